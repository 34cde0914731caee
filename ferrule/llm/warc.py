"""WARC archives: write, normalise to one gzip member a record with an offset index, read back.

``write_archives`` makes each archive as one monolithic gzip stream.  ``normalise`` inflates
such a stream once, from its start to its end, rewrites every record as its own member and
writes a sidecar index with each member's offset and length.  ``read_archives`` seeks each
member by the index alone and checks the payload's digest.  Memory is bounded by one
record; an archive is closed at ``ARCHIVE_BYTES``.

Files stand in the shared folder.  A task names its files by a fresh token and only the
manifest of tasks that ended well is read, so a task that is run again leaves no double.

Payloads: the html in UTF-8, a null is empty.  Of equal payloads of at least ``min_bytes``
the smallest page_id is the response and the others revisit it (a null page_id is larger than
all); rows that repeat that page_id are responses too.  A null url becomes the record's own
urn.  No pages give no rows, and further columns of the table don't matter.

Who revisits whom is found over ids and digests alone; payloads meet that by page_id and
digest together, so the rows of a common page are dealt over all tasks.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from typing import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text_arrays as ta

ARCHIVE_BYTES = 64 << 20
READ = 1 << 20
BASE16 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """Bare base32 SHA-1: each 40 bits of the digest are eight letters."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), BASE16, BASE32)


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None, kind: str) -> bytes:
    """One WARC record; a revisit has the headers of its payload only."""
    name = f"<urn:page:{page_id}>"
    uri = " ".join((url or f"urn:page:{page_id}").split())
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {uri}"]
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def header_fields(head: bytes) -> dict[str, str]:
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no WARC record: {first[:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def inflated(source) -> Iterator[bytes]:
    """The whole file's bytes, inflated once; one member or many."""
    z, open_ = zlib.decompressobj(31), False
    while raw := source.read(READ):
        while raw:
            open_ = True
            yield z.decompress(raw)
            raw = z.unused_data
            if z.eof:
                z, open_ = zlib.decompressobj(31), False
    if open_:
        raise ValueError("a gzip stream ends before its end mark")


def records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of an inflated stream."""
    have, need, at = bytearray(), 0, 0
    for chunk in chunks:
        have += chunk
        while True:
            if not need:
                at = have.find(b"\r\n\r\n")
                if at < 0:
                    break
                need = at + 4 + int(header_fields(bytes(have[:at]))["content-length"]) + 4
            if len(have) < need:
                break
            yield bytes(have[:need])
            del have[:need]
            need = 0
    if have.strip():
        raise ValueError("an archive ends inside a record")


def identify(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload (null for revisits), payload_bytes, payload_digest, record_type, refers_to."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("payload_digest", base32_sha1(F.col("payload")))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    small = ta.cut(rows.where(F.col("payload_bytes") >= min_bytes).select(F.col("page_id").alias("id"), F.col("payload_digest").alias("digest")), "digests")
    first = small.groupBy("digest").agg(F.min("id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = small.distinct().join(first, "digest").where("first_id is not null and not (first_id <=> id)")
    same = (F.col("digest") == F.col("payload_digest")) & F.col("id").eqNullSafe(F.col("page_id"))
    known = F.col("first_id").isNotNull()
    return rows.join(again, same, "left").select(
        "page_id", "url", F.when(~known, F.col("payload")).alias("payload"), "payload_bytes", "payload_digest",
        F.when(known, "revisit").otherwise("response").alias("record_type"), F.col("first_id").alias("refers_to"),
    )


def write_archives(identified: DataFrame, folder: str) -> DataFrame:
    """A record a row, in monolithic gzip archives; returns the manifest (path, n_records)."""
    ta.bounded_batches(identified.sparkSession)

    def run(batches):
        files, path = filesystem(folder)
        files.create_dir(path, recursive=True)
        token, number, out, z, name, size, n = uuid.uuid4().hex, 0, None, None, "", 0, 0
        done = []
        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    name = f"{path}/{token}-{number}.warc.gz"
                    out, z, size, n = files.open_output_stream(name, compression=None), zlib.compressobj(6, zlib.DEFLATED, 31), 0, 0
                    number += 1
                data = record(r["page_id"], r["url"], r["payload"], r["payload_bytes"], r["payload_digest"], r["refers_to"], r["record_type"])
                out.write(z.compress(data))
                size, n = size + len(data), n + 1
                if size >= ARCHIVE_BYTES:
                    out.write(z.flush())
                    out.close()
                    done.append((name, n))
                    out = None
        if out is not None:
            out.write(z.flush())
            out.close()
            done.append((name, n))
        yield pa.RecordBatch.from_pydict({"path": pa.array([x for x, _ in done], pa.string()), "n_records": pa.array([x for _, x in done], pa.int64())})

    return ta.cut(identified.mapInArrow(ta.released(run), "path string, n_records long"), "archives")


def spread(manifest: DataFrame) -> DataFrame:
    """One archive a task, as far as there are tasks."""
    return manifest.repartition(max(1, manifest.count()), "path")


def normalise(manifest: DataFrame, folder: str) -> DataFrame:
    """Each archive again with one gzip member a record, and its sidecar index; returns (path, index_path, n_records)."""

    def run(batches):
        for batch in batches:
            for source in batch.column(0).to_pylist():
                files, base = filesystem(folder)
                name = f"{base}/{source.rpartition('/')[2].removesuffix('.warc.gz')}-{uuid.uuid4().hex[:8]}"
                at = n = 0
                with (
                    files.open_input_stream(source, compression=None) as raw,
                    files.open_output_stream(f"{name}.members.warc.gz", compression=None) as out,
                    files.open_output_stream(f"{name}.index.tsv", compression=None) as index,
                ):
                    for data in records(inflated(raw)):
                        z = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = z.compress(data) + z.flush()
                        out.write(member)
                        head = header_fields(data[: data.find(b"\r\n\r\n")])
                        index.write(f"{at}\t{len(member)}\t{head['warc-record-id']}\t{head['warc-type']}\n".encode())
                        at, n = at + len(member), n + 1
                made = {"path": [f"{name}.members.warc.gz"], "index_path": [f"{name}.index.tsv"], "n_records": [n]}
                yield pa.RecordBatch.from_pydict(made, schema=pa.schema([("path", pa.string()), ("index_path", pa.string()), ("n_records", pa.int64())]))

    return ta.cut(spread(manifest).mapInArrow(ta.released(run), "path string, index_path string, n_records long"), "members")


def page_number(urn: str | None) -> int | None:
    text = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text.lstrip("-").isdigit() else None


def parse(data: bytes) -> dict:
    """A record's fields; a response's digest is made anew and must agree with its header."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = header_fields(head)
    http, _, payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
    size = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest, kind = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"{fields['warc-record-id']}: the payload differs from its header")
    return {
        "page_id": page_number(fields["warc-record-id"]), "payload_bytes": size, "payload_digest": digest, "record_type": kind,
        "refers_to": page_number(fields.get("warc-refers-to")), "url": fields["warc-target-uri"], "payload": payload if kind == "response" else None,
    }


def read_archives(members: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """A row a record, each member found by its index entry."""
    kinds = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())]
    kinds += [("payload", pa.binary())] * payloads
    schema = pa.schema(kinds)

    def run(batches):
        for batch in batches:
            for path, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                files, _ = filesystem(folder)
                with files.open_input_stream(index, compression=None) as f:
                    entries = [line.split(b"\t") for line in f.read().splitlines()]
                rows, held = [], 0
                with files.open_input_file(path) as f:
                    for at, size, *_ in entries:
                        got = parse(zlib.decompress(f.read_at(int(size), int(at)), 31))
                        held += got["payload_bytes"]
                        rows.append(got)
                        if len(rows) == 500 or held > ta.CHUNK_BYTES:
                            yield pa.RecordBatch.from_pylist([{k: r[k] for k, _ in kinds} for r in rows], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist([{k: r[k] for k, _ in kinds} for r in rows], schema=schema)

    types = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string" + ", payload binary" * payloads
    return spread(members).mapInArrow(ta.released(run), types)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = ta.shared_dir(spark, "warc")
    manifest = write_archives(identify(ta.table(spark, sf_dir, "pages")), folder)
    members = normalise(manifest, folder)
    return read_archives(members, folder, payloads=False).drop("url")


ORACLE = f"""
with p as (select page_id, coalesce(html, '') as html from pages),
s as (select page_id, strlen(html) as payload_bytes, sha1(html) as hex from p),
d as (select page_id, payload_bytes, hex,
    array_to_string(list_transform(range(32), lambda i: substr('{BASE32}', 1 + (((('0x' || substr(hex, 1 + 10 * (i // 8), 10))::bigint) >> (5 * (7 - i % 8))::int) & 31)::int, 1)), '') as payload_digest from s),
f as (select hex, min(page_id) as first_id from d group by hex)
select page_id, payload_bytes::bigint as payload_bytes, payload_digest, case when first_id is distinct from page_id and first_id is not null then 'revisit' else 'response' end as record_type,
  case when first_id is distinct from page_id then first_id end as refers_to
from d join f using (hex)
"""
