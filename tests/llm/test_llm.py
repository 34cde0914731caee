"""The training-data operators against brute force, libraries, round trips and held-out labels."""

import base64
import hashlib
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from ferrule.llm import bpe, decontaminate, langid, lm_attention, ngram_jaccard, quality, registry, sharding, token_count, toxicity, warc
from ferrule.llm import text_arrays as ta

SF = "/root/testdata/sf0.001"
WS = " \t\n\x0b\f\r"


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    out, now = [], ""
    for c in fold(text):
        if c in WS:
            if now:
                out.append(now)
            now = ""
        else:
            now += c
    return out + [now] if now else out


def shingle_set(text):
    w = words(text)
    return set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def odd_texts():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    base = make(60)
    texts = [None, "", " \t\n", "one", "One", "one two", "one two three four", "a b c d e", "A B C D E", "<|endoftext|> x"]
    texts += [" ".join(base)] * 5
    for i in range(40):
        near = list(base)
        near[rng.randrange(60)] = f"x{i}"
        texts.append("  ".join(near))
    texts += [" ".join(make(rng.randint(1, 80))) for _ in range(60)]
    texts += ["\n".join(" ".join(make(20)) for _ in range(400)), "z" * 5000, "日本 語 " * 50, "a b c\x00d"]
    return list(enumerate(texts, start=3))


def frame(spark, rows, n=3):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(n)


def brute_links(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    ids = [i for i, _ in rows]
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    degree = dict.fromkeys(ids, 0)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * len(sets[a] | sets[b]):
                degree[a] += 1
                degree[b] += 1
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i), degree[i]) for i in ids}


def test_jaccard_brute_force(spark):
    rows = odd_texts()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in ngram_jaccard.join(frame(spark, rows)).collect()}
    assert got == brute_links(rows)


def test_jaccard_splits_hot_groups(spark, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "GROUP", 8)
    rows = odd_texts()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in ngram_jaccard.join(frame(spark, rows)).collect()}
    assert got == brute_links(rows)


def test_jaccard_chain_and_empty(spark):
    base = [f"w{i}" for i in range(300)]
    rows = []
    for k in range(12):  # each links to its neighbours only: components need several rounds
        rows.append((100 - k, " ".join(base[: 300 - 0] if k == 0 else [*[f"v{j}" for j in range(k * 20)], *base[k * 20 :]])))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in ngram_jaccard.join(frame(spark, rows)).collect()}
    assert got == brute_links(rows)
    assert ngram_jaccard.join(frame(spark, []).limit(0)).count() == 0


def test_jaccard_long_drift(spark):
    n = 3000
    texts = [(i, " ".join(f"w{j}" for j in range(4 * i, 4 * i + 60))) for i in range(n)]
    got = {r.doc_id: (r.component_id, r.n_links) for r in ngram_jaccard.join(frame(spark, texts)).collect()}
    assert got == {i: (0, 1 if i in (0, n - 1) else 2) for i in range(n)}


def test_components_of_chains_and_trees(spark):
    rng = random.Random(8)
    mixed = rng.sample(range(10**6), 3000)
    chain = list(zip(mixed[:1500], mixed[1:1500]))
    tree = [(mixed[1500 + i], mixed[1500 + rng.randrange(i)]) for i in range(1, 1000)]
    star = [(mixed[2500], x) for x in mixed[2501:]]
    edges = spark.createDataFrame([*chain, *tree, *star, (mixed[0], mixed[0])], "a long, b long")
    parts = {}
    for r in ngram_jaccard.components(edges).collect():
        parts.setdefault(r.root, []).append(r.cid)
    got = {v: min(part) for part in parts.values() for v in part}
    assert got == {v: min(part) for part in (mixed[:1500], mixed[1500:2500], mixed[2500:]) for v in part}


def test_repeated_rows_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 9.0, "x"), (1, "a b c d e f", 9.0, "x"), (2, None, 1.0, "y")], "doc_id long, text string, score double, component_id string")
    got = sorted((r.doc_id, r.component_id, r.n_links) for r in ngram_jaccard.join(df).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (2, 2, 0)]
    w = [f"w{i}" for i in range(60)]  # B and C are near A, but not near each other
    a, b, c = w, ["x", *w[1:30], *w[30:]], [*w[:59], "y"]
    two = spark.createDataFrame([(5, " ".join(a)), (5, " ".join(b)), (9, " ".join(c)), (None, " ".join(a[:-1]))], "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in ngram_jaccard.join(two).collect()}
    assert got == {(5, 56, 5, 3), (9, 56, 5, 3), (None, 55, 5, 3)}
    model = toxicity.fit(["a", "b"], np.array([0, 1]))
    out = toxicity.score_toxicity(df, model)
    assert out.columns == ["doc_id", "text", "component_id", "score"] and out.count() == 3


def test_bpe_matches_library_and_round_trips(spark):
    import public_tokenizers as P
    import tiktoken

    ranks = bpe.load_ranks(bpe.vocabulary_path())
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = odd_texts()
    texts = dict(rows)
    got = bpe.decode(bpe.encode(frame(spark, rows))).collect()
    assert len(got) == len(rows)
    for r in got:
        assert list(r.ids) == library.encode_ordinary(texts[r.doc_id] or "")
        assert bytes(r.decoded).decode() == (texts[r.doc_id] or "")


def test_bpe_out_of_order_ranks():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 300, b"abc": 299, b"bc": 310, b"aa": 301, b"aaa": 298}
    encoder = bpe.Encoder(ranks)
    rng = random.Random(1)
    tests = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    for word, ids in zip(tests, encoder.encode(tests)):
        assert ids == ([ranks[word.encode()]] if word.encode() in ranks else brute_bpe(ranks, word.encode()))


def brute_bpe(ranks, word):
    parts = [bytes([b]) for b in word]
    while found := [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]:
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[x] for x in parts]


def test_bpe_replay_under_random_ranks():
    rng = random.Random(1)
    for _ in range(60):
        letters = b"abc"[: rng.randint(1, 3)]
        more = {bytes(rng.choice(letters) for _ in range(rng.randint(2, 5))) for _ in range(rng.randint(1, 25))}
        ranks = {x: i for i, x in enumerate([bytes([b]) for b in range(256)] + rng.sample(sorted(more), len(more)))}
        tried = [bytes(rng.choice(letters) for _ in range(rng.randint(1, 30))) for _ in range(40)]
        flat, lens = bpe.Encoder(ranks).replay(tried)
        got = [x.tolist() for x in np.split(flat, np.cumsum(lens)[:-1])]
        assert got == [[ranks[w]] if w in ranks else brute_bpe(ranks, w) for w in tried]


def test_very_long_texts(spark):
    """A text of megabytes, and one word of megabytes without a blank, through every operator of texts."""
    import tiktoken

    rng = random.Random(2)
    word = "".join(rng.choice("etaoinshrdlu") for _ in range(1_000_000))
    rows = [(1, word), (2, "der Hund und die Katze. " * 50_000), (3, "ab" * 100_000)]
    df = frame(spark, rows)
    library = tiktoken.Encoding("own", pat_str=bpe.pattern(), mergeable_ranks=bpe.load_ranks(bpe.vocabulary_path()), special_tokens={})
    got = {r.doc_id: r for r in bpe.round_trip(df).collect()}
    assert all(bytes(got[i].decoded).decode() == t for i, t in rows) and list(got[2].ids) == library.encode_ordinary(rows[1][1])
    assert {r.doc_id: r.n_shingles for r in ngram_jaccard.join(df).collect()} == {1: 1, 2: 5, 3: 1}
    assert {r.doc_id: r.n_tokens for r in token_count.count_tokens(df).collect()}[2] > 200_000
    model = langid.fit(["the cat and the dog", "der Hund und die Katze"], ["en", "de"])
    assert {r.doc_id: r.lang_pred for r in langid.identify_language(df, model).collect()}[2] == "de"
    assert decontaminate.find_leaks(df, spark.createDataFrame([(7, "die Katze. der Hund und die")], "item_id long, text string")).count() == 1
    assert lm_attention.score(df, F.col("doc_id") == 2).count() == 3
    assert toxicity.score_toxicity(df, toxicity.fit(["a", "b"], np.array([0, 1]))).count() == 3
    assert {r.doc_id: r.n_words for r in quality.measure(df).select("doc_id", "n_words").collect()} == {1: 1, 2: 250_000, 3: 1}


def test_bpe_forgets_without_change(monkeypatch):
    texts = [t for _, t in odd_texts()]
    ranks = bpe.load_ranks(bpe.vocabulary_path())
    want = bpe.Encoder(ranks).encode(texts)
    monkeypatch.setattr(bpe, "REMEMBER", 50)
    small = bpe.Encoder(ranks)
    assert [small.encode([t])[0] for t in texts * 2] == want * 2


def test_bpe_splits_like_the_pattern():
    import public_tokenizers as P
    import tiktoken

    ranks = bpe.load_ranks(bpe.vocabulary_path())
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(8)
    pieces = [" ", " ", "a", "b.", "it's", "\n", "\t", "  ", "\u00a0", "\u3000", "12", "²", "é", ",", "\r\n", "\x1c", "\x85", "I'll"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    assert bpe.Encoder(ranks).encode(texts) == [library.encode_ordinary(t) for t in texts]


def test_bpe_decode_rejects_unknown_ids(spark):
    some = spark.createDataFrame([(1, [0, 1]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded and bytes(r.decoded) for r in bpe.decode(some).collect()} == {1: b'!"', 2: None, 3: b""}
    bad = spark.createDataFrame([(1, [60000])], "doc_id long, ids array<int>")
    with pytest.raises(Exception, match="vocabulary"):
        bpe.decode(bad).collect()


def test_token_counts_match_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_count.vocabulary_path(token_count.VOCABULARY))
    rows = odd_texts()
    got = {r.doc_id: r.n_tokens for r in token_count.count_tokens(frame(spark, rows)).collect()}
    assert got == {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in rows}


def weighted(window, item):
    from collections import Counter

    a, b = Counter(window), Counter(item)
    return sum((a & b).values()) / sum((a | b).values())


def grams(w):
    return [tuple(w[i : i + min(5, len(w))]) for i in range(len(w) - min(5, len(w)) + 1)] if w else []


def brute_leaks(rows, items):
    out = {}
    for i, text in rows:
        w = words(text)
        for j, item in items:
            m = words(item)
            if not m or not w or len(w) < min(5, len(m)) or (len(m) < 5 and len(w) < len(m)):
                continue
            size = min(len(m), len(w))
            best = max(weighted(grams(w[s : s + size]), grams(m)) for s in range(len(w) - size + 1))
            if best >= 0.8:
                out[i, j] = round(best, 9)
    return out


def test_decontamination_brute_force(spark):
    rng = random.Random(2)
    noise = lambda n: [f"n{rng.randrange(5000)}" for _ in range(n)]
    items = [(k, " ".join(noise(rng.randint(12, 50)))) for k in range(20)] + [(90, None), (91, ""), (92, "Tiny item"), (93, "five words stand right here")]
    rows = [(1, None), (2, ""), (3, "tiny"), (4, "so Tiny  item here")]
    for k in range(40):
        w = words(items[k % 20][1])
        if k % 4 == 1:
            w[len(w) // 2] = "changed"
        if k % 4 == 2:
            w = w[: len(w) // 2]
        if k % 4 == 3:
            w = w[1:]
        rows.append((10 + k, " ".join(noise(rng.randint(0, 60)) + w + noise(rng.randint(0, 60)))))
    rows.append((70, " ".join(words(items[0][1])[:-1])))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in decontaminate.find_leaks(frame(spark, rows), bench).collect()}
    assert got == brute_leaks(rows, items)


def test_multi_index_finds_all_within_radius():
    rng = np.random.default_rng(0)
    items = decontaminate.Items(list(range(50)), [" ".join(f"w{rng.integers(9999)}" for _ in range(30)) for _ in range(50)])
    prints = items.prints[rng.integers(0, 50, 400)].copy()
    for p in prints:
        for bit in rng.choice(64, rng.integers(0, 30), replace=False):
            p[bit // 8] ^= 1 << (bit % 8)
    far = decontaminate.POPCOUNT[prints[:, None] ^ items.prints[None]].sum(2)
    assert set(items.candidates(30, prints)) == set(zip(*(x.tolist() for x in np.nonzero(far <= decontaminate.RADIUS))))


def test_radius_loses_nothing(spark, monkeypatch):
    docs, bench = ta.table(spark, "/root/testdata/sf0.01", "documents"), ta.table(spark, "/root/testdata/sf0.01", "benchmark")
    got = sorted(tuple(r) for r in decontaminate.find_leaks(docs, bench).collect())
    rows = bench.collect()
    items = decontaminate.Items([r.item_id for r in rows], [r.text for r in rows])
    everything = lambda n, prints: [(i, int(k)) for i in range(len(prints)) for k in np.flatnonzero(items.size == n)]
    monkeypatch.setattr(items, "candidates", everything)
    ids = [(r.doc_id, r.text) for r in docs.collect()]
    want = sorted((ids[r][0], items.ids[i], s, e, same) for r, i, s, e, same in items.leaks(pa.array([t for _, t in ids])))
    assert got == want and got


def test_warc_round_trip(spark, tmp_path):
    rows = [(5, "http://a", "<p>é</p>"), (3, None, "<p>é</p>"), (9, "u", None), (8, "u", ""), (4, "u\r\nx", "x" * 200000), (4, "u\r\nx", "x" * 200000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    folder = f"file://{tmp_path}/w"
    got = warc.read_archives(warc.normalise(warc.write_archives(warc.identify(pages), folder), folder), folder).collect()
    assert len(got) == len(rows)
    html = {i: (h or "").encode() for i, _, h in rows}
    for r in got:
        body = html[r.page_id]
        assert r.payload_bytes == len(body)
        assert r.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == body
    assert {(r.page_id, r.record_type, r.refers_to) for r in got} == {(5, "revisit", 3), (3, "response", None), (9, "revisit", 8), (8, "response", None), (4, "response", None)}
    empty = warc.write_archives(warc.identify(pages.limit(0)), folder)
    assert warc.read_archives(warc.normalise(empty, folder), folder).count() == 0


def test_warc_rejects_truncation():
    data = zlib.compress(b"x")
    whole = warc.record(1, "u", b"abc", 3, base64.b32encode(hashlib.sha1(b"abc").digest()).decode(), None, "response")
    assert list(warc.records(iter([whole[:9], whole[9:] + whole]))) == [whole, whole]
    with pytest.raises(ValueError):
        list(warc.records(iter([whole[:-9]])))
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    packed = pa.BufferReader((z.compress(whole) + z.flush())[:-4])
    with pytest.raises(ValueError):
        list(warc.inflated(packed))
    assert data


def test_quality_against_sql_and_python(spark):
    rows = odd_texts() + [(900, "a b c a b c a b c d"), (901, "x y z\nx y z\n\nx y z"), (902, "##### ### $$$\nfine words stand here."), (903, "Home | About | Contact\nHome\nreal text.")]
    got = {r.doc_id: r for r in quality.measure(frame(spark, rows)).collect()}
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [i for i, _ in rows], "text": pa.array([t for _, t in rows], pa.string())}))
    for r in con.sql(quality.ORACLE).fetchall():
        x = got[r[0]]
        assert (x.doc_id, x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed, x.kept) == r
    for i, text in rows:
        w = []
        for part in (text or "").translate({ord(c): " " for c in WS}).split(" "):
            w += [part] if part else []
        seen = {}
        for k in range(len(w) - 2):
            seen.setdefault(tuple(w[k : k + 3]), []).append(k)
        covered = {k + d for ks in seen.values() if len(ks) > 1 for k in ks for d in range(3)}
        assert (got[i].n_words, got[i].n_repeat_words) == (len(w), len(covered))
    assert got[903].clean_text == "real text."


def test_quality_is_native(spark):
    plan = quality.query(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_sharding_brute_force(spark, monkeypatch):
    rows = odd_texts() + [(500, "copy " * 40)] * 3 + [(k, "copy " * 40) for k in range(600, 700)]
    got = sharding.assign(frame(spark, rows), shards=7).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    by_text, slots, loads = {}, {}, {}
    for r in got:
        body = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(body) + 16, zlib.crc32(body), "bytes", None)
        by_text.setdefault(body, set()).add(r.shard)
        slots.setdefault(r.shard, []).append(r.slot)
        loads[r.shard] = loads.get(r.shard, 0) + r.size
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(slots) <= set(range(7))
    total, groups = sum(loads.values()), {}
    for i, t in rows:
        groups[t or ""] = groups.get(t or "", 0) + len((t or "").encode()) + 16
    assert max(loads.values()) <= max(total / 7, max(groups.values())) + max(groups.values())
    assert sharding.assign(frame(spark, rows).limit(0), shards=7).count() == 0


def plain_lpt(sizes, shards):
    loads = [0] * shards
    for size in sorted(sizes, reverse=True):
        loads[loads.index(min(loads))] += size
    return sorted(loads)


def test_longest_first_is_lpt(spark):
    rng = random.Random(4)
    for _ in range(200):
        shards = rng.randint(1, 6)
        classes = {rng.randint(1, 40): rng.choice([1, 2, 3, 50, 700]) for _ in range(rng.randint(1, 12))}
        loads = [0] * shards
        seen = {}
        for size, shard, lo, hi in sharding.longest_first(list(classes.items()), shards):
            loads[shard] += size * (hi - lo)
            seen.setdefault(size, []).append((lo, hi))
        assert sorted(loads) == plain_lpt([s for s, n in classes.items() for _ in range(n)], shards)
        for size, ranges in seen.items():  # every rank once
            assert sorted(x for lo, hi in ranges for x in range(lo, hi)) == list(range(classes[size]))
    rows = odd_texts()
    loads, groups = {}, {}
    for r in sharding.assign(frame(spark, rows), shards=7).collect():
        loads[r.shard] = loads.get(r.shard, 0) + r.size
    for _, t in rows:
        groups[t or ""] = groups.get(t or "", 0) + len((t or "").encode()) + 16
    assert sorted(loads.values()) == [x for x in plain_lpt(groups.values(), 7) if x]


def brute_marginal(word, prob):
    """Sum over all segmentations of one word, by recursion."""
    if not word:
        return 1.0
    return sum(prob.get(word[:k], 0.0) * brute_marginal(word[k:], prob) for k in range(1, len(word) + 1))


def test_forward_sums_all_segmentations():
    texts = ["abab baba the cat", "der hund und die katze"]
    model = langid.fit(texts, ["x", "y"], rounds=1)
    lookup = langid.Lookup(model.keys)

    def key(piece):
        d = np.frombuffer(piece, np.uint8)
        return int(lookup(ta.span_hashes(d, np.array([0]), np.array([len(d)])))[0])

    w = ta.words_of(pa.array(["abab katze international"]))
    got = langid.word_log_prob(w.data, w.starts, w.ends - w.starts, model, lookup)
    for i, (a, b) in enumerate(zip(w.starts, w.ends)):
        word = b" " + w.data[a:b].tobytes()
        pieces = {word[a:b]: key(word[a:b]) for a in range(len(word)) for b in range(a + 1, len(word) + 1)}
        for j in range(2):
            prob = {p: model.prob[k, j] for p, k in pieces.items() if k >= 0}
            assert np.isclose(10 ** got[i, j], brute_marginal(word, prob), rtol=1e-9)
    # words of any length, by whatever way: in doubles, in extended floats, scaled
    data = np.frombuffer(b"donaudampfschiff" * 200, np.uint8)
    for size in (20, 32, 33, 400, 512):
        got = langid.word_log_prob(data, np.array([0]), np.array([size]), model, lookup)[0]
        assert np.allclose(got, langid.long_word(data[:size], model, lookup), rtol=1e-9)
    texts = pa.array(["abab katze", "die katze " * 3 + "donaudampfschiff" * 100, None])
    scorer = langid.Scorer(model)
    first, again = scorer.predict(texts), scorer.predict(texts)
    assert first[0] == again[0] and (first[1] == again[1]).all()
    w = ta.words_of(texts)
    total = langid.word_log_prob(w.data, w.starts, w.ends - w.starts, model, lookup)[w.doc == 0].sum(0)
    assert np.isclose(first[1][0], 1 / (10 ** (total - total.max())).sum())


def test_language_held_out(spark):
    rows = {r.doc_id: r for r in langid.query(spark, SF).collect()}
    lang = {r.doc_id: r.lang for r in ta.table(spark, SF, "documents").collect()}
    held = [i for i, r in rows.items() if r.held_out]
    assert sum(rows[i].lang_pred == lang[i] for i in held) >= 0.95 * len(held)
    model = langid.fit(["the cat", "der hund"], ["en", "de"])
    out = {r.doc_id: r for r in langid.identify_language(frame(spark, [(1, None), (2, "123 !"), (3, ""), (4, "the " * 50 + "q" * 900)]), model).collect()}
    assert [(out[i].lang_pred, out[i].score) for i in (1, 2, 3)] == [("und", 0.0)] * 3 and out[4].lang_pred == "en"
    assert langid.fit([], []).languages == []


def test_toxicity_learns_pairs_and_held_out(spark):
    rng = random.Random(3)
    noise = lambda: [f"n{rng.randrange(200)}" for _ in range(12)]
    texts, labels = [], []
    for k in range(1200):  # toxic only if both words stand together
        a, b = k % 2, (k // 2) % 2
        texts.append(" ".join(noise() + ["insult"] * a + ["group"] * b))
        labels.append(a * b)
    model = toxicity.fit(texts, np.array(labels))
    fresh = [" ".join(noise() + more) for more in (["insult"], ["group"], ["insult", "group"], []) for _ in range(50)]
    toxic = (toxicity.predict(model, pa.array(fresh)) >= 0.5).reshape(4, 50).mean(1)
    assert toxic[2] > 0.95 and max(toxic[0], toxic[1], toxic[3]) < 0.05
    # either word alone: neither tells anything by itself
    model = toxicity.fit(texts, np.array([(k % 2) ^ ((k // 2) % 2) for k in range(1200)]))
    toxic = (toxicity.predict(model, pa.array(fresh)) >= 0.5).reshape(4, 50).mean(1)
    assert min(toxic[0], toxic[1]) > 0.95 and max(toxic[2], toxic[3]) < 0.05
    for text, score in zip(fresh[::20], toxicity.predict(model, pa.array(fresh[::20]))):  # the sum over all pairs, pair by pair
        _, terms = toxicity.distinct_terms(*toxicity.term_sets(pa.array([text])))
        at = [i for i in np.searchsorted(model.buckets, terms) if i < len(model.buckets) and model.buckets[i] in terms]
        z = model.bias + sum(float(model.linear[i]) for i in at)
        z += sum(float(model.factors[i].astype(float) @ model.factors[j].astype(float)) for n, i in enumerate(at) for j in at[n + 1 :])
        assert np.isclose(score, 1 / (1 + np.exp(-z)), rtol=1e-5)
    assert np.allclose(*toxicity.predict(model, pa.array(["", None], pa.string())))
    got = toxicity.query(spark, "/root/testdata/sf0.1").join(ta.table(spark, "/root/testdata/sf0.1", "labels"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in got) >= 0.95 * len(got)
    assert sum(r.predicted for r in got if r.toxic) >= 0.85 * sum(r.toxic for r in got)  # some 290 toxic documents to learn from
    assert toxicity.fit([], np.array([])).bias == -40.0


def test_lm_base_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm_attention, "FREQUENT", 30)  # most words go the way of the shuffle
    rows = odd_texts()
    train = rows[::2]
    from collections import Counter
    from math import log10

    counts = Counter(x for _, t in train for x in [*words(t), None])
    n, v = sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in lm_attention.score(frame(spark, rows), F.col("doc_id").isin([i for i, _ in train])).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        w = [*words(t), None]
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(w), sum(counts[x] > 0 for x in w), n)
        assert abs(got[i].base_score - sum(log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)) < 1e-6 * len(w)
        assert got[i].score < 0


def test_lm_context_width():
    assert (lm_attention.WINDOW, lm_attention.HEADS, lm_attention.BANDS) == (32, 72, 24)
    _, begin, length, skip = lm_attention.windows(np.array([500]))
    first = begin + skip  # of each later window: so many ids before it stand in the same window
    assert len(begin) > 10 and (first[1:] - begin[1:] >= 8).all() and (length[:-1] == 32).all()


def encoded(spark, rows, n=3):
    return lm_attention.encode(frame(spark, rows, n), None, "text", "doc_id", F.lit(True))


def streams(spark, rows):
    got = encoded(spark, rows, 1).select("ids").toArrow().column(0).combine_chunks()
    return lm_attention.id_streams(got, np.uint16)


def test_lm_layout_and_weights_take_the_whole_corpus(spark, monkeypatch):
    rows = odd_texts()
    ids, _ = streams(spark, rows)
    want, seen, layout = np.bincount(ids, minlength=50257), [], lm_attention.layout
    monkeypatch.setattr(lm_attention, "SAMPLE", 2)
    monkeypatch.setattr(lm_attention, "layout", lambda counts: seen.append(counts) or layout(counts))
    lm_attention.score(frame(spark, rows), F.lit(True)).count()
    assert (seen[0] == want).all()
    monkeypatch.setattr(lm_attention, "IDS_A_STEP", 1000)
    shape, steps = layout(want.astype(float)), []
    start = lm_attention.fit_weights(shape, ids[:0], np.zeros(0, int), want)
    for times in (1, 3):
        got = {(r.kind, r.key): r.n for r in lm_attention.corpus_pass(encoded(spark, rows * times, 1), shape, start, None).collect()}
        steps.append(got[4, lm_attention.ROWS + 1])
        assert sum(n for (k, _), n in got.items() if k == 2) == times * len(ids)
    assert steps == [-(-len(ids) // 1000), -(-3 * len(ids) // 1000)]


def test_lm_trains_once_on_every_id_of_every_text(spark):
    rows = [*odd_texts(), (999, "alpha beta gamma " * 15000)]
    ids, sizes = streams(spark, rows)
    assert sizes.max() * 2 > 1 << 16  # no text is too long to learn from
    shape = lm_attention.layout(np.bincount(ids, minlength=50257).astype(float))
    follow, at = np.zeros((lm_attention.ROWS + 1, lm_attention.CLASSES), dtype=np.int64), 0
    for n in sizes:
        before = lm_attention.ROWS
        for i in ids[at : at + n]:
            follow[before, shape.classes[i]] += 1
            before = shape.embedded[i]
        at += n
    got = np.zeros(follow.size, dtype=np.int64)
    for r in lm_attention.corpus_follow(encoded(spark, rows), shape, None).collect():
        assert r.kind == 5
        got[r.key] = r.n
    assert (got.reshape(follow.shape) == follow).all()
    start = lm_attention.start_weights(shape, np.bincount(ids, minlength=50257), follow)
    met = np.zeros(lm_attention.ROWS + 1, dtype=np.int64)
    for r in lm_attention.corpus_pass(encoded(spark, rows), shape, start, None).where(f"kind = 4 AND key <= {lm_attention.ROWS}").collect():
        met[r.key] = r.n
    assert (met == follow.sum(1)).all()


def test_lm_learns_from_counts_and_then_from_context(spark):
    texts = [(r.doc_id, r.text) for r in ta.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").orderBy("doc_id").collect()]
    df = encoded(spark, texts[:500], 2)
    ids, sizes = streams(spark, texts[:500])
    held, held_sizes = streams(spark, texts[500:])
    counts = np.bincount(ids, minlength=50257).astype(float)
    shape = lm_attention.layout(counts)
    tables = {3: np.zeros(sum(int(np.prod(x)) for x in lm_attention.SHAPES.values())), 4: np.zeros(lm_attention.ROWS + 2), 5: np.zeros((lm_attention.ROWS + 1) * lm_attention.CLASSES)}

    def fill(got):
        for r in got.where("kind > 2").collect():
            tables[r.kind][r.key] = r.n

    def logs(w):
        flat = lm_attention.Model(shape, np.zeros((lm_attention.CLASSES, lm_attention.ROWS)), np.zeros(50257), w)
        return lm_attention.score_ids(flat, held, held_sizes).sum()

    share = (np.bincount(shape.classes[ids], minlength=lm_attention.CLASSES) + 1.0) / (len(ids) + lm_attention.CLASSES)
    fill(lm_attention.corpus_follow(df, shape, None))
    start = lm_attention.start_weights(shape, counts, tables[5].reshape(lm_attention.ROWS + 1, -1))
    trained = start
    for _ in range(3):
        tables[3][:], tables[4][:] = 0, 0
        fill(lm_attention.corpus_pass(df, shape, trained, None))
        trained = lm_attention.averaged(trained, tables[3], tables[4])
    assert logs(trained) > 0.98 * logs(start) > 0.9 * np.log10(share[shape.classes[held]]).sum()


def test_lm_gradients_against_differences():
    rng = np.random.default_rng(4)
    w = {n: (rng.standard_normal(s) * 0.5).astype(np.float32) for n, s in lm_attention.SHAPES.items()}
    t = rng.integers(0, 40, (3, lm_attention.WINDOW))
    y = rng.integers(0, lm_attention.CLASSES, t.shape)
    y[0, 20:], y[1, :8] = -1, -1

    def loss(w):
        x = w["emb"][t] + w["pos"]
        a = np.exp(np.einsum("nid,njd->nij", x @ w["q"], x @ w["k"])) * np.tril(np.ones((t.shape[1],) * 2))
        z = (x + a / a.sum(-1, keepdims=True) @ (x @ w["v"]) @ w["o"]) @ w["out"] + w["bias"]
        p = np.take_along_axis(z, np.maximum(y, 0)[..., None], 2)[..., 0] - np.log(np.exp(z).sum(-1))
        return -p[y >= 0].mean()

    got = {}
    adam = lm_attention.Adam(w)
    adam.follow = got.update
    adam.step(t, y)
    assert sorted(got) == sorted(w)
    assert (adam.met == np.bincount(t[y >= 0], minlength=lm_attention.ROWS + 1)).all()
    exact = {n: x.astype(float) for n, x in w.items()}
    for n, x in exact.items():
        for _ in range(12):
            at = tuple(rng.integers(0, 40 if n == "emb" and i == 0 else size) for i, size in enumerate(x.shape))
            kept, sides = x[at], []
            for x[at] in (kept + 1e-5, kept - 1e-5):
                sides.append(loss(exact))
            x[at] = kept
            assert abs(got[n][at] - (sides[0] - sides[1]) / 2e-5) < 1e-4, (n, at)


def test_lm_kept_words_take_little_memory():
    import tracemalloc

    subwords = lm_attention.Subwords(lm_attention.vocabulary_path(lm_attention.VOCABULARY))
    w = ta.words_of(pa.array([" ".join(f"w{i:x}" for i in range(30000))]))
    keys, first = np.unique(w.hashes, return_index=True)
    tracemalloc.start()
    try:
        subwords.numbers(keys, w, first)
        assert len(subwords.known) == 30000 and tracemalloc.get_traced_memory()[0] < 80 * 30000
    finally:
        tracemalloc.stop()


def test_lm_kept_words_change_no_ids(monkeypatch):
    subwords = lm_attention.Subwords(lm_attention.vocabulary_path(lm_attention.VOCABULARY))
    texts = [t for _, t in odd_texts()]

    def run():
        out = []
        for text in [*texts, *texts[::-1]]:
            w = ta.words_of(pa.array([text, "ein hund"]))
            keys, first, inverse = np.unique(w.hashes, return_index=True, return_inverse=True)
            ids, sizes = subwords.streams(w, subwords.numbers(keys, w, first)[inverse])
            assert sizes.sum() == len(ids)
            out.append(ids.tolist())
        return out

    kept = run()
    assert len(subwords.known) > 100 and kept == kept[: len(texts)] + kept[: len(texts)][::-1]
    monkeypatch.setattr(lm_attention, "REMEMBER", 5)
    subwords.forget()
    assert run() == kept


def test_lm_words_encode_alike_alone_and_together():
    subwords = lm_attention.Subwords(lm_attention.vocabulary_path(lm_attention.VOCABULARY))
    tried = ["der", "hund,", "a\u00a0", "x\u3000y", "é!", "42"]
    flat, lens = subwords.encoded(tried)
    parts = [x.tolist() for x in np.split(flat, np.cumsum(lens)[:-1])]
    for word, ids in zip(tried, parts):
        assert subwords.encoding.decode(ids) == " " + word
    plain = [w for w in tried if not w.isspace() and "\u00a0" not in w]
    flat, lens = subwords.encoded(plain)
    assert flat.tolist() == [i for w in plain for i in subwords.encoding.encode_ordinary(" " + w)]


def test_lm_score_against_plain_loops():
    rng = np.random.default_rng(2)
    shape = lm_attention.layout(np.arange(500.0))
    start = lm_attention.train_weights(np.zeros((0, lm_attention.WINDOW), int), np.zeros((0, lm_attention.WINDOW), int), np.ones(lm_attention.CLASSES))
    pairs = rng.integers(0, 3, (lm_attention.CLASSES, lm_attention.ROWS))
    model = lm_attention.Model(shape, *lm_attention.shares(shape, np.arange(500.0), pairs), start)
    w = {n: x.astype(float) for n, x in start.items()}
    sizes = np.array([1, 31, 32, 33, 90])
    ids = rng.integers(0, 500, sizes.sum())
    ids[np.cumsum(sizes) - 1] = 499
    want, at = [], 0
    for n in sizes:
        text, total, done, begin = ids[at : at + n], 0.0, 0, 0
        while done < n:
            piece = text[begin : begin + 32]
            before = [lm_attention.ROWS if begin + k == 0 else shape.embedded[text[begin + k - 1]] for k in range(len(piece))]
            x = w["emb"][before] + w["pos"][: len(piece)]
            for k in range(done - begin, len(piece)):
                scores = np.exp([x[k] @ w["q"] @ (x[j] @ w["k"]) for j in range(k + 1)])
                h = x[k] + (sum(a * (x[j] @ w["v"]) for j, a in enumerate(scores)) / scores.sum()) @ w["o"]
                z = h @ w["out"] + w["bias"]
                i = piece[k]
                last = 499 if begin + k == 0 else text[begin + k - 1]
                total += (z[shape.classes[i]] - np.log(np.exp(z).sum())) / np.log(10) + model.after[shape.classes[last], shape.embedded[i]] + model.inner[i]
            done = begin + len(piece)
            begin += 24
        want.append(total)
        at += n
    assert np.allclose(lm_attention.score_ids(model, ids, sizes), want, rtol=1e-4)


def test_lm_windows_score_each_id_once():
    sizes = np.array([1, 5, 24, 25, 44, 45, 200])
    row, begin, length, skip = lm_attention.windows(sizes)
    for i, n in enumerate(sizes):
        hits = [b + k for r, b, ln, s in zip(row, begin, length, skip) if r == i for k in range(s, ln)]
        assert sorted(hits) == list(range(n))


def test_lm_is_a_distribution_and_causal():
    rng = np.random.default_rng(1)
    shape = lm_attention.layout(np.arange(3000.0))
    pairs = rng.integers(0, 3, (lm_attention.CLASSES, lm_attention.ROWS))
    weights = lm_attention.train_weights(np.zeros((0, lm_attention.WINDOW), int), np.zeros((0, lm_attention.WINDOW), int), np.ones(lm_attention.CLASSES))
    model = lm_attention.Model(shape, *lm_attention.shares(shape, np.arange(3000.0), pairs), weights)
    # the texts of two ids that begin alike have that beginning's probability together
    heads = range(0, 3000, 400)
    ids = np.array([[a, b] for a in heads for b in range(3000)])
    p = 10 ** lm_attention.score_ids(model, ids.ravel(), np.full(len(ids), 2))
    first = 10 ** lm_attention.score_ids(model, np.array(heads), np.ones(len(heads), int))
    assert np.allclose(p.reshape(-1, 3000).sum(1), first, rtol=1e-3)
    one = 10 ** lm_attention.score_ids(model, np.arange(3000), np.ones(3000, int))
    assert np.isclose(one.sum(), 1, rtol=1e-3)


def test_lm_learns_context_on_held_out_text(spark):
    texts = [(r.doc_id, r.text) for r in ta.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").orderBy("doc_id").collect()]
    ids, sizes = streams(spark, texts[:500])
    shape = lm_attention.layout(np.bincount(ids, minlength=50257).astype(float))
    weights = lm_attention.fit_weights(shape, ids, sizes)
    held, held_sizes = streams(spark, texts[500:])
    flat = lm_attention.Model(shape, np.zeros((lm_attention.CLASSES, lm_attention.ROWS)), np.zeros(50257), weights)
    attention = lm_attention.score_ids(flat, held, held_sizes).sum()
    share = (np.bincount(shape.classes[ids], minlength=lm_attention.CLASSES) + 1.0) / (len(ids) + lm_attention.CLASSES)
    assert attention > 0.9 * np.log10(share[shape.classes[held]]).sum()


def test_words_arrays():
    for _, t in odd_texts():
        w = ta.words_of(pa.array([t, "x", t]))
        raw = [w.data[a:b].tobytes().decode() for a, b in zip(w.starts, w.ends)]
        assert raw == [*words(t), "x", *words(t)]


def test_registry_queries_run(spark):
    docs = ta.table(spark, SF, "documents").count()
    for name in ("op1_ngram_jaccard", "op2_byte_bpe", "op9_token_counts", "op10_sharding"):
        assert registry.queries()[name](spark, SF).count() == docs


def test_jaccard_oracle(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    want = sorted(con.sql(ngram_jaccard.ORACLE).fetchall())
    assert sorted(tuple(r) for r in ngram_jaccard.query(spark, SF).collect()) == want
