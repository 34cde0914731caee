"""Every named query with an SQL twin gives the same rows in DuckDB."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ferrule.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"rule_program_visit", "rule_program_consume", "minimax_open_board", "tree_lookup", "priority_bucket_sssp", "program_priorities", "program_placement", "program_thread_tokens", "program_min_selector"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLE and n not in SLOW])
def test_oracle(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((plain(tuple(r)) for r in df.select(*columns).collect()), key=repr)
    want = con.sql(f"select {', '.join(f'"{c}"' for c in columns)} from ({ORACLE[name]}) t").fetchall()
    assert got == sorted(map(plain, want), key=repr)


def same_text(spark, folder, name, tables):
    """The query over a folder of its own gives, as text, what its SQL gives: signs of zero count."""
    c = duckdb.connect()
    for t in tables:
        c.sql(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet/*.parquet')")
    df = QUERIES[name](spark, str(folder))
    want = c.sql(f"select {', '.join(f'"{x}"' for x in df.columns)} from ({ORACLE[name]}) t").fetchall()
    assert sorted(repr(plain(tuple(r))) for r in df.collect()) == sorted(repr(plain(r)) for r in want)


def test_rounding_keeps_the_sign_of_zero(spark, tmp_path):
    vectors = [(1, [-1e-8, 1e-8, -0.0, 0.0]), (2, [-2.5e-7, -3e-7, 0.5, -0.1]), (3, [0.00390625, -0.00390625, 1.0, 0.3])]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    same_text(spark, tmp_path, "builtin_vector", ["embeddings"])


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_time_slices_round_before_1970_and_in_any_zone(spark, tmp_path, zone):
    times = ["1969-12-31 23:59:59.999500", "1969-12-31 22:00:00", "1969-12-31 21:59:59.999999", "1970-01-01 00:59:59.999999", "1884-05-03 07:30:00.000001"]
    times += ["2024-03-10 02:30:00", "2024-03-10 03:30:00", "2024-11-03 01:30:00", "2262-01-01 00:00:00.000001", None]
    times += ["2024-01-01 00:59:59.999499", "2024-01-01 00:59:59.999500", "1960-01-01 00:00:00.000499", "1960-01-01 00:00:00.000500"]
    rows = [(i, t, i % 3, "click") for i, t in enumerate(times)]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string").withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        same_text(spark, tmp_path, "time_slices", ["events"])
        same_text(spark, tmp_path, "pred_agg_first", ["events"])
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


@pytest.mark.parametrize("name", ["node_local_join", "theta_join"])
def test_pairs_of_one_key_are_dealt_over_many_tasks(spark, tmp_path, name):
    people = [(i, 7, float(i % 50)) for i in range(400)] + [(1000, 8, 1.0), (1001, 8, None), (1002, None, 2.0), (1003, 9, 3.0)]
    firms = [(i, 7, float(i % 40)) for i in range(90)] + [(1000, 8, 0.5), (1001, 8, None), (1002, None, 2.0), (1003, 10, 3.0), (None, 8, -1.0)]
    spark.createDataFrame(people, "c_custkey long, c_nationkey int, c_acctbal double").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame(firms, "s_suppkey long, s_nationkey int, s_acctbal double").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    same_text(spark, tmp_path, name, ["customer", "supplier"])
    shares = [n for _, n in QUERIES[name](spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()]
    assert max(shares) < sum(shares) / 3


@pytest.mark.parametrize("keys", [[0, -5, 3, 3, None, None, 10**15, 7, 8, 9, 11, 12, 2], [4], [None], []])
def test_tree_over_sparse_and_odd_keys(spark, tmp_path, keys):
    rows = [(k, None if i == 3 else i / 4) for i, k in enumerate(keys)]
    spark.createDataFrame(rows, "o_orderkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    same_text(spark, tmp_path, "tree_lookup", ["orders"])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


def test_plans_push_filters_and_prune_columns(spark):
    from ferrule.sources.sinks import plan_of

    plan = plan_of(QUERIES["scan_filter_project"](spark, SF))
    assert "PushedFilters: [IsNotNull" in plan and "l_shipdate" not in plan.split("ReadSchema")[1].split("\n")[0]
