"""Steps that must not be repeated, gathered or held whole as tables grow."""

from __future__ import annotations

import datetime as dt
from pathlib import Path

import pytest
from pyspark import SparkContext
from pyspark.sql import functions as F

from slotwise.operators import discovery, points, referrals
from slotwise.operators.durable import written_once
from slotwise.plans import catalog  # noqa: F401  (registers the queries)
from slotwise.plans.registry import QUERIES
from slotwise.sources.store import Tables
from slotwise.streaming import streams

from .conftest import rows


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def star(spark, folder):
    """A tiny sample: two bookings, one of an account that asked to go."""
    day = dt.datetime(2001, 3, 1)
    frames = {
        "customer": ([(i, f"c{i}", 100.0, "BUILDING") for i in (1, 18)], "c_custkey long, c_name string, c_acctbal double, c_mktsegment string"),
        "supplier": ([(1, "s", 1)], "s_suppkey long, s_name string, s_nationkey long"),
        "part": ([(1, "p", "PROMO", 3, 900.0)], "p_partkey long, p_name string, p_type string, p_size int, p_retailprice double"),
        "orders": ([(1, 1, "F", day), (2, 18, "F", day)], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp_ntz"),
        "lineitem": (
            [(o, 1, 1, 1, 2.0, 1000.0, "A", day) for o in (1, 2)],
            "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_shipdate timestamp_ntz",
        ),
        "events": ([(1, 1, "click", day, 1.0, "{}")], "event_id long, user_id long, event_type string, ts timestamp_ntz, value double, props string"),
        "labels": ([(1, 0, 1)], "doc_id long, toxic int, quality int"),
        "documents": ([(1, "t", "en", "s")], "doc_id long, text string, lang string, source string"),
        "conversations": ([(1, 0, "user", "t")], "conv_id long, turn int, role string, text string"),
    }
    for name, (data, schema) in frames.items():
        spark.createDataFrame(data, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", [
    "key_violations_other", "erase_users_counts", "erase_users_ledger", "erase_users_payments", "visible_owner2", "visible_reservations",
])
def test_bookings_are_made_once(spark, tmp_path, name):
    df = QUERIES[name].run(spark, star(spark, tmp_path))
    assert "Aggregate [l_orderkey" not in plan(df)
    assert df.count() > 0


def test_written_tables_feed_the_ones_made_of_them(spark):
    t = Tables({"a": lambda _t: spark.range(3), "b": lambda t: t["a"].select((F.col("id") + 1).alias("n"))})
    once = written_once(t, "a")
    assert rows(once["b"]) == [(1,), (2,), (3,)]
    assert "Range" in plan(t["b"]) and "Range" not in plan(once["b"])


def test_requests_are_read_once(spark, monkeypatch):
    asked = spark.range(4).select(
        F.col("id").alias("request_id"), F.when(F.col("id") < 3, F.col("id") % 2).alias("user_id"), F.lit(dt.datetime(2001, 1, 1)).alias("requested_at"),
        F.lit(5).cast("long").alias("amount"),
    )
    seen, write = [], points.cut_lineage
    monkeypatch.setattr(points, "cut_lineage", lambda df: seen.append(plan(df)) or write(df))
    got = points.point_redemption(asked, spark.createDataFrame([(0, 7)], "user_id long, available_points long"))
    # Nobody's request is none; of user 0 the first one fits, user 1 has nothing.
    assert rows(got) == [(0, 0, 5, True), (1, 1, 5, False), (2, 0, 5, False)]
    assert seen[0].count("Range (0, 4") == 1


def test_codes_are_turned_back_once(spark, monkeypatch):
    users = spark.range(6).select("id", F.when(F.col("id") > 2, F.lpad(F.col("id").cast("string"), 8, "A")).alias("referral_code"))
    seen, total = [], referrals.running_totals
    monkeypatch.setattr(referrals, "running_totals", lambda df, *a, **k: seen.append(plan(df)) or total(df, *a, **k))
    assert len({r.code for r in referrals.referral_codes(users).collect()}) == 3
    assert all("Range (" not in p for p in seen)


def test_nearest_shops_are_sorted_inside_a_user(spark):
    shops = spark.range(50).select("id", F.lit("active").alias("shop_status"), (37.5 + F.col("id") * 0.001).alias("latitude"), F.lit(127.0).alias("longitude"))
    users = spark.createDataFrame([(1, 37.5, 127.0), (2, 37.5, 127.0), (2, 37.5, 127.0)], "id long, latitude double, longitude double")
    got = discovery.nearby_shops(users, shops, k=4)
    found = {u: [(r.position, r.shop_id) for r in sorted(got.collect(), key=lambda r: r.position) if r.user_id == u] for u in (1, 2)}
    assert found == {1: [(1, 0), (2, 1), (3, 2), (4, 3)], 2: [(1, 0), (2, 0), (3, 1), (4, 1)]}
    assert "rows#" in plan(got) and "array_sort" in plan(got)


def test_state_of_streams_lies_on_disk(spark, tmp_path):
    folder, schema = f"{tmp_path}/in", "id string, user_id long, amount long, status string, available_from timestamp_ntz, expires_at timestamp_ntz, created_at timestamp_ntz"
    ledger = spark.createDataFrame([("a", 1, 5, "available", None, None, dt.datetime(2001, 1, 1))] * 2, schema)
    ledger.write.parquet(folder)
    before = {key: spark.conf.get(key, None) for key in streams.STATE}
    stream = streams.arriving(spark, folder, ledger.schema, "created_at")
    streams.point_balance_deltas(stream, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert rows(streams.point_balances_at(spark, f"{tmp_path}/out", dt.datetime(2001, 7, 1))) == [(1, 5, 5)]
    assert "RocksDBStateStoreProvider" in Path(f"{tmp_path}/state/offsets/0").read_text()
    assert {key: spark.conf.get(key, None) for key in streams.STATE} == before


def test_small_tables_are_audited_like_large_ones(spark, monkeypatch):
    import numpy as np

    from slotwise.llm import nn_descent

    asked, share = [], SparkContext.broadcast

    def spy(self, value):
        if isinstance(value, dict):
            asked.append(sum(len(nodes) for nodes, *_ in value.values()))
        return share(self, value)

    monkeypatch.setattr(SparkContext, "broadcast", spy)
    vectors = np.random.default_rng(5).normal(size=(300, 8)).tolist()
    df = spark.createDataFrame([(i, v, "x") for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, label string")
    nn_descent.near_links(df)
    assert asked and max(asked) < 300 / nn_descent.AUDIT * 4
