from __future__ import annotations

import datetime as dt
import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from slotwise.sources import model, store
from slotwise.sources.samples import open_samples
from tests.conftest import rows

SAMPLE = "/root/testdata/sf0.001"


def plan(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("table", sorted(model.COLUMNS))
def test_every_table_has_a_schema(table):
    names = [f.name for f in store.schema(table).fields]
    assert len(names) == len(set(names)) and (names[0] == "id" or table == "point_balances")


def test_round_trip_and_pruning(spark, tmp_path):
    source = open_samples(spark, SAMPLE)["reservations"]
    store.save(source, str(tmp_path), "reservations")
    back = store.load(spark, str(tmp_path), "reservations")
    assert back.schema["total_amount"].dataType.simpleString() == "bigint"
    assert back.count() == source.count()
    july = back.filter((back.stored_month == dt.date(2001, 7, 1)) & (back.reservation_date == dt.date(2001, 7, 15)))
    text = plan(july.select("id"))
    assert "PartitionFilters: [isnotnull(stored_month" in text
    assert "EqualTo(reservation_date,2001-07-15)" in text
    assert "ReadSchema: struct<id:string,reservation_date:date>" in text
    assert july.count() == source.filter("reservation_date = DATE '2001-07-15'").count()


def test_operators_run_on_a_store(spark, tmp_path):
    """What was computed from the sample comes out of stored tables too (keys are text there)."""
    from slotwise.operators import settlement

    t = open_samples(spark, SAMPLE)
    for name in ("reservations", "shops", "shop_settlement_configs", "system_settings"):
        store.save(t[name], str(tmp_path), name)
    kept = store.open_store(spark, str(tmp_path))
    june = (dt.date(2001, 6, 1), dt.date(2001, 6, 30))
    want = settlement.shop_settlement(t, *june).selectExpr("CAST(shop_id AS STRING) s", "commission_amount")
    got = settlement.shop_settlement(kept, *june).select("shop_id", "commission_amount")
    assert rows(got) == rows(want) and rows(got)


def test_log_is_only_added_to(spark, tmp_path):
    line = spark.createDataFrame([("1", "s", "approved", dt.datetime(2001, 7, 1))], "id STRING, settlement_id STRING, action STRING, created_at TIMESTAMP_NTZ")
    store.append_log(line, str(tmp_path), "settlement_logs", 0)
    store.append_log(line.selectExpr("'2' AS id", "settlement_id", "action", "created_at"), str(tmp_path), "settlement_logs", 1)
    assert store.load(spark, str(tmp_path), "settlement_logs").count() == 2


def test_a_repeated_batch_adds_nothing(spark, tmp_path):
    kind = "id STRING, settlement_id STRING, action STRING, created_at TIMESTAMP_NTZ"
    line = lambda i, month: (i, "s", "approved", dt.datetime(2001, month, 1))
    first = spark.createDataFrame([line("old", 6)], kind)
    store.save(first, str(tmp_path), "settlement_logs")
    batch = spark.createDataFrame([line("a", 6), line("b", 7), line("c", 7)], kind)
    store.append_log(batch.filter("id = 'b'"), str(tmp_path), "settlement_logs", 0)  # cut off half way
    for _ in range(3):
        store.append_log(batch, str(tmp_path), "settlement_logs", 0)
    store.append_log(spark.createDataFrame([line("d", 7)], kind), str(tmp_path), "settlement_logs", 1)
    kept = store.load(spark, str(tmp_path), "settlement_logs")
    assert rows(kept.select("id", "stored_batch")) == [("a", 0), ("b", 0), ("c", 0), ("d", 1), ("old", -1)]
    assert "PartitionFilters: [isnotnull(stored_month" in plan(kept.filter("stored_month = DATE '2001-07-01'").select("id"))
    with pytest.raises(ValueError, match="no log"):
        store.append_log(batch, str(tmp_path), "users", 0)


def test_filters_and_columns_reach_the_scan(spark):
    t = open_samples(spark, SAMPLE)
    text = plan(t["promotion_usages"].select("promotion_id"))
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_linenumber:int>" in text
    assert "Not(EqualTo(l_linenumber,5))" in text


def test_completion_period_reaches_the_scan(spark, tmp_path):
    from slotwise.functions.clock import in_days

    store.save(open_samples(spark, SAMPLE)["reservations"], str(tmp_path), "reservations")
    df = store.load(spark, str(tmp_path), "reservations")
    text = plan(df.filter(in_days(df.completed_at, dt.date(2001, 6, 1), dt.date(2001, 6, 30), "Asia/Seoul")).select("id"))
    assert "GreaterThanOrEqual(completed_at," in text and "LessThan(completed_at," in text


def test_operators_read_the_declared_layout(spark, tmp_path):
    """What reads columns or tables that only the sample had, or takes keys for numbers, gives the same on stored tables."""
    from slotwise.operators import discovery, outreach, visibility

    now = dt.datetime(2001, 7, 15, 12)
    t = open_samples(spark, SAMPLE)
    for name in ("users", "shops", "shop_services", "reservations", "reviews", "promotions", "promotion_usages", "reservation_services"):
        store.save(t[name], str(tmp_path), name)
    kept = store.open_store(spark, str(tmp_path))
    claims = t["promotion_claims"].withColumns({c: F.col(c).cast("string") for c in ("promotion_id", "user_id")})
    jobs = {
        # Ties go by key, which is a text there, so places are compared and not the keys in them.
        "exposure": lambda t: discovery.shop_exposure(t["shops"]).selectExpr("position", "shop_type", "CAST(partnership_started_at AS DATE)"),
        "categories": lambda t: discovery.shop_exposure_by_category(t["shops"]).selectExpr("category", "position", "shop_type"),
        "nearby": lambda t: discovery.nearby_shops(t["users"], t["shops"]).select("user_id", "shop_id"),
        "search": lambda t: discovery.shop_search(t, "ring", category="nail", price=(0, 10**9), min_rating=1.0).select("shop_id"),
        "cards": lambda t: discovery.shop_cards(t, 37.5665, 126.978).select("shop_id", "rating", "bookings", "lowest_price"),
        "rating": discovery.rating_summary,
        "popular": lambda t: discovery.popular_shops(t).select("id", "bookings"),
        "usage": outreach.promotion_usage,
        "claims": lambda t: outreach.promotion_eligibility(t, claims, now),
        "visible": visibility.visible_reservations,
    }
    for name, job in jobs.items():
        texts = [sorted(str([None if v is None else str(v) for v in r]) for r in job(tables).collect()) for tables in (t, kept)]
        assert texts[0] == texts[1] and texts[0], name


def test_bookings_are_visible_by_keys_of_any_kind(tables):
    from slotwise.operators import visibility

    t = tables(
        users=([("u-1", "user"), ("u-2", "shop_owner"), ("u-3", "admin")], "id STRING, user_role STRING"),
        shops=([("s-1", "u-2")], "id STRING, owner_id STRING"),
        reservations=([("r-uuid", "u-1", "s-1")], "id STRING, user_id STRING, shop_id STRING"),
    )
    assert rows(visibility.visible_reservations(t)) == [("u-1", "r-uuid", "row"), ("u-2", "r-uuid", "row"), ("u-3", None, "table")]
