from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import Window, functions as F

from slotwise.operators import discovery
from tests.conftest import rows


def km(lat1, lon1, lat2, lon2):
    a, b = math.radians(lat1), math.radians(lat2)
    h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return round(2 * 6371.0 * math.asin(math.sqrt(min(1.0, h))), 3)


def world(rng, n):
    return [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(n)]


def town(rng, n):
    return [(37.5 + rng.gauss(0, 0.02), 127.0 + rng.gauss(0, 0.02)) for _ in range(n)]


def crowd(rng, n):
    """A third at one very point, the rest spread over two towns."""
    return [(37.5, 127.0) if i % 3 == 0 else (37.5 + rng.gauss(0, 0.01) + 5 * (i % 2), 127.0 + rng.gauss(0, 0.01)) for i in range(n)]


def edges(rng, n):
    """Both sides of the date line and close to the poles."""
    return [
        (rng.choice([89.9, -89.95, 0.01, rng.uniform(-2, 2)]) , rng.choice([179.99, -179.99, rng.uniform(-180, 180)]))
        for _ in range(n)
    ]


@pytest.mark.parametrize("place", [world, town, crowd, edges])
@pytest.mark.parametrize("shops,k", [(300, 7), (5, 7)])
def test_nearest_equals_brute_force(spark, place, shops, k):
    rng = random.Random(3)
    spots, homes = place(rng, shops), place(rng, 60)
    shop_df = spark.createDataFrame(
        [(i, "active" if i % 9 else "suspended", *p) for i, p in enumerate(spots)],
        "id LONG, shop_status STRING, latitude DOUBLE, longitude DOUBLE",
    )
    user_df = spark.createDataFrame([(i, *p) for i, p in enumerate(homes)], "id LONG, latitude DOUBLE, longitude DOUBLE")
    got = {}
    for r in discovery.nearby_shops(user_df, shop_df, k).collect():
        got.setdefault(r.user_id, []).append((r.position, r.distance_km, r.shop_id))
    for user, home in enumerate(homes):
        best = sorted((km(*home, *p), i) for i, p in enumerate(spots) if i % 9)[:k]
        want = [(n, d, i) for n, (d, i) in enumerate(best, 1)]
        assert [(n, s) for n, _d, s in sorted(got[user])] == [(n, s) for n, _d, s in want], (place.__name__, user)


def test_exposure_puts_latest_partners_first(spark):
    import datetime as dt

    shops = spark.createDataFrame(
        [(1, "a", "non_partnered", "active", None), (2, "b", "partnered", "active", dt.date(2000, 1, 1)),
         (3, "c", "partnered", "active", dt.date(2001, 1, 1)), (4, "d", "partnered", "active", None),
         (5, "e", "partnered", "suspended", dt.date(2002, 1, 1))],
        "id LONG, name STRING, shop_type STRING, shop_status STRING, partnership_started_at DATE",
    )
    assert [r.id for r in discovery.shop_exposure(shops).orderBy("position").collect()] == [3, 2, 4, 1]
    assert discovery.shop_exposure(shops, page=1).count() == 0


def test_dense_ranks_share_places(spark):
    from slotwise.operators.spread import dense_ranks

    df = spark.createDataFrame([(i, "nail", n) for i, n in enumerate([5, 5, 3, 1, 1, 0])], "id LONG, g STRING, n LONG")
    assert sorted((r.id, r.place) for r in dense_ranks(df, "g", "n", "place").collect()) == [
        (0, 1), (1, 1), (2, 2), (3, 3), (4, 3), (5, 4)
    ]


def test_candidates_stay_few_for_far_users_and_beside_a_dense_core(spark):
    k = 10
    # 10,000 shops around one place, and users in it, some kilometres off, in a suburb of few shops, and across the globe.
    core = spark.range(10_000).selectExpr(
        "id", "'active' AS shop_status", "37.5 + (id % 100) * 0.0005 AS latitude", "127.0 + (id div 100) * 0.0005 AS longitude"
    )
    suburb = spark.range(10_000, 10_007).selectExpr("id", "'active' AS shop_status", "37.62 + id % 7 * 0.001 AS latitude", "127.02 AS longitude")
    users = spark.createDataFrame(
        [(1, 40.71, -74.0), (2, 37.52, 127.02), (3, 37.62, 127.02), (4, 37.45, 126.9), (5, -33.0, 180.0), (6, 90.0, 0.0)],
        "id LONG, latitude DOUBLE, longitude DOUBLE",
    )
    shops = core.unionByName(suburb)
    places = shops.selectExpr("id AS shop_id", "latitude AS shop_lat", "longitude AS shop_lon").withColumns({
        "shop_row": discovery.row_cell(F.col("shop_lat"), discovery.LEVELS[-1]), "shop_col": discovery.column_cell(F.col("shop_lon"), discovery.LEVELS[-1]),
    })
    home = users.select(
        discovery.row_cell(F.col("latitude"), discovery.HOME_LEVEL).alias("row"), discovery.column_cell(F.col("longitude"), discovery.HOME_LEVEL).alias("col")
    ).distinct()
    most = discovery._candidates(home, places, k).groupBy("row", "col").count().agg(F.max("count")).first()[0]
    assert k <= most <= 30 * k
    got = rows(discovery.nearby_shops(users, shops, k).select("user_id", "position", "shop_id"))
    near = users.crossJoin(shops.withColumnsRenamed({"id": "shop_id", "latitude": "a", "longitude": "b"})).select(
        F.col("id").alias("user_id"), "shop_id",
        F.round(discovery.distance_km(F.col("latitude"), F.col("longitude"), F.col("a"), F.col("b")), 3).alias("d"),
    )
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("d", "shop_id"))
    assert got == rows(near.withColumn("position", place).filter(f"position <= {k}").select("user_id", "position", "shop_id"))
