"""Finding shops: nearest, exposure order, search, sorts, price ranges, popularity, favourites."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.geo import KM_PER_DEGREE, column_cell, distance_km, row_cell
from .spread import dense_ranks

# Fixed value: shops per page.
PAGE_SIZE = 30

# Users are grouped by cells about 40 m high. Shops are found through nested cells, each level
# cutting a cell of the one before into eight by eight; those of the last are about 2 m high.
HOME_LEVEL = 20
STEP = 3
LEVELS = tuple(range(STEP, 25, STEP))


def nearby_shops(users: DataFrame, shops: DataFrame, k: int = PAGE_SIZE) -> DataFrame:
    """The ``k`` nearest active shops of each user, exact for any distribution of shops.

    No user meets all shops. Shops are counted in nested cells, and each cell that holds users walks
    down: a level's cells are taken nearest first until they hold ``k`` shops for certain, and only
    cells that may be as near are cut further. What is left at the last level is a few times ``k``,
    be the users far from all shops or next to a dense core. Of shops at the very same point only
    the first ``k`` can count. Ties go to the smaller key.
    """
    position = F.row_number().over(Window.partitionBy("latitude", "longitude").orderBy("id"))
    places = (
        shops.filter((F.col("shop_status") == "active") & F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
        .select("id", F.col("latitude").cast("double").alias("latitude"), F.col("longitude").cast("double").alias("longitude"))
        .withColumn("n", position).filter(F.col("n") <= k)
        .select(
            F.col("id").alias("shop_id"), F.col("latitude").alias("shop_lat"), F.col("longitude").alias("shop_lon"),
            row_cell(F.col("latitude"), LEVELS[-1]).alias("shop_row"), column_cell(F.col("longitude"), LEVELS[-1]).alias("shop_col"),
        )
    )
    people = users.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).select(
        F.col("id").alias("user_id"),
        F.col("latitude").cast("double").alias("latitude"), F.col("longitude").cast("double").alias("longitude"),
    ).withColumns({"row": row_cell(F.col("latitude"), HOME_LEVEL), "col": column_cell(F.col("longitude"), HOME_LEVEL)})
    home = people.select("row", "col").distinct()
    # Distances are sorted inside a user's row; sorted as rows, a task would hold all candidates of all its users.
    nearby = _candidates(home, places, k).groupBy("row", "col").agg(
        F.collect_list(F.struct("shop_id", "shop_lat", "shop_lon")).alias("shops")
    )
    distance = lambda s: F.round(distance_km(F.col("latitude"), F.col("longitude"), s["shop_lat"], s["shop_lon"]), 3)
    by_distance = F.array_sort(F.transform("shops", lambda s: F.struct(distance(s).alias("distance_km"), s["shop_id"].alias("shop_id"))))
    # The rows of an account are counted first, which also deals them out to tasks.
    counted = people.withColumn("rows", F.count(F.lit(1)).over(Window.partitionBy("user_id")))
    listed = counted.join(nearby, ["row", "col"]).select("user_id", "rows", F.posexplode(F.slice(by_distance, 1, k)).alias("place", "s"))
    ranked = listed.select("user_id", "rows", "s.shop_id", "s.distance_km", (F.col("place") + 1).alias("position"))
    # An account with several rows has one list for all of them.
    order = Window.partitionBy("user_id").orderBy("distance_km", "shop_id")
    several = ranked.filter("rows > 1").withColumn("position", F.row_number().over(order)).filter(F.col("position") <= k)
    return ranked.filter("rows = 1").unionByName(several).drop("rows")


def _candidates(home: DataFrame, places: DataFrame, k: int) -> DataFrame:
    """Shops that can be among the ``k`` nearest of somebody in a cell, for each ``home`` cell."""
    kept: DataFrame | None = None
    for level in LEVELS:
        shift = LEVELS[-1] - level
        counts = places.groupBy(
            F.shiftright("shop_row", shift).alias("r"), F.shiftright("shop_col", shift).alias("c")
        ).agg(F.count(F.lit(1)).alias("n"))
        if kept is None:
            # The first level has a fixed number of cells, the pole's own row included.
            cells = F.sequence(F.lit(0), F.lit((2 ** (level - 1) + 1) * 2**level - 1))
            around = home.withColumn("cell", F.explode(cells)).select(
                "row", "col", F.floor(F.col("cell") / 2**level).cast("int").alias("r"), (F.col("cell") % 2**level).cast("int").alias("c")
            ).join(counts, ["r", "c"])
        else:
            inside = counts.withColumns({"pr": F.shiftright("r", STEP), "pc": F.shiftright("c", STEP)})
            around = kept.join(inside, ["pr", "pc"])
        kept = _may_hold_nearest(around.select("row", "col", "r", "c", "n"), level, k)
        kept = kept.select("row", "col", F.col("r").alias("pr"), F.col("c").alias("pc"))
    return kept.join(places, (F.col("pr") == F.col("shop_row")) & (F.col("pc") == F.col("shop_col"))).select(
        "row", "col", "shop_id", "shop_lat", "shop_lon"
    )


def _may_hold_nearest(cells: DataFrame, level: int, k: int) -> DataFrame:
    """The cells around each home cell that may hold one of the ``k`` nearest shops of somebody in it.

    Two points of two cells are apart by the distance of the middles, give or take half a diagonal
    of each; a degree of longitude is never longer than one of latitude. Cells hold ``k`` shops for
    certain within the distance at which the counts of those that end before it reach ``k``.
    """
    edge, home_edge = 360.0 / (1 << level), 360.0 / (1 << HOME_LEVEL)
    middle = distance_km(
        (F.col("row") + 0.5) * home_edge - 90.0, (F.col("col") + 0.5) * home_edge - 180.0,
        (F.col("r") + 0.5) * edge - 90.0, (F.col("c") + 0.5) * edge - 180.0,
    )
    slack = (edge + home_edge) * math.sqrt(0.5) * KM_PER_DEGREE
    per_home = Window.partitionBy("row", "col")
    held = F.sum("n").over(per_home.orderBy("middle", "r", "c").rowsBetween(Window.unboundedPreceding, 0))
    return (
        cells.withColumn("middle", middle).withColumn("held", held)
        .withColumn("certain", F.min(F.when(F.col("held") >= k, F.col("middle"))).over(per_home))
        # Distances are rounded to a metre before they are compared.
        .filter(F.col("certain").isNull() | (F.col("middle") <= F.col("certain") + 2 * slack + 0.002))
    )


def _exposure_order() -> list[Column]:
    return [
        F.when(F.col("shop_type") == "partnered", 0).otherwise(1),
        F.desc_nulls_last("partnership_started_at"),
        F.col("id"),
    ]


def shop_exposure(shops: DataFrame, page: int = 0) -> DataFrame:
    """One page of the default order: partners first, latest partnership first."""
    top = (
        shops.filter(F.col("shop_status") == "active")
        .orderBy(*_exposure_order()).offset(page * PAGE_SIZE).limit(PAGE_SIZE)
    )
    # At most one page of rows is left here.
    place = F.row_number().over(Window.partitionBy(F.lit(page)).orderBy(*_exposure_order()))
    return top.select(
        "id", "name", "shop_type", "partnership_started_at", (place + page * PAGE_SIZE).alias("position")
    )


def category_membership(shops: DataFrame) -> DataFrame:
    """Every category a shop offers, main or further, once."""
    offered = F.concat(F.array("main_category"), F.coalesce("sub_categories", F.array().cast("array<string>")))
    return shops.select(
        F.col("id").alias("shop_id"), F.explode(F.array_distinct(offered)).alias("category")
    )


def shop_exposure_by_category(shops: DataFrame) -> DataFrame:
    """First page of the default order in each category."""
    active = shops.filter(F.col("shop_status") == "active")
    listed = category_membership(active).withColumnRenamed("shop_id", "id").join(
        active.select("id", "shop_type", "partnership_started_at"), "id"
    )
    place = F.row_number().over(Window.partitionBy("category").orderBy(*_exposure_order()))
    return listed.withColumn("position", place).filter(F.col("position") <= PAGE_SIZE)


def shop_price_range(services: DataFrame) -> DataFrame:
    return services.groupBy("shop_id", "category").agg(
        F.min("price_min").alias("price_low"), F.max("price_max").alias("price_high"),
        F.count(F.lit(1)).alias("service_count"),
    )


def shop_search(
    tables, text: str, category: str | None = None, price: tuple[int, int] | None = None,
    min_rating: float | None = None,
) -> DataFrame:
    """Active shops whose name, or one of whose services, contains ``text``, with filters."""
    needle = text.lower()
    services = tables["shop_services"]
    if category:
        services = services.filter(F.col("category") == category)
    if price:
        services = services.filter((F.col("price_min") <= price[1]) & (F.col("price_max") >= price[0]))
    offer = services.groupBy("shop_id").agg(
        F.count_if(F.lower("name").contains(needle)).alias("matching_services")
    )
    found = (
        tables["shops"].filter(F.col("shop_status") == "active")
        .select(F.col("id").alias("shop_id"), "name", "shop_type")
        .join(offer, "shop_id", "inner" if category or price else "left")
        .na.fill(0, ["matching_services"])
        .filter(F.lower("name").contains(needle) | (F.col("matching_services") > 0))
    )
    if min_rating is None:
        return found
    rated = rating_summary(tables).filter(F.col("rating") >= min_rating).select("shop_id", "rating")
    return found.join(rated, "shop_id")


def rating_summary(tables) -> DataFrame:
    """Average and number of ratings per shop; verified ones belong to a completed booking."""
    done = tables["reservations"].filter(F.col("status") == "completed").select(
        F.col("id").alias("reservation_id"), F.lit(1).alias("visited")
    )
    sums = (
        tables["reviews"].select("reservation_id", "shop_id", "rating")
        .join(done, "reservation_id", "left")
        .groupBy("shop_id")
        .agg(
            F.sum("rating").alias("total"), F.count(F.lit(1)).alias("reviews"),
            F.count("visited").alias("verified_reviews"),
        )
    )
    return sums.select(
        "shop_id", F.round(F.col("total") / F.col("reviews"), 4).alias("rating"), "reviews", "verified_reviews"
    )


def shop_cards(tables, latitude: float, longitude: float) -> DataFrame:
    """Active shops with everything they can be sorted by."""
    prices = tables["shop_services"].groupBy("shop_id").agg(F.min("price_min").alias("lowest_price"))
    booked = tables["reservations"].groupBy("shop_id").agg(F.count(F.lit(1)).alias("bookings"))
    ratings = rating_summary(tables).select("shop_id", "rating")
    here = (F.lit(latitude), F.lit(longitude))
    return (
        tables["shops"].filter(F.col("shop_status") == "active")
        .select(
            F.col("id").alias("shop_id"), "created_at",
            F.round(distance_km(*here, F.col("latitude"), F.col("longitude")), 3).alias("distance_km"),
        )
        .join(prices, "shop_id", "left").join(booked, "shop_id", "left").join(ratings, "shop_id", "left")
        .na.fill(0, ["bookings"])
    )


# Sort mode -> number to sort by, smallest first; cards without one come last.
SORTS = {
    "distance": lambda: F.col("distance_km"),
    "rating": lambda: -F.col("rating"),
    "price_low": lambda: F.col("lowest_price").cast("double"),
    "price_high": lambda: -F.col("lowest_price").cast("double"),
    "newest": lambda: -F.unix_micros(F.col("created_at").cast("timestamp")).cast("double"),
    "popularity": lambda: -F.col("bookings").cast("double"),
}


def shop_sorts(cards: DataFrame, modes: tuple[str, ...] = tuple(SORTS), page: int = 0) -> DataFrame:
    """One page of shop cards in the order of each mode; the cards are made once for all.

    Each task keeps only the first rows of a mode before they are exchanged.
    """
    keys = F.array(*[F.struct(F.lit(m).alias("mode"), SORTS[m]().cast("double").alias("by")) for m in modes])
    place = F.row_number().over(Window.partitionBy("mode").orderBy(F.asc_nulls_last("by"), "shop_id"))
    last = (page + 1) * PAGE_SIZE
    ranked = cards.withColumn("key", F.explode(keys)).select("key.mode", "key.by", *cards.columns).withColumn("position", place)
    return ranked.filter(F.col("position") <= last).filter(F.col("position") > last - PAGE_SIZE).select("mode", "position", *cards.columns)


def popular_shops(tables) -> DataFrame:
    """Shops ranked by bookings within their main category."""
    booked = tables["reservations"].groupBy(F.col("shop_id").alias("id")).agg(F.count(F.lit(1)).alias("bookings"))
    counted = (
        tables["shops"].filter(F.col("shop_status") == "active").select("id", "name", "main_category")
        .join(booked, "id", "left").na.fill(0, ["bookings"])
    )
    return dense_ranks(counted, "main_category", "bookings", "popularity_rank")


def favorite_shops(tables) -> DataFrame:
    """Active favourites of each user, once each, with the day they were first marked."""
    once = tables["user_favorites"].groupBy("user_id", "shop_id").agg(F.min("created_at").alias("favorited_at"))
    active = tables["shops"].filter(F.col("shop_status") == "active").select(
        F.col("id").alias("shop_id"), "name", "shop_type"
    )
    return once.join(active, "shop_id")


def feed_search(posts: DataFrame, keyword: str, region: str | None = None) -> DataFrame:
    """Visible posts that contain ``keyword`` anywhere in their text."""
    found = posts.filter((F.col("status") == "active") & F.lower("content").contains(keyword.lower()))
    return found if region is None else found.filter(F.col("region") == region)
