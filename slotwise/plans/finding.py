"""Discovery queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import discovery
from .registry import query

ACTIVE = "(SELECT * FROM shops WHERE shop_status='active')"


def _km(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return (
        f"ROUND(2*6371.0*ASIN(SQRT(LEAST(1.0,POW(SIN(RADIANS({lat2}-{lat1})/2),2)"
        f"+COS(RADIANS({lat1}))*COS(RADIANS({lat2}))*POW(SIN(RADIANS({lon2}-{lon1})/2),2)))),3)"
    )


@query("nearby_shops", f"""
SELECT user_id, shop_id, distance_km, position FROM (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY distance_km, shop_id) AS INT) AS position
  FROM (SELECT u.id AS user_id, s.id AS shop_id, {_km('u.latitude', 'u.longitude', 's.latitude', 's.longitude')} AS distance_km
    FROM users u CROSS JOIN {ACTIVE} s) d) r WHERE position<=30""")
def _(t):
    return discovery.nearby_shops(t["users"], t["shops"])


EXPOSURE = "CASE WHEN shop_type='partnered' THEN 0 ELSE 1 END, partnership_started_at DESC NULLS LAST, id"


@query("shop_exposure", f"""
SELECT id, name, shop_type, partnership_started_at, position FROM (SELECT *, CAST(ROW_NUMBER() OVER (ORDER BY {EXPOSURE}) AS INT) AS position FROM {ACTIVE} s) x
WHERE position BETWEEN 1 AND 30""")
def _(t):
    return discovery.shop_exposure(t["shops"])


MEMBERS = """SELECT DISTINCT id AS shop_id, UNNEST(list_concat([main_category],COALESCE(sub_categories,CAST([] AS VARCHAR[])))) AS category FROM shops"""


@query("category_membership", MEMBERS)
def _(t):
    return discovery.category_membership(t["shops"])


@query("shop_exposure_by_category", f"""
WITH m AS ({MEMBERS}) SELECT id, category, shop_type, partnership_started_at, position FROM (
  SELECT s.id, m.category, s.shop_type, s.partnership_started_at, CAST(ROW_NUMBER() OVER (PARTITION BY m.category ORDER BY {EXPOSURE}) AS INT) AS position
  FROM m JOIN {ACTIVE} s ON s.id=m.shop_id) x WHERE position<=30""")
def _(t):
    return discovery.shop_exposure_by_category(t["shops"])


@query("shop_price_range", """
SELECT shop_id, category, MIN(price_min) AS price_low, MAX(price_max) AS price_high, COUNT(*) AS service_count FROM shop_services GROUP BY shop_id, category""")
def _(t):
    return discovery.shop_price_range(t["shop_services"])


@query("shop_search", f"""
SELECT s.id AS shop_id, s.name, s.shop_type, COALESCE(m.n,0) AS matching_services FROM {ACTIVE} s
LEFT JOIN (SELECT shop_id, COUNT(*) AS n FROM shop_services WHERE LOWER(name) LIKE '%ring%' GROUP BY shop_id) m ON m.shop_id=s.id
WHERE LOWER(s.name) LIKE '%ring%' OR m.n>0""")
def _(t):
    return discovery.shop_search(t, "Ring")


RATINGS = """
  SELECT v.shop_id, ROUND(CAST(SUM(v.rating) AS DOUBLE)/COUNT(*),4) AS rating, COUNT(*) AS reviews, COUNT(r.id) AS verified_reviews
  FROM reviews v LEFT JOIN reservations r ON r.id=v.reservation_id AND r.status='completed' GROUP BY v.shop_id"""


@query("shop_search_filtered", f"""
WITH rated AS ({RATINGS})
SELECT s.id AS shop_id, s.name, s.shop_type, m.n AS matching_services, q.rating FROM {ACTIVE} s
JOIN (SELECT shop_id, COUNT(CASE WHEN LOWER(name) LIKE '%ring%' THEN 1 END) AS n FROM shop_services
  WHERE category='nail' AND price_min<=60000 AND price_max>=50000 GROUP BY shop_id) m ON m.shop_id=s.id
JOIN rated q ON q.shop_id=s.id AND q.rating>=2.95 WHERE LOWER(s.name) LIKE '%ring%' OR m.n>0""")
def _(t):
    return discovery.shop_search(t, "ring", category="nail", price=(50000, 60000), min_rating=2.95)


@query("rating_summary", RATINGS)
def _(t):
    return discovery.rating_summary(t)


CARDS = f"""
  SELECT s.id AS shop_id, s.created_at, {_km('37.5665', '126.978', 's.latitude', 's.longitude')} AS distance_km, p.low AS lowest_price,
    COALESCE(b.n,0) AS bookings, q.rating FROM {ACTIVE} s LEFT JOIN (SELECT shop_id, MIN(price_min) AS low FROM shop_services GROUP BY shop_id) p ON p.shop_id=s.id
  LEFT JOIN (SELECT shop_id, COUNT(*) AS n FROM reservations GROUP BY shop_id) b ON b.shop_id=s.id LEFT JOIN rated q ON q.shop_id=s.id"""
ORDERS = {
    "distance": "distance_km NULLS LAST", "rating": "rating DESC NULLS LAST", "price_low": "lowest_price NULLS LAST",
    "price_high": "lowest_price DESC NULLS LAST", "newest": "created_at DESC", "popularity": "bookings DESC",
}


@query("shop_sorts", f"WITH rated AS ({RATINGS}), cards AS ({CARDS})\n" + "\nUNION ALL ".join(
    f"SELECT '{mode}' AS mode, position, shop_id, created_at, distance_km, lowest_price, bookings, rating FROM "
    f"(SELECT *, CAST(ROW_NUMBER() OVER (ORDER BY {order}, shop_id) AS INT) AS position FROM cards) x WHERE position<=30"
    for mode, order in ORDERS.items()
))
def _(t):
    return discovery.shop_sorts(discovery.shop_cards(t, 37.5665, 126.978))


@query("popular_shops", f"""
SELECT s.id, s.name, s.main_category, COALESCE(b.n,0) AS bookings,
  CAST(DENSE_RANK() OVER (PARTITION BY s.main_category ORDER BY COALESCE(b.n,0) DESC) AS INT) AS popularity_rank
FROM {ACTIVE} s LEFT JOIN (SELECT shop_id, COUNT(*) AS n FROM reservations GROUP BY shop_id) b ON b.shop_id=s.id""")
def _(t):
    return discovery.popular_shops(t)


@query("favorite_shops", f"""
SELECT f.user_id, f.shop_id, MIN(f.created_at) AS favorited_at, s.name, s.shop_type FROM user_favorites f JOIN {ACTIVE} s ON s.id=f.shop_id
GROUP BY f.user_id, f.shop_id, s.name, s.shop_type""")
def _(t):
    return discovery.favorite_shops(t)


@query("feed_search", """
SELECT id, region, language, created_at FROM posts WHERE status='active' AND CONTAINS(LOWER(content),'the')""")
def _(t):
    return discovery.feed_search(t["posts"], "The").select("id", "region", "language", "created_at")
