"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from slotwise.plans import catalog  # noqa: F401
from slotwise.plans.registry import QUERIES
from slotwise.session import local_session

HEADLINE = [
    "shop_owner_dashboard", "settlement_batch", "monthly_revenue", "settlement_status", "points_history",
    "points_from_user_ledger", "user_point_summary", "award_service_points", "influencer_status", "referral_earnings",
    "nearby_shops", "shop_search", "shop_sorts", "popular_shops", "free_slots", "refund_decision",
    "shop_today_reservations", "reservation_quote", "visible_reservations", "promotion_eligibility",
    "event_funnel", "retention", "feature_usage", "enum_violations", "stream_event_counts",
]


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")))
    # Start the JVM's code paths once on a small query, so the first figure is not start-up.
    QUERIES["load_shops"].run(spark, directory).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name].run(spark, directory).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(directory.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
