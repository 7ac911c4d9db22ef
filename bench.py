"""Times the headline queries once each on ``$BENCH_SF_DIR`` and prints one JSON line.

``stage_listings`` is the one-time write of the derived listing table that all
listing queries scan.  ``BENCH_QUERIES`` (comma separated, or ``all``) selects
other queries.
"""
import json
import os
import time

from lotwise.plans import base
from lotwise.plans.catalog import QUERIES
from lotwise.session import build_session

HEADLINE = ["top_deals", "comps_year_window", "score_monitor", "comps_strict", "price_estimate", "comps_enhanced", "comps_abs_band",
            "market_position", "score_market", "score_enhanced", "score_simple", "risk_keywords", "red_flags", "fuzzy_jaccard_join",
            "normalize_listings", "seller_price_dups", "dedupe_cascade", "embedding_cosine", "alert_parse", "alert_match", "alert_eligibility",
            "upsert_listings", "listing_detail", "listing_detail_2", "source_dispatch", "price_drops", "price_outliers", "funnel",
            "watch_targets", "stream_tumbling"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if wanted == "all" else wanted.split(",") if wanted else HEADLINE
    spark = build_session("bench", cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    start = time.time()
    listings = base.listings(spark, sf_dir).count()
    times["stage_listings"] = round(time.time() - start, 3)
    for name in names:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    scored = times.get("score_market")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "listings": listings,
                      "listings_scored_per_second": round(listings / scored, 1) if scored else None}))
    spark.stop()


if __name__ == "__main__":
    main()
