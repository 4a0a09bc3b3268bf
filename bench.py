"""Bench: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and
print one JSON line with per-query wall seconds.

Each query is executed fully into Spark's ``noop`` sink, so all computed columns
count.  The tables that several queries share (interactions, catalog, id
dimensions, split, both trained stages) are timed on their own under ``setup_*``
before the queries that read them; ``value`` includes them.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tunefunnel.plans import registry  # noqa: E402
from tunefunnel.session import build_session, clean_scratch  # noqa: E402

# One query per operator family.
HEADLINE = [
    "eval_popularity",
    "holdout_split",
    "id_mapping",
    "catalog_left_join",
    "profile_playlist",
    "cross_features",
    "topn_dot_product",
    "metrics_by_playlist",
    "paired_ttest",
    "welch_ttest",
    "bootstrap_ci",
    "als_candidates",
    "foldin_candidates",
    "training_frame",
    "seed_side",
    "experiment_sizing",
]

# The ranker chain trains 100 trees, so it runs only where it is asked for.
MODEL = ["ranker_scores", "recommend_batch", "recommend_known", "eval_report", "ab_report", "stage1_leakage"]


def setup(spark, sf_dir: str) -> dict:
    """What several queries share, by the name it is timed under."""
    from tunefunnel.plans import cache as C
    return {
        "setup_interactions": lambda: C.interactions(spark, sf_dir),
        "setup_catalog": lambda: C.track_metadata(spark, sf_dir),
        "setup_id_maps": lambda: C.mapped(spark, sf_dir),
        "setup_split": lambda: registry.whole_split(spark, sf_dir),
        "setup_stage1": lambda: registry.trained_stage1(spark, sf_dir)[0].itemFactors,
    }


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES")
    names = names.split(",") if names else HEADLINE + MODEL * (os.environ.get("BENCH_MODELS") == "1")
    spark = build_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_PARTITIONS", "16")))
    times: dict[str, float] = {}
    rows: dict[str, int] = {}
    errors: dict[str, str] = {}
    runs = setup(spark, sf_dir) | {n: (lambda n=n: registry.QUERIES[n](spark, sf_dir)) for n in names}
    spark.range(1).write.format("noop").mode("overwrite").save()   # start the engine
    for name, run in runs.items():
        t0 = time.perf_counter()
        try:
            df = run()
            df.write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - t0, 3)
            rows[name] = df.count()
        except Exception as e:  # noqa: BLE001 - report and keep measuring the rest
            errors[name] = f"{type(e).__name__}: {str(e)[:200]}"
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "rows": rows,
        **({"errors": errors} if errors else {}),
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
    }))
    clean_scratch(spark)
    spark.stop()


if __name__ == "__main__":
    main()
