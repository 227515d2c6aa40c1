"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

HEADLINE = ["eg01_rapid_closure", "entity_scores", "eg02_value", "eg08_value", "ns02_absent_categories", "normalised_cases", "first_wins_dedup", "redacted_notes", "pseudonyms", "note_signatures", "targeted_sample", "entity_trend", "presence_snapshot", "policy_diff", "note_similarity"]


def main() -> None:
    from pyspark.sql import SparkSession

    from vigil.plans import catalogue

    cpus, sf_dir = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    catalogue.QUERIES[HEADLINE[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts the JVM's code
    took = {}
    for name in HEADLINE:
        began = time.time()
        catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total of headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
