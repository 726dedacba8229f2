"""Seconds of the headline queries, as one line of JSON: BENCH_SF_DIR, BENCH_CPUS and BENCH_QUERIES choose what runs."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from glyphmill.registry import QUERIES

HEADLINE = (
    "char_convert", "phrase_convert", "phrase_convert_arrow", "replacement_counts", "top_replacements", "phrase_counts",
    "restyled", "unit_split", "forward_match", "mixed_script", "script_votes", "page_previews", "span_merge", "job_decisions",
    "modes_forward", "markup_convert", "word_counts", "locale_convert", "epub_round_trip",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.local.dir", tempfile.mkdtemp(prefix="spark-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    took = {}
    for name in names:
        began = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    chars = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("sum(n_chars)").first()[0]
    rates = {n: round(chars / took[n]) for n in ("char_convert", "phrase_convert", "phrase_convert_arrow") if n in took}
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "chars_per_sec": rates, "sf": sf_dir.rpartition("sf")[2], "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
