"""Headline timings on local cores; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

# Reports over published facts, catalogue, log, conversation and text jobs.
HEADLINE = [
    "a23_v_model", "a27_j03_daily", "a31_project_month", "a34_j02_models", "a50_core_counts", "a57_overlap_selected",
    "a63_k03_cube_sessions", "w03_engaged_seconds", "w02_heads", "w17_short_keys", "w18_supersedes", "w07_event_actions",
    "j09_unrecoverable", "j12_verify_store", "j21_resolve_projects", "j28_f39_folder_report", "w13_phases",
    "a90_phase_statistics", "f35_redact_text", "f36_secret_findings", "j01_longest_prefix", "t02_stream_actions",
]


def timed(run) -> float:
    began = time.perf_counter()
    run()
    return round(time.perf_counter() - began, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("threadline-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        # Small staged files would otherwise be packed into half as many tasks as there are cores.
        .config("spark.sql.files.openCostInBytes", "524288")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        # One machine, so any folder is shared.
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from threadline.plans import registry
    from threadline.plans.stats_queries import _files, earlier_facts, facts_for, grown_facts
    from threadline.plans.talk_queries import talk_for

    queries = registry.queries()
    sink = lambda df: df.write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    # Timings are of a warm JVM: the same jobs run once on the smallest tables first.
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(small):
        facts_for(spark, small)
        earlier_facts(spark, small)
        grown_facts(spark, small)
        talk_for(spark, small)
    # The transcripts are made up from the events and laid down before the clock starts.
    _files(spark, sf_dir)
    # The whole statistics build: discovery, parsing, folding and every fact table.
    times["etl_build_facts"] = timed(lambda: facts_for(spark, sf_dir))
    # The same after a tenth of the files grew, over the facts of the build before.
    earlier_facts(spark, sf_dir)
    times["etl_incremental_build"] = timed(lambda: grown_facts(spark, sf_dir))
    times["etl_build_conversations"] = timed(lambda: talk_for(spark, sf_dir))
    for name in HEADLINE:
        sink(queries[name](spark, sf_dir))
        times[name] = timed(lambda: sink(queries[name](spark, sf_dir)))
    facts = facts_for(spark, sf_dir)
    transcripts, lines = facts.session.count(), facts.entry.count()
    size_mb = facts.listing.agg({"size_bytes": "sum"}).first()[0] / 1e6
    print(
        json.dumps(
            {
                "metric": "threadline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf_dir.rsplit("sf", 1)[-1],
                "transcripts": transcripts,
                "transcripts_per_sec": round(transcripts / times["etl_build_facts"], 1),
                "lines_per_sec": round(lines / times["etl_build_facts"], 1),
                "mb_per_sec": round(size_mb / times["etl_build_facts"], 3),
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
