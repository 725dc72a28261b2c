"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the number of local cores. Every query runs in full
into a no-op sink, so that nothing is skipped and nothing is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from veiltext.plans import catalog  # noqa: E402
from veiltext.session import local_session  # noqa: E402

HEADLINE = (
    "normalize_text", "mask_text", "mask_by_value", "cleanse_full", "report_rows", "spans",
    "sec_long", "sec_report_text", "finding_counts", "type_rollup", "detect_person_dict",
    "mask_cells_long", "mask_pages_doc_entities", "assemble_pages", "ocr_ngrams", "ocr_pick_ngrams",
    "ocr_match_entities", "stream_counters",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    # The given files have one row group each; all cores share its rows.
    registry = catalog.queries(2 * int(cpus) if cpus.isdigit() else None)
    docs = sum(
        spark.read.parquet(f"{folder}/{name}.parquet").count() for name in ("orders", "documents")
    )
    times: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        begin = time.perf_counter()
        registry[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - begin, 3)
    rates = {n: round(docs / times[n]) for n in ("mask_text", "cleanse_full", "sec_long") if n in times}
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")), "docs": docs,
        "docs_per_sec": rates,
    }))


if __name__ == "__main__":
    main()
