"""Times every relational query; prints one line of JSON. BENCH_SF_DIR: tables, BENCH_CPUS: threads."""

import json
import os
import re
import time

from graniteflow import catalog
from graniteflow.session import build_session


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).count()
    seconds = {}
    families: dict[str, float] = {}
    for name, query in catalog.QUERIES.items():
        begin = time.perf_counter()
        query(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
        family = query.__module__.rpartition(".")[2]
        families[family] = round(families.get(family, 0) + seconds[name], 3)
    sf = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "families": families, "sf": float(sf[1]) if sf else None}))
    spark.stop()


if __name__ == "__main__":
    main()
