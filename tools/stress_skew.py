"""Skew stress on data derived from the driver's lineitem table (not a registered query).

- oversample: one hot class (l_returnflag = 'N', a third of all rows) and 100 small classes
  (l_suppkey % 100), so every small class needs ~50 copies per row;
- smote: the same hot class and 200 small classes of 4-d vectors, ratio 0.05.

Prints sizes, wall time and, from Spark's event log in a scratch folder, the stages whose
tasks ran longest (to see that copy and tile work is spread).
Usage: python tools/stress_skew.py [sf_dir]
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from equiclass.operators.oversample import oversample  # noqa: E402
from equiclass.operators.smote import smote  # noqa: E402

IDS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_linestatus"]


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    logdir = tempfile.mkdtemp(prefix="evlog-stress-", dir="/tmp")
    spark = (SparkSession.builder.master("local[8]")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", logdir)
             .config("spark.eventLog.compress", "false").config("spark.eventLog.rolling.enabled", "false")
             .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    hot = F.col("l_returnflag") == "N"

    df = li.select(*IDS, F.when(hot, F.lit("hot"))
                   .otherwise(F.concat(F.lit("s"), (F.col("l_suppkey") % 100).cast("string"))).alias("cls"))
    t = time.time()
    out = oversample(df, "cls", IDS)
    n = out.count()
    sizes = out.groupBy("cls").count().agg(F.min("count"), F.max("count"), F.count("*")).first()
    print(f"oversample: {n} rows in {time.time() - t:.1f}s; per class min/max/classes {tuple(sizes)}")

    vec = li.select(
        F.monotonically_increasing_id().alias("id"),
        F.when(hot, F.lit("hot")).otherwise(
            F.concat(F.lit("s"), (F.col("l_suppkey") % 200).cast("string"))).alias("label"),
        F.array(F.col("l_quantity"), F.col("l_extendedprice") / 1000, F.col("l_discount") * 10,
                F.col("l_tax") * 10).alias("features"))
    t = time.time()
    syn = smote(vec, "label", "features", "id", k=5, sampling_rate=0.5, ratio_to_max=0.05)
    m = syn.filter("is_synthetic").count()
    print(f"smote: {m} synthetic rows in {time.time() - t:.1f}s")
    spark.stop()

    tasks: dict[int, list[int]] = {}
    for p in glob.glob(f"{logdir}/**", recursive=True):
        if not os.path.isfile(p):
            continue
        for line in open(p):
            ev = json.loads(line)
            if ev["Event"] == "SparkListenerTaskEnd":
                info = ev["Task Info"]
                tasks.setdefault(ev["Stage ID"], []).append(info["Finish Time"] - info["Launch Time"])
    for sid in sorted(tasks, key=lambda s: -sum(tasks[s]))[:6]:
        ds = sorted(tasks[sid])
        print(f"stage {sid}: tasks={len(ds)} total_ms={sum(ds)} median_ms={ds[len(ds) // 2]} max_ms={ds[-1]}")


if __name__ == "__main__":
    main()
