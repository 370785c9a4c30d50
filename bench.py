"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one line of JSON."""

from __future__ import annotations

import json
import os
import time

import numpy as np
from pyspark.sql import functions as F


def main() -> None:
    from pyspark.sql import SparkSession

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from arbora import queries as q
    from arbora.operators import binning, trees
    from arbora.plans.estimator import Bart
    from arbora.plans.sampler import Loop, Model, State, run_gram

    seconds: dict[str, float] = {}

    def timed(name: str, f, per: int = 1):
        t = time.time()
        out = f()
        seconds[name] = round((time.time() - t) / per, 4)
        return out

    q.bin_even(spark, sf_dir).collect()  # the first job starts the JVM's compilers
    for name in ("bin_quantile", "cut_quantile_unique", "traverse_forest", "evaluate_forest_sum", "leaf_gram", "posterior_mean", "points_per_leaf", "response_variance_weighted", "fit_continuous", "fit_probit"):
        timed(name, lambda n=name: q.QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save())
    d = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    features = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
    b = binning.RangeEvenBinner(d, features, 64)
    rows = b.transform(d).select(F.monotonically_increasing_id().alias("row_id"), "xb", F.array(F.col("l_extendedprice") / 1e4).alias("y"), F.array(F.lit(1.0)).alias("d")).repartition(int(cpus)).cache()
    n = rows.count()
    model = Model(max_split=b.max_split, offset=[3.8], leaf_prec=[[50.0]], binary=[False], trees=50, prec_df=3.0, prec_rate=[[3.0]])
    run_gram(rows, [State(model, 0, n)], Loop(2, 1), np.array([float(n)]))
    timed("gram_iteration_1_chain_50_trees", lambda: run_gram(rows, [State(model, 0, n)], Loop(4, 6), np.array([float(n)])), 10)
    timed("gram_iteration_4_chains_50_trees", lambda: run_gram(rows, [State(model, c, n) for c in range(4)], Loop(1, 3), np.array([float(n)])), 4)
    m = timed("fit_local_4_chains_50_trees_100_iterations", lambda: Bart(q._orders(spark, sf_dir).limit(10_000), q.X, "y", row_id="o_orderkey", binner=q.even, num_trees=50, n_burn=50, n_save=50, num_chains=4))
    scored = b.transform(d).select("l_orderkey", "xb")
    timed("score_mean_200_samples_50_trees", lambda: trees.latent(scored, ["l_orderkey"], m.trace, m.model.offset, mean=True).write.format("noop").mode("overwrite").save())
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
