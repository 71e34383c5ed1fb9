"""Benchmark the headline queries.

The order-line fact is built from the star schema once and written to the
checkpoint folder as parquet (``load_sales``, timed), the way a dashboard
deployment would stage it; each panel then runs the library operators over
that stored fact. Prints one JSON line.

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8)
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from ordertide.operators import cluster as CL  # noqa: E402
from ordertide.operators import dist as DI  # noqa: E402
from ordertide.operators import evalcurves as EC  # noqa: E402
from ordertide.operators import filters as FL  # noqa: E402
from ordertide.operators import groups as G  # noqa: E402
from ordertide.operators import kpis as K  # noqa: E402
from ordertide.operators import series as SE  # noqa: E402
from ordertide.operators import supervised as SU  # noqa: E402
from ordertide.plans import catalog  # noqa: E402
from ordertide.session import ensure_checkpoint_dir, local_session  # noqa: E402
from ordertide.sources.sales import ROW_KEY, materialize_sales_view, sales_view  # noqa: E402


def panels(s):
    """name -> thunk returning a DataFrame over the stored fact ``s``."""
    flt = lambda: FL.filter_in_dims(FL.filter_date_range(s, *catalog.RANGE), regions=catalog.REGIONS)
    return {
        "kpi_totals": lambda: K.kpi_totals(s),
        "ytd_metrics_anchored": lambda: K.ytd_metrics_anchored(s, None),
        "trend_by_index": lambda: SE.trend_by_index(G.sales_by(flt(), "order_month")),
        "sales_by_region": lambda: G.sales_by_region(s),
        "top_n_subcategories": lambda: G.top_n_subcategories(s),
        "top_customers": lambda: G.top_customers(s),
        "top_products_pivot": lambda: G.top_products_pivot(s),
        "sales_hierarchy": lambda: G.sales_hierarchy(s, "region", "state"),
        "group_features": lambda: G.group_features(s),
        "forecast_monthly": lambda: SE.forecast_monthly(s),
        "sales_quantile": lambda: DI.sales_quantile(s, 0.75),
        "histogram": lambda: DI.histogram(s),
        "box_stats": lambda: DI.box_stats(s, "sales", "category"),
        "qq_normal": lambda: DI.qq_normal(s, "sales", ROW_KEY),
        "kde": lambda: DI.kde(s, "sales", 500),
        "linear_regression": lambda: _regression(s, "linear"),
        "ridge_regression": lambda: _regression(s, "ridge"),
        "classifier_roc": lambda: _classifier(s),
        "kmeans": lambda: CL.kmeans_clusters(CL.cluster_groups_table(s)[0]),
        "elbow_silhouette": lambda: CL.elbow_and_silhouette(CL.cluster_groups_table(s)[0])[0],
        "cluster_hierarchy": lambda: CL.cluster_hierarchy(CL.cluster_groups_table(s)[0]),
    }


def _regression(s, model):
    r = SU.fit_regression(s, model)
    run(r["predictions"])
    return r["metrics"]


def _classifier(s):
    c = SU.fit_classifier(s)
    return EC.roc_auc(c["predictions"])


def run(df):
    """Force full evaluation of every row without collecting them."""
    df.write.format("noop").mode("overwrite").save()


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, shuffle_partitions=max(8, cpus),
                          checkpoint_dir=tempfile.mkdtemp(prefix="ordertide-bench-", dir="/tmp"))
    ckpt = ensure_checkpoint_dir(spark)
    # untimed warm-up: JVM class loading / JIT for scans, aggregation, shuffle
    spark.read.parquet(f"{sf_dir}/region.parquet").groupBy("r_name").count().collect()
    times = {}
    stage = f"{ckpt.rstrip('/')}/bench-fact-{uuid.uuid4().hex}"
    t0 = time.time()
    materialize_sales_view(sales_view(spark, sf_dir), stage)
    times["load_sales"] = time.time() - t0
    s = spark.read.parquet(stage)
    for name, thunk in panels(s).items():
        t = time.time()
        run(thunk())
        times[name] = round(time.time() - t, 3)
    times["load_sales"] = round(times["load_sales"], 3)
    total = round(sum(times.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec",
                      "queries": times, "sf": sf, "cpus": cpus}))


if __name__ == "__main__":
    main()
