"""Scale probe: report latency on a replicated fact.

    SCALE_REPLICAS=50 python bench_scale.py

Derives a larger fact from the sf0.1 warehouse by replicating every row
``SCALE_REPLICAS`` times with a replica-specific billing and servicing NPI
(``explode(sequence)``, no join), writes it with the production layout
(partitioned by year, sorted by state and code) into a fresh folder under
``spark.checkpoint.dir`` together with its monthly and yearly provider
summaries, and times the main reports on the fact and on the summaries. Prints one JSON
line. Only a measurement: the registered queries never read this data.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
import uuid

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from pyspark.sql import functions as F  # noqa: E402

from claimscope.operators.filters import ClaimsFilter  # noqa: E402
from claimscope.plans import directory, pages, prep, reports  # noqa: E402
from claimscope.session import local_session  # noqa: E402
from claimscope.sources import schemas, warehouse  # noqa: E402
from claimscope.sources.loaders import load_claims, load_summary  # noqa: E402


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    replicas = int(os.environ.get("SCALE_REPLICAS", "50"))
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cores=cpus, shuffle_partitions=4 * cpus, app="claimscope-scale")
    base = warehouse.open_test_tables(spark, sf)

    rep = F.explode(F.sequence(F.lit(0), F.lit(replicas - 1))).alias("replica")
    bigger = base.claims.select("*", rep).select(
        F.concat(F.col("billing_npi"), F.lit("-"), F.col("replica").cast("string")).alias("billing_npi"),
        F.when(F.col("servicing_npi").isNotNull(),
               F.concat(F.col("servicing_npi"), F.lit("-"), F.col("replica").cast("string"))).alias("servicing_npi"),
        *[c for c in schemas.CLAIMS.fieldNames() if c not in ("billing_npi", "servicing_npi")],
    )
    path = f"{warehouse.scratch_root(spark)}/claimscope/scale/{uuid.uuid4().hex[:12]}"
    t = time.perf_counter()
    prep.write_claims(bigger.repartition(4 * cpus, "billing_npi"), path)
    write_sec = time.perf_counter() - t
    claims = load_claims(spark, path)
    rows = claims.count()
    t = time.perf_counter()
    prep.write_claims(schemas.conform(prep.provider_summary(claims, by_month=True), schemas.MONTH_SUMMARY, "m"),
                      path + "_month_summary")
    month_summary = load_summary(spark, path + "_month_summary", by_month=True)
    prep.write_claims(schemas.conform(prep.provider_summary(month_summary), schemas.SUMMARY, "summary"),
                      path + "_summary")
    summary_sec = time.perf_counter() - t
    summary = load_summary(spark, path + "_summary")
    summary_rows = summary.count()
    month_summary_rows = month_summary.count()

    ref, reg = base.reference, base.registry
    filt = ClaimsFilter(states=["NATION_12", "NATION_15"], years=["1998", "1999"])
    cases = {
        "summary_state_overview": lambda: reports.state_overview(summary),
        "summary_service_category": lambda: reports.category_summary(summary, ref),
        "summary_service_code": lambda: reports.code_detail(summary, ref),
        "summary_trend_yearly": lambda: reports.yearly(summary, ref),
        "summary_directory_billing": lambda: directory.directory(summary, ref, reg, filt, "billing"),
        "month_summary_trend_monthly": lambda: reports.monthly(month_summary, ref),
        "month_summary_category_trend": lambda: reports.category_trend(month_summary, ref),
        "category_trend": lambda: reports.category_trend(claims, ref),
        "state_overview": lambda: reports.state_overview(claims),
        "state_overview_filtered": lambda: reports.state_overview(claims, filt),
        "service_category": lambda: reports.category_summary(claims, ref),
        "service_category_state": lambda: reports.category_state(claims, ref),
        "service_code": lambda: reports.code_detail(claims, ref),
        "trend_monthly": lambda: reports.monthly(claims, ref),
        "trend_yearly": lambda: reports.yearly(claims, ref),
        "directory_billing": lambda: directory.directory(claims, ref, reg, filt, "billing"),
        "directory_combined": lambda: directory.directory(claims, ref, reg, filt, "combined"),
    }

    def once(make) -> float:
        s = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        return time.perf_counter() - s

    out = {}
    for name, make in cases.items():
        once(make)
        out[name] = round(statistics.median(once(make) for _ in range(runs)), 3)

    def page_once() -> float:
        s = time.perf_counter()
        with pages.services_page(claims, ref) as p:
            for df in (p.category, p.category_state, p.code_detail):
                df.write.format("noop").mode("overwrite").save()
        return time.perf_counter() - s

    page_once()
    out["services_page_one_pass"] = round(statistics.median(page_once() for _ in range(runs)), 3)
    out["services_three_reports"] = round(out["service_category"] + out["service_category_state"]
                                          + out["service_code"], 3)
    print(json.dumps({"metric": "report median wall time on replicated fact", "unit": "sec",
                      "fact_rows": rows, "replicas": replicas, "cpus": cpus,
                      "write_sec": round(write_sec, 2), "summary_rows": summary_rows,
                      "month_summary_rows": month_summary_rows,
                      "summary_write_sec": round(summary_sec, 2), "reports": out}))
    spark.stop()


if __name__ == "__main__":
    main()
