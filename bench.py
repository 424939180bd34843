"""Wall seconds of the reports at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``, as one JSON line.

Each report runs to a no-op sink, so every row and column is computed and nothing is collected.
``queries`` holds the second run of a report and ``first_run`` the first, which also pays for
compiling the JVM code of its plan. Both include building and planning the query.
"""

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from soquy.registry import QUERIES  # noqa: E402

HEADLINE = [
    "summary_reconciliation",
    "detail_reconciliation",
    "detail_exemption",
    "detail_other_paid",
    "account_receivables",
    "summary_revenue",
    "revenue_by_order_dept",
    "detail_revenue",
    "revenue_by_order_and_perform_dept",
    "revenue_reconciliation",
    "summary_deduction",
    "deduction_by_order_dept",
    "deduction_by_order_and_perform_dept",
    "detail_deduction",
    "retail_revenue",
    "functional_food_revenue",
    "retail_deduction",
    "package_cost_by_dept",
    "exam_revenue",
    "exam_revenue_by_patient",
    "inventory_import",
    "inventory_export",
    "inventory_export_requisition",
    "retail_revenue_no_cogs",
    "summary_reconciliation_print",
]


def timed(spark: SparkSession, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name].run(spark, folder).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("soquy-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    first = {name: timed(spark, name, folder) for name in names}
    seconds = {name: timed(spark, name, folder) for name in names}
    print(
        json.dumps(
            {
                "metric": "report wall time, sum over reports",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "first_run": first,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
