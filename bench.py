"""Times the headline queries and prints one JSON line.

Each query is built and run in full into the noop sink, once to warm up and then `BENCH_RUNS` times;
the median counts.  Registered queries include the joins that make flights of the test tables; those
named `stored_...` are the operators alone, over a stored silver table.  `silver_to_gold_month` is the
whole batch job with its writes, over a silver table whose flights are folded into one month of 31 days,
the volume that arrives per month, and `stored_mart_query` a dashboard query on its result.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import functions as F

from skyledger.catalog.registered import QUERIES
from skyledger.operators import flights, marts, quality, ranking
from skyledger.plans.gold import silver_to_gold
from skyledger.schemas import ROUTE_PERFORMANCE, SILVER_FLIGHTS
from skyledger.session import build_session, clear_work, work_folder
from skyledger.sources import testbed
from skyledger.sources.tables import read_table
from skyledger.sources.writers import append_table, write_by_date

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))

HEADLINE = [
    "silver_flights",
    "fact_flights",
    "fact_flights_dw",
    "fact_point_in_time",
    "fact_as_of",
    "mart_route_daily",
    "mart_route_monthly",
    "mart_route_rollup",
    "mart_carrier_daily",
    "mart_route_dw",
    "mart_delay_analysis",
    "top_carriers",
    "ranked_routes",
    "scd2_airport",
    "incremental_load",
    "positions",
    "fr24_explode",
    "dq_rules",
    "dq_unique_key",
]

STORED = {
    "stored_fact_flights": flights.fact_flights,
    "stored_mart_route_daily": lambda silver: marts.route_performance(silver, "day"),
    "stored_mart_route_monthly": lambda silver: marts.route_performance(silver, "month"),
    "stored_mart_delay_analysis": marts.delay_analysis,
    "stored_top_carriers": ranking.top_carriers,
    "stored_dq_rules": lambda silver: quality.check_rules(silver, quality.SILVER_RULES),
}


def main() -> None:
    spark = build_session(
        "bench",
        f"local[{CPUS}]",
        **{
            "spark.sql.shuffle.partitions": CPUS,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def timed(run) -> float:
        laps = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            run()
            laps.append(time.perf_counter() - start)
        return round(statistics.median(laps[1:]), 3)

    chosen = sys.argv[1:] or [*HEADLINE, *STORED, "silver_to_gold_month", "warehouse_rerun"]
    times = {}
    for name in chosen:
        if name == "warehouse_rerun":
            # Two whole runs with all their writes; one lap.
            start = time.perf_counter()
            QUERIES[name](spark, FOLDER).count()
            times[name] = round(time.perf_counter() - start, 3)
        elif name in QUERIES:
            times[name] = timed(lambda: QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save())
    if set(STORED) & set(chosen):
        path = work_folder(spark, "silver")
        append_table(testbed.silver(spark, FOLDER), path)
        silver_table = read_table(spark, path, SILVER_FLIGHTS)
        for name in [n for n in STORED if n in chosen]:
            times[name] = timed(lambda: STORED[name](silver_table).write.format("noop").mode("overwrite").save())
    if "silver_to_gold_month" in chosen:
        work = work_folder(spark, "bench")
        folded = F.make_date(F.lit(2001), F.lit(1), F.dayofmonth("flight_date"))
        silver = testbed.silver(spark, FOLDER).withColumn("flight_date", folded)
        write_by_date(silver, f"{work}/silver/bts", "flight_date", ["carrier_code", "origin_airport"])
        times["silver_to_gold_month"] = timed(
            lambda: silver_to_gold(spark, "20010131", f"{work}/silver", f"{work}/gold")
        )

        def worst_routes_of_a_day() -> None:
            mart = read_table(spark, f"{work}/gold/mart_route_performance", ROUTE_PERFORMANCE)
            day = mart.filter(F.col("flight_date") == F.make_date(F.lit(2001), F.lit(1), F.lit(15)))
            day.orderBy(F.desc("avg_arr_delay_minutes")).limit(10).collect()

        times["stored_mart_query"] = timed(worst_routes_of_a_day)
    clear_work(spark)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": FOLDER.rstrip("/").rpartition("sf")[2],
                "cpus": int(CPUS),
                "runs": RUNS,
            }
        )
    )


if __name__ == "__main__":
    main()
