"""Environmental tables as views of the driver's tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SQL = {
    "stations": """SELECT DISTINCT user_id AS station_id,
 19 + CAST((user_id * 37) % 130 AS DOUBLE) / 10 AS lon, 59 + CAST((user_id * 53) % 120 AS DOUBLE) / 10 AS lat,
 CAST((user_id * 17) % 500 AS DOUBLE) AS elevation FROM events""",
    "obs": "SELECT user_id AS station_id, ts AS time, event_type AS parameter, value, event_id AS seq FROM events",
    "strikes": """SELECT event_id AS id, ts AS time,
 19 + CAST((event_id * 7919) % 13000 AS DOUBLE) / 1000 AS lon, 59 + CAST((event_id * 6101) % 12000 AS DOUBLE) / 1000 AS lat,
 CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(event_id % 2 AS INT) END AS cloud_indicator,
 CASE WHEN event_id % 3 = 0 THEN value ELSE -value END AS peak_current_ka FROM events""",
    "frames": """SELECT CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS INT) AS frame,
 CAST(l_partkey % 20 AS INT) AS row_idx, CAST(l_suppkey % 20 AS INT) AS col_idx, round(avg(l_quantity), 6) AS value
 FROM lineitem GROUP BY 1, 2, 3""",
    "run_acc": """SELECT run_time, step, cell, sum(inc) OVER (PARTITION BY run_time, cell ORDER BY step) AS acc
 FROM (SELECT date_trunc('month', o_orderdate) AS run_time, o_orderkey % 24 AS step, o_custkey % 50 AS cell,
 CAST(sum(CAST(round(o_totalprice * 100, 0) AS BIGINT)) AS DOUBLE) AS inc FROM orders GROUP BY 1, 2, 3) t""",
    "areas": """SELECT n_nationkey AS area_id, n_name AS name,
 19 + (n_nationkey % 5) * 2.6e0 AS west, 59 + floor(n_nationkey / 5) * 2.4e0 AS south,
 19 + (n_nationkey % 5) * 2.6e0 + 2.6e0 AS east, 59 + floor(n_nationkey / 5) * 2.4e0 + 2.4e0 AS north FROM nation""",
    "notifications": """SELECT event_id AS id, CAST(user_id AS VARCHAR(20)) || '/' || event_type AS data_id, ts AS pubtime,
 event_type = 'error' AS is_deletion FROM events
 UNION ALL SELECT event_id + 1000000000 AS id, CAST(user_id AS VARCHAR(20)) || '/' || event_type AS data_id, ts AS pubtime,
 event_type = 'error' AS is_deletion FROM events WHERE event_id % 4 = 0""",
    "alerts": """SELECT 'S' || CAST(e.event_id % 7 AS VARCHAR(20)) AS sender, 'A' || CAST(e.event_id % 300 AS VARCHAR(20)) AS identifier, e.ts AS sent,
 CASE e.event_type WHEN 'purchase' THEN 'Update' WHEN 'error' THEN 'Cancel' ELSE 'Alert' END AS msg_type,
 'S' || CAST(r.event_id % 7 AS VARCHAR(20)) AS ref_sender, 'A' || CAST(r.event_id % 300 AS VARCHAR(20)) AS ref_identifier, r.ts AS ref_sent,
 CAST(floor(e.value) % 5 AS INT) AS severity
 FROM events e LEFT JOIN events r ON r.event_id = e.event_id - 7 AND e.event_type IN ('purchase', 'error')""",
    "gates": """SELECT DISTINCT CAST(l_orderkey % 3 AS INT) AS site, 0.5e0 + (l_linenumber - 1) * 1.5e0 AS elangle,
 CAST(l_partkey % 360 AS INT) AS azimuth, CAST(l_suppkey % 100 AS INT) AS range_idx, CAST(l_quantity AS DOUBLE) AS dbz FROM lineitem""",
    "scans": """SELECT DISTINCT CAST(l_orderkey % 3 AS INT) AS site, CAST((year(l_shipdate) - 1992) * 12 + month(l_shipdate) - 1 AS INT) AS scan, 0.5e0 + (l_linenumber - 1) * 1.5e0 AS elangle,
 CAST(l_partkey % 360 AS INT) AS azimuth, CAST(l_suppkey % 100 AS INT) AS range_idx, CAST(l_quantity AS DOUBLE) AS dbz FROM lineitem""",
    "bands": """SELECT CAST(l_orderkey % 50 AS INT) AS pixel, CAST(7 + l_linenumber AS INT) AS band,
 round(200 + 2 * avg(l_quantity), 6) AS bt_k FROM lineitem GROUP BY 1, 2""",
}
_BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of SQL over the tables of sf_dir."""
    text = SQL[name]
    for base in _BASE:
        if base in text.replace("FROM", " FROM ").split() or f"JOIN {base}" in text:
            spark.read.parquet(f"{sf_dir}/{base}.parquet").createOrReplaceTempView(base)
    return spark.sql(text)


def with_views(*names: str, recursive: bool = False) -> str:
    """The head of an oracle: WITH name AS (...), ..."""
    return "WITH RECURSIVE " * recursive + "WITH " * (not recursive) + ", ".join(f"{n} AS ({SQL[n]})" for n in names) + "\n"
