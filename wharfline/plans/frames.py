"""Procurement lines, posteriors and lifecycle events as derived from the star-schema tables.

``lineitem`` joined with ``orders`` stands for purchase-order lines (one for each order and line number), the days
between order and shipment for durations, suppliers for vendors, part types for material categories, market
segments for projects.  The same derivations in SQL follow each function as a constant.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wharfline.session import table
from wharfline.shared import shares

AS_OF, TODAY, HORIZON = "1999-06-30", "1999-07-10", 365
DRAWS = 100


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines known at AS_OF: ordered by then, with a shipment not before the order.

    Lines are dealt by order once, in shares of a bounded number of rows, then folded and joined with their order in place; suppliers, parts and customers are dimensions.
    """
    raw = table(spark, sf, "lineitem")
    items = raw.repartition(max(shares(raw), spark.sparkContext.defaultParallelism), "l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("vendor"), F.min("l_partkey").alias("part"), F.max(F.to_date("l_shipdate")).alias("ship_date"), F.sum("l_quantity").alias("quantity"))
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("order_date"), (6 - F.substring("o_orderpriority", 1, 1).cast("int")).alias("criticality"))
    known = items.join(orders, items.l_orderkey == orders.o_orderkey).where((F.col("order_date") <= F.lit(AS_OF).cast("date")) & (F.col("ship_date") >= F.col("order_date")))
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("part"), F.col("p_type").alias("category"))
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("project"))
    as_of = F.lit(AS_OF).cast("date")
    return known.join(parts, "part").join(customers, "o_custkey").select(
        F.concat_ws("-", F.format_string("%09d", "l_orderkey"), F.col("l_linenumber").cast("string")).alias("line_id"),
        "project", F.col("l_orderkey").alias("po_number"), F.col("l_linenumber").alias("line_number"), "vendor", "category", "criticality", "quantity", "order_date",
        F.expr("date_add(order_date, 200 + 60 * criticality + cast(vendor * 37 % 400 as int))").alias("need_by"),
        (F.col("ship_date") <= as_of).alias("is_closed"),
        F.datediff("ship_date", "order_date").alias("duration"),
        F.datediff(F.least("ship_date", as_of), "order_date").alias("days"),
    )


LINES = f"""
items AS (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS vendor, min(l_partkey) AS part, max(CAST(l_shipdate AS DATE)) AS ship_date, sum(l_quantity) AS quantity FROM lineitem GROUP BY l_orderkey, l_linenumber),
line AS (SELECT printf('%09d', l_orderkey) || '-' || l_linenumber AS line_id, c_mktsegment AS project, l_orderkey AS po_number, l_linenumber AS line_number, vendor, p_type AS category,
  6 - CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS criticality, quantity, CAST(o_orderdate AS DATE) AS order_date,
  CAST(o_orderdate AS DATE) + CAST(200 + 60 * (6 - CAST(substr(o_orderpriority, 1, 1) AS INTEGER)) + vendor * 37 % 400 AS INTEGER) AS need_by,
  ship_date <= DATE '{AS_OF}' AS is_closed, date_diff('day', CAST(o_orderdate AS DATE), ship_date) AS duration,
  date_diff('day', CAST(o_orderdate AS DATE), least(ship_date, DATE '{AS_OF}')) AS days
  FROM items JOIN orders ON l_orderkey = o_orderkey JOIN part ON part = p_partkey JOIN customer ON o_custkey = c_custkey
  WHERE CAST(o_orderdate AS DATE) <= DATE '{AS_OF}' AND ship_date >= CAST(o_orderdate AS DATE))"""


def posteriors(spark: SparkSession, sf: str) -> DataFrame:
    """(vendor, draws): DRAWS equally likely durations of the vendor's closed lines, ascending.

    Durations are whole days, so a vendor is first folded to a count for each day; the ranks are read off the
    running count of that short list, however many lines the vendor has.
    """
    days = lines(spark, sf).where("is_closed").groupBy("vendor", "duration").agg(F.count("*").alias("n"))
    own = Window.partitionBy("vendor")
    run = days.withColumn("upto", F.sum("n").over(own.orderBy("duration"))).withColumn("total", F.sum("n").over(own))
    upto = lambda c: F.floor(c * DRAWS / F.col("total"))
    times = (upto(F.col("upto")) - upto(F.col("upto") - F.col("n"))).cast("int")
    held = run.select("vendor", F.struct("duration", F.array_repeat("duration", times).alias("d")).alias("s"))
    return held.groupBy("vendor").agg(F.flatten(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["d"])).alias("draws"))


POSTERIORS = f"""{LINES},
ranked AS (SELECT vendor, duration, row_number() OVER (PARTITION BY vendor ORDER BY duration) AS r, count(*) OVER (PARTITION BY vendor) AS n FROM line WHERE is_closed),
posterior AS (SELECT vendor, list(duration ORDER BY i) AS draws FROM ranked JOIN range(1, {DRAWS + 1}) AS t(i) ON r = (i * n + {DRAWS - 1}) // {DRAWS} GROUP BY vendor)"""


def events(spark: SparkSession, sf: str) -> DataFrame:
    """Lifecycle events: a gap-free sequence for each user, states from event types, whole UTC days."""
    raw = table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type", "value")
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return raw.withColumn("seq", F.row_number().over(own)).withColumn("from_state", F.lag("event_type").over(own)).withColumn("to_state", F.col("event_type")).withColumn("day", F.to_date("ts"))


EVENTS = """
log AS (SELECT user_id, event_id, ts, value, event_type AS to_state, lag(event_type) OVER w AS from_state, row_number() OVER w AS seq, CAST(ts AS DATE) AS day FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


def sealed_sql(source: str, group: str, text: str) -> str:
    """Digests of groups by way of blocks of 1024 texts in order: (group, n, digest)."""
    return f"""SELECT {group}, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(d, chr(10) ORDER BY b)) AS digest FROM (SELECT {group}, r // 1024 AS b, count(*) AS n, sha256(string_agg(t, chr(10) ORDER BY r)) AS d
  FROM (SELECT {group}, {text} AS t, row_number() OVER (PARTITION BY {group} ORDER BY {text}) - 1 AS r FROM {source}) GROUP BY {group}, r // 1024) GROUP BY {group}"""
