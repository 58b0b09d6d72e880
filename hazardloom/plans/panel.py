"""A device panel derived from the orders and customer tables, and the same panel as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hazardloom.functions import month_name
from hazardloom.operators.keyed import lookup

PANEL_CTE = """
b AS (
  SELECT CAST(o_custkey AS VARCHAR(20)) AS serial_number,
         least(CAST(o_orderdate AS DATE), DATE '2001-06-01') AS date,
         o_orderkey AS row_key, c_mktsegment AS model, o_orderstatus AS st, o_custkey AS ck,
         CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS smart_1_raw,
         CASE WHEN o_orderkey % 3 <> 0 THEN NULL ELSE o_totalprice END AS smart_2_raw,
         c_acctbal AS smart_9_raw,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r
  FROM orders JOIN customer ON o_custkey = c_custkey),
panel AS (
  SELECT serial_number, date, row_key, model, smart_1_raw, smart_2_raw, smart_9_raw,
         CASE WHEN (r = 1 AND st = 'F') OR (ck % 50 = 0 AND r = 2) THEN 1 ELSE 0 END AS failure
  FROM b)"""


def read_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers are devices, their orders the daily rows.

    The newest two orders of a customer come from a ranked filter, which Spark cuts down before its shuffle; they are
    marked by the unique order key, so no step gathers all rows of one customer.
    """
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("model"), F.col("c_acctbal").alias("smart_9_raw")
    )
    newest = Window.partitionBy("o_custkey").orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc())
    failing = (
        orders.select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus")
        .withColumn("r", F.row_number().over(newest)).where("r <= 2")
        .where("(r = 1 AND o_orderstatus = 'F') OR (o_custkey % 50 = 0 AND r = 2)")
        .groupBy("o_orderkey").agg(F.lit(1).alias("failure"))  # keys Spark knows to be unique: unused, the join goes
    )
    rows = lookup(orders.withColumn("row_key", F.col("o_orderkey")), customer, "o_custkey", "inner")
    return rows.join(failing, "o_orderkey", "left").select(
        F.col("o_custkey").cast("string").alias("serial_number"),
        F.least(F.col("o_orderdate").cast("date"), F.to_date(F.lit("2001-06-01"))).alias("date"),
        F.col("row_key"),
        "model",
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).alias("smart_1_raw"),
        F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice")).alias("smart_2_raw"),
        "smart_9_raw",
        F.coalesce("failure", F.lit(0)).alias("failure"),
    )


def with_season(panel: DataFrame) -> DataFrame:
    return panel.withColumn("season", month_name("date"))
