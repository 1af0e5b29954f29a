"""Coverage queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from selvage.operators.coverage import contained
from selvage.plans.registry import query
from selvage.tables import table


@query(
    "coverage_by_source",
    """
WITH cov AS (
  SELECT b.item_id, b.item_id % 4 AS source, EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, b.text)) AS covered
  FROM benchmark b)
SELECT source, count(*) AS total, count(*) FILTER (WHERE covered) AS covered,
       CASE WHEN count(*) = 0 THEN 1.0 ELSE round(count(*) FILTER (WHERE covered) / count(*), 4) END AS ratio
FROM cov GROUP BY ROLLUP (source)
""",
)
def coverage_by_source(spark: SparkSession, sf: str) -> DataFrame:
    """J1+G1+G2: a benchmark item is a block, covered when a document contains it."""
    items = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("item"))
    docs = table(spark, sf, "documents").select("text")
    hit = contained(docs, items.withColumnRenamed("item_id", "id")).select(F.col("id").alias("item_id"), F.lit(True).alias("hit"))
    rows = items.join(hit, "item_id", "left").select((F.col("item_id") % 4).alias("source"), F.coalesce("hit", F.lit(False)).alias("covered"))
    n, c = F.count(F.lit(1)), F.count_if("covered")
    return rows.rollup("source").agg(n.alias("total"), c.alias("covered"), F.when(n == 0, 1.0).otherwise(F.round(c / n, 4)).alias("ratio"))
