"""Roles of the bibliographic model played by the driver's tables, as frames and as SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Roles:
    """papers, links, authors, conferences, categories and journals over a folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def papers(self) -> DataFrame:
        s = F.col("o_orderstatus")
        return self.table("orders").select(
            F.col("o_orderkey").alias("paper_id"), F.concat_ws(" ", "o_orderpriority", F.col("o_orderkey").cast("string")).alias("title"), F.year("o_orderdate").alias("year"),
            F.when(s == "O", "journal").otherwise("conference").alias("type"), F.when(s == "F", F.col("o_custkey")).alias("conf_id"), F.when(s == "O", F.col("o_custkey")).alias("journal_id"),
        )

    @cached_property
    def links(self) -> DataFrame:
        return self.table("lineitem").groupBy(F.col("l_orderkey").alias("paper_id"), F.col("l_suppkey").alias("author_id")).agg(F.min("l_linenumber").alias("author_order"))

    @cached_property
    def authors(self) -> DataFrame:
        return self.table("supplier").select(F.col("s_suppkey").alias("author_id"), F.col("s_name").alias("name"))

    @cached_property
    def conferences(self) -> DataFrame:
        return self.table("customer").select(F.col("c_custkey").alias("conf_id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("rank"), F.col("c_nationkey").alias("primary_for"))

    @cached_property
    def categories(self) -> DataFrame:
        return self.table("nation").select(F.col("n_nationkey").alias("primary_for"), F.col("n_name").alias("description"))

    @cached_property
    def journals(self) -> DataFrame:
        q = F.when(F.col("p_size") <= 10, "Q1").when(F.col("p_size") <= 20, "Q2").when(F.col("p_size") <= 30, "Q3").when(F.col("p_size") <= 40, "Q4")
        return self.table("part").select(F.col("p_partkey").alias("journal_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("publisher"), q.alias("best_quartile"), F.col("p_type").alias("area"), F.col("p_retailprice").alias("sjr_index"), F.col("p_size").alias("h_index"))


#: The same roles as common table expressions; a query goes on with a comma or a SELECT.
SQL = """WITH papers AS (SELECT o_orderkey AS paper_id, o_orderpriority || ' ' || o_orderkey AS title, year(o_orderdate)::INTEGER AS year,
  CASE WHEN o_orderstatus = 'O' THEN 'journal' ELSE 'conference' END AS type, CASE WHEN o_orderstatus = 'F' THEN o_custkey END AS conf_id,
  CASE WHEN o_orderstatus = 'O' THEN o_custkey END AS journal_id FROM orders),
links AS (SELECT l_orderkey AS paper_id, l_suppkey AS author_id, min(l_linenumber) AS author_order FROM lineitem GROUP BY 1, 2),
authors AS (SELECT s_suppkey AS author_id, s_name AS name FROM supplier),
conferences AS (SELECT c_custkey AS conf_id, c_name AS title, c_mktsegment AS rank, c_nationkey AS primary_for FROM customer),
categories AS (SELECT n_nationkey AS primary_for, n_name AS description FROM nation),
journals AS (SELECT p_partkey AS journal_id, p_name AS title, p_brand AS publisher, CASE WHEN p_size <= 10 THEN 'Q1' WHEN p_size <= 20 THEN 'Q2'
  WHEN p_size <= 30 THEN 'Q3' WHEN p_size <= 40 THEN 'Q4' END AS best_quartile, p_type AS area, p_retailprice AS sjr_index, p_size AS h_index FROM part),
pac AS (SELECT paper_id, count(*) AS author_count FROM links GROUP BY 1)
"""
