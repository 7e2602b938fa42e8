"""Pair, vector and score tables derived from the given tables, in Spark and in SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SWAP = ("oleis", "01315")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spoof(name):
    return F.translate(name, *SWAP)


def name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_id, fraudulent_name, real_name, label: parts with even keys paired with their own name in
    swapped characters, the others with the name of another part."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    n = part.count()
    other = part.select(F.col("p_partkey").alias("_k"), F.col("p_name").alias("_other"))
    rows = part.join(other, F.expr(f"_k = (7 * p_partkey + 3) % {n}"))
    even = F.col("p_partkey") % 2 == 0
    return rows.select(
        F.col("p_partkey").alias("pair_id"),
        F.when(even, spoof("p_name")).otherwise(F.col("p_name")).alias("fraudulent_name"),
        F.when(even, F.col("p_name")).otherwise(F.col("_other")).alias("real_name"),
        F.when(even, 1).otherwise((F.col("p_name") == F.col("_other")).cast("int")).alias("label"),
    )


NAME_PAIRS = """name_pairs AS (
  SELECT a.p_partkey AS pair_id,
         CASE WHEN a.p_partkey % 2 = 0 THEN translate(a.p_name, 'oleis', '01315') ELSE a.p_name END AS fraudulent_name,
         CASE WHEN a.p_partkey % 2 = 0 THEN a.p_name ELSE b.p_name END AS real_name,
         CASE WHEN a.p_partkey % 2 = 0 THEN 1 ELSE CAST(a.p_name = b.p_name AS INTEGER) END AS label
  FROM part a JOIN part b ON b.p_partkey = (7 * a.p_partkey + 3) % (SELECT count(*) FROM part))"""


def vec_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_id, fraud_emb, real_emb, label (1: same class)."""
    e = table(spark, sf_dir, "embeddings")
    n = e.count()
    other = e.select(F.col("vec_id").alias("_k"), F.col("embedding").alias("real_emb"), F.col("label").alias("_l"))
    rows = e.join(other, F.expr(f"_k = (vec_id * 7 + 3) % {n}"))
    return rows.select(F.col("vec_id").alias("pair_id"), F.col("embedding").alias("fraud_emb"), "real_emb", (F.col("label") == F.col("_l")).cast("int").alias("label"))


VEC_PAIRS = """vec_pairs AS (
  SELECT a.vec_id AS pair_id, a.embedding::DOUBLE[] AS fraud_emb, b.embedding::DOUBLE[] AS real_emb, CAST(a.label = b.label AS INTEGER) AS label
  FROM embeddings a JOIN embeddings b ON b.vec_id = (a.vec_id * 7 + 3) % (SELECT count(*) FROM embeddings))"""


def line_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bulk scores: label (returned), a heavily tied score and a near-continuous one."""
    li = table(spark, sf_dir, "lineitem")
    return li.select((F.col("l_returnflag") == "R").cast("int").alias("label"), F.col("l_discount").alias("discount"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity"))


LINE_SCORES = """line_scores AS (
  SELECT CAST(l_returnflag = 'R' AS INTEGER) AS label, l_discount AS discount, l_extendedprice AS price, l_quantity AS quantity FROM lineitem)"""


def customer_queries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The stated query set, customers with keys divisible by 50 under swapped names, and all
    customers as references."""
    c = table(spark, sf_dir, "customer")
    queries = c.filter("c_custkey % 50 = 0").select(F.col("c_custkey").alias("query_id"), spoof("c_name").alias("query_name"))
    return queries, c.select(F.col("c_custkey").alias("ref_id"), F.col("c_name").alias("ref_name"))


CUSTOMER_QUERIES = """queries AS (SELECT c_custkey AS query_id, translate(c_name, 'oleis', '01315') AS query_name FROM customer WHERE c_custkey % 50 = 0),
refs AS (SELECT c_custkey AS ref_id, c_name AS ref_name FROM customer)"""


def part_refs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Distinct fraudulent names of the pairs as queries and distinct real names as references, each
    with the smallest pair_id as id."""
    pairs = name_pairs(spark, sf_dir)
    q = pairs.groupBy(F.col("fraudulent_name").alias("query_name")).agg(F.min("pair_id").alias("query_id"))
    r = pairs.groupBy(F.col("real_name").alias("ref_name")).agg(F.min("pair_id").alias("ref_id"))
    return q.select("query_id", "query_name"), r.select("ref_id", "ref_name")


PART_REFS = NAME_PAIRS + """,
queries AS (SELECT min(pair_id) AS query_id, fraudulent_name AS query_name FROM name_pairs GROUP BY fraudulent_name),
refs AS (SELECT min(pair_id) AS ref_id, real_name AS ref_name FROM name_pairs GROUP BY real_name)"""
