"""The store tables as views over the given test tables, once as DataFrames and once as SQL.

`Fixtures` is what the registered queries read; `VIEWS` holds the same definitions as SQL text for the
side-by-side check.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecall.plans.store import Store

AS_OF = "2001-08-01"


def as_of() -> Column:
    return F.lit(AS_OF).cast("date")


class Fixtures:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def companies(self) -> DataFrame:
        return self.table("region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))

    @cached_property
    def affiliate_companies(self) -> DataFrame:
        joined = self.table("nation").join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        return joined.select(
            F.col("n_nationkey").alias("id"),
            F.when(F.col("n_nationkey") < 5, F.col("r_name")).otherwise(F.col("n_name")).alias("name"),
            F.col("n_regionkey").alias("parent_company_id"),
        )

    @cached_property
    def company_alternate_names(self) -> DataFrame:
        return self.table("benchmark").select(
            (F.col("item_id") % 5).cast("int").alias("company_id"),
            F.when(F.col("item_id") % 2 == 0, F.lower("text")).otherwise(F.col("text")).alias("alternate_name"),
        )

    @cached_property
    def tags(self) -> DataFrame:
        return (
            self.table("part")
            .select(
                F.replace("p_brand", F.lit("Brand#"), F.lit("")).cast("int").alias("id"),
                F.col("p_brand").alias("name"),
            )
            .distinct()
        )

    @cached_property
    def job_tags(self) -> DataFrame:
        part = self.table("part").select("p_partkey", "p_brand")
        return (
            self.table("lineitem")
            .select("l_orderkey", "l_partkey")
            .join(part, F.col("l_partkey") == F.col("p_partkey"))
            .select(
                F.col("l_orderkey").alias("job_id"),
                F.replace("p_brand", F.lit("Brand#"), F.lit("")).cast("int").alias("tag_id"),
            )
            .distinct()
        )

    @cached_property
    def job_info(self) -> DataFrame:
        parts = self.table("part").agg(F.count("*").alias("n"))
        return (
            self.table("orders")
            .withColumn("part_no", F.col("o_orderkey") % parts.scalar())
            .join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .join(self.table("part"), F.col("part_no") == F.col("p_partkey"))
            .select(
                F.col("o_orderkey").alias("id"),
                F.concat(F.lit("["), "c_mktsegment", F.lit("] "), "p_name").alias("job_title"),
                F.col("n_regionkey").alias("company_id"),
                F.col("c_nationkey").alias("affiliate_company_id"),
                F.concat(F.lit("https://jobs.example/"), F.col("o_orderkey")).alias("link"),
                F.col("p_type").alias("team_info"),
                F.array("p_name", "p_brand").alias("responsibilities"),
                F.split("o_orderpriority", "-").alias("hiring_process"),
                F.when(F.col("p_size") % 2 == 0, F.array().cast("array<string>"))
                .otherwise(F.array("c_name"))
                .alias("additional_info"),
                F.col("o_orderdate").cast("date").alias("uploaded_date"),
                F.col("o_orderdate").alias("updated_at"),
                (F.col("o_orderstatus") == "O").alias("is_active"),
            )
        )

    @cached_property
    def sentences(self) -> DataFrame:
        lines = self.table("documents").select(
            F.col("doc_id").alias("job_id"), F.posexplode(F.split("text", "\n")).alias("at", "sentence")
        )
        return lines.select(
            "job_id",
            F.when(F.col("at") == 0, F.lit("title"))
            .when(F.col("at") % 2 == 1, F.lit("required"))
            .otherwise(F.lit("preferred"))
            .alias("type"),
            F.when(F.col("at") == 0, 0).otherwise(((F.col("at") - 1) / 2).cast("int")).alias("sentence_index"),
            "sentence",
        )

    @cached_property
    def job_embeddings(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").alias("job_id"), "embedding")

    @cached_property
    def resumes(self) -> DataFrame:
        """Documents as resumes, lower-cased as they arrive; vectors where there are any."""
        return self.table("documents").select(F.col("doc_id").alias("resume_id"), F.lower("text").alias("resume_text"))

    @cached_property
    def resume_vectors(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").alias("resume_id"), "embedding")

    @cached_property
    def store(self) -> Store:
        return Store(**{name: getattr(self, name) for name in Store.__dataclass_fields__})


# The same views in SQL, in dependency order.
VIEWS = {
    "companies": "SELECT r_regionkey AS id, r_name AS name FROM region",
    "affiliate_companies": """
        SELECT n_nationkey AS id, CASE WHEN n_nationkey < 5 THEN r_name ELSE n_name END AS name,
               n_regionkey AS parent_company_id
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "company_alternate_names": """
        SELECT CAST(item_id % 5 AS INTEGER) AS company_id,
               CASE WHEN item_id % 2 = 0 THEN lower(text) ELSE text END AS alternate_name
        FROM benchmark""",
    "tags": "SELECT DISTINCT CAST(replace(p_brand, 'Brand#', '') AS INTEGER) AS id, p_brand AS name FROM part",
    "job_tags": """
        SELECT DISTINCT l_orderkey AS job_id, CAST(replace(p_brand, 'Brand#', '') AS INTEGER) AS tag_id
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "job_info": """
        SELECT o_orderkey AS id, '[' || c_mktsegment || '] ' || p_name AS job_title, n_regionkey AS company_id,
               c_nationkey AS affiliate_company_id, 'https://jobs.example/' || o_orderkey AS link,
               p_type AS team_info, [p_name, p_brand] AS responsibilities,
               string_split(o_orderpriority, '-') AS hiring_process,
               CASE WHEN p_size % 2 = 0 THEN CAST([] AS VARCHAR[]) ELSE [c_name] END AS additional_info,
               CAST(o_orderdate AS DATE) AS uploaded_date, o_orderdate AS updated_at,
               o_orderstatus = 'O' AS is_active
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
             JOIN part ON p_partkey = o_orderkey % (SELECT count(*) FROM part)""",
    "sentence_lines": """
        SELECT doc_id, unnest(string_split(text, chr(10))) AS sentence,
               unnest(range(len(string_split(text, chr(10))))) AS pos
        FROM documents""",
    "sentences": """
        SELECT doc_id AS job_id,
               CASE WHEN pos = 0 THEN 'title' WHEN pos % 2 = 1 THEN 'required' ELSE 'preferred' END AS type,
               CAST(CASE WHEN pos = 0 THEN 0 ELSE (pos - 1) // 2 END AS INTEGER) AS sentence_index, sentence
        FROM sentence_lines""",
    "job_embeddings": "SELECT vec_id AS job_id, embedding FROM embeddings",
    "resumes": "SELECT doc_id AS resume_id, lower(text) AS resume_text FROM documents",
    "resume_vectors": "SELECT vec_id AS resume_id, embedding FROM embeddings",
}


def with_views(sql: str, extra: dict[str, str] | None = None) -> str:
    """Put the views a query names, and those they need, in front of it."""
    views = {**VIEWS, **(extra or {})}
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in views:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(views[name])

    visit(sql)
    if not needed:
        return sql
    ctes = ",\n".join(f"{name} AS MATERIALIZED ({views[name]})" for name in views if name in needed)
    if re.match(r"\s*WITH\b", sql, re.I):
        return f"WITH {ctes},\n{re.sub(r'^\s*WITH', '', sql, count=1, flags=re.I)}"
    return f"WITH {ctes}\n{sql}"
