"""The store's constraints as one DataFrame of violations: (table_name, constraint_name, violations)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolecall import fixed_values as fixed

NOT_NULL = {
    "companies": ("id", "name"),
    "company_alternate_names": ("company_id", "alternate_name"),
    "affiliate_companies": ("id", "name", "parent_company_id"),
    "tags": ("id", "name"),
    "job_info": (
        "id", "job_title", "company_id", "affiliate_company_id", "link", "team_info", "responsibilities",
        "hiring_process", "additional_info", "uploaded_date",
    ),
    "sentences": ("type", "sentence_index", "sentence"),
    "job_embeddings": ("job_id",),
    "job_tags": ("job_id", "tag_id"),
}
UNIQUE = {
    "companies": (("id",), ("name",)),
    "company_alternate_names": (("company_id", "alternate_name"),),
    "affiliate_companies": (("id",), ("name",)),
    "tags": (("id",), ("name",)),
    "job_info": (("id",), ("link",)),
    "job_embeddings": (("job_id",),),
    "job_tags": (("job_id", "tag_id"),),
}
FOREIGN = {
    "company_alternate_names": (("company_id", "companies"),),
    "affiliate_companies": (("parent_company_id", "companies"),),
    "job_info": (("company_id", "companies"), ("affiliate_company_id", "affiliate_companies")),
    "sentences": (("job_id", "job_info"),),
    "job_embeddings": (("job_id", "job_info"),),
    "job_tags": (("job_id", "job_info"), ("tag_id", "tags")),
}


def _row_checks(name: str, df: DataFrame, width: int) -> DataFrame | None:
    """NOT NULL, word list and vector width in a single pass over the table."""
    counts = {
        f"not_null({c})": F.count_if(F.col(c).isNull()) for c in NOT_NULL.get(name, ()) if c in df.columns
    }
    if name == "sentences":
        counts["check(type)"] = F.count_if(~F.col("type").isin(*fixed.SENTENCE_TYPES))
    if "embedding" in df.columns:
        counts["vector_width"] = F.count_if(F.size("embedding") != width)
    if not counts:
        return None
    one_row = df.agg(*[value.alias(key) for key, value in counts.items()])
    pairs = F.array(*[F.struct(F.lit(key).alias("k"), F.col(f"`{key}`").alias("n")) for key in counts])
    return one_row.select(F.explode(pairs).alias("pair")).select(
        F.lit(name).alias("table_name"), F.col("pair.k").alias("constraint_name"), F.col("pair.n").alias("violations")
    )


def _unique(name: str, df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Rows beyond the first of each key; null keys repeat freely."""
    present = df.dropna(subset=list(keys)).groupBy(*keys).agg(F.count("*").alias("n"))
    return present.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations")).select(
        F.lit(name).alias("table_name"), F.lit(f"unique({', '.join(keys)})").alias("constraint_name"), "violations"
    )


def _foreign(name: str, df: DataFrame, column: str, parent_name: str, parent: DataFrame) -> DataFrame:
    """Child rows whose parent is missing; children are counted per key before the join, so a key that
    very many rows share moves as one row."""
    children = df.dropna(subset=[column]).groupBy(column).agg(F.count("*").alias("n"))
    orphans = children.join(parent.select(F.col("id").alias(column)), column, "left_anti")
    return orphans.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations")).select(
        F.lit(name).alias("table_name"), F.lit(f"foreign({column} -> {parent_name})").alias("constraint_name"), "violations"
    )


def violations(store, width: int = fixed.EMBEDDING_WIDTH, only_broken: bool = True) -> DataFrame:
    tables = {name: getattr(store, name) for name in NOT_NULL}
    parts = [_row_checks(name, df, width) for name, df in tables.items()]
    parts += [_unique(name, tables[name], keys) for name, groups in UNIQUE.items() for keys in groups]
    parts += [
        _foreign(name, tables[name], column, parent, tables[parent])
        for name, links in FOREIGN.items()
        for column, parent in links
    ]
    whole = reduce(DataFrame.unionByName, [p for p in parts if p is not None])
    return whole.where("violations > 0") if only_broken else whole
