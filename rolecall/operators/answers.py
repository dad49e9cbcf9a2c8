"""Model answers: JSON text to typed columns, unusable ones set aside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolecall import schemas
from rolecall.functions.predicates import nothing_extracted

_CORRUPT = "corrupt"


def parse_extraction(df: DataFrame, answer: str = "answer") -> DataFrame:
    """Add the extraction fields and `is_usable`: well-formed and every field there, lists without gaps."""
    schema = T.StructType([*schemas.EXTRACTION.fields, T.StructField(_CORRUPT, T.StringType())])
    parsed = df.withColumn("parsed", F.from_json(answer, schema, {"columnNameOfCorruptRecord": _CORRUPT}))
    usable: Column = F.col(f"parsed.{_CORRUPT}").isNull()
    for field in schemas.EXTRACTION.fields:
        value = F.col(f"parsed.{field.name}")
        usable = usable & value.isNotNull()
        if isinstance(field.dataType, T.ArrayType):
            usable = usable & F.forall(value, lambda item: item.isNotNull())
    usable = F.coalesce(F.col(answer).isNotNull() & usable, F.lit(False))
    return parsed.withColumn("is_usable", usable).select(*df.columns, "parsed.*", "is_usable").drop(_CORRUPT)


def usable_extractions(df: DataFrame, answer: str = "answer") -> DataFrame:
    """Rows with a usable answer in which something was found."""
    parsed = parse_extraction(df, answer).where("is_usable").drop("is_usable", answer)
    return drop_empty(parsed)


def drop_empty(df: DataFrame) -> DataFrame:
    lists = [F.col(c) for c in ("responsibilities", "qualifications", "preferred_qualifications")]
    return df.where(~nothing_extracted(F.col("team_info"), *lists))


def parse_rerank(answers: DataFrame, key: str = "resume_id", answer: str = "answer") -> DataFrame:
    """(key, rank, job_idx, rank_title, reason) in answer order; indexes may come as text."""
    item = T.StructType([T.StructField(n, T.StringType()) for n in ("job_idx", "job_title", "reason")])
    schema = T.StructType([T.StructField("results", T.ArrayType(item))])
    rows = answers.select(key, F.posexplode(F.from_json(answer, schema)["results"]).alias("rank", "item"))
    return rows.select(
        key,
        "rank",
        F.col("item.job_idx").try_cast("int").alias("job_idx"),
        F.col("item.job_title").alias("rank_title"),
        F.col("item.reason").alias("reason"),
    )
