"""The eight store tables as one bundle of DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecall import schemas


@dataclass(frozen=True)
class Store:
    companies: DataFrame
    company_alternate_names: DataFrame
    affiliate_companies: DataFrame
    tags: DataFrame
    job_info: DataFrame
    sentences: DataFrame
    job_embeddings: DataFrame
    job_tags: DataFrame

    def with_tables(self, **tables: DataFrame) -> Store:
        return replace(self, **tables)

    def tables(self) -> dict[str, DataFrame]:
        return {field.name: getattr(self, field.name) for field in fields(self)}


def table_schema(name: str):
    return schemas.STORE["job_qualification_sentences" if name == "sentences" else name]


def empty_store(spark: SparkSession) -> Store:
    def empty(name: str) -> DataFrame:
        fields_ = table_schema(name).fields
        return spark.range(0).select(*[F.lit(None).cast(field.dataType).alias(field.name) for field in fields_])

    return Store(**{f.name: empty(f.name) for f in fields(Store)})
