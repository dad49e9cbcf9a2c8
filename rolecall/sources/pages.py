"""Landed pages: one row per page with its whole body.

Pages are what a crawler left in storage, one file per result page or detail page. A body is parsed by
the expressions of `sites`; an empty result page gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolecall.functions.text import script_json


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page, body) from a folder of files, each read whole."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("page"), F.col("value").alias("body")
    )


def json_items(pages: DataFrame, schema: str, path: str, body: str = "body", keep: tuple[str, ...] = ("page",)) -> DataFrame:
    """One row per element of the list at `path` of each page's JSON; columns `at` and `item`."""
    items = F.from_json(body, schema)
    for step in path.split("."):
        items = items[step]
    return pages.select(*keep, F.posexplode(items).alias("at", "item"))


def state_items(pages: DataFrame, item_schema: str, body: str = "body", keep: tuple[str, ...] = ("page",)) -> DataFrame:
    """Elements of all list-valued query states in a page's embedded JSON; columns `at` and `item`.

    A state holds a list or something else; the page's JSON is parsed once, as a variant, and what is no list gives no rows.
    """
    whole = F.try_parse_json(script_json(F.col(body), "__NEXT_DATA__"))
    queries = F.try_variant_get(whole, "$.props.pageProps.dehydratedState.queries", "array<variant>")
    states = pages.select(*keep, F.posexplode(queries).alias("state", "query"))
    lists = states.select(*keep, "state", F.posexplode(F.try_variant_get("query", "$.state.data", "array<variant>")).alias("at", "raw"))
    # field by field, so that one of another type is null and the others stay
    fields = T.StructType.fromDDL(item_schema).fields
    item = F.struct(*[F.try_variant_get("raw", f"$.{f.name}", f.dataType.simpleString()).alias(f.name) for f in fields])
    return lists.select(*keep, "state", "at", item.alias("item"))
