"""Facet counts under any choice of companies, tags and dates, from bitmap posting lists.

Active postings are numbered densely, newest first. A posting list holds, for a value of a facet and each stretch of
32,768 numbers, one bitmap of the postings that have it. A choice is an OR over the lists of its values and an AND over
facets, a row a stretch; counts are bits that a list and the choice share. So a choice costs a few kilobytes for every
32,768 postings, and neither postings nor their tags are joined again: that was done once, when the lists were made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rolecall.plans.listing import active, with_company_names
from rolecall.session import stored

LISTS = "value string, bucket long, bits binary, kind string"
#: Facets that are counted: companies, affiliates that are not the company itself, tags.
COUNTED = ("company", "member", "tag")


def numbered(postings: DataFrame) -> DataFrame:
    """postings with `number`, dense from 1, newest first; sorted by range, so no task holds them all."""
    order = [F.col("uploaded_date").desc_nulls_last(), F.col("id")]
    placed = postings.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    placed = stored(placed.select("*", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND((1 << 33) - 1).alias("row")), "numbered")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    bases = placed.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return placed.join(F.broadcast(bases), "part").withColumn("number", F.col("base") + F.col("row") + 1).drop("at", "part", "row", "base")


def posting_lists(store) -> DataFrame:
    """(kind, value, bucket, bits) of all active postings: company, affiliate, member, tag, day and any."""
    named = with_company_names(active(store.job_info), store.companies, store.affiliate_companies)
    rows = numbered(named.select("id", "uploaded_date", "company_name", "affiliate_company_name"))
    entry = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    own = F.array(
        entry("any", F.lit("")), entry("company", F.col("company_name")), entry("affiliate", F.col("affiliate_company_name")),
        entry("member", F.when(F.col("affiliate_company_name") != F.col("company_name"), F.col("affiliate_company_name"))),
        entry("day", F.col("uploaded_date").cast("string")),
    )
    tags = store.tags.select(F.col("id").alias("tag_id"), F.col("name").alias("value"))
    tagged = store.job_tags.join(rows.select(F.col("id").alias("job_id"), "number"), "job_id").join(tags, "tag_id")
    entries = rows.select("number", F.inline(own)).unionByName(tagged.select("number", F.lit("tag").alias("kind"), "value"))
    bits = F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits")
    return entries.where("value IS NOT NULL").groupBy("kind", "value", F.bitmap_bucket_number("number").alias("bucket")).agg(bits)


def save_lists(lists: DataFrame, path: str) -> DataFrame:
    """Write lists by kind, sorted by value, so that a choice reads its own values only; returns them as stored."""
    lists.repartitionByRange("kind", "value", "bucket").sortWithinPartitions("kind", "value", "bucket").write.mode("overwrite").partitionBy("kind").parquet(path)
    return read_lists(lists.sparkSession, path)


def read_lists(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LISTS).parquet(path)


def chosen(lists: DataFrame, as_of: Column, companies=(), tags=(), recent_week: bool = False, recent_day: bool = False) -> DataFrame:
    """(bucket, bits) of the postings that a choice leaves; nothing chosen in a facet leaves it open."""
    kind, value = F.col("kind"), F.col("value")
    since = lambda days: (kind == "day") & (value >= F.date_sub(as_of, days).cast("string"))
    wanted = [kind == "any"]
    wanted += [kind.isin("company", "affiliate") & value.isin(*companies)] if companies else []
    wanted += [(kind == "tag") & value.isin(*tags)] if tags else []
    wanted += [since(7)] if recent_week else []
    wanted += [since(1)] if recent_day else []
    # a list may serve several facets of the choice
    parts = [lists.where(w).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits")) for w in wanted]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    met = every.groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("facets"))
    return met.where(F.col("facets") == len(parts)).select("bucket", "bits")


def facet_counts(lists: DataFrame, choice: DataFrame, kinds=COUNTED) -> DataFrame:
    """(kind, value, job_count): postings of each value among those chosen; values without any do not appear."""
    beside = lists.where(F.col("kind").isin(*kinds)).join(choice.withColumnRenamed("bits", "chosen"), "bucket")
    both = beside.select("kind", "value", "bucket", F.explode(F.array("bits", "chosen")).alias("bits"))
    shared = both.groupBy("kind", "value", "bucket").agg(F.bitmap_count(F.bitmap_and_agg("bits")).alias("n"))
    return shared.groupBy("kind", "value").agg(F.sum("n").alias("job_count")).where("job_count > 0")


def chosen_count(choice: DataFrame) -> DataFrame:
    return choice.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("job_count"))
