"""Facet counts kept current by signed deltas.

Beside a store lies, for each version that was counted, a small table of counts (company, pair of company and affiliate,
tag) and the state of each posting by id (company, affiliate, active), in buckets. Counting a later version reads the
buckets of postings and tags whose place has changed since, takes old rows with -1 and new rows with +1, and adds the sums
to the last counts. The tags of postings that were switched, and the state of postings whose tags may have changed, are read
from the buckets of those ids. Names come from the store's dimension tables when counts are listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecall.session import stored
from rolecall.sources.tables import (
    bucket_count,
    bucket_of,
    latest_version,
    read_store,
    read_table,
    table_paths,
    write_buckets,
)

STATE = "id string, company_id int, affiliate_company_id int, is_active boolean"
COUNTS = "kind string, a int, b int, n long"
ENTRY = "bucket int, path string, version string"


def _entry(spark: SparkSession, root: str) -> tuple[str, dict[int, str]]:
    """(the last version counted, where each bucket of its postings' state lies)."""
    rows = spark.read.schema(ENTRY).parquet(f"{root}/live/entries")
    last = rows.agg(F.max("version")).first()[0]
    return last, {r.bucket: r.path for r in rows.where((F.col("version") == last) & (F.col("bucket") >= 0)).collect()}  # a row a bucket


def _state(spark: SparkSession, root: str, paths: dict[int, str], buckets) -> DataFrame:
    there = [paths[b] for b in sorted(buckets) if b in paths]
    if not there:
        return spark.createDataFrame([], STATE)
    return spark.read.option("basePath", f"{root}/live/state").schema(STATE).parquet(*there).select("id", "company_id", "affiliate_company_id", "is_active")


def _buckets_of(ids: DataFrame, buckets: int) -> set[int]:
    return {r[0] for r in ids.select(bucket_of(F.col(ids.columns[0]), buckets)).distinct().collect()}


def _of_state(jobs: DataFrame) -> DataFrame:
    return jobs.select("id", "company_id", "affiliate_company_id", F.coalesce("is_active", F.lit(False)).alias("is_active"))


def changed_paths(before: dict[int, str], after: dict[int, str]) -> tuple[dict[int, str], dict[int, str]]:
    """Those buckets of a table that lie elsewhere in a later version: where they lay, and where they lie."""
    moved = {b for b in before.keys() | after.keys() if before.get(b) != after.get(b)}
    return {b: before[b] for b in moved & before.keys()}, {b: after[b] for b in moved & after.keys()}


def posting_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, old, new): states of the postings whose state differs; null where there is none."""
    packed = lambda side: F.struct("company_id", "affiliate_company_id", "is_active").alias(side)
    none = lambda side: F.lit(None).cast("struct<company_id: int, affiliate_company_id: int, is_active: boolean>").alias(side)
    both = _of_state(old).select("id", packed("old"), none("new")).union(_of_state(new).select("id", none("old"), packed("new")))
    met = both.groupBy("id").agg(F.max("old").alias("old"), F.max("new").alias("new"))
    return met.where(~F.col("old").eqNullSafe(F.col("new")))


def _signed(changes: DataFrame, side: str, sign: int) -> DataFrame:
    """Companies and pairs of active postings on one side of the changes, each with its sign."""
    state = changes.where(F.col(f"{side}.is_active")).select(f"{side}.company_id", f"{side}.affiliate_company_id")
    entry = lambda kind, b: F.struct(F.lit(kind).alias("kind"), F.col("company_id").alias("a"), b.alias("b"))
    none = F.lit(None).cast("int")
    return state.select(F.inline(F.array(entry("company", none), entry("pair", F.col("affiliate_company_id"))))).withColumn("n", F.lit(sign))


def summed(*parts: DataFrame) -> DataFrame:
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy("kind", "a", "b").agg(F.sum("n").cast("long").alias("n")).where("n <> 0")


def update(spark: SparkSession, root: str) -> DataFrame:
    """Count the latest version of the store in `root` from the last one counted; returns (kind, a, b, n)."""
    version, buckets = latest_version(spark, root), bucket_count(spark, root)
    try:
        last, state_paths = _entry(spark, root)
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        last, state_paths = None, {}
    if last == version:
        return counts(spark, root, version)
    before, after = table_paths(spark, root, last) if last else {}, table_paths(spark, root, version)
    moved = {name: changed_paths(before.get(name, {}), after.get(name, {})) for name in ("job_info", "job_tags")}
    read = lambda name, side: read_table(spark, root, name, moved[name][side])

    changes = stored(posting_changes(read("job_info", 0), read("job_info", 1)), "changes")
    was, now = (F.coalesce(F.col(f"{side}.is_active").cast("int"), F.lit(0)) for side in ("old", "new"))
    marks = changes.select("id", was.alias("was"), now.alias("now"))

    # each tag row counts by what its posting is: as it was where the row goes, as it is where the row comes, by the switch where it stays
    switched = _buckets_of(marks.where("was <> now").select("id"), buckets)
    staying = {b: p for b, p in before.get("job_tags", {}).items() if b in switched and b not in moved["job_tags"][0]}
    rows = lambda tags, was, now: tags.select("job_id", "tag_id", F.lit(was).alias("by_was"), F.lit(now).alias("by_now"))
    signed = rows(read("job_tags", 0), -1, 0).unionByName(rows(read("job_tags", 1), 0, 1)).unionByName(rows(read_table(spark, root, "job_tags", staying), -1, 1))
    retagged = moved["job_tags"][0].keys() | moved["job_tags"][1].keys()
    others = _state(spark, root, state_paths, retagged).where("is_active").join(changes.select("id"), "id", "left_anti")
    # where no tags came or went, postings that are as they were have no part
    counted = marks.where("was + now > 0" if retagged else "was <> now").unionByName(others.select("id", F.lit(1).alias("was"), F.lit(1).alias("now")))
    by = (F.col("by_was") * F.col("was") + F.col("by_now") * F.col("now")).alias("n")
    of_tags = signed.join(counted, signed["job_id"] == counted["id"])
    tag_deltas = of_tags.select(F.lit("tag").alias("kind"), F.col("tag_id").alias("a"), F.lit(None).cast("int").alias("b"), by)

    parts = [_signed(changes, "old", -1), _signed(changes, "new", 1), tag_deltas]
    if last:
        parts.append(counts(spark, root, last))
    summed(*parts).coalesce(1).write.mode("overwrite").parquet(f"{root}/live/counts/version={version}")  # a row a key of a facet

    touched = _buckets_of(changes.select("id"), buckets)
    folder = f"{root}/live/state/version={version}"
    kept = _state(spark, root, state_paths, touched).join(changes.select("id"), "id", "left_anti")
    fresh = kept.unionByName(changes.where("new IS NOT NULL").select("id", "new.*"))
    paths = {b: p for b, p in state_paths.items() if b not in touched} | write_buckets(fresh, "id", folder, buckets)
    rows = [(b, p) for b, p in paths.items()] or [(-1, "")]
    # the entry comes last: a run that fails before it is repeated from the version before
    spark.createDataFrame(rows, ENTRY.removesuffix(", version string")).coalesce(1).write.mode("overwrite").parquet(f"{root}/live/entries/version={version}")
    return counts(spark, root, version)


def counts(spark: SparkSession, root: str, version: str) -> DataFrame:
    return spark.read.schema(COUNTS).parquet(f"{root}/live/counts/version={version}")


def _named(counted: DataFrame, kind: str, names: DataFrame, label: str) -> DataFrame:
    return counted.where(F.col("kind") == kind).join(names.select(F.col("id").alias("a"), F.col("name").alias(label)), "a").select(label, F.col("n").alias("job_count"))


def by_tag(counted: DataFrame, store) -> DataFrame:
    named = _named(counted, "tag", store.tags, "tag_name")
    return named.orderBy(F.col("job_count").desc(), "tag_name")


def by_company(counted: DataFrame, store) -> DataFrame:
    named = _named(counted, "company", store.companies, "company_name")
    return named.orderBy(F.col("job_count").desc(), "company_name")


def by_affiliate(counted: DataFrame, store) -> DataFrame:
    """Counts per affiliate and its parent, where the affiliate is not the company itself."""
    company = store.companies.select(F.col("id").alias("a"), F.col("name").alias("company_name"))
    parent = store.companies.select(F.col("id").alias("parent_company_id"), F.col("name").alias("parent_company_name"))
    affiliate = store.affiliate_companies.select(F.col("id").alias("b"), F.col("name").alias("affiliate_company_name"), "parent_company_id")
    named = counted.where("kind = 'pair'").join(affiliate, "b").join(company, "a").join(parent, "parent_company_id").where("affiliate_company_name <> company_name")
    return named.groupBy("affiliate_company_name", "parent_company_name").agg(F.sum("n").alias("job_count")).orderBy(F.col("job_count").desc(), "affiliate_company_name")


def latest(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Counts by tag, by company and by affiliate of the latest version."""
    counted, store = update(spark, root), read_store(spark, root)
    return by_tag(counted, store), by_company(counted, store), by_affiliate(counted, store)
