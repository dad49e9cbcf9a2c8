"""Write semantics as set-based merges: each returns the new content of a table.

The store is plain files, so an update is a copy-on-write DataFrame. Joins are arranged so that the big
table is the probe side: when the batch is small Spark broadcasts it and the big table moves nowhere;
when it is not, both sides shuffle on the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stable_uuid(key: Column) -> Column:
    """A UUID-shaped id made from the key, so that a task run twice gives the same id."""
    return F.regexp_replace(F.md5(key.cast("binary")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def _id_bucket(key: Column) -> Column:
    return F.substring(F.md5(key.cast("binary")), 1, 3)


def number_rows(new: DataFrame, key: str, existing: DataFrame, id_col: str = "id") -> DataFrame:
    """Give each row a dense id above the largest existing one, without sorting all rows in one task.

    Rows are numbered inside 4096 hash buckets; a running total over the 4096 bucket counts (their
    number is fixed) gives each bucket its offset.
    """
    bucketed = new.withColumn("bucket", _id_bucket(F.col(key)))
    counts = bucketed.groupBy("bucket").agg(F.count("*").alias("n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    top = existing.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("top"))
    in_bucket = F.row_number().over(Window.partitionBy("bucket").orderBy(key))
    return (
        bucketed.withColumn("in_bucket", in_bucket)
        .join(F.broadcast(offsets), "bucket")
        .withColumn(id_col, (top.scalar() + F.col("offset") + F.col("in_bucket")).cast("int"))
        .select(id_col, *new.columns)
    )


def missing(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of `incoming` whose key is not there yet."""
    return incoming.join(existing.select(*keys), keys, "left_anti")


def get_or_create(existing: DataFrame, incoming: DataFrame, key: str = "name") -> DataFrame:
    """Existing rows plus a numbered row for every incoming name they lack.

    `incoming` has one row per name (see `first_values`); an existing row keeps its own columns.
    """
    new = missing(existing, incoming, [key]).select(*[c for c in existing.columns if c != "id"])
    return existing.unionByName(number_rows(new, key, existing))


def first_values(rows: DataFrame, key: str, seq: str, *columns: str) -> DataFrame:
    """One row per key with the values of its first occurrence."""
    # values are keys at first: counted by hash, where a value that goes with the least `seq` has rows sorted
    met = rows.groupBy(key, *columns).agg(F.min(seq).alias(seq))
    picked = met.groupBy(key).agg(F.min_by(F.struct(F.lit(1), *columns), seq).alias("first"))
    return picked.select(key, *[F.col("first")[c].alias(c) for c in columns])


def insert_ignore(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Append the rows whose key is not there yet; nothing is ever removed."""
    return existing.unionByName(missing(existing, incoming.dropDuplicates(keys), keys))


def upsert(
    existing: DataFrame,
    incoming: DataFrame,
    keys: list[str],
    update: list[str],
    on_update: dict[str, Column] | None = None,
    on_insert: dict[str, Column] | None = None,
) -> DataFrame:
    """Update matched rows and append the others.

    Matched rows take `update` columns from the batch and `on_update` values; all else stays. New rows
    take the batch's columns and `on_insert` values. `incoming` has one row per key.
    """
    on_update, on_insert = on_update or {}, on_insert or {}
    batch = incoming.select(
        *keys, *[F.col(c).alias(f"new_{c}") for c in update], F.lit(True).alias("in_batch")
    )
    hit = F.col("in_batch").isNotNull()
    changed = {c: F.when(hit, F.col(f"new_{c}")).otherwise(F.col(c)) for c in update}
    changed |= {c: F.when(hit, value).otherwise(F.col(c)) for c, value in on_update.items()}
    kept = (
        existing.join(batch, keys, "left")
        .select(*[changed.get(c, F.col(c)).alias(c) for c in existing.columns])
    )
    matched = existing.select(*keys).join(incoming.select(*keys), keys, "left_semi")
    new = incoming.join(matched, keys, "left_anti").withColumns(on_insert)
    columns = [
        (F.col(f.name) if f.name in new.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in existing.schema
    ]
    return kept.unionByName(new.select(*columns))


def replace_children(existing: DataFrame, refreshed: DataFrame, parent: str, parents: DataFrame | None = None) -> DataFrame:
    """Drop the rows of every parent in `refreshed` and append the new ones (missing columns null).

    `parents` are the same parents, where they are at hand without the children.
    """
    parents = refreshed.select(parent).distinct() if parents is None else parents
    return existing.join(parents, parent, "left_anti").unionByName(refreshed, allowMissingColumns=True)


def delete_rows(df: DataFrame, condition: Column | None = None) -> DataFrame:
    """Rows left after a delete; without a condition nothing is left."""
    condition = F.lit(True) if condition is None else condition
    return df.where(~F.coalesce(condition, F.lit(False)))


def deactivate_stale(job_info: DataFrame, now: Column, days: int = 1) -> DataFrame:
    """Switch off postings not seen for `days`; a missing time changes nothing."""
    limit = now - F.expr(f"INTERVAL {days} DAY")
    stale = F.col("updated_at") < limit
    return job_info.withColumn("is_active", F.when(stale, F.lit(False)).otherwise(F.col("is_active")))


def clear_inactive_vectors(child: DataFrame, job_info: DataFrame) -> DataFrame:
    """Null the vectors of inactive postings; rows of unknown or undecided postings stay as they are."""
    inactive = job_info.where(~F.col("is_active")).select(F.col("id").alias("job_id"), F.lit(True).alias("off"))
    joined = child.join(inactive, "job_id", "left")
    cleared = F.when(F.col("off").isNull(), F.col("embedding"))
    return joined.withColumn("embedding", cleared).select(*child.columns)


def cascade_delete(store, companies=None, affiliates=None, jobs=None, tags=None):
    """Delete parents by id and everything that hangs from them; returns the remaining store.

    Each argument is a one-column DataFrame of ids. Only the ids of deleted rows travel, never those of
    the surviving ones.
    """

    def gone(df: DataFrame, column: str, ids: DataFrame | None) -> DataFrame | None:
        return None if ids is None else df.join(ids.toDF(column), column, "left_semi").select(F.col("id").alias("gone"))

    def either(*parts: DataFrame | None) -> DataFrame | None:
        there = [p.toDF("gone") for p in parts if p is not None]
        if not there:
            return None
        whole = there[0]
        for part in there[1:]:
            whole = whole.union(part)
        return whole.distinct()

    def left(df: DataFrame, column: str, ids: DataFrame | None) -> DataFrame:
        return df if ids is None else df.join(ids.toDF(column), column, "left_anti").select(*df.columns)

    lost_affiliates = either(affiliates, gone(store.affiliate_companies, "parent_company_id", companies))
    lost_jobs = either(
        jobs,
        gone(store.job_info, "company_id", companies),
        gone(store.job_info, "affiliate_company_id", lost_affiliates),
    )
    return store.with_tables(
        companies=left(store.companies, "id", companies),
        company_alternate_names=left(store.company_alternate_names, "company_id", companies),
        affiliate_companies=left(store.affiliate_companies, "id", lost_affiliates),
        tags=left(store.tags, "id", tags),
        job_info=left(store.job_info, "id", lost_jobs),
        sentences=left(store.sentences, "job_id", lost_jobs),
        job_embeddings=left(store.job_embeddings, "job_id", lost_jobs),
        job_tags=left(left(store.job_tags, "job_id", lost_jobs), "tag_id", tags),
    )
