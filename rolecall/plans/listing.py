"""Listing and facet queries over the store tables.

Everything is aggregated before it is joined: facet counts shrink to one row per key inside each
partition before anything moves, so one company or tag holding most postings makes no hot task.
Dimension tables are broadcast when their size allows (Spark knows it for tables read as they are, the
tag names are counted) and else shuffled, and adaptive execution splits skewed partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from rolecall.functions.dates import recency_flags


def active(job_info: DataFrame) -> DataFrame:
    return job_info.where("is_active")


def without_titles(sentences: DataFrame) -> DataFrame:
    return sentences.where(F.col("type") != "title")


def tag_arrays(job_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """(job_id, tags): the tag names of each tagged posting, sorted."""
    names = tags.select(F.col("id").alias("tag_id"), F.col("name").alias("tag_name"))
    return job_tags.join(names, "tag_id").groupBy("job_id").agg(F.sort_array(F.collect_list("tag_name")).alias("tags"))


def _ordered(kind: str) -> Column:
    rows = F.collect_list(F.when(F.col("type") == kind, F.struct("sentence_index", "sentence")))
    return F.transform(F.array_sort(rows), lambda row: row["sentence"])


def sentence_lists(sentences: DataFrame) -> DataFrame:
    """(job_id, qualifications, preferred_qualifications) in sentence order; one shuffle by job."""
    return (
        without_titles(sentences)
        .groupBy("job_id")
        .agg(_ordered("required").alias("qualifications"), _ordered("preferred").alias("preferred_qualifications"))
    )


def with_company_names(jobs: DataFrame, companies: DataFrame, affiliates: DataFrame) -> DataFrame:
    company = companies.select(F.col("id").alias("company_id"), F.col("name").alias("company_name"))
    affiliate = affiliates.select(
        F.col("id").alias("affiliate_company_id"), F.col("name").alias("affiliate_company_name")
    )
    return jobs.join(company, "company_id").join(affiliate, "affiliate_company_id")


def with_child_lists(jobs: DataFrame, children: DataFrame, *columns: str) -> DataFrame:
    """Left join one-row-per-job arrays; postings without any get empty arrays, not null."""
    joined = jobs.join(children.withColumnRenamed("job_id", "id"), "id", "left")
    empty = F.array().cast("array<string>")
    return joined.withColumns({name: F.coalesce(F.col(name), empty) for name in columns})


def hydrate(jobs: DataFrame, store) -> DataFrame:
    """Postings with company names, tags and sentence lists."""
    named = with_company_names(jobs, store.companies, store.affiliate_companies)
    tagged = with_child_lists(named, tag_arrays(store.job_tags, store.tags), "tags")
    return with_child_lists(
        tagged, sentence_lists(store.sentences), "qualifications", "preferred_qualifications"
    )


def newest_first(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("uploaded_date").desc(), F.col("id"))


def all_active(store, as_of: Column) -> DataFrame:
    """Every active posting with names, tags, lists and recency flags, newest first."""
    full = hydrate(active(store.job_info), store).select("*", *recency_flags(F.col("uploaded_date"), as_of))
    return newest_first(full)


def count_by_tag(store) -> DataFrame:
    """Active postings per tag; a tag without one does not appear."""
    ids = active(store.job_info).select(F.col("id").alias("job_id"))
    counts = store.job_tags.join(ids, "job_id").groupBy("tag_id").agg(F.count("job_id").alias("job_count"))
    names = store.tags.select(F.col("id").alias("tag_id"), F.col("name").alias("tag_name"))
    named = counts.join(names, "tag_id").select("tag_name", "job_count")
    return named.orderBy(F.col("job_count").desc(), "tag_name")


def count_by_company(store) -> DataFrame:
    counts = active(store.job_info).groupBy("company_id").agg(F.count("id").alias("job_count"))
    names = store.companies.select(F.col("id").alias("company_id"), F.col("name").alias("company_name"))
    named = counts.join(names, "company_id").select("company_name", "job_count")
    return named.orderBy(F.col("job_count").desc(), "company_name")


def count_by_affiliate(store) -> DataFrame:
    """Active postings per affiliate and its parent, where the affiliate is not the company itself.

    Companies play two roles: the posting's company and the affiliate's parent.
    """
    counts = (
        active(store.job_info)
        .groupBy("company_id", "affiliate_company_id")
        .agg(F.count("id").alias("pair_count"))
    )
    company = store.companies.select(F.col("id").alias("company_id"), F.col("name").alias("company_name"))
    parent = store.companies.select(
        F.col("id").alias("parent_company_id"), F.col("name").alias("parent_company_name")
    )
    affiliate = store.affiliate_companies.select(
        F.col("id").alias("affiliate_company_id"), F.col("name").alias("affiliate_company_name"), "parent_company_id"
    )
    named = (
        counts.join(affiliate, "affiliate_company_id")
        .join(company, "company_id")
        .join(parent, "parent_company_id")
        .where(F.col("affiliate_company_name") != F.col("company_name"))
    )
    return (
        named.groupBy("affiliate_company_name", "parent_company_name")
        .agg(F.sum("pair_count").alias("job_count"))
        .orderBy(F.col("job_count").desc(), "affiliate_company_name")
    )


def affiliates_of_listed_parents(by_company: DataFrame, by_affiliate: DataFrame, observed: Observation | None = None) -> DataFrame:
    """Affiliate counts with their parent's count; an affiliate whose parent lists nothing is dropped.

    `observed` gets the number of those, `dropped`, and of their postings, `dropped_jobs`, when the result is computed.
    """
    parents = by_company.select(
        F.col("company_name").alias("parent_company_name"), F.col("job_count").alias("parent_count")
    )
    beside = by_affiliate.join(parents, "parent_company_name", "left")
    missing = F.col("parent_count").isNull()
    if observed is not None:
        lost = F.coalesce(F.sum(F.when(missing, F.col("job_count"))), F.lit(0)).alias("dropped_jobs")
        beside = beside.observe(observed, F.count_if(missing).alias("dropped"), lost)
    return beside.where(~missing)


def company_facets(store) -> DataFrame:
    """Companies by count, each followed by its affiliates by count.

    A company's count already includes its affiliates' postings.
    """
    by_company = count_by_company(store)
    heads = by_company.select(
        "company_name",
        "job_count",
        F.col("job_count").alias("parent_count"),
        F.col("company_name").alias("parent"),
        F.lit(0).alias("level"),
    )
    members = affiliates_of_listed_parents(by_company, count_by_affiliate(store)).select(
        F.col("affiliate_company_name").alias("company_name"),
        "job_count",
        "parent_count",
        F.col("parent_company_name").alias("parent"),
        F.lit(1).alias("level"),
    )
    ordered = heads.unionByName(members).orderBy(
        F.col("parent_count").desc(), "parent", "level", F.col("job_count").desc(), "company_name"
    )
    return ordered.select("company_name", "job_count")


def recent_counts(listed: DataFrame) -> DataFrame:
    return listed.agg(
        F.count_if("uploaded_in_a_week").alias("recent_week_count"),
        F.count_if("uploaded_in_a_day").alias("recent_day_count"),
    )


def display_label(df: DataFrame) -> DataFrame:
    """Heading of a listed posting, numbered from `job_number` when it carries a reason."""
    heading = F.concat("job_title", F.lit(" @ "), "company_name")
    numbered = F.concat((F.col("job_number") + 1).cast("string"), F.lit(". "), heading)
    return df.withColumns(
        {
            "label": F.when(F.coalesce(F.col("reason"), F.lit("")) != "", numbered).otherwise(heading),
            "hiring_steps": F.array_join("hiring_process", " -> "),
        }
    )
