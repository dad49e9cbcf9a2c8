"""Rule tags: substring tests on the lower-cased title, as one array expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecall import fixed_values as fixed
from rolecall.operators.merge import insert_ignore


def _rule_table(rules) -> Column:
    """The rules as one constant array, so that the expression does not grow with them."""
    rows = []
    for tag, words, pairs in rules:
        pair_rows = [F.struct(F.lit(name).alias("company"), F.lit(word).alias("word")) for name, word in pairs]
        rows.append(
            F.struct(
                F.lit(tag).alias("tag"),
                F.array(*[F.lit(w) for w in words]).cast("array<string>").alias("words"),
                F.array(*pair_rows).cast("array<struct<company:string,word:string>>").alias("pairs"),
            )
        )
    return F.array(*rows)


def assign_tags(title: Column, company: Column, rules=fixed.TAG_RULES) -> Column:
    """Array of tags in rule order. Words match anywhere in the title, also inside longer words.

    The title is lower-cased once: the rules are tested inside a transform over that one value.
    """
    texts = F.array(F.struct(F.lower(F.coalesce(title, F.lit(""))).alias("title"), company.cast("string").alias("company")))

    def tags_of(text: Column) -> Column:
        def hit(rule: Column) -> Column:
            own = F.exists(rule["words"], lambda word: F.contains(text["title"], word))
            of_company = F.exists(
                rule["pairs"], lambda p: p["company"].eqNullSafe(text["company"]) & F.contains(text["title"], p["word"])
            )
            return own | of_company

        return F.transform(F.filter(_rule_table(rules), hit), lambda rule: rule["tag"])

    return F.get(F.transform(texts, tags_of), F.lit(0))


def postings_with_company(job_info: DataFrame, companies: DataFrame) -> DataFrame:
    """Every posting, active or not, with its company name if there is one."""
    names = companies.select(F.col("id").alias("company_id"), F.col("name").alias("company_name"))
    return job_info.join(names, "company_id", "left")


def tag_ids_by_name(assigned: DataFrame, tags: DataFrame) -> DataFrame:
    """(job_id, tag) -> (job_id, tag_id); names without a row in `tags` are ignored."""
    ids = tags.select(F.col("id").alias("tag_id"), F.col("name").alias("tag"))
    return assigned.join(ids, "tag").select("job_id", "tag_id")


def fill_job_tags(job_info: DataFrame, companies: DataFrame, tags: DataFrame, job_tags: DataFrame) -> DataFrame:
    """Assign tags to all postings and add the missing (job, tag) pairs; old pairs stay."""
    named = postings_with_company(job_info, companies)
    assigned = named.select(
        F.col("id").alias("job_id"),
        F.explode(assign_tags(F.col("job_title"), F.col("company_name"))).alias("tag"),
    )
    return insert_ignore(job_tags, tag_ids_by_name(assigned, tags), ["job_id", "tag_id"])
