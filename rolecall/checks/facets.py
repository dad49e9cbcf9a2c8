"""Checks of facet counts: from bitmap posting lists, and kept current by signed deltas."""

from pyspark.sql import functions as F

from rolecall.checks.fixtures import Fixtures, as_of
from rolecall.checks.registry import check
from rolecall.checks.relational import LISTING_VIEWS
from rolecall.checks.parsing import text_ids
from rolecall.operators import merge
from rolecall.plans import facets, live_counts
from rolecall.session import scratch_path
from rolecall.sources.tables import next_store, read_store, version_name, write_store

CHOICES = {
    "c8_facet_counts": (
        "(company_name IN ('ASIA', 'NATION_7') OR affiliate_company_name IN ('ASIA', 'NATION_7')) "
        "AND list_has_any(string_split(tags, '|'), ['Brand#2', 'Brand#11'])",
        {"companies": ["ASIA", "NATION_7"], "tags": ["Brand#2", "Brand#11"]},
    ),
    "c8_facet_counts_tags": ("list_has_any(string_split(tags, '|'), ['Brand#3', 'Brand#7', 'Brand#25'])", {"tags": ["Brand#3", "Brand#7", "Brand#25"]}),
    "c8_facet_counts_recent": (
        "uploaded_in_a_week AND (company_name IN ('EUROPE', 'AFRICA', 'ASIA') OR affiliate_company_name IN ('EUROPE', 'AFRICA', 'ASIA'))",
        {"companies": ["EUROPE", "AFRICA", "ASIA"], "recent_week": True},
    ),
    "c8_facet_counts_all": ("true", {}),
}


def _counts(condition: str) -> str:
    return f"""
        WITH chosen AS (SELECT * FROM listing WHERE {condition})
        SELECT 'company' AS kind, company_name AS value, count(*) AS job_count FROM chosen GROUP BY company_name
        UNION ALL SELECT 'member', affiliate_company_name, count(*) FROM chosen WHERE affiliate_company_name <> company_name GROUP BY ALL
        UNION ALL SELECT 'tag', tag, count(*) FROM (SELECT unnest(string_split(tags, '|')) AS tag FROM chosen WHERE tags <> '') GROUP BY tag"""


def _register(name, condition, choice):
    @check(name, _counts(condition), LISTING_VIEWS)
    def counts(fx: Fixtures):
        lists = facets.save_lists(facets.posting_lists(fx.store), scratch_path(fx.spark, "posting-lists"))
        return facets.facet_counts(lists, facets.chosen(lists, as_of(), **choice))


for _name, (_condition, _choice) in CHOICES.items():
    _register(_name, _condition, _choice)


# ----------------------------------------------------------------- counts kept current

GONE, SWITCHED_OFF = 4, 5


@check("e3_live_counts", f"""
    WITH jobs AS (
        SELECT id, company_id, affiliate_company_id, is_active AND id % 20 <> {SWITCHED_OFF} AS on_
        FROM job_info WHERE company_id <> {GONE} AND affiliate_company_id NOT IN (SELECT id FROM affiliate_companies WHERE parent_company_id = {GONE}))
    SELECT 'tag' AS kind, t.name, CAST(NULL AS VARCHAR) AS parent, count(*) AS job_count
    FROM jobs JOIN job_tags ON job_id = jobs.id JOIN tags t ON t.id = tag_id WHERE on_ GROUP BY t.name
    UNION ALL SELECT 'company', c.name, NULL, count(*) FROM jobs JOIN companies c ON c.id = company_id WHERE on_ GROUP BY c.name
    UNION ALL SELECT 'affiliate', a.name, p.name, count(*)
    FROM jobs JOIN affiliate_companies a ON a.id = affiliate_company_id JOIN companies c ON c.id = company_id JOIN companies p ON p.id = a.parent_company_id
    WHERE on_ AND a.name <> c.name GROUP BY ALL""")
def live(fx: Fixtures):
    """Counts after a half of the postings, the other half, more tags, some switched off, and a company deleted; each a version."""
    spark, root = fx.spark, scratch_path(fx.spark, "store")
    whole = text_ids(fx.store)
    early = F.col("id").cast("long") % 3 != 0
    first = whole.with_tables(job_info=whole.job_info.where(early), job_tags=whole.job_tags.where("job_id % 3 = 1"))
    write_store(spark, first, root, version_name(0), buckets=8)
    live_counts.update(spark, root)
    steps = [
        lambda store: {"job_info": store.job_info.unionByName(whole.job_info.where(~early))},
        lambda store: {"job_tags": merge.insert_ignore(store.job_tags, whole.job_tags, ["job_id", "tag_id"])},
        lambda store: {"job_info": store.job_info.withColumn("is_active", F.col("is_active") & (F.col("id").cast("long") % 20 != SWITCHED_OFF))},
        lambda store: {n: df for n, df in merge.cascade_delete(store, companies=spark.range(GONE, GONE + 1)).tables().items() if n in ("companies", "affiliate_companies", "job_info", "job_tags")},
    ]
    for step in steps:
        next_store(spark, root, step(read_store(spark, root)))
        live_counts.update(spark, root)
    tags, companies, affiliates = live_counts.latest(spark, root)
    none = F.lit(None).cast("string").alias("parent")
    return (
        tags.select(F.lit("tag").alias("kind"), F.col("tag_name").alias("name"), none, "job_count")
        .union(companies.select(F.lit("company"), "company_name", none, "job_count"))
        .union(affiliates.select(F.lit("affiliate"), "affiliate_company_name", "parent_company_name", "job_count"))
    )
