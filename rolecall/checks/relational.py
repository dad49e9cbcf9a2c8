"""Checks of joins, aggregations, filters and sorts over the store tables."""

from pyspark.sql import Observation
from pyspark.sql import functions as F

from rolecall.checks.fixtures import AS_OF, Fixtures, as_of
from rolecall.checks.registry import check
from rolecall.functions import predicates
from rolecall.functions.dates import recency_flags
from rolecall.operators import merge, tagging
from rolecall.operators.sentences import rows_per_job, sentences_to_embed
from rolecall.plans import listing, matching
from rolecall.sources import tables

DAY = f"DATE '{AS_OF}'"


def joined(df, *columns):
    """Arrays as text, for comparison."""
    return df.withColumns({c: F.array_join(c, "|") for c in columns})


# The listing in SQL, as views the checks below build on.
LISTING_VIEWS = {
    "tag_lists": """
        SELECT job_id, array_to_string(list_sort(list(name)), '|') AS tags
        FROM job_tags JOIN tags ON tag_id = id GROUP BY job_id""",
    "line_lists": """
        SELECT job_id,
               coalesce(string_agg(sentence, '|' ORDER BY sentence_index) FILTER (type = 'required'), '') AS qualifications,
               coalesce(string_agg(sentence, '|' ORDER BY sentence_index) FILTER (type = 'preferred'), '') AS preferred_qualifications
        FROM sentences WHERE type <> 'title' GROUP BY job_id""",
    "full_jobs": """
        SELECT j.id, j.job_title, j.company_id, j.affiliate_company_id, j.link, j.team_info,
               array_to_string(j.responsibilities, '|') AS responsibilities,
               array_to_string(j.hiring_process, '|') AS hiring_process,
               array_to_string(j.additional_info, '|') AS additional_info,
               j.uploaded_date, j.updated_at, j.is_active, c.name AS company_name, ac.name AS affiliate_company_name,
               coalesce(t.tags, '') AS tags, coalesce(l.qualifications, '') AS qualifications,
               coalesce(l.preferred_qualifications, '') AS preferred_qualifications
        FROM job_info j JOIN companies c ON j.company_id = c.id
             JOIN affiliate_companies ac ON j.affiliate_company_id = ac.id
             LEFT JOIN tag_lists t ON t.job_id = j.id LEFT JOIN line_lists l ON l.job_id = j.id""",
    "listing": f"""
        SELECT *, coalesce(uploaded_date >= {DAY} - 7, false) AS uploaded_in_a_week,
               coalesce(uploaded_date >= {DAY} - 1, false) AS uploaded_in_a_day
        FROM full_jobs WHERE is_active""",
}
LISTS = ("responsibilities", "hiring_process", "additional_info", "tags", "qualifications", "preferred_qualifications")


@check(
    "g1_listing_newest_first",
    "SELECT * FROM listing",
    LISTING_VIEWS,
)
def listing_newest_first(fx: Fixtures):
    return joined(listing.all_active(fx, as_of()), *LISTS)


@check("d1_dim_join", """
    SELECT j.id, j.job_title, c.name AS company_name, ac.name AS affiliate_company_name
    FROM job_info j JOIN companies c ON j.company_id = c.id JOIN affiliate_companies ac ON j.affiliate_company_id = ac.id""")
def dim_join(fx: Fixtures):
    named = listing.with_company_names(fx.job_info, fx.companies, fx.affiliate_companies)
    return named.select("id", "job_title", "company_name", "affiliate_company_name")


@check("d2_tag_left_join", """
    SELECT j.id, t.name AS tag_name FROM job_info j LEFT JOIN job_tags jt ON j.id = jt.job_id LEFT JOIN tags t ON jt.tag_id = t.id""")
def tag_left_join(fx: Fixtures):
    tags = listing.tag_arrays(fx.job_tags, fx.tags)
    with_tags = listing.with_child_lists(fx.job_info.select("id"), tags, "tags")
    return with_tags.select("id", F.explode_outer("tags").alias("tag_name"))


TAG_COUNTS = """
    WITH live AS (SELECT id AS posting FROM job_info WHERE is_active),
    per_tag AS (SELECT tag_id, count(*) AS job_count FROM job_tags WHERE job_id IN (SELECT posting FROM live) GROUP BY tag_id)
    SELECT name AS tag_name, job_count FROM per_tag JOIN tags ON id = tag_id"""


@check("d3_null_rejecting_left", TAG_COUNTS)
def null_rejecting_left(fx: Fixtures):
    """As written with outer joins; Spark turns them into inner ones."""
    joined_all = (
        fx.tags.join(fx.job_tags, F.col("id") == F.col("tag_id"), "left")
        .select("name", "job_id")
        .join(fx.job_info.select(F.col("id").alias("posting"), "is_active"), F.col("job_id") == F.col("posting"), "left")
        .where("is_active")
    )
    return joined_all.groupBy(F.col("name").alias("tag_name")).agg(F.count("job_id").alias("job_count"))


@check("e3_count_by_tag", TAG_COUNTS)
def count_by_tag(fx: Fixtures):
    return listing.count_by_tag(fx)


@check("e4_count_by_company", """
    SELECT c.name AS company_name, count(j.id) AS job_count
    FROM job_info j JOIN companies c ON j.company_id = c.id WHERE j.is_active GROUP BY c.name""")
def count_by_company(fx: Fixtures):
    return listing.count_by_company(fx)


AFFILIATE_COUNTS = """
    SELECT ac.name AS affiliate_company_name, pc.name AS parent_company_name, count(j.id) AS job_count
    FROM job_info j JOIN affiliate_companies ac ON j.affiliate_company_id = ac.id
         JOIN companies c ON j.company_id = c.id JOIN companies pc ON ac.parent_company_id = pc.id
    WHERE j.is_active AND ac.name <> c.name GROUP BY ac.name, pc.name"""


@check("e5_count_by_affiliate", AFFILIATE_COUNTS.replace("count(j.id)", "CAST(count(j.id) AS BIGINT)"))
def count_by_affiliate(fx: Fixtures):
    return listing.count_by_affiliate(fx)


@check("d4_role_playing_dim", """
    SELECT j.id, c.name AS company_name, pc.name AS parent_company_name
    FROM job_info j JOIN companies c ON j.company_id = c.id
         JOIN affiliate_companies ac ON j.affiliate_company_id = ac.id JOIN companies pc ON ac.parent_company_id = pc.id""")
def role_playing_dim(fx: Fixtures):
    named = listing.with_company_names(fx.job_info.select("id", "company_id", "affiliate_company_id"), fx.companies, fx.affiliate_companies)
    parent = fx.affiliate_companies.select(F.col("id").alias("affiliate_company_id"), "parent_company_id").join(
        fx.companies.select(F.col("id").alias("parent_company_id"), F.col("name").alias("parent_company_name")), "parent_company_id"
    )
    return named.join(parent, "affiliate_company_id").select("id", "company_name", "parent_company_name")


@check("d5_residual_inequality", """
    SELECT j.id, ac.name AS affiliate_company_name, c.name AS company_name
    FROM job_info j JOIN affiliate_companies ac ON j.affiliate_company_id = ac.id JOIN companies c ON j.company_id = c.id
    WHERE ac.name <> c.name""")
def residual_inequality(fx: Fixtures):
    named = listing.with_company_names(fx.job_info, fx.companies, fx.affiliate_companies)
    return named.where("affiliate_company_name <> company_name").select("id", "affiliate_company_name", "company_name")


@check("d6_left_company", "SELECT j.id, j.job_title, c.name AS company_name FROM job_info j LEFT JOIN companies c ON j.company_id = c.id AND c.id <> 3")
def left_company(fx: Fixtures):
    """One company is missing, so its postings must stay with a null name."""
    return tagging.postings_with_company(fx.job_info, fx.companies.where("id <> 3")).select("id", "job_title", "company_name")


@check("d7_sentence_active_join", """
    SELECT s.job_id, s.type, s.sentence_index, s.sentence FROM sentences s JOIN job_info j ON j.id = s.job_id WHERE j.is_active""")
def sentence_active_join(fx: Fixtures):
    return sentences_to_embed(fx.sentences, fx.job_info).orderBy("job_id", "type", "sentence_index")


@check("d9_id_list_semi", """
    SELECT id, job_title, link FROM job_info WHERE id IN (SELECT job_id FROM job_embeddings)""")
def id_list_semi(fx: Fixtures):
    ids = fx.job_embeddings.select(F.col("job_id").alias("id"))
    return fx.job_info.join(ids, "id", "left_semi").select("id", "job_title", "link")


@check("d11_child_list_map", "SELECT id, qualifications, preferred_qualifications FROM full_jobs", LISTING_VIEWS)
def child_list_map(fx: Fixtures):
    lists = listing.sentence_lists(fx.sentences)
    with_lists = listing.with_child_lists(fx.job_info.select("id"), lists, "qualifications", "preferred_qualifications")
    return joined(with_lists, "qualifications", "preferred_qualifications")


@check("d12_tag_name_lookup", """
    SELECT l_orderkey AS job_id, CAST(replace(p_brand, 'Brand#', '') AS INTEGER) AS tag_id
    FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand NOT LIKE '%7'""")
def tag_name_lookup(fx: Fixtures):
    """Names of every order line's brand, looked up in a tag table that lacks some of them."""
    named = fx.table("lineitem").join(fx.table("part"), F.col("l_partkey") == F.col("p_partkey"))
    assigned = named.select(F.col("l_orderkey").alias("job_id"), F.col("p_brand").alias("tag"))
    return tagging.tag_ids_by_name(assigned, fx.tags.where("name NOT LIKE '%7'"))


@check("d13_update_from_join", """
    SELECT e.job_id, CASE WHEN j.is_active IS NOT NULL AND NOT j.is_active THEN NULL
                          ELSE round(list_sum(CAST(e.embedding AS DOUBLE[])), 5) END AS total
    FROM job_embeddings e LEFT JOIN job_info j ON j.id = e.job_id""")
def update_from_join(fx: Fixtures):
    cleared = merge.clear_inactive_vectors(fx.job_embeddings, fx.job_info)
    total = F.aggregate("embedding", F.lit(0.0), lambda t, x: t + x.cast("double"))
    return cleared.select("job_id", F.round(total, 5).alias("total"))


@check("i6_clear_stale_vectors", """
    SELECT s.job_id, s.type, s.sentence_index,
           CASE WHEN j.is_active IS NOT NULL AND NOT j.is_active THEN NULL ELSE length(s.sentence) END AS width
    FROM sentences s LEFT JOIN job_info j ON j.id = s.job_id""")
def clear_stale_vectors(fx: Fixtures):
    """Sentence vectors of inactive postings; a one-element vector stands in for each sentence."""
    vectors = fx.sentences.withColumn("embedding", F.array(F.length("sentence").cast("float")))
    cleared = merge.clear_inactive_vectors(vectors, fx.job_info)
    return cleared.select("job_id", "type", "sentence_index", F.get("embedding", F.lit(0)).cast("long").alias("width"))


PARENTLESS = f"""
    WITH by_affiliate AS ({AFFILIATE_COUNTS}), by_company AS (
        SELECT c.name, count(j.id) AS n FROM job_info j JOIN companies c ON j.company_id = c.id
        WHERE j.is_active AND c.name <> 'ASIA' GROUP BY c.name)"""


@check("d15_parent_lookup", f"""{PARENTLESS}
    SELECT a.affiliate_company_name, a.parent_company_name, CAST(a.job_count AS BIGINT) AS job_count, b.n AS parent_count
    FROM by_affiliate a JOIN by_company b ON b.name = a.parent_company_name""")
def parent_lookup(fx: Fixtures):
    """One parent lists nothing: its affiliates are dropped."""
    by_company = listing.count_by_company(fx).where("company_name <> 'ASIA'")
    return listing.affiliates_of_listed_parents(by_company, listing.count_by_affiliate(fx))


@check("d15_parents_missing", f"""{PARENTLESS}
    SELECT count(*) AS dropped, CAST(coalesce(sum(job_count), 0) AS BIGINT) AS dropped_jobs
    FROM by_affiliate WHERE parent_company_name NOT IN (SELECT name FROM by_company)""")
def parents_missing(fx: Fixtures):
    """What the lookup dropped, as the metric that it leaves."""
    seen = Observation()
    by_company = listing.count_by_company(fx).where("company_name <> 'ASIA'")
    listing.affiliates_of_listed_parents(by_company, listing.count_by_affiliate(fx), seen).write.format("noop").mode("overwrite").save()
    return fx.spark.createDataFrame([(seen.get["dropped"], seen.get["dropped_jobs"])], "dropped long, dropped_jobs long")


@check("e1_tag_array", "SELECT id, tags FROM full_jobs WHERE is_active", LISTING_VIEWS)
def tag_array(fx: Fixtures):
    tags = listing.tag_arrays(fx.job_tags, fx.tags)
    return joined(listing.with_child_lists(listing.active(fx.job_info).select("id"), tags, "tags"), "tags")


VARIANT_ROWS = """
    SELECT c.id AS company_id, c.name AS company_name, c.name AS name_variant FROM companies c
    UNION ALL
    SELECT c.id, c.name, a.alternate_name FROM companies c JOIN company_alternate_names a ON c.id = a.company_id"""


@check("e2_variant_array", f"""
    SELECT company_id, company_name, string_agg(name_variant, '|' ORDER BY name_variant) AS name_variants
    FROM ({VARIANT_ROWS}) GROUP BY company_id, company_name""")
def variant_array(fx: Fixtures):
    return joined(matching.variant_arrays(fx.companies, fx.company_alternate_names), "name_variants")


@check("h1_variant_union", VARIANT_ROWS)
def variant_union(fx: Fixtures):
    return matching.name_variants(fx.companies, fx.company_alternate_names).select("company_id", "company_name", "name_variant")


@check("e6_sentence_lists", "SELECT * FROM line_lists", LISTING_VIEWS)
def sentence_lists(fx: Fixtures):
    return joined(listing.sentence_lists(fx.sentences), "qualifications", "preferred_qualifications")


@check("e7_company_facet_list", f"""
    WITH by_affiliate AS ({AFFILIATE_COUNTS}), by_company AS (
        SELECT c.name AS company_name, count(j.id) AS job_count FROM job_info j JOIN companies c ON j.company_id = c.id
        WHERE j.is_active GROUP BY c.name)
    SELECT company_name, CAST(job_count AS BIGINT) AS job_count FROM by_company
    UNION ALL SELECT affiliate_company_name, CAST(a.job_count AS BIGINT) FROM by_affiliate a JOIN by_company b ON b.company_name = a.parent_company_name""")
def company_facet_list(fx: Fixtures):
    return listing.company_facets(fx)


@check("e9_recent_counts", """
    SELECT count(*) FILTER (uploaded_in_a_week) AS recent_week_count, count(*) FILTER (uploaded_in_a_day) AS recent_day_count
    FROM listing""", LISTING_VIEWS)
def recent_counts(fx: Fixtures):
    flagged = listing.active(fx.job_info).select(*recency_flags(F.col("uploaded_date"), as_of()))
    return listing.recent_counts(flagged)


@check("e11_rows_per_job", """
    SELECT s.job_id, count(*) AS n,
           string_agg(s.type || ':' || s.sentence_index || ':' || s.sentence, '|' ORDER BY s.type, s.sentence_index) AS rows
    FROM sentences s JOIN job_info j ON j.id = s.job_id WHERE j.is_active GROUP BY s.job_id""")
def batch_per_job(fx: Fixtures):
    batches = rows_per_job(sentences_to_embed(fx.sentences, fx.job_info))
    text = F.transform("rows", lambda r: F.concat_ws(":", r["type"], r["sentence_index"].cast("string"), r["sentence"]))
    return batches.select("job_id", F.size("rows").cast("long").alias("n"), F.array_join(text, "|").alias("rows"))


@check("g2_count_desc", AFFILIATE_COUNTS)
def count_desc(fx: Fixtures):
    """Largest count first, names settle ties (the order itself is covered by a unit test)."""
    return listing.count_by_affiliate(fx)


@check("g5_composite_sort", """
    SELECT job_id, type, sentence_index, sentence, row_number() OVER (PARTITION BY job_id ORDER BY type, sentence_index) AS place
    FROM sentences WHERE type <> 'title'""")
def composite_sort(fx: Fixtures):
    rows = rows_per_job(listing.without_titles(fx.sentences)).select("job_id", F.posexplode("rows").alias("at", "row"))
    return rows.select("job_id", "row.type", "row.sentence_index", "row.sentence", (F.col("at") + 1).cast("long").alias("place"))


@check("g6_first_row", "SELECT id, job_title, link FROM job_info WHERE is_active ORDER BY uploaded_date DESC, id LIMIT 1")
def first_row(fx: Fixtures):
    rows = listing.active(fx.job_info).select("id", "job_title", "link", "uploaded_date")
    return tables.first_row(rows, F.col("uploaded_date").desc(), "id").drop("uploaded_date")


@check("b13_recency_flags", f"""
    SELECT o_orderkey AS id, coalesce(CAST(nullif(o_orderdate, TIMESTAMP '2001-07-30') AS DATE) >= {DAY} - 7, false) AS uploaded_in_a_week,
           coalesce(CAST(nullif(o_orderdate, TIMESTAMP '2001-07-30') AS DATE) >= {DAY} - 1, false) AS uploaded_in_a_day FROM orders""")
def flags(fx: Fixtures):
    """One day's dates are made null: both flags must be false there."""
    day = F.nullif("o_orderdate", F.lit("2001-07-30").cast("timestamp_ntz")).cast("date")
    return fx.table("orders").select(F.col("o_orderkey").alias("id"), *recency_flags(day, as_of()))


@check("c6_active_only", "SELECT id, job_title FROM job_info WHERE is_active")
def active_only(fx: Fixtures):
    return listing.active(fx.job_info).select("id", "job_title")


@check("c7_not_title", "SELECT job_id, type, sentence_index, sentence FROM sentences WHERE type <> 'title'")
def not_title(fx: Fixtures):
    return listing.without_titles(fx.sentences)


def _facet_check(name, condition, **choice):
    @check(name, f"""
        SELECT id, company_name, affiliate_company_name, tags, uploaded_in_a_week FROM listing WHERE {condition}""", LISTING_VIEWS)
    def facet_filter(fx: Fixtures):
        jobs = listing.with_company_names(listing.active(fx.job_info), fx.companies, fx.affiliate_companies)
        tagged = listing.with_child_lists(jobs, listing.tag_arrays(fx.job_tags, fx.tags), "tags")
        flagged = tagged.select("*", *recency_flags(F.col("uploaded_date"), as_of()))
        kept = flagged.where(predicates.facet_match(**choice))
        return joined(kept, "tags").select("id", "company_name", "affiliate_company_name", "tags", "uploaded_in_a_week")


_facet_check(
    "c8_facet_filter",
    "(company_name IN ('ASIA', 'NATION_7') OR affiliate_company_name IN ('ASIA', 'NATION_7')) "
    "AND list_has_any(string_split(tags, '|'), ['Brand#2', 'Brand#11'])",
    companies=["ASIA", "NATION_7"],
    tags=["Brand#2", "Brand#11"],
)
_facet_check("c8_facet_filter_recent", "uploaded_in_a_week", companies=[], tags=[], recent_week=True)
