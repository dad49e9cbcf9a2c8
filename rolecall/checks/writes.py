"""Checks of write semantics: merges, deletes, constraints, tagging, and the incremental stream."""

from pyspark.sql import functions as F

from rolecall import fixed_values as fixed
from rolecall.checks.fixtures import Fixtures
from rolecall.checks.parsing import q, sql_any, text_ids
from rolecall.checks.registry import check
from rolecall.operators import constraints, merge
from rolecall.operators.sentences import posting_sentences, update_vectors, upsert_means
from rolecall.operators.tagging import assign_tags, fill_job_tags
from rolecall.plans import ingest
from rolecall.plans.listing import with_company_names
from rolecall.plans.store import Store, empty_store
from rolecall.session import scratch_path
from rolecall.sources.tables import next_store, read_store, version_name, write_store
from rolecall.streaming import current
from rolecall.streaming.incremental import ingest_available

NOW = "2001-08-01 12:00:00"


def now():
    return F.lit(NOW).cast("timestamp_ntz")


# ------------------------------------------------------------------------------ dimensions


@check("i1_get_or_create_dim", """
    WITH old AS (SELECT c_custkey + 1 AS id, c_name AS name, c_nationkey AS parent_company_id
                 FROM customer WHERE c_nationkey < 5),
    new AS (SELECT c_name AS name, arg_min(c_nationkey, o_orderkey) AS parent_company_id
            FROM orders JOIN customer ON o_custkey = c_custkey
            WHERE c_name NOT IN (SELECT name FROM old) GROUP BY c_name)
    SELECT CAST(id AS INTEGER) AS id, name, parent_company_id FROM old
    UNION ALL
    SELECT CAST((SELECT max(id) FROM old) + row_number() OVER (ORDER BY substr(md5(name), 1, 3), name) AS INTEGER), name, parent_company_id FROM new""")
def get_or_create(fx: Fixtures):
    """Customers of five nations are known; those who ordered are added with the parent first seen."""
    customers = fx.table("customer").select("c_custkey", F.col("c_name").alias("name"), F.col("c_nationkey").alias("parent_company_id"))
    known = customers.where("parent_company_id < 5")
    old = known.select((F.col("c_custkey") + 1).cast("int").alias("id"), "name", "parent_company_id")
    seen = fx.table("orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    incoming = merge.first_values(seen, "name", "o_orderkey", "parent_company_id")
    return merge.get_or_create(old, incoming)


@check("i2_insert_ignore", """
    SELECT job_id, tag_id FROM job_tags UNION
    SELECT DISTINCT o_orderkey AS job_id, CAST(o_orderkey % 30 AS INTEGER) AS tag_id FROM orders""")
def insert_ignore(fx: Fixtures):
    """One more pair per order, some of them there already; each offered twice."""
    offered = fx.table("orders").select(F.col("o_orderkey").alias("job_id"), (F.col("o_orderkey") % 30).cast("int").alias("tag_id"))
    return merge.insert_ignore(fx.job_tags, offered.union(offered), ["job_id", "tag_id"])


# -------------------------------------------------------------------------------- postings


def base_and_delta(fx: Fixtures):
    """Known postings are those not in the last tenth; the batch holds every tenth posting with a new
    title, and all of the last tenth."""
    jobs = fx.job_info.withColumns({"id": F.concat(F.lit("job-"), F.col("id")), "number": F.col("id"), "created_at": F.col("updated_at")})
    fresh = F.col("number") % 10 == 9
    base = jobs.where(~fresh)
    delta = jobs.where(fresh | (F.col("number") % 10 == 0)).withColumn("job_title", F.concat(F.lit("NEW "), "job_title"))
    return base, delta


UUID = "substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-' || substr(m, 17, 4) || '-' || substr(m, 21)"
UPSERTED = {
    "upserted": f"""
        SELECT CASE WHEN id % 10 = 9 THEN {UUID} ELSE 'job-' || id END AS id,
               CASE WHEN id % 10 IN (0, 9) THEN 'NEW ' || job_title ELSE job_title END AS job_title, company_id, affiliate_company_id, link, team_info,
               array_to_string(responsibilities, '|') AS responsibilities, array_to_string(hiring_process, '|') AS hiring_process,
               array_to_string(additional_info, '|') AS additional_info, uploaded_date,
               CASE WHEN id % 10 = 9 THEN TIMESTAMP '{NOW}' ELSE updated_at END AS created_at,
               CASE WHEN id % 10 IN (0, 9) THEN TIMESTAMP '{NOW}' ELSE updated_at END AS updated_at,
               CASE WHEN id % 10 = 9 THEN true ELSE is_active END AS is_active
        FROM (SELECT *, md5(link) AS m FROM job_info)""",
}


def flat_jobs(df):
    return df.select(
        "id", "job_title", "company_id", "affiliate_company_id", "link", "team_info",
        *[F.array_join(c, "|").alias(c) for c in ("responsibilities", "hiring_process", "additional_info")],
        "uploaded_date", "created_at", "updated_at", "is_active",
    )


@check("i3_upsert_posting", "SELECT * FROM upserted", UPSERTED)
def upsert_posting(fx: Fixtures):
    base, delta = base_and_delta(fx)
    # The batch must not decide what an update keeps.
    delta = delta.withColumn("uploaded_date", F.when(F.col("number") % 10 == 0, F.lit("1999-01-01").cast("date")).otherwise(F.col("uploaded_date")))
    return flat_jobs(ingest.upsert_postings(base.drop("number"), delta.drop("number", "id", "created_at", "updated_at", "is_active"), now()))


def _parity_lines(parity):
    """Lines of a document at odd or even places, in order; the first line is the title."""
    indexed = F.transform(F.split("text", "\n"), lambda line, i: F.struct(i.alias("i"), line.alias("line")))
    return F.transform(F.filter(indexed, lambda r: (r["i"] > 0) & (r["i"] % 2 == parity)), lambda r: r["line"])


def posting_lists(fx: Fixtures):
    return fx.table("documents").select(
        F.col("doc_id").alias("job_id"),
        F.get(F.split("text", "\n"), F.lit(0)).alias("job_title"),
        _parity_lines(1).alias("qualifications"),
        _parity_lines(0).alias("preferred_qualifications"),
    )


@check("f1_sentence_index", "SELECT job_id, sentence_index, sentence FROM sentences WHERE type = 'required'")
def sentence_index(fx: Fixtures):
    lists = posting_lists(fx)
    return lists.select("job_id", F.posexplode("qualifications").alias("sentence_index", "sentence"))


@check("h2_sentence_union", "SELECT * FROM sentences")
def sentence_union(fx: Fixtures):
    return posting_sentences(posting_lists(fx))


@check("i4_replace_children", """
    SELECT job_id, CASE WHEN job_id % 4 = 0 THEN 'title' ELSE type END AS type, sentence_index,
           CASE WHEN job_id % 4 = 0 THEN 'again ' || sentence ELSE sentence END AS sentence,
           CASE WHEN job_id % 4 <> 0 THEN 1 END AS width
    FROM sentences WHERE job_id % 4 <> 0 OR type = 'title'""")
def replace_children(fx: Fixtures):
    """A quarter of the postings come again with one sentence; their vectors are gone."""
    old = fx.sentences.withColumn("embedding", F.array(F.lit(1.0).cast("float")))
    again = posting_lists(fx).where("job_id % 4 = 0").select(
        "job_id", F.lit("title").alias("type"), F.lit(0).alias("sentence_index"), F.concat(F.lit("again "), "job_title").alias("sentence")
    )
    replaced = merge.replace_children(old, again, "job_id")
    return replaced.select("job_id", "type", "sentence_index", "sentence", F.when(F.col("embedding").isNotNull(), 1).alias("width"))


@check("i5_deactivate_stale", f"""
    SELECT o_orderkey AS id, CASE WHEN o_orderkey % 50 = 0 THEN o_orderstatus = 'O'
        ELSE CASE WHEN o_orderdate + INTERVAL 12 HOUR < TIMESTAMP '{NOW}' - INTERVAL 1 DAY THEN false ELSE o_orderstatus = 'O' END END AS is_active
    FROM orders""")
def deactivate_stale(fx: Fixtures):
    """Order times at noon, so the oldest kept is exactly one day old; some times are missing."""
    noon = F.when(F.col("o_orderkey") % 50 != 0, F.col("o_orderdate") + F.expr("INTERVAL 12 HOUR"))
    jobs = fx.table("orders").select(F.col("o_orderkey").alias("id"), noon.alias("updated_at"), (F.col("o_orderstatus") == "O").alias("is_active"))
    return merge.deactivate_stale(jobs, now()).select("id", "is_active")


@check("i7_upsert_vectors", """
    SELECT CAST(coalesce(o.vec_id, n.job_id) AS BIGINT) AS job_id,
           round(CAST(CASE WHEN n.job_id IS NOT NULL THEN CAST(n.m AS FLOAT) ELSE o.embedding[1] END AS DOUBLE), 4) AS first_value
    FROM (SELECT * FROM embeddings WHERE vec_id % 3 <> 0) o
    FULL JOIN (SELECT job_id, avg(length(sentence)) AS m FROM sentences WHERE job_id % 2 = 0 GROUP BY job_id) n ON n.job_id = o.vec_id""")
def upsert_vectors(fx: Fixtures):
    """Means of new sentence vectors replace known ones or are added; others stay."""
    old = fx.job_embeddings.where("job_id % 3 <> 0")
    embedded = fx.sentences.where("job_id % 2 = 0").withColumn("embedding", F.array(F.length("sentence").cast("float")))
    means = upsert_means(old, embedded)
    return means.select("job_id", F.round(F.get("embedding", F.lit(0)).cast("double"), 4).alias("first_value"))


@check("i7_update_sentence_vectors", """
    SELECT job_id, type, sentence_index, CASE WHEN job_id % 2 = 0 THEN CAST(length(sentence) AS BIGINT) ELSE -1 END AS width FROM sentences""")
def update_sentence_vectors(fx: Fixtures):
    old = fx.sentences.withColumn("embedding", F.array(F.lit(-1).cast("float")))
    embedded = fx.sentences.where("job_id % 2 = 0").withColumn("embedding", F.array(F.length("sentence").cast("float")))
    updated = update_vectors(old, embedded.select("job_id", "type", "sentence_index", "embedding"))
    return updated.select("job_id", "type", "sentence_index", F.get("embedding", F.lit(0)).cast("long").alias("width"))


# --------------------------------------------------------------------------------- deletes


@check("i8_delete_rows", "SELECT conv_id, turn, role, text FROM conversations WHERE conv_id % 7 <> 3")
def delete_rows(fx: Fixtures):
    """History rows of some threads are purged."""
    return merge.delete_rows(fx.table("conversations"), F.col("conv_id") % 7 == 3)


SURVIVORS = """
    SELECT 'companies' AS table_name, CAST(id AS VARCHAR) AS key FROM companies WHERE id <> 2
    UNION ALL SELECT 'company_alternate_names', company_id || ':' || alternate_name FROM company_alternate_names WHERE company_id <> 2
    UNION ALL SELECT 'affiliate_companies', CAST(id AS VARCHAR) FROM affiliate_companies WHERE parent_company_id <> 2
    UNION ALL SELECT 'tags', CAST(id AS VARCHAR) FROM tags WHERE id <> 7
    UNION ALL SELECT 'job_info', CAST(id AS VARCHAR) FROM live
    UNION ALL SELECT 'sentences', job_id || ':' || type || ':' || sentence_index FROM sentences WHERE job_id NOT IN (SELECT id FROM dead)
    UNION ALL SELECT 'job_embeddings', CAST(job_id AS VARCHAR) FROM job_embeddings WHERE job_id NOT IN (SELECT id FROM dead)
    UNION ALL SELECT 'job_tags', job_id || ':' || tag_id FROM job_tags WHERE tag_id <> 7 AND job_id NOT IN (SELECT id FROM dead)"""


@check("i9_cascade_delete", SURVIVORS, {
    "dead": """SELECT id FROM job_info WHERE company_id = 2
               OR affiliate_company_id IN (SELECT id FROM affiliate_companies WHERE parent_company_id = 2)""",
    "live": "SELECT id FROM job_info WHERE id NOT IN (SELECT id FROM dead)",
})
def cascade_delete(fx: Fixtures):
    """One company and one tag go, with everything below them."""
    left = merge.cascade_delete(fx.store, companies=fx.companies.where("id = 2").select("id"), tags=fx.tags.where("id = 7").select("id"))
    keys = {
        "companies": ["id"], "company_alternate_names": ["company_id", "alternate_name"], "affiliate_companies": ["id"], "tags": ["id"],
        "job_info": ["id"], "sentences": ["job_id", "type", "sentence_index"], "job_embeddings": ["job_id"], "job_tags": ["job_id", "tag_id"],
    }
    parts = [
        df.select(F.lit(name).alias("table_name"), F.concat_ws(":", *[F.col(k).cast("string") for k in keys[name]]).alias("key"))
        for name, df in left.tables().items()
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.union(part)
    return whole


@check("i10_constraint_check", """
    SELECT 'job_info' AS table_name, 'not_null(job_title)' AS constraint_name, count(*) FILTER (id % 20 = 0) AS violations FROM job_info
    UNION ALL SELECT 'job_info', 'unique(link)', CAST(count(*) - count(DISTINCT link) AS BIGINT) FROM (SELECT CASE WHEN id % 30 = 0 THEN 'same' ELSE link END AS link FROM job_info)
    UNION ALL SELECT 'job_info', 'foreign(company_id -> companies)', count(*) FILTER (company_id = 3) FROM job_info
    UNION ALL SELECT 'affiliate_companies', 'foreign(parent_company_id -> companies)', count(*) FILTER (parent_company_id = 3) FROM affiliate_companies
    UNION ALL SELECT 'company_alternate_names', 'foreign(company_id -> companies)', count(*) FILTER (company_id = 3) FROM company_alternate_names
    UNION ALL SELECT 'sentences', 'check(type)', count(*) FILTER (type = 'title') FROM sentences
    UNION ALL SELECT 'job_embeddings', 'vector_width', 2 * count(*) FILTER (job_id % 10 = 0) FROM job_embeddings
    UNION ALL SELECT 'job_embeddings', 'unique(job_id)', count(*) FROM job_embeddings
    UNION ALL SELECT 'job_tags', 'foreign(tag_id -> tags)', count(*) FILTER (tag_id = 4) FROM job_tags""")
def constraint_check(fx: Fixtures):
    """Tables damaged on a rule: null titles, repeated links, a missing company and tag, a wrong type word, short vectors."""
    store = fx.store
    jobs = store.job_info.withColumns({
        "job_title": F.when(F.col("id") % 20 != 0, F.col("job_title")),
        "link": F.when(F.col("id") % 30 == 0, F.lit("same")).otherwise(F.col("link")),
    })
    vectors = store.job_embeddings.withColumn(
        "embedding", F.when(F.col("job_id") % 10 == 0, F.slice("embedding", 1, 5)).otherwise(F.col("embedding"))
    )
    damaged = store.with_tables(
        job_info=jobs,
        companies=store.companies.where("id <> 3"),
        tags=store.tags.where("id <> 4"),
        sentences=store.sentences.withColumn("type", F.when(F.col("type") == "title", F.lit("heading")).otherwise(F.col("type"))),
        job_embeddings=vectors.union(vectors),
    )
    return constraints.violations(damaged, width=64)


# --------------------------------------------------------------------------------- tagging


def all_words():
    return [w for _, words, pairs in fixed.TAG_RULES for w in (*words, *(p[1] for p in pairs))]


COMPANY_WORDS = ["쿠팡", "데브시스터즈", "하이퍼리즘", "네이버"]


def sql_tag_cases(title: str, company: str) -> str:
    cases = []
    for tag, words, pairs in fixed.TAG_RULES:
        tests = [sql_any(title, words)] if words else []
        tests += [f"({company} = {q(name)} AND contains({title}, {q(word)}))" for name, word in pairs]
        cases.append(f"CASE WHEN {' OR '.join(tests)} THEN {q(tag)} END")
    return f"concat_ws('|', {', '.join(cases)})"


WORD_LIST = "[" + ", ".join(q(w) for w in all_words()) + "]"
COMPANY_LIST = "[" + ", ".join(q(w) for w in COMPANY_WORDS) + "]"
TAG_TITLES = {
    "tag_titles": f"""
        SELECT id, lower(job_title || ' ' || {WORD_LIST}[1 + id % {len(all_words())}] || upper({WORD_LIST}[1 + (id * 7) % {len(all_words())}]) || ' x') AS title,
               {COMPANY_LIST}[1 + (id // 3) % 4] AS company_name
        FROM job_info""",
}


def tag_titles(fx: Fixtures):
    """Every rule word, pairs of words, and every company of a rule; one word in capitals."""
    words = F.array(*[F.lit(w) for w in all_words()])
    names = F.array(*[F.lit(w) for w in COMPANY_WORDS])
    n = len(all_words())
    title = F.concat(
        "job_title", F.lit(" "), F.element_at(words, (F.col("id") % n + 1).cast("int")),
        F.upper(F.element_at(words, ((F.col("id") * 7) % n + 1).cast("int"))), F.lit(" x"),
    )
    company = F.element_at(names, (F.floor(F.col("id") / 3) % 4 + 1).cast("int"))
    return fx.job_info.select("id", "company_id", title.alias("job_title"), company.alias("company_name"))


@check("l1_assign_tags", f"SELECT id, {sql_tag_cases('title', 'company_name')} AS tags FROM tag_titles", TAG_TITLES)
def tags_of_titles(fx: Fixtures):
    return tag_titles(fx).select("id", F.array_join(assign_tags(F.col("job_title"), F.col("company_name")), "|").alias("tags"))


@check("l1_assign_tags_text", f"""
    SELECT job_id, type, sentence_index, {sql_tag_cases('lower(sentence)', "''")} AS tags FROM sentences""")
def tags_of_lines(fx: Fixtures):
    """Free text as titles: short words hit inside longer ones."""
    return fx.sentences.select(
        "job_id", "type", "sentence_index", F.array_join(assign_tags(F.col("sentence"), F.lit(None).cast("string")), "|").alias("tags")
    )


@check("l2_tag_table_fill", f"""
    SELECT job_id, tag_id FROM job_tags UNION
    SELECT id, CAST(100 + list_position([{", ".join(q(t) for t in fixed.TAG_NAMES)}], tag) AS INTEGER)
    FROM (SELECT id, unnest(string_split({sql_tag_cases('title', "''")}, '|')) AS tag FROM tag_titles)
    WHERE tag <> '' AND tag <> 'XR'""", TAG_TITLES)
def tag_table_fill(fx: Fixtures):
    """Tags are added to those there; one tag name is missing from the tag table."""
    names = F.posexplode(F.array(*[F.lit(t) for t in fixed.TAG_NAMES])).alias("at", "name")
    tags = fx.spark.range(1).select(names).where("name <> 'XR'").select((F.col("at") + 101).cast("int").alias("id"), "name")
    jobs = tag_titles(fx).select("id", "job_title", "company_id")
    return fill_job_tags(jobs, fx.companies, tags, fx.job_tags)


# ---------------------------------------------------------------------- store files, stream


@check("a8_table_sink", "SELECT id, job_title, link, array_to_string(additional_info, '|') AS additional_info, is_active FROM job_info")
def table_sink(fx: Fixtures):
    """A store version written and read again."""
    root = scratch_path(fx.spark, "sink")
    write_store(fx.spark, text_ids(fx.store), root, version_name(1), buckets=8)
    back = read_store(fx.spark, root)
    return back.job_info.select(F.col("id").cast("long").alias("id"), "job_title", "link", F.array_join("additional_info", "|").alias("additional_info"), "is_active")


def staged(fx: Fixtures):
    """Postings as staging records: names instead of ids, one extra earlier row for every 20th link."""
    rows = with_company_names(fx.job_info, fx.companies, fx.affiliate_companies).select(
        "job_title", "company_name", "affiliate_company_name", "link", "team_info", "responsibilities",
        F.array("job_title", "link").alias("qualifications"), F.array("link").alias("preferred_qualifications"),
        "hiring_process", "additional_info", "uploaded_date",
        F.array(F.lower("company_name"), F.concat(F.lower("company_name"), F.lit(" inc"))).alias("alternate_names"),
        (F.col("id") + 1_000_000).alias("seq"), "id",
    )
    earlier = rows.where("id % 20 = 0").withColumns({
        "job_title": F.lit("early"), "uploaded_date": F.lit("1990-01-01").cast("date"), "seq": F.col("id"),
        "affiliate_company_name": F.lit("EARLY"),
    })
    return rows.unionByName(earlier)


INGESTED = """
    SELECT job_title, c.name AS company_name, ac.name AS affiliate_company_name, link, team_info,
           CASE WHEN j.id % 20 = 0 THEN DATE '1990-01-01' ELSE uploaded_date END AS uploaded_date, true AS is_active,
           'required:0:' || job_title || '|required:1:' || link || '|preferred:0:' || link || '|title:0:' || job_title AS sentences
    FROM job_info j JOIN companies c ON j.company_id = c.id JOIN affiliate_companies ac ON j.affiliate_company_id = ac.id"""


def ingested(store: Store):
    """Postings of a store in names, with their sentence rows in one text."""
    kinds = F.array_position(F.array(F.lit("required"), F.lit("preferred"), F.lit("title")), F.col("type"))
    rows = F.array_sort(F.collect_list(F.struct(kinds.alias("kind"), "sentence_index", F.concat_ws(":", "type", F.col("sentence_index").cast("string"), "sentence").alias("line"))))
    lines = store.sentences.groupBy(F.col("job_id").alias("id")).agg(F.array_join(F.transform(rows, lambda r: r["line"]), "|").alias("sentences"))
    named = with_company_names(store.job_info, store.companies, store.affiliate_companies)
    return named.join(lines, "id").select(
        "job_title", "company_name", "affiliate_company_name", "link", "team_info", "uploaded_date", "is_active", "sentences"
    )


@check("i3_apply_batch", INGESTED)
def one_batch(fx: Fixtures):
    """The whole table saved as one batch into an empty store."""

    return ingested(ingest.apply_batch(empty_store(fx.spark), staged(fx).drop("id"), now().cast("timestamp")))


@check("i3_bad_rows", f"""
    SELECT *, CAST(0 AS BIGINT) AS violations FROM ({INGESTED} WHERE j.id % 50 NOT IN (1, 2, 3))""")
def bad_rows(fx: Fixtures):
    """Rows without a company, an affiliate or a link fail alone and leave nothing behind."""
    kind = F.col("id") % 50
    damaged = staged(fx).withColumns({
        "company_name": F.when(kind != 1, F.col("company_name")), "affiliate_company_name": F.when(kind != 2, F.col("affiliate_company_name")),
        "link": F.when(kind != 3, F.col("link")),
    })
    root = scratch_path(fx.spark, "bad-rows")
    write_store(fx.spark, ingest.apply_batch(empty_store(fx.spark), damaged.drop("id"), now().cast("timestamp")), root, version_name(1), buckets=8)
    store = read_store(fx.spark, root)
    broken = constraints.violations(store, only_broken=False).agg(F.sum("violations").alias("n"))
    return ingested(store).withColumn("violations", broken.scalar())


@check("t1_incremental_ingest", INGESTED)
def incremental(fx: Fixtures):
    """The same rows landed as files and merged by the stream in several batches, with tags published in between."""

    spark = fx.spark
    landing, root, progress = (scratch_path(spark, name) for name in ("landing", "store", "progress"))
    write_store(spark, empty_store(spark), root, version_name(0), buckets=8)
    # Two runs: the earlier rows of a link land before the later ones.
    rows = staged(fx)
    for part in (rows.where("seq < 1000000"), rows.where("seq >= 1000000")):
        part.drop("id").write.mode("append").json(landing)
        store = ingest_available(spark, landing, root, progress, now().cast("timestamp"))
        tagged = ingest.tag_and_deactivate(store, now().cast("timestamp"))
        next_store(spark, root, {"tags": tagged.tags, "job_tags": tagged.job_tags})
    return ingested(read_store(spark, root))


@check("t1_state_ingest", INGESTED.replace("true AS is_active", "j.id % 7 <> 0 AS is_active"))
def by_state(fx: Fixtures):
    """The same rows with the time they were seen at, in files of any order: a seventh is not seen again after the first day."""
    spark = fx.spark
    landing, root, progress = (scratch_path(spark, name) for name in ("landing", "store", "progress"))
    write_store(spark, empty_store(spark), root, version_name(0), buckets=8)
    day = F.when(F.col("id") % 7 == 0, F.lit("2001-07-01 09:00:00")).when(F.col("seq") < 1_000_000, F.lit("2001-07-03 21:00:00")).otherwise(F.lit("2001-07-04 09:00:00"))
    rows = staged(fx).withColumn("seen_at", day.cast("timestamp"))
    # later rows of a link may land before its earlier ones
    rows.drop("id").where("seen_at < '2001-07-02'").write.mode("append").json(landing)
    current.ingest_available(spark, landing, root, progress, now().cast("timestamp"))
    rows.drop("id").where("seen_at >= '2001-07-02'").repartition(3, "seq").write.mode("append").json(landing)
    return ingested(current.ingest_available(spark, landing, root, progress, now().cast("timestamp")))
