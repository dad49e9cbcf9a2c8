"""Checks of resume texts, matching, reranking and prompt datasets."""

from pyspark.sql import functions as F

from rolecall import fixed_values as fixed
from rolecall.checks.fixtures import Fixtures
from rolecall.checks.parsing import PY_TRIM, q
from rolecall.checks.registry import check
from rolecall.checks.relational import LISTING_VIEWS, LISTS, joined
from rolecall.checks.vectors import MEANS
from rolecall.functions.text import summary_lines
from rolecall.operators.answers import parse_rerank
from rolecall.operators.knn import top_k
from rolecall.operators import substring_join as substrings
from rolecall.operators.sentences import ordered_text
from rolecall.plans import listing, matching, prompts
from rolecall.session import scratch_path
from rolecall.streaming import chunks

NAMED = {
    "variants": """
        SELECT id AS company_id, name AS name_variant FROM companies
        UNION ALL SELECT company_id, alternate_name FROM company_alternate_names""",
    "named": "SELECT DISTINCT resume_id, company_id FROM resumes JOIN variants ON contains(resume_text, name_variant)",
}


@check("d8_substring_join", "SELECT * FROM named", NAMED)
def substring_join(fx: Fixtures):
    return matching.named_experiences(fx.resumes, fx.companies, fx.company_alternate_names)


# The first lines of all texts as names: as many as texts, of every length.
FIRST_LINES = {
    "first_lines": "SELECT DISTINCT lower(string_split(text, chr(10))[1]) AS name_variant FROM documents WHERE text IS NOT NULL",
}


@check("d8_substring_join_grams", """
    SELECT resume_id, md5(name_variant) AS name FROM resumes JOIN first_lines ON contains(resume_text, name_variant)""", FIRST_LINES)
def substring_join_grams(fx: Fixtures):
    """A list as long as the texts are many."""
    lines = fx.resumes.select(F.split("resume_text", "\n")[0].alias("name_variant"))
    found = substrings.substring_join(fx.resumes, lines, "resume_id", "resume_text", "name_variant")
    return found.select("resume_id", F.md5("name_variant").alias("name"))


# --------------------------------------------------------------------------- texts and lines

# Model summaries made from the documents: every third line plain, the others as items with arrows and blanks.
SUMMARY_VIEWS = {
    "summary_lines": """
        SELECT doc_id, pos, CASE pos % 3 WHEN 0 THEN sentence WHEN 1 THEN '- a -> ' || sentence || ' -> b  ' ELSE '-  ' || sentence || chr(160) END AS line
        FROM sentence_lines WHERE doc_id % 5 <> 4""",
    "summaries": """
        SELECT doc_id AS resume_id, coalesce(string_agg(line, chr(10) ORDER BY pos), text) AS summary
        FROM documents LEFT JOIN summary_lines USING (doc_id) GROUP BY doc_id, text""",
}


def summaries(fx: Fixtures):
    """A fifth of the resumes has a summary without items."""
    def shape(line, i):
        return (
            F.when(i % 3 == 0, line)
            .when(i % 3 == 1, F.concat(F.lit("- a -> "), line, F.lit(" -> b  ")))
            .otherwise(F.concat(F.lit("-  "), line, F.lit("\xa0")))
        )

    shaped = F.array_join(F.transform(F.split("text", "\n"), shape), "\n")
    summary = F.when(F.col("doc_id") % 5 != 4, shaped).otherwise(F.col("text"))
    return fx.table("documents").select(F.col("doc_id").alias("resume_id"), summary.alias("summary"))


def sql_strip(column: str) -> str:
    return f"trim({column}, {PY_TRIM})"


LINES = f"""
    SELECT resume_id, list_transform(list_filter(string_split({sql_strip('summary')}, chr(10)),
               lambda l: {sql_strip('l')} <> '' AND starts_with(l, '- ')),
           lambda l: {sql_strip(f"replace({sql_strip(f'substr({sql_strip("l")}, 2)')}, ' -> ', ', ')")}) AS lines
    FROM summaries"""


@check("b11_summary_lines", f"SELECT resume_id, array_to_string(lines, chr(10)) AS lines FROM ({LINES})", SUMMARY_VIEWS)
def lines_of_summaries(fx: Fixtures):
    return summaries(fx).select("resume_id", F.array_join(summary_lines(F.col("summary")), "\n").alias("lines"))


@check("c10_valid_resume", f"SELECT resume_id, CAST(len(lines) AS BIGINT) AS n FROM ({LINES}) WHERE len(lines) > 0", SUMMARY_VIEWS)
def valid_resumes(fx: Fixtures):
    return matching.valid_summaries(summaries(fx)).select("resume_id", F.size("summary_sentences").cast("long").alias("n"))


@check("e12_ordered_text", """
    SELECT conv_id, lower(string_agg(text, chr(10) ORDER BY turn)) AS full_text FROM conversations GROUP BY conv_id""")
def ordered_pages(fx: Fixtures):
    """Turns as the pages of a text."""
    whole = ordered_text(fx.table("conversations"), "conv_id", "turn", "text", "\n", "full_text")
    return whole.withColumn("full_text", F.lower("full_text"))


@check("e12_token_stream", """
    SELECT conv_id, string_agg(CASE WHEN role = 'system' THEN '' ELSE text END, '' ORDER BY turn) AS summary FROM conversations GROUP BY conv_id""")
def token_stream(fx: Fixtures):
    """Turns as chunks of one answer; an end marker adds nothing."""
    chunks = fx.table("conversations").withColumn("chunk", F.when(F.col("role") != "system", F.col("text")))
    return ordered_text(chunks, "conv_id", "turn", "chunk", "", "summary")


@check("e12_streamed_answers", """
    SELECT conv_id, string_agg(CASE WHEN role = 'system' THEN '' ELSE text END, '' ORDER BY turn) AS summary, count(*) AS chunks
    FROM conversations GROUP BY conv_id HAVING max(turn) = count(*) - 1""")
def streamed_answers(fx: Fixtures):
    """Turns as chunks that land shuffled over files, a third of them twice, the last one marked as the end."""
    turns = fx.table("conversations")
    lengths = turns.groupBy("conv_id").agg(F.max("turn").alias("last"))
    rows = turns.join(lengths, "conv_id").select(
        "conv_id", F.col("turn").alias("seq"), F.when(F.col("role") != "system", F.col("text")).alias("text"), (F.col("turn") == F.col("last")).alias("is_end"),
        F.timestamp_seconds(F.lit(1_000_000_000) + F.col("conv_id") % 1000).alias("at"),
    )
    landing = chunks.land(rows.union(rows.where("(conv_id + seq) % 3 = 0")), 4, 7)
    out, progress = (scratch_path(fx.spark, n) for n in ("answers", "progress"))
    whole = chunks.assemble_available(fx.spark, landing, "conv_id long, seq long, text string, is_end boolean, at timestamp", "conv_id", out, progress)
    return whole.select("conv_id", F.col("text").alias("summary"), "chunks")


# --------------------------------------------------------------------------------- matching

MATCH_VIEWS = {
    **LISTING_VIEWS,
    **MEANS,
    **NAMED,
    "matches": """
        SELECT n.resume_id, j.*, n.similarity AS cosine_similarity,
               row_number() OVER (PARTITION BY n.resume_id ORDER BY round(n.similarity, 9) DESC, j.id) - 1 AS job_number
        FROM nearest n JOIN full_jobs j ON j.id = n.job_id
        WHERE NOT EXISTS (SELECT 1 FROM named e WHERE e.resume_id = n.resume_id AND e.company_id = j.company_id)""",
    "answers": """
        SELECT resume_id, unnest(range(12)) AS rank, (unnest(range(12)) * 7 + resume_id) % 13 AS job_idx FROM resume_vectors""",
    "reranked": """
        SELECT m.*, a.rank, 'reason ' || a.job_idx AS reason, 'title ' || a.job_idx AS rank_title
        FROM matches m JOIN answers a ON a.resume_id = m.resume_id AND a.job_idx = m.job_number""",
}


def matches(fx: Fixtures, **options):
    named = matching.named_experiences(fx.resumes, fx.companies, fx.company_alternate_names)
    return matching.match_jobs(fx.resume_vectors, fx.store, named, **options)


def answers(fx: Fixtures):
    """Model answers: a fixed permutation per resume with some indexes no posting has; text and number indexes."""
    results = F.transform(
        F.sequence(F.lit(0), F.lit(11)),
        lambda i: F.struct(
            ((i * 7 + F.col("resume_id")) % 13).cast("string").alias("job_idx"),
            F.concat(F.lit("title "), ((i * 7 + F.col("resume_id")) % 13).cast("string")).alias("job_title"),
            F.concat(F.lit("reason "), ((i * 7 + F.col("resume_id")) % 13).cast("string")).alias("reason"),
        ),
    )
    answer = F.to_json(F.struct(results.alias("results")))
    plain = F.regexp_replace(answer, r'"job_idx":"(\d+)"', r'"job_idx":$1')
    answer = F.when(F.col("resume_id") % 2 == 0, answer).otherwise(plain)
    return fx.resume_vectors.select("resume_id", answer.alias("answer"))


def shown(df, *extra):
    names = [
        "resume_id", "id", "job_title", "company_name", "affiliate_company_name", *LISTS, "is_active",
        F.round("cosine_similarity", 6).alias("cosine_similarity"), F.col("job_number").cast("long").alias("job_number"), *extra,
    ]
    return joined(df, *LISTS).select(*names)


SHOWN = (
    "resume_id, id, job_title, company_name, affiliate_company_name, " + ", ".join(LISTS)
    + ", is_active, round(cosine_similarity, 6) AS cosine_similarity, CAST(job_number AS BIGINT) AS job_number"
)


@check("j3_match_jobs", f"SELECT {SHOWN} FROM matches", MATCH_VIEWS)
def match_jobs(fx: Fixtures):
    return shown(matches(fx))


@check("d10_exclusion_anti", """
    SELECT n.resume_id, j.id FROM nearest n JOIN job_info j ON j.id = n.job_id
    WHERE NOT EXISTS (SELECT 1 FROM named e WHERE e.resume_id = n.resume_id AND e.company_id = j.company_id)""", MATCH_VIEWS)
def employers_excluded(fx: Fixtures):
    return matches(fx).select("resume_id", "id")


@check("d10_employers_kept", "SELECT n.resume_id, j.id FROM nearest n JOIN job_info j ON j.id = n.job_id", MATCH_VIEWS)
def employers_kept(fx: Fixtures):
    return matches(fx, exclude_employers=False).select("resume_id", "id")


@check("f2_job_number", "SELECT resume_id, id, CAST(job_number AS BIGINT) AS job_number FROM matches", MATCH_VIEWS)
def job_number(fx: Fixtures):
    return matches(fx).select("resume_id", "id", F.col("job_number").cast("long").alias("job_number"))


@check("d16_rank_position_join", "SELECT resume_id, id, rank, rank_title FROM reranked", MATCH_VIEWS)
def rank_positions(fx: Fixtures):
    ranked = matching.apply_rerank(matches(fx), answers(fx))
    return ranked.select("resume_id", "id", F.col("rank").cast("long").alias("rank"), "rank_title")


@check("j4_apply_rerank", f"SELECT {SHOWN}, rank, reason, rank_title FROM reranked", MATCH_VIEWS)
def apply_rerank(fx: Fixtures):
    ranked = matching.apply_rerank(matches(fx), answers(fx))
    return shown(ranked, F.col("rank").cast("long").alias("rank"), "reason", "rank_title")


@check("j4_parse_rerank", """
    SELECT resume_id, rank, CAST(job_idx AS INTEGER) AS job_idx, 'title ' || job_idx AS rank_title, 'reason ' || job_idx AS reason FROM answers""", MATCH_VIEWS)
def rerank_rows(fx: Fixtures):
    rows = parse_rerank(answers(fx))
    return rows.withColumn("rank", F.col("rank").cast("long"))


@check("b15_display_label", """
    SELECT resume_id, id, (job_number + 1) || '. ' || job_title || ' @ ' || company_name AS label,
           replace(hiring_process, '|', ' -> ') AS hiring_steps FROM reranked""", MATCH_VIEWS)
def display_labels(fx: Fixtures):
    ranked = matching.apply_rerank(matches(fx), answers(fx))
    return listing.display_label(ranked).select("resume_id", "id", "label", "hiring_steps")


# ---------------------------------------------------------------------------------- prompts


def sql_fill(template: str, **values: str) -> str:
    """SQL expression for a fixed text with columns in its `{name}` places."""
    parts = [template]
    for name, value in values.items():
        mark = "{%s}" % name
        cut = []
        for part in parts:
            if isinstance(part, tuple):
                cut.append(part)
                continue
            for n, piece in enumerate(part.split(mark)):
                if n:
                    cut.append((value,))
                cut.append(piece)
        parts = cut
    texts = [p[0] if isinstance(p, tuple) else q(p) for p in parts if p]
    return " || ".join(texts)


def sql_list(column: str) -> str:
    return f"array_to_string({column}, chr(10) || '    ')"


# Lists as lists here: texts may hold any separator.
PROMPT_VIEWS = {
    **MATCH_VIEWS,
    "real_lists": """
        SELECT job_id, coalesce(list(sentence ORDER BY sentence_index) FILTER (type = 'required'), []) AS qualifications,
               coalesce(list(sentence ORDER BY sentence_index) FILTER (type = 'preferred'), []) AS preferred_qualifications
        FROM sentences WHERE type <> 'title' GROUP BY job_id""",
    "prompt_jobs": """
        SELECT j.id, j.job_title, j.team_info, c.name AS company_name, j.responsibilities, coalesce(l.qualifications, []) AS qualifications,
               coalesce(l.preferred_qualifications, []) AS preferred_qualifications
        FROM job_info j JOIN companies c ON c.id = j.company_id LEFT JOIN real_lists l ON l.job_id = j.id""",
}
JOB_PLACES = {
    "job_title": "job_title", "company_name": "company_name", "team_info": "team_info",
    "responsibilities": sql_list("responsibilities"), "qualifications": sql_list("qualifications"),
    "preferred_qualifications": sql_list("preferred_qualifications"),
}


@check("p1_rerank_prompt", f"""
    WITH entries AS (
        SELECT m.resume_id, m.job_number, {sql_fill(fixed.RERANK_JOB_TEXT, job_idx="m.job_number", **{k: v.replace(k, "p." + k) for k, v in JOB_PLACES.items()})} AS entry
        FROM matches m JOIN prompt_jobs p ON p.id = m.id),
    lists AS (SELECT resume_id, string_agg(entry, chr(10) || chr(10) ORDER BY job_number) AS job_list FROM entries GROUP BY resume_id)
    SELECT r.resume_id, {sql_fill(fixed.RERANK_TEXT, rerank_count="'10'", resume_text="resume_text", job_list="job_list")} AS prompt
    FROM lists l JOIN resumes r ON r.resume_id = l.resume_id""", PROMPT_VIEWS)
def rerank_prompts(fx: Fixtures):
    return prompts.rerank_prompts(matches(fx), fx.resumes)


@check("p2_cover_letter_prompt", f"""
    SELECT r.resume_id, p.id AS job_id, {sql_fill(fixed.COVER_LETTER_TEXT, resume_text="resume_text", **JOB_PLACES)} AS prompt
    FROM nearest n JOIN resumes r ON r.resume_id = n.resume_id JOIN prompt_jobs p ON p.id = n.job_id WHERE n.rank <= 2""", PROMPT_VIEWS)
def cover_letter_prompts(fx: Fixtures):
    """For each resume the two closest postings."""
    wanted = top_k(fx.resume_vectors, fx.job_embeddings, 2).select("resume_id", "job_id")
    return prompts.cover_letter_prompts(wanted, fx.resumes, fx.store)


@check("p3_summary_messages", f"""
    SELECT resume_id, 'system' AS first_role, {q(fixed.SUMMARY_SYSTEM_TEXT)} AS first_content, 'user' AS second_role, resume_text AS second_content FROM resumes""")
def summary_messages(fx: Fixtures):
    two = prompts.summary_messages(fx.resumes)
    first, second = F.get("messages", F.lit(0)), F.get("messages", F.lit(1))
    return two.select(
        "resume_id", first["role"].alias("first_role"), first["content"].alias("first_content"),
        second["role"].alias("second_role"), second["content"].alias("second_content"),
    )


@check("p4_extraction_prompt", f"""
    SELECT doc_id, {sql_fill(fixed.EXTRACTION_TEXT, company_name="source", detail="CASE WHEN doc_id % 9 = 0 THEN 'None' ELSE text END")} AS prompt FROM documents""")
def extraction_prompts(fx: Fixtures):
    details = fx.table("documents").select(
        "doc_id", F.col("source").alias("company_name"), F.when(F.col("doc_id") % 9 != 0, F.col("text")).alias("detail")
    )
    return prompts.extraction_prompts(details).select("doc_id", "prompt")
