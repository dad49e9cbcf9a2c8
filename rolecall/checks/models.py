"""Checks of model batches and answer parsing; a stub that counts characters stands in for the model."""

from pyspark.sql import functions as F

from rolecall import fixed_values as fixed
from rolecall.checks.fixtures import Fixtures
from rolecall.checks.registry import check
from rolecall.operators import answers
from rolecall.operators.model_batch import embed_sentences, split_good_failed
from rolecall.operators.sentences import rows_per_job, sentences_to_embed, store_batches, vectors_from_batches


def stub_embedding(texts):
    """Vector of a text: its length and its number of blanks. A batch that starts with a `D` is refused."""
    if texts[0].startswith("D"):
        raise ValueError("refused")
    return [[float(len(t)), float(t.count(" "))] for t in texts]


STUB_VIEWS = {
    "live": "SELECT s.* FROM sentences s JOIN job_info j ON j.id = s.job_id WHERE j.is_active",
    "batches": "SELECT job_id, list(sentence ORDER BY type, sentence_index) AS texts FROM live GROUP BY job_id",
}


def run(fx: Fixtures):
    batches = rows_per_job(sentences_to_embed(fx.sentences, fx.job_info))
    return split_good_failed(embed_sentences(batches, stub_embedding, tries=2, wait_seconds=0.0))


@check("j5_model_batch", """
    SELECT l.job_id, l.type, l.sentence_index, CAST(length(l.sentence) AS BIGINT) AS width,
           CAST(length(l.sentence) - length(replace(l.sentence, ' ', '')) AS BIGINT) AS blanks
    FROM live l JOIN batches b ON b.job_id = l.job_id WHERE NOT starts_with(b.texts[1], 'D')""", STUB_VIEWS)
def model_batch(fx: Fixtures):
    good, _ = run(fx)
    vectors = vectors_from_batches(good)
    return vectors.select(
        "job_id", "type", "sentence_index",
        F.get("embedding", F.lit(0)).cast("long").alias("width"), F.get("embedding", F.lit(1)).cast("long").alias("blanks"),
    )


@check("i7_store_batches", """
    WITH done AS (
        SELECT job_id, CAST(avg(length(t)) AS FLOAT) AS mean FROM (SELECT job_id, unnest(texts) AS t, texts[1] AS head FROM batches)
        WHERE NOT starts_with(head, 'D') GROUP BY job_id)
    SELECT coalesce(o.job_id, d.job_id) AS job_id, round(CAST(coalesce(d.mean, o.embedding[1]) AS DOUBLE), 4) AS first_value
    FROM job_embeddings o FULL JOIN done d ON d.job_id = o.job_id""", STUB_VIEWS)
def stored_means(fx: Fixtures):
    """Means of freshly embedded postings beside the vectors of the others."""
    good, _ = run(fx)
    _, means = store_batches(fx.sentences.withColumn("embedding", F.lit(None).cast("array<float>")), fx.job_embeddings, good)
    return means.select("job_id", F.round(F.get("embedding", F.lit(0)).cast("double"), 4).alias("first_value"))


@check("i7_store_sentence_batches", """
    SELECT s.job_id, s.type, s.sentence_index, s.sentence, CASE WHEN j.is_active AND NOT starts_with(b.texts[1], 'D') THEN CAST(length(s.sentence) AS BIGINT) END AS width
    FROM sentences s LEFT JOIN job_info j ON j.id = s.job_id LEFT JOIN batches b ON b.job_id = s.job_id""", STUB_VIEWS)
def stored_sentences(fx: Fixtures):
    good, _ = run(fx)
    rows, _ = store_batches(fx.sentences.withColumn("embedding", F.lit(None).cast("array<float>")), fx.job_embeddings, good)
    return rows.select("job_id", "type", "sentence_index", "sentence", F.get("embedding", F.lit(0)).cast("long").alias("width"))


@check("j5_model_failures", "SELECT job_id, 'ValueError: refused' AS error FROM batches WHERE starts_with(texts[1], 'D')", STUB_VIEWS)
def model_failures(fx: Fixtures):
    _, failed = run(fx)
    return failed.select("job_id", "error")


def model_answers(fx: Fixtures):
    """JSON answers made from the documents: every 7th cut off, every 11th without findings, every 13th
    lacking a field."""
    none = F.array(F.lit(fixed.NO_CONTENT))
    blank = F.col("doc_id") % 11 == 0
    lines = F.split("text", "\n")
    answer = F.struct(
        F.when(blank, F.lit(fixed.NO_CONTENT)).otherwise(F.col("lang")).alias("team_info"),
        F.when(blank, none).otherwise(lines).alias("responsibilities"),
        F.when(blank, none).otherwise(F.array("source")).alias("qualifications"),
        F.when(blank, none).otherwise(F.array()).alias("preferred_qualifications"),
        F.when(F.col("doc_id") % 13 != 0, F.array("lang", "source")).alias("hiring_process"),
        F.array(F.lit("x")).alias("additional_info"),
    )
    text = F.to_json(answer)
    cut = F.substring(text, F.lit(1), F.length(text) - 9)
    return fx.table("documents").select("doc_id", F.when(F.col("doc_id") % 7 == 0, cut).otherwise(text).alias("answer"))


FIELDS = """doc_id, CASE WHEN doc_id % 11 = 0 THEN '해당 내용 없음' ELSE lang END AS team_info,
    CASE WHEN doc_id % 11 = 0 THEN '해당 내용 없음' ELSE text END AS responsibilities,
    CASE WHEN doc_id % 11 = 0 THEN '해당 내용 없음' ELSE source END AS qualifications,
    CASE WHEN doc_id % 11 = 0 THEN '해당 내용 없음' ELSE '' END AS preferred_qualifications,
    lang || chr(10) || source AS hiring_process, 'x' AS additional_info"""
LISTS = ("responsibilities", "qualifications", "preferred_qualifications", "hiring_process", "additional_info")


@check("j6_parse_extraction", f"SELECT {FIELDS} FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 13 <> 0")
def parse_extraction(fx: Fixtures):
    parsed = answers.parse_extraction(model_answers(fx)).where("is_usable")
    return parsed.select("doc_id", "team_info", *[F.array_join(c, "\n").alias(c) for c in LISTS])


@check("j6_unusable_answers", "SELECT doc_id FROM documents WHERE doc_id % 7 = 0 OR doc_id % 13 = 0")
def unusable_answers(fx: Fixtures):
    return answers.parse_extraction(model_answers(fx)).where("NOT is_usable").select("doc_id")


@check("c5_drop_empty_extraction", f"SELECT {FIELDS} FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 13 <> 0 AND doc_id % 11 <> 0")
def drop_empty(fx: Fixtures):
    kept = answers.usable_extractions(model_answers(fx))
    return kept.select("doc_id", "team_info", *[F.array_join(c, "\n").alias(c) for c in LISTS])
