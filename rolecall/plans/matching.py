"""Resume matching for many resumes at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rolecall import fixed_values as fixed
from rolecall.functions.predicates import is_valid_resume
from rolecall.functions.text import summary_lines
from rolecall.operators.answers import parse_rerank
from rolecall.operators.knn import TIE_DIGITS, top_k
from rolecall.operators.sentences import mean_vectors
from rolecall.operators.substring_join import substring_join
from rolecall.plans.listing import hydrate
from rolecall.session import stored


def name_variants(companies: DataFrame, alternates: DataFrame) -> DataFrame:
    """(company_id, company_name, name_variant): each company's own name and its other names."""
    base = companies.select(F.col("id").alias("company_id"), F.col("name").alias("company_name"))
    own = base.withColumn("name_variant", F.col("company_name"))
    other = base.join(alternates.withColumnRenamed("alternate_name", "name_variant"), "company_id")
    return own.unionByName(other)


def variant_arrays(companies: DataFrame, alternates: DataFrame) -> DataFrame:
    return (
        name_variants(companies, alternates)
        .groupBy("company_id", "company_name")
        .agg(F.sort_array(F.collect_list("name_variant")).alias("name_variants"))
    )


def named_experiences(resumes: DataFrame, companies: DataFrame, alternates: DataFrame) -> DataFrame:
    """(resume_id, company_id) for companies named in a resume.

    Resume texts arrive lower-cased and names are compared as written, so a name with a capital never
    matches.
    """
    variants = name_variants(companies, alternates).select("company_id", "name_variant")
    hits = substring_join(resumes, variants, "resume_id", "resume_text", "name_variant")
    return hits.join(variants, "name_variant").select("resume_id", "company_id").distinct()


def valid_summaries(resumes: DataFrame) -> DataFrame:
    """Resumes whose model `summary` has at least one line; the others get no matches."""
    with_lines = resumes.withColumn("summary_sentences", summary_lines(F.col("summary")))
    return with_lines.where(is_valid_resume(F.col("summary_sentences")))


def resume_means(line_vectors: DataFrame) -> DataFrame:
    """(resume_id, embedding): the mean of a resume's line vectors."""
    return mean_vectors(line_vectors, "resume_id")


def by_similarity(found: DataFrame) -> DataFrame:
    """Number each resume's postings from 0, most similar first."""
    order = Window.partitionBy("resume_id").orderBy(F.round("cosine_similarity", TIE_DIGITS).desc(), "id")
    return found.withColumn("job_number", F.row_number().over(order) - 1)


def match_jobs(
    resume_vectors: DataFrame,
    store,
    named: DataFrame | None = None,
    exclude_employers: bool = True,
    k: int = fixed.RETRIEVAL_COUNT,
    **search_options,
) -> DataFrame:
    """The k closest postings of each resume, with all posting fields, numbered by similarity.

    Postings of companies the resume names are left out after retrieval (`exclude_employers=False` keeps
    them). The search is written once: several tables are cut to what it found, child tables before they are aggregated.
    """
    found = stored(top_k(resume_vectors, store.job_embeddings, k, **search_options), "found")
    ids = found.select("job_id").distinct()
    jobs = store.job_info.join(ids.withColumnRenamed("job_id", "id"), "id", "left_semi")
    full = hydrate(
        jobs,
        store.with_tables(
            job_tags=store.job_tags.join(ids, "job_id", "left_semi"),
            sentences=store.sentences.join(ids, "job_id", "left_semi"),
        ),
    )
    matches = found.select("resume_id", F.col("job_id").alias("id"), F.col("similarity").alias("cosine_similarity"))
    matches = matches.join(full, "id")
    if named is not None and exclude_employers:
        matches = matches.join(named, ["resume_id", "company_id"], "left_anti")
    return by_similarity(matches)


def apply_rerank(matches: DataFrame, answers: DataFrame) -> DataFrame:
    """Matches in the order of the model's answer, with its reason and title.

    Index numbers that fit no posting are dropped.
    """
    ranked = parse_rerank(answers).withColumnRenamed("job_idx", "job_number")
    return matches.join(ranked, ["resume_id", "job_number"])


def match_resumes(
    resumes: DataFrame, line_vectors: DataFrame, store, exclude_employers: bool = True, k: int = fixed.RETRIEVAL_COUNT, **search_options
) -> DataFrame:
    """From resumes (resume_id, resume_text, summary) and their line vectors to their matches.

    Only resumes whose summary has lines are matched, by the mean of their line vectors, without postings of
    companies that their text names.
    """
    valid = valid_summaries(resumes).select("resume_id")
    vectors = resume_means(line_vectors.join(valid, "resume_id", "left_semi"))
    named = named_experiences(resumes.join(valid, "resume_id", "left_semi"), store.companies, store.company_alternate_names)
    return match_jobs(vectors, store, named, exclude_employers, k, **search_options)
