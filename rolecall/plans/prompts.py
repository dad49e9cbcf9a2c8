"""Prompt datasets: one row per model call, the prompt as a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecall import fixed_values as fixed
from rolecall.functions.text import fill_template
from rolecall.plans.listing import sentence_lists, with_child_lists, with_company_names
from rolecall.session import stored


def _listed(column: str) -> Column:
    return F.array_join(column, fixed.PROMPT_LIST_SEPARATOR)


def _job_values() -> dict[str, Column]:
    names = {name: F.coalesce(F.col(name), F.lit("None")) for name in ("job_title", "company_name", "team_info")}
    lists = {name: _listed(name) for name in ("responsibilities", "qualifications", "preferred_qualifications")}
    return names | lists


def rerank_prompts(matches: DataFrame, resumes: DataFrame) -> DataFrame:
    """(resume_id, prompt) for each resume with its matched postings in order of `job_number`.

    At most k postings per resume are collected.
    """
    entry = fill_template(fixed.RERANK_JOB_TEXT, job_idx=F.col("job_number"), **_job_values())
    numbered = F.array_sort(F.collect_list(F.struct("job_number", entry.alias("entry"))))
    lists = matches.groupBy("resume_id").agg(
        F.array_join(F.transform(numbered, lambda e: e["entry"]), fixed.PROMPT_JOB_SEPARATOR).alias("job_list")
    )
    prompt = fill_template(
        fixed.RERANK_TEXT,
        rerank_count=F.lit(fixed.RERANK_COUNT),
        resume_text=F.col("resume_text"),
        job_list=F.col("job_list"),
    )
    return resumes.join(lists, "resume_id").select("resume_id", prompt.alias("prompt"))


def cover_letter_prompts(wanted: DataFrame, resumes: DataFrame, store) -> DataFrame:
    """(resume_id, job_id, prompt) for each wanted (resume_id, job_id) pair.

    Only the wanted postings and their sentences are read on; the pairs are written once, as several tables are cut to them.
    """
    wanted = stored(wanted.select("resume_id", "job_id"), "wanted")
    ids = wanted.select(F.col("job_id").alias("id")).distinct()
    jobs = store.job_info.join(ids, "id", "left_semi")
    lines = store.sentences.join(ids.withColumnRenamed("id", "job_id"), "job_id", "left_semi")
    named = with_company_names(jobs, store.companies, store.affiliate_companies)
    full = with_child_lists(named, sentence_lists(lines), "qualifications", "preferred_qualifications")
    prompt = fill_template(fixed.COVER_LETTER_TEXT, resume_text=F.col("resume_text"), **_job_values())
    return (
        wanted.join(full.withColumnRenamed("id", "job_id"), "job_id")
        .join(resumes, "resume_id")
        .select("resume_id", "job_id", prompt.alias("prompt"))
    )


def summary_messages(resumes: DataFrame) -> DataFrame:
    """(resume_id, messages): the fixed system message and the resume as the user's."""
    messages = F.array(
        F.struct(F.lit("system").alias("role"), F.lit(fixed.SUMMARY_SYSTEM_TEXT).alias("content")),
        F.struct(F.lit("user").alias("role"), F.col("resume_text").alias("content")),
    )
    return resumes.select("resume_id", messages.alias("messages"))


def extraction_prompts(details: DataFrame) -> DataFrame:
    """Add `prompt` to rows with `company_name` and `detail`; a missing detail prints as `None`."""
    detail = F.coalesce(F.col("detail"), F.lit("None"))
    return details.withColumn(
        "prompt", fill_template(fixed.EXTRACTION_TEXT, company_name=F.col("company_name"), detail=detail)
    )
