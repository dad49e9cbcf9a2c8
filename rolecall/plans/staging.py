"""From landed pages to staged postings: listing rows, their details, and the model's answers brought together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecall import fixed_values as fixed
from rolecall import schemas
from rolecall.functions.text import fill_template, or_placeholder
from rolecall.operators.answers import usable_extractions
from rolecall.operators.dedupe import union_all
from rolecall.sources import sites


def fetch_link(source: Column, key: Column, link: Column) -> Column:
    """Where a posting's detail page is fetched: its link, but for the source whose pages show data of another address."""
    return F.when(source == "baemin", fill_template(fixed.BAEMIN_FETCH_LINK, id=key)).otherwise(link)


def of_source(source: Column, values: dict[str, Column]) -> Column:
    """The value that belongs to a row's source."""
    return F.coalesce(*[F.when(source == name, value) for name, value in values.items()])


def all_details(pages_by_source: dict[str, DataFrame], as_of: Column) -> DataFrame:
    """(source, fetched, page_detail, page_day) of the detail pages of all sources; one row per page address."""
    parts = [sites.detail(name, pages, as_of).select(F.lit(name).alias("source"), F.col("link").alias("fetched"), F.col("detail").alias("page_detail"), F.col("uploaded_date").alias("page_day")) for name, pages in pages_by_source.items()]
    return union_all(*parts).dropDuplicates(["source", "fetched"])


def with_details(listed: DataFrame, details: DataFrame, as_of: Column) -> DataFrame:
    """Listing rows with the detail text and date that their page has.

    A page's date goes before the listing's; without either it is the day of the run. A missing text is the
    placeholder at sources that have one.
    """
    source = F.col("source")
    rows = listed.withColumn("fetched", fetch_link(source, F.col("id"), F.col("link"))).join(details, ["source", "fetched"], "left")
    text = F.coalesce("page_detail", "detail")
    return rows.withColumns({
        "detail": F.when(source.isin(*fixed.DETAIL_PLACEHOLDER_SOURCES), or_placeholder(text)).otherwise(text),
        "uploaded_date": F.coalesce("page_day", "uploaded_date", as_of),
    }).drop("fetched", "page_detail", "page_day")


def seq_number(seq: Column) -> Column:
    """A row's place as one number: source, page, state, item."""
    parts = [F.coalesce(seq[name].cast("long"), F.lit(0).cast("long")) for name in ("source", "number", "state", "item")]
    return F.shiftleft(parts[0], 56) + F.shiftleft(parts[1], 24) + F.shiftleft(parts[2], 16) + parts[3]


def staged_postings(listed: DataFrame, answers: DataFrame) -> DataFrame:
    """Staging records (with alternate names and `seq`) of listing rows that have a usable answer in (link, answer)."""
    company = of_source(F.col("source"), {n: F.lit(name) for n, (name, _) in fixed.SOURCES.items()})
    others = of_source(F.col("source"), {n: F.array(*map(F.lit, names)) for n, (_, names) in fixed.SOURCES.items()})
    found = usable_extractions(answers.select("link", "answer").dropDuplicates(["link"]))
    rows = listed.join(found, "link").select(
        "*", F.col("title").alias("job_title"), company.alias("company_name"), others.alias("alternate_names"), seq_number(F.col("seq")).alias("place")
    )
    names = [f.name for f in schemas.STAGED_POSTING.fields]
    return rows.select(*names, "alternate_names", F.col("place").alias("seq"))


def stage(listings: dict[str, DataFrame], details: dict[str, DataFrame], answers: DataFrame, as_of: Column) -> DataFrame:
    """Staged postings of all sources from their listing pages, detail pages, and model answers by link."""
    listed = sites.merged_listing(listings, as_of)
    if details:
        listed = with_details(listed, all_details(details, as_of), as_of)
    return staged_postings(listed.withColumn("uploaded_date", F.coalesce("uploaded_date", as_of)), answers)
