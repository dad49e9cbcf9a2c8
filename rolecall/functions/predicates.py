"""Filters as boolean columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolecall import fixed_values as fixed
from rolecall.functions.text import has, has_any


def title_has_keyword(title: Column, exact_words=()) -> Column:
    """Any of the English words in any case, or one of `exact_words` as written."""
    return has_any(F.lower(title), fixed.TITLE_KEYWORDS) | has_any(title, exact_words)


def include_exclude(title: Column, affiliate: Column) -> Column:
    return (
        has_any(title, fixed.INCLUDE_WORDS)
        & ~has_any(title, fixed.EXCLUDE_PHRASES)
        & (affiliate != fixed.EXCLUDED_AFFILIATE)
    )


def team_and_location(team: Column, location: Column) -> Column:
    return (team == "engineering") & (location == "south-korea")


def engineering_card(tag_text: Column) -> Column:
    return has(tag_text, "Engineering") & ~has(tag_text, "Taipei")


def json_shape(text: Column) -> Column:
    """What a text of JSON is: list, object, scalar or null; broken where it is none. Null for a missing text."""
    value = F.try_parse_json(text)
    shape = (
        F.when(F.try_variant_get(value, "$", "array<variant>").isNotNull(), "list")
        .when(F.try_variant_get(value, "$", "map<string,variant>").isNotNull(), "object")
        .when(F.is_variant_null(value), "null")
        .otherwise("scalar")
    )
    return F.when(text.isNotNull(), F.when(value.isNull(), "broken").otherwise(shape))


def is_json_list(raw: Column) -> Column:
    """True for a JSON list with something in it; objects, empty lists, broken texts and nulls are skipped."""
    return F.coalesce(F.size(F.try_variant_get(F.try_parse_json(raw), "$", "array<variant>")) > 0, F.lit(False))


def nothing_extracted(team_info: Column, *lists: Column) -> Column:
    """The model found nothing: the team text and every list is exactly the one placeholder."""
    empty = team_info.eqNullSafe(F.lit(fixed.NO_CONTENT))
    for items in lists:
        empty = empty & items.eqNullSafe(F.array(F.lit(fixed.NO_CONTENT)))
    return empty


def facet_match(
    companies: list[str], tags: list[str], recent_week: bool = False, recent_day: bool = False
) -> Column:
    """The listing filter; an empty choice matches everything."""
    keep = F.lit(True)
    if companies:
        keep = keep & (F.col("company_name").isin(companies) | F.col("affiliate_company_name").isin(companies))
    if tags:
        keep = keep & F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags]))
    if recent_week:
        keep = keep & F.col("uploaded_in_a_week")
    if recent_day:
        keep = keep & F.col("uploaded_in_a_day")
    return keep


def resume_length_ok(text: Column) -> Column:
    """Between 20 and 1000 UTF-16 units: characters beyond the basic plane count twice."""
    units = F.length(text) + F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))
    return units.between(fixed.RESUME_MIN_CHARS, fixed.RESUME_MAX_CHARS)


def is_valid_resume(lines: Column) -> Column:
    return F.coalesce(F.size(lines) > 0, F.lit(False))
