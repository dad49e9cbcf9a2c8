"""The ten sources: landed listing pages to listing rows, landed detail pages to detail rows.

`listing(source, pages, as_of)` takes (page, body) and returns (page, at, id, title,
affiliate_company_name, link, detail, uploaded_date); `detail(source, pages, as_of)` takes (link, body)
and returns (link, detail, uploaded_date). Each is one projection over an exploded page, so files are
parsed in parallel and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolecall import fixed_values as fixed
from rolecall.functions import predicates, text
from rolecall.functions.dates import DASHED, DOTTED, first_token, parse_date
from rolecall.operators.dedupe import last_wins, union_all
from rolecall.sources.pages import json_items, state_items

ITEM_SCHEMAS = {
    "naver": ("list array<struct<annoId:string,id:string,annoSubject:string,title:string,staYmdTime:string>>", "list"),
    "baemin": ("data struct<list:array<struct<recruitNumber:string,recruitName:string,recruitOpenDate:string>>>", "data.list"),
    "kakao": (
        "jobList array<struct<realId:string,jobOfferTitle:string,introduction:string,workContentDesc:string,"
        "qualification:string,jobOfferProcessDesc:string,uptDate:string>>",
        "jobList",
    ),
    "flipster": (
        "jobs array<struct<id:string,title:string,team:struct<value:string>,location:struct<value:string>>>",
        "jobs",
    ),
    "hpcnt": ("data struct<allLever:struct<nodes:array<struct<lever_id:string,text:string>>>>", "data.allLever.nodes"),
}
STATE_ITEM = "openingId string, title string, openingJobPosition struct<openingJobPositionSetting:struct<createdAt:string>>"
CARDS = {"coupang": ("div", "card-job"), "daangn": ("li", "c-deAcZv"), "line": ("li", None)}


def link(source: str, value: Column) -> Column:
    return text.fill_template(fixed.LINKS[source], id=value, path=value)


def _row(source: str, title: Column, key: Column, affiliate=None, detail=None, day=None) -> list[Column]:
    affiliate = F.lit(fixed.SOURCES[source][0]) if affiliate is None else affiliate
    return [
        key.cast("string").alias("id"),
        title.alias("title"),
        affiliate.alias("affiliate_company_name"),
        link(source, key).alias("link"),
        (F.lit(None).cast("string") if detail is None else detail).alias("detail"),
        (F.lit(None).cast("date") if day is None else day).alias("uploaded_date"),
    ]


def _naver(item: Column, as_of: Column) -> list[Column]:
    title = F.coalesce(item["annoSubject"], item["title"])
    affiliate = text.bracket_affiliate(title, fixed.SOURCES["naver"][0])
    return _row(
        "naver",
        text.bracket_title(title),
        F.coalesce(item["annoId"], item["id"]),
        text.canonical_name(affiliate, fixed.NAVER_ALIASES),
        day=parse_date(first_token(text.strip(item["staYmdTime"]), " "), DOTTED, as_of),
    )


def _baemin(item: Column, as_of: Column) -> list[Column]:
    day = parse_date(first_token(text.strip(item["recruitOpenDate"]), " "), DASHED, as_of)
    return _row("baemin", text.bracket_title(item["recruitName"]), item["recruitNumber"], day=day)


def _kakao(item: Column, as_of: Column) -> list[Column]:
    parts = [item[n] for n in ("introduction", "workContentDesc", "qualification", "jobOfferProcessDesc")]
    return _row(
        "kakao",
        item["jobOfferTitle"],
        item["realId"],
        detail=text.labelled_sections(fixed.DETAIL_LABELS, parts),
        day=parse_date(first_token(item["uptDate"], "T"), DASHED, as_of),
    )


def _flipster(item: Column, as_of: Column) -> list[Column]:
    return _row("flipster", item["title"], item["id"], day=as_of)


def _hpcnt(item: Column, as_of: Column) -> list[Column]:
    return _row("hpcnt", item["text"], item["lever_id"], day=as_of)


def _devsisters(item: Column, as_of: Column) -> list[Column]:
    created = item["openingJobPosition"]["openingJobPositionSetting"]["createdAt"]
    return _row("devsisters", item["title"], item["openingId"], day=parse_date(first_token(created, "T"), DASHED, as_of))


def _hyperithm(item: Column, as_of: Column) -> list[Column]:
    return _row("hyperithm", item["title"], item["openingId"], day=as_of)


def coupang_titles(rows: DataFrame, keep, raw: Column) -> DataFrame:
    """Add (title, affiliate_company_name) of a card heading: bracket, suffixes, bracket text, aliases, in this order."""
    affiliate = text.bracket_affiliate(raw, fixed.SOURCES["coupang"][0])
    cut = text.cut_suffixes(raw, affiliate, fixed.COUPANG_SUFFIXES, fixed.COUPANG_WORD)
    parted = text.computed_once(rows, keep, [cut["title"].alias("cut"), cut["affiliate"].alias("named")])
    title = text.bracket_title(F.col("cut")).alias("title")
    return text.computed_once(
        parted, keep, [title, text.canonical_name(F.col("named"), fixed.COUPANG_ALIASES).alias("affiliate_company_name")]
    )


def _coupang(cards: DataFrame, as_of: Column) -> DataFrame:
    heading = text.element_html(F.col("card"), "h2", "card-title", clean=False)
    headings = text.computed_once(cards, ["page", "at"], [heading.alias("heading")])
    read = text.computed_once(
        headings,
        ["page", "at"],
        [text.text_of(F.col("heading"), "", clean=False).alias("raw"), text.attribute(F.col("heading"), "a", "href").alias("path")],
    ).where("path IS NOT NULL")
    rows = coupang_titles(read, ["page", "at", "path"], F.col("raw"))
    kept = rows.where(predicates.include_exclude(F.col("title"), F.col("affiliate_company_name")))
    return kept.select("page", "at", *_row("coupang", F.col("title"), F.col("path"), F.col("affiliate_company_name")))


def _daangn(cards: DataFrame, as_of: Column) -> DataFrame:
    heading = text.text_of(text.element_html(F.col("card"), "h3", "c-boyXyq", clean=False), "", clean=False)
    path = text.attribute(F.col("card"), "a", "href")
    rows = text.computed_once(cards, ["page", "at"], [text.drop_controls(heading).alias("heading"), path.alias("path")])
    kept = rows.where(F.col("path").isNotNull() & predicates.title_has_keyword(F.col("heading")))
    return kept.select("page", "at", *_row("daangn", F.col("heading"), F.col("path")))


def _line(cards: DataFrame, as_of: Column) -> DataFrame:
    heading = text.element_html(F.col("card"), "h3", "title", clean=False)
    # The heading's own text: what is left outside of nested elements, up to the first of them.
    own = F.filter(
        F.split(F.regexp_replace(heading, r"(?is)<(\w+)\b[^>]*>.*?</\1\s*>", "\x00"), "\x00"), lambda part: part != ""
    )
    title = text.strip(text.decode_entities(F.try_element_at(own, F.lit(1))))
    day = F.substring(text.text_of(text.element_html(F.col("card"), "span", "date", clean=False), "", clean=False), 1, 10)
    tags = text.text_of(text.element_html(F.col("card"), "div", "text_filter", clean=False), "", clean=False)
    path = text.attribute(F.col("card"), "a", "href")
    read = {"heading": title, "path": path, "day": day, "tags": tags}
    rows = text.computed_once(cards, ["page", "at"], [value.alias(name) for name, value in read.items()])
    complete = F.col("path").isNotNull() & F.col("heading").isNotNull() & F.col("tags").isNotNull()
    kept = rows.where(complete & predicates.engineering_card(F.col("tags")))
    return kept.select("page", "at", *_row("line", F.col("heading"), F.col("path"), day=parse_date(F.col("day"), DASHED, as_of)))


def cards(source: str, pages: DataFrame) -> DataFrame:
    """(page, at, card): the inner HTML of each card of a listing page."""
    tag, css_class = CARDS[source]
    body = text.without_silent(F.col("body"))
    if source == "line":
        body = text.element_html(body, "ul", "job_list", clean=False)
    if source == "daangn":
        body = text.element_html(body, "ul", "c-jpGEAj", clean=False)
    found = text.elements_html(body, tag, css_class, clean=False)
    return pages.select("page", F.posexplode(found).alias("at", "card"))


_JSON = {"naver": _naver, "baemin": _baemin, "kakao": _kakao, "flipster": _flipster, "hpcnt": _hpcnt}
_CARDS = {"coupang": _coupang, "daangn": _daangn, "line": _line}


def listing(source: str, pages: DataFrame, as_of: Column) -> DataFrame:
    if source in _JSON:
        items = json_items(pages, *ITEM_SCHEMAS[source])
        item = F.col("item")
        if source == "flipster":
            items = items.where(predicates.team_and_location(item["team"]["value"], item["location"]["value"]))
        rows = items.select("page", "at", *_JSON[source](item, as_of))
        return rows.where(predicates.title_has_keyword(F.col("title"))) if source == "hpcnt" else rows
    if source in _CARDS:
        return _CARDS[source](cards(source, pages), as_of)
    items = state_items(pages, STATE_ITEM)
    item = F.col("item")
    if source == "hyperithm":
        items = items.where(item["openingJobPosition"].isNotNull())
        rows = items.select("page", F.struct("state", "at").alias("at"), *_hyperithm(item, as_of))
        return rows.where(predicates.title_has_keyword(F.col("title"), fixed.TITLE_KEYWORDS_KO))
    return items.select("page", F.struct("state", "at").alias("at"), *_devsisters(item, as_of))


def place(source: int, rows: DataFrame) -> Column:
    """Where a row stands among all listed: source, page (by its number, then its name), state, item."""
    page = F.col("page").cast("string")
    number = F.regexp_extract(page, r"(\d+)\D*$", 1).try_cast("long")
    nested = isinstance(rows.schema["at"].dataType, T.StructType)
    state, item = (F.col("at.state"), F.col("at.at")) if nested else (F.lit(0), F.col("at"))
    return F.struct(
        F.lit(source).alias("source"), number.alias("number"), page.alias("page"), state.cast("int").alias("state"), item.cast("int").alias("item")
    )


def merged_listing(pages_by_source: dict[str, DataFrame], as_of: Column) -> DataFrame:
    """Rows of all sources, one per link; a link listed again keeps its place and takes the later row."""
    parts = []
    for number, (source, pages) in enumerate(pages_by_source.items()):
        rows = listing(source, pages, as_of)
        kept = [c for c in rows.columns if c not in ("page", "at")]
        parts.append(rows.select(F.lit(source).alias("source"), *kept, place(number, rows).alias("seq")))
    return last_wins(union_all(*parts), "link", "seq")


def detail(source: str, pages: DataFrame, as_of: Column) -> DataFrame:
    """(link, detail, uploaded_date) from landed detail pages; the date is null where the page has none."""
    body = F.col("body")
    day = F.lit(None).cast("date")
    if source == "baemin":
        found = F.get_json_object(body, "$.data.recruitContents")
    else:
        found = text.element_text(body, *fixed.DETAIL_ELEMENTS[source])
    if source == "daangn":
        day = parse_date(text.last_json_ld_date(body), DASHED, as_of)
    if source == "coupang":
        table = text.element_html(body, "div", "job-table")
        day = parse_date(text.attribute(table, "time", "datetime"), DASHED, as_of)
    placeholder = fixed.NO_DETAIL if source in fixed.DETAIL_PLACEHOLDER_SOURCES else None
    return pages.select("link", text.or_placeholder(found, placeholder).alias("detail"), day.alias("uploaded_date"))
