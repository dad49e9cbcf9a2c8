"""Checks of sources, scalar functions and filters, over pages and titles made from the given tables.

Result pages hold 25 postings each (`id // 25`), as the real ones are of bounded size.
"""

from pyspark.sql import functions as F

from rolecall import fixed_values as fixed
from rolecall.checks.fixtures import AS_OF, Fixtures, as_of
from rolecall.checks.registry import check
from rolecall.functions import predicates, text
from rolecall.functions.dates import DASHED, DOTTED, first_token, parse_date
from rolecall.operators.dedupe import last_wins, union_all
from rolecall.sources import sites
from rolecall.sources.pages import json_items
from rolecall.session import scratch_path
from rolecall.sources.tables import read_store, to_json_rows, version_name, write_store

PAGE = 25
DAY = f"DATE '{AS_OF}'"
PY_TRIM = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || ' ' || chr(133) || chr(160) || chr(5760) || chr(8192) || chr(8193) || chr(8194) || chr(8195) || chr(8196) || chr(8197) || chr(8198) || chr(8199) || chr(8200) || chr(8201) || chr(8202) || chr(8232) || chr(8233) || chr(8239) || chr(8287) || chr(12288)"


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_any(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, {q(w)})" for w in words) + ")"


def sql_aliases(column: str, aliases: dict) -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in aliases.items())
    return f"CASE lower({column}) {whens} ELSE {column} END"


def sql_bracket(column: str, default: str) -> tuple[str, str]:
    """(affiliate, title) of a bracketed title."""
    has = f"contains({column}, ']')"
    inner = f"trim(substr({column}, 2, greatest(strpos({column}, ']') - 2, 0)))"
    rest = f"trim(split_part({column}, ']', 2))"
    return f"CASE WHEN {has} THEN {inner} ELSE {q(default)} END", f"CASE WHEN {has} THEN {rest} ELSE {column} END"


def sql_link(source: str, value: str) -> str:
    left, right = fixed.LINKS[source].replace("{path}", "{id}").split("{id}")
    return f"{q(left)} || {value} || {q(right)}"


# Titles of many shapes made from the postings: brackets with known aliases, several brackets, suffixes,
# title words, control characters.
TITLE_VIEW = {
    "titles": """
        SELECT id, company_id, uploaded_date,
               CASE id % 7
                   WHEN 0 THEN job_title
                   WHEN 1 THEN '[NAVER Cloud] ' || split_part(job_title, '] ', 2) || ' Engineer'
                   WHEN 2 THEN 'x Coupang Pay ] ' || job_title || ' [b] Developer'
                   WHEN 3 THEN '[Coupang] ' || split_part(job_title, '] ', 2) || ' Scientist — Coupang Play'
                   WHEN 4 THEN split_part(job_title, '] ', 2) || ' Eats Engineer - Coupang Pay (Seoul)'
                   WHEN 5 THEN '[Search & Discovery] ' || split_part(job_title, '] ', 2) || ' Architect (Coupang Play) UX Research'
                   ELSE split_part(job_title, '] ', 2) || chr(7) || ' 개발자 ' || CASE WHEN id % 2 = 0 THEN 'developer' ELSE 'Research' || chr(127) END
               END AS title
        FROM job_info""",
}


def titles(fx: Fixtures):
    name = F.split_part("job_title", F.lit("] "), F.lit(2))
    title = (
        F.when(F.col("id") % 7 == 0, F.col("job_title"))
        .when(F.col("id") % 7 == 1, F.concat(F.lit("[NAVER Cloud] "), name, F.lit(" Engineer")))
        .when(F.col("id") % 7 == 2, F.concat(F.lit("x Coupang Pay ] "), "job_title", F.lit(" [b] Developer")))
        .when(F.col("id") % 7 == 3, F.concat(F.lit("[Coupang] "), name, F.lit(" Scientist — Coupang Play")))
        .when(F.col("id") % 7 == 4, F.concat(name, F.lit(" Eats Engineer - Coupang Pay (Seoul)")))
        .when(F.col("id") % 7 == 5, F.concat(F.lit("[Search & Discovery] "), name, F.lit(" Architect (Coupang Play) UX Research")))
        .otherwise(
            F.concat(name, F.lit("\x07 개발자 "), F.when(F.col("id") % 2 == 0, F.lit("developer")).otherwise(F.lit("Research\x7f")))
        )
    )
    return fx.job_info.select("id", "company_id", "uploaded_date", title.alias("title"))


def json_pages(rows, key, item, wrap):
    """Pack items into result pages of 25; `wrap` puts the list where the source has it."""
    pages = rows.groupBy(F.floor(F.col(key) / PAGE).alias("page")).agg(F.collect_list(item).alias("items"))
    return pages.select("page", F.to_json(wrap(F.col("items"))).alias("body"))


def html_pages(rows, key, card, before="", after=""):
    pages = rows.groupBy(F.floor(F.col(key) / PAGE).alias("page")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), card.alias("card")))), lambda c: c["card"]), "").alias("cards")
    )
    return pages.select("page", F.concat(F.lit(f"<html><body>{before}"), "cards", F.lit(f"{after}</body></html>")).alias("body"))


def listed(rows):
    return rows.select("id", "title", "affiliate_company_name", "link", "detail", "uploaded_date")


# --------------------------------------------------------------------------------------- scans


@check("a1_json_page_scan", """
    SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events""")
def json_page_scan(fx: Fixtures):
    """Events packed 25 to a page under a nested path, scanned back."""
    item = F.struct("event_id", "event_type", F.from_json("props", "k int").alias("props"))
    pages = json_pages(fx.table("events"), "event_id", item, lambda items: F.struct(F.struct(items.alias("list")).alias("data")))
    schema = "data struct<list:array<struct<event_id:bigint,event_type:string,props:struct<k:int>>>>"
    return json_items(pages, schema, "data.list").select("item.event_id", "item.event_type", F.col("item.props.k").alias("k"))


_naver = sql_bracket("title", "네이버")


@check("a1_naver_listing", f"""
    WITH cut AS (SELECT id, {_naver[0]} AS affiliate, {_naver[1]} AS title, uploaded_date FROM titles)
    SELECT CAST(id AS VARCHAR) AS id, title, {sql_aliases("affiliate", fixed.NAVER_ALIASES)} AS affiliate_company_name,
           {sql_link("naver", "id")} AS link, CAST(NULL AS VARCHAR) AS detail,
           CASE WHEN id % 11 = 0 THEN {DAY} ELSE uploaded_date END AS uploaded_date FROM cut""", TITLE_VIEW)
def naver_listing(fx: Fixtures):
    """Two field spellings, and some rows without a start time."""
    odd = F.col("id") % 2 == 1
    item = F.struct(
        F.when(odd, F.col("id")).alias("annoId"),
        F.when(~odd, F.col("id")).alias("id"),
        F.when(odd, F.col("title")).alias("annoSubject"),
        F.when(~odd, F.col("title")).alias("title"),
        F.when(F.col("id") % 11 != 0, F.concat(F.date_format("uploaded_date", "yyyy.MM.dd"), F.lit(" 10:00:00"))).alias("staYmdTime"),
    )
    pages = json_pages(titles(fx), "id", item, lambda items: F.struct(items.alias("list")))
    return listed(sites.listing("naver", pages, as_of()))


@check("a1_baemin_listing", f"""
    SELECT CAST(id AS VARCHAR) AS id, {sql_bracket("title", "")[1]} AS title, '우아한형제들' AS affiliate_company_name,
           {sql_link("baemin", "id")} AS link, CAST(NULL AS VARCHAR) AS detail, uploaded_date FROM titles""", TITLE_VIEW)
def baemin_listing(fx: Fixtures):
    day = F.concat(F.date_format("uploaded_date", "yyyy-MM-dd"), F.lit(" 00:00:00"))
    item = F.struct(F.col("id").alias("recruitNumber"), F.col("title").alias("recruitName"), day.alias("recruitOpenDate"))
    pages = json_pages(titles(fx), "id", item, lambda items: F.struct(F.struct(items.alias("list")).alias("data")))
    return listed(sites.listing("baemin", pages, as_of()))


@check("a1_kakao_listing", f"""
    SELECT CAST(id AS VARCHAR) AS id, title, '카카오' AS affiliate_company_name, {sql_link("kakao", "id")} AS link,
           '조직소개' || chr(10) || title || chr(10) || chr(10) || '업무내용' || chr(10) || coalesce(CASE WHEN id % 5 > 0 THEN title END, 'None')
           || chr(10) || chr(10) || '지원자격' || chr(10) || company_id || chr(10) || chr(10) || '채용절차' || chr(10) || 'a' AS detail, uploaded_date FROM titles""", TITLE_VIEW)
def kakao_listing(fx: Fixtures):
    item = F.struct(
        F.col("id").alias("realId"),
        F.col("title").alias("jobOfferTitle"),
        F.col("title").alias("introduction"),
        F.when(F.col("id") % 5 > 0, F.col("title")).alias("workContentDesc"),
        F.col("company_id").alias("qualification"),
        F.lit("a").alias("jobOfferProcessDesc"),
        F.date_format("uploaded_date", "yyyy-MM-dd'T'HH:mm:ss").alias("uptDate"),
    )
    pages = json_pages(titles(fx), "id", item, lambda items: F.struct(items.alias("jobList")))
    return listed(sites.listing("kakao", pages, as_of()))


@check("a1_flipster_listing", f"""
    SELECT CAST(id AS VARCHAR) AS id, title, '플립스터' AS affiliate_company_name, {sql_link("flipster", "id")} AS link,
           CAST(NULL AS VARCHAR) AS detail, {DAY} AS uploaded_date FROM titles WHERE company_id = 2 AND id % 3 <> 1""", TITLE_VIEW)
def flipster_listing(fx: Fixtures):
    team = F.when(F.col("company_id") == 2, F.lit("engineering")).otherwise(F.lit("sales"))
    place = F.when(F.col("id") % 3 == 1, F.lit("japan")).otherwise(F.lit("south-korea"))
    item = F.struct("id", "title", F.struct(team.alias("value")).alias("team"), F.struct(place.alias("value")).alias("location"))
    pages = json_pages(titles(fx), "id", item, lambda items: F.struct(items.alias("jobs")))
    return listed(sites.listing("flipster", pages, as_of()))


@check("a1_hpcnt_listing", f"""
    SELECT CAST(id AS VARCHAR) AS id, title, '하이퍼커넥트' AS affiliate_company_name, {sql_link("hpcnt", "id")} AS link,
           CAST(NULL AS VARCHAR) AS detail, {DAY} AS uploaded_date FROM titles WHERE {sql_any("lower(title)", fixed.TITLE_KEYWORDS)}""", TITLE_VIEW)
def hpcnt_listing(fx: Fixtures):
    item = F.struct(F.col("id").alias("lever_id"), F.col("title").alias("text"))
    pages = json_pages(
        titles(fx), "id", item, lambda items: F.struct(F.struct(F.struct(items.alias("nodes")).alias("allLever")).alias("data"))
    )
    return listed(sites.listing("hpcnt", pages, as_of()))


def state_pages(fx: Fixtures):
    """Pages whose embedded JSON mixes list states (two per page), an object, an empty list and a null."""
    rows = titles(fx)
    # Every third item has no position field.
    position = F.when(
        F.col("id") % 3 != 0,
        F.struct(F.struct(F.date_format("uploaded_date", "yyyy-MM-dd'T'HH:mm:ss").alias("createdAt")).alias("openingJobPositionSetting")),
    )
    item = F.to_json(F.struct(F.col("id").alias("openingId"), "title", position.alias("openingJobPosition")))
    halves = rows.groupBy(F.floor(F.col("id") / 10).alias("page"), (F.col("id") % 2).alias("half")).agg(
        F.concat(F.lit('{"state":{"data":['), F.array_join(F.collect_list(item), ","), F.lit("]}}")).alias("state")
    )
    pages = halves.groupBy("page").agg(F.array_join(F.array_sort(F.collect_list("state")), ",").alias("states"))
    others = '{"state":{"data":{"openingId":1,"title":"object"}}},{"state":{"data":[]}},{"state":{"data":null}},{"state":{}}'
    return pages.select(
        "page",
        F.concat(
            F.lit('<html><script src="a.js"></script><script id="__NEXT_DATA__" type="application/json">'),
            F.lit('{"props":{"pageProps":{"dehydratedState":{"queries":['),
            "states",
            F.lit(f",{others}]}}}}}}}}</script><p>x</p></html>"),
        ).alias("body"),
    )


@check("a2_embedded_json_scan", f"""
    SELECT CAST(id AS VARCHAR) AS id, title, '데브시스터즈' AS affiliate_company_name, {sql_link("devsisters", "id")} AS link,
           CAST(NULL AS VARCHAR) AS detail, CASE WHEN id % 3 = 0 THEN {DAY} ELSE uploaded_date END AS uploaded_date FROM titles""", TITLE_VIEW)
def embedded_json_scan(fx: Fixtures):
    return listed(sites.listing("devsisters", state_pages(fx), as_of()))


@check("c4_shape_filter", f"""
    SELECT CAST(id AS VARCHAR) AS id, title, '하이퍼리즘' AS affiliate_company_name, {sql_link("hyperithm", "id")} AS link,
           CAST(NULL AS VARCHAR) AS detail, {DAY} AS uploaded_date FROM titles
    WHERE id % 3 <> 0 AND ({sql_any("lower(title)", fixed.TITLE_KEYWORDS)} OR {sql_any("title", fixed.TITLE_KEYWORDS_KO)})""", TITLE_VIEW)
def shape_filter(fx: Fixtures):
    """List-valued states only, items with the position field only, then the source's title words."""
    return listed(sites.listing("hyperithm", state_pages(fx), as_of()))


@check("c4_json_shapes", """
    SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'object' WHEN 1 THEN 'list' WHEN 2 THEN 'list' WHEN 3 THEN 'scalar' WHEN 4 THEN 'null'
        WHEN 5 THEN 'broken' WHEN 6 THEN 'scalar' END AS shape FROM events""")
def json_shapes(fx: Fixtures):
    """Every event's properties as they are, in a list, in an empty list, as a text, null, cut off, as a number, and missing."""
    props, kind = F.col("props"), F.col("event_id") % 8
    body = (
        F.when(kind == 0, props).when(kind == 1, F.concat(F.lit(" ["), props, F.lit(", 1]"))).when(kind == 2, F.lit("[]"))
        .when(kind == 3, F.concat(F.lit('"'), "event_type", F.lit('"'))).when(kind == 4, F.lit("null")).when(kind == 5, F.concat(F.lit("["), props)).when(kind == 6, F.lit("3.5"))
    )
    return fx.table("events").select("event_id", predicates.json_shape(body).alias("shape"))


@check("a3_json_ld_date", """
    SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN NULL
        WHEN o_orderkey % 4 = 1 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%d') END AS posted
    FROM orders""")
def json_ld_date(fx: Fixtures):
    """None, one, or two scripts (the last non-empty one counts); an empty date and another type in between."""
    def script(day):
        return F.concat(F.lit('<script type="application/ld+json">{"@type":"JobPosting","datePosted":"'), day, F.lit('"}</script>'))

    first = script(F.date_format("o_orderdate", "yyyy-MM-dd"))
    second = script(F.date_format(F.date_add("o_orderdate", 1), "yyyy-MM-dd"))
    rest = F.lit('<script type="application/ld+json">{"datePosted":""}</script><script>{"datePosted":"1900-01-01"}</script>')
    kind = F.col("o_orderkey") % 4
    body = F.when(kind == 0, rest).when(kind == 1, F.concat(first, rest)).otherwise(F.concat(first, F.lit("<p>x</p>"), second, rest))
    return fx.table("orders").select(F.col("o_orderkey").alias("id"), text.last_json_ld_date(body).alias("posted"))


@check("a4_html_item_scan", r"""
    WITH items AS (
        SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>', '', 'g'),
                                                  '(?s)<li[^>]*>(.*?)</li>', 1)) AS card
        FROM pages)
    SELECT page_id, regexp_extract(card, 'href="([^"]*)"', 1) AS path,
           trim(replace(regexp_replace(card, '<[^>]*>', '', 'g'), '&amp;', '&')) AS title
    FROM items WHERE contains(card, 'href="')""")
def html_item_scan(fx: Fixtures):
    cards = fx.table("pages").select("page_id", F.explode(text.elements_html(F.col("html"), "li")).alias("card"))
    read = cards.select(
        "page_id", text.attribute(F.col("card"), "a", "href").alias("path"), text.text_of(F.col("card"), "").alias("title")
    )
    return read.where("path IS NOT NULL")


COUPANG_VIEWS = {
    **TITLE_VIEW,
    "c0": f"SELECT id, trim(title) AS title, {sql_bracket('trim(title)', '쿠팡')[0]} AS affiliate FROM titles",
}
_previous = "c0"
for _i, (_suffix, _name) in enumerate(fixed.COUPANG_SUFFIXES, 1):
    COUPANG_VIEWS[f"c{_i}"] = (
        f"SELECT id, CASE WHEN contains(title, {q(_suffix)}) THEN trim(split_part(title, {q(_suffix)}, 1)) ELSE title END AS title, "
        f"CASE WHEN contains(title, {q(_suffix)}) THEN {q(_name)} ELSE affiliate END AS affiliate FROM {_previous}"
    )
    _previous = f"c{_i}"
COUPANG_VIEWS["coupang_rows"] = f"""
    SELECT id, {sql_bracket("title", "")[1]} AS title, {sql_aliases("affiliate", fixed.COUPANG_ALIASES)} AS affiliate_company_name
    FROM (SELECT id, title, CASE WHEN contains(title, 'Eats') THEN '쿠팡이츠' ELSE affiliate END AS affiliate FROM {_previous})"""
_kept = (
    f"{sql_any('title', fixed.INCLUDE_WORDS)} AND NOT {sql_any('title', fixed.EXCLUDE_PHRASES)} "
    f"AND affiliate_company_name <> {q(fixed.EXCLUDED_AFFILIATE)}"
)


def escaped(column):
    return F.replace(F.replace(column, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def path_of(key="id"):
    return F.concat(F.lit("/jobs/"), F.col(key).cast("string"))


@check("a4_coupang_listing", f"""
    SELECT '/jobs/' || id AS id, title, affiliate_company_name, {sql_link("coupang", "'/jobs/' || id")} AS link,
           CAST(NULL AS VARCHAR) AS detail, CAST(NULL AS DATE) AS uploaded_date
    FROM coupang_rows WHERE id % 13 <> 0 AND {_kept}""", COUPANG_VIEWS)
def coupang_listing(fx: Fixtures):
    """Cards with nested blocks; every 13th has no link in its heading."""
    inside = F.when(
        F.col("id") % 13 != 0, F.concat(F.lit('<a class="x" href="'), path_of(), F.lit('">'), escaped(F.col("title")), F.lit("</a>"))
    ).otherwise(escaped(F.col("title")))
    card = F.concat(
        F.lit('<div class="card card-job"><div class="badge"><div>new</div></div><h2 class="card-title">'), inside,
        F.lit('</h2><a href="/other">more</a></div>'),
    )
    pages = html_pages(titles(fx), "id", card, '<div id="js-job-search-results">', "</div>")
    return listed(sites.listing("coupang", pages, as_of()))


@check("a4_daangn_listing", f"""
    SELECT '/jobs/' || id AS id, regexp_replace(trim(title), '[\\x00-\\x1F\\x7F]', '', 'g') AS title, '당근' AS affiliate_company_name,
           {sql_link("daangn", "'/jobs/' || id")} AS link, CAST(NULL AS VARCHAR) AS detail, CAST(NULL AS DATE) AS uploaded_date
    FROM titles WHERE id % 13 <> 0 AND {sql_any("lower(title)", fixed.TITLE_KEYWORDS)}""", TITLE_VIEW)
def daangn_listing(fx: Fixtures):
    heading = F.concat(F.lit('<h3 class="c-boyXyq">'), escaped(F.col("title")), F.lit("</h3>"))
    linked = F.concat(F.lit('<a href="'), path_of(), F.lit('">'), heading, F.lit("</a>"))
    card = F.concat(F.lit('<li class="c-deAcZv">'), F.when(F.col("id") % 13 != 0, linked).otherwise(heading), F.lit("</li>"))
    pages = html_pages(titles(fx), "id", card, '<ul class="nav"><li class="c-deAcZv">menu</li></ul><ul class="c-jpGEAj">', "</ul>")
    return listed(sites.listing("daangn", pages, as_of()))


@check("a4_line_listing", f"""
    SELECT '/jobs/' || id AS id, trim(title) AS title, '라인플러스' AS affiliate_company_name, {sql_link("line", "'/jobs/' || id")} AS link,
           CAST(NULL AS VARCHAR) AS detail, uploaded_date FROM titles WHERE id % 3 <> 0 AND company_id <> 4""", TITLE_VIEW)
def line_listing(fx: Fixtures):
    """Headings with a nested mark, tag texts of three kinds, some cards without tags."""
    tags = F.when(F.col("id") % 3 == 0, F.lit("<span>Engineering</span> Taipei")).otherwise(F.lit("<span>Seoul</span><span>Engineering</span>"))
    card = F.concat(
        F.lit('<li><a href="'), path_of(), F.lit('"><h3 class="title">'), escaped(F.col("title")), F.lit("<em>new</em>later</h3>"),
        F.lit('<span class="date">'), F.date_format("uploaded_date", "yyyy-MM-dd"), F.lit(" ~ open</span>"),
        F.when(F.col("company_id") != 4, F.concat(F.lit('<div class="text_filter">'), tags, F.lit("</div>"))).otherwise(F.lit("")),
        F.lit("</a></li>"),
    )
    pages = html_pages(titles(fx), "id", card, '<ul class="job_list">', "</ul>")
    return listed(sites.listing("line", pages, as_of()))


ARTICLE_TEXT = r"""
    SELECT page_id, list_filter(list_transform(
               regexp_split_to_array(regexp_extract(regexp_replace(html, '(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>', '', 'g'),
                                                    '(?s)<article[^>]*>(.*?)</article>', 1), '(?s)<[/A-Za-z][^>]*>'),
               lambda t: trim(replace(replace(replace(replace(t, '&middot;', '·'), '&copy;', '©'), '&quot;', '"'), '&amp;', '&'), """ + PY_TRIM + r""")),
               lambda t: t <> '') AS nodes
    FROM pages"""


@check("a5_html_detail_text", f"SELECT page_id, array_to_string(nodes, chr(10)) AS detail FROM ({ARTICLE_TEXT})")
def html_detail_text(fx: Fixtures):
    return fx.table("pages").select("page_id", text.element_text(F.col("html"), "article").alias("detail"))


@check("b10_missing_text", f"""
    SELECT page_id, CASE WHEN page_id % 3 = 0 OR len(nodes) = 0 THEN '상세 내용 없음' ELSE array_to_string(nodes, chr(10)) END AS with_placeholder,
           CASE WHEN page_id % 3 <> 0 AND len(nodes) > 0 THEN array_to_string(nodes, chr(10)) END AS without_placeholder
    FROM ({ARTICLE_TEXT})""")
def missing_text(fx: Fixtures):
    """A third of the pages look for a container they lack."""
    found = F.when(F.col("page_id") % 3 == 0, text.element_text(F.col("html"), "section", None, "jobs-contents")).otherwise(
        text.element_text(F.col("html"), "article")
    )
    return fx.table("pages").select(
        "page_id", text.or_placeholder(found).alias("with_placeholder"), text.or_placeholder(found, None).alias("without_placeholder")
    )


@check("a6_attribute_date", f"""
    SELECT 'u' || o_orderkey AS link, 'Text' || chr(10) || 'a & b' || chr(10) || 'end' AS detail,
           CASE WHEN o_orderkey % 3 = 0 THEN {DAY} ELSE CAST(o_orderdate AS DATE) END AS uploaded_date
    FROM orders""")
def attribute_date(fx: Fixtures):
    """Detail pages with nested containers and a time element with or without its attribute."""
    stamp = F.when(F.col("o_orderkey") % 3 == 0, F.lit("<time>soon</time>")).otherwise(
        F.concat(F.lit('<time class="t" datetime="'), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit('">x</time>'))
    )
    body = F.concat(
        F.lit('<div class="job-table"><div>Posted</div>'), stamp,
        F.lit('</div><article class="a cms-content"><b>Text</b><article> a &amp; b </article><script>"</article>"</script><p>end</p></article> tail'),
    )
    pages = fx.table("orders").select(F.concat(F.lit("u"), "o_orderkey").alias("link"), body.alias("body"))
    return sites.detail("coupang", pages, as_of())


@check("a9_json_sink", """
    SELECT id, job_title, team_info, responsibilities[1] AS first_item, uploaded_date,
           is_active FROM job_info""")
def json_sink(fx: Fixtures):
    """Each posting dumped to one JSON object and parsed again."""
    dumped = to_json_rows(fx.job_info.select("id", "job_title", "team_info", "responsibilities", "uploaded_date", "is_active"))
    parsed = F.from_json("json", "id bigint, job_title string, team_info string, responsibilities array<string>, uploaded_date date, is_active boolean")
    return dumped.select(parsed.alias("r")).select(
        "r.id", "r.job_title", "r.team_info", F.get("r.responsibilities", F.lit(0)).alias("first_item"), "r.uploaded_date", "r.is_active"
    )


STORE_KEYS = {
    "companies": "id", "company_alternate_names": "company_id", "affiliate_companies": "id", "tags": "id", "job_info": "id",
    "sentences": "job_id", "job_embeddings": "job_id", "job_tags": "job_id",
}


@check("a7_table_scan", " UNION ALL ".join(
    f"SELECT '{name}' AS table_name, count(*) AS n_rows, count(DISTINCT {key}) AS n_keys, CAST(sum(CAST({key} AS BIGINT)) AS BIGINT) AS key_sum FROM {name}"
    for name, key in STORE_KEYS.items()))
def table_scan(fx: Fixtures):
    """All eight tables written as a store version and scanned with their own schemas."""
    root = scratch_path(fx.spark, "scan")
    write_store(fx.spark, text_ids(fx.store), root, version_name(1), buckets=8)
    parts = [
        df.agg(F.count("*").alias("n_rows"), F.countDistinct(STORE_KEYS[name]).alias("n_keys"), F.sum(F.col(STORE_KEYS[name]).cast("long")).alias("key_sum"))
        .select(F.lit(name).alias("table_name"), "n_rows", "n_keys", "key_sum")
        for name, df in read_store(fx.spark, root).tables().items()
    ]
    return union_all(*parts)


def text_ids(store):
    """The fixture store with the types that stored tables have."""
    job_info = store.job_info.withColumns({
        "id": F.col("id").cast("string"), "created_at": F.col("updated_at").cast("timestamp"), "updated_at": F.col("updated_at").cast("timestamp"),
    })
    return store.with_tables(
        job_info=job_info,
        sentences=store.sentences.withColumns({"job_id": F.col("job_id").cast("string"), "embedding": F.lit(None).cast("array<float>")}),
        job_embeddings=store.job_embeddings.withColumn("job_id", F.col("job_id").cast("string")),
        job_tags=store.job_tags.withColumn("job_id", F.col("job_id").cast("string")),
    )


# ------------------------------------------------------------------------------------- scalars

_bracket = sql_bracket("title", "기본")


@check("b1_bracket_affiliate", f"SELECT id, {_bracket[0]} AS affiliate FROM titles", TITLE_VIEW)
def bracket_affiliate(fx: Fixtures):
    return titles(fx).select("id", text.bracket_affiliate(F.col("title"), "기본").alias("affiliate"))


@check("b2_bracket_strip", f"SELECT id, {_bracket[1]} AS title FROM titles", TITLE_VIEW)
def bracket_strip(fx: Fixtures):
    return titles(fx).select("id", text.bracket_title(F.col("title")).alias("title"))


@check("b3_alias_normalise", f"""
    SELECT id, {sql_aliases("affiliate", fixed.NAVER_ALIASES)} AS naver, {sql_aliases("affiliate", fixed.COUPANG_ALIASES)} AS coupang
    FROM (SELECT id, {_bracket[0]} AS affiliate FROM titles)""", TITLE_VIEW)
def alias_normalise(fx: Fixtures):
    affiliate = text.bracket_affiliate(F.col("title"), "기본")
    return titles(fx).select(
        "id",
        text.canonical_name(affiliate, fixed.NAVER_ALIASES).alias("naver"),
        text.canonical_name(affiliate, fixed.COUPANG_ALIASES).alias("coupang"),
    )


@check("b4_suffix_affiliate", "SELECT * FROM coupang_rows", COUPANG_VIEWS)
def suffix_affiliate(fx: Fixtures):
    return sites.coupang_titles(titles(fx), ["id"], text.strip(F.col("title")))


@check("b5_strip_control", "SELECT id, regexp_replace(title, '[\\x00-\\x1F\\x7F]', '', 'g') AS title FROM titles", TITLE_VIEW)
def strip_control(fx: Fixtures):
    return titles(fx).select("id", text.drop_controls(F.col("title")).alias("title"))


@check("b6_build_link", "SELECT id, " + ", ".join(f"{sql_link(s, 'id')} AS {s}" for s in fixed.LINKS) + " FROM job_info")
def build_link(fx: Fixtures):
    return fx.job_info.select("id", *[sites.link(s, F.col("id").cast("string")).alias(s) for s in fixed.LINKS])


@check("b7_parse_date", f"""
    SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 IN (3, 4, 5) THEN {DAY} ELSE CAST(o_orderdate AS DATE) END AS parsed FROM orders""")
def parse_dates(fx: Fixtures):
    """Both formats with a time behind, one cut at ten characters; missing, malformed and impossible dates."""
    dotted, dashed = F.date_format("o_orderdate", "yyyy.MM.dd"), F.date_format("o_orderdate", "yyyy-MM-dd")
    kind = F.col("o_orderkey") % 6
    parsed = (
        F.when(kind == 0, parse_date(first_token(F.concat(dotted, F.lit(" 09:00")), " "), DOTTED, as_of()))
        .when(kind == 1, parse_date(first_token(F.concat(dashed, F.lit("T09:00Z")), "T"), DASHED, as_of()))
        .when(kind == 2, parse_date(F.substring(F.concat(dashed, F.lit(" ~")), 1, 10), DASHED, as_of()))
        .when(kind == 3, parse_date(F.lit(None).cast("string"), DASHED, as_of()))
        .when(kind == 4, parse_date(F.concat(F.lit("x"), dashed), DASHED, as_of()))
        .otherwise(parse_date(F.lit("2001-02-30"), DASHED, as_of()))
    )
    return fx.table("orders").select(F.col("o_orderkey").alias("id"), parsed.alias("parsed"))


@check("b8_field_fallback", "SELECT event_id, coalesce(nullif(event_type, 'click'), 'event ' || event_id) AS title FROM events")
def field_fallback(fx: Fixtures):
    first, second = F.nullif("event_type", F.lit("click")), F.concat(F.lit("event "), "event_id")
    return fx.table("events").select("event_id", F.coalesce(first, second).alias("title"))


@check("b9_detail_concat", """
    SELECT p_partkey, '조직소개' || chr(10) || p_name || chr(10) || chr(10) || '업무내용' || chr(10) || coalesce(nullif(p_brand, 'Brand#2'), 'None')
        || chr(10) || chr(10) || '지원자격' || chr(10) || p_type || chr(10) || chr(10) || '채용절차' || chr(10) || p_size AS detail FROM part""")
def detail_concat(fx: Fixtures):
    parts = [F.col("p_name"), F.nullif("p_brand", F.lit("Brand#2")), F.col("p_type"), F.col("p_size")]
    return fx.table("part").select("p_partkey", text.labelled_sections(fixed.DETAIL_LABELS, parts).alias("detail"))


@check("b12_lowercase", "SELECT doc_id AS resume_id, lower(text) AS resume_text FROM documents")
def lowercase(fx: Fixtures):
    return fx.resumes


# ------------------------------------------------------------------------------------- filters


@check("c1_title_keywords", f"""
    SELECT id, {sql_any("lower(title)", fixed.TITLE_KEYWORDS)} AS english,
           {sql_any("lower(title)", fixed.TITLE_KEYWORDS)} OR {sql_any("title", fixed.TITLE_KEYWORDS_KO)} AS both_kinds FROM titles""", TITLE_VIEW)
def title_keywords(fx: Fixtures):
    title = F.col("title")
    return titles(fx).select(
        "id",
        predicates.title_has_keyword(title).alias("english"),
        predicates.title_has_keyword(title, fixed.TITLE_KEYWORDS_KO).alias("both_kinds"),
    )


@check("c2_include_exclude", f"SELECT * FROM coupang_rows WHERE {_kept}", COUPANG_VIEWS)
def include_exclude(fx: Fixtures):
    rows = sites.coupang_titles(titles(fx), ["id"], text.strip(F.col("title")))
    return rows.where(predicates.include_exclude(F.col("title"), F.col("affiliate_company_name")))


@check("c3_attribute_filter", """
    SELECT p_partkey, p_brand = 'Brand#2' AND p_type = 'SMALL' AS by_fields,
           contains(tag_text, 'Engineering') AND NOT contains(tag_text, 'Taipei') AS by_text
    FROM (SELECT *, CASE p_size % 3 WHEN 0 THEN 'Engineering Seoul' WHEN 1 THEN 'Engineering Taipei' ELSE p_type END AS tag_text FROM part)""")
def attribute_filter(fx: Fixtures):
    team = F.when(F.col("p_brand") == "Brand#2", F.lit("engineering")).otherwise(F.col("p_brand"))
    place = F.when(F.col("p_type") == "SMALL", F.lit("south-korea")).otherwise(F.col("p_type"))
    tag_text = F.when(F.col("p_size") % 3 == 0, F.lit("Engineering Seoul")).when(F.col("p_size") % 3 == 1, F.lit("Engineering Taipei")).otherwise(F.col("p_type"))
    return fx.table("part").select(
        "p_partkey", predicates.team_and_location(team, place).alias("by_fields"), predicates.engineering_card(tag_text).alias("by_text")
    )


@check("c9_resume_length", """
    SELECT doc_id AS resume_id, length(text) + len(regexp_extract_all(text, '[\\x{10000}-\\x{10FFFF}]')) BETWEEN 20 AND 1000 AS fits FROM documents""")
def resume_length(fx: Fixtures):
    return fx.table("documents").select(F.col("doc_id").alias("resume_id"), predicates.resume_length_ok(F.col("text")).alias("fits"))


# ----------------------------------------------------------------------------- union and dedupe


@check("e10_last_wins_dedupe", """
    SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value, min(event_id) AS event_id
    FROM events GROUP BY user_id""")
def last_wins_dedupe(fx: Fixtures):
    rows = fx.table("events").select("user_id", "event_type", "value", "event_id")
    return last_wins(rows, "user_id", "event_id").orderBy("event_id")


@check("h3_source_union", """
    SELECT link, arg_max(title, seq) AS title, arg_max(extra, seq) AS extra, min(seq) AS seq FROM (
        SELECT link, job_title AS title, CAST(NULL AS VARCHAR) AS extra, id AS seq FROM job_info
        UNION ALL SELECT 'https://jobs.example/' || (p_partkey * 2), p_name, p_brand, p_partkey + 1000000 FROM part)
    GROUP BY link""")
def source_union(fx: Fixtures):
    """Two sources of different shape that list some links both."""
    one = fx.job_info.select("link", F.col("job_title").alias("title"), F.col("id").alias("seq"))
    two = fx.table("part").select(
        F.concat(F.lit("https://jobs.example/"), F.col("p_partkey") * 2).alias("link"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("extra"),
        (F.col("p_partkey") + 1000000).alias("seq"),
    )
    return last_wins(union_all(one, two), "link", "seq")


REPEATS = 1000


@check("h3_merged_listing", f"""
    WITH listed AS (
        SELECT 'flipster' AS source, CAST(id % {REPEATS} AS VARCHAR) AS key, job_title, id FROM job_info
        UNION ALL SELECT 'kakao', CAST(id % {REPEATS - 1} AS VARCHAR), job_title || ' k', id FROM job_info)
    SELECT source, CASE source WHEN 'flipster' THEN {sql_link("flipster", "key")} ELSE {sql_link("kakao", "key")} END AS link,
           arg_max(job_title, id) AS title, min(id) // {PAGE} AS page, min(id) % {PAGE} AS item
    FROM listed GROUP BY source, key""")
def merged_pages(fx: Fixtures):
    """Two sources over pages of 25 with links repeated in and across them: the latest row, at the place of the first."""
    def pages(item):
        rows = fx.job_info.groupBy(F.floor(F.col("id") / PAGE).alias("page")).agg(F.array_sort(F.collect_list(F.struct("id", item.alias("item")))).alias("rows"))
        # ids without a posting leave empty places, so that an item's place follows from its id
        at = F.transform(F.sequence(F.lit(0), F.lit(PAGE - 1)), lambda k: F.get(F.filter("rows", lambda r: r["id"] % PAGE == k), F.lit(0))["item"])
        return rows.select("page", at.alias("items"))

    key = lambda n: (F.col("id") % n).cast("string")
    flipster = F.struct(key(REPEATS).alias("id"), F.col("job_title").alias("title"), F.struct(F.lit("engineering").alias("value")).alias("team"), F.struct(F.lit("south-korea").alias("value")).alias("location"))
    kakao = F.struct(key(REPEATS - 1).alias("realId"), F.concat("job_title", F.lit(" k")).alias("jobOfferTitle"))
    bodies = {
        "flipster": pages(flipster).select("page", F.to_json(F.struct(F.col("items").alias("jobs"))).alias("body")),
        "kakao": pages(kakao).select("page", F.to_json(F.struct(F.col("items").alias("jobList"))).alias("body")),
    }
    rows = sites.merged_listing(bodies, as_of())
    return rows.select("source", "link", "title", F.col("seq.number").alias("page"), F.col("seq.item").cast("long").alias("item"))


@check("a4_nested_cards", """
    SELECT o_orderkey AS id, 0 AS at, '<a>' || o_orderkey || '</a><ul><li>x' || o_orderkey || '</li></ul><b>' || o_orderstatus || '</b>' AS card FROM orders
    UNION ALL SELECT o_orderkey, 1, 'x' || o_orderkey FROM orders
    UNION ALL SELECT o_orderkey, 2, 'last' FROM orders""")
def nested_cards(fx: Fixtures):
    """A card within a card: both are whole."""
    html = F.concat(
        F.lit("<ul><li class='c'><a>"), "o_orderkey", F.lit("</a><ul><li>x"), "o_orderkey", F.lit("</li></ul><b>"), "o_orderstatus", F.lit("</b></li><li>last</li></ul>"),
    )
    return fx.table("orders").select(F.col("o_orderkey").alias("id"), F.posexplode(text.elements_html(html, "li")).alias("at", "card"))
