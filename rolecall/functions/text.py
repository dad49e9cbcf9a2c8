"""Text expressions. All are Column -> Column and stay inside the JVM."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecall import fixed_values as fixed


def strip(text: Column) -> Column:
    """Cut all Unicode white space from both ends (Spark's `trim` cuts U+0020 only)."""
    return F.btrim(text, F.lit(fixed.WHITE_SPACE))


def has(text: Column, part: str) -> Column:
    return F.contains(text, F.lit(part))


def has_any(text: Column, parts) -> Column:
    found = F.lit(False)
    for part in parts:
        found = found | has(text, part)
    return found


def drop_controls(text: Column) -> Column:
    """Delete ASCII control characters."""
    return F.regexp_replace(text, r"[\x00-\x1F\x7F]", "")


def bracket_affiliate(title: Column, default) -> Column:
    """`[Name] rest` -> `Name`; any title holding `]` counts and its first character is dropped."""
    default = F.lit(default) if isinstance(default, str) else default
    inside = F.substring(title, F.lit(2), F.greatest(F.locate("]", title) - 2, F.lit(0)))
    return F.when(has(title, "]"), strip(inside)).otherwise(default)


def bracket_title(title: Column) -> Column:
    """The text between the first and the second `]`, or the title itself when it has none."""
    return F.when(has(title, "]"), strip(F.split_part(title, F.lit("]"), F.lit(2)))).otherwise(title)


def canonical_name(name: Column, aliases: dict[str, str]) -> Column:
    """Case-insensitive exact replacement by a small alias table."""
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(name)), name)


def cut_suffixes(title: Column, affiliate: Column, suffixes, word) -> Column:
    """(title, affiliate) after cutting known suffixes, each naming the affiliate, one after the other;
    `word` = (part, affiliate) decides last. One fold over the rules keeps the expression small.
    """
    rules = F.array(*[F.struct(F.lit(s).alias("suffix"), F.lit(n).alias("name")) for s, n in suffixes])

    def apply(state: Column, rule: Column) -> Column:
        hit = F.contains(state["title"], rule["suffix"])
        cut = strip(F.split_part(state["title"], rule["suffix"], F.lit(1)))
        return F.struct(
            F.when(hit, cut).otherwise(state["title"]).alias("title"),
            F.when(hit, rule["name"]).otherwise(state["affiliate"]).alias("affiliate"),
        )

    part, name = word
    start = F.struct(title.alias("title"), affiliate.alias("affiliate"))
    return F.aggregate(
        rules,
        start,
        apply,
        lambda done: F.struct(
            done["title"].alias("title"),
            F.when(has(done["title"], part), F.lit(name)).otherwise(done["affiliate"]).alias("affiliate"),
        ),
    )


def computed_once(df: DataFrame, keep, columns) -> DataFrame:
    """Select `keep` and the costly `columns`; filters on them later read the finished values.

    A filter right after a plain projection is moved below it and repeats the expressions it uses; it
    does not move below a generator.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*columns))))


def _once(value: Column, use) -> Column:
    """`use(value)` where `value` is costly and used several times: inside the lambda it is a finished value."""
    return F.transform(F.array(value), use)[0]


def or_placeholder(text: Column, placeholder: str | None = fixed.NO_DETAIL) -> Column:
    """Missing or empty detail becomes the placeholder; sources without one keep null."""
    present = F.when(text != "", text)
    return present if placeholder is None else F.coalesce(present, F.lit(placeholder))


def labelled_sections(labels, parts) -> Column:
    """`label\\ntext` sections with a blank line between; a missing text prints as `None`."""
    sections = [
        F.concat(F.lit(f"{label}\n"), F.coalesce(part.cast("string"), F.lit("None")))
        for label, part in zip(labels, parts, strict=True)
    ]
    return F.concat_ws("\n\n", *sections)


def fill_template(template: str, **values: Column) -> Column:
    """Put columns into the `{name}` places of a fixed text."""
    pieces, rest = [], template
    while rest:
        spots = [(rest.find("{%s}" % name), name) for name in values if "{%s}" % name in rest]
        if not spots:
            pieces.append(F.lit(rest))
            break
        at, name = min(spots)
        if at:
            pieces.append(F.lit(rest[:at]))
        pieces.append(values[name].cast("string"))
        rest = rest[at + len(name) + 2 :]
    return F.concat(*pieces)


def summary_lines(summary: Column) -> Column:
    """The `- ` lines of a model summary, without dash, arrows turned to commas."""
    lines = F.filter(F.split(strip(summary), "\n"), lambda line: (strip(line) != "") & line.startswith("- "))
    return F.transform(
        lines,
        lambda line: strip(
            F.replace(strip(F.substring(strip(line), F.lit(2), F.length(line))), F.lit(" -> "), F.lit(", "))
        ),
    )


# ---------------------------------------------------------------------------------------- HTML

_SILENT = r"(?is)<!--.*?-->|<(script|style|template)\b[^>]*>.*?</\1\s*>|<!doctype[^>]*>"


def _decode_one(piece: Column) -> Column:
    """Decode `name;rest` (the text after an ampersand); unknown names keep their ampersand."""
    name = F.regexp_extract(piece, r"^(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]*);", 1)
    rest = F.substring(piece, F.length(name) + 2, F.length(piece))
    entities = {**{n: chr(c) for n, c in name2codepoint.items()}, "apos": "'"}
    table = F.create_map(*[F.lit(x) for pair in entities.items() for x in pair])
    hexa = F.when(name.rlike("^#[xX]"), F.substring(name, 3, 6)).when(
        name.startswith("#"), F.conv(F.substring(name, 2, 7), 10, 16)
    )
    numeric = F.decode(F.unhex(F.lpad(hexa, 8, "0")), "UTF-32")
    char = F.when(name.startswith("#"), numeric).otherwise(F.try_element_at(table, name))
    return F.when((name == "") | char.isNull(), F.concat(F.lit("&"), piece)).otherwise(F.concat(char, rest))


def decode_entities(text: Column) -> Column:
    """Decode character references in one pass, so that a decoded `&` starts no new reference."""

    def decoded(whole: Column) -> Column:
        pieces = F.transform(F.split(whole, "&"), lambda piece, i: F.when(i == 0, piece).otherwise(_decode_one(piece)))
        return F.when(has(whole, "&"), F.array_join(pieces, "")).otherwise(whole)

    return _once(text, decoded)


def without_silent(html: Column) -> Column:
    """Drop comments, scripts and styles: they hold no text and may hold misleading markup."""
    return F.regexp_replace(html, _SILENT, "")


# A character that no text may hold. Marking regex hits with it and splitting there is much cheaper than
# splitting by the regex, which would be compiled again for every row.
_MARK = "\uffff"


def _split_before(text: Column, pattern: str, limit: int = -1) -> Column:
    return F.split(F.regexp_replace(text, pattern, f"{_MARK}$0"), _MARK, limit)


def text_of(fragment: Column, separator: str = "\n", clean: bool = True) -> Column:
    """Text nodes of a fragment, stripped, empty ones dropped, joined. `clean=False` for a fragment
    without comments and scripts, such as the functions below return."""
    markup = without_silent(fragment) if clean else fragment
    nodes = F.split(F.regexp_replace(markup, r"(?s)<[/A-Za-z][^>]*>", _MARK), _MARK)
    stripped = F.transform(nodes, lambda node: strip(decode_entities(node)))
    return F.array_join(F.filter(stripped, lambda node: node != ""), separator)


def _opening(tag: str, css_class: str | None, element_id: str | None) -> str:
    wanted = rf"(?is)<{tag}\b"
    if css_class:
        wanted += rf"""(?=[^>]*\bclass\s*=\s*["'](?:[^"']*\s)?{css_class}(?:\s[^"']*)?["'])"""
    if element_id:
        wanted += rf"""(?=[^>]*\bid\s*=\s*["']{element_id}["'])"""
    return wanted + r"[^>]*>"


def _pieces(element: Column, tag: str) -> Column:
    """What follows the opening of the `tag` element that the text starts with, cut before every opening or closing `tag`."""
    return _split_before(F.regexp_replace(element, r"(?s)^<[^>]*>", ""), rf"(?i)</?{tag}\b")


def _inside(pieces: Column, tag: str) -> Column:
    """How many of the pieces lie inside the element: one fold over the depth; all of them if it is not closed."""
    start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("inside"))

    def step(state: Column, piece: Column) -> Column:
        closes, opens = piece.rlike(rf"(?i)^</{tag}\b"), piece.rlike(rf"(?i)^<{tag}\b")
        change = F.when(closes, -1).when(opens, 1).otherwise(0)
        depth = F.when(state["depth"] > 0, state["depth"] + change).otherwise(0)
        return F.struct(
            depth.cast("int").alias("depth"),
            (state["inside"] + F.when(depth > 0, 1).otherwise(0)).cast("int").alias("inside"),
        )

    return F.aggregate(pieces, start, step)["inside"]


def _inner(element: Column, tag: str) -> Column:
    """The inner HTML of the `tag` element that the text starts with; what follows its end is cut."""
    return _once(_pieces(element, tag), lambda pieces: F.array_join(F.slice(pieces, F.lit(1), _inside(pieces, tag)), ""))


def element_html(
    html: Column, tag: str, css_class: str | None = None, element_id: str | None = None, clean: bool = True
) -> Column:
    """Inner HTML of the first matching element, nested elements of the same tag included; else null."""
    parts = _split_before(without_silent(html) if clean else html, _opening(tag, css_class, element_id), 2)
    rest = lambda parts: F.replace(F.get(parts, F.lit(1)), F.lit(_MARK), F.lit(""))
    return _once(parts, lambda parts: F.when(F.size(parts) == 2, _inner(rest(parts), tag)))


def element_text(html: Column, tag: str, css_class: str | None = None, element_id: str | None = None) -> Column:
    """Text of the first matching element, or null."""
    return text_of(element_html(html, tag, css_class, element_id), clean=False)


def elements_html(html: Column, tag: str, css_class: str | None = None, clean: bool = True) -> Column:
    """Inner HTML of every matching element, in page order; one that is nested in another is in both.

    The page is cut before every match. An element that is not closed in its own cut holds the next one, and is
    read again over all that follows.
    """
    parts = _split_before(without_silent(html) if clean else html, _opening(tag, css_class, None))
    after_first = _once(parts, lambda parts: F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))))

    def whole(cards: Column, card: Column, at: Column) -> Column:
        pieces = _pieces(card, tag)
        read = _once(pieces, lambda pieces: F.struct(pieces.alias("pieces"), _inside(pieces, tag).alias("inside")))
        following = F.array_join(F.slice(cards, at + 1, F.size(cards)), "")
        return _once(
            read,
            lambda r: F.when(
                (r["inside"] == F.size(r["pieces"])) & (at + 1 < F.size(cards)), _inner(following, tag)
            ).otherwise(F.array_join(F.slice(r["pieces"], F.lit(1), r["inside"]), "")),
        )

    return _once(after_first, lambda cards: F.transform(cards, lambda card, at: whole(cards, card, at)))


def attribute(fragment: Column, tag: str, name: str) -> Column:
    """Decoded attribute of the first `tag` that has it, or null."""
    pattern = rf"""(?is)<{tag}\b[^>]*?\s{name}\s*=\s*["']([^"']*)["']"""
    return _once(fragment, lambda whole: F.when(whole.rlike(pattern), decode_entities(F.regexp_extract(whole, pattern, 1))))


def script_json(html: Column, element_id: str) -> Column:
    """Body of the JSON script element with this id, or null."""
    pattern = rf"""(?is)<script\b(?=[^>]*\bid\s*=\s*["']{element_id}["'])[^>]*>(.*?)</script\s*>"""
    return F.when(html.rlike(pattern), F.regexp_extract(html, pattern, 1))


def last_json_ld_date(html: Column) -> Column:
    """`datePosted` of the last linked-data script that has a non-empty one, or null."""
    pattern = r"""(?is)<script\b[^>]*\btype\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script\s*>"""
    bodies = F.regexp_extract_all(html, F.lit(pattern), F.lit(1))
    dates = F.transform(bodies, lambda body: F.get_json_object(body, "$.datePosted"))
    return F.try_element_at(F.filter(dates, lambda d: d.isNotNull() & (d != "")), F.lit(-1))
