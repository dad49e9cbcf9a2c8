import hashlib
import re

import pytest
from pyspark.sql import functions as F
from rolecall.llm import decontaminate as d

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, width=10):
    """By comparing every window of every item with every place of every document."""
    out = []
    for doc_id, text in docs:
        words, hit, named = plain_words(text), set(), set()
        for item, item_text in items:
            own = plain_words(item_text)
            n = min(width, len(own))
            for k in range(len(own) - n + 1 if n else 0):
                for at in range(len(words) - n + 1):
                    if words[at : at + n] == own[k : k + n]:
                        hit.update(range(at, at + n))
                        named.update([] if item is None else [str(item)])
        ids = ",".join(sorted(named))
        out.append((doc_id, len(words), len(hit), len(named), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


LONG = "One two THREE four five six seven eight nine ten eleven twelve"
ITEMS = [
    (3, LONG), (20, LONG.lower()), (3, "short Question?"), (5, "é ünder ☃ x1"), (6, ""), (7, None), (8, " ,;. "), (None, "nobody's own item"),
    (9, "aa aa aa aa aa aa aa aa aa aa aa"),
]
DOCS = [
    (1, "Before, one-two three_four five six SEVEN eight nine ten; after"), (2, "eleven " + LONG + " eleven twelve thirteen"), (3, None), (4, ""), (5, "?!"),
    (6, "a short question and a SHORT, question"), (7, "short questions"), (8, "É ünder ☃ x1 é ünder ☃ x1"), (9, "aa " * 40), (10, "is nobody s own item here"),
    (None, "short question"), (11, "short question"), (11, "short question"), (12, "aa aa aa"), (13, "one two three four five six seven eight nine"),
]


@pytest.fixture
def tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("digest", "items", "n_hit", "gram")})
    return docs, spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.mark.parametrize("block_bytes", [d.BLOCK_BYTES, 60])
def test_equals_a_plain_comparison(tables, block_bytes):
    docs, items = tables
    got = d.report(d.find(docs, items, block_bytes=block_bytes)).collect()
    assert sorted([tuple(r) for r in got], key=repr) == plain(DOCS, ITEMS)


def test_spans_are_places_of_the_text_as_it_was(tables):
    docs, items = tables
    texts = dict(DOCS)
    for row in d.find(docs, items).where("n_hit > 0 AND doc_id IS NOT NULL").collect():
        inside = [w for s in row.spans for w in plain_words(texts[row.doc_id][s.start : s.end])]
        assert len(inside) == row.n_hit
    first = d.find(docs, items).where("doc_id = 1").first()
    assert [DOCS[0][1][s.start : s.end] for s in first.spans] == ["one-two three_four five six SEVEN eight nine ten"]


def test_clean_keeps_rows_without_hits_and_all_columns(tables):
    docs, items = tables
    kept = d.clean(docs, items)
    assert kept.columns == docs.columns
    want = sorted(r[0] for r in plain(DOCS, ITEMS) if not r[5])
    assert sorted(r.doc_id for r in kept.collect()) == want


def test_question_and_answer_are_items_of_one_id(spark):
    items = spark.createDataFrame([(1, "what is it", "a cat")], "item_id long, question string, answer string")
    docs = spark.createDataFrame([(1, "what is it a cat"), (2, "is it a"), (3, "it is a cat")], "doc_id long, text string")
    got = {r.doc_id: (r.n_hit, r["items"]) for r in d.find(docs, items, ("question", "answer")).collect()}
    assert got == {1: (5, ["1"]), 2: (0, []), 3: (2, ["1"])}


def test_empty_tables(spark, tables):
    docs, items = tables
    assert d.find(docs.limit(0), items).count() == 0
    assert d.report(d.find(docs, items.limit(0))).where("contaminated").count() == 0
    assert d.clean(docs, items.limit(0)).count() == len(DOCS)
