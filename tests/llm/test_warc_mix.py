"""WARC archives and mixing."""

import base64
import gzip
import hashlib
from pathlib import Path

from pyspark.sql import functions as F
from rolecall.llm import mixing, warc
from rolecall.session import scratch_path

PAGES = "page_id long, url string, html string"


def test_archives_round_trip(spark):
    rows = [(k, f"http://h/{k}", f"<p>{k % 4}</p>\r\n\r\nWARC/1.1\r\n\r\n é") for k in range(20)]
    rows += [(30, None, None), (31, "http://h/ a\r\nX: y", ""), (5, "http://h/5", rows[5][2]), (None, "http://n/", "lonely"), (None, "http://n/", rows[0][2]), (40, "u", "big " * 100_000)]
    pages = spark.createDataFrame(rows, PAGES).withColumns({"payload_digest": F.lit("clash"), "refers_to": F.lit("clash")})
    folder = scratch_path(spark, "warc")
    warc.write(pages.repartition(3), folder)
    records = warc.read(spark, folder)
    got = records.collect()
    assert len(got) == len(rows)
    first = {}
    for k, _, html in rows:
        if k is not None:
            first[html or ""] = min(k, first.get(html or "", k))
    want = []
    for k, _, html in rows:
        raw = (html or "").encode()
        again = k is not None and k > first[html or ""]
        want.append((k, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", first[html or ""] if again else None))
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=key) == sorted(want, key=key)
    assert all(r.payload is None for r in got if r.record_type == "revisit")
    whole = {r.page_id: bytes(r.payload) for r in warc.resolved(records).where("page_id IS NOT NULL").collect()}
    assert whole == {k: (html or "").encode() for k, _, html in rows if k is not None}
    files = list(Path("/" + folder.removeprefix("file:").lstrip("/")).glob("part-*.gz"))
    assert sum(gzip.decompress(f.read_bytes()).count(b"WARC-Type: response") for f in files) == sum(w[3] == "response" for w in want)


def test_small_payloads_are_written_whole(spark):
    pages = spark.createDataFrame([(1, "u", "tiny"), (2, "u", "tiny"), (3, "u", "large one"), (4, "u", "large one")], PAGES)
    folder = scratch_path(spark, "warc")
    warc.write(pages, folder, min_bytes=5)
    assert {r.page_id: r.record_type for r in warc.read(spark, folder, with_payload=False).collect()} == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_no_pages(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).isEmpty()


def plain_targets(sizes, weights=(3, 1, 2), budget=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    full, left = set(), budget * sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in full]
        if not open_:
            break
        level = (left - sum(most * sizes[s] for s in full)) / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in full else level * weight[s] for s in names}
        full |= over
    return {s: most * sizes[s] for s in names}


def test_targets_fill_up_and_share_again(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 50, None: 7}, {"a": 5}, {"a": 0, "b": 10, "c": 0}, {"a": 0}, {c: (k + 1) ** 3 for k, c in enumerate("abcdefgh")}):
        got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()
        want = plain_targets(sizes)
        assert {r.source: r.source_size for r in got} == sizes
        assert all(abs(r.target - want[r.source]) < 1e-9 * max(1, want[r.source]) for r in got)


def test_words_taken_come_near_the_targets(docs_of, spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 50)
    rows = [(k, "w " * (1 + k * 37 % 90), "abcd"[min(3, k % 7)]) for k in range(1500)]
    docs = docs_of(rows).repartition(4)
    got = mixing.shares(docs).collect()
    assert len(got) == 1500 and all(r.taken in (0, r.size, 2 * r.size) for r in got)
    source = {k: s for k, _, s in rows}
    for name in "abcd":
        own = [r for r in got if source[r.doc_id] == name]
        assert sum(r.size for r in own) == own[0].source_size
        assert abs(sum(r.taken for r in own) - own[0].target) < 0.03 * own[0].target
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.shares(docs.repartition(7)).collect()))
    times = {r.doc_id: r.taken // r.size for r in got}
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == {k: n for k, n in times.items() if n}


def test_mixing_odd_and_empty_tables(odd_docs, docs_of):
    got = mixing.shares(odd_docs).collect()
    assert len(got) == 12 and all(r.taken <= 2 * r.size for r in got)
    assert {r.doc_id: r.size for r in got}[2] == 0 and {r.doc_id: r.size for r in got}[8] == 60_000
    assert mixing.mix(odd_docs).columns == odd_docs.columns
    assert mixing.shares(docs_of([])).isEmpty() and mixing.mix(docs_of([])).isEmpty()
    nothing = docs_of([(1, "", "a"), (2, None, "a")])
    assert [(r.target, r.taken) for r in mixing.shares(nothing).collect()] == [(0.0, 0), (0.0, 0)]
