"""Ingest by state and streamed answers."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F
from test_writes import NOW, posting, staged

from rolecall.plans import ingest
from rolecall.plans.store import empty_store
from rolecall.sources.tables import latest_version, read_store, version_name, write_store
from rolecall.streaming import chunks, current

@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Each partition of a state has files of its own."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


DAY0 = dt.datetime(2024, 3, 1, 9)


def land(folder, number, rows):
    """Rows are (posting, hours after DAY0)."""
    folder.mkdir(exist_ok=True)
    names = [f.name for f in current.SEEN.fields]
    path = folder / f"{number}.json"
    path.write_text("\n".join(json.dumps(dict(zip(names, (*row, (DAY0 + dt.timedelta(hours=h)).isoformat()))), default=str) for row, h in rows))
    os.utime(path, (1_700_000_000 + number, 1_700_000_000 + number))


ROWS = [(posting(i, f"l{i % 7}", title=f"t{i}", company=f"C{i % 3}", affiliate=f"A{i % 4}", day=dt.date(2024, 1, 1 + i)), i) for i in range(12)]


def show(store):
    return sorted((r.link, r.job_title, str(r.uploaded_date), r.id) for r in store.job_info.collect())


@pytest.mark.parametrize("order,files", [((2, 0, 1), 1), ((1, 2, 0), 3)])
def test_any_split_and_order_of_files_equals_one_batch(spark, tmp_path, order, files):
    landing, root, progress = tmp_path / "landing", str(tmp_path / "store"), str(tmp_path / "progress")
    write_store(spark, empty_store(spark), root, version_name(0), buckets=4)
    for place, part in enumerate(order):
        land(landing, place, ROWS[part * 4 : part * 4 + 4])
    got = current.ingest_available(spark, str(landing), root, progress, F.lit(NOW), files_per_batch=files)
    assert show(got) == show(ingest.apply_batch(empty_store(spark), staged(spark, *[r for r, _ in ROWS]), F.lit(NOW)))
    assert got.job_info.where("is_active").count() == 7
    version = latest_version(spark, root)
    # a restart has nothing to do; then a row that is older than what is known changes nothing but counts as seen
    assert show(current.ingest_available(spark, str(landing), root, progress, F.lit(NOW))) == show(got) and latest_version(spark, root) == version
    late = (*posting(3, "l3", title="old")[:-1], -5)
    land(landing, 9, [(late, 12)])
    after = show(current.ingest_available(spark, str(landing), root, progress, F.lit(NOW)))
    assert {r[0]: r[1] for r in after} == {r[0]: r[1] for r in show(got)}


def test_a_posting_not_seen_for_a_day_goes_off_and_stays_off(spark, tmp_path):
    landing, root, progress = tmp_path / "landing", str(tmp_path / "store"), str(tmp_path / "progress")
    write_store(spark, empty_store(spark), root, version_name(0), buckets=4)
    state = lambda: {r.link: r.is_active for r in current.ingest_available(spark, str(landing), root, progress, F.lit(NOW)).job_info.collect()}
    land(landing, 0, [(posting(1, "a"), 0), (posting(2, "b"), 0), (posting(3, "c"), 0)])
    assert state() == {"a": True, "b": True, "c": True}
    land(landing, 1, [(posting(4, "a"), 23), (posting(5, "b"), 20)])
    assert state() == {"a": True, "b": True, "c": True}
    land(landing, 2, [(posting(6, "a"), 40)])
    assert state() == {"a": True, "b": True, "c": False}
    land(landing, 3, [(posting(7, "a"), 60), (posting(8, "c"), 60)])
    assert state() == {"a": True, "b": False, "c": False}
    assert read_store(spark, root).job_info.count() == 3


def test_state_lies_on_disk_and_the_session_stays_as_it_was(spark, tmp_path):
    landing, root, progress = tmp_path / "landing", str(tmp_path / "store"), tmp_path / "progress"
    write_store(spark, empty_store(spark), root, version_name(0), buckets=4)
    settings = lambda: {key: spark.conf.get(key, None) for key in current.STATE}
    before = settings()
    for number, hours in enumerate((0, 40)):
        land(landing, number, [(posting(number, "a"), hours), (posting(number + 5, f"b{number}"), hours)])
        store = current.ingest_available(spark, str(landing), root, str(progress), F.lit(NOW))
    assert {r.link: r.is_active for r in store.job_info.collect()} == {"a": False, "b0": False, "b1": True}
    for stream in ("latest", "stale"):
        files = {p.suffix for p in (progress / stream / "state" / "0").rglob("*") if p.is_file() and not p.name.startswith(".")}
        # snapshots of RocksDB; rows that executors hold in their heap are written as .delta
        assert ".zip" in files and ".delta" not in files
    assert settings() == before


def test_merges_of_a_stream_with_state_are_planned_as_the_session_says(spark, tmp_path):
    land(tmp_path / "landing", 0, [(posting(1, "a"), 0)])
    land(tmp_path / "landing", 1, [(posting(2, "b"), 40)])
    seen, usual = [], spark.conf.get("spark.sql.adaptive.enabled")

    def merge(batch, stream, number):
        seen.append((batch.sparkSession.conf.get("spark.sql.adaptive.enabled"), sorted(r.link for r in batch.collect())))

    # a batch for each file, and one that the last watermark makes
    current._run(current.gone_stale(current.landed(spark, str(tmp_path / "landing"), 1)), "append", str(tmp_path / "progress"), merge)
    assert {s for s, _ in seen} == {usual} == {"true"} and [x for _, links in seen for x in links] == ["a"]


def test_a_batch_of_stale_links_is_computed_once(spark, tmp_path):
    root = str(tmp_path / "store")
    write_store(spark, ingest.apply_batch(empty_store(spark), staged(spark, *[r for r, _ in ROWS]), F.lit(NOW)), root, version_name(0), buckets=4)
    seen = spark.sparkContext.accumulator(0)

    def stale(*links):
        rows = spark.sparkContext.parallelize(links, 2).map(lambda link: (seen.add(1), (link,))[1])
        return spark.createDataFrame(rows, "link string")

    current.switch_off(stale("l1", "l2", "l2"), root, "stale", 0)
    assert {r.link for r in read_store(spark, root).job_info.where("NOT is_active").collect()} == {"l1", "l2"} and seen.value == 3
    current.switch_off(stale(), root, "stale", 1)
    assert latest_version(spark, root) == version_name(1)


SCHEMA = "conv long, seq long, text string, is_end boolean, at timestamp"


def test_streamed_answers_come_once_and_whole(spark, tmp_path):
    answers = {k: [f"<{k}.{i}>" for i in range(1 + k % 5)] for k in range(40)}
    rows = [(k, i, text, i == len(parts) - 1, DAY0) for k, parts in answers.items() for i, text in enumerate(parts)]
    rows.append((100, 0, "no end", False, DAY0))
    landing, out, progress = str(tmp_path / "landing"), str(tmp_path / "out"), str(tmp_path / "progress")
    missing = [r for r in rows if (r[0], r[1]) == (9, 2)]
    write = lambda part, seed: spark.createDataFrame(part, SCHEMA).repartition(3, F.xxhash64(F.lit(seed), "conv", "seq")).write.mode("append").json(landing)
    write([r for r in rows + rows[::3] if r not in missing], 1)
    take = lambda: {r.conv: (r.text, r.chunks) for r in chunks.assemble_available(spark, landing, SCHEMA, "conv", out, progress).collect()}
    want = {k: ("".join(parts), len(parts)) for k, parts in answers.items()}
    assert take() == {k: v for k, v in want.items() if k != 9}
    write(missing + rows[::2], 2)  # the late chunk, and repeated ones of answers that are done
    assert take() == want
    assert spark.read.parquet(out).count() == len(want)
