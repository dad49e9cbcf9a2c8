"""Bitmap posting lists and counts kept by deltas."""

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from rolecall.checks.fixtures import AS_OF, Fixtures, as_of
from rolecall.checks.parsing import text_ids
from rolecall.functions import predicates
from rolecall.functions.dates import recency_flags
from rolecall.operators import merge
from rolecall.plans import facets, ingest, listing, live_counts
from rolecall.plans.store import empty_store, table_schema
from rolecall.session import stored
from rolecall.sources import tables

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def fx(spark):
    return Fixtures(spark, SF_DIR)


@pytest.fixture(scope="module")
def jobs(fx):
    """(company, affiliate, tags, day) of each active posting."""
    named = listing.with_company_names(listing.active(fx.job_info), fx.companies, fx.affiliate_companies)
    tagged = listing.with_child_lists(named, listing.tag_arrays(fx.job_tags, fx.tags), "tags")
    return [(r.company_name, r.affiliate_company_name, set(r.tags), str(r.uploaded_date)) for r in tagged.collect()]


@pytest.fixture(scope="module")
def lists(fx, tmp_path_factory):
    return facets.save_lists(facets.posting_lists(fx.store), str(tmp_path_factory.mktemp("lists")))


def plain(jobs, companies, tags, day):
    kept = [j for j in jobs if (not companies or {j[0], j[1]} & set(companies)) and (not tags or j[2] & set(tags)) and j[3] >= day]
    counts = {}
    for company, affiliate, own, _ in kept:
        for key in [("company", company), *([("member", affiliate)] if affiliate != company else []), *(("tag", t) for t in own)]:
            counts[key] = counts.get(key, 0) + 1
    return len(kept), counts


def test_counts_under_any_choice_equal_a_plain_count(lists, jobs):
    rng = random.Random(3)
    names, brands = sorted({x for j in jobs for x in j[:2]}), sorted(set().union(*[j[2] for j in jobs]))
    for companies, tags in itertools.product((0, 1, 4), (0, 1, 6)):
        companies, tags = rng.sample(names, companies), rng.sample(brands, tags)
        choice = facets.chosen(lists, as_of(), companies=companies, tags=tags)
        total, counts = plain(jobs, companies, tags, "")
        assert facets.chosen_count(choice).first().job_count == total
        assert {(r.kind, r.value): r.job_count for r in facets.facet_counts(lists, choice).collect()} == counts


def test_recent_postings(lists, jobs):
    for flag, days in (("recent_week", 7), ("recent_day", 1)):
        import datetime as dt

        since = str(dt.date.fromisoformat(AS_OF) - dt.timedelta(days=days))
        assert facets.chosen_count(facets.chosen(lists, as_of(), **{flag: True})).first().job_count == plain(jobs, [], [], since)[0]
    assert facets.chosen_count(facets.chosen(lists, as_of(), companies=["nobody"])).first().job_count == 0


def test_numbers_are_dense_and_newest_first(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") % 7 > 0, F.date_sub(F.lit(AS_OF).cast("date"), (F.col("id") % 90).cast("int"))).alias("uploaded_date"))
    got = [(r.number, r.uploaded_date) for r in facets.numbered(rows.repartition(5)).orderBy("number").collect()]
    assert [n for n, _ in got] == list(range(1, 5001))
    dates = [d for _, d in got if d]
    assert dates == sorted(dates, reverse=True) and all(d is None for _, d in got[len(dates) :])


def test_a_choice_reads_its_own_lists_and_joins_no_tags(lists, capsys):
    facets.facet_counts(lists, facets.chosen(lists, as_of(), tags=["Brand#3"]), kinds=("tag",)).explain("formatted")
    text = capsys.readouterr().out
    assert "Brand#3" in text and text.count("PartitionFilters") >= 3
    assert "job_id" not in text and "tag_id" not in text


def full(store):
    return (
        {r.tag_name: r.job_count for r in listing.count_by_tag(store).collect()},
        {r.company_name: r.job_count for r in listing.count_by_company(store).collect()},
        {(r.affiliate_company_name, r.parent_company_name): r.job_count for r in listing.count_by_affiliate(store).collect()},
    )


def kept(spark, root):
    tags, companies, affiliates = live_counts.latest(spark, root)
    return (
        {r.tag_name: r.job_count for r in tags.collect()}, {r.company_name: r.job_count for r in companies.collect()},
        {(r.affiliate_company_name, r.parent_company_name): r.job_count for r in affiliates.collect()},
    )


def test_counts_kept_by_deltas_equal_full_counts(spark, fx, tmp_path, monkeypatch):
    root, whole = str(tmp_path), text_ids(fx.store)
    tables.write_store(spark, whole.with_tables(job_info=whole.job_info.where("id % 2 = 0"), job_tags=whole.job_tags.where("job_id % 3 = 1")), root, tables.version_name(0), buckets=16)
    assert kept(spark, root) == full(tables.read_store(spark, root))

    # one posting changes its company and another is new: one bucket or two are read and written
    store = tables.read_store(spark, root)
    link = store.job_info.where("is_active").orderBy("id").first().link
    version, paths = tables.version_name(1), tables.table_paths(spark, root, tables.version_name(0))
    bucket = spark.range(1).select(tables.bucket_of(F.lit(link), 16)).first()[0]
    rows = tables.read_table(spark, root, "job_info", {bucket: paths["job_info"][bucket]})
    changed = rows.withColumn("company_id", F.when(F.col("link") == link, (F.col("company_id") + 1) % 5).otherwise(F.col("company_id")).cast("int"))
    paths["job_info"] |= tables.write_table(changed, root, "job_info", version, 16)
    tables.publish(spark, root, version, paths, 16)
    read = []
    monkeypatch.setattr(live_counts, "read_table", lambda s, r, name, places: read.append((name, sorted(places))) or tables.read_table(s, r, name, places))
    live_counts.update(spark, root)
    assert [places for name, places in read if name == "job_info"] == [[bucket]] * 2
    assert all(not places for name, places in read if name == "job_tags")
    monkeypatch.undo()
    assert kept(spark, root) == full(tables.read_store(spark, root))

    # more tags, postings that go off, and two versions at once
    store = tables.read_store(spark, root)
    tables.next_store(spark, root, {"job_tags": merge.insert_ignore(store.job_tags, whole.job_tags.where("job_id % 5 < 3"), ["job_id", "tag_id"])})
    assert kept(spark, root) == full(tables.read_store(spark, root))
    store = tables.read_store(spark, root)
    tables.next_store(spark, root, {"job_info": store.job_info.withColumn("is_active", F.col("is_active") & (F.col("id") % 4 > 0))})
    store = tables.read_store(spark, root)
    after = merge.cascade_delete(store, companies=spark.range(2, 3))
    tables.next_store(spark, root, {n: after.tables()[n] for n in ("companies", "affiliate_companies", "job_info", "job_tags")})
    assert kept(spark, root) == full(tables.read_store(spark, root)) == kept(spark, root)


def test_dropped_affiliates_and_rejected_rows_are_counted(spark, fx):
    seen = Observation()
    by_company = listing.count_by_company(fx).where("company_name <> 'ASIA'")
    by_affiliate = listing.count_by_affiliate(fx)
    got = listing.affiliates_of_listed_parents(by_company, by_affiliate, seen).collect()
    assert seen.get["dropped"] == by_affiliate.where("parent_company_name = 'ASIA'").count() > 0
    assert seen.get["dropped_jobs"] == by_affiliate.where("parent_company_name = 'ASIA'").agg(F.sum("job_count")).first()[0]
    assert len(got) == by_affiliate.count() - seen.get["dropped"]
    rows = spark.range(10).select(*[F.lit("x").alias(c) for c in ("job_title", "company_name", "affiliate_company_name", "team_info")],
        F.when(F.col("id") % 3 > 0, F.lit("l")).alias("link"), *[F.array(F.lit("y")).alias(c) for c in ("responsibilities", "qualifications", "preferred_qualifications", "hiring_process", "additional_info")],
        F.current_date().alias("uploaded_date"))
    counted = Observation()
    assert ingest.accepted(rows, counted).count() == 6 and counted.get == {"staged": 10, "rejected": 4}


def test_one_choice_equals_the_listing_filter(fx, lists):
    choice = {"companies": ["ASIA", "NATION_7"], "tags": ["Brand#2", "Brand#11"], "recent_week": False}
    named = listing.with_company_names(listing.active(fx.job_info), fx.companies, fx.affiliate_companies)
    tagged = listing.with_child_lists(named, listing.tag_arrays(fx.job_tags, fx.tags), "tags").select("*", *recency_flags(F.col("uploaded_date"), as_of()))
    assert facets.chosen_count(facets.chosen(lists, as_of(), **choice)).first().job_count == tagged.where(predicates.facet_match(**choice)).count()


def test_tags_that_come_go_and_stay_are_counted_in_one_pass(spark, tmp_path, monkeypatch):
    """Rows that come twice count twice; no table of the tags' differences is made before they meet their postings."""
    root, schema = str(tmp_path), table_schema("job_info")
    active = [{"a": True, "b": True, "c": False, "d": None, "e": True}, {"a": True, "b": False, "c": True, "e": True, "f": True}]
    tags = [
        [("a", 1), ("a", 1), ("a", None), ("b", 1), ("b", 2), ("c", 3), ("e", 2), ("gone", 4), (None, 5)],
        [("a", 1), ("a", 3), ("b", 1), ("b", 3), ("c", 3), ("c", 4), ("d", 1), ("e", 2), ("f", 2), ("f", 2), (None, 5)],
    ]

    def tables_of(now, rows):
        jobs = [tuple({"id": i, "link": f"l{i}", "company_id": 1, "affiliate_company_id": 1, "is_active": on}.get(name) for name in schema.names) for i, on in now.items()]
        return {"job_info": spark.createDataFrame(jobs, schema), "job_tags": spark.createDataFrame(rows, table_schema("job_tags"))}

    def counted():
        return {r.a: r.n for r in live_counts.update(spark, root).where("kind = 'tag'").collect()}

    def plain(now, rows):
        return dict(Counter(tag for job, tag in rows if now.get(job)))

    tables.write_store(spark, empty_store(spark).with_tables(**tables_of(active[0], tags[0])), root, tables.version_name(0), buckets=4)
    written = []
    monkeypatch.setattr(live_counts, "stored", lambda df, name: written.append(name) or stored(df, name))
    assert counted() == plain(active[0], tags[0])
    # postings and tags at once, then only postings, then only tags
    tables.next_store(spark, root, tables_of(active[1], tags[1]))
    assert counted() == plain(active[1], tags[1])
    tables.next_store(spark, root, {"job_info": tables_of(active[0], tags[1])["job_info"]})
    assert counted() == plain(active[0], tags[1])
    tables.next_store(spark, root, {"job_tags": tables_of(active[0], tags[0])["job_tags"]})
    assert counted() == plain(active[0], tags[0])
    assert written == ["changes"] * 4
