"""Order of results and shape of plans."""

import re

import pytest
from pyspark.sql import functions as F

from rolecall.checks.fixtures import Fixtures, as_of
from rolecall.plans import listing

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def fx(spark):
    return Fixtures(spark, SF_DIR)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_listing_is_newest_first(fx):
    rows = listing.all_active(fx.store, as_of()).select("uploaded_date", "id").collect()
    assert rows == sorted(rows, key=lambda r: (-r.uploaded_date.toordinal(), r.id))


def test_facets_list_each_company_before_its_affiliates(fx):
    rows = [tuple(r) for r in listing.company_facets(fx.store).collect()]
    companies = [tuple(r) for r in listing.count_by_company(fx.store).collect()]
    members = {}
    for r in listing.count_by_affiliate(fx.store).collect():
        members.setdefault(r.parent_company_name, []).append((r.affiliate_company_name, r.job_count))
    want = []
    for name, count in companies:
        want += [(name, count), *members.get(name, [])]
    assert rows == want


def test_counts_come_largest_first(fx):
    for df in (listing.count_by_tag(fx.store), listing.count_by_company(fx.store), listing.count_by_affiliate(fx.store)):
        counts = [r.job_count for r in df.collect()]
        assert counts == sorted(counts, reverse=True)


def test_filters_and_columns_reach_the_scan(spark):
    jobs = spark.read.parquet(f"{SF_DIR}/orders.parquet").withColumn("is_active", F.col("o_orderstatus") == "O")
    text = plan(listing.active(jobs).select("o_orderkey"))
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,O)]" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in text


def test_null_rejecting_outer_joins_become_inner(fx):
    from rolecall.checks.relational import null_rejecting_left

    assert "LeftOuter" not in plan(null_rejecting_left(fx))


def test_top_k_of_one_query_keeps_a_heap(fx):
    from rolecall.operators.knn import one_query
    from rolecall.operators.sentences import mean_vectors

    text = plan(one_query(fx.job_embeddings, mean_vectors(fx.job_embeddings, None), 10))
    assert "TakeOrderedAndProject" in text and "CartesianProduct" not in text and "NestedLoop" not in text


def test_no_plan_pairs_everything(fx):
    """No query joins without keys."""
    from rolecall.checks.registry import QUERIES
    from rolecall.checks import load_all

    load_all()
    for name in ("g1_listing_newest_first", "e7_company_facet_list", "d8_substring_join_grams", "i3_upsert_posting", "d14_vector_cross_join", "p2_cover_letter_prompt"):
        text = plan(QUERIES[name](fx.spark, SF_DIR))
        loops = re.findall(r"CartesianProduct|BroadcastNestedLoopJoin", text)
        assert not loops, name


def test_bucketed_store_serves_without_shuffles_by_posting(spark, fx, tmp_path):
    from rolecall.sources.tables import read_bucketed, save_bucketed

    spark.sql("CREATE DATABASE IF NOT EXISTS serving")
    save_bucketed(fx.store, str(tmp_path), "serving", 4)
    store = read_bucketed(spark, "serving")
    listed = listing.all_active(store, as_of())
    text = plan(listed)
    assert not re.search(r"Exchange hashpartitioning", text), text
    assert text.count("Exchange rangepartitioning") == 1
    assert "SelectedBucketsCount: 4 out of 4" in text
    assert listed.count() == listing.active(fx.job_info).count()
    first, second = listed.drop("updated_at").collect(), listing.all_active(fx.store, as_of()).drop("updated_at").select(listed.drop("updated_at").columns).collect()
    assert first == second


def test_active_postings_have_their_own_partition(spark, fx, tmp_path):
    from rolecall.sources.tables import PARTITION_BY, version_name, write_table

    assert PARTITION_BY["job_info"] == ["is_active"]
    write_table(fx.job_info, str(tmp_path), "job_info", version_name(1), 4)
    stored = spark.read.schema(fx.job_info.schema).parquet(str(tmp_path / "job_info" / f"version={version_name(1)}"))
    text = plan(listing.active(stored).select("id"))
    assert re.search(r"PartitionFilters: \[[^\]]*is_active", text)
    assert stored.count() == fx.job_info.count() and stored.where("is_active").count() == listing.active(fx.job_info).count()
