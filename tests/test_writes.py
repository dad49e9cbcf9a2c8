import datetime as dt

import pytest
from pyspark.sql import functions as F

from rolecall import fixed_values as fixed
from rolecall import schemas
from rolecall.operators import answers, constraints, dedupe, merge
from rolecall.operators.tagging import assign_tags
from rolecall.plans import ingest
from rolecall.plans.store import empty_store
from rolecall.sources.tables import latest_version, next_store, publish, read_store, table_paths, version_name, write_store
from rolecall.streaming.incremental import LANDED, ingest_available, merge_batch, rejected_rows

NOW = dt.datetime(2024, 5, 2, 8, 0)


def posting(seq, link, title="T", company="C", affiliate="A", day=dt.date(2024, 5, 1), required=("r",), names=("c",), team="team"):
    return (title, company, affiliate, link, team, ["do"], list(required), ["p"], ["h"], [], day, list(names), seq)


def staged(spark, *rows):
    return spark.createDataFrame(list(rows), LANDED)


def jobs_by_link(store):
    return {r.link: r for r in store.job_info.collect()}


def frozen(spark, store, path, version=version_name(1)):
    write_store(spark, store, str(path), version, buckets=4)
    return read_store(spark, str(path), version)


def test_update_keeps_id_upload_date_creation_and_inactive_flag(spark, tmp_path):
    first = ingest.apply_batch(empty_store(spark), staged(spark, posting(1, "x"), posting(2, "y")), F.lit(NOW))
    first = first.with_tables(job_info=first.job_info.withColumn("is_active", F.lit(False)))
    first = frozen(spark, first, tmp_path / "a")
    later = NOW + dt.timedelta(days=3)
    again = posting(1, "x", title="New", day=dt.date(2030, 1, 1), required=("r1", "r2"))
    second = frozen(spark, ingest.apply_batch(first, staged(spark, again), F.lit(later)), tmp_path / "b")
    old, new = jobs_by_link(first), jobs_by_link(second)
    assert new["y"] == old["y"]
    assert (new["x"].id, new["x"].uploaded_date, new["x"].created_at, new["x"].is_active) == (old["x"].id, dt.date(2024, 5, 1), NOW, False)
    assert (new["x"].job_title, new["x"].updated_at) == ("New", later)
    lines = {(r.type, r.sentence_index, r.sentence) for r in second.sentences.where(F.col("job_id") == old["x"].id).collect()}
    assert lines == {("required", 0, "r1"), ("required", 1, "r2"), ("preferred", 0, "p"), ("title", 0, "New")}


def test_the_later_row_of_a_link_wins_but_its_first_upload_date_stays(spark):
    rows = [posting(1, "x", title="a", affiliate="A1"), posting(2, "x", title="b", affiliate="A2", day=dt.date(2025, 1, 1))]
    store = ingest.apply_batch(empty_store(spark), staged(spark, *rows), F.lit(NOW))
    job = jobs_by_link(store)["x"]
    assert (job.job_title, job.uploaded_date) == ("b", dt.date(2024, 5, 1))
    assert {r.name for r in store.affiliate_companies.collect()} == {"A1", "A2"}


def test_an_affiliate_keeps_its_first_parent(spark, tmp_path):
    rows = [posting(1, "x", company="C1", affiliate="A"), posting(2, "y", company="C2", affiliate="A")]
    store = frozen(spark, ingest.apply_batch(empty_store(spark), staged(spark, *rows), F.lit(NOW)), tmp_path)
    ids = {r.name: r.id for r in store.companies.collect()}
    assert [r.parent_company_id for r in store.affiliate_companies.collect()] == [ids["C1"]]
    assert sorted(ids.values()) == [1, 2]


def test_empty_extractions_are_not_saved(spark):
    none = [fixed.NO_CONTENT]
    blank = ("T", "C", "A", "x", fixed.NO_CONTENT, none, none, none, ["h"], [], dt.date(2024, 5, 1), [], 1)
    assert ingest.apply_batch(empty_store(spark), staged(spark, blank), F.lit(NOW)).job_info.count() == 0


def test_applying_a_batch_twice_changes_nothing_more(spark, tmp_path):
    batch = staged(spark, posting(1, "x"), posting(2, "y", names=("c", "d")), posting(3, "x", title="z"))
    once = frozen(spark, ingest.apply_batch(empty_store(spark), batch, F.lit(NOW)), tmp_path / "a")
    twice = frozen(spark, ingest.apply_batch(once, batch, F.lit(NOW)), tmp_path / "b")
    for name, df in once.tables().items():
        assert sorted(map(str, df.collect())) == sorted(map(str, twice.tables()[name].collect())), name


@pytest.mark.parametrize("files", [1, 3])
def test_stream_in_any_number_of_batches_equals_one_batch(spark, tmp_path, files):
    rows = [posting(i, f"l{i % 7}", title=f"t{i}", company=f"C{i % 3}", affiliate=f"A{i % 4}") for i in range(12)]
    landing, root = tmp_path / "landing", str(tmp_path / "store")
    landing.mkdir()
    write_store(spark, empty_store(spark), root, version_name(0), buckets=4)
    import json
    import os

    names = [f.name for f in LANDED.fields]
    for i in range(3):
        path = landing / f"{i}.json"
        path.write_text("\n".join(json.dumps(dict(zip(names, r)), default=str) for r in rows[i * 4 : i * 4 + 4]))
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    streamed = ingest_available(spark, str(landing), root, str(tmp_path / "progress"), F.lit(NOW), files_per_batch=files)
    assert latest_version(spark, root) == version_name(3 // files)
    whole = ingest.apply_batch(empty_store(spark), staged(spark, *rows), F.lit(NOW))
    show = lambda s: sorted((r.link, r.job_title, str(r.uploaded_date), r.id) for r in s.job_info.collect())
    assert show(streamed) == show(whole)
    assert {r.name for r in streamed.companies.collect()} == {r.name for r in whole.companies.collect()}
    lines = lambda s: sorted(map(str, s.sentences.collect()))
    assert lines(streamed) == lines(whole)
    # A second run finds nothing new, and unchanged tables were never copied.
    assert show(ingest_available(spark, str(landing), root, str(tmp_path / "progress"), F.lit(NOW))) == show(whole)
    assert table_paths(spark, root, latest_version(spark, root))["tags"] == {0: f"{root}/tags/version={version_name(0)}"}


def landed(folder, name, *rows):
    import json

    folder.mkdir(exist_ok=True)
    names = [f.name for f in LANDED.fields]
    (folder / f"{name}.json").write_text("\n".join(json.dumps(dict(zip(names, r)), default=str) for r in rows))


def test_a_new_progress_folder_goes_on_from_the_latest_version(spark, tmp_path):
    landing, root = tmp_path / "landing", str(tmp_path / "store")
    write_store(spark, empty_store(spark), root, version_name(0), buckets=4)
    landed(landing, "a", posting(1, "x"))
    ingest_available(spark, str(landing), root, str(tmp_path / "p1"), F.lit(NOW))
    landed(landing, "b", posting(2, "y"))
    ingest_available(spark, str(landing), root, str(tmp_path / "p1"), F.lit(NOW))
    landed(landing, "c", posting(3, "z"))
    store = ingest_available(spark, str(landing), root, str(tmp_path / "p2"), F.lit(NOW))
    assert set(jobs_by_link(store)) == {"x", "y", "z"} and latest_version(spark, root) == version_name(3)


def test_what_others_publish_between_two_batches_stays(spark, tmp_path):
    landing, root, progress = tmp_path / "landing", str(tmp_path / "store"), str(tmp_path / "progress")
    write_store(spark, empty_store(spark), root, version_name(0), buckets=4)
    landed(landing, "a", posting(1, "x", title="backend"), posting(2, "y", title="backend"))
    store = ingest_available(spark, str(landing), root, progress, F.lit(NOW))
    later = ingest.tag_and_deactivate(store, F.lit(NOW + dt.timedelta(days=3)))
    next_store(spark, root, {name: later.tables()[name] for name in ("tags", "job_tags", "job_info")})
    landed(landing, "b", posting(3, "z"))
    store = ingest_available(spark, str(landing), root, progress, F.lit(NOW))
    assert {r.link: r.is_active for r in store.job_info.collect()} == {"x": False, "y": False, "z": True}
    assert store.tags.count() == len(fixed.TAG_NAMES) and store.job_tags.count() > 0
    assert latest_version(spark, root) == version_name(3)


def test_a_batch_that_comes_again_is_left_alone_and_untouched_buckets_keep_their_path(spark, tmp_path):
    root = str(tmp_path / "store")
    write_store(spark, empty_store(spark), root, version_name(0), buckets=8)
    merge_batch(staged(spark, *[posting(i, f"l{i}") for i in range(40)]), root, F.lit(NOW), "s", 0)
    before = table_paths(spark, root, version_name(1))
    one = staged(spark, posting(50, "l7", title="New"))
    merge_batch(one, root, F.lit(NOW), "s", 1)
    merge_batch(one, root, F.lit(NOW), "s", 1)
    assert latest_version(spark, root) == version_name(2)
    after = table_paths(spark, root, version_name(2))
    for name in ("job_info", "sentences"):
        assert len(before[name]) > 4 and sum(before[name][b] != after[name][b] for b in before[name]) == 1, name
    store = read_store(spark, root)
    assert store.job_info.count() == 40 and jobs_by_link(store)["l7"].job_title == "New"
    assert constraints.violations(store).isEmpty()
    merge_batch(one, root, F.lit(NOW), "other stream", 1)
    assert latest_version(spark, root) == version_name(3)


def test_a_version_entered_twice_has_one_entry_and_two_places_are_an_error(spark, tmp_path):
    root = str(tmp_path)
    for path in ("a", "b"):
        publish(spark, root, version_name(4), {"tags": {0: path}}, 4)
    assert table_paths(spark, root, version_name(4)) == {"tags": {0: "b"}}
    spark.createDataFrame([("tags", 0, "c", 4, None, None)], "table_name string, bucket int, path string, buckets int, stream string, batch long").write.mode("append").parquet(f"{root}/versions/version={version_name(4)}")
    with pytest.raises(ValueError, match="two places"):
        table_paths(spark, root, version_name(4))


def test_bad_rows_fail_alone(spark, tmp_path):
    rows = [posting(1, "x", company=None), posting(2, "y"), posting(3, None), posting(4, "z", affiliate=None), posting(5, "w", day=None)]
    root = str(tmp_path / "store")
    write_store(spark, empty_store(spark), root, version_name(0), buckets=4)
    merge_batch(staged(spark, *rows), root, F.lit(NOW), "s", 0)
    store = read_store(spark, root)
    assert set(jobs_by_link(store)) == {"y"} and constraints.violations(store).isEmpty()
    assert {r.job_id for r in store.sentences.collect()} == {jobs_by_link(store)["y"].id}
    assert {(r.seq, r.reason) for r in rejected_rows(spark, root).collect()} == {
        (1, "no company_name"), (3, "no link"), (4, "no affiliate_company_name"), (5, "no uploaded_date"),
    }


def test_ids_are_dense_and_above_the_existing_ones(spark):
    old = spark.createDataFrame([(7, "a"), (3, "b")], "id int, name string")
    incoming = spark.createDataFrame([(n,) for n in ["b", "c", *map(str, range(500))]], "name string")
    rows = merge.get_or_create(old, incoming).collect()
    assert {(r.id, r.name) for r in rows} >= {(7, "a"), (3, "b")}
    assert sorted(r.id for r in rows) == [3, 7, *range(8, 509)]


def test_tags_are_only_added(spark):
    old = spark.createDataFrame([("j", 1)], "job_id string, tag_id int")
    new = spark.createDataFrame([("j", 1), ("j", 2), ("j", 2)], "job_id string, tag_id int")
    assert sorted(map(tuple, merge.insert_ignore(old, new, ["job_id", "tag_id"]).collect())) == [("j", 1), ("j", 2)]


def test_seeding_tags(spark):
    tags = ingest.seed_tags(spark.createDataFrame([], schemas.TAGS))
    assert [r.name for r in tags.orderBy("id").collect()] == list(fixed.TAG_NAMES)
    assert sorted(r.name for r in ingest.seed_tags(tags.where("name <> 'XR'")).collect()) == sorted(fixed.TAG_NAMES)


def test_stale_postings(spark):
    rows = [("old", NOW - dt.timedelta(days=1, seconds=1), True), ("edge", NOW - dt.timedelta(days=1), True), ("none", None, True), ("off", NOW, False)]
    jobs = spark.createDataFrame(rows, "id string, updated_at timestamp, is_active boolean")
    got = {r.id: r.is_active for r in merge.deactivate_stale(jobs, F.lit(NOW)).collect()}
    assert got == {"old": False, "edge": True, "none": True, "off": False}


def test_last_wins_keeps_the_first_place(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("a", 3, None)], "link string, seq int, v string")
    assert [tuple(r) for r in dedupe.last_wins(rows, "link", "seq").orderBy("seq").collect()] == [("a", 1, None), ("b", 2, "y")]


def test_tag_words_match_inside_words(value):
    tags = lambda title, company=None: value(assign_tags(F.lit(title), F.lit(company).cast("string")))
    assert tags("HTML developer") == ["AI"]
    assert tags("Cube seller") == ["BE"]
    assert tags("게임 클라이언트", "데브시스터즈") == ["게임"]
    assert tags("게임 클라이언트", "쿠팡") == []
    assert tags("Staff Software Engineer", "쿠팡") == ["BE"]
    assert tags("SRE DevOps Kubernetes, XR motion") == ["SRE", "DevOps", "XR"]
    assert value(assign_tags(F.lit(None).cast("string"), F.lit("x"))) == []


def test_cascade_leaves_no_orphans(spark, tmp_path):
    rows = [posting(i, f"l{i}", company=f"C{i % 3}", affiliate=f"A{i % 5}") for i in range(30)]
    store = frozen(spark, ingest.apply_batch(empty_store(spark), staged(spark, *rows), F.lit(NOW)), tmp_path)
    store = store.with_tables(job_embeddings=store.job_info.select(F.col("id").alias("job_id"), F.array(F.lit(1.0).cast("float")).alias("embedding")))
    assert constraints.violations(store, width=1).count() == 0
    left = merge.cascade_delete(store, companies=store.companies.where("name = 'C1'").select("id"))
    assert constraints.violations(left, width=1).count() == 0
    assert 0 < left.job_info.count() < 20


def test_unusable_answers(spark):
    good = '{"team_info":"t","responsibilities":["a"],"qualifications":[],"preferred_qualifications":[],"hiring_process":[],"additional_info":[]}'
    bad = [None, "", "null", good[:-2], good.replace('"t"', "null"), good.replace('["a"]', "[null]"), good.replace('"team_info":"t",', ""), "[]"]
    rows = spark.createDataFrame([(i, a) for i, a in enumerate([good, *bad])], "id int, answer string")
    assert {r.id for r in answers.parse_extraction(rows).where("is_usable").collect()} == {0}


def test_rerank_indexes_that_fit_nothing_are_dropped(spark):
    from rolecall.plans.matching import apply_rerank

    matches = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "resume_id int, job_number int, id string")
    answer = '{"results":[{"job_idx":"1","job_title":"B","reason":"r"},{"job_idx":-1,"reason":"x"},{"job_idx":5},{"job_idx":"x"},{"job_idx":0}]}'
    rows = apply_rerank(matches, spark.createDataFrame([(1, answer)], "resume_id int, answer string")).orderBy("rank").collect()
    assert [(r.id, r.rank_title, r.reason) for r in rows] == [("b", "B", "r"), ("a", None, None)]


def pages_of_all_sources(spark):
    """One posting of each source, as its listing and detail pages show it, and one more without a usable answer."""
    import json

    wrap = lambda items: f'<html><script id="__NEXT_DATA__" type="application/json">{json.dumps({"props": {"pageProps": {"dehydratedState": {"queries": [{"state": {"data": items}}]}}}})}</script></html>'
    listings = {
        "naver": json.dumps({"list": [{"annoId": "1", "annoSubject": "[NAVER Cloud] Backend", "staYmdTime": "2024.04.01 00:00"}]}),
        "baemin": json.dumps({"data": {"list": [{"recruitNumber": "R1", "recruitName": "[Tech] Server", "recruitOpenDate": "2024-04-02 09:00"}]}}),
        "kakao": json.dumps({"jobList": [{"realId": "P-1", "jobOfferTitle": "Data", "introduction": "i", "workContentDesc": "w", "qualification": "q", "jobOfferProcessDesc": "p", "uptDate": "2024-04-03T00:00"}, {"realId": "P-2", "jobOfferTitle": "Lost"}]}),
        "flipster": json.dumps({"jobs": [{"id": "f1", "title": "Infra", "team": {"value": "engineering"}, "location": {"value": "south-korea"}}]}),
        "hpcnt": json.dumps({"data": {"allLever": {"nodes": [{"lever_id": "h1", "text": "Android Engineer"}]}}}),
        "devsisters": wrap([{"openingId": "d1", "title": "Client", "openingJobPosition": {"openingJobPositionSetting": {"createdAt": "2024-04-04T01:00:00"}}}]),
        "hyperithm": wrap([{"openingId": "y1", "title": "Quant Developer", "openingJobPosition": {}}]),
        "line": '<ul class="job_list"><li><a href="/jobs/1"><h3 class="title">Server Engineer</h3><span class="date">2024-04-05 ~</span><div class="text_filter">Engineering</div></a></li></ul>',
        "coupang": '<div class="card card-job"><h2 class="card-title"><a href="/jobs/c1">[Coupang Pay] Staff Engineer</a></h2></div>',
        "daangn": '<ul class="c-jpGEAj"><li class="c-deAcZv"><a href="/jobs/g1/"><h3 class="c-boyXyq">Software Engineer</h3></a></li></ul>',
    }
    details = {
        "baemin": ("https://career.woowahan.com/w1/recruits/R1", json.dumps({"data": {"recruitContents": "<p>baemin text"}})),
        "coupang": ("https://www.coupang.jobs/jobs/c1", '<article class="cms-content">coupang text</article><div class="job-table"><time datetime="2024-04-06">x</time></div>'),
        "daangn": ("https://about.daangn.com/jobs/g1/", '<script type="application/ld+json">{"datePosted":"2024-04-07"}</script><article class="c-kJtTwH">daangn text</article>'),
    }
    frame = lambda key, value, column: spark.createDataFrame([(key, value)], f"{column} string, body string")
    return {n: frame("p1", body, "page") for n, body in listings.items()}, {n: frame(*row, "link") for n, row in details.items()}


ANSWER = '{"team_info":"t","responsibilities":["do"],"qualifications":["need"],"preferred_qualifications":["like"],"hiring_process":["h"],"additional_info":["a"]}'


def staged_of_all(spark):
    from rolecall.plans import staging
    from rolecall.sources import sites

    listings, details = pages_of_all_sources(spark)
    as_of = F.lit("2024-05-02").cast("date")
    links = [r.link for r in sites.merged_listing(listings, as_of).select("link").collect()]
    answers = spark.createDataFrame([(n, ANSWER if not n.endswith("P-2") else ANSWER[:-3]) for n in links], "link string, answer string")
    return staging.stage(listings, details, answers, as_of), staging.with_details(sites.merged_listing(listings, as_of), staging.all_details(details, as_of), as_of)


def test_all_ten_sources_are_staged(spark):
    staged_rows, detailed = staged_of_all(spark)
    rows = {r.company_name: r for r in staged_rows.collect()}
    assert staged_rows.columns == [f.name for f in LANDED.fields] and set(rows) == {name for name, _ in fixed.SOURCES.values()}
    days = {n: str(rows[fixed.SOURCES[n][0]].uploaded_date) for n in fixed.SOURCES}
    assert days == {
        "naver": "2024-04-01", "baemin": "2024-04-02", "kakao": "2024-04-03", "devsisters": "2024-04-04", "line": "2024-04-05", "coupang": "2024-04-06",
        "daangn": "2024-04-07", "flipster": "2024-05-02", "hpcnt": "2024-05-02", "hyperithm": "2024-05-02",
    }
    assert all(tuple(rows[name].alternate_names) == names for name, names in fixed.SOURCES.values())
    assert rows["우아한형제들"].link == "https://career.woowahan.com/recruitment/R1/detail" and rows["네이버"].affiliate_company_name == "네이버클라우드"
    assert len({r.seq for r in rows.values()}) == 10
    texts = {r.source: r.detail for r in detailed.where("link NOT LIKE '%P-2'").collect()}
    assert (texts["baemin"], texts["coupang"], texts["daangn"], texts["naver"], texts["flipster"]) == ("<p>baemin text", "coupang text", "daangn text", fixed.NO_DETAIL, None)


def test_the_whole_run_and_again(spark, tmp_path):
    from rolecall.plans.batch import run_batch

    root = str(tmp_path / "store")
    write_store(spark, empty_store(spark), root, version_name(0), buckets=4)
    rows, _ = staged_of_all(spark)
    rows = rows.cache()

    def call(texts):
        if any("Quant" in t for t in texts):
            raise RuntimeError("no")
        return [[float(len(t)), 1.0] for t in texts]

    options = {"wait_seconds": 0.0, "tries": 1}
    store, failed = run_batch(spark, root, rows, F.lit(NOW), call, **options)
    assert store.job_info.count() == 10 and store.job_embeddings.count() == 9 and failed.count() == 1
    assert store.sentences.where("embedding IS NOT NULL").count() == 27 and store.job_tags.count() > 0 and store.tags.count() == len(fixed.TAG_NAMES)
    broken = constraints.violations(store, width=2)
    assert broken.isEmpty(), broken.collect()
    later = NOW + dt.timedelta(days=4)
    again, _ = run_batch(spark, root, rows.where("company_name <> '쿠팡'"), F.lit(later), call, **options)
    kinds = {r.link: r.is_active for r in again.job_info.collect()}
    assert len(kinds) == 10 and [n for n, active in kinds.items() if not active] == ["https://www.coupang.jobs/jobs/c1"]
    third, _ = run_batch(spark, root, rows.where("company_name <> '쿠팡'"), F.lit(later), call, **options)
    assert third.job_embeddings.where("embedding IS NOT NULL").count() == 8 and latest_version(spark, root) == version_name(12)


def test_a_batch_is_read_as_often_as_it_is_kept(spark, tmp_path):
    """Staged rows are computed once, and the latest row of a link once, however many tables are made from them."""
    runs = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            runs.add(batch.num_rows)
            yield batch

    rows = staged(spark, *[posting(n, f"title {n}") for n in range(5)])
    frozen(spark, ingest.apply_batch(empty_store(spark), rows.mapInArrow(counted, rows.schema), F.lit(NOW)), tmp_path)
    assert runs.value == 5


def test_first_values_of_tied_and_missing_places(spark):
    rows = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("a", 3, "x"), ("b", None, "z"), ("c", 5, None)], "name string, seq long, parent string")
    assert {r.name: r.parent for r in merge.first_values(rows, "name", "seq", "parent").collect()} == {"a": "x", "b": None, "c": None}
