import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rolecall.checks import vectors
from rolecall.functions.vectors import cosine_similarity, mean_vector
from rolecall.operators import graph, knn, quantised
from rolecall.operators import substring_join as substrings
from rolecall.operators.model_batch import call_model, embed_sentences, split_good_failed
from rolecall.operators.sentences import mean_vectors
from rolecall.operators.substring_join import substring_join
from rolecall.plans import matching


def frame(spark, vectors, name):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], f"{name} long, embedding array<float>")


def clustered(n, dim, seed, groups=6, hot=0.4):
    """Vectors around a few directions; one direction holds a large share."""
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(groups, dim))
    pick = np.where(rng.random(n) < hot, 0, rng.integers(0, groups, n))
    return (centers[pick] + 0.3 * rng.normal(size=(n, dim))).astype(np.float32)


def brute(queries, items, k):
    q, p = (m.astype(np.float64) / np.linalg.norm(m.astype(np.float64), axis=1, keepdims=True) for m in (queries, items))
    sims = np.round(q @ p.T, knn.TIE_DIGITS)
    return {(i, int(j)): r + 1 for i in range(len(q)) for r, j in enumerate(np.lexsort((np.arange(len(p)), -sims[i]))[:k])}


def found(df):
    return {(r.resume_id, r.job_id): r["rank"] for r in df.collect()}


@pytest.mark.parametrize("cells", [1, 7])
def test_exact_search_equals_brute_force_with_small_blocks(spark, monkeypatch, cells):
    monkeypatch.setattr(knn, "QUERY_BLOCK", 16)
    monkeypatch.setattr(knn, "ITEM_BLOCK", 50)
    queries, items = clustered(40, 12, 1), clustered(700, 12, 1)
    items[100:140] = items[100]  # ties
    got = found(knn.top_k(frame(spark, queries, "resume_id"), frame(spark, items, "job_id"), 10, cells=cells))
    assert got == brute(queries, items, 10)


def test_approximate_search_finds_most_and_ranks_like_the_exact_one(spark):
    queries, items = clustered(50, 12, 2), clustered(600, 12, 2)
    args = frame(spark, queries, "resume_id"), frame(spark, items, "job_id"), 10
    near = knn.top_k(*args, cells=8, probes=2).collect()
    exact = brute(queries, items, 10)
    hits = sum((r.resume_id, r.job_id) in exact for r in near)
    assert hits / len(exact) > 0.8
    whole = {(r.resume_id, r.job_id): r.similarity for r in knn.top_k(*args).collect()}
    for r in near:
        if (r.resume_id, r.job_id) in whole:
            assert abs(whole[(r.resume_id, r.job_id)] - r.similarity) < 1e-12


@pytest.mark.parametrize("sf,share", [("sf0.001", 0.6), ("sf0.01", 0.25), ("sf0.1", 0.1)])
def test_the_graph_reaches_nine_tenths_of_brute_force(spark, tmp_path, sf, share):
    given_ = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").orderBy("vec_id")
    rows = given_.select("vec_id", "embedding").collect()
    matrix, ids = np.array([r.embedding for r in rows]), [r.vec_id for r in rows]
    index = graph.build(given_.select(F.col("vec_id").alias("job_id"), "embedding"), str(tmp_path))
    near, compared = graph.nearest(given_.select(F.col("vec_id").alias("resume_id"), "embedding"), index, 10)
    exact = {(ids[i], ids[j]) for i, j in brute(matrix, matrix, 10)}
    assert vectors.RECALL >= 0.9 and len(set(found(near)) & exact) >= 0.9 * len(exact)
    assert compared.agg(F.avg("compared")).first()[0] <= share * len(ids)


def test_a_graph_of_many_blocks_grows_and_is_built_anew(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(quantised, "QUERY_BYTES", 700)
    queries, items = clustered(30, 12, 6), clustered(900, 12, 6)
    items[50:60] = 0
    offered = frame(spark, items, "job_id").withColumn("job_id", F.concat(F.lit("j"), "job_id"))
    ask = frame(spark, queries, "resume_id")
    half = F.xxhash64("job_id") % 2 == 0
    graph.build(offered.limit(5), str(tmp_path))
    graph.build(offered.where(half), str(tmp_path), block_bytes=6000)
    index = graph.add(offered.where(~half), str(tmp_path), block_bytes=6000)
    assert index.select(F.explode("ids").alias("id")).agg(F.count("*"), F.count_distinct("id")).first() == (890, 890)
    near, compared = graph.nearest(ask, index, 10)
    real = np.delete(np.arange(900), np.arange(50, 60))
    exact = {(i, f"j{real[j]}"): r for (i, j), r in brute(queries, items[real], 10).items()}
    got = found(near)
    assert len(got) == 300 and len(set(got) & set(exact)) >= 0.95 * len(exact)
    assert compared.count() == 30
    none, _ = graph.nearest(ask.limit(0), index, 10)
    assert none.count() == 0 and graph.nearest(ask, graph.build(offered.limit(0), str(tmp_path / "none")), 10)[0].count() == 0


def test_links_are_mutual_bounded_and_lead_everywhere():
    unit = clustered(400, 8, 9)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    links = graph.linked(unit, links=6, most=40)
    pairs = {(i, int(j)) for i in range(400) for j in links[i] if j >= 0}
    assert all((b, a) in pairs for a, b in pairs) and not any(a == b for a, b in pairs)
    order = graph.apart_first(unit)
    assert sorted(order) == list(range(400))
    unit = unit[order]
    links = graph.linked(unit, links=6, most=40)
    seen = set(range(graph.entries(400)))
    todo = list(seen)
    while todo:
        new = {int(j) for j in links[todo.pop()] if j >= 0} - seen
        seen |= new
        todo += new
    assert len(seen) >= 396
    assert (graph.linked(unit, most=7) >= 0).sum(axis=1).max() <= 7
    assert graph.linked(unit[:1]).max() == -1


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 60), st.integers(1, 30), st.integers(0, 10**6))
def test_quantised_bounds_hold(n, width, seed):
    rng = np.random.default_rng(seed)
    rows = rng.normal(size=(n, width)) * rng.choice([1e-3, 1, 1e3], size=(n, 1)) + rng.choice([0, 5], size=(1, width))
    queries = rng.normal(size=(7, width))
    unit, q = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (rows, queries))
    codes, scale, slack = quantised.codes_of(unit)
    about = scale[:, None] * (codes.astype(np.float32) @ q.T.astype(np.float32))
    assert (np.abs(about - unit @ q.T) <= slack[:, None]).all()
    if width > 2:
        assert np.median(slack) < 0.05


def test_exact_search_in_small_steps_and_many_chunks(spark, monkeypatch):
    for name, value_ in (("QUERY_BYTES", 500), ("ITEM_ROWS", 64), ("QUERY_ROWS", 5), ("HELD", 300)):
        monkeypatch.setattr(quantised, name, value_)
    queries, items = clustered(25, 12, 1), clustered(700, 12, 1)
    items[100:140] = items[100]  # ties
    got = found(knn.top_k(frame(spark, queries, "resume_id"), frame(spark, items, "job_id").repartition(3), 10))
    assert got == brute(queries, items, 10)
    assert knn.top_k(frame(spark, queries, "resume_id").limit(0), frame(spark, items, "job_id"), 10).count() == 0


def test_a_task_holds_few_candidates_of_close_and_equal_vectors(spark):
    """Thousands of vectors closer than a byte a number can tell apart, and hundreds of copies of one."""
    rng = np.random.default_rng(11)
    items = (rng.normal(size=16) + 5e-2 * rng.normal(size=(3000, 16))).astype(np.float32)
    items[500:900] = items[500]
    asked, offered = (knn.usable(frame(spark, v, name), name, "embedding") for v, name in ((items[450:550], "resume_id"), (items, "job_id")))
    few = knn.few_of_each(offered, "job_id", 10)
    assert few.count() == 3000 - 390
    pairs = quantised.candidates(asked, quantised.quantised(few.coalesce(1), "job_id"), "resume_id", "job_id", 10)
    assert 1000 <= pairs.count() < 2000
    got = found(knn.top_k(frame(spark, items[450:550], "resume_id"), frame(spark, items, "job_id"), 10))
    assert got == brute(items[450:550], items, 10)
    cells = found(knn.top_k(frame(spark, items[450:550], "resume_id"), frame(spark, items, "job_id"), 10, cells=4, probes=4))
    assert cells == got


def test_repeated_rows_count_as_often_as_they_are_there_in_cells(spark):
    rng = np.random.default_rng(12)
    items, queries = rng.normal(size=(60, 8)), rng.normal(size=(4, 8))
    twice = np.concatenate([items, items[::3]])
    ids = np.concatenate([np.arange(60), np.arange(60)[::3]])
    offered = spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids, twice)], "job_id long, embedding array<float>")
    got = {}
    for r in knn.top_k(frame(spark, queries, "resume_id"), offered, 6, cells=3, probes=3).collect():
        got.setdefault(r.resume_id, []).append((r["rank"], r.job_id))
    q, v = (x.astype(np.float32).astype(float) for x in (queries, twice))
    near = np.round((q / np.linalg.norm(q, axis=1, keepdims=True)) @ (v / np.linalg.norm(v, axis=1, keepdims=True)).T, 9)
    assert {i: [j for _, j in sorted(rows)] for i, rows in got.items()} == {i: [int(ids[j]) for j in np.lexsort((ids, -near[i]))[:6]] for i in range(4)}


def test_bounds_halt_before_they_hold_too_much(monkeypatch):
    monkeypatch.setattr(quantised, "HELD", 500)
    codes, scale, slack = quantised.codes_of(np.tile([0.6, 0.8], (5000, 1)))
    bounds, handed_on = quantised.Bounds(np.array([[0.6, 0.8], [1.0, 0.0]]), 10, 100, 1), 0
    for _ in bounds.offer(0, codes, scale, slack):
        assert bounds.held <= 700
        handed_on += len(bounds.left()[0])
    assert handed_on + len(bounds.left()[0]) == 10_000


def test_missing_and_zero_vectors_are_left_out(spark):
    items = spark.createDataFrame([(0, None), (1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])], "job_id long, embedding array<float>")
    queries = spark.createDataFrame([(0, [1.0, 0.1]), (1, None)], "resume_id long, embedding array<float>")
    assert found(knn.top_k(queries, items, 10)) == {(0, 2): 1, (0, 3): 2}
    one = knn.one_query(items, queries.where("resume_id = 0"), 10).collect()
    assert [r.job_id for r in one] == [2, 3]


def test_fewer_items_than_asked_for_in_the_nearest_cells(spark):
    queries, items = clustered(5, 4, 3), clustered(12, 4, 3)
    got = found(knn.top_k(frame(spark, queries, "resume_id"), frame(spark, items, "job_id"), 10, cells=5))
    assert got == brute(queries, items, 10)


def test_ids_may_be_text(spark):
    items = frame(spark, clustered(30, 4, 4), "job_id").withColumn("job_id", F.col("job_id").cast("string"))
    queries = frame(spark, clustered(3, 4, 5), "resume_id").withColumn("resume_id", F.concat(F.lit("r"), "resume_id"))
    rows = knn.top_k(queries, items, 4).collect()
    assert len(rows) == 12 and {r.resume_id for r in rows} == {"r0", "r1", "r2"}


def test_cosine_and_means(spark, value):
    a = F.array(F.lit(1.0), F.lit(0.0))
    assert value(cosine_similarity(a, F.array(F.lit(0.0), F.lit(0.0)))) is None
    assert value(cosine_similarity(a, F.array(F.lit(2.0), F.lit(0.0)))) == 1.0
    vectors = F.array(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(6.0)))
    assert value(mean_vector(vectors)) == [2.0, 4.0]
    assert value(mean_vector(F.array().cast("array<array<float>>"))) is None
    one = spark.createDataFrame([(1, [0.25, 0.5]), (1, None)], "k int, embedding array<float>")
    assert mean_vectors(one, "k").first().embedding == [0.25, 0.5]


TEXT = st.text(alphabet="abc 가😀\n", max_size=60)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(TEXT, min_size=1, max_size=8), st.lists(st.text(alphabet="abc 가😀\n", max_size=20), min_size=1, max_size=12))
def test_substring_join_equals_brute_force(spark, texts, patterns):
    left = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    right = spark.createDataFrame([(p,) for p in patterns], "p string")
    want = {(i, p) for i, t in enumerate(texts) for p in patterns if p in t}
    assert {tuple(r) for r in substring_join(left, right, "id", "t", "p").collect()} == want


def test_long_patterns_at_every_offset(spark):
    rng = np.random.default_rng(0)
    base = "".join(rng.choice(list("abcdefgh"), 400))
    patterns = [base[i : i + n] for n in (1, 2, 3, 5, 8, 15, 16, 31, 64, 100, 255) for i in rng.integers(0, 140, 4)]
    texts = [base, base[7:], "x" + base[100:], base[:60]]
    left = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    right = spark.createDataFrame([(p,) for p in patterns], "p string")
    want = {(i, p) for i, t in enumerate(texts) for p in patterns if p in t}
    assert {tuple(r) for r in substring_join(left, right, "id", "t", "p").collect()} == want


def test_texts_hand_on_only_windows_that_a_pattern_may_start_with(spark, monkeypatch):
    """Long texts in pieces, text of several bytes a letter, patterns of every length up to several slices."""
    monkeypatch.setattr(substrings, "SLICE_BYTES", 100)
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("aé한😀 b"), n)) for n in (0, 1, 40, 90, 1500, 3000)] + ["zz" * 700, None]
    patterns = sorted({t[i : i + n] for t in texts if t for n in (*range(1, 20), 23, 24, 25, 47, 48, 49, 64, 300, 400) for i in rng.integers(0, max(1, len(t) - n), 2)} | {"absent", "q" * 500})
    left = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    right = spark.createDataFrame([(p,) for p in patterns] + [(None,)], "p string")
    want = {(i, p) for i, t in enumerate(texts) if t is not None for p in patterns if p in t}
    assert {tuple(r) for r in substring_join(left, right, "id", "t", "p").collect()} == want

    few = spark.createDataFrame([("zzzz", 4), ("q" * 500, 384)], "p string, width int")
    marks = substrings._bitmap(substrings._pattern_windows(few, "p"), substrings.LEAST_BITS)
    monkeypatch.setattr(substrings, "SLICE_BYTES", 1 << 20)
    handed_on = substrings._text_windows(left.where("t IS NOT NULL"), "id", "t", [4, 384], marks)
    assert [r.id for r in handed_on.collect()] == [6]  # one row, of some 9,000 positions


def test_probes_count_at_every_size(spark):
    rng = np.random.default_rng(3)
    items = frame(spark, rng.normal(size=(400, 12)), "job_id")
    queries = frame(spark, rng.normal(size=(15, 12)), "resume_id")
    exact, near = found(knn.top_k(queries, items, 5)), found(knn.top_k(queries, items, 5, probes=1))
    assert near != exact and found(knn.top_k(queries, items, 5, probes=knn.LEAST_CELLS)) == exact
    assert found(knn.top_k(queries, items, 5, cells=6, probes=6, train_rows=100)) == exact


def test_sorted_answers_are_sorted(spark):
    from rolecall import checks
    from rolecall.checks.registry import QUERIES

    checks.load_all()
    rows = [(r.resume_id, -round(r.similarity, 6), r.job_id) for r in QUERIES["g4_similarity_sort"](spark, "/root/testdata/sf0.001").collect()]
    assert rows and [r[:2] for r in rows] == sorted(r[:2] for r in rows)


def test_names_with_capitals_never_match_lower_cased_resumes(spark):
    resumes = spark.createDataFrame([(1, "worked at naver and acme")], "resume_id int, resume_text string")
    companies = spark.createDataFrame([(1, "Naver"), (2, "acme"), (3, "Other")], "id int, name string")
    alternates = spark.createDataFrame([(3, "NAVER"), (2, "naver")], "company_id int, alternate_name string")
    assert [r.company_id for r in matching.named_experiences(resumes, companies, alternates).collect()] == [2]


def test_model_calls_are_retried_and_failures_kept_apart(spark):
    calls = []

    def flaky(text):
        calls.append(text)
        if text == "bad" or (text == "shaky" and calls.count("shaky") < 3):
            raise RuntimeError("no")
        return len(text)

    from pyspark.sql import types as T

    rows = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "shaky")], "id int, text string").coalesce(1)
    good, failed = split_good_failed(call_model(rows, "text", flaky, T.StructField("n", T.IntegerType()), wait_seconds=0.0))
    assert sorted((r.id, r.n) for r in good.collect()) == [(1, 4), (3, 5)]
    assert [(r.id, r.error) for r in failed.collect()] == [(2, "RuntimeError: no")]


def test_few_answers_of_a_model_are_held_at_a_time(spark):
    from pyspark.sql import types as T

    class Answer(list):
        live = 0

        def __init__(self, *args):
            super().__init__(*args)
            Answer.live += 1

        def __del__(self):
            Answer.live -= 1

    rows = spark.range(2000).coalesce(1).select("id", F.struct(F.col("id").alias("n"), F.array(F.lit("x"), F.lit(None))).alias("kept"))
    kind = T.StructField("live", T.ArrayType(T.IntegerType()))
    out = call_model(rows, "id", lambda value: Answer([Answer.live]), kind).collect()
    assert {(r.id, r.kept.n, tuple(r.kept[1])) for r in out} == {(i, i, ("x", None)) for i in range(2000)}
    assert max(r.live[0] for r in out) < 300


def test_one_call_per_posting_in_sentence_order(spark):
    from rolecall.operators.sentences import rows_per_job, vectors_from_batches

    rows = [("j", "title", 0, "t"), ("j", "required", 1, "r1"), ("j", "preferred", 0, "p"), ("j", "required", 0, "r0")]
    sentences = spark.createDataFrame(rows, "job_id string, type string, sentence_index int, sentence string")
    batches = embed_sentences(rows_per_job(sentences), lambda texts: [[float(i)] for i in range(len(texts))])
    got = {r.sentence: r.embedding[0] for r in vectors_from_batches(batches).collect()}
    assert got == {"p": 0.0, "r0": 1.0, "r1": 2.0, "t": 3.0}


def test_running_means_leave_other_keys_alone_and_empty_ones_out(spark):
    from rolecall.operators import running_means as r

    rows = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 6.0]), (2, [5.0, 5.0]), (3, None), (4, [7.0, 7.0])], "k int, embedding array<float>")
    state = r.state_of(rows, "k")
    assert {(x.k, x.n) for x in state.collect()} == {(1, 2), (2, 1), (4, 1)}
    change = r.changes(rows.where("k = 2 OR embedding[0] = 3"), spark.createDataFrame([(1, [9.0, 0.0]), (3, [1.0, 1.0]), (5, None)], rows.schema), "k")
    got = {x.k: list(x.embedding) for x in r.means(r.updated(state, change, "k"), "k").collect()}
    assert got == {1: [5.0, 1.0], 3: [1.0, 1.0], 4: [7.0, 7.0]}
