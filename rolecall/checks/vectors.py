"""Checks of vector functions and nearest-neighbour search; all vectors are both queries and items."""

from pyspark.sql import functions as F

from rolecall import fixed_values as fixed
from rolecall.checks.fixtures import Fixtures
from rolecall.checks.registry import check
from rolecall.functions.vectors import cosine_distance
from rolecall.operators import graph, running_means
from rolecall.operators.knn import TIE_DIGITS, one_query, top_k
from rolecall.operators.sentences import mean_vectors
from rolecall.session import scratch_path, stored

K = fixed.RETRIEVAL_COUNT

MEANS = {
    "vector_values": """
        SELECT vec_id, label, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(len(embedding))) AS pos FROM embeddings""",
    "label_means": """
        SELECT label, list(m ORDER BY pos) AS mean
        FROM (SELECT label, pos, avg(x) AS m FROM vector_values GROUP BY label, pos) GROUP BY label""",
    "overall_mean": "SELECT list(m ORDER BY pos) AS mean FROM (SELECT pos, avg(x) AS m FROM vector_values GROUP BY pos)",
    "pairs": """
        SELECT r.resume_id, j.job_id, list_cosine_similarity(CAST(r.embedding AS DOUBLE[]), CAST(j.embedding AS DOUBLE[])) AS s
        FROM resume_vectors r CROSS JOIN job_embeddings j""",
    "nearest": f"""
        SELECT resume_id, job_id, s AS similarity, rank FROM (
            SELECT *, row_number() OVER (PARTITION BY resume_id ORDER BY round(s, {TIE_DIGITS}) DESC, job_id) AS rank FROM pairs)
        WHERE rank <= {K}""",
}


@check("b14_cosine_distance", """
    SELECT vec_id, round(1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), mean), 6) AS distance
    FROM embeddings JOIN label_means USING (label)""", MEANS)
def distance_to_mean(fx: Fixtures):
    """Each vector's distance to the mean of its label."""
    vectors = fx.table("embeddings")
    means = mean_vectors(vectors, "label").withColumnRenamed("embedding", "mean")
    pairs = vectors.join(means, "label")
    return pairs.select("vec_id", F.round(cosine_distance(F.col("embedding"), F.col("mean")), 6).alias("distance"))


@check("e8_mean_vector", """
    SELECT label, pos, round(avg(x), 6) AS value FROM vector_values GROUP BY label, pos""", MEANS)
def mean_vector(fx: Fixtures):
    means = mean_vectors(fx.table("embeddings"), "label")
    values = means.select("label", F.posexplode("embedding").alias("pos", "value"))
    return values.select("label", F.col("pos").cast("long").alias("pos"), F.round("value", 6).alias("value"))


@check("e8_mean_current", """
    WITH kept AS (SELECT vec_id, label, CAST(CASE WHEN vec_id % 5 = 1 THEN list_reverse(embedding) ELSE embedding END AS DOUBLE[]) AS v
                  FROM embeddings WHERE vec_id % 7 <> 2 AND label <> 3)
    SELECT label, pos, round(avg(x), 5) AS value
    FROM (SELECT label, unnest(v) AS x, unnest(range(len(v))) AS pos FROM kept) GROUP BY label, pos""", MEANS)
def mean_kept_current(fx: Fixtures):
    """Means per label from a third less of the vectors, after two batches: some change and the rest comes; some go, and all of one label."""
    vectors = fx.table("embeddings").select("vec_id", "label", "embedding")
    changed = (F.col("vec_id") % 5 == 1) & (F.col("vec_id") % 3 != 0)
    state = running_means.state_of(vectors.where("vec_id % 3 <> 0"), "label")
    turned = vectors.withColumn("embedding", F.when(F.col("vec_id") % 5 == 1, F.reverse("embedding")).otherwise(F.col("embedding")))
    first = running_means.changes(vectors.where(changed), turned.where(changed | (F.col("vec_id") % 3 == 0)), "label")
    state = stored(running_means.updated(state, first, "label"), "means")
    second = running_means.changes(turned.where("vec_id % 7 = 2 OR label = 3"), turned.limit(0), "label")
    means = running_means.means(running_means.updated(state, second, "label"), "label")
    values = means.select("label", F.posexplode("embedding").alias("pos", "value"))
    return values.select("label", F.col("pos").cast("long").alias("pos"), F.round("value", 5).alias("value"))


@check("g3_vector_topk", f"""
    SELECT job_id, round(d, 6) AS distance
    FROM (SELECT job_id, 1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), mean) AS d FROM job_embeddings, overall_mean)
    ORDER BY round(d, {TIE_DIGITS}), job_id LIMIT {K}""", MEANS)
def vector_topk(fx: Fixtures):
    """The mean of all vectors as the one query."""
    query = mean_vectors(fx.job_embeddings, None)
    found = one_query(fx.job_embeddings, query, K)
    return found.select("job_id", F.round("distance", 6).alias("distance"))


@check("d14_vector_cross_join", "SELECT resume_id, job_id, rank FROM nearest", MEANS)
def all_against_all(fx: Fixtures):
    """Every query vector against every item vector, only the best kept."""
    found = top_k(fx.resume_vectors, fx.job_embeddings, K)
    return found.select("resume_id", "job_id", F.col("rank").cast("long").alias("rank"))


@check("j1_exact_knn", "SELECT resume_id, job_id, round(similarity, 6) AS similarity, rank FROM nearest", MEANS)
def exact_knn(fx: Fixtures):
    """Bounds from quantised vectors, exact products of what they leave."""
    found = top_k(fx.resume_vectors, fx.job_embeddings, K)
    return found.select("resume_id", "job_id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


@check("g4_similarity_sort", "SELECT resume_id, job_id, round(similarity, 6) AS similarity FROM nearest", MEANS)
def similarity_sort(fx: Fixtures):
    found = top_k(fx.resume_vectors, fx.job_embeddings, K)
    ordered = found.orderBy("resume_id", F.round("similarity", TIE_DIGITS).desc(), "job_id")
    return ordered.select("resume_id", "job_id", F.round("similarity", 6).alias("similarity"))


#: What the graph must reach, and of how many of the vectors each query may see at most that share (or FEW vectors) on average.
RECALL, SHARE, FEW = 0.9, 0.25, 100


@check("j2_approx_knn", f"""
    SELECT resume_id, CAST({K} AS BIGINT) AS found, true AS similarities_true, true AS recall_reached, true AS few_compared FROM nearest GROUP BY resume_id""", MEANS)
def approx_knn(fx: Fixtures):
    """Through a graph index that is written and read: k rows for each resume, their similarities true, and over all resumes at least
    RECALL of the exact answer by a comparison with at most SHARE of the vectors."""
    index = graph.build(fx.job_embeddings, scratch_path(fx.spark, "graph"))
    near, compared = graph.nearest(fx.resume_vectors, index, K)
    exact = top_k(fx.resume_vectors, fx.job_embeddings, K).select("resume_id", "job_id", F.lit(1).alias("hit"))
    both = (
        near.join(fx.resume_vectors.select("resume_id", F.col("embedding").alias("asked")), "resume_id")
        .join(fx.job_embeddings.select("job_id", F.col("embedding").alias("offered")), "job_id")
        .join(exact, ["resume_id", "job_id"], "left")
    )
    true = F.abs(1 - cosine_distance(F.col("asked"), F.col("offered")) - F.col("similarity")) < 1e-6
    per = both.groupBy("resume_id").agg(F.count("*").alias("found"), F.bool_and(true).alias("similarities_true"), F.count("hit").alias("hits"))
    reached = per.agg((F.sum("hits") >= RECALL * F.sum("found")).alias("reached"))
    items = fx.job_embeddings.agg(F.greatest(F.lit(SHARE) * F.count("*"), F.lit(FEW)).alias("most"))
    few = compared.agg(F.avg("compared").alias("mean")).join(items, F.lit(True)).select(F.col("mean") <= F.col("most"))
    return per.select("resume_id", "found", "similarities_true").withColumns({"recall_reached": reached.scalar(), "few_compared": few.scalar()})


@check("j2_index_kept", f"""
    SELECT resume_id, CAST({K} AS BIGINT) AS found, true AS recall_reached FROM nearest GROUP BY resume_id""", MEANS)
def index_kept(fx: Fixtures):
    """Half of the vectors indexed first, the other half added; the recall is that of the whole table."""
    path = scratch_path(fx.spark, "graph")
    graph.build(fx.job_embeddings.where("job_id % 2 = 0"), path)
    near, _ = graph.nearest(fx.resume_vectors, graph.add(fx.job_embeddings.where("job_id % 2 = 1"), path), K)
    exact = top_k(fx.resume_vectors, fx.job_embeddings, K).select("resume_id", "job_id", F.lit(1).alias("hit"))
    per = near.join(exact, ["resume_id", "job_id"], "left").groupBy("resume_id").agg(F.count("*").alias("found"), F.count("hit").alias("hits"))
    reached = per.agg((F.sum("hits") >= RECALL * F.sum("found")).alias("reached"))
    return per.select("resume_id", "found").withColumn("recall_reached", reached.scalar())


@check("j2_all_cells", "SELECT resume_id, job_id, round(similarity, 6) AS similarity, rank FROM nearest", MEANS)
def all_cells(fx: Fixtures):
    """As many probes as cells leave nothing out."""
    found = top_k(fx.resume_vectors, fx.job_embeddings, K, cells=8, probes=8)
    return found.select("resume_id", "job_id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))
