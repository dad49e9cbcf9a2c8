"""Mixing sources to target weights by systematic sampling; DataFrame functions only.

A source's target is its weighted share of the budget, at most `most` times its size; what a full source leaves is
shared anew among the others. Every document of a source is expected target / size times. Documents stand in a line,
ordered by size; expected copies are added up along it, one random offset per source is added, and a document is emitted
once for every whole number that its stretch of the line crosses. Neighbours in the line are of like size, so the words
taken follow the target closely.

The line of a source that holds a third of all rows is not one task's: it is cut into blocks by size class and, within
one, by a hash of the id; a block's place in the line is a prefix sum over block counts, a document's a rank in its block.

Defined results: null text has size 0; a null source is a source, the last one; documents of size 0 take their place in
the line and may be emitted; a source of size 0 has target 0 and emits nothing; rows that repeat an id (or have none) are
documents of their own, and which of two equal rows is emitted makes no difference; empty tables give no rows.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolecall.llm.common import WORD, stored

WEIGHTS, BUDGET, MOST = (3, 1, 2), 1.5, 2
#: Documents that a block is planned for.
BLOCK_ROWS = 20_000
SEED = "mix"


def words(text: str) -> Column:
    """Number of words of a text column."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fraction(*parts: Column) -> Column:
    """A number in [0, 1) from a hash of strings."""
    digest = F.md5(F.concat(F.lit(f"{SEED}:"), *parts))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """(source, source_size, n_docs, target, rate, shift) from (source, size): one row per source.

    Sources fill up in the order of size per weight. With the first k full, the level is what they leave, per weight of
    the others; the right k is the first whose next source does not reach its limit at that level.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())  # a row per source
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(in_order) - 1) % len(weights) + 1).cast("int")).cast("long"))
    by_limit = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    after = by_limit.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.lit(budget) * F.sum("source_size").over(every) - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * most) / F.sum("weight").over(after)
    per = per.withColumn("level", level)
    reaches = F.col("level") * F.col("weight") <= F.col("source_size") * most
    per = per.withColumn("final", F.min(F.when(reaches, F.struct(F.col("source_size") / F.col("weight"), F.coalesce("source", F.lit("\U0010ffff")), "level"))).over(every)["level"])
    target = F.least(F.coalesce(F.col("final") * F.col("weight"), (F.col("source_size") * most).cast("double")), (F.col("source_size") * most).cast("double"))
    per = per.withColumn("target", target)
    return per.select(
        "source", "source_size", "n_docs", "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate"),
        fraction(F.coalesce(F.concat(F.lit("s:"), "source"), F.lit("null"))).alias("shift"),
    )


def size_class(size: Column) -> Column:
    """Classes half a doubling wide: from the number of binary digits and the second of them."""
    return (2 * F.length(F.bin(size)) + F.when(F.substring(F.bin(size), 2, 1) == "1", 1).otherwise(0)).cast("int")


def copies(rows: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """(row, size, source_size, target, copies) for each of (row, doc_id, source, size); `row` is carried along whatever it is."""
    # written, so that its size is known before documents are dealt out: a row per source
    sources = stored(targets(rows.select("source", "size"), weights, budget, most).withColumnRenamed("source", "of"), "sources")
    placed = rows.join(sources, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    blocks_of = F.ceil(F.col("n_docs") / F.lit(float(BLOCK_ROWS)))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    placed = placed.withColumns({"class": size_class(F.col("size")), "block": F.floor(fraction(F.lit("d:"), name) * blocks_of).cast("long")})
    # a key without nulls: rows then lie for the join as they lie for their ranks, and move once
    placed = placed.withColumn("key", F.coalesce(F.concat(F.lit("s:"), "source"), F.lit("null")))
    block = ["key", "class", "block"]
    counts = placed.groupBy(*block).agg(F.count("*").alias("n"))
    in_line = Window.partitionBy("key").orderBy("class", "block").rowsBetween(Window.unboundedPreceding, -1)  # a row per block
    counts = counts.select(*block, F.coalesce(F.sum("n").over(in_line), F.lit(0)).alias("before"))
    ranked = placed.withColumn("rank", F.row_number().over(Window.partitionBy(*block).orderBy("size", "doc_id"))).join(counts, block)
    place = F.col("before") + F.col("rank")
    line = lambda n: F.floor(n * F.col("rate") + F.col("shift"))
    made = F.greatest(F.lit(0), F.least(line(place) - line(place - 1), F.lit(most))).cast("long")
    return ranked.select("row", "doc_id", "size", "source_size", "target", made.alias("copies"))


def shares(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of each row, without moving texts."""
    sized = stored(docs.select(F.lit(0).alias("row"), "doc_id", "source", words("text").alias("size")), "sizes")
    return copies(sized).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """docs, all columns, each row as often as the mix takes it."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", words("text").alias("size"))
    taken = copies(rows).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return taken.select("row.*")
