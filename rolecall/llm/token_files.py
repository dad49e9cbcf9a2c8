"""Token-ID output: flat files of unsigned integers with 64-bit document offsets, cut into shards by ascending id.

A shard is three files: `.ids` (the ids of its documents one after another), `.idx` (n + 1 little-endian int64: where
each document starts inside the shard, and the end) and `.doc` (n int64 document ids). `manifest` holds one row per
shard with its base, the number of ids in all shards before it (a prefix sum). All three are flat arrays, so a reader
maps them into memory.

Defined results: a null text is empty and still gets its end id; a null id sorts first and is kept as the smallest
int64 (`NO_ID`), read back as null; repeated ids are further documents, ordered by text; an empty table makes no shard
and reads as no rows; columns other than doc_id and text are ignored.
"""

import itertools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rolecall.llm.tokens import MEMO_PIECES, encoder
from rolecall.session import scratch_path

#: Bytes of text that a shard is planned for.
SHARD_BYTES = 32 << 20
NO_ID = -(1 << 63)


def open_folder(uri: str):
    """(file system, path) of a folder, wherever pyarrow reaches it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri("/" + uri.removeprefix("file:").lstrip("/") if uri.startswith("file:") else uri)


def write(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, width: int = 2, shard_bytes: int = SHARD_BYTES, memo_pieces: int = MEMO_PIECES
) -> DataFrame:
    """Encode (doc_id, text) into shards below `folder`, a folder that every executor reaches; returns the manifest."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))

    def encode(batches):
        encode, end = encoder(tokenizer, width, memo_pieces), np.array([end_id], f"<u{width}").tobytes()
        shard = TaskContext.get().partitionId()
        files, top = open_folder(folder)
        files.create_dir(top, recursive=True)
        ends = ("ids", "idx", "doc")
        # an attempt writes under its own names and moves them at its end; a second attempt has the same bytes
        attempt = {e: f"{top}/.{shard:06d}-{TaskContext.get().taskAttemptId()}.{e}" for e in ends}
        out, at, n = None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                out = {e: files.open_output_stream(p) for e, p in attempt.items()}
                out["idx"].write(np.int64(0).astype("<i8").tobytes())
            for coded in itertools.batched(encode.each(batch.column("text")), 500):
                out["ids"].write(b"".join([x for ids in coded for x in (ids.data, end)]))
                ends_at = at + np.cumsum([len(ids) + 1 for ids in coded])
                at = int(ends_at[-1])
                out["idx"].write(ends_at.astype("<i8").tobytes())
            out["doc"].write(batch.column("doc_id").cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
            n += batch.num_rows
        if out is None:
            return
        for e in ends:
            out[e].close()
            files.move(attempt[e], f"{top}/shard-{shard:06d}.{e}")
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([n], pa.int64()), pa.array([at], pa.int64())], names=["shard", "n_docs", "n_tokens"])

    written = (
        docs.repartitionByRange(shards, F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
        .mapInArrow(encode, "shard int, n_docs long, n_tokens long")
    )
    counted = f"{folder}/counts"
    written.write.parquet(counted)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    spark.read.schema(written.schema).parquet(counted).withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).withColumn(
        "width", F.lit(width)
    ).coalesce(1).write.parquet(f"{folder}/manifest")
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("shard int, n_docs long, n_tokens long, base long, width int").parquet(f"{folder}/manifest")


def mapped(folder: str, shard: int, width: int):
    """(ids, offsets, document ids) of a shard as arrays over mapped memory; read whole where the store has no mapping."""
    files, top = open_folder(folder)
    kinds = {"ids": f"<u{width}", "idx": "<i8", "doc": "<i8"}
    if files.type_name == "local":
        return tuple(np.memmap(f"{top}/shard-{shard:06d}.{e}", k, "r") for e, k in kinds.items())
    return tuple(np.frombuffer(files.open_input_file(f"{top}/shard-{shard:06d}.{e}").read(), k) for e, k in kinds.items())


def read(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of each document, from the files; a task per shard."""
    shards = manifest(spark, folder)
    n = max(1, (shards.agg(F.max("shard")).first()[0] or 0) + 1)
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    fields += [("ids", pa.list_(pa.int32()))] if with_ids else []

    def open_shards(batches):
        import zlib

        for batch in batches:
            for row in batch.to_pylist():
                ids, offsets, names = mapped(folder, row["shard"], row["width"])
                for lo in range(0, len(names), 1000):
                    at = offsets[lo : lo + 1001]
                    each = [ids[a:b].astype("<u4") for a, b in zip(at[:-1], at[1:])]
                    columns = [
                        pa.array(names[lo : lo + 1000], mask=np.asarray(names[lo : lo + 1000] == NO_ID)),
                        pa.array(row["base"] + at[:-1]),
                        pa.array(np.diff(at)),
                        pa.array([zlib.crc32(x.tobytes()) for x in each], pa.int64()),
                    ]
                    columns += [pa.array([x.astype(np.int32) for x in each], pa.list_(pa.int32()))] if with_ids else []
                    yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(fields))

    out = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return shards.repartitionById(n, "shard").mapInArrow(open_shards, out)


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2, memo_pieces: int = MEMO_PIECES) -> DataFrame:
    """Write a fresh folder below the shared one and read it back: (doc_id, start, n_tokens, ids_crc32)."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "token-files")
    write(docs, folder, tokenizer, end_id, memo_pieces=memo_pieces)
    return read(spark, folder, with_ids=False)
