"""Token files and packing."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from rolecall.llm import packing, token_files
from rolecall.llm.tokens import Encoder, default_path
from rolecall.session import scratch_path

ODD = [
    "", " ", "  ", "a  b", "a   b", " a", "a ", "a \n b", "a\n b", "a\n\n  b\t c", "x  y", "x  y", "don't we'll  'tis", "<|endoftext|> in text",
    "é ☃ 漢字 かな 🙂", "w" * 300 + " " + "v" * 60 + " end", "\r\n tab\there", "1234 56.78, 9",
    "one, two.\nthree!\n\nfour?\n five;\u00a0six:\u2014 a.\u2014 b.é c,\u3000d", "end.", ".start", "a.\n", "\na", "it's, 'll. x.'s", "a,,b, c.. d",
]


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(default_path())
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def random_texts(n=120):
    rng = random.Random(4)
    return ["".join(rng.choice([" ", " ", "  ", "\n", "\n", "ab", "Cd", "'s", "9", ".", ",", "!", "é", "\t", "\u00a0", "\u2014"]) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_piecewise_ids_equal_those_of_the_whole_text(plain):
    encoder = Encoder(default_path())
    for text in ODD + random_texts() * 2:
        assert np.frombuffer(encoder(text), "<u4").tolist() == plain(text), text


def test_files_round_trip(spark, docs_of, plain):
    rows = [(k * 7 % 1009 - 300, t) for k, t in enumerate(ODD + random_texts(150))] + [(None, "nameless"), (50_000, None), (50_000, None), (50_001, "long " * 40_000)]
    folder = scratch_path(spark, "tokens")
    table = token_files.write(docs_of(rows).repartition(5), folder, default_path(), shard_bytes=30_000)
    shards = table.orderBy("shard").collect()
    assert len(shards) > 3 and [s.base for s in shards] == np.cumsum([0] + [s.n_tokens for s in shards[:-1]]).tolist()
    start = 0
    got = sorted(token_files.read(spark, folder).collect(), key=lambda r: r.start)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert [r.doc_id for r in got] == [i for i, _ in ordered]
    for r, (_, text) in zip(got, ordered):
        ids = plain(text or "") + [2]
        assert (r.start, r.n_tokens, list(r.ids)) == (start, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    ids, offsets, names = token_files.mapped(folder, shards[0].shard, 2)
    assert isinstance(ids, np.memmap) and ids.dtype == "<u2" and offsets[0] == 0 and offsets[-1] == len(ids) and len(names) == shards[0].n_docs


def test_files_of_odd_and_empty_tables(odd_docs, docs_of):
    assert token_files.round_trip(odd_docs, default_path()).count() == 12
    assert token_files.round_trip(docs_of([]), default_path()).isEmpty()
    with pytest.raises(ValueError):
        Encoder(default_path(), width=1)


def check_packing(rows, examples, plain, end=0, capacity=1024, segments=64, loss=1024):
    by_example, by_sequence = {}, {}
    for r in rows:
        by_example.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for name, ids in examples.items():
        at = 0
        for r in sorted(by_example[name], key=lambda r: r.start):
            part = ids[r.start : r.start + r.length]
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity and len(parts) <= segments and sum(r.loss_tokens for r in parts) <= loss
        padding += 0 if at & (at - 1) == 0 else capacity - at
    assert padding == 0


def test_pieces_cover_each_document_once_and_sequences_have_no_padding(docs_of, plain):
    rng = random.Random(8)
    rows = [(k, " ".join(rng.choice(["alpha", "beta", "gamma", "x"]) for _ in range(rng.choice([0, 1, 3, 40, 300, 1023, 1500, 5000])))) for k in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "z " * 60_000)]
    packed = packing.pack(docs_of(rows).repartition(3), default_path())
    got = packed.collect()
    check_packing(got, {k: plain(t or "") + [0] for k, t in rows}, plain)
    assert all(r.ids == np.array(plain(dict(rows)[r.doc_id] or "") + [0], "<u4")[r.start : r.start + r.length].tobytes() for r in got[:200])


def test_limits_on_segments_and_loss(docs_of, plain):
    rng = random.Random(9)
    rows = [(k, " ".join(["word"] * rng.randint(0, 30))) for k in range(400)]
    frame = docs_of(rows).withColumn("ask", F.when(F.col("doc_id") % 3 > 0, F.lit("question " * 50))).coalesce(1)
    got = packing.pack(frame, default_path(), prompt="ask", capacity=256, max_segments=4, max_loss=96).collect()
    prompt = plain("question " * 50)
    check_packing(got, {k: (prompt if k % 3 else []) + plain(t) + [0] for k, t in rows}, plain, capacity=256, segments=4, loss=96)


def test_packing_odd_and_empty_tables(odd_docs, docs_of):
    got = packing.pack(odd_docs, default_path(), with_ids=False)
    assert got.where("start = 0").count() == 12 and "ids" not in got.columns
    assert packing.pack(docs_of([]), default_path()).isEmpty()
