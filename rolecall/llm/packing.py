"""Packing examples into sequences: vector bin packing under limits on tokens, segments and loss-bearing tokens.

Every task packs the examples of its partition; nothing is shuffled. An example longer than a sequence gives whole
sequences and a rest. The rests wait in a buffer; the open sequence takes, again and again, the one that fits and has
the largest dot product of its demand (tokens, one segment, loss tokens, each as a share of its limit) with what is left.
What no rest fills is filled by cutting one, and a sequence that can't be filled is cut at a power of two, where
no padding is needed; what is cut off goes back to the buffer.

Defined results: null texts and prompts are empty, and an empty example still has its end id; repeated rows and ids
are examples of their own; null ids are kept; an empty table gives no rows; other columns are ignored.
"""

import itertools
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolecall.llm.tokens import MEMO_PIECES, encoder

CAPACITY, MAX_SEGMENTS, MAX_LOSS = 1024, 64, 1024
#: Rests that wait in a task, and rows that it hands on at a time.
BUFFER, ROWS = 512, 1000

SCHEMA = "doc_id long, start long, length long, loss_tokens long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def power_of_two(n: int) -> int:
    """The largest one that is at most n."""
    return 1 << (n.bit_length() - 1)


class Packer:
    """Pieces of examples in, whole sequences out. A piece is (example, start, length); its loss tokens are those from `example.prompt` on."""

    def __init__(self, capacity=CAPACITY, max_segments=MAX_SEGMENTS, max_loss=MAX_LOSS, buffer=BUFFER):
        self.limits = np.array([capacity, max_segments, max_loss], float)
        self.capacity, self.max_segments, self.max_loss, self.size = capacity, max_segments, max_loss, buffer
        self.pieces: list[tuple] = []
        self.demand = np.zeros((4, 3))

    @staticmethod
    def loss(piece) -> int:
        example, start, length = piece
        return max(0, start + length - max(start, example[2]))

    def _put(self, piece) -> None:
        k = len(self.pieces)
        if k == len(self.demand):
            self.demand = np.concatenate([self.demand, np.zeros_like(self.demand)])
        self.pieces.append(piece)
        self.demand[k] = piece[2], 1, self.loss(piece)

    def _take(self, k: int):
        piece, last = self.pieces[k], self.pieces.pop()
        n = len(self.pieces)
        if k < n:
            self.pieces[k] = last
            self.demand[k] = self.demand[n]
        return piece

    def add(self, example) -> None:
        """`example`: (id, ids, loss-free tokens in front, tokens)."""
        at, left = 0, example[3]
        while left:
            length = self._fitting(example, at, min(left, self.capacity))
            self._put((example, at, length))
            at, left = at + length, left - length

    def _fitting(self, example, at: int, length: int, loss: float | None = None) -> int:
        """Of a stretch, as much as the loss limit lets into one sequence; 0 if nothing."""
        room = self.max_loss if loss is None else loss
        return int(min(length, max(0, example[2] - at) + room))

    def sequences(self, final: bool = False):
        """Sequences (lists of pieces) while more rests wait than the buffer keeps; at the end, of all."""
        while self.pieces and (final or len(self.pieces) >= self.size):
            yield self._one()

    def _one(self) -> list:
        left, chosen = self.limits.copy(), []
        while self.pieces and left[0] > 0 and left[1] > 0:
            demand = self.demand[: len(self.pieces)]
            score = demand @ (left / self.limits**2)
            score[(demand > left).any(axis=1)] = -1
            k = int(score.argmax())
            if score[k] < 0:
                break
            piece = self._take(k)
            left -= piece[2], 1, self.loss(piece)
            chosen.append(piece)
        if self.pieces and left[0] > 0 and left[1] > 0:  # fill the gap with the front of the largest rest
            k = int(self.demand[: len(self.pieces), 0].argmax())
            example, start, length = self.pieces[k]
            if cut := self._fitting(example, start, min(length, int(left[0])), left[2]):
                self._take(k)
                chosen.append((example, start, cut))
                left[0] -= cut
                if cut < length:
                    self._put((example, start + cut, length - cut))
        return self._cut_back(chosen, int(self.capacity - left[0]))

    def _cut_back(self, chosen: list, length: int) -> list:
        """Without what makes the sequence longer than a power of two, unless it is full."""
        over = 0 if length == self.capacity else length - power_of_two(length)
        while over:
            example, start, n = chosen.pop()
            back = min(n, over)
            if back < n:
                chosen.append((example, start, n - back))
            self._put((example, start + n - back, back))
            over -= back
        return chosen


def pack(
    examples: DataFrame, tokenizer: str, end_id: int = 0, prompt: str | None = None, with_ids: bool = True,
    capacity: int = CAPACITY, max_segments: int = MAX_SEGMENTS, max_loss: int = MAX_LOSS, memo_pieces: int = MEMO_PIECES,
) -> DataFrame:
    """Pieces of (doc_id, text), with their place in a sequence and, with `with_ids`, their ids.

    `prompt` names a column whose tokens stand in front and bear no loss. `memo_pieces` is what an encoder remembers, memory for time.
    """
    columns = ["doc_id", F.coalesce("text", F.lit("")).alias("text")]
    columns += [F.coalesce(prompt, F.lit("")).alias("_prompt")] if prompt else []
    kinds = [pa.int64()] * 8 + [pa.binary()] * with_ids
    names = [x.split()[0] for x in SCHEMA.split(", ")] + ["ids"] * with_ids
    schema = pa.schema(list(zip(names, kinds)))

    def run(batches):
        encode, end = encoder(tokenizer, memo_pieces=memo_pieces), np.array([end_id], "<u4")
        packer = Packer(capacity, max_segments, max_loss)
        sequence = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []

        def emit(sequences):
            nonlocal sequence
            for pieces in sequences:
                offset = 0
                for piece in pieces:
                    example, start, length = piece
                    ids = example[1][start : start + length]
                    row = (example[0], start, length, packer.loss(piece), zlib.crc32(ids), example[3], sequence, offset)
                    rows.append((*row, ids.tobytes()) if with_ids else row)
                    offset += length
                sequence += 1

        def batch_of():
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], schema=schema)
            rows.clear()
            return made

        for batch in batches:
            pa.default_memory_pool().release_unused()  # what earlier batches and tasks of this worker took
            fronts = encode.each(batch.column("_prompt")) if prompt else itertools.repeat(end[:0])
            for name, own, front in zip(batch.column("doc_id").to_pylist(), encode.each(batch.column("text")), fronts):
                ids = np.concatenate([front, own, end])
                packer.add((name, ids, len(front), len(ids)))
                emit(packer.sequences())
                if len(rows) >= ROWS:
                    yield batch_of()
        emit(packer.sequences(final=True))
        if rows:
            yield batch_of()

    return examples.select(*columns).mapInArrow(run, SCHEMA + ", ids binary" * with_ids)
