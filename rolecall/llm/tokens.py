"""Encoding whole texts with a public tokenizer file, a batch at a time, from a bounded memo of pieces.

A byte-level BPE never merges over the cut before a space that has a non-space on either side, so a text's ids are those
of its space-led pieces one after another. Arrow finds a batch's distinct pieces, each of them is looked up once, and numpy
puts the ids of all pieces in a row. A worker encodes a piece once while it remembers it. Texts that hold a space between
other white space are encoded in one piece.
"""

import re

from rolecall.llm.common import process_memo

#: Pieces that a worker remembers, some 200 bytes each, beside those of the texts it is at.
MEMO_PIECES = 200_000
#: Bytes of text that are put together at a time.
STRETCH_BYTES = 1 << 20


#: Bits of a byte's kind: may end white space, may begin white space (beyond ASCII any byte may end it, few may begin it),
#: is white space, is an ASCII letter, is one of the marks that stand after words.
ENDS, BEGINS, WHITE, LETTER, MARK = 1, 2, 4, 8, 16


def _kinds():
    import numpy as np

    out = np.zeros(256, np.uint8)
    out[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = ENDS | BEGINS | WHITE
    out[128:] |= ENDS
    out[[0xC2, 0xE1, 0xE2, 0xE3]] |= BEGINS
    for letter in range(ord("A"), ord("Z") + 1):
        out[[letter, letter + 32]] = LETTER
    out[list(b",.;:!?")] = MARK
    return out


def cuts_words(tokenizer) -> bool:
    """Whether a tokenizer cuts text by the rule of byte-level BPE, which keeps marks and single line ends apart from words."""
    before = tokenizer.pre_tokenizer
    return type(before).__name__ == "ByteLevel" and getattr(before, "use_regex", False) and not getattr(before, "add_prefix_space", True)


def gathered(values, starts, lengths):
    """values[start : start + length] of each, one after another."""
    import numpy as np

    last = np.cumsum(lengths, dtype=np.int64)
    return values[np.repeat(starts - last + lengths, lengths) + np.arange(last[-1] if len(last) else 0)]


class Encoder:
    """ids of texts as little-endian numbers, `width` bytes an id; `path` is a `tokenizers` file."""

    def __init__(self, path: str, width: int = 4, memo_pieces: int = MEMO_PIECES):
        import numpy as np
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # the name of a special token inside a text is text
        self.kind = np.dtype(f"<u{width}")
        if self.tokenizer.get_vocab_size() > 256**width:
            raise ValueError(f"{width} bytes do not hold the ids of {path}")
        self.memo_pieces, self.kinds, self.fine = memo_pieces, _kinds(), cuts_words(self.tokenizer)
        self.unsafe = re.compile(r"(?<!\S) (?!\S)")
        # tokens that begin with a space, as the vocabulary writes it
        self.opens = np.array([(self.tokenizer.id_to_token(k) or "").startswith("\u0120") for k in range(self.tokenizer.get_vocab_size())])
        self.slots: dict[bytes, int] = {}  # of remembered pieces: a place in the following
        self.starts, self.lengths, self.known = np.zeros(1024, np.int64), np.zeros(1024, np.int32), np.zeros(1 << 16, self.kind)
        self.asked = np.zeros(1024, np.int32)  # how often, since pieces were last forgotten
        self.used = 0

    def _raw(self, texts: list[str]) -> list:
        import numpy as np

        return [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, pieces: list[bytes]):
        """(pieces in another order, how many ids each has, all ids). Those that are a space and no other white space are encoded
        together and told apart by their leading spaces."""
        import numpy as np

        texts = [p.decode() for p in pieces]
        plain = [k for k, t in enumerate(texts) if t[:1] == " " and t.split() == [t[1:]]]
        rest = sorted(set(range(len(texts))) - set(plain))
        order, lengths, ids = [], [np.zeros(0, np.int32)], [np.zeros(0, self.kind)]
        parts = [plain[lo : lo + 1000] for lo in range(0, len(plain), 1000)]
        for part, one in zip(parts, self.tokenizer.encode_batch_fast(["".join([texts[k] for k in part]) for part in parts], add_special_tokens=False)):
            together = np.array(one.ids)
            starts = np.flatnonzero(self.opens[together])
            if len(starts) != len(part):
                rest += part
                continue
            order += part
            lengths.append(np.diff(starts, append=len(together)))
            ids.append(together)
        each = self._raw([texts[k] for k in rest])
        order += rest
        return [pieces[k] for k in order], np.concatenate([*lengths, [len(x) for x in each]]).astype(np.int32), np.concatenate(ids + each).astype(self.kind)

    def _remember(self, pieces: list[bytes], lengths, ids) -> None:
        import numpy as np

        n = len(self.slots)
        while n + len(pieces) > len(self.starts):
            self.starts, self.lengths, self.asked = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths, self.asked))
        while self.used + len(ids) > len(self.known):
            self.known = np.concatenate([self.known, np.zeros_like(self.known)])
        self.lengths[n : n + len(pieces)] = lengths
        self.starts[n : n + len(pieces)] = self.used + np.cumsum(lengths) - lengths
        self.known[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.slots.update(zip(pieces, range(n, n + len(pieces))))

    def _looked_up(self, pieces: list[bytes]):
        """(starts, lengths, ids): where the ids of each piece lie."""
        import numpy as np

        get = self.slots.get
        slots = list(map(get, pieces))
        new = [p for p, slot in zip(pieces, slots) if slot is None]
        if new:
            if len(self.slots) + len(new) > self.memo_pieces or self.used > 8 * self.memo_pieces:
                self._forget(pieces)
            self._remember(*self._pieces(new))
            slots = [self.slots[p] for p in pieces]
        at = np.array(slots, np.int64)
        self.asked[at] += 1
        return self.starts[at], self.lengths[at], self.known

    def _forget(self, at_hand: list[bytes]) -> None:
        """Keep what was asked for most often, half of the memo at most, and the pieces at hand."""
        import numpy as np

        asked = self.asked[: len(self.slots)]
        bar = max(2, int(np.partition(asked, len(asked) // 2)[len(asked) // 2]) + 1) if len(asked) else 2
        stay = asked >= bar
        stay[[slot for slot in map(self.slots.get, at_hand) if slot is not None]] = True
        kept = [p for p, there in zip(self.slots, stay.tolist()) if there]
        lengths = self.lengths[: len(asked)][stay]
        ids = gathered(self.known, self.starts[: len(asked)][stay], lengths)
        self.slots, self.used = {}, 0
        self.asked[:] = 0
        self._remember(kept, lengths, ids)

    def each(self, texts):
        """The ids of one text after another of an Arrow string column without nulls."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        column = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        ends = np.cumsum(np.r_[0, pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)])
        at = 0
        while at < len(column):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + STRETCH_BYTES, "right")) - 1)
            yield from self._stretch(column.slice(at, to - at), ends[at : to + 1] - ends[at])
            at = to

    def _stretch(self, column, ends) -> list:
        import numpy as np
        import pyarrow as pa

        first = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset]
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[first : first + ends[-1]]
        # pieces begin with a space or with a text
        begins = data == 32
        spaces = np.flatnonzero(begins)
        opening, closing = np.zeros(len(data) + 1, bool), np.zeros(len(data) + 1, bool)
        opening[ends], closing[ends] = True, True
        kinds = self.kinds[data]
        beside = lambda at, step: kinds[np.clip(at + step, 0, max(0, len(data) - 1))]
        after_white, before_white = (beside(spaces, -1) & ENDS) > 0, (beside(spaces, 1) & BEGINS) > 0
        doubtful = spaces[(after_white | opening[spaces]) & (before_white | closing[spaces + 1])]
        if self.fine:
            # a mark after a letter and before white space, and a line end between words, are pieces as well
            marks = np.flatnonzero(kinds == MARK)
            marks = marks[(beside(marks, -1) == LETTER) & ~opening[marks] & (((beside(marks, 1) & WHITE) > 0) | closing[marks + 1])]
            lines = np.flatnonzero(data == 10)
            lines = lines[((beside(lines, -1) & ENDS) == 0) & ((beside(lines, 1) & BEGINS) == 0) & ~opening[lines] & ~closing[lines + 1]]
            begins[marks], begins[lines], begins[lines + 1] = True, True, True
        begins[ends[:-1][np.diff(ends) > 0]] = True
        cuts = np.flatnonzero(begins)
        pieces = pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(np.r_[cuts, len(data)].astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
        which = pieces.indices.to_numpy()
        starts, lengths, known = self._looked_up(pieces.dictionary.to_pylist())
        lengths = lengths[which]
        ids = gathered(known, starts[which], lengths)
        borders = np.r_[0, np.cumsum(lengths, dtype=np.int64)][np.searchsorted(cuts, ends)]
        out = [ids[a:b] for a, b in zip(borders[:-1].tolist(), borders[1:].tolist())]
        for k in np.unique(np.searchsorted(ends, doubtful, "right") - 1).tolist():
            text = column[k].as_py()
            if self.unsafe.search(text):
                out[k] = self._raw([text])[0]
        return out

    def __call__(self, text: str) -> bytes:
        import pyarrow as pa

        return next(self.each(pa.array([text], pa.string()))).tobytes()


def encoder(path: str, width: int = 4, memo_pieces: int = MEMO_PIECES) -> Encoder:
    """The worker's encoder for a file."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return process_memo(f"encoder:{path}:{width}:{memo_pieces}", lambda: Encoder(path, width, memo_pieces))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
