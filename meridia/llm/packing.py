"""Sum-of-squares online packing of tokenised documents into sequences.

Each task packs the rows it reads, in their order: a document's tokens (its text's ids and the
end id) are cut into whole sequences and a rest, and the rest is placed into the open sequence whose
fill level makes the sum of squared counts of open sequences by level smallest. The level array holds
those counts. At most OPEN sequences are open: when the rule asks for one more, the rest is cut so that it fills a
sequence of the level with the most (ties: the fullest), the choice that makes the sum smallest, and what is left of it is placed by the rule again.

What is still open at the task's end, fewer than OPEN times the length in tokens whatever the task has read, is joined, cut at the sequence length, and
the last tokens go to sequences of power-of-two lengths, which need no padding; the column at_end marks their pieces.

There is no shuffle, so no key can be hot, and a task that runs again makes the same rows:
sequence_id is the task's number and a running number. Memory: one slice of texts and OPEN sequences.

Null and empty texts are the end id alone. Repeated rows are packed again. Strings of special
tokens in a text are ordinary text. Other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text
from .common import slices

LENGTH, END = 4096, 2
#: Sequences that a task keeps open: 1 MB of ids.
OPEN = 64
#: Pieces of words whose ids a worker remembers.
REMEMBERED = 1_000_000
#: A character that is a pre-token of its own between spaces.
MARK = "\0"
#: Byte classes: 0 white space, 1 ASCII letter, 2 ASCII digit, 3 other ASCII, 4 apostrophe or part of another character.
CLASS = np.array([0 if text.SPACE[c] else 4 if c > 127 or c == 39 else 1 if chr(c).isalpha() else 2 if chr(c).isdigit() else 3 for c in range(256)], np.uint8)
#: Whether two neighbouring bytes of these classes always belong to different pre-tokens.
PARTS = np.zeros((5, 5), bool)
for _a, _b in ((1, 3), (3, 1), (1, 2), (2, 1), (2, 2), (2, 3), (3, 2)):
    PARTS[_a, _b] = True
SPLIT = PARTS.ravel()


class WordTokens:
    """Ids of whole texts from a tokenizer that treats pre-tokens one by one and drops white space.

    Texts are split where pre-tokens surely end; each distinct piece is encoded once by the
    library and remembered, so the ids equal those of encoding the whole text.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids[0]
        self.clear()

    def clear(self) -> None:
        self.known: dict[int, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.at = np.zeros(2, np.int64)

    def _learn(self, hashes: list[int], pieces: list[str]) -> None:
        """Encode distinct pieces in one call, a mark between each two, and remember their ids."""
        marked = [x for x in pieces if MARK in x]  # these would be cut; they are encoded alone
        rows = self.tokenizer.encode_batch_fast([f" {MARK} ".join(x for x in pieces if MARK not in x), *marked], add_special_tokens=False)
        ids = np.array(rows[0].ids, np.uint32)
        ends = np.append(np.flatnonzero(ids == self.mark), len(ids))
        starts = np.append(0, ends[:-1] + 1)
        lens = np.array([len(x.ids) for x in rows[1:]], np.int64)
        if len(marked) < len(pieces):
            alone = np.array([MARK in x for x in pieces])
            order = np.argsort(alone, kind="stable")
            hashes = [hashes[i] for i in order]
            lens = np.concatenate([ends - starts, lens])
        new = np.concatenate([ids[ids != self.mark], *[np.array(x.ids, np.uint32) for x in rows[1:]]])
        n = len(self.known)
        start = int(self.at[n])
        ends = start + np.cumsum(lens)
        if ends[-1] > len(self.ids):
            self.ids = np.resize(self.ids, max(int(ends[-1]), 2 * len(self.ids)))
        if n + len(lens) + 1 > len(self.at):
            self.at = np.resize(self.at, max(n + len(lens) + 1, 2 * len(self.at)))
        self.ids[start : ends[-1]] = new
        self.at[n + 1 : n + 1 + len(lens)] = ends
        self.known.update(zip(hashes, range(n, n + len(lens))))

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column of texts and the n + 1 bounds by text."""
        data, offsets = text.buffer(col)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        kind = CLASS[data]
        first = kind != 0
        first[1:] &= SPLIT[kind[:-1] * 5 + kind[1:]] | (kind[:-1] == 0)
        cut = offsets[1:-1]
        cut = cut[cut < len(data)]
        first[cut] = kind[cut] != 0
        starts = np.flatnonzero(first)
        # a piece ends at the next piece, white space or the text's end
        edge = np.append(first | (kind == 0), True)
        edge[offsets] = True
        bounds = np.flatnonzero(edge)
        ends = bounds[np.cumsum(edge)[starts]]
        hashes = text.hash_spans(data, starts, ends)
        order = np.argsort(hashes)
        ordered = hashes[order]
        new = np.append(True, ordered[1:] != ordered[:-1])
        unique, where = ordered[new], order[new]
        inverse = np.empty(len(order), np.int64)
        inverse[order] = np.cumsum(new) - 1
        if len(self.known) + len(unique) > REMEMBERED:
            self.clear()
        asked = unique.tolist()
        index = [self.known.get(h, -1) for h in asked]
        new = [i for i, x in enumerate(index) if x < 0]
        if new:
            raw = data.tobytes()
            self._learn([asked[i] for i in new], [raw[starts[where[i]] : ends[where[i]]].decode() for i in new])
            for i in new:
                index[i] = self.known[asked[i]]
        piece = np.array(index, np.int64)[inverse]
        begin, lens = self.at[piece], self.at[piece + 1] - self.at[piece]
        total = np.concatenate([[0], np.cumsum(lens)])
        ids = self.ids[np.repeat(begin - total[:-1], lens) + np.arange(total[-1])]
        return ids, total[np.searchsorted(starts, offsets)]


_TOKENS: dict[str, WordTokens] = {}


def tokens(path: str) -> WordTokens:
    if path not in _TOKENS:
        _TOKENS[path] = WordTokens(path)
    return _TOKENS[path]


Piece = tuple[int, int, np.ndarray, int]  # document, start, ids, tokens of the document


class SumOfSquares:
    """Open sequences by fill level; add() and finish() return those that are complete."""

    def __init__(self, length: int = LENGTH, most: int = OPEN) -> None:
        self.length, self.most, self.count = length, most, 0
        self.level = np.zeros(length + 1, np.int64)  # open sequences by fill; the full ones don't count
        self.open: list[list[list[Piece]]] = [[] for _ in range(length + 1)]

    def best(self, size: int) -> int:
        """The level whose sequence should take size tokens; 0: a new one. Ties go to the fullest."""
        n, top = self.level, self.length - size
        gain = 2 * (n[size : self.length + 1] - n[: top + 1])  # the change of the sum of squares, less 2
        gain[top] -= 1  # a full sequence is not counted
        gain[0] = 2 * n[size] - 1
        used = np.flatnonzero(n[: top + 1])
        if not len(used):
            return 0
        pick = used[::-1][np.argmin(gain[used][::-1])]
        return int(pick) if gain[pick] <= gain[0] else 0

    def add(self, doc: int, ids: np.ndarray) -> list[list[Piece]]:
        total, done = len(ids), []
        whole = total // self.length * self.length
        for start in range(0, whole, self.length):
            done.append([(doc, start, ids[start : start + self.length], total)])
        while whole < total:
            size = total - whole
            at = self.best(size)
            if not at and self.count >= self.most:
                at = int(self.length - np.argmax(self.level[::-1]))
                size = min(size, self.length - at)
            done += self._place((doc, whole, ids[whole : whole + size], total), at)
            whole += size
        return done

    def _place(self, piece: Piece, at: int) -> list[list[Piece]]:
        size = len(piece[2])
        if at:
            self.level[at] -= 1
            self.count -= 1
            taken = self.open[at].pop()
        else:
            taken = []
        taken.append(piece)
        if at + size == self.length:
            return [taken]
        self.level[at + size] += 1
        self.count += 1
        self.open[at + size].append(taken)
        return []

    def finish(self) -> list[list[Piece]]:
        """Join what is open, cut it at the length, and the rest at powers of two."""
        rest = [p for level in reversed(self.open) for taken in level for p in taken]
        left, done = sum(len(p[2]) for p in rest), []
        self.__init__(self.length, self.most)
        sizes = [self.length] * (left // self.length) + [1 << b for b in reversed(range(self.length.bit_length())) if left % self.length >> b & 1]
        for size in sizes:
            taken: list[Piece] = []
            while size:
                doc, start, ids, total = rest.pop()
                if len(ids) > size:
                    rest.append((doc, start + size, ids[size:], total))
                    ids = ids[:size]
                taken.append((doc, start, ids, total))
                size -= len(ids)
            done.append(taken)
        return done


NAMES = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "at_end", "ids"]
_TYPES = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, at_end boolean"


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end: int = END, keep_ids: bool = True) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, at_end and, if kept, its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 40
        packer, encode = SumOfSquares(length), tokens(path).encode

        def rows(done: list[list[Piece]], at_end: bool) -> pa.RecordBatch:
            nonlocal number
            cols: list[list] = [[] for _ in NAMES]
            for taken in done:
                offset = 0
                for doc, start, ids, total in taken:
                    for col, x in zip(cols, (doc, start, len(ids), zlib.crc32(ids.astype("<u4")), total, number, offset, at_end, ids)):
                        col.append(x)
                    offset += len(ids)
                number += 1
            arrays = [*(pa.array(c, pa.int64()) for c in cols[:7]), pa.array(cols[7], pa.bool_())]
            if keep_ids:
                arrays.append(pa.array([x.astype(np.int32) for x in cols[8]], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(arrays, names=NAMES[: len(arrays)])

        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                ids, bounds = encode(part.column("text"))
                done = []
                for i, doc in enumerate(part.column("id").to_pylist()):
                    done += packer.add(doc, np.append(ids[bounds[i] : bounds[i + 1]], np.uint32(end)))
                if done:
                    yield rows(done, False)
        yield rows(packer.finish(), True)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, _TYPES + (", ids array<int>" if keep_ids else "")).withColumnRenamed("id", id_col)
