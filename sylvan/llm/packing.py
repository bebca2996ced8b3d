"""Sum-of-squares online packing of documents into training sequences.

A sequence holds at most ``capacity`` tokens. Fill levels are tracked in one array N, N[h] the number of
open sequences with h tokens. A document of s tokens goes to the level h at which the sum of N[h]**2
afterwards is least (starting a sequence is level 0); this keeps levels spread out, so that a later
document finds a sequence that it fills up. Documents longer than the capacity first give whole sequences.

At most ``most_open`` sequences are open. When as many are and the document fits into none of them, it is cut: it
fills up the sequence at the level for which the sum of squares, with its rest as a level of its own, is then
least, and the rest is placed like a document. At the end of a partition no sequence is started any
more: the documents of the emptiest one are taken out and placed among the others by the same rule, until one
sequence is left; that goes to sequences of power-of-two length. So nothing is padded, every sequence comes
from the level rule, and ``closing`` marks those that were filled up at the end.

Each partition packs what it reads, in reading order, in one narrow pass: no shuffle, and a task that is
run again gives the same sequences. With ``by_file`` the files read have an order, that of their part
numbers: each split of a file is packed by itself and numbered by file and place, so sequence ids follow
files and splits however Spark deals the splits out to partitions. A partition keeps ids only of open sequences.

Defined results. Null text: empty, so its end id alone. Null doc_id: packed, its pieces have a null doc_id. Very
long texts: whole, in as many sequences as it takes. Repeated rows: each is packed. Ties between levels:
the fullest. Empty table: no rows. Columns of the input other than doc_id and text, whatever their names,
aren't read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from sylvan.llm import tokens
from sylvan.llm.arrow import in_arrow

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, closing boolean"
#: Open sequences at most.
MOST_OPEN = 64
#: Sequence ids are the partition's number times this, plus a number within the partition.
PER_PARTITION = 1 << 40
#: By file: the file's number times PER_PARTITION, plus the split's number times this, plus a number within the split.
PER_SPLIT = 1 << 28


class SumOfSquares:
    """Packs items one by one; ``closed`` gets each finished sequence, a list of (tag, start, ids), and whether it was filled up at the end."""

    def __init__(self, capacity: int, most_open: int = MOST_OPEN) -> None:
        self.capacity, self.most_open = capacity, max(1, most_open)
        self.level = np.zeros(capacity + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(capacity + 1)]
        self.n_open = 0
        self.closing = False
        self.closed: list[tuple[list, bool]] = []

    def best_level(self, size: int, may_start: bool = True) -> int | None:
        """The fill, 0 for a new sequence, at which the sum of squared counts grows least; None if no place is left for all of it."""
        n, c = self.level, self.capacity
        fits = np.flatnonzero(n[1 : c - size + 1]) + 1
        new = 0 if size == c else 2 * n[size] + 1
        if len(fits):
            to = np.where(fits + size < c, 2 * n[np.minimum(fits + size, c)] + 1, 0)
            growth = to - 2 * n[fits] + 1
            k = len(fits) - 1 - int(np.argmin(growth[::-1]))
            if not may_start or growth[k] <= new:
                return int(fits[k])
        return 0 if may_start else None

    def best_cut(self, size: int) -> int:
        """The fill of a sequence to fill up with the beginning of an item that fits nowhere whole."""
        n, c = self.level, self.capacity
        over = np.flatnonzero(n[c - size + 1 :]) + c - size + 1
        growth = 2 * n[over + size - c] - 2 * n[over]
        return int(over[len(over) - 1 - int(np.argmin(growth[::-1]))])

    def _take(self, fill: int) -> list:
        self.level[fill] -= 1
        self.n_open -= 1
        return self.open[fill].pop()

    def _file(self, window: list, fill: int) -> None:
        if fill == self.capacity:
            self.closed.append((window, self.closing))
        else:
            self.level[fill] += 1
            self.open[fill].append(window)
            self.n_open += 1

    def _place(self, tag: object, start: int, ids: np.ndarray) -> None:
        """An item of at most the capacity."""
        while True:
            h = self.best_level(len(ids), self.n_open < (1 if self.closing else self.most_open))
            if h is not None:
                window = self._take(h) if h else []
                window.append((tag, start, ids))
                return self._file(window, h + len(ids))
            h = self.best_cut(len(ids))
            room = self.capacity - h
            window = self._take(h)
            window.append((tag, start, ids[:room]))
            self._file(window, self.capacity)
            start, ids = start + room, ids[room:]

    def add(self, tag: object, ids: np.ndarray) -> None:
        c = self.capacity
        whole = len(ids) // c * c
        for a in range(0, whole, c):
            self.closed.append(([(tag, a, ids[a : a + c])], False))
        if whole < len(ids):
            self._place(tag, whole, ids[whole:])

    def finish(self) -> None:
        """Place the documents of the emptiest sequences among the others, and the last one's in powers of two."""
        self.closing = True
        while self.n_open > 1:
            for tag, start, ids in self._take(int(np.flatnonzero(self.level)[0])):
                self._place(tag, start, ids)
        if self.n_open:
            fill = int(np.flatnonzero(self.level)[0])
            pieces, left = self._take(fill), fill
            while left:
                room, window = 1 << (left.bit_length() - 1), []
                left -= room
                while room:
                    tag, start, ids = pieces.pop(0)
                    window.append((tag, start, ids[:room]))
                    if len(ids) > room:
                        pieces.insert(0, (tag, start + room, ids[room:]))
                    room -= min(room, len(ids))
                self.closed.append((window, True))
        self.closing = False


def file_numbers(files: Iterable[str]) -> dict[str, int]:
    """The place of each file, by its path, in the order of part numbers, then of names."""

    def place(path: str) -> tuple[int, str]:
        part = re.search(r"part-(\d+)[^/]*$", path)
        return (int(part[1]) if part else -1, path)

    return {p: k for k, p in enumerate(sorted({urlparse(f).path for f in files}, key=place))}


def split_start(numbers: dict[str, int], path: str, start: int, length: int, size: int) -> int:
    """The first sequence id of a file's split. All splits of a file but the last are of one length."""
    last = PER_PARTITION // PER_SPLIT - 1
    k, off = (last, 0) if start + length >= size else divmod(start, length)
    file = numbers[urlparse(path).path]
    if off or k > last or (k == last and start + length < size) or file >= 1 << 23:
        raise ValueError(f"no number for the split at {start} of {path}")
    return file * PER_PARTITION + k * PER_SPLIT


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = 2048, end_id: int = 1, most_open: int = MOST_OPEN, with_ids: bool = False, by_file: bool = False) -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, closing), and its ids if asked for.

    ``by_file`` needs a table as it is read from files, without a shuffle in between.
    """
    path = tokenizer or tokens.tokenizer_path()
    rows_in = docs.select("doc_id", "text")
    numbers: dict[str, int] = {}
    if by_file:
        m = docs.metadataColumn("_metadata")
        rows_in = docs.select("doc_id", "text", F.struct(*[m[c].alias(c) for c in ("file_path", "file_block_start", "file_block_length", "file_size")], F.input_file_block_start().alias("here")).alias("split"))
        numbers = file_numbers(docs.inputFiles())

    def runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple | None, int, int]]:
        """(split, first row, end) of the rows of one split after the other."""
        if not by_file:
            yield None, 0, batch.num_rows
            return
        keys = list(zip(*(c.to_pylist() for c in batch.column(2).flatten())))
        edges = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
        for a, b in zip(edges, [*edges[1:], len(keys)]):
            yield keys[a], a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = SumOfSquares(capacity, most_open)
        number = TaskContext.get().partitionId() * PER_PARTITION
        split, seen = None, set()
        end = np.array([end_id], np.int32)
        schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]).append(pa.field("closing", pa.bool_()))
        if with_ids:
            schema = schema.append(pa.field("ids", pa.list_(pa.int32())))

        def rows() -> pa.RecordBatch:
            nonlocal number
            out, pieces = [], []
            for window, closing in packer.closed:
                offset = 0
                for (doc, n), start, ids in window:
                    out.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n, number, offset, closing))
                    pieces.append(ids)
                    offset += len(ids)
                number += 1
            if split and number - split_start(numbers, *split[:-1]) > PER_SPLIT:
                raise ValueError(f"too many sequences in one split of {split[0]}")
            packer.closed = []
            columns = [pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 8, schema)]
            if with_ids:
                ends = np.cumsum([0, *map(len, pieces)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(pieces) if pieces else np.empty(0, np.int32))))
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for at, a, b in runs(batch):
                if at != split:
                    packer.finish()
                    yield rows()
                    if at in seen or at[-1] != at[1]:  # Spark knows no place in a file after a shuffle
                        raise ValueError("the table isn't as it was read: rows of splits may be apart")
                    seen.add(at)
                    split, number = at, split_start(numbers, *at[:-1])
                for i, ids in tokens.encoded(batch.column(1).slice(a, b - a), path):
                    packer.add((doc_ids[a + i], len(ids) + 1), np.concatenate([ids, end]))
                    if len(packer.closed) >= 1024:
                        yield rows()
                yield rows()
        packer.finish()
        yield rows()

    return in_arrow(rows_in, run, PIECES + ", ids array<int>" * with_ids)
