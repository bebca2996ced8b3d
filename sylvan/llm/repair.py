"""Token ids in a binary format, compressed by Re-Pair grammars.

A shard holds the ids of consecutive documents. Frequent pairs of neighbouring ids are replaced by new
symbols (nonterminals), then frequent pairs of what is left, round after round; the shard stores the rules,
each rule's expansion length, the rewritten sequence and a table of its documents. No rule spans two
documents, so a document, or a range of its tokens found through the expansion lengths, is decoded by
itself.

All pairs of the shard are counted by a sort, and the counts of frequent ones kept up to date from then on. One
step takes the most frequent pair and those at least a ``SHARE``-th as frequent, and replaces their occurrences without overlaps, where two meet the more frequent
pair; a pair that the others leave with fewer than ``LEAST`` occurrences waits for a later step. Steps end when no pair can be
replaced ``LEAST`` times, so a passage that is repeated often becomes one symbol however long it is.

File format, little-endian: magic, then counts as u64 (first symbol, rules, documents, symbols), then
rules (two u32 each), expansion lengths (u32), doc_ids (i64), null flags (u8), tokens and symbols of each
document (u64 each), symbols (low 16 bits of each, then high 8 bits of each). A shard is one row of a
Parquet table, so that any store that Spark writes to can hold it and a lost task's output is never read.

Defined results. Null text: empty, the end id alone. Null doc_id: comes first. Repeated rows: each is
written, in order of text, so that a doc_id (null too) of very many rows is spread over ranges. Very long texts:
whole, in a shard of their own size. Empty table: no shards. Columns other than doc_id and text, whatever their
names, aren't read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from sylvan.llm import tokens
from sylvan.llm.arrow import in_arrow
from sylvan.session import table_path

MAGIC = b"RPGRAM01"
SHARE, LEAST = 4, 8
#: Passes over the places of a step in which more frequent pairs go first.
PASSES = 24
#: Symbols that the file format can tell apart.
MOST_SYMBOLS = 1 << 24
#: Tokens after which a shard is closed; a document is never split.
SHARD_TOKENS = 1_000_000
SHARDS = "part int, shard int, first_doc long, last_doc long, n_docs long, n_tokens long, payload binary"


@dataclass
class Shard:
    base: int
    rules: np.ndarray  # (n, 2): the two symbols of each nonterminal, all of them smaller than it
    lengths: np.ndarray  # tokens in each nonterminal's expansion
    doc_ids: list
    tokens: np.ndarray  # of each document
    symbols: np.ndarray  # of each document
    sequence: np.ndarray

    def __post_init__(self) -> None:
        self._flat: tuple[np.ndarray, np.ndarray] | None = None

    def _expansions(self) -> tuple[np.ndarray, np.ndarray]:
        """All symbols' expansions one after the other, ids first, and where each begins."""
        if self._flat is None:
            seq = np.arange(self.base, self.base + len(self.rules))
            while len(at := np.flatnonzero(seq >= self.base)):
                n = np.ones(len(seq), np.int64)
                n[at] = 2
                place = np.cumsum(n) - n
                out = np.empty(int(n.sum()), np.int64)
                out[place] = seq
                pair = self.rules[seq[at] - self.base]
                out[place[at]], out[place[at] + 1] = pair[:, 0], pair[:, 1]
                seq = out
            begin = np.concatenate([np.arange(self.base), self.base + np.cumsum(self.lengths) - self.lengths])
            self._flat = np.concatenate([np.arange(self.base), seq]).astype(np.int32), begin
        return self._flat

    def expand(self, seq: np.ndarray) -> np.ndarray:
        flat, begin = self._expansions()
        n = np.concatenate([np.ones(self.base, np.int64), self.lengths])[seq]
        ends = np.cumsum(n)
        return flat[np.repeat(begin[seq] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]

    def document(self, k: int) -> np.ndarray:
        at = int(self.symbols[:k].sum())
        return self.expand(self.sequence[at : at + int(self.symbols[k])])

    def part(self, k: int, start: int, stop: int) -> np.ndarray:
        """Tokens [start, stop) of document k, expanding only the symbols that reach into them."""
        at = int(self.symbols[:k].sum())
        seq = self.sequence[at : at + int(self.symbols[k])]
        size = np.ones(len(seq), np.int64)
        big = seq >= self.base
        size[big] = self.lengths[seq[big] - self.base]
        end = np.cumsum(size)
        a, b = np.searchsorted(end, start, "right"), np.searchsorted(end, stop, "left") + 1
        skip = start - (int(end[a - 1]) if a else 0)
        return self.expand(seq[a:b])[skip : skip + stop - start]


def _alone(at: np.ndarray, follow: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The numbers of the places that each pair would take if there were no others: every second one of its own runs.

    ``follow`` is the place after each one.
    """
    start = np.ones(len(at), bool)
    start[1:] = (at[1:] != follow[:-1]) | (rank[1:] != rank[:-1])
    place = np.arange(len(at))
    return np.flatnonzero((place - np.maximum.accumulate(np.where(start, place, 0))) % 2 == 0)


def _matched(at: np.ndarray, follow: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which of the places are taken without overlaps when, where two meet, the pair of lower rank goes first."""
    taken, left = np.zeros(len(at), bool), np.arange(len(at))
    for _ in range(PASSES):
        if not len(left):
            return taken
        near, r = at[left[1:]] == follow[left[:-1]], rank[left]
        after, before = np.append(near, False), np.append(False, near)
        best = ~(before & (np.append(0, r[:-1]) < r)) & ~(after & (np.append(r[1:], 0) < r))
        taken[left[best]] = True
        left = left[~(best | after & np.append(best[1:], False) | before & np.append(False, best[:-1]))]
    if len(left):  # what is still undecided in a long chain of ever rarer pairs: left to right
        place = np.arange(len(left))
        start = np.append(True, at[left[1:]] != follow[left[:-1]])
        taken[left[(place - np.maximum.accumulate(np.where(start, place, 0))) % 2 == 0]] = True
    return taken


def _grouped(seq: np.ndarray, after: np.ndarray, place: np.ndarray, top: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs that begin at these places ``least`` times: (pair, how often, its places in order, pair after pair)."""
    left, right = seq[place].astype(np.int64), seq[after[place]]
    bits, room = int(top).bit_length(), len(seq).bit_length()
    if 2 * bits + room <= 63:  # pair and place in one number
        rows = ((left << bits | right) << room) | place
        rows.sort()
        place, key = rows & ((1 << room) - 1), rows >> room
        edge = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        pair = (key[edge] >> bits << 32) | (key[edge] & ((1 << bits) - 1))
    else:
        order = np.lexsort((place, right, left))
        place, key = place[order], (left[order] << 32) | right[order]
        edge = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        pair = key[edge]
    count = np.diff(np.append(edge, len(place)))
    return pair[count >= least], count[count >= least], place[np.repeat(count >= least, count)]


def compress(ids: np.ndarray, doc_tokens: np.ndarray, doc_ids: list, least: int = LEAST, share: int = SHARE) -> Shard:
    """The grammar of one shard. ``ids`` are all documents' ids, ``doc_tokens`` how many each has."""
    base = int(ids.max()) + 1 if len(ids) else 1
    seq = ids.astype(np.int32)
    last = np.zeros(len(seq), bool)
    last[np.cumsum(doc_tokens)[doc_tokens > 0] - 1] = True
    rules, lengths, top = [np.empty((0, 2), np.int64)], [np.empty(0, np.int64)], base
    least = max(2, least)
    # symbols that a replacement takes out leave their place empty; these are the places around each one, end for none
    end = len(seq)
    after, before = np.arange(1, end + 2, dtype=np.int32), np.arange(-1, end, dtype=np.int32)
    after[:-1][last] = end
    before[1:][last] = end
    before[0] = end
    seq, mark = np.append(seq, -1), np.zeros(end + 1, bool)
    # frequent pairs by number: the pair, how often it occurs now, and where the places are at which it was found;
    # number tells which of them is still there
    pair, count, found = _grouped(seq, after, np.flatnonzero(~last), top, least)
    first, size = np.cumsum(count) - count, count.copy()
    number = np.full(end + 1, -1, np.int32)
    number[found] = np.repeat(np.arange(len(pair)), size)
    places, used = np.empty(3 * end + 1, np.int32), len(found)  # a replacement makes two places at most
    places[:used] = found
    while len(count) and count.max() >= least and top < MOST_SYMBOLS:
        often = np.flatnonzero(count >= max(least, count.max() / share))
        often = often[np.argsort(-count[often], kind="stable")[: MOST_SYMBOLS - top]]
        n = size[often]
        order = np.repeat(np.arange(len(often)), n)
        at = places[np.repeat(first[often] - np.cumsum(n) + n, n) + np.arange(len(order))]
        there = number[at] == often[order]
        rows = (at[there].astype(np.int64) << 32) | order[there]
        rows.sort()
        at, order = rows >> 32, rows & 0xFFFFFFFF
        some = _alone(at, after[at], order)
        at, order = at[some], order[some]
        few = np.bincount(order, minlength=len(often)) < least
        if few.any():  # pairs that overlap themselves, as in a run of one symbol
            count[often[few]] = 0
            at, order = at[~few[order]], order[~few[order]]
        taken = _matched(at, after[at], order)
        at, order = at[taken], order[taken]
        enough = np.bincount(order, minlength=len(often)) >= least
        at, order = at[enough[order]], order[enough[order]]
        if not len(at):
            continue
        new, names = (np.cumsum(enough) - 1)[order], often[enough]
        both = np.stack([pair[names] >> 32, pair[names] & 0xFFFFFFFF], axis=1)
        known = np.concatenate([np.ones(base, np.int64), *lengths])
        out = after[at]
        mark[out] = True
        ahead = before[at]
        gone = np.concatenate([at, out, ahead[~mark[ahead] & (ahead != end)]])
        mark[out] = False
        was = number[gone]
        count -= np.minimum(np.bincount(was[was >= 0], minlength=len(count)), count)
        number[gone] = -1
        seq[at], seq[out] = top + new, -1
        beyond = after[out]
        after[at] = beyond
        before[beyond] = at
        mark[at] = True
        ahead = before[at]
        made = np.concatenate([at, ahead[~mark[ahead] & (ahead != end)]])
        mark[at] = False
        top += len(names)
        more, times, found = _grouped(seq, after, made[after[made] != end], top, least)
        if len(more):
            number[found] = len(count) + np.repeat(np.arange(len(more)), times)
            first, size = np.concatenate([first, used + np.cumsum(times) - times]), np.concatenate([size, times])
            pair, count = np.concatenate([pair, more]), np.concatenate([count, times])
            places[used : used + len(found)] = found
            used += len(found)
        rules.append(both)
        lengths.append(known[both].sum(axis=1))
    there = seq >= 0
    symbols = np.diff(np.append(0, np.cumsum(there[:-1]))[np.append(0, np.cumsum(doc_tokens))])
    return Shard(base, np.concatenate(rules), np.concatenate(lengths), doc_ids, doc_tokens, symbols, seq[there])


def dump(s: Shard) -> bytes:
    if s.base + len(s.rules) > MOST_SYMBOLS:
        raise ValueError("a shard has too many symbols for 24 bits")
    known = np.array([0 if d is None else d for d in s.doc_ids], "<i8")
    null = np.array([d is None for d in s.doc_ids], np.uint8)
    parts = [s.rules.astype("<u4"), s.lengths.astype("<u4"), known, null, s.tokens.astype("<u8"), s.symbols.astype("<u8"), (s.sequence & 0xFFFF).astype("<u2"), (s.sequence >> 16).astype(np.uint8)]
    return MAGIC + struct.pack("<4Q", s.base, len(s.rules), len(s.doc_ids), len(s.sequence)) + b"".join(p.tobytes() for p in parts)


def load(raw: bytes) -> Shard:
    if raw[:8] != MAGIC:
        raise ValueError("not a grammar shard")
    base, n_rules, n_docs, n_symbols = struct.unpack("<4Q", raw[8:40])
    at = 40

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(raw, kind, n, at)
        at += out.nbytes
        return out

    rules, lengths = take("<u4", 2 * n_rules).reshape(-1, 2).astype(np.int64), take("<u4", n_rules).astype(np.int64)
    known, null = take("<i8", n_docs).tolist(), take("u1", n_docs).tolist()
    n_tokens, symbols = take("<u8", n_docs).astype(np.int64), take("<u8", n_docs).astype(np.int64)
    low, high = take("<u2", n_symbols), take("u1", n_symbols)
    return Shard(base, rules, lengths, [None if x else d for d, x in zip(known, null)], n_tokens, symbols, low.astype(np.int64) | (high.astype(np.int64) << 16))


def encode_shards(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Shards of the documents in ascending doc_id order: part, then shard, is the global order."""
    path = tokenizer or tokens.tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        owners: list = []
        size, end = 0, np.array([end_id], np.int32)
        schema = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("payload", pa.binary())])

        def close() -> pa.RecordBatch:
            nonlocal held, owners, size, number
            s = compress(np.concatenate(held), np.array([len(x) for x in held], np.int64), owners)
            row = [part, number, owners[0], owners[-1], len(owners), size, dump(s)]
            held, owners, size, number = [], [], 0, number + 1
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for i, ids in tokens.encoded(batch.column(1), path):
                held.append(np.concatenate([ids, end]))
                owners.append(doc_ids[i])
                size += len(ids) + 1
                if size >= shard_tokens:
                    yield close()
        if held:
            yield close()

    rows = docs.select("doc_id", "text")
    # the text's beginning only says which range a row goes to; ties within it are sorted by the whole text
    return in_arrow(rows.repartitionByRange("doc_id", F.substring("text", 1, 40)).sortWithinPartitions("doc_id", "text"), run, SHARDS)


def write_shards(docs: DataFrame, path: str, **how) -> None:
    encode_shards(docs, **how).write.option("compression", "zstd").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHARDS).parquet(path)


def decode_documents(shards: DataFrame) -> DataFrame:
    """Per document, from the shards: doc_id, its place, its number of ids and their checksum.

    The ids of all documents before a shard are summed in two steps, within a part and over the parts, of
    which there are as many as tasks wrote.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, shard, raw in zip(*(batch.column(c).to_pylist() for c in (0, 1, 2))):
                s = load(raw)
                ids = s.expand(s.sequence).astype("<u4")
                ends = np.cumsum(s.tokens)
                crc = [zlib.crc32(ids[b - n : b].tobytes()) for b, n in zip(ends.tolist(), s.tokens.tolist())]
                n = len(s.doc_ids)
                yield pa.RecordBatch.from_pydict({"part": pa.array([part] * n, pa.int32()), "shard": pa.array([shard] * n, pa.int32()), "doc_id": pa.array(s.doc_ids, pa.int64()), "within": pa.array(ends - s.tokens), "n_tokens": pa.array(s.tokens), "ids_crc32": pa.array(crc, pa.int64())})

    rows = in_arrow(shards.select("part", "shard", "payload"), run, "part int, shard int, doc_id long, within long, n_tokens long, ids_crc32 long")
    sizes = shards.select("part", "shard", "n_tokens")
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", before(W.orderBy("part")).alias("of_part"))
    places = sizes.withColumnRenamed("n_tokens", "n").select("part", "shard", before(W.partitionBy("part").orderBy("shard")).alias("of_shard")).join(parts, "part")
    return rows.join(places, ["part", "shard"]).select("doc_id", (F.col("of_part") + F.col("of_shard") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def through_files(docs: DataFrame, **how) -> DataFrame:
    """Write the documents' shards to the shared folder and read them back."""
    path = table_path(docs.sparkSession, "token-shards")
    write_shards(docs, path, **how)
    return decode_documents(read_shards(docs.sparkSession, path))
