"""Near-duplicate documents by DartMinHash signatures, banded joining, and exact verification.

A text is the multiset of its five-word windows (words are runs of characters other than space and
\\x09-\\x0D), a window's weight being how often it occurs; without ``weighted``, their set. DartMinHash throws
darts, fixed by hashing, at a plane for each element: one axis is weight, the other rank, with one dart per
unit area on average. Of the darts below the element's weight, each belongs to one of ``k`` coordinates, and a
coordinate's value is its dart of least rank. Two texts agree in a coordinate with the probability of their
weighted Jaccard similarity (the sum of the lesser weights over that of the greater). A text needs about
k ln k + 2k darts however many elements it has; if a coordinate stays empty, ranks are doubled for that text.

Linking. Equal word sequences are one node (128-bit fingerprint), so copies cost nothing further. Nodes
that share a band of coordinates form a bucket; its members are first checked against one hub, the member
with most company in all its buckets, so a group of n near copies needs about n checks and not n**2. Every
link is verified by the exact similarity. Members of buckets that are then still in several components are
joined exactly, by a prefix and position filter over their windows and a bound on their difference, against all
others in such buckets, so that no link that a bucket shows is lost; this costs rows only for pairs that may be
links, not for all pairs of a bucket, and a window that very many texts share is dealt to several tasks. Links make
classes by connected components. What isn't saved: in a family of texts around the threshold, those without a link
are still compared, inside the join, with every member whose prefix shares a window with theirs.

Scale. Signatures are one narrow pass. Band keys are combined before their exchange: within a task, nodes
that share a key are marked and only one of them is sent on, so a bucket with a third of all texts leaves a
row for each task; one exchange by key shows the other buckets, and single members end there. Texts move
only for nodes in a bucket: a bit for each hashed fingerprint that is needed (of at most ``FILTER_BITS``,
whatever the input) goes to the scan and drops the others before the exchange; beyond that size the filter
lets more texts pass and loses none. Tables are deleted when all that read them are written.

Defined results. Null text, or a text without words: a class of its own, no links. Fewer than five words: one
window of all words. Very long texts: whole, each by itself in memory. Repeated rows: copies. Null doc_id:
takes part; a class's id is its least non-null doc_id, null if it has none. Ties go to the smaller fingerprint
or doc_id; of rows with one doc_id and the same words, the one with the least hash of all its columns stays.
Empty table: no rows. Other columns, whatever their names, aren't read by ``near_duplicates`` and are kept as
they are by ``drop_near_duplicates``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType

from sylvan.llm import text as T
from sylvan.llm.arrow import in_arrow
from sylvan.llm.columns import extended, named, without
from sylvan.operators.connect import components
from sylvan.session import cut, free, via_table

#: Five words, similarity of 0.8; 32 bands of 6 coordinates miss a pair at 0.8 with probability 6e-5.
WORDS, SIMILARITY, BANDS, ROWS = 5, 0.8, 32, 6
#: Texts whose darts are thrown at once; a text has about k ln k + 2k of them however short it is.
DART_TEXTS = 64
#: Documents whose band keys a task combines at a time.
COMBINED = 1 << 15
#: Bits of the filter of fingerprints at most (16 MB), and bits of one of its slices.
FILTER_BITS, SLICE_BITS = 1 << 27, 1 << 16
#: Counters that order windows by rarity, and the slices in which they are added up.
COUNTERS, COUNTER_SLICES = 1 << 20, 256
#: Texts that share a window, and times the mean counter, above which the window is dealt to several tasks, at most so many.
HOT, HOT_TIMES, MOST_DEALT = 2048, 8, 64
#: 64-bit numbers of a set's parity sketch, which bounds the difference of two sets from below.
SKETCH = 16
_SEEDS = [T.seeded(s) for s in range(8)]


def _poisson_table() -> np.ndarray:
    """Cumulative probabilities of a Poisson variable of mean 1, as 64-bit bounds."""
    p, total, out = np.exp(-1.0), 0.0, []
    for n in range(18):
        total += p
        out.append(min(int(total * 2.0**64), (1 << 64) - 1))
        p /= n + 1
    return np.array(out, np.uint64)


_POISSON = _poisson_table()


def dart_signatures(element: np.ndarray, weight: np.ndarray, owner: np.ndarray, n: int, k: int) -> np.ndarray:
    """(n, k) DartMinHash values of n weighted sets given as parallel arrays, in order of owner; sets without elements get all ones.

    The plane of an element is cut into unit cells; a cell's number of darts is Poisson of mean 1 and each
    dart has a weight, a rank and a coordinate, all from hashes of (element, cell, number). A value is the
    rank, in 1/2**44, which tells darts apart.
    """
    if n > DART_TEXTS:
        cuts = np.searchsorted(owner, np.arange(0, n + DART_TEXTS, DART_TEXTS))
        parts = [(element[a:b], weight[a:b], owner[a:b] - i * DART_TEXTS, min(DART_TEXTS, n - i * DART_TEXTS), k) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]))]
        return np.concatenate([dart_signatures(*x) for x in parts if x[3] > 0])
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    sig = np.full(n * k, empty, np.uint64)
    size = np.bincount(owner, weight, n)
    reach = np.where(size > 0, (k * np.log(k) + 2 * k) / np.maximum(size, 1e-300), 0.0)
    todo = size > 0
    low = np.zeros(n)  # ranks below were thrown before
    while todo.any():
        mine = np.flatnonzero(todo[owner])
        _throw(element[mine], weight[mine], owner[mine], low, reach, sig, k)
        todo &= (sig.reshape(n, k) == empty).any(axis=1)
        low[todo], reach[todo] = reach[todo], reach[todo] * 2
    return sig.reshape(n, k)


def _throw(element: np.ndarray, weight: np.ndarray, owner: np.ndarray, low: np.ndarray, reach: np.ndarray, sig: np.ndarray, k: int) -> None:
    first = np.floor(low[owner]).astype(np.int64)
    columns = np.ceil(reach[owner]).astype(np.int64) - first
    layers = np.ceil(weight).astype(np.int64)
    cells = columns * layers
    which = np.repeat(np.arange(len(element)), cells)
    at = np.arange(len(which)) - np.repeat(np.cumsum(cells) - cells, cells)
    column, layer = first[which] + at % columns[which], at // columns[which]
    seed = T.mix(element[which] ^ T.mix(column.astype(np.uint64) + (layer.astype(np.uint64) << np.uint64(40)) + _SEEDS[0]))
    count = np.searchsorted(_POISSON, T.mix(seed ^ _SEEDS[1]), "right")
    cell = np.repeat(np.arange(len(which)), count)
    number = np.arange(len(cell)) - np.repeat(np.cumsum(count) - count, count)
    dart = T.mix(seed[cell] + (number.astype(np.uint64) + np.uint64(1)) * _SEEDS[2])
    rank = (column[cell].astype(np.uint64) << np.uint64(44)) | (dart >> np.uint64(20))
    whose = owner[which[cell]]
    other = T.mix(dart ^ _SEEDS[3])
    inside = (rank < (reach[whose] * 2.0**44).astype(np.uint64)) & (rank >= (low[whose] * 2.0**44).astype(np.uint64))
    deep = layer[cell] + (other >> np.uint64(32)).astype(np.float64) / 2.0**32
    inside &= deep < weight[which[cell]]
    coordinate = ((other & np.uint64(0xFFFFFFFF)) * np.uint64(k)) >> np.uint64(32)
    np.minimum.at(sig, whose[inside] * k + coordinate[inside].astype(np.int64), rank[inside])


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.empty((len(sig), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(sig), T.seeded(1000 + b), np.uint64)
        for r in range(rows):
            h = T.mix(h ^ sig[:, b * rows + r]) + _SEEDS[4]
        out[:, b] = h
    return out


def _fingerprints(word_hash: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(texts, 2): two 64-bit hashes of each text's word sequence."""
    raw = word_hash.view(np.uint8) if len(word_hash) else np.empty(0, np.uint8)
    a = T.hash_spans(raw, first[:-1] * 8, first[1:] * 8)
    other = T.mix(word_hash + _SEEDS[5]).view(np.uint8) if len(word_hash) else raw
    return np.stack([a, T.mix(T.hash_spans(other, first[:-1] * 8, first[1:] * 8) ^ _SEEDS[6])], axis=1)


def _nodes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    begin, end, first = T.words(data, offsets)
    h = T.hash_spans(data, begin, end)
    element, owner = T.shingles(h, first, WORDS)
    return h, first, element, owner


def elements(data: np.ndarray, offsets: np.ndarray, weighted: bool) -> tuple[np.ndarray, np.ndarray]:
    """(element, text): the distinct windows of each text, or each of their occurrences as an element of its own.

    The Jaccard similarity of the latter sets is the weighted one of the multisets.
    """
    _, _, element, owner = _nodes(data, offsets)
    v, t, times = T.distinct(element, owner)
    if not weighted or not len(v) or times.max() == 1:
        return v, t
    at = np.repeat(np.arange(len(v)), times)
    copy = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
    return np.where(copy > 0, T.mix(v[at] ^ T.mix(copy.astype(np.uint64) + _SEEDS[7])), v[at]), t[at]


def fingerprinted(docs: DataFrame, picks: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """All columns, and ``_fp``, the fingerprint of the words; null where there are none.

    ``picks`` says, from the fingerprints as two numbers and from whether there are words, which rows stay.
    """
    docs = without(docs, ["_fp"])
    at, schema = docs.columns.index("text"), extended(docs, _fp=BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = T.utf8(batch.column(at))
            fps, some = [np.empty((0, 2), np.uint64)], [np.empty(0, bool)]
            for a, b in T.steps(offsets):
                part, off = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                begin, end, first = T.words(part, off)
                fps.append(_fingerprints(T.hash_spans(part, begin, end), first))
                some.append(np.diff(first) > 0)
            fp, has = np.concatenate(fps), np.concatenate(some)
            marks = pa.array([x.tobytes() if s else None for x, s in zip(fp, has)], pa.binary())
            out = pa.RecordBatch.from_arrays([*batch.columns, marks], names=schema.names)
            yield out if picks is None else out.filter(pa.array(picks(fp, has)))

    return in_arrow(docs, run, schema)


def signatures(docs: DataFrame, weighted: bool = True, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, fp, n, bands): fingerprint, number of windows (distinct ones if unweighted), band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = T.utf8(batch.column(1))
            for a, b in T.steps(offsets):
                h, first, element, owner = _nodes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                element, owner, times = T.distinct(element, owner)
                weight = times.astype(np.float64) if weighted else np.ones(len(element))
                some = np.diff(first) > 0
                keys = band_keys(dart_signatures(element, weight, owner, b - a, bands * rows), bands, rows)
                fp = _fingerprints(h, first)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (b - a + 1) * bands, bands, dtype=np.int32)), pa.array(keys.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column(0).slice(a, b - a),
                    "fp": pa.array([x.tobytes() if s else None for x, s in zip(fp, some)], pa.binary()),
                    "n": pa.array(np.bincount(owner, weight, b - a).astype(np.int64)),
                    "bands": lists,
                })

    return in_arrow(docs.select("doc_id", "text"), run, "doc_id long, fp binary, n long, bands array<bigint>")


def _numbers(fps: pa.Array) -> np.ndarray:
    """(rows, 2): fingerprints as pairs of numbers."""
    return np.frombuffer(b"".join(fps.to_pylist()), np.uint64).reshape(-1, 2)


def _as_binary(fp: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() for x in np.ascontiguousarray(fp)], pa.binary())


def _combined(sig: DataFrame, shared: bool) -> DataFrame:
    """From some thousands of documents of a task at a time: either (key, x, y), a row for each key with the halves
    of its least fingerprint, or (key, fp), all rows of keys that several nodes share.
    """

    def emit(keys: list[np.ndarray], fps: list[np.ndarray]) -> pa.RecordBatch:
        fp, first = np.unique(np.concatenate(fps), axis=0, return_index=True)
        key = np.concatenate(keys)[first]
        node = np.repeat(np.arange(len(fp)), key.shape[1])
        order = np.argsort(key.reshape(-1), kind="stable")
        k, node = key.reshape(-1)[order], node[order]
        again = np.concatenate([[False], k[1:] == k[:-1]]) if len(k) else np.empty(0, bool)
        keep = again | np.append(again[1:], False) if shared and len(k) else ~again
        if shared:
            return pa.RecordBatch.from_pydict({"key": pa.array(k[keep]), "fp": _as_binary(fp[node[keep]])})
        return pa.RecordBatch.from_pydict({"key": pa.array(k[keep]), "x": pa.array(fp[node[keep], 0].view(np.int64)), "y": pa.array(fp[node[keep], 1].view(np.int64))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        fps: list[np.ndarray] = []
        for batch in batches:
            if batch.num_rows:
                lists = batch.column(1)
                flat = lists.values.to_numpy()[lists.offsets[0].as_py() : lists.offsets[-1].as_py()]
                keys.append(flat.reshape(batch.num_rows, -1))
                fps.append(_numbers(batch.column(0)))
                if sum(map(len, fps)) >= COMBINED:
                    yield emit(keys, fps)
                    keys, fps = [], []
        if fps:
            yield emit(keys, fps)

    return in_arrow(sig.where("fp is not null").select("fp", "bands"), run, "key long, fp binary" if shared else "key long, x long, y long")


def members(sig: DataFrame) -> DataFrame:
    """(key, fp) of all nodes that share a band's key with another node.

    No task has two Python passes at once: each would be a worker of its own, and workers stay until the session ends.
    """

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted; the last row of a batch waits for the next one."""
        last, done = np.empty((0, 3), np.int64), False
        for batch in batches:
            rows = np.concatenate([last, np.stack([c.to_numpy() for c in batch.columns], axis=1)])
            rows = rows[np.append(True, (rows[1:] != rows[:-1]).any(axis=1))] if len(rows) else rows
            if not len(rows):
                continue
            again = rows[1:, 0] == rows[:-1, 0]
            hit = np.append(False, again) | np.append(again, False)
            emit = hit.copy()
            if done:
                emit[0] = False
            done = bool(hit[-1]) or (done and len(rows) == 1)
            last = rows[-1:]
            yield pa.RecordBatch.from_pydict({"key": pa.array(rows[emit, 0]), "fp": _as_binary(rows[emit, 1:])})

    sent = _combined(sig, False).repartition("key").sortWithinPartitions("key", "x", "y")
    return in_arrow(sent, runs, "key long, fp binary").union(_combined(sig, True))


class Filter:
    """Which fingerprints may be in a set: a bit for each hashed one, of a size that is bounded whatever the set."""

    def __init__(self, fps: DataFrame) -> None:
        """From a table (fp) of distinct fingerprints; slices of the bits are made by tasks, and put together here."""
        self.bits = min(FILTER_BITS, max(SLICE_BITS, 1 << (8 * fps.count()).bit_length()))
        bits = self.bits

        def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = (_numbers(batch.column(0))[:, 0] % np.uint64(bits)).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"slice": pa.array((at // SLICE_BITS).astype(np.int32)), "place": pa.array((at % SLICE_BITS).astype(np.int32))})

        def part(key: tuple, table: pa.Table) -> pa.Table:
            some = np.zeros(SLICE_BITS, bool)
            some[table.column("place").to_numpy()] = True
            return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([np.packbits(some).tobytes()], pa.binary())})

        self.table = np.zeros(bits // 8, np.uint8)
        for r in in_arrow(fps.select("fp"), places, "slice int, place int").groupBy("slice").applyInArrow(part, "slice int, part binary").collect():  # FILTER_BITS / SLICE_BITS rows at most
            at = r["slice"] * SLICE_BITS // 8
            self.table[at : at + SLICE_BITS // 8] = np.frombuffer(bytes(r["part"]), np.uint8)

    def __call__(self, fp: np.ndarray) -> np.ndarray:
        at = (fp[:, 0] % np.uint64(self.bits)).astype(np.int64)
        return (self.table[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0


def node_texts(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """(fp, text): one text of each node in ``needed`` (fp, doc_id); but for chance hits of the filter, only these texts move."""
    wanted = docs.sparkSession.sparkContext.broadcast(Filter(needed))
    found = fingerprinted(docs.select("doc_id", "text"), lambda fp, some: some & wanted.value(fp))
    of = needed.select(F.col("fp").alias("_of"), F.col("doc_id").alias("_doc"))
    texts = found.join(of, F.col("_fp") == F.col("_of")).where(F.col("doc_id").eqNullSafe(F.col("_doc")))
    return via_table(texts.select(F.col("_fp").alias("fp"), "text").dropDuplicates(["fp"]), "texts")


def verified(pairs: DataFrame, texts: DataFrame, weighted: bool = True) -> DataFrame:
    """(a, b, similarity) of each pair of fingerprints, from the windows of their texts."""
    rows = pairs.join(texts.select(F.col("fp").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("fp").alias("b"), F.col("text").alias("text_b")), "b")

    def sets(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
        parts = [(v, t + a) for a, _, v, t in _window_sets(batch, column, weighted)]
        return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.empty(0, np.uint64), np.empty(0, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                b = batch.slice(at, 500)
                (va, ta), (vb, tb) = sets(b, 2), sets(b, 3)
                _, t, times = T.distinct(np.concatenate([va, vb]), np.concatenate([ta, tb]))
                both = np.bincount(t[times == 2], minlength=b.num_rows)
                either = np.bincount(t, minlength=b.num_rows)
                yield pa.RecordBatch.from_pydict({"a": b.column(0), "b": b.column(1), "similarity": pa.array(both / np.maximum(either, 1))})

    return in_arrow(rows.select("a", "b", "text_a", "text_b"), run, "a binary, b binary, similarity double")


def classes(docs: DataFrame, similarity: float = SIMILARITY, weighted: bool = True, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """(documents, nodes): (doc_id, fp), and (fp, class, doc_id, docs, links).

    Class is the least fp of the class, doc_id the node's least one, docs the number of its documents, links the
    number of its verified links.
    """
    sig = via_table(signatures(docs, weighted, bands, rows), "signatures")
    nodes = cut(sig.where("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.count("*").alias("docs")))
    plain = cut(members(sig))
    sized = plain.join(plain.groupBy("key").agg(F.count("*").alias("size")), "key")
    company = sized.groupBy("fp").agg(F.sum("size").alias("company"))
    known = cut(company.join(nodes, "fp").select("fp", "company", "n", "doc_id"))
    member = cut(plain.join(known, "fp").select("key", "fp", "n", "company"))
    free(plain)
    hubs = member.groupBy("key").agg(F.max(F.struct("company", F.col("fp").alias("hub"), F.col("n").alias("m"))).alias("h")).select("key", "h.hub", "h.m")
    fits = F.least("n", "m") >= F.lit(similarity) * F.greatest("n", "m")  # sizes that allow the similarity
    pairs = cut(member.join(hubs, "key").where((F.col("fp") != F.col("hub")) & fits).select(F.col("fp").alias("a"), F.col("hub").alias("b")).distinct())
    texts = node_texts(docs, known.select("fp", "doc_id"))
    links = cut(verified(pairs, texts, weighted).where(F.col("similarity") >= similarity).select("a", "b"))
    label = components(links)
    undecided = _undecided(member.select("key", "fp", "n"), label)
    free(member, known)
    if not undecided.isEmpty():
        tried = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rest = cut(prefix_pairs(undecided, texts, similarity, weighted).join(tried, ["a", "b"], "left_anti"))
        more = cut(verified(rest, texts, weighted).where(F.col("similarity") >= similarity).select("a", "b"))
        if not more.isEmpty():
            both = cut(links.union(more))
            free(links)
            links, label = both, _joined(label, more)
        free(rest, more)
    free(undecided, pairs, texts)
    degree = links.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("links"))
    joined = nodes.join(label.withColumnRenamed("node", "fp"), "fp", "left").join(degree, "fp", "left")
    joined = cut(joined.select("fp", F.coalesce("label", "fp").alias("class"), "doc_id", "docs", F.coalesce("links", F.lit(0)).cast("long").alias("links")))
    free(nodes, links)
    return sig.select("doc_id", "fp"), joined


def _joined(label: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label) with further links, over which only components meet; a node that had no label was one by itself."""
    for c in ("a", "b"):
        links = links.join(label.select(F.col("node").alias(c), F.col("label").alias(f"of_{c}")), c, "left")
    ends = links.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    top = components(ends)
    above = top.select(F.col("node").alias("label"), F.col("label").alias("above"))
    moved = label.join(above, "label", "left").select("node", F.coalesce("above", "label").alias("label"))
    return cut(moved.union(top.join(label, "node", "left_anti")))


def _undecided(member: DataFrame, label: DataFrame) -> DataFrame:
    """(fp, n, comp, minor) of the nodes in buckets with several components; minor: outside a bucket's largest one."""
    m = cut(member.join(label.withColumnRenamed("node", "fp"), "fp", "left").select("key", "fp", "n", F.coalesce("label", "fp").alias("comp")))
    per = m.groupBy("key", "comp").agg(F.count("*").alias("c"))
    split = per.groupBy("key").agg(F.count("*").alias("parts"), F.max(F.struct("c", "comp")).alias("top")).where("parts > 1").select("key", F.col("top.comp").alias("largest"))
    out = cut(m.join(split, "key").groupBy("fp").agg(F.first("n").alias("n"), F.first("comp").alias("comp"), F.max(F.col("comp") != F.col("largest")).alias("minor")))
    free(m)
    return out


def _window_sets(batch: pa.RecordBatch, column: int, weighted: bool) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, last text, windows, text of each) of a batch, some texts at a time."""
    data, offsets = T.utf8(batch.column(column))
    for a, b in T.steps(offsets):
        yield a, b, *elements(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], weighted)


def window_counts(texts: DataFrame, weighted: bool = True) -> np.ndarray:
    """How many texts hold a window, by ``COUNTERS`` hashed counters: a table of fixed size, whatever the input."""
    size = COUNTERS // COUNTER_SLICES

    def slices(table: np.ndarray) -> Iterator[pa.RecordBatch]:
        some = [s for s in range(COUNTER_SLICES) if table[s * size : (s + 1) * size].any()]
        yield pa.RecordBatch.from_pydict({"slice": pa.array(some, pa.int32()), "part": pa.array([table[s * size : (s + 1) * size].tobytes() for s in some], pa.binary())})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for _, _, v, _ in _window_sets(batch, 0, weighted):
                table += np.bincount((v % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        yield from slices(table)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for s, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                table[s * size : (s + 1) * size] += np.frombuffer(raw, np.int64)
        yield from slices(table)

    parts = in_arrow(in_arrow(texts.select("text"), count, "slice int, part binary").repartition("slice"), add, "slice int, part binary")
    out = np.zeros(COUNTERS, np.int64)
    for r in parts.collect():  # at most COUNTER_SLICES rows
        out[r["slice"] * size : (r["slice"] + 1) * size] += np.frombuffer(bytes(r["part"]), np.int64)
    return out


def parity_sketches(element: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """(n, SKETCH) numbers: a bit for each value of an element's hash, set if the set has an odd number of such elements.

    Common elements of two sets cancel out, so their sketches differ in at most as many bits as the sets in elements.
    """
    bits = 64 * SKETCH
    place = T.mix(element ^ _SEEDS[7]) % np.uint64(bits)
    odd = np.bincount(owner * bits + place.astype(np.int64), minlength=n * bits).reshape(n, bits) & 1
    return np.packbits(odd.astype(bool), axis=1).view(np.int64)


def prefix_pairs(nodes: DataFrame, texts: DataFrame, similarity: float, weighted: bool = True) -> DataFrame:
    """(a, b): all pairs of nodes (fp, n, comp, minor) that can be this similar, one of them minor, in different components.

    An exact prefix and position filter. Windows are put in one global order, rarest first. Two sets of
    similarity s share at least s of the larger one's windows and 2s / (1 + s) of the smaller one's, so their
    first common window is among the first n - ceil(s n) + 1 of the larger and the first n - ceil(2s n / (1 + s)) + 1
    of the smaller, and from its place on both must have enough windows left. A set that changed in many
    places begins with windows that nobody else has, so it meets nobody; only these prefixes, without the
    windows that occur once, are shuffled. Of the pairs that meet, those pass whose parity sketches differ in no more
    bits than such sets may in windows: each window of only one set changes one bit, so no link is lost, while in a
    family around the threshold hardly more pass than are links. The rows of a window in very many texts go to several tasks: each
    larger set to one of them, the smaller sets' rows to all.
    """
    sketch = [f"s{k}" for k in range(SKETCH)]
    mine = cut(texts.join(nodes, "fp").select("text", "fp", "comp", "minor"))
    counts = mine.sparkSession.sparkContext.broadcast(window_counts(mine, weighted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["window", "fp", "comp", "minor", "n", "place", "salt", "larger", "smaller", *sketch]
        hot = max(HOT, HOT_TIMES * float(counts.value.mean()))
        for batch in batches:
            for a, b, v, t in _window_sets(batch, 0, weighted):
                often = counts.value[(v % np.uint64(COUNTERS)).astype(np.int64)]
                order = np.lexsort((v, often, t))
                v, often = v[order], often[order]
                n = np.bincount(t, minlength=b - a)
                place = np.arange(len(t)) - (np.cumsum(n) - n)[t]
                longer = n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1
                shorter = n - np.ceil(2 * similarity / (1 + similarity) * n - 1e-9).astype(np.int64) + 1
                tasks = np.clip(np.ceil(often / hot), 1, MOST_DEALT).astype(np.int64)
                probe = (place < longer[t]) & (often > 1)
                index = probe & (place < shorter[t])
                at = np.flatnonzero(probe)
                own = np.array([x[0] | x[1] << 8 for x in batch.column(1).slice(a, b - a).to_pylist()], np.int64)
                dealt = np.repeat(j := np.flatnonzero(index & (tasks > 1)), tasks[j])
                turn = np.arange(len(dealt)) - np.repeat(np.cumsum(tasks[j]) - tasks[j], tasks[j])
                rows, salt = np.concatenate([at, dealt]), np.concatenate([own[t[at]] % tasks[at], turn])
                larger = np.concatenate([np.ones(len(at), bool), np.zeros(len(dealt), bool)])
                smaller = np.concatenate([index[at] & (tasks[at] == 1), np.ones(len(dealt), bool)])
                of = pa.array(t[rows] + a)
                yield pa.RecordBatch.from_arrays([pa.array(v[rows].view(np.int64)), *(batch.column(c).take(of) for c in (1, 2, 3)), pa.array(n[t[rows]]), pa.array(place[rows]), pa.array(salt.astype(np.int32)), pa.array(larger), pa.array(smaller), *(pa.array(x) for x in parity_sketches(v, t, b - a)[t[rows]].T)], names=names)

    rows = cut(in_arrow(mine, run, "window long, fp binary, comp binary, minor boolean, n long, place long, salt int, larger boolean, smaller boolean" + "".join(f", {c} long" for c in sketch)))
    x, y = rows.where("larger").alias("x"), rows.where("smaller").alias("y")
    most = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place"))
    need = F.lit(similarity / (1 + similarity)) * (F.col("x.n") + F.col("y.n")) - 1e-6
    differ = sum(F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}"))) for c in sketch)
    alike = differ <= F.lit((1 - similarity) / (1 + similarity)) * (F.col("x.n") + F.col("y.n")) + 1e-6
    order = (F.col("x.n") > F.col("y.n")) | (F.col("x.n") == F.col("y.n")) & (F.col("x.fp") > F.col("y.fp"))
    meet = (F.col("x.window") == F.col("y.window")) & (F.col("x.salt") == F.col("y.salt")) & (F.col("x.comp") != F.col("y.comp")) & (F.col("x.minor") | F.col("y.minor")) & order & (most >= need) & alike
    out = cut(x.join(y, meet).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")).distinct())
    free(mine, rows)
    return out


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, weighted: bool = True) -> DataFrame:
    """(doc_id, class_id, kept, links) for every row.

    kept marks a class's least doc_id; links is the number of verified links of the document's words. Links
    were verified until they join the class, not for all its pairs; copies of the same words need none.
    """
    rows, nodes = classes(docs, similarity, weighted)
    ids = nodes.groupBy("class").agg(F.min("doc_id").alias("class_id"))
    nodes = cut(nodes.join(ids, "class").select("fp", "class_id", "links"))
    class_id = F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("class_id"))
    out = rows.join(nodes, "fp", "left").select("doc_id", class_id.alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
    return out.select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"), "links")


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, weighted: bool = True) -> DataFrame:
    """The documents with one row of each class, that of the least doc_id; texts without words all stay.

    Rows whose words nobody else has (a filter of fixed size shows most of them) stay where they are; the
    others meet the list of those that stay.
    """
    _, nodes = classes(docs, similarity, weighted)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "fp")).alias("k")
    each = cut(nodes.groupBy("class").agg(first, F.sum("docs").alias("docs")))
    keep = each.select(F.col("k.fp").alias("_of"), F.col("k.doc_id").alias("_doc"))
    company = nodes.join(each.where("docs > 1").select("class"), "class").select("fp")
    several = docs.sparkSession.sparkContext.broadcast(Filter(cut(company)))
    docs = without(docs, ["_of", "_doc"])
    alone = fingerprinted(docs, lambda fp, some: ~(some & several.value(fp)))
    others = fingerprinted(docs, lambda fp, some: some & several.value(fp))
    kept = others.join(keep, (F.col("_fp") == F.col("_of")) & F.col("doc_id").eqNullSafe(F.col("_doc"))).drop("_of", "_doc")
    told = F.xxhash64(*[named(f.name) for f in kept.schema if "map<" not in (kind := f.dataType.simpleString()) and "variant" not in kind])
    kept = kept.groupBy("_fp").agg(F.min_by(F.struct(*[named(c) for c in kept.columns]), told).alias("row"))
    back = kept.select(*[F.col("row")[c].alias(c) for c in alone.columns])
    return alone.union(back).drop("_fp")
