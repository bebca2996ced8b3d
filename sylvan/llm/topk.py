"""Exact top-k inner-product search by columnar branch-and-bound.

Vectors lie in blocks in vertical layout, one row per dimension. A query's scores over a block are summed
dimension group by dimension group; after each group a candidate's score can't exceed its sum so far plus
|rest of query| * |rest of vector| (Cauchy-Schwarz on the remaining mass), and candidates whose bound lies
under the query's k-th best score so far are compacted away. Bounds only cut what can't win or tie, so
results are exact.

Queries and candidates meet in blocks: query blocks and candidate blocks are dealt to a grid of cells, with
at most about ``CELL`` blocks of each a cell, so that memory doesn't grow with either table and nothing is
broadcast. A cell sends on k rows a query, which a window cuts to the final k.

Defined results. Vectors that are null, or hold null or non-finite components, and rows with a null id take
no part. Vectors meet only vectors of their length. Rows with a query's own id aren't its candidates. A
repeated query row is a query of its own, a repeated candidate row a candidate of its own. Ties go to the
smaller id. Scores beyond 64 bits are held at the ends of that range. Very long vectors: whole, in blocks of as
many. Empty table: no rows. Other columns, whatever their names, aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sylvan.llm.arrow import in_arrow
from sylvan.session import via_table

#: Vectors in a candidate block and in a query block; blocks of each in a cell; dimensions in a group.
CANDIDATES, QUERIES, CELL, GROUP = 1024, 256, 16, 16
_EXACT = 2.0**52
BLOCKS = "dim int, block long, n int, ids binary, rows binary"


def quantised(rows: np.ndarray) -> np.ndarray:
    """floor(256 x) of each component."""
    return np.floor(256.0 * rows)


def _blocks(vectors: DataFrame, size: int) -> DataFrame:
    """Blocks of a table (vec_id, embedding): ids, and the quantised components in vertical layout."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: dict[int, list] = {}

        def emit(dim: int) -> pa.RecordBatch:
            nonlocal number
            ids, rows = (np.concatenate(x) for x in zip(*held.pop(dim)))
            number += 1
            return pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "block": pa.array([number]), "n": pa.array([len(ids)], pa.int32()), "ids": pa.array([ids.tobytes()]), "rows": pa.array([np.ascontiguousarray(rows.T).tobytes()])})

        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            lengths = np.diff(lists.offsets.to_numpy())
            begin = lists.offsets.to_numpy()[:-1]
            flat = lists.values.cast(pa.float64())
            bad = ~np.isfinite(flat.to_numpy(zero_copy_only=False)) | flat.is_null().to_numpy(zero_copy_only=False)
            wrong = np.concatenate([[0], np.cumsum(bad)])
            fine = (lists.is_valid().to_numpy(zero_copy_only=False)) & ids.is_valid().to_numpy(zero_copy_only=False) & (wrong[begin + lengths] == wrong[begin]) & (lengths > 0)
            values = flat.fill_null(0.0).to_numpy(zero_copy_only=False)
            known = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for dim in np.unique(lengths[fine]).tolist():
                at = np.flatnonzero(fine & (lengths == dim))
                for a in range(0, len(at), size):
                    part = at[a : a + size]
                    held.setdefault(dim, []).append((known[part], quantised(values[begin[part][:, None] + np.arange(dim)])))
                    if sum(len(x[0]) for x in held[dim]) >= size:
                        yield emit(dim)
        for dim in list(held):
            yield emit(dim)

    return in_arrow(vectors, run, BLOCKS)


class Search:
    """The k best of the candidates seen so far, for one query."""

    def __init__(self, query: np.ndarray, own: int, k: int) -> None:
        self.q, self.own, self.k = query, own, k
        self.edges = [*range(0, len(query), GROUP), len(query)]
        self.rest = [float(np.sqrt((query[e:] ** 2).sum())) for e in self.edges]
        self.score, self.ids = np.empty(0), np.empty(0, np.int64)

    def floor(self) -> float:
        return float(self.score[-1]) if len(self.score) == self.k else -np.inf

    def offer(self, rows: np.ndarray, ids: np.ndarray, tails: list[np.ndarray]) -> None:
        """Candidates in vertical layout; tails[g] are their norms from dimension group g on."""
        floor, alive, part = self.floor(), None, 0.0
        for g, (a, b) in enumerate(zip(self.edges[:-1], self.edges[1:])):
            part = part + self.q[a:b] @ (rows[a:b] if alive is None else rows[a:b, alive])
            if floor > -np.inf:
                tail = tails[g + 1] if alive is None else tails[g + 1][alive]
                keep = part + (self.rest[g + 1] * tail * (1 + 1e-9) + 1e-6) >= floor
                if not keep.all():
                    alive = np.flatnonzero(keep) if alive is None else alive[keep]
                    part = part[keep]
                    if not len(alive):
                        return
        self._take(part, ids if alive is None else ids[alive])

    def _take(self, score: np.ndarray, ids: np.ndarray) -> None:
        other = ids != self.own
        score, ids = np.concatenate([self.score, score[other]]), np.concatenate([self.ids, ids[other]])
        best = np.lexsort((ids, -score))[: self.k]
        self.score, self.ids = score[best], ids[best]

    def offer_exactly(self, rows: np.ndarray, ids: np.ndarray) -> None:
        """For numbers beyond what doubles hold exactly: integers of any size, without bounds."""
        q = [int(x) for x in self.q]
        score = np.array([max(-(1 << 63), min((1 << 63) - 1, sum(x * int(y) for x, y in zip(q, c)))) for c in rows.T] or [0], object)[: len(ids)]
        keep = ids != self.own
        both = sorted([*zip((-s for s in self.score.tolist()), self.ids.tolist()), *zip((-s for s in score[keep]), ids[keep].tolist())])[: self.k]
        self.score, self.ids = np.array([-s for s, _ in both], object), np.array([i for _, i in both], np.int64)


def _cell(k: int):
    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if queries.num_rows and candidates.num_rows:
            dim = queries.column("dim")[0].as_py()
            unpack = lambda t: [(b, np.frombuffer(i, np.int64), np.frombuffer(r, np.float64).reshape(dim, n)) for b, n, i, r in sorted(zip(*(t.column(c).to_pylist() for c in ("block", "n", "ids", "rows"))))]
            blocks = unpack(candidates)
            edges = [*range(0, dim, GROUP), dim]
            tails = [[np.sqrt((r[e:] ** 2).sum(axis=0)) for e in edges] for _, _, r in blocks]
            # the longest vectors first: they are likely to raise the floor under which others are cut
            blocks, tails = zip(*sorted(zip(blocks, tails), key=lambda x: -float(x[1][0].max())))
            largest = max(float(t[0].max()) for t in tails)
            for number, own, rows in unpack(queries):
                for j in range(len(own)):
                    s = Search(rows[:, j], int(own[j]), k)
                    exact = s.rest[0] * largest < _EXACT
                    for (_, ids, r), t in zip(blocks, tails):
                        s.offer(r, ids, t) if exact else s.offer_exactly(r, ids)
                    found += [(number, j, int(own[j]), int(i), int(x)) for x, i in zip(s.score, s.ids)]
        columns = list(zip(*found)) if found else [[]] * 5
        kinds = (("block", pa.int64()), ("place", pa.int32()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()))
        return pa.table({n: pa.array(c, t) for c, (n, t) in zip(columns, kinds)})

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each query row of (vec_id, embedding)."""
    rows = vectors.select("vec_id", "embedding")
    candidates = via_table(_blocks(rows, CANDIDATES), "candidate-blocks")
    queries = via_table(_blocks(rows.where(is_query), QUERIES), "query-blocks")
    wide, high = max(1, -(-candidates.count() // CELL)), max(1, -(-queries.count() // CELL))
    deal = lambda df, n: F.pmod(F.xxhash64(df["block"]), F.lit(n)).cast("int")
    q = queries.withColumn("high", deal(queries, high)).withColumn("wide", F.explode(F.sequence(F.lit(0), F.lit(wide - 1))))
    c = candidates.withColumn("wide", deal(candidates, wide)).withColumn("high", F.explode(F.sequence(F.lit(0), F.lit(high - 1))))
    cell = ["dim", "high", "wide"]
    best = q.groupBy(*cell).cogroup(c.groupBy(*cell)).applyInArrow(_cell(k), "block long, place int, query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("block", "place").orderBy(F.col("score").desc(), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
