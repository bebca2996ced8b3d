"""Distances of two trees given as splits with lengths, the geodesic one among them."""

from __future__ import annotations

import math
from collections import deque

Splits = dict[frozenset, float]


def _compatible(a: frozenset, b: frozenset) -> bool:
    """Sides leave out the smallest leaf, so two splits fit in one tree if their sides are nested or apart."""
    return not (a & b) or a <= b or b <= a


def on_common(a: Splits, b: Splits, leaves_a: frozenset, leaves_b: frozenset, least_overlap: int = 4) -> tuple[Splits, Splits, int] | None:
    """Both split sets on their common leaves and the number of those, or None if they are too few."""
    common = leaves_a & leaves_b
    if len(common) < least_overlap:
        return None
    if leaves_a == leaves_b:
        return a, b, len(common)
    return restrict(a, common), restrict(b, common), len(common)


def restrict(s: Splits, keep: frozenset) -> Splits:
    """Splits on fewer leaves: those that fall together add up, empty and full ones go."""
    low, out = min(keep), {}
    for side, length in s.items():
        k = side & keep
        k = keep - k if low in k else k
        if k and len(k) < len(keep):
            out[k] = out.get(k, 0.0) + length
    return out


def robinson_foulds(a: Splits, b: Splits, n: int, normalise: bool = False) -> float:
    inner = [{s for s in x if 1 < len(s) < n - 1} for x in (a, b)]
    d = len(inner[0] ^ inner[1])
    return d / (len(inner[0]) + len(inner[1])) if normalise and inner[0] | inner[1] else float(d)


def weighted_rf(a: Splits, b: Splits, normalise: bool = False) -> float:
    d = math.fsum(abs(a.get(s, 0.0) - b.get(s, 0.0)) for s in a.keys() | b.keys())
    total = math.fsum([*a.values(), *b.values()])
    return d / total if normalise and total else d


def _norms(a: Splits, b: Splits) -> float:
    return sum(math.sqrt(math.fsum(v * v for v in x.values())) for x in (a, b))


def euclidean(a: Splits, b: Splits, normalise: bool = False) -> float:
    d = math.sqrt(math.fsum((a.get(s, 0.0) - b.get(s, 0.0)) ** 2 for s in a.keys() | b.keys()))
    return d / _norms(a, b) if normalise and _norms(a, b) else d


def geodesic(a: Splits, b: Splits, normalise: bool = False) -> float:
    """Length of the shortest path in tree space, leaf edges included.

    Edges that the other tree has, or could have, move straight. The rest falls apart into independent
    problems by compatible common splits; here all are refined together: start with one pair of supports
    (all of a's edges shrink, then all of b's grow) and split a pair wherever a vertex cover of the
    incompatibility graph, by squared shares of length, weighs less than 1.
    """
    common = a.keys() & b.keys()
    only_a, only_b = {s: v for s, v in a.items() if s not in common}, {s: v for s, v in b.items() if s not in common}
    straight = [(a[s] - b[s]) ** 2 for s in common]
    free_a = [s for s in only_a if all(_compatible(s, t) for t in only_b)]
    free_b = [s for s in only_b if all(_compatible(s, t) for t in only_a)]
    straight += [only_a.pop(s) ** 2 for s in free_a] + [only_b.pop(s) ** 2 for s in free_b]
    total = math.fsum(straight)
    if only_a and only_b:
        total += math.fsum(_leg(x, y, only_a, only_b) ** 2 for x, y in _supports(only_a, only_b))
    d = math.sqrt(total)
    return d / _norms(a, b) if normalise and _norms(a, b) else d


def _leg(x: list, y: list, a: Splits, b: Splits) -> float:
    return math.sqrt(math.fsum(a[s] ** 2 for s in x)) + math.sqrt(math.fsum(b[s] ** 2 for s in y))


def _supports(a: Splits, b: Splits) -> list[tuple[list, list]]:
    out, queue = [], deque([(list(a), list(b))])
    while queue:
        x, y = queue.popleft()
        parts = _extension(x, y, a, b)
        if parts is None:
            out.append((x, y))
        else:
            queue.extendleft(reversed(parts))
    return out


def _extension(x: list, y: list, a: Splits, b: Splits) -> list[tuple[list, list]] | None:
    """The refinement of a support pair by a minimum-weight vertex cover, or None if there is none."""
    na, nb = math.fsum(a[s] ** 2 for s in x), math.fsum(b[s] ** 2 for s in y)
    if na == 0 or nb == 0 or len(x) * len(y) < 2:
        return None
    clash = [[j for j, t in enumerate(y) if not _compatible(s, t)] for s in x]
    cover_x, cover_y, weight = _vertex_cover([a[s] ** 2 / na for s in x], [b[t] ** 2 / nb for t in y], clash)
    if weight >= 1 - 1e-12:
        return None
    c1 = [s for s, k in zip(x, cover_x) if k]
    c2 = [s for s, k in zip(x, cover_x) if not k]
    d1 = [t for t, k in zip(y, cover_y) if not k]
    d2 = [t for t, k in zip(y, cover_y) if k]
    if not c1 or not c2 or not d1 or not d2:
        return None
    return [(c1, d1), (c2, d2)]


def _vertex_cover(wx: list[float], wy: list[float], clash: list[list[int]]) -> tuple[list[bool], list[bool], float]:
    """Minimum-weight vertex cover of a bipartite graph, by the maximum flow source -> x -> y -> sink."""
    n, m = len(wx), len(wy)
    left_x, left_y = list(wx), list(wy)
    flow = [dict.fromkeys(c, 0.0) for c in clash]
    back: list[list[int]] = [[] for _ in range(m)]
    for i, c in enumerate(clash):
        for j in c:
            back[j].append(i)
    total = 0.0
    while True:
        seen: dict[tuple[int, int], tuple[int, int] | None] = {}
        queue = deque()
        for i in range(n):
            if left_x[i] > 1e-15:
                seen[0, i] = None
                queue.append((0, i))
        end = None
        while queue and end is None:
            side, k = queue.popleft()
            if side == 0:
                for j in clash[k]:
                    if (1, j) not in seen:
                        seen[1, j] = (0, k)
                        if left_y[j] > 1e-15:
                            end = (1, j)
                            break
                        queue.append((1, j))
            else:
                for i in back[k]:
                    if flow[i][k] > 1e-15 and (0, i) not in seen:
                        seen[0, i] = (1, k)
                        queue.append((0, i))
        if end is None:
            cover_x = [(0, i) not in seen for i in range(n)]
            cover_y = [(1, j) in seen for j in range(m)]
            return cover_x, cover_y, total
        path, at = [], end
        while at is not None:
            path.append(at)
            at = seen[at]
        path.reverse()
        push = min([left_x[path[0][1]], left_y[end[1]], *(flow[i][k] for (s, k), (_, i) in zip(path, path[1:]) if s == 1)])
        left_x[path[0][1]] -= push
        left_y[end[1]] -= push
        for (s, k), (_, other) in zip(path, path[1:]):
            if s == 0:
                flow[k][other] += push
            else:
                flow[other][k] -= push
        total += push
