"""Building, drawing and rearranging single trees. Every random step takes a numpy generator."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np

from sylvan.functions.newick import Tree


class TreeError(ValueError):
    """An operation doesn't apply to this tree."""


def default_labels() -> Iterator[str]:
    """x, y, z, then x2, y2, ..."""
    k = 1
    while True:
        for c in "xyz":
            yield c if k == 1 else f"{c}{k}"
        k += 1


def _compact(tree: Tree) -> Tree:
    """Nodes renumbered in preorder, detached ones left out."""
    out, made = Tree(), {}
    for k in tree.preorder():
        new = out.add(made[tree.parent[k]] if k else -1, tree.length[k], tree.label[k])
        out.support[new] = tree.support[k]
        made[k] = new
    return out.suppressed()


# ------------------------------------------------------------------ building from distances


def neighbour_joining(d: np.ndarray, names: list[str]) -> Tree:
    """The unrooted neighbour-joining tree, its last three lineages at the root; negative lengths become 0."""
    if len(names) < 3:
        raise TreeError("neighbour joining takes three taxa at least")
    m, part = d.astype(float).copy(), [f"{i}" for i in range(len(names))]
    kids: dict[str, list[tuple[str, float]]] = {}
    while len(part) > 3:
        n, total = len(part), m.sum(axis=1)
        q = (n - 2) * m - total[:, None] - total
        np.fill_diagonal(q, np.inf)
        i, j = sorted(np.unravel_index(int(q.argmin()), q.shape))
        left = m[i, j] / 2 + (total[i] - total[j]) / (2 * (n - 2))
        new = f"n{len(kids)}"
        kids[new] = [(part[i], left), (part[j], m[i, j] - left)]
        row = (m[i] + m[j] - m[i, j]) / 2
        keep = [k for k in range(n) if k not in (i, j)]
        m = np.vstack([np.column_stack([m[np.ix_(keep, keep)], row[keep]]), np.append(row[keep], 0)])
        part = [part[k] for k in keep] + [new]
    a, b, c = m[0, 1], m[0, 2], m[1, 2]
    kids["root"] = [(part[0], (a + b - c) / 2), (part[1], (a + c - b) / 2), (part[2], (b + c - a) / 2)]
    return _grown(kids, "root", names)


def _grown(kids: dict[str, list[tuple[str, float]]], root: str, names: list[str]) -> Tree:
    tree, stack = Tree(), [(root, -1, None)]
    while stack:
        key, parent, length = stack.pop()
        k = tree.add(parent, None if length is None else max(float(length), 0.0), names[int(key)] if key.isdigit() else None)
        stack += [(c, k, v) for c, v in reversed(kids.get(key, []))]
    return tree


def average_linkage(d: np.ndarray, names: list[str]) -> Tree:
    """The ultrametric tree of average linkage."""
    from sylvan.functions.cluster import linkage

    n = len(names)
    height, kids = {f"{k}": 0.0 for k in range(n)}, {}
    name = lambda k: f"{k}" if k < n else f"m{k}"
    for step, (a, b, h, _) in enumerate(linkage(d, "average")):
        new = f"m{n + step}"
        height[new] = h / 2
        kids[new] = [(name(c), h / 2 - height[name(c)]) for c in (a, b)]
    return _grown(kids, f"m{2 * n - 2}", names)


# ------------------------------------------------------------------ random trees


def iterative_random(names: list[str], rng: np.random.Generator) -> Tree:
    """Leaves put in one after the other, each on a random edge; unrooted, gamma lengths."""
    tree = Tree()
    tree.add(-1)
    for name in names[:3]:
        tree.add(0, None, name)
    for name in names[3:]:
        edge = int(rng.integers(1, len(tree.parent)))
        middle = tree.add(tree.parent[edge])
        tree.move(edge, middle)
        tree.add(middle, None, name)
    return with_random_lengths(_compact(tree), rng)


def yule(names: list[str], rng: np.random.Generator, rate: float = 1.0) -> Tree:
    """A pure-birth tree: any lineage splits at the same rate; ultrametric."""
    tree = Tree()
    tree.add(-1)
    alive = [tree.add(0, 0.0), tree.add(0, 0.0)] if len(names) > 1 else [tree.add(0, 0.0)]
    while True:
        wait = rng.exponential(1 / (rate * len(alive)))
        for k in alive:
            tree.length[k] += wait
        if len(alive) >= len(names):
            break
        k = alive.pop(int(rng.integers(len(alive))))
        alive += [tree.add(k, 0.0), tree.add(k, 0.0)]
    for k, name in zip(alive, rng.permutation(names)):
        tree.label[k] = str(name)
    return tree


def coalescent(names: list[str], rng: np.random.Generator, population: float = 1.0) -> Tree:
    """Kingman's coalescent: any two lineages meet at rate 1 / population."""
    kids, height, alive, now = {}, {f"{k}": 0.0 for k in range(len(names))}, [f"{k}" for k in range(len(names))], 0.0
    while len(alive) > 1:
        n = len(alive)
        now += rng.exponential(population / (n * (n - 1) / 2))
        a, b = (alive.pop(int(rng.integers(len(alive)))) for _ in range(2))
        new = f"c{len(kids)}"
        kids[new], height[new] = [(a, now - height[a]), (b, now - height[b])], now
        alive.append(new)
    return _grown(kids, alive[0], names)


def gene_tree(species: Tree, rng: np.random.Generator, population: float = 1.0, copies: int = 1, scale_to: float | None = None) -> Tree:
    """A coalescent within a species tree: lineages may only meet while they are in the same branch."""
    depth = species.depth()
    tall = max(depth.values()) or 1.0
    factor = scale_to / tall if scale_to else 1.0
    kids: dict[str, list[tuple[str, float]]] = {}
    height: dict[str, float] = {}
    names: list[str] = []
    lineages: dict[int, list[str]] = {}
    for k in species.postorder():
        if not species.children[k]:
            own = []
            for c in range(copies):
                names.append((species.label[k] or "") + (f"_{c + 1}" if copies > 1 else ""))
                own.append(f"{len(names) - 1}")
        else:
            own = [x for c in species.children[k] for x in lineages.pop(c)]
        bottom = (tall - depth[k]) * factor
        top = (tall - depth[species.parent[k]]) * factor if k else math.inf
        for x in own:
            height.setdefault(x, bottom)
        now = bottom
        while len(own) > 1:
            n = len(own)
            now += rng.exponential(population / (n * (n - 1) / 2))
            if now >= top:
                break
            a, b = (own.pop(int(rng.integers(len(own)))) for _ in range(2))
            new = f"g{len(kids)}"
            kids[new], height[new] = [(a, now - height[a]), (b, now - height[b])], now
            own.append(new)
        lineages[k] = own
    return _grown(kids, lineages[0][0], names) if kids else _grown({"r": [("0", height["0"])]}, "r", names)


def with_random_lengths(tree: Tree, rng: np.random.Generator, inner: tuple = (1.0, 1.0), leaf: tuple = (1.0, 1.0), draw: Callable | None = None) -> Tree:
    """Lengths drawn anew, gamma by default, with parameters for inner and for leaf edges."""
    draw = draw or (lambda r, shape, scale: r.gamma(shape, scale))
    for k in range(1, len(tree.parent)):
        tree.length[k] = float(draw(rng, *(inner if tree.children[k] else leaf)))
    return tree


def with_shuffled_labels(tree: Tree, rng: np.random.Generator) -> Tree:
    at = tree.leaves()
    for k, name in zip(at, rng.permutation([tree.label[k] or "" for k in at])):
        tree.label[k] = str(name)
    return tree


def relaxed_clock(tree: Tree, rng: np.random.Generator, correlation: float | None = None, spread: float = 0.5, exponential: bool = False) -> Tree:
    """Lengths times edge rates.

    With a correlation a rate's logarithm is normal around its parent's, ln R ~ N(ln P - v / 2, v) with
    v = length x correlation (or the rate is exponential with the parent's as mean); without, rates are
    independent.
    """
    rate = {0: 1.0}
    for k in tree.preorder():
        if not k:
            continue
        up, length = rate[tree.parent[k]] if correlation is not None else 1.0, tree.length[k] or 0.0
        v = length * correlation if correlation is not None else spread
        rate[k] = rng.exponential(up) if exponential else math.exp(rng.normal(math.log(max(up, 1e-300)) - v / 2, math.sqrt(v))) if v > 0 else up
        tree.length[k] = length * rate[k]
    return tree


# ------------------------------------------------------------------ rearrangements


def collapsed(tree: Tree, support: float | None = None, length: float | None = None, keep_lengths: bool = True) -> Tree:
    """Without inner edges of low support or short length; their lengths may be passed on to the children."""
    out = tree.copy()
    for k in out.postorder():
        if not k or not out.children[k]:
            if k and length is not None and (out.length[k] or 0.0) < length:
                out.length[k] = 0.0
            continue
        weak = support is not None and out.support[k] is not None and out.support[k] < support
        short = length is not None and (out.length[k] or 0.0) < length
        if weak or short:
            for c in list(out.children[k]):
                if keep_lengths:
                    out.length[c] = (out.length[c] or 0.0) + (out.length[k] or 0.0)
                out.move(c, out.parent[k])
            out.children[out.parent[k]].remove(k)
    return _compact(out)


def nearest_interchange(tree: Tree, rng: np.random.Generator, by_length: bool = False) -> Tree:
    """A subtree below a random inner edge changes places with one beside it; short edges are likelier with ``by_length``."""
    out = tree.copy()
    edges = [k for k in out.preorder() if k and out.children[k] and len(out.children[out.parent[k]]) > 1]
    if not edges:
        raise TreeError("no inner edge")
    weight = np.array([1 / ((out.length[k] or 0.0) + 1e-6) if by_length else 1.0 for k in edges])
    k = edges[int(rng.choice(len(edges), p=weight / weight.sum()))]
    beside = [c for c in out.children[out.parent[k]] if c != k]
    a, b = int(rng.choice(out.children[k])), int(rng.choice(beside))
    up = out.parent[k]
    out.move(a, up)
    out.move(b, k)
    return _compact(out)


def ultrametric_interchange(tree: Tree, rng: np.random.Generator) -> Tree:
    """An interchange after which all leaves keep their depth: moved edges take up the difference."""
    deep = tree.copy().depth()
    out = tree.copy()
    edges = [k for k in out.preorder() if k and out.children[k] and len(out.children[out.parent[k]]) > 1]
    fits = [(k, b) for k in edges for b in out.children[out.parent[k]] if b != k and deep[b] > deep[k]]
    if not fits:
        raise TreeError("no interchange keeps the depths")
    k, b = fits[int(rng.integers(len(fits)))]
    a, up = int(rng.choice(out.children[k])), out.parent[k]
    out.length[a], out.length[b] = deep[a] - deep[up], deep[b] - deep[k]
    out.move(a, up)
    out.move(b, k)
    return _compact(out)


def prune_and_regraft(tree: Tree, rng: np.random.Generator, no_sibling: bool = True) -> Tree:
    """A random subtree is cut off and put on a random edge elsewhere, at a random place of it."""
    out = tree.copy()
    choices = list(range(1, len(out.parent)))
    rng.shuffle(choices)
    for k in choices:
        inside, up = set(out.preorder(k)), out.parent[k]
        near = {up, *out.children[up]} if no_sibling else {up}
        goals = [e for e in range(1, len(out.parent)) if e not in inside and e not in near]
        if not goals or (up == 0 and len(out.children[0]) <= 2):
            continue
        e = int(rng.choice(goals))
        part = float(rng.random()) * (out.length[e] or 0.0)
        middle = out.add(out.parent[e], (out.length[e] or 0.0) - part)
        out.move(e, middle)
        out.length[e] = part
        out.move(k, middle)
        return _compact(out)
    raise TreeError("no place to regraft")


def lateral_transfer(tree: Tree, rng: np.random.Generator) -> Tree:
    """At a random time one lineage is replaced by a copy of a place on another that lived then; needs depths in time."""
    out = tree.copy()
    deep = out.depth()
    if max(deep[k] for k in out.leaves()) - min(deep[k] for k in out.leaves()) > 1e-6 * max(deep.values()):
        raise TreeError("lateral transfer needs an ultrametric tree")
    for _ in range(100):
        when = float(rng.random()) * max(deep.values())
        there = [k for k in range(1, len(out.parent)) if deep[out.parent[k]] < when < deep[k]]
        pairs = [(a, b) for a in there for b in there if a != b and out.parent[a] != out.parent[b] and not (out.parent[a] == 0 and len(out.children[0]) <= 2)]
        if pairs:
            taker, giver = pairs[int(rng.integers(len(pairs)))]
            middle = out.add(out.parent[giver], when - deep[out.parent[giver]])
            out.move(giver, middle)
            out.length[giver] = deep[giver] - when
            out.move(taker, middle)
            out.length[taker] = deep[taker] - when
            return _compact(out)
    raise TreeError("no two lineages to transfer between")


def incomplete_sorting(tree: Tree, rng: np.random.Generator, population: float = 1.0) -> Tree:
    """A gene tree in which lineages may fail to meet in the branch they share: the coalescent within the tree."""
    deep = tree.depth()
    tall = max(deep.values())
    level = tree.copy()
    for k in level.leaves():
        level.length[k] = (level.length[k] or 0.0) + tall - level.depth()[k]
    return gene_tree(level, rng, population)


def weighted_choice(weights: list[float], rng: np.random.Generator, transform: Callable | None = None) -> int:
    w = np.asarray(transform(np.asarray(weights)) if transform else weights, float)
    return int(np.searchsorted(np.cumsum(w), rng.random() * w.sum(), "right"))


# ------------------------------------------------------------------ roots


def unrooted(tree: Tree) -> Tree:
    """A root of two children dissolved into one edge."""
    if not tree.rooted:
        return tree.copy()
    out = tree.copy()
    a, b = out.children[0]
    keep, gone = (a, b) if out.children[b] else (b, a)
    if not out.children[gone]:
        return out
    out.length[keep] = (out.length[a] or 0.0) + (out.length[b] or 0.0)
    for c in list(out.children[gone]):
        out.move(c, 0)
    out.children[0].remove(gone)
    return _compact(out)


def bifurcated(tree: Tree) -> Tree:
    """Every node of more than two children resolved by new nodes of no length, so the base has two."""
    out = tree.copy()
    for k in list(out.preorder()):
        while len(out.children[k]) > 2:
            new = out.add(k, 0.0)
            for c in out.children[k][:2]:
                out.move(c, new)
    return out


def reversibly_unrooted(tree: Tree) -> tuple[Tree, frozenset[str], float, float]:
    """The unrooted tree, the leaves on one side of its root, and the lengths of the two root edges, for ``rerooted``."""
    if not tree.rooted:
        raise TreeError("the tree has no root of two children")
    a, b = tree.children[0]
    return unrooted(tree), tree.below()[a], tree.length[a] or 0.0, tree.length[b] or 0.0


def rerooted(tree: Tree, side: frozenset[str], length: float, other: float) -> Tree:
    """The tree with a root on the edge that parts ``side`` from the other leaves; the edge's two lengths are given."""
    below = tree.below()
    every = below[0]
    found = [k for k in tree.preorder() if k and below[k] in (side, every - side)]
    if not found:
        raise TreeError("no edge parts these leaves from the others")
    k = found[0]
    near, far = (length, other) if below[k] == side else (other, length)
    out = Tree()
    root = out.add(-1)

    def grow(node: int, came: int, to: int, edge: float | None) -> None:
        """Copy what is seen from node when one comes from a neighbour; without recursion, for deep trees."""
        stack = [(node, came, to, edge)]
        while stack:
            at, back, parent, size = stack.pop()
            new = out.add(parent, size, tree.label[at])
            out.support[new] = tree.support[at]
            around = [(c, tree.length[c]) for c in tree.children[at]] + ([(tree.parent[at], tree.length[at])] if at else [])
            stack += [(n, at, new, v) for n, v in reversed(around) if n != back]

    grow(k, tree.parent[k], root, near)
    grow(tree.parent[k], k, root, far)
    return out.suppressed()
