"""What the plans of near-duplicates do, whatever their results."""

import numpy as np

from sylvan.llm import neardup


def chained(df):
    """Python passes of a plan that read another one's rows without an exchange or a written table in between."""
    above, found = [], 0
    for line in df._jdf.queryExecution().sparkPlan().treeString().splitlines():
        name = line.lstrip(" :+-|")
        depth = len(line) - len(name)
        above = [x for x in above if x[0] < depth]
        if name.startswith(("MapInArrow", "FlatMapGroupsInArrow")):
            below = [n for _, n in above if n.startswith(("MapInArrow", "Exchange", "FlatMapGroups"))]
            found += bool(below) and below[-1].startswith("MapInArrow")
        above.append((depth, name))
    return found


def test_no_task_needs_two_python_workers(spark, monkeypatch):
    """A second worker stays with its memory for the rest of the session."""
    seen, write = [], neardup.via_table

    def watched(df, name):
        seen.append(chained(df))
        return write(df, name)

    monkeypatch.setattr(neardup, "via_table", watched)
    monkeypatch.setattr(neardup, "cut", lambda df: watched(df, "cut"))
    base = [f"w{i}" for i in range(60)]
    rows = [(k, " ".join([*base[: 2 * k], f"n{k}", *base[2 * k + 1 :]])) for k in range(20)]
    out = neardup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert len(seen) > 5 and not any(seen) and not chained(out)
    assert [r["doc_id"] for r in out.collect()] == [0]


def test_a_family_around_the_threshold_costs_rows_for_its_links(spark, monkeypatch):
    """Twice the texts of one template must not make four times the pairs that are verified after the hubs."""
    rng, base, made, verified = np.random.default_rng(3), [f"b{i}" for i in range(150)], [], neardup.verified

    def watched(pairs, texts, weighted):
        made.append(pairs.count())
        return verified(pairs, texts, weighted)

    monkeypatch.setattr(neardup, "verified", watched)
    rows = []
    for k in range(1000):
        words = list(base)
        for _ in range(rng.integers(1, 5)):
            words[rng.integers(0, 150)] = f"v{rng.integers(0, 300)}"
        rows.append((k, " ".join(words)))
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(made) == 2 and made[1] < 2 * len(rows)
    sets = [set(zip(*(t.split()[i:] for i in range(5)))) for _, t in rows]
    got = {r["doc_id"]: r["class_id"] for r in out}
    alike = [(i, j) for i in range(1000) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert len(alike) > 10_000 and all(got[i] == got[j] for i, j in alike)
    parent = list(range(1000))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in alike:
        parent[top(i)] = top(j)
    assert len({top(k) for k in range(1000)}) == len(set(got.values()))


def test_sketches_never_say_more_than_sets_differ():
    rng = np.random.default_rng(5)
    for n, share in ((5, 0.5), (150, 0.9), (150, 0.1), (5000, 0.9)):
        both, one, other = (rng.integers(0, 1 << 63, int(k), dtype=np.int64).view(np.uint64) for k in (n * share, n * (1 - share), n * (1 - share) / 2))
        element, owner = np.concatenate([both, one, both, other]), np.repeat([0, 1], [len(both) + len(one), len(both) + len(other)])
        a, b = neardup.parity_sketches(element, owner, 2)
        assert sum(int(x).bit_count() for x in (a ^ b).view(np.uint64)) <= len(one) + len(other)
