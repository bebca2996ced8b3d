"""Problem, model and group files, checks, roots, running totals, pairs, resampling, and the command line."""

import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from sylvan.functions import checks, likelihood as L, newick, treeops
from sylvan.operators import estimate, pairs, partition, prefix, resample
from sylvan.sources import groups, models, problems


def test_problems_go_through_text(spark, tmp_path):
    rows = [(0, "A", "B", 0.5, 0.1), (0, "A", "C", 0.25, 0.2), (0, "B", "C", 1.5, 0.3), (1, "B", "D", 2.0, 0.4)]
    table = spark.createDataFrame(rows, problems.PROBLEMS)
    for scale in (1.0, 2.0):
        texts = problems.problem_texts(table, scale)
        for name, text in zip("mgl", texts):
            (tmp_path / name).write_text(text)
        back = problems.read_problem(spark, *(str(tmp_path / n) for n in "mgl")).collect()
        assert sorted(map(tuple, back)) == [(f, a, b, d * scale, v * scale**2) for f, a, b, d, v in rows]
    matrices, genome_map, labels = problems.problem_texts(table)
    for bad in ((matrices[:-20], genome_map, labels), (matrices, "2 4 1 2", labels), (matrices, genome_map, "9\nA B"), (matrices.replace("3 3 1", "3 3 2"), genome_map, labels), ("x", genome_map, labels), (matrices, genome_map.replace("1 2", "9 2"), labels)):
        with pytest.raises(problems.ProblemError):
            problems.parse_problem(*bad)


def test_models_from_files(spark, tmp_path):
    rng = np.random.default_rng(3)
    rates, freqs = rng.random(190).tolist(), rng.dirichlet(np.ones(20)).tolist()
    (tmp_path / "m.dat").write_text(models.model_text(rates, freqs) + "\nA note with 1 number\n")
    m = models.read_model(spark, str(tmp_path / "m.dat"))
    want = L.empirical(rates, freqs)
    assert np.allclose(m.at(0.3), want.at(0.3)) and np.allclose(m.at(0.3).sum(axis=1), 1) and np.allclose(m.freqs @ m.at(0.7), m.freqs)
    flow = m.freqs[:, None] * m.at(0.4)
    assert np.allclose(flow, flow.T)
    with pytest.raises(ValueError):
        models.parse_exchangeabilities("1 2 3")
    protein = [(0, "ARNDC" * 8), (1, "ARNDE" * 8), (2, "ARQDC" * 8)]
    seqs = spark.createDataFrame([("l", k, f"t{k}", s) for k, s in protein], "locus string, seq_idx int, taxon string, seq string")
    plain = estimate.estimate_trees(seqs).first()["lnl"]
    own = estimate.estimate_trees(seqs, estimate.with_model(estimate.by_neighbour_joining, m)).first()["lnl"]
    assert plain != own and np.isfinite(own)
    a, b = (estimate.ml_distances(seqs, protein=p).orderBy("a", "b").first()["distance"] for p in (None, m))
    assert a != b


def test_group_and_replicate_writers(spark, tmp_path):
    seqs = spark.createDataFrame([("x", 0, "A", "ACGT"), ("x", 1, "B", "AC-T"), ("y", 0, "A", "GG"), ("z", 0, "B", "T")], "locus string, seq_idx int, taxon string, seq string")
    part = spark.createDataFrame([("x", 0), ("y", 0), ("z", 1)], "locus string, grp int")
    groups.write_groups(seqs, part, str(tmp_path / "g"), F.lit("DNA"))
    texts = {(p.parent.name, p.parent.parent.name): p.read_text() for p in (tmp_path / "g").rglob("part-*")}
    assert sorted(v for (f, _), v in texts.items() if f == "file=alignment") == [" 1 1\nB T\n\n", " 2 6\nA ACGTGG\nB AC-T??\n\n"]
    assert sorted(v for (f, _), v in texts.items() if f == "file=partitions") == ["DNA, x = 1-4\nDNA, y = 5-6\n", "DNA, z = 1-1\n"]
    again = groups.keyed(part.withColumn("grp", 5 - F.col("grp"))).select("locus", "key").collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, groups.keyed(part).select("locus", "key").collect()))
    reps = seqs.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(9))))
    groups.write_replicates(reps, 10, str(tmp_path / "r"))
    assert len(list((tmp_path / "r").iterdir())) >= 30 and (tmp_path / "r" / "locus=x_01").exists() and (tmp_path / "r" / "locus=x_10").exists()


def test_checks():
    assert checks.one_of("a", "ab") == "a" and checks.in_range(1, 1, 2) == 1 and checks.indices([2, 0], 3) == [2, 0]
    for f, error in ((lambda: checks.one_of("c", "ab"), checks.OptionError), (lambda: checks.in_range(3, 1, 2), checks.RangeError), (lambda: checks.number("x"), checks.OptionError), (lambda: checks.number(True), checks.OptionError), (lambda: checks.indices([3], 3), checks.RangeError), (lambda: checks.indices([-1], 3), checks.RangeError), (lambda: checks.indices([0.5], 3), checks.OptionError), (lambda: checks.indices([1, 1], 3), checks.OptionError)):
        with pytest.raises(error):
            f()
    assert list(checks.chunks("abcde", 2, "-")) == [("a", "b"), ("c", "d"), ("e", "-")]
    assert checks.hcl_to_rgb(0, 0, 0) == (0, 0, 0) and max(abs(a - b) for a, b in zip(checks.hcl_to_rgb(15, 100, 65), (0.973, 0.463, 0.427))) < 0.01
    assert len(set(checks.wheel(5))) == 5 and checks.wheel(1)[0].startswith("#f8")


def test_paths_are_checked_where_spark_reads(spark, tmp_path):
    (tmp_path / "f").write_text("x")
    assert checks.directory(spark, str(tmp_path)) == str(tmp_path) and checks.file(spark, str(tmp_path / "f"))
    for f, error in ((lambda: checks.directory(spark, str(tmp_path / "f")), checks.DirectoryError), (lambda: checks.file(spark, str(tmp_path)), checks.FileError), (lambda: checks.file(spark, str(tmp_path / "none")), checks.FileError)):
        with pytest.raises(error):
            f()


def test_roots_go_and_come_back():
    rng = np.random.default_rng(2)
    for _ in range(30):
        t = treeops.yule([f"t{k}" for k in range(int(rng.integers(3, 12)))], rng)
        bare, side, a, b = treeops.reversibly_unrooted(t)
        back = treeops.rerooted(bare, side, a, b)
        assert back.rooted and not bare.rooted
        lengths = lambda x: {v: round(x.length[k] or 0.0, 9) for k, v in x.below().items() if k}
        assert lengths(back) == lengths(t)
    star = newick.parse("(a:1,b:2,c:3,d:4);")
    two = treeops.bifurcated(star)
    assert two.rooted and all(len(c) in (0, 2) for c in two.children) and newick.splits(two).keys() >= newick.splits(star).keys()
    assert sum(x or 0 for x in two.length) == 10
    with pytest.raises(ValueError):
        treeops.reversibly_unrooted(star)


def test_running_totals_and_pairs(spark):
    rng = np.random.default_rng(1)
    rows = [(int(k), float(v), None if k % 7 else "x") for k, v in zip(rng.permutation(500), rng.integers(0, 9, 500))]
    table = spark.createDataFrame(rows, "k long, v double, s string").repartition(6)
    for inclusive in (False, True):
        at = 0.0
        got = {r["k"]: r["sum"] for r in prefix.running(table, ["k"], {"sum": "v"}, inclusive).collect()}
        for k, v, _ in sorted(rows):
            assert got[k] == at + (v if inclusive else 0)
            at += v
    assert prefix.running(table.limit(0), ["k"], {"sum": "v"}).count() == 0
    met = pairs.every_pair(table.where("k < 60"), "k", 7).select("a.k", F.col("b.k").alias("other")).collect()
    assert sorted(map(tuple, met)) == [(i, j) for i in range(60) for j in range(i + 1, 60)]
    elements = spark.range(300).select(F.col("id").alias("elem"))
    part = {r["elem"]: r["grp"] for r in partition.random_labels(elements, 12, 5, alpha=0.05, fill=True).collect()}
    assert set(part.values()) == set(range(12)) and [part[k] for k in range(300)] == partition.growth([part[k] for k in range(300)])


@pytest.mark.parametrize("parametric", [False, True])
def test_replicates_have_the_shape_of_the_data(spark, parametric):
    made = estimate.simulate(spark.createDataFrame([(k, t) for k, t in enumerate(["((a:.1,b:.1):.1,c:.2,d:.2);", "((a:.1,c:.1):.1,b:.2,d:.2);"] * 2)], "tree_id long, newick string"), 60, 3)
    seqs = made.select(F.concat(F.lit("l"), F.col("tree_id")).alias("locus"), F.lit(0).alias("seq_idx"), "taxon", "seq")
    part = seqs.select("locus").distinct().withColumn("grp", F.col("locus").isin("l1", "l3").cast("int"))
    out = resample.replicates(seqs, part, 3, 7, parametric).collect()
    assert len(out) == 3 * 16 and {(r["rep"], r["locus"]) for r in out} == {(k, f"l{j}") for k in (1, 2, 3) for j in range(4)} and all(len(r["seq"]) == 60 for r in out)
    assert sorted(map(tuple, out)) == sorted(map(tuple, resample.replicates(seqs, part, 3, 7, parametric).collect()))


def test_command_line(tmp_path):
    run = lambda *a: subprocess.run([sys.executable, "-m", "sylvan", *map(str, a)], cwd=Path(__file__).parents[1], capture_output=True, text=True, timeout=600)
    made = run("-d", "-", "--simulate", 2, 3, 6, 80, "-o", tmp_path / "made")
    assert made.returncode == 0, made.stderr[-2000:]
    inputs = tmp_path / "in"
    inputs.mkdir()
    for p in (tmp_path / "made" / "alignments").rglob("part-*"):
        (inputs / f"g{p.parent.name.split('=')[1]}.phy").write_text(p.read_text())
    assert len(list(inputs.iterdir())) == 6
    done = run("-d", inputs, "-f", "phylip", "-m", "euc", "-c", "average", "-l", 1, "-u", 2, "-r", 1, "-o", tmp_path / "out", "--trees-out", tmp_path / "trees", "--groups-out", tmp_path / "groups", "--piecewise-distances")
    assert done.returncode == 0, done.stderr[-2000:]
    for name in ("out/distances", "out/memberships", "out/scores", "out/gains", "out/piecewise", "trees", "groups/1", "groups/2"):
        assert list((tmp_path / name).rglob("part-*")), name
