"""Alignments as tables: (locus_id, locus, seq_idx, taxon, seq)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sylvan.functions.scalars import is_dna
from sylvan.operators.prefix import running


def sites(seqs: DataFrame) -> DataFrame:
    """(locus, pos, seq_idx, taxon, ch): one row for each residue."""
    return seqs.select("locus", "seq_idx", "taxon", F.posexplode(F.split("seq", "")).alias("pos", "ch"))


def site_patterns(seqs: DataFrame) -> DataFrame:
    """(locus, pattern, n): how often each column of a locus occurs.

    Columns are formed by transposing a locus's few sequences in one row, so only patterns are shuffled.
    """
    rows = seqs.groupBy("locus").agg(F.array_sort(F.collect_list(F.struct("seq_idx", "seq"))).alias("rows"))
    column = lambda i: F.array_join(F.transform("rows", lambda r: F.substring(r["seq"], i, F.lit(1))), "")
    wide = rows.select("locus", F.explode(F.transform(F.sequence(F.lit(1), F.length(F.get("rows", F.lit(0))["seq"])), column)).alias("pattern"))
    return wide.groupBy("locus", "pattern").agg(F.count("*").alias("n"))


def unconstrained_lnl(seqs: DataFrame) -> DataFrame:
    """(locus, n_patterns, lnl): the multinomial log likelihood of the columns, sum n ln n - N ln N."""
    p = site_patterns(seqs).groupBy("locus").agg(F.count("*").alias("n_patterns"), F.sum("n").alias("total"), F.sum(F.col("n") * F.ln("n")).alias("s"))
    return p.select("locus", "n_patterns", (F.col("s") - F.col("total") * F.ln("total")).alias("lnl"))


def alphabets(seqs: DataFrame) -> DataFrame:
    """(locus, datatype): dna if every residue of every sequence may be, else protein."""
    return seqs.groupBy("locus").agg(F.when(F.bool_and(is_dna(F.col("seq"))), F.lit("dna")).otherwise(F.lit("protein")).alias("datatype"))


def concatenated(seqs: DataFrame, pad: str = "?") -> DataFrame:
    """(taxon, seq, n_loci): loci joined in order for every taxon, padded where a taxon is missing.

    The grid of taxa and loci is what the result spells out: a row's text holds a part for each locus.
    """
    lengths = seqs.groupBy("locus").agg(F.max(F.length("seq")).alias("n"))
    grid = seqs.select("taxon").distinct().crossJoin(lengths)
    rows = grid.join(seqs.select("taxon", "locus", "seq"), ["taxon", "locus"], "left")
    part = F.struct("locus", F.coalesce("seq", F.repeat(F.lit(pad), F.col("n"))).alias("seq"))
    out = rows.groupBy("taxon").agg(F.array_sort(F.collect_list(part)).alias("parts"), F.count("seq").alias("n_loci"))
    return out.select("taxon", F.array_join(F.transform("parts", lambda p: p["seq"]), "").alias("seq"), "n_loci")


def running_offsets(lengths: DataFrame, group: str | None = None) -> DataFrame:
    """(…, start, stop), 1-based, of loci (locus, n) laid end to end in order, within each group if named."""
    if group is None:
        placed = running(lengths, ["locus"], {"stop": "n"}, inclusive=True)
    else:
        placed = lengths.withColumn("stop", F.sum("n").over(W.partitionBy(group).orderBy("locus").rowsBetween(W.unboundedPreceding, 0)))
    return placed.withColumn("start", F.col("stop") - F.col("n") + 1)


def partition_lines(offsets: DataFrame, model: Column, sep_codon_pos: bool = False, ml_freqs: bool = False, emp_freqs: bool = False) -> DataFrame:
    """(locus, line): the lines of a partition file; codon positions give three lines a locus."""
    suffix = "X" if ml_freqs else "F" if emp_freqs else ""
    name = F.concat(model, F.lit(suffix))
    if not sep_codon_pos:
        return offsets.select("locus", F.format_string("%s, %s = %d-%d", name, "locus", "start", "stop").alias("line"))
    rows = offsets.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2))))
    return rows.select("locus", F.format_string("%s, %s_%d = %d-%d/3", name, "locus", F.col("k") + 1, F.col("start") + F.col("k"), "stop").alias("line"))


def length_line(lengths: DataFrame) -> DataFrame:
    """One row (value): 'G n len1 len2 ...'."""
    rows = F.array_sort(F.collect_list(F.struct("locus", "n")))
    return lengths.agg(F.concat(F.lit("G "), F.count("*").cast("string"), F.lit(" "), F.array_join(F.transform(rows, lambda r: r["n"].cast("string")), " ")).alias("value"))


def species(seqs: DataFrame) -> DataFrame:
    """(locus, n_taxa, coverage): taxa of each locus, and their share of all taxa."""
    everyone = seqs.select("taxon").distinct().agg(F.count("*").alias("all"))
    per = seqs.groupBy("locus").agg(F.countDistinct("taxon").alias("n_taxa"))
    return per.crossJoin(F.broadcast(everyone)).select("locus", "n_taxa", (F.col("n_taxa") / F.col("all")).alias("coverage"))


def genome_map(seqs: DataFrame) -> DataFrame:
    """(locus, taxon, place): a taxon's 1-based row in a locus, -1 if it has none."""
    grid = seqs.select("taxon").distinct().crossJoin(seqs.select("locus").distinct())
    return grid.join(seqs.select("locus", "taxon", "seq_idx"), ["locus", "taxon"], "left").select("locus", "taxon", F.coalesce(F.col("seq_idx") + 1, F.lit(-1)).cast("long").alias("place"))


def jc69(seqs: DataFrame, states: int = 4) -> DataFrame:
    """(locus, a, b, n, p, d): closed-form distances of every two sequences of a locus.

    Columns with a gap or unknown in either don't count; d is null from saturation on.
    """
    a = seqs.select("locus", F.col("taxon").alias("a"), F.col("seq").alias("x"))
    b = seqs.select("locus", F.col("taxon").alias("b"), F.col("seq").alias("y"))
    pairs = a.join(b, "locus").where("a < b")
    known = r"[-?XxNn]"
    both = F.filter(F.arrays_zip(F.split("x", "").alias("x"), F.split("y", "").alias("y")), lambda p: ~p["x"].rlike(known) & ~p["y"].rlike(known))
    rows = pairs.select("locus", "a", "b", both.alias("both")).select("locus", "a", "b", F.size("both").cast("long").alias("n"), F.size(F.filter("both", lambda p: p["x"] != p["y"])).alias("k"))
    p = F.try_divide(F.col("k").cast("double"), F.col("n"))
    top = (states - 1) / states
    rows = rows.withColumn("p", p)
    return rows.select("locus", "a", "b", "n", "p", F.when(F.col("p") < top, F.lit(-top) * F.ln(F.lit(1.0) - F.col("p") / F.lit(top))).alias("d"))


def character_matrix(seqs: DataFrame) -> DataFrame:
    """(locus, taxon, characters): rows as arrays."""
    return seqs.select("locus", "taxon", F.split("seq", "").alias("characters"))


def from_characters(matrix: DataFrame) -> DataFrame:
    return matrix.select("locus", "taxon", F.array_join("characters", "").alias("seq"))


def bootstrap(seqs: DataFrame, replicates: int, seed: int) -> DataFrame:
    """(rep, locus, seq_idx, taxon, seq): columns drawn with replacement, then in order of place.

    A draw is a hash of (seed, replicate, locus, number), the same for all sequences of a locus.
    """
    rows = seqs.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    draw = lambda k: F.pmod(F.xxhash64(F.lit(seed), "rep", "locus", k), F.length("seq")).cast("int") + 1
    places = F.array_sort(F.transform(F.sequence(F.lit(1), F.length("seq")), draw))
    return rows.select("rep", "locus", "seq_idx", "taxon", F.array_join(F.transform(places, lambda i: F.substring(F.col("seq"), i, F.lit(1))), "").alias("seq"))


def permuted(seqs: DataFrame, groups: DataFrame, seed: int) -> DataFrame:
    """Sequences with the columns of each group's loci shuffled over the group, cut back to locus lengths.

    ``groups`` is (locus, grp). Every column of the group has a hash; sorted by it, columns are dealt to the
    loci by running offsets. Taxa that a locus lacks are padded.
    """
    lengths = seqs.groupBy("locus").agg(F.max(F.length("seq")).alias("n")).join(groups, "locus")
    places = running_offsets(lengths, "grp")
    wide = seqs.join(groups, "locus").select("grp", "taxon").distinct().join(lengths, "grp").join(seqs.select("locus", "taxon", "seq"), ["locus", "taxon"], "left")
    part = F.struct("locus", F.coalesce("seq", F.repeat(F.lit("?"), F.col("n"))).alias("seq"))
    whole = wide.groupBy("grp", "taxon").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["seq"]), "").alias("seq"))
    keyed = F.array_sort(F.transform(F.sequence(F.lit(1), F.length("seq")), lambda i: F.struct(F.xxhash64(F.lit(seed), "grp", i).alias("h"), i.alias("i"))))
    mixed = whole.select("grp", "taxon", F.array_join(F.transform(keyed, lambda p: F.substring(F.col("seq"), p["i"], F.lit(1))), "").alias("seq"))
    return mixed.join(places, "grp").select("locus", "taxon", F.substring(F.col("seq"), F.col("start").cast("int"), F.col("n")).alias("seq"))


def gap_positions(seqs: DataFrame) -> DataFrame:
    return sites(seqs).where("ch = '-'").select("locus", "taxon", "pos")
