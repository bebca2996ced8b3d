"""Writers by group: concatenated alignments with their partition files, bootstrap replicates, simulated data."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from sylvan.operators import align
from sylvan.sources.alignments import alignment_text


def keyed(part: DataFrame) -> DataFrame:
    """(locus, grp, key): the key is a digest of the group's members, the same whatever the group's number."""
    key = part.groupBy("grp").agg(F.sha1(F.array_join(F.array_sort(F.collect_list("locus")), "\n")).alias("key"))
    return part.select("locus", "grp").join(key, "grp")


def grouped(seqs: DataFrame, part: DataFrame, pad: str = "?") -> DataFrame:
    """(grp, taxon, seq): each group's loci (locus, grp) laid end to end, padded where a taxon is missing."""
    own = seqs.select("locus", "taxon", "seq").join(part.select("locus", "grp"), "locus")
    lengths = own.groupBy("grp", "locus").agg(F.max(F.length("seq")).alias("n"))
    rows = own.select("grp", "taxon").distinct().join(lengths, "grp").join(own, ["grp", "taxon", "locus"], "left")
    piece = F.struct("locus", F.coalesce("seq", F.repeat(F.lit(pad), F.col("n"))).alias("seq"))
    joined = rows.groupBy("grp", "taxon").agg(F.array_sort(F.collect_list(piece)).alias("parts"))
    return joined.select("grp", "taxon", F.array_join(F.transform("parts", lambda p: p["seq"]), "").alias("seq"))


def group_files(seqs: DataFrame, part: DataFrame, model: Column, kind: str = "phylip") -> DataFrame:
    """(key, file, value): each group's alignment, and the lines of its partition file; model is a column over locus."""
    named = keyed(part)
    whole = grouped(seqs, part).join(named.select("grp", "key").distinct(), "grp")
    texts = alignment_text(whole.select(F.col("key").alias("locus"), F.col("taxon").alias("seq_idx"), "taxon", "seq"), kind)
    lengths = seqs.groupBy("locus").agg(F.max(F.length("seq")).alias("n")).join(named, "locus")
    places = align.running_offsets(lengths, "key")
    line = F.format_string("%s, %s = %d-%d", model, "locus", "start", "stop")
    lines = places.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", line.alias("line")))).alias("r"))
    lines = lines.select("key", F.array_join(F.transform("r", lambda x: x["line"]), "\n").alias("value"))
    return texts.select(F.col("locus").alias("key"), F.lit("alignment").alias("file"), F.col("text").alias("value")).union(lines.select("key", F.lit("partitions").alias("file"), "value"))


def write_groups(seqs: DataFrame, part: DataFrame, path: str, model: Column | None = None, kind: str = "phylip") -> None:
    """A folder for each group's key, with a folder for its alignment and one for its partition file."""
    group_files(seqs, part, F.lit("DNA") if model is None else model, kind).write.partitionBy("key", "file").text(path)


def replicate_name(name: Column, rep: Column, replicates: int) -> Column:
    """The name with the replicate's number from 1, as wide as the last one's."""
    return F.concat(name, F.lit("_"), F.lpad((rep + 1).cast("string"), max(1, math.ceil(math.log10(replicates + 1))), "0"))


def write_replicates(replicates: DataFrame, n: int, path: str, kind: str = "phylip") -> None:
    """A folder for each replicate of each locus of (rep, locus, seq_idx, taxon, seq)."""
    rows = replicates.withColumn("locus", replicate_name(F.col("locus"), F.col("rep"), n))
    alignment_text(rows, kind).withColumnRenamed("text", "value").write.partitionBy("locus").text(path)


def write_simulation(genes: DataFrame, seqs: DataFrame, path: str, kind: str = "phylip") -> None:
    """Trees (gene, class, newick), alignments (tree_id, taxon, seq) of the genes, and the true partition, under one folder."""
    genes.select("gene", F.col("newick").alias("value")).write.partitionBy("gene").text(f"{path}/trees")
    named = seqs.select(F.col("tree_id").cast("string").alias("locus"), F.col("taxon").alias("seq_idx"), "taxon", "seq")
    alignment_text(named, kind).withColumnRenamed("text", "value").write.partitionBy("locus").text(f"{path}/alignments")
    genes.select("gene", "class").write.option("header", True).option("sep", "\t").csv(f"{path}/partition")
