"""Readers and writers of sequence alignments: FASTA and relaxed PHYLIP, plain, gzip or bzip2.

A directory is read with Spark's whole-text source (codecs by suffix), one row a file, and parsed into the
long table (locus_id, locus, seq_idx, taxon, seq). Loci are numbered in natural order of their paths.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sylvan.functions.scalars import natural_key, strip_extensions
from sylvan.operators.prefix import running

SUFFIXES = {"fasta": ("fa", "fas", "fasta"), "phylip": ("phy",)}
SEQUENCES = "locus string, seq_idx int, taxon string, seq string"


class NoRecordsError(ValueError):
    """A directory holds no file of the format."""


def parse_fasta(text: str) -> list[tuple[str, str]]:
    out: list[tuple[str, list[str]]] = []
    for line in text.splitlines():
        if line.startswith(">"):
            out.append((line[1:].strip().split()[0] if line[1:].strip() else "", []))
        elif line.strip():
            if not out:
                raise ValueError("sequence before the first > line")
            out[-1][1].append("".join(line.split()))
    return [(n, "".join(s)) for n, s in out]


def parse_phylip(text: str) -> list[tuple[str, str]]:
    """Relaxed PHYLIP: interleaved first, and sequential if the lengths don't come out."""
    lines = text.splitlines()
    while lines and not lines[0].strip():
        lines.pop(0)
    try:
        taxa, columns = map(int, lines[0].split()[:2])
    except (IndexError, ValueError) as err:
        raise ValueError("no PHYLIP header") from err
    body = [x for x in lines[1:] if x.strip()]
    for read in (_interleaved, _sequential):
        rows = read(body, taxa, columns)
        if rows and len(rows) == taxa and all(len(s) == columns for _, s in rows):
            return rows
    raise ValueError(f"not {taxa} sequences of {columns} columns")


def _interleaved(body: list[str], taxa: int, columns: int) -> list[tuple[str, str]]:
    rows: list[tuple[str, list[str]]] = []
    for k, line in enumerate(body):
        if k < taxa:
            name, _, rest = line.strip().partition(" ")
            rows.append((name, ["".join(rest.split())]))
        else:
            rows[k % taxa][1].append("".join(line.split()))
    return [(n, "".join(s)) for n, s in rows]


def _sequential(body: list[str], taxa: int, columns: int) -> list[tuple[str, str]]:
    rows: list[tuple[str, str]] = []
    for line in body:
        if not rows or len(rows[-1][1]) >= columns:
            name, _, rest = line.strip().partition(" ")
            rows.append((name, "".join(rest.split())))
        else:
            rows[-1] = (rows[-1][0], rows[-1][1] + "".join(line.split()))
    return rows


def _globs(kind: str) -> str:
    return "{" + ",".join(f"*.{s}{z}" for s in SUFFIXES[kind] for z in ("", ".gz", ".bz2")) + "}"


def read_alignments(spark: SparkSession, path: str, kind: str, header: Callable[[Column], Column] | None = None) -> DataFrame:
    """(locus_id, locus, seq_idx, taxon, seq) of all files of a directory (not of its subfolders)."""
    if kind not in SUFFIXES:
        raise ValueError(f"{kind} is none of {sorted(SUFFIXES)}")
    files = spark.read.option("pathGlobFilter", _globs(kind)).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    if files.isEmpty():
        raise NoRecordsError(f"no {kind} files in {path}")
    parse = parse_fasta if kind == "fasta" else parse_phylip

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = parse(text)
                yield pa.RecordBatch.from_pydict({"path": pa.array([name] * len(rows)), "seq_idx": pa.array(range(len(rows)), pa.int32()), "taxon": pa.array([n for n, _ in rows]), "seq": pa.array([s for _, s in rows])})

    rows = files.mapInArrow(run, "path string, seq_idx int, taxon string, seq string")
    order = running(files.select("path", natural_key(F.col("path")).alias("key"), F.lit(1).alias("one")), ["key", "path"], {"locus_id": "one"}).select("path", F.col("locus_id").cast("int").alias("locus_id"))
    taxon = header(F.col("taxon")) if header else F.col("taxon")
    return rows.join(order, "path").select("locus_id", strip_extensions(F.col("path")).alias("locus"), "seq_idx", taxon.alias("taxon"), "seq")


def alignment_text(sequences: DataFrame, kind: str = "phylip") -> DataFrame:
    """(locus, text): each locus as one file's text."""
    if kind == "fasta":
        line = F.concat(F.lit(">"), F.col("taxon"), F.lit("\n"), F.col("seq"))
        head = F.lit("")
    else:
        line = F.concat(F.col("taxon"), F.lit(" "), F.col("seq"))
        head = F.concat(F.lit(" "), F.size("rows").cast("string"), F.lit(" "), F.col("n").cast("string"), F.lit("\n"))
    rows = sequences.groupBy("locus").agg(F.array_sort(F.collect_list(F.struct("seq_idx", line.alias("line")))).alias("rows"), F.max(F.length("seq")).alias("n"))
    return rows.select("locus", F.concat(head, F.array_join(F.transform("rows", lambda r: r["line"]), "\n"), F.lit("\n")).alias("text"))


def write_alignments(sequences: DataFrame, path: str, kind: str = "phylip") -> None:
    """One text file in a folder for each locus."""
    alignment_text(sequences, kind).withColumnRenamed("text", "value").write.partitionBy("locus").text(path)


def attach(loci: DataFrame, extra: DataFrame) -> DataFrame:
    """Loci with what a directory has for them, trees or parameters; loci without stay, with nulls."""
    return loci.join(extra, "locus", "left")


def read_trees(spark: SparkSession, path: str) -> DataFrame:
    """(locus, newick) of the .nwk files of a directory."""
    files = spark.read.option("pathGlobFilter", "*.nwk*").text(path, wholetext=True)
    return files.select(strip_extensions(F.col("_metadata.file_path")).alias("locus"), F.trim("value").alias("newick"))
