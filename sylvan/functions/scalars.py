"""Scalar functions as Spark column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

#: IUPAC nucleotide codes and the bases each stands for (fixed values).
IUPAC = {
    "A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC",
    "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT",
}


def natural_key(path: Column) -> Column:
    """A sort key in which runs of digits count as numbers: each is padded to 20 places."""
    pieces = F.regexp_extract_all(path, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(r"^\d"), F.lpad(F.regexp_replace(p, r"^0+(?=\d)", ""), 20, "0")).otherwise(p)), "")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def strip_extensions(path: Column) -> Column:
    """The file's name without any of its extensions."""
    return F.regexp_extract(base_name(path), r"^(\.*[^.]*)", 1)


def is_dna(seq: Column) -> Column:
    """Whether all residues, gaps and unknowns apart, are nucleotide codes; deterministic, over the whole sequence."""
    return ~F.upper(seq).rlike("[^-?XGATCRYWSMKHBVDN]")


def gap_masked(simulated: Column, original: Column) -> Column:
    """The simulated sequence with a gap wherever the original has one; lengths must agree."""
    chars = F.zip_with(F.split(simulated, ""), F.split(original, ""), lambda s, o: F.when(o == "-", F.lit("-")).otherwise(s))
    return F.when(F.length(simulated) == F.length(original), F.array_join(chars, ""))


def _mask(c: Column) -> Column:
    """The bases of a code as bits."""
    bit = {"A": 1, "C": 2, "G": 4, "T": 8}
    table = F.create_map(*[F.lit(x) for code, bases in IUPAC.items() for x in (code, sum(bit[b] for b in bases))])
    return table[F.upper(c)]


def ambiguous(a: Column, b: Column, delete_ambiguous: bool = False) -> Column:
    """The union of two sequences column by column in IUPAC codes.

    A gap in either gives a gap; a column is upper case if either is. With ``delete_ambiguous`` a sequence
    with any disagreement becomes all X.
    """
    bit = {"A": 1, "C": 2, "G": 4, "T": 8}
    code = F.create_map(*[F.lit(x) for c, bases in IUPAC.items() for x in (sum(bit[k] for k in bases), c)])

    def one(x: Column, y: Column) -> Column:
        both = code[_mask(x).bitwiseOR(_mask(y))]
        lower = (x == F.lower(x)) & (y == F.lower(y))
        return F.when((x == "-") | (y == "-"), F.lit("-")).when(F.upper(x) == F.upper(y), F.when(lower, F.lower(x)).otherwise(F.upper(x))).otherwise(F.when(lower, F.lower(both)).otherwise(both))

    out = F.array_join(F.zip_with(F.split(a, ""), F.split(b, ""), one), "")
    if not delete_ambiguous:
        return out
    differs = F.exists(F.arrays_zip(F.split(a, "").alias("x"), F.split(b, "").alias("y")), lambda p: (p["x"] != "-") & (p["y"] != "-") & (F.upper(p["x"]) != F.upper(p["y"])))
    return F.when(differs, F.repeat(F.lit("X"), F.length(a))).otherwise(out)


def is_empty_sequence(seq: Column) -> Column:
    return seq.rlike("^X+$")


def name_prefix(name: Column) -> Column:
    """A name without its last .part."""
    return F.regexp_replace(name, r"\.[^.]*$", "")


def smoothed_frequencies(freqs: Column) -> Column:
    total = F.aggregate(freqs, F.lit(0.0), lambda a, x: a + x)
    return F.transform(F.array(total), lambda t: F.transform(freqs, lambda x: x / t))[0]


def model_name(model: Column) -> Column:
    return F.when(model == "LG", F.lit("LG08")).when(model == "WAG", F.lit("WAG01")).otherwise(model)


def pair_count(n: Column) -> Column:
    """n (n - 1) / 2."""
    return (n * (n - 1) / 2).cast("long")


def weighted_means(value: Column, weight: Column) -> dict[str, Column]:
    """Weighted arithmetic, geometric and harmonic means as aggregates."""
    total = F.sum(weight)
    return {
        "amean": F.try_divide(F.sum(weight * value), total),
        "gmean": F.exp(F.try_divide(F.sum(weight * F.ln(value)), total)),
        "hmean": F.try_divide(total, F.sum(weight / value)),
    }


def truncated_exponential(most: float, scale: float, seed: int) -> Column:
    """Draws from an exponential cut at ``most``, by inversion."""
    import math

    return F.lit(-scale) * F.ln(F.lit(1.0) - F.rand(seed) * F.lit(1.0 - math.exp(-most / scale)))


def translated(text: Column, table: dict[str, str]) -> Column:
    """All keys replaced at once, longest first, in one pass over the text."""
    import re

    keys = sorted(table, key=lambda k: (-len(k), k))
    pattern = "|".join(re.escape(k) for k in keys)
    lookup = F.create_map(*[F.lit(x) for k in keys for x in (k, table[k])])
    found, parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern)
    return F.array_join(F.zip_with(parts, F.transform(found, lambda k: lookup[k]), lambda p, r: F.concat(p, F.coalesce(r, F.lit("")))), "")


def insorted(values: Column, value: Column) -> Column:
    """A sorted array with the value put in, unless it is there."""
    return F.array_sort(F.array_union(values, F.array(value)))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def formatted_sequence(seq: Column, case: str | None = None, remove_gaps: bool = False) -> Column:
    """A sequence in upper or lower case, with or without its gaps."""
    out = {"upper": F.upper, "lower": F.lower, None: lambda c: c}[case](seq)
    return F.replace(out, F.lit("-"), F.lit("")) if remove_gaps else out
