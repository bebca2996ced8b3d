"""Model parameters from the text logs of tree-inference programs, as Spark expressions over whole texts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

NUMBER = r"[-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?"


def _one(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _doubles(text: Column) -> Column:
    return F.transform(_all(text, f"({NUMBER})"), lambda x: x.cast("double"))


def search_log(text: Column) -> Column:
    """A struct (likelihood, best, partitions) of a multi-start search log.

    The best start has the highest final likelihood, the first of equals; partitions is a map from number
    to (name, model, alpha, frequencies, rates) of that start.
    """
    finals = F.transform(_all(text, rf"Inference\[\d+\] final GAMMA-based Likelihood: ({NUMBER})"), lambda x: x.cast("double"))
    best = (F.array_position(finals, F.array_max(finals)) - 1).cast("int")
    lines = _all(text, r"(?m)^(alpha\[0\]:.*)$")
    line = F.get(lines, best)
    alphas = F.transform(_all(line, rf"alpha\[\d+\]: ({NUMBER})"), lambda x: x.cast("double"))
    rates = _all(line, rf"rates\[\d+\][^:]*: ((?:{NUMBER} ?)+)")
    freqs = _all(line, rf"freqs\[\d+\]: ((?:{NUMBER} ?)+)")
    names, models = _all(text, r"(?m)^Name: (.*)$"), _all(text, r"(?m)^Substitution Matrix: (.*)$")
    keys = F.sequence(F.lit(0), F.size(alphas) - 1)
    part = lambda i: F.struct(F.trim(F.get(names, i)).alias("name"), F.trim(F.get(models, i)).alias("model"), F.get(alphas, i).alias("alpha"), _doubles(F.get(freqs, i)).alias("frequencies"), _doubles(F.get(rates, i)).alias("rates"))
    whole = F.when(F.size(alphas) > 0, F.map_from_arrays(keys, F.transform(keys, part)))
    return F.struct(F.array_max(finals).alias("likelihood"), best.alias("best"), whole.alias("partitions"))


def evaluation_log(text: Column) -> Column:
    """The same struct from the log of a model optimisation on a fixed tree."""
    blocks = F.slice(F.split(text, r"Model Parameters of Partition "), 2, 1_000_000)
    models = _all(text, r"(?m)^Substitution Matrix: (.*)$")
    number = lambda b: F.regexp_extract(b, r"^(\d+)", 1).cast("int")
    of = lambda b, i: F.struct(
        F.regexp_extract(b, r"Name: (.*?), Type of Data", 1).alias("name"),
        F.trim(F.get(models, i)).alias("model"),
        _one(b, rf"alpha: ({NUMBER})").cast("double").alias("alpha"),
        F.transform(_all(b, rf"freq pi\([^)]*\): ({NUMBER})"), lambda x: x.cast("double")).alias("frequencies"),
        F.transform(_all(b, rf"rate \S+ <-> \S+: ({NUMBER})"), lambda x: x.cast("double")).alias("rates"),
    )
    return F.struct(
        _one(text, rf"Final GAMMA\s+likelihood: ({NUMBER})").cast("double").alias("likelihood"),
        F.lit(0).alias("best"),
        F.map_from_arrays(F.transform(blocks, number), F.transform(blocks, of)).alias("partitions"),
    )


def statistics_log(text: Column) -> Column:
    """(model, alpha, likelihood, frequencies, rates) of a nucleotide statistics file.

    Frequencies and rates follow the model: equal where it fixes them, transitions by the printed ratio.
    """
    model = _one(text, r"Model of[^\n]*substitution:\s+(\S+)")
    ratio = F.transform(_all(text, rf"Transition/transversion ratio[^:\n]*:\s+({NUMBER})"), lambda x: x.cast("double"))
    freqs = F.transform(_all(text, rf"f\([ACGT]\)=\s+({NUMBER})"), lambda x: x.cast("double"))
    rates = F.transform(_all(text, rf"[ACGT]\s+<->\s+[ACGT]\s+({NUMBER})"), lambda x: x.cast("double"))
    one, first, second = F.lit(1.0), F.get(ratio, F.lit(0)), F.get(ratio, F.lit(1))
    by = lambda a, b: F.array(one, a, one, one, b, one)
    return F.struct(
        model.alias("model"),
        _one(text, rf"Gamma shape parameter:\s+({NUMBER})").cast("double").alias("alpha"),
        _one(text, rf"Log-likelihood:\s+({NUMBER})").cast("double").alias("likelihood"),
        F.when(model.isin("JC69", "K80"), F.array(*[F.lit(0.25)] * 4)).otherwise(freqs).alias("frequencies"),
        F.when(model.isin("JC69", "F81"), by(one, one)).when(model.isin("K80", "F84", "HKY85"), by(first, first)).when(model == "TN93", by(first, second)).otherwise(rates).alias("rates"),
    )


def approximate_log(text: Column) -> Column:
    """(likelihood, alpha, frequencies, rates) of an approximate-search log; frequencies sum to 1."""
    from sylvan.functions.scalars import smoothed_frequencies

    freqs = _doubles(F.regexp_extract(text, r"GTR Frequencies:\s+([^\n]*)", 1))
    return F.struct(
        F.element_at(F.transform(_all(text, rf"(?:ML_Lengths\S*\s+LogLk\s*=\s*|loglk\s+|LogLk\s*=\s*)({NUMBER})"), lambda x: x.cast("double")), -1).alias("likelihood"),
        _one(text, rf"alpha\s*=?\s*({NUMBER})").cast("double").alias("alpha"),
        F.when(F.size(freqs) > 0, smoothed_frequencies(freqs)).alias("frequencies"),
        _doubles(F.regexp_extract(text, r"GTR rates\(ac ag at cg ct gt\)\s+([^\n]*)", 1)).alias("rates"),
    )
