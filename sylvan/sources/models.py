"""Published amino-acid models (such as LG, WAG or JTT) from files in the PAML form."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

from sylvan.functions import likelihood as L


def parse_exchangeabilities(text: str) -> tuple[list[float], list[float]]:
    """(lower triangle row by row, frequencies) of 190 and 20 numbers; what follows them is a comment."""
    numbers = []
    for token in text.split():
        if not re.fullmatch(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?", token):
            break
        numbers.append(float(token))
    if len(numbers) < 210:
        raise ValueError(f"{len(numbers)} numbers instead of 190 exchangeabilities and 20 frequencies")
    rates, freqs = numbers[:190], numbers[190:210]
    if min(rates) < 0 or min(freqs) <= 0 or abs(sum(freqs) - 1) > 0.01:
        raise ValueError("rates are at least 0, and frequencies are above 0 and add up to 1")
    return rates, freqs


def model_text(rates: list[float], freqs: list[float]) -> str:
    """The file of a model."""
    rows = [" ".join(repr(float(x)) for x in rates[k * (k - 1) // 2 : k * (k + 1) // 2]) for k in range(1, 20)]
    return "\n".join([*rows, "", " ".join(repr(float(x)) for x in freqs), ""])


def read_model(spark: SparkSession, path: str) -> L.Model:
    """The model of one file, wherever Spark can read it."""
    return L.empirical(*parse_exchangeabilities(spark.read.text(path, wholetext=True).first()["value"]))
