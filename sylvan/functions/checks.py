"""Checks of arguments, with errors that say what was asked for, and small helpers."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence


class OptionError(ValueError):
    """A value that is none of the options."""


class RangeError(ValueError):
    """A number outside of its range."""


class DirectoryError(ValueError):
    """A folder that Spark can't find."""


class FileError(ValueError):
    """A file that Spark can't find."""


def one_of(value: object, options: Iterable) -> object:
    options = list(options)
    if value not in options:
        raise OptionError(f"{value!r} is none of {options}")
    return value


def in_range(value: float, low: float, high: float) -> float:
    """The number, if it lies in the range, ends included."""
    if not low <= number(value) <= high:
        raise RangeError(f"{value!r} isn't from {low} to {high}")
    return value


def number(value: object) -> object:
    if isinstance(value, bool) or not isinstance(value, (int, float)) or math.isnan(value):
        raise OptionError(f"{value!r} isn't a number")
    return value


def indices(found: Sequence[int], n: int) -> list[int]:
    """Distinct whole numbers from 0 to n - 1, as places of loci to be joined."""
    for k in found:
        if isinstance(k, bool) or not isinstance(k, int):
            raise OptionError(f"{k!r} isn't a whole number")
        in_range(k, 0, n - 1)
    if len(set(found)) != len(found):
        raise OptionError("an index occurs twice")
    return list(found)


def _status(spark, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.getFileStatus(hadoop) if system.exists(hadoop) else None


def directory(spark, path: str) -> str:
    """The path, if it is a folder in whatever store it names."""
    found = _status(spark, path)
    if found is None or not found.isDirectory():
        raise DirectoryError(f"no folder {path}")
    return path


def file(spark, path: str) -> str:
    found = _status(spark, path)
    if found is None or found.isDirectory():
        raise FileError(f"no file {path}")
    return path


def chunks(items: Iterable, size: int, fill: object = None) -> Iterator[tuple]:
    """Items by ``size``, the last ones filled up."""
    held: list = []
    for x in items:
        held.append(x)
        if len(held) == size:
            yield tuple(held)
            held = []
    if held:
        yield tuple(held + [fill] * (size - len(held)))


def hcl_to_rgb(hue: float, chroma: float, luminance: float, gamma: float = 2.4) -> tuple[float, float, float]:
    """Red, green and blue in [0, 1] of a colour in polar CIE LUV coordinates (white point D65)."""
    if luminance <= 0:
        return (0.0, 0.0, 0.0)
    white_y, white_u, white_v = 100.0, 0.1978398, 0.4683363
    y = white_y * (((luminance + 16) / 116) ** 3 if luminance > 8 else luminance / 903.3)
    u = chroma * math.cos(math.radians(hue)) / (13 * luminance) + white_u
    v = chroma * math.sin(math.radians(hue)) / (13 * luminance) + white_v
    x = 9 * y * u / (4 * v)
    z = -x / 3 - 5 * y + 3 * y / v
    linear = (3.240479 * x - 1.537150 * y - 0.498535 * z, -0.969256 * x + 1.875992 * y + 0.041556 * z, 0.055648 * x - 0.204043 * y + 1.057311 * z)
    bent = [c / white_y for c in linear]
    bent = [1.055 * c ** (1 / gamma) - 0.055 if c > 0.00304 else 12.92 * c for c in bent]
    return tuple(min(1.0, max(0.0, c)) for c in bent)


def wheel(n: int, chroma: float = 100.0, luminance: float = 65.0, start: float = 15.0) -> list[str]:
    """n colours at equal steps of hue, as #rrggbb."""
    return ["#" + "".join(f"{round(255 * c):02x}" for c in hcl_to_rgb(start + 360 * k / n, chroma, luminance)) for k in range(n)]
