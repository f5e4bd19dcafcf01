"""Scalar building blocks as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOCK_PREFIX = "Computed response for: "


def prompt_key(prompt: Column) -> Column:
    """SHA-256 of the prompt as it is: case and white space count."""
    return F.sha2(prompt, 256)


def token_count(text: Column) -> Column:
    """White-space separated tokens; 0 for empty text."""
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda t: t != ""))


def mock_answer(prompt: Column) -> Column:
    return F.concat(F.lit(MOCK_PREFIX), F.reverse(prompt))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def normalised(v: Column) -> Column:
    """The unit vector; a zero vector stays as it is. The norm is evaluated once."""
    d = v.cast("array<double>")
    scaled = F.transform(F.array(norm(d)), lambda n: F.when(n == 0, d).otherwise(F.transform(d, lambda x: x / n)))
    return F.element_at(scaled, 1)


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def similarity(distance: Column) -> Column:
    return 1.0 / (1.0 + distance)


def is_hit(sim: Column, threshold: Column) -> Column:
    """The threshold itself is a hit, and so is NaN."""
    return ~F.coalesce(sim < threshold, F.lit(True))


def is_close(x: Column, y: float, rel: float = 1e-9, least: float = 1e-12) -> Column:
    return F.abs(x - y) <= F.greatest(F.greatest(F.abs(x), F.lit(abs(y))) * rel, F.lit(least))


def ratio(num: Column, den: Column) -> Column:
    """0.0 where the denominator is 0, never null."""
    return F.when(den == 0, 0.0).otherwise(num / den)


def expired(now: Column, expires_at: Column) -> Column:
    return F.coalesce(now > expires_at, F.lit(False))


def blank(text: Column) -> Column:
    return F.coalesce(F.regexp_replace(text, r"(?U)\s+", "") == "", F.lit(True))


def config_id(model: Column, workload: Column, threshold: Column) -> Column:
    return F.format_string("%s|%s|%.2f", model, workload, threshold.cast("double"))
