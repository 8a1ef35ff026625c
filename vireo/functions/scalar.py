"""Scalar functions in built-in expressions: confidence, distances, scores, keys and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
EXTENSIONS = (".png", ".jpg", ".jpeg", ".webp", ".bmp")


def clamp(value: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def threshold_for_confidence(confidence: Column) -> Column:
    """Hamming threshold of a confidence in percent: 100 is 0 bits, 0 is 40."""
    return F.round((100 - clamp(confidence.cast("int"), 0, 100)) * F.lit(0.4)).cast("int")


def confidence_for_threshold(threshold: Column) -> Column:
    return (100 - threshold / F.lit(0.4)).cast("int")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def quality_score(sharpness: Column, contrast: Column, entropy: Column, saturation: Column, corrupt: Column | None = None) -> Column:
    """0 to 100 (contrast is not capped): up to 35 for sharpness, 25 for entropy, 20 for saturation, and 20 times the contrast."""
    zero = F.lit(0.0)
    sharp, detail, colour = F.coalesce(sharpness, zero), F.coalesce(entropy, zero), F.coalesce(saturation, zero)
    score = F.least(F.lit(1.0), F.log10(F.greatest(F.lit(1.0), sharp)) / 4.5) * 35 + F.coalesce(contrast, zero) * 20
    score = F.round(score + F.least(F.lit(1.0), detail) * 25 + F.least(F.lit(1.0), colour * 2) * 20, 1)
    return score if corrupt is None else F.when(F.coalesce(corrupt.cast("int"), F.lit(0)) != 0, zero).otherwise(score)


def contains_like(column: Column, text: str) -> Column:
    """Substring test where % and _ in text are wildcards, A-Z match without case, and nothing escapes."""
    pattern = text.translate(str.maketrans(UPPER, LOWER)).replace("\\", "\\\\")
    return F.translate(column, UPPER, LOWER).like(f"%{pattern}%")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def suffix(name: Column) -> Column:
    """The last dot and what follows it; empty for names without a dot or with only a leading one."""
    return F.regexp_extract(name, r"[^/](\.[^./]+)$", 1)


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=[^/])\.[^./]+$", "")


def is_image(name: Column) -> Column:
    return F.lower(suffix(name)).isin(*EXTENSIONS)


def has_dot_part(rel: Column) -> Column:
    return F.exists(F.split(rel, "/"), lambda p: p.startswith("."))


def thumbnail_key(path: Column) -> Column:
    return F.substring(F.md5(path.cast("binary")), 1, 12)


def vault_key(path: Column) -> Column:
    return F.substring(F.md5(path.cast("binary")), 1, 16)


def pasted_path(text: Column) -> Column:
    """A path as users paste it: blanks and quotes around it go."""
    return F.regexp_replace(F.trim(text), "^[\"']+|[\"']+$", "")


def curated_dir(pool: Column) -> Column:
    return F.concat(F.regexp_replace(pool, "/+$", ""), F.lit("_curated"))


def bits64(values: Column, is_set) -> Column:
    """64 flags over indices 0 to 63 as a signed long, the first the highest bit."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda acc, k: F.shiftleft(acc, 1).bitwiseOR(F.when(is_set(values, k), F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))))


def dhash_grid(grid: Column) -> Column:
    """Difference hash of a row-major grid of 8 rows of 9: a bit is set where the right neighbour is brighter."""
    at = lambda g, k, d: F.get(g, (F.floor(k / 8) * 9 + k % 8 + d).cast("int"))
    # a function of an array's one element: the grid is worked out once, not for each bit
    return F.transform(F.array(grid), lambda one: bits64(one, lambda g, k: at(g, k, 1) > at(g, k, 0)))[0]


def median_hash(values: Column) -> Column:
    """64 coefficients: a bit is set where one is above the median (mean of the middle two)."""
    ordered = F.transform(F.array(F.struct(values.alias("v"), F.array_sort(values).alias("o"))), lambda x: F.struct(x["v"].alias("v"), ((F.element_at(x["o"], 32) + F.element_at(x["o"], 33)) / 2).alias("m")))
    return F.transform(ordered, lambda one: bits64(one, lambda s, k: F.get(s["v"], k) > s["m"]))[0]
