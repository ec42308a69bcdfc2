"""Numbers: rounding, scores, distances and prices."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(x: Column, digits: int = 0) -> Column:
    """Half towards plus infinity."""
    return F.floor(x * 10**digits + 0.5) / 10**digits


def clamp(x: Column, low: float = 0, high: float = 100) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def set_cosine(a: Column, b: Column) -> Column:
    """Common members over the geometric mean of the sizes; 0 if a set is empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.sqrt((F.size(a) * F.size(b)).cast("double"))), F.lit(0.0))


def grade(share: Column, names: tuple[str, ...] = ("platinum", "gold", "silver", "bronze", "to improve")) -> Column:
    """Grades at nine, eight, seven and six tenths."""
    return F.when(share >= 0.9, names[0]).when(share >= 0.8, names[1]).when(share >= 0.7, names[2]).when(share >= 0.6, names[3]).otherwise(names[4])


def haversine_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Metres between two places; null where a coordinate is null or 0."""
    known = (lat1 != 0) & (lng1 != 0) & (lat2 != 0) & (lng2 != 0)
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), F.lit(2))
    return F.when(known, round_half_up(2 * 6371000 * F.asin(F.least(F.lit(1.0), F.sqrt(a)))))


def cost(prompt: Column, completion: Column, images: Column, per_prompt: float, per_completion: float, per_image: float) -> Column:
    """Token prices are for a million."""
    return prompt / 1e6 * per_prompt + completion / 1e6 * per_completion + images * per_image


def unit_price(price: Column, count: Column, amount: Column | None = None) -> Column:
    """Price of one piece (or of one unit of its contents); null if that makes no sense."""
    per = count if amount is None else count * amount
    return F.when((price > 0) & (per > 0), F.try_divide(price.cast("double"), per.cast("double")))


#: Pieces in a title, first with a number of packs, then plain.
PACKS = r"(?i)(\d+)\s*(?:정|캡슐|구미|포|일분|개월|박스)?\s*x?\s*(\d+)?\s*(?:정|캡슐)"
PIECES = r"(?i)(\d+)\s*(?:정|캡슐|구미|포)"


def pack_count(title: Column) -> Column:
    """Pieces by a title, times the packs if it has both; else null."""
    found = lambda pattern, group: F.regexp_extract(title, pattern, group).try_cast("int")
    packs = F.when(title.rlike(PACKS), found(PACKS, 1) * F.coalesce(found(PACKS, 2), F.lit(1)))
    return F.coalesce(packs, found(PIECES, 1))


def polar(i: Column, of: Column, share: Column, centre: float = 0.0, radius: float = 1.0) -> tuple[Column, Column]:
    """The i-th (from 0) of ``of`` points around a centre, starting at the top."""
    angle = F.lit(2 * math.pi) * i / of - F.lit(math.pi / 2)
    return centre + radius * share * F.cos(angle), centre + radius * share * F.sin(angle)


def scaled(v: Column, low: float, high: float, most: Column) -> Column:
    """A value from 0 to ``most`` on a line from ``high`` (0) to ``low``."""
    return F.lit(high) - (high - low) * F.try_divide(v.cast("double"), most.cast("double"))


def weighted_mean(parts: list[tuple[Column, float]]) -> Column:
    """The mean of those values that are there, by their weights; null if none is."""
    total = sum((F.coalesce(v * w, F.lit(0.0)) for v, w in parts), F.lit(0.0))
    return F.try_divide(total, sum((F.when(v.isNotNull(), F.lit(w)).otherwise(0.0) for v, w in parts), F.lit(0.0)))
