"""Numeric functions as Column expressions: alignment costs, vector and book measures."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prior of each step (source segments, target segments) of length alignment.
STEP_PRIORS = {(1, 1): 0.89, (1, 0): 0.0099, (0, 1): 0.0099, (2, 1): 0.089, (1, 2): 0.089, (2, 2): 0.011}
LENGTH_VARIANCE = 6.8
LEAST_PROBABILITY = 1e-12
#: Coefficients of the Chebyshev fit of erfc (relative error below 1.2e-7).
_ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)

#: Inches of spine for a page, by paper; characters on a page; least pages; bleed.
PAPER_THICKNESS = {"white": 0.002252, "cream": 0.0025, "color": 0.002347}
CHARS_PER_PAGE, LEAST_PAGES = 1400, 24
BLEED, LEAST_SPINE = 0.125, 0.06


def two_sided_tail(z: Column) -> Column:
    """2 (1 - Phi(|z|)) = erfc(|z| / sqrt 2), in closed form."""
    x = F.abs(z) / math.sqrt(2)
    t = 1.0 / (1.0 + 0.5 * x)
    poly = F.lit(_ERFC[-1])
    for c in reversed(_ERFC[:-1]):
        poly = F.lit(c) + t * poly
    return t * F.exp(-x * x + poly)


def normal_cdf(z: Column) -> Column:
    tail = two_sided_tail(z) / 2
    return F.when(z >= 0, 1 - tail).otherwise(tail)


def length_cost(src: Column, tgt: Column, ratio: Column) -> Column:
    """-ln of the chance that texts of these lengths are translations, at `ratio` target characters each."""
    z = (tgt - src * ratio) / F.sqrt(F.greatest(src * LENGTH_VARIANCE, F.lit(1.0)))
    return F.when((src == 0) & (tgt == 0), 0.0).otherwise(-F.ln(F.greatest(two_sided_tail(z), F.lit(LEAST_PROBABILITY))))


def prior_cost(ds: Column, dt: Column) -> Column:
    out = F.lit(None).cast("double")
    for (a, b), p in STEP_PRIORS.items():
        out = F.when((ds == a) & (dt == b), -math.log(p)).otherwise(out)
    return out


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def unit(a: Column) -> Column:
    size = norm(a)
    return F.when(size > 0, F.transform(a, lambda x: x.cast("double") / size)).otherwise(F.transform(a, lambda x: x.cast("double")))


def estimate_pages(chars: Column) -> Column:
    """Half-even rounding of characters over page density, at least the minimum."""
    return F.greatest(F.lit(LEAST_PAGES), F.bround(chars / CHARS_PER_PAGE).cast("int"))


def gutter(pages: Column) -> Column:
    """Inside margin in inches."""
    return F.when(pages <= 150, 0.375).when(pages <= 300, 0.5).when(pages <= 500, 0.625).when(pages <= 700, 0.75).otherwise(0.875)


def cover_dimensions(trim_w: Column, trim_h: Column, pages: Column, paper: Column) -> Column:
    """(width, height, spine) of a wraparound cover in inches."""
    known = F.create_map(*[F.lit(x) for pair in PAPER_THICKNESS.items() for x in pair])
    spine = F.greatest(F.lit(LEAST_SPINE), pages * F.coalesce(F.try_element_at(known, paper), F.lit(PAPER_THICKNESS["white"])))
    return F.struct((2 * BLEED + 2 * trim_w + spine).alias("width"), (2 * BLEED + trim_h).alias("height"), spine.alias("spine"))


def body_start_page(has_toc: Column, has_copyright: Column) -> Column:
    """First page of the body without a table of contents; null with one (it is found while laying out)."""
    return F.when(~has_toc, 2 + has_copyright.cast("int"))


def is_recto(page: Column) -> Column:
    return page % 2 == 1
