"""Coordinate arithmetic and decision tables. Closed 1-based positions throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def from_zero_based(start0: Column, end0: Column) -> tuple[Column, Column]:
    """Half-open from 0 to closed from 1."""
    return start0 + 1, end0


def anchor(strand: Column, ref_start: Column, query_start: Column, query_end: Column, query_length: Column) -> Column:
    """Where the first base of the (oriented) query would lie on the reference."""
    return F.when(strand == "-", ref_start - query_length + query_end).otherwise(ref_start - query_start + 1)


def composed(a: Column, b: Column) -> Column:
    return F.when(a == b, "+").otherwise("-")


def mirrored(start: Column, end: Column, length: Column) -> tuple[Column, Column]:
    """The same stretch counted from the other end."""
    return length - end + 1, length - start + 1


def to_local(start: Column, end: Column, piece_start: Column, piece_end: Column, orientation: Column) -> tuple[Column, Column]:
    """Source positions inside a piece placed in the given orientation."""
    back = orientation == "-"
    return F.when(back, piece_end - end + 1).otherwise(start - piece_start + 1), F.when(back, piece_end - start + 1).otherwise(end - piece_start + 1)


def to_source(start: Column, end: Column, piece_start: Column, piece_end: Column, orientation: Column) -> tuple[Column, Column]:
    back = orientation == "-"
    return F.when(back, piece_end - end + 1).otherwise(piece_start + start - 1), F.when(back, piece_end - start + 1).otherwise(piece_start + end - 1)


def scaled_span(start: Column, end: Column, q_start: Column, q_end: Column, r_start: Column, r_end: Column) -> tuple[Column, Column]:
    """Linear projection of part of an alignment's query to its reference: outward rounding, clamped."""
    span, ref = q_end - q_start + 1, r_end - r_start + 1
    low = r_start + F.floor((F.greatest(start, q_start) - q_start) * ref / span)
    high = r_start + F.ceil((F.least(end, q_end) - q_start + 1) * ref / span) - 1
    return F.greatest(low, r_start), F.least(high, r_end)


def half_even(x: Column) -> Column:
    """Rounds halves to even, unlike SQL's round."""
    return F.bround(x).cast("long")


def half_up(x: Column) -> Column:
    """Rounds halves towards plus infinity."""
    return F.floor(x + 0.5)


def identity_percent(divergence: Column, matches: Column, block: Column) -> Column:
    """From a divergence tag if there is one, else matches over block length; 0 to 100."""
    value = F.coalesce((1 - divergence) * 100, matches * 100 / F.greatest(block, F.lit(1)))
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(100.0))


def qualified(block: Column, length: Column, least_block: int = 1000, least_percent: int = 25) -> Column:
    return (block >= least_block) | (block * 100 >= least_percent * F.greatest(length, F.lit(1)))


def placement(prev_end: Column, start: Column) -> tuple[Column, Column]:
    """Relation of neighbours and its size."""
    d = start - prev_end - 1
    return F.when(prev_end.isNull() | start.isNull(), "unknown").when(d < 0, "overlap").when(d > 0, "gap").otherwise("adjacent"), F.abs(d)


def confidence(score: Column) -> Column:
    return F.when(score >= 0.7, "high").when(score >= 0.4, "medium").otherwise("low")


def reference_status(here: Column, elsewhere: Column, weak: Column) -> Column:
    """From counts of good hits here, good hits on other chromosomes, and weak hits here."""
    return F.when(here > 1, "multi_hit").when(here == 1, "hit").when(weak > 0, "weak_hit").when(elsewhere > 0, "other_chr_only").otherwise("no_hit")
