"""Match ladders: how well a name or a path fits a keyword."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import one_edit
from .vocab import CUTOFF, MIN_STEM


def truncated(base: Column, weight: Column) -> Column:
    """base * weight without its fraction, toward zero."""
    return (base * weight).cast("int")


def symbol_base(name_low: Column, name_stem: Column, kw: Column, kw_stem: Column) -> Column:
    """Exact 100, prefix either way 50, contained 10, same stem 50, one edit apart 5; the first that holds."""
    return (
        F.when(name_low == kw, 100)
        .when(F.startswith(name_low, kw) | F.startswith(kw, name_low), 50)
        .when(F.contains(name_low, kw), 10)
        .when((name_stem == kw_stem) & (F.octet_length(kw_stem) >= MIN_STEM), 50)
        .when(one_edit(name_low, kw), 5)
        .otherwise(0)
    )


def kind_bonus(kind: Column) -> Column:
    return F.when(kind.isin("function", "method"), 20).when(kind.isin("class", "struct", "trait", "interface"), 5).otherwise(0)


def file_rung(path_low: Column, stem: Column, part_stems: Column, kw: Column, kw_stem: Column) -> Column:
    """1 the stem itself, 2 contained in it, 3 a part of the same word stem, 4 in the path, 5 one edit apart, or 0."""
    long = F.octet_length(kw_stem) >= MIN_STEM
    return (
        F.when(stem == kw, 1)
        .when(F.contains(stem, kw), 2)
        .when(long & F.array_contains(part_stems, kw_stem), 3)
        .when(F.contains(path_low, kw), 4)
        .when(one_edit(stem, kw) | F.exists(part_stems, lambda p: one_edit(p, kw)), 5)
        .otherwise(0)
    )


def file_base(rung: Column) -> Column:
    return F.when(rung == 1, 100).when(rung.isin(2, 3), 40).when(rung.isin(4, 5), 5).otherwise(0)


def cutoff(top: Column, least: int) -> Column:
    """The score that a result needs, given the best."""
    return F.greatest(F.lit(least), (F.coalesce(top, F.lit(0)) * CUTOFF).cast("int"))


def halved(score: Column) -> Column:
    """Half a score, toward zero."""
    return (score / 2).cast("int")


def idf(files: Column, file_hits: Column, symbols: Column, symbol_hits: Column, synonym: Column) -> Column:
    """The lesser of both rarities, between 1 and 10; half of that for a synonym."""
    one = lambda n, hits: F.when(hits > 0, F.ln(n / hits)).otherwise(10.0)
    rarity = F.greatest(F.lit(1.0), F.least(F.lit(10.0), one(files, file_hits), one(symbols, symbol_hits)))
    return F.when(synonym, rarity * 0.5).otherwise(rarity)
