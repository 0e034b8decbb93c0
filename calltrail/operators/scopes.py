"""Sets of names with a hierarchy: which of them cover the others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ancestors(name: Column, sep: str) -> Column:
    """The proper ancestors of a name, by whole segments: a and a.b of a.b.c."""
    parts = F.split(name, rf"\Q{sep}\E")
    n = F.size(parts)
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), sep))).otherwise(F.array().cast("array<string>"))


def collapsed(names: DataFrame, name: str = "name", sep: str = ".") -> DataFrame:
    """The distinct names that no other name of the set covers, so that each name is covered by exactly one of them.

    Each name looks up its own ancestors: one equi-join with the set. Null and empty names are left out.
    """
    every = names.where(F.col(name) != "").select(name).distinct()
    above = every.select(name, F.explode(ancestors(F.col(name), sep)).alias("_above"))
    covered = above.join(every.select(F.col(name).alias("_above")), "_above", "left_semi").select(name).distinct()
    return every.join(covered, name, "left_anti")


def covering(names: DataFrame, name: str = "name", sep: str = ".") -> DataFrame:
    """(name, covers): for each distinct name the collapsed name that covers it, itself if no other does."""
    every = names.where(F.col(name) != "").select(name).distinct()
    chain = every.select(name, F.explode(F.array_append(ancestors(F.col(name), sep), F.col(name))).alias("_above"))
    hits = chain.join(every.select(F.col(name).alias("_above")), "_above", "left_semi")
    return hits.groupBy(name).agg(F.min_by("_above", F.length("_above")).alias("covers"))
