"""What a word found in a row is worth: its occurrences, or BM25."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights are added in any order; sums are compared after rounding.
DECIMALS = 9


@dataclass(frozen=True)
class Weighing:
    """``weight`` gets, as columns, how often the word stands in the row, how
    many words the row has, in how many rows of the project the word stands,
    how many rows the project has and their mean number of words. Without
    ``statistics`` only the first two are known."""

    weight: Callable[[Column, Column, Column, Column, Column], Column]
    statistics: bool

    def settled(self, score: Column) -> Column:
        return F.round(score, DECIMALS) if self.statistics else score


occurrences = Weighing(lambda tf, length, df, docs, mean: tf.cast("long"), statistics=False)


def bm25(k1: float = 1.2, b: float = 0.75) -> Weighing:
    """Rare words count more, repeated ones less and less, long rows less."""

    def weight(tf: Column, length: Column, df: Column, docs: Column, mean: Column) -> Column:
        rarity = F.log(F.lit(1.0) + (docs - df + F.lit(0.5)) / (df + F.lit(0.5)))
        return rarity * tf * F.lit(k1 + 1) / (tf + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * length / mean))

    return Weighing(weight, statistics=True)
