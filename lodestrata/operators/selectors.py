"""Selection of entries. Conditions on size and time hold regular files only; directories and links pass them."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars


@dataclass(frozen=True)
class Selection:
    """exclude: parts of a path, case-sensitive, any of which drops an entry; sizes and times are inclusive. A time of
    parse_date() is a midnight, so of the last day only that moment is kept."""

    exclude: list[str] = field(default_factory=list)
    min_size: int | None = None
    max_size: int | None = None
    date_from: int | None = None
    date_to: int | None = None

    def condition(self) -> Column:
        rules: list[Column] = [~F.contains(F.col("rel"), F.lit(p)) for p in self.exclude]
        loose = ~F.col("is_regular")
        mtime = F.greatest(F.col("mtime"), F.lit(0))  # a time before 1970 counts as 0
        if self.min_size is not None:
            rules.append(loose | (F.col("size") >= self.min_size))
        if self.max_size is not None:
            rules.append(loose | (F.col("size") <= self.max_size))
        if self.date_from is not None:
            rules.append(loose | (mtime >= self.date_from))
        if self.date_to is not None:
            rules.append(loose | (mtime <= self.date_to))
        return reduce(Column.__and__, rules, F.lit(True))


def select(entries: DataFrame, selection: Selection) -> DataFrame:
    return entries.where(selection.condition())


def skipped(entries: DataFrame, selection: Selection) -> DataFrame:
    """One row: entries before, skipped and after."""
    keep = selection.condition()
    return entries.agg(F.count("*").alias("before"), F.count_if(~keep).alias("skipped"), F.count_if(keep).alias("kept"))


def find(entries: DataFrame, terms: list[str]) -> DataFrame:
    """Entries with any of the terms in their path, in any case; all without terms."""
    rules = [F.contains(F.lower(F.col("rel")), F.lit(t.lower())) for t in terms]
    return entries.where(reduce(Column.__or__, rules)) if rules else entries


def file_like(entries: DataFrame) -> DataFrame:
    return entries.where(scalars.file_like(F.col("kind")))


def hashable(entries: DataFrame) -> DataFrame:
    """Regular files that are not empty: what deduplication looks at."""
    return entries.where("is_regular AND size > 0")


def media(entries: DataFrame) -> DataFrame:
    return entries.where(scalars.routed(F.col("ext")))


def texts(entries: DataFrame, body: str = "body") -> DataFrame:
    return entries.where(scalars.looks_like_text(F.col(body)))
