"""Filters, transforms and rules in their fixed order, with the counts of what they did."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, functions as F

from ..plans.predicate import Predicate
from . import transform

#: A filter: a condition, a predicate, or a function of the DataFrame that gives a condition or the rows to keep.
RowFilter = Column | Predicate | Callable[[DataFrame], Column | DataFrame]
RecordTransform = Callable[[DataFrame], DataFrame]


@dataclass
class Stages:
    filters: Sequence[RowFilter] = ()
    transforms: Sequence[RecordTransform] = ()
    rules: Sequence[transform.Rename | transform.Drop] = ()

    def __post_init__(self):
        transform.compiled(self.rules)  # bad rules fail before any row is read

    @property
    def any(self) -> bool:
        return bool(self.filters or self.transforms or self.rules)


@dataclass
class Counts:
    """What a single complete action on the staged DataFrame will have counted."""

    read: Observation | None = None
    kept: Observation | None = None
    misses: list[Observation] = field(default_factory=list)
    unseen: list[str] = field(default_factory=list)

    def get(self) -> dict[str, int]:
        read = self.read.get["rows"] if self.read else 0
        kept = self.kept.get["rows"] if self.kept else read
        return {"rows_read": read, "rows_filtered": read - kept, "predicate_misses": sum(o.get["misses"] or 0 for o in self.misses)}


def observed(df: DataFrame, **values: Column) -> tuple[DataFrame, Observation]:
    o = Observation()
    return df.observe(o, *(c.alias(k) for k, c in values.items())), o


def staged(df: DataFrame, stages: Stages, counts: bool = False) -> tuple[DataFrame, Counts]:
    """``df`` through filters, transforms and rules.

    With ``counts``, rows and misses are observed on the way (in the same pass); an observation below a filter keeps
    the filter from the scan, so without ``counts`` a predicate filters by its pushdown form.
    """
    out = Counts()
    if counts:
        df, out.read = observed(df, rows=F.count(F.lit(1)))
    for f in stages.filters:
        if isinstance(f, Predicate):
            bound = f.bind(df.schema)
            out.unseen += [c for c in bound.unseen if c not in out.unseen]
            if counts and bound.misses is not None and not f.strict:
                df, o = observed(df, misses=F.coalesce(F.sum(bound.misses), F.lit(0)))
                out.misses.append(o)
            keep = bound.match if counts else bound.keep
            if counts and bound.unseen:
                # A condition that folds to false would take the scan, and with it the counts, out of the plan.
                keep = F.when(F.spark_partition_id() >= 0, keep).otherwise(True)
            df = df.filter(keep)
        elif isinstance(f, Column):
            df = df.filter(F.coalesce(f, F.lit(False)))
        else:
            kept = f(df)
            df = df.filter(F.coalesce(kept, F.lit(False))) if isinstance(kept, Column) else kept
    if counts and stages.filters:
        df, out.kept = observed(df, rows=F.count(F.lit(1)))
    for t in stages.transforms:
        df = df.transform(t)
    if stages.rules:
        df = transform.apply(df, stages.rules)
    return df, out
