"""Profiles: how often each attribute has a value, how many different ones, and the most frequent.

Values are counted under their canonical text. One pass unpivots the attributes into (attribute, text) and counts
with partial aggregation; the counts, not the rows, are ranked. Attributes of maps and of JSON values are found
while counting. Past ``max_distinct`` (if given) an attribute's values are estimated by Space-Saving counters, a table
per partition, merged by a shuffle.
"""

from __future__ import annotations

import heapq
import json
import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.canonical import JSON_KIND, canonical_text, is_empty
from ..session import ship
from ..sources.readers import NAMES

MOST_ATTRIBUTES = 4096
TOP = 10


@dataclass
class ValueCount:
    value: str
    count: int
    pct: float
    max_error: int = 0


@dataclass
class Attribute:
    name: str
    non_empty: int
    pct: float
    distinct: int
    distinct_exact: bool = True
    top_values: list[ValueCount] = field(default_factory=list)


@dataclass
class Profile:
    records: int
    columns: list[Attribute]
    columns_truncated: bool = False
    rows_skipped: int = 0
    predicate_misses: int = 0
    unseen_columns: list[str] = field(default_factory=list)


def percent(n: int, of: int) -> float:
    return n * 100 / of if of else 0.0


def _wanted(name: str, only: Sequence[str] | None) -> bool:
    return not only or any(name == w or name.startswith(w + ".") for w in only)


def _reaches(name: str, only: Sequence[str] | None) -> bool:
    """Whether something at or below ``name`` is wanted."""
    return _wanted(name, only) or any(w.startswith(name + ".") for w in only or ())


_ENTRY = "array<struct<attribute:string,text:string>>"


def _entry(name: Column, text: Column) -> Column:
    return F.struct(name.alias("attribute"), text.alias("text"))


def _leaves(c: Column, dt: T.DataType, metadata: dict, name: str, only: Sequence[str] | None) -> Iterator[Column]:
    """Arrays of (attribute, text) entries of a column; text is null where the value is empty."""
    if not _reaches(name, only):
        return
    if metadata.get(JSON_KIND):
        yield _json_leaves(c, name)
    elif isinstance(dt, T.StructType):
        for f in dt.fields:
            yield from _leaves(c.getField(f.name), f.dataType, f.metadata or {}, f"{name}.{f.name}", only)
    elif isinstance(dt, T.MapType):
        entries = F.transform(F.map_entries(c), lambda e: _entry(F.concat(F.lit(name + "."), e["key"].cast("string")), _text(e["value"], dt.valueType, {})))
        bare = F.array(_entry(F.lit(name), F.lit(None).cast("string")))
        yield F.when(F.size(c) > 0, entries).when(c.isNotNull(), bare)
    else:
        yield F.array(_entry(F.lit(name), _text(c, dt, metadata)))


def _text(c: Column, dt: T.DataType, metadata: dict) -> Column:
    if isinstance(dt, T.ArrayType):
        return F.when(~is_empty(c, dt), "[list]")
    return canonical_text(c, dt, metadata)


def _json_leaves(c: Column, name: str) -> Column:
    @F.pandas_udf(_ENTRY)
    def walk(values):
        from ..sources.jsonvalues import Pairs, float_text, loads

        def leaves(value, path):
            if isinstance(value, Pairs):
                if not value:
                    yield path, None
                for k, v in value:
                    yield from leaves(v, f"{path}.{k}")
            elif isinstance(value, list):
                yield path, "[list]" if value else None
            elif isinstance(value, bool):
                yield path, str(value).lower()
            elif isinstance(value, float):
                yield path, float_text(value, negative_zero=False)
            else:
                yield path, None if value is None or value == "" else str(value)

        def row(v):
            found: dict = {}
            for path, text in leaves(None if v is None else loads(v), name):
                found.setdefault(path, text)
            return [{"attribute": a, "text": t} for a, t in found.items()]

        return values.map(row)

    return walk(c)


def entries(df: DataFrame, only: Sequence[str] | None = None, records: bool = False) -> DataFrame | None:
    """A row (position, attribute, text) per record and attribute, ``records``: and one without an attribute; None if there is nothing to count."""
    ship(df.sparkSession)
    placed = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    arrays, seen = [], set()
    for i, f in enumerate(df.schema.fields):
        if f.name == NAMES or f.name in seen:  # the first of repeated names counts
            continue
        seen.add(f.name)
        for k, a in enumerate(_leaves(F.col(f"c{i}"), f.dataType, f.metadata or {}, f.name, only)):
            arrays.append(_placed(a, i * 10_000 + k))
    if not arrays:
        return None
    if records:
        nothing = F.lit(None).cast("string")
        arrays.append(F.array(F.struct(F.lit(-1).alias("position"), nothing.alias("attribute"), nothing.alias("text"))))
    out = placed.select(F.explode(F.concat(*(F.coalesce(a, F.array().cast("array<struct<position:int,attribute:string,text:string>>")) for a in arrays))).alias("e")).select("e.*")
    return out.where(_condition(only) | F.col("attribute").isNull()) if only else out


def _placed(entries: Column, at: int) -> Column:
    return F.transform(entries, lambda e: F.struct(F.lit(at).alias("position"), e["attribute"].alias("attribute"), e["text"].alias("text")))


def _condition(only: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in only:
        out = out | (F.col("attribute") == w) | F.startswith("attribute", F.lit(w + "."))
    return out


def value_counts(df: DataFrame, only: Sequence[str] | None = None, records: bool = False) -> DataFrame | None:
    """(attribute, text, n, position): exact counts; text is null for empty values. ``records``: a row without an attribute counts the records."""
    found = entries(df, only, records)
    return None if found is None else found.groupBy("attribute", "text").agg(F.count(F.lit(1)).alias("n"), F.min("position").alias("position"))


def attribute_counts(counts: DataFrame) -> DataFrame:
    """(attribute, position, records, non_empty, distinct_values)"""
    return counts.groupBy("attribute").agg(
        F.min("position").alias("position"), F.sum("n").alias("records"), F.coalesce(F.sum(F.when(F.col("text").isNotNull(), F.col("n"))), F.lit(0)).alias("non_empty"), F.count("text").alias("distinct_values")
    )


def top_values(counts: DataFrame, n: int = TOP, *more: str) -> DataFrame:
    """(attribute, value, n, rank, more columns): the most frequent first, ties by value. The limit per attribute goes ahead of the shuffle."""
    order = Window.partitionBy("attribute").orderBy(F.col("n").desc(), F.col("text"))
    ranked = counts.where("text IS NOT NULL").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    return ranked.select("attribute", F.col("text").alias("value"), "n", "rank", *more)


class SpaceSaving:
    """At most ``capacity`` counters; a newcomer takes over the least one with its count as error."""

    def __init__(self, capacity: int):
        self.capacity, self.counts, self.heap = capacity, {}, []

    def add(self, value: str, n: int = 1, error: int = 0) -> None:
        if value in self.counts:
            count, old = self.counts[value]
            self.counts[value] = (count + n, old + error)
            return
        if len(self.counts) >= self.capacity:
            while True:
                count, least = heapq.heappop(self.heap)
                now = self.counts[least][0]
                if now == count:
                    break
                heapq.heappush(self.heap, (now, least))
            del self.counts[least]
            n, error = n + count, error + count
        self.counts[value] = (n, error)
        heapq.heappush(self.heap, (n, value))

    def floor(self) -> int:
        """What a value without a counter may have been counted at most."""
        return min(n for n, _ in self.counts.values()) if len(self.counts) >= self.capacity else 0


def approximate_counts(df: DataFrame, max_distinct: int, only: Sequence[str] | None = None) -> DataFrame | None:
    """(attribute, text, n, max_error): counts where tables of ``max_distinct`` counters suffice per partition, else estimates.

    A true count is at most ``max_error`` away: by what the value's counters took over from others, and by what
    each table may have counted of it that no longer has it, its least counter at most.
    """
    found = entries(df, only)
    if found is None:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, SpaceSaving] = {}
        for batch in batches:
            for attribute, text in zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True):
                if text is not None:
                    tables.setdefault(attribute, SpaceSaving(max_distinct)).add(text)
        rows = []
        for attribute, table in tables.items():
            floor = table.floor()
            rows += [(attribute, text, n, error - floor) for text, (n, error) in table.counts.items()]
            rows.append((attribute, None, 0, floor))
        columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["attribute", "text", "n", "error"])

    partial = found.where("attribute IS NOT NULL").select("attribute", "text").mapInArrow(run, "attribute string, text string, n long, error long")
    merged = partial.groupBy("attribute", "text").agg(F.sum("n").alias("n"), F.sum("error").alias("error"))
    # The floors of all tables, less those of the tables that have the value. One row per attribute.
    floors = merged.where("text IS NULL").select("attribute", F.col("error").alias("floors"))
    return merged.where("text IS NOT NULL").join(floors, "attribute").select("attribute", "text", "n", (F.col("error") + F.col("floors")).alias("max_error"))


def profile(df: DataFrame, top: int = TOP, columns: Sequence[str] | None = None, max_distinct: int | None = None) -> Profile:
    """The profile of a DataFrame, from one pass over it. What reaches the driver is bounded by attributes times ``top``."""
    top = top if top > 0 else TOP
    counts = value_counts(df, columns, records=True)
    if counts is None:
        return Profile(df.count(), [])
    counts = counts.persist()
    try:
        rows = attribute_counts(counts).orderBy(F.col("attribute").isNotNull(), "position", "attribute").limit(MOST_ATTRIBUTES + 2).collect()
        records = sum(r["records"] for r in rows if r["attribute"] is None)
        rows = [r for r in rows if r["attribute"] is not None]
        exact: dict[str, list[ValueCount]] = {}
        for r in top_values(counts, top).orderBy("attribute", "rank").collect():
            exact.setdefault(r["attribute"], []).append(ValueCount(r["value"], r["n"], percent(r["n"], records)))
    finally:
        counts.unpersist()
    attributes = [Attribute(r["attribute"], r["non_empty"], percent(r["non_empty"], records), r["distinct_values"], True, exact.get(r["attribute"], [])) for r in rows[:MOST_ATTRIBUTES]]
    over = {a.name: a for a in attributes if max_distinct and a.distinct > max_distinct}
    if over:
        for a in over.values():
            a.distinct, a.distinct_exact, a.top_values = max_distinct, False, []
        estimates = approximate_counts(df, max_distinct, list(over))
        for r in top_values(estimates, top, "max_error").orderBy("attribute", "rank").collect():
            if a := over.get(r["attribute"]):
                a.top_values.append(ValueCount(r["value"], r["n"], percent(r["n"], records), r["max_error"]))
    return Profile(records, attributes, len(rows) > MOST_ATTRIBUTES)


# --- rendering -------------------------------------------------------------------------------------------

# The words of the report, which programs may read.
HEAD = ("ATTRIBUTE", "NON-EMPTY", "%", "DISTINCT")
FACTS = {"file": "file:", "records": "records:", "skipped": "skipped:", "misses": "where type misses:", "attributes": "attributes:"}
TOP_OF, ESTIMATED, CUT_SHORT = "top values of ", " (approximate: distinct limit reached)", "note: more attributes exist than are reported; the rest were left out"
_UNPRINTABLE = re.compile(r"[\x00-\x1f\x7f-\x9f]|\A\s+\Z")


def percent_text(p: float) -> str:
    return "<0.1%" if 0 < p < 0.1 else f"{p:.1f}%"


def shown(s: str, width: int) -> str:
    """A value as a table's cell: quoted if it would not be seen as it is, and no wider than ``width`` (0: any)."""
    cell = json.dumps(s, ensure_ascii=False) if _UNPRINTABLE.search(s) else s
    return cell if len(cell) <= width or width <= 0 else cell[:1] if width == 1 else cell[: width - 1] + "…"


def _table(*rows: Sequence[object]) -> str:
    """Cells two spaces apart; the last of a row ends its line."""
    cells = [[str(c) for c in r] for r in rows]
    wide = [max(map(len, column)) + 2 for column in zip(*(r[:-1] for r in cells), strict=True)]
    return "".join("".join(map(str.ljust, r, wide)) + r[-1] + "\n" for r in cells)


def render(p: Profile, path: str, width: int = 60) -> str:
    facts = {"file": shown(path, width), "records": p.records, "skipped": p.rows_skipped or None, "misses": p.predicate_misses or None, "attributes": len(p.columns)}
    names = {a.name: shown(a.name, width) for a in p.columns}
    parts = [
        _table(*((FACTS[k], v) for k, v in facts.items() if v is not None)),
        _table(HEAD, *((names[a.name], a.non_empty, percent_text(a.pct), str(a.distinct) + "+" * (not a.distinct_exact)) for a in p.columns)),
        *(
            f"{TOP_OF}{names[a.name]}{ESTIMATED * (not a.distinct_exact)}:\n"
            + _table(*(("  " + shown(v.value, width), "~" * (v.max_error > 0) + str(v.count), percent_text(v.pct)) for v in a.top_values))
            for a in p.columns if a.top_values
        ),
        *([CUT_SHORT + "\n"] if p.columns_truncated else []),
    ]
    return "\n".join(parts)


def as_json(p: Profile) -> str:
    def number(x: float):
        return int(x) if math.isfinite(x) and x == int(x) else x

    columns = []
    for a in p.columns:
        values = [{"value": v.value, "count": v.count, "pct": number(v.pct)} | ({"max_error": v.max_error} if v.max_error else {}) for v in a.top_values]
        columns.append({"name": a.name, "top_values": values, "non_empty": a.non_empty, "pct": number(a.pct), "distinct": a.distinct, "distinct_exact": a.distinct_exact})
    out = {"columns": columns, "records": p.records, "rows_skipped": p.rows_skipped, "columns_truncated": p.columns_truncated}
    if p.predicate_misses:
        out["predicate_misses"] = p.predicate_misses
    if p.unseen_columns:
        out["unseen_columns"] = p.unseen_columns
    return json.dumps(out, indent=2, ensure_ascii=False)
