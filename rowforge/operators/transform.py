"""Renames and drops of columns and nested entries, checked before any row is read."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.canonical import JSON_KIND


class InvalidTransform(ValueError):
    """A rule, or a set of rules, that makes no sense."""


@dataclass(frozen=True)
class Rename:
    source: str
    target: str


@dataclass(frozen=True)
class Drop:
    source: str


def _split(path: str, what: str) -> tuple[str, ...]:
    parts = tuple(path.split("."))
    if not path:
        raise InvalidTransform(f'invalid {what} "{path}": path is empty')
    if not all(parts):
        raise InvalidTransform(f'invalid {what} "{path}": path has an empty segment')
    return parts


def compiled(rules: Sequence[Rename | Drop]) -> dict:
    """A tree of rules: name -> (new name, None to drop or the name itself, subtree)."""
    tree: dict = {}
    for rule in rules:
        source = _split(rule.source, "transform source")
        new: str | None = None
        if isinstance(rule, Rename):
            target = _split(rule.target, "rename target")
            if len(target) != len(source):
                raise InvalidTransform(f'a rename cannot change the depth of a path: from "{rule.source}" to "{rule.target}"')
            if target[:-1] != source[:-1]:
                raise InvalidTransform(f'a rename cannot change the parent of a path: from "{rule.source}" to "{rule.target}"')
            new = target[-1]
        level = tree
        for i, part in enumerate(source):
            entry = level.setdefault(part, {"rule": False, "new": part, "below": {}})
            if i + 1 < len(source):
                if entry["rule"] and entry["new"] is None:
                    raise InvalidTransform(f'a dropped path has a rule below it: "{rule.source}"')
                level = entry["below"]
            else:
                if entry["rule"]:
                    raise InvalidTransform(f'more than one rule for "{rule.source}"')
                if new is None and entry["below"]:
                    raise InvalidTransform(f'a dropped path has a rule below it: "{rule.source}"')
                entry["rule"], entry["new"] = True, new
    return tree


def _nested(c: Column, dt: T.DataType, tree: dict, path: str) -> Column:
    if isinstance(dt, T.StructType):
        fields = []
        for f in dt.fields:
            entry = tree.get(f.name)
            if entry is None:
                fields.append(c.getField(f.name).alias(f.name))
            elif entry["new"] is not None:
                inner = c.getField(f.name)
                fields.append((_nested(inner, f.dataType, entry["below"], f"{path}.{f.name}") if entry["below"] else inner).alias(entry["new"]))
        if not fields:
            return F.when(c.isNotNull(), F.create_map().cast("map<string,string>"))
        return F.when(c.isNotNull(), F.struct(*fields))
    if isinstance(dt, T.MapType) and isinstance(dt.keyType, T.StringType):
        gone = [k for k, e in tree.items() if e["rule"] and e["new"] is None]
        if gone:
            c = F.map_filter(c, lambda k, v: ~k.isin(*gone))
        names = {k: e["new"] for k, e in tree.items() if e["rule"] and e["new"] not in (None, k)}
        for old, new in names.items():
            clash = F.map_contains_key(c, F.lit(old)) & F.map_contains_key(c, F.lit(new))
            message = F.lit(f'renaming "{path}.{old}": the entry "{new}" exists')
            c = F.when(clash, F.raise_error(message).cast(dt)).otherwise(_renamed(c, old, new))
        return c
    return c


def _renamed(c: Column, old: str, new: str) -> Column:
    return F.transform_keys(c, lambda k, v: F.when(k == old, F.lit(new)).otherwise(k))


def apply(df: DataFrame, rules: Sequence[Rename | Drop]) -> DataFrame:
    """``df`` with the rules applied in place; a path that is not there is left alone. Columns may end up with one name."""
    tree = compiled(rules)
    out = []
    for f in df.schema.fields:
        c = F.col("`" + f.name.replace("`", "``") + "`")
        entry = tree.get(f.name)
        if entry is None:
            out.append(c)
            continue
        if entry["new"] is None:
            continue
        if entry["below"]:
            if (f.metadata or {}).get(JSON_KIND):
                c = _json(c, entry["below"])
            else:
                c = _nested(c, f.dataType, entry["below"], f.name)
        out.append(c.alias(entry["new"], metadata=f.metadata or {}))
    return df.select(*out)


def _json(c: Column, tree: dict) -> Column:
    """The rules inside JSON values of any shape."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def rewrite(values):
        from ..sources.jsonvalues import Pairs, dumps, loads

        def walk(value, level):
            if not isinstance(value, Pairs):
                return value
            kept = []
            for name, inner in value:
                entry = level.get(name)
                if entry is None:
                    kept.append((name, inner))
                elif entry["new"] is not None:
                    kept.append((entry["new"], walk(inner, entry["below"]) if entry["below"] else inner))
            return Pairs(kept)

        return values.map(lambda v: None if v is None else dumps(walk(loads(v), tree)))

    return rewrite(c)
