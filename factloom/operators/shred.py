"""Nested records to related flat tables, by shared inlining.

The schema graph of all roots is analysed first. A struct that occurs once below its parent is inlined into the parent's
row (column names joined by dots). A repeated element gets a table of its own, and so does a struct type that occurs in
several places of the graph (same fields, same types): its rows from all places share one table. (A Spark schema is
finite, so a recursive type cannot occur.) Every row carries its keys: ``root`` and ``owner_id`` (the root row),
``parent`` (the parent's table), ``pos`` (the places in all arrays on the way, counted from 0; the last is its own, the
others are its parent's). Null elements yield no row but keep their place. Null or empty arrays yield no rows. A clash of
an inlined name with a key column is resolved by a trailing underscore.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEYS = ("root", "owner_id", "parent", "field", "pos")


def _sign(t: T.DataType) -> str:
    return t.simpleString().lower()


def shared_types(roots: dict[str, T.StructType]) -> dict[str, str]:
    """Signature -> table name of each struct type with more than one place in the graph."""
    places: Counter[str] = Counter()
    names: dict[str, str] = {}

    def visit(t: T.DataType, name: str, single: bool) -> None:
        if isinstance(t, T.StructType):
            if single:
                places[_sign(t)] += 1
                names.setdefault(_sign(t), name)
            for f in t.fields:
                visit(f.dataType, f.name, True)
        elif isinstance(t, T.ArrayType):
            visit(t.elementType, "", False)

    for t in roots.values():
        for f in t.fields:
            visit(f.dataType, f.name, True)
    return {s: f"shared.{names[s]}" for s, n in places.items() if n > 1}


def shred(roots: dict[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """Tables by name of ``roots``: name -> (frame, key column). Repeated elements are named by their path."""
    shared = shared_types({n: df.drop(key).schema for n, (df, key) in roots.items()})
    out: dict[str, list[DataFrame]] = {}

    def emit(table: str, df: DataFrame, root: str, parent: str, field: str, value, t: T.DataType) -> None:
        """``df`` has owner_id, pos and one non-null element of type ``t``, reached by ``value``."""
        flat, below = [], []

        def inline(struct: T.StructType, at, prefix: str) -> None:
            for f in struct.fields:
                c, name = at[f.name], prefix + f.name
                if isinstance(f.dataType, T.ArrayType) or (isinstance(f.dataType, T.StructType) and _sign(f.dataType) in shared):
                    below.append((name, c, f.dataType))
                elif isinstance(f.dataType, T.StructType):
                    inline(f.dataType, c, name + ".")
                else:
                    flat.append((name, c, f.dataType))

        if isinstance(t, T.StructType):
            inline(t, value, "")
        else:
            flat.append(("value", value, t))
        cols = [c.alias(n + "_" if n in KEYS else n) for n, c, _ in flat]
        out.setdefault(table, []).append(df.select(F.lit(root).alias("root"), "owner_id", F.lit(parent).alias("parent"), F.lit(field).alias("field"), "pos", *cols))
        for name, c, kind in below:
            if isinstance(kind, T.StructType):
                emit(shared[_sign(kind)], df.where(c.isNotNull()).select("owner_id", "pos", c.alias("el")), root, table, name, F.col("el"), kind)
                continue
            child = df.select("owner_id", "pos", F.posexplode(c).alias("at", "el")).where(F.col("el").isNotNull())
            emit(f"{table}.{name}", child.select("owner_id", F.concat("pos", F.array("at")).alias("pos"), "el"), root, table, name, F.col("el"), kind.elementType)

    for name, (df, key) in roots.items():
        rest = [c for c in df.columns if c != key]
        kind = T.StructType([df.schema[c] for c in rest])
        base = df.select(F.col(key).alias("owner_id"), F.array().cast("array<int>").alias("pos"), F.struct(*[F.col(f"`{c}`") for c in rest]).alias("el"))
        emit(name, base, name, "", "", F.col("el"), kind)
    return {n: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs) for n, dfs in out.items()}
