"""Schemas that drift between files: fingerprints, migration steps, one consistent table.

Input records are (record_kind, record_id, exporter, file_seq, text); a file is one (exporter, file_seq) of a kind. A
field is a leaf of the JSON text: keys joined by dots, ``[]`` after an array of objects; other arrays are leaves of type
array, null values are none. JSON inside a JSON string is unwrapped; text that is not complete JSON, or not an object,
holds no field. The fields of a file with their types are its schema version; its fingerprint is their hash. Consecutive
versions give migration steps: renamed, removed, added, retyped. Records without exporter or file_seq belong to no file
and take no part in the steps; in the table they keep their names.
"""

from __future__ import annotations

import json

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

WRAPS = 4
_TYPES = {bool: "boolean", str: "string", int: "integer", float: "decimal"}


def _unique(pairs: list[tuple]) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ValueError("repeated key")
    return out


def _constant(name: str):
    raise ValueError(name)


_parse = json.JSONDecoder(object_pairs_hook=_unique, parse_constant=_constant).decode


def load(text: str | None):
    """The object of a JSON text, unwrapped; None if there is none. NaN, Infinity and repeated keys are no JSON here."""
    try:
        v = _parse(text) if text else None
        for _ in range(WRAPS):
            if not isinstance(v, str):
                break
            v = _parse(v)
    except (ValueError, RecursionError):
        return None
    return v if isinstance(v, dict) else None


def leaves(obj: dict, object_arrays: tuple[str, ...] = ()):
    """(path, type, value) of every leaf; the walk keeps its own stack, so depth is no limit.

    Arrays with a key of ``object_arrays`` hold objects even when they are empty or hold only nulls.
    """
    stack = [("", obj)]
    while stack:
        prefix, o = stack.pop()
        for k, v in o.items():
            path = prefix + k
            if v is None:
                continue
            if isinstance(v, dict):
                stack.append((path + ".", v))
            elif isinstance(v, list):
                inner = [x for x in v if isinstance(x, dict)]
                if inner or k in object_arrays:
                    stack.extend((path + "[].", x) for x in reversed(inner))
                else:
                    yield path, "array", v
            else:
                yield path, _TYPES[type(v)], v


def _fields(object_arrays: tuple[str, ...]):
    def run(batches):
        for b in batches:
            seen: dict[tuple, None] = {}
            for kind, exporter, seq, text in zip(*(c.to_pylist() for c in b.columns)):
                seen[(kind, exporter, seq, None, None)] = None  # the file exists even if it holds nothing
                obj = load(text)
                if obj:
                    for path, kind_of, _ in leaves(obj, object_arrays):
                        seen[(kind, exporter, seq, path, kind_of)] = None
            cols = list(zip(*seen)) or [()] * 5
            types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["record_kind", "exporter", "file_seq", "path", "type"])

    return run


def versions(records: DataFrame, object_arrays: tuple[str, ...] = ()) -> DataFrame:
    """(record_kind, exporter, file_seq, path, type) of each field a file holds, one row with null path per file besides.

    Batches are reduced before the shuffle, so what moves is files x fields and not records. A field written in several
    types within a file has them joined by ``|``.
    """
    r = records.where("exporter IS NOT NULL AND file_seq IS NOT NULL").select("record_kind", "exporter", F.col("file_seq").cast("bigint"), "text")
    f = r.mapInArrow(_fields(object_arrays), "record_kind string, exporter string, file_seq bigint, path string, type string")
    return f.groupBy("record_kind", "exporter", "file_seq", "path").agg(F.array_join(F.array_sort(F.collect_set("type")), "|").alias("type"))


def fingerprints(fields: DataFrame) -> DataFrame:
    """(record_kind, exporter, file_seq, fields, fingerprint) of each file; a list is as long as the fields of one file."""
    one = F.array_sort(F.collect_list(F.when(F.col("path").isNotNull(), F.concat_ws(":", "path", "type"))))
    return fields.groupBy("record_kind", "exporter", "file_seq").agg(one.alias("l")).select("record_kind", "exporter", "file_seq", F.size("l").alias("fields"), F.sha2(F.array_join("l", "\n"), 256).alias("fingerprint"))


def changes(fields: DataFrame) -> DataFrame:
    """Steps between consecutive files: (record_kind, exporter, file_seq, field_path, change_kind, new_path, old_type, new_type).

    Fingerprints tell which files differ from the one before; only the fields of these are compared.
    """
    file = ["record_kind", "exporter", "file_seq"]
    w = W.partitionBy("record_kind", "exporter").orderBy("file_seq")
    order = fingerprints(fields).select(*file, F.lead("file_seq").over(w).alias("next_seq"), (F.lead("fingerprint").over(w) != F.col("fingerprint")).alias("differs"))
    held = fields.where("path IS NOT NULL")
    # Each version meets its successor under the successor's number; an exporter's first file has none before it.
    nxt = order.where("differs").drop("differs")
    before = held.join(nxt, file).select("record_kind", "exporter", F.col("next_seq").alias("file_seq"), "path", F.col("type").alias("old_type"), F.lit(None).cast("string").alias("new_type"))
    later = nxt.select("record_kind", "exporter", F.col("next_seq").alias("file_seq"))
    after = held.join(later, file).select(*file, "path", F.lit(None).cast("string").alias("old_type"), F.col("type").alias("new_type"))
    met = before.unionAll(after).groupBy(*file, "path").agg(F.max("old_type").alias("old_type"), F.max("new_type").alias("new_type"))
    met = met.where(~F.col("old_type").eqNullSafe(F.col("new_type")))
    retyped = met.where("old_type IS NOT NULL AND new_type IS NOT NULL").select(*file, F.col("path").alias("field_path"), F.lit("retyped").alias("change_kind"), F.lit(None).cast("string").alias("new_path"), "old_type", "new_type")
    moved = met.where("old_type IS NULL OR new_type IS NULL").withColumn("parent", F.regexp_extract("path", r"^(.*)\.[^.]*$", 1)).withColumn("type", F.coalesce("old_type", "new_type"))
    # The lists are as long as the fields of one parent that change at one step, whatever the number of records.
    g = moved.groupBy(*file, "parent", "type").agg(F.collect_list(F.when(F.col("new_type").isNull(), F.col("path"))).alias("gone"), F.collect_list(F.when(F.col("old_type").isNull(), F.col("path"))).alias("came"))
    none = F.lit(None).cast("string")
    single = (F.size("gone") == 1) & (F.size("came") == 1)
    rename = F.array(F.struct(F.col("gone")[0].alias("field_path"), F.lit("renamed").alias("change_kind"), F.col("came")[0].alias("new_path"), F.col("type").alias("old_type"), F.col("type").alias("new_type")))
    other = F.concat(
        F.transform("gone", lambda p: F.struct(p.alias("field_path"), F.lit("removed").alias("change_kind"), none.alias("new_path"), F.col("type").alias("old_type"), none.alias("new_type"))),
        F.transform("came", lambda p: F.struct(p.alias("field_path"), F.lit("added").alias("change_kind"), none.alias("new_path"), none.alias("old_type"), F.col("type").alias("new_type"))),
    )
    return retyped.unionByName(g.select(*file, F.inline(F.when(single, rename).otherwise(other))))


def _chain(pdf: pd.DataFrame) -> pd.DataFrame:
    """Spans of file numbers in which a path stands for an earlier name, from the rename steps of one exporter."""
    live: dict[str, tuple[str, int]] = {}
    out = []
    for seq, step in pdf.sort_values(["file_seq", "field_path"]).groupby("file_seq"):
        made = {}
        for r in step.itertuples():
            first, since = live.pop(r.field_path, (r.field_path, None))
            if since is not None:
                out.append((r.field_path, first, since, seq))
            made[r.new_path] = (first, seq)
        live.update(made)
    out += [(path, first, since, None) for path, (first, since) in live.items()]
    k = pdf.iloc[0]
    return pd.DataFrame([(k.record_kind, k.exporter, *o) for o in out], columns=["record_kind", "exporter", "path", "first_name", "since", "until"]).astype({"since": "Int64", "until": "Int64"})


def aliases(steps: DataFrame) -> DataFrame:
    """(record_kind, exporter, path, first_name, since, until): chained renames; only the rename steps of an exporter are gathered, no records."""
    r = steps.where("change_kind = 'renamed'").select("record_kind", "exporter", "file_seq", "field_path", "new_path")
    return r.groupBy("record_kind", "exporter").applyInPandas(_chain, "record_kind string, exporter string, path string, first_name string, since bigint, until bigint")


def _rows(object_arrays: tuple[str, ...], schema: pa.Schema):
    """Per record its values by consistent name, the texts of one name in their order."""

    def run(batches):
        for b in batches:
            rows = []
            for rid, exporter, seq, text, names in zip(*(c.to_pylist() for c in b.columns)):
                names = dict(names or ())
                values: dict[str, list[str]] = {}
                for path, _, v in leaves(load(text) or {}, object_arrays):
                    values.setdefault(names.get(path, path), []).append(v if isinstance(v, str) else json.dumps(v, ensure_ascii=False))
                rows.append({"record_id": rid, "exporter": exporter, "file_seq": seq, "m": sorted(values.items())})
            yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def names(fields: DataFrame, steps: DataFrame) -> DataFrame:
    """(record_kind, exporter, file_seq, names): of each file with renamed fields the map from the names in it to the first ones."""
    files = fields.where("path IS NULL").select("record_kind", "exporter", "file_seq")
    live = files.join(aliases(steps), ["record_kind", "exporter"]).where((F.col("file_seq") >= F.col("since")) & (F.col("until").isNull() | (F.col("file_seq") < F.col("until"))))
    return live.groupBy("record_kind", "exporter", "file_seq").agg(F.map_from_entries(F.collect_list(F.struct("path", "first_name"))).alias("names"))


def schema_of(fields: DataFrame, named: DataFrame, kind: str, most: int = 2000) -> list[tuple[str, str]]:
    """(consistent name, type) of all fields that files of a kind hold; the driver reads the schema, not its files.

    A field of one type has it; integers and decimals make a decimal; what else is mixed, and arrays, are text. Below an
    array of objects a field has a list. The fields of most files come first; those after ``most`` are left to ``extra``.
    """
    f = fields.where((F.col("record_kind") == kind) & F.col("path").isNotNull()).join(named.where(F.col("record_kind") == kind).drop("record_kind"), ["exporter", "file_seq"], "left")
    f = f.select(F.coalesce(F.try_element_at("names", F.col("path")), "path").alias("path"), F.explode(F.split("type", r"\|")).alias("type"))
    rows = f.groupBy("path").agg(F.array_sort(F.collect_set("type")).alias("types"), F.count("*").alias("n")).orderBy(F.col("n").desc(), "path").limit(most).collect()
    sql = {"boolean": "boolean", "integer": "bigint", "decimal": "double"}
    out = []
    for r in rows:
        t = sql.get(r.types[0], "string") if len(r.types) == 1 else "double" if r.types == ["decimal", "integer"] else "string"
        out.append((r.path, f"array<{t}>" if "[]" in r.path else t))
    return sorted(out)


def column_names(paths: list[str], taken: tuple[str, ...]) -> dict[str, str]:
    """Path -> column name: dots are two underscores; names that clash, in any letter case, get underscores at the end."""
    used, out = {t.lower() for t in taken}, {}
    for p in paths:
        name = p.replace("[]", "").replace(".", "__")
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out[p] = name
    return out


def _each(x, kind: str):
    return F.transform(x, lambda v: v.try_cast(kind))


def conform(records: DataFrame, named: DataFrame, kind: str, target: list[tuple[str, str]], defaults: dict[str, object] | None = None, object_arrays: tuple[str, ...] = ()) -> DataFrame:
    """One table of a kind: record_id, exporter, file_seq, a column per (path, type) of ``target``, and ``extra``.

    Inside its row each value goes through the chained renames of its file, then the cast; no value is shuffled, and the
    map of a file comes by a join on the file. A value that cannot be cast, and all fields without a column, stay in
    ``extra``. A field the record does not hold has its default. A field that changes name and type in one step is a new
    field, as in the list of changes.
    """
    r = records.where(F.col("record_kind") == kind).select("record_id", "exporter", F.col("file_seq").cast("bigint").alias("file_seq"), "text")
    n = named.where(F.col("record_kind") == kind).select("exporter", "file_seq", F.map_entries("names").alias("names"))
    out = "record_id bigint, exporter string, file_seq bigint, m map<string,array<string>>"
    r = r.join(n, ["exporter", "file_seq"], "left").select("record_id", "exporter", "file_seq", "text", F.transform("names", lambda e: F.array(e["key"], e["value"])).alias("names"))
    r = r.mapInArrow(_rows(object_arrays, pa.schema([("record_id", pa.int64()), ("exporter", pa.string()), ("file_seq", pa.int64()), ("m", pa.map_(pa.string(), pa.list_(pa.string())))])), out)
    label = column_names([p for p, _ in target], ("record_id", "exporter", "file_seq", "extra", "m"))
    cols, kept = [], []
    for path, kind_of in target:
        x = F.try_element_at(F.col("m"), F.lit(path))
        if kind_of.startswith("array<"):
            c = _each(x, kind_of[6:-1])
            whole = F.forall(c, lambda v: v.isNotNull())
            c = F.when(whole, c)
        else:
            c = F.when(F.size(x) == 1, x[0].try_cast(kind_of))
        kept.append(F.when(c.isNotNull(), F.lit(path)))
        cols.append(F.when(x.isNull(), F.lit((defaults or {}).get(path)).cast(kind_of)).otherwise(c).alias(label[path]))
    extra = F.map_filter("m", lambda k, _: ~F.array_contains(F.array_compact(F.array(F.lit(None).cast("string"), *kept)), k))
    return r.select("record_id", "exporter", "file_seq", *cols, extra.alias("extra"))
