"""Two copies of a table compared key by key with shared ordinals and presence bitmaps.

Keys alone are shuffled first, with digests of their rows. Inside a partition they are sorted and numbered in blocks; a
key's number is its ordinal on both sides. A block has a compressed presence bitmap per side: AND-NOT of the two gives the
missing rows, their AND with the bitmap of unequal digests the rows to compare. Only those rows are then read whole and
compared column by column, aligned by ordinal.

Null keys are one key. Of several rows of a side with one key the greatest value of each field is compared.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.store import Scratch

BLOCK = 1 << 15


class Bitmap:
    """Presence of the ordinals of a block, deflated while it is kept."""

    def __init__(self, mask: np.ndarray):
        self.n = len(mask)
        self.bytes = zlib.compress(np.packbits(mask).tobytes(), 1)

    def bits(self) -> np.ndarray:
        return np.frombuffer(zlib.decompress(self.bytes), np.uint8)

    def ordinals(self, bits: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bits, count=self.n))

    def and_not(self, other: Bitmap) -> np.ndarray:
        return self.ordinals(self.bits() & ~other.bits())

    def both(self, other: Bitmap) -> np.ndarray:
        return self.ordinals(self.bits() & other.bits())


def _blocks(batches, size: int):
    """Tables of at most ``size`` rows over the batches of a partition."""
    held, n = [], 0
    for b in batches:
        while b.num_rows:
            part = b.slice(0, size - n)
            held.append(part)
            n += part.num_rows
            b = b.slice(part.num_rows)
            if n == size:
                yield pa.Table.from_batches(held).combine_chunks()
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _present(column) -> np.ndarray:
    return np.asarray(pc.is_valid(column).combine_chunks() if isinstance(column, pa.ChunkedArray) else pc.is_valid(column))


def _flat(column):
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _field(column, i: int):
    """Child ``i`` of a struct column, null where the struct is."""
    return pc.struct_field(_flat(column), [i])


def _same(a, b):
    eq = pc.fill_null(pc.equal(a, b), False)
    if pa.types.is_floating(a.type):
        eq = pc.or_(eq, pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False))
    return pc.or_(eq, pc.and_(pc.is_null(a), pc.is_null(b)))


def _masks(t: pa.Table) -> tuple[Bitmap, Bitmap, np.ndarray]:
    """Presence of a block's ordinals on both sides, and where all rows of both sides have one digest."""
    a, b = (Bitmap(_present(t.column(f"{s}1_min"))) for s in "ab")
    same = np.ones(t.num_rows, bool)
    for d in "12":
        low = _flat(t.column(f"a{d}_min"))
        for other in (f"a{d}_max", f"b{d}_min", f"b{d}_max"):
            same &= np.asarray(pc.fill_null(pc.equal(low, _flat(t.column(other))), False))
    return a, b, same


def _missing(key_type: pa.DataType, size: int):
    """Keys missing on a side, and with a null difference those on both sides whose digests differ."""

    def run(batches):
        for t in _blocks(batches, size):
            first, second, same = _masks(t)
            differ = Bitmap(~same)
            both = first.bits() & second.bits()
            key = _flat(t.column("key"))
            for at, name in ((first.and_not(second), "only_in_first"), (second.and_not(first), "only_in_second"), (first.ordinals(both & differ.bits()), None)):
                if len(at):
                    yield pa.RecordBatch.from_arrays([key.take(pa.array(at)).cast(key_type), pa.array([name] * len(at), pa.string())], ["key", "difference"])

    return run


def _fields(names: list[str], key_type: pa.DataType, size: int):
    """Names of the fields that differ, column by column over the ordinals that both sides hold."""

    def run(batches):
        for t in _blocks(batches, size):
            key, a, b = (_flat(t.column(i)) for i in range(3))
            both = pa.array(Bitmap(_present(a)).both(Bitmap(_present(b))))
            left, right = a.take(both), b.take(both)
            for i, name in enumerate(names):
                at = both.filter(pc.invert(_same(_field(left, i), _field(right, i))))
                if len(at):
                    yield pa.RecordBatch.from_arrays([key.take(at).cast(key_type), pa.array([name] * len(at), pa.string())], ["key", "difference"])

    return run


def _presence(key_type: pa.DataType, size: int):
    def run(batches):
        for t in _blocks(batches, size):
            first, second, _ = _masks(t)
            key = _flat(t.column("key"))
            row = [pa.array([key[0].as_py()], key_type), pa.array([len(key)], pa.int64())]
            row += [pa.array([x], pa.int64()) for x in (len(first.and_not(second)), len(second.and_not(first)), len(first.both(second)))]
            row += [pa.array([x.bytes], pa.binary()) for x in (first, second)]
            yield pa.RecordBatch.from_arrays(row, ["first_key", "ordinals", "only_in_first", "only_in_second", "in_both", "bitmap_first", "bitmap_second"])

    return run


_WHOLE = {"tinyint", "smallint", "int", "bigint"}


def _plain(df: DataFrame, name: str):
    """A column as it is compared: whole numbers as BIGINT, nested values as JSON text with the entries of maps in order."""
    c, kind = F.col(f"`{name}`"), df.schema[name].dataType
    text = kind.simpleString()
    if text in _WHOLE:
        return c.cast("bigint")
    if isinstance(kind, T.MapType):
        return F.to_json(F.array_sort(F.map_entries(c)))
    return F.to_json(c) if isinstance(kind, (T.ArrayType, T.StructType)) else c


def _ordinals(first: DataFrame, second: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Keys of both sides in order, a row each, with the least and greatest of two 64-bit digests of the rows of either side.

    Only keys and digests are shuffled, after a map-side reduction that takes the repeated rows of a hot key.
    """

    def side(df: DataFrame, mine: str) -> DataFrame:
        values = [_plain(df, f) for f in fields]
        # a hash skips nulls, so where they are goes in as well
        nulls = F.concat_ws("", *[v.isNull().cast("string") for v in values])
        own = {f"{mine}1": F.xxhash64(*values, nulls), f"{mine}2": F.xxhash64(F.lit(1), nulls, *values)}
        none = F.lit(None).cast("bigint")
        return df.select(_plain(df, key).alias("key"), *[own.get(c, none).alias(c) for c in ("a1", "a2", "b1", "b2")])

    both = side(first, "a").unionAll(side(second, "b"))
    return both.groupBy("key").agg(*[f(c).alias(f"{c}_{f.__name__}") for c in ("a1", "a2", "b1", "b2") for f in (F.min, F.max)]).sortWithinPartitions("key")


def differences(first: DataFrame, second: DataFrame, key: str, fields: list[str], size: int = BLOCK) -> DataFrame:
    """(key, difference): only_in_first, only_in_second, or the name of a field whose values are not the same.

    Whole numbers of any width compare as numbers, NaN is like NaN, nested values compare by their JSON text.
    """
    store = Scratch(first.sparkSession, "compare")
    order = _ordinals(first, second, key, fields)
    kind = order.schema["key"].dataType
    schema = f"key {kind.simpleString()}, difference string"
    found = store.cut(order.mapInArrow(_missing(_arrow(kind), size), schema))
    # whole rows move only for the keys whose digests differ
    suspect = found.where("difference IS NULL").select("key")
    names = [f"f{i}" for i in range(len(fields))]

    def side(df: DataFrame, mine: str, other: str) -> DataFrame:
        row = df.select(_plain(df, key).alias("key"), *[_plain(df, f).alias(n) for f, n in zip(fields, names)])
        row = row.join(suspect.withColumnRenamed("key", "k"), F.col("key").eqNullSafe(F.col("k")), "left_semi")
        return row.select("key", F.lit(mine == "b").alias("b"), *names)

    pair = side(first, "a", "b").unionAll(side(second, "b", "a"))
    value = lambda b: F.when(F.bool_or(F.col("b") == b), F.struct(*[F.max(F.when(F.col("b") == b, F.col(n))).alias(n) for n in names]))
    paired = pair.groupBy("key").agg(value(False).alias("a"), value(True).alias("b")).sortWithinPartitions("key")
    return found.where("difference IS NOT NULL").unionAll(paired.mapInArrow(_fields(fields, _arrow(kind), size), schema))


def presence(first: DataFrame, second: DataFrame, key: str, size: int = BLOCK) -> DataFrame:
    """One row per block of ordinals: its first key, counts, and both compressed bitmaps."""
    order = _ordinals(first, second, key, [key])
    kind = order.schema["key"].dataType
    return order.mapInArrow(_presence(_arrow(kind), size), f"first_key {kind.simpleString()}, ordinals bigint, only_in_first bigint, only_in_second bigint, in_both bigint, bitmap_first binary, bitmap_second binary")


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
