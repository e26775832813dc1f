"""Byte-pair encoding of whole corpora with a public vocabulary, by recursive queries of an in-process DuckDB.

Each Arrow batch of a partition is one pass: texts are split by the vocabulary's pattern, each distinct word of the batch
becomes token-position rows, and a recursive query joins neighbouring tokens with the merge table and contracts the
leftmost pair of minimum rank of every word until no pair merges. An ordered aggregation gives the ids of each word, and
the words of a text in order give its ids. Words already encoded in the partition are not encoded again; the memory of
them is bounded and emptied when full, which changes no result.

A null or empty text has no tokens: its ids are the empty list.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.store import spread

#: Split of a text before the merges (fixed value of the vocabulary family).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_DIR = "/opt/tokenizers"
REMEMBERED = 200_000
#: In words longer than this many bytes a round contracts all places of the pair at once where that gives the same.
LONG = 256
#: Rounds of one query over long words; the words that are not done then start the next with the tokens they have.
ROUNDS = 64
#: Token-position rows of one query; the recursion holds all its rounds, so this bounds its memory.
ROWS = 100_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Encoder:
    """One vocabulary with its merge table in a DuckDB of this process."""

    def __init__(self, path: str):
        import duckdb
        import regex

        self.ranks = load_ranks(path)
        self.split = regex.compile(PATTERN).findall
        self.words: dict[str, list[int]] = {}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})  # what it holds is bounded, nothing is spilled
        self.single = [self.ranks[bytes([i])] for i in range(256)]
        left, right, merged = [], [], []
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                a, b = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        merge = pa.table({"a": pa.array(left, pa.int32()), "b": pa.array(right, pa.int32()), "m": pa.array(merged, pa.int32())})
        self.db.register("merge_rows", merge)
        # no token made of a safe one has a smaller rank, so after a contraction its other places are still first in order
        self.db.execute("CREATE TABLE merge AS SELECT a::BIGINT * 4294967296 + b AS ab, m FROM merge_rows")
        self.db.execute("CREATE TABLE unsafe AS SELECT DISTINCT x AS m FROM (SELECT a AS x, m FROM merge_rows UNION ALL SELECT b, m FROM merge_rows) WHERE m < x")

    #: Tokens of a word are rows (w, p, t). In a round every word contracts its leftmost pair of least rank: the pair's
    #: left row takes the merged token, its right row goes. Words without a mergeable pair leave the recursion.
    _FIXPOINT = """
    WITH RECURSIVE step(w, p, t, done) AS (
      SELECT w, p, t, false FROM start
      UNION ALL
      SELECT w, p, CASE WHEN m IS NOT NULL AND p = lp THEN m ELSE t END, m IS NULL FROM (
        SELECT w, p, t, m, lp, lag(p) OVER (PARTITION BY w ORDER BY p) AS before FROM (
          SELECT s.w, s.p, s.t, first_value(x.m) OVER b AS m, first_value(s.p) OVER b AS lp FROM (
            SELECT w, p, t, lead(t) OVER (PARTITION BY w ORDER BY p) AS u FROM step WHERE NOT done) s
          LEFT JOIN merge x ON x.ab = s.t::BIGINT * 4294967296 + s.u
          WINDOW b AS (PARTITION BY s.w ORDER BY x.m NULLS LAST, s.p)))
      WHERE m IS NULL OR before IS NULL OR before <> lp)
    SELECT w, list(t ORDER BY p) AS ids FROM step WHERE done GROUP BY w
    """

    def _merge(self, words: list[str]) -> None:
        ws, ps, ts = [], [], []
        single = self.single
        for w, word in enumerate(words):
            raw = word.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(raw)
            if whole is not None:
                self.words[word] = [whole]
            elif len(raw) > LONG:
                self._long(words, [w] * len(raw), list(range(len(raw))), [single[x] for x in raw])
            else:
                ws += [w] * len(raw)
                ps += range(len(raw))
                ts += [single[x] for x in raw]
                if len(ws) >= ROWS:
                    self._fixpoint(words, ws, ps, ts)
                    ws, ps, ts = [], [], []
        if ws:
            self._fixpoint(words, ws, ps, ts)

    def _fixpoint(self, words: list[str], ws: list[int], ps: list[int], ts: list[int]) -> None:
        start = pa.table({"w": pa.array(ws, pa.int32()), "p": pa.array(ps, pa.int32()), "t": pa.array(ts, pa.int32())})
        self.db.register("start", start)
        got = self.db.execute(self._FIXPOINT).fetchall()
        self.db.unregister("start")
        for w, ids in got:
            self.words[words[w]] = ids

    #: As above, for long words: if the pair is safe, all its places are contracted, in a run of equal tokens every second.
    _FIXPOINT_LONG = """
    WITH RECURSIVE step(w, p, t, done, r) AS (
      SELECT w, p, t, false, 0 FROM start
      UNION ALL
      SELECT w, p, CASE WHEN hit THEN m ELSE t END, m IS NULL, r + 1 FROM (
        SELECT *, lag(hit) OVER (PARTITION BY w ORDER BY p) AS gone FROM (
          SELECT *, here AND CASE WHEN safe THEN (n - coalesce(max(CASE WHEN NOT here THEN n END) OVER (PARTITION BY w ORDER BY p ROWS UNBOUNDED PRECEDING), 0)) % 2 = 1 ELSE p = lp END AS hit FROM (
            SELECT s.w, s.p, s.t, s.r, s.n, first_value(x.m) OVER b AS m, coalesce(x.m = first_value(x.m) OVER b, false) AS here, first_value(z.m) OVER b IS NULL AS safe, first_value(s.p) OVER b AS lp FROM (
              SELECT w, p, t, r, lead(t) OVER o AS u, row_number() OVER o AS n FROM step WHERE NOT done AND r < $rounds WINDOW o AS (PARTITION BY w ORDER BY p)) s
            LEFT JOIN merge x ON x.ab = s.t::BIGINT * 4294967296 + s.u LEFT JOIN unsafe z ON z.m = x.m
            WINDOW b AS (PARTITION BY s.w ORDER BY x.m NULLS LAST, s.p))))
      WHERE NOT coalesce(gone, false))
    SELECT w, list(t ORDER BY p) AS ids, list(p ORDER BY p) AS ps, bool_and(done) AS done FROM step WHERE done OR r = $rounds GROUP BY w
    """

    def _long(self, words: list[str], ws: list[int], ps: list[int], ts: list[int]) -> None:
        while ws:
            self.db.register("start", pa.table({"w": pa.array(ws, pa.int32()), "p": pa.array(ps, pa.int32()), "t": pa.array(ts, pa.int32())}))
            got = self.db.execute(self._FIXPOINT_LONG, {"rounds": ROUNDS}).fetchall()
            self.db.unregister("start")
            ws, ps, ts = [], [], []
            for w, ids, at, done in got:
                if done:
                    self.words[words[w]] = ids
                else:
                    ws += [w] * len(ids)
                    ps += at
                    ts += ids

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        split = [self.split(t) if t else () for t in texts]
        new = {w for ws in split for w in ws if w not in self.words}
        if len(self.words) + len(new) > REMEMBERED:
            self.words = {}
            new = {w for ws in split for w in ws}
        if new:
            self._merge(sorted(new))
        known = self.words
        return [[i for w in ws for i in known[w]] for ws in split]

    def decode(self, ids: list[int]) -> str:
        if not hasattr(self, "_tokens"):
            self._tokens = {v: k for k, v in self.ranks.items()}
        return b"".join(self._tokens[i] for i in ids).decode("utf-8", "surrogatepass")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def vocabulary(name: str = "byte_bpe_50k", folder: str = DEFAULT_DIR) -> str:
    return os.path.join(folder, f"{name}.tiktoken")


def _slices(batches, size: int = 1 << 22):
    """Row slices of about ``size`` bytes of text, one row at least."""
    for b in batches:
        lengths = pa.compute.fill_null(pa.compute.binary_length(b.column(1)), 0).to_pylist()
        begin, held = 0, 0
        for k, n in enumerate(lengths):
            if held and held + n > size:
                yield b.slice(begin, k - begin)
                begin, held = k, 0
            held += n
        if begin < b.num_rows:
            yield b.slice(begin)


def _encode(path: str, count: bool):
    def run(batches):
        e = encoder(path)
        for b in _slices(batches):
            ids = e.encode(b.column(1).to_pylist())
            second = pa.array([len(x) for x in ids], pa.int64()) if count else pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), second, *b.columns[2:]], ["id", "n_tokens" if count else "ids", *b.schema.names[2:]])

    return run


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary_path: str | None = None) -> DataFrame:
    """(``key``, ids) of every row."""
    kind = docs.schema[key].dataType.simpleString()
    rows = spread(docs.select(F.col(key).alias("id"), F.col(text).alias("text")), "id")
    return rows.mapInArrow(_encode(vocabulary_path or vocabulary(), False), f"id {kind}, ids array<int>").withColumnRenamed("id", key)


def sizes(docs: DataFrame, key: str, text: str, keep: list[str], vocabulary_path: str | None = None) -> DataFrame:
    """(``key``, n_tokens, kept columns) of every row."""
    kind = docs.schema[key].dataType.simpleString()
    rows = spread(docs.select(F.col(key).alias("id"), F.col(text).alias("text"), *keep), "id")
    schema = ", ".join([f"id {kind}", "n_tokens bigint", *(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)])
    return rows.mapInArrow(_encode(vocabulary_path or vocabulary(), True), schema).withColumnRenamed("id", key)
