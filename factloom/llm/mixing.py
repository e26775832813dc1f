"""Mixing sources to target weights by Pareto order sampling.

Sizes are tokens of a public tokenizer. The total is the largest at which every source that has tokens meets its share
within its ``max_repeats``; shares of sources without tokens are spread over the others in proportion and reported as
missed. A source's budget is met by whole copies of all its documents, as often as they fit, and a sample for the rest.
The sample ranks documents by random odds over inclusion odds, (u / (1 - u)) / (p / (1 - p)) with p in proportion to size
and u a hash of the id, and takes them in that order up to the size that is left; the document that would pass it is
left out. So a source ends below its budget by less than one document.

The cut is found without sorting a source in one task: documents are counted by fine bands of their rank, the bands are
added up (a bounded table), and only the band in which the size is reached is put in order.

Documents without a source, or of a source without a target, are not selected. Documents without tokens are selected only
in whole copies. A null or negative share or repeat counts as 0. Sources named twice in the targets have their shares
added and their smallest repeat.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from factloom.store import Scratch

BANDS = 4096
ROUNDS = 8


def plan(stats: list[tuple[str, int]], targets: list[tuple[str, float, int]]) -> dict[str, dict]:
    """Per source: share, target, tokens, repeats, budget, whole copies and rest, from token totals and targets."""
    want: dict[str, list] = {}
    for source, share, repeats in targets:
        w = want.setdefault(source, [0.0, None])
        w[0] += max(share or 0.0, 0.0)
        w[1] = max(repeats or 0, 0) if w[1] is None else min(w[1], max(repeats or 0, 0))
    have = dict(stats)
    usable = {s: w for s, w in want.items() if w[0] > 0 and w[1] > 0 and have.get(s, 0) > 0}
    scale = sum(w[0] for w in usable.values())
    total = min((w[1] * have[s] / (w[0] / scale) for s, w in usable.items()), default=0.0)
    out = {}
    for s, (share, repeats) in want.items():
        tokens = have.get(s, 0)
        budget = int(total * share / scale + 1e-6) if s in usable else 0
        whole = min(budget // tokens, repeats) if tokens else 0
        out[s] = {"target_share": share, "max_repeats": repeats, "tokens": tokens, "budget": budget, "whole": whole, "rest": budget - whole * tokens if whole < repeats else 0}
    return out


def _with(df: DataFrame, kind: str, **values: dict[str, object]) -> DataFrame:
    """``df`` with a column of each of ``values``, source -> value; a row per source of the recipe, so it is broadcast."""
    names = sorted({s for v in values.values() for s in v})
    rows = [(s, *(v.get(s) for v in values.values())) for s in names]
    t = df.sparkSession.createDataFrame(rows, ", ".join(["source string", *(f"{k} {kind}" for k in values)]))
    return df.join(F.broadcast(t), "source", "left")


def _slope(sized: DataFrame, rest: dict[str, int]) -> dict[str, float]:
    """Per source the c with sum(size x min(1, c x size)) = rest, from sums only; each round is one aggregation."""
    c = {s: 0.0 for s in rest}
    for _ in range(ROUNDS):
        full = F.col("n_tokens") * F.col("c") >= 1
        g = _with(sized.where(F.col("source").isin(*rest)), "double", c=c).groupBy("source").agg(F.sum(F.when(full, F.col("n_tokens").cast("double")).otherwise(0.0)).alias("sure"), F.sum(F.when(full, 0.0).otherwise(F.col("n_tokens").cast("double") * F.col("n_tokens"))).alias("sq"))
        new = {r.source: max((rest[r.source] - r.sure) / r.sq, 0.0) if r.sq else c[r.source] for r in g.collect()}
        done = all(math.isclose(new.get(s, 0.0), c[s], rel_tol=1e-9) for s in rest)
        c.update(new)
        if done:
            break
    return c


def select(sized: DataFrame, targets: DataFrame, seed: int = 0) -> tuple[DataFrame, dict[str, dict]]:
    """((doc_id, source, n_tokens, copies), plan) of ``sized(doc_id, source, n_tokens)`` and ``targets(source, target_share, max_repeats)``.

    The targets table is the mixture's recipe, a row per source, and is read by the driver, as are the sums per source named in it.
    """
    rows = [(r.source, r.target_share, r.max_repeats) for r in targets.where("source IS NOT NULL").select("source", "target_share", "max_repeats").collect()]
    names = sorted({r[0] for r in rows})
    store = Scratch(sized.sparkSession, "mix")
    sized = store.cut(sized.where(F.col("source").isin(*names)))
    sums = sized.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()
    p = plan([(r.source, r.n or 0) for r in sums], rows)
    whole = {s: x["whole"] for s, x in p.items()}
    rest = {s: x["rest"] for s, x in p.items() if x["rest"] > 0}
    base = _with(sized, "int", whole=whole).withColumn("copies", F.coalesce("whole", F.lit(0))).drop("whole")
    if rest:
        c = _slope(sized, rest)
        incl = F.least(F.lit(1.0), F.col("n_tokens") * F.col("c"))
        u = (F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))
        # log of the odds ratio; certain documents come first
        rank = F.when(incl >= 1.0, F.lit(-1e9)).otherwise(F.log(u / (1 - u)) - F.log(incl / (1 - incl)))
        ranked = _with(sized.where(F.col("source").isin(*rest) & (F.col("n_tokens") > 0)), "double", c=c).select("doc_id", "source", "n_tokens", F.coalesce(rank, F.lit(1e9)).alias("r"))
        band = F.when(F.col("r") <= -1e9, 0).otherwise(1 + F.floor((1 / (1 + F.exp(-F.col("r") / 4))) * (BANDS - 1)).cast("int"))
        ranked = store.cut(ranked.withColumn("band", band))
        bands = ranked.groupBy("source", "band").agg(F.sum("n_tokens").alias("n"))  # at most BANDS rows a source
        acc = _with(bands.withColumn("upto", F.sum("n").over(W.partitionBy("source").orderBy("band"))), "bigint", rest=rest).where("upto > rest")
        edge = {r.source: (r.m.band, r.m.upto - r.m.n) for r in acc.groupBy("source").agg(F.min(F.struct("band", "upto", "n")).alias("m")).collect()}
        last = {s: edge[s][0] if s in edge else BANDS + 1 for s in rest}
        before = {s: edge[s][1] if s in edge else 0 for s in rest}
        ranked = _with(ranked, "bigint", last=last, before=before, rest=rest)
        inside = ranked.where("band < last").select("doc_id", "source")
        order = W.partitionBy("source").orderBy("r", "doc_id")
        at = ranked.where("band = last").withColumn("upto", F.sum("n_tokens").over(order) + F.col("before"))
        taken = inside.unionAll(at.where("upto <= rest").select("doc_id", "source")).withColumn("more", F.lit(1))
        base = base.join(taken, ["doc_id", "source"], "left").withColumn("copies", F.col("copies") + F.coalesce("more", F.lit(0)))
    return base.where("copies > 0").select("doc_id", "source", "n_tokens", F.col("copies").cast("int").alias("copies")), p


def shares(selected: DataFrame, p: dict[str, dict]) -> DataFrame:
    """Per source of the targets: tokens there are and taken, target and actual share, most repeats used, and the gap."""
    spark = selected.sparkSession
    rows = [(s, float(x["target_share"]), x["max_repeats"], x["tokens"], x["budget"]) for s, x in sorted(p.items())]
    base = spark.createDataFrame(rows, "source string, target_share double, max_repeats int, tokens bigint, budget bigint")
    got = selected.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("n_tokens") * F.col("copies")).alias("taken"), F.max("copies").alias("repeats"))
    out = base.join(F.broadcast(got), "source", "left").fillna(0, ["documents", "taken", "repeats"])
    share = F.col("taken") / F.sum("taken").over(W.partitionBy(F.lit(1)))  # one row per target source
    return out.withColumn("actual_share", F.round(F.coalesce(share, F.lit(0.0)), 6)).withColumn("gap", F.round(F.col("actual_share") - F.col("target_share"), 6))
