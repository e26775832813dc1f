"""Frontier loops over edge tables: distances, bounded simple paths, components, label fixpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.store import Scratch


def distances(edges: DataFrame, targets: DataFrame, most: int | None = None) -> DataFrame:
    """(node, distance): links from each node to its nearest target over ``edges(src, dst)``; one backward frontier for all targets."""
    store = Scratch(edges.sparkSession, "dist")
    e = store.cut(edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct())
    level = store.cut(targets.select("node").where("node IS NOT NULL").distinct().withColumn("distance", F.lit(0)))
    parts, known = [level], level
    while most is None or len(parts) <= most:
        nxt = e.join(level.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node")).distinct().join(known, "node", "left_anti")
        level, (n,) = store.cut_counting(nxt.withColumn("distance", F.lit(len(parts))), F.lit(True))
        if not n:
            break
        parts.append(level)
        known = store.union(parts)
    return known


def simple_paths(edges: DataFrame, starts: DataFrame, ends: DataFrame, most: int, budget: int | None = None, mark_depth: bool = False) -> DataFrame:
    """(path, confidence, complete): simple paths of at most ``most`` links from a start to an end.

    Nodes farther from every end than the links that are left are not entered. ``confidence`` is the least of the links.
    With a ``budget`` the walk stops entering a level of more paths; ``complete`` is then false on every row. With
    ``mark_depth`` it is also false on the rows of a start from which a way to an end was left for its length.
    """
    store = Scratch(edges.sparkSession, "paths")
    e = store.cut(edges.groupBy("src", "dst").agg(F.max("confidence").alias("confidence")))
    far = store.cut(distances(e, ends.select("node"), None if mark_depth else most))
    stop = far.where("distance = 0").select(F.col("node").alias("dst"), F.lit(True).alias("end"))
    walk = starts.select("node").distinct().join(far.where(F.col("distance") <= most), "node", "left_semi").select(F.col("node").alias("src"), F.array("node").alias("path"), F.lit(1.0).alias("confidence"))
    done, left, complete = [], [], True
    for k in range(1, most + 1):
        step = walk.join(e.withColumnRenamed("confidence", "c"), "src").where(~F.array_contains("path", F.col("dst")))
        step = step.join(far.select(F.col("node").alias("dst"), "distance"), "dst").withColumn("late", F.col("distance") > most - k)
        if not mark_depth:
            step = step.where("NOT late")
        path = F.when(F.col("late"), F.slice("path", 1, 1)).otherwise(F.concat("path", F.array("dst")))
        step = store.cut(step.join(stop, "dst", "left").select(F.col("dst").alias("src"), path.alias("path"), F.least("confidence", "c").alias("confidence"), F.coalesce("end", F.lit(False)).alias("end"), "late"))
        left.append(step.where("late").select(F.element_at("path", 1).alias("start")))
        step = step.where("NOT late")
        if step.isEmpty():
            break
        done.append(step.where("end").select("path", "confidence"))
        walk = step.where("NOT end").select("src", "path", "confidence")
        if budget is not None and walk.count() > budget:
            complete = False
            break
    out = done[0] if done else walk.select("path", "confidence").limit(0)
    for d in done[1:]:
        out = out.unionAll(d)
    if not mark_depth or not left:
        return out.withColumn("complete", F.lit(complete))
    cut = left[0]
    for d in left[1:]:
        cut = cut.unionAll(d)
    out = out.withColumn("start", F.element_at("path", 1)).join(cut.distinct().withColumn("cut", F.lit(True)), "start", "left")
    return out.select("path", "confidence", (F.lit(complete) & F.col("cut").isNull()).alias("complete"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node connected with each, by hooking to the least neighbour and pointer jumping."""
    store = Scratch(edges.sparkSession, "cc")
    e = edges.where("src IS NOT NULL AND dst IS NOT NULL")
    e = store.cut(e.select("src", "dst").unionAll(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    label = store.cut(e.select(F.col("src").alias("node")).distinct().withColumn("component", F.col("node")))
    while True:
        near = e.join(label.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("m"))
        hook = label.join(near, "node", "left").select("node", "component", F.least("component", "m").alias("c"))
        # the whole old component follows its least new label, then one jump
        to = hook.groupBy("component").agg(F.min("c").alias("to"))
        jump = to.select(F.col("component").alias("to"), F.col("to").alias("to2"))
        to = to.join(jump, "to", "left").select("component", F.coalesce("to2", "to").alias("to"))
        new = store.cut(label.join(to, "component").select("node", F.least("component", "to").alias("component")))
        same = new.withColumnRenamed("component", "c2").join(label, "node").where("c2 <> component").isEmpty()
        store.drop(label)
        label = new
        if same:
            return label


def propagate(facts: DataFrame, edges: DataFrame, keep: list[str], stops: DataFrame | None = None) -> DataFrame:
    """Least fixpoint of facts(node, *keep, hops) over edges(src, dst): each fact reaches every node below, with the fewest links.

    Semi-naive: only the facts of the last round are joined, and a fact that a node already has is dropped. A fact goes on
    from no node that is in ``stops(node, some of keep)`` with it.
    """
    store = Scratch(facts.sparkSession, "fix")
    e = store.cut(edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct())
    fresh = store.cut(facts.select("node", *keep).distinct().withColumn("hops", F.lit(0)))
    parts, known, k = [fresh], fresh, 0
    while True:
        k += 1
        on = fresh if stops is None else fresh.join(stops, stops.columns, "left_anti")
        nxt = on.join(e.withColumnRenamed("src", "node"), "node").select(F.col("dst").alias("node"), *keep).distinct().join(known, ["node", *keep], "left_anti")
        fresh, (n,) = store.cut_counting(nxt.withColumn("hops", F.lit(k)), F.lit(True))
        if not n:
            return known
        parts.append(fresh)
        known = store.union(parts)
