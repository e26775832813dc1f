"""Parent-child rows to full hierarchies, by hash splitters.

A deterministic hash makes one node in ``gap`` a splitter. Every node walks to its next splitters; each round doubles the
stride, and only the front of a walk goes on. The splitters then form a reduced pointer graph a
``gap``-th as large, which is solved the same way with other splitters; one join expands it to all nodes. A cycle with a
splitter shrinks from level to level until a splitter points to itself. A walk on a cycle without one meets a node of its
own trail, and ends there with the mark of a cycle.

Nodes are BIGINT ids. Null ends, repeated edges and edges to ids that have no row of their own are allowed: null ends
are ignored, repeats count once, an id without an outgoing edge is an end. An empty edge table gives empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.store import Scratch

GAP = 64


def _is_splitter(c, gap: int):
    return F.pmod(F.xxhash64(c), F.lit(gap)) == 0


def reach(edges: DataFrame, wanted: DataFrame | None = None, gap: int = GAP) -> DataFrame:
    """(src, dst): which nodes of ``wanted(id)`` (all, if there is none) each node of ``edges(src, dst)`` reaches by one link or more.

    A row with null ``dst`` tells that links from ``src`` lead into a cycle. A node is paired with itself only if it is
    on a cycle.
    """
    store = Scratch(edges.sparkSession, "reach")
    e = edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct()
    marks = e if wanted is None else e.join(wanted.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
    pairs = e.withColumn("mark", F.lit(False)).unionAll(marks.withColumn("mark", F.lit(True)))
    return _solve(store, pairs, gap, 0).distinct()


def _solve(store: Scratch, pairs: DataFrame, gap: int, level: int) -> DataFrame:
    """(src, dst) of every src that has marks, from ``pairs(src, dst, mark)``: links (mark false) and marks that a node has itself.

    A walk (src, dst, trail) has passed the nodes of ``trail``, dst the last. Of walks between the same nodes one is kept;
    a shortest one never meets itself, so no node is missed when a walk that does is ended with the mark of a cycle.
    """
    split = lambda c: F.pmod(F.xxhash64(c, F.lit(level)), F.lit(gap)) == 0
    moving = ~F.col("mark") & ~split(F.col("dst"))

    def put(walks: DataFrame) -> tuple[DataFrame, list[int]]:
        """Walks that came round get the mark of a cycle; the others are thinned to one for each pair of ends."""
        trail = F.concat(F.array("src"), "trail")
        loop = ~F.col("mark") & (F.size(F.array_distinct(trail)) < F.size(trail))
        walks = walks.select("src", F.when(~loop, F.col("dst")).alias("dst"), (F.col("mark") | loop).alias("mark"), F.when(loop | F.col("mark") | split(F.col("dst")), F.array().cast(trail_type)).otherwise(F.col("trail")).alias("trail"))
        return store.cut_counting(walks.groupBy("src", "dst", "mark").agg(F.min("trail").alias("trail")), ~F.col("mark"), moving)

    trail_type = f"array<{pairs.schema['dst'].dataType.simpleString()}>"
    table, (links, live) = put(pairs.select("src", "dst", "mark", F.array("dst").alias("trail")))
    if not links:
        return table.select("src", "dst")
    parts = [table]
    while live:
        walks = parts[-1].where(moving)
        settled = store.union(parts).where(~moving).unionAll(walks)
        at = settled.select(F.col("src").alias("at"), F.col("dst").alias("to"), "mark", F.col("trail").alias("more"))
        step = walks.select("src", F.col("dst").alias("at"), "trail").join(at, "at")
        # what has settled is without a trail, but has moved on by a link at least
        more = F.when(F.size("more") > 0, F.col("more")).otherwise(F.array("to"))
        table, (_, live) = put(step.select("src", F.col("to").alias("dst"), "mark", F.concat("trail", more).alias("trail")))
        parts.append(table)
    done = store.union(parts).where(~moving).select("src", "dst", "mark")
    marks, hops = done.where("mark").select("src", "dst"), done.where("NOT mark").select("src", "dst")
    # the splitters' own links and marks are the reduced graph
    small = _solve(store, done.where(split(F.col("src"))), gap, level + 1)
    far = hops.withColumnRenamed("dst", "hub").join(small.withColumnRenamed("src", "hub"), "hub").select("src", "dst")
    return marks.unionAll(far)


def paths(pointers: DataFrame, gap: int = GAP) -> DataFrame:
    """Exact path of each node over single pointers ``(id, up)`` (``up`` null at a root).

    Returns (id, root_id, depth, path, in_cycle): ``path`` runs from the root to the node, ``depth`` is its number of
    links. A node whose pointers lead into a cycle has in_cycle true, root_id null, and depth and path null. ``up`` must
    be null or a row's id; an ``id`` may occur once.
    """
    store = Scratch(pointers.sparkSession, "paths")
    p = pointers.select("id", "up")
    # Walk: (id, at, trail) with trail = nodes after id up to and including at.
    walk = store.cut(p.where("up IS NOT NULL").select("id", F.col("up").alias("at"), F.array("up").alias("trail")))
    ended = p.where("up IS NULL").select(F.col("id").alias("at"))

    plain = F.size("trail") == F.size(F.array_distinct("trail"))  # else the walk has come round

    def settle(table: DataFrame, stop) -> DataFrame:
        """Double the stride of the walks that are neither at a stop, nor at an end, nor round a cycle."""
        made = None
        while True:
            moving = ~stop & plain
            if table.where(moving).join(ended, "at", "left_anti").isEmpty():
                return table
            nxt = table.select(F.col("id").alias("at"), F.col("at").alias("at2"), F.col("trail").alias("trail2"))
            moved = table.where(moving).join(nxt, "at", "left").select("id", F.coalesce("at2", "at").alias("at"), F.when(F.col("at2").isNull(), F.col("trail")).otherwise(F.concat("trail", "trail2")).alias("trail"))
            new = store.cut(table.where(~moving).unionByName(moved))
            store.drop(made)
            made = table = new

    stop = _is_splitter(F.col("at"), gap)
    walk = settle(walk, stop)
    hubs = store.cut(walk.where(_is_splitter(F.col("id"), gap)))
    hubs = settle(hubs, F.lit(False))
    tail = hubs.select(F.col("id").alias("at"), F.col("at").alias("root"), F.col("trail").alias("more"))
    full = walk.join(tail, "at", "left").select("id", F.coalesce("root", "at").alias("root_id"), F.when(F.col("root").isNull(), F.col("trail")).otherwise(F.concat("trail", "more")).alias("trail"))
    full = full.join(ended.withColumnRenamed("at", "root_id").withColumn("ok", F.lit(True)), "root_id", "left")
    good = F.col("ok").isNotNull()
    out = full.select(
        "id",
        F.when(good, F.col("root_id")).alias("root_id"),
        F.when(good, F.size("trail")).cast("int").alias("depth"),
        F.when(good, F.concat(F.reverse("trail"), F.array("id"))).alias("path"),
        (~good).alias("in_cycle"),
    )
    roots = p.where("up IS NULL").select("id", F.col("id").alias("root_id"), F.lit(0).alias("depth"), F.array("id").alias("path"), F.lit(False).alias("in_cycle"))
    return out.unionByName(roots)
