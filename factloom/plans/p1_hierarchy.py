"""Problem 1: class definitions to full hierarchies.

A node is a class name of a repository; it is known by the smallest class_id that defines it. Links between definitions
are links between names, because a link goes to every definition of its target name, so name-level reach gives
definition-level reach without multiplying repeated definitions along a path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.text import class_name
from factloom.operators import hierarchy
from factloom.store import Scratch, table


def definitions(raw: DataFrame) -> DataFrame:
    """One row per class_id with normal names: (class_id, repo_id, name, parent, targets).

    Rows without class_id or repo_id link to nothing and are left out. A definition without a name can have links but is
    the target of none.
    """
    cols = F.struct(F.col("repo_id"), class_name(F.col("full_name")).alias("name"), class_name(F.col("resolved_parent")).alias("parent"), F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce("resolved_interfaces", F.array().cast("array<string>")), class_name), lambda x: x.isNotNull()))).alias("faces"))
    one = raw.where("class_id IS NOT NULL AND repo_id IS NOT NULL").groupBy("class_id").agg(F.min(cols).alias("v"))
    return one.select("class_id", "v.repo_id", "v.name", "v.parent", F.array_distinct(F.array_compact(F.concat(F.array("v.parent"), F.col("v.faces")))).alias("targets"))


def links(raw: DataFrame, store: Scratch):
    """(defs with the node id ``nid`` of their own name, links (class_id, nid, to_nid))."""
    d = store.cut(definitions(raw))
    names = d.where("name IS NOT NULL").groupBy("repo_id", "name").agg(F.min("class_id").alias("to_nid"))
    defs = store.cut(d.join(names.withColumnRenamed("to_nid", "nid"), ["repo_id", "name"], "left").withColumn("nid", F.coalesce("nid", "class_id")))
    wants = defs.select("class_id", "nid", "repo_id", "parent", F.explode("targets").alias("name"))
    found = wants.join(names, ["repo_id", "name"]).select("class_id", "nid", "to_nid", F.col("name").eqNullSafe(F.col("parent")).alias("is_parent"))
    return defs, store.cut(found)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(class_id, root_id): reachable roots of each definition, and root_id 0 where links lead into a cycle."""
    store = Scratch(spark, "p1")
    defs, found = links(table(spark, sf_dir, "class_symbol"), store)
    edges = found.select(F.col("nid").alias("src"), F.col("to_nid").alias("dst"))
    roots = store.cut(defs.join(found.select("class_id").distinct(), "class_id", "left_anti").select(F.col("class_id").alias("root_id"), F.col("nid").alias("end")))
    ends = roots.select(F.col("end").alias("id")).distinct()
    # names that hold a root, as seen from each target name, itself included; 0 for a cycle
    near = ends.select(F.col("id").alias("to_nid"), F.col("id").alias("end"))
    seen = store.cut(hierarchy.reach(edges, ends).select(F.col("src").alias("to_nid"), F.col("dst").alias("end")).unionAll(near))
    loops = seen.where("end IS NULL").select("to_nid", F.lit(0).cast("long").alias("root_id"))
    holds = seen.join(roots, "end").select("to_nid", "root_id").unionAll(loops).distinct()
    return found.select("class_id", "to_nid").join(holds, "to_nid").select("class_id", "root_id").where("class_id <> root_id").distinct()


def p1_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree of primary links (the parent, else the smallest interface; of a name its first definition): per definition its exact path, depth and root."""
    store = Scratch(spark, "p1p")
    defs, found = links(table(spark, sf_dir, "class_symbol"), store)
    first = found.groupBy("class_id").agg(F.min(F.struct(~F.col("is_parent"), F.col("to_nid"))).alias("m")).select(F.col("class_id").alias("id"), F.col("m.to_nid").alias("up"))
    return hierarchy.paths(defs.select(F.col("class_id").alias("id")).join(first, "id", "left"))


def p1_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ancestor_id, class_id): every definition below another, over all links, with no pair of a definition and itself."""
    store = Scratch(spark, "p1d")
    defs, found = links(table(spark, sf_dir, "class_symbol"), store)
    r = hierarchy.reach(found.select(F.col("nid").alias("src"), F.col("to_nid").alias("dst")))
    onto = r.where("dst IS NOT NULL").select(F.col("src").alias("to_nid"), F.col("dst").alias("up")).unionAll(found.select("to_nid", F.col("to_nid").alias("up")).distinct()).distinct()
    up = found.select("class_id", "to_nid").join(onto, "to_nid").select("class_id", "up").distinct()
    return up.join(defs.select(F.col("nid").alias("up"), F.col("class_id").alias("ancestor_id")), "up").select("ancestor_id", "class_id").where("ancestor_id <> class_id").distinct()


QUERIES = {"p1_found": p1_found, "p1_paths": p1_paths, "p1_descendants": p1_descendants}

_NAME = r"nullif(lower(regexp_replace(regexp_replace({0}, '^[\s\p{{Z}}\\]+|[\s\p{{Z}}]+$', '', 'g'), '\\{{2,}}', '\\', 'g')), '')"
_DEFS = f"""
d AS (SELECT DISTINCT class_id, repo_id, {_NAME.format('full_name')} AS name, {_NAME.format('resolved_parent')} AS parent, resolved_interfaces AS faces FROM class_symbol WHERE class_id IS NOT NULL AND repo_id IS NOT NULL),
t AS (SELECT class_id, repo_id, name, parent AS target, true AS is_parent FROM d UNION SELECT class_id, repo_id, name, {_NAME.format('x')}, false FROM (SELECT class_id, repo_id, name, unnest(faces) AS x FROM d)),
link AS (SELECT t.class_id, o.class_id AS to_id, bool_or(t.is_parent) AS is_parent FROM t JOIN d o ON t.repo_id = o.repo_id AND t.target = o.name GROUP BY 1, 2),
reach AS (SELECT class_id, to_id FROM link UNION SELECT r.class_id, l.to_id FROM reach r JOIN link l ON r.to_id = l.class_id)
"""
ORACLE = {
    "p1_found": f"""WITH RECURSIVE {_DEFS},
cyc AS (SELECT class_id FROM reach WHERE class_id = to_id)
SELECT class_id, to_id AS root_id FROM reach WHERE to_id NOT IN (SELECT class_id FROM link) AND class_id <> to_id
UNION SELECT class_id, CAST(0 AS BIGINT) FROM reach WHERE to_id IN (SELECT class_id FROM cyc)""",
    "p1_descendants": f"WITH RECURSIVE {_DEFS} SELECT to_id AS ancestor_id, class_id FROM reach WHERE class_id <> to_id",
    "p1_paths": f"""WITH RECURSIVE {_DEFS},
up AS (SELECT d.class_id AS id, (SELECT arg_min(l.to_id, (CASE WHEN l.is_parent THEN 0 ELSE 1 END, l.to_id)) FROM link l WHERE l.class_id = d.class_id) AS up FROM d),
down AS (SELECT id, id AS root_id, 0 AS depth, [id] AS path FROM up WHERE up IS NULL
  UNION ALL SELECT u.id, w.root_id, w.depth + 1, list_append(w.path, u.id) FROM down w JOIN up u ON u.up = w.id)
SELECT id, root_id, depth, path, false AS in_cycle FROM down
UNION ALL SELECT id, NULL, NULL, NULL, true FROM up WHERE id NOT IN (SELECT id FROM down)""",
}
