"""From facts of files to flows, call graph, chains, rule matches and findings, as joins and fixpoints.

Everything stays inside a repository: names are resolved by (repo_id, name). Names that are ambiguous stay unresolved, and
what is unknown stays in as uncertain.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from factloom.code.facts import IDS
from factloom.functions import paths, pattern
from factloom.operators import graph, hierarchy
from factloom.store import Scratch

#: Entry points that run when a serialized object is restored or dropped (fixed values).
ENTRIES = ("__destruct", "__wakeup", "__unserialize")
MAGIC = (*ENTRIES, "__tostring", "__call", "__get", "__set", "__invoke")
DESERIALIZERS = ("unserialize", "igbinary_unserialize", "wddx_deserialize", "yaml_parse", "session_decode")
CONFIDENCE = {"direct": 1.0, "static": 1.0, "magic_call": 0.9, "typed_one": 0.9, "typed_many": 0.7, "override": 0.55, "property": 0.4, "sink": 1.0}
SCOPE_BITS = IDS.bit_length() - 1


class Code:
    """The fact tables of a set of files, parsed once and written to the shared folder."""

    def __init__(self, facts: DataFrame, label: str = "code"):
        self.store = Scratch(facts.sparkSession, label)
        self.facts = self.store.cut(facts)

    def rows(self, name: str) -> DataFrame:
        return self.facts.select("file_id", "repo_id", "path", F.explode(name).alias("x")).select("file_id", "repo_id", "path", "x.*")

    @property
    def calls(self) -> DataFrame:
        return self.rows("calls")

    def errors(self) -> DataFrame:
        return self.rows("errors").select("file_id", "path", F.lit("parse").alias("phase"), "message", "line")

    def functions(self) -> DataFrame:
        """Functions and methods with the class they belong to."""
        c = self.rows("classes").select(F.col("id").alias("class_id"), F.lower("name").alias("class"), F.regexp_extract("name", r"^(.*)\\", 1).alias("class_ns"), "traits", "abstract", F.col("kind").alias("class_kind"))
        return self.rows("functions").drop("abstract").join(c, "class_id", "left").withColumn("low", F.lower("name")).withColumn("namespace", F.lower(F.coalesce("class_ns", F.regexp_extract("name", r"^(.*)\\", 1))))

    def parents(self) -> DataFrame:
        """(repo_id, class, up, step): traits that are not adapted before the parent; a name with several definitions has the first."""
        c = self.rows("classes").withColumn("class", F.lower("name"))
        one = c.groupBy("repo_id", "class").agg(F.min_by(F.struct("parent", "traits", "adapted"), "id").alias("v")).select("repo_id", "class", "v.*")
        up = F.concat(F.when(~F.col("adapted"), F.col("traits")).otherwise(F.array().cast("array<string>")), F.array("parent"))
        return one.select("repo_id", "class", F.posexplode(up).alias("step", "u")).where("u IS NOT NULL").select("repo_id", "class", F.lower("u").alias("up"), "step")

    def descendants(self) -> DataFrame:
        """(repo_id, up, class): every class below another in its repository, over parents, interfaces and traits."""
        c = self.rows("classes").withColumn("class", F.lower("name"))
        ids = self.store.cut(c.groupBy("repo_id", "class").agg(F.min("id").alias("id")))
        ups = c.select("repo_id", "class", F.explode(F.array_compact(F.concat(F.array("parent"), "interfaces", "traits"))).alias("u")).select("repo_id", "class", F.lower("u").alias("up"))
        edges = ups.join(ids, ["repo_id", "class"]).join(ids.select("repo_id", F.col("class").alias("up"), F.col("id").alias("dst")), ["repo_id", "up"]).select(F.col("id").alias("src"), "dst")
        pairs = hierarchy.reach(edges).where("src <> dst")
        low = ids.select(F.col("id").alias("src"), "repo_id", "class")
        return self.store.cut(pairs.join(low, "src").join(ids.select(F.col("id").alias("dst"), F.col("class").alias("up")), "dst").select("repo_id", "up", "class"))

    # -- resolution ---------------------------------------------------------------------------------------------------
    def owners(self, wanted: DataFrame) -> DataFrame:
        """(repo_id, class, low, fn_id, distance): the nearest method of a class, its own before its traits' and its parent's."""
        m = self.store.cut(self.functions().where("kind = 'method'").groupBy("repo_id", F.col("class").alias("at"), "low").agg(F.min("id").alias("fn_id")))
        ups = self.store.cut(self.parents())
        live = wanted.select("repo_id", "class", "low").distinct().select("*", F.col("class").alias("at"), F.lit(0).alias("order"))
        out, k, asked = None, 0, []
        while True:
            hit = self.store.cut(live.join(m, ["repo_id", "at", "low"], "left").select("repo_id", "class", "low", "at", "order", "fn_id"))
            got = hit.where("fn_id IS NOT NULL").groupBy("repo_id", "class", "low").agg(F.min_by("fn_id", F.struct("order", "fn_id")).alias("fn_id")).withColumn("distance", F.lit(k))
            out = got if out is None else out.unionAll(got)
            rest = hit.where("fn_id IS NULL").join(got.select("repo_id", "class", "low"), ["repo_id", "class", "low"], "left_anti")
            live = rest.drop("fn_id", "order").join(ups.withColumnRenamed("class", "at").withColumnRenamed("step", "order"), ["repo_id", "at"]).drop("at").withColumnRenamed("up", "at").select("repo_id", "class", "low", "at", "order")
            # a class that was asked before, as in a cycle, is not asked again
            asked.append(hit)
            live = live.groupBy("repo_id", "class", "low", "at").agg(F.min("order").alias("order")).join(self.store.union(asked), ["repo_id", "class", "low", "at"], "left_anti")
            live, (n,) = self.store.cut_counting(live, F.lit(True))
            if not n:
                return out
            k += 1

    def targets(self) -> DataFrame:
        """(call_id, fn_id, how): each call with the function it must mean; ambiguous ones are left out."""
        calls = self.calls.select("file_id", "repo_id", F.col("id").alias("call_id"), "how", "callee", "qualified", "receiver", "receiver_class", "class_name")
        fns = self.functions().where("kind = 'function'").select("repo_id", "file_id", "low", F.col("id").alias("fn_id"))
        unique = fns.groupBy("repo_id", "low").agg(F.min("fn_id").alias("fn_id"), F.count("*").alias("n"))
        local = fns.groupBy("file_id", "low").agg(F.min("fn_id").alias("local_id"), F.count("*").alias("m")).where("m = 1").drop("m")
        f = calls.where("how = 'function' AND callee IS NOT NULL").select("call_id", "repo_id", "file_id", F.explode(F.array_distinct(F.array("qualified", "callee"))).alias("low"), "qualified")
        f = f.join(unique, ["repo_id", "low"]).join(local, ["file_id", "low"], "left")
        f = f.select("call_id", F.when(F.col("n") == 1, F.col("fn_id")).otherwise(F.col("local_id")).alias("fn_id"), (F.col("low") != F.col("qualified")).alias("later")).where("fn_id IS NOT NULL")
        f = f.groupBy("call_id").agg(F.min_by("fn_id", F.struct("later", "fn_id")).alias("fn_id")).withColumn("how", F.lit("function"))
        recv, own = F.lower("receiver"), F.lower("class_name")
        up = self.parents().where("step >= 0").groupBy("repo_id", "class").agg(F.max_by("up", "step").alias("up"))
        m = calls.where("callee IS NOT NULL AND how IN ('method', 'static', 'new')").withColumn("own", own)
        m = m.join(up.withColumnRenamed("class", "own"), ["repo_id", "own"], "left")
        at = F.when((F.col("how") == "method") & F.col("receiver_class").isNotNull(), F.col("receiver_class")).when(F.col("receiver") == "$this", F.col("own")).when(recv.isin("self", "static"), F.col("own")).when(recv == "parent", F.col("up")).when(F.col("how").isin("static", "new"), recv)
        m = self.store.cut(m.select("repo_id", "call_id", "how", F.col("callee").alias("low"), at.alias("class")).where("class IS NOT NULL"))
        got = m.join(self.owners(m).drop("distance"), ["repo_id", "class", "low"]).select("call_id", "fn_id", "how")
        return self.store.cut(f.unionByName(got))

    def contract_targets(self, contracts: DataFrame) -> DataFrame:
        """(call_id, fn_id, note): what a call that nothing else resolves may mean by ``contracts(caller_class, caller_method, receiver, callee, target_class, note)``.

        Only methods that are there are meant. The table is a bounded list of a framework's fixed dispatches.
        """
        k = contracts.select(*[F.lower(c).alias(c) if c not in ("receiver", "note") else F.col(c) for c in ("caller_class", "caller_method", "receiver", "callee", "target_class", "note")])
        f = self.functions().select(F.col("id").alias("fn_id"), F.col("class").alias("caller_class"), F.col("low").alias("caller_method"))
        c = self.calls.where("how = 'method'").select("repo_id", F.col("id").alias("call_id"), "fn_id", "receiver", "callee").join(f, "fn_id").drop("fn_id")
        c = c.join(self.targets().select("call_id"), "call_id", "left_anti").join(F.broadcast(k), ["caller_class", "caller_method", "receiver", "callee"])
        c = self.store.cut(c.select("repo_id", "call_id", F.col("target_class").alias("class"), F.col("callee").alias("low"), "note"))
        return c.join(self.owners(c).drop("distance"), ["repo_id", "class", "low"]).select("call_id", "fn_id", "note").distinct()

    # -- values -------------------------------------------------------------------------------------------------------
    def value_edges(self, targets: DataFrame) -> DataFrame:
        """(src, dst, tag) of all values: inside scopes, through calls and through shared storage."""
        e = self.rows("edges")
        # what an unknown call may pass on is dropped where the call is known
        loose = e.where("tag = 'unresolved'").join(targets.select(F.col("call_id").alias("dst")), "dst", "left_anti").select("src", "dst", "tag")
        sure = e.where("tag <> 'unresolved'").select("src", "dst", "tag")
        args = self.calls.select(F.col("id").alias("call_id"), F.explode("args").alias("a")).select("call_id", "a.at", "a.name", F.col("a.value_id").alias("src"))
        params = self.rows("functions").select(F.col("id").alias("fn_id"), F.explode("params").alias("p")).select("fn_id", F.col("p.name").alias("pname"), F.col("p.at").alias("pat"), F.col("p.value_id").alias("dst"))
        bound = args.join(targets, "call_id").join(params, "fn_id").where(F.when(F.col("name").isNotNull(), F.lower("name") == F.lower("pname")).otherwise(F.col("at") == F.col("pat")))
        bound = bound.select("src", "dst", F.lit("argument").alias("tag"))
        back = self.rows("returns").select("fn_id", F.col("value_id").alias("src")).join(targets, "fn_id").select("src", F.col("call_id").alias("dst"), F.lit("return").alias("tag"))
        cells = self.rows("cells").select("repo_id", "kind", "name", "value_id", "written")
        # all writes of a cell lead to its first read and from there to the others: writes plus reads, not their product
        r = cells.where("NOT written").select("repo_id", "kind", "name", F.col("value_id").alias("dst"))
        first = r.groupBy("repo_id", "kind", "name").agg(F.min("dst").alias("first"))
        w = cells.where("written").select("repo_id", "kind", "name", F.col("value_id").alias("src")).join(first, ["repo_id", "kind", "name"])
        shared = w.select("src", F.col("first").alias("dst"), F.col("kind").alias("tag")).unionAll(r.join(first, ["repo_id", "kind", "name"]).where("first <> dst").select(F.col("first").alias("src"), "dst", F.col("kind").alias("tag")))
        # what a parameter by reference holds in the end goes back to the argument
        outs, afters = self.rows("outs").select("fn_id", F.col("at").alias("pat"), F.col("name").alias("pname"), F.col("value_id").alias("src")), self.rows("afters").select("call_id", "at", "name", F.col("value_id").alias("dst"))
        effects = afters.join(targets, "call_id").join(outs, "fn_id").where(F.when(F.col("name").isNotNull(), F.lower("name") == F.lower("pname")).otherwise(F.col("at") == F.col("pat"))).select("src", "dst", F.lit("effect").alias("tag"))
        shared = shared.unionAll(effects)
        return self.store.cut(sure.unionAll(loose).unionAll(bound).unionAll(back).unionAll(shared).distinct())

    def parameters(self) -> DataFrame:
        """Parameters of public methods and functions as sources, for code that is a library."""
        fn = self.functions().where("kind <> 'closure' AND visibility = 'public' AND (NOT startswith(low, '__') OR low = '__construct')").select("file_id", F.col("id").alias("fn_id"), "name", "start_line", F.explode("params").alias("p"))
        return fn.select("file_id", F.col("p.value_id").alias("id"), "fn_id", F.concat(F.lit("$"), "p.name", F.lit(" of "), "name").alias("origin"), F.lit("library_parameter").alias("kind"), F.col("start_line").alias("line"))

    def origins(self, library: bool = False) -> DataFrame:
        s = self.rows("sources").select("file_id", "id", "fn_id", "origin", "kind", "line")
        return s.unionByName(self.parameters()) if library else s

    def taint(self, edges: DataFrame, origins: DataFrame | None = None) -> DataFrame:
        """(node, origin_id, hops, certain): source values that reach each value; certain if no unknown call is on some way."""
        # One fixpoint for both: a value is two nodes, reached surely (odd) or over an unknown call (even).
        start = (self.rows("sources") if origins is None else origins).select((F.col("id") * 2 + 1).alias("node"), F.col("id").alias("origin_id")).distinct()
        a, b, sure = F.col("src") * 2, F.col("dst") * 2, F.col("tag") != "unresolved"
        both = edges.where(sure).select((a + 1).alias("src"), (b + 1).alias("dst")).unionAll(edges.select(a.alias("src"), b.alias("dst"))).unionAll(edges.where(~sure).select((a + 1).alias("src"), b.alias("dst")))
        t = graph.propagate(start, both, ["origin_id"]).groupBy(F.shiftright("node", 1).alias("node"), "origin_id")
        return self.store.cut(t.agg(F.min("hops").alias("hops"), F.max(F.col("node") % 2 == 1).alias("certain")))

    def sink_arguments(self, category, targets: DataFrame) -> DataFrame:
        """Calls of built-in sinks with the argument that counts: by its name where it is named, else by its place.

        A call that means a function of the repository is no call of the built-in. Of a call that runs a callback the
        callback counts, and as dynamic only if it is not fixed.
        """
        c = self.calls.where("how IN ('function', 'include')").withColumn("category", F.when(F.col("callee").isin(*DESERIALIZERS), "DESERIALIZATION").otherwise(category(F.col("callee")))).where("category IS NOT NULL")
        c = c.where("category <> 'DYNAMIC_INVOCATION' OR callback IS NULL OR callback = 'dynamic' OR startswith(callback, 'property:')").withColumnRenamed("id", "call_id").join(targets.select("call_id"), "call_id", "left_anti")
        wanted = F.when(F.col("sink_name").isin("hash_file", "hash_hmac_file"), F.array(F.lit(1))).when(F.col("sink_name").isin("copy", "rename"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        arg = c.select("file_id", "repo_id", "path", "call_id", "fn_id", "class_name", F.col("callee").alias("sink_name"), "category", "restricted", "guards", "guards_cut", F.col("start_line").alias("line"), F.col("start_col").alias("col"), "text", F.explode("args").alias("a"))
        return arg.where(F.array_contains(wanted, F.col("a.place"))).withColumn("sink_argument", F.col("a.place")).withColumn("prefix", F.col("a.prefix")).withColumn("node", F.col("a.value_id")).drop("a")

    def inventory(self, category, library: bool = False, php_version: str | None = None) -> DataFrame:
        """Every sink call with its argument, whether source values reach it, and the first disposition that applies."""
        targets = self.targets()
        arg = self.store.cut(self.sink_arguments(category, targets))
        origins = self.store.cut(self.origins(library))
        t = self.taint(self.value_edges(targets), origins)
        t = t.join(arg.select("node"), "node", "left_semi").join(origins.select(F.col("id").alias("origin_id"), "kind", "origin", F.col("line").alias("origin_line")), "origin_id")
        best = F.struct(F.col("kind") != "request", ~F.col("certain"), "hops", "origin_id")
        got = t.groupBy("node").agg(F.min_by(F.struct("hops", "origin_id", "kind", "origin", "origin_line"), best).alias("m"), F.max("certain").alias("certain"), F.count("*").alias("origins")).select("node", "m.*", "certain", "origins")
        out = arg.join(got, "node", "left")
        archive = F.col("category") == "PHAR_TRIGGER"
        fixed = F.lower("prefix")
        local = fixed.isNotNull() & ~F.startswith(fixed, F.lit("phar://")) & ~F.startswith(F.lit("phar://"), fixed)
        reached = F.col("origins").isNotNull()
        what = (
            F.when(archive & local, "fixed_path").when(reached & F.col("restricted"), "restricted_options").when(reached & (F.col("kind") == "framework_request"), "modeled_framework_request").when(reached & (F.col("kind") == "persistent_data"), "persistent_data")
            .when(reached & (F.col("kind") == "library_parameter"), "conditional_library_api").when(reached & F.col("certain"), "proven_route").when(reached, "conditional_route").when(F.col("restricted"), "restricted_options")
        )
        if php_version is not None and tuple(int(x) for x in php_version.split(".")) >= (8, 0):
            what = what.when(archive, "inactive_for_version")
        what = what.when(archive & F.startswith(fixed, F.lit("phar://")), "fixed_archive_path").otherwise("no_modeled_source")
        return out.withColumn("scope", paths.scope(F.col("path"))).withColumn("disposition", what).drop("node")

    # -- call graph ---------------------------------------------------------------------------------------------------
    def call_graph(self, category) -> DataFrame:
        """(repo_id, src, dst, edge_type, confidence, call_id) between methods, functions and sinks; one row per call and target.

        Conversions to text and reads of typed members lead to __toString and __get without a call, so without call_id.
        """
        fn = self.functions()
        name = F.concat(F.col("repo_id").cast("string"), F.lit(":"), F.when(F.col("class").isNotNull(), F.concat("class", F.lit("::"), "low")).otherwise(F.col("low")))
        node = self.store.cut(fn.where("kind <> 'closure'").select("repo_id", F.col("id").alias("fn_id"), name.alias("node"), "class", "low", "namespace", "kind"))
        src = node.select("fn_id", F.col("node").alias("src"), "namespace", F.col("class").alias("own"))
        calls = self.calls.select("repo_id", F.col("id").alias("call_id"), "fn_id", "how", "callee", "callback", "receiver", (F.col("receiver_class").isNotNull() & ~F.col("receiver_exact") & (F.col("receiver") != "$this")).alias("declared"), "receiver_class").join(src, "fn_id")
        # what is only declared may be a class below, so it is no direct call
        targets = self.targets().join(calls.where("how = 'method' AND declared").select("call_id"), "call_id", "left_anti")
        row = lambda kind: [F.lit(kind).alias("edge_type"), F.lit(CONFIDENCE[kind]).alias("confidence")]
        direct = calls.join(targets.select("call_id", F.col("fn_id").alias("to")), "call_id").join(node.select(F.col("fn_id").alias("to"), F.col("node").alias("dst")), "to")
        direct = direct.select("repo_id", "src", "dst", F.when(F.col("how") == "static", "static").otherwise("direct").alias("edge_type"), F.lit(1.0).alias("confidence"), "call_id")
        open_ = calls.where("how = 'method'").join(targets.select("call_id"), "call_id", "left_anti")
        magic = open_.where("receiver = '$this'").join(node.where("low = '__call'").select("repo_id", F.col("class").alias("own"), F.col("node").alias("dst")), ["repo_id", "own"]).select("repo_id", "src", "dst", *row("magic_call"), "call_id")
        owned = node.where("kind = 'method'").select("repo_id", "namespace", F.col("low").alias("callee"), F.col("node").alias("dst")).distinct()
        prop = open_.where("receiver LIKE '$this->%' AND NOT declared").join(owned, ["repo_id", "namespace", "callee"]).select("repo_id", "src", "dst", *row("property"), "call_id")
        # a declared parameter type: the class itself and everything below it that has the method
        below = self.descendants()
        methods = node.where("kind = 'method'").select("repo_id", "class", F.col("low").alias("callee"), F.col("node").alias("dst"))
        hint = self.rows("functions").select(F.col("id").alias("fn_id"), F.explode("params").alias("p")).select("fn_id", F.concat(F.lit("$"), "p.name").alias("receiver"), F.lower(F.regexp_replace("p.type", r"^[?\\\\]+", "")).alias("hint")).where("hint <> ''")
        wide = below.select("repo_id", F.col("up").alias("hint"), "class").unionAll(node.where("class IS NOT NULL").select("repo_id", F.col("class").alias("hint"), "class")).distinct()
        # hints are short or full names; a short one stands for a class of the caller's namespace
        hint = hint.select("fn_id", "receiver", "hint").unionAll(open_.where("declared AND receiver LIKE '$this->%'").select("fn_id", "receiver", F.col("receiver_class").alias("hint"))).distinct()
        typed = open_.join(hint, ["fn_id", "receiver"]).withColumn("hint", F.when(F.contains("hint", F.lit("\\")) | (F.col("namespace") == "") | F.col("namespace").isNull(), F.col("hint")).otherwise(F.concat("namespace", F.lit("\\"), "hint")))
        typed = typed.join(wide, ["repo_id", "hint"]).join(methods, ["repo_id", "class", "callee"]).select("repo_id", "src", "dst", "call_id").distinct()
        many = typed.groupBy("call_id").agg(F.count("*").alias("n"))
        one = F.col("n") == 1
        typed = typed.join(many, "call_id").select("repo_id", "src", "dst", F.when(one, "typed_one").otherwise("typed_many").alias("edge_type"), F.when(one, CONFIDENCE["typed_one"]).otherwise(CONFIDENCE["typed_many"]).alias("confidence"), "call_id")
        # $this->m() may run the method of a class below
        virtual = calls.where("how = 'method' AND receiver = '$this'").join(below.select("repo_id", F.col("up").alias("own"), "class"), ["repo_id", "own"]).join(methods, ["repo_id", "class", "callee"]).select("repo_id", "src", "dst", *row("override"), "call_id")
        sinks = calls.where("how IN ('function', 'include') AND (callback IS NULL OR callback = 'dynamic' OR startswith(callback, 'property:'))").join(targets.select("call_id"), "call_id", "left_anti").withColumn("c", F.when(F.col("callee").isin(*DESERIALIZERS), "DESERIALIZATION").otherwise(category(F.col("callee")))).where("c IS NOT NULL")
        sinks = sinks.select("repo_id", "src", F.concat(F.col("repo_id").cast("string"), F.lit(":SINK::"), "callee").alias("dst"), *row("sink"), "call_id")
        # the declared class and everything below it, with the method that each has or inherits
        known = self.rows("classes").select("repo_id", F.lower("name").alias("class")).distinct()
        under = self.store.cut(below.select("repo_id", F.col("up").alias("hint"), "class").unionAll(known.select("repo_id", F.col("class").alias("hint"), "class")).distinct())
        touch = self.rows("implicit").where("type IS NOT NULL").select("repo_id", "fn_id", F.col("method").alias("low"), F.col("type").alias("hint")).distinct()
        touch = self.store.cut(touch.join(src.select("fn_id", "src"), "fn_id").join(under, ["repo_id", "hint"]))
        owner = self.owners(touch).select("repo_id", "class", "low", F.col("fn_id").alias("to")).join(node.select(F.col("fn_id").alias("to"), F.col("node").alias("dst")), "to")
        touch = touch.join(owner, ["repo_id", "class", "low"]).select("repo_id", "src", "fn_id", "hint", "low", "dst").distinct()
        few = touch.groupBy("fn_id", "hint", "low").agg((F.count("*") == 1).alias("one"))
        sure = F.when(F.col("one"), CONFIDENCE["typed_one"]).otherwise(CONFIDENCE["typed_many"])
        touch = touch.join(few, ["fn_id", "hint", "low"]).groupBy("repo_id", "src", "dst", F.when(F.col("low") == "__get", "magic_get").otherwise("magic_tostring").alias("edge_type")).agg(F.max(sure).alias("confidence")).withColumn("call_id", F.lit(None).cast("bigint"))
        return direct.unionByName(magic).unionByName(touch).unionByName(prop).unionByName(typed).unionByName(virtual).unionByName(sinks)

    def chains(self, edges: DataFrame, depth: int = 6, budget: int | None = None) -> DataFrame:
        """Paths from restored objects' entry methods to sinks, with a level of confidence by the weakest link.

        A chain has at most ``depth`` calls and the link to its sink; ``complete`` is false on the chains of an entry method
        from which a longer one was left.
        """
        e = self.store.cut(edges)
        held = self.store.cut(self.entry_methods())
        entry = held.select("node").distinct()
        sink = e.where("edge_type = 'sink'").select(F.col("dst").alias("node")).distinct()
        p = graph.simple_paths(e, entry, sink, depth + 1, budget, mark_depth=True)
        p = p.withColumn("node", F.element_at("path", 1)).join(held, "node")
        touched = self.rows("implicit").select("fn_id", F.regexp_extract("receiver", r"^\$this->(\w+)", 1).alias("property")).where("property <> ''")
        touched = touched.join(self.nodes().select("fn_id", F.col("node").alias("at")), "fn_id").groupBy("at").agg(F.collect_set("property").alias("ps"))
        props = p.select("entry", "path", F.explode("path").alias("at")).join(touched, "at").groupBy("entry", "path").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ps")))).alias("properties"))
        p = p.join(props, ["entry", "path"], "left")
        level = F.when(F.col("confidence") >= 0.9, "HIGH").when(F.col("confidence") >= 0.7, "MEDIUM").otherwise("LOW")
        return p.select(F.substring(F.sha2(F.concat_ws(">", F.array("entry"), "path"), 256), 1, 12).alias("chain_id"), "entry", F.element_at("path", -1).alias("sink"), F.size("path").alias("length"), level.alias("level"), "path", F.coalesce("properties", F.array().cast("array<string>")).alias("properties"), "complete")

    def nodes(self) -> DataFrame:
        """(repo_id, fn_id, node) of methods and functions."""
        name = F.concat(F.col("repo_id").cast("string"), F.lit(":"), F.when(F.col("class").isNotNull(), F.concat("class", F.lit("::"), "low")).otherwise(F.col("low")))
        return self.functions().where("kind <> 'closure'").select("repo_id", F.col("id").alias("fn_id"), name.alias("node"))

    def entry_methods(self) -> DataFrame:
        """(entry, node): for each class that can be made, the method that runs for each way in, its own or the nearest that it inherits."""
        concrete = self.rows("classes").where("kind = 'class' AND NOT abstract").select("repo_id", F.lower("name").alias("class")).distinct()
        wanted = concrete.select("*", F.explode(F.array(*[F.lit(x) for x in ENTRIES])).alias("low"))
        got = self.owners(wanted).join(self.nodes().drop("repo_id"), "fn_id")
        return got.select(F.concat(F.col("repo_id").cast("string"), F.lit(":"), "class", F.lit("::"), "low").alias("entry"), "node").distinct()

    def outline(self, chains: DataFrame) -> DataFrame:
        """Chains as text, a line a step, indented by its place."""
        line = F.transform("path", lambda x, i: F.concat(F.repeat(F.lit("  "), i), F.regexp_replace(x, r"^\d+:(?:SINK::)?", "")))
        return chains.select("chain_id", F.array_join(line, "\n").alias("outline"))

    def sites(self) -> DataFrame:
        """Deserialization calls with the classes that their options let through: deny, allow, allowlist or unknown."""
        c = self.calls.where(F.col("callee").isin(*DESERIALIZERS) & (F.col("how") == "function"))
        opts = F.filter("args", lambda a: (a["name"] == "options") | (a["name"].isNull() & (a["at"] == 1)))
        text = F.try_element_at(F.transform(opts, lambda a: a["text"]), F.lit(1))
        names = F.transform(F.regexp_extract_all(text, F.lit(r"[\"']?([\w\\\\]+?)(?:[\"']|::class)"), F.lit(1)), lambda x: F.lower(F.regexp_replace(F.regexp_replace(x, r"^\\+", ""), r"\\{2,}", r"\\")))
        names = F.filter(names, lambda x: x != "allowed_classes")
        policy = F.when(F.col("restricted"), "deny").when(text.isNull() | text.rlike(r"allowed_classes[\"']\s*=>\s*true"), "allow").when(text.rlike(r"allowed_classes[\"']\s*=>\s*(\[|array\()"), "allowlist").otherwise("unknown")
        return c.select("file_id", "repo_id", "path", F.col("id").alias("call_id"), "callee", F.col("start_line").alias("line"), policy.alias("policy"), F.when(policy == "allowlist", names).alias("classes"))

    def chain_sites(self, chains: DataFrame) -> DataFrame:
        """Chains with the sites of their repository whose options let the entry class through, counted by policy."""
        c = chains.withColumn("repo_id", F.substring_index("entry", ":", 1).cast("int")).withColumn("class", F.regexp_extract("entry", r"^\d+:(.*)::", 1))
        s = self.sites().groupBy("repo_id", "policy", "classes").agg(F.count("*").alias("n"), F.min(F.struct("path", "line")).alias("first"))
        fits = F.when(F.col("policy") == "deny", False).when(F.col("policy") == "allowlist", F.array_contains("classes", F.col("class"))).otherwise(True)
        j = c.join(s, "repo_id", "left").withColumn("fits", F.coalesce(fits, F.lit(False)))
        return j.groupBy("chain_id").agg(F.coalesce(F.sum(F.when(F.col("fits"), F.col("n"))), F.lit(0)).alias("compatible"), F.coalesce(F.sum(F.when(~F.col("fits"), F.col("n"))), F.lit(0)).alias("excluded"), F.min(F.when(F.col("fits"), F.col("first"))).alias("first"))

    def includes(self) -> DataFrame:
        """Includes with the path they name, constants of the directory folded, and the file there if it is in the set."""
        c = self.calls.where("how = 'include'").select("file_id", "repo_id", "path", F.col("id").alias("call_id"), F.col("callee").alias("kind"), "start_line", F.get("args", F.lit(0))["text"].alias("text"))
        body = F.regexp_replace("text", r"^(?:include|require)(?:_once)?\s*\(?\s*|\s*\)?\s*$", "")
        folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
        here = F.regexp_extract(body, r"^(?:__DIR__|dirname\(__FILE__\))\s*\.\s*['\"]([^'\"$]*)['\"]$", 1)
        plain = F.regexp_extract(body, r"^['\"]([^'\"$]*)['\"]$", 1)
        target = F.when(here != "", F.concat(folder, here)).when(plain != "", plain)
        # one step up at a time, as often as a path of this length can need
        norm = F.aggregate(F.split(target, "/"), F.array().cast("array<string>"), lambda acc, x: F.when(x.isin("", "."), acc).when((x == "..") & (F.size(acc) > 0), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))))
        c = c.withColumn("target", F.when(target.isNotNull(), F.array_join(norm, "/"))).withColumn("anchored", here != "")
        f = self.facts.select("repo_id", F.col("path").alias("target"), F.col("file_id").alias("target_id"))
        return c.join(f, ["repo_id", "target"], "left").select("file_id", "call_id", "kind", "start_line", "target", "anchored", "target_id")

    def session_dispatch(self, most: int = 24) -> DataFrame:
        """Method calls on a session value that a deserialization filled, with the classes of the repository that have the method."""
        key = r"^\$_SESSION\[['\"](\w+)['\"]\]"
        cells = self.calls.select("repo_id", "file_id", F.col("id").alias("call_id"), "callee", "receiver", "replaced", "start_line", "text")
        stores = self.rows("sessions").select("repo_id", F.col("file_id").alias("store_file"), "key", F.col("line").alias("store_line"))
        use = cells.where(F.col("receiver").rlike(key) & ~F.col("replaced")).withColumn("key", F.regexp_extract("receiver", key, 1))
        m = self.functions().where("kind = 'method' AND visibility = 'public'").groupBy("repo_id", F.col("low").alias("callee")).agg(F.slice(F.array_sort(F.collect_set("class")), 1, most).alias("classes"), F.count_distinct("class").alias("total"))
        n = stores.groupBy("repo_id", "key").agg(F.count("*").alias("stores"), F.min(F.struct("store_file", "store_line")).alias("first"))
        return use.join(n, ["repo_id", "key"]).join(m, ["repo_id", "callee"], "left").select("repo_id", "file_id", "start_line", "key", "callee", "stores", "first", "classes", F.coalesce("total", F.lit(0)).alias("total"), (F.coalesce("total", F.lit(0)) > most).alias("truncated"))

    def stored_columns(self) -> DataFrame:
        """Columns read and written by SQL in string arguments: (table, column, access, call_id)."""
        a = self.calls.select("repo_id", "file_id", F.col("id").alias("call_id"), "start_line", F.explode("args").alias("a")).select("repo_id", "file_id", "call_id", "start_line", F.lower("a.text").alias("t"))
        read = a.where(F.col("t").rlike(r"^[\"']\s*select\s")).select("*", F.regexp_extract("t", r"\sfrom\s+[`{]?(\w+)", 1).alias("table"), F.explode(F.split(F.regexp_extract("t", r"(?s)select\s+(.*?)\s+from\s", 1), r"\s*,\s*")).alias("column"), F.lit("read").alias("access"))
        put = a.where(F.col("t").rlike(r"^[\"']\s*insert\s+into\s")).select("*", F.regexp_extract("t", r"insert\s+into\s+[`{]?(\w+)", 1).alias("table"), F.explode(F.split(F.regexp_extract("t", r"\(([^()]*)\)\s*values", 1), r"\s*,\s*")).alias("column"), F.lit("write").alias("access"))
        both = read.unionByName(put).withColumn("column", F.regexp_replace("column", r"[`\s]|^\w+\.", ""))
        return both.where("table <> '' AND column <> ''").select("repo_id", "file_id", "call_id", "start_line", "table", "column", "access")

    def coverage(self) -> DataFrame:
        """Calls per file that have a known target, a category of their own, or neither."""
        t = self.targets().select("call_id", F.lit(1).alias("known"))
        c = self.calls.select("file_id", "path", F.col("id").alias("call_id"), "how").join(t, "call_id", "left")
        return c.groupBy("file_id", "path").agg(F.count("*").alias("calls"), F.count("known").alias("resolved"), F.count_if(F.col("known").isNull() & (F.col("how") == "method")).alias("unresolved_methods"))

    def finding_coverage(self, found: DataFrame, modeled: list[str]) -> DataFrame:
        """What a finding depends on: the scopes of its sink and origin and all functions that are called from them, over known calls.

        ``found(finding_id, file_id, fn_id, origin_id)``. Files, those of them with errors, and calls without a known target that
        are not ``modeled``: all counted, the first 32 listed.
        """
        key = ["finding_id", "file_id"]
        calls = self.calls.where("how IN ('function', 'method', 'static')").select(F.col("file_id").alias("at"), "path", F.col("id").alias("call_id"), F.col("fn_id").alias("node"), "how", "callee", "start_line", "start_col")
        calls = self.store.cut(calls.join(self.targets().select("call_id", F.col("fn_id").alias("to")), "call_id", "left"))
        found = self.store.cut(found)
        origin = found.join(self.rows("sources").select(F.col("id").alias("origin_id"), F.col("fn_id").alias("node")), "origin_id").select("node", *key)
        start = found.select(F.col("fn_id").alias("node"), *key).unionByName(origin).distinct()
        scopes = graph.propagate(start, calls.where("to IS NOT NULL").select(F.col("node").alias("src"), F.col("to").alias("dst")), key)
        file = self.facts.select(F.col("file_id").alias("at"), "path", (F.size("errors") > 0).alias("failed"))
        # the id of a scope begins with its file's
        files = scopes.withColumn("at", F.shiftright("node", SCOPE_BITS)).join(file, "at").groupBy(*key).agg(F.countDistinct("node").alias("scopes"), F.array_sort(F.collect_set("path")).alias("files"), F.array_sort(F.collect_set(F.when(F.col("failed"), F.col("path")))).alias("fallback_files"))
        static = (F.col("how") == "function") & F.col("callee").isNotNull()
        kind = F.when(static, "external_or_missing_function").otherwise("unresolved_dispatch")
        open_ = calls.where(F.col("to").isNull() & ~(static & F.coalesce(F.col("callee"), F.lit("")).isin(*modeled))).select("node", F.struct("path", "start_line", "start_col", "callee", kind.alias("kind")).alias("c"))
        open_ = scopes.join(open_, "node").select(*key, "c")
        w = W.partitionBy(*key).orderBy("c")
        open_ = open_.withColumn("n", F.row_number().over(w)).groupBy(*key).agg(F.count("*").alias("unresolved"), F.array_sort(F.collect_list(F.when(F.col("n") <= 32, F.col("c")))).alias("unresolved_calls"))
        out = files.join(open_, key, "left").withColumn("unresolved", F.coalesce("unresolved", F.lit(0)))
        return out.select(*key, "scopes", "files", "fallback_files", "unresolved", "unresolved_calls", (F.col("unresolved") > 32).alias("unresolved_truncated"))

    def dispatch_sinks(self, uses: DataFrame, edges: DataFrame, category, depth: int = 4) -> DataFrame:
        """``session_dispatch`` with the sinks of the call graph at most ``depth`` links from any class's method, and whether ways go on behind them."""
        e = self.store.cut(edges.select("src", "dst").distinct())
        m = self.functions().where("kind = 'method' AND visibility = 'public'").select("repo_id", F.col("low").alias("callee"), F.concat(F.col("repo_id").cast("string"), F.lit(":"), "class", F.lit("::"), "low").alias("node")).distinct()
        level = self.store.cut(uses.select("repo_id", "callee").distinct().join(m, ["repo_id", "callee"]))
        parts = [level]
        for _ in range(depth):
            step = level.join(e.withColumnRenamed("src", "node"), "node").select("repo_id", "callee", F.col("dst").alias("node")).distinct()
            level = self.store.cut(step.join(self.store.union(parts), ["repo_id", "callee", "node"], "left_anti"))
            parts.append(level)
        name = F.regexp_extract("node", r"^\d+:SINK::(.*)$", 1)
        kinds = ("RCE", "DYNAMIC_INVOCATION", "FILE_WRITE", "FILE_DELETE", "FILE_READ_INCLUDE")
        got = self.store.union(parts).withColumn("sink", name).where("sink <> ''").where(category(F.col("sink")).isin(*kinds)).groupBy("repo_id", "callee").agg(F.array_sort(F.collect_set("sink")).alias("sinks"))
        more = level.join(e.select(F.col("src").alias("node")), "node", "left_semi").select("repo_id", "callee").distinct().withColumn("deeper", F.lit(True))
        out = uses.join(got, ["repo_id", "callee"], "left").join(more, ["repo_id", "callee"], "left")
        return out.withColumn("sinks", F.coalesce("sinks", F.array().cast("array<string>"))).withColumn("deeper", F.coalesce("deeper", F.lit(False)))

    # -- evidence -----------------------------------------------------------------------------------------------------
    def assessed(self, inventory: DataFrame) -> DataFrame:
        """Reached sinks with the level of evidence, what limits it, and how far that goes."""
        kind, sure = F.col("kind"), F.col("certain")
        level = (
            F.when(kind.isin("request") & sure, "observed_source_flow").when(kind.isin("framework_request") & sure, "modeled_source_flow").when(kind == "persistent_data", "assumed_persistent_flow")
            .when((kind == "library_parameter") & sure, "assumed_api_flow").otherwise("unresolved_flow")
        )
        limits = F.array_sort(F.array_compact(F.array(
            F.when(~sure, "unresolved_propagation"), F.when(F.size("guards") > 0, "guard_not_proven"), F.when(F.col("guards_cut"), "guards_cut"), F.when(kind == "library_parameter", "external_caller_assumed"),
            F.when(kind == "framework_request", "framework_source_modeled"), F.when(kind == "persistent_data", "persistent_write_unverified"),
        )))
        direct = (F.col("category") == "DESERIALIZATION") & (F.col("level") == "observed_source_flow") & (F.size("limitations") == 0)
        i = inventory.where("origins IS NOT NULL AND disposition NOT IN ('restricted_options', 'fixed_path')").withColumn("level", level).withColumn("limitations", limits)
        return i.withColumn("detection", F.when(direct, "direct_untrusted_deserialization").otherwise("conditional_path")).withColumn("completeness", F.when(F.size("limitations") > 0, "limited").otherwise("within_model"))

    def stored_links(self, most: int = 16) -> DataFrame:
        """(read_id, write_id, table, column, rank, total): writes of the column that a query reads, in any file of the repository; ``most`` of each read with the uncapped count."""
        c = self.store.cut(self.stored_columns())
        r = c.where("access = 'read'").select("repo_id", "table", "column", F.col("call_id").alias("read_id"))
        w = c.where("access = 'write'").select("repo_id", "table", "column", F.col("call_id").alias("write_id")).distinct()
        total = w.groupBy("repo_id", "table", "column").agg(F.count("*").alias("total"))
        best = w.withColumn("rank", F.row_number().over(W.partitionBy("repo_id", "table", "column").orderBy("write_id"))).where(F.col("rank") <= most)
        return r.join(best, ["repo_id", "table", "column"]).join(total, ["repo_id", "table", "column"]).select("read_id", "write_id", "table", "column", "rank", "total")

    def route_evidence(self, inventory: DataFrame, chains: DataFrame, dispatch: DataFrame) -> DataFrame:
        """Routes of four kinds with status and missing links: source to sink, stored column, gadget chain, session dispatch."""
        none = F.array().cast("array<string>")
        gone = F.array_compact(F.array(F.when(~F.col("certain"), F.lit("unresolved_data_propagation")), F.when(F.col("kind") == "library_parameter", F.lit("external_caller")), F.when(F.col("kind") == "framework_request", F.lit("framework_runtime_binding")), F.when(F.size("guards") > 0, F.lit("guard_feasibility"))))
        flow = self.assessed(inventory).withColumn("missing", gone)
        flow = flow.select(paths.identity(F.lit("flow"), F.col("path"), F.col("line"), F.col("col"), F.col("sink_argument")).alias("route_id"), F.lit("source_to_sink").alias("kind"), F.when(~F.col("certain"), "unknown").when(F.size("missing") > 0, "conditional").otherwise("proven").alias("status"), "missing", "path", "line")
        at = self.calls.select("path", F.col("start_line").alias("line"), F.col("id").alias("read_id"))
        kept = self.stored_links().join(at, "read_id").select(paths.identity(F.lit("store"), F.col("read_id"), F.col("write_id"), F.col("column")).alias("route_id"), F.lit("candidate_persistent_store").alias("kind"), F.lit("conditional").alias("status"), F.array(F.lit("write_read_identity_and_order"), F.lit("write_authorization")).alias("missing"), "path", "line")
        held = self.store.cut(chains)
        s = held.select("chain_id", "level").join(self.chain_sites(held), "chain_id")
        lost = F.array_compact(F.array(F.when(F.col("compatible") == 0, F.lit("deserialization_site")), F.when(F.col("level") != "HIGH", F.lit("receiver_type"))))
        gadget = s.select(paths.identity(F.lit("chain"), F.col("chain_id")).alias("route_id"), F.lit("candidate_gadget").alias("kind"), F.when(F.col("compatible") > 0, "conditional").otherwise("unknown").alias("status"), lost.alias("missing"), F.col("first.path").alias("path"), F.col("first.line").alias("line"))
        file = self.facts.select("file_id", "path")
        d = dispatch.where("size(sinks) > 0").join(file, "file_id")
        late = F.array_compact(F.array(F.lit("session_identity_and_request_order"), F.lit("object_class_and_properties"), F.when(F.col("truncated"), F.lit("dispatch_candidates_unexamined")), F.when(F.col("deeper"), F.lit("dispatch_sink_search_truncated"))))
        session = d.select(paths.identity(F.lit("session"), F.col("file_id"), F.col("start_line"), F.col("key"), F.col("callee")).alias("route_id"), F.lit("candidate_session_dispatch").alias("kind"), F.lit("conditional").alias("status"), late.alias("missing"), "path", F.col("start_line").alias("line"))
        return flow.unionByName(kept).unionByName(gadget).unionByName(session).withColumn("missing", F.coalesce("missing", none)).dropDuplicates(["route_id"])

    # -- class loading ------------------------------------------------------------------------------------------------
    def include_index(self) -> DataFrame:
        """(repo_id, target_id, includers): the files that include each file, and whether one does so without a condition."""
        i = self.includes().where("target_id IS NOT NULL").join(self.calls.select(F.col("id").alias("call_id"), "conditional", "repo_id"), "call_id")
        return i.groupBy("repo_id", "target_id").agg(F.array_sort(F.collect_set("file_id")).alias("includers"), F.bool_or(~F.col("conditional")).alias("always"))

    def entrypoints(self) -> DataFrame:
        """(file_id, entry_id): the files that no other includes from which each file is reached by includes; itself if none includes it."""
        i = self.includes().where("target_id IS NOT NULL AND target_id <> file_id").select(F.col("target_id").alias("src"), F.col("file_id").alias("dst")).distinct()
        i = self.store.cut(i)
        f = self.facts.select("file_id")
        roots = self.store.cut(f.join(i.select(F.col("src").alias("file_id")), "file_id", "left_anti"))
        far = hierarchy.reach(i, roots.select(F.col("file_id").alias("id"))).where("dst IS NOT NULL")
        return far.select(F.col("src").alias("file_id"), F.col("dst").alias("entry_id")).unionAll(roots.select("file_id", F.col("file_id").alias("entry_id"))).distinct()

    def session_starts(self) -> DataFrame:
        """Files that start a session at their top level and without a condition; a function of that name in the repository is no start."""
        c = self.calls.where("how = 'function' AND callee = 'session_start' AND NOT conditional").withColumnRenamed("id", "call_id")
        return c.join(self.targets().select("call_id"), "call_id", "left_anti").groupBy("file_id").agg(F.min("start_line").alias("line"))

    def bootstraps(self) -> DataFrame:
        """Per file its entry points, how many of them start a session, and whether any does."""
        e = self.entrypoints()
        s = self.session_starts().select(F.col("file_id").alias("entry_id"), F.lit(True).alias("starts"))
        g = e.join(s, "entry_id", "left").groupBy("file_id")
        return g.agg(F.count("*").alias("entries"), F.count("starts").alias("starting"), F.array_sort(F.collect_set(F.when(F.col("starts"), F.col("entry_id")))).alias("starting_entries"))

    def entry_status(self) -> DataFrame:
        """Per file that must be included (it tests a constant at its top): included if some file defines the constant and reaches it, else unknown; others are direct."""
        guard = self.facts.select("file_id", "repo_id", F.explode_outer("entry_guards").alias("constant"))
        defines = self.calls.where("how = 'function' AND callee = 'define'").select("repo_id", F.col("file_id").alias("by"), F.regexp_extract(F.get("args", F.lit(0))["text"], r"^['\"](\w+)['\"]$", 1).alias("constant"))
        i = self.includes().where("target_id IS NOT NULL").select(F.col("file_id").alias("by"), F.col("target_id").alias("file_id")).distinct()
        near = i.join(defines, "by").select("file_id", "repo_id", "constant", "by")
        g = guard.join(near, ["file_id", "repo_id", "constant"], "left").groupBy("file_id").agg(F.max("constant").alias("constant"), F.count("by").alias("n"))
        return g.select("file_id", "constant", F.when(F.col("constant").isNull(), "direct").when(F.col("n") > 0, "included").otherwise("unknown").alias("status"))

    # -- control flow -------------------------------------------------------------------------------------------------
    def flow_graph(self) -> tuple[DataFrame, DataFrame]:
        """(blocks, steps) with a node id of its own for each statement of each scope."""
        at = lambda c: F.concat_ws(":", "fn_id", c)
        b = self.rows("blocks").select("file_id", "fn_id", at("node").alias("node"), F.col("node").alias("offset"), "line", "kind", "writes")
        return b, self.rows("steps").select("fn_id", at("src").alias("src"), at("dst").alias("dst"))

    def reachable(self) -> DataFrame:
        """Statements with whether control reaches them from the start of their scope; in a scope that is not supported all are."""
        b, e = self.flow_graph()
        got = graph.propagate(b.where("kind = 'entry'").select("node"), e, []).select("node", F.lit(True).alias("got"))
        odd = self.rows("unsupported").select("fn_id", F.lit(True).alias("odd")).distinct()
        return b.where("offset >= 0").join(got, "node", "left").join(odd, "fn_id", "left").select("file_id", "fn_id", "node", "line", "kind", (F.coalesce("got", F.lit(False)) | F.coalesce("odd", F.lit(False))).alias("reachable"))

    def dominators(self) -> DataFrame:
        """(dominator, node): the statements without which control cannot come to each statement; pairs are those of one scope."""
        b, e = self.flow_graph()
        start = b.where("kind = 'entry'").select("fn_id", F.col("node").alias("entry"))
        cut = b.where("offset >= 0").select("fn_id", F.col("node").alias("without"))
        around = graph.propagate(cut.join(start, "fn_id").select(F.col("entry").alias("node"), "without"), e, ["without"], cut.select(F.col("without").alias("node"), "without"))
        seen = graph.propagate(start.select(F.col("entry").alias("node")), e, []).select("node")
        live = b.where("offset >= 0").select("fn_id", "node").join(seen, "node", "left_semi")
        pairs = live.join(live.select("fn_id", F.col("node").alias("dominator")), "fn_id").where("node <> dominator")
        return pairs.join(around.select("node", F.col("without").alias("dominator")), ["node", "dominator"], "left_anti").select("dominator", "node")

    def reaching(self) -> DataFrame:
        """(node, variable, definition): which writes of a variable each statement may see; -1 is the value that came in."""
        b, e = self.flow_graph()
        w = b.select("fn_id", "node", F.explode("writes").alias("variable"))
        begin = b.where("kind = 'entry'").join(w.select("fn_id", "variable").distinct(), "fn_id").select("node", "variable", F.lit("-1").alias("definition"))
        first = e.join(w.withColumnRenamed("node", "src"), ["fn_id", "src"]).select(F.col("dst").alias("node"), "variable", F.col("src").alias("definition"))
        return graph.propagate(begin.unionAll(first), e, ["variable", "definition"], w.select("node", "variable")).select("node", "variable", "definition")

    def flow_metrics(self) -> DataFrame:
        """Per file: scopes, statements, branches, statements that are not reached, and scopes that are not supported."""
        r = self.reachable().groupBy("file_id").agg(F.count_distinct("fn_id").alias("scopes"), F.count("*").alias("statements"), F.count_if(F.col("kind").isin("if", "switch", "while", "for", "foreach", "do", "try")).alias("branches"), F.count_if(~F.col("reachable")).alias("dead"))
        u = self.rows("unsupported").groupBy("file_id").agg(F.count_distinct("fn_id").alias("unsupported"))
        return r.join(u, "file_id", "left").withColumn("unsupported", F.coalesce("unsupported", F.lit(0)))

    # -- rules --------------------------------------------------------------------------------------------------------
    def matches(self, rules: list[dict]) -> DataFrame:
        """(rule_id, severity, file_id, path, line, message) of calls; of matches of one rule that hold another the inner one.

        The rules are read by the driver. A call's text is parsed once for all of them, and only if its name fits one.
        """
        from factloom.code import structural

        fn = self.rows("functions").select(F.col("id").alias("fn_id"), F.lower("name").alias("inside"))
        c = self.calls.where("callee IS NOT NULL AND via IS NULL").join(fn, "fn_id", "left")
        names = {n for r in rules for n in structural.rule_callees(r) or ["*"]}
        if "*" not in names:
            c = c.where(F.col("callee").isin(*sorted(names)))
        m = c.select("file_id", "path", "start_line", "start_col", "end_line", "end_col", F.explode(structural.rules_matched(F.col("text"), F.coalesce("inside", F.lit("")), rules)).alias("m")).select("*", "m.*").drop("m")
        head = self.calls.sparkSession.createDataFrame([(r["id"], r["severity"], r["message"]) for r in rules], "rule_id string, severity string, template string")
        m = m.join(F.broadcast(head), "rule_id")
        m = m.withColumn("b", F.struct("start_line", "start_col")).withColumn("e", F.struct("end_line", "end_col"))
        # in reverse order the frame only grows
        w = W.partitionBy("file_id", "rule_id").orderBy(F.col("b").desc(), "e").rowsBetween(W.unboundedPreceding, -1)
        m = m.withColumn("n", F.min("e").over(w)).where(F.col("n").isNull() | (F.col("n") > F.col("e")))
        return m.select("rule_id", "severity", "file_id", "path", F.col("start_line").alias("line"), F.col("start_col").alias("col"), pattern.message(F.col("template"), F.col("bindings")).alias("message"))

    def typed_reviews(self) -> DataFrame:
        """Calls that restore objects by the class of what they are called on: archive metadata, and containers of the standard library."""
        kind = F.when(F.col("receiver_class").isin(*ARCHIVES) & (F.col("callee") == "getmetadata"), "archive_metadata").when(F.col("receiver_class").isin(*CONTAINERS) & F.col("callee").isin("unserialize", "__unserialize"), "container_unserialize")
        return self.calls.where("how = 'method' AND receiver_class IS NOT NULL").select("file_id", "path", F.col("start_line").alias("line"), "receiver_class", "callee", kind.alias("review")).where("review IS NOT NULL")

    def serializable_callbacks(self) -> DataFrame:
        """(class, method, property, sinks): methods that run a callback kept in a property, of classes that can be restored."""
        c = self.calls.where("startswith(callback, 'property:')").select("repo_id", "fn_id", "callee", F.substring_index("callback", ":", -1).alias("property"))
        f = self.functions().where("kind = 'method'").select(F.col("id").alias("fn_id"), "class", F.col("low").alias("method"))
        return c.join(f, "fn_id").groupBy("repo_id", "class", "method", "property").agg(F.array_sort(F.collect_set("callee")).alias("sinks"))


#: Classes of archives, and containers that restore what they hold (fixed values).
ARCHIVES = ("phar", "phardata", "pharfileinfo")
CONTAINERS = ("splobjectstorage", "arrayobject", "arrayiterator", "spldoublylinkedlist", "splqueue", "splstack")

def _rule(name: str, severity: str, patterns: list[str], message: str, without: tuple[str, ...] = (), inside: tuple[str, ...] = ()) -> dict:
    """Archives are restored without being asked to before 8.0, and wddx ends with 7.4."""
    r = {"id": f"loom.{name}", "severity": severity, "patterns": patterns, "message": message}
    below = {"archive": "8.0", "wddx": "7.4"}.get(name.split(".")[0])
    return {**r, **({"not": list(without)} if without else {}), **({"inside": list(inside)} if inside else {}), **({"metadata": {"below": below}} if below else {})}


_SENT = ("_GET", "_POST", "_REQUEST", "_COOKIE")
_PATHS = ("file_exists", "is_file", "is_dir", "filesize", "getimagesize", "md5_file", "exif_read_data", "is_readable")
#: Rules for review, in our own words.
RULES = [
    _rule("unserialize.open", "HIGH", ["unserialize($DATA)"], "unserialize of $DATA allows every class"),
    _rule("unserialize.options", "LOW", ["unserialize($DATA, ...)"], "unserialize of $DATA has options", ("unserialize($DATA)",)),
    _rule("unserialize.sent", "CRITICAL", [f"unserialize(${s}[...])" for s in _SENT], "unserialize takes what the client sent"),
    _rule("unserialize.decoded", "HIGH", ["unserialize(base64_decode($DATA))", "unserialize(urldecode($DATA))", "unserialize(gzuncompress($DATA))"], "unserialize of decoded $DATA"),
    _rule("unserialize.stored", "MEDIUM", ["unserialize(file_get_contents($FILE))", "unserialize($ROW[...])"], "unserialize of stored data", tuple(f"unserialize(${s}[...])" for s in _SENT)),
    _rule("igbinary", "HIGH", ["igbinary_unserialize($DATA)"], "igbinary_unserialize of $DATA"),
    _rule("wddx", "MEDIUM", ["wddx_deserialize($DATA)"], "wddx_deserialize of $DATA, in older versions"),
    _rule("wddx.sent", "HIGH", [f"wddx_deserialize(${s}[...])" for s in _SENT], "wddx_deserialize takes what the client sent"),
    _rule("yaml", "MEDIUM", ["yaml_parse($DATA, ...)"], "yaml_parse of $DATA may make objects"),
    _rule("yaml.sent", "HIGH", [f"yaml_parse(${s}[...])" for s in _SENT], "yaml_parse takes what the client sent"),
    _rule("session", "LOW", ["session_decode($DATA)"], "session_decode of $DATA by the session's handler"),
    _rule("session.sent", "MEDIUM", [f"session_decode(${s}[...])" for s in _SENT], "session_decode takes what the client sent"),
    _rule("cookie.session", "MEDIUM", ["session_id($_COOKIE[...])", "session_id($_GET[...])"], "the client names the session"),
    _rule("archive.path", "INFO", [f"{p}($PATH)" for p in _PATHS], "$PATH may name an archive"),
    _rule("archive.sent", "HIGH", [f"{p}(${s}[...])" for p in _PATHS[:4] for s in _SENT], "the client names a path that may be an archive"),
    _rule("magic.sink", "MEDIUM", ["unlink(...)", "file_put_contents(...)", "eval(...)", "unserialize(...)"], "a sink runs inside a magic method", inside=MAGIC),
    _rule("magic.invoke", "MEDIUM", ["call_user_func($F, ...)", "call_user_func_array($F, ...)"], "$F is called inside a magic method", inside=MAGIC),
    _rule("magic.include", "MEDIUM", ["include_path(...)", "spl_autoload($CLASS)"], "code is loaded inside a magic method", inside=MAGIC),
]


def rules_for(rules: list[dict], php_version: str) -> list[dict]:
    """Rules that mean something for a version of the language: those whose metadata has ``below`` only for earlier ones."""
    v = tuple(int(x) for x in php_version.split("."))
    return [r for r in rules if "below" not in r.get("metadata", {}) or v < tuple(int(x) for x in r["metadata"]["below"].split("."))]


def check_rules(rules: list[dict]) -> tuple[list[dict], list[tuple[str, str]]]:
    """(rules that can be used, (id, reason) of the others); a rule that is wrong does not stop the others."""
    from factloom.code import structural

    good, bad, seen = [], [], set()
    known = {"id", "severity", "confidence", "patterns", "not", "inside", "message", "metadata"}
    for r in rules:
        rid = str(r.get("id", "?")) if isinstance(r, dict) else "?"
        try:
            if not isinstance(r, dict):
                raise ValueError("not a mapping")
            if extra := set(r) - known:
                raise ValueError(f"unknown key {sorted(extra)[0]!r}")
            if missing := {"id", "severity", "patterns", "message"} - set(r):
                raise ValueError(f"missing key {sorted(missing)[0]!r}")
            if rid in seen:
                raise ValueError("duplicate id")
            if r["severity"] not in ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"):
                raise ValueError("unknown severity")
            if not r["patterns"]:
                raise ValueError("no pattern")
            for p in (*r["patterns"], *r.get("not", ())):
                if not isinstance(p, str) or not p.strip():
                    raise ValueError("empty pattern")
                structural.compile_pattern(p)
        except ValueError as x:
            bad.append((rid, str(x)))
            continue
        seen.add(rid)
        good.append(r)
    return good, bad


def read_rules(texts: dict[str, str]) -> tuple[list[dict], list[tuple[str, str]]]:
    """Rules of YAML documents (name -> text), in the order of their names: a mapping with a list ``rules``.

    Keys of a rule: id, message, severity, pattern or pattern-either, pattern-not, pattern-inside, confidence, metadata,
    languages (only php) and mode (only search). What cannot be used is told with its reason.
    """
    import yaml

    raw, bad = [], []
    for name in sorted(texts):
        try:
            doc = yaml.safe_load(texts[name])
            if not isinstance(doc, dict) or not isinstance(doc.get("rules"), list):
                raise ValueError("no list of rules")
            raw += doc["rules"]
        except (yaml.YAMLError, ValueError) as x:
            bad.append((name, str(x).split("\n")[0]))
    rules = []
    listed = lambda x: x if isinstance(x, list) else [x]
    text = lambda p: p.get("pattern") if isinstance(p, dict) else p
    for r in raw:
        try:
            if not isinstance(r, dict):
                raise ValueError("not a mapping")
            r = dict(r)
            if r.pop("mode", "search") != "search":
                raise ValueError("only search rules")
            if listed(r.pop("languages", ["php"])) != ["php"]:
                raise ValueError("only php")
            if ("pattern" in r) == ("pattern-either" in r):
                raise ValueError("pattern or pattern-either")
            out = {"id": r.pop("id", "?"), "severity": str(r.pop("severity", "MEDIUM")).upper(), "message": r.pop("message", ""), "patterns": [text(p) for p in listed(r.pop("pattern", None) or r.pop("pattern-either", None) or [])]}
            out["severity"] = {"ERROR": "HIGH", "WARNING": "MEDIUM"}.get(out["severity"], out["severity"])
            if "pattern-not" in r:
                out["not"] = [text(p) for p in listed(r.pop("pattern-not"))]
            if "pattern-inside" in r:
                found = re.findall(r"function\s+(\w+)", str(text(r.pop("pattern-inside"))))
                if not found:
                    raise ValueError("pattern-inside names no function")
                out["inside"] = [f.lower() for f in found]
            for k in ("cwe", "owasp", "remediation"):
                r.pop(k, None)
            rules.append({**out, **r})
        except ValueError as x:
            bad.append((str(r.get("id", "?")) if isinstance(r, dict) else "?", str(x)))
    good, worse = check_rules(rules)
    return good, bad + worse
