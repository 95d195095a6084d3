"""Code sites that name nodes of resource trees (user interface files, animations), graded against the trees.

The project supplies the trees as tables: ``nodes`` (res_key, node_id, parent_id, name, type) and ``timelines``
(res_key, timeline). Sites come from the fact store or from the project as ``file, line, cls, func, segments`` (the
path of names; steps may skip levels), ``prefix`` (whether the last segment is only a beginning; null where the name is
not known before run time).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from navgraph.functions.paths import like_literal
from navgraph.navigation import Navigator
from navgraph.operators import graph
from navgraph.operators.temporal import as_of
from navgraph.shared import checkpointed

#: Steps from an item's class to the class that holds its resource, and hits that an answer lists.
HOST_STEPS, LISTED = 4, 8
LEVELS = ("EXACT", "MULTI", "PATTERN", "INDIRECT", "UNBOUND", "MISS", "DYNAMIC")


@dataclass
class Resources:
    nav: Navigator
    nodes: DataFrame
    timelines: DataFrame
    #: Kinds of ``ui_binding`` facts that bind a class to a resource, load and play an animation, or name a host class.
    bind_kinds: tuple[str, ...] = ("bind",)
    load_kinds: tuple[str, ...] = ("anim_load",)
    play_kinds: tuple[str, ...] = ("anim_play",)
    host_kinds: tuple[str, ...] = ("host",)
    #: Bases at which inherited bindings stop.
    base_stops: tuple[str, ...] = ()

    def _facts(self, kinds: tuple[str, ...]) -> DataFrame:
        return self.nav.store.table("ui_binding").where(F.col("kind").isin(list(kinds)) if kinds else F.lit(False))

    # -- trees ----------------------------------------------------------------------------------------------------
    def closure(self) -> DataFrame:
        """``res_key, anc, node_id``: every node under every one above it; ``anc`` is null for the root of the tree."""
        def make():
            down = self.nodes.where("parent_id IS NOT NULL").select(F.concat_ws("\u0001", "res_key", "parent_id").alias("src"), F.concat_ws("\u0001", "res_key", "node_id").alias("dst"))
            pairs = graph.reachable_pairs(down, "src", "dst").where("origin <> node")
            parts = pairs.select(F.split("origin", "\u0001").alias("a"), F.split("node", "\u0001").alias("b"))
            below = parts.select(F.col("a")[0].alias("res_key"), F.col("a")[1].alias("anc"), F.col("b")[1].alias("node_id"))
            return below.unionByName(self.nodes.select("res_key", F.lit(None).cast("string").alias("anc"), F.col("node_id").cast("string")))
        return self.nav.graph._once(f"res_closure_{id(self)}", make)

    def bindings(self) -> DataFrame:
        """``cls, file, res_key, inherited``: a class's own keys and those of its bases up to a stop."""
        own = self._facts(self.bind_kinds).where("cls IS NOT NULL").select("cls", "file", F.col("key").alias("res_key")).distinct()
        up = self.nav.graph.ancestors().where(~F.col("anc").isin(list(self.base_stops)) if self.base_stops else F.lit(True)).select("cls", "file", "anc", "anc_file")
        met = up.join(own.withColumnsRenamed({"cls": "anc", "file": "anc_file"}), ["anc", "anc_file"])
        return met.groupBy("cls", "file", "res_key").agg(F.min(F.col("anc") != F.col("cls")).alias("inherited"))

    def hosts(self) -> DataFrame:
        """``cls, file, res_key``: resources that a class reaches through the classes that hold it, a few steps up."""
        held = self._facts(self.host_kinds).where("cls IS NOT NULL").select(F.col("key").alias("cls"), F.col("cls").alias("host"), F.col("file").alias("host_file")).distinct()
        bound = self.bindings().select(F.col("cls").alias("host"), F.col("file").alias("host_file"), "res_key")
        classes = self.nav.store.table("classes").select(F.col("name").alias("cls"), "file").distinct()
        here = classes.join(held, "cls").select("cls", "file", "host", "host_file", F.lit(1).alias("step"))
        every = here
        for _ in range(HOST_STEPS - 1):
            up = held.select(F.col("cls").alias("host"), F.col("host").alias("next"), F.col("host_file").alias("next_file"))
            here = here.join(up, "host").select("cls", "file", F.col("next").alias("host"), F.col("next_file").alias("host_file"), (F.col("step") + 1).alias("step"))
            every = every.unionByName(here)
        met = every.join(bound, ["host", "host_file"])
        return met.groupBy("cls", "file").agg(F.min(F.struct("step", "host_file", "host", "res_key")).alias("first")).select("cls", "file", "first.res_key")

    def hits(self, wanted: DataFrame) -> DataFrame:
        """``wanted`` (res_key, segments, prefix and others) with every ``node_id`` that its path of names reaches."""
        names = self.nodes.select("res_key", F.col("node_id").cast("string").alias("node_id"), "name")
        below = self.closure()
        longest = wanted.agg(F.max(F.size("segments"))).first()[0] or 0
        here, done = wanted.withColumn("anc", F.lit(None).cast("string")), None
        for k in range(longest):
            step = here.where(F.size("segments") > k).withColumn("want", F.get("segments", F.lit(k)))
            last = F.size("segments") == k + 1
            under = step.join(below.withColumnsRenamed({"res_key": "below_key", "anc": "below_anc"}), (F.col("res_key") == F.col("below_key")) & F.col("anc").eqNullSafe(F.col("below_anc"))).join(names, ["res_key", "node_id"])
            fits = (F.col("name") == F.col("want")) | (last & F.col("prefix") & F.col("name").startswith(F.col("want")))
            met = under.where(fits).select(*wanted.columns, "node_id").distinct()
            ended = met.where(F.size("segments") == k + 1)
            done = ended if done is None else done.unionByName(ended)
            here = met.withColumnRenamed("node_id", "anc")
        return done if done is not None else wanted.withColumn("node_id", F.lit(None).cast("string")).limit(0)

    def counted(self, wanted: DataFrame, n: str, nodes: str) -> DataFrame:
        """``site``, how many nodes it reaches in all its trees, and the first of them. What a path reaches in a tree is
        the same for every site, so it is found and counted once, and sites only add up the counts of their trees."""
        path = ["res_key", "segments", "prefix"]
        hits = checkpointed(self.hits(checkpointed(wanted.select(*path).distinct())))
        shown = F.concat_ws("#", "res_key", "node_id")
        listed = hits.withColumn("shown", shown).withColumn("r", F.row_number().over(Window.partitionBy(*path).orderBy("shown"))).where(F.col("r") <= LISTED)
        told = hits.groupBy(*path).agg(F.count("*").alias("k")).join(listed.groupBy(*path).agg(F.collect_list("shown").alias("first")), path)
        met = wanted.select("site", *path).distinct().join(told, path)
        return met.groupBy("site").agg(F.sum("k").alias(n), F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("first")))), 1, LISTED).alias(nodes))

    # -- grading --------------------------------------------------------------------------------------------------
    def grade(self, sites: DataFrame) -> DataFrame:
        """``file, line, cls, level, n, nodes, note`` of every site.

        EXACT for one hit in the bound trees, MULTI for more, PATTERN for a beginning that hits nothing, INDIRECT where
        the class has no tree of its own and its hosts' have it, MISS where the bound tree lacks it, UNBOUND where no
        tree is known, DYNAMIC where the name is not known.
        """
        keyed = sites.withColumn("site", F.xxhash64("file", "line", "cls", F.array_join("segments", "/"), "prefix"))
        known = keyed.where("prefix IS NOT NULL").select("site", "file", "cls", "segments", "prefix").distinct()
        own = checkpointed(known.join(self.bindings().select("cls", "file", "res_key"), ["cls", "file"]).select("site", "res_key", "segments", "prefix"))
        via = checkpointed(known.join(own.select("site").distinct(), "site", "left_anti").join(self.hosts(), ["cls", "file"]).select("site", "res_key", "segments", "prefix"))
        met = keyed.join(own.select("site", F.lit(True).alias("bound")).distinct(), "site", "left").join(via.select("site", F.lit(True).alias("hosted")).distinct(), "site", "left")
        met = met.join(self.counted(own, "n_own", "own_nodes"), "site", "left").join(self.counted(via, "n_via", "via_nodes"), "site", "left")
        level = (
            F.when(F.col("prefix").isNull(), "DYNAMIC").when(F.col("n_own") == 1, "EXACT").when(F.col("n_own") > 1, "MULTI")
            .when(F.col("bound") & F.col("prefix"), "PATTERN").when(F.col("bound"), "MISS")
            .when(F.col("n_via") > 0, "INDIRECT").when(F.col("hosted") & F.col("prefix"), "PATTERN").when(F.col("hosted"), "MISS").otherwise("UNBOUND")
        )
        note = F.when((level == "MISS") & F.col("hosted"), "not in the host's tree").when(level == "MISS", "not in the bound tree")
        return met.select("file", "line", "cls", "segments", level.alias("level"), F.coalesce("n_own", "n_via", F.lit(0)).cast("long").alias("n"), F.coalesce("own_nodes", "via_nodes").alias("nodes"), note.alias("note"))

    def type_mismatches(self, sites: DataFrame, rules: DataFrame) -> DataFrame:
        """Sites whose ``wrapper`` may not wrap the type of a node that they hit; ``rules``: ``prefix, types`` (array),
        the longest prefix of the wrapper's name counts."""
        keyed = sites.withColumn("site", F.xxhash64("file", "line", "cls", F.array_join("segments", "/"), "prefix"))
        own = keyed.where("prefix IS NOT NULL").join(self.bindings().select("cls", "file", "res_key"), ["cls", "file"]).select("site", "res_key", "segments", "prefix")
        typed = self.hits(own).join(self.nodes.select("res_key", F.col("node_id").cast("string").alias("node_id"), "type"), ["res_key", "node_id"])
        r = rules.select(F.col("prefix").alias("rule"), "types")
        allowed = keyed.select("site", "file", "line", "wrapper").join(F.broadcast(r), F.col("wrapper").startswith(F.col("rule")))
        best = allowed.groupBy("site", "file", "line", "wrapper").agg(F.max_by("types", F.length("rule")).alias("types"))
        return best.join(typed, "site").where(~F.array_contains("types", F.col("type"))).select("file", "line", "wrapper", "type").distinct()

    def audit(self, sites: DataFrame) -> DataFrame:
        """``level, n, files, examples`` over all sites, levels without a site too."""
        graded = checkpointed(self.grade(sites).select("level", "file", "line"))
        every = self.nav.store.spark.createDataFrame([(x,) for x in LEVELS], "level string")
        first = graded.withColumn("k", F.row_number().over(Window.partitionBy("level", F.pmod(F.xxhash64("file"), F.lit(64))).orderBy("file", "line"))).where("k <= 5")
        shown = first.groupBy("level").agg(F.slice(F.array_sort(F.collect_set(F.concat_ws(":", "file", "line"))), 1, 5).alias("examples"))
        counts = graded.groupBy("level").agg(F.count("*").alias("n"), F.countDistinct("file").alias("files"))
        return every.join(counts, "level", "left").join(shown, "level", "left").select("level", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("files", F.lit(0)).alias("files"), "examples").orderBy("level")

    # -- views ----------------------------------------------------------------------------------------------------
    def node_view(self, name: str) -> DataFrame:
        """Facts whose key is the name or has it as one of its dotted parts."""
        n = like_literal(name)
        key = F.col("key")
        hit = (key == name) | key.like(f"{n}.%") | key.like(f"%.{n}") | key.like(f"%.{n}.%")
        return self.nav.store.table("ui_binding").where(hit).select("kind", "key", "file", "line", "cls", "func").orderBy("file", "line")

    def file_view(self, file: str) -> DataFrame:
        """Bindings of a file's classes: ``BIND``, ``BIND_INHERIT``, or ``RES-MISS`` where the tree does not exist."""
        trees = self.nodes.select("res_key").distinct().withColumn("there", F.lit(True))
        rows = self.bindings().where(F.col("file") == file).join(trees, "res_key", "left")
        level = F.when(F.col("there").isNull(), "RES-MISS").when(F.col("inherited"), "BIND_INHERIT").otherwise("BIND")
        return rows.select("cls", "res_key", level.alias("level")).orderBy("cls", "res_key")

    def animations(self) -> DataFrame:
        """Every play of a timeline with the resource that it is taken from: the receiver's nearest earlier load in the
        function, else any load of the class, else the class's bindings; the first that has the timeline."""
        plays = self._facts(self.play_kinds).select("file", "func", "receiver", "line", F.col("key").alias("timeline"), "cls")
        loads = self._facts(self.load_kinds).select("file", "func", "receiver", F.col("line").alias("at"), F.col("key").alias("res_key"), "cls")
        near = as_of(plays, loads.select("file", "func", "receiver", "at", "res_key"), ["file", "func", "receiver"], "line", "at", ["res_key"]).where("res_key IS NOT NULL")
        by_class = plays.join(loads.select("file", "cls", "res_key", "at"), ["file", "cls"])
        by_binding = plays.join(self.bindings().select("file", "cls", "res_key"), ["file", "cls"])
        keys = ["file", "line", "timeline"]
        tries = near.select(*keys, F.lit(0).alias("rank"), "res_key").unionByName(by_class.select(*keys, F.lit(1).alias("rank"), "res_key")).unionByName(by_binding.select(*keys, F.lit(2).alias("rank"), "res_key"))
        there = tries.join(self.timelines.select("res_key", "timeline"), ["res_key", "timeline"])
        best = there.groupBy(*keys).agg(F.min(F.struct("rank", "res_key")).alias("b")).select(*keys, F.col("b.res_key").alias("res_key"))
        return plays.join(best, keys, "left").select("file", "line", "timeline", "res_key", F.when(F.col("res_key").isNull(), "MISS").otherwise("ANIM-PLAY").alias("level")).orderBy("file", "line")
