"""What a change reaches: from diffs to changed functions, then layer by layer over all kinds of edges."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from navgraph.functions.paths import display_name, module_of
from navgraph.hooks import FactHooks
from navgraph.navigation import Navigator
from navgraph.operators.tables import page
from navgraph.operators.temporal import overlaps
from navgraph.resolve import CallGraph
from navgraph.shared import checkpointed
from navgraph.sources.extract import scan

#: Depth that stands for no limit, and edges after which a closure is cut off.
NO_LIMIT, MAX_EDGES = 99, 1000
#: Rows that are sent to every executor instead of dealing out what they meet.
FEW = 10_000
HUNK = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
FUNCTION_SHAPE = "file string, cls string, name string, line long, end_line long, cls_line long, header_start long, header_end long"


def hunks(diffs: DataFrame) -> DataFrame:
    """``file, side, first, last`` of every hunk side that has lines, from unified diffs (``file, diff``)."""
    lines = diffs.select("file", F.explode(F.split("diff", "\n")).alias("text")).where(F.col("text").rlike(HUNK))
    number = lambda k: F.regexp_extract("text", HUNK, k)
    size = lambda k: F.when(number(k) == "", 1).otherwise(number(k).cast("long"))
    sides = F.explode(F.array(
        F.struct(F.lit("old").alias("side"), number(1).cast("long").alias("first"), size(2).alias("size")),
        F.struct(F.lit("new").alias("side"), number(3).cast("long").alias("first"), size(4).alias("size")),
    ))
    rows = lines.select("file", sides.alias("h")).select("file", "h.side", "h.first", "h.size").where("size > 0")
    return rows.select("file", "side", "first", (F.col("first") + F.col("size") - 1).alias("last"))


def changes_of(spark: SparkSession, diff: str, old_root: str | None = None) -> DataFrame:
    """``file, diff, old_text`` from one unified diff of several files, as version control prints it.

    The old texts, by which deleted functions are known, are read below ``old_root`` if it is given. A diff is a few
    files that someone changed, so it is taken apart on the driver.
    """
    parts: dict[str, list[str]] = {}
    old = new = None
    for line in diff.split("\n"):
        if line.startswith("--- "):
            old, new = line[4:].split("\t")[0].strip(), None
        elif line.startswith("+++ ") and old is not None:
            new = line[4:].split("\t")[0].strip()
            path = old if new == "/dev/null" else new
            file = path[2:] if path[:2] in ("a/", "b/") else path
            parts[file] = []
        elif new is not None:
            parts[file].append(line)
    rows = []
    for file, lines in sorted(parts.items()):
        where = os.path.join(old_root, file) if old_root else None
        text = None
        if where and os.path.isfile(where):
            with open(where, encoding="utf-8", errors="replace") as f:
                text = f.read()
        rows.append((file, "\n".join(lines), text))
    return spark.createDataFrame(rows, "file string, diff string, old_text string")


def functions_of_texts(texts: DataFrame) -> DataFrame:
    """Functions and methods, with their classes' headers, of sources given as text (``file, text``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                _, facts = scan(path, (text or "").encode(), FactHooks(), "semantic-only")
                heads = {c[0]: (c[2], c[4], (c[5] or c[3] + 1) - 1) for c in facts["classes"]}
                rows += [(path, cls, name, line, end, *heads.get(cls, (None, None, None))) for line, end, cls, name, _, nested in facts["defs"] if not nested]
            kinds = [pa.string(), pa.string(), pa.string(), *[pa.int64()] * 5]
            columns = list(zip(*rows, strict=True)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split(" ")[0] for x in FUNCTION_SHAPE.split(", ")])

    return texts.select("file", "text").mapInArrow(run, FUNCTION_SHAPE)


def touched(functions: DataFrame, spans: DataFrame) -> DataFrame:
    """``file, cls, name`` of the functions that a span meets; a span on a class's header meets all its methods."""
    inside = overlaps(functions, spans, ["file"], ("line", "end_line"), ("first", "last")).select("file", "cls", "name")
    heads = overlaps(functions.where("cls IS NOT NULL"), spans, ["file"], ("header_start", "header_end"), ("first", "last")).select("file", "cls", "name")
    return inside.unionByName(heads).distinct()


def node(file: Column, cls: Column, func: Column) -> Column:
    return F.concat_ws("\u0001", file, F.coalesce(cls, F.lit("")), func)


@dataclass
class Impact:
    nav: Navigator

    # -- what changed ---------------------------------------------------------------------------------------------
    def functions(self) -> DataFrame:
        """Indexed functions and methods with the headers of their classes."""
        defs = self.nav.store.table("defs").where("NOT nested").select("file", "cls", "name", "line", "end_line")
        heads = self.nav.store.table("classes").select("file", F.col("name").alias("cls"), F.col("line").alias("cls_line"), "header_start", (F.coalesce("first_method", F.col("end_line") + 1) - 1).alias("header_end"))
        return defs.join(heads, ["file", "cls"], "left").select("file", "cls", "name", "line", "end_line", "cls_line", "header_start", "header_end")

    def changed_functions(self, changes: DataFrame) -> DataFrame:
        """``file, cls, name, state`` from ``changes`` (``file, diff, old_text``): ``changed``, or ``deleted`` where only
        the old side has the function. A change without a diff counts as all functions of the file."""
        spans = hunks(changes.where("diff IS NOT NULL"))
        now = self.functions()
        new = touched(now, spans.where("side = 'new'"))
        old = touched(functions_of_texts(changes.where("old_text IS NOT NULL").select("file", F.col("old_text").alias("text"))), spans.where("side = 'old'"))
        whole = now.join(changes.where("diff IS NULL").select("file"), "file", "left_semi").select("file", "cls", "name")
        met = new.unionByName(old).unionByName(whole).distinct().withColumn("key", node(F.col("file"), F.col("cls"), F.col("name")))
        present = now.select(node(F.col("file"), F.col("cls"), F.col("name")).alias("key"), F.lit(True).alias("present")).distinct()
        return met.join(present, "key", "left").select("file", "cls", "name", F.when(F.col("present"), "changed").otherwise("deleted").alias("state"))

    def changed_statements(self, changes: DataFrame) -> DataFrame:
        """``file, line, kind`` of top-level imports and assignments that a new-side hunk meets."""
        spans = hunks(changes.where("diff IS NOT NULL")).where("side = 'new'")
        return overlaps(self.nav.store.table("module_stmt"), spans, ["file"], ("line", "end_line"), ("first", "last")).select("file", "line", "kind").distinct()

    def changed_callbacks(self, changes: DataFrame) -> DataFrame:
        """Callback declarations on a changed line (all of a file without a diff)."""
        declared = self.nav.store.table("callback_raw").withColumn("until", F.col("line"))
        spans = hunks(changes.where("diff IS NOT NULL")).where("side = 'new'")
        hit = overlaps(declared, spans, ["file"], ("line", "until"), ("first", "last")).select(*declared.columns)
        return hit.unionByName(declared.join(changes.where("diff IS NULL").select("file"), "file", "left_semi").select(*declared.columns)).drop("until").distinct()

    # -- edges ----------------------------------------------------------------------------------------------------
    def edges(self) -> DataFrame:
        """``to, target, caller_key, caller, caller_file, caller_line, via``: who is reached by calls and callbacks when a
        function changes."""
        return self.nav.graph._once("impact_edges", self._edges, kept=True)

    def _edges(self) -> DataFrame:
        def rows(df: DataFrame, to: tuple[str, str, str], by: tuple[str, str, str], line: str, via: str) -> DataFrame:
            f, c, n = map(F.col, by)
            return df.select(
                node(*map(F.col, to)).alias("to"), display_name(F.col(to[1]), F.col(to[2])).alias("target"), F.when(n.isNotNull(), node(f, c, n)).alias("caller_key"),
                display_name(c, n).alias("caller"), f.alias("caller_file"), F.col(line).alias("caller_line"), F.lit(via).alias("via"),
            )

        calls = self.nav.graph
        direct = rows(calls.call_edges(), ("dst_file", "dst_cls", "dst_func"), ("src_file", "src_cls", "src_func"), "line", "call")
        back = rows(calls.callback_edges(), ("def_file", "def_cls", "target"), ("file", "cls", "source"), "line", "callback")
        return direct.unionByName(back).where("caller_key IS NULL OR caller_key <> to").distinct()

    def remote_calls(self) -> DataFrame:
        """``method, stub, caller_key, caller, caller_file, caller_line, via`` of every remote call."""
        def make():
            sent = self.nav.enclosing(self.nav.store.table("rpc").select("file", "line", "method", "stub"))
            key = F.when(F.col("e_func").isNotNull(), node(F.col("file"), F.col("e_cls"), F.col("e_func")))
            return sent.select("method", "stub", key.alias("caller_key"), display_name(F.col("e_cls"), F.col("e_func")).alias("caller"), F.col("file").alias("caller_file"), F.col("line").alias("caller_line"), F.lit("rpc").alias("via")).distinct()
        return self.nav.graph._once("remote_calls", make, kept=True)

    def event_sides(self) -> DataFrame:
        """``event, side, key, name, file, line`` of every function that sends or hears an event."""
        def make():
            rows = self.nav.store.table("pubsub").where("func IS NOT NULL")
            return rows.select("event", "side", node(F.col("file"), F.col("cls"), F.col("func")).alias("key"), display_name(F.col("cls"), F.col("func")).alias("name"), "file", "line").distinct()
        return self.nav.graph._once("event_sides", make, kept=True)

    def reached(self, frontier: DataFrame) -> DataFrame:
        """Edges into the functions of ``frontier`` (``key``). Both sides of an event reach each other, and a remote call
        every method of its name; they meet at the events and methods of the frontier, so pairs of all senders and
        hearers, or of all calls and methods, are never written out."""
        shape = ("to", "target", "caller_key", "caller", "caller_file", "caller_line", "via")
        direct = self.edges().join(frontier.withColumnRenamed("key", "to"), "to").select(*shape)
        sides = self.event_sides()
        other = F.when(F.col("side") == "publish", "listen").otherwise("publish")
        here = sides.join(frontier, "key").select("event", other.alias("side"), F.col("key").alias("to"), F.col("name").alias("target")).distinct()
        there = sides.select("event", "side", F.col("key").alias("caller_key"), F.col("name").alias("caller"), F.col("file").alias("caller_file"), F.col("line").alias("caller_line"), F.lit("pubsub").alias("via"))
        by_event = here.join(there, ["event", "side"]).where("caller_key <> to").select(*shape)
        defs = self.nav.store.table("defs").select(node(F.col("file"), F.col("cls"), F.col("name")).alias("to"), display_name(F.col("cls"), F.col("name")).alias("target"), F.col("cls").alias("t_cls"), F.col("name").alias("method"))
        called = defs.join(frontier.withColumnRenamed("key", "to"), "to").distinct()
        remote = called.join(self.remote_calls(), "method").where("(t_cls IS NULL OR stub IS NULL OR stub = t_cls) AND (caller_key IS NULL OR caller_key <> to)").select(*shape)
        return direct.unionByName(by_event).unionByName(remote).distinct()

    # -- closure --------------------------------------------------------------------------------------------------
    def closure(self, changes: DataFrame, depth: int = 3, max_edges: int = MAX_EDGES) -> tuple[DataFrame, bool]:
        """(``layer, target, caller, caller_file, caller_line, via``, whether it was cut off at ``max_edges``).

        Layer 1 are the callers of changed functions, the targets of changed callbacks, and what called deleted
        functions before (``via`` is ``snapshot``); then each layer's callers. A cut keeps whole layers in order.
        """
        depth = depth or NO_LIMIT
        changed = checkpointed(self.changed_functions(changes))
        columns = ["layer", "target", "caller", "caller_file", "caller_line", "via", "caller_key"]
        met = checkpointed(changed.where("state = 'changed'").select(node(F.col("file"), F.col("cls"), F.col("name")).alias("key")).distinct())
        declared = self.changed_callbacks(changes).select("file", "line", "cls", "kind", "source", "target")
        aimed = self.nav.graph.callback_edges().join(declared.select("file", "line", "cls", "source", F.col("target")).distinct(), ["file", "line", "cls", "source", "target"], "left_semi")
        by_callback = aimed.select(F.lit(1).alias("layer"), F.concat_ws(".", "cls", "source").alias("target"), display_name(F.col("def_cls"), F.col("target")).alias("caller"), F.col("def_file").alias("caller_file"), F.col("def_line").alias("caller_line"), F.lit("callback").alias("via"), node(F.col("def_file"), F.col("def_cls"), F.col("target")).alias("caller_key"))
        items = checkpointed(by_callback.select(*columns).unionByName(self._snapshot(changed).select(*columns)).distinct())
        frontier, layer, cut = met, 0, False
        total = items.count()
        while layer < depth:
            layer += 1
            hit = self.reached(frontier).withColumn("layer", F.lit(layer)).select(*columns).distinct()
            hit = checkpointed(hit)
            n = hit.count()
            if not n and layer > 1:
                break
            if total + n > max_edges:
                hit = hit.orderBy("caller_file", "caller_line", "target", "via").limit(max_edges - total)
                cut = True
            total += n
            items = items.unionByName(hit)
            ahead = hit if layer > 1 else hit.unionByName(by_callback.select(*columns))
            frontier = checkpointed(ahead.where("caller_key IS NOT NULL").select(F.col("caller_key").alias("key")).distinct().join(met, "key", "left_anti"))
            if cut or not frontier.take(1):
                break
            met = checkpointed(met.unionByName(frontier))
        return items.drop("caller_key").orderBy("layer", "caller_file", "caller_line", "target"), cut

    def _snapshot(self, changed: DataFrame) -> DataFrame:
        """Callers of deleted functions as the store had them before its last refresh."""
        gone = changed.where("state = 'deleted'").select(node(F.col("file"), F.col("cls"), F.col("name")).alias("to"))
        before = self.nav.store.previous()
        shape = "layer int, target string, caller string, caller_file string, caller_line long, via string, caller_key string"
        if before is None:
            return self.nav.store.spark.createDataFrame([], shape)
        old = CallGraph(before, self.nav.config).call_edges()
        found = old.withColumn("to", node(F.col("dst_file"), F.col("dst_cls"), F.col("dst_func"))).join(gone, "to", "left_semi")
        return found.select(F.lit(1).alias("layer"), display_name(F.col("dst_cls"), F.col("dst_func")).alias("target"), display_name(F.col("src_cls"), F.col("src_func")).alias("caller"), F.col("src_file").alias("caller_file"), F.col("line").alias("caller_line"), F.lit("snapshot").alias("via"), F.lit(None).cast("string").alias("caller_key"))

    def importers(self, changes: DataFrame) -> DataFrame:
        """``file, imports``: files that import a changed file, from the index or, where the index has lost the file, by
        its module's name (``import m``, ``from m import x``, ``import m.x``)."""
        files = changes.select(F.col("file").alias("dst")).distinct()
        gone = files.join(self.nav.store.files().select(F.col("file").alias("dst")), "dst", "left_anti").select(F.col("dst").alias("imports"), module_of(F.col("dst")).alias("gone"))
        imports = self.nav.store.table("imports").select("file", "module", "name")
        # A name is looked up once, not at every import of it.
        told = checkpointed(imports.select("module", "name").distinct())
        here = self.nav._import_targets(told).join(files, "dst").select("module", "name", F.col("dst").alias("imports"))
        # Every module that an import names or lies under, so that this stays an equality join.
        parts = F.split("module", r"\.")
        over = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))
        named = told.where("module <> ''").select("module", "name", F.explode(F.concat(over, F.when(F.col("name").isNotNull(), F.array(F.concat_ws(".", "module", "name"))).otherwise(F.array().cast("array<string>")))).alias("gone"))
        aimed = checkpointed(here.unionByName(named.join(gone, "gone").select("module", "name", "imports")).distinct().withColumnsRenamed({"module": "m", "name": "n"}))
        if aimed.count() <= FEW:
            aimed = F.broadcast(aimed)
        met = imports.join(aimed, F.col("module").eqNullSafe(F.col("m")) & F.col("name").eqNullSafe(F.col("n"))).where(F.col("file") != F.col("imports"))
        return met.select("file", "imports").distinct().orderBy("file", "imports")

    # -- projections ----------------------------------------------------------------------------------------------
    @staticmethod
    def summary(items: DataFrame) -> DataFrame:
        """``layer, n, callers`` of a closure."""
        return items.groupBy("layer").agg(F.count("*").alias("n"), F.countDistinct("caller_file", "caller").alias("callers")).orderBy("layer")

    @staticmethod
    def page(items: DataFrame, layer: int | None = None, offset: int = 0, limit: int = 50) -> DataFrame:
        """One page of a closure (of one layer); the computation is the same for every page."""
        rows = items if layer is None else items.where(F.col("layer") == layer)
        return page(rows, ["layer", "caller_file", "caller_line", "target"], offset, limit)
