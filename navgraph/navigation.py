"""Questions to the fact store, answered as DataFrames. Every answer row that is evidence carries its ``level``."""

from __future__ import annotations

import re
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from navgraph.config import AnalysisConfig
from navgraph.functions.paths import display_name, folder_key, like_literal, within
from navgraph.operators import graph
from navgraph.operators.grading import cascade
from navgraph.resolve import CallGraph
from navgraph.sources.store import FactStore

IDENTIFIER = re.compile(r"[A-Za-z_]\w*\Z")
#: Callees too common to tell anything, as compatible answers leave them out.
NOISE = (
    "bool int float str bytes list dict tuple set len range enumerate isinstance issubclass getattr setattr hasattr print "
    "sorted min max sum abs any all map filter zip open super type repr format round id hash iter next divmod pow"
).split()
HUB_LEAST = 10


@dataclass(frozen=True)
class Answer:
    """Rows with what a reader needs to judge them: counts of evidence, coverage of the files asked about (``complete``
    or ``partial`` with the failed ones), state of the index, and why there is nothing, if so."""

    query: str
    rows: DataFrame
    coverage: dict
    index: dict
    note: str | None = None
    elapsed: float = 0.0

    def counts(self) -> dict[str, int]:
        """Verified, candidate and inferred rows; empty where rows carry no level."""
        if "level" not in self.rows.columns:
            return {}
        level = F.col("level")
        told = self.rows.agg(F.count_if(level == "VERIFIED").alias("verified"), F.count_if(level == "CANDIDATE").alias("candidate"), F.count_if(level.endswith("-INFERRED")).alias("inferred"))
        return told.first().asDict()


@dataclass
class Navigator:
    store: FactStore
    config: AnalysisConfig
    graph: CallGraph = field(init=False)

    def __post_init__(self) -> None:
        self.graph = CallGraph(self.store, self.config)

    def ask(self, question: str, *given, index: dict | None = None, **named) -> Answer:
        """The answer of a method of this class in its envelope. ``index`` is what a refresh returned; coverage is the
        scope's for questions about a scope and the whole index's for all others."""
        began = time.time()
        rows = getattr(self, question.replace("-", "_"))(*given, **named)
        scoped = question in ("deps", "importers", "external")
        scope = (given[0] if given else named.get("scope", "")) if scoped else None
        told = self.store.coverage(scope or None).first()
        coverage = {"status": told["coverage"], "files": told["files"], "parse_failed": told["failed"], "issues": list(told["issues"])}
        note = None
        if question in ("callers", "callees"):
            note = self.target_note(*(list(given) + [named[k] for k in ("file", "func") if k in named])[:2])
        elif question == "importers" and scope and self.is_hub(scope):
            note = f"a hub: {self.hub_degree()} importers or more"
        elif question == "file-context" and not rows.take(1):
            note = "the file is not in the index"
        return Answer(question, rows, coverage, {**self.store.state(), **(index or {})}, note, round(time.time() - began, 3))

    def enclosing(self, rows: DataFrame) -> DataFrame:
        """``rows`` (file, line) with the innermost function around the line (``e_cls, e_func``, null at the top)."""
        defs = self.store.table("defs").select("file", F.col("line").alias("d_line"), "end_line", F.col("cls").alias("e_cls"), F.col("name").alias("e_func"))
        keys = rows.select("file", "line").distinct()
        inner = keys.join(defs, "file").where(F.col("line").between(F.col("d_line"), F.col("end_line"))).groupBy("file", "line").agg(F.max(F.struct("d_line", "e_cls", "e_func")).alias("e"))
        return rows.join(inner.select("file", "line", "e.e_cls", "e.e_func"), ["file", "line"], "left")

    # -- calls ----------------------------------------------------------------------------------------------------
    def target(self, file: str, func: str, receiver_class: str | None = None) -> DataFrame:
        """The definition that a question is about: the first of that name in the file (of the class, if one is named)."""
        found = self.store.table("defs").where((F.col("file") == file.replace("\\", "/")) & (F.col("name") == func))
        if receiver_class:
            found = found.where(F.col("cls") == receiver_class)
        return found.orderBy("line").limit(1).select(F.col("file").alias("t_file"), F.col("line").alias("t_line"), F.col("cls").alias("t_cls"), F.col("name").alias("t_name"))

    def target_note(self, file: str, func: str) -> str | None:
        """Why there is no target: the file failed to parse, is unknown, or has no such function; None if there is one."""
        if self.target(file, func).take(1):
            return None
        row = self.store.files().where(F.col("file") == file).select("parse_ok").first()
        if row is None:
            return "the file is not in the index"
        return "no such function" if row["parse_ok"] else "parse failure: the file's definitions are unknown"

    def callers(self, file: str, func: str, receiver_class: str | None = None) -> DataFrame:
        """``level, file, line, caller, note``: graded call sites of a function, and callbacks that reach it.

        Evidence about the receiver comes first: where a framework fact names another class the site is dropped, where
        it names this one the site is inferred; then what the resolver found, then the mere name.
        """
        target = self.target(file, func, receiver_class).withColumn("wanted", F.coalesce(F.lit(receiver_class), "t_cls"))
        sites = self.graph.resolved().where(F.col("callee") == func)
        facts = self.store.table("receiver_fact").groupBy("file", "line", F.col("expr").alias("recv")).agg(F.collect_set("type").alias("types"))
        parsed = self.store.files().select("file", "parse_ok")
        met = sites.crossJoin(F.broadcast(target)).join(facts, ["file", "line", "recv"], "left").join(parsed, "file")
        is_target = (F.col("def_file") == F.col("t_file")) & (F.col("def_line") == F.col("t_line"))
        known = F.coalesce(is_target, F.lit(False))
        agrees = F.coalesce(F.array_contains("types", F.col("wanted")), F.lit(False))
        level = cascade([(F.col("types").isNotNull() & agrees & ~known, "FRAMEWORK-INFERRED"), (known, "VERIFIED")], "CANDIDATE")
        note = F.when(level != "CANDIDATE", F.lit(None).cast("string")).when(F.col("def_file").isNotNull(), F.concat(F.lit("resolved to "), "def_file", F.lit(":"), "def_line")).otherwise("unreachable")
        graded = met.where(F.col("types").isNull() | agrees).select(level.alias("level"), "file", "line", display_name(F.col("cls"), F.col("func")).alias("caller"), note.alias("note"))
        # Files that do not parse have names only: every occurrence is a candidate.
        broken = self.store.table("names").where(F.col("name") == func).join(parsed.where("NOT parse_ok"), "file").crossJoin(F.broadcast(target))
        unknown = broken.select(F.lit("CANDIDATE").alias("level"), "file", "line", F.lit("?").alias("caller"), F.lit("parse failure").alias("note"))
        back = self.graph.callback_edges().join(F.broadcast(target), (F.col("def_file") == F.col("t_file")) & (F.col("def_line") == F.col("t_line")))
        by_callback = back.select("level", "file", "line", F.concat_ws(".", "cls", "source").alias("caller"), F.col("kind").alias("note"))
        return graded.unionByName(unknown).unionByName(by_callback).distinct().orderBy("level", "file", "line")

    def callees(self, file: str, func: str) -> DataFrame:
        """``level, symbol, def_file, def_line, line, note`` of the calls in a function and its nested functions."""
        target = self.target(file, func).join(self.store.table("defs").select(F.col("file").alias("t_file"), F.col("line").alias("t_line"), "end_line"), ["t_file", "t_line"])
        inside = self.graph.resolved().where(~F.col("callee").isin(NOISE)).join(F.broadcast(target), (F.col("file") == F.col("t_file")) & F.col("line").between(F.col("t_line"), F.col("end_line")))
        facts = self.store.table("receiver_fact").groupBy("file", "line", F.col("expr").alias("recv")).agg(F.collect_set("type").alias("types"))
        met = inside.join(facts, ["file", "line", "recv"], "left")
        inferred = F.size("types") == 1
        level = cascade([(F.col("def_file").isNotNull(), "VERIFIED"), (inferred, "FRAMEWORK-INFERRED")], "CANDIDATE")
        symbol = F.when(F.col("def_file").isNotNull(), display_name(F.col("def_cls"), F.col("callee"))).when(inferred, F.concat_ws(".", F.element_at("types", 1), "callee")).otherwise(F.col("callee"))
        rows = met.select(level.alias("level"), symbol.alias("symbol"), "def_file", "def_line", "line", F.when(level == "CANDIDATE", "unresolved").alias("note"))
        return rows.groupBy("level", "symbol", "def_file", "def_line", "note").agg(F.min("line").alias("line")).orderBy("level", "symbol", "line")

    def usages(self, symbol: str, limit: int = 200) -> DataFrame:
        """``level, file, line, col``: raw occurrences, one more than ``limit`` where there are more; empty for no name."""
        rows = self.store.by_name("names").where(F.col("name") == symbol if IDENTIFIER.match(symbol) else F.lit(False))
        return rows.select(F.lit("OCCUR").alias("level"), "file", "line", "col").orderBy("file", "line", "col").limit(limit + 1)

    def defs(self, symbol: str, limit: int = 200, with_classes: bool = False) -> DataFrame:
        """``level, kind, file, line, symbol`` of functions and methods of a name, and of classes if asked for."""
        sound = F.lit(bool(IDENTIFIER.match(symbol)))
        rows = self.store.by_name("defs").where(sound & (F.col("name") == symbol)).select(F.lit("DEFINITION").alias("level"), F.when(F.col("cls").isNull(), "function").otherwise("method").alias("kind"), "file", "line", display_name(F.col("cls"), F.col("name")).alias("symbol"))
        if with_classes:
            classes = self.store.table("classes").where(sound & (F.col("name") == symbol))
            rows = rows.unionByName(classes.select(F.lit("DEFINITION").alias("level"), F.lit("class").alias("kind"), "file", "line", F.col("name").alias("symbol")))
        return rows.orderBy("file", "line").limit(limit + 1)

    # -- structure ------------------------------------------------------------------------------------------------
    def _import_targets(self, imports: DataFrame | None = None) -> DataFrame:
        """Every import (or rows with its ``module`` and ``name``) with the file that it names: ``module.name`` before
        ``module``; ``dst`` is null outside."""
        modules = self.graph.modules()
        if imports is None:
            imports = self.store.table("imports").select("file", "module", "name", "line")
        longer = modules.select(F.col("module").alias("m1"), F.col("file").alias("f1"))
        plain = modules.select(F.col("module").alias("m2"), F.col("file").alias("f2"))
        named = F.col("name").isNotNull() & (F.concat_ws(".", "module", "name") == F.col("m1"))  # without a name both are the module
        met = imports.join(longer, named, "left").join(plain, F.col("module") == F.col("m2"), "left")
        return met.select(*imports.columns, F.coalesce("f1", "f2").alias("dst"))

    def import_edges(self) -> DataFrame:
        """Distinct ``src, dst`` between indexed files."""
        return self.graph._once("import_edges", kept=True, make=lambda: self._import_targets().where("dst IS NOT NULL AND dst <> file").select(F.col("file").alias("src"), "dst").distinct())

    def _import_counts(self) -> DataFrame:
        """``dst, module, n, times``: every imported file (``module`` is null) with the number of other files that import
        it and of imports, every module outside (``dst`` is null) with the number of imports. One pass over the imports."""
        def make():
            inside = F.col("dst").isNotNull()
            told = self._import_targets().select("dst", F.when(~inside, F.col("module")).alias("module"), F.when(inside, F.col("file")).alias("file"))
            pairs = told.groupBy("dst", "module", "file").agg(F.count("*").alias("times"))  # by pair, so that a hub is spread out
            return pairs.groupBy("dst", "module").agg(F.count_if(F.col("dst") != F.col("file")).alias("n"), F.sum("times").alias("times"))
        return self.graph._once("import_counts", make, kept=True)

    def external(self, scope: str = "") -> DataFrame:
        """``module, n``: imported modules that no indexed file is, by how often they are imported."""
        told = self.store.table("imports").where(within(F.col("file"), scope)).where("module <> ''")
        times = told.groupBy("module", "name").agg(F.count("*").alias("times"))  # a name is looked up once, not at every import
        out = self._import_targets(times).where("dst IS NULL")
        return out.groupBy("module").agg(F.sum("times").alias("n")).orderBy(F.desc("n"), "module")

    def deps(self, scope: str) -> DataFrame:
        """``src, dst`` of the internal imports of a file or folder."""
        return self.import_edges().where(within(F.col("src"), scope)).orderBy("src", "dst")

    def importers(self, scope: str) -> DataFrame:
        """``file`` of everything that imports a file or folder, importers inside the folder too."""
        return self.import_edges().where(within(F.col("dst"), scope)).select(F.col("src").alias("file")).distinct().orderBy("file")

    def hub_degree(self, real_percentile: bool = False) -> int:
        """Least number of importers that makes a hub: at least ten; the compatible place in the descending list of
        degrees, or with ``real_percentile`` the exact 95th percentile."""
        degrees = graph.in_degree(self.import_edges(), "src", "dst").groupBy("n").agg(F.count("*").alias("times"))
        rows = sorted(((r["n"], r["times"]) for r in degrees.collect()), reverse=True)  # distinct degrees: few
        total = sum(t for _, t in rows)
        place, upto = (int(total * 0.05) if real_percentile else max(int(total * 0.95) - 1, 0)), 0
        for n, times in rows:
            upto += times
            if upto > place:
                return max(n, HUB_LEAST)
        return HUB_LEAST

    def is_hub(self, scope: str) -> bool:
        return self.importers(scope).count() >= self.hub_degree()

    def hubs(self, top: int = 25) -> DataFrame:
        return graph.hubs(self.import_edges(), "src", "dst", top).withColumnRenamed("dst", "file")

    def tree(self, depth: int = 2) -> DataFrame:
        """``folder, n, bytes`` by the first ``depth`` + 1 parts of the path; '' for files at the top."""
        return self.store.files().groupBy(folder_key(F.col("file"), depth).alias("folder")).agg(F.count("*").alias("n"), F.sum("length").alias("bytes")).orderBy("folder")

    def find(self, pattern: str, limit: int = 50) -> DataFrame:
        """Paths that hold ``pattern``, case aside and taken literally, shortest first; one more than ``limit`` if there are more."""
        like = f"%{like_literal(pattern.lower())}%"
        return self.store.files().where(F.lower("file").like(like)).select("file").orderBy(F.length("file"), "file").limit(limit + 1)

    def file_context(self, file: str) -> DataFrame:
        """``section, name, detail, line``: classes, functions, imports, external modules, importers and other facts of a file."""
        t = lambda name: self.store.table(name).where(F.col("file") == file)
        none, no_line = F.lit(None).cast("string"), F.lit(None).cast("long")
        row = lambda df, section, name, detail=none, line=no_line: df.select(F.lit(section).alias("section"), name.alias("name"), detail.alias("detail"), line.alias("line"))
        targets = self._import_targets().where(F.col("file") == file)
        parts = [
            row(t("classes"), "class", F.col("name"), F.array_join("bases", ","), F.col("line")),
            row(t("defs"), "def", display_name(F.col("cls"), F.col("name")), none, F.col("line")),
            row(targets.where("dst IS NOT NULL"), "import", F.col("dst"), F.col("module"), F.col("line")),
            row(targets.where("dst IS NULL"), "external", F.col("module"), F.col("name"), F.col("line")),
            row(self.importers(file), "importer", F.col("file")),
            row(t("attr"), "attr", F.concat_ws(".", "cls", "attr"), F.col("type"), F.col("line")),
            row(self.graph.components().where(F.col("comp_file") == file), "component", F.col("comp"), F.concat_ws(":", "host_file", "host")),
            row(t("callback_raw"), "callback", F.concat_ws(".", "cls", "source"), F.col("target"), F.col("line")),
            row(self.store.files().where((F.col("file") == file) & ~F.col("parse_ok")), "issue", F.lit("parse failure")),
        ]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out.orderBy("section", "line", "name")

    def context(self, compact: bool = False) -> DataFrame:
        """``section, name, n``: the project's largest folders, hubs, external modules, table sizes and coverage."""
        folders, hubs, modules = (15, 10, 10) if compact else (40, 25, 25)
        tree = self.store.files().groupBy(folder_key(F.col("file"), 1).alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(folders)
        counts = self._import_counts()  # hubs, external modules and the number of imports come from one pass
        top = counts.where("dst IS NOT NULL AND n > 0").orderBy(F.desc("n"), "dst").limit(hubs)
        outside = counts.where("dst IS NULL AND module <> ''").orderBy(F.desc("times"), "module").limit(modules)
        size = lambda rows, table: rows.select(F.lit("table").alias("section"), F.lit(table).alias("name"), "n")
        parts = [
            tree.select(F.lit("folder").alias("section"), "name", "n"),
            top.select(F.lit("hub").alias("section"), F.col("dst").alias("name"), "n"),
            outside.select(F.lit("external").alias("section"), F.col("module").alias("name"), F.col("times").alias("n")),
            self.store.by_profile().select(F.lit("profile").alias("section"), F.col("profile").alias("name"), "n"),
            self.store.coverage().select(F.lit("coverage").alias("section"), F.col("coverage").alias("name"), F.col("failed").alias("n")),
        ]
        for table in ("defs", "classes", "call_site"):
            parts.append(size(self.store.table(table).agg(F.count("*").alias("n")), table))
        parts.append(size(counts.agg(F.coalesce(F.sum("times"), F.lit(0)).alias("n")), "imports"))
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    # -- framework facts ------------------------------------------------------------------------------------------
    def rpc_refs(self, method: str, stub: str | None = None) -> DataFrame:
        """``level, file, line, symbol, chan, match``: calls of a remote method (``symbol`` is the function around the
        call), its handlers, and mere namesakes.

        A handler counts where its endpoint is the stub asked for, if one is, and its channel, or a channel that means
        the same, is one on which the method is called; with no call in sight every such handler counts. Definitions
        of the name that are no such handler are namesakes. Channels show under their configured names.
        """
        calls = self.store.table("rpc").where(F.col("method") == method)
        handlers = self.store.table("rpc_handler").where(F.col("method") == method)
        if stub:
            calls = calls.where(F.col("stub") == stub)
            handlers = handlers.where(F.col("endpoint") == stub)
        frame = lambda rows, shape: self.store.spark.createDataFrame(rows, shape)
        aliases = frame([(c, x) for c, xs in self.config.rpc_aliases.items() for x in xs], "chan string, alias string")
        means = handlers.select("chan").distinct().withColumn("alias", F.col("chan")).unionByName(aliases)
        used = calls.select(F.col("chan").alias("alias")).distinct()
        sounds = means.join(used, "alias", "left_semi").select("chan").distinct()
        any_call = calls.agg((F.count("*") == 0).alias("silent"))
        met = handlers.join(sounds.withColumn("heard", F.lit(True)), "chan", "left").crossJoin(F.broadcast(any_call)).where("heard OR silent")
        level = F.when(F.col("confidence") == "verified", "HANDLER-VERIFIED").otherwise("HANDLER-INFERRED")
        defs = self.store.table("defs").where(F.col("name") == method)
        named = defs.join(met.select("file", "line").distinct(), ["file", "line"], "left_anti")
        blank = F.lit(None).cast("string")
        found = self.enclosing(calls).select(F.lit("RPC-INFERRED").alias("level"), "file", "line", display_name(F.col("e_cls"), F.col("e_func")).alias("symbol"), "chan", blank.alias("match"))
        found = found.unionByName(met.select(level.alias("level"), "file", "line", F.concat_ws(".", "endpoint", "method").alias("symbol"), "chan", F.lit("direction+endpoint" if stub else "direction").alias("match")))
        found = found.unionByName(named.select(F.lit("NAME-ONLY").alias("level"), "file", "line", display_name(F.col("cls"), F.col("name")).alias("symbol"), blank.alias("chan"), F.lit("name-only").alias("match")))
        if self.config.rpc_channels:
            names = frame([(c, *told) for c, told in self.config.rpc_channels.items()], "chan string, shown string, direction string")
            found = found.join(F.broadcast(names), "chan", "left").select("level", "file", "line", "symbol", F.when(F.col("shown").isNull(), F.col("chan")).otherwise(F.concat_ws(" ", "shown", "direction")).alias("chan"), "match")
        return found.orderBy("level", "file", "line")

    def pubsub_refs(self, event: str, side: str | None = None) -> DataFrame:
        """``event, level, file, line, symbol``: an event with a dot exactly, a bare one as the last part of any key."""
        fits = F.col("event") == event
        if "." not in event:
            fits = fits | F.col("event").endswith("." + event)
        rows = self.store.table("pubsub").where(fits)
        if side:
            rows = rows.where(F.col("side") == side)
        level = F.when(F.col("side") == "publish", "EVENT-INFERRED").otherwise("LISTENER")
        return rows.select("event", level.alias("level"), "file", "line", display_name(F.col("cls"), F.col("func")).alias("symbol")).orderBy("event", "level", "file", "line")

    def diagnose(self) -> DataFrame:
        """What the project's own diagnostics say, in order of severity and place."""
        found = self.config.hooks.diagnostics(self.store, self.config)
        if found is None:
            return self.store.spark.createDataFrame([], "code string, severity string, file string, line long, class string, property string, message string")
        return found.orderBy("severity", "file", "line", "code")
