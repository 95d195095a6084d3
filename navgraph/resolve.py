"""Resolving every call of the code base at once, as joins over the fact tables.

Precedence for a call: through ``self`` the enclosing class's method lookup; through a variable its type's methods (a
known type rules everything else out) or else the one function of an imported module; a bare name the one module-level
function of that name, in all files or else in the own file.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from navgraph.config import AnalysisConfig
from navgraph.functions.paths import folder, top_folder
from navgraph.operators.grading import best_rank
from navgraph.shared import checkpointed
from navgraph.sources.store import FactStore

#: Raised when the same facts resolve differently, so that kept tables are made again.
RESOLVER_VERSION = 2
#: Rounds of variable typing.
TYPE_ROUNDS = 6
COMPONENT_ORD = 1 << 20


def nearness(a: Column, b: Column) -> Column:
    """0 for the same file, 1 for its folder, 2 for its top folder, 3 for anywhere."""
    return F.when(a == b, 0).when(folder(a) == folder(b), 1).when(top_folder(a) == top_folder(b), 2).otherwise(3)


def last_part(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


@dataclass
class CallGraph:
    """Resolved calls of one store; every table is made once and kept for the later queries."""

    store: FactStore
    config: AnalysisConfig
    _made: dict[str, DataFrame] = field(default_factory=dict)

    def _once(self, name: str, make, kept: bool = False) -> DataFrame:
        """The table ``name``, made once a session; one that is ``kept`` stays in the store beside the facts that it was
        made from, and later sessions read it there (until the facts, the configuration or the resolver change)."""
        if name not in self._made:
            tag = f"{RESOLVER_VERSION}-{self.config.fingerprint()[:16]}"
            self._made[name] = self.store.derived(f"{tag}/{name}", make) if kept and self.store.keeps() else checkpointed(make())
        return self._made[name]

    # -- names of files and classes -------------------------------------------------------------------------------
    def modules(self) -> DataFrame:
        """``module, file``; of ``a.py`` and ``a/__init__.py`` the package counts."""
        def make():
            ranked = self.store.files().select("module", "file", F.when(F.col("file").endswith("/__init__.py"), 0).otherwise(1).alias("rank"))
            return best_rank(ranked, ["module"], "rank", ["file"]).select("module", "file")
        return self._once("modules", make, kept=True)

    def visible_imports(self) -> DataFrame:
        """``file, scope, bound, module, name``: a name that one scope binds to two targets is left out."""
        def make():
            bound = F.coalesce("alias", "name", F.substring_index("module", ".", 1))
            module = F.when(F.col("name").isNull() & F.col("alias").isNull(), F.substring_index("module", ".", 1)).otherwise(F.col("module"))
            rows = self.store.table("imports").select("file", "scope", bound.alias("bound"), F.struct(module.alias("module"), "name").alias("target")).distinct()
            one = rows.groupBy("file", "scope", "bound").agg(F.count("*").alias("n"), F.first("target").alias("target")).where("n = 1")
            return one.select("file", "scope", "bound", "target.module", "target.name")
        return self._once("visible_imports", make)

    def named_members(self) -> DataFrame:
        """``host, comp``: what the project's hooks say an import-all component brings (one row for each host that has
        any; hosts are few)."""
        hosts = [r["host"] for r in self.store.table("comp_raw").where("kind = 'importall'").select("host").distinct().orderBy("host").toLocalIterator()]
        rows = [(host, name) for host in hosts for name in self.config.hooks.importall_members(host) or []]
        return self.store.spark.createDataFrame(rows, "host string, comp string")

    def components(self) -> DataFrame:
        """``host, host_file, comp, comp_file``: classes whose methods a host class takes in."""
        def make():
            raw = self.store.table("comp_raw")
            classes = self.store.table("classes").select(F.col("file").alias("comp_file"), F.col("name").alias("comp"))
            named = raw.where(F.col("kind") == "ref").withColumn("comp", last_part(F.col("value"))).join(classes, "comp")
            ranked = named.withColumn("rank", nearness(F.col("file"), F.col("comp_file")))
            refs = best_rank(ranked.select("file", "host", "value", "comp", "rank", "comp_file"), ["file", "host", "value"], "rank", ["comp_file"])
            attrs = raw.where(F.col("kind") == "attr").join(self.store.table("attr").select("file", F.col("cls").alias("host"), F.col("attr").alias("value"), F.col("type").alias("comp")), ["file", "host", "value"])
            by_attr = attrs.join(classes, "comp").withColumn("rank", nearness(F.col("file"), F.col("comp_file")))
            by_attr = best_rank(by_attr.select("file", "host", "value", "comp", "rank", "comp_file"), ["file", "host", "value"], "rank", ["comp_file"])
            level_one = self.store.table("imports").where("scope = '' AND name IS NOT NULL").select("file", F.col("module").alias("from_module"), F.col("name"))
            told = self.named_members()
            listed = told.select("host").distinct()
            chosen = told.join(raw.where("kind = 'importall'").select("file", "host"), "host").join(classes, "comp").withColumn("rank", nearness(F.col("file"), F.col("comp_file")))
            chosen = best_rank(chosen.select("file", "host", "comp", "rank", "comp_file"), ["file", "host", "comp"], "rank", ["comp_file"])
            inits = self.modules().withColumnRenamed("file", "init_file")
            whole = raw.where(F.col("kind") == "importall").join(listed, "host", "left_anti").select(F.col("file"), "host", F.col("value").alias("module")).join(inits, "module")
            members = whole.join(level_one.withColumnRenamed("file", "init_file"), "init_file").join(self.modules().select(F.col("module").alias("member_module"), F.col("file").alias("comp_file")), F.col("member_module") == F.concat_ws(".", "from_module", "name"))
            every = members.select("file", "host", "comp_file").join(classes, "comp_file")
            parts = [x.select("host", F.col("file").alias("host_file"), "comp", "comp_file") for x in (refs, by_attr, every, chosen)]
            return reduce(DataFrame.unionByName, parts).distinct()
        return self._once("components", make)

    def class_edges(self) -> DataFrame:
        """``cls, file, up, up_file, ord``: bases left to right, each in its files by nearness, then components."""
        def make():
            classes = self.store.table("classes")
            up = classes.select(F.col("name").alias("up"), F.col("file").alias("up_file")).distinct()
            bases = classes.select(F.col("name").alias("cls"), "file", F.posexplode("bases").alias("pos", "base")).withColumn("up", last_part(F.col("base")))
            met = bases.join(up, "up").where((F.col("up") != F.col("cls")) | (F.col("up_file") != F.col("file")))
            ordered = met.select("cls", "file", "up", "up_file", F.array(F.col("pos"), nearness(F.col("file"), F.col("up_file"))).alias("step"))
            comps = self.components().select(F.col("host").alias("cls"), F.col("host_file").alias("file"), F.col("comp").alias("up"), F.col("comp_file").alias("up_file"), F.array(F.lit(COMPONENT_ORD), F.lit(0)).alias("step"))
            return ordered.unionByName(comps).withColumn("step", F.concat(F.transform("step", lambda x: F.lpad(x.cast("string"), 8, "0")), F.array("up", "up_file")))
        return self._once("class_edges", make)

    def ancestors(self) -> DataFrame:
        """``cls, file, anc, anc_file, path``: sorting by ``path`` gives the order of method lookup (depth first)."""
        def make():
            edges = self.class_edges()
            start = self.store.table("classes").select(F.col("name").alias("cls"), "file").distinct()
            met = frontier = checkpointed(start.select("cls", "file", F.col("cls").alias("anc"), F.col("file").alias("anc_file"), F.array().cast("array<string>").alias("path")))
            step = edges.select(F.col("cls").alias("anc"), F.col("file").alias("anc_file"), "up", "up_file", "step")
            keys = ["cls", "file", "anc", "anc_file"]
            while True:  # a path through a cycle is longer than the one before it, hence never better: rounds end
                ahead = frontier.join(step, ["anc", "anc_file"]).select("cls", "file", F.col("up").alias("anc"), F.col("up_file").alias("anc_file"), F.concat("path", "step").alias("path"))
                best = ahead.groupBy(*keys).agg(F.min("path").alias("path"))
                old = met.withColumnRenamed("path", "old_path")
                better = checkpointed(best.join(old, keys, "left").where("old_path IS NULL OR path < old_path").drop("old_path"))
                if not better.take(1):
                    return met
                met = checkpointed(met.join(better.select(*keys), keys, "left_anti").unionByName(better))
                frontier = better
        return self._once("ancestors", make)

    def methods(self) -> DataFrame:
        """``cls, file, method, def_file, def_line, def_cls``: what each class's lookup of each name finds."""
        def make():
            defs = self.store.table("defs").where("cls IS NOT NULL AND NOT nested").select(F.col("cls").alias("anc"), F.col("file").alias("anc_file"), F.col("name").alias("method"), F.col("line").alias("def_line"))
            met = self.ancestors().join(defs, ["anc", "anc_file"])
            best = met.groupBy("cls", "file", "method").agg(F.min(F.struct("path", "def_line", "anc", "anc_file")).alias("b"))
            return best.select("cls", "file", "method", F.col("b.anc_file").alias("def_file"), "b.def_line", F.col("b.anc").alias("def_cls"))
        return self._once("methods", make)

    def methods_on_type(self, wanted: DataFrame) -> DataFrame:
        """``wanted`` (from_file, type, method) with the definition found on the nearest class of that name."""
        found = wanted.select("from_file", "type", "method").distinct().join(self.methods().withColumnsRenamed({"cls": "type", "file": "cls_file"}), ["type", "method"])
        ranked = found.withColumn("rank", nearness(F.col("from_file"), F.col("cls_file")))
        return best_rank(ranked, ["from_file", "type", "method"], "rank", ["cls_file"]).select("from_file", "type", "method", "def_file", "def_line", "def_cls")

    # -- types of variables ---------------------------------------------------------------------------------------
    def returns(self) -> DataFrame:
        """``owner, func, type``: what a module's or a class's function builds; seeds come before facts."""
        def make():
            seeds = self.store.spark.createDataFrame([(a, b, t) for (a, b), t in sorted(self.config.ret_seeds.items())], "owner string, func string, type string").withColumn("rank", F.lit(0))
            facts = self.store.table("ret")
            plain = facts.where(~F.col("func").contains(".")).select(F.col("module").alias("owner"), "func", "type", "file", "line")
            member = facts.where(F.col("func").contains(".")).select(F.substring_index("func", ".", 1).alias("owner"), last_part(F.col("func")).alias("func"), "type", "file", "line")
            latest = plain.unionByName(member).groupBy("owner", "func").agg(F.max_by("type", F.struct("file", "line")).alias("type")).withColumn("rank", F.lit(1))
            return best_rank(seeds.unionByName(latest), ["owner", "func"], "rank", ["type"]).select("owner", "func", "type")
        return self._once("returns", make)

    def attributes(self) -> DataFrame:
        """``cls, attr, type``: seeds before facts, ``global.attr`` types followed to the class they stand for."""
        def make():
            seeds = self.store.spark.createDataFrame([(a, b, t) for (a, b), t in sorted(self.config.attr_seeds.items())], "cls string, attr string, type string").withColumn("rank", F.lit(0))
            facts = self.store.table("attr").groupBy("cls", "attr").agg(F.max_by("type", F.struct("file", "line")).alias("type")).withColumn("rank", F.lit(1))
            best = best_rank(seeds.unionByName(facts), ["cls", "attr"], "rank", ["type"]).select("cls", "attr", "type")
            pseudo = self.globals().select(F.concat_ws(".", "base", "name").alias("type"), F.col("global_type"))
            return best.join(pseudo, "type", "left").select("cls", "attr", F.coalesce("global_type", "type").alias("type"))
        return self._once("attributes", make)

    def globals(self) -> DataFrame:
        def make():
            return self.store.table("global_assign").groupBy("base", F.col("attr").alias("name")).agg(F.max_by("cls", "file").alias("global_type"))
        return self._once("globals", make)

    def scopes_seen(self, df: DataFrame) -> DataFrame:
        """One row for each scope that ``df``'s ``scope`` sees: itself, its enclosing functions, and the module ('')."""
        parts = F.split("scope", r"\.")
        prefixes = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), ".")))
        wide = df.withColumn("seen_scope", F.explode(prefixes))
        return wide.withColumn("depth", F.when(F.col("seen_scope") == "", 0).otherwise(F.size(F.split("seen_scope", r"\."))))

    def imported(self, uses: DataFrame, name: str) -> DataFrame:
        """``uses`` (file, scope and others) with the innermost import that binds its column ``name``."""
        keys = uses.select("file", "scope", F.col(name).alias("bound")).distinct()
        classes = self.store.table("scope_range").where("kind = 'class'").select("file", F.col("scope").alias("seen_scope")).distinct()
        seen = self.scopes_seen(keys).join(classes, ["file", "seen_scope"], "left_anti")
        hit = seen.join(self.visible_imports().withColumnsRenamed({"scope": "seen_scope", "name": "import_name"}), ["file", "seen_scope", "bound"])
        inner = hit.groupBy("file", "scope", "bound").agg(F.max_by(F.struct("module", "import_name"), "depth").alias("t"))
        return inner.select("file", "scope", F.col("bound").alias(name), F.col("t.module").alias("import_module"), F.col("t.import_name").alias("import_name"))

    def assigned_types(self) -> DataFrame:
        """``file, scope, var, line, ord, type`` of every assignment that tells a type."""
        def make():
            facts = self.store.table("assign_fact")
            by_import = self.imported(facts.where("head IS NOT NULL"), "head")
            a = facts.join(by_import, ["file", "scope", "head"], "left")
            own = self.store.files().select("file", "module")
            returns = self.returns()
            # x = make(): a return fact of the imported or own function, else the name is a class
            ctor = a.where("kind = 'ctor'").join(own, "file").withColumns({"owner": F.coalesce("import_module", "module"), "func": F.coalesce("import_name", "head")})
            ctor = ctor.join(returns, ["owner", "func"], "left").select("file", "scope", "var", "line", "ord", F.coalesce("type", F.coalesce("import_name", "head")).alias("type"))
            # x = module.make() and x = Class.make()
            owner = F.when(F.col("import_name").isNull(), F.coalesce("import_module", "head")).otherwise(F.concat_ws(".", "import_module", "import_name"))
            calls = a.where("kind = 'call'").withColumns({"owner": owner, "func": F.col("tail")})
            direct = calls.join(returns, ["owner", "func"]).select("file", "scope", "var", "line", "ord", "type")
            by_class = calls.where("import_name IS NOT NULL").withColumn("owner", F.col("import_name")).join(returns, ["owner", "func"]).select("file", "scope", "var", "line", "ord", "type")
            glob = a.where("kind = 'global_attr'").join(self.globals().withColumnsRenamed({"base": "head", "name": "tail", "global_type": "type"}), ["head", "tail"]).select("file", "scope", "var", "line", "ord", "type")
            selves = a.where("kind = 'self_attr'").join(self.attributes().withColumnRenamed("attr", "tail"), ["cls", "tail"]).select("file", "scope", "var", "line", "ord", "type")
            known = ctor.unionByName(direct).unionByName(by_class).unionByName(glob).unionByName(selves).groupBy("file", "scope", "var", "line", "ord").agg(F.min("type").alias("type"))
            known = checkpointed(known)
            # x = y.f(): the type of y at that place, then what its class's f builds; a few rounds reach the fixed point
            open_ = checkpointed(calls.where(~F.col("head").contains(".")).select("file", "scope", "cls", "var", "line", "ord", "head", "tail").join(known, ["file", "scope", "var", "line", "ord"], "left_anti"))
            for _ in range(TYPE_ROUNDS):
                at = self.type_at(open_.withColumnRenamed("head", "recv"), known)
                new = at.withColumnRenamed("type", "owner").join(returns.withColumnRenamed("func", "tail"), ["owner", "tail"]).select("file", "scope", "var", "line", "ord", "type")
                new = checkpointed(new.join(known.select("file", "scope", "var", "line", "ord"), ["file", "scope", "var", "line", "ord"], "left_anti").distinct())
                if not new.take(1):
                    break
                known = checkpointed(known.unionByName(new))
            return known
        return self._once("assigned_types", make)

    def type_at(self, uses: DataFrame, known: DataFrame) -> DataFrame:
        """``uses`` (file, scope, line, ord, recv) with the type of the latest solved assignment to ``recv`` in sight.

        The scope and its enclosing functions are searched inside out; in the own scope only what comes before counts.
        """
        seen = self.scopes_seen(uses.select("file", "scope", "line", "ord", "recv").distinct())
        facts = known.select("file", F.col("scope").alias("seen_scope"), F.col("var").alias("recv"), F.col("line").alias("a_line"), F.col("ord").alias("a_ord"), "type")
        hit = seen.join(facts, ["file", "seen_scope", "recv"]).where("seen_scope <> scope OR a_ord < ord")
        best = hit.groupBy("file", "scope", "line", "ord", "recv").agg(F.max_by("type", F.struct("depth", "a_line", "a_ord")).alias("type"))
        return uses.join(best, ["file", "scope", "line", "ord", "recv"])

    # -- calls ----------------------------------------------------------------------------------------------------
    def resolved(self) -> DataFrame:
        """Every call site with ``def_file, def_line, def_cls`` (null where unresolved), ``branch`` and ``recv_type``."""
        def make():
            calls = checkpointed(self.store.table("call_site"))
            keys = ["file", "line", "ord"]
            own = calls.where("recv_kind = 'self' AND cls IS NOT NULL").select(*keys, F.col("file").alias("from_file"), F.col("cls").alias("type"), F.col("callee").alias("method"))
            via_self = own.join(self.methods_on_type(own), ["from_file", "type", "method"]).select(*keys, "def_file", "def_line", "def_cls", F.lit("self").alias("branch"), F.col("type").alias("recv_type"))

            named = calls.where("recv_kind = 'name'")
            typed = checkpointed(self.type_at(named, self.assigned_types()).select(*keys, F.col("file").alias("from_file"), "type", F.col("callee").alias("method")))
            via_type = typed.join(self.methods_on_type(typed), ["from_file", "type", "method"], "left").select(*keys, "def_file", "def_line", "def_cls", F.lit("type").alias("branch"), F.col("type").alias("recv_type"))

            free = named.join(typed.select(*keys), keys, "left_anti")
            met = free.join(self.imported(free, "recv"), ["file", "scope", "recv"])
            tries = F.explode(F.array(F.struct(F.lit(0).alias("rank"), F.concat_ws(".", "import_module", "import_name").alias("module")), F.struct(F.lit(1).alias("rank"), F.col("import_module").alias("module"))))
            aimed = met.select(*keys, "callee", tries.alias("t")).select(*keys, "callee", "t.rank", "t.module").join(self.modules().withColumnRenamed("file", "def_file"), "module")
            aimed = best_rank(aimed.select(*keys, "callee", "rank", "def_file"), [*keys, "callee"], "rank", ["def_file"])
            tops = self.store.table("defs").where("cls IS NULL AND NOT nested").select(F.col("file").alias("def_file"), F.col("name").alias("callee"), F.col("line").alias("def_line"))
            single = tops.groupBy("def_file", "callee").agg(F.count("*").alias("n"), F.min("def_line").alias("def_line")).where("n = 1").drop("n")
            blank = F.lit(None).cast("string")
            via_module = aimed.join(single, ["def_file", "callee"]).select(*keys, "def_file", "def_line", blank.alias("def_cls"), F.lit("module").alias("branch"), blank.alias("recv_type"))

            everywhere = tops.groupBy("callee").agg(F.count("*").alias("n"), F.min(F.struct("def_file", "def_line")).alias("d")).where("n = 1").select("callee", F.lit(0).alias("rank"), "d.def_file", "d.def_line")
            bare = calls.where("recv_kind = 'none'").select(*keys, "callee")
            by_all = bare.join(everywhere, "callee").select(*keys, "rank", "def_file", "def_line")
            by_own = bare.join(single.withColumnRenamed("def_file", "file"), ["file", "callee"]).select(*keys, F.lit(1).alias("rank"), F.col("file").alias("def_file"), "def_line")
            via_name = best_rank(by_all.unionByName(by_own), keys, "rank", ["def_file", "def_line"]).select(*keys, "def_file", "def_line", blank.alias("def_cls"), F.lit("name").alias("branch"), blank.alias("recv_type"))

            found = via_self.unionByName(via_type).unionByName(via_module).unionByName(via_name)
            return calls.join(found, keys, "left")
        return self._once("resolved", make, kept=True)

    def call_edges(self) -> DataFrame:
        """Function to function: ``src_file, src_cls, src_func, src_line, line, dst_file, dst_cls, dst_func, dst_line``."""
        def make():
            defs = self.store.table("defs").select(F.col("file").alias("def_file"), F.col("line").alias("def_line"), F.col("cls").alias("dst_cls"), F.col("name").alias("dst_func"))
            found = self.resolved().where("def_file IS NOT NULL").join(defs, ["def_file", "def_line"])
            return found.select(
                F.col("file").alias("src_file"), F.col("cls").alias("src_cls"), F.col("func").alias("src_func"), F.col("scope").alias("src_scope"), "line",
                F.col("def_file").alias("dst_file"), "dst_cls", "dst_func", F.col("def_line").alias("dst_line"),
            )
        return self._once("call_edges", make, kept=True)

    def hosts(self) -> DataFrame:
        """``cls, file, host, host_file``: classes at run time behind a class: itself, its hosts and its subclasses.

        A subclass counts where its base's name is unique or the base is in the subclass's own file.
        """
        def make():
            classes = self.store.table("classes").select(F.col("name").alias("cls"), "file").distinct()
            unique = classes.groupBy("cls").agg(F.count("*").alias("n"))
            edges = self.class_edges().join(unique.withColumnRenamed("cls", "up"), "up")
            back = edges.where((F.col("n") == 1) | (F.col("up_file") == F.col("file")) | (F.element_at("step", 1) == F.lpad(F.lit(str(COMPONENT_ORD)), 8, "0")))
            step = checkpointed(back.select(F.col("up").alias("host"), F.col("up_file").alias("host_file"), F.col("cls").alias("next"), F.col("file").alias("next_file")).distinct())
            met = frontier = checkpointed(classes.select("cls", "file", F.col("cls").alias("host"), F.col("file").alias("host_file")), plain=True)
            while True:  # every round meets new pairs or ends
                ahead = frontier.join(step, ["host", "host_file"]).select("cls", "file", F.col("next").alias("host"), F.col("next_file").alias("host_file")).distinct()
                frontier = checkpointed(ahead.join(met, ["cls", "file", "host", "host_file"], "left_anti"), plain=True)
                if not frontier.take(1):
                    return met
                met = checkpointed(met.unionByName(frontier), plain=True)
        return self._once("hosts", make)

    def callback_edges(self) -> DataFrame:
        """Declared source to target methods of classes that can be one object: ``..., level`` is ``<KIND>-INFERRED``."""
        def make():
            raw = self.store.table("callback_raw").select("file", "line", "cls", "kind", "source", "target")
            defs = self.store.table("defs").where("cls IS NOT NULL AND NOT nested").select(F.col("file").alias("def_file"), F.col("cls").alias("def_cls"), F.col("name").alias("target"), F.col("line").alias("def_line"))
            pairs = raw.join(defs, "target").select("file", "line", "cls", "kind", "source", "target", "def_file", "def_cls", "def_line")
            hosts = self.hosts()
            one = hosts.select(F.col("cls"), F.col("file"), F.col("host").alias("host"), F.col("host_file").alias("host_file"))
            other = hosts.select(F.col("cls").alias("def_cls"), F.col("file").alias("def_file"), F.col("host").alias("host"), F.col("host_file").alias("host_file"))
            # Only the hosts of classes in a declared pair meet.
            met = pairs.join(one, ["cls", "file"]).join(other, ["def_cls", "def_file", "host", "host_file"]).select(*pairs.columns).distinct()
            return met.withColumn("level", F.concat(F.upper("kind"), F.lit("-INFERRED")))
        return self._once("callback_edges", make, kept=True)
