"""Code-fact questions whose plans or tables must not grow with the square of the code base."""

import pytest
from pyspark.sql import functions as F

from navgraph.config import AnalysisConfig
from navgraph.impact import Impact
from navgraph.navigation import Navigator
from navgraph.plans import codebase
from navgraph.resources import Resources
from navgraph.sources.store import FrameStore

SF = "/root/testdata/sf0.01"


@pytest.fixture
def small_broadcasts(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "256k")  # as on tables of some size, of which none is broadcast whole
    yield
    spark.conf.set(key, before)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_external_joins_no_product(spark, small_broadcasts):
    assert "CartesianProduct" not in plan(codebase.code_external(spark, SF))


def test_a_store_reads_each_footer_once(spark):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("store", "store")
    try:
        codebase.store(spark, "/root/testdata/sf0.01/")
        assert len(tracker.getJobIdsForGroup("store")) <= 3 * len(codebase.TABLES)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_a_table_is_made_when_it_is_asked_for(spark, monkeypatch):
    made, real = [], codebase._facts
    monkeypatch.setattr(codebase, "_facts", lambda spark, sf_dir, sql: made.append(sql) or real(spark, sf_dir, sql))
    own = codebase.store(spark, SF)
    assert made == [codebase.FILES]
    assert own.table("defs").columns == own.table("defs").columns
    assert made == [codebase.FILES, codebase.FRAMES["defs"]]


def test_remote_calls_meet_at_the_frontier(spark):
    """The kept edges hold calls and callbacks; the pairs of all remote calls and all methods of a name are not in them."""
    own = Impact(codebase.navigator(spark, SF))
    calls = own.nav.store.table("rpc").count()
    assert own.edges().where("via = 'rpc'").count() == 0
    assert own.remote_calls().count() <= calls


def test_a_path_is_looked_up_once_in_a_tree(spark, monkeypatch):
    looked, real = [], Resources.hits

    def hits(self, wanted):
        looked.append(wanted.count())
        return real(self, wanted)

    monkeypatch.setattr(Resources, "hits", hits)
    own, sites = codebase._resources(spark, SF)
    assert own.grade(sites).count() == sites.count()
    trees = own.nodes.select("res_key").distinct().count()
    assert max(looked) <= trees * sites.where("prefix IS NOT NULL").select("segments", "prefix").distinct().count() < sites.count()


def test_an_audit_grades_once(spark):
    own, sites = codebase._resources(spark, SF)
    assert "part.parquet" not in plan(own.audit(sites))  # counts and examples read the kept grades


def test_context_joins_no_product(spark, small_broadcasts):
    assert "CartesianProduct" not in plan(codebase.code_context(spark, SF))


def test_context_reads_every_import_once(spark):
    own, read = codebase.store(spark, SF), spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(module):
        read.add(1)
        return module

    imports = own.table("imports")
    counted = imports.withColumn("module", seen.asNondeterministic()("module"))
    told = Navigator(FrameStore(spark, own.files(), own._tables | {"imports": counted}), AnalysisConfig(SF)).context(compact=True).collect()
    assert read.value == imports.count() == {r["name"]: r["n"] for r in told if r["section"] == "table"}["imports"]


def test_context_tells_the_hubs_and_modules_of_the_whole(spark):
    """Two names of one file, a file that imports itself, repeats, modules outside with and without a name, no module."""
    files = spark.createDataFrame([(m.replace(".", "/") + ".py", m, 1, True, "full") for m in ("a", "p.b", "p.c", "p.d")], "file string, module string, length long, parse_ok boolean, profile string")
    rows = [("a.py", "p", "b"), ("a.py", "p.b", None), ("a.py", "p.b", "f"), ("p/b.py", "p.b", "f"), ("p/c.py", "p.b", "f"), ("p/c.py", "p.b", "g"), ("p/c.py", "p", "c")]
    rows += [("a.py", "os", None), ("p/c.py", "os", "path"), ("p/d.py", "os", "path"), ("p/d.py", "p", "x"), ("p/d.py", "", "y"), ("p/d.py", "a", None)]
    imports = spark.createDataFrame([(*row, k) for k, row in enumerate(rows)], "file string, module string, name string, line long")
    imports = imports.withColumns({"alias": F.lit(None).cast("string"), "scope": F.lit("")})
    told = Navigator(FrameStore(spark, files, {"imports": imports}), AnalysisConfig(SF)).context()
    found = {s: [(r["name"], r["n"]) for r in told.where(F.col("section") == s).collect()] for s in ("hub", "external", "table")}
    assert found["hub"] == [("p/b.py", 2), ("a.py", 1)]
    assert found["external"] == [("os", 3), ("p", 1)]
    assert dict(found["table"]) == {"defs": 0, "classes": 0, "imports": len(rows), "call_site": 0}


def test_importers_of_few_files_make_no_edges_of_all(spark, small_broadcasts):
    nav = Navigator(codebase.store(spark, SF), AnalysisConfig(SF))
    changes = spark.createDataFrame([("ext_3.py", None, None), (nav.store.files().first()["file"], None, None)], "file string, diff string, old_text string")
    found = Impact(nav).importers(changes)
    assert "CartesianProduct" not in plan(found) and "Generate explode" not in plan(found)  # names are taken apart once each, before
    assert "import_edges" not in nav.graph._made
    assert {r["imports"] for r in found.collect()} == {r["file"] for r in changes.collect()}
