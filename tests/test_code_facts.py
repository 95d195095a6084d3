"""Made-up source trees through scan, store, resolution and navigation.

The main tree is a small weather service: ``station`` objects keep ``gauge`` readings, a ``report`` module formats them
and scripts of ``tools`` drive both. One script does not parse.
"""

import ast
import os
import time

import pytest
from pyspark.sql import functions as F

from navgraph.config import AnalysisConfig, load_config
from navgraph.hooks import FactHooks
from navgraph.navigation import NOISE, Navigator
from navgraph.sources.extract import dotted, literal_prefix, scan
from navgraph.sources.store import FactStore, StaleConfig

GAUGE = """import math


def smooth(values):
    return math.fsum(values) / len(values)


class Gauge:
    def __init__(self):
        self.rows = []

    def read(self):
        return smooth(self.rows)

    def calibrate(self):
        self.read()
        self.read


class RainGauge(Gauge):
    def drain(self):
        self.calibrate()
        self.evaporate()
"""
STATION = """from weather.gauge import RainGauge, smooth as mean
from weather import report


def open_station():
    return Station()


class Station:
    def poll(self, feed):
        probe = RainGauge()
        probe.read()
        feed.read()
        report.render(mean([1, 2]))
        probe.explode()
"""
REPORT = """def render(value):
    return frame(str(value))


def frame(text):
    return text
"""
NIGHTLY = """import sqlite3
from weather.station import open_station


def frame(text):
    return '<' + text + '>'


def nightly():
    site = open_station()
    site.poll(None)
    frame('x')
    only_here()
    sqlite3.connect('x')


def only_here():
    pass
"""
TREE = {
    "weather/__init__.py": "",
    "weather/gauge.py": GAUGE,
    "weather/station.py": STATION,
    "weather/report.py": REPORT,
    "tools/nightly.py": NIGHTLY,
    "tools/weekly.py": "from tools.nightly import only_here\n\nonly_here()\n",
    "tools/torn.py": "while True\n    render(1)\n",
}


def write(root, files):
    for path, text in files.items():
        full = os.path.join(root, path)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "w") as f:
            f.write(text)


def line_of(text, part, nth=1):
    return [k for k, line in enumerate(text.split("\n"), 1) if part in line][nth - 1]


def told(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def nav(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tree"))
    write(root, TREE)
    config = AnalysisConfig(root)
    store = FactStore(spark, str(tmp_path_factory.mktemp("store")) + "/facts")
    stats = store.build(config)
    assert (stats["files"], stats["parse_failed"]) == (len(TREE), 1)
    return Navigator(store, config)


def test_calls_through_self_bases_and_imports(nav):
    reads = told(nav.callers("weather/gauge.py", "read"), "level", "file", "line", "caller", "note")
    assert ("VERIFIED", "weather/gauge.py", line_of(GAUGE, "self.read()"), "Gauge.calibrate", None) in reads
    assert ("VERIFIED", "weather/station.py", line_of(STATION, "probe.read"), "Station.poll", None) in reads  # inherited by the variable's type
    assert ("CANDIDATE", "weather/station.py", line_of(STATION, "feed.read"), "Station.poll", "unreachable") in reads
    assert len(reads) == 3  # naming a method is no call
    assert told(nav.callers("weather/gauge.py", "smooth"), "level", "caller") == [("VERIFIED", "Gauge.read")]
    assert told(nav.callers("weather/gauge.py", "calibrate"), "level", "caller") == [("VERIFIED", "RainGauge.drain")]
    assert told(nav.callers("weather/station.py", "poll"), "level", "caller") == [("VERIFIED", "nightly")]  # what open_station() returns


def test_calls_at_the_top_of_a_module_and_in_torn_files(nav):
    assert told(nav.callers("tools/nightly.py", "only_here"), "level", "file", "caller") == [("VERIFIED", "tools/nightly.py", "nightly"), ("VERIFIED", "tools/weekly.py", "?")]
    assert ("CANDIDATE", "tools/torn.py", 2, "parse failure") in told(nav.callers("weather/report.py", "render"), "level", "file", "line", "note")


def test_a_name_defined_twice_stays_in_its_file(nav):
    assert told(nav.callers("weather/report.py", "frame"), "level", "file", "note") == [("CANDIDATE", "tools/nightly.py", f"resolved to tools/nightly.py:{line_of(NIGHTLY, 'def frame')}"), ("VERIFIED", "weather/report.py", None)]
    assert told(nav.callers("tools/nightly.py", "frame").where("level = 'VERIFIED'"), "file") == [("tools/nightly.py",)]


def test_callees_leave_out_noise(nav):
    assert told(nav.callees("weather/gauge.py", "smooth"), "symbol") == [("fsum",)]
    assert {"str", "len", "hash", "divmod"} <= set(NOISE) and "append" not in NOISE
    got = told(nav.callees("weather/station.py", "poll"), "symbol", "level")
    assert got == [("Gauge.read", "VERIFIED"), ("RainGauge", "CANDIDATE"), ("explode", "CANDIDATE"), ("mean", "CANDIDATE"), ("read", "CANDIDATE"), ("render", "VERIFIED")]


def test_answers_come_in_an_envelope(nav):
    asked = nav.ask("callers", "weather/report.py", "render")
    assert asked.coverage["status"] == "partial" and asked.coverage["parse_failed"] == 1 and asked.index["version"] == 1
    assert asked.counts() == {"verified": 1, "candidate": 1, "inferred": 0}
    assert nav.ask("deps", "tools").coverage == {"status": "partial", "files": 3, "parse_failed": 1, "issues": ["tools/torn.py"]}
    assert nav.ask("importers", "weather/gauge.py").coverage["status"] == "complete"
    assert "parse failure" in nav.ask("callers", "tools/torn.py", "render").note
    assert nav.ask("callers", "weather/none.py", "x").note == "the file is not in the index"
    assert nav.ask("callees", "weather/report.py", "absent").note == "no such function"
    assert nav.ask("file-context", "weather/none.py").note == "the file is not in the index"


def test_coverage_by_scope(nav):
    assert told(nav.store.coverage(), "files", "failed", "coverage") == [(len(TREE), 1, "partial")]
    assert told(nav.store.coverage("weather"), "coverage") == [("complete",)]


def test_imports_and_folders(nav):
    assert told(nav.importers("weather/gauge.py"), "file") == [("weather/station.py",)]
    assert told(nav.deps("tools"), "src", "dst") == [("tools/nightly.py", "weather/station.py"), ("tools/weekly.py", "tools/nightly.py")]
    assert told(nav.external(), "module", "n") == [("math", 1), ("sqlite3", 1)]
    assert nav.hubs(1).first()["n"] == 1 and nav.hub_degree() == 10 and not nav.is_hub("weather/gauge.py")
    assert ("tools", 3) in told(nav.tree(), "folder", "n")
    assert nav.find("GAUG").count() == 1 and nav.find("g_uge").count() == 0 and nav.find("%").count() == 0


def test_names(nav):
    assert nav.usages("not a name").count() == 0
    assert nav.usages("only_here").count() == 4 and nav.usages("only_here", 2).count() == 3
    assert told(nav.defs("frame"), "kind", "file") == [("function", "tools/nightly.py"), ("function", "weather/report.py")]
    assert nav.defs("Gauge").count() == 0 and nav.defs("Gauge", with_classes=True).count() == 1


def test_contexts(nav):
    station = nav.file_context("weather/station.py")
    assert {r.name for r in station.where("section = 'import'").collect()} == {"weather/gauge.py", "weather/report.py"}
    assert {r.name for r in station.where("section = 'importer'").collect()} == {"tools/nightly.py"}
    compact = nav.context(compact=True)
    assert compact.where("section = 'hub'").count() <= 10 and compact.where("section = 'coverage' AND name = 'partial' AND n = 1").count() == 1


def test_resolved_calls_stay_in_the_store(spark, nav):
    before = nav.graph.resolved().count()
    other = Navigator(FactStore(spark, nav.store.path), nav.config)
    rows = other.graph.resolved()
    assert rows.count() == before and "derived" in rows.inputFiles()[0]
    changed = Navigator(other.store, AnalysisConfig(nav.config.root, ret_seeds={("weather.station", "open_station"): "Nothing"}))
    assert changed.graph.resolved().where("callee = 'poll' AND def_file IS NOT NULL").count() == 0


def test_names_are_read_in_order(nav):
    plan = nav.usages("render")._jdf.queryExecution().executedPlan().toString()
    assert "by-name/names" in plan and "EqualTo(name,render)" in plan


def test_refresh(spark, tmp_path):
    root = str(tmp_path / "r")
    write(root, TREE)
    config, store = AnalysisConfig(root), FactStore(spark, str(tmp_path / "s"))
    store.build(config)
    assert store.drift(config).count() == 0 and store.drift_check(config, list(TREE)) == []
    time.sleep(0.05)
    write(root, {"weather/report.py": REPORT + "\n\ndef footer():\n    return frame('')\n"})
    assert told(store.drift(config), "file", "change") == [("weather/report.py", "changed")]
    assert store.drift_check(config, ["weather\\report.py", "weather/gauge.py", "tools/new.py"]) == ["weather/report.py"]
    assert store.drift_check(config, ["a", "b"], cap=1) is None and store.drift_check(config, []) == []
    assert store.refresh(config, "check") == {"mode": "check", "version": 1, "changed": 1, "stale": True}
    assert store.refresh(config, "off")["stale"] is None and store.refresh(config)["changed"] == 1
    assert Navigator(store, config).defs("footer").count() == 1
    os.remove(f"{root}/tools/weekly.py")
    write(root, {"tools/hourly.py": "def tick():\n    pass\n"})
    assert store.drift_check(config, ["tools/weekly.py", "tools/hourly.py"]) == ["tools/weekly.py", "tools/hourly.py"]
    assert told(store.drift(config), "change") == [("added",), ("removed",)]
    store.refresh(config)
    assert Navigator(store, config).defs("tick").count() == 1 and Navigator(store, config).callers("tools/nightly.py", "only_here").count() == 1
    part = AnalysisConfig(root, targets=["tools"])
    write(root, {"weather/later.py": "x = 1\n", "tools/later.py": "x = 1\n"})
    assert told(store.drift(part), "file") == [("tools/later.py",)]
    store.refresh(part)
    store.compact()
    assert store.files().where("file IN ('weather/gauge.py', 'tools/later.py')").count() == 2
    with pytest.raises(StaleConfig):
        store.refresh(AnalysisConfig(root, profiles=[("tools/*", "semantic-only")]))


FACTS = """import ast

from navgraph.hooks import FactHooks
from navgraph.sources.extract import dotted, literal_prefix


class Postal(FactHooks):
    def rpc_calls(self, call, place):
        if isinstance(call.func, ast.Name) and call.func.id == "post" and isinstance(call.args[0], ast.Constant):
            desk, method = call.args[0].value.split("/")
            return [("letter", method, desk)]
        return []

    def handlers(self, node, place):
        marks = [dotted(d.func) for d in node.decorator_list if isinstance(d, ast.Call)]
        sure = "verified" if "sorted_by" in marks else "likely"
        return [("counter", node.name, place.cls or "", sure, "decorator")] if {"sorted_by", "taken_by"} & set(marks) else []

    def receiver_types(self, call, place):
        if isinstance(call.func, ast.Attribute) and dotted(call.func.value) == "van" and place.func == "deliver":
            return [("van", "Truck", "likely", "name")]
        return []

    def pubsub_calls(self, call, place):
        side = {"hear": "listen", "ring": "publish"}.get(dotted(call.func) or "")
        key = literal_prefix(call.args[0]) if side else None
        return [(side, key[0])] if key else []

    def class_facts(self, node, place):
        return [("comp_raw", (node.name, "importall", "post.parts"))] if node.name == "Depot" else []

    def importall_members(self, host):
        return ["Crane"] if host == "Depot" else None
"""
POST = {
    "post/desk.py": "class Desk:\n    def send(self):\n        post('Bureau/weigh')\n        post('Annex/weigh')\n\n    def wait(self):\n        hear('post.bell')\n        ring('post.bell')\n        ring('bell')\n",
    "post/bureau.py": "class Bureau:\n    @sorted_by('size')\n    def weigh(self):\n        pass\n\n\nclass Annex:\n    @taken_by('hand')\n    def weigh(self):\n        pass\n\n\ndef weigh():\n    pass\n",
    "post/cars.py": "class Truck:\n    def park(self):\n        pass\n\n\nclass Bike:\n    def park(self):\n        pass\n",
    "post/road.py": "def deliver(van):\n    van.park()\n\n\ndef fetch(van):\n    van.park()\n",
    "post/parts/crane.py": "class Crane:\n    def lift(self):\n        pass\n\n\nclass Hook:\n    def lower(self):\n        pass\n",
    "post/depot.py": "class Depot:\n    def work(self):\n        self.lift()\n        self.lower()\n",
    "post/made/table.py": "class Rows:\n    cells = StrangeMark\n",
}


@pytest.fixture(scope="module")
def postal(spark, tmp_path_factory):
    """A project whose plug-ins come from a folder."""
    root, custom = str(tmp_path_factory.mktemp("post")), str(tmp_path_factory.mktemp("custom"))
    write(root, POST)
    write(custom, {"facts.py": FACTS, "config.py": "PROFILES = [('post/made/*', 'semantic-only')]\nRPC_ALIASES = {'counter': ['letter']}\nRPC_CHANNELS = {'letter': ('mail', 'out')}\n", "seeds.py": "RET_SEEDS = {('a', 'b'): 'C'}\n"})
    config = load_config(root, custom, exclude_files=["*_old.py"])
    assert config.ret_seeds == {("a", "b"): "C"} and config.exclude_files == ["*_old.py"] and config.fingerprint() != AnalysisConfig(root).fingerprint()
    store = FactStore(spark, str(tmp_path_factory.mktemp("post-store")) + "/f")
    store.build(config)
    return Navigator(store, config)


def test_remote_calls_and_handlers(postal):
    every = told(postal.rpc_refs("weigh"), "level", "symbol", "chan", "match")
    assert every == [
        ("HANDLER-INFERRED", "Annex.weigh", "counter", "direction"), ("HANDLER-VERIFIED", "Bureau.weigh", "counter", "direction"), ("NAME-ONLY", "weigh", None, "name-only"),
        ("RPC-INFERRED", "Desk.send", "mail out", None), ("RPC-INFERRED", "Desk.send", "mail out", None),
    ]
    one = told(postal.rpc_refs("weigh", "Annex"), "level", "symbol", "match")
    assert one == [("HANDLER-INFERRED", "Annex.weigh", "direction+endpoint"), ("NAME-ONLY", "Bureau.weigh", "name-only"), ("NAME-ONLY", "weigh", "name-only"), ("RPC-INFERRED", "Desk.send", None)]


def test_events_receivers_and_profiles(postal):
    assert told(postal.pubsub_refs("bell"), "event", "level") == [("bell", "EVENT-INFERRED"), ("post.bell", "EVENT-INFERRED"), ("post.bell", "LISTENER")]
    assert told(postal.pubsub_refs("post.bell", "listen"), "symbol") == [("Desk.wait",)]
    assert told(postal.callers("post/cars.py", "park", "Truck"), "level", "caller") == [("CANDIDATE", "fetch"), ("FRAMEWORK-INFERRED", "deliver")]
    assert told(postal.callers("post/cars.py", "park", "Bike"), "level", "caller") == [("CANDIDATE", "fetch")]
    assert postal.usages("StrangeMark").count() == 0 and postal.store.table("classes").where("name = 'Rows'").count() == 1
    assert postal.diagnose().count() == 0


def test_named_members_of_an_import_all_component(postal):
    assert told(postal.graph.components(), "host", "comp", "comp_file") == [("Depot", "Crane", "post/parts/crane.py")]
    got = told(postal.graph.resolved().where("file = 'post/depot.py'"), "callee", "def_cls")
    assert got == [("lift", "Crane"), ("lower", None)]


def test_scan_of_odd_sources():
    ok, rows = scan("a/b.py", "x = 1\nx += 2\n".encode(), FactHooks(), first_only=True)
    assert ok and rows["names"] == [("x", 1, 1)]
    assert scan("a.py", "class (:\n  y".encode(), FactHooks())[0] is False
    ok, rows = scan("a.py", "# \xd6\xd0\nname = 1\n".encode("latin-1"), FactHooks())
    assert ok and [n[0] for n in rows["names"]] == ["name"]
    big = "import os\n" + "DATA = [\n" + "    1,\n" * 400_000 + "]\n"
    ok, rows = scan("d.py", big.encode(), FactHooks())
    assert ok and [i[0] for i in rows["imports"]] == ["os"] and len(rows["names"]) == 1
    assert literal_prefix(ast.parse("'a%s' % x", mode="eval").body) == ("a", False)
    assert dotted(ast.parse("a.b.c", mode="eval").body) == "a.b.c"
    ok, rows = scan("p/q/r.py", b"from .. import z\nfrom .s import t\nfrom u import *\n", FactHooks())
    assert [(m, n) for m, n, *_ in rows["imports"]] == [("p", "z"), ("p.q.s", "t")]


def test_class_statements_inside_blocks():
    class Marks(FactHooks):
        def callbacks(self, node, place):
            call = node.value if isinstance(node, ast.Expr) else None
            return [("mark", call.args[0].value, call.args[1].value)] if isinstance(call, ast.Call) and dotted(call.func) == "mark" else []

    source = "class A:\n    mark('a', 'b')\n    if X:\n        mark('c', 'd')\n    else:\n        try:\n            pass\n        except E:\n            mark('e', 'f')\n    def m(self):\n        mark('g', 'h')\n"
    _, rows = scan("a.py", source.encode(), Marks())
    assert [r[3:] for r in rows["callback_raw"]] == [("a", "b"), ("c", "d"), ("e", "f")]


def test_method_lookup_is_depth_first(spark, tmp_path):
    """A chain deeper than any fixed number of rounds, a diamond, and a class that is its own base."""
    chain = "class L0:\n    def deep(self):\n        pass\n" + "".join(f"\n\nclass L{k}(L{k - 1}):\n    pass\n" for k in range(1, 40))
    source = chain + "\n\nclass Wide:\n    def deep(self):\n        pass\n\n    def wide(self):\n        pass\n\n\nclass Both(L39, Wide):\n    def go(self):\n        self.deep()\n        self.wide()\n\n\nclass Loop(Loop):\n    def spin(self):\n        self.nowhere()\n"
    root = str(tmp_path / "r")
    write(root, {"m.py": source})
    config, store = AnalysisConfig(root), FactStore(spark, str(tmp_path / "s"))
    store.build(config)
    got = {r.callee: r.def_cls for r in Navigator(store, config).graph.resolved().where(F.col("recv_kind") == "self").collect()}
    assert got == {"deep": "L0", "wide": "Wide", "nowhere": None}
