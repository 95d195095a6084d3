"""Resource grading on a small tree, the command line, and the streamed index."""

import io
import json

import pytest
from test_code_facts import told, write

from navgraph.cli import COMMANDS, main, parser
from navgraph.config import AnalysisConfig
from navgraph.hooks import FactHooks
from navgraph.navigation import Navigator
from navgraph.operators.index import token_index
from navgraph.resources import LEVELS, Resources
from navgraph.server import caller, serve
from navgraph.sources.extract import dotted
from navgraph.sources.store import FactStore
from navgraph.streaming.token_stream import start_index


class Screens(FactHooks):
    def resource_calls(self, call, place):
        kinds = {"bind": "bind", "load": "anim_load", "play": "anim_play", "hold": "host"}
        name = (dotted(call.func) or "").split(".")
        if name[-1] in kinds and call.args and hasattr(call.args[0], "value"):
            return [(kinds[name[-1]], call.args[0].value, name[0] if len(name) > 1 else None)]
        return []


SOURCE = """class Base(object):
    def setup(self):
        bind('main')


class Panel(Base):
    def show(self):
        a.load('fx')
        a.play('glow')
        a.play('absent')


class Item(object):
    def draw(self):
        pass


class Owner(Panel):
    def fill(self):
        hold('Item')


class Lost(object):
    def here(self):
        bind('nowhere')
"""


@pytest.fixture(scope="module")
def resources(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("res"))
    write(root, {"ui.py": SOURCE})
    config = AnalysisConfig(root, hooks=Screens())
    store = FactStore(spark, str(tmp_path_factory.mktemp("res-store")) + "/f")
    store.build(config)
    nodes = spark.createDataFrame([("main", "1", None, "root", "Panel"), ("main", "2", "1", "list", "List"), ("main", "3", "2", "row", "Item"), ("main", "4", "2", "row", "Item"), ("main", "5", "1", "title", "Text"), ("fx", "1", None, "fx", "Anim")], "res_key string, node_id string, parent_id string, name string, type string")
    timelines = spark.createDataFrame([("fx", "glow")], "res_key string, timeline string")
    return Resources(Navigator(store, config), nodes, timelines)


def test_levels(spark, resources):
    sites = spark.createDataFrame([
        ("ui.py", 1, "Panel", None, ["list"], False, "ListView"), ("ui.py", 2, "Panel", None, ["root", "row"], False, "TextView"),
        ("ui.py", 3, "Panel", None, ["tit"], True, "TextView"), ("ui.py", 4, "Panel", None, ["zzz"], True, None),
        ("ui.py", 5, "Panel", None, ["zzz"], False, None), ("ui.py", 6, "Item", None, ["title"], False, None),
        ("ui.py", 7, "Item", None, ["zzz"], False, None), ("ui.py", 8, "Absent", None, ["list"], False, None),
        ("ui.py", 9, "Panel", None, ["x"], None, None),
    ], "file string, line long, cls string, func string, segments array<string>, prefix boolean, wrapper string")
    got = {r.line: (r.level, r.n) for r in resources.grade(sites).collect()}
    assert got == {1: ("EXACT", 1), 2: ("MULTI", 2), 3: ("EXACT", 1), 4: ("PATTERN", 0), 5: ("MISS", 0), 6: ("INDIRECT", 1), 7: ("MISS", 0), 8: ("UNBOUND", 0), 9: ("DYNAMIC", 0)}
    tally = {r.level: r.n for r in resources.audit(sites).collect()}
    assert tally == {"EXACT": 2, "MULTI": 1, "PATTERN": 1, "INDIRECT": 1, "UNBOUND": 1, "MISS": 2, "DYNAMIC": 1}
    rules = spark.createDataFrame([("Text", ["Text"]), ("List", ["List"])], "prefix string, types array<string>")
    assert told(resources.type_mismatches(sites, rules), "line", "type") == [(2, "Item")]


def test_views(resources):
    assert told(resources.animations(), "timeline", "res_key", "level") == [("absent", None, "MISS"), ("glow", "fx", "ANIM-PLAY")]
    assert told(resources.file_view("ui.py"), "cls", "level") == [("Base", "BIND"), ("Lost", "RES-MISS"), ("Owner", "BIND_INHERIT"), ("Panel", "BIND_INHERIT")]
    assert resources.node_view("main").count() == 1 and resources.node_view("m_in").count() == 0


def test_command_line(spark, tmp_path, capsys):
    root, store = str(tmp_path / "r"), str(tmp_path / "s")
    write(root, {"src/demo.py": "class Hello(object):\n    def hi(self):\n        pass\n"})
    for name in COMMANDS:
        words = [name, *["x"] * sum(d is ... for _, _, d in COMMANDS[name])]
        assert parser().parse_args([*words, "--root", root, "--store", store, "--json", "--refresh", "off"]).command == name
    assert main(["build", "--root", root, "--store", store]) == 0
    assert json.loads(capsys.readouterr().out)["files"] == 1
    assert main(["defs", "hi", "--root", root, "--store", store, "--json"]) == 0
    told = json.loads(capsys.readouterr().out)
    assert told["items"][0]["symbol"] == "Hello.hi" and told["coverage"]["status"] == "complete" and told["index"]["version"] == 1
    assert main(["blast-radius", "src/demo.py", "--mode", "summary", "--root", root, "--store", store]) == 0


def test_server(spark, tmp_path):
    root, store = str(tmp_path / "r"), str(tmp_path / "s")
    write(root, {"src/demo.py": "class Hello(object):\n    def hi(self):\n        pass\n"})
    messages = [
        {"id": 1, "method": "initialize", "params": {}}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "ping"},
        {"id": 4, "method": "tools/call", "params": {"name": "defs", "arguments": {"symbol": "hi"}}}, {"id": 5, "method": "tools/call", "params": {"name": "defs", "arguments": {}}},
        {"id": 6, "method": "nothing"},
    ]
    out = io.StringIO()
    serve([*map(json.dumps, messages), "{", ""], out, caller(spark, root, store, None))
    replies = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [r["id"] for r in replies] == [1, 2, 3, 4, 5, 6, None]
    assert {t["name"] for t in replies[1]["result"]["tools"]} == set(COMMANDS)
    told = json.loads(replies[3]["result"]["content"][0]["text"])
    assert [i["symbol"] for i in told["items"]] == ["Hello.hi"] and told["coverage"]["status"] == "complete" and not replies[3]["result"]["isError"]
    assert replies[4]["result"]["isError"] and replies[5]["error"]["code"] == -32601 and replies[6]["error"]["code"] == -32700


def test_resource_views_on_the_command_line(spark, resources, tmp_path, capsys):
    resources.nodes.write.parquet(str(tmp_path / "nodes"))
    store = resources.nav.store
    common = ["--root", resources.nav.config.root, "--store", store.path, "--refresh", "off", "--nodes", str(tmp_path / "nodes")]
    assert main(["ui-refs", "file", "--name", "ui.py", *common]) == 0
    assert "Lost\tnowhere\tRES-MISS" in capsys.readouterr().out.splitlines()
    assert main(["ui-refs", "audit", *common, "--json"]) == 0
    assert {i["level"]: i["n"] for i in json.loads(capsys.readouterr().out)["items"]} == dict.fromkeys(LEVELS, 0)


def test_streamed_index(spark, tmp_path):
    docs, index = str(tmp_path / "docs"), str(tmp_path / "index")
    for k in range(2):
        spark.createDataFrame([(k, f"alpha beta\nalpha {'x' * k}")], "doc_id long, text string").write.mode("append").parquet(docs)
        start_index(spark, docs, "doc_id long, text string", index, str(tmp_path / "state")).awaitTermination()
    got = told(spark.read.parquet(index), "doc_id", "line", "ord", "token")
    assert got == told(token_index(spark.read.parquet(docs), "doc_id", "text"), "doc_id", "line", "ord", "token") and len(got) == 7
