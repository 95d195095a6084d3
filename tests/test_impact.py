"""Diffs, changed functions and closures over a made-up bakery; the layer kernel against a plain search."""

import os
import random
import time
from collections import defaultdict

import pytest
from test_code_facts import line_of, told, write

from navgraph.cli import main
from navgraph.config import AnalysisConfig
from navgraph.impact import Impact, changes_of, hunks
from navgraph.navigation import Navigator
from navgraph.operators import graph, tables
from navgraph.sources.store import FactStore

OVEN = """HEAT = 220


def knead(dough):
    return dough * 2


def rest(dough):
    return dough


class Oven:
    door = 'shut'

    def bake(self, dough):
        return knead(dough)

    def clean(self):
        return None
"""
SHOP = """from bakery.oven import Oven, rest
import bakery.oven


def morning():
    oven = Oven()
    oven.bake(1)


def opening():
    morning()
    rest(2)
"""
TREE = {"bakery/__init__.py": "", "bakery/oven.py": OVEN, "shop/day.py": SHOP}


@pytest.fixture(scope="module")
def impact(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("bakery"))
    write(root, TREE)
    config = AnalysisConfig(root)
    store = FactStore(spark, str(tmp_path_factory.mktemp("bakery-store")) + "/f")
    store.build(config)
    return Impact(Navigator(store, config))


def change(spark, *rows):
    return spark.createDataFrame(list(rows), "file string, diff string, old_text string")


def at(first, last=None):
    """A hunk that replaces these lines by as many."""
    n = (last or first) - first + 1
    return f"@@ -{first},{n} +{first},{n} @@"


def test_hunk_headers(spark):
    diff = "@@ -7 +8,4 @@ class A:\n+x\n@@ -30,5 +33,0 @@\n-y\n not @@ -1 +1 @@\n@@ -50,0 +49 @@"
    assert told(hunks(change(spark, ("f", diff, None))), "side", "first", "last") == [("new", 49, 49), ("new", 8, 11), ("old", 30, 34), ("old", 7, 7)]


def test_what_a_diff_changes(spark, impact):
    changed = lambda *diff, old=OVEN: told(impact.changed_functions(change(spark, ("bakery/oven.py", "\n".join(diff), old))), "name", "state")
    assert changed(at(line_of(OVEN, "return knead"))) == [("bake", "changed")]
    assert changed(at(line_of(OVEN, "door"))) == [("bake", "changed"), ("clean", "changed")]  # the class's own lines
    assert changed(at(line_of(OVEN, "return dough * 2"), line_of(OVEN, "def rest"))) == [("knead", "changed"), ("rest", "changed")]
    older = OVEN + "\n    def burn(self):\n        pass\n"
    assert changed(f"@@ -{line_of(older, 'burn') - 1},3 +{len(OVEN.splitlines())},0 @@", old=older) == [("burn", "deleted")]
    assert told(impact.changed_functions(change(spark, ("shop/day.py", None, None))), "name") == [("morning",), ("opening",)]
    assert told(impact.changed_statements(change(spark, ("bakery/oven.py", at(1), None))), "kind") == [("assign",)]


def test_layers_of_callers(spark, impact):
    kneading = change(spark, ("bakery/oven.py", at(line_of(OVEN, "return dough * 2")), None))
    items, cut = impact.closure(kneading, depth=0)
    assert not cut and told(items, "layer", "target", "caller", "via") == [(1, "knead", "Oven.bake", "call"), (2, "Oven.bake", "morning", "call"), (3, "morning", "opening", "call")]
    assert impact.closure(kneading, depth=2)[0].count() == 2
    few, cut = impact.closure(kneading, depth=0, max_edges=1)
    assert cut and told(few, "layer") == [(1,)]
    assert told(Impact.summary(items), "layer", "n", "callers") == [(1, 1, 1), (2, 1, 1), (3, 1, 1)]
    page = Impact.page(items, limit=1, offset=1).collect()
    assert [(r.layer, r.total, r.has_more, r.next_offset) for r in page] == [(2, 3, True, 2)]


def test_importers_of_files_there_and_gone(spark, tmp_path):
    root = str(tmp_path / "r")
    write(root, TREE | {"shop/night.py": "from bakery import oven\n", "shop/else.py": "import bakeryware\nfrom bakery.ovens import x\n"})
    config, store = AnalysisConfig(root), FactStore(spark, str(tmp_path / "s"))
    store.build(config)
    gone = change(spark, ("bakery/oven.py", None, None))
    expected = [("shop/day.py",), ("shop/night.py",)]
    assert told(Impact(Navigator(store, config)).importers(gone), "file") == expected
    os.remove(f"{root}/bakery/oven.py")
    store.refresh(config)
    assert told(Impact(Navigator(store, config)).importers(gone), "file") == expected


def test_callers_of_deleted_functions_come_from_before(spark, tmp_path):
    root = str(tmp_path / "r")
    write(root, TREE)
    config, store = AnalysisConfig(root), FactStore(spark, str(tmp_path / "s"))
    store.build(config)
    time.sleep(0.05)
    first = line_of(OVEN, "def rest")
    write(root, {"bakery/oven.py": OVEN.replace("def rest(dough):\n    return dough\n\n\n", "")})
    store.refresh(config)
    items, _ = Impact(Navigator(store, config)).closure(change(spark, ("bakery/oven.py", f"@@ -{first},4 +{first - 1},0 @@", OVEN)))
    assert told(items, "target", "caller", "via") == [("rest", "opening", "snapshot")]


DIFF = f"""diff --git a/bakery/oven.py b/bakery/oven.py
index 1..2 100644
--- a/bakery/oven.py
+++ b/bakery/oven.py
@@ -{line_of(OVEN, "return dough * 2")} +{line_of(OVEN, "return dough * 2")} @@ def knead(dough):
-    return dough * 3
+    return dough * 2
diff --git a/shop/old.py b/shop/old.py
--- a/shop/old.py
+++ /dev/null
@@ -1,2 +0,0 @@
-def leave():
-    pass
"""


def test_diffs_as_version_control_prints_them(spark, impact, tmp_path, capsys):
    write(str(tmp_path), {"shop/old.py": "def leave():\n    pass\n", "d.diff": DIFF})
    changes = changes_of(spark, DIFF, str(tmp_path))
    assert told(changes, "file", "old_text") == [("bakery/oven.py", None), ("shop/old.py", "def leave():\n    pass\n")]
    assert told(impact.changed_functions(changes), "file", "name", "state") == [("bakery/oven.py", "knead", "changed"), ("shop/old.py", "leave", "deleted")]
    nav = impact.nav
    assert main(["blast-radius", "--diff", f"{tmp_path}/d.diff", "--mode", "summary", "--root", nav.config.root, "--store", nav.store.path, "--refresh", "off"]) == 0
    assert capsys.readouterr().out.splitlines() == ["1\t1\t1", "2\t1\t1", "3\t1\t1"]


@pytest.mark.parametrize("seed", range(3))
def test_layers_on_random_graphs(spark, seed):
    rng = random.Random(seed)
    n = rng.randint(5, 40)
    pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(4, 90))]
    ahead = defaultdict(set)
    for a, b in pairs:
        ahead[a].add(b)
    seeds = rng.sample(range(n), 2)
    expected, here = dict.fromkeys(seeds, 0), set(seeds)
    for depth in range(1, n + 1):
        here = {b for a in here for b in ahead[a]} - expected.keys()
        expected |= dict.fromkeys(here, depth)
    found = graph.layers(spark.createDataFrame([*pairs, (None, 1)], "src int, dst int"), spark.createDataFrame([(s,) for s in seeds], "node int"))
    assert {r.node: r.layer for r in found.collect()} == expected


def test_pairs_on_a_long_chain(spark):
    found = graph.reachable_pairs(spark.createDataFrame([(k, k + 1) for k in range(36)], "src int, dst int"))
    assert found.count() == 37 * 38 // 2


def test_page_limits(spark):
    with pytest.raises(ValueError):
        tables.page(spark.range(5), ["id"], 0, 201)
