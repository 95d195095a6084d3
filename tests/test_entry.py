"""The driver's entry points, with and without the corpus subpackage."""

import os
import subprocess
import sys

import __spark_entry__

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert rows and rows == sorted(rows, key=lambda r: -r["n"])


def test_every_kernel_query_has_sql():
    found, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(found)
    assert {name for name in found if not name.startswith("op") and name != "pipeline"} <= set(sql)


def test_import_without_the_corpus_subpackage():
    code = "import sys; sys.modules['navgraph.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; print(len(e.queries()), [n for n in e.queries() if n.startswith('op')])"
    said = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0 and said.stdout.split()[1] == "[]" and int(said.stdout.split()[0]) >= 25


def test_nothing_else_imports_it():
    for folder, _, names in os.walk(os.path.join(ROOT, "navgraph")):
        if os.path.basename(folder) == "llm":
            continue
        for name in names:
            if name.endswith(".py"):
                with open(os.path.join(folder, name)) as f:
                    assert "navgraph.llm" not in f.read()
