"""Command line over the navigation API: ``python -m navgraph.cli COMMAND ... --root TREE --store FACTS [--custom FOLDER] [--json]``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession

from navgraph.config import load_config
from navgraph.impact import Impact, changes_of
from navgraph.navigation import Answer, Navigator
from navgraph.resources import Resources
from navgraph.session import session
from navgraph.sources.store import FactStore

#: command -> its own arguments (name, type, default); a default of ... marks a required one.
COMMANDS: dict[str, list[tuple[str, type, object]]] = {
    "build": [],
    "refresh": [],
    "drift": [],
    "coverage": [("--scope", str, None)],
    "callers": [("file", str, ...), ("func", str, ...), ("--receiver-class", str, None)],
    "callees": [("file", str, ...), ("func", str, ...)],
    "usages": [("symbol", str, ...), ("--limit", int, 200)],
    "defs": [("symbol", str, ...), ("--limit", int, 200)],
    "deps": [("scope", str, ...)],
    "importers": [("scope", str, ...)],
    "hubs": [("--top", int, 25)],
    "tree": [("--depth", int, 2)],
    "find": [("pattern", str, ...), ("--limit", int, 50)],
    "file-context": [("file", str, ...)],
    "external": [("--scope", str, "")],
    "context": [("--compact", bool, False)],
    "rpc-refs": [("method", str, ...), ("--stub", str, None)],
    "pubsub-refs": [("event", str, ...), ("--side", str, None)],
    "diagnose": [],
    "ui-refs": [("view", str, ...), ("--name", str, None), ("--nodes", str, None), ("--timelines", str, None), ("--sites", str, None)],
    "blast-radius": [("files", str, ...), ("--diff", str, None), ("--old-root", str, None), ("--depth", int, 3), ("--mode", str, "full"), ("--layer", int, None), ("--offset", int, 0), ("--limit", int, 50)],
}


def parser() -> argparse.ArgumentParser:
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("--root", required=True, help="source tree")
    common.add_argument("--store", required=True, help="folder of the facts")
    common.add_argument("--custom", help="folder with config.py, seeds.py and facts.py")
    common.add_argument("--targets", nargs="*", default=[])
    common.add_argument("--refresh", choices=("auto", "check", "off"), default="auto")
    common.add_argument("--json", action="store_true")
    out = argparse.ArgumentParser(prog="navgraph")
    sub = out.add_subparsers(dest="command", required=True)
    for name, arguments in COMMANDS.items():
        p = sub.add_parser(name, parents=[common])
        for flag, kind, default in arguments:
            if name == "blast-radius" and flag == "files":
                p.add_argument(flag, nargs="*")
            elif kind is bool:
                p.add_argument(flag, action="store_true")
            elif default is ...:
                p.add_argument(flag, type=kind)
            else:
                p.add_argument(flag, type=kind, default=default)
    return out


OWN = ("command", "root", "store", "custom", "targets", "refresh", "json")


def blast(args: argparse.Namespace, nav: Navigator) -> DataFrame:
    """Files count as changed in all their functions; ``--diff`` (``-`` for the standard input) names changed lines."""
    spark = nav.store.spark
    changes = spark.createDataFrame([(f, None, None) for f in args.files], "file string, diff string, old_text string")
    if args.diff:
        text = sys.stdin.read() if args.diff == "-" else open(args.diff, encoding="utf-8", errors="replace").read()
        changes = changes.unionByName(changes_of(spark, text, args.old_root))
    impact = Impact(nav)
    if args.mode == "importers":
        return impact.importers(changes)
    items, _ = impact.closure(changes, args.depth)
    if args.mode == "summary":
        return Impact.summary(items)
    return Impact.page(items, args.layer, args.offset, args.limit) if args.mode == "page" else items


def ui_refs(args: argparse.Namespace, nav: Navigator) -> DataFrame:
    """Views ``audit``, ``grade``, ``file``, ``node`` and ``animations`` over trees and sites given as Parquet."""
    spark = nav.store.spark
    read = lambda path, shape: spark.read.parquet(path) if path else spark.createDataFrame([], shape)
    nodes = read(args.nodes, "res_key string, node_id string, parent_id string, name string, type string")
    own = Resources(nav, nodes, read(args.timelines, "res_key string, timeline string"))
    if args.view in ("file", "node"):
        return getattr(own, f"{args.view}_view")(args.name)
    if args.view == "animations":
        return own.animations()
    sites = read(args.sites, "file string, line long, cls string, func string, segments array<string>, prefix boolean")
    return {"audit": own.audit, "grade": own.grade}[args.view](sites)


def answer(args: argparse.Namespace, nav: Navigator, index: dict) -> Answer:
    given = {k: v for k, v in vars(args).items() if k not in OWN}
    whole = lambda rows: Answer(args.command, rows, nav.store.coverage().drop("issues").first().asDict(), nav.store.state() | index)
    match args.command:
        case "coverage":
            return whole(nav.store.coverage(args.scope))
        case "drift":
            return whole(nav.store.drift(nav.config))
        case "blast-radius":
            return whole(blast(args, nav))
        case "ui-refs":
            return whole(ui_refs(args, nav))
        case command:
            return nav.ask(command, index=index, **given)


def show(told: Answer, as_json: bool) -> None:
    """One JSON object with its items written as they come, or lines with tabs and the rest on the error stream."""
    about = {"query": told.query, "coverage": told.coverage, "index": told.index, "note": told.note, "elapsed": told.elapsed, "counts": told.counts()}
    if as_json:
        print(json.dumps(about, default=str, ensure_ascii=False)[:-1] + ', "items": [', end="")
    for k, row in enumerate(told.rows.toLocalIterator()):
        values = row.asDict(recursive=True)
        if as_json:
            print((", " if k else "") + json.dumps(values, default=str, ensure_ascii=False), end="")
        else:
            print("\t".join("" if v is None else str(v) for v in values.values()))
    if as_json:
        print("]}")
    else:
        print(f"coverage: {told.coverage}" + (f"; note: {told.note}" if told.note else ""), file=sys.stderr)


def run(args: argparse.Namespace, spark: SparkSession) -> Answer | dict:
    """What a command gives: figures of a build or refresh, or an answer."""
    config, store = load_config(args.root, args.custom, targets=args.targets), FactStore(spark, args.store)
    if args.command == "build":
        return store.build(config)
    told = store.refresh(config, args.refresh) if args.command != "drift" else {}
    return told if args.command == "refresh" else answer(args, Navigator(store, config), told)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    told = run(args, session())
    if isinstance(told, dict):
        print(json.dumps(told))
    else:
        show(told, args.json)
    return 0


if __name__ == "__main__":
    sys.exit(main())
