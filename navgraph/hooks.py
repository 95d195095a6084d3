"""Framework knowledge as plug-ins.

A project that builds on a framework subclasses ``FactHooks`` and returns facts for what it recognises in the syntax
tree. Instances are shipped to the executors, so they must be picklable. Fact methods return lists of tuples in the
column order of ``schema.FACTS`` without file, line and enclosing names, which the scan adds.
"""

from __future__ import annotations

import ast
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass
class ScanPlace:
    """Where in a file the scan stands when it calls a hook."""

    path: str
    module: str
    cls: str | None = None
    func: str | None = None
    #: Name in sight -> module or ``module.name``.
    imports: dict[str, str] = field(default_factory=dict)
    function_node: ast.AST | None = None


class FactHooks:
    def value_type(self, value: ast.expr, place: ScanPlace) -> str | None:
        """Type of an assigned value that is no plain constructor call."""
        return None

    def class_facts(self, node: ast.ClassDef, place: ScanPlace) -> list[tuple[str, tuple]]:
        """(table, row) pairs for a class; rows without ``file``."""
        return []

    def class_statement(self, node: ast.stmt, place: ScanPlace) -> tuple[str, tuple] | None:
        """One (table, row) for a statement of a class body."""
        return None

    def callbacks(self, node: ast.stmt, place: ScanPlace) -> list[tuple[str, str, str]]:
        """(kind, source, target) that a statement of a class body declares."""
        return []

    def importall_members(self, host: str) -> list[str] | None:
        """Names that an import-all component of ``host`` brings; None takes its package's own imports."""
        return None

    def rpc_calls(self, call: ast.Call, place: ScanPlace) -> list[tuple[str, str, str | None]]:
        """(channel, method, stub)."""
        return []

    def handlers(self, node: ast.FunctionDef, place: ScanPlace) -> list[tuple[str, str, str, str, str]]:
        """(channel, method, endpoint, confidence, reason)."""
        return []

    def pubsub_calls(self, call: ast.Call, place: ScanPlace) -> list[tuple[str, str]]:
        """(listen or publish, event)."""
        return []

    def resource_calls(self, call: ast.Call, place: ScanPlace) -> list[tuple[str, str, str | None]]:
        """(kind, key, receiver)."""
        return []

    def receiver_types(self, call: ast.Call, place: ScanPlace) -> list[tuple[str, str, str, str]]:
        """(receiver expression, type, confidence, reason)."""
        return []

    def built(self, store, config) -> None:
        """After a build; an exception is reported, not raised."""

    def diagnostics(self, store, config) -> DataFrame | None:
        """A table with code, severity, file, line, class, property and message."""
        return None
