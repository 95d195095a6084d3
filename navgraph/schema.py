"""Fact tables. A file's facts are one row with an array of structs for each table; the tables are views of it."""

from __future__ import annotations

import pyarrow as pa

_S, _L, _B = "string", "long", "boolean"

#: Columns of each fact table beside ``file``.
FACTS: dict[str, dict[str, str]] = {
    "names": {"name": _S, "line": _L, "col": _L},
    "defs": {"line": _L, "end_line": _L, "cls": _S, "name": _S, "scope": _S, "nested": _B},
    "classes": {"name": _S, "bases": "array<string>", "line": _L, "end_line": _L, "header_start": _L, "first_method": _L},
    "imports": {"module": _S, "name": _S, "alias": _S, "line": _L, "scope": _S},
    "attr": {"cls": _S, "attr": _S, "type": _S, "line": _L},
    "global_assign": {"base": _S, "attr": _S, "cls": _S},
    "ret": {"module": _S, "func": _S, "type": _S, "line": _L},
    "comp_raw": {"host": _S, "kind": _S, "value": _S},
    "rpc": {"line": _L, "chan": _S, "method": _S, "stub": _S},
    "receiver_fact": {"line": _L, "expr": _S, "type": _S, "confidence": _S, "reason": _S},
    "rpc_handler": {"line": _L, "chan": _S, "method": _S, "endpoint": _S, "confidence": _S, "reason": _S},
    "pubsub": {"line": _L, "side": _S, "event": _S, "func": _S, "cls": _S},
    "callback_raw": {"line": _L, "cls": _S, "kind": _S, "source": _S, "target": _S},
    "ui_binding": {"line": _L, "kind": _S, "key": _S, "receiver": _S, "cls": _S, "func": _S},
    "call_site": {"line": _L, "ord": _L, "recv_kind": _S, "recv": _S, "callee": _S, "cls": _S, "func": _S, "func_line": _L, "scope": _S},
    "assign_fact": {"line": _L, "ord": _L, "scope": _S, "cls": _S, "var": _S, "kind": _S, "head": _S, "tail": _S},
    "scope_range": {"start": _L, "end": _L, "scope": _S, "kind": _S},
    "module_stmt": {"line": _L, "end_line": _L, "kind": _S},
}

_ARROW = {_S: pa.string(), _L: pa.int64(), _B: pa.bool_(), "array<string>": pa.list_(pa.string())}


def fact_ddl() -> str:
    """DDL of the nested columns."""
    parts = []
    for table, columns in FACTS.items():
        inside = ", ".join(f"{c}: {t}" for c, t in columns.items())
        parts.append(f"{table} array<struct<{inside}>>")
    return ", ".join(parts)


def fact_arrow(table: str) -> pa.DataType:
    return pa.list_(pa.struct([(c, _ARROW[t]) for c, t in FACTS[table].items()]))
