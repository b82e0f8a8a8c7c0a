"""Command files: builders, JSON reader and writer."""

from __future__ import annotations

import json
from collections.abc import Iterable

from termloom.operators.context_types import ContextSchema
from termloom.plans import query as Q

NAMES = ("search", "completion", "select", "insert", "update", "delete", "delete-by-query", "insert-context", "delete-context", "load", "store", "status", "noop")


def search(q: Q.Query | str, offset: int = 0, most: int = -1, weight: bool = False, fields: list[str] | None = None) -> dict:
    c = {"cmd": "search", "query": _query(q), "offset": offset, "max": most}
    return c | ({"weight": True} if weight else {}) | ({"fields": fields} if fields is not None else {})


def completion(q: Q.Query | str, most: int = -1) -> dict:
    return {"cmd": "completion", "text": _query(q), "max": most}


def select(q: Q.Query | str) -> dict:
    return {"cmd": "select", "query": _query(q)}


def insert(document: dict) -> dict:
    return {"cmd": "insert", "document": document}


def update(document: dict) -> dict:
    return {"cmd": "update", "document": document}


def delete(uri: str) -> dict:
    return {"cmd": "delete", "uri": uri}


def delete_by_query(q: Q.Query | str) -> dict:
    return {"cmd": "delete-by-query", "query": _query(q)}


def insert_context(name: str, schema: ContextSchema) -> dict:
    return {"cmd": "insert-context", "context": name, "schema": schema.to_json()}


def delete_context(name: str) -> dict:
    return {"cmd": "delete-context", "context": name}


def store(path: str) -> dict:
    return {"cmd": "store", "path": path}


def load(path: str) -> dict:
    return {"cmd": "load", "path": path}


def status(what: str) -> dict:
    return {"cmd": "status", "status": what}


def noop() -> dict:
    return {"cmd": "noop"}


def sequence(commands: Iterable[dict]) -> list[dict]:
    return list(commands)


def _query(q: Q.Query | str) -> dict | str:
    return q if isinstance(q, str) else Q.to_json(q)


def loads(text: str) -> dict | list:
    """A command or a sequence; ValueError for an unknown name, anywhere."""
    value = json.loads(text)
    for c in value if isinstance(value, list) else [value]:
        if isinstance(c, list):
            loads(json.dumps(c))
        elif not isinstance(c, dict) or c.get("cmd") not in NAMES:
            raise ValueError(f"no command: {str(c)[:80]}")
    return value


def dumps(command: dict | list) -> str:
    return json.dumps(command, ensure_ascii=False)


def document(uri: str, index: dict[str, str] | None = None, description: dict | None = None, weight: float | None = None) -> dict:
    """An ingest record; what is not set is left out."""
    parts = {"uri": uri, "index": index, "description": description, "weight": weight}
    return {k: v for k, v in parts.items() if v is not None}
