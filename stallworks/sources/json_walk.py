"""JSON of page scripts as flat rows: the helper that runs inside the page jobs' tasks.

Which rows are lists, references or fields of a company is decided in the plan.
(Variants would keep the work in the JVM, but they sort the keys of objects, and
the first of several names counts in document order.)
"""

from __future__ import annotations

import json
import re


def parse(text: str):
    """The document, or None where it is broken or nested too deep to be read."""
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return None


def assigned(text: str, name: str):
    """JSON value assigned to a script variable: on ``window``, by ``var``, or bare, in this order."""
    pattern = re.compile(rf"(?:(window\.)|(var\s+)|\b){re.escape(name)}\s*=\s*(?=[{{\[])")
    found = sorted(pattern.finditer(text), key=lambda m: (not m[1], not m[2], m.start()))
    decoder = json.JSONDecoder()
    for match in found:
        try:
            return decoder.raw_decode(text, match.end())[0]
        except (ValueError, RecursionError):
            continue
    return None


def nodes(document) -> list[dict]:
    """Every value of a document as a row, in document order: what it is, its key, and the row number of what holds it."""
    rows: list[dict] = []
    waiting = [(None, None, document)]
    while waiting:
        parent, key, value = waiting.pop()
        row = {"no": len(rows), "parent": parent, "key": key, "kind": "other", "text": "", "size": 0}
        rows.append(row)
        if isinstance(value, (dict, list)):
            members = list(value.items()) if isinstance(value, dict) else [(None, v) for v in value]
            row |= {"kind": "object" if isinstance(value, dict) else "list", "size": len(members)}
            waiting += [(row["no"], k, v) for k, v in reversed(members)]
        elif isinstance(value, str):
            row |= {"kind": "text", "text": value}
        elif value:
            row["text"] = str(value)
    return rows


def texts(blocks: list[str]) -> list[dict]:
    """Texts of all blocks in document order: number of the object around, own key, and the nearest key on the way up."""
    out: list[dict] = []
    before = 0
    for block in blocks:
        rows = nodes(parse(block))
        for row in rows:
            up = rows[row["parent"]] if row["parent"] is not None else None
            row["label"] = row["key"] if row["key"] is not None else up["label"] if up else None
            row["owner"] = None if up is None else up["no"] if up["kind"] == "object" else up["owner"]
            if row["kind"] == "text" and row["owner"] is not None:
                out.append({"owner": before + row["owner"], "key": row["key"], "label": row["label"], "text": row["text"]})
        before += len(rows)
    return out


def leaves(document) -> list[dict]:
    """Scalars and lists of a document in document order, each with its path (keys, and places in lists)."""
    rows: list[dict] = []
    waiting = [([], document)]
    while waiting:
        path, value = waiting.pop()
        if isinstance(value, dict):
            waiting += [([*path, key], member) for key, member in reversed(value.items())]
            continue
        if isinstance(value, list):
            waiting += [([*path, str(place)], value[place]) for place in range(len(value) - 1, -1, -1)]
        text = value if isinstance(value, str) else "" if isinstance(value, list) or not value else str(value)
        rows.append({"no": len(rows), "path": path, "members": len(value) if isinstance(value, list) else None, "text": text})
    return rows
