"""Paper records as YAML: a writer and a reader of the block style it writes, by the standard library alone where PyYAML is absent."""

from __future__ import annotations

import json
import os
import re

try:
    import yaml
except ImportError:
    yaml = None


def dump(value: dict) -> str:
    if yaml is not None:
        return yaml.safe_dump(value, allow_unicode=True, sort_keys=False)
    return _lines(value, 0)


def _lines(v: object, depth: int) -> str:
    pad = "  " * depth
    if isinstance(v, dict):
        return "".join(f"{pad}{k}:" + ("\n" + _lines(x, depth + 1) if isinstance(x, (dict, list)) and x else f" {json.dumps(x, ensure_ascii=False)}\n") for k, x in v.items())
    return "".join(f"{pad}- {json.dumps(x, ensure_ascii=False)}\n" for x in v)


def load(text: str) -> dict:
    if yaml is not None:
        return yaml.safe_load(text) or {}
    root: dict = {}
    stack: list[tuple[int, object]] = [(-1, root)]
    for line in text.splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        depth = len(line) - len(line.lstrip())
        while stack[-1][0] >= depth:
            stack.pop()
        at = stack[-1][1]
        body = line.strip()
        if body.startswith("- ") and isinstance(at, tuple):
            holder, k = at
            if not isinstance(holder[k], list):
                holder[k] = []
            holder[k].append(_scalar(body[2:]))
            continue
        k, _, rest = body.partition(":")
        holder = at if isinstance(at, dict) else at[0][at[1]]
        if rest.strip():
            holder[k] = _scalar(rest.strip())
        else:
            holder[k] = {}
            stack.append((depth, (holder, k)))
    return root


def _scalar(s: str) -> object:
    try:
        return json.loads(s)
    except ValueError:
        return s.strip("'\"")


def paper_id(record: dict) -> str | None:
    """identifiers.arxiv, else the id behind `arxiv:`."""
    found = (record.get("identifiers") or {}).get("arxiv")
    if not found and str(record.get("id", "")).startswith("arxiv:"):
        found = str(record["id"])[6:]
    return re.sub(r"^arxiv:", "", str(found), flags=re.I) if found else None


def free_path(path: str) -> str:
    """The path, or `stem.N.yml` where it is taken."""
    stem, ext = os.path.splitext(path)
    n, out = 1, path
    while os.path.exists(out):
        out = f"{stem}.{n}{ext}"
        n += 1
    return out


def merge_keep(fresh: dict, old: dict) -> dict:
    """Fresh values win, keys that only the old record has stay, at any depth."""
    out = dict(old)
    for k, v in fresh.items():
        out[k] = merge_keep(v, old[k]) if isinstance(v, dict) and isinstance(old.get(k), dict) else v
    return out
