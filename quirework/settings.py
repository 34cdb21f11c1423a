"""Settings by layers: defaults, profile, user file, environment, explicit options; each overrides the one before."""

from __future__ import annotations

import copy
import json
import os
from collections.abc import Mapping

#: Defaults that decide results.
DEFAULTS: dict = {
    "sections": {"reference_titles": ["references", "bibliography"], "abstract_title": "abstract"}, "authors": {"max_part": 80},
    "output": {"scheme": "arxiv-ym", "max_name": 255, "max_title": 220, "max_source": 80, "max_short": 80, "anchors": False, "linked_citations": False},
    "http": {"timeout_s": 10, "retries": 3, "backoff_s": 3.0, "retry_status": [429, 500, 502, 503, 504]}, "cache": {"ttl_s": 86400}, "images": {"dpi": 150}, "batch": {"concurrency": 3},
}
PROFILES: dict[str, dict] = {"default": {}, "test": {"output": {"anchors": True}, "cache": {"ttl_s": 0}, "http": {"retries": 1}}}
PREFIX = "QUIREWORK_"


class SettingsError(ValueError):
    exit_code = 2


def deep_merge(a: Mapping, b: Mapping) -> dict:
    """The right side wins, at any depth; neither side is changed."""
    out = copy.deepcopy(dict(a))
    for k, v in b.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else copy.deepcopy(v)
    return out


def scalar(text: str) -> object:
    """Value of an environment variable: boolean, JSON, number or text."""
    low = text.strip().lower()
    if low in ("true", "yes", "on"):
        return True
    if low in ("false", "no", "off"):
        return False
    try:
        return json.loads(text)
    except ValueError:
        return text


def from_environment(env: Mapping[str, str] | None = None) -> dict:
    """QUIREWORK_OUTPUT__ANCHORS=true gives {"output": {"anchors": True}}."""
    out: dict = {}
    for name, value in (os.environ if env is None else env).items():
        if name.startswith(PREFIX):
            *path, last = name[len(PREFIX) :].lower().split("__")
            at = out
            for p in path:
                at = at.setdefault(p, {})
            at[last] = scalar(value)
    return out


def load(profile: str = "default", user: Mapping | None = None, env: Mapping[str, str] | None = None, options: Mapping | None = None) -> dict:
    """Merged and checked settings; options that are None count as not given."""
    if profile not in PROFILES:
        raise SettingsError(f"no profile {profile!r}")
    out = deep_merge(deep_merge(deep_merge(DEFAULTS, PROFILES[profile]), user or {}), from_environment(env))
    return checked(deep_merge(out, without_none(options or {})))


def without_none(m: Mapping) -> dict:
    return {k: without_none(v) if isinstance(v, Mapping) else v for k, v in m.items() if v is not None}


def checked(s: dict) -> dict:
    http = s["http"]
    if not 0 < http["timeout_s"] <= 600 or not 0 <= http["retries"] <= 20 or http["backoff_s"] < 0:
        raise SettingsError("http: timeout_s in (0, 600], retries in 0..20 and backoff_s from 0 are needed")
    if s["batch"]["concurrency"] < 1 or s["images"]["dpi"] < 1:
        raise SettingsError("batch.concurrency and images.dpi must be 1 at least")
    if s["output"]["scheme"] not in ("arxiv-ym", "full-date", "title"):
        raise SettingsError(f"output.scheme: {s['output']['scheme']!r} is unknown")
    return s
