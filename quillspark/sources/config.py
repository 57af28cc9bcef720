"""Settings: layered files, environment placeholders, dotted overrides."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Mapping
from pathlib import Path

import yaml

HOLDER = re.compile(r"\$\{([A-Za-z_][A-Za-z0-9_]*)(?::-([^}]*))?\}")


def expanded(value: object, env: Mapping[str, str] | None = None) -> object:
    """${NAME} and ${NAME:-default} in texts, filled in; a name that nothing is known of stays."""
    env = os.environ if env is None else env
    if isinstance(value, dict):
        return {k: expanded(v, env) for k, v in value.items()}
    if isinstance(value, list):
        return [expanded(v, env) for v in value]
    if isinstance(value, str):
        return HOLDER.sub(lambda m: env.get(m[1], m[2] if m[2] is not None else m[0]), value)
    return value


def merged(a: Mapping, b: Mapping) -> dict:
    """a with b over it; maps are merged all the way down."""
    out = dict(a)
    for k, v in b.items():
        out[k] = merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def coerced(text: str) -> object:
    """A command line's value: JSON where it is, else the text; words for nothing, yes and no."""
    words = {"none": None, "null": None, "true": True, "false": False}
    if text.strip().lower() in words:
        return words[text.strip().lower()]
    try:
        return json.loads(text)
    except ValueError:
        return text


def dotted(overrides: Mapping[str, object]) -> dict:
    out: dict = {}
    for path, value in overrides.items():
        *way, last = path.split(".")
        here = out
        for step in way:
            here = here.setdefault(step, {})
        here[last] = coerced(value) if isinstance(value, str) else value
    return out


def load(path: str, overrides: Mapping[str, object] | None = None, read: Callable[[str], str] | None = None) -> dict:
    """A YAML or JSON file over those that it `extends`, with overrides such as {"jobs.search.limit": "5"} over all."""
    read = read or (lambda p: Path(p).read_text(encoding="utf-8"))
    said = yaml.safe_load(read(path)) or {}
    named = said.pop("extends", [])
    base: dict = {}
    for other in [named] if isinstance(named, str) else named:
        base = merged(base, load(str(Path(path).parent / other), read=read))
    return expanded(merged(merged(base, said), dotted(overrides or {})))
