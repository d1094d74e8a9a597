"""YAML heads of notes: read, add missing keys, replace one value, write.

Values follow YAML 1.2 (``yes`` is text, ``010`` is ten, dates stay text). PyYAML does the
parsing where it is installed.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

try:
    import yaml
except ImportError:  # pragma: no cover - an optional package
    yaml = None

#: Fixed value: keys of a head in order; others follow by name.
KEY_ORDER = ("kind", "ingested", "source-format", "origin-url", "derived-from", "source", "aliases", "summary", "updated", "question", "asked", "mode", "grounded", "missing")
BOM = "\ufeff"
_HEAD = re.compile(rf"\A{BOM}?---[ \t]*\r?\n")
_CLOSE = re.compile(r"^---[ \t]*(?:\r?\n|\Z)", re.M)

if yaml:

    class _Loader(yaml.SafeLoader):
        """The core schema of YAML 1.2."""

    _Loader.yaml_implicit_resolvers = {}
    for _tag, _pattern, _first in (
        ("bool", r"true|True|TRUE|false|False|FALSE", "tTfF"),
        ("int", r"[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+", "-+0123456789"),
        ("float", r"[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN)", "-+0123456789."),
        ("null", r"~|null|Null|NULL|", "~nN\0"),
        ("merge", "<<", "<"),
    ):
        _Loader.add_implicit_resolver(f"tag:yaml.org,2002:{_tag}", re.compile(f"^(?:{_pattern})$"), [c if c != "\0" else "" for c in _first])

    def _int(loader: yaml.SafeLoader, node: yaml.Node) -> int:
        s = loader.construct_scalar(node)
        return int(s, 8 if s.startswith("0o") else 16 if s.startswith("0x") else 10) if s[:2] in ("0o", "0x") else int(s)

    _Loader.add_constructor("tag:yaml.org,2002:int", _int)

    class _Dumper(yaml.SafeDumper):
        """Quotes what 1.1 or 1.2 would read as anything but text."""

        def ignore_aliases(self, data) -> bool:  # noqa: ANN001
            return True


@dataclass
class Head:
    present: bool = False
    mergeable: bool = False
    data: dict = field(default_factory=dict)
    inner: str = ""
    start: int = 0  # of the inner text
    end: int = 0
    body: str = ""


def parse(text: str) -> Head:
    """``present``: a fence opens the text, or follows its byte order mark. ``mergeable``: it closes and holds a mapping, or nothing."""
    opening = _HEAD.match(text)
    closing = _CLOSE.search(text, opening.end()) if opening else None
    if not closing:
        return Head(present=bool(opening), body=text)
    inner = text[opening.end() : closing.start()]
    out = Head(True, True, {}, inner, opening.end(), closing.start(), text[closing.end() :])
    if inner.strip():
        if yaml is None:
            raise RuntimeError("reading a note's head needs PyYAML")
        try:
            loaded = yaml.load(inner, _Loader)  # noqa: S506 - a safe loader
        except yaml.YAMLError:
            loaded = None
        out.mergeable, out.data = (True, loaded) if isinstance(loaded, dict) else (False, {})
    return out


def _dump(value) -> str:  # noqa: ANN001
    if yaml is None:
        raise RuntimeError("writing a note's head needs PyYAML")
    return yaml.dump(value, Dumper=_Dumper, sort_keys=False, allow_unicode=True, width=float("inf"), default_flow_style=False)


def keys(data: dict) -> str:
    data = {k: v for k, v in data.items() if v is not None}
    order = [k for k in KEY_ORDER if k in data] + sorted(k for k in data if k not in KEY_ORDER)
    return _dump({k: data[k] for k in order}) if order else ""


def render(data: dict) -> str:
    return f"---\n{keys(data)}---\n"


def ensure(text: str, data: dict) -> str:
    """Adds the keys that are missing, in front; what is there keeps its bytes. A broken head stays as it is."""
    head = parse(text)
    if not head.present:
        mark, rest = (BOM, text[1:]) if text.startswith(BOM) else ("", text)
        return f"{mark}---\n{added}---\n{rest}" if (added := keys(data)) else text
    if not head.mergeable:
        return text
    added = keys({k: v for k, v in data.items() if k not in head.data})
    return text[: head.start] + added + text[head.start :] if added else text


def replace_value(text: str, key: str, value: str) -> str | None:
    """The text with one top-level scalar on one line replaced; null if there is not just one such."""
    head = parse(text)
    if not head.present or not head.end and not head.mergeable:
        return None
    found = list(re.finditer(rf"^{re.escape(key)}[ \t]*:[ \t]*(.*)$", head.inner, re.M))
    old = found[0][1].strip() if len(found) == 1 else ""
    new = _dump(value).strip().removesuffix("...").rstrip()
    if not old or old[0] in "|>" or "\n" in new:
        return None
    at, m = head.start, found[0]
    return text[: at + m.start()] + f"{key}: {new}" + text[at + m.end() :]


FIELDS = StructType([StructField(n, ArrayType(StringType()) if n == "aliases" else StringType()) for n in ("kind", "aliases", "summary", "source", "derived_from", "asked", "body")])


@F.pandas_udf(FIELDS)
def fields(text: pd.Series) -> pd.DataFrame:
    """What operators read of notes' heads; values of another type than wanted are null, aliases none. A null text has no head and no body."""
    rows = []
    for t in text:
        head = parse(t) if t is not None else Head(body=None)
        own = lambda k, d=head.data: d[k] if isinstance(d.get(k), str) else None
        names = head.data.get("aliases")
        names = [names] if isinstance(names, str) else names if isinstance(names, list) else []
        rows.append((own("kind"), [a for a in names if isinstance(a, str)], own("summary"), own("source"), own("derived-from"), None if head.data.get("asked") is None else str(head.data["asked"]), head.body))
    return pd.DataFrame(rows, columns=["kind", "aliases", "summary", "source", "derived_from", "asked", "body"], dtype=object)
