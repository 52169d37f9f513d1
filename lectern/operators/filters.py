"""The search filter language, compiled to one predicate over hydrated candidates.

All parts are ANDed. Comparison of dates is by text on purpose: a day as upper
bound excludes that day's timestamps, and rows without a date pass.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

TYPES = ("system", "project", "code")


def stringify(value: Any) -> str:
    """How a JSON value of a filter is written for comparison."""
    if value is None:
        return "<nil>"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        f = float(value)
        if f == int(f) and abs(f) < 1e21:
            return str(int(f))
        s = repr(f)
        return s if "e" not in s else f"{float(s.split('e')[0]):g}e{int(s.split('e')[1]):+03d}"
    if isinstance(value, (list, tuple)):
        return "[" + " ".join(map(stringify, value)) + "]"
    if isinstance(value, dict):
        return "map[" + " ".join(f"{k}:{stringify(v)}" for k, v in sorted(value.items())) + "]"
    return str(value)


def parse_meta(pairs: list[str]) -> dict[str, str]:
    """``key=value`` arguments; the first equals sign parts them."""
    out = {}
    for pair in pairs:
        key, eq, value = pair.partition("=")
        if not eq:
            raise ValueError(f"metadata filter without '=': {pair!r}")
        out[key] = value
    return out


@dataclass(frozen=True)
class SearchFilters:
    collection: str = ""
    source_type: str = ""
    path: str = ""
    date_from: str = ""
    date_to: str = ""
    sender: str = ""
    author: str = ""
    metadata: dict[str, Any] = field(default_factory=dict)

    def any(self) -> bool:
        return any([self.collection, self.source_type, self.path, self.date_from, self.date_to, self.sender, self.author, self.metadata])

    def predicate(self, collection="collection_name", collection_type="collection_type", source_type="source_type", path="source_path", metadata="metadata") -> Column:
        meta, parts = F.col(metadata), []
        if self.collection:
            parts.append(F.col(collection_type if self.collection in TYPES else collection) == self.collection)
        if self.source_type:
            parts.append(F.col(source_type) == self.source_type)
        if self.path:
            parts.append(_contains(F.col(path), self.path))
        if self.sender:
            parts.append(_contains(_string_field(meta, "sender"), self.sender))
        if self.author:
            parts.append(list_contains(meta, "authors", self.author))
        date = _string_field(meta, "date")
        if self.date_from:
            parts.append((date == "") | (date >= self.date_from))
        if self.date_to:
            parts.append((date == "") | (date <= self.date_to))
        parts += [metadata_matches(meta, k, stringify(v)) for k, v in self.metadata.items()]
        return reduce(lambda a, b: a & b, [F.coalesce(p, F.lit(False)) for p in parts], F.lit(True))


def _contains(column: Column, needle: str) -> Column:
    return F.lower(column).contains(needle.lower())


def _variant(meta: Column) -> Column:
    return F.try_parse_json(F.nullif(meta, F.lit("")))


def _key(key: str) -> str:
    """A top-level key as a path, dots and all."""
    return "$[" + json.dumps(key, ensure_ascii=False) + "]"


def _kind(meta: Column, key: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(_variant(meta), _key(key), "variant"))


def _string_field(meta: Column, key: str) -> Column:
    """The field if it is a string, else empty."""
    value = F.try_variant_get(_variant(meta), _key(key), "string")
    return F.coalesce(F.when(_kind(meta, key) == "STRING", value), F.lit(""))


def list_contains(meta: Column, key: str, needle: str) -> Column:
    """Whether the field is a list with a string that contains the needle; other elements don't count."""
    items = F.try_variant_get(_variant(meta), _key(key), "array<variant>")
    hit = F.exists(items, lambda v: (F.schema_of_variant(v) == "STRING") & _contains(F.try_variant_get(v, "$", "string"), needle))
    return _kind(meta, key).startswith("ARRAY") & hit


def metadata_matches(meta: Column, key: str, needle: str) -> Column:
    """Strings contain the value, lists have a string that does, anything else is written like it."""
    kind = _kind(meta, key)
    text = F.try_variant_get(_variant(meta), _key(key), "string")
    number = F.regexp_replace(text, r"\.0+$", "")
    return (
        F.when(kind == "STRING", _contains(text, needle))
        .when(kind.startswith("ARRAY"), list_contains(meta, key, needle))
        .when(kind == "VOID", F.lit(needle == "<nil>"))
        .when(kind.isNotNull(), (text == needle) | (number == needle))
        .otherwise(F.lit(False))
    )
