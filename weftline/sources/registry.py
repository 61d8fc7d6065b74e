"""Kinds of sources by name: a typed configuration and how its tables are read.

A kind's configuration is a dataclass, from which the check of a source's settings and the
JSON schema for editors both follow, so neither can drift from the code that reads them.
"""

from __future__ import annotations

import dataclasses
import types
import typing
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

# Settings that every source may have beside its kind's own, with what they may hold.
COMMON = {"type": str, "name": str, "enabled": bool | str, "profiling": bool | str, "samples": bool, "constraints": dict | None, "descriptions": dict | None}
JSON_TYPES = {str: "string", int: "integer", float: "number", bool: "boolean", dict: "object", list: "array", type(None): "null"}


@dataclass
class Parquet:
    """A folder with a Parquet file or folder for each table."""

    path: str


@dataclass
class Database:
    """A database of the session's catalog."""

    database: str = "default"


@dataclass
class Sqlite:
    """A SQLite file."""

    path: str


@dataclass
class Jdbc:
    """A database that JDBC reaches; the default port is its dialect's."""

    host: str = "localhost"
    port: int | None = None
    database: str = ""
    options: dict[str, str] = field(default_factory=dict)


def alternatives(hint) -> tuple[type, ...]:
    """The plain types that a type hint allows."""
    if isinstance(hint, types.UnionType) or typing.get_origin(hint) is typing.Union:
        return tuple(t for part in typing.get_args(hint) for t in alternatives(part))
    return (typing.get_origin(hint) or hint,)


def fits(value, hint) -> bool:
    """Whether a value has one of the hint's types; a boolean is no number, an integer is a number."""
    kinds = alternatives(hint)
    if isinstance(value, bool):
        return bool in kinds
    return isinstance(value, kinds) or float in kinds and isinstance(value, int)


@dataclass(frozen=True)
class Kind:
    """A kind of source: its name, its configuration's class, and its tables by name."""

    name: str
    config: type
    tables: Callable[[SparkSession, typing.Any], dict[str, DataFrame]] | None = None

    def _hints(self) -> dict:
        return typing.get_type_hints(self.config)

    def _required(self) -> list[str]:
        return [f.name for f in dataclasses.fields(self.config) if f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING]

    def typed(self, settings: dict):
        """The configuration of given settings; every wrong, missing and unknown one is named in the error."""
        hints = self._hints()
        wrong = [f"{k} is missing" for k in self._required() if k not in settings]
        for k, v in settings.items():
            hint = hints.get(k, COMMON.get(k))
            if hint is None:
                wrong.append(f"{k} is unknown")
            elif not fits(v, hint):
                wrong.append(f"{k} must be {' or '.join(JSON_TYPES[t] for t in alternatives(hint))}")
        if wrong:
            raise ValueError(f"settings of a source of type {self.name}: " + ", ".join(sorted(wrong)))
        return self.config(**{k: v for k, v in settings.items() if k in hints})

    def schema(self) -> dict:
        """The JSON schema of a source's settings."""
        shown = lambda hint: (lambda names: names[0] if len(names) == 1 else names)([JSON_TYPES[t] for t in alternatives(hint)])
        properties = {k: {"type": shown(h)} for k, h in {**COMMON, **self._hints()}.items()}
        properties["type"] = {"const": self.name}
        return {"title": self.name, "description": (self.config.__doc__ or "").strip(), "type": "object", "properties": properties, "required": ["type", *self._required()], "additionalProperties": False}


class Registry:
    """Kinds of sources by name, without regard to case; a name is taken once."""

    def __init__(self, kinds: Iterable[Kind] = ()):
        self._kinds: dict[str, Kind] = {}
        for kind in kinds:
            self.add(kind)

    def add(self, kind: Kind) -> None:
        key = kind.name.lower()
        if key in self._kinds:
            raise ValueError(f"a source type {kind.name} is there already")
        self._kinds[key] = kind

    def names(self) -> list[str]:
        return sorted(k.name for k in self._kinds.values())

    def __getitem__(self, name: str | None) -> Kind:
        found = self._kinds.get(str(name).lower())
        if found is None:
            raise ValueError(f"unknown source type {name!r}; there are {', '.join(self.names())}")
        return found

    def schemas(self) -> dict[str, dict]:
        return {name: self[name].schema() for name in self.names()}


def built_in(dialects: Iterable[str]) -> Registry:
    """The library's own kinds; a database's tables are read by the facade, through its catalog."""
    jdbc = [Kind(d, Jdbc) for d in dialects if d != "sqlite"]
    return Registry([Kind("parquet", Parquet), Kind("spark", Database), Kind("sqlite", Sqlite), *jdbc])
