"""Dataclasses to documents and back: ``id`` is the key; dates, decimals and enums become text."""

from __future__ import annotations

import dataclasses
import datetime as dt
import decimal
import enum
import types
import typing
import uuid
from typing import Any


def _plain(v: Any) -> Any:
    if dataclasses.is_dataclass(v):
        return {f.name: _plain(getattr(v, f.name)) for f in dataclasses.fields(v)}
    if isinstance(v, enum.Enum):
        return v.name
    if isinstance(v, dt.date | dt.time | decimal.Decimal | uuid.UUID):
        return str(v) if not isinstance(v, dt.datetime) else v.isoformat()
    if isinstance(v, dict):
        return {str(k): _plain(x) for k, x in v.items()}
    return [_plain(x) for x in v] if isinstance(v, list | tuple | set | frozenset) else v


def to_record(obj: Any, key: str = "id") -> tuple[str, dict]:
    """(key, document) of a dataclass instance."""
    doc = _plain(obj)
    return str(doc.pop(key)), doc


def _typed(v: Any, t: Any) -> Any:
    if v is None:
        return None
    origin, args = typing.get_origin(t), typing.get_args(t)
    if origin in (typing.Union, types.UnionType):
        return _typed(v, next(a for a in args if a is not type(None)))
    if origin in (list, set, tuple, frozenset):
        return origin(_typed(x, args[0]) if args else x for x in v)
    if origin is dict:
        return {k: _typed(x, args[1]) for k, x in v.items()}
    if dataclasses.is_dataclass(t):
        return from_doc(t, v)
    if isinstance(t, type) and issubclass(t, enum.Enum):
        return t[v]
    if t in (dt.date, dt.datetime, dt.time):
        return t.fromisoformat(v) if isinstance(v, str) else v
    return t(v) if t in (decimal.Decimal, uuid.UUID) else v


def from_doc(cls: type, doc: dict) -> Any:
    hints = typing.get_type_hints(cls)
    return cls(**{f.name: _typed(doc[f.name], hints[f.name]) for f in dataclasses.fields(cls) if f.name in doc})


def from_record(cls: type, key: str, doc: dict, key_field: str = "id") -> Any:
    """The dataclass instance of a document."""
    kind = typing.get_type_hints(cls).get(key_field, str)
    return from_doc(cls, {**doc, key_field: kind(key) if kind in (int, str, float) else key})
