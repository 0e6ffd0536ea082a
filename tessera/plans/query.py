"""Fluent predicate builder: ``Q = Query(); (Q.age > 28) & Q.tags.has("x")``.

Attributes and items extend the path; methods of this class win over fields of the same name, so
such fields need item access (``Q["sum"]``). Comparisons and tests end in a :class:`Condition`.
"""

from __future__ import annotations

from typing import Any


class Condition:
    """A finished predicate; ``as_rule`` gives the mapping it stands for."""

    def __init__(self, rule: dict):
        self.rule = rule

    def as_rule(self) -> dict:
        return self.rule

    def _joined(self, op: str, other: Condition) -> Condition:
        parts = []
        for side in (self.rule, other.rule):
            parts += side[op] if set(side) == {op} else [side]
        return Condition({op: parts})

    def __and__(self, other: Condition) -> Condition:
        return self._joined("$and", other)

    def __or__(self, other: Condition) -> Condition:
        return self._joined("$or", other)

    def __invert__(self) -> Condition:
        return Condition({"$not": self.rule})

    def __repr__(self) -> str:
        return f"Condition({self.rule!r})"


class Query:
    """A path being built."""

    def __init__(self, path: tuple[str, ...] = ()):
        self._path = path

    def __getattr__(self, name: str) -> Query:
        if name.startswith("__"):
            raise AttributeError(name)
        return Query((*self._path, name))

    def __getitem__(self, name: str | int) -> Query:
        return Query((*self._path, str(name)))

    @property
    def path(self) -> str:
        return ".".join(self._path)

    def _test(self, op: str, arg: Any) -> Condition:
        key = ".".join((*self._path, f"${op}"))
        return Condition({key: arg})

    def _compare(self, op: str, arg: Any):
        return self._test(op, arg) if self._path else NotImplemented

    def __eq__(self, other: Any):
        return self._compare("eq", other)

    def __ne__(self, other: Any):
        return self._compare("ne", other)

    def __gt__(self, other: Any):
        return self._compare("gt", other)

    def __ge__(self, other: Any):
        return self._compare("gte", other)

    def __lt__(self, other: Any):
        return self._compare("lt", other)

    def __le__(self, other: Any):
        return self._compare("lte", other)

    __hash__ = None  # type: ignore[assignment]


def _method(op: str, pair: bool = False):
    if pair:
        return lambda self, a, b: self._test(op, (a, b))
    return lambda self, arg: self._test(op, arg)


for _name, _op in {
    "has": "has", "ihas": "ihas", "not_has": "nhas", "startswith": "sw", "endswith": "ew", "size_of": "size", "exists": "exists",
    "type_of": "type", "any_in": "anyin", "matches": "re", "fullmatch": "match", "test": "func", "one_of": "in", "not_in": "nin",
}.items():
    setattr(Query, _name, _method(_op))
for _name in ("between", "near", "mod"):
    setattr(Query, _name, _method(_name, pair=True))
for _name in "lower upper strip str int float abs ceil floor round len sum min max avg std mid neg first last flat sort unique".split():
    setattr(Query, _name, lambda self, _op=_name: Query((*self._path, f"${_op}")))


def path_of(spec: Any) -> str:
    """Text of a path given as a string or as a :class:`Query`."""
    return spec.path if isinstance(spec, Query) else spec
