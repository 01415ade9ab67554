"""Filter trees, the multi-field format, scopes and routing predicates, all as Catalyst columns."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import contains_literal

#: The package that holds a project's own code.
OWN = "__project__"


@dataclass(frozen=True)
class Eq:
    field: str
    value: object


@dataclass(frozen=True)
class In:
    field: str
    values: tuple


@dataclass(frozen=True)
class Like:
    """Literal substring without regard to case."""

    field: str
    needle: str


@dataclass(frozen=True)
class And:
    parts: tuple = ()


@dataclass(frozen=True)
class Or:
    parts: tuple = ()


@dataclass(frozen=True)
class Not:
    part: object


Node = Eq | In | Like | And | Or | Not


def parse(spec: Mapping | None) -> Node:
    """{field: value}, {field: {"eq" | "in" | "like": value}}: all must hold. Anything else is a ValueError."""
    parts = []
    for field, want in (spec or {}).items():
        if not isinstance(field, str) or not field or field.startswith("$"):
            raise ValueError(f"not a field: {field!r}")
        if not isinstance(want, Mapping):
            parts.append(Eq(field, want))
            continue
        if len(want) != 1:
            raise ValueError(f"{field}: exactly one operator is needed")
        op, value = next(iter(want.items()))
        if op == "eq":
            parts.append(Eq(field, value))
        elif op == "in":
            if not isinstance(value, (list, tuple, set)):
                raise ValueError(f"{field}: in needs a list")
            parts.append(In(field, tuple(value)))
        elif op == "like":
            parts.append(Like(field, str(value)))
        else:
            raise ValueError(f"{field}: unknown operator {op!r}")
    return And(tuple(parts))


def fields(node: Node) -> set[str]:
    if isinstance(node, (And, Or)):
        return set().union(*map(fields, node.parts)) if node.parts else set()
    return fields(node.part) if isinstance(node, Not) else {node.field}


def check(node: Node, allowed: set[str]) -> None:
    if bad := fields(node) - allowed:
        raise ValueError(f"fields that may not be filtered: {sorted(bad)}")


def column(node: Node, of: Callable[[str], Column] = F.col) -> Column:
    """The tree as one predicate; an empty conjunction is true, an empty list of values false."""
    if isinstance(node, Eq):
        return of(node.field) == F.lit(node.value)
    if isinstance(node, In):
        return of(node.field).isin(*node.values) if node.values else F.lit(False)
    if isinstance(node, Like):
        return contains_literal(of(node.field), node.needle)
    if isinstance(node, Not):
        return ~column(node.part, of)
    parts = [column(p, of) for p in node.parts]
    if isinstance(node, And):
        return reduce(lambda a, b: a & b, parts, F.lit(True))
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def split_scope(node: Node) -> tuple[Node, set[str]]:
    """The tree without its scope clauses, and the union of the scopes they name."""
    scopes: set[str] = set()
    rest = []
    for p in node.parts if isinstance(node, And) else (node,):
        if isinstance(p, (Eq, In)) and p.field == "scope":
            scopes |= {p.value} if isinstance(p, Eq) else set(p.values)
        else:
            rest.append(p)
    return And(tuple(rest)), scopes


def scope_column(scopes: set[str], package: str = "package", own: str = OWN) -> Column:
    """project_only, dependencies_only, all, or any of several; a null package is in no narrow scope."""
    if not scopes or "all" in scopes:
        return F.lit(True)
    out = F.lit(False)
    if "project_only" in scopes:
        out = out | (F.col(package) == own)
    if "dependencies_only" in scopes:
        out = out | (F.col(package) != own)
    return out


def route_columns(terms: str = "terms", threshold: int = 8, scope: str | None = None, origin: str | None = None, matches: str | None = None) -> dict[str, Column]:
    """Predicates on a table of queries, by which batches are routed.

    Columns for the scope, the origin asked for and the number of matches so far are optional; a null or missing scope includes everything.
    """
    n = F.size(F.filter(F.split(F.trim(F.coalesce(F.col(terms), F.lit(""))), r"\s+"), lambda t: t != ""))
    asked = F.coalesce(F.col(scope), F.lit("")) if scope else F.lit("")
    return {
        "has_matches": F.coalesce(F.col(matches), F.lit(0)) > 0 if matches else F.lit(False),
        "query_has_multiple_terms": n >= 4,
        "scope_includes_dependencies": asked != "project_only",
        "scope_includes_project": asked != "dependencies_only",
        "scope_is_project_only": asked == "project_only",
        "scope_is_dependencies_only": asked == "dependencies_only",
        "kind_is_decision": F.coalesce(F.col(origin), F.lit("")) == "decision_record" if origin else F.lit(False),
        "is_long_query": n >= threshold,
    }


class Registry(dict):
    """Named things, added with a decorator; a name can be taken once."""

    def add(self, name: str) -> Callable:
        def put(thing: object) -> object:
            if name in self:
                raise ValueError(f"{name} is taken")
            self[name] = thing
            return thing

        return put


FORMATS = Registry(multifield=parse)
