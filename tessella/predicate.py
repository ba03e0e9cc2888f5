"""Predicates over declared fields: builders, a validated tree, a visitor, and compilers.

Compilation is in negation normal form: a NOT is pushed to the leaves, where each leaf is written so
that a missing value gives the wanted answer without wrapping the predicate in coalesce. Plain leaves
reach the Parquet scan as pushed filters; wrapped ones wouldn't.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.errors import InvalidArgument
from tessella.schema import KINDS, Field, Schema, is_identifier, scalar

ORDERED = ("gt", "gte", "lt", "lte")
_OPPOSITE = {"eq": "neq", "neq": "eq", "gt": "lte", "gte": "lt", "lt": "gte", "lte": "gt"}
_SIGNS = {"eq": "=", "neq": "<>", "gt": ">", "gte": ">=", "lt": "<", "lte": "<="}


@dataclass(frozen=True)
class Leaf:
    """A comparison; ``value`` is a tuple for "in"."""

    op: str
    name: str
    kind: str
    value: object


@dataclass(frozen=True)
class Group:
    """A conjunction ("and") or disjunction ("or")."""

    op: str
    members: tuple


@dataclass(frozen=True)
class Negation:
    member: object


@dataclass(frozen=True)
class Everything:
    """The empty filter."""


EVERYTHING = Everything()


def _leaf(op: str, field: Field, value: object) -> Leaf:
    kind, literal = scalar(value)
    if field.kind == "float" and kind == "int":
        kind, literal = "float", float(literal)
    if kind != field.kind:
        raise InvalidArgument(f"{field.name} is {field.kind}, the value is {kind}")
    return Leaf(op, field.name, kind, literal)


def equal(field: Field, value: object) -> Leaf:
    return _leaf("eq", field, value)


def not_equal(field: Field, value: object) -> Leaf:
    return _leaf("neq", field, value)


def greater(field: Field, value: object) -> Leaf:
    return _leaf("gt", field, value)


def greater_or_equal(field: Field, value: object) -> Leaf:
    return _leaf("gte", field, value)


def less(field: Field, value: object) -> Leaf:
    return _leaf("lt", field, value)


def less_or_equal(field: Field, value: object) -> Leaf:
    return _leaf("lte", field, value)


def one_of(field: Field, *values: object) -> Leaf:
    if not values:
        raise InvalidArgument("one_of needs values")
    return Leaf("in", field.name, field.kind, tuple(_leaf("eq", field, v).value for v in values))


def all_of(*members: object) -> Group:
    return Group("and", tuple(members))


def any_of(*members: object) -> Group:
    return Group("or", tuple(members))


def inverse(member: object) -> Negation:
    return Negation(member)


def normalise(node: object | None) -> object:
    """A validated tree in which an AND never stands directly in an AND, nor an OR in an OR; None is the empty filter."""
    if node is None:
        return EVERYTHING
    tree = _flattened(node)
    validate(tree)
    return tree


def _flattened(node: object) -> object:
    if isinstance(node, Negation):
        return Negation(_flattened(node.member))
    if isinstance(node, Group):
        members = [m for child in map(_flattened, node.members) for m in (child.members if isinstance(child, Group) and child.op == node.op else (child,))]
        return Group(node.op, tuple(members))
    return node


def is_empty(tree: object | None) -> bool:
    return tree is None or isinstance(tree, Everything)


def validate(tree: object, inner: bool = False) -> None:
    """Refuse trees that no builder makes: bad names, kinds or literals, ordered comparisons of text or booleans, empty groups."""
    if isinstance(tree, Everything) and not inner:
        return
    if isinstance(tree, Group):
        if tree.op not in ("and", "or") or not tree.members:
            raise InvalidArgument("a group needs members")
        for m in tree.members:
            validate(m, True)
    elif isinstance(tree, Negation):
        validate(tree.member, True)
    elif isinstance(tree, Leaf):
        if not is_identifier(tree.name) or tree.kind not in KINDS or tree.op not in (*_OPPOSITE, "in"):
            raise InvalidArgument(f"bad comparison {tree!r}")
        if tree.op in ORDERED and tree.kind not in ("int", "float"):
            raise InvalidArgument(f"{tree.kind} has no order")
        values = tree.value if tree.op == "in" else (tree.value,)
        if not isinstance(values, tuple) or not values or any(scalar(v)[0] != tree.kind for v in values):
            raise InvalidArgument(f"values of {tree.name} are not all {tree.kind}")
    else:
        raise InvalidArgument(f"{type(tree).__name__} is no predicate")


def bind(tree: object, schema: Schema) -> object:
    """The tree, if the schema declares each of its fields with exactly its kind. Checked before any data is read."""
    if not schema.finalised:
        raise InvalidArgument("schema is not built")
    tree = EVERYTHING if tree is None else tree
    validate(tree)
    walk(tree, leaf=lambda x: schema.field(x.name, x.kind))
    return tree


def walk(tree: object, leaf: Callable = lambda x: None, enter: Callable = lambda x: None, leave: Callable = lambda x: None, empty: Callable = lambda x: None) -> None:
    """Visit a tree: ``enter`` and ``leave`` for groups and negations, ``leaf`` for comparisons, ``empty`` for the empty filter."""
    if isinstance(tree, Everything):
        empty(tree)
    elif isinstance(tree, Leaf):
        leaf(tree)
    else:
        enter(tree)
        for m in tree.members if isinstance(tree, Group) else (tree.member,):
            walk(m, leaf, enter, leave, empty)
        leave(tree)


def _column_leaf(x: Leaf, root: str, negated: bool, sql_nulls: bool) -> Column:
    c = F.col(f"{root}.{x.name}" if root else x.name)
    lit = lambda v: F.lit(v).cast(KINDS[x.kind])
    if x.op == "in":
        found = c.isin([lit(v) for v in x.value])
        return found if not negated else (~found if sql_nulls else ~found | c.isNull())
    op, v = (_OPPOSITE[x.op] if negated else x.op), lit(x.value)
    if op == "eq":
        return c == v
    if op == "neq":
        return c != v if sql_nulls else ~c.eqNullSafe(v)
    compared = {"gt": c > v, "gte": c >= v, "lt": c < v, "lte": c <= v}[op]
    return compared | c.isNull() if negated and not sql_nulls else compared


def compiled(tree: object, root: str = "attributes", nulls: str = "two_valued", negated: bool = False) -> Column:
    """The tree as a column. ``nulls="sql"`` lets comparisons with missing values drop the row, also under NOT."""
    if isinstance(tree, Everything):
        return F.lit(not negated)
    if isinstance(tree, Leaf):
        return _column_leaf(tree, root, negated, nulls == "sql")
    if isinstance(tree, Negation):
        return compiled(tree.member, root, nulls, not negated)
    join = or_ if (tree.op == "and") == negated else and_
    return reduce(join, [compiled(m, root, nulls, negated) for m in tree.members])


def matches(tree: object, attributes: dict | None) -> bool:
    """The same semantics over one record, for rows that aren't in Spark."""
    own = attributes or {}
    if isinstance(tree, Everything):
        return True
    if isinstance(tree, Negation):
        return not matches(tree.member, own)
    if isinstance(tree, Group):
        return (all if tree.op == "and" else any)(matches(m, own) for m in tree.members)
    x = own.get(tree.name)
    if x is None:
        return tree.op == "neq"
    if tree.op == "in":
        return x in tree.value
    v = tree.value
    return {"eq": x == v, "neq": x != v, **({"gt": x > v, "gte": x >= v, "lt": x < v, "lte": x <= v} if tree.op in ORDERED else {})}[tree.op]


def as_sql(tree: object, first: int = 1) -> tuple[str, list]:
    """SQL text over a JSON attribute column, with numbered parameters; values are never part of the text."""
    casts = {"string": "", "int": "::bigint", "float": "::double precision", "bool": "::boolean"}
    args: list = []

    def term(x: Leaf) -> str:
        left = f"attributes->>'{x.name}'"
        left = f"({left}){casts[x.kind]}" if casts[x.kind] else left
        values: Sequence = x.value if x.op == "in" else (x.value,)
        marks = []
        for v in values:
            args.append(v)
            marks.append(f"${first + len(args) - 1}")
        return f"{left} IN ({', '.join(marks)})" if x.op == "in" else f"{left} {_SIGNS[x.op]} {marks[0]}"

    def text(t: object) -> str:
        if isinstance(t, Everything):
            return "TRUE"
        if isinstance(t, Leaf):
            return term(t)
        if isinstance(t, Negation):
            return f"NOT ({text(t.member)})"
        return f" {t.op.upper()} ".join(f"({text(m)})" for m in t.members)

    return text(tree), args


def as_conditions(tree: object) -> dict:
    """A typed condition tree of plain dicts."""
    if isinstance(tree, Everything):
        return {"match": "all"}
    if isinstance(tree, Negation):
        return {"not": as_conditions(tree.member)}
    if isinstance(tree, Group):
        return {tree.op: [as_conditions(m) for m in tree.members]}
    if tree.op in ORDERED:
        return {"range": {"field": tree.name, tree.op: tree.value}}
    return {tree.op: {"field": tree.name, "values" if tree.op == "in" else "value": list(tree.value) if tree.op == "in" else tree.value}}


def as_query_dsl(tree: object) -> dict:
    """The JSON query language of text-search servers."""
    if isinstance(tree, Everything):
        return {"match_all": {}}
    if isinstance(tree, Negation):
        return {"bool": {"must_not": [as_query_dsl(tree.member)]}}
    if isinstance(tree, Group):
        inner = [as_query_dsl(m) for m in tree.members]
        return {"bool": {"filter": inner}} if tree.op == "and" else {"bool": {"should": inner, "minimum_should_match": 1}}
    if tree.op == "in":
        return {"terms": {tree.name: list(tree.value)}}
    if tree.op in ORDERED:
        return {"range": {tree.name: {tree.op: tree.value}}}
    term = {"term": {tree.name: tree.value}}
    return term if tree.op == "eq" else {"bool": {"must_not": [term]}}


def explained(tree: object) -> str:
    """The filter as readable JSON."""
    return json.dumps(as_conditions(tree), ensure_ascii=False)
