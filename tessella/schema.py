"""Declared attribute schemas: typed fields under one nested struct column."""

from __future__ import annotations

import math
import numbers
import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from types import MappingProxyType

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.errors import InvalidArgument

IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]*"
RESERVED = frozenset(("id", "content", "type", "source_id", "target_id"))
KINDS = {"string": T.StringType(), "int": T.LongType(), "float": T.DoubleType(), "bool": T.BooleanType()}
# Policies for names of resources, fixed values.
NAME_POLICIES = {"identifier": IDENTIFIER, "sql": IDENTIFIER, "index": r"[a-z][a-z0-9_-]*", "collection": r"[A-Za-z][A-Za-z0-9_-]*"}
_LONG = 1 << 63


def is_identifier(name: object) -> bool:
    return isinstance(name, str) and re.fullmatch(IDENTIFIER, name) is not None


def checked_name(name: str, policy: str = "identifier") -> str:
    """The name, if it follows the policy for its kind of resource."""
    if not isinstance(name, str) or not re.fullmatch(NAME_POLICIES[policy], name):
        raise InvalidArgument(f"{policy} name {name!r}")
    return name


def scalar(value: object) -> tuple[str, object]:
    """The kind and canonical form of a scalar. bool comes first: it is an int in Python."""
    if isinstance(value, bool) or type(value).__name__ in ("bool_", "bool"):
        return "bool", bool(value)
    if isinstance(value, str):
        return "string", str(value)
    if isinstance(value, numbers.Integral):
        if type(value).__name__.startswith(("uint", "ulong")):
            raise InvalidArgument(f"unsigned integer {value!r}")
        if not -_LONG <= int(value) < _LONG:
            raise InvalidArgument(f"integer {value!r} exceeds 64 bits")
        return "int", int(value)
    if isinstance(value, numbers.Real):
        if not math.isfinite(value):
            raise InvalidArgument(f"{value!r} is not finite")
        return "float", float(value)
    raise InvalidArgument(f"{type(value).__name__} is no scalar")


def normalised(attributes: Mapping[str, object] | None) -> dict[str, object] | None:
    """Attributes with identifier keys and canonical scalars; None if there are none."""
    out = {}
    for name, value in (attributes or {}).items():
        if not is_identifier(name):
            raise InvalidArgument(f"attribute name {name!r}")
        out[name] = scalar(value)[1]
    return out or None


@dataclass(frozen=True)
class Field:
    """A declared field of one kind."""

    name: str
    kind: str
    root: str = "attributes"

    @property
    def column(self) -> Column:
        return F.col(f"{self.root}.{self.name}")


@dataclass(frozen=True)
class Schema:
    """An immutable set of fields. ``fields`` is None for a schema that was never built."""

    fields: Mapping[str, str] | None = None
    root: str = "attributes"

    @property
    def finalised(self) -> bool:
        return self.fields is not None

    def _checked(self) -> Mapping[str, str]:
        if self.fields is None:
            raise InvalidArgument("schema is not built")
        return self.fields

    def lookup(self, name: str) -> Field | None:
        return Field(name, self.fields[name], self.root) if self.fields and name in self.fields else None

    def field(self, name: str, kind: str) -> Field:
        found = self._checked().get(name)
        if found != kind:
            raise InvalidArgument(f"field {name!r} is {found or 'not declared'}, not {kind}")
        return Field(name, kind, self.root)

    def string(self, name: str) -> Field:
        return self.field(name, "string")

    def int(self, name: str) -> Field:
        return self.field(name, "int")

    def float(self, name: str) -> Field:
        return self.field(name, "float")

    def bool(self, name: str) -> Field:
        return self.field(name, "bool")

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(n, KINDS[k]) for n, k in self._checked().items()])

    def normalise(self, attributes: Mapping[str, object] | None) -> dict[str, object] | None:
        """Attributes coerced to the declared kinds: whole floats to int fields, ints to float fields, nothing else."""
        fields, out = self._checked(), {}
        for name, value in (normalised(attributes) or {}).items():
            if name not in fields:
                raise InvalidArgument(f"attribute {name!r} is not declared")
            kind = scalar(value)[0]
            want = fields[name]
            if kind == want:
                out[name] = value
            elif (want, kind) == ("float", "int"):
                out[name] = float(value)
            elif (want, kind) == ("int", "float") and value == math.floor(value) and -_LONG <= value < _LONG:
                out[name] = int(value)
            else:
                raise InvalidArgument(f"attribute {name!r} is {kind}, not {want}")
        return out or None

    def coerced(self, columns: Mapping[str, tuple[Column, T.DataType]]) -> Column:
        """The struct of this schema from columns of known types, with the same rules; a bad value fails the query."""
        for name in columns:
            if name not in self._checked():
                raise InvalidArgument(f"attribute {name!r} is not declared")
        parts = [_coerced(name, kind, *columns[name]) if name in columns else F.lit(None).cast(KINDS[kind]).alias(name) for name, kind in self._checked().items()]
        if not parts:
            return F.lit(None)
        some = F.greatest(*[p.isNotNull() for p in parts], F.lit(False))
        return F.when(some, F.struct(*parts))


def fits(kind: str, value: Column, given: T.DataType) -> Column | None:
    """Whether a value of a known type can be of a declared kind; None if any can."""
    whole, real = isinstance(given, T.ByteType | T.ShortType | T.IntegerType | T.LongType), isinstance(given, T.FloatType | T.DoubleType)
    if kind == "int" and real:
        x = value.cast("double")
        return value.isNull() | ((x == F.floor(x)) & (x >= -(2.0**63)) & (x < 2.0**63))
    if kind == "float" and real:
        return value.isNull() | ~(F.isnan(value) | (F.abs(value) == float("inf")))
    return None if type(given) is type(KINDS[kind]) or kind in ("int", "float") and whole else value.isNull()


def _coerced(name: str, kind: str, value: Column, given: T.DataType) -> Column:
    fail = F.raise_error(F.lit(f"InvalidArgument: attribute {name} is not {kind}"))
    whole, real = isinstance(given, T.ByteType | T.ShortType | T.IntegerType | T.LongType), isinstance(given, T.FloatType | T.DoubleType)
    target = KINDS[kind]
    if kind == "int" and real:
        x = value.cast("double")
        return F.when(x.isNull(), None).when((x == F.floor(x)) & (x >= -(2.0**63)) & (x < 2.0**63), x.cast("long")).otherwise(fail.cast("long")).alias(name)
    if kind == "float" and (whole or real):
        x = value.cast("double")
        return F.when(x.isNull(), None).when(F.isnan(x) | (F.abs(x) == float("inf")), fail.cast("double")).otherwise(x).alias(name)
    if type(given) is type(target) or (kind == "int" and whole):
        return value.cast(target).alias(name)
    return F.when(value.isNull(), None).otherwise(fail.cast(target)).alias(name)


@dataclass
class SchemaBuilder:
    """Declares fields; later declarations never reach a schema already built."""

    declared: dict[str, str] = field(default_factory=dict)
    root: str = "attributes"

    def _declare(self, name: str, kind: str) -> SchemaBuilder:
        if not is_identifier(name):
            raise InvalidArgument(f"field name {name!r}")
        if name in RESERVED:
            raise InvalidArgument(f"field name {name!r} is reserved")
        if name in self.declared:
            raise InvalidArgument(f"field {name!r} is declared twice")
        self.declared[name] = kind
        return self

    def string(self, name: str) -> SchemaBuilder:
        return self._declare(name, "string")

    def int(self, name: str) -> SchemaBuilder:
        return self._declare(name, "int")

    def float(self, name: str) -> SchemaBuilder:
        return self._declare(name, "float")

    def bool(self, name: str) -> SchemaBuilder:
        return self._declare(name, "bool")

    def build(self) -> Schema:
        return Schema(MappingProxyType(dict(self.declared)), self.root)


def empty_schema() -> Schema:
    return Schema(MappingProxyType({}))


#: The attributes of the document tables.
STANDARD = SchemaBuilder().string("tenant").int("age").float("score").bool("active").build()
