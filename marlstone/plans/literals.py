"""Typed literals and predicates of proposals."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Callable, Mapping
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.plans.errors import CompileError

INTEGERS = {"int16": (T.ShortType(), 15), "int32": (T.IntegerType(), 31), "int64": (T.LongType(), 63)}
OPERATORS: dict[str, Callable[[Column, Column], Column]] = {
    "eq": lambda a, b: a == b, "not_eq": lambda a, b: a != b, "lt": lambda a, b: a < b,
    "lt_eq": lambda a, b: a <= b, "gt": lambda a, b: a > b, "gt_eq": lambda a, b: a >= b,
}
MAX_DEPTH = 32


def take(x: Mapping, *required: str, **optional):
    """The values of a JSON object's members, in order; a missing or an unknown one is an error."""
    if not isinstance(x, Mapping) or set(x) - {*required, *optional} or set(required) - set(x):
        raise CompileError("invalid_requirement", f"expected {', '.join(required)}, found {sorted(x) if isinstance(x, Mapping) else x!r}")
    out = [x[k] for k in required] + [x.get(k, v) for k, v in optional.items()]
    return out if len(out) != 1 else out[0]


def literal(lit: Mapping) -> tuple[T.DataType, Column]:
    """Type and column of a literal ``{"type", "value"}``."""
    kind, value = take(lit, "type", "value")
    if kind == "boolean" and isinstance(value, bool):
        return T.BooleanType(), F.lit(value)
    if kind in INTEGERS and isinstance(value, int) and not isinstance(value, bool):
        t, bits = INTEGERS[kind]
        if -(2**bits) <= value < 2**bits:
            return t, F.lit(value).cast(t)
    if kind == "uint64" and isinstance(value, int) and 0 <= value < 2**64:
        return T.DecimalType(20, 0), F.lit(Decimal(value)).cast("decimal(20,0)")
    if kind == "float64" and isinstance(value, (int, float)) and not isinstance(value, bool):
        if not math.isfinite(value):
            raise CompileError("float_literal", "a finite number is needed")
        return T.DoubleType(), F.lit(float(value))
    if kind == "utf8" and isinstance(value, str):
        return T.StringType(), F.lit(value)
    if kind == "decimal128":
        coefficient, precision, scale = take(value, "coefficient", "precision", "scale")
        number = int(coefficient)
        if not (0 < precision <= 38 and 0 <= scale <= precision and abs(number) < 10**precision):
            raise CompileError("decimal_literal")
        return T.DecimalType(precision, scale), F.lit(Decimal(number).scaleb(-scale)).cast(T.DecimalType(precision, scale))
    if kind == "date32" and isinstance(value, int):
        return T.DateType(), F.lit(dt.date(1970, 1, 1) + dt.timedelta(days=value))
    if kind == "timestamp":
        ticks, unit, zone = take(value, "ticks", "unit", timezone=None)
        per = {"second": 10**6, "millisecond": 10**3, "microsecond": 1}.get(unit)
        if zone not in (None, "UTC", "+00:00"):
            raise CompileError("timestamp_timezone", zone)
        if per is None:
            raise CompileError("timestamp_timezone", "nanoseconds can't be held")
        instant = F.timestamp_micros(F.lit(ticks * per).cast("bigint"))
        return (T.TimestampType(), instant) if zone else (T.TimestampNTZType(), instant.cast("timestamp_ntz"))
    raise CompileError("comparison_type", f"{lit!r} is no literal")


class Predicates:
    """Predicate trees over fields or output slots."""

    def __init__(self, resolve: Callable[[object], tuple[Column, T.DataType, object]], mappings: Mapping | None = None, parameters: Mapping | None = None):
        """``resolve`` gives column, type and meaning (or None) of a reference."""
        self.resolve, self.mappings, self.parameters = resolve, mappings or {}, parameters

    def column(self, p: Mapping, depth: int = 0) -> Column:
        if depth >= MAX_DEPTH:
            raise CompileError("work_limit", "a predicate is too deep")
        kind = p.get("kind") if isinstance(p, Mapping) else None
        if kind in ("all", "any"):
            _, parts = take(p, "kind", "predicates")
            if not parts:
                raise CompileError("empty_boolean")
            cols = [self.column(q, depth + 1) for q in parts]
            out = cols[0]
            for c in cols[1:]:
                out = out & c if kind == "all" else out | c
            return out
        if kind == "not":
            return ~self.column(take(p, "kind", "predicate")[1], depth + 1)
        if kind == "is_null":
            _, ref, negated = take(p, "kind", "field", "negated")
            c = self.resolve(ref)[0]
            return c.isNotNull() if negated else c.isNull()
        if kind == "compare":
            _, ref, op, value = take(p, "kind", "field", "operator", "value")
            return self.compare(ref, op, value)
        if kind == "compare_parameter":
            _, ref, op, name = take(p, "kind", "field", "operator", "parameter")
            if self.parameters is None or name not in self.parameters:
                raise CompileError("unbound_parameter", name)
            return self.compare(ref, op, self.parameters[name])
        if kind == "compare_mapped":
            _, ref, op, mapping, phrase = take(p, "kind", "field", "operator", "mapping", "phrase")
            if mapping not in self.mappings:
                raise CompileError("unknown_value_mapping", mapping)
            domain, codes = self.mappings[mapping]
            meaning = self.resolve(ref)[2]
            if domain is not None and getattr(meaning, "enum_domain", None) != domain:
                raise CompileError("enum_domain", mapping)
            if phrase not in codes:
                raise CompileError("unresolved_value", phrase)
            return self.compare(ref, op, {"type": "utf8", "value": codes[phrase]}, mapped=True)
        raise CompileError("invalid_requirement", f"{kind!r} is no predicate")

    def compare(self, ref, op: str, value: Mapping, mapped: bool = False) -> Column:
        column, kind, meaning = self.resolve(ref)
        if op not in OPERATORS:
            raise CompileError("comparison_operator", op)
        if getattr(meaning, "comparison", "binary") != "binary":
            raise CompileError("comparison_profile")
        t, lit = literal(value)
        if t != kind:
            raise CompileError("comparison_type", f"{t.simpleString()} against {kind.simpleString()}")
        if isinstance(kind, T.BooleanType) and op not in ("eq", "not_eq"):
            raise CompileError("comparison_operator", op)
        return OPERATORS[op](column, lit)
