"""Semantic model documents (YAML or JSON): datasets of one-column fields bound to sources, with governed metrics and concepts.

What a document states and the engine can't do is an error, never left out.  Keys are kept as declarations, not enforced.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.plans import catalog as C

#: Logical types of documents and the Spark types that fit them (fixed values).
FITS = {
    "String": (T.StringType,), "Integer": (T.ByteType, T.ShortType, T.IntegerType, T.LongType), "Float": (T.FloatType, T.DoubleType), "Decimal": (T.DecimalType,),
    "Boolean": (T.BooleanType,), "Date": (T.DateType,), "DateTime": (T.TimestampNTZType,), "DateTimeTz": (T.TimestampType,),
}


class ImportError_(ValueError):
    """All problems of a document: (code, path, message)."""

    def __init__(self, problems: list[tuple[str, str, str]]):
        super().__init__("; ".join(f"{c} at {p}: {m}" for c, p, m in problems))
        self.problems = problems


@dataclass
class Dataset:
    name: str
    source: str
    #: (field name, physical column, logical type or None)
    fields: list[tuple[str, str, str | None]]
    meaning: C.Meaning = field(default_factory=C.Meaning)


def parse(text: str) -> Mapping:
    """A document as JSON values; duplicate keys are refused."""

    def pairs(items):
        out = {}
        for k, v in items:
            if k in out:
                raise ImportError_([("parse", "/", f"duplicate key {k!r}")])
            out[k] = v
        return out

    try:
        return json.loads(text, object_pairs_hook=pairs)
    except json.JSONDecodeError:
        pass
    try:
        import yaml
    except ImportError:
        raise ImportError_([("parse", "/", "not JSON, and no YAML parser is installed")]) from None

    class Strict(yaml.SafeLoader):
        pass

    Strict.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, lambda loader, node: pairs([(loader.construct_object(k, True), loader.construct_object(v, True)) for k, v in node.value]))
    try:
        return yaml.load(text, Strict)
    except yaml.YAMLError as e:
        raise ImportError_([("parse", "/", str(e))]) from None


def _column(expression: str) -> str | None:
    if re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", expression):
        return expression
    if m := re.fullmatch(r'"((?:[^"]|"")+)"', expression):
        return m[1].replace('""', '"')
    return None


def inspect(document: Mapping, model: str | None = None) -> list[Dataset]:
    """The datasets of one model, checked without any data."""
    problems: list[tuple[str, str, str]] = []
    models = document.get("semantic_model") if isinstance(document, Mapping) else None
    if not isinstance(models, list) or not models:
        raise ImportError_([("schema", "/semantic_model", "a list of models is needed")])
    names = [m.get("name") for m in models]
    if len(set(names)) != len(names):
        raise ImportError_([("duplicate_model", "/semantic_model", "model names repeat")])
    chosen = [m for m in models if model is None or m.get("name") == model]
    if len(chosen) != 1:
        raise ImportError_([("model_selection", "/semantic_model", f"one of {names}")])
    (m,) = chosen
    for k in set(m) - {"name", "description", "datasets", "metrics", "relationships", "ai_context", "custom_extensions"}:
        problems.append(("schema", f"/{k}", "unknown member"))
    out: dict[str, Dataset] = {}
    for i, d in enumerate(m.get("datasets") or []):
        path = f"/datasets/{i}"
        if not C.NAME.fullmatch(str(d.get("name"))) or d["name"] in out:
            problems.append(("invalid_name", f"{path}/name", str(d.get("name"))))
            continue
        fields = []
        for j, f in enumerate(d.get("fields") or []):
            dialects = {x.get("dialect"): x.get("expression") for x in (f.get("expression") or {}).get("dialects", [])}
            column = _column(str(dialects.get("ANSI_SQL", "")))
            if not C.NAME.fullmatch(str(f.get("name"))) or f["name"] in [x[0] for x in fields]:
                problems.append(("invalid_name", f"{path}/fields/{j}/name", str(f.get("name"))))
            elif column is None:
                problems.append(("unsupported_expression", f"{path}/fields/{j}/expression", str(dialects)))
            elif f.get("datatype") is not None and f["datatype"] not in FITS:
                problems.append(("unsupported_type", f"{path}/fields/{j}/datatype", f["datatype"]))
            else:
                fields.append((f["name"], column, f.get("datatype")))
        if not fields:
            problems.append(("missing_fields", f"{path}/fields", "one field at least"))
        own = [x[0] for x in fields]
        keys = [d["primary_key"]] if d.get("primary_key") else []
        for key in (keys := [*keys, *(d.get("unique_keys") or [])]):
            if not key or len(set(key)) != len(key) or set(key) - set(own):
                problems.append(("invalid_key", path, str(key)))
        out[d["name"]] = Dataset(d["name"], str(d.get("source")), fields, C.Meaning(keys=tuple(map(tuple, keys))))
    for i, r in enumerate(m.get("relationships") or []):
        left, right = out.get(r.get("from")), out.get(r.get("to"))
        pairs = list(zip(r.get("from_columns") or [], r.get("to_columns") or []))
        if not left or not right or not pairs or not r.get("name"):
            problems.append(("unsupported_relationship", f"/relationships/{i}", str(r.get("name"))))
            continue
        new = C.Relationship(r["name"], right.name, r.get("role", r["name"]), tuple(pairs), bool(r.get("null_keys_match", False)))
        left.meaning = C.replace(left.meaning, relationships=(*left.meaning.relationships, new))
    for i, x in enumerate(m.get("metrics") or []):
        expression = next((e.get("expression", "") for e in (x.get("expression") or {}).get("dialects", []) if e.get("dialect") == "ANSI_SQL"), "")
        found = re.fullmatch(r"(SUM|COUNT|AVG|MIN|MAX)\((?:(\w+)\.)?(\w+|\*)\)", expression.strip(), re.I)
        owner = out.get(found[2]) if found and found[2] else next(iter(out.values()), None) if len(out) == 1 else None
        if not found or owner is None or found[3] != "*" and found[3] not in [f[0] for f in owner.fields] or found[3] == "*" and found[1].upper() != "COUNT":
            problems.append(("unsupported_metric", f"/metrics/{i}", expression))
            continue
        new = C.Metric(str(x.get("name")), found[1].lower(), None if found[3] == "*" else found[3], aliases=tuple(x.get("synonyms") or ()), dimensions=frozenset(x.get("dimensions") or [f[0] for f in owner.fields]))
        owner.meaning = C.replace(owner.meaning, metrics=(*owner.meaning.metrics, new))
    for i, e in enumerate(m.get("custom_extensions") or []):
        problems += _extension(out, e, f"/custom_extensions/{i}")
    if problems:
        raise ImportError_(problems)
    return list(out.values())


def _extension(datasets: dict[str, Dataset], e: Mapping, path: str) -> list[tuple[str, str, str]]:
    d = datasets.get(e.get("dataset"))
    if d is None:
        return [("invalid_extension", path, "unknown dataset")]
    m, kind = d.meaning, e.get("kind")
    own = [f[0] for f in d.fields]
    if kind in ("enum_mapping", "field_unit", "comparison_profile", "reference_system") and e.get("field") not in own:
        return [("invalid_extension", path, "unknown field")]
    old = m.fields.get(e.get("field"), C.FieldMeaning())
    if kind == "enum_mapping":
        domain = e.get("domain")
        d.meaning = C.replace(m, mappings={**m.mappings, e["name"]: (domain, dict(e["values"]))}, fields={**m.fields, e["field"]: C.replace(old, enum_domain=domain)})
    elif kind == "field_unit":
        d.meaning = C.replace(m, fields={**m.fields, e["field"]: C.replace(old, unit=e["unit"])})
    elif kind == "comparison_profile":
        d.meaning = C.replace(m, fields={**m.fields, e["field"]: C.replace(old, comparison=e["profile"])})
    elif kind == "reference_system":
        d.meaning = C.replace(m, fields={**m.fields, e["field"]: C.replace(old, reference_system=e["system"])})
    elif kind == "concept":
        d.meaning = C.replace(m, concepts=(*m.concepts, C.Concept(e["name"], e["predicate"], tuple(e.get("synonyms") or ()), e.get("parameters") or {})))
    elif kind == "conversion":
        d.meaning = C.replace(m, conversions=(*m.conversions, C.Conversion(e["name"], e["field"], int(e["numerator"]), int(e["denominator"]), e.get("unit"), e.get("rounding") == "half_even")))
    elif kind == "row_policy":
        d.meaning = C.replace(m, policies=(*m.policies, (e["name"], tuple(C.Filter(f["field"], f["operator"], f["value"]) for f in e["filters"]))))
    else:
        return [("invalid_extension", path, f"unknown kind {kind!r}")]
    return []


def load(engine, document: Mapping, bindings: Mapping[str, DataFrame | Callable[[], DataFrame]], model: str | None = None) -> list[str]:
    """Register the model's datasets in the engine, over the bound sources; nothing is registered if anything is wrong."""
    datasets = inspect(document, model)
    problems, ready = [], []
    for d in datasets:
        if d.source not in bindings:
            problems.append(("missing_binding", f"/{d.name}/source", d.source))
            continue
        df = bindings[d.source]
        df = df() if callable(df) else df
        for name, column, kind in d.fields:
            if column not in df.columns:
                problems.append(("missing_column", f"/{d.name}/{name}", column))
            elif kind is not None and not isinstance(df.schema[column].dataType, FITS[kind]):
                problems.append(("type_mismatch", f"/{d.name}/{name}", f"{kind}, {df.schema[column].dataType.simpleString()}"))
        ready.append((d, df))
    if problems:
        raise ImportError_(problems)
    for d, df in ready:
        engine.register(d.name, df.select(*(F.col("`" + c.replace("`", "``") + "`").alias(n) for n, c, _ in d.fields)), d.meaning)
    return [d.name for d in datasets]
