"""Project files: connections, sources, views and a model, in one YAML or JSON document; paths are relative to it."""

from __future__ import annotations

import os
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import SparkSession

from marlstone.plans import imports
from marlstone.plans.errors import CompileError
from marlstone.session import Engine, plan_facts
from marlstone.sources.connectors import Registry
from marlstone.sources.files import FileSource, SourceError, read
from marlstone.sources.generations import Materialized

MEMBERS = {"cache", "model_file", "model", "connections", "sources", "views"}


class Project:
    """A checked project; ``secrets`` resolves ``${NAME}`` in connection options (by default from the environment)."""

    def __init__(self, path: str, secrets=os.environ.get):
        self.path, self.secrets = Path(path), secrets
        self.config = imports.parse(self.path.read_text())
        if not isinstance(self.config, Mapping) or set(self.config) - MEMBERS:
            raise SourceError(f"{path}: unknown members {sorted(set(self.config) - MEMBERS)}")
        for name, s in self.config.get("sources", {}).items():
            if s.get("connection") is not None and s["connection"] not in self.config.get("connections", {}):
                raise SourceError(f"{name}: unknown connection {s['connection']}")

    def near(self, name: str) -> str:
        return name if "://" in name or os.path.isabs(name) else str(self.path.parent / name)

    def option(self, value):
        if isinstance(value, str) and value.startswith("${") and value.endswith("}"):
            found = self.secrets(value[2:-1])
            if found is None:
                raise SourceError(f"{value} is not set")
            return found
        return value

    def views(self, spark: SparkSession) -> list[tuple[str, str, Mapping]]:
        """(name, SQL, options) of the views, those that others read first."""
        texts = {n: (Path(self.near(v["sql_file"])).read_text(), v) for n, v in self.config.get("views", {}).items()}
        reads = {n: {p[-1] for p in plan_facts(spark, t)[1]} & set(texts) for n, (t, _) in texts.items()}
        out: list[str] = []
        while len(out) < len(texts):
            ready = sorted(n for n in texts if n not in out and reads[n] <= set(out))
            if not ready:
                raise CompileError("view_lineage", "views depend on one another")
            out += ready
        return [(n, *texts[n]) for n in out]

    def load(self, spark: SparkSession, registry: Registry | None = None) -> Engine:
        engine, registry = Engine(spark), registry or Registry()
        for name, c in self.config.get("connections", {}).items():
            registry.connect(name, c["connector"], {k: self.option(v) for k, v in c.items() if k != "connector"})
        bound = {}
        for name, s in self.config.get("sources", {}).items():
            if s.get("connection") is not None:
                bound[name] = registry.deferred(engine.spark, s["connection"], s.get("table", name))
            else:
                extra = {k: v for k, v in s.items() if k in ("format", "header", "delimiter", "quote", "escape", "null_regex", "infer_records")}
                bound[name] = lambda s=s, extra=extra: read(engine.spark, FileSource(self.near(s["path"]), **extra))
        if "model_file" in self.config:
            imports.load(engine, imports.parse(Path(self.near(self.config["model_file"])).read_text()), bound, self.config.get("model"))
        else:
            for name, get in bound.items():
                engine.register(name, get)
        kept = Materialized(engine.spark, self.near(self.config["cache"]["folder"])) if "cache" in self.config else None
        for name, sql, v in self.views(engine.spark):
            engine.view(name, sql)
            if v.get("max_age_seconds") is not None and kept is not None:
                frame = kept.get(name, f"{engine.catalog.current.id} {sql}", lambda name=name: engine.spark.table(name), float(v["max_age_seconds"]), v.get("max_rows"))
                frame.createOrReplaceTempView(name)
        return engine
