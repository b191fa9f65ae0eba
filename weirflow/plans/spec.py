"""Pipelines as YAML says them."""

from __future__ import annotations

from typing import Any, Literal

import yaml
from pydantic import BaseModel, ConfigDict, Field

SOURCES = ("csv", "json", "jsonl", "parquet", "sqlite", "postgres", "jdbc", "rest", "kafka")
TRANSFORMS = ("filter", "map", "aggregate", "join", "deduplicate", "window", "union", "schema_validation", "window_aggregate")


class _Open(BaseModel):
    """Other keys are settings of the connector, as those under extra are."""

    model_config = ConfigDict(populate_by_name=True, extra="allow")


class KafkaSpec(_Open):
    brokers: list[str] = Field(default_factory=lambda: ["localhost:9092"])
    topic: str
    consumer_group: str = "weirflow"
    format: str = "json"
    schema_config: dict[str, Any] | str | None = Field(default=None, alias="schema")
    condition: str | None = None
    key_field: str | None = None


class WindowSpec(_Open):
    type: Literal["tumbling", "sliding", "session"]
    size: str | float = "60s"
    slide: str | float | None = None
    gap: str | float | None = None


class DeadLetterSpec(_Open):
    type: str = "kafka"
    path: str | None = None
    config: KafkaSpec | None = None


class ConnectorSpec(_Open):
    type: str
    path: str | None = None
    database: str | None = None
    query: str | None = None
    table: str | None = None
    url: str | None = None
    batch_size: int = Field(default=1000, ge=1)
    config: KafkaSpec | None = None
    extra: dict[str, Any] = Field(default_factory=dict)

    def settings(self) -> dict[str, Any]:
        return {**(self.model_extra or {}), **self.extra}


class SourceSpec(ConnectorSpec):
    pass


class SinkSpec(ConnectorSpec):
    input: str | list[str] | None = None
    mode: str | None = None
    if_exists: str | None = None


class TransformSpec(_Open):
    name: str
    type: str
    input: str | list[str] | None = None
    condition: str | None = None
    columns: dict[str, str] | None = None
    drop_original: bool = False
    group_by: list[str] | None = None
    aggregations: dict[str, str] | None = None
    on: str | list[str] | None = None
    how: str | None = None
    right: str | None = None
    suffixes: tuple[str, str] = ("_left", "_right")
    keys: list[str] | None = None
    keep: str | None = None
    order_by: list[str] | None = None
    partition_by: list[str] | None = None
    size: int | None = None
    step: int | None = None
    column: str | None = None
    aggregation: str | None = None
    schema_path: str | dict[str, Any] | None = Field(default=None, alias="schema")
    on_failure: Literal["dead_letter", "drop", "raise"] | None = None
    window: WindowSpec | None = None
    timestamp: str | None = None
    lateness: str | float | None = None

    def inputs(self) -> list[str]:
        return [] if self.input is None else [self.input] if isinstance(self.input, str) else list(self.input)


class PipelineSpec(BaseModel):
    model_config = ConfigDict(populate_by_name=True)

    name: str
    version: str = "1.0"
    mode: Literal["batch", "streaming"] = "batch"
    sources: dict[str, SourceSpec]
    transforms: list[TransformSpec] = Field(default_factory=list)
    sinks: dict[str, SinkSpec]
    dead_letter: DeadLetterSpec | None = None


def _named(data: Any) -> Any:
    """data with keys as they were written: YAML takes a bare `on` for true."""
    if isinstance(data, dict):
        return {("on" if k is True else k): _named(v) for k, v in data.items()}
    return [_named(v) for v in data] if isinstance(data, list) else data


def parse(text: str) -> PipelineSpec:
    """A spec from YAML. Name, version and mode may stand under pipeline, or at the top."""
    data = _named(yaml.safe_load(text))
    if not isinstance(data, dict):
        raise ValueError("not a pipeline: a mapping is needed")
    head = data.pop("pipeline", None)
    if isinstance(head, dict):
        data = head | data
    return PipelineSpec.model_validate(data)


def load(path: str) -> PipelineSpec:
    with open(path, encoding="utf-8") as f:
        return parse(f.read())


def chained(spec: PipelineSpec) -> PipelineSpec:
    """The spec with each missing input filled in: the step before, or the only source for the first one."""
    spec = spec.model_copy(deep=True)
    before = next(iter(spec.sources)) if len(spec.sources) == 1 else None
    for t in spec.transforms:
        t.input = t.input if t.input is not None else before
        before = t.name
    for s in spec.sinks.values():
        s.input = s.input if s.input is not None else before
    return spec


def check(spec: PipelineSpec) -> list[str]:
    """What is wrong with the spec, as warnings."""
    out: list[str] = []
    if not spec.sources:
        out.append("no sources")
    if not spec.sinks:
        out.append("no sinks")
    known = set(spec.sources)
    for n, s in spec.sources.items():
        if s.type not in SOURCES:
            out.append(f"source {n!r}: unknown type {s.type!r}")
    names = [t.name for t in spec.transforms]
    out += [f"transform {n!r}: name used twice" for n in sorted({n for n in names if names.count(n) > 1 or n in spec.sources})]
    needed = {"filter": ("condition",), "map": ("columns",), "aggregate": ("aggregations",), "join": ("on",), "deduplicate": ("keys",), "window": ("size",), "schema_validation": ("schema_path",), "window_aggregate": ("window", "aggregations")}
    for t in chained(spec).transforms:
        if t.type not in TRANSFORMS:
            out.append(f"transform {t.name!r}: unknown type {t.type!r}")
        out += [f"transform {t.name!r}: {f} is missing" for f in needed.get(t.type, ()) if not getattr(t, f)]
        inputs = [*t.inputs(), *([t.right] if t.right else [])]
        if not inputs:
            out.append(f"transform {t.name!r}: no input")
        out += [f"transform {t.name!r}: input {i!r} is not defined before it" for i in inputs if i not in known]
        known.add(t.name)
    for n, s in chained(spec).sinks.items():
        if s.type not in SOURCES:
            out.append(f"sink {n!r}: unknown type {s.type!r}")
        if not s.input:
            out.append(f"sink {n!r}: no input")
        out += [f"sink {n!r}: input {i!r} is not defined" for i in ([s.input] if isinstance(s.input, str) else s.input or []) if i not in known]
    return out
