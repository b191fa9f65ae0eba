"""From a spec to a graph of frames, or to running streams."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from weirflow import operators as ops
from weirflow.sources import CSVFile, JDBCTable, JSONFile, KafkaSink, KafkaSource, ParquetFile, RESTEndpoint, SQLiteDatabase, postgres
from weirflow.streaming.runner import StreamRunner
from weirflow.streaming.windows import TimeWindow, windowed_aggregate
from weirflow.validation import DeadLetters, JSONSchema, Validated

from .graph import Context, Graph, Step
from .spec import ConnectorSpec, DeadLetterSpec, KafkaSpec, PipelineSpec, SinkSpec, TransformSpec, chained, check


def _kafka(kind: type, config: KafkaSpec | None, settings: dict[str, Any]):
    if config is None:
        config = KafkaSpec.model_validate(settings)
    out = {"brokers": config.brokers, "topic": config.topic, "consumer_group": config.consumer_group, "format": config.format}
    more = config.model_extra or {}
    if kind is KafkaSink:
        out |= {"condition": config.condition, "key_field": config.key_field}
    else:
        out |= {"schema": more.pop("columns", None)}
    return kind(**out, **{k: v for k, v in more.items() if k in kind.__dataclass_fields__})


def connector(spec: ConnectorSpec) -> Any:
    """The source or sink that a spec names."""
    s = spec.settings()
    kind = spec.type
    needs = {"csv": "path", "json": "path", "jsonl": "path", "parquet": "path", "sqlite": "database", "postgres": "database", "jdbc": "url", "rest": "url"}
    if kind in needs and not getattr(spec, needs[kind]):
        raise ValueError(f"{kind} needs {needs[kind]}")
    if kind == "csv":
        return CSVFile(spec.path, **s)
    if kind in ("json", "jsonl"):
        return JSONFile(spec.path, **({"lines": kind == "jsonl"} | s))
    if kind == "parquet":
        return ParquetFile(spec.path, **s)
    query = {"table": spec.table or "", "query": spec.query or ""}
    if kind == "sqlite":
        return SQLiteDatabase(spec.database, **query, batch_size=spec.batch_size, **s)
    if kind == "postgres":
        return postgres(spec.database, **query, fetch_size=spec.batch_size, batch_size=spec.batch_size, **s)
    if kind == "jdbc":
        return JDBCTable(spec.url, **query, fetch_size=spec.batch_size, batch_size=spec.batch_size, **s)
    if kind == "rest":
        return RESTEndpoint(spec.url, batch_size=spec.batch_size, **s)
    if kind == "kafka":
        return _kafka(KafkaSink if isinstance(spec, SinkSpec) else KafkaSource, spec.config, s)
    raise ValueError(f"unknown type {kind!r}")


def writer(spec: SinkSpec) -> Callable[[DataFrame], int]:
    """What writes a frame to the sink, and gives its rows."""
    s = spec.settings()
    method = s.pop("method", None)
    sink = connector(spec.model_copy(update={"extra": s, "__pydantic_extra__": {}}) if method else spec)
    if isinstance(sink, SQLiteDatabase | JDBCTable):
        return lambda df: sink.write(df, spec.if_exists or "append")
    if isinstance(sink, RESTEndpoint):
        return lambda df: sink.write(df, method or "POST")
    if isinstance(sink, KafkaSink):
        return sink.write
    return lambda df: sink.write(df, spec.mode or "w")


def dead_letter_writer(spec: DeadLetterSpec | None) -> Callable[[DataFrame], object] | None:
    if spec is None:
        return None
    if spec.type == "kafka":
        if spec.config is None:
            raise ValueError("dead_letter of type kafka needs config")
        return _kafka(KafkaSink, spec.config, {}).write
    return lambda df: connector(SinkSpec(type=spec.type, path=spec.path, **(spec.model_extra or {}))).write(df, "a")


def _schema(spec: TransformSpec) -> JSONSchema:
    return JSONSchema(spec.schema_path) if isinstance(spec.schema_path, dict) else JSONSchema.load(spec.schema_path)


def transform(spec: TransformSpec) -> Callable[[list[DataFrame]], DataFrame | Validated]:
    """The operator of a step, over its inputs (several are united) and, for a join, the right side last."""

    def one(f: Callable[[DataFrame], Any]) -> Callable[[list[DataFrame]], Any]:
        return lambda inputs: f(ops.union_all(inputs))

    t = spec
    if t.type == "filter":
        return one(lambda df: ops.filter_rows(df, t.condition))
    if t.type == "map":
        return one(lambda df: ops.map_columns(df, t.columns, t.drop_original))
    if t.type == "aggregate":
        return one(lambda df: ops.aggregate(df, t.group_by or [], t.aggregations, t.order_by))
    if t.type == "join":
        return lambda inputs: ops.join(ops.union_all(inputs[:-1]), inputs[-1], t.on, t.how or "inner", t.suffixes)
    if t.type == "deduplicate":
        return one(lambda df: ops.deduplicate(df, t.keys, t.keep or "first", t.order_by))
    if t.type == "window":
        return one(lambda df: ops.row_window(df, t.size, t.step or 1, t.aggregation or "avg", t.column or "", t.order_by, t.partition_by))
    if t.type == "union":
        return one(lambda df: df)
    if t.type == "schema_validation":
        schema = _schema(t)
        return one(lambda df: schema.validate_rows(df))
    if t.type == "window_aggregate":
        w = TimeWindow(t.window.type, t.window.size, t.window.slide, t.window.gap)
        return one(lambda df: windowed_aggregate(df, w, t.aggregations, t.group_by, t.timestamp, t.lateness))
    raise ValueError(f"unknown type {t.type!r}")


def _valid_only(done: Any, spec: TransformSpec, letters: list[tuple[str, DataFrame]]) -> DataFrame:
    if not isinstance(done, Validated):
        return done
    if spec.on_failure == "dead_letter":
        letters.append((spec.name, done.invalid))
    if spec.on_failure == "raise" and not done.invalid.isEmpty():
        raise ValueError(f"{spec.name}: {done.invalid.select('_errors').first()[0]}")
    return done.valid


def build_graph(spec: PipelineSpec, spark: SparkSession) -> Graph:
    """A step for each source, transform and sink. Sinks, and the dead letters of a validation, are actions."""
    spec = chained(spec)
    if wrong := [w for w in check(spec) if "not defined" in w or "unknown type" in w]:
        raise ValueError("; ".join(wrong))
    graph = Graph(spec.name)
    for name, s in spec.sources.items():
        graph.add_node(Step(f"source:{name}", lambda ctx, c=connector(s): c.read(spark)))
    place = {n: f"source:{n}" for n in spec.sources}
    dead = dead_letter_writer(spec.dead_letter)
    for t in spec.transforms:
        place[t.name] = f"transform:{t.name}"
        run = transform(t)

        def operate(ctx: Context, run=run, t=t) -> DataFrame:
            inputs = [ctx.results[place[i]] for i in [*t.inputs(), *([t.right] if t.right else [])]]
            letters: list[tuple[str, DataFrame]] = []
            out = _valid_only(run(inputs), t, letters)
            for source, invalid in letters:
                if dead:
                    dead(DeadLetters.letters(invalid, source))
            return out

        graph.add_node(Step(place[t.name], operate, retries=0 if t.on_failure == "raise" else 3))
        for i in dict.fromkeys([*t.inputs(), *([t.right] if t.right else [])]):
            graph.add_edge(place[i], place[t.name])
    for name, s in spec.sinks.items():
        inputs = [s.input] if isinstance(s.input, str) else list(s.input or [])
        graph.add_node(Step(f"sink:{name}", lambda ctx, w=writer(s): w(ops.union_all(ctx.inputs)), action=True))
        for i in inputs:
            graph.add_edge(place[i], f"sink:{name}")
    return graph


def streaming_runners(spec: PipelineSpec, spark: SparkSession, streams: dict[str, DataFrame] | None = None) -> dict[str, StreamRunner]:
    """A runner for each sink. streams: streaming frames in place of sources. A validation is made before the steps after it, in the
    plan; its invalid rows go to the dead letters in a runner of their own."""
    spec = chained(spec)
    frames: dict[str, DataFrame] = {n: (streams or {}).get(n) if n in (streams or {}) else connector(s).read_stream(spark) for n, s in spec.sources.items()}
    out: dict[str, StreamRunner] = {}
    dead = dead_letter_writer(spec.dead_letter)
    for t in spec.transforms:
        done = transform(t)([frames[i] for i in [*t.inputs(), *([t.right] if t.right else [])]])
        if isinstance(done, Validated):
            if t.on_failure == "dead_letter" and dead:
                letters = DeadLetters.letters(done.invalid, t.name)
                out[f"dead_letter:{t.name}"] = StreamRunner(letters, lambda df, _, d=dead: d(df), name=f"{spec.name}-dead-{t.name}")
            done = done.valid
        frames[t.name] = done
    for name, s in spec.sinks.items():
        write = writer(s)
        inputs = [s.input] if isinstance(s.input, str) else list(s.input or [])
        source = ops.union_all([frames[i] for i in inputs])
        out[name] = StreamRunner(source, lambda df, _, w=write: w(df), name=f"{spec.name}-{name}")
    return out
