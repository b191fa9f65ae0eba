from __future__ import annotations

import json
import threading
import time
import urllib.request

import pytest

from weirflow import cli
from weirflow.monitoring import MetricsCollector, serve
from weirflow.monitoring.server import answer
from weirflow.plans.build import build_graph, connector, streaming_runners
from weirflow.plans.executor import Executor
from weirflow.plans.graph import CycleError, Graph, Step
from weirflow.plans.runs import RunStore, run_metrics
from weirflow.plans.spec import SourceSpec, check, parse
from weirflow.plans.state import RunState, Status, StepState


def graph(*edges, operation=lambda ctx: 1, **more):
    g = Graph("g")
    for s in sorted({x for e in edges for x in e}):
        g.add_node(Step(s, operation, **more))
    for a, b in edges:
        g.add_edge(a, b)
    return g


DIAMOND = [("A", "B"), ("A", "C"), ("B", "D"), ("C", "D")]


def test_graph_order_and_neighbours():
    g = graph(*DIAMOND)
    assert g.order() == ["A", "B", "C", "D"] and g.roots() == ["A"]
    assert g.dependencies("D") == ["B", "C"] and g.dependents("A") == ["B", "C"] and len(g.edges) == 4 and set(g.nodes) == set("ABCD")
    assert g.validate() == []


def test_graph_errors():
    g = graph(("A", "B"))
    for bad, kind in ((("A", "A"), ValueError), (("A", "B"), ValueError), (("A", "X"), KeyError)):
        with pytest.raises(kind):
            g.add_edge(*bad)
    with pytest.raises(ValueError):
        g.add_node(Step("A", None))
    with pytest.raises(ValueError):
        Graph().validate()
    with pytest.raises(CycleError):
        graph(("A", "B"), ("B", "C"), ("C", "A")).order()
    g.add_node(Step("alone", None))
    assert g.validate() == ["step 'alone' is connected to nothing"]


def test_state_goes_forward():
    s = RunState("p", {x: StepState(x) for x in "ab"})
    assert s.ready({"b": ["a"]}) == ["a"]
    s.start()
    with pytest.raises(ValueError):
        s.start()
    s.step_started("a")
    s.step_done("a", 5)
    assert s.ready({"b": ["a"]}) == ["b"]
    s.cancel()
    assert s.status is Status.CANCELLED and s.ready({"b": ["a"]}) == [] and s.steps["b"].status is Status.CANCELLED
    d = s.to_dict()
    assert d["summary"]["completed"] == 1 and d["nodes"]["a"]["output_records"] == 5 and json.dumps(d)


def test_executor_runs_in_order_and_passes_results():
    seen = []

    def operation(ctx):
        seen.append(ctx.step)
        return 1 + sum(ctx.inputs)

    ex = Executor(graph(*DIAMOND, operation=operation), on_step=lambda s, st: seen.append(s.lower()))
    state = ex.execute()
    assert state.status is Status.COMPLETED and ex.results == {"A": 1, "B": 2, "C": 2, "D": 5}
    assert seen[0] == "A" and seen[-1] == "d" and state.steps["D"].input_records == 4


def test_executor_retries_and_fails():
    tries, naps = [], []

    def flaky(ctx):
        tries.append(1)
        if len(tries) < 3:
            raise RuntimeError("not yet")
        return 7

    ex = Executor(graph(("A", "B"), operation=flaky), sleep=naps.append)
    assert ex.execute().status is Status.COMPLETED and naps == [1.0, 2.0] and ex.state.steps["A"].attempts == 3

    def broken(ctx):
        raise RuntimeError("never")

    naps.clear()
    ex = Executor(graph(("A", "B"), operation=broken, retries=7), sleep=naps.append)
    state = ex.execute()
    assert state.status is Status.FAILED and "never" in state.error and state.steps["B"].status is Status.PENDING
    assert naps == [1, 2, 4, 8, 16, 32, 60]


def test_executor_timeout():
    state = Executor(graph(("A", "B"), operation=lambda ctx: time.sleep(5), timeout=0.05, retries=0)).execute()
    assert state.status is Status.FAILED and "0.05" in state.error


def test_executor_counts_rows_without_jobs_of_its_own(spark):
    g = Graph("rows")
    g.add_node(Step("read", lambda ctx: spark.range(10)))
    g.add_node(Step("filter", lambda ctx: ctx.inputs[0].filter("id > 5")))
    g.add_node(Step("sink", lambda ctx: len(ctx.inputs[0].collect()), action=True))
    g.add_node(Step("other", lambda ctx: len(ctx.inputs[0].collect()), action=True))
    for e in (("read", "filter"), ("filter", "sink"), ("filter", "other")):
        g.add_edge(*e)
    ex = Executor(g, spark)
    state = ex.execute()
    assert state.status is Status.COMPLETED, state.error
    assert ex.results["sink"] == ex.results["other"] == state.steps["sink"].output_records == 4
    assert state.steps["read"].output_records in (10, None) and state.steps["filter"].output_records in (4, None)


YAML = """
pipeline:
  name: sales
  version: "2.0"
sources:
  raw:
    type: csv
    path: {dir}/sales.csv
    delimiter: ";"
  names:
    type: jsonl
    path: {dir}/names.jsonl
transforms:
  - name: positive
    type: filter
    input: raw
    condition: "amount > 0"
  - name: totals
    type: map
    columns: {{total: "price * quantity", region_upper: "upper(region)"}}
  - name: named
    type: join
    input: totals
    right: names
    on: region
    how: left
  - name: by_region
    type: aggregate
    group_by: [region_upper, label]
    aggregations: {{sales: "sum(total)", n: "count()"}}
sinks:
  warehouse:
    type: sqlite
    input: by_region
    database: {dir}/out.db
    table: sales
  copy:
    type: json
    input: by_region
    path: {dir}/copy
"""


@pytest.fixture
def files(tmp_path):
    (tmp_path / "sales.csv").write_text("region;price;quantity;amount\nn;2.5;4;10\ns;1;3;-1\nn;1;1;1\n")
    (tmp_path / "names.jsonl").write_text('{"region": "n", "label": "North"}\n')
    (tmp_path / "p.yaml").write_text(YAML.format(dir=tmp_path))
    return tmp_path


def test_yaml_pipeline_runs(spark, files):
    spec = parse((files / "p.yaml").read_text())
    assert (spec.name, spec.version, check(spec)) == ("sales", "2.0", [])
    state = Executor(build_graph(spec, spark), spark).execute()
    assert state.status is Status.COMPLETED, state.error
    from weirflow.sources import SQLiteDatabase

    assert [tuple(r) for r in SQLiteDatabase(str(files / "out.db"), "sales").read(spark).collect()] == [("N", "North", 11.0, 2)]
    assert spark.read.option("multiLine", True).json(str(files / "copy")).count() == 1
    assert state.steps["sink:warehouse"].output_records == 1


def test_specs_are_checked():
    bad = parse("name: x\nsources: {a: {type: xml}}\ntransforms: [{name: t, type: filter, input: nothing}, {name: t, type: magic, input: a}]\nsinks: {o: {type: csv, input: gone, path: p}}")
    text = " | ".join(check(bad))
    for part in ("unknown type 'xml'", "condition is missing", "'nothing' is not defined", "used twice", "unknown type 'magic'", "'gone' is not defined"):
        assert part in text
    with pytest.raises(ValueError):
        build_graph(bad, None)
    with pytest.raises(ValueError):
        parse("- 1")
    with pytest.raises(ValueError):
        connector(SourceSpec(type="csv"))


def test_validation_in_yaml_sends_dead_letters(spark, tmp_path):
    spark.createDataFrame([("sn1", 5.0), ("sn2", -1.0)], "id string, level double").write.parquet(str(tmp_path / "in"))
    (tmp_path / "s.json").write_text(json.dumps({"type": "object", "properties": {"level": {"type": "number", "minimum": 0}}}))
    text = f"""
name: v
sources: {{sn: {{type: parquet, path: {tmp_path}/in}}}}
transforms:
  - {{name: ok, type: schema_validation, schema: {tmp_path}/s.json, on_failure: dead_letter}}
  - {{name: w, type: window_aggregate, window: {{type: tumbling, size: 60s}}, group_by: [id], aggregations: {{total: sum(level)}}}}
sinks: {{out: {{type: parquet, path: {tmp_path}/out}}}}
dead_letter: {{type: jsonl, path: {tmp_path}/dead}}
"""
    state = Executor(build_graph(parse(text), spark), spark).execute()
    assert state.status is Status.COMPLETED, state.error
    assert [r.total for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [5.0]
    assert [json.loads(r.record)["id"] for r in spark.read.json(str(tmp_path / "dead")).collect()] == ["sn2"]
    strict = parse(text.replace("on_failure: dead_letter", "on_failure: raise"))
    assert "minimum" in Executor(build_graph(strict, spark), spark).execute().error


def test_streaming_yaml(spark, tmp_path):
    spark.createDataFrame([(1, 5), (2, -1)], "id int, v int").write.parquet(str(tmp_path / "in"))
    spec = parse(f"""
pipeline: {{name: s, mode: streaming}}
sources: {{a: {{type: parquet, path: {tmp_path}/in}}}}
transforms: [{{name: f, type: filter, condition: "v > 0"}}]
sinks: {{out: {{type: parquet, path: {tmp_path}/out, mode: append}}}}
""")
    for name, runner in streaming_runners(spec, spark).items():
        runner.run(str(tmp_path / "check" / name))
    assert [r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [1]


def run_dict(i, status="completed", name="p"):
    return {"run_id": f"r{i}", "pipeline": name, "status": status, "created_at": f"2024-01-0{i}T00:00:00", "duration": float(i), "nodes": {"a": {"output_records": 10}}}


def test_run_store(spark, tmp_path):
    store = RunStore(str(tmp_path / "runs.db"))
    for i in (1, 2, 3):
        store.save(run_dict(i, "running", "p" if i < 3 else "q"))
    store.save(run_dict(2, "failed"))
    assert store.get("r2")["status"] == "failed" and store.get("none") is None
    assert [r["run_id"] for r in store.recent(2)] == ["r3", "r2"] and [r["run_id"] for r in store.recent(pipeline="p")] == ["r2", "r1"]
    totals = run_metrics(store.frame(spark)).first()
    assert (totals.total_runs, totals.failed_runs, totals.successful_runs, totals.avg_duration) == (3, 1, 0, 2.0)


def test_monitoring(tmp_path):
    runs = MetricsCollector()
    for i, status in ((1, "completed"), (2, "failed")):
        runs.record(run_dict(i, status))
    assert answer("/health", runs) == (200, {"status": "healthy"})
    assert [r["run_id"] for r in answer("/pipelines", runs)[1]] == ["r2", "r1"]
    assert answer("/pipelines/r1", runs)[1]["status"] == "completed" and answer("/pipelines/x", runs)[0] == 404 and answer("/x", runs)[0] == 404
    totals = answer("/metrics", runs)[1]
    assert totals == {"total_runs": 2, "successful_runs": 1, "failed_runs": 1, "success_rate": 0.5, "failure_rate": 0.5, "avg_duration": 1.5, "total_records": 20}
    server = serve(port=0, collector=runs)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    with urllib.request.urlopen(f"http://127.0.0.1:{server.server_address[1]}/metrics") as a:
        assert json.loads(a.read()) == totals
    server.shutdown()
    assert MetricsCollector.shared() is MetricsCollector.shared()
    runs.reset()
    assert runs.runs() == []


def test_command_line(spark, files, capsys):
    db = ["--db", str(files / "runs.db")]
    assert cli.main([*db, "validate", "--config", str(files / "p.yaml")]) == 0
    assert "2 sources" in capsys.readouterr().out
    assert cli.main([*db, "validate", "--config", str(files / "none.yaml")]) == 1
    assert cli.main([*db, "run", "--config", str(files / "p.yaml")]) == 0
    out = capsys.readouterr().out
    run_id = out.strip().split()[-1]
    assert cli.main([*db, "status", run_id]) == 0 and cli.main([*db, "status", "x"]) == 1
    assert cli.main([*db, "list"]) == 0 and run_id in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["--version"])
