"""weirflow run | validate | status | list | monitor."""

from __future__ import annotations

import argparse
import json
import sys

from weirflow import __version__


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="weirflow", description=__doc__)
    parser.add_argument("--version", action="version", version=f"%(prog)s {__version__}")
    parser.add_argument("--db", default="weirflow_runs.db", help="file that runs are recorded in")
    sub = parser.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run", help="run a pipeline")
    run.add_argument("--config", required=True)
    run.add_argument("--max-parallel", type=int, default=4)
    run.add_argument("--master")
    run.add_argument("--checkpoint", default="checkpoints", help="folder for a streaming pipeline's checkpoints")
    run.add_argument("--once", action="store_true", help="a streaming pipeline ends when it has read what is there")
    sub.add_parser("validate", help="check a pipeline's file").add_argument("--config", required=True)
    sub.add_parser("status", help="show a run").add_argument("run_id")
    listing = sub.add_parser("list", help="show recent runs")
    listing.add_argument("--limit", type=int, default=10)
    listing.add_argument("--pipeline")
    monitor = sub.add_parser("monitor", help="serve runs over HTTP")
    monitor.add_argument("--host", default="127.0.0.1")
    monitor.add_argument("--port", type=int, default=8000)
    given = parser.parse_args(args)
    return globals()[f"_{given.command}"](given)


def _load(path: str):
    from weirflow.plans.spec import load

    try:
        return load(path)
    except (OSError, ValueError) as e:
        print(f"{path}: {e}", file=sys.stderr)
        return None


def _run(given: argparse.Namespace) -> int:
    from weirflow.monitoring import MetricsCollector
    from weirflow.plans.build import build_graph, streaming_runners
    from weirflow.plans.executor import Executor
    from weirflow.plans.runs import RunStore
    from weirflow.plans.spec import check
    from weirflow.session import session

    spec = _load(given.config)
    if spec is None:
        return 1
    for w in check(spec):
        print(f"warning: {w}", file=sys.stderr)
    spark = session(spec.name, given.master)
    if spec.mode == "streaming":
        trigger = {"availableNow": True} if given.once else {}
        queries = [r.start(f"{given.checkpoint}/{n.replace(':', '-')}", **trigger) for n, r in streaming_runners(spec, spark).items()]
        for q in queries:
            q.awaitTermination()
        return 0
    state = Executor(build_graph(spec, spark), spark, given.max_parallel, on_step=lambda s, st: print(f"{s}: {st.steps[s].status.value}")).execute()
    MetricsCollector.shared().record(state.to_dict())
    RunStore(given.db).save(state.to_dict())
    print(f"{state.status.value} in {state.duration:.2f} s: {state.run_id}" + (f"\n{state.error}" if state.error else ""))
    return 0 if state.status.value == "completed" else 1


def _validate(given: argparse.Namespace) -> int:
    from weirflow.plans.spec import check

    spec = _load(given.config)
    if spec is None:
        return 1
    warnings = check(spec)
    for w in warnings:
        print(f"warning: {w}")
    print(f"{spec.name} {spec.version}: {len(spec.sources)} sources, {len(spec.transforms)} transforms, {len(spec.sinks)} sinks")
    return 0


def _status(given: argparse.Namespace) -> int:
    from weirflow.plans.runs import RunStore

    run = RunStore(given.db).get(given.run_id)
    print(json.dumps(run, indent=2) if run else f"no run {given.run_id}")
    return 0 if run else 1


def _list(given: argparse.Namespace) -> int:
    from weirflow.plans.runs import RunStore

    for r in RunStore(given.db).recent(given.limit, given.pipeline):
        print(f"{r['run_id']}  {r['pipeline']}  {r['status']}  {r['created_at']}")
    return 0


def _monitor(given: argparse.Namespace) -> int:
    from weirflow.monitoring import serve
    from weirflow.plans.runs import RunStore

    server = serve(given.host, given.port, store=RunStore(given.db))
    print(f"http://{given.host}:{server.server_address[1]}/health")
    try:
        server.serve_forever()
    except KeyboardInterrupt:
        pass
    return 0


if __name__ == "__main__":
    sys.exit(main())
