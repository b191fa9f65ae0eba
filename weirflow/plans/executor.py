"""Runs a graph: frames are built at once, lazily; only action steps start jobs."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from concurrent.futures import TimeoutError as Late
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .graph import Context, Graph
from .state import RunState, Status, StepState

#: Seconds before the second attempt, doubled for each one after, and the most of it.
BACKOFF, BACKOFF_MOST = 1.0, 60.0


class Executor:
    """A graph's run: max_parallel action steps side by side, each with its retries and timeout.

    A step whose frame several steps use is kept in memory and on disk while the run lasts. Rows are counted as they pass,
    by observations, without jobs of their own. After a failure no step starts; those that run go on to their end. A step
    that takes too long has its Spark jobs cancelled.
    """

    def __init__(self, graph: Graph, spark: SparkSession | None = None, max_parallel: int = 4, on_step: Callable[[str, RunState], object] | None = None, sleep: Callable[[float], object] = time.sleep):
        if max_parallel < 1:
            raise ValueError("max_parallel is at least 1")
        self.graph, self.spark, self.max_parallel, self.on_step, self.sleep = graph, spark, max_parallel, on_step, sleep
        self.state = RunState(graph.name, {s: StepState(s) for s in graph.nodes})
        self.results: dict[str, Any] = {}
        self._seen: dict[str, Observation] = {}
        self._kept: list[DataFrame] = []
        self._lock = threading.Lock()

    def cancel(self) -> None:
        self.state.cancel()
        if self.spark:
            self.spark.interruptTag(self._tag())

    def _tag(self, step: str = "") -> str:
        return f"weirflow-{self.state.run_id}" + (f"-{step}" if step else "")

    def execute(self) -> RunState:
        self.graph.validate()
        state, needs = self.state, {s: self.graph.dependencies(s) for s in self.graph.nodes}
        state.start()
        running: dict[Future, str] = {}
        try:
            with ThreadPoolExecutor(self.max_parallel) as pool:
                while True:
                    if not state.failed():
                        for s in state.ready(needs):
                            if len(running) == self.max_parallel:
                                break
                            state.step_started(s)
                            run = inheritable_thread_target(self.spark)(self._run) if self.spark else self._run
                            running[pool.submit(run, s)] = s
                    if not running:
                        break
                    done, _ = wait(running, return_when=FIRST_COMPLETED)
                    for f in done:
                        f.result()
                        s = running.pop(f)
                        if self.on_step:
                            self.on_step(s, state)
        finally:
            for df in self._kept:
                df.unpersist()
        self._count()
        failed = [s for s in state.steps.values() if s.status is Status.FAILED]
        state.finish(Status.FAILED if failed else Status.COMPLETED, "; ".join(f"{s.id}: {s.error}" for s in failed) or None)
        return state

    def _run(self, name: str) -> None:
        step, state = self.graph.nodes[name], self.state
        pause = BACKOFF
        for attempt in range(step.retries + 1):
            if attempt:
                self.sleep(pause)
                pause = min(2 * pause, BACKOFF_MOST)
                if state.status.over:
                    return
            state.step_tried(name)
            try:
                out = self._call(name)
                break
            except Exception as e:
                if attempt == step.retries:
                    state.step_failed(name, f"{type(e).__name__}: {e}")
                    return
        if isinstance(out, DataFrame):
            out = self._watched(name, out)
        with self._lock:
            self.results[name] = out
        state.step_done(name, out if isinstance(out, int) and not isinstance(out, bool) else None)

    def _call(self, name: str) -> Any:
        step = self.graph.nodes[name]
        needs = self.graph.dependencies(name)
        with self._lock:
            context = Context(name, step.config, {d: self.results[d] for d in needs}, needs)
        if step.timeout is None:
            return self._tagged(name, step.operation, context)
        # A thread of its own, as a step can't be stopped otherwise; its Spark jobs are.
        with_tags = inheritable_thread_target(self.spark)(self._tagged) if self.spark else self._tagged
        pool = ThreadPoolExecutor(1)
        try:
            return pool.submit(with_tags, name, step.operation, context).result(step.timeout)
        except Late as e:
            if self.spark:
                self.spark.interruptTag(self._tag(name))
            raise TimeoutError(f"took more than {step.timeout} s") from e
        finally:
            pool.shutdown(wait=False, cancel_futures=True)

    def _tagged(self, name: str, operation: Callable, context: Context) -> Any:
        if not self.spark:
            return operation(context)
        tags = (self._tag(), self._tag(name))
        for t in tags:
            self.spark.addTag(t)
        try:
            return operation(context)
        finally:
            for t in tags:
                self.spark.removeTag(t)

    def _watched(self, name: str, df: DataFrame) -> DataFrame:
        if df.isStreaming:
            return df
        seen = Observation(f"{self._tag()}-{name}")
        df = df.observe(seen, F.count(F.lit(1)).alias("rows"))
        if len(self.graph.dependents(name)) > 1:
            df = df.persist()
            self._kept.append(df)
        with self._lock:
            self._seen[name] = seen
        return df

    def _count(self) -> None:
        """Rows that passed, where a job ran over all of a frame."""
        for name, seen in self._seen.items():
            rows = _value(seen)
            if rows is not None:
                self.state.steps[name].output_records = rows
        for name, s in self.state.steps.items():
            counts = [self.state.steps[d].output_records for d in self.graph.dependencies(name)]
            if counts and None not in counts:
                s.input_records = sum(counts)


def _value(seen: Observation) -> int | None:
    """What was observed, or None: get() would wait for a job that may never come."""
    jo = getattr(seen, "_jo", None)
    if jo is None:
        return None
    try:
        future = jo.future()
        return int(seen.get["rows"]) if future.isCompleted() else None
    except Exception:
        return None
