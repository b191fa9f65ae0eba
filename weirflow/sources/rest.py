"""Web services that give and take JSON."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any
from urllib.parse import urlencode

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

TIMEOUT = 30


def results_of(body: Any, key: str | None) -> list:
    """The records of an answer: a list itself; what a dotted key holds, a lone record as a list of one; else the answer."""
    if isinstance(body, list):
        return body
    if not key:
        return [body] if isinstance(body, dict) else []
    for part in key.split("."):
        if not isinstance(body, dict) or part not in body:
            return []
        body = body[part]
    return body if isinstance(body, list) else [body] if isinstance(body, dict) else []


def auth_header(kind: str, token: str) -> dict[str, str]:
    """bearer, basic (the token is encoded already) and token put their name before the token; another kind sends it as it is."""
    if not token:
        return {}
    names = {"bearer": "Bearer ", "basic": "Basic ", "token": "Token "}
    return {"Authorization": names.get(kind, "") + token}


def _call(url: str, headers: dict, wait: float, method: str = "GET", body: bytes | None = None) -> Any:
    if wait:
        time.sleep(wait)
    request = urllib.request.Request(url, data=body, method=method, headers={"Accept": "application/json", **({"Content-Type": "application/json"} if body else {}), **headers})
    with urllib.request.urlopen(request, timeout=TIMEOUT) as answer:
        text = answer.read()
    return json.loads(text) if text.strip() else None


class _Pages(InputPartition):
    def __init__(self, first: int, count: int):
        self.first, self.count = first, count


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.o = json.loads(options["spec"])

    def partitions(self) -> list[InputPartition]:
        o = self.o
        if not o["paginate"]:
            return [_Pages(0, 1)]
        n = max(1, min(o["partitions"], o["max_pages"]))
        cuts = [o["max_pages"] * k // n for k in range(n + 1)]
        return [_Pages(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]

    def read(self, part: _Pages) -> Iterator[tuple[str]]:
        o = self.o
        for k in range(part.first, part.first + part.count):
            params = dict(o["params"])
            if o["paginate"]:
                params[o["page_key"]] = int(params.get(o["page_key"], 1)) + k
            body = _call(o["url"] + ("?" + urlencode(params) if params else ""), o["headers"], o["rate_limit"])
            records = results_of(body, o["results_key"])
            if not records:
                return
            for r in records:
                yield (json.dumps(r),)


class RESTSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "weirflow_rest"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))


@dataclass
class RESTEndpoint:
    """An endpoint. rate_limit: seconds that each task waits before a request. A status of failure is an error.

    paginate: pages are asked for one after the other until one is empty; with partitions, ranges of the max_pages
    pages are asked for side by side, each until its first empty page.
    """

    base_url: str
    endpoint: str = ""
    headers: dict[str, str] = field(default_factory=dict)
    auth_type: str = "bearer"
    auth_token: str = ""
    rate_limit: float = 0.0
    params: dict[str, Any] = field(default_factory=dict)
    paginate: bool = False
    page_key: str = "page"
    results_key: str | None = "results"
    max_pages: int = 100
    partitions: int = 1
    batch_size: int = 1000

    def _url(self) -> str:
        return self.base_url.rstrip("/") + ("/" + self.endpoint.lstrip("/") if self.endpoint else "")

    def _headers(self) -> dict[str, str]:
        return auth_header(self.auth_type, self.auth_token) | self.headers

    def read_text(self, spark: SparkSession) -> DataFrame:
        """Records as JSON text in a column value."""
        spark.dataSource.register(RESTSource)
        spec = {k: getattr(self, k) for k in ("params", "paginate", "page_key", "results_key", "max_pages", "partitions", "rate_limit")} | {"url": self._url(), "headers": self._headers()}
        return spark.read.format("weirflow_rest").option("spec", json.dumps(spec)).load()

    def read(self, spark: SparkSession, schema: StructType | str | None = None) -> DataFrame:
        """Records by a schema. Without one, the answers are fetched once more to infer it."""
        text = self.read_text(spark)
        if schema is None:
            schema = spark.read.json(text.rdd.map(lambda r: r[0])).schema
        return text.select(F.from_json("value", schema).alias("record")).select("record.*")

    def write(self, df: DataFrame, method: str = "POST") -> int:
        """Arrays of batch_size records as request bodies, each task its own; the number of rows."""
        if method not in ("POST", "PUT"):
            raise ValueError(f"method is POST or PUT, not {method!r}")
        url, headers, wait, size = self._url(), self._headers(), self.rate_limit, self.batch_size
        records = df.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)), {"ignoreNullFields": "false"}).alias("record"))

        def send(batches):
            import pyarrow as pa

            held: list[str] = []

            def post() -> None:
                if held:
                    _call(url, headers, wait, method, ("[" + ",".join(held) + "]").encode())
                    held.clear()

            for batch in batches:
                for r in batch.column(0).to_pylist():
                    held.append(r)
                    if len(held) == size:
                        post()
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])
            post()

        return int(records.mapInArrow(send, "n long").agg(F.sum("n")).first()[0] or 0)
