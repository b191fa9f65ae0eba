from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

import pytest
from pyspark.sql import functions as F

from weirflow import sources as io
from weirflow.sources.jdbc import bind
from weirflow.sources.json import extract
from weirflow.sources.kafka import decode, encode, split_broken
from weirflow.sources.rest import auth_header, results_of


def test_csv_cells_are_text(spark, tmp_path):
    path = tmp_path / "parts.csv"
    path.write_text('part,weight,note\nbolt,0.5,steel\nnut,,"a, ""b""\nc"\n')
    df = io.CSVFile(str(path), multi_line=True).read(spark)
    assert [tuple(r) for r in df.collect()] == [("bolt", "0.5", "steel"), ("nut", "", 'a, "b"\nc')]
    assert io.CSVFile(str(path), multi_line=True, empty_as_null=True).read(spark).filter("weight is null").count() == 1
    (tmp_path / "plain.csv").write_text("part,note\nbolt,steel\n" * 2)
    assert io.CSVFile(str(tmp_path / "plain.csv")).read(spark).count() == 3


def test_csv_without_header(spark, tmp_path):
    (tmp_path / "x.csv").write_text("1;a\n2;b\n")
    assert io.CSVFile(str(tmp_path / "x.csv"), ";", has_header=False).read(spark).columns == ["0", "1"]


def test_csv_writes_and_appends(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, 'q"x')], "a int, b string")
    file = io.CSVFile(str(tmp_path / "out"))
    assert file.write(df) == 2 and file.write(df, "a") == 2
    assert sorted(tuple(r) for r in file.read(spark).collect()) == sorted([("1", ""), ("2", 'q"x')] * 2)
    assert file.write(df.filter("a > 9")) == 0
    with pytest.raises(ValueError):
        file.write(df, "z")


def test_missing_files_are_errors(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        io.CSVFile(str(tmp_path / "none.csv")).read(spark)


def test_json_forms(spark, tmp_path):
    def read(text, **options):
        path = tmp_path / "x.json"
        path.write_text(text)
        return [r.asDict(recursive=True) for r in io.JSONFile(str(path), **options).read(spark).collect()]

    assert read('[{"id": 1}, {"id": 2}]') == [{"id": 1}, {"id": 2}]
    assert read('{"id": 1}') == [{"id": 1}]
    assert read("") == []
    assert read('{"id": 1}\n\n{"id": 2}\n', lines=True) == [{"id": 1}, {"id": 2}]
    nested = '{"meta": {"page": 1}, "data": {"results": [{"id": 1, "name": "a"}, {"id": 2, "name": "b"}]}}'
    assert read(nested, record_path="data.results") == [{"id": 1, "name": "a"}, {"id": 2, "name": "b"}]
    assert read(nested, record_path="data.results.1") == [{"id": 2, "name": "b"}]
    with pytest.raises(KeyError):
        read(nested, record_path="data.nothing")


def test_json_extract_of_plain_values(spark):
    df = spark.createDataFrame([([1, 2],)], "xs array<int>")
    assert [r.value for r in extract(df, "xs").collect()] == [1, 2]


@pytest.mark.parametrize("lines", [True, False])
def test_json_round_trip(spark, tmp_path, lines):
    df = spark.createDataFrame([(i, None if i % 2 else "x") for i in range(50)], "a int, b string").repartition(3)
    file = io.JSONFile(str(tmp_path / "out"), lines=lines)
    assert file.write(df) == 50
    assert {tuple(r) for r in file.read(spark).select("a", "b").collect()} == {tuple(r) for r in df.collect()}
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert '"b":null' in text
    if not lines:
        assert all(isinstance(json.loads(p.read_text()), list) for p in (tmp_path / "out").glob("part-*") if p.stat().st_size)


def test_parquet_partitions(spark, tmp_path):
    file = io.ParquetFile(str(tmp_path / "p"), ["k"])
    assert file.write(spark.range(10).withColumn("k", F.col("id") % 2)) == 10
    assert file.read(spark).filter("k = 1").count() == 5


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "x.db")
    df = spark.createDataFrame([(1, "a", 1.5, True, None), (2, None, 2.5, False, "z"), (3, "c", None, True, "y")], "id bigint, name string, score double, ok boolean, note string")
    db = io.SQLiteDatabase(path, "users", batch_size=2)
    assert db.write(df) == 3
    assert sorted(tuple(r) for r in db.read(spark).select("id", "name", "score").collect()) == [(1, "a", 1.5), (2, None, 2.5), (3, "c", None)]
    assert io.SQLiteDatabase(path, "users", partitions=3).read(spark).count() == 3
    assert io.SQLiteDatabase(path, query="SELECT id FROM users WHERE id > ?", params=(1,)).read(spark).count() == 2
    assert db.write(df, "replace") == 3 and db.write(df) == 3 and db.read(spark).count() == 6
    with pytest.raises(ValueError):
        db.write(df, "fail")
    with pytest.raises(ValueError):
        io.SQLiteDatabase(path).read(spark)


def test_a_failed_sqlite_write_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "x.db")
    db = io.SQLiteDatabase(path, "t")
    db.write(spark.range(3))
    with pytest.raises(Exception, match="boom"):
        db.write(spark.range(10).select(F.when(F.col("id") > 8, F.raise_error(F.lit("boom"))).otherwise(F.col("id")).alias("id")), "replace")
    assert db.read(spark).count() == 3


def test_jdbc_options():
    source = io.postgres("postgresql://me:p%40ss@db:5433/shop", query="SELECT * FROM t WHERE a = $1 AND b = '$2'", params=("it's",))
    assert source.options()["url"] == "jdbc:postgresql://db:5433/shop"
    assert source.options()["query"] == "SELECT * FROM t WHERE a = 'it''s' AND b = '$2'"
    assert source.options()["password"] == "p@ss"
    assert bind("$1 $2", [None, True]) == "NULL TRUE"
    with pytest.raises(ValueError):
        bind("$3", [1])
    parts = io.JDBCTable("jdbc:x", "t", partition_column="id", lower=0, upper=9, partitions=3).options()
    assert parts["numPartitions"] == "3" and parts["dbtable"] == "t"
    with pytest.raises(ValueError):
        io.JDBCTable("jdbc:x").options()


class Service(BaseHTTPRequestHandler):
    got: list = []

    def do_GET(self):
        url = urlsplit(self.path)
        page = int(parse_qs(url.query).get("page", ["1"])[0])
        if url.path == "/broken":
            self.send_error(500)
            return
        pages = {1: [{"id": 1, "name": "a"}, {"id": 2, "name": None}], 2: [{"id": 3, "name": "c"}]}
        body = json.dumps({"data": {"results": pages.get(page, [])}, "auth": self.headers.get("Authorization")}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def do_POST(self):
        Service.got.append((self.command, json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
        self.send_response(201)
        self.end_headers()

    do_PUT = do_POST

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def service():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_address[1]}"
    server.shutdown()


def test_rest_reads_pages(spark, service):
    source = io.RESTEndpoint(service, "items", paginate=True, results_key="data.results", max_pages=6)
    assert sorted(tuple(r) for r in source.read(spark, "id int, name string").collect()) == [(1, "a"), (2, None), (3, "c")]
    assert source.read(spark).columns == ["id", "name"]
    source.partitions = 2
    assert source.read(spark, "id int").count() == 3
    with pytest.raises(Exception, match="500"):
        io.RESTEndpoint(service, "broken").read(spark, "id int").collect()


def test_rest_writes_batches(spark, service):
    Service.got.clear()
    assert io.RESTEndpoint(service, "items", batch_size=2).write(spark.range(5).coalesce(1), "PUT") == 5
    assert sorted(len(b) for _, b in Service.got) == [1, 2, 2] and {m for m, _ in Service.got} == {"PUT"}
    with pytest.raises(ValueError):
        io.RESTEndpoint(service).write(spark.range(1), "DELETE")


def test_rest_answers():
    assert results_of([1], None) == [1]
    assert results_of({"a": {"b": [1]}}, "a.b") == [1]
    assert results_of({"a": {"b": 1}}, "a") == [{"b": 1}]
    assert results_of({"a": 1}, "x") == []
    assert results_of({"a": 1}, None) == [{"a": 1}]
    assert auth_header("bearer", "t") == {"Authorization": "Bearer t"}
    assert auth_header("custom", "t") == {"Authorization": "t"} and auth_header("basic", "") == {}


def test_kafka_messages_are_decoded(spark):
    data = [(b'{"id": 1, "x": "a"}', 0), (b"not-json", 1), (b'{"id": 2}', 2), (None, 3), (b'{"id": "no"}', 4)]
    messages = spark.createDataFrame(data, "value binary, offset bigint").withColumns({"topic": F.lit("t"), "partition": F.lit(0)})
    good, bad = split_broken(decode(messages, "json", "id int, x string"), "g")
    assert sorted((r.id, r.x, r._kafka_meta.offset) for r in good.collect()) == [(1, "a", 0), (2, None, 2)]
    assert sorted((r.original_message, r.consumer_group) for r in bad.collect()) == [("", "g"), ("not-json", "g"), ('{"id": "no"}', "g")]
    raw = decode(messages.limit(1), "raw").first()
    assert raw.raw == '{"id": 1, "x": "a"}'
    with pytest.raises(ValueError):
        decode(messages, "xml")


def test_kafka_messages_are_encoded(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "b", 150), (3, "c", 200)], "id int, x string, amount int").withColumn("_meta", F.lit(0))
    sink = io.KafkaSink(topic="t", key_field="id", condition="amount > 100")
    assert [(r.key, json.loads(r.value)) for r in sink.messages(df).collect()] == [("2", {"id": 2, "x": "b", "amount": 150}), ("3", {"id": 3, "x": "c", "amount": 200})]
    assert '"x":null' in encode(df).first().value
    assert sink.write_options()["kafka.enable.idempotence"] == "true"
    assert io.KafkaSource(topic="t").read_options(True)["maxOffsetsPerTrigger"] == "500"
    with pytest.raises(NotImplementedError):
        sink.read(spark)
    with pytest.raises(NotImplementedError):
        io.KafkaSource(topic="t").write(df)
