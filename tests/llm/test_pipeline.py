"""The corpus pipeline against each stage's brute force, on its own input."""

from __future__ import annotations

import corpus_pipeline
from test_documents import check_packing
from test_lines_and_pii import slow_dedup
from test_neardup import agree
from pyspark.sql import functions as F

from weirflow.llm import decontaminate, linededup


def test_every_stage_works_on_what_the_one_before_kept(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id < 110")
    extra = spark.createDataFrame([(9001, None, None, "s", 0), (9002, "123 456", None, "s", 7), (9003, "", None, "s", 0)], docs.schema)
    docs = docs.union(extra)
    docs.write.parquet(str(tmp_path / "in"))
    docs = spark.read.parquet(str(tmp_path / "in"))
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, tables[-1], sf_dir).write.parquet(str(tmp_path / name))
        tables.append(spark.read.parquet(str(tmp_path / name)))
    for t in tables[:-1]:
        assert t.columns == docs.columns
    before, known, lined, single, clean, packed = [t.collect() for t in tables]
    assert {r.doc_id for r in before} - {r.doc_id for r in known} == {9001, 9002, 9003}

    keys = {r.text: r.k for r in tables[1].select("text", F.xxhash64("text").alias("k")).collect()}
    rows = [(r.doc_id, r.text) for r in known]
    gone = slow_dedup(rows, linededup.MIN_WORDS, keys)
    assert {(r.doc_id, r.text) for r in lined} == {(i, "\n".join(x for j, x in enumerate(t.split("\n")) if j not in gone[(i, t)])) for i, t in rows}

    agree([(r.doc_id, r.text) for r in lined], [r.doc_id for r in single])

    bench = decontaminate.Benchmark([tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()])
    assert {r.doc_id for r in clean} == {r.doc_id for r in single if not bench.hits(r.text)}

    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    check_packing(packed, {r.doc_id: [*t.encode(r.text or "", add_special_tokens=False).ids, 1] for r in clean})


def test_the_query_is_the_pipeline(spark, sf_dir):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
