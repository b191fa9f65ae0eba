"""Consumers and producers of Kafka topics, as streaming queries and batch writes."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession

from weirflow.sources.kafka import BROKEN, META, KafkaOptions, KafkaSink, decode, encode, split_broken


@dataclass
class ConsumerMetrics:
    consumed: int = 0
    failed: int = 0
    dead_letter: int = 0
    last_offset: int = -1
    started: float = field(default_factory=time.time)

    def to_dict(self) -> dict[str, float]:
        return {"messages_consumed": self.consumed, "messages_failed": self.failed, "dead_letter_count": self.dead_letter, "last_offset": self.last_offset, "uptime_seconds": round(time.time() - self.started, 3)}


@dataclass
class KafkaConsumer:
    """Gives decoded batches to on_message, broken messages to on_error and, in an envelope, to dead_letter.

    Offsets are kept in the query's checkpoint and move on once on_message has returned. messages: a streaming frame with
    value, in place of the topic's.
    """

    options: KafkaOptions
    on_message: Callable[[DataFrame], object]
    on_error: Callable[[DataFrame], object] | None = None
    dead_letter: Callable[[DataFrame], object] | None = None
    metrics: ConsumerMetrics = field(default_factory=ConsumerMetrics)

    def handle(self, messages: DataFrame) -> None:
        """One batch of messages."""
        o = self.options
        decoded = decode(messages, o.format, o.schema).persist()
        try:
            good, bad = split_broken(decoded, o.consumer_group)
            from pyspark.sql import functions as F

            has_offset = f"{META}.offset" if "offset" in messages.columns else None
            counts = decoded.agg(F.count_if(F.col(BROKEN).isNull()).alias("good"), F.count_if(F.col(BROKEN).isNotNull()).alias("bad"), (F.max(has_offset) if has_offset else F.lit(None)).alias("offset")).first()
            if counts["good"]:
                self.on_message(good)
            if counts["bad"]:
                if self.on_error:
                    self.on_error(bad)
                if self.dead_letter:
                    self.dead_letter(bad)
                    self.metrics.dead_letter += counts["bad"]
            self.metrics.consumed += counts["good"]
            self.metrics.failed += counts["bad"]
            self.metrics.last_offset = max(self.metrics.last_offset, counts["offset"] if counts["offset"] is not None else -1)
        finally:
            decoded.unpersist()

    def start(self, spark: SparkSession, checkpoint: str, messages: DataFrame | None = None, **trigger):
        if messages is None:
            messages = spark.readStream.format("kafka").options(**self.options.read_options(True)).load()
        writer = messages.writeStream.foreachBatch(lambda df, _: self.handle(df)).option("checkpointLocation", checkpoint)
        self.query = (writer.trigger(**trigger) if trigger else writer).start()
        return self.query

    def stop(self) -> None:
        self.query.stop()


@dataclass
class ProducerMetrics:
    sent: int = 0
    failed: int = 0
    last_error: str = ""


@dataclass
class KafkaProducer:
    """Sends frames. deliver: what to do with a frame of key and value, in place of writing to the brokers."""

    options: KafkaSink
    on_delivery: Callable[[int], object] | None = None
    deliver: Callable[[DataFrame], int] | None = None
    metrics: ProducerMetrics = field(default_factory=ProducerMetrics)

    def send(self, df: DataFrame, topic: str | None = None, key: Column | None = None) -> int:
        """The rows sent; key: a column in place of the key field."""
        from dataclasses import replace

        sink = replace(self.options, topic=topic or self.options.topic)
        if not sink.topic:
            raise ValueError("a topic is needed")
        try:
            messages = encode(df, sink.format, sink.key_field, sink.avro_schema, key) if key is not None else sink.messages(df)
            n = self.deliver(messages) if self.deliver else _write(messages, sink)
        except Exception as e:
            self.metrics.failed += 1
            self.metrics.last_error = str(e)
            raise
        self.metrics.sent += n
        if self.on_delivery:
            self.on_delivery(n)
        return n


def _write(messages: DataFrame, sink: KafkaSink) -> int:
    from weirflow.sources.base import Counted

    counted = Counted(messages)
    counted.df.write.format("kafka").options(**sink.write_options()).save()
    return counted.rows
