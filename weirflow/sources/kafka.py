"""Kafka topics: batch and streaming reads, decoding, encoding and writes.

Spark's own Kafka connector does the work, and has to be on the class path; what is decoded and encoded here are columns, which
any frame with a column value has use for.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weirflow.functions import sink_column

FORMATS = ("json", "avro", "raw")
#: The column that decoding adds, and that of messages that can't be decoded.
META, BROKEN = "_kafka_meta", "_corrupt_value"


def decode(messages: DataFrame, format: str = "json", schema: StructType | str | None = None) -> DataFrame:
    """Records of messages (value, and topic, partition, offset, timestamp where there), with META.

    BROKEN holds the text of a message that isn't a record of the format, NULL for others. raw gives the text in a column raw;
    bytes that aren't UTF-8 become replacement characters.
    """
    if format not in FORMATS:
        raise ValueError(f"no format {format!r}; there are {', '.join(FORMATS)}")
    parts = [c for c in ("topic", "partition", "offset", "timestamp") if c in messages.columns]
    meta = F.struct(*parts).alias(META) if parts else F.lit(None).alias(META)
    text = F.make_valid_utf8(F.col("value").cast("binary").cast("string"))
    if format == "raw":
        return messages.select(text.alias("raw"), F.lit(None).cast("string").alias(BROKEN), meta)
    if schema is None:
        raise ValueError(f"{format} needs a schema")
    if format == "avro":
        from pyspark.sql.avro.functions import from_avro

        record = from_avro("value", schema, {"mode": "PERMISSIVE"})
        return messages.select(record.alias("r"), meta, "value").select("r.*", F.when(F.col("r").isNull(), F.base64("value")).alias(BROKEN), META)
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    wide = StructType([*kind.fields]).add(BROKEN, "string")
    record = F.from_json(text, wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN})
    broken = F.when(F.col("t").isNull() | F.col("r").isNull() | (F.get_json_object("t", "$").isNull()), F.coalesce("t", F.lit(""))).otherwise(F.col(f"r.{BROKEN}"))
    return messages.select(record.alias("r"), text.alias("t"), meta).select(*(F.col("r").getField(f.name).alias(f.name) for f in kind), broken.alias(BROKEN), META)


def split_broken(decoded: DataFrame, group: str = "weirflow") -> tuple[DataFrame, DataFrame]:
    """The records, and an envelope (original_message, error, timestamp, consumer_group) for each broken message."""
    good = decoded.filter(F.col(BROKEN).isNull()).drop(BROKEN)
    bad = decoded.filter(F.col(BROKEN).isNotNull())
    return good, bad.select(F.col(BROKEN).alias("original_message"), F.lit("message can't be decoded").alias("error"), F.current_timestamp().alias("timestamp"), F.lit(group).alias("consumer_group"))


def encode(df: DataFrame, format: str = "json", key_field: str | None = None, avro_schema: str | None = None, key: Column | None = None) -> DataFrame:
    """key and value of the messages of df. Columns that begin with _ are left out; a NULL field is written out."""
    if format not in FORMATS:
        raise ValueError(f"no format {format!r}; there are {', '.join(FORMATS)}")
    sent = [c for c in df.columns if not c.startswith("_")]
    record = F.struct(*(F.col(f"`{c}`") for c in sent))
    if format == "avro":
        from pyspark.sql.avro.functions import to_avro

        value = to_avro(record, avro_schema) if avro_schema else to_avro(record)
    elif format == "raw" and sent == ["raw"]:
        value = F.col("raw").cast("string")
    else:
        value = F.to_json(record, {"ignoreNullFields": "false"})
    if key is None and key_field and key_field in df.columns:
        key = F.col(f"`{key_field}`").cast("string")
    extra = [c for c in ("topic", "headers") if c in df.columns and c not in sent]
    return df.select((key if key is not None else F.lit(None)).cast("string").alias("key"), value.alias("value"), *extra)


@dataclass
class KafkaOptions:
    """What producers and consumers tell the brokers. extra: other options, by their Kafka name."""

    brokers: list[str] = field(default_factory=lambda: ["localhost:9092"])
    topic: str = ""
    consumer_group: str = "weirflow"
    format: str = "json"
    schema: StructType | str | None = None
    offset_reset: str = "earliest"
    max_messages: int | None = None
    max_poll_records: int = 500
    acks: str = "all"
    retries: int = 3
    linger_ms: int = 5
    idempotent: bool = True
    extra: dict[str, str] = field(default_factory=dict)

    def _common(self) -> dict[str, str]:
        return {"kafka.bootstrap.servers": ",".join(self.brokers)} | {f"kafka.{k}": str(v) for k, v in self.extra.items()}

    def read_options(self, streaming: bool = False) -> dict[str, str]:
        out = self._common() | {"subscribe": self.topic, "kafka.group.id": self.consumer_group, "failOnDataLoss": "false"}
        out["startingOffsets"] = self.offset_reset if streaming or self.offset_reset == "earliest" else "earliest"
        if streaming:
            out["maxOffsetsPerTrigger"] = str(self.max_messages or self.max_poll_records)
        else:
            out["endingOffsets"] = "latest"
        return out

    def write_options(self) -> dict[str, str]:
        out = self._common() | {"kafka.acks": self.acks, "kafka.retries": str(self.retries), "kafka.linger.ms": str(self.linger_ms), "kafka.enable.idempotence": str(self.idempotent).lower()}
        return out | ({"topic": self.topic} if self.topic else {})


@dataclass
class KafkaSource(KafkaOptions):
    def read(self, spark: SparkSession) -> DataFrame:
        """The topic's records so far, max_messages at most; broken messages are left out."""
        messages = spark.read.format("kafka").options(**self.read_options()).load()
        good, _ = split_broken(decode(messages, self.format, self.schema), self.consumer_group)
        return good.limit(self.max_messages) if self.max_messages else good

    def read_stream(self, spark: SparkSession) -> DataFrame:
        """Records as they come, with BROKEN; split_broken() parts them in a batch."""
        return decode(spark.readStream.format("kafka").options(**self.read_options(True)).load(), self.format, self.schema)

    def write(self, df: DataFrame) -> int:
        raise NotImplementedError("a source doesn't write; KafkaSink does")


@dataclass
class KafkaSink(KafkaOptions):
    key_field: str | None = None
    avro_schema: str | None = None
    condition: str | None = None

    def messages(self, df: DataFrame) -> DataFrame:
        """key and value of the rows that pass the condition."""
        if self.condition:
            df = df.filter(sink_column(self.condition, df))
        return encode(df, self.format, self.key_field, self.avro_schema)

    def write(self, df: DataFrame) -> int:
        from .base import Counted

        if not self.topic and "topic" not in df.columns:
            raise ValueError("a topic is needed")
        counted = Counted(self.messages(df))
        counted.df.write.format("kafka").options(**self.write_options()).save()
        return counted.rows

    def write_stream(self, df: DataFrame, checkpoint: str):
        return self.messages(df).writeStream.format("kafka").options(**self.write_options()).option("checkpointLocation", checkpoint).start()

    def read(self, spark: SparkSession) -> DataFrame:
        raise NotImplementedError("a sink doesn't read; KafkaSource does")
