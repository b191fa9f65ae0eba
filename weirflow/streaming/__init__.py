"""Event time, stream joins, batches and running streams."""

from .batches import BatchWindow, in_batches
from .dedup import first_by_id, first_by_id_within
from .joins import interval_join
from .kafka import KafkaConsumer, KafkaProducer
from .registry import CompatibilityLevel, SchemaRegistry, compatible
from .runner import StreamMetrics, StreamRunner
from .watermark import drop_late, late_rows
from .windows import TimeWindow, windowed_aggregate

__all__ = [
    "BatchWindow",
    "CompatibilityLevel",
    "KafkaConsumer",
    "KafkaProducer",
    "SchemaRegistry",
    "StreamMetrics",
    "StreamRunner",
    "TimeWindow",
    "compatible",
    "drop_late",
    "first_by_id",
    "first_by_id_within",
    "in_batches",
    "interval_join",
    "late_rows",
    "windowed_aggregate",
]
