"""Runs in memory, and over HTTP."""

from .metrics import MetricsCollector
from .server import serve

__all__ = ["MetricsCollector", "serve"]
