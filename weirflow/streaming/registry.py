"""Schemas by subject and version: a registry's client, and a check of compatibility of one's own."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable
from enum import Enum
from typing import Any
from urllib.parse import quote

from weirflow.validation.json_schema import JSONSchema


class CompatibilityLevel(Enum):
    NONE = "NONE"
    BACKWARD = "BACKWARD"
    BACKWARD_TRANSITIVE = "BACKWARD_TRANSITIVE"
    FORWARD = "FORWARD"
    FORWARD_TRANSITIVE = "FORWARD_TRANSITIVE"
    FULL = "FULL"
    FULL_TRANSITIVE = "FULL_TRANSITIVE"


def _reads(reader: dict, writer: dict) -> bool:
    """Whether whatever holds to writer holds to reader, as far as types, required and declared fields say."""
    if "type" in reader:
        wide = {reader["type"]} if isinstance(reader["type"], str) else set(reader["type"])
        wide |= {"integer"} if "number" in wide else set()
        own = writer.get("type")
        if own is None or not ({own} if isinstance(own, str) else set(own)) <= wide:
            return False
    fields, others = reader.get("properties", {}), writer.get("properties", {})
    if not set(reader.get("required", [])) <= set(writer.get("required", [])):
        return False
    if reader.get("additionalProperties", True) is False and (writer.get("additionalProperties", True) is not False or set(others) - set(fields)):
        return False
    return all(_reads(fields[k], others[k]) for k in fields.keys() & others.keys())


def compatible(new: dict, olds: list[dict], level: CompatibilityLevel = CompatibilityLevel.BACKWARD) -> bool:
    """Whether a schema may follow the older ones, the latest last."""
    if level is CompatibilityLevel.NONE or not olds:
        return True
    seen = olds if level.value.endswith("TRANSITIVE") else olds[-1:]
    back = all(_reads(new, old) for old in seen)
    forth = all(_reads(old, new) for old in seen)
    return back if level.value.startswith("BACKWARD") else forth if level.value.startswith("FORWARD") else back and forth


class SchemaRegistry:
    """A client of a schema registry's web interface. call: (method, path, body) -> answer, in place of HTTP."""

    def __init__(self, url: str = "", auth: dict[str, str] | None = None, call: Callable[[str, str, Any], Any] | None = None):
        self.url, self.headers = url.rstrip("/"), auth or {}
        self._call = call or self._http
        self._by_id: dict[int, JSONSchema] = {}

    def _http(self, method: str, path: str, body: Any = None) -> Any:
        data = json.dumps(body).encode() if body is not None else None
        request = urllib.request.Request(self.url + path, data=data, method=method, headers={"Content-Type": "application/vnd.schemaregistry.v1+json", **self.headers})
        with urllib.request.urlopen(request, timeout=30) as answer:
            return json.loads(answer.read())

    def register(self, subject: str, schema: dict, type: str = "JSON") -> int:
        """The schema's id."""
        return self._call("POST", f"/subjects/{quote(subject, safe='')}/versions", {"schema": json.dumps(schema), "schemaType": type})["id"]

    def get(self, id: int) -> JSONSchema:
        if id not in self._by_id:
            answer = self._call("GET", f"/schemas/ids/{id}", None)
            self._by_id[id] = JSONSchema(json.loads(answer["schema"]), id=id, type=answer.get("schemaType", "AVRO").lower())
        return self._by_id[id]

    def latest(self, subject: str) -> JSONSchema:
        a = self._call("GET", f"/subjects/{quote(subject, safe='')}/versions/latest", None)
        return JSONSchema(json.loads(a["schema"]), a["subject"], a["version"], a["id"], a.get("schemaType", "AVRO").lower())

    def versions(self, subject: str) -> list[int]:
        return self._call("GET", f"/subjects/{quote(subject, safe='')}/versions", None)

    def subjects(self) -> list[str]:
        return self._call("GET", "/subjects", None)

    def delete(self, subject: str) -> list[int]:
        return self._call("DELETE", f"/subjects/{quote(subject, safe='')}", None)

    def check(self, subject: str, schema: dict, type: str = "JSON") -> bool:
        """Whether the registry finds the schema compatible with the latest one; a subject without any takes all."""
        try:
            return self._call("POST", f"/compatibility/subjects/{quote(subject, safe='')}/versions/latest", {"schema": json.dumps(schema), "schemaType": type}).get("is_compatible", False)
        except urllib.error.HTTPError as e:
            if e.code == 404:
                return True
            raise
