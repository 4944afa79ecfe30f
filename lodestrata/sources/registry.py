"""A schema registry in a folder of JSON files: <subject>/<version>.json with id and schema."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

from lodestrata.plans.files import Files
from lodestrata.sources.avro import compatible, parse


class SchemaRegistry:
    """Wherever Spark reads and writes. Lookups are read when asked for, so ids that
    were added later are found."""

    def __init__(self, spark: SparkSession, folder: str):
        self.disk, self.folder = Files(spark), folder.rstrip("/")

    def _versions(self, subject: str) -> list[dict]:
        at = f"{self.folder}/{subject}"
        numbers = sorted(int(x.removesuffix(".json")) for x in self.disk.names(at) if x.endswith(".json") and not x.startswith("."))
        return [json.loads(self.disk.read(f"{at}/{n}.json")) for n in numbers]

    def register(self, subject: str, schema: str | dict) -> int:
        """Add a version (unless the last one is the same); its id."""
        found = self._versions(subject)
        schema = parse(schema)
        if found and found[-1]["schema"] == schema:
            return found[-1]["id"]
        ids = [x["id"] for s in self.subjects() for x in self._versions(s)]
        entry, at = {"id": max(ids, default=0) + 1, "schema": schema}, f"{self.folder}/{subject}"
        if not self.disk.write_new(f"{at}/{len(found) + 1}.json", json.dumps(entry), f"{at}/.{uuid.uuid4().hex}"):
            raise FileExistsError(f"version {len(found) + 1} of {subject} was added meanwhile")
        return entry["id"]

    def subjects(self) -> list[str]:
        return self.disk.names(self.folder)

    def schema(self, schema_id: int) -> dict:
        for subject in self.subjects():
            for entry in self._versions(subject):
                if entry["id"] == schema_id:
                    return entry["schema"]
        raise KeyError(f"no schema has id {schema_id}")

    def latest(self, subject: str) -> tuple[int, dict]:
        found = self._versions(subject)
        if not found:
            raise KeyError(f"no schema for subject {subject}")
        return found[-1]["id"], found[-1]["schema"]

    def ids(self, subject: str) -> list[int]:
        return sorted({x["id"] for x in self._versions(subject)})

    def writers(self, subject: str) -> dict[int, dict]:
        return {x["id"]: x["schema"] for x in self._versions(subject)}

    def accepts(self, subject: str, candidate: str | dict) -> bool:
        """Whether data of the latest version can be read under the candidate (an unknown subject accepts any)."""
        found = self._versions(subject)
        return not found or compatible(parse(candidate), found[-1]["schema"])
