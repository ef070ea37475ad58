"""A table of batches that readers see whole or not at all.

A batch is written to a folder of its own and then listed: the list of a version is one small file that is moved into
place under the version's number, which only one writer can do.  Readers take the newest list and the folders in it, so a
batch that is being written, a rewrite or a failed attempt is never seen.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from . import folders


class CommittedTable:
    """``folder/data/<batch>-<attempt>`` and ``folder/versions/<number>``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _versions(self) -> list[int]:
        return sorted(int(n) for n in folders.names(self.spark, f"{self.folder}/versions") if n.isdigit())

    def _list(self, version: int) -> dict:
        return json.loads(folders.read_text(self.spark, f"{self.folder}/versions/{version}"))

    def current(self) -> dict:
        """Version, schema, and the folders with the batches they hold."""
        known = self._versions()
        return self._list(known[-1]) if known else {"version": 0, "schema": None, "parts": []}

    def _commit(self, before: dict, schema: str, parts: list[dict]) -> bool:
        after = {"version": before["version"] + 1, "schema": schema, "parts": parts}
        return folders.put_if_absent(self.spark, f"{self.folder}/versions/{after['version']}", json.dumps(after))

    def append(self, batch: DataFrame, batch_id: int) -> None:
        """Add a batch, or replace what an earlier attempt at it has committed."""
        target = f"{self.folder}/data/{batch_id}-{uuid.uuid4().hex}"
        batch.write.parquet(target)
        while True:
            before = self.current()
            if any(batch_id in p["batches"] and len(p["batches"]) > 1 for p in before["parts"]):
                raise ValueError(f"batch {batch_id} is merged with others and cannot be replaced")
            others = [p for p in before["parts"] if batch_id not in p["batches"]]
            if self._commit(before, batch.schema.json(), [*others, {"folder": target, "batches": [batch_id]}]):
                return

    def read(self) -> DataFrame:
        """All batches of the newest version."""
        known = self.current()
        if not known["parts"]:
            raise ValueError(f"{self.folder} holds no batch yet")
        return self._read(known, known["parts"])

    def _read(self, known: dict, parts: list[dict]) -> DataFrame:
        schema = StructType.fromJson(json.loads(known["schema"]))
        return self.spark.read.schema(schema).parquet(*[p["folder"] for p in parts])

    def compact(self, files: int, keep_last: int = 1) -> bool:
        """Write all batches but the last ones to one folder of some files; False if another writer was first.

        The last batches stay as they are, so that they can still be repeated.
        """
        before = self.current()
        old = sorted((p for p in before["parts"]), key=lambda p: max(p["batches"]))
        old, new = old[: len(old) - keep_last], old[len(old) - keep_last :]
        if len(old) < 2:
            return True
        target = f"{self.folder}/data/merged-{uuid.uuid4().hex}"
        self._read(before, old).coalesce(files).write.parquet(target)
        merged = {"folder": target, "batches": sorted(b for p in old for b in p["batches"])}
        return self._commit(before, before["schema"], [merged, *new])

    def clean(self, keep_versions: int = 2) -> None:
        """Delete lists older than the last versions, and folders that no kept list names."""
        known = self._versions()
        kept = known[-keep_versions:]
        named = {p["folder"].rsplit("/", 1)[-1] for v in kept for p in self._list(v)["parts"]}
        newest = max((b for v in kept for p in self._list(v)["parts"] for b in p["batches"]), default=-1)
        for name in folders.names(self.spark, f"{self.folder}/data"):
            batch = name.split("-")[0]
            # A folder of a newer batch may be one that is just being written.
            if name not in named and (batch == "merged" or int(batch) <= newest):
                folders.remove(self.spark, f"{self.folder}/data/{name}")
        for version in known[:-keep_versions]:
            folders.remove(self.spark, f"{self.folder}/versions/{version}")
