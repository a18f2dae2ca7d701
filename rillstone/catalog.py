"""Definitions of sources, streams and sinks, kept as JSON files below a folder.

All three kinds share one namespace. A definition is written to a new file and renamed into place, so a crash leaves the old
or the new one. Checkpoints of streams are folders that executors reach, too.
"""

from __future__ import annotations

import json
import os
import shutil
import zlib
from pathlib import Path

from pyspark.sql import SparkSession

from . import storage
from .errors import CatalogError

KINDS = ("source", "stream", "sink")


class Catalog:
    def __init__(self, path: str, spark: SparkSession | None = None):
        """With a session checkpoints go to its shared folder, where executors reach them; else beside the definitions."""
        self.path, self.spark = Path(path), spark
        for sub in ("definitions", "states"):
            (self.path / sub).mkdir(parents=True, exist_ok=True)

    def _file(self, folder: str, name: str) -> Path:
        return self.path / folder / f"{name.lower().encode().hex()}.json"

    def _write(self, file: Path, data: dict) -> None:
        part = file.with_suffix(".part")
        part.write_text(json.dumps(data))
        os.replace(part, file)

    def exists(self, name: str) -> bool:
        return self._file("definitions", name).exists()

    def create(self, kind: str, name: str, **data) -> None:
        if self.exists(name):
            raise CatalogError(f"'{name}' already exists")
        self._write(self._file("definitions", name), {"kind": kind, "name": name, **data})

    def get(self, kind: str, name: str) -> dict:
        file = self._file("definitions", name)
        found = json.loads(file.read_text()) if file.exists() else {}
        if found.get("kind") != kind:
            raise CatalogError(f"{kind} '{name}' not found")
        return found

    def list(self, kind: str) -> list[dict]:
        every = (json.loads(f.read_text()) for f in (self.path / "definitions").glob("*.json"))
        return sorted((d for d in every if d["kind"] == kind), key=lambda d: d["name"].lower())

    def delete(self, kind: str, name: str) -> None:
        self.get(kind, name)
        self._file("definitions", name).unlink()
        self._file("states", name).unlink(missing_ok=True)
        self.clear_checkpoint(name)

    def checkpoint(self, name: str) -> str:
        own = name.lower().encode().hex()
        if self.spark is None:
            return str(self.path / "checkpoints" / own)
        return f"{storage.shared_base(self.spark)}/streams/{zlib.crc32(str(self.path.absolute()).encode()):08x}/{own}"

    def clear_checkpoint(self, name: str) -> None:
        if self.spark is None:
            shutil.rmtree(self.checkpoint(name), ignore_errors=True)
        else:
            storage.remove(self.spark, self.checkpoint(name))

    def state(self, name: str) -> dict:
        """The stream's last known state: created, started, stop, finish, or error with a message."""
        file = self._file("states", name)
        return json.loads(file.read_text()) if file.exists() else {"state": "created"}

    def set_state(self, name: str, state: str, message: str | None = None) -> None:
        self._write(self._file("states", name), {"state": state, "message": message})
