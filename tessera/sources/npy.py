"""Matrices in .npy files as a Spark data source: df.write.format("npy").option("path", folder), and spark.read the same way.

Tasks write parts of bounded size into a folder of this run; the commit moves the parts of the tasks that succeeded, and only those, to
their place and removes the rest. A failed run is taken away whole, so a reader sees all of a run or nothing of it. The folder
is one that the driver and all executors mount.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

ROWS = 65_536  # of a part


def _folder(options: dict) -> str:
    if not options.get("path"):
        raise ValueError("the npy source needs a path")
    return options["path"].removeprefix("file://")


@dataclass
class _Written(WriterCommitMessage):
    parts: list[tuple[str, int]]


class _Writer(DataSourceArrowWriter):
    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite, self.run = folder, overwrite, f"{folder}/_run-{uuid.uuid4().hex}"
        os.makedirs(self.run)  # here, in the driver: a task that outlives a failed run must not make it anew

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        task, parts, held, count = uuid.uuid4().hex, [], [], 0

        def out() -> None:
            keys, matrix = np.concatenate([k for k, _ in held]), np.concatenate([m for _, m in held])
            name = f"part-{task}-{len(parts):05d}"
            np.save(f"{self.run}/{name}.keys.npy", keys)
            np.save(f"{self.run}/{name}.npy", matrix)
            parts.append((name, len(keys)))
            held.clear()

        for whole in iterator:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                column = batch.column(1)
                widths = {len(x) if x.is_valid else -1 for x in column}
                if len(widths) > 1 or -1 in widths or column.flatten().null_count or batch.column(0).null_count:
                    raise ValueError("a matrix has rows of one length without nulls, each with a key")
                values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
                if held and held[0][1].shape[1] != values.shape[1]:
                    raise ValueError("a matrix has rows of one length without nulls, each with a key")
                held.append((batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), values))
                count += batch.num_rows
                if count >= ROWS:
                    out()
                    count = 0
        if held:
            out()
        return _Written(parts)

    def commit(self, messages: list[_Written | None]) -> None:
        parts = [p for m in messages if m is not None for p in m.parts]
        widths = {np.load(f"{self.run}/{name}.npy", mmap_mode="r").shape[1] for name, _ in parts}
        if len(widths) > 1:
            self.abort(messages)
            raise ValueError(f"rows have lengths {sorted(widths)}")
        listed = f"{self.folder}/_parts.json"
        before = [] if self.overwrite or not os.path.exists(listed) else json.load(open(listed))
        for name, _ in parts:
            for end in (".keys.npy", ".npy"):
                os.replace(f"{self.run}/{name}{end}", f"{self.folder}/{name}{end}")
        with open(listed + ".new", "w") as f:
            json.dump(before + [list(p) for p in parts], f)
        os.replace(listed + ".new", listed)  # from here on a reader sees this run
        kept = {name for name, _ in before} | {name for name, _ in parts}
        for file in os.listdir(self.folder):
            if file.startswith("part-") and file.split(".")[0] not in kept:
                os.remove(f"{self.folder}/{file}")
        self.abort([])

    def abort(self, messages: list[_Written | None]) -> None:
        """Moved out of the way first, so that tasks which still run find no place to write to."""
        if os.path.exists(self.run):
            os.replace(self.run, f"{self.run}-gone")
            shutil.rmtree(f"{self.run}-gone", ignore_errors=True)


@dataclass
class _Part(InputPartition):
    name: str


class _Reader(DataSourceReader):
    def __init__(self, folder: str, names: list[str]):
        self.folder, self.names = folder, names

    def partitions(self) -> list[_Part]:
        listed = f"{self.folder}/_parts.json"
        if not os.path.exists(listed):
            raise ValueError(f"{self.folder} holds no committed matrix")
        return [_Part(name) for name, _ in json.load(open(listed))] or [_Part("")]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        if partition.name:
            keys, matrix = np.load(f"{self.folder}/{partition.name}.keys.npy"), np.load(f"{self.folder}/{partition.name}.npy")
            offsets = np.arange(len(keys) + 1, dtype=np.int32) * matrix.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.ravel()))], names=self.names)


class Npy(DataSource):
    """Options: path. Columns: a long key, and an array of doubles; under any names when written, key and fingerprint when read."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "key long, fingerprint array<double>"

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        if [f.dataType.typeName() for f in schema] != ["long", "array"]:
            raise ValueError("the npy source writes a long key and an array")
        return _Writer(_folder(self.options), overwrite)

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(_folder(self.options), schema.names)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Npy)
