"""A ledger of steps in a folder all executors reach, so that a stopped job goes on where it was.

A step's table is written to a folder of its own; only then one row is appended to the ledger. Spark commits that row as a
single file, so a step is either done, with its table whole, or it is repeated into a new folder. The row carries a hash of
the step's parameters and of the steps it depends on: with other parameters, or after a step before it was made anew, the
step counts as not done.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelframe.session import read_if_there

ROW = "step string, hash string, folder string, started double, seconds double, n_rows long, note string"


def digest(*parts: object) -> str:
    """Hash of parameters, independent of the order of keys."""
    return hashlib.md5(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:16]


def files_digest(table: DataFrame) -> str:
    """Hash of the files a table is read from: their paths, sizes and times."""
    files = table.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    return digest(*map(str, files.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*files.columns))).first()))


class Ledger:
    """Steps of a job below one folder. The rows read at the start and added since are a few per step."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        stored = read_if_there(spark, f"{path}/ledger")
        self.rows = {} if stored is None else {(r.step, r.hash): r for r in stored.orderBy("started").collect()}
        self.made: list[str] = []

    def done(self, step: str, hash_: str) -> bool:
        return (step, hash_) in self.rows

    def record(self, step: str, hash_: str, folder: str, started: float, n_rows: int | None = None, note: str | None = None) -> None:
        """Commit a step: from here on it is done."""
        row = self.spark.createDataFrame([(step, hash_, folder, started, time.time() - started, n_rows, note)], ROW)
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/ledger")
        self.rows[step, hash_] = row.first()
        self.made.append(step)

    def table(self, step: str, make: Callable[[], DataFrame], parameters: object = None, after: tuple[str, ...] = ()) -> tuple[DataFrame, str]:
        """The table of a step and its hash; ``make`` is called only if the step is not done. ``after`` has the hashes of the
        steps and inputs it depends on."""
        hash_ = digest(step, parameters, *after)
        if not self.done(step, hash_):
            started, folder = time.time(), f"{self.path}/{step}/{uuid.uuid4().hex}"
            made = make()
            made.write.parquet(folder)
            self.record(step, hash_, folder, started, self.spark.read.schema(made.schema).parquet(folder).count())
        return self.spark.read.parquet(self.rows[step, hash_].folder), hash_

    def run_times(self, step: str | None = None) -> DataFrame:
        """step, hash, seconds of what is done, the last run of each."""
        rows = [(r.step, r.hash, r.seconds, r.note) for (name, _), r in self.rows.items() if step is None or name == step]
        return self.spark.createDataFrame(rows, "step string, hash string, seconds double, note string")
