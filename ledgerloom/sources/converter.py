"""A conversion session fed with chunks of bytes."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

from ..errors import CsvMissingHeader, InvalidState, MemoryLimitExceeded
from ..types import CsvReadOptions, ExcelLoadOptions, ParquetWriteOptions, SchemaHint
from .csv_files import read_csv
from .parquet_files import write_parquet
from .xlsx import read_xlsx

#: Bytes that a session takes, and its memory limit in MB.
INPUT_CAP, MEMORY_LIMIT = 2 * 1024**3, 150


class Converter:
    """begin_*, then feed chunks, the last with ``is_last``: that one writes the Parquet dataset to ``out`` and returns its path.

    Chunks land in ``folder``, which a cluster's executors must share; a chunk may end anywhere, also within a
    record or a character. What the session itself holds in memory is one chunk, which goes to the file at once; one
    above ``memory_limit_mb`` is MemoryLimitExceeded, as is more input than ``input_cap`` bytes. Rows are Spark's, which spills.
    """

    def __init__(self, spark: SparkSession, out: str, folder: str | None = None, input_cap: int = INPUT_CAP, memory_limit_mb: int = MEMORY_LIMIT):
        if memory_limit_mb < 1:
            raise ValueError("the memory limit must be at least 1 MB")
        self.spark, self.out, self.input_cap, self.memory_limit_mb = spark, out, input_cap, memory_limit_mb
        if folder is None and not spark.sparkContext.master.startswith("local"):
            raise ValueError("name a folder that all executors share")
        self.folder = tempfile.mkdtemp(prefix="ledgerloom-convert-", dir=folder)
        self.state, self.bytes_consumed = "Idle", 0
        self._job = None

    def _begin(self, state: str, name: str, job) -> None:
        if self.state != "Idle":
            raise InvalidState(f"a conversion is under way ({self.state})")
        self.state, self.bytes_consumed, self._job = state, 0, job
        self._path = os.path.join(self.folder, name)
        open(self._path, "wb").close()

    def begin_csv_to_parquet(self, read: CsvReadOptions | None = None, write: ParquetWriteOptions | None = None, hint: SchemaHint | None = None) -> None:
        self._begin("CsvToParquet", "input.csv", lambda p: write_parquet(read_csv(self.spark, p, read, hint), self.out, write))

    def begin_excel_to_parquet(self, read: ExcelLoadOptions | None = None, write: ParquetWriteOptions | None = None, hint: SchemaHint | None = None) -> None:
        self._begin("ExcelToParquet", "input.xlsx", lambda p: write_parquet(read_xlsx(self.spark, p, read, hint), self.out, write))

    def feed(self, chunk: bytes, is_last: bool = False) -> str | None:
        if self.state == "Idle":
            raise InvalidState("no conversion has begun")
        if self.bytes_consumed + len(chunk) > self.input_cap:
            raise MemoryLimitExceeded(f"more than {self.input_cap} bytes of input")
        if len(chunk) > self.memory_limit_mb * 2**20:
            raise MemoryLimitExceeded(f"a chunk of {len(chunk)} bytes is above {self.memory_limit_mb} MB")
        with open(self._path, "ab") as f:
            f.write(chunk)
        self.bytes_consumed += len(chunk)
        if not is_last:
            return None
        try:
            if not self.bytes_consumed:
                raise CsvMissingHeader("the input is empty")
            self._job(self._path)
            return self.out
        finally:
            self.state = "Idle"

    def free(self) -> None:
        """Drop what was fed."""
        self.state = "Idle"
        shutil.rmtree(self.folder, ignore_errors=True)

    def __enter__(self) -> Converter:
        return self

    def __exit__(self, *_: object) -> None:
        self.free()
