"""Flat arrays in one file that Spark ships to every executor, where the Python workers of a machine share it memory-mapped.

The file is made on the driver, an array at a time, and handed over with SparkContext.addFile: a lost executor's successor fetches it anew. The
driver's copy goes when the driver ends.
"""

from __future__ import annotations

import atexit
import json
import mmap
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterable

import numpy as np
from pyspark import SparkFiles
from pyspark.sql import SparkSession


class Writer:
    """Appends arrays to a new file; `ship` closes it and returns its name on every executor."""

    def __init__(self, kind: str):
        self.name = f"{kind}-{uuid.uuid4().hex}.bin"
        self.folder = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, self.folder, ignore_errors=True)
        self.path = os.path.join(self.folder, self.name)
        self.file, self.head, self.size = open(self.path, "wb"), {}, 0  # noqa: SIM115

    def add(self, name: str, values: np.ndarray) -> None:
        self.head[name] = (self.size, len(values), values.dtype.str)
        self.file.write(values.tobytes() + b"\0" * (-values.nbytes % 8))
        self.size += values.nbytes + -values.nbytes % 8

    def add_parts(self, name: str, parts: Iterable[np.ndarray], kind: type) -> None:
        """Appends one array that comes in parts."""
        begin, n = self.size, 0
        for values in parts:
            self.file.write(values.tobytes())
            n += len(values)
        used = n * np.dtype(kind).itemsize
        self.file.write(b"\0" * (-used % 8))
        self.head[name] = (begin, n, np.dtype(kind).str)
        self.size += used + -used % 8

    def ship(self, spark: SparkSession) -> str:
        head = json.dumps(self.head).encode()
        self.file.write(head + len(head).to_bytes(8, "little"))
        self.file.close()
        spark.sparkContext.addFile(self.path)
        return self.name


_open: dict[str, dict[str, np.ndarray]] = {}


def opened(name: str) -> dict[str, np.ndarray]:
    """The arrays of a shipped file, by name; the last few files stay mapped."""
    if name not in _open:
        if len(_open) > 3:
            _open.clear()
        with open(SparkFiles.get(name), "rb") as f:
            whole = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        size = int.from_bytes(whole[-8:], "little")
        _open[name] = {n: np.frombuffer(whole, d, k, at) for n, (at, k, d) in json.loads(whole[-8 - size : -8]).items()}
    return _open[name]
