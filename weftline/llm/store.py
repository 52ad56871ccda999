"""Folders that the driver and all executors share.

The place is ``spark.checkpoint.dir`` of the session. Only where that is unset
and the session is local, as in tests, a temporary folder of this machine is set.
Executors reach the folder through ``pyarrow.fs``, so a local mount, HDFS or an
object store serve alike; where the files are on a mounted file system they are
mapped into memory, else read into it. A file holds several arrays, and a reader
keeps the files that it used last.
"""

from __future__ import annotations

import io
import json
import mmap
import os
import tempfile
import uuid
from collections import OrderedDict

import numpy as np
from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_ALIGN = 64


def root(spark: SparkSession) -> str:
    """The shared folder's URI; sets one only where none is configured and the session is local."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not place and spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        place = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("name a folder that all machines share as spark.checkpoint.dir")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="weftline-"))
        place = _own[0]
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(place)
    return place if "://" in place or place.startswith("file:") else "file://" + os.path.abspath(place)


def folder(spark: SparkSession, name: str) -> str:
    """A new folder's URI, made by whoever writes to it first."""
    return f"{root(spark).rstrip('/')}/weftline/{name}-{uuid.uuid4().hex}"


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read again: cuts the lineage."""
    path = folder(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables made by written, which nothing reads any more."""
    for t in tables:
        if path := getattr(t, "_stored", None):
            drop(t.sparkSession, path)


def drop(spark: SparkSession, uri: str) -> None:
    """Delete a folder that is no longer read."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def put(uri: str, name: str, **arrays: np.ndarray) -> None:
    """Write arrays as one file uri/name. A repeated task writes the same bytes and renames them into place."""
    store, path = _open(uri)
    store.create_dir(path, recursive=True)
    head, at = {}, 0
    for k, a in arrays.items():
        head[k] = (a.dtype.str, len(a), at)
        at += -(-a.nbytes // _ALIGN) * _ALIGN
    first = json.dumps(head).encode()
    first += b" " * (-(len(first) + 8) % _ALIGN)
    part = f"{path}/.{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(part) as f:
        f.write(len(first).to_bytes(8, "little") + first)
        for a in arrays.values():
            data = np.ascontiguousarray(a).view(np.uint8)
            f.write(data)
            f.write(bytes(-len(data) % _ALIGN))
    store.move(part, f"{path}/{name}")


def get(uri: str, name: str) -> dict[str, np.ndarray]:
    """The arrays of uri/name, mapped into memory; a mapping needs no open file."""
    from pyarrow import fs

    store, path = _open(uri)
    if isinstance(store, fs.LocalFileSystem):
        with open(f"{path}/{name}", "rb") as f:
            try:
                data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False)
            except TypeError:  # Python before 3.13
                data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    else:
        with store.open_input_stream(f"{path}/{name}") as f:
            out = io.BytesIO()
            while block := f.read(1 << 24):
                out.write(block)
            data = out.getbuffer()
    size = int.from_bytes(data[:8], "little")
    return {k: np.frombuffer(data, kind, n, 8 + size + at) for k, (kind, n, at) in json.loads(bytes(data[8 : 8 + size])).items()}


class Files:
    """The files of a folder, those used last kept: at most so many, and of those that can't be mapped so many bytes."""

    def __init__(self, uri: str, most: int = 1 << 15, most_bytes: int = 256 << 20):
        from pyarrow import fs

        self.uri, self.most, self.most_bytes = uri, most, most_bytes
        self.mapped = isinstance(_open(uri)[0], fs.LocalFileSystem)
        self.kept: OrderedDict[str, dict[str, np.ndarray]] = OrderedDict()
        self.size = 0

    def __call__(self, name: str) -> dict[str, np.ndarray]:
        if name in self.kept:
            self.kept.move_to_end(name)
            return self.kept[name]
        self.kept[name] = got = get(self.uri, name)
        self.size += self._bytes(got)
        while len(self.kept) > 1 and (len(self.kept) > self.most or self.size > self.most_bytes):
            self.size -= self._bytes(self.kept.popitem(last=False)[1])
        return got

    def _bytes(self, arrays: dict[str, np.ndarray]) -> int:
        return 0 if self.mapped else sum(a.nbytes for a in arrays.values())
