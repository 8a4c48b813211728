"""Shared helpers: byte-level words, word hashes, scratch tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders made for sessions that name no shared one, by application.
_OWN_DIRS: dict[str, str] = {}
#: Where materialised tables lie.
_PATHS: WeakKeyDictionary = WeakKeyDictionary()
#: Odd multipliers of the mixing functions below.
K1, K2, K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes that are no part of an alphanumeric word become blanks; bytes from 0x80 on are kept.
_ALNUM = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b) in _LOWER else 32 for b in range(256))


def raw_bytes(text: str | None) -> bytes:
    """UTF-8 bytes of a text; null is empty."""
    return (text or "").encode("utf-8", "surrogatepass")


def blank_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z (``bytes`` methods are ASCII-only)."""
    return raw_bytes(text).lower().split()


def alnum_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    return raw_bytes(text).lower().translate(_ALNUM).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words; hashing a word anew takes less time than to find it among those kept, and no memory."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(31))) * K2
    return x ^ (x >> np.uint64(29))


def lower_ascii(col):
    """Lower-case A-Z only."""
    return F.translate(col, _UPPER, _LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir``. Only a local master may do without; it gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        found = _OWN_DIRS.get(app) or _OWN_DIRS.setdefault(app, tempfile.mkdtemp(prefix="tessera-"))
    return found.rstrip("/")


@contextmanager
def settings(spark: SparkSession, **values: object):
    """Session settings (dots written as two underscores) while jobs inside run."""
    names = {k.replace("__", "."): str(v) for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def materialise(df: DataFrame, **options: object) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage and survives lost executors.

    What the write shuffled is removed at its end; ``discard`` removes the table. ``options`` go to the Parquet
    writer, dots written as two underscores.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    with settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        df.write.options(**{k.replace("__", "."): v for k, v in options.items()}).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``materialise`` that nothing still to be run reads."""
    for df in tables:
        where = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(_PATHS.pop(df))
        where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added where the frame has such a column."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def least_hashed(ids: DataFrame, key: Column, most: int, *then: str) -> DataFrame:
    """The ``most`` rows of least key, a hash. Only about that many rows of all partitions together are sorted."""
    share = (most + 6 * most**0.5) / max(ids.count(), 1)
    if share < 1:
        ids = ids.where(key < F.lit(int(-(2**63) + share * 2**64)))
    return ids.orderBy(key, *then).limit(most)


def map_batches(df: DataFrame, schema: str, start: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]]) -> DataFrame:
    """Run ``start()`` once a task and its result on every Arrow batch; columns keep their exact types, nulls included."""

    def run(batches):
        f = start()
        for b in batches:
            yield f(b)

    return df.mapInArrow(run, schema)


def batch(**columns) -> pa.RecordBatch:
    """A batch of Arrow arrays by name; (values, type) pairs are made into arrays."""
    made = {k: pa.array(v[0], v[1]) if isinstance(v, tuple) else v for k, v in columns.items()}
    return pa.RecordBatch.from_arrays(list(made.values()), names=list(made))


def appended(b: pa.RecordBatch, names: list[str], **columns) -> pa.RecordBatch:
    """The named columns of a batch, then new ones."""
    return batch(**{n: b.column(n) for n in names}, **columns)


def ddl(df: DataFrame) -> str:
    """The schema of a frame as DDL."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
