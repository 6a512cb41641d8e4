"""Helpers shared by the corpus operators: lineage cuts, ASCII folding, word hashing."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
BLANKS = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. A temporary one only where none is set and driver and tasks are one
    process, as in tests; elsewhere an error, as the executors would not see it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="quadrille-")
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder and read it back."""
    path = f"{shared_dir(df.sparkSession)}/quadrille/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def release(*tables: DataFrame | None) -> None:
    """Delete tables of materialise() that nothing reads any more."""
    for table in tables:
        if table is not None and (path := _paths.pop(table, None)):
            jvm = table.sparkSession.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. lower() does so where every other character is ASCII or a lower-case letter; it is much
    faster than translate(), which the remaining texts take."""
    odd = r"[\x{80}-\x{10FFFF}&&[^\p{Ll}]]"
    return F.when(text.rlike(odd), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_IS_BLANK = np.zeros(256, dtype=bool)
_IS_BLANK[[9, 10, 11, 12, 13, 32]] = True
_P = np.uint64(0x9E3779B97F4A7C15 | 1)


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_tables: dict[str, np.ndarray] = {"p": _powers(1 << 16, _P), "i": _powers(1 << 16, _INV)}


def _table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables["p"]) < n:
        size = 1 << (n - 1).bit_length()
        _tables["p"], _tables["i"] = _powers(size, _P), _powers(size, _INV)
    return _tables["p"], _tables["i"]


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3, on a copy."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A-Z-folded bytes, and the start and end offsets of the words [^\\x20\\x09-\\x0D]+ ."""
    raw = _FOLD[np.frombuffer(data, dtype=np.uint8)]
    blank = np.empty(len(raw) + 2, dtype=bool)
    blank[0] = blank[-1] = True
    blank[1:-1] = _IS_BLANK[raw]
    turn = np.flatnonzero(blank[1:] != blank[:-1])
    return raw, turn[0::2], turn[1::2]


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a text, in order; equal words after A-Z folding, equal hashes."""
    raw, start, end = word_spans(data)
    if not len(start):
        return np.empty(0, dtype=np.uint64)
    power, inverse = _table(len(raw) + 1)
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start] ^ (end - start).astype(np.uint64))


def shingle_hashes(words: np.ndarray, width: int = 5) -> np.ndarray:
    """The sorted distinct hashes of the runs of width words; of the whole sequence if there are fewer words."""
    n = len(words)
    if not n:
        return words
    width = min(width, n)
    out = np.zeros(n - width + 1, dtype=np.uint64)
    for k in range(width):
        out = mix(out * _P + words[k : n - width + 1 + k])
    if width < 5:
        out = mix(out + np.uint64(width))
    return np.unique(out)
