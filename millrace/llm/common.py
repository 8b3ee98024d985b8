"""What the operators of this package share: session settings, shared-folder tables, column guards."""

from __future__ import annotations

import ctypes
import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import join_often  # noqa: F401
from ..sources.sinks import stash  # noqa: F401

WORD = r"[^\x20\x09-\x0D]+"
RECORDS_PER_BATCH = 500
BYTES_PER_BATCH = 16 << 20
_SPACE = {str: re.compile(r"[ \t-\r]"), bytes: re.compile(rb"[ \t-\r]")}


def spread(df: DataFrame) -> DataFrame:
    """df dealt evenly over the cores where its source has fewer parts than those: a small file is one part otherwise."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def small_batches(spark: SparkSession) -> None:
    """Bound the rows and bytes that a Python worker gets at once, for texts can be very long.

    Plans read these settings when they run, so they stay set in the session; smaller ones of the session's own are kept.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", RECORDS_PER_BATCH), ("spark.sql.execution.arrow.maxBytesPerBatch", BYTES_PER_BATCH)):
        n, unit = re.fullmatch(r"(-?\d+)([a-z]*)", spark.conf.get(key).lower()).groups()
        now = int(n) << 10 * "bkmgt".index(unit[:1] or "b")
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def fold(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of the id as text, mod 5. A null id counts as empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % 5


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names for columns of an operator's own that clash with none of df's, whatever their case."""
    have, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        name = f"_{name}"
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """128 bits that stand for a row's id and text; nulls are allowed."""
    return [F.xxhash64(F.col(doc_id), F.col(text)).alias("_r1"), F.xxhash64(F.lit(7), F.col(text), F.col(doc_id)).alias("_r2")]


def word_count(text: str | Column) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def stretches(text: str | bytes, size: int):
    """text in parts of about `size` characters or bytes, cut at white space only, so that no word is cut."""
    at = 0
    while at < len(text):
        gap = _SPACE[type(text)].search(text, at + size) if at + size < len(text) else None
        end = gap.end() if gap else len(text)
        yield text[at:end]
        at = end


def splitmix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, on uint64 with wrap-around."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of an ordered pair of uint64 arrays."""
    with np.errstate(over="ignore"):
        return splitmix(a * np.uint64(0xD6E8FEB86659FD93) + splitmix(b))


def give_back() -> None:
    """Return freed memory to the system: a worker is reused, and what it holds counts against the executor."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


SENT = 200_000


def join_sized(rows: DataFrame, once: DataFrame, keys: list[str], width: int = 1) -> DataFrame:
    """rows left join once, one row a key: sent to all tasks if it has at most SENT / width rows, which are counted first,
    and beyond that by shuffle without hot tasks. `width` is how many values a row holds."""
    if once.count() <= SENT // width:
        return rows.join(F.broadcast(once), keys, "left")
    return join_often(rows, once, keys)
