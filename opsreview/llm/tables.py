"""Small column helpers that the training-data operators share."""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the operators' contracts mean it: blank and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text as a string; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def held_out(doc_id: str = "doc_id") -> Column:
    """Fold 2 of 4 by crc32 of the id written as text; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def thinned(df: DataFrame, key: str, rows: int, of: int, salt: int = 0) -> DataFrame:
    """About ``rows`` of the ``of`` rows of ``df``, chosen by a hash of ``key``: the same on every run."""
    if of <= rows:
        return df
    step = 1 << 30
    return df.filter(F.pmod(F.xxhash64(F.col(key), F.lit(salt)), F.lit(step)) < int(step * rows / of))


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def stretches(texts: Sequence[str], characters: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Cut a batch where about so many characters have come together: Python objects made from
    a text weigh many times the text. A longer text is a stretch of its own."""
    start = held = 0
    for i, text in enumerate(texts):
        if held and held + len(text) > characters:
            yield start, i
            start, held = i, 0
        held += len(text)
    if start < len(texts):
        yield start, len(texts)


def remembered(kind: str, key: object, make):
    """A cache that a Python worker keeps between tasks: one at a time, as long as kind and key are the same.

    Functions come to a worker anew with each task, so the cache lies in a module of its own. Losing
    it costs time only.
    """
    import sys
    import types

    state = sys.modules.setdefault("opsreview_worker_state", types.ModuleType("opsreview_worker_state"))
    if getattr(state, "name", None) != (kind, key):
        state.cache = None
        state.name, state.cache = (kind, key), make()
    return state.cache


def forget() -> None:
    """Drop that cache before a task that needs the worker's memory itself."""
    remembered("nothing", 0, lambda: None)


def release() -> None:
    """Give memory that is free inside this process back to the system: an idle Python worker holds it beside the executor otherwise."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library only
    if trim is not None:
        trim(0)


def releasing(function):
    """For a function from batches to batches: what its worker does not need is given back when its task is over."""

    @functools.wraps(function)
    def run(batches):
        try:
            yield from function(batches)
        finally:
            release()

    return run
