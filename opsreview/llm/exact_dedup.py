"""Exact duplicates by sorting content.

Texts, without white space, are range-partitioned by sampled splitters and sorted outside
memory, so equal texts lie next to each other. Each text is compared in full with its
neighbour; a run of equal texts keeps its first row. The order is: first bytes of the normalised
text, its SHA-256, then within equal texts the longest original and the smallest id, so splitters
are short, a run of any size is cut over many partitions, and its first row is the one
that stays. Runs that touch the edge of a partition are put together from two small rows per
partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opsreview.llm.tables import partitions, text_of
from opsreview.session import write_through

#: Code points of the normalised text that come first in the order.
FIRST = 32
FIRST_RUN, LAST_RUN, INNER = 0, 1, 2

_SCHEMA = (
    "part int, edge int, place long, doc_id long, known boolean, text_sha256 string, n_points long, "
    "keep_id long, keep_known boolean, run_size long, edge_text string"
)


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of one partition in order. A run is given out when it has ended; only ids are held until then."""
    columns = [x.split()[0] for x in _SCHEMA.split(", ")]
    out: list[tuple] = []
    run: list[tuple] = []
    text, runs, part = None, 0, 0

    def end(last: bool) -> None:
        nonlocal runs
        edge = FIRST_RUN if runs == 0 else LAST_RUN if last else INNER
        _, doc, known, *_ = run[0]
        for k, (part, *rest) in enumerate(run):
            out.append((part, edge, k, *rest, doc, known, len(run), text if k == 0 and edge != INNER else None))
        runs += 1
        run.clear()

    for batch in batches:
        for part, doc, known, sha, n, own in zip(batch["part"], batch["doc_id"], batch["known"], batch["sha"], batch["n_points"], batch["norm"], strict=True):
            if run and own != text:
                end(False)
            text = own
            run.append((part, doc, known, sha, n))
        if out:
            yield pd.DataFrame(out, columns=columns)
            out.clear()
    if run:
        end(True)
        yield pd.DataFrame(out, columns=columns)


def deduplicated(documents: DataFrame) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``: one row for each row of ``documents``.

    Texts are equal if they are the same without blanks and U+0009 to U+000D; null counts as empty. Of
    equal texts one row stays: the most code points in the original, then the smallest doc_id; rows
    without an id come last, and of rows that are alike in all this any one stays.
    """
    text = text_of()
    rows = documents.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"),
        F.col("doc_id").isNotNull().alias("known"),
        F.char_length(text).cast("long").alias("n_points"),
        F.regexp_replace(text, r"[\x20\x09-\x0D]+", "").alias("norm"),
    ).withColumns({"sha": F.sha2(F.col("norm"), 256), "first": F.substring("norm", 1, FIRST)})
    inside = [F.col("n_points").desc(), F.col("known").desc(), F.col("doc_id")]
    ranged = rows.repartitionByRange(partitions(documents), "first", "sha", *inside).sortWithinPartitions("first", "sha", "norm", *inside)
    walked = ranged.select(F.spark_partition_id().alias("part"), "doc_id", "known", "sha", "n_points", "norm").mapInPandas(_runs, _SCHEMA)
    walked = write_through(walked, "content-runs")

    # One row per run at an edge: at most two per partition.
    edges = walked.filter((F.col("edge") != INNER) & (F.col("place") == 0))
    along = W.orderBy("part", "edge")
    edges = edges.withColumn("new", F.coalesce(F.col("edge_text") != F.lag("edge_text").over(along), F.lit(True)).cast("int"))
    edges = edges.withColumn("whole", F.sum("new").over(along))
    group = W.partitionBy("whole")
    edges = edges.select(
        "part",
        "edge",
        F.sum("run_size").over(group).alias("whole_size"),
        F.first("keep_id").over(group.orderBy("part", "edge")).alias("whole_keep"),
        F.first("keep_known").over(group.orderBy("part", "edge")).alias("whole_known"),
        (F.col("new") == 1).alias("head"),
    )
    met = walked.join(F.broadcast(edges), ["part", "edge"], "left")
    keep, known = F.coalesce("whole_keep", "keep_id"), F.coalesce("whole_known", "keep_known")
    return met.select(
        F.when(F.col("known"), F.col("doc_id")).alias("doc_id"),
        F.when(known, keep).alias("keep_id"),
        F.coalesce("whole_size", "run_size").alias("group_size"),
        ((F.col("place") == 0) & F.coalesce("head", F.lit(True))).alias("kept"),
        "text_sha256",
    )
