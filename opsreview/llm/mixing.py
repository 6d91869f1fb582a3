"""Mixing sources to target weights by balanced (cube) sampling.

A document of a source whose target is ``r`` times its size is taken ``floor(r)`` times, and
once more with probability ``frac(r)``. The cube method draws those extra copies so that
the words and the documents taken come as near as possible to what is expected: the
vector of probabilities walks inside the null space of the two balance constraints until
coordinates become 0 or 1, which keeps both totals unchanged, and only the last few
undecided documents are rounded (the landing).

The walk runs in blocks of bounded size inside a source, so a source with a third of all
rows is spread over many tasks. A block decides all but at most two of its documents;
the undecided ones, with their current probabilities, are dealt into new blocks and
walk on until one block per source is left. All draws come from a hash of the
document, so reruns agree however the data are split.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opsreview.llm.tables import WORD, text_of
from opsreview.session import write_through


@dataclass(frozen=True)
class MixSettings:
    """``weights`` repeat over the sources in order; ``share`` of all words is dealt out; a source
    gets ``most`` times its words at most; ``block_rows`` is the size that blocks are made for."""

    weights: tuple[int, ...] = (3, 1, 2)
    share: float = 1.5
    most: float = 2.0
    block_rows: int = 8_000
    seed: int = 5


def targets(sizes: DataFrame, settings: MixSettings) -> DataFrame:
    """``source, n_docs, source_size, target, ratio`` from rows with ``source, size``.

    Sources are ranked by code point, null last. Resharing an excess until no source is above its
    limit gives every source ``min(level * weight, limit)`` with one common level, which is found
    with running sums over the sources in the order in which they reach their limits. There is one
    row per source from here on, so the windows over all sources are small.
    """
    per = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    rank = W.orderBy(F.col("source").isNull(), F.col("source"))
    weights = F.array(*[F.lit(float(w)) for w in settings.weights])
    per = per.withColumn("weight", F.element_at(weights, ((F.row_number().over(rank) - 1) % len(settings.weights) + 1).cast("int")))
    per = per.withColumn("limit", F.lit(settings.most) * F.col("source_size"))
    full = W.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = full.rowsBetween(W.unboundedPreceding, -1)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    per = per.withColumns(
        {
            "total": F.lit(settings.share) * F.sum("source_size").over(everything),
            "filled": F.coalesce(F.sum("limit").over(before), F.lit(0.0)),
            "open_weight": F.sum("weight").over(full.rowsBetween(W.currentRow, W.unboundedFollowing)),
        }
    )
    # The level if all earlier sources are full and no later one is; the first that fits is the level.
    per = per.withColumn("candidate", (F.col("total") - F.col("filled")) / F.col("open_weight"))
    fits = F.col("candidate") <= F.col("limit") / F.col("weight")
    level = F.min(F.when(fits, F.struct(F.col("limit") / F.col("weight"), F.col("candidate").alias("level")))).over(everything)["level"]
    per = per.withColumn("level", level)
    target = F.coalesce(F.least("limit", F.col("level") * F.col("weight")), F.col("limit"))
    return per.select("source", "n_docs", "source_size", target.alias("target")).withColumn(
        "ratio", F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    )


def walk(chance: np.ndarray, size: np.ndarray, draws: np.random.Generator) -> np.ndarray:
    """Flight phase over one block, in the given order, with two constraints: words and documents.

    Three undecided documents span a null space of at least one dimension. They move along it until
    one of them is decided, then the next takes its place. At most two stay undecided.
    """
    p = chance.astype(float).copy()
    held: list[int] = []
    for k in range(len(p)):
        if not 1e-9 < p[k] < 1 - 1e-9:
            p[k] = round(p[k])
            continue
        held.append(k)
        if len(held) < 3:
            continue
        a, b, c = (float(size[i]) for i in held)
        move = (c - b, a - c, b - a)  # keeps the number of documents and the number of words
        if move == (0.0, 0.0, 0.0):
            move = (1.0, -1.0, 0.0)
        up = down = math.inf
        for i, d in zip(held, move, strict=True):
            if d > 0:
                up, down = min(up, (1 - p[i]) / d), min(down, p[i] / d)
            elif d < 0:
                up, down = min(up, p[i] / -d), min(down, (1 - p[i]) / -d)
        step = up if draws.random() < down / (up + down) else -down
        for i, d in zip(held, move, strict=True):
            p[i] += step * d
        nearest = min(held, key=lambda i: min(p[i], 1 - p[i]))
        p[nearest] = round(p[nearest])
        held = [i for i in held if 1e-9 < p[i] < 1 - 1e-9]
    return np.where(p < 1e-9, 0.0, np.where(p > 1 - 1e-9, 1.0, p))


#: The landing weighs all choices for so many documents.
LANDING = 12


def land(chance: np.ndarray, size: np.ndarray, draws: np.random.Generator) -> np.ndarray:
    """Walk, but leave the last documents; then decide all that are open by the choice whose words come
    nearest to what is expected (the nearest number of documents among equals, then the first)."""
    p = np.where(chance < 1e-9, 0.0, np.where(chance > 1 - 1e-9, 1.0, chance.astype(float)))
    keep = max(0, len(p) - (LANDING - 2))
    p[:keep] = walk(p[:keep], size[:keep], draws)
    open_ = np.flatnonzero((p > 0) & (p < 1))
    choices = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_))) & 1
    words = np.abs(choices @ size[open_].astype(float) - (p[open_] * size[open_]).sum())
    documents = np.abs(choices.sum(1) - p[open_].sum())
    p[open_] = choices[np.lexsort((documents, np.round(words, 6)))[0]]
    return p


_STATE = "row_key long, text_hash long, copy int, size long, source_no long, chance double"


def _round(last: bool, seed: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["row_key", "text_hash", "copy"], ignore_index=True)
        draws = np.random.default_rng([seed, int(key[0]) & 0xFFFFFFFF, int(key[1]) & 0xFFFFFFFF])
        # Long documents walk first, so that what stays undecided, and is rounded in the end, is short.
        order = np.lexsort((draws.random(len(rows)), -rows["size"].to_numpy()))
        chance, size = rows["chance"].to_numpy()[order], rows["size"].to_numpy()[order]
        rows.loc[order, "chance"] = (land if last else walk)(chance, size, draws)
        return rows[["row_key", "text_hash", "copy", "size", "source_no", "chance"]]

    return run


def _decided(extra: DataFrame, settings: MixSettings) -> DataFrame:
    """``row_key, text_hash, copy, chance`` with every chance 0 or 1. Each pass leaves at most two undecided documents per block."""
    done: list[DataFrame] = []
    level = 0
    while True:
        per = extra.groupBy("source_no").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / settings.block_rows))
        per = write_through(per.select("source_no", "blocks"), "mix-blocks")
        most = per.agg(F.max("blocks")).first()[0] or 1
        dealt = extra.join(per, "source_no").withColumn("block", F.pmod(F.xxhash64("row_key", "text_hash", "copy", F.lit(settings.seed + level)), F.col("blocks")))
        walked = write_through(dealt.groupBy("source_no", "block").applyInPandas(_round(most <= 1, settings.seed + level), _STATE), "mix-walk")
        decided = (F.col("chance") == 0) | (F.col("chance") == 1)
        done.append(walked.filter(decided))
        if most <= 1:
            break
        extra, level = walked.filter(~decided), level + 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select("row_key", "text_hash", "copy", "chance")


def _keyed(documents: DataFrame) -> DataFrame:
    """Adds two hashes that stand for id, source and text: 128 bits, never null."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return documents.withColumns({"row_key": F.xxhash64("doc_id", F.col("source").cast("string"), text), "text_hash": F.xxhash64(text, F.lit(1))})


def mixed(documents: DataFrame, settings: MixSettings | None = None) -> DataFrame:
    """One row for each row of ``documents``: ``doc_id, source, size, source_size, target, times, taken`` and
    the keys ``row_key, text_hash, copy``.

    A null text has size 0. Rows that repeat id, source and text are told apart by ``copy``, 1, 2, ..., so
    each of them is drawn on its own. A source without words has target 0 and is not taken.
    """
    settings = settings or MixSettings()
    size = F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size")
    rows = _keyed(documents.select("doc_id", "source", "text")).select("doc_id", F.col("source").cast("string").alias("source"), size, "row_key", "text_hash")
    rows = rows.groupBy("row_key", "text_hash", "size", "doc_id", "source").agg(F.count("*").alias("rows"))
    each = write_through(rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))).drop("rows"), "mix-sizes")
    number = F.row_number().over(W.orderBy(F.col("source").isNull(), F.col("source"))).cast("long")
    per = targets(each, settings).withColumn("source_no", number).withColumnRenamed("source", "of_source")
    # One row per source, written before: Spark sees its size and sends it to all tasks while it is small.
    per = write_through(per, "mix-targets")
    each = each.join(per, F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source", "n_docs")
    chance = F.col("ratio") - F.floor("ratio")
    extra = each.filter((chance > 0) & (F.col("size") > 0))
    drawn = _decided(extra.select("row_key", "text_hash", "copy", "size", "source_no", chance.alias("chance")), settings)
    met = each.join(drawn, ["row_key", "text_hash", "copy"], "left")
    times = (F.floor("ratio") + F.coalesce("chance", F.lit(0.0))).cast("int")
    out = met.withColumn("times", times).withColumn("taken", (F.col("times") * F.col("size")).cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", "times", "taken", "row_key", "text_hash", "copy")


def mix(documents: DataFrame, settings: MixSettings | None = None) -> DataFrame:
    """The rows of ``documents``, each as often as the mix takes it, with all their columns."""
    columns = documents.columns
    drawn = mixed(documents, settings).select("row_key", "text_hash", "copy", "times").groupBy("row_key", "text_hash")
    # Of rows alike in id, source and text it does not matter which is taken more often.
    drawn = drawn.agg(F.sum("times").alias("all_times"), F.count("*").alias("alike"))
    drawn = write_through(drawn.filter(F.col("all_times") > 0).withColumnsRenamed({"row_key": "mix_key", "text_hash": "mix_hash"}), "mix-times")
    keyed = _keyed(documents.select(F.struct(*[documents[c] for c in columns]).alias("row"), "doc_id", "source", "text")).select("row", "row_key", "text_hash")
    met = keyed.join(drawn, (F.col("row_key") == F.col("mix_key")) & (F.col("text_hash") == F.col("mix_hash")))
    place = F.row_number().over(W.partitionBy("row_key", "text_hash").orderBy("row_key", "text_hash"))
    times = F.floor(F.col("all_times") / F.col("alike")) + (place <= F.col("all_times") % F.col("alike")).cast("int")
    met = met.withColumn("times", F.when(F.col("alike") == 1, F.col("all_times")).otherwise(times).cast("int"))
    return met.select("row", F.explode(F.array_repeat(F.lit(1), F.col("times")))).select("row.*")
