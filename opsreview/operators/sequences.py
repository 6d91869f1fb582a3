"""Investigation action sequences: repetition, deviation, missing steps."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opsreview.config import SequenceConfig
from opsreview.functions.expr import (
    action_letter,
    action_names,
    edit_distance_ratio,
    letters_of,
    period_label,
    sequence_hash,
    severity_at_least,
)
from opsreview.functions.ordered import BLOCK, earlier_blocks, in_blocks, within_block
from opsreview.operators.rollups import in_first_period, reporting_periods
from opsreview.session import write_through
from opsreview.sources.tables import Tables

#: Investigations with more actions are put together by many tasks.
LONG = 100_000
#: Buckets of ids by which actions are counted first.
BUCKETS = 1 << 16


def _ordered_letters(group: str = "steps") -> F.Column:
    return F.array_join(F.transform(F.array_sort(group), lambda s: s["letter"]), "")


def _long_ids(ids: DataFrame) -> DataFrame:
    """Ids of more than ``LONG`` actions, as ``long_id``. Actions are counted by a few buckets of ids first, which is little to
    shuffle; only the ids of buckets with more actions than that are counted one by one."""
    bucket = F.pmod(F.xxhash64("investigation_id"), F.lit(BUCKETS)).cast("int")
    full = write_through(ids.groupBy(bucket.alias("full")).agg(F.count("*").alias("n")).where(F.col("n") > LONG).select("full"), "full-buckets")
    if not full.isEmpty():
        ids = ids.join(F.broadcast(full), bucket == F.col("full"), "left_semi")
        ids = ids.groupBy("investigation_id").agg(F.count("*").alias("n")).where(F.col("n") > LONG)
    else:
        ids = ids.limit(0)
    return write_through(ids.select(F.col("investigation_id").alias("long_id")), "long-investigations")


def action_sequences(actions: DataFrame) -> DataFrame:
    """Per investigation: ``letters`` (one per action, in order), ``action_count``,
    ``has_duplicate_numbers``.

    Order is by sequence number, then time (missing times last), then action id.
    Investigations of up to ``LONG`` actions are sorted in the partitions of their ids and
    read off in that order. Longer ones are put together from pieces of blocks, so no task
    sorts a whole one, however long it is.
    """
    steps = actions.select(
        "investigation_id",
        F.col("sequence_number").cast("bigint").alias("seq"),
        F.col("occurred_at").isNull().alias("untimed"),
        F.col("occurred_at").alias("at"),
        F.col("action_id").alias("id"),
        action_letter("action_type").alias("letter"),
    )
    long = _long_ids(actions.select("investigation_id"))
    if long.isEmpty():
        return _in_order(steps)
    return _in_order(_of(steps, long, "long_id", "left_anti")).unionByName(_from_pieces(_of(steps, long, "long_id", "left_semi")))


def _of(rows: DataFrame, ids: DataFrame, id_column: str, how: str) -> DataFrame:
    return rows.join(ids, F.col("investigation_id").eqNullSafe(F.col(id_column)), how)


def _read_off(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per investigation from ordered steps; the last one of a batch waits for the next batch."""
    waiting: pa.Table | None = None
    for batch in chain(batches, [None]):
        if batch is None:
            table, waiting = waiting, None
        else:
            table = pa.Table.from_batches([batch])
            table, waiting = (pa.concat_tables([waiting, table]) if waiting is not None else table), None
        if table is None or not table.num_rows:
            continue
        table = table.combine_chunks()
        ids, numbers = (table[c].combine_chunks().dictionary_encode("encode") for c in ("investigation_id", "seq"))
        fresh, again = (np.diff(c.indices.to_numpy()) != 0 for c in (ids, numbers))
        first = np.concatenate([[0], np.flatnonzero(fresh) + 1])
        if batch is not None:
            waiting = table.slice(int(first[-1]))
            first, size = first[:-1], int(first[-1])
        else:
            size = table.num_rows
        if not len(first):
            continue
        ends = np.append(first[1:], size)
        repeated = np.concatenate([[0], np.cumsum(~fresh & ~again)])  # up to a row, within its investigation
        letters = "".join(table["letter"].slice(0, size).to_pylist()).encode("ascii")
        offsets = np.append(first, size).astype(np.int32)
        moments, kinds = table["moment"].to_numpy(), np.frombuffer(letters, np.uint8)
        unclear = np.zeros(size, np.int64)  # up to a row: it differs from the one before at the same moment
        np.cumsum(~fresh[: size - 1] & (moments[1:size] == moments[: size - 1]) & (kinds[1:] != kinds[:-1]), out=unclear[1:])
        yield pa.RecordBatch.from_pydict({
            "investigation_id": table["investigation_id"].combine_chunks().take(pa.array(first)),
            "letters": pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets.tobytes()), pa.py_buffer(letters)),
            "action_count": pa.array((ends - first).astype(np.int64)),
            "has_duplicate_numbers": pa.array(repeated[ends - 1] > repeated[first]),
            "tied": pa.array(unclear[ends - 1] > unclear[first]),
        })


def _in_order(steps: DataFrame) -> DataFrame:
    """Action ids are long and decide only where number and time are the same, so they stay behind at first;
    investigations in which different actions meet there are read off again by id."""
    read = write_through(_sorted(steps.drop("id")), "action-letters")
    tied = read.where("tied").select(F.col("investigation_id").alias("tied_id"))
    if tied.isEmpty():
        return read.drop("tied")
    again = _sorted(_of(steps, tied, "tied_id", "left_semi"))
    return read.where("not tied").unionByName(again).drop("tied")


def _sorted(steps: DataFrame) -> DataFrame:
    """Rows are sorted by a hash first: numbers are compared faster than ids that begin alike."""
    order = ["investigation_id", "seq", "untimed", "at", *[c for c in ("id",) if c in steps.columns], "letter"]
    dealt = steps.repartition("investigation_id").withColumn("place", F.xxhash64("investigation_id"))
    ordered = dealt.sortWithinPartitions("place", *order)
    moment = F.xxhash64("seq", "untimed", "at").alias("moment")
    return ordered.select("investigation_id", "seq", moment, "letter").mapInArrow(
        _read_off, "investigation_id string, letters string, action_count bigint, has_duplicate_numbers boolean, tied boolean"
    )


def _from_pieces(steps: DataFrame) -> DataFrame:
    """The same from range-partitioned blocks. An investigation has at most one piece per block."""
    flat = steps.withColumn("step", F.struct("seq", "untimed", "at", "id", "letter"))
    blocks = in_blocks(flat, ["investigation_id"], ["seq", "untimed", "at", "id"], "action-pieces")
    # Equal numbers lie next to each other, so a piece sees its own repeats; the first
    # and last number show repeats that two pieces share.
    numbers = F.transform("steps", lambda s: s["seq"])
    pieces = (
        blocks.groupBy("investigation_id", BLOCK)
        .agg(F.collect_list("step").alias("steps"))
        .select(
            "investigation_id",
            F.struct(
                BLOCK,
                _ordered_letters().alias("letter"),
                F.array_min(numbers).alias("first"),
                F.array_max(numbers).alias("last"),
            ).alias("piece"),
            F.size("steps").alias("n"),
            (F.size(F.array_distinct(numbers)) < F.size("steps")).alias("repeats"),
        )
    )
    ends = F.array_sort("pieces")
    shared = F.exists(
        F.sequence(F.lit(2), F.size("pieces")), lambda i: F.element_at(ends, i)["first"].eqNullSafe(F.element_at(ends, i - 1)["last"])
    )
    return (
        pieces.groupBy("investigation_id")
        .agg(F.collect_list("piece").alias("pieces"), F.sum("n").alias("action_count"), F.bool_or("repeats").alias("repeats"))
        .select(
            "investigation_id",
            _ordered_letters("pieces").alias("letters"),
            "action_count",
            (F.col("repeats") | (F.when(F.size("pieces") > 1, shared).otherwise(F.lit(False)))).alias("has_duplicate_numbers"),
        )
    )


def investigation_records(tables: Tables, config: SequenceConfig = SequenceConfig()) -> DataFrame:
    """Investigations inside a reporting period with their sequence and alert severity.

    Written once, in (entity, period, investigation) order and cut into blocks; the
    three detectors and the evidence all read this table.
    """
    periods = reporting_periods(tables.performance_metrics)
    placed = in_first_period(
        tables.investigations.select("investigation_id", "entity_id", "alert_id", "status", "started_at"),
        periods,
        "started_at",
    )
    severity = tables.alerts.select("alert_id", F.col("severity").alias("alert_severity"))
    records = (
        placed.join(action_sequences(tables.investigation_actions), "investigation_id", "left")
        .join(severity, "alert_id", "left")
        .na.fill({"letters": "", "action_count": 0, "has_duplicate_numbers": False, "alert_severity": ""})
    )
    return in_blocks(records, ["entity_id"], ["period_start", "investigation_id"], "investigation-records")


def _eligible(records: DataFrame, config: SequenceConfig) -> DataFrame:
    return records.where(F.col("action_count") >= config.min_sequence_length)


def sequence_counts(records: DataFrame, config: SequenceConfig = SequenceConfig()) -> DataFrame:
    """How often each sequence occurs per entity and period, and who had it first."""
    return _eligible(records, config).groupBy("entity_id", "period_start", "letters").agg(
        F.count("*").alias("matching"),
        F.min("investigation_id").alias("first_seen"),
        F.max("period_end").alias("period_end"),
    )


def repetitive(records: DataFrame, config: SequenceConfig = SequenceConfig()) -> DataFrame:
    """IF-REP-001: the commonest sequence of an entity-period, if it occurs often enough.

    The commonest is the smallest (-count, first seen) pair, a mergeable aggregate,
    so no window over an entity-period is needed. The rate is reported, not tested.
    """
    top = (
        sequence_counts(records, config)
        .groupBy("entity_id", "period_start")
        .agg(
            F.min(F.struct((-F.col("matching")).alias("rank"), "first_seen", "letters")).alias("top"),
            F.sum("matching").alias("window_investigation_count"),
            F.max("period_end").alias("window_end"),
        )
        .select(
            "entity_id",
            F.col("period_start").alias("window_start"),
            "window_end",
            period_label("period_start").alias("period_label"),
            F.col("top.letters").alias("letters"),
            (-F.col("top.rank")).alias("matching_investigation_count"),
            "window_investigation_count",
        )
        .where(
            (F.col("window_investigation_count") >= config.min_comparable_investigations)
            & (F.col("matching_investigation_count") >= config.repetition_threshold)
        )
    )
    n = F.col("matching_investigation_count")
    share = n / F.col("window_investigation_count")
    return top.select(
        F.concat_ws(":", F.lit("IF-REP-001"), "entity_id", "period_label", sequence_hash("letters")).alias("finding_key"),
        "entity_id", "window_start", "window_end", "period_label", "letters",
        action_names("letters").alias("dominant_sequence"),
        "matching_investigation_count", "window_investigation_count",
        share.alias("repetition_rate"),
        F.when((n >= 2 * config.repetition_threshold) & (share >= F.lit(0.8)), "HIGH")
        .when(share >= F.lit(0.5), "MODERATE")
        .otherwise("LOW")
        .alias("confidence"),
        F.format_string(
            "In %s, %d of %d comparable investigations of entity %s follow the same action sequence. "
            "This describes records and states no cause.",
            "period_label", n, "window_investigation_count", "entity_id",
        ).alias("summary"),
    )


def repetition_members(records: DataFrame, findings: DataFrame, config: SequenceConfig = SequenceConfig()) -> DataFrame:
    """The investigations behind each IF-REP-001 finding, one row per investigation."""
    key = findings.select(
        "entity_id", F.col("window_start").alias("period_start"), "letters", "finding_key", "period_label"
    )
    return _eligible(records, config).select(
        "entity_id", "period_start", "letters", "investigation_id"
    ).join(key, ["entity_id", "period_start", "letters"])


def running_baseline(records: DataFrame, config: SequenceConfig = SequenceConfig()) -> DataFrame:
    """For each eligible investigation: the commonest sequence among the entity's
    earlier ones (ties: the one seen first), its count, and how many came before.

    Each row raises the count of one sequence by one, so the leader before a row is
    the best (count so far, first seen) pair among the earlier rows. The counts, the
    first sightings and the leader are each computed inside a block and completed
    with one summary row per earlier block, so an entity may be of any size.
    """
    entity, order = ["entity_id"], ["period_start", "investigation_id"]
    own = [*entity, "letters"]
    rows = (
        _eligible(records, config)
        .select(BLOCK, *entity, *order, "period_end", "letters")
        .withColumn("pos", F.row_number().over(within_block(entity, order)))
        .withColumn("seen", F.row_number().over(within_block(own, order)))
    )
    per_block = rows.groupBy(*own, BLOCK).agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))
    carried = per_block.select(
        *own,
        BLOCK,
        F.coalesce(F.sum("n").over(earlier_blocks(own)), F.lit(0)).alias("seen_before"),
        F.min(F.struct(BLOCK, "first_pos")).over(
            W.partitionBy(*own).orderBy(BLOCK).rowsBetween(W.unboundedPreceding, 0)
        ).alias("first"),
    )
    contenders = rows.join(carried, [*own, BLOCK]).withColumn(
        "contender",
        F.struct(
            (F.col("seen") + F.col("seen_before")).alias("count"),
            (-F.col("first.block")).alias("first_block"),
            (-F.col("first.first_pos")).alias("first_pos"),
            F.col("letters").alias("letters"),
        ),
    )
    before_row = within_block(entity, order).rowsBetween(W.unboundedPreceding, -1)
    best = contenders.groupBy(*entity, BLOCK).agg(F.max("contender").alias("best"), F.count("*").alias("n"))
    best_before = best.select(
        *entity,
        BLOCK,
        F.max("best").over(earlier_blocks(entity)).alias("block_leader"),
        F.coalesce(F.sum("n").over(earlier_blocks(entity)), F.lit(0)).alias("n_before"),
    )
    return (
        contenders.withColumn("row_leader", F.max("contender").over(before_row))
        .join(best_before, [*entity, BLOCK])
        .withColumn("leader", F.greatest("row_leader", "block_leader"))
        .withColumn("n_prior", F.col("pos") - 1 + F.col("n_before"))
        .where(F.col("n_prior") >= config.min_baseline_investigations)
        .select(
            "investigation_id", *entity, "period_start", "period_end", "letters",
            F.col("leader.letters").alias("baseline_letters"),
            F.col("leader.count").alias("baseline_investigation_count"),
            "n_prior",
        )
    )


def deviating(records: DataFrame, config: SequenceConfig = SequenceConfig()) -> DataFrame:
    """IF-DEV-002: investigations whose sequence is far from the running baseline."""
    limit = float(config.deviation_threshold)
    distance, support = F.col("normalized_distance"), F.col("baseline_investigation_count")
    hits = (
        running_baseline(records, config)
        .withColumn("normalized_distance", edit_distance_ratio("letters", "baseline_letters"))
        .where(distance >= F.lit(limit))
    )
    return hits.select(
        F.concat(F.lit("IF-DEV-002:"), "investigation_id").alias("finding_key"),
        "entity_id", "investigation_id", "period_start", "period_end",
        "letters", "baseline_letters",
        action_names("letters").alias("observed_sequence"),
        action_names("baseline_letters").alias("baseline_sequence"),
        "normalized_distance", "baseline_investigation_count",
        F.when((distance >= F.lit(limit + 0.20)) & (support >= 6), "HIGH")
        .when(support >= 3, "MODERATE")
        .otherwise("LOW")
        .alias("confidence"),
        F.format_string(
            "Investigation %s of entity %s differs from the entity's usual action sequence by %.2f "
            "(usual sequence seen %d times before). This describes records and states no cause.",
            "investigation_id", "entity_id", distance, support,
        ).alias("summary"),
    )


def incomplete(records: DataFrame, config: SequenceConfig = SequenceConfig()) -> DataFrame:
    """IF-MEA-003: closed investigations of severe alerts without any expected action."""
    letters = letters_of(config.expected_actions)
    missing = sorted(config.expected_actions)
    n = F.col("action_count")
    hits = records.where(
        (F.col("status") == "CLOSED")
        & severity_at_least("alert_severity", config.missing_action_min_severity)
        & ~F.col("letters").rlike(f"[{letters}]")
    )
    return hits.select(
        F.concat(F.lit("IF-MEA-003:"), "investigation_id").alias("finding_key"),
        "entity_id", "investigation_id", "alert_id", "period_start", "period_end",
        "letters",
        action_names("letters").alias("observed_sequence"),
        F.array(*[F.lit(a) for a in missing]).alias("missing_action_types"),
        "alert_severity", "action_count",
        F.when(n >= 6, "HIGH").when(n >= 3, "MODERATE").otherwise("LOW").alias("confidence"),
        F.format_string(
            f"Closed investigation %s of a %s alert records none of: {', '.join(missing)}. "
            "Other records may hold context that the action log does not.",
            "investigation_id", "alert_severity",
        ).alias("summary"),
    )
