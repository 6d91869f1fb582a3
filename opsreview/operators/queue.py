"""The review queue: items from findings, merge with earlier decisions, moves, views."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsreview import vocab as V
from opsreview.functions.expr import lookup, rank_in, short_hash, step_level
from opsreview.functions.pages import Pages
from opsreview.sources.snapshots import Snapshots

ITEM = (
    "queue_id", "finding_key", "analytic_id", "finding_type", "entity_id", "period_label", "title",
    "category", "priority", "confidence", "evidence_count", "finding_version",
)
SCHEMA = T.StructType(
    [
        T.StructField(name, T.LongType() if name == "evidence_count" else T.StringType())
        for name in ITEM
    ]
    + [T.StructField("status", T.StringType())]
    + [T.StructField(n, T.TimestampType()) for n in ("created_at", "updated_at", "reviewed_at")]
    + [T.StructField(n, T.StringType()) for n in ("reviewer_ref", "review_note")]
)
MAX_PAGE = 200


def priority_of(
    analytic: Column, kind: Column, severity: Column, confidence: Column, evidence_count: Column
) -> Column:
    """Base priority of the finding type, one step up for a severe alert, one down for
    LOW confidence, one down without evidence; each step stops at the ends."""
    by_analytic = {"AN-001": "HIGH", "PB-001": "MEDIUM", "MRD-001": "HIGH"}
    priority = F.coalesce(lookup(V.BASE_PRIORITY, kind), lookup(by_analytic, analytic), F.lit("MEDIUM"))
    severe = F.coalesce(F.upper(severity).isin("HIGH", "CRITICAL"), F.lit(False))
    weak = F.coalesce(confidence == "LOW", F.lit(False))
    for condition, step in ((severe, 1), (weak, -1), (evidence_count == 0, -1)):
        priority = step_level(V.PRIORITIES, priority, F.when(condition, step).otherwise(0))
    return priority


def title_of(kind: Column, entity: Column) -> Column:
    spelled = F.initcap(F.replace(F.lower(kind), F.lit("_"), F.lit(" ")))
    return F.concat(
        F.coalesce(lookup(V.TITLES, kind), F.concat(F.lit("Potential "), spelled)), F.lit(" — "), entity
    )


def items(findings: DataFrame) -> DataFrame:
    """Queue items of the unified findings."""
    c = F.col
    version = F.concat_ws("|", "finding_key", "analytic_id", "entity_id", "period_label")
    return findings.select(
        short_hash(c("finding_key"), 12).alias("queue_id"),
        "finding_key", "analytic_id", "finding_type", "entity_id", "period_label",
        title_of(c("finding_type"), c("entity_id")).alias("title"),
        "category",
        priority_of(c("analytic_id"), c("finding_type"), c("alert_severity"), c("confidence"), c("evidence_count")).alias("priority"),
        F.coalesce("confidence", F.lit("UNKNOWN")).alias("confidence"),
        "evidence_count",
        short_hash(version, 8).alias("finding_version"),
    )


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def merge(previous: DataFrame, new_items: DataFrame, run_at: datetime | Column) -> DataFrame:
    """The next queue state, plus ``outcome`` per row.

    INSERTED: not seen before, starts OPEN. UNCHANGED: same version, only
    ``updated_at`` moves, decisions stay. UPDATED: version differs, fields are
    refreshed, the item is OPEN again without reviewer data. KEPT: not found this
    time, left as it is. Applying the same findings twice inserts nothing.

    Rows meet by ``finding_key``, which determines ``queue_id``; the short id alone
    would collide once there are tens of millions of findings.
    """
    now = run_at if isinstance(run_at, Column) else F.lit(run_at)
    new = new_items.select(*ITEM).withColumn("is_new", F.lit(True)).alias("new")
    old = previous.withColumn("is_old", F.lit(True)).alias("old")
    joined = old.join(new, F.col("old.finding_key") == F.col("new.finding_key"), "full_outer")
    is_new, is_old = F.col("is_new").isNotNull(), F.col("is_old").isNotNull()
    outcome = (
        F.when(is_new & ~is_old, "INSERTED")
        .when(~is_new, "KEPT")
        .when(F.col("old.finding_version") == F.col("new.finding_version"), "UNCHANGED")
        .otherwise("UPDATED")
    )
    state = joined.withColumn("outcome", outcome)
    fresh = F.col("outcome").isin("INSERTED", "UPDATED")

    def keep_unless_fresh(name: str, value: Column | None = None) -> Column:
        replaced = F.lit(None).cast(SCHEMA[name].dataType) if value is None else value
        return F.when(fresh, replaced).otherwise(F.col(f"old.{name}")).alias(name)

    return state.select(
        *[keep_unless_fresh(name, F.col(f"new.{name}")) for name in ITEM],
        keep_unless_fresh("status", F.lit("OPEN")),
        F.when(F.col("outcome") == "INSERTED", now).otherwise(F.col("old.created_at")).alias("created_at"),
        F.when(F.col("outcome") == "KEPT", F.col("old.updated_at")).otherwise(now).alias("updated_at"),
        *[keep_unless_fresh(name) for name in ("reviewed_at", "reviewer_ref", "review_note")],
        "outcome",
    )


def outcomes(merged: DataFrame) -> DataFrame:
    """Counts ``(outcome, n)`` of one merge, 0 where an outcome does not occur, and the ``TOTAL``."""
    wanted = merged.sparkSession.createDataFrame([(x,) for x in ("INSERTED", "UPDATED", "UNCHANGED", "KEPT", "TOTAL")], "outcome string")
    counts = merged.rollup("outcome").agg(F.count("*").alias("n")).select(F.coalesce("outcome", F.lit("TOTAL")).alias("outcome"), "n")
    return wanted.join(counts, "outcome", "left").na.fill(0, ["n"])


def judge_moves(queue: DataFrame, requests: DataFrame) -> DataFrame:
    """What becomes of each move request ``(queue_id, new_status, reviewer_ref,
    review_note, request_no)``: APPLIED, NOT_FOUND, INVALID_TRANSITION, NOT_FIRST or AMBIGUOUS.

    A batch moves an item once: the request with the lowest number is judged, later
    ones come back as NOT_FIRST for the next batch. A short id that several findings
    share moves none of them and comes back as AMBIGUOUS.
    """
    first = requests.groupBy("queue_id").agg(F.min("request_no").alias("request_no")).withColumn("first", F.lit(True))
    allowed = F.concat_ws(">", "status", "new_status").isin(*[f"{a}>{b}" for a, b in V.ALLOWED_MOVES])
    known = queue.groupBy("queue_id").agg(F.min("status").alias("status"), (F.min("finding_key") != F.max("finding_key")).alias("shared"))
    return (
        requests.join(first, ["queue_id", "request_no"], "left")
        .join(known, "queue_id", "left")
        .withColumn(
            "result",
            F.when(F.col("first").isNull(), "NOT_FIRST")
            .when(F.col("status").isNull(), "NOT_FOUND")
            .when(F.col("shared"), "AMBIGUOUS")
            .when(allowed, "APPLIED")
            .otherwise("INVALID_TRANSITION"),
        )
        .drop("first", "shared")
    )


def apply_moves(queue: DataFrame, judged: DataFrame, run_at: datetime | Column) -> DataFrame:
    """The queue after the APPLIED requests.

    REVIEWED and DISMISSED stamp time, reviewer and note; IN_REVIEW stamps the
    reviewer; OPEN keeps earlier stamps. Missing reviewer or note leaves the old one.
    """
    now = run_at if isinstance(run_at, Column) else F.lit(run_at)
    move = F.struct("request_no", "new_status", F.col("reviewer_ref").alias("by"), F.col("review_note").alias("note"))
    moves = (
        judged.where("result = 'APPLIED'")
        .groupBy("queue_id")
        .agg(F.min(move).alias("move"))
        .select("queue_id", "move.new_status", "move.by", "move.note")
    )
    moved = F.col("new_status").isNotNull()
    decided = F.col("new_status").isin("REVIEWED", "DISMISSED")
    taken = decided | (F.col("new_status") == "IN_REVIEW")
    return (
        queue.join(moves, "queue_id", "left")
        .withColumn("status", F.coalesce("new_status", "status"))
        .withColumn("updated_at", F.when(moved, now).otherwise(F.col("updated_at")))
        .withColumn("reviewed_at", F.when(decided, now).otherwise(F.col("reviewed_at")))
        .withColumn("reviewer_ref", F.when(taken, F.coalesce("by", "reviewer_ref")).otherwise(F.col("reviewer_ref")))
        .withColumn("review_note", F.when(decided, F.coalesce("note", "review_note")).otherwise(F.col("review_note")))
        .select(*queue.columns)
    )


def select_items(
    queue: DataFrame,
    status: str | None = None,
    priority: str | None = None,
    entity_id: str | None = None,
    category: str | None = None,
) -> DataFrame:
    """Items that meet every given filter; unknown levels are refused."""
    for value, levels in ((status, V.REVIEW_STATUSES), (priority, V.PRIORITIES), (category, V.FINDING_CATEGORIES)):
        if value is not None and value.upper() not in levels:
            raise ValueError(f"{value!r} is not one of {levels}")
    wanted = {"status": status, "priority": priority, "category": category}
    for column, value in wanted.items():
        if value is not None:
            queue = queue.where(F.col(column) == value.upper())
    return queue if entity_id is None else queue.where(F.col("entity_id") == entity_id)


def page(queue: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page: most urgent first, then newest. Sorted before it is cut."""
    if not 1 <= limit <= MAX_PAGE:
        raise ValueError(f"limit must be between 1 and {MAX_PAGE}")
    if offset < 0:
        raise ValueError("offset must not be negative")
    urgent = rank_in(V.PRIORITIES, "priority")
    return queue.orderBy(urgent.desc(), F.col("created_at").desc(), "queue_id", "finding_key").offset(offset).limit(limit)


def pages(queue: DataFrame) -> Pages:
    """The queue in its order, to be paged at any depth with its total, or on from an item."""
    return Pages(queue.withColumn("urgency", rank_in(V.PRIORITIES, "priority")), ["-urgency", "-created_at", "queue_id", "finding_key"], "queue-pages")


def one(queue: DataFrame, queue_id: str) -> DataFrame:
    return queue.where(F.col("queue_id") == queue_id)


def summary(queue: DataFrame) -> DataFrame:
    """Counts ``(dimension, level, n)`` by status, priority and category and in total.

    One pass with grouping sets; levels that do not occur show 0.
    """
    vocabularies = {"status": V.REVIEW_STATUSES, "priority": V.PRIORITIES, "category": V.FINDING_CATEGORIES}
    wanted = [(d, level) for d, levels in vocabularies.items() for level in levels] + [("total", "ALL")]
    grid = queue.sparkSession.createDataFrame(wanted, "dimension string, level string")
    c = F.col
    counts = (
        queue.groupingSets([[c("status")], [c("priority")], [c("category")], []], c("status"), c("priority"), c("category"))
        .agg(F.count("*").alias("n"), F.grouping_id().alias("set"))
        .select(
            F.when(c("set") == 3, "status").when(c("set") == 5, "priority").when(c("set") == 6, "category").otherwise("total").alias("dimension"),
            F.coalesce("status", "priority", "category", F.lit("ALL")).alias("level"),
            "n",
        )
    )
    return grid.join(counts, ["dimension", "level"], "left").na.fill(0, ["n"])


# --- Stored versions ------------------------------------------------------------
# Whole states by a version number of the caller's choice; ``sources.queue_store`` keeps a queue that changes in parts.


def save(queue: DataFrame, folder: str, version: int) -> None:
    """Write a queue state as ``<folder>/version=<n>``; refuses to overwrite one. It counts once its
    pointer is published, after all of it is written."""
    queue.select(*SCHEMA.names).write.mode("errorifexists").parquet(f"{folder}/version={version}")
    Snapshots(queue.sparkSession, folder).publish(version, {"path": f"version={version}"})


def load(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """A stored state, by default the newest of those that were written whole."""
    published = Snapshots(spark, folder)
    version = published.newest() if version is None else version
    if version not in published.numbers():
        raise ValueError(f"there is no version {version}")
    return spark.read.schema(SCHEMA).parquet(f"{folder}/{published.read(version)['path']}")
