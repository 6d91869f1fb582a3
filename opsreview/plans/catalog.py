"""Named queries over the test tables: name -> function of (session, folder)."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsreview import vocab as V
from opsreview.config import (
    AssessmentConfig,
    DivergenceConfig,
    ExecutionGapConfig,
    NegativeSpaceConfig,
    PeerConfig,
)
from opsreview.functions.expr import action_names, period_label
from opsreview.operators import (
    audit,
    entities,
    evaluate,
    evidence,
    execution_gap,
    findings,
    forest,
    negative_space,
    peers,
    queue,
    sequences,
    trend,
    validate,
)
from opsreview.operators.rollups import latest_metrics, period_features
from opsreview.plans.assessment import assess
from opsreview.schemas import DATASETS
from opsreview.session import run_folder, write_each, write_through
from opsreview.sources import demo, files
from opsreview.sources.queue_store import QueueStore
from opsreview.sources.store import Store
from opsreview.sources.tables import Tables
from opsreview.streaming import telemetry

Query = Callable[[SparkSession, str], DataFrame]

#: The test tables have daily telemetry and no strong KPI trends, so two limits are lower.
CONFIG = AssessmentConfig(
    negative_space=NegativeSpaceConfig(telemetry_gap_threshold_hours=24.0),
    divergence=DivergenceConfig(headline_min_improvement=0.05, quality_min_deterioration=0.05),
)
YESTERDAY, TODAY = datetime(2024, 2, 1), datetime(2024, 2, 2)

QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _ts(col: str) -> Column:
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss").alias(col)


def _r(col: str) -> Column:
    return F.round(col, 6).alias(col)


def _label() -> Column:
    return period_label("period_start").alias("period_label")


def _joined(array: str, sep: str = "|") -> Column:
    return F.array_join(array, sep)


def _with_stored_kpis(spark: SparkSession, folder: str) -> Tables:
    """The test tables with the derived KPI table written once, for queries that read
    it several times."""
    return _kpis_stored(demo.load(spark, folder))


def _kpis_stored(tables: Tables) -> Tables:
    return tables.replace(performance_metrics=write_through(latest_metrics(tables.performance_metrics), "kpis"))


# --- Rollups -------------------------------------------------------------------------


@query
def kpi_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return demo.load(spark, folder).performance_metrics.select("entity_id", _label(), *V.KPI_NAMES)


@query
def period_features_table(spark: SparkSession, folder: str) -> DataFrame:
    features = period_features(demo.load(spark, folder))
    return features.select("entity_id", _label(), *[_r(f) for f in (*V.MODEL_FEATURES, *V.CONTEXT_FEATURES)])


QUERIES["period_features"] = QUERIES.pop("period_features_table")


# --- Execution gap, negative space -------------------------------------------------------


@query
def eg001_unescalated(spark: SparkSession, folder: str) -> DataFrame:
    found = execution_gap.unescalated_alerts(demo.load(spark, folder), CONFIG.execution_gap)
    return found.select("finding_key", "entity_id", "asset_id", "alert_id", "investigation_id", "alert_severity", _ts("observed_at"))


@query
def eg002_uninvestigated(spark: SparkSession, folder: str) -> DataFrame:
    found = execution_gap.uninvestigated_alerts(demo.load(spark, folder), CONFIG.execution_gap)
    return found.select("finding_key", "entity_id", "asset_id", "alert_id", "alert_severity", _ts("window_start"), _ts("window_end"))


@query
def eg003_unremediated(spark: SparkSession, folder: str) -> DataFrame:
    found = execution_gap.unremediated_recurrences(demo.load(spark, folder), CONFIG.execution_gap)
    return found.select("finding_key", "entity_id", "recurrence_key", "n_related_alerts", "asset_id", "alert_severity", _ts("window_start"), _ts("window_end"))


@query
def eg003_members(spark: SparkSession, folder: str) -> DataFrame:
    tables = demo.load(spark, folder)
    found = execution_gap.unremediated_recurrences(tables, ExecutionGapConfig())
    return execution_gap.recurrence_members(tables, found).select("finding_key", "alert_id")


@query
def ns001_silent_assets(spark: SparkSession, folder: str) -> DataFrame:
    found = negative_space.silent_assets(demo.load(spark, folder), CONFIG.negative_space)
    return found.select("finding_key", "entity_id", "asset_id", "asset_criticality", "expected_telemetry")


@query
def ns002_vanished_telemetry(spark: SparkSession, folder: str) -> DataFrame:
    found = negative_space.vanished_telemetry(demo.load(spark, folder), CONFIG.negative_space)
    return found.select("finding_key", "entity_id", "asset_id", "baseline_observation_count", _ts("last_evidence_at"), "silence_hours")


@query
def ns002_members(spark: SparkSession, folder: str) -> DataFrame:
    tables = demo.load(spark, folder)
    found = negative_space.vanished_telemetry(tables, CONFIG.negative_space)
    return negative_space.telemetry_members(tables, found).select("finding_key", "telemetry_id")


# --- Peers, trends -----------------------------------------------------------------------


@query
def pb001_peer_deviation(spark: SparkSession, folder: str) -> DataFrame:
    return peers.detect(demo.load(spark, folder), CONFIG.peers).select(
        "finding_key", "entity_id", "peer_group", "metric_name", "entity_value", _r("peer_baseline"),
        "peer_population_count", _r("deviation_measure"), "deviation_basis", "direction",
    )


@query
def pb001_peer_status(spark: SparkSession, folder: str) -> DataFrame:
    status = peers.peer_status(_with_stored_kpis(spark, folder), PeerConfig(peer_dimension="sector", peer_min_count=5))
    return status.select("status", "entity_id", _label(), "peer_group", "peer_population_count")


@query
def trend_scores(spark: SparkSession, folder: str) -> DataFrame:
    return trend.trend_scores(demo.load(spark, folder)).select("entity_id", "metric_name", "metric_group", "n", _r("trend_score"))


@query
def mrd001_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return trend.detect(_with_stored_kpis(spark, folder), CONFIG.divergence).select(
        "finding_key", "entity_id", "supporting_period_count", _r("headline_trend_score"),
        _r("quality_trend_score"), "confidence", _ts("window_end"),
    )


@query
def mrd001_skipped(spark: SparkSession, folder: str) -> DataFrame:
    return trend.skipped_entities(_with_stored_kpis(spark, folder), DivergenceConfig(min_observation_periods=28))


@query
def metric_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    return trend.snapshots(demo.load(spark, folder)).drop("period_start")


# --- Sequences ---------------------------------------------------------------------------


def _records(spark: SparkSession, folder: str) -> DataFrame:
    return sequences.investigation_records(demo.load(spark, folder), CONFIG.sequences)


@query
def action_sequences(spark: SparkSession, folder: str) -> DataFrame:
    built = sequences.action_sequences(demo.load(spark, folder).investigation_actions)
    return built.select("investigation_id", _joined(action_names("letters")).alias("sequence"), "action_count", "has_duplicate_numbers")


@query
def investigation_records(spark: SparkSession, folder: str) -> DataFrame:
    return _records(spark, folder).select(
        "investigation_id", "entity_id", "alert_id", "status", "alert_severity", _label(), "letters", "action_count"
    )


@query
def sequence_counts(spark: SparkSession, folder: str) -> DataFrame:
    return sequences.sequence_counts(_records(spark, folder)).select(
        "entity_id", _label(), _joined(action_names("letters")).alias("sequence"), "matching", "first_seen"
    )


@query
def if_rep001_repetitive(spark: SparkSession, folder: str) -> DataFrame:
    return sequences.repetitive(_records(spark, folder)).select(
        "finding_key", "entity_id", _joined("dominant_sequence").alias("sequence"),
        "matching_investigation_count", "window_investigation_count", _r("repetition_rate"), "confidence",
    )


@query
def if_rep001_members(spark: SparkSession, folder: str) -> DataFrame:
    records = _records(spark, folder)
    found = sequences.repetitive(records)
    return sequences.repetition_members(records, found).select("finding_key", "investigation_id")


@query
def running_baseline(spark: SparkSession, folder: str) -> DataFrame:
    return sequences.running_baseline(_records(spark, folder)).select(
        "investigation_id", "entity_id", "letters", "baseline_letters", "baseline_investigation_count", "n_prior"
    )


@query
def if_dev002_deviation(spark: SparkSession, folder: str) -> DataFrame:
    return sequences.deviating(_records(spark, folder)).select(
        "finding_key", "entity_id", _joined("observed_sequence").alias("observed_sequence"),
        _joined("baseline_sequence").alias("baseline_sequence"), "baseline_investigation_count",
        _r("normalized_distance"), "confidence",
    )


@query
def if_mea003_missing_action(spark: SparkSession, folder: str) -> DataFrame:
    return sequences.incomplete(_records(spark, folder)).select(
        "finding_key", "entity_id", "alert_id", "alert_severity",
        _joined("observed_sequence").alias("observed_sequence"), "action_count", "confidence",
    )


# --- Anomalies ---------------------------------------------------------------------------


@query
def an001_status(spark: SparkSession, folder: str) -> DataFrame:
    return forest.status(forest.model_rows(demo.load(spark, folder)))


@query
def an001_notable_features(spark: SparkSession, folder: str) -> DataFrame:
    notable = forest.notable_features(forest.model_rows(demo.load(spark, folder)))
    return notable.select("entity_id", _label(), F.posexplode("notable_features").alias("at", "f")).select(
        "entity_id", "period_label", (F.col("at") + 1).cast("bigint").alias("place"), F.col("f.name").alias("feature"),
        F.round("f.value", 6).alias("value"), F.round("f.population_median", 6).alias("population_median"),
    )


@query
def an001_isolation_forest(spark: SparkSession, folder: str) -> DataFrame:
    found = forest.detect(forest.model_rows(demo.load(spark, folder)), CONFIG.anomaly)
    return found.select(
        "finding_key", "entity_id", _label(), "decision", _r("raw_anomaly_score"), _r("normalized_anomaly_score"),
        _joined(F.transform("notable_features", lambda f: f["name"])).alias("notable"),
    )


# --- Findings and evidence -------------------------------------------------------------------


def _detected(spark: SparkSession, folder: str) -> tuple[Tables, DataFrame, dict[str, DataFrame]]:
    """Everything but the forest, whose random splits have no SQL counterpart."""
    tables = _kpis_stored(demo.load(spark, folder, stored=True))
    records = sequences.investigation_records(tables, CONFIG.sequences)
    return tables, records, {
        "execution_gap": execution_gap.detect(tables, CONFIG.execution_gap),
        "negative_space": negative_space.detect(tables, CONFIG.negative_space),
        "peers": peers.detect(tables, CONFIG.peers),
        "divergence": trend.detect(tables, CONFIG.divergence),
        "repetitive": sequences.repetitive(records, CONFIG.sequences),
        "deviating": sequences.deviating(records, CONFIG.sequences),
        "incomplete": sequences.incomplete(records, CONFIG.sequences),
    }


def _findings(spark: SparkSession, folder: str) -> DataFrame:
    return findings.unified(_detected(spark, folder)[2])


@query
def findings_all(spark: SparkSession, folder: str) -> DataFrame:
    return _findings(spark, folder).select(
        "finding_key", "analytic_id", "finding_type", "category", "entity_id", "period_label", "alert_severity",
        "confidence", _joined("confidence_factors", ",").alias("confidence_factors"), "evidence_count",
    )


QUERIES["findings"] = QUERIES.pop("findings_all")


@query
def findings_of_category(spark: SparkSession, folder: str) -> DataFrame:
    chosen = findings.select_findings(_findings(spark, folder), entity_id="ENT-07", category="EXECUTION_GAP")
    return chosen.select("finding_key", "analytic_id", "entity_id", "period_label", "confidence")


@query
def findings_page(spark: SparkSession, folder: str) -> DataFrame:
    return findings.page(_findings(spark, folder), limit=50, offset=100).select(
        "finding_key", "analytic_id", "finding_type", "entity_id", "period_label"
    )


@query
def findings_after(spark: SparkSession, folder: str) -> DataFrame:
    """The page behind the first key of the newest month's workflow findings."""
    found = write_through(_findings(spark, folder), "findings")
    newest = found.where("analytic_id = 'IF-DEV-002'").agg(F.max("period_label")).first()[0]
    chosen = findings.select_findings(found, analytic_id="IF-DEV-002", period=newest)
    first = chosen.agg(F.min("finding_key")).first()[0]
    return findings.page(chosen, limit=50, after=first).select("finding_key", "entity_id", "period_label")


@query
def finding_one(spark: SparkSession, folder: str) -> DataFrame:
    found = write_through(_findings(spark, folder), "findings")
    key = found.where("analytic_id = 'EG-001'").agg(F.min("finding_key")).first()[0]
    return findings.one(found, key or "").select("finding_key", "analytic_id", "entity_id", "evidence_count")


@query
def findings_by_category(spark: SparkSession, folder: str) -> DataFrame:
    return findings.count_by(_findings(spark, folder), "category", V.FINDING_CATEGORIES)


@query
def evidence_refs(spark: SparkSession, folder: str) -> DataFrame:
    tables, records, detected = _detected(spark, folder)
    return evidence.all_refs(tables, write_each(detected), records, CONFIG.sequences).drop("reason")


@query
def evidence_unsupported(spark: SparkSession, folder: str) -> DataFrame:
    tables, records, detected = _detected(spark, folder)
    refs = evidence.all_refs(tables, write_each(detected), records, CONFIG.sequences)
    return evidence.unsupported_refs(tables, refs).select("finding_key", "source_type", "source_id")


@query
def evidence_planted(spark: SparkSession, folder: str) -> DataFrame:
    """The same check where alerts of EG-001, assets of EG-002 and investigations of IF-REP-001 are replaced by ones that do not exist."""
    tables, records, detected = _detected(spark, folder)
    refs = evidence.all_refs(tables, write_each(detected), records, CONFIG.sequences)
    pair = F.concat_ws(" ", "analytic_id", "source_type")
    gone = pair.isin("EG-001 ALERT", "EG-002 ASSET", "IF-REP-001 INVESTIGATION")
    refs = refs.withColumn("source_id", F.when(gone, F.concat("source_id", F.lit("-gone"))).otherwise(F.col("source_id")))
    return evidence.unsupported_refs(tables, refs).select("finding_key", "source_type", "source_id").distinct()


@query
def findings_hash(spark: SparkSession, folder: str) -> DataFrame:
    """The same findings hashed as they come, and again from other partitions in two parts."""
    columns = ("finding_key", "analytic_id", "entity_id", "period_label", "confidence", "evidence_count")
    found = write_through(_findings(spark, folder).select(*columns), "findings")
    dealt = found.repartition(7, "entity_id")
    parts = [findings.multiset_hash(dealt.where(f"evidence_count {sign} 3"), *columns) for sign in ("<=", ">")]
    merged = parts[0].unionByName(parts[1]).agg(
        F.sum("n_rows").alias("n_rows"), F.sum(F.col("sum_hash").cast("decimal(38,0)")).cast("string").alias("sum_hash"), F.bit_xor("xor_hash").alias("xor_hash")
    )
    whole = findings.multiset_hash(found, *columns)
    return whole.select(F.lit("whole").alias("way"), "*").unionByName(merged.select(F.lit("parts").alias("way"), "*"))


# --- Review queue --------------------------------------------------------------------------


def _items(spark: SparkSession, folder: str) -> DataFrame:
    return write_through(queue.items(_findings(spark, folder)), "queue-items")


def _yesterday(items: DataFrame) -> DataFrame:
    """A queue as an earlier run and its reviewers could have left it: no deviation
    items yet, recurrences in another version, decisions by type and priority."""
    then = items.where("analytic_id <> 'IF-DEV-002'").withColumn(
        "finding_version",
        F.when(F.col("finding_type") == "RECURRING_CONFIRMED_ALERTS_NO_REMEDIATION", "previous").otherwise(F.col("finding_version")),
    )
    status = (
        F.when(F.col("finding_type") == "MISSING_EXPECTED_ACTION", "REVIEWED")
        .when(F.col("priority") == "CRITICAL", "IN_REVIEW")
        .when(F.col("priority") == "LOW", "DISMISSED")
        .otherwise("OPEN")
    )
    return (
        then.withColumn("status", status)
        .withColumn("created_at", F.lit(YESTERDAY))
        .withColumn("updated_at", F.lit(YESTERDAY))
        .withColumn("reviewed_at", F.when(F.col("status").isin("REVIEWED", "DISMISSED"), F.lit(YESTERDAY)))
        .withColumn("reviewer_ref", F.when(F.col("status") != "OPEN", "reviewer"))
        .withColumn("review_note", F.lit(None).cast("string"))
    )


def _merged(spark: SparkSession, folder: str) -> DataFrame:
    items = _items(spark, folder)
    return queue.merge(_yesterday(items), items.where("analytic_id <> 'PB-001'"), TODAY)


@query
def queue_items(spark: SparkSession, folder: str) -> DataFrame:
    return queue.items(_findings(spark, folder))


@query
def queue_merge(spark: SparkSession, folder: str) -> DataFrame:
    return _merged(spark, folder).select(
        "queue_id", "finding_key", "outcome", "status", "finding_version", _ts("created_at"), _ts("updated_at"), "reviewer_ref"
    )


def _requests(old: DataFrame) -> DataFrame:
    wanted = F.when(F.col("confidence") == "LOW", "DISMISSED").when(F.col("confidence") == "MODERATE", "IN_REVIEW").otherwise("OPEN")
    asked = old.select("queue_id", wanted.alias("new_status"))
    unknown = old.select(F.concat(F.lit("unknown-"), "finding_type").alias("queue_id"), F.lit("OPEN").alias("new_status")).distinct()
    return asked.unionByName(unknown).select(
        "*", F.lit("second").alias("reviewer_ref"), F.lit("seen").alias("review_note"), F.lit(1).alias("request_no")
    )


def _judged(old: DataFrame) -> DataFrame:
    return queue.judge_moves(old, _requests(old))


@query
def queue_transitions(spark: SparkSession, folder: str) -> DataFrame:
    return _judged(_yesterday(_items(spark, folder))).select("queue_id", "new_status", "result")


@query
def queue_after_transitions(spark: SparkSession, folder: str) -> DataFrame:
    old = _yesterday(_items(spark, folder))
    return queue.apply_moves(old, _judged(old), TODAY).select("queue_id", "status", "reviewer_ref", _ts("updated_at"))


def _stored_queue(spark: SparkSession, folder: str) -> tuple[QueueStore, DataFrame]:
    """A stored queue after yesterday's state and today's items, which come one analytic after the other."""
    items = _items(spark, folder)
    store = QueueStore(spark, f"{run_folder(spark)}/queue-{uuid.uuid4().hex}", buckets=8)
    store.put(_yesterday(items))
    for chosen in ("analytic_id IN ('EG-001', 'EG-002', 'EG-003')", "analytic_id NOT IN ('EG-001', 'EG-002', 'EG-003', 'PB-001')"):
        store.merge(items.where(chosen), TODAY)
    return store, items


@query
def queue_stored(spark: SparkSession, folder: str) -> DataFrame:
    return _stored_queue(spark, folder)[0].load().select(
        "queue_id", "finding_key", "status", "finding_version", _ts("created_at"), _ts("updated_at"), "reviewer_ref"
    )


@query
def queue_stored_moves(spark: SparkSession, folder: str) -> DataFrame:
    """Moves applied to the stored queue; the version before them is still there."""
    store, items = _stored_queue(spark, folder)
    store.put(_yesterday(items))
    requests = _requests(_yesterday(items))
    store.move(requests, TODAY)
    before = store.load(store.version() - 1).select("queue_id", F.col("status").alias("status_before"))
    return store.load().join(before, "queue_id").select("queue_id", "status_before", "status", "reviewer_ref", _ts("updated_at"))


@query
def queue_summary(spark: SparkSession, folder: str) -> DataFrame:
    return queue.summary(_merged(spark, folder))


@query
def queue_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    return queue.outcomes(_merged(spark, folder))


@query
def queue_one(spark: SparkSession, folder: str) -> DataFrame:
    merged = write_through(_merged(spark, folder), "queue")
    first = merged.where("priority = 'HIGH'").agg(F.min("queue_id")).first()[0]
    return queue.one(merged, first or "").select("queue_id", "finding_key", "priority", "status")


@query
def queue_page(spark: SparkSession, folder: str) -> DataFrame:
    chosen = queue.select_items(_merged(spark, folder), status="OPEN")
    return queue.page(chosen, limit=50, offset=25).select("queue_id", "finding_key", "priority", "status")


@query
def queue_pages(spark: SparkSession, folder: str) -> DataFrame:
    """A deep page with the total, and the page that follows its last item."""
    pages = queue.pages(_merged(spark, folder))
    deep = write_through(pages.page(40, offset=pages.total // 2).select("*", F.lit("deep").alias("page")), "queue-page")
    last = deep.orderBy("urgency", "created_at", F.col("queue_id").desc()).first()
    following = pages.after(last.asDict(), 40).select("*", F.lit("next").alias("page")) if last else deep
    return deep.unionByName(following).select("page", "queue_id", "finding_key", "priority", "status", "total")


@query
def findings_pages(spark: SparkSession, folder: str) -> DataFrame:
    pages = findings.pages(_findings(spark, folder).select("finding_key", "analytic_id", "entity_id"))
    return pages.page(50, offset=max(0, pages.total - 75))


@query
def queue_of_entity(spark: SparkSession, folder: str) -> DataFrame:
    chosen = queue.select_items(_merged(spark, folder), priority="low", entity_id="ENT-03", category="WORKFLOW_PATTERN")
    return chosen.select("queue_id", "finding_key", "priority", "status")


# --- Ingestion -------------------------------------------------------------------------------


def raw_alerts(spark: SparkSession, folder: str) -> DataFrame:
    """Orders spelled as uploaded alert rows, with faults wherever an order's own
    attributes do not fit the alert dataset."""
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    key, price, status = F.col("o_orderkey").cast("string"), F.col("o_totalprice"), F.col("o_orderstatus")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return orders.select(
        (F.col("o_orderkey") + 1).alias("_row"),
        F.when(price > 480000.0, F.concat(F.lit("ALR-"), F.col("o_custkey").cast("string")))
        .when(price < 4000.0, F.concat(F.lit("ALERT/"), key))
        .otherwise(F.concat(F.lit("ALR-"), key)).alias("alert_id"),
        F.when(price < 8000.0, "ENT-99").when(price > 495000.0, " ").otherwise("ENT-07").alias("entity_id"),
        F.concat(F.lit("AST-"), F.lpad(F.col("o_custkey").cast("string"), 8, "0")).alias("asset_id"),
        F.concat(F.lit(" "), F.lower(F.regexp_extract("o_orderpriority", "-(.*)$", 1)), F.lit("\t")).alias("severity"),
        F.when(status == "F", "Malware").when(status == "O", "").otherwise("PHISHING").alias("category"),
        F.lit("ENDPOINT").alias("detection_source"),
        F.when(status == "F", "closed").when(status == "O", "ACKNOWLEDGED").otherwise("In_Investigation").alias("status"),
        F.when(price > 490000.0, "yesterday").when(status == "F", F.concat(day, F.lit("T10:00:00Z")))
        .when(status == "O", F.concat(day, F.lit(" 10:00"))).otherwise(F.concat(day, F.lit("T12:00:00.250+02:00"))).alias("created_at"),
        F.when(price < 20000.0, F.concat(day, F.lit("T09:59:59z"))).when(price < 300000.0, F.concat(day, F.lit("T10:00:00.5Z"))).alias("acknowledged_at"),
        F.when(price >= 100000.0, "yes").when(price >= 50000.0, "N").when(price >= 40000.0, "maybe").otherwise("").alias("is_true_positive"),
    )


def raw_telemetry(spark: SparkSession, folder: str) -> DataFrame:
    """Events spelled as uploaded telemetry rows in various number formats."""
    events = spark.read.parquet(f"{folder}/events.parquet")
    kind, k = F.col("event_type"), F.regexp_extract("props", "[0-9]+", 0)
    start = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return events.select(
        (F.col("event_id") + 1).alias("_row"),
        F.concat(F.lit("TLM-"), F.col("event_id").cast("string")).alias("telemetry_id"),
        F.lit("ENT-01").alias("entity_id"),
        F.concat(F.lit("AST-"), F.lpad(F.col("user_id").cast("string"), 8, "0")).alias("asset_id"),
        start.alias("period_start"),
        start.alias("period_end"),
        F.lit("DNS").alias("category"),
        F.when(kind == "click", F.concat(k, F.lit(".0"))).when(kind == "view", F.concat(k, F.lit(".5")))
        .when(kind == "error", F.concat(F.lit("-1"), k)).when(kind == "signup", "n/a").otherwise(F.concat(k, F.lit("e2"))).alias("event_count"),
        F.when(kind == "click", "NaN").when(kind == "view", F.concat(F.lit("-"), F.lit("0.5"))).when(kind == "error", "inf")
        .otherwise(F.col("value").cast("decimal(12,2)").cast("string")).alias("activity_level"),
        F.lit("HEALTHY").alias("source_status"),
        F.when(kind == "view", "T").when(kind == "click", "0").when(kind == "error", "oui").otherwise("TRUE").alias("expected"),
    )


def _typed(rows: DataFrame, dataset_type: str) -> DataFrame:
    return write_through(validate.check_cells(rows, DATASETS[dataset_type]), "typed-rows")


def _stored_alerts(tables: Tables) -> DataFrame:
    """Some alerts as if they were stored already."""
    return tables.alerts.where("status = 'IN_INVESTIGATION'").withColumn(
        "alert_id", F.regexp_replace("alert_id", "^ALR-0*(?=[0-9])", "ALR-")
    )


def _alert_issues(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    tables = demo.load(spark, folder)
    typed = _typed(raw_alerts(spark, folder), "alerts")
    references = {"entities": tables.entities, "assets": tables.assets}
    return typed, validate.row_issues(typed, DATASETS["alerts"], references, _stored_alerts(tables))


@query
def ingest_alert_issues(spark: SparkSession, folder: str) -> DataFrame:
    return _alert_issues(spark, folder)[1].select("row", "field", "code", "severity")


def _uploaded(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """Problems of the raw alerts after a round through an uploaded file in the shared folder."""
    path = f"{run_folder(spark)}/upload-{uuid.uuid4().hex}/alerts.{suffix}"
    ordered = raw_alerts(spark, folder).orderBy("_row").drop("_row")
    if suffix == "csv":
        ordered.write.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    else:
        ordered.write.json(path)
    batch = files.read_batch(spark, "alerts", path)
    typed = write_through(validate.check_cells(batch.rows, DATASETS["alerts"]), "typed-rows")
    tables = demo.load(spark, folder)
    references = {"entities": tables.entities, "assets": tables.assets}
    return validate.row_issues(typed, DATASETS["alerts"], references, _stored_alerts(tables))


@query
def ingest_csv_file(spark: SparkSession, folder: str) -> DataFrame:
    return _uploaded(spark, folder, "csv").select("row", "field", "code", "severity")


@query
def ingest_json_lines_file(spark: SparkSession, folder: str) -> DataFrame:
    return _uploaded(spark, folder, "jsonl").select("row", "field", "code", "severity")


@query
def ingest_spanning_csv(spark: SparkSession, folder: str) -> DataFrame:
    """An upload whose texts hold line breaks, quotes and commas, read by many tasks."""
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    key = F.concat(F.lit('key "'), F.col("o_custkey").cast("string"), F.lit('",\n\nof '), F.col("o_orderpriority"), F.lit("\n."))
    keys = orders.select((F.col("o_orderkey") + 1).alias("_row"), F.when(F.col("o_totalprice") >= 200000.0, key).alias("recurrence_key"))
    path = f"{run_folder(spark)}/upload-{uuid.uuid4().hex}/alerts.csv"
    raw_alerts(spark, folder).join(keys, "_row").orderBy("_row").drop("_row").write.options(header=True, escape='"').csv(path)
    typed = write_through(validate.check_cells(files.read_batch(spark, "alerts", path).rows, DATASETS["alerts"]), "typed-rows")
    return typed.select(F.col("_row").alias("row"), "severity", "recurrence_key")


def _documents(lines: DataFrame, opening: str, closing: str, path: str) -> None:
    """Write rows of JSON as one document per partition."""

    def written(batches):
        first = True
        for batch in batches:
            text = "," + batch["value"]
            if first and len(text):
                text.iloc[0] = opening + text.iloc[0][1:]
                first = False
            yield text.to_frame()
        yield pd.DataFrame({"value": [opening + closing if first else closing]})

    lines.mapInPandas(written, "value string").write.option("lineSep", " ").text(path)


@query
def ingest_json_document(spark: SparkSession, folder: str) -> DataFrame:
    """Problems of the raw alerts uploaded as JSON documents of both forms."""
    tables = demo.load(spark, folder)
    references = {"entities": tables.entities, "assets": tables.assets}
    ordered = raw_alerts(spark, folder).orderBy("_row").drop("_row")
    lines = ordered.select(F.to_json(F.struct("*")).alias("value"))
    found = None
    for form, opening, closing in (("list", "[", "]"), ("records", '{"source": {"name": "}{"}, "records": [', '], "end": [{}]}')):
        path = f"{run_folder(spark)}/upload-{uuid.uuid4().hex}/alerts.json"
        _documents(lines, opening, closing, path)
        typed = write_through(validate.check_cells(files.read_batch(spark, "alerts", path).rows, DATASETS["alerts"]), "typed-rows")
        issues = validate.row_issues(typed, DATASETS["alerts"], references, _stored_alerts(tables)).select(F.lit(form).alias("form"), "row", "field", "code", "severity")
        found = issues if found is None else found.unionByName(issues)
    return found


@query
def ingest_structure(spark: SparkSession, folder: str) -> DataFrame:
    """Problems of files as a whole: the raw alerts without some columns and with others, in three formats."""
    wrong = raw_alerts(spark, folder).drop("_row", "severity", "category").withColumn("colour", F.lit("red"))
    base = f"{run_folder(spark)}/upload-{uuid.uuid4().hex}"
    wrong.write.options(header=True, escape='"').csv(f"{base}/alerts.csv")
    wrong.write.json(f"{base}/alerts.jsonl")
    _documents(wrong.select(F.to_json(F.struct("*")).alias("value")), "[", "]", f"{base}/alerts.json")
    found = None
    for suffix in ("csv", "jsonl", "json"):
        issues = validate.validate(spark, files.read_batch(spark, "alerts", f"{base}/alerts.{suffix}")).issues
        own = issues.select(F.lit(suffix).alias("format"), "row", "field", "code", "severity")
        found = own if found is None else found.unionByName(own)
    return found


@query
def ingest_alert_report(spark: SparkSession, folder: str) -> DataFrame:
    issues = _alert_issues(spark, folder)[1]
    return issues.groupBy("code", "severity").agg(
        F.count("*").alias("errors"), F.countDistinct("row").alias("rejected_rows")
    )


@query
def ingest_alert_accepted(spark: SparkSession, folder: str) -> DataFrame:
    typed, issues = _alert_issues(spark, folder)
    bad = issues.select(F.col("row").alias("_row")).distinct()
    return typed.join(bad, "_row", "left_anti").select(
        F.col("_row").alias("row"), "alert_id", "severity", "category", "status", "is_true_positive"
    )


@query
def ingest_telemetry_issues(spark: SparkSession, folder: str) -> DataFrame:
    typed = _typed(raw_telemetry(spark, folder), "telemetry")
    return validate.row_issues(typed, DATASETS["telemetry"]).select("row", "field", "code", "severity")


@query
def ingest_telemetry_values(spark: SparkSession, folder: str) -> DataFrame:
    typed = _typed(raw_telemetry(spark, folder), "telemetry")
    return typed.select(F.col("_row").alias("row"), "event_count", "activity_level", "expected")


# --- Stored datasets ---------------------------------------------------------------------------


def _filled_store(spark: SparkSession, folder: str) -> Store:
    """A store after one load of three datasets at once, two more appends of alerts with joining of parts, and three
    imports that must change nothing."""
    base = f"{run_folder(spark)}/store-{uuid.uuid4().hex}"
    tables = demo.load(spark, folder)
    # A file of alerts for each status, as uploads would bring them.
    uploads = {"entities": tables.entities, "assets": tables.assets}
    files.export(uploads, f"{base}/uploads")
    alerts = write_through(tables.alerts, "alerts")
    for status in V.ALERT_STATUSES:
        files.export({"alerts": alerts.where(F.col("status") == status)}, f"{base}/uploads/{status}")
    files.export({"entities": tables.entities.where("entity_id < 'ENT-03'")}, f"{base}/uploads/few")
    store = Store(spark, f"{base}/store", most_parts=2)
    paths = {n: f"{base}/uploads/{n}.csv" for n in uploads} | {"alerts": f"{base}/uploads/CLOSED/alerts.csv"}
    store.load_all(paths)
    store.load("alerts", f"{base}/uploads/ACKNOWLEDGED/alerts.jsonl")
    store.load("alerts", f"{base}/uploads/IN_INVESTIGATION/alerts.csv")
    store.load("alerts", f"{base}/uploads/ACKNOWLEDGED/alerts.csv")  # REJECTED: stored already
    store.load("entities", f"{base}/uploads/few/entities.csv", mode="REPLACE")  # ROLLED_BACK: others refer to the rest
    store.load_all({"entities": paths["entities"], "alerts": paths["alerts"]})  # REJECTED, both
    return store


@query
def store_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return _filled_store(spark, folder).table("alerts").select(
        "alert_id", "entity_id", "asset_id", "severity", "status", _ts("created_at"), _ts("acknowledged_at"), _ts("closed_at"), "recurrence_key", "is_true_positive"
    )


@query
def store_import_log(spark: SparkSession, folder: str) -> DataFrame:
    columns = ("dataset_type", "mode", "status", "row_count", "accepted_count", "rejected_count", "error_count")
    return _filled_store(spark, folder).log().select(*columns)


# --- Streams -----------------------------------------------------------------------------------


@query
def telemetry_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Weeks of telemetry that are closed after all of it has arrived as a stream of files."""
    base = f"{run_folder(spark)}/stream-{uuid.uuid4().hex}"
    struct = DATASETS["telemetry"].struct
    demo.load(spark, folder).telemetry.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in struct]).write.parquet(f"{base}/in")
    settings = telemetry.RollupSettings(window="7 days", late="10 days")
    running = telemetry.start(spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint", settings)
    running.awaitTermination()
    return spark.read.parquet(f"{base}/out").select("entity_id", "asset_id", _ts("window_start"), "records", "event_count", _ts("last_seen"), "silent_records")


# --- Audits and evaluation -----------------------------------------------------------------------


@query
def dataset_audit(spark: SparkSession, folder: str) -> DataFrame:
    return audit.audit(demo.load(spark, folder))


@query
def scenario_evaluation(spark: SparkSession, folder: str) -> DataFrame:
    region = F.col("n_regionkey")
    scenario = (
        F.when(region == 0, "CRITICAL_ALERT_WITHOUT_ESCALATION").when(region == 1, "TELEMETRY_DISAPPEARANCE")
        .when(region == 2, "SUSPICIOUSLY_FAST_INVESTIGATION").when(region == 3, "METRIC_RISK_DIVERGENCE")
        .otherwise("NORMAL_BASELINE")
    )
    planted = spark.read.parquet(f"{folder}/nation.parquet").select(
        scenario.alias("scenario_type"),
        F.concat(F.lit("ENT-"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("entity_id"),
        F.lit(None).cast("string").alias("expected_detection_category"),
    )
    return evaluate.evaluate(planted, _findings(spark, folder))


# --- Whole runs and listings -----------------------------------------------------------------


@query
def assessment_findings(spark: SparkSession, folder: str) -> DataFrame:
    return assess(demo.load(spark, folder, stored=True), CONFIG).findings.select(
        "finding_key", "analytic_id", "finding_type", "category", "entity_id", "period_label", "confidence", "evidence_count"
    )


@query
def assessment_summary(spark: SparkSession, folder: str) -> DataFrame:
    return assess(demo.load(spark, folder, stored=True), CONFIG).summary


def _listed(df: DataFrame) -> DataFrame:
    return df.select(
        "entity_id", "name", "sector", "peer_group", "scale", "asset_count_estimate", "analyst_headcount",
        _ts("data_period_start"), _ts("data_period_end"),
    )


@query
def entity_list(spark: SparkSession, folder: str) -> DataFrame:
    return _listed(entities.page(demo.load(spark, folder).entities, limit=20))


@query
def entity_list_after(spark: SparkSession, folder: str) -> DataFrame:
    return _listed(entities.page(demo.load(spark, folder).entities, limit=20, after="ENT-19"))


@query
def entity_one(spark: SparkSession, folder: str) -> DataFrame:
    return _listed(entities.one(demo.load(spark, folder).entities, "ENT-07"))


@query
def eg001_scoped(spark: SparkSession, folder: str) -> DataFrame:
    """Two entities only, given as a table."""
    ids = spark.createDataFrame([("ENT-03",), ("ENT-11",)], "entity_id string")
    found = execution_gap.unescalated_alerts(demo.load(spark, folder).scoped(ids), CONFIG.execution_gap)
    return found.select("finding_key", "entity_id", "asset_id", "alert_id", "investigation_id", "alert_severity", _ts("observed_at"))
