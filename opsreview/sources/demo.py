"""Views that present order-processing tables as security-operations tables.

The test tables describe nations, customers, orders and line items. Nations play
the organisations, customers the assets, orders the alerts and line items the
investigation actions, so that the analytics run on data of any scale without
generated input. Time stamps carry no zone and stay that way.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from opsreview.operators.rollups import kpi_rollup
from opsreview.session import write_through
from opsreview.sources.tables import Tables


def _padded(prefix: str, col: str | Column, width: int) -> Column:
    return F.concat(F.lit(prefix), F.lpad(F.col(col).cast("string") if isinstance(col, str) else col.cast("string"), width, "0"))


def _month_start(col: Column) -> Column:
    return F.make_date(F.year(col), F.month(col), F.lit(1))


def _minutes(col: Column) -> Column:
    return F.make_dt_interval(mins=col.cast("int"))


def _seconds(col: Column) -> Column:
    return F.make_dt_interval(secs=col.cast("decimal(18,6)"))


class _Demo:
    """The views of one folder. Each is built on first use."""

    def __init__(self, spark: SparkSession, folder: str, stored: bool) -> None:
        self.spark = spark
        self.folder = folder
        self.stored = stored

    def _shared(self, df: DataFrame, label: str) -> DataFrame:
        return write_through(df, label) if self.stored else df

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def orders(self) -> DataFrame:
        return self.raw("orders")

    @cached_property
    def lineitem(self) -> DataFrame:
        return self.raw("lineitem")

    @cached_property
    def customer(self) -> DataFrame:
        return self.raw("customer")

    @cached_property
    def horizon(self) -> Row:
        """First and last month, read once: many tables need them."""
        return self.orders.select(
            _month_start(F.min("o_orderdate")).alias("first"),
            F.add_months(_month_start(F.max("o_orderdate")), 1).alias("last"),
        ).first()

    @property
    def first(self) -> Column:
        return F.lit(self.horizon["first"])

    @property
    def last(self) -> Column:
        return F.lit(self.horizon["last"])

    @cached_property
    def entities(self) -> DataFrame:
        headcount = self.raw("supplier").groupBy("s_nationkey").agg(F.count("*").alias("analyst_headcount"))
        asset_count = self.customer.groupBy("c_nationkey").agg(F.count("*").alias("asset_count_estimate"))
        region = F.col("n_regionkey")
        return (
            self.raw("nation").join(self.raw("region"), region == F.col("r_regionkey"))
            .join(asset_count, F.col("n_nationkey") == F.col("c_nationkey"), "left")
            .join(headcount, F.col("n_nationkey") == F.col("s_nationkey"), "left")
            .select(
                _padded("ENT-", "n_nationkey", 2).alias("entity_id"),
                F.col("n_name").alias("name"),
                F.when(region == 0, "FINANCE").when(region == 1, "HEALTHCARE").when(region == 2, "RETAIL")
                .when(region == 3, "ENERGY").otherwise("TECHNOLOGY").alias("sector"),
                F.col("r_name").alias("peer_group"),
                F.when(region <= 1, "SMALL").when(region <= 3, "MEDIUM").otherwise("LARGE").alias("scale"),
                F.coalesce("asset_count_estimate", F.lit(0)).alias("asset_count_estimate"),
                F.coalesce("analyst_headcount", F.lit(0)).alias("analyst_headcount"),
                self.first.cast("timestamp_ntz").alias("created_at"),
                self.first.cast("timestamp_ntz").alias("data_period_start"),
                self.last.cast("timestamp_ntz").alias("data_period_end"),
            )
        )

    @cached_property
    def assets(self) -> DataFrame:
        segment = F.col("c_mktsegment")
        expected = F.col("c_acctbal") > 0
        return self.customer.select(
            _padded("AST-", "c_custkey", 8).alias("asset_id"),
            _padded("ENT-", "c_nationkey", 2).alias("entity_id"),
            F.col("c_name").alias("name"),
            F.when(segment == "AUTOMOBILE", "SERVER").when(segment == "MACHINERY", "DATABASE")
            .when(segment == "BUILDING", "APPLICATION").otherwise("WORKSTATION").alias("category"),
            F.when(segment == "AUTOMOBILE", "CRITICAL").when(segment == "MACHINERY", "HIGH")
            .when(segment == "BUILDING", "MEDIUM").otherwise("LOW").alias("criticality"),
            expected.alias("monitoring_expected"),
            F.when(expected, "NETWORK_FLOW").alias("expected_telemetry"),
            self.first.cast("timestamp_ntz").alias("created_at"),
        )

    @cached_property
    def _orders_as_alerts(self) -> DataFrame:
        priority, status, price = F.col("o_orderpriority"), F.col("o_orderstatus"), F.col("o_totalprice")
        alerts = self.orders.join(
            self.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")
        ).select(
            "o_orderkey",
            "o_totalprice",
            _padded("ALR-", "o_orderkey", 10).alias("alert_id"),
            _padded("ENT-", "c_nationkey", 2).alias("entity_id"),
            _padded("AST-", "o_custkey", 8).alias("asset_id"),
            F.when(priority == "1-URGENT", "CRITICAL").when(priority == "2-HIGH", "HIGH")
            .when(priority == "3-MEDIUM", "MEDIUM").otherwise("LOW").alias("severity"),
            F.when(status == "F", "MALWARE").when(status == "O", "PHISHING")
            .otherwise("POLICY_VIOLATION").alias("category"),
            F.lit("ENDPOINT").alias("detection_source"),
            F.when(status == "F", "CLOSED").when(status == "O", "ACKNOWLEDGED")
            .otherwise("IN_INVESTIGATION").alias("status"),
            F.col("o_orderdate").alias("created_at"),
            (F.col("o_orderdate") + _minutes(F.floor(price / 1000.0))).alias("acknowledged_at"),
            F.when(status == "F", F.col("o_orderdate") + F.make_dt_interval(days=F.lit(2))).alias("closed_at"),
            F.when(price >= 200000.0, F.concat(F.lit("RK-"), F.col("o_custkey").cast("string"))).alias("recurrence_key"),
            F.when(status == "F", price >= 100000.0).alias("is_true_positive"),
        )
        return self._shared(alerts, "order-alerts")

    def alerts(self) -> DataFrame:
        return self._orders_as_alerts.drop("o_orderkey", "o_totalprice")

    @cached_property
    def lines(self) -> DataFrame:
        """One row per order with what its lines say. Written once: investigations,
        actions, escalations and remediations all start from it."""
        remedied = (F.col("l_returnflag") == "A") & (F.col("l_discount") >= 0.08)
        return write_through(
            self.lineitem.groupBy("l_orderkey").agg(
                F.count("*").alias("n_lines"),
                F.max("l_linenumber").alias("last_line"),
                F.min("l_suppkey").alias("lead"),
                F.min("l_shipdate").alias("first_ship"),
                F.max("l_shipdate").alias("last_ship"),
                F.bool_or(F.col("l_discount") >= 0.07).alias("investigated"),
                F.bool_or(F.col("l_quantity") >= 40.0).alias("escalated"),
                F.bool_or((F.col("l_quantity") >= 40.0) & (F.col("l_returnflag") == "R")).alias("escalated_alert"),
                F.bool_or(remedied).alias("remedied"),
                F.bool_or(remedied & (F.col("l_linestatus") == "F")).alias("remedy_done"),
                F.bool_or(remedied & (F.col("l_tax") < 0.04)).alias("remedy_on_alert"),
                F.bool_or(remedied & (F.col("l_tax") >= 0.04)).alias("remedy_on_investigation"),
            ),
            "order-lines",
        )

    def investigations(self) -> DataFrame:
        started = F.col("acknowledged_at") + F.make_dt_interval(mins=F.lit(10))
        duration = F.when(
            F.col("status") != "IN_INVESTIGATION", F.lit(300) + F.floor(F.col("o_totalprice") / 25.0)
        )
        investigations = (
            self.lines.where("investigated")
            .join(self._orders_as_alerts, F.col("l_orderkey") == F.col("o_orderkey"))
            .select(
                _padded("INV-", "l_orderkey", 10).alias("investigation_id"),
                "alert_id",
                "entity_id",
                _padded("ANALYST-", "lead", 7).alias("analyst_id"),
                F.when(F.col("status") == "CLOSED", "CLOSED").when(F.col("status") == "ACKNOWLEDGED", "ABANDONED")
                .otherwise("IN_PROGRESS").alias("status"),
                started.alias("started_at"),
                (started + _seconds(duration)).alias("ended_at"),
                duration.alias("duration_seconds"),
                F.col("n_lines").alias("evidence_count"),
            )
        )
        return self._shared(investigations, "investigations")

    def actions(self) -> DataFrame:
        """Line items of investigated orders, and one closing action where the order is done. What is written are
        the lines' own columns for the long action ids, which few readers want and which are made for those."""
        investigated = self.lines.where("investigated")
        flag, line_status = F.col("l_returnflag"), F.col("l_linestatus")
        worked = self.lineitem.join(investigated.select("l_orderkey"), "l_orderkey", "left_semi").select(
            "l_orderkey", _padded("INV-", "l_orderkey", 10).alias("investigation_id"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
            F.col("l_linenumber").cast("bigint").alias("sequence_number"),
            F.when(flag == "R", "EVENT_SEARCH").when(flag == "N", "ASSET_LOOKUP")
            .when(line_status == "F", "VALIDATE").otherwise("CONTEXT_REVIEW").alias("action_type"),
            F.col("l_shipdate").alias("occurred_at"),
            F.lit(False).alias("closing"),
        )
        done = self.orders.where(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("l_orderkey"))
        finished = investigated.join(done, "l_orderkey", "left_semi").select(
            "l_orderkey", _padded("INV-", "l_orderkey", 10).alias("investigation_id"),
            (F.col("last_line") + 1).cast("bigint").alias("sequence_number"),
            F.lit("CLOSE").alias("action_type"),
            F.col("last_ship").alias("occurred_at"),
            F.lit(True).alias("closing"),
        )
        of_line = F.concat(
            F.lpad(F.col("l_linenumber").cast("string"), 2, "0"),
            F.lpad(F.col("l_partkey").cast("string"), 9, "0"),
            F.lpad(F.col("l_suppkey").cast("string"), 7, "0"),
            F.lpad(F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string"), 12, "0"),
        )
        return self._shared(worked.unionByName(finished, allowMissingColumns=True), "actions").select(
            F.concat(_padded("ACT-", "l_orderkey", 10), F.when(F.col("closing"), "99").otherwise(of_line)).alias("action_id"),
            "investigation_id", "sequence_number", "action_type", "occurred_at",
            F.lit(None).cast("bigint").alias("duration_seconds"), F.lit("SUCCESS").alias("outcome"),
        )

    def escalations(self) -> DataFrame:
        by_alert = F.col("escalated_alert") | ~F.col("investigated")
        return self.lines.where("escalated").select(
            _padded("ESC-", "l_orderkey", 10).alias("escalation_id"),
            F.when(by_alert, _padded("ALR-", "l_orderkey", 10)).alias("alert_id"),
            F.when(~by_alert, _padded("INV-", "l_orderkey", 10)).alias("investigation_id"),
            F.col("first_ship").alias("created_at"),
            F.lit("TIER2").alias("target"),
            F.lit("SEVERITY").alias("reason"),
            F.lit("RESOLVED").alias("status"),
            F.col("last_ship").alias("resolved_at"),
        )

    def remediations(self) -> DataFrame:
        done = F.col("remedy_done")
        return self.lines.where("remedied").select(
            _padded("REM-", "l_orderkey", 10).alias("remediation_id"),
            F.when(F.col("remedy_on_alert"), _padded("ALR-", "l_orderkey", 10)).alias("alert_id"),
            F.when(F.col("remedy_on_investigation"), _padded("INV-", "l_orderkey", 10)).alias("investigation_id"),
            F.col("first_ship").alias("created_at"),
            F.when(done, F.col("last_ship")).alias("completed_at"),
            F.lit("PATCH").alias("remediation_type"),
            F.when(done, "COMPLETED").otherwise("IN_PROGRESS").alias("status"),
            F.when(done, F.lit(True)).alias("successful"),
        )

    def telemetry(self) -> DataFrame:
        events = self.raw("events")
        shift = F.date_diff(self.last, F.date_add(events.select(F.to_date(F.max("ts"))).scalar(), 1))
        return (
            events.groupBy("user_id", F.date_add(F.to_date("ts"), shift).alias("day"))
            .agg(F.count("*").alias("event_count"), F.avg("value").alias("activity_level"))
            .join(self.customer.select("c_custkey", "c_nationkey"), F.col("user_id") == F.col("c_custkey"))
            .select(
                F.concat(F.lit("TLM-"), F.lpad(F.col("user_id").cast("string"), 8, "0"), F.date_format("day", "yyyyMMdd")).alias("telemetry_id"),
                _padded("ENT-", "c_nationkey", 2).alias("entity_id"),
                _padded("AST-", "user_id", 8).alias("asset_id"),
                F.col("day").cast("timestamp_ntz").alias("period_start"),
                F.date_add("day", 1).cast("timestamp_ntz").alias("period_end"),
                F.lit("NETWORK_FLOW").alias("category"),
                "event_count",
                F.greatest(F.lit(0.0), F.round("activity_level", 4)).alias("activity_level"),
                F.lit("HEALTHY").alias("source_status"),
                F.lit(True).alias("expected"),
            )
        )

    def quarters(self) -> DataFrame:
        starts = F.expr("sequence(data_period_start, data_period_end - interval 1 month, interval 3 months)")
        return self.entities.select("entity_id", F.explode(starts).alias("period_start")).withColumn(
            "period_end", F.col("period_start") + F.expr("interval 3 months")
        )

    def kpis(self) -> DataFrame:
        return kpi_rollup(self.tables, self.quarters()).select(
            F.concat(F.lit("PMET-"), F.substring("entity_id", 5, 2), F.date_format("period_start", "yyyyMM")).alias("metric_id"),
            "*",
        )

    @cached_property
    def tables(self) -> Tables:
        return Tables(
            entities=lambda: self.entities,
            assets=lambda: self.assets,
            alerts=self.alerts,
            investigations=self.investigations,
            investigation_actions=self.actions,
            escalations=self.escalations,
            remediations=self.remediations,
            telemetry=self.telemetry,
            performance_metrics=self.kpis,
        )


def load(spark: SparkSession, folder: str, stored: bool = False) -> Tables:
    """The nine tables over the raw tables in ``folder``. With ``stored``, alerts, investigations and actions are
    written once, for whole runs, which read each of them several times."""
    return _Demo(spark, folder, stored).tables
