"""The same results in plain SQL over the raw test tables, for comparison.

Every statement is written against the raw tables and shares no code with the
Spark jobs. Where the Spark job avoids a pairwise computation (peers, running
baseline) the SQL does it by brute force.
"""

from __future__ import annotations

import re

_ACTIONS = (
    "['OPEN','ASSET_LOOKUP','EVENT_SEARCH','CORRELATION','CONTEXT_REVIEW','EVIDENCE_REVIEW',"
    "'ESCALATE','CONTAINMENT_REQUEST','REMEDIATION_REQUEST','VALIDATE','CLOSE']"
)
_KPIS = (
    "mttr_hours", "closure_rate", "sla_compliance", "escalation_rate",
    "investigation_completeness", "recurrence_rate", "remediation_rate", "evidence_completeness",
)
_FEATURES = (
    "alerts_per_asset", "crit_high_rate", "tp_rate", "closure_rate", "inv_coverage", "esc_rate",
    "mean_inv_dur_h", "mean_actions", "mean_evidence",
)


def _ts(col: str) -> str:
    return f"strftime({col}, '%Y-%m-%d %H:%M:%S')"


def _ym(col: str) -> str:
    return f"strftime({col}, '%Y-%m')"


_kpi_long = " UNION ALL ".join(
    f"SELECT entity_id, period_start, period_end, '{k}' AS metric_name, {k} AS v FROM kpi" for k in _KPIS
)
_feature_long = " UNION ALL ".join(
    f"SELECT entity_id, period_start, '{f}' AS feature, {f} AS v FROM complete" for f in _FEATURES
)

_CTE: dict[str, str] = {
    "horizon": """SELECT date_trunc('month', min(o_orderdate))::TIMESTAMP AS ps,
        (date_trunc('month', max(o_orderdate)) + INTERVAL 1 MONTH)::TIMESTAMP AS pe FROM orders""",
    "entities": """SELECT 'ENT-' || lpad(n_nationkey::VARCHAR, 2, '0') AS entity_id, n_name AS name,
        CASE n_regionkey WHEN 0 THEN 'FINANCE' WHEN 1 THEN 'HEALTHCARE' WHEN 2 THEN 'RETAIL' WHEN 3 THEN 'ENERGY' ELSE 'TECHNOLOGY' END AS sector,
        r_name AS peer_group,
        CASE WHEN n_regionkey <= 1 THEN 'SMALL' WHEN n_regionkey <= 3 THEN 'MEDIUM' ELSE 'LARGE' END AS scale,
        (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS asset_count_estimate,
        (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS analyst_headcount,
        (SELECT ps FROM horizon) AS data_period_start, (SELECT pe FROM horizon) AS data_period_end
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "assets": """SELECT 'AST-' || lpad(c_custkey::VARCHAR, 8, '0') AS asset_id,
        'ENT-' || lpad(c_nationkey::VARCHAR, 2, '0') AS entity_id,
        CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'CRITICAL' WHEN 'MACHINERY' THEN 'HIGH' WHEN 'BUILDING' THEN 'MEDIUM' ELSE 'LOW' END AS criticality,
        c_acctbal > 0 AS monitoring_expected,
        CASE WHEN c_acctbal > 0 THEN 'NETWORK_FLOW' END AS expected_telemetry FROM customer""",
    "alerts": """SELECT o_orderkey, o_totalprice, 'ALR-' || lpad(o_orderkey::VARCHAR, 10, '0') AS alert_id,
        'ENT-' || lpad(c_nationkey::VARCHAR, 2, '0') AS entity_id, 'AST-' || lpad(o_custkey::VARCHAR, 8, '0') AS asset_id,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'CRITICAL' WHEN '2-HIGH' THEN 'HIGH' WHEN '3-MEDIUM' THEN 'MEDIUM' ELSE 'LOW' END AS severity,
        CASE o_orderstatus WHEN 'F' THEN 'CLOSED' WHEN 'O' THEN 'ACKNOWLEDGED' ELSE 'IN_INVESTIGATION' END AS status,
        o_orderdate AS created_at,
        o_orderdate + to_minutes(floor(o_totalprice / 1000.0)::BIGINT) AS acknowledged_at,
        CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 2 DAY END AS closed_at,
        CASE WHEN o_totalprice >= 200000 THEN 'RK-' || o_custkey::VARCHAR END AS recurrence_key,
        CASE WHEN o_orderstatus = 'F' THEN o_totalprice >= 100000 END AS is_true_positive
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "lines": """SELECT l_orderkey, count(*) AS n_lines, max(l_linenumber) AS last_line, min(l_suppkey) AS lead,
        min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship,
        bool_or(l_discount >= 0.07::DOUBLE) AS investigated, bool_or(l_quantity >= 40) AS escalated,
        bool_or(l_quantity >= 40 AND l_returnflag = 'R') AS escalated_alert,
        bool_or(l_returnflag = 'A' AND l_discount >= 0.08::DOUBLE) AS remedied,
        bool_or(l_returnflag = 'A' AND l_discount >= 0.08::DOUBLE AND l_linestatus = 'F') AS remedy_done,
        bool_or(l_returnflag = 'A' AND l_discount >= 0.08::DOUBLE AND l_tax < 0.04::DOUBLE) AS remedy_on_alert,
        bool_or(l_returnflag = 'A' AND l_discount >= 0.08::DOUBLE AND l_tax >= 0.04::DOUBLE) AS remedy_on_inv
        FROM lineitem GROUP BY l_orderkey""",
    "investigations": """SELECT 'INV-' || lpad(l_orderkey::VARCHAR, 10, '0') AS investigation_id, alert_id, entity_id,
        CASE status WHEN 'CLOSED' THEN 'CLOSED' WHEN 'ACKNOWLEDGED' THEN 'ABANDONED' ELSE 'IN_PROGRESS' END AS status,
        acknowledged_at + INTERVAL 10 MINUTE AS started_at,
        CASE WHEN status <> 'IN_INVESTIGATION' THEN 300 + floor(o_totalprice / 25.0)::BIGINT END AS duration_seconds,
        acknowledged_at + INTERVAL 10 MINUTE
          + to_seconds(CASE WHEN status <> 'IN_INVESTIGATION' THEN 300 + floor(o_totalprice / 25.0)::BIGINT END) AS ended_at,
        n_lines AS evidence_count, l_orderkey
        FROM lines JOIN alerts ON l_orderkey = o_orderkey WHERE investigated""",
    "actions": """SELECT 'ACT-' || lpad(l_orderkey::VARCHAR, 10, '0') || lpad(l_linenumber::VARCHAR, 2, '0')
          || lpad(l_partkey::VARCHAR, 9, '0') || lpad(l_suppkey::VARCHAR, 7, '0')
          || lpad(round(l_extendedprice * 100)::BIGINT::VARCHAR, 12, '0') AS action_id,
        'INV-' || lpad(l_orderkey::VARCHAR, 10, '0') AS investigation_id, l_linenumber::BIGINT AS sequence_number,
        CASE WHEN l_returnflag = 'R' THEN 'EVENT_SEARCH' WHEN l_returnflag = 'N' THEN 'ASSET_LOOKUP'
          WHEN l_linestatus = 'F' THEN 'VALIDATE' ELSE 'CONTEXT_REVIEW' END AS action_type, l_shipdate AS occurred_at
        FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lines WHERE investigated)
        UNION ALL
        SELECT 'ACT-' || lpad(l_orderkey::VARCHAR, 10, '0') || '99', 'INV-' || lpad(l_orderkey::VARCHAR, 10, '0'),
        (last_line + 1)::BIGINT, 'CLOSE', last_ship FROM lines JOIN orders ON l_orderkey = o_orderkey
        WHERE investigated AND o_orderstatus = 'F'""",
    "escalations": """SELECT 'ESC-' || lpad(l_orderkey::VARCHAR, 10, '0') AS escalation_id,
        CASE WHEN escalated_alert OR NOT investigated THEN 'ALR-' || lpad(l_orderkey::VARCHAR, 10, '0') END AS alert_id,
        CASE WHEN NOT (escalated_alert OR NOT investigated) THEN 'INV-' || lpad(l_orderkey::VARCHAR, 10, '0') END AS investigation_id,
        first_ship AS created_at, last_ship AS resolved_at FROM lines WHERE escalated""",
    "remediations": """SELECT 'REM-' || lpad(l_orderkey::VARCHAR, 10, '0') AS remediation_id,
        CASE WHEN remedy_on_alert THEN 'ALR-' || lpad(l_orderkey::VARCHAR, 10, '0') END AS alert_id,
        CASE WHEN remedy_on_inv THEN 'INV-' || lpad(l_orderkey::VARCHAR, 10, '0') END AS investigation_id,
        CASE WHEN remedy_done THEN 'COMPLETED' ELSE 'IN_PROGRESS' END AS status,
        first_ship AS created_at, CASE WHEN remedy_done THEN last_ship END AS completed_at
        FROM lines WHERE remedied""",
    "telemetry": """SELECT 'TLM-' || lpad(user_id::VARCHAR, 8, '0') || strftime(day, '%Y%m%d') AS telemetry_id,
        'ENT-' || lpad(c_nationkey::VARCHAR, 2, '0') AS entity_id, 'AST-' || lpad(user_id::VARCHAR, 8, '0') AS asset_id,
        day::TIMESTAMP AS period_start, (day + INTERVAL 1 DAY)::TIMESTAMP AS period_end, n AS event_count
        FROM (SELECT user_id, (ts::DATE + date_diff('day', (SELECT max(ts)::DATE + 1 FROM events), (SELECT pe::DATE FROM horizon))::INTEGER) AS day, count(*) AS n
              FROM events GROUP BY ALL) JOIN customer ON user_id = c_custkey""",
    "quarters": """SELECT entity_id, q AS period_start, q + INTERVAL 3 MONTH AS period_end FROM
        (SELECT entity_id, unnest(generate_series(data_period_start, data_period_end - INTERVAL 1 MONTH, INTERVAL 3 MONTH)) AS q FROM entities)""",
    "inv_facts": """SELECT i.*, EXISTS (SELECT 1 FROM escalations e WHERE e.investigation_id = i.investigation_id) AS has_esc,
        EXISTS (SELECT 1 FROM remediations r WHERE r.investigation_id = i.investigation_id AND r.status = 'COMPLETED') AS has_rem,
        coalesce(n_actions, 0) AS n_actions, coalesce(validated AND closed_out, FALSE) AS full_flow
        FROM investigations i LEFT JOIN (SELECT investigation_id, count(*) AS n_actions, bool_or(action_type = 'VALIDATE') AS validated,
          bool_or(action_type = 'CLOSE') AS closed_out FROM actions GROUP BY 1) USING (investigation_id)""",
    "kpi": """SELECT 'PMET-' || substr(q.entity_id, 5, 2) || strftime(q.period_start, '%Y%m') AS metric_id,
        q.entity_id, q.period_start, q.period_end,
        format('{:.4f}', (coalesce(sum(i.duration_seconds) FILTER (i.status = 'CLOSED') / 3600.0 / nullif(count(*) FILTER (i.status = 'CLOSED'), 0), 0))::DOUBLE)::DOUBLE AS mttr_hours,
        format('{:.4f}', (coalesce(count(*) FILTER (i.status = 'CLOSED')::DOUBLE / nullif(count(i.investigation_id), 0), 1))::DOUBLE)::DOUBLE AS closure_rate,
        format('{:.4f}', (coalesce(count(*) FILTER (a.acknowledged_at IS NOT NULL AND date_diff('second', a.created_at, a.acknowledged_at) / 60.0
            <= CASE a.severity WHEN 'LOW' THEN 240 WHEN 'MEDIUM' THEN 120 WHEN 'HIGH' THEN 45 ELSE 15 END)::DOUBLE / nullif(count(a.acknowledged_at), 0), 1))::DOUBLE)::DOUBLE AS sla_compliance,
        format('{:.4f}', (coalesce(count(*) FILTER (i.has_esc)::DOUBLE / nullif(count(i.investigation_id), 0), 0))::DOUBLE)::DOUBLE AS escalation_rate,
        format('{:.4f}', (coalesce(count(*) FILTER (i.status = 'CLOSED' AND i.full_flow)::DOUBLE / nullif(count(*) FILTER (i.status = 'CLOSED'), 0), 1))::DOUBLE)::DOUBLE AS investigation_completeness,
        format('{:.4f}', (coalesce(count(a.recurrence_key)::DOUBLE / nullif(count(a.alert_id), 0), 0))::DOUBLE)::DOUBLE AS recurrence_rate,
        format('{:.4f}', (coalesce(count(*) FILTER (a.is_true_positive AND i.has_rem)::DOUBLE / nullif(count(*) FILTER (a.is_true_positive), 0), 1))::DOUBLE)::DOUBLE AS remediation_rate,
        format('{:.4f}', (coalesce(sum(least(i.evidence_count, CASE a.severity WHEN 'LOW' THEN 2 WHEN 'MEDIUM' THEN 4 WHEN 'HIGH' THEN 6 ELSE 8 END)
            * CASE a.severity WHEN 'LOW' THEN 12 WHEN 'MEDIUM' THEN 6 WHEN 'HIGH' THEN 4 ELSE 3 END) FILTER (i.status = 'CLOSED')::DOUBLE / 24
            / nullif(count(*) FILTER (i.status = 'CLOSED'), 0), 1))::DOUBLE)::DOUBLE AS evidence_completeness
        FROM quarters q LEFT JOIN alerts a ON a.entity_id = q.entity_id AND q.period_start <= a.created_at AND a.created_at < q.period_end
        LEFT JOIN inv_facts i ON i.alert_id = a.alert_id GROUP BY q.entity_id, q.period_start, q.period_end""",
    "remediated": """SELECT alert_id FROM remediations WHERE status = 'COMPLETED' AND alert_id IS NOT NULL
        UNION SELECT i.alert_id FROM remediations r JOIN investigations i ON r.investigation_id = i.investigation_id WHERE r.status = 'COMPLETED'""",
    "features": """SELECT q.entity_id, q.period_start,
        coalesce(n_alerts, 0)::DOUBLE / greatest(asset_count_estimate, 1) AS alerts_per_asset,
        severe::DOUBLE / nullif(n_alerts, 0) AS crit_high_rate, confirmed::DOUBLE / nullif(resolved, 0) AS tp_rate,
        closed::DOUBLE / nullif(n_inv, 0) AS closure_rate, coalesce(n_inv, 0)::DOUBLE / nullif(n_alerts, 0) AS inv_coverage,
        esc::DOUBLE / nullif(n_inv, 0) AS esc_rate, dur / 3600.0 AS mean_inv_dur_h, acts AS mean_actions, ev AS mean_evidence,
        coalesce(n_alerts, 0)::DOUBLE AS alert_count, rem::DOUBLE / nullif(confirmed, 0) AS rem_rate
        FROM quarters q JOIN entities e ON e.entity_id = q.entity_id
        LEFT JOIN (SELECT q.entity_id, q.period_start, count(*) AS n_alerts, count(*) FILTER (severity IN ('HIGH', 'CRITICAL')) AS severe,
            count(is_true_positive) AS resolved, count(*) FILTER (is_true_positive) AS confirmed,
            count(*) FILTER (is_true_positive AND a.alert_id IN (SELECT alert_id FROM remediated)) AS rem
            FROM quarters q JOIN alerts a ON a.entity_id = q.entity_id AND q.period_start <= created_at AND created_at < q.period_end GROUP BY ALL) x
          ON x.entity_id = q.entity_id AND x.period_start = q.period_start
        LEFT JOIN (SELECT q.entity_id, q.period_start, count(*) AS n_inv, count(*) FILTER (status = 'CLOSED') AS closed,
            count(*) FILTER (has_esc) AS esc, avg(duration_seconds) FILTER (status = 'CLOSED') AS dur, avg(n_actions) AS acts, avg(evidence_count) AS ev
            FROM quarters q JOIN inv_facts i ON i.entity_id = q.entity_id AND q.period_start <= started_at AND started_at < q.period_end GROUP BY ALL) y
          ON y.entity_id = q.entity_id AND y.period_start = q.period_start""",
    "complete": "SELECT * FROM features WHERE " + " AND ".join(f"{f} IS NOT NULL" for f in _FEATURES),
    "feature_long": _feature_long,
    # --- detectors ---------------------------------------------------------------
    "eg1": """SELECT 'EG-001:' || alert_id AS finding_key, 'CRITICAL_ALERT_NO_ESCALATION' AS reason_code, a.entity_id, asset_id, alert_id,
        investigation_id, coalesce(closed_at, created_at) AS observed_at, severity FROM alerts a JOIN investigations i USING (alert_id)
        WHERE severity = 'CRITICAL' AND a.status = 'CLOSED' AND is_true_positive
        AND NOT EXISTS (SELECT 1 FROM escalations e WHERE e.alert_id = a.alert_id OR e.investigation_id = i.investigation_id)""",
    "eg2": """SELECT 'EG-002:' || alert_id AS finding_key, 'ACKNOWLEDGED_ALERT_NO_INVESTIGATION' AS reason_code, a.entity_id, asset_id, alert_id,
        acknowledged_at, data_period_end, severity FROM alerts a JOIN entities e ON a.entity_id = e.entity_id
        WHERE acknowledged_at IS NOT NULL AND status = 'ACKNOWLEDGED' AND severity IN ('HIGH', 'CRITICAL')
        AND alert_id NOT IN (SELECT alert_id FROM investigations)
        AND date_diff('second', acknowledged_at, data_period_end) / 3600.0 >= 24""",
    "eg3_alerts": """SELECT *, alert_id IN (SELECT alert_id FROM remediated) AS rem FROM alerts
        WHERE is_true_positive AND recurrence_key IS NOT NULL""",
    "eg3": """SELECT 'EG-003:' || entity_id || ':' || recurrence_key AS finding_key, 'RECURRING_CONFIRMED_ALERTS_NO_REMEDIATION' AS reason_code,
        entity_id, recurrence_key, count(*) AS n, min(created_at) AS ws, max(created_at) AS we,
        arg_min(asset_id, alert_id) AS asset_id, arg_min(severity, alert_id) AS severity
        FROM eg3_alerts GROUP BY entity_id, recurrence_key HAVING count(*) >= 3 AND NOT bool_or(rem)""",
    "ns1": """SELECT 'NS-001:' || asset_id AS finding_key, a.entity_id, asset_id, criticality, expected_telemetry, data_period_start, data_period_end
        FROM assets a JOIN entities e ON a.entity_id = e.entity_id WHERE monitoring_expected AND criticality = 'CRITICAL'
        AND date_diff('second', data_period_start, data_period_end) / 3600.0 >= 24 AND asset_id NOT IN (SELECT asset_id FROM telemetry)""",
    "ns2": """SELECT 'NS-002:' || a.asset_id AS finding_key, a.entity_id, a.asset_id, criticality, expected_telemetry, n, last_seen, data_period_end,
        date_diff('second', last_seen, data_period_end) / 3600.0 AS silence
        FROM assets a JOIN entities e ON a.entity_id = e.entity_id
        JOIN (SELECT asset_id, count(*) AS n, max(period_end) AS last_seen FROM telemetry GROUP BY 1) t ON t.asset_id = a.asset_id
        WHERE monitoring_expected AND n >= 2 AND last_seen < data_period_end AND date_diff('second', last_seen, data_period_end) / 3600.0 >= 24""",
    "kpi_long": _kpi_long,
    "peer_rows": """SELECT k.*, scale AS grp FROM kpi_long k JOIN entities USING (entity_id)""",
    "peer_median": """SELECT s.entity_id, s.period_start, s.metric_name, s.grp, any_value(s.v) AS v, median(p.v) AS m, count(*) AS n
        FROM peer_rows s JOIN peer_rows p ON s.grp = p.grp AND s.period_start = p.period_start AND s.metric_name = p.metric_name AND s.entity_id <> p.entity_id
        GROUP BY s.entity_id, s.period_start, s.metric_name, s.grp HAVING count(*) >= 2""",
    "peer_mad": """SELECT s.entity_id, s.period_start, s.metric_name, s.grp, any_value(s.v) AS v, any_value(s.m) AS m, any_value(s.n) AS n,
        1.4826::DOUBLE * median(abs(p.v - s.m)) AS mad
        FROM peer_median s JOIN peer_rows p ON s.grp = p.grp AND s.period_start = p.period_start AND s.metric_name = p.metric_name AND s.entity_id <> p.entity_id
        GROUP BY s.entity_id, s.period_start, s.metric_name, s.grp""",
    "pb": """SELECT 'PB-001:' || entity_id || ':' || strftime(period_start, '%Y-%m') || ':' || metric_name AS finding_key, *,
        CASE WHEN mad = 0 THEN 'ABSOLUTE_ZERO_MAD' ELSE 'ROBUST_MAD' END AS basis,
        CASE WHEN mad = 0 THEN abs(v - m) ELSE abs(v - m) / mad END AS measure,
        CASE WHEN v > m THEN 'ABOVE' ELSE 'BELOW' END AS direction
        FROM peer_mad WHERE CASE WHEN mad = 0 THEN abs(v - m) >= CASE metric_name WHEN 'mttr_hours' THEN 2.0::DOUBLE ELSE 0.15::DOUBLE END
          ELSE abs(v - m) / nullif(mad, 0) >= 3.5::DOUBLE END""",
    "trend_points": """SELECT entity_id, metric_name, period_start, v, metric_name NOT IN ('mttr_hours', 'recurrence_rate') AS up,
        CASE WHEN metric_name IN ('closure_rate', 'sla_compliance', 'mttr_hours') THEN 'HEADLINE' ELSE 'QUALITY' END AS grp,
        row_number() OVER (PARTITION BY entity_id, metric_name ORDER BY period_start) - 1 AS x
        FROM kpi_long JOIN entities USING (entity_id) WHERE metric_name <> 'escalation_rate' AND period_start < data_period_end""",
    "trends": """SELECT entity_id, metric_name, grp, count(*) AS n,
        CASE WHEN max(v) = min(v) THEN 0.0 ELSE greatest(-1.0, least(1.0, regr_slope(CASE WHEN up THEN v ELSE -v END, x) * (count(*) - 1) / (max(v) - min(v)))) END AS score
        FROM trend_points GROUP BY entity_id, metric_name, grp""",
    "mrd": """SELECT 'MRD-001:' || entity_id || ':' || strftime(ws, '%Y-%m') || ':' || strftime(ls, '%Y-%m') AS finding_key, *
        FROM (SELECT entity_id, coalesce(avg(score) FILTER (grp = 'HEADLINE' AND abs(score) >= 0.05::DOUBLE), 0) AS h,
            coalesce(avg(score) FILTER (grp = 'QUALITY' AND abs(score) >= 0.05::DOUBLE), 0) AS q FROM trends GROUP BY 1)
        JOIN (SELECT entity_id, min(period_start) AS ws, max(period_start) AS ls, count(*) AS n, max(period_end) AS we
            FROM kpi JOIN entities USING (entity_id) WHERE period_start < data_period_end GROUP BY 1) USING (entity_id)
        WHERE n >= 4 AND h >= 0.05::DOUBLE AND q <= -0.05::DOUBLE""",
    "seqs": f"""SELECT investigation_id, count(*) AS n_actions, count(DISTINCT sequence_number) < count(*) AS dup,
        string_agg(chr((96 + list_position({_ACTIONS}, action_type))::INTEGER), '' ORDER BY sequence_number, occurred_at, action_id) AS letters,
        string_agg(action_type, '|' ORDER BY sequence_number, occurred_at, action_id) AS seq FROM actions GROUP BY 1""",
    "recs": """SELECT i.investigation_id, i.entity_id, i.alert_id, i.status, q.period_start, q.period_end, a.severity,
        coalesce(n_actions, 0) AS n_actions, coalesce(dup, FALSE) AS dup, coalesce(letters, '') AS letters, coalesce(seq, '') AS seq
        FROM investigations i JOIN quarters q ON i.entity_id = q.entity_id AND q.period_start <= i.started_at AND i.started_at < q.period_end
        JOIN alerts a ON a.alert_id = i.alert_id LEFT JOIN seqs s ON s.investigation_id = i.investigation_id""",
    "fp_counts": """SELECT entity_id, period_start, letters, any_value(seq) AS seq, count(*) AS n, min(investigation_id) AS first_inv,
        sum(count(*)) OVER (PARTITION BY entity_id, period_start)::BIGINT AS total
        FROM recs WHERE n_actions >= 2 GROUP BY entity_id, period_start, letters""",
    "rep": """SELECT 'IF-REP-001:' || entity_id || ':' || strftime(period_start, '%Y-%m') || ':' || substr(sha256(seq), 1, 8) AS finding_key, *
        FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, period_start ORDER BY n DESC, first_inv) AS place FROM fp_counts)
        WHERE place = 1 AND n >= 3 AND total >= 3""",
    "elig": """SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY period_start, investigation_id) AS pos FROM recs WHERE n_actions >= 2""",
    "prior_counts": """SELECT r.investigation_id, p.letters, any_value(p.seq) AS seq, count(*) AS n, min(p.pos) AS first_pos
        FROM elig r JOIN elig p ON r.entity_id = p.entity_id AND p.pos < r.pos WHERE r.pos > 3 GROUP BY r.investigation_id, p.letters""",
    "baseline": """SELECT e.*, b.letters AS b_letters, b.seq AS b_seq, b.n AS b_n, e.pos - 1 AS n_prior FROM elig e JOIN
        (SELECT *, row_number() OVER (PARTITION BY investigation_id ORDER BY n DESC, first_pos) AS place FROM prior_counts) b
        ON e.investigation_id = b.investigation_id AND b.place = 1""",
    "dev": """SELECT 'IF-DEV-002:' || investigation_id AS finding_key, *,
        levenshtein(letters, b_letters)::DOUBLE / greatest(length(letters), length(b_letters)) AS dist FROM baseline
        WHERE levenshtein(letters, b_letters)::DOUBLE / greatest(length(letters), length(b_letters)) >= 0.6::DOUBLE""",
    "mea": """SELECT 'IF-MEA-003:' || investigation_id AS finding_key, * FROM recs WHERE status = 'CLOSED' AND severity IN ('HIGH', 'CRITICAL')
        AND NOT contains(letters, 'j') AND NOT contains(letters, 'f')""",
    # --- evidence, findings, queue --------------------------------------------------
    "refs": f"""SELECT finding_key, 'EG-001' AS analytic_id, 'ALERT' AS source_type, alert_id AS source_id, 'triggering_alert' AS role, {_ym('observed_at')} AS period_label FROM eg1
        UNION ALL SELECT finding_key, 'EG-001', 'INVESTIGATION', investigation_id, 'associated_investigation', {_ym('observed_at')} FROM eg1
        UNION ALL SELECT finding_key, 'EG-001', 'ASSET', asset_id, 'affected_asset', {_ym('observed_at')} FROM eg1
        UNION ALL SELECT finding_key, 'EG-001', 'ABSENCE', 'missing_escalation|entity:' || entity_id || '|alert:' || alert_id, 'missing_expected_escalation', {_ym('observed_at')} FROM eg1
        UNION ALL SELECT finding_key, 'EG-001', 'ALERT', alert_id, 'triggering_alert', {_ym('acknowledged_at')} FROM eg2
        UNION ALL SELECT finding_key, 'EG-001', 'ASSET', asset_id, 'affected_asset', {_ym('acknowledged_at')} FROM eg2
        UNION ALL SELECT finding_key, 'EG-001', 'ABSENCE', 'missing_investigation|entity:' || entity_id || '|alert:' || alert_id, 'missing_expected_investigation', {_ym('acknowledged_at')} FROM eg2
        UNION ALL SELECT finding_key, 'EG-001', 'ALERT', a.alert_id, 'related_recurring_alert', {_ym('ws')} FROM eg3 JOIN eg3_alerts a USING (entity_id, recurrence_key)
        UNION ALL SELECT finding_key, 'EG-001', 'ASSET', asset_id, 'affected_asset', {_ym('ws')} FROM eg3
        UNION ALL SELECT finding_key, 'EG-001', 'ABSENCE', 'missing_remediation|entity:' || entity_id || '|recurrence_key:' || recurrence_key, 'missing_expected_remediation', {_ym('ws')} FROM eg3
        UNION ALL SELECT finding_key, 'NS-001', 'ASSET', asset_id, 'monitored_asset', {_ym('data_period_start')} FROM ns1
        UNION ALL SELECT finding_key, 'NS-001', 'ABSENCE', 'missing_telemetry|entity:' || entity_id || '|asset:' || asset_id, 'missing_expected_telemetry', {_ym('data_period_start')} FROM ns1
        UNION ALL SELECT finding_key, 'NS-001', 'ASSET', asset_id, 'monitored_asset', {_ym('last_seen')} FROM ns2
        UNION ALL SELECT finding_key, 'NS-001', 'TELEMETRY_RECORD', telemetry_id, 'last_observed_telemetry', {_ym('last_seen')} FROM ns2 JOIN telemetry t ON t.asset_id = ns2.asset_id
        UNION ALL SELECT finding_key, 'NS-001', 'ABSENCE', 'telemetry_gap|entity:' || entity_id || '|asset:' || asset_id, 'telemetry_continuity_gap', {_ym('last_seen')} FROM ns2
        UNION ALL SELECT finding_key, 'PB-001', 'PERFORMANCE_METRIC', entity_id || ':' || {_ym('period_start')} || ':' || metric_name, 'subject_metric_observation', {_ym('period_start')} FROM pb
        UNION ALL SELECT finding_key, 'PB-001', 'PEER_BASELINE', 'peer_group:' || grp || ':period:' || {_ym('period_start')} || ':metric:' || metric_name, 'peer_baseline', {_ym('period_start')} FROM pb
        UNION ALL SELECT finding_key, 'MRD-001', 'PERFORMANCE_METRIC', entity_id || ':' || {_ym('period_start')} || ':' || metric_name,
          CASE WHEN t.grp = 'HEADLINE' THEN 'headline_kpi' ELSE 'quality_indicator' END, {_ym('period_start')} FROM mrd JOIN trend_points t USING (entity_id)
        UNION ALL SELECT finding_key, 'IF-REP-001', 'INVESTIGATION', e.investigation_id, 'repeated_pattern_investigation', {_ym('period_start')} FROM rep JOIN elig e USING (entity_id, period_start, letters)
        UNION ALL SELECT finding_key, 'IF-DEV-002', 'INVESTIGATION', investigation_id, 'deviating_investigation', {_ym('period_start')} FROM dev
        UNION ALL SELECT finding_key, 'IF-DEV-002', 'PEER_BASELINE', 'entity_baseline:' || entity_id || ':n=' || b_n::VARCHAR, 'entity_baseline_fingerprint', {_ym('period_start')} FROM dev
        UNION ALL SELECT finding_key, 'IF-MEA-003', 'INVESTIGATION', investigation_id, 'incomplete_investigation', {_ym('period_start')} FROM mea
        UNION ALL SELECT finding_key, 'IF-MEA-003', 'ALERT', alert_id, 'associated_high_crit_alert', {_ym('period_start')} FROM mea
        UNION ALL SELECT finding_key, 'IF-MEA-003', 'ABSENCE', 'missing_action|inv:' || investigation_id || '|action:' || x, 'missing_expected_action', {_ym('period_start')}
          FROM mea, (VALUES ('VALIDATE'), ('EVIDENCE_REVIEW')) v(x)""",
    "ref_counts": "SELECT finding_key, count(*) AS evidence_count FROM (SELECT DISTINCT finding_key, source_type, source_id FROM refs) GROUP BY 1",
    "raw_findings": f"""SELECT finding_key, 'EG-001' AS analytic_id, reason_code AS finding_type, 'EXECUTION_GAP' AS category, entity_id, {_ym('observed_at')} AS period_label, severity, 'MODERATE' AS confidence,
          'ADEQUATE_RECORD_COUNT,ABSENCE_BASED' AS factors FROM eg1
        UNION ALL SELECT finding_key, 'EG-001', reason_code, 'EXECUTION_GAP', entity_id, {_ym('acknowledged_at')}, severity, 'MODERATE', 'SINGLE_RECORD,ABSENCE_BASED' FROM eg2
        UNION ALL SELECT finding_key, 'EG-001', reason_code, 'EXECUTION_GAP', entity_id, {_ym('ws')}, severity, 'MODERATE', 'MULTIPLE_DIRECT_RECORDS,ABSENCE_BASED' FROM eg3
        UNION ALL SELECT finding_key, 'NS-001', 'CRITICAL_ASSET_NO_TELEMETRY', 'MONITORING_GAP', entity_id, {_ym('data_period_start')}, NULL, 'MODERATE', 'SINGLE_RECORD,ABSENCE_BASED' FROM ns1
        UNION ALL SELECT finding_key, 'NS-001', 'TELEMETRY_CONTINUITY_GAP', 'MONITORING_GAP', entity_id, {_ym('last_seen')}, NULL,
          CASE WHEN n < 3 THEN 'LOW' ELSE 'MODERATE' END,
          'MULTIPLE_DIRECT_RECORDS,' || CASE WHEN n < 3 THEN 'SMALL_BASELINE' WHEN n < 6 THEN 'MODERATE_BASELINE' ELSE 'LARGE_COMPARISON_POP' END || ',ABSENCE_BASED' FROM ns2
        UNION ALL SELECT finding_key, 'PB-001', 'PEER_DEVIATION', 'PEER_DEVIATION', entity_id, {_ym('period_start')}, NULL,
          CASE WHEN basis = 'ABSOLUTE_ZERO_MAD' OR n < 3 THEN 'LOW' ELSE 'MODERATE' END,
          'SINGLE_RECORD,' || CASE WHEN n < 3 THEN 'SMALL_BASELINE' WHEN n < 6 THEN 'MODERATE_BASELINE' ELSE 'LARGE_COMPARISON_POP' END
            || CASE WHEN basis = 'ABSOLUTE_ZERO_MAD' THEN ',FRAGILE_BASELINE' ELSE '' END FROM pb
        UNION ALL SELECT finding_key, 'MRD-001', 'METRIC_RISK_DIVERGENCE', 'METRIC_RISK_DIVERGENCE', entity_id, {_ym('ws')}, NULL,
          CASE WHEN n >= 5 AND h / 0.05::DOUBLE >= 2 AND abs(q) / 0.05::DOUBLE >= 2 THEN 'HIGH' ELSE 'MODERATE' END,
          'MULTIPLE_DIRECT_RECORDS' || CASE WHEN n = 4 THEN ',MODERATE_BASELINE' ELSE '' END FROM mrd
        UNION ALL SELECT finding_key, 'IF-REP-001', 'REPETITIVE_WORKFLOW', 'WORKFLOW_PATTERN', entity_id, {_ym('period_start')}, NULL,
          CASE WHEN n >= 6 AND n::DOUBLE / total >= 0.8::DOUBLE THEN 'HIGH' WHEN n::DOUBLE / total >= 0.5 THEN 'MODERATE' ELSE 'LOW' END,
          'MULTIPLE_DIRECT_RECORDS' || CASE WHEN n = 3 THEN ',MINIMUM_THRESHOLD' ELSE '' END || CASE WHEN n::DOUBLE / total < 0.25 THEN ',MODERATE_BASELINE' ELSE '' END FROM rep
        UNION ALL SELECT finding_key, 'IF-DEV-002', 'SEQUENCE_DEVIATION', 'WORKFLOW_PATTERN', entity_id, {_ym('period_start')}, NULL,
          CASE WHEN dist >= 0.6::DOUBLE + 0.2::DOUBLE AND b_n >= 6 THEN 'HIGH' WHEN b_n >= 3 THEN 'MODERATE' ELSE 'LOW' END,
          'SINGLE_RECORD,' || CASE WHEN b_n < 3 THEN 'FRAGILE_BASELINE' WHEN b_n < 5 THEN 'MODERATE_BASELINE,FRAGILE_BASELINE'
            WHEN b_n < 8 THEN 'MODERATE_BASELINE' ELSE 'LARGE_COMPARISON_POP' END FROM dev
        UNION ALL SELECT finding_key, 'IF-MEA-003', 'MISSING_EXPECTED_ACTION', 'WORKFLOW_PATTERN', entity_id, {_ym('period_start')}, severity,
          CASE WHEN n_actions >= 6 THEN 'HIGH' WHEN n_actions >= 3 THEN 'MODERATE' ELSE 'LOW' END,
          'ADEQUATE_RECORD_COUNT,ABSENCE_BASED' || CASE WHEN n_actions <= 2 THEN ',MINIMUM_THRESHOLD' ELSE '' END FROM mea""",
    "findings": "SELECT f.*, evidence_count FROM raw_findings f JOIN ref_counts USING (finding_key)",
    "ranked": """SELECT *, CASE finding_type WHEN 'CRITICAL_ALERT_NO_ESCALATION' THEN 2 WHEN 'ACKNOWLEDGED_ALERT_NO_INVESTIGATION' THEN 2
        WHEN 'METRIC_RISK_DIVERGENCE' THEN 2 WHEN 'REPETITIVE_WORKFLOW' THEN 0 WHEN 'SEQUENCE_DEVIATION' THEN 0 ELSE 1 END AS base FROM findings""",
    "items": """SELECT substr(sha256(finding_key), 1, 12) AS queue_id, finding_key, analytic_id, finding_type, entity_id, period_label,
        CASE finding_type WHEN 'CRITICAL_ALERT_NO_ESCALATION' THEN 'Potential Escalation Gap' WHEN 'ACKNOWLEDGED_ALERT_NO_INVESTIGATION' THEN 'Potential Investigation Gap'
          WHEN 'RECURRING_CONFIRMED_ALERTS_NO_REMEDIATION' THEN 'Potential Remediation Gap' WHEN 'CRITICAL_ASSET_NO_TELEMETRY' THEN 'Potential Monitoring Gap'
          WHEN 'TELEMETRY_CONTINUITY_GAP' THEN 'Potential Telemetry Disappearance' WHEN 'PEER_DEVIATION' THEN 'Potential Peer Benchmark Deviation'
          WHEN 'METRIC_RISK_DIVERGENCE' THEN 'Potential Metric-Risk Divergence' WHEN 'REPETITIVE_WORKFLOW' THEN 'Potential Template-Driven Investigation Pattern'
          WHEN 'SEQUENCE_DEVIATION' THEN 'Potential Investigation Sequence Deviation' ELSE 'Potential Missing Investigation Action' END || ' — ' || entity_id AS title,
        category,
        (['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'])[1 + greatest(0, least(3, base + CASE WHEN severity IN ('HIGH', 'CRITICAL') THEN 1 ELSE 0 END) - CASE WHEN confidence = 'LOW' THEN 1 ELSE 0 END)] AS priority,
        confidence, evidence_count, substr(sha256(finding_key || '|' || analytic_id || '|' || entity_id || '|' || period_label), 1, 8) AS finding_version
        FROM ranked""",
    # Yesterday's queue: all items but sequence deviations; recurrences carried another
    # version then; missing-action items had been decided; what was seen at PB is gone by now.
    "old_queue": """SELECT * REPLACE (CASE WHEN finding_type = 'RECURRING_CONFIRMED_ALERTS_NO_REMEDIATION' THEN 'previous' ELSE finding_version END AS finding_version),
        CASE WHEN finding_type = 'MISSING_EXPECTED_ACTION' THEN 'REVIEWED' WHEN priority = 'CRITICAL' THEN 'IN_REVIEW' WHEN priority = 'LOW' THEN 'DISMISSED' ELSE 'OPEN' END AS status
        FROM items WHERE analytic_id <> 'IF-DEV-002'""",
    "new_items": "SELECT * FROM items WHERE analytic_id <> 'PB-001'",
    "merged": """SELECT coalesce(n.queue_id, o.queue_id) AS queue_id, coalesce(n.finding_key, o.finding_key) AS finding_key,
        CASE WHEN o.finding_key IS NULL THEN 'INSERTED' WHEN n.finding_key IS NULL THEN 'KEPT' WHEN o.finding_version = n.finding_version THEN 'UNCHANGED' ELSE 'UPDATED' END AS outcome,
        CASE WHEN o.finding_key IS NULL OR o.finding_version <> n.finding_version THEN 'OPEN' ELSE o.status END AS status,
        coalesce(n.finding_version, o.finding_version) AS finding_version,
        CASE WHEN o.finding_key IS NULL THEN '2024-02-02 00:00:00' ELSE '2024-02-01 00:00:00' END AS created_at,
        CASE WHEN n.finding_key IS NULL THEN '2024-02-01 00:00:00' ELSE '2024-02-02 00:00:00' END AS updated_at,
        CASE WHEN o.finding_key IS NULL OR o.finding_version <> n.finding_version THEN NULL
          WHEN o.status IN ('REVIEWED', 'DISMISSED', 'IN_REVIEW') THEN 'reviewer' END AS reviewer_ref,
        coalesce(n.priority, o.priority) AS priority, coalesce(n.category, o.category) AS category, coalesce(n.entity_id, o.entity_id) AS entity_id
        FROM old_queue o FULL JOIN new_items n ON o.finding_key = n.finding_key""",
    "moves": """SELECT queue_id, status, CASE confidence WHEN 'LOW' THEN 'DISMISSED' WHEN 'MODERATE' THEN 'IN_REVIEW' ELSE 'OPEN' END AS new_status FROM old_queue
        UNION ALL SELECT 'unknown-' || finding_type, NULL, 'OPEN' FROM old_queue GROUP BY finding_type""",
    "judged": """SELECT queue_id, new_status, CASE WHEN status IS NULL THEN 'NOT_FOUND'
        WHEN status || '>' || new_status IN ('OPEN>IN_REVIEW', 'OPEN>REVIEWED', 'OPEN>DISMISSED', 'IN_REVIEW>REVIEWED', 'IN_REVIEW>OPEN', 'REVIEWED>OPEN', 'DISMISSED>OPEN')
        THEN 'APPLIED' ELSE 'INVALID_TRANSITION' END AS result FROM moves""",
    # --- ingestion ------------------------------------------------------------------
    "raw_alerts": """SELECT o_orderkey + 1 AS row, o_custkey,
        CASE WHEN o_totalprice > 480000 THEN 'ALR-' || o_custkey::VARCHAR WHEN o_totalprice < 4000 THEN 'ALERT/' || o_orderkey::VARCHAR ELSE 'ALR-' || o_orderkey::VARCHAR END AS alert_id,
        CASE WHEN o_totalprice < 8000 THEN 'ENT-99' WHEN o_totalprice > 495000 THEN NULL ELSE 'ENT-07' END AS entity_id,
        upper(split_part(o_orderpriority, '-', 2)) AS severity, o_orderstatus AS st, o_totalprice AS p FROM orders""",
    "alert_issues": """SELECT row, 'alert_id' AS field, 'invalid_identifier_format' AS code FROM raw_alerts WHERE p < 4000
        UNION ALL SELECT row, 'entity_id', 'missing_required_value' FROM raw_alerts WHERE entity_id IS NULL
        UNION ALL SELECT row, 'entity_id', 'missing_reference' FROM raw_alerts WHERE entity_id = 'ENT-99'
        UNION ALL SELECT row, 'severity', 'invalid_enum_value' FROM raw_alerts WHERE severity IN ('URGENT', 'NOT SPECIFIED')
        UNION ALL SELECT row, 'category', 'missing_required_value' FROM raw_alerts WHERE st = 'O'
        UNION ALL SELECT row, 'created_at', 'invalid_timestamp' FROM raw_alerts WHERE p > 490000
        UNION ALL SELECT row, 'created_at', 'naive_timestamp' FROM raw_alerts WHERE p <= 490000 AND st = 'O'
        UNION ALL SELECT row, 'acknowledged_at', 'temporal_order' FROM raw_alerts WHERE p < 20000 AND st <> 'O'
        UNION ALL SELECT row, 'is_true_positive', 'invalid_field_type' FROM raw_alerts WHERE p >= 40000 AND p < 50000
        UNION ALL SELECT row, 'alert_id', 'duplicate_identifier' FROM (SELECT row, row_number() OVER (PARTITION BY alert_id ORDER BY row) AS place FROM raw_alerts) WHERE place > 1
        UNION ALL SELECT row, 'alert_id', 'duplicate_identifier' FROM raw_alerts WHERE alert_id IN (SELECT 'ALR-' || o_orderkey::VARCHAR FROM orders WHERE o_orderstatus = 'P')
        UNION ALL SELECT row, 'asset_id', 'missing_reference' FROM raw_alerts WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)""",
    "raw_telemetry": """SELECT event_id + 1 AS row, event_type AS kind, regexp_extract(props, '[0-9]+') AS k, value FROM events""",
    # --- audits -----------------------------------------------------------------------
    "spans": """SELECT investigation_id, sequence_number, count(*) AS n, min(occurred_at) AS f, max(occurred_at) AS t,
        lag(max(occurred_at)) OVER (PARTITION BY investigation_id ORDER BY sequence_number) AS before FROM actions GROUP BY investigation_id, sequence_number""",
    "ground": """SELECT CASE n_regionkey WHEN 0 THEN 'CRITICAL_ALERT_WITHOUT_ESCALATION' WHEN 1 THEN 'TELEMETRY_DISAPPEARANCE' WHEN 2 THEN 'SUSPICIOUSLY_FAST_INVESTIGATION'
        WHEN 3 THEN 'METRIC_RISK_DIVERGENCE' ELSE 'NORMAL_BASELINE' END AS scenario_type,
        CASE n_regionkey WHEN 0 THEN 'ESCALATION_GAP' WHEN 1 THEN 'TELEMETRY_DISAPPEARANCE' WHEN 2 THEN 'INVESTIGATION_QUALITY' WHEN 3 THEN 'METRIC_RISK_DIVERGENCE' ELSE 'NONE' END AS expected,
        'ENT-' || lpad(n_nationkey::VARCHAR, 2, '0') AS entity_id FROM nation""",
}

_NAMES = re.compile(r"\b(" + "|".join(_CTE) + r")\b")


def _needed(sql: str, seen: set[str]) -> None:
    for name in _NAMES.findall(sql):
        if name not in seen:
            seen.add(name)
            _needed(_CTE[name], seen)


def _with(sql: str) -> str:
    """Prefix a statement with the common table expressions it needs."""
    needed: set[str] = set()
    _needed(sql, needed)
    ctes = ",\n".join(f"{name} AS ({body})" for name, body in _CTE.items() if name in needed)
    return f"WITH {ctes}\n{sql}" if needed else sql


_kpi_columns = ", ".join(_KPIS)
_feature_columns = ", ".join(f"round({f}, 6) AS {f}" for f in (*_FEATURES, "alert_count", "rem_rate"))

_QUERIES: dict[str, str] = {
    "kpi_rollup": f"SELECT entity_id, {_ym('period_start')} AS period_label, {_kpi_columns} FROM kpi",
    "period_features": f"SELECT entity_id, {_ym('period_start')} AS period_label, {_feature_columns} FROM features",
    "eg001_scoped": f"SELECT finding_key, entity_id, asset_id, alert_id, investigation_id, severity AS alert_severity, {_ts('observed_at')} AS observed_at FROM eg1 WHERE entity_id IN ('ENT-03', 'ENT-11')",
    "eg001_unescalated": f"SELECT finding_key, entity_id, asset_id, alert_id, investigation_id, severity AS alert_severity, {_ts('observed_at')} AS observed_at FROM eg1",
    "eg002_uninvestigated": f"SELECT finding_key, entity_id, asset_id, alert_id, severity AS alert_severity, {_ts('acknowledged_at')} AS window_start, {_ts('data_period_end')} AS window_end FROM eg2",
    "eg003_unremediated": f"SELECT finding_key, entity_id, recurrence_key, n AS n_related_alerts, asset_id, severity AS alert_severity, {_ts('ws')} AS window_start, {_ts('we')} AS window_end FROM eg3",
    "eg003_members": "SELECT finding_key, alert_id FROM eg3 JOIN eg3_alerts USING (entity_id, recurrence_key)",
    "ns001_silent_assets": "SELECT finding_key, entity_id, asset_id, criticality AS asset_criticality, expected_telemetry FROM ns1",
    "ns002_vanished_telemetry": f"SELECT finding_key, entity_id, asset_id, n AS baseline_observation_count, {_ts('last_seen')} AS last_evidence_at, format('{{:.3f}}', silence::DOUBLE)::DOUBLE AS silence_hours FROM ns2",
    "ns002_members": "SELECT finding_key, telemetry_id FROM ns2 JOIN telemetry t ON t.asset_id = ns2.asset_id",
    "pb001_peer_deviation": "SELECT finding_key, entity_id, grp AS peer_group, metric_name, v AS entity_value, round(m, 6) AS peer_baseline, n AS peer_population_count, round(measure, 6) AS deviation_measure, basis AS deviation_basis, direction FROM pb",
    "pb001_peer_status": f"""SELECT 'INSUFFICIENT_PEERS' AS status, entity_id, {_ym('period_start')} AS period_label, sector AS peer_group,
        (SELECT count(*) - 1 FROM kpi k2 JOIN entities e2 USING (entity_id) WHERE e2.sector = e.sector AND k2.period_start = k.period_start) AS peer_population_count
        FROM kpi k JOIN entities e USING (entity_id)
        WHERE (SELECT count(*) - 1 FROM kpi k2 JOIN entities e2 USING (entity_id) WHERE e2.sector = e.sector AND k2.period_start = k.period_start) < 5""",
    "trend_scores": "SELECT entity_id, metric_name, grp AS metric_group, n, round(score, 6) AS trend_score FROM trends",
    "mrd001_divergence": f"""SELECT finding_key, entity_id, n AS supporting_period_count, round(h, 6) AS headline_trend_score, round(q, 6) AS quality_trend_score,
        CASE WHEN n >= 5 AND h / 0.05::DOUBLE >= 2 AND abs(q) / 0.05::DOUBLE >= 2 THEN 'HIGH' ELSE 'MODERATE' END AS confidence, {_ts('we')} AS window_end FROM mrd""",
    "mrd001_skipped": f"""SELECT entity_id, count(*) AS supporting_period_count FROM kpi JOIN entities USING (entity_id)
        WHERE period_start < data_period_end GROUP BY entity_id HAVING count(*) < 28""",
    "metric_snapshots": f"SELECT entity_id, metric_name, grp AS metric_group, {_ym('period_start')} AS period_label, v AS value FROM trend_points",
    "action_sequences": "SELECT investigation_id, seq AS sequence, n_actions AS action_count, dup AS has_duplicate_numbers FROM seqs",
    "investigation_records": f"SELECT investigation_id, entity_id, alert_id, status, severity AS alert_severity, {_ym('period_start')} AS period_label, letters, n_actions AS action_count FROM recs",
    "sequence_counts": f"SELECT entity_id, {_ym('period_start')} AS period_label, seq AS sequence, n AS matching, first_inv AS first_seen FROM fp_counts",
    "if_rep001_repetitive": "SELECT finding_key, entity_id, seq AS sequence, n AS matching_investigation_count, total AS window_investigation_count, round(n::DOUBLE / total, 6) AS repetition_rate, CASE WHEN n >= 6 AND n::DOUBLE / total >= 0.8::DOUBLE THEN 'HIGH' WHEN n::DOUBLE / total >= 0.5 THEN 'MODERATE' ELSE 'LOW' END AS confidence FROM rep",
    "if_rep001_members": "SELECT finding_key, e.investigation_id FROM rep JOIN elig e USING (entity_id, period_start, letters)",
    "running_baseline": "SELECT investigation_id, entity_id, letters, b_letters AS baseline_letters, b_n AS baseline_investigation_count, n_prior FROM baseline",
    "if_dev002_deviation": "SELECT finding_key, entity_id, seq AS observed_sequence, b_seq AS baseline_sequence, b_n AS baseline_investigation_count, round(dist, 6) AS normalized_distance, CASE WHEN dist >= 0.6::DOUBLE + 0.2::DOUBLE AND b_n >= 6 THEN 'HIGH' WHEN b_n >= 3 THEN 'MODERATE' ELSE 'LOW' END AS confidence FROM dev",
    "if_mea003_missing_action": "SELECT finding_key, entity_id, alert_id, severity AS alert_severity, seq AS observed_sequence, n_actions AS action_count, CASE WHEN n_actions >= 6 THEN 'HIGH' WHEN n_actions >= 3 THEN 'MODERATE' ELSE 'LOW' END AS confidence FROM mea",
    "an001_notable_features": f"""SELECT entity_id, {_ym('period_start')} AS period_label, place, feature, round(v, 6) AS value, round(med, 6) AS population_median FROM (
        SELECT *, row_number() OVER (PARTITION BY entity_id, period_start ORDER BY round(abs(v - med) / CASE WHEN q3 > q1 THEN q3 - q1 ELSE 1 END, 9) DESC, feature) AS place
        FROM feature_long JOIN (SELECT feature, quantile_cont(v, 0.25) AS q1, median(v) AS med, quantile_cont(v, 0.75) AS q3 FROM feature_long GROUP BY feature) USING (feature)) WHERE place <= 3""",
    "an001_status": "SELECT CASE WHEN (SELECT count(*) FROM complete) >= 20 THEN 'OK' ELSE 'INSUFFICIENT_SAMPLE' END AS status, (SELECT count(*) FROM features) AS observation_count, (SELECT count(*) FROM complete) AS scored_observation_count, (SELECT count(*) FROM features) - (SELECT count(*) FROM complete) AS dropped_incomplete_count",
    "findings": "SELECT finding_key, analytic_id, finding_type, category, entity_id, period_label, severity AS alert_severity, confidence, factors AS confidence_factors, evidence_count FROM findings",
    "findings_of_category": "SELECT finding_key, analytic_id, entity_id, period_label, confidence FROM findings WHERE category = 'EXECUTION_GAP' AND entity_id = 'ENT-07'",
    "findings_page": "SELECT finding_key, analytic_id, finding_type, entity_id, period_label FROM findings ORDER BY finding_key LIMIT 50 OFFSET 100",
    "findings_after": """SELECT finding_key, entity_id, period_label FROM (SELECT *, min(finding_key) OVER () AS first_key FROM findings
        WHERE analytic_id = 'IF-DEV-002' AND period_label = (SELECT max(period_label) FROM findings WHERE analytic_id = 'IF-DEV-002'))
        WHERE finding_key > first_key ORDER BY finding_key LIMIT 50""",
    "finding_one": "SELECT finding_key, analytic_id, entity_id, evidence_count FROM findings WHERE finding_key = (SELECT min(finding_key) FROM findings WHERE analytic_id = 'EG-001')",
    "findings_by_category": "SELECT c AS category, count(finding_key) AS n FROM (VALUES ('EXECUTION_GAP'), ('MONITORING_GAP'), ('ANOMALY'), ('PEER_DEVIATION'), ('METRIC_RISK_DIVERGENCE'), ('WORKFLOW_PATTERN')) v(c) LEFT JOIN findings ON category = c GROUP BY c",
    "evidence_planted": "SELECT DISTINCT finding_key, source_type, source_id || '-gone' AS source_id FROM refs WHERE analytic_id || ' ' || source_type IN ('EG-001 ALERT', 'EG-002 ASSET', 'IF-REP-001 INVESTIGATION')",
    "findings_hash": """SELECT way, count(*) AS n_rows, sum(h)::VARCHAR AS sum_hash, bit_xor(h) AS xor_hash FROM (SELECT ('0x' || substr(sha256(
        strlen(finding_key) || ':' || finding_key || strlen(analytic_id) || ':' || analytic_id || strlen(entity_id) || ':' || entity_id
        || coalesce(strlen(period_label) || ':' || period_label, '-') || coalesce(strlen(confidence) || ':' || confidence, '-')
        || coalesce(strlen(evidence_count::VARCHAR) || ':' || evidence_count, '-')), 1, 15))::BIGINT AS h FROM findings), (VALUES ('whole'), ('parts')) v(way) GROUP BY way""",
    "telemetry_stream": f"""SELECT entity_id, asset_id, {_ts('w')} AS window_start, count(*) AS records, sum(event_count)::BIGINT AS event_count, {_ts('max(period_start)')} AS last_seen,
        count(*) FILTER (event_count = 0) AS silent_records FROM (SELECT *, time_bucket(INTERVAL 7 DAY, period_start, TIMESTAMP '1970-01-01') AS w FROM telemetry)
        WHERE w + INTERVAL 7 DAY <= (SELECT max(period_start) FROM telemetry) - INTERVAL 10 DAY GROUP BY entity_id, asset_id, w""",
    "evidence_refs": "SELECT DISTINCT finding_key, analytic_id, source_type, source_id, role, period_label FROM refs",
    "evidence_unsupported": "SELECT finding_key, source_type, source_id FROM refs WHERE source_type = 'ALERT' AND source_id NOT IN (SELECT alert_id FROM alerts) OR source_type = 'ASSET' AND source_id NOT IN (SELECT asset_id FROM assets) OR source_type = 'INVESTIGATION' AND source_id NOT IN (SELECT investigation_id FROM investigations)",
    "queue_items": "SELECT queue_id, finding_key, analytic_id, finding_type, entity_id, period_label, title, category, priority, confidence, evidence_count, finding_version FROM items",
    "queue_merge": "SELECT queue_id, finding_key, outcome, status, finding_version, created_at, updated_at, reviewer_ref FROM merged",
    "queue_transitions": "SELECT queue_id, new_status, result FROM judged",
    "queue_after_transitions": """SELECT o.queue_id, coalesce(j.new_status, o.status) AS status,
        CASE WHEN j.new_status IN ('DISMISSED', 'IN_REVIEW') THEN 'second' WHEN o.status IN ('REVIEWED', 'DISMISSED', 'IN_REVIEW') THEN 'reviewer' END AS reviewer_ref,
        CASE WHEN j.queue_id IS NULL THEN '2024-02-01 00:00:00' ELSE '2024-02-02 00:00:00' END AS updated_at
        FROM old_queue o LEFT JOIN (SELECT * FROM judged WHERE result = 'APPLIED') j ON o.queue_id = j.queue_id""",
    "queue_stored": "SELECT queue_id, finding_key, status, finding_version, created_at, updated_at, reviewer_ref FROM merged",
    "queue_stored_moves": """SELECT o.queue_id, o.status AS status_before, coalesce(j.new_status, o.status) AS status,
        CASE WHEN j.new_status IN ('DISMISSED', 'IN_REVIEW') THEN 'second' WHEN o.status IN ('REVIEWED', 'DISMISSED', 'IN_REVIEW') THEN 'reviewer' END AS reviewer_ref,
        CASE WHEN j.queue_id IS NULL THEN '2024-02-01 00:00:00' ELSE '2024-02-02 00:00:00' END AS updated_at
        FROM old_queue o LEFT JOIN (SELECT * FROM judged WHERE result = 'APPLIED') j ON o.queue_id = j.queue_id""",
    "queue_summary": """SELECT v.d AS dimension, v.l AS level, count(m.queue_id) AS n FROM (VALUES ('status', 'OPEN'), ('status', 'IN_REVIEW'), ('status', 'REVIEWED'), ('status', 'DISMISSED'),
        ('priority', 'CRITICAL'), ('priority', 'HIGH'), ('priority', 'MEDIUM'), ('priority', 'LOW'), ('category', 'EXECUTION_GAP'), ('category', 'MONITORING_GAP'), ('category', 'ANOMALY'),
        ('category', 'PEER_DEVIATION'), ('category', 'METRIC_RISK_DIVERGENCE'), ('category', 'WORKFLOW_PATTERN'), ('total', 'ALL')) v(d, l)
        LEFT JOIN merged m ON (v.d = 'status' AND m.status = v.l) OR (v.d = 'priority' AND m.priority = v.l) OR (v.d = 'category' AND m.category = v.l) OR v.d = 'total' GROUP BY ALL""",
    "queue_outcomes": """SELECT o AS outcome, count(finding_key) AS n FROM (VALUES ('INSERTED'), ('UPDATED'), ('UNCHANGED'), ('KEPT'), ('TOTAL')) v(o)
        LEFT JOIN merged ON outcome = o OR o = 'TOTAL' GROUP BY o""",
    "queue_one": "SELECT queue_id, finding_key, priority, status FROM merged WHERE queue_id = (SELECT min(queue_id) FROM merged WHERE priority = 'HIGH')",
    "queue_page": "SELECT queue_id, finding_key, priority, status FROM merged WHERE status = 'OPEN' ORDER BY CASE priority WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END, created_at DESC, queue_id LIMIT 50 OFFSET 25",
    "queue_pages": """SELECT CASE WHEN place < total // 2 + 40 THEN 'deep' ELSE 'next' END AS page, queue_id, finding_key, priority, status, total FROM (
        SELECT *, count(*) OVER () AS total, row_number() OVER (ORDER BY CASE priority WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END, created_at DESC, queue_id, finding_key) - 1 AS place FROM merged)
        WHERE place >= total // 2 AND place < total // 2 + 80""",
    "findings_pages": """SELECT finding_key, analytic_id, entity_id, total FROM (SELECT *, count(*) OVER () AS total, row_number() OVER (ORDER BY finding_key) - 1 AS place FROM findings)
        WHERE place >= greatest(0, total - 75) AND place < greatest(0, total - 75) + 50""",
    "queue_of_entity": "SELECT queue_id, finding_key, priority, status FROM merged WHERE entity_id = 'ENT-03' AND category = 'WORKFLOW_PATTERN' AND priority = 'LOW'",
    "entity_list_after": f"SELECT entity_id, name, sector, peer_group, scale, asset_count_estimate, analyst_headcount, {_ts('data_period_start')} AS data_period_start, {_ts('data_period_end')} AS data_period_end FROM entities WHERE entity_id > 'ENT-19' ORDER BY entity_id LIMIT 20",
    "entity_one": f"SELECT entity_id, name, sector, peer_group, scale, asset_count_estimate, analyst_headcount, {_ts('data_period_start')} AS data_period_start, {_ts('data_period_end')} AS data_period_end FROM entities WHERE entity_id = 'ENT-07'",
    "entity_list": f"SELECT entity_id, name, sector, peer_group, scale, asset_count_estimate, analyst_headcount, {_ts('data_period_start')} AS data_period_start, {_ts('data_period_end')} AS data_period_end FROM entities ORDER BY entity_id LIMIT 20 OFFSET 0",
}


def _number(check: str, sql: str) -> str:
    return f"SELECT '{check}' AS \"check\", ({sql})::BIGINT AS violations"


_AUDIT = [
    _number(f"{name}: key unique", f"SELECT count(*) - count(DISTINCT {key}) FROM {cte}")
    for name, cte, key in (
        ("entities", "entities", "entity_id"), ("assets", "assets", "asset_id"), ("alerts", "alerts", "alert_id"),
        ("investigations", "investigations", "investigation_id"), ("investigation_actions", "actions", "action_id"),
        ("escalations", "escalations", "escalation_id"), ("remediations", "remediations", "remediation_id"),
        ("telemetry", "telemetry", "telemetry_id"), ("performance_metrics", "kpi", "metric_id"),
    )
] + [
    _number(f"{name}: {col} exists", f"SELECT count(*) FROM {cte} WHERE {col} IS NOT NULL AND {col} NOT IN (SELECT {col} FROM {parent})")
    for name, cte, col, parent in (
        ("assets", "assets", "entity_id", "entities"), ("alerts", "alerts", "entity_id", "entities"), ("alerts", "alerts", "asset_id", "assets"),
        ("investigations", "investigations", "alert_id", "alerts"), ("investigations", "investigations", "entity_id", "entities"),
        ("investigation_actions", "actions", "investigation_id", "investigations"),
        ("escalations", "escalations", "alert_id", "alerts"), ("escalations", "escalations", "investigation_id", "investigations"),
        ("remediations", "remediations", "alert_id", "alerts"), ("remediations", "remediations", "investigation_id", "investigations"),
        ("telemetry", "telemetry", "entity_id", "entities"), ("telemetry", "telemetry", "asset_id", "assets"),
        ("performance_metrics", "kpi", "entity_id", "entities"),
    )
] + [
    _number(f"{name}: {later} not before {earlier}", f"SELECT count(*) FROM {cte} WHERE {later} < {earlier}")
    for name, cte, earlier, later in (
        ("entities", "entities", "data_period_start", "data_period_end"), ("alerts", "alerts", "created_at", "acknowledged_at"),
        ("alerts", "alerts", "created_at", "closed_at"), ("investigations", "investigations", "started_at", "ended_at"),
        ("escalations", "escalations", "created_at", "resolved_at"), ("remediations", "remediations", "created_at", "completed_at"),
        ("telemetry", "telemetry", "period_start", "period_end"), ("performance_metrics", "kpi", "period_start", "period_end"),
    )
] + [
    _number("investigations: alert_id unique", "SELECT count(*) - count(DISTINCT alert_id) FROM investigations"),
    _number("performance_metrics: one row per period", "SELECT count(*) - count(DISTINCT (entity_id, period_start)) FROM kpi"),
    _number("investigation_actions: numbers run 1..n", "SELECT count(*) FROM (SELECT investigation_id FROM spans GROUP BY investigation_id HAVING NOT (min(sequence_number) = 1 AND max(sequence_number) = sum(n) AND count(*) = sum(n)))"),
    _number("investigation_actions: time does not go back", "SELECT count(*) FROM spans WHERE f < before"),
    _number("investigation_actions: within the investigation", "SELECT count(*) FROM actions a JOIN investigations i ON a.investigation_id = i.investigation_id WHERE occurred_at < started_at OR occurred_at > ended_at"),
    _number("assets: severe ones are monitored", "SELECT count(*) FROM assets WHERE criticality IN ('HIGH', 'CRITICAL') AND (NOT monitoring_expected OR expected_telemetry IS NULL)"),
    _number("telemetry: only of monitored assets", "SELECT count(*) FROM telemetry WHERE asset_id NOT IN (SELECT asset_id FROM assets WHERE monitoring_expected)"),
]

_log = [("entities", "entities"), ("assets", "assets"), ("alerts", "alerts WHERE status = 'CLOSED'"), ("alerts", "alerts WHERE status = 'ACKNOWLEDGED'"), ("alerts", "alerts WHERE status = 'IN_INVESTIGATION'")]
_QUERIES |= {
    "store_round_trip": f"SELECT alert_id, entity_id, asset_id, severity, status, {_ts('created_at')} AS created_at, {_ts('acknowledged_at')} AS acknowledged_at, {_ts('closed_at')} AS closed_at, recurrence_key, is_true_positive FROM alerts",
    "store_import_log": " UNION ALL ".join(
        [f"SELECT '{name}' AS dataset_type, 'APPEND' AS mode, 'COMPLETED' AS status, count(*) AS row_count, count(*) AS accepted_count, 0 AS rejected_count, 0 AS error_count FROM {rows}" for name, rows in _log]
        # Every row that is stored already is one duplicate.
        + [f"SELECT '{name}', 'APPEND', 'REJECTED', count(*), 0, count(*), count(*) FROM {rows}" for name, rows in (_log[0], _log[2], _log[3])]
        + ["SELECT 'entities', 'REPLACE', 'ROLLED_BACK', count(*), 0, count(*), 0 FROM entities WHERE entity_id < 'ENT-03'"]
    ),
}

_severity = "CASE WHEN code = 'invalid_field_type' THEN 'structural' ELSE 'semantic' END"
_QUERIES |= {
    "ingest_alert_issues": f"SELECT row, field, code, {_severity} AS severity FROM alert_issues",
    "ingest_csv_file": f"SELECT row, field, code, {_severity} AS severity FROM alert_issues",
    "ingest_json_lines_file": f"SELECT row, field, code, {_severity} AS severity FROM alert_issues",
    "ingest_spanning_csv": """SELECT o_orderkey + 1 AS row, CASE o_orderpriority WHEN '1-URGENT' THEN NULL WHEN '4-NOT SPECIFIED' THEN NULL WHEN '2-HIGH' THEN 'HIGH' WHEN '3-MEDIUM' THEN 'MEDIUM' ELSE 'LOW' END AS severity,
        CASE WHEN o_totalprice >= 200000 THEN 'key "' || o_custkey || '",' || chr(10) || chr(10) || 'of ' || o_orderpriority || chr(10) || '.' END AS recurrence_key FROM orders""",
    "ingest_json_document": f"SELECT form, row, field, code, {_severity} AS severity FROM alert_issues, (VALUES ('list'), ('records')) v(form)",
    "ingest_structure": """SELECT format, NULL::BIGINT AS row, field, code, 'structural' AS severity FROM (VALUES ('csv'), ('jsonl'), ('json')) v(format),
        (VALUES ('severity', 'missing_required_column'), ('category', 'missing_required_column'), ('colour', 'unknown_column')) w(field, code) WHERE EXISTS (SELECT 1 FROM orders)""",
    "ingest_alert_report": f"SELECT code, {_severity} AS severity, count(*) AS errors, count(DISTINCT row) AS rejected_rows FROM alert_issues GROUP BY code",
    "ingest_alert_accepted": """SELECT row, alert_id, severity, CASE st WHEN 'F' THEN 'MALWARE' ELSE 'PHISHING' END AS category,
        CASE st WHEN 'F' THEN 'CLOSED' ELSE 'IN_INVESTIGATION' END AS status, CASE WHEN p >= 100000 THEN TRUE WHEN p >= 50000 THEN FALSE END AS is_true_positive
        FROM raw_alerts WHERE row NOT IN (SELECT row FROM alert_issues)""",
    "ingest_telemetry_issues": f"""SELECT row, field, code, {_severity} AS severity FROM (
        SELECT row, 'event_count' AS field, 'invalid_field_type' AS code FROM raw_telemetry WHERE kind IN ('view', 'signup')
        UNION ALL SELECT row, 'event_count', 'negative_value' FROM raw_telemetry WHERE kind = 'error'
        UNION ALL SELECT row, 'activity_level', 'invalid_field_type' FROM raw_telemetry WHERE kind IN ('click', 'error')
        UNION ALL SELECT row, 'activity_level', 'negative_value' FROM raw_telemetry WHERE kind = 'view' OR (kind IN ('signup', 'purchase') AND value < 0)
        UNION ALL SELECT row, 'expected', 'invalid_field_type' FROM raw_telemetry WHERE kind = 'error')""",
    "ingest_telemetry_values": """SELECT row, CASE kind WHEN 'click' THEN k::BIGINT WHEN 'error' THEN -('1' || k)::BIGINT WHEN 'purchase' THEN k::BIGINT * 100 END AS event_count,
        CASE WHEN kind = 'view' THEN -0.5::DOUBLE WHEN kind IN ('signup', 'purchase') THEN round(value, 2) END AS activity_level,
        CASE WHEN kind IN ('view', 'signup', 'purchase') THEN TRUE WHEN kind = 'click' THEN FALSE END AS expected FROM raw_telemetry""",
    "dataset_audit": " UNION ALL ".join(_AUDIT),
    "scenario_evaluation": """SELECT scenario_type, expected, count(*) AS planted, count(*) FILTER (hit) AS hits,
        CASE WHEN expected = 'NONE' AND count(*) FILTER (hit) = 0 THEN 'CONTROL_CLEAN' WHEN expected = 'NONE' THEN 'CONTROL_FLAGGED'
          WHEN count(*) FILTER (hit) > 0 THEN 'DETECTED' ELSE 'MISSED' END AS verdict FROM (
        SELECT g.*, EXISTS (SELECT 1 FROM findings f WHERE f.entity_id = g.entity_id AND CASE expected WHEN 'ESCALATION_GAP' THEN finding_type = 'CRITICAL_ALERT_NO_ESCALATION'
          WHEN 'TELEMETRY_DISAPPEARANCE' THEN finding_type = 'TELEMETRY_CONTINUITY_GAP' WHEN 'METRIC_RISK_DIVERGENCE' THEN finding_type = 'METRIC_RISK_DIVERGENCE'
          WHEN 'NONE' THEN finding_type = 'REPETITIVE_WORKFLOW' ELSE TRUE END) AS hit FROM ground g) GROUP BY scenario_type, expected""",
}


def statements() -> dict[str, str]:
    return {name: _with(sql) for name, sql in _QUERIES.items()}
