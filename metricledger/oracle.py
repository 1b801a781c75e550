"""DuckDB twins of the registered queries.

Written apart from the Spark code: the log's identity columns come from the template a row was
made from, not from reading the expression text, and the joins are plain SQL.
"""

from __future__ import annotations

from metricledger import registry as reg
from metricledger.params import TimeRange


def _pn(n: str) -> str:
    return f"concat('m_', {n}, CASE ({n}) % 4 WHEN 1 THEN '_total' WHEN 2 THEN '_bucket' ELSE '' END)"


def _pct(part: str, whole: str) -> str:
    return f"round(CAST({part} AS DOUBLE) * 100.0 / nullif(CAST({whole} AS DOUBLE), 0.0), 2)"


_EV = """ev AS (
  SELECT *, user_id AS m, CAST(json_extract_string(props, '$.k') AS INT) AS k, event_id % 8 AS tpl FROM events
)"""

_LOG = f"""named AS (
  SELECT *, {_pn('m')} AS m1, {_pn('(m + 1)')} AS m2, concat('job="j', k % 10, '"') AS jb FROM ev
), ql AS (
  SELECT event_id AS query_id, ts, tpl, m1, m2,
    CASE tpl WHEN 0 THEN m1
      WHEN 1 THEN m1 || '{{' || jb || ',env="prod"}}'
      WHEN 2 THEN m1 || '{{env="dev", ' || jb || '}}'
      WHEN 3 THEN 'rate(' || m1 || '[5m])'
      WHEN 4 THEN 'sum by (job, env) (rate(' || m1 || '{{' || jb || '}}[5m]))'
      WHEN 5 THEN 'sum by (env, job) (rate(' || m1 || '{{' || jb || '}}[5m]))'
      WHEN 6 THEN m1 || ' / on(job, instance) group_left(team) ' || m2 || '{{job=~"j.*"}}'
      ELSE 'rate(' || m1 || '[' END AS query_param,
    CASE tpl WHEN 0 THEN m1
      WHEN 1 THEN m1 || '{{env="MASKED",job="MASKED"}}'
      WHEN 2 THEN m1 || '{{env="MASKED",job="MASKED"}}'
      WHEN 3 THEN 'rate(' || m1 || '[5m])'
      WHEN 6 THEN m1 || ' / on (instance, job) group_left (team) ' || m2 || '{{job=~"MASKED"}}'
      WHEN 7 THEN ''
      ELSE 'sum by (env, job) (rate(' || m1 || '{{job="MASKED"}}[5m]))' END AS canonical,
    CASE tpl WHEN 0 THEN '__name__=' || m1
      WHEN 1 THEN '__name__=' || m1 || ',env=prod,job=j' || (k % 10)
      WHEN 2 THEN '__name__=' || m1 || ',env=dev,job=j' || (k % 10)
      WHEN 3 THEN '__name__=' || m1
      WHEN 6 THEN '__name__=' || m1 || ';__name__=' || m2 || ',job=j.*'
      WHEN 7 THEN NULL
      ELSE '__name__=' || m1 || ',job=j' || (k % 10) END AS label_matchers,
    CAST(floor(value) AS BIGINT) AS duration_ms,
    CAST(CASE WHEN event_type <> 'error' THEN 200 WHEN event_id % 2 = 0 THEN 500 ELSE 422 END AS INT) AS status_code,
    CAST(event_id % 4096 AS INT) AS body_size,
    CASE WHEN event_id % 3 = 0 THEN 'instant' ELSE 'range' END AS type,
    CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(15.0 AS DOUBLE) END AS step,
    CASE WHEN event_id % 3 = 0 THEN ts ELSE ts - to_hours(k * k) END AS start_ts,
    ts AS end_ts,
    CAST(floor(value * 10) AS BIGINT) AS total_queryable_samples,
    CAST(floor(value) AS BIGINT) % 97 AS peak_samples,
    concat('client-', user_id % 5) AS user_agent,
    strftime(ts, '%Y-%m-%d') AS dt
  FROM named
), log AS (
  SELECT *, CASE WHEN canonical = '' THEN '' ELSE substr(md5(canonical), 1, 16) END AS fingerprint FROM ql
)"""

_RULES = f"""rule_push AS (
  SELECT {_pn('user_id')} AS serie, concat('g', k % 3) AS group_name, concat('r', k % 4) AS name,
    concat('expr_', k % 2) AS expression, CASE WHEN k % 5 < 3 THEN 'alert' ELSE 'record' END AS kind,
    'sev,team' AS labels, ts AS seen_at
  FROM ev WHERE event_type = 'signup'
), rules AS (
  SELECT serie, group_name, name, expression, kind, labels, min(seen_at) AS created_at,
    min(seen_at) AS first_seen_at, max(seen_at) AS last_seen_at
  FROM rule_push GROUP BY ALL
)"""

_DASH = f"""dash_push AS (
  SELECT concat('d', user_id) AS id, {_pn('(user_id + k)')} AS serie,
    concat('Dash ', user_id, ' v', event_id % 3) AS name, concat('http://d/', user_id, '?v=', event_id % 3) AS url,
    ts AS seen_at, event_id AS seq
  FROM ev WHERE event_type = 'view'
), dash AS (
  SELECT id, serie, arg_max(name, row(seen_at, seq)) AS name, arg_max(url, row(seen_at, seq)) AS url,
    min(seen_at) AS created_at, min(seen_at) AS first_seen_at, max(seen_at) AS last_seen_at
  FROM dash_push GROUP BY id, serie
)"""

_CATALOG = """meta AS (
  SELECT concat('m_', c_custkey, CASE WHEN c_custkey % 4 = 1 THEN '_total' ELSE '' END) AS name,
    CASE c_custkey % 4 WHEN 0 THEN 'gauge' WHEN 1 THEN 'counter' WHEN 2 THEN 'histogram' ELSE 'summary' END AS type,
    concat('help ', c_mktsegment) AS help, CASE WHEN c_custkey % 3 = 0 THEN 'seconds' ELSE 'bytes' END AS unit,
    CASE WHEN c_custkey % 10 = 9 THEN TIMESTAMP '2023-11-01' ELSE TIMESTAMP '2024-01-30' END AS synced_at,
    c_custkey AS seq
  FROM customer
), expansion(base, ns, ts_, hs, keep) AS (VALUES
  ('histogram', '_bucket', 'histogram_bucket', ' (histogram buckets)', TRUE),
  ('histogram', '_count', 'histogram_count', ' (histogram count)', FALSE),
  ('histogram', '_sum', 'histogram_sum', ' (histogram sum)', TRUE),
  ('summary', '', 'summary', '', TRUE),
  ('summary', '_count', 'summary_count', ' (summary count)', FALSE),
  ('summary', '_sum', 'summary_sum', ' (summary sum)', TRUE)
), meta_rows AS (
  SELECT name || coalesce(ns, '') AS name, coalesce(ts_, type) AS type, help || coalesce(hs, '') AS help,
    CASE WHEN coalesce(keep, TRUE) THEN unit ELSE '' END AS unit, synced_at, seq
  FROM meta LEFT JOIN expansion ON base = type
), catalog AS (
  SELECT name, type, help, unit, synced_at AS first_seen_at, synced_at AS last_synced_at FROM meta_rows
)"""

_JOBS = f"""jobs AS (
  SELECT {_pn('user_id')} AS name, concat('j', k % 10) AS job, max(ts) AS updated_at FROM ev GROUP BY 1, 2
)"""

_SERIES = f"""series AS (
  SELECT DISTINCT {_pn('user_id')} AS name,
    CASE WHEN event_id % 7 <> 0 THEN concat('j', k % 10) END AS job, concat('i', event_id % 5) AS instance
  FROM ev
)"""

_OTLP = """om AS (
  SELECT l_orderkey AS export_id, l_linenumber AS line,
    concat('m_', l_partkey, CASE WHEN l_partkey % 4 = 1 THEN '_total' ELSE '' END) AS metric_name,
    concat('m_', l_partkey) AS raw_name,
    CASE l_partkey % 4 WHEN 0 THEN 'gauge' WHEN 1 THEN 'sum' WHEN 2 THEN 'histogram' ELSE 'summary' END AS data_type,
    l_partkey % 4 = 1 AS is_monotonic,
    concat('desc ', l_partkey % 7) AS description,
    CASE WHEN l_partkey % 3 = 0 THEN 's' ELSE 'By' END AS unit,
    CASE l_suppkey % 10 WHEN 0 THEN 'svc0' WHEN 9 THEN '' ELSE concat('j', l_suppkey % 10) END AS job,
    CAST(l_quantity AS BIGINT) % 4 AS points
  FROM lineitem
)"""


def _between(tr: TimeRange, ts: str = "ts") -> str:
    return f"{ts} BETWEEN TIMESTAMP '{tr.start}' AND TIMESTAMP '{tr.end}'"


def _half_open(tr: TimeRange, ts: str = "ts") -> str:
    return f"{ts} >= TIMESTAMP '{tr.start}' AND {ts} < TIMESTAMP '{tr.end}'"


def _overlap(tr: TimeRange) -> str:
    return f"first_seen_at <= TIMESTAMP '{tr.end}' AND last_seen_at >= TIMESTAMP '{tr.start}'"


def _summary_cte(tr: TimeRange, name: str = "summ") -> str:
    return f"""{name} AS (
  SELECT c.name, coalesce(ra.a, 0) AS alert_count, coalesce(ra.r, 0) AS record_count,
    coalesce(da.d, 0) AS dashboard_count, coalesce(qa.q, 0) AS query_count, qa.last_queried_at,
    coalesce(ra.a, 0) + coalesce(ra.r, 0) + coalesce(da.d, 0) + coalesce(qa.q, 0) = 0 AS is_unused
  FROM catalog c
  LEFT JOIN (SELECT serie AS name, count(*) FILTER (WHERE kind = 'alert') AS a,
      count(*) FILTER (WHERE kind = 'record') AS r FROM rules WHERE {_overlap(tr)} GROUP BY 1) ra USING (name)
  LEFT JOIN (SELECT serie AS name, count(DISTINCT id) AS d FROM dash WHERE {_overlap(tr)} GROUP BY 1) da USING (name)
  LEFT JOIN (SELECT m1 AS name, count(*) AS q, max(ts) AS last_queried_at FROM log
      WHERE tpl <> 7 AND {_between(tr)} GROUP BY 1) qa USING (name)
  WHERE c.last_synced_at >= TIMESTAMP '{tr.start}'
)"""


_SUMMARY = [_EV, _LOG, _RULES, _DASH, _CATALOG, _summary_cte(reg.FULL)]
_UNUSED = """variants(data_type, suffix) AS (VALUES ('gauge', ''), ('sum', ''), ('histogram', '_bucket'),
  ('histogram', '_count'), ('histogram', '_sum'), ('summary', ''), ('summary', '_count'), ('summary', '_sum')
), unused AS (
  SELECT o.metric_name FROM (SELECT DISTINCT metric_name, data_type FROM om) o
  JOIN variants v USING (data_type)
  LEFT JOIN known s ON s.name = o.metric_name || v.suffix
  GROUP BY 1 HAVING bool_and(coalesce(s.is_unused, FALSE))
)"""
_WITH_UNUSED = [*_SUMMARY, _OTLP, "known AS (SELECT name, is_unused FROM summ)", _UNUSED]


def _with(ctes: list[str], body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


def _log(body: str) -> str:
    return _with([_EV, _LOG], body)


def _spine(tr: TimeRange, stride: str) -> str:
    return (
        f"spine AS (SELECT unnest(generate_series(date_trunc('minute', TIMESTAMP '{tr.start}'), "
        f"date_trunc('minute', TIMESTAMP '{tr.end}'), INTERVAL '{stride}')) AS time)"
    )


def _series_sql(tr: TimeRange, stride: str, columns: dict[str, str], where: str = "TRUE") -> str:
    aggs = ", ".join(f"{sql} AS {name}" for name, sql in columns.items())
    outs = ", ".join(f"coalesce({name}, 0) AS {name}" for name in columns)
    agg = (
        f"agg AS (SELECT time_bucket(INTERVAL '{stride}', ts, date_trunc('minute', TIMESTAMP '{tr.start}')) AS time, "
        f"{aggs} FROM log WHERE {_half_open(tr)} AND {where} GROUP BY 1)"
    )
    return _with([_EV, _LOG, _spine(tr, stride), agg], f"SELECT time, {outs} FROM spine LEFT JOIN agg USING (time)")


_STATUS = {
    "status_2xx": "count(*) FILTER (WHERE status_code BETWEEN 200 AND 299)",
    "status_4xx": "count(*) FILTER (WHERE status_code BETWEEN 400 AND 499)",
    "status_5xx": "count(*) FILTER (WHERE status_code BETWEEN 500 AND 599)",
}
_LATENCY = {
    "value": "round(avg(duration_ms), 2)",
    "p95": "CAST(floor(round(quantile_cont(duration_ms, 0.95), 2)) AS BIGINT)",
}


def _references(metric: str) -> str:
    return f"((tpl <> 7 AND m1 = '{metric}') OR (tpl = 6 AND m2 = '{metric}'))"


_RATE = (
    "count(*) FILTER (WHERE status_code BETWEEN 200 AND 299) AS success_total, "
    + _pct("count(*) FILTER (WHERE status_code BETWEEN 200 AND 299)", "count(*)")
    + " AS success_pct, count(*) FILTER (WHERE status_code >= 400) AS error_total, "
    + _pct("count(*) FILTER (WHERE status_code >= 400)", "count(*)")
    + " AS error_pct"
)

_RANGES = f"""spans AS (
  SELECT date_diff('second', start_ts, end_ts) AS s FROM log
  WHERE {_between(reg.FULL)} AND type = 'range' AND end_ts > start_ts
), labels(label, lo, hi) AS (VALUES ('<24h', 0, 1), ('24h', 1, 7), ('7d', 7, 30), ('30d', 30, 60), ('60d', 60, 90),
  ('90d+', 90, 1000000)
), dist AS (
  SELECT label, count(s) AS count, coalesce({_pct('count(s)', '(SELECT count(*) FROM spans)')}, 0.0) AS percent
  FROM labels LEFT JOIN spans ON s >= lo * CAST(86400 AS BIGINT) AND s < hi * CAST(86400 AS BIGINT) GROUP BY label
)"""

_EXPRESSIONS = f"""expr AS (
  SELECT fingerprint, arg_max(query_param, row(ts, query_param)) AS query, count(*) AS executions,
    round(avg(duration_ms), 2) AS avg_duration, {_pct('count(*) FILTER (WHERE status_code >= 400)', 'count(*)')} AS error_rate_pct,
    max(peak_samples) AS peak_samples
  FROM log WHERE {_between(reg.FULL)} GROUP BY 1
)"""

_COUNTS = "alert_count, record_count, dashboard_count, query_count"
_COALESCED = ", ".join(f"coalesce(s.{c}, 0) AS {c}" for c in _COUNTS.split(", "))
_NAMES = ", ".join(f"'{n}'" for n in reg.NAMES)
_PLACED = """placed AS (
  SELECT name, alert_count, record_count, dashboard_count, query_count, last_queried_at, is_unused FROM summ
  UNION ALL
  SELECT name, 0, 0, 0, 0, NULL, FALSE FROM catalog WHERE name NOT IN (SELECT name FROM summ)
)"""
_ACTIVE = (
    "job IN (" + ", ".join(f"'{j}'" for j in reg.ALLOW) + ") AND job NOT IN ("
    + ", ".join(f"'{j}'" for j in reg.DENY) + ")"
)
_DROPPED = f"(metric_name IN (SELECT metric_name FROM unused) AND {_ACTIVE})"
_OTLP_ITEMS = """items AS (
  SELECT metric_name AS name, CASE data_type WHEN 'sum' THEN 'counter' ELSE data_type END AS type, description AS help, unit FROM om
  UNION ALL SELECT metric_name || '_bucket', 'histogram', description, unit FROM om WHERE data_type = 'histogram'
  UNION ALL SELECT metric_name || '_sum', data_type, description, unit FROM om WHERE data_type IN ('histogram', 'summary')
  UNION ALL SELECT metric_name || '_count', data_type, description, '' FROM om WHERE data_type IN ('histogram', 'summary')
)"""
_PUSHED = (
    "query_param, ts AS time_param, duration_ms, status_code, body_size, type, coalesce(step, 0.0) AS step, "
    "start_ts, end_ts, total_queryable_samples, peak_samples"
)


def oracle_sql() -> dict[str, str]:
    full, metric, nxt, job = reg.FULL, reg.METRIC, reg.NEXT_METRIC, reg.JOB
    prev = reg.MIDDLE.previous()
    bad = "status_code >= 400"
    q: dict[str, str] = {}

    # sources and sinks
    q["query_log_append"] = _log(
        "SELECT query_id, ts, query_param, duration_ms, status_code, body_size, type, step, start_ts, end_ts, "
        "total_queryable_samples, peak_samples, fingerprint, label_matchers, user_agent, dt FROM log"
    )
    wrong = "CASE query_id % 50 WHEN 0 THEN 'unknown field surprise' " + " ".join(
        f"WHEN {n} THEN 'invalid field {field}'" for n, (field, _) in enumerate(reg.WRONG_FIELDS, 1)
    ) + " END"
    shown = f"SELECT query_id, {_PUSHED}, user_agent FROM log"
    whole = ("duration_ms", "status_code", "body_size", "total_queryable_samples", "peak_samples")
    fine = ", ".join(
        f"CASE WHEN query_id % 50 NOT BETWEEN 1 AND {len(reg.WRONG_FIELDS)} THEN {c} {'ELSE 0' if c in whole else ''} END AS {c}"
        for c in [*reg._PUSHED, "user_agent"]
    )
    q["query_push_read"] = _log(f"SELECT {fine}, {wrong} AS error FROM ({shown})")
    q["query_validate"] = _log(
        """, spoiled AS (SELECT query_id, query_id % 31 AS r, ts,
          CASE WHEN query_id % 31 = 4 THEN 'stream' ELSE type END AS type,
          CASE WHEN query_id % 31 = 6 THEN -1.0 ELSE step END AS step,
          CASE WHEN query_id % 31 <> 7 THEN start_ts END AS s,
          CASE WHEN query_id % 31 = 8 THEN start_ts - to_hours(1) WHEN query_id % 31 <> 9 THEN end_ts END AS e FROM log)
        SELECT query_id, CASE r WHEN 1 THEN 'missing query parameter' WHEN 2 THEN 'invalid body size'
          WHEN 3 THEN 'invalid duration' WHEN 4 THEN 'invalid query type' WHEN 5 THEN 'invalid status code'
          WHEN 6 THEN 'invalid step'
          ELSE CASE WHEN type = 'range' AND s IS NULL THEN 'missing start parameter'
            WHEN type = 'range' AND e IS NULL THEN 'missing end parameter'
            WHEN type = 'range' AND e < s THEN 'invalid range: end before start' END END AS error,
          CASE WHEN type = 'range' AND coalesce(step, 0) <= 0 THEN 15.0 ELSE coalesce(step, 0.0) END::DOUBLE AS step,
          CASE WHEN type = 'instant' THEN coalesce(s, ts) ELSE s END AS start_ts,
          CASE WHEN type = 'instant' THEN coalesce(e, ts) ELSE e END AS end_ts FROM spoiled""".lstrip()
    ).replace("\n, spoiled", ",\nspoiled")
    ok = "status_code = 200"
    q["response_stats_parse"] = _log(
        f"SELECT query_id, CASE WHEN {ok} THEN total_queryable_samples ELSE 0 END AS total_queryable_samples, "
        f"CASE WHEN {ok} THEN peak_samples ELSE 0 END AS peak_samples FROM log"
    )
    q["usage_push_rules"] = _with(
        [_EV, _RULES], "SELECT seen_at, serie, group_name, name, expression, kind FROM rule_push"
    )
    q["rule_sources_union"] = _with([_EV, _RULES], "SELECT serie, kind, count(*) AS rules FROM rule_push GROUP BY 1, 2")
    q["usage_push_dashboards"] = _with([_EV, _DASH], "SELECT seen_at, id, serie, name, url FROM dash_push")
    q["catalog_from_metadata"] = _with([_CATALOG], "SELECT name, type, help, unit, synced_at FROM meta_rows")
    q["catalog_from_names"] = _with(
        [_EV], f"SELECT DISTINCT {_pn('user_id')} AS name, '' AS type, '' AS help, '' AS unit FROM ev"
    )
    q["job_index_from_series"] = _with(
        [_EV, _SERIES], "SELECT DISTINCT name, job FROM series WHERE job IS NOT NULL"
    )
    q["otlp_flatten"] = _with(
        [_OTLP], "SELECT export_id, job, metric_name, data_type, is_monotonic, description, unit, points FROM om"
    )
    q["paged_result_write"] = _with(
        [_EV, _LOG, _EXPRESSIONS],
        "SELECT (SELECT count(*) FROM expr) AS total, CAST(ceil((SELECT count(*) FROM expr) / 20.0) AS BIGINT) AS total_pages, "
        "array_to_string(list(fingerprint ORDER BY executions DESC, fingerprint), ',') AS fingerprints FROM "
        "(SELECT fingerprint, executions FROM expr ORDER BY executions DESC, fingerprint LIMIT 20 OFFSET 20)",
    )

    # enrichment
    q["fingerprint"] = _log("SELECT DISTINCT query_param, fingerprint FROM log")
    q["canonical_expr"] = _log("SELECT DISTINCT query_param, canonical FROM log")
    q["canonical_expr_ignore_ranges"] = _log(
        "SELECT DISTINCT query_param, replace(canonical, '[5m]', '[0s]') AS canonical_any_range FROM log"
    )
    q["label_matchers"] = _log("SELECT DISTINCT query_param, label_matchers FROM log")
    q["metric_refs"] = _log(
        "SELECT query_id, m1 AS metric FROM log WHERE tpl <> 7 UNION ALL SELECT query_id, m2 FROM log WHERE tpl = 6"
    )
    q["header_extract"] = _with(
        [_EV],
        "SELECT event_id, concat('server=s', k % 3, ',user-agent=client-', user_id % 5, ',x-team=', "
        "CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END) AS headers FROM ev",
    )
    q["time_param_parse"] = _with(
        [_EV],
        "SELECT event_id, CASE event_id % 4 WHEN 2 THEN date_trunc('second', ts) + INTERVAL '500 milliseconds' "
        f"WHEN 3 THEN TIMESTAMP '{reg.NOW}' ELSE date_trunc('second', ts) END AS parsed FROM ev",
    )
    q["status_class"] = _log(
        "SELECT query_id, CASE status_code // 100 WHEN 2 THEN '2xx' WHEN 4 THEN '4xx' WHEN 5 THEN '5xx' END AS status_class FROM log"
    )
    q["range_seconds"] = _log("SELECT query_id, date_diff('second', start_ts, end_ts) AS seconds FROM log")
    q["prom_metric_name"] = _with([_OTLP], "SELECT DISTINCT metric_name, data_type FROM om")
    q["otlp_type_map"] = _with(
        [_OTLP],
        "SELECT data_type, CASE data_type WHEN 'sum' THEN 'counter' ELSE data_type END AS prom_type, "
        "count(*) AS metrics FROM om GROUP BY 1, 2",
    )
    q["otlp_catalog_items"] = _with(
        [_OTLP, _OTLP_ITEMS], "SELECT name, type, help, unit, count(*) AS sightings FROM items GROUP BY ALL"
    )
    q["resolve_job"] = _with([_OTLP], "SELECT job, count(*) AS metrics FROM om GROUP BY 1")

    # filters
    q["time_filter"] = _log(f"SELECT query_id, ts FROM log WHERE {_half_open(reg.UNALIGNED)}")
    q["presence_overlap"] = _with(
        [_EV, _DASH], f"SELECT id, serie, first_seen_at, last_seen_at FROM dash WHERE {_overlap(reg.TWO_HOURS)}"
    )
    q["ilike_contains"] = _log("SELECT query_id, query_param FROM log WHERE query_param ILIKE '%RATE(m%_total%'")
    q["fingerprint_filter"] = _log(
        f"SELECT query_id, query_param FROM log WHERE m1 = '{metric}' AND tpl IN (1, 2)"
    )
    q["metric_match_any"] = _log(f"SELECT query_id, query_param FROM log WHERE {_references(nxt)}")
    q["metric_match_first"] = _log(f"SELECT query_id, query_param FROM log WHERE tpl <> 7 AND m1 = '{nxt}'")
    q["type_family_filter"] = _with(
        [_CATALOG], "SELECT name, type FROM catalog WHERE type IN ('summary', 'summary_count', 'summary_sum')"
    )
    q["usage_state_filter"] = _with(_SUMMARY, f"SELECT name, {_COUNTS} FROM summ WHERE NOT is_unused")
    q["job_membership"] = _with(
        [_EV, _CATALOG, _JOBS],
        f"SELECT name, type FROM catalog WHERE name IN (SELECT name FROM jobs WHERE job = '{job}')",
    )
    described = f"c.name, c.type, c.help, c.unit, {_COALESCED}, s.last_queried_at"
    q["name_list_lookup"] = _with(
        _SUMMARY,
        f"SELECT {described}, coalesce(s.is_unused, FALSE) AS is_unused FROM catalog c LEFT JOIN summ s USING (name) "
        f"WHERE c.name IN ({_NAMES})",
    )

    # joins
    with_jobs = [*_SUMMARY, _JOBS]
    q["series_metadata"] = _with(
        with_jobs,
        f"SELECT {described} FROM catalog c LEFT JOIN summ s USING (name) WHERE c.name ILIKE '%m_1%' OR c.help ILIKE '%m_1%'",
    )
    q["series_metadata_indexed"] = q["series_metadata"]
    q["ilike_contains_indexed"] = _with(
        [_CATALOG], "SELECT name, type, help FROM catalog WHERE name ILIKE '%M_1%_coU%' OR help ILIKE '%M_1%_coU%'"
    )
    q["series_metadata_unused"] = _with(
        with_jobs, f"SELECT {described} FROM catalog c JOIN summ s USING (name) WHERE s.is_unused"
    )
    q["series_metadata_unused_job"] = _with(
        with_jobs,
        f"SELECT {described} FROM jobs j JOIN summ s USING (name) JOIN catalog c USING (name) WHERE s.is_unused AND j.job = '{job}'",
    )
    q["bucket_spine_join"] = _series_sql(reg.TWO_HOURS, "1 minute", {"value": "count(*)"})
    q["bucket_range_join"] = _with(
        [_EV, _LOG, _spine(reg.UNALIGNED, "1 hour")],
        "SELECT time, count(ts) AS value FROM spine LEFT JOIN log ON ts >= time AND ts < time + INTERVAL '1 hour' "
        f"AND {_half_open(reg.UNALIGNED)} GROUP BY 1",
    )
    q["scalar_cross_join"] = _log(
        "SELECT fingerprint, count(*) AS executions, (SELECT count(DISTINCT fingerprint) FROM log) AS total_count FROM log GROUP BY 1"
    )
    q["missing_summary_backfill"] = _with(
        _SUMMARY, "SELECT name FROM catalog WHERE name NOT IN (SELECT name FROM summ)"
    )

    # aggregations
    for key, tr in (("query_types", full), ("query_types_empty", reg.EMPTY)):
        q[key] = _log(
            f"SELECT count(*) AS total, {_pct('''count(*) FILTER (WHERE type = 'instant')''', 'count(*)')} AS instant_pct, "
            f"{_pct('''count(*) FILTER (WHERE type = 'range')''', 'count(*)')} AS range_pct FROM log WHERE {_between(tr)}"
        )
    q["average_duration"] = _log(
        f"SELECT round(coalesce(a, 0), 2) AS avg_current, CASE WHEN b IS NULL OR b = 0 THEN 0 ELSE round((a - b) * 100.0 / b, 2) END AS delta_percent "
        f"FROM (SELECT avg(duration_ms) FILTER (WHERE {_between(reg.MIDDLE)}) AS a, avg(duration_ms) FILTER (WHERE {_between(prev)}) AS b FROM log)"
    )
    q["query_rate"] = _log(f"SELECT {_RATE} FROM log WHERE {_between(full)} AND {_references(metric)}")
    q["query_status_distribution"] = _series_sql(full, "6 hours", _STATUS)
    q["query_status_distribution_day"] = _series_sql(reg.ONE_DAY, "15 minutes", _STATUS)
    q["query_latency_trends"] = _series_sql(full, "6 hours", _LATENCY)
    q["query_latency_trends_metric"] = _series_sql(reg.UNALIGNED, "1 hour", _LATENCY, _references(metric))
    q["query_latency_trends_approx"] = _with(
        [_EV, _LOG, _spine(full, "6 hours")], "SELECT time, TRUE AS rank_within_bound FROM spine"
    )
    q["query_throughput"] = _series_sql(full, "6 hours", {"value": "count(*)"})
    q["query_throughput_empty"] = _series_sql(reg.EMPTY, "1 day", {"value": "count(*)"})
    q["query_errors"] = _series_sql(full, "6 hours", {"value": f"count(*) FILTER (WHERE {bad})"})
    q["stride_status_distribution"] = _series_sql(reg.UNALIGNED, "1 hour", _STATUS)
    q["stride_throughput"] = q["query_throughput"]
    q["stride_errors"] = _series_sql(reg.UNALIGNED, "1 hour", {"value": f"count(*) FILTER (WHERE {bad})"}, f"m1 = '{metric}' AND tpl IN (1, 2)")
    q["stride_latency_trends"] = f"SELECT *, TRUE AS rank_within_bound FROM ({_series_sql(reg.UNALIGNED, '1 hour', {'value': _LATENCY['value']})})"
    q["query_time_range_distribution"] = _with([_EV, _LOG, _RANGES], "SELECT label, count, percent FROM dist")
    q["query_expressions"] = _with([_EV, _LOG, _EXPRESSIONS], "SELECT * FROM expr")
    q["query_expressions_keyset"] = _with(
        [_EV, _LOG, _EXPRESSIONS], "SELECT *, (SELECT count(*) FROM expr) AS total FROM expr ORDER BY executions DESC, fingerprint LIMIT 10 OFFSET 10"
    )
    q["query_executions"] = _log(
        "SELECT query_id, ts, status_code, duration_ms, total_queryable_samples AS samples, type, coalesce(step, 0.0) AS steps, "
        f"'user-agent=' || user_agent AS http_headers, start_ts, end_ts FROM log WHERE {_between(full)} AND m1 = '{metric}' "
        "AND tpl IN (1, 2) AND type = 'range'"
    )
    q["queries_by_metric"] = _log(
        "SELECT query_param AS query, round(avg(duration_ms), 6) AS avg_duration, round(avg(peak_samples), 6) AS avg_peak_samples, "
        f"max(peak_samples) AS max_peak_samples FROM log WHERE {_between(full)} AND {_references(nxt)} GROUP BY 1"
    )
    q["metric_query_performance"] = _log(
        "SELECT count(*) AS total_queries, round(avg(total_queryable_samples), 2) AS average_samples, max(peak_samples) AS peak_samples, "
        f"round(avg(duration_ms), 2) AS average_duration, {_RATE} FROM log WHERE {_between(full)} AND {_references(metric)}"
    )
    q["latest_query_text"] = _log(
        "SELECT fingerprint, arg_max(query_param, row(ts, query_param)) AS query FROM log "
        f"WHERE {_between(reg.MIDDLE)} GROUP BY 1"
    )
    q["latest_text_lookup"] = _log(
        "SELECT o.fingerprint, o.type, count(*) AS executions, (SELECT l.query_param FROM log l "
        f"WHERE l.fingerprint = o.fingerprint AND {_between(reg.MIDDLE)} ORDER BY l.ts DESC, l.query_param DESC LIMIT 1) AS query "
        f"FROM log o WHERE {_between(reg.MIDDLE)} GROUP BY 1, 2"
    )
    mine = "serie = 'm_25_total'"
    q["metric_statistics"] = _with(
        [_EV, _RULES, _DASH],
        f"SELECT * FROM (SELECT count(*) FILTER (WHERE {mine} AND kind = 'alert') AS alert_count, "
        f"count(*) FILTER (WHERE {mine} AND kind = 'record') AS record_count, count(*) FILTER (WHERE kind = 'alert') AS total_alerts, "
        f"count(*) FILTER (WHERE kind = 'record') AS total_records FROM rules WHERE {_overlap(full)}) CROSS JOIN "
        f"(SELECT count(DISTINCT name) FILTER (WHERE {mine}) AS dashboard_count, count(DISTINCT name) AS total_dashboards "
        f"FROM dash WHERE {_overlap(full)})",
    )
    producers = f"SELECT job, count(*) AS series FROM series WHERE name = '{metric}' AND job IS NOT NULL GROUP BY 1"
    q["metric_producers"] = _with([_EV, _SERIES], producers)
    q["metric_series_shape"] = _with(
        [_EV, _SERIES],
        "SELECT count(*) AS serie_count, CAST(CASE WHEN count(*) = 0 THEN 0 ELSE 2 + CASE WHEN count(job) > 0 THEN 1 ELSE 0 END END AS BIGINT) AS label_count "
        f"FROM series WHERE name = '{metric}'",
    )
    q["producer_contribution"] = _with(
        [_EV, _SERIES, f"p AS ({producers})"],
        "SELECT job, series, CAST(floor(series / (SELECT sum(series) FROM p) * 100 + 0.5) AS BIGINT) AS percent FROM p",
    )
    shares = {
        "short_percent": "'<24h', '24h'",
        "medium_percent": "'7d', '30d'",
        "long_percent": "'60d', '90d+'",
    }
    share_sql = ", ".join(f"round(sum(percent) FILTER (WHERE label IN ({v})), 2) AS {k}" for k, v in shares.items())
    q["retention_insight"] = _with(
        [_EV, _LOG, _RANGES],
        "SELECT short_percent, medium_percent, long_percent, CASE WHEN n = 0 THEN NULL WHEN short_percent >= 70 THEN 'short' "
        "WHEN short_percent + medium_percent >= 80 THEN 'medium' WHEN long_percent >= 40 THEN 'long' ELSE 'balanced' END AS tier "
        f"FROM (SELECT sum(count) AS n, {share_sql} FROM dist)",
    )
    q["metrics_unused"] = _with(
        _SUMMARY,
        f"SELECT c.name, coalesce(s.is_unused, TRUE) AS unused, {_COALESCED} FROM catalog c LEFT JOIN summ s USING (name) WHERE c.name IN ({_NAMES})",
    )
    q["adaptive_bucket"] = _log(
        f"SELECT query_id, time_bucket(INTERVAL '1 hour', ts, date_trunc('minute', TIMESTAMP '{reg.UNALIGNED.start}')) AS bucket "
        f"FROM log WHERE {_half_open(reg.UNALIGNED)}"
    )
    q["rules_count_by_metric"] = _with(
        [_EV, _RULES],
        "SELECT serie AS name, count(*) FILTER (WHERE kind = 'alert') AS alert_count, count(*) FILTER (WHERE kind = 'record') AS record_count "
        f"FROM rules WHERE {_overlap(reg.MIDDLE)} GROUP BY 1",
    )
    q["dashboards_count_by_metric"] = _with(
        [_EV, _DASH],
        f"SELECT serie AS name, count(DISTINCT id) AS dashboard_count FROM dash WHERE {_overlap(reg.MIDDLE)} GROUP BY 1",
    )
    q["query_count_by_metric"] = _log(
        f"SELECT m1 AS name, count(*) AS query_count, max(ts) AS last_queried_at FROM log WHERE tpl <> 7 AND {_between(reg.MIDDLE)} GROUP BY 1"
    )
    q["query_count_by_metric_daily"] = q["query_count_by_metric"].replace(_between(reg.MIDDLE), _between(reg.UNALIGNED))
    q["usage_summary"] = _with(_SUMMARY, "SELECT * FROM summ")
    q["usage_summary_refresh_join"] = _with(
        [_EV, _LOG, _RULES, _DASH, _CATALOG, _summary_cte(reg.MIDDLE)], "SELECT * FROM summ"
    )
    q["list_jobs"] = _with([_EV, _JOBS], "SELECT DISTINCT job FROM jobs")
    q["otlp_point_counts"] = _with(
        _WITH_UNUSED,
        "SELECT 'unused_metric' AS reason, CAST(sum(points) AS BIGINT) AS received, "
        f"CAST(coalesce(sum(points) FILTER (WHERE {_DROPPED}), 0) AS BIGINT) AS dropped FROM om",
    )
    q["missing_job_count"] = _with([_OTLP], "SELECT count(*) FILTER (WHERE job = '') AS missing FROM om")

    # windows
    q["rules_latest"] = _with(
        [_EV, _RULES],
        "SELECT serie, group_name, name, expression, kind, labels, created_at FROM rules "
        f"WHERE kind = 'alert' AND {_overlap(full)} QUALIFY row_number() OVER (PARTITION BY serie, kind, group_name, name "
        "ORDER BY last_seen_at DESC, expression, labels) = 1",
    )
    q["dashboards_latest"] = _with(
        [_EV, _DASH], f"SELECT id, serie, name, url, created_at FROM dash WHERE {_overlap(full)}"
    )
    q["latest_by_fingerprint"] = _log(
        f"SELECT fingerprint, query_id, query_param, ts FROM log WHERE {_between(reg.MIDDLE)} "
        "QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY ts DESC, query_id DESC) = 1"
    )
    q["rank_p95"] = _log(
        ", ranked AS (SELECT date_trunc('minute', ts) AS minute, duration_ms, "
        "row_number() OVER (PARTITION BY date_trunc('minute', ts) ORDER BY duration_ms) AS n, "
        f"count(*) OVER (PARTITION BY date_trunc('minute', ts)) AS total FROM log WHERE {_half_open(full)}) "
        "SELECT minute, max(CASE WHEN n > CAST(floor(total * 0.95) AS BIGINT) THEN duration_ms ELSE 0 END) AS p95 FROM ranked GROUP BY 1"
    ).replace("\n, ranked", ",\nranked")

    # sort and paging
    q["safe_order_by"] = _with([_EV, _LOG, _EXPRESSIONS], "SELECT row_number() OVER (ORDER BY executions DESC, fingerprint) - 1 AS position, fingerprint, executions FROM expr")
    q["paginate"] = _with(
        [_EV, _LOG, _EXPRESSIONS],
        "SELECT row_number() OVER (ORDER BY avg_duration, fingerprint) - 1 AS position, fingerprint, avg_duration FROM expr "
        "ORDER BY avg_duration, fingerprint LIMIT 25 OFFSET 50",
    )
    q["total_pages"] = _log(
        "SELECT count(DISTINCT fingerprint) AS total, CAST(ceil(count(DISTINCT fingerprint) / 40.0) AS BIGINT) AS total_pages FROM log"
    )

    # set operations
    q["labelled_union"] = _log(
        "SELECT 'ok' AS label, count(*) AS count FROM log WHERE status_code < 300 UNION ALL "
        "SELECT 'client', count(*) FROM log WHERE status_code BETWEEN 400 AND 499 UNION ALL "
        "SELECT 'server', count(*) FROM log WHERE status_code >= 500"
    )
    q["time_spine"] = (
        "SELECT unnest(generate_series(date_trunc('minute', min(ts)), date_trunc('minute', max(ts)), INTERVAL '6 hours')) AS time FROM events"
    )

    # keyed maintenance
    q["catalog_upsert"] = _with(
        [_CATALOG],
        "SELECT name, type, CASE WHEN seq % 3 = 0 THEN 'old help' || substr(help, 5) ELSE help END AS help, unit, "
        "CASE WHEN seq % 3 < 2 THEN TIMESTAMP '2023-12-01' ELSE synced_at END AS first_seen_at, "
        "CASE WHEN seq % 3 = 0 THEN TIMESTAMP '2023-12-01' ELSE synced_at END AS last_synced_at FROM meta_rows",
    )
    q["summary_placeholder"] = _with([*_SUMMARY, _PLACED], "SELECT * FROM placed")
    q["summary_merge"] = _with(
        [*_SUMMARY, _PLACED, _summary_cte(reg.MIDDLE, "mid")],
        "SELECT * FROM mid UNION ALL SELECT * FROM placed WHERE name NOT IN (SELECT name FROM mid)",
    )
    q["job_index_upsert"] = _with(
        [_EV, _JOBS, _SERIES],
        "SELECT name, job, max(updated_at) AS updated_at FROM (SELECT name, job, updated_at FROM jobs UNION ALL "
        f"SELECT DISTINCT name, job, TIMESTAMP '{reg.NOW}' FROM series WHERE job IS NOT NULL) GROUP BY 1, 2",
    )
    q["rules_upsert"] = _with([_EV, _RULES], "SELECT * FROM rules")
    q["dashboards_upsert"] = _with([_EV, _DASH], "SELECT * FROM dash")
    old = f"ts < TIMESTAMP '{reg.CUTOFF}'"
    q["retention_delete"] = _log(
        f"SELECT query_id, ts, (SELECT count(*) FROM log WHERE {old}) AS deleted FROM log WHERE NOT ({old})"
    )
    q["retention_report"] = _log(
        f"SELECT count(*) FILTER (WHERE {old}) AS deleted, count(*) FILTER (WHERE NOT ({old})) AS kept FROM log"
    )
    q["is_unused_backfill"] = _with(
        [*_SUMMARY, _PLACED],
        "SELECT name, alert_count = 0 AND record_count = 0 AND dashboard_count = 0 AND query_count = 0 AS is_unused FROM placed",
    )
    q["summary_noop_check"] = _with(
        [_CATALOG], "SELECT count(*) AS catalog_rows, CAST(0 AS BIGINT) AS refreshed_rows, count(*) > 0 AS was_noop FROM catalog"
    )
    synced = _CATALOG.replace(
        "CASE WHEN c_custkey % 10 = 9 THEN TIMESTAMP '2023-11-01' ELSE TIMESTAMP '2024-01-30' END", "TIMESTAMP '2024-01-31'"
    )
    month = TimeRange.of("2024-01-01T00:00:00", "2024-01-31T00:00:00")
    q["inventory_sync"] = _with(
        [_EV, _LOG, _RULES, _DASH, synced, _summary_cte(month), _SERIES],
        f"SELECT s.name, c.type, {_COUNTS}, is_unused, coalesce(j.n, 0) AS jobs FROM summ s JOIN catalog c USING (name) "
        "LEFT JOIN (SELECT name, count(DISTINCT job) AS n FROM series WHERE job IS NOT NULL GROUP BY 1) j USING (name)",
    )

    # streaming
    q["stream_query_ingest"] = _log(
        f"SELECT {_PUSHED.replace('coalesce(step, 0.0)', '''CASE WHEN type = 'range' THEN 15.0 ELSE 0.0 END::DOUBLE''')}, fingerprint "
        f"FROM log WHERE {wrong} IS NULL"
    )
    q["stream_closed_days"] = q["stream_query_ingest"]
    narrow = "query_param, fingerprint, type, duration_ms, status_code, total_queryable_samples, peak_samples"
    q["stream_metric_log"] = _log(
        f"SELECT m1 AS metric, TRUE AS is_first, {narrow} FROM log WHERE {wrong} IS NULL AND canonical <> '' "
        f"UNION ALL SELECT m2, FALSE, {narrow} FROM log WHERE {wrong} IS NULL AND tpl = 6 AND m2 <> m1"
    )
    q["stream_query_rejects"] = _log(f"SELECT coalesce({wrong}, 'none') AS error, count(*) AS records FROM log GROUP BY 1")
    q["stream_bucket_rollup"] = _log(
        "SELECT date_trunc('hour', ts) AS time, count(*) AS total, "
        + ", ".join(f"{sql} AS {name}" for name, sql in _STATUS.items())
        + ", CAST(sum(duration_ms) AS BIGINT) AS duration_sum FROM log GROUP BY 1"
    )
    q["otlp_unused_names"] = _with(_WITH_UNUSED, "SELECT metric_name FROM unused")
    kept = f"NOT {_DROPPED} AND points > 0"
    q["otlp_drop_unused"] = _with(
        _WITH_UNUSED, f"SELECT export_id, line, job, metric_name, points FROM om WHERE {kept}"
    )
    q["otlp_drop_unused_nested"] = _with(
        _WITH_UNUSED, f"SELECT export_id, job, metric_name, points FROM om WHERE {kept}"
    )
    q["otlp_drop_unused_nested_join"] = q["stream_drop_unused"] = q["otlp_drop_unused_nested"]
    prefixes = " OR ".join(f"starts_with(metric_name, '{p}')" for p in reg.DROP_PREFIXES)
    listed = ", ".join(f"'{n}'" for n in reg.DROP_NAMES)
    q["otlp_drop_by_name_prefix"] = _with(
        [_OTLP], f"SELECT export_id, line, metric_name FROM om WHERE NOT (metric_name IN ({listed}) OR {prefixes})"
    )
    q["job_scope_rule"] = _with([_OTLP], f"SELECT job, {_ACTIVE} AS active, count(*) AS metrics FROM om GROUP BY 1, 2")
    q["otlp_dry_run"] = _with(
        _WITH_UNUSED,
        f"SELECT count(*) AS metrics, CAST(coalesce(sum(points), 0) AS BIGINT) AS datapoints FROM om WHERE {_DROPPED}",
    )
    q["catalog_seen_dedup"] = "WITH RECURSIVE " + _EV + f""", ticks AS (
      SELECT DISTINCT {_pn('user_id')} AS name, epoch_ms((epoch_us(ts) // 30000000) * 30000) AS tick FROM ev
    ), written AS (
      SELECT name, min(tick) AS flush FROM ticks GROUP BY name
      UNION ALL
      SELECT w.name, (SELECT min(t.tick) FROM ticks t WHERE t.name = w.name AND t.tick >= w.flush + INTERVAL '1 day') AS flush
      FROM written w WHERE w.flush IS NOT NULL
    ) SELECT name, flush FROM written WHERE flush IS NOT NULL"""
    q["stream_seen_writes"] = q["catalog_seen_dedup"]
    q["stream_catalog_sync"] = _with(
        [_OTLP, _OTLP_ITEMS], "SELECT DISTINCT name, type, help, unit, FALSE AS is_unused FROM items"
    )
    q["fail_open_lookup"] = _with(
        [*_SUMMARY, _OTLP, "known AS (SELECT name, is_unused FROM summ WHERE NOT contains(name, 'm_1'))", _UNUSED],
        "SELECT metric_name, count(*) AS metrics FROM om WHERE metric_name NOT IN (SELECT metric_name FROM unused) "
        "AND points > 0 GROUP BY 1",
    )
    return q
