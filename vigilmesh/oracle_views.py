"""The adapters of ``adapters.py`` as SQL common table expressions, for the DuckDB oracle."""

from __future__ import annotations

from vigilmesh.adapters import ARCHIVE_SLOTS, ARCHIVE_START, PRICE_EDGES


def slot_ts(slot: str) -> str:
    return f"(TIMESTAMP '{ARCHIVE_START}' + to_seconds(CAST(({slot}) * 300 AS BIGINT)))"


def second_ts(second: str) -> str:
    return f"(TIMESTAMP '{ARCHIVE_START}' + to_seconds(CAST({second} AS BIGINT)))"


_bins = " ".join(f"WHEN l_extendedprice < {edge} THEN {i}" for i, edge in enumerate(PRICE_EDGES))
_voice = ", ".join(f"CAST(sum(CASE WHEN bin = {i} THEN q - fail ELSE 0 END) AS BIGINT)" for i in range(9))
_sms = ", ".join(f"CAST(sum(CASE WHEN (p + bin) % 9 = {i} THEN q - q // 20 ELSE 0 END) AS BIGINT)" for i in range(9))

VIEWS: dict[str, tuple[list[str], str]] = {
    "obs": (
        [],
        """
SELECT event_id, 'S' || (user_id % 10) AS scope_id, 'src' || (user_id % 3) AS source_id,
  CASE event_type WHEN 'view' THEN 'NODE' WHEN 'signup' THEN 'HEARTBEAT' ELSE 'SERVICE' END AS kind,
  CASE WHEN event_type IN ('view','signup') THEN NULL WHEN user_id % 2 = 0 THEN 'VOLTE' ELSE 'SMS' END AS service,
  CASE WHEN event_type = 'view' THEN 'N' || (user_id % 3) END AS node_id,
  date_trunc('minute', ts) AS window_start,
  date_trunc('minute', ts) + INTERVAL 60 SECOND AS window_end,
  date_trunc('minute', ts) + to_seconds(60 + event_id % 5) AS emitted_at,
  date_trunc('minute', ts) + to_seconds(60 + event_id % 20) AS received_at,
  CASE WHEN event_id % 13 = 0 THEN 'INCOMPLETE' ELSE 'COMPLETE' END AS quality,
  CAST(round(value * 100) AS BIGINT) AS amount
FROM events""",
    ),
    "obs_metrics": (
        ["obs"],
        """
SELECT *,
  CASE WHEN service = 'VOLTE' THEN 100 + amount % 900 END AS attempts,
  CASE WHEN service = 'VOLTE' THEN (amount % 11) * (1 + amount % 4) END AS technical_failures,
  CASE WHEN service = 'VOLTE' THEN amount % 7 END AS user_outcomes,
  CASE WHEN service = 'VOLTE' THEN 100 + amount % 900 - (amount % 11) * (1 + amount % 4) - amount % 7 END
    AS technical_successes,
  CASE WHEN service = 'VOLTE' THEN ((amount % 11) * (1 + amount % 4)) // 2 END AS sip503_count,
  CASE WHEN service = 'VOLTE' THEN 105 + amount % 900 END AS rrc_attempts,
  CASE WHEN service = 'VOLTE' THEN 105 + amount % 900 - amount % 4 END AS rrc_successes,
  CASE WHEN service = 'VOLTE' THEN 103 + amount % 900 END AS bearer_attempts,
  CASE WHEN service = 'VOLTE' THEN 103 + amount % 900 - amount % 3 END AS bearer_successes,
  CASE WHEN service = 'SMS' THEN 60 + amount % 300 END AS delivery_attempts,
  CASE WHEN service = 'SMS' THEN 60 + amount % 300 - amount % 13 END AS delivery_successes,
  CASE WHEN service = 'SMS' THEN 1 + amount % 47 END AS delivered_messages,
  CASE WHEN service = 'SMS' THEN list_transform(range(1, 2 + amount % 47), lambda i: (amount * i * 31) % 60000) END
    AS delivery_delay_ms,
  CASE WHEN kind = 'NODE' THEN CAST(amount % 101 AS DOUBLE) END AS cpu_pct,
  CASE WHEN kind = 'NODE' THEN (amount % 50) / 1000.0::DOUBLE END AS packet_loss_ratio,
  CASE WHEN kind = 'NODE' THEN amount % 1500 END AS queue_depth,
  CASE WHEN kind = 'NODE' THEN CASE WHEN amount % 1500 = 0 THEN 0 ELSE amount % 400 END END AS oldest_pending_seconds
FROM obs""",
    ),
    "obs_dup": (
        ["obs"],
        """
SELECT *, event_id * 4 + delivery AS arrival,
  sha256(concat_ws('|', event_id, scope_id, source_id, kind, CAST(epoch(window_start) AS BIGINT), quality, amount))
    AS content_hash
FROM (SELECT *, 0 AS delivery FROM obs
  UNION ALL SELECT *, 1 FROM obs WHERE event_id % 17 = 0
  UNION ALL SELECT * REPLACE (amount + 1 AS amount), 2 FROM obs WHERE event_id % 23 = 0)""",
    ),
    "catalogue": (
        [],
        """
SELECT * FROM (SELECT 'S' || (id % 10) AS scope_id,
  CASE WHEN id // 10 < 3 THEN 'SERVICE' ELSE 'NODE' END AS role,
  CASE WHEN id // 10 < 3 THEN NULL ELSE 'N' || (id // 10 - 3) END AS node_id,
  'src' || ((id // 10) % 3) AS source_id,
  CASE WHEN (id % 10) % 2 = 0 THEN 'VOLTE' ELSE 'SMS' END AS service
FROM range(60) t(id)) WHERE NOT (role = 'NODE' AND scope_id = 'S7' AND node_id = 'N2')""",
    ),
    "kpi_hour": (
        [],
        """
SELECT 'S' || (user_id % 10) AS scope_id, date_trunc('hour', ts) AS window_start, count(*) AS attempts,
  count(*) FILTER (WHERE event_type <> 'error') AS success, count(*) FILTER (WHERE event_type = 'view') AS views,
  CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS amount,
  max(CAST(round(value * 100) AS BIGINT)) AS peak, max(event_id) AS last_event_id,
  date_trunc('hour', ts) + INTERVAL 3600 SECOND AS window_end
FROM events GROUP BY 1, 2, 9""",
    ),
    "city5m": (
        [],
        f"""
SELECT *, CAST(holding_ms AS DECIMAL(20,0)) * CAST(0.001 AS DECIMAL(4,3)) AS voice_holding_seconds,
  CAST(setup_ms AS DECIMAL(20,0)) * CAST(0.001 AS DECIMAL(4,3)) AS voice_setup_elapsed_seconds FROM (
SELECT city_id, slot, {slot_ts("slot")} AS ts,
  CAST(sum(q) AS BIGINT) AS voice_attempts, CAST(sum(q - fail) AS BIGINT) AS voice_success,
  CAST(sum(least(drp, q - fail)) AS BIGINT) AS voice_drops,
  CAST(sum(cents) AS BIGINT) AS holding_ms, CAST(sum(q * (p % 50)) AS BIGINT) AS setup_ms,
  [{_voice}] AS voice_setup_hist,
  CAST(sum(q + n) AS BIGINT) AS sms_submitted, CAST(sum(q - q // 20) AS BIGINT) AS sms_delivered,
  CAST(sum(q // 20) AS BIGINT) AS sms_expired, CAST(sum(p % 200) AS BIGINT) AS sms_queue,
  max(p % 700) AS sms_oldest_seconds, [{_sms}] AS sms_delay_hist,
  CAST(sum(2 * q) AS BIGINT) AS data_attempts, CAST(sum(2 * q - fail) AS BIGINT) AS data_success,
  CAST(sum(3 * q) AS BIGINT) AS dns_attempts, CAST(sum(3 * q - drp) AS BIGINT) AS dns_success,
  CAST(sum(p % 97) AS BIGINT) AS user_throughput_mbps, CAST(sum(n) AS BIGINT) AS ho_attempts,
  CAST(sum(n - CASE WHEN fail > 0 THEN 1 ELSE 0 END) AS BIGINT) AS ho_success
FROM (SELECT 'C' || (l_suppkey % 10) AS city_id, (l_orderkey * 7 + l_linenumber) % {ARCHIVE_SLOTS} AS slot,
  CAST(l_quantity AS BIGINT) AS q,
  CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) * CAST(round(l_discount * 100) AS BIGINT) // 100
    ELSE 0 END AS fail,
  CAST(l_quantity AS BIGINT) * CAST(round(l_tax * 100) AS BIGINT) // 100 AS drp,
  CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
  CASE {_bins} ELSE {len(PRICE_EDGES)} END AS bin, l_partkey AS p, CAST(l_linenumber AS BIGINT) AS n
  FROM lineitem) GROUP BY city_id, slot)""",
    ),
    "link5m": (
        [],
        f"""
SELECT *, CAST(traffic_micro AS DECIMAL(18,0)) * CAST(0.000001 AS DECIMAL(7,6)) AS traffic_gbps,
  CAST(capacity AS DECIMAL(18,0)) AS effective_capacity_gbps,
  CAST(loss_bp AS DECIMAL(18,0)) * CAST(0.01 AS DECIMAL(3,2)) AS loss_pct
FROM (SELECT link_id, slot, {slot_ts("slot")} AS ts, 20 + 10 * (c % 3) AS capacity,
  least(cents // 3, (20 + 10 * (c % 3)) * 1000000) AS traffic_micro, k % 5 AS loss_bp, 10 + c % 140 AS rtt_ms,
  k % 17 AS jitter_ms, k % 7 AS interface_errors, c % 11 AS queue_drops
FROM (SELECT 'L' || (o_custkey % 12) AS link_id, (o_orderkey * 7) % {ARCHIVE_SLOTS} AS slot, o_orderkey AS k,
  o_custkey AS c, CAST(round(o_totalprice * 100) AS BIGINT) AS cents,
  row_number() OVER (PARTITION BY o_custkey % 12, (o_orderkey * 7) % {ARCHIVE_SLOTS} ORDER BY o_orderkey DESC) AS rn
  FROM orders) WHERE rn = 1)""",
    ),
    "roam5m": (
        [],
        f"""
SELECT 'N' || c_nationkey AS country_id, 'N' || c_nationkey || '-DEMO-01' AS partner_id, direction, slot,
  {slot_ts("slot")} AS ts,
  CAST(sum(cents % 1000) AS BIGINT) AS reg_attempts,
  CAST(sum(cents % 1000 - (cents % 1000) // 40) AS BIGINT) AS reg_success,
  CAST(sum(cents % 700) AS BIGINT) AS data_attempts,
  CAST(sum(cents % 700 - (cents % 700) // 30) AS BIGINT) AS data_success,
  CAST(sum(cents % 300) AS BIGINT) AS voice_attempts,
  CAST(sum(cents % 300 - (cents % 300) // 25) AS BIGINT) AS voice_success,
  CAST(sum(cents % 200) AS BIGINT) AS sms_attempts,
  CAST(sum(cents % 200 - (cents % 200) // 50) AS BIGINT) AS sms_success,
  CAST(sum(cents % 90) AS BIGINT) AS active_users, max(20 + cents % 150) AS rtt_ms
FROM (SELECT c_nationkey, CASE WHEN o_orderkey % 2 = 0 THEN 'in' ELSE 'out' END AS direction,
  (o_orderkey * 7) % {ARCHIVE_SLOTS} AS slot, CAST(round(o_totalprice * 100) AS BIGINT) AS cents
  FROM orders JOIN customer ON o_custkey = c_custkey)
GROUP BY c_nationkey, direction, slot""",
    ),
    "revisions": (
        ["city5m"],
        """
SELECT city_id AS scope_id, slot, ts AS bucket_start, voice_success AS numerator, voice_attempts AS denominator,
  CASE WHEN slot % 29 = 0 THEN 'STALE' WHEN slot % 13 = 0 THEN 'PARTIAL' ELSE 'VALID' END AS quality,
  CASE WHEN slot % 13 = 0 THEN 500000 ELSE 1000000 END AS coverage_ppm, slot % 37 = 0 AS source_unknown, 0 AS revision
FROM city5m
UNION ALL SELECT city_id, slot, ts, greatest(voice_success - 1, 0), voice_attempts, 'VALID', 1000000, slot % 37 = 0, 1
FROM city5m WHERE slot % 11 = 0""",
    ),
    "city_facts": (["city5m"], "SELECT *, city_id AS scope_id FROM city5m"),
    "link_facts": (["link5m"], "SELECT *, link_id || ':a-to-b' AS scope_id FROM link5m"),
    "roam_facts": (["roam5m"], "SELECT *, partner_id || ':' || direction AS scope_id FROM roam5m"),
    "cities": ([], "SELECT 'C' || id AS scope_id FROM range(10) t(id)"),
    "links": ([], "SELECT 'L' || id || ':a-to-b' AS scope_id FROM range(12) t(id)"),
    "partners": (
        [],
        """
SELECT d.direction, 'N' || n_nationkey || '-DEMO-01' AS partner_id, 'N' || n_nationkey AS country_id,
  'N' || n_nationkey || '-DEMO-01:' || d.direction AS scope_id
FROM nation, (SELECT unnest(['in', 'out']) AS direction) d""",
    ),
    "scopes10": ([], "SELECT 'S' || id AS scope_id FROM range(10) t(id)"),
    "nodes": (
        [],
        """
SELECT 'ROOT' AS node_id, CAST(NULL AS VARCHAR) AS parent_id, 'COUNTRY' AS node_type
UNION ALL SELECT 'R' || r_regionkey, 'ROOT', 'REGION' FROM region
UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, 'DISTRICT' FROM nation
UNION ALL SELECT 'V' || s_suppkey, CASE s_suppkey % 10 WHEN 4 THEN 'V' || (s_suppkey + 1) WHEN 5 THEN 'V' || (s_suppkey - 1) ELSE 'N' || s_nationkey END, 'SITE' FROM supplier
UNION ALL SELECT 'K' || c_custkey, CASE WHEN c_custkey % 50 BETWEEN 21 AND 28 THEN 'K' || (c_custkey - 1) ELSE 'N' || c_nationkey END, 'SITE' FROM customer""",
    ),
    "link_inventory": (
        [],
        f"""
SELECT 'L' || l AS link_id, 'a-to-b' AS direction_id, {second_ts("s")} AS valid_from, {second_ts("until")} AS valid_to,
  20 + 10 * (k % 3) AS nominal_gbps, 'C' || (n % 10) AS a, 'C' || ((n + 3) % 10) AS b
FROM (SELECT *, CASE WHEN k % 9 = 0 THEN greatest(s, e - 600) WHEN k % 11 = 0 THEN e + 900 ELSE e END AS until
  FROM (SELECT *, coalesce(lead(s) OVER (PARTITION BY l ORDER BY s, k), 2592000) AS e
    FROM (SELECT c_custkey AS k, c_custkey % 12 AS l, c_nationkey AS n, c_custkey * 104729 % 2592000 AS s FROM customer)))""",
    ),
    "exclusions": (
        [],
        f"""
SELECT {slot_ts("r_regionkey * 1500 + 200")} AS from_ts, {slot_ts("r_regionkey * 1500 + 260")} AS to_ts,
  CASE WHEN r_regionkey % 2 = 0 THEN 'DECLARED_INJECTION' ELSE 'MAINTENANCE' END AS reason FROM region""",
    ),
    "vectors": (
        [],
        f"""
SELECT vec_id, CASE WHEN vec_id % 10 <= 5 THEN 'train' WHEN vec_id % 10 = 6 THEN 'calibration'
    WHEN vec_id % 10 <= 8 THEN 'validation' ELSE 'test' END AS split,
  CASE WHEN label = 0 THEN 0 ELSE 1 END AS fault, 'family' || label AS family,
  CASE vec_id % 3 WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' ELSE 'HIGH' END AS severity,
  CASE vec_id % 2 WHEN 0 THEN 'weekday' ELSE 'weekend' END AS profile, 'run' || (vec_id % 20) AS run_id,
  TIMESTAMP '{ARCHIVE_START}' + to_seconds(vec_id * 60) AS window_start,
  CAST(embedding[1] AS DOUBLE) AS f0, CAST(embedding[2] AS DOUBLE) AS f1, CAST(embedding[3] AS DOUBLE) AS f2,
  CAST(embedding[4] AS DOUBLE) AS f3, CAST(embedding[5] AS DOUBLE) AS f4, CAST(embedding[6] AS DOUBLE) AS f5
FROM embeddings""",
    ),
    "classified": (
        [],
        """
SELECT l.doc_id, l.toxic AS truth, l.quality AS prediction, d.lang AS family, d.source AS profile
FROM labels l JOIN documents d ON d.doc_id = l.doc_id""",
    ),
}


def sql(body: str, *views: str, recursive: bool = False, **extra: str) -> str:
    """``body`` preceded by the named adapter views (with what they need) and ``extra`` named ones."""
    ordered: list[str] = []

    def need(name: str):
        for parent in VIEWS[name][0]:
            need(parent)
        if name not in ordered:
            ordered.append(name)

    for view in views:
        need(view)
    parts = [f"{name} AS ({VIEWS[name][1]}\n)" for name in ordered]
    parts += [f"{name} AS ({text}\n)" for name, text in extra.items()]
    if not parts:
        return body.strip()
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" + body.strip()
