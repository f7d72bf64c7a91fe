"""DuckDB definitions of the store-shaped views, written apart from the Spark adapters."""

ISO = "'%Y-%m-%dT%H:%M:%SZ'"
VIEWS: dict[str, str] = {
    "msg": f"""SELECT 's' || conv_id AS session_id, turn AS rowid, 'p' || (conv_id % 4) AS project, role, coalesce(text, '') AS content,
        strftime(TIMESTAMP '2024-01-01' + to_hours(conv_id) + to_minutes(turn), {ISO}) AS ts FROM conversations""",
    "sessions": """SELECT session_id, min(project) AS project, substr(arg_min(content, rowid), 1, 80) AS title, min(ts) AS first_ts, max(ts) AS last_ts,
        count(*) AS messages FROM msg GROUP BY session_id""",
    "reviewed": "SELECT session_id FROM sessions WHERE CAST(substr(session_id, 2) AS BIGINT) % 3 = 0",
    "beliefs": f"""SELECT doc_id AS id, CASE doc_id % 5 WHEN 0 THEN 'user' WHEN 1 THEN 'user-model' ELSE 'project:' || lang END AS subject,
        substr(trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'), ' '), 1, 300) AS claim, ((doc_id * 37) % 100) / 100.0::DOUBLE AS confidence,
        CASE doc_id % 10 WHEN 7 THEN 'retracted' WHEN 8 THEN 'dormant' WHEN 9 THEN 'superseded' ELSE 'active' END AS status,
        CASE WHEN doc_id % 10 = 9 THEN doc_id - 9 END AS superseded_by,
        strftime(TIMESTAMP '2024-01-01' + to_minutes(doc_id % 40000), {ISO}) AS created,
        strftime(TIMESTAMP '2024-01-01' + to_minutes(doc_id % 40000) + to_days(CAST(doc_id % 30 AS INT)), {ISO}) AS updated,
        CASE WHEN doc_id % 3 <> 0 THEN strftime(TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 50 AS INT)), {ISO}) END AS last_referenced,
        CASE doc_id % 4 WHEN 0 THEN 'agent' WHEN 1 THEN 'user' END AS writer, CASE doc_id % 5 WHEN 0 THEN 'approved' WHEN 1 THEN 'derived' WHEN 2 THEN 'dream' END AS via,
        sha256('b' || doc_id) AS uid FROM documents""",
    "n_beliefs": "SELECT count(*) AS n FROM documents",
    "evidence": f"""SELECT (event_id * 7919 + user_id * 104729) % n AS belief_id, 'u' || user_id || '-' || strftime(ts, '%Y-%m-%d') AS session_id,
        'p' || (user_id % 4) AS project, event_type AS note, strftime(ts, {ISO}) AS created, event_id FROM events, n_beliefs""",
    "outcomes": f"""SELECT event_id AS id, (event_id * 7919 + user_id * 104729) % n AS belief_id,
        CASE event_type WHEN 'view' THEN 'stale' WHEN 'purchase' THEN 'confirmed' ELSE 'contradicted' END AS event, 'u' || user_id || '-' || strftime(ts, '%Y-%m-%d') AS session_id,
        strftime(ts, {ISO}) AS created FROM events, n_beliefs WHERE event_type IN ('view', 'purchase', 'error')""",
    "walks": f"""SELECT lag(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS src, b AS dst, event_id, event_type, 'u' || user_id || '-' || strftime(ts, '%Y-%m-%d') AS session_id,
        strftime(ts, {ISO}) AS created FROM (SELECT *, (event_id * 7919 + user_id * 104729) % n AS b FROM events, n_beliefs)""",
    "raw_edges": """SELECT src, dst, CASE event_type WHEN 'view' THEN 'depends_on' WHEN 'signup' THEN 'specializes' WHEN 'error' THEN 'explains' WHEN 'click' THEN 'contradicts' ELSE 'applies_when' END AS rel,
        session_id, created, event_id FROM walks WHERE src <> dst""",
    "assertions": """SELECT CASE WHEN rel = 'contradicts' THEN least(src, dst) ELSE src END AS src, CASE WHEN rel = 'contradicts' THEN greatest(src, dst) ELSE dst END AS dst, rel, session_id,
        min(created) AS created FROM raw_edges GROUP BY ALL""",
    "edges": "SELECT src, dst, rel, min(session_id) AS session_id, min(created) AS created FROM assertions GROUP BY src, dst, rel",
    "support": "SELECT src, dst, rel, count(DISTINCT session_id) AS n, least(1 - exp(-count(DISTINCT session_id) / 2.0::DOUBLE), 0.99::DOUBLE) AS weight FROM assertions GROUP BY src, dst, rel",
    "active_support": """SELECT s.* FROM support s JOIN beliefs a ON a.id = s.src AND a.status = 'active' JOIN beliefs b ON b.id = s.dst AND b.status = 'active'""",
    "adj": """SELECT src, dst, rel, weight FROM active_support UNION ALL SELECT dst, src, rel, weight FROM active_support WHERE rel = 'contradicts'""",
    "ops": f"""SELECT *, row_number() OVER (ORDER BY event_id, delivery) AS seq FROM (
        SELECT e.event_id, 0 AS delivery, 'op' || event_id AS op_id, 'm' || (user_id % 5) AS machine_id, row_number() OVER (PARTITION BY user_id % 5 ORDER BY event_id) AS machine_seq,
        event_id // 3 + 1 AS lamport, CASE event_type WHEN 'view' THEN 'session' WHEN 'click' THEN 'memory' WHEN 'error' THEN 'skill' ELSE 'belief' END AS class,
        CASE event_type WHEN 'view' THEN 'upsert' WHEN 'click' THEN 'replace' WHEN 'error' THEN 'put' WHEN 'signup' THEN 'insert' ELSE 'supersede' END AS op,
        'k' || (user_id % 3) AS project_key, props AS payload, CAST(json_extract(props, '$.k') AS BIGINT) AS k, strftime(ts, {ISO}) AS created, event_id % 11 <> 0 AS verified FROM events e
        UNION ALL
        SELECT e.event_id, 1, 'op' || event_id, 'm' || (user_id % 5), seq5, event_id // 3 + 1, CASE event_type WHEN 'view' THEN 'session' WHEN 'click' THEN 'memory' WHEN 'error' THEN 'skill' ELSE 'belief' END,
        CASE event_type WHEN 'view' THEN 'upsert' WHEN 'click' THEN 'replace' WHEN 'error' THEN 'put' WHEN 'signup' THEN 'insert' ELSE 'supersede' END,
        'k' || (user_id % 3), props, CAST(json_extract(props, '$.k') AS BIGINT), strftime(ts, {ISO}), event_id % 11 <> 0
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id % 5 ORDER BY event_id) AS seq5 FROM events) e WHERE event_id % 20 = 0)""",
    "log": "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY op_id ORDER BY seq) AS rn FROM ops) WHERE rn = 1",
    "accepted": "SELECT * FROM log WHERE verified",
    "entries": """SELECT bucket, doc_id, pos, trim(line, ' ') AS entry FROM (SELECT source AS bucket, doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line
        FROM (SELECT source, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)) WHERE trim(line, ' ') <> ''""",
    "usage": """SELECT event_type AS name, 'm' || (user_id % 5) AS origin, CAST((extract(day FROM ts) - 1) // 10 AS BIGINT) AS generation, count(*) AS uses,
        count(*) FILTER (value > 20) AS ok, count(*) FILTER (value <= 20) AS fail FROM events GROUP BY ALL""",
    "msg_tokens": """SELECT session_id, rowid, project, unnest(t) AS term, generate_subscripts(t, 1) AS pos, len(t) AS n_terms FROM
        (SELECT session_id, rowid, project, regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+') AS t FROM msg)""",
    "claim_toks": "SELECT id, subject, status, claim, list_distinct(regexp_extract_all(lower(claim), '[a-z0-9_]{3,}')) AS t FROM beliefs",
    "counts": """SELECT belief_id, count(*) FILTER (event = 'confirmed') AS confirmed, count(*) FILTER (event = 'contradicted') AS contradicted, count(*) FILTER (event = 'stale') AS stale,
        count(*) AS total FROM outcomes GROUP BY belief_id""",
}
