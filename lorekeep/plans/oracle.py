"""The logical tables of ``lorekeep.sources.bridge`` as SQL, to build the SQL counterpart of each query from."""

from __future__ import annotations

from ..sources import bridge as B

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"


def pick(expr: str, names) -> str:
    items = names.items() if isinstance(names, dict) else enumerate(names)
    q = lambda k: f"'{k}'" if isinstance(k, str) else str(k)
    return f"CASE {expr} " + " ".join(f"WHEN {q(k)} THEN '{v}'" for k, v in items) + " END"


TABLES = {
    "memories": f"""SELECT event_id AS id, user_id, {pick('event_type', B.TYPES)} AS memory_type,
        CASE WHEN event_id % 6 <> 0 THEN 'ctx ' || user_id END AS context,
        CASE WHEN event_id % 29 = 3 THEN 'journal' ELSE {pick('user_id % 3', ('teaching', 'inference', 'exchange'))} END AS source_type,
        coalesce({pick('event_id % 10', B.STATUS)}, 'durable') AS status, {pick('event_id % 5', ('user', 'assistant', 'system', 'user'))} AS proposed_by,
        (event_id % 101) / 100.0::DOUBLE AS confidence, CASE WHEN event_id % 8 = 0 THEN ts + INTERVAL 14 DAY END AS review_after,
        event_id % 9 = 0 AS needs_user_confirmation, CASE WHEN event_id % 17 = 0 THEN 'high' WHEN event_id % 13 = 5 THEN 'low' WHEN event_id % 19 <> 0 THEN 'normal' END AS consent_level,
        {pick('event_id % 41', B.COUNTERWEIGHTS)} AS counterweight_type, ts AS created_at, ts AS updated_at, event_id % 7 AS access_count, event_id % 23 = 0 AS is_core,
        {pick('event_id % 31', B.FLAGS)} AS pattern_flag, CASE WHEN event_id % 2 = 0 THEN 'source ' || (user_id % 4) END AS pattern_source,
        CASE WHEN event_id % 37 = 0 THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END AS retrieval_weight FROM events""",
    "texts": "SELECT event_id AS id, text AS raw_text FROM events JOIN documents ON doc_id = event_id % (SELECT count(*) FROM documents)",
    "affect_base": f"""SELECT event_id AS memory_id, greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (value - 50) / 53)) AS valence, k / 51 - 1 AS arousal, (user_id % 11) / 5.3::DOUBLE - 1 AS dominance,
        CASE WHEN event_id % 97 <> 0 THEN {pick('event_type', B.FIRST)} END AS e1, CASE WHEN event_id % 97 <> 0 THEN k / 100 END AS w1,
        CASE WHEN event_id % 97 <> 0 THEN {pick('user_id % 5', B.SECOND)} END AS e2, CASE WHEN event_id % 97 <> 0 THEN 1 - k / 100 END AS w2, ts AS computed_at, 'base' AS model
        FROM (SELECT *, (props::JSON->>'$.k')::DOUBLE AS k FROM events)""",
    "affect": """SELECT * FROM affect_base UNION ALL
        SELECT memory_id, -valence, arousal, dominance, e1, w2, e2, w1, computed_at + INTERVAL 1 HOUR, 'later' FROM affect_base WHERE memory_id % 20 = 7""",
    "latest": "SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY computed_at DESC, model) AS n FROM affect) WHERE n = 1",
    "chords": "SELECT memory_id, model, e1 AS emotion, w1 AS w FROM affect WHERE e1 IS NOT NULL UNION ALL SELECT memory_id, model, e2, w2 FROM affect WHERE e2 IS NOT NULL",
    "latest_chords": "SELECT memory_id, e1 AS emotion, w1 AS w FROM latest WHERE e1 IS NOT NULL UNION ALL SELECT memory_id, e2, w2 FROM latest WHERE e2 IS NOT NULL",
    "vectors": "SELECT event_id AS memory_id, embedding FROM events JOIN embeddings ON vec_id = event_id % (SELECT count(*) FROM embeddings) WHERE event_id % 3 <> 0",
    "edges": """SELECT event_id AS from_id, (event_id * 31 + 17) % (SELECT count(*) FROM events) AS to_id, CASE WHEN event_id % 2 = 0 THEN 'resonance' ELSE 'supports' END AS edge_type, (event_id % 70) / 100.0::DOUBLE + 0.3 AS weight, ts AS created_at FROM events WHERE event_id % 7 IN (1, 3)
        UNION ALL SELECT event_id, event_id % 13 + (SELECT count(*) FROM events) - 13, 'resonates', 0.5, ts FROM events WHERE event_id % 11 = 0
        UNION ALL SELECT event_id, event_id, 'self', 1.0, ts FROM events WHERE event_id % 101 = 0""",
    "degrees": "SELECT id, count(*) AS degree FROM (SELECT from_id AS id FROM edges UNION ALL SELECT to_id FROM edges) GROUP BY id",
    "ring": "SELECT event_id AS memory_id, 0.4::DOUBLE + (event_id % 6) / 10.0::DOUBLE AS activation, ts AS last_activated_at FROM events WHERE event_id % 7 = 0 ORDER BY event_id DESC LIMIT 30",
    "sessions": """SELECT user_id, ts::DATE AS day, max(event_id) % 3 <> 0 AS boot_ran, max(event_id) % 4 = 0 AS timestamp_logged, count(*) FILTER (event_type = 'click') AS exchanges_stored,
        count(*) FILTER (event_type = 'view') AS heartbeats_sent, count(*) AS tool_calls_total, min(ts) AS started_at FROM events GROUP BY 1, 2""",
    "hive": f"""SELECT event_id, {pick('event_type', {'click': 'emit', 'error': 'stop', 'purchase': 'waggle', 'signup': 'nectar'})} AS kind, 'k' || (user_id % 40) AS key, 's' || (event_id % 3) AS signal,
        least(1.0::DOUBLE, value / 100) AS intensity, CASE WHEN event_id % 4 <> 0 THEN 'note ' || (event_id % 9) END AS note, event_id * 13 % 1000 AS target_memory_id, ts,
        CASE WHEN event_id % 5 = 0 THEN ts + INTERVAL 2 DAY END AS expires_at FROM events WHERE event_type <> 'view'""",
    "sleep": """SELECT ts AS cycle_start, ts + INTERVAL 5 SECOND AS cycle_end, event_id % 5 AS edges_created, event_id % 3 AS memories_expired, event_id % 26 AS embeddings_backfilled
        FROM events WHERE event_type = 'signup'""",
    "state_log": f"""SELECT event_id, {pick('event_type', B.STATE_KEYS)} AS key, CASE WHEN event_type IN ('click', 'view') THEN {pick('user_id % 5', B.SECOND)} ELSE (ts::DATE)::VARCHAR END AS value, ts AS updated_at FROM events""",
    "audit": "SELECT event_id, ts, user_id % 7 AS identity, CASE WHEN event_type = 'error' THEN 403 ELSE 200 END AS response_code, event_type = 'purchase' AS writes FROM events",
    "journal": "SELECT doc_id AS id, left(text, 40) AS title, text AS description, lang AS entry_type, 'sess ' || (doc_id % 12) AS session_id, TIMESTAMP '2024-01-01' + to_days((doc_id % 30)::INTEGER) AS ts FROM documents",
}
_NEEDS = {"affect": ["affect_base"], "latest": ["affect"], "chords": ["affect"], "latest_chords": ["latest"], "degrees": ["edges"]}


def recursive(text: str) -> str:
    """SQL whose common table expressions may refer to themselves."""
    return "WITH RECURSIVE" + text.removeprefix("WITH")


def sql(names: str, body: str, **more: str) -> str:
    """``body`` with the logical tables that it names (and what these need), and further ones, as common table expressions."""
    order: list[str] = []

    def need(n: str) -> None:
        for m in _NEEDS.get(n, []):
            need(m)
        if n not in order:
            order.append(n)

    for n in names.split():
        need(n)
    parts = [f"{n} AS ({TABLES[n]})" for n in order] + [f"{n} AS ({q})" for n, q in more.items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body
