"""SQL that DuckDB runs against the same tables, for the queries of this subpackage that SQL can express."""

_TURNS = r"""
roles AS (SELECT lower(trim(alias)) AS a, lower(trim(role)) AS r FROM role_aliases),
msgs AS (
  SELECT m.id, m.thread_id, m.created_at, m.content, coalesce(x.r, 'other') AS r,
         m.content IS NULL OR NOT regexp_matches(m.content, '[\p{L}\p{Nd}]') AS blank
  FROM (SELECT id, any_value(thread_id) AS thread_id, any_value(created_at) AS created_at,
               any_value(content) AS content, any_value(role) AS role
        FROM messages GROUP BY id) m
  LEFT JOIN roles x ON lower(trim(m.role)) = x.a
),
turns AS (
  SELECT *, lead(r) OVER w AS nr, lead(blank) OVER w AS nb, lag(r) OVER w AS pr,
         row_number() OVER w - 1 AS turn_no
  FROM msgs WHERE r IN ('user', 'assistant')
  WINDOW w AS (PARTITION BY thread_id ORDER BY created_at NULLS FIRST, r DESC, id)
),
by_turn AS (
  SELECT thread_id, bool_or(r = 'assistant' AND pr IS NULL) AS af,
         bool_or(r = 'assistant' AND pr = 'assistant') AS tw,
         bool_or(r = 'user' AND NOT coalesce(nr = 'assistant' AND NOT nb, FALSE)) AS op
  FROM turns GROUP BY 1
),
by_row AS (
  SELECT thread_id, bool_or(NOT blank) AS any_text, bool_or(r = 'other' OR created_at IS NULL) AS bad
  FROM msgs WHERE r <> 'system' GROUP BY 1
),
faults AS (
  SELECT t.id AS thread_id,
         CASE WHEN b.thread_id IS NULL OR NOT coalesce(o.any_text, FALSE) THEN 'empty'
              WHEN o.bad OR b.af OR b.tw THEN 'broken'
              WHEN b.op THEN 'no_reply' END AS fault
  FROM (SELECT DISTINCT id FROM threads WHERE id IS NOT NULL) t
  LEFT JOIN by_turn b ON b.thread_id = t.id LEFT JOIN by_row o ON o.thread_id = t.id
)
"""

P1_FOUND = f"WITH {_TURNS} SELECT thread_id, fault FROM faults WHERE fault IS NOT NULL"

P1_CONVERSATIONS = f"""WITH {_TURNS}
SELECT t.thread_id, t.turn_no, t.r AS role, t.id AS message_id, t.created_at, t.content
FROM turns t JOIN faults f ON f.thread_id = t.thread_id AND f.fault IS NULL"""

#: Found again from links alone, the conversations are the same.
P1_LINKED = P1_CONVERSATIONS

P3_FOUND = "SELECT DISTINCT id AS chunk_id FROM chunks WHERE length(content) > 1000"
