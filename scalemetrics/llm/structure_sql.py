"""The statement for ``op11_structure_repair``: cheapest edits by recursion from the last row, audits compared as texts."""

from __future__ import annotations


def option(edit: str, cost: str, state: int, allowed: str | None = None) -> str:
    value = f"{{'c': p.s{state}.c + {cost}, 'a': '{edit}' || p.s{state}.a}}"
    return value if allowed is None else f"CASE WHEN NOT r.must AND ({allowed}) THEN {value} END"


def direct(state: int) -> str:
    """Least of the edits of a row in a state; structs compare by cost, then by audit."""
    expected = {0: 2, 1: 2, 2: 3, 3: 2}[state]
    role = {2: "u", 3: "a"}[expected]
    options = [option("D", "4", state), option("K", "r.extra", expected, f"r.code = '{role}'"), option("R", "3 + r.extra", expected, "true")]
    if state == 0:
        options.append(option("K", "r.extra", 1, "r.code = 's'"))
    return f"list_min([{', '.join(options)}])"


def inserted(state: str, after: str) -> str:
    return f"list_min([{state}, {{'c': {after}.c + 3, 'a': 'I' || {after}.a}}])"


SQL = f"""
WITH RECURSIVE byte_table AS (
  SELECT list(list_reduce([n::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: xor(c >> 1, (c & 1) * 3988292384)) ORDER BY n) AS t FROM range(256) AS g(n)
), fated AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_concat([4294967295::UBIGINT],
               list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda ch: ord(ch)::UBIGINT)),
             lambda acc, b: xor(acc >> 8, t[((xor(acc, b)) & 255)::INT + 1])), 4294967295::UBIGINT) % 20 AS fate
  FROM conversations, byte_table
), damaged AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
         CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN fate = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM fated WHERE fate <> 0
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged
), seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
         rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS cut FROM ordered
), judged AS (
  SELECT conv_id, turn, i, role, text,
         CASE WHEN cut = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(cut, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE '-' END AS code,
         lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS role_before
  FROM seen
), rows_ AS (
  SELECT *, fault IN ('blank', 'duplicate') AS must, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS extra FROM judged
), best AS (
  SELECT conv_id, count(*) + 1 AS i, {{'c': 0::BIGINT, 'a': ''}} AS s0, {{'c': 6::BIGINT, 'a': 'II'}} AS s1, {{'c': 3::BIGINT, 'a': 'I'}} AS s2,
         {{'c': 0::BIGINT, 'a': ''}} AS s3
  FROM rows_ GROUP BY conv_id
  UNION ALL
  SELECT conv_id, i, {inserted("d0", "t2")}, {inserted("d1", "t2")}, t2, t3
  FROM (SELECT *, {inserted("d2", "d3")} AS t2, {inserted("d3", "d2")} AS t3
        FROM (SELECT p.conv_id, r.i AS i, {direct(0)} AS d0, {direct(1)} AS d1, {direct(2)} AS d2, {direct(3)} AS d3
              FROM best p JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i - 1) a) b
), audits AS (SELECT conv_id, s0.c AS cost, s0.a AS audit FROM best WHERE i = 1
), edits AS (
  SELECT conv_id, pos, audit[pos] AS edit, pos - length(replace(left(audit, pos), 'I', '')) AS inserts,
         length(replace(left(audit, pos), 'D', '')) AS place
  FROM (SELECT *, unnest(range(1, length(audit) + 1)) AS pos FROM audits)
), placed AS (
  SELECT e.*, r.role, r.text,
         max(CASE WHEN place = 1 AND edit = 'K' AND left(r.role, 1) = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id) AS has_system
  FROM edits e LEFT JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM e.conv_id AND e.edit <> 'I' AND r.i = e.pos - e.inserts
), texts AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role ELSE CASE WHEN (place - has_system) % 2 = 1 THEN 'user' ELSE 'assistant' END END
           || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY pos) AS repaired
  FROM placed WHERE edit <> 'D' GROUP BY conv_id
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (role_before IS NOT NULL AND left(role_before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal
  FROM rows_ GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN audits a ON a.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM o.conv_id
"""
