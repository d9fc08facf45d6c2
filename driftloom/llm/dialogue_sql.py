"""SQL counterparts of the conversation and spelling queries."""

from __future__ import annotations

#: crc32 of a string column as an expression over the table `crc_table(tab)`.
CRC_TABLE = """crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab
)"""


def crc32(text: str) -> str:
    """Unsigned crc32 of the UTF-8 bytes of an expression."""
    data = (
        f"list_transform(range(length(hex(encode({text}))) // 2), "
        f"lambda i: CAST('0x' || substr(hex(encode({text})), CAST(2 * i + 1 AS INTEGER), 2) AS BIGINT))"
    )
    return (
        f"xor(4294967295, list_reduce(list_prepend(4294967295, {data}), "
        "lambda c, b: xor(c >> 8, tab[CAST(1 + (xor(c, b) & 255) AS INTEGER)])))"
    )


SPELLING = rf"""
WITH RECURSIVE {CRC_TABLE}, r AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS raw FROM documents
), l AS (
  SELECT doc_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS c
  FROM r WHERE length(raw) >= 5 GROUP BY ALL
), h AS (
  SELECT w, c, {crc32("coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || w")} AS h FROM l, crc_table
), d AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, c
  FROM h
), words AS MATERIALIZED (
  SELECT word, CAST(sum(c) AS BIGINT) AS n FROM d WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3
), cuts AS MATERIALIZED (
  SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), pairs AS (
  SELECT x.word, y.word AS near, y.n FROM cuts x JOIN cuts y USING (i, a, b) WHERE x.word <> y.word
  UNION SELECT c.word, w.word, w.n FROM cuts c JOIN words w ON w.word = c.a || c.b
  UNION SELECT w.word, c.word, c.n FROM cuts c JOIN words w ON w.word = c.a || c.b
), best AS (
  SELECT word, count(*) AS n_near, arg_min(near, (-n, near)) AS near, arg_min(n, (-n, near)) AS near_n
  FROM pairs GROUP BY word
), f AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near,
    CASE WHEN b.near_n >= 2 * w.n THEN b.near END AS form, CASE WHEN b.near_n >= 2 * w.n THEN b.near_n END AS form_n
  FROM words w LEFT JOIN best b USING (word)
), chain AS (
  SELECT word, coalesce(form, word) AS root FROM f
  UNION
  SELECT c.word, f.form FROM chain c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, c.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n
FROM f JOIN chain c USING (word) JOIN f e ON e.word = c.root WHERE e.form IS NULL
"""

CHAT = r"""
WITH c AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k
  FROM (
    SELECT conv_id, turn, role, text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
    UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
  )
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(24 + length(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\\\1|', 'g'))
    + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""


def _choices(state: int) -> str:
    """Cheapest edits from a state before a row, of those that delete, change or keep the row."""
    ways = [f"struct_pack(c := v{state}.c + 2, a := 'D' || v{state}.a, r := v{state}.r)"]
    role, nxt = (("user", 2), ("user", 2), ("assistant", 3), ("user", 2))[state]
    ways.append(f"struct_pack(c := v{nxt}.c + CASE WHEN fault IN (1, 2) THEN 1000000 ELSE 1 + broken END, "
                f"a := 'R' || v{nxt}.a, r := chr(10) || '{role}:' || f.text || v{nxt}.r)")
    for initial, nxt in (((("s", 1), ("u", 2)), (("u", 2),), (("a", 3),), (("u", 2),))[state]):
        ways.append(f"struct_pack(c := v{nxt}.c + CASE WHEN fault IN (1, 2) OR left(f.role, 1) <> '{initial}' THEN 1000000 "
                    f"ELSE broken END, a := 'K' || v{nxt}.a, r := chr(10) || f.role || ':' || f.text || v{nxt}.r)")
    return f"list_sort([{', '.join(ways)}])[1]"


def _inserted(state: int, target: str) -> str:
    role = ("user", "user", "assistant", "user")[state]
    return f"struct_pack(c := {target}.c + 5, a := 'I' || {target}.a, r := chr(10) || '{role}:' || {target}.r)"


REPAIR = rf"""
WITH RECURSIVE {CRC_TABLE}, src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS x
  FROM conversations, crc_table
), damaged AS (
  SELECT conv_id, turn, CASE WHEN x = 4 THEN 'user' ELSE role END AS role,
    CASE x WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN x = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM src WHERE x <> 0
), numbered AS (
  SELECT *, rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS body,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS k,
    count(*) OVER (PARTITION BY conv_id) AS n
  FROM damaged
), f AS MATERIALIZED (
  SELECT *, CASE WHEN body = '' THEN 1 WHEN seen > 1 THEN 2 WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
    CASE WHEN body <> '' AND seen = 1 AND right(body, 1) NOT IN ('.', '!', '?') THEN 5 ELSE 0 END AS broken,
    lag(role) OVER (PARTITION BY conv_id ORDER BY k) AS before
  FROM numbered
), best AS (
  SELECT conv_id, n + 1 AS k, struct_pack(c := 0, a := '', r := '') AS v0,
    struct_pack(c := 10, a := 'II', r := chr(10) || 'user:' || chr(10) || 'assistant:') AS v1,
    struct_pack(c := 5, a := 'I', r := chr(10) || 'assistant:') AS v2, struct_pack(c := 0, a := '', r := '') AS v3
  FROM f WHERE k = 1
  UNION ALL
  SELECT conv_id, k, list_sort([w0, {_inserted(0, "u2")}])[1], list_sort([w1, {_inserted(1, "u2")}])[1], u2, u3
  FROM (
    SELECT *, list_sort([w2, {_inserted(2, "w3")}])[1] AS u2, list_sort([w3, {_inserted(3, "w2")}])[1] AS u3
    FROM (
      SELECT f.conv_id, f.k, {_choices(0)} AS w0, {_choices(1)} AS w1, {_choices(2)} AS w2, {_choices(3)} AS w3
      FROM best b JOIN f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.k = b.k - 1
    )
  )
), stats AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
    count(*) FILTER (k > 1 AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal
  FROM f GROUP BY conv_id
)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(v0.c, 0) AS BIGINT) AS cost,
  coalesce(v0.a, '') AS audit, sha256(coalesce(substr(v0.r, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id AND b.k = 1
"""
