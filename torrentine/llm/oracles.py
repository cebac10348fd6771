"""DuckDB SQL for the training-data queries that SQL can express.

Fingerprints, tokenizers, edit distance, compressors and cuts have none; their tests compare with brute force.
"""

from __future__ import annotations

WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

OP3 = """WITH r AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
 l AS (SELECT d, min(page_id) AS lead FROM r WHERE n >= 100 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, r.d AS payload_digest, CASE WHEN page_id IS NULL AND lead IS NOT NULL OR page_id > lead THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN page_id IS NULL OR page_id > lead THEN lead END AS refers_to FROM r LEFT JOIN l ON r.d = l.d AND n >= 100"""

#: Words with their places, documents told apart by their row; and the places that windows which come twice cover.
_PLACES = f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
 g AS (SELECT k, i, array_to_string(list_slice(w, i, i + %(width)d - 1), ' ') AS s FROM (SELECT k, w, unnest(generate_series(1, len(w) - %(width)d + 1)) AS i FROM d WHERE len(w) >= %(width)d)),
 hit AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY s%(within)s) AS n FROM g) WHERE n > 1),
 gone AS (SELECT DISTINCT k, i + j AS p FROM hit, generate_series(0, %(width)d - 1) t(j))"""

_SPOTS = _PLACES % {"width": 3, "within": ", k"}
OP5 = rf"""{_SPOTS},
 m AS (SELECT k, doc_id, text, w, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
 q AS (SELECT m.*, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words FROM m LEFT JOIN (SELECT k, count(*) AS n FROM gone GROUP BY k) r ON m.k = r.k),
 b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR n_symbols * 10 > n_words OR word_chars < 3 * n_words OR word_chars > 10 * n_words
 OR n_dup_lines * 2 > n_lines OR length(regexp_replace(text, '[^\p{{Lu}}]+', '', 'g')) * 2 > word_chars OR (length(text) - length(replace(text, '!', ''))) * 2 > n_words
 OR len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) * 10 < 6 * n_words) AS kept FROM b"""

OP10 = f"""{_PLACES % {"width": 35, "within": ""}},
 p AS (SELECT d.k, u.i, d.w[u.i] AS word FROM d, generate_series(1, len(d.w)) u(i)),
 kept AS (SELECT p.k, string_agg(word, ' ' ORDER BY p.i) AS s, count(*) AS n FROM p LEFT JOIN gone ON gone.k = p.k AND gone.p = p.i WHERE gone.k IS NULL GROUP BY p.k)
SELECT d.doc_id, len(d.w) AS n_words, len(d.w) - coalesce(kept.n, 0) AS n_removed, sha256(coalesce(kept.s, '')) AS kept_sha256 FROM d LEFT JOIN kept ON d.k = kept.k"""

#: The counts of op7's base patterns; its spans stand in op7_secret_scan.
SECRET_COUNTS = r"""SELECT doc_id, len(list_filter(regexp_extract_all(coalesce(text, ''), '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda x: length(x) >= 12)) AS n_assign,
 len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 18)) AS n_access, len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 16)) AS n_hex FROM documents"""

SQL = {"op3_warc_chunks": OP3, "op5_quality_rules": OP5, "op10_substring_dedup": OP10, "secret_counts": SECRET_COUNTS}


def _crc_steps(n: int, bits: int = 4) -> int:
    for _ in range(bits):
        n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
    return n


def _crc32(s: str) -> str:
    """crc32 of a string's UTF-8 bytes, a half-byte at a time, the lower first."""
    table = "[" + ", ".join(f"{_crc_steps(n)}" for n in range(16)) + "]"
    halves = f"list_transform(range(length(hex({s}))), lambda i: CAST(instr('123456789ABCDEF', substr(hex({s}), CAST(xor(i, 1) AS INTEGER) + 1, 1)) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {halves}), lambda c, x: xor(c >> 4, CAST({table}[(xor(c, x) & 15) + 1] AS BIGINT))), 4294967295)"


_PLAIN = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
OP13 = f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, {_PLAIN} AS w FROM documents), b AS MATERIALIZED (SELECT {_PLAIN} AS w FROM benchmark),
 f AS MATERIALIZED (SELECT k, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT k, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, generate_series(1, 3) t(n) WHERE len(w) >= n)),
 g AS MATERIALIZED (SELECT array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM b, generate_series(1, 3) t(n) WHERE len(w) >= n)),
 h AS MATERIALIZED (SELECT s, {_crc32("s")} % 10000 AS bucket FROM (SELECT s FROM f UNION SELECT s FROM g)),
 src AS (SELECT bucket, count(*) AS n FROM f JOIN h USING (s) GROUP BY bucket), tgt AS (SELECT bucket, count(*) AS n FROM g JOIN h USING (s) GROUP BY bucket),
 gain AS MATERIALIZED (SELECT r.bucket, CAST(floor(1000 * ln((coalesce(tgt.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM f) + 10000)::DOUBLE / ((coalesce(src.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM g) + 10000)::DOUBLE))) AS BIGINT) AS gain
  FROM range(10000) r(bucket) LEFT JOIN src USING (bucket) LEFT JOIN tgt USING (bucket)),
 w AS (SELECT k, CAST(count(*) AS BIGINT) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM f JOIN h USING (s) JOIN gain USING (bucket) GROUP BY k),
 r AS (SELECT k, doc_id, len(w) >= 20 AS fit, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN w USING (k)),
 o AS (SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id, k) AS place, count(*) OVER (PARTITION BY fit) AS n FROM r)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN fit AND place <= 5 * n // 100 THEN place END AS rank FROM o"""


def _edit(rest: str, cost, letter: str, said: str) -> str:
    """An edit before what a state has: its cost and letter, and the turn that it leaves."""
    return f"{{'c': {rest}.c + {cost}, 'k': '{letter}' || {rest}.k, 's': {f'chr(10) || {said} || ' if said else ''}{rest}.s}}"


def _least(*options: str) -> str:
    return f"list_sort([{', '.join(options)}])[1]"


SAID = "role || ':' || text"


def _row(state: str, *keeps: tuple[str, str]) -> str:
    """The best edit of a row in a state: to delete it, or unless that is required to keep or rerole it."""
    more = "CASE fault WHEN 't' THEN 5 ELSE 0 END"
    [give] = {to for c, to in keeps if c != "s"}
    kept = " ".join(f"WHEN c = '{c}' THEN [{_edit(to, more, 'K', SAID)}]" for c, to in keeps)
    given = _edit(give, f"1 + {more}", "R", f"'{dict(u='user', a='assistant')[give]}:' || text")
    return f"list_sort([{_edit(state, 2, 'D', '')}] || CASE WHEN fault IN ('b', 'd') THEN [] ELSE [{given}] || CASE {kept} ELSE [] END END)[1]"


#: Rows after damage in order, their first fault, and least (cost, rest of the audit, rest of the text) of each grammar state from the end on.
_S = "coalesce(CAST({} AS VARCHAR), ' ')"
OP12 = f"""WITH RECURSIVE x AS (SELECT conv_id, turn, {_S.format("role")} AS role, {_S.format("text")} AS text, {_crc32(f"({_S.format('conv_id')} || ':' || {_S.format('turn')})")} % 20 AS dice FROM conversations),
 y AS (SELECT conv_id, turn, CASE dice WHEN 4 THEN 'user' ELSE role END AS role, CASE dice WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM x, generate_series(1, CASE dice WHEN 3 THEN 2 ELSE 1 END) t(n) WHERE dice <> 0),
 z AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
  regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g') AS kept, count(*) OVER (PARTITION BY conv_id) AS n FROM y),
 r AS MATERIALIZED (SELECT conv_id, turn, role, text, i, n, role[1:1] AS c, lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS prev, CASE WHEN kept = '' THEN 'b' WHEN i > min(i) OVER (PARTITION BY conv_id, role, text) THEN 'd' WHEN right(kept, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM z),
 ids AS (SELECT conv_id, max(n) AS n FROM (SELECT conv_id, n FROM r UNION ALL SELECT conv_id, 0 FROM conversations) GROUP BY conv_id),
 p AS (SELECT conv_id, n + 1 AS i, {{'c': 0, 'k': '', 's': ''}} AS e, {{'c': 10, 'k': 'II', 's': chr(10) || 'user:' || chr(10) || 'assistant:'}} AS s,
   {{'c': 5, 'k': 'I', 's': chr(10) || 'assistant:'}} AS u, {{'c': 0, 'k': '', 's': ''}} AS a FROM ids
  UNION ALL
  SELECT conv_id, i, {_least("e0", _edit("u0", 5, "I", "'user:'"), _edit(_edit("a0", 5, "I", "'assistant:'"), 5, "I", "'user:'"))},
   {_least("s0", _edit("u0", 5, "I", "'user:'"), _edit(_edit("a0", 5, "I", "'assistant:'"), 5, "I", "'user:'"))}, {_least("u0", _edit("a0", 5, "I", "'assistant:'"))}, {_least("a0", _edit("u0", 5, "I", "'user:'"))}
  FROM (SELECT conv_id, r.i, {_row("e", ("s", "s"), ("u", "u"))} AS e0, {_row("s", ("u", "u"))} AS s0, {_row("u", ("a", "a"))} AS u0, {_row("a", ("u", "u"))} AS a0
   FROM (SELECT p.*, r.c, r.role, r.text, r.fault FROM p JOIN r ON p.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = p.i - 1) AS q(conv_id, i0, e, s, u, a, c, role, text, fault), (SELECT i0 - 1) AS r(i))),
 m AS (SELECT conv_id, CASE WHEN max(turn) IS NULL THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
  count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (prev IS NOT NULL AND prev[1:1] || c NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
SELECT p.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
 CAST(e.c AS BIGINT) AS cost, e.k AS audit, sha256(substr(e.s, 2)) AS repaired_sha256 FROM p LEFT JOIN m ON p.conv_id IS NOT DISTINCT FROM m.conv_id WHERE p.i = 1"""

SQL |= {"op12_conversation_repair": OP12, "op13_importance_resampling": OP13}
