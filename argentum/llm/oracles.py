"""DuckDB SQL for the queries that SQL can express, over whole texts of documents."""

WORDS = r"'[^\x20\x09-\x0D]+'"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: A window is known by the hash of its bytes; the first place of each is its least (doc_id, place).
SUFFIX_DEDUP = """WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS h FROM documents),
b AS (SELECT doc_id, i, hex(array_slice(h, i, i)) AS x, CASE WHEN i + 99 <= octet_length(h) THEN md5(array_slice(h, i, i + 99)) END AS w FROM (SELECT doc_id, h, unnest(generate_series(1, octet_length(h))) AS i FROM d)),
f AS (SELECT *, w IS NOT NULL AND row_number() OVER (PARTITION BY w ORDER BY doc_id, i) > 1 AS again FROM b),
g AS (SELECT *, max(CAST(again AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone FROM f),
s AS (SELECT *, gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), 0) = 0 AS begins FROM g),
r AS (SELECT doc_id, sum(gone) AS n_removed, count(*) FILTER (begins) AS n_spans, string_agg(x, '' ORDER BY i) FILTER (gone = 0) AS kept FROM s GROUP BY doc_id)
SELECT d.doc_id, octet_length(h) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN r ON r.doc_id = d.doc_id"""

FM_DEDUP = f"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WORDS}) AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS i, len(w) AS n, w FROM d),
x AS (SELECT doc_id, i, word, CASE WHEN i + 12 <= n THEN array_to_string(list_slice(w, i, i + 12), ' ') END AS win FROM p),
f AS (SELECT *, win IS NOT NULL AND min(doc_id) OVER (PARTITION BY win) < doc_id AS again FROM x),
g AS (SELECT *, max(CAST(again AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM f),
r AS (SELECT doc_id, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM g GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN r ON r.doc_id = d.doc_id"""

NEAR_DUPLICATES = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER}, {WORDS}) AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS sh FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, least(len(w), 1)))) AS i FROM d)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY 1, 2) p JOIN n u ON u.doc_id = a JOIN n v ON v.doc_id = b WHERE 100 * c >= 75 * (u.n + v.n - c)),
reach AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON l.a = r.b),
m AS (SELECT a, min(b) AS least FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.least, d.doc_id)) AS component_id, least(d.doc_id, coalesce(m.least, d.doc_id)) = d.doc_id AS kept FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.a = d.doc_id"""


def _way(state: str, letters: str, cost: str = "0") -> str:
    """A state's cost and edits with more of both."""
    return f"{{'c': {state}.c + {cost} + {3 * letters.count('I')}, 'a': {state}.a || '{letters}'}}"


#: Damage by CRC-32 bit by bit, faults, then a row at a time over all conversations: b0 to b3 are the cheapest edits for each state
#: of the pattern (cost first, then letters), e0 to e3 those after insertions; at last the edits are laid beside the rows.
_KEPT, _MADE = "CASE WHEN stays THEN extra ELSE 1000000 END", "CASE WHEN stays THEN 3 + extra ELSE 1000000 END"
_ONLY = "CASE WHEN stays AND r = '{}' THEN extra ELSE 1000000 END"
REPAIR = f"""WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
f AS (SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, len(k) + 1), lambda i: ascii(substr(k, i, 1))::BIGINT)),
 lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) % 20 AS fate FROM k),
d AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE fate WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM f),
o AS (SELECT *, left(role, 1) AS r, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(CAST(length(role) AS VARCHAR) || ':' || role || text), copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS same FROM d),
z AS MATERIALIZED (SELECT *, lag(r) OVER (PARTITION BY conv_id ORDER BY i) || r AS pair, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN same > 1 THEN 'duplicate' WHEN regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM o),
y AS MATERIALIZED (SELECT *, fault IN ('', 'truncated') AS stays, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS extra FROM z),
m AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, {{'c': 0, 'a': ''}} AS b0, {{'c': 1000000, 'a': ''}} AS b1, {{'c': 1000000, 'a': ''}} AS b2, {{'c': 1000000, 'a': ''}} AS b3 FROM conversations UNION ALL
 SELECT n.conv_id, y.i, {_way("e0", "D", "4")}, least({_way("e1", "D", "4")}, {_way("e0", "K", _ONLY.format("s"))}),
  least({_way("e2", "D", "4")}, {", ".join(_way(e, "K", _ONLY.format("u")) + ", " + _way(e, "R", _MADE) for e in ("e0", "e1", "e3"))}), least({_way("e3", "D", "4")}, {_way("e2", "K", _ONLY.format("a"))}, {_way("e2", "R", _MADE)})
 FROM (SELECT conv_id, i, b0 AS e0, b1 AS e1, least(b2, {", ".join(_way(b, "I") for b in ("b0", "b1", "b3"))}) AS e2, least(b3, {_way("b2", "I")}, {_way("b0", "II")}, {_way("b1", "II")}) AS e3 FROM m) n JOIN y ON y.conv_id IS NOT DISTINCT FROM n.conv_id AND y.i = n.i + 1),
l AS (SELECT conv_id, arg_max(least(b0, b3, {_way("b2", "I")}, {_way("b0", "II")}, {_way("b1", "II")}), i) AS best FROM m GROUP BY conv_id),
p AS (SELECT conv_id, best.a AS audit, unnest(range(1, length(best.a) + 1)) AS p FROM l),
w AS (SELECT *, substr(audit, p, 1) AS e, length(replace(audit, 'D', '')) AS n, length(replace(left(audit, p), 'I', '')) AS i, length(replace(left(audit, p), 'D', '')) AS j FROM p),
t AS (SELECT w.conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (j - n % 2) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS said
 FROM w LEFT JOIN y ON y.conv_id IS NOT DISTINCT FROM w.conv_id AND y.i = w.i WHERE e <> 'D' GROUP BY w.conv_id),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM y GROUP BY conv_id)
SELECT l.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(best.c AS BIGINT) AS cost, best.a AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM l LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM l.conv_id LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM l.conv_id"""
