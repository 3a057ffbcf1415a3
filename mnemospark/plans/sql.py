"""The oracle's SQL for tokens, stems, statistics and ranking, built from the same fixed values."""

from __future__ import annotations

from mnemospark.functions import text as T


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def words(text: str) -> str:
    raw = f"regexp_extract_all(lower({text}), '[a-z0-9][a-z0-9''_-]*')"
    trimmed = f"list_transform({raw}, lambda x: regexp_replace(regexp_replace(x, '^[''_-]+', ''), '[''_-]+$', ''))"
    return f"list_filter({trimmed}, lambda x: length(x) >= 2 AND x NOT IN ({quoted(T.STOPWORDS)}))"


def stem(word: str) -> str:
    table = T._whole_form()
    lookup = f"coalesce(map([{quoted(table)}], [{quoted(table.values())}])[x], x)"
    doubles = " OR ".join(f"x LIKE '%{c}{c}'" for c in T.DOUBLES)
    steps = [
        lookup,
        "CASE WHEN length(x) <= 3 THEN x || '|' WHEN x LIKE '%sses' OR x LIKE '%ies' THEN x[:-3] WHEN x LIKE '%s' AND x NOT LIKE '%ss' THEN x[:-2] ELSE x END",
        f"CASE WHEN x LIKE '%|' THEN x ELSE regexp_replace(x, '({'|'.join(T.SUFFIXES)})$', '') END",
        f"CASE WHEN x NOT LIKE '%|' AND length(x) >= 4 AND ({doubles}) THEN x[:-2] ELSE x END",
        "CASE WHEN length(x) >= 4 AND x LIKE '%e' AND x NOT LIKE '%ee' THEN x[:-2] ELSE x END",
        "CASE WHEN x NOT LIKE '%|' AND length(x) > 3 AND regexp_matches(x, '[^aeiou]y$') THEN x[:-2] || 'i' ELSE x END",
        "rtrim(x, '|')",
    ]
    out = f"[{word}]"
    for s in steps:
        out = f"list_transform({out}, lambda x: {s})"
    return f"{out}[1]"


def terms(source: str = "SELECT doc_id, text FROM documents", queries: list[tuple[int, str]] | str | None = None) -> str:
    """CTEs tok, stems, pos (doc_id, pos, term), post (doc_id, term, tf), len, n; with ``queries`` (rows, or SQL for qid, q) also qt (qid, qpos, term)."""
    asked = ""
    if queries:
        rows = queries if isinstance(queries, str) else "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{q}')" for i, q in queries) + ") v(qid, q)"
        asked = f""", ask AS (SELECT qid, {words('q')} AS ws FROM ({rows})),
qw AS (SELECT qid, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS qpos FROM ask),
qt AS (SELECT qid, qpos, {stem('w')} AS term FROM qw)"""
    return f"""WITH src AS ({source}),
tok AS (SELECT doc_id, {words("text")} AS ws FROM src),
flat AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS pos FROM tok),
stems AS (SELECT w, {stem('w')} AS term FROM (SELECT DISTINCT w FROM flat)),
pos AS (SELECT doc_id, pos, term FROM flat JOIN stems USING (w)),
post AS (SELECT doc_id, term, count(*) AS tf FROM pos GROUP BY ALL),
len AS (SELECT doc_id, sum(tf) AS len FROM post GROUP BY doc_id),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
n AS (SELECT count(*) AS n_chunks, coalesce(avg(len), 0) AS avgdl FROM len){asked}"""


BM25 = """, bm AS (
SELECT qid, doc_id, sum(times * ln(1 + (n_chunks - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl))) AS bm25
FROM (SELECT qid, term, count(*) AS times FROM qt GROUP BY ALL) JOIN post USING (term) JOIN df USING (term) JOIN len USING (doc_id), n GROUP BY ALL)"""

BOOST = """, qd AS (SELECT DISTINCT qid, term FROM qt), qn AS (SELECT qid, count(*) AS q FROM qd GROUP BY qid),
hit AS (SELECT qid, doc_id, pos, term FROM pos JOIN qd USING (term)),
nxt AS (SELECT a.qid, a.doc_id, a.pos, b.term, min(b.pos) AS p FROM hit a JOIN hit b ON a.qid = b.qid AND a.doc_id = b.doc_id AND b.pos >= a.pos GROUP BY ALL),
sp AS (SELECT qid, doc_id, pos, count(*) AS have, max(p) - pos AS span FROM nxt GROUP BY qid, doc_id, pos),
best AS (SELECT qid, doc_id, max(have) AS d, min(span) FILTER (WHERE have = top) AS span FROM (SELECT *, max(have) OVER (PARTITION BY qid, doc_id) AS top FROM sp) GROUP BY ALL),
prox AS (SELECT qid, doc_id, CASE WHEN d >= 2 AND q >= 2 THEN d / q * (d - 1) / span ELSE 0.0 END AS proximity FROM best JOIN qn USING (qid)),
ph AS (SELECT DISTINCT qid, doc_id FROM (SELECT qid, doc_id, pos - qpos AS st, count(DISTINCT qpos) AS c FROM pos JOIN qt USING (term) GROUP BY ALL)
  JOIN (SELECT qid, count(*) AS n, count(DISTINCT term) AS kinds FROM qt GROUP BY qid) USING (qid) WHERE c = n AND kinds > 1),
lex AS (SELECT bm.qid, bm.doc_id, bm25 * (1 + 0.6 * coalesce(proximity, 0) + CASE WHEN ph.doc_id IS NULL THEN 0 ELSE 1 END) AS lexical
  FROM bm LEFT JOIN prox ON prox.qid = bm.qid AND prox.doc_id = bm.doc_id LEFT JOIN ph ON ph.qid = bm.qid AND ph.doc_id = bm.doc_id)"""

DATED = "SELECT doc_id, text, source, TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * (doc_id % 365) AS when_ts FROM documents"
ASKED = "SELECT conv_id * 1000 + turn AS qid, text AS q FROM conversations WHERE conv_id % 50 = 0 AND role = 'user'"
RECENCY = "pow(0.5, greatest(0, epoch_ms(TIMESTAMP '2024-12-31') - epoch_ms(when_ts)) / 86400000.0 / 60)"
