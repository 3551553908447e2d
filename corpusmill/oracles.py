"""DuckDB SQL for the registered queries, built from shared common table expressions.

Each text computes its result from the raw tables alone. Queries without an
entry (recursive splitters, MMR, sentence splits with look-behind, NFKC) are checked by tests.
"""

from __future__ import annotations

from corpusmill.functions.text import WHITE
from corpusmill.plans.campaign import PAIRS as CHOSEN
from corpusmill.plans.campaign import REWRITE, VARIANTS, pairs_text
from corpusmill.plans.retrieval import BASES, RERANKED

ORACLE_SQL: dict[str, str] = {}

TOKENS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"
NORMAL = "trim(regexp_replace(lower({0}), '" + WHITE.replace("{", "{{").replace("}", "}}") + "', ' ', 'g'))"


def tokens(x: str) -> str:
    return TOKENS.format(x)


def normal(x: str) -> str:
    return NORMAL.format(x)


def clip(x: str, n: int) -> str:
    return f"CASE WHEN length({x}) > {n} THEN left({x}, {n}) || '…' ELSE {x} END"


#: Line merging: which batch each line is in, line by line; lines of over 2000 characters word by word.
CHUNKS = r"""
lines AS (
  SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i
  FROM (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '\s+$', '')) AS l FROM documents)),
folded AS (
  SELECT doc_id, 0::BIGINT AS i, ''::VARCHAR AS line, 0::BIGINT AS batch, FALSE AS is_open, 0::BIGINT AS used, FALSE AS taken, FALSE AS big
  FROM (SELECT DISTINCT doc_id FROM lines)
  UNION ALL
  SELECT l.doc_id, l.i, l.line,
    CASE WHEN l.line = '' AND NOT f.is_open THEN f.batch
         WHEN length(l.line) <= 2000 AND f.is_open AND f.used + 1 + length(l.line) <= 2000 THEN f.batch ELSE f.batch + 1 END,
    CASE WHEN l.line = '' AND NOT f.is_open THEN FALSE ELSE length(l.line) <= 2000 END,
    CASE WHEN l.line = '' AND NOT f.is_open THEN 0
         WHEN f.is_open AND f.used + 1 + length(l.line) <= 2000 THEN f.used + 1 + length(l.line) ELSE length(l.line) END,
    NOT (l.line = '' AND NOT f.is_open), length(l.line) > 2000
  FROM folded f JOIN lines l ON l.doc_id = f.doc_id AND l.i = f.i + 1),
words AS (
  SELECT doc_id, batch, CASE WHEN i = 1 THEN w ELSE ' ' || w END AS w, row_number() OVER (PARTITION BY doc_id, batch ORDER BY i) AS i
  FROM (SELECT doc_id, batch, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, batch, string_split(line, ' ') AS ws FROM folded WHERE big))
  WHERE NOT (i = 1 AND w = '')),
filled AS (
  SELECT doc_id, batch, i, w, 1::BIGINT AS piece, length(w)::BIGINT AS used FROM words WHERE i = 1
  UNION ALL
  SELECT n.doc_id, n.batch, n.i, n.w, CASE WHEN f.used + length(n.w) > 2000 THEN f.piece + 1 ELSE f.piece END,
    CASE WHEN f.used + length(n.w) > 2000 THEN length(n.w) ELSE f.used + length(n.w) END
  FROM filled f JOIN words n ON n.doc_id = f.doc_id AND n.batch = f.batch AND n.i = f.i + 1),
pieces AS (
  SELECT doc_id, batch, 0::BIGINT AS piece, string_agg(line, chr(10) ORDER BY i) AS text FROM folded WHERE taken AND NOT big GROUP BY doc_id, batch
  UNION ALL
  SELECT doc_id, batch, piece, trim(string_agg(w, '' ORDER BY i)) FROM filled GROUP BY doc_id, batch, piece HAVING trim(string_agg(w, '' ORDER BY i)) <> ''),
chunks AS MATERIALIZED (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY batch, piece) - 1 AS pos, text FROM pieces)"""

QUERIES = r"""
queries AS (
  SELECT item_id AS query_id, array_to_string(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')[1:12], ' ') AS question, text AS gold_snippet
  FROM benchmark)"""

TERMS = rf"""
toks AS (SELECT doc_id, pos, {tokens("text")} AS ts FROM chunks),
lengths AS (SELECT doc_id, pos, len(ts) AS dl FROM toks),
postings AS (SELECT doc_id, pos, term, count(*) AS tf FROM (SELECT doc_id, pos, unnest(ts) AS term FROM toks) GROUP BY ALL),
corpus AS (SELECT count(*) AS n, avg(dl) AS average FROM lengths),
raw AS (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS r FROM postings, corpus GROUP BY term),
terms AS (SELECT term, df, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw)"""

LEXICAL = rf"""{TERMS},
asked AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({tokens("question")}) AS term FROM queries) GROUP BY ALL),
matched AS (
  SELECT query_id, p.doc_id, p.pos, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / average))), 8) AS score
  FROM asked JOIN terms USING (term) JOIN postings p USING (term) JOIN lengths l ON l.doc_id = p.doc_id AND l.pos = p.pos, corpus GROUP BY ALL),
lexical AS MATERIALIZED (
  SELECT query_id, c.doc_id, c.pos, coalesce(m.score, 0.0) AS score,
    row_number() OVER (PARTITION BY query_id ORDER BY coalesce(m.score, 0.0) DESC, c.doc_id, c.pos) AS rank
  FROM queries CROSS JOIN lengths c LEFT JOIN matched m USING (query_id, doc_id, pos) QUALIFY rank <= 100)"""


def _hashed(source: str, key: str, text: str) -> str:
    return f"""
  SELECT {key}, h % 64 AS bucket, sum(CASE WHEN (h // 64) % 2 = 0 THEN 1 ELSE -1 END) AS v
  FROM (SELECT {key}, ('0x' || substr(md5(t), 1, 8))::BIGINT AS h FROM (SELECT {key}, unnest({tokens(text)}) AS t FROM {source})) GROUP BY ALL"""


DENSE = f"""
cv AS ({_hashed("chunks", "doc_id, pos", "text")}),
qv AS ({_hashed("queries", "query_id", "question")}),
cn AS (SELECT doc_id, pos, sum(v * v)::DOUBLE AS n FROM cv GROUP BY ALL),
qn AS (SELECT query_id, sum(v * v)::DOUBLE AS n FROM qv GROUP BY ALL),
dots AS (SELECT query_id, doc_id, pos, sum(qv.v * cv.v)::DOUBLE AS dot FROM qv JOIN cv USING (bucket) GROUP BY ALL),
dense AS MATERIALIZED (
  SELECT q.query_id, c.doc_id, c.pos,
    round(2 - 2 * CASE WHEN coalesce(qn.n, 0) * coalesce(cn.n, 0) > 0 THEN coalesce(dot, 0) / sqrt(qn.n * cn.n) ELSE 0 END, 8) AS score,
    row_number() OVER (PARTITION BY q.query_id ORDER BY round(2 - 2 * CASE WHEN coalesce(qn.n, 0) * coalesce(cn.n, 0) > 0 THEN coalesce(dot, 0) / sqrt(qn.n * cn.n) ELSE 0 END, 8), c.doc_id, c.pos) AS rank
  FROM queries q CROSS JOIN chunks c LEFT JOIN qn USING (query_id) LEFT JOIN cn ON cn.doc_id = c.doc_id AND cn.pos = c.pos
  LEFT JOIN dots d ON d.query_id = q.query_id AND d.doc_id = c.doc_id AND d.pos = c.pos QUALIFY rank <= 100)"""

WITH_CHUNKS = f"WITH RECURSIVE {CHUNKS}"
WITH_LEXICAL = f"WITH RECURSIVE {CHUNKS},{QUERIES},{LEXICAL}"
WITH_LISTS = f"{WITH_LEXICAL},{DENSE}"


def seen(parts: list[str], k: int) -> str:
    """First occurrences in the order of ``seen``; parts select query_id, doc_id, pos, seen."""
    return f"""SELECT query_id, doc_id, pos, min(seen) AS seen, row_number() OVER (PARTITION BY query_id ORDER BY min(seen), doc_id, pos) AS rank
  FROM ({" UNION ALL ".join(parts)}) GROUP BY query_id, doc_id, pos QUALIFY rank <= {k}"""


def part(name: str, n: int, order: str) -> str:
    return f"SELECT query_id, doc_id, pos, {order} AS seen FROM {name} WHERE rank <= {n}"


def rrf(k: int, constant: int, fetch: int) -> str:
    fetch = max(fetch, k)
    return f"""SELECT query_id, doc_id, pos, round(sum(1.0::DOUBLE / ({constant} + r)), 8) AS score,
    row_number() OVER (PARTITION BY query_id ORDER BY round(sum(1.0::DOUBLE / ({constant} + r)), 8) DESC, min(l * 1000000 + r), doc_id, pos) AS rank
  FROM (SELECT query_id, doc_id, pos, rank AS r, 0 AS l FROM dense WHERE rank <= {fetch} UNION ALL SELECT query_id, doc_id, pos, rank, 1 FROM lexical WHERE rank <= {fetch})
  GROUP BY query_id, doc_id, pos QUALIFY rank <= {k}"""


def scaled(v: str) -> str:
    low, high = (f"{f}(CASE WHEN {v} > 0 THEN {v} END) OVER (PARTITION BY query_id)" for f in ("min", "max"))
    return f"CASE WHEN {v} <= 0 THEN 0.0 WHEN {high} <= {low} THEN 1.0 ELSE ({v} - {low}) / ({high} - {low}) END"


def weighted(k: int, w: float) -> str:
    fetch = max(20, k)
    return f"""SELECT query_id, doc_id, pos, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, dr NULLS LAST, br NULLS LAST, doc_id, pos) AS rank
  FROM (SELECT query_id, doc_id, pos, dr, br, round({w}::DOUBLE * ({scaled("d")}) + (1 - {w}::DOUBLE) * ({scaled("b")}), 8) AS score
    FROM (SELECT query_id, doc_id, pos, x.rank AS dr, y.rank AS br, coalesce(1 / (1 + x.score), 0.0) AS d, coalesce(y.score, 0.0) AS b
      FROM (SELECT * FROM dense WHERE rank <= {fetch}) x FULL JOIN (SELECT * FROM lexical WHERE rank <= {fetch}) y USING (query_id, doc_id, pos))) QUALIFY rank <= {k}"""


def base(name: str, k: int) -> str:
    """A base retriever's k rows with rank and score."""
    fetch = max(20, k)
    simple = {"dense_sim_k10": "dense", "bm25_k10": "lexical"}
    if name in simple:
        return f"SELECT query_id, doc_id, pos, score, rank FROM {simple[name]} WHERE rank <= {k}"
    if name.startswith("hyb_rrf"):
        return rrf(k, 30 if name.endswith("k30") else 60, 40 if name.endswith("fetch40") else 20)
    if name.startswith("hyb_weighted"):
        return weighted(k, 0.5 if name.endswith("norm") else 0.7)
    if name == "hyb_interleave":
        return seen([part("dense", fetch, "2 * (rank - 1)"), part("lexical", fetch, "2 * (rank - 1) + 1")], k)
    if name == "hyb_fill_dense_then_bm25":
        return seen([part("dense", max(5, k // 2), "rank"), part("lexical", fetch, "rank + 1000000"), part("dense", fetch, "rank + 2000000")], k)
    raise ValueError(name)


def coverage(question: str, text: str) -> str:
    asked = f"list_distinct({tokens(question)})"
    return f"CASE WHEN len({asked}) = 0 THEN 0.0 ELSE len(list_intersect({asked}, list_distinct({tokens(f'left({text}, 8000)')})))::DOUBLE / len({asked}) END"


def reranked(rows: str, k: int | None) -> str:
    cut = "" if k is None else f" QUALIFY rank <= {k}"
    return f"""SELECT query_id, doc_id, pos, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, former, doc_id, pos) AS rank
  FROM (SELECT r.query_id, r.doc_id, r.pos, r.rank AS former, round({coverage("q.question", "c.text")}, 8) AS score
    FROM ({rows}) r JOIN queries q ON q.query_id = r.query_id JOIN chunks c ON c.doc_id = r.doc_id AND c.pos = r.pos){cut}"""


def padded(rows: str, pools: list[tuple[str, int]], k: int) -> str:
    return seen([f"SELECT query_id, doc_id, pos, rank AS seen FROM ({rows})", *(part(p, n, f"rank + {i + 1}000000") for i, (p, n) in enumerate(pools))], k)


def retriever(name: str, k: int = 10) -> str:
    plain = name.removesuffix(RERANKED)
    rows = reranked(base(plain, max(50, 5 * k)), k) if name.endswith(RERANKED) else base(plain, k)
    return padded(rows, [("dense", 80), ("lexical", 80)], k)


RANKED = "SELECT query_id, rank, doc_id, pos FROM ({0})"
SCORED = "SELECT query_id, rank, doc_id, pos, round(score, 6) AS score FROM ({0})"

REFERENCE = f"""
gold AS MATERIALIZED (
  SELECT q.query_id, q.question, q.gold_snippet, min(d.doc_id) AS reference
  FROM (SELECT *, {normal("gold_snippet")} AS wanted FROM queries) q LEFT JOIN (SELECT doc_id, {normal("text")} AS t FROM documents) d ON wanted <> '' AND contains(d.t, q.wanted)
  GROUP BY ALL)"""

CHECKED = [r for b in (BASES, tuple(b + RERANKED for b in BASES)) for r in b if "mmr" not in r]
GRID = "\ngrid AS MATERIALIZED (" + "\n UNION ALL ".join(f"SELECT 'line_n_merge' AS strategy, '{r}' AS retriever, query_id, rank, doc_id, pos FROM ({retriever(r)})" for r in CHECKED) + ")"
HITS = f"""
hits AS MATERIALIZED (
  SELECT cells.strategy, cells.retriever, g.query_id, min(CASE WHEN contains({normal("c.text")}, {normal("g.gold_snippet")}) THEN r.rank END) AS first_hit
  FROM (SELECT DISTINCT strategy, retriever FROM grid) cells CROSS JOIN gold g
  LEFT JOIN grid r ON r.strategy = cells.strategy AND r.retriever = cells.retriever AND r.query_id = g.query_id AND r.doc_id = g.reference
  LEFT JOIN chunks c ON c.doc_id = r.doc_id AND c.pos = r.pos GROUP BY ALL)"""
WITH_HITS = f"{WITH_LISTS},{REFERENCE},{GRID},{HITS}"
SUMMARY = """SELECT strategy, retriever, round(count(first_hit) / count(*), 4) AS hit_rate, round(sum(coalesce(1.0::DOUBLE / first_hit, 0.0)) / count(*), 4) AS mrr, count(*) AS n
FROM hits GROUP BY strategy, retriever"""

REPS = f"""
reps AS (SELECT coalesce(text, '') AS text, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1),
total AS (SELECT sum(copies) AS n FROM reps),
tf AS (SELECT doc_id, copies, term, count(*) AS tf FROM (SELECT doc_id, copies, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM reps) GROUP BY ALL),
df AS (SELECT term, sum(copies) AS df FROM tf GROUP BY term),
rawv AS (SELECT doc_id, term, tf * (ln((1.0::DOUBLE + n) / (1 + df)) + 1) AS raw FROM tf JOIN df USING (term), total),
vec AS MATERIALIZED (SELECT doc_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS weight FROM rawv)"""
PAIRS = f"""{REPS},
pairs AS MATERIALIZED (
  SELECT x.doc_id AS a, y.doc_id AS b, round(sum(x.weight * y.weight), 6) AS cosine FROM vec x JOIN vec y USING (term) WHERE x.doc_id < y.doc_id GROUP BY ALL HAVING round(sum(x.weight * y.weight), 6) > 0.95)"""
GROUPS = f"""WITH RECURSIVE {PAIRS},
edges AS (SELECT a AS x, b AS y FROM pairs UNION SELECT b, a FROM pairs),
reach AS (SELECT doc_id AS node, doc_id AS other FROM reps UNION SELECT r.node, e.y FROM reach r JOIN edges e ON e.x = r.other),
roots AS (SELECT node, min(other) AS component FROM reach GROUP BY node),
members AS MATERIALIZED (
  SELECT d.doc_id, r.component, p.doc_id AS representative, d.n_chars FROM documents d JOIN reps p ON p.text = coalesce(d.text, '') JOIN roots r ON r.node = p.doc_id)"""

LEGAL = r"""made AS (
  SELECT doc_id, (doc_id % 9)::VARCHAR || (1990 + doc_id % 30)::VARCHAR || ['R', 'D', 'L', 'x'][doc_id % 4 + 1] || lpad((doc_id % 10000)::VARCHAR, 4, '0')
    || CASE WHEN doc_id % 5 = 0 THEN 'R(01)' ELSE '' END AS id FROM documents),
parts AS (SELECT doc_id, id, '^([0-9])([0-9]{4})([A-Z]{1,2})([0-9]{4})(?:R?\(([0-9]+)\))?$' AS p FROM made)"""

LAST_TURNS = f"""SELECT conv_id, turn, role, md5(CASE WHEN length(text) > 120 THEN left(text, 119) || '…' ELSE text END) AS text
FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) <= 3"""

SCORES = """scores AS (
  SELECT vec_id, CASE WHEN vec_id % 7 <> 0 THEN embedding[1]::DOUBLE END AS m1, CASE WHEN vec_id % 2 = 0 THEN embedding[2]::DOUBLE END AS m2,
    CASE WHEN vec_id % 11 = 0 THEN NULL ELSE embedding[3]::DOUBLE END AS m3, CASE WHEN vec_id % 13 = 0 THEN 'no_answer' END AS skip_reason FROM embeddings)"""


def statistic(m: str) -> str:
    return f"""SELECT '{m}' AS metric, round(avg({m}), 6) AS mean, CASE WHEN count({m}) = 1 THEN 0.0 ELSE round(stddev_samp({m}), 6) END AS stdev, count({m}) AS n FROM scores WHERE skip_reason IS NULL"""


_asked = rf"regexp_replace('Which provision of the document sets out, among its other rules, the following: ' || array_to_string(string_split(question, ' ')[1:6], ' '), '\?', '', 'g')"  # noqa: F541
_asked_tokens = f"list_distinct({tokens(normal(_asked))})"
QUESTION = f"""round(len(list_intersect({_asked_tokens}, list_distinct({tokens(normal("gold_snippet"))}))), 0) <= 0.55 * len({_asked_tokens})"""

SIMILARITY = """
pairs5 AS (
  SELECT l.query_id, l.rank, x, y FROM (SELECT query_id, doc_id, pos, rank FROM lexical WHERE rank <= 5) l JOIN chunks c USING (doc_id, pos) JOIN queries q USING (query_id),
  LATERAL (SELECT {0} AS x, {1} AS y)),
near AS (SELECT query_id, rank, CASE WHEN CASE WHEN greatest(length(x), length(y)) = 0 THEN 1.0 ELSE 1 - levenshtein(x, y)::DOUBLE / greatest(length(x), length(y)) END >= 0.5 THEN 1 ELSE 0 END AS hit FROM pairs5)""".format(
    *(normal(rf"regexp_replace({x}, '[^\x20-\x7e]', '?', 'g')") for x in ("c.text", "q.gold_snippet"))
)

ORACLE_SQL |= {
    "norm_text": f"SELECT doc_id, md5({normal('text')}) AS digest, length({normal('text')}) AS n FROM documents",
    "tokenize_counts": f"SELECT doc_id, len({tokens('text')}) AS n_tokens, len(list_distinct({tokens('text')})) AS n_distinct FROM documents",
    "chunk_line_merge": f"{WITH_CHUNKS} SELECT doc_id, pos, length(text) AS n, md5(text) AS digest FROM chunks",
    "chunk_uids": f"{WITH_CHUNKS} SELECT doc_id, pos, left(sha256(doc_id::VARCHAR || '|line_n_merge|' || pos::VARCHAR), 32) AS chunk_uid FROM chunks",
    "chunk_global_index": f"""{WITH_CHUNKS}, numbered AS (SELECT doc_id, pos, row_number() OVER (ORDER BY doc_id, pos) - 1 AS idx FROM chunks)
SELECT doc_id, pos, idx, left(sha256(doc_id::VARCHAR || '|line_n_merge|' || idx::VARCHAR), 32) AS uid FROM numbered""",
    "chunk_stats": f"""{WITH_CHUNKS} SELECT 'line_n_merge' AS strategy, count(*) AS n_chunks, quantile_cont(length(text), 0.5)::DOUBLE AS median_chars,
floor(greatest(60, least(250, quantile_cont(length(text), 0.5) / 6)))::BIGINT AS target_words FROM chunks""",
    "citations_in_text": r"""SELECT conv_id, turn, array_to_string(list_transform(list_filter(list_transform(ranks, lambda x, i: CASE WHEN list_position(ranks, x) = i THEN x END), lambda x: x IS NOT NULL), lambda x: x::VARCHAR), ',') AS ranks
FROM (SELECT conv_id, turn, list_transform(regexp_extract_all(text || ' [' || turn::VARCHAR || '] [7][x][' || (conv_id % 5)::VARCHAR || ']', '\[([0-9]{1,9})\]', 1), lambda x: x::INTEGER) AS ranks FROM conversations)""",
    "snippets_and_titles": rf"""SELECT doc_id, md5({clip("text", 400)}) AS snippet, md5({clip("text", 800)}) AS preview,
CASE WHEN length(one) > 48 THEN rtrim(left(one, 45)) || '…' ELSE one END AS title FROM (SELECT doc_id, text, trim(regexp_replace(text, '\s+', ' ', 'g')) AS one FROM documents)""",
    "legal_ids": f"""WITH {LEGAL} SELECT doc_id, nullif(regexp_extract(id, p, 1), '')::BIGINT AS sector, nullif(regexp_extract(id, p, 2), '')::BIGINT AS year,
nullif(regexp_extract(id, p, 3), '') AS type, nullif(regexp_extract(id, p, 4), '') AS code, nullif(regexp_extract(id, p, 5), '') AS revision, nullif(regexp_extract(id, p, 5), '') IS NOT NULL AS is_revision FROM parts""",
    "document_urls": "SELECT doc_id, 'https://example.org/doc/' || doc_id::VARCHAR AS url FROM documents",
    "json_repair": "SELECT doc_id, lang, n_chars AS n FROM documents",
    "label_resolve": """WITH n AS (SELECT *, CASE WHEN lang LIKE '%7' THEN lang ELSE 'Name of ' || lang END AS a, CASE WHEN source LIKE '%7' THEN source ELSE 'Name of ' || source END AS b FROM documents)
SELECT doc_id, lang || ',' || source AS label_ids, a || ', ' || b AS categories FROM n""",
    "language_filter": "SELECT doc_id, length(text) AS n FROM documents WHERE lang = 'en'",
    "hash_sample": "SELECT doc_id FROM documents ORDER BY md5('42|' || doc_id::VARCHAR), doc_id LIMIT 100",
    "minimum_length": "SELECT doc_id FROM documents WHERE length(text) >= 500",
    "manifest_semi": "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
    "manifest_anti": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "gold_references": f"WITH {QUERIES},{REFERENCE} SELECT query_id, reference FROM gold",
    "scope_violations": f"WITH {QUERIES},{REFERENCE} SELECT query_id, reference FROM gold WHERE reference IS NOT NULL AND reference NOT IN (SELECT doc_id FROM labels)",
    "input_violations": r"""WITH d AS (SELECT doc_id, text FROM documents UNION ALL SELECT doc_id, text FROM documents WHERE doc_id % 100 = 0),
c AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id)
SELECT (SELECT count(*) FROM d WHERE coalesce(trim(doc_id::VARCHAR), '') = '') AS missing_id, (SELECT count(*) FROM d WHERE coalesce(trim(text), '') = '') AS empty_text, (SELECT count(*) FROM c WHERE doc_id IS NOT NULL AND n > 1) AS duplicate_ids""",
    "chunk_subset_counts": f"""{WITH_CHUNKS} SELECT 'line_n_merge' AS strategy, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels)) AS kept,
count(*) FILTER (WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS dropped FROM chunks""",
    "three_way_count": f"{WITH_CHUNKS} SELECT count(*) AS n FROM chunks JOIN documents d USING (doc_id) JOIN labels l USING (doc_id) WHERE d.lang = 'en' AND l.quality = 1",
    "label_value_counts": "SELECT label, count(*) AS count FROM (SELECT unnest([lang, source]) AS label FROM documents) WHERE label IS NOT NULL GROUP BY label",
    "label_unique": "SELECT count(*) AS n_rows, count(label) AS n_labels, count(DISTINCT label) AS n_distinct FROM (SELECT unnest([lang, source]) AS label FROM documents)",
    "group_size_two_keys": "SELECT lang, source, count(*) AS count FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY lang, source ORDER BY count DESC, lang, source LIMIT 30",
    "string_lengths": "SELECT count(DISTINCT length(doc_id::VARCHAR)) AS n_lengths, min(length(doc_id::VARCHAR)) AS least, max(length(doc_id::VARCHAR)) AS most FROM documents",
    "bow_counts": f"""SELECT term, sum(n)::BIGINT AS count, count(*) AS n_docs FROM (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest({tokens(normal("text"))}) AS term FROM documents)
WHERE term NOT IN ('the', 'of', 'de', 'la', 'der') GROUP BY ALL) GROUP BY term""",
    "recent_turns": LAST_TURNS,
    "history_turns": """SELECT conv_id, turn, md5(text) AS user, md5(after) AS assistant FROM (
SELECT conv_id, turn, role, text, lead(role) OVER w AS next_role, lead(text) OVER w AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)) WHERE role = 'user' AND next_role = 'assistant'""",
    "newest_conversations": "SELECT conv_id, max(turn) AS last_turn, count(*) AS n_turns FROM conversations GROUP BY conv_id",
    "tfidf_top_terms": f"WITH {REPS} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 6) DESC, term) AS rank, term, round(weight, 6) AS weight FROM vec QUALIFY rank <= 3",
    "similar_pairs": f"WITH {PAIRS} SELECT a, b, cosine FROM pairs",
    "dup_components": f"{GROUPS} SELECT doc_id, component, representative FROM members",
    "dedup_keepers": f"{GROUPS} SELECT doc_id, component FROM members QUALIFY row_number() OVER (PARTITION BY component ORDER BY coalesce(n_chars, -1) DESC, doc_id) = 1",
    "dup_group_size": f"{GROUPS} SELECT doc_id, component, count(*) OVER (PARTITION BY component) AS group_size FROM members",
    "dup_group_id": f"{GROUPS} SELECT doc_id, dense_rank() OVER (ORDER BY component) - 1 AS group_id FROM members",
    "dedup_stats": f"{GROUPS} SELECT sum(n)::BIGINT AS before, count(*) AS after, count(*) FILTER (WHERE n > 1) AS groups, (sum(n) - count(*))::BIGINT AS dropped, (SELECT count(*) FROM pairs) AS pairs FROM (SELECT component, count(*) AS n FROM members GROUP BY component)",
    "bm25_terms": f"{WITH_CHUNKS},{TERMS} SELECT term, df, round(idf, 6) AS idf FROM terms",
    "bm25_top10": f"{WITH_LEXICAL} {SCORED.format('SELECT * FROM lexical WHERE rank <= 10')}",
    "dense_text_top10": f"WITH RECURSIVE {CHUNKS},{QUERIES},{DENSE} {SCORED.format('SELECT * FROM dense WHERE rank <= 10')}",
    "dense_top10": """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
d AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_dot_product(a.v, a.v) + list_dot_product(b.v, b.v) - 2 * list_dot_product(a.v, b.v), 8) AS d FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank, vec_id, round(d, 6) AS distance, round(1 / (1 + d), 6) AS similarity FROM d QUALIFY rank <= 10""",
    "rrf_k60": f"{WITH_LISTS} {SCORED.format(base('hyb_rrf_k60', 10))}",
    "rrf_k30": f"{WITH_LISTS} {SCORED.format(base('hyb_rrf_k30', 10))}",
    "rrf_fetch40": f"{WITH_LISTS} {SCORED.format(base('hyb_rrf_fetch40', 10))}",
    "weighted_norm": f"{WITH_LISTS} {SCORED.format(base('hyb_weighted_norm', 10))}",
    "weighted_dense_70": f"{WITH_LISTS} {SCORED.format(base('hyb_weighted_dense_70', 10))}",
    "minmax_norm": f"{WITH_LEXICAL} SELECT query_id, rank, round({scaled('score')}, 6) AS norm FROM lexical WHERE rank <= 20",
    "interleave": f"{WITH_LISTS} {RANKED.format(base('hyb_interleave', 10))}",
    "fill_dense_bm25": f"{WITH_LISTS} {RANKED.format(base('hyb_fill_dense_then_bm25', 10))}",
    "first_seen_dedupe": f"{WITH_LISTS} {RANKED.format(seen([part('lexical', 20, 'rank'), part('dense', 20, 'rank + 1000000')], 1000))}",
    "pad_to_k": f"{WITH_LISTS} {RANKED.format(padded('SELECT * FROM lexical WHERE rank <= 5', [('dense', 80), ('lexical', 80)], 20))}",
    "rerank_lexical": f"{WITH_LEXICAL} {SCORED.format(reranked('SELECT * FROM lexical WHERE rank <= 50', 10))}",
}

NEAR = """SELECT l.query_id, l.doc_id, l.pos + o.o AS pos, l.rank * 5 + o.s AS seen FROM {0} l CROSS JOIN (VALUES (0, 0), (1, -2), (2, -1), (3, 1), (4, 2)) o(s, o)
JOIN chunks c ON c.doc_id = l.doc_id AND c.pos = l.pos + o.o"""
_near5 = NEAR.format("(SELECT * FROM lexical WHERE rank <= 5)")
_near100 = seen([NEAR.format("lexical")], 1 << 30)
_chat = reranked("SELECT * FROM lexical WHERE rank <= 100", None)
_relevance = "round(CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END, 4)"
_context = "'Answer from the numbered sources alone and cite them as [n].' || chr(10) || chr(10)"

ORACLE_SQL |= {
    "neighbors_expand": f"{WITH_LEXICAL} {RANKED.format(seen([_near5], 1 << 30))}",
    "neighbors_rerank": f"{WITH_LISTS} {RANKED.format(padded(reranked(_near100, 20), [('dense', 80), ('lexical', 80)], 20))}",
    "chat_threshold": f"""{WITH_LEXICAL} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank, doc_id, pos, relevance
FROM (SELECT *, {_relevance} AS relevance FROM ({_chat}) WINDOW w AS (PARTITION BY query_id)) WHERE relevance >= 0.3 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 20""",
    "group_sources": f"""{WITH_LEXICAL} SELECT query_id, doc_id, string_agg(rank::VARCHAR, ',' ORDER BY rank) AS ranks, md5(arg_min({clip("text", 400)}, rank)) AS snippet
FROM (SELECT l.query_id, l.rank, l.doc_id, c.text FROM lexical l JOIN chunks c ON c.doc_id = l.doc_id AND c.pos = l.pos WHERE rank <= 20) GROUP BY query_id, doc_id""",
    "citations": f"""{WITH_LEXICAL}, marked AS (SELECT query_id, rank, doc_id, pos, query_id % 3 <> 0 AND (rank = 2 OR rank = query_id % 7) AS used FROM lexical WHERE rank <= 10)
SELECT query_id, rank, doc_id, pos FROM marked QUALIFY used OR NOT max(used) OVER (PARTITION BY query_id)""",
    "prompts": f"""{WITH_LEXICAL}, p AS (SELECT q.query_id, {_context} || coalesce(string_agg('[' || rank::VARCHAR || '] Document ' || l.doc_id::VARCHAR || chr(10) || CASE WHEN length(c.text) > 2000 THEN left(c.text, 2000) || chr(10) || '[truncated]' ELSE c.text END, chr(10) || chr(10) ORDER BY rank), '')
|| chr(10) || chr(10) || 'Question: ' || any_value(q.question) AS prompt FROM queries q LEFT JOIN lexical l ON l.query_id = q.query_id AND l.rank <= 3 LEFT JOIN chunks c ON c.doc_id = l.doc_id AND c.pos = l.pos GROUP BY q.query_id)
SELECT query_id, length(prompt) AS n, md5(prompt) AS digest FROM p""",
    "grid_rankings": f"{WITH_LISTS},{GRID} SELECT strategy, retriever, query_id, rank, doc_id, pos FROM grid",
    "first_hit": f"{WITH_HITS} SELECT strategy, retriever, query_id, first_hit FROM hits",
    "grid_summary": f"{WITH_HITS} {SUMMARY}",
    "rank_histogram": f"""{WITH_HITS}, names AS (SELECT x::VARCHAR AS rank_bucket FROM range(1, 11) r(x) UNION ALL SELECT 'miss'),
counts AS (SELECT strategy, retriever, CASE WHEN first_hit <= 10 THEN first_hit::VARCHAR ELSE 'miss' END AS rank_bucket, count(*) AS c FROM hits GROUP BY ALL)
SELECT cells.strategy, cells.retriever, names.rank_bucket, coalesce(c, 0) AS count FROM (SELECT DISTINCT strategy, retriever FROM hits) cells CROSS JOIN names LEFT JOIN counts USING (strategy, retriever, rank_bucket)""",
    "hit_rate_pivot": f"{WITH_HITS}, s AS ({SUMMARY}) SELECT strategy, " + ", ".join(f"max(CASE WHEN retriever = '{r}' THEN hit_rate END) AS {r}" for r in CHECKED) + " FROM s GROUP BY strategy",
    "merge_summaries": f"{WITH_HITS}, s AS ({SUMMARY}) SELECT CASE WHEN retriever LIKE '%{RERANKED}' THEN 'eval2' ELSE 'eval1' END AS eval_id, CASE WHEN retriever LIKE '%{RERANKED}' THEN 'reranked' ELSE 'plain' END AS eval_label, * FROM s",
    "snippet_middle_only": f"""WITH RECURSIVE {CHUNKS},{QUERIES},{REFERENCE}, picked AS (SELECT DISTINCT reference AS doc_id, gold_snippet FROM gold WHERE reference IS NOT NULL),
ends AS (SELECT doc_id, max(pos) AS last FROM chunks GROUP BY doc_id)
SELECT p.doc_id, md5(p.gold_snippet) AS digest, min(c.pos) AS pos FROM picked p JOIN chunks c USING (doc_id) JOIN ends USING (doc_id)
WHERE last >= 2 AND contains({normal("c.text")}, {normal("p.gold_snippet")}) GROUP BY p.doc_id, p.gold_snippet HAVING count(*) FILTER (WHERE c.pos = 0 OR c.pos = last) = 0""",
    "question_valid": f"WITH {QUERIES} SELECT query_id, {QUESTION} AS passes, FALSE AS passes_strict FROM queries",
    "answer_valid": f"""WITH {QUERIES} SELECT query_id, length(trim(question)) BETWEEN 10 AND 500 AND len(string_split(trim(question), ' ')) >= 3
AND len(list_intersect({tokens("question")}, {tokens("gold_snippet")})) > 0 AS passes FROM queries""",
    "skip_reason": """WITH r AS (SELECT doc_id, doc_id % 4 AS n, CASE WHEN doc_id % 3 <> 0 THEN lang END AS a, CASE WHEN doc_id % 5 <> 0 THEN source END AS f FROM documents)
SELECT doc_id, CASE WHEN n = 0 THEN 'no_contexts' WHEN coalesce(trim(a), '') = '' THEN 'no_answer' END AS minimal,
CASE WHEN n = 0 THEN 'no_contexts' WHEN coalesce(trim(a), '') = '' THEN 'no_answer' WHEN coalesce(trim(f), '') = '' THEN 'no_reference' END AS full FROM r""",
    "overall_mean": f"WITH {SCORES} SELECT vec_id, round((coalesce(m1, 0) + coalesce(m2, 0) + coalesce(m3, 0)) / nullif((m1 IS NOT NULL)::INT + (m2 IS NOT NULL)::INT + (m3 IS NOT NULL)::INT, 0), 6) AS overall_score FROM scores",
    "score_stats": f"WITH {SCORES} {statistic('m1')} UNION ALL {statistic('m2')} UNION ALL {statistic('m3')}",
    "edit_similarity_precision": f"""{WITH_LEXICAL},{SIMILARITY}, places AS (SELECT query_id, hit, hit * sum(hit) OVER (PARTITION BY query_id ORDER BY rank)::DOUBLE / row_number() OVER (PARTITION BY query_id ORDER BY rank) AS p FROM near)
SELECT query_id, round(sum(p) / (sum(hit) + 1e-10), 6) AS context_precision FROM places GROUP BY query_id""",
    "edit_similarity_recall": f"{WITH_LEXICAL},{SIMILARITY} SELECT query_id, round(max(hit)::DOUBLE, 6) AS context_recall FROM near GROUP BY query_id",
}

_present = "list_filter(list_transform({0}, lambda x: trim(x)), lambda x: x <> '')"
_answered = "rank = 2 OR rank = query_id % 7"

ORACLE_SQL |= {
    "last_row_wins": "SELECT conv_id, turn, role, md5(text) AS digest FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1",
    "unknown_ids": "SELECT vec_id * 3 AS doc_id FROM embeddings WHERE vec_id * 3 NOT IN (SELECT doc_id FROM documents)",
    "legal_subset": f"""WITH {LEGAL}, x AS (SELECT doc_id, regexp_extract(id, p, 2) AS year, regexp_extract(id, p, 3) AS type, regexp_extract(id, p, 4) AS code FROM parts)
SELECT doc_id, year::BIGINT AS year, code, row_number() OVER (ORDER BY year, doc_id) AS rank FROM x WHERE type = 'D' AND code LIKE '%5'""",
    "revision_counts": f"WITH {LEGAL} SELECT count(*) FILTER (WHERE regexp_extract(id, p, 5) <> '') AS revisions, count(*) FILTER (WHERE regexp_extract(id, p, 1) <> '') AS matched, count(*) AS n FROM parts",
    "group_size_null_keys": "SELECT CASE WHEN doc_id % 10 <> 0 THEN lang END AS lang, source, count(*) AS count FROM documents GROUP BY ALL ORDER BY count DESC, 1 NULLS FIRST, source NULLS FIRST LIMIT 40",
    "kept_chunks": f"{WITH_CHUNKS} SELECT doc_id, pos FROM chunks WHERE doc_id IN (SELECT doc_id FROM labels)",
    "unused_references": f"WITH {QUERIES},{REFERENCE} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT reference FROM gold WHERE reference IS NOT NULL)",
    "reference_fill": """SELECT d.doc_id AS id, coalesce(nullif(trim(CASE WHEN d.doc_id % 3 = 0 THEN ' ' WHEN d.doc_id % 3 = 1 THEN d.source END), ''), t.lang) AS reference
FROM documents d LEFT JOIN documents t ON t.doc_id = d.doc_id AND t.doc_id % 2 = 0""",
    "list_sets": f"""{WITH_LISTS}, a AS (SELECT query_id, doc_id, pos FROM dense WHERE rank <= 20), b AS (SELECT query_id, doc_id, pos FROM lexical WHERE rank <= 20)
SELECT query_id, 'both' AS part, count(*) AS n FROM (FROM a INTERSECT FROM b) GROUP BY query_id UNION ALL SELECT query_id, 'either', count(*) FROM (FROM a UNION FROM b) GROUP BY query_id
UNION ALL SELECT query_id, 'dense_only', count(*) FROM (FROM a EXCEPT FROM b) GROUP BY query_id""",
    "document_keys": f"""{WITH_CHUNKS} SELECT doc_id, pos, md5(CASE WHEN pos % 2 = 0 THEN left(sha256(doc_id::VARCHAR || '|line_n_merge|' || pos::VARCHAR), 32)
ELSE doc_id::VARCHAR || '|' || left({normal("text")}, 240) END) AS key FROM chunks""",
    "relative_times": """WITH t AS (SELECT event_id, ts, floor((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts)) / 60000000)::BIGINT AS m FROM events)
SELECT event_id, CASE WHEN m < 1 THEN 'Just now' WHEN m < 60 THEN m::VARCHAR || 'm ago' WHEN m < 1440 THEN (m // 60)::VARCHAR || 'h ago' WHEN m < 10080 THEN (m // 1440)::VARCHAR || 'd ago' ELSE strftime(ts, '%b %-d') END AS label FROM t""",
    "stream_tokens": "SELECT conv_id, turn, regexp_replace(text, '[^A-Za-z ]', '', 'g') || CASE WHEN turn % 3 = 0 THEN '!' ELSE '' END AS plain FROM conversations",
    "variant_pairs": f"""WITH {QUERIES}, v AS (SELECT query_id, trim(left(question, length(question) // 2)) AS a, trim(CASE WHEN query_id % 3 = 0 THEN upper(left(question, length(question) // 2)) WHEN query_id % 3 = 1 THEN substr(question, length(question) // 2 + 1) ELSE 'short' END) AS b FROM queries)
SELECT query_id, CASE WHEN length(a) >= 10 AND length(b) >= 10 AND lower(a) <> lower(b) THEN a || '|' || b END AS pair FROM v""",
    "context_texts": f"""WITH {QUERIES}, c AS (SELECT query_id, CASE WHEN query_id % 2 = 0 AND trim(question) <> '' THEN {_present.format("[question]")} ELSE {_present.format("[gold_snippet]")} END AS t FROM queries)
SELECT query_id, len(t) AS n, md5(array_to_string(list_transform(t, lambda x: CASE WHEN length(x) > 60 THEN left(x, 60) || chr(10) || '[truncated]' ELSE x END), '|')) AS digest FROM c""",
    "marked_citations": f"{WITH_LEXICAL} SELECT query_id, rank, doc_id, pos, {_answered} AS cited FROM lexical WHERE rank <= 10",
    "finalized_candidates": f"{WITH_LISTS}, pool AS ({base('hyb_interleave', 50).replace('AS seen,', 'AS seen, -min(seen) AS score,')}) {RANKED.format(padded(reranked('SELECT * FROM pool', 20), [('pool', 50)], 20))}",
    "rankings_k20": f"{WITH_LISTS} {RANKED.format(retriever('hyb_rrf_k60' + RERANKED, 20))}",
    "stored_or_live": f"{WITH_LISTS} SELECT query_id, rank, doc_id, pos FROM dense WHERE rank <= 10 AND query_id % 2 = 0 UNION ALL SELECT query_id, rank, doc_id, pos FROM lexical WHERE rank <= 10 AND query_id % 2 <> 0",
    "rewritten_questions": f"""WITH RECURSIVE {CHUNKS},{QUERIES.replace("queries AS", "asked_first AS")},
queries AS (SELECT query_id, regexp_replace(question, '^[^ ]+ ', '') AS question, gold_snippet FROM asked_first),{LEXICAL},{DENSE} {RANKED.format(retriever('bm25_k10'))}""",
    "finished_cells": f"{WITH_HITS} SELECT strategy || '::' || retriever AS cell, count(*) AS n, count(*) = (SELECT count(*) FROM queries) AS done FROM hits GROUP BY ALL",
}

SNIPPETS = r"""
drawn AS (
  SELECT doc_id, x, n, greatest(150, n // 6) AS first, least(n - 200, n * 5 // 6) - greatest(150, n // 6) AS room, ('0x' || left(md5('42|place|' || doc_id::VARCHAR), 8))::BIGINT AS a,
    120 + ('0x' || left(md5('42|size|' || doc_id::VARCHAR), 8))::BIGINT % 281 AS size
  FROM (SELECT doc_id, coalesce(text, '') AS x, length(coalesce(text, '')) AS n FROM documents)),
placed AS (SELECT doc_id, x, first + a % room AS place, size FROM drawn WHERE n >= 500 AND room > 0),
cut AS (SELECT doc_id, substr(x, place - 119, 120) AS before, substr(x, place + 1, size) AS body, substr(x, place + size + 1, 200) AS after FROM placed),
passages AS (
  SELECT doc_id, regexp_replace(regexp_extract(before, '(?s)^.*(?:\.[ \n]|\n\n)(.*)\z', 1) || body || left(after, coalesce(nullif(instr(after, '. '), 0), instr(after, '.' || chr(10)))),
    '^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+\z', '', 'g') AS p FROM cut),
ended AS (SELECT doc_id, p, regexp_extract(left(p, 400), '(?s)^(.*\.) ', 1) AS whole FROM passages),
snippets AS (
  SELECT doc_id, CASE WHEN length(p) <= 400 THEN p WHEN length(whole) >= 120 THEN whole ELSE regexp_replace(left(p, 400), '\s+\z', '') END AS gold_snippet FROM ended WHERE length(p) >= 120)"""


def filled(template: str, *values: str) -> str:
    """SQL for format_string with texts."""
    parts = [f"'{x}'".replace(chr(10), "' || chr(10) || '") for x in template.split("%s")]
    return " || ".join(x for pair in zip(parts, (*values, "''"), strict=True) for x in pair)


_made = r"'Which provision of the document sets out, among its other rules, the following: ' || array_to_string(string_split(trim(regexp_replace(gold_snippet, '\s+', ' ', 'g')), ' ')[1:8], ' ') || '?'"
_made_tokens = "list_distinct({0})".format(tokens(normal("replace(q, '?', '')")))
_first_sentence = r"coalesce(nullif(regexp_extract(text, '(?s)^(.*?[.!?])\s', 1), ''), text)"

ORACLE_SQL |= {
    "dense_k3": f"WITH RECURSIVE {CHUNKS},{QUERIES},{DENSE} {SCORED.format('SELECT * FROM dense WHERE rank <= 3')}",
    "snippet_pick": f"WITH {SNIPPETS} SELECT doc_id, length(gold_snippet) AS n, md5(gold_snippet) AS digest FROM snippets WHERE length(gold_snippet) >= 120",
    "accepted_snippets": f"""WITH {SNIPPETS}, made AS (SELECT doc_id, gold_snippet, {_made} AS q, left(gold_snippet, 400) AS a, row_number() OVER (ORDER BY md5('42|' || doc_id::VARCHAR), doc_id) AS turn FROM snippets WHERE length(gold_snippet) >= 120)
SELECT doc_id, turn, md5(q) AS question FROM made
WHERE length(q) - length(replace(q, '?', '')) = 1 AND len(regexp_split_to_array(trim(q), '\\s+')) >= 12 AND len({_made_tokens}) > 0
  AND len(list_intersect({_made_tokens}, list_distinct({tokens(normal("gold_snippet"))}))) <= 0.55 * len({_made_tokens})
  AND length(trim(a)) BETWEEN 10 AND 500 AND len(regexp_split_to_array(trim(a), '\\s+')) >= 3 AND len(list_intersect({tokens("a")}, {tokens("gold_snippet")})) > 0
ORDER BY turn LIMIT 50""",
    "strategies_first_seen": "SELECT row_number() OVER (ORDER BY min(i)) - 1 AS place, strategy FROM (VALUES " + ", ".join(f"({i}, '{s}')" for i, (s, _) in enumerate(CHOSEN)) + ") p(i, strategy) GROUP BY strategy",
    "pairs_fingerprint": "SELECT sha256('" + pairs_text(CHOSEN).replace("\n", "' || chr(10) || '") + "') AS fingerprint",
    "stored_questions": f"""WITH RECURSIVE {CHUNKS},{QUERIES}, t AS (SELECT floor(greatest(60, least(250, quantile_cont(length(text), 0.5) / 6)))::BIGINT AS target_words FROM chunks)
SELECT 'line_n_merge' AS strategy, query_id, 'According to the provisions that apply, ' || lower(left(question, 1)) || substr(question, 2) AS enhanced_question, target_words FROM queries, t""",
    "question_prompts": f"WITH {QUERIES} SELECT query_id, md5({filled(REWRITE, "'120'", 'question')}) AS rewrite, md5({filled(VARIANTS, "'120'", 'question')}) AS variants FROM queries",
    "responses": f"""{WITH_LEXICAL},{REFERENCE}, found AS (SELECT l.query_id, l.rank, l.doc_id, c.text FROM lexical l JOIN chunks c ON c.doc_id = l.doc_id AND c.pos = l.pos WHERE rank <= 5),
p AS (SELECT q.query_id, {_context} || string_agg('[' || rank::VARCHAR || '] Document ' || f.doc_id::VARCHAR || chr(10) || CASE WHEN length(text) > 2000 THEN left(text, 2000) || chr(10) || '[truncated]' ELSE text END, chr(10) || chr(10) ORDER BY rank)
  || chr(10) || chr(10) || 'Question: ' || any_value(q.question) AS prompt, count(*) AS n_documents FROM queries q JOIN found f USING (query_id) GROUP BY q.query_id)
SELECT p.query_id, g.reference, CASE WHEN trim(coalesce(g.gold_snippet, '')) <> '' THEN 1 ELSE 0 END AS n_reference, n_documents, md5(prompt) AS prompt, md5(trim({_first_sentence})) AS answer
FROM p JOIN found f ON f.query_id = p.query_id AND f.rank = 1 JOIN gold g ON g.query_id = p.query_id""",
    "seeded_order": "SELECT doc_id, row_number() OVER (ORDER BY md5('42|' || doc_id::VARCHAR), doc_id) AS turn FROM documents",
    "coerced_numbers": """WITH r AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang || 'x' ELSE n_chars::VARCHAR END AS raw FROM documents)
SELECT doc_id, try_cast(raw AS BIGINT) AS number, coalesce(try_cast(raw AS BIGINT), -1) AS filled FROM r""",
    "language_projection": "SELECT doc_id, length(text) AS n FROM documents WHERE lang = 'en'",
    "previews": f"{WITH_LEXICAL} SELECT l.query_id, l.rank, l.doc_id, md5({clip('d.text', 800)}) AS preview FROM lexical l JOIN documents d USING (doc_id) WHERE l.rank <= 3",
}
