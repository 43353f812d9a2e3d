"""DuckDB SQL with the same rows as the queries of the catalog."""

from __future__ import annotations

from kaivo.functions.text import CONJUNCTIONS, STOPWORDS

assert CONJUNCTIONS
_STOP = "(" + ", ".join(f"'{w}'" for w in STOPWORDS) + ")"
_WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"


def words(column: str) -> str:
    return _WORDS.format(column)


def kept(column: str) -> str:
    return f"list_filter({words(column)}, lambda w: w NOT IN {_STOP})"


STEM = "CASE WHEN length(regexp_replace(w, '(ing|tion|ment|ed|er|es|en|s)$', '')) >= 3 THEN regexp_replace(w, '(ing|tion|ment|ed|er|es|en|s)$', '') ELSE w END"
SPLIT = "CASE WHEN length(w) >= 10 THEN [w, left(w, (length(w) // 2)::INT), substr(w, (length(w) // 2 + 1)::INT)] ELSE [w] END"
PREFIX = f"CASE WHEN length(w) >= 6 THEN list_concat({SPLIT}, [left(w, 5)]) ELSE {SPLIT} END"


def lexemes(name: str, source: str, keys: str) -> str:
    """Rows (keys, w, [position]) of ``source`` to (keys, analyser, lexeme)."""
    return f"""{name} AS MATERIALIZED (
    SELECT {keys}, 'stem' AS analyser, {STEM} AS lexeme FROM {source}
    UNION ALL SELECT {keys}, 'base', w FROM {source}
    UNION ALL SELECT {keys}, 'split', unnest(list_distinct({SPLIT})) FROM {source}
    UNION ALL SELECT {keys}, 'prefix', unnest(list_distinct({PREFIX})) FROM {source})"""


INDEX = f"""
tok AS MATERIALIZED (SELECT doc_id, lang AS authority, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS position FROM (SELECT doc_id, lang, {kept("text")} AS ws FROM documents)),
{lexemes("occ", "tok", "doc_id, authority, position")},
len AS (SELECT analyser, doc_id, count(*) AS length FROM occ GROUP BY 1, 2)"""
QUERY = f"""
qtok AS (SELECT item_id, unnest({kept("text")}) AS w FROM benchmark),
{lexemes("qocc", "qtok", "item_id")},
qlex AS MATERIALIZED (SELECT DISTINCT item_id, analyser, lexeme FROM qocc),
qn AS (SELECT item_id, analyser, count(*) AS n FROM qlex GROUP BY 1, 2)"""
SCORES = f"""{INDEX},{QUERY},
post AS MATERIALIZED (SELECT o.analyser, authority, doc_id, lexeme, count(*) AS tf FROM occ o SEMI JOIN qlex q USING (analyser, lexeme) GROUP BY ALL),
score AS MATERIALIZED (
    SELECT item_id, analyser, authority, doc_id, 0.1 * w / 1.64493406685 / n AS score FROM (
        SELECT item_id, p.analyser, authority, doc_id, sum(list_sum(list_transform(range(1, least(tf, 255) + 1), lambda j: 1.0 / (j * j)))) AS w FROM post p JOIN qlex q USING (analyser, lexeme) GROUP BY ALL)
    JOIN qn USING (item_id, analyser))"""


def hits(k: int = 5, where: str = "TRUE", asked: str = "s.authority") -> str:
    return f"""{SCORES},
cells AS (SELECT item_id, {asked} AS asked_in, analyser, norm, doc_id, authority, round(score / CASE norm WHEN 1 THEN log2(length + 1) WHEN 2 THEN length ELSE 1 END, 9) AS rank
    FROM score s JOIN len USING (analyser, doc_id), (SELECT unnest([0, 1, 2])::INT AS norm) WHERE {where} AND (authority IS NOT NULL)),
hit AS MATERIALIZED (SELECT item_id, asked_in, analyser, norm, position, doc_id, authority, round(rank, 6) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY item_id, asked_in, analyser, norm ORDER BY rank DESC, doc_id)::INT AS position FROM cells) WHERE position <= {k})"""


NEED = """need AS MATERIALIZED (SELECT item_id, lang AS asked_in, doc_id FROM documents d JOIN benchmark b ON contains(lower(d.text), lower(b.text)) WHERE b.text <> '' AND lang IS NOT NULL)"""
SHARES = """shares AS MATERIALIZED (
    SELECT item_id, asked_in, analyser, doc_id, count(*) AS n_shared FROM (SELECT DISTINCT doc_id, analyser, lexeme FROM occ SEMI JOIN need USING (doc_id)) o JOIN need USING (doc_id) JOIN qlex USING (item_id, analyser, lexeme) GROUP BY ALL)"""
LEAKED = """leaked AS (SELECT item_id, asked_in, analyser, count(DISTINCT lexeme) AS n_leaked FROM (SELECT DISTINCT doc_id, analyser, lexeme FROM occ SEMI JOIN need USING (doc_id)) o JOIN need USING (doc_id) JOIN qlex USING (item_id, analyser, lexeme) GROUP BY ALL)"""


def outcomes(k: int = 5, where: str = "TRUE") -> str:
    return f"""{hits(k, where)},
{NEED},
{SHARES},
{LEAKED},
outcome AS MATERIALIZED (
    SELECT g.item_id, g.asked_in, g.analyser, g.norm, count(*) AS n_required, count(position) AS n_found, min(position) AS first_position,
        count(*) FILTER (position IS NULL AND n_shared IS NULL) AS n_unreachable, count(*) FILTER (position IS NULL AND n_shared IS NOT NULL) AS n_outranked,
        coalesce(any_value(qn.n), 0) AS n_query, coalesce(any_value(n_leaked), 0) AS n_leaked
    FROM (SELECT * FROM need, (SELECT DISTINCT analyser, norm FROM hit)) g
    LEFT JOIN hit USING (item_id, asked_in, analyser, norm, doc_id) LEFT JOIN shares USING (item_id, asked_in, analyser, doc_id)
    LEFT JOIN qn USING (item_id, analyser) LEFT JOIN leaked USING (item_id, asked_in, analyser) GROUP BY ALL)"""


METRICS = """count(*) AS questions, sum(n_required)::BIGINT AS required, round(avg((n_found = n_required)::INT), 6) AS complete_set_recall, round(sum(n_found) / sum(n_required), 6) AS passage_recall,
    round(avg(coalesce(1.0 / first_position, 0)), 6) AS mrr, sum(n_unreachable)::BIGINT AS unreachable, sum(n_outranked)::BIGINT AS outranked, round(coalesce(sum(n_leaked) / nullif(sum(n_query), 0), 0), 6) AS leakage"""
_CONTROL = "analyser = 'stem'"


def _wilson(s: str, n: str) -> tuple[str, str]:
    p, z = f"({s} / nullif({n}, 0)::DOUBLE)", "1.959963985::DOUBLE"
    centre = f"({p} + {z} * {z} / (2 * {n}))"
    spread = f"{z} * sqrt({p} * (1 - {p}) / {n} + {z} * {z} / (4.0 * {n} * {n}))"
    d = f"(1 + {z} * {z} / nullif({n}, 0))"
    return f"greatest(0.0, ({centre} - {spread}) / {d})", f"least(1.0, ({centre} + {spread}) / {d})"


_RATERS = r"""
x AS (SELECT l.doc_id, source, quality, toxic, text FROM labels l JOIN documents USING (doc_id)),
units AS (SELECT source AS qid, doc_id, 'quality' AS field, (quality = 1) = ((length(text) - length(translate(text, '#*$%&|!', ''))) * 20 < length(text)) AS same FROM x
    UNION ALL SELECT source, doc_id, 'toxic', (toxic = 1) = contains(lower(text), 'worthless') FROM x)"""
PHRASE = f"""
ptok AS MATERIALIZED (SELECT doc_id, lang, unnest(ws) AS w, unnest(range(len(ws))) AS place FROM (SELECT doc_id, lang, {kept("text")} AS ws FROM documents)),
pw AS MATERIALIZED (SELECT item_id AS phrase_id, unnest(ws) AS w, unnest(range(len(ws))) AS ord FROM (SELECT item_id, {kept("text")} AS ws FROM benchmark)),
phrase AS MATERIALIZED (SELECT DISTINCT phrase_id, doc_id, lang FROM (SELECT phrase_id, doc_id, lang, place - ord AS start, count(DISTINCT ord) AS n FROM ptok JOIN pw USING (w) GROUP BY ALL) JOIN (SELECT phrase_id, count(DISTINCT ord) AS n FROM pw GROUP BY 1) USING (phrase_id, n))"""
_KINDS = f"""{NEED},{PHRASE},
there AS MATERIALIZED (SELECT item_id, asked_in FROM need UNION SELECT phrase_id, lang FROM phrase WHERE lang IS NOT NULL),
kinds AS MATERIALIZED (SELECT item_id, asked_in, CASE WHEN (item_id, asked_in) IN (SELECT (item_id, asked_in) FROM there) THEN 'answerable' WHEN item_id IN (SELECT item_id FROM there) THEN 'out-of-jurisdiction' ELSE 'out-of-corpus' END AS kind
    FROM benchmark, (SELECT DISTINCT lang AS asked_in FROM documents WHERE lang IS NOT NULL))"""
_CITED = f"""{hits(5, f"{_CONTROL} AND norm = 0")},
h AS (SELECT item_id || '-' || asked_in AS qid, asked_in, position, authority || '@2024-03-01#' || (doc_id + 1) AS a, authority FROM hit),
cited AS (SELECT qid, asked_in, position * 10 + n AS pos, a, authority, n, CASE n WHEN 0 THEN a WHEN 1 THEN '  ' || upper(a) || ' ' WHEN 2 THEN 'xx' || substr(a, 3) WHEN 3 THEN replace(a, '-03-01', '-13-41') WHEN 4 THEN 'see above' ELSE a || '.sub' END AS raw
    FROM h, (SELECT unnest(range(6)) AS n)),
bucket AS (SELECT qid, pos::INT AS pos, raw, CASE WHEN n IN (3, 4) THEN NULL WHEN n = 1 THEN a ELSE raw END AS address, CASE WHEN n IN (3, 4) THEN 'unparseable' WHEN n IN (0, 1) THEN 'inside' WHEN n = 2 THEN 'foreign' ELSE 'outside' END AS bucket FROM cited)"""
_TURNS = """turns AS (SELECT conv_id, turn, q AS question, text AS answer FROM (SELECT *, lag(text) OVER w AS q, lag(role) OVER w AS before FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'assistant' AND before = 'user')"""
_SQUEEZE = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
_SLUG = "regexp_replace(regexp_replace(translate(lower({0}), 'äåöé', 'aaoe'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
_LOW, _HIGH = _wilson("good", "n")
_CLUSTER = """SELECT field, clusters, units, agreed, round(p, 6) AS rate, round(CASE WHEN v <= 1e-12 THEN wl ELSE greatest(0.0, p - 1.959963985::DOUBLE * sqrt(greatest(v, 0))) END, 6) AS low,
    round(CASE WHEN v <= 1e-12 THEN wh ELSE least(1.0, p + 1.959963985::DOUBLE * sqrt(greatest(v, 0))) END, 6) AS high, CASE WHEN v <= 1e-12 THEN 'wilson-over-clusters' ELSE 'cluster-robust' END AS kind"""

SQL = {
    "corpus_summary": "SELECT lang, count(*) AS documents, count(source) AS with_source, count(DISTINCT source) AS sources, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1",
    "postings_positions": f"WITH {INDEX} SELECT authority, doc_id, lexeme, count(*) AS tf, array_to_string(list_sort(list(position)), ',') AS positions FROM occ WHERE {_CONTROL} GROUP BY ALL",
    "lexeme_counts": f"WITH {INDEX}, p AS (SELECT analyser, doc_id, lexeme, count(*) AS tf FROM occ GROUP BY ALL), s AS (SELECT analyser, count(*) AS postings, sum(tf)::BIGINT AS positions FROM p GROUP BY 1) SELECT *, round(postings / (SELECT postings FROM s WHERE {_CONTROL}), 6) AS ratio FROM s",
    "document_lengths": f"WITH {INDEX} SELECT a AS analyser, d.doc_id, coalesce(length, 0)::BIGINT AS length FROM documents d CROSS JOIN (SELECT unnest(['stem', 'base', 'split', 'prefix']) AS a) LEFT JOIN len l ON l.doc_id = d.doc_id AND l.analyser = a",
    "empty_index": f"WITH {INDEX} SELECT a AS analyser, d.doc_id FROM documents d CROSS JOIN (SELECT unnest(['stem', 'base', 'split', 'prefix']) AS a) ANTI JOIN len l ON l.doc_id = d.doc_id AND l.analyser = a",
    "stopword_filter": f"SELECT lang, count(*) AS tokens, count(*) FILTER (w IN {_STOP}) AS stopped, count(DISTINCT w) AS forms, count(DISTINCT w) FILTER (w IN {_STOP}) AS stop_forms FROM (SELECT lang, unnest({words('text')}) AS w FROM documents) GROUP BY 1",
    "query_lexemes": f"WITH {QUERY} SELECT * FROM qlex",
    "index_fingerprint": f"""WITH ws AS (SELECT DISTINCT unnest({words("text")}) AS w FROM benchmark), {lexemes("o", "ws", "w")}, g AS (SELECT w, analyser, array_to_string(list_sort(list(lexeme)), chr(31)) AS l FROM o GROUP BY 1, 2)
        SELECT left(sha256(array_to_string(list_sort(list(w || chr(9) || analyser || chr(9) || l)), chr(30))), 16) AS fingerprint FROM g""",
    **{f"lexical_topk_norm{n}": f"WITH {hits(5, f'{_CONTROL} AND norm = {n}')} SELECT item_id, asked_in, position, doc_id, rank FROM hit" for n in (0, 1, 2)},
    "topk_grid": f"WITH {hits()} SELECT * FROM hit",
    "topk_without_jurisdiction": f"WITH {hits(5, f'{_CONTROL} AND norm = 0', 'NULL')} SELECT authority, count(*) AS hits FROM hit GROUP BY 1",
    "one_authority": "SELECT item_id, 0::BIGINT AS doc_id FROM benchmark WHERE FALSE",
    "best_cell": f"WITH {outcomes()}, m AS (SELECT analyser, norm, {METRICS} FROM outcome GROUP BY 1, 2) SELECT analyser, norm, complete_set_recall, 1::INT AS place FROM m ORDER BY complete_set_recall DESC, list_position(['stem', 'base', 'split', 'prefix'], analyser), norm LIMIT 1",
    "chunks_containing": "SELECT item_id, doc_id, lang AS authority FROM documents d JOIN benchmark b ON contains(lower(d.text), lower(b.text)) WHERE b.text <> ''",
    "resolve_labels": f"WITH {NEED} SELECT item_id FROM benchmark ANTI JOIN need USING (item_id)",
    "addresses_matching": f"WITH {INDEX}, {QUERY}, {NEED}, {SHARES} SELECT * FROM shares",
    "chunk_lexemes": f"WITH {INDEX}, {NEED} SELECT doc_id, count(DISTINCT lexeme) AS lexemes FROM occ SEMI JOIN need USING (doc_id) WHERE {_CONTROL} GROUP BY 1",
    "phrase_match": f"""WITH {PHRASE} SELECT phrase_id, doc_id FROM phrase""",
    "presence_two_sided": f"WITH {_KINDS} SELECT * FROM kinds",
    "refusal_kinds": f"WITH {_KINDS} SELECT kind, asked_in, count(*) AS questions FROM kinds GROUP BY ALL",
    "refusal_absence": f"""WITH {_KINDS}, e AS (SELECT k.*, EXISTS (SELECT 1 FROM there t WHERE t.item_id = k.item_id AND t.asked_in <> k.asked_in) AS other FROM kinds k)
        SELECT item_id, asked_in, CASE WHEN item_id % 2 = 0 THEN CASE WHEN kind = 'answerable' THEN 'stands in its own jurisdiction' WHEN other THEN 'stands in another jurisdiction' END
            ELSE CASE WHEN kind = 'answerable' THEN 'answerable where it was asked' WHEN NOT other THEN 'answerable nowhere' END END AS violation FROM e WHERE violation IS NOT NULL""",
    "power_matrix": f"""WITH {outcomes(1, _CONTROL)}, p AS (SELECT item_id, asked_in, norm, n_found = n_required AS passed FROM outcome)
        SELECT 'stem/' || a.norm AS cell, {', '.join(f"CASE WHEN a.norm <> {n} THEN count(*) FILTER (b.norm = {n} AND a.passed <> b.passed) END AS d{n}" for n in (0, 1, 2))} FROM p a JOIN p b USING (item_id, asked_in) GROUP BY a.norm""",
    "verdict_envelopes": f"""WITH {_TURNS}, t AS (SELECT (conv_id * 7 + turn) % 9 AS h FROM turns), e AS (SELECT h, CASE h WHEN 7 THEN 'empty' WHEN 8 THEN 'not an object' WHEN 5 THEN 'missing key' END AS problem FROM t),
        u AS (SELECT NULL AS unit, problem, NULL::BOOLEAN AS stated, NULL::BOOLEAN AS supported, NULL::BOOLEAN AS asserted, 0 AS incoherent FROM e WHERE problem IS NOT NULL
            UNION ALL SELECT 'branch', NULL, h % 2 = 0 AND h <> 6, h % 3 = 0 AND h % 2 = 0 AND h <> 6, NULL, (h % 3 = 0 AND h % 2 > 0)::INT + (h = 6 AND h % 2 = 0)::INT FROM e WHERE problem IS NULL
            UNION ALL SELECT 'forbidden', NULL, NULL, NULL, h = 4 AND h <> 6, (h = 6 AND h = 4)::INT FROM e WHERE problem IS NULL)
        SELECT unit, problem, count(*) AS units, count(*) FILTER (stated) AS stated, count(*) FILTER (supported) AS supported, count(*) FILTER (asserted) AS asserted, sum(incoherent)::BIGINT AS incoherent FROM u GROUP BY 1, 2""",
    "dehyphenate": """WITH m AS (SELECT doc_id, text, replace(text, 'th', '-' || chr(10) || 'ja th') AS t FROM documents)
        SELECT doc_id, length(t)::BIGINT AS chars, sha256(t) AS sha256, ((length(text) - length(replace(text, 'an', ''))) // 2)::BIGINT AS joins, ((length(text) - length(replace(text, 'th', ''))) // 2)::BIGINT AS guards FROM m""",
    "required_found_missed": f"WITH {outcomes(5, _CONTROL)} SELECT item_id, asked_in, norm, n_required, n_found, first_position, n_unreachable, n_outranked FROM outcome",
    "lexical_leakage": f"WITH {outcomes(5, _CONTROL)} SELECT item_id, asked_in, n_query, n_leaked, round(n_leaked / nullif(n_query, 0), 6) AS leakage FROM outcome WHERE norm = 0",
    "grid_metrics": f"WITH {outcomes()} SELECT analyser, norm, {METRICS} FROM outcome GROUP BY 1, 2",
    "metrics_by_authority": f"WITH {outcomes(5, _CONTROL)} SELECT analyser, norm, asked_in, {METRICS} FROM outcome GROUP BY GROUPING SETS ((analyser, norm), (analyser, norm, asked_in))",
    "pass_matrix": f"WITH {outcomes(1, _CONTROL)} SELECT item_id, asked_in, {', '.join(f'max(CASE WHEN norm = {n} THEN CASE WHEN n_found = n_required THEN chr(80) ELSE chr(46) END END) AS norm{n}' for n in (0, 1, 2))} FROM outcome GROUP BY 1, 2",
    "discordance_pairs": f"""WITH {outcomes(1)}, p AS (SELECT item_id, asked_in, analyser || '/' || norm AS cell, n_found = n_required AS passed FROM outcome),
        c AS (SELECT a.cell AS cell_a, b.cell AS cell_b, count(*) FILTER (a.passed AND NOT b.passed) AS a_only, count(*) FILTER (b.passed AND NOT a.passed) AS b_only FROM p a JOIN p b ON a.item_id = b.item_id AND a.asked_in = b.asked_in AND a.cell < b.cell GROUP BY 1, 2)
        SELECT *, round(CASE WHEN a_only + b_only = 0 THEN 1 ELSE least(1.0, 2 * list_sum(list_transform(range(least(a_only, b_only) + 1), lambda i: exp(lgamma(a_only + b_only + 1) - lgamma(i + 1) - lgamma(a_only + b_only - i + 1)))) * pow(0.5, a_only + b_only)) END, 6) AS p FROM c""",
    "baseline_compare": f"""WITH {hits(5, _CONTROL).replace("hit AS MATERIALIZED", "hit5 AS MATERIALIZED")}, hit1 AS (SELECT * FROM hit5 WHERE position <= 1), {NEED}, {SHARES}, {LEAKED},
        o AS (SELECT k, g.item_id, g.asked_in, g.norm, count(*) AS n_required, count(position) AS n_found, min(position) AS first_position FROM (SELECT * FROM need, (SELECT unnest([0, 1, 2]) AS norm), (SELECT unnest([1, 5]) AS k)) g
            LEFT JOIN (SELECT 5 AS k, * FROM hit5 UNION ALL SELECT 1, * FROM hit1) h USING (k, item_id, asked_in, norm, doc_id) GROUP BY ALL),
        m AS (SELECT k, norm, round(avg((n_found = n_required)::INT), 6) AS complete_set_recall, round(sum(n_found) / sum(n_required), 6) AS passage_recall, round(avg(coalesce(1.0 / first_position, 0)), 6) AS mrr FROM o GROUP BY 1, 2),
        u AS (UNPIVOT m ON complete_set_recall, passage_recall, mrr INTO NAME metric VALUE v)
        SELECT 'stem/' || norm AS cell, metric, max(v) FILTER (k = 5) AS was, max(v) FILTER (k = 1) AS now FROM u GROUP BY norm, metric HAVING now < was""",
    "run_drift": f"""WITH {hits(5, f"{_CONTROL} AND norm IN (0, 1)")}, c AS (SELECT norm, item_id, asked_in, list_sort(list(doc_id)) AS c FROM hit GROUP BY 1, 2, 3)
        SELECT CASE WHEN b.c IS NULL THEN 'missing' WHEN a.c IS NULL THEN 'extra' WHEN a.c <> b.c THEN 'drifted' ELSE 'same' END AS state, count(*) AS questions FROM (SELECT * FROM c WHERE norm = 0) a FULL JOIN (SELECT * FROM c WHERE norm = 1) b USING (item_id, asked_in) GROUP BY 1""",
    "mcnemar_exact": "SELECT a, b, round(CASE WHEN a + b = 0 THEN 1 ELSE least(1.0, 2 * list_sum(list_transform(range(least(a, b) + 1), lambda i: exp(lgamma(a + b + 1) - lgamma(i + 1) - lgamma(a + b - i + 1)))) * pow(0.5, a + b)) END, 6) AS p FROM range(20) x(a), range(20) y(b)",
    "wilson_intervals": f"SELECT source, good, n, round({_LOW}, 6) AS low, round({_HIGH}, 6) AS high FROM (SELECT source, sum(quality)::BIGINT AS good, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1)",
    "unit_agreement": f"WITH {_RATERS} SELECT field, count(*) AS units, count(*) FILTER (same) AS agreed, count(DISTINCT qid) AS clusters FROM units GROUP BY 1",
    "cluster_robust_interval": f"""WITH {_RATERS}, c AS (SELECT field, qid, count(*) AS n, count(*) FILTER (same) AS a FROM units GROUP BY 1, 2),
        t AS (SELECT field, count(*) AS clusters, sum(n)::BIGINT AS units, sum(a)::BIGINT AS agreed, count(*) FILTER (a = n) AS whole, sum(a) / sum(n) AS p FROM c GROUP BY 1),
        v AS (SELECT t.*, (SELECT sum((a - p * n) * (a - p * n)) FROM c WHERE c.field = t.field) * clusters / ((clusters - 1)::DOUBLE * units * units) AS v, {_wilson("whole", "clusters")[0]} AS wl, {_wilson("whole", "clusters")[1]} AS wh FROM t)
        {_CLUSTER} FROM v""",
    "pending_units": "SELECT lang, count(*) AS pending FROM documents ANTI JOIN labels USING (doc_id) GROUP BY 1",
    "citation_check": f"WITH {_CITED} SELECT * FROM bucket",
    "address_validity": f"""WITH {_CITED}, per AS (SELECT qid, count(*) AS cited, {", ".join(f"count(*) FILTER (bucket = '{b}') AS \"{b}\"" for b in ("inside", "outside", "foreign", "unparseable"))} FROM bucket GROUP BY 1)
        SELECT count(*) AS answers, {", ".join(f"sum(\"{b}\")::BIGINT AS \"{b}\"" for b in ("cited", "inside", "outside", "foreign", "unparseable"))}, round(sum(inside) / nullif(sum(cited), 0), 6) AS validity, round(avg((cited = inside)::INT), 6) AS clean_answers FROM per""",
    "first_citation": f"WITH {hits(5, f'{_CONTROL} AND norm = 0')} SELECT authority, item_id, doc_id FROM hit QUALIFY row_number() OVER (PARTITION BY authority ORDER BY item_id, position) = 1",
    "quote_words_present": f"""WITH {_TURNS}, w AS (SELECT conv_id, turn, contains({_SQUEEZE.format("answer")}, {_SQUEEZE.format("question")}) AS quote_found, {words("question")} AS q, {words("answer")} AS a FROM turns)
        SELECT conv_id, turn, quote_found, round(CASE WHEN len(q) = 0 THEN 1 ELSE list_sum(list_transform(list_distinct(q), lambda x: least(len(list_filter(q, lambda y: y = x)), len(list_filter(a, lambda y: y = x))))) / len(q) END, 6) AS share FROM w""",
    "refusal_metrics": f"""WITH {hits(1, f"{_CONTROL} AND norm = 0")}, {_KINDS},
        o AS (SELECT kind <> 'answerable' AS refusal, coalesce(rank, 0) < 0.05 AS refused, (k.item_id, k.asked_in) IN (SELECT (item_id, asked_in) FROM need JOIN hit USING (item_id, asked_in, doc_id)) AS complete FROM kinds k LEFT JOIN hit USING (item_id, asked_in)),
        s AS (SELECT count(*) FILTER (refusal) AS refusals, count(*) FILTER (refusal AND refused) AS correct, count(*) FILTER (refused) AS emitted, count(*) FILTER (NOT refusal AND refused AND NOT complete) AS excused FROM o)
        SELECT refusals, correct, emitted, excused, round(correct / nullif(refusals, 0), 6) AS recall, round({_wilson("correct", "refusals")[0]}, 6) AS recall_low, round({_wilson("correct", "refusals")[1]}, 6) AS recall_high,
            round(correct / nullif(emitted, 0), 6) AS precision, round(CASE WHEN emitted > 0 THEN {_wilson("correct", "emitted")[0]} ELSE 0 END, 6) AS precision_low, round(CASE WHEN emitted > 0 THEN {_wilson("correct", "emitted")[1]} ELSE 1 END, 6) AS precision_high,
            round(correct / nullif(emitted - excused, 0), 6) AS restricted_precision FROM s""",
    "slugify": rf"SELECT doc_id, {_SLUG.format('text')} AS slug, md5(lower(regexp_replace(text, '[\s\-\x{{2010}}-\x{{2015}}]+', '', 'g'))) AS title FROM documents",
    "address_parse": """WITH a AS (SELECT doc_id, lang, source, lang || '@2024-' || lpad((doc_id % 14)::VARCHAR, 2, '0') || '-15#' || (doc_id % 7) || CASE WHEN doc_id % 2 = 0 THEN '.' || source ELSE '' END AS address, doc_id % 14 BETWEEN 1 AND 12 AND doc_id % 7 > 0 AS ok FROM documents)
        SELECT doc_id, address, CASE WHEN ok THEN lang END AS authority, CASE WHEN ok THEN address[4:13] END AS day, CASE WHEN ok THEN doc_id % 7 END AS clause, CASE WHEN ok AND doc_id % 2 = 0 THEN source END AS sub FROM a""",
    "content_hash": "SELECT doc_id, sha256(text) AS sha256, source || ' (' || lang || ')' AS citation FROM documents",
    "shortest_unique_prefix": rf"""WITH u AS (SELECT doc_id, unnest(l) AS text, unnest(range(len(l))) AS unit FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents)),
        w AS (SELECT doc_id, unit, list_filter(string_split(regexp_replace(text, '[\s]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM u),
        t AS (SELECT doc_id, unit, n, {_SLUG.format("array_to_string(w[1:n], ' ')")} AS slug FROM (SELECT *, unnest(range(1, greatest(1, least(5, len(w))) + 1)) AS n FROM w)),
        s AS (SELECT *, count(*) OVER (PARTITION BY doc_id, n, slug) AS same FROM t)
        SELECT doc_id, unit, arg_min(slug, n) FILTER (same = 1 AND slug <> '') AS key FROM s GROUP BY 1, 2""",
    "section_split": "SELECT doc_id, 'front 1.2.2024' AS front, (length(string_split(text, chr(10))[1]) + 11 + 7 + 1 + length(string_split(text, chr(10))[-1]) + 8)::BIGINT AS toc_chars, sha256(text) AS body FROM documents",
    "front_matter_dates": "SELECT doc_id, CASE WHEN doc_id % 31 > 0 AND doc_id % 13 > 0 AND try_cast('2024-' || (doc_id % 13) || '-' || (doc_id % 31) AS DATE) IS NOT NULL THEN '2023-05-01,2024-' || lpad((doc_id % 13)::VARCHAR, 2, '0') || '-' || lpad((doc_id % 31)::VARCHAR, 2, '0') ELSE '2023-05-01' END AS dates FROM documents",
    "page_breaks": r"""WITH m AS (SELECT doc_id, replace(replace(text, '. ', '.' || chr(10) || chr(12) || ' '), ', ', ',' || chr(12) || ' ') || chr(10) || chr(12) || '  Next' || chr(12) AS t FROM documents)
        SELECT doc_id, md5(regexp_replace(regexp_replace(t, '(?m)^\f+([ \t]*[\p{Lu}•*])', chr(10) || '\1', 'g'), '(?m)^\f+', '', 'g')) AS text, len(regexp_extract_all(t, '(?m)^\f+[ \t]*[\p{Lu}•*]'))::BIGINT AS breaks, length(t)::BIGINT AS before FROM m""",
    "municipality_status": """WITH dim AS (SELECT lower(n_name) AS place, n_regionkey FROM nation), d2 AS (SELECT * FROM dim UNION ALL SELECT place, 2 FROM dim WHERE n_regionkey = 1 AND place LIKE 'a%'), known AS (SELECT place, count(*) AS n FROM d2 GROUP BY 1),
        asked AS (SELECT CASE WHEN c_custkey % 10 = 0 THEN ' ' WHEN c_custkey % 10 = 1 THEN 'Atlantis' ELSE array_to_string(list_transform(string_split(lower(n_name), ' '), lambda x: upper(x[1]) || x[2:]), ' ') END AS place FROM customer JOIN nation ON c_nationkey = n_nationkey)
        SELECT a.place, CASE WHEN trim(a.place) = '' THEN 'blank' WHEN n IS NULL THEN 'unknown' WHEN n > 1 THEN 'ambiguous' ELSE 'resolved' END AS status, count(*) AS asked FROM asked a LEFT JOIN known k ON lower(a.place) = k.place GROUP BY 1, 2""",
    "pair_check": "SELECT source, count(*) AS rows, count(DISTINCT text) AS texts, count(DISTINCT lang) AS authorities FROM documents GROUP BY 1",
    "ledger_daily": "SELECT ts::DATE::VARCHAR AS day, count(*) AS queries, round(sum(value), 4) AS cost FROM events WHERE ts IS NOT NULL GROUP BY 1",
    "ledger_monthly": "SELECT strftime(ts, '%Y-%m') AS month, count(*) AS queries, round(sum(value), 4) AS cost FROM events WHERE ts IS NOT NULL GROUP BY 1",
    "ledger_tokens": "SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS issued_at, strftime(min(ts) + INTERVAL 24 HOUR, '%Y-%m-%d %H:%M:%S') AS expires_at, least(count(*), 10)::BIGINT AS used, count(*) AS asked, round(sum(value), 4) AS cost FROM events GROUP BY 1",
    "budget_running": "WITH r AS (SELECT user_id, event_id, ts, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS total FROM events) SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id FROM r WHERE total > 500 GROUP BY 1",
    "cap_replay": "SELECT user_id, event_id, CASE WHEN ts >= min(ts) OVER (PARTITION BY user_id) + INTERVAL 24 HOUR THEN 'expired' WHEN row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) > 10 THEN 'over_cap' ELSE 'accepted' END AS decision FROM events",
    "event_properties": "SELECT event_type, count(*) AS events, count(props) AS with_props, count(DISTINCT user_id) AS users FROM events GROUP BY 1",
    "token_keys": "SELECT o_orderkey, CASE WHEN length(k) = 6 THEN 'AB' || left(k, 2) || '-' || k[3:6] ELSE NULL END AS token FROM (SELECT o_orderkey, left(lpad(o_orderkey::VARCHAR, 6, '0'), 6) AS k FROM orders)",
    "pricing_summary": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity)::DOUBLE, 2) AS qty, round(avg(l_extendedprice)::DOUBLE, 2) AS avg_price FROM lineitem GROUP BY 1, 2",
    "effective_date": """WITH m AS (SELECT doc_id % 97 AS g, CASE doc_id % 97 % 3 WHEN 1 THEN '2024-06-01' WHEN 2 THEN '2024-06-0' || (doc_id % 2 + 1) END AS day FROM documents)
        SELECT g AS "group", CASE WHEN min(day) = max(day) THEN min(day) END AS day, CASE WHEN min(day) IS NULL THEN 'no date' WHEN min(day) < max(day) THEN 'several dates' END AS problem FROM m GROUP BY 1""",
    "corpus_inventory": "SELECT lang AS authority, count(DISTINCT source) AS clauses, count(*) AS chunks, count(source) FILTER (doc_id % 3 = 0) AS definitions FROM documents GROUP BY 1",
    "inventory_problems": "SELECT lang AS authority, CASE WHEN lang = 'de' THEN 'undeclared' ELSE 'chunks ' || count(*) || ' for ' || (count(*) + 1) END AS problem FROM documents WHERE lang = 'de' OR lang LIKE 'e%' GROUP BY 1",
    "index_report": f"""WITH {INDEX}, t AS (SELECT unnest({words("text")}) AS w FROM documents), n AS (SELECT count(*) AS tokens, count(*) FILTER (w IN {_STOP}) AS stopped, count(DISTINCT w) AS forms FROM t)
        SELECT analyser, any_value(tokens) AS tokens, any_value(stopped) AS stopped, any_value(forms) AS forms, count(DISTINCT lexeme) AS lexemes, count(*) AS positions FROM occ, n GROUP BY 1""",
    "question_problems": """SELECT item_id AS qid, 'nothing required' AS problem FROM benchmark WHERE item_id % 5 = 0 UNION SELECT item_id, 'passage of another jurisdiction' FROM benchmark WHERE item_id % 5 = 1
        UNION SELECT item_id, 'passage required twice' FROM benchmark WHERE item_id % 5 = 2 UNION SELECT item_id, 'repeated id' FROM benchmark WHERE item_id % 11 = 0
        UNION SELECT -item_id - 1, 'refusal with passages' FROM benchmark WHERE item_id % 14 = 0 UNION SELECT -item_id - 1, 'text in both populations' FROM benchmark WHERE item_id % 7 = 0
        UNION SELECT item_id, 'text in both populations' FROM benchmark WHERE text IN (SELECT text FROM benchmark WHERE item_id % 7 = 0)""",
    "pair_problems": """WITH p AS (SELECT count(*) AS n, count(DISTINCT lang) AS langs FROM documents WHERE text IS NOT NULL GROUP BY text)
        SELECT CASE WHEN n <> 2 THEN 'not two rows' ELSE 'one jurisdiction' END AS problem, count(*) AS pairs FROM p WHERE n <> 2 OR langs <> 2 GROUP BY 1""",
    "control_floor": """SELECT shape, count(*) AS total, count(*) FILTER (caught) AS caught, bool_and(coalesce(caught, false)) AS passed FROM (SELECT concat_ws('-', quality, toxic) AS shape, toxic = 1 OR doc_id % 2 = 0 AS caught FROM labels) GROUP BY ROLLUP (shape)""",
    "publication_rule": f"WITH {_RATERS}, n AS (SELECT field, count(*) AS units, count(*) FILTER (same) AS agreed FROM units GROUP BY 1) SELECT *, round(agreed / units, 6) AS rate, agreed / units >= 0.85 AS published FROM n",
    "context_format": f"""WITH {hits(3, f"{_CONTROL} AND norm = 0")} SELECT item_id, asked_in, count(*) AS n, count(*) FILTER (text IS NULL) AS missing, sha256(string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY position)) AS context FROM hit LEFT JOIN documents USING (doc_id) GROUP BY 1, 2""",
    "clause_split": """WITH x AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[^a-zA-Z]+', ' ', 'g')) AS x, unnest([1, 2]) AS clause FROM documents)
        SELECT doc_id, CASE WHEN doc_id % 4 > 0 THEN clause END AS clause, CASE WHEN doc_id % 4 > 0 THEN CASE clause WHEN 1 THEN 'Alpha' ELSE 'Beta- rule' END END AS title, CASE WHEN doc_id % 4 > 0 THEN trim(chr(64 + clause) || ' ' || x) END AS text,
            CASE WHEN doc_id % 4 = 0 THEN '1 clauses of 2 found' END AS problem FROM x WHERE doc_id % 4 > 0 OR clause = 1""",
    "definition_units": """SELECT doc_id, unit, trim(chr((65 + unit)::INT) || ' ' || x) AS text FROM (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[^a-zA-Z]+', ' ', 'g')) AS x, unnest(range(3)) AS unit FROM documents)""",
}
