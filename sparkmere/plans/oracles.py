"""DuckDB SQL for the registered queries."""

from __future__ import annotations

TOK = r"regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{N}}_]+')".format
NORM = r"lower(trim(regexp_replace(coalesce({}, ''), '\s+', ' ', 'g')))".format

CORPUS = r"corpus AS (SELECT source || '_' || doc_id AS doc_id, CASE WHEN doc_id % 5 = 0 THEN '' ELSE split_part(text, chr(10), 1) END AS title, text FROM documents)"
NUMBERED = r"numbered AS (SELECT doc_id AS pair_id, text AS positive, (doc_id % 100) || '_' || doc_id AS positive_id, split_part(text, chr(10), 1) AS positive_title FROM documents)"
BENCH = r"bench AS (SELECT 'wiki_' || b.item_id || '_0' AS doc_id, b.item_id, coalesce(split_part(d.text, chr(10), 1), '') AS title, b.text FROM benchmark b LEFT JOIN (SELECT * FROM documents WHERE doc_id % 10 = 0) d ON d.doc_id = b.item_id)"
QRELS = r"qrels AS (SELECT CAST(l.doc_id % 50 AS VARCHAR) AS qid, CASE WHEN l.doc_id % 7 = 3 THEN 'none_' || l.doc_id ELSE d.source || '_' || l.doc_id END AS doc_id, quality > 0 AS positive, l.doc_id AS ord FROM labels l JOIN documents d USING (doc_id))"
TOPICS = r"topics AS (SELECT CAST(item_id AS VARCHAR) AS qid, text AS query FROM benchmark)"
QUESTIONS = r"questions AS (SELECT CAST(b.item_id AS VARCHAR) AS pair_id, b.text AS query, d.source || '_' || d.doc_id AS positive_id, ['natural', 'vocab_gap', 'inflected'][b.item_id % 3 + 1] AS category FROM benchmark b JOIN documents d ON d.doc_id = b.item_id)"


def _shingles(name: str, source: str, key: str, text: str) -> str:
    return f"""{name}_t AS (SELECT {key} AS k, {TOK(text)} AS w FROM {source}),
{name} AS (SELECT DISTINCT k, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT k, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM {name}_t WHERE len(w) > 0))"""


JACCARD = f"""{NUMBERED}, {BENCH},
{_shingles('ps', 'numbered', 'pair_id', 'positive')},
{_shingles('bs', 'bench', 'doc_id', 'text')},
jac AS (SELECT p.k AS pair_id, b.k AS doc_id, count(*)::DOUBLE / (any_value(np.n) + any_value(nb.n) - count(*)) AS jaccard FROM ps p JOIN bs b USING (s)
  JOIN (SELECT k, count(*) AS n FROM ps GROUP BY k) np ON np.k = p.k JOIN (SELECT k, count(*) AS n FROM bs GROUP BY k) nb ON nb.k = b.k GROUP BY p.k, b.k),
near AS (SELECT * FROM jac WHERE jaccard >= 0.1)"""

JUDGED = f"""{JACCARD},
articles AS (SELECT DISTINCT regexp_extract(doc_id, 'wiki_(\\d+)_', 1) AS a FROM bench WHERE regexp_extract(doc_id, 'wiki_(\\d+)_', 1) <> ''),
titles AS (SELECT DISTINCT {NORM('title')} AS t FROM bench WHERE {NORM('title')} <> ''),
judged AS (SELECT pair_id, split_part(positive_id, '_', 1) IN (SELECT a FROM articles) AS article_hit,
  CASE WHEN {NORM('positive_title')} IN (SELECT t FROM titles) THEN 'title' WHEN pair_id IN (SELECT pair_id FROM near) THEN 'near_dup'
  WHEN split_part(positive_id, '_', 1) IN (SELECT a FROM articles) THEN 'article_id' END AS reason FROM numbered)"""

PAIRS = f"""{CORPUS}, {TOPICS}, {QRELS},
negs AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY ord, doc_id) AS rk FROM qrels WHERE NOT positive),
nl AS (SELECT qid, list(doc_id ORDER BY rk) AS negative_ids, list(text ORDER BY rk) AS negatives FROM negs JOIN corpus USING (doc_id) WHERE rk <= 8 AND text <> '' GROUP BY qid),
gold AS (SELECT q.qid AS query_id, q.doc_id AS positive_id, c.title AS positive_title, t.query, c.text AS positive, coalesce(nl.negative_ids, []) AS negative_ids, coalesce(nl.negatives, []) AS negatives
  FROM qrels q JOIN topics t USING (qid) JOIN corpus c ON c.doc_id = q.doc_id AND c.text <> '' LEFT JOIN nl ON nl.qid = q.qid WHERE q.positive AND t.query <> '')"""


def _bm25(queries: str, corpus: str, k: int, stem: bool = False, prefix: str = "") -> str:
    word = "CASE WHEN NOT (regexp_full_match(t, '\\p{Nd}+') OR length(t) <= 1) AND regexp_replace(t, '(tion|ing|er|en|es|ed)$', '') <> '' AND t IN (SELECT w FROM vocab) THEN regexp_replace(t, '(tion|ing|er|en|es|ed)$', '') ELSE t END" if stem else "t"
    vocab = f"vocab AS (SELECT DISTINCT unnest({TOK('text')}) AS w FROM documents),\n" if stem else ""
    return f"""{vocab}{prefix}dt AS (SELECT doc_id, len({TOK('text')}) AS dl, {TOK('text')} AS w FROM {corpus}),
{prefix}tf AS (SELECT doc_id, term, count(*)::DOUBLE AS tf FROM (SELECT doc_id, {word} AS term FROM (SELECT doc_id, unnest(w) AS t FROM {prefix}dt)) GROUP BY doc_id, term),
{prefix}df AS (SELECT term, count(*)::DOUBLE AS df FROM {prefix}tf GROUP BY term),
{prefix}st AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM {prefix}dt),
{prefix}qt AS (SELECT DISTINCT qid, {word} AS term FROM (SELECT qid, unnest({TOK('query')}) AS t FROM {queries})),
{prefix}sc AS (SELECT qid, doc_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 9) AS score
  FROM {prefix}qt JOIN {prefix}tf USING (term) JOIN {prefix}df USING (term) JOIN {prefix}dt USING (doc_id), {prefix}st GROUP BY qid, doc_id),
{prefix}ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM {prefix}sc) WHERE rank <= {k})"""


MINED = f"""{CORPUS}, {QUESTIONS},
pos AS (SELECT * FROM corpus WHERE doc_id IN (SELECT positive_id FROM questions)),
pool AS (SELECT * FROM pos UNION ALL SELECT * FROM (SELECT * FROM corpus WHERE split_part(doc_id, '_', 1) NOT IN ('src3', 'src4') AND doc_id NOT IN (SELECT doc_id FROM pos) ORDER BY md5('13:' || doc_id), doc_id LIMIT (SELECT greatest(0, POOL - count(*)) FROM pos)))"""
MINED_ALL = MINED.replace("POOL", "80000") + ",\nqq AS (SELECT pair_id AS qid, query FROM questions),\n" + _bm25("qq", "pool", 50) + """,
mined AS (SELECT pair_id, negative_id, rank, pos FROM (SELECT q.pair_id, r.doc_id AS negative_id, r.rank - 1 AS rank, row_number() OVER (PARTITION BY q.pair_id ORDER BY r.rank) AS pos
  FROM ranked r JOIN questions q ON q.pair_id = r.qid WHERE r.rank > 2 AND r.doc_id <> q.positive_id AND split_part(r.doc_id, '_', 1) <> split_part(q.positive_id, '_', 1)) WHERE pos <= 4)"""

TRAIN = f"""{MINED_ALL}, {TOPICS}, {QRELS},
{PAIRS.split(QRELS + ',', 1)[1].strip()},
made AS (SELECT q.pair_id, q.query, c.text AS positive, q.category, coalesce(n.negatives, []) AS negatives FROM questions q JOIN corpus c ON c.doc_id = q.positive_id AND c.text <> ''
  LEFT JOIN (SELECT m.pair_id, list(h.text ORDER BY m.pos) AS negatives FROM mined m JOIN corpus h ON h.doc_id = m.negative_id WHERE h.text <> '' GROUP BY m.pair_id) n ON n.pair_id = q.pair_id),
train AS (SELECT pair_id, query, positive, negatives, category FROM made UNION ALL SELECT 'g' || positive_id, query, positive, negatives, NULL FROM gold),
ex AS (SELECT *, list_filter(negatives, lambda x: x <> '') AS ok FROM train WHERE query <> '' AND positive <> '')"""


def _dense(name: str, dims: int) -> str:
    return f"""{name} AS (SELECT qid, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM
  (SELECT q.vec_id AS qid, p.vec_id AS doc_id, round(list_cosine_similarity(CAST(q.embedding[1:{dims}] AS DOUBLE[]), CAST(p.embedding[1:{dims}] AS DOUBLE[])), 9) AS score FROM embeddings q, embeddings p WHERE q.vec_id % 100 = 0)) WHERE rank <= 100)"""


RUNS = f"""{_dense('full_', 64)}, {_dense('short_', 16)}, {_dense('tiny_', 8)},
both_ AS (SELECT coalesce(a.qid, b.qid) AS qid, coalesce(a.doc_id, b.doc_id) AS doc_id, a.rank AS ra, b.rank AS rb, coalesce(1 / (60.0::DOUBLE + a.rank), 0) + coalesce(1 / (60.0::DOUBLE + b.rank), 0) AS score FROM full_ a FULL JOIN short_ b ON a.qid = b.qid AND a.doc_id = b.doc_id),
fused_ AS (SELECT qid, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, ra NULLS LAST, rb NULLS LAST, doc_id) AS rank FROM both_) WHERE rank <= 10),
rel AS (SELECT q.vec_id AS qid, p.vec_id AS doc_id FROM embeddings q JOIN embeddings p USING (label) WHERE q.vec_id % 100 = 0),
cats AS (SELECT vec_id AS qid, ['natural', 'inflected', 'vocab_gap'][vec_id % 3 + 1] AS category FROM embeddings WHERE vec_id % 100 = 0),
sizes AS (SELECT qid, count(*) AS n_rel FROM rel GROUP BY qid),
runs AS (SELECT 'full' AS system, qid, doc_id, rank FROM full_ UNION ALL SELECT 'short', qid, doc_id, rank FROM short_ UNION ALL SELECT 'tiny', qid, doc_id, rank FROM tiny_ UNION ALL SELECT 'fused', qid, doc_id, rank FROM fused_),
per AS (SELECT s.system, z.qid, coalesce(sum(1 / log2(r.rank + 1)) / (SELECT sum(1 / log2(i + 1)) FROM range(1, least(10, any_value(z.n_rel)) + 1) t(i)), 0) AS ndcg, coalesce(1.0::DOUBLE / min(r.rank), 0) AS rr, count(r.rank)::DOUBLE / any_value(z.n_rel) AS recall
  FROM (SELECT DISTINCT system FROM runs) s CROSS JOIN sizes z LEFT JOIN (SELECT runs.* FROM runs SEMI JOIN rel ON rel.qid = runs.qid AND rel.doc_id = runs.doc_id WHERE rank <= 10) r ON r.system = s.system AND r.qid = z.qid GROUP BY s.system, z.qid)"""

BOOT = f"""{RUNS},
d0 AS (SELECT a.qid, b.ndcg - a.ndcg AS d FROM per a JOIN per b USING (qid) WHERE a.system = 'short' AND b.system = 'full'),
d AS (SELECT scope, qid, d, row_number() OVER (PARTITION BY scope ORDER BY qid) - 1 AS i FROM (SELECT unnest(['ALL', category]) AS scope, qid, d FROM d0 JOIN cats USING (qid))),
sm AS (SELECT scope, count(*) AS n, avg(d) AS delta FROM d GROUP BY scope),
dr AS (SELECT scope, b, CAST('0x' || substr(md5(b || ':' || j), 1, 8) AS BIGINT) % n AS i FROM (SELECT scope, n, b, unnest(range(n)) AS j FROM (SELECT scope, n, unnest(range(10000)) AS b FROM sm))),
mn AS (SELECT scope, b, round(avg(d), 12) AS m FROM dr JOIN d USING (scope, i) GROUP BY scope, b),
tl AS (SELECT scope, avg((m <= 0)::INT) AS low, avg((m >= 0)::INT) AS high FROM mn GROUP BY scope)"""

SYNTH = f"""{CORPUS},
sp AS (SELECT doc_id, text, row_number() OVER (ORDER BY md5('13:' || doc_id), doc_id) - 1 AS rn FROM corpus WHERE length(text) >= 200 AND split_part(doc_id, '_', 1) NOT IN ('src3', 'src4')),
ba AS (SELECT rn // 5 AS batch_id, rn % 5 AS j, doc_id, text FROM sp WHERE rn < 14000)"""

ORACLE_SQL = {
    "tokenize_docs": f"SELECT doc_id, len({TOK('text')}) AS n_tokens, len(list_distinct({TOK('text')})) AS n_distinct FROM documents",
    "shingle_counts": f"WITH {_shingles('s', 'documents', 'doc_id', 'text')} SELECT d.doc_id, count(s.s) AS n_shingles FROM documents d LEFT JOIN s ON s.k = d.doc_id GROUP BY d.doc_id",
    "scalar_functions": rf"""WITH p AS (SELECT page_id, url, regexp_extract(html, '<title>(.*?)</title>', 1) AS title FROM pages)
SELECT page_id, right(regexp_replace(regexp_replace(url, '[^0-9A-Za-z]+', '_', 'g'), '^_+|_+$', '', 'g'), 60) AS cache_key, {NORM("'  ' || title || ' ' || chr(9) || ' '")} AS norm, length(regexp_replace(title, '^\s+|\s+$', '', 'g')) >= 5 AS is_question,
regexp_full_match(split_part(url, '/', 5), '\p{{Nd}}+') OR length(split_part(url, '/', 5)) <= 1 AS trivial, nullif(title, '') AS first FROM p""",
    "norm_titles_overlap": f"""WITH p AS (SELECT page_id, {NORM("regexp_extract(html, '<title>(.*?)</title>', 1)")} AS t FROM pages)
SELECT page_id FROM p WHERE page_id % 2 = 1 AND t <> '' AND t IN (SELECT t FROM p WHERE page_id % 2 = 0)""",
    "article_id_overlap": f"WITH {NUMBERED} SELECT pair_id AS doc_id FROM numbered WHERE split_part(positive_id, '_', 1) IN (SELECT CAST(item_id AS VARCHAR) FROM benchmark)",
    "near_dup_benchmark": f"WITH {JACCARD} SELECT pair_id, doc_id, round(jaccard, 6) AS jaccard FROM near",
    "near_dup_best": f"WITH {JACCARD} SELECT pair_id, round(max(jaccard), 6) AS jaccard FROM near GROUP BY pair_id",
    "overlap_cascade": f"WITH {JUDGED} SELECT pair_id, article_hit, reason FROM judged",
    "overlap_report": f"""WITH {JUDGED} SELECT count(*) AS pairs_in, count(*) FILTER (reason IS NULL) AS pairs_kept, count(reason) AS pairs_dropped, count(*) FILTER (reason = 'title') AS dropped_title,
count(*) FILTER (reason = 'near_dup') AS dropped_near_dup, count(*) FILTER (reason = 'article_id') AS dropped_article_id, count(*) FILTER (article_hit) AS article_id_overlap,
(SELECT count(*) FROM bench) AS benchmark_passages, (SELECT count(*) FROM articles) AS benchmark_articles FROM judged""",
    "clean_negatives": f"""WITH {JUDGED}, n AS (SELECT n.pair_id // 10 AS g, n.pair_id, n.positive_id, n.pair_id IN (SELECT pair_id FROM near) OR j.article_hit AS bad FROM numbered n JOIN judged j USING (pair_id))
SELECT g AS pair_id, coalesce(string_agg(positive_id, ',' ORDER BY pair_id) FILTER (NOT bad), '') AS negative_ids, count(*) FILTER (NOT bad) AS n_kept, count(*) FILTER (bad) AS n_stripped FROM n GROUP BY g""",
    "build_pairs": f"WITH {PAIRS} SELECT query_id, positive_id, positive_title, length(query) AS q_chars, length(positive) AS p_chars, array_to_string(negative_ids, ',') AS negative_ids, len(negatives) AS n_neg FROM gold",
    "pair_stats": f"""WITH {PAIRS}, per AS (SELECT q.qid, t.query IS NOT NULL AS asked FROM (SELECT DISTINCT qid FROM qrels) q LEFT JOIN topics t USING (qid)),
h AS (SELECT doc_id FROM corpus WHERE text <> '')
SELECT count(*) AS queries, count(*) FILTER (NOT asked) AS missing_query,
(SELECT count(*) FROM qrels JOIN per USING (qid) WHERE positive AND asked AND doc_id NOT IN (SELECT doc_id FROM h)) AS missing_pos_doc,
(SELECT count(*) FROM negs JOIN per USING (qid) WHERE rk <= 8 AND asked AND doc_id NOT IN (SELECT doc_id FROM h)) AS missing_neg_doc,
(SELECT count(*) FROM gold) AS pairs, (SELECT CAST(sum(len(negatives)) AS BIGINT) FROM gold) AS neg_total, (SELECT count(*) FROM gold WHERE len(negatives) > 0) AS with_negatives FROM per""",
    "corpus_last_wins": "SELECT conv_id AS doc_id, max_by(role, turn) AS role, max_by(text, turn) AS text FROM conversations GROUP BY conv_id",
    "qrels_split": """SELECT CAST(doc_id % 50 AS VARCHAR) AS qid, 'd' || doc_id AS doc_id, CASE doc_id % 6 WHEN 2 THEN 1.0 WHEN 4 THEN -1.5 ELSE quality END::DOUBLE AS rel,
CASE doc_id % 6 WHEN 2 THEN true WHEN 4 THEN false ELSE quality > 0 END AS positive FROM labels WHERE doc_id % 6 NOT IN (3, 5)""",
    "loader_lines": r"""WITH t AS (SELECT CAST(conv_id % 40 AS VARCHAR) AS doc_id, 'h' || turn AS title, regexp_replace(text, '[\t\n\"\\]', ' ', 'g') AS text, CASE WHEN conv_id % 2 = 0 THEN 0 ELSE 1 END AS f, conv_id * 100 + turn AS o FROM conversations WHERE conv_id % 5 <> 4)
SELECT doc_id, max_by(title, (f, o)) AS title, max_by(text, (f, o)) AS text FROM t GROUP BY doc_id""",
    "candidate_pool": f"WITH {MINED.replace('POOL', '80000')} SELECT doc_id FROM pool",
    "resume_filter": f"WITH {CORPUS} SELECT doc_id FROM corpus WHERE length(text) >= 200 AND split_part(doc_id, '_', 1) NOT IN ('src3', 'src4') AND length(text) % 2 = 1 ORDER BY md5('13:' || doc_id), doc_id LIMIT 14000",
    "prompt_batches": f"WITH {SYNTH} SELECT batch_id, count(*) AS n, md5(string_agg('[' || j || '] ' || text, chr(10) ORDER BY j)) AS prompt_md5 FROM ba GROUP BY batch_id",
    "synth_unpivot": f"""WITH {SYNTH}, k AS (SELECT doc_id, batch_id, batch_id || 'x' || j AS key FROM ba WHERE batch_id % 7 <> 6 AND j < 4),
q AS (SELECT doc_id, 'natural' AS category, 'What is ' || key || '?' AS query FROM k UNION ALL SELECT doc_id, 'vocab_gap', CASE WHEN batch_id % 3 = 0 THEN 'abc' ELSE 'Say of ' || key END FROM k UNION ALL SELECT doc_id, 'inflected', 'On ' || key || '?!' FROM k)
SELECT doc_id AS passage_id, category, query FROM q WHERE length(query) >= 5""",
    "term_df": f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest({TOK('text')}) AS term FROM documents) GROUP BY term",
    "doc_stats": f"SELECT count(*) AS n_docs, CAST(sum(len({TOK('text')})) AS BIGINT) AS n_tokens, round(avg(len({TOK('text')})), 6) AS avgdl FROM documents",
    "idf_table": f"SELECT term, df, round(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 6) AS idf FROM (SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({TOK('text')}) AS term FROM documents) GROUP BY term), (SELECT count(*) AS n FROM documents)",
    "bm25_topk": f"WITH {CORPUS}, {TOPICS}, {_bm25('topics', 'corpus', 10)} SELECT qid, rank, doc_id, round(score, 6) AS score FROM ranked",
    "bm25_stemmed_topk": f"WITH {CORPUS}, {TOPICS}, {_bm25('topics', 'corpus', 10, True)} SELECT qid, rank, doc_id, round(score, 6) AS score FROM ranked",
    "mine_negatives": f"WITH {MINED_ALL} SELECT pair_id, negative_id, rank, pos FROM mined",
    "mined_ids_artifact": f"""WITH {MINED_ALL} SELECT length(q.query) AS q_chars, q.positive_id, coalesce(string_agg(m.negative_id, ',' ORDER BY m.pos), '') AS negative_ids, q.category FROM questions q LEFT JOIN mined m USING (pair_id) GROUP BY q.pair_id, q.query, q.positive_id, q.category""",
    "assemble_train": f"WITH {TRAIN} SELECT pair_id, category, length(query) AS q_chars, length(positive) AS p_chars, len(negatives) AS n_neg, md5(array_to_string(negatives, '|')) AS neg_md5 FROM train",
    "triplets": f"WITH {TRAIN} SELECT pair_id, md5(positive) AS positive_md5, md5(n) AS negative_md5 FROM (SELECT pair_id, positive, unnest(ok[1:2]) AS n FROM ex)",
    "train_pairs": f"WITH {TRAIN} SELECT pair_id, length(query) AS a_chars, length(positive) AS p_chars FROM ex WHERE len(ok) = 0",
    "train_stats": f"""WITH {TRAIN}, c AS (SELECT CAST(sum(least(len(ok), 4)) AS BIGINT) AS n_triplets, count(*) FILTER (len(ok) = 0) AS n_pairs FROM ex),
p AS (SELECT *, greatest(1, CAST(ceil((n_triplets + n_pairs) / 128) AS BIGINT)) AS steps_per_epoch FROM c)
SELECT n_triplets, n_pairs, steps_per_epoch, steps_per_epoch * 2 AS total_steps, CAST(floor(steps_per_epoch * 2 * 0.1::DOUBLE) AS BIGINT) AS warmup_steps FROM p""",
    "dense_topk": f"WITH {_dense('r', 64)} SELECT qid, rank, doc_id, round(score, 6) AS score FROM r",
    "rrf_fusion": f"WITH {RUNS} SELECT qid, rank, doc_id, round(score, 6) AS score FROM fused_",
    "ndcg_mrr_recall_by_slice": f"""WITH {RUNS} SELECT CASE WHEN grouping(category) = 1 THEN 'ALL' ELSE category END AS scope, count(*) AS n, round(avg(ndcg), 6) AS ndcg, round(avg(rr), 6) AS rr, round(avg(recall), 6) AS recall
FROM per JOIN cats USING (qid) WHERE system = 'full' GROUP BY GROUPING SETS ((category), ())""",
    "paired_bootstrap": f"""WITH {BOOT} SELECT scope, n, round(delta, 6) AS delta, round(CASE WHEN delta >= 0 THEN low ELSE high END, 6) AS p_value, CASE WHEN delta >= 0 THEN low ELSE high END < 0.05 AS significant FROM sm JOIN tl USING (scope)""",
    "eval_table": f"""WITH {RUNS} SELECT CASE WHEN grouping(category) = 1 THEN 'ALL' ELSE category END AS scope, {', '.join(f"round(avg(ndcg) FILTER (system = '{x}'), 6) AS {x}" for x in ('full', 'short', 'tiny', 'fused'))}
FROM per JOIN cats USING (qid) GROUP BY GROUPING SETS ((category), ())""",
    "tier_counts": "SELECT ['natural', 'inflected', 'vocab_gap'][vec_id % 3 + 1] AS category, count(*) AS n FROM embeddings WHERE vec_id % 100 = 0 GROUP BY 1",
    "model_ranking": """WITH t AS (SELECT event_type AS model, CASE WHEN event_type <> 'click' THEN round(sum(value), 4) END AS value FROM events GROUP BY event_type)
SELECT model, value, row_number() OVER (ORDER BY value DESC NULLS LAST, model) AS place FROM t""",
}
