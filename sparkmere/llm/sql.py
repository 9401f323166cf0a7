"""DuckDB SQL for the operators' queries, written apart from the operators."""

from __future__ import annotations

import hashlib


def _owners(n_shards: int, size: int) -> list[int]:
    """The lookup table by a plain simulation: every shard's whole order of slots, then turns."""
    digest = lambda salt, k: int(hashlib.md5(f"{salt}:shard-{k:05d}".encode()).hexdigest()[:15], 16)

    def order(k: int):
        start, step = digest("offset", k), 1 + digest("skip", k) % (size - 1)
        return ((start + i * step) % size for i in range(size))

    orders = [order(k) for k in range(n_shards)]
    owner: dict[int, int] = {}
    turn = 0
    while len(owner) < size:
        owner[next(s for s in orders[turn % n_shards] if s not in owner)] = turn % n_shards
        turn += 1
    return [owner[s] for s in range(size)]


def shard_sql(n_shards: int = 64, size: int = 65_537) -> str:
    """The table itself is inlined: SQL has no short form for taking turns."""
    owners = ",".join(map(str, _owners(n_shards, size)))
    return f"""
WITH t AS (SELECT unnest(string_split('{owners}', ',')) AS shard, unnest(range({size})) AS slot),
d AS (SELECT doc_id, CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15)) AS BIGINT) % {size} AS shard_slot FROM documents)
SELECT d.doc_id, d.shard_slot, CAST(t.shard AS INTEGER) AS shard FROM d JOIN t ON t.slot = d.shard_slot
"""


_NORM = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"

DECONTAMINATE = rf"""
WITH d AS (SELECT doc_id, {_NORM} AS w FROM documents),
b AS (SELECT item_id, {_NORM} AS w FROM benchmark),
bw AS (SELECT item_id, w, least(len(w), 5) AS k FROM b WHERE len(w) > 0 AND item_id IS NOT NULL),
bs AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i+k-1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM bw)),
ks AS (SELECT DISTINCT k FROM bw),
ds AS (SELECT DISTINCT doc_id, k, array_to_string(w[i:i+k-1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id),
p AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN bs USING (k, s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment FROM p JOIN n USING (item_id) WHERE n_shared >= 0.8 * n_item
"""

MIX = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  CAST(('0x' || substr(md5('17:' || CAST(doc_id AS VARCHAR)), 1, 15)) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, 1.0::DOUBLE + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight, 3.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, cap / weight AS ratio, row_number() OVER o AS pos,
  (sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level_here
  FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)),
t AS (SELECT source, source_size, least(cap, weight * (SELECT min_by(level_here, pos) FROM l WHERE ratio >= level_here)) AS target FROM l),
n AS (SELECT source, source_size, target, CAST(coalesce(floor(target / nullif(source_size, 0)), 0) AS BIGINT) AS whole FROM t),
c AS (SELECT d.doc_id, d.size, d.h, n.*, CAST(round(n.target) AS BIGINT) - n.whole * n.source_size AS need,
  CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size) AS BIGINT) AS upto,
  count(*) OVER (PARTITION BY d.source, d.h, d.doc_id, d.size) AS ties FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source),
m AS (SELECT *, CASE WHEN upto <= need THEN size WHEN upto - size * ties < need THEN (need - (upto - size * ties)) // ties ELSE 0 END AS more FROM c)
SELECT doc_id, size, source_size, target, whole * size + more AS taken,
  whole + CASE WHEN more >= size AND size > 0 THEN 1 ELSE 0 END AS copies,
  CASE WHEN more >= size AND size > 0 THEN 0 ELSE more END AS part FROM m
"""

QUALITY = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3),
k AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i+1], w[i+2]) AS n FROM g),
p AS (SELECT DISTINCT r, unnest([i, i + 1, i + 2]) AS i FROM k WHERE n > 1),
rw AS (SELECT r, count(*) AS n_repeat_words FROM p GROUP BY r),
ln AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
dl AS (SELECT r, sum(n - 1) AS n_dup_lines FROM (SELECT r, line, count(*) AS n FROM ln WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r, line) GROUP BY r),
m AS (SELECT d.doc_id, d.source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words FROM d LEFT JOIN rw USING (r) LEFT JOIN dl USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n_docs, count(*) FILTER (base_failed) AS n_failed FROM f GROUP BY source),
a AS (SELECT avg(n_failed / n_docs) AS mu, coalesce(var_samp(n_failed / n_docs), 0) AS v FROM h),
b AS (SELECT mu, greatest(1.0, least(1000.0, CASE WHEN v > 0 AND mu * (1 - mu) > 0 THEN mu * (1 - mu) / v - 1 ELSE 1000.0 END)) AS wt FROM a),
s AS (SELECT source, (n_failed + mu * wt) / (n_docs + wt) AS rate, n_docs + wt + 1 AS size FROM h, b)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (rate - 2.0 * sqrt(rate * (1 - rate) / size) > 0.5) AS kept
FROM f JOIN s ON f.source IS NOT DISTINCT FROM s.source
"""

CHAT = r"""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e AS (SELECT *, CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss,
  length('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10)) + len(regexp_extract_all(text, '<\\*\|')) AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(sum(length(loss)) AS BIGINT) AS loss_chars, sha256(string_agg(loss, '' ORDER BY turn)) AS loss_sha256, CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

REPEATS = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL),
g AS (SELECT doc_id, i, md5(array_to_string(w[i + 1:i + 50], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS i FROM d WHERE len(w) >= 50)),
k AS (SELECT h FROM g GROUP BY h HAVING min(doc_id) < max(doc_id)),
p AS (SELECT DISTINCT doc_id, i FROM g JOIN k USING (h)),
f AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM p),
s AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM f)
SELECT doc_id, CAST(min(i) AS BIGINT) AS start, CAST(max(i) + 50 AS BIGINT) AS stop, CAST(max(i) + 50 - min(i) AS BIGINT) AS n_words FROM s GROUP BY doc_id, island
"""
