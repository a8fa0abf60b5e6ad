"""SQL with the rows of the queries that SQL can express."""

from __future__ import annotations

SPACED = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
LETTERS = rf"list_filter(regexp_split_to_array({LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

JACCARD = f"""WITH RECURSIVE w AS (SELECT doc_id, {SPACED.replace("coalesce(text, '')", LOWER)} AS ws FROM documents),
 s AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + 4], ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
 n AS (SELECT doc_id, count(k) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY 1),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (k) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
 e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
 r AS (SELECT doc_id, doc_id AS v FROM n UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.v = e.a)
 SELECT n.doc_id, n.n AS n_shingles, (SELECT min(v) FROM r WHERE r.doc_id = n.doc_id) AS component_id FROM n"""

SUBSTRINGS = f"""WITH d AS (SELECT doc_id, {SPACED} AS ws FROM documents),
 s AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM d WHERE len(ws) >= 35)),
 r AS (SELECT doc_id, i FROM s QUALIFY count(*) OVER (PARTITION BY k) > 1),
 gone AS (SELECT DISTINCT doc_id, i + o AS p FROM r, range(35) t(o)),
 words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM d),
 kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY 1),
 n AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY 1)
 SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)"""

DECONTAMINATION = f"""WITH d AS (SELECT doc_id, {LETTERS} AS ws FROM documents),
 b AS (SELECT item_id, {LETTERS} AS ws FROM benchmark),
 item AS (SELECT DISTINCT item_id, least(len(ws), 10) AS size, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS k FROM (SELECT *, unnest(range(1, greatest(len(ws) - 8, 2))) AS i FROM b WHERE len(ws) > 0)),
 place AS (SELECT doc_id, size, i, array_to_string(ws[i:i + size - 1], ' ') AS k FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM item) WHERE len(ws) >= size)),
 hit AS (SELECT doc_id, size, i, item_id FROM place JOIN item USING (size, k)),
 n AS (SELECT doc_id, count(DISTINCT i + o) AS n_hit FROM hit, range(10) t(o) WHERE o < size GROUP BY 1),
 ids AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY 1)
 SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN n USING (doc_id) LEFT JOIN ids USING (doc_id)"""

LEXICAL = f"""WITH w AS (SELECT doc_id, {LETTERS} AS ws FROM documents),
 d AS (SELECT row_number() OVER () AS row, doc_id, ws, len(ws) AS n FROM w WHERE len(ws) > 0),
 size AS (SELECT count(*) AS N_, CAST(sum(n) AS BIGINT) AS L_ FROM d),
 item AS (SELECT DISTINCT item_id, unnest({LETTERS}) AS term FROM benchmark),
 tf AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(ws) AS term FROM d) SEMI JOIN item USING (term) GROUP BY 1, 2),
 weight AS (SELECT term, CAST(floor(1000 * ln((2 * N_ + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, size GROUP BY term, N_),
 hit AS (SELECT item_id, row, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * N_) // L_))) AS s FROM item JOIN tf USING (term) JOIN weight USING (term) JOIN d USING (row), size),
 scored AS (SELECT item_id, row, CAST(sum(s) AS BIGINT) AS score FROM hit GROUP BY 1, 2),
 ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score FROM scored JOIN d USING (row) WHERE score > 0)
 SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM ranked WHERE rank <= 10"""

ORACLES = {"op13_ranked_lexical_search": LEXICAL, "op1_ngram_jaccard_join": JACCARD, "op3_substring_dedup": SUBSTRINGS, "op9_benchmark_decontamination": DECONTAMINATION}
