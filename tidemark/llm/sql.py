"""SQL counterparts of the queries that SQL can express."""

from __future__ import annotations

# Remainders of CRC-32 for every byte, from its rule: eight steps per byte.
_STEPS = "SELECT i, i AS c FROM range(256) AS r(i)"
for _ in range(8):
    _STEPS = f"SELECT i, xor(c >> 1, (c & 1) * 3988292384) AS c FROM ({_STEPS})"

BYTE_SHARDS = f"""WITH remainders AS (SELECT list(c ORDER BY i) AS t FROM ({_STEPS})),
texts AS (SELECT doc_id, hex(encode(COALESCE(text, ''))) AS h, COALESCE(strlen(text), 0) + 1 AS size FROM documents),
sums AS (SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(h) // 2), lambda k: CAST('0x' || substr(h, 2 * k + 1, 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS crc FROM texts, remainders),
placed AS (SELECT *, SUM(size) OVER (ORDER BY doc_id) - size AS start, SUM(size) OVER () AS total FROM sums),
dealt AS (SELECT *, CAST(LEAST(7, ((2 * start + size) * 8) // (2 * total)) AS INT) AS shard FROM placed)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, CAST(NULL AS INT) AS grown_shard FROM dealt"""

SIMILAR = r"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, COUNT(*) AS n FROM shingles GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS c FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b, c = x.n AND c = y.n AS same FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 9 * c >= 4 * (x.n + y.n)),
reached AS (SELECT doc_id AS d, doc_id AS least FROM documents UNION SELECT b, least FROM reached JOIN links ON a = d)
SELECT doc_id, LEAST(doc_id, COALESCE((SELECT MIN(b) FROM links WHERE a = doc_id AND same), doc_id)) AS copy_id, (SELECT MIN(least) FROM reached WHERE d = doc_id) AS class_id,
    (SELECT COUNT(*) FROM links WHERE a = doc_id) AS n_links FROM documents"""

# DuckDB counts edits in bytes, so letters of two bytes stand as spare signs of one while edits are counted.
_LETTERS = "".join(chr(c) for c in range(0xC0, 0x100))
_SIGNS = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).islower() and chr(c) != "'")[: len(_LETTERS)]

VARIANTS = rf"""WITH RECURSIVE remainders AS (SELECT list(c ORDER BY i) AS t FROM ({_STEPS})),
runs AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, COUNT(*) AS times
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents) WHERE length(run) >= 7 GROUP BY ALL),
coded AS (SELECT *, hex(encode(concat(CAST(doc_id AS VARCHAR), ':', run))) AS x FROM runs),
sums AS (SELECT run, times, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(x) // 2), lambda k: CAST('0x' || substr(x, 2 * k + 1, 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM coded, remainders),
damaged AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times FROM sums),
words AS (SELECT word, translate(word, '{_LETTERS}', '{_SIGNS}') AS signs, CAST(SUM(times) AS BIGINT) AS n FROM damaged WHERE length(word) >= 7 GROUP BY 1 HAVING SUM(times) >= 2),
near AS (SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM words a JOIN words b
    ON abs(length(a.word) - length(b.word)) <= 1 AND a.word <> b.word AND levenshtein(a.signs, b.signs) = 1),
best AS (SELECT word, COUNT(*) AS n_near, MAX(near_n) AS most, arg_min(near, (-near_n, near)) AS form FROM near GROUP BY 1),
formed AS (SELECT w.word, w.n, COALESCE(n_near, 0) AS n_near, CASE WHEN most >= 10 * w.n THEN form END AS form, CASE WHEN most >= 10 * w.n THEN most END AS form_n FROM words w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root, 0 AS steps FROM formed UNION ALL SELECT c.word, f.form, steps + 1 FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT word, form, (SELECT arg_max(root, steps) FROM chain c WHERE c.word = f.word) AS root, n, n_near, form_n FROM formed f"""

SQL = {"op11_spelling_variants": VARIANTS, "op5_byte_shards": BYTE_SHARDS, "op8_bayes_jaccard": SIMILAR}
