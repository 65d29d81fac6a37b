"""The SQL that queries of this subpackage are compared with, for an engine that reads the same tables."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

TOP_K = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.e, v.e) AS BIGINT) AS score
    FROM v AS q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e)
    WHERE q.vec_id % 50 = 0
), ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

NEAR = f"""
WITH RECURSIVE split AS (
    SELECT doc_id, {WORDS.format(f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')")} AS w FROM documents
), shingle AS (
    SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM split WHERE len(w) > 0)
), sized AS (
    SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id
), link AS (
    SELECT a.doc_id AS x, b.doc_id AS y
    FROM shingle AS a JOIN shingle AS b ON a.s = b.s AND a.doc_id <> b.doc_id
    JOIN sized AS m ON m.doc_id = a.doc_id JOIN sized AS n ON n.doc_id = b.doc_id
    GROUP BY a.doc_id, b.doc_id, m.n, n.n
    HAVING 100 * count(*) >= 85 * (m.n + n.n - count(*))
), reach AS (
    SELECT doc_id AS x, doc_id AS y FROM documents
    UNION
    SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x
), least AS (
    SELECT x, min(y) AS c FROM reach GROUP BY x
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, c AS component_id, doc_id = c AS kept
FROM documents JOIN least ON x = doc_id LEFT JOIN sized USING (doc_id)
"""

REPEATS = f"""
WITH split AS (
    SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents
), starts AS (
    SELECT doc_id, i, array_to_string(w[i : i + 34], ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM split WHERE len(w) >= 35)
), again AS (
    SELECT s FROM starts GROUP BY s HAVING count(*) > 1
), gone AS (
    SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM starts JOIN again USING (s)
), kept AS (
    SELECT word.doc_id, word.p, word.t, gone.p IS NOT NULL AS out
    FROM (SELECT doc_id, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS p FROM split) AS word
    LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.p = word.p
), joined AS (
    SELECT doc_id, count(*) FILTER (out) AS n_removed, string_agg(t, ' ' ORDER BY p) FILTER (NOT out) AS rest FROM kept GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256
FROM split LEFT JOIN joined USING (doc_id)
"""

CHAT = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(regexp_replace(role, '[\\#<:]', 'xx', 'g')) + length(regexp_replace(text, '[\\#<]', 'xx', 'g')) + length('### : </turn>') + 1) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""

FINITE = "len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _round(n: int) -> str:
    """Assignments ``a<n>`` to the centroids ``c<n>``, and the centroids ``c<n + 1>`` that they give."""
    return f"""
a{n} AS (
    SELECT r, vec_id, any_value(v.q) AS q,
           min({{'d': list_sum(list_transform(list_zip(v.q, m.q), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 'c': m.c}}) AS best
    FROM kept AS v, c{n} AS m GROUP BY r, vec_id
), s{n} AS (
    SELECT c, p, sum(x) AS s, count(*) AS n
    FROM (SELECT best.c AS c, unnest(q) AS x, unnest(range(1, 65)) AS p FROM a{n}) GROUP BY c, p
), c{n + 1} AS (
    SELECT c{n}.c, coalesce(new.q, c{n}.q) AS q
    FROM c{n} LEFT JOIN (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY p) AS q FROM s{n} GROUP BY c) AS new USING (c)
)"""


CLUSTERS = f"""
WITH kept AS (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
    FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = 64 AND {FINITE}
), c0 AS (
    SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id), q) - 1 AS INTEGER) AS c, q
    FROM kept ORDER BY sha256('1:' || vec_id), q LIMIT 16
), {",".join(_round(n) for n in range(4))}
SELECT vec_id, best.c AS cluster, CAST(best.d AS BIGINT) AS distance,
       CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c3.q, ',')) AS centroid_sha256
FROM a3 JOIN c3 ON c3.c = best.c
"""

AUDIT = f"""
WITH RECURSIVE split AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, {WORDS.format("coalesce(text, '')")} AS w FROM documents
), fails AS (
    SELECT doc_id, part, [
        len(w) < 100,
        100 * len(list_distinct(w)) < 80 * len(w),
        100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t),
        regexp_matches(t, '[#$%&*|]'),
        coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)
    ] AS f
    FROM split
), marked AS (
    SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), doc AS (
    SELECT part, f, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n
    FROM fails LEFT JOIN marked USING (doc_id) GROUP BY ALL
), orders AS (
    SELECT '' AS o
    UNION ALL
    SELECT o || l FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l) WHERE NOT contains(o, l)
), steps AS (
    SELECT o, s, ord(o[s]) - 64 AS i, list_transform(range(1, s), lambda p: ord(o[p]) - 64) AS earlier
    FROM orders, (SELECT unnest(range(1, 6)) AS s) WHERE length(o) = 5
), seen AS (
    SELECT part, o, s, i, f, n, good, toxic, f[i] AS bad, len(list_filter(earlier, lambda e: f[e])) = 0 AS there FROM doc, steps
), told AS (
    SELECT part, o, s, i,
           coalesce(sum(n) FILTER (there AND NOT bad), 0) AS kept,
           coalesce(sum(n) FILTER (there AND bad), 0) AS removed,
           coalesce(sum(n) FILTER (NOT there AND bad), 0) AS redundant,
           coalesce(sum(n) FILTER (bad AND len(list_filter(f, lambda x: x)) = 1), 0) AS unique_fails,
           coalesce(sum(n) FILTER (there AND bad AND good), 0) AS good_lost,
           coalesce(sum(n) FILTER (there AND bad AND toxic), 0) AS toxic_lost
    FROM seen GROUP BY part, o, s, i
)
SELECT part, o AS filter_order, CAST(s AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, i) AS BIGINT) AS shapley
FROM told
"""
