"""DuckDB SQL for the queries that SQL can express over whole tables."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, d.vec_id AS vec_id, CAST(list_dot_product(q.v, d.v) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id % 100 = 0 AND q.vec_id <> d.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM scored
)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM ranked WHERE place <= 10
"""

SUBSTRING_DEDUP = f"""
WITH docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
windows AS (
  SELECT doc_id, s AS start, md5(array_to_string(list_slice(w, s, s + 19), ' ')) AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM docs)
), repeats AS (
  SELECT doc_id, start FROM (
    SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, start) AS place FROM windows
  ) WHERE place > 1
), gone AS (SELECT DISTINCT doc_id, unnest(range(start, start + 20)) AS pos FROM repeats),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM docs),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS text, count(*) AS n
  FROM words ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(text, '')) AS kept_sha256
FROM docs d LEFT JOIN kept USING (doc_id)
"""

MIXING = f"""
WITH docs AS (
  SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size,
         md5(concat('0:', coalesce(CAST(doc_id AS VARCHAR), ''))) AS k
  FROM documents
), named AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5, 2, 1][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3] AS weight
  FROM docs GROUP BY source
), shared AS (
  SELECT *, ((sum(source_size) OVER ()) * 150 / 100.0
             - coalesce(sum(2 * source_size) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS per_weight
  FROM named WINDOW r AS (ORDER BY 2 * source_size / weight, source ASC NULLS LAST)
), targets AS (
  SELECT source, source_size,
         least(CAST(2 * source_size AS DOUBLE), CAST(max(per_weight) OVER () AS DOUBLE) * weight) AS target
  FROM shared
), rows AS (
  SELECT d.*, source_size, target, CAST(floor(target) AS BIGINT) AS budget,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
           AS words_before
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
), cut AS (
  SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM rows
)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - words_before)) AS BIGINT) AS taken
FROM cut
"""

FILL_MIDDLE = """
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
         sha256(concat('1:', coalesce(CAST(doc_id AS VARCHAR), ''))) AS k
  FROM documents
), drawn AS (
  SELECT *, [CAST('0x' || substr(k, 8 * i + 1, 8) AS BIGINT) FOR i IN [0, 1, 2, 3]] AS h FROM docs
), cut AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90
              THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), parts AS (
  SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1, n - b) AS suffix FROM cut
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t
                        WHEN 'psm' THEN concat('<P>', prefix, '<S>', suffix, '<M>', middle)
                        ELSE concat('<S>', suffix, '<P>', prefix, '<M>', middle) END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""


def centroid_clustering(k: int = 8, rounds: int = 10) -> str:
    """Every round in full: all distances, floor of the mean, then the last assignment."""
    distance = "list_sum(list_transform(r.v, lambda x, i: (x - c.v[i]) * (x - c.v[i])))"
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""near{i} AS MATERIALIZED (
  SELECT r.vec_id, any_value(r.v) AS v, min([CAST({distance} AS BIGINT), c.number]) AS best
  FROM kept r CROSS JOIN centre{i} c GROUP BY r.vec_id
)""")
        if i < rounds:
            steps.append(f"""mean{i} AS (
  SELECT number, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY place) AS v
  FROM (
    SELECT best[2] AS number, place, sum(v[place]) AS s, count(*) AS n
    FROM near{i}, (SELECT unnest(range(1, 65)) AS place) GROUP BY 1, 2
  ) GROUP BY number
), centre{i + 1} AS MATERIALIZED (
  SELECT number, coalesce(m.v, c.v) AS v FROM centre{i} c LEFT JOIN mean{i} m USING (number)
)""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), centre0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS number, v
  FROM kept QUALIFY number < {k}
), {", ".join(steps)},
digests AS (
  SELECT number, sha256(array_to_string(v, ',')) AS centroid_sha256 FROM centre{rounds}
)
SELECT vec_id, CAST(best[2] AS INTEGER) AS cluster, best[1] AS distance,
       CAST(sum(best[1]) OVER (PARTITION BY best[2]) AS BIGINT) AS cluster_inertia,
       CAST(sum(best[1]) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM near{rounds} JOIN digests ON best[2] = number
"""
