"""DuckDB SQL of those queries that it can express."""

from __future__ import annotations

from .licenses import PHRASES, TEMPLATES, stride_of, words_of

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_REACH = """links AS (SELECT a AS x, b AS y FROM pairs UNION SELECT b, a FROM pairs),
reach(id, low) AS (SELECT id, id FROM ids UNION SELECT l.y, r.low FROM reach r JOIN links l ON l.x = r.id WHERE r.low < l.y),
comp AS (SELECT id, min(low) AS component_id FROM reach GROUP BY id)"""


def near_documents(percent: int = 85, k: int = 5) -> str:
    """Linked documents by counting the shingles that two of them share."""
    return f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce({_LOWER.format("text")}, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(s) AS s FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= {k} THEN list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(list_slice(w, i, i + {k - 1}), ' '))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a, b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM s p JOIN s q ON p.s = q.s AND p.doc_id < q.doc_id GROUP BY ALL) JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
ids AS (SELECT doc_id AS id FROM documents), {_REACH}
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, component_id = doc_id AS kept FROM documents JOIN comp ON id = doc_id LEFT JOIN n USING (doc_id)"""


_SOUND = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def top_k(k: int = 5, every: int = 50) -> str:
    """All inner products of the queries, ranked."""
    return f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE {_SOUND}),
s AS (SELECT q.vec_id AS query_id, r.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * r.v[i]))::BIGINT AS score FROM v q JOIN v r ON q.vec_id % {every} = 0 AND q.vec_id <> r.vec_id),
o AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT * FROM o WHERE rank <= {k}"""


def near_vectors(threshold: float = 0.95) -> str:
    """Linked vectors from all pairs' cosines."""
    return f"""WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE {_SOUND} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.vec_id < q.vec_id AND len(p.v) = len(q.v) WHERE list_cosine_similarity(p.v, q.v) >= {threshold}),
ids AS (SELECT vec_id AS id FROM embeddings), {_REACH}, n AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, component_id = vec_id AS kept FROM embeddings JOIN comp ON id = vec_id LEFT JOIN n ON x = vec_id"""


def licenses(threshold: float = 0.8) -> str:
    """Phrase places by position, and every block against every template."""
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    templates = ", ".join(f"('{label}', {quoted(sorted({w.decode() for w in words_of(t)}))})" for label, t in TEMPLATES)
    places = " UNION ALL ".join(f"SELECT doc_id, unnest(list_filter(range(0, len(w) - {len(p.split()) - 1}), lambda i: list_slice(w, i + 1, i + {len(p.split())}) = {quoted(p.split())})) AS i, '{label}' AS label FROM w" for p, label in PHRASES.items())
    word, stride = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", stride_of(TEMPLATES)
    return f"""WITH d AS (SELECT doc_id, coalesce({_LOWER.format("text")}, '') AS t FROM documents),
w AS (SELECT doc_id, regexp_extract_all(t, '{word}') AS w FROM d),
places AS ({places}),
base AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word FROM places GROUP BY doc_id),
blocks AS (SELECT doc_id, list_slice(w, a + 1, a + {2 * stride}) AS b FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w), 1), {stride})) AS a FROM w)),
templates(label, words) AS (VALUES {templates}),
found AS (SELECT doc_id, label, len(list_intersect(words, b))::DOUBLE / len(words) AS c FROM blocks, templates WHERE len(list_intersect(words, b)) >= {threshold} * len(words) - 1e-9),
best AS (SELECT doc_id, max(c) AS c FROM found GROUP BY doc_id),
named AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM places UNION SELECT doc_id, label FROM found) GROUP BY doc_id),
base_named AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS base_labels FROM (SELECT DISTINCT doc_id, label FROM places) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN base_labels IS NOT NULL THEN 1.0::DOUBLE ELSE coalesce(c, 0)::DOUBLE END AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN base_named USING (doc_id)"""
