"""DuckDB SQL of those queries of the training-data operators that SQL can express at the size of the correctness tables."""

from __future__ import annotations

OP1 = """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a, ok b WHERE a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
low AS (SELECT a, min(b) AS component_id FROM reach GROUP BY 1),
n AS (SELECT a, count(*) AS n FROM links GROUP BY 1)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, low.component_id, v.vec_id = low.component_id AS kept FROM v JOIN low ON low.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id"""

OP4 = r"""WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 34, 0) + 1)) AS i FROM d)),
twice AS (SELECT h FROM s GROUP BY 1 HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM s WHERE h IN (SELECT h FROM twice)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, count(*) AS n, array_to_string(list(word ORDER BY p), ' ') AS line FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, (len(d.w) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.line, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""


def _spans(kind: str, rank: int, pattern: str, keep: str = "true") -> str:
    """Matches of a pattern with their places: the gaps between matches and the matches alternate."""
    return f"""SELECT doc_id, '{kind}' AS kind, {rank} AS rank, list_sum(g[1:k]) + coalesce(list_sum(n[1:k - 1]), 0) AS start, list_sum(g[1:k]) + list_sum(n[1:k]) AS stop FROM
 (SELECT doc_id, m, g, list_transform(m, lambda x: length(x)) AS n, unnest(range(1, len(m) + 1)) AS k FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS m, list_transform(string_split_regex(text, '{pattern}'), lambda x: length(x)) AS g FROM t)) WHERE {keep}"""


_VALUE = r"(?i:password|passwd|secret|token|api_?key)[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
_LETTERS = "[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]"  # (?i) also folds letters beyond ASCII here
_VALUE = _VALUE.replace("?i:password|passwd|secret|token|api_?key", f"?:{_LETTERS}")
_RUN = "[A-Za-z0-9+/=_-]+"
_SECRET = "^[A-Za-z0-9+/]{32,}={0,2}"
_ENDPOINT = r"(?:https?|s3|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[A-Za-z0-9._~:/?#@!$&*+,;=%-]+"

OP6 = f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
base AS ({_spans("assign", 0, _VALUE, f"length(regexp_extract(m[k], '{_VALUE}', 1)) >= 12")} UNION ALL {_spans("access", 1, "AKIA[A-Z0-9]+", "n[k] >= 18")} UNION ALL {_spans("hex", 2, "[0-9a-f]+", "n[k] >= 16")}),
runs AS (SELECT doc_id, start, r FROM (SELECT doc_id, list_sum(g[1:k]) + coalesce(list_sum(n[1:k - 1]), 0) AS start, m[k] AS r FROM (SELECT doc_id, m, g, list_transform(m, lambda x: length(x)) AS n, unnest(range(1, len(m) + 1)) AS k FROM
 (SELECT doc_id, regexp_extract_all(text, '{_RUN}') AS m, list_transform(string_split_regex(text, '{_RUN}'), lambda x: length(x)) AS g FROM t WHERE regexp_matches(text, 'AKIA[A-Z0-9]{{14,}}'))) WHERE length(m[k]) >= 32)),
weak AS (SELECT doc_id, 'secret' AS kind, 3 AS rank, start, start + length(regexp_extract(r, '{_SECRET}')) AS stop FROM runs WHERE regexp_matches(r, '{_SECRET}') AND regexp_matches(regexp_extract(r, '^[A-Za-z0-9+/]+'), '[0-9]') AND regexp_matches(regexp_extract(r, '^[A-Za-z0-9+/]+'), '[a-z]') AND regexp_matches(regexp_extract(r, '^[A-Za-z0-9+/]+'), '[A-Z]')
 UNION ALL SELECT * FROM ({_spans("endpoint", 4, _ENDPOINT)})),
near AS (SELECT DISTINCT w.* FROM weak w JOIN base b ON b.doc_id = w.doc_id AND b.kind = 'access' AND ((b.start <= w.start AND w.start - b.stop <= 400) OR (b.start >= w.start AND b.start - w.stop <= 400))),
strong AS (SELECT * FROM base WHERE kind = 'assign' UNION ALL SELECT * FROM near WHERE kind = 'secret'),
linked AS (SELECT * FROM near WHERE kind = 'secret' UNION ALL SELECT DISTINCT w.* FROM near w JOIN strong s ON s.doc_id = w.doc_id AND w.kind = 'endpoint' AND ((s.start <= w.start AND w.start - s.stop <= 400) OR (s.start >= w.start AND s.start - w.stop <= 400))),
b AS (SELECT doc_id, count_if(rank = 0) AS n_assign, count_if(rank = 1) AS n_access, count_if(rank = 2) AS n_hex, string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, rank, stop) AS line FROM base GROUP BY 1),
a AS (SELECT doc_id, string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, rank, stop) AS line FROM (SELECT * FROM base UNION ALL SELECT * FROM linked) GROUP BY 1)
SELECT t.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(b.line, '')) AS base_sha256, coalesce(a.line, '') AS spans FROM t LEFT JOIN b USING (doc_id) LEFT JOIN a USING (doc_id)"""
