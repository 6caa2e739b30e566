"""Pieces of DuckDB SQL that several checks share."""

from __future__ import annotations

from quillon.functions.text import ACCENTED, PLAIN
from quillon.operators import stemming as N

BLANK = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def tokens(x: str) -> str:
    return rf"regexp_extract_all(lower(coalesce({x}, '')), '[\p{{L}}\p{{N}}_]+')"


def stems(tokens: str) -> str:
    """A subquery ``token, stem`` with the French stems of the distinct words of ``tokens(token)``."""
    v, end = N.VOWELS, N.at_end
    some = lambda words: "(" + ", ".join(f"'{x}'" for x in words) + ")"
    piece = f"""CASE WHEN x = 'ë' THEN 'He' WHEN x = 'ï' THEN 'Hi' WHEN x = 'qu' THEN 'qU'
 WHEN regexp_matches(x, '^[{v}][ui][{v}]$') THEN x[1] || upper(x[2]) || x[3]
 WHEN regexp_matches(x, '^[{v}]y$') THEN x[1] || 'Y' WHEN regexp_matches(x, '^y[{v}]$') THEN 'Y' || x[2] ELSE x END"""
    upto = lambda pattern: f"coalesce(nullif(length(regexp_extract(w, '{pattern}')), 0), length(w))"
    # k letters are left before the suffix s, j before the suffix t of what is left
    ement = f"""CASE WHEN t = 'iv' AND j >= p2 AND right(c, 2) = 'at' AND j - 2 >= p2 THEN left(c, j - 2) WHEN t IN ('iv', 'eus', 'abl', 'iqU') AND j >= p2 THEN c
 WHEN t = 'eus' AND j >= p1 THEN c || 'eux' WHEN t IN ('ièr', 'Ièr') AND j >= pv THEN c || 'i' ELSE b END"""
    ite = "CASE WHEN t IN ('abil', 'ic', 'iv') AND j >= p2 THEN c WHEN t = 'abil' THEN c || 'abl' WHEN t = 'ic' THEN c || 'iqU' ELSE b END"
    ive = "CASE WHEN t <> 'at' OR j < p2 THEN b WHEN right(c, 2) <> 'ic' THEN c WHEN j - 2 >= p2 THEN left(c, j - 2) ELSE left(c, j - 2) || 'iqU' END"
    done = f"""CASE WHEN s IN {some(N.NOUNS)} AND k >= p2 THEN b WHEN s IN {some(N.ATIONS)} AND k >= p2 THEN CASE WHEN t = 'ic' THEN CASE WHEN j >= p2 THEN c ELSE c || 'iqU' END ELSE b END
 WHEN s IN {some(N.LOGIES)} AND k >= p2 THEN b || 'log' WHEN s IN {some(N.UTIONS)} AND k >= p2 THEN b || 'u' WHEN s IN {some(N.ENCES)} AND k >= p2 THEN b || 'ent'
 WHEN s IN {some(N.EMENTS)} AND k >= pv THEN {ement} WHEN s IN {some(N.ITES)} AND k >= p2 THEN {ite} WHEN s IN {some(N.IFS)} AND k >= p2 THEN {ive}
 WHEN s = 'eaux' THEN b || 'eau' WHEN s = 'aux' AND k >= p1 THEN b || 'al' WHEN s IN {some(N.EUSES)} AND k >= p2 THEN b WHEN s IN {some(N.EUSES)} AND k >= p1 THEN b || 'eux'
 WHEN s IN {some(N.ISSEMENTS)} AND k >= p1 AND regexp_matches(b, '[^{v}]$') THEN b END"""
    behind = f"CASE WHEN s = 'amment' AND k >= pv THEN b || 'ant' WHEN s = 'emment' AND k >= pv THEN b || 'ent' WHEN s IN {some(N.MENTS)} AND regexp_matches(b, '[{v}]$') AND k - 1 >= pv THEN b ELSE w END"
    verb = f"""CASE WHEN i <> '' AND length(r) > length(i) AND regexp_matches(r[length(r) - length(i)], '[^{v}H]') THEN left(w, length(w) - length(i))
 WHEN e = 'ions' THEN CASE WHEN length(w) - 4 >= p2 THEN left(w, length(w) - 4) END
 WHEN e IN {some(N.A_VERBS)} AND length(r) > length(e) AND r[length(r) - length(e)] = 'e' THEN left(w, length(w) - length(e) - 1)
 WHEN e <> '' THEN left(w, length(w) - length(e)) END"""
    left = f"""CASE WHEN s = 'ion' AND length(w) - 3 >= p2 AND regexp_matches(r, '[st]ion$') THEN left(w, length(w) - 3) WHEN s IN ('ier', 'ière', 'Ier', 'Ière') THEN left(w, length(w) - length(s)) || 'i'
 WHEN s = 'e' THEN left(w, length(w) - 1) ELSE w END"""
    q = f"SELECT token, array_to_string(list_transform(regexp_extract_all(token, '{N.PIECES}'), lambda x: {piece}), '') AS w FROM (SELECT DISTINCT token FROM {tokens})"
    q = f"SELECT *, CASE WHEN regexp_matches(w, '^(?:[{v}]{{2}}.|{'|'.join(N.SHORT)})') THEN 3 ELSE {upto(N.RV)} END AS pv, {upto(N.R1)} AS p1, {upto(N.R2)} AS p2, regexp_extract(w, '{end(N.STANDARD)}') AS s FROM ({q})"
    q = f"SELECT *, length(b) AS k, regexp_extract(b, '{end(N.INNER)}') AS t FROM (SELECT *, left(w, length(w) - length(s)) AS b FROM ({q}))"
    q = f"SELECT token, pv, p2, {done} AS done, {behind} AS behind FROM (SELECT *, k - length(t) AS j, left(b, k - length(t)) AS c FROM ({q}))"
    q = f"SELECT *, coalesce(done, behind) AS w, substr(coalesce(done, behind), pv + 1) AS r FROM ({q})"
    q = f"SELECT *, regexp_extract(r, '{end(N.I_VERBS)}') AS i, regexp_extract(r, '{end(('ions', *N.ER_VERBS, *N.A_VERBS))}') AS e FROM ({q})"
    q = f"SELECT token, pv, p2, w AS whole, coalesce(done, {verb}) AS found FROM ({q})"
    q = f"SELECT *, substr(w, pv + 1) AS r FROM (SELECT *, CASE WHEN regexp_matches(whole, '(?:Hi|[^{N.KEEP_S}])s$') THEN left(whole, length(whole) - 1) ELSE whole END AS w FROM ({q}))"
    q = f"SELECT token, coalesce(regexp_replace(regexp_replace(found, 'Y$', 'i'), 'ç$', 'c'), {left}) AS w FROM (SELECT *, regexp_extract(r, '{end(N.RESIDUAL)}') AS s FROM ({q}))"
    q = f"SELECT token, regexp_replace(CASE WHEN regexp_matches(w, '{end(N.DOUBLES)}') THEN left(w, length(w) - 1) ELSE w END, '[éè]([^{v}]+)$', 'e\\1') AS w FROM ({q})"
    return f"(SELECT token, replace(replace(replace(replace(replace(replace(w, 'He', 'ë'), 'Hi', 'ï'), 'H', ''), 'I', 'i'), 'U', 'u'), 'Y', 'y') AS stem FROM ({q}))"


def stem_lists() -> str:
    """CTEs to ``lists(doc_id, n, s)``: each document's number of words and its stems, joined by spaces."""
    words = "(SELECT doc_id, t[i] AS token, i FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM t))"
    return f"""t AS (SELECT doc_id, {tokens("text")} AS t FROM documents), w AS {words},
joined AS (SELECT doc_id, string_agg(stem, ' ' ORDER BY i) AS s FROM w JOIN {stems("w")} USING (token) GROUP BY doc_id),
lists AS (SELECT t.doc_id, CAST(len(t) AS BIGINT) AS n, coalesce(s, '') AS s FROM t LEFT JOIN joined USING (doc_id))"""


def clean(x: str) -> str:
    return f"trim(regexp_replace({x}, '{BLANK}', ' ', 'g'))"


def words(x: str) -> str:
    return f"CAST(len(list_filter(string_split_regex(coalesce({x}, ''), '{BLANK}'), lambda w: w <> '')) AS BIGINT)"


def plain(x: str) -> str:
    return f"translate({x}, '{ACCENTED}', '{PLAIN}')"


#: Chunks are documents; queries are benchmark items.
POSTINGS = f"""
tok AS (SELECT doc_id AS chunk_id, unnest({tokens("text")}) AS token FROM documents),
stems AS {stems("tok")},
tf AS (SELECT chunk_id, stem AS term, count(*) AS tf FROM tok JOIN stems USING (token) GROUP BY ALL),
size AS (SELECT chunk_id, sum(tf) AS size FROM tf GROUP BY chunk_id),
posts AS (SELECT tf.chunk_id, term, tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / (SELECT avg(size) FROM size))) AS weight FROM tf JOIN size USING (chunk_id)),
idf AS (SELECT term, count(*) AS df, ln(1 + ((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf GROUP BY term)
"""


def ranked(hits: str, limit: int | str, score: str = "score") -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round({score}, 9) DESC, chunk_id) AS rank FROM {hits}) WHERE rank <= {limit}"


def channels(queries: str, limit: int = 50) -> str:
    """CTEs from POSTINGS to the two channels for ``queries(query_id, text)``.

    The parts of a sparse score are whole units of 1e-12 before they are added: sums of doubles depend on their order, so that copies
    of a text would differ in the last digit, and in rank where nine decimals part them.
    """
    return f"""{POSTINGS},
qtok AS (SELECT query_id, unnest({tokens("text")}) AS token FROM {queries}),
qterms AS (SELECT DISTINCT query_id, stem AS term FROM qtok JOIN {stems("qtok")} USING (token)),
sscore AS (SELECT query_id, chunk_id, sum(CAST(floor(weight * idf * 1e12 + 0.5) AS BIGINT)) / 1e12 AS score FROM qterms JOIN posts USING (term) JOIN idf USING (term) GROUP BY ALL),
sparse AS ({ranked("sscore", limit)}),
hv AS (SELECT chunk_id, CAST(('0x' || substr(md5(token), 1, 8))::BIGINT % 64 AS INTEGER) AS dim, count(*) AS tf FROM tok GROUP BY ALL),
hvn AS (SELECT chunk_id, dim, tf / sqrt(CAST(sum(tf * tf) OVER (PARTITION BY chunk_id) AS DOUBLE)) AS v FROM hv),
qv AS (SELECT query_id, CAST(('0x' || substr(md5(token), 1, 8))::BIGINT % 64 AS INTEGER) AS dim, count(*) AS tf FROM (SELECT query_id, unnest({tokens("text")}) AS token FROM {queries}) GROUP BY ALL),
qvn AS (SELECT query_id, dim, tf / sqrt(CAST(sum(tf * tf) OVER (PARTITION BY query_id) AS DOUBLE)) AS q FROM qv),
dscore AS (SELECT query_id, chunk_id, sum(q * v) AS score FROM qvn JOIN hvn USING (dim) GROUP BY ALL),
dense AS ({ranked("dscore", limit)})"""


def fused(k: float | str = 1, prefetch: int = 50) -> str:
    return f"(SELECT query_id, chunk_id, sum(1.0 / ({k} + rank - 1)) AS score FROM (SELECT * FROM sparse UNION ALL SELECT * FROM dense) WHERE rank <= {prefetch} GROUP BY ALL)"


ITEMS = "(SELECT item_id AS query_id, text FROM benchmark)"

STYLED = f"""(SELECT item_id * 2 AS query_id, item_id, 'framed' AS style, text FROM benchmark
 UNION ALL SELECT item_id * 2 + 1, item_id, 'keyword', array_to_string(({tokens("text")})[1:3], ' ') FROM benchmark)"""

#: Rerank by covered idf: CTEs after ``pool(query_id, chunk_id, score)``.
RERANK = """
want AS (SELECT query_id, term, coalesce(idf, 0.0) AS idf FROM qterms LEFT JOIN idf USING (term)),
total AS (SELECT query_id, sum(idf) AS all_idf FROM want GROUP BY query_id),
part AS (SELECT p.query_id, p.chunk_id, sum(w.idf) AS part FROM pool p JOIN want w USING (query_id) JOIN tf ON tf.chunk_id = p.chunk_id AND tf.term = w.term GROUP BY ALL),
scored AS (SELECT pool.query_id, pool.chunk_id, score AS rrf_score, coalesce(part / CASE WHEN all_idf > 0 THEN all_idf END, 0.0) AS rerank_score
  FROM pool LEFT JOIN part USING (query_id, chunk_id) LEFT JOIN total USING (query_id))"""
