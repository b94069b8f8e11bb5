"""DuckDB SQL for the queries of this subpackage that SQL can express.

Written for fixtures of some thousand documents: pairs are joined outright.
"""

from __future__ import annotations

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"

OP1 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {_WORDS.format(f"translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}')")} AS w FROM documents
),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) >= 3 THEN array_to_string(w[i:i + 2], ' ') ELSE array_to_string(w, ' ') || chr(10) END AS x
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_n FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL
),
half AS (
  SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE 100 * both_n >= 85 * (na.n + nb.n - both_n)
),
link AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
reach(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
low AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c, d.doc_id) AS component_id, coalesce(c, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN low ON low.a = d.doc_id
"""

OP2 = f"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
win AS (
  SELECT doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50)
),
first AS (SELECT k, min(doc_id) AS least FROM win GROUP BY k),
hit AS (SELECT doc_id, i FROM win JOIN first USING (k) WHERE least < doc_id),
gone AS (SELECT DISTINCT doc_id, i + d AS i FROM hit, range(50) t(d)),
word AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w)
SELECT d.doc_id, count(word.i) AS n_words, count(gone.i) AS n_removed,
       sha256(coalesce(string_agg(CASE WHEN gone.i IS NULL THEN x END, ' ' ORDER BY word.i), '')) AS kept_sha256
FROM documents d LEFT JOIN word USING (doc_id) LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.i = word.i
GROUP BY d.doc_id
"""

_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {5 * i + 1}, 5))::INT >> {shift}) & 31) + 1, 1)"
    for i in range(8)
    for shift in (15, 10, 5, 0)
)

OP7 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (h)
"""


def _found(rule, order: int) -> str:
    """Rows (doc_id, a, ord, kind, z) of one rule: texts are cut at marks around
    matches, as DuckDB has no positions of matches either."""
    pattern = rule.pattern.replace("'", "''")
    group = f"length(regexp_extract(x, '{pattern}', {rule.group}))" if rule.group else "length(x)"
    return f"""
  SELECT doc_id, (upto - length(x))::INT AS a, {order} AS ord, '{rule.kind}' AS kind, upto::INT AS z FROM (
    SELECT doc_id, x, i, sum(length(x)) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM (
      SELECT doc_id, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM (
        SELECT doc_id, string_split(regexp_replace(t, '({pattern})', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS p FROM t))
  ) WHERE i % 2 = 0 AND {group} >= {rule.least}"""


def secret_sql(rules, n_base: int) -> str:
    joined = "string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, ord)"
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in rules[:n_base])
    return f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), chr(1), chr(2)) AS t FROM documents),
found AS ({" UNION ALL ".join(_found(r, i) for i, r in enumerate(rules))})
SELECT d.doc_id, {counts},
       sha256(coalesce({joined.replace(')', f') FILTER (WHERE ord < {n_base})')}, '')) AS base_sha256, coalesce({joined}, '') AS spans
FROM documents d LEFT JOIN found USING (doc_id) GROUP BY d.doc_id
"""


#: Sources by the share at which they are full; the first that is not full at
#: the share of itself and all after it ends the resharing.
MIX_TARGETS = f"""
WITH s AS (
  SELECT source, sum(len({_WORDS.format("coalesce(text, '')")}))::BIGINT AS source_size FROM documents GROUP BY source
),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM s),
o AS (SELECT *, 3.0::DOUBLE * source_size / w AS full_at, sum(source_size) OVER () AS total FROM w),
c AS (
  SELECT *, (total - 3.0::DOUBLE * (sum(source_size) OVER before - source_size)) / (sum(w) OVER () - (sum(w) OVER before - w)) AS share
  FROM o WINDOW before AS (ORDER BY full_at, encode(source) NULLS LAST ROWS UNBOUNDED PRECEDING)
),
f AS (SELECT max(share) FILTER (WHERE share <= full_at) AS share, max(full_at) AS top FROM c)
SELECT source, source_size, round(least(w * coalesce(f.share, f.top), 3.0::DOUBLE * source_size), 3) AS target FROM w, f
"""


def _pii(kind: str, order: int, pattern: str, fits: str) -> str:
    return f"""
  SELECT doc_id, '{kind}' AS kind, {order} AS ord, (upto - length(x))::INT AS a, upto::INT AS z FROM (
    SELECT doc_id, x, i, sum(length(x)) OVER (PARTITION BY doc_id ORDER BY i) AS upto, regexp_replace(x, '[^0-9]', '', 'g') AS d FROM (
      SELECT doc_id, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM (
        SELECT doc_id, string_split(regexp_replace(t, '({pattern})', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS p FROM t))
  ) WHERE i % 2 = 0 AND {fits}"""


_LUHN = (
    "list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN (length(d) - i) % 2 = 1 THEN d[i]::INT * 2 - "
    "CASE WHEN d[i]::INT > 4 THEN 9 ELSE 0 END ELSE d[i]::INT END)) % 10 = 0"
)
_PII = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "len(list_filter(string_split(x, '.'), lambda q: length(ltrim(q, '0')) > 3 OR try_cast(right(q, 4) AS INT) > 255)) = 0"),
    ("card", r"[0-9](?:[\x20-]?[0-9])+", f"length(d) BETWEEN 13 AND 19 AND {_LUHN}"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "length(d) BETWEEN 9 AND 15"),
)
_SPANS = "string_agg(kind || ':' || a || ':' || z, ',' ORDER BY ord, a)"

PII_BASE = f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), chr(1), chr(2)) AS t FROM documents),
found AS ({" UNION ALL ".join(_pii(k, i, p, f) for i, (k, p, f) in enumerate(_PII))})
SELECT d.doc_id, {", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k, *_ in _PII)},
       sha256(coalesce({_SPANS}, '')) AS base_sha256
FROM documents d LEFT JOIN found USING (doc_id) GROUP BY d.doc_id
"""
