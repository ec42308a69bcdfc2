"""DuckDB SQL of the longer training-data queries, put together from the parameters of their operators."""

from __future__ import annotations

from tidemill.llm import secretscan, vectorcode


def _either_case(pattern: str) -> str:
    """The words of an assignment with both cases of each ASCII letter spelled out."""
    words, rest = pattern.split(")", 1)
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words) + ")" + rest


def _matches(kind: int, pattern: str, least: str) -> str:
    """Matches of a pattern with their places: what stands between the matches and the matches themselves add up to them."""
    return f"""
      SELECT doc_id, {kind} AS k, a, a + length(m) AS b, m FROM (
        SELECT doc_id, m, CAST(sum(length(gap)) OVER before + sum(length(m)) OVER before - length(m) AS BIGINT) AS a FROM (
          SELECT doc_id, unnest(regexp_split_to_array(t, '{pattern}')) AS gap, unnest(regexp_extract_all(t, '{pattern}')) AS m, generate_subscripts(regexp_split_to_array(t, '{pattern}'), 1) AS i
          FROM d WHERE regexp_matches(t, '{pattern}'))
        WHERE m IS NOT NULL WINDOW before AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING))
      WHERE {least}"""


def _entropy(kind: int, c: secretscan.CharClass) -> str:
    """Windows of one class with enough entropy, by the counts of their characters."""
    needs = " AND ".join(f"regexp_matches(w, '[{n}]')" for n in c.needs)
    return f"""
      SELECT doc_id, {kind} AS k, s AS a, s + {c.window} AS b FROM (
        SELECT doc_id, s, x, count(*) AS n FROM (
          SELECT doc_id, s, unnest(string_split(w, '')) AS x FROM (
            SELECT doc_id, a + o AS s, substring(m, CAST(o + 1 AS BIGINT), {c.window}) AS w FROM (SELECT *, unnest(range(length(m) - {c.window - 1})) AS o FROM cands WHERE length(m) >= {c.window}))
          WHERE regexp_full_match(w, '[{c.members}]+') AND {needs})
        GROUP BY doc_id, s, x)
      GROUP BY doc_id, s HAVING sum(CAST(round(n * log2(n) * {secretscan.UNIT}) AS BIGINT)) <= {c.limit}"""


_ASSIGN = _either_case(secretscan.ASSIGN).replace("'", "''")
_KINDS = [*secretscan.BASE_KINDS, *(c.kind for c in secretscan.CLASSES)]
_LISTED = "string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k)"

OP11_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
base AS ({_matches(0, _ASSIGN, f"length(regexp_extract(m, '{_ASSIGN}', 2)) >= {secretscan.LEAST_VALUE}")}
  UNION ALL {_matches(1, secretscan.ACCESS, f"length(m) >= {secretscan.LEAST_ACCESS}")}
  UNION ALL {_matches(2, secretscan.HEX, f"length(m) >= {secretscan.LEAST_HEX}")}),
cands AS ({_matches(0, secretscan.CANDIDATE, "true")}),
w AS ({" UNION ALL ".join(_entropy(k, c) for k, c in enumerate(secretscan.CLASSES, 3))}),
e AS (
  SELECT doc_id, k, min(a) AS a, max(b) AS b FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY doc_id, k ORDER BY a ROWS UNBOUNDED PRECEDING) AS island FROM (
      SELECT *, CASE WHEN a <= lag(b) OVER (PARTITION BY doc_id, k ORDER BY a) THEN 0 ELSE 1 END AS fresh FROM w))
  GROUP BY doc_id, k, island
),
more AS (
  SELECT e.* FROM e JOIN d USING (doc_id)
  WHERE NOT regexp_matches(substring(t, CAST(a + 1 AS BIGINT), CAST(b - a AS BIGINT)), '{"|".join(secretscan.ALLOWED)}')
    AND NOT EXISTS (SELECT 1 FROM base WHERE base.doc_id = e.doc_id AND base.a <= e.a AND base.b >= e.b)
),
spans AS (SELECT doc_id, k, a, b, [{", ".join(f"'{k}'" for k in _KINDS)}][k + 1] AS kind FROM (SELECT doc_id, k, a, b FROM base UNION ALL SELECT doc_id, k, a, b FROM more))
SELECT d.doc_id, {", ".join(f"count(*) FILTER (WHERE k = {k}) AS n_{name}" for k, name in enumerate(secretscan.BASE_KINDS))},
       sha256(coalesce({_LISTED} FILTER (WHERE k < 3), '')) AS base_sha256, coalesce({_LISTED}, '') AS spans
FROM d LEFT JOIN spans ON spans.doc_id = d.doc_id GROUP BY d.doc_id
"""


def _round(r: int) -> str:
    """One assignment of all parts, and the codebook that it makes."""
    return f"""
a{r} AS MATERIALIZED (
  SELECT vec_id, label, parts.p, any_value(x) AS x, min(struct_pack(d := list_dot_product(c, c) - 2 * list_dot_product(x, c) + list_dot_product(x, x), e := e)) AS best
  FROM parts JOIN b{r} ON parts.p = b{r}.p GROUP BY vec_id, label, parts.p
),
b{r + 1} AS MATERIALIZED (
  SELECT b{r}.p, b{r}.e, coalesce(m.c, b{r}.c) AS c FROM b{r} LEFT JOIN (
    SELECT p, e, list(v ORDER BY i) AS c FROM (
      SELECT p, e, i, floor(sum(v) / count(*)) AS v FROM (SELECT p, best.e AS e, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM a{r}) GROUP BY p, e, i)
    GROUP BY p, e) m ON m.p = b{r}.p AND m.e = b{r}.e
),"""


OP12_SQL = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * {vectorcode.SCALE})) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
parts AS MATERIALIZED (SELECT vec_id, label, p, v[p * len(v) // {vectorcode.PARTS} + 1 : (p + 1) * len(v) // {vectorcode.PARTS}] AS x FROM kept, (SELECT unnest(range({vectorcode.PARTS})) AS p)),
b0 AS MATERIALIZED (SELECT p, e, x AS c FROM (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM parts) WHERE e < {vectorcode.ENTRIES}),{"".join(_round(r) for r in range(vectorcode.ROUNDS + 1))}
books AS (SELECT sha256(string_agg(CAST(CAST(v AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM (SELECT p, e, unnest(c) AS v, generate_subscripts(c, 1) AS i FROM b{vectorcode.ROUNDS})),
found AS (SELECT vec_id, label, string_agg(format('{{:02x}}', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{vectorcode.ROUNDS} GROUP BY vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM found, books
"""
