"""DuckDB SQL for the queries of the corpus operators that SQL can state; it shares nothing with the operators but the contract."""

from __future__ import annotations

import re

from .license_scan import BASE_STRENGTH, PHRASES
from .license_texts import TEMPLATES

OP2 = r"""WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (
  SELECT rid, doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM w, unnest(range(1, len(ws) - 48)) AS t(i)),
least AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h),
gone AS (
  SELECT DISTINCT rid, unnest(range(i, i + 50)) AS i FROM win JOIN least USING (h) WHERE doc_id > m),
kept AS (
  SELECT x.rid, string_agg(x.word, ' ' ORDER BY x.i) AS t
  FROM (SELECT rid, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w) x ANTI JOIN gone USING (rid, i) GROUP BY x.rid),
lost AS (SELECT rid, count(*) AS n FROM gone GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN lost USING (rid) LEFT JOIN kept USING (rid)"""

OP7 = r"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
part AS (SELECT rid, base, substr(x, 2 * base + 1, 2 * (1024 + 199)) AS y FROM d, unnest(range(0, length(x) // 2 - 199, 1024)) AS t(base)),
win AS (SELECT rid, base + j AS i, md5(substr(y, 2 * j + 1, 400)) AS h FROM part, unnest(range(0, length(y) // 2 - 199)) AS t(j)),
twice AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
hit AS (SELECT rid, i, CASE WHEN i - lag(i) OVER (PARTITION BY rid ORDER BY i) <= 200 THEN 0 ELSE 1 END AS head FROM win SEMI JOIN twice USING (h)),
span AS (SELECT rid, sum(head) OVER (PARTITION BY rid ORDER BY i) AS s, i FROM hit),
runs AS (SELECT rid, s, min(i) AS lo, max(i) + 200 AS hi FROM span GROUP BY rid, s),
gaps AS (SELECT rid, hi AS a, lead(lo) OVER (PARTITION BY rid ORDER BY lo) AS b FROM runs
  UNION ALL SELECT rid, 0, min(lo) FROM runs GROUP BY rid),
kept AS (SELECT rid, string_agg(CASE WHEN b IS NULL THEN substr(x, 2 * a + 1) ELSE substr(x, 2 * a + 1, 2 * (b - a)) END, '' ORDER BY a) AS k
  FROM gaps JOIN d USING (rid) GROUP BY rid),
lost AS (SELECT rid, count(*) AS n, sum(hi - lo) AS bytes FROM runs GROUP BY rid)
SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(bytes, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN n IS NULL THEN x ELSE k END)) AS kept_sha256
FROM d LEFT JOIN lost USING (rid) LEFT JOIN kept USING (rid)"""


def template_regex(template: str) -> str:
    """The template over words that each have a blank before them."""
    out = []
    for part in re.findall(r"[\[\]]|\{\d+\}|[^\[\]{}]+", template):
        if part in "[]":
            out.append("(?:" if part == "[" else ")?")
        elif part[0] == "{":
            out.append("(?: [^ ]+){0," + part[1:-1] + "}")
        else:
            out += [" " + w for w in re.findall(r"[0-9a-z]+", part.lower())]
    return "".join(out) + "(?: |$)"


_quoted = lambda x: "'" + x.replace("'", "''") + "'"
_TEMPLATES = ",\n    ".join(f"({_quoted(label)}, {strength}, {_quoted(template_regex(t))})" for label, strength, t in TEMPLATES)
_PHRASES = ", ".join(f"({_quoted(label)}, [{', '.join(_quoted(w) for w in p.split())}])" for p, label in PHRASES)

OP4 = rf"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
phrase(label, p) AS (VALUES {_PHRASES}),
template(label, strength, re) AS (VALUES
    {_TEMPLATES}),
hit AS (
  SELECT rid, k - 1 AS k, label FROM w, unnest(range(1, len(ws) + 1)) AS t(k), phrase WHERE ws[k] = p[1] AND ws[k:k + len(p) - 1] = p),
base AS (SELECT rid, count(*) AS n, min(k) AS lo, max(k) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS names FROM hit GROUP BY rid),
said AS (
  SELECT rid, label, {BASE_STRENGTH} AS strength FROM hit
  UNION ALL SELECT rid, label, strength FROM (SELECT rid, ' ' || array_to_string(ws, ' ') AS t FROM w) JOIN template ON regexp_matches(t, re)),
best AS (SELECT rid, label, max(strength) AS s FROM said GROUP BY rid, label),
judged AS (SELECT rid, string_agg(label, ',' ORDER BY label) AS names, product(1 - s) AS miss FROM best GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word, hi::BIGINT AS last_word,
  coalesce(base.names, '') AS base_labels, coalesce(judged.names, '') AS labels, coalesce(round(1 - miss, 9), 0)::DOUBLE AS score
FROM w LEFT JOIN base USING (rid) LEFT JOIN judged USING (rid)
"""

ORACLE_SQL: dict[str, str] = {"op2_substring_dedup": OP2, "op4_license_scan": OP4, "op7_suffix_dedup": OP7}
