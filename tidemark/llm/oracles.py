"""DuckDB SQL for those queries of this subpackage that SQL can express."""

from __future__ import annotations

from tidemark.llm.mixing import WEIGHTS
from tidemark.llm.quality_rules import STOP_WORDS

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_BLANKS = r"regexp_replace({}, '[\x20\x09-\x0D]', '', 'g')"

OP2 = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
g AS (SELECT k, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
t AS (SELECT k, i, count(*) OVER (PARTITION BY k, w[i], w[i + 1], w[i + 2]) AS n FROM g),
c AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS p FROM t WHERE n > 1) GROUP BY k),
l AS (SELECT k, list_filter(string_split(text, chr(10)), lambda x: length({_BLANKS.format("x")}) > 0) AS l FROM d),
f AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length({_BLANKS.format("text")})::BIGINT AS word_chars,
    (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l) AS n_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words,
    len(list_filter(w, lambda x: rtrim(lower(x), '.,;:!?') IN ({", ".join(f"'{x}'" for x in sorted(set(STOP_WORDS)))}))) AS n_stop,
    len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_alpha
  FROM d LEFT JOIN c USING (k) JOIN l USING (k)
),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars / n_words BETWEEN 2.5 AND 12 AND n_symbols / n_words <= 0.25 AND n_stop / n_words >= 0.05
    AND n_dup_lines / n_lines <= 0.5 AND n_alpha / n_words >= 0.7 AS kept
FROM b
"""

OP7 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size, md5(coalesce(text, '')) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source),
w AS (SELECT source, source_size, [{", ".join(map(str, WEIGHTS))}][k % {len(WEIGHTS)} + 1] AS weight, 1.5 * sum(source_size) OVER () AS total FROM s),
r(n, source, source_size, weight, total, capped) AS (
  SELECT 0, source, source_size, weight, total, false FROM w
  UNION ALL
  SELECT n + 1, source, source_size, weight, total,
    capped OR weight * (total - coalesce(sum(2.0 * source_size) FILTER (WHERE capped) OVER (), 0)) / nullif(sum(weight) FILTER (WHERE NOT capped) OVER (), 0) > 2.0 * source_size
  FROM r WHERE n < 40
),
z AS (SELECT * FROM r WHERE n = 40),
t AS (SELECT source, source_size, CASE WHEN capped THEN 2.0 * source_size
    ELSE weight * ((total - coalesce(sum(2.0 * source_size) FILTER (WHERE capped) OVER (), 0))::DOUBLE / (sum(weight) FILTER (WHERE NOT capped) OVER ())) END::DOUBLE AS target FROM z),
p AS (SELECT d.*, source_size, target, CASE WHEN source_size = 0 THEN 0.0::DOUBLE ELSE target / source_size END AS rate,
    ('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, '') || ':' || h), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS draw
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM p
"""

OP6 = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, text FROM documents),
u AS (SELECT k, doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
m AS (SELECT *, regexp_replace(array_to_string(regexp_extract_all(raw, '[^\x20\x09-\x0D]+'), ' '), '[^ ]*[0-9][^ ]*', '<*>', 'g') AS m FROM u),
l AS (SELECT *, len(string_split(m, ' ')) AS n, array_to_string(string_split(m, ' ')[1:4], ' ') AS lead FROM m WHERE m <> ''),
c AS (SELECT m, n, lead, count(DISTINCT k) AS docs, min(doc_id) AS first, count(DISTINCT k) >= 3 OR n > 50 AND count(DISTINCT k) >= 2 AS recurs FROM l GROUP BY 1, 2, 3),
v AS (SELECT *, string_split(m, ' ') AS w, n - 4 AS t FROM c WHERE n > 6),
pairs AS (SELECT a.g AS a, b.g AS b FROM range(5) a(g), range(5) b(g) WHERE a.g <= b.g),
cut AS (SELECT DISTINCT m, n, lead, recurs, array_to_string(list_transform(w, lambda x, i: CASE WHEN i - 5 >= a * t // 5 AND i - 5 < (a + 1) * t // 5 OR i - 5 >= b * t // 5 AND i - 5 < (b + 1) * t // 5 THEN '<>' ELSE x END), ' ') AS template
  FROM v, pairs WHERE 5 * ((a + 1) * t // 5 - a * t // 5 + CASE WHEN a < b THEN (b + 1) * t // 5 - b * t // 5 ELSE 0 END) BETWEEN 1 AND 2 * t),
gen AS (SELECT cut.n, cut.lead, template, min(l.doc_id) AS first FROM cut JOIN l USING (m) GROUP BY 1, 2, 3 HAVING count(DISTINCT k) >= 3 AND NOT bool_and(recurs)),
found AS (SELECT m, min(first) AS first FROM (
  SELECT m, first FROM c WHERE recurs UNION ALL SELECT cut.m, gen.first FROM cut JOIN gen USING (n, lead, template)) GROUP BY m),
x AS (SELECT m.*, coalesce(m.doc_id IS DISTINCT FROM f.first, false) AND f.m IS NOT NULL AS gone FROM m LEFT JOIN found f ON m.m = f.m)
SELECT any_value(doc_id) AS doc_id, count(*) FILTER (WHERE m <> '') AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, md5(coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_md5
FROM x GROUP BY k
"""

OP12 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
  sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
x AS (SELECT doc_id, text, u, len(u)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM x),
p AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""

OP13 = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^ 	-]+') AS w FROM documents),
s AS (SELECT k, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
h AS (SELECT s.k, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM s JOIN d USING (k)),
r AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY h) AS n FROM h) WHERE n > 1),
g AS (SELECT DISTINCT k, unnest(range(i, i + 35)) AS i FROM r),
l AS (SELECT k, list(i) AS gone FROM g GROUP BY k),
x AS (SELECT doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN l USING (k))
SELECT doc_id, len(w)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN len(gone) = 0 THEN w WHEN len(gone) = len(w) THEN [] ELSE list_filter(w, lambda y, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM x
"""

SQL = {"op12_fill_in_middle": OP12, "op13_substring_dedup": OP13, "op6_line_dedup": OP6, "op2_quality_rules": OP2, "op7_mixing": OP7}
