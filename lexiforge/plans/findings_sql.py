"""DuckDB SQL of the structural findings, of sign trigrams and of tests of hypotheses."""

from __future__ import annotations

from lexiforge.plans.oracles import NUMERALS, TOKENS


def _strength(name: str, source: str, rev: bool) -> str:
    w = "reverse(token)" if rev else "token"
    return f""", {name}_t AS (SELECT DISTINCT doc_id, {w} AS w FROM {source}),
{name}_s AS (SELECT doc_id, w, k, left(w, len(w) - k) AS stem, right(w, k) AS suf FROM {name}_t, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) - k >= 2),
{name}_b AS (SELECT DISTINCT doc_id, w AS stem, 1 AS bare FROM {name}_s),
{name}_g AS (SELECT s.doc_id, s.stem FROM {name}_s s LEFT JOIN {name}_b b USING (doc_id, stem) GROUP BY ALL HAVING count(*) + coalesce(max(b.bare), 0) >= 2),
{name}_p AS (SELECT s.*, count(*) OVER (PARTITION BY doc_id, suf) AS score FROM {name}_s s SEMI JOIN {name}_g USING (doc_id, stem)),
{name} AS (SELECT doc_id, sum(score) AS {name} FROM (SELECT doc_id, suf, max(score) AS score, row_number() OVER (PARTITION BY doc_id ORDER BY max(score) DESC) AS rk FROM {name}_p GROUP BY doc_id, suf) WHERE rk <= 10 GROUP BY doc_id)"""


WORDS = TOKENS + NUMERALS + """, nl AS (SELECT doc_id, list(sign) AS l FROM nums GROUP BY doc_id),
tn AS (SELECT tok.*, coalesce(l IS NOT NULL AND len(list_filter(string_split(token, ''), lambda s: NOT list_contains(l, s))) = 0, false) AS num FROM tok LEFT JOIN nl USING (doc_id)),
wo AS (SELECT doc_id, tok_idx, token FROM tn WHERE NOT num)"""

CONTROL = WORDS + f""", nt AS (SELECT doc_id, count(DISTINCT token) AS types FROM wo GROUP BY doc_id HAVING count(DISTINCT token) >= 20),
ok AS (SELECT nt.* FROM nt JOIN p USING (doc_id) WHERE spaced),
w2 AS (SELECT wo.* FROM wo SEMI JOIN ok USING (doc_id)),
s1 AS (SELECT doc_id, tok_idx, unnest(string_split(token, '')) AS sign, generate_subscripts(string_split(token, ''), 1) AS k FROM w2),
s2 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tok_idx, k) - 1 AS i FROM s1),
s3 AS (SELECT doc_id, sign, row_number() OVER (PARTITION BY doc_id ORDER BY md5('3:' || doc_id || ':' || i)) - 1 AS i FROM s2),
s4 AS (SELECT s2.doc_id, s2.tok_idx, string_agg(s3.sign, '' ORDER BY s2.k) AS token FROM s2 JOIN s3 USING (doc_id, i) GROUP BY ALL),
po AS (SELECT doc_id, token FROM (SELECT d.doc_id, d.token, types, row_number() OVER (PARTITION BY d.doc_id ORDER BY md5('3:' || d.doc_id || ':' || d.token), d.token) AS rk FROM (SELECT DISTINCT doc_id, token FROM s4) d JOIN ok USING (doc_id)) WHERE rk <= types)
{_strength('suffix', 'w2', False)}{_strength('prefix', 'w2', True)}{_strength('control_suffix', 'po', False)}{_strength('control_prefix', 'po', True)},
co AS (SELECT doc_id, coalesce(suffix, 0) AS suffix, coalesce(prefix, 0) AS prefix, coalesce(control_suffix, 0) AS control_suffix, coalesce(control_prefix, 0) AS control_prefix
       FROM ok LEFT JOIN suffix USING (doc_id) LEFT JOIN prefix USING (doc_id) LEFT JOIN control_suffix USING (doc_id) LEFT JOIN control_prefix USING (doc_id)),
ac AS (SELECT *, NOT (suffix * 10 < control_suffix * 13 AND prefix * 10 < control_prefix * 13) AS significant FROM co),
bs AS (SELECT doc_id, w, max(struct_pack(x := score * (100 + 15 * k), stem := stem, suf := suf)) AS v FROM suffix_p SEMI JOIN (SELECT doc_id FROM ac WHERE significant) USING (doc_id) GROUP BY doc_id, w),
en AS (SELECT doc_id, v.stem AS stem, v.suf AS suf FROM bs UNION SELECT bs.doc_id, v.stem, '' FROM bs JOIN suffix_t ty ON ty.doc_id = bs.doc_id AND ty.w = v.stem),
pw AS (SELECT DISTINCT doc_id, stem || suf AS token FROM en SEMI JOIN (SELECT doc_id, stem FROM en GROUP BY ALL HAVING count(DISTINCT suf) >= 2) USING (doc_id, stem))"""

_FUNCTION = CONTROL + """, tc AS (SELECT *, greatest(1, n // 10) AS size FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM tn)),
fw0 AS (SELECT doc_id, token, count(*) AS c, min(tok_idx) AS first, max(n) AS n, count(DISTINCT CASE WHEN tok_idx // size < 10 THEN tok_idx // size END) / max(least(10, ceil(n / size))) AS spread FROM tc WHERE NOT num GROUP BY ALL),
fw1 AS (SELECT *, median(len(token)) OVER (PARTITION BY doc_id) AS med, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, first) AS top FROM fw0),
fw AS (SELECT * FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY top) AS rk, token, c FROM fw1 ANTI JOIN pw USING (doc_id, token) WHERE top <= 40 AND c / n >= 0.005 AND len(token) <= med AND spread >= 0.7) WHERE rk <= 10)"""



def _signatures(name: str, splits: str, types: str) -> str:
    return f""", {name}_x AS (SELECT doc_id, w, max(struct_pack(x := score * (100 + 15 * k), stem := stem, suf := suf)) AS v FROM {splits} GROUP BY doc_id, w),
{name}_e AS (SELECT doc_id, v.stem AS stem, v.suf AS suf FROM {name}_x UNION SELECT y.doc_id, v.stem, '' FROM {name}_x y JOIN {types} ty ON ty.doc_id = y.doc_id AND ty.w = v.stem),
{name}_q AS (SELECT doc_id, stem, list_sort(list(DISTINCT suf)) AS e FROM {name}_e GROUP BY ALL HAVING count(DISTINCT suf) >= 2),
{name} AS (SELECT doc_id, array_to_string(e, '|') AS endings, count(*) AS stems, row_number() OVER (PARTITION BY doc_id ORDER BY -count(*) * len(e), array_to_string(e, '|')) AS rk FROM {name}_q GROUP BY doc_id, e HAVING count(*) >= 3)"""


ORACLE_SQL = {
    "affix_signatures_controlled": CONTROL + _signatures("real", "suffix_p", "suffix_t") + _signatures("fake", "control_suffix_p", "control_suffix_t") + """
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY rk) AS rk, endings, stems FROM real JOIN ac USING (doc_id) LEFT JOIN (SELECT doc_id, max(stems) AS best FROM fake GROUP BY doc_id) USING (doc_id)
        WHERE rk <= 8 AND significant AND stems >= 2 * greatest(coalesce(best, 2), 2)""",
    "name_candidates_uninflected": CONTROL + """, nw AS (SELECT doc_id, token, count(*) AS c, min(tok_idx) AS a, max(tok_idx) AS b FROM tok GROUP BY ALL),
        nx AS (SELECT *, sum(c) OVER (PARTITION BY doc_id) AS n, median(len(token)) OVER (PARTITION BY doc_id) AS med FROM nw)
        SELECT doc_id, rk, token, c FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, a) AS rk FROM nx ANTI JOIN pw USING (doc_id, token) WHERE c BETWEEN 2 AND 8 AND len(token) >= med AND (b - a) / n <= 0.2) WHERE rk <= 12""",
    "affix_control": CONTROL + """ SELECT *, CASE WHEN significant AND suffix + prefix > 0 THEN CASE WHEN suffix * 10 >= prefix * 13 THEN 'suffixing' WHEN prefix * 10 >= suffix * 13 THEN 'prefixing' ELSE 'mixed' END END AS side FROM ac""",
    "function_words": _FUNCTION + " SELECT * FROM fw",
    "word_order_hint": _FUNCTION + """, fl AS (SELECT tok.doc_id, unit_idx, pos, fw.rk IS NOT NULL AS f FROM tok LEFT JOIN fw USING (doc_id, token)),
        ld AS (SELECT *, lead(f) OVER (PARTITION BY doc_id, unit_idx ORDER BY pos) AS g FROM fl), ba AS (SELECT doc_id, count(*) FILTER (f AND NOT g) AS before, count(*) FILTER (NOT f AND g) AS after FROM ld GROUP BY doc_id)
        SELECT *, CASE WHEN before + after < 20 THEN NULL WHEN before / (before + after) >= 0.6 THEN 'head-initial' WHEN before / (before + after) <= 0.4 THEN 'head-final' END AS hint FROM ba WHERE before + after > 0""",
    "name_candidates_cased": TOKENS + r""", pt AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '') AS w FROM documents JOIN p USING (doc_id) WHERE hc),
        pa AS (SELECT doc_id, unnest(w) AS part, generate_subscripts(w, 1) AS i FROM pt), pl AS (SELECT *, lag(part) OVER (PARTITION BY doc_id ORDER BY i) AS last FROM pa),
        nm AS (SELECT doc_id, i, last, regexp_replace(part, '^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$', '', 'g') AS name FROM pl),
        cp AS (SELECT doc_id, name, count(*) AS c, min(i) AS first FROM nm WHERE NOT regexp_matches(last, '[.!?:"]$') AND regexp_matches(name, '^\p{Lu}\p{Ll}') GROUP BY ALL),
        c40 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, first) AS top FROM cp),
        fr AS (SELECT c40.*, coalesce(wc.c, 0) AS low FROM c40 LEFT JOIN wc ON wc.doc_id = c40.doc_id AND wc.token = lower(c40.name) WHERE top <= 40 AND c40.c >= 2)
        SELECT * FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY top) AS rk, name, c FROM fr WHERE low * 10 <= c * 12) WHERE rk <= 12""",
    "sign_trigrams": TOKENS + """, pd AS (SELECT doc_id, '##' || token || '#' AS t FROM tok) SELECT doc_id, gram, count(*) AS c FROM (SELECT doc_id, substr(t, CAST(i AS BIGINT), 3) AS gram FROM (SELECT doc_id, t, unnest(generate_series(1, len(t) - 2)) AS i FROM pd)) GROUP BY ALL""",
}
