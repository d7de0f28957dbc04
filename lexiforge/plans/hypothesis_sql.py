"""DuckDB SQL of the tests of hypotheses; the commands are those of hypothesis_queries."""

from __future__ import annotations

from lexiforge.plans.findings_sql import CONTROL, WORDS
from lexiforge.plans.language_sql import _FREQ, _LEX
from lexiforge.plans.oracles import TOKENS

_GLOSSES = "(VALUES (0, 'the', 'line_start'), (1, 'und', 'der'), (2, 'de', 'line_end'), (3, 'et', 'numbers'), (4, 'the', NULL)) AS h(hyp, token, anchor)"
_ROLES = "(VALUES (5, 'the', 'function_word'), (6, 'und', 'unit_start'), (7, 'de', 'unit_end'), (8, 'et', 'name'), (9, 'the', 'number'), (10, 'the', 'verb')) AS h(hyp, token, role)"
_AFFIXES = "(VALUES (11, 'ing', false), (12, 'be', true), (13, 'en', false)) AS h(hyp, a, back)"

VALUES_SQL = f"""{TOKENS}, {_FREQ}, {_LEX}, vs AS (SELECT ['e', 't', 'a', 'o', 'n', 'i', 's', 'r', 'l', 'u'] AS v),
        cv AS (SELECT doc_id, token, c FROM wc WHERE regexp_full_match(token, '[etaonisrlu]+')), cd AS (SELECT doc_id, sum(c) AS covered FROM cv GROUP BY doc_id), al AS (SELECT doc_id, sum(c) AS n FROM wc GROUP BY doc_id),
        mp AS (SELECT doc_id, trial, list(s ORDER BY CASE WHEN trial = 0 THEN lpad(CAST(i AS VARCHAR), 9, '0') ELSE md5(trial || ':' || doc_id || ':' || i) END) AS m
               FROM (SELECT DISTINCT doc_id FROM cv), (SELECT unnest(range(201)) AS trial), (SELECT unnest(v) AS s, unnest(range(10)) AS i FROM vs) GROUP BY ALL),
        wd AS (SELECT doc_id, trial, c, translate(token, 'etaonisrlu', array_to_string(m, '')) AS word FROM mp JOIN cv USING (doc_id) WHERE len(token) >= 3),
        ra AS (SELECT doc_id, trial, coalesce(sum(c) FILTER (hit), 0) / sum(c) AS rate FROM (SELECT wd.*, lx.rank IS NOT NULL AS hit FROM wd LEFT JOIN (SELECT * FROM lx WHERE lang = 'en') lx USING (word)) GROUP BY doc_id, trial),
        re AS (SELECT doc_id, rate AS real FROM ra WHERE trial = 0), nl2 AS (SELECT doc_id, sum(rate) AS s, count(*) FILTER (rate >= real) AS beaten FROM ra JOIN re USING (doc_id) WHERE trial > 0 GROUP BY doc_id),
        x AS (SELECT d.doc_id, covered, n, coalesce(real, 0) AS rate, coalesce(s, 0) / 200 AS nm, (1 + coalesce(beaten, 200)) / 201.0 AS p FROM documents d LEFT JOIN cd USING (doc_id) LEFT JOIN al USING (doc_id) LEFT JOIN re USING (doc_id) LEFT JOIN nl2 USING (doc_id))
        SELECT doc_id, 0 AS hyp, CASE WHEN covered IS NOT NULL THEN round(covered / n, 4) END AS coverage, CASE WHEN covered IS NOT NULL THEN round(rate, 4) END AS rate, CASE WHEN covered IS NOT NULL THEN round(nm, 8) END AS null_mean,
        CASE WHEN covered IS NOT NULL THEN round(p, 4) END AS p_value, CASE WHEN covered IS NULL THEN 'UNTESTABLE' WHEN p < 0.01 AND rate > 0.1 THEN 'CONSISTENT' WHEN p < 0.05 THEN 'PARTLY CONSISTENT' ELSE 'INCONSISTENT' END AS verdict FROM x"""

ORACLE_SQL = {
    "parse_hypotheses": """SELECT * FROM (VALUES (0, 'gloss the = ARTICLE near line_start', 'gloss', 'the', 'ARTICLE', 'line_start', NULL, NULL, NULL, NULL), (1, 'gloss und = AND near der', 'gloss', 'und', 'AND', 'der', NULL, NULL, NULL, NULL),
        (2, 'gloss de = OF near line_end', 'gloss', 'de', 'OF', 'line_end', NULL, NULL, NULL, NULL), (3, 'gloss et = AND near numbers', 'gloss', 'et', 'AND', 'numbers', NULL, NULL, NULL, NULL), (4, 'gloss the = ARTICLE', 'gloss', 'the', 'ARTICLE', NULL, NULL, NULL, NULL, NULL),
        (5, 'role the function_word', 'role', 'the', NULL, NULL, 'function_word', NULL, NULL, NULL), (6, 'role und unit_start', 'role', 'und', NULL, NULL, 'unit_start', NULL, NULL, NULL), (7, 'role de unit_end', 'role', 'de', NULL, NULL, 'unit_end', NULL, NULL, NULL),
        (8, 'role et name', 'role', 'et', NULL, NULL, 'name', NULL, NULL, NULL), (9, 'role the number', 'role', 'the', NULL, NULL, 'number', NULL, NULL, NULL), (10, 'role the verb', 'role', 'the', NULL, NULL, 'verb', NULL, NULL, NULL),
        (11, 'affix -ing = GERUND', 'affix', NULL, 'GERUND', NULL, NULL, '-ing', NULL, NULL), (12, 'affix be- = PREFIX', 'affix', NULL, 'PREFIX', NULL, NULL, 'be-', NULL, NULL), (13, 'affix -en = PLURAL', 'affix', NULL, 'PLURAL', NULL, NULL, '-en', NULL, NULL),
        (14, 'values G001=a G002=b in de', 'sign_values', NULL, NULL, NULL, NULL, NULL, 'G001:a,G002:b', 'de'), (15, 'guess what', 'unknown', NULL, NULL, NULL, NULL, NULL, NULL, NULL)) AS t(hyp, line, kind, token, meaning, anchor, role, affix, pairs, language)""",
    "counterexamples": WORDS + f""", ce AS (SELECT *, lag(token) OVER q AS pt, lead(token) OVER q AS qt, coalesce(lag(num) OVER q, false) OR coalesce(lead(num) OVER q, false) AS nn FROM tn WINDOW q AS (PARTITION BY doc_id, unit_idx ORDER BY pos)),
        x AS (SELECT h.hyp, ce.doc_id, ce.unit_idx, ce.pos, CASE h.anchor WHEN 'numbers' THEN nn WHEN 'line_start' THEN pos = 0 WHEN 'line_end' THEN pos = unit_len - 1 ELSE coalesce(pt = h.anchor, false) OR coalesce(qt = h.anchor, false) END AS near FROM ce JOIN {_GLOSSES} ON ce.token = h.token WHERE h.anchor IS NOT NULL),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, hyp ORDER BY unit_idx, pos) AS rk FROM x WHERE NOT near)
        SELECT r.doc_id, hyp, rk, array_to_string(u, ' ') AS unit FROM r JOIN un USING (doc_id, unit_idx) WHERE rk <= 3""",
    "values_test": VALUES_SQL,
    "gloss_test": WORDS + f""", ce AS (SELECT *, lag(token) OVER q AS pt, lead(token) OVER q AS qt, coalesce(lag(num) OVER q, false) OR coalesce(lead(num) OVER q, false) AS nn FROM tn WINDOW q AS (PARTITION BY doc_id, unit_idx ORDER BY pos)),
        x AS (SELECT h.hyp, h.anchor, ce.doc_id, ce.token = h.token AS it, CASE h.anchor WHEN 'numbers' THEN nn WHEN 'line_start' THEN pos = 0 WHEN 'line_end' THEN pos = unit_len - 1 ELSE coalesce(pt = h.anchor, false) OR coalesce(qt = h.anchor, false) END AS near FROM ce, {_GLOSSES}),
        g AS (SELECT doc_id, hyp, any_value(anchor) AS anchor, count(*) FILTER (it) AS o, count(*) FILTER (it AND near) AS k, count(*) FILTER (near) / count(*) AS ch FROM x GROUP BY doc_id, hyp),
        r AS (SELECT d.doc_id, h.hyp, coalesce(o, 0) AS occurrences, CASE WHEN o > 0 AND h.anchor IS NOT NULL THEN k / o END AS rate, CASE WHEN o > 0 AND h.anchor IS NOT NULL THEN ch END AS chance FROM documents d CROSS JOIN {_GLOSSES} LEFT JOIN g ON g.doc_id = d.doc_id AND g.hyp = h.hyp)
        SELECT doc_id, hyp, occurrences, round(rate, 3) AS rate, round(chance, 3) AS chance, CASE WHEN rate IS NULL THEN 'UNTESTABLE' WHEN rate >= 0.7 AND rate >= 2 * chance THEN 'CONSISTENT' WHEN rate <= greatest(chance * 1.2, 0.2) THEN 'INCONSISTENT' ELSE 'PARTLY CONSISTENT' END AS verdict FROM r""",
    "role_test": CONTROL + f""", z AS (SELECT doc_id, count(*) AS n, max(unit_idx) + 1 AS nu FROM tok GROUP BY doc_id),
        us AS (SELECT doc_id, token, count(*) AS c, max(n) AS n, max(nu) AS nu, count(DISTINCT unit_idx * 10 // nu) AS tenths, max(unit_idx) - min(unit_idx) AS span, count(*) FILTER (pos = 0) AS st, count(*) FILTER (pos = unit_len - 1) AS en2, bool_or(num) AS num FROM tn JOIN z USING (doc_id) GROUP BY ALL),
        x AS (SELECT d.doc_id, h.hyp, h.role, us.*EXCLUDE (doc_id), pw.token IS NULL AS still FROM documents d CROSS JOIN {_ROLES} LEFT JOIN us ON us.doc_id = d.doc_id AND us.token = h.token LEFT JOIN pw ON pw.doc_id = d.doc_id AND pw.token = h.token),
        y AS (SELECT doc_id, hyp, coalesce(c, 0) AS occurrences, CASE WHEN c IS NULL THEN NULL WHEN role = 'function_word' THEN (c / n > 0.005)::INT + (tenths >= 7)::INT + still::INT WHEN role = 'number' THEN num::INT
              WHEN role = 'name' THEN (c BETWEEN 2 AND 10)::INT + still::INT + (span * 10 <= nu * 3)::INT WHEN role = 'unit_start' THEN (st * 10 >= c * 6)::INT WHEN role = 'unit_end' THEN (en2 * 10 >= c * 6)::INT END AS passed,
              CASE WHEN c IS NULL THEN NULL WHEN role IN ('function_word', 'name') THEN 3 WHEN role IN ('number', 'unit_start', 'unit_end') THEN 1 END AS checks FROM x)
        SELECT *, CASE WHEN checks IS NULL THEN 'UNTESTABLE' WHEN passed = checks THEN 'CONSISTENT' WHEN passed = 0 THEN 'INCONSISTENT' ELSE 'PARTLY CONSISTENT' END AS verdict FROM y""",
    "affix_test": WORDS + f""", tb AS (SELECT doc_id, token, CASE WHEN back THEN reverse(token) ELSE token END AS w, back, c FROM wc, (SELECT unnest([false, true]) AS back)),
        ca AS (SELECT h.hyp, h.back, doc_id, w, c, left(w, len(w) - len(a)) AS stem FROM tb JOIN {_AFFIXES} ON h.back = tb.back AND ends_with(w, CASE WHEN h.back THEN reverse(a) ELSE a END) AND len(w) > len(a) + 1),
        ot AS (SELECT ca.hyp, ca.doc_id, ca.w, any_value(ca.c) AS c, count(*) AS forms, bool_or(tb.w = ca.stem) AS bare FROM ca JOIN tb ON tb.doc_id = ca.doc_id AND tb.back = ca.back AND starts_with(tb.w, ca.stem) GROUP BY ca.hyp, ca.doc_id, ca.w),
        g AS (SELECT doc_id, hyp, sum(c) AS occurrences, count(*) AS types, count(*) FILTER (forms >= 2) AS other_stems, count(*) FILTER (bare) AS bare_stems FROM ot GROUP BY doc_id, hyp)
        SELECT d.doc_id, h.hyp, coalesce(occurrences, 0) AS occurrences, coalesce(types, 0) AS types, coalesce(other_stems, 0) AS other_stems, coalesce(bare_stems, 0) AS bare_stems,
        CASE WHEN other_stems >= 3 THEN 'CONSISTENT' WHEN other_stems > 0 THEN 'PARTLY CONSISTENT' ELSE 'INCONSISTENT' END AS verdict FROM documents d CROSS JOIN {_AFFIXES} LEFT JOIN g ON g.doc_id = d.doc_id AND g.hyp = h.hyp""",
}
