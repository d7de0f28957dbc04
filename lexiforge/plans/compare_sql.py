"""DuckDB SQL of the comparison with reference languages."""

from __future__ import annotations

from lexiforge.plans import language_sql, oracles
from lexiforge.plans.findings_sql import CONTROL
from lexiforge.plans.language_sql import _FREQ, _LEX

_LATIN = "replace(replace(replace(replace(replace(replace(replace(replace(replace(strip_accents(lower({w})), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe'), 'ø', 'o'), 'đ', 'd'), 'ð', 'd'), 'ł', 'l'), 'þ', 'th'), 'ı', 'i')"
_VARIANTS = "list_distinct([{w}] || list_transform(generate_series(1, len({w})), lambda i: {w}[1:i - 1] || {w}[i + 1:]))"


def _shares(source: str, key: str) -> str:
    return f"""(SELECT {key}, list_transform((list_sort(list(share), 'DESC') || [0.0 FOR x IN range(60)])[1:60], lambda x: round(x, 9)) AS rank_profile, round(0.0 - sum(share * log2(share)), 6) AS h1, count(*) AS inventory
    FROM (SELECT {key}, c / sum(c) OVER (PARTITION BY {key}) AS share FROM {source}) GROUP BY {key})"""


def _strength(name: str, rev: bool) -> str:
    w = "reverse(word)" if rev else "word"
    return f""", {name}_t AS (SELECT lang, {w} AS w FROM aw),
{name}_s AS (SELECT lang, w, left(w, len(w) - k) AS stem, right(w, k) AS suf FROM {name}_t, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) - k >= 2),
{name}_g AS (SELECT s.lang, s.stem FROM {name}_s s LEFT JOIN (SELECT lang, w AS stem, 1 AS bare FROM {name}_t WHERE len(w) >= 3) b USING (lang, stem) GROUP BY ALL HAVING count(*) + coalesce(max(b.bare), 0) >= 2),
{name} AS (SELECT lang, sum(score) AS {name} FROM (SELECT lang, suf, count(*) AS score, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, suf) AS rk FROM {name}_s SEMI JOIN {name}_g USING (lang, stem) GROUP BY lang, suf) WHERE rk <= 10 GROUP BY lang)"""


_REFERENCES = f"""{_FREQ}, {_LEX}, prw AS (SELECT * FROM lx WHERE rank <= 8000 AND regexp_matches(word, '\\p{{L}}')),
lc AS (SELECT lang, sign, sum(c) AS c FROM (SELECT lang, c, unnest(string_split(word, '')) AS sign FROM prw) WHERE regexp_matches(sign, '^\\p{{L}}$') GROUP BY ALL),
iv AS (SELECT lang, count(*) FILTER (before < n * 0.995) AS inventory FROM (SELECT lang, sum(c) OVER (PARTITION BY lang ORDER BY c DESC, sign) - c AS before, sum(c) OVER (PARTITION BY lang) AS n FROM lc) GROUP BY lang),
wl AS (SELECT lang, round(sum(len(regexp_replace(word, '[^\\p{{L}}]', '', 'g')) * c) / sum(c), 6) AS word_len FROM prw GROUP BY lang),
aw AS (SELECT lang, word FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY rank) AS nth FROM prw) WHERE nth <= 5000 AND regexp_matches(word, '^\\p{{L}}+$')){_strength('rsuf', False)}{_strength('rpre', True)},
rp AS (SELECT lang, rank_profile, h1, iv.inventory, word_len, round(coalesce(rsuf, 0) / greatest(1, coalesce(rsuf, 0) + coalesce(rpre, 0)), 6) AS suffix_ratio
       FROM {_shares('lc', 'lang')} s JOIN iv USING (lang) JOIN wl USING (lang) LEFT JOIN rsuf USING (lang) LEFT JOIN rpre USING (lang))"""

_PROFILES = f"""dp AS (SELECT doc_id, rank_profile, h1, inventory, word_len, round(coalesce(suffix, 0) / greatest(1, coalesce(suffix, 0) + coalesce(prefix, 0)), 6) AS suffix_ratio
    FROM {_shares('sc', 'doc_id')} s JOIN (SELECT doc_id, round(avg(len(token)), 6) AS word_len FROM tok GROUP BY doc_id) USING (doc_id) LEFT JOIN ac USING (doc_id))"""

_INDEX = f"""dx AS (SELECT lang, word, min(rank) AS rank FROM (SELECT lang, rank, {_LATIN.format(w='word')} AS word FROM lx) WHERE len(word) >= 3 GROUP BY ALL),
ix AS (SELECT lang, variant, arg_min(word, rank) AS word FROM (SELECT lang, rank, word, unnest({_VARIANTS.format(w='word')}) AS variant FROM dx) GROUP BY lang, variant)"""

def _matched(lexicon: str) -> str:
    return f"""{oracles.TOKENS}, pl AS (SELECT doc_id, tok_idx, sign, k, row_number() OVER (PARTITION BY doc_id ORDER BY tok_idx, k) - 1 AS i FROM sg),
sh AS (SELECT doc_id, sign, row_number() OVER (PARTITION BY doc_id ORDER BY md5('0:' || doc_id || ':' || i)) - 1 AS i FROM pl),
ct AS (SELECT pl.doc_id, pl.tok_idx, string_agg(sh.sign, '' ORDER BY pl.k) AS token FROM pl JOIN sh USING (doc_id, i) GROUP BY ALL),
{_FREQ}, {lexicon}, {_INDEX},
ty AS (SELECT DISTINCT doc_id, true AS real, token AS word FROM tok WHERE len(token) >= 3 UNION ALL SELECT DISTINCT doc_id, false, token FROM ct WHERE len(token) >= 3),
tw AS (SELECT word, {_LATIN.format(w='word')} AS p FROM (SELECT DISTINCT word FROM ty)),
tr AS (SELECT word, unnest([p] || list_transform(generate_series(1, len(p)), lambda i: p[1:i - 1] || p[i + 1:])) AS variant, unnest(generate_series(0, len(p))) AS nth FROM tw),
mt AS (SELECT ix.lang, tr.word, arg_min(ix.word, nth) AS match FROM tr JOIN ix USING (variant) GROUP BY ix.lang, tr.word),
hit AS (SELECT ty.*, l.lang, mt.match FROM ty CROSS JOIN (SELECT DISTINCT lang FROM lx) l LEFT JOIN mt ON mt.lang = l.lang AND mt.word = ty.word),
sr AS (SELECT doc_id, lang, count(match) FILTER (real) / greatest(1, count(*) FILTER (real)) AS r, count(match) FILTER (NOT real) / greatest(1, count(*) FILTER (NOT real)) AS k,
       array_to_string(coalesce(list_sort(list(word || '~' || match) FILTER (real AND match IS NOT NULL)), [])[1:10], ' ') AS examples FROM hit GROUP BY doc_id, lang),
ro AS (SELECT doc_id, lang, round(r, 4) AS rate, round(k, 4) AS control, CASE WHEN k > 0 THEN round(r / k, 4) END AS lift, examples FROM sr),
lm AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(rate - control, 6) DESC, lang) AS rk FROM ro)"""


_MATCHES = _matched(_LEX)
#: The lexicon with all words of each language.
_WHOLE = "lx AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY c DESC, word) AS rank FROM fq)"

_SHARES_SQL = language_sql.ORACLE_SQL["script_shares"]

ORACLE_SQL = {
    "available_languages": f"WITH {_FREQ}, {_LEX} SELECT DISTINCT lang, CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' WHEN 'fr' THEN 'French' WHEN 'es' THEN 'Spanish' ELSE lang END AS name FROM lx",
    "reference_profiles": f"WITH {_REFERENCES} SELECT * FROM rp",
    "doc_profiles": f"{CONTROL}, {_PROFILES} SELECT * FROM dp",
    "profile_distance": f"""{CONTROL}, {_PROFILES}, {_REFERENCES},
        di AS (SELECT doc_id, lang, round(list_sum(list_transform(list_zip(dp.rank_profile, rp.rank_profile), lambda z: abs(z[1] - z[2]))) + abs(dp.h1 - rp.h1) * 0.25 + abs(dp.word_len - rp.word_len) * 0.1 + abs(dp.suffix_ratio - rp.suffix_ratio) * 0.3, 6) AS d FROM dp, rp)
        SELECT doc_id, rk, lang, round(d, 3) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY d, lang) AS rk FROM di) WHERE rk <= 6""",
    "deletion_index": f"WITH {_FREQ}, {_LEX}, {_INDEX} SELECT * FROM ix",
    "lexical_matching": f"{_MATCHES} SELECT doc_id, rk, lang, rate, control, lift, examples FROM lm",
    "look_alikes": f"""{_matched(_WHOLE)} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY rk) AS rk, lang, rate, control, lift FROM lm WHERE round(rate - control, 6) >= 0.1 AND coalesce(lift, 0) >= 1.5""",
    "anchors": f"""SELECT doc_id, 'two or more scripts: a readable part may be a key to the other' AS anchor FROM ({_SHARES_SQL}) WHERE share >= 0.05 GROUP BY doc_id HAVING count(*) >= 2
        UNION ALL SELECT DISTINCT doc_id, 'signs like numbers: words beside them may count things' FROM ({oracles.ORACLE_SQL['numeral_signs']})
        UNION ALL SELECT DISTINCT doc_id, 'words like names: they may be known from elsewhere' FROM ({oracles.ORACLE_SQL['name_candidates_caseless']})""",
    "letter_model": f"""WITH {_FREQ}, {_LEX}, mw AS (SELECT *, c * 1e6 / sum(c) OVER (PARTITION BY lang) AS f FROM lx WHERE rank <= 20000 AND regexp_matches(word, '\\p{{L}}')),
        lc AS (SELECT lang, x, sum(c) AS c FROM (SELECT lang, c, unnest(string_split(word, '')) AS x FROM mw) WHERE regexp_matches(x, '^\\p{{L}}$') GROUP BY ALL),
        al AS (SELECT lang, list(x) AS a FROM (SELECT lang, x, sum(c) OVER (PARTITION BY lang ORDER BY c DESC, x) - c AS before, sum(c) OVER (PARTITION BY lang) AS n FROM lc) WHERE before < n * 0.9995 GROUP BY lang),
        sq AS (SELECT lang, f, ['#', '#'] || list_filter(string_split(word, ''), lambda x: list_contains(a, x)) || ['#'] AS s FROM mw JOIN al USING (lang)),
        g AS (SELECT lang, s[i] AS a, s[i + 1] AS b, s[i + 2] AS c, sum(f) AS n FROM (SELECT lang, f, s, unnest(generate_series(1, len(s) - 2)) AS i FROM sq) GROUP BY ALL),
        x AS (SELECT *, sum(n) OVER (PARTITION BY lang, a, b) AS ab, sum(n) OVER (PARTITION BY lang, b, c) AS bc, sum(n) OVER (PARTITION BY lang, b) AS nb, sum(n) OVER (PARTITION BY lang, c) AS nc, sum(n) OVER (PARTITION BY lang) AS al FROM g),
        y AS (SELECT x.*, k FROM x JOIN (SELECT lang, count(DISTINCT c) AS k FROM g GROUP BY lang) USING (lang))
        SELECT lang, a, b, c, round(ln(ab / (ab + 5.0) * n / ab + (1 - ab / (ab + 5.0)) * (0.9 * (bc + 1e-9) / (nb + k * 1e-9) + 0.1 * (nc + 1e-9) / (al + k * 1e-9))), 6) AS logp FROM y""",
    "labels_and_transliteration": f"""WITH {_FREQ}, {_LEX} SELECT lang, word, array_to_string(list_transform(string_split(word, ''), lambda c: 'P0' || lpad(CAST(ascii(c) - 97 AS VARCHAR), 2, '0')), '-') AS shown, true AS parsed_back,
        array_to_string(list_sort({_VARIANTS.format(w='word')}), ' ') AS variants FROM lx WHERE regexp_matches(word, '^[a-z]+$')""",
}
