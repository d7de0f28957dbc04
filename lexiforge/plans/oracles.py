"""DuckDB SQL for the queries: each is a body over the common table expressions ``tok`` and ``sg``."""

from __future__ import annotations


TOKENS = r"""
WITH b AS (SELECT doc_id, replace(coalesce(text, ''), chr(13), '') AS body FROM documents),
p AS (SELECT doc_id, regexp_matches(body, '\p{Lu}') AND regexp_matches(body, '\p{Ll}') AS hc, len(regexp_extract_all(body, '[\p{Po}.!?।॥。！？؟;·]')) >= 3 AS sm,
             len(regexp_extract_all(replace(body, chr(10), ''), '\s')) / greatest(1, len(replace(body, chr(10), ''))) >= 0.03 AS spaced,
             list_filter(string_split(body, chr(10)), lambda x: trim(x) <> '') AS lines FROM b),
c AS (SELECT doc_id, hc, sm, spaced, CASE WHEN sm THEN string_split(regexp_replace(array_to_string(lines, ' '), '([.!?।॥。！？؟])\s+', '\1' || chr(1), 'g'), chr(1)) ELSE lines END AS chunks FROM p),
u0 AS (SELECT doc_id, sm, list_filter(list_transform(chunks, lambda ch: list_filter(list_transform(CASE WHEN spaced THEN string_split_regex(ch, '\s+') ELSE string_split(regexp_replace(ch, '\s', '', 'g'), '') END,
         lambda t: CASE WHEN hc THEN lower(regexp_replace(t, '\p{P}', '', 'g')) ELSE regexp_replace(t, '\p{P}', '', 'g') END), lambda t: t <> '')), lambda u: len(u) > 0) AS units FROM c),
uu AS (SELECT doc_id, CASE WHEN len(units) <= 1 AND len(flatten(units)) > 60 THEN '12-token window' WHEN sm THEN 'sentence' ELSE 'line' END AS unit_kind,
          CASE WHEN len(units) <= 1 AND len(flatten(units)) > 60 THEN list_transform(generate_series(0, (len(flatten(units)) - 1) // 12), lambda i: flatten(units)[i * 12 + 1 : i * 12 + 12]) ELSE units END AS units FROM u0),
un AS (SELECT doc_id, unit_kind, unnest(units) AS u, generate_subscripts(units, 1) - 1 AS unit_idx FROM uu),
ub AS (SELECT *, len(u) AS unit_len, sum(len(u)) OVER (PARTITION BY doc_id ORDER BY unit_idx) - len(u) AS base FROM un),
tk AS (SELECT doc_id, unit_idx, unit_len, base, unnest(u) AS token, generate_subscripts(u, 1) - 1 AS pos FROM ub),
tok AS (SELECT doc_id, unit_idx, pos, unit_len, CAST(base + pos AS BIGINT) AS tok_idx, token FROM tk),
sg AS (SELECT doc_id, tok_idx, unnest(string_split(token, '')) AS sign, generate_subscripts(string_split(token, ''), 1) - 1 AS k FROM tok),
sc AS (SELECT doc_id, sign, count(*) AS c, sum(count(*)) OVER (PARTITION BY doc_id) AS total FROM sg GROUP BY doc_id, sign),
wc AS (SELECT doc_id, token, count(*) AS c, min(tok_idx) AS first, sum(count(*)) OVER (PARTITION BY doc_id) AS total FROM tok GROUP BY doc_id, token)
"""


# Texts without white space (see queries.unspaced): the sign that divides words, and the number of tokens.
UNSPACED = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', CASE WHEN ((doc_id % 2) + 2) % 2 = 0 THEN chr(57376) ELSE '' END, 'g') AS body FROM documents),
ch AS (SELECT doc_id, unnest(string_split(body, '')) AS ch, generate_subscripts(string_split(body, ''), 1) AS i FROM d WHERE body <> ''),
nb AS (SELECT *, lag(ch) OVER o AS l, lead(ch) OVER o AS r, i - row_number() OVER (PARTITION BY doc_id, ch ORDER BY i) AS run FROM ch WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
ct AS (SELECT doc_id, ch, count(*) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(i)) AS rk FROM nb GROUP BY doc_id, ch),
db AS (SELECT doc_id, ch, sum(m // 2) AS doubled FROM (SELECT doc_id, ch, run, count(*) AS m FROM nb GROUP BY ALL) GROUP BY ALL),
sd AS (SELECT doc_id, ch, s, x, count(*) AS c FROM (SELECT doc_id, ch, 'l' AS s, l AS x FROM nb WHERE l IS NOT NULL UNION ALL SELECT doc_id, ch, 'r', r FROM nb WHERE r IS NOT NULL) GROUP BY ALL),
en AS (SELECT doc_id, ch, sum(-c / t * log2(c / t)) AS score FROM (SELECT *, sum(c) OVER (PARTITION BY doc_id, ch, s) AS t FROM sd) GROUP BY ALL),
ca AS (SELECT doc_id, ch, rk, score, rk <= 6 AND doubled / n < 0.02 AS fit FROM ct JOIN db USING (doc_id, ch) JOIN en USING (doc_id, ch) WHERE rk <= 15 AND n >= 10),
be AS (SELECT doc_id, max(struct_pack(s := score, k := -rk, c := ch)) AS b FROM ca WHERE fit GROUP BY doc_id),
found AS (SELECT be.doc_id, any_value(b.c) AS ch FROM be JOIN ca ON ca.doc_id = be.doc_id AND ca.ch <> b.c GROUP BY be.doc_id HAVING any_value(b.s) > max(score) * 1.05),
sm AS (SELECT doc_id, body, found.ch AS sep, regexp_matches(body, '\p{Lu}') AND regexp_matches(body, '\p{Ll}') AS hc FROM d LEFT JOIN found USING (doc_id)),
w AS (SELECT doc_id, len(list_filter(list_transform(CASE WHEN sep IS NOT NULL THEN string_split(body, sep) ELSE string_split(body, '') END, lambda t: regexp_replace(t, '\p{P}', '', 'g')), lambda t: t <> '')) AS n, 1 AS nu FROM sm)
"""


def _pairs(source: str, keys: str) -> str:
    return f"""(SELECT {keys}, substr('^' || token || '$', CAST(i AS BIGINT), 2) AS ab FROM (SELECT *, unnest(generate_series(1, len(token) + 1)) AS i FROM {source}))"""


def _cond(source: str, keys: str) -> str:
    return f"""(SELECT {keys}, 0.0 - sum(c / n * log2(c / oa)) AS h_cond FROM (
        SELECT *, CAST(sum(c) OVER (PARTITION BY {keys}, a) AS DOUBLE) AS oa, CAST(sum(c) OVER (PARTITION BY {keys}) AS DOUBLE) AS n FROM (
            SELECT {keys}, ab, substr(ab, 1, 1) AS a, count(*) AS c FROM {_pairs(source, keys)} GROUP BY ALL)) GROUP BY {keys})"""


def _top(source: str, column: str, k: int, order: str) -> str:
    return f"""SELECT doc_id, rk, {column}, c FROM (SELECT doc_id, {column}, count(*) AS c, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min({order})) AS rk
        FROM {source} GROUP BY doc_id, {column}) WHERE rk <= {k}"""


def _grams(n: int) -> str:
    return f"""(SELECT doc_id, tok_idx, i, substr(token, CAST(i AS BIGINT), {n}) AS gram FROM (SELECT doc_id, tok_idx, token, unnest(generate_series(1, len(token) - {n - 1})) AS i FROM tok WHERE len(token) >= {n}))"""


_ZIPF = """(SELECT doc_id, round(0.0 - regr_slope(y, x), 3) AS slope, round(regr_intercept(y, x), 3) AS intercept, CASE WHEN stddev_pop(y) = 0 THEN 1.0 ELSE round(regr_r2(y, x), 3) END AS r2, count(*) AS fitted_ranks
    FROM (SELECT doc_id, log10(rk) AS x, log10(c) AS y FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, first) AS rk FROM wc) WHERE c >= 2) GROUP BY doc_id HAVING count(*) >= 5)"""


def _affix(rev: bool) -> str:
    w = "reverse(token)" if rev else "token"
    return f""", ty AS (SELECT DISTINCT doc_id, {w} AS w FROM tok),
sp AS (SELECT doc_id, w, k, left(w, len(w) - k) AS stem, right(w, k) AS suf FROM ty, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) - k >= 2),
st AS (SELECT doc_id, stem FROM sp GROUP BY doc_id, stem HAVING count(*) + coalesce(max((SELECT 1 FROM ty JOIN (SELECT DISTINCT doc_id AS d, w AS x FROM sp) q ON q.d = ty.doc_id AND q.x = ty.w WHERE ty.doc_id = sp.doc_id AND ty.w = sp.stem)), 0) >= 2),
pr AS (SELECT sp.*, count(*) OVER (PARTITION BY doc_id, suf) AS score FROM sp SEMI JOIN st USING (doc_id, stem)),
bs AS (SELECT doc_id, w, max(struct_pack(x := score * (100 + 15 * k), stem := stem, suf := suf)) AS v FROM pr GROUP BY doc_id, w)
"""


def _scores(rev: bool) -> str:
    affix = "reverse(suf)" if rev else "suf"
    return TOKENS + _affix(rev) + f"""SELECT doc_id, rk, affix, score FROM (SELECT doc_id, {affix} AS affix, max(score) AS score, row_number() OVER (PARTITION BY doc_id ORDER BY max(score) DESC, {affix}) AS rk
        FROM pr GROUP BY doc_id, {affix}, suf) WHERE rk <= 12"""


NUMERALS = r""", dbl AS (SELECT doc_id, substr(pr, 1, 1) AS sign, count(*) AS d FROM (SELECT doc_id, substr(token, CAST(i AS BIGINT), 2) AS pr FROM (SELECT doc_id, token, unnest(generate_series(1, len(token) - 1)) AS i FROM tok WHERE len(token) >= 2))
        WHERE substr(pr, 1, 1) = substr(pr, 2, 1) GROUP BY ALL),
nums AS (SELECT sc.doc_id, sc.sign, sc.c, CASE WHEN regexp_full_match(sc.sign, '\p{Nd}') THEN 'digit' ELSE 'tally' END AS kind FROM sc LEFT JOIN dbl USING (doc_id, sign)
         WHERE regexp_full_match(sc.sign, '\p{Nd}') OR sc.c >= 5 AND coalesce(d, 0) / sc.c >= 0.25 AND coalesce(d, 0) / sc.c > 5 * sc.c / total)
"""


_TYPES = [
    ("legal or licence text", "hereby|licence|license|warranty|liability|pursuant"), ("letter or email", "dear |regards|sincerely|subject:"),
    ("invoice or financial record", "invoice|total|amount due|gst|qty"), ("academic or technical paper", "abstract|introduction|references|et al"), ("code or configuration", "def |import |function|{|};"),
]


def _doc_type() -> str:
    hits = [" + ".join(f"CAST(contains(t, '{m}') AS INTEGER)" for m in marks.split("|")) for _, marks in _TYPES]
    cols = ", ".join(f"{h} AS h{i}" for i, h in enumerate(hits))
    most = "greatest(" + ", ".join(f"h{i}" for i in range(len(hits))) + ")"
    cases = " ".join(f"WHEN h{i} = {most} AND {most} >= 2 THEN '{n}'" for i, (n, _) in enumerate(_TYPES))
    return f"SELECT doc_id, CASE {cases} ELSE 'general prose' END AS doc_type FROM (SELECT doc_id, {cols} FROM (SELECT doc_id, lower(text) AS t FROM documents))"


def _redact() -> str:
    steps = [
        (r"sk-ant-[A-Za-z0-9_\-]{10,}", "API_KEY=<redacted>"), (r"\bsk-[A-Za-z0-9_\-]{20,}", "API_KEY=<redacted>"), (r"\bAKIA[0-9A-Z]{16}\b", "AWS_ACCESS_KEY_ID=<redacted>"),
        (r"\bgh[pousr]_[A-Za-z0-9]{30,}\b", "GITHUB_TOKEN=<redacted>"), (r"\bAIza[0-9A-Za-z_\-]{30,}\b", "GOOGLE_API_KEY=<redacted>"), (r"\bxox[abpr]-[A-Za-z0-9\-]{10,}\b", "SLACK_TOKEN=<redacted>"),
        (r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]+?-----END [A-Z ]*PRIVATE KEY-----", "PRIVATE_KEY=<redacted>"),
        (r"(?i)\b(api[_-]?key|secret|password|passwd|token|auth)\b(\s*[:=]\s*)(?:''[^\s''\"]{6,}''|\"[^\s''\"]{6,}\"|[^\s''\"]{6,})", r"\1\2<redacted>"),
    ]
    sql = "WITH r0 AS (SELECT doc_id, coalesce(text, '') AS t, 0 AS h FROM documents)"
    for i, (pattern, to) in enumerate(steps):
        sql += f", r{i + 1} AS (SELECT doc_id, regexp_replace(t, '{pattern}', '{to}', 'g') AS t, h + len(regexp_extract_all(t, '{pattern}')) AS h FROM r{i})"
    return sql + f" SELECT doc_id, t AS text, CAST(h AS INTEGER) AS hits FROM r{len(steps)}"


ORACLE_SQL = {
    "units": TOKENS + "SELECT doc_id, unit_kind, unit_idx, array_to_string(u, ' ') AS unit FROM un",
    "tokens": TOKENS + "SELECT * FROM tok",
    "sign_frequency": TOKENS + "SELECT doc_id, sign, c FROM sc",
    "sign_inventory": TOKENS + """, i AS (SELECT doc_id, max(total) AS total_signs, count(*) AS distinct_signs, count(*) FILTER (c = 1) AS f1, count(*) FILTER (c = 2) AS f2, 0.0 - sum(c / total * log2(c / total)) AS h FROM sc GROUP BY doc_id),
        j AS (SELECT *, distinct_signs + CASE WHEN f2 > 0 THEN f1 * f1 / (2.0 * f2) ELSE f1 * (f1 - 1) / 2.0 END AS chao FROM i)
        SELECT doc_id, total_signs, distinct_signs, f1 AS hapax_signs, round(chao, 1) AS chao1_inventory, round(f1 / total_signs, 4) AS unseen_mass, round(h, 4) AS h1,
        CASE WHEN round(chao) <= 40 THEN 'alphabet or abjad' WHEN round(chao) <= 100 THEN 'syllabary (possibly with some logograms)' WHEN round(chao) <= 1000 THEN 'logo-syllabic system' ELSE 'logographic system' END AS system_type FROM j""",
    "divider_like_signs": TOKENS + "SELECT s.doc_id, s.sign, s.alone FROM (SELECT doc_id, token AS sign, count(*) AS alone FROM tok WHERE len(token) = 1 GROUP BY ALL) s JOIN sc USING (doc_id, sign) SEMI JOIN (SELECT doc_id FROM p WHERE spaced) USING (doc_id) WHERE alone >= 5 AND alone / sc.c >= 0.8",
    "conditional_entropy": TOKENS + f"SELECT doc_id, round(h_cond, 4) AS h_cond FROM {_cond('tok', 'doc_id')}",
    "word_statistics": TOKENS + "SELECT doc_id, sum(c) AS tokens, count(*) AS types, round(count(*) / sum(c), 4) AS ttr, round(sum(c * len(token)) / sum(c), 4) AS mean_length, round(0.0 - sum(c / total * log2(c / total)), 4) AS h_word FROM wc GROUP BY doc_id",
    "zipf_fit": TOKENS + f"SELECT * FROM {_ZIPF}",
    "top_words": TOKENS + _top("tok", "token", 25, "tok_idx"),
    "top_bigrams": TOKENS + _top(_grams(2), "gram", 15, "struct_pack(a := tok_idx, b := i)"),
    "top_trigrams": TOKENS + _top(_grams(3), "gram", 15, "struct_pack(a := tok_idx, b := i)"),
    "structure_verdict": TOKENS + f""", pl AS (SELECT seed, doc_id, tok_idx, sign, k, row_number() OVER (PARTITION BY seed, doc_id ORDER BY tok_idx, k) - 1 AS i FROM sg, (SELECT unnest([0, 1, 2, 3, 4]) AS seed)),
        sh AS (SELECT seed, doc_id, sign, row_number() OVER (PARTITION BY seed, doc_id ORDER BY md5(seed || ':' || doc_id || ':' || i)) - 1 AS i FROM pl),
        ct AS (SELECT pl.seed, pl.doc_id, pl.tok_idx, string_agg(sh.sign, '' ORDER BY pl.k) AS token FROM pl JOIN sh USING (seed, doc_id, i) GROUP BY ALL),
        m AS (SELECT a.doc_id, a.h_cond AS h, b.h AS hs, n.n AS ts, t.types, z.slope, z.r2 FROM {_cond('tok', 'doc_id')} a JOIN (SELECT doc_id, avg(h_cond) AS h FROM {_cond('ct', 'doc_id, seed')} GROUP BY doc_id) b USING (doc_id)
              JOIN (SELECT doc_id, avg(n) AS n FROM (SELECT doc_id, seed, CAST(count(DISTINCT token) AS DOUBLE) AS n FROM ct GROUP BY ALL) GROUP BY doc_id) n USING (doc_id) JOIN (SELECT doc_id, count(*) AS types FROM wc GROUP BY doc_id) t USING (doc_id) LEFT JOIN {_ZIPF} z USING (doc_id)),
        g AS (SELECT *, CASE WHEN hs <> 0 THEN (hs - h) / hs ELSE 0.0 END AS gap FROM m)
        SELECT doc_id, round(h, 3) AS h_cond, round(hs, 3) AS h_cond_shuffled, round(ts, 2) AS types_shuffled, round(gap, 4) + 0.0 AS structure_gap,
        CASE WHEN coalesce(gap >= 0.08 AND slope BETWEEN 0.7 AND 1.4 AND r2 >= 0.85 AND ts > 1.15 * types, false) THEN 'language-like' WHEN gap < 0.03 THEN 'random-like' ELSE 'structured, unclear' END AS verdict FROM g""",
    "signs_per_word": TOKENS + "SELECT p.doc_id, CASE WHEN spaced THEN 'whitespace' ELSE 'none' END AS separator, CASE WHEN spaced THEN round(m, 4) END AS signs_per_word FROM p LEFT JOIN (SELECT doc_id, avg(len(token)) AS m FROM tok GROUP BY doc_id) USING (doc_id)",
    "sample_units": TOKENS + "SELECT doc_id, unit_idx, array_to_string(u, ' ') AS unit FROM un WHERE unit_idx < 3",
    "zipf_curve": TOKENS + f""", pl AS (SELECT doc_id, tok_idx, sign, k, row_number() OVER (PARTITION BY doc_id ORDER BY tok_idx, k) - 1 AS i FROM sg),
        sh AS (SELECT doc_id, sign, row_number() OVER (PARTITION BY doc_id ORDER BY md5('0:' || doc_id || ':' || i)) - 1 AS i FROM pl),
        ct AS (SELECT pl.doc_id, pl.tok_idx, string_agg(sh.sign, '' ORDER BY pl.k) AS token FROM pl JOIN sh USING (doc_id, i) GROUP BY ALL),
        tw AS (SELECT doc_id, 'document' AS series, token, count(*) AS c, min(tok_idx) AS f FROM tok GROUP BY ALL UNION ALL SELECT doc_id, 'shuffled', token, count(*), min(tok_idx) FROM ct GROUP BY ALL)
        SELECT doc_id, series, row_number() OVER (PARTITION BY doc_id, series ORDER BY c DESC, f) AS rk, CAST(c AS DOUBLE) AS freq FROM tw
        UNION ALL SELECT doc_id, 'fit', i AS rk, round(pow(10.0, intercept - slope * log10(i)), 3) FROM (SELECT *, unnest(generate_series(1, fitted_ranks)) AS i FROM {_ZIPF})""",
    "unspaced_separators": UNSPACED + r"""SELECT d.doc_id, CASE WHEN found.ch IS NULL THEN 'none' ELSE 'sign ' || CASE WHEN found.ch = chr(57376) THEN 'P032' ELSE found.ch END END AS separator, coalesce(w.n, 0) AS tokens
        FROM d LEFT JOIN found USING (doc_id) LEFT JOIN w USING (doc_id)""",
    "unspaced_notes": UNSPACED + r"""SELECT doc_id, seq, note FROM (SELECT d.doc_id, unnest(list_filter([CASE WHEN found.ch IS NOT NULL THEN 'there is no white space; the sign ' || CASE WHEN found.ch = chr(57376) THEN 'P032' ELSE found.ch END || ' is taken as the word divider'
        ELSE 'there is no word divider; each sign is a token' END, CASE WHEN nu <= 1 AND n > 60 THEN 'there are neither sentences nor lines; units are runs of 12 tokens' END], lambda x: x IS NOT NULL)) AS note,
        unnest(range(2)) AS seq FROM d LEFT JOIN found USING (doc_id) LEFT JOIN w USING (doc_id)) WHERE note IS NOT NULL""",
    "redact_documents": _redact(),
    "condition_notes": "SELECT doc_id, len(text) AS characters, len(text) - len(replace(text, chr(10), '')) + 1 AS lines, len(text) - len(replace(text, chr(65533), '')) AS unreadable FROM documents",
    "doc_type": _doc_type(),
    "affix_scores": _scores(False),
    "prefix_scores": _scores(True),
    "affix_best_split": TOKENS + _affix(False) + "SELECT doc_id, w, v.stem AS stem, v.suf AS suf FROM bs",
    "affix_signatures": TOKENS + _affix(False) + """, en AS (SELECT doc_id, v.stem AS stem, v.suf AS suf FROM bs UNION SELECT bs.doc_id, v.stem, '' FROM bs JOIN ty ON ty.doc_id = bs.doc_id AND ty.w = v.stem),
        pa AS (SELECT doc_id, stem, list_sort(list(DISTINCT suf)) AS e FROM en GROUP BY ALL HAVING count(DISTINCT suf) >= 2)
        SELECT doc_id, rk, endings, stems FROM (SELECT doc_id, array_to_string(e, '|') AS endings, count(*) AS stems, row_number() OVER (PARTITION BY doc_id ORDER BY -count(*) * len(e), array_to_string(e, '|')) AS rk FROM pa GROUP BY doc_id, e HAVING count(*) >= 3) WHERE rk <= 8""",
    "dispersion": TOKENS + """SELECT doc_id, token, round(count(DISTINCT CASE WHEN tok_idx // size < 10 THEN tok_idx // size END) / max(least(10, ceil(n / size))), 4) AS dispersion
        FROM (SELECT *, greatest(1, n // 10) AS size FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM tok)) GROUP BY doc_id, token""",
    "positional_words": TOKENS + """, w AS (SELECT doc_id, token, count(*) AS c, count(*) FILTER (pos = 0) AS f, count(*) FILTER (pos = unit_len - 1) AS l, min(tok_idx) AS seen FROM tok WHERE unit_len >= 3 GROUP BY ALL),
        x AS (SELECT *, sum(f) OVER (PARTITION BY doc_id) / sum(c) OVER (PARTITION BY doc_id) AS base FROM w),
        y AS (SELECT doc_id, token, c, seen, base, 'first' AS side, f AS h FROM x WHERE c >= 5 UNION ALL SELECT doc_id, token, c, seen, base, 'last', l FROM x WHERE c >= 5),
        z AS (SELECT *, round(h / c / base, 1) AS r FROM y WHERE h / c / base >= 2.5)
        SELECT doc_id, side, rk, token, c, round(h / c, 2) AS share, r AS ratio FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, side ORDER BY -round(r * ln(1 + c), 9), seen) AS rk FROM z) WHERE rk <= 8""",
    "numeral_signs": TOKENS + NUMERALS + "SELECT * FROM nums",
    "number_context": TOKENS + NUMERALS + """, nl AS (SELECT doc_id, list(sign) AS l FROM nums GROUP BY doc_id),
        tn AS (SELECT tok.*, coalesce(len(list_filter(string_split(token, ''), lambda s: NOT list_contains(l, s))) = 0, false) AS num FROM tok LEFT JOIN nl USING (doc_id)),
        ctx AS (SELECT *, lead(num) OVER q AS nx, lag(num) OVER q AS pv FROM tn WINDOW q AS (PARTITION BY doc_id, unit_idx ORDER BY pos)),
        tt AS (SELECT doc_id, count(*) FILTER (num) AS nn, count(*) AS n FROM tn GROUP BY doc_id),
        ww AS (SELECT doc_id, token, count(*) AS f, count(*) FILTER (nx) AS before, count(*) FILTER (pv) AS after, min(tok_idx) AS seen FROM ctx WHERE NOT num GROUP BY ALL),
        ss AS (SELECT doc_id, token, f, seen, 'before' AS side, before AS c FROM ww UNION ALL SELECT doc_id, token, f, seen, 'after', after FROM ww),
        ll AS (SELECT ss.*, c / (nn * f / n) AS lift FROM ss JOIN tt USING (doc_id) WHERE c >= 3)
        SELECT doc_id, rk, token, side, c, round(lift, 1) AS lift FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY -c * round(lift, 1), side DESC, seen) AS rk FROM ll WHERE lift >= 3) WHERE rk <= 8""",
    "name_candidates_caseless": TOKENS + """, w AS (SELECT doc_id, token, count(*) AS c, min(tok_idx) AS a, max(tok_idx) AS b FROM tok GROUP BY ALL),
        x AS (SELECT *, sum(c) OVER (PARTITION BY doc_id) AS n, median(len(token)) OVER (PARTITION BY doc_id) AS med FROM w)
        SELECT doc_id, rk, token, c FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, a) AS rk FROM x WHERE c BETWEEN 2 AND 8 AND len(token) >= med AND (b - a) / n <= 0.2) WHERE rk <= 12""",
}
