"""DuckDB SQL of the language, summary and lexicon queries."""

from __future__ import annotations

_WORD = r"[\p{L}\p{M}]+(?:[''’][\p{L}\p{M}]+)?"


def _words(text: str, pattern: str = _WORD) -> str:
    return f"regexp_extract_all(lower(coalesce({text}, '')), '{pattern}')"


def _counts(pattern: str) -> str:
    return f"""(SELECT doc_id, lang, word, count(*) AS c, min(i) AS first FROM (SELECT doc_id, lang, unnest(w) AS word, generate_subscripts(w, 1) AS i
        FROM (SELECT doc_id, lang, {_words('text', pattern)} AS w FROM documents)) GROUP BY ALL)"""


_FREQ = f"""fq AS (SELECT lang, word, c, log10(c / sum(c) OVER (PARTITION BY lang)) + 9 AS zipf FROM
    (SELECT lang, word, count(*) AS c FROM (SELECT lang, unnest({_words('text')}) AS word FROM documents WHERE lang IS NOT NULL) GROUP BY ALL))"""

_LEX = "lx AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY c DESC, word) AS rank FROM fq) WHERE rank <= 30000)"


def _weights(pattern: str) -> str:
    return f"wt AS (SELECT w.doc_id, w.word, w.c, w.first, w.c * greatest(0.0, 7.5 - coalesce(fq.zipf, 0)) AS weight FROM {_counts(pattern)} w LEFT JOIN fq USING (lang, word))"


_SCRIPTS = r"""sc AS (SELECT doc_id, CASE WHEN ch IN ('ª', 'º') THEN CASE ch WHEN 'ª' THEN 'FEMININE' ELSE 'MASCULINE' END WHEN ch = 'µ' THEN 'MICRO' WHEN regexp_matches(ch, '\p{Latin}') THEN 'LATIN' WHEN regexp_matches(ch, '\p{Greek}') THEN 'GREEK'
        WHEN regexp_matches(ch, '\p{Cyrillic}') THEN 'CYRILLIC' WHEN regexp_matches(ch, '\p{Han}') THEN 'CJK UNIFIED' WHEN regexp_matches(ch, '\p{Co}') THEN 'PRIVATE-USE' ELSE 'OTHER' END AS script, count(*) AS letters
    FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), '')) AS ch FROM documents) WHERE regexp_matches(ch, '[\p{L}\p{M}\p{Co}]') GROUP BY ALL),
sp AS (SELECT doc_id, sum(letters) AS letters, max(struct_pack(c := letters, s := script)).s AS dominant_script, coalesce(round(sum(letters) FILTER (script = 'PRIVATE-USE') / sum(letters), 4), 0.0) AS unknown_share FROM sc GROUP BY doc_id)"""

_MODEL = f"""gd AS (SELECT doc_id, lang, gram, count(*) AS c FROM (SELECT doc_id, lang, substr(' ' || w || ' ', CAST(i AS BIGINT), 3) AS gram FROM (SELECT doc_id, lang, w, unnest(generate_series(1, len(w))) AS i
        FROM (SELECT doc_id, lang, unnest({_words('text')}) AS w FROM documents))) GROUP BY ALL),
gl AS (SELECT lang, gram, sum(c) AS c FROM gd WHERE lang IS NOT NULL GROUP BY ALL),
gm AS (SELECT lang, gram, ln((c + 0.5) / 0.5) AS gain, ln(0.5 / (sum(c) OVER (PARTITION BY lang) + 0.5 * (count(*) OVER (PARTITION BY lang) + 1))) AS base FROM gl),
gs AS (SELECT doc_id, gm.lang AS candidate, sum(gd.c * gain) + max(n) * max(base) AS score FROM (SELECT *, sum(c) OVER (PARTITION BY doc_id) AS n FROM gd) gd JOIN gm USING (gram) GROUP BY ALL),
ge AS (SELECT *, exp(score - max(score) OVER (PARTITION BY doc_id)) AS e FROM gs),
ca AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 6) DESC, candidate) AS rk, candidate, round(e / sum(e) OVER (PARTITION BY doc_id), 4) AS confidence FROM ge)"""


def _coverage(lang: str, source: str) -> str:
    return f"""(SELECT doc_id, round(coalesce(sum(q.c) FILTER (zipf > 1.5), 0) / sum(q.c), 4) AS coverage FROM (SELECT w.doc_id, w.word, w.c, {lang} AS lang FROM {_counts(_WORD)} w {source}) q LEFT JOIN fq USING (lang, word) GROUP BY doc_id)"""


ORACLE_SQL = {
    "script_shares": f"WITH {_SCRIPTS} SELECT doc_id, script, letters, round(letters / sum(letters) OVER (PARTITION BY doc_id), 4) AS share FROM sc",
    "script_profile": f"""WITH {_SCRIPTS} SELECT d.doc_id, coalesce(sp.letters, 0) AS letters, dominant_script, coalesce(unknown_share, 0.0) AS unknown_share,
        CASE WHEN sp.letters > 0 AND dominant_script <> 'PRIVATE-USE' THEN 'left-to-right' END AS direction FROM documents d LEFT JOIN sp USING (doc_id)""",
    "reference_lexicon": f"WITH {_FREQ}, {_LEX} SELECT lang, rank, word, c, round(zipf, 4) AS zipf FROM lx",
    "vocab_coverage": f"WITH {_FREQ} SELECT d.doc_id, d.lang, coverage FROM documents d LEFT JOIN {_coverage('w.lang', '')} USING (doc_id)",
    "lexicon_rate": f"""WITH {_FREQ}, {_LEX} SELECT doc_id, sum(c) AS words, round(coalesce(sum(c) FILTER (known), 0) / sum(c), 4) AS hit_rate
        FROM (SELECT w.doc_id, w.c, lx.rank IS NOT NULL AS known FROM {_counts(_WORD)} w LEFT JOIN lx USING (lang, word) WHERE len(w.word) >= 3) GROUP BY doc_id""",
    "language_candidates": f"WITH {_MODEL} SELECT doc_id, rk, candidate, confidence FROM ca WHERE rk <= 3",
    "tier_routing": f"""WITH {_FREQ}, {_SCRIPTS}, {_MODEL}, c1 AS (SELECT doc_id, candidate, confidence FROM ca WHERE rk = 1),
        a AS (SELECT d.doc_id, coalesce(letters, 0) AS letters, coalesce(unknown_share, 0) AS unknown_share, candidate, confidence, coverage FROM documents d LEFT JOIN sp USING (doc_id) LEFT JOIN c1 USING (doc_id)
              LEFT JOIN {_coverage('c1.candidate', 'JOIN c1 USING (doc_id)')} USING (doc_id)),
        r AS (SELECT *, CASE WHEN letters < 20 THEN 'too few letters' WHEN unknown_share > 0.2 THEN 'private or unassigned signs' WHEN candidate IS NULL THEN 'no candidate' WHEN confidence < 0.45 THEN 'low confidence'
              WHEN coverage < 0.5 THEN 'vocabulary not known' WHEN coverage IS NULL THEN 'model only' ELSE 'model and vocabulary agree' END AS reason FROM a)
        SELECT doc_id, CASE WHEN reason IN ('model only', 'model and vocabulary agree') THEN candidate END AS language, confidence, coverage, reason,
        CASE WHEN reason IN ('model only', 'model and vocabulary agree') THEN 1 ELSE 2 END AS tier FROM r""",
    "keywords": f"""WITH {_FREQ}, {_weights(r'[\p{L}\p{M}]{3,}')}, k AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS types FROM wt)
        SELECT doc_id, rk, word, c, round(weight, 3) AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 6) DESC, first) AS rk FROM k WHERE c >= 2 OR types < 50) WHERE rk <= 12""",
    "extractive_summary": f"""WITH {_FREQ}, {_weights(r'[\p{L}\p{M}]{2,}')},
        p AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(coalesce(text, ''), '([.!?।॥。！？؟])\\s+', '\\1' || chr(1), 'g'), '\\n{{2,}}', chr(1), 'g'), chr(1)) AS parts FROM documents),
        q AS (SELECT doc_id, list_filter(list_transform(parts, lambda s: trim(regexp_replace(s, '\\s+', ' ', 'g'))), lambda s: len(s) > 15 AND len(s) < 600) AS ss FROM p),
        s AS (SELECT doc_id, unnest(ss) AS sentence, generate_subscripts(ss, 1) - 1 AS sentence_idx FROM q),
        u AS (SELECT doc_id, sentence_idx, unnest({_words('sentence', r'[\p{L}\p{M}]{2,}')}) AS word FROM s),
        v AS (SELECT u.doc_id AS doc_id, u.sentence_idx AS sentence_idx, sum(weight) / max(top) / sqrt(count(*)) * any_value(CASE WHEN u.sentence_idx = 0 THEN 1.2 ELSE 1.0 END) AS score FROM u JOIN (SELECT *, max(weight) OVER (PARTITION BY doc_id) AS top FROM wt) t USING (doc_id, word) GROUP BY u.doc_id, u.sentence_idx),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 6) DESC, sentence_idx DESC) AS rk FROM v)
        SELECT doc_id, sentence_idx, sentence, round(score, 3) AS score FROM r JOIN s USING (doc_id, sentence_idx) WHERE rk <= 5""",
}
