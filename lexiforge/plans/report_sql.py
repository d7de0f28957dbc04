"""DuckDB SQL of the steps that a report proposes and of counts of claims."""

from __future__ import annotations

from lexiforge.plans import findings_sql, oracles

ORACLE_SQL = {
    "next_steps": f"""WITH ws AS ({oracles.ORACLE_SQL['word_statistics']}), si AS ({oracles.ORACLE_SQL['sign_inventory']}), nc AS ({oracles.ORACLE_SQL['number_context']}), fw AS ({findings_sql.ORACLE_SQL['function_words']}),
        st AS (SELECT ws.doc_id, list_filter([CASE WHEN tokens < 1500 THEN 'add text: ' || CAST(tokens AS BIGINT) || ' words are few, the figures settle from some thousand on' END, 'add related texts, above all a bilingual one',
            'add pictures, the material and the place where it was found', 'test what is counted: gloss ' || nc.token || ' = THING near numbers', 'test a function word: role ' || fw.token || ' function_word',
            CASE WHEN distinct_signs > 45 THEN 'test part of a syllabary by a command of sign values' END], lambda x: x IS NOT NULL) AS l
            FROM ws JOIN si USING (doc_id) LEFT JOIN (SELECT doc_id, token FROM nc WHERE rk = 1) nc USING (doc_id) LEFT JOIN (SELECT doc_id, token FROM fw WHERE rk = 1) fw USING (doc_id))
        SELECT doc_id, CAST(generate_subscripts(l, 1) AS INTEGER) AS nth, unnest(l) AS step FROM st""",
}
