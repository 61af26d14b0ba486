"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from . import chat, decontamination, html_text, imatch, language, packing, simhash, substring_dedup, token_files, warc

QUERIES = {
    f.__name__: f
    for f in (
        chat.op1_chat_format,
        warc.op2_warc,
        token_files.op3_token_files,
        language.op4_language_id,
        imatch.op5_imatch,
        html_text.op6_html_extract,
        packing.op7_best_fit_packing,
        substring_dedup.op8_substring_dedup,
        simhash.op9_simhash_trie,
        decontamination.op10_winnowing,
    )
}

ORACLE_SQL = {
    # markers around a text: <s> once; user 15, system 13, assistant 7 code points; each
    # control string and backslash in a text gains one
    "op1_chat_format": r"""
        WITH said AS (
            SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        sized AS (
            SELECT *, length(text) + len(regexp_extract_all(text, '\\|</?[sa]>|\[/?(?:INST|SYS|TURN|NONE)\b'))
                + CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 13 WHEN 'assistant' THEN 7 END AS shown
            FROM said)
        SELECT conv_id, count(*)::BIGINT AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
            (3 + sum(shown))::BIGINT AS formatted_chars
        FROM sized GROUP BY conv_id""",
    "op2_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest FROM p),
        t AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS target FROM d)
        SELECT page_id, payload_bytes, payload_digest,
            CASE WHEN payload_bytes >= 1000 AND page_id < target THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN payload_bytes >= 1000 AND page_id < target THEN target END AS refers_to
        FROM t""",
    # crc32 of the id's digits: a step of 256 + byte, then eight shifts; all labelled rows that
    # aren't held out are learned from, as they are where no language has more than LEARN
    "op4_language_id": rf"""
        WITH d AS (
            SELECT doc_id, lang, string_split(' ' || trim(regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}]+', ' ', 'g')) || ' ', '') AS c,
                xor(list_reduce([4294967295] || flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
                    lambda r, x: CASE WHEN x >= 0 THEN xor(r, x) ELSE xor(r >> 1, 3988292384 * (r & 1)) END), 4294967295) % 4 = 2 AS held_out
            FROM documents),
        g AS (
            SELECT doc_id, gram, count(*) AS n FROM (
                SELECT doc_id, unnest(list_filter(c, lambda x: x <> ' ')) AS gram FROM d
                UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(c)), lambda i: c[i] || c[i + 1])) FROM d WHERE len(c) > 2
                UNION ALL SELECT doc_id, unnest(list_transform(list_filter(range(1, len(c) - 1), lambda i: c[i + 1] <> ' '), lambda i: c[i] || c[i + 1] || c[i + 2])) FROM d)
            GROUP BY ALL),
        own AS (SELECT doc_id, gram, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, length(gram), gram) - 1 AS k FROM g QUALIFY k < {language.TOP}),
        sums AS (SELECT lang, gram, sum(n) AS n FROM g JOIN d USING (doc_id) WHERE lang IS NOT NULL AND NOT held_out GROUP BY ALL),
        profile AS (SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY n DESC, length(gram), gram) - 1 AS rank FROM sums QUALIFY rank < {language.TOP}),
        far AS (
            SELECT doc_id, l.lang, count(*) AS size, sum(coalesce(least(abs(rank - k), {language.TOP}), {language.TOP}))::BIGINT AS apart
            FROM own CROSS JOIN (SELECT DISTINCT lang FROM profile) l LEFT JOIN profile p ON p.lang = l.lang AND p.gram = own.gram GROUP BY ALL),
        best AS (SELECT * FROM far QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY apart, lang) = 1)
        SELECT doc_id, held_out, coalesce(best.lang, '{language.UNKNOWN}') AS lang_pred, coalesce(1 - apart::DOUBLE / ({language.TOP} * size), 0) AS score
        FROM d LEFT JOIN best USING (doc_id)""",
    "op10_winnowing": r"""
        WITH dw AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM documents),
        bw AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM benchmark),
        bg AS (
            SELECT DISTINCT item_id, least(8, len(w)) AS size, array_to_string(w[i : i + least(8, len(w)) - 1], ' ') AS gram
            FROM (SELECT item_id, w, unnest(range(1, len(w) - least(8, len(w)) + 2)) AS i FROM bw WHERE len(w) > 0)),
        dg AS (
            SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS gram
            FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i
                  FROM dw, (SELECT DISTINCT size FROM bg) WHERE len(w) >= size)),
        hits AS (SELECT doc_id, i, dg.size, item_id FROM dg JOIN bg ON dg.size = bg.size AND dg.gram = bg.gram),
        words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
            sha256(coalesce(names, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
        FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
}
