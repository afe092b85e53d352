"""The registered queries of this subpackage and their SQL."""

from policylens.llm.decontamination import op10_decontamination
from policylens.llm.language_id import op7_language_id
from policylens.llm.order_minhash import op9_order_minhash
from policylens.llm.packing import op4_best_fit_packing
from policylens.llm.periodic_runs import op13_periodic_runs
from policylens.llm.secret_scan import op12_secret_scan
from policylens.llm.simhash_dedup import op6_simhash_dedup
from policylens.llm.spelling_variants import op11_spelling_variants
from policylens.llm.substring_dedup import op3_substring_dedup
from policylens.llm.suffix_dedup import op2_suffix_dedup
from policylens.llm.token_counts import op5_token_counts
from policylens.llm.toxicity import op8_toxicity
from policylens.llm.url_filter import op1_url_filter

QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_token_counts": op5_token_counts,
    "op6_simhash_dedup": op6_simhash_dedup,
    "op7_language_id": op7_language_id,
    "op8_toxicity": op8_toxicity,
    "op9_order_minhash": op9_order_minhash,
    "op10_decontamination": op10_decontamination,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_secret_scan": op12_secret_scan,
    "op13_periodic_runs": op13_periodic_runs,
}

STATEMENTS = {
    # Bytes as pairs of hex digits, the next 400 as one string, and the strings that start twice.
    "op2_suffix_dedup": """
        WITH spelled AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        blocks AS (
            SELECT doc_id, length(h) // 2 AS size, base, substr(h, 2 * base + 1, 2000) AS part
            FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2, 600)) AS base FROM spelled)),
        strings AS (
            SELECT doc_id, base + i AS place, substr(part, CAST(2 * i + 1 AS BIGINT), 2) AS byte,
                CASE WHEN base + i + 400 <= size THEN md5(substr(part, CAST(2 * i + 1 AS BIGINT), 800)) END AS run
            FROM (SELECT *, unnest(range(0, least(600, size - base))) AS i FROM blocks)),
        repeated AS (SELECT run FROM strings WHERE run IS NOT NULL GROUP BY run HAVING count(*) > 1),
        marked AS (
            SELECT s.doc_id, s.place, s.byte, r.run IS NOT NULL AS starts
            FROM strings s LEFT JOIN repeated r ON s.run = r.run),
        covered AS (
            SELECT doc_id, place, byte, bool_or(starts) OVER (
                PARTITION BY doc_id ORDER BY place ROWS BETWEEN 399 PRECEDING AND CURRENT ROW) AS gone
            FROM marked),
        opened AS (
            SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY place), false) AS opens
            FROM covered),
        counted AS (
            SELECT doc_id, count(*) AS n_bytes, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans,
                coalesce(string_agg(byte, '' ORDER BY place) FILTER (NOT gone), '') AS kept
            FROM opened GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed,
            coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
        FROM documents d LEFT JOIN counted c USING (doc_id)""",
    # Words by place, the next 13 as one string, and the smallest document in which that string starts.
    "op3_substring_dedup": r"""
        WITH listed AS (
            SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
            FROM documents),
        words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS place FROM listed),
        windows AS (
            SELECT doc_id, place, word, count(*) OVER ahead AS n, string_agg(word, ' ') OVER ahead AS run
            FROM words WINDOW ahead AS (PARTITION BY doc_id ORDER BY place ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
        least AS (SELECT run, min(doc_id) AS first_doc FROM windows WHERE n = 13 GROUP BY run),
        marked AS (
            SELECT w.doc_id, w.place, w.word, w.n = 13 AND l.first_doc < w.doc_id AS starts
            FROM windows w LEFT JOIN least l ON w.run = l.run AND w.n = 13),
        covered AS (
            SELECT doc_id, place, word, coalesce(bool_or(starts) OVER (
                PARTITION BY doc_id ORDER BY place ROWS BETWEEN 12 PRECEDING AND CURRENT ROW), false) AS gone
            FROM marked),
        counted AS (
            SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed,
                coalesce(string_agg(word, ' ' ORDER BY place) FILTER (NOT gone), '') AS kept
            FROM covered GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
            sha256(coalesce(kept, '')) AS kept_sha256
        FROM documents d LEFT JOIN counted c USING (doc_id)""",
    # Shingles that documents and items share, the windows of the item's size that hold one, and the best of them.
    # Items have five words or more.
    "op10_decontamination": r"""
        WITH plain AS (
            SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark),
        listed AS (
            SELECT kind, id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
            FROM plain),
        words AS (
            SELECT kind, id, len(ws) AS n, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS place FROM listed),
        windows AS (
            SELECT kind, id, n, place, count(*) OVER ahead AS size, string_agg(word, ' ') OVER ahead AS shingle
            FROM words WINDOW ahead AS (PARTITION BY kind, id ORDER BY place ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
        shingles AS (SELECT kind, id, n, place, shingle FROM windows WHERE size = 5),
        of_items AS (
            SELECT id AS item_id, n AS item_n, shingle, count(*) AS times FROM shingles WHERE kind = 'i' GROUP BY ALL),
        hits AS (
            SELECT d.id AS doc_id, i.item_id, d.n, i.item_n, least(d.n, i.item_n) AS span, d.place
            FROM shingles d JOIN of_items i ON d.shingle = i.shingle WHERE d.kind = 'd'),
        starts AS (
            SELECT DISTINCT doc_id, item_id, item_n, span,
                unnest(range(greatest(0, place - (span - 5)), least(place, n - span) + 1)) AS start_word
            FROM hits),
        held AS (
            SELECT s.doc_id, s.item_id, s.item_n, s.span, s.start_word, d.shingle, count(*) AS times
            FROM starts s JOIN shingles d ON d.kind = 'd' AND d.id = s.doc_id
                AND d.place BETWEEN s.start_word AND s.start_word + s.span - 5
            GROUP BY ALL),
        shared AS (
            SELECT h.doc_id, h.item_id, h.item_n, h.span, h.start_word, CAST(sum(least(h.times, i.times)) AS BIGINT) AS n_both
            FROM held h JOIN of_items i ON h.item_id = i.item_id AND h.shingle = i.shingle GROUP BY ALL),
        likeness AS (
            SELECT *, CAST(n_both AS DOUBLE) / CAST(span - 4 + item_n - 4 - n_both AS DOUBLE) AS similarity FROM shared)
        SELECT doc_id, item_id, start_word, CAST(span AS BIGINT) AS n_words, similarity
        FROM likeness WHERE similarity >= CAST(0.8 AS DOUBLE)
        QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start_word) = 1""",
}
