"""The operators' queries in SQL, where SQL can express them."""

from __future__ import annotations

# Fixed values of the contracts, written anew and not taken from the operators.
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_ASCII_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(text: str) -> str:
    lowered = _ASCII_LOWER.format(f"coalesce({text}, '')")
    return f"regexp_extract_all({lowered}, '{_WORD}')"


# Words of operators 9 and 10.
_PLAIN = r"[^\x20\x09-\x0D]+"
# Limits of operator 10: window length and largest share; the share of repeated lines.
_WINDOWS = {5: 0.45, 6: 0.44, 7: 0.43, 8: 0.42, 9: 0.41, 10: 0.40}
_LINES = 0.45

# Operator 11: crc32 of a text of ASCII, bit by bit; edits of a row from one state to another.
_CRC = """xor(list_reduce(flatten(list_transform(string_split({0}, ''), lambda c: list_transform(range(8), lambda b: (ascii(c) >> b) & 1))),
    lambda x, b: xor(x >> 1, (xor(x, b) & 1) * 3988292384), 4294967295), 4294967295)"""
_GAP = r"[^\x20\x09-\x0D]"


def _clusters(rounds: int) -> str:
    """Operator 12: assignments ``a0`` and on, and the centroids that follow from each."""
    parts = []
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS (
            SELECT row, x, min({{'d': CAST(list_sum(list_transform(list_zip(x, y), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT), 'c': c}}) AS best
            FROM kept, c{r} GROUP BY row, x)""")
        parts.append(f"""c{r + 1} AS (
            SELECT c, coalesce(m.y, o.y) AS y FROM c{r} o LEFT JOIN (
                SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY j) AS y FROM (
                    SELECT best.c AS c, j, sum(x[j]) AS s, count(*) AS n FROM a{r}, range(1, 65) t(j) GROUP BY ALL) GROUP BY c) m USING (c))""")
    return ", ".join(parts)


ORACLE = {
    "op11_conversation_repair": f"""
        WITH RECURSIVE source AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   {_CRC.format("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS code FROM conversations),
        damaged AS (
            SELECT conv_id, turn, CASE code WHEN 4 THEN 'user' ELSE role END AS role,
                   CASE code WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
            FROM source, range(2) c(n) WHERE code <> 0 AND (n = 0 OR code = 3)),
        placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k, role[1] AS i FROM damaged),
        judged AS (
            SELECT *, CASE WHEN NOT regexp_matches(text, '{_GAP}') THEN 'blank'
                WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'duplicate'
                WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
                lag(i) OVER (PARTITION BY conv_id ORDER BY k) AS i_before FROM placed),
        inserted(s, m, letters, said) AS (VALUES
            ('0', '0', '', []), ('0', 'u', 'I', ['user:']), ('0', 'a', 'II', ['user:', 'assistant:']),
            ('s', 's', '', []), ('s', 'u', 'I', ['user:']), ('s', 'a', 'II', ['user:', 'assistant:']),
            ('u', 'u', '', []), ('u', 'a', 'I', ['assistant:']), ('a', 'a', '', []), ('a', 'u', 'I', ['user:'])),
        follows(m, t) AS (VALUES ('0', 's'), ('0', 'u'), ('s', 'u'), ('u', 'a'), ('a', 'u')),
        options AS (
            SELECT m AS m, 'D' AS letter, m AS t FROM (SELECT DISTINCT m FROM inserted)
            UNION ALL SELECT m, 'K', t FROM follows UNION ALL SELECT m, 'R', t FROM follows WHERE t <> 's'),
        moves AS (SELECT s, letters, said, letter, t FROM inserted JOIN options USING (m)),
        walked AS (
            SELECT conv_id, 0::BIGINT AS k, '0' AS s, {{'cost': 0, 'audit': '', 'said': []::VARCHAR[]}} AS best FROM (SELECT DISTINCT conv_id FROM placed)
            UNION ALL
            SELECT w.conv_id, w.k + 1, v.t, min({{
                'cost': best.cost + 2 * length(letters) + CASE letter WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END + CASE WHEN letter <> 'D' AND fault = 'truncated' THEN 1 ELSE 0 END,
                'audit': best.audit || letters || letter,
                'said': best.said || v.said || CASE letter WHEN 'D' THEN []::VARCHAR[] WHEN 'K' THEN [role || ':' || text]
                    ELSE [CASE v.t WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text] END}})
            FROM walked w JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.k = w.k + 1
            JOIN moves v ON v.s = w.s AND (letter = 'D' OR fault NOT IN ('blank', 'duplicate')) AND (letter <> 'K' OR v.t = i)
            GROUP BY w.conv_id, w.k, v.t),
        closing(s, more, letters, said) AS (VALUES ('0', 0, '', []), ('a', 0, '', []), ('u', 2, 'I', ['assistant:']), ('s', 4, 'II', ['user:', 'assistant:'])),
        ended AS (
            SELECT w.conv_id, min({{'cost': best.cost + more, 'audit': best.audit || letters, 'said': best.said || c.said}}) AS best
            FROM walked w JOIN closing c USING (s) JOIN (SELECT conv_id, max(k) AS k FROM placed GROUP BY conv_id) n
                ON n.conv_id IS NOT DISTINCT FROM w.conv_id AND n.k = w.k GROUP BY w.conv_id),
        counted AS (
            SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
                   count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
                   count(*) FILTER (i_before || i NOT IN ('su', 'ua', 'au')) AS illegal
            FROM judged GROUP BY conv_id)
        SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
               coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0)::BIGINT AS cost,
               coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.said, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o
        LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id""",
    "op12_centroid_clusters": f"""
        WITH kept AS (
            SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda v: CAST(floor(64 * CAST(v AS DOUBLE)) AS BIGINT)) AS x
            FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = 64),
        c0 AS (
            SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(vec_id::VARCHAR, '')), x) - 1 AS c, x AS y
            FROM kept QUALIFY c < 16),
        {_clusters(3)},
        found AS (SELECT vec_id, best.c AS cluster, best.d AS distance FROM a3 JOIN kept USING (row)),
        sums AS (SELECT cluster, sum(distance)::BIGINT AS cluster_inertia FROM found GROUP BY cluster)
        SELECT vec_id, cluster::INT AS cluster, distance, cluster_inertia, (SELECT sum(distance)::BIGINT FROM found) AS inertia,
               sha256(array_to_string(y, ',')) AS centroid_sha256
        FROM found JOIN sums USING (cluster) JOIN c3 ON c = cluster""",
    "op13_near_vectors": """
        WITH RECURSIVE vectors AS (
            SELECT row_number() OVER () AS row, vec_id, CASE
                WHEN len(e) > 0 AND len(list_filter(e, lambda v: v IS NOT NULL AND isfinite(v))) = len(e) AND list_dot_product(e, e) > 0 THEN e END AS e
            FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)),
        links AS (
            SELECT a.row AS a, b.row AS b FROM vectors a JOIN vectors b ON a.row <> b.row AND len(a.e) = len(b.e)
            WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
        reached AS (
            SELECT row, row AS other FROM vectors
            UNION SELECT r.row, l.b FROM reached r JOIN links l ON l.a = r.other),
        least AS (SELECT r.row, min(v.vec_id) AS component_id FROM reached r JOIN vectors v ON v.row = r.other GROUP BY r.row),
        counts AS (SELECT a AS row, count(*) AS n FROM links GROUP BY a)
        SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
        FROM vectors JOIN least USING (row) LEFT JOIN counts USING (row)""",
    "op9_near_duplicates": f"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all({_ASCII_LOWER.format("coalesce(text, '')")}, '{_PLAIN}') AS w FROM documents),
        shingles AS (
            SELECT DISTINCT doc_id, array_to_string(list_slice(w, k, k + 2), ' ') AS x
            FROM words, unnest(range(1, greatest(len(w) - 1, 2))) AS t(k) WHERE len(w) > 0),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b USING (x) GROUP BY ALL),
        links AS (
            SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
            WHERE a <> b AND 100 * k >= 90 * (p.n + q.n - k)),
        reached AS (
            SELECT doc_id, doc_id AS other FROM documents
            UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.other)
        SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id
        FROM reached LEFT JOIN sizes USING (doc_id) GROUP BY doc_id""",
    "op10_quality_rules": f"""
        WITH lists AS (SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '{_PLAIN}') AS w FROM documents),
        words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM lists),
        totals AS (SELECT doc_id, count(*) AS n_words, sum(length(word))::BIGINT AS word_chars FROM words GROUP BY doc_id),
        followed AS (
            SELECT doc_id, k, word AS l0, {", ".join(f"lead(word, {k}) OVER o AS l{k}" for k in range(1, 10))}
            FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
        windows AS ({" UNION ALL ".join(
            f"SELECT doc_id, {size} AS size, k, concat_ws(' ', {', '.join(f'l{k}' for k in range(size))}) AS win FROM followed WHERE l{size - 1} IS NOT NULL"
            for size in (3, *_WINDOWS))}),
        known AS (SELECT doc_id, size, win FROM windows GROUP BY ALL HAVING count(*) > 1),
        inside AS (SELECT DISTINCT doc_id, size, unnest(range(k, k + size)) AS k FROM windows JOIN known USING (doc_id, size, win)),
        parts AS (
            SELECT doc_id, size, count(*) AS n, sum(length(word)) / any_value(word_chars) AS share
            FROM inside JOIN words USING (doc_id, k) JOIN totals USING (doc_id) GROUP BY doc_id, size),
        repeats AS (
            SELECT doc_id, max(n) FILTER (size = 3) AS n, max(share) FILTER (size > 3) AS share,
                   bool_or({" OR ".join(f"size = {k} AND share > {v}" for k, v in _WINDOWS.items())}) AS bad
            FROM parts GROUP BY doc_id),
        lines AS (
            SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line) AS place
            FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM lists) WHERE regexp_matches(line, '{_PLAIN}')),
        again AS (
            SELECT doc_id, count(*) AS n, sum(length(array_to_string(regexp_extract_all(line, '{_PLAIN}'), ''))) AS chars
            FROM lines WHERE place > 1 GROUP BY doc_id),
        counted AS (
            SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
                   len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(again.n, 0) AS n_dup_lines,
                   coalesce(repeats.n, 0) AS n_repeat_words, coalesce(repeats.share, 0.0) AS window_share,
                   coalesce(again.chars / word_chars, 0.0) AS line_share, coalesce(bad, false) AS bad
            FROM lists LEFT JOIN totals USING (doc_id) LEFT JOIN again USING (doc_id) LEFT JOIN repeats USING (doc_id)),
        judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, window_share, line_share, base_failed,
               NOT base_failed AND NOT bad AND line_share <= {_LINES} AS kept
        FROM judged""",
    "op6_decontamination": f"""
        WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_words("text")} AS w FROM benchmark),
        windows AS (
            SELECT DISTINCT item, array_to_string(list_slice(w, k, k + 12), ' ') AS win, least(len(w), 13) AS size
            FROM items, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS t(k) WHERE len(w) > 0),
        words AS (SELECT doc_id, {_words("text")} AS w FROM documents),
        sizes AS (SELECT DISTINCT size FROM windows),
        hits AS (
            SELECT doc_id, k, p.size, item
            FROM (SELECT doc_id, k, size, array_to_string(list_slice(w, k, k + size - 1), ' ') AS win
                  FROM words, sizes, unnest(range(1, greatest(len(w) - size + 2, 1))) AS t(k)) p
            JOIN windows USING (win, size)),
        hit_words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM hits, unnest(range(k, k + size)) AS t(j) GROUP BY doc_id),
        named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
                  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM words LEFT JOIN hit_words USING (doc_id) LEFT JOIN named USING (doc_id)""",
}
