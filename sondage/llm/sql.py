"""The same results in DuckDB's SQL, where SQL can say them."""

from .encodings import QUOTED

_CURRENT = """
    SELECT term, doc_id, tf FROM (
        SELECT lower(trim(term, chr(32) || chr(9))) AS term, doc_id, tf,
               row_number() OVER (PARTITION BY lower(trim(term, chr(32) || chr(9))), doc_id ORDER BY coalesce(seq, -9223372036854775808) DESC, tf DESC) AS rn
        FROM postings WHERE term IS NOT NULL AND trim(term, chr(32) || chr(9)) <> '' AND tf IS NOT NULL AND doc_id IS NOT NULL)
    WHERE rn = 1 AND tf > 0"""

_FREQUENCIES = f"""
    SELECT term, CAST(sum(tf) AS BIGINT) AS occurrences, count(*) AS records,
           CASE WHEN count(*) < 3 THEN 'rare' WHEN count(*) > 0.25 * (SELECT count(DISTINCT doc_id) FROM dated_docs) THEN 'common' END AS mark
    FROM ({_CURRENT}) GROUP BY term"""

_SCORED = f"""
    WITH c AS ({_CURRENT}), n AS (SELECT greatest(count(DISTINCT doc_id), 1) AS n FROM dated_docs), total AS (SELECT sum(tf) AS t FROM c),
    byterm AS (SELECT term, count(*) AS df, sum(tf) AS tt FROM c GROUP BY term),
    w AS (SELECT c.*, df, tt, (1 + ln(tf)) * (ln((n.n + 1) / (df + 1)) + 1) AS weight FROM c JOIN byterm USING (term), n),
    byrec AS (SELECT doc_id, count(*) AS terms, sum(tf) AS n, sqrt(sum(weight * weight)) AS norm FROM w GROUP BY doc_id),
    x AS (SELECT w.*, terms, norm, CAST(tf AS DOUBLE) AS y, CAST(byrec.n AS DOUBLE) AS nn, CAST(tt - tf AS DOUBLE) AS r, CAST(t - byrec.n AS DOUBLE) AS m, 1000.0 * tt / t AS a
          FROM w JOIN byrec USING (doc_id), total),
    o AS (SELECT *, ln((y + a) / (nn + 1000.0 - y - a)) - ln((r + a) / (m + 1000.0 - r - a)) AS log_odds FROM x)
    SELECT *, log_odds / sqrt(1 / (y + a) + 1 / (r + a)) AS z FROM o"""

_CHAMPIONS = f"""
    SELECT term, doc_id, tf, CAST(rank AS INTEGER) AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY term ORDER BY tf DESC, doc_id) AS rank FROM ({_CURRENT})) WHERE rank <= 8"""

_NEAREST = """
    WITH v AS (SELECT DISTINCT point_id, coords FROM points WHERE coords IS NOT NULL AND len(coords) = 16
               AND len(list_filter(coords, lambda x: x IS NOT NULL AND isfinite(x))) = 16),
    ranked AS (SELECT a.point_id AS a, b.point_id AS b, list_distance(a.coords, b.coords) AS dist,
                      row_number() OVER (PARTITION BY a.point_id ORDER BY list_distance(a.coords, b.coords), b.point_id) AS rn
               FROM v a JOIN v b ON a.point_id <> b.point_id)
    SELECT * FROM ranked WHERE rn <= 5"""

_QUOTED_WORD = QUOTED.replace("'", "''")

ORACLES = {
    "p1_found": f"SELECT term, mark FROM ({_FREQUENCIES}) WHERE mark IS NOT NULL",
    "p1_terms": _FREQUENCIES,
    "p3_found": f"SELECT doc_id, term FROM ({_SCORED}) WHERE terms >= 4 AND weight >= 0.9 * norm",
    "p3_distinctive": f"SELECT doc_id, term, tf, df, round(weight, 6) AS weight, round(norm, 6) AS norm, round(log_odds, 6) AS log_odds, round(z, 6) AS z FROM ({_SCORED})",
    "p4_found": f"SELECT term, doc_id FROM ({_CHAMPIONS})",
    "p4_champions": _CHAMPIONS,
    "p5_found": f"SELECT DISTINCT least(a, b) AS point_id_a, greatest(a, b) AS point_id_b FROM ({_NEAREST}) WHERE dist <= 1.0",
    "p5_neighbours": f"SELECT a AS point_id, b AS neighbour, CAST(rn AS INTEGER) AS rank, round(dist, 6) AS distance FROM ({_NEAREST})",
    "p6_coverage": """SELECT doc_id, n AS n_tokens, greatest(CAST(ceil(n / 512.0) AS BIGINT), 1) AS pieces, true AS whole, true AS fits
        FROM (SELECT doc_id, CAST(coalesce(len(regexp_extract_all(text, '[0-9A-Za-zА-Яа-яЁё_-]+')), 0) AS BIGINT) AS n FROM documents)""",
    "p6_found": "SELECT doc_id FROM documents WHERE len(regexp_extract_all(text, '[0-9A-Za-zА-Яа-яЁё_-]+')) > 512",
    "p7_verbatim": "SELECT doc_id, item_id FROM documents JOIN eval_items ON contains(text, passage) WHERE len(regexp_extract_all(passage, '[^ ]+')) >= 12",
    "p8_replaced": f"""SELECT doc_id FROM documents WHERE contains(text, chr(65533))
        AND len(list_filter(regexp_split_to_array(text, '[ \\n\\r\\t]+'), lambda w: contains(w, chr(65533)) AND NOT regexp_matches(w, '{_QUOTED_WORD}'))) > 0""",
}
