"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ann import op5
from .decontam import op10
from .hmm import op8
from .langid import op7
from .lexical import op12
from .licenses import op9
from .mixing import op11
from .negatives import op13
from .packing import op1
from .simhash import op4
from .token_counts import op3
from .token_orc import op6
from .warc import op2

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1,
    "op2_warc": op2,
    "op3_token_counts": op3,
    "op4_simhash": op4,
    "op5_multiprobe_ann": op5,
    "op6_token_orc": op6,
    "op7_langid": op7,
    "op8_hmm": op8,
    "op9_licenses": op9,
    "op10_decontamination": op10,
    "op11_mixing": op11,
    "op12_lexical_search": op12,
    "op13_hard_negatives": op13,
}

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL: dict[str, str] = {
    "op10_decontamination": f"""
        WITH d AS (SELECT doc_id, {WORDS} AS ws FROM documents), b AS (SELECT item_id, ws, least(10, len(ws)) AS k FROM (SELECT item_id, {WORDS} AS ws FROM benchmark) WHERE len(ws) > 0),
        iw AS (SELECT DISTINCT item_id, k, array_to_string(ws[i:i + k - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(ws) - k + 2)) AS i FROM b)),
        dw AS (SELECT doc_id, i, k, array_to_string(ws[i:i + k - 1], ' ') AS win FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM b) WHERE len(ws) >= k)),
        hit AS (SELECT doc_id, i, dw.k, item_id FROM dw JOIN iw ON dw.k = iw.k AND dw.win = iw.win),
        n AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS place FROM hit) GROUP BY doc_id),
        t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
        SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id""",
    "op12_lexical_search": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, ts, len(ts)::BIGINT AS size FROM (SELECT doc_id, {WORDS} AS ts FROM documents) WHERE len(ts) > 0),
        z AS (SELECT count(*) AS docs, sum(size)::BIGINT AS terms FROM d), i AS (SELECT DISTINCT item_id, unnest({WORDS}) AS term FROM benchmark),
        tf AS (SELECT r, doc_id, size, term, count(*) AS tf FROM (SELECT r, doc_id, size, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY ALL),
        w AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, z GROUP BY term, docs),
        s AS (SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * size * docs) // terms))))::BIGINT AS score FROM tf JOIN w USING (term) JOIN i USING (term), z GROUP BY ALL)
        SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 50""",
    "op13_hard_negatives": """
        WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
        s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::BIGINT AS score
            FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
        p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3""",
    "op2_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
        last AS (SELECT html, max(page_id) AS last FROM p WHERE n >= 1000 GROUP BY html)
        SELECT p.page_id, p.n::BIGINT AS payload_bytes, sha1(p.html) AS payload_digest,
               CASE WHEN p.page_id < last.last THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN p.page_id < last.last THEN last.last END AS refers_to
        FROM p LEFT JOIN last ON p.html = last.html AND p.n >= 1000""",
}
