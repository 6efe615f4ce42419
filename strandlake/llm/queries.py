"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandlake.llm import avi_mjpeg, collocations, decontam, fim, kneser_ney, langid, packing, quality, rp_forest, secrets, simhash_vp, suffix_levels, warc_chunks
from strandlake.session import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.score(table(spark, sf_dir, "documents"))


def op5_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_chunks.round_trip(table(spark, sf_dir, "pages"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_levels.dedup(table(spark, sf_dir, "documents"))


def op8_avi_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return avi_mjpeg.digests(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_vp.near_duplicates(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp_forest.nearest(table(spark, sf_dir, "embeddings"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_id, op2_secret_scan, op3_decontamination, op4_kneser_ney, op5_warc_chunks, op6_quality, op7_suffix_dedup, op8_avi_media, op9_simhash, op10_packing,
        op11_collocations, op12_nearest_neighbours, op13_fill_in_middle,
    )
}

_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

ORACLE_SQL: dict[str, str] = {
    "op3_decontamination": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        bi AS (SELECT item_id, least(10, len(w)) AS n, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM b),
        bl AS (SELECT item_id, n, list(word) OVER (PARTITION BY item_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS l FROM bi),
        bw AS (SELECT DISTINCT item_id, n, array_to_string(l[1:n], ' ') AS win FROM bl WHERE len(l) >= n),
        di AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
        dl AS (SELECT doc_id, i, list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS l FROM di),
        dw AS (SELECT doc_id, i, n, array_to_string(l[1:n], ' ') AS win FROM dl, (SELECT DISTINCT n FROM bw) WHERE len(l) >= n),
        h AS (SELECT doc_id, i, dw.n AS n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
        c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
        t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM h) GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op5_warc_chunks": """
        WITH d AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
        FROM d LEFT JOIN f USING (payload_digest)""",
    "op11_collocations": r"""
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^.,;:!?\n\x0B\f\r]+')) AS piece FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM p),
        t AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
        g AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 6) AS r(k))),
        f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
        s AS (SELECT *, string_split(phrase, ' ') AS w FROM f),
        i AS (SELECT DISTINCT lang, array_to_string(w[x : x + y - 1], ' ') AS phrase, a FROM (SELECT lang, w, k, a, y, unnest(range(1, k - y + 2)) AS x FROM s, range(2, 5) AS q(y) WHERE y < k)),
        c AS (SELECT s.* FROM s ANTI JOIN i ON s.lang = i.lang AND s.phrase = i.phrase AND i.a >= s.a WHERE k > 1),
        u AS (SELECT lang, phrase, w, a, k, unnest(range(1, k)) AS cut FROM c),
        v AS (SELECT u.lang, u.phrase, u.a, cut, x.a AS l, y.a AS r, n, ((1000::HUGEINT * u.a * n) // (x.a::HUGEINT * y.a))::BIGINT AS score
          FROM u JOIN t ON t.lang = u.lang JOIN f x ON x.lang = u.lang AND x.phrase = array_to_string(w[1:cut], ' ') JOIN f y ON y.lang = u.lang AND y.phrase = array_to_string(w[cut + 1 : u.k], ' ')),
        b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM b QUALIFY rank <= 2000""",
    "op13_fill_in_middle": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS w FROM documents),
        x AS (SELECT *, len(w) AS n, ('0x' || h[1:8])::UBIGINT::BIGINT AS h1, ('0x' || h[9:16])::UBIGINT::BIGINT AS h2, ('0x' || h[25:32])::UBIGINT::BIGINT AS h4 FROM d),
        c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM x),
        p AS (SELECT *, array_to_string(w[1:lo], '') AS a, array_to_string(w[lo + 1 : hi], '') AS b, array_to_string(w[hi + 1 : n], '') AS z FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
          sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || z || '<P>' || a || '<M>' || b ELSE '<P>' || a || '<S>' || z || '<M>' || b END) AS output_sha256, sha256(text) AS restored_sha256 FROM p""",
}
