"""Named queries of the operators over the given tables, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from berthline.llm import (
    byte_cnn, content_sort, decontaminate, fair_queue, fuzzy_lines, interleave, merkle_witness, multi_index_hash, pii_bootstrap, qd_whitening,
    quality_gam, super_minhash, url_filter,
)
from corpus_pipeline import ORACLE_SQL, run


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op3_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort.exact_duplicates(_table(spark, sf_dir, "documents"))


def op4_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleave.shard_slots(_table(spark, sf_dir, "documents"))


def op5_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_lines.fuzzy_lines(_table(spark, sf_dir, "documents"))


def op6_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gam.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_cnn.identify(_table(spark, sf_dir, "documents"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return super_minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_bootstrap.personal_data(_table(spark, sf_dir, "documents"))


def op10_fair_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fair_queue.mix(_table(spark, sf_dir, "documents"))


def op11_qd_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qd_whitening.whitening_report(_table(spark, sf_dir, "embeddings"))


def op12_merkle_witness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_witness.audit(_table(spark, sf_dir, "documents"))


def op13_multi_index_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index_hash.nearest_of_every_20th(_table(spark, sf_dir, "embeddings"))


LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_decontaminate": op2_decontaminate,
    "op3_content_sort": op3_content_sort,
    "op4_interleave": op4_interleave,
    "op5_fuzzy_lines": op5_fuzzy_lines,
    "op6_quality_gam": op6_quality_gam,
    "op7_byte_cnn": op7_byte_cnn,
    "op8_near_dedup": op8_near_dedup,
    "op9_personal_data": op9_personal_data,
    "op10_fair_queue": op10_fair_queue,
    "op11_qd_whitening": op11_qd_whitening,
    "op12_merkle_witness": op12_merkle_witness,
    "op13_multi_index_hash": op13_multi_index_hash,
    "pipeline": run,
}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

LLM_ORACLES: dict[str, str] = {
    "op2_decontaminate": rf"""
        WITH items AS (
            SELECT item_id::VARCHAR AS id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        windows AS (
            SELECT DISTINCT id, size, array_to_string(w[i : i + size - 1], ' ') AS win
            FROM (SELECT id, w, least(len(w), 10) AS size, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM items WHERE len(w) > 0) x),
        docs AS (
            SELECT row_number() OVER () AS r, doc_id,
                   coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
        places AS (
            SELECT r, size, i, array_to_string(w[i : i + size - 1], ' ') AS win
            FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs, (SELECT DISTINCT size FROM windows) s WHERE len(w) >= size) x),
        met AS (SELECT r, p.size, i, win FROM places p WHERE EXISTS (SELECT 1 FROM windows v WHERE v.win = p.win AND v.size = p.size)),
        hits AS (SELECT r, count(DISTINCT at_word) AS n FROM (SELECT r, unnest(range(i, i + size)) AS at_word FROM met) x GROUP BY r),
        own AS (
            SELECT r, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids
            FROM (SELECT DISTINCT r, id FROM met JOIN windows USING (win, size) WHERE id IS NOT NULL) x GROUP BY r)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(o.n, 0) AS n_items,
               sha256(coalesce(o.ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
        FROM docs d LEFT JOIN hits h USING (r) LEFT JOIN own o USING (r)""",
    "op8_near_dedup": rf"""
        WITH RECURSIVE docs AS (
            SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
        shingles AS (
            SELECT DISTINCT r, array_to_string(w[i : i + 4], ' ') AS s
            FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM docs WHERE len(w) > 0) x),
        sizes AS (SELECT r, count(*) AS n FROM shingles GROUP BY r),
        shared AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.r <> b.r GROUP BY a.r, b.r),
        links AS (SELECT x, y FROM shared JOIN sizes a ON a.r = x JOIN sizes b ON b.r = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
        reach(x, y) AS (SELECT r, r FROM docs UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y),
        least_id AS (SELECT reach.x AS r, min(doc_id) AS component_id FROM reach JOIN docs ON docs.r = reach.y GROUP BY reach.x)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
        FROM docs JOIN least_id USING (r) LEFT JOIN sizes USING (r)""",
    "op3_content_sort": r"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS t,
                   regexp_replace(coalesce(text, ''), '[\x09-\x0D\x20]', '', 'g') AS norm
            FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
               row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY norm ORDER BY length(t) DESC, doc_id ASC NULLS LAST)""",
    "op12_merkle_witness": r"""
        WITH RECURSIVE
        fields AS (
            SELECT *, [doc_id::VARCHAR, source, lang, n_chars::VARCHAR, text] AS f,
                   [doc_id::VARCHAR, source, lang, (n_chars + 1)::VARCHAR, text] AS g,
                   list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
                       lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
                           lambda x, bit: xor(x >> 1, (x & 1) * 3988292384))) AS crc
            FROM documents),
        leaves AS (
            SELECT doc_id, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
                   sha256(array_to_string(list_transform(f, lambda v: coalesce(strlen(v) || ':' || v, '-')), '')) AS leaf,
                   CASE WHEN xor(crc, 4294967295) % 7 = 0 AND n_chars IS NOT NULL
                        THEN sha256(array_to_string(list_transform(g, lambda v: coalesce(strlen(v) || ':' || v, '-')), '')) END AS changed
            FROM fields),
        placed AS (
            SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
                   count(*) OVER (PARTITION BY tree) AS n, row_number() OVER () AS r
            FROM leaves),
        nodes(tree, k, pos, h, n) AS (
            SELECT tree, 0, pos, leaf, n FROM placed
            UNION ALL
            SELECT tree, k + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2
            FROM nodes WHERE n > 1 GROUP BY tree, k, pos // 2, n),
        subroots AS (SELECT tree, h, k AS height, count(*) OVER () AS trees FROM nodes WHERE n = 1),
        tops(k, pos, h, n) AS (
            SELECT 0, tree, h, trees FROM subroots
            UNION ALL
            SELECT k + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2
            FROM tops WHERE n > 1 GROUP BY k, pos // 2, n),
        path(r, k, pos, tree, height, h, proof) AS (
            SELECT r, 0, pos, p.tree, s.height, coalesce(changed, leaf), '' FROM placed p JOIN subroots s ON p.tree = s.tree
            UNION ALL
            SELECT r, p.k + 1, p.pos // 2, p.tree, height,
                   sha256(CASE WHEN p.pos % 2 = 1 THEN s.h || p.h ELSE p.h || coalesce(s.h, '') END), proof || coalesce(s.h, '')
            FROM path p LEFT JOIN nodes s ON s.tree = p.tree AND s.k = p.k AND s.pos = xor(p.pos, 1)
            WHERE p.k < height),
        climb(r, k, pos, h, proof) AS (
            SELECT r, 0, tree, h, proof FROM path WHERE k = height
            UNION ALL
            SELECT r, p.k + 1, p.pos // 2,
                   sha256(CASE WHEN p.pos % 2 = 1 THEN s.h || p.h ELSE p.h || coalesce(s.h, '') END), proof || coalesce(s.h, '')
            FROM climb p LEFT JOIN tops s ON s.k = p.k AND s.pos = xor(p.pos, 1)
            WHERE p.k < (SELECT max(k) FROM tops)),
        top AS (SELECT k, h FROM tops WHERE n = 1)
        SELECT doc_id, leaf, s.h AS subroot, top.h AS root, sha256(c.proof) AS proof_sha256, c.h AS folded_root,
               c.h = top.h AS verified
        FROM placed p JOIN subroots s ON p.tree = s.tree JOIN climb c ON c.r = p.r JOIN top ON c.k = top.k""",
    **({"pipeline": ORACLE_SQL} if ORACLE_SQL else {}),
}
