"""The queries of this subpackage over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscan.llm import decontam, lexical, mixing, packing, periodic, quality, secret_scan, simhash, suffix_dedup, surrogates, token_file, topk, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = warc.write_archive(_table(spark, sf_dir, "pages"))
    return warc.read_archive(spark, where)


QUERIES["op1_warc_archive"] = op1_warc_archive
SQL["op1_warc_archive"] = """
WITH p AS (
  SELECT page_id, url, encode(coalesce(html, '')) AS b, row_number() OVER () AS rec FROM pages
), d AS (
  SELECT page_id, url, rec, octet_length(b) AS n, sha1(b) AS h FROM p
), f AS (
  SELECT *, first_value(page_id) OVER w AS first_page, first_value(rec) OVER w AS first_rec FROM d
  WINDOW w AS (PARTITION BY h ORDER BY page_id NULLS LAST, rec)
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 8), lambda g: translate(lpad(to_base(CAST('0x' || substr(h, 5 * g + 1, 5) AS BIGINT), 32), 4, '0'),
    '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')), '') AS payload_digest,
  CASE WHEN rec <> first_rec THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN rec <> first_rec THEN first_page END AS refers_to, url AS target_uri
FROM f
"""


def op2_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


QUERIES["op2_entropy_mix"] = op2_entropy_mix


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.whole_vectors(_table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, F.coalesce(F.col("vec_id") % 100 == 0, F.lit(False)))


QUERIES["op6_top_k"] = op6_top_k
SQL["op6_top_k"] = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS rid, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.rid AS q_rid, q.vec_id AS query_id, c.vec_id, c.rid,
    CAST(coalesce(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.rid <> c.rid AND len(q.e) = len(c.e)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY q_rid ORDER BY score DESC, vec_id NULLS LAST, rid) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


QUERIES["op7_simhash"] = op7_simhash


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES["op3_suffix_dedup"] = op3_suffix_dedup


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = token_file.write_files(_table(spark, sf_dir, "documents"), tokenizer_file())
    return token_file.file_index(spark, where)


QUERIES["op10_token_file"] = op10_token_file


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES["op8_quality"] = op8_quality


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_table(spark, sf_dir, "documents"))


QUERIES["op9_secret_scan"] = op9_secret_scan


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES["op4_decontaminate"] = op4_decontaminate
_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"
SQL["op4_decontaminate"] = f"""
WITH i AS (
  SELECT item_id, row_number() OVER () AS iid, {_WORDS} AS l FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)
), g AS (
  SELECT DISTINCT item_id, iid, least(5, len(l)) AS n,
    unnest(list_transform(range(1, len(l) - least(5, len(l)) + 2), lambda k: array_to_string(l[k:k + least(5, len(l)) - 1], ' '))) AS s
  FROM i WHERE len(l) > 0
), q AS (
  SELECT iid, item_id, count(*) AS n_item FROM g GROUP BY iid, item_id
), d AS (
  SELECT doc_id, row_number() OVER () AS rid, {_WORDS} AS l FROM documents WHERE text IS NOT NULL
), e AS (
  SELECT DISTINCT rid, doc_id, n, unnest(list_transform(range(1, len(l) - n + 2), lambda k: array_to_string(l[k:k + n - 1], ' '))) AS s
  FROM d, (SELECT DISTINCT n FROM g)
), m AS (
  SELECT e.rid, e.doc_id, g.iid, count(*) AS n_shared FROM e JOIN g USING (n, s) GROUP BY e.rid, e.doc_id, g.iid
)
SELECT doc_id, item_id, CAST(n_shared AS BIGINT) AS n_shared, CAST(n_item AS BIGINT) AS n_item, n_shared / n_item AS containment
FROM m JOIN q USING (iid) WHERE n_shared >= 0.8 * n_item - 1e-9
"""


def op5_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace_entities(_table(spark, sf_dir, "documents"))


QUERIES["op5_surrogates"] = op5_surrogates


def op13_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"), tokenizer_file())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES["op13_pack"] = op13_pack


def periodic_suffix(doc_id: int | None, n: int) -> np.ndarray | None:
    """The words that op12 reads in place of a document's own: one in ten documents repeats a stretch from some word on."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return None
    begin = h // 10 % n
    period = 1 + (n - begin) // (3 + h // 10 % 8)
    place = np.arange(n)
    return np.where(place < begin, place, begin + (place - begin) % period)


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.collapse_runs(_table(spark, sf_dir, "documents"), periodic_suffix)
    line = "concat(array_join(transform(runs, r -> concat_ws(',', r.start, r.length, r.period)), '\\n'), if(size(runs) > 0, '\\n', ''))"
    # Exact ratios: a run is better than the best so far if its length times that period is greater.
    best = "aggregate(runs, runs[0], (b, r) -> if(r.length * b.period > b.length * r.period, r, b))"
    return found.selectExpr("doc_id", "cast(size(runs) AS bigint) AS n_runs", f"if(size(runs) > 0, {best}, null) AS best",
                            f"sha2({line}, 256) AS runs_sha256", "sha2(collapsed, 256) AS collapsed_sha256") \
        .selectExpr("doc_id", "n_runs", "best.start AS start", "best.length AS length", "best.period AS period",
                    "1000 * best.length div best.period AS exponent_milli", "runs_sha256", "collapsed_sha256")


QUERIES["op12_runs"] = op12_runs


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.best_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES["op11_lexical_search"] = op11_lexical_search
_TERMS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
SQL["op11_lexical_search"] = f"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid, {_TERMS} AS l FROM documents WHERE text IS NOT NULL
), k AS (
  SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(len(l)) AS BIGINT) AS total FROM d WHERE len(l) > 0
), t AS (
  SELECT rid, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT rid, unnest(l) AS term FROM d) GROUP BY rid, term
), w AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, k GROUP BY term, docs
), q AS (
  SELECT item_id, iid, term, count(*) AS c
  FROM (SELECT item_id, iid, unnest(l) AS term
        FROM (SELECT item_id, row_number() OVER () AS iid, {_TERMS} AS l FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)))
  GROUP BY item_id, iid, term
), s AS (
  SELECT q.item_id, q.iid, d.doc_id, d.rid,
    CAST(sum(q.c * w.w * ((1000000000 * t.tf) // (1000 * t.tf + 12 * (75 + (25 * len(d.l) * k.docs) // k.total)))) AS BIGINT) AS score
  FROM q JOIN t USING (term) JOIN w USING (term) JOIN d ON d.rid = t.rid, k
  GROUP BY q.item_id, q.iid, d.doc_id, d.rid
), r AS (
  SELECT *, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST, rid) AS rank FROM s WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 20
"""
