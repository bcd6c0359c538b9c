"""Registered queries of the corpus operators: one ``opN_<name>`` per operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, *tables: str, sql: str | None = None):
    """Register ``fn`` of the named tables (``documents`` if none) under ``name``."""
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables or ("documents",)))
        run.__name__ = name
        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return fn
    return deco


@query("op1_warc", "pages", sql="""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, strlen(coalesce(html, '')) AS n FROM pages),
g AS (SELECT t, max(page_id) AS keep FROM p GROUP BY t)
SELECT p.page_id, p.n AS payload_bytes, sha1(p.t) AS payload_digest,
       CASE WHEN p.n >= 1000 AND p.page_id <> g.keep THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.n >= 1000 AND p.page_id <> g.keep THEN g.keep END AS refers_to
FROM p JOIN g USING (t)""")
def op1(pages: DataFrame) -> DataFrame:
    from .warc import archive_pages
    read = archive_pages(pages, f"{shared_dir(pages.sparkSession)}/warc")
    return read.select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op2_sentencepiece")
def op2(docs: DataFrame) -> DataFrame:
    from .sentencepiece import encode_documents
    read = encode_documents(docs, decode=True)
    return read.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids",
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
                       (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


@query("op3_line_dedup", sql=r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
hot AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE hot.key IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE hot.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN hot USING (key) GROUP BY doc_id""")
def op3(docs: DataFrame) -> DataFrame:
    from .line_dedup import line_dedup
    return line_dedup(docs, min_docs=10).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query("op4_substring_dedup", sql=r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(len(ws) - 49)) AS i FROM w WHERE len(ws) >= 50),
k AS (SELECT doc_id, i, md5(array_to_string(ws[i + 1:i + 50], ' ')) AS h FROM p),
f AS (SELECT h, min(doc_id) AS least FROM k GROUP BY h HAVING count(DISTINCT doc_id) > 1),
gone AS (SELECT DISTINCT k.doc_id, unnest(range(k.i, k.i + 50)) AS pos FROM k JOIN f USING (h) WHERE f.least < k.doc_id),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM w),
kept AS (SELECT words.doc_id, count(gone.pos) AS n_removed,
                string_agg(word, ' ' ORDER BY words.pos) FILTER (WHERE gone.pos IS NULL) AS kept
         FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.pos = gone.pos GROUP BY words.doc_id)
SELECT w.doc_id, len(w.ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id""")
def op4(docs: DataFrame) -> DataFrame:
    from .substring_dedup import substring_dedup
    return substring_dedup(docs, window=50).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query("op5_exact_dedup", sql="""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                    'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g USING (t)""")
def op5(docs: DataFrame) -> DataFrame:
    from .exact_dedup import exact_dedup
    return exact_dedup(docs)


@query("op6_fingerprints")
def op6(docs: DataFrame) -> DataFrame:
    from .fingerprints import fingerprint_edits
    return fingerprint_edits(docs)


@query("op7_near_dedup")
def op7(docs: DataFrame) -> DataFrame:
    from .near_dedup import near_groups
    return near_groups(docs, k=3, percent=85).select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


@query("op8_toxicity", "documents", "labels")
def op8(docs: DataFrame, labels: DataFrame) -> DataFrame:
    from .toxicity import held_out, score, train
    return score(docs, train(docs, labels)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


@query("op9_language_id")
def op9(docs: DataFrame) -> DataFrame:
    from .language_id import held_out, identify, train
    return identify(docs, train(docs)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


@query("op10_packing")
def op10(docs: DataFrame) -> DataFrame:
    from .packing import pack
    return pack(docs)


@query("op11_conversations", "conversations")
def op11(conversations: DataFrame) -> DataFrame:
    from .conversations import audit
    return audit(conversations)


@query("op12_divergence", sql=r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
w AS (SELECT doc_id, lang, source, translate(unnest(ws), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
t AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT doc_id) >= 3),
c AS (SELECT w.lang, source, term, count(*) AS n FROM w JOIN t USING (lang, term) GROUP BY ALL),
tongue AS (SELECT lang, count(*) AS v, sum(n) AS total FROM t GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT s.lang, s.source, t.term, coalesce(c.n, 0) AS n,
             1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (s.total + tongue.v)::HUGEINT AS p,
             1 + (1000000000::HUGEINT * (t.n + 1)) // (tongue.total + tongue.v)::HUGEINT AS q
      FROM s JOIN tongue USING (lang) JOIN t USING (lang) LEFT JOIN c USING (lang, source, term)),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
                 coalesce((SELECT sum(((x.p - y.p) * (x.p - y.p)) // y.p) FROM p x JOIN p y
                           ON x.lang = y.lang AND x.term = y.term
                           WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // q AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
           FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200""")
def op12(docs: DataFrame) -> DataFrame:
    from .divergence import divergence_audit
    return divergence_audit(docs)


@query("op13_decontaminate", "documents", "benchmark", sql=r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                  'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
i AS (SELECT item_id, least(len(ws), 10) AS size, unnest(range(greatest(len(ws) - 9, 1))) AS k, ws FROM b WHERE len(ws) > 0),
w AS (SELECT DISTINCT item_id, size, array_to_string(ws[k + 1:k + size], ' ') AS win FROM i),
sizes AS (SELECT DISTINCT size FROM w),
places AS (SELECT doc_id, ws, size, unnest(range(len(ws) - size + 1)) AS k FROM d, sizes WHERE len(ws) >= size),
found AS (SELECT doc_id, places.size, k, item_id FROM places JOIN w
          ON w.size = places.size AND w.win = array_to_string(ws[k + 1:k + places.size], ' ')),
hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS pos FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN items ON d.doc_id = items.doc_id""")
def op13(docs: DataFrame, bench: DataFrame) -> DataFrame:
    from .decontaminate import scan
    return scan(docs, bench, window=10).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))
