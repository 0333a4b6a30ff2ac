"""The registered queries of this subpackage, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelens.llm import (
    divergence,
    exact_dedup,
    filter_audit,
    html_extract,
    line_dedup,
    lm_score,
    packing,
    quality_classifier,
    quality_rules,
    sentencepiece_trie,
    simhash,
    substring_dedup,
    warc,
)
from hirelens.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


@query("""WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)""")
def op1_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query(r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
  list_filter(string_split(text, chr(10)), lambda x : regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, array_to_string(ws[i : i + 7], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g),
p AS (SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS k FROM c WHERE n > 1),
r AS (SELECT doc_id, sum(k) AS n_repeat_words FROM p GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, len(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  len(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines FROM w LEFT JOIN r ON r.doc_id = w.doc_id),
f AS (SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
  + CASE WHEN word_chars < 2 * n_words OR word_chars > 15 * n_words THEN 4 ELSE 0 END
  + CASE WHEN 10 * n_symbols > 3 * n_words THEN 8 ELSE 0 END + CASE WHEN 10 * n_dup_lines > 3 * n_lines THEN 16 ELSE 0 END)::INTEGER AS failed_mask FROM m),
s AS (SELECT *, CASE failed_mask & 15 WHEN 1 THEN 'too_few_words' WHEN 2 THEN 'repeated_windows' WHEN 4 THEN 'word_length' WHEN 8 THEN 'symbols' ELSE '' END AS sole_rule FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_mask, (failed_mask & 3) <> 0 AS base_failed, (failed_mask & 15) = 0 AS kept,
  (failed_mask & 3) = 0 AS kept_v1, (failed_mask & 15) = 0 AS kept_v2, failed_mask = 0 AS kept_v3, sole_rule,
  CASE WHEN sole_rule = '' THEN 0 ELSE count(*) OVER (PARTITION BY sole_rule) END AS sole_rule_docs FROM s""")
def op5_quality_rules(spark, sf_dir):
    book = quality_rules.with_policies(quality_rules.stored(table(spark, sf_dir, "documents")))
    measured = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return book.select("doc_id", *measured, "failed_mask", "base_failed", "kept", "kept_v1", "kept_v2", "kept_v3", "sole_rule", "sole_rule_docs")


@query()
def op7_simhash_dedup(spark, sf_dir):
    return simhash.simhash_dedup(table(spark, sf_dir, "documents"))


@query(r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
h AS (SELECT key, count(DISTINCT doc_id) AS n, max(doc_id) AS last_doc FROM k WHERE len(key) >= 40 GROUP BY key),
m AS (SELECT k.doc_id, pos, line, n >= 5 AND k.doc_id <> last_doc AS gone FROM k LEFT JOIN h ON h.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE gone IS NOT TRUE), '')) AS kept_sha256
FROM m GROUP BY doc_id""")
def op10_line_dedup(spark, sf_dir):
    done = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", F.col("n_dropped").cast("long").alias("n_dropped"), F.sha2("kept_text", 256).alias("kept_sha256"))


@query()
def op6_quality_classifier(spark, sf_dir):
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op4_lexical_packing(spark, sf_dir):
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).drop("ids")


@query()
def op9_html_extract(spark, sf_dir):
    done = html_extract.extract(table(spark, sf_dir, "pages"))
    return done.withColumn("n_chars", F.char_length("text").cast("long"))


@query()
def op2_substring_dedup(spark, sf_dir):
    return substring_dedup.substring_classes(table(spark, sf_dir, "documents"))


@query()
def op8_lm_score(spark, sf_dir):
    return lm_score.lm_scores(table(spark, sf_dir, "documents"))


@query()
def op3_sentencepiece(spark, sf_dir):
    """Ids of each text and what they decode to, as digests."""
    import public_tokenizers

    back = sentencepiece_trie.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return back.select("doc_id", "n_tokens", "ids_crc32", F.sha2("text", 256).alias("decoded_sha256"))


@query("""WITH RECURSIVE d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
lab AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, (CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END
  + CASE WHEN 100 * len(regexp_replace(text, '[^A-Z]+', '', 'g')) > 3 * len(text) THEN 4 ELSE 0 END
  + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
  + CASE WHEN w.doc_id > min(w.doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END) AS mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM w LEFT JOIN lab ON lab.doc_id = w.doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT f AS filter_order, bit AS used FROM f UNION ALL SELECT filter_order || f, used + bit FROM o, f WHERE (used & bit) = 0),
s AS (SELECT filter_order, step, (SELECT bit FROM f WHERE f = filter_order[step]) AS bit,
  coalesce((SELECT sum(bit) FROM f WHERE contains(filter_order[1:step - 1], f)), 0)::INT AS earlier
  FROM (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM o WHERE used = 31)),
r AS (SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (WHERE (mask & (bit | earlier)) = 0), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER (WHERE (mask & bit) <> 0 AND (mask & earlier) = 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (WHERE (mask & bit) <> 0 AND (mask & earlier) <> 0), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (WHERE mask = bit), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (WHERE (mask & bit) <> 0 AND (mask & earlier) = 0), 0)::BIGINT AS good_lost,
  coalesce(sum(toxic) FILTER (WHERE (mask & bit) <> 0 AND (mask & earlier) = 0), 0)::BIGINT AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM r""")
def op11_filter_audit(spark, sf_dir):
    return filter_audit.audit_files(spark, f"{sf_dir}/documents.parquet", table(spark, sf_dir, "labels"))


@query(r"""WITH d AS (SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
x AS (SELECT row_id, lang, source, unnest(ts) AS term FROM d),
v AS (SELECT lang, term, count(*) AS n FROM x GROUP BY lang, term HAVING count(DISTINCT row_id) >= 30),
l AS (SELECT lang, count(*)::HUGEINT AS big_v, sum(n)::HUGEINT AS big_n FROM v GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT x.lang, x.source, x.term, count(*) AS n FROM x JOIN v ON v.lang = x.lang AND v.term = x.term GROUP BY ALL),
t AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT AS total FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
p AS (SELECT t.lang, t.source, v.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 5) // (t.total + 5 * l.big_v) AS p,
  1 + 1000000000::HUGEINT * (v.n + 5) // (l.big_n + 5 * l.big_v) AS lang_p
  FROM t JOIN v ON v.lang = t.lang JOIN l ON l.lang = t.lang LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = v.term),
pair AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source
  LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source),
every AS (SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, (p - lang_p)::BIGINT FROM p WHERE n > 0 AND p > lang_p),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM every)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 50""")
def op12_source_divergence(spark, sf_dir):
    return divergence.divergence(table(spark, sf_dir, "documents"))


@query("""WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
m AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS payload_digest, max(page_id) OVER (PARTITION BY html) AS last_id FROM p),
r AS (SELECT *, payload_bytes >= 1000 AND page_id <> last_id AS again FROM m)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN last_id END AS refers_to FROM r""")
def op13_warc(spark, sf_dir):
    back = warc.round_trip(table(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
