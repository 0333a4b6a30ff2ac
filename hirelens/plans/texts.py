"""Queries on description texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from hirelens.operators import textmine as X
from hirelens.operators.collect import domain_filter
from hirelens.operators.describe import salary_group
from hirelens.plans.registry import as_long, query, rounded
from hirelens.plans.views import (
    CLEAN_SQL, MODELLED_SQL, SIMILARITY_SQL, TFIDF_SQL, TOKENS_SQL, clean, doc_similarity, doc_terms, doc_tokens, document_count,
    high_documents, modelled, table, tag_rows_sql, texts, with_tags,
    POSTINGS_SQL, postings,
)
from hirelens.session import settle

Y = "salary_month_k"


@query(f"WITH {TOKENS_SQL} SELECT term, count(*) AS n FROM tokens GROUP BY 1")
def term_freq(spark, sf_dir):
    return X.term_freq(doc_tokens(spark, sf_dir))


@query(f"WITH {TOKENS_SQL} SELECT term, count(*) AS n FROM tokens GROUP BY 1 ORDER BY n DESC, term LIMIT 15")
def top_terms(spark, sf_dir):
    return X.top_terms(X.term_freq(doc_tokens(spark, sf_dir)), 15)


# common words of the parts table serve as the stop list
@query(f"""WITH {TOKENS_SQL}, stop AS (SELECT DISTINCT term FROM (SELECT term, count(DISTINCT doc_id) AS d FROM tokens GROUP BY 1) x
WHERE d * 2 > (SELECT count(*) FROM documents))
SELECT term, count(*) AS n FROM tokens WHERE term NOT IN (SELECT term FROM stop) GROUP BY 1""")
def drop_stopwords(spark, sf_dir):
    """Terms that occur in more than half of all documents are taken as generic."""
    tokens = settle(X.term_counts(doc_terms(spark, sf_dir), "doc_id"))
    common = X.document_frequency(tokens, document_count(spark, sf_dir)).where(
        F.col("df") * 2 > document_count(spark, sf_dir))
    return X.term_freq(X.drop_stopwords(tokens, common))


@query(f"""WITH {TOKENS_SQL}, l AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1),
t AS (SELECT term, count(*) FILTER (quality = 1) AS n_high, count(*) FILTER (quality <> 1) AS n_low FROM tokens JOIN l USING (doc_id) GROUP BY 1),
s AS (SELECT CAST(sum(n_high) AS DOUBLE) AS h, CAST(sum(n_low) AS DOUBLE) AS l FROM t)
SELECT term, n_high, n_low, round(n_high / h, 6) AS share_high, round(n_low / l, 6) AS share_low, round(n_high / h - n_low / l, 6) AS share_diff,
  round(ln(((n_high + 1) * l) / ((n_low + 1) * h)), 6) AS log_ratio FROM t, s""")
def contrast_terms(spark, sf_dir):
    groups = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    # labels meet the documents, not the tokens
    docs = texts(spark, sf_dir, "documents", "doc_id", "text").join(groups, "doc_id")
    tokens = docs.select("quality", F.explode(X.word_tokens(F.col("text"))).alias("term"))
    return rounded(X.contrast_terms(tokens, F.col("quality") == 1), "share_high", "share_low", "share_diff", "log_ratio")


@query(f"""WITH {CLEAN_SQL}, {tag_rows_sql('p_type')}, c AS (SELECT job_id, CASE WHEN round({Y}, 6) <= q1 THEN 'low' WHEN round({Y}, 6) >= q3 THEN 'high'
WHEN {Y} IS NOT NULL THEN 'middle' END AS salary_group FROM clean,
(SELECT quantile_cont(round({Y}, 6), 0.25) AS q1, quantile_cont(round({Y}, 6), 0.75) AS q3 FROM clean) q)
SELECT salary_group, tag AS benefit, count(*) AS n FROM c JOIN tag_rows USING (job_id) GROUP BY 1, 2""")
def benefit_freq(spark, sf_dir):
    rows = with_tags(rounded(clean(spark, sf_dir).select("job_id", Y), Y), spark, sf_dir, "p_type", "benefits")
    return X.benefit_freq(salary_group(rows, Y), "salary_group")


@query(f"WITH {TFIDF_SQL} SELECT doc_id, term, round(w, 6) AS w FROM vectors")
def tfidf_vectors(spark, sf_dir):
    return rounded(X.tfidf(doc_terms(spark, sf_dir), "doc_id", document_count(spark, sf_dir)), "w")


_WIDTH = 4096


@query(f"""WITH {TOKENS_SQL}, slots AS (SELECT doc_id, CAST(concat('0x', substr(md5(term), 1, 8)) AS BIGINT) % {_WIDTH} AS slot FROM tokens),
counts AS (SELECT doc_id, slot, count(*) AS tf FROM slots GROUP BY 1, 2),
freq AS (SELECT slot, ln((1.0::DOUBLE + (SELECT count(*) FROM documents)) / (1.0::DOUBLE + count(*))) + 1.0::DOUBLE AS idf FROM counts GROUP BY 1)
SELECT doc_id, slot, round(tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY doc_id)), 6) AS w FROM counts JOIN freq USING (slot)""")
def hashed_vectors(spark, sf_dir):
    """TF-IDF over hashed slots instead of a vocabulary."""
    return rounded(X.hashed_tfidf(doc_terms(spark, sf_dir), "doc_id", document_count(spark, sf_dir), _WIDTH), "w")


@query(f"WITH {TFIDF_SQL} SELECT term, round(sum(w) / (SELECT count(*) FROM high), 6) AS weight FROM vectors WHERE doc_id IN (SELECT doc_id FROM high) GROUP BY 1")
def high_template(spark, sf_dir):
    vectors = X.tfidf(doc_terms(spark, sf_dir), "doc_id", document_count(spark, sf_dir))
    return rounded(X.template(vectors, high_documents(spark, sf_dir), "doc_id"), "weight")


@query(f"WITH {SIMILARITY_SQL} SELECT doc_id, round(similarity, 6) AS similarity FROM sims")
def tfidf_similarity(spark, sf_dir):
    return rounded(doc_similarity(spark, sf_dir), "similarity")


@query(f"""WITH {TFIDF_SQL}, folds AS (SELECT unnest(range(4)) AS fold),
own AS (SELECT f.fold, term, sum(w) AS s FROM vectors JOIN folds f ON doc_id % 4 <> f.fold WHERE doc_id IN (SELECT doc_id FROM high) GROUP BY 1, 2),
size AS (SELECT f.fold, count(*) AS n FROM high JOIN folds f ON doc_id % 4 <> f.fold GROUP BY 1),
tpl AS (SELECT fold, term, s / n AS weight FROM own JOIN size USING (fold)),
len AS (SELECT fold, sqrt(sum(weight * weight)) AS len FROM tpl GROUP BY 1)
SELECT doc_id, round(coalesce(sum(w * weight), 0.0::DOUBLE) / any_value(len), 6) AS similarity
FROM vectors LEFT JOIN tpl ON tpl.term = vectors.term AND tpl.fold = doc_id % 4 JOIN len ON len.fold = doc_id % 4 GROUP BY 1""")
def similarity_out_of_fold(spark, sf_dir):
    """Every document against the template of the other three folds: no document explains itself."""
    return rounded(doc_similarity(spark, sf_dir, folds=4), "similarity")


@query(f"""WITH {MODELLED_SQL} SELECT CAST(least(floor(round(similarity, 9) * 5) + 1, 5) AS INT) AS grade, count({Y}) AS n, round(avg({Y}), 6) AS mean
FROM modelled WHERE similarity IS NOT NULL GROUP BY 1""")
def similarity_grades(spark, sf_dir):
    rows = rounded(modelled(spark, sf_dir), "similarity", digits=9)
    return rounded(X.similarity_grades(rows, "similarity", Y), "mean")


@query(f"""WITH {MODELLED_SQL} SELECT source, regr_count({Y}, similarity) AS n, round(regr_slope({Y}, similarity), 4) AS slope,
round(regr_intercept({Y}, similarity), 4) AS intercept, round(regr_r2({Y}, similarity), 6) AS r2 FROM modelled GROUP BY 1""")
def similarity_line(spark, sf_dir):
    out = X.fit_line(modelled(spark, sf_dir), "similarity", Y, ["source"])
    return as_long(rounded(rounded(out, "slope", "intercept", digits=4), "r2"), "n")


@query(f"""WITH {MODELLED_SQL} SELECT round(similarity, 9) AS similarity, round({Y}, 6) AS {Y} FROM modelled
WHERE (job_id % 2147483648) * {X.HASH_FACTOR} % {X.HASH_SIZE} < {int(0.1 * X.HASH_SIZE)} AND similarity IS NOT NULL AND {Y} IS NOT NULL""")
def similarity_points(spark, sf_dir):
    """A tenth of the points for the scatter chart, by a hash of the id."""
    return rounded(rounded(X.scatter_points(modelled(spark, sf_dir), "similarity", Y, 0.1, "job_id"), "similarity", digits=9), Y)


@query(f"""WITH {POSTINGS_SQL}, r AS (SELECT job_id, unnest(regexp_extract_all(concat(raw_education, ' ', coalesce(raw_experience, ''), source), '[一-鿿]+')) AS run FROM postings),
b AS (SELECT run, unnest(range(1, greatest(length(run), 2))) AS i FROM r) SELECT substr(run, CAST(i AS INT), 2) AS term, count(*) AS n FROM b GROUP BY 1""")
def han_tokens(spark, sf_dir):
    """Bigrams of Han runs; a run of one character is its own term."""
    rows = postings(spark, sf_dir).select("job_id", F.concat("raw_education", F.lit(" "), F.coalesce("raw_experience", F.lit("")), "source").alias("text"))
    return X.term_freq(X.tokenise(rows, "job_id", "text")).where(F.col("term").rlike("^[一-鿿]+$"))


DICTIONARY = ["the", "ther", "tion", "elle", "ción", "und", "auf"]


@query("WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '"
       + "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))) + "')) AS term FROM documents) SELECT term, count(*) AS n FROM t GROUP BY 1")
def dict_tokens(spark, sf_dir):
    """Dictionary mode: longest match of a word list anywhere in the text."""
    return X.term_freq(X.tokenise(texts(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text", DICTIONARY))


_PART_WORDS = "SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS w FROM part"


def part_words(spark, sf_dir):
    """The word list of the two queries below: all distinct words of the part names."""
    return table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("term"))


@query(f"""WITH p AS (SELECT string_agg(w, '|' ORDER BY length(w) DESC, w) AS pattern FROM ({_PART_WORDS}) x WHERE w <> ''),
t AS (SELECT unnest(regexp_extract_all(concat(lower(text), ' ', coalesce(source, '')), pattern)) AS term FROM documents, p
  UNION ALL SELECT unnest(regexp_extract_all(lower(replace(p_name, ' ', '')), pattern)) FROM part, p)
SELECT term, count(*) AS n FROM t GROUP BY 1""")
def part_word_tokens(spark, sf_dir):
    """Dictionary mode with a list that comes from a table, over all documents and over part names without their blanks."""
    words = X.TermSet(spark, part_words(spark, sf_dir))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(" ", "text", F.coalesce("source", F.lit(""))).alias("text"))
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.replace("p_name", F.lit(" "), F.lit("")).alias("text"))
    return X.term_freq(X.tokenise(docs.unionAll(names), "doc_id", "text", words))


@query(f"""WITH p AS (SELECT string_agg(w, '|') AS pattern FROM ({_PART_WORDS}) x WHERE w <> '')
SELECT page_id, url FROM pages, p WHERE regexp_matches(concat_ws(' ', lower(url), lower(html)), pattern)""")
def domain_filter_words(spark, sf_dir):
    """The domain filter with the distinct words of the part names as its terms."""
    words = X.TermSet(spark, part_words(spark, sf_dir))
    return domain_filter(table(spark, sf_dir, "pages"), words, ["url", "html"]).select("page_id", "url")
