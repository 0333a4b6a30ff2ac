"""Every operator and stage on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import time
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hirelens.llm import exact_dedup, html_extract, line_dedup, lm_score, packing, quality_classifier, quality_rules, sentencepiece_trie, simhash, substring_dedup

public_tokenizers = pytest.importorskip("public_tokenizers")
WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
LONG = " ".join(f"word{i}" for i in range(60_000))
SAME = " ".join(f"same{i}" for i in range(80))
CLASH = ["kept", "row", "key", "fp", "shard", "digest", "node", "a", "r", "score", "ids", "text_sha256", "line", "carried", "label", "cut_spans"]
ROWS = [
    (1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, SAME), (6, SAME), (6, SAME), (7, "x"), (None, SAME), (None, None),
    (8, "tie tie"), (9, "tie tie"), (10, "a\x00b ퟿ 😀 ﬁ"), (11, "CASE case"), (12, LONG + " end")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    base = spark.createDataFrame([(i, t, None, "s", None) for i, t in ROWS], SCHEMA)
    return base.withColumns({c: F.lit("clash") for c in CLASH})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(1, 13)] + [(None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ids_of(df):
    return sorted((r.doc_id for r in df.collect()), key=lambda x: (x is not None, x))


ALL = sorted((i for i, _ in ROWS), key=lambda x: (x is not None, x))


def test_exact_dedup(spark, docs):
    got = exact_dedup.exact_dedup(docs)
    rows = {(r.doc_id, r.text_sha256): r for r in got.collect()}
    assert ids_of(got) == ALL
    same = [r for r in rows.values() if r.group_size == 4]
    assert {r.doc_id for r in same} == {5, 6, None} and all(r.keep_id == 6 and r.kept == (r.doc_id == 6) for r in same)
    nothing = [r for r in rows.values() if r.doc_id in (1, 2)]
    assert all(r.keep_id == 2 and r.group_size == 3 for r in nothing)
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0


def test_substring(spark, docs):
    got = substring_dedup.substring_classes(docs)
    rows = {r.doc_id: r for r in got.collect()}
    assert ids_of(got) == ALL
    assert rows[5].class_id == rows[6].class_id == 5 and rows[6].n_links == 1 and rows[6].n_repeated_words == 80
    assert rows[12].class_id == 4 and rows[12].n_repeated_words == 60_000
    assert all(rows[i].n_links == 0 and rows[i].class_id == i for i in (1, 2, 3, 7, 8, 9, 10, 11, None))
    assert substring_dedup.substring_classes(empty(spark)).count() == 0
    cut = substring_dedup.cut_passages(docs)
    assert set(cut.columns) == set(docs.columns)
    left = {r.doc_id: r.text for r in cut.collect()}
    assert 6 not in left and left[5] == SAME and left[12].split() == ["end"] and left[1] is None and None in left


def test_sentencepiece(spark, docs):
    got = sentencepiece_trie.decode(sentencepiece_trie.encode(docs, PIECES), PIECES)
    back = [(r.doc_id, r.text) for r in got.collect()]
    assert sorted(back, key=str) == sorted(((i, t or "") for i, t in ROWS), key=str)
    assert sentencepiece_trie.decode(sentencepiece_trie.encode(empty(spark), PIECES), PIECES).count() == 0


def test_packing(spark, docs):
    import numpy as np
    from tokenizers import Tokenizer

    inner = Tokenizer.from_file(WORDS)
    pieces = packing.pack(docs, WORDS, shard_docs=4).collect()
    want = sorted(zlib.crc32(np.array([*inner.encode(t or "", add_special_tokens=False).ids, packing.END], "<u4").tobytes()) for _, t in ROWS)
    docs_found, at = [], {}
    for r in sorted(pieces, key=lambda r: (str(r.doc_id), r.doc_tokens, r.start)):
        if r.length == r.doc_tokens:
            docs_found.append(zlib.crc32(np.frombuffer(r.ids, "<u2").astype("<u4").tobytes()))
            continue
        key = (r.doc_id, r.doc_tokens)
        assert r.start == sum(len(x) for x in at.setdefault(key, [])) // 2
        at[key].append(bytes(r.ids))
    docs_found += [zlib.crc32(np.frombuffer(b"".join(x), "<u2").astype("<u4").tobytes()) for x in at.values()]
    assert sorted(docs_found) == want
    filled = {}
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= packing.WINDOW
    assert packing.pack(empty(spark), WORDS).count() == 0


def test_rules(spark, docs):
    rows = quality_rules.verdict(quality_rules.ledger(docs)).collect()
    assert len(rows) == len(ROWS)
    by = {r.doc_id: r for r in rows}
    assert by[1].n_words == by[2].n_words == by[3].n_words == 0 and by[1].base_failed and not by[1].kept
    assert by[4].n_words == 60_000 and by[4].kept and by[11].word_chars == 8
    assert quality_rules.ledger(empty(spark)).count() == 0 and quality_rules.ablations(quality_rules.ledger(empty(spark))).count() == 0


def test_classifier(spark, docs, labels):
    got = quality_classifier.classify(docs, labels)
    assert ids_of(got) == ALL
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.collect())
    none = quality_classifier.classify(docs, labels.where("false"))
    assert {r.score for r in none.collect()} == {0.5}
    assert quality_classifier.classify(empty(spark), labels).count() == 0


def test_simhash(spark, docs):
    got = simhash.simhash_dedup(docs)
    assert ids_of(got) == ALL
    rows = {r.doc_id: r for r in got.collect()}
    assert rows[1].fingerprint == rows[3].fingerprint == "0" * 16 and rows[3].component_id == 1
    assert rows[6].component_id == 5 and rows[9].component_id == 8
    stay = simhash.keep_one(docs)
    assert set(stay.columns) == set(docs.columns)
    assert [i for i in ids_of(stay) if i is not None and i in (5, 6, 8, 9)] == [5, 8]
    assert simhash.simhash_dedup(empty(spark)).count() == 0 and simhash.keep_one(empty(spark)).count() == 0


def test_lm(spark, docs):
    got = lm_score.lm_scores(docs)
    assert ids_of(got) == ALL
    rows = {r.doc_id: r for r in got.collect()}
    assert rows[1].n_tokens == rows[2].n_tokens == 1 and rows[4].n_tokens == 60_001
    assert all(r.score < 0 and r.base_score < 0 for r in rows.values())
    assert lm_score.lm_scores(empty(spark)).count() == 0


def test_html(spark):
    rows = [
        (1, None, None), (2, "http://h/a", ""), (3, "http://h/b", "plain &amp; simple"), (4, "http://h/c", "<article><p>a<b>b</b>\n c<p>d&nbsp;e</article>"),
        (4, "http://h/c", "<article><p>a<b>b</b>\n c<p>d&nbsp;e</article>"), (None, "::", "<div><div>" * 5000 + "deep"), (5, "http://h/d", "<nav>x</nav><footer>y</footer>")]
    pages = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, html string, host string, template string")
    got = sorted(((r.page_id, r.text) for r in html_extract.extract(pages).collect()), key=str)
    assert got == sorted([(1, ""), (2, ""), (3, "plain & simple"), (4, "ab c d e"), (4, "ab c d e"), (None, "deep"), (5, "")], key=str)
    assert html_extract.extract(pages.where("false")).count() == 0


def test_lines(spark, docs):
    line = "l" * 45
    rows = [(i, f"own{i}\n {line.upper()}\n{line}", "en", "s", 1) for i in range(1, 7)] + [(6, "other\n" + line, "en", "s", 1), (None, line, "en", "s", 1), (None, None, "en", "s", 1)]
    more = spark.createDataFrame(rows, SCHEMA)
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.line_dedup(more).collect()), key=str)
    want = [(i, 3, 2, f"own{i}") for i in range(1, 6)] + [(6, 3, 0, f"own6\n {line.upper()}\n{line}"), (6, 2, 0, "other\n" + line), (None, 1, 1, ""), (None, 1, 0, "")]
    assert got == sorted(want, key=str)
    assert len(line_dedup.line_dedup(docs).collect()) == len(ROWS)
    assert line_dedup.line_dedup(empty(spark)).count() == 0


def test_labels_given_twice(spark):
    measured = quality_classifier.features(spark.createDataFrame([(i, f"text {i}") for i in range(1, 5)], "doc_id long, text string"))
    ids = [i for i in range(1, 200) if quality_classifier.python_fold(i, 4) != 2][:4]
    measured = measured.withColumn("doc_id", F.element_at(F.array(*map(F.lit, ids)), F.col("doc_id").cast("int")).cast("long"))
    rows = [(ids[0], 1), (ids[0], 1), (ids[1], 0), (ids[1], 1), (ids[2], 0), (ids[2], None)]
    known = quality_classifier.training(measured, spark.createDataFrame(rows, "doc_id long, quality int"))
    assert sorted(r.label for r in known.collect()) == [0, 1]


def test_what_each_stage_keeps(spark, labels, tmp_path):
    """Each stage's own result on a small corpus where it is known."""
    labels.where("false").write.parquet(f"{tmp_path}/labels.parquet")
    stages, line = dict(corpus_pipeline.STAGES), "This line is on every page and has over forty characters."
    own = lambda i: " ".join(f"w{i}x{j}" for j in range(70))
    passage = " ".join(f"shared{j}" for j in range(60))
    rows = [(i, f"{own(i)}\n{line}", None, "s", 1) for i in range(1, 7)] + [(7, own(7), "en", "s", 1), (8, own(7), "en", "s", 1)]
    rows += [(9, f"{own(9)} {passage}", "en", "s", 1), (10, f"{own(10)} {passage}", "en", "s", 1), (11, None, None, None, None)]
    start = spark.createDataFrame(rows, SCHEMA)
    after = lambda name, df: {r.doc_id: r.text for r in stages[name](spark, df, str(tmp_path)).collect()}
    assert after("quality classifier", start) == {i: t for i, t, *_ in rows}  # no label, so every score is 0.5: nothing goes
    lined = after("line dedup", start)
    assert lined == {i: own(i) if i < 6 else t or "" for i, t, *_ in rows}
    assert after("near duplicates", start) == {i: t for i, t, *_ in rows if i != 8}
    cut = after("substring dedup", start)
    assert cut[9] == rows[8][1] and cut[10].split() == own(10).split() and 8 not in cut and cut[7] == own(7)
    pieces = stages["packing"](spark, start, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == set(range(1, 12)) and sum(r.length for r in pieces) == sum({r.doc_id: r.doc_tokens for r in pieces}.values())


def test_stages(spark, docs, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for start in (docs, empty(spark)):
        now = start
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, now, str(tmp_path))
            if name != corpus_pipeline.STAGES[-1][0]:
                assert got.columns == corpus_pipeline.COLUMNS
                now = spark.createDataFrame(got.collect(), got.schema)
            assert (got.count() > 0) == (start is docs)


def test_settled_steps_leave_no_shuffle_files(spark):
    """Substring dedup runs in this: the files of a step are gone when it is written, without a garbage collection."""
    from pathlib import Path

    from hirelens.llm.common import settle, shuffles_dropped

    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {str(p) for d in disk.localDirs() for p in Path(str(d.getPath())).rglob("shuffle_*.data")}
    step = lambda: settle(spark.range(100_000).groupBy((F.col("id") % 1000).alias("k")).count())
    before = files()
    step()
    assert files() - before
    between = files()
    with shuffles_dropped(spark):
        assert step().count() == 1000
        time.sleep(1)
        assert not files() - between
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
