"""Filter audit, source divergence and web archives against brute force, with their edge cases."""

import collections
import hashlib
import itertools
import re

import pytest
from pyspark.sql import functions as F

from hirelens.llm import divergence, filter_audit, warc
from hirelens.session import shared_folder

DOCS = "doc_id long, text string, lang string, source string"
WORD = re.compile("[^\x20\x09-\x0d]+")


def fails(text):
    words = WORD.findall(text)
    capitals = sum("A" <= c <= "Z" for c in text)
    tests = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * capitals > 3 * len(text), any(c in "#$%&*|" for c in text)]
    return {f for f, t in zip("ABCD", tests) if t}


def brute_audit(rows, labels):
    good, toxic = ({i for i, *v in labels if v[k] == 1 and i is not None} for k in (0, 1))
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    docs = [(i, lang or "", fails(text or "") | ({"E"} if i is not None and i > least[text or ""] else set())) for i, text, lang in rows]
    out, removed_in = {}, collections.Counter()
    for part in {p for _, p, _ in docs}:
        mine = [(i, f) for i, p, f in docs if p == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, flt in enumerate(order, 1):
                here = [(i, f) for i, f in mine if flt in f]
                gone = [(i, f) for i, f in here if not f & set(order[:step - 1])]
                out[part, order, step] = [
                    sum(not f & set(order[:step]) for _, f in mine), len(gone), len(here) - len(gone), sum(f == {flt} for _, f in mine),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
                removed_in[part, flt] += len(gone)
    return {k: (*v, removed_in[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audit_rows(df):
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}
    assert len(got) == df.count()
    return got


SAME, OTHER = " ".join(f"w{i}" for i in range(250)), " ".join(f"w{i % 90}" for i in range(250))
AUDITED = [
    (90, SAME, "en"), (91, SAME, "de"), (80, OTHER, "en"), (81, "short $", None), (82, None, "en"), (83, "", "fr"), (None, SAME, "en"), (None, None, "en"),
    (50, SAME, "de"), (51, SAME, "de"), (52, OTHER.upper(), "en"), (52, OTHER.upper(), "en"), (53, "short $", "en"), (54, "ÀÉ " * 300, "en"),
    (10, SAME, "en"), (10, SAME, "fr"), (11, OTHER, "en"), (12, "x" * 500_000, "en"), (13, "a\x0bb c " * 100, "de"), (14, "short $", "en")]
LABELS = [(10, 1, 0), (10, 0, 1), (90, 1, 1), (91, 1, 0), (50, 0, 1), (53, 1, None), (None, 1, 1), (80, None, 1), (999, 1, 1)]


def test_filter_audit(spark):
    """Files come with the largest ids first, so that every later file takes places away; then more files, in a second call."""
    base = shared_folder(spark)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").withColumn("part", F.lit("clash"))

    def write(rows):
        df = spark.createDataFrame([(i, t, la, "s") for i, t, la in rows], DOCS).withColumns({"mask": F.lit("clash"), "good": F.lit("clash")})
        df.coalesce(1).write.mode("append").parquet(f"{base}/docs")

    def run():
        files = spark.readStream.schema(spark.read.parquet(f"{base}/docs").schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/docs")
        filter_audit.audit_stream(files, labels, f"{base}/checkpoint", f"{base}/changes", buckets=2)
        return audit_rows(filter_audit.audit(filter_audit.counters(spark, f"{base}/changes")))

    first = [r for r in AUDITED if r[0] is not None]
    for some in (first[:6], first[6:12], first[12:]):
        write(some)
    assert run() == brute_audit(first, LABELS)
    assert spark.read.parquet(f"{base}/changes/batch=*").where("n < 0").count() > 0  # places were taken away
    more = [(5, SAME, "fr"), (7, OTHER.upper(), "de"), (6, "", "en")]
    write(more)
    assert run() == brute_audit(first + more, LABELS)
    assert run() == brute_audit(first + more, LABELS)  # nothing new
    spark.createDataFrame([(i, t, la, "s") for i, t, la in AUDITED], DOCS).repartition(5).write.parquet(f"{base}/all")
    assert audit_rows(filter_audit.audit_files(spark, f"{base}/all", labels, batches=3)) == brute_audit(AUDITED, LABELS)


def test_filter_audit_on_nothing(spark):
    base = shared_folder(spark)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    spark.createDataFrame([], DOCS).write.parquet(f"{base}/none")
    assert filter_audit.audit_files(spark, f"{base}/none", labels).count() == 0
    spark.createDataFrame([(1, None, None, None), (2, None, None, None)], DOCS).coalesce(1).write.parquet(f"{base}/two")
    got = audit_rows(filter_audit.audit_files(spark, f"{base}/two", labels))
    assert len(got) == 600 and got["", "AEBCD", 1] == (0, 2, 0, 1, 0, 0, 180) and got["", "AEBCD", 2] == (0, 0, 1, 0, 0, 0, 60)


TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_divergence(rows, min_docs, top):
    counts, docs, groups = collections.defaultdict(collections.Counter), collections.Counter(), set()
    for _, text, lang, source in rows:
        g = (lang or "", source or "")
        groups.add(g)
        terms = TERM.findall((text or "").translate(LOWER))
        counts[g].update(terms)
        docs.update((g[0], t) for t in set(terms))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for (la, t), n in docs.items() if la == lang and n >= min_docs]
        whole = collections.Counter()
        for g in groups:
            if g[0] == lang:
                whole.update(counts[g])

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p, q = {g: shares(counts[g]) for g in groups if g[0] == lang}, shares(whole)
        for g in p:
            pairs = [(sum(abs(p[g][t] - p[s][t]) for t in kept), s[1]) for s in p if s != g]
            terms = [(p[g][t] - q[t], t) for t in kept if counts[g][t] and p[g][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out |= {(lang, g[1], part, item, value, rank) for rank, (value, item) in enumerate(ranked, 1)}
    return out


def divergence_rows(df):
    rows = [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


@pytest.mark.parametrize("postings,held", [(50_000, 400_000), (40, 10)])
def test_divergence(spark, monkeypatch, postings, held):
    """One block a language, and very many; counts kept to the end of a task, and sent on all the time."""
    monkeypatch.setattr(divergence, "HELD", held)
    monkeypatch.setattr(divergence, "SCATTER", 50 if held == 10 else 1_000_000)
    words = [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}" for i in range(60)] + ["Über", "été", "ÀB"]
    rows = []
    for i in range(400):
        lang, source = "en" if i % 3 else "de", f"s{0 if i % 2 else i % 11}"  # half of all in one source
        rows.append((i, " ".join(words[(i * 7 + k * k) % (20 + i % 44)] for k in range(i % 40)) + (" 1only2" if i == 5 else ""), lang, source))
    rows += [(1, None, "en", "empty"), (1, None, "en", "empty2"), (2, "a b", None, None), (3, "zz", "xx", "one"), (4, None, "xx", "two"), (5, "Zz-zZ\x00zz", "xx", "two"),
             (None, "word " * 30_000, "en", "s0"), (6, "WA WA", "en", "Z"), (6, "WA WA", "en", "Z")]
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("clash") for c in ("term", "n", "part", "item", "value", "rank", "base", "block", "p", "terms")}).repartition(5)
    for min_docs in (3, 1, 10_000):
        got = divergence_rows(divergence.divergence(docs, min_docs=min_docs, top=7, postings=postings))
        assert got == brute_divergence(rows, min_docs, 7)
    assert divergence.divergence(docs.where("false")).count() == 0


def test_shares_of_large_counts(spark):
    """10^9 times a count of 10^13 is beyond a long."""
    got = spark.range(1).select(divergence.share(F.lit(10**13 + 1), F.lit(3 * 10**13), F.lit(10**7)).alias("p")).first().p
    assert got == 1 + 10**9 * (10**13 + 6) // (3 * 10**13 + 5 * 10**7)


BIG = "<p>" + "x" * 2000 + "</p>"
PAGES = [
    (1, "http://h/1", BIG), (2, "http://h/2", BIG), (3, "http://h/3", "small"), (4, "http://h/4", "small"), (5, None, None), (6, "", ""), (7, "http://h/ü?a=b%20c", BIG),
    (7, "http://h/7", BIG), (8, " bad\r\nWARC-Type: metadata ", "a\r\n\r\nWARC/1.0\r\nContent-Length: 3\r\n\r\n" * 40), (9, "http://h/9", "é" * 500), (10, "http://h/10", "é" * 500),
    (11, "u", "y" * 999), (12, "u", "y" * 999), (13, "u", "z" * 3_000_000), (None, "n", BIG), (None, "n", "w" * 1500), (None, "n", "w" * 1500), (14, "u", "\x00\x01" * 600)]


def pages_of(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in ("digest", "n", "of", "again", "http", "first_id", "value")})


def brute_warc():
    last = {}
    for i, _, html in PAGES:
        last[html or ""] = max(-1 if i is None else i, last.get(html or "", -1))
    out = []
    for i, _, html in PAGES:
        raw = (html or "").encode()
        first = last[html or ""]
        again = len(raw) >= 1000 and first >= 0 and i != first
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def test_warc_round_trip(spark):
    got = warc.round_trip(pages_of(spark).repartition(3))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()), key=str) == brute_warc()
    assert warc.round_trip(pages_of(spark).where("false")).count() == 0


def test_warc_index_and_ranges(spark):
    """The index names exact byte ranges; chosen pages come back whole, a revisit through its response; damage is an error."""
    folder = shared_folder(spark)
    warc.write_archives(pages_of(spark).repartition(2), folder, records_per_file=4)
    entries = [r.asDict() for r in warc.index(spark, folder).collect()]
    assert len(entries) == len(PAGES) and len({e["file"] for e in entries}) >= 5
    for e in entries:
        with open(e["file"].removeprefix("file:").replace("//", "/"), "rb") as f:
            f.seek(e["offset"])
            raw = f.read(e["length"] + 4)
        assert raw.startswith(b"WARC/1.0\r\nWARC-Type: " + e["record_type"].encode()) and raw.endswith(b"\r\n\r\n")
    assert {e["url"] for e in entries if e["page_id"] == 8} == {"%20bad%0D%0AWARC-Type: metadata%20"}
    back = {r.page_id: r.payload for r in warc.resolve(spark, folder, F.col("page_id").isin(1, 8, 9, 13)).collect()}
    assert back == {i: h.encode() for i, _, h in PAGES if i in (1, 8, 9, 13)}
    few = warc.index(spark, folder).where("page_id IN (3, 13)")
    for gap, span, block in ((0, 1, 1), (1 << 30, 1 << 30, 1 << 40), (10, 100, 64)):
        assert {r.page_id: len(r.payload) for r in warc.read_records(few, gap=gap, span=span, block=block).collect()} == {3: 5, 13: 3_000_000}
    wrong = few.withColumn("length", F.col("length") - 1)
    with pytest.raises(Exception, match="does not have the digest"):
        warc.read_records(wrong).collect()


def test_ranges_are_coalesced_and_bounded():
    entries = [("a", 0, 10), ("a", 14, 10), ("a", 60, 10), ("a", 72, 50), ("b", 120, 5), ("b", 125, 500), ("b", 626, 1)]
    runs = list(warc._ranges(iter(entries), gap=5, span=40))
    assert [[e[1] for e in r] for r in runs] == [[0, 14], [60], [72], [120], [125], [626]]
