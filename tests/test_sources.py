import json

import pytest
from pyspark.sql import functions as F

from hirelens.constants import CARD_COLUMNS
from hirelens.operators.collect import domain_filter, first_seen, require_id
from hirelens.session import settle, shared_folder
from hirelens.sources import files, listings, pages


def job(i, name="岗位", **kw):
    return {"encryptJobId": i, "jobName": name, "brandName": kw.get("brand", "公司"), "salaryDesc": "8-12K", "brandIndustry": kw.get("industry"),
            "welfareList": kw.get("welfare"), "skills": ["SQL", "Python"]}


RESPONSES = [
    {"code": 0, "keyword": "k", "page_no": 1, "zpData": {"jobList": [job("a", industry="银行"), job(None, industry="银行"), job("b", "fintech dev"), job("c")]}},
    {"code": "0", "keyword": "k", "page_no": 2, "zpData": {"jobList": [job("a", "later", industry="银行"), job("c", industry="保险")]}},
    {"keyword": "k", "page_no": 3, "zpData": {"jobList": []}},
    {"code": 37, "keyword": "k", "page_no": 4, "zpData": {"jobList": [job("x", industry="银行")]}},
    {"code": 121, "keyword": "k", "page_no": 5},
    {"code": 0, "keyword": "k", "page_no": 6},
]


@pytest.fixture(scope="module")
def listing_path(tmp_path_factory):
    path = tmp_path_factory.mktemp("listing")
    (path / "r.json").write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in RESPONSES), encoding="utf-8")
    return str(path)


def test_listing_to_postings(spark, listing_path):
    got = listings.read_listings(spark, listing_path)
    assert got.count() == 6
    kept = first_seen(domain_filter(require_id(got)), "job_id", ["keyword", "page_no", "pos_in_page"])
    rows = {r["job_id"]: (r["title"], r["page_no"]) for r in kept.collect()}
    # the third job fails the filter on page 1 and enters on page 2
    assert rows == {"a": ("岗位", 1), "b": ("fintech dev", 1), "c": ("岗位", 2)}
    named = listings.published_names(kept).where("job_id = 'a'").first()
    assert (named["技能标签"], named["福利标签"], named["职位描述"]) == ("SQL,Python", "", "")


def test_response_status(spark):
    df = spark.createDataFrame([("37",), ("0",), (None,), ("121",)], "code string")
    assert [r[0] for r in df.select(listings.response_status(F.col("code"))).collect()] == ["blocked", "ok", "ok", "error"]


GOOD = '{"code": 0, "keyword": "k", "page_no": 1, "zpData": {"jobList": [{"encryptJobId": "a"}]}}'
BAD = [GOOD[:60], "<html>", "[1]", f"[{GOOD}]", '"text"', "7", "null", '{"code": 0, "zpData": "oops"}', '{"code": 0, "page_no": "many"}', "[]", "{"]


def test_broken_responses_are_kept(spark, tmp_path):
    """Nothing that is not a response passes as an empty page; each comes out whole with its file."""
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "a.json").write_text("\n".join([GOOD, "", "  ", *BAD, '{"code": 37, "keyword": "k", "page_no": 2}', "{}"]), encoding="utf-8")
    got = listings.read_responses(spark, str(tmp_path / "one"))
    assert sorted(r.status for r in got.collect()) == ["blocked"] + ["error"] * len(BAD) + ["ok", "ok"]
    bad = listings.quarantine(got).collect()
    assert sorted(r.broken_text for r in bad if r.status == "error") == sorted(BAD)
    assert all(r.file.endswith("/one/a.json") for r in bad)
    assert [(r.code, r.page_no, r.broken_text) for r in bad if r.status == "blocked"] == [("37", 2, None)]
    assert [r.job_id for r in listings.read_listings(spark, str(tmp_path / "one")).collect()] == ["a"]
    whole = tmp_path / "whole"
    whole.mkdir()
    (whole / "good.json").write_text(GOOD.replace(", ", ",\n"), encoding="utf-8")
    (whole / "page.html").write_text("<html>\n<body>verify</body>\n</html>", encoding="utf-8")
    got = listings.read_responses(spark, str(whole), multi_line=True)
    assert sorted((r.status, r.broken_text) for r in got.collect()) == [("error", "<html>\n<body>verify</body>\n</html>"), ("ok", None)]
    assert listings.read_listings(spark, str(whole), multi_line=True).count() == 1


DETAIL = [
    ('<div class="job-sec-text fold">first<br>line<div>inner</div></div><p>out</p>', "firstlineinner"),
    ('<div class="job-sec-text">  </div><div class="job-sec"><h3>t</h3><div class="text"> second </div></div>', "second"),
    ('<section class="x-job-sec-y"><span class="text">sixth</span></section>', "sixth"),
    ('<div class="text">no parent</div>', ""),
    ("", ""), (None, ""),
]


def test_detail_description(spark):
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(DETAIL)], "i int, html string")
    assert [r["description"] for r in pages.extract_description(df).orderBy("i").collect()] == [w for _, w in DETAIL]


def test_detail_status(spark):
    df = spark.createDataFrame(
        [(404, "u", ""), (403, "u", "t"), (200, "https://x/security-check", "t"), (200, "u", "  "), (200, "u", "t"), (None, None, "t"), (200, None, "t")],
        "s int, u string, t string")
    got = [r[0] for r in df.select(pages.detail_status(F.col("s"), F.col("u"), F.col("t"))).collect()]
    assert got == ["closed", "failed", "failed", "empty", "ok", "failed", "ok"]


def card(name="岗位", company="公司", salary="1-2万", info=("上海", "1-3年", "本科"), tags=("SQL", "Excel"), firm=("民营",)):
    cut = lambda cls, v: f'<span class="{cls}"> {v} </span>' if v is not None else ""
    return (
        '<div class="joblist-box__item clearfix">' + cut("jobinfo__name", name) + cut("jobinfo__salary", salary)
        + "".join(f'<div class="jobinfo__other-info-item"><span>{i}</span></div>' for i in info)
        + '<div class="jobinfo__tag">' + "".join(f'<span class="joblist-box__item-tag">{t}</span>' for t in tags) + "</div>"
        + cut("companyinfo__name", company)
        + '<div class="companyinfo__tag">' + "".join(f'<span class="joblist-box__item-tag">{t}</span>' for t in firm) + "</div></div>")


def test_cards(spark):
    html = "<div class='positionlist'>" + "".join([
        card(), card(info=()), card(info=("北京",)), card(info=("北京", "3-5年")), card(tags=(), firm=()), card(salary=None), card(company=None)]) + "</div>"
    rows = pages.extract_cards(spark.createDataFrame([("u", html)], "page_url string, html string"))
    assert rows.columns == ["page_url", *CARD_COLUMNS]
    got = [tuple(r)[1:] for r in rows.collect()]
    assert got == [
        ("岗位", "公司", "1-2万", "1-3年,本科", "上海", "SQL,Excel", "民营"),
        ("岗位", "公司", "1-2万", ",", "", "SQL,Excel", "民营"),
        ("岗位", "公司", "1-2万", ",", "北京", "SQL,Excel", "民营"),
        ("岗位", "公司", "1-2万", "3-5年,", "北京", "SQL,Excel", "民营"),
        ("岗位", "公司", "1-2万", "1-3年,本科", "上海", "暂无", "暂无"),
    ]


@pytest.mark.parametrize("tag, quote", [("div", '"'), ("li", "'"), ("span", '"'), ("div", "'")])
def test_card_tags_in_any_element(spark, tag, quote):
    """The tag block ends where its own element ends, whatever stands inside; blocks that are not tags lend none."""
    one = lambda t: f"<{tag} class={quote}joblist-box__item-tag{quote}><b>{t}</b></{tag}>"
    html = (
        '<div class="joblist-box__item"><a class="jobinfo__name">n</a><i class="jobinfo__salary">s</i>' + one("outside")
        + f'<div class="jobinfo__tag"><div>{one("Java")}</div>{one("SQL")}</div><div><div class="companyinfo__name">c</div>'
        + f'<div class="companyinfo__tag">{one("民营")}</div></div></div>')
    row = pages.extract_cards(spark.createDataFrame([("u", html)], "page_url string, html string")).first()
    assert (row[CARD_COLUMNS[5]], row[CARD_COLUMNS[6]]) == ("Java,SQL", "民营")


PLAIN = [card(), card(tags=("R&amp;D", "a &lt; b")), "<ul><LI CLASS='x joblist-box__item'>a<br/>b<p class=\"jobinfo__name\">n</ul>tail", "x</b></p>y<i>z", "",
         "<div class='a' class=\"joblist-box__item\"><div/><hr class='jobinfo__name'>t</div>", "no tags", "<a title=\" class='b'\" data-x='1' >&copy; &nbsp;</a>"]
ODD = ["a < b <p>c</p>", "<!-- <p> --><p class='jobinfo__name'>x</p>", "<script>if (a<b) '</p>'</script><p>y</p>", "<p class=bare>z</p>", "<p class='a>b'>q</p>",
       "<p>cut off <b", "<p>t</p> &am", "<!doctype html><p>x</p>", "<p disabled class='n'>v</p>", "<title><b></title>w", "<p class='R&amp;D'>e</p>", "<?x?><p>1</p>"]


@pytest.mark.parametrize("html", PLAIN + ODD)
def test_pages_of_plain_tags_read_as_fed(html, monkeypatch):
    """The cut of plain pages gives what HTMLParser gives, also inside a card; only other pages reach it (F12)."""
    class Seen(pages._Elements):
        def __init__(self):
            super().__init__()
            self.seen = []

        def opened(self):
            self.seen.append(("open", list(self.open)))

        def closed(self):
            self.seen.append(("closed", list(self.open)))

        def handle_data(self, data):
            self.seen.append(("text", data))

    inside = f'<div class="joblist-box__item"><a class="jobinfo__name">n</a><i class="jobinfo__salary">s</i><b class="companyinfo__name">{html}</b></div>'
    for page in (html, inside):
        fed, read, cards = Seen(), Seen(), pages._Cards()
        fed.feed(page), read.read(page), cards.feed(page)
        assert read.seen == fed.seen
        got = pages._Cards()
        got.read(page)
        assert got.cards == cards.cards
    if html in PLAIN:
        monkeypatch.setattr(pages._Elements, "feed", None)
        Seen().read(inside)


def test_snapshot_written_back_to_its_place(spark):
    base = shared_folder(spark)
    df = spark.createDataFrame([(i, "old") for i in range(50)], "n int, title string")
    files.write_snapshot(df, f"{base}/s")
    files.write_snapshot(files.read_snapshot(spark, f"{base}/s").withColumn("title", F.lit("new")), f"{base}/s")
    bad = df.withColumn("title", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        files.write_snapshot(bad, f"{base}/s")
    rows = files.read_snapshot(spark, f"{base}/s").collect()
    assert len(rows) == 50 and {r["title"] for r in rows} == {"new"}


def test_query_parts(spark):
    df = spark.createDataFrame([("https://sou.example.com/?jl=765&kw=finance&p=3",), ("not a url",), ("https://x/?p=a",)], "url string")
    rows = [tuple(r)[1:] for r in pages.parse_query(df).collect()]
    assert rows == [("765", "finance", 3), (None, None, None), (None, None, None)]
    assert pages.page_range(pages.parse_query(df), 1, 3).count() == 1


def test_snapshot_append_export(spark):
    base = shared_folder(spark)
    df = spark.createDataFrame([("a", "x", None, ["p", "q"]), (None, "y", "d", None)], "job_id string, title string, description string, tags array<string>")
    assert files.write_snapshot(df, f"{base}/s") and not files.write_snapshot(df.where("title = 'z'"), f"{base}/s")
    back = files.read_snapshot(spark, f"{base}/s")
    assert sorted((r["job_id"], r["description"]) for r in back.collect()) == [("", "d"), ("a", "")]
    files.append_page(df, f"{base}/a")
    files.append_page(df, f"{base}/a")
    assert spark.read.parquet(f"{base}/a").count() == 4
    path = files.export_final(df, base)
    out = spark.read.option("header", True).csv(path)
    assert out.columns == ["title", "description", "tags"] and {r["tags"] for r in out.collect()} == {"p,q", None}
    files.export_cleaned(df, f"{base}/c")
    assert spark.read.option("header", True).csv(f"{base}/c").columns == df.columns


def test_union_sources(spark):
    one, two = spark.createDataFrame([("a", 1)], "t string, n int"), spark.createDataFrame([("b",)], "t string")
    rows = sorted(tuple(r) for r in files.union_sources({"BOSS直聘": one, "智联招聘": two}).select("t", "n", "source").collect())
    assert rows == [("a", 1, "boss"), ("b", None, "zhaopin")]


def test_settled_table_survives(spark):
    df = settle(spark.range(10).withColumn("x", F.rand()))
    assert df.collect() == df.collect()
