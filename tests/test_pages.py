"""Literal cases of page reading, parsing and feeds."""

import datetime as dt
import json
import random

from pyspark.sql import functions as F

from opporta.functions.html import Page
from opporta.operators import feeds, links, parse
from opporta.operators.pages import read_page


def now():
    return F.lit(dt.datetime(2026, 8, 23, 14, 30)).cast("timestamp_ntz")


def raw(spark, rows):
    return spark.createDataFrame([(u, s, dt.datetime(2026, 8, 23), h) for u, s, h in rows],
                                 "url STRING, source_id STRING, fetched_at TIMESTAMP_NTZ, html STRING")


def parsed(spark, html, source="generic", url="https://example.vn/a-b"):
    return parse.parse_items(raw(spark, [(url, source, html)]), now()).collect()[0]


def test_clean_html():
    out = Page("<div class='title'>  UBND &nbsp; Tỉnh Quảng Ninh\n\t <script>alert(1)</script></div>").visible_text()
    assert "UBND" in out and "Quảng Ninh" in out and "alert" not in out and "\n" not in out


def test_clean_html_keeps_contacts_and_labels():
    out = Page("<nav>Menu</nav><a href='mailto:a@b.vn?subject=x'>Liên hệ</a><a href='tel:0912'>0912</a>"
               "<img alt='Logo'><p>**đậm** [x](http://y) `c`</p><footer>Chân</footer>").visible_text()
    assert out == "Menu Liên hệ [Email: a@b.vn] 0912 Logo đậm x c Chân"


def test_unclosed_markup_is_data():
    deep = "<p>" * 5000 + "x" + "</b></div>"
    assert read_page(deep, "http://a.vn/")["visible_text"] == "x"


def test_published_meta_beats_deadline_in_title(spark):
    row = parsed(spark, '<html><head><meta property="article:published_time" content="2026-08-23T07:00:00+07:00">'
                        '<meta property="article:modified_time" content="2026-08-25T07:00:00"></head>'
                        "<body><h1>Gói thầu hạn nộp 30/08/2026</h1><p>x</p></body></html>")
    assert row.published_at == dt.datetime(2026, 8, 23, 7)


def test_bare_title_date_is_no_evidence(spark):
    assert parsed(spark, "<h1>Mở thầu 24/08/2026</h1><p>nội dung</p>").published_at is None


def test_date_ranks(spark):
    ld = '<script type="application/ld+json">[{"a":{"datePublished":"2026-01-02"}}]</script>'
    assert parsed(spark, ld + "<p>Ngày đăng: 03/01/2026</p>").published_at == dt.datetime(2026, 1, 2)
    assert parsed(spark, "<p>Ngày đăng: 03/01/2026 08:00</p><time>04/01/2026</time>").published_at == dt.datetime(2026, 1, 3, 8)
    assert parsed(spark, "<h1><span class='date'>05/01/2026</span></h1><span class='post-date'>04/01/2026 10:00</span>").published_at == dt.datetime(2026, 1, 4, 10)
    assert parsed(spark, "<span class='date'>Hạn chót 04/01/2026</span>").published_at is None


def test_job_post(spark):
    ld = json.dumps({"@type": "JobPosting", "title": "Chuyên gia Chuyển đổi số", "datePosted": "2026-08-24",
                     "hiringOrganization": {"@type": "Organization", "name": "Công ty ABC"}})
    row = parsed(spark, f'<script type="application/ld+json">{ld}</script><h1>Khác</h1><p>Mô tả</p>', "topcv")
    assert (row.title, row.author, row.published_at) == ("Chuyên gia Chuyển đổi số", "Công ty ABC", dt.datetime(2026, 8, 24))
    assert row.raw_content.startswith("Đơn vị tuyển dụng: Công ty ABC\n") and row.error is None
    assert parsed(spark, "<p>chỉ có chữ</p>", "topcv").error == "no title"


def test_source_titles(spark):
    assert parsed(spark, "<title>Tin A - VnExpress Số hóa</title>", "vnexpress").title == "Tin A"
    assert parsed(spark, "<h1>Mua sắm công</h1>", "muasamcong").title.startswith("Thông báo Lựa chọn nhà thầu")
    assert parsed(spark, "<p>x</p>").title == "a b"
    row = parsed(spark, "<p>Chủ đầu tư Sở Y tế Mã KHLCNT PL1</p><p>Ngày đăng: 03/01/2026</p>", "dauthau_asia")
    assert row.raw_content.startswith("Chủ đầu tư: Sở Y tế\nNgày đăng: 03/01/2026 00:00\n")


def test_search_links(spark):
    html = ("<nav><li><a href='/menu-1.html'>số hóa</a></li></nav>"
            "<article><h3><a href='/bai-viet-123.html'>Bài</a></h3><p>về SỐ HÓA tài liệu</p></article>"
            "<article><a href='https://khac.vn/bai-1.html'>số hóa</a></article>"
            "<article><a href='/bai-khac-9.html'>không khớp</a></article>")
    found = links.page_links(raw(spark, [("https://vietnamnet.vn/tim-kiem?q=x", "vietnamnet", html)]), with_context=True)
    got = [r.target_url for r in links.search_links(found.withColumn("keyword", F.lit("số hóa"))).collect()]
    assert got == ["https://vietnamnet.vn/bai-viet-123.html"]


def test_section_links(spark):
    html = ("<div><a href='/goi-thau/mua-sam-he-thong-post12.html'>A</a> 01/08/2026</div>"
            "<div><a href='/goi-thau/mua-sam-he-thong-post13.html'>B</a> 22/08/2026</div>"
            "<div><a href='/thong-bao-moi-thau/'>menu</a><a href='/goi-thau/mua-sam-he-thong-post13.html'>B</a></div>")
    found = links.page_links(raw(spark, [("https://baodauthau.vn/thong-bao-moi-thau/", "baodauthau", html)]))
    since = F.lit(dt.datetime(2026, 8, 16)).cast("timestamp_ntz")
    got = [r.full_url for r in links.section_links(found, now(), since).collect()]
    assert got == ["https://baodauthau.vn/goi-thau/mua-sam-he-thong-post13.html"]
    assert links.section_links(found, now()).count() == 2


def test_job_cards(spark):
    html = ("<div class='job-item-2'><h3><a href='/viec-lam/ky-su-ai/111.html?ta=1'>Kỹ sư AI</a></h3>"
            "<a class='company'>Pro Công ty X</a><span>2 tuần trước</span></div>"
            "<div class='job-item'><a href='/viec-lam/ky-su-ai/111.html'>lặp</a></div>"
            "<div class='job-item'><a href='/khac'>không</a></div>")
    got = feeds.job_cards(raw(spark, [("https://www.topcv.vn/tim-viec-lam-ai", "topcv", html)]), now()).collect()
    assert [(r.url, r.title, r.company, r.published_at) for r in got] == [
        ("https://www.topcv.vn/viec-lam/ky-su-ai/111.html", "Kỹ sư AI", "Công ty X", dt.datetime(2026, 8, 9, 14, 30))]


def test_social_posts(spark):
    rows = [
        {"linkedinUrl": "https://www.linkedin.com/posts/1", "text": "Cần tìm\n giải pháp", "author": {"name": "An", "headline": "CIO", "company": {"name": "ABC"}}, "postedAt": 1787644800000},
        {"url": "https://other.com/1", "text": "x"}, {"url": "https://www.linkedin.com/posts/2", "text": ""},
        {"url": "https://www.linkedin.com/posts/1", "text": "lặp"},
        {"url": "https://linkedin.com/posts/3", "content": {"text": "b"}, "author": "Bình", "timestamp": "2026-08-25T08:00:00Z"}]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)], "position INT, body STRING")
    got = {r.url: r for r in feeds.social_posts(df, now()).collect()}
    assert set(got) == {"https://www.linkedin.com/posts/1", "https://linkedin.com/posts/3"}
    one = got["https://www.linkedin.com/posts/1"]
    assert one.title == "Cần tìm giải pháp" and one.author_company == "ABC"
    assert one.published_at == dt.datetime(2026, 8, 25, 8)
    assert one.raw_content.split("\n") == ["Cần tìm giải pháp", "Tác giả công khai: An", "Chức danh công khai: CIO", "Đơn vị công khai: ABC"]
    assert got["https://linkedin.com/posts/3"].published_at == dt.datetime(2026, 8, 25, 8)


def test_search_results(spark):
    bodies = [
        ("q1", {"results": {"items": [[{"link": "https://www.google.com/search?q=1", "title": "G"}], {"url": {"href": "https://abc.vn/?utm_source=x"}, "name": "ABC", "content": "c"}]}, "answer": {"text": "see https://xyz.vn/."}}),
        ("q2", [{"url": "http://127.0.0.1/"}, "https://d.vn/a and more"])]
    df = spark.createDataFrame([(q, json.dumps(b)) for q, b in bodies], "query STRING, body STRING")
    got = sorted((r.query, r.position, r.url, r.title) for r in feeds.search_results(df).collect())
    assert got == [("q1", 2, "https://abc.vn/", "ABC"), ("q1", 3, "https://xyz.vn", "xyz.vn"), ("q2", 2, "https://d.vn/a", "d.vn")]


def test_search_answers_are_opened_in_few_passes(spark, monkeypatch):
    """Items of one answer at different depths keep their order; three levels take one pass, and each item is read once."""
    passes, real = [], feeds.cut_lineage
    monkeypatch.setattr(feeds, "cut_lineage", lambda df: passes.append(1) or real(df))
    deep = {"items": ["https://a.vn/1", ["https://b.vn/2", {"url": "https://c.vn/3", "title": "C"}], {"data": {"note": "nothing"}}, "https://d.vn/4"]}
    df = spark.createDataFrame([("q", json.dumps({"results": deep}))], "query STRING, body STRING")
    got = sorted((r.position, r.url, r.title) for r in feeds.search_results(df).collect())
    assert got == [(1, "https://a.vn/1", "a.vn"), (2, "https://b.vn/2", "b.vn"), (3, "https://c.vn/3", "C"), (4, "https://d.vn/4", "d.vn")]
    assert len(passes) <= 2


def test_plain_markup_is_read_as_the_standard_parser_reads_it(monkeypatch):
    drawn = random.Random(5)
    pieces = ['<a href="/x">', '<a href="https://b.vn/c-1">', '<a href="HTTP://B.vn/c?d=1&amp;e">', "<a href='q'>", "</a>", '<div class="t" id="u">', "</div>", "<li>", "</li>", "<br>", "<br/>", "<P>", "<script>",
              "</script>", "<title>", "</title>", "<!-- c -->", "<!DOCTYPE html>", "text ", "a < b", "&amp;", "&am", "&lt", "<", ">", "12/3", "/2026", " \n", '<a b="c"d="e">', "<textarea>", "é ﬁ", "</", '<a b=""', "<nav>"]
    pages = ["".join(drawn.choice(pieces) for _ in range(drawn.randint(1, 14))) for _ in range(3000)]

    def read():
        return [([(n.tag, n.attrs, n.text, n.parent, n.end) for n in page.nodes], page.anchors("https://a.vn/x/y")) for page in map(Page, pages)]
    fast = read()
    monkeypatch.setattr(Page, "_read_plain", lambda self, markup: 0)
    assert fast == read()
    monkeypatch.undo()
    calls = []
    monkeypatch.setattr(Page, "feed", lambda self, markup: calls.append(markup))
    Page('<ul><li class="a">Tin <a href="/b">B</a></li></ul>')
    assert not calls  # plain markup never meets the standard parser


def test_pages_leave_in_small_batches(spark):
    from opporta.operators import pages as op
    raw = spark.createDataFrame([(f"https://a.vn/{k}", f'<a href="/{k}">é</a>', dt.datetime(2026, 1, 1)) for k in range(950)], "url string, html string, fetched_at timestamp_ntz").coalesce(1)
    got = op.with_page_fields(raw, ["url", "fetched_at"], ("links",))
    assert got.columns == ["url", "fetched_at", "links", "parse_error"]  # nothing that was not asked for
    rows = got.collect()
    assert [r.links[0].resolved for r in rows] == [r.url for r in rows] and len(rows) == 950


def test_links_of_a_batch_are_those_of_each_page():
    import pyarrow as pa

    from opporta.functions.link_batch import plain_links
    drawn = random.Random(7)
    tags = ["a", "a", "li", "li", "div", "tr", "article", "nav", "p", "b", "ul", "br", "img"]
    texts = ["x", " ", "12/03/1998", "1", "2/3/19", "98 ", " 1/2/2003", "/03/1998", "&amp;", "&", "é ", "A > b", "٣/2/2003"]
    attributes = ["", ' href="/a"', ' class="c" href=" /é "', ' title="x href=" href="/q"', ' href="/1" href="/2"', ' href=" "', ' href="/a&amp;b"', " href='x'", ' data-href="/d"', ' href="12/03/1999"']

    def page():
        out, opened = [], []
        for _ in range(drawn.randrange(24)):
            kind = drawn.random()
            if kind < .4:
                out.append(drawn.choice(texts[:7] if drawn.random() < .9 else texts))
            elif kind < .7 or not opened:
                tag = drawn.choice(tags) if drawn.random() < .99 else drawn.choice(["script", "textarea", "blockquote"])
                out.append(f"<{tag}{drawn.choice(attributes) if tag == 'a' else ''}>")
                opened += [tag] if tag not in ("br", "img") else []
            else:
                tag = opened.pop()
                out.append(f"</{tag if drawn.random() < .98 else 'i'}>")
        return "".join(out + [f"</{tag}>" for tag in reversed(opened) if drawn.random() < .97])

    pages = [None, "", "<b>", *(page() for _ in range(8000))]
    read, found = plain_links(pa.array(pages, pa.string()))
    got = {}
    for row in found.to_pylist():
        got.setdefault(row["page"], []).append((row["position"], row["href"], row["near_date"]))
    assert read.mean() > .4 and set(got) <= set(read.nonzero()[0])
    for n in read.nonzero()[0]:
        assert got.get(n, []) == [(x["position"], x["href"], x["near_date"]) for x in Page(pages[n] or "").anchors("https://a.vn/")[0]], pages[n]


def test_section_pages_are_read_without_a_walk(spark, monkeypatch):
    from opporta.functions import link_batch
    from opporta.operators import pages as op
    plain = "<ul><li class=\"i\"><a href=\"/goi-thau/mua-sam-he-thong-post{n}.html\">A</a> 0{n}/08/2026</li><li><p><b>x</b></p></li></ul><div><div><a href=\"/goi-thau/x-{n}\">B</a></div> 09/08/2026</div>"
    htmls = [plain.replace("{n}", str(n)) for n in range(1, 8)] + [None, "<li><a href='/q'>no end 01/02/2026", "<!-- c --><li><a href=\"/r\">r</a>01/02/2026</li>"]
    df = raw(spark, [(f"https://baodauthau.vn/{n}", "baodauthau", h) for n, h in enumerate(htmls)]).coalesce(1)
    assert link_batch.plain_links(op.pa.array(htmls))[0].tolist() == [True] * 8 + [False] * 2
    few = links.page_links(df, fields=links.SECTION_FIELDS)
    assert few.columns == ["page_url", "source_id", "position", "href", "near_date"]
    assert sorted(few.collect(), key=str) == sorted(links.page_links(df).select(*few.columns).collect(), key=str) and few.count() == 16


def test_plain_days_are_read_as_other_dates(spark):
    from opporta.functions import dates
    texts = ["1/2/2024", "31/02/2024", "29/02/2024", "0/1/2024", "12/13/2024", "01/02/0000", "1/2/2024\n", "1/2/20245", "1/2/2024 08:30"]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING").select("t", dates.parse_datetime(F.col("t"), now()).cast("string").alias("d"))
    assert {r.t: r.d for r in df.collect()} == {
        "1/2/2024": "2024-02-01 00:00:00", "31/02/2024": None, "29/02/2024": "2024-02-29 00:00:00", "0/1/2024": None, "12/13/2024": None, "01/02/0000": "0000-02-01 00:00:00",
        "1/2/2024\n": "2024-02-01 00:00:00", "1/2/20245": "2024-02-01 00:00:00", "1/2/2024 08:30": "2024-02-01 08:30:00"}
