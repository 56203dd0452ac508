"""Literal cases of the column expressions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from opporta.functions import addresses, dates, ids, labels, money, phones, terms, text, url
from opporta.functions.places import with_location

def now():
    return F.lit(dt.datetime(2026, 8, 23, 14, 30)).cast("timestamp_ntz")


def run(spark, expr, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i INT, v STRING")
    return [r.out for r in df.select("i", expr(F.col("v")).alias("out")).orderBy("i").collect()]


def check(spark, expr, cases):
    got = run(spark, expr, [c[0] for c in cases])
    assert got == [c[1] for c in cases]


def test_canonical_url(spark):
    cases = [
        ("https://baodauthau.vn/tin-tuc.html?utm_source=facebook&utm_medium=cpc#section1", "https://baodauthau.vn/tin-tuc.html"),
        ("HTTP://WWW.Example.com/A/b//?b=2&REF=x&a=&c", "http://www.example.com/A/b?b=2"),
        ("https://example.com/", "https://example.com/"),
        ("https://example.com", "https://example.com"),
        ('"<https://example.com/x**/>"', "https://example.com/x"),
        ("https://e.com/a?q=chuyển đổi&x=a%20*b~", "https://e.com/a?q=chuy%E1%BB%83n+%C4%91%E1%BB%95i&x=a+%2Ab~"),
        ("https://e.com/a?q=100%", "https://e.com/a?q=100%25"),
        ("https://e.com/a/;p?x=1=2", "https://e.com/a;p?x=1%3D2"),
        ("e.com/a/", "e.com/a"),
        ("  ", ""), (None, ""),
    ]
    check(spark, url.canonical, cases)
    once = run(spark, url.canonical, [c[0] for c in cases])
    assert run(spark, url.canonical, once) == once


def test_canonical_url_agrees_with_standard_library(spark):
    import re
    from urllib.parse import parse_qsl, urlencode, urlparse, urlunparse
    drop = set(url.TRACKING_PARAMS)

    def expected(raw):
        p = urlparse(raw)
        q = urlencode([(k, v) for k, v in parse_qsl(p.query) if k.lower() not in drop])
        path = p.path.rstrip("/") if len(p.path) > 1 else p.path
        return urlunparse((p.scheme.lower(), re.sub("[*'\"`]+", "", p.netloc.lower()), path, p.params, q, ""))
    raw = [f"https://Ex{i}.com:8{i}/p/{i}/?a={c}&{c}=1&gclid=z&b=%2{i}{c}%zz" for i, c in enumerate("xé+%!~(*,;@/:$-_. ")]
    assert run(spark, url.canonical, raw) == [expected(r) for r in raw]


def test_source_url(spark):
    check(spark, url.source_url, [
        ("Example.com", "https://example.com/"), ("http://E.com:8080/a/?q=1#f", "http://e.com:8080/a?q=1"), ("", ""),
        ("https://e.com/a;x", "https://e.com/a"), ("https:///x", "https:///x")])


def test_fingerprint_ignores_tracking(spark):
    a, b = run(spark, ids.fingerprint, ["https://a.vn/x?utm_source=1", "https://A.vn/x/#t"])
    assert a == b and len(a) == 64


def test_urls_in_text(spark):
    check(spark, url.urls_in_text, [("see [a](https://a.vn/x). and https://a.vn/x/ or http://b.vn?q=1!", ["https://a.vn/x", "http://b.vn?q=1"])])


def test_currency(spark):
    def value(c):
        return money.currency(c)["value"]
    check(spark, value, [
        ("Gói thầu trị giá 4,5 tỷ VNĐ phục vụ số hóa", 4.5e9), ("Ngân sách dự kiến 300 triệu đồng", 3.0e8),
        ("Tổng mức đầu tư 12 tỷ 500 triệu", 1.25e10), ("Giá trị 15.000.000.000 đ", 1.5e10), ("12.500 triệu", 1.25e7),
        ("500.000 đồng", None), ("10 tin tức", None), ("3 trường", None), ("5 TỶ", 5e9), (None, None)])
    check(spark, lambda c: money.currency(c, compat=True)["value"], [("10 tin tức", 1e10), ("3 trường", 3e6)])
    got = run(spark, lambda c: money.currency(c)["matched"], ["trị giá 4,5 tỷ VNĐ phục vụ"])
    assert "4,5 tỷ" in got[0]


def test_money_label(spark):
    check(spark, lambda c: money.money_label(c.cast("double")), [
        ("1500000000", "1,5 tỷ VNĐ"), ("300000000", "300 triệu VNĐ"), ("950000", "950.000 VNĐ"), ("0", None), ("1234567890000", "1.234,57 tỷ VNĐ")])
    check(spark, lambda c: money.money_label(c.cast("double"), thousands=""), [
        ("1025000000", "1,02 tỷ VNĐ"), ("2405000000", "2,4 tỷ VNĐ"), ("999985000", "1000 triệu VNĐ"), ("1234567890000", "1234,57 tỷ VNĐ")])


def test_dates(spark):
    d = dt.datetime
    check(spark, lambda c: dates.parse_datetime(c, now()), [
        ("Ngày đăng: 24/08/2026 09:30", d(2026, 8, 24, 9, 30)), ("2026-08-23T07:00:00+07:00", d(2026, 8, 23, 7)),
        ("2026-08-23T07:00:00.123Z", d(2026, 8, 23, 7, 0, 0, 123000)), ("09:30:15 24/08/2026", d(2026, 8, 24, 9, 30, 15)),
        ("24-8-2026 9:05:07", d(2026, 8, 24, 9, 5, 7)), ("2026-08-24", d(2026, 8, 24)), ("2026/8/4", d(2026, 8, 4)),
        ("2026-08-24 10:11:12", d(2026, 8, 24, 10, 11, 12)), ("24.08.2026", d(2026, 8, 24)), ("vừa xong", d(2026, 8, 23, 14, 30)),
        ("3 giờ trước", d(2026, 8, 23, 11, 30)), ("2 ngày trước", d(2026, 8, 21, 14, 30)), ("hôm qua", d(2026, 8, 22, 14, 30)),
        ("đăng ngày 5/6/2026 lúc", d(2026, 6, 5)), ("32/01/2026", None), ("abc", None), ("", None),
        ("cập nhật: 24/08/2026", d(2026, 8, 24)), ("24/08-2026", d(2026, 8, 24))])


def test_published_candidate(spark):
    check(spark, lambda c: dates.published_candidate(c, now()), [
        ("hạn chót 24/08/2026", None), ("Thứ hai, 24/08/2026 08:15", dt.datetime(2026, 8, 24, 8, 15))])


def test_location(spark):
    df = spark.createDataFrame([("Dự án tại thành phố Hà Nội",), ("UBND TP. Hồ Chí Minh",), ("tỉnh Quảng Ninh và Hà Nội",), ("không",), ("hà nộix",)], "v STRING")
    got = [r.loc for r in with_location(df, F.col("v"), "loc").collect()]
    assert got == ["Hà Nội", "TP.HCM", "Hà Nội", None, None]


def test_contact(spark):
    sample = "Mọi chi tiết liên hệ ông Nguyễn Văn A, email: contact@dauthau.gov.vn, điện thoại 0912345678."
    assert run(spark, phones.first_email, [sample]) == ["contact@dauthau.gov.vn"]
    assert run(spark, phones.first_phone, [sample]) == ["0912345678"]
    assert run(spark, phones.contact_name, [sample])[0] is not None


def test_phones(spark):
    check(spark, phones.normalize_phones, [
        ("826891248", "0826891248"), ("+84 28 3773 1666 (ext. 2245)", "02837731666 máy lẻ 2245"),
        ("0904.634.288, 024.8888.4288", "0904634288; 02488884288"), ("#ERROR!", None), ("841234567", None),
        ("0904634288 hoặc 0904634288", "0904634288"), ("0084904634288", "0904634288"), (None, None)])
    once = run(spark, phones.normalize_phones, ["+84 28 3773 1666 (ext. 2245)", "0904.634.288, 024.8888.4288"])
    assert run(spark, phones.normalize_phones, once) == once


def test_public_url(spark):
    got = run(spark, addresses.url_problem, ["http://127.0.0.1/admin", "ftp://a.vn", "https://u:p@a.vn", "https://a.vn", "http://10.1.2.3", "http://8.8.8.8", "http://[::1]/", "http://x.local", "http:///x", "http://[2606:4700::1111]/"])
    assert [g is None for g in got] == [False, False, False, True, False, True, False, False, False, True]


def test_text(spark):
    check(spark, text.normalize, [(" ａ b\t\n c ", "a b c"), ("Chuyển đổi", "Chuyển đổi"), (None, "")])
    check(spark, text.slug, [("Chuyển đổi số", "chuyen-doi-so"), ("Đô thị -- 5G!", "do-thi-5g")])
    check(spark, lambda c: text.as_bool(c, True), [("Có", True), ("", True), ("no", False), (" X ", True)])


def test_terms_use_word_boundaries(spark):
    df = spark.createDataFrame([("Dự án AI tại Hà Nội, C++ và số hóa tài liệu",), ("tải xuống logistics",), ("ai_x GIS.",)], "v STRING")
    found = terms.with_term_hits(df, F.col("v"), ["AI", "GIS", "số hóa", "số hóa tài liệu", "C++", "++"], "h")
    assert [sorted(r.h) for r in found.collect()] == [[0, 2, 3, 4], [], [1]]


def test_labels(spark):
    check(spark, lambda c: labels.mapped(c, labels.TIMEFRAMES), [("1_day", "24 giờ qua"), ("x", "x")])
    check(spark, labels.hide_technical, [("Read timed out", None), ("Phần mềm", "Phần mềm"), (" ", None)])


def test_a_phone_is_looked_for_once(spark):
    """The text is searched once, not again for each use of what was found."""
    df = spark.createDataFrame([("Gọi 0912 345 678",)], "t string")
    plan = df.select(phones.first_phone(df.t).alias("p"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"(?U)[\s.-]") == 1
    plan = df.select(money.currency(df.t).alias("m"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") == 0


def test_amount_ends_where_the_text_goes_on(spark):
    texts = ["1,5 tỷ 200 triệu đồng", "10 tin", "3 tr. đồng", "12 trang", "gần 7,25 triệu", "1.000.000đồng", "5 tỷ đ", "2 tỷđa", "không có", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = [r.m for r in df.select("k", money.currency(df.t).alias("m")).orderBy("k").collect()]
    assert [m and (m.value, m.matched) for m in got] == [
        (1.7e9, "1,5 tỷ 200 triệu"), None, (3e6, "3 tr"), None, (7.25e6, "7,25 triệu"), (1e6, "1.000.000đồng"), (5e9, "5 tỷ đ"), None, None, None]
