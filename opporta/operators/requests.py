"""Request tables for an external model service: one rendered text per item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opporta.functions import text as tx

# Words for what is unknown, and how much evidence a score request shows.
UNKNOWN = {
    "source": "không xác định", "keywords": "Không có keyword khớp được ghi nhận", "date": "Chưa rõ",
    "budget": "Chưa xác định", "summary": "Chưa có tóm tắt", "categories": "Chưa phân loại", "location": "Chưa xác định",
    "contact": "Không có", "evidence": "- Không có minh chứng chi tiết",
}
EVIDENCE_ITEMS, EVIDENCE_CHARS = 10, 500
TEMPLATE_CHARS = (100, 30_000)

DEFAULT_TEMPLATES = {
    "extraction": "Trích xuất một JSON object gồm tổ chức, nhu cầu, ngân sách, địa bàn, liên hệ và hạn chót. "
                  "Chỉ dùng điều có trong nội dung; không có bằng chứng thì trả null.",
    "scoring": "Chấm điểm cơ hội từ 0 đến 100 theo nhu cầu, ý định mua, ngân sách, thời hạn, địa bàn và đầu mối liên hệ. "
               "Chọn CALL, EMAIL hoặc NURTURE và nêu lý do có bằng chứng.",
    "sales": "Viết kịch bản tiếp cận phù hợp với hành động đã chọn: đối tượng, kênh, mở đầu, giá trị, câu hỏi và bước tiếp theo. "
             "Không thêm dữ kiện không có trong hồ sơ.",
    "profile": "Tạo một hồ sơ tổ chức dạng JSON từ dữ liệu vòng 1 và các trang đã đọc. "
               "Mọi mục phải có source_url nguyên văn trong dữ liệu và evidence_text trực tiếp.",
    "query": "Tạo đúng một truy vấn tìm website chính thức của tổ chức, dạng JSON {\"queries\": [...]}.",
}


def checked_template(text: str) -> str:
    least, most = TEMPLATE_CHARS
    value = (text or "").strip()
    if not least <= len(value) <= most:
        raise ValueError(f"a template needs {least} to {most} characters")
    return value


def _or(value: Column, what: str) -> Column:
    return F.coalesce(tx.blank_to_null(value), F.lit(UNKNOWN[what]))


def _list(values: Column, what: str) -> Column:
    kept = F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.trim(v)), lambda v: v != "")
    return _or(F.array_join(kept, ", "), what)


def _lines(*pairs: tuple[str, Column]) -> Column:
    return F.concat_ws("\n", *[F.concat(F.lit(f"- {label}: "), value) for label, value in pairs])


def evidence_lines(evidence: Column) -> Column:
    """The first ten non-blank items, each cut to 500 characters with `...`."""
    full = F.filter(F.transform(F.coalesce(evidence, F.array().cast("array<string>")), lambda v: F.trim(v)), lambda v: v != "")
    cut = F.transform(F.slice(full, 1, EVIDENCE_ITEMS), lambda v: F.concat(
        F.lit("- "), F.when(F.length(v) > EVIDENCE_CHARS, F.concat(F.left(v, F.lit(EVIDENCE_CHARS)), F.lit("..."))).otherwise(v)))
    return _or(F.array_join(cut, "\n"), "evidence")


def budget_text(value: Column) -> Column:
    """Whole amount with grouped thousands; halves go to the even number."""
    return _or(F.concat(F.format_number(F.bround(value), 0), F.lit(" VNĐ")), "budget")


def extraction_requests(items: DataFrame, template: str = DEFAULT_TEMPLATES["extraction"]) -> DataFrame:
    body = F.concat(
        F.lit(checked_template(template) + "\n\n"),
        _lines(("Nguồn", _or(F.col("source_id"), "source")), ("Keyword khớp", _list(F.col("matched_keywords"), "keywords")),
               ("Tiêu đề", F.coalesce("title", F.lit("")))),
        F.lit("\n- Nội dung gốc:\n"), F.coalesce("raw_content", F.lit("")))
    return items.select("doc_url", F.lit("extraction").alias("kind"), body.alias("request"))


def score_requests(leads: DataFrame, now: Column, scoring: str = DEFAULT_TEMPLATES["scoring"], sales: str = DEFAULT_TEMPLATES["sales"]) -> DataFrame:
    def day(value: Column) -> Column:
        return _or(F.date_format(value, "yyyy-MM-dd"), "date")
    facts = _lines(
        ("Tiêu đề", F.coalesce("title", F.lit(""))), ("Nhu cầu", _or(F.col("need_summary"), "summary")),
        ("Nhóm nhu cầu", _list(F.col("need_categories"), "categories")), ("Ngân sách", budget_text(F.col("budget_value"))),
        ("Địa bàn", _or(F.col("location"), "location")), ("Email công khai", _or(F.col("contact_email"), "contact")),
        ("Số điện thoại công khai", _or(F.col("contact_phone"), "contact")), ("Ngày đăng", day(F.col("published_at"))),
        ("Hạn chót", day(F.col("deadline"))), ("Ngày đánh giá", F.date_format(now, "yyyy-MM-dd")),
        ("Mức độ phù hợp vòng 1", F.coalesce(F.col("relevance").cast("string"), F.lit("0.0"))),
        ("Keyword khớp ở vòng lọc", _list(F.col("keywords_matched"), "keywords")))
    body = F.concat(F.lit(checked_template(scoring) + "\n\n" + checked_template(sales) + "\n\n"), facts,
                    F.lit("\n- Minh chứng:\n"), evidence_lines(F.col("evidence")))
    return leads.select("doc_url", F.lit("score").alias("kind"), body.alias("request"))


def profile_requests(orgs: DataFrame, template: str = DEFAULT_TEMPLATES["profile"]) -> DataFrame:
    """orgs: doc_url, organization_name, organization_type, organization_tax_code, official_url, context, supplement."""
    body = F.concat(
        F.lit(checked_template(template) + "\n\n"),
        _lines(("Tổ chức", F.col("organization_name")), ("Loại tổ chức", _or(F.col("organization_type"), "date")),
               ("Mã số thuế", _or(F.col("organization_tax_code"), "location")), ("Website", _or(F.col("official_url"), "contact"))),
        F.lit("\n- Trang đã đọc:\n"), F.coalesce(tx.blank_to_null(F.col("context")), F.lit("(không có website chính thức)")),
        F.coalesce(F.concat(F.lit("\n- Bổ sung:\n"), tx.blank_to_null(F.col("supplement"))), F.lit("")))
    return orgs.select("doc_url", F.lit("profile").alias("kind"), body.alias("request"))


def query_requests(orgs: DataFrame, template: str = DEFAULT_TEMPLATES["query"] + " Chỉ tìm trang do chính tổ chức vận hành.") -> DataFrame:
    body = F.concat(
        F.lit(checked_template(template) + "\n\n"),
        _lines(("Tổ chức", F.col("organization_name")), ("Mã số thuế", _or(F.col("organization_tax_code"), "contact")),
               ("Địa điểm", _or(F.col("location"), "contact"))))
    return orgs.select("doc_url", F.lit("query").alias("kind"), body.alias("request"))
