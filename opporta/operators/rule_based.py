"""Extraction and scoring without a model."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opporta.functions import dates, money, once, phones, scan, text as tx
from opporta.functions.places import PROVINCES, listed_place

# Labels before an owner, words that no owner begins with, labels that end it, kinds of bodies, what bodies
# do, labels before a deadline, words of list pages, requirement words.
OWNER_LABELS = ["Chủ đầu tư", "Bên mời thầu", "Đơn vị yêu cầu", "Cơ quan ban hành", "Đơn vị thực hiện", "Cơ quan phê duyệt"]
NO_OWNER = ["khác", "từng", "hoặc"]
NEXT_LABELS = ["Mã", "Tên KHLCNT", "Tên gói thầu", "Địa chỉ", "Số quyết định", "Quyết định", "Phân loại"]
BODIES = [
    "UBND", "Ủy ban nhân dân", "HĐND", "Sở", "Ban Quản lý", "Ban Quản lý dự án", "Ban Khoa học, Công nghệ và Môi trường", "Ban Chỉ đạo", "Bộ", "Cục", "Tổng cục",
    "Trung tâm", "Văn phòng", "Viện", "Chi nhánh", "Tổng công ty", "Công ty", "Tập đoàn", "Bệnh viện", "Trường Đại học"]
ACTS = ["thông báo", "mời", "đã", "sẽ", "vừa", "tiếp tục", "triển khai", "ban hành", "ký kết", "có nhu cầu", "lựa chọn", "đề nghị", "yêu cầu"]
DEADLINE_LABELS = ["Thời điểm đóng thầu", "Hạn cuối nộp", "Thời hạn nộp hồ sơ", "Đóng thầu lúc", "Hạn chót"]
DEADLINE_WORDS = ["đóng thầu", "hạn nộp"]
NOISE_WORDS = ["Bảng giá", "Danh sách", "TOP 10", "Tra cứu", "không tìm được", "Đăng nhập", "Đăng ký"]
_NEED_WORDS = "triển khai|xây dựng|thuê dịch vụ|nâng cấp|số hóa|phần mềm|ocr|thị giác|camera|trí tuệ nhân tạo"

# Points and thresholds of the declared scoring rules.
WEIGHTS = {
    "concrete_project_or_tender": 25, "budget_gte_3b": 20, "budget_gte_5b_bonus": 5, "strategic_location": 10,
    "deadline_gte_5days": 10, "core_capability_match": 15, "has_contact_info": 10, "freshness_lte_3days": 5,
    "low_relevance_policy_only": -15, "expired_deadline": -30,
}
STRATEGIC_PLACES = ["Hà Nội", "TP.HCM", "Thành phố Hồ Chí Minh", "Đà Nẵng", "Hải Phòng", "Quảng Ninh", "Bình Dương"]
CALL_SCORE, EMAIL_SCORE = 90, 80


def _any_of(words: list[str]) -> str:
    """One of the words, the longest first; without regard to case."""
    return "(?iuU)\\b(?:" + "|".join(sorted(words, key=len, reverse=True)) + r")\b"


def _contains(text: Column, words: list[str]) -> Column:
    low, found = F.lower(text), F.lit(False)
    for word in dict.fromkeys(w.lower() for w in words):
        found = found | low.contains(word)
    return found


def _bare(text: Column) -> Column:
    return F.regexp_replace(tx.squeeze(text), r"^[ :\-,.;]+|[ :\-,.;]+$", "")


def _first_name(parts: Column, most: int) -> Column:
    """First part of 4 to `most` characters that is no heading of a list page."""
    return F.get(F.filter(F.transform(parts, _bare), lambda v: F.length(v).between(4, most) & ~_contains(v, NOISE_WORDS)), 0)


def _owners(text: Column) -> Column:
    """What follows an owner label in its line, up to the next label; empty where something else follows.

    Only lines with a label are cut, and each is cut at its labels, not matched from every place.
    """
    lines = F.filter(F.split(text, "\n"), lambda line: _contains(line, OWNER_LABELS))
    after = F.flatten(F.transform(lines, lambda line: F.slice(F.split(line, _any_of(OWNER_LABELS)), 2, F.size(F.split(line, _any_of(OWNER_LABELS))))))
    value = F.transform(after, lambda v: F.get(F.split(F.regexp_replace(v, r"^\s*:?\s*", ""), r"\s+" + _any_of(NEXT_LABELS)), 0))
    return F.filter(value, lambda v: ~v.rlike("^" + _any_of(NO_OWNER)))


def _actors(text: Column) -> Column:
    """Clauses from a body's name up to what it does."""
    clauses = F.filter(F.split(text, r"[.;\n]"), lambda c: _contains(c, BODIES))
    named = F.transform(clauses, lambda c: F.regexp_substr(c, F.lit(_any_of(BODIES) + r"\s+.*")))
    return F.transform(F.array_compact(named), lambda c: F.get(F.split(c, r"\s+" + _any_of(ACTS)), 0))


def organization_name(title: Column, text: Column, most_owner: int = 220, most_actor: int = 200) -> Column:
    """Labelled owner, else the organization that acts, else an organization before `:` in the title."""
    whole = F.concat_ws("\n", F.coalesce(title, F.lit("")), F.coalesce(text, F.lit("")))
    head = _bare(F.regexp_extract(title, r"^([^:–-]+)[:–-]", 1))
    return F.coalesce(
        F.when(_contains(whole, OWNER_LABELS), _first_name(_owners(whole), most_owner)),
        F.when(_contains(whole, BODIES), _first_name(_actors(whole), most_actor)),
        F.when(head.rlike("^" + _any_of(BODIES)) & ~_contains(head, NOISE_WORDS), F.trim(F.left(head, F.lit(most_actor)))))


def deadline(text: Column, now: Column) -> Column:
    """Date behind a deadline label and a colon, else the first day named right after a deadline word."""
    pieces = F.split(text, r"[\n,;]")
    labelled = F.get(F.filter(pieces, lambda p: _contains(p, DEADLINE_LABELS) & p.contains(":")), 0)
    value = F.get(F.split(labelled, _any_of(DEADLINE_LABELS) + r"\s*:\s*", 2), 1)
    worded = F.get(F.filter(pieces, lambda p: _contains(p, DEADLINE_WORDS)), 0)
    rest = F.get(F.split(worded, _any_of(DEADLINE_WORDS) + r"\s*(?:(?:vào|ngày|trước)\s*)?(?=\d)", 2), 1)
    day = F.regexp_substr(rest, F.lit(r"^\d{1,2}[/-]\d{1,2}[/-]\d{4}(?:\s+\d{1,2}:\d{1,2})?"))
    return F.when(_contains(text, DEADLINE_LABELS + DEADLINE_WORDS), F.coalesce(
        dates.parse_datetime(tx.squeeze(value), now), dates.parse_datetime(tx.squeeze(day), now)))


def need_sentences(text: Column) -> Column:
    """The first three sentences (21 to 249 characters) that speak of a requirement."""
    parts = F.transform(F.split(text, r"[.\n]+"), tx.squeeze)
    return F.slice(F.filter(parts, lambda s: F.length(s).between(21, 249) & F.lower(s).rlike(_NEED_WORDS)), 1, 3)


_PARTS = "organization string, due string, due_day string, needs array<string>, place int"
_LIST_WORDS = {"owner": OWNER_LABELS, "next": NEXT_LABELS, "body": BODIES, "act": ACTS, "noise": NOISE_WORDS, "due": DEADLINE_LABELS, "due word": DEADLINE_WORDS,
               "need": _NEED_WORDS.split("|"), "place": PROVINCES}


class TenderText:
    """What `organization_name`, `deadline`, `need_sentences` and `with_location` find, in one pass over title and text."""

    def __init__(self, most_owner: int = 220, most_actor: int = 200):
        self.words, self.most_owner, self.most_actor = scan.Words(_LIST_WORDS), most_owner, most_actor
        flat = lambda words: "(?i)\\b(?:" + "|".join(map(re.escape, sorted(words, key=len, reverse=True))) + ")\\b"
        self.no_owner, self.opening = re.compile(flat(NO_OWNER)), re.compile(flat(BODIES))
        self.due, self.due_word = re.compile(flat(DEADLINE_LABELS) + r"\s*:\s*"), re.compile(flat(DEADLINE_WORDS) + r"\s*(?:(?:vào|ngày|trước)\s*)?(?=\d)")
        self.day, self.heading = re.compile(r"\d{1,2}[/-]\d{1,2}[/-]\d{4}(?:\s+\d{1,2}:\d{1,2})?", re.ASCII), re.compile(r"([^:–-]+)[:–-]")

    @staticmethod
    def bare(text: str) -> str:
        return scan.squeezed(text).strip(" :-,.;")

    def is_noise(self, text: str) -> bool:
        low = scan.lowered(text)
        return any(w.lower() in low for w in NOISE_WORDS)

    def first_name(self, values: list[str], most: int) -> str | None:
        for value in map(self.bare, values):
            if 4 <= len(value) <= most and not self.is_noise(value):
                return value
        return None

    def owners(self, whole: str, found: dict) -> list[str]:
        nexts, out = scan.whole_words(found["next"], whole), []
        for _, end, own in scan.holding(scan.spans(whole, "\n"), found["owner"]):
            labels = scan.apart(scan.whole_words(own, whole))
            for k, (_, z, _) in enumerate(labels):
                upto = labels[k + 1][0] if k + 1 < len(labels) else end
                start = z + re.match(r"\s*:?\s*", whole[z:upto]).end()
                value = whole[start:scan.cut_before(whole, start, upto, nexts)]
                if not self.no_owner.match(value):
                    out.append(value)
        return out

    def actors(self, whole: str, found: dict) -> list[str]:
        acts, out = scan.whole_words(found["act"], whole), []
        for _, end, own in scan.holding(scan.spans(whole, ".;\n"), found["body"]):
            start = next((a for a, z, _ in scan.whole_words(own, whole) if z < end and whole[z].isspace()), None)
            if start is not None:
                stop = re.compile("[\r\x85\u2028\u2029]").search(whole, start, end)
                end = stop.start() if stop else end
                out.append(whole[start:scan.cut_before(whole, start, end, acts)])
        return out

    def read(self, title: str | None, text: str | None) -> tuple:
        body, at = text or "", len(title or "") + 1
        whole = f"{title or ''}\n{body}"
        found = self.words.found(scan.lowered(whole))
        inside = {k: [(a - at, z - at, p) for a, z, p in found[k] if a >= at] for k in ("due", "due word", "need", "place")}
        name = self.first_name(self.owners(whole, found), self.most_owner) if found["owner"] else None
        if name is None and found["body"]:
            name = self.first_name(self.actors(whole, found), self.most_actor)
        if name is None and title is not None and (m := self.heading.match(title)):
            head = self.bare(m.group(1))
            if self.opening.match(head) and not self.is_noise(head):
                name = head[:self.most_actor].strip(" ")
        due = day = None
        if inside["due"] or inside["due word"]:
            pieces = scan.spans(body, "\n,;")
            for a, z, _ in scan.holding(pieces, inside["due"]):
                if ":" in body[a:z]:
                    m = self.due.search(body[a:z])
                    due = body[a + m.end():z] if m else None
                    break
            for a, z, _ in scan.holding(pieces, inside["due word"])[:1]:
                m = self.due_word.search(body[a:z])
                d = self.day.match(body[a + m.end():z]) if m else None
                day = d.group() if d else None
        needs = []
        for a, z, _ in scan.holding(scan.spans(body, ".\n"), inside["need"]):
            sentence = scan.squeezed(body[a:z])
            if 21 <= len(sentence) <= 249:
                needs.append(sentence)
                if len(needs) == 3:
                    break
        places = scan.whole_words(inside["place"], body)
        return name, due, day, needs, min((p for *_, p in places), default=None)


_reader: list[TenderText] = []


def _read(titles: pa.Array, texts: pa.Array) -> pa.Array:
    if not _reader:
        _reader.append(TenderText())
    rows = [_reader[0].read(a, b) for a, b in zip(titles.to_pylist(), texts.to_pylist(), strict=True)]
    kinds = pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int32()
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["organization", "due", "due_day", "needs", "place"])


def extract_by_rules(items: DataFrame, now: Column) -> DataFrame:
    """Extraction columns from `title` and `raw_content` alone. `raw_content` should be normalized."""
    text = F.col("raw_content")
    read = F.arrow_udf(_read, _PARTS)(F.col("title"), text)
    staged = once(items.withColumn("_read", read), [*items.columns, "_read"], _money=money.currency(text), _title=F.trim(F.coalesce("title", F.lit(""))))
    own = F.when(F.col("_title").endswith("."), F.col("_title")).otherwise(F.concat("_title", F.lit(".")))
    needs = F.col("_read.needs")
    return staged.withColumns({
        "organization_name": F.col("_read.organization"), "location": listed_place(F.col("_read.place")),
        "need_summary": F.when(F.size(needs) > 0, F.concat(F.array_join(F.slice(needs, 1, 2), ". "), F.lit("."))).otherwise(own),
        "evidence": F.when(F.size(needs) > 0, needs).otherwise(F.array("_title")),
        "budget_value": F.col("_money.value"), "budget_text": F.col("_money.matched"),
        "contact_name": phones.contact_name(text), "contact_email": phones.first_email(text), "contact_phone": phones.first_phone(text),
        "deadline": F.coalesce(dates.parse_datetime(tx.squeeze(F.col("_read.due")), now), dates.parse_datetime(tx.squeeze(F.col("_read.due_day")), now))}).drop("_money", "_read", "_title")


def score_by_rules(leads: DataFrame, now: Column) -> DataFrame:
    """Add score, action and reasons from the declared weights. Marked `rules`; never mixed with model scores.

    leads: budget_value, deadline, location, published_at, contact_email, contact_phone, keywords_matched,
    is_project (a concrete project or tender), policy_only (general policy news).
    """
    budget, due = F.col("budget_value"), F.col("deadline")
    tests = {
        "concrete_project_or_tender": F.col("is_project"), "budget_gte_3b": budget >= 3e9, "budget_gte_5b_bonus": budget >= 5e9,
        "strategic_location": F.col("location").isin(*STRATEGIC_PLACES),
        "deadline_gte_5days": due >= F.timestamp_add("DAY", F.lit(5), now),
        "core_capability_match": F.size("keywords_matched") > 0,
        "has_contact_info": F.coalesce(tx.blank_to_null(F.col("contact_email")), tx.blank_to_null(F.col("contact_phone"))).isNotNull(),
        "freshness_lte_3days": F.col("published_at") >= F.timestamp_add("DAY", F.lit(-3), now),
        "low_relevance_policy_only": F.col("policy_only"), "expired_deadline": due < now,
    }
    hits = F.array_compact(F.array(*[F.when(t, F.struct(F.lit(n).alias("rule_name"), F.lit(WEIGHTS[n]).alias("points"))) for n, t in tests.items()]))
    total = F.aggregate("breakdown", F.lit(0), lambda a, b: a + b["points"])
    return leads.withColumn("breakdown", hits).withColumn(
        "score", F.greatest(F.lit(0), F.least(F.lit(100), total))).withColumns({
            "recommended_action": action_of(F.col("score")),
            "score_reasons": F.transform("breakdown", lambda b: F.concat(b["rule_name"], F.lit(": "), b["points"].cast("string"))),
            "evaluated_by": F.lit("rules")})


def action_of(score: Column) -> Column:
    return F.when(score >= CALL_SCORE, "CALL").when(score >= EMAIL_SCORE, "EMAIL").otherwise("NURTURE")
