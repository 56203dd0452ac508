"""Which links of a section page lead to items. All entries are fixed values.

include: pattern on the raw href; exclude: pattern on the raw href; base: prefix of relative
links; longer_than: full URLs must be longer; dated: links whose block shows an older date are dropped.
"""

LINK_RULES = [
    # source_id, include, exclude, base, longer_than, dated
    ("baodauthau", r"-post\d+\.html|/thong-bao-moi-thau/|/(?:goi-thau|du-an|moi-thau)/",
     r"^(?:https://baodauthau\.vn)?/thong-bao-moi-thau/$", "https://baodauthau.vn", 30, True),
    ("chinhphu", r"-\d{10,20}\.htm$|chi-dao|quyet-dinh|thoi-su|chinh-sach", None, "https://baochinhphu.vn", 30, False),
    ("xaydungchinhsach", r"-\d+\.htm$|/tin-tuc/", None, "https://xaydungchinhsach.chinhphu.vn", 30, False),
    ("congbao", r"/(?:van-ban|noi-dung|chi-tiet)/|-\d+$", None, "https://congbao.chinhphu.vn", 25, False),
    ("vietnamnet", r"-\d+\.html$", r"^https://vietnamnet\.vn/video", "https://vietnamnet.vn", 30, False),
    ("vnexpress", r"^(?=.*(?:so-hoa|khoa-hoc|cong-nghe)).*-\d+\.html$", None, "https://vnexpress.net", 30, False),
    ("most_gov", r"tin-tuc|thong-bao|su-kien|van-ban|de-an|chuyen-doi-so|-\d+$|\.html?$", r"^(?:javascript|mailto):",
     "https://mst.gov.vn", 22, False),
    ("muasamcong", r"contractor|tender|bid|thong-bao|goi-thau|ke-hoach|chi-tiet", r"#$", "https://muasamcong.mpi.gov.vn", 25, False),
    ("hanoi_gov", r"^(?=.*(?:tin-tuc|chi-tiet|van-ban|thong-tin|su-kien|chi-dao)).*(?:\.html?|-\d+)$", None,
     "https://hanoi.gov.vn", 30, False),
    ("dauthau_asia", r"/thongbao/moithau/|/tenders/|/goi-thau/|-tender-|/\d+-[^/]+\.html$|/procurement/[^/]+",
     r"/thongbao/moithau/$|^#$|javascript:", "https://dauthau.asia", 28, True),
    ("dauthau_asia_news", r"/news/", r"/news/$", "https://dauthau.asia", 28, False),
]

SEARCH_RULES = [
    # source_id, article URL pattern, allowed hosts
    ("vietnamnet", r"https://vietnamnet\.vn/(?!video/).+-\d+\.html$", ["vietnamnet.vn", "www.vietnamnet.vn"]),
    ("vnexpress", r"https://vnexpress\.net/.+-\d+\.html$", ["vnexpress.net", "www.vnexpress.net"]),
    ("most_gov", r"https://mst\.gov\.vn/.+-\d{8,}\.html?$", ["mst.gov.vn", "www.mst.gov.vn"]),
]

# Files and paths a site walk never opens.
SKIP_EXTENSIONS = (
    r"(?i)\.(?:7z|avi|bin|bmp|css|csv|docx?|eot|exe|gif|gz|ico|jpe?g|js|json|m4a|mkv|mov|mp3|mp4|mpeg|pdf|png|pptx?"
    r"|rar|rss|svg|tar|tiff?|ttf|webm|webp|woff2?|xlsx?|xml|zip)(?:$|[?#])"
)
SKIP_PATHS = r"(?i)/(?:login|logout|signin|signup|register|cart|checkout|wp-admin)(?:/|$)"
# Paths that describe an organization.
PROFILE_PATHS = (
    r"(?i)about|gioi-thieu|company|profile|leadership|lanh-dao|team|contact|lien-he|service|san-pham|dich-vu|project"
    r"|du-an|case-stud|news|tin-tuc|career|tuyen-dung|job|tender|dau-thau|procurement|annual|report|bao-cao|nang-luc"
)
JOB_URL = r"(?i)^https://(?:www\.)?topcv\.vn/viec-lam/[^?#]+/\d+\.html"
