"""Fixed values. They must equal the published vocabulary of the data, so they stand here as plain text."""

# Company-name suffixes, longest legal forms first; the order is part of the rule.
COMPANY_SUFFIXES = ["股份有限公司", "股份公司", "有限责任公司", "有限公司", "集团公司", "集团", "控股", "公司"]
ST_PREFIX = r"^(?:S?\*?ST)+"

# Stance words as written by extractors -> stance.
STANCES = {
    "买入": "推荐", "增持": "推荐", "推荐": "推荐", "强推": "推荐", "强烈推荐": "推荐",
    "提及": "提及", "中性": "提及", "持有": "提及", "关注": "提及",
    "回避": "回避", "减持": "回避", "卖出": "回避", "规避": "回避",
}
DEFAULT_STANCE = "提及"

# Rating words -> rating action.
ACTIONS = {
    "买入": "买入", "增持": "增持", "中性": "中性", "减持": "减持", "卖出": "卖出",
    "持有": "中性", "观望": "中性", "强烈推荐": "买入", "强推": "买入", "推荐": "买入",
}

# Substring -> report type; first match wins.
REPORT_TYPES = [
    ("深度", "深度"),
    ("点评", "点评"), ("跟踪", "点评"), ("动态", "点评"),
    ("策略", "策略"), ("行业", "策略"), ("宏观", "策略"),
]
DEFAULT_REPORT_TYPE = "其他"

# Security-code prefix -> exchange.
EXCHANGE_PREFIXES = {
    "SH": ["600", "601", "603", "605", "688", "689"],
    "SZ": ["000", "001", "002", "003", "300", "301", "302"],
    "BJ": ["43", "83", "87", "88", "92"],
}

# Concept boards that are market noise, not themes.
NOISE_NAMES = ["低价微盘股", "ST板块", "股权激励", "基金", "期货概念"]
NOISE_PARTS = [
    "昨日", "涨停", "连板", "触板", "重仓", "持股", "股通", "含可转债", "含H股", "含GDR",
    "百元股", "低价股", "高价股", "破净", "微盘", "大盘股", "中盘股", "小盘股", "ST股",
    "次新股", "科创板做市", "融资融券", "转融券", "富时罗素", "MSCI", "标普道琼斯",
    "央视50", "上证50", "上证180", "上证380", "中证500", "中证1000", "中证2000",
    "沪深300", "深证100", "创业板综", "科创板综", "AB股", "AH股", "B股", "H股", "GDR",
]

# Markdown residue of the PDF engine and lines that carry no body text.
PICTURE_TEXT = r"<!--\s*Start of picture text\s*-->.*?<!--\s*End of picture text\s*-->\n?"
HIDDEN_FIELD = r"\s*\[Table_\w+\]"
HIGHLIGHT_MARK = r"</?mark>"
DISCLAIMER = "请务必阅读正文之后的免责条款部分"  # anywhere in a line
FOOTER_LINES = [
    r"^[-—]*\s*\d+\s*[-—]*$",
    r"^资料来源[:：].*$",
    r"^图\s*[:：]?.{0,40}$",
    r"^\(?\d{4}[ /年]\d{1,2}[ /月]\d{1,2}[日)]?.{0,10}$",
]
BARE_NUMBERS = r"[\d\s%.\-]+"
BARE_NUMBERS_BELOW = 20

# Dates.
CJK_DATE = r"(20\d{2})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日"
NUMERIC_DATE = r"(?<![\d/.-])(20\d{2})[-/.](\d{1,2})[-/.](\d{1,2})(?![\d/.-])"
EXTRACTED_DATE = r"(20\d{2})[-/.年](\d{1,2})[-/.月](\d{1,2})日?"

# Connector payloads.
HIGHLIGHT_TAG = r"(?i)</?em[^>]*>"
PAYLOAD_DATE = r"(\d{4})-(\d{1,2})-(\d{1,2})"
FILENAME_ILLEGAL = r'[\\/:*?"<>|\r\n\t]+'
DOWNLOAD_KEYS = ["pdfurl", "url", "fileurl", "downloadurl"]

# Thresholds.
UPLOAD_MAX_BYTES = 50 * 1024 * 1024
UPLOAD_EXTENSIONS = [".pdf", ".docx"]
SCAN_MIN_CHARS_PER_PAGE = 30
MARKDOWN_MIN_CHARS = 200
MAX_INPUT_CHARS = 50_000
CHUNK_CHARS = 26_000
CHUNK_OVERLAP = 1_000
FUZZY_RATIO = 0.85
NEAR_RATIO = 0.5
NEAR_BANDS = [0.75, 0.65, 0.5]
NEAR_HINTS = 3
INFERRED_HINTS = 5
BRIDGE_SHARE = 0.6
RESTORE_DAYS = 30
EVIDENCE_REPORTS = 60
CURSOR_OVERLAP_HOURS = 1
CURSOR_MAX_DAYS = 7
CURSOR_DEFAULT_DAYS = 3
BACKOFF_SECONDS = [60, 300, 1500]
ALERT_EVERY = 5
