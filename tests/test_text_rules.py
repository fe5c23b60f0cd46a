"""Text rules at their edges, against small plain re-statements."""

import datetime as dt
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from dossier.functions import cleaning, constants as K, fields, text


def values(spark, inputs, rule, kind="string"):
    """Apply a column rule to a list of values, order kept."""
    df = spark.createDataFrame(list(enumerate(inputs)), f"i int, v {kind}")
    return [r[0] for r in df.select("i", rule(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def test_title_key_folds_case_width_and_space(spark):
    got = values(spark, ["ＡＩ　算力 深度", "Straße 1 x", "plain  Title\t", "É\x1fÀ"], text.normalize_title)
    assert got == ["ai算力深度", "strasse1x", "plaintitle", "éà"]


def test_theme_key_keeps_case(spark):
    assert values(spark, ["AI 算力", "ＡＩ算力", None], text.normalize_theme_name) == ["AI算力", "AI算力", ""]


def test_tag_keeps_single_spaces(spark):
    assert values(spark, ["　a \n b ", "  "], text.normalize_tag_name) == ["a b", ""]


def plain_name(name):
    s = "".join(unicodedata.normalize("NFKC", name or "").split()).upper()
    head = 0
    while True:
        for mark in ("S*ST", "SST", "*ST", "ST"):
            if s.startswith(mark, head):
                head += len(mark)
                break
        else:
            break
    if head == len(s):
        return s
    s = s[head:]
    while True:
        before = s
        for suffix in K.COMPANY_SUFFIXES:
            if s.endswith(suffix) and s != suffix:
                s = s[: -len(suffix)]
        if s == before:
            return s


def test_company_key_against_restatement(spark):
    rng = random.Random(7)
    parts = K.COMPANY_SUFFIXES + ["ST", "*ST", "S*ST", "Ａ", "万 科", "安洁", "tech", "SST"]
    names = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 5))) for _ in range(400)]
    names += ["ST", "*ST", "股份有限公司股份有限公司", "X股份公司控股", "集团公司", "公司", "ＳＴ 万科Ａ"]
    assert values(spark, names, text.normalize_name) == [plain_name(n) for n in names]


def test_lines_break_like_a_text_reader(spark):
    samples = ["a\r\nb\x0bc\x0cd\x1ce\x85f g ", "", "\n", "a\n\nb", "no break"]
    assert values(spark, samples, text.split_lines) == [s.splitlines() for s in samples]


def test_cleaning_keeps_tables_and_blank_lines(spark):
    md = "\n".join(
        [
            "<!-- Start of picture text -->2020 2021\n<br><!-- End of picture text -->",
            "# T [Table_Title]", "|---|---|", "", "- 12 -", " 3.5% 7.2% ", "资料来源：Wind",
            "图 3：增长", "图" + "长" * 41, "2024年1月5日 策略", "2024年1月", "<mark>重点</mark>", "前 请务必阅读正文之后的免责条款部分 后",
            "1234567890 1234567890", "—", "2024-01-02 is text", "body 12",
        ]
    )
    assert values(spark, [md], cleaning.clean_markdown)[0].split("\n") == [
        "# T", "|---|---|", "", "图" + "长" * 41, "2024年1月", "重点", "1234567890 1234567890", "—", "2024-01-02 is text", "body 12",
    ]


@pytest.mark.parametrize(
    "head,expected",
    [
        ("x 2024 年 12月 31日 y", dt.date(2024, 12, 31)),
        ("2024年13月1日 2024年5月6日\n2024/3/4", dt.date(2024, 3, 4)),
        ("2024/1/2 2024/5/2 2024/8/31\n2024.7.8", dt.date(2024, 7, 8)),
        ("2024-12-31-1", None),
        ("v1.2024/12/31", None),
        ("2024-2-30\nafter 2023-02-28.", None),
        ("2024-2-30\nafter 2023-02-28 x", dt.date(2023, 2, 28)),
        ("1999年1月1日", None),
        ("x" * 3000 + "2024年1月1日", dt.date(2024, 1, 1)),
    ],
)
def test_anchor_date(spark, head, expected):
    assert values(spark, [head], fields.anchor_publish_date) == [expected]


def test_anchor_date_of_the_first_characters(spark):
    assert values(spark, ["x" * 3000 + "2024年1月1日"], lambda c: fields.anchor_publish_date(c, 3000)) == [None]


def test_extracted_date_must_be_the_whole_text(spark):
    got = values(spark, ["2024-1-5", " 2024年01月05日 ", "2024.1.5x", "2024-13-1", None], fields.extracted_date)
    assert got == [dt.date(2024, 1, 5), dt.date(2024, 1, 5), None, None, None]


def test_codes_and_enumerations(spark):
    assert values(spark, ["SZ002635", "2635", None, "600-000"], fields.normalize_code) == ["002635", None, None, "600000"]
    assert values(spark, ["强烈推荐", " 卖出 ", "??", None], fields.map_stance) == ["推荐", "回避", "提及", "提及"]
    assert values(spark, ["观望", "??", None], fields.map_action) == ["中性", None, None]
    assert values(spark, ["深度跟踪", "行业点评", "晨会"], fields.map_report_type) == ["深度", "点评", "其他"]
    assert values(spark, ["688001", "301001", "920001", "200001"], fields.exchange_of) == ["SH", "SZ", "BJ", ""]
    assert values(spark, [" 基金 ", "基金重组", "昨日首板", "固态电池"], fields.is_noise_concept) == [True, False, True, False]


def test_code_source_is_a_plain_substring(spark):
    df = spark.createDataFrame([("002635", "x10026359"), ("002635", "none"), (None, "002635")], "c string, b string")
    got = [r[0] for r in df.select(fields.code_source(F.col("c"), F.col("b"))).collect()]
    assert got == ["text", "inferred", None]


def test_url_classes(spark):
    urls = {
        "https://example.com/a": "ok", "HTTP://Example.com": "ok", "ftp://example.com": "scheme_not_allowed",
        "https:///x": "no_host", "http://127.0.0.1:8080/": "host_not_allowed", "http://u:p@10.1.2.3/": "host_not_allowed",
        "http://172.15.0.1": "ok", "http://172.16.0.1": "host_not_allowed", "http://[::1]/": "host_not_allowed",
        "http://[2001:4860:4860::8888]/": "ok", "http://[fe80::1]/": "host_not_allowed", "http://0.0.0.0": "host_not_allowed",
        "http://192.0.0.9": "ok", "http://192.0.0.8": "host_not_allowed", "http://8.8.8.8": "ok", "http://100.64.0.1": "ok",
        "http://224.0.0.1": "ok", "http://240.0.0.1": "host_not_allowed", "http://010.0.0.1": "ok",
    }
    assert dict(zip(urls, values(spark, list(urls), fields.url_class))) == urls


def test_chunks_keep_the_overlapped_tail(spark):
    df = spark.createDataFrame([(1, "abcdefghij"), (2, "short"), (3, "abcde     "), (4, "")], "id int, body string")
    rows = cleaning.chunk_bodies(df, "body", max_chars=5, size=4, overlap=1).orderBy("id", "start").collect()
    assert [(r.id, r.chunk) for r in rows] == [(1, "abcd"), (1, "defg"), (1, "ghij"), (1, "j"), (2, "short"), (3, "abcd"), (3, "de  ")]


def test_outline(spark):
    md = "# A *b* #\n```\n# code\n```\n## A b\n~~~\n## no\n~~~\n####### no\n#no\n### A b-1\n## A b\n## 风险！提示"
    df = spark.createDataFrame([(1, md), (2, "text")], "id int, md string")
    rows = cleaning.heading_outline(df, "id", "md").orderBy("line_no").collect()
    assert [(r.level, r.heading, r.slug) for r in rows] == [
        (1, "A b", "a-b"), (2, "A b", "a-b-1"), (3, "A b-1", "a-b-1-1"), (2, "A b", "a-b-2"), (2, "风险！提示", "风险提示"),
    ]


def test_tokens(spark):
    assert values(spark, ["AI算力 芯", "Ünïcode 3D-打印机", None], fields.search_tokens) == [
        ["ai", "算力", "芯"], ["ünïcode", "3d", "打印", "印机"], [],
    ]


def test_highlight_and_filename(spark):
    assert values(spark, [" <EM class='a'>x</em>y ", None], text.strip_highlight) == ["xy", ""]
    assert values(spark, ['a/b:"c"\n', "", "长" * 90], text.safe_filename) == ["a_b_c_", "report", "长" * 90]


def test_settled_characters_equal_unicode_tables(spark):
    rng = random.Random(6)
    sure = [chr(c) for a, b in ((0x20, 0x7F), (0x4E00, 0x9FFF), (0xAC00, 0xD7A4), (0x400, 0x460), (0xC0, 0x180)) for c in rng.sample(range(a, b), 60)]
    odd = list("ＡＢ１２ﬁ①㈱ｶﾞがぎ̧́̈ßẞΣςİıǅ℡½") + [chr(c) for c in rng.sample(range(0xE000), 400) if not 0xD800 <= c < 0xE000] + ["\U0001D400", "\U00010400"]
    texts = ["".join(rng.choice(sure if rng.random() < 0.8 else odd) for _ in range(rng.randrange(1, 12))) for _ in range(3000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.nfkc(F.col("t")).alias("n"), text.normalize_title(F.col("t")).alias("k"))
    for r in rows.collect():
        assert r.n == unicodedata.normalize("NFKC", r.t)
        assert r.k == re.sub(r"\s+", "", unicodedata.normalize("NFKC", r.t).casefold())


def test_han_rows_stay_in_the_jvm(spark):
    han = spark.createDataFrame([("算力与人工智能",), ("AI 算力 2024 한국어 Привет été",)], "t string")
    assert han.where(F.col("t").rlike(text.unsettled(False)) | F.col("t").rlike(text.unsettled(True))).count() == 0
    assert spark.createDataFrame([("Ａ",), ("ﬁ",), ("e\u0301",), ("ß",)], "t string").where(F.col("t").rlike(text.unsettled(True))).count() == 4
