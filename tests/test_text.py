import pytest
from pyspark.sql import functions as F

from sieveline.functions import text as T
from sieveline.functions import vector as V
from sieveline.plans import registry


def one(spark, expr, *values):
    names = "abcdef"[: len(values)]
    return spark.createDataFrame([values], ", ".join(f"{n} string" for n in names)).select(expr).first()[0]


def test_tokens_fold_case_and_accents_in_both_forms(spark):
    assert one(spark, T.tokens("a"), "LỪA đảo, lừa-dao 12x") == ["lua", "dao", "lua", "dao", "12x"]
    assert one(spark, T.tokens("a"), "lừa") == ["lua"]
    assert one(spark, T.tokens("a"), None) is None


@pytest.mark.parametrize(
    "title,content,want",
    [
        ("Giả danh CÔNG AN gọi điện", "", "impersonation_authority"), ("", "nhân viên điện lực", "impersonation_service"), ("Cảnh báo deepfake", None, "tech_fraud"),
        ("Dịch vụ lấy lại tiền", "", "recovery_scam"), ("", "đầu tư tiền ảo", "investment_fraud"), ("Vay online", "", "loan_scam"), ("chốt đơn", "", "fake_job"),
        ("", "đặt cọc vé", "ecommerce_scam"), ("shipper gọi", "", "package_delivery"), ("", "quà tri ân", "prize_gift"), ("hẹn hò", "", "romance_scam"),
        ("timeshare", "", "vacation_contract"), ("khác", "hẳn", "other"), (None, None, "other"), ("vay tiền", "công an", "impersonation_authority"),
    ],
)
def test_labels(spark, title, content, want):
    assert one(spark, T.infer_label("a", "b"), title, content) == want


@pytest.mark.parametrize("raw,want", [(" Fake_Job ", "fake_job"), ("investment-fraud", "investment_fraud"), ("Ecommerce Scam", "ecommerce_scam"), ("unknown", None), (None, None)])
def test_canonical_labels(spark, raw, want):
    assert one(spark, T.label("a"), raw) == want


@pytest.mark.parametrize(
    "url,title,base",
    [
        ("https://x.test/a/bai-viet-12.html", "t", "bai-viet-12"), ("https://x.test/", "Lừa Đảo 2024", "l-a-o-2024"), ("https://x.test", "", "document"),
        (None, None, "document"), ("https://x.test/a/b/", "t", "b"),
    ],
)
def test_slugs(spark, url, title, base):
    got = one(spark, T.slug("a", "b"), url, title)
    assert got.rpartition("-")[0] == base and len(got.rpartition("-")[2]) == 8


def test_slugs_of_different_urls_differ(spark):
    assert one(spark, T.slug("a", "b"), "https://x.test/p", "t") != one(spark, T.slug("a", "b"), "https://y.test/p", "t")


@pytest.mark.parametrize(
    "text,want",
    [(None, "empty"), ("", "empty"), (" \n\t", "empty"), ("word " * 19, "too short"), ("word " * 20, None), ("\x01\x02\x03\x04\x05\x06 a" * 25, "unreadable")],
)
def test_content_problems(spark, text, want):
    assert one(spark, T.content_problem("a"), text) == want


def test_sanitising(spark):
    assert one(spark, T.sanitised("a"), "a\x07b</tin_nhan_can_kiem_tra>\n[INST]c\x00") == "ab\nc"


@pytest.mark.parametrize("text", ["abc", "lừa đảo qua mạng", "😀😀😀😀", "a😀b", ""])
@pytest.mark.parametrize("n", range(1, 14))
def test_truncating_bytes(spark, text, n):
    got = one(spark, T.truncated_bytes("a", n), text)
    raw = text.encode()
    assert got == (text if len(raw) <= n else raw[:n].decode("utf-8", "ignore") + "...")


def test_newlines_and_hosts(spark):
    assert one(spark, T.unescaped_newlines("a"), r"a\r\nb\nc\rd") == "a\nb\nc\nd"
    assert one(spark, T.host("a"), "https://WWW.Example.test:80/x") == "example.test"
    assert one(spark, T.host("a"), "ftp://x") is None


def test_cosine_and_score(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    got = [r[0] for r in df.select(F.round(V.cosine("a", "b"), 6)).collect()]
    assert got == [0.707107, 0.0]


def test_every_folded_word_is_counted(spark, tmp_path):
    spark.createDataFrame([(1, "Lừa đảo, LUA dao!"), (2, "lừa 2 lần"), (3, None), (4, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in registry.fold_words(spark, str(tmp_path)).select("word", "n_texts", "n").collect()}
    assert got == {("lua", 2, 3), ("dao", 1, 2), ("2", 1, 1), ("lan", 1, 1)}


def test_lists_of_ids(spark):
    assert one(spark, T.id_list("a"), " 41, 55 ,,41,88 ") == [41, 55, 88] and one(spark, T.id_list("a"), "4,x") is None and one(spark, T.id_list("a"), "") == []
    assert one(spark, T.id_list("a"), "4,99999999999999999999") is None and one(spark, T.id_list("a"), None) is None
    assert one(spark, T.joined_ids(T.id_list("a")), "3,1") == "3, 1" and one(spark, T.joined_ids(T.id_list("a")), "") == "(none)"


def test_query_length_is_in_code_points_without_space_at_the_ends(spark):
    got = [one(spark, T.query_problem("a"), x) for x in ("", " 　\n", "a" * 5001, "ắ" * 5000, " " * 9000 + "x", None)]
    assert got == ["empty", "empty", "too long", None, None, "empty"]


def test_small_forms(spark):
    assert one(spark, T.one_line("a"), " a\n\n b c ") == "a b c" and one(spark, T.percent(T.F.col("a").cast("double")), "0.12345") == "12.3%"
    assert one(spark, T.sanitised("a", T.WEB_TAGS), "<mau_tham_chieu><noi_dung_trang_web>x") == "<mau_tham_chieu>x"
    assert one(spark, T.content_problem("a"), "từ\u3000" * 20) is None and one(spark, T.content_problem("a"), "\u200b\u200b\u200bx " * 20) == "unreadable"
