"""Text functions as column expressions. Unless said otherwise a null input gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sieveline.schemas import SCAM_TYPES

#: Letters with diacritics, in lower case, and what each is folded to.
ACCENTED = "àáảãạăằắẳẵặâầấẩẫậèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵđ"
PLAIN = "a" * 17 + "e" * 11 + "i" * 5 + "o" * 17 + "u" * 11 + "y" * 5 + "d"
#: Combining marks of decomposed text.
MARKS = "̛̣̀́̃̉̂̆"

#: Keyword groups in order of priority; the first group with a hit names the type.
LABEL_KEYWORDS = (
    ("impersonation_authority", ("giả mạo công an", "giả danh công an", "công an", "cảnh sát", "viện kiểm sát", "tòa án", "bộ tài chính", "bộ công an", "cơ quan thuế", "cán bộ thuế", "vneid", "định danh điện tử", "căn cước", "cccd")),
    ("impersonation_service", ("điện lực", "nhân viên y tế", "bệnh viện", "cấp cứu", "nâng cấp sim", "nhà mạng", "nhân viên ngân hàng", "giả danh ngân hàng")),
    ("tech_fraud", ("deepfake", "trí tuệ nhân tạo", "công nghệ cao", "mã độc", "malware", "phần mềm độc hại", "phần mềm gián điệp", "chiếm đoạt tài khoản", "hack tài khoản", "hack facebook", "hack zalo", "ứng dụng giả mạo", "app giả mạo", "trạm bts", "bts giả")),
    ("recovery_scam", ("lấy lại tiền", "thu hồi tiền", "lấy lại tiền bị lừa", "hỗ trợ lấy lại")),
    ("investment_fraud", ("đầu tư", "forex", "crypto", "tiền ảo", "chứng khoán", "sàn giao dịch", "lợi nhuận cao", "ponzi", "lãi suất cao", "làm giàu")),
    ("loan_scam", ("vay tiền", "vay online", "tín dụng đen", "vay nặng lãi", "cho vay", "app vay", "mở thẻ tín dụng")),
    ("fake_job", ("việc nhẹ lương cao", "cộng tác viên online", "cộng tác viên", "nhấn like", "chốt đơn", "làm nhiệm vụ", "nhiệm vụ tiktok", "xuất khẩu lao động")),
    ("ecommerce_scam", ("đặt cọc", "bán hàng online", "vé máy bay", "tour du lịch", "combo du lịch", "mua hàng online", "đặt phòng")),
    ("package_delivery", ("shipper", "giao hàng", "bưu kiện", "bưu phẩm")),
    ("prize_gift", ("trúng thưởng", "tặng quà miễn phí", "quà tri ân", "tri ân", "nhận thưởng")),
    ("romance_scam", ("tình cảm", "hẹn hò", "kết bạn", "người nước ngoài", "gửi quà")),
    ("vacation_contract", ("hợp đồng kỳ nghỉ", "resort", "timeshare", "sở hữu kỳ nghỉ")),
)
#: What fences the parts of a prompt, and the tags taken out of text that goes into one.
MESSAGE_FENCE = ("<tin_nhan_can_kiem_tra>", "</tin_nhan_can_kiem_tra>")
REFERENCE_FENCE = ("<mau_tham_chieu>", "</mau_tham_chieu>")
MODEL_TAGS = ("<|im_start|>", "<|im_end|>", "[INST]", "[/INST]")
PROMPT_TAGS = (*MESSAGE_FENCE, *REFERENCE_FENCE, *MODEL_TAGS)
#: The same for a prompt about a web page.
WEB_TAGS = ("<noi_dung_trang_web>", "</noi_dung_trang_web>", *MODEL_TAGS)


def _column(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def trimmed(col: Column | str) -> Column:
    """Without white space at both ends: line breaks, tabs and the spaces of Unicode too."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def one_line(col: Column | str) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return trimmed(F.regexp_replace(col, r"(?U)\s+", " "))


def plural(n: Column | str) -> Column:
    """The ending of a noun after a number: empty for one."""
    return F.when(_column(n) == 1, "").otherwise("s")


def joined_ids(ids: Column | str) -> Column:
    """Numbers with commas between, or ``(none)``."""
    return F.when(F.size(ids) > 0, F.array_join(F.transform(ids, lambda i: i.cast("string")), ", ")).otherwise("(none)")


def id_list(col: Column | str) -> Column:
    """The different numbers of a comma list in order of appearance; null if a field that is not blank is no number."""
    fields = F.filter(F.transform(F.split(col, ","), trimmed), lambda f: f != "")
    ids = F.transform(fields, lambda f: F.when(f.rlike(r"^[+-]?\d+$"), f.try_cast("long")))
    return F.when(~F.exists(ids, lambda i: i.isNull()), F.array_distinct(ids))


def percent(share: Column | str) -> Column:
    """A share as a percentage with one digit."""
    return F.concat(F.format_string("%.1f", _column(share) * 100), F.lit("%"))


def bullets(items: Column | str, none: str = "") -> Column:
    """A line for each item, or ``none`` where there are no items."""
    return F.when(F.size(items) > 0, F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x, F.lit("\n"))), "")).otherwise(none)


def query_problem(col: Column | str, most: int = 5000) -> Column:
    """Why a query is not searched for, or null: without white space at the ends it has 1 to ``most`` code points. A null is ``empty``."""
    n = F.length(trimmed(F.coalesce(_column(col), F.lit(""))))
    return F.when(n == 0, "empty").when(n > most, "too long")


def folded(col: Column | str) -> Column:
    """Lower case without diacritics, in composed and decomposed text alike; đ is d."""
    return F.translate(F.lower(col), ACCENTED + MARKS, PLAIN)


def tokens(col: Column | str) -> Column:
    """Folded words, the longest runs of letters and digits, in order."""
    return F.filter(F.split(folded(col), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def label(col: Column | str) -> Column:
    """A stored type label in its canonical spelling; null for labels outside the known ones."""
    c = F.regexp_replace(F.lower(trimmed(col)), "[- ]", "_")
    return F.when(c.isin(*SCAM_TYPES), c)


def infer_label(title: Column | str, content: Column | str) -> Column:
    """The type whose keyword group is the first with a keyword in title or content, else ``other``.

    Nulls count as empty.
    """
    text = F.lower(F.concat_ws(" ", F.coalesce(_column(title), F.lit("")), F.coalesce(_column(content), F.lit(""))))
    out = None
    for name, words in LABEL_KEYWORDS:
        hit = text.rlike("|".join(words))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("other")


def preview(col: Column | str, n: int) -> Column:
    """The first ``n`` characters."""
    return F.substring(col, 1, n)


def host(col: Column | str) -> Column:
    """The host of a URL in lower case without one leading ``www.``; null where there is none."""
    return F.regexp_replace(F.lower(F.nullif(F.regexp_extract(col, r"^https?://([^/?#:]+)", 1), F.lit(""))), r"^www\.", "")


def slug(url: Column | str, title: Column | str) -> Column:
    """A file name: the URL's last path segment without its ending, else the title, else ``document``, and eight digits of the URL's SHA-1."""

    def simple(c: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9-]+", "-"), "-{2,}", "-"), "^-|-$", "")

    u = F.coalesce(_column(url), F.lit(""))
    t = F.coalesce(_column(title), F.lit(""))
    path = F.regexp_extract(u, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)
    last = F.regexp_extract(F.regexp_replace(path, "/+$", ""), r"([^/]*)$", 1)
    stem = F.regexp_replace(last, r"(.)\.[^.]*$", "$1")
    base = F.coalesce(F.nullif(simple(stem), F.lit("")), F.nullif(simple(t), F.lit("")), F.lit("document"))
    return F.concat_ws("-", base, F.substring(F.sha1(u), 1, 8))


def content_problem(col: Column | str) -> Column:
    """Why a text is not worth indexing, or null: checks in order of size, encoding, words, readable share.

    At most 10 MiB, valid UTF-8, 20 to 500,000 words between white space of Unicode, at least half of the
    characters readable: letters, marks, digits, punctuation, symbols and white space. A null text is ``empty``.
    """
    c = F.coalesce(_column(col), F.lit(""))
    n = F.size(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != ""))
    odd = F.length(c) - F.length(F.regexp_replace(c, r"(?U)[^\p{L}\p{M}\p{N}\p{P}\p{S}\s]", ""))
    return (
        F.when(F.octet_length(c) > 10 * 1024 * 1024, "too large")
        .when(~F.is_valid_utf8(c), "not utf-8")
        .when(n == 0, "empty")
        .when(n < 20, "too short")
        .when(n > 500_000, "too long")
        .when(odd * 2 > F.length(c), "unreadable")
    )


def unescaped_newlines(col: Column | str) -> Column:
    """Escape sequences written out as two characters turned into line breaks."""
    c = _column(col)
    return F.replace(F.replace(F.replace(c, F.lit("\\r\\n"), F.lit("\n")), F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\n"))


def sanitised(col: Column | str, tags: tuple[str, ...] = PROMPT_TAGS) -> Column:
    """Without bytes that are no UTF-8, control characters but line breaks and tabs, and ``tags``, one pass each in order."""
    c = _column(col)
    valid = F.when(F.is_valid_utf8(c), c).otherwise(F.replace(F.make_valid_utf8(c), F.lit("\ufffd"), F.lit("")))
    out = F.regexp_replace(valid, r"[\x00-\x08\x0b-\x1f]", "")
    for tag in tags:
        out = F.replace(out, F.lit(tag), F.lit(""))
    return out


def truncated_bytes(col: Column | str, n: int) -> Column:
    """At most ``n`` UTF-8 bytes, never half a character, with ``...`` where something was left out."""
    c = _column(col)
    b = F.encode(c, "UTF-8")
    # continuation bytes at the cut belong to a character that would not be whole
    back = F.lit(0)
    for k in (3, 2, 1):
        byte = F.conv(F.hex(F.substring(b, n + 1 - (k - 1), 1)), 16, 10).cast("int")
        back = F.when((byte < 128) | (byte >= 192), F.lit(k - 1)).otherwise(back) if k < 3 else F.when((byte < 128) | (byte >= 192), F.lit(2)).otherwise(F.lit(3))
    return F.when(F.octet_length(c) <= n, c).otherwise(F.concat(F.decode(F.substring(b, F.lit(1), F.lit(n) - back), "UTF-8"), F.lit("...")))
