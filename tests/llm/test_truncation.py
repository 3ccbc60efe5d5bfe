import numpy as np

from sieveline.llm import truncation as T

RNG = np.random.default_rng(7)
PLACES = "Lam Mây Quế Sim Hà Rạng Châu Bồng".split()


def sentence():
    a, b, n = RNG.choice(PLACES), RNG.choice(PLACES), int(RNG.integers(1000, 9999))
    return str(RNG.choice([f"Nạn nhân ở xã {a} kể lại đã chuyển tiền cho người lạ.", f"Cơ quan chức năng xã {b} đã nhận {n} đơn trình báo.", "Nhóm này chuẩn bị sẵn kịch bản rất kỹ để tạo lòng tin.", f"Không có đơn vị nào tên như vậy ở huyện {a}."]))


def make(spark):
    rows, cut = [], set()
    for i in range(500):
        t = " ".join(sentence() for _ in range(int(RNG.integers(3, 12))))
        if i % 10 == 0 and len(t) > 200:
            t = t[:200]
            if not t.rstrip().endswith("."):
                cut.add(i)
        elif i % 25 == 1:
            t = t[:-1]  # finished, without its full stop
        elif i % 25 == 2:
            t += " (Hết)"
        elif i % 50 == 3:
            t = t[: len(t) // 2].rstrip(" .") + "…"
            if len(t.rpartition(" ")[2]) > 2:
                cut.add(i)
        rows.append((i, t, None, "s" if i % 3 else None, "x"))
    rows += [rows[5], (900, "", " ", "s", "x"), (901, None, None, "s", "x")]
    return spark.createDataFrame(rows, "id long, content string, prevention string, source string, limit string"), cut, {r[0]: r[1] for r in rows}


def test_cut_values_are_found(spark):
    df, cut, text = make(spark)
    got = T.cut_values(df, common=0.01).collect()
    found = {r["id"] for r in got}
    assert len(got) == len(found) and {r["field"] for r in got} == {"content"}
    assert len(found & cut) >= 0.85 * len(cut) and len(found - cut) <= 0.2 * len(cut)
    assert not {900, 901} & found
    assert any(r["limit"] == "chars:200" for r in got)
    shares = {(r["source"], r["field"]): r for r in T.cut_shares(df, common=0.01).collect()}
    assert set(shares) == {("s", "content"), (None, "content")}
    assert sum(r["n_values"] for r in shares.values()) == 500 and sum(r["n_cut"] for r in shares.values()) == len(found)


def test_empty_table(spark):
    df, *_ = make(spark)
    assert T.cut_values(df.limit(0)).count() == 0


def test_censored_likelihood_recovers_the_distribution():
    x = np.random.default_rng(0).normal(6.0, 0.5, 20_000)
    limit = 6.2
    cen = x > limit
    mu, sd = T.fit_censored(np.minimum(x, limit), np.ones(len(x)), cen)
    assert abs(mu - 6.0) < 0.02 and abs(sd - 0.5) < 0.02
    naive = np.minimum(x, limit).mean()
    assert abs(mu - 6.0) < abs(naive - 6.0)


def test_tokens_split_off_trailing_marks():
    t = T.tokens(["Một hai, ba.", "bốn…\nnăm"])
    assert t.doc.tolist() == [0, 0, 0, 1, 1] and t.stop.tolist() == [False, False, True, False, False]
    assert t.other.tolist() == [False, True, False, False, False] and t.terminal.tolist() == [False, False, False, True, False]
    assert t.last.tolist() == [False, False, True, True, True]
    assert T.tokens(["ba."]).literal[0] == T.tokens(["ba"]).literal[0] and T.tokens([]).doc.size == 0
