from __future__ import annotations

import unicodedata

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import similarity as S
from tallyspark.functions import text as T


def one(spark, f, *values, kinds=None):
    names = [f"c{i}" for i in range(len(values))]
    df = spark.createDataFrame([values], ", ".join(f"{n} {k}" for n, k in zip(names, kinds or ["string"] * len(values))))
    return df.select(f(*map(F.col, names)).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "unit"),
    [(u, "м2") for u in ("кв.м", "кв м", "кв. м", "м.кв", "м кв", "КВ.М", "м²")]
    + [(u, "м3") for u in ("куб.м", "куб. м", "м.куб", "м³")]
    + [(u, "м") for u in ("пог.м", "пог. м", "п.м", "м.п", "мп")]
    + [("к-т", "компл"), ("комплект", "компл"), ("вимір.", "вимір"), ("", ""), (None, ""), ("щось", "щось")],
)
def test_units(spark, raw, unit):
    assert one(spark, T.normalise_unit, raw) == unit


@pytest.mark.parametrize(("raw", "value"), [("9,690009", 9.690009), ("1 234,56", 1234.56), ("13,84287", 13.84287), ("", None), ("не число", None), (None, None), ("nan", None), ("inf", None), ("1e5", 1e5)])
def test_numbers(spark, raw, value):
    assert one(spark, T.parse_number, raw) == value
    assert one(spark, T.looks_like_number, raw) == (value is not None)


def test_cleaning(spark):
    assert one(spark, T.clean_text, "кам’яних   стінах") == "кам'яних стінах"
    assert one(spark, T.soft_clean, "  шт 4  ") == "  шт 4" and one(spark, T.soft_clean, "a  b\t") == "a  b"
    assert one(spark, T.clean_text, "ТВБВ № 10016/016") == "ТВБВ № 10016/016"
    assert one(spark, T.clean_text, "перено-\n сення") == "переносення"
    assert one(spark, T.clean_text, None) == "" and one(spark, T.normalise_name, None) == ""
    assert one(spark, T.normalise_name, "Роздiл (з) – «Київ»") == "розділ київ"


def test_marks_are_composed(spark):
    pair = "й"
    assert one(spark, T.clean_text, f"Ки{pair}в") == "Кийв"
    got = T.compose_all(spark.createDataFrame([(1, "é"), (2, "plain"), (3, None), (4, pair), (5, "e\u0301 q\u0307\u0323 \u1100\u1161\u0300")], "id int, t string"), "t")
    assert {r.id: r.t for r in got.collect()} == {1: "é", 2: "plain", 3: None, 4: "й", 5: unicodedata.normalize("NFC", "e\u0301 q\u0307\u0323 \u1100\u1161\u0300")}
    cells = ["a\u0301", " x", "y  z", "ok", None, "a’b", "z\u00a0", "line\nend", ""]
    df = spark.createDataFrame([([c],) for c in cells] + [(cells,)], "c array<string>")
    every = df.select(T.clean_all(F.col("c")).alias("a"), F.transform("c", lambda c: T.clean_text(c)).alias("b")).collect()
    assert all(r.a == r.b for r in every)


def test_keys_and_actions(spark):
    key = lambda n, u: one(spark, T.work_key, n, u)
    assert key("Демонтаж розеток", "шт") == key("демонтаж розеток", "штук") != key("Демонтаж розеток", "м2")
    assert one(spark, T.action_class, "Демонтаж розеток") == "demolition" and one(spark, T.action_class, "Монтаж розеток") == "install"
    assert one(spark, T.action_class, "Розетки") == ""
    assert one(spark, T.stem_phrase, "Шпаклювання стінами кути") == "шпакл стінам кути"


def test_money_and_display(spark):
    assert str(one(spark, T.quantity, "9.690009")) == "9.690009"
    assert str(one(spark, T.money, "2.675")) == "2.68" and str(one(spark, T.money, "junk")) == "0.00"
    show = lambda v: one(spark, T.show_quantity, v)
    assert (show("9.690009"), show("4"), show("0"), show("1234567.5"), show("100")) == ("9.690009", "4", "0", "1 234 567.5", "100")
    assert one(spark, T.source_label, "site") == "прайс сайту" and one(spark, T.source_label, "") == "—" and one(spark, T.source_label, "own") == "own"


def brute_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_ratio(spark):
    words = ["", "розетк", "розеток", "плитк", "плит", "a", "abcabc", "cab", "стіна"]
    pairs = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string")
    for r in pairs.select("a", "b", S.ratio(F.col("a"), F.col("b")).alias("r")).collect():
        total = len(r.a) + len(r.b)
        assert r.r == pytest.approx(200 * brute_common(r.a, r.b) / total if total else 100.0)


def test_token_set(spark):
    ratio = lambda a, b: one(spark, S.token_set_ratio, a, b)
    assert ratio("a b", "b a c") == 100 and ratio("", "a") == 0 and ratio("a b c", "b c d") == pytest.approx(80.0)
    assert ratio("плитк стін", "плитк підлог") == pytest.approx(ratio("плитк підлог", "плитк стін"))
