from __future__ import annotations

import random

from pyspark.sql import functions as F

from tallyspark.operators import extract as X
from tallyspark.sources import pages as P
from tallyspark.sources import search as W

TABLE = """<html><head><title>ціна 5 грн</title></head><body><nav><a href="/prices/walls#x">Стіни</a><a href="/other">Інше</a><a href="floor">Підлога</a></nav>
<h2>Роботи на стелі</h2><table><tr><th>Найменування робіт</th><th>Од.</th><th>Ціна</th></tr>
<tr><td>Обшивка стелі вагонкою</td><td>м2</td><td>95 грн</td></tr><tr><td>Миття вікон</td><td>кв. м</td><td>30</td></tr></table>
<h2>Проводка</h2><table><tr><td>Прокладання дроту</td><td>шт.</td><td>від 95 грн</td></tr><tr><td>Монтаж щита обліку</td><td>м²</td><td>1 241,00 грн</td></tr></table></body></html>"""
INLINE = "<ul><li>Заміна замка вхідного   шт   250 грн</li><li>Циклювання паркету дубового м2 від 120 грн</li><li>Разом м2 370 грн</li></ul>"
DIVS = '<h3>Роботи на стелі</h3><div class="row"><div>Побілка стелі крейдою</div><div>м2</div><div>100-140 грн</div></div>'


def site(spark, *pages):
    df = spark.createDataFrame([(i, "s", i, "https://s.ua/prices", h) for i, h in enumerate(pages)], "page_id long, site string, page_ord int, url string, html string")
    return df, [(r.name, r.unit, float(r.price), r.category) for r in P.site_prices(df).orderBy("page_ord", "row_no").collect()]


def test_pages(spark):
    df, rows = site(spark, TABLE, INLINE, DIVS)
    assert rows[:4] == [
        ("Обшивка стелі вагонкою", "м2", 95.0, "Роботи на стелі"), ("Миття вікон", "м2", 30.0, "Роботи на стелі"),
        ("Прокладання дроту", "шт", 95.0, "Проводка"), ("Монтаж щита обліку", "м2", 1241.0, "Проводка"),
    ]
    assert ("Заміна замка вхідного", "шт", 250.0, "") in rows and ("Циклювання паркету дубового", "м2", 120.0, "") in rows
    assert not any("Разом" in r[0] for r in rows) and ("Побілка стелі крейдою", "м2", 120.0, "Роботи на стелі") in rows
    assert [r.link for r in P.section_links(df.where("page_id = 0")).orderBy("ord").collect()] == ["https://s.ua/prices/walls"]
    twice = X.first_of_each(P.site_prices(df).unionByName(P.site_prices(df)), "page_ord", "row_no")
    assert twice.count() == len(rows)


def samples(spark, text, unit, legacy=False):
    df = spark.createDataFrame([(text, unit)], "t string, u string")
    return [(s.value, s.unit, s.kind) for s in df.select(X.snippet_samples(F.col("t"), F.col("u"), legacy).alias("s")).first()["s"]]


def test_snippets(spark):
    assert samples(spark, "Настилання лінолеуму від 310 грн/м2, послуги майстра", "м2")[0] == (310.0, "м2", "labor")
    assert samples(spark, "Купити паркет дубовий: 1150 грн за м.кв, товар зі складу", "м2")[0][2] == "material"
    assert (75.0, "шт", "labor") in samples(spark, "Заміна крана 60-90 грн/шт", "шт")
    assert samples(spark, "Труба 95 грн/м.п", "м2") == []
    assert samples(spark, "1200 грн", "") == [(1200.0, "", "labor")] and samples(spark, "1200 грн", "", True) == [(200.0, "", "labor")]
    assert samples(spark, "450 грн монтаж", "м2") == [(450.0, "м2", "labor")] and samples(spark, "450 грн монтаж", "м2", True) == []
    assert samples(spark, None, "м2") == []


def test_trimmed_medians(spark):
    """From counts as from the values themselves, however often a value occurs."""
    from statistics import median

    rng = random.Random(3)
    given = {"a": [3, 61, 64, 65, 67, 70, 2000], "b": [75, 65], "c": [7], "d": [1, 2, 9, 10], "e": [5] * 40 + [9] * 3}
    given |= {f"r{k}": [rng.randrange(12) for _ in range(rng.randrange(1, 60))] for k in range(60)}

    def by_hand(v):
        v, cut = sorted(v), max(1, len(v) // 5) if len(v) > 4 else 0
        return median(v[cut : len(v) - cut])

    df = spark.createDataFrame([(k, float(x)) for k, v in given.items() for x in v], "k string, value double")
    got = {r.k: r["median"] for r in X.trimmed_medians(df, "k").collect()}
    assert got == {k: by_hand(v) for k, v in given.items()} and got["a"] == 65 and got["d"] == 5.5


def test_web_prices(spark):
    answers = spark.createDataFrame(
        [("k", "Київ", "м2", "serpapi", '{"organic_results": [{"title": "a", "snippet": "75 грн/м2", "link": "u"}, {"title": "b", "snippet": "65 грн/м2"}]}'), ("k2", "", "шт", "brave", "{}"), ("k3", "", "шт", "google", "broken")],
        "work_key string, city string, unit string, provider string, answer string",
    )
    results = W.search_results(answers)
    assert results.count() == 2
    row = X.web_prices(results).first()
    assert (float(row.labor), float(row.material), row.n_samples) == (70.0, 0.0, 2)


def test_list_profile(spark):
    rows = spark.createDataFrame([("s", "Довга назва роботи", "м2", 10.0, "a"), ("s", "Коротка", "", 3.0, ""), ("s", "Ще одна назва роботи", "м2", 30.0, "a")], "site string, name string, unit string, price double, category string")
    units, categories, bounds = X.list_profile(rows)
    assert [tuple(r) for r in units.collect()] == [("м2", 2), ("—", 1)] and categories.first()["category"] == "a"
    assert tuple(bounds.first()) == ("s", 3, 3.0, 30.0, 10.0, 1)


def test_page_counts_and_diagnosis(spark):
    df, rows = site(spark, "<p>Наш прайс</p>", DIVS, "<p>нічого</p>", INLINE)
    counts = P.site_page_counts(df, P.site_prices(df)).first()
    assert (counts.site, counts.pages, counts.rows) == ("s", 3, len(rows))  # the first page counts without a row
    none = df.where("page_id = 2")
    assert tuple(P.site_page_counts(none, P.site_prices(none)).first()) == ("s", 1, 0)
    got = {r.page_id: r for r in X.page_diagnosis(df, P.page_rows(df)).collect()}
    assert (got[3].price_mentions, got[3].unit_mentions, got[3].rows, got[3].priced_rows) == (3, 3, 3, 3)
    assert (got[2].price_mentions, got[2].rows, got[2].priced_rows) == (0, 1, 0)
    assert [tuple(r) for r in X.page_diagnosis(spark.createDataFrame([(1, None)], "page_id long, html string")).collect()] == [(1, 0, 0, 0)]


def test_snippets_are_dealt(spark, monkeypatch):
    """snippets of a small file are read in many tasks."""
    kept = []
    write = X.written
    monkeypatch.setattr(X, "written", lambda df, name: (kept.append(df), write(df, name))[1])
    results = spark.createDataFrame([(f"k{i}", "", "serpapi", "шт", 1, "a", f"{70 + i} грн/шт") for i in range(40)], "work_key string, city string, provider string, unit string, rank int, title string, snippet string").coalesce(1)
    assert X.web_prices(results).count() == 40
    assert "REPARTITION_BY_NUM" in kept[0]._jdf.queryExecution().executedPlan().toString()
