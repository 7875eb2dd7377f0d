from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal as N

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import catalog, pricing, totals
from tallyspark.plans import browse, report

HISTORY = "id string, work_key string, name string, city string, region string, labor_price decimal(18,6), material_price decimal(18,6), machines_price decimal(18,6), created_at timestamp"
ITEMS = "ord long, code string, name string, unit string, category string, labor decimal(18,6), material decimal(18,6), machines decimal(18,6)"


def facts(spark, *rows):
    day = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(str(i), "k|шт", "k", c, r, N(v), N(0), N(0), day + dt.timedelta(days=i)) for i, (c, r, v) in enumerate(rows)], HISTORY)


@pytest.mark.parametrize(("city", "region", "factor"), [("Київ", "Полтавська область", 1.35), ("", "Львівська область", 1.14), ("Лохвиця", "Полтавська область", 0.95), ("Невідоме", "", 1.0), ("", "київська обл.", 1.35), (None, None, 1.0)])
def test_region_factor(spark, city, region, factor):
    f, _ = catalog.region_factor(F.col("c"), F.col("r"))
    assert spark.createDataFrame([(city, region)], "c string, r string").select(f.alias("f")).first()["f"] == factor


def test_history_scopes(spark):
    asked = spark.createDataFrame([("k|шт", "Київ", ""), ("k|шт", "Львів", "Р"), ("k|шт", "", ""), ("x", "", "")], "work_key string, city string, region string")
    h = facts(spark, ("Київ", "", 100), ("Київ", "", 200), ("Київ", "", 900), ("Суми", "Р", 50))
    got = {r.city: (float(r.labor), r.samples, r.scope) for r in pricing.history_price(asked, h).collect()}
    assert got == {"Київ": (200.0, 3, "місто Київ"), "Львів": (50.0, 1, "область Р"), "": (150.0, 4, "уся історія")}
    many = facts(spark, *[("Київ", "", v) for v in range(1, 21)])
    assert float(pricing.history_price(asked, many).where("city = 'Київ'").first().labor) == 16.5  # the last eight: 13..20


def test_resolution(spark):
    items = spark.createDataFrame([(1, "C1", "Демонтаж розеток", "шт", "", N(55), N(10), N(1))], ITEMS)
    site = spark.createDataFrame([(1, "Демонтаж розеток", "шт", N(520), "", "s")], "ord long, name string, unit string, price decimal(18,6), category string, site string")
    asked = spark.createDataFrame([("демонтаж розетки", "шт", "Полтава", ""), ("невідома", "шт", "", "")], "name string, unit string, city string, region string")
    none = facts(spark)
    of = lambda s, **k: {r.name: (r.source, float(r.labor)) for r in pricing.resolve(asked, k.get("history", none), items, site, k.get("web"), s).collect()}
    assert of("site_first")["демонтаж розетки"] == ("site", 546.0) and of("catalog_only")["демонтаж розетки"] == ("catalog", 57.75)
    assert of("site_first")["невідома"] == ("none", 0.0)
    from tallyspark.functions import text as T

    key = asked.select(T.work_key(F.col("name"), F.col("unit")).alias("k")).first()["k"]
    web = spark.createDataFrame([(key, "Полтава", N(77), N(0))], "work_key string, city string, labor decimal(18,2), material decimal(18,2)")
    assert of("web_first", web=web)["демонтаж розетки"] == ("web", 77.0) and of("history_first", web=web)["демонтаж розетки"][0] == "site"
    assert of("no such order")["демонтаж розетки"][0] == "site"
    past = facts(spark, ("Полтава", "", 33)).withColumn("work_key", F.lit(key))
    assert of("history_first", history=past)["демонтаж розетки"] == ("history", 33.0)


def budget(spark, limit, *asked):
    df = spark.createDataFrame([(1, i, k, False, f) for i, (k, f) in enumerate(asked)], "run int, seq int, work_key string, cached boolean, found boolean")
    r = pricing.budget(pricing.live_queries(df, limit), limit).first()
    return r.used, r.blocked, r.from_cache


def test_budget(spark):
    assert budget(spark, 2, *[(str(i), True) for i in range(5)]) == (2, 3, 0)
    assert budget(spark, 1, ("a", True), ("a", True)) == (1, 0, 1)
    assert budget(spark, 0, *[(str(i), False) for i in range(5)]) == (5, 0, 0)
    assert budget(spark, 1, ("a", False), ("b", True), ("b", True)) == (1, 2, 0)


def position(spark, quantity, labor, material, machines):
    return spark.createDataFrame([(1, "e", "d", N(quantity), N(labor), N(material), N(machines))], "object_id int, estimate_id string, division_id string, quantity decimal(18,6), labor_price decimal(18,6), material_price decimal(18,6), machines_price decimal(18,6)")


def test_mark_up(spark):
    t = totals.position_totals(position(spark, 10, 100, 50, 10))
    sums = t.groupBy("object_id").agg(*(F.sum(m).cast(totals.SUM).alias(m) for m in totals.MEASURES))
    r = totals.mark_up(totals.settings_with_defaults(sums)).first()
    assert [float(r[c]) for c in ("total", "labor", "overhead", "profit", "before_vat", "vat", "grand_total")] == [1600, 1000, 165, 101.2, 1901.5, 380.3, 2281.8]
    lines = totals.summary_lines(totals.mark_up(totals.settings_with_defaults(sums))).orderBy("ord").collect()
    assert len(lines) == 12 and lines[4].label == "Загальновиробничі витрати (15%)" and lines[8].label.endswith("(0%)") and float(lines[-1].value) == 2281.8


def test_materials_excluded(spark):
    r = totals.position_totals(position(spark, 2, 100, 900, 0), False).first()
    assert float(r.material) == 0 and float(r.total) == 200


def test_rollup_levels(spark):
    t = totals.position_totals(position(spark, 1, 1, 1, 1).union(position(spark, 2, 1, 1, 1)))
    assert sorted((r.level, float(r.total)) for r in totals.rollup(t).collect()) == [(0, 9.0), (1, 9.0), (3, 9.0)]


def test_report(spark):
    p = spark.createDataFrame([(1, 1, "01", "на ремонт", 1, "2", "Стіни", 1, "Фарбування", "м2", N("9.690009"), N(3), N("29.07")), (1, 1, "01", "на ремонт", 2, "", "", 2, "Інше", "шт", N(1), N(1), N(1))],
                              "object_id int, estimate_ord int, estimate_code string, estimate_title string, division_ord int, division_code string, division_title string, number int, name string, unit string, quantity decimal(18,6), unit_price decimal(18,2), total decimal(18,2)")
    rows = report.report_rows(p).collect()
    assert [(r.kind, r.name) for r in rows] == [
        ("estimate", "Локальний кошторис 01 на ремонт"), ("division", "Розділ 2. Стіни"), ("position", "Фарбування"), ("division_total", "Разом по розділу «Стіни»"), ("position", "Інше"), ("estimate_total", "Разом по кошторису 01 на ремонт"),
    ]
    assert rows[2].quantity == N("9.690009") and float(rows[-1].total) == 30.07


def test_browse_and_cache(spark):
    h = facts(spark, ("a", "", 1), ("b", "", 2)).withColumn("name", F.lit("Demo Роботи"))
    assert browse.history_browse(h, "dEMO").count() == 2 and browse.history_browse(h, "роботи").count() == 0 and browse.history_browse(h, "D%Р_б").count() == 2
    assert [r.city for r in browse.history_browse(h, "", 1).collect()] == ["b"]
    cache = spark.createDataFrame([("k", "", "p", N(1), N(0), dt.datetime(2024, 1, 1)), ("k", "", "p", N(2), N(0), dt.datetime(2024, 1, 9)), ("k", "", "p", N(0), N(0), dt.datetime(2024, 1, 20))], "work_key string, city string, provider string, labor decimal(18,2), material decimal(18,2), created_at timestamp")
    now = pricing.update_cache(cache.limit(0), cache)
    assert [float(r.labor) for r in now.collect()] == [2.0]
    keys = cache.select("work_key", "city", "provider").distinct()
    assert pricing.fresh_cache(keys, now, "2024-01-23 00:00:00").count() == 0 and pricing.fresh_cache(keys, now, "2024-01-22 00:00:00").count() == 1


def test_overrides(spark):
    items = spark.createDataFrame([(1, "C1", "a", "шт", "x", N(1), N(0), N(0)), (2, "U0001", "b", "шт", "", N(1), N(0), N(0))], ITEMS)
    changes = spark.createDataFrame([("", "new", "кв.м", "", N(5), None, None, dt.datetime(2024, 1, 1)), ("", "other", "", "", None, None, None, dt.datetime(2024, 1, 2)), ("C1", "a2", "к-т", "", N(7), N(0), N(0), dt.datetime(2024, 1, 1)), ("C1", " ", "", "", N(9), N(0), N(0), dt.datetime(2024, 1, 3))],
                                    "code string, name string, unit string, category string, labor decimal(18,6), material decimal(18,6), machines decimal(18,6), updated_at timestamp")
    after = catalog.upsert(changes.limit(0), changes, items)
    assert {r.code: (r.name, r.unit) for r in after.collect()} == {"U0002": ("new", "м2"), "U0003": ("other", ""), "C1": ("a2", "компл")}
    shown = {r.code: (r.name, r.category, r.source) for r in catalog.overlay(items, after).collect()}
    assert shown["C1"] == ("a2", "x", "override") and shown["U0001"] == ("b", "", "base") and len(shown) == 4
    gone = catalog.delete(after, spark.createDataFrame([("C1",)], "code string"))
    assert {r.name for r in catalog.overlay(items, gone).collect()} == {"a", "b", "new", "other"}


def test_overlay_appends_new_codes(spark):
    """Items that only an override has follow the base in the overrides' order, and are matched."""
    from tallyspark.operators import match

    base = spark.createDataFrame([(4, "C0", "Демонтаж розеток", "шт", "Електрика", N(55), N(0), N(0)), (7, "C1", "Заміна вікон", "шт", "", N(9), N(0), N(0))], ITEMS)
    over = "code string, name string, unit string, category string, labor decimal(18,6), material decimal(18,6), machines decimal(18,6)"
    rows = [("N2", "Демонтаж розеток", "шт.", "", N(99), N(0), N(0)), ("N1", "Шліфування паркетної підлоги", "кв. м", "Підлога", N(40), N(0), N(0)), ("C1", "Заміна вікон дерев'яних", "шт", "", N(11), N(0), N(0))]
    overrides = spark.createDataFrame(rows, over)
    items = catalog.overlay(base, overrides)
    assert {r.code: (r.ord, r.unit, r.source) for r in items.collect()} == {"C0": (4, "шт", "base"), "C1": (7, "шт", "override"), "N1": (8, "м2", "override"), "N2": (9, "шт", "override")}
    asked = spark.createDataFrame([("Демонтаж розеток", "шт"), ("Шліфування паркетних підлог дубових", "м2")], "name string, unit string")
    assert {r.name: r.code for r in match.match(asked, items).collect()} == {"Демонтаж розеток": "C0", "Шліфування паркетних підлог дубових": "N1"}
    in_order = overrides.withColumn("seq", F.when(F.col("code") == "N2", 1).otherwise(2))
    assert {r.code: r.ord for r in catalog.overlay(base, in_order).collect()} == {"C0": 4, "C1": 7, "N2": 8, "N1": 9}
    assert {r.code: r.ord for r in catalog.overlay(base.limit(0), overrides).collect()} == {"C1": 0, "N1": 1, "N2": 2}
    assert [r.name for r in catalog.by_code(items, "C1").collect()] == ["Заміна вікон дерев'яних"] and catalog.overlay(base, overrides.limit(0)).count() == 2


def test_free_codes_and_numbers(spark):
    from tallyspark.sources.shared import numbered

    df = spark.range(0, 1000, numPartitions=7).select(F.pmod(F.col("id") * 7919, F.lit(1000)).alias("k"), F.lit("x").alias("_part"))
    assert sorted((r.k, r.n) for r in numbered(df.drop("_part"), "n", "k").collect()) == [(k, k + 1) for k in range(1000)]
    assert [r.n for r in numbered(df.drop("_part"), "n", F.desc("k")).orderBy("k").collect()] == list(range(1000, 0, -1)) and numbered(df.limit(0), "n", "k").count() == 0
    over = "code string, name string, unit string, category string, labor decimal(18,6), material decimal(18,6), machines decimal(18,6), updated_at timestamp"
    day = dt.datetime(2024, 1, 1)
    taken = spark.range(1, 10_001).select(F.format_string("U%04d", "id").alias("code"))
    new = spark.createDataFrame([(None, "b", "шт", "", None, N(1), N(2), day), ("", "a", "шт", "", N(1), N(1), N(1), day), ("U10001", "c", "", "", N(1), N(1), N(1), day)], over)
    got = {r.name: r.code for r in catalog.upsert(new.limit(0), new, taken).collect()}
    assert got == {"a": "U10002", "b": "U10003", "c": "U10001"}


def test_candidates_of_positions(spark):
    from tallyspark.operators import match

    items = spark.createDataFrame([(i, f"C{i}", n, "шт", "A" if i % 2 else "B", N(10 * i), N(1), N(0)) for i, n in enumerate(["Демонтаж розеток", "Монтаж розеток", "Заміна вікон", "Фарбування стін"], 1)], ITEMS)
    p = spark.createDataFrame([("1", "Монтаж розетки", "шт", 1.5), ("2", "зовсім інше", "шт", 1.0), ("3", "Монтаж розетки", "шт", 2.0)], "position_id string, name string, unit string, factor double")
    got = {}
    for r in match.position_candidates(p, items, 2).orderBy("rank").collect():
        got.setdefault(r.position_id, []).append((r.code, float(r.labor)))
    assert got["1"] == [("C2", 30.0), ("C1", 15.0)] and got["3"] == [("C2", 40.0), ("C1", 20.0)] and len(got["2"]) == 2
    texts = spark.createDataFrame([("розетки",), ("",), ("нема такого",)], "text string")
    assert {r.text: r.total for r in match.search_totals(texts, items, 5).collect()} == {"розетки": 2, "": 4, "нема такого": 0}
    assert {r.text: r.total for r in match.search_totals(texts, items, 5, "A").collect()} == {"розетки": 1, "": 2, "нема такого": 0}


def test_snapshots_survive_a_failed_write(spark, tmp_path):
    """Readers see the old rows during and after a write that fails, and the new ones after one that does not."""
    from pyspark.sql.types import StringType

    from tallyspark.sources import snapshots

    path = str(tmp_path / "site")
    rows = lambda price, *sites: spark.createDataFrame([(k, f"робота {k}", "м2", N(price), "", s) for s in sites for k in range(3)], "ord long, name string, unit string, price decimal(18,6), category string, site string")
    seen = lambda s: [float(r.price) for r in pricing.read_site(spark, path, s).collect()]
    pricing.overwrite_site(rows(1, "a", "b"), path)

    @F.udf(StringType())
    def fails(name):
        if name.endswith("2"):
            raise ValueError("the network is down")
        return name

    with pytest.raises(Exception, match="network is down"):
        pricing.overwrite_site(rows(2, "a").withColumn("name", fails("name")), path)
    assert seen("a") == [1.0] * 3
    pricing.overwrite_site(rows(3, "a"), path)
    assert seen("a") == [3.0] * 3 and seen("b") == [1.0] * 3 and seen("none") == []
    with pytest.raises(RuntimeError):
        snapshots._commit(spark, path, 2, {})  # a second writer of the same number
    assert snapshots.read(spark, str(tmp_path / "nothing")) is None


def test_state_of_history_after_appends(spark, tmp_path):
    """The state that appends bring up to date equals the one of all history; a hot key goes to several files."""
    from tallyspark.sources import snapshots

    rng = random.Random(5)
    rows = [(str(k), "hot" if k % 3 == 0 else f"k{rng.randrange(20)}", rng.choice(["Київ", "", None]), rng.choice(["Київська область", ""]), *(N(rng.randrange(99)) for _ in range(3)), dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randrange(500)), "назва") for k in range(900)]
    df = spark.createDataFrame(rows, "id string, work_key string, city string, region string, labor_price decimal(18,6), material_price decimal(18,6), machines_price decimal(18,6), created_at timestamp, name string")
    path, state = str(tmp_path / "h"), str(tmp_path / "s")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else a few rows go to one task anyway
    for k in range(3):
        pricing.append_history(df.where(F.col("id").cast("int") % 7 % 3 == k), path, state)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    key = lambda d: sorted(map(str, d.collect()))
    want = pricing.latest_facts(df)
    assert key(snapshots.read(spark, state).select(*want.columns)) == key(want)
    files = spark.read.parquet(path).where("work_key = 'hot'").select(F.input_file_name()).distinct().count()
    assert files > 3 and spark.read.parquet(path).count() == 900
    asked = spark.createDataFrame([("hot", "Київ", ""), ("k3", "", "Київська область"), ("k4", "", "")], "work_key string, city string, region string")
    assert key(pricing.price_from_facts(asked, snapshots.read(spark, state))) == key(pricing.history_price(asked, df))


def test_repricing_under_a_budget(spark):
    """Requests beyond the limit fall through; what is cached or was found before costs nothing; without the cache each is live."""
    from tallyspark.functions import text as T

    names = ["невідома перша", "невідома друга", "невідома перша", "щось третє", "ручна"]
    p = spark.createDataFrame([(1, 1, 1, k, f"p{k}", n, "шт", "Полтава", "", n == "ручна", N(5), N(0), N(0)) for k, n in enumerate(names)], "object_id int, estimate_ord int, division_ord int, ordinal int, position_id string, name string, unit string, city string, region string, manual boolean, labor_price decimal(18,6), material_price decimal(18,6), machines_price decimal(18,6)")
    key = {r.name: r.k for r in p.select("name", T.work_key(F.col("name"), F.col("unit")).alias("k")).collect()}
    items = spark.createDataFrame([(1, "C1", "невідома друга", "шт", "x", N(10), N(0), N(0))], ITEMS)
    answer = lambda *n: spark.createDataFrame([(key[x], "Полтава", N(70 + i), N(0), "serpapi", [(70.0 + i, "шт", "labor")] * 9) for i, x in enumerate(n)], "work_key string, city string, labor decimal(18,2), material decimal(18,2), provider string, samples array<struct<value:double,unit:string,kind:string>>")
    web = answer("невідома перша", "невідома друга", "щось третє")

    def run(limit, cache=None, use_cache=True):
        out, stats = pricing.reprice_in_order(p, facts(spark), items, None, web, cache, "web_first", limit, use_cache)
        r = stats.first()
        return [(x.price_source, x.details.cached if x.details else None) for x in out.orderBy("ordinal").collect()], (r.used, r.blocked, r.from_cache), out

    sources, spent, out = run(1)
    assert sources == [("web", False), ("catalog", None), ("web", True), ("none", None), ("manual", None)] and spent == (1, 2, 1)
    first = out.where("ordinal = 0").first()
    assert len(first.details.found_prices) == 6 and first.details.provider == "serpapi" and float(first.labor_price) == 70
    assert run(0)[1] == (3, 0, 1) and run(1, use_cache=False)[1] == (1, 3, 0)
    sources, spent, _ = run(1, answer("невідома перша"))
    assert spent == (1, 1, 2) and sources[0] == ("web", True) and sources[1] == ("web", False)


def test_tree_is_shuffled_once(spark):
    """Positions are dealt by object once; divisions, estimates and objects are put together where they lie."""
    cells = [(o, e, f"e{e}", d, f"d{d}", n, f"{o}-{e}-{d}-{n}", "Двері", "шт", 1.0, 2.0) for o in (1, 2) for e in (2, 1) for d in (1, 2) for n in (2, 1)]
    schema = "object_id long, estimate_ord int, estimate_id string, division_ord int, division_id string, ordinal int, position_id string, name string, unit string, quantity double, total double"
    found = totals.tree(spark.createDataFrame(cells, schema))
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    rows = {r.object_id: [p.position_id for e in r.estimates for d in e.divisions for p in d.positions] for r in found.collect()}
    assert rows == {o: [f"{o}-{e}-{d}-{n}" for e in (1, 2) for d in (1, 2) for n in (1, 2)] for o in (1, 2)}


def test_appended_facts_have_no_factor(spark, sf_dir, monkeypatch):
    """a fact has a place; the factor of each order's place need not be made for it."""
    from tallyspark.plans import queries

    seen, append = [], pricing.append_history
    monkeypatch.setattr(pricing, "append_history", lambda facts, path: (seen.append(facts.columns), append(facts, path)))
    assert queries.QUERIES["h_append_history"](spark, sf_dir).count() > 0
    assert len(seen) == 2 and not any("factor" in c for c in seen)


def recorded(monkeypatch, module) -> dict:
    """What the module writes for itself, by name."""
    kept, write = {}, module.written

    def put(df, name):
        kept[name] = df
        return write(df, name)

    monkeypatch.setattr(module, "written", put)
    return kept


def test_positions_of_a_repricing_carry_numbers_only(spark, monkeypatch):
    """What sources say is written by request; positions are joined with it at the end, and not with themselves."""
    kept = recorded(monkeypatch, pricing)
    schema = "position_id string, object_id long, estimate_ord int, division_ord int, ordinal int, name string, unit string, city string, region string, manual boolean, labor_price decimal(18,6), material_price decimal(18,6), machines_price decimal(18,6)"
    rows = [(f"p{i}", 1, 1, 1, i, n, "шт", "Київ", "", m, N(5), N(0), N(0)) for i, (n, m) in enumerate([("Монтаж дверей", False), ("Монтаж дверей", False), ("Монтаж вікон", True), (None, False)])]
    web = spark.createDataFrame([("монтаж двер|шт", "Київ", N(70), N(0))], "work_key string, city string, labor decimal(18,2), material decimal(18,2)")
    items = spark.createDataFrame([(1, "C1", "Монтаж дверей", "шт", "", N(55), N(10), N(1))], ITEMS)
    positions = spark.createDataFrame(rows, schema)
    out, told = pricing.reprice_in_order(positions, facts(spark), items, None, web, None, "web_first", 1)
    assert not [c for c in kept["reached"].columns if c.startswith("s_")] and kept["sources"].count() == 3 and "status" not in kept
    key = pricing.keyed(positions.limit(1)).first().work_key
    found = key == "монтаж двер|шт"
    got = {r.position_id: (r.price_source, float(r.labor_price)) for r in out.collect()}
    assert got["p2"] == ("manual", 5.0) and got["p3"] == ("none", 0.0)
    assert got["p0"] == got["p1"] == (("web", 70.0) if found else ("catalog", 55 * 1.35))
    s = told.first()
    assert (s.total, s.skipped_manual, s.used + s.blocked + s.from_cache) == (4, 1, 3)


def test_keys_are_made_once_for_each_name(spark, sf_dir):
    """names and units of paid works are few next to parts."""
    from tallyspark.plans import domain

    plan = domain.history(spark, sf_dir).select("work_key")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [name" in plan


def test_resolved_requests_are_written(spark, monkeypatch):
    """Requests are few next to positions, so they go to the positions, with their units made already."""
    kept = recorded(monkeypatch, pricing)
    new = spark.createDataFrame([("a", "Двері", " ШТ. ", "", "", False, None, N(2)), ("b", "Двері", "", "", "", False, None, None), ("c", "інше", "кв. м", "", "", True, N(7), N(1))], "position_id string, name string, unit string, city string, region string, manual boolean, labor_price decimal(18,6), quantity decimal(18,6)").withColumns({f"{p}_price": F.lit(None).cast("decimal(18,6)") for p in ("material", "machines")})
    resolved = new.where("position_id <> 'c'").select("name", "unit", "city", "region", *(F.lit(3).cast("decimal(18,2)").alias(p) for p in pricing.PRICES), F.lit("catalog").alias("source"), F.lit("C1").alias("match_code"), F.lit(90.0).alias("match_score"))
    items = spark.createDataFrame([(1, "C1", "Двері", "компл", "", N(3), N(3), N(3))], ITEMS)
    got = {r.position_id: (r.unit, r.price_source, float(r.labor_price)) for r in pricing.fill_added(new, resolved, items).collect()}
    assert got == {"a": ("шт", "catalog", 3.0), "b": ("компл", "catalog", 3.0), "c": ("м2", "manual", 7.0)}
    assert "r_unit" in kept.pop("resolved").columns
    pricing.reprice(new.withColumn("price_source", F.lit("none")), resolved)
    assert "resolved" in kept
