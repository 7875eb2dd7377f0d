from __future__ import annotations

import random

from pyspark.sql import functions as F

from tallyspark.functions import text as T
from tallyspark.operators import bills as B
from tallyspark.sources import bills as S


def lines(spark, doc, text):
    return spark.createDataFrame([(doc, i, line) for i, line in enumerate(text.split("\n"))], "doc_id string, line_no int, line string")


def test_delimited(spark):
    text = "№;Найменування робіт;Одиниця виміру;Кількість\n;;;\n1;Демонтаж розеток;шт;4\n2;Штукатурення стін;кв.м;18,5\nРазом;;;"
    rows = S.split_cells(lines(spark, "a", text).withColumnRenamed("line_no", "row_no"))
    got = B.table_positions(rows).orderBy("number").collect()
    assert [(r.number, r.name, r.unit, float(r.quantity), r.title) for r in got] == [(1, "Демонтаж розеток", "шт", 4.0, "Локальний кошторис"), (2, "Штукатурення стін", "м2", 18.5, "Локальний кошторис")]


def test_quoted_cells(spark, tmp_path):
    """Delimiters, doubled quotes and line ends inside quotes, and quotes that are none."""
    text = '\ufeff№;Найменування робіт;Одиниця виміру;Кількість\r\n1;"Демонтаж ""старих"" розеток";шт;4\r\n2;"Фарбування; два шари";м2;4\r\n3;"Заміна\nвікон";шт;"7,5"\r\n4;Труба 5" сталева;м;1\r\n5;"";шт;1\r\n6;"без кінця;шт;2'
    (tmp_path / "bill.csv").write_text(text, encoding="utf-8")
    got = B.table_positions(S.read_delimited(spark, str(tmp_path / "bill.csv"))).orderBy("number").collect()
    assert [(r.name, r.unit, float(r.quantity)) for r in got] == [
        ('Демонтаж "старих" розеток', "шт", 4.0), ("Фарбування; два шари", "м2", 4.0), ("Заміна вікон", "шт", 7.5), ('Труба 5" сталева', "м", 1.0), ("без кінця", "шт", 2.0),
    ]
    import csv
    import io

    odd = ['a;"b;c";d', ';;', '"x""y";"";z', 'a"b;c', '"tail"more;e', '";";";"', 'one', 'a;"b""";"""c"']
    df = spark.createDataFrame([(k, line) for k, line in enumerate(odd)], "k int, line string").select("k", S._cells(F.col("line"), ";").alias("c"))
    assert {r.k: list(r.c) for r in df.collect()} == {k: next(csv.reader(io.StringIO(line), delimiter=";")) for k, line in enumerate(odd)}


def test_header_rows_until_one_names_the_object(spark):
    rows = [(0, ["за адресою: м. Полтава, ремонт будівлі школи"]), (1, ["Капітальний ремонт школи № 5 за адресою: Сумська область"]), (2, ["№", "Найменування", "Кількість"]), (3, ["1", "Капітальний ремонт даху старої школи", "4"])]
    got = B.table_positions(spark.createDataFrame([("d", i, c) for i, c in rows], "doc_id string, row_no int, cells array<string>")).collect()
    assert [(r.name, r.object_name, r.city, r.region) for r in got] == [("Капітальний ремонт даху старої школи", "Капітальний ремонт школи № 5", "Полтава", "Сумська область")]


def test_plan_of_divisions_before_estimates(spark):
    """Divisions before any estimate get one; empty ones count too."""
    head = [["№", "Найменування", "Од. виміру", "Кількість"], ["Розділ 1. Порожній"], ["Розділ 2. Стіни"], ["1", "Демонтаж дверей", "шт", "1"], ["Локальний кошторис 5 на дах"], ["Локальний кошторис 6 на підлогу"], ["2", "Заміна вікон", "шт", "1"], ["3", "Заміна дверей", "шт", "1"], ["Розділ 3. Інше"], ["4", "Монтаж розеток", "шт", "2"]]
    rows = spark.createDataFrame([("d", i, c) for i, c in enumerate(head)], "doc_id string, row_no int, cells array<string>")
    plan = B.import_plan(B.table_positions(rows).withColumn("seq", F.col("row_no"))).orderBy("seq").collect()
    assert [(r.estimate_ord, r.estimate_title, r.division_ord, r.division_title, r.ordinal) for r in plan] == [
        (1, "Локальний кошторис", 2, "Стіни", 1), (3, "підлогу", 3, "Роботи", 1), (3, "підлогу", 3, "Роботи", 2), (3, "підлогу", 4, "Інше", 1),
    ]


def test_sections_and_headers(spark):
    of = lambda t: spark.createDataFrame([(t,)], "t string").select(B.section(F.col("t")).alias("s")).first()["s"]
    assert tuple(of("Локальний кошторис 02-01 на ремонт даху")) == ("estimate", "02-01", "ремонт даху")
    assert tuple(of("локальні кошторис 5")) == ("estimate", "5", "") and tuple(of("Роздiл 3. Стіни")) == ("division", "3", "Стіни") and of("Стіни") is None
    head = spark.createDataFrame([("Капітальний ремонт школи за адресою: смт. Семенівка, Полтавська область",)], "t string").select(B.object_header(F.col("t")).alias("h")).first()["h"]
    assert tuple(head) == ("Капітальний ремонт школи", "смт. Семенівка, Полтавська область", "Семенівка", "Полтавська область")


DOC = """Додаток 1
Відомість обсягів робіт
Капітальний ремонт приміщення банку за адресою:
м. Семенівка, Полтавська область
№ Найменування робіт Одиниця
1 2 3 4 5
Локальний кошторис 02-01-01 на загальнобудівельні
роботи
Роздiл 1. Стіни
1 Демонтаж розеток   шт 4
2 Штукатурення стін
10 мм завтовшки по
  каменю   м2 151,1
3 Щось без одиниці   дивн 5
Розділ 2. Підлога
4 Улаштування стяжки   м2  9,690009
Програмний комплекс АВК 118_ДЦ_ВОБ
Локальний кошторис 02-01-02 на електрику
1 Прокладання кабелю   м 1 200
Склав
2 Після підпису   шт 1"""


def test_line_document(spark):
    kept, codes = S.content_lines(lines(spark, "d", DOC))
    positions, warnings, headers = B.line_positions(kept)
    got = [(r.number, r.kind, r.code, r.title, r.name, r.unit, float(r.quantity)) for r in positions.orderBy("block").collect()]
    assert got == [
        (1, "division", "1", "Стіни", "Демонтаж розеток", "шт", 4.0), (2, "division", "1", "Стіни", "Штукатурення стін 10 мм завтовшки по каменю", "м2", 151.1),
        (4, "division", "2", "Підлога", "Улаштування стяжки", "м2", 9.690009), (1, "estimate", "02-01-02", "електрику", "Прокладання кабелю", "м", 1200.0),
    ]
    assert [r.number for r in warnings.collect()] == [3] and codes.first().doc_code == "118_ДЦ_ВОБ"
    h = headers.first()
    assert (h.object_name, h.city, h.region) == ("Капітальний ремонт приміщення банку", "Семенівка", "Полтавська область")


def _loop(lines):
    """The rule of accepted numbers, line by line."""
    last, fresh, out = 0, True, []
    for line_no, n, estimate in lines:
        if estimate:
            fresh = True
        elif n == last + 1 or fresh and n == 1:
            out.append(line_no)
            last, fresh = n, False
    return out


def test_accepted_numbers_as_by_a_loop(spark):
    """Random documents, and the cases: none, no 1, only estimates, one long run, a 1 in each line, many short runs."""
    rng = random.Random(7)
    docs = {f"r{k}": [(rng.choice([-1, 0, *range(1, rng.choice([3, 6, 12]))]), rng.random() < 0.1) for _ in range(rng.randrange(80))] for k in range(150)}
    docs |= {"none": [(-1, False)], "no one": [(2, False), (3, False)], "estimates": [(-1, True)] * 3, "long": [(k, False) for k in range(1, 3000)]}
    docs |= {"ones": [(1, k % 2 == 0) for k in range(40)], "junk": [(k // 2 + 1 if k % 2 == 0 else 7, False) for k in range(400)]}
    docs |= {"restarts": [(n, n == 0) for _ in range(50) for n in (0, 1, 9, 2, 1, 3)], "before": [(1, False), (-1, True), (2, False), (1, False), (3, False)]}
    rows = [(d, 3 * i, -1 if e else n, e) for d, lines in docs.items() for i, (n, e) in enumerate(lines)]
    rng.shuffle(rows)
    schema = "doc_id string, line_no int, num_raw int, is_estimate boolean"
    got = {(r.doc_id, r.line_no) for r in B.accepted_numbers(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(d, at) for d, lines in docs.items() for at in _loop([(3 * i, n, e) for i, (n, e) in enumerate(lines)])}
    assert B.accepted_numbers(spark.createDataFrame([], schema)).count() == 0


def test_heads_that_documents_share_and_rows_without_text(spark):
    """Roles by distinct heads; the first head row of a document counts; blank rows of any white space go."""
    head, other = ["№", "Найменування", "Одиниця", "Кількість"], ["Обсяг", "Найменування", "Вимір"]
    docs = {"a": [head, ["1", "Двері", "шт", "2"]], "b": [other, head, ["3", "Вікна", "шт"]], "c": [["\u00a0", "\t \n"], head, ["1", " Стіни\u00a0 ", "кв.м", "4"]], "d": [["1", "Без голови", "шт", "2"]]}
    rows = spark.createDataFrame([(d, i, c) for d, cs in docs.items() for i, c in enumerate(cs)], "doc_id string, row_no int, cells array<string>")
    got = B.table_positions(S.clean_cells(rows)).collect()
    assert sorted((r.doc_id, r.name, r.unit, float(r.quantity)) for r in got) == [("a", "Двері", "шт", 2.0), ("b", "Вікна", "шт", 3.0), ("c", "Стіни", "м2", 4.0)]
    assert S.clean_cells(rows).where("doc_id = 'c'").count() == 2


def test_import_plan(spark):
    kept, _ = S.content_lines(lines(spark, "d", DOC))
    positions, _, headers = B.line_positions(kept)
    given = spark.createDataFrame([("d", "Моя назва", "", "", "")], "doc_id string, object_name string, address string, city string, region string")
    plan = B.import_plan(positions.withColumn("seq", F.col("block")), headers, given).orderBy("seq").collect()
    assert [(r.estimate_ord, r.division_ord, r.ordinal, r.division_title) for r in plan] == [(1, 1, 1, "Стіни"), (1, 1, 2, "Стіни"), (1, 2, 1, "Підлога"), (2, 3, 1, "Роботи")]
    assert [r.estimate_code for r in plan] == ["02-01-01"] * 3 + ["02-01-02"]
    assert plan[0].object_name == "Моя назва" and plan[0].city == "Семенівка"


def test_lines_are_dealt_twice_and_written_once(spark, monkeypatch):
    """Line bills: no small tables on the way, no number of rounds, no line cleaned twice by filters."""
    tables = []
    monkeypatch.setattr(B, "written", lambda df, name: tables.append(df) or df)
    rng = random.Random(3)
    docs = "\n".join(line for k in range(40) for line in [DOC.split("\n")[1 + rng.randrange(14)], f"{k} Двері   шт {k}"])
    kept, _ = S.content_lines(lines(spark, "d", docs))
    B.line_positions(kept)
    plan = tables[0]._jdf.queryExecution().executedPlan().toString()
    assert len(tables) == 1 and plan.count("Exchange hashpartitioning") == 2
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(T.SOFT_DIRTY) == 1


def test_tables_are_dealt_once(spark, monkeypatch):
    """Table bills: one shuffle by document, nothing written on the way, each line cut into cells once."""
    tables = []
    monkeypatch.setattr(B, "written", lambda df, name: tables.append(name) or df)
    text = "№;Найменування робіт;Одиниця виміру;Кількість\n1;Демонтаж розеток;шт;4"
    cells = S.split_cells(lines(spark, "a", text).withColumnRenamed("line_no", "row_no"))
    found = B.table_positions(cells)
    assert tables == [] and found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert cells._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 3  # one a delimiter


def test_header_row_after_positions(spark):
    """The object's header counts for positions before it, and rows that speak of an object before it stay headers."""
    rows = [(0, ["№", "Найменування", "Кількість"]), (1, ["1", "Двері", "2"]), (2, ["", "за адресою: м. Полтава, ремонт будівлі школи", "7"]), (3, ["2", "Капітальний ремонт школи № 5", "1"]), (4, ["3", "Капітальний ремонт даху школи", "4"])]
    got = B.table_positions(spark.createDataFrame([("d", i, c) for i, c in rows], "doc_id string, row_no int, cells array<string>")).orderBy("row_no").collect()
    assert [(r.row_no, r.number, r.city) for r in got] == [(1, 1, "Полтава"), (4, 2, "Полтава")]
