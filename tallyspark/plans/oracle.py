"""SQL for DuckDB: the same text rules, views and results as the Spark queries."""

from __future__ import annotations

from tallyspark.functions import fixed
from tallyspark.functions.text import ACTION_STARTS, any_of
from tallyspark.plans import domain as D


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def array(values) -> str:
    return "[" + ", ".join(map(quoted, values)) + "]"


def pick(values: list[str], n: str) -> str:
    return f"{array(values)}[CAST({n} % {len(values)} + 1 AS INT)]"


def lookup(values: dict, key: str) -> str:
    """The value of a key of a literal table, or null."""
    plain = lambda v: quoted(v) if isinstance(v, str) else f"CAST({v} AS DOUBLE)"
    return f"(CASE {key} " + " ".join(f"WHEN {quoted(k)} THEN {plain(v)}" for k, v in values.items()) + " END)"


def clean(x: str) -> str:
    marks = quoted(fixed.APOSTROPHES)
    x = f"translate(coalesce({x}, ''), {marks}, {quoted(chr(39) * len(fixed.APOSTROPHES))})"
    x = rf"regexp_replace({x}, '([\p{{L}}\p{{N}}_])-\s*\n\s*([\p{{L}}\p{{N}}_])', '\1\2', 'g')"
    x = f"translate({x}, chr(10) || chr(13) || chr(9) || chr(160) || chr(8199) || chr(8239), '      ')"
    return rf"trim(regexp_replace({x}, '\s{{2,}}', ' ', 'g'))"


def soft(x: str) -> str:
    x = f"translate(coalesce({x}, ''), {quoted(fixed.APOSTROPHES)}, {quoted(chr(39) * len(fixed.APOSTROPHES))})"
    return rf"regexp_replace(translate({x}, chr(9) || chr(160) || chr(8199) || chr(8239) || chr(8201), '     '), '\s+$', '')"


def tokens(x: str) -> str:
    x = f"translate(lower({clean(x)}), {quoted(fixed.LATIN)}, {quoted(fixed.CYRILLIC)})"
    x = rf"regexp_replace({x}, '[\[\](){{}}«»\"“”/\\,;:.!?–—_+*]', ' ', 'g')"
    return rf"list_filter(string_split(regexp_replace({x}, '\s{{2,}}', ' ', 'g'), ' '), lambda t: NOT list_contains({array(['', *fixed.STOP_WORDS])}, t))"


def name(x: str) -> str:
    return f"array_to_string({tokens(x)}, ' ')"


def stems(x: str) -> str:
    return rf"list_transform({tokens(x)}, lambda t: regexp_replace(t, '^(.{{{fixed.LEAST_STEM},}}?){any_of(fixed.ENDINGS)}$', '\1'))"


def phrase(x: str) -> str:
    return f"array_to_string({stems(x)}, ' ')"


def unit(x: str) -> str:
    raw = f"translate(trim(rtrim(lower({clean(x)}), '.')), '²³', '23')"
    compact = rf"regexp_replace({raw}, '[\s.]', '', 'g')"
    return f"coalesce({lookup(fixed.UNIT_OF, raw)}, {lookup(fixed.UNIT_OF, compact)}, {raw})"


def key(n: str, u: str) -> str:
    return f"(CASE WHEN {unit(u)} <> '' THEN {phrase(n)} || '|' || {unit(u)} ELSE {phrase(n)} END)"


def action(x: str) -> str:
    return f"(CASE WHEN regexp_matches({name(x)}, {quoted(any_of(fixed.DEMOLITION))}) THEN 'demolition' WHEN regexp_matches({name(x)}, {quoted(any_of(fixed.INSTALL))}) THEN 'install' ELSE '' END)"


def number(x: str) -> str:
    raw = f"replace(replace({clean(x)}, ' ', ''), ',', '.')"
    return rf"(CASE WHEN {x} IS NOT NULL AND regexp_matches({raw}, '^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$') THEN TRY_CAST({raw} AS DOUBLE) END)"


def is_action_word(t: str) -> str:
    return f"list_contains({array(ACTION_STARTS)}, substr({t}, 1, 5))"


def common_length(a: str, b: str) -> str:
    """Common subsequence by list_reduce; row, letter and index are lists so that types agree."""
    letters = lambda s: f"string_split({s}, '')"
    inner = (
        f"list_reduce(list_transform(range(1, length({b}) + 1), lambda j: [j]), "
        "lambda made, j: list_append(made, CASE WHEN substr(" + b + ", CAST(j[1] AS INT), 1) = chr(CAST(x[1] AS INT)) THEN row[j[1]] + 1 ELSE greatest(row[j[1] + 1], made[-1]) END), [0::BIGINT])"
    )
    return (
        f"(CASE WHEN {a} = '' OR {b} = '' THEN 0 ELSE list_reduce(list_transform({letters(a)}, lambda c: [unicode(c)::BIGINT]), lambda row, x: {inner}, list_transform(range(length({b}) + 1), lambda z: 0::BIGINT))[-1] END)"
    )


def ratio(a: str, b: str) -> str:
    return f"(CASE WHEN length({a}) + length({b}) = 0 OR {a} = {b} THEN 100.0::DOUBLE ELSE 200.0::DOUBLE * {common_length(a, b)} / (length({a}) + length({b})) END)"


def work_name(part: str, things: dict[str, str] = D.THINGS) -> str:
    return f"concat_ws(' ', {lookup(D.ACTIONS, f'split_part({part}, chr(32), 1)')}, {lookup(things, f'split_part({part}, chr(32), 2)')})"


def wide_name(of: str, things: dict[str, str] = D.THINGS) -> str:
    digits = f"translate(CAST({of}.p_partkey AS VARCHAR), '0123456789', {quoted(D.SYLLABLE_LETTERS)})"
    return f"{work_name(f'{of}.p_name', things)} || ' ' || lower({of}.p_type) || ' серії ' || {digits} || 'ор'"


def factor(city: str, region: str) -> str:
    inside = " ".join(f"WHEN {clean(region)} <> '' AND contains(lower({clean(region)}), {quoted(k.split()[0].lower())}) THEN CAST({v} AS DOUBLE)" for k, v in fixed.REGIONS.items())
    return f"coalesce({lookup(fixed.CITIES, clean(city))}, {lookup(fixed.REGIONS, clean(region))}, CASE {inside} ELSE 1.0 END)"


def factor_label(city: str, region: str) -> str:
    inside = " ".join(f"WHEN {clean(region)} <> '' AND contains(lower({clean(region)}), {quoted(k.split()[0].lower())}) THEN {quoted(k)}" for k in fixed.REGIONS)
    c, r = clean(city), clean(region)
    return f"(CASE WHEN {lookup(fixed.CITIES, c)} IS NOT NULL THEN 'місто ' || {c} WHEN {lookup(fixed.REGIONS, r)} IS NOT NULL THEN {r} {inside} ELSE {quoted(fixed.BASE_REGION)} END)"


def share(price: str, s: str) -> str:
    return f"CAST(CAST({price} AS DECIMAL(18,2)) * CAST({s} AS DECIMAL(4,3)) AS DECIMAL(18,6))"


_PRICES = f"{share('l_extendedprice', '0.010')} AS labor_price, {share('l_extendedprice', '0.005')} AS material_price, {share('l_extendedprice', '0.002')} AS machines_price"

#: Views as common table expressions, in an order in which each may use those before it.
VIEWS = {
    "objects": f"""SELECT o_orderkey AS object_id, 'Об''єкт ' || o_orderkey AS name, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'вул. ' || c_mktsegment END AS address,
        {pick(D.PLACES, 'c_nationkey')} AS city, {pick(D.AREAS, 'o_custkey')} AS region, c_name AS customer, CASE WHEN o_orderstatus = 'F' THEN '118_ДЦ_ВОБ' ELSE '' END AS doc_code,
        o_orderdate AS updated_at, o_custkey FROM orders JOIN customer ON o_custkey = c_custkey""",
    "positions": f"""SELECT l_orderkey AS object_id, l_linestatus AS estimate_id, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 2 END AS estimate_ord, l_returnflag AS division_id,
        CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS division_ord, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_extendedprice AS DECIMAL(18,2))) AS position_id, l_linenumber AS ordinal,
        CASE l_linenumber % 3 WHEN 0 THEN {work_name('p_name')} WHEN 1 THEN {work_name('p_name', D.OTHER_FORMS)} ELSE upper({work_name('p_name')}) || ',  ' END AS name,
        {pick(D.RAW_UNITS, 'p_size')} AS unit, CAST(l_quantity AS DECIMAL(18,6)) AS quantity, {_PRICES}, l_linenumber = 7 AS manual
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "catalogue": f"""SELECT p_partkey AS ord, 'P' || p_partkey AS code, {work_name('p_name')} AS name, {pick(D.UNITS, 'p_size')} AS unit, p_type AS category,
        CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS DECIMAL(18,6)) AS labor, CAST(CAST(p_retailprice AS DECIMAL(18,2)) * 0.5 AS DECIMAL(18,6)) AS material,
        CAST(CAST(p_retailprice AS DECIMAL(18,2)) * 0.1 AS DECIMAL(18,6)) AS machines FROM part""",
    "overrides": """SELECT code, name, 'кв. м' AS unit, CASE WHEN ord % 20 = 0 THEN '' ELSE 'ЗМІНА' END AS category, CAST(labor + 1 AS DECIMAL(18,6)) AS labor, material, machines FROM catalogue WHERE ord % 10 = 0
        UNION ALL SELECT 'N' || ord, name, 'кв. м', CASE WHEN ord % 20 = 0 THEN '' ELSE 'ЗМІНА' END, CAST(labor + 1 AS DECIMAL(18,6)), material, machines FROM catalogue WHERE ord % 100 = 0""",
    "history": f"""SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_extendedprice AS DECIMAL(18,2))) AS id, {key(work_name('p_name'), pick(D.UNITS, 'p_size'))} AS work_key, {work_name('p_name')} AS name,
        {pick(D.UNITS, 'p_size')} AS unit, {pick(D.PLACES, 's_nationkey')} AS city, {pick(D.AREAS, 's_suppkey')} AS region, {_PRICES}, o_orderdate AS created_at
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey WHERE p_size % 3 <> 0""",
    "site_prices": "SELECT ord, name, unit, CAST(labor + 10.50 AS DECIMAL(18,6)) AS price, category, 'site' AS site FROM catalogue WHERE ord % 3 = 0",
}


def with_views(sql: str, *names: str, **more: str) -> str:
    """WITH the named views (and those they need) and further expressions."""
    need = set(names)
    if need & {"overrides", "site_prices"}:
        need.add("catalogue")
    parts = [f"{n} AS ({VIEWS[n]})" for n in VIEWS if n in need] + [f"{n} AS ({q})" for n, q in more.items()]
    return f"WITH {', '.join(parts)} {sql}"
