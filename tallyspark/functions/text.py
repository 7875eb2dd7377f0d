"""Names, units and numbers as column expressions; all of it stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import fixed

_MARK = "̆̈"
_COMPOSED = {"й": "й", "Й": "Й", "ї": "ї", "Ї": "Ї", "ё": "ё", "Ё": "Ё"}


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def any_of(words: list[str]) -> str:
    """A pattern for any of the words, which hold no special characters."""
    return "(?:" + "|".join(words) + ")"


def fix_apostrophes(c: Column) -> Column:
    return F.translate(c, fixed.APOSTROPHES, "'" * len(fixed.APOSTROPHES))


def compose(c: Column) -> Column:
    """Join the letters and marks that Ukrainian text uses (see compose_all for the rest)."""
    for pair, letter in _COMPOSED.items():
        c = F.replace(c, F.lit(pair), F.lit(letter))
    return c


def composed(c: Column) -> Column:
    """NFC of a text. Only texts with a combining mark are composed, by the Unicode library that Spark itself comes with."""
    whole = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(False))
    return F.when(c.rlike(r"\p{M}"), whole).otherwise(c)


def compose_all(df: DataFrame, *columns: str) -> DataFrame:
    """NFC of string columns: for sources, before any other rule reads a text."""
    return df.withColumns({k: composed(F.col(k)) for k in columns})


#: Texts of spaces and of letters, digits and marks that no rule of cleaning changes: one quick pass tells most texts.
PLAIN = r"\A[\u0400-\u0481\u0490\u0491 !-_a-~\u00ab\u00bb\u00b2\u00b3\u2116\u2013\u2014]*\z"


def plain(c: Column) -> Column:
    """Whether spaces are all that cleaning may change in a text."""
    return c.rlike(PLAIN)


def single_spaced(c: Column) -> Column:
    """clean_text of a plain text."""
    return F.when(F.contains(c, F.lit("  ")), F.regexp_replace(F.trim(c), " {2,}", " ")).otherwise(F.trim(c))


def soft_clean(c: Column) -> Column:
    """Tabs and no-break spaces become spaces, the right end is trimmed; double spaces stay."""
    c = fix_apostrophes(compose(F.coalesce(c, F.lit(""))))
    return F.regexp_replace(F.translate(c, "\t    ", "     "), r"(?U)\s+$", "")


def clean_text(c: Column) -> Column:
    c = fix_apostrophes(compose(F.coalesce(c, F.lit(""))))
    c = F.regexp_replace(c, r"(?U)(?<=\w)-\s*\n\s*(?=\w)", "")
    c = F.translate(c, "\n\r\t   ", "      ")
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\s{2,}", " "), r"(?U)^\s+|\s+$", "")


#: What clean_text would change somewhere in a text.
DIRTY = rf"(?U)[\p{{M}}{fixed.APOSTROPHES.replace(chr(39), '')}\n\r\t\u00a0\u2007\u202f]|\s\s|^\s|\s$"


def clean_once(c: Column) -> Column:
    """clean_text for texts of which nearly all are clean: these are looked at, not rewritten."""
    return F.when(plain(c), single_spaced(c)).when(c.rlike(DIRTY), clean_text(c)).otherwise(F.coalesce(c, F.lit("")))


#: What soft_clean would change somewhere in a text.
SOFT_DIRTY = rf"(?U)[\p{{M}}{fixed.APOSTROPHES.replace(chr(39), '')}\t\u00a0\u2007\u202f\u2009]|\s$"


def soft_clean_once(c: Column) -> Column:
    """soft_clean as clean_once."""
    return F.when(plain(c), F.rtrim(c)).when(c.rlike(SOFT_DIRTY), soft_clean(c)).otherwise(F.coalesce(c, F.lit("")))


#: First letters of texts between which no white space and no digits but 0 to 9 lie.
_KNOWN = (("!", "~"), ("\u00a1", "\u0600"))


def first_letter(c: Column) -> Column:
    """The first letter after spaces; null where white space or a digit of another kind may come first."""
    first = F.substring(F.ltrim(c), 1, 1)
    return F.when(first.between(*_KNOWN[0]) | first.between(*_KNOWN[1]), first)


def starts_with_digit(c: Column) -> Column:
    """Whether a text starts with a digit after white space."""
    first = first_letter(c)
    return F.when(first.isNotNull(), first.between("0", "9")).otherwise(c.rlike(r"(?U)^\s*\d"))


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """df with these columns for good: filters on them stay above and do not compute them again."""
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))))


def clean_all(cells: Column) -> Column:
    """clean_text of each text of an array; arrays that it would not change are passed through."""
    whole = F.array_join(F.concat(F.array(F.lit("")), cells, F.array(F.lit(""))), "|", "\t")  # a null is not plain
    good = plain(whole) & ~F.contains(whole, F.lit("  ")) & ~F.contains(whole, F.lit(" |")) & ~F.contains(whole, F.lit("| "))
    each = F.transform(cells, lambda c: clean_once(F.coalesce(c, F.lit(""))))
    return F.when(good, cells).otherwise(each)


def name_tokens(c: Column) -> Column:
    """The words of a name that count: lower case, look-alikes unified, no marks, no stop words."""
    c = F.translate(F.lower(clean_once(c)), fixed.LATIN, fixed.CYRILLIC)
    c = F.regexp_replace(c, r"[\[\](){}«»\"“”/\\,;:.!?–—_+*]", " ")
    stop = F.array(*map(F.lit, ["", *fixed.STOP_WORDS]))
    return F.filter(F.split(F.regexp_replace(c, r"(?U)\s{2,}", " "), " "), lambda t: ~F.array_contains(stop, t))


def normalise_name(c: Column) -> Column:
    return F.array_join(name_tokens(c), " ")


def stem(token: Column) -> Column:
    """Cut the longest known ending that leaves four letters."""
    return F.regexp_replace(token, f"^(.{{{fixed.LEAST_STEM},}}?){any_of(fixed.ENDINGS)}$", "$1")


def stems(c: Column, normal: bool = False) -> Column:
    """normal: the name is normalised already."""
    return F.filter(F.transform(F.split(F.trim(c if normal else normalise_name(c)), r"(?U)\s+"), stem), lambda t: t != "")


def stem_phrase(c: Column, normal: bool = False) -> Column:
    """The stems joined by a space: one pass over the phrase. normal: the name is normalised already."""
    return F.regexp_replace(c if normal else normalise_name(c), rf"(?<!\S)(\S{{{fixed.LEAST_STEM},}}?){any_of(fixed.ENDINGS)}(?!\S)", "$1")


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also inside lambdas, where Spark shares nothing."""
    return F.element_at(F.transform(F.array(value), body), F.lit(1))


def unit_raw(c: Column, clean: bool = False) -> Column:
    """clean: the text is clean already."""
    return F.translate(F.trim(F.rtrim(F.lower(c if clean else clean_text(c)), F.lit("."))), "²³", "23")


def unit_of(raw: Column) -> Column:
    table = literal_map(fixed.UNIT_OF)
    return F.coalesce(F.try_element_at(table, raw), F.try_element_at(table, F.regexp_replace(raw, r"(?U)[\s.]", "")), raw)


#: Units that are written as unit_raw leaves them.
_AS_WRITTEN = {k: v for k, v in fixed.UNIT_OF.items() if k == k.lower().rstrip(".").strip(" ").translate(str.maketrans("²³", "23"))}


def known_unit(c: Column) -> Column:
    """normalise_unit of a text; most units are found as they are written, which are clean."""
    return F.coalesce(F.try_element_at(literal_map(_AS_WRITTEN), c), let(clean_once(c), lambda x: let(unit_raw(x, clean=True), unit_of)))


def normalise_unit(c: Column, clean: bool = False) -> Column:
    return unit_of(unit_raw(c, clean))


def unit_set(units: list[str]) -> list[str]:
    """The canonical units of a list of forms, by the rule of normalise_unit."""
    out = []
    for u in units:
        raw = u.lower().rstrip(".").strip().translate(str.maketrans("²³", "23"))
        out.append(fixed.UNIT_OF.get(raw) or fixed.UNIT_OF.get("".join(raw.split()).replace(".", "")) or raw)
    return sorted(set(out) - {""})


_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def parse_number(c: Column, kind: str = "double", clean: bool = False) -> Column:
    """Number with spaces between thousands, point or comma; null for anything else.

    clean: the text is clean already."""
    raw = F.replace(F.replace(c if clean else clean_text(c), F.lit(" "), F.lit("")), F.lit(","), F.lit("."))
    return F.when(c.isNotNull() & raw.rlike(_NUMBER), raw.try_cast("double")).try_cast(kind)


def looks_like_number(c: Column) -> Column:
    return parse_number(c).isNotNull()


def work_key(name: Column, unit: Column) -> Column:
    u = normalise_unit(unit)
    return F.when(u != "", F.concat_ws("|", stem_phrase(name), u)).otherwise(stem_phrase(name))


ACTION_STARTS = sorted({m[:5] for m in fixed.DEMOLITION + fixed.INSTALL if len(m) >= 5})


def is_action_word(token: Column) -> Column:
    return F.substring(token, 1, 5).isin(ACTION_STARTS)


def action_class(c: Column, normal: bool = False) -> Column:
    """demolition is looked for first: its marks may hold a mark of install. normal: the name is normalised already."""
    low = c if normal else normalise_name(c)
    return F.when(low.rlike(any_of(fixed.DEMOLITION)), "demolition").when(low.rlike(any_of(fixed.INSTALL)), "install").otherwise("")


def number_or_zero(c: Column, kind: str = "decimal(18,6)") -> Column:
    return F.coalesce(c.try_cast(kind), F.lit(0).cast(kind))


def money(c: Column) -> Column:
    return F.round(number_or_zero(c), 2).cast("decimal(18,2)")


def quantity(c: Column) -> Column:
    return number_or_zero(c)


def show_quantity(c: Column, separator: str = " ") -> Column:
    """Up to six digits, no zeros at the end, thousands apart."""
    text = F.regexp_replace(F.format_number(number_or_zero(c), 6), r"\.?0+$", "")
    return F.when(text == "", "0").otherwise(F.replace(text, F.lit(","), F.lit(separator)))


def source_label(c: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(fixed.SOURCE_LABELS), c), F.nullif(c, F.lit("")), F.lit("—"))


def json_or(c: Column, schema: str, default: Column) -> Column:
    """from_json, or the default where the field is null, empty or no JSON."""
    good = c.isNotNull() & (F.trim(c) != "") & F.try_parse_json(c).isNotNull()
    return F.when(good, F.coalesce(F.from_json(c, schema), default)).otherwise(default)
