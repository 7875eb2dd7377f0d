"""Pairs of words that are near very many others: what can be of no use is not made."""

from __future__ import annotations

import random

import numpy as np

from tallyspark.functions import alike
from tallyspark.operators import match as M


def _made(spark, monkeypatch):
    """The best items of random names, and how many pairs the near words make."""
    rng = random.Random(12)
    own = lambda: "".join(rng.choice("аб") for _ in range(9))
    names = [f"{rng.choice(['Демонтаж', 'Монтаж', 'Фарбування'])} {rng.choice(['вікон', 'дверей'])} {own()}" for _ in range(400)]
    items = [(k, f"C{k}", n, rng.choice(["м2", "шт", ""]), "", 1.0, 1.0, 1.0) for k, n in enumerate(names)]
    asked = [(n.replace("вікон", "вікна") if rng.random() < 0.5 else f"{n} зі склом", rng.choice(["кв.м", "штук", ""])) for n in names[:200]]
    items = spark.createDataFrame(items, "ord long, code string, name string, unit string, category string, labor double, material double, machines double")
    pairs, near = [], alike.near_pairs
    monkeypatch.setattr(alike, "near_pairs", lambda q, i: pairs.append(near(q, i)) or pairs[-1])
    found = M.match(spark.createDataFrame(asked, "name string, unit string"), items)
    return sorted(map(tuple, found.select("name", "unit", "rank", "code", "score").collect())), sum(p.count() for p in pairs)


def test_pairs_of_no_use(spark, monkeypatch):
    """Other units, opposite actions and places after sure ones make no pairs, and the results are those without these bounds."""
    with monkeypatch.context() as m:
        got, few = _made(spark, m)
    with monkeypatch.context() as m:
        m.setattr(alike, "_named", lambda c: np.full(len(c), -1))  # units and actions unknown
        places = alike._places
        m.setattr(alike, "_places", lambda c, missing: tuple(x * 0 for x in places(c, 0)))  # and all places the same
        want, many = _made(spark, m)
    assert got == want and 0 < few < many / 2
