"""Nearest colours against every pair, at many sizes of cells."""

import random

import pytest
from pyspark.sql import functions as F

from colorjobs.functions.colors import hex_to_lab, hex_to_rgb
from colorjobs.operators.mapping import nearest_color


def plain(spark, colours, keys, metric):
    """Each colour's nearest key, from all pairs in doubles."""
    place = (lambda c: hex_to_lab(F.col(c))) if metric == "lab" else (lambda c: hex_to_rgb(F.col(c)))
    of = lambda hexes: {r.h: tuple(r.p) for r in spark.createDataFrame([(h,) for h in hexes], "h string").distinct().select("h", place("h").alias("p")).collect()}
    away = lambda p, q: sum((x - y) * (x - y) for x, y in zip(p, q, strict=True)) ** 0.5
    cs, ks = of(colours), of([k for k, _ in keys])
    first = {}
    for k, o in keys:
        first[k] = min(o, first.get(k, o))
    out = {}
    for c, p in cs.items():
        d, _, k = min((away(p, ks[k]), o, k) for k, o in first.items())
        out[c] = (k, round(d, 6))
    return out


def colour(r, low=0, high=255):
    return "#" + "".join(f"{r.randint(low, high):02X}" for _ in range(3))


CASES = [("dark", "lab", 40), ("dark", "rgb", 1), ("anywhere", "lab", 50_000), ("anywhere", "rgb", 40), ("one", "lab", 1)]


@pytest.mark.parametrize(("where", "metric", "most_keys"), CASES)
def test_like_every_pair(spark, where, metric, most_keys):
    """Keys in one corner are far from most colours; repeated keys and equal distances go to the smallest ord, then source."""
    r = random.Random(5)
    keys = {"dark": [(colour(r, 0, 30), i % 7) for i in range(150)], "anywhere": [(colour(r), i % 5) for i in range(60)], "one": [("#00FF00", 3), ("#00FF00", 1)]}[where]
    colours = [colour(r) for _ in range(120)] + ["#000000", "#FFFFFF", "#0000FF", "#FF00FF"] + [keys[0][0]]
    got = nearest_color(spark.createDataFrame([(c,) for c in colours], "hex string"), spark.createDataFrame(keys, "source string, ord long"), metric, most_keys)
    rows = got.collect()
    assert len(rows) == len(set(colours))
    assert {x.hex: (x.via, round(x.distance, 6)) for x in rows} == plain(spark, colours, keys, metric)


def test_no_keys_and_no_colours(spark):
    some, none = spark.createDataFrame([("#123456",), (None,)], "hex string"), spark.createDataFrame([], "source string, ord long")
    assert nearest_color(some, none).count() == 0
    key = spark.createDataFrame([("#FFFFFF", 1), (None, 2), ("blue?", 3)], "source string, ord long")
    assert nearest_color(some.limit(0), key).count() == 0
    assert [(x.hex, x.via) for x in nearest_color(some, key).collect()] == [("#123456", "#FFFFFF")]
