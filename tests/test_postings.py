"""The posting index: refreshed, probed, and k-means beside a plain Lloyd version."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from colorjobs.functions.colors import hex_to_lab
from colorjobs.operators import palette, postings


def test_index_follows_changes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "SPAN", 8)  # several blocks
    store = postings.index_store(spark, str(tmp_path))
    r, state = random.Random(6), {}
    for step in range(4):
        changed = {f"f{r.randrange(40):02d}": [f"#00000{r.randrange(6)}" for _ in range(r.randrange(4))] for _ in range(12)}
        before = [(f, h) for f in changed for h in state.get(f, [])]
        state |= changed
        frame = lambda rows: spark.createDataFrame(rows, "file string, hex string")
        after = frame([(f, h) for f, hs in changed.items() for h in hs or [None]])
        assert postings.refresh(store, f"c{step}", frame(before), after)
        assert not postings.refresh(store, f"c{step}", frame(before), after)
        want = {(h, f) for f, hs in state.items() for h in hs}
        colors = frame([("", f"#00000{i}") for i in range(7)])
        assert {(x.hex, x.file) for x in postings.files_of(store, colors).collect()} == want
        count = {h: len({f for g, f in want if g == h}) for h, _ in want}
        assert {x.hex: x.n_files for x in postings.document_frequency(store).collect()} == count
    assert store.read("postings").agg(F.max("n")).first()[0] <= 8 and store.read("numbers").count() == len(state)
    swatches = spark.createDataFrame([("p", "#000009", ["#000001", "#000002", "#000002"]), ("q", "#000009", ["#FFFFFF"])], "id string, source_hex string, members array<string>")
    assert {x.id: x.n_files for x in postings.palette_usage(store, swatches).collect()} == {"p": len({f for h, f in want if h in ("#000001", "#000002")}), "q": 0}
    owners = sorted(f for h, f in want if h == "#000001")
    over = spark.createDataFrame([(f, "#000001") for f in [owners[0], "nowhere"]], "file string, source string")
    assert [(x.id, x.file) for x in postings.overridden_files(store, swatches, over).collect()] == [("p", owners[0])]


def test_a_probe_reads_its_buckets_only(spark, tmp_path):
    store = postings.index_store(spark, str(tmp_path))
    rows = spark.range(3000).select(F.format_string("f%d", F.col("id") % 100).alias("file"), F.format_string("#%06X", F.col("id") % 500).alias("hex"))
    postings.refresh(store, "all", rows.limit(0), rows)
    one = spark.createDataFrame([("#000007",)], "hex string")
    files = postings.probe(store, one).inputFiles()
    assert files and {f.split("bucket=")[1].split("/")[0] for f in files if "postings" in f} == {str(b) for b in store.touched("postings", one)}


def test_kmeans_against_plain_lloyd(spark):
    """The same start, means and end as rounds over single points."""
    r = random.Random(4)
    colors = sorted({f"#{r.randrange(1 << 24):06X}" for _ in range(150)})
    df = spark.createDataFrame([(c,) for c in colors], "hex string")
    at = {x.hex: (x.p.L, x.p.a, x.p.b) for x in df.select("hex", hex_to_lab(F.col("hex")).alias("p")).collect()}
    by_hash = sorted(colors, key=lambda c: hashlib.sha256(c.encode()).hexdigest())
    centres, old = [at[c] for c in by_hash[:6]], None
    away = lambda p, q: sum((x - y) ** 2 for x, y in zip(p, q, strict=True))
    for _ in range(50):
        own = {c: min(range(6), key=lambda i: away(at[c], centres[i])) for c in colors}
        new = []
        for i in range(6):
            mine = [at[c] for c in colors if own[c] == i]
            assert mine  # the seed leaves no cluster empty
            new.append(tuple(sum(x) / len(mine) for x in zip(*mine, strict=True)))
        drift, same = max(away(p, q) ** 0.5 for p, q in zip(centres, new, strict=True)), own == old
        centres, old = new, own
        if drift < 0.5 and same:
            break
    final = {c: min(range(6), key=lambda i: away(at[c], centres[i])) for c in colors}
    want = sorted(sorted(c for c in colors if final[c] == i) for i in range(6))
    got = {}
    for x in palette.kmeans_members(df.repartition(3), 6).collect():
        got.setdefault(x.id, []).append(x.hex)
    assert sorted(sorted(v) for v in got.values()) == want
    for x in palette.kmeans_palette(df, 6).collect():
        mine = got[x.id]
        mean = tuple(sum(at[c][k] for c in mine) / len(mine) for k in range(3))
        assert x.n_members == len(mine) and away((x.L, x.a, x.b), mean) < 1e-12
        assert abs(away(at[x.source_hex], mean) - min(away(at[c], mean) for c in mine)) < 1e-9


def test_boxes_count_as_whole_only_where_one_centre_owns_them():
    """Every place of a settled box is nearest to its owner; a box with a tie or a border inside is not settled."""
    rng = np.random.default_rng(3)
    low = rng.uniform(0, 60, (400, 3))
    high, centres = low + rng.uniform(0, 4, (400, 3)), rng.uniform(0, 60, (9, 3))
    own = palette.sole_owners(low, high, centres)
    assert (own >= 0).sum() > 50 and (own < 0).sum() > 20
    for i in np.flatnonzero(own >= 0):
        assert (palette.nearest(rng.uniform(low[i], high[i], (200, 3)), centres)[0] == own[i]).all()
    two = np.array([[0.0, 0, 0], [10.0, 0, 0]])
    assert palette.sole_owners(np.array([[4.0, 0, 0], [5.0, 0, 0]]), np.array([[4.5, 1, 1], [5.0, 0, 0]]), two).tolist() == [0, -1]
    assert palette.sole_owners(low, high, centres[:1]).tolist() == [0] * 400
    assert palette.nearest(np.array([[5.0, 0, 0]]), two)[0].tolist() == [0]


def test_kmeans_is_the_same_for_every_size_of_box_and_task(spark, monkeypatch):
    r = random.Random(8)
    df = spark.createDataFrame([(f"#{r.randrange(1 << 24):06X}",) for _ in range(1500)] + [("none",), (None,)], "hex string")
    want = sorted(palette.kmeans_palette(df, 7).collect())
    for side, task in ((25, 200), (1, 700)):
        monkeypatch.setattr(palette, "SIDE", side)
        monkeypatch.setattr(palette, "TASK", task)
        assert sorted(palette.kmeans_palette(df.repartition(5), 7).collect()) == want
