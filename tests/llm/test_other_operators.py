import random

import numpy as np
import plain
import pytest
from pyspark.sql import functions as F

import compare
from colorjobs.llm import chat, mixing, neighbours, registry, urls

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql(spark, name):
    assert compare.differences(registry.QUERIES[name](spark, SF), compare.oracle(SF), registry.SQL[name]) is None


def test_urls_edges(spark):
    rows = [(1, None), (2, "no scheme"), (3, "HTTP://A.NET/x?y#z"), (4, "https://example.net/en/"), (5, "x://example.net"),
        (6, "x://b.example.com/de/1"), (7, "x://org/fr/"), (7, "x://org/fr/"), (8, "x://sub.org?q=/"), (9, "x://notnet/")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash"))
    outcomes = spark.createDataFrame([(1, 1), (3, None), (9, 0), (9, 0), (9, 0)], "page_id long, good int")
    out = {r.page_id: r for r in urls.judge_urls(pages, outcomes).collect()}
    assert (out[1].host, out[1].path, out[1].rule) == ("", "", None) and out[2].host == ""
    assert (out[3].host, out[3].path, out[3].rule, out[3].verdict) == ("a.net", "/x", "net/", "block")
    assert (out[4].rule, out[4].verdict) == ("example.net/en/", "allow") and out[5].rule is None
    assert out[6].verdict == "block" and out[7].verdict == "allow" and (out[8].host, out[8].path) == ("sub.org", "") and out[9].rule is None
    assert urls.judge_urls(pages, outcomes.limit(0)).count() == len(rows) and urls.judge_urls(pages.limit(0), outcomes).count() == 0


def test_urls_unlabelled_hosts(spark):
    """Hosts without outcomes say nothing about the spread: one bad host among many of them is still blocked."""
    hosts = [f"x://h{h}.com/" for h in range(10) for _ in range(30)] + [f"x://u{h}.com/" for h in range(500)]
    pages = spark.createDataFrame(list(enumerate(hosts)), "page_id long, url string")
    outcomes = spark.createDataFrame([(i, int(i >= 30)) for i in range(300)], "page_id long, good int")
    out = {r.host: r.verdict for r in urls.judge_urls(pages, outcomes).collect()}
    assert out.pop("h0.com") == "block" and set(out.values()) == {"allow"}


def test_mixing(spark):
    rows = [(i, " ".join("w" * (i % 17 + 1)), [None, "a", "b", "B", "ä", "tiny"][i % 5 if i > 3 else 5]) for i in range(600)] + [(1000, None, "a"),
        (1001, "", "zero"), (7, " ".join("w" * 8), "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit(-1))
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = plain.targets(sizes)
    out = mixing.mix(df).collect()
    assert len(out) == len(rows)
    got = {}
    for r in out:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 and 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        got[r.source] = got.get(r.source, 0) + r.taken
    assert all(abs(got[s] - want[s]) <= max(2, 0.005 * want[s]) for s in want)
    again = mixing.mix(df.repartition(7)).collect()
    key = lambda x: sorted((r.doc_id, r.size, r.taken) for r in x)
    assert key(out) == key(again)
    assert mixing.mix(df.limit(0)).count() == 0
    docs = df.drop("size").withColumn("lang", F.lit("x"))
    staged = mixing.stage_mix(spark, docs, "")
    assert staged.columns == docs.columns and staged.count() == sum(r.copies for r in out)


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    v = {i: rng.standard_normal(16) for i in range(400)}
    v[3] = v[2] = v[1] = v[0].copy()
    rows = [(i, [float(c) for c in x]) for i, x in v.items()]
    bad = [(500, None), (550, [0.0] * 16), (600, [float("nan")] * 16), (650, [1.0]), (700, [None] * 16)]
    df = spark.createDataFrame(rows + bad, "id long, v array<double>")
    out = neighbours.search(df, F.expr("id % 50 = 0"), row_block=64, query_block=3).collect()
    found = {}
    for r in sorted(out, key=lambda r: r["rank"]):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert sorted(found) == list(range(0, 400, 50)) and all(len(x) == 5 for x in found.values())
    hits = 0
    for q, x in found.items():
        truth = plain.nearest(v, q)
        hits += len({i for i, _ in x} & {i for i, _ in truth})
        assert x == sorted(x, key=lambda p: (-p[1], p[0])) and all(abs(dict(truth).get(i, s) - s) < 1e-12 for i, s in x)
    assert [i for i, _ in found[0][:3]] == [1, 2, 3] and hits >= 0.9 * 5 * len(found)
    few = df.where("id in (0, 1, 7)")
    assert neighbours.search(few, F.expr("id = 0")).count() == 2
    assert neighbours.search(df.limit(0), F.lit(True)).count() == 0 and neighbours.search(df, F.lit(False)).count() == 0


def test_neighbours_recall(spark):
    out = neighbours.op7_neighbours(spark, SF).collect()
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    v = {r.vec_id: np.array(r.embedding, float) for r in rows}
    found = {}
    for r in out:
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = [len(found[q] & {i for i, _ in plain.nearest(v, q)}) / 5 for q in v if q % 50 == 0]
    assert np.mean(hits) >= 0.9


def test_chat_recovers_roles(spark):
    turns = chat.spoken_turns(spark, SF)
    learn, held = F.pmod(F.xxhash64("conv_id"), F.lit(4)) != 0, F.pmod(F.xxhash64("conv_id"), F.lit(4)) == 0
    model = chat.fit(turns.where(learn))
    pieces = turns.where(held).select("conv_id", F.col("turn").alias("piece"), "text")
    got = {(r.conv_id, r.piece): r.role for r in chat.parse(pieces, model).where("line = 0").collect()}
    truth = {(r.conv_id, r.turn): r.role for r in turns.where(held).collect()}
    assert sum(got.get(k) == v for k, v in truth.items()) > 0.8 * len(truth)  # a fifth of the turns have no marker


def test_chat_blocks_change_nothing(spark):
    turns = chat.spoken_turns(spark, SF)
    model = chat.fit(turns)
    one = turns.where("turn < 6").select(F.lit(1).cast("long").alias("conv_id"), (F.col("conv_id") * 10 + F.col("turn")).alias("piece"), "text")
    small, large = (sorted((r.piece, r.line, r.role) for r in chat.parse(one, model, block).where("not continued").collect()) for block in (40, 100_000))
    assert small == large
    lines = sorted(chat.lines_of(one.withColumn("h", F.xxhash64("text")), "piece", "h").collect(), key=lambda r: (r.piece, r.h, r.line))
    path = plain.viterbi(model.first, model.step, model.scores([r.symbol for r in lines]))
    begun = [(r.piece, r.line, model.states[s][0]) for r, s in zip(lines, path, strict=True) if model.states[s][1]]
    assert [x for x in large if x in set(begun)] == begun


def test_chat_null_and_negative_turns(spark):
    model = chat.fit(chat.spoken_turns(spark, SF))
    numbers = [None, -200, -1, 0, 1, 70, 5000]
    said = [(c, p, f"{mark}: text {p}\nand more?") for c, ps in ((1, numbers), (2, [None, 3]), (3, [-1, 0]), (None, numbers)) for p,
        mark in zip(ps, ["User", "AI"] * 4)]
    df = spark.createDataFrame(said, "conv_id long, piece long, text string")
    place = lambda piece, line: (piece is not None, piece or 0, line)
    lines, out = chat.lines_of(df, "conv_id", "piece").collect(), chat.parse(df, model).collect()
    assert sum(r.n_lines for r in out) == len(lines)
    for conv in (1, 2, 3, None):
        own = sorted((r for r in lines if r.conv_id == conv), key=lambda r: place(r.piece, r.line))
        path = plain.viterbi(model.first, model.step, model.scores([r.symbol for r in own]))
        begun = [(r.piece, r.line, model.states[s][0]) for r, s in zip(own, path, strict=True) if model.states[s][1]]
        got = sorted((r for r in out if r.conv_id == conv and not r.continued), key=lambda r: place(r.piece, r.line))
        assert [(r.piece, r.line, r.role) for r in got] == begun and got[0].piece == own[0].piece


def test_chat_query_learns_from_all_turns(spark, monkeypatch):
    seen, fit = [], chat.fit
    monkeypatch.setattr(chat, "fit", lambda turns, *a: seen.append(turns.count()) or fit(turns, *a))
    chat.op3_chat(spark, "/root/testdata/sf0.001")
    assert seen == [spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").count()]


def test_chat_edges(spark):
    df = spark.createDataFrame([(1, None, "User: hi\nAI: yo"), (1, 2, None), (2, 1, ""), (None, 1, "hello")], "conv_id long, piece long, text string")
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert {r.conv_id for r in chat.parse(df, chat.fit(none)).collect()} == {1, None} and chat.parse(df.limit(0), chat.fit(none)).count() == 0


def test_targets_of_many_sources(spark):
    """The same targets in one range and in several: excess over several rounds, sizes of zero, a null source, one source."""
    r = random.Random(12)
    sizes = {f"s{i:03d}": int(1.35 ** r.randrange(45)) for i in range(120)} | {"z": 0, "\U0001f600": 7, "￮": 900, None: 40}
    for some in (sizes, {None: 5}, {"a": 0, "b": 0}, {"a": 1, "b": 1_000_000, "c": 10}):
        rows = spark.createDataFrame(list(some.items()), "source string, source_size long")
        want = plain.targets(some)
        for tasks in (1, 5):
            got = {x.source: x.target for x in mixing.source_targets(rows.repartition(3), tasks=tasks).collect()}
            assert got.keys() == want.keys() and all(abs(got[s] - want[s]) <= 1e-9 * max(1, want[s]) for s in want)
    assert mixing.source_targets(rows.limit(0)).count() == 0 and mixing.tasks_for(0) == 1 and mixing.tasks_for(250_000) == 2


def test_mix_in_several_tasks_of_sources(spark, monkeypatch):
    r = random.Random(2)
    docs = [(i, "w " * r.randrange(30), f"s{r.randrange(9)}") for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    want = sorted((x.doc_id, x.copies) for x in mixing.mix(df).collect())
    monkeypatch.setattr(mixing, "SOURCES", 3)
    assert sorted((x.doc_id, x.copies) for x in mixing.mix(df).collect()) == want
