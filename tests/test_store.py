"""The bucketed store, changes in place, streams on top of it."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from colorjobs.operators import changes, mapping
from colorjobs.sources import tables
from colorjobs.sources.store import Spec, Store
from colorjobs.streaming import streams

SVG = '<svg xmlns="http://www.w3.org/2000/svg">{}</svg>'


def svg(*colors):
    return SVG.format("".join(f'<rect fill="{c}"/>' for c in colors))


def rows_of(df):
    return sorted(str(tuple(r)) for r in df.collect())


def files_under(path):
    return {str(p): p.stat().st_mtime_ns for p in Path(path).rglob("part-*.parquet")}


def small(spark, path, **more):
    return Store(spark, path, {"t": Spec("k string, v long", ("k",), 8)}, **more)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), "k string, v long")


def test_upsert_generations_and_compaction(spark, tmp_path):
    store = small(spark, str(tmp_path), most=3)
    assert store.read("t").count() == 0 and store.manifest()["number"] == 0
    want = {}
    for n in range(9):
        new = {f"k{(n * 5 + i) % 17}": n for i in range(6)}
        want |= new
        assert store.upsert(f"c{n}", {"t": frame(spark, *((k, v) for k, v in new.items() for _ in range(2)))})  # a unit of two rows
        assert rows_of(store.read("t")) == sorted(str((k, v)) for k, v in want.items() for _ in range(2))
    assert all(len(g) <= 3 for g in store.manifest()["tables"]["t"].values())
    before = len(files_under(tmp_path))
    assert store.vacuum() > 0 and len(files_under(tmp_path)) < before
    assert rows_of(store.read("t")) == sorted(str((k, v)) for k, v in want.items() for _ in range(2)) and store.vacuum() == 0
    assert [n for n in os.listdir(tmp_path / "_commits") if n.endswith(".json")] == ["0000000009.json"]


def test_commits_can_be_repeated(spark, tmp_path, monkeypatch):
    store = small(spark, str(tmp_path))
    store.upsert("one", {"t": frame(spark, *((f"k{i}", i) for i in range(40)))})
    before = files_under(tmp_path)
    assert not store.upsert("one", {"t": frame(spark, ("k1", 99))}) and files_under(tmp_path) == before
    hit = frame(spark, ("k3", 0))

    def change():
        return store.change("two", {"t": hit}, lambda t: {"t": t["t"].where("k != 'k3'").unionByName(frame(spark, ("k3", -3)))})

    with monkeypatch.context() as m:  # the driver is lost before the manifest is in place
        m.setattr(Store, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            change()
    assert store.manifest()["commit"] == "one" and store.read("t").where("v = 3").count() == 1
    assert change() and not change()
    assert [r.v for r in store.read("t").where("k = 'k3'").collect()] == [-3] and store.read("t").count() == 40
    assert before.items() <= files_under(tmp_path).items()  # no file of the first commit was written again
    told = store.manifest()["tables"]["t"]
    assert sum(g == [2] for g in told.values()) == 1 and sum(g == [1] for g in told.values()) == len(told) - 1
    monkeypatch.setattr(Store, "manifest", lambda self: {"number": 1, "commit": "x", "tables": {}})
    with pytest.raises(RuntimeError):  # a writer that has not seen the second commit
        store.upsert("three", {"t": hit})


def library(spark, path):
    """A store with three files, and the same tables."""
    t = {
        "global_map": spark.createDataFrame([("cmyk", "#AA0000", "#110000", "", "", 1), ("cmyk", "#BB0000", "#BB0000", "", "", 2), ("grayscale", "#AA0000", "#222222", "", "", 3)],
            "pipeline string, source string, target string, label string, notes string, ord long"),
        "overrides": spark.createDataFrame([(f"f{i}", p, s, t) for i in range(30) for p, s, t in (("cmyk", "#AA0000", f"#0000{i:02d}"), ("grayscale", "#CC0000", "#CC0000"))
            if i % 3 or p == "grayscale"], "file string, pipeline string, source string, target string"),
        "device": spark.createDataFrame([("f1", "#AA0000", (1.0, 2.0, 3.0, 4.0)), ("f2", "#DD0000", (1.0, 2.0, 3.0, 4.0))],
            "file string, source string, cmyk struct<c:double,m:double,y:double,k:double>"),
        "illustrations": spark.createDataFrame([(f"f{i}", "reviewed" if i % 2 else "pending", "pending", False, "") for i in range(30)],
            "file string, status string, cmyk_status string, cmyk_auto_fix boolean, notes string").withColumn("updated_at", F.lit("2024-01-01").cast("timestamp")).select(
                "file", "status", "cmyk_status", "cmyk_auto_fix", "updated_at", "notes"),
    }
    store = changes.library_store(spark, path)
    changes.load(store, "load", t)
    return store, t


def test_changes_in_place(spark, tmp_path):
    """Each change gives what the change of whole tables gives, and leaves buckets without hits alone."""
    swatches = spark.createDataFrame([("p_1", "#EE0000", "l", "n", ["#AA0000", "#AB0000", "#EE0000"])], "id string, source_hex string, label string, notes string, members array<string>")
    store, t = library(spark, str(tmp_path / "a"))
    before = files_under(tmp_path / "a" / "overrides")
    assert changes.replace_globally(store, "merge", swatches, "cmyk") and not changes.replace_globally(store, "merge", swatches, "cmyk")
    g, o = mapping.replace_globally(t["global_map"], t["overrides"], swatches, "cmyk")
    assert rows_of(store.read("overrides")) == rows_of(o) and rows_of(store.read("global_map")) == rows_of(g.select(*store.read("global_map").columns))
    hit = set(store.touched("overrides", t["overrides"].where("pipeline = 'cmyk'")))
    told = store.manifest()["tables"]["overrides"]
    assert {int(b) for b, gens in told.items() if gens == [2]} <= hit and any(gens == [1] for gens in told.values())
    assert before.items() <= files_under(tmp_path / "a" / "overrides").items()

    store, t = library(spark, str(tmp_path / "b"))
    files = spark.createDataFrame([("f1",), ("f2",), ("f6",), ("nowhere",)], "file string")
    changes.wipe_pipeline(store, "wipe", files, "cmyk")
    done = mapping.wipe_pipeline(t["illustrations"], t["overrides"], t["device"], files, "cmyk")
    for n in ("illustrations", "overrides", "device"):
        assert rows_of(store.read(n)) == rows_of(done[n].select(*store.read(n).columns)), n
    now = rows_of(store.read("overrides"))
    changes.cleanup_identity(store, "clean", "grayscale")
    assert rows_of(store.read("overrides")) == [r for r in now if "'#CC0000', '#CC0000'" not in r] and store.read("global_map").count() == 3
    changes.cleanup_identity(store, "clean cmyk", "cmyk")
    assert store.read("global_map").count() == 2
    changes.mark_status(store, "mark", spark.createDataFrame([("f4",), ("nowhere",)], "file string"), "exported", F.lit("2025-01-01").cast("timestamp"))
    assert [r.file for r in store.read("illustrations").where("status = 'exported' and year(updated_at) = 2025").collect()] == ["f4"]

    other, t = library(spark, str(tmp_path / "c"))
    resets = spark.createDataFrame([("f4", "#AA0000"), ("f5", "#DD0000")], "file string, hex string")
    changes.reset_colors(other, "reset", resets, "cmyk")
    g, o, d = mapping.reset_colors(t["global_map"], t["overrides"], t["device"], resets, "cmyk")
    assert [rows_of(other.read(n)) for n in ("global_map", "overrides", "device")] == [rows_of(x) for x in (g, o, d)]
    found = changes.mapping_diff(other, changes.library_store(spark, str(tmp_path / "a")), "cmyk")
    assert found.where("file = 'f4'").count() == 0 and found.where("file = 'f1'").first().after is None
    rows = t["global_map"].limit(0).unionByName(spark.createDataFrame([("cmyk", "#BB0000", "#123456", "new", "", 9)], t["global_map"].schema)).drop("ord")
    changes.upsert_map(other, "upsert", rows)
    changes.remove_map(other, "remove", spark.createDataFrame([("grayscale", "#AA0000")], "pipeline string, source string"))
    assert [(r.source, r.target, r.ord) for r in other.read("global_map").collect()] == [("#BB0000", "#123456", 2)]


# --- streams -----------------------------------------------------------------------------------------------------------


def feed(folder, name, content, at):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(content)
    os.utime(folder / name, (at, at))


def test_stream_usage_state(spark, tmp_path):
    """Newer versions replace, older ones that come later do not, a document without colours empties its file, and what is
    held follows the files."""
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    rows = [("a", svg("red"), 10), ("a", svg("blue", "blue"), 20), ("b", svg("lime"), 10)], [("a", svg("black"), 15), ("b", svg("white"), 30)], [("b", svg(), 40), ("c", "<svg", 5)]

    def run():
        stream = spark.readStream.schema("file string, content string, mtime timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        streams.stream_usage(stream, out, check).awaitTermination()
        return {(r.file, r.hex, r.n) for r in streams.current_usage(spark, out).collect()}

    want = [{("a", "#0000FF", 2), ("b", "#00FF00", 1)}, {("a", "#0000FF", 2), ("b", "#FFFFFF", 1)}, {("a", "#0000FF", 2)}]
    for batch, expected in zip(rows, want, strict=True):
        df = spark.createDataFrame(batch, "file string, content string, t long").withColumn("mtime", F.timestamp_seconds("t")).drop("t")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        assert run() == expected  # each run is a restart
    store = streams.usage_store(spark, out)
    assert store.read("seen").count() == 3 and {r.file for r in store.read("usage").collect()} == {"a", "b", "c"}
    assert run() == want[-1]


def test_stream_usage_many_files(spark, tmp_path):
    """Past the checked number of files the other way gives the same."""
    folder = tmp_path / "in"
    for i in range(12):
        feed(folder, f"f{i}.svg", svg("red", "#00f"), 1e9 + i)
    for few in (100, 3):
        out = str(tmp_path / f"out{few}")
        streams.stream_usage(streams.stream_svgs(spark, str(folder)), out, str(tmp_path / f"check{few}"), few=few).awaitTermination()
        assert rows_of(streams.current_usage(spark, out)) == sorted(str((f"f{i}.svg", h, 1)) for i in range(12) for h in ("#FF0000", "#0000FF"))


def test_contents_are_not_exchanged(spark, tmp_path):
    """Neither reading a library nor counting its documents sends a content column anywhere."""
    feed(tmp_path / "in", "a.svg", svg("red"), 1e9)
    svgs = tables.read_svgs(spark, str(tmp_path / "in"))
    plan = svgs._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
    assert [r.file for r in tables.svg_names(svgs).collect()] == ["a.svg"]
    assert "content" not in tables.svg_names(svgs)._jdf.queryExecution().executedPlan().toString().split("Scan")[0]
    fresh = spark.createDataFrame([("a.svg",)], "file string").withColumn("mtime", F.timestamp_seconds(F.lit(1_000_000_000)))
    docs = svgs.select("file", "mtime", "content").join(F.broadcast(fresh), ["file", "mtime"], "left_semi")
    counts = streams.document_counts(docs)
    lines = counts._jdf.queryExecution().executedPlan().toString().splitlines()
    exchanges = [i for i, x in enumerate(lines) if "Exchange" in x and "Broadcast" not in x]
    assert exchanges and not any("content" in lines[i + 1] for i in exchanges)
    assert [(r.file, [(c.hex, c.n) for c in r.counts]) for r in counts.collect()] == [("a.svg", [("#FF0000", 1)])]


def test_stream_status(spark, tmp_path):
    """Late events change nothing, events too late are dropped, and a batch touches the buckets of its own files."""
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    day = 86_400
    batches = [[("a", 10 * day, "reviewed"), ("b", 10 * day, "odd")], [("a", 10 * day - 60, "exported"), ("b", 10 * day + 5, "in_progress")], [("c", 30 * day, "exported")],
        [("d", 2 * day, "reviewed"), ("c", 30 * day, "reviewed")]]
    want = [{"a": "reviewed", "b": "pending"}, {"a": "reviewed", "b": "in_progress"}, {"a": "reviewed", "b": "in_progress", "c": "exported"}]
    want.append(want[-1] | {"c": "reviewed"})
    for rows, expected in zip(batches, want, strict=True):
        df = spark.createDataFrame(rows, "file string, t long, status string").withColumn("ts", F.timestamp_seconds("t")).drop("t")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        before = streams.status_store(spark, out).manifest()["tables"].get("status", {})
        events = spark.readStream.schema("file string, ts timestamp, status string").parquet(str(tmp_path / "in"))
        streams.stream_status(events, out, check).awaitTermination()
        assert {r.file: r.status for r in streams.current_status(spark, out).collect()} == expected
        store = streams.status_store(spark, out)
        after = store.manifest()["tables"]["status"]
        assert {int(b) for b in after if after[b] != before.get(b)} <= set(store.touched("status", df))
    table = spark.read.parquet(str(tmp_path / "in"))
    assert {r.file: r.status for r in streams.latest_status(table).collect()} == want[-1] | {"d": "reviewed"}
