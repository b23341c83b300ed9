import functools
import hashlib
import random
import zlib

import duckdb
import numpy as np
import plain
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from colorjobs.llm import decontaminate, language, quality, simhash, substrings, tokens

random.seed(5)
VOCABULARY = [f"w{i}" for i in range(60)] + ["The", "é", "ﬁn", "x,"]


def words(n):
    return [random.choice(VOCABULARY) for _ in range(n)]


@functools.cache
def corpus():
    passage, line = " ".join(words(45)), " ".join(words(22))
    out = [None, "", "  \n\t", "one", "a b c", " ".join(["same"] * 70), passage, passage,
        " ".join(words(30)) + " " + passage + "\n" + " ".join(words(5)), line + " " + line, " ".join(words(4000))]
    out += [" ".join(words(10)) + f" u{i} " + line + f" v{i} " + " ".join(words(8)) for i in range(12)]
    near = words(300)
    out += [" ".join(near), " ".join([*near[:150], "changed", *near[151:]]), " ".join(near).upper()]
    return list(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), "doc_id long, text string").withColumn("text_", F.lit("clash")).withColumn("m", F.lit(1)).repartition(3).cache()


@pytest.mark.parametrize("shard_rows", [2000, 2])
def test_repeats(spark, docs, shard_rows):
    found = substrings.remove_repeats(docs, shard_rows=shard_rows).collect()
    expected = plain.removed(corpus())
    assert len(found) == len(expected)
    for r in found:
        n, kept = substrings.kept_words(r.text, [(s["from"], s["to"]) for s in r.spans or ()])
        assert (n, n - len(kept)) == expected[r.doc_id][:2], r.doc_id


def test_repeats_random(spark):
    random.seed(11)
    rows = [(i, " ".join(random.choice("ab") if i % 2 else random.choice("abcdefgh") for _ in range(random.randrange(0, 90)))) for i in range(40)]
    found = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window=8, gram=3).collect()
    expected = plain.removed(rows, 8)
    assert {r.doc_id: sum(1 for _ in range(0)) + substrings.kept_words(r.text,
        [(s["from"], s["to"]) for s in r.spans or ()])[0] - len(substrings.kept_words(r.text,
            [(s["from"], s["to"]) for s in r.spans or ()])[1]) for r in found} == {k: v[1] for k, v in expected.items()}


def test_repeats_same_ids(spark):
    text = " ".join(f"z{i}" for i in range(30))
    df = spark.createDataFrame([(1, text), (1, text + " more"), (None, text), (None, None)], "doc_id long, text string")
    found = {(r.doc_id, r.text): bool(r.spans) for r in substrings.remove_repeats(df).collect()}
    assert found[None, text] is False and found[1, text] and found[1, text + " more"] and not found[None, None]
    assert substrings.remove_repeats(df.limit(0)).count() == 0


def test_automaton_matches():
    a = substrings.SuffixAutomaton()
    seqs = [list("abcabd"), list("xabcab"), list("bcabdd")]
    for k, s in enumerate(seqs):
        a.add(s, k)
    for n in (1, 2, 3, 4):
        for s in seqs:
            for end, (k, i) in a.matches(s, n):
                piece = s[end - n + 1 : end + 1]
                first = next((k2, j + n - 1) for k2, t in enumerate(seqs) for j in range(len(t) - n + 1) if t[j : j + n] == piece)
                assert (k, i) == first


def test_decontaminate(spark, docs):
    c = corpus()
    items = [(1, c[6][1]), (2, "A b C"), (3, None), (4, ""), (2, "A b C"), (10, " ".join(c[10][1].split()[100:113]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = plain.contaminated(c, items)
    for block in (2_000_000, 150):
        out = decontaminate.decontaminate(docs, bench, block_chars=block).select("doc_id", "verdict.*").collect()
        assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in out} == expected
    assert decontaminate.decontaminate(docs, bench.limit(0)).where("verdict.n_hit > 0").count() == 0
    assert decontaminate.decontaminate(docs.limit(0), bench).count() == 0


@pytest.mark.parametrize("block", [2_000_000, 30])
def test_decontaminate_null_item(spark, block):
    docs = spark.createDataFrame([(1, "x one two y"), (2, "three four"), (3, "five six"), (4, "clean")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "one two"), ("a", "one two"), (None, "three four"), ("b", "five six"), (None, "five six"),
        ("", "one two")], "item_id string, text string")
    out = decontaminate.decontaminate(docs, bench, block_chars=block).select("doc_id", "verdict.*").collect()
    digest = {i: hashlib.sha256(t.encode()).hexdigest() for i, t in ((1, ",a"), (2, ""), (3, "b"), (4, ""))}
    assert {r.doc_id: (r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in out} == {1: (2, 2, digest[1], True), 2: (2, 0, digest[2], True),
        3: (2, 1, digest[3], True), 4: (0, 0, digest[4], False)}


@pytest.mark.parametrize("cap", [2_000_000, 3000])
def test_simhash(spark, docs, cap):
    fps = {i: plain.fingerprint(t) for i, t in corpus()}
    expected = plain.components(fps)
    out = simhash.near_duplicates(docs, cap=cap).collect()
    assert {r.doc_id: r.fp % (1 << 64) for r in out} == fps
    assert {r.doc_id: r.component_id for r in out} == expected


def test_ball_links_dense(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = set(base.tolist())
    for b in base[:10].tolist():
        for _ in range(30):
            x = b
            for bit in rng.choice(64, rng.integers(1, 7), replace=False).tolist():
                x ^= 1 << bit
            fps.add(x)
    signed = {int(np.uint64(f).view(np.int64)): f for f in fps}
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.ball_links(df, cap=4000)).collect()}
    assert {s: roots.get(s, s) for s in signed} == plain.components({s: f for s, f in signed.items()})


def test_near_dedup_stage_keeps_one(spark, docs):
    out = [r.doc_id for r in simhash.stage_near_dedup(spark, docs.unionByName(docs), "").collect()]
    assert sorted(out) == sorted(set(plain.components({i: plain.fingerprint(t) for i, t in corpus()}).values()))


def test_near_dedup_stage_null_and_repeated_ids(spark):
    """One row stays for each group, whatever its ids: unrelated texts with null or equal ids do not compete."""
    x, y, z, u, v = (" ".join(f"{c}{i * 37 % 101}" for i in range(60)) for c in "xyzuv")
    rows = [(3, x, "p"), (7, x, "a"), (7, y, "z"), (None, z, "a"), (None, z, "b"), (None, u, "a"), (None, v, "a"), (9, v, "c"), (9, v, "b"),
        (None, None, "a"), (None, "", "a")]
    out = simhash.stage_near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), "").collect()
    assert sorted(map(tuple, out), key=str) == sorted([(3, x, "p"), (7, y, "z"), (None, z, "a"), (None, u, "a"), (9, v, "b"), (None, None, "a")], key=str)


@pytest.mark.parametrize("encoding", ["delta", "dictionary"])
def test_tokens_round_trip(spark, docs, encoding, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    odd = spark.createDataFrame([(100, "don't ''s <|endoftext|> ΣΑΣ ﬁ İ 12½ é\u0301 — x\x1cy \u00a0z"), (100, "again"), (None, "none")],
        "doc_id long, text string")
    all_docs = docs.select("doc_id", "text").unionByName(odd)
    tokens.write_tokens(all_docs, str(tmp_path / "t"), path, encoding=encoding)
    rows = sorted(tokens.read_tokens(spark, str(tmp_path / "t")).withColumn("crc", tokens.digest(F.col("tokens"))).collect(), key=lambda r: r.start)
    texts = sorted(((r.doc_id, r.text) for r in all_docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    tokenizer, start = Tokenizer.from_file(path), 0
    for r, (doc, text) in zip(rows, texts, strict=True):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        assert (r.doc_id, r.start, r.n_tokens, list(r.tokens)) == (doc, start, len(ids), ids)
        assert r.crc == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert tokens.read_tokens(spark, str(tmp_path / "t"), ("doc_id", "n_tokens"), ids=(3, 5)).count() == 3


def test_tokens_of_nothing(spark, docs):
    assert tokens.token_table(spark, docs.limit(0)).count() == 0


def tables(sf="/root/testdata/sf0.01"):
    con = duckdb.connect()
    return con.execute(f"SELECT doc_id, text, lang, quality FROM '{sf}/documents.parquet' LEFT JOIN '{sf}/labels.parquet' USING (doc_id)").fetchall()


def test_language_held_out(spark):
    rows = {r[0]: r[2] for r in tables()}
    out = language.op2_language(spark, "/root/testdata/sf0.01").collect()
    assert len(out) == len(rows) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out]
    assert sum(r.lang_pred == rows[r.doc_id] for r in held) > 0.97 * len(held)


def test_language_edges(spark):
    learn = spark.createDataFrame([("en", "the cat and the dog"), ("de", "der hund und die katze"), (None, "xx"), ("fr", None)], "lang string, text string")
    ask = spark.createDataFrame([("the dog",), (None,), ("",), ("123 !?",), ("der und die",)], "text string")
    out = [r.f.lang for r in ask.select(language.identify(language.profiles(learn), F.col("text")).alias("f")).collect()]
    assert out == ["en", "und", "und", "und", "de"]
    none = ask.select(language.identify(language.profiles(learn.limit(0)), F.col("text")).alias("f")).collect()
    assert all(r.f.lang == "und" and r.f.score == 0 for r in none)


def test_quality_held_out(spark):
    label = {r[0]: r[3] for r in tables() if r[3] is not None}
    out = quality.op6_quality(spark, "/root/testdata/sf0.01").collect()
    held = [r for r in out if r.held_out and r.doc_id in label]
    assert sum(r.predicted == label[r.doc_id] for r in held) > 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in out)


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, "fine words here"), (2, None), (3, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 1), (9, None)], "doc_id long, label int")
    one = quality.fit(docs, labels, F.lit(True))
    assert [r.s for r in docs.select(quality.score_column(spark, one, F.col("text")).alias("s")).collect()] == [1.0] * 3
    none = quality.fit(docs.limit(0), labels.limit(0), F.lit(True))
    assert [r.s for r in docs.select(quality.score_column(spark, none, F.col("text")).alias("s")).collect()] == [0.5] * 3
