"""Operators 11 to 13 against plain versions, and cases that once went wrong in others."""

import hashlib
import random
import re
import sys
import unicodedata

import numpy as np
import pytest
import public_tokenizers
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from colorjobs.llm import bpe, language, middle, negatives, neighbours, quality, tokens

CLASH = ["form", "n", "ids", "key", "row", "one", "other", "output", "anchor", "score"]
TEXTS = [None, "", "\n", "a", "a\n", "\n\n\n", "a\nb", "äß\n漢字\n😀x\n\nend", "has <P> inside\nx", "<S>", "x<M", "<P" + "\n" + ">", "é" * 7 + "\n" + "é" * 9,
    "line\n" * 2000 + "last", "x" * 100_000, "12345678\n1234567\n123456\n\n\n\n\n\n\n\nx\n"]


def crowded(df):
    for c in CLASH:
        df = df.withColumn(c, F.lit("clash")) if c not in df.columns else df
    return df


# --- 11 ----------------------------------------------------------------------------------------------------------------


def plain_middle(doc, text, unit, percent, spm):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)
    told = hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(told[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("unit,percent,spm", [("line", 100, 50), ("char", 100, 50), ("line", 40, 0), ("line", 0, 50)])
def test_middle_against_plain(spark, unit, percent, spm):
    rows = [(100 * k + i, t) for k in range(4) for i, t in enumerate(TEXTS)] + [(None, "a\nb\nc"), (7, "twice\nx"), (7, "twice\nx")]
    df = crowded(spark.createDataFrame(rows, "doc_id long, text string")).repartition(3)
    made = middle.fill_in_middle(df, unit=unit, percent=percent, spm_percent=spm)
    got = made.withColumn("back", middle.restored(F.col("output"), F.col("form"))).collect()
    want = sorted((str((d, *plain_middle(d, t, unit, percent, spm), t or "")) for d, t in rows))
    assert sorted(str(tuple(r)) for r in got) == want


def test_middle_sentinels_and_empty(spark):
    df = spark.createDataFrame([(i, f"{i}|a\nb+c\n(d)\n") for i in range(30)], "doc_id long, text string")
    marks = ("|", "+", "(d")
    assert {r.form for r in middle.fill_in_middle(df, sentinels=marks).collect()} == {"plain"}
    marks = ("[p.]", "[s*]", "[m|]")
    made = middle.fill_in_middle(df, sentinels=marks)
    assert {r.form for r in made.collect()} == {"psm", "spm"}
    back = made.select("doc_id", middle.restored(F.col("output"), F.col("form"), marks).alias("text")).join(df, ["doc_id", "text"])
    assert back.count() == 30
    assert middle.fill_in_middle(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        middle.fill_in_middle(df, unit="word")


def test_marks():
    """Rank and select over words, with neighbours of the marked byte that arithmetic with carries would take for it."""
    rng = np.random.default_rng(3)
    for size in (0, 1, 7, 8, 9, 64, 1000):
        data = rng.choice(np.array([9, 10, 11, 10 + 128, 0, 255, 128], np.uint8), size)
        words = np.zeros(size + 7 >> 3 or 1, np.uint64)
        words.view(np.uint8)[:size] = data
        marks, at = middle.Marks(middle.line_ends(words)), np.flatnonzero(data == 10)
        assert (marks.select(np.arange(len(at))) == at).all()
        assert (marks.rank(np.arange(size + 1)) == np.searchsorted(at, np.arange(size + 1))).all()


# --- 12 ----------------------------------------------------------------------------------------------------------------


def odd_texts():
    """Texts, and code points: all that Python's Unicode has assigned (but only some for private use), all that a newer one
    has, and some of the rest."""
    r = random.Random(5)
    rest = regex.compile(r"[\p{Cn}\p{Co}]")
    points = [chr(i) for i in range(sys.maxunicode + 1) if not 0xD800 <= i < 0xE000 and (i % 997 == 0 or not rest.match(chr(i)) or
        unicodedata.category(chr(i)) not in ("Cn", "Co"))]
    letters = ["".join(r.choice("aeinrst") for _ in range(r.randint(1, 40))) for _ in range(4000)]
    repeats = [c * n for c in "ae!-_.='" for n in (*range(1, 40), 130, 1000)]
    special = ["<|endoftext|>", "a<|endoftext|>b <|startoftext|> ", " <|endoftext|", "x\x1cy", "İΣ Σa", "é", "½ ² Ⅷ", "", " ", "\n\n",
        "don't we'll I'VE", "a_b__c", "Ᲊ!", "!𓪈", "a" * 3000 + "漢字" * 200]
    return [*letters, *repeats, *special], [f"{c} a{c}b !{c} {c}1" for c in points]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_bpe_against_tokenizers(name):
    path = public_tokenizers.path(name)
    own, theirs = bpe.Codec(path), Tokenizer.from_file(path)
    texts, points = odd_texts()
    got = [np.frombuffer(x, "<i4").tolist() for x in own.encode(texts)]
    want = [e.ids for e in theirs.encode_batch(texts, add_special_tokens=False)]
    assert [(t, a, b) for t, a, b in zip(texts, got, want, strict=True) if a != b] == []
    assert [own.decode(w) for w in want] == [theirs.decode(w, skip_special_tokens=False) for w in want]
    some = points[:: 1 if name.startswith("word") else 17]  # alone, between letters, beside a symbol, before a digit
    want = [e.ids for e in theirs.encode_batch_fast(some, add_special_tokens=False)]
    got = [np.frombuffer(x, "<i4").tolist() for x in own.encode(some)]
    assert [(t, a, b) for t, a, b in zip(some, got, want, strict=True) if a != b] == []


def test_bpe_steps_agree():
    """The tables of single pieces and those of many pieces are the same."""
    own = bpe.codec(public_tokenizers.path("word_bpe_49k.json"))
    r = random.Random(8)
    pieces = [bytes(r.choice(b"aeionrstlh!.\xc3\xa4") for _ in range(r.randint(1, 60))) for _ in range(3000)]
    assert [np.frombuffer(x, "<i4").tolist() for x in own.pieces(pieces)] == [own.piece(p) for p in pieces]


def test_bpe_refuses_other_vocabularies():
    with pytest.raises(ValueError):
        bpe.Merges({"a": 0, "b": 1, "c": 2, "ab": 3, "bc": 4, "abc": 5}, ["a b", "b c", "a bc", "ab c"])
    with pytest.raises(ValueError):
        bpe.Merges({"a": 0, "b": 1, "ab": 2, "aab": 3}, ["a ab", "a b"])
    # a token that another merge always forestalls is never met
    m = bpe.Merges({"a": 0, "b": 1, "c": 2, "bc": 3, "ab": 4, "abc": 5}, ["b c", "a b", "ab c"])
    assert m.reachable() == {0, 1, 2, 3, 4}


def test_bpe_frames(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    theirs = Tokenizer.from_file(path)
    rows = [(1, None), (2, ""), (3, "Same words"), (3, "Same words"), (None, "null id ²"), (4, "long " * 50_000 + "x" * 5000)]
    df = crowded(spark.createDataFrame(rows, "doc_id long, text string"))
    made = bpe.encode(df, path)
    got = sorted((str((r.doc_id, list(r.ids), r.back)) for r in made.withColumn("back", bpe.decoded(F.col("ids"), path)).collect()))
    want = [theirs.encode(t or "", add_special_tokens=False).ids for _, t in rows]
    assert got == sorted(str((d, w, theirs.decode(w, skip_special_tokens=False))) for (d, _), w in zip(rows, want, strict=True))
    assert bpe.encode(df.limit(0), path).count() == 0
    ids = spark.createDataFrame([([320, 999_999, -1, 321],), (None,), ([],)], "ids array<int>")
    assert [r[0] for r in ids.select(bpe.decoded(F.col("ids"), path)).collect()] == [theirs.decode([320, 321], skip_special_tokens=False), None, ""]


def test_bpe_query(spark):
    sf = "/root/testdata/sf0.001"
    theirs = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    out = bpe.op12_bpe(spark, sf).collect()
    assert len(out) == len(docs)
    for r in out:
        ids = theirs.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(" ".join(map(str, ids))))
        assert r.decoded_sha256 == sha(theirs.decode(ids, skip_special_tokens=False))


def test_token_files_hold_any_letter(spark):
    """Operator 4 on every code point: letters that Python does not know, and symbols beside them."""
    path = public_tokenizers.path("word_bpe_49k.json")
    own, theirs = tokens.Encoder(path), Tokenizer.from_file(path)
    texts, points = odd_texts()
    some = points + texts
    want = [np.array(e.ids, "<u4").tobytes() for e in theirs.encode_batch_fast(some, add_special_tokens=False)]
    assert own.ids(some) == want


# --- 13 ----------------------------------------------------------------------------------------------------------------


def plain_negatives(rows, positives=5, negatives_=3, least=50, most=95):
    """rows: [(id, label, vector of whole numbers)] in any order, none of them unfit."""
    out = []
    key = lambda s, i: (-s, i is None, i or 0)
    for n, (a, label, v) in enumerate(rows):
        if a is None or a % 50:
            continue
        scored = [(sum(x * y for x, y in zip(v, w, strict=True)), i, lab) for k, (i, lab, w) in enumerate(rows) if k != n]
        same = sorted(((s, i) for s, i, lab in scored if lab == label), key=lambda x: key(*x))[:positives]
        others = sorted(((s, i) for s, i, lab in scored if lab != label), key=lambda x: key(*x))
        for s, i in same:
            for rank, (t, j) in enumerate([x for x in others if least * s <= 100 * x[0] <= most * s][:negatives_]):
                out.append((a, i, rank + 1, j, s, t))
    return sorted(map(str, out))


def test_negatives_against_plain(spark):
    rng = np.random.default_rng(9)
    v = np.floor(rng.standard_normal((500, 8)) * 4) / 16
    v[40:160] = v[0]  # many copies, also of anchors, over all labels
    v[160:200] = 0.0
    rows = [(int(i % 480), int(i * 7 % 4), v[i].tolist()) for i in range(500)] + [(None, 1, v[3].tolist()), (2**63 - 1, 1, v[3].tolist())]
    unfit = [(600, None, v[1].tolist()), (650, 1, None), (700, 1, [float("nan")] * 8), (750, 2, [None] * 8), (800, 2, [1.0]), (850, 1, [float("inf")] * 8)]
    df = crowded(spark.createDataFrame(rows + unfit, "id long, label int, v array<double>")).repartition(5)
    want = plain_negatives([(i, lab, [int(np.floor(256 * x)) for x in w]) for i, lab, w in rows])
    assert len(want) > 100
    for options in ({}, {"row_block": 32, "anchor_block": 3, "parts": 3}):
        got = negatives.mine(df, F.col("id") % 50 == 0, **options).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
        assert sorted(str(tuple(r)) for r in got.collect()) == want
    assert negatives.mine(df.limit(0), F.col("id") % 50 == 0).count() == 0
    assert negatives.mine(df, F.lit(False)).columns[0] == "anchor_id"


def test_negatives_large_numbers(spark):
    """Products that pass 53, and 64, bits."""
    for scale in (2.0**18, 2.0**20, 2.0**40):
        rng = np.random.default_rng(4)
        w = rng.integers(1, 1000, (60, 3))
        rows = [(i, i % 2, (w[i] * scale / 256).tolist()) for i in range(60)]
        whole = [(i, lab, [int(np.floor(256 * x)) for x in x_]) for i, lab, x_ in rows]
        got = negatives.mine(spark.createDataFrame(rows, "id long, label int, v array<double>"), F.col("id") % 50 == 0).collect()
        if scale < 2.0**30:
            order = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
            assert sorted(str(tuple(r[c] for c in order)) for r in got) == plain_negatives(whole)
        else:  # beyond 64 bits every score is the same
            assert all(r.positive_score <= 2**63 - 1 for r in got)


def test_negatives_ties_at_zero(spark):
    """A positive of score zero has negatives of score zero, also those with smaller ids."""
    rows = [(50, 1, [1.0, 0.0]), (9, 1, [0.0, 1.0]), (3, 2, [0.0, 2.0]), (12, 2, [0.0, 3.0]), (4, 2, [-1.0, 0.0])]
    got = negatives.mine(spark.createDataFrame(rows, "id long, label int, v array<double>"), F.col("id") % 50 == 0).collect()
    assert sorted((r.positive_id, r["rank"], r.negative_id, r.negative_score) for r in got) == [(9, 1, 3, 0), (9, 2, 12, 0)]


# --- cases that once went wrong ----------------------------------------------------------------------------------------


def test_quality_sample_keeps_both_labels(spark):
    """One labelled document that repeats often takes one place of the sample."""
    rows = [(1, "same text again")] * 60 + [(i, f"good words {i} of many") for i in range(2, 30)] + [(i, f"bad {i}!!") for i in range(30, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 30)) for i in range(1, 60)], "doc_id long, label int")
    model = quality.fit(docs, labels, F.lit(True), sample=10, rank=4, k=3)
    assert sorted(model.labels.tolist()) == [0.0] * 10 + [1.0] * 10


def test_neighbours_largest_and_repeated_ids(spark):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((8, 6)).tolist()
    rows = [(50, v[0]), (50, v[0]), (2**63 - 1, v[0]), (None, v[0]), *((i, v[i]) for i in range(1, 8))]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = sorted((r["rank"], r.vec_id) for r in neighbours.search(df, F.col("id") % 50 == 0, k=3).collect())
    assert got == [(1, 50), (1, 50), (2, 2**63 - 1), (2, 2**63 - 1), (3, None), (3, None)]


def test_language_group_limit(spark):
    docs = spark.createDataFrame([("a", "some words"), ("b", "more words")], "lang string, text string")
    assert "WindowGroupLimit" in language.profiles(docs, 5)._jdf.queryExecution().optimizedPlan().toString()
