"""Nulls, ties, repeated rows, very long texts, empty tables, and extra columns whose names an operator uses itself."""

import hashlib
import zlib

import numpy as np
import plain
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from colorjobs.llm import chat, common, decontaminate, language, mixing, neighbours, quality, simhash, substrings, tokens, urls

#: Names that operators give to columns of their own.
CLASH = "n copies key nth h _h _id score _score verdict _verdict _hit0 _n rest fp first root size host name part at doc high m a start sha".split()
CLASH += "lang_pred KEY_ Nth_ taken target".split()
LONG = " ".join(f"lang{i % 997}" for i in range(120_000))


def crowded(df):
    for c in CLASH:
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def odd(spark):
    """(doc_id, text, source, lang): null ids, null and empty texts, repeated rows, a very long text."""
    rows = [(1, "one two three four five", "a", "en"), (1, "one two three four five", "a", "en"), (2, None, None, None),
        (None, "six seven eight", "b", "en"), (None, "six seven eight", "b", "en"), (3, "", "a", "de"), (4, LONG, "c", "fr"),
            (5, " \t\n", None, "de"), (6, "eins zwei drei vier", "b", "de"), (None, None, None, None)]
    return crowded(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")).cache()


def rows_of(df):
    return sorted((tuple(str(x) for x in r) for r in df.collect()))


def test_numbered(spark):
    rows = [(k, i % 3 if i % 7 else None, i) for k in (1, 2, None) for i in range(50)]
    out = common.numbered(spark.createDataFrame(rows, "k long, o long, i long").repartition(5), "k", F.col("o").asc_nulls_first(), F.col("i")).collect()
    for k in (1, 2, None):
        mine = sorted((r for r in out if r.k == k), key=lambda r: r.nth)
        assert [r.nth for r in mine] == list(range(50))
        assert [(r.o, r.i) for r in mine] == sorted(((r.o, r.i) for r in mine), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    assert common.numbered(spark.createDataFrame([], "k long, i long"), "k", F.col("i")).count() == 0


def test_stages_keep_every_column(spark, odd, monkeypatch):
    labels = spark.createDataFrame([(1, 1), (6, 0), (3, None)], "doc_id long, quality int")
    bench = spark.createDataFrame([(1, "eins zwei drei vier"), (None, "nothing of that")], "item_id long, text string")
    for m in (quality, decontaminate):
        monkeypatch.setattr(m, "table", lambda s, d, name: {"labels": labels, "benchmark": bench}[name])
    for stage in (quality.stage_quality, simhash.stage_near_dedup, decontaminate.stage_decontaminate, mixing.stage_mix):
        out = stage(spark, odd, "")
        assert out.columns == odd.columns, stage
        assert set(rows_of(out)) <= set(rows_of(odd)) and out.count() > 0, stage
        assert stage(spark, odd.limit(0), "").count() == 0, stage
    assert tokens.stage_tokens(spark, odd, "").count() == odd.count()


def test_operators_take_odd_rows(spark, odd):
    n = odd.count()
    assert substrings.remove_repeats(odd).count() == n
    near = simhash.near_duplicates(odd).collect()
    assert len(near) == n and sorted((r.doc_id, r.component_id) for r in near if r.doc_id in (1, 2, 3, 5)) == [(1, 1), (1, 1), (2, 2), (3, 2), (5, 2)]
    assert all(r.component_id is None for r in near if r.doc_id is None and r.fp != 0)
    assert mixing.mix(odd).count() == n
    assert odd.select(language.identify(language.profiles(odd), F.col("text")).alias("f")).where("f.lang = 'und'").count() == 4
    items = spark.createDataFrame([(7, LONG), (None, None), (8, "eins zwei drei vier")], "item_id long, text string")
    found = {r.doc_id: r.verdict_ for r in decontaminate.decontaminate(odd, items, name="verdict_").collect() if r.doc_id}
    assert found[4].contaminated and found[4].n_hit == 120_000 and found[6].contaminated and not found[1].contaminated and not found[2].contaminated


# --- urls --------------------------------------------------------------------------------------------------------------


def test_url_levels(spark):
    rows = ["https://user:pw@www.shop.co.uk:8080/a", "http://10.0.0.1:80/x", "http://[::1]:8080/", "http://example.com./", "http://a.b.example.com",
        "http://localhost", None]
    host = urls.host_of(F.col("u"))
    name = urls.name_of(host)
    out = spark.createDataFrame([(u,) for u in rows], "u string").select(host.alias("h"), name.alias("n"), urls.domain_of(name).alias("d"),
        urls.suffix_of(name).alias("s")).collect()
    assert [(r.n, r.d, r.s) for r in out] == [("www.shop.co.uk", "shop.co.uk", "co.uk"), ("10.0.0.1", "10.0.0.1", "(address)"),
        ("[::1]", "[::1]", "(address)"), ("example.com", "example.com", "com"), ("a.b.example.com", "example.com", "com"),
            ("localhost", "localhost", "localhost"), ("", "", "")]
    assert out[0].h == "user:pw@www.shop.co.uk:8080"


def plain_bounds(pages, outcomes, z=1.645):
    """{host: bound} for hosts of three labels; each moment as a sum over single pairs of outcomes, not in closed form."""
    seen = {}
    for page, host in pages:
        seen.setdefault(host, []).extend(g for p, g in outcomes if p == page and g in (0, 1))
    good, n = sum(sum(v) for v in seen.values()), sum(len(v) for v in seen.values())
    prior, out = {None: (good + 1) / (n + 2)}, {}
    for depth in (1, 2, 3):
        groups = {}
        for h, v in seen.items():
            groups.setdefault(".".join(h.split(".")[-depth:]), []).extend(v)
        up = lambda k, d=depth: prior[None if d == 1 else ".".join(k.split(".")[-d + 1 :])]  # noqa: B023,E731
        pair = free = squares = 0.0
        for k, v in groups.items():
            p = up(k)
            if v:  # correlation: the mean product of deviations of two different outcomes of a group
                dev = [x - p for x in v]
                pair += (sum(dev) ** 2 - len(v) * p * (1 - p)) / len(v)
                free += p * (1 - p) * (len(v) - 1)
                squares += (p * (1 - p)) ** 2
        c = max(pair / free, (2 * squares) ** 0.5 / free) if free else 1.0
        strength = max(1.0, 1 / c - 1)
        now = {}
        for k, v in groups.items():
            a, b = sum(v) + strength * up(k), len(v) - sum(v) + strength * (1 - up(k))
            now[k] = a / (a + b)
            if depth == 3:
                out[k] = max(0.0, a / (a + b) - z * (a * b / (a + b) ** 2 / (a + b + 1)) ** 0.5)
        prior |= now
    return out


def test_url_reputation_against_plain(spark):
    rng = np.random.default_rng(5)
    pages, outcomes = [], []
    for h in range(60):
        host = f"h{h}.d{h % 12}.{'com' if h % 5 else 'info'}"
        bad = h % 12 == 3  # a planted domain
        for _ in range(int(rng.integers(1, 30))):
            pages.append((len(pages), host))
            if h % 3 != 2:
                outcomes.append((pages[-1][0], int(rng.random() < (0.1 if bad else 0.9))))
    want = plain_bounds(pages, outcomes)
    df = spark.createDataFrame([(i, f"x://{h}/p") for i, h in pages], "page_id long, url string")
    got = {r.host: r for r in urls.judge_urls(df, spark.createDataFrame(outcomes, "page_id long, good int"), rules=()).collect()}
    assert set(got) == set(want) and all(abs(got[h].reputation - b) < 1e-9 for h, b in want.items())
    bad = {h for h in got if h.split(".")[1] == "d3"}
    assert {h for h in got if got[h].verdict == "block"} >= bad and all(got[h].verdict == "allow" for h in got if h not in bad)
    plan = urls.judge_urls(df, spark.createDataFrame(outcomes, "page_id long, good int"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") <= 4


# --- languages, quality ------------------------------------------------------------------------------------------------


def plain_profile(texts, size):
    counts = {}
    for t in texts:
        words = " ".join("".join(c if c.isalpha() else " " for c in t.lower()).split(" "))
        words = " ".join(w for w in words.split(" ") if w)
        for n in (1, 2, 3):
            padded = f" {words} "
            for i in range(len(padded) - n + 1):
                g = padded[i : i + n]
                if g != " ":
                    counts[g] = counts.get(g, 0) + 1
    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))][:size]


def test_language_against_plain_distance(spark):
    learn = [("en", "the cat and the other dog"), ("en", "and then they went there"), ("de", "der hund und die katze"),
        ("de", "und dann gingen sie dahin"), ("fr", "le chat et le chien sont là"), ("en", "the cat and the other dog")]
    ask = ["the dog there", "die katze", "chat", "x", "et und and", "ohne zweifel the", "là là là"]
    size = 40
    profiles = {lang: plain_profile([t for x, t in learn if x == lang], size) for lang in ("de", "en", "fr")}
    df = spark.createDataFrame(learn, "lang string, text string").withColumn("rank", F.lit("clash")).withColumn("gram", F.lit(1))
    got = spark.createDataFrame([(t,) for t in ask], "text string").select("text",
        language.identify(language.profiles(df, size), F.col("text"), size).alias("f")).collect()
    for r in got:
        mine = plain_profile([r.text], size)
        distance = {lang: sum(abs(i - p.index(g)) if g in p else size for i, g in enumerate(mine)) for lang, p in profiles.items()}
        first, second = sorted(distance.items(), key=lambda x: (x[1], x[0]))[:2]
        assert r.f.lang == first[0] and abs(r.f.score - second[1] / (first[1] + second[1])) < 1e-12, r.text


def test_language_ties_and_slices(spark):
    df = spark.createDataFrame([("b", "same words"), ("a", "same words")], "lang string, text string")
    r = spark.createDataFrame([("same words",)], "text string").select(language.identify(language.profiles(df), F.col("text")).alias("f")).first()
    assert (r.f.lang, r.f.score) == ("a", 0.5)
    text = "Zwei Wörter, drei — und ein sehr langer Text mit vielen Wörtern " * 9
    whole = language.counted(language.grams(text))
    for step in (1, 2, 3, 7, 50):
        part = language.counted(language.grams(text, step))
        assert (part[0] == whole[0]).all() and (part[1] == whole[1]).all()


def test_quality_against_plain_votes(spark):
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["alpha", "beta", "Gamma", "DELTA!!", "x9", "zz"], int(rng.integers(3, 40)))) for _ in range(90)] + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)] + [(0, 1), (61, None)], "doc_id long, label int")
    model = quality.fit(docs, labels, F.lit(True), rank=8, k=7)
    got = [r.s for r in docs.orderBy("doc_id").select(quality.score_column(spark, model, F.col("text")).alias("s")).collect()]
    # the same terms, a dense matrix, numpy's own decomposition, one document after the other
    df_ = np.zeros(quality.DIMENSIONS)
    for t in texts:
        df_[quality.terms(t)[0]] += 1
    idf = np.log((1 + len(texts)) / (1 + df_)) + 1e-3

    def dense(text):
        x = np.zeros(quality.DIMENSIONS)
        at, w = quality.terms(text)
        x[at] = w * idf[at]
        for part in (slice(0, quality.WORDS), slice(quality.WORDS, quality.WORDS + quality.SHAPES), slice(quality.WORDS + quality.SHAPES, None)):
            x[part] /= max(1e-9, np.linalg.norm(x[part]))
        return x

    known = np.array([dense(texts[i]) for i in range(60)])
    basis = np.linalg.svd(known, full_matrices=False)[2][:8].T
    latent = known @ basis
    for i, t in enumerate(texts):
        v = dense(t) @ basis
        cosine = sorted(((float(v @ u / max(1e-9, np.linalg.norm(v) * np.linalg.norm(u))), k % 3 == 0) for k, u in enumerate(latent)), reverse=True)
        votes = [(max(c, 1e-6) ** 4, label) for c, label in cosine[:7]]
        if cosine[6][0] - cosine[7][0] > 1e-4:  # otherwise the last place is a tie
            assert abs(got[i] - sum(w for w, label in votes if label) / sum(w for w, _ in votes)) < 1e-3, i


# --- tokens ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("encoding", ["delta", "dictionary"])
def test_token_files(spark, odd, encoding, tmp_path):
    """Encodings, row groups and page indexes of the files themselves, and reads that leave columns out."""
    path, out = public_tokenizers.path("word_bpe_49k.json"), str(tmp_path / "t")
    many = spark.range(3000).select("id", F.col("id").alias("doc_id"),
        F.concat_ws(" ", *(F.concat(F.lit("word"), (F.col("id") * k % 83)) for k in (3, 5, 7, 11))).alias("text"))
    tokens.write_tokens(many.unionByName(odd.select("doc_id", "text").where("doc_id = 4"), allowMissingColumns=True).coalesce(1), out, path,
        encoding=encoding, row_group_bytes=(64 if encoding == "delta" else 4) << 10, page_rows=100)
    files = [f for f in (tmp_path / "t").glob("*.parquet")]
    groups = 0
    for f in files:
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            columns = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c) for c in range(meta.num_columns)}
            ids = next(v for k, v in columns.items() if k.startswith("tokens"))
            wanted = {"DELTA_BINARY_PACKED"} if encoding == "delta" else {"RLE_DICTIONARY", "PLAIN_DICTIONARY"}
            assert wanted & set(ids.encodings), ids.encodings
            assert encoding == "dictionary" or not {"RLE_DICTIONARY", "PLAIN_DICTIONARY"} & set(ids.encodings), ids.encodings
            assert all(c.has_offset_index and c.has_column_index for k, c in columns.items() if k == "doc_id") and ids.has_offset_index
            groups += 1
    assert groups > len(files)
    plan = tokens.read_tokens(spark, out, ("doc_id", "n_tokens"), ids=(10, 12))
    assert plan.count() == 3 and "ReadSchema: struct<doc_id:bigint,n_tokens:bigint>" in plan._jdf.queryExecution().executedPlan().toString()
    row = tokens.read_tokens(spark, out, ("doc_id", "tokens"), ids=(4, 4)).where("size(tokens) > 1000").first()
    assert list(row.tokens) == [*Tokenizer.from_file(path).encode(LONG, add_special_tokens=False).ids, 1]


def test_tokens_ties(spark, odd):
    rows = sorted(tokens.token_table(spark, odd).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, None, None, 1, 1, 2, 3, 4, 5, 6] and rows[0].n_tokens == 1
    assert rows[0].ids_crc32 == zlib.crc32(np.array([1],
        "<u4").tobytes()) and [r.start for r in rows][1:] == np.cumsum([r.n_tokens for r in rows])[:-1].tolist()


# --- repeats, mixing ---------------------------------------------------------------------------------------------------


def test_repeats_one_id_many_texts(spark):
    """Texts under one id are told apart by all bits of their hashes, and judged in the order of those."""
    rng = np.random.default_rng(8)
    texts = [" ".join(map(str, rng.integers(0, 4, 60))) for _ in range(40)]
    df = spark.createDataFrame([(9, t) for t in texts], "doc_id long, text string").withColumn("high", F.lit("clash"))
    order = [r.text for r in df.orderBy(F.xxhash64("text")).collect()]
    want = {t: w for t, w in zip(order, plain.removed(list(enumerate(order)), 8).values(), strict=True)}
    for r in substrings.remove_repeats(df, window=8, gram=3, shard_rows=50).collect():
        n, kept = substrings.kept_words(r.text, [(s["from"], s["to"]) for s in r.spans or ()])
        assert (n, n - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()) == want[r.text]


def test_mixing_duals_are_the_optimum(spark):
    """The tilted rates against a plain bisection of the dual, and against other rates that meet the same target."""
    rng = np.random.default_rng(4)
    sizes = {s: rng.integers(1, 400, 80) for s in ("a", "b", None)}
    df = spark.createDataFrame([(i, " ".join("w" * int(n)), s) for s, v in sizes.items() for i, n in enumerate(v)], "doc_id long, text string, source string")
    targets = plain.targets({s: int(v.sum()) for s, v in sizes.items()})
    groups = df.select("source", mixing.size_of(F.col("text")).alias("size")).groupBy("source", "size").agg(F.count("*").alias("n")).cache()
    rows = [(s, int(v.sum()), len(v), float(targets[s]), 0.0) for s, v in sizes.items()]
    duals = {r.source: r.l for r in mixing.tilts(groups,
        spark.createDataFrame(rows, "source string, source_size long, docs long, target double, start double")).collect()}
    for s, v in sizes.items():
        x, low, high = v / v.mean(), -50.0, 50.0
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if (v * np.minimum(3, np.exp(mid * x))).sum() < targets[s] else (low, mid)
        rate = np.minimum(3, np.exp(duals[s] * x))
        assert abs((v * rate).sum() - targets[s]) < 1e-5 * targets[s]
        if targets[s] < 3 * v.sum() - 1:
            assert abs(duals[s] - mid) < 1e-5
        entropy = lambda r: float((r * np.log(np.maximum(r, 1e-300)) - r).sum())
        for _ in range(50):  # moves along the constraint make it no smaller
            i, j = rng.choice(len(v), 2, replace=False)
            other = rate.copy()
            other[i] += 1e-3 / v[i]
            other[j] -= 1e-3 / v[j]
            if other.min() > 0 and other.max() <= 3:
                assert entropy(other) >= entropy(rate) - 1e-9


def test_mixing_needs_many_fixes(spark):
    """A gap that only hundreds of small documents can close."""
    groups = spark.createDataFrame([("s", 1, 500), ("s", 7, 40), ("s", 1000, 3)], "source string, size long, n long")
    duals = spark.createDataFrame([("s", 3780, 543, 640.0, -30.0)], "source string, source_size long, docs long, target double, l double")
    got = {r.size: r for r in mixing.rounded(groups, duals).collect()}
    taken = sum((r.base * r.n + r.extra) * r.size for r in got.values())
    assert taken == 640


# --- chat, neighbours --------------------------------------------------------------------------------------------------


def test_chat_one_number_and_long_pieces(spark):
    """Pieces that share a number, and one piece of very many lines, are cut into blocks; the result is one Viterbi run's."""
    model = chat.fit(chat.spoken_turns(spark, "/root/testdata/sf0.001"))
    said = [(1, 5, f"{'User' if i % 2 else 'AI'}: text {i}\nand more?") for i in range(90)] + [(2, None,
        "\n".join(f"{'User' if i % 2 else 'AI'}: line {i}" for i in range(500)))] + [(3, 1, "same")] * 5
    df = crowded(spark.createDataFrame(said, "conv_id long, piece long, text string"))
    out = chat.parse(df, model, block=16).collect()
    lines = chat.lines_of(df.withColumn("h2", F.xxhash64("text")), "conv_id", "piece", "h2").collect()
    assert sum(r.n_lines for r in out) == len(lines)
    for conv in (1, 2, 3):
        own = sorted((r for r in lines if r.conv_id == conv), key=lambda r: (r.h2, r.line))
        path = plain.viterbi(model.first, model.step, model.scores([r.symbol for r in own]))
        begun = sorted((model.states[s][0], r.line) for r, s in zip(own, path, strict=True) if model.states[s][1])
        assert sorted((r.role, r.line) for r in out if r.conv_id == conv and not r.continued) == begun


def test_chat_unmarked_turns(spark):
    """Held-out turns without a marker: a turn is right if its first line begins a turn of its role. The prose is invented,
    so lengths and the order of roles are all there is to tell; without a beginning found nothing is right."""
    turns = chat.spoken_turns(spark, "/root/testdata/sf0.1")
    held = F.pmod(F.xxhash64("conv_id"), F.lit(4)) == 0
    model = chat.fit(turns.where(~held))
    bare = turns.where(held & ~F.col("text").rlike(chat.ANY_MARKER) & (F.col("text") != "")).select("conv_id", "turn", "role").collect()
    out = {(r.conv_id, r.piece): r.role for r in chat.parse(turns.where(held).select("conv_id", F.col("turn").alias("piece"), "text"),
        model).where("line = 0").collect()}
    right = sum(out.get((r.conv_id, r.turn)) == r.role for r in bare)
    print("unmarked turns right:", right, "of", len(bare))
    assert len(bare) > 100 and right > 0.5 * len(bare)


def test_neighbours_extreme_values(spark):
    rng = np.random.default_rng(6)
    v = rng.standard_normal((120, 8))
    scale = np.array([1e200, 1e-200, 1.0, 1e-310, 1e307])[np.arange(120) % 5]
    rows = [(i, [float(c) for c in x * s]) for i, (x, s) in enumerate(zip(v, scale, strict=True))] + [(7, [float(c) for c in v[50]]),
        (None, [float(c) for c in v[50] * 2])]
    df = crowded(spark.createDataFrame(rows, "id long, v array<double>"))
    out = neighbours.search(df, F.expr("id % 50 = 0"), row_block=32, query_block=2).collect()
    unit = {i: np.array(x) / np.abs(x).max() for i, x in rows[:120]}
    for q in (0, 50, 100):
        best = sorted((-float(unit[q] @ u / np.sqrt((unit[q] @ unit[q]) * (u @ u))), i) for i, u in unit.items() if i != q)
        got = sorted((r.rank, r.vec_id, r.score) for r in out if r.query_id == q)
        assert len(got) == 5 and [g[0] for g in got] == [1, 2, 3, 4, 5]
        if q == 50:
            assert [g[1] for g in got[:2]] == [7, None] and abs(got[0][2] - 1) < 1e-12
        else:
            assert len({g[1] for g in got} & {i for _, i in best[:6]}) >= 4
