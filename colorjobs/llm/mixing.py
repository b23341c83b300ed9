"""Operator 10: mixing sources to target weights by entropy balancing. DataFrame functions only.

Targets: sources by code point, null last, weigh 5, 2, 1, 5, ... and share the total size; a source's target stops at
``most`` times its own size and the excess is shared again by weight among the others (water filling). Sources may be as
many as sites: no step has them all in one task.

Rates: among all document rates with sum(rate * size) = target in every source, take those nearest to one in relative
entropy. The convex dual has one unknown a source; its solution tilts exponentially, rate = exp(l * size / mean size),
held at ``most``. Newton steps, kept inside a bracket, solve it for all sources at once. All that a step needs is the
number of documents of each (source, size), so documents are aggregated once and the loop runs on that table.

Copies: within a source, documents of equal size are interchangeable. The fractional parts of the rates are rounded
systematically along falling sizes, which keeps the sum within one document of its target at every size; then documents of
one size are added or taken back, as many as fit best, the best size first, until nothing gets nearer. Which documents of a size get
the extra copy is settled by a hash of the id, so reruns agree.

Both loops run until they are done: Newton until every source is at its target or at its limit (an error if ``rounds`` do
not get there), documents of one size until no size gets nearer.

Defined cases: null or blank text has size 0 and takes 0 (it keeps one copy); null source is a source of its own, last;
no documents: no rows; all sizes zero: all targets zero. Rows that repeat are dealt with one by one; null ids are like
others. Other columns are not read by the mix; the stage keeps them, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .common import cut, drop, join_nulls, row_text, table, unused

WORDS = "[^\\x20\\x09-\\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
#: Rows of one source each that a task takes.
SOURCES = 100_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)).cast("long"), F.lit(0).cast("long"))


def tasks_for(sources: int) -> int:
    """In how many tasks that many rows of one source each are dealt with."""
    return max(1, sources // SOURCES)


def placed(totals: DataFrame, tasks: int) -> DataFrame:
    """totals (source, source_size), cut, with ``nth``: the place of the source, from 0, by code point, null last.

    Dealt by ranges; a place is the number of rows before it in its range and in the ranges before. One count a range is gathered."""
    by = F.col("source").asc_nulls_last()
    at = totals.repartitionByRange(tasks, by).sortWithinPartitions(by).withColumn("at", F.monotonically_increasing_id())
    at = cut(at.select("source", "source_size", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("at")), "sources")
    before, starts = 0, [F.lit(-1), F.lit(0)]
    for r in at.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():
        starts += [F.lit(r.part), F.lit(before)]
        before += r.n
    return at.select("source", "source_size", (F.col("at") + F.create_map(*starts)[F.col("part")]).alias("nth"))


def source_targets(totals: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0, tasks: int = 1) -> DataFrame:
    """totals: one row a source (source, source_size). Adds target.

    Sources are filled in rounds: those that their share would lift above the cap are held there, what is left is shared
    among the others, and shares only rise, so the held ones stay held. The rounds end when no other source joins them."""
    w = placed(totals, tasks).withColumn("w", F.element_at(F.array(*map(F.lit, weights)), F.pmod("nth", F.lit(len(weights))).cast("int") + 1))
    w = w.withColumn("cap", F.col("source_size") * most)
    whole = w.agg(F.sum("source_size").alias("size"), F.sum("w").alias("w")).first()
    fill, held = (whole.size / whole.w if whole.w else 0.0), 0
    while True:
        over = F.col("cap") < F.col("w") * F.lit(fill)
        now = w.agg(F.count_if(over).alias("held"), F.sum(F.when(over, F.col("cap")).otherwise(0.0)).alias("cap"),
            F.sum(F.when(over, 0.0).otherwise(F.col("w"))).alias("w")).first()
        if now.held == held or not now.w:
            return w.select("source", "source_size", F.least("cap", F.col("w") * F.lit(fill)).alias("target"))
        fill, held = max(fill, (whole.size - now.cap) / now.w), now.held


def tilts(groups: DataFrame, targets: DataFrame, most: float = 3.0, rounds: int = 200, near: float = 1e-9, tasks: int = 1) -> DataFrame:
    """groups: (source, size, n); targets: (source, source_size, docs, target, start). Adds column l, the dual of each
    source, found from its value at the start.

    rate(l, x) = min(most, exp(l * x)), x = size / mean size; sum(n * size * rate) rises with l from 0 to most * source_size.
    """
    null = F.lit(None).cast("double")
    duals = targets.select("source", "source_size", "docs", "target", F.col("start").alias("l"), null.alias("lo"), null.alias("hi"), F.lit(False).alias("done"))
    top = F.try_divide(F.log(F.lit(float(most))), F.col("least_x"))  # beyond it every document is at the limit
    for _ in range(rounds):
        x = F.col("size") * F.col("docs") / F.col("source_size")
        free = F.exp(F.least(F.col("l") * x, F.lit(700.0)))
        rate = F.least(F.lit(most), free)
        g = join_nulls(groups.where("size > 0"), duals.select("source", "source_size", "docs", "l"), "source").groupBy("source").agg(
            F.sum(F.col("n") * F.col("size") * rate).alias("got"),
                F.sum(F.when(free < most, F.col("n") * F.col("size") * x * free).otherwise(0.0)).alias("slope"), F.min(x).alias("least_x"),
        )
        gap = F.col("target") - F.col("got")
        met = F.col("got").isNull() | (F.abs(gap) <= near * F.greatest(F.col("target"), F.lit(1.0)))
        done = met | ((gap > 0) & (F.col("l") >= top))
        lo, hi = F.when(gap > 0, F.col("l")).otherwise(F.col("lo")), F.when(gap < 0, F.col("l")).otherwise(F.col("hi"))
        # a bracket that has come down to neighbouring doubles cannot be halved
        d = join_nulls(duals, g, "source", how="left").select("source", "source_size", "docs", "target", "l", lo.alias("lo"), hi.alias("hi"),
            "slope", "least_x", gap.alias("gap"), done.alias("done"))
        done = F.col("done") | F.coalesce(F.col("hi") - F.col("lo") <= 1e-15 * F.abs("hi"), F.lit(False))
        step = F.col("l") + F.try_divide(F.col("gap"), F.col("slope"))
        # without a bracket the step is kept short, with one it stays inside
        inside = F.when((F.col("slope") > 0) & (step >= F.coalesce("lo", step)) & (step <= F.coalesce("hi", step)), step)
        far = F.abs("l") * 2 + 1
        half = F.when(F.col("lo").isNotNull() & F.col("hi").isNotNull(), (F.col("lo") + F.col("hi")) / 2).when(F.col("gap") > 0,
            F.least(top, far)).otherwise(-far)
        now = d.select("source", "source_size", "docs", "target",
            F.when(done, F.col("l")).otherwise(F.least(top, F.coalesce(inside, half))).alias("l"), "lo", "hi", done.alias("done"))
        now = cut(now.coalesce(tasks), "duals")
        drop(duals)
        duals = now
        if not duals.where("not done").take(1):
            return duals.select("source", "source_size", "docs", "target", "l")
    raise RuntimeError(f"no convergence in {rounds} Newton steps")


def rounded(groups: DataFrame, duals: DataFrame, most: float = 3.0) -> DataFrame:
    """(source, size, n, base, extra): each document of the group gets base copies and ``extra`` of them one more."""
    g = join_nulls(groups, duals, "source")
    x = F.try_divide(F.col("size") * F.col("docs"), F.col("source_size"))
    rate = F.when(F.col("size") == 0, F.lit(1.0)).otherwise(F.least(F.lit(most), F.exp(F.least(F.col("l") * x, F.lit(700.0)))))
    g = g.withColumn("rate", rate).withColumn("base", F.floor(F.col("rate") + 1e-9).cast("long")).withColumn("part",
        F.greatest(F.lit(0.0), F.col("rate") - F.col("base")))
    falling = W.partitionBy("source").orderBy(F.desc("size")).rowsBetween(W.unboundedPreceding, W.currentRow)
    g = g.withColumn("sum", F.sum(F.col("part") * F.col("n")).over(falling))
    g = g.withColumn("extra",
        F.greatest(F.lit(0), F.least(F.col("n"), F.floor(F.col("sum") + 0.5) - F.floor(F.col("sum") - F.col("part") * F.col("n") + 0.5))).cast("long"))
    g = cut(g.select("source", "size", "n", "target", "base", "extra"), "copies")
    while True:  # every round brings the gap of some source nearer to zero, and sizes are whole numbers
        gap = g.groupBy("source").agg((F.max("target") - F.sum((F.col("base") * F.col("n") + F.col("extra")) * F.col("size"))).alias("gap"))
        h = join_nulls(g, gap, "source")
        free = F.when(F.col("gap") > 0, F.when(F.col("base") < most, F.col("n") - F.col("extra"))).otherwise(F.col("extra"))
        # of each size as many as fit best; the size that leaves the smallest gap
        many = F.least(free, F.greatest(F.lit(1), F.rint(F.try_divide(F.abs("gap"), F.col("size"))))).cast("long")
        rest = F.abs(F.abs("gap") - many * F.col("size"))
        nearer = h.where((F.col("size") > 0) & (free > 0)).withColumn("many", many).withColumn("rest", rest).where(F.col("rest") < F.abs("gap"))
        pick = F.min_by(F.struct("size", (F.col("many") * F.signum("gap")).cast("long").alias("more")), F.struct("rest", "size"))
        best = nearer.groupBy("source").agg(pick.alias("p")).select("source", "p.size", "p.more")
        best = cut(best, "fix")
        if not best.take(1):
            drop(best)
            return g
        fixed = join_nulls(g, best, "source", "size", how="left")
        fixed = cut(fixed.select("source", "size", "n", "target", "base",
            (F.col("extra") + F.coalesce("more", F.lit(0).cast("long"))).alias("extra")), "copies")
        drop(g, best)
        g = fixed


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0, key: Column | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken, key: one row for each row of docs. ``key`` (a long, by
    default a hash of id and text) settles which of equally long documents get a copy more."""
    key = F.xxhash64(F.col("doc_id").cast("string"), "text") if key is None else key
    sized = cut(docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), key.alias("h")), "sizes")
    groups = cut(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "groups")
    docs_ = F.sum(F.when(F.col("size") > 0, F.col("n")).otherwise(0))
    squares = F.sum(F.col("n") * F.col("size").cast("double") * F.col("size"))
    totals = groups.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), docs_.alias("docs"), squares.alias("squares"))
    totals = cut(totals, "totals")
    tasks = tasks_for(totals.count())
    named = source_targets(totals.select("source", "source_size"), weights, most, tasks)
    # the dual if all documents had the mean x of a word
    ratio = F.least(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.99 * most))
    start = F.coalesce(F.when(ratio > 0,
        F.try_divide(F.log(F.nullif(ratio, F.lit(0.0))), F.col("squares") * F.col("docs") / F.pow(F.nullif("source_size", F.lit(0)), F.lit(2)))), F.lit(0.0))
    targets = join_nulls(totals.select("source", "docs", "squares"), named, "source").select("source", "source_size", "docs", "target", start.alias("start"))
    targets = cut(targets.coalesce(tasks), "targets")
    plan = rounded(groups, tilts(groups, targets, most, tasks=tasks), most)
    # the extra-th smallest hash of a group: found by counts of 1/256th parts first, so only one part of a group is ranked
    part = F.shiftrightunsigned("h", 56)
    parts = sized.withColumn("part", part).groupBy("source", "size", "part").agg(F.count("*").alias("m"))
    before = F.coalesce(F.sum("m").over(W.partitionBy("source", "size").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = join_nulls(parts.withColumn("before", before), plan.select("source", "size", "base", "extra"), "source", "size")
    parts = parts.withColumn("more", F.greatest(F.lit(0), F.least(F.col("m"), F.col("extra") - F.col("before"))))
    whole = join_nulls(sized.withColumn("part", part), parts.select("source", "size", "part", "m", "base", "more"), "source", "size", "part")
    open_ = (F.col("more") > 0) & (F.col("more") < F.col("m"))
    nth = F.row_number().over(W.partitionBy("source", "size", "part").orderBy("h", "doc_id"))
    ranked = whole.where(open_).withColumn("nth", nth)
    dealt = whole.where(~open_).withColumn("nth", F.lit(1)).unionByName(ranked)
    copies = F.col("base") + F.when(F.col("nth") <= F.col("more"), 1).otherwise(0)
    dealt = dealt.select("doc_id", "source", "size", F.col("h").alias("key"), copies.cast("long").alias("copies"))
    named = targets.select("source", "source_size", "target")
    return join_nulls(dealt, named, "source").select("doc_id", "source", "size", "source_size", "target", "copies",
        (F.col("copies") * F.col("size")).alias("taken"), "key")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes of it."""
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix takes it (none, once, or more).

    Rows are known by a hash of all their columns. Rows that are equal in every column become one (before they move, where
    they lie together) with the copies of them all; documents move once, to their copies."""
    key, copies, nth = (unused(docs.columns, c) for c in ("key", "copies", "nth"))
    own, names = F.xxhash64(row_text(docs)), [f"`{c}`" for c in docs.columns]
    plan = mix(docs, key=own).groupBy(F.col("key").alias(key)).agg(F.sum("copies").alias(copies)).where(F.col(copies) > 0)
    joined = docs.withColumn(key, own).dropDuplicates([key]).join(plan, key)
    return joined.select(*names, F.explode(F.array_repeat(F.lit(0), F.col(copies).cast("int"))).alias(nth)).select(*names)
