"""Operator 3: transcript parsing with a hidden Markov model, then canonical turn rendering.

States: each role, beginning a turn or going on with it. A line shows several features: its speaker marker, its length
class, how it ends, how it opens, and the class of its words. Emissions are the product of one table for each feature, and
they and the transitions are counts over all labelled turns, smoothed. Viterbi recovers the roles of the lines of a
transcript, and each recovered turn is rendered as ``<|role|>``, its text without the marker, ``<|end|>``.

A conversation may be longer than any task: its lines are numbered (by ranges, no task sees them all) and cut into blocks
of ``block`` lines. Each block is summed up as the matrix of its best path scores between states (max-plus), blocks are
combined ``block`` at a time until one is left, and the best states at the block borders are handed down again, so the
result is that of one Viterbi run over the whole, and no task holds more than ``block`` lines or matrices of one group,
whether a conversation has very many pieces, one very long piece, or pieces that all share a number.

Defined cases: null or empty pieces have no lines and no turns; pieces with equal numbers are ordered by a hash of the
text; a null piece number sorts first; a null conversation is one like any other; rows that repeat are said twice; unknown
or null roles teach nothing; without any labelled turn all states are equally likely and the first role by name, or
``user``, wins; other columns are not read; an empty table gives no rows. A turn that goes on over a block border comes as
a second row with ``continued`` true. Transitions are counted inside blocks of ``block`` turns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .common import cut, join_nulls, numbered, small_batches, table

#: Speaker markers at the start of a line (fixed values, ours).
MARKERS = {"user": ("user", "human", "customer", "q"), "assistant": ("assistant", "ai", "bot", "a"), "system": ("system", "sys")}
LENGTHS = (1, 20, 50, 90, 150, 250, 400, 700)
#: Words by which people ask and answer (fixed values, ours); other words say nothing.
ASKING = ("what", "why", "how", "who", "when", "where", "which", "can", "could", "please", "i", "my", "me", "help")
ANSWERING = ("sure", "here", "yes", "no", "you", "your", "first", "then", "because", "therefore", "sorry", "certainly", "of course")


def marker_pattern(names) -> str:
    return rf"(?i)^\s*(?:#+\s*|\*+\s*|<\|?|\[)?(?:{'|'.join(names)})(?:\*+)?\s*(?:\|?>|\]|:)[ \t]*"


ANY_MARKER = marker_pattern([n for names in MARKERS.values() for n in names])


def symbol(line: Column) -> Column:
    """Features of a line, joined by slashes: marker's role, or none; length class; end; opening; kind of words. All but
    the first are those of the line without its marker."""
    mark = F.lit("none")
    for role, names in MARKERS.items():
        mark = F.when(line.rlike(marker_pattern(names)), F.lit(role)).otherwise(mark)
    said = F.trim(F.regexp_replace(line, ANY_MARKER, ""))
    size = F.lit(len(LENGTHS))
    for k, limit in reversed(list(enumerate(LENGTHS))):
        size = F.when(F.length(said) < limit, F.lit(k)).otherwise(size)
    last = F.right(said, F.lit(1))
    end = F.when(last == "?", "ask").when(last.isin(".", "!"), "stop").when(last.isin(":", ";", ",", "{"), "open").otherwise("other")
    begin = F.when(said.rlike(r"^(?:[-*+•]|\d+[.)])\s"), "list").when(said.rlike(r"^(?:```|    |[{}<$#/])|[;{}]$"),
        "code").when(said.rlike(r"^\p{Lu}"), "upper").otherwise("other")
    words = F.when(said.rlike(rf"(?i)\b(?:{'|'.join(ASKING)})\b"), "asking").when(said.rlike(rf"(?i)\b(?:{'|'.join(ANSWERING)})\b"),
        "answering").otherwise("other")
    return F.concat_ws("/", mark, size.cast("string"), end, begin, words)


def lines_of(pieces: DataFrame, *keep: str) -> DataFrame:
    """One row a line: line (from 0), text, symbol."""
    out = pieces.where("text != ''").select(*keep, F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return out.withColumn("symbol", symbol(F.col("text")))


class Model:
    def __init__(self, roles, emissions, starts, transitions, smooth: float = 0.5):
        self.roles = sorted(roles) or ["user"]
        self.states = [(r, begin) for r in self.roles for begin in (True, False)]
        at = {s: k for k, s in enumerate(self.states)}
        # one table a feature: its values are columns, one more stands for values not seen
        counts: list[dict] = []
        for role, begin, sym, n in emissions:
            for f, value in enumerate(sym.split("/")):
                if f == len(counts):
                    counts.append({})
                counts[f].setdefault(value, np.zeros(len(self.states)))[at[role, begin]] += n
        self.emit = []
        for values in counts:
            table = np.array([*values.values(), np.zeros(len(self.states))]) + smooth
            self.emit.append(({v: k for k, v in enumerate(values)}, np.log(table / table.sum(axis=0))))
        first = np.array([smooth if begin else 1e-9 for _, begin in self.states])
        for role, n in starts:
            first[at[role, True]] += n
        self.first = np.log(first / first.sum())
        step = np.full((len(self.states),) * 2, smooth)
        for i, (role, _) in enumerate(self.states):
            for j, (other, begin) in enumerate(self.states):
                if not begin and other != role:
                    step[i, j] = 1e-9  # only its own turn goes on
        for (r, rb), (s, sb), n in transitions:
            step[at[r, rb], at[s, sb]] += n
        self.step = np.log(step / step.sum(axis=1, keepdims=True))

    def scores(self, symbols) -> np.ndarray:
        """Log-likelihood of each line in each state."""
        out = np.zeros((len(symbols), len(self.states)))
        for f, (column, table) in enumerate(self.emit):
            out += table[[column.get(s.split("/")[f], len(column)) for s in symbols]]
        return out


def fit(turns: DataFrame, block: int = 64) -> Model:
    """turns (conv_id, turn, role, text): labelled turns as they look in transcripts."""
    known = turns.where(F.col("role").isin(*MARKERS)).select("conv_id", "turn", "role", "text")
    found = cut(lines_of(known, "role").groupBy("role", (F.col("line") == 0).alias("begin"), "symbol").agg(F.count("*").alias("n")), "emissions")
    emissions = [tuple(r) for r in found.select("role", "begin", "symbol", "n").orderBy("role", "begin", "symbol").collect()]  # states times symbols rows
    placed = numbered(known.where("text != ''"), "conv_id", F.col("turn").asc_nulls_first(), F.xxhash64("text"))
    order = W.partitionBy("conv_id", F.floor(F.col("nth") / block)).orderBy("nth")
    n = F.size(F.split("text", "\n"))
    steps = placed.select("conv_id", "role", n.alias("n"), F.lag("role").over(order).alias("before"), F.lag(n).over(order).alias("n_before"))
    sums = F.count("*").alias("turns"), F.sum((F.col("n") > 1).cast("long")).alias("begun"), F.sum(F.greatest(F.col("n") - 2, F.lit(0))).alias("on")
    rows = steps.groupBy("role", "before", (F.col("n_before") > 1).alias("long_before")).agg(*sums).collect()  # pairs of roles
    starts, transitions = [], []
    for r in rows:
        transitions += [((r.role, True), (r.role, False), r.begun), ((r.role, False), (r.role, False), r.on)]
        if r.before is None:
            starts.append((r.role, r.turns))
        else:
            transitions.append(((r.before, not r.long_before), (r.role, True), r.turns))
    return Model({r.role for r in rows}, emissions, starts, transitions)


def _product(mats: list[np.ndarray]) -> np.ndarray:
    out = mats[0]
    for m in mats[1:]:
        out = (out[:, :, None] + m[None, :, :]).max(axis=1)
    return out


def _through(mats: list[np.ndarray], entry: int, leave: int) -> list[int]:
    """States after each matrix on the best path from ``entry`` that ends in ``leave``."""
    score, back = mats[0][entry], []
    for m in mats[1:]:
        paths = score[:, None] + m
        back.append(paths.argmax(axis=0))
        score = paths.max(axis=0)
    path = [leave]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def _line_matrices(model: Model, symbols, first: bool) -> list[np.ndarray]:
    emit = model.scores(symbols)
    out = [model.step + e[None, :] for e in emit]
    if first:
        out[0] = np.broadcast_to(model.first[None, :] + emit[0][None, :], model.step.shape)
    return out


def _in_order(table: pa.Table) -> list[dict]:
    return sorted(table.to_pylist(), key=lambda r: r["nth"])


def _sums(model: Model):
    def of(group: pa.Table) -> pa.Table:
        rows = _in_order(group)
        total = _product(_line_matrices(model, [r["symbol"] for r in rows], rows[0]["opens"]))
        return pa.table({"conv": pa.array([rows[0]["conv"]], pa.int64()), "part": pa.array([rows[0]["part"]], pa.int64()),
            "m": pa.array([total.ravel().tolist()], pa.list_(pa.float64()))})

    return of


def _combined(size: int):
    def of(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["part"])
        total = _product([np.array(r["m"]).reshape(size, size) for r in rows])
        return pa.table({"conv": pa.array([rows[0]["conv"]], pa.int64()), "part": pa.array([rows[0]["up"]], pa.int64()),
            "m": pa.array([total.ravel().tolist()], pa.list_(pa.float64()))})

    return of


def _handed_down(size: int):
    def of(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["part"])
        ends = _through([np.array(r["m"]).reshape(size, size) for r in rows], rows[0]["entry"], rows[0]["leave"])
        return pa.table({"conv": pa.array([r["conv"] for r in rows], pa.int64()), "part": pa.array([r["part"] for r in rows], pa.int64()),
            "entry": pa.array([rows[0]["entry"], *ends[:-1]], pa.int32()), "leave": pa.array(ends, pa.int32())})

    return of


TURN = "conv_id long, piece long, line int, role string, continued boolean, n_lines int, rendered string"


def _turns(model: Model):
    import re

    marker = re.compile(ANY_MARKER)

    def of(group: pa.Table) -> pa.Table:
        rows = _in_order(group)
        states = _through(_line_matrices(model, [r["symbol"] for r in rows], rows[0]["opens"]), rows[0]["entry"], rows[0]["leave"])
        out = []
        for r, s in zip(rows, states, strict=True):
            role, begin = model.states[s]
            if begin or not out:
                out.append({"conv_id": r["conv"], "piece": r["piece"], "line": r["line"], "role": role, "continued": not begin, "lines": []})
            out[-1]["lines"].append(marker.sub("", r["text"], count=1) if begin else r["text"])
        for t in out:
            lines = t.pop("lines")
            t |= {"n_lines": len(lines), "rendered": f"<|{t['role']}|>\n" + "\n".join(lines).strip() + "\n<|end|>\n"}
        return pa.Table.from_pylist(out, pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("line", pa.int32()), ("role", pa.string()),
            ("continued", pa.bool_()), ("n_lines", pa.int32()), ("rendered", pa.string())]))

    return of


def parse(transcripts: DataFrame, model: Model, block: int = 64) -> DataFrame:
    """transcripts (conv_id, piece, text): raw text in pieces. Returns one row for each recovered turn."""
    small_batches(transcripts.sparkSession)
    pieces = transcripts.where("text != ''").select(F.col("conv_id").cast("long").alias("conv"), F.col("piece").cast("long").alias("piece"),
        F.xxhash64("text").alias("h"), "text")
    placed = numbered(lines_of(pieces, "conv", "piece", "h"), "conv", F.col("piece").asc_nulls_first(), F.col("h"), F.col("line"))
    part = F.floor(F.col("nth") / block).cast("long")
    lines = cut(placed.select("conv", "piece", "nth", "line", "text", "symbol", part.alias("part"), (part == 0).alias("opens")), "lines")
    sums = cut(lines.groupBy("conv", "part").applyInArrow(_sums(model), "conv long, part long, m array<double>"), "blocks")
    known = _ends(sums, len(model.states), block)
    return join_nulls(lines, known, "conv", "part").groupBy("conv", "part").applyInArrow(_turns(model), TURN)


def _ends(sums: DataFrame, size: int, block: int) -> DataFrame:
    """sums (conv, part, m) -> conv, part, entry, leave: the best states before and after each block. Conversations of one
    block are settled by it; those of several go up, ``block`` blocks as one, and come down again."""
    many = cut(sums.groupBy("conv").count().where("count > 1").select("conv"), "many")
    last = F.array_position(F.slice("m", 1, size), F.array_max(F.slice("m", 1, size))) - 1  # all rows of an opening matrix are equal
    alone = join_nulls(sums, many, "conv", how="left_anti").select("conv", "part", F.lit(0).alias("entry"), last.cast("int").alias("leave"))
    if not many.take(1):
        return cut(alone, "ends")
    several = join_nulls(sums, many, "conv", how="left_semi").withColumn("up", F.floor(F.col("part") / block).cast("long"))
    above = cut(several.groupBy("conv", "up").applyInArrow(_combined(size), "conv long, part long, m array<double>"), "blocks")
    known = _ends(above, size, block).withColumnRenamed("part", "up")
    down = join_nulls(several, known, "conv", "up").groupBy("conv", "up").applyInArrow(_handed_down(size), "conv long, part long, entry int, leave int")
    return cut(alone.unionByName(down), "ends")


def as_spoken(role: Column, text: Column, key: Column) -> Column:
    """A turn as a transcript may show it: mostly with a marker in one of several spellings, sometimes with none."""
    style = F.pmod(F.xxhash64(key, F.lit(3)), F.lit(5))
    shown = {"user": ("User: ", "Human: ", "### Q: "), "assistant": ("Assistant: ", "AI: ", "### A: "), "system": ("System: ", "[system] ", "### sys: ")}
    mark = F.lit("")
    for name, marks in shown.items():
        mark = F.when(role == name, F.when(style < 2, marks[0]).when(style == 2, marks[1]).when(style == 3, marks[2]).otherwise("")).otherwise(mark)
    return F.concat(mark, text)


def spoken_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return turns.withColumn("text", as_spoken(F.col("role"), F.col("text"), F.struct("conv_id", "turn")))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of every conversation, written as raw transcripts in pieces of up to four turns, parsed back.

    The model learns from all of them."""
    turns = spoken_turns(spark, sf_dir)
    model = fit(turns)
    placed = numbered(turns.where("text is not null"), "conv_id", F.col("turn").asc_nulls_first(), F.xxhash64("text"))
    said = F.array_sort(F.collect_list(F.struct("nth", "text")))  # four at most
    pieces = placed.groupBy("conv_id", F.floor(F.col("nth") / 4).alias("piece")).agg(F.array_join(F.transform(said, lambda x: x["text"]), "\n").alias("text"))
    return parse(pieces, model)
