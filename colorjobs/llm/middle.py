"""Operator 11: fill-in-the-middle documents.

A text is cut into units (lines, or code points); two unit boundaries make it prefix, middle and suffix, which are put
into another order behind sentinels. Where a unit ends is found on the UTF-8 bytes of a whole Arrow batch at once, seen as
64-bit words: the bytes that end a unit are marked by arithmetic on the words, the marks of each word are counted, the
word of a mark is found in the running counts, and the place in the word by a second count. So no line is ever an object, and a
text of any length costs its bytes and two look-ups.

Which form a document takes comes from a hash of its id (columns of Spark), so reruns and other partitionings agree.

Defined cases: a null text is empty, and empty texts stay plain with no unit; a null id counts as an id of no characters;
equal rows give equal rows; other columns are not read; an empty table gives no rows. A text that holds a sentinel stays
plain, so an output says by itself what it was made of.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import small_batches, table

SENTINELS = ("<P>", "<S>", "<M>")
LOW, HIGH = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
ONE, SEVEN, SIX, BYTE, TOP = (np.uint64(x) for x in (1, 7, 6, 8, 56))


def line_ends(words: np.ndarray) -> np.ndarray:
    """The high bit of each byte that is a line feed. No carry passes from byte to byte, so neighbours cannot be taken for one."""
    other = words ^ (LOW * np.uint64(10))
    return ~(((other & ~HIGH) + ~HIGH) | other) & HIGH


def starts(words: np.ndarray) -> np.ndarray:
    """The high bit of each byte that begins a code point (any but 10xxxxxx)."""
    return ~words & HIGH | (words << ONE) & HIGH


def point_ends(words: np.ndarray) -> np.ndarray:
    """The high bit of each byte after which a code point begins; the last byte of all is one of them."""
    begins = starts(words)
    return begins >> BYTE | np.append(begins[1:], HIGH) << TOP & HIGH


class Marks:
    """Marked bytes of a buffer: how many stand before a place, and where the n-th stands."""

    def __init__(self, marked: np.ndarray):
        self.marked = marked
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(marked), dtype=np.int64)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Marks in the bytes before ``at``."""
        word, byte = at >> 3, (at & 7).astype(np.uint64)
        held = np.append(self.marked, np.uint64(0))[word] & ((ONE << (byte * BYTE)) - ONE)
        return self.before[word] + np.bitwise_count(held)

    def select(self, n: np.ndarray) -> np.ndarray:
        """Byte of the n-th mark, from 0."""
        word = np.searchsorted(self.before, n, side="right") - 1
        left = (n - self.before[word]).astype(np.uint64)
        so_far = (self.marked[word] >> SEVEN) * LOW  # byte i: marks in bytes 0 to i, at most 8
        return word * 8 + np.bitwise_count(((left * LOW | HIGH) - so_far) & HIGH)  # bytes that hold no more than ``left``


UNITS = {"line": line_ends, "char": point_ends}


def boundaries(data: np.ndarray, offsets: np.ndarray, one: np.ndarray, other: np.ndarray, unit: str) -> tuple[np.ndarray, ...]:
    """For texts that lie one after the other in ``data``: their units, the bytes at which prefix and middle end when the
    cuts fall after ``one`` % (n + 1) and ``other`` % (n + 1) units, and the code points of prefix and middle."""
    begin, end = offsets[:-1], offsets[1:]
    words = np.zeros(len(data) + 7 >> 3 or 1, np.uint64)
    words.view(np.uint8)[: len(data)] = data
    ends, points = Marks(UNITS[unit](words)), Marks(starts(words))
    first, total = ends.rank(begin), ends.rank(end)
    open_end = (end > begin) & (ends.rank(np.maximum(end - 1, 0)) == total)  # the last unit has no mark of its own
    n = total - first + open_end
    a, b = one % (n + 1), other % (n + 1)

    def place(units: np.ndarray) -> np.ndarray:
        found = (units > 0) & (first + units <= total)
        out = np.where(units > 0, end, begin)
        out[found] = ends.select((first + units - 1)[found]) + 1
        return out

    p, m = place(np.minimum(a, b)), place(np.maximum(a, b))
    before, middle, after = points.rank(begin), points.rank(p), points.rank(m)
    return n, p, m, middle - before, after - middle


def hashed(column: Column, seed: str, group: int) -> Column:
    """The group-th 8 hex digits of sha256("seed:id") as an unsigned integer."""
    told = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(column.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(told, 8 * group + 1, 8), 16, 10).cast("long")


MADE = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def fill_in_middle(docs: DataFrame, seed: str = "7", unit: str = "line", percent: int = 100, spm_percent: int = 50,
    sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars and the output."""
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {sorted(UNITS)}, not {unit!r}")
    small_batches(docs.sparkSession)
    doc_id, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit(""))
    one, other, kept, order = (hashed(doc_id, seed, i) for i in range(4))
    plain = (text == "") | (kept % 100 >= percent)
    for s in sentinels:
        plain = plain | F.contains(text, F.lit(s))
    form = F.when(plain, "plain").when(order % 100 < spm_percent, "spm").otherwise("psm")
    rows = docs.select(doc_id.alias("doc_id"), text.alias("text"), one.alias("one"), other.alias("other"), form.alias("form"))
    P, S, M = (s.encode() for s in sentinels)

    def make(batches):
        for b in batches:
            texts = b.column("text").cast(pa.large_binary())
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + b.num_rows + 1] if b.num_rows else np.zeros(1, np.int64)
            held = texts.buffers()[2]
            data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None and held.size else np.zeros(0, np.uint8)
            offsets = offsets - offsets[0]
            n, p, m, in_prefix, in_middle = boundaries(data, offsets, b.column("one").to_numpy(), b.column("other").to_numpy(), unit)
            forms, raw, out = b.column("form").to_pylist(), memoryview(data), []
            for f, s, i, j, e in zip(forms, offsets.tolist(), p.tolist(), m.tolist(), offsets[1:].tolist(), strict=False):
                prefix, middle, suffix = raw[s:i], raw[i:j], raw[j:e]
                out.append(bytes(raw[s:e]) if f == "plain" else b"".join(
                    (P, prefix, S, suffix, M, middle) if f == "psm" else (S, suffix, P, prefix, M, middle)))
            none = np.array([f == "plain" for f in forms], bool)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), b.column("form"), pa.array(in_prefix, mask=none),
                pa.array(in_middle, mask=none), pa.array(out, pa.binary()).cast(pa.string())], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return rows.mapInArrow(make, MADE)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output was made of: its three parts, told apart by the sentinels, in their first order."""
    parts = F.split(output, "|".join(re.escape(s) for s in sentinels), -1)
    part = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "plain", output).when(form == "psm", F.concat(part(1), part(3), part(2))).otherwise(F.concat(part(2), part(3), part(1)))


def op11_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document by lines, all of those that can be, half of them suffix first."""
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    back = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(back).alias("restored_sha256"))


def op11_sql() -> str:
    h = [f"('0x' || substr(hex, {8 * i + 1}, 8))::BIGINT" for i in range(4)]
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS hex FROM documents),
l AS (SELECT *, regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+') AS lines FROM d),
c AS (SELECT *, len(lines) AS n, {h[0]} % (len(lines) + 1) AS a, {h[1]} % (len(lines) + 1) AS b FROM l),
p AS (SELECT doc_id, text, n,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR {h[2]} % 100 >= 100 THEN 'plain'
         WHEN {h[3]} % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(lines[1 : least(a, b)], '') AS prefix, array_to_string(lines[least(a, b) + 1 : greatest(a, b)], '') AS middle,
    array_to_string(lines[greatest(a, b) + 1 : n], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""
