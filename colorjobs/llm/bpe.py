"""Operator 12: byte-pair encoding and decoding by a table of last tokens.

For every prefix of a piece exactly one token can be the last of the prefix's encoding. It is found among the tokens that
end there (the whole-token states on the suffix links of a suffix automaton of the vocabulary) as the one that is
compatible with the last token of the prefix before it. Stored for each prefix, these tokens are the back-pointers: from the
end of the piece they lead to its ids. The cost of a piece is its length, whatever the order in which its pairs merge. New
pieces of a batch of texts take each step together (``LastTokens``), as arrays; words of texts met before are remembered.

Two tokens are compatible if no merge crosses the boundary between them. Of the left token only the right edge of its merge
tree touches the boundary, of the right token only the left edge; each node of an edge lives from its own merge until the
merge that takes it up. So it is enough to walk both edges back in time and look for a crossing merge of two nodes that live
at the same time and whose merge would have come before either is taken up (of equal merges, the left one comes first).

That holds where each token is the result of one merge, later than those of its parts; other vocabularies are refused. Tokens
that no text can give, because a crossing merge always comes first, are left out of the automaton.

Defined cases: null text is empty and gives no ids, an empty list decodes to the empty text, a null list to null; special
tokens in a text are their own ids; an id that the vocabulary lacks decodes to nothing; repeated rows are encoded one by one; other
columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import json
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import small_batches, table
from .pieces import Cutter, byte_letters

NEVER = 1 << 40
#: Words whose ids a worker remembers (some 80 MB), and bytes of a piece beyond which it is encoded by itself.
HELD_WORDS, ALONE = 300_000, 128
_codecs: dict = {}
_decoders: dict = {}


class Numbers:
    """Numbers by whole-number keys (from 0), looked up many at a time; a default where a key is unknown."""

    def __init__(self, held: dict[int, int], default: int):
        keys, values = np.fromiter(held, np.int64, len(held)), np.fromiter(held.values(), np.int64, len(held))
        bits = (4 * len(held) + 8).bit_length()
        self.down, self.mask, self.default = np.uint64(64 - bits), (1 << bits) - 1, default
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, default, np.int64)
        at = self.home(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]
            mine = self.keys[at] == keys
            self.values[at[mine]] = values[mine]
            keys, values, at = keys[~mine], values[~mine], (at[~mine] + 1) & self.mask

    def home(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.down).astype(np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        at = self.home(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.values[at], self.default)
        lost = np.flatnonzero((there != keys) & (there >= 0))
        while len(lost):
            at[lost] = (at[lost] + 1) & self.mask
            there = self.keys[at[lost]]
            hit = there == keys[lost]
            out[lost[hit]] = self.values[at[lost[hit]]]
            lost = lost[~hit & (there >= 0)]
        return out


class Merges:
    """Merge trees of a vocabulary. Ranks count from 0; symbols, which no merge makes, were always there (-1)."""

    def __init__(self, vocab: dict[str, int], merges: list):
        self.size = max(vocab.values(), default=0) + 1
        self.parts: dict[int, tuple[int, int]] = {}
        self.born = [-1] * self.size
        self.rank: dict[int, int] = {}
        for rank, pair in enumerate(merges):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            x, y, made = vocab[left], vocab[right], vocab[left + right]
            if made in self.parts:
                raise ValueError("each token must come from one merge")
            self.parts[made], self.born[made], self.rank[x * self.size + y] = (x, y), rank, rank
        if any(self.born[p] >= self.born[made] for made, pair in self.parts.items() for p in pair):
            raise ValueError("a merge must come after those of its parts")
        self.known: dict[int, bool] = {}

    def compatible(self, left: int, right: int) -> bool:
        key = left * self.size + right
        found = self.known.get(key)
        if found is None:
            if len(self.known) > HELD_WORDS:
                self.known.clear()
            found = self.known[key] = self.meet(left, right, NEVER)
        return found

    def meet(self, left: int, right: int, until: int) -> bool:
        """Both tokens stand side by side up to time ``until``, with no merge across their boundary."""
        born, left_taken, right_taken = self.born, until, until
        while True:
            crossing = self.rank.get(left * self.size + right, NEVER)
            if crossing < left_taken and crossing <= right_taken:
                return False
            if born[left] > born[right]:  # undo the later of the two; of equal merges the left one came first
                left, left_taken = self.parts[left][1], born[left]
            elif born[right] >= 0:
                right, right_taken = self.parts[right][0], born[right]
            else:
                return True

    def reachable(self) -> set[int]:
        """Symbols, and tokens that their own text is encoded as."""
        out = {i for i in range(self.size) if i not in self.parts}
        for made, (x, y) in sorted(self.parts.items(), key=lambda p: self.born[p[0]]):
            if x in out and y in out and self.meet(x, y, self.born[made]):
                out.add(made)
        return out

    def symbols(self) -> dict[int, tuple[int, ...]]:
        """Each merged token as symbols."""
        out: dict[int, tuple[int, ...]] = {}
        for made, pair in sorted(self.parts.items(), key=lambda p: self.born[p[0]]):
            out[made] = sum((out.get(p, (p,)) for p in pair), ())
        return out


class TokenAutomaton:
    """Suffix automaton of a set of tokens over symbols. A whole token is the longest string of its state, because there it
    occurs with nothing before it."""

    def __init__(self, tokens: dict[int, tuple[int, ...]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.longest, self.token = [-1], [0], [-1]
        for token, spelled in tokens.items():
            at = 0
            for c in spelled:
                at = self.grow(at, c)
            self.token[at] = token
        self.lists: list = [None] * len(self.next)

    def state(self, longest: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.longest.append(longest)
        self.token.append(-1)
        return len(self.next) - 1

    def split(self, at: int, c: int, target: int) -> int:
        """The state of the strings of ``target`` that are one symbol longer than those of ``at``, or shorter."""
        if self.longest[target] == self.longest[at] + 1:
            return target
        part = self.state(self.longest[at] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = part
        while at >= 0 and self.next[at].get(c) == target:
            self.next[at][c] = part
            at = self.link[at]
        return part

    def grow(self, at: int, c: int) -> int:
        """The state of the string that ``at`` stands for and one symbol more."""
        if (there := self.next[at].get(c)) is not None:
            return self.split(at, c, there)
        new, up = self.state(self.longest[at] + 1, {}, 0), at
        while up >= 0 and c not in self.next[up]:
            self.next[up][c] = new
            up = self.link[up]
        if up >= 0:
            self.link[new] = self.split(up, c, self.next[up][c])
        return new

    def ending(self, at: int) -> list[tuple[int, int]]:
        """(token, symbols) of all tokens that are suffixes of the state's longest string, longest first."""
        found = self.lists[at]
        if found is None:
            found, up = [], at
            while up > 0:
                if self.token[up] >= 0:
                    found.append((self.token[up], self.longest[up]))
                up = self.link[up]
            self.lists[at] = found
        return found


class LastTokens:
    """The same table for many pieces at once: each step is taken by all pieces that are long enough for it."""

    def __init__(self, merges: Merges, automaton: TokenAutomaton, length: list[int]):
        self.size = merges.size
        self.born = np.array(merges.born, np.int64)
        self.parts = np.array([merges.parts.get(t, (t, t)) for t in range(merges.size)], np.int64)
        self.rank = Numbers(merges.rank, NEVER)
        self.moves = Numbers({s * merges.size + c: to for s, moves in enumerate(automaton.next) for c, to in moves.items()}, -1)
        self.link, self.longest = np.array(automaton.link, np.int64), np.array(automaton.longest, np.int64)
        self.token, self.length = np.array(automaton.token, np.int64), np.array(length, np.int64)
        self.up = np.zeros(len(self.link), np.int64)  # the next whole token on the links of a state
        for s in np.argsort(self.longest, kind="stable")[1:]:
            over = self.link[s]
            self.up[s] = over if self.token[over] >= 0 else self.up[over]

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merges.compatible of many pairs."""
        out, open_ = np.ones(len(left), bool), np.arange(len(left))
        left_taken = right_taken = np.full(len(left), NEVER)
        while len(open_):
            crossing = self.rank.of(left * self.size + right)
            met = (crossing < left_taken) & (crossing <= right_taken)
            out[open_[met]] = False
            born_left, born_right = self.born[left], self.born[right]
            undo_left, undo_right = born_left > born_right, (born_left <= born_right) & (born_right >= 0)
            left, left_taken = np.where(undo_left, self.parts[left, 1], left), np.where(undo_left, born_left, left_taken)
            right, right_taken = np.where(undo_right, self.parts[right, 0], right), np.where(undo_right, born_right, right_taken)
            on = ~met & (undo_left | undo_right)
            open_, left, right, left_taken, right_taken = open_[on], left[on], right[on], left_taken[on], right_taken[on]
        return out

    def of(self, symbols: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Pieces are symbols[begin : begin + size], longest first. The last token of each prefix, at its end."""
        last = np.zeros(len(symbols), np.int64)
        at, matched = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
        for end in range(int(size[0])):
            on = np.searchsorted(-size, -end, side="left")  # the pieces that have a symbol here come first
            at, matched = at[:on], matched[:on]
            place = begin[:on] + end
            c, open_ = symbols[place], np.arange(on)
            while len(open_):
                there = self.moves.of(at[open_] * self.size + c[open_])
                got = there >= 0
                at[open_[got]] = there[got]
                matched[open_[got]] += 1
                open_ = open_[~got]
                at[open_] = self.link[at[open_]]
                matched[open_] = self.longest[at[open_]]
            state = np.where((self.token[at] >= 0) & (self.longest[at] <= matched), at, self.up[at])
            open_ = np.arange(on)
            while len(open_):
                token, n = self.token[state[open_]], self.longest[state[open_]]
                fits = n > end
                rest = np.flatnonzero(~fits)
                fits[rest] = self.compatible(last[place[open_[rest]] - n[rest]], token[rest])
                last[place[open_[fits]]] = token[fits]
                open_ = open_[~fits]
                state[open_] = self.up[state[open_]]
        return last

    def ids(self, symbols: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that lie one after the other, and how many each has."""
        begin = np.cumsum(size) - size
        order = np.argsort(-size, kind="stable")
        last = self.of(symbols, begin[order], size[order])
        left, rounds, open_ = size.copy(), [], np.arange(len(size))
        count = np.zeros(len(size), np.int64)
        while len(open_):  # back-pointers: from the end of each piece
            token = last[begin[open_] + left[open_] - 1]
            rounds.append((open_, token))
            left[open_] -= self.length[token]
            count[open_] += 1
            open_ = open_[left[open_] > 0]
        behind = np.cumsum(count)
        out = np.zeros(int(behind[-1]), np.int64)
        for k, (piece, token) in enumerate(rounds):
            out[behind[piece] - 1 - k] = token
        return out, count


class Decoder:
    """Texts of ids, for a byte-level BPE tokenizer."""

    def __init__(self, told: dict):
        kind = (told.get("decoder") or {}).get("type")
        if kind not in (None, "ByteLevel"):
            raise ValueError(f"no decoder of type {kind}")
        special = {t["content"]: t["id"] for t in told["added_tokens"]}
        vocab, self.joined = told["model"]["vocab"] | special, kind is None
        self.texts: list = [None] * (1 + max(vocab.values()))
        for t, i in vocab.items():
            self.texts[i] = t if self.joined else t.encode() if t in special else bytes(map(byte_letters().__getitem__, t))

    def decode(self, ids: list[int]) -> str:
        """As the library does: without a decoder, tokens joined by spaces; at byte level, their bytes in a row."""
        try:
            if ids and min(ids) < 0:
                raise IndexError
            parts = list(map(self.texts.__getitem__, ids))
            return " ".join(parts) if self.joined else b"".join(parts).decode(errors="replace")
        except (IndexError, TypeError):
            known = [i for i in ids if 0 <= i < len(self.texts) and self.texts[i] is not None]
            return self.decode(known) if len(known) < len(ids) else ""


class Codec(Decoder):
    """Ids of texts, and texts of ids, for a byte-level BPE tokenizer in a file."""

    def __init__(self, path: str):
        self.cutter = Cutter(path)
        told, model = self.cutter.told, self.cutter.told["model"]
        super().__init__(told)
        steps = told.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("only plain byte-pair encodings are served")
        if "ByteLevel" not in [p["type"] for p in (steps, *steps.get("pretokenizers", ()))]:
            raise ValueError("only byte-level vocabularies are served")
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.merges = Merges(vocab, model["merges"])
        inside, last = [0] * 256, [0] * 256
        for letter, b in byte_letters().items():
            inside[b], last[b] = vocab[letter], vocab[letter + suffix]
        self.inside, self.last = np.array(inside, np.int64), np.array(last, np.int64)
        spelled, kept = self.merges.symbols(), self.merges.reachable()
        symbols = {s: (s,) for s in (*inside, *last)}
        self.automaton = TokenAutomaton(symbols | {t: x for t, x in spelled.items() if t in kept})
        self.length = [len(spelled.get(t, " ")) for t in range(self.merges.size)]
        self.many = LastTokens(self.merges, self.automaton, self.length)
        self.known: dict[str, bytes] = {}
        self.cutter.told = {}

    def piece(self, raw: bytes) -> list[int]:
        """One piece, step by step."""
        symbols = [*self.inside[list(raw[:-1])].tolist(), int(self.last[raw[-1]])] if len(raw) > 1 else [int(self.last[raw[-1]])]
        moves, link, longest, lists = self.automaton.next, self.automaton.link, self.automaton.longest, self.automaton.lists
        compatible, known, size = self.merges.compatible, self.merges.known, self.merges.size
        at = matched = 0
        tokens: list[int] = []  # the last token of each prefix
        for end, c in enumerate(symbols):
            while (there := moves[at].get(c)) is None:
                at = link[at]
                matched = longest[at]
            at, matched = there, matched + 1
            found = lists[at]
            for token, n in self.automaton.ending(at) if found is None else found:
                if n > matched:
                    continue
                if n > end:
                    tokens.append(token)
                    break
                before = tokens[end - n]
                fits = known.get(before * size + token)
                if compatible(before, token) if fits is None else fits:
                    tokens.append(token)
                    break
            else:
                raise AssertionError("each prefix has a last token")
        out, end = [], len(tokens)
        while end:
            out.append(tokens[end - 1])
            end -= self.length[tokens[end - 1]]
        return out[::-1]

    def pieces(self, new: list[bytes]) -> list[bytes]:
        """Each one's ids as little-endian 32-bit integers."""
        out = [np.array(self.piece(p), "<i4").tobytes() if len(p) > ALONE else b"" for p in new]
        short = [i for i, p in enumerate(new) if len(p) <= ALONE]
        if short:
            size = np.array([len(new[i]) for i in short], np.int64)
            raw = np.frombuffer(b"".join([new[i] for i in short]), np.uint8)
            symbols, ends = self.inside[raw], np.cumsum(size) - 1
            symbols[ends] = self.last[raw[ends]]
            ids, count = self.many.ids(symbols, size)
            held, at = ids.astype("<i4").tobytes(), 0
            for i, e in zip(short, (4 * np.cumsum(count)).tolist(), strict=True):
                out[i] = held[at:e]
                at = e
        return out

    def learn(self, words: list[str]) -> None:
        """Ids of new words of plain texts."""
        cut = [self.cutter.cut(w) for w in words]
        new = list(dict.fromkeys(p for pieces in cut for p in pieces))
        ids = dict(zip(new, self.pieces([p.encode() for p in new]), strict=True))
        for w, pieces in zip(words, cut, strict=True):
            self.known[w] = b"".join([ids[p] for p in pieces])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        fine = [self.cutter.plain(t) for t in texts]
        words = [self.cutter.words(t) if ok else () for t, ok in zip(texts, fine, strict=True)]
        new = set(chain.from_iterable(words)).difference(self.known)
        if len(self.known) + len(new) > HELD_WORDS:
            self.known.clear()
            new = set(chain.from_iterable(words))
        if new:
            self.learn(list(new))
        odd = [self.cutter.cut_any(t) for t, ok in zip(texts, fine, strict=True) if not ok]
        pieces = list({p for cut in odd for p in cut if isinstance(p, bytes)})
        ids = dict(zip(pieces, self.pieces(pieces), strict=True)) | {i: np.array([i], "<i4").tobytes() for i in self.cutter.special.values()}
        of, cut = self.known.__getitem__, iter(odd)
        return [b"".join(map(of, w)) if ok else b"".join(map(ids.__getitem__, next(cut))) for w, ok in zip(words, fine, strict=True)]


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def decoder(path: str) -> Decoder:
    """Only the vocabulary: encoding and decoding run in workers of their own."""
    if path not in _decoders:
        with open(path, encoding="utf-8") as f:
            _decoders[path] = Decoder(json.load(f))
    return _decoders[path]


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """docs: doc_id, text. Returns doc_id and ids, the whole text's, special tokens not added."""
    small_batches(docs.sparkSession, 400)

    def ids(batches):
        own = codec(tokenizer)
        for b in batches:
            made = own.encode([t or "" for t in b.column(1).to_pylist()])
            ends = np.cumsum([0, *(len(x) // 4 for x in made)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(made), "<i4"), pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(ids, "doc_id long, ids array<int>")


def decoded(ids: Column, tokenizer: str) -> Column:
    """The text of a column of ids, special tokens kept."""

    @F.arrow_udf("string")
    def text(lists: pa.Array) -> pa.Array:
        own = decoder(tokenizer)
        values, at = lists.values.to_numpy(zero_copy_only=False).tolist(), lists.offsets.to_numpy().tolist()
        return pa.array([own.decode(values[a:e]) if ok else None for a, e, ok in zip(at, at[1:], lists.is_valid().to_pylist(), strict=False)], pa.string())

    return text(ids)


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded, and its ids decoded."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    rows = encode(table(spark, sf_dir, "documents"), path)
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), sha(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"),
        sha(decoded(F.col("ids"), path)).alias("decoded_sha256"))
