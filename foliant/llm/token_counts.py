"""Token counts at every prefix of a text, for a byte-level BPE vocabulary, by dynamic programming.

BPE encodings are closed under dropping their last token: if a string's last token is ``t``,
the tokens before it are the encoding of the string without ``t``. So within one
pre-token piece the count at prefix ``k`` is ``count[k - len(t)] + 1``, where ``t`` is the only
token that ends there and may follow the last token of prefix ``k - len(t)``; "may follow" means
that the two tokens' bytes together encode to just these two, which is looked up once a pair.
Counts of earlier pieces add up. Every prefix's exact count is thus known after one linear
pass, and truncation and budget questions need no further encoding.

Pieces end where a longer text might go on (white space before a word, a cut contraction), so
``prefix_counts`` counts the cut pieces of such a prefix by themselves.

Defined results: a null text counts as empty and has 0 tokens; texts of any length are counted whole; of
tokens that may end at one place exactly one follows what stands before, so there are no ties; an empty
table gives an empty result; repeated rows are counted one by one; input columns named like the results are replaced.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns

#: The pre-tokeniser's white space (Unicode White_Space, fixed values).
_SPACE = r"\t-\r \x85\xa0  -     　"
#: Letters of the texts that ``_PLAIN`` lets through (fixed values).
_LATIN = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
#: Characters for which Python's own engine and the classes above are exact: no numerals but 0-9, no odd white space.
_PLAIN = re.compile("[\x00-\x1b \x21-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ]*")


def _pattern(letter: str, number: str, space: str) -> str:
    """The byte-level pre-tokeniser's alternatives, in order (a fixed format)."""
    other = f"[^{space}{letter}{number}]"
    return f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?{other}+|[{space}]+(?![^{space}])|[{space}]+"


_FAST = re.compile(_pattern(_LATIN, "0-9", _SPACE))
_FULL = regex.compile(_pattern(r"\p{L}", r"\p{N}", _SPACE))
#: Distinct pieces whose counts a worker remembers; the older half goes when it is full.
_REMEMBERED = 250_000
_PAIRS = 500_000
_STATES = 400_000


def _byte_letters() -> dict[str, int]:
    """The vocabulary file's letter for each byte: printable bytes stand for themselves, the others for U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Counts for the vocabulary file of one byte-level BPE tokenizer (JSON)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        # Own numbers: a byte its value, a merged token 256 and its merge's rank.
        self.ids = {bytes([b]): b for b in range(256)}
        self.joined: dict[int, int] = {}
        self.left, self.right = list(range(256)), list(range(256))
        for one, two in merges:
            x, y, token = self.ids[raw(one)], self.ids[raw(two)], raw(one) + raw(two)
            new = self.ids.setdefault(token, len(self.left))
            if new == len(self.left):
                self.left.append(x)
                self.right.append(y)
            self.joined.setdefault(x << 32 | y, new)
        missing = [k for k in spec["model"]["vocab"] if all(c in letters for c in k) and raw(k) not in self.ids]
        if missing:
            raise ValueError(f"tokens that no merge makes: {missing[:3]}")
        special = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        # Tokens that a string can encode to, spelt backwards: byte -> node, and at -1 the token that the path spells.
        self.ends: dict = {}
        for token, number in self.ids.items():
            if number < 256 or self._stays(self.left[number], self.right[number], number):
                node = self.ends
                for byte in reversed(token):
                    node = node.setdefault(byte, {})
                node[-1] = number
        self.follows: dict[int, bool] = {}
        #: Count (high half) and last token (low half) of prefixes met before: words with the same beginning share them.
        self.states: dict[bytes, int] = {}
        self.new: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def may_follow(self, a: int, b: int) -> bool:
        """Whether the bytes of ``a`` and ``b`` together encode to just these two tokens.

        The merges that made both are undone, the latest first; before each undoing the two tokens
        that then meet must have no merge of their own that would have come earlier.
        """
        key = a << 32 | b
        if (ok := self.follows.get(key)) is None:
            if len(self.follows) >= _PAIRS:
                self.follows.clear()
            ok = self.follows[key] = self._stays(a, b)
        return ok

    def _stays(self, a: int, b: int, before: int = 1 << 62) -> bool:
        joined = self.joined
        while True:
            if joined.get(a << 32 | b, before) < before:
                return False
            # Of merges of one rank the left one comes first, so on a tie the right token is undone.
            if a > b and a >= 256:
                before, a = a, self.right[a]
            elif b >= 256:
                before, b = b + 1, self.left[b]
            else:
                return True

    def piece_counts(self, piece: bytes) -> list[int]:
        """Token count of every byte prefix of one piece (index 0: the empty prefix)."""
        ends, follows, states = self.ends, self.follows.get, self.states
        if len(states) >= _STATES:
            states.clear()
        counts, last = [0], [0]
        for k in range(1, len(piece) + 1):
            state = states.get(piece[:k]) if k <= 24 else None
            if state is None:
                node, start, found = ends, k, []
                while start and (node := node.get(piece[start - 1])) is not None:
                    start -= 1
                    if -1 in node:
                        found.append((start, node[-1]))
                while True:
                    start, t = found.pop()
                    if start == 0 or (follows(last[start] << 32 | t) or self.may_follow(last[start], t)):
                        break
                state = (counts[start] + 1) << 32 | t
                if k <= 24:
                    states[piece[:k]] = state
            counts.append(state >> 32)
            last.append(state & 0xFFFFFFFF)
        return counts

    def pieces(self, text: str) -> list[str]:
        return _FAST.findall(text) if _PLAIN.fullmatch(text) else _FULL.findall(text)

    def piece_count(self, piece: str) -> int:
        n = self.old.get(piece)
        if n is None:
            n = self.piece_counts(piece.encode("utf-8"))[-1]
        if len(piece) <= 64:
            if len(self.new) >= _REMEMBERED:
                self.old, self.new = self.new, {}
            self.new[piece] = n
        return n

    def segments(self, text: str) -> list[tuple[str, bool]]:
        """The text cut at special tokens' strings, which count 1 each."""
        if self.special is None:
            return [(text, False)]
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [(text[at : m.start()], False), (m.group(), True)]
            at = m.end()
        return [*out, (text[at:], False)]

    def count(self, text: str | None) -> int:
        total = 0
        get = self.new.get
        for segment, special in self.segments(text or ""):
            if special:
                total += 1
                continue
            for piece in self.pieces(segment):
                n = get(piece)
                if n is None:
                    n = self.piece_count(piece)
                    get = self.new.get
                total += n
        return total

    def prefix_counts(self, text: str | None) -> list[int]:
        """The exact token count of ``text[:k]`` for every ``k`` from 0 to its length."""
        out, done = [0], 0
        open_text, open_done = "", 0
        for segment, special in self.segments(text or ""):
            if special:
                # Until its last character a special string goes on with the ordinary text before it.
                out += [*(open_done + self.count(open_text + segment[:k]) for k in range(1, len(segment))), done + 1]
                done += 1
                continue
            open_text, open_done = segment, done
            for piece in self.pieces(segment):
                counts = self.piece_counts(piece.encode("utf-8"))
                ends, size = [], 0
                for c in piece:
                    size += len(c.encode("utf-8"))
                    ends.append(size)
                here = [done + counts[e] for e in ends]
                if piece[0] == "'" and len(piece) > 2 and piece[1:2].isalpha():  # 're, 've, 'll: cut, it is two pieces
                    here[1] = done + counts[1] + self.piece_count(piece[1])
                out += here
                done += counts[-1]
            # A white-space run that a word ends belongs together in prefixes that end within it.
            self._runs(segment, out)
        return out

    def _runs(self, segment: str, out: list[int]) -> None:
        base = len(out) - 1 - len(segment)
        for m in re.finditer(f"[{_SPACE}]+", segment):
            start, end = m.span()
            if end - start > 1:
                counts = self.piece_counts(m.group().encode("utf-8"))
                size = 0
                for k, c in enumerate(m.group(), 1):
                    size += len(c.encode("utf-8"))
                    out[base + start + k] = out[base + start] + counts[size]

    def truncate(self, text: str | None, budget: int) -> str:
        """The longest prefix of at most ``budget`` tokens."""
        counts = self.prefix_counts(text)
        k = max(i for i, n in enumerate(counts) if n <= budget)
        return (text or "")[:k]


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    """One for each file and worker."""
    return PrefixCounter(path)


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def counted(docs: DataFrame, limit: int = 1024, path: str | None = None, text: str = "text") -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_tokens`` and ``over_limit``. ``path``: the vocabulary file, the same on all workers."""

    def make(texts: list[str | None]) -> list[pa.Array]:
        c = counter(path or vocabulary_path())
        return [pa.array([len((t or "").encode("utf-8")) for t in texts], pa.int64()), pa.array([c.count(t) for t in texts], pa.int64())]

    return add_columns(docs, text, {"n_bytes": T.LongType(), "n_tokens": T.LongType()}, make).withColumn("over_limit", F.col("n_tokens") > limit)


def truncated(docs: DataFrame, budget: int, path: str | None = None, text: str = "text") -> DataFrame:
    """``docs`` with ``truncated``: each text's longest prefix within ``budget`` tokens."""

    def make(texts: list[str | None]) -> list[pa.Array]:
        c = counter(path or vocabulary_path())
        return [pa.array([c.truncate(t, budget) for t in texts], pa.string())]

    return add_columns(docs, text, {"truncated": T.StringType()}, make)


def count_all(docs: DataFrame) -> DataFrame:
    return counted(docs.select("doc_id", "text")).drop("text")
