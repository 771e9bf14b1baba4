"""Seeded merge-dropout for a SentencePiece BPE model: varied segmentations that decode to the same text.

Encoding follows the model's merge order with an agenda of candidate merges, best first and
leftmost among equals. When a candidate comes up it is skipped for good if a keyed hash of
(seed, document, position in the text, merged piece) falls below the dropout rate, so a run is
repeatable on any worker and in any order, and every occurrence of a word is cut for itself.
Characters without a piece fall back to byte pieces, so decoding gives the whole text back. With
rate 0 the result is the library's own encoding.

No merge goes across two neighbouring characters that no piece holds side by side, so a text
falls into parts with an agenda each; a space mark after another character is always such a border.
The agendas of all parts of many texts are worked off side by side: a step takes the best
candidate of every part, skips or merges it, and looks up the two pairs that are new. Nothing is
remembered between texts. A long part keeps its agenda as a heap of its own.

Defined results: a null text is encoded as an empty one, which has no tokens; texts of any length are
encoded whole; an empty table gives an empty result; of merges with equal scores the leftmost comes up
first; repeated rows with one id are cut alike, and rows without an id as if they had one id; input
columns named like the results are replaced.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns

MARK = "▁"
_MASK = (1 << 64) - 1
#: Characters of a part that is worked off side by side with others, in bits; rank of no merge.
_PLACE = 8
_NEVER = np.iinfo(np.int32).max
_AT, _PIECE, _MIX = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9


class PairTable:
    """Values (int32) of pairs of ids below 2**17, found by hashing; -1 for an unknown pair."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        keys = np.array([a << 17 | b for a, b in pairs], np.uint64)
        values = np.array(list(pairs.values()), np.int32)
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys, self.values = np.full(1 << bits, _MASK, np.uint64), np.full(1 << bits, -1, np.int32)
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] == _MASK
            self.keys[slot[free]] = keys[free]
            own = self.keys[slot] == keys
            self.values[slot[own]] = values[own]
            keys, values, slot = keys[~own], values[~own], (slot[~own] + 1) & ((1 << bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(_AT)) >> self.shift).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(np.uint64) << np.uint64(17) | b.astype(np.uint64)
        slot = self._slot(keys)
        held = self.keys[slot]
        out = self.values[slot]
        todo = np.flatnonzero(held != keys)
        todo = todo[held[todo] != _MASK]
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (len(self.keys) - 1)
            held = self.keys[slot[todo]]
            right = held == keys[todo]
            out[todo] = np.where(right, self.values[slot[todo]], -1)
            todo = todo[~right & (held != _MASK)]
        return out


class Pieces:
    """The pieces of one SentencePiece BPE model file."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        if n > 1 << 16:
            raise ValueError("ids are kept as 16-bit numbers")
        score = [sp.get_score(i) for i in range(n)]
        # Only ordinary pieces are merged into; the best score is the least rank.
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        text = {i: sp.id_to_piece(i) for i in plain}
        self.ids = {s: i for i, s in text.items()}
        if any(MARK in s.lstrip(MARK) for s in self.ids):
            raise ValueError("pieces with an inner space mark can't be cut part by part")
        self.rank = np.zeros(n, np.int32)
        place, last = -1, None
        for i in sorted(plain, key=lambda i: -score[i]):
            if score[i] != last:
                place, last = place + 1, score[i]
            self.rank[i] = place
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        byte_of = {i: b for b, i in enumerate(self.byte)}
        raw = [text[i].replace(MARK, " ").encode() if i in text else bytes([byte_of[i]]) if i in byte_of else b"" for i in range(n)]
        self.byte_at = np.concatenate([[0], np.cumsum([len(b) for b in raw])]).astype(np.int64)
        self.all_bytes = np.frombuffer(b"".join(raw), np.uint8)
        # Numbers of all characters; those that only stand within pieces have one beyond the ids.
        chars = {c for s in self.ids for c in s}
        number = dict(self.ids) | {c: n + k for k, c in enumerate(sorted(chars - self.ids.keys()))}
        self.n = n
        self.char = np.full(0x110000, -1, np.int32)
        for c in chars:
            self.char[ord(c)] = number[c]
        #: Characters that stand side by side in some piece; no merge goes across any other border.
        self.beside = PairTable({(number[s[k]], number[s[k + 1]]): 1 for s in self.ids for k in range(len(s) - 1)})
        self.merges = PairTable({(number[s[:k]], number[s[k:]]): i for s, i in self.ids.items() for k in range(1, len(s)) if s[:k] in number and s[k:] in number})

    def _bytes_of(self, parts) -> list[int]:
        out: list[int] = []
        for p in parts:
            i = self.ids.get(p)
            if i is not None:
                out.append(i)
            else:
                out += [self.byte[b] for b in p.encode("utf-8")]
        return out

    def cut(self, part: str, rate: float, key: int, begin: int) -> list[int]:
        """Ids of one part that begins at ``begin`` of its document, whose hash is ``key``; the agenda is a heap,
        whose cost grows little more than the part."""
        ids = self.ids
        parts: list[str | None] = list(part)
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda: list[tuple[int, int, int, str]] = []
        rank, below = self.rank, int(rate * (1 << 32))

        def propose(at: int) -> None:
            nxt = after[at]
            if at >= 0 and nxt < n:
                joined = parts[at] + parts[nxt]
                i = ids.get(joined)
                if i is not None:
                    heapq.heappush(agenda, (int(rank[i]), at, i, joined))

        for at in range(n - 1):
            propose(at)
        while agenda:
            _, at, i, joined = heapq.heappop(agenda)
            nxt = after[at]
            if parts[at] is None or nxt >= n or len(parts[at]) + len(parts[nxt]) != len(joined):
                continue  # one side has been merged since
            if below:
                h = (key ^ ((begin + at) * _AT + i * _PIECE)) & _MASK
                if ((h ^ (h >> 31)) * _MIX & _MASK) >> 32 < below:
                    continue
            parts[at], parts[nxt] = joined, None
            after[at] = after[nxt]
            if after[nxt] < n:
                before[after[nxt]] = at
            if before[at] >= 0:
                propose(before[at])
            propose(at)
        return self._bytes_of(p for p in parts if p is not None)

    def encode_all(self, texts: list[str | None], rate: float, seed: int, documents: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(ids (uint16) of all texts, one after the other; how many each text has). ``documents``: a number for each
        text, by which its occurrences are cut."""
        whole = "".join([MARK + t.replace(" ", MARK) for t in texts if t])
        sizes = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        keys = np.array([xxhash.xxh3_64_intdigest(str(d).encode(), seed & _MASK) for d in documents], np.uint64)
        code = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        n = len(code)
        if not n:
            return np.zeros(0, np.uint16), np.zeros(len(texts), np.int64)
        piece = self.char[code]
        known = piece >= 0
        # Parts: runs of characters that merges may cross.
        border = np.ones(n, bool)
        inner = np.flatnonzero(known[1:] & known[:-1]) + 1
        border[inner] = self.beside.find(piece[inner - 1], piece[inner]) < 0
        border[bounds[:-1][sizes > 0]] = True
        start = np.flatnonzero(border)
        length = np.diff(np.append(start, n))
        text_of = np.searchsorted(bounds, start, side="right") - 1
        alive = np.ones(n, bool)
        short = (length > 1) & (length < 1 << _PLACE)
        self._work_off(piece, alive, start[short], length[short], keys[text_of[short]], start[short] - bounds[text_of[short]], int(rate * (1 << 32)))
        # Characters without a piece of their own give their bytes; long parts are cut one by one.
        count = (alive & (piece >= 0)).astype(np.int64)
        other: dict[int, list[int]] = {}
        for k in np.flatnonzero(alive & ((piece < 0) | (piece >= self.n))).tolist():
            other[k] = [self.byte[b] for b in whole[k].encode("utf-8")]
        for a, m, t in zip(*(x[length >= 1 << _PLACE].tolist() for x in (start, length, text_of)), strict=True):
            for k in range(a, a + m):
                other.pop(k, None)
            count[a : a + m] = 0
            other[a] = self.cut(whole[a : a + m], rate, int(keys[t]), a - int(bounds[t]))
        own = np.flatnonzero(count)
        if other:
            at = np.array(list(other), np.int64)
            count[at] = [len(x) for x in other.values()]
            own = own[~np.isin(own, at)]
        run = np.concatenate([[0], np.cumsum(count)])
        ids = np.empty(run[-1], np.uint16)
        ids[run[own]] = piece[own]
        for k, x in other.items():
            ids[run[k] : run[k] + len(x)] = x
        return ids, np.diff(run[bounds])

    def _work_off(self, piece: np.ndarray, alive: np.ndarray, start: np.ndarray, length: np.ndarray, key: np.ndarray, begin: np.ndarray, below: int) -> None:
        """Work off the agendas of the parts at ``start``: ``piece`` gets the piece that begins at each character,
        ``alive`` becomes false for characters within one. Places are counted from a part's own start."""
        if not len(start):
            return
        run = np.cumsum(length)
        first = run - length
        place = np.arange(run[-1]) - np.repeat(first, length)
        at = np.repeat(start, length) + place
        place = place.astype(np.int32)
        own, live = piece[at], np.ones(len(at), bool)
        after, before = place + np.int32(1), place - np.int32(1)
        joined = np.full(len(at), -1, np.int32)
        inner = np.flatnonzero(place > 0)
        joined[inner - 1] = self.merges.find(own[inner - 1], own[inner])
        agenda = np.where(joined >= 0, self.rank[joined] << _PLACE | place, _NEVER).astype(np.int32)
        limit = np.uint64(below)
        while True:
            best = np.minimum.reduceat(agenda, first)
            todo = np.flatnonzero(best != _NEVER)
            if 2 * len(todo) < len(first):
                # The parts that are done go.
                open_ = best != _NEVER
                rows = np.repeat(open_, length)
                piece[at[~rows]], alive[at[~rows]] = own[~rows], live[~rows]
                if not len(todo):
                    return
                at, own, live, after, before, joined, agenda = (x[rows] for x in (at, own, live, after, before, joined, agenda))
                length, key, begin, best = length[open_], key[open_], begin[open_], best[open_]
                first = np.cumsum(length) - length
                todo = np.arange(len(first))
            base = first[todo]
            local = best[todo] & np.int32((1 << _PLACE) - 1)
            x = base + local
            new = joined[x]
            if below:
                h = key[todo] ^ ((begin[todo] + local).astype(np.uint64) * np.uint64(_AT) + new.astype(np.uint64) * np.uint64(_PIECE))
                h = ((h ^ (h >> np.uint64(31))) * np.uint64(_MIX)) >> np.uint64(32)
                merged = h >= limit
                agenda[x[~merged]] = _NEVER
                todo, base, local, x, new = todo[merged], base[merged], local[merged], x[merged], new[merged]
            y = base + after[x]
            own[x], live[y], agenda[y], agenda[x] = new, False, _NEVER, _NEVER
            beyond = after[y]
            after[x] = beyond
            right = np.flatnonzero(beyond < length[todo])
            left = np.flatnonzero(before[x] >= 0)
            after_x, before_x = base[right] + beyond[right], base[left] + before[x[left]]
            before[after_x] = local[right]
            a, b = np.concatenate([x[right], before_x]), np.concatenate([after_x, x[left]])
            found = self.merges.find(own[a], own[b])
            joined[a] = found
            where = np.concatenate([local[right], before[x[left]]])
            agenda[a] = np.where(found >= 0, self.rank[found] << _PLACE | where, _NEVER)

    def encode(self, text: str | None, rate: float, seed: int, document: int) -> np.ndarray:
        """Ids (uint16) of a whole text."""
        return self.encode_all([text], rate, seed, [document])[0]

    def decode_all(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The bytes of several texts, whose ids stand one after the other."""
        begin = self.byte_at[ids]
        n = self.byte_at[ids.astype(np.int64) + 1] - begin
        run = np.cumsum(n)
        raw = self.all_bytes[np.arange(run[-1] if len(run) else 0) + np.repeat(begin - run + n, n)].tobytes()
        at = np.concatenate([[0], run])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [raw[a + 1 : b] for a, b in zip(at, at[1:], strict=False)]

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_all(ids, np.array([len(ids)]))[0].decode("utf-8")


@lru_cache(maxsize=8)
def pieces(path: str) -> Pieces:
    """One for each file."""
    return Pieces(path)


def vocabulary_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoded(docs: DataFrame, rate: float = 0.1, seed: int = 1, path: str | None = None, text: str = "text", key: str = "doc_id", keep_ids: bool = True) -> DataFrame:
    """``docs`` with ``token_ids`` (unless ``keep_ids`` is false), ``n_tokens``, ``ids_hash`` and ``lossless``.

    Every occurrence of a word is cut by the document's ``key`` and its place in the text.
    ``lossless`` is the result of decoding the ids and comparing with the text. A space mark
    that the text itself holds comes back as a space, as it does from the library; such a text
    is compared with its marks as spaces.
    """
    joined = docs.withColumn("__both", F.concat(F.xxhash64(F.col(key)).cast("string"), F.lit(":"), F.coalesce(F.col(text), F.lit(""))))
    new = {"n_tokens": T.LongType(), "ids_hash": T.StringType(), "lossless": T.BooleanType()} | ({"token_ids": T.ArrayType(T.IntegerType(), False)} if keep_ids else {})

    def make(texts: list[str | None]) -> list[pa.Array]:
        p = pieces(path or vocabulary_path())
        documents, plain = [], []
        for both in texts:
            document, _, t = both.partition(":")
            documents.append(int(document))
            plain.append(t)
        flat, n = p.encode_all(plain, rate, seed, documents)
        same = [got == t.replace(MARK, " ").encode() for got, t in zip(p.decode_all(flat, n), plain, strict=True)]
        bounds = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
        hashes = [xxhash.xxh3_64_hexdigest(flat[a:b].tobytes()) for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False)]
        out = [pa.array(n, pa.int64()), pa.array(hashes, pa.string()), pa.array(same, pa.bool_())]
        if keep_ids:
            out.append(pa.ListArray.from_arrays(bounds, flat.astype(np.int32)))
        return out

    return add_columns(joined, "__both", new, make).drop("__both")


def encode_all(docs: DataFrame) -> DataFrame:
    return encoded(docs.select("doc_id", "text"), keep_ids=False).drop("text")


def encode_stage(docs: DataFrame) -> DataFrame:
    """Pipeline stage: every document's ids."""
    return encoded(docs.select("doc_id", "text", "lang", "source")).drop("text")
