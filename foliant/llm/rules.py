"""Quality rules: a learned decision list over interpretable statistics of whole texts.

Statistics are counted in one pass. From a bounded sample of labelled documents, sequential
covering grows conjunctions of thresholds (most FOIL gain first), prunes each on rows held
out from growing, removes the rows it covers and goes on. The list is emitted as one Spark
``CASE WHEN`` whose conditions come in the learned order.

Words are runs of characters other than the six ASCII white-space characters. Defined
results: a null or empty text has no words and fails the base rules; texts of any length are measured
whole; without labelled rows the list is empty and keeps what the base rules keep; of conditions with
equal gain the first in the order of the statistics is taken; an empty table gives an empty result;
repeated rows are judged one by one;
input columns named like the results are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, labelled_texts

#: Characters that count as symbols (fixed values).
SYMBOLS = b"#*$%&|<>"
BASE_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Learned rules see these shares; names are those of the emitted conditions.
FEATURES = ("mean_word_chars", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "bang_share", "distinct_share", "words_a_line")


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    m = len(ids)
    pair = a[:-1] * m + a[1:]
    if m >= 1 << 20:  # three ids wouldn't fit in 63 bits
        pair = np.unique(pair, return_inverse=True)[1]
    code = pair[:-1] * m + a[2:]
    order = np.argsort(code, kind="stable")
    same = code[order][1:] == code[order][:-1]
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def measure(text: str | None) -> tuple:
    """The base counts and the features of one text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    spaces = sum(map(raw.count, (b" ", b"\t", b"\n", b"\r", b"\x0b", b"\x0c")))
    chars = len(text) - spaces
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    dups = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = len(raw) - len(raw.translate(None, b"0123456789"))
    c, w = max(chars, 1), max(n, 1)
    shares = (chars / w, symbols / c, dups / max(len(lines), 1), repeats / w, upper / c, digits / c, raw.count(b"!") / c, len(set(words)) / w, n / max(len(lines), 1))
    return (n, chars, symbols, dups, repeats, *shares)


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the base counts (long) and the features (double)."""

    def make(texts: list[str | None]) -> list[pa.Array]:
        columns = list(zip(*map(measure, texts), strict=True)) or [()] * (len(BASE_COLUMNS) + len(FEATURES))
        return [pa.array(c, pa.int64() if i < len(BASE_COLUMNS) else pa.float64()) for i, c in enumerate(columns)]

    return add_columns(docs, text, {**dict.fromkeys(BASE_COLUMNS, T.LongType()), **dict.fromkeys(FEATURES, T.DoubleType())}, make)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    value: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        v = x[:, FEATURES.index(self.feature)]
        return v > self.value if self.above else v <= self.value

    def column(self) -> Column:
        c = F.col(self.feature)
        return c > F.lit(self.value) if self.above else c <= F.lit(self.value)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.value:.6g}"


@dataclass(frozen=True)
class Settings:
    #: Most labelled rows that learning reads; only their statistics reach the driver.
    sample: int = 6000
    most_rules: int = 12
    most_conditions: int = 4
    cuts: int = 32
    least_precision: float = 0.8
    least_covered: int = 3


def covered(rule: list[Condition], x: np.ndarray) -> np.ndarray:
    return reduce(np.logical_and, [c.holds(x) for c in rule], np.ones(len(x), bool))


def grow(x: np.ndarray, bad: np.ndarray, cfg: Settings) -> list[Condition]:
    rule: list[Condition] = []
    inside = np.ones(len(x), bool)
    while len(rule) < cfg.most_conditions:
        p, n = int((inside & bad).sum()), int((inside & ~bad).sum())
        if not p or not n:
            break
        before, best = np.log2(p / (p + n)), (0.0, None)
        for f, name in enumerate(FEATURES):
            v = x[inside, f]
            for cut in np.unique(np.quantile(v, np.linspace(0, 1, cfg.cuts + 1)[1:-1])):
                high = inside & (x[:, f] > cut)
                for above, mask in ((True, high), (False, inside & ~high)):
                    q, m = int((mask & bad).sum()), int((mask & ~bad).sum())
                    if q and (gain := q * (np.log2(q / (q + m)) - before)) > best[0] + 1e-12:
                        best = (gain, (Condition(name, above, float(cut)), mask))
        if best[1] is None:
            break
        rule.append(best[1][0])
        inside = best[1][1]
    return rule


def prune(rule: list[Condition], x: np.ndarray, bad: np.ndarray) -> list[Condition]:
    """The beginning of the rule that is worth most on rows it wasn't grown from."""

    def worth(r: list[Condition]) -> float:
        mask = covered(r, x)
        p, n = int((mask & bad).sum()), int((mask & ~bad).sum())
        return (p - n) / (p + n) if p + n else -1.0

    ways = [rule[:k] for k in range(1, len(rule) + 1)]
    return max(ways, key=lambda r: (worth(r), -len(r))) if ways else rule


def learn(x: np.ndarray, bad: np.ndarray, cfg: Settings) -> list[list[Condition]]:
    """Ordered rules for the rows marked ``bad``. Every third row is kept for pruning."""
    rules: list[list[Condition]] = []
    for_pruning = np.arange(len(x)) % 3 == 2
    left = np.ones(len(x), bool)
    while len(rules) < cfg.most_rules:
        g, h = left & ~for_pruning, left & for_pruning
        if (g & bad).sum() < cfg.least_covered:
            break
        rule = prune(grow(x[g], bad[g], cfg), x[h], bad[h])
        if not rule:
            break
        mask = left & covered(rule, x)
        p, n = int((mask & bad).sum()), int((mask & ~bad).sum())
        if p < cfg.least_covered or p < cfg.least_precision * (p + n):
            break
        rules.append(rule)
        left &= ~mask
    return rules


def verdict(rules: list[list[Condition]]) -> Column:
    """The decision list: False for what the first matching rule rejects, otherwise True."""
    cases = F.when(F.lit(False), F.lit(False))
    for rule in rules:
        cases = cases.when(reduce(lambda a, b: a & b, [c.column() for c in rule]), F.lit(False))
    return cases.otherwise(F.lit(True))


def train(docs: DataFrame, labels: DataFrame, cfg: Settings | None = None) -> list[list[Condition]]:
    cfg = cfg or Settings()
    rows = labelled_texts(docs, labels.where(F.col("quality").isin(0, 1)), F.col("quality"), cfg.sample)
    got = statistics(rows).select("y", *FEATURES).collect()
    got.sort(key=lambda r: tuple(r))
    # A fixed shuffle, so that rows for growing and pruning are alike.
    got = [got[i] for i in np.random.default_rng(5).permutation(len(got))]
    x = np.array([[r[f] for f in FEATURES] for r in got], float).reshape(len(got), len(FEATURES))
    return learn(x, np.array([r.y == 0 for r in got], bool), cfg)


def judge(docs: DataFrame, rules: list[list[Condition]], text: str = "text") -> DataFrame:
    """``docs`` with statistics, ``base_failed`` and ``kept``."""
    return statistics(docs, text).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def judge_all(docs: DataFrame, labels: DataFrame) -> DataFrame:
    judged = judge(docs.select("doc_id", "text"), train(docs, labels))
    return judged.select("doc_id", *BASE_COLUMNS, "base_failed", "kept", *FEATURES)
