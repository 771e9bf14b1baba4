"""Sets that no cutting serves, and token counts of prefixes that end within special strings."""

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import jaccard_join, token_counts


def test_few_sets_are_marked():
    rng = np.random.default_rng(9)
    for size in (5, 9, 12, 20, 26, 28, 30, 32, 34, 40, 60):
        items = [np.sort(rng.integers(0, 2**63, size).astype(np.uint64)) for _ in range(3000)]
        sets = jaccard_join.Sets(np.concatenate(items), np.arange(3001) * size)
        _, _, mark, _ = jaccard_join.signatures(sets, sets, jaccard_join.Settings())
        assert len(mark) <= (30 if size >= 26 else 300), (size, len(mark))


def test_unrelated_texts_deal_no_blocks(spark):
    """20,000 texts of 30 to 38 words that share nothing: but for a few equal 32-bit hashes no group holds two of them."""
    word = lambda j: F.concat(F.lit("w"), F.pmod(F.xxhash64("doc_id", F.lit(j)), F.lit(10**9)).cast("string"))
    docs = spark.range(20_000).select(F.col("id").alias("doc_id")).withColumn("n", F.pmod(F.hash("doc_id"), F.lit(9)) + 30)
    docs = docs.select("doc_id", F.array_join(F.slice(F.array(*[word(j) for j in range(38)]), F.lit(1), F.col("n")), " ").alias("text"))
    cfg = jaccard_join.Settings()
    rows = jaccard_join.survey(docs, cfg)
    sizes = rows.select("cls", "n_shingles").distinct()
    signed = jaccard_join.sign(docs, np.zeros(((1 << cfg.bitmap_bits) // 32768 + 2) * 4096, np.uint8), 8, cfg)
    found = jaccard_join.groups(signed, sizes, cfg).groupBy("gid").count().collect()
    assert len(found) < 100 and all(r["count"] == 2 for r in found)


@pytest.mark.parametrize("cuttings", [0, 1])
def test_first_shingles_alone_lose_no_link(spark, cuttings):
    rng = random.Random(11)
    texts = {}
    for b in range(12):
        base = [f"w{b}x{rng.randrange(10**6)}" for _ in range(rng.randrange(6, 45))]
        for c in range(6):
            words = [w if rng.random() > 0.02 else f"e{rng.randrange(10**6)}" for w in base] + ["tail"] * rng.randrange(2)
            texts[b * 6 + c] = " ".join(words)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    cfg = jaccard_join.Settings(cuttings=cuttings, block=8, crowded=6)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(df, cfg).collect()} == brute.components(texts)


def test_prefixes_that_end_within_special_strings():
    from tokenizers import Tokenizer

    path = token_counts.vocabulary_path()
    own, lib = token_counts.PrefixCounter(path), Tokenizer.from_file(path)
    rng = random.Random(12)
    parts = ["<|endoftext|>", "<|endoftext|>", "<|endof", " ", "  ", "\n", "see", " a", "'ll", "<", "|", "é", "1 2", "x  "]
    texts = ["see <|endoftext|>", "<|endoftext|><|endoftext|>", "a  <|endoftext|>  b"] + ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 6))) for _ in range(1500)]
    for t in texts:
        want = [len(lib.encode(t[:k], add_special_tokens=False).ids) for k in range(len(t) + 1)]
        assert own.prefix_counts(t) == want, t
        assert own.truncate(t, 2) == t[: max(k for k, n in enumerate(want) if n <= 2)]
