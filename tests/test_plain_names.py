"""Short cuts past cleaning patterns, and patterns on the documents that count only."""

import random

from pyspark.sql import functions as F

from foliant.functions import extract, text
from foliant.plans import registry

SF = "/root/testdata/sf0.001"
BITS = ["A", "b", "Z9", " ", "  ", "#", ".", "-", "--", "&", "'", "*", "**", "_", "__", "`", "\t", ":", ";", ",", "é", "　", "\r", "x.y"]


def names(spark, n=4000):
    rng = random.Random(3)
    rows = [("".join(rng.choice(BITS) for _ in range(rng.randrange(0, 7))),) for _ in range(n)]
    return spark.createDataFrame([*rows, (None,), ("",), ("A\n",), ("a b " * 30_000 + "c",)], "t string")


def test_plain_names_are_left_alone(spark):
    t = F.col("t")
    whole = extract.filled(extract.clean_client(extract.filled(text.strip(t))))
    plain = t.rlike(extract.PLAIN_NAME) & ~F.contains(t, F.lit("  "))
    r = names(spark).agg(F.count_if(~whole.eqNullSafe(extract.client_of(t))).alias("off"), F.count_if(plain).alias("plain"), F.count_if(whole.isNotNull() & (whole != t)).alias("cleaned")).first()
    assert r.off == 0 and r.plain > 100 and r.cleaned > 100


def test_parts_of_words():
    for word in ("expense", "subject:", "estimate", "po", "to:", "invoice", "a"):
        part = extract.rare_part(word)
        assert word.endswith(part) and len(part) >= min(len(word), 3)
    assert (extract.rare_part("expense"), extract.rare_part("invoice"), extract.rare_part("po")) == ("xpense", "voice", "po")


def test_titles(spark):
    """The first line of more than eight characters of twenty, whichever it is."""
    cases = {"Quotation 1\nb": "Quotation 1", "short\n  a longer line \nx": "a longer line", " \n" * 20 + "beyond the limit": "f x", "": "f x", "  123456789  ": "123456789", "\n\nnine chars": "nine chars", "eight ch\nlonger than eight": "longer than eight"}
    got = spark.createDataFrame([(k, v) for k, v in [*cases.items(), (None, "f x")]], "t string, want string").select("want", text.guess_title(F.col("t"), F.lit("d/f_x.txt")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_local_evidence_runs_patterns_on_first_documents_only(spark):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    found = registry.queries()["local_evidence"](spark, SF)
    lines = found._jdf.queryExecution().executedPlan().toString().splitlines()
    spark.conf.set("spark.sql.adaptive.enabled", before)
    # Above stands what runs later: references and dates after the last window that numbers documents.
    numbered = max(n for n, line in enumerate(lines) if "row_number()" in line)
    assert max(n for n, line in enumerate(lines) if "regexp_extract_all" in line) < numbered
    assert found.count() > 0
