"""The training-data operators against brute force, library results, round trips and odd rows."""

import random

import brute
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from foliant.llm import ann_tree, html_text, jaccard_join, merge_dropout, mixing, pii, quality, rules, subword, token_counts, toxicity


def test_pii_spans(odd_docs, odd_rows, empty_docs):
    got = pii.find_all(odd_docs).collect()
    assert len(got) == len(odd_rows)
    text = {r[0]: r[1] for r in odd_rows}
    for r in got:
        want = brute.pii_row(text[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == want[:5]
        assert r.spans.startswith(want[5])
    assert pii.find_all(empty_docs).count() == 0


def test_pii_disclosing_terms(spark):
    """A name that always stands by one address gives it away; words that stand everywhere don't."""
    rows = [(i, f"word{i} other{i} please write to Zorbax at z@q.com soon about item{i}") for i in range(6)]
    rows += [(100 + i, f"please write soon about something else item{i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.find_all(docs).collect()}
    at = rows[0][1].index("Zorbax")
    assert f"term:{at}:{at + 6}" in got[0] and "please" not in got[100] and got[100] == ""
    clean = {r.doc_id: r.text for r in pii.sanitised(docs).collect()}
    assert "z@q.com" not in clean[0] and "Zorbax" not in clean[0] and "please write" in clean[0] and clean[100] == rows[6][1]


def test_pii_rare_entities(spark):
    """An entity of two texts, and one that a single text names again and again, are given away too."""
    rng = random.Random(11)
    filler = lambda n: " ".join(f"w{rng.randrange(40):02d}x" for _ in range(n))
    rows = [(i, f"{filler(4)} Zorbax z@q.com {filler(4)}") for i in range(2)]
    rows += [(2, " ".join(f"{filler(40)} Quillon q@q.com {filler(40)}" for _ in range(5)))]
    rows += [(100 + i, filler(60)) for i in range(200)]
    got = {r.doc_id: r for r in pii.find_all(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(f"term:{(at := text.index('Zorbax'))}:{at + 6}" in got[i].spans and got[i].n_terms == 1 for i, text in rows[:2])
    assert got[2].n_terms == rows[2][1].count("Quillon") == 5 and not any(got[i].n_terms for i, _ in rows[3:])


def test_pii_terms_of_whole_texts(spark):
    """Short names far from the address are found, and masked in texts without the address as well."""
    rng = random.Random(12)
    filler = lambda n: " ".join(f"w{rng.randrange(40):02d}x" for _ in range(n))
    rows = [(i, f"Li, {filler(60)} a@q.com {filler(60)} Li") for i in range(6)]
    rows += [(6, f"{filler(20)} (Li) {filler(20)}")] + [(100 + i, filler(60)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find_all(docs).collect()}
    clean = {r.doc_id: r.text for r in pii.sanitised(docs).collect()}
    assert len(clean) == len(rows) and all(clean[i] == text for i, text in rows[7:])
    for i, text in rows[:7]:
        assert got[i].n_terms == text.count("Li") and "Li" not in clean[i] and (got[i].n_email, "a@q.com" in clean[i]) == (int(i < 6), False)
        spans = [x.split(":") for x in got[i].spans.split(",") if not x.startswith("email")]
        assert all(text[int(a) : int(b)] == "Li" for _, a, b in spans)


def test_quality(odd_docs, labels, empty_docs):
    got = quality.score_all(odd_docs.withColumn("score", F.lit("x")), labels).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert quality.score_all(empty_docs, labels).count() == 0


def test_quality_learns(spark):
    rng = random.Random(1)
    word = lambda p: p + "".join(rng.choice("abcdef") for _ in range(4))
    rows = [(i, " ".join(word("zz" if i % 2 else "k") for _ in range(30))) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(240)], "doc_id long, quality int")
    held = [r for r in quality.score_all(docs, labels).collect() if r.held_out]
    assert held and all((r.score > 0.5) == bool(r.doc_id % 2) for r in held)


def test_subword_without_rows():
    model = subword.fit([], [], np.zeros(0, np.int64), 2, subword.Settings())
    assert np.allclose(model.probabilities([None, "abc"])[:, 1], 0.5, atol=0.05)


def test_toxicity(spark, odd_docs, labels, empty_docs):
    rng = random.Random(2)
    rows = [(i, " ".join(["calm words here"] + [f"w{rng.randrange(300)}" for _ in range(20)] + ["idiot scum"] * (i % 4 == 0))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int")
    got = toxicity.score_all(docs, marks).where("doc_id >= 200").collect()
    assert all(r.toxic == (r.doc_id % 4 == 0) for r in got) and all(0 <= r.expected_severity <= 3 for r in got)
    assert toxicity.score_all(odd_docs, labels).count() == odd_docs.count() and toxicity.score_all(empty_docs, labels).count() == 0


def test_mixing(spark, odd_docs, labels, empty_docs):
    points = spark.createDataFrame([(100, 1.0, 0.0), (100, 0.9, 0.1), (50, 0.0, 1.0)], "n_tokens long, p_x double, p_y double")
    found = mixing.fit(points, {"x": 0.5, "y": 0.5})
    totals = points.withColumn("r", found.rate()).agg(F.sum(F.expr("n_tokens * r * p_x")).alias("x"), F.sum(F.expr("n_tokens * r * p_y")).alias("y"), F.min("r").alias("m")).first()
    assert abs(totals.x - totals.y) < 1e-3 and totals.m >= 1 - 1e-9
    tight = mixing.fit(points, {"x": 0.05, "y": 0.95}, total=100.0)
    assert points.select(F.min(tight.rate()).alias("m")).first().m >= 0
    assert mixing.mix_all(odd_docs, labels).count() == odd_docs.count() and mixing.mix_all(empty_docs, labels).count() == 0
    assert {r.doc_id for r in mixing.mixed(odd_docs, labels).select("doc_id").collect()} == {r.doc_id for r in odd_docs.select("doc_id").collect()}


def test_token_counts_at_every_prefix():
    from tokenizers import Tokenizer

    path = token_counts.vocabulary_path()
    own, lib = token_counts.PrefixCounter(path), Tokenizer.from_file(path)
    rng = random.Random(3)
    texts = ["a   b", "we'll they're !'s  'll", "<|endoftext|> a<|endoft", "²½１２ 漢字　x", "\x1c\x85b", "🙂 it's", "x" * 200, ""] + ["".join(rng.choice(" \n'abrevlst.12é漢") for _ in range(30)) for _ in range(60)]
    for t in texts:
        want = [len(lib.encode(t[:k], add_special_tokens=False).ids) for k in range(len(t) + 1)]
        assert own.prefix_counts(t) == want and own.count(t) == want[-1]
        cut = own.truncate(t, 5)
        assert want[len(cut)] <= 5 and all(w > 5 for w in want[len(cut) + 1 :])


def test_token_count_rows(odd_docs, odd_rows):
    got = token_counts.count_all(odd_docs).collect()
    assert sorted(r.n_bytes for r in got) == sorted(len((t or "").encode()) for _, t, *_ in odd_rows) and all(r.over_limit == (r.n_tokens > 1024) for r in got)


def test_jaccard(odd_docs, odd_rows, empty_docs, spark):
    text = {r[0]: r[1] for r in odd_rows if r[0] is not None}
    want = brute.components(text)
    got = jaccard_join.join(odd_docs).collect()
    assert len(got) == len(odd_rows)
    for r in got:
        assert (r.n_shingles, r.component_id) == (want[r.doc_id] if r.doc_id is not None else want[1])
    assert jaccard_join.join(empty_docs).count() == 0
    kept = sorted(r.doc_id for r in jaccard_join.keep_one(odd_docs).collect())
    assert kept == sorted(d for d, (n, c) in want.items() if c == d or n == 0)


def test_jaccard_near_copies(spark):
    """Edited copies of a few texts and a passage that all texts share."""
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(30)]
    texts = {}
    for b in range(6):
        base = [f"w{b}x{rng.randrange(10**6)}" for _ in range(60)]
        for c in range(12):
            words = list(base)
            for _ in range(rng.randrange(4)):
                words[rng.randrange(60)] = f"e{rng.randrange(10**6)}"
            texts[b * 12 + c] = " ".join(passage + words)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    cfg = jaccard_join.Settings(batch_frequent=4, frequent=20, block=8, crowded=6)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(df, cfg).collect()} == brute.components(texts)


def _sets(*sets):
    return jaccard_join.Sets(np.concatenate(sets), np.cumsum([0, *map(len, sets)]))


def test_signatures_are_shared():
    """Sets that differ as much as a link may share signatures, as many as their band's, and their sketches let them pass."""
    rng, cfg = np.random.default_rng(5), jaccard_join.Settings()
    for size in (1, 3, 4, 5, 6, 7, 9, 12, 20, 57, 200, 900):
        linked = 0
        for _ in range(60):
            s = np.unique(rng.integers(0, 2**63, size).astype(np.uint64) * np.uint64(2))
            drop, add = rng.integers(0, len(s) // 4 + 1, 2).tolist()
            t = np.unique(np.concatenate([s[drop:], rng.integers(0, 2**63, add).astype(np.uint64) * np.uint64(2)]))
            inter = len(np.intersect1d(s, t))
            both = _sets(s, t)
            if 100 * inter < 75 * (len(s) + len(t) - inter) or len(set(both.classes().tolist())) == 1:
                continue
            linked += 1
            # A frequent passage is left out of both sets, or of a large part of them.
            for rest in (both, both.only(both.items % np.uint64(10) > 1), both.only(both.items % np.uint64(10) > 7)):
                sig, own, mark, marked = jaccard_join.signatures(both, rest, cfg)
                shared = np.intersect1d(sig[own >> 1 == 0], sig[own >> 1 == 1])
                if len(mark) == 0:
                    i = max(jaccard_join.band(min(len(s), len(t))), jaccard_join.band(max(len(s), len(t))) - 1)
                    assert len(shared) >= jaccard_join.spare(i, cfg.spare)
                assert len(shared)
            # With nothing but their first shingles, too.
            sig, own, _, _ = jaccard_join.signatures(both, both, jaccard_join.Settings(cuttings=0))
            assert len(np.intersect1d(sig[own >> 1 == 0], sig[own >> 1 == 1]))
            raw, bounds = both.sketches()
            sketches = jaccard_join.Sketched([pa.array([raw[a:b].tobytes() for a, b in zip(bounds, bounds[1:])])], both.sizes)
            assert sketches.may_link(np.array([0]), np.array([1]))[0]
        assert linked or size < 4


def test_shingle_sets():
    rng = random.Random(13)
    texts = ["", None, "a", "A b", "a b c d", "A b\tc D e", "é ü x É z w", "\n  \t", "x" * 3000000 + " y"] + [" ".join(rng.choice("abcdE") for _ in range(rng.randrange(30))) for _ in range(200)]
    sets = jaccard_join.shingle_sets(pa.array(texts))
    assert sets.sizes.tolist() == [len(brute.shingles(t)) for t in texts]
    part = jaccard_join.shingle_sets(pa.array(texts).slice(9, 40))
    assert all((part[i] == sets[9 + i]).all() for i in range(40))
    same = {}
    for i, t in enumerate(texts):
        assert same.setdefault(brute.shingles(t), sets.classes()[i]) == sets.classes()[i]
    assert len(same) == len(set(sets.classes().tolist()))


def test_keep_one_decides_by_row(spark):
    """Null ids, repeated ids, repeated rows and clashing column names."""
    base = " ".join(f"w{i}" for i in range(60))
    near, other = base.replace("w30", "x30"), " ".join(f"v{i}" for i in range(40))
    rows = [(1, base, "a"), (None, base, "b"), (5, near, "c"), (5, other, "d"), (5, other, "d"), (None, "q r s", "e"), (None, "q r s", "f"), (7, None, "g"), (7, "", "h"), (7, None, "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, cls string").withColumn("label", F.lit(1)).withColumn("n_shingles", F.lit("x"))
    got = jaccard_join.keep_one(docs)
    assert got.columns == docs.columns
    kept = sorted(got.select("doc_id", "text", "cls").collect(), key=str)
    kept = [tuple(r) for r in kept]
    assert sum(t == "q r s" for _, t, _ in kept) == 1
    assert sorted((r for r in kept if r[1] != "q r s"), key=str) == sorted([(1, base, "a"), (5, other, "d"), (7, None, "g"), (7, "", "h"), (7, None, "g")], key=str)
    joined = {(r.doc_id, r.n_shingles): r.component_id for r in jaccard_join.join(docs).collect()}
    assert joined == {(1, 56): 1, (None, 56): 1, (5, 56): 1, (5, 36): 5, (None, 1): None, (7, 0): 7}


def test_bitmap(spark):
    x = [0, 1, 5, 32767, 32768, 32769, 65536, (1 << 23) - 1, -3]
    bits = jaccard_join.bitmap(spark.createDataFrame([(v,) for v in x], "x long"), "x", 23)
    assert jaccard_join.in_bitmap(np.array(x, np.int64).astype(np.uint64), bits, 23).all()
    assert not jaccard_join.in_bitmap(np.array([2, 7, 40000], np.uint64), bits, 23).any()


def test_html():
    page = '<html><head><title>T &amp; x</title><style>p{}</style></head><body><p>Hello <b>big</b>\n world<p>two<br>three<ul><li>a<li>b<ol start=3><li>x</ol></ul><table><tr><th>Name<th>Qty<tr><td>Apple pie<td>3<tr><td>B<td>12</table><div style="display: none">no</div><span hidden>no</span><pre>a\n  b</pre>end<script>var x="</p>"</script><!-- c --> &lt;ok&gt;'
    want = "Hello big world\n\ntwo\nthree\n\n- a\n- b\n  3. x\n\nName       Qty\nApple pie  3\nB          12\n\na\n  b\n\nend <ok>"
    assert html_text.extract(page) == (want, "T & x")
    assert html_text.extract(None) == ("", None) and html_text.extract("plain") == ("plain", None)
    assert html_text.extract("<div>" * 5000 + "deep")[0] == "deep" and html_text.extract("<table><tr><td>" * 300 + "x")[0] == "x"
    assert html_text.extract("a<!-- open")[0] == "a"


def test_html_tables(spark):
    show = lambda page: html_text.extract(page)[0]
    assert show("<table><tr><td rowspan=2>A</td><td>b</tr><tr><td>c</tr></table>") == "A  b\n   c"
    assert show("<table><tr><td colspan=1000>wide</td><td>x</tr><tr><td>a<td>b</table>") == "wide  x\na  b"
    assert show("<table><tr><td rowspan=0>A<td data-x='colspan=5'>b<td>c</tr><tr><td>d<td>e</tr></table>") == "A  b  c\n   d  e"
    deep = show("<table><tr><td>" * 14 + "deep<td>two</table><p>x" )
    assert deep.split("\n")[0] == "deep  two" and "x" in deep
    assert show("<table><tr><td><div>" * 400 + "deep") == "deep"
    assert show("") == "" and html_text.extract_all(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_rows(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a"), (2, None, None), (2, None, None)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    assert sorted(r.text for r in html_text.extracted(pages).collect()) == ["", "", "a"]


def test_ann(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(900, 8)), np.ones((60, 8))]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2100, [0.0] * 8), (2200, [float("nan")] * 8), (2300, [None] * 8), (2400, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann_tree.search_all(df).collect()
    hits = 0
    for q in range(0, 960, 100):
        gap = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        gap[q] = np.inf
        want = np.lexsort((np.arange(len(x)), gap))[:10]
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [m[0] for m in mine] == list(range(1, 11)) and all(abs(m[2] - gap[m[1]]) < 1e-9 for m in mine)
        hits += len({m[1] for m in mine} & set(want.tolist()))
        if q == 900:
            assert [m[1] for m in mine] == want.tolist()
    assert hits >= 90 and {r.query_id for r in got} == set(range(0, 960, 100))
    assert ann_tree.search_all(df.limit(0)).count() == 0


def test_ann_ties_go_to_smaller_ids(spark):
    """Different vectors at one distance, in a single leaf and in many, with a clashing column."""
    one_hot = [(i, [1.0 if k == i else 0.0 for k in range(24)]) for i in range(24)]
    df = spark.createDataFrame([(r[0] * 100, r[1]) for r in one_hot], "vec_id long, embedding array<float>").withColumn("score", F.lit("x")).withColumn("rank", F.lit("y"))
    got = ann_tree.search_all(df).collect()
    for q in range(24):
        mine = [r.vec_id for r in sorted((r for r in got if r.query_id == q * 100), key=lambda r: r.rank)]
        assert mine == [i * 100 for i in range(24) if i != q][:10]


def test_rules(odd_docs, odd_rows, labels, empty_docs):
    rng = random.Random(7)
    for t in [r[1] for r in odd_rows] + ["".join(rng.choice("ab \n\t#") for _ in range(80)) for _ in range(200)]:
        assert rules.measure(t)[:5] == brute.rule_counts(t)
    got = rules.judge_all(odd_docs, labels).collect()
    assert len(got) == len(odd_rows) and not any(r.kept and r.base_failed for r in got)
    assert rules.judge_all(empty_docs, labels).count() == 0


def test_rules_are_found():
    rng = np.random.default_rng(8)
    x = rng.random((600, len(rules.FEATURES)))
    bad = (x[:, 1] > 0.7) | ((x[:, 3] > 0.5) & (x[:, 4] > 0.6))
    learned = rules.learn(x, bad, rules.Settings())
    caught = np.logical_or.reduce([rules.covered(r, x) for r in learned])
    assert (caught == bad).mean() > 0.95


def test_merge_dropout(odd_docs, odd_rows, empty_docs):
    """Rate 0 is the library; other rates are the brute-force agenda, for long parts too, and decode losslessly."""
    import sentencepiece
    import xxhash

    path = merge_dropout.vocabulary_path()
    lib, own = sentencepiece.SentencePieceProcessor(model_file=path), merge_dropout.Pieces(path)
    rng = random.Random(9)
    texts = ["", "  a  b ", "🙂漢字\x00\n\t ", "a" * 300, "Hello, world. It's e.g. 12,5!", "ab" * 200 + " the end", "x"] + ["".join(rng.choice("ab  \n🙂é漢09.,") for _ in range(30)) for _ in range(100)]
    assert all(own.encode(t, 0.0, 1, 0).tolist() == lib.encode(t) for t in texts)
    for rate in (0.1, 0.5, 1.0):
        ids, n = own.encode_all([*texts, None], rate, 7, list(range(len(texts) + 1)))
        at = np.concatenate([[0], np.cumsum(n)])
        for k, t in enumerate(texts):
            mine = ids[at[k] : at[k + 1]]
            assert mine.tolist() == brute.merge_dropout(t, own.ids, own.rank, own.byte, rate, xxhash.xxh3_64_intdigest(str(k).encode(), 7))
            assert own.decode(mine) == t and lib.decode(mine.tolist()) == t
        assert n[-1] == 0 and [x.decode() for x in own.decode_all(ids, n)] == [*texts, ""]
    clash = odd_docs.withColumn("token_ids", F.lit("x")).withColumn("n_tokens", F.lit("x"))
    got = merge_dropout.encoded(clash).collect()
    assert len(got) == len(odd_rows) and all(r.lossless and r.n_tokens == len(r.token_ids) for r in got)
    assert merge_dropout.encode_all(empty_docs).count() == 0 and merge_dropout.encode_stage(odd_docs).count() == len(odd_rows)


def test_merge_dropout_varies_every_occurrence(spark):
    """One word has many cuttings within a document and over documents."""
    docs = spark.createDataFrame([(i, "segmentation " * 40) for i in range(20)], "doc_id long, text string")
    rows = merge_dropout.encoded(docs, rate=0.3).collect()
    assert all(r.lossless for r in rows) and len({tuple(r.token_ids) for r in rows}) == 20
    own = merge_dropout.Pieces(merge_dropout.vocabulary_path())
    words = [own.encode("segmentation", 0.3, 1, d).tobytes() for d in range(200)]
    plain = own.encode("segmentation", 0.0, 1, 0).tobytes()
    assert len(set(words)) > 10 and 0 < words.count(plain) < 200
    assert [own.encode("segmentation", 0.3, 1, d).tobytes() for d in range(200)] == words


def test_html_shows_all_visible_text():
    show = lambda page: html_text.extract(page)[0]
    for attr in ('class="hidden md:block"', 'title="the hidden truth"', 'data-x="display:none"', "class='menu hidden open'"):
        assert show(f"a <span {attr}>b</span> c") == "a b c"
    for attr in ("hidden", 'HIDDEN=""', "style='color: red; display : none'", 'style="visibility:hidden"'):
        assert show(f"a <span {attr}>b</span> c") == "a c"
    assert show("a <select><option>x<option selected>y<option>z</select> b") == "a y b" and show("<select><optgroup><option>x</option></optgroup><option>z</select>") == "x"
    assert show("a <math><mi>q</mi></math> <svg><path d='1'/><text>t</text></svg> <object>f</object> <textarea>g &amp; h</textarea> b") == "a q t f g & h b"


def test_pii_many_spans_and_clashing_columns(spark):
    """Spans over several runs, overlaps, and columns named like inner ones."""
    text = " ".join(f"é{i}@b.com +1 555 {1000000 + i}" for i in range(700)) + " end 10.0.0.1"
    docs = spark.createDataFrame([(1, text, "k1", "s"), (2, None, "k2", "t"), (3, "call a@b.com", "k3", "u")], "doc_id long, text string, key string, spans string").withColumns({"row": F.lit("r"), "new": F.lit("n"), "term_spans": F.lit(1), "kinds": F.lit("q"), "n_chars": F.lit(5)})
    got = {r.doc_id: r for r in pii.find_all(docs).collect()}
    assert (got[1].n_email, got[1].n_phone, got[1].n_ip, got[1].base_sha256) == (*(brute.pii_row(text)[k] for k in (0, 3, 1)), brute.pii_row(text)[4])
    clean = pii.sanitised(docs)
    assert clean.columns == docs.columns
    rows = {r.doc_id: r for r in clean.collect()}
    assert (rows[1].key, rows[1].spans, rows[1].row, rows[1].new, rows[1].term_spans, rows[1].kinds) == ("k1", "s", "r", "n", 1, "q") and rows[2].text is None and rows[2].n_chars == 5
    assert rows[1].text.count("[EMAIL]") == rows[1].text.count("[PHONE]") == 700 and "@" not in rows[1].text and rows[1].text.endswith("[IP]") and rows[1].n_chars == len(rows[1].text)


def test_pii_common_entities_disclose_little(spark):
    """Words beside an address that nearly all texts hold tell nothing of it."""
    rows = [(i, f"please write to office@q.com no {i} soon and more of it late") for i in range(90)] + [(100 + i, f"other words {i} here") for i in range(10)]
    assert all(r.n_terms == 0 for r in pii.find_all(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_pii_near_copies_are_one_context(spark):
    """Rare words of a text that was copied and edited elsewhere are no evidence against its address."""
    rng = random.Random(14)
    filler = lambda n: " ".join(f"w{rng.randrange(40):02d}x" for _ in range(n))
    tail = [f"rare{k}" for k in range(30)]
    head = f"{filler(30)} a@q.com {filler(30)}"
    rows = [(i, f"{head} {' '.join(tail[:i] + [f'edit{i}'] + tail[i:])}") for i in range(6)] + [(100 + i, filler(60)) for i in range(300)] + [(900, filler(30) + " rare7")]
    got = {r.doc_id: r for r in pii.find_all(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[900].n_terms == 0
