"""Quality rules, tokenizing, language identification, extraction and scores against plain versions."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracefold.llm import bilinear_lm, html_main_text, language_id, quality_rules
from tracefold.llm import queries as Q
from tracefold.llm import sentencepiece_codec as sp

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, kept int, bucket string"
WS = " \t\n\x0b\x0c\r"


def words(text, lower=False):
    raw = text or ""
    if lower:
        raw = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in raw)
    out, own = [], ""
    for c in raw + " ":
        if c in WS:
            if own:
                out.append(own)
            own = ""
        else:
            own += c
    return out


def table(spark, rows):
    """Documents with extra columns whose names clash with those used inside."""
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), "x", 1, "y") for i, t, lang, s in rows], DOCS)


ODD = [
    (0, None, None, None), (1, "", "en", "a"), (2, "   \n \t", "en", "a"), (3, "one", "en", "a"), (4, "A b c\nA b c\n\nA b c", "de", "a"),
    (5, "x " * 30, "de", None), (5, "x " * 30, "de", None), (6, "nbsp stays one word # * $", "en", "b"), (None, "no id here at all", "en", "b"),
    (7, "é" * 50 + " " + "w " * 3000, "fr", "b"),
]


def base(text):
    own = words(text)
    windows = [tuple(own[k : k + 8]) for k in range(len(own) - 7)]
    n = Counter(windows)
    inside = {k + j for k, w in enumerate(windows) if n[w] > 1 for j in range(8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(own), sum(map(len, own)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(inside)


def test_quality_base_matches_brute_force(spark, sf):
    docs = table(spark, ODD).unionByName(Q.read(spark, sf, "documents"), allowMissingColumns=True)
    got = quality_rules.quality_verdicts(docs).toPandas()
    want = Counter((None if r.doc_id is None else r.doc_id, *base(r.text)) for r in docs.collect())
    found = Counter((None if x != x else int(x), *map(int, r)) for x, *r in got[["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]].itertuples(index=False))
    assert found == want
    failed = (got.n_words < 20) | (100 * got.n_repeat_words > 30 * got.n_words)
    assert (got.base_failed == failed).all() and not got[got.base_failed].kept.any()


def test_frequent_lines_reject_depleted_documents(spark):
    rng = random.Random(1)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    foot = ["footer " + fresh(11) for _ in range(6)]
    rows = [(k, fresh(60) + "\n" + foot[0].upper(), "en", "hot") for k in range(40)]
    rows += [(100 + k, fresh(4) + "\n" + "\n".join(foot), "en", "hot") for k in range(30)]
    rows += [(200 + k, "an exact copy " + "of many other words " * 2 + " ".join(map(str, range(30))), "en", "hot") for k in range(50)]
    rows += [(300, fresh(4) + "\n" + "\n".join(foot), "en", "other")]
    got = quality_rules.quality_verdicts(table(spark, rows), with_frequent_lines=True, min_docs=20).toPandas().set_index("doc_id").sort_index()
    assert got.loc[:39].kept.all() and (got.loc[:39].words_left == 60).all()
    assert not got.loc[100:129].kept.any()
    assert got.loc[200:249].kept.all(), "exact copies count as one document"
    assert got.loc[300].kept, "lines count within a host"
    judged = quality_rules.quality_verdicts(table(spark, rows), carry=("text", "source"), with_frequent_lines=True)
    cleaned = quality_rules.remove_lines(judged, "text", "source", "frequent_lines").toPandas().set_index("doc_id").sort_index()
    assert "footer" not in cleaned.loc[0].text.lower() and len(words(cleaned.loc[0].text)) == 60


def test_long_frequent_lines_count(spark):
    rng = random.Random(4)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    passage = "passage " + fresh(59)
    rows = [(k, fresh(60) + "\n" + passage.upper(), "en", "hot") for k in range(30)]
    rows += [(100 + k, fresh(20) + "\n" + passage, "en", "hot") for k in range(5)]
    rows += [(200 + k, fresh(60) + "\n" + passage, "en", "other") for k in range(5)]
    judged = quality_rules.quality_verdicts(table(spark, rows), carry=("text", "source"), with_frequent_lines=True, min_docs=20)
    got = judged.toPandas().set_index("doc_id").sort_index()
    assert got.loc[:29].kept.all() and (got.loc[:29].words_left == 60).all()
    assert not got.loc[100:104].kept.any(), "20 of 80 words left"
    assert got.loc[200:204].kept.all() and (got.loc[200:204].words_left == 120).all(), "under the limit of its host"
    cleaned = quality_rules.remove_lines(judged, "text", "source", "frequent_lines").toPandas().set_index("doc_id").sort_index()
    assert "passage" not in cleaned.loc[0].text.lower() and len(words(cleaned.loc[0].text)) == 60


def test_sentencepiece_is_exact(spark, sf):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    lib, codec = sentencepiece.SentencePieceProcessor(model_file=path), sp.Codec(path)
    rng = random.Random(5)
    texts = ["", " ", "  a  b ", "▁ ▁x", "\n\n", "<s></s><0x0A>", "=" * 200, " " * 60 + "x", "a" * 500, None]
    texts += ["".join(rng.choice("abcdeéàß ▁ \n\t\r\x00漢字😀   aaAA..--01") for _ in range(rng.randrange(60))) for _ in range(1500)]
    ids = codec.encode(texts)
    want = lib.encode([t or "" for t in texts])
    assert [x.tolist() for x in ids] == want
    assert codec.decode(ids) == [lib.decode(x) for x in want]
    docs = table(spark, ODD).unionByName(Q.read(spark, sf, "documents"), allowMissingColumns=True)
    got = Counter(map(tuple, sp.digest_documents(docs, path).collect()))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = Counter()
    for r in docs.collect():
        own = lib.encode(r.text or "", add_eos=True)
        want[(r.doc_id, len(own), sha(" ".join(map(str, own))), sha(lib.decode(own)))] += 1
    assert got == want
    whole = sp.encode_documents(docs.filter("doc_id = 4").limit(1), path).first()
    assert whole.ids[-1] == 2 and whole.decoded


def test_serial_merges_agree():
    import public_tokenizers

    vocab = sp.Vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    units = [" intentionally", "aaaaaaaaaa", "    x", " abababab", "======", " Übergröße"]
    rng = random.Random(7)
    units += ["".join(rng.choice("abehlnorst=-.") for _ in range(rng.randrange(1, 40))) for _ in range(800)]
    units += ["".join(rng.choice(["ab", "=", "--", "er", "an", "the"]) * rng.randrange(1, 9) for _ in range(4)) for _ in range(400)]
    a, b = sp.merge_rounds(vocab, units), [sp.merge_singly(vocab, u) for u in units]
    assert [x.tolist() for x in a] == b


def test_long_text_without_spaces():
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    rng = random.Random(8)
    text = "".join(rng.choice("ABCDEFabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(60_000))
    assert sp.Codec(path).encode([text])[0].tolist() == sentencepiece.SentencePieceProcessor(model_file=path).encode(text)


def test_language_held_out_accuracy_and_rejection(spark):
    got = Q.op5_language_id(spark, "/root/testdata/sf0.01").toPandas()
    docs = Q.read(spark, "/root/testdata/sf0.01", "documents").toPandas()
    both = got.merge(docs, on="doc_id")
    held = both[both.held_out]
    assert len(both) == len(docs) and (held.lang == held.lang_pred).mean() > 0.98
    assert both.score.between(0, 1).all() and both.rejected.mean() < 0.01
    model = language_id.fit(Q.read(spark, "/root/testdata/sf0.01", "documents"), F.lit(True), per_lang=100)
    assert model.predict(["кириллица совсем другой язык " * 20])[2][0], "far from every centroid"
    odd = language_id.identify(table(spark, ODD), model).toPandas()
    assert len(odd) == len(ODD) and (odd.lang_pred[[0, 1, 2]] == "und").all() and (odd.score[[0, 1, 2]] == 0).all()


def test_language_rejects_very_long_foreign_text():
    rng = random.Random(6)
    spoken = [f"{a}{b}" for a in ("the", "and", "with", "for", "from") for b in ("", "se", "m", "ing", "er", "out")]
    known = lambda n: " ".join(rng.choice(spoken) for _ in range(n))
    counts, letters = language_id.ngram_counts([known(60) for _ in range(50)])
    model = language_id.CentroidModel(counts.astype(np.float32), letters, ["en"] * 50)
    odd = lambda n: " ".join("".join(rng.choice("жщыюяцфъ") for _ in range(6)) for _ in range(n))
    assert model.predict([odd(60), odd(20_000)])[2].all(), "no text of this length was learnt from"
    assert not model.predict([known(60), known(20_000)])[2].any()


def test_language_without_learning_rows(spark):
    empty = table(spark, [])
    model = language_id.fit(empty, F.lit(True))
    assert language_id.identify(empty, model).count() == 0
    assert set(language_id.identify(table(spark, ODD), model).toPandas().lang_pred) == {"und"}


def lm_parts(docs, learn, **options):
    marked = docs.withColumn("_learn", learn)
    listed = bilinear_lm.list_words(bilinear_lm.count_words(marked, "_learn", "text")[0], **options)
    return listed, bilinear_lm.encode(marked, listed, "_learn", bucket_tokens=20_000)


def log_softmax(x):
    return [y - max(x) - math.log(sum(math.exp(z - max(x)) for z in x)) for y in x]


def plain_score(model, listed, counts, own):
    """The score of a list of words (the end among them) by plain sums over the model's arrays."""
    codes = {w: k for k, w in enumerate(listed.words)}
    code = lambda w: codes.get(w.encode(), len(codes) + bilinear_lm.rest_class(w.encode()))
    context, output, inner, weights = (np.float64(getattr(model, p)) for p in ("context", "output", "word_output", "weights"))
    group_of = {k: g for g, (a, b) in enumerate(zip(listed.edges, listed.edges[1:], strict=False)) for k in range(a, b)}
    total, before = 0.0, [listed.start, listed.start]
    for w in own:
        k = code(w)
        guess = context[before[1]] * weights[0] + context[before[0]] * weights[1]
        classes = log_softmax([guess @ q[:-1] + q[-1] for q in output])
        if k < listed.singles:
            found = classes[k]
        elif k in group_of:
            a, b = listed.edges[group_of[k]], listed.edges[group_of[k] + 1]
            found = classes[listed.singles + group_of[k]] + log_softmax([guess @ q[:-1] + q[-1] for q in inner[a:b]])[k - a]
        else:
            r = k - len(codes)
            found = classes[listed.singles + len(listed.edges) - 1 + r] + math.log((counts[w] + 0.5) / (listed.rest_n[r] + 0.5 * (listed.rest_v[r] + 1)))
        total += found / math.log(10)
        before = [before[1], k]
    return total


def test_lm_matches_a_plain_version(spark, sf):
    docs = Q.read(spark, sf, "documents").unionByName(spark.createDataFrame([(10**6, None), (10**6 + 1, ""), (10**6 + 2, "the the zzzz"), (10**6 + 2, "the the zzzz")], "doc_id long, text string"), allowMissingColumns=True)
    learn = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1, F.lit(True))
    listed, coded = lm_parts(docs, learn, min_count=6, singles=20, groups=9)
    assert len(listed.edges) == 10 and (np.diff(listed.edges) > 2).all() and listed.rest_v.min() > 0
    model = bilinear_lm.fit(coded, listed, shard_docs=50)
    found = bilinear_lm.score(coded, model, listed).collect()
    rows = docs.collect()
    c = Counter()
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 5 != 1:
            c.update([*words(r.text, True), "\n"])
    n, v = sum(c.values()), len(c)
    assert (listed.total, listed.distinct) == (n, v) and all(c[w.decode()] == k for w, k in zip(listed.words, listed.counts, strict=True))
    got = {r.doc_id: r for r in found}
    assert len(found) == len(rows) and len(got) == len(rows) - 1
    short = {r.doc_id for r in sorted(rows, key=lambda r: len(r.text or ""))[:40]}
    for r in rows:
        own = [*words(r.text, True), "\n"]
        want = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        x = got[r.doc_id]
        assert (x.n_tokens, x.n_known, x.train_tokens) == (len(own), sum(c[w] > 0 for w in own), n)
        assert x.base_score == pytest.approx(want, abs=1e-6)
        if r.doc_id in short:
            assert x.score == pytest.approx(plain_score(model, listed, c, own), rel=1e-4, abs=1e-4)
    # Probabilities of all codes after a context add up to one, and so do those of words within a rest class.
    k = listed.start
    logs = model.log10_probability(np.arange(k), np.full(k, 3), np.full(k, 5))
    assert (10.0**logs).sum() == pytest.approx(1, abs=1e-3)
    for r in range(bilinear_lm.RESTS):
        rest = [w for w in c if w.encode() not in set(listed.words) and bilinear_lm.rest_class(w.encode()) == r]
        assert sum(c[w] + 0.5 for w in rest) + 0.5 == pytest.approx(listed.rest_n[r] + 0.5 * (listed.rest_v[r] + 1))


def test_lm_does_not_depend_on_partitions(spark, sf):
    docs = Q.read(spark, sf, "documents").select("doc_id", "text")
    key = lambda f: sorted((r.doc_id, r.base_score, r.score) for r in f.collect())
    one, many = ([], [])
    for parts, out in ((1, one), (7, many)):
        listed, coded = lm_parts(docs.repartition(parts), F.lit(True), min_count=5)
        model = bilinear_lm.fit(coded, listed, shard_docs=60)
        out.append(np.concatenate([getattr(model, p).ravel() for p in model.PARTS]))
        out.append(key(bilinear_lm.score(coded, model, listed)))
    assert (one[0] == many[0]).all()
    assert all(a == pytest.approx(b, rel=1e-5) for a, b in zip(one[1], many[1], strict=True))


def test_lm_trains_on_every_token_once(spark, monkeypatch):
    rows = [(k, " ".join(f"w{k}x{j}" for j in range(k % 11)), "en", "a") for k in range(60)]
    listed, coded = lm_parts(table(spark, rows), F.lit(True), min_count=1)
    assert len(listed.words) == listed.distinct == 1 + sum(k % 11 for k in range(60))
    used, want = Counter(), Counter()
    monkeypatch.setattr(bilinear_lm.Bilinear, "train", lambda self, target, one, *rest: used.update(zip(target.tolist(), one.tolist(), strict=True)))
    tasks, mapped = [], type(coded).mapInArrow
    monkeypatch.setattr(type(coded), "mapInArrow", lambda self, f, schema: tasks.append((self, f)) or mapped(self, f, schema))
    bilinear_lm.fit(coded, listed, shard_docs=7, chunk=50)
    for frame, run in tasks:  # the training functions once more, here, with steps that only note their targets
        if "codes" in frame.columns:
            list(run(iter(frame.toArrow().to_batches(max_chunksize=5))))
    for _, text, *_ in rows:
        coder = bilinear_lm.Coder(listed.words)
        codes = coder.codes(coder.numbers([[w.encode() for w in words(text, lower=True)]])).tolist()
        want.update(zip(codes, [listed.start, *codes[:-1]], strict=True))
    assert used == want


def test_lm_beats_base_on_held_out_text(spark):
    got = Q.op8_lm_scoring(spark, "/root/testdata/sf0.01").toPandas()
    held = got[got.held_out]
    assert held.score.sum() > 0.97 * held.base_score.sum() and held.score.sum() > held.base_score.sum()


def test_lm_without_rows(spark):
    empty = table(spark, [])
    assert bilinear_lm.learn_and_score(empty, F.lit(True)).count() == 0
    one = bilinear_lm.learn_and_score(table(spark, ODD), F.lit(False)).toPandas()
    assert len(one) == len(ODD) and (one.n_known == 0).all() and (one.train_tokens == 0).all()


def test_lm_very_long_text(spark):
    rows = [(1, "a b c " * 300_000, "en", "x"), (2, "a b", "en", "x"), (3, "d" * 10**6, "en", "x")]
    got = bilinear_lm.learn_and_score(table(spark, rows), F.lit(True)).toPandas().set_index("doc_id")
    assert got.n_tokens.to_dict() == {1: 900_001, 2: 3, 3: 2} and np.isfinite(got.score).all()


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="with-sidebar">
<header>Site</header><nav><ul><li><a href=/x>Menu</a></ul></nav><div class="cookie-notice">We use cookies</div><!-- <p>no</p> -->
<article><h1>Head &amp; tail</h1><p>First&nbsp; <b>para\ngraph</b>.<br><p>Second &lt;one&gt; 1 < 2<form><input><p>Mail</form><aside>Side</aside><ul><li>a<li>b</ul>
<div class="comments"><article class="comment"><p>Nice!</article></div></article><div id="related-posts">More</div><footer>&copy; x</footer></body></html>"""


def alone(source):
    return html_main_text.main_text(html_main_text.Page(source))[0]


def test_page_structure():
    assert alone(PAGE) == "Head & tail\n\nFirst para graph.\n\nSecond <one> 1 < 2\n\na\n\nb"
    for broken in ("", None, "<", "<p", "plain", "<p>a</div></p>b", "<script>x", "<![CDATA[a<b]]>", "<p>x &am"):
        html_main_text.lines_of(broken)


def test_only_real_attributes_make_furniture():
    for inside in (
        '<p title="Hidden gems">kept</p>', '<p data-id="nav">kept</p>', '<p data-hidden="false">kept</p>', '<h2 id="search-results">kept</h2>',
        '<section class="related-work"><p>kept</p></section>', "<p>ke<math><mi>p</mi></math>t</p>", "<p data-x='class=\"ad\"'>kept</p>",
    ):
        assert alone(f"<article><p>one</p>{inside}</article>") == "one\n\nkept", inside
    for inside in ("<p hidden>x</p>", '<div class="big ad">x</div>', '<div role="navigation">x</div>', '<p style="display: none">x</p>', '<div id="comments"><p>x</p></div>'):
        assert alone(f"<article><p>one</p>{inside}</article>") == "one", inside


@pytest.mark.parametrize("most", [1 << 27, 4])
def test_lcs_matches_dynamic_program(monkeypatch, most):
    whole = html_main_text._aligned
    monkeypatch.setattr(html_main_text, "_aligned", lambda a, b, bits=most: whole(a, b, bits))
    rng = random.Random(2)
    for _ in range(500):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(14))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        found = sorted(html_main_text.shared(a, b).items())
        assert len(found) == best[-1][-1] and all(a[i] == b[j] for i, j in found)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(found, found[1:], strict=False))


def plain_lcs(a, b):
    best = [[frozenset()] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] | {i} if x == y else max(best[i][j + 1], best[i + 1][j], key=len)
    return best[-1][-1]


def test_differencing_without_marks(spark):
    rng = random.Random(12)
    story = [[f"story {k} line {j} " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(6)) for j in range(rng.randrange(1, 6))] for k in range(90)]
    lines = [["Home | News", *own, *(["Quoted by some"] if k % 7 == 0 else []), "Imprint"] for k, own in enumerate(story)]
    page = lambda k: "".join(f"<div>{x}</div>" for x in lines[k])
    rows = [(k, f"http://h/{k:03d}", page(k)) for k in range(90)] + [(200, None, None), (201, "http://h/000", page(0)), (201, "http://h/000", page(0)), (None, "http://solo/", page(7))]
    rows += [(300 + k, "http://h/045", page(45)) for k in range(40)] + [(None, None, "<p>same</p>")] * 30
    pages = spark.createDataFrame([(*r, "x", 2) for r in rows], "page_id long, url string, html string, _host string, block int")
    whole = html_main_text.extract(pages).toPandas()
    cut = html_main_text.extract(pages, block_rows=64).toPandas()
    capped = html_main_text.extract(pages, block_rows=8, usual_blocks=2).toPandas()
    key = lambda f: sorted(map(str, f.itertuples(index=False)))
    assert key(whole) == key(cut) == key(capped) and len(whole) == len(rows)
    own = whole.set_index("page_id")
    for k in range(90):  # the whole operator once more, plainly
        near = [j for j in range(k - 1, -1, -1)][:3] + [j for j in range(k + 1, 90)][:3]
        votes = Counter(i for j in near for i in plain_lcs(lines[k], lines[j]))
        want = "\n\n".join(x for i, x in enumerate(lines[k]) if 2 * votes[i] < len(near))
        assert own.loc[k].text == want, k
    assert (own.loc[300:339].text == own.loc[45].text).all(), "copies are passed over"
    assert own.loc[200].text == "" and (own[own.url == "http://solo/"].text.str.count("\n\n") == len(lines[7]) - 1).all()
    assert html_main_text.extract(pages.limit(0)).count() == 0


def test_differencing_decides_in_articles_too(spark):
    rng = random.Random(3)
    fresh = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(8))
    own = [[fresh() for _ in range(rng.randrange(2, 5))] for _ in range(30)]
    quote = "A line that pages quote"
    body = [["Share this story", *own[k][:1], *([quote] if k % 2 else []), *own[k][1:], "Written by our staff"] for k in range(30)]
    page = lambda k: f"<div class=x><p>Top {k}</div><article>{''.join(f'<p>{x}</p>' for x in body[k])}</article><div>Terms</div>"
    rows = [(k, f"http://h/{k:03d}", page(k)) for k in range(30)] + [(100, "http://two/a", page(0)), (101, "http://two/b", page(1))]
    got = html_main_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).toPandas().set_index("page_id")
    for k in range(30):
        assert got.loc[k].text == "\n\n".join(x for x in body[k] if x not in (body[k][0], body[k][-1])), k
        assert got.loc[k].n_shared == 4 and alone(page(k)) == "\n\n".join(body[k])
    assert got.loc[100].text == "\n\n".join(body[0]), "one page alone is no evidence within an article"


def test_very_long_page(spark):
    rows = [(k, f"http://h/{k}", "<div>Menu</div><article>" + "".join(f"<p>line {j} of {k}" for j in range(20_000)) + "<p>" + "x" * 10**6 + "</article>") for k in range(3)]
    got = html_main_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).toPandas()
    assert (got.text.str.count("\n\n") == 20_000).all() and (got.n_chars > 10**6).all()


def test_pages_match_articles(spark, sf):
    import html as h
    import re

    got = Q.op6_html_extraction(spark, sf).toPandas().merge(Q.read(spark, sf, "pages").toPandas(), on="page_id")
    for r in got.itertuples():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        want = "\n\n".join(x for x in (" ".join(h.unescape(re.sub("<[^>]*>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", inner)) if x)
        assert r.text == want and r.n_chars == len(want)
