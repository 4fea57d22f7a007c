"""Sharding, neighbours, preference pairs, packing, near-duplicates and the pipeline against plain versions."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tracefold.llm import best_fit_packing, block_knn, lookup_sharding, preference_format, setsketch_dedup
from tracefold.llm import queries as Q
from tracefold.llm.components import components

from .test_text_operators import ODD, table, words


def test_table_gives_even_shares_and_moves_few_slots():
    names = [f"s{k}" for k in range(20)]
    full = lookup_sharding.fill_table(names, 2003)
    share = Counter(full)
    assert max(share.values()) - min(share.values()) <= 1 and set(share) == set(range(20))
    less = lookup_sharding.fill_table(names[:-1], 2003)
    moved = sum(a != b for a, b in zip(full, less, strict=True) if a != 19)
    assert moved < 0.15 * 2003
    heavy = Counter(lookup_sharding.fill_table(names, 2003, [2.0] + [1.0] * 19))
    assert heavy[0] == pytest.approx(2 * heavy[1], rel=0.05)
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            lookup_sharding.fill_table(bad, 7)
    with pytest.raises(ValueError):
        lookup_sharding.fill_table(["a"], 8)


def test_placement(spark):
    names = ["a", "b", "c"]
    docs = table(spark, ODD).withColumn("slot", F.lit("old"))
    got = lookup_sharding.place(docs, "doc_id", names, 101).collect()
    filled = lookup_sharding.fill_table(names, 101)
    assert len(got) == len(ODD)
    for r in got:
        if r.doc_id is None:
            assert r.slot is None and r.shard is None
        else:
            assert r.slot == lookup_sharding.number(str(r.doc_id)) % 101 and r.shard == names[filled[r.slot]]
    assert lookup_sharding.place(docs.limit(0), "doc_id", names, 101).count() == 0


def brute_nearest(rows, queries, k):
    usable = [(n, i, np.array(v, float)) for n, (i, v) in enumerate(rows) if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = Counter()
    for n, i, v in usable:
        if queries(i):
            near = sorted((float(np.sqrt(sum((a - b) ** 2 for a, b in zip(v, w, strict=True)))), j) for m, j, w in usable if m != n and len(w) == len(v))[:k]
            out.update((i, r, j, round(d, 9)) for r, (d, j) in enumerate(near, 1))
    return out


def test_neighbours_match_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(int(k), [float(x) for x in rng.standard_normal(8)]) for k in range(400)]
    rows += [(400 + k, [1.0] * 8) for k in range(60)] + [(500, [1.0] * 8), (500, [1.0] * 8)]
    rows += [(800 + k, [1e155 * (k + 1)] * 8) for k in range(3)] + [(850, [-1e200] * 8)]
    rows += [(600, None), (601, []), (602, [0.0] * 8), (603, [float("nan")] + [1.0] * 7), (604, [None] * 8), (605, [float("inf")] * 8), (None, [1.0] * 8), (700, [1.0, 2.0]), (701, [1.0, 3.0])]
    frame = spark.createDataFrame([(i, v, "x", 0) for i, v in rows], "vec_id long, embedding array<double>, ids string, row int")
    for block, groups in ((2048, 1), (16, 3)):
        got = block_knn.nearest(frame, F.col("vec_id") % 50 == 0, k=10, block=block, groups=groups)
        assert Counter((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in got.collect()) == brute_nearest(rows, lambda i: i % 50 == 0, 10)
    assert block_knn.nearest(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_neighbours_broadcast_nothing(spark):
    rng = np.random.default_rng(5)
    rows = [(k, [float(x) for x in rng.standard_normal(4)]) for k in range(2000)]
    got = block_knn.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0)
    assert got.count() == 200
    got.collect()
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_grid_bounds_copies_of_queries():
    for rows, queries in ((2000, 20), (600_000, 6_000), (17_000_000, 170_000), (10**9, 10**7), (10**7, 10**7)):
        pieces, columns = block_knn.grid(rows, queries, 64, k=10, block=2048, most=600)
        assert columns * queries <= max(16 * queries, rows * pieces / 2) and columns <= 600
        assert queries / pieces * (64 * 4 + 64) < block_knn.PIECE_BYTES
    assert block_knn.grid(0, 0, 0, k=10, block=2048, most=600) == (1, 1)


def test_neighbours_over_several_cells_and_norms(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((1500, 16)) * np.repeat([1e-18, 1e-12, 1, 3, 1e14, 1e17], 250)[:, None]
    x[300:900] = x[rng.integers(500, 560, 600)] * (1 + 1e-6 * rng.integers(0, 2, (600, 1)))  # copies and near copies
    x = x.astype(np.float32)
    frame = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    monkeypatch.setattr(block_knn, "PIECE_BYTES", 20_000)
    assert block_knn.grid(1500, 150, 16, k=7, block=64, most=4)[0] > 1
    got = block_knn.nearest(frame, F.col("vec_id") % 10 == 0, k=7, block=64).collect()
    want = Counter()
    for q in range(0, 1500, 10):
        d = block_knn.distances(np.repeat(x[q : q + 1], 1500, 0).astype(float), x.astype(float))
        order = [j for j in np.lexsort((np.arange(1500), d)).tolist() if j != q][:7]
        want.update((q, r, j, float(d[j])) for r, j in enumerate(order, 1))
    assert Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == want


def test_quantisation_bounds_hold():
    rng = np.random.default_rng(4)
    x, y = rng.standard_normal((40, 64)), rng.standard_normal((300, 64)) * rng.uniform(0.1, 5, (300, 1))
    q, v, d = block_knn.tile(x, y, 5, np.full(40, np.inf), None)
    exact = np.sqrt(((x[:, None] - y[None]) ** 2).sum(2))
    found = set(zip(q.tolist(), v.tolist(), strict=True))
    assert all((i, j) in found for i in range(40) for j in np.argsort(exact[i])[:5].tolist())
    assert len(found) < 40 * 300 / 3 and np.allclose(d, exact[q, v])


def test_preference_segments(spark):
    s = "pair_id long, turn long, role string, text string, side string"
    chosen = [(1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "good"), (1, 3, "user", "more"), (2, 0, None, None), (3, 0, "user", "same"), (3, 0, "user", "same"), (None, 0, "user", "x"), (4, None, "user", "x"), (5, 0, "assistant", "only")]
    rejected = [(1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "bad"), (2, 0, "user", ""), (3, 0, "user", "same")]
    got = preference_format.format_pairs(*(spark.createDataFrame([(*r, "z") for r in rows], s) for rows in (chosen, rejected)))
    rows = sorted((r.pair_id, r.side, r.turn, r.copies, r.loss) for r in got.collect())
    assert rows == [
        (1, "chosen", 2, 1, 1), (1, "chosen", 3, 1, 0), (1, "prompt", 0, 1, 0), (1, "prompt", 1, 1, 0), (1, "rejected", 2, 1, 1),
        (2, "prompt", 0, 1, 0), (3, "chosen", 0, 2, 0), (3, "rejected", 0, 1, 0), (5, "chosen", 0, 1, 1),
    ]
    one = next(r for r in preference_format.as_records(got).collect() if r.pair_id == 1)
    assert one.prompt == "<|system|>\nbe kind<|end|>\n<|user|>\nhi<|end|>\n" and one.rejected == "<|assistant|>\nbad<|end|>\n"
    assert [(m.n_chars, m.loss) for m in one.chosen_mask] == [(26, 1), (21, 0)] and sum(m.n_chars for m in one.chosen_mask) == len(one.chosen)


def test_packing_keeps_constraints_and_every_word(spark):
    rng = random.Random(6)
    rows = ODD + [(1000 + k, " ".join(["w%d" % rng.randrange(99)] * rng.choice([3, 40, 130, 700])), "en", rng.choice(["hot"] * 3 + list("abcdefgh"))) for k in range(300)]
    items = best_fit_packing.measure(table(spark, rows))
    got = best_fit_packing.pack(items, capacity=256, group_rows=120).toPandas()
    by_id = got.groupby("doc_id", dropna=False).n_words.sum()
    want = defaultdict(int)
    for i, text, _, _ in rows:
        want[i] += len(words(text))
    assert all(by_id.loc[i] == n for i, n in want.items() if i is not None) and got[got.doc_id.isna()].n_words.sum() == want[None]
    packed = got[got.n_words > 0]
    assert packed.bin_id.notna().all() and got[got.n_words == 0].bin_id.isna().all()
    for _, b in packed.groupby("bin_id"):
        assert b.n_words.sum() <= 256 and not b.source.dropna().duplicated().any()
        ends = b.sort_values("bin_offset")
        assert (ends.bin_offset.iloc[1:].to_numpy() == (ends.bin_offset + ends.n_words).iloc[:-1].to_numpy()).all()
    assert best_fit_packing.pack(items.limit(0)).count() == 0


def test_best_fit_matches_a_plain_search():
    rng = np.random.default_rng(8)
    n, cap = 400, 100
    lengths = np.sort(rng.integers(1, 101, n))[::-1]
    sources, clusters = rng.integers(-1, 6, n), rng.integers(-1, 90, n)
    where, offset = best_fit_packing.best_fit(lengths, sources, clusters, cap)
    bins: list = []  # left, sources, clusters, members
    for k in range(n):
        fits = [b for b in bins if b[0] >= lengths[k] and (sources[k] < 0 or sources[k] not in b[1]) and (clusters[k] < 0 or clusters[k] not in b[2])]
        best = min(fits, key=lambda b: b[0])[0] if fits else None
        own = cap - offset[k]  # the residual that the piece found
        assert (best is None and offset[k] == 0) or own == best
        if best is None:
            bins.append([cap - lengths[k], {sources[k]}, {clusters[k]}, where[k]])
        else:
            b = next(b for b in bins if b[3] == where[k])
            assert b in fits
            b[0] -= lengths[k]
            b[1].add(sources[k])
            b[2].add(clusters[k])


def sets_of(rows, size):
    out = {}
    for i, text in rows:
        own = words(text, True)
        out[i] = {tuple(own[k : k + size]) for k in range(len(own) - size + 1)} if len(own) >= size else ({tuple(own)} if own else set())
    return out


def brute_components(rows, size, percent=80):
    sets = sets_of(rows, size)
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    common = Counter((a, b) for h in holders.values() for k, a in enumerate(h) for b in h[k + 1 :])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def near_copies(seed, groups=12, most=40):
    """Groups of copies of growing distance, some of which link only through others."""
    rng, rows = random.Random(seed), []
    for _ in range(groups):
        text = [f"t{rng.randrange(10**6)}" for _ in range(rng.choice([3, 5, 12, 60, 300]))]
        for _ in range(rng.randrange(1, most)):
            own = list(text)
            for _ in range(int(len(own) * rng.choice([0, 0, 0.01, 0.03, 0.06]))):
                own[rng.randrange(len(own))] = f"u{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(own).upper() if rng.random() < 0.2 else " ".join(own)))
            if rng.random() < 0.3:
                text = own
    return rows


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates_match_brute_force(spark, size):
    rows = near_copies(size) + [(5000, None), (5001, ""), (5002, " \n"), (5003, "One two"), (5004, "one TWO"), (5005, "two one"), (5005, "two one")]
    frame = table(spark, [(i, t, "en", "a") for i, t in rows] + [(None, rows[0][1], "en", "a")]).repartition(5)
    got = setsketch_dedup.near_duplicates(frame, words=size).collect()
    want = brute_components(rows, size)
    assert len(got) == len(rows) + 1
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], r.doc_id == want[r.doc_id][1])
    assert setsketch_dedup.near_duplicates(frame.limit(0)).count() == 0


def test_likelihood_estimates_similarity():
    rng = np.random.default_rng(1)
    sketch = setsketch_dedup.Sketcher(240)
    for common, only_a, only_b in ((400, 50, 50), (100, 100, 300), (10, 500, 500), (450, 0, 112)):
        x = rng.integers(0, 1 << 63, common + only_a + only_b, np.uint64)
        a, b = x[: common + only_a], np.r_[x[:common], x[common + only_a :]]
        rows = sketch(np.r_[a, b], np.array([len(a), len(b)]))
        estimate, can = setsketch_dedup._compare(rows[:1], rows[1:], np.array([len(a)]), np.array([len(b)]), 0.8)
        true = common / len(x)
        assert abs(estimate[0] - true) < 0.1 and can[0] == (true > 0.7)
        # Registers of a union are the larger ones.
        assert (sketch(x, np.array([len(x)]))[0] == rows.max(0)).all()


def test_components_both_ways(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(k, k + 1) for k in range(400, 440)] + [(500, k) for k in range(501, 560)] + [(7, 7)]
    frame = spark.createDataFrame(edges, "a long, b long")
    small, large = (dict(map(tuple, components(frame.repartition(9), piece=n).collect())) for n in (10**6, 3))
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    assert small == large == {x: find(x) for x in list(root)}
    assert components(frame.limit(0)).count() == 0


def test_pipeline_stages(spark, tmp_path):
    docs = Q.read(spark, "/root/testdata/sf0.01", "documents").withColumn("rejected", F.when(F.col("doc_id") >= 0, "mine"))
    docs = docs.unionByName(spark.createDataFrame([(10**7, None, None, None, None, None), (10**7 + 1, "1 2 3", "en", "a", 5, None)], docs.schema))
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.01")
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        rows = out.collect()
        if name != "best_fit_packing":
            assert out.columns == docs.columns and len({r.doc_id for r in rows}) == len(rows)
        if name == "language_id":
            assert 10**7 not in {r.doc_id for r in rows} and len(rows) > 0.98 * len(before)
        if name == "quality_rules":
            from .test_text_operators import base

            good = {i for i, r in before.items() if (b := base(r.text))[0] >= 20 and 100 * b[4] <= 30 * b[0]}
            assert {r.doc_id for r in rows} <= good and len(rows) > 0.97 * len(good)
            assert all(r.n_chars == len(r.text) for r in rows)
        if name == "near_duplicates":
            want = brute_components([(r.doc_id, r.text) for r in docs.collect()], 5)
            assert {r.doc_id for r in rows} == {i for i, (_, c) in want.items() if i == c}
        if name == "best_fit_packing":
            left = {r.doc_id: len(words(r.text)) for r in docs.collect()}
            got = Counter()
            for r in rows:
                got[r.doc_id] += r.n_words
            assert got == left
        docs = out


def test_pipeline_drops_rows_not_ids(spark):
    rng = random.Random(11)
    text = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(5)]
    rows = [(1, text[0], "en", "a"), (5, text[0] + " more", "en", "a"), (5, text[1], "en", "a"), (6, text[2], "en", "b"), (6, text[2], "en", "b"), (6, text[2].upper(), "en", "b"), (7, text[3], "en", "b"), (7, text[4], "en", "b"), (8, "", "en", "b"), (8, None, "en", "b"), (None, text[0], "en", "b")]
    docs = table(spark, rows)
    left = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    got = Counter((r.doc_id, (r.text or "").lower()) for r in left.collect())
    assert got == Counter([(1, text[0]), (5, text[1]), (6, text[2]), (7, text[3]), (7, text[4]), (8, ""), (8, ""), (None, text[0])]) and left.columns == docs.columns
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0


def test_strict_quality_rules_deplete(spark, sf):
    got = Q.quality_rules_strict(spark, sf).toPandas()
    assert (got.kept < ~got.base_failed).any()


def test_queries_have_the_contract_columns(spark, sf):
    want = {
        "op1_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
        "op2_sentencepiece": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        "op4_nearest_neighbours": ["query_id", "rank", "vec_id", "score"],
        "op5_language_id": ["doc_id", "held_out", "lang_pred", "score"],
        "op6_html_extraction": ["page_id", "url", "text", "n_chars"],
        "op8_lm_scoring": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        "op10_near_duplicates": ["doc_id", "n_shingles", "component_id", "kept"],
    }
    found = Q.queries()
    for name, columns in want.items():
        assert set(columns) <= set(found[name](spark, sf).columns), name


def test_sweep_removes_written_tables(spark):
    from tracefold.llm import common

    frame, path = common.kept(spark.range(3))
    assert frame.count() == 3 and common.sweep(spark) >= 1
    assert not spark.sparkContext._jvm.java.io.File(path.removeprefix("file:")).exists()
