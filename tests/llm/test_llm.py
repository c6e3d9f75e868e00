"""The training-data operators against brute force, on rows with nulls, empties, ties, repeats and clashing columns."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from erloom.llm import ans, decontam, embedding, html, langid, minhash, packing, quality, secrets, sharding
from erloom.llm.common import components
from erloom.llm.tokens import default_tokenizer, encoder

SCHEMA = "doc_id long, text string, lang string, source string, band string, x string, t string, h string"


def vocabulary(seed, n=400):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 9))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    r, words = random.Random(5), vocabulary(1)
    rows = []
    for i in range(60):
        rows.append((i, " ".join(r.choice(words) for _ in range(r.randint(1, 120))), "en", f"s{i % 4}"))
    near = rows[7][1].split() + [r.choice(words) for _ in range(60)]
    rows += [(100, " ".join(near), "en", "s1"), (101, " ".join(near[:-2] + ["other", "end"]), None, None), (102, " ".join(near), "en", "s1"), (102, " ".join(near), "en", "s1")]
    rows += [(200, None, None, None), (201, "", "en", "s1"), (202, "!!! ???", "en", "s1"), (203, "!!! ???", "en", "s1"), (204, "two words", "en", "s2"), (205, "a  b\n\nc ", "en", "s2"), (206, " ".join(r.choice(words) for _ in range(6000)), "en", "s2")]
    return spark.createDataFrame([(*x, "b", "x", "t", "h") for x in rows], SCHEMA)


def none_of(spark):
    return spark.createDataFrame([], SCHEMA)


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 30), (5, 5), (None, 1)] + [(50, i) for i in range(51, 80)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, 30: 7} | {i: 50 for i in range(50, 80)}


def test_language(spark):
    tongues = {"aa": vocabulary(11, 60), "bb": [w + "ö" for w in vocabulary(12, 60)]}
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(tongues[k]) for _ in range(40)), k) for i in range(80) for k in [("aa", "bb")[i % 2]]]
    frame = spark.createDataFrame(rows + [(900, None, None), (901, "123 !!", "aa"), (902, "", None)], "doc_id long, text string, lang string")
    model = langid.fit(frame)
    got = {x.doc_id: x for x in langid.identify(frame, model).collect()}
    assert all(got[i].lang_pred == k for i, _, k in rows) and all(0 <= x.score <= 1 for x in got.values())
    assert {got[i].lang_pred for i in (900, 901, 902)} == {"und"}
    # code-switched text: the words of each half are labelled by their own language
    mixed = " ".join(tongues["aa"][:20] + tongues["bb"][:20])
    _, _, sums = model.predict(pa.array([mixed], pa.large_string()))
    assert abs(sums[0] - 20).max() < 4
    kept = langid.keep_identified(frame, model)
    assert kept.columns == frame.columns and kept.count() == 80
    assert langid.fit(frame.where("false")) is None and langid.identify(frame.where("false"), None).count() == 0


def test_forward_backward_by_enumeration():
    import itertools

    rng = np.random.default_rng(0)
    emit, trans = rng.normal(size=(1, 4, 3)), rng.normal(size=(3, 3))
    p, pairs = langid.forward_backward(emit, trans, np.array([4]))
    want, both, z = np.zeros((4, 3)), np.zeros((3, 3)), 0.0
    for y in itertools.product(range(3), repeat=4):
        w = np.exp(sum(emit[0, i, k] for i, k in enumerate(y)) + sum(trans[a, b] for a, b in zip(y, y[1:])))
        z += w
        for i, k in enumerate(y):
            want[i, k] += w
        for a, b in zip(y, y[1:]):
            both[a, b] += w
    assert np.allclose(p[0], want / z) and np.allclose(pairs, both / z)


def test_long_sequences_are_one_chain():
    rng = np.random.default_rng(5)
    trans = rng.normal(size=(3, 3)) * 2
    for t in (257, 512, 700, 1025):
        emit = rng.normal(size=(t, 3))
        whole, _ = langid.forward_backward(emit[None], trans, np.array([t]), switches=False)
        assert np.allclose(langid.long_marginals(emit, trans), whole[0])
    sharp = np.zeros((1, 300, 2), dtype=np.float32)  # labels that rule each other out, and no way between them
    sharp[0, ::2, 0], sharp[0, 1::2, 1] = 500, 500
    p, _ = langid.forward_backward(sharp, np.array([[0.0, -500], [-500, 0]]), np.array([300]))
    assert np.isfinite(p).all() and np.allclose(p.sum(axis=2), 1, atol=1e-3)


def accuracy(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    lang = langid.identify(docs, langid.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").where(langid.held_out() & langid.F.col("lang").isNotNull()).toPandas()
    model = quality.fit(docs, labels)
    good = quality.score(docs, model).join(labels, "doc_id").where(quality.held_out()).toPandas()
    return lang, good


def test_held_out_accuracy(spark):
    """On rows that were never learned from."""
    lang, good = accuracy(spark, "/root/testdata/sf0.01")
    assert len(lang) > 150 and (lang["lang"] == lang["lang_pred"]).mean() >= 0.98
    s, y = good["score"].to_numpy(), good["quality"].to_numpy()
    above = (s[y == 1][:, None] > s[y == 0][None, :]).mean()
    passed = s >= quality.CUT
    assert above >= 0.97 and y[passed].mean() >= 0.95 and passed[y == 1].mean() >= 0.95


def test_non_negative_risk_by_finite_differences():
    rng = np.random.default_rng(12)
    model = quality.Scorer(rng.normal(size=(200, len(quality.STATS))))
    model.weights, model.bias = rng.normal(size=len(model.weights)) * 0.3, 0.2
    p, u = (model.bins(rng.normal(size=(n, len(quality.STATS)))) for n in (40, 70))
    for prior, part in ((0.3, "both"), (0.95, "negative")):
        if part == "negative":  # weights that separate the samples push the negatives' part below zero
            model.weights = np.zeros(len(model.weights))
            np.add.at(model.weights, p.reshape(-1), 0.4)
            model.bias = -6.0
        pos, neg = quality.risk(model, p, u, prior)
        assert (neg < 0) == (part == "negative")
        g = quality.step(model, p, u, prior)
        value = lambda: (lambda a, b: (a + b if part == "both" else -b) + quality.DECAY * (model.weights**2).sum() / 2)(*quality.risk(model, p, u, prior))
        for i in rng.choice(len(model.weights), 12, replace=False):
            held = model.weights[i]
            model.weights[i] = held + 1e-5
            up = value()
            model.weights[i] = held - 1e-5
            down = value()
            model.weights[i] = held
            assert abs((up - down) / 2e-5 - g[i]) < 1e-5


def test_quality_tables(spark):
    r, words = random.Random(4), vocabulary(5)
    rows = [(i, " ".join(r.choice(words) for _ in range(40)) + ".") for i in range(60)] + [(100 + i, "BUY!! " * 30) for i in range(40)] + [(300, None), (301, ""), (302, "x " * 200_000), (None, "text of none"), (1, "again")]
    docs = spark.createDataFrame([(*x, "q", 1) for x in rows], "doc_id long, text string, positive string, quality int")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 60, 2)] + [(None, 1, 0), (100, 0, 1)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    got = quality.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= x.score <= 1 for x in got)
    by_id = {x.doc_id: x.score for x in got}
    assert by_id[101] < by_id[3] and len({by_id[i] for i in range(100, 140)}) == 1 and by_id[300] == by_id[301]
    assert quality.fit(docs.where("false"), labels.where("false")) is None
    assert quality.score(docs.where("false"), model).count() == 0 and quality.score(docs, None).where("score <> 0.5").count() == 0


def test_quality():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(1, 0.3, (900, len(quality.STATS))), rng.normal(-1, 0.3, (300, len(quality.STATS)))
    model = quality.train(good[:400], np.concatenate([good[400:], bad]))
    assert abs(model.prior - 500 / 800) < 0.1
    assert model.score(good).min() > 0.5 > model.score(bad).max()
    assert quality.train(good[:2], bad) is None
    stats = quality.statistics(pa.array(["", "AA!! BB!!", "a a a a", "x\nx\nx"], pa.large_string()))
    assert np.isfinite(stats).all() and stats.shape == (4, len(quality.STATS))


def test_token_ids_equal_the_library():
    r = random.Random(3)
    parts = ["a", "the", " ", "  ", "\n", "\t", "é", "!", "'s", "don't", "12", "<|endoftext|>", "日本", ".", ",", " b", "x,", "\r\n", "\x02", "\xa0"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(3000)]
    coder = encoder(default_tokenizer())
    starts, ids = coder.encode(pa.array(texts, pa.large_string()))
    for i, e in enumerate(coder.tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert ids[starts[i] : starts[i + 1]].tolist() == e.ids


def test_ans_round_trip():
    rng = np.random.default_rng(2)
    ids = rng.zipf(1.4, 50_000) % 5000
    coder = ans.Coder(ans.scale(np.bincount(ids, minlength=5000)))
    for n in (1, 100, 8192, 8193, 50_000):
        assert (coder.decode(*coder.encode(ids[:n])) == ids[:n]).all()


def test_ans_files(spark, docs, tmp_path):
    ans.write_tokens(docs, str(tmp_path / "t"), default_tokenizer())
    got = sorted(tuple(r) for r in ans.read_tokens(spark, str(tmp_path / "t")).collect())
    tok, at, want = encoder(default_tokenizer()).tokenizer, 0, []
    for i, t in sorted((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()):
        ids = np.array(tok.encode(t, add_special_tokens=False).ids + [0], dtype="<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == sorted(want)


def test_ans_of_no_rows(spark, tmp_path):
    ans.write_tokens(none_of(spark), str(tmp_path / "t"), default_tokenizer())
    assert ans.read_tokens(spark, str(tmp_path / "t")).count() == 0


def test_ans_damage_is_seen(spark, docs, tmp_path):
    ans.write_tokens(docs, str(tmp_path / "t"), default_tokenizer())
    blocks = spark.read.parquet(str(tmp_path / "t/blocks"))
    damaged = blocks.withColumn("header", ans.F.concat("header", ans.F.lit(b"x")))
    damaged.write.parquet(str(tmp_path / "u/blocks"))
    spark.read.parquet(str(tmp_path / "t/table")).write.parquet(str(tmp_path / "u/table"))
    with pytest.raises(Exception, match="damaged"):
        ans.read_tokens(spark, str(tmp_path / "u")).collect()


def test_sharding(spark, docs):
    from pyspark.sql import functions as F

    rows = sharding.shard(docs, "doc_id", 7, [F.length("text").alias("size")]).collect()
    assert len(rows) == docs.count()
    for s in range(7):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert all(r.grown_shard in (r.shard, 7) for r in rows)
    assert sharding.shard(none_of(spark), "doc_id", 7, []).count() == 0


def test_html():
    page = "<html><head><title>T</title></head><body><nav><ul><li>menu</li></ul></nav><div class='ad'>Buy now and save a lot of money today</div><article><h1>Head &amp; line</h1><p>One   two\nthree, a paragraph that is long enough.<p><b>Bold<br>text</b> goes on here.</p><p>Ok.</p></article><div id='comments'><p>A reader says something quite long here.</p></div><footer>&copy; x</footer></body></html>"
    assert html.main_text(page) == "Head & line\n\nOne two three, a paragraph that is long enough.\n\nBold text goes on here.\n\nOk."
    assert html.main_text("") == "" and html.main_text("<p>") == "" and isinstance(html.main_text("<![bad"), str)
    assert html.main_text("<div><p>Just a paragraph without any article around it.</p></div>") == "Just a paragraph without any article around it."


def test_html_keeps_short_and_late_text():
    story = ["A long paragraph of the story, number %d, with many words in it." % i for i in range(12)]
    body = "".join(f"<p>{x}</p>" for x in story)
    # a heading and a short paragraph beside removed elements of an article
    page = f"<article><h1>A short heading here</h1><div class='ad'>Buy</div>{body}<form>x</form><p>The end.</p></article>"
    assert html.main_text(page) == "\n\n".join(["A short heading here", *story, "The end."])
    # without an article, text on both sides of an advert
    page = f"<nav>menu</nav><div><h1>A short heading</h1><div class='ad'>Buy</div>{body}<div class='ad'>Buy</div><p>A closing paragraph of the story.</p></div><footer>x</footer>"
    assert html.main_text(page) == "\n\n".join(["A short heading", *story, "A closing paragraph of the story."])
    # beyond a header or footer a short region stands alone
    assert html.main_text(f"<p>Short one.</p><nav>menu</nav>{body}<footer>x</footer><p>Other.</p>") == "\n\n".join(story)
    # teaser cards beside a story that is no article
    page = f"<div>{body}</div><nav>more</nav><article><p>A teaser card with a few words.</p></article>"
    assert html.main_text(page) == "\n\n".join(story)


def test_near_vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(150, 16))
    x[40:70] = x[40] + rng.normal(scale=0.02, size=(30, 16))
    x[100:104] = x[100]
    rows = [(i, v.tolist(), "u") for i, v in enumerate(x)] + [(900, None, "u"), (901, [], "u"), (902, [0.0] * 16, "u"), (903, [None] * 16, "u"), (904, [float("nan")] * 16, "u"), (905, x[40].tolist()[:5], "u")]
    got = {r.vec_id: r for r in embedding.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, unit string")).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = (u @ u.T >= 0.95 - 1e-12).sum(axis=1) - 1
    assert [got[i].n_links for i in range(150)] == want.tolist() and all(got[i].n_links == 0 for i in range(900, 906))
    assert {got[i].component_id for i in range(40, 70)} == {40} and {got[i].component_id for i in range(100, 104)} == {100}


def test_near_vectors_of_shared_ids_and_repeats(spark):
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(1, a, "n"), (1, b, "n"), (2, b, "n"), (2, b, "n"), (None, a, "n"), (3, [0.99, 0.01, 0.0], "n"), (4, [2.0, 0.0, 0.0], "n")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, node string")
    got = sorted(map(str, map(tuple, embedding.near_vectors(frame).collect())))
    assert got == sorted(map(str, [(1, 3, 1), (1, 2, 1), (2, 2, 1), (2, 2, 1), (None, 3, 1), (3, 3, 1), (4, 3, 1)]))
    assert embedding.near_vectors(frame.where("false")).count() == 0
    apart = embedding.near_vectors(frame.where("vec_id = 2 or vec_id = 4")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in apart) == [(2, 1, 2), (2, 1, 2), (4, 0, 4)]


def test_planned_passes_grow_with_the_vectors():
    assert embedding.planned_passes(100) < embedding.planned_passes(10**5) < embedding.planned_passes(10**8) < 200


@pytest.mark.parametrize("share", [0.0, 0.4])
def test_recall_of_planted_pairs(spark, share):
    """Pairs at 0.955 among random vectors, and inside a dense group whose members don't link otherwise."""
    rng, n, d = np.random.default_rng(7), 6000, 64
    x = rng.normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1)[:, None]
    g = int(n * share)
    middle = rng.normal(size=d)
    x[:g] = np.sqrt(0.8) * middle / np.linalg.norm(middle) + np.sqrt(0.2) * x[:g]
    x /= np.linalg.norm(x, axis=1)[:, None]
    src = np.arange(0, 600) if g else np.arange(3000, 3600)
    o = rng.normal(size=(600, d))
    o -= (o * x[src]).sum(axis=1)[:, None] * x[src]
    y = 0.955 * x[src] + np.sqrt(1 - 0.955**2) * o / np.linalg.norm(o, axis=1)[:, None]
    rows = [(i, v) for i, v in enumerate(np.concatenate([x, y]).tolist())]
    got = {r.vec_id: r.component_id for r in embedding.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)).collect()}
    assert np.mean([got[int(a)] == got[n + k] for k, a in enumerate(src)]) >= 0.97


def test_weighted_signatures():
    rng = np.random.default_rng(6)
    a = rng.integers(0, 2**63, 300).astype(np.uint64)
    w, v = rng.uniform(0.2, 3, 300), rng.uniform(0.2, 3, 300)
    s = minhash.signatures(np.array([0, 300, 600]), np.concatenate([a, a]), np.concatenate([w, v]), k=1500)
    assert abs((s[0] == s[1]).mean() - np.minimum(w, v).sum() / np.maximum(w, v).sum()) < 0.05


def classes(texts, threshold=0.8):
    """Smallest index of each text's class, by every pair of multisets of shingles."""
    from collections import Counter

    starts, sh, counts = minhash.shingles(pa.array([t or "" for t in texts], pa.large_string()))
    bags = [Counter(dict(zip(sh[a:b].tolist(), counts[a:b].tolist()))) for a, b in zip(starts, starts[1:])]
    size, group = [sum(b.values()) for b in bags], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            common = sum((bags[i] & bags[j]).values()) if group[i] != group[j] else 0
            if texts[i] and texts[i] == texts[j] or common and common >= threshold * (size[i] + size[j] - common):
                lo, hi = sorted((group[i], group[j]))
                group = [lo if g == hi else g for g in group]
    return group


def test_shingle_counts():
    starts, sh, counts = minhash.shingles(pa.array(["a b c d e a b c d e a b c d e", "", "x", "A, b c d! e"], pa.large_string()))
    assert starts.tolist() == [0, 5, 5, 6, 7] and sorted(counts.tolist()) == [1, 1, 2, 2, 2, 2, 3] and sh[6] in sh[:5]


def test_near_duplicates(spark, docs):
    rows = docs.select("doc_id", "text").collect()
    group = [rows[g].doc_id for g in classes([r.text for r in rows])]
    got = minhash.near_duplicates(docs).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == sorted((r.doc_id, g) for r, g in zip(rows, group))
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(group))
    assert minhash.near_duplicates(none_of(spark)).count() == 0 and minhash.keep_one(none_of(spark)).count() == 0


def test_near_duplicates_of_shared_and_null_ids(spark):
    t = [" ".join(vocabulary(k, 30)) for k in (41, 42, 43)]
    rows = [(1, t[0], "p"), (1, t[1], "p"), (1, t[1], "o"), (2, t[0], "p"), (None, t[2], "p"), (None, t[2], "p"), (3, "", "p"), (3, "", "p"), (4, None, "p"), (5, t[2] + " end", "p")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = sorted(map(str, map(tuple, minhash.near_duplicates(frame).collect())))
    assert got == sorted(map(str, [(1, 1, 1)] * 3 + [(2, 1, 1), (None, 5, None), (None, 5, None), (3, 3, 3), (3, 3, 3), (4, 4, 4), (5, 5, 5)]))
    kept = sorted(map(str, map(tuple, minhash.keep_one(frame).collect())))
    assert kept == sorted(map(str, [rows[0], rows[2], rows[4], rows[5], rows[6], rows[7], rows[8], rows[9]]))


@pytest.mark.parametrize(("n", "own", "common"), [(300, 9, 204), (1000, 60, 200)])
def test_near_duplicates_of_one_form(spark, n, own, common):
    """Many texts of one form, just under the threshold, with pairs above it; buckets hold hundreds."""
    r, words = random.Random(21), vocabulary(22, 5000)
    form, rows = [r.choice(words) for _ in range(common)], []
    for i in range(n // 2 if own > 9 else n):  # the two texts of a pair are similar, all others less than 0.8
        both = [r.choice(words) for _ in range(own)]
        rows += [(k * n + i, " ".join(form + both + [r.choice(words) for _ in range(22)])) for k in (0, 1)]
    rows.sort()
    group = [rows[g][0] for g in classes([t for _, t in rows])]
    assert len(set(group)) == len(rows) // 2
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and {x.doc_id: x.component_id for x in got} == {i: g for (i, _), g in zip(rows, group)}


def test_decontamination(spark, docs):
    item = vocabulary(77, 30)
    moved = item[15:] + ["between"] + item[:15]
    extra = [(500, "start " + " ".join(moved).upper() + " end"), (501, " ".join(item[:8])), (502, " ".join(item) + " tail")]
    frame = docs.select("doc_id", "text").unionAll(spark.createDataFrame(extra, "doc_id long, text string"))
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, ""), (4, "a b")], "item_id long, text string")
    got = decontam.contaminated(frame, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(500, 1), (502, 1)}
    assert decontam.drop_contaminated(frame, bench).count() == frame.count() - 2
    assert decontam.tiles(np.arange(12, dtype=np.uint64), np.concatenate([np.arange(6, 12), [99], np.arange(6)]).astype(np.uint64)) == [(0, 7, 6), (6, 0, 6)]


def naive_tiles(item, doc, least):
    """Greedy string tiling word by word."""
    a, b, out = [True] * len(item), [True] * len(doc), []
    while True:
        best, found = least - 1, []
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and a[i + n] and b[j + n]:
                    n += 1
                if n > best:
                    best, found = n, []
                if n == best and n >= least:
                    found.append((i, j, n))
        if not found:
            return out
        for i, j, n in found:
            if all(a[i : i + n]) and all(b[j : j + n]):
                a[i : i + n], b[j : j + n] = [False] * n, [False] * n
                out.append((i, j, n))


def test_tiling_by_single_words():
    r = random.Random(9)
    for _ in range(150):
        item, doc = ([r.randrange(5) for _ in range(r.randint(0, n))] for n in (14, 30))
        got = decontam.tiles(np.array(item, dtype=np.uint64), np.array(doc, dtype=np.uint64), 3)
        assert sorted(got) == sorted(naive_tiles(item, doc, 3))


def test_contaminated_by_brute_force(spark):
    r, words = random.Random(10), vocabulary(91, 12)
    items = [(i, " ".join(r.choice(words) for _ in range(r.randint(1, 12)))) for i in range(25)] + [(90, items_text := "a b"), (91, items_text), (92, None), (93, "")]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randint(1, 60))), "x") for i in range(80)] + [(500, "A, b!", "x"), (501, "a b c", "x"), (502, None, "x"), (503, "", "x"), (1, "dup", "x")]
    for i, t in items[:10]:  # items inside documents, in two parts
        w = t.split()
        rows.append((600 + i, " ".join(["start", *w[len(w) // 2 :], "mid", *w[: len(w) // 2], "end"]), "x"))
    want = set()
    for d, t, _ in rows:
        doc = [x for x in ("".join(filter(str.isalnum, w)).lower() for w in (t or "").split()) if x]
        for i, q in items:
            item = (q or "").split()
            if not item:
                continue
            own = naive_tiles(item, doc, decontam.MIN_MATCH)
            if sum(x[2] for x in own) >= decontam.COVERAGE * len(item) or len(item) < decontam.MIN_MATCH and item == doc:
                want.add((d, i))
    frame = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contaminated(frame, bench).collect()
    assert {(x.doc_id, x.item_id) for x in got} == want and len(got) == len(want) > 5
    kept = decontam.drop_contaminated(frame, bench)
    assert kept.columns == frame.columns and sorted(x.doc_id for x in kept.collect()) == sorted(d for d, t, _ in rows if not any(w[0] == d for w in want))
    assert decontam.contaminated(frame.where("false"), bench).count() == 0 and decontam.contaminated(frame, bench.where("false")).count() == 0
    assert decontam.drop_contaminated(frame, bench.where("false")).count() == len(rows)


def test_secrets(spark):
    base = re.compile(r"""((?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", re.I)
    rows = [(1, "é token = 'abcdef123' x", "o1"), (2, "password: token: abcdef", "o1"), (3, None, None), (4, "", "o2"), (5, "AKIA" + "B" * 16 + " " + "0f" * 15, "o2"), (6, "Xk29fPq81LmZ0aa7Rt55", "o1")] + [(10 + i, "zZ91fPq81LmZ0aa7Rt55", f"o{i}") for i in range(4)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    from pyspark.sql import functions as F

    got = {r.doc_id: r for r in secrets.scan(frame, F.col("source"), F.col("source")).collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        want = [(m.start(), m.end()) for m in base.finditer(t or "") if len(m[2]) >= 6]
        assert [(s.start, s.end) for s in got[i].base if s.kind == 0] == want
    assert [(s.kind, s.start, s.end) for s in got[5].base] == [(1, 0, 20), (2, 21, 51)]
    assert len(got[6].extra) == 1 and not got[10].extra  # narrow and wide ownership
    clean = {r.doc_id: r.text for r in secrets.mask_secrets(frame, F.col("source"), F.col("source")).collect()}
    assert clean[1] == "é [secret]' x" and clean[3] is None and clean[10] == rows[6][1] and clean[6] == "[secret]"


def test_packing(spark, docs):
    got = packing.pack(docs, default_tokenizer(), length=256).collect()
    tok = encoder(default_tokenizer()).tokenizer
    want = {}
    for r in docs.select("doc_id", "text").distinct().collect():
        want[r.doc_id] = np.array(tok.encode(r.text or "", add_special_tokens=False).ids + [1], dtype="<u4")
    places = {}
    for r in got:
        ids = want[r.doc_id]
        assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids)
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 256
    copies = {r.doc_id: r["count"] for r in docs.groupBy("doc_id").count().collect()}
    assert sum(r.length for r in got) == sum(len(want[k]) * n for k, n in copies.items())
    assert packing.pack(none_of(spark), default_tokenizer()).count() == 0


def test_cutting_stock():
    rng = np.random.default_rng(8)
    demand = np.append(rng.integers(0, 40, 31), 0)
    patterns, times = packing.cutting_stock(demand, 32)
    sizes = np.arange(1, 33)
    assert ((patterns * times[:, None]).sum(axis=0) == demand).all() and (patterns @ sizes).max() <= 32
    bins = []  # first-fit decreasing, item by item
    for size in np.repeat(sizes, demand)[::-1].tolist():
        at = next((i for i, room in enumerate(bins) if room >= size), None)
        if at is None:
            bins.append(32 - size)
        else:
            bins[at] -= size
    assert np.ceil((demand * sizes).sum() / 32) <= times.sum() <= len(bins)


def test_pipeline_small(spark, sf):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, sf).count() > 0


def test_secrets_null_ids_repositories_and_long_texts(spark):
    from pyspark.sql import functions as F

    token = "Zk29fPq81LmZ0aa7Rt55"
    rows = [(None, "password: hunter22 " + token, "o1", "en"), (None, "x", "o1", "en"), (1, "secret = abcdefgh AKIA" + "B" * 20, "o2", "en"), (1, "secret = abcdefgh AKIA" + "B" * 20, "o2", "en")]
    rows += [(10 + i, "wide9In2Repositories77", "o1", f"l{i}") for i in range(secrets.WIDE_REPOSITORIES)]  # one owner, many repositories
    long = "".join(f"password={i:07d} é " for i in range(3000))
    rows.append((99, long, "o3", "en"))
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = secrets.scan(frame, F.concat_ws("/", "source", "lang"), F.col("source")).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    null = next(r for r in got if r.doc_id is None and r.base)
    assert null.n_live == 2 and [(s.start, s.end) for s in null.extra] == [(19, 39)]
    assert all(not by_id[10 + i].extra for i in range(secrets.WIDE_REPOSITORIES))
    assert [(s.start, s.end) for s in by_id[99].base if s.kind == 0] == [(19 * i, 19 * i + 16) for i in range(3000)]
    masked = {r.doc_id: r.text for r in secrets.mask_secrets(frame, F.col("lang"), F.col("source")).collect()}
    assert masked[99] == "[secret] é " * 3000 and masked[1] == "[secret] [secret]"
    assert secrets.scan(frame.where("false"), F.col("lang"), F.col("source")).count() == 0
    assert secrets.mask_secrets(frame.where("false"), F.col("lang"), F.col("source")).columns == frame.columns
