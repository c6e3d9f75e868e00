"""Features, learners and decisions of the chain against plain Python on the fixture."""

import re
import shutil
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from erloom.functions import similarity as sim
from erloom.operators import baseline, blocking, chain, decide, features, locale, models, rescue, synthetic
from erloom.plans.registry import QUERIES, opened

SHIFTS = {3, 4, 5, 7, 9, 11, 13, 21}


@pytest.fixture(scope="module")
def t(spark, sf):
    return opened(spark, sf).store.table


def one(f, a, b):
    return float(f([a], [b])[0])


def numbers(address):
    return [n.lstrip("0") or "0" for n in re.findall(r"\d+", address or "")]


def test_odd_features_by_plain_python(spark, sf, t):
    scores = QUERIES["scored_pairs"](spark, sf)
    decoys, new = ({r.country: set(r.words) for r in decide.by_country(t(x)).collect()} for x in ("decoys", "replacements"))
    rec, ent = ({r.eid: r for r in t(x).collect()} for x in ("qt", "st"))
    pairs = scores.collect()
    best = {}
    for r in sorted(pairs, key=lambda r: (-r.p, r.s1)):
        best.setdefault(r.rid, r)
    sibs = defaultdict(list)
    for r in best.values():
        if r.p >= 0.5:
            sibs[r.s1].append(r)
    got = {(r.rid, r.s1): r for r in QUERIES["odd_features"](spark, sf).collect()}
    assert len(got) == sum(r.p >= 0.001 for r in pairs)
    matched = lambda w, other: len(w) >= 4 and w in "".join(other) or any(one(sim.ratio, w, o) >= 80 for o in other)
    real = lambda w: len(w) >= 2 and not w.isdigit() and w not in features.LEGAL_WORDS and w not in features.STOP_WORDS
    for r in pairs[::3]:
        if r.p < 0.001:
            continue
        q, s, o = rec[r.rid], ent[r.s1], got[r.rid, r.s1]
        near = [(x, rec[x.rid]) for x in sibs[r.s1] if x.rid != r.rid]
        qw, sw = q.name_core.split(), s.name_core.split()
        added = [w for w in dict.fromkeys(qw) if w not in sw and real(w) and not matched(w, sw)]
        removed = [w for w in dict.fromkeys(sw) if w not in qw and real(w) and not matched(w, qw)]
        qn, sn = numbers(q.address), numbers(s.address)
        held = set().union(*(numbers(x.address) for _, x in near)) if near else set()
        assert o.o_n5 == len(near) and o.o_n9 == sum(x.p >= 0.9 for x, _ in near)
        assert (o.o_add_n, o.o_rem_n) == (len(added), len(removed))
        assert o.o_add_unsup == sum(all(w not in x.name_core.split() for _, x in near) for w in added)
        assert o.o_rem_kept == (sum(all(w in x.name_core.split() for _, x in near) for w in removed) if near else None)
        assert o.o_qx_sib == sum(n in held for n in set(qn) - set(sn))
        assert o.o_veto == any(w in decoys.get(q.country, ()) and w not in sw for w in qw if len(w) >= 3 and w.isalpha())
        assert o.o_l2 == any(w in new.get(q.country, ()) for w in added if len(w) >= 3)
        if near:
            top = max(one(sim.ratio, q.name_core, x.name_core) for _, x in near)
            assert o.o_name_sib == pytest.approx(top, abs=1e-5) and o.o_name_rel == pytest.approx(top - one(sim.ratio, q.name_core, s.name_core), abs=1e-5)
            assert o.o_addr_sib == pytest.approx(max(one(sim.ratio, q.address, x.address) for _, x in near), abs=1e-5)
        else:
            assert o.o_name_sib is None and o.o_addr_rel is None


def test_relative_features_by_plain_python(spark, sf, t):
    rows = defaultdict(list)
    for r in features.fuzzy_features(t("cand"), t("qt"), t("st")).collect():
        rows[r.rid].append(r)
    got = {(r.rid, r.s1): r for r in QUERIES["relative_features"](spark, sf).collect()}
    for group in rows.values():
        for r in group:
            o = got[r.rid, r.s1]
            assert o.combined == pytest.approx(r.name_token_set + r.address_token_set, abs=1e-5)
            assert o.name_jw_gap == pytest.approx(r.name_jw - max(x.name_jw for x in group), abs=1e-5)
            assert o.name_ratio_rank == 1 + sum(x.name_ratio > r.name_ratio for x in group)


def test_replacement_words_by_plain_python(t):
    rec, ent, owner = ({r.eid: r for r in t("qt").collect()}, {r.eid: r for r in t("st").collect()}, {r.rid: r.s1 for r in t("truth").collect()})
    decoys = {(r.country, r.w) for r in t("decoys").collect()}
    n = defaultdict(lambda: [0, 0])
    for c in t("cand").where("rk = 1").collect():
        if c.s1 % 20 == 0 or owner.get(c.rid, c.s1) != c.s1:
            continue
        q, s = rec[c.rid], ent[c.s1]
        qw, sw = q.name_full.split(), s.name_full.split()
        if any((q.country, w) in decoys and w not in sw for w in qw):
            continue
        for w in set(decide.new_words([q.name_full], [s.name_full])[0]):
            n[q.country, w][c.rid in owner] += len(w) >= 3
    want = {(c, w, d, k) for (c, w), (d, k) in n.items() if d >= 2 and k <= 0.002 * d}
    assert {tuple(r) for r in t("replacements").collect()} == want


def test_chain_beats_the_plain_owner(spark, sf, t):
    linked = QUERIES["link_all"](spark, sf).cache()
    assert linked.count() == linked.select("rid").distinct().count()
    entities, truth = t("st"), t("truth")
    score = lambda d: chain.metric(d, truth, entities, chain.DECOY_WEIGHT).first()
    plain = features.best_of_record(t("cand").select("rid", "s1", F.col("score").alias("p")))
    assert score(linked).f05 > score(plain).f05 + 0.1 and score(linked).f05_weighted > 0.8
    auc = [models.ranking(t("stage2"), p=p).first() for p in ("p", "p2")]
    assert min(r.auc for r in auc) > 0.9 and min(r.average_precision for r in auc) > 0.9


def test_ranking_and_precision_by_plain_python(spark):
    rng = np.random.default_rng(5)
    p = np.round(rng.random(500), 2)
    y = (rng.random(500) < p).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y)], "p double, label int")
    r = models.ranking(df).first()
    above = (p[y == 1][:, None] > p[y == 0][None, :]).mean() + (p[y == 1][:, None] == p[y == 0][None, :]).mean() / 2
    precision = {v: y[p >= v].mean() for v in set(p)}
    assert r.auc == pytest.approx(above, abs=1e-6) and r.positives == y.sum()
    assert r.average_precision == pytest.approx(sum(precision[v] for v, k in zip(p, y) if k) / y.sum(), abs=1e-6)
    for row in models.precision_recall(df, [0.3, 0.8]).collect():
        hit = p >= row.threshold
        assert (row.tp, row.fp, row.fn) == ((hit & (y == 1)).sum(), (hit & (y == 0)).sum(), (~hit & (y == 1)).sum())


def test_guard_sibling_and_changes(spark):
    scores = spark.createDataFrame([(1, 10, 0.9, 0.8), (1, 11, 0.2, 0.1), (2, 10, 0.9, 0.1), (2, 11, 0.3, 0.7), (3, 12, 0.4, 0.3)], "rid long, s1 long, p double, p_guard double")
    got = {r.rid: (r.s1, r.p) for r in chain.guarded_owners(scores, F.col("rid") < 3).collect()}
    assert got == {1: (10, 0.8), 2: (10, 0.0), 3: (12, 0.4)}
    big = 2 * features.SOURCE
    kept = spark.createDataFrame([(big + 1, 5, 0.9, 1), (big + 2, 5, 0.9, 0), (big + 3, 5, 0.96, 0), (big + 4, 6, 0.5, 0), (2 * big, 5, 0.5, 0), (big + 6, 5, 0.5, None)], "rid long, s1 long, p double, fne int")
    assert sorted(r.rid for r in chain.sibling_rule(kept).collect()) == [big + 1, big + 3, big + 4, big + 6, 2 * big]
    frame = lambda rows: spark.createDataFrame(rows, "rid long, s1 long")
    out = chain.apply_changes(frame([(1, 1), (2, 2)]), frame([(2, 2)]), frame([(2, 9), (2, 8), (1, 8), (3, 77)]), spark.createDataFrame([(8,), (9,)], "eid long"))
    assert sorted(map(tuple, out.collect())) == [(1, 1), (2, 8)]


NAMES = "eid long, country string, name_core string, name_full string, address string"


def texts(spark, rows):
    return features.tokens(spark.createDataFrame(rows, NAMES))


def test_vetoes(spark):
    e = [(100 + i, "x", f"alpha bakery w{i}", f"alpha bakery w{i}", "1 rue a") for i in range(60)] + [(200 + i, "x", f"garage delta v{i}", f"garage delta v{i}", "2 rue b") for i in range(60)]
    st = texts(spark, [*e, (1, "x", "omega bakery", "omega bakery", "5 rue c")])
    qt = texts(spark, [(11, "x", "omega garage", "omega garage", "5 rue c"), (12, "x", "omega bakery", "omega bakery", "5 rue c"), (13, "x", "omega bakeri", "omega bakeri", "5 rue c")])
    owners = features.with_texts(spark.createDataFrame([(11, 1, 0.9), (12, 1, 0.9), (13, 1, 0.9)], "rid long, s1 long, p double"), qt, st)
    assert [r.rid for r in decide.swapped(owners, st).collect()] == [11]
    types = decide.type_words(st)
    assert {"bakery", "garage", "alpha", "delta"} == {r.w for r in types.where("n > 1").collect()} - {"omega"}
    assert [r.rid for r in decide.type_swaps(owners, types).collect()] == [11]


def test_families(spark):
    st = texts(spark, [(1, "x", "omega shop", "omega shop", "10 rue c")])
    qt = texts(spark, [(21, "x", "omega shop", "omega shop", "17 rue c"), (22, "x", "omega palace", "omega palace", "10 rue c"), (23, "x", "omega shop", "omega shop", "19 rue c"), (24, "x", "omega shop", "omega shop", "19 rue c")])
    pairs = features.with_texts(spark.createDataFrame([(21, 1, 0.9), (22, 1, 0.2), (23, 1, 0.9), (24, 1, 0.9)], "rid long, s1 long, p1 double"), qt, st)
    words = spark.createDataFrame([("x", "palace")], "country string, w string")
    got = {r.rid: (r["shift"], r["replacement"], r["promoted"]) for r in chain.families(pairs, words).collect()}
    assert got == {21: (True, False, False), 22: (False, True, True), 23: (False, False, False), 24: (False, False, False)}


def test_rescue_by_hand(spark):
    st = texts(spark, [(1, "x", "blue ocean traders", "blue ocean traders ltd", "12 harbour rd"), (2, "x", "kelvin logistics", "kelvin logistics inc", "7 main st pune"), (3, "x", "other house", "other house", "99 lake view rd")])
    qt = texts(spark, [(31, "x", "blueoceantraders", "blueoceantraders", "12 harbour rd"), (32, "x", "kelvn logistics", "kelvn logistics", "7 main st"), (33, "x", "zzzz", "zzzz", "99 lake view rd"), (34, "x", "unknown wordy", "unknown wordy", "")])
    none = spark.createDataFrame([], "rid long, s1 long")
    got = {r.rid: r for r in rescue.selected(qt, st, none).collect()}
    assert {k: v.s1 for k, v in got.items()} == {31: 1, 32: 2, 33: 3}
    assert "cat" in got[31].family and "typo" in got[32].family and "aexact" in got[33].family
    again = rescue.selected(qt, st, spark.createDataFrame([(31, 1)], "rid long, s1 long"))
    assert 31 not in {r.rid for r in again.collect()}
    f = {r.rid: r for r in rescue.acceptance_features(rescue.selected(qt, st, none).select("rid", "s1", "family"), qt, st).collect()}
    assert f[31].name_ratio == pytest.approx(200 * 16 / 35) and f[33].address_missing == 0 and f[32].fam_typo == 1


def test_locale_rules(spark):
    region = "12 rue du lac"
    st = texts(spark, [(1, "france", "boulangerie martin", "boulangerie martin sarl", region), (2, "france", "cafe lune", "cafe lune", "5 av foch"), (3, "france", "alpha beta conseil", "alpha beta conseil", "8 rue verte")])
    qt = texts(spark, [(41, "france", "boulangerie martin", "boulangerie martin", region), (42, "france", "cafe lune fils", "cafe lune fils", "5 av foch"), (43, "france", "abc", "abc", "8 rue verte"), (44, "france", "cafe lune", "cafe lune", "71 av foch")])
    scores = spark.createDataFrame([(41, 1, 0.9, 0.5), (42, 2, 0.6, 0.6), (43, 3, 0.3, 0.3), (44, 2, 0.7, 0.7)], "rid long, s1 long, p double, p_guard double")
    none, cand = spark.createDataFrame([], "rid long, s1 long"), scores.select("rid", "s1")
    found = locale.proposals(qt, st, scores, none, cand, rare_df=1)
    assert {r.rid: (r.s1, r.rule) for r in found.collect()} == {41: (1, "A3"), 42: (2, "A1"), 43: (3, "R5"), 44: (2, "N1")}
    review = locale.reviewed(qt, st, scores, none, found)
    got = {r.rid: r.rule for r in locale.additions(found, review, scores, st).collect()}
    assert got == {41: "A3", 42: "A1A2_noise", 43: "R5A5", 44: "N1"}
    assert locale.removals(review, least=1).count() == 0


def test_locale_removals_and_partial_filter(spark):
    st = texts(spark, [(1, "france", "martin coiffure", "martin coiffure", "1 rue a"), (2, "france", "martin boulanger", "martin boulanger", "2 rue b"), (3, "france", "soleil france", "soleil france", "3 rue c")])
    qt = texts(spark, [(51, "france", "martin garage", "martin garage", "9 rue a"), (52, "france", "martin garage", "martin garage", "2 rue b"), (53, "france", "soleil france", "soleil france france", "4 rue c"), (54, "france", "martin coiffure", "martin coiffure", "1 rue a")])
    scores = spark.createDataFrame([(51, 1, 0.6), (52, 2, 0.9), (53, 3, 0.9), (54, 1, 0.9)], "rid long, s1 long, p double")
    own = scores.where("rid > 51").select("rid", "s1")
    review = locale.reviewed(qt, st, scores, own, spark.createDataFrame([], "rid long, s1 long, rule string"))
    raw = spark.createDataFrame([(53, "soleil france france"), (3, "soleil france"), (54, "martin"), (1, "martin")], "eid long, name string")
    assert {(r.rid, r.rule) for r in locale.removals(review, raw, least=1).collect()} == {(52, "R1_typeswap"), (53, "R2_dupfrance")}
    pair = lambda *rows: spark.createDataFrame(list(rows), "rid long, s1 long")
    got = locale.partial_filter(pair((51, 1), (53, 3), (52, 2)), pair((54, 1), (52, 2)), qt, st)
    assert {tuple(r) for r in got.collect()} == {(51, 1, "new"), (52, 2, "new"), (54, 1, "restored")} - ({(51, 1, "new")} if "diff_addr" in {r.verdict for r in decide.reviewed(features.with_texts(pair((51, 1)), qt, st)).collect()} else set())
    gate = locale.change_gate(pair((54, 1), (51, 1)), qt, st, True, 1.0).first()
    assert (gate.n, gate.verdict_share) == (2, 0.5) and not gate["pass"]
    pool = spark.createDataFrame([(54, 1, 0.97), (51, 1, 0.99), (52, 2, 0.5)], "rid long, s1 long, ce double")
    assert [r.rid for r in locale.rescue_gate(pool, qt, st, pair((53, 3))).collect()] == [54]


def test_simple_matcher(spark, sf, t):
    ranks = baseline.ranked(t("cand"), t("qt"), t("st"))
    rows = ranks.collect()
    group = defaultdict(list)
    for r in rows:
        score = 1000 * (r.name1 == r.name2 != "") + 800 * (r.address1 == r.address2 != "") + 100 * (len(r.name1) >= 4 and len(r.name2) >= 4 and r.name1[:4] == r.name2[:4]) + 50 * (len(r.address1) >= 5 and len(r.address2) >= 5 and r.address1[:5] == r.address2[:5])
        assert r.cheap_score == score
        group[r.s1, r.source].append((-score, r.rid, r.cheap_rank))
    assert all([x[2] for x in sorted(g)] == list(range(1, len(g) + 1)) for g in group.values())
    for r in baseline.reranked(ranks).collect()[::7]:
        x = next(x for x in rows if (x.rid, x.s1) == (r.rid, r.s1))
        alike = lambda a, b: one(sim.ratio, a, b) if a and b else 0.0
        assert r.sim == pytest.approx(0.7 * alike(x.name1, x.name2) + 0.3 * alike(x.address1, x.address2), abs=1e-5)
    sample = baseline.sampled_pairs(ranks, t("truth"))
    features_ = baseline.pair_features(sample)
    assert set(baseline.FEATURES) <= set(features_.columns) and sample.where("label = 1").count() == Counter((r.rid, r.s1) in {(x.rid, x.s1) for x in t("truth").collect()} for r in rows)[True]
    scored = baseline.classified(features_, rounds=5, depth=3)
    assert scored.count() == sample.where("part = 'valid'").count() and models.ranking(scored).first().auc > 0.9
    best = baseline.best_matches(t("cand").select("rid", "s1"), t("qt"), t("st"), 2)
    assert best.groupBy("rid").count().where("count > 2").count() == 0 and best.where("ratio < 40").count() == 0
    sweep = {r.threshold: r for r in baseline.macro_sweep(scored.select("rid", "s1", "p"), t("truth"), t("st"), [0.2, 0.9]).collect()}
    assert sweep[0.2].predicted >= sweep[0.9].predicted
    assert sum(r.n for r in baseline.rank_ranges(ranks, t("truth")).collect()) == sum(r.covered for r in baseline.coverage(t("cand"), t("truth")).collect())


def test_synthetic_pairs(spark, t):
    e = t("st").select("eid", "name_full", "address")
    rows = synthetic.generated(e).collect()
    by_id = {r.eid: r for r in e.collect()}
    assert len(rows) == len(by_id) and {r.change for r in rows} == {*synthetic.DECOYS, *synthetic.COPIES}
    for r in rows:
        x = by_id[r.s1]
        if r.change == "shift":
            assert int(r.address.split()[0]) - int(x.address.split()[0]) in SHIFTS and r.label == 0
        if r.change == "glue":
            assert r.name.replace(" ", "") == x.name_full.replace(" ", "")
        if r.change == "noaddr":
            assert r.address == ""
        if r.change in synthetic.DECOYS:
            assert r.label == 0 and (r.name, r.address) != (x.name_full, x.address)
    assert {tuple(r) for r in rows} == {tuple(r) for r in synthetic.generated(e.repartition(7)).collect()}


def test_reverse_additions_fit_no_model_that_they_do_not_need(spark, sf, tmp_path):
    shutil.copy(f"{sf}/part.parquet", tmp_path)
    found = QUERIES["reverse_accept"](spark, str(tmp_path)).collect()
    assert found == [] and not {"stage1", "stage2", "final"} & set(opened(spark, str(tmp_path)).store.frames)


def test_reverse_additions_are_those_with_all_scores_made_first(t):
    found = t("cand")
    cand = found.where("rid % 3 = 0")
    scores = found.select("rid", "s1", (F.col("rid") % 10 / 20.0).alias("p"))
    plain = chain.reverse_accepted(chain.reverse_pairs(found, cand, scores, t("qt"), t("st")), t("truth"), 1.0)
    made = chain.reverse_additions(found, cand, lambda: scores, t("qt"), t("st"), t("truth"), 1.0)
    want = sorted(map(tuple, plain.collect()))
    assert want and sorted(map(tuple, made.collect())) == want


def test_reverse_additions_make_keys_once_for_both_sides(spark, sf, tmp_path, monkeypatch):
    shutil.copy(f"{sf}/part.parquet", tmp_path)
    asked, keys = [], blocking.keys
    monkeypatch.setattr(blocking, "keys", lambda texts: asked.append(texts) or keys(texts))
    QUERIES["reverse_accept"](spark, str(tmp_path)).collect()
    assert len(asked) == 2
    store = opened(spark, str(tmp_path)).store
    for how in ({}, {"per": "s1", "other": "rid", "top": 20}):
        anew = sorted(map(tuple, blocking.block(store.table("qt"), store.table("st"), **how).collect()))
        assert anew and sorted(map(tuple, blocking.ranked(*store.keyed(), **how).collect())) == anew
