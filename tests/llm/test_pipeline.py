"""Each stage of the pipeline against brute force, on rows with nulls, empties, repeats and benchmark passages."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from erloom.llm import decontam, langid
from erloom.llm.tokens import default_tokenizer, encoder

from .test_llm import classes, naive_tiles, vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, band string, node long"
BASE = re.compile(r"""((?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", re.I)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(31)
    tongues = {"aa": vocabulary(51, 300), "bb": [w + "ö" for w in vocabulary(52, 300)]}
    items = [" ".join(r.choice(tongues["aa"]) for _ in range(25)) for _ in range(4)]
    rows = []
    for i in range(120):
        lang = ("aa", "bb")[i % 2]
        rows.append((i, " ".join(r.choice(tongues[lang]) for _ in range(r.randint(20, 120))), lang, f"s{i % 5}"))
    rows += [(200 + i, rows[i][1] + " end", "aa", "s1") for i in range(0, 20, 4)] + [(300, rows[1][1], "bb", "s2"), rows[2], rows[2]]
    rows += [(400 + i, " ".join(["say", *q.split()[12:], "and", *q.split()[:12]]), "aa", "s3") for i, q in enumerate(items)]
    rows += [(500, rows[5][1] + " password = hunter2hunter2 x", "bb", "s4"), (501, rows[7][1][::-1] + " AKIA" + "C" * 17, "bb", "s0")]
    rows += [(600, None, "aa", "s1"), (601, "", "aa", "s1"), (602, "123 !!", None, None), (603, "two words", None, None), (None, rows[9][1], "bb", "s1"), (604, " ".join(r.choice(tongues["aa"]) for _ in range(5000)), "aa", "s2")]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(*x, len(x[1] or ""), "b", 1) for x in rows], SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def key(row):
    return tuple(map(str, row))


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "near_duplicates", "decontamination", "secret_masking", "packing"]

    model, rows = langid.fit(docs), docs.collect()
    best, score, _ = model.predict(pa.array([x.text or "" for x in rows], pa.large_string()))
    want = [x for x, b, s in zip(rows, best, score) if b >= 0 and s >= langid.SURE]
    first = stages["language"](spark, docs, tables)
    got = first.collect()
    assert first.columns == docs.columns and sorted(map(key, got)) == sorted(map(key, want)) and {600, 601, 602}.isdisjoint(x.doc_id for x in got)

    known = sorted((x for x in got if x.doc_id is not None), key=lambda x: x.doc_id)
    group, kept = classes([x.text for x in known]), {}
    for x, g in zip(known, group):
        kept.setdefault(g, x)
    second = stages["near_duplicates"](spark, first, tables)
    got = second.collect()
    assert second.columns == docs.columns and sorted(map(key, got)) == sorted(map(key, [*kept.values(), *(x for x in rows if x.doc_id is None)]))

    items = [x.text.split() for x in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    holds = lambda t: any(sum(p[2] for p in naive_tiles(q, t.split(), decontam.MIN_MATCH)) >= decontam.COVERAGE * len(q) for q in items)
    want = [x for x in got if len(x.text) > 4000 or not holds(x.text)]
    third = stages["decontamination"](spark, second, tables)
    found = third.collect()
    assert third.columns == docs.columns and sorted(map(key, found)) == sorted(map(key, want)) and len(found) < len(got)

    fourth = stages["secret_masking"](spark, third, tables)
    got = {x.doc_id: x for x in fourth.collect()}
    assert fourth.columns == docs.columns and len(got) == len(found)
    for x in found:
        plain = BASE.sub(lambda m: "[secret]" if len(m[2]) >= 6 else m[0], x.text)
        plain = re.sub(r"AKIA[A-Z0-9]{16,}", "[secret]", plain)
        assert got[x.doc_id].text == plain and got[x.doc_id].n_chars == len(plain)

    pieces = stages["packing"](spark, fourth, tables).collect()
    tok = encoder(default_tokenizer()).tokenizer
    size = {i: len(tok.encode(x.text, add_special_tokens=False).ids) + 1 for i, x in got.items()}
    assert {p.doc_id: p.doc_tokens for p in pieces} == size and sum(p.length for p in pieces) == sum(size.values())
    filled = {}
    for p in pieces:
        filled[p.sequence_id] = filled.get(p.sequence_id, 0) + p.length
    assert max(filled.values()) <= 2048 and len(filled) <= np.ceil(1.1 * sum(size.values()) / 2048) + 1

    run = corpus_pipeline.run(spark, tables)
    assert sorted(map(key, run.collect())) == sorted(map(key, pieces))


def test_empty_table(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet").where("false")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{tables}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
