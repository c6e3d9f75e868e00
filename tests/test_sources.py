import pyarrow as pa
import pytest

from erloom.operators import models
from erloom.sources import io, store


def test_tsv_round_trip(spark, tmp_path):
    (tmp_path / "a.tsv").write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS2-12\t"Quoted" \\ name\t\tUS\nS3-7\tB\tnull\tIN\n')
    (tmp_path / "b.tsv").write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\nS2-1\tC\tx\tFR\n")
    rows = {r.eid: r for r in io.with_ids(io.read_tsv(spark, str(tmp_path / "a.tsv"))).collect()}
    assert rows[20000000012].business_name == '"Quoted" \\ name' and set(rows) == {20000000012, 30000000007}
    assert all(r.address_missing for r in rows.values())
    assert io.read_tsv(spark, str(tmp_path / "a.tsv"), str(tmp_path / "b.tsv")).count() == io.read_tsv(spark, str(tmp_path / "*.tsv")).count() == 3
    truth = spark.createDataFrame([("S1-1", "S2-1, S3-2"), ("S1-2", ""), ("S1-3", None)], "source1_entity_id string, matched_entity_ids string")
    assert sorted(map(tuple, io.read_truth(truth).collect())) == [("S1-1", "S2-1"), ("S1-1", "S3-2")]


def test_sorted_files_become_one(spark, tmp_path):
    df = spark.range(0, 5000, numPartitions=7).selectExpr("concat('S1-', lpad(id, 5, '0')) AS source1_entity_id", "'' AS matched_entity_ids")
    io.write_tsv(df, str(tmp_path / "parts"), "source1_entity_id")
    n = io.concatenate(spark, str(tmp_path / "parts"), str(tmp_path / "one.tsv"))
    lines = (tmp_path / "one.tsv").read_text().splitlines()
    assert n >= 1 and lines[0] == "source1_entity_id\tmatched_entity_ids" and lines[1:] == [f"S1-{i:05d}\t" for i in range(5000)]


def test_parquet_and_words(spark, tmp_path):
    io.write_parquet(spark.range(10).selectExpr("id", "id % 2 AS part"), str(tmp_path / "p"), "part")
    assert io.read_parquet(spark, str(tmp_path / "p")).where("part = 1").count() == 5
    io.write_parquet(spark.range(3), str(tmp_path / "x1"))
    io.write_parquet(spark.range(4), str(tmp_path / "x2"))
    assert io.read_parquet(spark, str(tmp_path / "x1"), str(tmp_path / "x2")).count() == io.read_parquet(spark, str(tmp_path / "x*")).count() == 7
    io.write_words({"US": ["x"]}, str(tmp_path / "w.json"))
    assert io.read_words(str(tmp_path / "w.json")) == {"US": ["x"]}


def test_places_follow_an_order(spark):
    df = spark.range(0, 1000, numPartitions=5).selectExpr("(id * 7919) % 1000 AS k", "id")
    got = io.with_place(df, "k").collect()
    assert sorted(r.pos for r in got) == list(range(1000)) and all(r.pos == r.k for r in got)


def test_batches_views_tables_and_changes(spark, tmp_path):
    out = io.in_batches(spark.range(100), lambda b: pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"]), "n long")
    assert sum(r.n for r in out.collect()) == 100
    io.register(spark, "in_memory", pa.table({"a": [1, 2, 3]}))
    assert spark.sql("SELECT sum(a) AS s FROM in_memory").first().s == 6
    io.write_parquet(spark.range(6), str(tmp_path / "t.parquet"))
    assert io.attach(spark, str(tmp_path), "w", "t") == ["w_t"] and spark.table("w_t").count() == 6
    dtypes, n, first = io.peek(spark.table("w_t"), 2)
    assert (dtypes, n, [r.id for r in first]) == ([("id", "bigint")], 6, [0, 1])
    io.write_changes(spark.createDataFrame([(1, 2)], "rid long, s1 long"), str(tmp_path / "c"))
    assert [tuple(r) for r in io.read_changes(spark, str(tmp_path / "c")).collect()] == [(1, 2, "")]
    (tmp_path / "one.txt").write_text("x")
    assert io.package(str(tmp_path), ["one.txt"], str(tmp_path / "z.zip")) == ["one.txt"]
    with pytest.raises(FileNotFoundError, match="two.txt"):
        io.package(str(tmp_path), ["one.txt", "two.txt"], str(tmp_path / "y.zip"))


def test_models_are_kept(spark, tmp_path):
    rows = spark.range(400).selectExpr("id AS rid", "id % 7 AS s1", "cast(id % 2 as int) AS label", "cast(id % 2 as double) + 0.1 AS a", "cast(null as double) AS b")
    model = models.fit_trees(rows, ["a", "b"], rounds=3, depth=2)
    models.save(model, str(tmp_path / "m"), ["a", "b"], threshold=0.7)
    again, meta = models.load(spark, str(tmp_path / "m"))
    assert meta == {"features": ["a", "b"], "threshold": 0.7}
    score = lambda m: sorted((r.rid, r.p) for r in models.score(m, rows, ["a", "b"]).select("rid", "p").collect())
    assert score(model) == score(again)


def test_a_store_follows_its_files(spark, tmp_path):
    part = "p_partkey long, p_type string, p_name string, p_brand string, p_size int"
    for n in (1, 2):
        spark.createDataFrame([(i, "T", "a b", "B#1", 3) for i in range(12 * n)], part).write.mode("overwrite").parquet(str(tmp_path / "part.parquet"))
        assert store.of(spark, str(tmp_path)).table("q").count() == 12 * n
