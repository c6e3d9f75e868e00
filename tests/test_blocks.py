"""The simple blocks against brute force."""

from collections import Counter

import duckdb

from erloom.operators import blocking
from erloom.plans.registry import ORACLES, QUERIES, opened


def test_blocks(spark, sf):
    store = opened(spark, sf).store
    q, s1 = (store.table(x).selectExpr("eid", "country", "name_core AS name", "name_words", "address_words").collect() for x in ("qt", "st"))
    near = [(a, b) for a in q for b in s1 if a.country == b.country]
    want = {(a.eid, b.eid) for a, b in near if len(b.name) >= 4 and a.name[:4] == b.name[:4]}
    assert {(r.rid, r.s1) for r in QUERIES["prefix_block"](spark, sf).collect()} == want
    hit = {(a.eid, b.eid, "prefix") for a, b in near if a.name and a.name[:3] == b.name[:3]}
    known = {r for r, _, _ in hit}
    want = hit | {(a.eid, b.eid, "country") for a, b in near if a.name and a.eid not in known}
    assert {(r.rid, r.s1, r.how) for r in QUERIES["prefix_block_fallback"](spark, sf).collect()} == want
    want = set()
    for col in ("name_words", "address_words"):
        n = Counter(w for a in q for w in set(a[col]) if len(w) >= 4)
        want |= {(a.eid, b.eid) for a, b in near if any(n[w] <= 500 for w in set(a[col]) & set(b[col]) if len(w) >= 4)}
    assert {(r.rid, r.s1) for r in QUERIES["rare_token_block"](spark, sf).collect()} == want


def test_fallback_looks_no_pair_up_and_takes_keys_that_repeat(spark, tmp_path):
    names = ["blue box", "red pen", "red cup", "a b", "old jar"]
    rows = [(k % 40, names[k % 5], f"Brand#{k % 3}", None if k % 17 == 0 else f"type {k % 2 + k // 40}", k % 7, 1.0) for k in range(100)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    found = QUERIES["prefix_block_fallback"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{tmp_path}/part.parquet/*.parquet')")
    want = con.execute(ORACLES["prefix_block_fallback"]).fetchall()
    assert {w[2] for w in want} == {"prefix", "country"} and sorted(map(tuple, found.collect())) == sorted(want)
    todo, anti = [found._jdf.queryExecution().optimizedPlan()], []
    while todo:
        node = todo.pop()
        todo += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Join" and node.joinType().toString() == "LeftAnti":
            anti.append(node.right().toString())
    assert anti and not any("Join Inner" in right for right in anti)


def test_prefix_block_takes_little_space_for_its_rows(spark, tmp_path):
    names = spark.range(4000).selectExpr("id AS p_partkey", "CASE WHEN id % 50 = 0 THEN 'red pen' WHEN id % 70 = 0 THEN 'a b' ELSE 'blue box' END AS p_name", "'Brand#1' AS p_brand", "CASE WHEN id % 90 > 0 THEN concat('type ', id % 16 div 15) END AS p_type", "cast(id % 7 as int) AS p_size", "1.0D AS p_retailprice")
    names.unionAll(names.where("p_partkey < 40")).write.parquet(f"{tmp_path}/part.parquet")
    QUERIES["prefix_block"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{tmp_path}/part.parquet/*.parquet')")
    con.execute(f"CREATE TABLE found AS SELECT rid, s1 FROM read_parquet('{tmp_path}/out/*.parquet')")
    con.execute(f"CREATE TABLE want AS {ORACLES['prefix_block']}")
    rows = con.execute("SELECT count(*) FROM want").fetchone()[0]
    assert rows > 5_000_000 and con.execute("SELECT count(*) FROM found").fetchone()[0] == rows
    assert not con.execute("(FROM found EXCEPT ALL FROM want) UNION ALL (FROM want EXCEPT ALL FROM found) LIMIT 5").fetchall()
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 0.2 * rows


def test_whole_blocks_are_the_join(spark):
    left = spark.createDataFrame([(k if k % 7 else None, f"c{k % 3}" if k % 5 else None) for k in range(90)], "rid long, c string")
    right = spark.createDataFrame([(k // 2 if k % 6 else None, f"c{k % 4}") for k in range(700)], "s1 long, c string")
    key = lambda d: sorted(map(repr, map(tuple, d.collect())))
    assert key(blocking.whole_blocks(left, right, ["c"])) == key(left.join(right, "c").select("rid", "s1"))
    assert not blocking.whole_blocks(left.limit(0), right, ["c"]).collect()


def test_prefix_block_fallback_takes_little_space_for_its_rows(spark, tmp_path):
    names = spark.range(4000).selectExpr("id AS p_partkey", "CASE WHEN id % 50 = 0 THEN 'red pen' WHEN id % 70 = 0 THEN 'a b' WHEN id % 3 = 0 THEN 'old jar' ELSE 'blue box' END AS p_name", "'Brand#1' AS p_brand", "CASE WHEN id % 90 > 0 THEN concat('type ', id % 16 div 15) END AS p_type", "cast(id % 7 as int) AS p_size", "1.0D AS p_retailprice")
    names.unionAll(names.where("p_partkey < 40")).write.parquet(f"{tmp_path}/part.parquet")
    QUERIES["prefix_block_fallback"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{tmp_path}/part.parquet/*.parquet')")
    con.execute(f"CREATE TABLE found AS SELECT rid, s1, how FROM read_parquet('{tmp_path}/out/*.parquet')")
    con.execute(f"CREATE TABLE want AS {ORACLES['prefix_block_fallback']}")
    rows = dict(con.execute("SELECT how, count(*) FROM want GROUP BY how").fetchall())
    assert min(rows["prefix"], rows["country"]) > 1_000_000 and dict(con.execute("SELECT how, count(*) FROM found GROUP BY how").fetchall()) == rows
    assert not con.execute("(FROM found EXCEPT ALL FROM want) UNION ALL (FROM want EXCEPT ALL FROM found) LIMIT 5").fetchall()
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 0.25 * sum(rows.values())
