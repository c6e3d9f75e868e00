"""Candidate generation: key families, an inverted index weighted by rarity, top candidates with a ratio test.

Rows carry a 64-bit hash of country and key and a whole number as weight, so exchanges move three numbers a row. A pair
counts only with `ratio` of its record's best score, and few pairs come near it, so most matches of common keys are never
made: the rarest keys give each record a floor under its best score; keys that together weigh less than the floor's share
can't carry a pair by themselves, so they are looked up only for pairs that other keys have brought up. Nothing is lost:
what is left out can't reach the ratio."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from erloom.sources.store import staged

UNIGRAM_CAP, OTHER_CAP = 50, 500
TOP_K, RATIO = 10, 0.5
#: Scores are summed as integers, so that the order of addition can't change a rank.
SCALE = 1_000_000
#: Keys that at most so many entities hold give the floors.
RARE = 8
#: Texts whose keys a task makes.
TASK_TEXTS = 20_000
#: A whole block of two tables: ids of the records and of the entities in a chunk, and in a tile, rows of a task. Few entities
#: in a task make few bits of a code in a file; the runs of a record's id cost the same however many records there are.
CHUNK_RID, CHUNK_S1, TILE_RID, TILE_S1, TASK_ROWS = 1 << 15, 512, 32, 256, 1 << 24


def _pairs(words: str, kind: str) -> Column:
    """Neighbouring words, each pair in alphabetical order."""
    a = F.col(words)
    left, right = F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))), F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0)))
    return F.zip_with(left, right, lambda x, y: F.concat(F.lit(kind), F.least(x, y), F.lit("_"), F.greatest(x, y)))


def keys(texts: DataFrame) -> DataFrame:
    """(eid, country, tk, unigram) of texts (eid, country, name_core, name_words, address_words), distinct for each entity and never shuffled.

    Six families: n and a (words), N and A (neighbour pairs), C (the name without spaces), X (name word by address word)."""
    tagged = lambda kind: lambda w: F.concat(F.lit(kind), w)
    whole = F.when(F.length("name_core") >= 4, F.array(F.concat(F.lit("C"), F.replace("name_core", F.lit(" "), F.lit(""))))).otherwise(F.array().cast("array<string>"))
    cross = F.flatten(F.transform("name_words", lambda n: F.transform("address_words", lambda a: F.concat(F.lit("X"), n, F.lit("|"), a))))
    every = F.concat(F.transform("name_words", tagged("n")), F.transform("address_words", tagged("a")), _pairs("name_words", "N"), _pairs("address_words", "A"), whole, cross)
    each = texts.select("eid", "country", F.explode(F.array_distinct(every)).alias("tk"))
    return each.withColumn("unigram", F.substring("tk", 1, 1).isin("n", "a"))


def _rarity(hashed: DataFrame, entities: int) -> DataFrame:
    """(h, df, idf, w) of the keys that no more entities hold than their cap, which bounds the fan-out of every join."""
    cap = F.when(F.first("unigram"), UNIGRAM_CAP).otherwise(OTHER_CAP)
    df = hashed.groupBy("h").agg(F.count("*").alias("df"), cap.alias("cap")).where("df <= cap")
    idf = F.log(F.lit(float(entities)) / F.col("df"))
    return df.select("h", "df", idf.alias("idf"), F.round(idf * SCALE).cast("long").alias("w"))


def _hashed(of: DataFrame) -> DataFrame:
    return of.select(F.xxhash64("country", "tk").alias("h"), "eid", "tk", "unigram")


def index(of: DataFrame, entities: int) -> DataFrame:
    """(h, eid, tk, idf) of keys `of`, h being a hash of country and key, without the keys over their cap."""
    hashed = _hashed(of)
    return hashed.join(_rarity(hashed, entities), "h").select("h", "eid", "tk", "idf")


def keyed(query: DataFrame, of: DataFrame, entities: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What ranked() reads, of the keys of the records and of the entities: (h, rid), (h, s1) and (h, df, w)."""
    asked = staged(_hashed(query).select("h", F.col("eid").alias("rid")), "asked")
    held = staged(_hashed(of).select("h", F.col("eid").alias("s1"), "unigram"), "held")
    return asked, held.select("h", "s1"), staged(_rarity(held, entities).select("h", "df", "w"), "weights")


def candidates(query: DataFrame, of: DataFrame, entities: int, **how) -> DataFrame:
    """ranked() of the keys of the records (rid) and of the entities (s1)."""
    return ranked(*keyed(query, of, entities), **how)


def ranked(asked: DataFrame, held: DataFrame, weight: DataFrame, per: str = "rid", other: str = "s1", top: int = TOP_K, ratio: float = RATIO) -> DataFrame:
    """(rid, s1, score, nkeys, rk): the best `top` counterparts of each `per` with at least `ratio` of its best score.

    `per` may be either side; keyed() serves both. A pair without a common key, or without any under its cap, is no
    candidate; of equal scores the smaller id goes first."""
    own, far = (asked, held) if per == "rid" else (held, asked)
    own = own.join(weight, "h")
    floors = own.where(F.col("df") <= RARE).join(far, "h").groupBy(per, other).agg(F.sum("w").alias("w")).groupBy(per).agg(F.max("w").alias("floor"))
    # lightest first: a key with all that are lighter
    with_lighter = F.sum("w").over(W.partitionBy(per).orderBy("w", "h").rowsBetween(W.unboundedPreceding, W.currentRow))
    own = own.withColumn("weigh", with_lighter).join(floors, per, "left").withColumn("light", F.coalesce(F.col("weigh") < ratio * F.col("floor"), F.lit(False)))
    own = staged(own.select(per, "h", "w", "light", "floor"), "weighed")
    light = own.where("light")
    most = light.groupBy(per).agg(F.sum("w").alias("most"))
    hits = own.where("not light").join(far, "h").select(per, other, "w", "floor").repartition(per)
    found = hits.groupBy(per, other).agg(F.sum("w").alias("w"), F.count("*").alias("nkeys"), F.first("floor").alias("floor"))
    found = found.join(most, per, "left").where(F.col("w") + F.coalesce("most", F.lit(0)) >= ratio * F.coalesce("floor", F.lit(0))).select(per, other, "w", "nkeys")
    found = staged(found, "found")
    more = found.select(per, other).join(light.select(per, "h", F.col("w").alias("w2")), per).join(far, [other, "h"]).groupBy(per, other).agg(F.sum("w2").alias("w2"), F.count("*").alias("n2"))
    zero = F.lit(0).cast("long")
    whole = found.join(more, [per, other], "left").select("rid", "s1", (F.col("w") + F.coalesce("w2", zero)).alias("w"), (F.col("nkeys") + F.coalesce("n2", zero)).alias("nkeys"))
    near = whole.withColumn("best", F.max("w").over(W.partitionBy(per))).where(F.col("w") >= ratio * F.col("best"))
    best = near.withColumn("rk", F.row_number().over(W.partitionBy(per).orderBy(F.desc("w"), other)).cast("long")).where(F.col("rk") <= top)
    return best.select("rid", "s1", (F.col("w") / SCALE).alias("score"), "nkeys", "rk")


def block(query: DataFrame, entities: DataFrame, **how) -> DataFrame:
    """candidates() of two tables of texts."""
    return candidates(keys(query), keys(entities), entities.count(), **how)


def spread(texts: DataFrame) -> DataFrame:
    """texts dealt out, TASK_TEXTS in a part: a small file of texts has many keys, and one task would make them all."""
    return texts.repartition(texts.count() // TASK_TEXTS + 1)


def _chunks(ids: DataFrame, on: list[str], name: str, size: int) -> DataFrame:
    """The ids of each block in ascending order, `size` in a row."""
    place = F.row_number().over(W.partitionBy(*on).orderBy(name)) - 1
    gathered = F.sort_array(F.collect_list(F.struct(name)))  # a list of ids alone would leave nulls out
    return ids.select(*on, F.floor(place / size).alias("chunk"), name).groupBy(*on, "chunk").agg(F.transform(gathered, lambda x: x[name]).alias(name)).drop("chunk")


def _cut(ids: str, size: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(ids), F.lit(size)), lambda i: F.slice(ids, i, size))


def whole_blocks(query: DataFrame, entities: DataFrame, on: list[str]) -> DataFrame:
    """(rid, s1): every pair of query (rid, *on) and entities (s1, *on) that agree in `on`, as of an equi-join.

    The pairs are as many as the join's, but come tile by tile: a tile's rows are one record after another, each with the
    same few entities in the same order, so a file of them holds runs and repeats and takes a small part of the space.
    Until the tasks that return them, a pair is its share of two chunks of ids; tasks get tiles of about TASK_ROWS pairs."""
    count = lambda d, n: d.groupBy(*on).agg(F.count("*").alias(n))
    rows = count(query, "n").join(count(entities, "m"), on).agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0
    chunks = _chunks(query, on, "rid", CHUNK_RID).join(_chunks(entities, on, "s1", CHUNK_S1), on).select("rid", "s1").repartition(rows // TASK_ROWS + 1)
    # a cut is a lambda, which isn't fused with what follows, so no more than a tile is made ahead of the writer
    tiles = chunks.select("rid", F.explode(_cut("s1", TILE_S1)).alias("s1")).select(F.explode(_cut("rid", TILE_RID)).alias("rid"), "s1")
    return tiles.select(F.explode("rid").alias("rid"), "s1").select("rid", F.explode("s1").alias("s1"))
