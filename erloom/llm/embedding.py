"""Near-duplicate vectors by sorted projection passes.

In each pass every vector gets a key of concatenated random hashes (signs of projections), vectors are ordered
lexicographically by key, and each is compared with a bounded window of neighbours. Verified pairs of all passes
are united into components. How many passes are made follows from the number of vectors, and further rounds of
passes follow until one joins hardly any components, since dense groups crowd the windows. Inside a dense group, found on a
bounded sample, keys are taken from what a vector has beside the group's mean, so that they tell its members apart.
Inside a component all members are then compared in square tiles, one task each, so the number of links is exact for
every pair that shares a component, however large a dense group is."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, release, staged, table

COSINE = 0.95
BITS, WINDOW = 64, 24
#: Passes of a round, whose rows are ordered together.
ROUND = 8
#: Share of the pairs at the threshold that the planned passes show, where vectors lie at random.
PLANNED = 0.99
#: Further rounds are made until one finds at most so many links between components, as a share of the linked vectors.
SETTLED = 0.005
#: Passes compare in single precision; a pair this near the threshold is decided in double precision.
MARGIN = 1e-5
SEED = 20_011
#: Vectors that are sampled for the means of dense groups; a group has at least LEAST of them, each at a cosine of NEAR
#: or more to another one.
SAMPLE, LEAST, NEAR = 2048, 8, 0.6
#: Vectors on a side of a tile: a sixteenth of the component, inside these bounds.
TILES, LEAST_TILE, MOST_TILE = 16, 64, 4096


def planned_passes(n: int, window: int = WINDOW, cosine: float = COSINE) -> int:
    """Passes that bring a pair at the threshold into a window with probability PLANNED among n random vectors.

    A sign agrees with probability p = 1 - angle / pi, and with 1/2 for unrelated vectors, so neighbours in a window of
    n sorted keys share about log2(n / window) signs, and a pass shows the pair with (n / window) ** log2(p)."""
    p = 1 - math.acos(min(cosine, 1.0)) / math.pi
    shown = max(1.0, n / window) ** math.log2(p)
    return max(1, math.ceil(math.log(1 - PLANNED) / math.log(max(1e-12, 1 - min(shown, 0.999)))))


def _matrix(col: pa.Array) -> np.ndarray:
    """Binary float64 vectors of one length."""
    return np.frombuffer(b"".join(col.to_pylist()), dtype=np.float64).reshape(len(col), -1)


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors in double precision and a digest of the raw components; null for vectors that link with nothing."""
    for batch in batches:
        units, sums = [], []
        for v in batch.column("embedding").to_pylist():
            units.append(None)
            sums.append(None)
            if not v or any(x is None for x in v):
                continue
            x = np.array(v, dtype=np.float64)
            top = np.abs(x).max()
            if not np.isfinite(top) or top == 0:
                continue
            raw = x + 0.0
            x = x / top
            sums[-1] = hashlib.md5(raw.tobytes()).hexdigest()
            units[-1] = (x / np.sqrt(x @ x)).tobytes()
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(sums, pa.string()), pa.array(units, pa.binary())], ["vec_id", "digest", "unit"])


def dense_means(units: list[bytes]) -> dict[int, np.ndarray]:
    """By length of vector, the means of the dense groups of a sample of unit vectors: sampled vectors that hang
    together at a cosine of NEAR or more, LEAST of them at least."""
    out = {}
    for size in sorted({len(u) for u in units}):
        x = np.array([np.frombuffer(u, dtype=np.float64) for u in units if len(u) == size])
        near = x @ x.T >= NEAR
        group = np.arange(len(x))
        while True:  # the smallest index that is reached
            low = np.where(near, group[None, :], len(x)).min(axis=1)
            if (low == group).all():
                break
            group = low
        names, n = np.unique(group, return_counts=True)
        means = [x[group == g].mean(axis=0) for g, k in zip(names, n, strict=True) if k >= LEAST]
        if means:
            out[size // 8] = np.array(means)
    return out


def _keys(first: int, passes: int, held):
    """Keys of the passes from `first` on. One in four takes the vector itself; the others take, where it lies near the
    mean of a dense group, the group and what the vector has beside that mean."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            sizes = np.array([len(u) // 8 for u in batch.column("unit").to_pylist()])
            for d in np.unique(sizes):
                own = batch.take(pa.array(np.flatnonzero(sizes == d)))
                if d not in planes:
                    planes[d] = np.concatenate([np.random.default_rng([SEED, int(d), first + p]).standard_normal((int(d), BITS)) for p in range(passes)], axis=1)
                x, group = _matrix(own.column("unit")), np.full(len(own), -1)
                single = pa.array([v.tobytes() for v in x.astype(np.float32)], pa.binary())
                beside, means = x, held.value.get(int(d))
                if means is not None:
                    cos = x @ (means / np.linalg.norm(means, axis=1)[:, None]).T
                    at = cos.argmax(axis=1)
                    group = np.where(cos.max(axis=1) >= NEAR, at, -1)
                    beside = np.where(group[:, None] >= 0, x - means[at], x)
                for p in range(passes):
                    plain = (first + p) % 4 == 0
                    signs = np.packbits((x if plain else beside) @ planes[d][:, p * BITS : (p + 1) * BITS] > 0, axis=1)
                    name = np.zeros(len(own), dtype=">u4") if plain else (group + 1).astype(">u4")
                    key = [int(d).to_bytes(4, "big") + g.tobytes() + k.tobytes() for g, k in zip(name, signs, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), p, dtype=np.int32)), pa.array(key, pa.binary()), own.column("node"), single], ["pass", "key", "node", "unit"])

    return run


def _near(passes: np.ndarray, nodes: np.ndarray, units: list[bytes], window: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of at least `cosine` among rows at most `window` apart in one pass and of one length: (pairs, whether each is
    beyond doubt). Pairs that hang together over nearer ones already are left out, so a dense run of rows gives about as
    many pairs as it has rows; who links with whom is counted in tiles afterwards."""
    found, sure, at = [np.zeros((0, 2), dtype=np.int64)], [np.zeros(0, dtype=bool)], 0
    sizes = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
    ends = np.flatnonzero((passes[1:] != passes[:-1]) | (sizes[1:] != sizes[:-1])) + 1
    for to in [*ends.tolist(), len(units)]:
        m = np.frombuffer(b"".join(units[at:to]), dtype=np.float32).reshape(to - at, -1)
        own, group = nodes[at:to], np.arange(to - at)
        for k in range(1, min(window, to - at - 1) + 1):
            cos = np.einsum("ij,ij->i", m[:-k], m[k:])
            near = np.flatnonzero((cos >= cosine - MARGIN) & (group[:-k] != group[k:]))
            if not len(near):
                continue
            certain = cos[near] >= cosine + MARGIN
            found.append(np.stack([own[near], own[near + k]], axis=1))
            sure.append(certain)
            a, b = near[certain], near[certain] + k
            while (group[a] != group[b]).any():  # the smaller name of two that meet, until none changes
                low = np.minimum(group[a], group[b])
                names = np.arange(to - at)
                np.minimum.at(names, group[a], low)
                np.minimum.at(names, group[b], low)
                group = names[group]
        at = to
    both, certain = np.concatenate(found), np.concatenate(sure)
    apart = both[:, 0] != both[:, 1]
    return np.sort(both[apart], axis=1), certain[apart]


_COMPARED = ["x", "y", "sure", "pass", "key", "node", "unit"]
_SCHEMA = "x long, y long, sure boolean, pass int, key binary, node long, unit binary"


def _compare(window: int, cosine: float):
    """Pairs (x, y, sure), and the first and last `window` rows of the task, which neighbour those of other tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail, seen = [], 0

        def border(rows: list) -> pa.RecordBatch:
            kinds = (("pass", pa.int32()), ("key", pa.binary()), ("node", pa.int64()), ("unit", pa.binary()))
            cols = [pa.nulls(len(rows), k) for k in (pa.int64(), pa.int64(), pa.bool_())] + [pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds)]
            return pa.RecordBatch.from_arrays(cols, _COMPARED)

        def pairs(both: np.ndarray, sure: np.ndarray) -> pa.RecordBatch:
            none = [pa.nulls(len(both), k) for k in (pa.int32(), pa.binary(), pa.int64(), pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(sure), *none], _COMPARED)

        for batch in batches:
            new = list(zip(*(batch.column(c).to_pylist() for c in ("pass", "key", "node", "unit")), strict=True))
            if seen < window:
                yield border(new[: window - seen])
            seen += len(new)
            rows = tail + new
            if rows:
                yield pairs(*_near(np.array([r[0] for r in rows]), np.array([r[2] for r in rows], dtype=np.int64), [r[3] for r in rows], window, cosine))
            tail = rows[-window:]
        if seen > window:
            yield border(tail[-min(window, seen - window) :])

    return run


def _tile(cosine: float, step: int = 1024):
    """Numbers of linked copies of a tile's members: of side 0 with side 1, or among side 0 if that is all."""

    def run(key, rows):
        side = np.asarray(rows.column("side"))
        ids, n = np.asarray(rows.column("node")), np.asarray(rows.column("copies"))
        units = rows.column("unit").combine_chunks()
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        same = not len(b)
        b = a if same else b
        x, y = _matrix(units.take(pa.array(a))), _matrix(units.take(pa.array(b)))
        links_a, links_b = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
        for i in range(0, len(a), step):
            for j in range(0, len(b), step):
                close = x[i : i + step] @ y[j : j + step].T >= cosine
                if same:
                    close[ids[a[i : i + step]][:, None] == ids[b[j : j + step]][None, :]] = False
                links_a[i : i + step] += close @ n[b[j : j + step]]
                links_b[j : j + step] += close.T @ n[a[i : i + step]]
        out = (ids[a], links_a) if same else (np.concatenate([ids[a], ids[b]]), np.concatenate([links_a, links_b]))
        return pa.table({"node": pa.array(out[0]), "links": pa.array(out[1])})

    return run


def _decide(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            close = [np.frombuffer(a, dtype=np.float64) @ np.frombuffer(b, dtype=np.float64) >= cosine for a, b in zip(batch.column("ux").to_pylist(), batch.column("uy").to_pylist(), strict=True)]
            yield batch.select(["x", "y"]).filter(pa.array(close, pa.bool_()))

    return run


def _shown(reps: DataFrame, first: int, held, cosine: float, window: int) -> DataFrame:
    """(x, y): links that the passes from `first` on show."""
    keyed = reps.select("node", "unit").mapInArrow(_keys(first, ROUND, held), "pass int, key binary, node long, unit binary")
    order = ["pass", "key", "node"]
    found = staged(keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_compare(window, cosine), _SCHEMA), "compared")
    # the window rows at each task's two ends, in one order a pass: neighbours across the ends of tasks
    ends = found.where("x is null").select("pass", "key", "node", "unit").repartition("pass").sortWithinPartitions(*order)
    every = found.unionAll(ends.mapInArrow(_compare(window, cosine), _SCHEMA)).where("x is not null").groupBy("x", "y").agg(F.max("sure").alias("sure"))
    every = staged(every, "pairs")
    release(found)
    unit = lambda k: reps.select(F.col("node").alias(k), F.col("unit").alias(f"u{k}"))
    doubt = every.where("not sure").join(unit("x"), "x").join(unit("y"), "y").select("x", "y", "ux", "uy").mapInArrow(_decide(cosine), "x long, y long")
    return every.where("sure").select("x", "y").unionAll(doubt)


def _linked(reps: DataFrame, n: int, cosine: float, window: int) -> DataFrame | None:
    """Stars (node, component) of the links that passes show; None without any.

    After the planned passes, each further round counts the links that it shows between components."""
    spark = reps.sparkSession
    sample = reps.select("unit").orderBy(F.xxhash64("node", F.lit(5)), "node").limit(SAMPLE).collect()  # bounded
    held = spark.sparkContext.broadcast(dense_means([bytes(r.unit) for r in sample]))
    plan = planned_passes(n, window, cosine)
    links = _shown(reps, 0, held, cosine, window)
    for first in range(ROUND, plan, ROUND):
        links = links.unionAll(_shown(reps, first, held, cosine, window))
    first = ROUND * max(1, -(-plan // ROUND))
    stars = staged(components(links, "x", "y"), "stars")
    while True:
        side = lambda k: stars.select(F.col("node").alias(k), F.col("component").alias(f"c{k}"))
        new = _shown(reps, first, held, cosine, window).join(side("x"), "x", "left").join(side("y"), "y", "left")
        new = new.select(F.coalesce("cx", "x").alias("x"), F.coalesce("cy", "y").alias("y")).where("x <> y").distinct()
        new = staged(new, "new")
        joined, known, first = new.count(), stars.count(), first + ROUND
        if joined:
            own = stars.where("node <> component").select(F.col("node").alias("x"), F.col("component").alias("y"))
            stars = staged(components(own.unionAll(new), "x", "y"), "stars")
        if joined <= SETTLED * known:
            return stars if known + joined else None


def near_vectors(vectors: DataFrame, cosine: float = COSINE, window: int = WINDOW) -> DataFrame:
    """(vec_id, n_links, component_id) of every row of vectors (vec_id, embedding; other columns are ignored).

    Null, empty and zero vectors and those with null or non-finite components have no links and are components of
    their own; vectors of different lengths never link. Equal vectors are one representative with a count, so a
    group of copies costs one vector; repeated rows count as copies, and vectors that share a vec_id are rows of their
    own. A pair at exactly `cosine` in double precision links. An empty table gives no rows."""
    node = F.xxhash64("digest")
    rows = staged(vectors.select("vec_id", "embedding").mapInArrow(_unit, "vec_id long, digest string, unit binary"), "vectors")
    reps = staged(rows.where("digest is not null").groupBy("digest").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"), F.first("unit").alias("unit")).select(node.alias("node"), "vec_id", "copies", "unit"), "representatives")
    n = reps.count()
    alone = rows.where("digest is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    groups = _linked(reps, n, cosine, window) if n else None
    own = rows.where("digest is not null").select("vec_id", node.alias("node"))
    if groups is None:
        copies = reps.select("node", "copies", F.col("vec_id").alias("component_id"))
        return own.join(copies, "node").select("vec_id", (F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).unionAll(alone)
    # members of a component in blocks, blocks in tiles
    tile = F.least(F.greatest(F.ceil(F.count("*") / TILES), F.lit(LEAST_TILE)), F.lit(MOST_TILE))
    size = groups.groupBy("component").agg(F.ceil(F.count("*") / tile).cast("int").alias("blocks"))
    member = groups.join(staged(size, "sizes"), "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = member.select("node", "component", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    placed = placed.select("node", "component", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), F.when(F.col("block") <= F.col("other"), 0).otherwise(1).alias("side"))
    tiles = placed.join(reps.select("node", "copies", "unit"), "node")
    counts = tiles.groupBy("component", "lo", "hi").applyInArrow(_tile(cosine), "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))
    first = groups.join(reps.select("node", "vec_id"), "node").groupBy("component").agg(F.min("vec_id").alias("component_id"))
    placed = groups.join(first, "component").join(counts, "node", "left").select("node", "component_id", "links")
    found = staged(reps.select("node", "vec_id", "copies").join(placed, "node", "left").select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")), "found")
    return own.join(found, "node").select("vec_id", "n_links", F.coalesce("component_id", "vec_id").alias("component_id")).unionAll(alone)


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at a cosine of 0.95 or more."""
    return near_vectors(table(spark, sf_dir, "embeddings")).withColumn("kept", F.col("vec_id") == F.col("component_id"))
