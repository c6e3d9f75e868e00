"""Token-id files coded by a static range asymmetric numeral system.

One frequency table over all ids is shared by all blocks. A block holds whole documents and is coded apart
from the others: its ids are cut into segments, a segment is dealt over LANES interleaved coder states, and the
state of every lane and the place in the word stream are stored at each segment's start as a checkpoint. A reader
starts at any block, and inside a block decodes all segments side by side; CRC-32 sums cover header and payload.

A file row is one block: part, block (place within the part), docs (ids of its documents), sizes (their token
counts), tokens, header and payload (bytes), crc (of both). Parts follow one another in ascending doc_id."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import chunks, scratch_path, small_batches, staged, table
from .tokens import default_tokenizer, encoder

END_ID = 0
#: Frequencies sum to 2 ** BITS.
BITS = 20
#: Lower bound of a coder state; states stay below 2 ** 63 and are renormalised by one 32-bit word at most,
#: which suffices since a word has more bits than a frequency.
LOW = 1 << 31
LANES, STEPS = 64, 128
#: A block ends with the document that reaches this many ids.
BLOCK_TOKENS = 1 << 18
#: Ids of each output part, about.
PART_TOKENS = 8_000_000


def scale(counts: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Counts to frequencies that sum to 2 ** bits, at least 1 for each id."""
    total, n = 1 << bits, len(counts)
    if n > total // 2:
        raise ValueError("too many ids for this precision")
    f = 1 + np.floor(counts.astype(np.float64) / max(1, counts.sum()) * (total - n)).astype(np.int64)
    f[np.argmax(f)] += total - f.sum()
    return f


class Coder:
    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """(header, payload). Each segment has LANES x STEPS ids, dealt to lanes in turn; the last may be short.

        All segments are coded side by side, last id first. Each writes its words backwards, so that a
        decoder reads them forwards."""
        per = LANES * STEPS
        segments = -(-len(ids) // per)
        # short of a full segment: the likeliest id fills up and is cut off again by the count
        fill = np.full(segments * per, int(np.argmax(self.freq)), dtype=np.int64)
        fill[: len(ids)] = ids
        grid = fill.reshape(segments, STEPS, LANES)
        x = np.full((segments, LANES), LOW, dtype=np.uint64)
        words, marks = [], []
        for step in range(STEPS - 1, -1, -1):
            f, s = self.freq[grid[:, step]], self.start[grid[:, step]]
            big = x >= (f << np.uint64(63 - BITS))
            words.append((x & np.uint64(0xFFFFFFFF)).astype(np.uint32))
            marks.append(big)
            x = np.where(big, x >> np.uint64(32), x)
            q = x // f
            x = (q << np.uint64(BITS)) + (x - q * f) + s
        # a decoder meets steps in order, and in each step the lanes in order
        w, m = np.stack(words[::-1], axis=1), np.stack(marks[::-1], axis=1)
        payload = w[m].astype("<u4").tobytes()
        sizes = m.reshape(segments, -1).sum(axis=1).astype("<u4")
        header = np.array([len(ids), segments], dtype="<u4").tobytes() + sizes.tobytes() + x.astype("<u8").tobytes()
        return header, payload

    def decode(self, header: bytes, payload: bytes) -> np.ndarray:
        n, segments = np.frombuffer(header, dtype="<u4", count=2)
        segments = int(segments)
        sizes = np.frombuffer(header, dtype="<u4", count=segments, offset=8).astype(np.int64)
        x = np.frombuffer(header, dtype="<u8", offset=8 + 4 * segments).reshape(segments, LANES).astype(np.uint64)
        words = np.append(np.frombuffer(payload, dtype="<u4"), 0).astype(np.uint64)
        at = np.cumsum(sizes) - sizes
        out = np.empty((segments, STEPS, LANES), dtype=np.uint32)
        low = np.uint64((1 << BITS) - 1)
        for step in range(STEPS):
            slot = x & low
            sym = self.symbol[slot]
            out[:, step] = sym
            x = self.freq[sym] * (x >> np.uint64(BITS)) + slot - self.start[sym]
            need = x < np.uint64(LOW)
            place = np.cumsum(need, axis=1)
            got = words[np.minimum(at[:, None] + place - 1, len(words) - 1)]
            x = np.where(need, (x << np.uint64(32)) | got, x)
            at += place[:, -1]
        return out.reshape(-1)[: int(n)]


_SCHEMA = "part int, block int, docs array<long>, sizes array<long>, tokens long, header binary, payload binary, crc long"


def _tokens(path: str):
    """doc_id, text -> doc_id and its ids, the end id included, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            for rows, texts in chunks(batch, limit=8_000_000):
                starts, ids = coder.encode(texts)
                full = np.full(len(ids) + len(texts), END_ID, dtype=ids.dtype)
                full[np.arange(len(ids)) + np.repeat(np.arange(len(texts)), np.diff(starts))] = ids
                ends = (starts + np.arange(len(starts))) * ids.itemsize
                held = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(full)])
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), held], ["doc_id", "ids"])

    return run


def _count(size: int, kind: np.dtype):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size, dtype=np.int64)
        for batch in batches:
            sums += np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), dtype=kind), minlength=size)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(sums[some])], ["id", "n"])

    return run


def _blocks(kind: np.dtype, freq):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part = Coder(freq.value), TaskContext.get().partitionId()
        docs, sizes, held, block = [], [], [], 0

        def flush() -> pa.RecordBatch:
            header, payload = code.encode(np.concatenate(held))
            row = [[part], [block], [docs], [sizes], [sum(sizes)], [header], [payload], [zlib.crc32(payload, zlib.crc32(header))]]
            kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], ["part", "block", "docs", "sizes", "tokens", "header", "payload", "crc"])

        tokens = 0
        for batch in batches:
            for name, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                own = np.frombuffer(ids.as_buffer(), dtype=kind)
                docs.append(name)
                sizes.append(len(own))
                held.append(own)
                tokens += len(own)
                if tokens >= BLOCK_TOKENS:
                    yield flush()
                    docs, sizes, held, block, tokens = [], [], [], block + 1, 0
        if docs:
            yield flush()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str) -> np.ndarray:
    """Write the ids of all docs (doc_id, text; null text: empty; other columns are ignored) to path, in ascending
    doc_id, each document's ids followed by END_ID. Returns the shared frequency table, also kept at path/table.

    Null ids come first; rows that share an id are ordered by a hash of their ids, and equal rows stand side by side. A
    block is as long as its last document makes it, so a very long text is one block. An empty table writes the
    table of equal frequencies and no block."""
    spark = docs.sparkSession
    coder = encoder(tokenizer)
    kind = coder.ids.dtype
    # a document is encoded once; its ids, shorter than its text, are what is counted and put in order
    tokens = staged(small_batches(docs).select("doc_id", "text").mapInArrow(_tokens(tokenizer), "doc_id long, ids binary"), "tokens")
    counted = tokens.select("ids").mapInArrow(_count(coder.size, kind), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # one row for each id
    counts = np.zeros(coder.size, dtype=np.int64)
    for i, n in counted:
        counts[i] = n
    freq = scale(counts)
    spark.createDataFrame([(i, int(f)) for i, f in enumerate(freq)], "id int, freq int").coalesce(1).write.parquet(f"{path}/table")
    parts = max(1, -(-int(counts.sum()) // PART_TOKENS))
    ordered = tokens.repartitionByRange(parts, "doc_id", F.xxhash64("ids")).sortWithinPartitions("doc_id", F.xxhash64("ids"))
    ordered.mapInArrow(_blocks(kind, spark.sparkContext.broadcast(freq)), _SCHEMA).write.option("compression", "none").parquet(f"{path}/blocks")
    return freq


def _read(freq):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Coder(freq.value)
        for batch in batches:
            for i in range(batch.num_rows):  # a row is a block
                row = batch.slice(i, 1).to_pylist()[0]
                if zlib.crc32(row["payload"], zlib.crc32(row["header"])) != row["crc"]:
                    raise ValueError(f"block {row['part']}/{row['block']} is damaged")
                ids = code.decode(row["header"], row["payload"]).astype("<u4")
                n = np.array(row["sizes"], dtype=np.int64)
                if len(ids) != row["tokens"] or n.sum() != row["tokens"]:
                    raise ValueError(f"block {row['part']}/{row['block']} has {len(ids)} ids")
                ends = np.cumsum(n)
                sums = [zlib.crc32(ids[b - k : b]) for b, k in zip(ends.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(row["docs"], pa.int64()), pa.array(ends - n + row["first"]), pa.array(n), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files at path, decoded and verified.

    Where a block starts follows from the token counts before it: summed by part, then inside each part."""
    freq = np.array([r[0] for r in spark.read.parquet(f"{path}/table").orderBy("id").select("freq").collect()], dtype=np.int64)
    blocks = spark.read.parquet(f"{path}/blocks")
    parts = blocks.groupBy("part").agg(F.sum("tokens").alias("t"))
    before = parts.select("part", (F.sum("t").over(W.orderBy("part")) - F.col("t")).alias("base"))
    place = blocks.select("part", "block", "tokens").withColumn("own", F.sum("tokens").over(W.partitionBy("part").orderBy("block")) - F.col("tokens"))
    place = place.join(before, "part").select("part", "block", (F.col("base") + F.col("own")).alias("first"))
    rows = blocks.join(place, ["part", "block"]).select("docs", "sizes", "tokens", "header", "payload", "crc", "first", "part", "block")
    return rows.mapInArrow(_read(spark.sparkContext.broadcast(freq)), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_ans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the ids of all documents, each ended by id 0, and read the files back, which go when the process ends."""
    path = scratch_path(spark, "ans")
    write_tokens(table(spark, sf_dir, "documents"), path, default_tokenizer())
    return read_tokens(spark, path)
