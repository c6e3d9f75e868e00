"""Secret scanning with corpus-wide ownership frequency, in DataFrame functions only.

Patterns give candidate spans; each candidate's value is hashed, and hashes are counted over the whole corpus by
distinct repositories and owners. A value that many owners hold is a copied example; one that stays with few
owners is a live-looking credential. Generic tokens, too weak a sign by themselves, become spans only where their
ownership is narrow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table

# fixed values: the three kinds of the query's contract, in its order
_WORDS = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
ASSIGN = rf"""({_WORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"(AKIA[A-Z0-9]{16,})"
HEX = r"([0-9a-f]{24,})"
#: The method's own kind: a run of token characters with digits among letters.
TOKEN = r"([A-Za-z0-9+/_-]{20,})"
KINDS = ("assign", "access", "hex", "token")
#: From so many distinct owners, or so many distinct repositories, a value counts as a widely copied example.
WIDE_OWNERS, WIDE_REPOSITORIES = 3, 5
#: A generic token needs so many digits, letters and distinct characters.
TOKEN_DIGITS, TOKEN_LETTERS, TOKEN_DISTINCT = 3, 3, 10
MASK = "[secret]"

#: Elements of a block that a fold builds at once.
FOLD = 128
_SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def _before(array: Column, zero: Column, value, combine) -> Column:
    """For each element, what an associative `combine` makes of the values of all elements before it.

    Two levels of blocks, so that no fold copies an array longer than a block or the number of blocks."""
    n = F.size(array)
    blocks = F.transform(F.sequence(F.lit(0), F.greatest((n - 1).cast("int"), F.lit(0)), F.lit(FOLD)), lambda i: F.slice(array, i + 1, FOLD))
    kind = zero.cast("int")

    def scanned(items: Column, start: Column, of) -> Column:
        state = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(items, state, lambda s, x: F.struct(combine(s["at"], of(x)).cast("int").alias("at"), F.array_append(s["out"], s["at"]).alias("out")), lambda s: s["out"])

    totals = F.transform(blocks, lambda b: F.aggregate(b, kind, lambda acc, x: combine(acc, value(x)).cast("int")))
    starts = scanned(totals, kind, lambda x: x)
    return F.flatten(F.transform(F.arrays_zip(blocks.alias("b"), starts.alias("s")), lambda z: scanned(z["b"], z["s"], value)))


def _spans(text: Column, pattern: str, kind: int, group: int, keep) -> Column:
    """Leftmost non-overlapping matches in code points; keep(value) says which stay. The texts between matches
    and the matches themselves give the places, so no match is searched for twice."""
    gaps, hits, values = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    pieces = F.slice(F.arrays_zip(F.transform(gaps, F.length).alias("g"), F.transform(hits, F.length).alias("h"), values.alias("v")), F.lit(1), F.size(hits))
    at = _before(pieces, F.lit(0), lambda x: x["g"] + x["h"], lambda a, b: a + b)
    kept = F.filter(F.arrays_zip(pieces.alias("p"), at.alias("at")), lambda z: keep(z["p"]["v"]))
    found = F.transform(kept, lambda z: F.struct((z["at"] + z["p"]["g"]).alias("start"), F.lit(kind).alias("kind"), (z["at"] + z["p"]["g"] + z["p"]["h"]).alias("end"), z["p"]["v"].alias("value")))
    return F.when(text.rlike(pattern), found).otherwise(F.array()).cast(_SPAN)


def _apart(base: Column, loose: Column) -> Column:
    """Those of the loose spans that overlap no base span: of all in order of their start, the base spans before end by
    the loose span's start, and those after start at its end or later."""
    both = F.array_sort(F.concat(base, loose))
    back = F.reverse(both)
    ended = _before(both, F.lit(0), lambda x: F.when(x["kind"] < 3, x["end"]).otherwise(0), F.greatest)
    begun = F.reverse(_before(back, F.lit(2**31 - 1), lambda x: F.when(x["kind"] < 3, x["start"]).otherwise(2**31 - 1), F.least))
    kept = F.filter(F.arrays_zip(both.alias("s"), ended.alias("ended"), begun.alias("begun")), lambda z: (z["s"]["kind"] == 3) & (z["ended"] <= z["s"]["start"]) & (z["begun"] >= z["s"]["end"]))
    return F.when(F.size(loose) == 0, F.array()).when(F.size(base) == 0, loose).otherwise(F.transform(kept, lambda z: z["s"])).cast(_SPAN)


def _token_like(v: Column) -> Column:
    count = lambda p: F.length(F.regexp_replace(v, p, ""))
    return (count("[^0-9]") >= TOKEN_DIGITS) & (count("[^A-Za-z]") >= TOKEN_LETTERS) & (F.size(F.array_distinct(F.split(v, ""))) >= TOKEN_DISTINCT)


def scan(docs: DataFrame, repository: Column, owner: Column) -> DataFrame:
    """(doc_id, text_hash, base, extra, n_live, n_copied) for each row of docs.

    base has all spans of the first three kinds; extra the owner-specific generic tokens that touch none of
    them; n_live and n_copied count the spans of both by the ownership of their values. A null text counts as
    empty, a null doc_id is an id like any other, and a null repository or owner is one of its own. Repeated rows are
    scanned once each and count once, as do all rows of one text under one id; other columns are ignored. No rows give
    no rows."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), text.alias("t"), F.coalesce(repository, F.lit("")).alias("repo"), F.coalesce(owner, F.lit("")).alias("owner"))
    t = F.col("t")
    base = F.concat(_spans(t, ASSIGN, 0, 2, lambda v: F.length(v) >= 6), _spans(t, ACCESS, 1, 1, lambda v: F.lit(True)), _spans(t, HEX, 2, 1, lambda v: F.lit(True)))
    rows = rows.select("doc_id", "text_hash", "repo", "owner", F.array_sort(base).alias("base"), _spans(t, TOKEN, 3, 1, _token_like).alias("loose"))
    rows = rows.withColumn("extra", _apart(F.col("base"), F.col("loose"))).drop("loose")
    rows = staged(rows, "spans")
    each = rows.where(F.size("base") + F.size("extra") > 0).select("doc_id", "text_hash", "repo", "owner", F.explode(F.concat("base", "extra")).alias("s"))
    each = each.select("doc_id", "text_hash", "repo", "owner", "s", F.sha2(F.col("s.value"), 256).alias("h"))
    held = each.select("h", "owner", "repo").distinct()
    known = staged(held.groupBy("h").agg(F.countDistinct("owner").alias("owners"), F.countDistinct("repo").alias("repos")), "owners")
    judged = each.drop("repo", "owner").distinct().join(known, "h")
    live = ((F.col("owners") < WIDE_OWNERS) & (F.col("repos") < WIDE_REPOSITORIES)).alias("live")
    judged = judged.select("doc_id", "text_hash", "s", live).where("s.kind < 3 or live")
    extra = judged.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(F.when(F.col("s.kind") == 3, F.col("s")))).alias("found"), F.count_if("live").alias("n_live"), F.count_if(~F.col("live")).alias("n_copied"))
    none = F.array().cast(_SPAN)
    extra = extra.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "found", "n_live", "n_copied")
    with_spans = F.size("base") + F.size("extra") > 0
    own = rows.where(with_spans).select("doc_id", "text_hash", "base")
    joined = own.join(extra, own["doc_id"].eqNullSafe(F.col("_id")) & (own["text_hash"] == F.col("_hash")), "left").drop("_id", "_hash")
    rest = rows.where(~with_spans).select("doc_id", "text_hash", "base", F.lit(None).cast(_SPAN).alias("found"), F.lit(None).cast("long").alias("n_live"), F.lit(None).cast("long").alias("n_copied"))
    return joined.unionAll(rest).select(
        "doc_id", "text_hash", "base", F.coalesce("found", none).alias("extra"), F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"), F.coalesce("n_copied", F.lit(0)).cast("long").alias("n_copied"))


def listed(spans: Column) -> Column:
    kind = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with each span, or run of spans that overlap, replaced by MASK. Null stays null."""
    ordered = F.array_sort(spans)
    covered = _before(ordered, F.lit(0), lambda x: x["end"], F.greatest)
    at = lambda z: text.substr(z["to"] + 1, z["s"]["start"] - z["to"])
    pieces = F.transform(F.filter(F.arrays_zip(ordered.alias("s"), covered.alias("to")), lambda z: z["s"]["start"] >= z["to"]), lambda z: F.concat(at(z), F.lit(MASK)))
    tail = text.substr(F.array_max(F.transform(spans, lambda x: x["end"])) + 1, F.length(text))
    return F.when(F.size(spans) > 0, F.concat(F.array_join(pieces, ""), tail)).otherwise(text)


def mask_secrets(docs: DataFrame, repository: Column, owner: Column) -> DataFrame:
    """The rows of docs, all columns, with their spans masked: those of the first three kinds, and generic tokens that
    stay with few owners and repositories. Other texts aren't changed and no row goes; null and empty texts stay as they
    are."""
    found = scan(docs, repository, owner).select("doc_id", "text_hash", F.concat("base", "extra").alias("_spans")).where(F.size("_spans") > 0).distinct()
    found = found.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "_spans")
    joined = docs.join(found, docs["doc_id"].eqNullSafe(F.col("_id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("_hash")), "left")
    text = masked(F.col("text"), F.coalesce("_spans", F.array().cast(_SPAN)))
    return joined.select(*[text.alias(c) if c == "text" else F.col(c) for c in docs.columns])


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in all documents; a source is an owner, its part in one language a repository."""
    found = scan(table(spark, sf_dir, "documents"), F.concat_ws("/", "source", "lang"), F.col("source"))
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.array_sort(F.concat("base", "extra"))).alias("spans"), "n_live", "n_copied")
