"""Queries of the simple matcher, of reports and measures, of one country's rules and of synthetic pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from erloom.functions import text
from erloom.operators import baseline, features, locale, models, synthetic
from erloom.sources.fixtures import registry

from .dialect import Duck
from .fuzzy import like
from .registry import blocked, opened, query, scored, with_

_D = Duck()


def _tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    store = opened(spark, sf_dir).store
    return [store.table(n) for n in names]


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = opened(spark, sf_dir)
    return spark.sql(with_(d, scored(d)) + "SELECT rid, s1, p FROM scored")


_RANKS = """ranks AS (SELECT *, row_number() OVER (PARTITION BY s1, source ORDER BY cheap_score DESC, rid) AS cheap_rank FROM (
  SELECT c.rid, c.s1, c.rid // 10000000000 AS source, s.name_core AS name1, q.name_core AS name2, s.address AS address1, q.address AS address2,
    (CASE WHEN q.name_core = s.name_core AND q.name_core <> '' THEN 1000 ELSE 0 END + CASE WHEN q.address = s.address AND q.address <> '' THEN 800 ELSE 0 END
     + CASE WHEN least(length(q.name_core), length(s.name_core)) >= 4 AND starts_with(q.name_core, substr(s.name_core, 1, 4)) THEN 100 ELSE 0 END
     + CASE WHEN least(length(q.address), length(s.address)) >= 5 AND starts_with(q.address, substr(s.address, 1, 5)) THEN 50 ELSE 0 END)::BIGINT AS cheap_score
  FROM cand c JOIN q ON q.eid = c.rid JOIN s1 s ON s.eid = c.s1))"""


def _ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseline.ranked(*_tables(spark, sf_dir, "cand", "qt", "st"))


@query(with_(_D, blocked(_D), _RANKS) + "SELECT rid, s1, source, cheap_score, cheap_rank FROM ranks WHERE cheap_rank <= 300")
def cheap_score_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points for equal texts and beginnings, and the first 300 of each entity and source."""
    return _ranks(spark, sf_dir).where(F.col("cheap_rank") <= baseline.PRUNED).select("rid", "s1", "source", "cheap_score", "cheap_rank")


@query(with_(_D, blocked(_D), _RANKS) + "SELECT CASE WHEN cheap_rank <= 300 THEN '1-300' WHEN cheap_rank <= 500 THEN '301-500' WHEN cheap_rank <= 1000 THEN '501-1000' WHEN cheap_rank <= 2000 THEN '1001-2000' ELSE '2001+' END AS rank_range, count(*) AS n FROM ranks JOIN truth USING (rid, s1) GROUP BY 1")
def rank_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In which range of ranks the true pairs stand."""
    return baseline.rank_ranges(_ranks(spark, sf_dir), *_tables(spark, sf_dir, "truth"))


@query(with_(_D, blocked(_D), _RANKS, """lab AS (SELECT r.*, CASE WHEN t.rid IS NULL THEN 0 ELSE 1 END AS label FROM ranks r LEFT JOIN truth t ON t.rid = r.rid AND t.s1 = r.s1)""") + """
SELECT rid, s1, label, cheap_rank, CASE WHEN s1 % 5 = 0 THEN 'valid' ELSE 'train' END AS part FROM lab WHERE label = 1 AND cheap_rank <= 2000
UNION ALL SELECT rid, s1, 0, cheap_rank, CASE WHEN s1 % 5 = 0 THEN 'valid' ELSE 'train' END FROM (SELECT *, row_number() OVER (PARTITION BY s1, source ORDER BY cheap_rank, rid) AS i FROM lab WHERE label = 0 AND cheap_rank <= 300) WHERE i <= 100""")
def negative_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All true pairs to rank 2000 and up to 100 others to rank 300 of each entity and source."""
    found = baseline.sampled_pairs(_ranks(spark, sf_dir), *_tables(spark, sf_dir, "truth"))
    return found.select("rid", "s1", "label", "cheap_rank", "part")


@query(with_(_D, blocked(_D), _RANKS, like("SELECT name1 AS a, name2 AS b FROM ranks UNION SELECT address1, address2 FROM ranks")) + """
SELECT rid, s1, source, sim, r FROM (SELECT *, row_number() OVER (PARTITION BY s1, source ORDER BY sim DESC, rid) AS r FROM (
  SELECT k.rid, k.s1, k.source, max(round(0.7 * CASE WHEN name1 = '' OR name2 = '' THEN 0 ELSE n.r END + 0.3 * CASE WHEN address1 = '' OR address2 = '' THEN 0 ELSE d.r END, 6)) AS sim
  FROM ranks k JOIN ratio_ n ON n.a = name1 AND n.b = name2 JOIN ratio_ d ON d.a = address1 AND d.b = address2 GROUP BY ALL)) WHERE r <= 50""")
def weighted_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """0.7 of the name's and 0.3 of the address's ratio, the best 50 of each entity and source, repeats by their best."""
    return baseline.reranked(_ranks(spark, sf_dir))


@query()
def best_match_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten names most like a record's among those that begin alike, from a ratio of 40 on."""
    qt, st = _tables(spark, sf_dir, "qt", "st")
    key = lambda df, k: df.select(F.col("eid").alias(k), "country", F.substring("name_core", 1, 3).alias("start")).where("start <> ''")
    return baseline.best_matches(key(qt, "rid").join(key(st, "s1"), ["country", "start"]), qt, st)


@query()
def simple_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 24 features of the simple matcher."""
    return baseline.pair_features(_ranks(spark, sf_dir)).select("rid", "s1", *baseline.FEATURES)


@query()
def simple_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out probabilities of the simple matcher: classes at equal weight, early stopping."""
    rows = baseline.pair_features(baseline.sampled_pairs(_ranks(spark, sf_dir), *_tables(spark, sf_dir, "truth")))
    return baseline.classified(rows).select("rid", "s1", "label", "p")


_GRID = "(VALUES (0.3::DOUBLE), (0.5), (0.7), (0.9)) g(threshold)"


@query(with_(_D, scored(_D), "hit AS (SELECT s.s1, threshold, count(*) AS n, count(t.rid) AS tp FROM scored s CROSS JOIN " + _GRID + " LEFT JOIN truth t ON t.rid = s.rid AND t.s1 = s.s1 WHERE p >= threshold GROUP BY ALL)",
             "n_true AS (SELECT s1, count(*) AS t FROM truth GROUP BY s1)", "grid AS (SELECT e.eid AS s1, g.threshold, coalesce(n, 0) AS n, coalesce(tp, 0) AS tp, coalesce(t, 0) AS t FROM s1 e CROSS JOIN " + _GRID + " LEFT JOIN hit h ON h.s1 = e.eid AND h.threshold = g.threshold LEFT JOIN n_true x ON x.s1 = e.eid)")
       + "SELECT threshold, sum(n)::BIGINT AS predicted, sum(tp)::BIGINT AS tp, round(avg(CASE WHEN t = 0 AND n = 0 THEN 1.0 WHEN tp = 0 THEN 0.0 ELSE 1.25 * tp / (0.25 * t + n) END::DOUBLE), 6) AS f05 FROM grid GROUP BY threshold")
def macro_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro F0.5 over all entities at each of several thresholds."""
    return baseline.macro_sweep(_scores(spark, sf_dir), *_tables(spark, sf_dir, "truth", "st"), [0.3, 0.5, 0.7, 0.9])


@query(with_(_D, blocked(_D), "e AS (SELECT t.rid // 10000000000 AS source, t.s1, count(*) AS t, count(c.rid) AS h FROM truth t LEFT JOIN cand c ON c.rid = t.rid AND c.s1 = t.s1 GROUP BY ALL)")
       + "SELECT source, sum(t)::BIGINT AS true_pairs, sum(h)::BIGINT AS covered, round(sum(h) / sum(t), 6) AS covered_share, count(*) AS entities, count(*) FILTER (WHERE t = h) AS entities_whole FROM e GROUP BY source")
def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of the truth the candidates hold, by source."""
    return baseline.coverage(*_tables(spark, sf_dir, "cand", "truth"))


@query(with_(_D, blocked(_D), _RANKS) + "SELECT label, count(*) AS n, round(avg(cheap_score), 6) AS mean, round(quantile_cont(cheap_score, 0.1), 6) AS q10, round(quantile_cont(cheap_score, 0.5), 6) AS median, round(quantile_cont(cheap_score, 0.9), 6) AS q90 FROM (SELECT r.*, CASE WHEN t.rid IS NULL THEN 0 ELSE 1 END AS label FROM ranks r LEFT JOIN truth t ON t.rid = r.rid AND t.s1 = r.s1) GROUP BY label")
def score_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheap score of true and other pairs."""
    truth = _tables(spark, sf_dir, "truth")[0].select("rid", "s1", F.lit(1).alias("label"))
    return baseline.score_report(_ranks(spark, sf_dir).join(truth, ["rid", "s1"], "left").fillna(0, ["label"]))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = _tables(spark, sf_dir, "truth")[0].select("rid", "s1", F.lit(1).alias("label"))
    return _scores(spark, sf_dir).join(truth, ["rid", "s1"], "left").fillna(0, ["label"])


_LABELLED = "lab AS (SELECT s.p, CASE WHEN t.rid IS NULL THEN 0 ELSE 1 END AS y FROM scored s LEFT JOIN truth t ON t.rid = s.rid AND t.s1 = s.s1)"


@query(with_(_D, scored(_D), _LABELLED, "v AS (SELECT p, sum(y) AS pos, count(*) AS n FROM lab GROUP BY p)", "c AS (SELECT *, sum(n) OVER (ORDER BY p) - n + (n + 1) / 2 AS r, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(n) OVER (ORDER BY p DESC) AS taken FROM v)")
       + "SELECT round(((sum(pos * r) - sum(pos) * (sum(pos) + 1) / 2) / (sum(pos) * (sum(n) - sum(pos))))::DOUBLE, 6) AS auc, round((sum(pos * tp / taken) / sum(pos))::DOUBLE, 6) AS average_precision, sum(pos)::BIGINT AS positives FROM c")
def auc_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area under the ROC curve by average ranks, and average precision."""
    return models.ranking(_labelled(spark, sf_dir))


@query(with_(_D, scored(_D), _LABELLED, "c AS (SELECT threshold, count(*) FILTER (WHERE p >= threshold AND y = 1) AS tp, count(*) FILTER (WHERE p >= threshold AND y = 0) AS fp, count(*) FILTER (WHERE p < threshold AND y = 1) AS fn FROM lab CROSS JOIN " + _GRID + " GROUP BY threshold)")
       + "SELECT threshold, tp, fp, fn, round(tp / (tp + fp), 6) AS precision_, round(tp / (tp + fn), 6) AS recall, round(1.25 * tp / (1.25 * tp + 0.25 * fn + fp), 6) AS f_beta FROM c")
def precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F0.5 of pairs at several thresholds."""
    return models.precision_recall(_labelled(spark, sf_dir), [0.3, 0.5, 0.7, 0.9])


_AT = (1, 3, 5, 10, 15, 20)


@query(with_(_D, blocked(_D)) + "SELECT t.rid // 10000000000 AS source, count(*) AS pairs, " + ", ".join(f"round(count(*) FILTER (WHERE rk <= {k}) / count(*), 6) AS recall_{k}" for k in _AT) + ", round(count(c.rid) / count(*), 6) AS recall_any FROM truth t LEFT JOIN cand c ON c.rid = t.rid AND c.s1 = t.s1 GROUP BY 1")
def block_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the true pairs among the first candidates of their records, by source."""
    cand, truth = _tables(spark, sf_dir, "cand", "truth")
    d = truth.join(cand, ["rid", "s1"], "left")
    share = lambda c: F.round(F.avg(F.coalesce(c, F.lit(False)).cast("double")), 6)
    return d.groupBy(F.expr("rid div 10000000000").alias("source")).agg(F.count("*").alias("pairs"), *[share(F.col("rk") <= k).alias(f"recall_{k}") for k in _AT], share(F.col("rk").isNotNull()).alias("recall_any"))


@query(with_(_D, scored(_D), "r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY p DESC, s1) AS place, ('0x' || substr(md5(rid || '-' || s1), 1, 15))::BIGINT % 1000 AS h FROM scored)") + """
SELECT rid, s1, p, 'train' AS split FROM r WHERE p BETWEEN 0.003 AND 0.997 OR h < 15 UNION ALL SELECT rid, s1, p, 'valid' FROM r WHERE p BETWEEN 0.002 AND 0.998 UNION ALL SELECT rid, s1, p, 'test' FROM r WHERE place <= 2 AND p BETWEEN 0.01 AND 0.99""")
def uncertain_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs for a text model by use: to learn the uncertain ones and 1.5 % of the rest, to validate a wider band, to score
    the first two of a record."""
    d = _scores(spark, sf_dir).withColumn("h", F.conv(F.substring(F.md5(F.concat_ws("-", "rid", "s1").cast("binary")), 1, 15), 16, 10).cast("long") % 1000)
    at = F.row_number().over(W.partitionBy("rid").orderBy(F.desc("p"), "s1"))
    use = F.array(F.when(F.col("p").between(0.003, 0.997) | (F.col("h") < 15), "train"), F.when(F.col("p").between(0.002, 0.998), "valid"), F.when((F.col("at") <= 2) & F.col("p").between(0.01, 0.99), "test"))
    return d.withColumn("at", at).select("rid", "s1", "p", F.explode(F.array_compact(use)).alias("split"))


_MAP = "SELECT a AS token, b AS target, n, total FROM (SELECT a, b, n, sum(n) OVER (PARTITION BY a)::BIGINT AS total, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS r FROM (SELECT a, b, count(*) AS n FROM pairs GROUP BY a, b)) WHERE r = 1 AND n >= {least} AND n >= 0.6 * total AND a <> b"


@query(with_(_D, registry(_D), "pairs AS (SELECT unnest(string_split(q.name_full, ' ')) AS a, unnest(string_split(s.name_full, ' ')) AS b FROM truth t JOIN q ON q.eid = t.rid JOIN s1 s ON s.eid = t.s1 WHERE len(string_split(q.name_full, ' ')) = len(string_split(s.name_full, ' ')))") + _MAP.format(least=3))
def learn_token_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word-for-word map from aligned names of equal length: the commonest target of a word if it is frequent and clear."""
    truth, q, s1 = _tables(spark, sf_dir, "truth", "q", "s1")
    name = lambda df, k, n: df.select(F.col("eid").alias(k), F.split("name_full", " ").alias(n))
    return learned_map(truth.join(name(q, "rid", "x"), "rid").join(name(s1, "s1", "y"), "s1"), least=3)


def learned_map(pairs: DataFrame, least: int = 20, share: float = 0.6) -> DataFrame:
    """(token, target, n, total) of pairs of word arrays x, y: words at the same place of names of equal length. A target
    is learned if it is the commonest, comes `least` times and with this share, and differs."""
    each = pairs.where(F.size("x") == F.size("y")).select(F.explode(F.arrays_zip("x", "y")).alias("z")).groupBy(F.col("z.x").alias("token"), F.col("z.y").alias("target")).agg(F.count("*").alias("n"))
    of = W.partitionBy("token")
    d = each.withColumns({"total": F.sum("n").over(of), "r": F.row_number().over(of.orderBy(F.desc("n"), "target"))})
    return d.where((F.col("r") == 1) & (F.col("n") >= least) & (F.col("n") >= share * F.col("total")) & (F.col("token") != F.col("target"))).drop("r")


@query("SELECT page_id, strip_accents(html) AS plain FROM pages")
def strip_accents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole pages with the marks of their Latin letters off."""
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", text.strip_accents(F.col("html")).alias("plain"))


_SUFFIXES = ("pvt", "ltd", "inc", "llc", "corp")


@query(with_(_D, blocked(_D), "d AS (SELECT c.rid, c.s1, list_filter(string_split(s.name_full, ' '), lambda w: w NOT IN string_split(q.name_full, ' ')) AS gone FROM cand c JOIN q ON q.eid = c.rid JOIN s1 s ON s.eid = c.s1)") + f"SELECT rid, s1, len(gone) AS gone, coalesce(list_bool_and(list_transform(gone, lambda w: w IN {_SUFFIXES})), true) AS only_suffixes FROM d")
def all_in_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all words that a record lacks are suffixes; true if it lacks none."""
    both = features.with_texts(*_tables(spark, sf_dir, "cand", "qt", "st"))
    gone = F.filter(F.split("s_name_full", " "), lambda w: ~F.array_contains(F.split("q_name_full", " "), w))
    return both.select("rid", "s1", F.size(gone).alias("gone"), F.forall(gone, lambda w: w.isin(*_SUFFIXES)).alias("only_suffixes"))


@query(with_(_D, blocked(_D)) + "SELECT c.rid, c.s1, (q.name_core <> '' AND q.name_core = s.name_core)::INT AS name_exact, (q.name_core <> '' AND s.name_core <> '' AND (contains(q.name_core, s.name_core) OR contains(s.name_core, q.name_core)))::INT AS name_contains, (q.address <> '' AND s.address <> '' AND (contains(q.address, s.address) OR contains(s.address, q.address)))::INT AS address_contains FROM cand c JOIN q ON q.eid = c.rid JOIN s1 s ON s.eid = c.s1")
def containment_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simple_features(spark, sf_dir).select("rid", "s1", "name_exact", "name_contains", "address_contains")


def _second(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).withColumn("p_guard", F.least(F.col("p") + 0.05, F.lit(1.0)))


def _sure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.best_of_record(_scores(spark, sf_dir)).where("p >= 0.85").select("rid", "s1")


@query()
def locale_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule-based proposals for records that the scores leave without a sure owner."""
    qt, st, cand = _tables(spark, sf_dir, "qt", "st", "cand")
    return locale.proposals(qt, st, _second(spark, sf_dir), _sure(spark, sf_dir), cand, rare_df=20)


@query()
def locale_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the review takes away from the sure owners, and what it lets pass of the proposals."""
    qt, st = _tables(spark, sf_dir, "qt", "st")
    proposed, scores = locale_proposals(spark, sf_dir), _second(spark, sf_dir)
    review = locale.reviewed(qt, st, scores, _sure(spark, sf_dir), proposed)
    gone = locale.removals(review, least=2).withColumn("what", F.lit("removed"))
    return gone.unionByName(locale.additions(proposed, review, scores, st).withColumn("what", F.lit("added")))


@query()
def locale_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two assignments made one: by verdicts on what only either has."""
    new = features.best_of_record(_scores(spark, sf_dir).withColumn("p", 1 - F.col("p"))).where("p >= 0.3")
    return locale.partial_filter(new, _sure(spark, sf_dir), *_tables(spark, sf_dir, "qt", "st"))


@query()
def locale_rescue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a sure pool the pairs whose classes say the same."""
    pool = _scores(spark, sf_dir).withColumnRenamed("p", "ce")
    return locale.rescue_gate(pool, *_tables(spark, sf_dir, "qt", "st"), _sure(spark, sf_dir).where("rid % 2 = 0"))


@query()
def change_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether additions and removals of the review pass their gates."""
    qt, st = _tables(spark, sf_dir, "qt", "st")
    changes = locale_changes(spark, sf_dir)
    one = lambda what, added, lower: locale.change_gate(changes.where(F.col("what") == what), qt, st, added, lower).withColumn("what", F.lit(what))
    return one("added", True, 0.003).unionByName(one("removed", False, 0.02))


@query()
def synthetic_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities with one known change each, noise or decoy."""
    return synthetic.generated(_tables(spark, sf_dir, "st")[0].select("eid", "name_full", "address"))


@query(with_(_D, blocked(_D), "d AS (SELECT q.cls, try_cast(q.numbers[1] AS BIGINT) - try_cast(s.numbers[1] AS BIGINT) AS step FROM cand c JOIN qt q ON q.eid = c.rid JOIN st s ON s.eid = c.s1 WHERE c.rk = 1)") + "SELECT cls, step, count(*) AS n FROM d WHERE step IS NOT NULL AND step <> 0 GROUP BY ALL HAVING count(*) >= 2")
def number_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the house numbers of first candidates lie from their entity's, by class of record."""
    cand, qt, st = _tables(spark, sf_dir, "cand", "qt", "st")
    d = features.with_texts(cand.where("rk = 1").select("rid", "s1"), qt, st).join(qt.select(F.col("eid").alias("rid"), "cls"), "rid")
    step = F.expr("try_cast(get(q_numbers, 0) as bigint) - try_cast(get(s_numbers, 0) as bigint)")
    return d.select("cls", step.alias("step")).where("step is not null and step <> 0").groupBy("cls", "step").agg(F.count("*").alias("n")).where("n >= 2")
