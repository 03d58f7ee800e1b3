"""Queries over training rows, pools, coverage and comparison families, beside those of the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions import vectors
from lodestone.operators import latency, retrieval, sampling, statistics, training, validation
from lodestone.plans.catalogue import _DENSE, _PRINT, _SEEDS, _V, _WORD, _dense, _judged, _query, _seed_scores, _table, _verdicts
from lodestone.runtime import small, store

# Rankings

_SECOND = _DENSE + """, t AS (SELECT r.query_id, r.doc_id, rank, round(list_dot_product(q.v[1:8], c.v[1:8]), 9) AS second FROM r JOIN q USING (query_id) JOIN c USING (doc_id) WHERE rank <= 100),
w AS (SELECT query_id, doc_id, rank, CASE WHEN rank <= 10 THEN row_number() OVER (PARTITION BY query_id, rank <= 10 ORDER BY second DESC, rank) ELSE rank END AS new_rank FROM t),
ann AS (SELECT * FROM rel WHERE doc_id % 3 = 0)"""


def _reranked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(rankings with new_rank, relevance): the first ten by the inner product of eight dimensions."""
    ranking, relevance, corpus = _dense(spark, sf_dir, 100)
    ranking = store(ranking.select("query_id", "doc_id", "rank"))
    queries = _table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.slice("embedding", 1, 8).alias("a"))
    pairs = ranking.join(small(queries), "query_id").join(corpus.select("doc_id", F.slice("vector", 1, 8).alias("b")), "doc_id")
    second = pairs.select("query_id", "doc_id", F.round(vectors.dot(F.col("a"), F.col("b")), 9).alias("second"))
    return store(retrieval.reranked_prefix(ranking, second, 10).select("query_id", "doc_id", "rank", "new_rank")), relevance


@_query(_SECOND + """, e AS (SELECT 'before' AS condition, query_id, doc_id, rank FROM w UNION ALL SELECT 'after', query_id, doc_id, new_rank FROM w),
b AS (SELECT condition, ann.query_id, min(e.rank) AS best FROM (SELECT DISTINCT condition FROM e) CROSS JOIN ann LEFT JOIN e USING (condition, query_id, doc_id) GROUP BY 1, 2)
SELECT condition, count(*) AS eligible, round(avg((coalesce(best, 1000) <= 1)::INT), 9) AS top1, round(avg((coalesce(best, 1000) <= 3)::INT), 9) AS top3 FROM b GROUP BY 1""")
def annotated_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    both, relevance = _reranked(spark, sf_dir)
    annotated = store(relevance.where("doc_id % 3 = 0"))
    sides = {"before": both.select("query_id", "doc_id", "rank"), "after": both.select("query_id", "doc_id", F.col("new_rank").alias("rank"))}
    parts = [training.coverage(d, annotated).select(F.lit(name).alias("condition"), "eligible", F.round("top1", 9).alias("top1"), F.round("top3", 9).alias("top3")) for name, d in sides.items()]
    return parts[0].unionByName(parts[1])


@_query(_SECOND + """, f AS (SELECT query_id, max(doc_id) FILTER (rank = 1) AS a, max(doc_id) FILTER (new_rank = 1) AS b FROM w GROUP BY 1),
m AS (SELECT 'annotated' AS mark, * FROM ann UNION ALL SELECT 'positive', * FROM rel),
x AS (SELECT k.mark, a, b, EXISTS (SELECT 1 FROM m WHERE m.mark = k.mark AND m.query_id = f.query_id AND m.doc_id = a) AS was, EXISTS (SELECT 1 FROM m WHERE m.mark = k.mark AND m.query_id = f.query_id AND m.doc_id = b) AS now FROM f, (SELECT unnest(['annotated', 'positive']) AS mark) k)
SELECT mark, count(*) FILTER (a = b) AS unchanged, count(*) FILTER (now AND NOT was) AS promoted, count(*) FILTER (was AND NOT now) AS demoted FROM x GROUP BY 1""")
def rerank_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    both, _ = _reranked(spark, sf_dir)
    positive = store(_judged(spark, sf_dir, both.where("rank = 1 OR new_rank = 1")))
    before, after = both.select("query_id", "doc_id", "rank"), both.select("query_id", "doc_id", F.col("new_rank").alias("rank"))
    marks = {"annotated": positive.where("doc_id % 3 = 0"), "positive": positive}
    parts = [training.top_changes(before, after, m).select(F.lit(name).alias("mark"), "unchanged", "promoted", "demoted") for name, m in marks.items()]
    return parts[0].unionByName(parts[1])


@_query(_DENSE + "SELECT query_id, doc_id, 101 - rank AS score FROM r WHERE rank <= 100")
def rank_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir, 100)[0].select("query_id", "doc_id", training.rank_score(F.col("rank")).cast("bigint").alias("score"))


@_query(_DENSE + "SELECT query_id, string_agg(doc_id, ',' ORDER BY score DESC, doc_id) AS listed FROM r WHERE rank <= 10 GROUP BY 1")
def normalized_rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = _dense(spark, sf_dir, 10)[0].groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("doc_id", "score"))).alias("m"))
    return scores.select("query_id", F.array_join(training.listed_ranking(F.col("m")).cast("array<string>"), ",").alias("listed"))


@_query(_DENSE + """SELECT condition, count(*) AS n, sum(doc_id * rank)::BIGINT AS checksum FROM (SELECT 'first three' AS condition, query_id, doc_id, rank FROM r WHERE rank <= 3 UNION ALL SELECT 'first', query_id, doc_id, rank FROM r WHERE rank <= 1
UNION ALL SELECT 'gold', query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) FROM rel) GROUP BY 1""")
def evidence_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranking, relevance, _ = _dense(spark, sf_dir, 3)
    gold = relevance.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id")))
    rows = training.condition_rankings(**{"first three": ranking, "first": ranking.where("rank <= 1"), "gold": gold})
    return rows.groupBy("condition").agg(F.count("*").alias("n"), F.sum(F.col("doc_id") * F.col("rank")).cast("bigint").alias("checksum"))


_ARMS = _DENSE + f""", f AS (SELECT doc_id, {_PRINT.format(v='v')} AS fp FROM c),
known AS (SELECT DISTINCT query_id, fp FROM rel JOIN f USING (doc_id)),
cand AS (SELECT r.query_id, r.doc_id, r.rank, f.fp FROM r JOIN f USING (doc_id) WHERE r.rank <= 50 AND NOT EXISTS (SELECT 1 FROM rel WHERE rel.query_id = r.query_id AND rel.doc_id = r.doc_id) AND NOT EXISTS (SELECT 1 FROM known k WHERE k.query_id = r.query_id AND k.fp = f.fp)),
o AS (SELECT 'hard' AS arm, query_id, doc_id, rank AS pos, fp FROM cand UNION ALL SELECT 'random', query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY md5('5|' || query_id || '|' || doc_id), doc_id), fp FROM cand),
d AS (SELECT *, row_number() OVER (PARTITION BY arm, query_id, fp ORDER BY pos) AS n FROM o),
arms AS (SELECT * FROM (SELECT arm, query_id, doc_id, row_number() OVER (PARTITION BY arm, query_id ORDER BY pos) AS negative FROM d WHERE n = 1) WHERE negative <= 5)"""


def _arms(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(arms (arm, query_id, doc_id, negative), positives, fingerprints): the five hardest and five random negatives among the first fifty."""
    ranking, relevance, corpus = _dense(spark, sf_dir, 50)
    ranking = store(ranking.select("query_id", "doc_id", "rank"))
    thousandths = F.transform(F.col("vector").cast("array<double>"), lambda x: F.round(x * 1000).cast("bigint").cast("string"))
    prints = corpus.select("doc_id", F.md5(F.array_join(thousandths, ",")).alias("fingerprint"))
    left = ranking.join(relevance, ["query_id", "doc_id"], "left_anti")
    shuffled = left.select("query_id", "doc_id", F.row_number().over(Window.partitionBy("query_id").orderBy(T.seeded_order(5, F.col("query_id"), F.col("doc_id")), "doc_id")).alias("rank"))
    made = [retrieval.hard_negatives(rows, relevance, prints, 5, strict=False).select(F.lit(arm).alias("arm"), "query_id", "doc_id", "negative") for arm, rows in (("hard", ranking), ("random", shuffled))]
    return store(made[0].unionByName(made[1])), relevance, prints


@_query(_ARMS + """SELECT rel.query_id, rel.doc_id AS positive_id, arm, string_agg(arms.doc_id, ',' ORDER BY negative) AS negatives FROM rel JOIN arms ON arms.query_id = rel.query_id GROUP BY 1, 2, 3""")
def paired_training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    arms, positives, _ = _arms(spark, sf_dir)
    rows = training.paired_rows(positives, arms)
    return rows.select("query_id", "positive_id", "arm", F.array_join(F.col("negative_ids").cast("array<string>"), ",").alias("negatives"))


@_query(_ARMS + """, x AS (SELECT arm, query_id, doc_id FROM arms WHERE doc_id IN (SELECT doc_id FROM rel) AND NOT EXISTS (SELECT 1 FROM rel WHERE rel.query_id = arms.query_id AND rel.doc_id = arms.doc_id))
SELECT (SELECT count(DISTINCT query_id) FROM arms) AS queries, (SELECT count(*) FROM (SELECT query_id, doc_id FROM arms GROUP BY 1, 2 HAVING count(*) > 1)) AS overlap_slots,
(SELECT count(*) FROM x WHERE arm = 'hard') AS cross_hard, (SELECT count(*) FROM x WHERE arm = 'random') AS cross_random, (SELECT count(*) - count(DISTINCT fp) FROM f) AS duplicate_contents""")
def training_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    arms, positives, prints = _arms(spark, sf_dir)
    return training.negative_audit(store(positives), arms, prints, ("hard", "random"))


@_query(r"""WITH p AS (SELECT doc_id, i - 1 AS sentence_index, len(list_distinct(regexp_extract_all(lower(t[i]), '[\p{L}\p{N}_]+'))) AS score, trim(t[i]) <> '' AS filled, len(t) AS n FROM (SELECT doc_id, t, unnest(generate_series(1, len(t))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents))),
r AS (SELECT doc_id % 50 AS query_id, doc_id, sentence_index, row_number() OVER (PARTITION BY doc_id % 50 ORDER BY score DESC, doc_id, sentence_index) AS rank FROM p WHERE filled),
t AS (SELECT DISTINCT doc_id % 50 AS query_id, doc_id, sentence_index FROM p WHERE score >= 10 AND doc_id % 4 = 0),
b AS (SELECT t.query_id, min(rank) AS best FROM t LEFT JOIN r USING (query_id, doc_id, sentence_index) GROUP BY 1),
s AS (SELECT count(*) AS n FROM r WHERE rank = 1 AND EXISTS (SELECT 1 FROM t WHERE t.query_id = r.query_id AND t.doc_id = r.doc_id))
SELECT count(*) AS eligible, count(*) FILTER (best <= 1) AS top1_hits, count(*) FILTER (best <= 3) AS top3_hits, max(s.n) AS selected_document FROM b, s""")
def sentence_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = retrieval.sentence_passages(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    scored = rows.select((F.col("doc_id") % 50).alias("query_id"), "doc_id", F.col("sentence_index").cast("bigint").alias("sentence_index"), F.size(F.array_distinct(T.tokens(F.col("text")))).alias("score"))
    scored = store(scored)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id", "sentence_index")
    # Only the best three of a query and the targets are asked for: ranks come from the rows that are not worse than any target.
    targets = scored.where("score >= 10 AND doc_id % 4 = 0").select("query_id", "doc_id", "sentence_index")
    passages = scored.withColumn("rank", F.row_number().over(order)).where("rank <= 3").drop("score")
    return training.sentence_hits(passages, targets)


# Pools

_POOL_ROWS = _V + """, p AS (SELECT doc_id AS claim_id, n_chars % 97 AS doc_id, ['A', 'B', 'C', 'D'][n_chars % 4 + 1] AS condition, gold, n_chars FROM v),
y AS (SELECT claim_id, doc_id, condition, CASE WHEN n_chars % 23 = 0 THEN 'DEV' ELSE 'TRAIN' END AS source_split, CASE WHEN n_chars % 29 = 0 THEN 'MIXED' ELSE gold END AS claim_gold_label,
 CASE WHEN condition = 'A' OR n_chars % 31 = 0 THEN gold END AS pair_annotation, CASE WHEN condition = 'A' THEN gold ELSE 'INSUFFICIENT' END AS context_label,
 CASE WHEN condition = 'A' AND n_chars % 17 <> 0 THEN 1 ELSE 0 END AS n_rationale, (n_chars % 100) / 100.0::DOUBLE AS retrieval_score,
 CASE WHEN n_chars % 37 = 0 THEN 'old' ELSE 'v1' END AS filter_version, CASE WHEN n_chars % 41 = 0 THEN 'open' ELSE 'approved' END AS filter_status FROM p)"""


def _pool_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the four conditions from the verdicts, some of them wrong."""
    n = F.col("n_chars")
    rows = _verdicts(spark, sf_dir).withColumn("condition", F.get(F.array(*[F.lit(c) for c in "ABCD"]), (n % 4).cast("int")))
    gold = F.col("condition") == "A"
    return rows.select(
        F.col("doc_id").alias("claim_id"), (n % 97).alias("doc_id"), "condition", F.when(n % 23 == 0, "DEV").otherwise("TRAIN").alias("source_split"), F.when(n % 29 == 0, "MIXED").otherwise(F.col("gold")).alias("claim_gold_label"),
        F.when(gold | (n % 31 == 0), F.col("gold")).alias("pair_annotation"), F.when(gold, F.col("gold")).otherwise("INSUFFICIENT").alias("context_label"),
        F.when(gold & (n % 17 != 0), F.array(F.lit(0))).otherwise(F.array().cast("array<int>")).alias("rationale_sentences"), ((n % 100) / 100.0).cast("double").alias("retrieval_score"),
        F.when(n % 37 == 0, "old").otherwise("v1").alias("filter_version"), F.when(n % 41 == 0, "open").otherwise("approved").alias("filter_status"),
    )


@_query(_POOL_ROWS + """SELECT claim_id, doc_id, condition, unnest(list_filter([CASE WHEN source_split <> 'TRAIN' THEN 'split' END,
 CASE WHEN condition = 'A' AND (coalesce(pair_annotation NOT IN ('SUPPORT', 'CONTRADICT'), true) OR context_label IS DISTINCT FROM pair_annotation OR n_rationale = 0) THEN 'gold' END,
 CASE WHEN condition <> 'A' AND (pair_annotation IS NOT NULL OR context_label <> 'INSUFFICIENT' OR n_rationale > 0) THEN 'negative' END,
 CASE WHEN condition IN ('B', 'C') AND (filter_version <> 'v1' OR filter_status <> 'approved') THEN 'filter' END,
 CASE WHEN condition = 'B' AND retrieval_score > 0.8 + 1e-12 THEN 'score' END, CASE WHEN condition <> 'A' AND claim_gold_label = 'MIXED' THEN 'mixed' END], lambda x: x IS NOT NULL)) AS problem FROM y""")
def violations_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.pool_problems(_pool_rows(spark, sf_dir), {"B": "v1", "C": "v1"}, {"B": 0.8})


@_query(_POOL_ROWS + """, a AS (SELECT condition AS pool, claim_gold_label IN ('SUPPORT', 'CONTRADICT') AND claim_id % 3 > 0 AS contaminated FROM y WHERE condition = 'B' AND retrieval_score <= 0.5 OR condition = 'C')
SELECT pool, count(*) AS n, count(*) FILTER (contaminated) AS contaminated, count(*) FILTER (contaminated) <= count(*) * 0.6::DOUBLE AS kept FROM a GROUP BY 1""")
def filtered_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pool_rows(spark, sf_dir)
    score, pool = F.col("retrieval_score"), F.col("condition")
    rules = {"A": ("drop_all", None), "B": ("absolute_score_max", 0.5), "C": ("no_filter", None), "D": ("drop_all", None)}
    accepted = F.lit(False)
    for name, (rule, most) in rules.items():
        accepted = F.when(pool == name, validation.filter_rule(score, rule, most)).otherwise(accepted)
    audit = rows.where(accepted).select(pool.alias("pool"), (F.col("claim_gold_label").isin("SUPPORT", "CONTRADICT") & (F.col("claim_id") % 3 > 0)).alias("contaminated"))
    return validation.kept_pools(audit, 0.6)


# Integrity


@_query("""WITH m AS (SELECT item_id AS id FROM benchmark WHERE item_id % 11 <> 0 UNION ALL SELECT item_id FROM benchmark WHERE item_id % 13 = 0 UNION ALL SELECT item_id + 1000000 FROM benchmark WHERE item_id % 17 = 0), a AS (SELECT id, count(*) AS n FROM m GROUP BY 1)
SELECT item_id AS id, 'missing' AS problem FROM benchmark WHERE item_id NOT IN (SELECT id FROM a) UNION ALL SELECT id, 'extra' FROM a WHERE id NOT IN (SELECT item_id FROM benchmark) UNION ALL SELECT id, 'repeated' FROM a WHERE n > 1""")
def violations_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"))
    placed = items.where("id % 11 <> 0").unionByName(items.where("id % 13 = 0")).unionByName(items.where("id % 17 = 0").select((F.col("id") + 1_000_000).alias("id")))
    clusters = placed.groupBy((F.col("id") % 7).alias("cluster")).agg(F.collect_list("id").alias("members"))
    return validation.cluster_problems(items, clusters, "id")


@_query("SELECT doc_id FROM documents WHERE doc_id % 17 = 0 AND text IS NOT NULL")
def violations_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.split("text", "\n").alias("sentences"))
    passages = docs.select("doc_id", F.posexplode("sentences").alias("sentence_index", "text"))
    changed = F.when((F.col("doc_id") % 17 == 0) & (F.col("sentence_index") == 0), F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return validation.sentence_problems(docs, passages.withColumn("text", changed))


@_query("""SELECT l_orderkey AS key, CASE WHEN l_linenumber = 3 THEN 'missing' ELSE 'differs' END AS problem FROM lineitem WHERE l_linenumber = 3 OR l_partkey % 97 = 0 AND l_discount > 0""")
def violations_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, discount = F.col("l_extendedprice"), F.col("l_discount")
    product = F.when(F.col("l_partkey") % 97 == 0, price).otherwise(price * (1 - discount))
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", price.alias("price"), F.when(F.col("l_linenumber") != 3, 1 - discount).alias("share"), product.alias("amount"))
    return validation.derived_problems(rows, "l_orderkey", "amount", ("price", "share"), 1e-9).withColumnRenamed("l_orderkey", "key")


@_query(_DENSE + "SELECT DISTINCT query_id FROM r WHERE query_id % 200 = 0")
def violations_reordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranking = _dense(spark, sf_dir, 10)[0].select("query_id", "doc_id", "rank")
    after = ranking.withColumn("doc_id", F.when((F.col("query_id") % 200 == 0) & (F.col("rank") == 10), -1).otherwise(F.col("doc_id")))
    return validation.reordered(ranking, after, "query_id", "doc_id")


@_query(_V + """SELECT doc_id_group, part, list_sort(list(DISTINCT gold)) AS labels FROM (SELECT n_chars % 500 AS doc_id_group, lang AS part, gold FROM v WHERE gold <> 'INSUFFICIENT') GROUP BY 1, 2 HAVING count(DISTINCT gold) > 1""")
def violations_pair_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _verdicts(spark, sf_dir).select((F.col("n_chars") % 500).alias("doc_id_group"), F.col("lang").alias("part"), "gold")
    return validation.pair_conflicts(rows, "doc_id_group", "part", label="gold")


@_query(_V + """, x AS (SELECT doc_id AS claim_id, gold AS decision FROM v WHERE doc_id % 40 = 0)
SELECT unnest(list_filter([CASE WHEN count(*) NOT BETWEEN 3 AND 5 THEN 'count' END, CASE WHEN count(*) FILTER (claim_id % 80 = 0) > 0 THEN 'not of the training split' END,
CASE WHEN count(DISTINCT decision) < 3 THEN 'labels' END], lambda p: p IS NOT NULL)) AS problem FROM x""")
def few_shot_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _verdicts(spark, sf_dir).select(F.col("doc_id").alias("claim_id"), F.col("gold").alias("decision"))
    return training.few_shot_problems(store(rows.where("claim_id % 40 = 0")), rows.where("claim_id % 80 <> 0"), rows.where("claim_id % 80 = 0"))


@_query("""SELECT problem, count(*) AS n FROM (SELECT CASE WHEN text IS NULL OR length(text) > 20000 THEN 'length' WHEN trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) = '' THEN 'empty' WHEN n_chars % 13 NOT BETWEEN 1 AND 10 THEN 'k' END AS problem FROM documents) GROUP BY 1""")
def claim_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select(training.claim_problem(F.col("text"), F.col("n_chars") % 13).alias("problem"))
    return rows.groupBy("problem").agg(F.count("*").alias("n"))


# Seeds, selection and families


@_query(_V + "SELECT gold AS label, min(doc_id) AS doc_id FROM v GROUP BY 1")
def first_per_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.first_per_label(_verdicts(spark, sf_dir).select(F.col("gold").alias("label"), "doc_id"), "label", "doc_id")


@_query(_V + """, s AS (SELECT source, n_chars % 3 AS seed, avg((predicted = gold)::INT) AS a, avg((other = gold)::INT) AS b FROM v GROUP BY 1, 2), m AS (SELECT source, list(a) AS a, avg(b) AS b FROM s GROUP BY 1)
SELECT source, CASE WHEN list_min(a) - b > 1e-12 THEN 'all_improve' WHEN list_max(a) - b < -1e-12 THEN 'all_degrade' WHEN list_min(a) - b >= -1e-12 AND list_max(a) - b <= 1e-12 THEN 'all_tie' ELSE 'mixed' END AS class FROM m""")
def all_seed_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = lambda c: F.avg((F.col(c) == F.col("gold")).cast("double"))
    each = _verdicts(spark, sf_dir).groupBy("source", F.col("n_chars") % 3).agg(hit("predicted").alias("a"), hit("other").alias("b"))
    return each.groupBy("source").agg(F.collect_list("a").alias("a"), F.avg("b").alias("b")).select("source", training.seed_class(F.col("a"), F.col("b")).alias("class"))


@_query(_V + """, s AS (SELECT source, n_chars % 3 AS seed, avg((predicted = gold)::INT) AS a, avg((other = gold)::INT) AS b FROM v GROUP BY 1, 2)
SELECT source, round(avg(a), 9) AS predicted, round(avg(b), 9) AS other, round(avg(a) - avg(b), 9) AS difference FROM s GROUP BY 1""")
def seed_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    arms = F.explode(F.create_map(F.lit("predicted"), F.col("predicted"), F.lit("other"), F.col("other"))).alias("arm", "said")
    rows = _verdicts(spark, sf_dir).select("source", (F.col("n_chars") % 3).alias("seed"), "gold", arms)
    each = rows.groupBy("source", "seed", "arm").agg(F.avg((F.col("said") == F.col("gold")).cast("double")).alias("accuracy"))
    made = training.seed_average(each, "source", "arm", "accuracy", ("predicted", "other"))
    return made.select("source", *[F.round(c, 9).alias(c) for c in ("predicted", "other", "difference")])


@_query(_SEEDS.replace("WITH v", "WITH RECURSIVE v") + """, m AS (SELECT source, round(avg(accuracy), 9) AS accuracy FROM s GROUP BY 1),
t AS (SELECT 0 AS place, ''::VARCHAR AS source, (SELECT list({'source': source, 'accuracy': accuracy} ORDER BY source) FROM m) AS rest
 UNION ALL SELECT place + 1, c.source, list_filter(rest, lambda x: x.source <> c.source)
 FROM (SELECT place, rest, list_filter(rest, lambda x: list_max(list_transform(rest, lambda y: y.accuracy)) - x.accuracy <= 0.005)[1] AS c FROM t WHERE len(rest) > 0))
SELECT source, accuracy, place FROM t JOIN m USING (source) WHERE place > 0""")
def tie_margin_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    systems = store(_seed_scores(spark, sf_dir).groupBy("source").agg(F.round(F.avg("accuracy"), 9).alias("accuracy")))
    return training.margin_ranking(systems, "accuracy", "source").select("source", "accuracy", "place")


def _gain(right_a: str, said_a: str, right_b: str, said_b: str) -> str:
    f1 = lambda said, right: " + ".join(f"coalesce(2 * {right}{k} / nullif({said}{k} + g{k}, 0), 0)" for k in range(3))
    return f"(({f1(said_a, right_a)}) - ({f1(said_b, right_b)})) / 3"


_CELLS = ", ".join(
    [f"count(*) FILTER ({c} = '{x}') AS {kind}{k}" for kind, c in (("g", "gold"), ("p", "predicted"), ("q", "other")) for k, x in enumerate(("SUPPORT", "CONTRADICT", "INSUFFICIENT"))]
    + [f"count(*) FILTER ({c} = '{x}' AND gold = '{x}') AS {kind}{k}" for kind, c in (("pt", "predicted"), ("qt", "other")) for k, x in enumerate(("SUPPORT", "CONTRADICT", "INSUFFICIENT"))]
)
_NAMES = [f"{kind}{k}" for kind in ("g", "p", "q", "pt", "qt") for k in range(3)]


@_query(_V + f""", u0 AS (SELECT {_CELLS} FROM v GROUP BY n_chars % 60), u AS (SELECT *, row_number() OVER (ORDER BY {', '.join(_NAMES)}) - 1 AS unit FROM u0), k AS (SELECT count(*) AS n FROM u),
d AS (SELECT r, {_WORD.format("'0|' || r || '|' || i")} % n AS unit FROM k, (SELECT unnest(range(500)) AS r), (SELECT unnest(range(1000)) AS i) WHERE i < n),
s AS (SELECT r, {', '.join(f'sum({c}) AS {c}' for c in _NAMES)} FROM d JOIN u USING (unit) GROUP BY 1), m AS (SELECT {_gain('pt', 'p', 'qt', 'q')} AS value FROM s), w AS (SELECT {', '.join(f'sum({c}) AS {c}' for c in _NAMES)} FROM u)
SELECT round((SELECT {_gain('pt', 'p', 'qt', 'q')} FROM w), 9) AS value, round(quantile_cont(value, 0.025), 9) AS low, round(quantile_cont(value, 0.975), 9) AS high FROM m""")
def cluster_macro_f1_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _verdicts(spark, sf_dir).withColumn("cluster", F.col("n_chars") % 60)
    return statistics.cluster_macro_f1(rows, "cluster", 500).select(*[F.round(c, 9).alias(c) for c in ("value", "low", "high")])


def _family_sql() -> str:
    tests = [(c, m) for c in ("predicted_minus_other", "other_minus_constant") for m in ("accuracy", "valid")]
    parts = []
    for i, (c, m) in enumerate(tests):
        boot, flip = _WORD.format(f"'{100 + i}|' || r || '|' || i"), _WORD.format(f"'{100 + i}|' || r || '|' || unit")
        parts.append(f"""SELECT '{c}' AS comparison, '{m}' AS metric, (SELECT mean FROM k{i}) AS mean, (SELECT quantile_cont(value, 0.025) FROM b{i}) AS low, (SELECT quantile_cont(value, 0.975) FROM b{i}) AS high,
        (SELECT (count(*) FILTER (value >= abs(mean) - 1e-12) + 1) / 501 FROM f{i}, k{i}) AS p""")
        tests[i] = f"""u{i} AS (SELECT total, size, row_number() OVER (ORDER BY total, size) - 1 AS unit FROM l WHERE comparison = '{c}' AND metric = '{m}'), k{i} AS (SELECT count(*) AS n, sum(total) / sum(size) AS mean FROM u{i}),
        b{i} AS (SELECT r, sum(total) / sum(size) AS value FROM (SELECT r, {boot} % n AS unit FROM k{i}, (SELECT unnest(range(500)) AS r), (SELECT unnest(range(1000)) AS i) WHERE i < n) JOIN u{i} USING (unit) GROUP BY 1),
        f{i} AS (SELECT r, abs(sum(total * (1 - 2 * ({flip} % 2))) / sum(size)) AS value FROM u{i}, (SELECT unnest(range(500)) AS r) GROUP BY r)"""
    return _V + f""", l AS (SELECT comparison, metric, n_chars % 40 AS cluster, sum(d)::DOUBLE AS total, count(*)::DOUBLE AS size FROM (
      SELECT n_chars, 'predicted_minus_other' AS comparison, 'accuracy' AS metric, (predicted = gold)::INT - (other = gold)::INT AS d FROM v UNION ALL
      SELECT n_chars, 'predicted_minus_other', 'valid', (predicted <> 'INVALID')::INT - (other <> 'INVALID')::INT FROM v UNION ALL
      SELECT n_chars, 'other_minus_constant', 'accuracy', (other = gold)::INT - (gold = 'SUPPORT')::INT FROM v UNION ALL
      SELECT n_chars, 'other_minus_constant', 'valid', (other <> 'INVALID')::INT - 1 FROM v) GROUP BY 1, 2, 3), {', '.join(tests)},
    z AS ({' UNION ALL '.join(parts)}), e AS (SELECT *, comparison = 'predicted_minus_other' AND metric = 'accuracy' AS main FROM z),
    h AS (SELECT *, row_number() OVER (PARTITION BY main ORDER BY p, comparison, metric) AS i, count(*) OVER (PARTITION BY main) AS n FROM e)
    SELECT comparison, metric, CASE WHEN main THEN 'primary' ELSE 'exploratory' END AS role, round(mean, 9) AS mean, round(low, 9) AS low, round(high, 9) AS high, round(p, 9) AS p,
    CASE WHEN NOT main THEN round(max(least(1, (n - i + 1) * p)) OVER (PARTITION BY main ORDER BY p, comparison, metric ROWS UNBOUNDED PRECEDING), 9) END AS holm FROM h"""


@_query(_family_sql())
def comparison_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two comparisons by two metrics; the constant system always says SUPPORT."""
    right = lambda c: (F.col(c) == F.col("gold")).cast("int")
    valid = lambda c: (F.col(c) != "INVALID").cast("int")
    constant = (F.col("gold") == "SUPPORT").cast("int")
    named = lambda c, m, d: F.struct(F.lit(c).alias("comparison"), F.lit(m).alias("metric"), d.alias("d"))
    each = F.array(
        named("predicted_minus_other", "accuracy", right("predicted") - right("other")), named("predicted_minus_other", "valid", valid("predicted") - valid("other")),
        named("other_minus_constant", "accuracy", right("other") - constant), named("other_minus_constant", "valid", valid("other") - 1),
    )
    rows = _verdicts(spark, sf_dir).select((F.col("n_chars") % 40).alias("cluster"), F.explode(each).alias("x"))
    units = store(rows.groupBy("x.comparison", "x.metric", "cluster").agg(F.sum("x.d").cast("double").alias("total"), F.count("*").cast("double").alias("size")))
    made = statistics.comparison_family(units, ["predicted_minus_other", "other_minus_constant"], ["accuracy", "valid"], ("predicted_minus_other", "accuracy"), 500, 500, 100)
    return made.select("comparison", "metric", "role", *[F.round(c, 9).alias(c) for c in ("mean", "low", "high", "p", "holm")])


# Orders of training


@_query("""WITH e AS (SELECT epoch, doc_id, md5('3|' || epoch || '|' || doc_id) AS k FROM documents, (SELECT unnest([1, 2, 3]) AS epoch) WHERE doc_id IS NOT NULL),
c AS (SELECT epoch, substr(k, 1, 3) AS p, count(*) AS n, sha256(string_agg(doc_id, ',' ORDER BY k)) AS h FROM e GROUP BY 1, 2)
SELECT epoch, sum(n)::BIGINT AS n, sha256(string_agg(h, '' ORDER BY p)) AS order_sha FROM c GROUP BY 1""")
def epoch_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").select("doc_id")
    return training.order_fingerprint(training.epoch_order(rows, 3, 3, "doc_id"), "doc_id").select("epoch", "n", "order_sha")


@_query("""WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY md5('8|' || doc_id), doc_id) - 1 AS place FROM documents WHERE doc_id IS NOT NULL)
SELECT place % 4 AS worker, count(*) AS n, sum(doc_id)::BIGINT AS checksum FROM o GROUP BY 1""")
def sharded_sampler(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").select(F.col("doc_id").alias("group_id"), F.lit(0).alias("all"))
    placed = sampling.placed(rows, ["all"], 8)
    return placed.groupBy(training.sampler_shard(F.col("place"), 4).cast("bigint").alias("worker")).agg(F.count("*").alias("n"), F.sum("group_id").cast("bigint").alias("checksum"))


@_query("""SELECT lang, ceil(count(*) / 8)::BIGINT AS steps_per_epoch, (ceil(count(*) / 8) * 3)::BIGINT AS total_steps, ceil(ceil(count(*) / 8) * 3 * 0.1::DOUBLE)::BIGINT AS warmup_steps FROM documents GROUP BY 1""")
def training_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return counts.select("lang", training.schedule(F.col("n"), 8, 3, 0.1).alias("s")).select("lang", *[F.col(f"s.{c}").cast("bigint").alias(c) for c in ("steps_per_epoch", "total_steps", "warmup_steps")])


@_query(_V + """, r AS (SELECT doc_id, n_chars % 60 AS group_id FROM v) SELECT group_id, count(*) AS n FROM r WHERE doc_id % 5 = 0 GROUP BY 1""")
def restricted_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = _verdicts(spark, sf_dir).select(F.col("doc_id").alias("id"), (F.col("n_chars") % 60).alias("group_id"))
    return sampling.restricted_groups(groups, groups.where("id % 5 = 0").select("id")).groupBy("group_id").agg(F.count("*").alias("n"))


# Request log


@_query("""SELECT event_type, count(value) AS n, round(sum(value * (user_id % 5 + 1)) / sum(CASE WHEN value IS NOT NULL THEN user_id % 5 + 1 END), 6) AS mean FROM events GROUP BY 1""")
def weighted_mean_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").select("event_type", "value", (F.col("user_id") % 5 + 1).alias("w"))
    return latency.weighted_mean(rows, "event_type", "value", "w").select("event_type", "n", F.round("mean", 6).alias("mean"))


@_query("""SELECT event_type, count(*) AS steps, round(sum(user_id) / sum(value), 6) AS per_second FROM events WHERE event_id > 100 GROUP BY 1""")
def measured_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = latency.measured(_table(spark, sf_dir, "events"), "event_type", "event_id", 100, "user_id", "value")
    return made.select("event_type", "steps", F.round("per_second", 6).alias("per_second"))


@_query("""SELECT doc_id, md5(substr(text, 1, 1600)) AS excerpt, lang || ',' || source AS kinds FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL AND lang <> source""")
def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 1,600 characters of an example, and its kinds in the order in which they come first."""
    rows = _table(spark, sf_dir, "documents").where("doc_id IS NOT NULL AND text IS NOT NULL AND lang <> source")
    return rows.select("doc_id", F.md5(T.excerpt(F.col("text"))).alias("excerpt"), F.array_join(T.first_seen(F.array("lang", "source", "lang")), ",").alias("kinds"))


# Leakage groups of claims

_CLAIM_GROUPS = r"""WITH RECURSIVE i AS (SELECT item_id AS id, text, array_to_string(regexp_extract_all(replace(lower(coalesce(text, '')), 'ß', 'ss'), '[\p{L}\p{N}_]+'), ' ') AS norm FROM benchmark WHERE item_id IS NOT NULL),
t AS (SELECT id, list_distinct(string_split(norm, ' ')) AS t FROM i WHERE norm <> ''),
held AS (SELECT i.id, d.doc_id FROM i JOIN documents d ON contains(d.text, i.text)),
l AS (SELECT a.id AS a, b.id AS b FROM held a JOIN held b USING (doc_id) UNION SELECT a.id, b.id FROM i a JOIN i b ON a.norm = b.norm
 UNION SELECT a.id, b.id FROM t a JOIN t b ON 100 * len(list_intersect(a.t, b.t)) >= 80 * len(list_distinct(a.t || b.t))),
reach AS (SELECT a AS id, b AS other FROM l UNION SELECT r.id, l.b FROM reach r JOIN l ON r.other = l.a)
SELECT i.id, least(i.id, coalesce(min(other), i.id)) AS group_id FROM i LEFT JOIN reach ON reach.id = i.id GROUP BY i.id"""


@_query(_CLAIM_GROUPS)
def claim_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that share a document, a normalised text or most of their words are one group."""
    items = _table(spark, sf_dir, "benchmark").where("item_id IS NOT NULL").select(F.col("item_id").alias("id"), "text")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held = retrieval.containment(items.select(F.col("id").alias("query_id"), F.col("text").alias("item")), docs)
    keys = held.select(F.col("query_id").alias("id"), F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("key"))
    keys = keys.unionByName(items.select("id", F.concat(F.lit("text "), T.normalized(F.coalesce("text", F.lit("")))).alias("key")))
    similar = sampling.similar_sets(items.select("id", T.tokens(F.replace(F.lower("text"), F.lit("ß"), F.lit("ss"))).alias("items")), 80)
    return sampling.leakage_groups(items.select("id"), store(sampling.key_links(store(keys)).unionByName(similar)))
