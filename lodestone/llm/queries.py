"""The registered queries of the training-data operators, and their SQL where SQL expresses them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import attention, chat, covertree, jump, merkle, minhash, mixing, multiset, ordinal, phrases, spaced, urlmodel, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@_query
def op1_cover_tree_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.near_duplicate_vectors(_table(spark, sf_dir, "embeddings"), cosine=0.93)


ORACLES["op1_cover_tree_near_dedup"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT a AS vec_id, b AS other FROM links
  UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.other = l.a
), low AS (SELECT vec_id, min(other) AS low FROM reach GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, least(e.vec_id, coalesce(low.low, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(low.low, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN n ON n.vec_id = e.vec_id LEFT JOIN low ON low.vec_id = e.vec_id
"""


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, grade) from the labels: 0 toxic, 1 of low quality, 2 good; rows without a full label are left out."""
    labels = _table(spark, sf_dir, "labels").where("quality IS NOT NULL AND toxic IS NOT NULL")
    return labels.selectExpr("doc_id", "CASE WHEN toxic = 1 THEN 0 WHEN quality = 0 THEN 1 ELSE 2 END AS grade")


@_query
def op2_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return ordinal.graded(docs, ordinal.fit_on(docs, ratings(spark, sf_dir)))


@_query
def op3_url_language_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlmodel.filtered(_table(spark, sf_dir, "pages"))


@_query
def op4_hypergeometric_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    made = mixing.mixed(docs, carry=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken", "blocks.shard")
    return made.withColumnRenamed("shard", "shards")


@_query
def op5_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(_table(spark, sf_dir, "pages"))


ORACLES["op5_warc_segments"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
f AS (SELECT page_id, payload, sha1(payload) AS h, min(page_id) OVER (PARTITION BY payload) AS first FROM p)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(h, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""


@_query
def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), width=4, percent=80)


ORACLES["op6_minhash_near_dedup"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 4 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 3], ' ') END AS sh
  FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 3, 1))) AS i FROM w WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT a AS doc_id, b AS other FROM both_ways
  UNION SELECT r.doc_id, e.b FROM reach r JOIN both_ways e ON r.other = e.a
), comp AS (SELECT doc_id, min(other) AS low FROM reach GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(comp.low, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(comp.low, d.doc_id)) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN comp ON comp.doc_id = d.doc_id
"""


@_query
def op7_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.linked(_table(spark, sf_dir, "conversations"))


@_query
def op8_attention_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention.scored(_table(spark, sf_dir, "documents"))


@_query
def op9_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = jump.sharded(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


@_query
def op10_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spaced.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def _decontamination_sql() -> str:
    """Leaks without masks: any stretch that agrees in 80 % of 6 to 20 tokens has three in a row that agree, which name the diagonals; items of fewer tokens are sought by every single token."""

    def runs(source: str, key: str) -> str:
        one = f"SELECT {key}, i - 1 AS at, 1 AS k, h[i] AS seed FROM (SELECT {key}, h, unnest(generate_series(1, len(h))) AS i FROM {source})"
        three = f"SELECT {key}, i - 1 AS at, 3 AS k, h[i] || ' ' || h[i + 1] || ' ' || h[i + 2] AS seed FROM (SELECT {key}, h, unnest(generate_series(1, len(h) - 2)) AS i FROM {source})"
        return f"{one} UNION ALL {three}"

    def toks(key: str, table: str) -> str:
        return rf"SELECT {key}, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '') AS h FROM {table} WHERE {key} IS NOT NULL"

    return f"""
WITH d AS ({toks('doc_id', 'documents')}), b AS ({toks('item_id', 'benchmark')}),
few AS (SELECT * FROM ({runs('b', 'item_id')}) JOIN (SELECT item_id, len(h) AS n FROM b) USING (item_id)),
hits AS (SELECT DISTINCT ds.doc_id, bs.item_id, ds.at - bs.at AS shift FROM ({runs('d', 'doc_id')}) ds JOIN few bs ON ds.k = bs.k AND ds.seed = bs.seed AND bs.k = CASE WHEN bs.n < 6 THEN 1 ELSE 3 END),
agree AS (
  SELECT doc_id, item_id, shift, least({spaced.WINDOW}, len(b.h)) AS w,
    list_transform(generate_series(1, len(b.h)), lambda j: CASE WHEN j + shift BETWEEN 1 AND len(d.h) AND d.h[j + shift] = b.h[j] THEN 1 ELSE 0 END) AS a
  FROM hits JOIN d USING (doc_id) JOIN b USING (item_id)
), best AS (
  SELECT doc_id, item_id, w, list_max(list_transform(generate_series(1, len(a) - w + 1), lambda s: list_sum(a[s:s + w - 1]))) AS matched FROM agree
)
SELECT doc_id, item_id, CAST(max(matched) AS BIGINT) AS matched, CAST(max(w) AS BIGINT) AS "window"
FROM best WHERE matched * 100 >= w * {spaced.PERCENT} GROUP BY doc_id, item_id
"""


ORACLES["op10_spaced_seed_decontamination"] = _decontamination_sql()


@_query
def op11_octopus_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.proved(_table(spark, sf_dir, "documents"))


def _manifest_sql() -> str:
    """The tree level by level: nodes of all levels, siblings by coordinates, and a fold a level at a time."""

    def field(c: str) -> str:
        return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"

    def leaf(text: str) -> str:
        return f"sha256({' || '.join(field(c) for c in ('doc_id', 'source', 'lang', 'n_chars'))} || {field(text)})"

    def levels(leaves: str, key: str) -> str:
        return f"""
  SELECT {key}, 0 AS lvl, pos, h, count(*) OVER (PARTITION BY {key}) AS n FROM {leaves}
  UNION ALL
  SELECT {key}, lvl + 1, pos, h, n FROM (
    SELECT {key}, lvl, pos // 3 AS pos, sha256(string_agg(h, '' ORDER BY pos)) AS h, (any_value(n) + 2) // 3 AS n
    FROM {{nodes}} WHERE n > 1 GROUP BY {key}, lvl, pos // 3)"""

    return f"""
WITH RECURSIVE
bits AS (SELECT list_transform(range(256), lambda b: list_reduce(range(9), lambda c, i: CASE WHEN i = 0 THEN c WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS t),
ids AS (SELECT DISTINCT doc_id, CAST(doc_id AS VARCHAR) AS s FROM documents WHERE doc_id IS NOT NULL),
crc AS (SELECT doc_id, xor(list_reduce(list_transform(range(1, strlen(s) + 1), lambda i: CAST(ascii(s[i]) AS BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS crc FROM ids, bits),
leaves AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce('=' || source, '-') AS tree, {leaf('text')} AS h, {leaf("replace(text, chr(10), '')")} AS bare FROM documents
), placed AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS BIGINT) AS pos FROM leaves
), nodes AS ({levels('placed', 'tree').format(nodes='nodes')}
), subroots AS (SELECT tree, h, CAST(row_number() OVER (ORDER BY tree) - 1 AS BIGINT) AS pos FROM nodes WHERE n = 1 AND pos = 0
), based AS (SELECT 'top' AS tree, h, pos FROM subroots
), tops AS ({levels('based', 'tree').format(nodes='tops')}
), root AS (SELECT h AS root FROM tops WHERE n = 1
), every AS (SELECT * FROM nodes UNION ALL SELECT * FROM tops
), runs AS (
  SELECT a.tree, a.lvl, a.pos, string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos) AS before, string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos) AS behind
  FROM every a JOIN every b ON a.tree = b.tree AND a.lvl = b.lvl AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY a.tree, a.lvl, a.pos
), fold AS (
  SELECT r, p.tree AS on_tree, 0 AS lvl, p.pos, CASE WHEN crc % 2 = 0 THEN bare ELSE p.h END AS h, '' AS seen FROM placed p LEFT JOIN crc USING (doc_id)
  UNION ALL
  SELECT r, on_tree, lvl, pos, h, seen FROM (
    SELECT f.r, CASE WHEN u.tree IS NULL THEN 'top' ELSE f.on_tree END AS on_tree, CASE WHEN u.tree IS NULL THEN 0 ELSE f.lvl + 1 END AS lvl,
      CASE WHEN u.tree IS NULL THEN s.pos ELSE f.pos // 3 END AS pos,
      CASE WHEN u.tree IS NULL THEN f.h ELSE sha256(coalesce(u.before, '') || f.h || coalesce(u.behind, '')) END AS h,
      CASE WHEN u.tree IS NULL THEN f.seen ELSE f.seen || coalesce(u.before, '') || coalesce(u.behind, '') END AS seen
    FROM fold f LEFT JOIN runs u ON u.tree = f.on_tree AND u.lvl = f.lvl AND u.pos = f.pos LEFT JOIN subroots s ON s.tree = f.on_tree
    WHERE u.tree IS NOT NULL OR f.on_tree <> 'top')
), ended AS (
  SELECT f.* FROM fold f LEFT JOIN runs u ON u.tree = f.on_tree AND u.lvl = f.lvl AND u.pos = f.pos WHERE f.on_tree = 'top' AND u.tree IS NULL
)
SELECT p.doc_id, p.h AS leaf, s.h AS subroot, root, sha256(e.seen) AS proof_sha256, e.h AS folded_root, e.h = root AS verified
FROM placed p JOIN ended e USING (r) JOIN subroots s ON s.tree = p.tree, root
"""


ORACLES["op11_octopus_manifest"] = _manifest_sql()


@_query
def op12_multiset_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset.edited(_table(spark, sf_dir, "documents"))


ORACLES["op12_multiset_fingerprints"] = rf"""
WITH d AS (
  SELECT doc_id, t, length(t) AS n, row_number() OVER w AS r, lead(t) OVER w AS follows, first_value(t) OVER w AS first
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) WINDOW w AS (ORDER BY doc_id DESC NULLS LAST, sha256(t))
), e AS (SELECT *, substring(t, 1, n - n // 2) || substring(coalesce(follows, first), 1, n // 2) AS edit FROM d),
x AS (SELECT r, 'own' AS kind, t FROM e UNION ALL SELECT r, 'edit', edit FROM e),
paragraphs AS (SELECT r, kind, sha256(q) || sha256(sha256(q)) AS h FROM (SELECT r, kind, unnest(string_split(t, chr(10))) AS q FROM x)),
digests AS (SELECT r, kind, j, CAST(sum(CAST('0x' || substr(h, 8 * j + 1, 8) AS BIGINT)) % 4294967296 AS BIGINT) AS v FROM paragraphs, (SELECT unnest(range(16)) AS j) GROUP BY ALL),
clauses AS (SELECT r, kind, md5(trim(c)) AS m FROM (SELECT r, kind, unnest(regexp_split_to_array(t, '[.,;:!?
]+')) AS c FROM x) WHERE trim(c) <> ''),
counted AS (SELECT r, kind, j, count(*) FILTER ((CAST('0x' || substr(m, 1 + 8 * (j // 32), 8) AS BIGINT) >> (j % 32)) & 1 = 1) AS v, count(*) AS c FROM clauses, (SELECT unnest(range(64)) AS j) GROUP BY ALL),
bits AS (SELECT r, kind, j, coalesce(v, 0) AS v, coalesce(c, 0) AS c FROM (SELECT r, kind FROM x) CROSS JOIN (SELECT unnest(range(64)) AS j) LEFT JOIN counted USING (r, kind, j)),
hexed AS (
  SELECT r, kind, string_agg(printf('%08x', v), '' ORDER BY lane) AS f FROM (
    SELECT r, kind, j AS lane, v FROM digests UNION ALL SELECT r, kind, 16, max(c) FROM bits GROUP BY r, kind UNION ALL SELECT r, kind, 17 + j, v FROM bits)
  GROUP BY r, kind
), pairs AS (SELECT r AS a, 'own' AS ka, r AS b, 'edit' AS kb FROM e UNION ALL SELECT r, 'own', CASE WHEN follows IS NULL THEN 1 ELSE r + 1 END, 'own' FROM e),
dots AS (
  SELECT p.a, p.kb, any_value(fa.f = fb.f) AS equal, sum((2 * x.v - x.c) * (2 * y.v - y.c)) AS ab, sum((2 * x.v - x.c) * (2 * x.v - x.c)) AS aa, sum((2 * y.v - y.c) * (2 * y.v - y.c)) AS bb
  FROM pairs p JOIN bits x ON x.r = p.a AND x.kind = p.ka JOIN bits y ON y.r = p.b AND y.kind = p.kb AND y.j = x.j
  JOIN hexed fa ON fa.r = p.a AND fa.kind = p.ka JOIN hexed fb ON fb.r = p.b AND fb.kind = p.kb GROUP BY p.a, p.kb
), near AS (SELECT a, kb, CASE WHEN equal THEN 1.0::DOUBLE WHEN aa = 0 OR bb = 0 THEN 0 ELSE least(1, greatest(0, CAST(ab AS DOUBLE) / sqrt(CAST(aa AS DOUBLE) * CAST(bb AS DOUBLE)))) END AS s FROM dots)
SELECT doc_id, n AS n_chars, sha256(edit) AS edited_sha256, o.f AS fingerprint, i.f AS edited_fingerprint, ne.s AS near_edited, nn.s AS near_next
FROM e JOIN hexed o ON o.r = e.r AND o.kind = 'own' JOIN hexed i ON i.r = e.r AND i.kind = 'edit'
JOIN near ne ON ne.a = e.r AND ne.kb = 'edit' JOIN near nn ON nn.a = e.r AND nn.kb = 'own'
"""


@_query
def op13_automaton_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


ORACLES["op13_automaton_collocations"] = rf"""
WITH t AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS s FROM documents
), pieces AS (SELECT lang, unnest(regexp_extract_all(s, '[^.,;:!?
-
]+')) AS p FROM t),
w AS (SELECT lang, regexp_extract_all(p, '[^ 	]+') AS w FROM pieces),
size AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest(range(1, {phrases.MOST_WORDS + 1})) AS k) WHERE len(w) >= k)
), f AS (SELECT lang, k, g, count(*) AS f, string_split(g, ' ') AS ws FROM grams GROUP BY lang, k, g HAVING count(*) >= {phrases.LEAST}),
cuts AS (
  SELECT c.lang, c.g, c.k, c.f AS a, x.k AS cut, x.f AS l, y.f AS r
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM f WHERE k > 1) c
  JOIN f x ON x.lang = c.lang AND x.g = array_to_string(c.ws[1:c.cut], ' ') JOIN f y ON y.lang = c.lang AND y.g = array_to_string(c.ws[c.cut + 1:], ' ')
), inside AS (
  SELECT DISTINCT lang, part AS g FROM (
    SELECT lang, f, array_to_string(ws[i:i + m - 1], ' ') AS part
    FROM (SELECT lang, f, ws, m, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM f WHERE k > 2)))
  JOIN (SELECT lang, g AS part, f AS a FROM f) USING (lang, part) WHERE f >= a
), scored AS (
  SELECT lang, g, a, cut, l, r, n, CAST((1000::HUGEINT * a * n) // (l::HUGEINT * r) AS BIGINT) AS score FROM cuts JOIN size USING (lang) WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = cuts.lang AND i.g = cuts.g)
), best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank, g AS phrase, a, l, r, n, score
FROM best QUALIFY rank <= {phrases.TOP}
"""


@_query
def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rules alone say of each URL: op3's columns that SQL expresses."""
    parts = _table(spark, sf_dir, "pages").select("page_id", urlmodel.host_of(F.col("url")).alias("host"), urlmodel.path_of(F.col("url")).alias("path"))
    found = parts.withColumn("found", urlmodel.rule_of(F.col("host"), F.col("path"), urlmodel.RULES))
    return found.select("page_id", "host", "path", "found.rule", F.col("found.verdict").alias("ruled"))


def _rules_sql() -> str:
    """Every rule that fits, the longest first."""
    listed = ", ".join(f"('{verdict}', '{rule}', '{rule.split('/', 1)[0]}', '/{rule.split('/', 1)[1]}')" for rule, verdict in urlmodel.RULES)
    return rf"""
WITH u AS (SELECT page_id, url, contains(url, '://') AS whole, substr(url, strpos(url, '://') + 3) AS rest FROM pages),
h AS (SELECT page_id, CASE WHEN whole THEN translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
  CASE WHEN whole THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM u),
r AS (SELECT * FROM (VALUES {listed}) AS r(verdict, rule, rule_host, rule_path)),
f AS (SELECT page_id, rule, verdict FROM h JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY strlen(rule) DESC) = 1)
SELECT page_id, host, path, rule, verdict AS ruled FROM h LEFT JOIN f USING (page_id)
"""


ORACLES["url_rules"] = _rules_sql()


@_query
def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sizes and targets of op4, the columns of it that SQL expresses, and how far what is taken of a source lies from its target."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    made = mixing.mixed(docs, carry=["doc_id", "source"])
    taken = made.groupBy("source").agg(F.sum("taken").alias("taken"), F.count("*").alias("n"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    return taken.select("source", "n", "source_size", F.round("target", 6).alias("target"), (F.abs(F.col("taken") - F.col("target")) <= 0.5).alias("met"))


ORACLES["mix_targets"] = rf"""
WITH RECURSIVE s AS (
  SELECT source, count(*) AS n, sum(len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')))::BIGINT AS source_size FROM documents GROUP BY source
), w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight, {mixing.MOST} * source_size::DOUBLE AS most FROM s),
z AS (SELECT {mixing.SHARE} * sum(source_size) AS total FROM w),
-- Sources that would pass their limit at a level stand at it, and the rest is shared again.
levels AS (
  SELECT 0 AS step, (SELECT total / sum(weight) FROM w, z GROUP BY total) AS level
  UNION ALL
  SELECT step + 1, (total - (SELECT coalesce(sum(most), 0) FROM w WHERE most < level * weight)) / (SELECT sum(weight) FROM w WHERE most >= level * weight) FROM levels, z
  WHERE step < 100 AND (SELECT count(*) FROM w WHERE most >= level * weight) > 0
), last AS (SELECT max_by(level, step) AS level FROM levels WHERE level IS NOT NULL)
SELECT source, n, source_size, round(coalesce(least(most, level * weight), most), 6) AS target, true AS met FROM w, last
"""


@_query
def shard_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op9: each document's size and checksum-free columns, and whether the slots of its shard are gapless and only the new shard takes rows."""
    made = jump.sharded(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    whole = made.groupBy("shard").agg(F.count("*").alias("n"), F.min("slot").alias("low"), F.max("slot").alias("high"), F.countDistinct("slot").alias("slots"), F.count_if((F.col("grown_shard") != F.col("shard")) & (F.col("grown_shard") != 16)).alias("strays"))
    sound = whole.agg(F.sum("n").alias("n"), (F.count("*") == 16).alias("all_shards"), F.bool_and((F.col("low") == 0) & (F.col("high") == F.col("n") - 1) & (F.col("slots") == F.col("n"))).alias("gapless"), F.sum("strays").alias("strays"))
    sizes = made.agg(F.sum("size").alias("bytes"), F.countDistinct("law").alias("laws"), F.min("law").alias("law"))
    return sound.crossJoin(sizes)  # single rows


ORACLES["shard_sizes"] = "SELECT count(*) AS n, true AS all_shards, true AS gapless, 0::BIGINT AS strays, sum(strlen(coalesce(text, '')) + 1)::BIGINT AS bytes, 1::BIGINT AS laws, 'key' AS law FROM documents"


@_query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
