"""The engine's query catalog: each operator over the test tables, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import durations as D
from ..functions import text as X
from ..functions.embedding import BUCKETS, hashed_embedding, query_embedding
from ..operators import evaluation as E
from ..operators import exact, metrics, ranking, retrieval
from ..operators.provider import RuleProvider
from ..sources.tables import parquet, parquet_of_ids
from .pipeline import Pipeline

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _plan(spark: SparkSession, sf: str, table: str) -> Pipeline:
    return Pipeline.of(parquet(spark, sf, table), table)


#: Conditions and column descriptions of the catalog's plans with the expressions that stand in for a model.
RULES = RuleProvider(
    {
        "The text mentions the.": lambda c: F.array_contains(X.tokens(c("text")), "the"),
        "The text is long.": lambda c: F.length(c("text")) > 2000,
        "number of different words": lambda c: F.size(X.token_set(c("text"))),
        "first word of the text": lambda c: F.get(X.tokens(c("text")), F.lit(0)),
        "The text speaks of a license.": lambda c: F.contains(F.lower(c("text")), F.lit("license")),
        "Both parts have the same type and size.": lambda c: (c("p_type") == c("p_type_right")) & (c("p_size") == c("p_size_right")),
        "number of turns": lambda c: F.size(c("items")),
        "roles that speak": lambda c: F.array_sort(F.array_distinct(F.transform(c("items"), lambda x: x["role"]))),
        "brand of the part": lambda c: F.lower(c("p_brand")),
        "size class of the part": lambda c: F.when(c("p_size") > 25, "large").otherwise("small"),
    }
)
_WORDS_SQL = "regexp_extract_all(lower({0}), '([a-z0-9]+)', 1)"


# sources, projection, filter, map


@query("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def project_cols(spark, sf):
    return _plan(spark, sf, "orders").project(["o_orderkey", "o_totalprice", "o_orderstatus"]).lower()


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F'")
def exact_filter(spark, sf):
    return _plan(spark, sf, "orders").filter("o_totalprice > 100000 and o_orderstatus = 'F'").project(["o_orderkey", "o_custkey"]).lower()


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net, CASE WHEN l_quantity > 25 THEN 'bulk' ELSE 'single' END AS size_class FROM lineitem")
def map_derive(spark, sf):
    new = {"net": "round(l_extendedprice * (1 - l_discount), 4)", "size_class": "if(l_quantity > 25, 'bulk', 'single')"}
    return _plan(spark, sf, "lineitem").map(new).project(["l_orderkey", "l_linenumber", "net", "size_class"]).lower()


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events WHERE (props->>'$.k')::BIGINT % 2 = 0")
def map_error_drop(spark, sf):
    """A callable that raises drops its row."""

    def even(row):
        import json

        k = json.loads(row["props"])["k"]
        if k % 2:
            raise ValueError("odd")
        return {"k": k}

    return _plan(spark, sf, "events").project(["event_id", "props"]).map(even, [{"name": "k", "type": "int"}]).project(["event_id", "k"]).lower()


@query("SELECT event_id FROM events WHERE event_type = 'click' AND value > 50")
def filter_callable(spark, sf):
    plan = _plan(spark, sf, "events").project(["event_id", "event_type", "value"])
    return plan.filter(lambda r: r["event_type"] == "click" and r["value"] > 50).project(["event_id"]).lower()


@query("SELECT n_nationkey AS n_nationkey_x, n_name AS n_name_x, n_regionkey AS n_regionkey_x FROM nation")
def add_suffix(spark, sf):
    return _plan(spark, sf, "nation").add_col_suffix("_x").lower()


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE coalesce(l_discount > 0.05 AND l_tax < 0.03, false)")
def filter_expr_string(spark, sf):
    return exact.row_filter(parquet(spark, sf, "lineitem"), "l_discount > 0.05 and l_tax < 0.03")[0].select("l_orderkey", "l_linenumber")


@query("SELECT doc_id FROM documents WHERE lang IN ('de', 'fr') AND length(text) >= 3000")
def base_predicates(spark, sf):
    return parquet(spark, sf, "documents").filter(F.col("lang").isin("de", "fr") & (F.length("text") >= 3000)).select("doc_id")


@query("SELECT doc_id, substr(text, 1, 200) AS head, regexp_extract(text, '(.{0,20})[Ll]icense', 1) AS cue FROM documents")
def regex_window_map(spark, sf):
    return _plan(spark, sf, "documents").map({"head": F.substring("text", 1, 200), "cue": F.regexp_extract("text", "(.{0,20})[Ll]icense", 1)}).project(["doc_id", "head", "cue"]).lower()


@query("SELECT doc_id, 'img/' || doc_id::VARCHAR || '.jpg' AS image FROM documents")
def image_source(spark, sf):
    from ..sources.tables import with_images

    return with_images(parquet(spark, sf, "documents").select("doc_id"), "doc_id", "img")


@query("SELECT o_orderkey, o_totalprice, o_orderkey % 7 AS pos FROM orders WHERE o_orderkey <= 7 ORDER BY pos")
def subset_scan(spark, sf):
    from ..sources.tables import subset

    orders = parquet(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    ids = orders.filter("o_orderkey <= 7").select(F.col("o_orderkey").cast("string").alias("id"), (F.col("o_orderkey") % 7).alias("_pos"))
    return subset(orders, ids, "o_orderkey").select("o_orderkey", "o_totalprice", F.col("_pos").alias("pos"))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def parquet_semi_scan(spark, sf):
    ids = parquet(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return parquet_of_ids(spark, f"{sf}/lineitem.parquet", ids, "l_orderkey").select("l_orderkey", "l_linenumber", "l_quantity")


# joins


@query("SELECT c_custkey, c_mktsegment, o_orderkey, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 200000")
def join_equi(spark, sf):
    plan = _plan(spark, sf, "customer").join(_plan(spark, sf, "orders"), "c_custkey = o_custkey").filter("o_totalprice > 200000")
    return plan.project(["c_custkey", "c_mktsegment", "o_orderkey", "o_totalprice"]).lower()


@query("SELECT a.n_name AS n_name, b.s_name FROM nation a JOIN supplier b ON a.n_nationkey < b.s_nationkey AND b.s_acctbal > a.n_nationkey * 400")
def join_theta(spark, sf):
    return _plan(spark, sf, "nation").join(_plan(spark, sf, "supplier"), "n_nationkey < s_nationkey and s_acctbal > n_nationkey * 400").project(["n_name", "s_name"]).lower()


@query("SELECT a.p_partkey, b.p_partkey AS p_partkey_right, lower(a.p_brand) AS brand FROM part a JOIN part b ON a.p_type = b.p_type AND a.p_size = b.p_size AND lower(a.p_brand) = lower(b.p_brand) AND a.p_partkey <> b.p_partkey")
def self_join_pairs(spark, sf):
    parts = _plan(spark, sf, "part").sem_map([{"name": "brand", "type": "str", "description": "brand of the part"}], depends_on=["p_brand"]).project(["p_partkey", "p_type", "p_size", "brand"])
    return parts.join(parts, "p_type = p_type_right and p_size = p_size_right and brand = brand_right and p_partkey <> p_partkey_right").project(["p_partkey", "p_partkey_right", "brand"]).lower(RULES)


@query("SELECT a.n_name, a.n_regionkey, b.n_name AS n_name_right FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def join_collision(spark, sf):
    n = _plan(spark, sf, "nation").project(["n_name", "n_regionkey"])
    return n.join(n, "n_regionkey = n_regionkey_right").project(["n_name", "n_regionkey", "n_name_right"]).lower()


@query("SELECT DISTINCT a, b FROM (SELECT p_size AS a, p_partkey % 50 AS b FROM part UNION ALL SELECT p_partkey % 50, p_size FROM part) WHERE a <> b")
def pair_symmetrize(spark, sf):
    pairs = parquet(spark, sf, "part").select(F.col("p_size").cast("long").alias("a"), (F.col("p_partkey") % 50).alias("b"))
    return E.symmetric_pairs(pairs, "a", "b")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def semi_ids(spark, sf):
    return parquet(spark, sf, "customer").join(parquet(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def anti_ids(spark, sf):
    urgent = parquet(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").withColumnRenamed("o_custkey", "c_custkey")
    return parquet(spark, sf, "customer").join(urgent, "c_custkey", "left_anti").select("c_custkey")


# grouping


@query('SELECT l_returnflag, l_linestatus, count(*) AS "count(l_orderkey)", round(sum(l_quantity), 2) AS sum_qty, round(avg(l_extendedprice), 4) AS avg_price, min(l_discount) AS "min(l_discount)", max(l_tax) AS "max(l_tax)" FROM lineitem GROUP BY ALL')
def groupby_functions(spark, sf):
    plan = _plan(spark, sf, "lineitem").groupby(["l_returnflag", "l_linestatus"], ["count", "sum", "average", "min", "max"], ["l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    plan = plan.map({"sum_qty": "round(`sum(l_quantity)`, 2)", "avg_price": "round(`average(l_extendedprice)`, 4)"})
    return plan.project(["l_returnflag", "l_linestatus", "count(l_orderkey)", "sum_qty", "avg_price", "min(l_discount)", "max(l_tax)"]).lower()


@query('SELECT n_regionkey, list(n_name ORDER BY n_name) AS "list(n_name)", list_sort(list(DISTINCT n_nationkey % 3)) AS "set(m)" FROM nation GROUP BY n_regionkey')
def groupby_list_set(spark, sf):
    return _plan(spark, sf, "nation").map({"m": "n_nationkey % 3"}).groupby(["n_regionkey"], ["list", "set"], ["n_name", "m"]).lower()


@query('SELECT count(*) AS "count(doc_id)" FROM documents WHERE false HAVING count(*) > 0')
def groupby_empty_global(spark, sf):
    return _plan(spark, sf, "documents").filter("false").groupby([], ["count"], ["doc_id"]).lower()


@query('SELECT key, count(*) AS "count(p_partkey)" FROM (SELECT [p_size % 2, p_size % 3] AS key FROM part) GROUP BY key')
def groupby_list_key(spark, sf):
    return _plan(spark, sf, "part").map({"key": "array(p_size % 2, p_size % 3)"}).groupby(["key"], ["count"], ["p_partkey"]).lower()


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def limit_ordered(spark, sf):
    return _plan(spark, sf, "orders").project(["o_orderkey", "o_totalprice"]).limit(20, [F.desc("o_totalprice"), F.col("o_orderkey")]).lower()


# text functions


@query(f"SELECT doc_id, {_WORDS_SQL.format('text')} AS words FROM documents")
def tokenize(spark, sf):
    return parquet(spark, sf, "documents").select("doc_id", X.tokens("text").alias("words"))


@query(f"SELECT doc_id, array_to_string({_WORDS_SQL.format('source || lang')}, ' ') AS phrase FROM documents")
def normalize_phrase(spark, sf):
    return parquet(spark, sf, "documents").select("doc_id", X.normalize_phrase(F.concat("source", "lang")).alias("phrase"))


_JACCARD = """
WITH b AS (SELECT item_id, list_distinct({0}) AS w FROM benchmark), d AS (SELECT doc_id, list_distinct({0}) AS w FROM documents)
SELECT doc_id, item_id, round(len(list_intersect(d.w, b.w)) / (len(d.w) + len(b.w) - len(list_intersect(d.w, b.w))), 6) AS score FROM d JOIN b ON len(list_intersect(d.w, b.w)) > 0
""".format(_WORDS_SQL.format("text"))


def _meeting(spark, sf):
    """Whole documents and whole benchmark items that share a token, with ``common``, their numbers of tokens and the document's words.

    The items' tokens are broadcast, so no token gathers its documents in one task; what moves are the pairs.
    """
    words = F.size(F.filter(F.split("text", r"\s+"), lambda x: x != ""))
    d = parquet(spark, sf, "documents").select("doc_id", words.alias("words"), X.token_set("text").alias("w"), F.monotonically_increasing_id().alias("row"))
    b = parquet(spark, sf, "benchmark").select("item_id", X.token_set("text").alias("v"), F.monotonically_increasing_id().alias("item_row"))
    d = d.select("row", "doc_id", "words", F.size("w").alias("n"), F.explode("w").alias("token"))
    b = b.select("item_row", "item_id", F.size("v").alias("m"), F.explode("v").alias("token"))
    return d.join(F.broadcast(b), "token").groupBy("row", "doc_id", "words", "n", "item_row", "item_id", "m").agg(F.count(F.lit(1)).alias("common"))


@query(_JACCARD)
def token_jaccard(spark, sf):
    """Every pair of similarity above 0."""
    return _meeting(spark, sf).select("doc_id", "item_id", F.round(F.col("common") / (F.col("n") + F.col("m") - F.col("common")), 6).alias("score"))


@query(f"SELECT doc_id, len(list_filter(['of the', 'apache license', 'and'], lambda p: contains(' ' || array_to_string({_WORDS_SQL.format('text')}, ' ') || ' ', ' ' || p || ' '))) AS hits FROM documents")
def phrase_hits(spark, sf):
    return ranking.keyphrases(parquet(spark, sf, "documents"), ["text"], ["of the", "Apache License", "and"]).select("doc_id", F.col("hits").cast("long").alias("hits"))


@query("SELECT conv_id, array_to_string(list_transform(range(1, len(r) + 1), lambda i: i::VARCHAR || '. ' || r[i]), chr(10)) AS numbered FROM (SELECT conv_id, list(role ORDER BY turn) AS r FROM conversations GROUP BY conv_id)")
def number_items(spark, sf):
    rows = parquet(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("r"))
    return rows.select("conv_id", X.number_items(F.transform("r", lambda x: x["role"])).alias("numbered"))


@query("SELECT item, list_sort(list(DISTINCT conv_id)) AS keys FROM (SELECT conv_id, role AS item FROM conversations) GROUP BY item")
def keys_by_items(spark, sf):
    rows = parquet(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("roles"))
    return X.keys_by_items(rows, "conv_id", "roles")


_QUOTE = f"""
WITH q AS (SELECT d.doc_id, b.item_id, d.text AS quote, b.text AS span FROM documents d, benchmark b),
w AS (SELECT *, list_distinct({_WORDS_SQL.format('quote')}) AS qs, list_distinct({_WORDS_SQL.format('span')}) AS gs, len(list_filter(regexp_split_to_array(quote, '\\s+'), lambda x: x <> '')) AS n FROM q),
s AS (SELECT *, len(list_intersect(qs, gs)) AS common FROM w)
SELECT doc_id, item_id, round(CASE WHEN len(qs) > 0 AND n <= 60 AND len(gs) >= 5 AND common / len(gs) >= 0.9 THEN 1.0 WHEN len(qs) + len(gs) - common = 0 THEN 1.0 ELSE common / (len(qs) + len(gs) - common) END, 6)::DOUBLE AS score FROM s WHERE common > 0
"""


@query(_QUOTE)
def quote_score(spark, sf):
    """Every pair of score above 0, from whole texts."""
    holds = (F.col("words") <= 60) & (F.col("m") >= 5) & (F.col("common") / F.col("m") >= 0.9)
    score = F.when(holds, 1.0).otherwise(F.col("common") / (F.col("n") + F.col("m") - F.col("common")))
    return _meeting(spark, sf).select("doc_id", "item_id", F.round(score, 6).alias("score"))


@query("SELECT doc_id, CASE WHEN length(text) <= 300 THEN text ELSE substr(text, 1, 173) || ' …[' || format('{:,}', length(text) - 260) || ' chars omitted]… ' || right(text, 87) END AS short FROM documents")
def truncate_middle(spark, sf):
    return parquet(spark, sf, "documents").select("doc_id", X.truncate_middle("text", 300).alias("short"))


@query("SELECT p_partkey, CASE WHEN p_retailprice = floor(p_retailprice) THEN p_retailprice::BIGINT::VARCHAR ELSE p_retailprice::VARCHAR END AS id FROM part")
def normalize_ids(spark, sf):
    return parquet(spark, sf, "part").select("p_partkey", X.normalize_id("p_retailprice").alias("id"))


_CITE = "SELECT item_id, list_sort(list_distinct([item_id % 5, item_id % 5 + 1, item_id % 5 + 2, item_id % 7])) AS cited FROM benchmark"


@query(_CITE)
def normalize_citations(spark, sf):
    text = F.concat(F.lit("so it is [Article "), F.col("item_id") % 5, F.lit("-"), F.col("item_id") % 5 + 2, F.lit("; "), F.col("item_id") % 7, F.lit("]"))
    return parquet(spark, sf, "benchmark").select("item_id", X.normalize_citations(text).alias("cited"))


@query("SELECT p_partkey, (p_size * CASE WHEN p_partkey % 2 = 0 THEN 30 ELSE 365 END)::DOUBLE AS days FROM part")
def duration_days(spark, sf):
    text = F.concat(F.lit("a term of some ("), F.col("p_size"), F.lit(") "), F.when(F.col("p_partkey") % 2 == 0, "months").otherwise("years"))
    return parquet(spark, sf, "part").select("p_partkey", D.days(D.parse_duration(text)).alias("days"))


@query("SELECT p_partkey, lpad((p_size % 12 + 1)::VARCHAR, 2, '0') AS month, '1?' AS day, CASE WHEN p_size % 100 < 50 THEN '20' ELSE '19' END || lpad((p_size % 100)::VARCHAR, 2, '0') AS year FROM part")
def partial_dates(spark, sf):
    text = F.concat((F.col("p_size") % 12 + 1).cast("string"), F.lit("/1?/"), F.lpad((F.col("p_size") % 100).cast("string"), 2, "0"))
    return parquet(spark, sf, "part").select("p_partkey", D.parse_date(text).alias("d")).select("p_partkey", "d.month", "d.day", "d.year")


# ranking and sampling

QUERY = "the license of the apache hereby"
_BM25 = f"""
WITH words AS (SELECT doc_id, {_WORDS_SQL.format("coalesce(text, '')")} AS w FROM documents),
dl AS (SELECT doc_id, len(w) AS dl FROM words), tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM words) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), size AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
raw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw, n, avgdl FROM df, size), mean AS (SELECT avg(raw) AS mean FROM raw),
q AS (SELECT term, count(*) AS times FROM (SELECT unnest({_WORDS_SQL.format(repr(QUERY))}) AS term) GROUP BY term),
w AS (SELECT term, times * CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END AS weight, avgdl FROM raw JOIN q USING (term), mean),
bm AS (SELECT doc_id, sum(weight * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS bm25 FROM tf JOIN w USING (term) JOIN dl USING (doc_id) GROUP BY doc_id),
scores AS (SELECT d.doc_id, d.text, coalesce(bm25, 0.0) AS bm25 FROM documents d LEFT JOIN bm USING (doc_id))
"""


@query(f"{_BM25} SELECT doc_id, round(bm25, 6) AS bm25 FROM scores")
def bm25_rank(spark, sf):
    return ranking.bm25(parquet(spark, sf, "documents").select("doc_id", "text"), "text", QUERY).select("doc_id", F.round("bm25", 6).alias("bm25"))


@query(f"SELECT (i - 1)::INTEGER AS position, q[i] AS term FROM (SELECT ['the', 'zzzqx', 'hereby', 'license', 'qqq'] AS q), range(1, 6) AS r(i) WHERE q[i] NOT IN (SELECT unnest({_WORDS_SQL.format('text')}) FROM documents WHERE text IS NOT NULL)")
def dead_terms(spark, sf):
    return ranking.dead_terms(parquet(spark, sf, "documents"), "text", "the zzzqx hereby license qqq")


_VECTOR = [((i * 7) % 13 - 6) / 6.0 for i in range(64)]


@query(f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {_VECTOR}::DOUBLE[]), 6) AS dense FROM embeddings")
def cosine_rank(spark, sf):
    return ranking.dense(parquet(spark, sf, "embeddings"), ["embedding"], _VECTOR).select("vec_id", F.round("dense", 6).alias("dense"))


_HYBRID = f"""{_BM25.rstrip()},
d AS (SELECT s.doc_id, bm25, len(list_filter(['of the', 'license'], lambda p: contains(' ' || array_to_string({_WORDS_SQL.format('text')}, ' ') || ' ', ' ' || p || ' '))) AS hits,
      CASE WHEN e.vec_id IS NULL THEN 0.0 ELSE list_cosine_similarity(embedding::DOUBLE[], {_VECTOR}::DOUBLE[]) END AS dense FROM scores s LEFT JOIN embeddings e ON s.doc_id = e.vec_id),
a AS (SELECT *, (bm25 - min(bm25) OVER ()) / (max(bm25) OVER () - min(bm25) OVER ()) + hits AS total FROM d),
b AS (SELECT doc_id, (total - min(total) OVER ()) / (max(total) OVER () - min(total) OVER ()) AS sparse, (dense - min(dense) OVER ()) / (max(dense) OVER () - min(dense) OVER ()) AS dense_norm FROM a),
scored AS (SELECT doc_id, round(0.5 * sparse + 0.5 * dense_norm, 6) AS score FROM b)
"""


def _hybrid(spark, sf) -> DataFrame:
    docs = parquet(spark, sf, "documents").select("doc_id", "text")
    scored = ranking.keyphrases(ranking.bm25(docs, "text", QUERY), ["text"], ["of the", "license"])
    vectors = parquet(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    scored = ranking.dense(scored.join(vectors, "doc_id", "left"), ["embedding"], _VECTOR)
    return ranking.combine(scored, 0.5).select("doc_id", F.round("score", 6).alias("score"))


@query(f"{_HYBRID} SELECT doc_id, score FROM scored")
def hybrid_score(spark, sf):
    return _hybrid(spark, sf)


@query("SELECT unnest([10, 20, 30, 40, 50, 60, 70, 80, 90])::INTEGER AS p, round(unnest((SELECT quantile_cont(o_totalprice, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) FROM orders)), 6) AS value")
def score_percentiles(spark, sf):
    return ranking.percentiles(parquet(spark, sf, "orders"), "o_totalprice")


_RANKED = """
WITH s AS (SELECT p_partkey, (p_size - 1) / 49.0 AS score FROM part), o AS (SELECT *, row_number() OVER (ORDER BY score DESC, p_partkey) AS rank, round_even(score, 3) AS r FROM s),
ranked AS (SELECT p_partkey, score, rank, dense_rank() OVER (ORDER BY r DESC) - 1 AS run FROM o)
"""


def _ranked(spark, sf) -> DataFrame:
    return ranking.ranked(parquet(spark, sf, "part").select("p_partkey", ((F.col("p_size") - 1) / 49.0).alias("score")), "p_partkey")


@query(f"{_RANKED} SELECT p_partkey, rank::BIGINT AS rank, run::BIGINT AS run FROM ranked")
def flat_runs(spark, sf):
    return _ranked(spark, sf).select("p_partkey", F.col("rank").cast("long").alias("rank"), F.col("run").cast("long").alias("run"))


_BAND = """, b{0} AS (SELECT r.p_partkey FROM ranked r, (SELECT round_even({1} * (count(*) - 1), 0)::BIGINT + 1 AS start FROM {2}) x
  WHERE r.p_partkey NOT IN (SELECT p_partkey FROM taken{0})
  ORDER BY CASE WHEN r.run = (SELECT run FROM ranked WHERE rank = start) THEN 0 WHEN r.rank >= start THEN 1 ELSE 2 END,
           CASE WHEN r.run = (SELECT run FROM ranked WHERE rank = start) THEN md5('42:' || r.p_partkey::VARCHAR) END,
           CASE WHEN r.rank >= start THEN r.rank ELSE -r.rank END LIMIT {3})"""


@query(f"{_RANKED}, taken1 AS (SELECT NULL::BIGINT AS p_partkey WHERE false){_BAND.format(1, '0.0', 'ranked', 10)}, taken2 AS (SELECT * FROM b1){_BAND.format(2, '0.5', 'ranked', 5)}, taken3 AS (SELECT * FROM b1 UNION ALL SELECT * FROM b2){_BAND.format(3, '0.9', 'ranked', 5)} SELECT 'top' AS band, p_partkey FROM b1 UNION ALL SELECT 'middle', p_partkey FROM b2 UNION ALL SELECT 'negative', p_partkey FROM b3")
def gradient_subset(spark, sf):
    scored = parquet(spark, sf, "part").select("p_partkey", ((F.col("p_size") - 1) / 49.0).alias("score"))
    return ranking.gradient_subset(scored, "p_partkey", 20, 42).select("band", "p_partkey")


@query(f"{_RANKED}, taken1 AS (SELECT NULL::BIGINT AS p_partkey WHERE false){_BAND.format(1, '0.0', 'ranked', 10)}, taken2 AS (SELECT * FROM b1){_BAND.format(2, '0.5', 'ranked', 5)}, taken3 AS (SELECT * FROM b1 UNION ALL SELECT * FROM b2){_BAND.format(3, '0.9', 'ranked', 5)} , picked AS (SELECT 'top' AS band, p_partkey FROM b1 UNION ALL SELECT 'middle', p_partkey FROM b2 UNION ALL SELECT 'negative', p_partkey FROM b3) SELECT band, count(*) AS n, min(rank) AS rank_min, max(rank) AS rank_max, min(score) AS score_min, max(score) AS score_max FROM picked JOIN ranked USING (p_partkey) GROUP BY band")
def band_summary(spark, sf):
    scored = parquet(spark, sf, "part").select("p_partkey", ((F.col("p_size") - 1) / 49.0).alias("score"))
    rows = ranking.band_summary(ranking.gradient_subset(scored, "p_partkey", 20, 42))
    return rows.select("band", "n", F.col("rank_min").cast("long").alias("rank_min"), F.col("rank_max").cast("long").alias("rank_max"), "score_min", "score_max")


@query("WITH a AS (SELECT p_partkey FROM part WHERE p_size < 20 ORDER BY p_retailprice DESC, p_partkey LIMIT 12) SELECT 1 AS stratum, p_partkey FROM a UNION ALL SELECT 2, p_partkey FROM (SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM a) ORDER BY p_retailprice DESC, p_partkey LIMIT 8)")
def strata_subset(spark, sf):
    part, order = parquet(spark, sf, "part"), [F.desc("p_retailprice"), F.col("p_partkey")]
    first = ranking.top_k(part.filter("p_size < 20"), 12, order).select("p_partkey")
    second = ranking.top_k(part, 8, order, first, "p_partkey").select("p_partkey")
    return first.select(F.lit(1).alias("stratum"), "p_partkey").unionByName(second.select(F.lit(2).alias("stratum"), "p_partkey"))


@query("SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id::VARCHAR), doc_id LIMIT 40")
def random_subset(spark, sf):
    return ranking.random_rows(parquet(spark, sf, "documents").select("doc_id"), "doc_id", 40, 42)


@query("SELECT doc_id FROM documents WHERE lang <> 'en' ORDER BY md5('43:' || doc_id::VARCHAR), doc_id LIMIT 15")
def fill_subset(spark, sf):
    docs = parquet(spark, sf, "documents").select("doc_id", "lang")
    return ranking.random_rows(docs.join(docs.filter("lang = 'en'").select("doc_id"), "doc_id", "left_anti"), "doc_id", 15, 43).select("doc_id")


# retrieval

_CHUNKS = "SELECT doc_id, i AS chunk, substr(text, i * 1000 + 1, 1000) AS piece FROM (SELECT doc_id, text, unnest(range(greatest(ceil(length(text) / 1000), 1)::BIGINT)) AS i FROM documents WHERE length(text) >= 1000)"


@query(f"SELECT doc_id, chunk::INTEGER AS chunk, piece FROM ({_CHUNKS.replace(' WHERE length(text) >= 1000', '')})")
def chunk_text(spark, sf):
    docs = parquet(spark, sf, "documents")
    return docs.select("doc_id", F.posexplode(X.chunks("text", 1000)).alias("chunk", "piece"))


_CHUNK_SCORES = f"""
WITH c AS ({_CHUNKS}), words AS (SELECT doc_id, chunk, {_WORDS_SQL.format('piece')} AS w FROM c), dl AS (SELECT doc_id, chunk, len(w) AS dl FROM words),
tf AS (SELECT doc_id, chunk, term, count(*) AS tf FROM (SELECT doc_id, chunk, unnest(w) AS term FROM words) GROUP BY ALL), df AS (SELECT doc_id, term, count(*) AS df FROM tf GROUP BY ALL),
size AS (SELECT doc_id, count(*) AS n, avg(dl) AS avgdl FROM dl GROUP BY doc_id), raw AS (SELECT doc_id, term, ln(n - df + 0.5) - ln(df + 0.5) AS raw, avgdl FROM df JOIN size USING (doc_id)),
mean AS (SELECT doc_id, avg(raw) AS mean FROM raw GROUP BY doc_id), q AS (SELECT term, count(*) AS times FROM (SELECT unnest({_WORDS_SQL.format(repr(QUERY))}) AS term) GROUP BY term),
w AS (SELECT doc_id, term, times * CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END AS weight, avgdl FROM raw JOIN q USING (term) JOIN mean USING (doc_id)),
bm AS (SELECT doc_id, chunk, sum(weight * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS s FROM tf JOIN w USING (doc_id, term) JOIN dl USING (doc_id, chunk) GROUP BY ALL),
scored AS (SELECT c.doc_id, c.chunk, round(coalesce(s, 0.0), 6) AS sim FROM c LEFT JOIN bm USING (doc_id, chunk)),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sim DESC, chunk) AS rank FROM scored)
"""


def _best_chunks(spark, sf, **rule) -> DataFrame:
    return retrieval.best_chunks(parquet(spark, sf, "documents"), "doc_id", "text", QUERY, 1000, digits=6, **rule)


@query(f"{_CHUNK_SCORES} SELECT doc_id, chunk::INTEGER AS chunk, sim, rank::INTEGER AS rank FROM o WHERE rank <= 2")
def chunk_topk_bm25(spark, sf):
    return _best_chunks(spark, sf, top=2).select("doc_id", "chunk", "sim", "rank")


@query(f"{_CHUNK_SCORES} SELECT doc_id, chunk::INTEGER AS chunk, sim FROM o WHERE sim >= 0.5 OR rank = 1")
def chunk_threshold(spark, sf):
    return _best_chunks(spark, sf, threshold=0.5).select("doc_id", "chunk", "sim")


@query("SELECT doc_id, greatest(floor(greatest(length(text) / 4, 500)), 1)::INTEGER AS size FROM documents")
def chunk_size_expression(spark, sf):
    return parquet(spark, sf, "documents").select("doc_id", retrieval.chunk_size("max(input_length / 4, 500)", F.length("text")).alias("size"))


@query(f"{_CHUNK_SCORES}, best AS (SELECT doc_id, string_agg(piece, ' ' ORDER BY rank) AS seen FROM o JOIN c USING (doc_id, chunk) WHERE rank <= 2 GROUP BY doc_id) SELECT d.doc_id FROM documents d LEFT JOIN best USING (doc_id) WHERE contains(lower(coalesce(seen, d.text)), 'license')")
def rag_filter(spark, sf):
    plan = _plan(spark, sf, "documents").project(["doc_id", "text"])
    return plan.rag_filter("The text speaks of a license.", QUERY, "doc_id", ["text"], chunk_size=1000, top=2).project(["doc_id"]).lower(RULES)


_RETRIEVED = f"{_CHUNK_SCORES}, best AS (SELECT doc_id, string_agg('[Chunk rank ' || rank || '/' || least(n, 2) || ', BM25 ' || format('{{:.4f}}', sim) || ']' || chr(10) || piece, chr(10) || chr(10) ORDER BY rank) AS seen FROM o JOIN c USING (doc_id, chunk) JOIN (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id) USING (doc_id) WHERE rank <= 2 GROUP BY doc_id)"


@query(f"{_RETRIEVED} SELECT d.doc_id, len(list_distinct({_WORDS_SQL.format('coalesce(seen, d.text)')})) AS words FROM documents d LEFT JOIN best USING (doc_id)")
def rag_map(spark, sf):
    plan = _plan(spark, sf, "documents").project(["doc_id", "text"])
    made = [{"name": "words", "type": "int", "description": "number of different words"}]
    return plan.rag_map(made, QUERY, "doc_id", ["text"], chunk_size=1000, top=2).project(["doc_id", "words"]).lower(RULES)


@query(f"WITH w AS (SELECT doc_id, list_transform({_WORDS_SQL.format('text')}, lambda x: ('0x' || substr(md5(x), 1, 2))::INTEGER % {BUCKETS}) AS b FROM documents), v AS (SELECT doc_id, list_transform(range({BUCKETS}), lambda i: len(list_filter(b, lambda x: x = i))::DOUBLE) AS v FROM w) SELECT doc_id, round(CASE WHEN list_sum(v) = 0 THEN 0.0 ELSE list_cosine_similarity(v, {query_embedding(QUERY)}::DOUBLE[]) END, 6) AS sim FROM v")
def hashed_embedding_cosine(spark, sf):
    q = F.array(*[F.lit(x) for x in query_embedding(QUERY)])
    return parquet(spark, sf, "documents").select("doc_id", F.round(X.cosine(hashed_embedding(F.col("text")), q), 6).alias("sim"))


# model operators, over rules in place of a model


@query(f"SELECT doc_id, lang FROM documents WHERE list_contains({_WORDS_SQL.format('text')}, 'the')")
def sem_filter(spark, sf):
    return _plan(spark, sf, "documents").sem_filter("The text mentions the.", depends_on=["text"]).project(["doc_id", "lang"]).lower(RULES)


@query(f"SELECT doc_id, len(list_distinct({_WORDS_SQL.format('text')})) AS words, {_WORDS_SQL.format('text')}[1] AS first FROM documents")
def sem_map(spark, sf):
    made = [{"name": "words", "type": "int", "description": "number of different words"}, {"name": "first", "type": "str", "description": "first word of the text"}]
    return _plan(spark, sf, "documents").sem_map(made, depends_on=["text"]).project(["doc_id", "words", "first"]).lower(RULES)


@query(f"SELECT doc_id FROM documents WHERE lang = 'de' OR list_contains({_WORDS_SQL.format('text')}, 'the')")
def skip_if_filter(spark, sf):
    return _plan(spark, sf, "documents").sem_filter("The text mentions the.", depends_on=["text"], skip_if="lang = 'de'").project(["doc_id"]).lower(RULES)


@query(f"SELECT doc_id, CASE WHEN lang <> 'de' THEN len(list_distinct({_WORDS_SQL.format('text')})) END AS words FROM documents")
def skip_if_map(spark, sf):
    made = [{"name": "words", "type": "int", "description": "number of different words"}]
    return _plan(spark, sf, "documents").sem_map(made, depends_on=["text"], skip_if="lang = 'de'").project(["doc_id", "words"]).lower(RULES)


@query("SELECT a.p_partkey, b.p_partkey AS p_partkey_right FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_size = b.p_size")
def sem_join(spark, sf):
    part = _plan(spark, sf, "part").project(["p_partkey", "p_brand", "p_type", "p_size"])
    condition = "Both parts have the same type and size."
    return part.sem_join(part, condition, depends_on=["p_type", "p_size", "p_type_right", "p_size_right"], blocking="p_brand = p_brand_right").project(["p_partkey", "p_partkey_right"]).lower(RULES)


@query("SELECT a.n_nationkey AS p_size, b.n_nationkey AS p_size_right FROM nation a, nation b WHERE a.n_regionkey = b.n_regionkey AND a.n_nationkey % 3 = b.n_nationkey % 3")
def sem_join_all_pairs(spark, sf):
    from ..operators.provider import RuleProvider as Rules

    rules = Rules({"same region and rest": lambda c: (c("n_regionkey") == c("n_regionkey_right")) & (c("n_nationkey") % 3 == c("n_nationkey_right") % 3)})
    nation = _plan(spark, sf, "nation").project(["n_nationkey", "n_regionkey"])
    out = nation.sem_join(nation, "same region and rest", depends_on=["n_regionkey", "n_nationkey", "n_regionkey_right", "n_nationkey_right"], most_pairs=10_000).lower(rules)
    return out.select(F.col("n_nationkey").alias("p_size"), F.col("n_nationkey_right").alias("p_size_right"))


_TURNS = [{"name": "turns", "type": "int", "description": "number of turns"}]


@query("SELECT conv_id, count(*) AS turns FROM conversations GROUP BY conv_id")
def sem_agg(spark, sf):
    return _plan(spark, sf, "conversations").sem_agg(_TURNS, "Count the turns.", group_by=["conv_id"], depends_on=["turn", "role"]).lower(RULES)


@query("SELECT DISTINCT conv_id, role AS speaker FROM conversations")
def sem_agg_one_to_many(spark, sf):
    made = [{"name": "speaker", "type": "list[str]", "description": "roles that speak"}]
    return _plan(spark, sf, "conversations").sem_agg(made, "List the speakers.", group_by=["conv_id"], depends_on=["turn", "role"], one_to_many=True).lower(RULES)


@query("SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id) AS turns FROM conversations")
def sem_agg_keep_inputs(spark, sf):
    plan = _plan(spark, sf, "conversations").sem_agg(_TURNS, "Count the turns.", group_by=["conv_id"], depends_on=["turn", "role"], keep_inputs=True)
    return plan.project(["conv_id", "turn", "turns"]).lower(RULES)


@query("SELECT count(*) AS turns FROM conversations")
def sem_agg_global(spark, sf):
    return _plan(spark, sf, "conversations").sem_agg(_TURNS, "Count the turns.", depends_on=["turn"]).lower(RULES)


@query("SELECT p_partkey FROM part WHERE p_size > 25 AND p_brand = 'Brand#12'")
def map_then_filter_plan(spark, sf):
    """The shape of a classification plan: the exact filter moves below the model."""
    made = [{"name": "class", "type": "str", "description": "size class of the part"}]
    return _plan(spark, sf, "part").sem_map(made, depends_on=["p_size"]).filter("class = 'large'").filter("p_brand = 'Brand#12'").project(["p_partkey"]).lower(RULES)


@query("SELECT role AS item, list_sort(list(DISTINCT conv_id)) AS keys FROM conversations GROUP BY role")
def verifier_pattern(spark, sf):
    """A group summary put back beside its rows, then an inverted index of what it names."""
    made = [{"name": "speakers", "type": "list[str]", "description": "roles that speak"}]
    plan = _plan(spark, sf, "conversations").sem_agg(made, "List the speakers.", group_by=["conv_id"], depends_on=["turn", "role"])
    return X.keys_by_items(plan.lower(RULES), "conv_id", "speakers")


@query(f"SELECT doc_id FROM documents WHERE length(text) > 2000 OR list_contains({_WORDS_SQL.format('text')}, 'the')")
def vote_cascade(spark, sf):
    """Rows that a cheap test settles skip the model."""
    plan = _plan(spark, sf, "documents").map({"long": "length(text) > 2000"})
    return plan.sem_filter("The text mentions the.", depends_on=["text"], skip_if="long").project(["doc_id"]).lower(RULES)


# evaluation, cost, stability


@query("WITH r AS (SELECT doc_id FROM documents WHERE doc_id % 3 = 0), w AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1), p AS (SELECT DISTINCT doc_id FROM documents), c AS (SELECT count(*) FILTER (r.doc_id IS NOT NULL AND w.doc_id IS NOT NULL) AS tp, count(*) FILTER (r.doc_id IS NOT NULL AND w.doc_id IS NULL) AS fp, count(*) FILTER (r.doc_id IS NULL AND w.doc_id IS NOT NULL) AS fn, count(*) FILTER (r.doc_id IS NULL AND w.doc_id IS NULL) AS tn FROM p LEFT JOIN r USING (doc_id) LEFT JOIN w USING (doc_id)) SELECT tp, fp, fn, tn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c")
def set_f1(spark, sf):
    docs, labels = parquet(spark, sf, "documents").select("doc_id"), parquet(spark, sf, "labels")
    out = E.set_f1(docs.filter("doc_id % 3 = 0"), labels.filter("quality = 1").select("doc_id"), docs, "doc_id")
    return out.select("tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


_BENT = "regexp_replace(text, '[aeo]n[a-z]*', 'x', 'g')"


def _bent(text="text"):
    """A text with some of its words changed: what a plan might have quoted of it."""
    return F.regexp_replace(text, "[aeo]n[a-z]*", "x")


@query(f"WITH x AS (SELECT d.doc_id, list_distinct({_WORDS_SQL.format(_BENT)}) AS q, list_distinct({_WORDS_SQL.format('text')}) AS g FROM documents d JOIN labels USING (doc_id) WHERE quality = 1), s AS (SELECT *, len(list_intersect(q, g)) / greatest(len(q) + len(g) - len(list_intersect(q, g)), 1) AS j, len(q) + len(g) = 0 AS none FROM x) SELECT count(*) FILTER (j > 0.5 OR none) AS tp, count(*) FILTER (NOT (j > 0.5 OR none)) AS fn FROM s")
def set_f1_jaccard(spark, sf):
    docs = parquet(spark, sf, "documents")
    gold = docs.join(parquet(spark, sf, "labels").filter("quality = 1"), "doc_id").select("doc_id", F.array("text").alias("spans"))
    return E.set_f1_reason(docs.select("doc_id", _bent().alias("reason")), gold, docs, "doc_id", "reason", "spans").select("tp", "fn")


@query(f"WITH x AS (SELECT d.doc_id, {_BENT} AS quote, list_distinct({_WORDS_SQL.format(_BENT)}) AS q, list_distinct({_WORDS_SQL.format('text')}) AS g, len(list_filter(regexp_split_to_array({_BENT}, '\\s+'), lambda x: x <> '')) AS n FROM documents d JOIN labels USING (doc_id) WHERE quality = 1), s AS (SELECT *, len(list_intersect(q, g)) AS c FROM x), t AS (SELECT CASE WHEN len(q) > 0 AND n <= 60 AND len(g) >= 5 AND c / len(g) >= 0.9 THEN 1.0 WHEN len(q) + len(g) - c = 0 THEN 1.0 ELSE c / (len(q) + len(g) - c) END AS score FROM s) SELECT count(*) FILTER (score > 0.5) AS tp, count(*) FILTER (NOT score > 0.5) AS fn FROM t")
def set_f1_quote(spark, sf):
    docs = parquet(spark, sf, "documents")
    gold = docs.join(parquet(spark, sf, "labels").filter("quality = 1"), "doc_id").select("doc_id", F.array("text").alias("spans"))
    return E.set_f1_quote(docs.select("doc_id", _bent().alias("quote")), gold, docs, "doc_id", "quote", "spans").select("tp", "fn")


_MACRO = f"""WITH c AS (SELECT lang AS category, CASE WHEN doc_id % 5 = 0 THEN '' ELSE lower(text) END AS g, CASE WHEN doc_id % 7 = 0 THEN '' ELSE lower({_BENT}) END AS p FROM documents),
w AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(g, '\\s+'), lambda x: x <> '')) AS gw, list_distinct(list_filter(regexp_split_to_array(p, '\\s+'), lambda x: x <> '')) AS pw FROM c),
j AS (SELECT *, g <> '' AND p <> '' AND len(list_intersect(gw, pw)) / greatest(len(gw) + len(pw) - len(list_intersect(gw, pw)), 1) > 0.15 AS hit FROM w),
n AS (SELECT category, count(*) FILTER (hit) AS tp, count(*) FILTER (p <> '' AND NOT hit) AS fp, count(*) FILTER (g <> '' AND p = '') AS fn, count(*) FILTER (g = '' AND p = '') AS tn FROM j GROUP BY category),
f AS (SELECT category, tp, fp, fn, tn, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS recall, CASE WHEN tp + fn = 0 THEN NULL WHEN tp = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1 FROM n)
"""


def _cells(spark, sf):
    return parquet(spark, sf, "documents").select(F.col("lang").alias("category"), F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("text")).alias("gold"), F.when(F.col("doc_id") % 7 == 0, "").otherwise(_bent()).alias("got"))


@query(f"{_MACRO} SELECT category, tp, fp, fn, tn, round(f1, 6)::DOUBLE AS f1 FROM f")
def macro_f1(spark, sf):
    return E.macro_f1(_cells(spark, sf), "category", "gold", "got").select("category", "tp", "fp", "fn", "tn", F.round("f1", 6).alias("f1"))


@query(f"{_MACRO} SELECT round(avg(precision), 6)::DOUBLE AS avg_precision, round(avg(recall), 6)::DOUBLE AS avg_recall, round(avg(f1), 6)::DOUBLE AS avg_f1, avg(CASE WHEN recall IS NULL THEN 1.0 ELSE 0.0 END)::DOUBLE AS nan_fraction FROM f")
def macro_means(spark, sf):
    means = E.macro_means(E.macro_f1(_cells(spark, sf), "category", "gold", "got"))
    return means.select(*[F.round(c, 6).alias(c) for c in ("avg_precision", "avg_recall", "avg_f1")], "nan_fraction")


@query("SELECT p_partkey::VARCHAR AS p_partkey, category, trim(regexp_replace(t, '[^a-zA-Z0-9\\s]', '', 'g')) AS text FROM (SELECT p_partkey, 'p_type' AS category, p_type AS t FROM part UNION ALL SELECT p_partkey, 'p_brand', p_brand FROM part) WHERE trim(regexp_replace(t, '[^a-zA-Z0-9\\s]', '', 'g')) <> ''")
def wide_to_long(spark, sf):
    return E.wide_to_long(parquet(spark, sf, "part").withColumnRenamed("p_type", "P-Type"), "p_partkey", ["p_type", "p_brand", "absent"])


@query("SELECT conv_id::VARCHAR AS conv_id, lower(role) AS category, string_agg(trim(regexp_replace(text, '[^a-zA-Z0-9\\s]', '', 'g')), ' ' ORDER BY turn) AS text FROM conversations WHERE trim(regexp_replace(text, '[^a-zA-Z0-9\\s]', '', 'g')) <> '' GROUP BY ALL")
def nested_to_long(spark, sf):
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x["role"].alias("clause_type"), x["text"].alias("text_span")))
    return E.nested_to_long(parquet(spark, sf, "conversations").groupBy("conv_id").agg(turns.alias("clauses")), "conv_id", "clauses")


_INSIGHTS = "SELECT item_id AS insight_id, [item_id % 7, item_id % 11 + 100000000, item_id + 1] AS docs FROM benchmark"
_PRESENT = f"WITH i AS ({_INSIGHTS}), present AS (SELECT insight_id, list_sort(list(DISTINCT d)) AS ref FROM (SELECT insight_id, unnest(docs) AS d FROM i) WHERE d IN (SELECT doc_id FROM documents) GROUP BY insight_id)"


def _present(spark, sf):
    i = F.col("item_id")
    insights = parquet(spark, sf, "benchmark").select(i.alias("insight_id"), F.array(i % 7, i % 11 + 100_000_000, i + 1).alias("docs"))
    return E.insights_present(insights, parquet(spark, sf, "documents"), "docs", "doc_id")


@query(f"{_PRESENT} SELECT insight_id, ref FROM present")
def insights_present(spark, sf):
    return _present(spark, sf).select("insight_id", "ref")


@query(f"""{_PRESENT}, v AS (SELECT item_id AS insight_id, CASE item_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.0 END AS coverage, CASE WHEN item_id % 3 < 2 AND item_id % 4 > 0 THEN item_id % 5 END AS bullet_id FROM benchmark WHERE item_id % 10 > 0),
b AS (SELECT k AS bullet_id, list_distinct([k, k + 1, k + 2]) AS cited FROM range(5) AS r(k)),
s AS (SELECT insight_id, coalesce(coverage, 0.0) AS coverage, ref, coalesce(cited, []) AS cited FROM present LEFT JOIN v USING (insight_id) LEFT JOIN b USING (bullet_id)),
f AS (SELECT coverage, CASE WHEN coverage > 0 THEN CASE WHEN len(cited) = 0 THEN 0.0 ELSE len(list_intersect(cited, ref)) / len(cited) END END AS p, CASE WHEN coverage > 0 THEN len(list_intersect(cited, ref)) / len(ref) END AS r FROM s),
g AS (SELECT *, CASE WHEN coverage > 0 THEN CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END END AS f1 FROM f)
SELECT round(avg(coalesce(coverage * f1, 0.0)), 6)::DOUBLE AS score, round(avg(coverage), 6)::DOUBLE AS coverage, round(avg(f1), 6)::DOUBLE AS citation_f1, count(*) AS n_insights, count(*) FILTER (coverage = 1) AS fully_covered FROM g""")
def summary_citation(spark, sf):
    i, k = F.col("item_id"), F.col("id")
    kept = F.when((i % 3 < 2) & (i % 4 > 0), i % 5)
    verdicts = parquet(spark, sf, "benchmark").filter("item_id % 10 > 0").select(i.alias("insight_id"), F.when(i % 3 == 0, 1.0).when(i % 3 == 1, 0.5).otherwise(0.0).alias("coverage"), kept.alias("bullet_id"))
    bullets = spark.range(5).select(k.alias("bullet_id"), X.normalize_citations(F.concat(F.lit("so it is [Article "), k, F.lit("-"), k + 2, F.lit("]"))).alias("cited"))
    means = E.summary_means(E.summary_scores(_present(spark, sf), bullets, verdicts))
    return means.select(*[F.round(c, 6).alias(c) for c in ("score", "coverage", "citation_f1")], "n_insights", "fully_covered")


@query("SELECT p_partkey FROM part WHERE p_partkey % 11 > 0 AND p_size % 5 > 2 AND p_size * CASE WHEN p_partkey % 2 = 0 THEN 30 ELSE 7 END >= 90 AND 1990 + p_size > 2000")
def query_conditions(spark, sf):
    """Conditions over parsed answers, and rows whose ground truth cannot settle them left out."""
    size, key = F.col("p_size"), F.col("p_partkey")
    truth = parquet(spark, sf, "part").select(
        "p_partkey", F.to_json(F.struct((size % 5).alias("number_parties"))).alias("Parties Answer"),
        F.to_json(F.array(F.struct(size.alias("length"), F.when(key % 2 == 0, "months").otherwise("weeks").alias("unit")))).alias("Notice Answer"),
        F.to_json(F.array(F.struct((size + 1990).cast("string").alias("year")), F.struct(F.lit("20??").alias("year")))).alias("Expiration Answer"),
        F.when(key % 11 == 0, F.lit('{"Parties": "unclear"}')).otherwise(F.lit('{"Other": "x"}')).alias("unusable"),
    )
    return E.gold_ids(truth, [E.more_than("Parties", 2), E.at_least_days("Notice", 90), E.after_year("Expiration", 2000)], ["p_partkey"])


@query("SELECT c_custkey, lower(replace(c_name, '#', ' ')) AS name, c_custkey % 3 = 0 AS same FROM customer")
def name_matches(spark, sf):
    from ..functions.names import name_matches as matches
    from ..functions.names import normalize_name

    said = F.concat(F.lit("The "), F.replace("c_name", F.lit("Cust"), F.lit("Cüst")), F.when(F.col("c_custkey") % 2 == 0, ", Inc.").otherwise(" Holdings S.p.A."))
    accepted = F.array(F.lit("Other"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise(F.lit("Another")))
    return parquet(spark, sf, "customer").select("c_custkey", normalize_name(said).alias("name"), matches(said, accepted).alias("same"))


@query("SELECT p_partkey, regexp_replace(lower(trim(p_type)), '[ /-]', '_', 'g') AS category, regexp_replace(upper(p_name), '[^A-Z0-9]', '', 'g') AS contract FROM part")
def key_normalizers(spark, sf):
    from ..functions.names import category_key, contract_key

    return parquet(spark, sf, "part").select("p_partkey", category_key(F.col("p_type")).alias("category"), contract_key(F.concat("p_name", F.lit(".PDF'"))).alias("contract"))


@query("""SELECT p_partkey, '{"id":' || p_partkey || ',"brand":"' || p_brand || '","category":"' || p_type || '"}' AS id, p_partkey || '-' || p_size AS pair FROM part""")
def composite_id(spark, sf):
    from ..functions.names import composite_id as composed
    from ..functions.names import pair_id

    return parquet(spark, sf, "part").select("p_partkey", composed(id=F.col("p_partkey"), brand=F.col("p_brand"), category=F.col("p_type")).alias("id"), pair_id(F.col("p_partkey"), F.col("p_size")).alias("pair"))


@query("SELECT item_id, 'see [' || array_to_string(list_concat(range(item_id % 5, item_id % 5 + 3), [item_id % 7]), ', ') || '] and [doctor]' AS text, 1 AS rewritten FROM benchmark")
def rewrite_citations(spark, sf):
    from ..functions.summaries import rewritten_citations

    i = F.col("item_id")
    said = F.concat(F.lit("see [Articles "), i % 5, F.lit("–"), i % 5 + 2, F.lit("; "), i % 7, F.lit("] and [doctor]"))
    return parquet(spark, sf, "benchmark").select("item_id", rewritten_citations(said).alias("r")).select("item_id", "r.text", "r.rewritten")


@query("SELECT conv_id, list_filter(list_transform(string_split(string_agg(text, chr(10) ORDER BY turn), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS bullets FROM conversations GROUP BY conv_id")
def summary_bullets(spark, sf):
    """A group's texts as one summary cell, and the cell as bullets."""
    from ..functions.summaries import summary_bullets as bullets

    cell = F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n"), F.lit("\n"))
    return parquet(spark, sf, "conversations").groupBy("conv_id").agg(cell.alias("cell")).select("conv_id", bullets("cell").alias("bullets"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'unlimited' ELSE '1' END AS renewals, p_size::DOUBLE AS length, 'months' AS unit, 30.0::DOUBLE AS notice, p_size AS term, 'years' AS term_unit FROM part WHERE p_size > 12")
def contract_terms(spark, sf):
    from ..functions import contracts as C

    size = F.col("p_size").cast("string")
    renewal = F.concat(F.when(F.col("p_partkey") % 3 == 0, "succesive ").otherwise(""), F.lit("some ("), size, F.lit(") month; perpetual"))
    term = F.array(F.concat(F.lit("This agreement has a term of "), size, F.lit(" years, unless ended by thirty (30) days prior notice.")))
    made = parquet(spark, sf, "part").filter("p_size > 12").select("p_partkey", C.parse_renewals(renewal)[0].alias("r"), C.parse_notice(F.lit("thirty (30) days"))[0].alias("n"), C.term_in_spans(term).alias("t"))
    return made.select("p_partkey", "r.renewals", "r.length", "r.unit", F.col("n.length").alias("notice"), F.col("t.length").alias("term"), F.col("t.unit").alias("term_unit"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN ['New York', 'Ontario'] WHEN n_nationkey % 4 = 1 THEN ['England', 'Wales'] WHEN n_nationkey % 4 = 2 THEN ['not a place'] ELSE ['redacted'] END AS places FROM nation")
def governing_law(spark, sf):
    from ..functions.contracts import parse_governing_law

    k = F.col("n_nationkey") % 4
    raw = F.when(k == 0, "State of New York; New York; Province of Ontario, Canada").when(k == 1, "England and Wales").when(k == 2, "where the breach occurs").otherwise("[ * ]")
    return parquet(spark, sf, "nation").select("n_nationkey", parse_governing_law(raw, ["New York"], ["Canada"], ["Ontario", "England", "Wales"]).alias("places"))


@query("SELECT n_nationkey, 2 AS number_parties, ['Acme Incorporated', n_name || ' Limited'] AS parties FROM nation")
def contract_parties(spark, sf):
    from ..functions.contracts import parse_parties

    raw = F.concat(F.lit('Acme Incorporatd ("Acme"); '), "n_name", F.lit(' Limited; together ("Parties")'))
    spans = F.array(F.concat(F.lit("between Acme Incorporated and "), "n_name", F.lit(" Limited")))
    return parquet(spark, sf, "nation").select("n_nationkey", parse_parties(raw, spans).alias("p")).select("n_nationkey", "p.number_parties", "p.parties")


@query("WITH c AS (SELECT lang, source, count(*)::DOUBLE AS n FROM documents GROUP BY ALL), a AS (SELECT sum(n * (n - 1) / 2) AS a, sum(n) AS n FROM c), b AS (SELECT sum(m * (m - 1) / 2) AS b FROM (SELECT sum(n) AS m FROM c GROUP BY lang)), d AS (SELECT sum(m * (m - 1) / 2) AS c FROM (SELECT sum(n) AS m FROM c GROUP BY source)) SELECT round((a - b * c / (n * (n - 1) / 2)) / ((b + c) / 2 - b * c / (n * (n - 1) / 2)), 6) AS ari FROM a, b, d")
def adjusted_rand(spark, sf):
    return E.adjusted_rand_index(parquet(spark, sf, "documents"), "lang", "source").select(F.round("ari", 6).alias("ari"))


@query("WITH r AS (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS x, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0 AS y FROM part) SELECT round(corr(x, y), 6) AS spearman FROM r")
def spearman(spark, sf):
    return E.spearman(parquet(spark, sf, "part"), "p_size", "p_retailprice").select(F.round("spearman", 6).alias("spearman"))


@query("WITH j AS (SELECT item_id, list_distinct([item_id % 3, item_id % 4, item_id % 5]) AS c, list_distinct([item_id % 2, item_id % 3]) AS r, CASE WHEN item_id % 3 = 0 THEN 1.0 WHEN item_id % 3 = 1 THEN 0.5 ELSE 0.0 END AS cov FROM benchmark) SELECT item_id, round(2.0 * len(list_intersect(c, r)) / (len(c) + len(r)), 6) AS citation_f1, round(cov * 2.0 * len(list_intersect(c, r)) / (len(c) + len(r)), 6) AS joint FROM j")
def citation_f1(spark, sf):
    i = F.col("item_id")
    judged = parquet(spark, sf, "benchmark").select("item_id", F.array_distinct(F.array(i % 3, i % 4, i % 5)).alias("c"), F.array_distinct(F.array(i % 2, i % 3)).alias("r"), F.when(i % 3 == 0, 1.0).when(i % 3 == 1, 0.5).otherwise(0.0).alias("cov"))
    return E.citation_scores(judged, "c", "r", "cov").select("item_id", F.round("citation_f1", 6).alias("citation_f1"), F.round("joint", 6).alias("joint"))


@query("SELECT p_partkey, round(1 / (1 + abs(p_retailprice - 1000) / 1000), 6) AS score FROM part")
def relative_error(spark, sf):
    return parquet(spark, sf, "part").select("p_partkey", F.round(E.relative_error_score(F.col("p_retailprice"), F.lit(1000.0)), 6).alias("score"))


@query("SELECT o_orderstatus AS plan, round(avg(o_totalprice), 4) AS q_avg, round(stddev_samp(o_totalprice), 4) AS q_std FROM orders GROUP BY 1")
def plan_agg_stats(spark, sf):
    runs = parquet(spark, sf, "orders").select(F.col("o_orderstatus").alias("plan"), F.col("o_totalprice").alias("q"))
    return metrics.repeated_runs(runs, "plan", ["q"]).select("plan", F.round("q_avg", 4).alias("q_avg"), F.round("q_std", 4).alias("q_std"))


@query("SELECT count(*) FILTER (WHERE p_partkey % 4 = 0 OR p_partkey % 5 = 0) AS n_unstable FROM part")
def unstable_records(spark, sf):
    part = parquet(spark, sf, "part").select("p_partkey", "p_brand")
    one = part.withColumn("run", F.lit(1))
    two = part.withColumn("run", F.lit(2)).filter("p_partkey % 4 <> 0").withColumn("p_brand", F.when(F.col("p_partkey") % 5 == 0, "other").otherwise(F.col("p_brand")))
    return metrics.unstable_records(one.unionByName(two), "run", "p_partkey", 2)


def _watched(spark, sf):
    """A plan of a mapping that fails on some rows, an exact filter and a model filter, and what its run recorded."""
    from ..operators.record import Record

    def parsed(row):
        import json

        k = json.loads(row["props"])["k"]
        if k % 5 == 0:
            raise ValueError(f"bad value {k % 3}")
        return {"k": k}

    rules = RuleProvider({"The value is even.": lambda c: c("k") % 2 == 0})
    plan = _plan(spark, sf, "events").project(["event_id", "props", "value"]).map(parsed, [{"name": "k", "type": "int"}]).filter("value > 50").sem_filter("The value is even.", depends_on=["k"])
    record = Record({"rules": metrics.Price(1.0, 2.0)})
    plan.lower(rules, record=record).write.format("noop").mode("overwrite").save()
    return record


_EVENTS = "WITH e AS (SELECT *, (props->>'$.k')::BIGINT AS k FROM events)"


@query(f"{_EVENTS} SELECT 'map' AS op_type, count(*) AS num_records, count(*) FILTER (k % 5 <> 0) AS num_passed, count(*) FILTER (k % 5 = 0) AS num_errors FROM e UNION ALL SELECT 'filter', count(*), count(*) FILTER (value > 50), 0 FROM e WHERE k % 5 <> 0 UNION ALL SELECT 'sem_filter', count(*), count(*) FILTER (k % 2 = 0), 0 FROM e WHERE k % 5 <> 0 AND value > 50")
def operator_stats(spark, sf):
    return _watched(spark, sf).stats(spark).select("op_type", "num_records", "num_passed", "num_errors")


@query(f"{_EVENTS}, c AS (SELECT 'ValueError: bad value ' || (k % 3)::VARCHAR AS message, count(*) AS n FROM e WHERE k % 5 = 0 GROUP BY ALL), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, message) AS rank FROM c) SELECT rank::INTEGER AS rank, n::VARCHAR || 'x ' || message AS error FROM r WHERE rank <= 3")
def op_error_top3(spark, sf):
    return _watched(spark, sf).errors(spark).select("rank", "error")


@query("SELECT event_type AS op_type, count(*) AS n, round(sum(value), 4) AS value_sum, round(avg(value), 4) AS value_mean FROM events GROUP BY 1")
def results_summary(spark, sf):
    return metrics.results_summary(parquet(spark, sf, "events").withColumnRenamed("event_type", "op_type"), "op_type", {"value": 4})


@query(f"SELECT hits AS value, count(*) AS n FROM (SELECT len(list_filter(['of the', 'license', 'and'], lambda p: contains(' ' || array_to_string({_WORDS_SQL.format('text')}, ' ') || ' ', ' ' || p || ' '))) AS hits FROM documents) GROUP BY hits")
def hits_histogram(spark, sf):
    scored = ranking.keyphrases(parquet(spark, sf, "documents"), ["text"], ["of the", "license", "and"])
    return ranking.histogram(scored.withColumn("hits", F.col("hits").cast("long")), "hits")


@query("SELECT 'o_totalprice' AS name, min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders UNION ALL SELECT 'o_custkey', min(o_custkey)::DOUBLE, max(o_custkey)::DOUBLE FROM orders")
def score_ranges(spark, sf):
    return ranking.ranges(parquet(spark, sf, "orders"), ["o_totalprice", "o_custkey"])


@query(f"SELECT p FROM (SELECT unnest(['of the', 'zzz qx', 'license', 'qqq']) AS p) WHERE NOT EXISTS (SELECT 1 FROM documents WHERE contains(' ' || array_to_string({_WORDS_SQL.format('text')}, ' ') || ' ', ' ' || p || ' '))")
def zero_hit_phrases(spark, sf):
    phrases = ["of the", "zzz qx", "license", "qqq"]
    unused = ranking.zero_hits(ranking.keyphrases(parquet(spark, sf, "documents"), ["text"], phrases), phrases)
    return spark.createDataFrame([(p,) for p in unused], "p string")


@query("SELECT conv_id, turn, (1.0 / count(*) OVER (PARTITION BY conv_id))::DOUBLE AS cost FROM conversations")
def spread_costs(spark, sf):
    return metrics.spread_over(parquet(spark, sf, "conversations").select("conv_id", "turn", F.lit(1.0).alias("cost")), ["conv_id"], ["cost"])


@query("SELECT o_orderkey, round(CASE WHEN floor(o_totalprice)::BIGINT > 272000 THEN floor(o_totalprice)::BIGINT * 0.2 + 500 * 0.75 ELSE floor(o_totalprice)::BIGINT * 0.1 + 500 * 0.5 END / 1e6, 9) AS cost FROM orders")
def token_cost(spark, sf):
    price = metrics.Price(0.1, 0.5, tier=272_000, long_read=0.2, long_write=0.75)
    tokens = F.floor("o_totalprice").cast("long")
    return parquet(spark, sf, "orders").select("o_orderkey", F.round(metrics.token_cost(price, tokens, F.lit(500)), 9).alias("cost"))


@query("SELECT event_type AS op_type, event_type AS op_id, round(sum(value), 4) AS cost_usd, count(*) AS num_records, count(*) FILTER (value > 50) AS num_passed FROM events GROUP BY event_type")
def summed_operator_stats(spark, sf):
    stats = parquet(spark, sf, "events").select(F.col("event_type").alias("op_id"), F.col("event_type").alias("op_type"), F.col("value").alias("cost_usd"), F.lit(0.0).alias("latency_s"), F.lit(1).alias("input_tokens"), F.lit(1).alias("output_tokens"), (F.col("value") > 50).alias("passed"))
    return metrics.operator_stats(stats).select("op_type", "op_id", F.round("cost_usd", 4).alias("cost_usd"), "num_records", "num_passed")


# extensions


@query("SELECT n_name AS name FROM nation UNION SELECT r_name FROM region")
def union_distinct(spark, sf):
    nation = _plan(spark, sf, "nation").map({"name": "n_name"}).project(["name"])
    return nation.union(_plan(spark, sf, "region").map({"name": "r_name"}).project(["name"])).distinct().lower()
