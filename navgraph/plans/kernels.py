"""Kernel queries over the driver tables: ``QUERIES`` (Spark) and ``ORACLES`` (SQL with the same columns)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from navgraph.functions.paths import folder_key, like_literal
from navgraph.operators import grading, graph, index, tables, temporal
from navgraph.shared import checkpointed


def _t(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1: how often each identifier-like token stands in the documents, and in how many."""
    tokens = index.token_index(_t(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")
    per_doc = tokens.groupBy("token", "doc_id").agg(F.count("*").alias("n"))
    return per_doc.groupBy("token").agg(F.sum("n").alias("n"), F.count("*").alias("n_docs"))


def usages_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1: the first 201 places of one token, in order."""
    return index.usages(index.token_index(_t(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text"), "with", "doc_id", 200)


def downsample_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First place of each token in each document."""
    return index.first_occurrences(index.token_index(_t(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text"), "doc_id")


def line_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions of one name, in order (parts stand for definitions, brands for classes)."""
    parts = _t(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand").where(F.col("p_name") == "small ring")
    return parts.orderBy("p_partkey").limit(201).select(F.col("p_name").alias("name"), F.col("p_brand").alias("cls"), F.col("p_partkey").alias("line"))


def callers_graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2: line items as call sites of every part's name: sites of the part itself are verified, sites of another part
    of that name are candidates; counted by target and level, without listing candidate pairs."""
    parts = _t(spark, sf_dir, "part", "p_partkey", "p_name")
    own = _t(spark, sf_dir, "lineitem", "l_partkey").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("own"))
    sited = parts.join(own, "p_partkey", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    by_name = sited.groupBy("p_name").agg(F.sum("own").alias("all"))
    both = sited.join(by_name, "p_name")
    grades = F.explode(F.array(F.struct(F.lit("VERIFIED").alias("level"), F.col("own").alias("n")), F.struct(F.lit("CANDIDATE").alias("level"), (F.col("all") - F.col("own")).alias("n"))))
    return both.select("p_partkey", "p_name", grades.alias("g")).select("p_partkey", "p_name", "g.level", "g.n").where("n > 0")


def callees_graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2: what each supplier's items lead to, noise types left out, distinct, graded by how far the part's type is known."""
    parts = _t(spark, sf_dir, "part", "p_partkey", "p_name", "p_type").where(~F.col("p_type").isin("ECONOMY"))
    items = _t(spark, sf_dir, "lineitem", "l_suppkey", "l_partkey").distinct()
    met = items.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    level = grading.cascade([(F.col("p_type") == "STANDARD", "VERIFIED"), (F.col("p_type") == "PROMO", "FRAMEWORK-INFERRED")], "CANDIDATE")
    return grading.count_levels(met.select("l_suppkey", level.alias("level")), ["l_suppkey"])


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "lineitem", F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))


def deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6: all distinct edges."""
    return _edges(spark, sf_dir).distinct()


def importers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6: distinct sources of edges into every target, with the hub flag of at least ten sources."""
    return graph.in_degree(_edges(spark, sf_dir), "src", "dst").select("dst", "n", (F.col("n") >= 10).alias("hub"))


def hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6: the 25 targets with most distinct sources."""
    return graph.hubs(_edges(spark, sf_dir), "src", "dst", 25)


def percentile_hub_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The degree at the compatible rule's place of the descending list beside the exact 95th percentile."""
    degrees = graph.in_degree(_edges(spark, sf_dir), "src", "dst")
    by_degree = degrees.groupBy("n").agg(F.count("*").alias("times"))
    # Few distinct degrees: the place is found in their running counts, no window holds all targets.
    total = by_degree.agg(F.sum("times").alias("total"))
    above = Window.orderBy(F.desc("n"))
    placed = by_degree.withColumn("upto", F.sum("times").over(above)).crossJoin(F.broadcast(total))
    place = F.greatest(F.floor(F.col("total") * 0.95) - 1, F.lit(0))
    compatible = placed.where(F.col("upto") > place).agg(F.max("n").alias("compatible"))
    exact = placed.where(F.col("upto") > F.floor(F.col("total") * 0.05)).agg(F.max("n").alias("p95"))
    return compatible.crossJoin(F.broadcast(exact)).select(F.greatest("compatible", F.lit(10)).alias("compatible"), F.greatest("p95", F.lit(10)).alias("p95"))


def external_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References that no page answers, by how often they stand (an anti-join, then counts)."""
    pages = _t(spark, sf_dir, "pages", "url", "html")
    links = pages.select(F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href")).groupBy("href").agg(F.count("*").alias("n"))
    known = pages.select(F.regexp_extract("url", "^[a-z]+://[^/]+([^?#]*)", 1).alias("href")).distinct()
    return links.join(known, "href", "left_anti").orderBy(F.desc("n"), "href").limit(40)


def _doc_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents", "source", "lang", "doc_id", "n_chars")
    return docs.select(F.concat_ws("/", "source", "lang", F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".py"))).alias("path"), "n_chars")


def tree_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8: files and bytes by folder, two parts deep."""
    return tables.roll_up(_doc_paths(spark, sf_dir), folder_key(F.col("path"), 1), "n_chars")


def find_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K12: paths that hold a text, case aside, shortest first."""
    pattern = "%" + like_literal("d1") + "%"
    paths = _doc_paths(spark, sf_dir).select("path").where(F.lower("path").like(pattern))
    return paths.orderBy(F.length("path"), "path").limit(51)


def class_rank_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3: for each customer the nearest supplier: same nation before same region before any, then the smallest key.

    Nearness depends on the nation alone, so suppliers are ranked once for each nation and customers look the best up.
    """
    nations = _t(spark, sf_dir, "nation", "n_nationkey", "n_regionkey")
    suppliers = _t(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey").join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    by_nation = suppliers.groupBy("n_nationkey", "n_regionkey").agg(F.min("s_suppkey").alias("s_suppkey"))
    home = nations.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("c_regionkey"))
    rank = F.when(F.col("c_nationkey") == F.col("n_nationkey"), 0).when(F.col("c_regionkey") == F.col("n_regionkey"), 1).otherwise(2)
    # nations x nations: 25 rows each by definition of the schema
    ranked = home.join(F.broadcast(by_nation)).select("c_nationkey", rank.alias("rank"), "s_suppkey")
    best = grading.best_rank(ranked, ["c_nationkey"], "rank", ["s_suppkey"])
    return _t(spark, sf_dir, "customer", "c_custkey", "c_nationkey").join(best, "c_nationkey").select("c_custkey", F.col("rank").cast("long").alias("rank"), "s_suppkey")


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region -> nation -> customer and supplier, as ``parent, node``."""
    regions = _t(spark, sf_dir, "region", F.lit("world").alias("parent"), F.concat(F.lit("r"), F.col("r_regionkey")).alias("node"))
    nations = _t(spark, sf_dir, "nation", F.concat(F.lit("r"), F.col("n_regionkey")).alias("parent"), F.concat(F.lit("n"), F.col("n_nationkey")).alias("node"))
    customers = _t(spark, sf_dir, "customer", F.concat(F.lit("n"), F.col("c_nationkey")).alias("parent"), F.concat(F.lit("c"), F.col("c_custkey")).alias("node"))
    suppliers = _t(spark, sf_dir, "supplier", F.concat(F.lit("n"), F.col("s_nationkey")).alias("parent"), F.concat(F.lit("s"), F.col("s_suppkey")).alias("node"))
    return regions.unionByName(nations).unionByName(customers).unionByName(suppliers)


def runtime_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4: all hosts above every node, itself included, by a closure upwards."""
    pairs = graph.reachable_pairs(_tree(spark, sf_dir).select(F.col("node").alias("src"), F.col("parent").alias("dst")))
    return pairs.select(F.col("origin").alias("node"), F.col("node").alias("host"))


def subclass_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4: everything below one region with its level."""
    found = graph.layers(_tree(spark, sf_dir), spark.range(1).select(F.lit("r1").alias("node")), "parent", "node")
    return found.select("node", F.col("layer").cast("long").alias("layer"))


def impact_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4: users reached from the first one over consecutive errors, by layer.

    Each event's follower is found by a window per hour with the next hour's first event as its end, so that no task
    orders all events.
    """
    errors = _t(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type").where("event_type = 'error'")
    hours = errors.withColumn("hour", F.date_trunc("hour", "ts"))
    inside = Window.partitionBy("hour").orderBy("ts", "event_id")
    heads = hours.groupBy("hour").agg(F.min(F.struct("ts", "event_id", "user_id")).alias("head"))
    ends = heads.select("hour", F.lead("head.user_id").over(Window.orderBy("hour")).alias("next_head"))
    follow = hours.withColumn("dst", F.lead("user_id").over(inside)).join(ends, "hour").select(F.col("user_id").alias("src"), F.coalesce("dst", "next_head").alias("dst"))
    edges = checkpointed(follow.where("dst IS NOT NULL AND src <> dst").distinct())
    found = graph.layers(edges, edges.agg(F.min("src").alias("node")), "src", "dst", max_depth=3)
    return found.select("node", F.col("layer").cast("long").alias("layer"))


def pubsub_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7: publishers and listeners by key: counts of both sides and of pairs, made from side counts."""
    events = _t(spark, sf_dir, "events", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    sides = events.groupBy("k").agg(F.count_if(F.col("event_type") == "click").alias("publish"), F.count_if(F.col("event_type") == "view").alias("listen"))
    return sides.where("publish > 0 AND listen > 0").select("k", "publish", "listen", (F.col("publish") * F.col("listen")).alias("pairs"))


def rpc_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7: each user turn with the assistant turn that answers it."""
    turns = _t(spark, sf_dir, "conversations", "conv_id", "turn", "role")
    asked = turns.where("role = 'user'").select("conv_id", F.col("turn").alias("ask"), (F.col("turn") + 1).alias("turn"))
    answered = turns.where("role = 'assistant'").select("conv_id", "turn")
    return asked.join(answered, ["conv_id", "turn"]).select("conv_id", "ask", F.col("turn").alias("answer"))


def asof_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5: for each error the latest purchase of that user at or before it."""
    events = _t(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type")
    errors = events.where("event_type = 'error'").select("user_id", "event_id", "ts")
    bought = events.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("purchase_id"))
    return temporal.as_of(errors, bought, ["user_id"], "ts", "at", ["purchase_id"], tie="purchase_id").select("event_id", "purchase_id")


def hunk_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K9: orders whose 30 days after the order date meet an item's 14 days before shipping, counted by order."""
    orders = _t(spark, sf_dir, "orders", F.col("o_orderkey").alias("key"), F.col("o_orderdate").alias("a"), F.expr("o_orderdate + INTERVAL 30 DAYS").alias("b"))
    items = _t(spark, sf_dir, "lineitem", F.col("l_orderkey").alias("key"), "l_linenumber", F.expr("l_shipdate - INTERVAL 14 DAYS").alias("start"), F.col("l_shipdate").alias("end"))
    met = temporal.overlaps(items, orders, ["key"], ("start", "end"), ("a", "b"))
    return met.groupBy("key").agg(F.count("*").alias("n"), F.min("l_linenumber").cast("long").alias("first_line"))


def drift_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K10: documents against labels by id: added, removed, or changed (marked of low quality)."""
    docs = _t(spark, sf_dir, "documents", "doc_id", F.lit(1).alias("state"))
    labels = _t(spark, sf_dir, "labels", "doc_id", F.col("quality").alias("state"))
    return tables.drift(labels, docs, "doc_id", ["state"])


def coverage_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K11: complete or partial by source, a toxic document standing for a file that failed to parse."""
    docs, labels = _t(spark, sf_dir, "documents", "doc_id", "source"), _t(spark, sf_dir, "labels", "doc_id", "toxic")
    return tables.coverage(docs.join(labels, "doc_id"), "source", F.col("toxic") == 0)


def tree_descend_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K13: for each region the customers below it that a skipping path of names reaches, graded by their number."""
    up = tree = _tree(spark, sf_dir)
    pairs = graph.reachable_pairs(up.select(F.col("node").alias("src"), F.col("parent").alias("dst")))
    closure = pairs.where("origin <> node").select(F.col("node").alias("anc"), F.col("origin").alias("node"))
    names = up.select("node", F.col("node").alias("name"))
    roots = tree.where("parent = 'world'").select(F.col("node").alias("root"), "node")
    hits = tables.descend(roots, closure, names, ["c10*"])
    return tables.grade_hits(roots.select("root"), hits, ["root"]).select("root", "n", "level")


def page_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page of the graded call sites of one level."""
    graded = callers_graded(spark, sf_dir).where("level = 'CANDIDATE'").select("p_partkey", "n")
    return tables.page(graded, ["p_partkey"], 40, 20)


QUERIES = {
    f.__name__: f
    for f in (
        token_index, usages_token, downsample_first, line_definitions, callers_graded, callees_graded, deps, importers, hubs,
        percentile_hub_flag, external_rank, tree_rollup, find_path, class_rank_pick, runtime_hosts, subclass_closure,
        impact_layers, pubsub_pairs, rpc_pairs, asof_assignment, hunk_overlap, drift_set, coverage_contract,
        tree_descend_grade, page_projection,
    )
}

_TOKENS = r"""
    WITH lines AS (
      SELECT doc_id, unnest(string_split(text, chr(10))) AS line_text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
    found AS (SELECT doc_id, line, regexp_extract_all(line_text, '[A-Za-z_][A-Za-z0-9_]*') AS tokens FROM lines),
    toks AS (SELECT doc_id, CAST(line AS BIGINT) AS line, CAST(generate_subscripts(tokens, 1) AS BIGINT) AS ord, unnest(tokens) AS token FROM found)"""
_TREE = """
    tree AS (
      SELECT 'world' AS parent, 'r' || r_regionkey AS node FROM region
      UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation
      UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer
      UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier)"""
_PATHS = "SELECT source || '/' || lang || '/d' || doc_id || '.py' AS path, n_chars FROM documents"
_GRADED = """
    WITH own AS (SELECT p_partkey, p_name, count(l_partkey) AS own FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY ALL),
    named AS (SELECT *, sum(own) OVER (PARTITION BY p_name) AS every FROM own),
    graded AS (
      SELECT p_partkey, p_name, 'VERIFIED' AS level, CAST(own AS BIGINT) AS n FROM named WHERE own > 0
      UNION ALL SELECT p_partkey, p_name, 'CANDIDATE', CAST(every - own AS BIGINT) FROM named WHERE every > own)"""

ORACLES: dict[str, str] = {
    "token_index": _TOKENS + " SELECT token, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM toks GROUP BY token",
    "usages_token": _TOKENS + " SELECT doc_id, line, ord, token FROM toks WHERE token = 'with' ORDER BY doc_id, line, ord LIMIT 201",
    "downsample_first": _TOKENS + """ SELECT doc_id, line, ord, token FROM (
        SELECT *, row_number() OVER (PARTITION BY doc_id, token ORDER BY line, ord) AS k FROM toks) WHERE k = 1""",
    "line_definitions": "SELECT p_name AS name, p_brand AS cls, p_partkey AS line FROM part WHERE p_name = 'small ring' ORDER BY p_partkey LIMIT 201",
    "callers_graded": _GRADED + " SELECT * FROM graded",
    "callees_graded": """
        SELECT l_suppkey, CASE p_type WHEN 'STANDARD' THEN 'VERIFIED' WHEN 'PROMO' THEN 'FRAMEWORK-INFERRED' ELSE 'CANDIDATE' END AS level, count(*) AS n
        FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) JOIN part ON p_partkey = l_partkey WHERE p_type <> 'ECONOMY' GROUP BY 1, 2""",
    "deps": "SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem",
    "importers": "SELECT l_partkey AS dst, count(DISTINCT l_suppkey) AS n, count(DISTINCT l_suppkey) >= 10 AS hub FROM lineitem GROUP BY 1",
    "hubs": "SELECT l_partkey AS dst, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, dst LIMIT 25",
    "percentile_hub_flag": """
        WITH d AS (SELECT count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_partkey),
        r AS (SELECT n, row_number() OVER (ORDER BY n DESC) - 1 AS k, count(*) OVER () AS total FROM d)
        SELECT greatest(max(CASE WHEN k = greatest(CAST(floor(total * 0.95) AS BIGINT) - 1, 0) THEN n END), 10) AS compatible,
               greatest(max(CASE WHEN k = CAST(floor(total * 0.05) AS BIGINT) THEN n END), 10) AS p95 FROM r""",
    "external_rank": """
        WITH links AS (SELECT unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages)
        SELECT href, count(*) AS n FROM links
        WHERE href NOT IN (SELECT regexp_extract(url, '^[a-z]+://[^/]+([^?#]*)', 1) FROM pages)
        GROUP BY 1 ORDER BY n DESC, href LIMIT 40""",
    "tree_rollup": f"""
        SELECT array_to_string(string_split(path, '/')[1:2], '/') AS folder, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS bytes FROM ({_PATHS}) GROUP BY 1""",
    "find_path": f"SELECT path FROM ({_PATHS}) WHERE path ILIKE '%d1%' ORDER BY length(path), path LIMIT 51",
    "class_rank_pick": """
        SELECT c_custkey, rank, s_suppkey FROM (
          SELECT c_custkey, CAST(CASE WHEN c_nationkey = s_nationkey THEN 0 WHEN a.n_regionkey = b.n_regionkey THEN 1 ELSE 2 END AS BIGINT) AS rank, s_suppkey,
                 row_number() OVER (PARTITION BY c_custkey ORDER BY CASE WHEN c_nationkey = s_nationkey THEN 0 WHEN a.n_regionkey = b.n_regionkey THEN 1 ELSE 2 END, s_suppkey) AS k
          FROM customer JOIN nation a ON a.n_nationkey = c_nationkey, supplier JOIN nation b ON b.n_nationkey = s_nationkey) WHERE k = 1""",
    "runtime_hosts": f"""
        WITH RECURSIVE {_TREE}, up(node, host) AS (
          SELECT node, node FROM tree UNION SELECT 'world', 'world' UNION SELECT up.node, tree.parent FROM up JOIN tree ON tree.node = up.host)
        SELECT node, host FROM up""",
    "subclass_closure": f"""
        WITH RECURSIVE {_TREE}, down(node, layer) AS (
          SELECT 'r1', CAST(0 AS BIGINT) UNION SELECT tree.node, layer + 1 FROM down JOIN tree ON tree.parent = down.node)
        SELECT node, min(layer) AS layer FROM down GROUP BY node""",
    "impact_layers": """
        WITH RECURSIVE follow AS (
          SELECT user_id AS src, lead(user_id) OVER (ORDER BY ts, event_id) AS dst FROM events WHERE event_type = 'error'),
        edges AS (SELECT DISTINCT src, dst FROM follow WHERE dst IS NOT NULL AND src <> dst),
        reach(node, layer) AS (
          SELECT (SELECT min(src) FROM edges), CAST(0 AS BIGINT)
          UNION SELECT dst, layer + 1 FROM reach JOIN edges ON src = node WHERE layer < 3)
        SELECT node, min(layer) AS layer FROM reach GROUP BY node""",
    "pubsub_pairs": """
        SELECT k, publish, listen, publish * listen AS pairs FROM (
          SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) FILTER (event_type = 'click') AS publish,
                 count(*) FILTER (event_type = 'view') AS listen FROM events GROUP BY 1) WHERE publish > 0 AND listen > 0""",
    "rpc_pairs": """
        SELECT a.conv_id, a.turn AS ask, b.turn AS answer FROM conversations a JOIN conversations b
          ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'""",
    "asof_assignment": """
        SELECT e.event_id, arg_max(p.event_id, (p.ts, p.event_id)) AS purchase_id
        FROM events e LEFT JOIN events p ON p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts <= e.ts
        WHERE e.event_type = 'error' GROUP BY e.event_id""",
    "hunk_overlap": """
        SELECT l_orderkey AS key, count(*) AS n, CAST(min(l_linenumber) AS BIGINT) AS first_line FROM lineitem JOIN orders ON o_orderkey = l_orderkey
          AND l_shipdate - INTERVAL 14 DAY <= o_orderdate + INTERVAL 30 DAY AND l_shipdate >= o_orderdate GROUP BY 1""",
    "drift_set": """
        SELECT coalesce(l.doc_id, d.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'added' WHEN d.doc_id IS NULL THEN 'removed' ELSE 'changed' END AS change
        FROM labels l FULL OUTER JOIN documents d ON l.doc_id = d.doc_id
        WHERE l.doc_id IS NULL OR d.doc_id IS NULL OR l.quality IS DISTINCT FROM 1""",
    "coverage_contract": """
        SELECT source, count(*) AS n, count(*) FILTER (toxic <> 0) AS failed,
               CASE WHEN count(*) FILTER (toxic <> 0) = 0 THEN 'complete' ELSE 'partial' END AS coverage
        FROM documents JOIN labels USING (doc_id) GROUP BY source""",
    "tree_descend_grade": """
        WITH hits AS (SELECT 'r' || n_regionkey AS root, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey
                      WHERE CAST(c_custkey AS VARCHAR) LIKE '10%' GROUP BY 1)
        SELECT 'r' || r_regionkey AS root, coalesce(n, 0) AS n, CASE WHEN n = 1 THEN 'EXACT' WHEN n > 1 THEN 'MULTI' ELSE 'MISS' END AS level
        FROM region LEFT JOIN hits ON root = 'r' || r_regionkey""",
    "page_projection": _GRADED + """, c AS (SELECT p_partkey, n FROM graded WHERE level = 'CANDIDATE')
        SELECT p_partkey, n, (SELECT count(*) FROM c) AS total, (SELECT count(*) FROM c) > 60 AS has_more,
               CASE WHEN (SELECT count(*) FROM c) > 60 THEN CAST(60 AS BIGINT) END AS next_offset
        FROM c ORDER BY p_partkey LIMIT 20 OFFSET 40""",
}
