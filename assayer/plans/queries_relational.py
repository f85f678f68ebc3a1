"""Relational detectors over the driver's tables: history, graphs, versions, contracts, sets.

Thresholds are parameters; these tables span a month where the published defaults expect years, hence the smaller ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayer.functions import versions
from assayer.operators import detectors, graph, history, lines
from assayer.operators.common import table
from assayer.plans.registry import query

# History: events as commits; the user is the author, user and property make a path.


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    path = F.concat(F.lit("f"), F.pmod("user_id", F.lit(75)).cast("string"), F.lit("_"), F.pmod(k, F.lit(20)).cast("string"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("commit"), F.col("user_id").alias("author"), "ts", path.alias("path"), "value", "event_type")


_HISTORY = "h AS (SELECT event_id c, user_id author, ts, 'f' || (user_id % 75) || '_' || ((props->>'$.k')::INT % 20) path, value FROM events)"
_DAYS = "(epoch_us({}) - epoch_us({})) / 86400000000.0"


@query(
    "churn_hotspots",
    f"""WITH {_HISTORY}, cx AS (SELECT path, max(value) complexity FROM h GROUP BY 1), r AS (SELECT * FROM h WHERE ts >= (SELECT max(ts) FROM h) - INTERVAL 7 DAY),
    c AS (SELECT path, count(*) churn FROM r GROUP BY 1)
    SELECT path, churn, complexity FROM c JOIN cx USING (path) WHERE (churn >= 4 AND complexity >= 10 AND churn >= 0.001 * (SELECT count(*) FROM r)) OR (churn >= 6 AND complexity >= 15)""",
)
def _(spark, sf_dir):
    h = changes(spark, sf_dir)
    return history.hotspots(h, h.groupBy("path").agg(F.max("value").alias("complexity")), window_days=7, share=0.001)


@query(
    "knowledge_concentration",
    f"""WITH {_HISTORY}, o AS (SELECT path, count(*) touches, count(DISTINCT author) authors, min(ts) a, max(ts) b, min(author) owner FROM h GROUP BY 1), act AS (SELECT author, max(ts) active FROM h GROUP BY 1)
    SELECT path, owner, touches FROM o JOIN act ON owner = author WHERE authors = 1 AND touches >= 4 AND {_DAYS.format("b", "a")} >= 10 AND {_DAYS.format("(SELECT max(ts) FROM h)", "active")} <= 5""",
)
def _(spark, sf_dir):
    return history.concentration(changes(spark, sf_dir), span_days=10, active_days=5)


@query(
    "knowledge_freshness",
    f"""WITH {_HISTORY}, act AS (SELECT author, max(ts) active FROM h GROUP BY 1), p AS (SELECT path, max(ts) last, max(active) active FROM h JOIN act USING (author) GROUP BY 1)
    SELECT path, last FROM p WHERE {_DAYS.format("(SELECT max(ts) FROM h)", "last")} > greatest(10.0, {_DAYS.format("(SELECT max(ts) FROM h)", "(SELECT min(ts) FROM h)")} / 4)
      AND {_DAYS.format("(SELECT max(ts) FROM h)", "active")} > 0.3""",
)
def _(spark, sf_dir):
    h = changes(spark, sf_dir)
    # half of the history is longer than any gap here, so a quarter stands in: the rule's own parameter is the larger limit
    return history.stale(h, stale_days=10, active_days=0.3, history_share=0.25)


@query("ownership", f"WITH {_HISTORY}, p AS (SELECT path, author, count(*) n, min(ts) a, max(ts) b FROM h GROUP BY 1, 2) SELECT path, sum(n)::BIGINT touches, count(*) authors, min(a) AS first, max(b) AS last, arg_min(author, (-n, author)) AS owner FROM p GROUP BY 1")
def _(spark, sf_dir):
    return history.ownership(changes(spark, sf_dir))


@query(
    "change_coupling",
    """WITH e AS (SELECT DISTINCT l_orderkey c, l_partkey p FROM lineitem), s AS (SELECT * FROM e WHERE c IN (SELECT c FROM e GROUP BY 1 HAVING count(*) <= 12)), n AS (SELECT p, count(*) n FROM s GROUP BY 1)
    SELECT x.p a, y.p b, count(*) support, round(count(*) / least(any_value(na.n), any_value(nb.n)), 6) confidence FROM s x JOIN s y ON x.c = y.c AND x.p < y.p JOIN n na ON na.p = x.p JOIN n nb ON nb.p = y.p
    GROUP BY 1, 2 HAVING count(*) >= 2 AND count(*) / least(any_value(na.n), any_value(nb.n)) >= 0.05""",
)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("path"))
    return history.change_coupling(rows, support=2, confidence=0.05).withColumn("confidence", F.round("confidence", 6))


# Graphs: a supplier's nation depends on the customers' nations that take most of its deliveries, so the graph has as many edges at every scale.


def trade(spark: SparkSession, sf_dir: str, partners: int = 3) -> DataFrame:
    t = {n: table(spark, sf_dir, n) for n in ("lineitem", "orders", "customer", "supplier")}
    rows = t["lineitem"].select("l_orderkey", "l_suppkey").join(t["orders"].select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(t["customer"].select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(t["supplier"].select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    n = rows.groupBy(F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst")).agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("n"), "dst"))
    return n.withColumn("rank", rank).where(F.col("rank") <= partners).select("src", "dst")


_TRADE = """t AS (SELECT s_nationkey src, c_nationkey dst, count(*) n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
e0 AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) r FROM t), e AS (SELECT DISTINCT src, dst FROM e0 WHERE r <= {partners} AND src <> dst)"""
_DEG = "deg AS (SELECT n_nationkey node, (SELECT count(*) FROM e WHERE dst = n_nationkey) ca, (SELECT count(*) FROM e WHERE src = n_nationkey) ce FROM nation), m AS (SELECT node, ca, ce, CASE WHEN ca + ce = 0 THEN 1.0 ELSE ce / (ca + ce) END i FROM deg)"


def _nations(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"))


@query("fan_in_out_instability", f"WITH {_TRADE.format(partners=3)}, {_DEG} SELECT node, ca, ce, round(i, 6) instability FROM m")
def _(spark, sf_dir):
    return graph.instability(trade(spark, sf_dir), _nations(spark, sf_dir)).withColumn("instability", F.round("instability", 6))


@query(
    "unstable_dependency",
    f"WITH {_TRADE.format(partners=3)}, {_DEG}, x AS (SELECT m.*, n_regionkey / 8.0 a FROM m JOIN nation ON node = n_nationkey) SELECT src, dst FROM e JOIN x s ON s.node = src JOIN x d ON d.node = dst WHERE d.i > s.i + 0.3 AND d.a < 0.5 AND s.ca >= 1",
)
def _(spark, sf_dir):
    edges = trade(spark, sf_dir)
    abstract = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"), (F.col("n_regionkey") / 8.0).alias("abstractness"))
    return graph.unstable_dependencies(edges, graph.instability(edges, _nations(spark, sf_dir)).join(abstract, "node")).select("src", "dst")


@query("off_main_sequence", f"WITH {_TRADE.format(partners=3)}, {_DEG} SELECT node, round(abs(n_regionkey / 8.0 + i - 1), 6) distance FROM m JOIN nation ON node = n_nationkey")
def _(spark, sf_dir):
    abstract = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"), (F.col("n_regionkey") / 8.0).alias("abstractness"))
    return graph.main_sequence(graph.instability(trade(spark, sf_dir), _nations(spark, sf_dir)).join(abstract, "node")).select("node", F.round("distance", 6).alias("distance"))


_CLOSURE = "RECURSIVE {t}, cl(src, dst) AS (SELECT src, dst FROM e UNION SELECT cl.src, e.dst FROM cl JOIN e ON cl.dst = e.src)"


@query("transitive_closure", f"WITH {_CLOSURE.format(t=_TRADE.format(partners=2))} SELECT src, dst FROM cl")
def _(spark, sf_dir):
    return graph.closure(graph.clean(trade(spark, sf_dir, 2)))


@query(
    "scc_components",
    f"WITH {_CLOSURE.format(t=_TRADE.format(partners=2))}, s AS (SELECT a.src node, least(a.src, min(a.dst)) component FROM cl a JOIN cl b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src), z AS (SELECT component, count(*) size FROM s GROUP BY 1 HAVING count(*) > 1) SELECT node, component, size FROM s JOIN z USING (component)",
)
def _(spark, sf_dir):
    return graph.strong_components(trade(spark, sf_dir, 2))


@query(
    "test_reachability",
    f"WITH RECURSIVE {_TRADE.format(partners=2)}, r(node, hops) AS (SELECT n_nationkey, 0 FROM nation WHERE n_regionkey = 0 UNION SELECT e.dst, r.hops + 1 FROM r JOIN e ON r.node = e.src WHERE r.hops < 30) SELECT node, min(hops)::INT hops FROM r GROUP BY 1",
)
def _(spark, sf_dir):
    start = table(spark, sf_dir, "nation").where("n_regionkey = 0").select(F.col("n_nationkey").alias("node"))
    return graph.reachable(graph.clean(trade(spark, sf_dir, 2)), start)


@query("namespace_two_cycles", f"WITH {_TRADE.format(partners=3)} SELECT x.src a, x.dst b FROM e x JOIN e y ON x.src = y.dst AND x.dst = y.src WHERE x.src < x.dst")
def _(spark, sf_dir):
    return graph.two_cycles(trade(spark, sf_dir))


@query(
    "lcom4_components",
    """WITH RECURSIVE u AS (SELECT DISTINCT p_brand || '/' || p_type cls, l_suppkey f, l_partkey m FROM lineitem JOIN part ON l_partkey = p_partkey),
    x AS (SELECT cls, f, min(m) hub FROM u GROUP BY 1, 2), e AS (SELECT u.m a, hub b, u.cls FROM u JOIN x USING (cls, f) UNION SELECT hub, u.m, u.cls FROM u JOIN x USING (cls, f)),
    r(cls, m, root) AS (SELECT cls, m, m FROM u UNION SELECT r.cls, e.b, r.root FROM r JOIN e ON e.a = r.m AND e.cls = r.cls WHERE r.root < e.b),
    lab AS (SELECT cls, m, min(root) root FROM r GROUP BY 1, 2) SELECT cls, count(DISTINCT m) methods, count(DISTINCT root) components FROM lab GROUP BY 1""",
)
def _(spark, sf_dir):
    # brands and types as classes, parts as methods, suppliers as the fields that methods use
    uses = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return detectors.cohesion(uses.select(F.concat_ws("/", "p_brand", "p_type").alias("cls"), F.col("l_partkey").alias("method"), F.col("l_suppkey").alias("field")))


# Versions and dates


def advisories(spark: SparkSession) -> DataFrame:
    rows = [("a1", "Brand#1", "5.0.0", "20.0.0", None, "HIGH", False), ("a2", "Brand#2", None, "10.0.0", None, "LOW", False), ("a3", "Brand#3", "30.0.0", None, "40.0.0", "CRITICAL", False), ("MAL-1", "Brand#4", "45.0.0", None, None, None, False), ("a4", "Brand#1", "1.0.0", None, None, "MODERATE", True)]
    return spark.createDataFrame(rows, "advisory string, package string, introduced string, fixed string, last_affected string, severity string, withdrawn boolean")


@query(
    "advisory_interval_match",
    """WITH a(advisory, package, lo, hi, last, w) AS (VALUES ('a1', 'Brand#1', 5, 20, NULL, 2.0), ('a2', 'Brand#2', NULL, 10, NULL, 0.5), ('a3', 'Brand#3', 30, NULL, 40, 3.0), ('MAL-1', 'Brand#4', 45, NULL, NULL, 3.0))
    SELECT p_partkey, advisory, (w * CASE WHEN p_partkey <= 100 THEN 1 ELSE 0.75 END)::DOUBLE weight FROM part JOIN a ON p_brand LIKE package || '%' AND lower(substr(p_brand, 1, 7)) = lower(package)
    WHERE (lo IS NULL OR p_size >= lo) AND (hi IS NULL OR p_size < hi) AND (last IS NULL OR p_size <= last)""",
)
def _(spark, sf_dir):
    packages = table(spark, sf_dir, "part").select("p_partkey", F.substring("p_brand", 1, 7).alias("package"), F.concat(F.col("p_size").cast("string"), F.lit(".0.0")).alias("version"), (F.col("p_partkey") <= 100).alias("direct"))
    return detectors.vulnerable(packages, advisories(spark)).select("p_partkey", "advisory", "weight")


@query("version_order", "SELECT v, row_number() OVER (ORDER BY k)::INT pos FROM (VALUES ('1.0.0-alpha', 1), ('1.0.0-alpha.1', 2), ('1.0.0-alpha.beta', 3), ('1.0.0-beta.2', 4), ('1.0.0-beta.11', 5), ('1.0.0-RC.1', 6), ('v1.0.0', 7), ('1.0.0.1', 8), ('1.2', 9), ('1.10.0+build.5', 10), ('2.0.0-0', 11), ('2', 12)) t(v, k)")
def _(spark, sf_dir):
    texts = ["1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-RC.1", "v1.0.0", "1.0.0.1", "1.2", "1.10.0+build.5", "2.0.0-0", "2", "not-a-version"]
    rows = spark.createDataFrame([(x,) for x in texts], "v string").withColumn("k", versions.version_key(F.col("v"))).where("k is not null")
    return rows.select("v", F.row_number().over(Window.orderBy("k")).alias("pos"))


_CYCLES = [("1-URGENT", "1995-06-30"), ("2-HIGH", "1996-12-31"), ("3-MEDIUM", None), ("5-LOW", "1998-01-01")]


@query(
    "eol_as_of",
    "WITH c(cycle, eol) AS (VALUES ('1-URGENT', DATE '1995-06-30'), ('2-HIGH', DATE '1996-12-31'), ('3-MEDIUM', NULL), ('5-LOW', DATE '1998-01-01')) SELECT o_orderpriority, o_orderstatus, count(*) n FROM orders JOIN c ON o_orderpriority = cycle WHERE eol <= o_orderdate::DATE GROUP BY 1, 2",
)
def _(spark, sf_dir):
    cycles = spark.createDataFrame(_CYCLES, "cycle string, eol string").withColumn("eol", F.to_date("eol"))
    found = detectors.end_of_life(table(spark, sf_dir, "orders"), cycles, F.col("o_orderpriority"), F.to_date("o_orderdate"))
    return found.groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


# Contracts, layers, membership


@query(
    "layer_violations",
    f"WITH {_TRADE.format(partners=3)} SELECT src, dst FROM e JOIN nation a ON a.n_nationkey = src JOIN nation b ON b.n_nationkey = dst WHERE a.n_regionkey < b.n_regionkey AND a.n_regionkey <> 4",
)
def _(spark, sf_dir):
    ranks = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("rank"), (F.col("n_regionkey") == 4).alias("exempt"))
    return detectors.layer_violations(graph.clean(trade(spark, sf_dir)), ranks).select("src", "dst")


@query(
    "captive_dependency",
    "SELECT DISTINCT l_suppkey service, l_partkey dependency FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey WHERE s_nationkey < 3 AND p_size < 5",
)
def _(spark, sf_dir):
    # suppliers as singletons, small parts as scoped services, line items as constructor parameters
    registered = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("service"), F.when(F.col("s_nationkey") < 3, "Singleton").otherwise("Transient").alias("lifetime"))
    scoped = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("service"), F.when(F.col("p_size") < 5, "Scoped").otherwise("Singleton").alias("lifetime"))
    takes = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("service"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dependency"))
    found = detectors.captive_dependencies(registered.unionByName(scoped), takes)
    return found.select(F.col("service").cast("bigint").alias("service"), F.substring("dependency", 2, 20).cast("bigint").alias("dependency"))


@query("contract_anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')")
def _(spark, sf_dir):
    calls = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").alias("name"))
    return detectors.undefined(calls, table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' and o_orderstatus = 'F'").select(F.col("o_custkey").alias("name"))).select("c_custkey")


@query("multi_handler", "SELECT l_partkey command, count(DISTINCT l_suppkey) handlers FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1")
def _(spark, sf_dir):
    return detectors.many_handlers(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("command"), F.col("l_suppkey").alias("handler")))


@query("raised_not_handled", "SELECT DISTINCT user_id, strftime(ts, '%Y-%m-%d') AS day, event_type FROM events e WHERE event_type <> 'purchase' AND NOT EXISTS (SELECT 1 FROM events h WHERE h.event_type = 'purchase' AND h.user_id = e.user_id AND h.ts::DATE = e.ts::DATE)")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    raised, handled = e.where("event_type <> 'purchase'").select("user_id", "day", "event_type").distinct(), e.where("event_type = 'purchase'")
    return raised.join(handled.select("user_id", "day").distinct(), ["user_id", "day"], "left_anti")


@query(
    "longest_prefix_owner",
    "WITH p(project, dir) AS (VALUES ('all', 'http'), ('plain', 'http://'), ('tls', 'https://'), ('mobile', 'https://m.'), ('com', 'https://t'), ('deep', 'http://th')) SELECT page_id, arg_max(project, length(dir)) project FROM pages JOIN p ON starts_with(url, dir) GROUP BY 1",
)
def _(spark, sf_dir):
    owners = spark.createDataFrame([("all", "http"), ("plain", "http://"), ("tls", "https://"), ("mobile", "https://m."), ("com", "https://t"), ("deep", "http://th")], "project string, dir string")
    return detectors.longest_prefix(table(spark, sf_dir, "pages").select("page_id", "url"), owners, "url", ["page_id"])


@query(
    "set_ops_events",
    """WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'click'), b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase')
    SELECT 'union' op, count(*) n FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'intersect', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'except', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'concat', (SELECT count(*) FROM a) + (SELECT count(*) FROM b)""",
)
def _(spark, sf_dir):
    users = lambda kind: table(spark, sf_dir, "events").where(F.col("event_type") == kind).select("user_id").distinct()
    a, b = users("click"), users("purchase")
    ops = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "except": a.exceptAll(b), "concat": a.union(b)}
    parts = [d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("op"), "n") for k, d in ops.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(
    "past_tense_names",
    "WITH w AS (SELECT p_partkey, p_name, unnest(list_distinct(regexp_split_to_array(lower(p_name), '[^a-z]+'))) word FROM part) SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM w WHERE word LIKE '%ed' OR word IN ('sent', 'paid', 'made', 'lost', 'sold'))",
)
def _(spark, sf_dir):
    return detectors.not_past_tense(table(spark, sf_dir, "part").select("p_partkey", "p_name"), F.split(F.lower("p_name"), "[^a-z]+"))


@query("ordered_turns", "SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) role_before, coalesce(turn - lag(turn) OVER (PARTITION BY conv_id ORDER BY turn), 0) step FROM conversations")
def _(spark, sf_dir):
    before, turn = lines.previous(F.col("role"), "conv_id", "turn"), lines.previous(F.col("turn"), "conv_id", "turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", before.alias("role_before"), F.coalesce(F.col("turn") - turn, F.lit(0)).alias("step"))


@query("rule_histogram", "SELECT lang, quality, toxic, count(*) n FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2, 3")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id").groupBy("lang", "quality", "toxic").agg(F.count(F.lit(1)).alias("n"))


@query(
    "benchmark_rollup",
    "SELECT coalesce(lang, 'all units') unit, count(*) plants, sum(quality)::BIGINT found, round(100.0 * sum(quality) / count(*), 2) recall, round(100.0 * (1 - avg(toxic)), 2) resistance FROM labels JOIN documents USING (doc_id) GROUP BY ROLLUP (lang)",
)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("unit")).join(table(spark, sf_dir, "labels"), "doc_id")
    return detectors.benchmark_rollup(rows, found=F.col("quality"), noise=F.col("toxic"))


@query(
    "embedding_nearest",
    """WITH q AS (SELECT vec_id q, embedding e FROM embeddings WHERE vec_id % 50 = 0), d AS (SELECT q, v.vec_id, list_cosine_similarity(q.e::DOUBLE[], v.embedding::DOUBLE[]) s FROM q, embeddings v WHERE q <> v.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(s, 9) DESC, vec_id) r FROM d) SELECT q, vec_id, r::INT "rank", round(s, 6) similarity FROM r WHERE r <= 5""",
)
def _(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return detectors.nearest(v, v.where("vec_id % 50 = 0"), k=5)
