"""Queries over relations: joins, rules, closures, intervals, sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import models, neighbours, relational
from quern.operators.graph import transitive_closure
from quern.plans.registry import query, table


@query(
    "sibling_relation",
    """WITH o AS (SELECT DISTINCT o_custkey, o_orderkey FROM orders)
    SELECT a.o_custkey AS custkey, a.o_orderkey AS orderkey, b.o_orderkey AS sibling FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey""",
)
def sibling_relation(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("orderkey"))
    return relational.siblings(o, "custkey", "orderkey")


@query(
    "selector_overlap_match",
    """WITH p AS (SELECT l_suppkey AS s, list(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1),
    n AS (SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey)
    SELECT 's' || n.a AS target, 's' || n.b AS related, array_to_string(list_sort(list_intersect(x.parts, y.parts)), ',') AS shared FROM n JOIN p x ON x.s = n.a JOIN p y ON y.s = n.b WHERE len(list_intersect(x.parts, y.parts)) > 0""",
)
def selector_overlap_match(spark, sf_dir):
    """Suppliers of one nation that sell the same parts, as related contracts that share selectors."""
    sold = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), "l_partkey")
    out = relational.group_matches(sold.join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), "s_suppkey"), "s_nationkey", "s_suppkey", "l_partkey")
    name = lambda c: F.concat(F.lit("s"), F.col(c).cast("string"))
    return out.select(name("s_suppkey").alias("target"), name("other").alias("related"), F.array_join("shared", ",").alias("shared"))


@query(
    "listed_selector_match",
    """WITH p AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS part FROM lineitem), r AS (SELECT s_suppkey AS t, s_suppkey + k AS o FROM supplier, (SELECT unnest([1, 2, 3]) AS k))
    SELECT 's' || t AS target, 's' || o AS related, array_to_string(list(x.part ORDER BY x.part), ',') AS shared FROM r JOIN p x ON x.s = r.t JOIN p y ON y.s = r.o AND y.part = x.part GROUP BY t, o""",
)
def listed_selector_match(spark, sf_dir):
    """Suppliers with the three that follow them, as related contracts in a list, and the parts they share."""
    name = lambda c: F.concat(F.lit("S"), c.cast("string"))
    sold = table(spark, sf_dir, "lineitem").select(name(F.col("l_suppkey")).alias("address"), F.col("l_partkey").alias("selector"))
    near = table(spark, sf_dir, "supplier").select(name(F.col("s_suppkey")).alias("target"), F.array(*[name(F.col("s_suppkey") + k) for k in (1, 2, 3)]).alias("related"))
    return relational.selector_matches(near, sold).select("target", "related", F.array_join("shared", ",").alias("shared"))


@query("sibling_counts", "SELECT o_custkey AS custkey, o_orderkey AS orderkey, count(*) OVER (PARTITION BY o_custkey) - 1 AS n_siblings FROM (SELECT DISTINCT o_custkey, o_orderkey FROM orders)")
def sibling_counts(spark, sf_dir):
    """Orders with how many others their customer has."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("orderkey"))
    return relational.sibling_groups(o, "custkey", "orderkey")


@query(
    "designator_resolution",
    """WITH c AS (SELECT CASE WHEN c_custkey % 5 = 0 THEN 'a' ELSE 'b' END AS chain, c_nationkey || '-' || c_custkey % 40 AS address, CASE WHEN c_custkey % 4 = 0 THEN 'ef' ELSE substr(sha256(c_name), 1, 1) END AS code, c_custkey % 4 = 0 AS is_designator FROM customer),
    r AS (SELECT chain, address, CASE WHEN count(DISTINCT code) = 1 THEN min(code) END AS runtime FROM c WHERE NOT is_designator AND code <> '' GROUP BY 1, 2)
    SELECT c.chain, c.address, coalesce(r.runtime, 'unresolved') AS runtime, count(*) AS n FROM c LEFT JOIN r ON r.chain = c.chain AND r.address = c.address WHERE is_designator GROUP BY 1, 2, 3""",
)
def designator_resolution(spark, sf_dir):
    """Runtime code of designators: the one code of the same chain and address, else unresolved."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(
        F.when(k % 5 == 0, "a").otherwise("b").alias("chain"),
        F.concat(F.col("c_nationkey").cast("string"), F.lit("-"), (k % 40).cast("string")).alias("address"),
        F.when(k % 4 == 0, "ef").otherwise(F.substring(F.sha2("c_name", 256), 1, 1)).alias("code"),
        (k % 4 == 0).alias("is_designator"),
    )
    out = relational.resolve_designators(c)
    return out.groupBy("chain", "address", F.coalesce("runtime", F.lit("unresolved")).alias("runtime")).agg(F.count("*").alias("n"))


@query(
    "call_rules",
    """WITH RECURSIVE f AS (SELECT DISTINCT p_size AS func FROM part), pub AS (SELECT DISTINCT p_size AS func, 'sel' || p_size AS sel FROM part WHERE p_size % 3 = 0),
    e AS (SELECT func AS src, (func * 5 + 1) % 50 + 1 AS dst FROM f), c AS (SELECT src, dst FROM e UNION SELECT c.src, e.dst FROM c JOIN e ON c.dst = e.src),
    reach AS (SELECT src, dst FROM c UNION SELECT func, func FROM pub),
    calls AS (SELECT p_partkey AS stmt, p_size AS func, CASE WHEN p_partkey % 2 = 0 THEN 'sig' || p_partkey % 6 ELSE 'UnkownCall' END AS sig FROM part WHERE p_partkey % 4 IN (0, 1))
    SELECT pub.func, pub.sel, count(stmt) AS n_calls, coalesce(array_to_string(list_sort(list(DISTINCT sig) FILTER (WHERE sig IS NOT NULL)), ','), '') AS targets FROM pub JOIN reach ON reach.src = pub.func LEFT JOIN calls ON calls.func = reach.dst GROUP BY 1, 2""",
)
def call_rules(spark, sf_dir):
    """Public functions and the external calls that they reach; facts are derived from parts."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    size, key = F.col("p_size"), F.col("p_partkey")
    func = p.select(size.alias("func")).distinct()
    facts = {
        "public": func.where("func % 3 = 0").select("func", F.concat(F.lit("sel"), F.col("func").cast("string")).alias("sel")),
        "in_function": func.select(F.col("func").alias("block"), "func"),
        "call_edge": func.select(F.col("func").alias("block"), ((F.col("func") * 5 + 1) % 50 + 1).alias("func")),
        "opcode": p.select(key.alias("stmt"), F.when(key % 4 == 0, "CALL").when(key % 4 == 1, "STATICCALL").otherwise("ADD").alias("op")),
        "statement": p.select(key.alias("stmt"), size.alias("func")),
        "target": p.where(key % 2 == 0).select(key.alias("stmt"), F.concat(F.lit("sig"), (key % 6).cast("string")).alias("sig")),
    }
    out = relational.call_rules(facts)
    return out.select("func", "sel", "n_calls", F.array_join("targets", ",").alias("targets"))


@query("attached_threshold", "SELECT o_orderkey, c_acctbal AS threshold, o_totalprice >= c_acctbal AS above FROM orders JOIN customer ON o_custkey = c_custkey")
def attached_threshold(spark, sf_dir):
    """Each order with its customer's balance as a threshold; an order without one would fail."""
    t = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_acctbal").alias("threshold"))
    out = relational.attach_or_fail(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), t, ["o_custkey"], "threshold")
    return out.select("o_orderkey", "threshold", (F.col("o_totalprice") >= F.col("threshold")).alias("above"))


@query(
    "conflict_categories",
    """WITH g AS (SELECT l_partkey, count(DISTINCT l_returnflag) AS n_labels, count(DISTINCT l_suppkey) AS n_addresses, count(DISTINCT l_linenumber) AS n_chains, count(DISTINCT l_linestatus) AS n_sources FROM lineitem GROUP BY 1)
    SELECT CASE WHEN n_labels <= 1 THEN 'none' WHEN n_addresses = 1 THEN 'same_address' WHEN n_chains > 1 THEN 'cross_chain' WHEN n_sources > 1 THEN 'cross_source' ELSE 'same_source' END AS category, count(*) AS n FROM g GROUP BY 1""",
)
def conflict_categories(spark, sf_dir):
    """Why parts have several return flags."""
    g = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(*[F.count_distinct(c).alias(n) for c, n in (("l_returnflag", "n_labels"), ("l_suppkey", "n_addresses"), ("l_linenumber", "n_chains"), ("l_linestatus", "n_sources"))])
    return relational.conflict_category(g).groupBy("category").agg(F.count("*").alias("n"))


_RULES = (("STANDARD", "std"), ("STANDARD ANODIZED", "std-anodized"), ("PROMO", "promo"), ("ECONOMY", "eco"), ("SMALL", "small"))
_RULES_SQL = ", ".join(f"('{p}', '{n}')" for p, n in _RULES)


@query("prefix_rule_match", f"WITH r(prefix, rule) AS (VALUES {_RULES_SQL}) SELECT p_partkey, p_type, prefix, rule FROM part JOIN r ON starts_with(p_type, prefix)")
def prefix_rule_match(spark, sf_dir):
    rules = spark.createDataFrame(_RULES, "prefix string, rule string")
    return relational.prefix_matches(table(spark, sf_dir, "part").select("p_partkey", "p_type"), "p_type", rules, "prefix").select("p_partkey", "p_type", "prefix", "rule")


@query(
    "default_on_missing",
    """WITH late AS (SELECT l_orderkey, max(l_returnflag) AS flag, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
    SELECT o_orderkey, coalesce(flag, 'UnkownCall') AS flag, coalesce(n, 0) AS n FROM orders LEFT JOIN late ON o_orderkey = l_orderkey""",
)
def default_on_missing(spark, sf_dir):
    late = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_returnflag").alias("flag"), F.count("*").alias("n"))
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    out = relational.default_on_missing(o, late, ["o_orderkey"], "flag", "UnkownCall")
    return relational.default_on_missing(out, late, ["o_orderkey"], "n", 0)


@query(
    "call_closure",
    """WITH RECURSIVE e AS (SELECT DISTINCT p_size AS src, (p_size * 7 + 3) % 53 AS dst FROM part),
    c AS (SELECT src, dst FROM e UNION SELECT c.src, e.dst FROM c JOIN e ON c.dst = e.src) SELECT CAST(src AS INTEGER) AS src, CAST(dst AS INTEGER) AS dst FROM c""",
)
def call_closure(spark, sf_dir):
    """All reachable pairs of a cyclic graph derived from part sizes."""
    return transitive_closure(table(spark, sf_dir, "part").select(F.col("p_size").alias("src"), ((F.col("p_size") * 7 + 3) % 53).alias("dst")))


@query(
    "interval_merge",
    """WITH i AS (SELECT user_id, ts AS s, ts + INTERVAL 30 MINUTE AS e FROM events),
    m AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
    g AS (SELECT *, sum(CASE WHEN s <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM m)
    SELECT user_id, min(s) AS "start", max(e) AS "end", count(*) AS n FROM g GROUP BY user_id, k""",
)
def interval_merge(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("user_id", F.col("ts").alias("s"), (F.col("ts") + F.expr("INTERVAL 30 MINUTES")).alias("e"))
    return relational.merge_intervals(ev, ["user_id"], "s", "e")


@query(
    "paired_pivot",
    """WITH g AS (SELECT user_id, max(CASE WHEN event_type = 'click' THEN 1 END) AS a, max(CASE WHEN event_type = 'view' THEN 1 END) AS b,
    max(CASE WHEN event_type = 'click' AND value > 50 THEN 1 WHEN event_type = 'click' THEN 0 END) AS x, max(CASE WHEN event_type = 'view' AND value > 50 THEN 1 WHEN event_type = 'view' THEN 0 END) AS y FROM events GROUP BY user_id)
    SELECT count(*) FILTER (WHERE x = 1 AND y = 1) AS "both", count(*) FILTER (WHERE x = 1 AND y = 0) AS only_a, count(*) FILTER (WHERE x = 0 AND y = 1) AS only_b, count(*) FILTER (WHERE x = 0 AND y = 0) AS neither FROM g WHERE a = 1 AND b = 1""",
)
def paired_pivot(spark, sf_dir):
    ev = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "view")).select("user_id", "event_type", (F.col("value") > 50).cast("int").alias("hit"))
    return relational.paired_counts(ev, ["user_id"], "event_type", "hit", "click", "view")


@query(
    "funnel_counts",
    """SELECT count(*) AS events, count(*) FILTER (WHERE value > 10) AS above_10, count(*) FILTER (WHERE value > 10 AND event_type = 'click') AS clicks, count(*) FILTER (WHERE value > 10 AND event_type = 'click' AND user_id % 2 = 0) AS even_users FROM events""",
)
def funnel_counts(spark, sf_dir):
    stages = [("events", F.lit(True)), ("above_10", F.col("value") > 10), ("clicks", F.col("event_type") == "click"), ("even_users", F.col("user_id") % 2 == 0)]
    return relational.funnel(table(spark, sf_dir, "events"), stages)


@query(
    "set_overlap",
    """WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'click'), b AS (SELECT DISTINCT user_id FROM events WHERE value > 90),
    j AS (SELECT a.user_id AS x, b.user_id AS y FROM a FULL JOIN b ON a.user_id = b.user_id)
    SELECT count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) AS "both", count(*) FILTER (WHERE y IS NULL) AS only_a, count(*) FILTER (WHERE x IS NULL) AS only_b, round(count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) / count(*), 9) AS jaccard FROM j""",
)
def set_overlap(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return relational.set_overlap(ev.where("event_type = 'click'"), ev.where("value > 90"), "user_id").withColumn("jaccard", F.round("jaccard", 9))


@query(
    "pairwise_disjoint",
    """WITH o AS (SELECT DISTINCT event_type AS k, user_id FROM events WHERE value > 95)
    SELECT a.k AS a, b.k AS b, count(*) AS shared FROM o a JOIN o b USING (user_id) WHERE a.k < b.k GROUP BY 1, 2""",
)
def pairwise_disjoint(spark, sf_dir):
    return relational.pairwise_disjoint(table(spark, sf_dir, "events").where("value > 95"), "event_type", "user_id")


@query(
    "delegation_degree",
    """WITH e AS (SELECT DISTINCT l_suppkey AS target, l_orderkey AS account FROM lineitem WHERE l_quantity > 45)
    SELECT target, account, count(*) OVER (PARTITION BY target) AS n FROM e""",
)
def delegation_degree(spark, sf_dir):
    """Who delegates to each target, and how many do."""
    e = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("account"), F.col("l_suppkey").alias("target"))
    return relational.delegation_degree(e, "account", "target")


@query(
    "unmatched_keys",
    "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
)
def unmatched_keys(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(o, "c_custkey", "left_anti")


@query(
    "validated_attach",
    "SELECT o_orderkey, o_custkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey",
)
def validated_attach(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return relational.validated_join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), c, ["o_custkey"])


_NEAR_SQL = """WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 100 = 0),
    d AS (SELECT q.vec_id AS id, e.vec_id AS neighbour, sqrt(list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) ** 2))) AS distance FROM q JOIN embeddings e ON q.vec_id <> e.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, neighbour) AS rank FROM d)"""


@query("nearest_neighbor", f"{_NEAR_SQL} SELECT id, neighbour, round(distance, 9) AS distance, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5")
def nearest_neighbor(spark, sf_dir):
    """The five nearest of every vector whose id is divisible by 100, among all."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return models.nearest(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", 5).withColumn("distance", F.round("distance", 9))


@query("knn_mean_distance", f"{_NEAR_SQL} SELECT id, round(avg(distance), 9) AS mean_distance FROM r WHERE rank <= 5 GROUP BY id")
def knn_mean_distance(spark, sf_dir):
    """Mean distance to the five nearest of every vector whose id is divisible by 100."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    near = models.nearest(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", 5)
    return near.groupBy("id").agg(F.round(F.avg("distance"), 9).alias("mean_distance"))


@query(
    "knn_scaled_distance",
    """WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS k FROM embeddings),
    s AS (SELECT k, avg(x) AS m, stddev_pop(x) AS s FROM x WHERE vec_id % 5 <> 0 GROUP BY k),
    z AS (SELECT vec_id, list((x - m) / CASE WHEN s = 0 THEN 1 ELSE s END ORDER BY k) AS v FROM x JOIN s USING (k) GROUP BY vec_id),
    d AS (SELECT q.vec_id AS id, e.vec_id AS neighbour, sqrt(list_sum(list_transform(list_zip(q.v, e.v), lambda x: (x[1] - x[2]) ** 2))) AS distance
      FROM z q JOIN z e ON q.vec_id <> e.vec_id WHERE q.vec_id % 100 = 0 AND e.vec_id % 5 <> 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, neighbour) AS rank FROM d)
    SELECT id, round(avg(distance), 8) AS mean_distance FROM r WHERE rank <= 5 GROUP BY id""",
)
def knn_scaled_distance(spark, sf_dir):
    """Mean distance of every vector whose id is divisible by 100 to its five nearest training vectors, in the training vectors' scale."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    train = e.where("vec_id % 5 <> 0")
    ask, known = (neighbours.scaled(x, train, "embedding") for x in (e.where("vec_id % 100 = 0"), train))
    near = models.nearest(ask, known, "vec_id", "embedding", 5)
    return near.groupBy("id").agg(F.round(F.avg("distance"), 8).alias("mean_distance"))


@query("neighbour_search_share")
def neighbour_search_share(spark, sf_dir):
    """What the exact search for the five nearest of every hundredth vector compares: queries, rows and pairs."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.search(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", 5)[1]


@query(
    "set_members",
    """WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'click'), b AS (SELECT DISTINCT user_id FROM events WHERE value > 90)
    SELECT user_id AS value, user_id IN (SELECT user_id FROM a) AS in_a, user_id IN (SELECT user_id FROM b) AS in_b FROM (SELECT * FROM a UNION SELECT * FROM b)""",
)
def set_members(spark, sf_dir):
    """Users who clicked, and users with a high value: the union, with both memberships."""
    ev = table(spark, sf_dir, "events")
    return relational.set_members(ev.where("event_type = 'click'"), ev.where("value > 90"), "user_id")
