"""Joins, group conflicts, windows, set operations and rule programs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.operators.graph import transitive_closure
from quern.operators.ranges import ranked
from quern.plans.materialize import materialize

#: Rows of a rule dimension that may be sent to every executor.
BROADCAST_ROWS = 100_000
#: Rows, and pairs of them, that one task gets where members of a group meet.
MEETING_ROWS = 250_000


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint where it has at most ``most`` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def validated_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", one: str = "many_to_one") -> DataFrame:
    """Join after a check that keys are unique on the right (and left, one_to_one)."""
    for side, df in (("right", right), *([("left", left)] if one == "one_to_one" else [])):
        if not df.groupBy(*keys).count().where("count > 1").limit(1).isEmpty():
            raise ValueError(f"keys {keys} repeat on the {side} side")
    return left.join(right, keys, how)


def attach_or_fail(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Left join in which an unmatched row is an error when it is read."""
    out = left.join(right.select(*keys, value), keys, "left")
    return out.withColumn(value, F.when(F.col(value).isNotNull(), F.col(value)).otherwise(F.raise_error(F.lit(f"no {value} for a key")).cast(right.schema[value].dataType)))


def conflicting_groups(df: DataFrame, key: str, label: str) -> DataFrame:
    """Keys with more than one label: (key, n_labels, labels, members)."""
    g = df.groupBy(key).agg(F.count_distinct(label).alias("n_labels"), F.array_join(F.sort_array(F.collect_set(F.col(label).cast("string"))), ";").alias("labels"), F.count("*").alias("members"))
    return g.where("n_labels > 1")


def quarantine(df: DataFrame, key: str, label: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose key has one label, and rows of conflicting keys, positives included."""
    bad = conflicting_groups(df, key, label).select(key)
    return df.join(bad, key, "left_anti"), df.join(bad, key, "left_semi")


def conflict_category(group: DataFrame) -> DataFrame:
    """Why a group conflicts: by its distinct chains, addresses and sources."""
    c = F.when(F.col("n_labels") <= 1, "none").when(F.col("n_addresses") == 1, "same_address").when(F.col("n_chains") > 1, "cross_chain").when(F.col("n_sources") > 1, "cross_source").otherwise("same_source")
    return group.withColumn("category", c)


def siblings(df: DataFrame, group: str, member: str) -> DataFrame:
    """(group, member, sibling): ordered pairs of different members.

    The self join is on the group key, so its rows are spread and skewed groups
    can be split; no group is collected.
    """
    own = df.select(group, member).distinct()
    return own.join(own.withColumnRenamed(member, "sibling"), group).where(F.col(member) != F.col("sibling"))


def sibling_groups(df: DataFrame, group: str, member: str) -> DataFrame:
    """(group, member, n_siblings): the same relation without its pairs, a row for each member; null groups have no members.

    A hot group's size is summed before it is joined, and the join is on one row per group.
    """
    own = df.where(F.col(group).isNotNull()).select(group, member).distinct()
    size = own.groupBy(group).agg((F.count("*") - 1).alias("n_siblings"))
    return own.join(size, group)


def group_matches(df: DataFrame, group: str, member: str, selector: str) -> DataFrame:
    """(group, member, other, shared): members of one group that share selectors, member < other, with those they share.

    Members meet on group and selector at once, so only pairs with something in
    common arise, whatever the size of a group. Nulls match nothing. Rows and pairs
    are counted first and dealt over as many tasks as they take, so what a task holds doesn't grow with them.
    """
    rows = df.select(group, member, selector).dropna()
    own = materialize(rows.repartition(1 + rows.count() // MEETING_ROWS, group, selector).distinct(), "members")
    meet = own.groupBy(group, selector).agg(F.count("*").cast("double").alias("n"))
    lots = 1 + int((meet.agg(F.sum(F.col("n") * (F.col("n") + 1) / 2)).first()[0] or 0) // MEETING_ROWS)
    own = own.repartition(lots, group, selector)
    other = own.withColumnRenamed(member, "other")
    pairs = own.join(other, [group, selector]).where(F.col(member) < F.col("other"))
    pairs = pairs.repartition(lots, group, member, "other")
    return pairs.groupBy(group, member, "other").agg(F.array_sort(F.collect_list(selector)).alias("shared"))


def selector_matches(relations: DataFrame, selectors: DataFrame) -> DataFrame:
    """(target, related, shared): related contracts that share selectors with a target.

    relations: target, related; selectors: address, selector. Related contracts
    may be in an array, and so may the selectors of a row (then ``selectors``).
    Addresses are lowered. Pairs meet on target, then on related
    and selector, so no contract's selectors are gathered before they match.
    """
    one = F.explode("selectors").alias("selector") if "selectors" in selectors.columns else F.col("selector")
    own = selectors.select(F.lower("address").alias("address"), one).distinct()
    listed = isinstance(relations.schema["related"].dataType, T.ArrayType)
    pairs = relations.select("target", (F.explode("related") if listed else F.col("related")).alias("related"))
    pairs = pairs.select(F.lower("target").alias("target"), F.lower("related").alias("related")).distinct()
    wanted = pairs.join(own.withColumnRenamed("address", "target"), "target")
    hit = wanted.join(own.withColumnRenamed("address", "related"), ["related", "selector"])
    return hit.groupBy("target", "related").agg(F.array_sort(F.collect_list("selector")).alias("shared"))


def projection(df: DataFrame, column: str, values: dict, names: list[str]) -> DataFrame:
    """``df`` with columns looked up by the value of one: a tuple of ``names`` for each; null where there is none.

    The dictionary is a dimension of a few rows, written into the plan.
    """
    kinds = {n: F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v[i]))]) for i, n in enumerate(names)}
    return df.withColumns({n: m[F.col(column)] for n, m in kinds.items()})


def finite(df: DataFrame, *columns: str) -> DataFrame:
    """Rows in which all the columns are numbers: not null, NaN or infinite."""
    keep = F.lit(True)
    for c in columns:
        keep = keep & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c).cast("double")) < float("inf"))
    return df.where(keep)


def prefix_matches(df: DataFrame, column: str, rules: DataFrame, prefix: str) -> DataFrame:
    """Rows and the rules whose prefix they start with.

    Prefixes are looked up by equality at each length that occurs, so there is
    no join of all rows with all rules.
    """
    lengths = rules.agg(F.collect_set(F.length(prefix)).alias("__lengths"))
    heads = df.crossJoin(F.broadcast(lengths))  # one row, with a number for each length of prefix
    fits = F.filter("__lengths", lambda n: n <= F.length(column))
    heads = heads.withColumn("__head", F.explode(F.transform(fits, lambda n: F.left(column, n)))).drop("__lengths")
    return heads.join(small(rules), F.col("__head") == F.col(prefix)).drop("__head")


def default_on_missing(left: DataFrame, right: DataFrame, keys: list[str], value: str, default) -> DataFrame:
    """Rule negation: the value of a match, or a constant."""
    return left.join(right.select(*keys, value), keys, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def resolve_designators(codes: DataFrame) -> DataFrame:
    """Runtime code of rows that are designators: the one code of the same chain and address.

    codes: chain, address, code, is_designator. Ambiguous ones stay unresolved.
    """
    real = codes.where("not is_designator and code != ''").groupBy("chain", "address").agg(F.count_distinct("code").alias("n"), F.min("code").alias("runtime"))
    return codes.where("is_designator").join(real, ["chain", "address"], "left").withColumn("runtime", F.when(F.col("n") == 1, F.col("runtime"))).drop("n")


def delegation_degree(edges: DataFrame, account: str, target: str) -> DataFrame:
    """(target, account, n): every account that delegates to a target, once, and how many do."""
    own = edges.select(target, account).where(F.col(target).isNotNull() & F.col(account).isNotNull()).distinct()
    return own.join(own.groupBy(target).agg(F.count("*").alias("n")), target)


def funnel(df: DataFrame, stages: list[tuple[str, Column]]) -> DataFrame:
    """One row of counts, each stage keeping what all before it kept; one pass."""
    kept, out = F.lit(True), []
    for name, keep in stages:
        kept = kept & F.coalesce(keep, F.lit(False))
        out.append(F.count_if(kept).alias(name))
    return df.agg(*out)


def paired_counts(df: DataFrame, keys: list[str], model: str, hit: str, a: str, b: str) -> DataFrame:
    """both, only a, only b, neither over rows that two models share."""
    wide = df.groupBy(*keys).pivot(model, [a, b]).agg(F.max(hit)).dropna(subset=[a, b])
    x, y = F.col(a) == 1, F.col(b) == 1
    return wide.agg(F.count_if(x & y).alias("both"), F.count_if(x & ~y).alias("only_a"), F.count_if(~x & y).alias("only_b"), F.count_if(~x & ~y).alias("neither"))


def macro_mean(df: DataFrame, group: str, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean of group means, with the pooled mean and that of groups of one."""
    g = df.groupBy(*by, group).agg(F.avg(value).alias("m"), F.sum(value).alias("s"), F.count(value).alias("n"))
    return g.groupBy(*by).agg(F.avg("m").alias("macro"), (F.sum("s") / F.sum("n")).alias("pooled"), F.avg(F.when(F.col("n") == 1, F.col("m"))).alias("singletons"))


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key: the first in an explicit order."""
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__k = 1").drop("__k")


def evenly_spaced(df: DataFrame, group: list[str], order: list, n: int) -> DataFrame:
    """At most n rows of each group at even distances in an order."""
    own = Window.partitionBy(*group)
    k, size = F.row_number().over(own.orderBy(*order)) - 1, F.count("*").over(own)
    out = df.withColumns({"__k": k, "__n": size})
    slot = F.floor(F.col("__k") * n / F.col("__n"))
    before = F.floor((F.col("__k") - 1) * n / F.col("__n"))
    return out.where((F.col("__n") <= n) | (F.col("__k") == 0) | (slot != before)).drop("__k", "__n")


def sample(df: DataFrame, key: str, n: int, seed: int = 7702, strata: tuple[str, ...] = ()) -> DataFrame:
    """n rows (of each stratum) without replacement, by a seeded hash; ties by key."""
    order = [F.xxhash64(key, F.lit(seed)), F.col(key)]
    if not strata:
        return df.orderBy(*order).limit(n)
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*strata).orderBy(*order))).where(F.col("__k") <= n).drop("__k")


def set_overlap(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Counts of both, only the first, only the second, and the Jaccard index."""
    x = a.select(column).distinct().withColumn("x", F.lit(1))
    y = b.select(column).distinct().withColumn("y", F.lit(1))
    j = x.join(y, column, "full")
    both, only_a, only_b = F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()), F.count_if(F.col("y").isNull()), F.count_if(F.col("x").isNull())
    return j.agg(both.alias("both"), only_a.alias("only_a"), only_b.alias("only_b"), F.try_divide(both, F.count("*")).alias("jaccard"))


def set_members(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """(value, in_a, in_b): every value of either column once; a null is one value."""
    rows = a.select(F.col(column).alias("value"), F.lit(True).alias("a"), F.lit(False).alias("b"))
    rows = rows.unionByName(b.select(F.col(column).alias("value"), F.lit(False).alias("a"), F.lit(True).alias("b")))
    return rows.groupBy("value").agg(F.bool_or("a").alias("in_a"), F.bool_or("b").alias("in_b"))


def same_set(a: DataFrame, b: DataFrame) -> bool:
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def merge_intervals(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """(keys, start, end, n) of intervals that touch or overlap, joined."""
    own = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(own.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col(start) <= reach, 0).otherwise(1)).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn("__i", island).groupBy(*keys, "__i").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("n")).drop("__i")


def pairwise_disjoint(df: DataFrame, part: str, value: str) -> DataFrame:
    """(a, b, shared) of parts with values in common; no rows if all are disjoint."""
    own = df.select(part, value).distinct()
    a, b = own.withColumnRenamed(part, "a"), own.withColumnRenamed(part, "b")
    return a.join(b, value).where(F.col("a") < F.col("b")).groupBy("a", "b").agg(F.count("*").alias("shared"))


def unique_donors(pool: DataFrame, sid: str, code_hash: str) -> DataFrame:
    """The row with the smallest id of each code, so that no code stands in two pools; rows without a hash go."""
    first = pool.where(F.col(code_hash).isNotNull()).groupBy(code_hash).agg(F.min(sid).alias(sid))
    return pool.join(first, [code_hash, sid], "left_semi")


def donor_ledger(recipients: DataFrame, pool: DataFrame, family: str, fold: str, n: int, seed: int = 7702) -> DataFrame:
    """n different donors of another family for each recipient, drawn from the whole pool of its fold, with the draw.

    (sid, rank, fold, family, donor, donor_family, pool_size, place): a fold's
    donors are numbered by family and id, so a family's places are a range that
    is left out for its own recipients; ``pool_size`` is what is left. The draws
    are equally far apart and begin at a place told by md5(sid|seed), so each
    donor is as likely as any other. With fewer donors than n, all are drawn. Ids (``sid``) must differ within the pool. A
    recipient without a fold, or whose fold has no other family, gets none; a
    null family is another than all.
    """
    d = pool.select(F.col("sid").alias("donor"), F.col(family).alias("donor_family"), F.col(fold).alias("fold")).where("fold is not null")
    d = materialize(ranked(d, [("donor_family", False), ("donor", False)], "place", by=("fold",)).withColumn("place", F.col("place") - 1), "donors")
    folds = d.groupBy("fold").agg(F.count("*").alias("all"))
    own = d.groupBy("fold", F.col("donor_family").alias("family")).agg(F.min("place").alias("first"), F.count("*").alias("many"))
    r = recipients.select("sid", F.col(family).alias("family"), F.col(fold).alias("fold")).join(F.broadcast(folds), "fold").join(own, ["fold", "family"], "left")
    many = F.coalesce("many", F.lit(0))
    r = r.withColumn("pool_size", F.col("all") - many).where("pool_size > 0").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(n), "pool_size") - 1)))
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("sid").cast("string"), F.lit(str(seed)))), 1, 12), 16, 10).cast("double") / 2.0**48
    place = F.floor((F.col("k") + u) * F.col("pool_size") / F.least(F.lit(n), "pool_size"))
    r = r.withColumn("place", place).withColumn("place", F.when(F.col("place") >= F.col("first"), F.col("place") + many).otherwise(F.col("place")))
    return r.join(d, ["fold", "place"]).select("sid", (F.col("k") + 1).alias("rank"), "fold", "family", "donor", "donor_family", "pool_size", "place")


def donors(recipients: DataFrame, pool: DataFrame, family: str, fold: str, n: int, seed: int = 7702) -> DataFrame:
    """(sid, donor, rank) of ``donor_ledger``."""
    return donor_ledger(recipients, pool, family, fold, n, seed).select("sid", "donor", F.col("rank").cast("int").alias("rank"))


def call_rules(facts: dict[str, DataFrame]) -> DataFrame:
    """Public functions that reach an external call: (func, sel, n_calls, target).

    facts: public(func, sel), in_function(block, func), call_edge(block, func),
    opcode(stmt, op), statement(stmt, func), target(stmt, sig). Reach is a
    fixpoint over the call graph; a call without a known target is UnkownCall.
    """
    edges = facts["in_function"].withColumnRenamed("func", "src").join(facts["call_edge"].withColumnRenamed("func", "dst"), "block").select("src", "dst")
    reach = transitive_closure(edges).unionByName(facts["public"].select(F.col("func").alias("src"), F.col("func").alias("dst"))).distinct()
    calls = facts["opcode"].where(F.col("op").isin("CALL", "DELEGATECALL", "STATICCALL", "CALLCODE")).join(facts["statement"], "stmt")
    calls = default_on_missing(calls, facts["target"], ["stmt"], "sig", "UnkownCall")
    hit = facts["public"].join(reach, F.col("func") == F.col("src")).drop("func").join(calls.withColumnRenamed("func", "dst"), "dst", "left")
    return hit.groupBy(F.col("src").alias("func"), "sel").agg(F.count("stmt").alias("n_calls"), F.array_sort(F.collect_set("sig")).alias("targets"))
