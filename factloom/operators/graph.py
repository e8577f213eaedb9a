"""Links between facts: making, strengthening, normalising and exploring them.

Links are directed rows (source_id, target_id, ...). Set overlaps are found by joining on shared rare tokens, never by comparing all
facts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..frames import BROADCAST_ROWS, attach, drop, materialize, new_path
from .nearest import nearest
from .sets import similar


def overlaps(tokens: DataFrame, recent: int) -> DataFrame:
    """(a, b, shared, n_a, n_b) for facts a > b (by row_seq) that share tokens, b among the ``recent`` numbers before a.

    ``tokens`` has (id, row_seq, tokens). Predecessors lie in a's own bucket of numbers or the one before, so rows meet by (token, bucket). Spark
    judges tokens by the bytes of the file they come from; they are many times that, so neither side may be sent whole through the driver.
    """
    long = tokens.select("id", "row_seq", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    bucket = F.floor(F.col("row_seq") / recent)
    a = long.select(F.col("id").alias("a"), F.col("row_seq").alias("sa"), F.col("n").alias("n_a"), "token", F.explode(F.array(bucket, bucket - 1)).alias("bucket"))
    b = long.select(F.col("id").alias("b"), F.col("row_seq").alias("sb"), F.col("n").alias("n_b"), "token", bucket.alias("bucket"))
    both = a.hint("merge").join(b, ["token", "bucket"]).where((F.col("sb") < F.col("sa")) & (F.col("sa") - F.col("sb") <= recent))
    return both.groupBy("a", "b").agg(F.count("*").alias("shared"), F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"))


def similar_sets(tokens: DataFrame, threshold: float, measure: str = "jaccard") -> DataFrame:
    """(a, b, sim) of all pairs a > b of (id, tokens) whose sets have a similarity of ``threshold`` or more. Exact.

    ``measure`` is "jaccard" or "cosine" (shared over the geometric mean of the sizes). Tokens, and sets, are told apart by 64-bit hashes. Equal
    sets are one set while pairs are sought, so many copies cost no pairs until the end; see :mod:`.sets` for how the others meet.
    """
    words = F.coalesce("tokens", F.array().cast("array<string>"))
    hashed = tokens.select("id", F.sort_array(F.array_distinct(F.transform(words, lambda t: F.xxhash64(t)))).alias("h"))
    kinds = materialize(hashed.where(F.size("h") > 0).select("id", F.xxhash64("h").alias("k"), "h"), "hashed")
    shared, m, n = F.col("shared"), F.col("m"), F.col("n")
    sim = shared / (m + n - shared) if measure == "jaccard" else shared / F.sqrt(m.cast("double") * n)
    near = similar(kinds.select("k", "h"), threshold, measure).select("k", "k2", sim.alias("sim")).where(F.col("sim") >= threshold)
    near = near.union(near.select("k2", "k", "sim"))
    member = kinds.select("id", "k")
    near = near.union(member.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k", "k", F.lit(1.0)))
    a, b = member.select(F.col("id").alias("a"), "k"), member.select(F.col("id").alias("b"), F.col("k").alias("k2"))
    return a.join(near, "k").join(b, "k2").where("a > b").select("a", "b", "sim")


def keyword_links(tokens: DataFrame, recent: int = 50) -> DataFrame:
    """Links of facts with three shared words or more and a Jaccard similarity of 0.15 or more, to the latest predecessors."""
    j = F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared"))
    return overlaps(tokens, recent).where((F.col("shared") >= 3) & (j >= 0.15)).select(F.col("a").alias("source_id"), F.col("b").alias("target_id"), (0.3 * j).alias("strength"))


def coupling_links(tokens: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Links of facts whose shared words over the geometric mean of their numbers exceed the threshold."""
    x = similar_sets(tokens, threshold, "cosine").where(F.col("sim") > threshold)
    return x.select(F.col("a").alias("source_id"), F.col("b").alias("target_id"), (0.5 * F.col("sim")).alias("strength"))


def temporal_links(facts: DataFrame, k: int = 4, reach: float = 320.0) -> DataFrame:
    """Links to the last k facts of the same scope: 0.28 * 0.85 ** place * exp(-gap / 120), over 0.02.

    A link from over ``reach`` seconds away is too weak whatever its place (0.28 * exp(-317 / 120) < 0.02). So a scope is cut into spans of that length, and
    facts are numbered among those of their span and the one before; a scope with all the rows is as many groups as its time has spans.
    """
    span = F.floor(F.col("created_at") / reach)
    x = facts.select("id", "scope_id", "created_at", "row_seq", F.explode(F.array(span, span + 1)).alias("span")).withColumn("own", F.floor(F.col("created_at") / reach) == F.col("span"))
    w = Window.partitionBy("scope_id", "span").orderBy("created_at", "row_seq")
    lags = [F.struct(F.lit(i).alias("place"), F.lag("id", i + 1).over(w).alias("target_id"), F.lag("created_at", i + 1).over(w).alias("then")) for i in range(k)]
    x = x.select("id", "own", "created_at", F.array(*lags).alias("lags")).where("own").select(F.col("id").alias("source_id"), "created_at", F.inline("lags"))
    strength = 0.28 * F.pow(F.lit(0.85), F.col("place")) * F.exp(-(F.col("created_at") - F.col("then")) / 120.0)
    return x.where(F.col("target_id").isNotNull()).withColumn("strength", strength).where("strength > 0.02").select("source_id", "target_id", "strength")


def semantic_links(vectors: DataFrame, block: str, threshold: float = 0.7, k: int = 5) -> DataFrame:
    """Links to at most k vectors of the same block with a cosine of ``threshold`` or more; strength half the cosine. Blocks meet in tiles."""
    near = nearest(vectors, vectors, k, block, threshold, itself=False)
    return near.select(F.col("query_id").alias("source_id"), F.col("id").alias("target_id"), (0.5 * F.col("sim")).alias("strength"))


def without_linked(new: DataFrame, links: DataFrame) -> DataFrame:
    """New links whose two ends are not linked yet, in either direction."""
    seen = links.select("source_id", "target_id").union(links.select("target_id", "source_id")).distinct()
    return new.join(seen, ["source_id", "target_id"], "left_anti")


def between(links: DataFrame, pairs: DataFrame) -> DataFrame:
    """The links of the (source_id, target_id) asked for, with all their columns."""
    return links.join(pairs.select("source_id", "target_id").distinct(), ["source_id", "target_id"], "left_semi")


def both_ways(links: DataFrame) -> DataFrame:
    back = links.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), *[c for c in links.columns if c not in ("source_id", "target_id")])
    return links.unionByName(back)


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new links in both directions; the greater strength and the later time win."""
    return old.unionByName(both_ways(new)).groupBy("source_id", "target_id").agg(F.max("strength").alias("strength"), F.max("last_updated").alias("last_updated"))


def decay(links: DataFrame, factor: float = Config.link_decay, least: float = 0.01) -> DataFrame:
    return links.withColumn("strength", F.col("strength") * factor).where(F.col("strength") >= least)


def npmi(p_ab: Column, p_a: Column, p_b: Column) -> Column:
    """Normalised pointwise mutual information in [-1, 1]; 0 where a count is 0 or the pair is certain."""
    ok = (p_ab > 0) & (p_a > 0) & (p_b > 0) & (p_ab < 1)
    safe = [F.when(ok, p).otherwise(0.5) for p in (p_ab, p_a, p_b)]
    value = F.ln(safe[0] / (safe[1] * safe[2])) / -F.ln(safe[0])
    return F.when(ok, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value))).otherwise(0.0)


def link_npmi(links: DataFrame, counts: DataFrame) -> DataFrame:
    """(source_id, target_id, npmi) from co-occurrences ``co`` and the (id, n) accesses of facts."""
    total = F.broadcast(counts.agg(F.sum("n").alias("total")))  # one row
    a, b = counts.select(F.col("id").alias("source_id"), F.col("n").alias("na")), counts.select(F.col("id").alias("target_id"), F.col("n").alias("nb"))
    x = links.join(a, "source_id").join(b, "target_id").crossJoin(total)
    return x.select("source_id", "target_id", npmi(F.col("co") / F.col("total"), F.col("na") / F.col("total"), F.col("nb") / F.col("total")).alias("npmi"))


def hebbian(results: DataFrame, links: DataFrame, eta: float = Config.learning_rate) -> DataFrame:
    """Links after facts were recalled together: (query_id, id, place, activation) of each query's best five strengthen their pairs.

    An existing link gains eta * a * b * (min(co, 100) ** 0.75 / 100 ** 0.75) * (1 + 0.2 * ln(1 + co)) per recall, at most to 1; a new
    pair starts in both directions with min(eta * a * b, 0.3).
    """
    x = results.where("place <= 5")
    y = x.select("query_id", F.col("id").alias("b"), F.col("place").alias("pb"), F.col("activation").alias("act_b"))
    pairs = x.join(y, "query_id").where("place < pb").groupBy(F.col("id").alias("source_id"), F.col("b").alias("target_id")).agg(F.sum(F.col("activation") * F.col("act_b")).alias("ab"), F.count("*").alias("times"))
    co = F.col("co") + F.col("times")
    gain = eta * F.col("ab") * (F.pow(F.least(co, F.lit(100)).cast("double"), F.lit(0.75)) / F.pow(F.lit(100.0), F.lit(0.75))) * (1.0 + 0.2 * F.log1p(co.cast("double")))
    kept = links.join(pairs, ["source_id", "target_id"], "left")
    touched = F.col("ab").isNotNull()
    old = kept.select("source_id", "target_id", F.when(touched, F.least(F.lit(1.0), F.col("strength") + gain)).otherwise(F.col("strength")).alias("strength"), F.when(touched, co).otherwise(F.col("co")).alias("co"))
    fresh = without_linked(pairs, links).select("source_id", "target_id", F.least(eta * F.col("ab"), F.lit(0.3)).alias("strength"), F.col("times").alias("co"))
    return old.unionByName(both_ways(fresh))


def homeostasis(links: DataFrame, limit: float = Config.homeostasis) -> DataFrame:
    """Scale the links of nodes whose mean strength exceeds the limit; a link takes the factors of both its ends."""
    ends = links.select(F.col("source_id").alias("id"), "strength").union(links.select("target_id", "strength"))
    mean = ends.groupBy("id").agg(F.avg("strength").alias("m")).where(F.col("m") > limit).select("id", (F.lit(limit) / F.col("m")).alias("f"))
    x = links.join(mean.select(F.col("id").alias("source_id"), F.col("f").alias("fa")), "source_id", "left").join(mean.select(F.col("id").alias("target_id"), F.col("f").alias("fb")), "target_id", "left")
    return x.select("source_id", "target_id", (F.col("strength") * F.coalesce("fa", F.lit(1.0)) * F.coalesce("fb", F.lit(1.0))).alias("strength"))


#: Links of a node in one row of the weight table; a hub has several.
HUB_LINKS = 256


def explore(links: DataFrame, seeds: DataFrame, rounds: int = Config.exploration_rounds, alpha: float = Config.exploration_alpha, order: str | None = None) -> DataFrame:
    """(id, s): personalised exploration from (id, seed) over (source_id, target_id, strength).

    Pull form, normalised by the receiver: s'(v) = alpha * p(v) + (1 - alpha) * sum(s(u) * w(v, u)) / sum(w(v, u)). The graph is
    made symmetric first; of rows of one pair, in either direction, the last in ``order`` (a column) counts, or without one the greatest strength.
    Exactly ``rounds`` rounds.

    Weights are dealt once: each node ``u`` has rows of at most about ``HUB_LINKS`` of its links, bucketed by (u, part). A round sends a score to
    each row of its node and the sums back to the receivers; weights stay where they are. Rounds end in the shared folder.
    """
    one = links.select("source_id", "target_id", "strength", *([F.col(order).alias("_at")] if order else []))
    both = both_ways(one)
    strength = F.max_by("strength", "_at") if order else F.max("strength")
    w = materialize(both.groupBy("source_id", "target_id").agg(strength.alias("w")), "weights")
    total = w.groupBy("source_id").agg(F.sum("w").alias("t"), F.ceil(F.count("*") / HUB_LINKS).cast("int").alias("parts"))
    mass = seeds.groupBy("id").agg(F.greatest(F.max("seed"), F.lit(0.01)).alias("m"))
    all_mass = F.broadcast(mass.agg(F.sum("m").alias("all")))  # one row
    nodes = total.select(F.col("source_id").alias("id"), "t", "parts").join(mass, "id", "full").crossJoin(all_mass)
    state = materialize(nodes.select("id", "t", F.coalesce("parts", F.lit(0)).alias("parts"), (F.coalesce("m", F.lit(0.01)) / F.col("all")).alias("p"), F.lit(0.0).alias("s")), "scores")
    small = _small(state)
    weights = _dealt(w.select(F.col("target_id").alias("u"), F.col("source_id").alias("v"), "w"), state, small)
    drop(w)
    try:
        for _ in range(rounds):
            pulled = weights.frame.join(_sent(state.where("s <> 0"), "s", small), ["u", "part"]).groupBy(F.col("v").alias("id")).agg(F.sum(F.col("w") * F.col("s")).alias("_in"))
            new = state.drop("s").join(pulled, "id", "left").withColumn("s", alpha * F.col("p") + (1 - alpha) * F.coalesce(F.col("_in") / F.col("t"), F.lit(0.0))).drop("_in")
            new = materialize(new, "scores")
            drop(state)
            state = new
    finally:
        weights.drop()
    return state.select("id", "s")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of the ends of all edges between two different nodes; component is the smallest node that is reached.

    Each round a node takes the smallest label among its neighbours, and then the label of that label, until nothing changes. Edges are dealt
    once, those of a hub in parts, so that no task holds them all; a round moves labels. Null ends are ignored.
    """
    e = edges.select("source_id", "target_id").where("source_id <> target_id")
    e = materialize(both_ways(e).distinct(), "edges")
    state = materialize(e.groupBy(F.col("source_id").alias("id")).agg(F.ceil(F.count("*") / HUB_LINKS).cast("int").alias("parts")).withColumn("component", F.col("id")), "labels")
    small = _small(state)
    dealt = _dealt(e.select(F.col("target_id").alias("u"), F.col("source_id").alias("v")), state, small)
    drop(e)
    try:
        while True:
            sent = _sent(state, "component", small)
            low = dealt.frame.join(sent, ["u", "part"]).groupBy(F.col("v").alias("id")).agg(F.min("component").alias("low"))
            near = materialize(state.select("id", "parts", F.col("component").alias("was")).join(low, "id").withColumn("component", F.least("was", "low")).drop("low"), "labels")
            drop(state)
            jump = near.where("component <> id").select(F.col("id").alias("component"), F.col("component").alias("far"))
            state = materialize(attach(near, jump, "component", "left").withColumn("component", F.coalesce("far", "component")).drop("far"), "labels")
            drop(near)
            if state.where("component <> was").isEmpty():
                return state.select("id", "component")
    finally:
        dealt.drop()


def _small(nodes: DataFrame) -> bool:
    return nodes.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def _dealt(links: DataFrame, nodes: DataFrame, small: bool) -> "Bucketed | Kept":
    """(u, part, v, ...): links with a part of ``u``'s, for joins with what :func:`_sent` gives; bucketed if the nodes are too many to be sent everywhere."""
    parts = nodes.select(F.col("id").alias("u"), "parts")
    x = links.join(F.broadcast(parts) if small else parts, "u")
    x = x.select("u", F.pmod(F.xxhash64("v"), "parts").cast("int").alias("part"), *[c for c in links.columns if c != "u"])
    return Kept(x) if small else Bucketed(x, ["u", "part"])


def _sent(state: DataFrame, value: str, small: bool) -> DataFrame:
    """(u, part, value): the value of a node for each part of its links."""
    x = state.where("parts > 0").select(F.col("id").alias("u"), value, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return F.broadcast(x) if small else x.hint("shuffle_merge")


class Kept:
    """A table in the shared folder."""

    def __init__(self, df: DataFrame) -> None:
        self.frame = materialize(df, "links")

    def drop(self) -> None:
        drop(self.frame)


class Bucketed:
    """A table in the shared folder dealt and sorted by its keys, so that a join on them moves only the other side."""

    def __init__(self, df: DataFrame, keys: list[str]) -> None:
        self.spark = df.sparkSession
        path = new_path(self.spark, "bucketed")
        name = "factloom_" + path.rsplit("-", 1)[1]
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        df.repartition(n, *keys).write.format("parquet").bucketBy(n, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
        self.frame = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")  # out of the catalog; the files of a table with a path of its own stay, and the frame reads them
        self.frame._factloom_path = path

    def drop(self) -> None:
        drop(self.frame)


def _breadth_first(e: DataFrame) -> tuple[DataFrame, int]:
    """((id, parent, level), greatest level): breadth-first trees of a symmetric graph, each from the smallest node of its component."""
    roots = components(e).select("component").distinct()
    seen = front = materialize(roots.select(F.col("component").alias("id"), F.lit(None).cast("long").alias("parent"), F.lit(0).alias("level")))
    level = 0
    while True:
        met = e.join(front.select(F.col("id").alias("source_id")), "source_id").groupBy(F.col("target_id").alias("id")).agg(F.min("source_id").alias("parent"))
        front = materialize(met.join(seen.select("id"), "id", "left_anti").withColumn("level", F.lit(level + 1)))
        if front.isEmpty():
            return seen, level
        level += 1
        seen = materialize(seen.unionByName(front))


def articulation_points(edges: DataFrame) -> DataFrame:
    """(id): nodes whose removal parts their component. No task holds a component; there is a round of joins for each level of its tree.

    In a breadth-first tree links join nodes of one level or of neighbouring levels. From the deepest level upwards, links are lifted to the
    parents of their ends until the ends are brothers. Brothers so joined are one group. A node parts the graph where a group of its
    sons has no link that leads past it; a root, where it has more than one group.
    """
    one = edges.select(F.col("source_id").cast("long").alias("source_id"), F.col("target_id").cast("long").alias("target_id")).where("source_id <> target_id")
    e = materialize(both_ways(one).distinct())
    tree, depth = _breadth_first(e)
    ends = [tree.select(F.col("id").alias(n), F.col("parent").alias(f"p_{n}"), F.col("level").alias(f"l_{n}")) for n in ("x", "y")]
    # each link once, from its deeper end; links of a son with its own parent are the tree itself
    links = e.toDF("x", "y").join(ends[0], "x").join(ends[1], "y").where("l_x > l_y or (l_x = l_y and x < y)")
    links = materialize(links.where("l_x = l_y or p_x <> y").select("x", "y", "p_x", "p_y", F.col("l_x").alias("level"), (F.col("l_x") > F.col("l_y")).alias("up")))
    past = links.where("up").select(F.col("x").alias("id"))
    brothers, lifted = [], None
    for level in range(depth, 0, -1):
        own = links.where((F.col("level") == level) & ~F.col("up")).select("x", "y", "p_x", "p_y")
        if lifted is not None:
            at = [t.where(F.col(f"l_{n}") == level).drop(f"l_{n}") for t, n in zip(ends, ("x", "y"))]
            own = own.unionByName(lifted.join(at[0], "x").join(at[1], "y").select("x", "y", "p_x", "p_y"))
        pairs = materialize(own.distinct())
        brothers.append(pairs.where("p_x = p_y").select("x", "y"))
        apart = pairs.where("p_x <> p_y")
        past = past.union(apart.select("x")).union(apart.select("y"))
        high = apart.select(F.col("p_x").alias("x"), F.col("p_y").alias("y")).union(links.where((F.col("level") == level) & F.col("up")).select(F.col("p_x").alias("x"), "y"))
        lifted = high.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
        if level % 20 == 0:
            brothers, past = [materialize(reduce(DataFrame.union, brothers))], materialize(past.distinct())
    sons = tree.where("level > 0").select("id", "parent", (F.col("level") == 1).alias("of_root"))
    if brothers:
        joined = components(reduce(DataFrame.union, brothers).toDF("source_id", "target_id"))
        sons = sons.join(joined, "id", "left")
    else:
        sons = sons.withColumn("component", F.lit(None).cast("long"))
    groups = sons.join(past.distinct().withColumn("past", F.lit(1)), "id", "left").groupBy("parent", "of_root", F.coalesce("component", "id").alias("g")).agg(F.max("past").alias("past"))
    nodes = groups.groupBy("parent", "of_root").agg(F.count("*").alias("n"), F.max(F.col("past").isNull()).alias("held"))
    return nodes.where(F.when(F.col("of_root"), F.col("n") > 1).otherwise(F.col("held"))).select(F.col("parent").alias("id"))


def cut_vertices(edges: Iterator[tuple[int, int]]) -> set[int]:
    """Cut vertices of an undirected simple graph, by depth-first numbering without recursion."""
    near: dict[int, list[int]] = {}
    for a, b in edges:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    order: dict[int, int] = {}
    low: dict[int, int] = {}
    out: set[int] = set()
    for root in near:
        if root in order:
            continue
        order[root] = low[root] = len(order)
        stack, sons = [(root, None, iter(near[root]))], 0
        while stack:
            node, parent, rest = stack[-1]
            step = next(rest, None)
            if step is None:
                stack.pop()
                if stack:
                    up = stack[-1][0]
                    low[up] = min(low[up], low[node])
                    if up == root:
                        sons += 1
                    elif low[node] >= order[up]:
                        out.add(up)
            elif step not in order:
                order[step] = low[step] = len(order)
                stack.append((step, node, iter(near[step])))
            elif step != parent:
                low[node] = min(low[node], order[step])
        if sons > 1:
            out.add(root)
    return out
