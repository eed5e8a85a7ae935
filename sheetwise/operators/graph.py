"""Graph operators over an edge table: components, bounded walks, neighbours, one-to-one matching.

Loops write each round as Parquet in the folder of spark.checkpoint.dir, so plans stay small and a lost
executor costs one round.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: list[str] = []


def written(df: DataFrame) -> DataFrame:
    """df as Parquet in the folder that driver and executors share (spark.checkpoint.dir; a local one only for a session in one process)."""
    spark: SparkSession = df.sparkSession
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _OWN_DIR:
            _OWN_DIR.append("file://" + tempfile.mkdtemp(prefix="sheetwise-"))
        top = _OWN_DIR[0]
    path = f"{top.rstrip('/')}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """node, component: the smallest node that each node is connected to.

    Each round lowers the label of a node, and that of the node it names, to the least label next to it, then jumps
    along that label, until nothing changes: labels only fall, and once none does they are equal along every edge."""
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b"))
    both = written(e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("m"))
        step = labels.join(near, labels["node"] == near["a"], "left").select("node", F.col("component").alias("old"), F.least("component", "m").alias("low"))
        own, root = F.struct("node", "low", "old"), F.struct(F.col("old").alias("node"), "low", F.lit(None).cast(labels.schema["component"].dataType).alias("old"))
        step = step.select(F.explode(F.array(own, root)).alias("x")).select("x.*").groupBy("node").agg(F.min("low").alias("low"), F.max("old").alias("old"))
        jump = labels.select(F.col("node").alias("low"), F.col("component").alias("far"))
        new = written(step.join(jump, "low", "left").select("node", F.least("low", "far").alias("component"), "old"))
        labels = new.select("node", "component")
        if not new.filter("component <> old").limit(1).count():
            return labels


def walk(edges: DataFrame, starts: DataFrame, direction: str = "downstream", max_depth: int = 12, src: str = "src", dst: str = "dst") -> DataFrame:
    """node, depth: the least number of edges from any start node (column node), up to max_depth.

    `downstream` follows edges, `undirected` both ways, anything else follows them backwards."""
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b"))
    back = e.select(F.col("b").alias("a"), F.col("a").alias("b"))
    e = e if direction == "downstream" else e.unionAll(back) if direction == "undirected" else back
    e = written(e.distinct())
    seen = frontier = written(starts.select("node").distinct().withColumn("depth", F.lit(0)))
    for depth in range(1, max_depth + 1):
        ahead = e.join(frontier.select(F.col("node").alias("a")), "a").select(F.col("b").alias("node")).distinct()
        frontier = written(ahead.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        if not frontier.limit(1).count():
            break
        seen = seen.unionByName(frontier)
    return seen


def trace(edges: DataFrame, starts: DataFrame, max_depth: int = 25, **names) -> DataFrame:
    """The nodes downstream of the starts with their least depth. A walk that passes no node twice reaches the same nodes
    at the same least depths as one that only goes to unseen nodes, which does not enumerate paths."""
    return walk(edges, starts, "downstream", max_depth, **names)


def neighbours(edges: DataFrame, src: str = "src", dst: str = "dst", via: str = "via") -> DataFrame:
    """node, neighbour, direction, via: both ends' view of every edge."""
    out = edges.select(F.col(src).alias("node"), F.col(dst).alias("neighbour"), F.lit("out").alias("direction"), F.col(via).alias("via"))
    return out.unionByName(edges.select(F.col(dst).alias("node"), F.col(src).alias("neighbour"), F.lit("in").alias("direction"), F.col(via).alias("via")))


def unordered(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Distinct pairs (lo, hi) of different nodes, whatever the edge's sense."""
    return edges.filter(F.col(src) != F.col(dst)).select(F.least(src, dst).alias("lo"), F.greatest(src, dst).alias("hi")).distinct()


def component_pairs(members: DataFrame, existing: DataFrame, component: str = "component", node: str = "node") -> DataFrame:
    """Pairs of nodes of one component that no edge joins yet. Components are conductors of a page and small by nature."""
    a, b = members.select(component, F.col(node).alias("lo")), members.select(component, F.col(node).alias("hi"))
    return a.join(b, component).filter("lo < hi").select("lo", "hi").distinct().join(existing, ["lo", "hi"], "left_anti")


def first_kept(items: DataFrame, pairs: DataFrame, by: list[str], key: str) -> DataFrame:
    """The items (by, key) that stay when they are looked at in order and each goes that an earlier kept one is paired with.

    pairs: by, first, second, first being the earlier. In rounds, what no earlier undecided item is paired with stays, and
    what is paired with that goes; the earliest undecided item is always decided, so this ends with what the order gives."""
    rest, open_pairs, done = written(items.select(*by, key).distinct()), written(pairs.select(*by, "first", "second").distinct()), None
    while rest.limit(1).count():
        free = written(rest.join(open_pairs.select(*by, F.col("second").alias(key)), [*by, key], "left_anti"))
        done = free if done is None else done.unionByName(free)
        hit = open_pairs.join(free.withColumnRenamed(key, "first"), [*by, "first"], "left_semi").select(*by, F.col("second").alias(key))
        rest = written(rest.join(free, [*by, key], "left_anti").join(hit, [*by, key], "left_anti"))
        for end in ("first", "second"):
            open_pairs = open_pairs.join(rest.withColumnRenamed(key, end), [*by, end], "left_semi")
        open_pairs = written(open_pairs)
    return rest if done is None else done


def _in_order(rest: DataFrame, by: list[str], left: str, right: str, order: list[str]) -> DataFrame:
    """The sequential rule itself: each group's pairs stream past in order; only its used ends are held."""
    named = rest.filter(" AND ".join(f"`{c}` IS NOT NULL" for c in [*by, left, right]))
    ends = [F.to_json(F.struct(*by)), F.to_json(F.struct(left)), F.to_json(F.struct(right))]  # hashable, of any type
    dealt = named.repartition(*by).sortWithinPartitions(*by, *order, left, right)
    dealt = dealt.select(*rest.columns, *(c.alias(f"_end{i}") for i, c in enumerate(ends)))

    def take(batches):
        import pyarrow as pa

        group, used_l, used_r = None, set(), set()
        for b in batches:
            keep = []
            for g, one, two in zip(*(b.column(f"_end{i}").to_pylist() for i in range(3)), strict=True):
                if g != group:
                    group, used_l, used_r = g, set(), set()
                keep.append(one not in used_l and two not in used_r)
                if keep[-1]:
                    used_l.add(one)
                    used_r.add(two)
            yield b.select(columns).filter(pa.array(keep, pa.bool_()))

    columns = rest.columns
    return written(dealt.mapInArrow(take, rest.schema))


def greedy_match(pairs: DataFrame, by: list[str], left: str, right: str, order: list[str], rounds: int = 8) -> DataFrame:
    """One-to-one matching, best pairs first: what taking pairs in `order` and skipping used ends gives.

    `order` with left and right must be a strict total order (smaller is better). Each round accepts the
    pairs that are first at both ends and removes their ends. What is left after `rounds` of them waits for
    one another, as equal costs do, and is taken in order, group by group."""
    rank = F.struct(*order, left, right)
    rest = written(pairs.select(*by, left, right, *order))
    done = None
    for _ in range(rounds):
        best_l = rest.groupBy(*by, left).agg(F.min(rank).alias("_l"))
        best_r = rest.groupBy(*by, right).agg(F.min(rank).alias("_r"))
        hit = written(rest.join(best_l, [*by, left]).join(best_r, [*by, right]).filter((rank == F.col("_l")) & (rank == F.col("_r"))).select(*rest.columns))
        if not hit.limit(1).count():
            return done if done is not None else rest.limit(0)
        done = hit if done is None else done.unionByName(hit)
        rest = written(rest.join(hit.select(*by, left), [*by, left], "left_anti").join(hit.select(*by, right), [*by, right], "left_anti"))
    return done.unionByName(_in_order(rest, by, left, right, order))
