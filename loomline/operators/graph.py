"""Graphs of nodes and edges: ranking, reachability, cycles, components, replayed trees.

Iterations are Spark jobs; the driver sees one number a step. Lineage is cut by reliable checkpoints in the folder of spark.checkpoint.dir.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, from spark.checkpoint.dir. Where the session names none, one is made on a single machine; on a cluster that is an error, since
    executors don't see the driver's folders."""
    if spark.sparkContext.getCheckpointDir() is None:
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(at or tempfile.mkdtemp(prefix="loomline-"))
    return spark.sparkContext.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def number_rows(rows: DataFrame, order: Sequence[str | Column], name: str, start: int = 1) -> DataFrame:
    """Rows numbered from `start` in the given order, by range partitions: each numbers its own, after the counts of those before it."""
    ranged = settled(rows.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))  # settled, so that counts and numbers see the same ranges
    counts = ranged.groupBy("__p").agg(F.count("*").alias("__c"))
    before = counts.withColumn("__before", F.sum("__c").over(Window.orderBy("__p")) - F.col("__c")).drop("__c")  # one row a partition
    own = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    return ranged.withColumn("__n", own).join(before, "__p").withColumn(name, F.col("__n") + F.col("__before") + (start - 1)).drop("__p", "__n", "__before")


def build_edges(nodes: DataFrame, refs: DataFrame) -> DataFrame:
    """Distinct edges from references by name: a candidate in the same file first, else the first one; no self edges. Only the first candidate of a name, and of a name in a file, can be
    taken, so a reference meets two rows, however many nodes share its name.
    nodes: id, name, file; refs: src, name, file."""
    near = nodes.groupBy("name", "file").agg(F.min("id").alias("near"))
    any_ = near.groupBy("name").agg(F.min("near").alias("any"))
    best = refs.select("src", "name", "file").join(near, ["name", "file"], "left").groupBy("src", "name").agg(F.min("near").alias("near")).join(any_, "name")
    return best.select("src", F.coalesce("near", "any").alias("dst")).filter("src <> dst").distinct()


def parts_for(spark: SparkSession, rows: int, most: int = 1_000_000) -> int:
    """A number of partitions that grows with the rows, so that no task's sort or table does: the session's own at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // most))


def distinct_edges(edges: DataFrame, most: int = 1_000_000) -> DataFrame:
    """Each edge (src, dst) once; a task holds about `most` of the edges given."""
    return edges.select("src", "dst").repartition(parts_for(edges.sparkSession, edges.count(), most), "src", "dst").distinct()


def pagerank(nodes: DataFrame, edges: DataFrame, focal: DataFrame | None = None, damping: float = 0.85, tol: float = 1e-5, max_steps: int = 100, fixed_steps: int | None = None, most: int = 1_000_000) -> DataFrame:
    """id and rank. A task sorts about `most` edges, whatever their number. What dangling nodes hold goes to the personalisation vector (uniform without matching focal nodes). Raises if max_steps don't converge;
    fixed_steps runs so many steps and doesn't test."""
    base = nodes.select("id").distinct()
    marks = base.join(focal.select("id").distinct().withColumn("f", F.lit(1.0)), "id", "left").fillna(0.0, ["f"]) if focal is not None else base.withColumn("f", F.lit(0.0))
    total, hits = marks.agg(F.count("*"), F.sum("f")).first()
    p = settled(marks.select("id", (F.col("f") / hits if hits else F.lit(1.0 / max(1, total))).alias("p")))
    out = settled(edges.select("src", "dst"))
    degree = out.groupBy("src").agg(F.count("*").alias("deg"))
    out = out.repartition(parts_for(out.sparkSession, out.count(), most), "src")
    state = settled(p.join(degree.withColumnRenamed("src", "id"), "id", "left").select("id", "p", "deg", F.col("p").alias("rank")))
    for step in range(1, (fixed_steps or max_steps) + 1):
        flow = state.join(out.select(F.col("src").alias("id"), "dst"), "id").groupBy("dst").agg(F.sum(F.col("rank") / F.col("deg")).alias("inflow"))
        lost = state.agg(F.coalesce(F.sum(F.when(F.col("deg").isNull(), F.col("rank"))), F.lit(0.0)).alias("lost"))
        new = state.join(flow.withColumnRenamed("dst", "id"), "id", "left").crossJoin(F.broadcast(lost))  # one number for all rows
        new = new.select("id", "p", "deg", F.col("rank").alias("was"), ((1 - damping) * F.col("p") + damping * (F.coalesce("inflow", F.lit(0.0)) + F.col("lost") * F.col("p"))).alias("rank"))
        new = settled(new)
        state = new.drop("was")
        if fixed_steps is None and new.agg(F.sum(F.abs(F.col("rank") - F.col("was")))).first()[0] < tol:
            return state.select("id", "rank")
    if fixed_steps is None:
        raise RuntimeError(f"no convergence in {max_steps} steps")
    return state.select("id", "rank")


def hub_outliers(edges: DataFrame, sigmas: float = 3.0) -> DataFrame:
    """Nodes whose degree exceeds mean + sigmas population deviations; none for fewer than 3 nodes or hardly any deviation."""
    deg = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    s = deg.agg(F.avg("degree").alias("m"), F.stddev_pop("degree").alias("d"), F.count("*").alias("n"))
    return deg.crossJoin(F.broadcast(s)).filter((F.col("n") >= 3) & (F.col("d") > 1e-6) & (F.col("degree") > F.col("m") + sigmas * F.col("d"))).select("id", "degree")


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.select("id").join(edges.select(F.explode(F.array("src", "dst")).alias("id")), "id", "left_anti")


def mutual_pairs(edges: DataFrame) -> DataFrame:
    """Two-cycles, once a pair with src < dst."""
    e = edges.select("src", "dst").distinct()
    return e.filter("src < dst").join(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_semi")


def blast_radius(edges: DataFrame, seeds: DataFrame, ignore: Sequence[str] = ("DEFINES",)) -> DataFrame:
    """seed and id of every transitive predecessor, the seed left out. edges: src, dst, kind; seeds: id. One job a level, whatever the shape of the graph."""
    e = edges.filter(~F.col("kind").isin(*ignore)).select("src", "dst").distinct()
    seen = front = settled(seeds.select(F.col("id").alias("seed"), "id").distinct())
    while True:
        front = settled(front.join(e, front["id"] == e["dst"]).select("seed", F.col("src").alias("id")).distinct().join(seen, ["seed", "id"], "left_anti"))
        if front.isEmpty():
            return seen.filter("seed <> id")
        seen = settled(seen.unionByName(front))


def cyclic_core(edges: DataFrame) -> DataFrame:
    """Edges left after nodes without predecessors or successors are peeled off, again and again; none are left iff there is no cycle."""
    e = settled(edges.select("src", "dst").distinct())
    n = e.count()
    while n:
        e = settled(e.join(e.select(F.col("dst").alias("src")), "src", "left_semi").join(e.select(F.col("src").alias("dst")), "dst", "left_semi").select("src", "dst"))
        left = e.count()
        if left == n:
            break
        n = left
    return e


def has_cycle(edges: DataFrame) -> bool:
    return not cyclic_core(edges).isEmpty()


def _spread(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels (node, label) after every node has taken the smallest label that reaches it along edges (src, dst)."""
    while True:
        came = edges.join(labels.select(F.col("node").alias("src"), "label"), "src").groupBy("dst").agg(F.min("label").alias("came"))
        moved = settled(labels.join(came, labels["node"] == came["dst"], "left").select("node", F.col("label").alias("was"), F.least("label", F.coalesce("came", "label")).alias("label")))
        labels = moved.drop("was")
        if moved.filter("was <> label").isEmpty():
            return labels


def strong_components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) of every node on a cycle of two nodes or more.

    Forward-backward colouring: what can lie on no cycle is peeled off; each node takes the smallest node that reaches it as its colour; those of a colour that reach the node it is named after are a
    component. What is left goes into the next round, in which only edges inside a colour count; each round finds a component of every colour."""
    left, found = edges.filter("src <> dst").select("src", "dst").distinct(), None
    while True:
        left = cyclic_core(left)
        if left.isEmpty():
            break
        nodes = left.select(F.col("src").alias("node")).unionByName(left.select(F.col("dst").alias("node"))).distinct()
        colours = _spread(settled(nodes.withColumn("label", F.col("node"))), left)
        colour = lambda c: colours.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label"))  # noqa: E731, B023
        inner = settled(left.join(colour("src"), "src").join(colour("dst"), "dst").filter("src_label = dst_label").select("src", "dst"))
        front = reach = settled(colours.filter("node = label"))
        while not front.isEmpty():
            back = inner.join(front.select(F.col("node").alias("dst"), "label"), "dst").select(F.col("src").alias("node"), "label").distinct()
            front = settled(back.join(reach.select("node"), "node", "left_anti"))
            reach = settled(reach.unionByName(front))
        found = reach if found is None else found.unionByName(reach)
        gone = reach.select("node")
        left = settled(inner.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))
    if found is None:
        return edges.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    # the node that names a colour alone is no cycle of two
    named = found.select("node", F.col("label").alias("component"))
    return named.join(named.groupBy("component").agg(F.count("*").alias("n")).filter("n > 1").select("component"), "component").select("node", "component")


def cycles(edges: DataFrame, max_len: int | None = 4) -> DataFrame:
    """Elementary cycles of up to max_len nodes as arrays that begin with the smallest node. None: of any length; a dense component has exponentially many.

    Paths are extended inside the cyclic core, for cycles of more than four nodes inside strongly connected components, and never back to a node that is smaller than their first."""
    loops = edges.filter("src = dst").select(F.array("src").alias("cycle")).distinct()
    if max_len is not None and max_len <= 4:
        e, largest = cyclic_core(edges.filter("src <> dst")), max_len
    else:
        named = settled(strong_components(edges))
        largest = named.groupBy("component").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        of = lambda c: named.select(F.col("node").alias(c), F.col("component").alias(f"{c}_in"))
        e = settled(edges.select("src", "dst").distinct().join(of("src"), "src").join(of("dst"), "dst").filter("src_in = dst_in and src <> dst").select("src", "dst"))
    paths, longest = settled(e.filter("src < dst").select(F.array("src", "dst").alias("path"))), largest if max_len is None else min(max_len, largest)
    for n in range(2, longest + 1):
        tail = F.element_at("path", -1)
        closing = paths.join(e, (tail == e["src"]) & (F.element_at("path", 1) == e["dst"])).select(F.col("path").alias("cycle"))
        loops = loops.unionByName(closing)
        if n == longest:
            break
        paths = settled(paths.join(e, tail == e["src"]).filter((F.col("dst") > F.element_at("path", 1)) & ~F.array_contains("path", F.col("dst"))).select(F.array_append("path", F.col("dst")).alias("path")))
        if paths.isEmpty():
            break
    return loops


def witness_cycles(edges: DataFrame) -> DataFrame:
    """component and cycle: a shortest cycle through the smallest node of each strongly connected component, as an array that begins and ends with it. One breadth-first search for all components at once, so dense ones cost no more."""
    named = settled(strong_components(edges))
    of = lambda c: named.select(F.col("node").alias(c), F.col("component").alias(f"{c}_in"))
    e = settled(edges.filter("src <> dst").select("src", "dst").distinct().join(of("src"), "src").join(of("dst"), "dst").filter("src_in = dst_in").select("src", "dst", F.col("src_in").alias("component")))
    front = settled(named.filter("node = component").select("node", F.array("node").alias("path")))
    seen, done = settled(front.select("node")), None
    while not front.isEmpty():
        steps = settled(front.join(e, front["node"] == e["src"]).select("component", F.col("dst").alias("node"), F.array_append("path", F.col("dst")).alias("path")))
        closed = settled(steps.filter("node = component").groupBy("component").agg(F.min("path").alias("cycle")))
        done = closed if done is None else done.unionByName(closed.join(done, "component", "left_anti"))
        # components that have their cycle go no further
        open_ = steps.join(done.select("component"), "component", "left_anti").groupBy("component", "node").agg(F.min("path").alias("path"))
        front = settled(open_.join(seen, "node", "left_anti").select("node", "path"))
        seen = settled(seen.unionByName(front.select("node")))
    return done if done is not None else named.select("component", F.array("node").alias("cycle")).limit(0)


def unreferenced(nodes: DataFrame, edges: DataFrame, kinds: Sequence[str] = ("CALLS", "INHERITS"), exempt: str = r"^(main|__\w+__|test_.*)$") -> DataFrame:
    """Nodes that nothing calls or inherits from, exempt names aside. nodes: id, name."""
    return nodes.filter(~F.col("name").rlike(exempt)).join(edges.filter(F.col("kind").isin(*kinds)).select(F.col("dst").alias("id")), "id", "left_anti")


def _labelled(rows: DataFrame, group: str) -> DataFrame:
    """group and member with the smallest member that a chain of shared things leads to. rows: distinct (group, member, shared)."""
    labels = settled(rows.select(group, "member").distinct().withColumn("label", F.col("member")))
    while True:
        low = rows.join(labels, [group, "member"]).groupBy(group, "shared").agg(F.min("label").alias("low"))
        new = rows.join(low, [group, "shared"]).groupBy(group, "member").agg(F.min("low").alias("low"))
        lower = labels.join(new, [group, "member"], "left").select(group, "member", F.col("label").alias("was"), F.least("label", F.coalesce("low", "label")).alias("label"))
        jump = labels.select(group, F.col("member").alias("label"), F.col("label").alias("further"))
        moved = settled(lower.join(jump, [group, "label"], "left").select(group, "member", "was", F.least("label", F.coalesce("further", "label")).alias("label")))
        labels = moved.drop("was")
        if moved.filter("was <> label").isEmpty():
            return labels


def components(pairs: DataFrame, group: str) -> DataFrame:
    """Clusters of each group (member, shared): members joined by a shared thing. Groups of one member have 1.

    A cluster has a shared thing (or is one member without any), and only a member with two or more joins things. So things are counted, and the search runs over such members alone: what they touch
    counts by cluster instead of by thing. It takes the smallest label over the bipartite graph to a fixed point; a round takes the smallest label over the shared things, then the label's own label, so
    long chains close in logarithmically many rounds."""
    pairs = pairs.select(group, "member", "shared")
    ends = pairs.groupBy(group, "member").agg(F.min("shared").alias("low"), F.max("shared").alias("high"))
    joining = settled(pairs.join(ends.filter("low < high").select(group, "member"), [group, "member"], "left_semi").filter("shared is not null").distinct())
    found = joining.groupBy(group).agg(F.countDistinct("shared").alias("touched")).join(_labelled(joining, group).groupBy(group).agg(F.countDistinct("label").alias("joined")), group)
    things = pairs.filter("member is not null").select(group, "shared").distinct().groupBy(group).agg(F.count("shared").alias("things"))
    alone = ends.filter("low is null and member is not null").groupBy(group).agg(F.count("*").alias("alone"))
    count = F.col("things") + F.coalesce("alone", F.lit(0)) - F.coalesce("touched", F.lit(0)) + F.coalesce("joined", F.lit(0))
    return things.join(alone, group, "left").join(found, group, "left").select(group, count.alias("clusters"))


def materialise(ops: DataFrame, key: str) -> DataFrame:
    """Trees from change logs: key, node, parent, deleted, rejected. The first insert of a node wins, a delete is a tombstone, moves apply in order of (lamport, agent, node, parent);
    one that would make a cycle is rejected; repeats are ignored. `place` numbers siblings by (pos, node) where ops have a pos, else by node; `absent` says that a node was last put
    under a parent that no insert made, so it stands at the root. ops: key, op (insert, delete, move), node, parent, lamport, agent and, if wanted, pos. One replay a tree, since each move
    depends on those before: Spark sorts each partition by tree, inserts first, and a task goes through its rows once, so it holds the nodes of one tree and no tree costs a call of its own."""
    with_pos = "pos" in ops.columns
    given = ops.select(F.col(key).alias("key"), "op", "node", "parent", "lamport", "agent", (F.col("pos") if with_pos else F.lit("")).alias("pos"))
    rows = given.repartition("key").sortWithinPartitions("key", ~F.col("op").eqNullSafe("insert"), *[F.col(c).asc_nulls_last() for c in ("lamport", "agent", "node", "parent", "op", "pos")])

    def built(k, tree):
        parent, pos, dead, bad, lost = tree["parent"], tree["pos"], tree["dead"], tree["bad"], tree["lost"]
        seen: dict[str, int] = {}
        place: dict[str, int] = {}
        for n in sorted(parent, key=lambda n: (parent[n], pos[n], n)):
            place[n] = seen[parent[n]] = seen.get(parent[n], 0) + 1
        return [(k, n, p, n in dead, bad.get(n, 0), place[n], n in lost) for n, p in sorted(parent.items())]

    def rooted(tree):
        """All inserts are in: a parent that none made is the root."""
        parent = tree["parent"]
        tree["lost"] = {n for n, p in parent.items() if p and p not in parent}
        tree["parent"] = {n: p if p in parent else "" for n, p in parent.items()}
        tree["rooted"] = True

    def apply(tree, op, node, at, pos):
        parent, lost = tree["parent"], tree["lost"]
        if node not in parent:
            return
        if op == "delete":
            tree["dead"].add(node)
            return
        up, steps = at, 0
        while up in parent and up != node and steps <= len(parent):
            up, steps = parent[up], steps + 1
        if up == node:
            tree["bad"][node] = tree["bad"].get(node, 0) + 1
        else:
            (lost.add if at and at not in parent else lost.discard)(node)
            parent[node] = at if at in parent else ""
            tree["pos"][node] = pos or ""

    def replay(batches):
        last, tree, out, kind = None, None, [], None
        names = ["key", "node", "parent", "deleted", "rejected", "place", "absent"]
        types = [pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.bool_()]

        def flushed():
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), [kind, *types], strict=True)], names)

        for batch in batches:
            kind = batch.column(0).type
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row == last:
                    continue
                k, op, node, parent, _, _, pos = row
                if tree is None or k != last[0] and (k == k or last[0] == last[0]):
                    if tree is not None:
                        if not tree["rooted"]:
                            rooted(tree)
                        out += built(last[0], tree)
                    tree = {"parent": {}, "pos": {}, "dead": set(), "bad": {}, "lost": set(), "rooted": False}
                last = row
                if op == "insert":
                    if node not in tree["parent"]:
                        tree["parent"][node], tree["pos"][node] = parent, pos or ""
                    continue
                if not tree["rooted"]:
                    rooted(tree)
                apply(tree, op, node, parent, pos)
            if len(out) >= 10_000:
                yield flushed()
                out = []
        if tree is not None:
            if not tree["rooted"]:
                rooted(tree)
            out += built(last[0], tree)
        if out:
            yield flushed()

    kind = ops.schema[key].dataType.simpleString()
    return rows.mapInArrow(replay, f"key {kind}, node string, parent string, deleted boolean, rejected int, place int, absent boolean").withColumnRenamed("key", key)
