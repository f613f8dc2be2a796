"""MinHash near-duplicates by an LSH forest (operator 13).

Each tree orders the documents by a signature of its own: `depth` minimum hashes of the document's shingles, one after another. In a sorted order the documents with the
longest common prefix stand next to each other, so a document's candidates are the rows around it that share at least one hash with it, at most `reach` rows away. How deep a prefix
they share depends on the region: where few documents begin alike, one hash is enough, and where many do (a hot shingle, a template), the order separates them by further hashes. Spark sorts
by ranges of (tree, signature, id), which split a region of any size.

A first pass goes over some of the trees by their first hash alone. How many others share a document's first hashes says how central it is: an original has the hashes of most
of its near copies, which have fewer of each other's. Each region compares its documents with its most central one, one pair a document, and these links already join what is much alike. A second pass
looks around each row, as far as `reach`, but only at rows of other components. Two rows are candidates if the sizes and parity bitmaps of their sets (exact bounds) and a sketch of 64 of their minimum hashes (two bits each) allow
the similarity. Candidates are pruned by each set's own larger bitmap, exactly, and confirmed on whole sets, the most promising pair of each component first. So a group of near copies
is never compared in all its pairs. Documents with equal sets count once.

Two sets of similarity s share the first d hashes of a tree with probability s^d. A row sees its partners of a tree if the whole region of some depth d is within its reach and inside its range; it misses one at 0.8
in that tree with probability 1 - 0.8^d, and in all trees with the product of these. Rows for which the product is above that of `whole` trees at depth 1 (0.2^9, 5 in 10^7; rows outside crowds have 0.2^16, 7 in 10^12) are crowded.
Both ends of a pair that may be missing are crowded, so a third pass sorts the crowded rows by themselves, in blocks with the rows around them, and looks `far` rows around each. What is still crowded then, in groups of
near copies beyond that, is compared by the exact join of operator 4 with this operator's shingles, as far as it is in different components. The sketch fails a pair at 0.8 once in a billion times (`most_apart`); it is no bound on how many
candidates a row or region has.

Edge cases: null, empty and blank texts have an empty set and are linked with nothing. Texts with fewer words than a
shingle have one token, the whole sequence. Rows that repeat a doc_id and its text are one document. Of rows that share a doc_id but not a
text, the text with the smallest hash is the document; the others are linked with nothing. A null doc_id stays null unless another document has the same set. Other columns are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, WordHashes, forget, id_and_text, mix, one_text_each, raw_texts, settle, slices
from .graphs import components
from .idfilter import KeyFilter
from .near import linked as exactly_linked
from .near import set_sizes, set_table, shingle_sets, verified

PARITY = 4  # longs of the parity bitmap that travels with the orders
LONGS = PARITY + 2  # and those of the sketch behind it
ROW = "tree int, key binary, doc_id long, root long, n int, traits binary"
PAIR = "a long, b long, depth long"
SORTED = ["tree", "key", "doc_id"]


def signatures(sets: list[np.ndarray], hashes: int) -> np.ndarray:
    """The `hashes` minimum hashes of each set (upper 32 bits), a row a set; zeros for empty sets."""
    out = np.zeros((len(sets), hashes), np.uint32)
    full = [k for k, s in enumerate(sets) if len(s)]
    if not full:
        return out
    flat = np.concatenate([sets[k] for k in full])
    begins = np.concatenate([[0], np.cumsum([len(sets[k]) for k in full])[:-1]])
    factors = mix(np.arange(1, hashes + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
    work = np.empty_like(flat)
    for at, factor in enumerate(factors):
        np.multiply(flat, factor, out=work)
        out[full, at] = np.minimum.reduceat(work, begins) >> U64(32)
    return out


def forest_table(texts: DataFrame, width: int, hashes: int) -> DataFrame:
    """Settled: doc_id, n (set size), k1, k2 (128-bit hash of the set), bits (parity bitmap of two to four times n bits, 256 at least), traits (the same in 256 bits, then the sketch), keys (minimum hashes)."""

    def run(batches):
        known = WordHashes()
        for part in (part for batch in batches for part in slices(batch)):
            sets = shingle_sets(raw_texts(part), known, width)
            keys = signatures(sets, hashes)
            digests, bits = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets], [parities(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([(h >> 64) - (1 << 63) for h in digests], pa.int64()),
                    pa.array([(h & (1 << 64) - 1) - (1 << 63) for h in digests], pa.int64()),
                    pa.array(bits, pa.binary()),
                    pa.array([folded(b, PARITY).tobytes() + s.tobytes() for b, s in zip(bits, sketches(keys), strict=True)], pa.binary()),
                    pa.array([k.tobytes() for k in keys.astype(">u4")], pa.binary()),
                ],
                ["doc_id", "n", "k1", "k2", "bits", "traits", "keys"],
            )

    return settle(texts.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, k1 long, k2 long, bits binary, traits binary, keys binary"), "forest-signatures")


def parities(tokens: np.ndarray) -> bytes:
    """How many tokens have each value of their lowest bits, modulo 2: two sets differ in at least as many tokens as their bitmaps in bits."""
    size = max(64 * PARITY, 1 << (2 * len(tokens)).bit_length())
    odd = np.bincount((tokens & U64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def sketches(keys: np.ndarray) -> np.ndarray:
    """The two lowest bits of the first 64 minimum hashes of each row, in two planes of 64 bits."""
    planes = np.zeros((len(keys), 2, 8), np.uint8)
    for bit in range(2):
        packed = np.packbits((keys[:, :64] >> np.uint32(bit) & np.uint32(1)).astype(np.uint8), axis=1)
        planes[:, bit, : packed.shape[1]] = packed
    return planes.reshape(-1, 16).view(U64)


@lru_cache
def most_apart(percent: int, hashes: int = 64, miss: float = 1e-9) -> int:
    """In how many of its places may the sketch of a similar set be another? More come about with a probability below `miss`: a minimum hash is another with probability 1 - s, and three in four of those have other bits."""
    p = 0.75 * (100 - percent) / 100
    tail, most = 0.0, hashes
    while most and (tail := tail + math.comb(hashes, most) * p**most * (1 - p) ** (hashes - most)) < miss:
        most -= 1
    return most


def folded(bits: bytes, longs: int) -> np.ndarray:
    """A parity bitmap in fewer bits: the parity of two halves' parities is that of both."""
    return np.bitwise_xor.reduce(np.frombuffer(bits, U64).reshape(-1, longs), 0)


def near_enough(pairs: DataFrame, table: DataFrame, percent: int) -> DataFrame:
    """The pairs that their bitmaps leave: |A and B| is at most half of what both sizes have beyond the bits that differ. Exact: no similar pair goes. Bitmaps have a fortieth of a set's bytes."""

    def run(batches):
        for batch in batches:
            may = []
            for na, nb, x, y in zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "xa", "xb")), strict=True):
                longs = min(len(x), len(y)) // 8
                apart = int(np.bitwise_count(folded(x, longs) ^ folded(y, longs)).sum())
                may.append((100 + percent) * (na + nb - apart) >= 2 * percent * (na + nb))
            yield batch.select(["a", "b", "hits"]).filter(pa.array(may, pa.bool_()))

    asked = KeyFilter(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "doc_id")
    table = asked.split(table.select("doc_id", "n", "bits"), "doc_id")[0]
    # a doc_id that repeats its text has a row for each repetition
    of = lambda c: table.select(F.col("doc_id").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"x{c}")).dropDuplicates([c])
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "hits", "na", "nb", "xa", "xb").mapInArrow(run, "a long, b long, hits long")


def orders(table: DataFrame, trees: int, depth: int) -> DataFrame:
    """A row (ROW) for each document and each of the first trees. table: doc_id, root, n, traits, keys (signatures of `depth` hashes, one after another)."""
    size = 4 * depth

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            flat = np.frombuffer(b"".join(batch.column("keys").to_pylist()), np.uint8).reshape(n, -1, size).transpose(1, 0, 2)
            for tree in range(trees):
                keys = pa.FixedSizeBinaryArray.from_buffers(pa.binary(size), n, [None, pa.py_buffer(np.ascontiguousarray(flat[tree]))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, tree, np.int32)), keys, *map(batch.column, ("doc_id", "root", "n", "traits"))], ["tree", "key", "doc_id", "root", "n", "traits"])

    return table.select("keys", "doc_id", "root", F.col("n").cast("int").alias("n"), "traits").mapInArrow(run, ROW)


class Stretch:
    """Consecutive rows of a sorted order."""

    def __init__(self, rows: pa.RecordBatch, depth: int):
        self.tree, self.ids, self.root, self.n = (rows.column(c).to_numpy() for c in ("tree", "doc_id", "root", "n"))
        self.n = self.n.astype(np.int64)
        self.keys = np.frombuffer(b"".join(rows.column("key").to_pylist()), ">u4").reshape(-1, depth).astype(np.uint32)
        self.traits = np.frombuffer(b"".join(rows.column("traits").to_pylist()), U64).reshape(-1, LONGS)

    def shared(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """How many hashes the keys at two places begin with alike; none in different trees."""
        return np.cumprod(self.keys[one] == self.keys[two], axis=1).sum(1) * (self.tree[one] == self.tree[two])

    def pairs(self, low: int, high: int, reach: int, percent: int) -> pa.RecordBatch:
        """Candidates (a, b, depth of the common prefix) of different roots at most `reach` rows apart; the second row is one from low to below high."""
        region = np.cumsum(np.concatenate([[True], (self.tree[1:] != self.tree[:-1]) | (self.keys[1:, 0] != self.keys[:-1, 0])]))
        at, found = np.arange(max(0, low - reach), high), [(np.empty(0, np.int64),) * 3]
        for step in range(1, reach + 1):
            at = at[: np.searchsorted(at, high - step)]
            at = at[region[at] == region[at + step]]
            if not len(at):
                break
            some = at[np.searchsorted(at, low - step) :]
            some = some[self.root[some] != self.root[some + step]]
            some = some[alike(self.n, self.traits, some, some + step, percent)]
            a, b = self.ids[some], self.ids[some + step]
            found.append((np.minimum(a, b), np.maximum(a, b), self.shared(some, some + step)))
        return triples(*map(np.concatenate, zip(*found, strict=True)))

    def unseen(self, low: int, high: int, reach: int, percent: int) -> pa.RecordBatch:
        """(a, null, what it lacks) of the rows from low to below high whose region isn't whole within their reach: the logarithm of how much more probable it is that this tree misses a partner than with a whole region, in millionths.
        A region that goes on to the first or last row may go on beyond it."""
        at = np.arange(low, high)
        depth = self.keys.shape[1]
        more = np.maximum(self.shared(at, np.maximum(at - reach - 1, 0)), self.shared(at, np.minimum(at + reach + 1, len(self.ids) - 1)))  # so deep is the last region that isn't whole
        lack = np.array([*(lacking(d + 1, percent) for d in range(depth)), lacking(None, percent)])[more]
        ids = self.ids[low:high][more > 0]
        return triples(ids, pa.nulls(len(ids), pa.int64()), lack[more > 0])


def lacking(depth: int | None, percent: int) -> int:
    """Millionths of the logarithm of: the probability that a tree misses a similar partner, if the region of this depth is whole (None: not even the deepest), over that at depth 1."""
    s = min(percent / 100, 0.999999)
    return round(1e6 * (math.log1p(-(s**depth) if depth else 0) - math.log1p(-s)))


def triples(a, b, depth) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, depth)], ["a", "b", "depth"])


def neighbours(depth: int, reach: int, percent: int):
    """A task over a range of sorted rows: candidates (a, b, depth of the common prefix) and (a, null, what it lacks) of rows that may have partners in this tree which they haven't met."""
    far = reach + 1

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            old = 0 if held is None else held.num_rows
            held = batch if held is None else pa.concat_batches([held, batch])
            rows = Stretch(held, depth)
            yield rows.pairs(old, held.num_rows, reach, percent)
            yield rows.unseen(max(0, old - far), max(0, held.num_rows - far), reach, percent)
            held = held.slice(max(0, held.num_rows - 2 * far))
        if held is not None:
            yield Stretch(held, depth).unseen(max(0, held.num_rows - far), held.num_rows, reach, percent)

    return run


def in_blocks(depth: int, reach: int, percent: int):
    """The same over whole blocks of `overlapping`; a pair is found in the block of its second row."""

    def run(batches):
        held = None
        for batch in batches:
            held = batch if held is None else pa.concat_batches([held, batch])
            while held.num_rows and (end := int(np.searchsorted(block := held.column("block").to_numpy(), block[0], "right"))) < held.num_rows:
                yield from of(held.slice(0, end))
                held = held.slice(end)
        if held is not None and held.num_rows:
            yield from of(held)

    def of(block):
        home = np.flatnonzero(block.column("home"))
        if len(home):
            rows, ends = Stretch(block, depth), (int(home[0]), int(home[-1]) + 1)
            yield rows.pairs(*ends, reach, percent)
            yield rows.unseen(*ends, reach, percent)

    return run


def overlapping(rows: DataFrame, reach: int, n_rows: int) -> tuple[DataFrame, DataFrame]:
    """(block, home and rows (ROW), sorted in tasks; a table to forget). Blocks are of reach + 1 consecutive rows of the whole order (home), with as many before and after them, so no range ends inside a region."""
    ranged = settle(dealt(rows, SORTED, n_rows).withColumn("part", F.spark_partition_id()), "forest-ranges")
    counts = ranged.groupBy("part").agg(F.count("*").alias("own"))
    before = counts.select("part", (F.sum("own").over(Window.orderBy("part")) - F.col("own")).alias("before"))  # one row a range
    own = F.row_number().over(Window.partitionBy("part").orderBy(*SORTED))
    placed = ranged.withColumn("own", own).join(F.broadcast(before), "part").withColumn("at", F.col("own") - 1 + F.col("before")).drop("own", "part", "before")
    far, block = reach + 1, F.floor(F.col("at") / (reach + 1))
    blocks = placed.withColumn("block", F.explode(F.array(block - 1, block, block + 1))).withColumn("home", F.col("block") == F.floor(F.col("at") / far))
    return blocks.repartition("block").sortWithinPartitions("block", "at").select("block", "home", "tree", "key", "doc_id", "root", "n", "traits"), ranged


def sizes(batches):
    """A task over a range of rows sorted by tree and first hash: doc_id and the logarithm of its region's size."""

    def sent(ids, region):
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.log2(np.bincount(region)[region]))], ["doc_id", "weight"])

    held = None
    for batch in batches:
        held = batch if held is None else pa.concat_batches([held, batch])
        if not held.num_rows:
            continue
        tree, keys = held.column("tree").to_numpy(), np.frombuffer(b"".join(held.column("key").to_pylist()), ">u4")
        region = np.cumsum(np.concatenate([[0], (tree[1:] != tree[:-1]) | (keys[1:] != keys[:-1])]))
        done = int(np.searchsorted(region, region[-1]))  # the last region may go on
        if done:
            yield sent(held.column("doc_id").to_numpy()[:done], region[:done])
        held = held.slice(done)
    if held is not None and held.num_rows:
        yield sent(held.column("doc_id").to_numpy(), np.zeros(held.num_rows, np.int64))


def against_first(percent: int):
    """A task over a range of rows sorted by tree, first hash and centrality: candidates (a, b, 1) of each row and the first of its region."""

    def run(batches):
        first = None
        for batch in batches:
            if not batch.num_rows:
                continue
            held = batch if first is None else pa.concat_batches([first, batch])
            tree, ids, n = held.column("tree").to_numpy(), held.column("doc_id").to_numpy(), held.column("n").to_numpy().astype(np.int64)
            keys, traits = np.frombuffer(b"".join(held.column("key").to_pylist()), ">u4"), np.frombuffer(b"".join(held.column("traits").to_pylist()), U64).reshape(-1, LONGS)
            begins = np.concatenate([[True], (tree[1:] != tree[:-1]) | (keys[1:] != keys[:-1])])
            to = np.maximum.accumulate(np.where(begins, np.arange(len(ids)), 0))
            some = np.flatnonzero(ids != ids[to])
            some, last = some[alike(n, traits, some, to[some], percent)], int(to[-1])
            a, b = ids[some], ids[to[some]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(np.ones(len(a), np.int64))], ["a", "b", "depth"])
            first = held.slice(last, 1)

    return run


def alike(n: np.ndarray, traits: np.ndarray, one: np.ndarray, two: np.ndarray, percent: int) -> np.ndarray:
    """Which of the sets at two places may be similar? By their sizes and parity bitmaps, exactly (no similar pair fails), and by their sketches."""
    kept = np.flatnonzero(100 * np.minimum(n[one], n[two]) >= percent * np.maximum(n[one], n[two]))
    x, y = traits[one[kept], PARITY:], traits[two[kept], PARITY:]
    kept = kept[np.bitwise_count((x[:, 0] ^ y[:, 0]) | (x[:, 1] ^ y[:, 1])) <= most_apart(percent)]
    both = n[one[kept]] + n[two[kept]]
    apart = np.bitwise_count(traits[one[kept], :PARITY] ^ traits[two[kept], :PARITY]).sum(1, dtype=np.int64)
    return kept[(100 + percent) * (both - apart) >= 2 * percent * both]


def dealt(rows: DataFrame, order: list[str], n_rows: int) -> DataFrame:
    """Rows sorted in ranges of some ten thousand at least."""
    parts = max(1, min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_rows // 10_000))
    return rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)


def central_pairs(own: DataFrame, trees: int, depth: int, percent: int, n_docs: int) -> DataFrame:
    """Settled: a, b and hits (trees), of each document and the most central one of each of its regions."""
    heads = F.concat(*[F.substring("keys", 4 * depth * t + 1, 4) for t in range(trees)])  # each tree's first hash
    flat = own.select("doc_id", "n", "traits", heads.alias("keys"))
    bare = orders(flat.select("doc_id", "n", "keys", F.lit(0).cast("long").alias("root"), F.lit(b"").alias("traits")), trees, 1)
    weights = dealt(bare, SORTED, trees * n_docs).mapInArrow(sizes, "doc_id long, weight double")
    weights = settle(weights.groupBy("doc_id").agg((-1000 * F.sum("weight")).cast("long").alias("root")), "forest-weights")
    ranked = orders(flat.join(weights, "doc_id"), trees, 1)
    found = dealt(ranked, ["tree", "key", "root", "doc_id"], trees * n_docs).mapInArrow(against_first(percent), PAIR)
    out = settle(found.groupBy("a", "b").agg(F.sum("depth").alias("hits")).filter("hits > 1"), "forest-candidates")
    forget(weights)
    return out


def candidates(met: DataFrame, lack: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(a, b and hits, the depths of their common prefixes over all trees; doc_id of rows that lack more than `lack` in all; the table of both). Settled."""
    found = settle(met.groupBy("a", "b").agg(F.sum("depth").alias("hits")), "forest-neighbours")
    crowded = settle(found.filter((F.col("b").isNull()) & (F.col("hits") > lack)).select(F.col("a").alias("doc_id")), "forest-crowded")
    return found.filter("b is not null"), crowded, found


def rooted(pairs: DataFrame, root: DataFrame | None) -> DataFrame:
    """The pairs between different components, with ra and rb, the roots of a and b."""
    if root is None:
        return pairs.withColumn("ra", F.col("a")).withColumn("rb", F.col("b"))
    up = lambda c: root.select(F.col("doc_id").alias(c), F.col("root").alias(f"up_{c}"))
    lifted = pairs.join(up("a"), "a", "left").join(up("b"), "b", "left")
    return lifted.select("a", "b", "hits", F.coalesce("up_a", "a").alias("ra"), F.coalesce("up_b", "b").alias("rb")).filter("ra <> rb")


def joined(root: DataFrame | None, links: DataFrame) -> DataFrame:
    """Settled: doc_id and root, after links (ra, rb) between roots."""
    higher = components(links.select(F.col("ra").alias("a"), F.col("rb").alias("b"))).select(F.col("node").alias("old"), F.col("component").alias("root"))
    if root is None:
        return settle(higher.select(F.col("old").alias("doc_id"), "root"), "forest-roots")
    known = root.select("doc_id", F.col("root").alias("old"))
    alone = higher.select(F.col("old").alias("doc_id"), "old").join(known.select("doc_id"), "doc_id", "left_anti")  # linked for the first time
    return settle(known.unionByName(alone).join(higher, "old", "left").select("doc_id", F.coalesce("root", "old").alias("root")), "forest-roots")


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int, rounds: int, to_the_end: bool, root: DataFrame | None) -> DataFrame | None:
    """The roots after the links among the pairs (a, b, hits): rounds test the most promising pair of each component, and at last, if wanted, all pairs that are still between components."""
    tested: list[DataFrame] = []
    active = settle(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "forest-active")
    sets = set_table(texts, active, width)
    for turn in range(rounds + to_the_end):
        left = rooted(pairs, root)
        for t in tested:
            left = left.join(t.select("a", "b"), ["a", "b"], "left_anti")
        if turn < rounds:
            ends = left.select(F.explode(F.array("ra", "rb")).alias("r"), F.struct("hits", F.xxhash64("a", "b").alias("h"), "a", "b", "ra", "rb").alias("p"))
            left = ends.groupBy("r").agg(F.max("p").alias("p")).select("p.a", "p.b", "p.ra", "p.rb").distinct()
        now = settle(left.select("a", "b", "ra", "rb"), "forest-pairs")
        tested.append(now)
        if now.isEmpty():
            break
        asked = now.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        links = verified(now, KeyFilter(asked, "doc_id").split(sets, "doc_id")[0], percent, "forest-links")
        if not links.isEmpty():
            before, root = root, joined(root, links.join(now, ["a", "b"]))
            if before is not None:
                forget(before)
        forget(links)
    forget(active, sets, *tested)
    return root


def several_roots(some: DataFrame, root: DataFrame | None) -> bool:
    """Are the documents in more than one component?"""
    roots = some if root is None else some.join(root, "doc_id", "left").select(F.coalesce("root", "doc_id").alias("doc_id"))
    low = roots.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    return low["low"] != low["high"]


def with_roots(rows: DataFrame, root: DataFrame | None) -> DataFrame:
    """Rows with the root of their doc_id; only documents that are linked are shuffled."""
    if root is None:
        return rows.withColumn("root", F.col("doc_id"))
    in_root, alone = KeyFilter(root, "doc_id").split(rows, "doc_id")
    return alone.withColumn("root", F.col("doc_id")).unionByName(in_root.join(root, "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id")))


def linked(texts: DataFrame, width: int = 2, percent: int = 80, trees: int = 16, depth: int = 4, reach: int = 256, whole: int = 9, first_trees: int = 8, far: int = 4096, rounds: int = 2) -> DataFrame:
    """doc_id, n_shingles, component_id of texts whose doc_ids have one text each."""
    table = forest_table(texts, width, trees * depth)
    classes = table.filter("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"))
    members = settle(table.select("doc_id", "n", "k1", "k2").join(classes, ["k1", "k2"], "left").select("doc_id", "n", F.when(F.col("n") > 0, F.col("rep")).otherwise(F.col("doc_id")).alias("rep")), "forest-members")
    others = settle(members.filter("n > 0 and (doc_id is null or doc_id <> rep)").select("doc_id").distinct(), "forest-copies")
    columns = ["doc_id", "n", "bits", "traits", "keys"]
    maybe, sure = KeyFilter(others, "doc_id").split(table.filter("n > 0 and doc_id is not null").select(*columns), "doc_id")
    own = sure.unionByName(maybe.join(others.hint("shuffle_hash"), "doc_id", "left_anti").select(*columns))
    n_docs = members.count()

    found = central_pairs(own, min(first_trees, trees), depth, percent, n_docs)
    pairs = settle(near_enough(found, own, percent), "forest-near")
    root = confirmed(pairs, texts, width, percent, rounds, False, None)
    forget(found, pairs)
    lack = (trees - whole) * lacking(None, percent)
    met = dealt(orders(with_roots(own, root), trees, depth), SORTED, trees * n_docs).mapInArrow(neighbours(depth, reach, percent), PAIR)
    found, crowded, both = candidates(met, lack)
    pairs = settle(near_enough(found, own, percent), "forest-near")
    root = confirmed(pairs, texts, width, percent, rounds, True, root)
    forget(pairs)
    if far > reach and several_roots(crowded, root):
        of = settle(KeyFilter(crowded, "doc_id").split(own.select("doc_id", "n", "traits", "keys"), "doc_id")[0].join(crowded.hint("shuffle_hash"), "doc_id", "left_semi").dropDuplicates(["doc_id"]), "forest-crowd")
        blocks, ranged = overlapping(orders(with_roots(of, root), trees, depth), far, trees * crowded.count())
        more, still, rest = candidates(blocks.mapInArrow(in_blocks(depth, far, percent), PAIR), lack)
        fresh = settle(more.join(found, ["a", "b"], "left_anti"), "forest-candidates")
        pairs = settle(near_enough(fresh, own, percent), "forest-near")
        root = confirmed(pairs, texts, width, percent, rounds, True, root)
        forget(of, ranged, rest, fresh, pairs, crowded)
        crowded = still
    forget(both)
    if several_roots(crowded, root):
        crowd = KeyFilter(crowded, "doc_id").split(texts, "doc_id")[0].join(crowded.hint("shuffle_hash"), "doc_id", "left_semi")
        bits = min(27, max(22, (crowded.count() << 9).bit_length() + 4))  # its sketches only prune: a small crowd needs small ones
        links = exactly_linked(crowd, width, percent, sketch_bits=bits, known=root).filter("doc_id <> component_id").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"), F.lit(0).alias("hits"))
        between = settle(rooted(links, root), "forest-links")
        if not between.isEmpty():
            root = joined(root, between)
        forget(between)
    forget(table, others, crowded)
    found = members.select("doc_id", F.col("n").alias("n_shingles"), F.col("rep").alias("component_id"))
    if root is not None:
        found = members.join(root.select(F.col("doc_id").alias("rep"), "root"), "rep", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "rep").alias("component_id"))
    return found


def near_duplicates(docs: DataFrame, width: int = 2, percent: int = 80, **options) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (is it its component's smallest id?): one row a row of docs."""
    known, aside = one_text_each(id_and_text(docs))
    found = linked(known, width, percent, **options)
    for rest in aside:
        found = found.unionByName(set_sizes(rest, width))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
