"""N-gram Jaccard join by token-combination prefixes (operator 4).

A document's tokens are its distinct word shingles, ordered rarest first by fixed-size counts over all documents.
A prefix is extended until any partner must share, in some class of tokens, as many prefix tokens as the class asks for: one for rare
tokens, a combination of two for frequent ones, which are split into hashed classes so that combinations stay few.
Rare tokens and combinations are indexed; documents that share an index entry are candidates and are verified on
their whole sets. Documents with equal sets count once. Links are needed only between different components: each
entry first compares its documents with one pivot, over a few rounds with other pivots, and then every pair that is
still in different components, so a group of copies never becomes all its pairs and no link between components is lost.

Edge cases: null, empty and blank texts have an empty set and are linked with nothing. Texts with fewer words than a
shingle have one token, the whole sequence. Rows that repeat a doc_id and its text are one document. Of rows that share a doc_id but not a
text, the text with the smallest hash is the document; the others are linked with nothing. A null doc_id stays null unless another document has the same set.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, WordHashes, bound_batches, forget, id_and_text, mix, named, one_text_each, raw_texts, rolling, settle, slices, tidy
from .graphs import components
from .idfilter import KeyFilter
from .windows import BASE_1, BASE_2


BITMAP = tuple(f"b{i}" for i in range(8))
TRAITS = ("n", "own", *BITMAP)


def shingle_sets(texts: list[bytes], hashes: WordHashes, width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; A-Z count as a-z."""
    words, offsets = hashes.of_texts([t.lower() for t in texts])
    every, out = mix(rolling(words, width, BASE_1) + U64(width)), []
    for at, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        own = min(width, end - at)
        out.append(np.unique(every[at : end - width + 1] if own == width else mix(rolling(words[at:end], own, BASE_1) + U64(own))) if own else words[:0])
    return out


def pack_places(places: np.ndarray) -> bytes:
    """Sorted places as byte gaps: 255 only advances, a smaller byte advances and marks a place."""
    gaps = np.diff(places, prepend=0)
    skips = gaps // 255
    out = np.full(int(skips.sum()) + len(gaps), 255, np.uint8)
    out[np.cumsum(skips + 1) - 1] = gaps - 255 * skips
    return out.tobytes()


def unpack_places(packed: bytes) -> np.ndarray:
    gaps = np.frombuffer(packed, np.uint8)
    return np.cumsum(gaps, dtype=np.int64)[gaps < 255]


class Frequencies:
    """What the prefixes need to know of all shingles, in fixed space: a bitmap of hash buckets that hold more than one
    occurrence, and a coarse count. A shingle whose bucket isn't marked occurs in one document only; the coarse count bounds a frequency from above."""

    def __init__(self, repeated: np.ndarray, counts: np.ndarray, bits: int, coarse: int):
        self.repeated, self.counts, self.bits, self.coarse = repeated, counts, bits, coarse

    def of(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = (tokens >> U64(64 - self.bits)).astype(np.int64)
        return (self.repeated[at >> 3] >> (7 - (at & 7)) & 1).astype(bool), self.counts[at >> (self.bits - self.coarse)]


def frequencies(texts: DataFrame, width: int, bits: int, coarse: int, block: int = 19, at_once: int = 1 << 21) -> Frequencies:
    """One pass over all documents. Tasks send the bucket places of `at_once` shingles together (about a byte each) and their coarse counts, by block;
    Spark merges the blocks; the driver gets 2^bits / 8 + 4 * 2^coarse bytes whatever the input."""
    blocks = 1 << (bits - block)

    def count(batches):
        hashes, total, held, n = WordHashes(), np.zeros(1 << coarse, np.uint32), [], 0

        def sent():
            at = np.sort((np.concatenate(held) >> U64(64 - bits)).astype(np.int64))
            np.add.at(total, at >> (bits - coarse), np.uint32(1))
            if len(at) > 2:  # two of a kind say as much as more
                at = at[np.concatenate([[True, True], at[2:] != at[:-2]])]
            cuts = np.searchsorted(at, np.arange(blocks + 1) << block)
            some = [k for k in range(blocks) if cuts[k] < cuts[k + 1]]
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([False] * len(some), pa.bool_()), pa.array([pack_places(at[cuts[k] : cuts[k + 1]] - (k << block)) for k in some], pa.binary())], ["block", "is_count", "data"])

        for batch in batches:
            for part in slices(batch):
                own = shingle_sets(raw_texts(part), hashes, width)
                held, n = held + own, n + sum(map(len, own))
                if n >= at_once:
                    yield sent()
                    held, n = [], 0
        if held:
            yield sent()
        parts = np.split(total, blocks)
        yield pa.RecordBatch.from_arrays([pa.array(range(blocks), pa.int32()), pa.array([True] * blocks, pa.bool_()), pa.array([p.tobytes() for p in parts], pa.binary())], ["block", "is_count", "data"])

    def merge(batches):
        sums: dict[int, np.ndarray] = {}
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, is_count, data in zip(*(batch.column(c).to_pylist() for c in ("block", "is_count", "data")), strict=True):
                if is_count:
                    own = np.frombuffer(data, np.uint32).astype(np.uint64)
                    sums[k] = sums[k] + own if k in sums else own
                    continue
                marks = seen.setdefault(k, np.zeros((2, 1 << block), bool))
                at = unpack_places(data)
                marks[1][at[marks[0][at]]] = True
                marks[1][at[1:][at[1:] == at[:-1]]] = True
                marks[0][at] = True
        out = [(k, True, np.minimum(v, 2**32 - 1).astype(np.uint32).tobytes()) for k, v in sums.items()] + [(k, False, np.packbits(v[1]).tobytes()) for k, v in seen.items()]
        columns = list(zip(*out, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.bool_(), pa.binary()), strict=True)], ["block", "is_count", "data"])

    schema = "block int, is_count boolean, data binary"
    merged = texts.select("text").mapInArrow(tidy(count), schema).repartition(blocks, "block").mapInArrow(tidy(merge), schema)
    repeated, counts = np.zeros(1 << (bits - 3), np.uint8), np.zeros(1 << coarse, np.uint32)
    for r in merged.collect():
        whole, kind = (counts, np.uint32) if r["is_count"] else (repeated, np.uint8)
        size = len(whole) // blocks
        whole[r["block"] * size : (r["block"] + 1) * size] = np.frombuffer(r["data"], kind)
    return Frequencies(repeated, counts, bits, coarse)


def needed(n: int, percent: int) -> int:
    """Prefix tokens that cannot all be missing from a partner: n minus the least overlap, plus one."""
    return n - -(-percent * n // 100) + 1


def needed_below(n: int, percent: int) -> int:
    """The same against partners no smaller: they must share percent / (100 + percent) of both sizes together."""
    return n - -(-2 * percent * n // (100 + percent)) + 1


def signatures(tokens: np.ndarray, repeated: np.ndarray, counts: np.ndarray, frequent: int, percent: int, prefix: int | None = None) -> np.ndarray:
    """Index entries of one set: single rare tokens and pairs of frequent tokens from its extended prefix.

    Tokens that no other document has come first in the order; they count for the prefix but need no entry.

    Pairs are made in a scheme for the power of two of the smaller partner's size, which sets the number of classes; a set whose partners
    may fall in two schemes makes entries in both.
    """
    n = len(tokens)
    if not n:
        return tokens
    need = (needed(n, percent) if prefix is None else prefix) - int(len(tokens) - repeated.sum())
    tokens, counts = tokens[repeated], counts[repeated]
    if need <= 0:
        return tokens[:0]
    order = np.lexsort((tokens, counts))
    tokens, counts = tokens[order], counts[order]
    rare = int(np.searchsorted(counts, frequent))
    out = []
    for scheme in range((-(-percent * n // 100)).bit_length(), n.bit_length() + 1):
        if scheme < 4 or rare >= need:
            out.append(tokens[:need])
            continue
        out.append(tokens[:rare])
        rest = tokens[rare:]
        classes = max(1, (1 << scheme) // 40)
        own = (mix(rest + U64(BASE_2)) % U64(classes)).astype(np.int64)
        by_class = np.argsort(own, kind="stable")
        grouped = own[by_class]
        first = np.searchsorted(grouped, grouped)
        rank = np.empty(len(rest), np.int64)
        rank[by_class] = np.arange(len(rest)) - first
        end = int(np.searchsorted(np.cumsum(rank > 0), need - rare)) + 1
        by_class = by_class[by_class < end]  # still by class, then by the common order
        grouped, mine = own[by_class], rest[by_class]
        step = 1
        while step < len(mine) and (same := grouped[step:] == grouped[:-step]).any():
            out.append(mix(mine[:-step][same] * U64(BASE_1) + mine[step:][same] * U64(BASE_2) + U64(scheme)))
            step += 1
    return np.unique(np.concatenate(out))


def parity_bitmap(tokens: np.ndarray) -> np.ndarray:
    """512 bits, each the parity of the tokens hashed to it: two sets differ in at least as many tokens as their bitmaps in bits."""
    odd = np.bincount((tokens >> U64(55)).astype(np.int64), minlength=512) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def prefix_table(texts: DataFrame, width: int, percent: int, bits: int, coarse: int, frequent: int) -> DataFrame:
    """Settled: doc_id, n (set size), own (tokens that no other document has), k1, k2 (128-bit hash of the set), b0 to b7 (parity bitmap), entries array<long>, short array<boolean>."""
    known = frequencies(texts, width, bits, coarse)
    # buckets hold other shingles too: a token is frequent if its bucket stands out from the mean load
    limit = int(frequent + 4 * known.counts.mean())
    shared = texts.sparkSession.sparkContext.broadcast(known)  # 2^bits / 8 + 4 * 2^coarse bytes

    def run(batches):
        hashes, known = WordHashes(), shared.value
        for part in (part for batch in batches for part in slices(batch)):
            n, own, k1, k2, entries, short, bitmaps = [], [], [], [], [], [], []
            for tokens in shingle_sets(raw_texts(part), hashes, width):
                key = xxhash.xxh3_128_intdigest(tokens.tobytes())
                n.append(len(tokens))
                k1.append((key >> 64) - (1 << 63))
                k2.append((key & (1 << 64) - 1) - (1 << 63))
                repeated, counts = known.of(tokens)
                own.append(int(len(tokens) - repeated.sum()))
                bitmaps.append(parity_bitmap(tokens))
                every = signatures(tokens, repeated, counts, limit, percent)
                entries.append(every)
                short.append(np.isin(every, signatures(tokens, repeated, counts, limit, percent, needed_below(len(tokens), percent))) if len(every) else np.empty(0, bool))
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(e) for e in entries])]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (np.concatenate(entries).view(np.int64), np.concatenate(short))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(x, pa.int64()) for x in (n, own, k1, k2)], *map(pa.array, np.stack(bitmaps, 1)), *lists], ["doc_id", "n", "own", "k1", "k2", *BITMAP, "entries", "short"])

    bits_of = ", ".join(f"{b} long" for b in BITMAP)
    return settle(texts.mapInArrow(tidy(run), f"doc_id long, n long, own long, k1 long, k2 long, {bits_of}, entries array<long>, short array<boolean>"), "near-prefixes")


def set_table(texts: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """Settled: doc_id and its whole set, of the wanted documents."""

    def run(batches):
        hashes, seen = WordHashes(), set()  # rows that repeat a doc_id are in one partition
        for part in (part for batch in batches for part in slices(batch)):
            fresh = [i for i, x in enumerate(part.column("doc_id").to_pylist()) if not (x in seen or seen.add(x))]
            part = part.take(pa.array(fresh, pa.int64()))
            sets = shingle_sets(raw_texts(part), hashes, width)
            offsets = np.concatenate([[0], np.cumsum([len(e) for e in sets])]).astype(np.int32)
            flat = np.concatenate([np.empty(0, U64), *sets]).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["doc_id", "tokens"])

    own = KeyFilter(wanted, "doc_id").split(texts, "doc_id")[0].join(wanted.hint("shuffle_hash"), "doc_id", "left_semi")
    return settle(own.mapInArrow(tidy(run), "doc_id long, tokens array<long>"), "near-sets")


def verified(pairs: DataFrame, sets: DataFrame, percent: int, name: str) -> DataFrame:
    """The pairs (a, b) whose Jaccard similarity is at least percent."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("tb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", F.size("ta").alias("na"), F.size("tb").alias("nb"), F.size(F.array_intersect("ta", "tb")).alias("common"))
    return settle(both.filter(100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b"), name)


def may_link(percent: int) -> Column:
    """Can a document and its partner (columns p_...) be similar? What they share must reach percent / (100 + percent) of both sizes together.
    It is at most what either has in common with anyone, and at most what their parity bitmaps leave. Both bounds are exact: no similar pair fails."""
    both = F.col("n") + F.col("p_n")
    share = F.least(F.col("n") - F.col("own"), F.col("p_n") - F.col("p_own"))
    apart = sum((F.bit_count(F.col(b).bitwiseXOR(F.col(f"p_{b}"))) for b in BITMAP), F.lit(0))
    return ((100 + percent) * share >= percent * both) & ((100 + percent) * (both - apart) >= 2 * percent * both)


def near_components(docs: DataFrame, width: int = 5, percent: int = 80, **options) -> DataFrame:
    """doc_id, n_shingles, component_id: one row a row of docs."""
    known, aside = one_text_each(id_and_text(docs))
    found = linked(known, width, percent, **options)
    for rest in aside:
        found = found.unionByName(set_sizes(rest, width))
    return found


def linked(texts: DataFrame, width: int = 5, percent: int = 80, sketch_bits: int = 27, count_bits: int = 20, frequent: int = 64, rounds: int = 3, known: DataFrame | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id of texts whose doc_ids have one text each. known: doc_id and root of documents that are linked already; only links between roots are looked for then."""
    table = prefix_table(texts, width, percent, sketch_bits, count_bits, frequent)
    classes = table.filter("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"))
    members = settle(table.select("doc_id", "n", "k1", "k2").join(classes, ["k1", "k2"], "left").select("doc_id", "n", F.when(F.col("n") > 0, F.col("rep")).otherwise(F.col("doc_id")).alias("rep")), "near-members")
    # every document but the representatives of its set leaves the index
    others = settle(members.filter("n > 0 and (doc_id is null or doc_id <> rep)").select("doc_id").distinct(), "near-copies")
    maybe, sure = KeyFilter(others, "doc_id").split(table.filter("n > 0 and doc_id is not null").select("doc_id", "entries", "short"), "doc_id")
    index = sure.unionByName(maybe.join(others.hint("shuffle_hash"), "doc_id", "left_anti")).withColumn("of", F.col("doc_id"))
    if known is not None:
        index = index.drop("of").join(known.select("doc_id", F.col("root").alias("of")), "doc_id", "left").withColumn("of", F.coalesce("of", "doc_id"))
    index = index.select("doc_id", "of", F.explode(F.arrays_zip("entries", "short")).alias("e")).select("doc_id", "of", F.col("e.entries").alias("entry"), F.col("e.short").alias("short"))
    index = index.repartition("entry")  # one exchange serves the bounds and the join
    shared = index.groupBy("entry").agg(F.min("of").alias("low"), F.max("of").alias("high")).filter("low <> high").select("entry")
    bare = settle(index.join(shared, "entry", "left_semi").drop("of"), "near-index")
    traits = table.filter("n > 0 and doc_id is not null").select("doc_id", *TRAITS).dropDuplicates(["doc_id"])
    index = settle(bare.join(traits, "doc_id"), "near-traits")
    forget(table, others, bare)
    active = settle(index.select("doc_id").distinct(), "near-active")
    sets = set_table(texts, active, width)
    done: list[DataFrame] = []  # settled pairs of all rounds
    root = known  # doc_id, root of the documents linked so far
    tested: DataFrame | None = None

    def rooted() -> DataFrame:
        if root is None:
            return index.withColumn("root", F.col("doc_id"))
        return index.join(root, "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))

    def merge(links: DataFrame) -> DataFrame | None:
        """The roots after more links; None if there are none."""
        if links.isEmpty():
            return None
        if root is None:
            return settle(components(links).select(F.col("node").alias("doc_id"), F.col("component").alias("root")), "near-roots")
        up = lambda c: root.select(F.col("doc_id").alias(c), F.col("root").alias(f"r{c}"))
        lifted = links.join(up("a"), "a", "left").join(up("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
        higher = components(lifted).select(F.col("node").alias("old"), F.col("component").alias("root"))
        known = root.select("doc_id", F.col("root").alias("old"))
        # a document linked for the first time is its own old root
        alone = higher.select(F.col("old").alias("doc_id"), "old").join(known.select("doc_id"), "doc_id", "left_anti")
        return settle(known.unionByName(alone).join(higher, "old", "left").select("doc_id", F.coalesce("root", "old").alias("root")), "near-roots")

    for turn in range(rounds + 1):
        now = rooted()
        if turn < rounds:  # each entry's documents against one pivot: first the one with the fewest tokens to itself, then others
            place = F.struct((F.col("own") / F.col("n") if turn == 0 else F.lit(0.0)).alias("o"), F.xxhash64("doc_id", F.lit(turn)).alias("h"))
            pivot = now.groupBy("entry").agg(F.min(F.struct(place.alias("place"), "doc_id", "root", "short", *TRAITS)).alias("p"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("entry", F.col("p.doc_id").alias("pd"), F.col("p.root").alias("pr"), F.col("p.short").alias("p_short"), *[F.col(f"p.{c}").alias(f"p_{c}") for c in TRAITS])
            below = (F.col("n") < F.col("p_n")) | ((F.col("n") == F.col("p_n")) & (F.col("doc_id") < F.col("pd")))
            meets = F.when(below, F.col("short")).otherwise(F.col("p_short"))  # the smaller of two meets its partner in its short prefix
            pairs = now.join(pivot, "entry").filter((F.col("root") != F.col("pr")) & meets & may_link(percent)).select(F.least("doc_id", "pd").alias("a"), F.greatest("doc_id", "pd").alias("b"))
        else:  # whatever is left between components
            other = now.select("entry", F.col("doc_id").alias("pd"), F.col("root").alias("pr"), *[F.col(c).alias(f"p_{c}") for c in TRAITS])
            below = (F.col("n") < F.col("p_n")) | ((F.col("n") == F.col("p_n")) & (F.col("doc_id") < F.col("pd")))
            pairs = now.filter("short").join(other, "entry").filter(below & (F.col("root") != F.col("pr")) & may_link(percent)).select(F.least("doc_id", "pd").alias("a"), F.greatest("doc_id", "pd").alias("b"))
        pairs = pairs.distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = settle(pairs, "near-pairs")
        done.append(pairs)
        if pairs.isEmpty():
            continue
        tested = pairs if tested is None else tested.unionByName(pairs)
        links = verified(pairs, sets, percent, "near-links")
        root = merge(links) or root
        forget(links)
    forget(index, sets, active, *done)
    found = members.select("doc_id", F.col("n").alias("n_shingles"), F.col("rep").alias("component_id"))
    if root is not None:
        found = members.join(root.select(F.col("doc_id").alias("rep"), "root"), "rep", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "rep").alias("component_id"))
    return found


def set_sizes(texts: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles and component_id of rows that are linked with nothing."""

    def run(batches):
        hashes = WordHashes()
        for part in (part for batch in batches for part in slices(batch)):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) for x in shingle_sets(raw_texts(part), hashes, width)], pa.int64()), part.column("doc_id")], ["doc_id", "n_shingles", "component_id"])

    return texts.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, n_shingles long, component_id long")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The documents that are the smallest doc_id of their component, and those without one, with all their columns.

    Rows that repeat a doc_id and its text stay or go together; other texts of a shared doc_id, and rows without a doc_id, stay.
    """
    bound_batches(docs.sparkSession)
    rest = [F.struct(*[named(c) for c in docs.columns if c != "text"]).alias("row")]
    known, aside = one_text_each(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *rest))
    found = linked(known.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), **options)
    others = settle(found.filter("doc_id <> component_id").select("doc_id").distinct(), "near-others")
    maybe, kept = KeyFilter(others, "doc_id").split(known, "doc_id")  # only documents that may go are shuffled
    kept = kept.unionByName(maybe.join(others.hint("shuffle_hash"), "doc_id", "left_anti").select(*kept.columns))
    for more in aside:
        kept = kept.unionByName(more)
    return kept.select(*[F.col("text") if c == "text" else named(c, "row") for c in docs.columns])
