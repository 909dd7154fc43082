"""SimHash near-duplicate groups found with sharded BK-trees."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doctrail.llm.common import Rows, arrow_map, checkpoint, groups, stored, utf8
from doctrail.llm.components import components
from doctrail.llm.tokens import mixed

SEED = 42
BLOCK = 1 << 16
#: Documents alike: so many words in a shingle, and the least Jaccard similarity of their sets of shingles.
SHINGLE, SIMILARITY = 5, 0.8
#: Minima of a set, and so many of them in a band: of pairs at 0.8, three in a million share no band; above it, fewer.
BANDS, IN_BAND = 32, 5
#: Each round compares the classes of a band with one of them; then those still apart meet in pairs.
ROUNDS = 2
#: Rows to fetch texts for are broadcast up to so many.
ASKED = 500_000
_RANDOM = np.random.Generator(np.random.PCG64(29))
_FLIPS, _FACTORS = (_RANDOM.integers(0, 1 << 63, (BANDS * IN_BAND, 1), np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
_PLACES = _RANDOM.integers(0, 1 << 63, (BANDS, IN_BAND), np.uint64) * np.uint64(2) + np.uint64(1)


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """SimHash over XXH64 of word shingles; 0 for a text without words."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    line, digest = b" ".join(words), xxhash.xxh64_digest
    ends = [x - 1 for x in accumulate(len(x) + 1 for x in words)]
    starts = [0, *(x + 1 for x in ends)]
    spans = list(zip(starts, ends[shingle - 1 :], strict=False)) if len(words) > shingle else [(0, len(line))]
    counts = np.zeros(64, np.int64)
    for k in range(0, len(spans), BLOCK):
        hashes = b"".join([digest(line[a:b], SEED) for a, b in spans[k : k + BLOCK]])
        counts += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * counts > len(spans)).tobytes(), "big")


class BKTree:
    """Children keyed by their Hamming distance to the parent."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        at, values, children = 0, self.values, self.children
        if values:
            while True:
                edges = children[at]
                distance = (values[at] ^ value).bit_count()
                if distance not in edges:
                    edges[distance] = len(values)
                    break
                at = edges[distance]
        values.append(value)
        children.append({})

    def within(self, value: int, radius: int) -> Iterator[int]:
        """Places of values at most ``radius`` away; only edges within the radius of the distance are followed."""
        values, children, todo = self.values, self.children, [0] if self.values else []
        while todo:
            at = todo.pop()
            distance = (values[at] ^ value).bit_count()
            if distance <= radius:
                yield at
            for edge, child in children[at].items():
                if distance - radius <= edge <= distance + radius:
                    todo.append(child)


def linked(tree: list[int], probes: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that join the values as all links within the radius would, at most one fewer than there are values.

    ``probes`` empty: the values of ``tree`` among themselves; else each probe
    against the tree.
    """
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    out, bk = [], BKTree()
    for value in tree if probes else ():
        bk.add(value)
    for value in probes or tree:
        for at in bk.within(value, radius):
            a, b = root(value), root(bk.values[at])
            if a != b:
                parent[a] = b
                out.append((value, bk.values[at]))
        if not probes:
            bk.add(value)
    return out


def fingerprints(rows: Rows) -> DataFrame:
    """rid, doc_id, fp (the fingerprint's bits as a long)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x) for x in utf8(batch, "text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("doc_id").cast(pa.int64()), pa.array(fps)], ["rid", "doc_id", "fp"])

    return arrow_map(rows.numbered("doc_id", "text"), work, "rid long, doc_id long, fp long")


def links(fps: DataFrame, radius: int = 4, tree_size: int = 2048) -> DataFrame:
    """Links (u, v) between distinct fingerprints (long column fp) within the radius.

    Pigeonhole: two fingerprints that differ in at most ``radius`` bits agree in
    one of radius + 1 blocks, so each block's value names a shard. A shard of
    more than ``tree_size`` fingerprints is cut by hash into parts of about that
    size; each part has a tree, and every two parts of a shard meet once, in a
    task of bounded size. Trees reach their probes through this shuffle, as all
    trees together grow with the corpus and so must not be broadcast. Each task
    gives a spanning forest of what it found, never all pairs.
    """
    n = radius + 1
    cuts = [64 * i // n for i in range(n + 1)]
    width = max(b - a for a, b in zip(cuts, cuts[1:], strict=False))
    keys = [F.lit(i << width).bitwiseOR(F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << (b - a)) - 1))) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    sharded = fps.select("fp", F.explode(F.array(*keys)).alias("shard"))
    # At most (radius + 1) * 2 ** width rows: bounded, so it may be broadcast.
    parts = sharded.groupBy("shard").agg(F.ceil(F.count("*") / tree_size).cast("int").alias("parts")).where("parts > 1")
    cut = sharded.join(F.broadcast(parts), "shard", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    cut = cut.withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    met = cut.select("shard", "part", "fp", other).select(
        "shard", F.greatest("part", "other").alias("a"), F.least("part", "other").alias("b"), (F.col("part") < F.col("other")).cast("int").alias("side"), "fp"
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []

        def out() -> pa.RecordBatch:
            pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])

        for (_, a, b), (side, fp) in groups(batches, 3):
            if len(fp) > 1:
                bits = fp.view(np.uint64)
                tree, probes = bits[side == 0].tolist(), bits[side == 1].tolist()
                if a == b or (tree and probes):
                    found += linked(tree, probes if a != b else [], radius)
            if len(found) > 10_000:
                yield out()
        yield out()

    dealt = met.repartition("shard", "a", "b").sortWithinPartitions("shard", "a", "b")
    dealt.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    return dealt.mapInArrow(work, "u long, v long")


def near_duplicates(docs: DataFrame | Rows, radius: int = 4) -> DataFrame:
    """One row a document: rid, doc_id, fp, component_id, representative.

    Documents whose fingerprints differ in at most ``radius`` bits are linked;
    ``component_id`` is the smallest doc_id reachable and ``representative`` is
    true for one row of each component: the smallest doc_id (nulls last), then
    the first row. ``rid`` is the row's number (see ``Rows``).

    Null and empty texts have fingerprint zero and are linked like any other;
    repeated rows share a component; a component of null doc_ids alone has a
    null id; an empty table gives no rows; other columns are ignored.
    """
    marked = checkpoint(fingerprints(docs if isinstance(docs, Rows) else Rows(docs)))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")
    fps = checkpoint(marked.groupBy("fp").agg(F.min(order).alias("first")))
    stars = components(links(fps.select("fp"), radius))
    nodes = stars.select(F.col("u").alias("fp"), F.col("v").alias("root")).unionByName(stars.select(F.col("v").alias("fp"), F.col("v").alias("root")).distinct())
    led = nodes.join(fps, "fp")
    lowest = led.groupBy("root").agg(F.min("first").alias("lowest"))
    classes = fps.join(led.join(lowest, "root").select("fp", "lowest"), "fp", "left").select("fp", F.coalesce("lowest", "first").alias("lowest"))
    out = marked.join(classes, "fp")
    return out.select("rid", "doc_id", "fp", F.col("lowest.doc_id").alias("component_id"), (F.col("lowest.rid") == F.col("rid")).alias("representative"))


def keep_representatives(docs: DataFrame, radius: int = 4) -> DataFrame:
    """The rows of ``docs`` that represent their component, with their columns."""
    rows = Rows(docs)
    return rows.without(checkpoint(near_duplicates(rows, radius).where("not representative").select("rid")))


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Different hashes of the text's runs of ``size`` words, ascending; of all its words where they are fewer."""
    import xxhash

    words = text.lower().split()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(x, SEED) for x in words], np.uint64)
    size = min(size, len(h))
    if not size:
        return h
    out = np.zeros(len(h) - size + 1, np.uint64)
    for k in range(size):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - size + 1 + k])
    return np.unique(out)


def simhash(found: np.ndarray) -> int:
    """The bits that more than half of a set's hashes have; 0 for an empty set."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(found), BLOCK):
        counts += np.unpackbits(found[k : k + BLOCK].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * counts > len(found)).tobytes(), "big")


def tree_pairs(classes: DataFrame, radius: int = 4) -> DataFrame:
    """Pairs (u, v) of classes (long columns c, fp) that BK-trees of their fingerprints link: each with the first of its fingerprint, and the first ones of linked fingerprints."""
    first = checkpoint(classes.groupBy("fp").agg(F.min("c").alias("lead"), F.count("*").alias("m")))
    met = links(first.select("fp"), radius)
    for x in "uv":
        met = met.join(first.select(F.col("fp").alias(x), F.col("lead").alias(f"lead_{x}")), x)
    same = classes.join(first.where("m > 1"), "fp").where("c <> lead").select(F.col("c").alias("u"), F.col("lead").alias("v"))
    return met.select(F.col("lead_u").alias("u"), F.col("lead_v").alias("v")).unionByName(same)


def bands(found: np.ndarray) -> np.ndarray:
    """BANDS numbers, each of IN_BAND minima of a set of shingles; none for an empty set."""
    if not len(found):
        return found
    least = np.full(BANDS * IN_BAND, (1 << 64) - 1, np.uint64)
    for k in range(0, len(found), 4096):
        least = np.minimum(least, mixed((found[None, k : k + 4096] ^ _FLIPS) * _FACTORS).min(axis=1))
    return mixed((least.reshape(BANDS, IN_BAND) * _PLACES).sum(axis=1, dtype=np.uint64))


def similar_groups(numbers: Rows, similarity: float = SIMILARITY) -> DataFrame:
    """rid, doc_id, representative: one of each group of documents joined by links of at least this Jaccard similarity.

    Documents with the same set are one class. Classes whose SimHash
    fingerprints sharded BK-trees link are the first candidates; as most pairs
    at the least similarity differ in more bits than trees can be sought for,
    classes that share a band of minima follow. A link is only what the sets
    themselves confirm. A band's classes are first compared with one of them,
    in rounds, and then in pairs where no links join them yet, so large groups
    of near copies cost linear work. Texts without words are one class; the representative has the
    smallest doc_id (nulls last), then the first row.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(x) for x in utf8(batch, "text")]
            classes = np.array([int(mixed(x).sum(dtype=np.uint64)) ^ len(x) for x in sets], np.uint64)
            fps = np.array([simhash(x) for x in sets], np.uint64).view(np.int64)
            made = pa.array([bands(x).view(np.int64) for x in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("doc_id").cast(pa.int64()), pa.array(mixed(classes).view(np.int64)), pa.array(fps), made], ["rid", "doc_id", "c", "fp", "bands"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = pa.array([shingles(x).view(np.int64) for x in utf8(batch, "text")], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("c"), sets], ["c", "set"])

    rows = numbers.numbered("doc_id", "text")
    marked = stored(arrow_map(rows, sketch, "rid long, doc_id long, c long, fp long, bands array<long>"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")
    classes = checkpoint(marked.groupBy("c").agg(F.min(F.struct(order.alias("first"), "fp", "bands")).alias("s")).select("c", "s.first", "s.fp", "s.bands"))
    near = checkpoint(tree_pairs(classes.select("c", "fp")))
    ends = classes.select("c", F.posexplode("bands").alias("i", "k"))
    shared = ends.groupBy("i", "k").agg(F.count("*").alias("m")).where("m > 1").drop("m")
    ends = stored(ends.join(shared, ["i", "k"]))
    asked = ends.select("c").unionByName(near.select(F.explode(F.array("u", "v")).alias("c")))
    wanted = checkpoint(asked.distinct().join(classes, "c").select("c", F.col("first.rid").alias("rid")))
    met = rows.join(F.broadcast(wanted) if wanted.count() <= ASKED else wanted, "rid").select("c", "text")
    sets = stored(arrow_map(met, fetch, "c long, set array<long>"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        u, v = (sets.select(F.col("c").alias(x), F.col("set").alias(f"set_{x}")) for x in "uv")
        both = pairs.distinct().join(u, "u").join(v, "v")
        total = F.size("set_u") + F.size("set_v")
        return both.where((F.least(F.size("set_u"), F.size("set_v")) >= similarity * F.greatest(F.size("set_u"), F.size("set_v")) - 1e-9) & (F.size(F.array_intersect("set_u", "set_v")) >= total * (similarity / (1 + similarity)) - 1e-9)).select("u", "v")

    found = checkpoint(confirmed(near))
    joined = components(found)
    for k in range(ROUNDS + 1):
        labelled = ends.join(joined.select(F.col("u").alias("c"), "v"), "c", "left").select("i", "k", "c", F.coalesce("v", "c").alias("label"))
        if k < ROUNDS:
            heads = labelled.groupBy("i", "k").agg(F.min(F.struct(F.xxhash64("c", F.lit(k)).alias("r"), "c", "label")).alias("x"))
            pairs = labelled.join(heads, ["i", "k"]).where(F.col("label") != F.col("x.label")).select(F.col("c").alias("u"), F.col("x.c").alias("v"))
        else:
            # Bands of one group have nothing left to compare.
            apart = labelled.groupBy("i", "k").agg((F.min("label") < F.max("label")).alias("apart")).where("apart").drop("apart")
            left = labelled.join(apart, ["i", "k"])
            a, b = left.alias("a"), left.alias("b")
            pairs = a.join(b, (F.col("a.i") == F.col("b.i")) & (F.col("a.k") == F.col("b.k")) & (F.col("a.c") < F.col("b.c")) & (F.col("a.label") != F.col("b.label"))).select(F.col("a.c").alias("u"), F.col("b.c").alias("v"))
        found = found.unionByName(checkpoint(confirmed(pairs)))
        joined = components(found)
    roots = joined.select(F.col("v").alias("u"), "v").distinct().unionByName(joined)
    led = roots.withColumnRenamed("u", "c").join(classes.select("c", "first"), "c")
    lowest = led.groupBy("v").agg(F.min("first").alias("lowest"))
    leaders = classes.join(led.join(lowest, "v").select("c", "lowest"), "c", "left").select("c", F.coalesce("lowest", "first").alias("lowest"))
    out = marked.select("rid", "doc_id", "c").join(leaders, "c")
    return out.select("rid", "doc_id", (F.col("lowest.rid") == F.col("rid")).alias("representative"))


def keep_dissimilar(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that represent their group of similar documents, with all their columns.

    A null text is as an empty one; texts without words are one group; repeated
    rows are one group; a null doc_id comes last; an empty table gives no rows.
    """
    rows = Rows(docs)
    return rows.without(checkpoint(similar_groups(rows, similarity).where("not representative").select("rid")))
