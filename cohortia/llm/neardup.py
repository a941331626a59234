"""Near-duplicate groups by an LSH forest over MinHash signatures, confirmed on full shingle sets.

Each tree of the forest is one sorted order of the documents: its label is a sequence of minimum
hashes, one byte a level.  Documents whose labels share a prefix stand together in that order; a
region is what shares the least depth.  Small regions are compared whole.  In a crowded one a document
meets its nearest neighbours in the order, those with the longest common prefix: the depth adapts to
the crowd.  What is crowded has an exact rest: a prefix-filtered join of the shingle sets.

1. Texts with the same shingle set are one vertex, the smallest id.
2. In each tree, neighbours whose whole signatures agree enough are joined; per stretch of the order
   only a spanning forest leaves the task.  Their components are the clusters in which links can lie.
3. The shingle sets of a cluster's documents meet: a small cluster whole, a large one again stretch by
   stretch in every tree.  Links are decided on the sets, and again a spanning forest leaves the task.
4. Documents of crowded regions and large clusters meet once more, by the rarest shingles of their sets:
   links that no stretch compared and no chain joins.
5. Components of the confirmed links give each document its smallest reachable id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, process_cache, stored, whole_text
from .components import components
from .repeats import WordHashes

TREES, LEVELS, DEPTH = 24, 8, 4
# Rows compared with each other at once; longer stretches move on by half of it.
STRETCH = 256
# Signatures of 192 functions tell a similarity within about 0.03; links at 0.8 fall below 0.68 about once in 50,000.
LIKELY = 0.68
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
EDGE = "a long, b long"
# Shingles are counted in 2^RARE_BITS cells, which order them from rare to frequent.
RARE_BITS = 18
# Parity bits of a shingle set.
SKETCH = 512
# Documents of one shingle and side compared by one task; more are cut into blocks that meet in pairs.
BLOCK = 1024
PREFIX = "token long, id long, n int, place int, home long, bits binary"


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles; of a shorter text, of all its words."""
    words = text.translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    known = process_cache("word hashes", WordHashes)
    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    span = min(width, len(words))
    mixed = np.full(len(words) - span + 1, span, np.uint64)
    for i in range(span):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + len(mixed)]
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xC2B2AE3D27D4EB4F)
    mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def hash_functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(20)
    return random.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), random.integers(0, 2**32, n, dtype=np.uint32)


def signature(shingles: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """One byte of the minimum under each hash function."""
    values = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(factors), 2**32 - 1, np.uint32)
    for at in range(0, len(values), 2048):
        part = values[at : at + 2048]
        least = np.minimum(least, (np.multiply.outer(factors, part) + shifts[:, None]).min(axis=1))
    # The high bits of a minimum are all small; its low ones are even.
    return (least & np.uint32(255)).astype(np.uint8)


def spanning(ids: np.ndarray, linked: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a small graph given by its adjacency matrix, as pairs of ids."""
    n = len(ids)
    open_, out = np.ones(n, bool), []
    for root in range(n):
        if not open_[root]:
            continue
        open_[root] = False
        front = [root]
        while front:
            at = front.pop()
            for to in np.flatnonzero(linked[at] & open_).tolist():
                open_[to] = False
                front.append(to)
                out.append((int(ids[at]), int(ids[to])))
    return out


def likely_links(signatures: list[bytes]) -> np.ndarray:
    """Which pairs of signatures agree in at least the share ``LIKELY`` of their bytes."""
    s = np.frombuffer(b"".join(signatures), np.uint8).reshape(len(signatures), -1)
    agree = np.empty((len(s), len(s)), bool)
    need = LIKELY * s.shape[1]
    for i in range(len(s)):
        agree[i] = (s == s[i]).sum(axis=1) >= need
    return agree


def set_links(percent: int) -> Callable[[list[bytes]], np.ndarray]:
    """Which pairs of sets have 100 * intersection >= percent * union, by counting on whole sets."""

    def links(sets: list[bytes]) -> np.ndarray:
        sizes = np.array([len(s) // 8 for s in sets], np.int64)
        shingles = np.frombuffer(b"".join(sets), np.uint64)
        owner = np.repeat(np.arange(len(sets)), sizes)
        values, column, times = np.unique(shingles, return_inverse=True, return_counts=True)
        # A shingle of one document adds to no intersection.
        shared = times > 1
        place = np.cumsum(shared) - 1
        use = shared[column]
        column, owner = place[column[use]], owner[use]
        common = np.zeros((len(sets), len(sets)), np.float32)
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        width = 8192
        for at in range(0, int(shared.sum()), width):
            a, b = np.searchsorted(column, (at, at + width))
            present = np.zeros((len(sets), width), np.float32)
            present[owner[a:b], column[a:b] - at] = 1
            # Whole numbers below 2^24 stay exact.
            common += present @ present.T
        common = common.astype(np.int64)
        union = sizes[:, None] + sizes[None, :] - common
        return (100 * common >= percent * union) & (common > 0)

    return links


def stretches(rows: Iterator[tuple], whole: Callable[[list], np.ndarray]) -> Iterator[list[tuple[int, int]]]:
    """Links of neighbours in sorted rows of (group, id, payload), as spanning forests.

    A group of up to ``STRETCH`` rows is compared whole; a longer one by stretches that overlap by half.
    """
    group, held = None, []
    fresh = 0

    def compare():
        if fresh and len(held) > 1:
            yield spanning(np.array([h[0] for h in held]), whole([h[1] for h in held]))

    for key, vertex, payload in rows:
        if key != group:
            yield from compare()
            group, held, fresh = key, [], 0
        elif len(held) == STRETCH:
            yield from compare()
            held, fresh = held[STRETCH // 2 :], 0
        held.append((vertex, payload))
        fresh += 1
    yield from compare()


def edges_of(rows: DataFrame, keys: list[str], payload: str, whole: Callable) -> DataFrame:
    """Spanning edges of sorted ``rows``: groups are runs of equal ``keys``."""
    columns = [*keys, "id", payload]

    def run(batches):
        def each():
            for b in batches:
                lists = [c.to_pylist() for c in b.columns]
                for r in zip(*lists):
                    yield r[:-2], r[-2], r[-1]

        found: list[tuple[int, int]] = []
        for forest in stretches(each(), whole):
            found += forest
            if len(found) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])
                found = []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])

    return rows.select(*columns).mapInArrow(run, EDGE)


def sketch(shingles: np.ndarray) -> bytes:
    """Parities of the shingles per hash cell: two sketches differ in no more bits than the sets in shingles."""
    return np.packbits(np.bincount((shingles & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1).tobytes()


def least_common(n, m, percent: int):
    """The smallest intersection with which sets of ``n`` and ``m`` shingles are linked."""
    return -(-percent * (n + m) // (100 + percent))


def candidates(rows: Iterator[pa.RecordBatch], percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of documents that can be linked, out of rows sorted by (token, p, q) as ``crossing`` gives them.

    The first common shingle of a linked pair, in the order from rare to frequent, leaves enough behind it
    in both sets, and the sketches differ in no more bits than the sets may.  Pairs of one home are joined
    already.
    """

    def pairs(t: pa.Table):
        token, p, q, ids, n, place, home, own = (t.column(c).to_numpy() for c in ("token", "p", "q", "id", "n", "place", "home", "own"))
        bits = np.frombuffer(b"".join(t.column("bits").to_pylist()), np.uint64).reshape(len(ids), -1)
        n, left = n.astype(np.int64), (n - place).astype(np.int64)
        border = np.flatnonzero((np.diff(token) != 0) | (np.diff(p) != 0) | (np.diff(q) != 0)) + 1
        size = np.diff(np.concatenate(([0], border, [len(ids)])))
        after = np.repeat(np.cumsum(size), size) - np.arange(len(ids)) - 1
        found = []
        at = np.flatnonzero(after > 0)
        step = 1
        while len(at):
            to = at + step
            need = least_common(n[at], n[to], percent)
            use = (home[at] != home[to]) & (np.minimum(left[at], left[to]) >= need) & ((p[at] == q[at]) | (own[at] != own[to]))
            a, b, need = at[use], to[use], need[use]
            near = np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1, dtype=np.int64) <= n[a] + n[b] - 2 * need
            a, b = ids[a[near]], ids[b[near]]
            if len(a):
                found.append(np.unique(np.column_stack((np.minimum(a, b), np.maximum(a, b))), axis=0))
            step += 1
            at = at[after[at] >= step]
        if found:
            both = np.unique(np.concatenate(found), axis=0)
            yield both[:, 0], both[:, 1]

    held: list[pa.RecordBatch] = []
    for b in rows:
        held.append(b)
        if sum(h.num_rows for h in held) < 30_000:
            continue
        t = pa.Table.from_batches(held)
        keys = [t.column(c).to_numpy() for c in ("token", "p", "q")]
        same = np.logical_and.reduce([k == k[-1] for k in keys])
        # The last group may go on in the next batch.
        cut = int(np.argmax(same))
        if cut:
            yield from pairs(t.slice(0, cut))
        held = t.slice(cut).combine_chunks().to_batches()
    if held:
        yield from pairs(pa.Table.from_batches(held))


def exact_rest(sets: DataFrame, percent: int, parts: int) -> DataFrame:
    """All linked pairs of ``sets`` (``id``, ``home``, ``shingles``) whose homes differ: prefix filtering, then whole sets."""
    spark = sets.sparkSession

    def tally(batches):
        cells = np.zeros(1 << RARE_BITS, np.int64)
        for b in batches:
            for s in b.column(0).to_pylist():
                cells += np.bincount((np.frombuffer(s, np.uint64) >> np.uint64(64 - RARE_BITS)).astype(np.int64), minlength=len(cells))
        cell = np.flatnonzero(cells)
        for at in range(0, len(cell), 50_000):
            part = cell[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(cells[part])], names=["cell", "n"])

    counts = sets.select("shingles").mapInArrow(tally, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    frequency = np.zeros(1 << RARE_BITS, np.int64)
    frequency[counts["cell"].to_numpy(np.int64)] = counts["n"].to_numpy(np.int64)
    sent = spark.sparkContext.broadcast(frequency)

    def prefixes(batches):
        frequency = sent.value
        for b in batches:
            out = []
            for vertex, home, s in zip(*(c.to_pylist() for c in b.columns)):
                shingles = np.frombuffer(s, np.uint64)
                n = len(shingles)
                order = np.lexsort((shingles, frequency[(shingles >> np.uint64(64 - RARE_BITS)).astype(np.int64)]))
                first = shingles[order[: n - -(-percent * n // 100) + 1]].view(np.int64)
                bits = sketch(shingles)
                out += [(int(token), vertex, n, place, home, bits) for place, token in enumerate(first)]
                if len(out) > 20_000:
                    yield rows_of(out)
                    out = []
            if out:
                yield rows_of(out)

    def rows_of(out):
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["token", "id", "n", "place", "home", "bits"])

    first = stored(sets.select("id", "home", "shingles").mapInArrow(prefixes, PREFIX), "prefixes")
    # A shingle on which one home alone stands joins nothing.  Of the others the largest home is cut into blocks
    # that meet those of all other homes, never each other; these meet among themselves too.
    by_home = first.groupBy("token", "home").agg(F.count(F.lit(1)).alias("times"))
    shared = by_home.groupBy("token").agg(F.sum("times").alias("times"), F.max(F.struct("times", "home")).alias("most"), F.count(F.lit(1)).alias("homes"))
    blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    shared = shared.where("homes > 1").select(
        "token", F.col("most.home").alias("main"), blocks(F.col("most.times")).alias("mains"), blocks(F.col("times") - F.col("most.times")).alias("others")
    )
    crossing = first.join(shared, "token").withColumn("side", F.when(F.col("home") == F.col("main"), F.lit(0)).otherwise(F.lit(1)))
    spread = F.pmod(F.xxhash64("id"), F.when(F.col("side") == 0, F.col("mains")).otherwise(F.col("others"))).cast("int")
    crossing = crossing.withColumn("block", spread)
    # Place (-1 - i, j): block i of the main home and block j of the others, told apart by the side; (i, j): two blocks of others.
    place = lambda p, q, own: F.struct(p.cast("int").alias("p"), q.cast("int").alias("q"), own.cast("int").alias("own"))
    every = lambda n, of: F.transform(F.sequence(F.lit(0), F.col(n) - 1), of)
    block = F.col("block")
    as_main = every("others", lambda j: place(-1 - block, j, F.lit(-1)))
    to_main = every("mains", lambda i: place(-1 - i, block, F.lit(-2)))
    to_others = every("others", lambda j: place(F.least(block, j), F.greatest(block, j), block))
    places = F.when(F.col("side") == 0, as_main).otherwise(F.concat(to_main, to_others))
    crossing = crossing.select("token", "id", "n", "place", "home", "bits", F.explode(places).alias("at"))
    crossing = crossing.select("token", "at.p", "at.q", "id", "n", "place", "home", "at.own", "bits")
    crossing = crossing.repartition(parts, "token", "p", "q").sortWithinPartitions("token", "p", "q")

    def compare(batches):
        for a, b in candidates(batches, percent):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    pairs = stored(crossing.mapInArrow(compare, EDGE).distinct(), "pairs")
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("one"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("two"))
    both = pairs.hint("merge").join(left, "a").hint("merge").join(right, "b").select("a", "b", "one", "two")

    def confirm(batches):
        for batch in batches:
            keep = []
            for one, two in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common > 0 and 100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(confirm, EDGE)


def near_duplicates(docs: DataFrame, width: int = 4, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, ``n_shingles``, ``component_id`` and ``kept`` of every row.

    Words stand between ASCII white space, A-Z in lower case; a text's set are its distinct shingles of
    ``width`` words, of a shorter text all its words as one.  Two texts are linked if 100 times the
    intersection is at least ``percent`` times the union.  ``component_id`` is the smallest id reachable,
    ``kept`` whether it is the row's own.  Missing, empty and blank texts have no shingles and no links.
    Rows that share an id are one vertex; a row without an id has no links, no component and is kept.
    Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    given = docs.select(col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text"))

    def sign(batches):
        factors, shifts = hash_functions(TREES * LEVELS)
        for b in batches:
            n, key, signs = [], [], []
            for text in b.column(1).to_pylist():
                shingles = shingle_set(text.encode("utf-8", "surrogatepass"), width)
                n.append(len(shingles))
                key.append(xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None)
                signs.append(signature(shingles, factors, shifts).tobytes() if len(shingles) else None)
            arrays = [b.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(signs, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "n", "key", "sign"])

    signed = stored(given.mapInArrow(sign, "id long, n long, key binary, sign binary"), "signed")
    # Copies collapse before anything is compared, however many there are.
    by_key = signed.where(F.col("id").isNotNull() & F.col("key").isNotNull()).groupBy("key")
    vertices = stored(by_key.agg(F.min("id").alias("id"), F.first("sign").alias("sign")), "vertices")

    tree = F.posexplode(F.array(*[F.substring("sign", LEVELS * t + 1, LEVELS) for t in range(TREES)])).alias("tree", "label")
    labels = vertices.select("id", tree).withColumn("region", F.conv(F.hex(F.substring("label", 1, DEPTH)), 16, 10).cast("long"))
    crowds = labels.groupBy("tree", "region").agg(F.count(F.lit(1)).alias("crowd")).where("crowd > 1")
    together = labels.join(crowds, ["tree", "region"])
    placed = together.join(vertices, "id").select("tree", "region", "label", "crowd", "id", "sign")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Crowded regions stand in one order over all trees, cut anywhere; others are each in one task.
    order = ["tree", "region", "label", "id"]
    whole = placed.where(F.col("crowd") <= STRETCH).repartition(parts, "tree", "region").sortWithinPartitions(*order)
    ordered = placed.where(F.col("crowd") > STRETCH).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    likely = [edges_of(rows, ["tree", "region"], "sign", likely_links) for rows in (whole, ordered)]
    clusters = stored(components(likely[0].unionByName(likely[1])), "clusters")

    sizes = clusters.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    crowded = together.where(F.col("crowd") > STRETCH).select("id").distinct().withColumn("crowded", F.lit(True))
    members = clusters.join(sizes, "component").join(crowded, "id", "full").select(
        F.coalesce("component", "id").alias("component"), "id", F.coalesce("size", F.lit(1)).alias("size"),
        (F.coalesce("crowded", F.lit(False)) | (F.coalesce("size", F.lit(1)) > STRETCH)).alias("rest"),
    )
    set_type = T.StructType(
        [T.StructField(n, T.LongType()) for n in ("component", "id", "size")]
        + [T.StructField("rest", T.BooleanType())]
        + [T.StructField(n, T.BinaryType()) for n in ("sign", "shingles")]
    )

    def read_sets(batches):
        factors, shifts = hash_functions(TREES * LEVELS)
        for b in batches:
            signs, sets = [], []
            for text, size in zip(b.column(4).to_pylist(), b.column(2).to_pylist()):
                shingles = shingle_set(text.encode("utf-8", "surrogatepass"), width)
                signs.append(signature(shingles, factors, shifts).tobytes() if size > STRETCH and len(shingles) else None)
                sets.append(shingles.tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(signs, pa.binary()), pa.array(sets, pa.binary())], names=set_type.names)

    # Members grow with the corpus, so they are never broadcast, however few they are.
    texts = members.hint("merge").join(given, "id").select("component", "id", "size", "rest", "text").mapInArrow(read_sets, set_type)
    texts = stored(texts.where(F.length("shingles") > 0), "sets")
    exact = set_links(percent)
    small = texts.where(F.col("size") <= STRETCH).repartition(parts, "component").sortWithinPartitions("component", "id")
    large = texts.where(F.col("size") > STRETCH).select("component", "id", "shingles", tree)
    order = ["component", "tree", "label", "id"]
    large = large.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    links = edges_of(small, ["component"], "shingles", exact).unionByName(edges_of(large, ["component", "tree"], "shingles", exact))
    groups = components(links)
    rest = texts.where("rest").select("id", "shingles")
    if not rest.isEmpty():
        homes = stored(groups, "homes")
        rest = rest.dropDuplicates(["id"]).join(homes, "id", "left").select("id", F.coalesce("component", "id").alias("home"), "shingles")
        more = exact_rest(stored(rest, "rest"), percent, parts)
        groups = components(homes.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more))
    groups = groups.withColumnRenamed("id", "vertex")

    # A copy reaches its vertex by the set, the vertex its component.
    owners = vertices.select("key", F.col("id").alias("vertex")).join(groups, "vertex", "left")
    owners = owners.select("key", F.coalesce("component", "vertex").alias("component_id"))
    found = signed.select("id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.col("key")).alias("key")).join(owners, "key", "left")
    component = F.coalesce("component_id", "id").alias("component_id")
    out = found.select("id", "n_shingles", component).withColumn("kept", F.coalesce(F.col("component_id") == F.col("id"), F.lit(True)))
    return out.withColumnRenamed("id", id_col)
