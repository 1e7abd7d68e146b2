"""MinHash near-dedup: an LSH forest.

1. Every text becomes its set of word shingles and TREES labels of DEPTH MinHash
   values each.  Equal texts are one vertex, so exact copies cost nothing further.
2. Each tree is a sorted order of the vertices by label (range-partitioned by label
   and vertex, so a dense region spreads over partitions; the rows at the borders of
   partitions are compared too).  A vertex's candidates are its WINDOW successors in
   each order, if their longest common prefix is long enough: in a dense region the
   neighbours share deeper prefixes, in a sparse one shallower ones, so the depth
   adapts itself.  A small sketch, then all MinHash values of the two drop candidates
   that are clearly less alike than the limit.  Connected candidates form a region.
3. Inside each region links are confirmed on the full shingle sets.  Every member is
   compared with the region's centre first; what the centre settles needs no pair
   of its own.  A region with open members is then split, exactly: of a set of n
   shingles, the n - ceil(limit * n) + 1 that are rarest in the region (judged by a
   few members; any order is right) are its prefix, and linked sets share a shingle of
   their prefixes.  Vertices that share one are connected by a star, and the connected
   parts are compared, open members with all members, in blocks of at most BLOCK
   against BLOCK, so that no task holds a whole part and no pairs are emitted: a block
   returns a spanning forest of its links.  What shares only boilerplate falls apart.
4. The connected components of the confirmed links are the result.

Misses: two texts at the limit that nothing else resembles share the common prefix in
no tree with a probability of MISSED at most, and so little do the sketch and the
values drop them; together below 3e-6 at the limit, and less above it.  Inside a part
nothing is missed.  Texts with many others between them in every order are found
if the candidates connect them; see the README for measurements.

Defined results: a document without words (or a null text) has an empty set and
stands alone; one with fewer words than a shingle has its whole sequence as its one
shingle.  Every row is a document: rows that repeat an id with another text have
components of their own, and rows that repeat id and text are in one.  A component's
id is its least doc_id, null if none of its rows has one; a row without an id isn't
`kept`.  `deduplicated` keeps one row of each component, whatever its id.  Other
columns are ignored there and kept as they are here; an empty table gives an empty
one.  Nothing is capped: texts, regions, blocks and components may have any size.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from .common import map_batches, prepare, release, stored

#: Sorted orders, values of a label, successors compared, values of the sketch.
TREES, DEPTH, WINDOW, SKETCH = 20, 8, 2, 32
#: The chance of each of the three filters to drop a pair at the limit.
MISSED = 1e-6
#: Members whose shingles judge what is rare in a region, about; members that one task takes the prefixes of.
SAMPLE, CHUNK = 16, 64
#: Documents of a block in the exact comparison.
BLOCK = 64
KEPT_WORDS = 300_000

_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD))
_RANDOM = np.random.default_rng(20240607)
_FACTORS = _RANDOM.integers(1, 2**63, TREES * DEPTH + SKETCH, dtype=np.uint64) | np.uint64(1)
_OFFSETS = _RANDOM.integers(0, 2**63, TREES * DEPTH + SKETCH, dtype=np.uint64)


def shared_prefix(percent: int) -> int:
    """The longest common prefix that a pair at the limit has in some tree, but for the chance MISSED."""
    return max(d for d in range(1, DEPTH + 1) if d == 1 or (1 - (percent / 100) ** d) ** TREES <= MISSED)


def least_equal(n: int, percent: int) -> int:
    """How many of n MinHash values are equal for a pair at the limit, but for the chance MISSED."""
    t, below = percent / 100, 0.0
    for k in range(n):
        below += math.comb(n, k) * t**k * (1 - t) ** (n - k)
        if below > MISSED:
            return k
    return n


def words_of(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased: bytes split and lower ASCII alone, just as the contract says."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class Shingler:
    """Distinct 64-bit shingle hashes of texts; keeps the hashes of frequent words."""

    def __init__(self, size: int):
        self.size, self.known = size, {}

    def shingles(self, words: list[bytes]) -> np.ndarray:
        """Sorted distinct hashes; a sequence shorter than a shingle is one by itself."""
        if not words:
            return np.empty(0, np.uint64)
        if len(words) < self.size:
            return np.array([xxhash.xxh64_intdigest(b" ".join(words), 1)], np.uint64)
        known = self.known
        if len(known) > KEPT_WORDS:
            known.clear()
        hashes = []
        for w in words:
            if (h := known.get(w)) is None:
                h = xxhash.xxh64_intdigest(w)
                if len(w) <= 32:
                    known[w] = h
            hashes.append(h)
        h = np.array(hashes, np.uint64)
        n = len(h) - self.size + 1
        out = h[:n].copy()
        for k in range(1, self.size):
            out = (out ^ (out >> np.uint64(29))) * _A + (h[k : k + n] ^ _B) * _C
        out = (out ^ (out >> np.uint64(32))) * _D
        return np.unique(out ^ (out >> np.uint64(29)))


def signature(shingles: np.ndarray) -> tuple[bytes, bytes]:
    """(labels of all trees, sketch): big-endian 16-bit values, and single bytes."""
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingles), 2048):
        block = shingles[start : start + 2048, None] * _FACTORS + _OFFSETS
        least = np.minimum(least, (block ^ (block >> np.uint64(31))).min(axis=0))
    least = least * _D
    least ^= least >> np.uint64(33)
    return (least[: TREES * DEPTH] & np.uint64(0xFFFF)).astype(">u2").tobytes(), (least[TREES * DEPTH :] & np.uint64(0xFF)).astype(np.uint8).tobytes()


def identity(text: str) -> Column:
    """A digest of the text."""
    return F.unhex(F.md5(F.col(text).cast("binary")))


def signatures(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(id, class, n_shingles, labels, sketch) of every document; class is null without words."""

    def run(batch):
        tool = Shingler(size)
        out: dict[str, list] = {"class": [], "n_shingles": [], "labels": [], "sketch": []}
        for t, digest in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            shingles = tool.shingles(words_of(t))
            labels, sketch = signature(shingles) if len(shingles) else (None, None)
            out["n_shingles"].append(len(shingles))
            out["class"].append(digest if len(shingles) else None)
            out["labels"].append(labels)
            out["sketch"].append(sketch)
        return {"id": batch.column(0), **out}

    return map_batches(docs.select(F.col(key).cast("bigint"), F.col(text), identity(text)), run, "id bigint, class binary, n_shingles bigint, labels binary, sketch binary")


def neighbours(vertices: DataFrame, percent: int) -> DataFrame:
    """Distinct candidate pairs (a, b, n), a < b, n times neighbours in the sorted orders of all trees."""
    width = 2 * DEPTH
    tree = F.explode(F.array(*(F.struct(F.lit(t).cast("tinyint").alias("tree"), F.substring("labels", t * width + 1, width).alias("label")) for t in range(TREES)))).alias("x")
    rows = vertices.select("id", "sketch", tree).select("x.tree", "x.label", "id", "sketch")
    rows = rows.repartitionByRange("tree", "label", "id").sortWithinPartitions("tree", "label", "id")
    need, common = least_equal(SKETCH, percent), 2 * shared_prefix(percent)
    names = ["a", "b", "tree", "label", "id", "sketch"]
    types = [pa.int64(), pa.int64(), pa.int8(), pa.binary(), pa.int64(), pa.binary()]

    def pairs(batches):
        tail: list[tuple] = []
        border: list[tuple] = []  # the partition's first and last rows
        for batch in batches:
            out: list[tuple[int, int]] = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                t, label, i, sketch = row
                prefix = label[:common]
                for t0, label0, i0, sketch0 in tail:
                    if t0 == t and i0 != i and label0[:common] == prefix and sum(map(int.__eq__, sketch0, sketch)) >= need:
                        out.append((i0, i) if i0 < i else (i, i0))
                tail.append(row)
                if len(tail) > WINDOW:
                    del tail[0]
                if len(border) < WINDOW:
                    border.append(row)
            if out:
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in zip(*out)), *(pa.nulls(len(out), t) for t in types[2:])], names)
        border += [row for row in tail if row not in border]
        if border:
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(border), pa.int64()) for _ in range(2)), *(pa.array(x, t) for x, t in zip(zip(*border), types[2:]))], names)

    schema = "a bigint, b bigint, tree tinyint, label binary, id bigint, sketch binary"
    found = stored(rows.mapInArrow(pairs, schema), "neighbours")
    # a few rows a partition; again in the common order, the last ones of a partition meet the first ones of the next
    borders = found.where("a IS NULL").select("tree", "label", "id", "sketch").repartition(1).sortWithinPartitions("tree", "label", "id")
    return found.union(borders.mapInArrow(pairs, schema)).where("a IS NOT NULL").groupBy("a", "b").agg(F.count("*").alias("n"))


def alike(pairs: DataFrame, vertices: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, n) that have as many equal MinHash values as the limit asks for."""
    size = TREES * DEPTH
    values = vertices.select("id", "labels", "sketch")
    need = least_equal(size + SKETCH, percent)

    def compare(batches):
        for batch in batches:
            labels, sketches = (
                [np.frombuffer(b"".join(batch.column(c).to_pylist()), kind).reshape(batch.num_rows, -1) for c in columns]
                for columns, kind in (((3, 5), np.uint16), ((4, 6), np.uint8))
            )
            equal = (labels[0] == labels[1]).sum(axis=1) + (sketches[0] == sketches[1]).sum(axis=1)
            yield batch.select([0, 1, 2]).filter(pa.array(equal >= need))

    joined = pairs
    for side in ("a", "b"):
        joined = joined.join(values.select(F.col("id").alias(side), F.col("labels").alias(f"labels_{side}"), F.col("sketch").alias(f"sketch_{side}")), side)
    columns = ["a", "b", "n", "labels_a", "sketch_a", "labels_b", "sketch_b"]
    return joined.select(*columns).mapInArrow(compare, "a bigint, b bigint, n bigint")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every vertex of the edges (a, b): the least id that it reaches.

    Each round hangs every vertex on its least neighbour and contracts; only local
    minima remain, so the edges are gone after a logarithmic number of rounds.
    """
    edges = stored(edges.select("a", "b").where("a <> b"), "edges")
    where = None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hung = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("id"), F.least("a", "low").alias("up"))
        hung = stored(hung, "hung")
        up = hung.select(F.col("id").alias("up"), F.col("up").alias("higher"))
        hung = stored(hung.join(up, "up").select("id", F.col("higher").alias("up")), "hung")
        left, right = (hung.select(F.col("id").alias(c), F.col("up").alias(f"up_{c}")) for c in "ab")
        edges = stored(edges.join(left, "a").join(right, "b").select(F.col("up_a").alias("a"), F.col("up_b").alias("b")).where("a <> b").distinct(), "edges")
        if where is None:
            where = hung.select("id", F.col("up").alias("component"))
        else:
            step = hung.select(F.col("id").alias("component"), "up")
            where = stored(where.join(step, "component", "left").select("id", F.coalesce("up", "component").alias("component")), "where")
    if where is None:
        where = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    release(edges.sparkSession)
    return where


def _links(sets: list[np.ndarray], others: list[np.ndarray], percent: int):
    """(i, j) with 100 * |intersection| >= percent * |union| between two lists of sorted sets."""
    if not sets or not others:
        return
    joined = np.concatenate(others)
    owner = np.repeat(np.arange(len(others)), [len(x) for x in others])
    order = np.argsort(joined, kind="stable")
    joined, owner = joined[order], owner[order]
    sizes = np.array([len(x) for x in others])
    for i, own in enumerate(sets):
        low, high = np.searchsorted(joined, own, "left"), np.searchsorted(joined, own, "right")
        lengths = high - low
        at = np.repeat(low - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        shared = np.bincount(owner[at], minlength=len(others))
        for j in np.flatnonzero((shared > 0) & (100 * shared >= percent * (len(own) + sizes - shared))):
            yield i, int(j)


def _sets(column: pa.Array) -> list[np.ndarray]:
    values, offsets = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), column.offsets.to_numpy()
    first = offsets[0]
    return [values[a - first : b - first] for a, b in zip(offsets[:-1], offsets[1:])]


def parts(members: DataFrame, near: DataFrame, percent: int) -> DataFrame:
    """The members of regions with open ones (`near` is false), in the parts that their prefixes connect: id, region (a part now) and set."""
    flagged = members.select("id", "region").join(near.select("id", "near"), "id")
    counted = stored(flagged.groupBy("region").agg(F.count("*").alias("n"), F.count_if(~F.col("near")).alias("open")).where("open > 0"), "open")
    own = stored(members.join(counted, "region").select("region", "id", "set", F.ceil(F.col("n") / SAMPLE).alias("step"), F.ceil(F.col("n") / CHUNK).alias("chunks")), "open")
    place = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), n)
    common = own.where(place(F.col("step"), 1) == 0).select("region", "chunks", F.explode("set").alias("shingle")).groupBy("region", "chunks", "shingle").agg(F.count("*").alias("c")).where("c > 1")
    common = common.groupBy("region", "chunks").agg(F.sort_array(F.collect_list(F.struct("shingle", "c"))).alias("x"))  # the shingles of a few members
    orders = common.select("region", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("id"), F.col("x.shingle").alias("set"), F.col("x.c").alias("counts"))
    rows = own.select("region", place(F.col("chunks"), 2).alias("chunk"), F.lit(1).alias("kind"), "id", "set", F.array().cast("array<bigint>").alias("counts"))
    dealt = orders.union(rows).repartition("region", "chunk").sortWithinPartitions("region", "chunk", "kind")

    def prefixes(batches):
        region, shingles, counts = None, np.empty(0, np.uint64), np.empty(0, np.int64)
        for batch in batches:
            out: list[tuple[int, np.ndarray]] = []
            number = [np.asarray(x, np.int64) for x in batch.column(5).to_pylist()]
            for r, kind, i, own_set, c in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), _sets(batch.column(4)), number):
                if r != region:
                    region, shingles, counts = r, np.empty(0, np.uint64), np.empty(0, np.int64)
                if kind == 0:
                    order = np.argsort(own_set)  # signed order there, unsigned here
                    shingles, counts = own_set[order].copy(), c[order]
                    continue
                at = np.minimum(np.searchsorted(shingles, own_set), max(len(shingles) - 1, 0))
                often = np.where(shingles[at] == own_set, counts[at], 0) if len(shingles) else np.zeros(len(own_set), np.int64)
                size = len(own_set) - (percent * len(own_set) + 99) // 100 + 1
                out.append((r, i, own_set[np.lexsort((own_set, often))[:size]].view(np.int64)))
            if out:
                sizes = [len(x) for _, _, x in out]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat([r for r, _, _ in out], sizes), pa.int64()), pa.array(np.concatenate([x for _, _, x in out]), pa.int64()), pa.array(np.repeat([i for _, i, _ in out], sizes), pa.int64())], ["region", "shingle", "id"])

    prefix = stored(dealt.mapInArrow(prefixes, "region bigint, shingle bigint, id bigint"), "prefixes")
    low = prefix.groupBy("region", "shingle").agg(F.min("id").alias("low"), F.count("*").alias("n")).where("n > 1").drop("n")
    stars = prefix.join(low, ["region", "shingle"]).select(F.col("id").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
    return own.select("id", "set").join(components(stars).withColumnRenamed("component", "region"), "id").select("id", "region", "set")


def confirmed(members: DataFrame, edges: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect what the full sets of each region connect.

    `members` has id, region and set; `edges` are the candidate pairs, whose number
    makes a document central.
    """
    degree = edges.select("a", "n").union(edges.select("b", "n")).groupBy("a").agg(F.sum("n").alias("degree"))
    light = members.select("id", "region").join(degree, F.col("id") == F.col("a"))
    centres = stored(light.groupBy("region").agg(F.max_by("id", F.struct("degree", -F.col("id"))).alias("centre")), "centres")
    centre_sets = stored(centres.join(members.select(F.col("id").alias("centre"), F.col("set").alias("centre_set")), "centre").select("region", "centre", "centre_set"), "centres")

    def with_centre(batches):
        for batch in batches:
            own, centre = _sets(batch.column(2)), _sets(batch.column(3))
            near = [100 * (k := len(np.intersect1d(x, y, assume_unique=True))) >= percent * (len(x) + len(y) - k) for x, y in zip(own, centre)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near, pa.bool_())], ["id", "centre", "near"])

    pairs = members.join(centre_sets, "region").select("id", "centre", "set", "centre_set")
    near = stored(pairs.mapInArrow(with_centre, "id bigint, centre bigint, near boolean"), "near")

    # Every unsettled block meets every block of its part: settled ones, and unsettled ones once.
    members = parts(members, near, percent)
    flagged = members.select("id", "region").join(near.select("id", "near"), "id")
    sizes = flagged.groupBy("region").agg(F.count_if("near").alias("settled"), F.count_if(~F.col("near")).alias("open")).where("open > 0")
    blocks = stored(sizes.select("region", F.ceil(F.col("settled") / BLOCK).cast("int").alias("settled"), F.ceil(F.col("open") / BLOCK).cast("int").alias("open")), "blocks")
    place = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    row = lambda i, kind, j, side: F.struct(i.cast("int").alias("i"), F.lit(kind).alias("kind"), j.cast("int").alias("j"), F.lit(side).alias("side"))
    own = F.col("own")
    to = F.when(F.col("near"), F.transform(F.sequence(F.lit(0), F.col("open") - 1), lambda i: row(i, "s", own, 1))).otherwise(
        F.concat(
            F.when(F.col("settled") > 0, F.transform(F.sequence(F.lit(0), F.col("settled") - 1), lambda j: row(own, "s", j, 0))).otherwise(F.array().cast("array<struct<i:int,kind:string,j:int,side:int>>")),
            F.transform(F.sequence(own, F.col("open") - 1), lambda j: row(own, "u", j, 0)),
            F.transform(F.sequence(F.lit(0), own), lambda i: row(i, "u", own, 1)),
        )
    )
    dealt = members.join(near.select("id", "near"), "id").join(blocks, "region").withColumn("own", F.when(F.col("near"), place(F.greatest("settled", F.lit(1)))).otherwise(place(F.col("open"))))
    dealt = dealt.select("region", "id", "set", F.explode(to).alias("x")).select("region", "x.i", "x.kind", "x.j", "x.side", "id", "set")
    dealt = dealt.repartition("region", "i", "kind", "j").sortWithinPartitions("region", "i", "kind", "j", "side")

    def within_blocks(batches):
        key, sides = None, ([], [])

        def forest():
            (left, right) = sides
            ids = sorted({i for i, _ in left} | {i for i, _ in right})
            parent = {i: i for i in ids}

            def root(x):
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            out = []
            for i, j in _links([s for _, s in left], [s for _, s in right], percent):
                a, b = left[i][0], right[j][0]
                if (x := root(a)) != (y := root(b)):
                    parent[max(x, y)] = min(x, y)
                    out.append((a, b))
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["a", "b"])

        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in range(4)))
            for k, side, i, s in zip(keys, batch.column(4).to_pylist(), batch.column(5).to_pylist(), _sets(batch.column(6))):
                if k != key:
                    if key is not None:
                        yield forest()
                    key, sides = k, ([], [])
                sides[side].append((i, s.copy()))
        if key is not None:
            yield forest()

    linked = dealt.mapInArrow(within_blocks, "a bigint, b bigint")
    return near.where("near").select(F.col("id").alias("a"), F.col("centre").alias("b")).union(linked)


def vertices_of(rows: DataFrame) -> DataFrame:
    """The classes of signature rows, stored: class, first (its least id), labels, sketch, and a number `id` of their own."""
    same = [F.any_value(c).alias(c) for c in ("labels", "sketch")]  # functions of the class
    classes = rows.where("class IS NOT NULL").groupBy("class").agg(F.min("id").alias("first"), *same)
    return stored(classes.withColumn("id", F.monotonically_increasing_id()), "vertices")


def linked(docs: DataFrame, vertices: DataFrame, percent: int, size: int, key: str, text: str) -> DataFrame:
    """(id, component) of every vertex that has links; a component is the least of its vertices."""
    edges = stored(alike(stored(neighbours(vertices, percent), "candidates"), vertices, percent), "alike")
    regions = components(edges).select("id", F.col("component").alias("region"))

    def sets(batch):
        tool = Shingler(size)
        values = [tool.shingles(words_of(t)).view(np.int64) for t in batch.column(2).to_pylist()]
        lengths = np.array([0, *map(len, values)], np.int32).cumsum().astype(np.int32)
        return {"id": batch.column(0), "region": batch.column(1), "set": pa.ListArray.from_arrays(pa.array(lengths), pa.array(np.concatenate(values), pa.int64()))}

    # the text of a vertex: that of the rows with its class and least id
    wanted = regions.join(vertices.select("id", "class", "first"), "id")
    texts = docs.select(F.col(key).cast("bigint").alias("doc"), identity(text).alias("digest"), F.col(text).alias("text"))
    wanted = texts.join(wanted, F.col("doc").eqNullSafe(F.col("first")) & (F.col("digest") == F.col("class"))).select("id", "region", "text")
    members = stored(map_batches(wanted, sets, "id bigint, region bigint, set array<bigint>").dropDuplicates(["id"]), "members")
    return stored(components(confirmed(members, edges, percent)), "components")


def near_duplicates(docs: DataFrame, percent: int = 85, size: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, kept) of every document, for links of `percent` on `size`-word shingles."""
    prepare(docs.sparkSession)
    rows = stored(signatures(docs, key, text, size), "signatures")
    vertices = vertices_of(rows)
    found = linked(docs, vertices, percent, size, key, text)
    least = found.join(vertices.select("id", "first"), "id").groupBy("component").agg(F.min("first").alias("least"))
    labelled = vertices.select("id", "class", "first").join(found.join(least, "component").select("id", "least"), "id", "left").select("class", F.coalesce("least", "first").alias("component"))
    kind = docs.schema[key].dataType.simpleString()
    with_words = rows.where("class IS NOT NULL").select("id", "n_shingles", "class").join(stored(labelled, "labelled"), "class").select("id", "n_shingles", "component")
    out = with_words.union(rows.where("class IS NULL").select("id", "n_shingles", F.col("id").alias("component")))
    component = F.col("component")
    return out.select(F.col("id").cast(kind).alias(key), "n_shingles", component.cast(kind).alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def deduplicated(docs: DataFrame, percent: int = 80, size: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, and every row without words, with all columns.

    The row is that of the least id (null ids last), then the least text digest; of
    rows that repeat both it is the least by the other columns.
    """
    prepare(docs.sparkSession)
    rows = stored(signatures(docs, key, text, size), "signatures")
    vertices = vertices_of(rows)
    found = linked(docs, vertices, percent, size, key, text).join(vertices.select("id", "first", "class"), "id")
    order = F.struct(F.col("first").isNull(), "first", "class")
    best = found.groupBy("component").agg(F.min_by("id", order).alias("best"))
    lost = found.select("id").join(best.select(F.col("best").alias("id")), "id", "left_anti")
    keepers = stored(vertices.select("id", "first", "class").join(lost, "id", "left_anti"), "keepers").select(
        F.coalesce("first", F.lit(0)).alias("k0"), F.col("first").isNull().alias("k1"), F.col("class").alias("k2"))
    own = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(own))))  # whatever they are called
    doc, body = f"c{own.index(key)}", f"c{own.index(text)}"
    has_words = F.coalesce(F.col(body).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    keyed = plain.where(has_words).select(*plain.columns, F.coalesce(F.col(doc).cast("bigint"), F.lit(0)).alias("k0"), F.col(doc).isNull().alias("k1"), identity(body).alias("k2"))
    # the keepers grow with the corpus, so both sides are exchanged at every size; what repeats a key is then in one partition
    met = keyed.join(keepers.hint("merge"), ["k0", "k1", "k2"], "left_semi")
    ordered = [f.name for f in plain.schema if not isinstance(f.dataType, (MapType, VariantType))]
    one = met.groupBy("k0", "k1", "k2").agg(F.min_by(F.struct(*plain.columns), F.struct(*ordered)).alias("row")).select("row.*")
    return one.union(plain.where(~has_words)).toDF(*own)


def report(docs: DataFrame) -> DataFrame:
    """The contract's columns for `documents`."""
    return near_duplicates(docs)


#: The same by comparing all pairs that share a shingle.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END)) AS shingle
  FROM w WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
both_ AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(a, b) AS (SELECT a, b FROM both_ UNION SELECT r.a, both_.b FROM r JOIN both_ ON r.b = both_.a),
least_ AS (SELECT a, min(b) AS low FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(low, d.doc_id)) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least_ ON least_.a = d.doc_id
"""
