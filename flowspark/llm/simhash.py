"""Document fingerprints: SimHash with permuted block tables.

A text's terms are its words and pairs of neighbouring words (short texts: also
runs of four code points).  Every term's 128-bit hash votes on the signed bits,
weighted by its damped count; longer words weigh more, as short ones are common
to all texts.  The fingerprint is the sign of each bit's sum.

The near search finds all pairs of distinct fingerprints within a Hamming radius
r.  The bits are cut into blocks, and a table for each block holds the
fingerprints with that block at the front, as the key.  If block i allows t(i)
differing bits and the t(i) + 1 sum to r + 1, two fingerprints within r meet a
block's allowance at least once; so a query looks up its block and all values
that differ from it in at most t(i) bits, and what it finds is compared exactly.
Equal fingerprints are one row there, so copies cost nothing.

RADIUS is from measured distances: of the 88 pairs of distinct fingerprints of
sf0.1 that are at most 30 bits apart and share 85 % of their three-word shingles,
87 are at most 20 bits apart (73 at most 16, 1 at most 3); all pairs within 20
bits share more than half, and unrelated pairs begin at about 35 bits.

n_near counts the other documents within the radius, exact copies among them;
`near_documents` names them, a row for each, as a list would have no bound.

Defined results: null and empty texts have the all-zero fingerprint; ties in a
bit's vote give 0; `next` goes by ascending (doc_id, text), null ids last, and of
repeated ids the first row stands for its id; a row with a null id has no next one;
extra columns are ignored; an empty table gives an empty one.  Texts of any length
are hashed whole, in blocks of terms.  The driver holds at most MOST_BUCKETS cut
points and first ids; beyond that buckets grow with the table, but a task streams
its bucket and holds two rows of it.
"""

from __future__ import annotations

import hashlib
import math
import re
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, stored

BITS = 128
#: Texts below so many code points also vote by runs of four code points.
SHORT = 400
#: Words whose hashes a worker keeps.
KEPT_WORDS = 300_000
#: Hamming radius of the search, and blocks (and tables) that it cuts fingerprints into.
RADIUS, BLOCKS = 20, 8
#: Documents of a bucket of neighbours, about; most buckets (a bound on what the driver holds).
BUCKET_ROWS, MOST_BUCKETS = 100, 20_000

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD))


def _mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values (the finaliser of a multiply-xorshift hash)."""
    x = (x ^ (x >> np.uint64(33))) * _M3
    x = (x ^ (x >> np.uint64(29))) * _M1
    return x ^ (x >> np.uint64(32))


class Hasher:
    """Fingerprints of texts; keeps the hashes of frequent words."""

    def __init__(self, bits: int = BITS):
        self.bits, self.words = bits, {}

    def _word_hashes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        known = self.words
        if len(known) > KEPT_WORDS:
            known.clear()
        out = []
        for w in words:
            if (h := known.get(w)) is None:
                h = xxhash.xxh64_intdigest(w)
                if len(w) <= 32:
                    known[w] = h
            out.append(h)
        return np.array(out, np.uint64), np.fromiter(map(len, words), np.int64, len(words))

    def fingerprint(self, text: str | None) -> bytes:
        """The fingerprint of a text: bits / 8 bytes."""
        words = _WORD.findall(text or "")
        if not words:
            return bytes(self.bits // 8)
        hashes, lengths = self._word_hashes(words)
        terms, weights = [hashes], [np.minimum(lengths, 8) / 16]
        if len(words) > 1:
            terms.append(hashes[:-1] * _M1 + (hashes[1:] ^ _M2) * _M2)
            weights.append(np.ones(len(words) - 1))
        if len(text) < SHORT:
            points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            if len(points) >= 4:
                terms.append(_mix((points[:-3] << np.uint64(42)) ^ (points[1:-2] << np.uint64(28)) ^ (points[2:-1] << np.uint64(14)) ^ points[3:]))
                weights.append(np.full(len(points) - 3, 0.25))
        return self.vote(np.concatenate(terms), np.concatenate(weights))

    def vote(self, terms: np.ndarray, weights: np.ndarray) -> bytes:
        distinct, first, counts = np.unique(terms, return_index=True, return_counts=True)
        weight = (weights[first] * (1 + np.log(counts))).astype(np.float32)
        total, lane = np.zeros(self.bits, np.float32), 64
        for start in range(0, len(distinct), 65536):
            some, w = distinct[start : start + 65536], weight[start : start + 65536]
            for k in range(self.bits // lane):
                bits = np.unpackbits(_mix(some + np.uint64((k + 1) * int(_M2) % 2**64)).view(np.uint8).reshape(-1, 8), axis=1)
                total[k * lane : (k + 1) * lane] += 2 * (w @ bits) - w.sum()
        return np.packbits(total > 1e-6).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Share of equal bits, from 0 to 1."""
    return 1 - (int.from_bytes(a) ^ int.from_bytes(b)).bit_count() / (8 * len(a))


def edited(text: str, following: str) -> str:
    """`text` with its last quarter replaced by the first code points of the next text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k] if k else text


def _pairs(left: DataFrame, right: DataFrame, radius: int, extra: int, bits: int) -> DataFrame:
    """(a, b, distance) of all different fingerprints, one of each side, within the radius; each pair once.

    A key joins `extra` of radius + extra blocks of bits.  A pair comes from the
    first table that has it, so no distinct is needed afterwards.
    """
    n = radius + extra
    cuts = [bits // 4 * i // n for i in range(n + 1)]  # in hexadecimal digits
    block = lambda c, i: F.substring(c, cuts[i] + 1, cuts[i + 1] - cuts[i])
    choices = list(combinations(range(n), extra))
    tables = F.array(*(F.struct(F.lit(k).alias("t"), F.concat(*(block(F.col("f"), i) for i in own)).alias("key")) for k, own in enumerate(choices)))
    a, b = (x.select("f", F.explode(tables).alias("x")).select("f", "x.t", "x.key").alias(name) for x, name in ((left, "a"), (right, "b")))
    number = lambda c, i: F.conv(F.substring(c, i + 1, 8), 16, 10).cast("bigint")
    distance = sum((F.bit_count(number(F.col("a.f"), i).bitwiseXOR(number(F.col("b.f"), i))) for i in range(0, bits // 4, 8)), F.lit(0))
    first = F.lit(len(choices))
    for k in range(len(choices) - 1, -1, -1):
        same = F.lit(True)
        for i in choices[k]:
            same = same & (block(F.col("a.f"), i) == block(F.col("b.f"), i))
        first = F.when(same, F.lit(k)).otherwise(first)
    met = a.join(b, (F.col("a.t") == F.col("b.t")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.f") != F.col("b.f")) & (distance <= radius) & (first == F.col("a.t")))
    return met.select(F.col("a.f").alias("a"), F.col("b.f").alias("b"), distance.cast("int").alias("distance"))


def _words(f, bits: int) -> list:
    """A hexadecimal fingerprint as 64-bit numbers."""
    number = lambda i: F.conv(F.substring(f, i + 1, 8), 16, 10).cast("bigint")
    return [F.shiftleft(number(i), 32).bitwiseOR(number(i + 8)) for i in range(0, bits // 4, 16)]


def allowances(radius: int, blocks: int) -> list[int]:
    """Differing bits that each block allows (-1: none needed); the allowances + 1 sum to radius + 1."""
    return [(radius + 1) // blocks + (i < (radius + 1) % blocks) - 1 for i in range(blocks)]


def _probed(left: DataFrame, right: DataFrame, radius: int, blocks: int, bits: int) -> DataFrame:
    """As `_pairs`, by looking up each block of a left fingerprint with up to its allowance of bits changed."""
    width = bits // blocks
    if bits % 64 or bits % blocks or 64 % width or width > 32:
        raise ValueError(f"{blocks} blocks don't cut {bits} bits into equal parts of 64-bit words")
    names, allowed = [f"w{i}" for i in range(bits // 64)], allowances(radius, blocks)
    used = [i for i in range(blocks) if allowed[i] >= 0]

    def block(words, i):
        k, within = divmod(i * width, 64)
        return F.shiftrightunsigned(words[k], 64 - width - within).bitwiseAND(F.lit(2**width - 1).cast("bigint"))

    masks = {t: [sum(1 << x for x in c) for k in range(t + 1) for c in combinations(range(width), k)] for t in {allowed[i] for i in used}}
    own = [F.col(n) for n in names]
    numbers = lambda df: df.select(*(w.alias(n) for w, n in zip(_words(F.col("f"), bits), names)))
    key = lambda i: F.lit(i << width).cast("bigint").bitwiseOR(block(own, i))
    changed = lambda i: F.transform(F.array(*(F.lit(m).cast("bigint") for m in masks[allowed[i]])), lambda m: key(i).bitwiseXOR(m))
    a = numbers(left).select(*names, F.explode(F.flatten(F.array(*map(changed, used)))).alias("key")).alias("a")
    b = numbers(right).select(*names, F.explode(F.array(*map(key, used))).alias("key")).alias("b")
    differing = [F.col(f"a.{n}").bitwiseXOR(F.col(f"b.{n}")) for n in names]
    distance = sum((F.bit_count(x) for x in differing), F.lit(0))
    first = F.lit(-1)  # the first block whose allowance the pair meets
    for i in reversed(used):
        first = F.when(F.bit_count(block(differing, i)) <= allowed[i], F.lit(i)).otherwise(first)
    # exchanged at every size: the estimate of a side doesn't know how many keys a row has
    met = a.hint("merge").join(b, (F.col("a.key") == F.col("b.key")) & distance.between(1, radius) & (first == F.shiftright(F.col("a.key"), width)))
    text = lambda side: F.lower(F.concat(*(F.lpad(F.hex(F.col(f"{side}.{n}")), 16, "0") for n in names)))
    return met.select(text("a").alias("a"), text("b").alias("b"), distance.cast("int").alias("distance"))


def _near(left: DataFrame, right: DataFrame, radius: int, extra: int | None, bits: int) -> DataFrame:
    return _probed(left, right, radius, BLOCKS, bits) if extra is None else _pairs(left, right, radius, extra, bits)


def within_radius(fingerprints: DataFrame, column: str = "fingerprint", radius: int = RADIUS, extra: int | None = None, bits: int = BITS) -> DataFrame:
    """All pairs (a, b, distance), a < b, of distinct hexadecimal fingerprints at most `radius` bits apart.

    With `extra`, equal keys of so many of radius + extra blocks are looked up
    instead, without changed bits; that is for a small radius.
    """
    distinct = fingerprints.select(F.col(column).alias("f")).where(F.col("f").isNotNull()).distinct()
    return _near(distinct, distinct, radius, extra, bits).where("a < b")


def searched(fingerprints: DataFrame, queries: DataFrame, column: str = "fingerprint", radius: int = RADIUS, extra: int | None = None, bits: int = BITS) -> DataFrame:
    """For each distinct fingerprint of `queries`, which are rows of `fingerprints`: n_near, how many other rows of `fingerprints` are within the radius."""
    wanted = queries.select(F.col(column).alias("f")).where(F.col("f").isNotNull()).distinct()
    rows = fingerprints.select(F.col(column).alias("f")).where(F.col("f").isNotNull()).groupBy("f").agg(F.count("*").alias("n"))
    pairs = _near(wanted, rows.select("f"), radius, extra, bits)
    met = pairs.join(rows, F.col("b") == F.col("f")).select("a", "n").union(rows.select(F.col("f").alias("a"), F.col("n") - 1))
    return wanted.join(met.groupBy("a").agg(F.sum("n").alias("n_near")), F.col("f") == F.col("a")).select(F.col("f").alias(column), "n_near")


def near_documents(fingerprints: DataFrame, queries: DataFrame, key: str = "doc_id", column: str = "fingerprint", radius: int = RADIUS, extra: int | None = None, bits: int = BITS) -> DataFrame:
    """(key, near_id, distance): the other documents of `fingerprints` within the radius of each of `queries`, exact copies at distance 0."""
    asked, rows = (x.select(F.col(key).alias(i), F.col(column).alias(f)).where(F.col(f).isNotNull()) for x, i, f in ((queries, key, "a"), (fingerprints, "near_id", "b")))
    wanted = asked.select(F.col("a").alias("f")).distinct()
    pairs = _near(wanted, rows.select(F.col("b").alias("f")).distinct(), radius, extra, bits)
    pairs = pairs.union(wanted.select("f", F.col("f").alias("f2"), F.lit(0)))
    return asked.join(pairs, "a").join(rows, "b").where(~F.col(key).eqNullSafe(F.col("near_id"))).select(key, "near_id", "distance").distinct()


def cut_points(docs: DataFrame, key: str) -> list[int]:
    """Ids at which buckets of about BUCKET_ROWS neighbours begin (quantiles; at most MOST_BUCKETS)."""
    ids = docs.select(F.col(key).cast("double").alias("id")).where(F.col("id").isNotNull())
    wanted = max(1, min(MOST_BUCKETS, ids.count() // BUCKET_ROWS))
    if wanted == 1:
        return []
    found = ids.approxQuantile("id", [i / wanted for i in range(1, wanted)], 0.25 / wanted)
    return sorted({min(math.ceil(x), 2**63 - 1) for x in found})  # doubles round the largest ids up, out of range


def with_neighbours(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(bucket, copied, key, text) in buckets of neighbouring ids, each ending with a copy of the next bucket's first row.

    The bucket after the last is the first one.  Rows with a null id have buckets
    of their own (negative), without an order.  Only one exchange carries texts.
    """
    cuts = np.array(cut_points(docs, key), np.int64)

    @F.pandas_udf("bigint")
    def bucket(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, ids.to_numpy(np.int64), side="right"))

    heads = {r["b"]: r["id"] for r in docs.select(F.col(key).alias("id")).where(F.col("id").isNotNull()).withColumn("b", bucket("id")).groupBy("b").agg(F.min("id").alias("id")).collect()}
    order = sorted(heads)
    before = {heads[b]: order[i - 1] for i, b in enumerate(order)}
    place = "array<struct<bucket:bigint,copied:boolean>>"

    @F.pandas_udf(place)
    def places(ids: pd.Series, salt: pd.Series) -> pd.Series:
        out = []
        for i, b, s in zip(ids, np.searchsorted(cuts, ids.fillna(0).to_numpy(np.int64), side="right"), salt):
            if pd.isna(i):
                out.append([{"bucket": -1 - s, "copied": False}])
            else:
                out.append([{"bucket": int(b), "copied": False}, *([{"bucket": before[int(i)], "copied": True}] if int(i) in before else [])])
        return pd.Series(out)

    salt = F.pmod(F.xxhash64(text), F.lit(64)).alias("salt")
    rows = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"), salt)
    rows = rows.select("id", "text", F.explode(places("id", "salt")).alias("p")).select("p.bucket", "p.copied", "id", "text")
    return rows.repartition("bucket").sortWithinPartitions("bucket", "copied", "id", "text")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", bits: int = BITS) -> DataFrame:
    """Key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row.

    A row with a null id has no next document: its edited text is its text, and
    near_next is null.
    """
    prepare(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches):
        hasher, held = Hasher(bits), None
        rows: list[tuple] = []

        def finish(row, following):
            _, _, i, text, own = row
            changed = text if following is None else edited(text, following[3])
            mark = own if changed == text else hasher.fingerprint(changed)
            rows.append((i, len(text), hashlib.sha256(changed.encode()).hexdigest(), own.hex(), mark.hex(), likeness(own, mark), None if following is None else likeness(own, following[4])))

        def full():
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
            rows.clear()
            return out

        for batch in batches:
            for bucket, copied, i, text in zip(*(c.to_pylist() for c in batch.columns)):
                if copied and held is not None and held[1] and held[0] == bucket:
                    continue  # a repeated head
                text = text or ""
                row = (bucket, copied, i, text, hasher.fingerprint(text))
                if held is not None and not held[1]:
                    finish(held, row if held[0] == bucket and bucket >= 0 else None)
                held = row
            if len(rows) >= 1000:
                yield full()
        if held is not None and not held[1]:
            finish(held, None)
        if rows:
            yield full()

    schema = "id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_neighbours(docs, key, text).mapInArrow(run, schema).withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", key)


def report(docs: DataFrame) -> DataFrame:
    """The contract's columns for `documents`; n_near for the stated query set, ids divisible by 50 (else null)."""
    rows = stored(fingerprints(docs), "simhash")
    asked = F.coalesce(F.col("doc_id") % 50 == 0, F.lit(False))
    columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    found = rows.where(asked).join(searched(rows, rows.where(asked)), "fingerprint").select(*columns, "n_near")
    return found.union(rows.where(~asked).select(*columns, F.lit(None).cast("bigint").alias("n_near")))
