"""Language ID: hyperdimensional profiles.

Every letter has a pseudo-random vector of +1 and -1, made from its code point
alone.  A 3-gram is bound by multiplying its letters' vectors after permuting
them by place (two shifts, one, none); a text is the bundle (sum) of its 3-grams;
a language is the bundle of its training texts, less the mean of all languages.
A text gets the language whose prototype has the largest cosine with it.

Bundles are linear, so training only has to count 3-grams by language inside each
partition and add up one vector a language and partition.

`in_language` rejects texts whose cosine is below a cutoff for texts of their
length.  `calibrate` takes the cutoffs from labelled rows that training didn't
see: SLACK of the cosine that all but LOSS of them reach, but at most NOISE, as a
cosine above it can't come from letters at random, however few rows were labelled.

Defined results: a null text, or one without a letter, is `und` with score 0;
ties go to the first language by name; with no labelled text at all everything
is `und`.  Repeated rows count as often as they occur; a row with a null id is judged
but trains nothing; other columns are ignored; an empty table gives an empty one.
Texts of any length are counted whole, in blocks of BLOCK code points and whole texts.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, prepare

#: Dimensions of the vectors, and the seed of the letters' vectors.
DIMENSIONS, SEED = 1024, 20240601
#: 3-gram vectors that a worker keeps (bytes: this times DIMENSIONS).
KEPT_GRAMS = 16_000
UNKNOWN = "und"
#: Share of the labelled rows that a cutoff leaves out of account, and its share of the cosine that the others reach.
LOSS, SLACK = 0.001, 0.5
#: Four deviations of the cosine of unrelated vectors.
NOISE = 4 / DIMENSIONS**0.5
#: Classes of length: below 32 code points, 128, 512, 2048, and the rest.
LENGTHS = 5
#: Code points handled at once; longer batches are split between texts.
BLOCK = 250_000
#: 3-grams whose vectors are multiplied at once.
SOME = 2048


@lru_cache(maxsize=20_000)
def letter(code: int) -> np.ndarray:
    """The vector of a code point (0 is the space between words)."""
    return np.random.default_rng((SEED, code)).integers(0, 2, DIMENSIONS, dtype=np.int8) * 2 - 1


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """The lower-case letter of each code point, or 0 for what isn't a letter."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


class Grams:
    """Vectors of 3-grams by packed code, as rows of one matrix."""

    def __init__(self):
        self.rows: dict[int, int] = {}
        self.matrix = np.empty((1024, DIMENSIONS), np.int8)

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        rows = self.rows
        if len(rows) > KEPT_GRAMS:
            rows.clear()
        at = np.empty(len(codes), np.int64)
        for i, code in enumerate(codes.tolist()):
            if (k := rows.get(code)) is None:
                k = rows[code] = len(rows)
                if k == len(self.matrix):
                    self.matrix = np.concatenate([self.matrix, np.empty_like(self.matrix)])
                a, b, c = code >> 42, code >> 21 & 0x1FFFFF, code & 0x1FFFFF
                self.matrix[k] = np.roll(letter(a), 2) * np.roll(letter(b), 1) * letter(c)
            at[i] = k
        return self.matrix[at]


@lru_cache(maxsize=1)
def grams() -> Grams:
    return Grams()


def count_grams(texts: list[str | None]):
    """(distinct codes, text of each count, index of its code, counts) of the 3-grams of texts.

    A 3-gram is three neighbours among the letters and the single spaces that
    stand for runs of anything else (one at either end of a text); it holds a letter.
    """
    table = _letters()
    joined = "".join(f"\x00{t or ''}\x00" for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t or "") + 2 for t in texts])
    codes = table[points].astype(np.int64)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0) | (owner[1:] != owner[:-1])
    codes, owner = codes[keep], owner[keep]
    a, b, c = codes[:-2], codes[1:-1], codes[2:]
    fits = (owner[:-2] == owner[2:]) & ((a | b | c) != 0)
    packed = (a[fits] << 42) | (b[fits] << 21) | c[fits]
    distinct, index = np.unique(packed, return_inverse=True)
    pair, counts = np.unique(owner[:-2][fits].astype(np.int64) * max(len(distinct), 1) + index, return_counts=True)
    return distinct, (pair // max(len(distinct), 1)).astype(np.int64), (pair % max(len(distinct), 1)).astype(np.int64), counts


def _blocks(texts: list[str | None]):
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size > BLOCK:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def bundles(texts: list[str | None]):
    """(vectors of texts as float32 rows, whether each has a letter)."""
    out, has = np.zeros((len(texts), DIMENSIONS), np.float32), np.zeros(len(texts), bool)
    table = _letters()
    for low, high in _blocks(texts):
        part = texts[low:high]
        distinct, text, gram, counts = count_grams(part)
        for i, t in enumerate(part):
            has[low + i] = bool(t) and bool(table[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)].any())
        if not len(distinct):
            continue
        for first in range(0, len(distinct), SOME):  # bounds the dense matrix
            some = (gram >= first) & (gram < first + SOME)
            vectors = grams().vectors(distinct[first : first + SOME]).astype(np.float32)
            for doc in range(0, len(part), 256):
                mine = some & (text >= doc) & (text < doc + 256)
                if mine.any():
                    dense = np.zeros((min(256, len(part) - doc), len(vectors)), np.float32)
                    dense[text[mine] - doc, gram[mine] - first] = counts[mine]
                    out[low + doc : low + doc + len(dense)] += dense @ vectors
    return out, has


def train(docs: DataFrame, lang: str = "lang", text: str = "text") -> dict[str, np.ndarray]:
    """The prototype of every language in `docs` (rows with a null language are left out).

    Texts are counted whole.  Each partition sends one vector a language; the sums
    of them (languages x DIMENSIONS numbers) come to the driver.
    """
    prepare(docs.sparkSession)

    def partial(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for low, high in _blocks(texts):
                distinct, doc, gram, counts = count_grams(texts[low:high])
                for name in dict.fromkeys(names[low:high]):
                    mine = np.array([n == name for n in names[low:high]])[doc] if len(doc) else np.zeros(0, bool)
                    total = np.bincount(gram[mine], counts[mine], len(distinct)) if len(distinct) else np.zeros(0)
                    for first in range(0, len(distinct), SOME):
                        part = total[first : first + SOME].astype(np.float32) @ grams().vectors(distinct[first : first + SOME]).astype(np.float32)
                        sums[name] = sums.get(name, 0) + part.astype(np.float64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], ["name", "vector"])

    rows = (
        docs.where(F.col(lang).isNotNull()).select(lang, text).mapInArrow(partial, "name string, vector array<double>")
        .select("name", F.posexplode("vector").alias("dimension", "x")).groupBy("name", "dimension").agg(F.sum("x").alias("x"))
        .groupBy("name").agg(F.sort_array(F.collect_list(F.struct("dimension", "x"))).alias("vector")).collect()
    )
    vectors = {r["name"]: np.array([x["x"] for x in r["vector"]]) for r in sorted(rows, key=lambda r: r["name"])}
    unit = {k: v / n for k, v in vectors.items() if (n := np.linalg.norm(v))}
    if len(unit) > 1:  # what all languages share says nothing
        mean = sum(unit.values()) / len(unit)
        unit = {k: (v - mean) / max(np.linalg.norm(v - mean), 1e-12) for k, v in unit.items()}
    return unit


def classify(docs: DataFrame, prototypes: dict[str, np.ndarray], key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, lang_pred and score (cosine, not below 0) of every row."""
    return _classified(docs.select(key, text), prototypes, [key], text)


def length_class(n: int) -> int:
    """The class of a text of n code points, from 0 to LENGTHS - 1."""
    return min(LENGTHS - 1, max(0, n.bit_length() - 4) // 2)


def calibrate(docs: DataFrame, prototypes: dict[str, np.ndarray], lang: str = "lang", text: str = "text") -> list[float]:
    """The cutoff of each class of length, from labelled rows that `train` didn't see.

    A class without rows has the cutoff of the next shorter one, or 0.
    """
    if not prototypes:
        return [0.0] * LENGTHS
    labelled = docs.where(F.col(lang).isNotNull()).select(F.col(text).alias("c0"))
    found = _classified(labelled, prototypes, [], "c0", "length int, letter boolean").where("letter")
    reached = {r["length"]: r["score"] for r in found.groupBy("length").agg(F.percentile_approx("score", LOSS, 100_000).alias("score")).collect()}
    out, last = [], 0.0
    for k in range(LENGTHS):
        last = min(NOISE, SLACK * reached[k]) if k in reached else last
        out.append(last)
    return out


def in_language(docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", cutoffs: list[float] | None = None) -> DataFrame:
    """The documents with a letter whose score reaches the cutoff of their length, with all their columns.

    Without cutoffs, or without prototypes (nothing can be judged), all with a letter stay.
    """
    own = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(own))))  # whatever they are called
    found = _classified(plain, prototypes, plain.columns, f"c{own.index(text)}", "length int, letter boolean")
    if cutoffs and prototypes:
        found = found.where(F.col("score") >= F.element_at(F.array(*map(F.lit, cutoffs)), F.col("length") + 1))
    return found.where("letter").select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(own)))


def _classified(docs: DataFrame, prototypes: dict[str, np.ndarray], keep: list[str], text: str, more: str = "") -> DataFrame:
    names, at = list(prototypes), docs.columns.index(text)
    matrix = np.array([prototypes[k] for k in names], np.float32).reshape(len(names), DIMENSIONS).T
    places = {c: docs.columns.index(c) for c in keep}

    def run(batch):
        texts = batch.column(at).to_pylist()
        vectors, has = bundles(texts)
        norms = np.linalg.norm(vectors, axis=1)
        known = has & (norms > 0) & bool(names)
        cosine = (vectors @ matrix) / np.maximum(norms, 1e-12)[:, None] if names else np.zeros((len(has), 1))
        best = cosine.argmax(axis=1)
        score = np.where(known, np.clip(cosine[np.arange(len(best)), best], 0, 1), 0.0)
        pred = [names[b] if h and names else UNKNOWN for b, h in zip(best, has)]
        lengths = pa.array([length_class(len(t or "")) for t in texts], pa.int32())
        return {"lang_pred": pred, "score": pa.array(score.astype(np.float64)), "length": lengths, "letter": pa.array(has), **{c: batch.column(i) for c, i in places.items()}}

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "lang_pred string", "score double", *([more] if more else [])])
    return map_batches(docs, run, schema)


def held_out(key: Column) -> Column:
    """Whether a document is kept from training."""
    return F.crc32(key.cast("string").cast("binary")) % 5 == 0


def identify(docs: DataFrame) -> DataFrame:
    """The contract's columns for `documents`."""
    held = F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    prototypes = train(docs.where(~held_out(F.col("doc_id"))))  # not from rows without an id
    return classify(docs, prototypes).select("doc_id", held.alias("held_out"), "lang_pred", "score")
