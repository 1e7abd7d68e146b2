"""Mixing sources to target weights: temperature mixing with budgeted block permutations.

The token shares of the sources are raised to an exponent and normalised.  The
exponent is bisected between 0 (equal weights) and 1 (shares as they are): either
to the flattest mixture that repeats no source more than `repeats` times as often
as the least repeated one, or to a target entropy.  The budget of tokens gives
each source its number of epochs; by default it is the least budget with which
every document is used at least once, so that mixing drops nothing.

Whole epochs take every document.  The rest of an epoch takes a prefix of a
permutation: documents lie in hashed blocks, blocks and the documents in them are
in the order of their digests, and the prefix ends at the last document that fits
the source's budget.  Totals are summed along that order in three levels (the first
PREFIX digits of the block's digest, blocks, documents), so that no task sorts a
source: at most 16 ** PREFIX totals, then the blocks behind one prefix, then one block.

Sources may be any number: their totals, shares and weights stay a table, and each
step of the bisection is an aggregate of it (many exponents at once), so the driver
holds a few numbers.  Spark broadcasts the table of sources if it is small by its
measured size, and else exchanges both sides.

Defined results: documents without a source are a source of their own; a null or
empty text has no tokens and goes with its place in the permutation; rows that
repeat an id and text are taken together; with no tokens at all every document is
used once; texts of any length are counted whole; extra columns stay as they are,
whatever they are called (`mixed` replaces a column `_mix`); an empty table gives an
empty one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, prepare, stored

#: How often a source may be repeated against the least repeated one; documents of a block, about.
REPEATS, BLOCK_ROWS = 2.0, 200
#: Hexadecimal digits of the blocks' order that totals are first summed by.
PREFIX = 3
#: Steps of the bisection; exponents that one aggregate tries (each such round is worth log2(TRIED + 1) steps).
STEPS, TRIED = 60, 31


def repeat_exponent(least: float, most: float, repeats: float) -> float:
    """The least exponent from 0 to 1 that repeats no source more than `repeats` times as often as another; shares of the extremes are given."""
    low, high = 0.0, 1.0
    fits = lambda x: (1 - x) * math.log(most / least) <= math.log(repeats)
    if fits(low):
        return low
    for _ in range(STEPS):
        middle = (low + high) / 2
        low, high = (low, middle) if fits(middle) else (middle, high)
    return high


def entropies(shares: DataFrame, exponents: list[float]) -> list[float]:
    """Entropy in nats of the shares `p` (above 0) raised to each exponent and normalised."""
    sums = [x for e in exponents for x in (F.sum(F.pow("p", F.lit(e))), F.sum(F.pow("p", F.lit(e)) * F.log("p")))]
    row = shares.where("p > 0").agg(*(x.alias(f"s{i}") for i, x in enumerate(sums))).first()
    return [math.log(row[2 * i]) - e * row[2 * i + 1] / row[2 * i] for i, e in enumerate(exponents)]


def entropy_exponent(shares: DataFrame, target: float) -> float:
    """The exponent from 0 to 1 whose entropy meets the target; one out of reach gives the nearer end.

    Entropy falls with the exponent.  Every round tries TRIED exponents in one aggregate.
    """
    low, high = 0.0, 1.0
    at_low, at_high = entropies(shares, [low, high])
    if at_low <= target:
        return low
    if at_high > target:
        return high
    for _ in range(math.ceil(STEPS / math.log2(TRIED + 1))):
        tried = [low + (high - low) * (i + 1) / (TRIED + 1) for i in range(TRIED)]
        inside = [x for x, h in zip(tried, entropies(shares, tried)) if h > target]
        above = [x for x in tried if x not in inside]
        low, high = max([low, *inside]), min([high, *above])
    return high


def n_tokens(text: Column) -> Column:
    """White-space words of a text, the unit of the budget."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")).cast("long")


def _digest(*values: Column) -> Column:
    return F.md5(F.concat_ws(":", *values).cast("binary"))


def _number(digest: Column, first: int) -> Column:
    return F.conv(F.substring(digest, first, 8), 16, 10).cast("long")


def sources(rows: DataFrame, repeats: float | None = REPEATS, target_entropy: float | None = None, budget: float | None = None) -> DataFrame:
    """(stratum, weight, epochs, n_blocks, whole, rest) of every source of `rows` (stratum, n_tokens)."""
    totals = stored(rows.groupBy("stratum").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("tokens")), "totals")
    everything = totals.agg(F.sum("tokens").alias("t")).first()["t"] or 0
    shares = totals.withColumn("p", F.col("tokens") / F.lit(float(max(everything, 1))))
    ends = shares.where("p > 0").agg(F.min("p").alias("least"), F.max("p").alias("most")).first()
    if not ends["least"]:
        exponent = 1.0
    elif target_entropy is not None:
        exponent = entropy_exponent(shares, target_entropy)
    else:
        exponent = repeat_exponent(ends["least"], ends["most"], repeats)
    raised = shares.withColumn("r", F.when(F.col("p") > 0, F.pow("p", F.lit(exponent))).otherwise(F.lit(0.0)))
    total = raised.agg(F.sum("r").alias("r")).first()["r"] or 1.0
    weighed = stored(raised.withColumn("weight", F.col("r") / F.lit(float(total))), "weights")
    if budget is None:
        budget = weighed.where("weight > 0").agg(F.max(F.col("tokens") / F.col("weight")).alias("b")).first()["b"] or 0.0
    # the division must not make an exact number of epochs a hair less
    epochs = F.when(F.col("tokens") > 0, F.round(F.col("weight") * F.lit(float(budget)) / F.col("tokens"), 9)).otherwise(F.lit(1.0))
    whole = F.floor("epochs")
    return weighed.withColumn("epochs", epochs).select(
        "stratum", "weight", "epochs", F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK_ROWS)).cast("long").alias("n_blocks"),
        whole.alias("whole"), F.floor((F.col("epochs") - whole) * F.col("tokens")).alias("rest"),
    )


def plan(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 0, **target) -> DataFrame:
    """A row for each source (`stratum`): weight, epochs, n_blocks, whole, rest, last_order and last_digest."""
    prepare(docs.sparkSession)
    rows = stored(docs.select(stratum(source), digest(key, text, seed), n_tokens(F.col(text)).alias("n_tokens")), "tokens")
    chosen = stored(sources(rows, **target), "sources")
    placed = rows.join(chosen.where("rest > 0"), "stratum").withColumn("block", block())
    along = placed.groupBy("stratum", "rest", "block").agg(F.sum("n_tokens").alias("t")).withColumn("order", block_order("stratum", "block", seed)).withColumn("prefix", F.substring("order", 1, PREFIX))
    along = stored(along, "blocks")

    def cut(totals: DataFrame, order: str, *given: str) -> DataFrame:
        """The total in which each source's budget ends, and what is left of the budget there."""
        totals = totals.withColumn("before", F.sum("t").over(Window.partitionBy("stratum", *given).orderBy(order)) - F.col("t"))
        return totals.where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("t") > F.col("rest"))).withColumn("rest", F.col("rest") - F.col("before")).drop("before", "t")

    prefixes = cut(along.groupBy("stratum", "rest", "prefix").agg(F.sum("t").alias("t")), "prefix")
    blocks = stored(cut(along.drop("rest").join(prefixes, ["stratum", "prefix"]), "order", "prefix").select("stratum", "block", "order", F.col("rest").alias("left")), "cuts")
    inside = placed.join(blocks, ["stratum", "block"]).groupBy("stratum", "order", "left", "digest").agg(F.sum("n_tokens").alias("t"))
    fits = inside.withColumn("upto", F.sum("t").over(Window.partitionBy("stratum").orderBy("digest"))).where(F.col("upto") <= F.col("left"))
    last = fits.groupBy("stratum").agg(F.max("digest").alias("last_digest"))
    return chosen.join(blocks.select("stratum", F.col("order").alias("last_order")), "stratum", "left").join(last, "stratum", "left")


def stratum(source: str = "source") -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("")).alias("stratum")


def digest(key: str, text: str, seed: int) -> Column:
    """A document's place in the permutations of its source."""
    return _digest(F.lit(seed).cast("string"), F.coalesce(F.col(key).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))).alias("digest")


def block() -> Column:
    return _number(F.col("digest"), 25) % F.col("n_blocks")


def block_order(stratum: str, block: str | Column, seed: int) -> Column:
    return _digest(F.lit(seed).cast("string"), F.col(stratum), (F.col(block) if isinstance(block, str) else block).cast("string"))


def _copied(docs: DataFrame, key: str, text: str, source: str, seed: int, target: dict) -> DataFrame:
    """The documents with columns c0, c1, ..., whatever they are called, and `mix`: struct<weight, epochs, copies>."""
    choice = stored(plan(docs, key, text, source, seed=seed, **target), "plan")
    rows = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    name = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = rows.withColumn("digest", digest(name[key], name[text], seed)).withColumn("own", stratum(name[source]))
    rows = rows.join(choice, F.col("own") == F.col("stratum"))
    order = block_order("stratum", block(), seed)
    inside = (order < F.col("last_order")) | ((order == F.col("last_order")) & (F.col("digest") <= F.coalesce("last_digest", F.lit(""))))
    copies = (F.col("whole") + F.coalesce(inside, F.lit(False)).cast("int")).cast("long")
    return rows.select(*name.values(), F.struct("weight", "epochs", copies.alias("copies")).alias("mix"))


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 0, **target) -> DataFrame:
    """The documents and `_mix`: struct<weight, epochs, copies>, copies being how often the mixture has each."""
    own = docs.columns
    out = _copied(docs, key, text, source, seed, target)
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(own) if c != "_mix"), F.col("mix").alias("_mix"))


def realised(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 0, **target) -> DataFrame:
    """The mixture: every document as often as its copies, with the columns of `docs`."""
    own = docs.columns
    out = _copied(docs, key, text, source, seed, target).where("mix.copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("mix.copies").cast("int"))))
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(own)))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, source, n_tokens, weight, epochs and copies of every document."""
    return mixed(docs.select("doc_id", "text", "source")).select(
        "doc_id", "source", n_tokens(F.col("text")).alias("n_tokens"), F.round("_mix.weight", 9).alias("weight"), F.round("_mix.epochs", 9).alias("epochs"), F.col("_mix.copies").alias("copies")
    )


ORACLE_SQL = rf"""
WITH docs AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS stratum, md5('0:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS digest,
         len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> ''))::BIGINT AS n_tokens
  FROM documents),
totals AS (SELECT stratum, count(*) AS n, sum(n_tokens)::DOUBLE AS tokens FROM docs GROUP BY stratum),
shares AS (SELECT *, tokens / sum(tokens) OVER () AS p FROM totals),
exponent AS (SELECT greatest(0.0, 1 - ln({REPEATS}) / ln(max(p) / min(p))) AS x FROM shares WHERE p > 0 HAVING max(p) > min(p)),
raised AS (SELECT s.*, CASE WHEN p > 0 THEN pow(p, coalesce((SELECT x FROM exponent), 0.0)) ELSE 0.0 END AS r FROM shares s),
weighed AS (SELECT *, r / sum(r) OVER () AS weight FROM raised),
budget AS (SELECT max(tokens / weight) AS b FROM weighed WHERE weight > 0),
epoch AS (SELECT stratum, n, tokens, weight, CASE WHEN tokens > 0 THEN round(weight * (SELECT b FROM budget) / tokens, 9) ELSE 1.0 END AS epochs, greatest(1, ceil(n / {BLOCK_ROWS}.0))::BIGINT AS n_blocks FROM weighed),
sources AS (SELECT *, floor(epochs)::BIGINT AS whole, floor((epochs - floor(epochs)) * tokens) AS rest FROM epoch),
placed AS (SELECT d.*, s.weight, s.epochs, s.whole, s.rest, ('0x' || substr(d.digest, 25, 8))::BIGINT % s.n_blocks AS block FROM docs d JOIN sources s USING (stratum)),
ordered AS (SELECT *, md5('0:' || stratum || ':' || block::VARCHAR) AS block_order FROM placed),
running AS (SELECT *, sum(n_tokens) OVER (PARTITION BY stratum ORDER BY block_order, digest RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
            sum(n_tokens) OVER (PARTITION BY stratum ORDER BY block_order RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS block_upto FROM ordered),
cut AS (SELECT stratum, min(block_order) AS last_order FROM running WHERE rest > 0 AND block_upto > rest GROUP BY stratum)
SELECT doc_id, source, n_tokens, round(weight, 9) AS weight, round(epochs, 9) AS epochs,
       (whole + CASE WHEN rest > 0 AND (block_order < last_order OR (block_order = last_order AND upto <= rest)) THEN 1 ELSE 0 END)::BIGINT AS copies
FROM running LEFT JOIN cut USING (stratum)
"""
