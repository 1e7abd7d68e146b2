"""Quality rules: thresholds with a controlled risk, as DataFrame expressions only.

A rule is a statistic of a text that is large for bad texts, with a fixed grid of
cutoffs from loose to tight.  All rules tighten together: step j of a stratum
(language) rejects a text whose statistic is above the j-th cutoff of any rule.  On
the stratum's labelled documents the steps are tested from the loosest on: step j is
accepted if the exact binomial tail P(Bin(n, alpha) <= k) is at most delta / strata,
where n counts the good documents and k those that the step rejects; testing stops at
the first step that fails.  This fixed order needs no correction inside a stratum
(stopping controls it, and the steps' losses are nested); the Bonferroni factor
corrects between strata.  With probability 1 - delta no stratum then loses more than
a share alpha of its good documents.  A stratum needs log(delta / strata) /
log(1 - alpha) good labels (217 of four strata); without an accepted step it has no
cutoffs, and only the base rules reject.

Defined results: a null text has no words and fails the base rules; documents
without a language form a stratum of their own; a stratum without labels has no
cutoffs; labels that repeat for a document count once, with the lower quality;
repeated documents are judged one by one; a statistic at its cutoff passes; other
columns, of documents and of labels, are ignored; empty tables give an empty one.  Texts of
any length are judged whole, in time n log n in their words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, prepare, stored, words_of

#: Share of good documents that a stratum may lose, and the chance that some stratum loses more.
ALPHA, DELTA = 0.02, 0.05


_STEPS = tuple(round(0.8 - 0.025 * i, 3) for i in range(32))  # 0.8 to 0.025
#: Cutoffs of each rule, from loose to tight; one of each makes a step.
GRIDS: dict[str, tuple[float, ...]] = {
    "symbols": _STEPS, "duplicate_lines": _STEPS, "repeated_words": _STEPS, "capitals": _STEPS, "word_length": tuple(20 - 0.5 * i for i in range(32)),
}
#: The two counts whose quotient is each rule's statistic.
PARTS = {
    "symbols": ("n_symbols", "word_chars"), "duplicate_lines": ("n_dup_lines", "n_lines"), "repeated_words": ("n_repeat_words", "n_words"),
    "capitals": ("n_capitals", "word_chars"), "word_length": ("word_chars", "n_words"),
}


def _rules() -> dict[str, tuple[Column, tuple[float, ...]]]:
    return {name: (F.col(a) / F.greatest(F.col(b), F.lit(1)), GRIDS[name]) for name, (a, b) in PARTS.items()}


def repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window which occurs twice or more.

    The windows are sorted with their places; equal neighbours are repeats.  The
    places of these, in order, cover min(3, distance to the next) words each.
    """

    def covered(places: Column) -> Column:
        own = F.transform(places, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(places, j + 1) - p, F.lit(3))))
        return F.aggregate(own, F.lit(0).cast("bigint"), lambda a, x: a + x)

    def repeats(windows: Column) -> Column:
        ordered = F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
        same = lambda a, b: F.coalesce(a["w"] == b["w"], F.lit(False))
        return let(ordered, lambda s: let(F.sort_array(F.transform(F.filter(s, lambda x, j: same(F.get(s, j - 1), x) | same(F.get(s, j + 1), x)), lambda x: x["i"])), covered))

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 3, F.lit(0).cast("bigint")).otherwise(
        let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("bigint")).otherwise(repeats(w)))
    )


def features(docs: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """Key, stratum and the counts of every document; texts are read once and leave no column."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = let(F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d")))
    counts = let(words_of(whole), lambda w: F.struct(
        F.size(w).cast("long").alias("n"),
        F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("chars"),
        repeat_words(w).alias("repeats"),
    ))
    count = lambda kept: F.length(F.regexp_replace(whole, f"[^{kept}]+", "")).cast("long")
    rows = docs.select(F.col(key), F.col(stratum).alias("stratum"), counts.alias("c"), lines.alias("l"), count("#*$%&|<>").alias("n_symbols"), count("A-Z").alias("n_capitals"))
    return rows.select(
        key, "stratum", F.col("c.n").alias("n_words"), F.col("c.chars").alias("word_chars"), "n_symbols", F.col("l.d").alias("n_dup_lines"),
        F.col("c.repeats").alias("n_repeat_words"), F.col("l.n").alias("n_lines"), "n_capitals",
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def log_tail(n: Column, k: Column, p: Column) -> Column:
    """log P(Bin(n, p) <= k), summed term by term in logarithms (exact but for rounding)."""
    start = F.struct((n * F.log1p(-p)).alias("term"), (n * F.log1p(-p)).alias("total"))

    def add(acc, i):
        term = acc["term"] + F.log((n - i + 1) / i) + F.log(p / (1 - p))
        top = F.greatest(acc["total"], term)
        return F.struct(term.alias("term"), (top + F.log1p(F.exp(F.least(acc["total"], term) - top))).alias("total"))

    return F.when(k >= n, F.lit(0.0)).when(k == 0, n * F.log1p(-p)).otherwise(F.aggregate(F.sequence(F.lit(1), k.cast("int")), start, add, lambda acc: acc["total"]))


def cutoffs(rows: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, key: str = "doc_id") -> DataFrame:
    """(stratum, n_good, step, n_lost) of every stratum with an accepted step."""
    good = labels.groupBy(key).agg(F.min("quality").alias("quality")).where("quality = 1").select(key)
    # the first step that rejects the document: of each rule, how many cutoffs are not below its value
    passed = lambda value, grid: F.size(F.filter(F.array(*map(F.lit, map(float, grid))), lambda c: c >= value))
    first = F.least(*(passed(value, grid) for value, grid in _rules().values()))
    bins = rows.join(good, key).select("stratum", first.alias("first")).groupBy("stratum", "first").agg(F.count("*").alias("n"))
    strata = bins.groupBy("stratum").agg(F.sum("n").alias("n_good"), F.collect_list(F.struct("first", "n")).alias("bins"))  # a bin a step at most
    strata = strata.withColumn("tests", F.count("*").over(Window.partitionBy(F.lit(1))))  # a row a stratum
    tried = strata.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(len(_STEPS) - 1))))
    tried = tried.withColumn("n_lost", F.aggregate(F.filter("bins", lambda x: x["first"] <= F.col("step")), F.lit(0).cast("long"), lambda a, x: a + x["n"]))
    n, k, risk = F.col("n_good"), F.col("n_lost"), F.lit(alpha)
    fits = (k <= risk * n) & (log_tail(n, F.least(k, F.ceil(risk * n)), risk) <= F.log(F.lit(delta) / F.col("tests")))
    order = Window.partitionBy("stratum").orderBy("step")
    accepted = tried.withColumn("fits", fits).withColumn("all_fit", F.min("fits").over(order)).where("all_fit")
    return accepted.groupBy("stratum", "n_good").agg(F.max("step").alias("step"), F.max("n_lost").alias("n_lost"))


def judge(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """Adds base_failed, n_failed (rules above their cutoffs) and kept to the rows of `features`."""
    limits = chosen.select(F.col("stratum").alias("of"), "step")
    above = lambda value, grid: F.when(F.col("step").isNull(), 0).when(value > F.get(F.array(*map(F.lit, map(float, grid))), F.col("step")), 1).otherwise(0)
    failed = sum((above(value, grid) for value, grid in _rules().values()), F.lit(0))
    out = rows.join(limits, F.col("stratum").eqNullSafe(F.col("of")), "left").withColumn("base_failed", base_failed()).withColumn("n_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("n_failed") == 0)).drop("of", "step")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns for `documents`."""
    prepare(docs.sparkSession)
    rows = stored(features(docs), "quality")
    judged = judge(rows, cutoffs(rows, labels))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("n_failed").alias("rules_failed"))


def oracle_sql() -> str:
    """The same in DuckDB's SQL."""
    grid = ", ".join(f"('{name}', {step}, {float(c)})" for name, cs in GRIDS.items() for step, c in enumerate(cs))
    values = " UNION ALL ".join(f"SELECT doc_id, n, stratum, '{name}' AS rule, {a}::DOUBLE / greatest({b}, 1) AS x FROM f" for name, (a, b) in PARTS.items())
    p = ALPHA
    return rf"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS n, coalesce(lang, chr(1)) AS stratum, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
s AS (SELECT n, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
windows AS (SELECT n, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS win FROM s),
again AS (SELECT n, i FROM (SELECT *, count(*) OVER (PARTITION BY n, win) AS c FROM windows) WHERE c > 1),
covered AS (SELECT n, count(DISTINCT i + k) AS c FROM again, (VALUES (0), (1), (2)) AS o(k) GROUP BY n),
f AS (
  SELECT doc_id, w.n, stratum, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, length(regexp_replace(t, '[^A-Z]', '', 'g'))::BIGINT AS n_capitals,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls)::BIGINT AS n_lines, coalesce(c, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN covered ON covered.n = w.n),
grid(rule, step, cutoff) AS (VALUES {grid}),
x AS ({values}),
good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1),
rejected AS (SELECT stratum, n, step, bool_or(x > cutoff) AS lost FROM x JOIN good USING (doc_id) JOIN grid USING (rule) GROUP BY ALL),
tried AS (SELECT stratum, step, count(*) AS n, count(*) FILTER (lost) AS k FROM rejected GROUP BY ALL),
tests AS (SELECT count(DISTINCT stratum) AS m FROM tried),
tail AS (
  SELECT *, CASE WHEN k > {p} * n THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p}) + (n - i) * ln(1 - {p})))) END AS chance
  FROM tried),
fits AS (SELECT *, bool_and(chance <= {DELTA} / (SELECT m FROM tests)) OVER (PARTITION BY stratum ORDER BY step ROWS UNBOUNDED PRECEDING) AS fits FROM tail),
cuts AS (SELECT stratum, max(step) AS step FROM fits WHERE fits GROUP BY stratum),
failed AS (SELECT x.n, count(*) AS c FROM x JOIN cuts USING (stratum) JOIN grid USING (rule, step) WHERE x > cutoff GROUP BY x.n)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND coalesce(c, 0) = 0 AS kept, coalesce(c, 0)::INTEGER AS rules_failed
FROM f LEFT JOIN failed ON failed.n = f.n
"""
