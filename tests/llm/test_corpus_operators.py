"""The operators that look at the corpus as a whole, against brute force on small tables."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from flowspark.llm import lsh_forest, mixing, quality_rules
from tests.llm.test_text_operators import ODD, WORD, documents


def _links(texts, percent, size):
    """Least id that each id reaches, by comparing all pairs."""
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for i, t in texts.items():
        w = WORD.findall((t or "").translate(low))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    least = {i: i for i in texts}

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    for a in texts:
        for b in texts:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                least[y] = x
    return {i: root(i) for i in texts}, {i: len(s) for i, s in sets.items()}


def _families(rng, families, copies, words):
    out = []
    for _ in range(families):
        base = [rng.choice("abcdefghij") + str(rng.randint(0, 300)) for _ in range(words)]
        for k in range(copies):
            own = list(base)
            for _ in range(rng.randint(0, max(1, words // 25))):
                own[rng.randrange(words)] = f"new{rng.randint(0, 9999)}"
            out.append(" ".join(own) if k % 4 else " ".join(own).upper())
    return out


@pytest.mark.parametrize(("percent", "size"), [(85, 3), (80, 5)])
def test_near_duplicates(spark, monkeypatch, percent, size):
    monkeypatch.setattr(lsh_forest, "BLOCK", 8)  # many blocks inside a region
    rng = random.Random(11)
    texts = dict(enumerate([*ODD, "Two words", "two WORDS", *_families(rng, 6, 20, 60)]))
    want, sizes = _links(texts, percent, size)
    rows = lsh_forest.near_duplicates(documents(spark, list(texts.values()), repeat=False), percent, size).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(texts)
    assert {i: r.n_shingles for i, r in got.items()} == sizes
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_near_duplicates_odd_tables(spark):
    assert lsh_forest.report(documents(spark, [])).count() == 0
    assert [r.kept for r in lsh_forest.report(documents(spark, ["a b c d"])).collect()] == [True, True]
    null_id = spark.createDataFrame([(None, "a b c d"), (3, "a b c d")], "doc_id bigint, text string")
    assert sorted((r.doc_id or -1, r.component_id, r.kept) for r in lsh_forest.report(null_id).collect()) == [(-1, 3, False), (3, 3, True)]


def test_near_duplicates_among_boilerplate(spark, monkeypatch):
    """Texts that share three quarters of their words in a row, and planted pairs among them."""
    monkeypatch.setattr(lsh_forest, "BLOCK", 8)
    monkeypatch.setattr(lsh_forest, "CHUNK", 16)
    rng = random.Random(3)
    common = [f"c{rng.randrange(10**6)}" for _ in range(120)]
    texts, pairs = {}, set()
    for k in range(120):
        own = common + [f"u{rng.randrange(10**6)}" for _ in range(rng.choice([12, 25, 40]))]
        texts[len(texts)] = " ".join(own)
        if k % 6 == 0:
            at = rng.randrange(len(own) - 4)
            own[at] = "changed"
            pairs.add((len(texts) - 1, len(texts)))
            texts[len(texts)] = " ".join(own)
    want, _ = _links(texts, 85, 3)
    got = {r.doc_id: r.component_id for r in lsh_forest.near_duplicates(documents(spark, list(texts.values()), repeat=False)).collect()}
    assert got == want and all(want[a] == want[b] for a, b in pairs)


def test_neighbours_meet_across_partitions(spark):
    """Two rows with equal labels are candidates wherever partitions are cut."""
    tool = lsh_forest.Shingler(3)
    rows = []
    for i in range(60):
        labels, sketch = lsh_forest.signature(tool.shingles([b"w%d" % (100 * (i // 2) + k) for k in range(30)]))
        rows.append((i, bytearray(labels), bytearray(sketch)))
    frame = spark.createDataFrame(rows, "id bigint, labels binary, sketch binary")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "59")
    try:
        found = {(r.a, r.b): r.n for r in lsh_forest.neighbours(frame, 85).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert found.keys() == {(2 * k, 2 * k + 1) for k in range(30)} and all(n >= lsh_forest.TREES for n in found.values())


def test_rows_that_repeat_or_lack_an_id(spark):
    long = " ".join(f"w{k}" for k in range(60))
    near, other = long.replace("w30", "x"), " ".join(f"v{k}" for k in range(60))
    rows = [(5, long, "a"), (5, other, "b"), (5, other, "c"), (3, near, "d"), (None, long.upper(), "e"), (None, "only here now yes", "f"), (None, "only here now yes", "f"), (7, None, "g"), (7, " ", "h"), (None, "", "i")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, k0 string")
    got = sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in lsh_forest.near_duplicates(docs, 80, 5).collect())
    assert got == sorted([(5, 3, False), (5, 5, True), (5, 5, True), (3, 3, True), (-1, 3, False), (-1, -1, False), (-1, -1, False), (7, 7, True), (7, 7, True), (-1, -1, False)])
    kept = sorted(r.k0 for r in lsh_forest.deduplicated(docs).collect())
    assert kept == ["b", "d", "f", "g", "h", "i"]
    assert lsh_forest.deduplicated(docs).columns == docs.columns
    assert lsh_forest.deduplicated(docs.where("false")).count() == 0


def test_filters_follow_the_limit():
    for percent in (80, 85):
        t, d = percent / 100, lsh_forest.shared_prefix(percent)
        assert (1 - t**d) ** lsh_forest.TREES <= lsh_forest.MISSED < (1 - t ** (d + 1)) ** lsh_forest.TREES
        for n in (32, 192):
            k = lsh_forest.least_equal(n, percent)
            tail = lambda k: sum(math.comb(n, i) * t**i * (1 - t) ** (n - i) for i in range(k))  # noqa: E731, B023
            assert tail(k) <= lsh_forest.MISSED < tail(k + 1)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 200) if i != 100] + [(5, 5)], "a bigint, b bigint")
    got = {r.id: r.component for r in lsh_forest.components(edges).collect()}
    assert got == {i: 1 if i <= 100 else 101 for i in range(1, 201)}


def _features(text):
    text = text or ""
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    seen = Counter(zip(words, words[1:], words[2:]))
    covered = {k for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_features(spark):
    rng = random.Random(2)
    texts = [*ODD, *(" ".join(rng.choice(["a", "b", "c#", "d\n", "\n"]) for _ in range(rng.randint(0, 90))) for _ in range(200))]
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in quality_rules.report(documents(spark, texts), labels).collect()}
    for i, t in enumerate(texts):
        f, r = _features(t), got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == f
        assert r.base_failed == (f[0] < 50 or 100 * f[4] > 50 * f[0]) and r.kept == (not r.base_failed)
    assert quality_rules.report(documents(spark, []), labels).count() == 0


def test_quality_cutoffs_follow_the_exact_bound(spark):
    rng = random.Random(4)
    rows = [(i, "en", 100, 500, rng.choice([0] * 300 + [60, 200]), 0, 0, 10, rng.choice([5] * 400 + [450])) for i in range(4000)]
    rows += [(5000 + i, "de", 100, 500, 0, 0, 0, 10, 5) for i in range(80)]  # too few labels
    frame = spark.createDataFrame(rows, "doc_id bigint, stratum string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_lines bigint, n_capitals bigint")
    labels = spark.createDataFrame([(r[0], 1, "clash") for r in rows] + [(3, 1, "x"), (7, 0, "x"), (None, 1, "x")], "doc_id bigint, quality int, stratum string")
    got = {r.stratum: (r.step, r.n_lost, r.n_good) for r in quality_rules.cutoffs(frame, labels.drop("stratum")).collect()}
    limit = quality_rules.DELTA / 2

    def tail(k, n, p):
        return sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))

    good, best = [r for r in rows if r[1] == "en" and r[0] != 7], None
    for step in range(32):
        cut = {name: grid[step] for name, grid in quality_rules.GRIDS.items()}
        lost = sum(r[4] / 500 > cut["symbols"] or r[8] / 500 > cut["capitals"] or 5 > cut["word_length"] for r in good)
        if lost > quality_rules.ALPHA * len(good) or tail(lost, len(good), quality_rules.ALPHA) > limit:
            break
        best = (step, lost, len(good))
    assert got == {"en": best} and best[1] > 0
    judged = {r.doc_id: r for r in quality_rules.judge(frame, quality_rules.cutoffs(frame, labels)).collect()}
    cut = {name: grid[best[0]] for name, grid in quality_rules.GRIDS.items()}
    for r in rows:
        n = sum([r[4] / 500 > cut["symbols"], r[8] / 500 > cut["capitals"], 5 > cut["word_length"]]) if r[1] == "en" else 0
        assert (judged[r[0]].n_failed, judged[r[0]].kept) == (n, n == 0)


def test_quality_sql_with_accepted_cutoffs(spark):
    """The statement and the query agree where cutoffs reject; sf0.01 has them for one language."""
    duckdb = pytest.importorskip("duckdb")
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    rows = quality_rules.features(docs).cache()
    assert quality_rules.cutoffs(rows, labels).count() >= 1
    base = duckdb.connect()
    for n in ("documents", "labels"):
        base.execute(f"CREATE VIEW {n} AS SELECT * FROM '{folder}/{n}.parquet'")
    got = quality_rules.report(docs, labels)
    names = got.columns
    want = sorted(base.execute(f"SELECT {', '.join(names)} FROM ({quality_rules.oracle_sql()})").fetchall())
    assert sorted(map(tuple, got.collect())) == want
    assert any(r.rules_failed and not r.base_failed for r in got.collect())


def test_mixing_targets(spark):
    shares = {"a": 0.7, "b": 0.2, "c": 0.1, "none": 0.0}
    x = mixing.repeat_exponent(0.1, 0.7, 2.0)
    epochs = [p**x / p for p in shares.values() if p]
    assert max(epochs) / min(epochs) == pytest.approx(2.0, abs=1e-9)
    frame = spark.createDataFrame(list(shares.items()), "s string, p double")
    y = mixing.entropy_exponent(frame, 1.0)
    raised = [p**y for p in shares.values() if p]
    assert -sum(r / sum(raised) * math.log(r / sum(raised)) for r in raised) == pytest.approx(1.0, abs=1e-9)
    assert mixing.repeat_exponent(1.0, 1.0, 2.0) == 0.0 and mixing.entropy_exponent(frame, 9.0) == 0.0 and mixing.entropy_exponent(frame, 0.0) == 1.0


def test_mixing_many_sources_and_clashing_names(spark):
    rows = [(i, "w " * (1 + i % 5), f"s{i % 3000}", i, "x", 2.0, "y", 1) for i in range(9000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, _mix bigint, _mix_plan string, _mix_digest double, stratum string, mix int")
    out = mixing.realised(docs)
    assert out.columns == docs.columns and {r.doc_id for r in out.select("doc_id").collect()} == set(range(9000))
    assert sorted(map(tuple, out.distinct().collect())) == sorted(map(tuple, docs.collect()))
    assert mixing.mixed(docs).columns == [c for c in docs.columns if c != "_mix"] + ["_mix"]
    assert mixing.sources(docs.select(mixing.stratum("source"), mixing.n_tokens(F.col("text")).alias("n_tokens"))).count() == 3000
    flat = mixing.sources(docs.select(mixing.stratum("source"), mixing.n_tokens(F.col("text")).alias("n_tokens")), target_entropy=99.0).collect()
    assert max(r.weight for r in flat) == pytest.approx(min(r.weight for r in flat))


def test_mixing_meets_the_budget(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)), rng.choice(["hot"] * 8 + ["b", "c", None]), 1.5, "y") for i in range(3000)]
    docs = spark.createDataFrame([*rows, (1, None, "b", None, None)], "doc_id bigint, text string, source string, weight double, digest string")
    out = mixing.mixed(docs).collect()
    assert len(out) == len(rows) + 1 and min(r._mix.copies for r in out) >= 1
    used, have, epochs = Counter(), Counter(), {}
    for r in out:
        n = len((r.text or "").split())
        used[r.source] += n * r._mix.copies
        have[r.source] += n
        epochs[r.source] = r._mix.epochs
    for s in have:  # short of the target by less than a document
        assert 0 <= epochs[s] * have[s] - used[s] <= 40
    again = mixing.realised(docs)
    assert again.columns == docs.columns and again.count() == sum(r._mix.copies for r in out)
    empty = docs.where("false")
    assert mixing.realised(empty).count() == 0 and mixing.report(empty).count() == 0
    dropped = mixing.realised(docs, budget=1000.0)
    assert 0 < dropped.count() < 3001
