"""Near copies, decontamination, rules, classifiers and mixing against brute force."""

from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimscope.llm import common, decontaminate, mixing, neardup, oracles, quality, queries, rules, textstats, toxicity
from conftest import SF01, SF001
from llm_docs import docs  # noqa: F401
from oracle_compare import compare, duck

RNG = random.Random(7)
WORDS = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(2, 6))) for _ in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng, text, edits):
    words = text.split(" ")
    for _ in range(edits):
        words[rng.randrange(len(words))] = rng.choice(WORDS) + "q"
    return " ".join(words)


# ---------------------------------------------------------------- near copies


def _sets(texts):
    owner, h, w, _ = neardup.Shingler().sets(texts)
    cut = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [(h[a:b], w[a:b]) for a, b in zip(cut[:-1], cut[1:])]


def test_probability_jaccard_against_its_definition():
    rng = random.Random(1)
    for _ in range(50):
        a = {rng.randrange(20): rng.choice([1.0, 1.7, 2.1]) for _ in range(rng.randint(1, 12))}
        b = {rng.randrange(20): rng.choice([1.0, 1.7, 2.1]) for _ in range(rng.randint(1, 12))}
        want = sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in {*a, *b}) for i in a.keys() & b.keys())
        x, y = (np.array(sorted(m), dtype=np.uint64) for m in (a, b))
        got = neardup.probability_jaccard(x, np.array([a[i] for i in x]), y, np.array([b[i] for i in y]))
        assert got == pytest.approx(want)


def test_signatures_estimate_the_similarity():
    rng = random.Random(2)
    base = prose(rng, 300)
    texts = [base, edited(rng, base, 5), edited(rng, base, 20), base + " " + " ".join([base[:60]] * 5), prose(rng, 300), "one two"]
    owner, h, w, _ = neardup.Shingler().sets(texts)
    sig = neardup.signatures(owner, h, w, len(texts), 2000)
    sets = _sets(texts)
    for i, j in itertools.combinations(range(len(texts)), 2):
        exact = neardup.probability_jaccard(*sets[i], *sets[j])
        assert abs((sig[i] == sig[j]).mean() - exact) < 0.05


def _brute_classes(rows, threshold=0.8):
    ids = [d for d, _ in rows]
    sets = _sets([t for _, t in rows])
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        same_id = ids[i] == ids[j] and ids[i] is not None
        if same_id or len(sets[i][0]) and neardup.probability_jaccard(*sets[i], *sets[j]) >= threshold - 1e-9:
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    out = {}
    for i, d in enumerate(ids):
        members = [ids[k] for k in range(len(ids)) if find(k) == find(i) and ids[k] is not None]
        out[d] = min(members, default=None)
    return out


def test_classes_equal_brute_force(docs):
    rng = random.Random(3)
    passage = prose(rng, 60)
    rows = []
    # A family whose members straddle the threshold, families that share a passage, singles.
    base = prose(rng, 120)
    rows += [(i, edited(rng, base, rng.randint(0, 5))) for i in range(100, 160)]
    for f in range(5):
        own = prose(rng, 90)
        rows += [(200 + 20 * f + k, edited(rng, own + " " + passage, rng.randint(0, 3))) for k in range(8)]
    rows += [(400 + i, prose(rng, rng.randint(1, 80))) for i in range(40)]
    rows += [(900, "Same  TEXT, here it is now"), (901, "same text here it is now"), (902, "ab"), (903, "ab"), (904, " ".join(["spam line of words here"] * 300))]
    rng.shuffle(rows)
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs(rows)).collect()}
    assert got == _brute_classes(rows)


def test_prefix_join_alone_loses_no_pair(spark, docs):
    """All members in one bucket and no hub rounds: only the prefix join finds the links."""
    rng = random.Random(4)
    base = prose(rng, 100)
    rows = [(i, edited(rng, base, rng.randint(0, 4)) + (" " + " ".join([base[:40]] * 3)) * (i % 5 == 0)) for i in range(60)]
    sets = neardup.shingle_sets(docs(rows).select(F.col("doc_id").alias("node"), "text"))
    members = spark.createDataFrame([(1, d) for d, _ in rows], "key long, node long")
    got = {r.node: r.label for r in neardup.linked(members, sets, 0.8, rounds=0).collect()}
    assert {d: got.get(d, d) for d, _ in rows} == _brute_classes(rows)


def test_prefix_join_takes_each_text_of_a_repeated_id(spark, docs):
    """A short text beside a long one of the same id: its shared shingles are early in it alone."""
    rng = random.Random(14)
    base = prose(rng, 100)
    rows = [(1, base), (1, prose(rng, 1000)), (2, edited(rng, base, 1)), (3, prose(rng, 100))]
    sets = neardup.shingle_sets(docs(rows).select(F.col("doc_id").alias("node"), "text"))
    members = spark.createDataFrame([(1, d) for d in (1, 2, 3)], "key long, node long")
    got = {r.node: r.label for r in neardup.linked(members, sets, 0.8, rounds=0).collect()}
    assert got == {1: 1, 2: 1}


def test_near_copies_edge_cases(docs):
    long = prose(random.Random(5), 30_000)
    rows = [(1, None), (2, ""), (3, " .,! "), (None, "a b c d e f"), (5, "a b c d e f"), (6, "A b c d e f!"), (7, long), (8, long + " end"), (5, "a b c d e f"), (9, "x y z w v u"), (6, "x y z w v u"), (None, None)]
    got = sorted(((r.doc_id, r.class_id) for r in neardup.near_duplicates(docs(rows)).collect()), key=repr)
    want = [(1, 1), (2, 2), (3, 3), (None, 5), (5, 5), (5, 5), (6, 5), (6, 5), (9, 5), (7, 7), (8, 7), (None, None)]
    assert got == sorted(want, key=repr)
    kept = sorted(r.doc_id for r in neardup.keep_one(docs(rows)).collect() if r.doc_id is not None)
    assert kept == [1, 2, 3, 5, 7]
    assert neardup.near_duplicates(docs([])).collect() == []


def test_near_copies_take_few_texts_at_a_time(spark, docs, monkeypatch):
    """Each step with Python workers bounds their Arrow batches; classes do not depend on the bound."""
    rng = random.Random(15)
    base = prose(rng, 100)
    rows = [(i, edited(rng, base, rng.randint(0, 4))) for i in range(30)] + [(100 + i, prose(rng, 40)) for i in range(30)]
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, sizes, kept = spark.conf.get(name), {}, neardup.staged
    monkeypatch.setattr(neardup, "TEXTS", 7)
    monkeypatch.setattr(neardup, "staged", lambda df, n: sizes.setdefault(n, set()).add(int(spark.conf.get(name))) or kept(df, n))
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs(rows).coalesce(1)).collect()}
    assert got == _brute_classes(rows)
    assert sizes["signed"] == sizes["sets"] == sizes["found"] == {7} and spark.conf.get(name) == before


def test_words_are_hashed_alike_wherever_they_stand():
    shingler = neardup.Shingler(1)
    texts = ["été a b a", "b été", "", "a " * 300, None]
    owner, h, _, content = shingler.sets(texts)
    alone = {w: neardup.Shingler(1).sets([w])[1][0] for w in ("été", "a", "b")}
    assert {(int(o), x) for o, x in zip(owner, h)} == {(k, alone[w]) for k, t in enumerate(texts) for w in (t or "").split()}
    assert not content[[2, 4]].any() and not vars(shingler).keys() - {"size"}  # no words are kept from text to text


# ---------------------------------------------------------------- SQL oracles


@pytest.mark.parametrize("key", list(oracles.ORACLE_SQL))
def test_query_equals_sql(spark, key):
    ok, msg = compare(spark, duck(SF001), key, queries.queries()[key], oracles.ORACLE_SQL[key], SF001)
    assert ok, msg


def _brute_contamination(text, windows):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hit, items = set(), set()
    for win, owners in windows.items():
        for s in range(len(words) - len(win) + 1):
            if tuple(words[s : s + len(win)]) == win:
                hit.update(range(s, s + len(win)))
                items |= owners - {None}
    return len(words), len(hit), sorted(items)


@pytest.mark.parametrize("limit", [0, 64 << 20])
def test_contamination_cases(spark, docs, limit):
    rng = random.Random(6)
    items = [(1, prose(rng, 25)), (2, "Only Three Words"), (3, None), (4, "!!"), (5, prose(rng, 10)), (None, "a b c"), (6, "Only three  words"), (7, "Émile école É")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit("x"))
    one = items[0][1]
    rows = [
        (1, f"x {one.upper()} y"), (2, None), (3, ""), (4, "only three words only THREE words"), (5, " ".join(one.split()[3:14])),
        (6, " ".join(one.split()[3:12])), (7, prose(rng, 20_000) + " " + items[4][1]), (1, "clean text"), (1, f"x {one.upper()} y"),
        (None, one), (8, "émile école é"), (9, "Émile école É"), (10, "z a b c z"), (11, "only three words a b c"),
    ]
    windows = {}
    for d, t in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        for k in range(max(len(w) - 9, 1)):
            if w:
                windows.setdefault(tuple(w[k : k + 10]), set()).add(None if d is None else str(d))
    got = decontaminate.contamination(docs(rows), bench, broadcast_bytes=limit).collect()
    want = sorted(((d, *_brute_contamination(t, windows)) for d, t in rows), key=repr)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got), key=repr) == want
    assert all(r.contaminated == (r.n_hit > 0) for r in got)
    assert decontaminate.contamination(docs([]), bench, broadcast_bytes=limit).collect() == []
    assert not any(r.contaminated for r in decontaminate.contamination(docs(rows), bench.limit(0), broadcast_bytes=limit).collect())


def test_native_operators_run_no_python(spark, docs):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    for frame in (rules.judge(docs([(1, "a")])), decontaminate.contamination(docs([(1, "a")]), bench)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_contamination_sends_no_rows_through_python(spark, docs, monkeypatch):
    frame, bench = docs([(1, "x a b c"), (2, "d")]), spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    frame, bench = (common.staged(x, "given") for x in (frame, bench))
    monkeypatch.setattr(type(spark), "createDataFrame", lambda *a, **b: pytest.fail("rows made in the driver"))
    found = decontaminate.contamination(frame, bench).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit) for r in found) == [(1, 4, 3), (2, 1, 0)]


# ---------------------------------------------------------------- rules


def _repeat_words(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    wins = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {p for i, x in enumerate(wins) if wins.count(x) > 1 for p in range(i, i + 3)}
    return len(hit)


def test_rules_cases(docs):
    rng = random.Random(8)
    texts = [None, "", "a b c", "a b c a b c", "a a a a", "x y z\nx y z\n\n x\n \n", " ".join("the of and to".split() * 30), "é ü 日本 # $$ <a>|b"]
    texts += [" ".join(rng.choice("a b c d".split()) for _ in range(rng.randint(3, 40))) for _ in range(20)]
    rows = [(i, t, None if i % 3 == 0 else "en") for i, t in enumerate(texts)] + [(None, "a b", "en"), (3, "dup", None)]
    got = rules.judge(docs(rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id not in (None, 3)}
    for i, t in enumerate(texts):
        if i == 3:
            continue
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x]
        lines = [x for x in (t or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        r = by[i]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), _repeat_words(t or ""))
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert rules.judge(docs([])).collect() == []
    alone = rules.judge(docs([(1, prose(rng, 80), None)])).first()
    assert alone.kept and alone.char_distance is None


def test_rules_separate_junk(spark):
    got = rules.judge(spark.read.parquet(f"{SF01}/documents.parquet"))
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    share = {r.quality: r.kept for r in got.join(labels, "doc_id").where(~F.col("base_failed")).groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert share[1] > 0.98 and share[0] < 0.6


# ---------------------------------------------------------------- classifiers


def _auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    return (rank[y == 1].mean() - (y.sum() - 1) / 2) / max((y == 0).sum(), 1)


@pytest.mark.parametrize("name, label, least", [("op1_additive_quality", "quality", 0.97), ("op7_toxic_neighbours", "toxic", 0.85)])
def test_held_out_accuracy(spark, name, label, least):
    found = queries.queries()[name](spark, SF01).toPandas()
    n = spark.read.parquet(f"{SF01}/documents.parquet").count()
    assert len(found) == n and found["score"].between(0, 1).all()
    assert (found["predicted"] == (found["score"] >= 0.7)).all()
    labels = spark.read.parquet(f"{SF01}/labels.parquet").toPandas()
    both = found[found["held_out"]].merge(labels, on="doc_id")
    assert _auc(both["score"].to_numpy(), both[label].to_numpy()) > least


def test_additive_score_is_the_sum_of_its_tables():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 3))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    model = quality.fit_additive(x, y, rounds=40, pairs=2)
    assert (0, 1) in model.pairs
    assert ((model.score(x) > 0.5) == (y == 1)).mean() > 0.85
    row = x[:1]
    z = model.base + sum(t[np.searchsorted(e, row[0, f], side="right")] for f, (t, e) in enumerate(zip(model.tables, model.edges)))
    z += sum(t[tuple(np.searchsorted(model.coarse[f], row[0, f], side="right") for f in p)] for p, t in zip(model.pairs, model.pair_tables))
    assert model.score(row)[0] == pytest.approx(1 / (1 + np.exp(-z)))


CASES = [(1, None), (2, ""), (3, "word"), (None, "word"), (3, "word"), (4, "long " * 50_000), (5, "\n\n ### 日本")]


def test_classifier_cases(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(60)] + [(None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    texts = docs([(i, "good fine text here " * 9 if i % 2 else "idiotic moronic stuff " * 9) for i in range(60)])
    m = quality.fit(texts, labels, "quality", F.lit(True))
    got = quality.score(docs(CASES), m).collect()
    assert sorted(map(repr, (r.doc_id for r in got))) == sorted(repr(d) for d, _ in CASES)
    assert quality.score(docs([]), m).collect() == [] and all(0 <= r.score <= 1 for r in got)
    none = quality.fit(texts, labels.limit(0), "quality", F.lit(True))
    assert {r.score for r in quality.score(docs(CASES), none).collect()} == {0.5}
    t = toxicity.fit(texts, labels, "toxic", F.lit(True))
    got = toxicity.score(docs([*CASES, (9, "you idiotic thing")]), t).collect()
    assert len(got) == len(CASES) + 1 and all(0 <= r.score <= 1 for r in got)
    worst = max(got, key=lambda r: r.score)
    assert worst.doc_id == 9 and worst.evidence and worst.evidence[0].cosine <= 1 + 1e-9
    assert toxicity.score(docs([]), t).collect() == []
    empty = toxicity.fit(texts, labels.limit(0), "toxic", F.lit(True))
    assert len({r.score for r in toxicity.score(docs(CASES), empty).collect()}) == 1


def test_block_index_is_exact():
    rng = np.random.default_rng(1)
    vectors = []
    for _ in range(700):
        t = np.sort(rng.choice(60, size=rng.integers(1, 8), replace=False))
        w = rng.random(len(t)) + 0.1
        vectors.append((t, w / np.sqrt((w**2).sum())))
    index = toxicity.BlockMaxIndex(vectors, 60)
    dense = np.zeros((700, 60))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    for t, w in vectors[:60]:
        who, cos = index.nearest(t, w, 15)
        q = np.zeros(60)
        q[t] = w
        want = np.sort((dense @ q)[dense @ q > 0])[::-1][:15]
        assert np.allclose(cos, want) and np.allclose(dense[who] @ q, cos)
    assert len(index.nearest(np.array([99]), np.array([1.0]), 5)[0]) == 0


def test_a_repeated_id_is_one_example(spark, docs):
    """The bound on sampled ids bounds the rows that reach the driver."""
    picked = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, label int")
    frame = docs([(1, "same text")] * 50 + [(1, "other text"), (1, None), (2, "two"), (3, None), (4, "no label"), (None, "x")])
    found = common.sample_rows(frame, picked)
    got = {r.doc_id: r for r in found.collect()}
    assert found.columns == ["doc_id", "text", "label"] and found.count() == 3 == len(got)
    assert got[1].text in ("same text", "other text") and got[1].label == 1
    assert (got[2].text, got[3].text) == ("two", None)
    labels = spark.createDataFrame([(i, int(i >= 20)) for i in range(40)], "doc_id long, toxic int")
    rows = [(i, "plain words here" if i < 20 else "foul words there") for i in range(40)]
    once, often = (toxicity.fit(docs(r), labels, "toxic", F.lit(True)) for r in (rows, rows + [rows[0]] * 300))
    assert once.rows.sum() == often.rows.sum() and once.idf == often.idf and once.base == often.base


# ---------------------------------------------------------------- mixing


def test_rates_reach_the_targets(spark):
    rng = np.random.default_rng(2)
    p = rng.dirichlet([0.4, 0.3, 0.3], size=3000)
    rows = spark.createDataFrame([(int(n), *map(float, x)) for n, x in zip(rng.integers(1, 500, 3000), p)], "tokens long, p0 double, p1 double, p2 double")
    for share in ((0.2, 0.5, 0.3), (0.98, 0.01, 0.01)):
        mix = mixing.fit_rates(rows, ["a", "b", "c"], dict(zip("abc", share)), 1.0)
        frame = rows.toPandas()
        x = frame[["p0", "p1", "p2"]].to_numpy()
        r, _ = mixing.rates(x, mix.pulls)
        total = (r * frame["tokens"].to_numpy()) @ x
        assert (r >= 0).all() and np.allclose(total, mix.reached)
        if share[0] < 0.9:  # a reachable target is met
            assert np.abs(total - mix.targets).max() <= 2 * mixing.TOLERANCE * frame["tokens"].sum()


def test_projected_gradient_finds_the_least_squares_point(spark):
    """Against a plain solver with the same weights, for a target that is out of reach."""
    rng = np.random.default_rng(3)
    p = rng.dirichlet([1.0, 1.0], size=200)
    n = rng.integers(1, 50, 200).astype(float)
    rows = spark.createDataFrame([(int(k), *map(float, x)) for k, x in zip(n, p)], "tokens long, p0 double, p1 double")
    mix = mixing.fit_rates(rows, ["a", "b"], {"a": 1.0}, 1.0, steps=60, tolerance=1e-9)
    white = np.linalg.inv((p * n[:, None]).T @ p + np.eye(2) * n.sum() * 1e-6)

    def loss(r):
        e = (r * n) @ p - mix.targets
        return e @ white @ e

    r = np.ones(200)
    for _ in range(20_000):
        r = np.maximum(0, r - 0.5 * p @ white @ ((r * n) @ p - mix.targets))
    assert loss(mixing.rates(p, mix.pulls)[0]) <= loss(r) + 0.01 * loss(np.ones(200))


def test_mixing_cases(spark, docs):
    texts = [(i, ("plain words in a line " * 12) if i % 3 else "### $$$ %%% &&& " * 20) for i in range(90)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(60)] + [(61, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    frame = docs([*texts, (None, "x"), (200, None), (201, ""), (5, texts[5][1])])
    rows, model, mix = mixing.mixed(frame, labels, {"1,0": 0.9, "0,0": 0.1}, 1.0)
    got = rows.collect()
    assert model.domains == ["0,0", "1,0"] and len(got) == 94
    assert all(r.rate >= 0 and r.copies in (int(r.rate), int(r.rate) + 1) for r in got)
    assert np.abs(mix.reached - mix.targets).max() <= 2 * mixing.TOLERANCE * mix.targets.sum()
    again = mixing.resampled(frame, labels, {"1,0": 0.9, "0,0": 0.1}, 1.0)
    assert again.columns == frame.columns and again.count() == sum(r.copies for r in got)
    assert mixing.mixed(docs([]), labels)[0].collect() == []
    plain = mixing.mixed(frame, labels.limit(0))[0].collect()
    assert {r.rate for r in plain} == {1.0} and len(plain) == 94
    assert mixing.resampled(frame, labels.limit(0)).count() == 94
    assert len(textstats.features("a b")) == len(textstats.NAMES)


def test_rates_are_computed_once(spark, docs):
    """A second evaluation below a filter would keep two more Python workers an executor for the stages after it."""
    texts = [(i, ("plain words in a line " * 12) if i % 3 else "### $$$ %%% &&& " * 20) for i in range(60)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(60)], "doc_id long, quality int, toxic int")
    again = mixing.resampled(docs(texts), labels, {"1,0": 0.9, "0,0": 0.1}, 1.0)
    assert again._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
