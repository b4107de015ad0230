"""Language-model scoring, spelling variants and the filter audit against brute force."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from llm_docs import docs  # noqa: F401
from pyspark.sql import functions as F

from claimscope.llm import filter_audit, lm, spelling
from claimscope.llm.common import held_out

SPACE = re.compile("[^\x20\x09-\x0d]+")


# ---------------------------------------------------------------- language model


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def token_lists(texts):
    return [[*SPACE.findall(low(t)), "</s>"] for t in texts]


def half_rule(n1, n2, n3, n4):
    if not (n1 and n2 and n3 and n4):
        return [0, 0.5, 1, 1]
    y = n1 / (n1 + 2 * n2)
    return [0, *(min(max(d, 0), k) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3)))]


class Brute:
    """The model with plain dictionaries."""

    def __init__(self, texts):
        self.c, self.big = Counter(), Counter()
        for line in token_lists(texts):
            self.c.update(line)
            self.big.update(zip(["<s>", *line], line))
        self.hist, self.left = defaultdict(Counter), Counter()
        for (h, w), n in self.big.items():
            self.hist[h][w] = n
            self.left[w] += 1
        of = Counter(self.big.values())
        self.d = half_rule(*(of[k] for k in (1, 2, 3, 4)))
        of = Counter(self.left.values())
        self.e = half_rule(*(of[k] for k in (1, 2, 3, 4)))
        self.N, self.V = sum(self.c.values()), len(self.c)

    def lower(self, w):
        a = sum(self.left.values())
        free = sum(self.e[min(k, 3)] for k in self.left.values()) / a
        k = self.left[w]
        return max(k - self.e[min(k, 3)], 0) / a + free / (self.V + 1)

    def p(self, h, w):
        seen = self.hist.get(h)
        if not seen:
            return self.lower(w)
        total = sum(seen.values())
        free = sum(self.d[min(k, 3)] for k in seen.values()) / total
        return (seen[w] - self.d[min(seen[w], 3)] if w in seen else 0) / total + free * self.lower(w)

    def row(self, text):
        line = token_lists([text])[0]
        base = sum(math.log10((self.c[w] + 1) / (self.N + self.V + 1)) for w in line)
        score = sum(math.log10(self.p(h, w)) for h, w in zip(["<s>", *line], line))
        return len(line), sum(self.c[w] > 0 for w in line), base, score


def some_texts(seed, n):
    r = random.Random(seed)
    words = ["the", "The", "of", "cat", "Ünï", "é", "x\x1fy", "a b", "naïve", "İ"] + [f"w{k}" for k in range(40)]
    weights = [40, 20, 20, 5, 3, 3, 2, 2, 2, 2] + [60 / (k + 1) for k in range(40)]
    texts = [" ".join(r.choices(words, weights, k=r.randint(0, 60))) for _ in range(n)]
    return texts + [None, "", " \t\n\x0b\x0c\r ", "the the the\n\nthe", "same text here"] + ["same text here"] * 5


@pytest.mark.parametrize("small", [False, True])
def test_lm_equals_brute_force(spark, docs, monkeypatch, small):  # noqa: F811
    if small:  # many word shards, ranges, split ranges, blocks and pieces
        for name, value in (("SHARD", 16), ("WORDS", 4), ("BLOCK", 40), ("PIECE", 30), ("MANY", 3)):
            monkeypatch.setattr(lm, name, value)
    rows = list(enumerate(some_texts(3, 60)))
    frame = docs([*rows, (None, "the cat of an unseen zebra"), (7, "a repeated id")])
    every = [(r["doc_id"], r["text"]) for r in frame.collect()]
    held = {r["doc_id"]: r["h"] for r in frame.select("doc_id", held_out(F.col("doc_id"), 7, 2).alias("h")).collect()}
    assert held[0] == (zlib.crc32(b"0") % 7 == 2)
    brute = Brute([t for i, t in every if not held[i]])
    model = lm.fit(frame, ~held_out(F.col("doc_id"), 7, 2))
    assert (model.tokens, model.distinct) == (brute.N, brute.V)
    got = lm.score(frame, model, "doc_id").collect()
    want = Counter((i, *(round(x, 8) for x in brute.row(t))) for i, t in every)
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 8), round(r["score"], 8)) for r in got) == want
    if small:
        assert len(model.bases) > 4 and len(model.starts) > 10 and max(model.splits) > 1
    words = [*brute.c, "never seen"]
    for h in ("<s>", "the", "w1"):
        known = sum(brute.p(h, w) for w in words)
        assert known == pytest.approx(1)


def test_lm_without_training_rows(spark, docs):  # noqa: F811
    frame = docs([(1, "some words"), (2, None)])
    model = lm.fit(frame, F.lit(False))
    got = lm.perplexity(lm.score(frame, model, "doc_id")).orderBy("doc_id").collect()
    assert [(r["n_tokens"], r["n_known"], r["score"], r["base_score"], r["perplexity"]) for r in got] == [(3, 0, 0, 0, 1), (1, 0, 0, 0, 1)]
    assert lm.score(docs([]), lm.fit(docs([]), F.lit(True)), "doc_id").count() == 0


def test_long_text_goes_on_in_pieces(monkeypatch):
    text = " ".join(f"Word{k}" for k in range(5000))
    whole = [w for piece in lm.text_pieces(text) for w in piece]
    monkeypatch.setattr(lm, "PIECE", 100)
    monkeypatch.setattr(lm, "BLOCK", 64)
    pieces = list(lm.text_pieces(text))
    assert len(pieces) > 300 and [w for p in pieces for w in p] == whole == text.lower().encode().split()
    pairs = []
    for block in lm.blocks(iter([text, "end now"])):
        name = {v: k for k, v in block.number.items()}
        before, token, of = block.pairs()
        pairs += [(name[h], name[w], t) for h, w, t in zip(before, token, of)]
    line = [*whole, lm.END]
    assert pairs == [*((h, w, 0) for h, w in zip([lm.BEGIN, *whole], line)), (lm.BEGIN, b"end", 1), (b"end", b"now", 1), (b"now", lm.END, 1)]


# ---------------------------------------------------------------- spelling variants


def edits(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = low(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            at = h % len(run)
            n[run if h % 199 else run[:at] + run[at + 1 :]] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    near = {w: [v for v in n if edits(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        if best and n[best] >= 5 * n[w]:
            form[w] = best
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        f = form.get(w)
        out.add((w, f, root, n[w], len(near[w]), n[f] if f else None))
    return out


def variant_rows(seed):
    """Words with planted variants, chains of counts, ties, anagrams and letters outside a-z."""
    r = random.Random(seed)
    alphabet = "abeinrst" + "éèüß×÷ÿ"
    base = ["".join(r.choices(alphabet, k=r.randint(6, 9))) for _ in range(25)]
    words = Counter()
    for w in base:
        words[w] = r.choice([30, 150, 160])
        for _ in range(12):
            k = r.randrange(len(w))
            v = r.choice([w[:k] + r.choice(alphabet) + w[k + 1 :], w[:k] + w[k + 1 :], w[:k] + r.choice(alphabet) + w[k:]])
            words[v] += r.choice([5, 6, 30])
            words["".join(r.sample(v, len(v)))] += 5
    words |= {"plantone": 400, "plantune": 40, "plantunx": 6}
    texts = []
    for w, k in words.items():
        texts += [w.upper() if r.random() < 0.1 and w.isascii() else w] * k
    r.shuffle(texts)
    rows = [(i, " 1".join(texts[i::80])) for i in range(80)]
    return [*rows, (None, "seldom words without an id"), (5, None), (6, ""), (7, "Āā longer" + "x" * 5000 + " " + "y" * 5000), (0, rows[0][1])]


@pytest.mark.parametrize("cell", [8192, 16])
def test_variants_equal_brute_force(docs, monkeypatch, cell):  # noqa: F811
    monkeypatch.setattr(spelling, "CELL", cell)
    rows = variant_rows(11)
    got = spelling.variants(docs(rows)).collect()
    want = brute_variants(rows)
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    forms = {w[0]: w[1] for w in want}
    assert any(f and forms.get(f) for f in forms.values()), "no chain of two links planted"


def test_variants_of_nothing(docs):  # noqa: F811
    assert spelling.variants(docs([])).count() == 0
    assert spelling.variants(docs([(1, None), (2, ""), (3, "short few words")])).count() == 0


def test_cells_and_boxes_lose_no_pair():
    """Dealing by the upper tree plus the search inside each cell finds exactly the pairs one edit apart."""
    r = random.Random(5)
    words = sorted({"".join(r.choices("abcdeé", k=6)) for _ in range(900)})
    longer = sorted({w[:k] + r.choice("abcz") + w[k:] for w in words for k in (0, 3, 6)})
    for trees_of, seek, down in ((words, words, 1), (longer, words, 0)):
        own, ask = (spelling.code_points(x, len(x[0])) for x in (trees_of, seek))
        tree = spelling.upper_tree(spelling.letter_counts(own)[::3], 64)
        cell_of = {}
        for cell, at in spelling.visits(tree, spelling.letter_counts(own), 0, 0):
            cell_of.update(dict.fromkeys(at.tolist(), cell))
        assert len(cell_of) == len(trees_of) and len(set(cell_of.values())) > 30
        found, visited = set(), 0
        for cell, at in spelling.visits(tree, spelling.letter_counts(ask), 1, down):
            here = np.array([k for k, c in cell_of.items() if c == cell], dtype=int)
            visited += len(at)
            if len(here):
                i, j = spelling.near_in_cell(own[here], ask[at])
                pairs = list(zip(at[i].tolist(), here[j].tolist()))
                assert not found & set(pairs)
                found |= set(pairs)
        assert found == {(i, j) for i, a in enumerate(seek) for j, b in enumerate(trees_of) if edits(a, b)}
        assert visited < len(seek) * 64 / 2, "boxes prune nothing"


# ---------------------------------------------------------------- filter audit


def brute_audit(rows, labels):
    def fails(doc_id, text):
        text = text or ""
        words = SPACE.findall(text)
        out = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search("[#$%&*|]", text)),
            "E": doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, _, t in rows),
        }
        return {k for k, bad in out.items() if bad}

    mark = defaultdict(lambda: (0, 0))
    for i, q, t in labels:
        mark[i] = (max(mark[i][0], q or 0), max(mark[i][1], t or 0))
    judged = [(src or "", fails(i, t), mark[i] if i is not None else (0, 0)) for i, src, t in rows]
    out, shares = {}, Counter()
    for part in {p for p, _, _ in judged}:
        mine = [(f, m) for p, f, m in judged if p == part]
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, name in enumerate(order, 1):
                gone = [(f, m) for f, m in left if name in f]
                left = [(f, m) for f, m in left if name not in f]
                all_failing = sum(name in f for f, _ in mine)
                only = sum(f == {name} for f, _ in mine)
                out[part, order, step] = (
                    len(left), len(gone), all_failing - len(gone), only, sum(m[0] == 1 for _, m in gone), sum(m[1] == 1 for _, m in gone),
                )
                shares[part, name] += len(gone)
    return {(*k, *v, shares[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_equals_brute_force(spark):
    r = random.Random(2)
    many = " ".join(f"word{k}" for k in range(220))
    pool = [
        many, many.upper(), many + " #", "few words", "Few $ Words", "same " * 250, "SAME " * 300, None, "", "   ", "é" * 50, "A",
        "x " * 199, many + " y", "a\x1fb " * 210,
    ]
    rows = [(i, r.choice(["s1", "s2", None, ""]), r.choice(pool)) for i in range(120)]
    rows += [(None, "s1", many), (None, "s1", "few words"), (3, "s2", rows[3][2]), (4, "s3", many), rows[5], rows[5]]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, 120, 2)] + [(3, 1, 0), (3, 0, 1), (None, 1, 1), (999, 1, 1)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "'x' AS mask", "1 AS n", "'y' AS part", "0 AS digest")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'x' AS good", "'y' AS text")
    got = filter_audit.audit(frame, marks).collect()
    want = brute_audit(rows, labels)
    assert len(got) == len(want) == 600 * 4
    assert {tuple(row) for row in got} == want


def test_audit_of_an_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, source string, text string")
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(none, marks).count() == 0
    one = filter_audit.audit(spark.createDataFrame([(1, None, None)], none.schema), marks).collect()
    assert len(one) == 600 and {r["part"] for r in one} == {""}


def test_shapley_solves_the_weighted_least_squares():
    """Equal to the mean over all orders, and to the unanimity game's equal split."""
    r = random.Random(1)
    value = [0, *(r.randint(-50, 99) for _ in range(31))]
    mean = [0] * 5
    for order in permutations(range(5)):
        s = 0
        for k in order:
            mean[k] += value[s | 1 << k] - value[s]
            s |= 1 << k
    assert [120 * x for x in filter_audit.shapley(value)] == mean
    assert filter_audit.shapley([int(s & 7 == 7) for s in range(32)]) == [filter_audit.Fraction(1, 3)] * 3 + [0, 0]
