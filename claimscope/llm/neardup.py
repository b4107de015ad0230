"""Operator 2: near-duplicate classes by ProbMinHash, banding and exact verification.

A document is the weighted set of its five-word shingles; a shingle that occurs ``n``
times weighs ``1 + ln n``. Each shingle is a Poisson process whose arrivals, at a rate
equal to its weight, fall on the registers of a signature; a register keeps the shingle
that arrives first. A shingle is followed only until its next arrival is later than
every register's first one. Two registers agree with the probability Jaccard similarity
J_P of the two documents, which equals the plain Jaccard similarity when weights are
even. Documents that agree on all registers of a band become candidates and are kept if
their exact J_P reaches the threshold; classes are the connected components.

Bands never emit all their pairs. In each band bucket one document, the hub, is compared
with every member outside its class; then the hub leaves, and buckets whose members all
share a class are done. What is left after a few such rounds are mostly documents that
resemble a class but reach the threshold with none of it. These go through an exact
prefix join: shingles are ordered by rarity, those that only one class has in front, and
two documents can reach the threshold only if they share a shingle early enough in both
orders. Of such pairs all that cross classes are compared; nothing is cut off.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimscope.llm.common import arrow_rows, free_worker, staged

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 25, 5
#: Hub rounds over band buckets before the documents left go to the prefix join.
HUB_ROUNDS = 2
WORD = re.compile(r"\w+")
#: Texts, or pairs of shingle sets, in one Arrow batch: what a worker and its executor hold at a time.
TEXTS = 250
BROADCAST_BYTES = 64 << 20

U = np.uint64
GOLDEN, MIX1, MIX2 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: even small changes of ``x`` give unrelated results."""
    x = (x ^ (x >> U(30))) * MIX1
    x = (x ^ (x >> U(27))) * MIX2
    return x ^ (x >> U(31))


class Shingler:
    """Weighted shingle sets of texts, as (owner, shingle hash, weight) arrays."""

    def __init__(self, size: int = SHINGLE):
        self.size = size

    def _hashes(self, words: list[list[str]]) -> np.ndarray:
        """Hashes of all words in a row; each distinct one is hashed once."""
        flat = [w for ws in words for w in ws]
        return pd.util.hash_array(np.array(flat, dtype=object), categorize=True) if flat else np.zeros(0, dtype=U)

    def sets(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(owner, shingle, weight) sorted by owner and shingle, and each text's content hash (n x 2).

        A text of fewer words than a shingle is one shingle; a text without words has none.
        """
        words = [WORD.findall(t.lower()) if t else [] for t in texts]
        n = np.array([len(w) for w in words], dtype=np.int64)
        flat = self._hashes(words)
        first = np.concatenate([[0], np.cumsum(n)])[:-1].astype(np.int64)
        content = np.zeros((len(texts), 2), dtype=U)
        if not len(flat):
            none = np.zeros(0)
            return none.astype(np.int64), none.astype(U), none, content
        # Content hash: two position-dependent sums of all words.
        pos = np.arange(len(flat)) - np.repeat(first, n)
        full = np.flatnonzero(n)
        for k, seed in enumerate((U(0x51ED270B), U(0xA0761D65))):
            content[full, k] = np.add.reduceat(mixed(flat + mixed(pos.astype(U) + seed)), first[full])
        windows = np.where(n > 0, np.maximum(n - self.size + 1, 1), 0)
        owner = np.repeat(np.arange(len(texts)), windows)
        start = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows) + first[owner]
        stop = (first + n)[owner]
        h = np.zeros(len(owner), dtype=U)
        for k in range(self.size):
            at = start + k
            inside = at < stop
            h = np.where(inside, mixed(h * GOLDEN + flat[np.minimum(at, len(flat) - 1)] + U(1)), h)
        order = np.lexsort((h, owner))
        owner, h = owner[order], h[order]
        new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])])
        at = np.flatnonzero(new)
        times = np.diff(np.append(at, len(h)))
        return owner[at], h[at], 1.0 + np.log(times), content


def signatures(owner: np.ndarray, shingle: np.ndarray, weight: np.ndarray, texts: int, registers: int) -> np.ndarray:
    """ProbMinHash signatures (texts x registers) of weighted sets; rows without shingles stay 0."""
    first = np.full(texts * registers, np.inf)
    holder = np.zeros(texts * registers, dtype=U)
    time = np.zeros(len(owner))
    step = np.zeros(1, dtype=U)
    while len(owner):
        step += GOLDEN
        r = mixed(shingle + step)
        time = time - np.log(((r >> U(11)).astype(float) + 0.5) * 2.0**-53) / weight
        slot = owner * registers + (mixed(r + MIX1) % U(registers)).astype(np.int64)
        early = time < first[slot]
        s, t, x = slot[early], time[early], shingle[early]
        order = np.lexsort((x, t, s))
        s, t, x = s[order], t[order], x[order]
        lead = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else []
        first[s[lead]], holder[s[lead]] = t[lead], x[lead]
        last = first.reshape(texts, registers).max(axis=1)
        going = time < last[owner]
        owner, shingle, weight, time = owner[going], shingle[going], weight[going], time[going]
    return holder.reshape(texts, registers)


def probability_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Exact J_P of two weighted sets given as ascending distinct hashes and weights."""
    both, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    u, v = wa[i], wb[j]
    order = np.argsort(u / v, kind="stable")
    u, v = u[order], v[order]
    # For a common shingle k: the sum over all shingles j of max(u_j / u_k, v_j / v_k). Where
    # the ratio u_j / v_j is at least that of k, the first is larger, else the second.
    sum_u, sum_v = wa.sum(), wb.sum()
    lower_u, lower_v = np.cumsum(u) - u, np.cumsum(v) - v
    only_v = sum_v - v.sum()
    return float((1.0 / ((sum_u - lower_u) / u + (lower_v + only_v) / v)).sum())


def content_and_bands(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, c1, c2, bands): content hash and band keys; all null for a text without words."""

    def signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        free_worker()
        shingler = Shingler()
        salt = mixed(np.arange(1, bands + 1, dtype=U) * GOLDEN)
        for batch in batches:
            for k in range(0, len(batch), TEXTS):
                pdf = batch.iloc[k : k + TEXTS]
                owner, shingle, weight, content = shingler.sets(pdf["text"].tolist())
                sig = signatures(owner, shingle, weight, len(pdf), bands * rows).reshape(len(pdf), bands, rows)
                key = np.broadcast_to(salt, (len(pdf), bands)).copy()
                for r in range(rows):
                    key = mixed(key * GOLDEN + sig[:, :, r])
                some = np.zeros(len(pdf), dtype=bool)
                some[owner] = True
                c = content.astype(np.int64)
                yield pd.DataFrame(
                    {
                        "doc_id": pdf["doc_id"].astype("Int64"),
                        "c1": pd.array(c[:, 0], dtype="Int64").copy(),
                        "c2": pd.array(c[:, 1], dtype="Int64").copy(),
                        "bands": [x if s else None for x, s in zip(key.astype(np.int64), some)],
                    }
                )

    rows_in = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = rows_in.mapInPandas(signed, "doc_id long, c1 long, c2 long, bands array<long>")
    return out.withColumns({c: F.when(F.col("bands").isNotNull(), F.col(c)) for c in ("c1", "c2")})


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(node, part, shingles, weights) of documents, shingles ascending as unsigned numbers.

    ``part`` tells the texts of one node apart.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        free_worker()
        shingler = Shingler()
        for batch in batches:
            for k in range(0, len(batch), TEXTS):
                pdf = batch.iloc[k : k + TEXTS]
                owner, shingle, weight, _ = shingler.sets(pdf["text"].tolist())
                cuts = np.searchsorted(owner, np.arange(1, len(pdf)))
                yield pd.DataFrame(
                    {
                        "node": pdf["node"],
                        "part": pdf["part"],
                        "shingles": np.split(shingle.astype(np.int64), cuts),
                        "weights": np.split(weight.astype(np.float32), cuts),
                    }
                )

    rows = docs.select("node", F.xxhash64("text").alias("part"), "text")
    return rows.mapInPandas(cut, "node long, part long, shingles array<long>, weights array<float>")


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Those (a, b) of ``pairs`` whose exact J_P is at least ``threshold``."""

    def similar(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        free_worker()
        for pdf in batches:
            keep = [
                probability_jaccard(x.view(U), u.astype(float), y.view(U), v.astype(float)) >= threshold - 1e-9
                for x, u, y, v in zip(pdf["x"], pdf["u"], pdf["y"], pdf["v"])
            ]
            yield pdf.loc[keep, ["a", "b"]]

    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"), F.col("weights").alias("u"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"), F.col("weights").alias("v"))
    return pairs.join(left, "a").join(right, "b").mapInPandas(similar, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, label): the least node of each connected component; only nodes with a link.

    Labels move to neighbours and then to the label's own label, so that chains halve
    in every round.
    """
    both = staged(links.select("a", "b").union(links.select("b", "a")), "links").toDF("node", "other")
    label = staged(both.groupBy("node").agg(F.least("node", F.min("other")).alias("label")), "labels")
    while True:
        near = both.join(label.toDF("other", "seen"), "other").groupBy("node").agg(F.min("seen").alias("seen"))
        moved = label.join(near, "node").select("node", F.least("label", "seen").alias("next"), "label")
        jump = label.toDF("next", "further")
        moved = moved.join(jump, "next", "left").select("node", F.least("next", "further").alias("new"), "label")
        moved = staged(moved, "labels")
        changed = moved.where(F.col("new") != F.col("label")).limit(1).count()
        label = moved.select("node", F.col("new").alias("label"))
        if not changed:
            return label


def open_buckets(members: DataFrame, label: DataFrame) -> DataFrame:
    """Members (key, node, label) of the buckets that hold more than one class."""
    named = members.join(label, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    mixed_keys = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
    return named.join(mixed_keys, "key", "left_semi")


def hub_pairs(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs of each bucket's hub with members of other classes, the members without hubs)."""
    hub = members.groupBy("key").agg(F.min(F.struct("node", "label")).alias("hub"))
    with_hub = members.join(hub, "key")
    away = with_hub.where(F.col("label") != F.col("hub.label"))
    pairs = away.select(F.col("hub.node").alias("a"), F.col("node").alias("b")).distinct()
    return pairs, with_hub.where(F.col("node") != F.col("hub.node")).select("key", "node")


def prefix_pairs(members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of different classes among ``members`` that may reach the threshold.

    In the common order of all shingles let ``before`` be the weight that a document has
    in front of the first shingle it shares with another. With all weights 1 they share
    at most ``all - before``, and need ``t / (1 + t)`` of their weights' sum. In general,
    J_P is at most the smaller share of weight that is not in front. A node with several
    texts takes part with each of them.
    """
    nodes = members.select("node", "label").distinct()
    long = sets.join(nodes, "node").select("node", "part", "label", F.explode(F.arrays_zip("shingles", "weights")).alias("s"))
    long = long.select("node", "part", "label", F.col("s.shingles").alias("shingle"), F.col("s.weights").cast("double").alias("w"))
    known = long.groupBy("shingle").agg(F.count("*").alias("df"), (F.min("label") != F.max("label")).alias("shared"))
    mine = Window.partitionBy("node", "part")
    ahead = mine.orderBy("shared", "df", "shingle").rowsBetween(Window.unboundedPreceding, -1)
    placed = long.join(known, "shingle").select(
        "shingle", "node", "label", "shared",
        F.coalesce(F.sum("w").over(ahead), F.lit(0.0)).alias("before"),
        F.sum("w").over(mine).alias("all"),
        (F.max("w").over(mine) == 1.0).alias("even"),
    )
    early = placed.where(F.col("shared") & (F.col("before") <= (1.0 - threshold) * F.col("all") + 1e-6)).drop("shared")
    early = staged(early, "early")
    several = early.groupBy("shingle").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("shingle")
    early = staged(early.join(several, "shingle", "left_semi"), "early")
    x, y = early.alias("x"), early.alias("y")
    need = threshold / (1.0 + threshold) * (F.col("x.all") + F.col("y.all")) - 1e-6
    room = (F.col("x.all") - F.col("x.before") >= need) & (F.col("y.all") - F.col("y.before") >= need)
    on = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.label") != F.col("y.label"))
    pairs = x.join(y, on & (room | ~F.col("x.even") | ~F.col("y.even")))
    return pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def linked(members: DataFrame, sets: DataFrame, threshold: float, rounds: int = HUB_ROUNDS) -> DataFrame:
    """Components (node, label) of all similar pairs that share a bucket of ``members``."""
    whole = members
    label = members.select("node", F.col("node").alias("label")).limit(0)
    links = None
    for turn in range(rounds + 1):
        left = staged(open_buckets(whole if turn == rounds else members, label), "buckets")
        if left.isEmpty():
            break
        if turn < rounds:
            pairs, members = hub_pairs(left)
            members = staged(members, "members")
        else:
            pairs = prefix_pairs(left, sets, threshold)
        with arrow_rows(members.sparkSession, TEXTS):
            found = staged(verified(pairs, sets, threshold), "found")
        if not found.isEmpty():
            links = found if links is None else links.union(found)
            label = components(links)
    return label


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id), one row per row of ``docs``.

    ``class_id`` is the least doc_id of the class. Texts with the same words are one
    document to the search, whatever their case and punctuation. A text without words
    (null, empty) is alike to none: its class is its own doc_id. Rows with one doc_id
    belong to one document and share its class; a row without doc_id takes the class of
    an equal text, or null. Other columns are ignored; an empty table gives no rows.
    """
    with arrow_rows(docs.sparkSession, TEXTS):
        signed = staged(content_and_bands(docs), "signed")
    named = signed.where(F.col("doc_id").isNotNull() & F.col("c1").isNotNull())
    # One node per content: the least doc_id that has it.
    contents = staged(named.groupBy("c1", "c2").agg(F.min("doc_id").alias("node")), "contents")
    # Least id of each content, and links between contents that share an id.
    shared = (
        named.select("doc_id", "c1", "c2").distinct().join(contents, ["c1", "c2"]).groupBy("doc_id")
        .agg(F.min("node").alias("a"), F.max("node").alias("b"))
    )
    reps = named.join(contents, ["c1", "c2"]).where(F.col("doc_id") == F.col("node")).dropDuplicates(["node", "c1", "c2"])
    members = reps.select("node", F.explode("bands").alias("key")).distinct()
    several = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    members = staged(members.join(several, "key", "left_semi").select("key", "node"), "members")

    nodes = members.select("node").distinct()
    # A row of ``nodes`` is one number, so its count bounds its bytes.
    if nodes.count() * 16 <= BROADCAST_BYTES:
        nodes = F.broadcast(nodes)
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(nodes, "node", "left_semi")
    # Repeated rows count once; an id with several texts has a set for each.
    texts = texts.groupBy("node", F.xxhash64("text")).agg(F.any_value("text").alias("text")).select("node", "text")
    with arrow_rows(docs.sparkSession, TEXTS):
        sets = staged(shingle_sets(texts), "sets")
    label = linked(members, sets, threshold)
    ties = staged(shared.where("a <> b").select("a", "b"), "ties")
    if not ties.isEmpty():
        label = components(label.select(F.col("node").alias("a"), F.col("label").alias("b")).union(ties))

    classes = contents.join(label, "node", "left").select("c1", "c2", F.coalesce("label", "node").alias("class_id"))
    out = signed.select("doc_id", "c1", "c2").join(classes, ["c1", "c2"], "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all columns, that stand for their class: the least doc_id.

    Of equal rows that repeat an id one is kept. Rows without a doc_id stay, as nothing
    names them.
    """
    classes = near_duplicates(docs.where(F.col("doc_id").isNotNull()), threshold)
    gone = classes.where(F.col("doc_id") != F.col("class_id")).select(F.col("doc_id").alias("__id")).distinct()
    kept = docs.join(gone, docs["doc_id"] == gone["__id"], "left_anti")
    again = staged(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 and doc_id is not null").select(F.col("doc_id").alias("__id")), "again")
    if again.isEmpty():  # so that whole rows are only compared where an id repeats
        return kept
    once = kept.join(again, kept["doc_id"] == again["__id"], "left_anti")
    return once.unionByName(kept.join(again, kept["doc_id"] == again["__id"], "left_semi").dropDuplicates())
