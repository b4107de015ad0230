"""Interpolated modified Kneser-Ney bigram model, counted in Spark, read from memory-mapped arrays.

Tokens of a text (null: empty) are its words between ASCII white space with A-Z lower-cased,
then one end token; the first is seen after a begin mark that is never predicted itself.

    p(w | h) = max(c(h w) - D(c), 0) / c(h) + (D1 N1(h) + D2 N2(h) + D3 N3+(h)) / c(h) * p(w)
    p(w)     = max(a(w) - D'(a), 0) / A + (D'1 N'1 + D'2 N'2 + D'3 N'3+) / A / (V + 1)

with a(w) the different words seen before w, A their sum, and one uniform share for all unseen
words. An unseen h leaves p(w). Discounts come from counts of counts on either level.

Nothing is sampled: the model holds every word and every bigram of the training rows.

* **Words.** Spark counts 64-bit word hashes (collisions are left to chance). Hash ranges are
  Spark groups; each writes its sorted hashes and counts as two files. A word's id is its place.
* **Bigrams.** Tasks turn tokens into ids and send sorted blocks of (first id, second id) keys
  with counts to shards: ranges of first words that hold about SHARD tokens each by the exact
  word counts; a range that a hot word swells is split further by the second word. A shard
  group merges its blocks and writes sorted keys and counts. All groups have about one size.
* **Scoring** maps the files and looks up the sorted distinct keys of many texts at a time, shard
  after shard, so a worker's own memory does not depend on the model's size.

Files are named by shard and moved into place when complete, so a repeated task rewrites the
same bytes. They lie in the shared folder; where that is no mounted path, a worker reads one
bounded shard at a time instead of mapping it.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimscope.llm.common import hadoop_uri, new_folder, staged

#: No word holds white space, so these cannot meet one.
BEGIN, END = b" begin", b" end"

#: Tokens per bigram shard and words per word shard.
SHARD = 1 << 21
WORDS = 1 << 20
#: Tokens that a worker holds at a time; longer texts go on in the next block.
BLOCK = 1 << 20
#: Bigram counts take a byte; those of MANY and more stand in a list beside it.
MANY = 255
PIECE = 4 << 20

LOW = np.uint64(0xFFFFFFFF)
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


@dataclass(frozen=True)
class Model:
    """What a worker needs to read the files: a few numbers per shard."""

    root: str
    #: First id of each word shard, with the total at the end; the shard is the hash's top ``bits``.
    bases: np.ndarray
    bits: int
    #: First id of each range of first words, its first bigram shard and its shards.
    starts: np.ndarray
    firsts: np.ndarray
    splits: np.ndarray
    #: Training tokens and distinct tokens (the end token is one, the begin mark is not).
    tokens: int
    distinct: int
    #: Discounts by count 0 to 3 (3: and more), and the share of an unseen word.
    discounts: tuple[float, ...] = ()
    unseen: float = 1.0


# ---------------------------------------------------------------- files


def _place(root: str, name: str):
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(root)
    return system, f"{base}/{name}"


def write_array(root: str, name: str, values: np.ndarray) -> None:
    """Write under a name of its own, then move: readers and repeated tasks see whole files only."""
    system, path = _place(root, name)
    part = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(part) as out:
        out.write(np.ascontiguousarray(values).tobytes())
    system.move(part, path)


def read_array(root: str, name: str, dtype: str) -> np.ndarray:
    from pyarrow import fs

    system, path = _place(root, name)
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(path, dtype=dtype, mode="r")
    with system.open_input_file(path) as source:
        return np.frombuffer(source.read(), dtype=dtype)


# ---------------------------------------------------------------- tokens


def text_pieces(text: str | None) -> Iterator[list[bytes]]:
    """Words of a text, a bounded piece at a time."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    at = 0
    while len(raw) - at > PIECE:
        space = _SPACE.search(raw, at + PIECE)
        if space is None:
            break
        yield raw[at : space.start()].lower().split()
        at = space.start()
    yield raw[at:].lower().split()


class Block:
    """Tokens of consecutive texts as numbers of the block's own word list.

    A text that goes on from the block before starts with that block's last word instead of
    the begin mark. Such first tokens are histories only.
    """

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {BEGIN: 0, END: 1}
        self.codes: list[np.ndarray] = []
        self.texts: list[int] = []
        self.size = 0

    def add(self, text: int, words: list[bytes], before: bytes, last: bool) -> None:
        number = self.number
        line = [before, *words, END] if last else [before, *words]
        self.codes.append(np.fromiter((number.setdefault(w, len(number)) for w in line), dtype=np.int64, count=len(line)))
        self.texts.append(text)
        self.size += len(line)

    def hashes(self) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, self.number), dtype=np.uint64, count=len(self.number))

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(history, token, text) of every token."""
        sizes = np.array([len(c) for c in self.codes])
        codes = np.concatenate(self.codes)
        inner = np.ones(len(codes), dtype=bool)
        inner[np.cumsum(sizes) - sizes] = False
        at = np.nonzero(inner)[0]
        return codes[at - 1], codes[at], np.repeat(np.array(self.texts), sizes)[at]


def blocks(texts: Iterator[str | None]) -> Iterator[Block]:
    block = Block()
    for k, text in enumerate(texts):
        before, held = BEGIN, None
        for words in text_pieces(text):
            if held is not None:
                block.add(k, held, before, last=False)
                before = held[-1] if held else before
                if block.size >= BLOCK:
                    yield block
                    block = Block()
            held = words
        block.add(k, held or [], before, last=True)
        if block.size >= BLOCK:
            yield block
            block = Block()
    if block.size:
        yield block


# ---------------------------------------------------------------- words


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for block in blocks(t for pdf in batches for t in pdf["text"]):
        _, tokens, _ = block.pairs()
        n = np.bincount(tokens, minlength=len(block.number))
        n[0] = sum(int(c[0] == 0) for c in block.codes)
        used = n > 0
        yield pd.DataFrame({"h": block.hashes()[used].view(np.int64), "n": n[used]})


def word_shard(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), dtype=np.int64)


def _word_writer(root: str):
    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(pdf["shard"].iloc[0])
        hashes = pdf["h"].to_numpy().view(np.uint64)
        order = np.argsort(hashes)
        n = pdf["n"].to_numpy()[order]
        write_array(root, f"word-hash-{shard}", hashes[order])
        write_array(root, f"word-count-{shard}", n)
        # Ranges of first words: a new one wherever the tokens so far pass a multiple of SHARD.
        slot = (np.cumsum(n) - n) // SHARD
        starts = np.nonzero(np.diff(slot, prepend=-1))[0]
        held = np.add.reduceat(n, starts)
        return pd.DataFrame({"shard": [shard], "words": [len(n)], "starts": [starts.tolist()], "splits": [(-(-held // (2 * SHARD))).tolist()]})

    return write


def ids_of(model: Model, hashes: np.ndarray, *arrays: str) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Word ids (-1: unseen) of any hashes, with the values of further arrays by word (0: unseen)."""
    order = np.argsort(hashes)
    wanted = hashes[order]
    ids = np.full(len(wanted), -1, dtype=np.int64)
    values = {a: np.zeros(len(wanted), dtype=_kind(a)) for a in arrays}
    shards = word_shard(wanted, model.bits)
    for shard in np.unique(shards):
        low, high = np.searchsorted(shards, [shard, shard + 1])
        if model.bases[shard] == model.bases[shard + 1]:
            continue
        held = read_array(model.root, f"word-hash-{shard}", "<u8")
        place = np.minimum(np.searchsorted(held, wanted[low:high]), len(held) - 1)
        hit = np.nonzero(held[place] == wanted[low:high])[0]
        ids[low + hit] = model.bases[shard] + place[hit]
        for a in arrays:
            values[a][low + hit] = read_array(model.root, f"{a}-{shard}", _kind(a))[place[hit]]
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return ids[back], {a: v[back] for a, v in values.items()}


def _kind(name: str) -> str:
    return "<i8" if name == "word-count" else "<f8"


# ---------------------------------------------------------------- bigrams


def bigram_shard(model: Model, keys: np.ndarray) -> np.ndarray:
    """Shard of each key: by the range of its first word, in a swollen range also by a mix of the second."""
    span = np.searchsorted(model.starts, (keys >> np.uint64(32)).astype(np.int64), side="right") - 1
    mixed = ((keys & LOW) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    return model.firsts[span] + (mixed % model.splits[span].astype(np.uint64)).astype(np.int64)


def by_shard(model: Model, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, places in ``keys``), places in the order of the sorted keys."""
    shards = bigram_shard(model, keys)
    order = np.argsort(shards, kind="stable")
    shards = shards[order]
    edges = np.nonzero(np.diff(shards, prepend=-1))[0]
    for low, high in zip(edges, [*edges[1:], len(shards)]):
        yield int(shards[low]), order[low:high]


def _pair_counter(model: Model):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in blocks(t for pdf in batches for t in pdf["text"]):
            before, token, _ = block.pairs()
            ids, _ = ids_of(model, block.hashes())
            ids = ids.astype(np.uint64)
            keys, n = np.unique(ids[before] << np.uint64(32) | ids[token], return_counts=True)
            rows = [(s, keys[p].tobytes(), n[p].astype(np.uint32).tobytes()) for s, p in by_shard(model, keys)]
            yield pd.DataFrame(rows, columns=["shard", "keys", "counts"])

    return count


def _shard_writer(model: Model):
    """Merge one shard's blocks, write it, and report what its words add to the statistics."""

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(pdf["shard"].iloc[0])
        keys = np.concatenate([np.frombuffer(b, dtype=np.uint64) for b in pdf["keys"]])
        n = np.concatenate([np.frombuffer(b, dtype=np.uint32) for b in pdf["counts"]]).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        edge = np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[0]
        keys, n = keys[edge], np.add.reduceat(n, edge)
        write_array(model.root, f"pair-key-{shard}", keys)
        write_array(model.root, f"pair-count-{shard}", np.minimum(n, MANY).astype(np.uint8))
        many = np.nonzero(n >= MANY)[0]
        write_array(model.root, f"pair-many-{shard}", np.stack([many, n[many]]))

        first = (keys >> np.uint64(32)).astype(np.int64)
        edge = np.nonzero(np.diff(first, prepend=-1))[0]
        classes = [np.add.reduceat((t(n)).astype(np.int64), edge) for t in
                   (lambda c: c == 1, lambda c: c == 2, lambda c: c >= 3, lambda c: c == 3, lambda c: c == 4)]
        second, a = np.unique((keys & LOW).astype(np.int64), return_counts=True)
        zero = np.zeros(len(second), dtype=np.int64)
        out = pd.DataFrame({"id": np.concatenate([first[edge], second]), "a": np.concatenate([np.zeros(len(edge), dtype=np.int64), a])})
        for name, found in zip(("n1", "n2", "more", "n3", "n4"), classes):
            out[name] = np.concatenate([found, zero])
        out["shard"] = np.searchsorted(model.bases, out["id"].to_numpy(), side="right") - 1
        return out

    return write


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float, float]:
    """D by count 0, 1, 2, 3 and more, from counts of counts.

    Where a small table lacks one of the counts the rule is undefined; then D is half the count
    for 1, and 1 for more.
    """
    if not (n1 and n2 and n3 and n4):
        return 0.0, 0.5, 1.0, 1.0
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return (0.0, *(min(max(d, 0.0), float(k)) for k, d in enumerate(raw, 1)))


def _level_writer(model: Model, low: tuple, a_sum: int, spread: float):
    """Files of the lower level: by word, its probability p(w) and the share its bigrams leave free."""
    high = model.discounts

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(pdf["shard"].iloc[0])
        base, end = int(model.bases[shard]), int(model.bases[shard + 1])
        at = pdf["id"].to_numpy() - base
        a, n = np.zeros(end - base, dtype=np.int64), read_array(model.root, f"word-count-{shard}", "<i8")
        a[at] = pdf["a"].to_numpy()
        free = np.zeros(end - base)
        free[at] = high[1] * pdf["n1"].to_numpy() + high[2] * pdf["n2"].to_numpy() + high[3] * pdf["more"].to_numpy()
        # A word that only ever ends the model's view (the end token) has no bigrams: its share is never read.
        write_array(model.root, f"free-{shard}", free / n)
        write_array(model.root, f"lower-{shard}", np.maximum(a - np.array(low)[np.minimum(a, 3)], 0) / max(a_sum, 1) + spread)
        return pd.DataFrame({"shard": [shard]})

    return write


def fit(docs: DataFrame, train: Column) -> Model:
    """Count words and bigrams of the rows of ``docs`` where ``train`` holds, and write the model.

    Repeated rows count each. Without training rows the model knows no word: every token has
    probability 1.
    """
    spark = docs.sparkSession
    root = hadoop_uri(spark, new_folder(spark, "lm"), make=True)
    texts = docs.where(train).select("text")
    words = staged(texts.mapInPandas(_count_words, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "lm-words")
    begin = int(np.uint64(xxhash.xxh3_64_intdigest(BEGIN)).view(np.int64))
    # Both marks are in the table as words; the begin mark is no token.
    tokens, distinct = words.agg(F.sum(F.when(F.col("h") != begin, F.col("n"))), F.count_if(F.col("h") != begin)).first()
    none = np.zeros(1, dtype=np.int64)
    if not tokens:
        return Model(root, np.zeros(2, dtype=np.int64), 0, none, none, none + 1, 0, 0, (0.0,) * 4)
    if distinct + 1 >= 1 << 32:
        raise ValueError("more distinct words than 32-bit ids")

    bits = max(0, (distinct // WORDS).bit_length())
    shard = F.shiftrightunsigned("h", 64 - bits).cast("int") if bits else F.lit(0)
    wrote = words.select(shard.alias("shard"), "h", "n").groupBy("shard")
    wrote = wrote.applyInPandas(_word_writer(root), "shard int, words long, starts array<long>, splits array<long>")
    meta = {r["shard"]: r for r in wrote.collect()}  # one row per WORDS words, two numbers per SHARD tokens
    sizes = [meta[s]["words"] if s in meta else 0 for s in range(1 << bits)]
    bases = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    starts = np.array([bases[s] + x for s in sorted(meta) for x in meta[s]["starts"]], dtype=np.int64)
    splits = np.array([x for s in sorted(meta) for x in meta[s]["splits"]], dtype=np.int64)
    model = Model(root, bases, bits, starts, np.cumsum(splits) - splits, splits, tokens, distinct)

    pairs = texts.mapInPandas(_pair_counter(model), "shard int, keys binary, counts binary").groupBy("shard")
    told = "id long, a long, n1 long, n2 long, more long, n3 long, n4 long, shard int"
    parts = pairs.applyInPandas(_shard_writer(model), told).groupBy("shard", "id")
    names = ("a", "n1", "n2", "more", "n3", "n4")
    stats = staged(parts.agg(*(F.sum(c).alias(c) for c in names)), "lm-stats")
    a = F.col("a")
    total = stats.agg(
        *(F.sum(c).alias(c) for c in names),
        *(F.count_if(a == k).alias(f"a{k}") for k in (1, 2, 3, 4)),
        F.count_if(a >= 3).alias("a_more"),
    ).first()
    high = discounts(total["n1"], total["n2"], total["n3"], total["n4"])
    low = discounts(*(total[f"a{k}"] for k in (1, 2, 3, 4)))
    free = (low[1] * total["a1"] + low[2] * total["a2"] + low[3] * total["a_more"]) / total["a"]
    model = Model(root, bases, bits, starts, model.firsts, splits, tokens, distinct, high, free / (distinct + 1))
    levels = stats.groupBy("shard").applyInPandas(_level_writer(model, low, total["a"], model.unseen), "shard int")
    levels.write.format("noop").mode("overwrite").save()
    return model


# ---------------------------------------------------------------- scoring


def pair_counts(model: Model, keys: np.ndarray) -> np.ndarray:
    """Training counts of sorted distinct keys (0: unseen)."""
    n = np.zeros(len(keys), dtype=np.int64)
    for shard, at in by_shard(model, keys):
        try:
            held = read_array(model.root, f"pair-key-{shard}", "<u8")
        except FileNotFoundError:  # a split that no training bigram fell into
            continue
        place = np.minimum(np.searchsorted(held, keys[at]), len(held) - 1)
        hit = held[place] == keys[at]
        c = read_array(model.root, f"pair-count-{shard}", "u1")[place[hit]].astype(np.int64)
        if (c == MANY).any():
            where, count = read_array(model.root, f"pair-many-{shard}", "<i8").reshape(2, -1)
            c[c == MANY] = count[np.searchsorted(where, place[hit][c == MANY])]
        n[at[hit]] = c
    return n


def block_scores(model: Model, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, known, log10 p, log10 base p) of every token of a block."""
    before, token, text = block.pairs()
    if not model.tokens:
        zero = np.zeros(len(token))
        return text, zero, zero, np.full(len(token), 0.0)
    ids, by_word = ids_of(model, block.hashes(), "word-count", "free", "lower")
    lower = np.where(ids >= 0, by_word["lower"], model.unseen)
    count = by_word["word-count"]
    p = lower[token]
    # An unseen word, or one that only training texts' ends follow, has no history to look up.
    seen = np.nonzero((ids[before] >= 0) & (ids[token] >= 0))[0]
    keys = ids[before[seen]].astype(np.uint64) << np.uint64(32) | ids[token[seen]].astype(np.uint64)
    distinct, back = np.unique(keys, return_inverse=True)
    c = pair_counts(model, distinct)[back]
    known = np.nonzero(ids[before] >= 0)[0]
    p[known] *= by_word["free"][before[known]]
    p[seen] += (c - np.array(model.discounts)[np.minimum(c, 3)]) / count[before[seen]]
    base = np.log10((count + 1) / (model.tokens + model.distinct + 1))
    return text, count[token] > 0, np.log10(p), base[token]


SCORES = "n_tokens long, n_known long, base_score double, score double"


def score(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """The columns ``keep`` of every row with SCORES: token counts and log10 probabilities.

    A null text counts as empty: it has one token, the end.
    """

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            total = np.zeros((4, len(pdf)))
            for block in blocks(pdf["text"]):
                text, known, ours, base = block_scores(model, block)
                for k, x in enumerate((np.ones(len(text)), known, base, ours)):
                    total[k] += np.bincount(text, weights=x, minlength=len(pdf))
            out = {c: pdf[c] for c in keep}
            out |= {"n_tokens": total[0].astype(np.int64), "n_known": total[1].astype(np.int64), "base_score": total[2], "score": total[3]}
            yield pd.DataFrame(out)

    kinds = dict(docs.dtypes)
    schema = "".join(f"`{c}` {kinds[c]}, " for c in keep) + SCORES
    return docs.select(*keep, F.col("text")).mapInPandas(scored, schema)


def perplexity(scores: DataFrame) -> DataFrame:
    """Adds ``perplexity``, the inverse mean probability per token, to the result of :func:`score`."""
    return scores.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
