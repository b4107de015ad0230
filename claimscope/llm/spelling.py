"""Spelling variants: words one edit apart, found by range searches in k-d trees of letter counts.

One inserted, deleted or replaced letter changes a word's letter-count vector by one up, one
down, or one of each: an L1 distance of two at most. So the words near a word of length L lie
in small boxes around its vector, in the trees of lengths L and L + 1 (a deletion is the
insertion seen from the other side). Letter order is checked on the pairs found.

The words are counted by Spark. Planes of the upper trees, one tree per length, come from a
bounded sample; they only deal words to cells, every word is in exactly one cell and every
search visits all cells its box meets, so the planes affect balance, not results. Cells are
Spark groups; each builds the lower tree over its words and searches it for the words dealt
to it, many at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimscope.llm.common import staged

RUN = "[A-Za-zÀ-ÿ]+"
#: Every so many (document, word) pairs lose a letter.
SLIP = 199
MIN_LETTERS = 6
MIN_COUNT = 5
#: A form must be so many times as frequent as the word.
MORE = 5

#: Bound of the sample that the upper planes are cut from, and words a cell aims at.
SAMPLE = 65_536
CELL = 8_192
LEAF = 32
DIMS = 32
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): the words of whole texts after slips, with at least MIN_LETTERS and MIN_COUNT.

    A null text has no words, a null doc_id is written as an empty string; repeated rows
    count each. Occurrences are added up on the map side, so frequent words cost one row a task.
    """
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    runs = docs.select(doc.alias("doc"), F.explode(F.regexp_extract_all("text", F.lit(f"({RUN})"), F.lit(1))).alias("run"))
    # lower() of a pure ASCII run touches A-Z only and is fast; other runs go letter by letter.
    ascii_only = F.octet_length("run") == F.char_length("run")
    low = F.when(ascii_only, F.lower("run")).otherwise(F.translate("run", CAPITALS, SMALL))
    runs = runs.select("doc", low.alias("run"))
    h = F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary"))
    runs = runs.select("run", h.alias("h"), F.char_length("run").alias("size"))
    at = (F.col("h") % F.col("size")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + F.lit(2), F.col("size")))
    word = F.when(F.col("h") % SLIP == 0, cut).otherwise(F.col("run"))
    words = runs.select(word.alias("word")).where(F.char_length("word") >= MIN_LETTERS)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_COUNT)


def code_points(words: list[str], length: int) -> np.ndarray:
    """Words of one length as rows of code points."""
    return np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").reshape(len(words), length)


def letter_counts(points: np.ndarray) -> np.ndarray:
    """Counts per dimension: a to z, all other letters dealt over the rest."""
    dim = np.where((points >= 97) & (points <= 122), points - 97, 26 + points % (DIMS - 26)).astype(np.int64)
    rows = np.arange(len(points))[:, None] * DIMS
    return np.bincount((rows + dim).ravel(), minlength=len(points) * DIMS).reshape(len(points), DIMS).astype(np.int16)


def unary_codes(counts: np.ndarray) -> np.ndarray:
    """Two bits a dimension, as many set as the count up to two: bits that differ bound L1 from below."""
    code = np.zeros(len(counts), dtype=np.uint64)
    for d in range(DIMS):
        code |= ((counts[:, d] >= 1).astype(np.uint64) | ((counts[:, d] >= 2).astype(np.uint64) << np.uint64(1))) << np.uint64(2 * d)
    return code


def plane(counts: np.ndarray) -> tuple[int, int] | None:
    """Dimension and value that split the vectors most evenly (value and above go right); None if all are equal."""
    middle = len(counts) / 2
    best = None
    for d in np.nonzero(counts.max(axis=0) > counts.min(axis=0))[0]:
        below = np.cumsum(np.bincount(counts[:, d]))[:-1]
        v = int(np.argmin(np.abs(below - middle)))
        off = abs(below[v] - middle)
        if 0 < below[v] < len(counts) and (best is None or off < best[0]):
            best = (off, int(d), v + 1)
    return None if best is None else best[1:]


def upper_tree(counts: np.ndarray, cells: int) -> list:
    """Planes as nested [dim, value, left, right]; leaves are cell numbers counted from the left."""
    leaves = iter(range(1 << 30))

    def grow(rows: np.ndarray, want: int) -> list | int:
        cut = plane(counts[rows]) if want > 1 and len(rows) > 1 else None
        if cut is None:
            return next(leaves)
        right = counts[rows, cut[0]] >= cut[1]
        return [*cut, grow(rows[~right], want // 2), grow(rows[right], want // 2)]

    return grow(np.arange(len(counts)), cells)


def visits(tree: list | int, counts: np.ndarray, up: int, down: int) -> Iterator[tuple[int, np.ndarray]]:
    """(cell, rows) for the rows whose box, ``up`` letters more and ``down`` letters less, meets the cell."""
    stack = [(tree, np.arange(len(counts)), np.full(len(counts), up), np.full(len(counts), down), {})]
    while stack:
        node, rows, ups, downs, box = stack.pop()
        if not len(rows):
            continue
        if not isinstance(node, list):
            yield node, rows
            continue
        d, value, left, right = node
        low, high = box.get(d, (0, np.inf))
        x = counts[rows, d]
        # What this dimension has already cost in the box above, and would cost on either side.
        paid_up, paid_down = np.maximum(low - x, 0), np.maximum(x - high, 0)
        left_down = downs + paid_down - np.maximum(x - (value - 1), 0)
        right_up = ups + paid_up - np.maximum(value - x, 0)
        keep = left_down >= 0
        stack.append((left, rows[keep], ups[keep], left_down[keep], {**box, d: (low, value - 1)}))
        keep = right_up >= 0
        stack.append((right, rows[keep], right_up[keep], downs[keep], {**box, d: (value, high)}))


def near_in_cell(words: np.ndarray, seekers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (seeker, word) exactly one edit apart.

    ``words`` and ``seekers`` are code-point rows; seekers have the words' length (one letter
    replaced) or one letter less (one inserted).
    """
    same = words.shape[1] == seekers.shape[1]
    down = 1 if same else 0
    w, q = letter_counts(words), letter_counts(seekers)
    w_code, q_code = unary_codes(w), unary_codes(q)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    stack = [(np.arange(len(w)), np.arange(len(q)))]
    while stack:
        rows, asked = stack.pop()
        vectors, wanted = w[rows], q[asked]
        over = np.maximum(vectors.min(axis=0) - wanted, 0).sum(axis=1)
        under = np.maximum(wanted - vectors.max(axis=0), 0).sum(axis=1)
        asked = asked[(over <= 1) & (under <= down)]
        if not len(asked):
            continue
        cut = plane(vectors) if len(rows) > LEAF else None
        if cut is not None:
            right = vectors[:, cut[0]] >= cut[1]
            stack += [(rows[~right], asked), (rows[right], asked)]
            continue
        # Blocks bound the pair matrix, also where many words share one vector.
        step = max(1, (1 << 20) // len(rows))
        for k in range(0, len(asked), step):
            part = asked[k : k + step]
            apart = np.bitwise_count(q_code[part][:, None] ^ w_code[rows][None, :])
            i, j = np.nonzero(apart <= 1 + down)
            i, j = part[i], rows[j]
            ok = one_edit(seekers[i], words[j])
            found.append((i[ok], j[ok]))
    if not found:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows of ``a`` that become the row of ``b`` by one replaced letter, or by one inserted if ``b`` is longer."""
    size = a.shape[1]
    if b.shape[1] == size:
        return (a != b).sum(axis=1) == 1
    head = np.logical_and.accumulate(a == b[:, :size], axis=1).sum(axis=1)
    tail = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return head + tail >= size


def upper_trees(words: DataFrame) -> dict[int, list]:
    """One upper tree per word length, cut from about SAMPLE words at most, those of least hash."""
    sizes = {r["size"]: r["n"] for r in words.groupBy(F.char_length("word").alias("size")).agg(F.count(F.lit(1)).alias("n")).collect()}
    share = min(1.0, SAMPLE / max(sum(sizes.values()), 1))
    # A cut through the hashes needs no sort, which would bring every task's candidates to the driver.
    picked = [r[0] for r in words.select("word").where(F.pmod(F.xxhash64("word"), F.lit(1 << 32)) < int(share * (1 << 32))).collect()]
    by_size: dict[int, list[str]] = {size: [] for size in sizes}
    for word in picked:
        by_size[len(word)].append(word)
    trees = {}
    for size, some in by_size.items():
        cells = 1 << max(0, (sizes[size] - 1) // CELL).bit_length()
        counts = letter_counts(code_points(some, size)) if some else np.zeros((0, DIMS), dtype=np.int16)
        trees[size] = upper_tree(counts, min(cells, max(1, len(some) // 8)))
    return trees


def dealt(words: DataFrame, trees: dict[int, list]) -> DataFrame:
    """(size, cell, seeks, word, n): each word in its cell, and in each cell its search must visit."""

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for size, part in pdf.groupby(pdf["word"].str.len()):
                counts = letter_counts(code_points(part["word"].tolist(), size))
                for seeks, tree_size, up, down in ((False, size, 0, 0), (True, size, 1, 1), (True, size + 1, 1, 0)):
                    if tree_size not in trees:
                        continue
                    for cell, rows in visits(trees[tree_size], counts, up, down):
                        some = part.iloc[rows]
                        yield pd.DataFrame({"size": tree_size, "cell": cell, "seeks": seeks, "word": some["word"], "n": some["n"]})

    return words.mapInPandas(deal, "size int, cell int, seeks boolean, word string, n long")


def search_cell(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links (word, near, near_n) between the words of one cell and those that seek there."""
    size = int(pdf["size"].iloc[0])
    own = pdf[~pdf["seeks"]]
    out = [pd.DataFrame({"word": [], "near": [], "near_n": []})]
    points = code_points(own["word"].tolist(), size)
    for length in (size, size - 1):
        ask = pdf[pdf["seeks"] & (pdf["word"].str.len() == length)]
        if not len(own) or not len(ask):
            continue
        i, j = near_in_cell(points, code_points(ask["word"].tolist(), length))
        a, b = ask.iloc[i], own.iloc[j]
        out.append(pd.DataFrame({"word": a["word"].to_numpy(), "near": b["word"].to_numpy(), "near_n": b["n"].to_numpy()}))
        if length < size:  # the longer word finds the shorter one here too
            out.append(pd.DataFrame({"word": b["word"].to_numpy(), "near": a["word"].to_numpy(), "near_n": a["n"].to_numpy()}))
    return pd.concat(out, ignore_index=True).astype({"near_n": "int64"})


def links(words: DataFrame) -> DataFrame:
    """(word, near, near_n): every ordered pair of words exactly one edit apart, once."""
    cells = dealt(words, upper_trees(words)).groupBy("size", "cell")
    return cells.applyInPandas(search_cell, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of all words with a form: links followed to the last by doubling.

    Counts grow by MORE along a chain, so it has under 28 links and ends after 5 rounds.
    """
    found = staged(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = found.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = found.join(ahead, "root", "left")
        found = staged(longer.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        if found.where("moved").isEmpty():
            return found.drop("moved")
        found = found.drop("moved")


def variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of :func:`word_counts`.

    ``form`` is the near word of largest count (ties: smallest) if that count is at least
    MORE times the word's, else null; ``root`` the end of the chain of forms, or the word.
    A table without words gives no rows.
    """
    words = staged(word_counts(docs), "spelling-words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best")
    near = links(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    told = words.join(near, "word", "left")
    enough = -F.col("best.less") >= MORE * F.col("n")
    told = told.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"),
    )
    told = staged(told, "spelling-forms")
    ends = roots(told.where(F.col("form").isNotNull()))
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
