"""Operator 8: benchmark decontamination by a prefix-filtered join.

Every benchmark item is cut into windows of ``size`` consecutive words (a shorter item is
one window). A document contains a window only if it contains the window's rarest word,
so that word alone is the necessary prefix: words are counted over all documents, each
window is keyed by its rarest word, document words are joined to those keys, the window's
place is bounded by the document's length, and the full run of words is compared.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.
Everything runs as DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimscope.llm.common import staged

SIZE = 10
#: Windows are broadcast up to this many bytes; beyond it, they are joined by a shuffle.
BROADCAST_BYTES = 64 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text; a null text has none. Only A-Z are lower-cased."""
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(low, NOT_WORD), lambda w: w != "")


def item_windows(benchmark: DataFrame, size: int) -> DataFrame:
    """(item_id, window): the distinct windows of every item; items without words have none."""
    w = benchmark.select(F.col("item_id"), words(F.col("text")).alias("ws")).where(F.size("ws") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("ws") - size + 1, F.lit(1)))
    return w.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("ws", i, size))).alias("window")).distinct()


def _hint(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def scanned(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, broadcast_bytes: int = BROADCAST_BYTES):
    """Documents and their occurrences of benchmark windows, and the windows' items.

    Returns (rows: doc_id, text_hash, n_words, window_id, start, length; owners:
    window_id, item_id). Every document has one row with a null window_id, and one for
    each occurrence; ``start`` counts its words from 0.
    """
    owned = staged(item_windows(benchmark, size), "windows")
    windows = owned.select("window").distinct().withColumn("window_id", F.xxhash64(F.concat_ws(" ", "window")))
    # The bound is looked up anew on every call: rows carry the window's words and ids.
    held = windows.agg(F.sum(F.lit(64) + 24 * F.size("window") + F.octet_length(F.concat_ws("", "window"))).alias("b")).first()
    small = (held["b"] or 0) <= broadcast_bytes

    # Outer generators below: an inner one would make Spark cut the words a second time,
    # in a filter against empty arrays.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("ws"))
    vocabulary = owned.select(F.explode("window").alias("word")).distinct()
    seen = (
        texts.select(F.explode_outer("ws").alias("word"))
        .join(_hint(vocabulary, small), "word", "left_semi")
        .groupBy("word")
        .agg(F.count("*").alias("df"))
    )
    # A window with a word that no document has cannot occur and falls out of the join.
    at = windows.select("window_id", "window", F.posexplode("window").alias("offset", "word"))
    ranked = at.join(_hint(seen, small), "word").groupBy("window_id").agg(
        F.min(F.struct("df", "word", "offset")).alias("rarest"), F.count("*").alias("found"), F.any_value("window").alias("window")
    )
    keyed = ranked.where(F.col("found") == F.size("window")).select(
        F.col("rarest.word").alias("word"), F.col("rarest.offset").alias("offset"), "window_id", "window"
    )
    keyed = staged(keyed, "prefixes")

    first = F.col("pos") - F.col("offset")
    length = F.size("window")

    def same(ws: Column) -> Column:
        return F.slice(ws, first + 1, length) == F.col("window")

    if small:
        # One pass: the words stay in place, only verified rows leave the scan's stage.
        # An empty word in front of each document meets a key of its own, which gives the
        # document's row.
        marked = texts.withColumn("ws", F.concat(F.array(F.lit("")), "ws"))
        spread = marked.select("doc_id", "text_hash", "ws", F.posexplode_outer("ws").alias("pos", "word"))
        # Made of literals: rows from the driver would start Python workers, which stay beside the others' for a while.
        values = {"word": F.lit(""), "offset": F.lit(0)}
        mark = keyed.sparkSession.range(1).select(*(values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in keyed.schema))
        fits = (first >= 1) & (first + length <= F.size("ws"))
        held = F.when(F.col("window_id").isNull(), True).when(fits, same(F.col("ws"))).otherwise(False)
        rows = spread.join(F.broadcast(keyed.unionByName(mark)), "word").where(held).select(
            "doc_id", "text_hash", (F.size("ws") - 1).alias("n_words"), "window_id",
            F.when(F.col("window_id").isNotNull(), first - 1).alias("start"),
            F.when(F.col("window_id").isNotNull(), length).alias("length"),
        )
    else:
        # Shuffle the words by key without their texts, then verify against the texts.
        spread = texts.select("doc_id", "text_hash", F.size("ws").alias("n_words"), F.posexplode_outer("ws").alias("pos", "word"))
        close = (first >= 0) & (first + length <= F.col("n_words"))
        cand = spread.join(keyed, "word").where(close).drop("word").distinct()
        whole = texts.dropDuplicates(["doc_id", "text_hash"])
        on = cand["doc_id"].eqNullSafe(whole["doc_id"]) & cand["text_hash"].eqNullSafe(whole["text_hash"])
        hits = cand.join(whole.select("doc_id", "text_hash", "ws"), on).where(same(F.col("ws")))
        hits = hits.select(cand["doc_id"], cand["text_hash"], "n_words", "window_id", first.alias("start"), length.alias("length"))
        none = texts.select(
            "doc_id", "text_hash", F.size("ws").alias("n_words"), F.lit(None).cast("long").alias("window_id"),
            F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("length"),
        )
        rows = hits.unionByName(none)
    owners = owned.select(F.xxhash64(F.concat_ws(" ", "window")).alias("window_id"), "item_id")
    return rows, owners


def covered(spans: Column) -> Column:
    """Number of places inside any of the (start, length) spans."""
    zero = F.struct(F.lit(0).cast("int").alias("end"), F.lit(0).cast("long").alias("n"))

    def add(acc, s):
        end = F.greatest(acc["end"], s["start"] + s["length"])
        return F.struct(end.alias("end"), (acc["n"] + end - F.greatest(acc["end"], s["start"])).alias("n"))

    return F.aggregate(F.array_sort(spans), zero, add, lambda acc: acc["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, text_hash, n_words, n_hit, items, contaminated), one row per row of ``docs``.

    ``n_hit`` counts the words inside any occurrence of a window, ``items`` is the sorted
    array of item ids (as strings) with an occurring window. A null or empty text has no
    words and no hits. The words of an item without id are hit like any other's, only its
    null is not listed. Rows with a null or repeated doc_id each get the result of their own
    text, which ``text_hash`` names. Other columns are ignored; empty tables give no rows, or
    no hits.
    """
    rows, owners = scanned(docs, benchmark, size, broadcast_bytes)
    rows = staged(rows, "occurrences")
    key = ["doc_id", "text_hash"]
    hits = rows.where(F.col("window_id").isNotNull())
    spans = hits.groupBy(*key).agg(covered(F.collect_set(F.struct("start", "length"))).alias("n_hit"))
    items = (
        hits.select(*key, "window_id").distinct().join(owners, "window_id")
        .select(*key, F.col("item_id").cast("string").alias("item")).distinct()
        .groupBy(*key).agg(F.sort_array(F.collect_list("item")).alias("items"))
    )
    found = spans.join(items, spans["doc_id"].eqNullSafe(items["doc_id"]) & spans["text_hash"].eqNullSafe(items["text_hash"]))
    found = found.select(spans["doc_id"].alias("of"), spans["text_hash"].alias("of_text"), "n_hit", "items")
    rows = rows.where(F.col("window_id").isNull()).select("doc_id", "text_hash", F.col("n_words").cast("long").alias("n_words"))
    out = rows.join(found, F.col("doc_id").eqNullSafe(F.col("of")) & F.col("text_hash").eqNullSafe(F.col("of_text")), "left")
    return out.select(
        "doc_id",
        "text_hash",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def digest(result: DataFrame) -> DataFrame:
    """The report with the item list as a count and a SHA-256 of the joined ids."""
    return result.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        "contaminated",
    )
