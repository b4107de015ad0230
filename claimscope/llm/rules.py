"""Operator 4: quality rules by distribution divergence.

A document is compared with every language's reference in two histograms: the classes of
its characters, and its common words (one bucket per word of a fixed list, one for all
other words). The measure is the Jensen-Shannon distance with base two, 0 to 1. A
document passes if one language's reference is near in both histograms. Short documents
have noisy histograms: below the minimum lengths a histogram is not judged.

References are the mean histograms of all documents of a language that pass the base
rules, so that neither long documents nor repetitive ones rule them. Everything runs as
DataFrame operations inside a row, but for one aggregate over the languages.

Words are ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimscope.llm.common import staged

MIN_WORDS, REPEAT_PERCENT, WINDOW = 50, 50, 3
#: Guards: fewer characters or words than these are not judged by the histogram.
MIN_CHARS_JUDGED, MIN_WORDS_JUDGED = 200, 50
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.20, 0.45

# Common words of English, German, French and Spanish.
COMMON = (
    "the of and to in a is that for it as was with be by on are this an from at or not "
    "der die und das ist nicht ein eine mit von den dem zu im für auf sich des als er "
    "le la les et des un une du est que pour dans qui par sur au pas plus en "
    "el los las que y un una es por para con del se su no lo como más"
).split()

SPACE = r"[\x20\x09-\x0D]+"
#: Character classes in order; each pattern takes its characters out of what is left.
CLASSES = (
    ("lower", r"[a-z]+"),
    ("space", SPACE),
    ("stops", r"[.,;:]+"),
    ("upper", r"[A-Z]+"),
    ("beyond_ascii", r"[^\x00-\x7F]+"),
    ("digits", r"[0-9]+"),
    ("quotes", r"['\"()\-]+"),
)
SYMBOLS = r"[^#*$%&|<>]+"


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def repeated_words(ws: Column) -> Column:
    """Number of words inside word windows that occur at least twice.

    Window hashes are sorted together with their places; equal neighbours give the
    places of repeated windows, whose spans are then added up from left to right.
    """
    n = F.size(ws) - (WINDOW - 1)
    hashes = F.transform(
        F.slice(ws, 1, F.greatest(n, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2)),
    )

    def places(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        again = let(
            ordered,
            lambda o: F.filter(o, lambda x, i: (F.get(o, i - 1)["h"] == x["h"]) | (F.get(o, i + 1)["h"] == x["h"])),
        )
        return F.sort_array(F.transform(again, lambda x: x["i"]))

    def total(at: Column) -> Column:
        gaps = F.transform(at, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - x, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda acc, x: acc + x)

    def count(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(places(h), total))

    return let(hashes, count)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, the base numbers, and both histograms of every row's text.

    ``chars`` has the share of each class and of the rest, ``common`` the share of each
    common word that occurs. A null text counts as empty.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.coalesce("text", F.lit("")).alias("text"))
    # Each step feeds several columns of the next; Spark keeps such projections apart.
    rows = rows.select(
        "doc_id", "lang", F.length("text").alias("n_chars"),
        F.length(F.regexp_replace("text", SYMBOLS, "")).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        words(F.col("text")).alias("ws"), F.col("text").alias("rest_0"),
    )
    left = "rest_0"
    for k, (name, pattern) in enumerate(CLASSES, 1):
        rows = rows.withColumn(f"rest_{k}", F.regexp_replace(left, pattern, "")).withColumn(f"c_{name}", F.length(left) - F.length(f"rest_{k}"))
        rows, left = rows.drop(left), f"rest_{k}"
    size = F.greatest(F.col("n_chars"), F.lit(1)).cast("double")
    chars = F.array(*((F.col(f"c_{name}") / size) for name, _ in CLASSES), F.length(left) / size)
    known = sorted(set(COMMON))

    def histogram(found: Column, n: Column) -> Column:
        return F.map_from_entries(
            F.transform(
                F.array_distinct(found),
                lambda w: F.struct(w, (F.size(F.filter(found, lambda x: x == w)) / F.greatest(n, F.lit(1)).cast("double")).alias("p")),
            )
        )

    def is_common(w: Column) -> Column:
        return w.isin(known)

    # A word counts as common without the stop marks behind it.
    plain = F.transform("ws", lambda w: F.translate(w, ".,;:", ""))
    plain = F.filter(plain, is_common)
    return rows.select(
        "doc_id", "lang", F.col("n_chars").cast("long").alias("n_chars"),
        F.size("ws").cast("long").alias("n_words"),
        # Characters of words: all but the white space.
        (F.col("n_chars") - F.col("c_space")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("ws")).alias("n_repeat_words"),
        chars.alias("chars"),
        let(plain, lambda found: histogram(found, F.size("ws"))).alias("common"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def references(rows: DataFrame) -> DataFrame:
    """(ref_lang, ref_chars, ref_common): mean histograms of each language's documents that pass the base rules."""
    good = rows.where(F.col("lang").isNotNull() & ~base_failed())
    width = len(CLASSES) + 1
    known = sorted(set(COMMON))
    sums = good.groupBy("lang").agg(
        *(F.avg(F.col("chars")[k]).alias(f"c{k}") for k in range(width)),
        *(F.avg(F.coalesce(F.try_element_at("common", F.lit(w)), F.lit(0.0))).alias(f"w{i}") for i, w in enumerate(known)),
    )
    entries = F.array(*(F.struct(F.lit(w).alias("key"), F.col(f"w{i}").alias("value")) for i, w in enumerate(known)))
    return sums.select(
        F.col("lang").alias("ref_lang"),
        F.array(*(F.col(f"c{k}") for k in range(width))).alias("ref_chars"),
        F.map_from_entries(entries).alias("ref_common"),
    )


def divergence(p: Column, q: Column) -> Column:
    """One bucket's part of the Jensen-Shannon divergence of shares p and q, base two."""
    def side(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2.0 * a / (a + b))).otherwise(F.lit(0.0))

    return 0.5 * (side(p, q) + side(q, p))


def char_distance(p: Column, q: Column) -> Column:
    parts = F.zip_with(p, q, divergence)
    return F.sqrt(F.greatest(F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x), F.lit(0.0)))


def word_distance(p: Column, q: Column, q_mass: Column) -> Column:
    """Distance of two common-word maps, whose missing shares are those of all other words."""
    met = F.transform(
        F.map_entries(p), lambda e: F.struct(e["value"].alias("p"), F.coalesce(F.try_element_at(q, e["key"]), F.lit(0.0)).alias("q"))
    )
    zero = F.struct(F.lit(0.0).alias("js"), F.lit(0.0).alias("p"), F.lit(0.0).alias("q"))
    sums = F.aggregate(
        met, zero,
        lambda acc, x: F.struct(
            (acc["js"] + divergence(x["p"], x["q"])).alias("js"), (acc["p"] + x["p"]).alias("p"), (acc["q"] + x["q"]).alias("q")
        ),
    )
    # A bucket that only the reference fills adds half its share; then the bucket of all other words.
    rest = F.struct(F.greatest(1.0 - q_mass, F.lit(0.0)).alias("q"))
    return let(
        F.struct(sums.alias("s"), rest.alias("r"), q_mass.alias("m")),
        lambda v: F.sqrt(
            F.greatest(
                v["s"]["js"] + 0.5 * (v["m"] - v["s"]["q"]) + divergence(F.greatest(1.0 - v["s"]["p"], F.lit(0.0)), v["r"]["q"]),
                F.lit(0.0),
            )
        ),
    )


def judge(docs: DataFrame) -> DataFrame:
    """Base numbers, distances and verdict, one row per row of ``docs``.

    ``char_distance`` and ``word_distance`` are those of the nearest language (``near_lang``,
    by their sum; ties by name); they are null if there is no reference. Without one, or
    below the guards, a histogram is not held against a document. A null text has no words
    and fails the base rules. Rows with a null or repeated doc_id are judged one by one,
    a null lang is only left out of the references. Other columns are ignored; an empty
    table gives no rows.
    """
    rows = staged(measured(docs), "rules")
    # One row per language, of fixed width, in one array: a scalar subquery, no join.
    entry = F.struct("ref_lang", "ref_chars", F.map_entries("ref_common").alias("words"))
    listed = references(rows).groupBy().agg(F.sort_array(F.collect_list(entry)).alias("refs"))

    def opened(r: Column) -> Column:
        mass = F.aggregate(r["words"], F.lit(0.0), lambda acc, e: acc + e["value"])
        return F.struct(r["ref_lang"].alias("lang"), r["ref_chars"].alias("chars"), F.map_from_entries(r["words"]).alias("words"), mass.alias("mass"))

    listed = listed.select(F.transform("refs", opened).alias("refs"))

    def compare(r: Column) -> Column:
        c = F.when(F.col("n_chars") >= MIN_CHARS_JUDGED, char_distance(F.col("chars"), r["chars"]))
        w = F.when(F.col("n_words") >= MIN_WORDS_JUDGED, word_distance(F.col("common"), r["words"], r["mass"]))
        return F.struct(r["lang"].alias("lang"), c.alias("c"), w.alias("w"))

    def ranked(x: Column) -> Column:
        total = F.coalesce(x["c"], F.lit(0.0)) + F.coalesce(x["w"], F.lit(0.0))
        return F.struct(total.alias("total"), x["lang"].alias("lang"), x["c"].alias("c"), x["w"].alias("w"))

    both = rows.withColumn("refs", listed.scalar())
    near = both.withColumn("near", F.array_min(F.transform(F.transform("refs", compare), ranked)))
    passes = (F.coalesce("near.c", F.lit(0.0)) <= MAX_CHAR_DISTANCE) & (F.coalesce("near.w", F.lit(0.0)) <= MAX_WORD_DISTANCE)
    return near.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"),
        (~base_failed() & passes).alias("kept"),
        F.col("near.lang").alias("near_lang"),
        F.col("near.c").alias("char_distance"),
        F.col("near.w").alias("word_distance"),
    )
