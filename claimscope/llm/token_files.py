"""Operator 10: token ids as ORC files that can be read stripe by stripe.

Each file holds one contiguous range of document ids in ascending order, as rows
(doc_id, n_tokens, offset, ids): ``ids`` ends with the end id and is stored with ORC's
integer run-length encoding, ``offset`` counts the ids before the row in its file. Row
indexes and a Bloom filter on doc_id let a reader skip stripes and row groups from
metadata alone; any stripe can be read on its own, in parallel.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimscope.llm.common import arrow_rows, one_thread_per_task, per_worker

END_ID = 0
#: Parts whose ids a worker remembers, letters that it encodes at a time, and parts in one call's text.
CACHED_PARTS, LETTERS, GROUP = 400_000, 2_000_000, 100
#: Texts in one Arrow batch.
TEXTS = 500
SPACE, MARKS = 0x20, b".,;:!?"
#: ORC settings of the written files; the stripe is the unit of parallel reads.
ORC = {
    "compression": "zstd",
    "orc.stripe.size": str(16 << 20),
    "orc.row.index.stride": "1000",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}
#: Most ids that leave a worker in one Arrow batch; a longer document is a batch of its own.
IDS_PER_BATCH = 2_000_000


def _letters() -> np.ndarray:
    """Of each character of two UTF-8 bytes, by its lower eleven bits, whether it is a letter."""
    return np.array([c >= 0x80 and unicodedata.category(chr(c)).startswith("L") for c in range(1 << 11)])


def _marks(found: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(found)] = True
    return out


LETTER_OF_TWO, IS_MARK = _letters(), _marks(MARKS)
PLAIN = _marks(b"".join(bytes([c]) for c in range(128) if chr(c).isalnum()))
#: Last bytes of the blank characters U+2000 to U+202F.
WIDE_BLANK = _marks(bytes([*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF]))


def _blank(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Whether three bytes from the start of a character on are, or begin with, a blank outside ASCII."""
    two = (x == 0xC2) & ((y == 0x85) | (y == 0xA0))
    general = (x == 0xE2) & (((y == 0x80) & WIDE_BLANK[z]) | ((y == 0x81) & (z == 0x9F)))
    return two | general | ((x == 0xE1) & (y == 0x9A) & (z == 0x80)) | ((x == 0xE3) & (y == 0x80) & (z == 0x80))


def part_starts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where the parts of texts start, ascending, and the end of the last text.

    ``data`` are the UTF-8 bytes of the texts in a row, ``bounds`` their first bytes and the
    end. A part starts at a text, at a space between two characters that are neither blank
    nor control, and at a mark that a letter or digit precedes and such a space, or the
    text's end, follows. The library's pieces never cross these places.
    """
    b = np.concatenate([np.zeros(3, dtype=np.uint8), data, np.zeros(3, dtype=np.uint8)])
    at = np.flatnonzero(data == SPACE) + 3
    left, right = b[at - 1], b[at + 1]
    safe = (left > SPACE) & (right > SPACE)
    wide = np.flatnonzero(safe & ((left >= 0x80) | (right >= 0x80)))
    p = at[wide]
    before = _blank(b[p - 3], b[p - 2], b[p - 1]) | _blank(b[p - 2], b[p - 1], np.zeros(len(p), dtype=np.uint8))
    safe[wide[before | _blank(b[p + 1], b[p + 2], b[p + 3])]] = False
    at = at[safe]
    ends = np.concatenate([at, bounds[1:][np.diff(bounds) > 1] + 3])
    ends = ends[IS_MARK[b[ends - 1]]]
    two = (b[ends - 3] & 0xE0) == 0xC0
    letter = two & LETTER_OF_TWO[(b[ends - 3] & 0x1F).astype(np.int64) << 6 | (b[ends - 2] & 0x3F)]
    marks = ends[PLAIN[b[ends - 2]] | letter] - 1
    starts = np.zeros(len(data) + 1, dtype=bool)
    for x in (bounds, at - 3, marks - 3):
        starts[x] = True
    return np.flatnonzero(starts)


class PartEncoder:
    """Token ids of texts from the tokenizers library, which sees each distinct part once.

    The library's pieces never cross the ends of a part (see :func:`part_starts`), so
    unseen parts are joined into longer texts, encoded in one call, and the ids dealt back
    by their byte lengths. Ids of parts that came again are kept for the next texts.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        one_thread_per_task()
        self.lib = Tokenizer.from_file(vocabulary)
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        size = self.lib.get_vocab_size(with_added_tokens=True)
        # In a byte-level vocabulary each character of a token's name is one byte.
        self.length = np.array([len(self.lib.id_to_token(i) or "") for i in range(size)], dtype=np.int64)
        self.known, self.ids = _no_parts()

    def _coded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts in a row, and how many each has."""
        coded = [np.array(x.ids, dtype=np.int32) for x in self.lib.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, dtype=np.int32), *coded]), np.array([len(x) for x in coded], dtype=np.int64)

    def _learned(self, parts: pa.Array) -> pa.ListArray:
        """Ids of distinct parts."""
        at, data = _bytes_of(parts)
        b = np.concatenate([data, np.zeros(3, dtype=np.uint8)])
        first, second, last = (b[np.minimum(x, len(data))] for x in (at[:-1], at[:-1] + 1, at[1:] - 1))
        # A space and a character that is not blank in front: no piece reaches back over it.
        joins = (first == SPACE) & (second > SPACE) & (last > SPACE) & (np.diff(at) > 1)
        joins &= ~_blank(second, b[at[:-1] + 2], b[np.minimum(at[:-1] + 3, len(data))])
        joined, alone = np.flatnonzero(joins), np.flatnonzero(~joins)
        ends, raw = _bytes_of(parts.take(pa.array(joined)))
        edges = [*ends[:-1:GROUP].tolist(), int(ends[-1])]
        flat, _ = self._coded([raw[i:j].tobytes().decode("utf-8") for i, j in zip(edges, edges[1:])])
        size = np.cumsum(self.length[flat])
        stops = np.searchsorted(size, ends[1:], side="left") + 1
        if len(stops) and (stops[-1] != len(flat) or not np.array_equal(size[stops - 1], ends[1:])):
            raise ValueError("the vocabulary's tokens do not end where the parts end")
        others, n = self._coded([x.decode("utf-8") for x in parts.take(pa.array(alone)).to_pylist()])
        offsets = np.concatenate([[0], stops, len(flat) + np.cumsum(n)])
        ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([flat, others])))
        back = np.empty(len(parts), dtype=np.int64)
        back[np.concatenate([joined, alone])] = np.arange(len(parts))
        return ids.take(pa.array(back))

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (no nulls) in a row, and how many each text has."""
        bounds, data = _bytes_of(texts.cast(pa.binary()))
        starts = part_starts(data, bounds)
        special = np.zeros(len(texts), dtype=bool)
        for x in self.special:
            special |= pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
        if special.any():  # the library cuts such a text by itself
            owner = np.searchsorted(bounds, starts, side="right") - 1
            inside = starts > bounds[np.minimum(owner, len(texts))]
            starts = starts[~(inside & special[np.minimum(owner, len(texts) - 1)])]
        parts = pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(data)])
        coded = parts.dictionary_encode()
        distinct, which = coded.dictionary, coded.indices.to_numpy()
        kept = pc.index_in(distinct, value_set=self.known)
        fresh = np.flatnonzero(kept.is_null().to_numpy(zero_copy_only=False))
        ids = pa.concat_arrays([self.ids, self._learned(distinct.take(pa.array(fresh)))])
        row = kept.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        row[fresh] = len(self.known) + np.arange(len(fresh))
        found = ids.take(pa.array(row[which]))
        n = np.concatenate([[0], np.cumsum(np.diff(found.offsets.to_numpy()))])
        n = np.diff(n[np.searchsorted(starts, bounds)])
        self._keep(distinct, ids, row, np.bincount(which, minlength=len(distinct)))
        return found.flatten().to_numpy(), n

    def _keep(self, distinct: pa.Array, ids: pa.ListArray, row: np.ndarray, times: np.ndarray) -> None:
        """Remember the parts that came again; those longest unseen go first."""
        again = np.flatnonzero((times > 1) | (row < len(self.known)))
        unseen = np.ones(len(self.known), dtype=bool)
        unseen[row[row < len(self.known)]] = False
        older = np.flatnonzero(unseen)
        rows = np.concatenate([older, row[again]])[-CACHED_PARTS:]
        parts = pa.concat_arrays([self.known.take(pa.array(older)), distinct.take(pa.array(again))])
        self.known, self.ids = parts[-len(rows) :] if len(rows) else _no_parts()[0], ids.take(pa.array(rows))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        flat, n = self.flat(pa.array(texts, pa.string()))
        ends = np.cumsum(n)
        return [flat[i:j].astype("<u4").tobytes() for i, j in zip((ends - n).tolist(), ends.tolist())]


def _no_parts() -> tuple[pa.Array, pa.ListArray]:
    return pa.array([], pa.binary()), pa.array([], pa.list_(pa.int32()))


def _bytes_of(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bounds and bytes of binary values in a row, the first at 0."""
    if not len(values):
        return np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, dtype=np.int32, count=len(values) + 1, offset=4 * values.offset).astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return at - at[0], raw[at[0] : at[-1]]


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("offset", pa.int64()), ("ids", pa.list_(pa.int32()))])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows (doc_id, text) of Arrow batches, about LETTERS bytes of text at a time, or one longer text."""
    held, size = [], 0
    for batch in batches:
        n = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            done = int(n[at - 1]) if at else 0
            to = int(np.searchsorted(n, done + LETTERS - size, side="right"))
            if to == at and held:
                yield pa.concat_batches(held)
                held, size = [], 0
                continue
            to = max(to, at + 1)
            held.append(batch.slice(at, to - at))
            size += int(n[to - 1]) - done
            at = to
    if held:
        yield pa.concat_batches(held)


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID) -> None:
    """Write the token ids of ``docs`` (doc_id, text) to ORC files under ``path``.

    Documents go in ascending doc_id order over the files (null ids first, repeated ids
    by their text's hash); a null text has only the end id. Other columns are ignored; an
    empty table writes no rows.
    """

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, offset = per_worker(("parts", vocabulary), lambda: PartEncoder(vocabulary)), 0
        for rows in _gathered(batches):
            flat, n = encoder.flat(rows.column(1))
            ends = np.cumsum(n)
            flat = np.insert(flat, ends, np.array(end_id, dtype=np.uint32).astype(np.int32))
            n, ends = n + 1, ends + np.arange(1, len(n) + 1)
            first = 0
            while first < len(n):
                base = int(ends[first] - n[first])
                last = max(first + 1, int(np.searchsorted(ends, base + IDS_PER_BATCH, side="right")))
                at = np.concatenate([[0], ends[first:last] - base])
                ids = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat[base : base + at[-1]]))
                yield pa.record_batch(
                    [rows.column(0).slice(first, last - first), pa.array(n[first:last]), pa.array(offset + at[:-1]), ids], schema=SCHEMA
                )
                offset += int(at[-1])
                first = last

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = ("doc_id", F.xxhash64("text"))
    out = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    out = out.mapInArrow(encoded, "doc_id long, n_tokens long, offset long, ids array<int>")
    with arrow_rows(docs.sparkSession, TEXTS):
        out.write.options(**ORC).orc(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): what the files hold, with each document's global start."""
    rows = spark.read.schema("doc_id long, n_tokens long, offset long, ids array<int>").orc(path)
    # Files are numbered in id order; names compare as text, so the number is taken out.
    part = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("long")
    rows = rows.withColumn("part", part)
    sizes = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row of two numbers per file: metadata, not data.
    bases = sizes.select(F.col("part").alias("of"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(bases), rows["part"] == bases["of"]).select(
        "doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids"
    )


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Rows of some documents; stripes and row groups are skipped by statistics and Bloom filters."""
    return spark.read.orc(path).where(F.col("doc_id").isin(doc_ids))


def digests(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of rows with ``ids``."""

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for batch in batches:
            ids = batch.column(2)
            flat = ids.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)
            at = ids.offsets.to_numpy()
            n = np.diff(at).astype(np.int64)
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(n), pa.array(crc, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    rows = tokens.select("doc_id", "start", "ids")
    return rows.mapInArrow(digested, "doc_id long, start long, n_tokens long, ids_crc32 long")
