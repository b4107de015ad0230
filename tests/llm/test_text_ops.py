"""Token counts, token files, language ID and chat formatting against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from claimscope.llm import bpe, chat, common, language, token_files
from claimscope.llm.common import new_folder
from llm_docs import docs  # noqa: F401
from pyspark.sql import functions as F

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
PARTS = list("ab Z1.,'\n\t\r é日😀<|>\\") + ["\u00a0", "\u3000", "<|endoftext|>", "'s", "  ", "\n\n", " word,", "<|im_end|>"]
ODD = st.lists(st.sampled_from(PARTS), max_size=40).map("".join)


@pytest.fixture(scope="module")
def lib():
    return Tokenizer.from_file(BYTE_BPE)


@pytest.fixture(scope="module")
def counter():
    return bpe.TokenCounter(BYTE_BPE)


@pytest.fixture(scope="module")
def encoder():
    return token_files.PartEncoder(BYTE_BPE)


@settings(max_examples=400, deadline=None)
@given(ODD)
def test_count_and_ids_equal_the_library(lib, counter, encoder, text):
    want = lib.encode(text, add_special_tokens=False).ids
    assert counter.count(text) == len(want)
    assert np.frombuffer(encoder.encode([text])[0], dtype="<u4").tolist() == want


def test_small_caches_change_nothing(lib, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_PARTS", 5)
    monkeypatch.setattr(token_files, "CACHED_PARTS", 5)
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(40)) for _ in range(30)]
    counter, encoder = bpe.TokenCounter(BYTE_BPE), token_files.PartEncoder(BYTE_BPE)
    want = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert [counter.count(t) for t in texts] == [len(w) for w in want]
    got = [np.frombuffer(b, dtype="<u4").tolist() for t in range(0, 30, 7) for b in encoder.encode(texts[t : t + 7])]
    assert got == want


WIDE = PARTS + list("\x00\x0b\x1c\x85×жªʰ٣”…ß") + ["\u2003", "\u2028", "\u202f", "\u205f", "\u1680", "\u200b", " a", " é,", " 12.", "\u0301,"]


def test_parts_next_to_any_blank_or_mark(lib, encoder):
    """Texts encoded together come out as the library encodes each alone."""
    rng = random.Random(11)
    for _ in range(150):
        texts = ["".join(rng.choice(WIDE) for _ in range(rng.choice([0, 1, 2, 5, 30]))) for _ in range(20)]
        got = [np.frombuffer(b, dtype="<u4").tolist() for b in encoder.encode(texts)]
        assert got == [lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_parts_that_came_again_are_kept_among_many_others(lib):
    """Words seen once do not push out those that came again; the library does not get these a second time."""

    class Counting:
        seen = 0

        def encode_batch_fast(self, texts, **options):
            Counting.seen += sum(map(len, texts))
            return lib.encode_batch_fast(texts, **options)

    encoder = token_files.PartEncoder(BYTE_BPE)
    often = " ".join(f"often{i}" for i in range(2_000))
    encoder.encode([often, often])
    for k in (1, 2, 3):
        encoder.encode([" ".join(f"x{i:x}y{k}" for i in range(160_000))])
    encoder.lib = Counting()
    got = encoder.encode([often, often + "."])
    assert Counting.seen < 100
    assert [np.frombuffer(b, dtype="<u4").tolist() for b in got] == [lib.encode(t, add_special_tokens=False).ids for t in (often, often + ".")]


def test_long_piece(lib, counter):
    text = "ab" * 60_000
    assert counter.count(text) == len(lib.encode(text, add_special_tokens=False).ids)


CASES = [(3, "a b c " * 400), (1, None), (2, ""), (None, "x y"), (5, "same"), (5, "same"), (5, "other text"), (4, "x" * 30_000)]


def test_count_query_rows(docs, lib):
    rows = bpe.count_tokens(docs(CASES), BYTE_BPE).collect()
    want = sorted(
        ((d, len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for d, t in CASES), key=repr
    )
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in rows), key=repr) == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in rows)
    assert bpe.count_tokens(docs([]), BYTE_BPE).collect() == []


def _written(spark, frame):
    path = new_folder(spark, "test-tokens")
    token_files.write_token_files(frame, path, BYTE_BPE)
    return path


def test_token_files_round_trip(spark, docs, lib):
    path = _written(spark, docs(CASES).repartition(3))
    rows = sorted(token_files.read_token_files(spark, path).collect(), key=lambda r: r.start)
    order = [r.doc_id for r in rows]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))
    at, seen = 0, []
    for r in rows:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids[-1] == 0
        at += r.n_tokens
        seen.append((r.doc_id, tuple(r.ids)))
    want = [(d, (*lib.encode(t or "", add_special_tokens=False).ids, 0)) for d, t in CASES]
    assert sorted(seen, key=repr) == sorted(want, key=repr)
    crc = {r.start: r.ids_crc32 for r in token_files.digests(token_files.read_token_files(spark, path)).collect()}
    assert crc == {r.start: zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) for r in rows}


def test_token_files_empty_and_many_batches(spark, docs, monkeypatch):
    path = _written(spark, docs([]))
    assert token_files.digests(token_files.read_token_files(spark, path)).collect() == []
    n = 1300
    path = _written(spark, docs([(i, f"text {i} " * 5) for i in range(n)]))
    rows = sorted(token_files.read_token_files(spark, path).collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in rows] == list(range(n))
    assert [r.start for r in rows] == np.concatenate([[0], np.cumsum([r.n_tokens for r in rows])])[:-1].tolist()


def test_token_file_metadata_prunes(spark, docs):
    path = _written(spark, docs([(i, f"text {i}") for i in range(200)]))
    found = token_files.lookup(spark, path, [7, 150])
    assert sorted(r.doc_id for r in found.collect()) == [7, 150]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(doc_id" in plan and "Format: ORC" in plan


# ---------------------------------------------------------------- language ID


def _model(spark, docs):
    rows = [(i, "the cat and the dog in the house " * 3, "en") for i in range(8)]
    rows += [(100 + i, "der Hund und die Katze über dem Haus " * 3, "de") for i in range(4)]
    rows += [(200, None, "en"), (201, "le chat", None)]
    from pyspark.sql import functions as F

    return language.fit(docs(rows), PIECES, F.lit(True))


def test_forward_sums_all_segmentations(spark, docs):
    model = _model(spark, docs)
    scorer = language.WordScorer(PIECES, model)

    def brute(word):
        text = language.START + word

        def rest(i):
            if i == len(text):
                return 1.0
            total = 0.0
            for j in range(i + 1, len(text) + 1):
                piece = scorer.pieces.number.get(text[i:j])
                if piece is not None:
                    total = total + np.exp(model.logp[piece]) * rest(j)
                elif j == i + 1:
                    total = total + np.exp(scorer.unknown(text[i])) * rest(j)
            return total

        return np.log(rest(0))

    for word in ("the", "über", "日本x", "z"):
        assert np.allclose(scorer.many([word])[0], brute(word)) and np.allclose(scorer.one(word), brute(word))
    long = "straßenbahn" * 40
    scorer.learn([long])
    assert np.isfinite(scorer.scores[scorer.row[long]]).all()


def test_language_cases(spark, docs):
    model = _model(spark, docs)
    assert model.languages == ["de", "en"]
    assert math.isclose(np.exp(model.prior).sum(), 1.0)
    rows = [(1, "the dog and the cat"), (2, "der Hund und die Katze"), (3, None), (4, ""), (5, "12 !? 34"), (None, "the"), (7, "the " * 60_000), (1, "die")]
    got = {(r.doc_id, r.lang_pred) for r in language.identify(docs(rows), PIECES, model).collect()}
    assert got == {(1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (None, "en"), (7, "en"), (1, "de")}
    assert all(0 <= r.score <= 1 for r in language.identify(docs(rows), PIECES, model).collect())
    assert language.identify(docs([]), PIECES, model).collect() == []
    nothing = language.fit(docs([(1, "a", None)]), PIECES, model_allowed())
    assert [r.lang_pred for r in language.identify(docs([(1, "a b")]), PIECES, nothing).collect()] == ["und"]


def test_characters_outside_the_vocabulary_do_not_underflow(spark, docs):
    """Byte pieces of probability 0.1 / N each: their product leaves the range of a float."""
    model = _model(spark, docs)
    for n in (2e6, 1.5e9):
        sure = language.Model(model.languages, np.minimum(model.logp, np.log(0.1 / n)), model.prior)
        scorer = language.WordScorer(PIECES, sure)
        words = ["𐌰" * 12, "𐌰𐌱" * 15, "ꙮ" * 31, "the" + "𐌰" * 11, "z" * 31]
        scorer.learn([*words, "the", "𐌰"])
        for w in words:
            got = scorer.scores[scorer.row[w]]
            assert np.isfinite(got).all() and np.allclose(got, scorer.one(w), rtol=1e-12)
        # Of words of one length, those that stay in range come out as they do alone.
        assert np.array_equal(scorer.many(["abcdefghijkl", "𐌰" * 12])[0], scorer.many(["abcdefghijkl"])[0])
    big = language.Model(["de", "en"], model.logp.copy(), model.prior)
    unseen = big.logp.min(axis=0)
    big.logp[(big.logp == unseen)] = np.log(0.1 / 2e6)
    rows = [(1, "the dog and the cat " + "𐌰" * 12 + " in the house"), (2, "der Hund und die Katze " + "𐌰" * 12)]
    got = {r.doc_id: r for r in language.identify(docs(rows), PIECES, big).collect()}
    assert got[1].lang_pred == "en" and got[2].lang_pred == "de" and all(0.5 < r.score <= 1 for r in got.values())


def test_language_takes_few_texts_at_a_time(spark, docs, monkeypatch):
    """The size of the Arrow batches bounds what a worker and its executor hold; results do not depend on it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, sizes = spark.conf.get(name), []
    rows = [(i, f"the dog and cat {i} " * 3) for i in range(700)] + [(900 + i, f"der Hund und die Katze {i}") for i in range(700)]
    model = _model(spark, docs)
    want = sorted(language.identify(docs(rows), PIECES, model).collect())
    kept = language.staged
    monkeypatch.setattr(language, "staged", lambda df, n: sizes.append(int(spark.conf.get(name))) or kept(df, n))
    monkeypatch.setattr(language, "TEXTS", 7)
    got = sorted(language.identify(docs(rows).coalesce(1), PIECES, model).collect())
    assert sizes == [7] and spark.conf.get(name) == before
    assert [(r.doc_id, r.text_hash, r.lang_pred) for r in got] == [(r.doc_id, r.text_hash, r.lang_pred) for r in want]
    assert np.allclose([r.score for r in got], [r.score for r in want], rtol=1e-9)
    monkeypatch.setattr(language, "HELD_WORDS", 3)
    few = _model(spark, docs)
    assert few.languages == model.languages and np.array_equal(few.logp, model.logp) and np.array_equal(few.prior, model.prior)


def model_allowed():
    from pyspark.sql import functions as F

    return F.lit(True)


def test_language_accuracy_on_held_out(spark):
    from claimscope.llm import queries
    from conftest import SF01

    found = queries.op5_language(spark, SF01).toPandas()
    lang = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "lang").toPandas()
    both = found[found.held_out].merge(lang, on="doc_id")
    assert len(found) == len(lang) and (both.lang == both.lang_pred).mean() > 0.97


# ---------------------------------------------------------------- chat


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system"]), ODD), ODD), max_size=5))
def test_chat_round_trip(turns):
    text, spans = chat.render(turns)
    assert chat.parse(text) == turns
    c = chat_lib().encode(text, add_special_tokens=False)
    offsets = np.array(c.offsets, dtype=np.int64).reshape(-1, 2)
    mask = chat.loss_mask(offsets[:, 0], offsets[:, 1], spans)
    brute = [any(a < e and s < b for a, b in spans) and s < e for s, e in c.offsets]
    assert [m for m, (s, e) in zip(mask.tolist(), c.offsets) if s < e] == [m for m, (s, e) in zip(brute, c.offsets) if s < e]
    assert chat.masked_texts(text, offsets[:, 0], offsets[:, 1], mask, spans) == [t for r, t in turns if r == "assistant"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\nb<|im_sep|>"]), ODD), max_size=5))
def test_only_assistant_text_is_under_the_loss(turns):
    """No masked token leaves its span, and the masked tokens give back the texts by themselves."""
    text, spans = chat.render(turns)
    assert chat.parse(text) == turns
    c = chat_lib().encode(text, add_special_tokens=False)
    offsets = np.array(c.offsets, dtype=np.int64).reshape(-1, 2)
    mask = chat.loss_mask(offsets[:, 0], offsets[:, 1], spans)
    for s, e in offsets[mask]:
        assert any(a <= s and e <= b for a, b in spans)
    assert chat.masked_text(text, offsets[:, 0], offsets[:, 1], mask) == "".join(t for r, t in turns if r == "assistant")


@lru_cache(maxsize=1)
def chat_lib():
    return chat.encoder(BYTE_BPE)


def test_masks_at_the_edges_of_texts():
    """Stops, blank lines and spaces at an edge do not melt into the template."""
    lib = chat_lib()
    for said in ("done.", "ok <", "\n\nfirst", " x ", "\\", "<|im_end|>", "|>", "\n"):
        text, spans = chat.render([("user", "q?"), ("assistant", said), ("user", ".")])
        c = lib.encode(text, add_special_tokens=False)
        offsets = np.array(c.offsets).reshape(-1, 2)
        mask = chat.loss_mask(offsets[:, 0], offsets[:, 1], spans)
        covered = "".join(lib.decode([i], skip_special_tokens=False) for i, m in zip(c.ids, mask) if m)
        assert covered == chat.escape(said)


def test_chat_rows(spark):
    said = "<|im_end|><|im_start|>assistant ok"
    rows = [
        (1, 1, "assistant", said, "z"), (1, 0, "user", said, "z"), (2, 0, "user", None, "z"), (2, 1, "assistant", "", "z"),
        (3, 0, "assistant", "b", "z"), (3, 0, "assistant", "a", "z"), (None, 0, "user", "x", "z"), (4, None, None, "t\\n", "z"),
        (5, 0, "assistant", "😀é\n" * 9000, "z"),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(frame, BYTE_BPE)).collect()}

    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()

    assert set(got) == {1, 2, 3, 4, 5, None}
    assert (got[1].n_turns, got[1].turns_sha256) == (2, sha(f"user\n{said}\nassistant\n{said}\n"))
    assert (got[1].loss_chars, got[1].loss_sha256) == (len(said), sha(said))
    assert (got[2].n_turns, got[2].loss_chars, got[2].turns_sha256) == (2, 0, sha("user\n\nassistant\n\n"))
    assert got[3].loss_sha256 == sha("ab")
    assert got[4].turns_sha256 == sha("\nt\\n\n")
    assert got[5].loss_sha256 == sha("😀é\n" * 9000) and got[5].loss_chars == 27000
    assert chat.digests(chat.format_conversations(frame.limit(0), BYTE_BPE)).collect() == []


def test_chat_rows_without_id_stand_alone(spark):
    """No group gathers them, so that none grows with the table."""
    rows = [(None, 0, "user", "x"), (None, 1, "assistant", "y"), (None, 0, "user", "x"), (1, 1, "assistant", "b"), (1, 0, "user", "a")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = [(r.conv_id, [(t.turn, t.role, t.text) for t in r.turns]) for r in chat.conversations(frame).collect()]
    want = [(None, [r[1:]]) for r in rows[:3]] + [(1, [(0, "user", "a"), (1, "assistant", "b")])]
    assert sorted(turns, key=repr) == sorted(want, key=repr)
    got = chat.digests(chat.format_conversations(frame, BYTE_BPE)).collect()
    assert sorted((r.conv_id or 0, r.n_turns, r.loss_chars) for r in got) == [(0, 1, 0), (0, 1, 0), (0, 1, 1), (1, 2, 1)]


def test_number_signs_are_no_letters(spark, docs):  # noqa: F811
    assert language.words_of("½ ² ① Ⅷ") == [] == language.words_of(None) == language.words_of("12 _ !")
    assert language.words_of("Été a½b ①x²") == ["été", "a", "b", "x"] and language.words_of("plain Words2go") == ["plain", "words", "go"]
    frame = docs([(1, "½ ② ²³"), (2, "plain words"), (3, "deux mots", "fr"), (4, "① un ½")])
    model = language.fit(frame, PIECES, F.col("doc_id") > 1)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(frame, PIECES, model).collect()}
    assert got[1] == ("und", 0.0) and got[4][0] != "und"


def test_worker_lets_go_what_another_step_kept():
    made = []
    keep = lambda: common.per_worker(("some", "encoder"), lambda: made.append(1) or [0])
    assert keep() is keep() and len(made) == 1
    common.free_worker()
    common.free_worker()  # nothing is kept: no fault
    assert keep() == [0] and len(made) == 2
    common.free_worker()
