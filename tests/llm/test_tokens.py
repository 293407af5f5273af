"""Token ids in ORC and SentencePiece: exact round trips."""

from __future__ import annotations

import random
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tablewright.llm import sentencepieces, token_orc
from tablewright.session import new_path
from tests.llm.fixtures import documents, empty

LIBRARY = Tokenizer.from_file(token_orc.vocabulary())
CACHE = token_orc.WordCache(LIBRARY, 40)
ODD = "aAbB.,'sS \n\t\x00\x0b\x85　éÉßİΣ1①<|endoftext|>😀中́"


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.text(alphabet=ODD, max_size=40), st.text(max_size=20)), max_size=4))
def test_word_cache_equals_the_library(texts):
    want = [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(b, np.uint16).tolist() for b in CACHE.encode(texts)] == want


def test_orc_round_trip(spark):
    docs = documents(spark)
    got = sorted(token_orc.round_trip(docs).collect(), key=lambda r: r.start)
    texts = {}
    for r in docs.collect():
        ids = LIBRARY.encode(r.text or "", add_special_tokens=False).ids + [2]
        texts.setdefault(r.doc_id, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    start = 0
    for r in got:
        assert r.start == start
        assert (r.n_tokens, r.ids_crc32) in texts[r.doc_id]
        start += r.n_tokens
    ids = [r.doc_id for r in got if r.doc_id is not None]
    assert ids == sorted(ids) and len(got) == docs.count()
    assert token_orc.round_trip(empty(spark)).count() == 0


def test_a_lookup_prunes_by_metadata(spark):
    path = new_path(spark, "tokens")
    token_orc.write_tokens(documents(spark), path, token_orc.vocabulary())
    found = token_orc.read_tokens(spark, path, F.col("doc_id") == 103)
    assert found.count() == 1
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,103)]" in found._jdf.queryExecution().toString()


PIECES = sentencepieces.Pieces(sentencepieces.model_path())
ENCODER = sentencepieces.Encoder(PIECES, 30)


def brute(text):
    """Every end position from every start: highest sum, later start on ties."""
    if not text:
        return []
    z = sentencepieces.MARK + text.replace(" ", sentencepieces.MARK)
    best, back = [0.0] + [None] * len(z), [None] * (len(z) + 1)
    for e in range(1, len(z) + 1):
        for s in range(max(0, e - PIECES.longest), e):
            piece = PIECES.scores.get(z[s:e])
            if piece and best[s] is not None and (best[e] is None or best[s] + piece[0] >= best[e]):
                best[e], back[e] = best[s] + piece[0], (s, piece[1])
        alone = best[e - 1] + PIECES.unknown if best[e - 1] is not None else None
        if not PIECES.scores.get(z[e - 1]) and alone is not None and (best[e] is None or alone > best[e]):
            best[e], back[e] = alone, (e - 1, -1)
    out, e = [], len(z)
    while e:
        s, i = back[e]
        out += [i] if i >= 0 else PIECES.fallback(z[s])[::-1]
        e = s
    return out[::-1]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abtheinr  \n.é😀▁", max_size=70), st.randoms())
def test_viterbi_in_any_pieces_of_text(text, rng):
    want = brute(text)
    assert ENCODER.encode(text).tolist() == want
    marked = sentencepieces.MARK + text.replace(" ", sentencepieces.MARK) if text else ""
    run, got, at = sentencepieces.Viterbi(PIECES), [], 0
    while at < len(marked):
        step = rng.randint(1, 9)
        got += run.feed(marked[at : at + step])
        at += step
    assert got + run.finish() == want
    assert PIECES.decode(want) == text.replace("▁", " ")


def test_the_window_stays_small():
    rng = random.Random(2)
    run = sentencepieces.Viterbi(PIECES)
    for _ in range(300):
        run.feed("".join(rng.choice("aehinrst") for _ in range(50)))
        assert len(run.text) < 400
        assert len(run.live) <= PIECES.longest + 1


@pytest.mark.parametrize("text", ["x" * 400_000, "xy" * 200_000, "é" * 200_000])
def test_one_run_without_blanks_takes_linear_time(text):
    began = time.process_time()
    assert PIECES.decode(ENCODER.encode(text).tolist()) == text
    assert time.process_time() - began < 20


def test_ids_are_committed_on_the_way():
    rng = random.Random(3)
    run, seen = sentencepieces.Viterbi(PIECES), 0
    for k in range(1, 200):
        seen += len(run.feed("".join(rng.choice("aehinrst") for _ in range(50))))
        assert seen > (k - 3) * 50 / PIECES.longest


def test_documents_decode_to_themselves(spark):
    docs = documents(spark)
    back = sentencepieces.decoded(sentencepieces.encoded(docs)).collect()
    assert sorted(r.text for r in back) == sorted(r.text or "" for r in docs.collect())
    assert all((r.n_ids == 0) == (r.text == "") for r in back)
    assert sentencepieces.decoded(sentencepieces.encoded(empty(spark))).count() == 0


@pytest.mark.parametrize("text", ["a" * 20_000, "the " * 5_000])
def test_long_texts(text):
    assert PIECES.decode(ENCODER.encode(text).tolist()) == text


@pytest.mark.parametrize("core", ["\u09b9\u09df", "\u0939\u095b", "KAD\u0130", "\u05e9\ufb2a", "stra\u00dfe"])
@pytest.mark.parametrize("sign", [".", ","])
def test_letters_that_normalise_to_marks(core, sign):
    text = f"word {core}{sign} {core} {core}{sign}"
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(CACHE.encode([text])[0], np.uint16).tolist() == want


def test_signs_around_letters_and_special_tokens():
    """Words are put together from letters and signs only where the library divides them there."""
    cache = token_orc.WordCache(LIBRARY)
    texts = ["(word) \"Word\", word%%% ###word&&& snake_case a'b 'tis it's, don't. x/y <b>é</b> Ünd!", "<|endoftext|> x<|endoftext|>y <|ENDOFTEXT|> <|x|>", "КАД Word, ÀÉ."]
    want = [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(b, np.uint16).tolist() for b in cache.encode(texts)] == want


def test_words_are_looked_up_once(monkeypatch):
    """Frequent words cost one look-up a batch, and signs beside a known word reach no tokenizer."""
    cache = token_orc.WordCache(LIBRARY)
    cache.encode(["some words , %%% ("])
    monkeypatch.setattr(cache, "_ids", lambda *a: pytest.fail("known words were encoded again"))
    flat, at = cache.encode_all(["some words, (some words%%% " * 50, "", "words"])
    assert len(at) == 4 and at[1] == at[2] and len(flat) == at[3]
    assert flat[at[0] : at[1]].tolist() == LIBRARY.encode("some words, (some words%%% " * 50, add_special_tokens=False).ids


def test_units_between_blanks():
    """A unit is searched once, whatever stands around it; runs of marks, line breaks and empty texts as one by one."""
    own = sentencepieces.Encoder(PIECES)
    texts = ["the the  the", None, " a", "", "a \nb\n\nb a\nb", "\nb", "b", "a▁ b▁▁c ▁d", "  ", "▁", "é😀 the " * 40]
    flat, at = own.encode_all(texts * 2)
    assert [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [brute(t) for t in texts] * 2
    assert PIECES.decode_all(flat, at) == [(t or "").replace("▁", " ") for t in texts] * 2
    assert PIECES.decode_all(flat[at[4] :], at[4:] - at[4]) == PIECES.decode_all(flat, at)[4:]


def test_kept_segments_stay_within_their_bound():
    """Two workers of an executor keep what they have met beside Spark's heap."""
    import sys

    import corpus_pipeline

    rng = random.Random(6)
    own = sentencepieces.Encoder(PIECES, corpus_pipeline.KEPT_BYTES)
    own.search = lambda text: [1, 2, 3, 4]
    for _ in range(40):
        own.encode_all([" ".join("".join(rng.choice("aehinrst") for _ in range(12)) for _ in range(20_000))])
    kept = sum(sys.getsizeof(d) + sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in d.items()) for d in (own.young, own.old))
    assert kept < 40 << 20
