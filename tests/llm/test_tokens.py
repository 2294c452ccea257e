import random
import sys
import time
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodeseek.llm import packing, token_counts
from lodeseek.llm.words import split_words

from ..conftest import DATA
from .fixtures import clashing, documents, empty, rows

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PIECES)
TOKENIZER, ENCODER = Tokenizer.from_file(WORDS), packing.WordEncoder(WORDS)
AWKWARD = ["", " ", "  ", "   a", "a  ", "\n", "<s>x</s><unk>▁y\x00z　é é ﬁ", "日本語テキスト", "🙂🙂 👩‍👩‍👧", "a" * 4000, " " * 3000, "x" + " " * 700 + "y", "ab" * 2500]


def test_transducer_equals_the_library():
    rnd = random.Random(1)
    texts = AWKWARD + ["".join(rnd.choice("abcdehinorst  \n\té日🙂▁<>.,ÄßА01") for _ in range(rnd.randint(0, 1500))) for _ in range(100)]
    want = [len(x) for x in LIBRARY.encode(texts, num_threads=1)]
    assert token_counts.transducer(PIECES).count(texts).tolist() == want
    assert [int(token_counts.transducer(PIECES).count([t])[0]) for t in texts[:20]] == want[:20]  # chunk borders elsewhere


def unspaced(n, seed=2):
    rnd = random.Random(seed)
    return "".join(rnd.choice("abcdehinorstABé日1") for _ in range(n))


def test_text_without_spaces_equals_the_library_and_takes_little_longer():
    """Chunks that are all head: their maps are composed."""
    machine, plain = token_counts.transducer(PIECES), unspaced(200_000)
    spaced = "".join(" " if i % 7 == 6 else c for i, c in enumerate(plain))
    want = [len(LIBRARY.encode(t)) for t in (plain, spaced)]

    def seconds(text):
        best = 1e9
        for _ in range(3):
            began = time.perf_counter()
            machine.count([text])
            best = min(best, time.perf_counter() - began)
        return best

    assert machine.count([plain, spaced]).tolist() == want
    assert machine.count([spaced, "x", plain[:50_001], "", plain[50_000:]]).tolist() == [len(LIBRARY.encode(t)) for t in (spaced, "x", plain[:50_001], "", plain[50_000:])]
    assert seconds(plain) < 10 * seconds(spaced)


def test_wrong_predictions_are_mended(monkeypatch):
    """A state predicted from one character, or from none, is wrong at times; chunks are short."""
    monkeypatch.setattr(token_counts, "CHUNK", 8)
    texts = [unspaced(3000, s) for s in range(4)] + ["a" * 500, "ab" * 300, "the" * 200 + " " + "the" * 200]
    for warm in (0, 1, 8):
        monkeypatch.setattr(token_counts, "WARM", warm)
        assert token_counts.transducer(PIECES).count(texts).tolist() == [len(LIBRARY.encode(t)) for t in texts]


def test_long_texts_are_run_in_parts(monkeypatch):
    monkeypatch.setattr(token_counts, "BATCH", token_counts.CHUNK * 2)
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("abcdehinorst   \né日🙂▁") for _ in range(n)) for n in (1022, 1023, 1024, 1025, 2047, 2048, 5000)]
    texts += [unspaced(4000), " " * 3000, "x" * 1023 + "  y" + " " * 1022 + "z", "short"]
    assert token_counts.transducer(PIECES).count(texts).tolist() == [len(LIBRARY.encode(t)) for t in texts]


def test_a_long_text_cannot_outgrow_the_tables(monkeypatch):
    """The tables begin anew between the parts of one text, from the state that it is in."""
    machine = token_counts.CountingTransducer(PIECES)
    monkeypatch.setattr(token_counts, "BATCH", token_counts.CHUNK)
    monkeypatch.setattr(token_counts, "TABLE_LIMIT", 40_000)
    resets, whole = [], machine.reset
    machine.reset = lambda: resets.append(len(machine.states) * machine.width) or whole()
    texts = [unspaced(6000), " ".join(unspaced(40, s) for s in range(200)), "short"]
    assert machine.count(texts).tolist() == [len(LIBRARY.encode(t)) for t in texts]
    assert len(resets) > 10


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=80), max_size=6))
def test_transducer_on_any_text(texts):
    assert token_counts.transducer(PIECES).count(texts).tolist() == [len(LIBRARY.encode(t)) for t in texts]


def test_counts_of_tables(spark):
    want = sorted(((r[0], len((r[1] or "").encode()), len(LIBRARY.encode(r[1] or ""))) for r in rows()), key=repr)
    for docs in (documents(spark), clashing(spark)):
        got = token_counts.count_tokens(docs, PIECES).collect()
        assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=repr) == want
        assert all(r.over_limit == (r.n_tokens > 4096) for r in got)
    assert token_counts.count_tokens(empty(spark), PIECES).count() == 0


def test_query_counts_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in token_counts.op5_token_counts(spark, DATA).collect():
        assert r.n_tokens == len(LIBRARY.encode(texts[r.doc_id]))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abAZ'strlm.,!é ß\n\t\xa0日1２<|>endoftxΣ́İ", max_size=60), max_size=5))
def test_word_encoder_equals_the_library(texts):
    ids, n = ENCODER.encode(pa.array(texts, pa.string()), 1)
    cut = np.cumsum(n)
    for t, b, k in zip(texts, cut, n):
        assert ids[b - k : b].tolist() == [*TOKENIZER.encode(t, add_special_tokens=False).ids, 1]


def test_split_words():
    number, words, sizes = split_words(pa.array([" a b\x0ba ", "", "\n", "c"]))
    assert [words[i] for i in number] == [b"a", b"b", b"a", b"c"] and sizes.tolist() == [3, 0, 0, 1]


def check_pieces(pieces, table, size=2048):
    """Pieces tile the sequences without a gap and hold each document's ids once."""
    at = 0
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert (r.sequence_id, r.offset) == divmod(at, size) and 0 < r.length <= size - r.offset
        at += r.length
    want = defaultdict(list)
    for i, t in table:
        want[i].append(np.array([*TOKENIZER.encode(t or "", add_special_tokens=False).ids, 1], "<u4"))
    assert at == sum(len(x) for group in want.values() for x in group)
    for r in pieces:
        assert any(len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length]) == r.ids_crc32 for x in want[r.doc_id])
    covered = defaultdict(int)
    for r in pieces:
        covered[r.doc_id] += r.length
    assert covered == {i: sum(map(len, group)) for i, group in want.items()}


def test_packing_awkward_rows(spark):
    for docs in (documents(spark), clashing(spark), documents(spark).repartition(5)):
        check_pieces(packing.pack(docs, WORDS, size=64).collect(), [(r[0], r[1]) for r in rows()], 64)
    assert packing.pack(empty(spark), WORDS).count() == 0


def test_packing_with_a_tokenizer_that_spans_words(spark):
    """No lower-casing, white space in its tokens: whole texts are encoded."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole, table = Tokenizer.from_file(path), [(i, t) for i, t in enumerate(["Some Words, here. ", "", None, " two  spaces\n", "x" * 3000])]
    got = defaultdict(list)
    for r in packing.pack(spark.createDataFrame(table, "doc_id long, text string"), path, 64).collect():
        got[r.doc_id].append((r.start, r.length, r.ids_crc32))
    for i, t in table:
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        assert sum(n for _, n, _ in got[i]) == len(ids) and all(zlib.crc32(ids[a : a + n]) == crc for a, n, crc in got[i])


def test_packing_query(spark):
    table = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    check_pieces(packing.op6_packing(spark, DATA).collect(), table)


def test_unsupported_models_are_refused(tmp_path):
    with pytest.raises(Exception):
        token_counts.CountingTransducer(str(tmp_path / "none.model"))


def test_known_words_take_no_steps_of_python_each():
    """But for one length: forms, last stops and special strings are found for whole columns."""
    encoder, calls = packing.WordEncoder(WORDS), []
    texts = pa.array([" ".join(f"Word{i}x, word{i}x w{i}." for i in range(2000)), "a <|endoftext|>b. <|EndOfText|>. end."])
    want, n = encoder.encode(texts, 1)
    for t, b, k in zip(texts.to_pylist(), np.cumsum(n), n):
        assert want[b - k : b].tolist() == [*TOKENIZER.encode(t, add_special_tokens=False).ids, 1]
    sys.setprofile(lambda frame, event, arg: calls.append(event))
    try:
        again, _ = encoder.encode(texts, 1)
    finally:
        sys.setprofile(None)
    assert (again == want).all() and len(calls) < 2 * 2 * 6000
