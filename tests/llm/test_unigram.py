"""Operators 3 and 7: both Viterbi forms against the public unigram tokenizer, and the round trip."""

import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers

from spanwise.llm import sentencepiece_codec, token_counts
from spanwise.llm.sentencepiece_codec import Coder
from spanwise.llm.token_counts import Counter
from spanwise.llm.unigram import Vocabulary, mark, units

TEXTS = [None, "", " ", "  ", " a", "a ", "a  b", "x\n\ny\t", "🙂世é" * 3, "a" * 3000, "▁a", "ab " * 2000, "<0x41>", "\u0000", "hello world"]


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary.load()


@pytest.fixture(scope="module")
def reference():
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    model = tokenizers.models.Unigram([(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())], unk_id=0, byte_fallback=True)
    known = {}

    def encode(text):
        out = []
        for u in units(text or ""):
            if u not in known:
                known[u] = [t.id for t in model.tokenize(mark(u))]
            out += known[u]
        return out

    return encode


def random_texts(n):
    rng = random.Random(1)
    return ["".join(rng.choice("ab  \n.eéinthg世🙂") for _ in range(rng.randrange(60))) for _ in range(n)]


def test_units_give_back_the_marked_text():
    for t in [*TEXTS, *random_texts(300)]:
        if t:
            assert "".join(map(mark, units(t))) == "▁" + t.replace(" ", "▁")
    assert units("") == []


def test_both_forms_match_the_public_tokenizer(vocabulary, reference):
    coder, counter = Coder(vocabulary), Counter(vocabulary)
    texts = [t for t in TEXTS + random_texts(1500) if t != "<0x41>"]  # that library reads byte pieces in a text
    for text, ids in zip(texts, coder.encode(texts), strict=True):
        assert ids.tolist() == reference(text), text
        assert counter.text(text) == len(ids)
        assert coder.decode(ids) == (text or "").replace("▁", " ")


def test_shared_prefixes_do_not_change_a_word(vocabulary):
    coder = Coder(vocabulary)
    rng = random.Random(3)
    words = {"▁" + "".join(rng.choice("abthe") for _ in range(rng.randrange(9))) for _ in range(400)}
    ids, sizes = coder.words(sorted(words))
    for w, together in zip(sorted(words), np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
        assert coder.words([w])[0].tolist() == together.tolist()


def test_small_caches_change_nothing(vocabulary, monkeypatch):
    texts = random_texts(200)
    whole = [x.tolist() for x in Coder(vocabulary).encode(texts)]
    monkeypatch.setattr(sentencepiece_codec, "CACHE_BYTES", 10 * sentencepiece_codec.WORD_BYTES)
    monkeypatch.setattr(token_counts, "CACHE_WORDS", 10)
    coder, counter = Coder(vocabulary), Counter(vocabulary)
    assert [coder.encode([t])[0].tolist() for t in texts] == whole
    assert [counter.text(t) for t in texts] == [len(x) for x in whole]


def test_ties_take_the_longer_piece():
    v = Vocabulary({"▁": (-1.0, 0), "a": (-1.0, 1), "b": (-1.0, 2), "ab": (-2.0, 3), "▁a": (-2.0, 4)}, list(range(5, 261)), -12.0, 261, [b""] * 261)
    # ▁ a b, ▁ ab and ▁a b all score -3: each position keeps its first candidate, the longest piece ending there
    assert Coder(v).words(["▁ab"])[0].tolist() == [0, 3]
    assert Counter(v).word("▁ab") == 2


def test_dataframes(spark, vocabulary, reference):
    rows = [(i, t, "clash", 7) for i, t in enumerate(TEXTS)] + [(0, None, "clash", 7), (None, "hello world", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")
    got = sentencepiece_codec.decoded(sentencepiece_codec.encoded(df)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.decoded == (r.text or "").replace("▁", " ")
        if r.text != "<0x41>":
            assert list(r.ids) == reference(r.text)
    counts = token_counts.token_counts(df).collect()
    assert sorted(str((r.doc_id, r.n_tokens, r.n_chars)) for r in counts) == sorted(str((r.doc_id, len(r.ids), len(r.text or ""))) for r in got)
    assert sentencepiece_codec.encoded(df.limit(0)).count() == 0 and token_counts.token_counts(df.limit(0)).count() == 0


def test_whole_documents_round_trip(spark, reference):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    n = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs).collect()}
    for r in sentencepiece_codec.decoded(sentencepiece_codec.encoded(docs)).collect():
        assert r.decoded == r.text and n[r.doc_id] == len(r.ids)
        assert list(r.ids) == reference(r.text)
