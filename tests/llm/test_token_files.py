"""Operator 9: exact round trip through the files, random access, damage."""

import io
import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tokenizers
import zstandard

from spanwise.llm import token_files as files

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def definition():
    with open(PATH, encoding="utf-8") as f:
        return f.read()


def odd_texts():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab  \n.\t\r'sé世🙂\x1c\xa0　 1") for _ in range(rng.randrange(40))) for _ in range(1500)]
    return [*texts, None, "", " ", "  ", " a", "a ", "a   b", "x\n\ny\t ", "a \n \n b", "don't  'll", "<|endoftext|> a <|endoftext|>", "a" * 20_000, "a b " * 20_000]


def test_words_give_the_library_s_ids(reference, definition, monkeypatch):
    texts = odd_texts()
    encoder = files.Encoder(definition)
    want = [reference(t) for t in texts]
    assert [np.frombuffer(x, encoder.type).tolist() for x in encoder.encode(texts)] == want
    assert [np.frombuffer(x, encoder.type).tolist() for x in encoder.encode(texts)] == want  # from the cache
    monkeypatch.setattr(files, "CACHE_WORDS", 5)
    monkeypatch.setattr(files, "CHUNK_CHARS", 10)
    small = files.Encoder(definition)
    for t, ids in zip(texts[-300:], want[-300:], strict=True):
        assert np.frombuffer(small.encode([t])[0], small.type).tolist() == ids


def test_words_met_again_outlive_a_full_cache(definition, monkeypatch):
    monkeypatch.setattr(files, "CACHE_WORDS", 12)
    encoder = files.Encoder(definition)
    often = "x alpha beta gamma"
    want = encoder.encode([often])
    assert encoder.encode([often]) == want
    encoder.encode([f"x {' '.join(f'new{i}' for i in range(20))}"])  # more than the cache holds, and none of them
    given = []
    library = encoder.tokenizer.encode_batch_fast

    class Watched:
        def encode_batch_fast(self, texts, **options):
            given.extend(texts)
            return library(texts, **options)

    encoder.tokenizer = Watched()
    assert encoder.encode([often]) == want
    assert not any("alpha" in t for t in given)


def expected(rows, reference):
    out, start = [], 0
    for i, t in rows:
        ids = [*reference(t), 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("shards", [1, 5, 40])
def test_round_trip(spark, reference, tmp_path, shards):
    rows = list(enumerate(odd_texts()[-200:], start=-20))
    mixed = rows[:]
    random.Random(2).shuffle(mixed)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in mixed], "doc_id long, text string, start int, shard string")
    manifest = files.write_tokens(df, str(tmp_path), shards=shards)
    got = sorted(tuple(r) for r in files.read_tokens(manifest, str(tmp_path)).collect())
    assert got == expected(rows, reference)
    some = {r.doc_id: list(r.ids) for r in files.read_documents(manifest, str(tmp_path), [-20, 3, 10**9]).collect()}
    assert some == {i: [*reference(t), 2] for i, t in rows if i in (-20, 3)}
    assert not [f for f in os.listdir(tmp_path) if f.startswith("part-")]  # only finished files


def test_null_ids_repeats_and_empty_table(spark, reference, tmp_path):
    df = spark.createDataFrame([(5, "b"), (None, "a a"), (5, "b"), (5, None)], "doc_id long, text string")
    rows = [tuple(r) for r in files.read_tokens(files.write_tokens(df, str(tmp_path / "a")), str(tmp_path / "a")).collect()]
    rows.sort(key=lambda r: r[1])
    assert [r[0] for r in rows] == [None, 5, 5, 5]
    assert [r[1] for r in rows] == [0, *np.cumsum([r[2] for r in rows])[:-1].tolist()]
    empty = files.write_tokens(df.limit(0), str(tmp_path / "b"))
    assert files.read_tokens(empty, str(tmp_path / "b")).count() == 0


def test_file_format():
    docs = [(7, np.arange(n, dtype="<u2").tobytes()) for n in (0, 1, 5000)] + [(None, b"\x02\x00")]
    sink = io.BytesIO()
    assert files.write_file(sink, docs, 2) == (4, 5002)
    raw = sink.getvalue()
    # any reader of zstandard frames gets all ids in order
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True)
    assert whole.read(10002) == b"".join(x for _, x in docs)[:10002]
    file = files.TokenFile(io.BytesIO(raw), len(raw))
    assert file.doc_ids == [7, 7, 7, None]
    assert [file.ids(i).astype("<u2").tobytes() for i in range(4)] == [x for _, x in docs]
    broken = bytearray(raw)
    broken[int(file.at[2]) + 20] ^= 1
    damaged = files.TokenFile(io.BytesIO(bytes(broken)), len(broken))
    assert damaged.ids(1).tolist() == [0]  # the others are untouched
    with pytest.raises((ValueError, zstandard.ZstdError)):
        damaged.ids(2)
    with pytest.raises(ValueError):
        files.TokenFile(io.BytesIO(raw[:-3]), len(raw) - 3)
