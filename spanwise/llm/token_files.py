"""Operator 9, token-id files: independent zstandard frames with a trailing seek table.

One file per shard, shards in ascending id order.  A file is a sequence of zstandard frames, one per
document, each holding the document's ids as little-endian integers; a skippable frame with the
document ids (zstandard inside); and, last, a skippable frame in the layout of the public zstandard
seekable format: per frame compressed size, size and checksum (low half of XXH64 of the content),
then the number of frames, a flag byte and the magic number.  Any zstandard reader can read the file
through; a reader with the seek table fetches, checks and decompresses only the documents it wants.

Tokenising is the byte-level BPE of the ``tokenizers`` library.  Its splitting rule always cuts before
a space that is followed by a non-space, so texts are cut there, words are numbered by Arrow, and each
distinct word is given to the library once per process: words and ids that are known lie side by side
in Arrow and numpy arrays (bounded; the words met again stay).  A document's ids are the concatenation.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanwise.llm.common import Tables, pieces, tidy
from spanwise.llm.wordcode import Codes

END_ID = 2
SHARD_BYTES = 64 << 20  # about this much text in a shard
CACHE_WORDS = 1_500_000  # some 50 bytes each
LONG_WORD = 64  # bytes; longer words are not kept
CHUNK_CHARS = 1 << 19  # bytes of words given to the library at once
ENCODE_BYTES = 8 << 20  # texts whose words are numbered together
_SEEK_MAGIC, _INDEX_MAGIC, _SEEK_FOOTER = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1
_ODD = r" [\t-\r\x1c- \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"  # a space and what Python takes as one
_CUT = re.compile(r" (?=\S)")
_encoders: dict[str, Encoder] = {}


class Encoder:
    """Whole texts to ids with a ``tokenizers`` file (given as its JSON text)."""

    def __init__(self, definition: str):
        import tokenizers

        self.tokenizer = tokenizers.Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        vocabulary = self.tokenizer.get_vocab()
        self.type = np.dtype("<u2") if max(vocabulary.values()) < 1 << 16 else np.dtype("<u4")
        self.length = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, i in vocabulary.items():
            self.length[i] = len(token)  # byte-level: one character stands for one byte
        self.space = self._ids([" "])[0]
        self.forget()

    def forget(self) -> None:
        self.known = pa.array([], pa.string())  # words after a space
        self.codes = Codes([], self.type)  # their ids
        self.round = 0
        self.last = np.empty(0, np.int32)  # round that met a known word last
        self.again = np.empty(0, bool)  # met in several rounds

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.type).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _spaced(self, words: pa.Array) -> Codes:
        """Ids of ' ' + word for each word, many words in one call of the library."""
        flat, sizes = [], []
        lengths = pc.binary_length(words.cast(pa.binary())).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        total = np.cumsum(lengths)
        start = 0
        while start < len(words):
            base = total[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(total, base + CHUNK_CHARS, side="right")))
            part = words[start:end]
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part), " ")[0].as_py()
            ids = np.array(self.tokenizer.encode_batch_fast([" " + joined], add_special_tokens=False)[0].ids, dtype=self.type)
            ends, at = total[start:end] - base, np.cumsum(self.length[ids])
            cut = np.searchsorted(at, ends) + 1
            if cut[-1] == len(ids) and np.array_equal(at[cut - 1], ends):
                flat.append(ids)
                sizes.append(np.diff(cut, prepend=0))
            else:  # the tokenizer's cuts are not at spaces
                own = Codes(self._ids([" " + w for w in part.to_pylist()]), self.type)
                flat.append(own.flat)
                sizes.append(own.sizes)
            start = end
        return Codes.of(np.concatenate([self.codes.flat[:0], *flat]), np.concatenate([self.codes.sizes[:0], *sizes]))

    def _coded(self, words: pa.Array) -> tuple[Codes, np.ndarray]:
        """Codes, and the place of each of the distinct words among them; new words are kept."""
        self.round += 1
        at = pc.index_in(words, value_set=self.known)
        place = pc.fill_null(at, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        fresh = place < 0
        old, new = place[~fresh], words.filter(pa.array(fresh))
        self.last[old], self.again[old] = self.round, True
        made = self._spaced(new)
        codes = Codes.of(np.concatenate((self.codes.flat, made.flat)), np.concatenate((self.codes.sizes, made.sizes)))
        place[fresh] = len(self.known) + np.arange(len(new))
        short = pc.less_equal(pc.binary_length(new.cast(pa.binary())), LONG_WORD).to_numpy(zero_copy_only=False)
        keep = np.concatenate((np.ones(len(self.known), bool), short))
        last = np.concatenate((self.last, np.full(len(new), self.round, np.int32)))
        again = np.concatenate((self.again, np.zeros(len(new), bool)))
        if keep.sum() > CACHE_WORDS:  # half of them stay: words met in several rounds first, then those met last
            order = np.lexsort((last, again & keep, keep))[::-1][: min(CACHE_WORDS // 2, int(keep.sum()))]
            keep[:] = False
            keep[order] = True
            again[:] = False
        words = pa.concat_arrays([self.known, new])
        if keep.all():
            self.known, self.codes, self.last, self.again = words, codes, last, again
        else:
            rows = np.flatnonzero(keep)
            self.known, self.codes = words.take(pa.array(rows)), Codes.of(codes.gather(rows), codes.sizes[rows])
            self.last, self.again = last[rows], again[rows]
        return codes, place

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, their number per text), without end ids."""
        blank = pc.fill_null(texts.cast(pa.string()), "")
        odd = pc.match_substring_regex(blank, _ODD)
        at = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        lists = pc.split_pattern(blank, " ")
        words, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
        sizes, starts = np.diff(offsets), offsets[:-1] - offsets[0]
        if len(at):  # their words follow those of the others
            cuts = [_CUT.split(t) for t in blank.filter(odd).to_pylist()]
            sizes[at] = list(map(len, cuts))
            starts[at] = len(words) + np.cumsum(sizes[at]) - sizes[at]
            words = pa.concat_arrays([words, pa.array([w for c in cuts for w in c], pa.string())])
        first = words.take(pa.array(starts)).dictionary_encode()
        coded = words.dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        index = index[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
        rest = np.ones(len(index), dtype=bool)
        rest[ends - sizes] = False
        met = np.zeros(len(coded.dictionary), dtype=bool)
        met[index[rest]] = True
        empty = pc.equal(coded.dictionary, "").to_numpy(zero_copy_only=False)
        asked = np.flatnonzero(met & ~empty)
        codes, place = self._coded(coded.dictionary.take(pa.array(asked)))
        table = np.full(len(met), len(codes.sizes), dtype=np.int64)  # the empty word: a space
        table[asked] = place
        heads = Codes([self.space, *self._ids(first.dictionary.to_pylist())], self.type)
        index = table[index]
        index[ends - sizes] = len(codes.sizes) + 1 + first.indices.to_numpy(zero_copy_only=False)
        every = Codes.of(np.concatenate((codes.flat, heads.flat)), np.concatenate((codes.sizes, heads.sizes)))
        upto = np.concatenate(([0], np.cumsum(every.sizes[index])))
        return every.gather(index), upto[ends] - upto[ends - sizes]

    def encode(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        """Ids of each text, without an end id."""
        ids, sizes = self.encode_column(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        raw, ends = ids.tobytes(), np.cumsum(sizes) * self.type.itemsize
        return [raw[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False)]


def _encoder(definition: str) -> Encoder:
    if definition not in _encoders:
        _encoders.clear()
        _encoders[definition] = Encoder(definition)
    return _encoders[definition]


def write_file(sink, documents: Iterable[tuple[int | None, bytes]], width: int) -> tuple[int, int]:
    """Write (id, packed ids) pairs to a binary stream; number of documents and of ids."""
    compressor = zstandard.ZstdCompressor(level=3)
    entries, names, known, total = bytearray(), [], bytearray(), 0
    for name, raw in documents:
        frame = compressor.compress(raw)
        sink.write(frame)
        entries += struct.pack("<III", len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF)
        names.append(name or 0)
        known.append(name is not None)
        total += len(raw) // width
    index = compressor.compress(struct.pack("<II", width, len(names)) + np.array(names, dtype="<i8").tobytes() + bytes(known))
    sink.write(struct.pack("<II", _INDEX_MAGIC, len(index)) + index)
    sink.write(struct.pack("<II", _SEEK_MAGIC, len(entries) + 9) + entries + struct.pack("<IBI", len(names), 0x80, _SEEK_FOOTER))
    return len(names), total


class TokenFile:
    """Random access to one file: ``ids(i)`` decompresses document i only and checks its checksum."""

    def __init__(self, source, size: int):
        self.source = source
        source.seek(size - 9)
        frames, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != _SEEK_FOOTER or flags != 0x80:
            raise ValueError("not a token file")
        table = 12 * frames
        source.seek(size - 9 - table - 8)
        if struct.unpack("<II", source.read(8)) != (_SEEK_MAGIC, table + 9):
            raise ValueError("damaged seek table")
        entries = np.frombuffer(source.read(table), dtype="<u4").reshape(frames, 3).astype(np.int64)
        self.sizes, self.raw, self.sums = entries[:, 0], entries[:, 1], entries[:, 2]
        self.at = np.concatenate(([0], np.cumsum(self.sizes)))
        source.seek(int(self.at[-1]))
        magic, n = struct.unpack("<II", source.read(8))
        if magic != _INDEX_MAGIC:
            raise ValueError("damaged index")
        index = zstandard.ZstdDecompressor().decompress(source.read(n))
        self.width, count = struct.unpack("<II", index[:8])
        names, known = np.frombuffer(index[8 : 8 + 8 * count], dtype="<i8"), index[8 + 8 * count :]
        self.doc_ids = [int(x) if k else None for x, k in zip(names, known, strict=True)]
        self.tokens = self.raw // self.width

    def ids(self, i: int) -> np.ndarray:
        self.source.seek(int(self.at[i]))
        raw = zstandard.ZstdDecompressor().decompress(self.source.read(int(self.sizes[i])), max_output_size=int(self.raw[i])) if self.raw[i] else b""
        if len(raw) != self.raw[i] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[i]:
            raise ValueError(f"checksum of document {self.doc_ids[i]} does not match")
        return np.frombuffer(raw, dtype=f"<u{self.width}").astype("<u4")


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                 shards: int | None = None) -> DataFrame:
    """Write all rows as token files to ``folder`` (seen by all executors); returns the manifest:
    (shard, path, n_docs, n_tokens, start) with the ids before each shard.

    Rows are dealt to shards by ranges of the id, in ascending order (null ids first, equal ids by the
    text's hash).  A null text counts as empty.  A task writes under a name of its attempt and renames
    at the end, so a lost or repeated attempt leaves no half file behind a final name.
    """
    spark = docs.sparkSession
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("byte_bpe_50k.json")
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = spark.sparkContext.broadcast(f.read())
    base = tidy(docs, id_col, text_col)
    if shards is None:
        size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // SHARD_BYTES + 1)
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root)

    def write(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        encoder = _encoder(definition.value)
        end = np.array([END_ID], dtype=encoder.type).tobytes()
        context = TaskContext.get()
        name, part = f"{root}/shard-{context.partitionId():06d}.tok", f"{root}/part-{context.taskAttemptId()}"
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return

        def documents():
            for source in ([first], batches):
                for batch in pieces(source, size=ENCODE_BYTES):
                    yield from zip(batch.column("doc_id").to_pylist(), (x + end for x in encoder.encode(batch.column("text"))), strict=True)

        with fs.open_output_stream(part) as sink:
            n, tokens = write_file(sink, documents(), encoder.type.itemsize)
        fs.move(part, name)
        yield pa.RecordBatch.from_arrays([pa.array([context.partitionId()], pa.int32()), pa.array([name]), pa.array([n], pa.int64()), pa.array([tokens], pa.int64())], ["shard", "path", "n_docs", "n_tokens"])

    ranged = base.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    written = Tables(spark, "manifest").store(ranged.mapInArrow(write, "shard int, path string, n_docs long, n_tokens long"), "shards")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    return written.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files of ``write_tokens``."""

    def read(batches):
        fs, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with fs.open_input_file(path) as source:
                    file = TokenFile(source, source.size())
                    sums = [zlib.crc32(file.ids(i).tobytes()) for i in range(len(file.doc_ids))]
                begins = start + np.concatenate(([0], np.cumsum(file.tokens)[:-1])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(file.doc_ids, pa.int64()), pa.array(begins), pa.array(file.tokens), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    files = manifest.select("shard", "path", "start")
    count = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return files.repartition(count, "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_documents(manifest: DataFrame, folder: str, wanted: list[int]) -> DataFrame:
    """(doc_id, ids) of the wanted documents; only their frames are read and decompressed."""
    want = set(wanted)

    def read(batches):
        fs, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with fs.open_input_file(path) as source:
                    file = TokenFile(source, source.size())
                    at = [i for i, d in enumerate(file.doc_ids) if d in want]
                    yield pa.RecordBatch.from_arrays([pa.array([file.doc_ids[i] for i in at], pa.int64()), pa.array([file.ids(i).astype(np.int64) for i in at], pa.list_(pa.int64()))], ["doc_id", "ids"])

    return manifest.select("shard", "path").mapInArrow(read, "doc_id long, ids array<long>")
