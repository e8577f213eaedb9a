"""Operator 3: token ids in sorted-string-table shards.

File format of a shard, little-endian::

    blocks   each: zstd of entries (shared key bytes u8, own key bytes u8, value bytes u32, key tail, ids)
    index    per block: first key (9 bytes), offset u64, stored bytes u32, crc32 u32, documents u32, ids u64
    bloom    bits of a Bloom filter over the keys
    footer   index offset, blocks, bloom offset, bloom bytes, hashes, id width, documents, ids (u64 each), MAGIC

A key is a null flag and the identifier in order-preserving big-endian form, so nulls come first. Entries ascend by
key; a lookup asks the Bloom filter, then searches the sparse index, then reads one block.

Documents are dealt by range of identifier (then of text hash, so that a repeated identifier does not make one task
large), sorted, encoded and written by the tasks into the shared folder under names of their own; only shards whose task
succeeded enter the manifest. A shard is closed at ``shard_bytes``.

Encoding: the vocabulary's pattern never matches across a space or a line break between two other characters that are not white
space, so pieces of text that begin at one are encoded apart by the library and remembered (about twice ``_MEMO`` of them in a
process). A text with longer runs of white space, or other kinds of it, goes through the library whole.

Defined results: a null text is empty and still gets the end id; null ids sort first; repeated ids stay, in
order of their text; an empty table gives no shard and no rows; other columns are ignored whatever their names.
"""

from __future__ import annotations

import functools
import struct
import uuid
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_bytes, default_tokenizer_path, env_single_thread, materialize, new_path, ship
from .wordtable import arrow_schema

MAGIC = b"FLSST001"
_FOOTER = struct.Struct("<8Q8s")
_INDEX = struct.Struct("<9sQIIIQ")
_ENTRY = struct.Struct("<BBI")
BLOCK_BYTES, SHARD_BYTES, CHUNK_BYTES, BLOOM_BITS, BLOOM_HASHES = 256 << 10, 128 << 20, 6 << 20, 10, 7
_MEMO = 300_000
_MANIFEST = "part long, seq long, path string, n_docs long, n_tokens long, first_id long, last_id long"
_MARKS, _LINES = b".,;:!?", 16
_OTHER_SPACE = [b"  ", b" \n", b"\n ", b"\n\n", b"\t", b"\r", b"\x0b", b"\x0c", b"\x1c", b"\x1d", b"\x1e", b"\x1f", b"\0"]
_FAR_SPACE = [b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80"]


def key_of(doc_id: int | None) -> bytes:
    return b"\0" * 9 if doc_id is None else b"\1" + ((doc_id + (1 << 63)) & ((1 << 64) - 1)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return None if key[0] == 0 else int.from_bytes(key[1:], "big") - (1 << 63)


def _bits(key: bytes, n_bits: int) -> list[int]:
    h = xxhash.xxh128_intdigest(key)
    a, b = h & ((1 << 64) - 1), (h >> 64) | 1
    return [((a + i * b) & ((1 << 64) - 1)) % n_bits for i in range(BLOOM_HASHES)]


class ShardWriter:
    """Writes ascending (id, ids) into one shard."""

    def __init__(self, sink, width: int) -> None:
        self.sink, self.width, self.at = sink, width, 0
        self.index: list[bytes] = []
        self.keys: list[bytes] = []
        self.n_docs = self.n_tokens = 0
        self._new_block()

    def _new_block(self) -> None:
        self.entries: list[bytes] = []
        self.size, self.first, self.last, self.block_docs, self.block_tokens = 0, b"", b"", 0, 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        key, value = key_of(doc_id), ids.astype("<u2" if self.width == 2 else "<u4").tobytes()
        shared = 0
        if self.entries:
            while shared < 9 and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        self.entries += [_ENTRY.pack(shared, 9 - shared, len(value)), key[shared:], value]
        if not self.keys or self.keys[-1] != key:
            self.keys.append(key)
        self.last = key
        self.size += len(value) + 15
        self.block_docs += 1
        self.block_tokens += len(ids)
        if self.size >= BLOCK_BYTES:
            self.flush()

    def flush(self) -> None:
        if not self.entries:
            return
        data = zstandard.ZstdCompressor(level=1).compress(b"".join(self.entries))
        self.sink.write(data)
        self.index.append(_INDEX.pack(self.first, self.at, len(data), zlib.crc32(data), self.block_docs, self.block_tokens))
        self.at += len(data)
        self.n_docs += self.block_docs
        self.n_tokens += self.block_tokens
        self._new_block()

    def close(self) -> None:
        self.flush()
        n_bits = max(64, -(-len(self.keys) * BLOOM_BITS // 8) * 8)
        bloom = bytearray(n_bits // 8)
        for key in self.keys:
            for b in _bits(key, n_bits):
                bloom[b >> 3] |= 1 << (b & 7)
        index = b"".join(self.index)
        self.sink.write(index)
        self.sink.write(bytes(bloom))
        self.sink.write(_FOOTER.pack(self.at, len(self.index), self.at + len(index), len(bloom), BLOOM_HASHES, self.width, self.n_docs, self.n_tokens, MAGIC))
        self.sink.close()


class ShardReader:
    """Reads a shard by blocks, or one identifier."""

    def __init__(self, source) -> None:
        self.source = source
        size = source.size()
        source.seek(size - _FOOTER.size)
        at, n, bloom_at, bloom_n, self.hashes, self.width, self.n_docs, self.n_tokens, magic = _FOOTER.unpack(source.read(_FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard of this format")
        source.seek(at)
        raw = source.read(n * _INDEX.size)
        self.index = list(_INDEX.iter_unpack(raw))
        source.seek(bloom_at)
        self.bloom = source.read(bloom_n)

    def block(self, i: int) -> list[tuple[int | None, np.ndarray]]:
        _, at, size, crc, _, _ = self.index[i]
        self.source.seek(at)
        data = self.source.read(size)
        if zlib.crc32(data) != crc:
            raise ValueError("a block is damaged")
        data, pos, key, out = zstandard.ZstdDecompressor().decompress(data), 0, b"", []
        while pos < len(data):
            shared, own, n = _ENTRY.unpack_from(data, pos)
            pos += _ENTRY.size
            key = key[:shared] + data[pos : pos + own]
            pos += own
            out.append((id_of(key), np.frombuffer(data, f"<u{self.width}", n // self.width, pos)))
            pos += n
        return out

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for i in range(len(self.index)):
            yield from self.block(i)

    def may_hold(self, doc_id: int | None) -> bool:
        return all(self.bloom[b >> 3] >> (b & 7) & 1 for b in _bits(key_of(doc_id), len(self.bloom) * 8))

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """All values of an identifier: none, or several where it is repeated."""
        if not self.index or not self.may_hold(doc_id):
            return []
        key = key_of(doc_id)
        firsts = [x[0] for x in self.index]
        i = max(0, bisect_right(firsts, key) - 1)
        while i > 0 and firsts[i] == key:
            i -= 1
        out: list[np.ndarray] = []
        while i < len(firsts) and firsts[i] <= key:
            out += [v for d, v in self.block(i) if d == doc_id]
            i += 1
        return out


def open_path(path: str, write: bool = False):
    """A file of any file system that Arrow reaches by URI."""
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path)
    if write:
        system.create_dir(at.rsplit("/", 1)[0], recursive=True)
        return system.open_output_stream(at)
    return system.open_input_file(at)


def byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself where it prints, else the next one from U+0100."""
    prints = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(prints))}


class ByteEncoder:
    def __init__(self, path: str) -> None:
        env_single_thread()
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.t.no_truncation()
        self.t.no_padding()
        self.memo: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.chars = byte_chars()
        self.line_break = self._whole(b"\n")[0]
        self.width = 2 if max(self.t.get_vocab(with_added_tokens=True).values()) < 1 << 16 else 4

    def _learn(self, units: set[bytes]) -> None:
        """Encode new units. A mark at the end of a letter or digit is always a piece of its own, and so is a run of letters with the space before it: the
        library's model takes such a run as it is; other units go through the whole library, as lines of short texts."""
        memo, old, tokenize, chars, space = self.memo, self.old, self.t.model.tokenize, self.chars, self.chars[32]
        ended = [u for u in units if u[-1] in _MARKS and u[-2:-1].isalnum()]
        other = []
        for u in units.difference(ended) | ({u[:-1] for u in ended} | {u[-1:] for u in ended}).difference(memo):
            known = old.get(u)
            if known is not None:
                memo[u] = known
                continue
            word = u[1:] if u[0] == 32 else u
            if word.isalpha():  # ASCII letters
                memo[u] = array("I", [x.id for x in tokenize((space if u[0] == 32 else "") + word.decode())]).tobytes()
                continue
            text = word.decode("utf-8", "replace")
            if text.isalpha() and max(text) < "\u0250":
                memo[u] = array("I", [x.id for x in tokenize(u.decode("latin-1").translate(chars))]).tobytes()
            else:
                other.append(u)
        for i in range(0, len(other), _LINES):
            some = other[i : i + _LINES]
            ids = np.array(self._whole(b"\n".join(some)), "<u4")
            cuts = np.flatnonzero(ids == self.line_break)
            if len(cuts) != len(some) - 1:  # a line break among the units themselves
                memo.update((u, np.array(self._whole(u), "<u4").tobytes()) for u in some)
                continue
            raw, cuts = ids.tobytes(), (4 * cuts).tolist()
            memo.update(zip(some, [raw[a:b] for a, b in zip([0, *[c + 4 for c in cuts]], [*cuts, len(raw)])]))
        for u in ended:
            memo[u] = memo[u[:-1]] + memo[u[-1:]]

    def _whole(self, text: bytes) -> list[int]:
        return self.t.encode_batch_fast([text.decode("utf-8", "replace")], add_special_tokens=False)[0].ids

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of texts. Units are cut and numbered by Arrow, so that only the distinct ones of a batch become Python objects."""
        if len(self.memo) > _MEMO:
            self.old, self.memo = self.memo, {}  # units that are still in use come back from the older half
        self.memo[b""] = b""
        odd = [any(x in t for x in _OTHER_SPACE) or (not t.isascii() and any(x in t for x in _FAR_SPACE)) or t[:1] == b" " or t[-1:] == b" " for t in texts]
        whole = {i: np.array(self._whole(texts[i]), "<u4") for i, o in enumerate(odd) if o}
        plain = pa.array([t for t, o in zip(texts, odd) if not o], pa.large_binary())
        marked = pc.replace_substring(pc.replace_substring(plain, b"\n", b"\0\n\0"), b" ", b"\0 ")
        lists = pc.split_pattern(marked, b"\0")
        coded = lists.flatten().dictionary_encode()
        units = coded.dictionary.to_pylist()
        get = self.memo.get
        self._learn({u for u in units if get(u) is None})
        values = [self.memo[u] for u in units]
        lens = np.fromiter(map(len, values), np.int64, len(values)) // 4
        flat = np.frombuffer(b"".join(values), "<u4")
        at = coded.indices.to_numpy()
        n = lens[at]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat((np.cumsum(lens) - lens)[at] - ends[:-1], n) + np.arange(ends[-1])]
        cuts = ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()] if len(plain) else ends[:1]
        parts = iter(zip(cuts.tolist(), cuts[1:].tolist()))
        return [whole[i] if o else ids[slice(*next(parts))] for i, o in enumerate(odd)]


@functools.lru_cache(1)
def _encoder(path: str) -> ByteEncoder:
    return ByteEncoder(path)


def write_shards(docs: DataFrame, out_path: str, tokenizer_path: str | None = None, end_id: int | None = 2, shard_bytes: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, sort and write all documents under ``out_path``; returns the manifest, a row per shard in order."""
    ship(docs.sparkSession)
    path = tokenizer_path or default_tokenizer_path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq, writer, rows, first, last = _encoder(path), TaskContext.get().partitionId(), 0, None, [], None, None
        tail = np.array([] if end_id is None else [end_id], "<u4")

        def close() -> None:
            nonlocal writer, first, last
            writer.close()
            rows.append((part, seq, name, writer.n_docs, writer.n_tokens, first, last))
            writer = first = last = None

        for batch in batches:
            ids = batch.column(0).to_pylist()
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            lo = 0
            while lo < len(ids):  # about CHUNK_BYTES at a time, so that a batch of long texts stays small
                hi = lo + max(1, int(np.searchsorted(np.cumsum(sizes[lo:]), CHUNK_BYTES)))
                texts = as_bytes(batch.column(1).slice(lo, hi - lo))
                for doc_id, got in zip(ids[lo:hi], encoder.encode([t or b"" for t in texts])):
                    if writer is None:
                        name = f"{out_path}/shard-{part:06d}-{seq:05d}-{uuid.uuid4().hex}.sst"
                        writer = ShardWriter(open_path(name, write=True), encoder.width)
                    writer.add(doc_id, np.concatenate([got, tail]))
                    first, last = doc_id if first is None else first, doc_id  # nulls come first
                    if writer.at >= shard_bytes:
                        close()
                        seq += 1
                lo = hi
        if writer is not None:
            close()
        schema = arrow_schema(_MANIFEST)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows) if rows else [[]] * 7, schema)], schema=schema)

    picked = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    order = ["_id", F.xxhash64("_text"), "_text"]
    dealt = picked.repartitionByRange("_id", F.xxhash64("_text")).sortWithinPartitions(*order)
    return materialize(dealt.mapInArrow(run, _MANIFEST), "manifest")


def read_shards(manifest: DataFrame, digest: bool = False) -> DataFrame:
    """Documents of all shards in order: id, start and ids, or with ``digest`` their count and CRC-32."""
    ship(manifest.sparkSession)
    ddl = "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digest else "ids array<int>")
    schema = arrow_schema(ddl)
    earlier = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard
    placed = manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows: list[list] = [[], [], [], []]

                def out() -> pa.RecordBatch:
                    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema)], schema=schema)

                with open_path(path) as source:
                    for doc_id, ids in ShardReader(source):
                        last = zlib.crc32(ids.astype("<u4").tobytes()) if digest else ids.astype(np.int32)
                        for c, x in zip(rows, (doc_id, start, len(ids), last)):
                            c.append(x)
                        start += len(ids)
                        if len(rows[0]) >= (20_000 if digest else 500):
                            yield out()
                            rows = [[], [], [], []]
                yield out()

    n = max(1, manifest.sparkSession.sparkContext.defaultParallelism)
    return placed.select("path", "start").repartition(n, "path").mapInArrow(run, ddl)


def lookup(manifest: DataFrame, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids) of the identifiers asked for. Shards whose first and last identifier leave room for one are opened, and asked by Bloom filter, index and block."""
    ship(manifest.sparkSession)
    asked = sorted(doc_ids)
    ddl = "doc_id long, ids array<int>"
    schema = arrow_schema(ddl)

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with open_path(path) as source:
                    reader = ShardReader(source)
                    got = [(d, v.astype(np.int32)) for d in asked for v in reader.get(d)]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in got], schema[i].type) for i in range(2)], schema=schema)

    near = manifest.where(F.exists(F.array(*map(F.lit, asked)).cast("array<long>"), lambda a: a.between(F.col("first_id"), F.col("last_id"))))
    return near.select("path").mapInArrow(run, ddl)


def round_trip(spark: SparkSession, docs: DataFrame, out_path: str | None = None, **options) -> DataFrame:
    """Write all documents as shards and read their digests back from the files."""
    return read_shards(write_shards(docs, out_path or new_path(spark, "sst"), **options), digest=True)
