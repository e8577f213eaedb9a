"""Operator 1: BPE encoding and decoding by a distinct-word table.

The vocabulary ``word_bpe_49k.json`` normalises and pre-tokenises word by word: white space is dropped, lower-casing works
on single characters, and neither composition nor the pre-tokeniser's pattern reaches across white space. So the ids of
a text are the ids of its white-space separated words, one after another. Texts are split, each distinct word is encoded
once by the library itself, and ids are joined back by position (see :mod:`.wordtable`).

Decoding joins each id with its piece. The vocabulary has no decoder, so the library puts one space between pieces. The
id-to-piece table has as many rows as the vocabulary, which bounds what is broadcast.

Defined results: a null text counts as empty (no ids, empty decoded text); null ids and repeated rows stay, one output row
per input row; an empty table gives an empty result; other columns are ignored whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordtable
from .common import default_tokenizer_path, env_single_thread, materialize

DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
TOKENS = "doc_id long, ids array<int>, decoded string"


@functools.lru_cache(2)
def _tokenizer(path: str):
    env_single_thread()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@functools.lru_cache(2)
def pieces(path: str) -> list[str]:
    """The piece of every id."""
    t = _tokenizer(path)
    vocab = t.get_vocab(with_added_tokens=True)
    out = [""] * (max(vocab.values()) + 1)
    for piece, i in vocab.items():
        out[i] = piece
    return out


def check_vocabulary(path: str) -> None:
    """Refuse a vocabulary for which words cannot be encoded on their own."""
    with open(path, encoding="utf-8") as f:
        j = json.load(f)
    pre = json.dumps(j.get("pre_tokenizer") or {})
    if j.get("decoder") is not None or '"Removed"' not in pre or j.get("post_processor") is not None:
        raise ValueError("this operator needs a vocabulary that drops white space and has no decoder")


def encode_words(path: str, words: list[bytes]) -> list[bytes]:
    """Ids of each word as little-endian unsigned 32-bit integers."""
    out: list[bytes] = []
    t = _tokenizer(path)
    for i in range(0, len(words), 20_000):
        some = [w.decode("utf-8", "replace") for w in words[i : i + 20_000]]
        out += [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch_fast(some, add_special_tokens=False)]
    return out


def _digests(path: str, block: wordtable.Assembled) -> pa.RecordBatch:
    table = pieces(path)
    ids, texts = block.values, []
    for v in ids:
        texts.append(" ".join([table[i] for i in np.frombuffer(v, "<u4").tolist()]).encode())
    counts = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    rows: list[tuple] = []
    for doc_id, lo, hi in zip(block.doc_ids, block.starts.tolist(), block.ends.tolist()):
        at = block.at[lo:hi]
        own = at.tolist()
        h = hashlib.sha256(b"".join([ids[i] for i in own]))
        d = hashlib.sha256(b" ".join([t for i in own if (t := texts[i])]))
        rows.append((doc_id, int(counts[at].sum()) if own else 0, h.hexdigest(), d.hexdigest()))
    return wordtable._batch(DIGESTS, rows)


def _tokens(path: str, block: wordtable.Assembled) -> pa.RecordBatch:
    table = pieces(path)
    rows = []
    for doc_id, lo, hi in zip(block.doc_ids, block.starts.tolist(), block.ends.tolist()):
        ids = np.frombuffer(b"".join([block.values[i] for i in block.at[lo:hi].tolist()]), "<u4").tolist()
        rows.append((doc_id, ids, " ".join([table[i] for i in ids])))
    return wordtable._batch(TOKENS, rows)


def encode(docs: DataFrame, tokenizer_path: str | None = None, digest: bool = False, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """Ids and decoded text of each document, or with ``digest`` their count and SHA-256 sums."""
    path = tokenizer_path or default_tokenizer_path("word_bpe_49k.json")
    check_vocabulary(path)
    return wordtable.value_units(
        docs, bytes.split, functools.partial(encode_words, path), functools.partial(_digests if digest else _tokens, path), DIGESTS if digest else TOKENS, id_col, text_col, **limits
    )


def decode(tokens: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """(doc_id, decoded) from (doc_id, ids) by a join with the id-to-piece table; unknown ids are left out, as the library does."""
    path = tokenizer_path or default_tokenizer_path("word_bpe_49k.json")
    spark = tokens.sparkSession
    rows = [(i, p) for i, p in enumerate(pieces(path))]
    table = F.broadcast(spark.createDataFrame(rows, "id int, piece string"))  # as many rows as the vocabulary
    keyed = tokens.select("doc_id", "ids").withColumn("_row", F.monotonically_increasing_id())
    keyed = materialize(keyed, "decode")
    at = keyed.select("_row", F.posexplode("ids").alias("pos", "id")).join(table, "id")
    got = at.groupBy("_row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"]), " ").alias("decoded"))
    return keyed.join(got, "_row", "left").select("doc_id", F.coalesce("decoded", F.lit("")).alias("decoded"))
