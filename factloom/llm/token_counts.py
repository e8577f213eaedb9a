"""Operator 8: token counts with an exact count at every prefix.

SentencePiece merges never reach across a space that follows another character, so a text is a row of units: runs of
spaces with the characters after them. Each distinct unit is valued once (see :mod:`.wordtable`) by a
dynamic programme over its prefixes: the last piece of a prefix is the only suffix piece that
may follow the last piece of what stands before it, so ``count[i] = count[i - len(piece)] + 1``. Units are
visited in sorted order, so shared prefixes are worked out once. Counts of a text are running sums over its units;
questions about budgets and truncation need no second encoding.

Defined results: null counts as the empty text (0 bytes, 0 tokens); rows with null or repeated ids stay; an empty
table gives an empty result; other columns are ignored whatever their names. Control pieces' strings inside texts are ordinary text.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import wordtable
from .common import default_tokenizer_path

COUNTS = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, budget_chars long"
PREFIXES = "doc_id long, n_bytes long, n_tokens long, prefix_tokens array<int>"
_RUNS = re.compile(rb" *[^ ]+| +\Z")
_MARK = "▁".encode()
_MEMO = 400_000


def split_units(text: bytes) -> list[bytes]:
    """Units of a text, without the first space of each; the library puts one space before a text."""
    if _MARK in text:
        text = text.replace(_MARK, b" ")  # the library's own sign for a space
    if not text:
        return []
    if b"  " not in text and text[:1] != b" " and text[-1:] != b" ":
        return text.split(b" ")
    return [x[1:] for x in _RUNS.findall(b" " + text)]


def pack(counts: list[int]) -> bytes:
    """Counts as bytes where they fit, else as 32-bit integers; the first byte says which."""
    return b"\x01" + bytes(counts) if max(counts) < 256 else b"\x04" + np.array(counts, "<u4").tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u4" if data[0] == 4 else "u1", offset=1).astype(np.int64)


class PrefixCounter:
    """Exact token counts of all prefixes of units for one SentencePiece BPE model."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self.sp.piece_size())
        plain = [i for i in ids if not (self.sp.is_control(i) or self.sp.is_byte(i) or self.sp.is_unknown(i) or self.sp.is_unused(i))]
        self.pieces = {self.sp.id_to_piece(i) for i in plain}
        self.longest = max(map(len, self.pieces))
        self.byte_fallback = any(self.sp.is_byte(i) for i in ids)
        if any("▁" in p.lstrip("▁") for p in self.pieces) or self.sp.encode(" a", out_type=str)[0] != "▁":
            raise ValueError("this operator needs a model whose pieces hold no space after another character and that keeps white space")
        self.memo: dict[tuple[str, str], bool] = {}

    def _follows(self, left: str, piece: str) -> bool:
        """Whether the model leaves ``left`` and ``piece`` apart when they stand together. An unknown line break keeps the added space away."""
        key = (left, piece)
        got = self.memo.get(key)
        if got is None:
            if len(self.memo) >= _MEMO:
                self.memo.clear()
            want = [left, piece] if left else [piece]
            got = self.memo[key] = self.sp.encode("\n" + left + piece, out_type=str)[-len(want) - 1 :] == [self.barrier, *want]
        return got

    @functools.cached_property
    def barrier(self) -> str:
        return self.sp.encode("\n", out_type=str)[-1]

    def count(self, units: list[bytes]) -> list[bytes]:
        """For each unit, counts at its prefixes of 1, 2, ... code points, the space before it not counted as one."""
        out: list[bytes] = [b""] * len(units)
        pieces, longest, follows, memo = self.pieces, self.longest, self._follows, self.memo
        before = ""
        last, cnt = [""], [0]
        texts = [("▁" + u.decode("utf-8", "replace").replace(" ", "▁"), i) for i, u in enumerate(units)]
        texts.sort()
        for s, at in texts:
            n = min(len(s), len(before))
            keep = 0
            while keep < n and s[keep] == before[keep]:
                keep += 1
            del last[keep + 1 :], cnt[keep + 1 :]
            for i in range(keep + 1, len(s) + 1):
                for j in range(max(0, i - longest), i):
                    piece = s[j:i]
                    if piece in pieces:
                        key = (last[j], piece)
                        ok = memo.get(key)
                        if ok is None:
                            ok = follows(*key)
                        if ok:
                            last.append(piece)
                            cnt.append(cnt[j] + 1)
                            break
                else:  # no piece: the bytes of one unknown character, to which nothing is merged
                    last.append("")
                    cnt.append(cnt[-1] + (len(s[i - 1].encode()) if self.byte_fallback else 1))
            before = s
            out[at] = pack(cnt[1:])
        return out


@functools.lru_cache(1)
def _counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def _values(path: str, units: list[bytes]) -> list[bytes]:
    return _counter(path).count(units)


def _emit_counts(limit: int, block: wordtable.Assembled) -> pa.RecordBatch:
    """Tokens of each text, and where its budget ends: by the sums of its units' counts, and the prefixes of the one unit in which it ends."""
    whole = np.fromiter((v[-1] if v[0] == 1 else int.from_bytes(v[-4:], "little") for v in block.values), np.int64, len(block.values))
    chars = np.fromiter(((len(v) - 1) // v[0] for v in block.values), np.int64, len(block.values))
    rows = []
    for d, b, lo, hi in zip(block.doc_ids, block.n_bytes, block.starts.tolist(), block.ends.tolist()):
        at = block.at[lo:hi]
        sums = np.cumsum(whole[at])
        n = int(sums[-1]) if len(at) else 0
        far = int(chars[at].sum()) - 1 if len(at) else 0  # the first unit's space is not in the text
        if n > limit:
            k = int(np.searchsorted(sums, limit))  # the unit in which the budget ends; a later one starts beyond it
            k += int(sums[k] == limit)
            own = unpack(block.values[at[k]]) + (int(sums[k - 1]) if k else 0)
            fits = np.flatnonzero(own <= limit)
            far = int(chars[at[:k]].sum()) - 1 + (int(fits[-1]) + 1 if len(fits) else 0)
        rows.append((d, b, n, n > limit, max(far, 0)))
    return wordtable._batch(COUNTS, rows)


def _emit_prefixes(block: wordtable.Assembled) -> pa.RecordBatch:
    rows = []
    for d, b, lo, hi in zip(block.doc_ids, block.n_bytes, block.starts.tolist(), block.ends.tolist()):
        total, counts = 0, []
        for k, i in enumerate(block.at[lo:hi].tolist()):
            own = unpack(block.values[i])
            counts.append(own[(k == 0) :] + total)  # the first unit's space is not in the text
            total += int(own[-1])
        rows.append((d, b, total, np.concatenate(counts).tolist() if counts else []))
    return wordtable._batch(PREFIXES, rows)


def count_tokens(docs: DataFrame, model_path: str | None = None, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """Bytes, tokens, whether a text has more than ``limit`` tokens, and the code points of its longest prefix that has no more (``budget_chars``)."""
    path = model_path or default_tokenizer_path("piece_bpe_32k.model")
    return wordtable.value_units(docs, split_units, functools.partial(_values, path), functools.partial(_emit_counts, limit), COUNTS, id_col, text_col, **limits)


def count_prefixes(docs: DataFrame, model_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """Besides, ``prefix_tokens``: the token count of each prefix of 1, 2, ... code points."""
    path = model_path or default_tokenizer_path("piece_bpe_32k.model")
    return wordtable.value_units(docs, split_units, functools.partial(_values, path), _emit_prefixes, PREFIXES, id_col, text_col, **limits)


def longest_prefix(prefix_tokens: Column, budget: int) -> Column:
    """Code points of the longest prefix with at most ``budget`` tokens."""
    fits = F.transform(prefix_tokens, lambda x, i: F.when(x <= budget, i + 1).otherwise(F.lit(0)))
    return F.coalesce(F.array_max(fits), F.lit(0))
