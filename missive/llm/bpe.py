"""Operator 5: byte-level BPE encoding and decoding by monoid tree reduction.

A text is halved until its parts are short, the parts are encoded, and
neighbours are joined up the tree. Joining re-encodes a window around the seam:

* Between matches of the splitting pattern. A letter followed by anything but
  a letter, a digit followed by anything but a digit, and anything followed by
  white space when it is none itself are ends of a match in every context (no
  alternative of the pattern spans them and none looks back). The window grows
  from the seam to the first such place on either side; tokens beyond it are
  those of the whole text.
* Within one long match. Token sequences of a byte-pair merge are right if and
  only if every two neighbours, encoded together, give themselves again. The
  window grows until this holds at both of its ends.

Decoding concatenates the tokens' bytes in halves up a tree.

The rank file's path is a parameter; each Python worker reads it once. Texts
are encoded inside map tasks, nothing is shuffled.

Defined cases: a null text counts as empty and has no tokens; a null doc_id is
passed on; an empty table gives an empty result; repeated rows are encoded
alike; extra columns are not read; texts may be of any length.
"""

from __future__ import annotations

import base64
import functools
import hashlib

import pandas as pd
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame

from missive.llm.common import small_batches

#: Characters of a leaf of the text tree, and bytes of a leaf within one match.
LEAF_CHARS = 64
LEAF_BYTES = 32
#: Windows of up to so many characters are kept for the next time.
_SHORT = 24
_PLACE = r"(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})|(?<=\S)(?=\s)"
_SEAM, _LAST = regex.compile(_PLACE), regex.compile("(?r)" + _PLACE)


def default_ranks() -> str:
    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


class Codec:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN,
                 leaf_chars: int = LEAF_CHARS, leaf_bytes: int = LEAF_BYTES):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        # the public merge routine encodes leaves
        leaf = tiktoken.Encoding("leaf", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._leaf = leaf.encode_ordinary
        self._merge = leaf._core_bpe.encode_single_piece
        self._pattern = regex.compile(pattern)
        self._bytes = {i: b for b, i in ranks.items()}
        self.digits = [str(i) for i in range(max(self._bytes) + 1)]
        self._leaf_chars, self._leaf_bytes = leaf_chars, leaf_bytes
        # windows are mostly a word or two and come again and again
        self._short = functools.lru_cache(1 << 16)(lambda t: tuple(self._leaf(t)))
        self._settled = functools.lru_cache(1 << 16)(
            lambda a, b: self._merge(self._bytes[a] + self._bytes[b]) == [a, b])

    # one match of the pattern

    def _match(self, piece: bytes) -> list[int]:
        if len(piece) <= self._leaf_bytes:
            return self._merge(piece) if piece else []
        half = len(piece) // 2
        left, right, grow = self._match(piece[:half]), self._match(piece[half:]), 1
        while True:
            a, b = max(0, len(left) - grow), min(len(right), grow)
            window = b"".join(map(self._bytes.__getitem__, left[a:] + right[:b]))
            if len(window) >= len(piece):
                middle = self._merge(piece)
            else:
                middle = self._match(window)
            if (a == 0 or self._settled(left[a - 1], middle[0])) and (
                    b == len(right) or self._settled(middle[-1], right[b])):
                return left[:a] + middle + right[b:]
            grow *= 2

    def _window(self, text: str) -> list[int]:
        if len(text) <= _SHORT:
            return self._short(text)
        if len(text) <= 2 * self._leaf_chars:
            return self._leaf(text)
        out = []
        for m in self._pattern.finditer(text):
            out += self._match(m.group().encode("utf-8")) if len(m.group()) > self._leaf_bytes else self._leaf(m.group())
        return out

    # the whole text

    @staticmethod
    def _last_seam(text: str) -> int:
        m = _LAST.search(text)   # from the end
        return m.start() if m else 0

    @staticmethod
    def _first_seam(text: str) -> int:
        m = _SEAM.search(text, 1) if text else None
        return m.start() if m else len(text)

    def encode(self, text: str) -> list[int]:
        if len(text) <= self._leaf_chars:
            return self._leaf(text)
        half = len(text) // 2
        a, b = text[:half], text[half:]
        left, right = self.encode(a), self.encode(b)
        p, q = self._last_seam(a), self._first_seam(b)
        tail, head = self._window(a[p:]), self._window(b[:q])
        left[len(left) - len(tail):] = self._window(a[p:] + b[:q])
        left += right[len(head):]
        return left

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= self._leaf_chars:
            return b"".join(map(self._bytes.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@functools.lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ranks: str | None = None) -> DataFrame:
    """One row per input row: doc_id, ids (array of int)."""
    path = ranks or default_ranks()
    small_batches(docs.sparkSession)

    def run(frames):
        own = codec(path)
        for f in frames:
            ids = [own.encode(t) if t else [] for t in f["text"]]
            yield pd.DataFrame({"doc_id": f["doc_id"], "ids": ids})

    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    return rows.mapInPandas(run, f"doc_id {dict(rows.dtypes)['doc_id']}, ids array<int>")


def decode_documents(encoded: DataFrame, ranks: str | None = None) -> DataFrame:
    """One row per encoded row: doc_id, decoded (binary)."""
    path = ranks or default_ranks()
    small_batches(encoded.sparkSession)

    def run(frames):
        own = codec(path)
        for f in frames:
            yield pd.DataFrame({"doc_id": f["doc_id"], "decoded": [own.decode(list(i)) for i in f["ids"]]})

    rows = encoded.select("doc_id", "ids")
    return rows.mapInPandas(run, f"doc_id {dict(rows.dtypes)['doc_id']}, decoded binary")


def bpe_digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ranks: str | None = None,
               with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row, encoded and decoded in one pass."""
    path = ranks or default_ranks()
    small_batches(docs.sparkSession)

    def run(frames):
        own = codec(path)
        for f in frames:
            n, ids_sha, text_sha, all_ids = [], [], [], []
            for t in f["text"]:
                ids = own.encode(t) if t else []
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(own.digits.__getitem__, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(own.decode(ids)).hexdigest())
                all_ids.append(ids)
            out = {"doc_id": f["doc_id"], "n_tokens": n, "ids_sha256": ids_sha, "decoded_sha256": text_sha}
            yield pd.DataFrame(out | ({"ids": all_ids} if with_ids else {}))

    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    return rows.mapInPandas(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, "
                                 "decoded_sha256 string" + ", ids array<int>" * with_ids)
