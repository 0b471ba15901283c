"""Byte-level BPE encoding and decoding.

Encoding merges, in a doubly linked list of symbols, the adjacent pair of
lowest rank, taken from a priority queue; entries whose symbols have changed
since they were queued are stale and skipped. Decoding concatenates vocabulary
strings. Texts are split before merging by the byte-level pattern, and every
distinct piece is merged once per Python worker (a bounded cache).

Nothing is shuffled: a row's result depends on that row alone.

Defined results: a null text encodes as the empty text (no ids, hash of no
bytes); the vocabulary's special strings inside a text become their ids, as in
the tokenizers library; texts of any length are encoded whole; repeated rows
give repeated results; an empty table gives an empty table. Input columns other
than the id and the text are not looked at, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TokenCache, gather, pretokens, row_bounds, slices

_WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PATTERN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteBPE:
    """A byte-level BPE vocabulary with its merge ranks."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], _byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        strings = [b""] * size
        for word, i in vocab.items():
            if word not in self.special:
                strings[i] = bytes(letters[c] for c in word)
        for word, i in self.special.items():
            strings[i] = word.encode()
        self.strings = strings
        self.byte_ids = [0] * 256
        for c, b in letters.items():
            self.byte_ids[b] = vocab[c]
        #: left * 2**20 + right -> (rank, merged id)
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[(vocab[left] << 20) + vocab[right]] = (rank, vocab[left + right])
        self.lengths = np.array([len(x) for x in strings], np.int64)
        self.flat = np.frombuffer(b"".join(strings), np.uint8)
        self.ptr = np.cumsum(self.lengths) - self.lengths
        self.marked = b"<|"
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.cache = TokenCache(self.merge_all)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece: queue of ranks over a doubly linked symbol list."""
        symbols = [self.byte_ids[b] for b in piece]
        n = len(symbols)
        if n < 2:
            return symbols
        get = self.merges.get
        queue = []
        for i in range(n - 1):
            found = get((symbols[i] << 20) + symbols[i + 1])
            if found:
                queue.append((found[0], i, symbols[i], symbols[i + 1], found[1]))
        if not queue:
            return symbols
        heapq.heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pop, push = heapq.heappop, heapq.heappush
        while queue:
            _, i, left, right, merged = pop(queue)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue  # stale: one of the two has been merged since
            symbols[i], symbols[j] = merged, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                found = get((merged << 20) + symbols[k])
                if found:
                    push(queue, (found[0], i, merged, symbols[k], found[1]))
            h = before[i]
            if h >= 0:
                found = get((symbols[h] << 20) + merged)
                if found:
                    push(queue, (found[0], h, symbols[h], merged, found[1]))
        return [s for s in symbols if s >= 0]

    def merge_all(self, pieces: list[bytes]) -> list[list[int]]:
        merge = self.merge
        return [merge(p) for p in pieces]

    def encode(self, text: str | None) -> list[int]:
        """Ids of one text, without the vectorised splitting."""
        out: list[int] = []
        for part in self.special_split.split(text or "") if self.special_split else [text or ""]:
            if part in self.special:
                out.append(self.special[part])
            else:
                for piece in _PATTERN.findall(part):
                    out += self.merge(piece.encode())
        return out

    def encode_slice(self, s) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a slice one after another, and each text's bounds."""
        data, starts, ends, row, odd = pretokens(s, self.marked, fold=False)
        ids, size = self.cache.ids(data, starts, ends)
        bounds = row_bounds(row, size, len(s.rows))
        if odd.any():
            parts = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
            for k in np.flatnonzero(odd):
                parts[k] = np.array(self.encode(s.text(k).decode()), np.uint32)
            ids = np.concatenate(parts)
            bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, bounds

    def decode_bytes(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the concatenated vocabulary strings."""
        return gather(self.flat, self.ptr[ids], self.lengths[ids])

    def decode(self, ids) -> str:
        return self.decode_bytes(np.asarray(ids, np.int64)).tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> ByteBPE:
    """One vocabulary per Python worker, with its cache."""
    return ByteBPE(path)


def encode(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id column and ``ids`` (array<int>) of the whole text."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        bpe = load(vocab_path)
        for batch in batches:
            for s in slices(batch.column(1)):
                ids, bounds = bpe.encode_slice(s)
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.rows.start, len(s.rows)), lists], names=["id", "ids"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, vocab_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: the id column and ``text``; null ids decode as the empty text."""
    kind = dict(encoded.dtypes)[id_col]

    def run(batches):
        bpe = load(vocab_path)
        for batch in batches:
            texts = [bpe.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, sha256 of the ids as little-endian u32, sha256 of
    the text decoded from them; encoded and decoded in one pass."""
    kind = dict(docs.dtypes)[id_col]
    schema = f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"

    def run(batches):
        bpe = load(vocab_path)
        sha = hashlib.sha256
        for batch in batches:
            for s in slices(batch.column(1)):
                ids, bounds = bpe.encode_slice(s)
                ends = np.concatenate([[0], np.cumsum(bpe.lengths[ids])])[bounds].tolist()
                text = memoryview(bpe.decode_bytes(ids).tobytes())
                raw = memoryview(ids.astype("<u4").tobytes())
                at = (4 * bounds).tolist()
                hashed = [sha(raw[a:b]).hexdigest() for a, b in zip(at, at[1:])]
                back = [sha(str(text[a:b], "utf-8", "replace").encode()).hexdigest() for a, b in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(s.rows.start, len(s.rows)), pa.array(np.diff(bounds)), pa.array(hashed, pa.string()), pa.array(back, pa.string())],
                    names=["id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
