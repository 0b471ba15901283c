"""Packing of tokenised documents into sequences of a fixed length.

Bounded-space online best fit. A packer keeps a fixed number of open bins; a
bitset has a bit for each free space that some open bin has, so the tightest
bin that holds an item is the lowest set bit at or above the item's length.
When a new bin is needed and all are open, the fullest closes first.

Tokenising cuts a document longer than a sequence into full pieces and a rest.
The pieces (ids, no tokens) are written once; packers then work side by side on
streams of about ``PIECES_PER_PACKER`` pieces that a hash of the id deals out,
so at most ``open_bins`` sequences a stream stay part-filled, whatever the size
of the input. A bin is never split over two tasks.

Defined results: a null or empty text is one piece of only the end id; texts of
any length are packed whole; repeated rows are packed each for itself (equal
ids are numbered apart by their place in the stream); a null id is a value like
any other; an empty table gives an empty table; only the id and text columns
are read, so other columns cannot clash.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _byte_letters
from .common import KEPT, Scratch, TokenCache, pretokens, row_bounds, slices

PIECES_PER_PACKER = 1_000_000
OPEN_BINS = 1024


class Packer:
    """Bounded-space best fit over bins of ``capacity``."""

    def __init__(self, capacity: int, open_bins: int = OPEN_BINS):
        self.capacity, self.most = capacity, open_bins
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = 0
        self.open = 0
        self.made = 0

    def place(self, size: int) -> tuple[int, int]:
        """(bin, offset in it) for an item of ``size`` (1 to capacity)."""
        fits = self.bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            stack = self.by_free[free]
            number = stack.pop()
            if not stack:
                self.bits &= ~(1 << free)
        else:
            number, free = self.made, self.capacity
            self.made += 1
            if size < free:
                if self.open >= self.most:
                    self._close()
                self.open += 1
        left = free - size
        if left:
            self.by_free[left].append(number)
            self.bits |= 1 << left
        elif free < self.capacity:
            self.open -= 1
        return number, self.capacity - free

    def _close(self) -> None:
        """Close the fullest open bin."""
        free = (self.bits & -self.bits).bit_length() - 1
        stack = self.by_free[free]
        stack.pop(0)
        if not stack:
            self.bits &= ~(1 << free)
        self.open -= 1


class FoldingTokens:
    """The library's tokenizer behind a cache of distinct pretokens."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.letters = {b: c for c, b in _byte_letters().items()}
        self.cache = TokenCache(self._pieces)

    def _pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Pieces are folded and split already, so the library's model takes them
        as they are, by the letters of their bytes."""
        merge, letters = self.model.tokenize, self.letters
        return [[t.id for t in merge(p.decode("latin-1").translate(letters))] for p in pieces]

    def encode_slice(self, s) -> tuple[np.ndarray, np.ndarray]:
        data, starts, ends, row, odd = pretokens(s, b"<|", fold=True)
        ids, size = self.cache.ids(data, starts, ends)
        bounds = row_bounds(row, size, len(s.rows))
        if odd.any():
            parts = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
            for k in np.flatnonzero(odd):
                parts[k] = np.array(self.tokenizer.encode(s.text(k).decode(), add_special_tokens=False).ids, np.uint32)
            ids = np.concatenate(parts)
            bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, bounds


@lru_cache(maxsize=2)
def load(path: str) -> FoldingTokens:
    return FoldingTokens(path)


KEPT.append(load.cache_clear)


def pieces(docs: DataFrame, vocab_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32 and, if asked, ids."""
    kind = dict(docs.dtypes)[id_col]
    schema = f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids array<int>" if with_ids else "")

    def run(batches):
        tokens = load(vocab_path)
        for batch in batches:
            for s in slices(batch.column(1)):
                ids, bounds = tokens.encode_slice(s)
                # one end id after each document
                full = np.insert(ids, bounds[1:], end_id).astype("<u4")
                bounds = bounds + np.arange(len(bounds))
                total = np.diff(bounds)
                count = -(-total // capacity)
                owner = np.repeat(np.arange(len(total)), count)
                number = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
                start = number * capacity
                length = np.minimum(total[owner] - start, capacity)
                lo = bounds[owner] + start
                raw = memoryview(full.tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(lo.tolist(), length.tolist())]
                cols = [batch.column(0).take(pa.array(owner + s.rows.start)), pa.array(number.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                if with_ids:
                    cuts = np.append(lo, bounds[-1])
                    cols.append(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(full.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, names=["id", "piece", "start", "length", "ids_crc32", "ids"][: len(cols)])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def pack(items: DataFrame, scratch: Scratch, capacity: int = 2048, open_bins: int = OPEN_BINS, per_packer: int = PIECES_PER_PACKER, id_col: str = "doc_id", carry: tuple[str, ...] = ("piece", "start", "length", "ids_crc32")) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to written rows that have ``length``.

    Streams are dealt by a hash of the id and piece; a stream's order is that
    hash too, so lengths arrive mixed and the outcome repeats exactly.
    """
    total = items.count()
    packers = max(1, -(-total // per_packer))
    fields = {f.name: f.dataType.simpleString() for f in items.schema.fields}
    names = [id_col, *carry]
    schema = ", ".join(f"`{n}` {fields[n]}" for n in names) + ", sequence_id bigint, offset bigint"
    length_at = names.index("length")

    def run(batches):
        packer, stream = Packer(capacity, open_bins), None
        for batch in batches:
            place = packer.place
            if stream is None and batch.num_rows:
                stream = batch.column(batch.num_columns - 1)[0].as_py()
            placed = [place(n) for n in batch.column(length_at).to_pylist()]
            number = pa.array([(stream << 40) + b for b, _ in placed], pa.int64())
            offset = pa.array([o for _, o in placed], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], number, offset], names=[*names, "sequence_id", "offset"])

    order = F.xxhash64(*[F.col(n) for n in names])
    dealt = items.select(*names, order.alias("__order"))
    if packers == 1:
        dealt = dealt.coalesce(1)
    else:
        dealt = dealt.repartitionByRange(packers, "__order")
    return dealt.sortWithinPartitions("__order", *names).withColumn("__stream", F.spark_partition_id().cast("bigint")).select(*names, "__stream").mapInArrow(run, schema)


def packed(docs: DataFrame, vocab_path: str, capacity: int = 2048, end_id: int = 0, open_bins: int = OPEN_BINS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise and pack: one row per piece with its sequence and place."""
    scratch = Scratch(docs.sparkSession, "packing")
    cut = scratch.keep(pieces(docs, vocab_path, capacity, end_id, id_col, text_col), "pieces")
    return pack(cut, scratch, capacity, open_bins, id_col=id_col)


def sequences(packed_rows: DataFrame, with_ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The token sequences themselves: (sequence_id, n_tokens, ids) from packed
    rows and the ``pieces(..., with_ids=True)`` of the same documents. A group
    is one sequence, so it never holds more than its capacity."""
    key = [id_col, "piece"]
    joined = packed_rows.select(*key, "sequence_id", "offset").join(with_ids.select(*key, "ids"), key)
    return joined.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids")).select("sequence_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids")
