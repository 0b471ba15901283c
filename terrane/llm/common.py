"""Shared pieces of the corpus operators: tables in the shared folder, and
vectorised scanning of Arrow string columns.

Scanning works on the raw UTF-8 buffer of a column: a slice of about
``SLICE_BYTES`` is classified byte by byte with lookup tables, cut into words,
and every word gets a 64-bit hash from its bytes, all in numpy. No Python
object is made per word.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import unicodedata
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled by one vectorised step; one longer text is a step of its own.
SLICE_BYTES = 1 << 20

U64 = np.uint64
_MULT = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
#: mallopt's name for the size from which memory is mapped; 128 KB unless set.
_MMAP_THRESHOLD = -3


# ------------- tables


class Scratch:
    """Tables of one operator run, written under the cluster's shared folder.

    The folder is ``spark.checkpoint.dir``; only where that is unset (a local
    test session) a temporary one is made and set. ``keep`` writes a frame as
    Parquet and returns the frame that reads it back, which cuts the lineage:
    a lost executor costs a re-read, not a re-computation. ``drop`` removes a
    table that no later step reads; the rest goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        self.count = 0
        atexit.register(self.drop)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back.scratch_path = path
        return back

    def drop(self, *frames: DataFrame) -> None:
        """Remove the tables behind ``frames``, or everything without arguments."""
        try:
            jvm = self.spark._jvm
            for path in [f.scratch_path for f in frames] or [self.root]:
                at = jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session has ended: nothing left to remove with
            if frames:
                raise


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="terrane-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def give_back() -> None:
    """Return freed memory of the driver's Python to the system: allocators keep
    what a bounded model took while it was made, beside all later steps."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


#: What empties the caches that a worker keeps from task to task.
KEPT: list[Callable[[], None]] = []


def forget() -> None:
    """Empty them, in a worker that begins to work for an operator without such
    a cache: a worker serves all operators of a session, one after another."""
    for clear in KEPT:
        clear()
    give_back()


@contextmanager
def reusing(most: int = 2 << 20) -> Iterator[None]:
    """Let arrays of up to ``most`` bytes come from memory that this process
    holds already, instead of new pages for each; at the end the pages go back."""
    try:
        limit = ctypes.CDLL(None).mallopt
    except (AttributeError, OSError):  # not glibc
        yield
        return
    limit(_MMAP_THRESHOLD, most)
    try:
        yield
    finally:
        limit(_MMAP_THRESHOLD, 128 << 10)
        give_back()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_of_id(column: str = "doc_id") -> Column:
    """crc32 of the id as text; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


# ------------- scanning


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection on 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


#: Spans beyond this many bytes are hashed one by one.
LONG = 64
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


def _eights(data: np.ndarray) -> np.ndarray:
    """At each place, the eight bytes from there on as one number."""
    return np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span ``data[start:end]``; equal bytes, equal hash.

    Eight bytes at a time go through a bijection, so spans of one size up to
    eight bytes never collide; spans over ``LONG`` bytes take blake2b."""
    size, eight = ends - starts, _eights(data)
    h = mix((eight[starts] & _LOW[np.minimum(size, 8)]) ^ mix(size.astype(U64) + U64(_MULT)))
    left = np.flatnonzero(size > 8)
    for i in left[size[left] > LONG].tolist():
        h[i] = int.from_bytes(blake2b(data[starts[i] : ends[i]].data, digest_size=8).digest(), "little")
    left = left[size[left] <= LONG]
    at, n = starts[left] + 8, size[left] - 8
    while len(left):
        h[left] = mix(h[left] * U64(_MULT) + (eight[at] & _LOW[np.minimum(n, 8)]))
        on = n > 8
        left, at, n = left[on], at[on] + 8, n[on] - 8
    return h


def same_spans(a: np.ndarray, a0: np.ndarray, a1: np.ndarray, b: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> bool:
    """All spans ``a[a0:a1]`` hold the bytes of their partners ``b[b0:b1]``."""
    size = a1 - a0
    if (size != b1 - b0).any():
        return False
    long = np.flatnonzero(size > LONG)
    if any(not np.array_equal(a[a0[i] : a1[i]], b[b0[i] : b1[i]]) for i in long.tolist()):
        return False
    x, y = _eights(a), _eights(b)
    left = np.flatnonzero(size <= LONG)
    p, q, n = a0[left], b0[left], size[left]
    while len(n):
        if ((x[p] ^ y[q]) & _LOW[np.minimum(n, 8)]).any():
            return False
        on = n > 8
        p, q, n = p[on] + 8, q[on] + 8, n[on] - 8
    return True


class Slice:
    """Consecutive rows of a string column: ``rows`` (a range), their bytes in
    ``data`` and the ``bounds`` of each row in it (one more than rows)."""

    __slots__ = ("bounds", "data", "rows")

    def __init__(self, rows: range, data: np.ndarray, bounds: np.ndarray):
        self.rows, self.data, self.bounds = rows, data, bounds

    def text(self, k: int) -> bytes:
        return self.data[self.bounds[k] : self.bounds[k + 1]].tobytes()


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a string column into slices of about ``limit`` bytes; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    bounds = np.frombuffer(offs, dtype=np.int64, count=n + 1 + column.offset)[column.offset :]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(bounds, bounds[at] + limit, side="right")) - 1
        to = min(n, max(to, at + 1))
        yield Slice(range(at, to), raw[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at])
        at = to


def _lut(on: str | bytes | list[int]) -> np.ndarray:
    table_ = np.zeros(256, dtype=bool)
    table_[list(on)] = True
    return table_


SPACES = _lut([0x20, *range(9, 14)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Letters of any script count as non-ASCII bytes do: part of a word.
NOT_LETTERS = _lut([b for b in range(128) if not chr(b).isalpha()])


def words(s: Slice, breaks: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a slice, A-Z lowered: (hash, start, end, row within the slice).

    A word is a longest run of bytes that ``breaks`` does not name; no word
    crosses from one row to the next.
    """
    data = LOWER[s.data]
    if not len(data):
        none = np.empty(0, np.int64)
        return np.empty(0, U64), none, none, none
    inside = ~breaks[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[s.bounds] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | first[1:-1]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | first[1:-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return span_hashes(data, starts, ends), starts, ends, rows_of(s, starts)


def rows_of(s: Slice, starts: np.ndarray) -> np.ndarray:
    """The row that each of the rising positions lies in."""
    return np.repeat(np.arange(len(s.rows)), np.diff(np.searchsorted(starts, s.bounds)))


# ------------- splitting as tokenizers do

LETTER, NUMBER, SPACE, OTHER, ODD = range(5)


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower case of code points up to U+024F; ODD where only the slow way is exact."""
    kinds, lower = np.full(0x800, ODD, np.uint8), np.arange(0x800, dtype=np.int64)
    for cp in range(0x250):
        c = chr(cp)
        kind = unicodedata.category(c)[0]
        if 0x1C <= cp <= 0x1F or cp in (0x85, 0xA0):
            continue
        kinds[cp] = SPACE if c in " \t\n\v\f\r" else LETTER if kind == "L" else NUMBER if kind == "N" else OTHER
        low = c.lower()
        if len(low) == 1 and (ord(low) < 0x80) == (cp < 0x80) and ord(low) < 0x800:
            lower[cp] = ord(low)
        else:
            kinds[cp] = ODD
    return kinds, lower


KINDS, LOWERED = _classes()


def pretokens(s: Slice, marked: bytes, fold: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Split texts as the byte-level pattern does, or (``fold``) as the folding one.

    Returns (bytes, starts, ends, row of each token, rows that need the slow
    way). A row needs it if it holds a code point above U+024F, a rare control
    or space, or the two bytes ``marked`` with which special tokens begin.
    """
    data = s.data
    n = len(data)
    rows = len(s.rows)
    odd_rows = np.zeros(rows, dtype=bool)
    none = np.empty(0, np.int64)
    if not n:
        return data, none, none, none, odd_rows
    kind = KINDS[data]
    high = data >= 0x80
    if high.any():
        lead = np.flatnonzero(data >= 0xC0)
        lead = lead[lead + 1 < n]
        cp = ((data[lead].astype(np.int64) & 0x1F) << 6) | (data[lead + 1] & 0x3F)
        two = data[lead] < 0xE0
        found = np.where(two, KINDS[np.where(two, cp, 0)], ODD)
        kind[high] = ODD
        kind[lead] = found
        kind[lead + 1] = found
        if fold:
            data = data.copy()
            low = LOWERED[np.where(two, cp, 0x7FF)]
            change = two & (low != cp) & (found != ODD)
            data[lead[change]] = 0xC0 | (low[change] >> 6)
            data[lead[change] + 1] = 0x80 | (low[change] & 0x3F)
    if fold:
        data = LOWER[data]
    odd = kind == ODD
    odd[:-1] |= (data[:-1] == marked[0]) & (data[1:] == marked[1])
    if odd.any():
        odd_rows[np.searchsorted(s.bounds, np.flatnonzero(odd), side="right") - 1] = True
    first = np.zeros(n + 1, dtype=bool)
    first[s.bounds] = True
    begin = first[:-1].copy()
    begin[1:] |= kind[1:] != kind[:-1]
    rs = np.flatnonzero(begin)
    re_ = np.append(rs[1:], n)
    rk = kind[rs]
    followed = ~first[re_]
    cut = np.zeros(n + 1, dtype=bool)
    cut[rs] = True
    prev_space = np.zeros(len(rs), dtype=bool)  # a blank that the run takes as its prefix
    if not fold:
        blank = (rk == SPACE) & followed
        last = re_[blank] - 1
        cut[last] = True
        takes = np.flatnonzero(blank)[data[last] == 0x20] + 1
        cut[rs[takes]] = False
        prev_space[takes] = True
    else:
        digit = (kind == NUMBER) & ((data & 0xC0) != 0x80)
        cut[:-1] |= digit
    quote = np.flatnonzero((rk == OTHER) & (data[rs] == 0x27) & (re_ - rs == 1) & followed & ~prev_space)
    quote = quote[rk[np.minimum(quote + 1, len(rs) - 1)] == LETTER]
    if len(quote):
        p, run = rs[quote], re_[quote + 1] - rs[quote + 1]
        c1 = data[p + 1]
        c2 = data[np.minimum(p + 2, n - 1)]
        one = np.isin(c1, np.frombuffer(b"stmd", np.uint8))
        two = (run >= 2) & (((c1 == 0x72) & (c2 == 0x65)) | ((c1 == 0x76) & (c2 == 0x65)) | ((c1 == 0x6C) & (c2 == 0x6C)))
        cut[p[one | two] + 1] = False
        cut[p[one] + 2] = True
        cut[p[two & ~one] + 3] = True
    starts = np.flatnonzero(cut[:-1])
    ends = np.append(starts[1:], n)
    keep = ~odd_rows[(row := rows_of(s, starts))]
    if fold:
        keep &= kind[starts] != SPACE
    return data, starts[keep], ends[keep], row[keep], odd_rows


class TokenCache:
    """Ids of distinct pretokens, found by hash and held against their bytes;
    bounded, so it may be emptied."""

    def __init__(self, encode, most: int = 1_500_000, most_bytes: int = 64 << 20):
        self.encode, self.most, self.most_bytes = encode, most, most_bytes
        self._clear()

    def _clear(self) -> None:
        self.keys = np.empty(0, U64)
        #: place and length of each key's ids in ``flat``, and of its bytes in ``raw``
        self.at = np.empty((4, 0), np.int64)
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0
        self.raw, self.filled = np.empty(1 << 18, np.uint8), 0

    @staticmethod
    def _with(store: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
        if used + len(more) > len(store):
            grown = np.empty(max(2 * len(store), used + len(more)), store.dtype)
            grown[:used] = store[:used]
            store = grown
        store[used : used + len(more)] = more
        return store

    def ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all tokens one after another, and how many each token has."""
        if not len(starts):
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        uniq, where, inverse = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        lo, hi = starts[where], ends[where]
        if len(self.keys) and (len(self.keys) + len(uniq) > self.most or self.filled + int((hi - lo).sum()) > self.most_bytes):
            self._clear()
        at = np.searchsorted(self.keys, uniq)
        known = np.zeros(len(uniq), dtype=bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == uniq[inside]
        old = np.flatnonzero(known)
        of = self.at[:, at[old]]
        if not same_spans(data, starts, ends, data, lo[inverse], hi[inverse]) or not same_spans(data, lo[old], hi[old], self.raw, of[2], of[2] + of[3]):
            return self._by_bytes(data, starts, ends)
        if len(old) < len(uniq):
            new = np.flatnonzero(~known)
            a, b = lo[new], hi[new]
            text = data.tobytes()
            made = self.encode([text[x:y] for x, y in zip(a.tolist(), b.tolist())])
            size = np.fromiter(map(len, made), np.int64, len(made))
            held = np.stack([self.used + np.cumsum(size) - size, size, self.filled + np.cumsum(b - a) - (b - a), b - a])
            self.flat = self._with(self.flat, self.used, np.fromiter((i for ids in made for i in ids), np.uint32, int(size.sum())))
            self.raw = self._with(self.raw, self.filled, gather(data, a, b - a))
            self.used, self.filled = self.used + int(size.sum()), self.filled + int((b - a).sum())
            self.keys, self.at = np.insert(self.keys, at[new], uniq[new]), np.insert(self.at, at[new], held, axis=1)
            at = np.searchsorted(self.keys, uniq)
        at = at[inverse]
        return gather(self.flat, self.at[0, at], self.at[1, at]), self.at[1, at]

    def _by_bytes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same without hashes, for a slice in which two tokens share one."""
        text = data.tobytes()
        tokens = [text[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
        distinct = list(dict.fromkeys(tokens))
        made = {t: np.array(ids, np.uint32) for t, ids in zip(distinct, self.encode(distinct))}
        found = [made[t] for t in tokens]
        return np.concatenate(found), np.array([len(x) for x in found], np.int64)


def gather(flat: np.ndarray, ptr: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The pieces ``flat[ptr:ptr + size]`` one after another."""
    out = np.cumsum(size)
    total = int(out[-1]) if len(out) else 0
    return flat[np.arange(total) + np.repeat(ptr - out + size, size)]


def row_bounds(row: np.ndarray, size: np.ndarray, rows: int) -> np.ndarray:
    """Where each row's ids begin among all ids: one more than ``rows``."""
    out = np.zeros(rows + 1, np.int64)
    np.cumsum(np.bincount(row, weights=size, minlength=rows).astype(np.int64), out=out[1:])
    return out


def drawn(rows: DataFrame, most: int, total: int, *key: str) -> DataFrame:
    """At most ``most`` of about ``total`` rows, by a hash of their key columns.

    A plain ordered limit would send that many rows of every partition to one
    task; here a hash threshold first leaves about twice as many in all."""
    h = F.xxhash64(*key)
    near = rows if total <= 2 * most else rows.where(F.pmod(h, F.lit(1 << 40)) < int((1 << 40) * 2 * most / total))
    return near.orderBy(h, *key).limit(most)
