"""Near-duplicate documents by HyperMinHash, banding and full verification.

A document's set holds the 64-bit hashes of its distinct 5-word shingles. Its
sketch has ``BUCKETS`` registers: a bucket has a hash of its own, and its
register keeps the leading-zero count and the next ten bits of the least value
over the set (16 bits in all). Were shingles dealt out to buckets by one hash,
short texts would leave most buckets empty, and their bands would rest on one
shingle, such as a licence line's. Documents with equal sets are one class from the
start, through a fingerprint of the set. Bands of four registers give
candidates; the collision-corrected estimate drops those that five standard
deviations cannot bring to the threshold; the rest is confirmed on full sets.

Candidates of a band bucket are tested against one hub of the bucket, not
against each other; links contract into components. Members of buckets that
still span several components, such as texts around one licence, meet once more
by their rarest shingles: in an order of all shingles of these members, rarest
first, all that two sets have in common lies from their least common shingle on.
So a pair at the threshold meets under a shingle from which on both still hold
the overlap that their sizes ask for, and only such pairs are tested. What many
unlike texts share comes last in that order; unless it is nearly enough for the
threshold by itself, pairs of them are ruled out, while no pair at the threshold
is given up. Under each shingle hubs are tested, those of the smaller components
first and eight times as many a round, until each pair is tested or joined. A
round's components are found among the components that its links join, not among
all links so far.

For confirmation a hub's text is sent once for each ``CHUNK`` texts that it
meets, ahead of them in one sorted stream, so a hub of many texts is spread
over many tasks and no text is repeated for each pair. Sets confirmed at J >= 0.7 share no band with probability
(1 - 0.7**4) ** 48 < 2e-6.

Defined results: null, empty or blank texts have an empty set, link with
nothing and are kept; texts of any length are read whole; equal texts link
through their class; rows that repeat an id are one document; rows with a null
id link with nothing, keep a null component and are kept; an empty table gives
an empty table; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import U64, Scratch, mix, slices, words
from .graphs import components, marked, only_ids

WIDTH = 5
BANDS, BAND = 48, 4
BUCKETS = BANDS * BAND
MANTISSA = 10
#: Hubs a bucket tests in the second round (one in the first), and how that grows.
HUBS, MORE = 32, 8
#: Texts that meet a hub in one group.
CHUNK = 512

_WEIGHTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], U64)

_FACTORS = (mix(np.arange(1000, 1000 + BUCKETS, dtype=U64)) >> U64(32)).astype(np.uint32) | np.uint32(1)


def shingle_sets(s) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row of a slice."""
    h, _, _, row = words(s)
    n = len(s.rows)
    at = np.searchsorted(row, np.arange(n + 1)).tolist()
    if len(h) >= WIDTH:
        total = len(h) - WIDTH + 1
        full = h[:total] * _WEIGHTS[0]
        for j in range(1, WIDTH):
            full = full + h[j : j + total] * _WEIGHTS[j]
        full = mix(full)
    out = []
    for a, b in zip(at, at[1:]):
        if b - a >= WIDTH:
            out.append(np.unique(full[a : b - WIDTH + 1]))
        elif b > a:
            short = (h[a:b] * _WEIGHTS[: b - a]).sum(dtype=U64) + U64(b - a)
            out.append(mix(np.array([short], U64)))
        else:
            out.append(np.empty(0, U64))
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """(rows, BUCKETS) sketches: 0 throughout for an empty set, else for each
    bucket the zeros and mantissa of the least value of the bucket's hash."""
    least = np.zeros((len(sets), BUCKETS), np.uint32)
    for k, x in enumerate(sets):
        folded = (x ^ (x >> U64(32))).astype(np.uint32)
        for a in range(0, len(x), 1024):
            values = folded[a : a + 1024, None] * _FACTORS
            values ^= values >> np.uint32(15)
            low = values.min(axis=0)
            least[k] = np.minimum(least[k], low) if a else low
    filled = np.array([len(x) > 0 for x in sets], bool)
    value = np.maximum(least, np.uint32(1)).astype(np.int64)
    zeros = 32 - np.frexp(value.astype(np.float64))[1]
    mantissa = ((value << (zeros + 1)) & 0xFFFFFFFF) >> (32 - MANTISSA)
    return np.where(filled[:, None], ((zeros + 1) << MANTISSA) | mantissa, 0).astype("<u2")


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard of register rows, and its standard deviation.

    Of the buckets that either side fills, equal registers count; those expected
    to be equal by chance are taken off (0.1699 * 2**-mantissa of them, times the
    ratio term of the sizes, as for unrelated sets)."""
    used = ((a != 0) | (b != 0)).sum(axis=1)
    same = ((a == b) & (a != 0)).sum(axis=1)
    n, m = np.maximum(n, 1).astype(float), np.maximum(m, 1).astype(float)
    ratio = 4 * (n / m) / (1 + n / m) ** 2
    chance = 0.169919487159739 * 2.0**-MANTISSA * ratio * used
    j = np.clip((same - chance) / np.maximum(used, 1), 0, 1)
    return j, np.sqrt(0.25 / np.maximum(used, 1))


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n (set size), two fingerprints of the set, registers."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        for batch in batches:
            for s in slices(batch.column(1)):
                sets = shingle_sets(s)
                regs = registers(sets)
                one = np.array([x.sum(dtype=U64) for x in sets], U64).view(np.int64)
                two = np.array([mix(x + U64(0x2545F4914F6CDD1D)).sum(dtype=U64) for x in sets], U64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(s.rows.start, len(s.rows)), pa.array([len(x) for x in sets], pa.int64()), pa.array(one), pa.array(two), pa.array([r.tobytes() for r in regs], pa.binary())],
                    names=["id", "n", "f1", "f2", "regs"],
                )

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n bigint, f1 bigint, f2 bigint, regs binary")


def bands(reps: DataFrame) -> DataFrame:
    """(key, id) for each band with a filled register."""
    kind = dict(reps.dtypes)["id"]

    def run(batches):
        salt = mix(np.arange(1, BANDS + 1, dtype=U64))
        for batch in batches:
            if not batch.num_rows:
                continue
            regs = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2").reshape(-1, BANDS, BAND)
            packed = np.ascontiguousarray(regs).view("<u8").reshape(-1, BANDS)
            where, band = np.nonzero(packed)
            key = mix(mix(packed[where, band]) ^ salt[band]).view(np.int64)
            for k in range(0, len(key), 100_000):
                part = slice(k, k + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(key[part]), batch.column(0).take(pa.array(where[part]))], names=["key", "id"])

    return reps.select("id", "regs").mapInArrow(run, f"key bigint, id {kind}")


def _likely(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose estimate may reach the threshold."""
    kind = dict(pairs.dtypes)["a"]
    side = only_ids(reps, "id", pairs.select("a").union(pairs.select("b")))
    joined = pairs.join(side.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("regs").alias("ra")), "a")
    joined = joined.join(side.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("regs").alias("rb")), "b")

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ra, rb = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u2").reshape(-1, BUCKETS) for k in (4, 5))
            j, sd = estimate(ra, rb, batch.column(2).to_numpy(), batch.column(3).to_numpy())
            keep = np.flatnonzero(j + 5 * sd >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(keep)) for k in (0, 1)], names=["a", "b"])

    return joined.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(run, f"a {kind}, b {kind}")


def _confirmed(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Pairs with 100 * |intersection| >= percent * |union| on full sets.
    ``docs(id, text)`` has one row for each id."""
    kind = dict(pairs.dtypes)["a"]
    side = only_ids(docs, "id", pairs.select("a").union(pairs.select("b")))
    many = pairs.groupBy("b").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    dealt = pairs.join(many, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("chunks")).alias("chunk"))
    hubs = dealt.select("b", "chunk").distinct().join(side.select(F.col("id").alias("b"), "text"), "b").select("b", "chunk", F.lit(0).alias("turn"), F.col("b").alias("a"), "text")
    met = dealt.join(side.select(F.col("id").alias("a"), "text"), "a").select("b", "chunk", F.lit(1).alias("turn"), "a", "text")

    def run(batches):
        hub = np.empty(0, U64)
        for batch in batches:
            turn, keep = batch.column(2).to_pylist(), []
            for s in slices(batch.column(4)):
                for k, x in zip(s.rows, shingle_sets(s)):
                    if not turn[k]:
                        hub = x
                        continue
                    few, most = sorted((len(x), len(hub)))
                    if 100 * few >= percent * most:
                        common = few + most - len(np.unique(np.concatenate([x, hub])))
                        if 100 * common >= percent * (few + most - common):
                            keep.append(k)
            keep = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(3).take(keep), batch.column(0).take(keep)], names=["a", "b"])

    key = ["b", "chunk"]
    return hubs.union(met).repartition(*key).sortWithinPartitions(*key, "turn").mapInArrow(run, f"a {kind}, b {kind}")


def _rarest(docs: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(key, id, n, spare): shingles of each text of ``docs(id, text)``, rarest
    first, as far as a set at the threshold may first be met; ``spare`` counts
    those from this one on. Shingles of one text only are left out."""
    kind = dict(docs.dtypes)["id"]

    def run(batches):
        for batch in batches:
            for s in slices(batch.column(1)):
                sets = shingle_sets(s)
                size = np.array([len(x) for x in sets])
                f = np.array([x.sum(dtype=U64) for x in sets], U64).view(np.int64)
                x = np.concatenate(sets).view(np.int64)
                row = np.repeat(np.arange(len(sets)), size)
                for k in range(0, len(x), 100_000):
                    part = row[k : k + 100_000]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(part + s.rows.start)), pa.array(size[part]), pa.array(f[part]), pa.array(x[k : k + 100_000])], names=["id", "n", "f", "key"])

    sets = scratch.keep(docs.mapInArrow(run, f"id {kind}, n bigint, f bigint, key bigint"), "sets")
    met = sets.join(sets.groupBy("key").agg(F.count("*").alias("df")).where("df > 1"), "key")
    own = W.partitionBy("id", "n", "f")
    ranked = met.withColumn("spare", F.count("*").over(own) + 1 - F.row_number().over(own.orderBy("df", "key")))
    return ranked.where(100 * F.col("spare") >= percent * F.col("n")).select("key", "id", "n", "spare")


def link(docs: DataFrame, percent: int = 70, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "minhash")
    sk = scratch.keep(sketches(docs, id_col, text_col), "sketches")
    named = sk.where("n > 0 and id is not null")
    classes = scratch.keep(named.groupBy("f1", "f2", "n").agg(F.min("id").alias("rep")), "classes")
    reps = named.join(classes.select(F.col("rep").alias("id"), "f1", "f2", "n"), ["id", "f1", "f2", "n"], "left_semi").dropDuplicates(["id", "f1", "f2", "n"])
    reps = scratch.keep(reps.select("id", "n", "regs"), "reps")
    text_of = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def tested(pairs: DataFrame) -> DataFrame:
        pairs = scratch.keep(pairs, "pairs")
        likely = scratch.keep(_likely(pairs, reps, percent / 100), "likely")
        found = scratch.keep(_confirmed(likely, text_of, percent), "links")
        scratch.drop(pairs, likely)
        return found

    member = bands(reps)
    hubs = member.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("m")).where("m > 1").select("key", "hub")
    first = tested(member.join(hubs, "key").where("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct())
    comp = scratch.keep(components(first, scratch).select("node", "component"), "components")
    named_comp = comp.select(F.col("node").alias("id"), "component")
    met = member.join(hubs, "key", "left_semi").join(named_comp, "id", "left").select("key", "id", F.coalesce("component", "id").alias("comp"))
    shared = scratch.keep(_spanning(met, hubs).select("id", "comp").distinct(), "shared")
    rare = _rarest(only_ids(text_of, "id", shared.select("id")).dropDuplicates().join(shared.select("id"), "id").select("id", "text"), percent, scratch)
    open_ = scratch.keep(_spanning(scratch.keep(rare, "rarest").join(shared, "id")), "open")
    width = HUBS
    while open_.take(1):
        # members of buckets that span components, the smaller components first
        sizes = open_.groupBy("key", "comp").agg(F.count("*").alias("size"))
        ranked = open_.join(sizes, ["key", "comp"]).withColumn("rank", F.row_number().over(W.partitionBy("key").orderBy("size", "id")))
        hubs = scratch.keep(ranked.where(F.col("rank") <= width).select("key", F.col("id").alias("hub"), F.col("comp").alias("hub_comp"), F.col("n").alias("hub_n"), F.col("spare").alias("hub_spare")), "hubs")
        # what both hold from here on may be the overlap that the threshold asks for
        may = F.expr(f"comp <> hub_comp and {100 + percent} * least(spare, hub_spare) >= {percent} * (n + hub_n)")
        pairs = open_.join(hubs, "key").where(may).select(F.greatest("id", "hub").alias("a"), F.least("id", "hub").alias("b")).distinct()
        found = tested(pairs)
        of = open_.select("id", "comp").distinct()
        ends = found.join(of.select(F.col("id").alias("a"), F.col("comp").alias("ca")), "a").join(of.select(F.col("id").alias("b"), F.col("comp").alias("cb")), "b")
        moved = scratch.keep(components(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b")), scratch).select("node", "component"), "moved")
        # components that no link has reached before are their own single nodes
        after = comp.withColumnRenamed("component", "was").join(moved.withColumnRenamed("node", "was"), "was", "left").select("node", F.coalesce("component", "was").alias("component"))
        after = scratch.keep(after.union(moved.join(comp.select("node"), "node", "left_anti")), "components")
        now = open_.join(moved.withColumnRenamed("node", "comp"), "comp", "left").select("key", "id", "n", "spare", F.coalesce("component", "comp").alias("comp"))
        left = scratch.keep(_spanning(now, hubs), "open")
        scratch.drop(open_, hubs, comp, found, moved)
        open_, comp, width = left, after, MORE * width
    whole = sk.join(classes, ["f1", "f2", "n"], "left").join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left")
    root = F.when((F.col("n") > 0), F.coalesce("component", "rep", "id")).otherwise(F.col("id"))
    return whole.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), root.alias("component_id"), F.coalesce(F.col("id") == root, F.lit(True)).alias("kept"))


def dedup(docs: DataFrame, percent: int = 70, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group: the one of the least id. All
    columns as they are; of rows that repeat an id, the first in text order stays."""
    scratch = Scratch(docs.sparkSession, "minhash")
    linked = scratch.keep(link(docs, percent, id_col, text_col, scratch).select(F.col(id_col).alias("__id"), "kept"), "linked")
    doubt = linked.where("__id is not null").groupBy("__id").agg(F.count("*").alias("__rows"), F.min("kept").alias("__kept")).where("__rows > 1 or not __kept")
    doubt = scratch.keep(doubt, "doubt")
    near = marked(docs.withColumn("__id", F.col(id_col)), "__id", doubt.select("__id"))
    joined = near.where("__maybe").join(doubt, "__id", "left")
    names = docs.columns
    repeated = joined.where("__kept and __rows > 1").withColumn("__first", F.row_number().over(W.partitionBy("__id").orderBy(text_col, *[F.xxhash64(n) for n in names]))).where("__first = 1")
    parts = [near.where("not __maybe"), joined.where("__rows is null"), repeated]
    return parts[0].select(*names).union(parts[1].select(*names)).union(parts[2].select(*names))


def _spanning(member: DataFrame, tested: DataFrame | None = None) -> DataFrame:
    """Members that are no tested hubs, in buckets where they span components."""
    rest = member if tested is None else member.join(tested.select("key", F.col("hub").alias("id")), ["key", "id"], "left_anti")
    wide = rest.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    return rest.join(wide, "key", "left_semi")
