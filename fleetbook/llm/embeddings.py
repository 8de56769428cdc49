"""Near-duplicate vectors by sorted projection passes.

Equal vectors are one class.  Every pass orders the classes lexicographically by ``BITS``
concatenated random-hyperplane hashes and compares each vector, in double precision, with the
next ``WINDOW`` in that order.  Where the outer half of a window still holds links the window
is doubled, until it does not: dense groups are compared in full, whatever their size.  The order
of a pass is cut into blocks of ``BLOCK`` rows that are read with the rows behind them; windows
that go further are continued over whole blocks.  Pairs of all passes are united; links carry the
class sizes.  The number of passes follows the counted vectors (``passes_for``).

Defined cases: vectors that are null, empty, zero or hold a null or non-finite component link
with nothing; vectors of different lengths do not link; a null id is a row of its own with null
component; repeated rows are vectors of their own that share an id; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetbook.llm.common import stored
from fleetbook.llm.graph import components

#: Predicted recall of lone pairs at COSINE; sets the number of passes from the number of vectors.
RECALL = 0.995
LEAST_PASSES = 24
BITS = 48
WINDOW = 64
#: Rows of a pass that one task holds at a time (an eighth more are read behind them).
BLOCK = 2048
COSINE = 0.9
SEED = 7_0001
ROWS_AT_ONCE = 512


def hyperplanes(dim: int, passes: int) -> np.ndarray:
    return np.random.default_rng(SEED + dim).normal(size=(dim, passes * BITS))


def predicted_recall(rows: int, passes: int) -> float:
    """Chance that a lone pair at ``COSINE`` among ``rows`` evenly spread vectors meets in a pass:
    its first bits have to agree until about WINDOW rows are left."""
    agree = (1 - math.acos(COSINE) / math.pi) ** max(math.log2(max(rows, 1) / WINDOW), 0.0)
    return 1 - (1 - agree) ** passes


def passes_for(rows: int) -> int:
    """Passes with a predicted recall of at least ``RECALL``; grows about as rows ** 0.22."""
    passes = LEAST_PASSES
    while predicted_recall(rows, passes) < RECALL:
        passes += 1
    return passes


def unit_vectors(x: np.ndarray) -> np.ndarray:
    x = x.astype(float)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def by_length(batch):
    """(dim, positions, matrix) of the vectors of each length."""
    lists = batch.column("embedding").to_pylist()
    lengths = np.array([len(v) for v in lists])
    for dim in np.unique(lengths):
        at = np.flatnonzero(lengths == dim)
        yield int(dim), at, np.array([lists[i] for i in at], dtype=float)


def signatures(classes: DataFrame, passes: int) -> DataFrame:
    """(dim, pass, sig, cls): each class once per pass."""
    def run(batches):
        planes = {}
        for batch in batches:
            ids = batch.column("cls").to_numpy(zero_copy_only=False)
            for dim, at, x in by_length(batch):
                if dim not in planes:
                    planes = {dim: hyperplanes(dim, passes)}
                bits = (unit_vectors(x) @ planes[dim] > 0).reshape(len(at), passes, BITS)
                sig = bits.astype(np.int64) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                for p in range(passes):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), dim, np.int32)), pa.array(np.full(len(at), p, np.int32)), pa.array(sig[:, p]),
                         pa.array(ids[at])], names=["dim", "pass", "sig", "cls"])
    return classes.select("cls", "embedding").mapInArrow(run, "dim int, pass int, sig long, cls long")


def packed(classes: DataFrame) -> DataFrame:
    """(cls, raw): the vector's bytes, in single precision where the column is."""
    kind = "<f4" if classes.schema["embedding"].dataType.elementType == T.FloatType() else "<f8"

    def run(batches):
        for batch in batches:
            ids = batch.column("cls").to_numpy(zero_copy_only=False)
            for _, at, x in by_length(batch):
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array([r.tobytes() for r in x.astype(kind)], pa.binary())],
                                                 names=["cls", "raw"])
    return classes.select("cls", "embedding").mapInArrow(run, "cls long, raw binary")


def unpacked(raw: bytes, dim: int, size: int) -> np.ndarray:
    """Unit vectors of ``size`` vectors' bytes."""
    return unit_vectors(np.frombuffer(raw, dtype="<f4" if len(raw) == 4 * dim * size else "<f8").reshape(size, dim))


def placed(classes: DataFrame, passes: int, block: int) -> DataFrame:
    """(dim, pass, cls, idx, block_no, total): place of each class in the order of a pass, which goes
    through all partitions, and the length of the pass."""
    rows = signatures(classes, passes)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "dim", "pass", "sig", "cls").sortWithinPartitions("dim", "pass", "sig", "cls")

    def run(batches):
        part, key, upto = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            dim, number = (batch.column(c).to_numpy() for c in ("dim", "pass"))
            pos = np.zeros(len(dim), np.int64)
            cuts = np.flatnonzero((np.diff(dim) != 0) | (np.diff(number) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(dim)]):
                if a < b:
                    if key != (dim[a], number[a]):
                        key, upto = (dim[a], number[a]), 0
                    pos[a:b] = upto + np.arange(b - a)
                    upto += b - a
            yield pa.RecordBatch.from_arrays([batch.column("dim"), batch.column("pass"), batch.column("cls"),
                                              pa.array(np.full(len(dim), part, np.int32)), pa.array(pos)],
                                             names=["dim", "pass", "cls", "part", "pos"])

    # written once, so that places cannot change between reads
    rows = stored(ordered.mapInArrow(run, "dim int, pass int, cls long, part int, pos long"), "vector-order")
    one = Window.partitionBy("dim", "pass")
    before = F.sum("cnt").over(one.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    start = rows.groupBy("dim", "pass", "part").agg(F.count("*").alias("cnt")) \
        .select("dim", "pass", "part", F.coalesce(before, F.lit(0)).alias("start"), F.sum("cnt").over(one).alias("total"))
    rows = rows.join(start, ["dim", "pass", "part"]).withColumn("idx", F.col("start") + F.col("pos"))
    return stored(rows.select("dim", "pass", "cls", "idx", F.floor(F.col("idx") / block).alias("block_no"), "total"), "vector-places")


def window_pairs(ids: np.ndarray, z: np.ndarray, own: int, whole: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """Linked pairs of the first ``own`` unit vectors of a run in order with those after them:
    windows of WINDOW, doubled while their outer half holds links.  The last value tells whether
    a window goes past the run, which is ``whole`` if nothing follows it."""
    left, right, beyond = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], False
    for start in range(0, own, ROWS_AT_ONCE):
        rows = np.arange(start, min(start + ROWS_AT_ONCE, own))
        low, high = 1, WINDOW
        while len(rows):
            beyond |= not whole and int(rows[-1]) + high >= len(z)
            far = min(len(z), int(rows[-1]) + high + 1)
            near = int(rows[0]) + low
            if near >= far:
                break
            hit = z[rows] @ z[near:far].T >= COSINE
            gap = np.arange(near, far)[None, :] - rows[:, None]
            hit &= (gap >= low) & (gap <= high)
            i, j = np.nonzero(hit)
            left.append(ids[rows[i]])
            right.append(ids[near + j])
            outer = (hit & (gap > (low + high) // 2)).any(axis=1)
            rows = rows[outer]
            low, high = high + 1, 2 * high
    return np.concatenate(left), np.concatenate(right), beyond


def link_batches(key: tuple, a: np.ndarray, b: np.ndarray):
    """Record batches (dim, pass, x, gap, a, b), a > b."""
    names = ["dim", "pass", "x", "gap", "a", "b"]
    kinds = (np.int32, np.int32, np.int64, np.int64)
    for s in range(0, len(a), 1 << 16):
        x, y = a[s:s + (1 << 16)], b[s:s + (1 << 16)]
        yield pa.RecordBatch.from_arrays([*(pa.array(np.full(len(x), v, k)) for v, k in zip(key, kinds)),
                                          pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], names=names)


LINKS = "dim int, pass int, x long, gap long, a long, b long"


def gathered(rows: DataFrame, vectors: DataFrame, parts: int) -> DataFrame:
    """(dim, pass, block, idx, total, cls, raw) with the rows of a block together and in order."""
    return rows.join(vectors, "cls").select("dim", "pass", "block", "idx", "total", "cls", "raw") \
        .repartition(parts, "dim", "pass", "block").sortWithinPartitions("dim", "pass", "block", "idx")


def runs(batches):
    """(key, total, ids, raw) of each block of ``gathered``: key is (dim, pass, block)."""
    key, total, ids, raw = None, 0, [], []
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("dim", "pass", "block", "total", "cls", "raw"))
        for d, p, n, t, i, v in zip(*columns):
            if key != (d, p, n):
                if ids:
                    yield key, total, ids, raw
                key, total, ids, raw = (d, p, n), t, [], []
            ids.append(i)
            raw.append(v)
    if ids:
        yield key, total, ids, raw


def block_pairs(pairs: DataFrame, places: DataFrame, vectors: DataFrame, parts: int) -> DataFrame:
    """Links between the blocks x and x + gap of ``pairs`` (dim, pass, x, gap), stored."""
    wanted = pairs.select("dim", "pass", F.explode(F.array("x", F.col("x") + F.col("gap"))).alias("block")).distinct()
    rows = gathered(places.withColumnRenamed("block_no", "block").join(wanted, ["dim", "pass", "block"], "left_semi"), vectors, parts)

    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())

    def pack(batches):
        for key, _, ids, raw in runs(batches):
            values = (*key, np.array(ids, np.int64).tobytes(), b"".join(raw))
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], names=["dim", "pass", "block", "ids", "raw"])

    def compare(batches):
        for batch in batches:
            for r in batch.to_pylist():
                a, b = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["ids2"], np.int64)
                i, j = np.nonzero(unpacked(r["raw"], r["dim"], len(a)) @ unpacked(r["raw2"], r["dim"], len(b)).T >= COSINE)
                yield from link_batches((r["dim"], r["pass"], r["x"], r["gap"]), a[i], b[j])

    blocks = stored(rows.mapInArrow(pack, "dim int, pass int, block long, ids binary, raw binary"), "vector-blocks")
    both = pairs.join(blocks.withColumnRenamed("block", "x"), ["dim", "pass", "x"]).withColumn("block", F.col("x") + F.col("gap")) \
        .join(blocks.withColumnRenamed("ids", "ids2").withColumnRenamed("raw", "raw2"), ["dim", "pass", "block"]).drop("block")
    return stored(both.repartition(parts, "dim", "pass", "x", "gap").mapInArrow(compare, LINKS), "vector-far")


def linked_classes(classes: DataFrame, block: int = BLOCK) -> DataFrame:
    """Distinct linked pairs (a, b), a > b, of classes (cls, embedding)."""
    halo = max(block // 8, WINDOW)
    if block < WINDOW:
        raise ValueError("a block holds a window at least")
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    places = placed(classes, passes_for(classes.count()), block)
    vectors = packed(classes)
    # a block and the rows that follow it: those at the start of the next block go to both
    behind = (F.col("idx") % block < halo) & (F.col("block_no") > 0)
    to = F.when(behind, F.array("block_no", F.col("block_no") - 1)).otherwise(F.array("block_no"))

    def run(batches):
        for (dim, number, no), total, ids, raw in runs(batches):
            own = min(block, total - no * block)
            a, b, beyond = window_pairs(np.array(ids, np.int64), unpacked(b"".join(raw), dim, len(ids)), own,
                                        no * block + len(ids) >= total)
            yield from link_batches((dim, number, no, 0), a, b)
            if beyond:          # a row without a pair
                yield pa.RecordBatch.from_pylist([{"dim": dim, "pass": number, "x": no, "gap": 0}], schema=out)

    out = pa.schema([("dim", pa.int32()), ("pass", pa.int32()), ("x", pa.int64()), ("gap", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
    near = stored(gathered(places.withColumn("block", F.explode(to)), vectors, parts).mapInArrow(run, LINKS), "vector-near")
    links = near.filter(F.col("a").isNotNull()).select("a", "b").distinct()
    # blocks whose windows go further: whole blocks at distances 1, 2, 3-4, 5-8, ... of them, while
    # the outer half of these distances holds links
    going, low, high = stored(near.filter(F.col("a").isNull()).select("dim", "pass", "x"), "vector-going"), 1, 1
    last = places.groupBy("dim", "pass").agg(F.max("block_no").alias("last"))
    while going.count():
        reach = F.least(F.col("last") - F.col("x"), F.lit(high))
        pairs = going.join(last, ["dim", "pass"]).filter(F.col("last") - F.col("x") >= low) \
            .select("dim", "pass", "x", F.explode(F.sequence(F.lit(low).cast("long"), reach.cast("long"))).alias("gap"))
        far = block_pairs(stored(pairs, "vector-pairs"), places, vectors, parts)
        links = links.unionByName(far.select("a", "b"))
        going = stored(far.filter(F.col("gap") > (low + high - 1) // 2).select("dim", "pass", "x").distinct(), "vector-going")
        low, high = high + 1, 2 * high
    return links.distinct()


def near_vectors(vectors: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding): vec_id, n_links, component_id."""
    ok = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.col("vec_id").isNotNull() \
        & ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) \
        & F.exists("embedding", lambda v: v != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").withColumn("ok", F.coalesce(ok, F.lit(False)))
    # a class is named by a hash of its vector; equal vectors, one class (ids of repeated rows may clash)
    name = F.xxhash64(F.to_json(F.struct("embedding")))
    rows = stored(rows.withColumn("name", F.when(F.col("ok"), name)), "vectors")
    classes = stored(rows.filter("ok").groupBy("name").agg(F.min("vec_id").alias("low"), F.count("*").alias("cnt"),
                                                           F.first("embedding").alias("embedding")), "vector-classes")
    links = stored(linked_classes(classes.withColumnRenamed("name", "cls"), block), "vector-links")
    size = classes.select(F.col("name").alias("b"), "cnt")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = stored(both.join(size, "b").groupBy("a").agg(F.sum("cnt").alias("others")), "vector-others")
    comp = components(links)
    low = classes.select("name", "low", "cnt").join(comp, F.col("name") == F.col("node"), "left") \
        .withColumn("component", F.coalesce("component", "name"))
    lowest = low.groupBy("component").agg(F.min("low").alias("component_id"))
    told = stored(low.join(lowest, "component").join(others, F.col("name") == F.col("a"), "left")
                  .select(F.col("name").alias("class"), "component_id",
                          (F.col("cnt") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")), "vector-told")
    out = rows.join(told, F.col("name") == F.col("class"), "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      F.coalesce("component_id", "vec_id").alias("component_id"))
