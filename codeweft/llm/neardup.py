"""Near-duplicate documents by MinHash with sequential Bayesian verification.

Documents with equal shingle sets are one set from then on. Sets whose MinHash
signatures agree in a band are candidates. A candidate pair is compared a batch of
the signature at a time and dropped once the posterior chance that its similarity
reaches the threshold falls below the chosen miss probability; survivors are
verified exactly on full shingle sets. Links make components.

Within a bucket of any size pairs are not spelled out. Members are tested against
two pivots of their bucket, and what links is merged. Members of buckets that still
hold several components and that can't link any more are settled by an exact bound:
what a set may share with a set of another component is at most the number of its
shingles that occur in another component at all. What is left is compared in full,
in pairs of blocks of bounded size whose members' pairs never become rows, so that
no candidate is lost whatever the sizes.

Defined cases: a text without words, or null, has no shingles and links with
nothing; fewer words than a shingle are one shingle, the whole sequence; rows that
repeat an id are documents of their own with that id; a null id is never the
smallest unless its component has no other; an empty table
gives an empty result; texts of any length are taken whole; of copies of the same
similarity none is preferred; extra columns are ignored by classes and kept by keep_first.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.llm import words as wd
from codeweft.llm.components import components
from codeweft.llm.salting import salted_join
from codeweft.sources.scratch import Workspace, sheltered

BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
#: Signature entries that are compared at once.
BATCH = 16
#: Posterior chance of a true link below which a comparison stops.
MISS = 1e-7
#: Shingles of a block of sets, about: 4 MB.
BLOCK_SHINGLES = 500_000
#: Bits of the filter that finds the texts whose sets are verified: 4 MB, whatever the input.
FILTER_BITS = 25

_RNG = wd.mix(np.arange(1, 2 * HASHES + 1, dtype=wd.U) * wd.U(0xA24BAED4963EE407))
_MUL = (_RNG[:HASHES] >> wd.U(32)).astype(np.uint32) | np.uint32(1)
_ADD = (_RNG[HASHES:] >> wd.U(32)).astype(np.uint32)


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray | None]:
    """The sorted distinct shingle hashes of every row; None without words."""
    for lo, hi in wd.slices(column):
        data, offsets = wd.utf8(column.slice(lo, hi - lo))
        data = wd.LOWER[data]
        starts, ends = wd.spans(data, offsets)
        h = wd.hashes(data, starts, ends)
        first = wd.per_row(starts, offsets)
        grams = wd.ngrams(h, width)
        for i in range(hi - lo):
            a, b = first[i], first[i + 1]
            if a == b:
                yield None
            elif b - a < width:
                yield wd.ngrams(h[a:b], int(b - a))
            else:
                yield np.unique(grams[a : b - width + 1])


def minhash(grams: np.ndarray) -> np.ndarray:
    """The least of each of HASHES linear permutations of the shingles' 32-bit hashes."""
    x = (grams >> wd.U(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for i in range(0, len(x), 2048):
            np.minimum(out, (x[i : i + 2048, None] * _MUL + _ADD).min(0), out=out)
    return out


def _sketched(width: int, percent: int):
    # A set of n and a different one share n / (n + 1) at most: smaller ones link with no other.
    least = math.ceil(percent / (100 - percent)) if percent < 100 else 1 << 62

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            n, key, sig = [], [], []
            for grams in shingle_sets(b.column(1), width):
                n.append(0 if grams is None else len(grams))
                key.append(None if grams is None else hashlib.blake2b(grams.tobytes(), digest_size=16).digest())
                sig.append(None if grams is None or len(grams) < least else minhash(grams).tobytes())
            cols = [b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "row_key", "n_shingles", "set", "sig"])

    return batches


def _banded(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(bucket, rid)`` for every band of every signature."""
    for b in rows:
        if not b.num_rows:
            continue
        sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(-1, BANDS, ROWS).astype(wd.U)
        with np.errstate(over="ignore"):
            key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=wd.U), sig.shape[:2]) * wd.U(0x9E3779B97F4A7C15)
            for r in range(ROWS):
                key = wd.mix(key + sig[:, :, r])
        rid = np.repeat(b.column(0).to_numpy(), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(rid)], ["bucket", "rid"])


def least_matches(threshold: float, miss: float) -> list[int]:
    """For each number of batches, the matches below which a pair is dropped.

    With a uniform prior, ``m`` matches of ``n`` leave the similarity a
    Beta(m + 1, n - m + 1) posterior, whose tail is a binomial sum.
    """
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        tail, m = 0.0, 0
        while m <= n:
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= miss:
                break
            m += 1
        out.append(m)
    return out


def _survivors(threshold: float, miss: float):
    least = least_matches(threshold, miss)

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            n = b.num_rows
            left, right = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint32).reshape(n, HASHES) for c in ("sa", "sb"))
            alive, matches = np.arange(n), np.zeros(n, np.int64)
            for k, need in enumerate(least):
                at = slice(k * BATCH, (k + 1) * BATCH)
                matches[alive] += (left[alive, at] == right[alive, at]).sum(1)
                alive = alive[matches[alive] >= need]
            yield b.select(["a", "b"]).take(pa.array(alive))

    return batches


def _id_bits(ids: DataFrame) -> np.ndarray:
    """A bitmap, of fixed size, of hashes of document ids."""
    h = F.xxhash64("doc_id")
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - FILTER_BITS}) & 63 as int))")
    word = ids.select(h.alias("h")).select(F.shiftrightunsigned("h", 70 - FILTER_BITS).alias("w"), bit.alias("b"))
    t = word.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bits = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    bits[t.column("w").to_numpy()] = t.column("b").to_numpy()
    return bits.view(np.uint8)


def _sets(documents: DataFrame, reps: DataFrame, rids: DataFrame, ws: Workspace, width: int) -> DataFrame:
    """``(rid, grams)``: the full sets of the given representatives, from their texts."""
    named = ws.put(reps.join(rids, "rid", "left_semi").select("rid", "set", F.col("rep_id").alias("doc_id")))
    bits = documents.sparkSession.sparkContext.broadcast(_id_bits(named.select("doc_id")))

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            at = b.column(0).to_numpy().view(wd.U) >> wd.U(64 - FILTER_BITS)
            here = np.flatnonzero((bits.value[at >> wd.U(3)] >> (at & wd.U(7)).astype(np.uint8)) & 1)
            for lo in range(0, len(here), 200):
                text = b.column(1).take(pa.array(here[lo : lo + 200]))
                sets = [g for g in shingle_sets(text, width) if g is not None]
                key = [hashlib.blake2b(g.tobytes(), digest_size=16).digest() for g in sets]
                grams = pa.array([g.view(np.int64) for g in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), grams], ["set", "grams"])

    every = documents.select(F.xxhash64("doc_id"), "text").mapInArrow(batches, "set binary, grams array<long>")
    # One text may come several times, under ids that share a filter bit or repeat.
    found = every.join(named, "set").groupBy("rid").agg(F.first("grams").alias("grams"))
    out = ws.put(found.select("rid", "grams", F.size("grams").alias("n")))
    bits.destroy()
    return out


def _verified(pairs: DataFrame, reps: DataFrame, sets: DataFrame, ws: Workspace, percent: int, miss: float) -> DataFrame:
    """The links among ``pairs(a, b)``: by sizes, then by signatures a batch at a time, then on full sets."""
    fresh = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    signed = lambda x: reps.select(F.col("rid").alias(x), F.col("sig").alias(f"s{x}"), F.col("n_shingles").alias(f"n{x}"))
    near = fresh.join(signed("a"), "a").join(signed("b"), "b")
    near = near.where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)").select("a", "b", "sa", "sb")
    near = near.mapInArrow(_survivors(percent / 100, miss), "a long, b long")
    # A pivot's set is shuffled once, its partners' once a pair.
    full = lambda x: sets.select(F.col("rid").alias(x), F.col("grams").alias(f"g{x}"))
    both = near.join(full("b"), "b").join(full("a"), "a")
    shared = F.size(F.array_intersect("ga", "gb"))
    counted = both.select("a", "b", shared.alias("s"), F.size("ga").alias("x"), F.size("gb").alias("y"))
    return ws.put(counted.where(f"100 * s >= {percent} * (x + y - s)").select("a", "b"))


def _mixed(members: DataFrame, ws: Workspace) -> DataFrame:
    """Members of the buckets that hold more than one label."""
    mixed = members.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi")
    return ws.put(members.join(mixed.select("bucket"), "bucket", "left_semi"))


def _possible(left: DataFrame, sets: DataFrame, ws: Workspace, percent: int) -> DataFrame:
    """Members that may still link with a member of their bucket in another component.

    ``s`` shingles of a set of ``n`` occur in another component, so no set of ``m``
    shingles there can be more similar than s / (n + m - s), nor than m / n.
    """
    pool = left.select("rid", "label").distinct()
    held = ws.put(sets.join(pool, "rid").select("rid", "label", F.explode("grams").alias("g")))
    crossing = held.groupBy("g").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("g")
    s = held.join(crossing, "g").groupBy("rid").agg(F.count("*").alias("s"))
    sized = left.join(sets.select("rid", "n"), "rid").join(s, "rid", "left").withColumn("s", F.coalesce("s", F.lit(0)))
    least = sized.groupBy("bucket").agg(F.min("n").alias("m"))
    can = sized.join(least, "bucket").where(f"100 * s >= {percent} * (n + greatest(m, n * {percent} / 100) - s)")
    out = _mixed(can.select("bucket", "rid", "label"), ws)
    ws.drop(held)
    return out


def _compared(percent: int):
    """Edges between sets of different labels in a pair of blocks, one for each set and label at most."""

    def run(key, t):
        rid, label, block = (t.column(c).to_numpy() for c in ("rid", "label", "block"))
        grams = pa.concat_arrays(t.column("grams").chunks)
        _, ids = np.unique(grams.flatten().to_numpy(), return_inverse=True)
        size = np.diff(grams.offsets.to_numpy())
        start = np.cumsum(size) - size
        names, counts = np.unique(label, return_counts=True)
        # Of two different labels at least one is not the most frequent one.
        rare = np.flatnonzero(label != names[np.argmax(counts)])
        mark, out = np.zeros(int(ids.max()) + 1, np.int32), []
        same = key[1].as_py() == key[2].as_py()
        for u in rare:
            own = ids[start[u] : start[u] + size[u]]
            mark[own] = 1
            shared = np.add.reduceat(mark[ids], start)
            mark[own] = 0
            near = 100 * shared >= percent * (size[u] + size - shared)
            hit = np.flatnonzero(near & (label != label[u]) & (same | (block != block[u])))
            _, first = np.unique(label[hit], return_index=True)
            out += [(int(rid[u]), int(rid[v])) for v in hit[first]]
        a, b = zip(*out, strict=True) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _rest(left: DataFrame, sets: DataFrame, ws: Workspace, percent: int) -> DataFrame:
    """Links between the members left of buckets that meet, by exact comparison of blocks."""
    pivot = left.groupBy("bucket").agg(F.min("rid").alias("p"))
    meet = left.join(pivot, "bucket").select(F.col("p").alias("a"), F.col("rid").alias("b")).distinct()
    group = ws.put(components(meet, ws))
    members = left.select("rid", "label").distinct().join(group, F.col("rid") == F.col("id")).select("rid", "label", F.col("component").alias("group"))
    sized = ws.put(members.join(sets, "rid"))
    blocks = F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int")
    sized = sized.join(sized.groupBy("group").agg(blocks.alias("blocks")), "group")
    sized = sized.withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = sized.select("group", "rid", "label", "block", "grams", other)
    dealt = dealt.select("group", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "rid", "label", "block", "grams")
    return dealt.groupBy("group", "i", "j").applyInArrow(_compared(percent), "a long, b long")


def link_sets(documents: DataFrame, reps: DataFrame, ws: Workspace, width: int, percent: int, miss: float) -> DataFrame | None:
    """``(id, component)`` of the sets that are linked; None if there are none."""
    banded = reps.where("sig is not null").select("rid", "sig").mapInArrow(_banded, "bucket long, rid long")
    sizes = banded.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    left = ws.put(banded.join(sizes, "bucket").withColumn("label", F.col("rid")))
    if left.isEmpty():
        return None
    sets = _sets(documents, reps, left.select("rid").distinct(), ws, width)
    # The smallest member is a pivot of all bands of a group, the other one differs from band to band.
    other = F.min(F.struct(F.xxhash64("rid", "bucket").alias("h"), "rid"))["rid"]
    pivots = left.groupBy("bucket").agg(F.array(F.min("rid"), other).alias("p")).select("bucket", F.explode(F.array_distinct("p")).alias("pivot"))
    pairs = salted_join(left, pivots, "bucket").where("rid <> pivot").select(F.col("pivot").alias("a"), F.col("rid").alias("b"))
    edges = _verified(pairs, reps, sets, ws, percent, miss)
    labels = None
    if not edges.isEmpty():
        labels = ws.put(components(edges, ws))
        named = left.drop("label").join(labels, F.col("rid") == F.col("id"), "left")
        left = _mixed(named.select("bucket", "rid", F.coalesce("component", "rid").alias("label")), ws)
    left = _possible(left, sets, ws, percent)
    if left.isEmpty():
        return labels
    found = ws.put(_rest(left, sets, ws, percent))
    return labels if found.isEmpty() else components(edges.union(found), ws)


def row_key() -> Column:
    """Tells rows apart that share an id."""
    return F.xxhash64("doc_id", "text")


def classes(documents: DataFrame, width: int = 4, percent: int = 80, miss: float = MISS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, row_key, rep_key`` for every row; ``rep_key`` is the key of the class's first row."""
    spark = documents.sparkSession
    ws = Workspace(spark, "neardup")
    docs = documents.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", "text", row_key())
    rows = ws.put(keyed.mapInArrow(_sketched(width, percent), f"doc_id {kind}, row_key long, n_shingles long, set binary, sig binary"))
    # the row that stands for a set, and later for a class: a null id only where there is no other
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row_key")).alias("rep")
    reps = rows.where("set is not null").groupBy("set").agg(rep, F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
    reps = ws.put(reps.withColumn("rep_id", F.col("rep.doc_id")).withColumn("rid", F.monotonically_increasing_id()))
    labels = link_sets(docs, reps, ws, width, percent, miss)
    named = reps.select("set", "rid", "rep")
    if labels is None:
        member = named.select("set", "rep")
    else:
        named = named.join(labels, named["rid"] == labels["id"], "left").withColumn("label", F.coalesce("component", "rid"))
        named = named.select("set", "rep", "label")
        least = named.groupBy("label").agg(F.min("rep").alias("rep"))
        member = named.drop("rep").join(least, "label").select("set", "rep")
    out = rows.select("doc_id", "row_key", "n_shingles", "set").join(member, "set", "left")
    alone = F.col("set").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("rep.doc_id"))
    first = F.when(alone, F.col("row_key")).otherwise(F.col("rep.row_key"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"), "row_key", first.alias("rep_key"))
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    return out.select("doc_id", "n_shingles", "component_id", kept, "row_key", "rep_key")


def keep_first(documents: DataFrame, width: int = 5, percent: int = 80, miss: float = MISS) -> DataFrame:
    """One row of each class: that of the smallest id, of several the first by key; rows without words are classes of their own.

    Rows that repeat both id and text are one key; one of them stays.
    """
    docs, restored = sheltered(documents, ("doc_id", "text"))
    ws = Workspace(documents.sparkSession, "keep")
    found = ws.put(classes(docs, width, percent, miss).select("row_key", "rep_key", "n_shingles"))
    gone = found.where("row_key <> rep_key").select(F.col("row_key").alias("_gone")).distinct()
    out = docs.withColumn("_key", row_key())
    out = out.join(gone, out["_key"] == gone["_gone"], "left_anti")
    repeated = found.where("row_key = rep_key and n_shingles > 0").groupBy("row_key").agg(F.count("*").alias("n")).where("n > 1")
    repeated = ws.put(repeated.select(F.col("row_key").alias("_key")))
    if not repeated.isEmpty():
        again = out.join(repeated, "_key", "left_semi").groupBy("_key").agg(F.first(F.struct(*docs.columns)).alias("row"))
        out = out.join(repeated, "_key", "left_anti").select(*docs.columns).union(again.select("row.*"))
    return restored(out)


def op8_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("row_key", "rep_key")


_WORDS8 = "list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"

OP8_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS8} AS w FROM documents WHERE text IS NOT NULL),
s AS (
  SELECT DISTINCT doc_id, w[i:i + 3] AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM w WHERE len(w) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (
  SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.i >= 80 * (x.n + y.n - p.i)
),
l AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT l.b AS id, r.c FROM r JOIN l ON l.a = r.id),
m AS (SELECT id, min(c) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN m ON m.id = d.doc_id
"""
