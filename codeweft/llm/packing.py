"""Sequence packing by patterns fitted with non-negative least squares.

Token pieces of at most ``capacity`` tokens are counted by length; the histogram
has ``capacity`` bins however many pieces there are. Patterns are the pairs and
triples of lengths that fill a sequence exactly. Non-negative least squares fits
their repeat counts to the histogram; rounded down, they are taken as they are,
and the pieces that are left are packed by best fit, longest first. Pieces find
their place by their rank among the pieces of their length.

The fit runs on the driver over the histogram alone: at most ``capacity`` patterns are
in use at once, so its time and memory have bounds that the input doesn't move. The
table of places has a row for each length of each pattern in use and for what is left
over; it is broadcast up to ``BROADCAST_PLACES`` rows and joined beyond.

Defined cases: null and empty texts are a single piece of the end token alone; texts
of any length are encoded whole and cut into pieces; pieces of one length that tie
are placed in the order of their tasks; patterns that gain equally are tried in the
order of their lengths; repeated rows and ids are packed one by one; an empty table
gives an empty result; other columns than doc_id and text, whatever their names, are
ignored.
"""

from __future__ import annotations

import base64
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeweft.sources.scratch import Workspace

CAPACITY = 1024
END = 2
_ROWS = 50  # bits of a rank
#: Rows of the table of places up to which it is broadcast: 40 MB.
BROADCAST_PLACES = 1_000_000
#: Neighbouring ranks that meet places together beyond that.
STRETCH = 64

_TOKENIZERS: dict = {}


def encoder(path: str | None = None):
    """Text to the ids that the ``tokenizers`` file at ``path`` gives, without special tokens added.

    A byte-level BPE file with a ``.tiktoken`` file of the same name beside it is
    encoded from those ranks, which gives equal ids several times faster; texts
    that spell a special token out, or are extremely long, take the first library.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    if path not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        ranks = path.removesuffix(".json") + ".tiktoken"
        slow = lambda text: whole.encode(text, add_special_tokens=False).ids
        if os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
            spelled = [t.content for t in whole.get_added_tokens_decoder().values()]
            _TOKENIZERS[path] = lambda text: (
                slow(text) if len(text) > 500_000 or any(s in text for s in spelled) else fast.encode_ordinary(text)
            )
        else:
            _TOKENIZERS[path] = slow
    return _TOKENIZERS[path]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces of ``n`` tokens; the first one takes what doesn't divide."""
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """All pairs and triples of the given lengths that sum to the capacity; a pair has 0 as its first length."""
    have = np.zeros(capacity + 1, bool)
    have[lengths] = True
    out = []
    for i in [0, *lengths[3 * lengths <= capacity]]:
        j = lengths[(lengths >= i) & (2 * lengths <= capacity - i)]
        j = j[have[capacity - i - j]]
        out.append(np.stack([np.full(len(j), i), j, capacity - i - j], 1))
    return np.concatenate(out).astype(np.int64)


def fit(pats: np.ndarray, counts: np.ndarray, weight: float = 1.0, rounds: int = 40, width: int = 64) -> np.ndarray:
    """Non-negative least squares of repeat counts: an active-set method that admits columns by the block."""
    n = len(counts)
    x = np.zeros(len(pats))
    scale = (np.arange(n) / max(n - 1, 1)) ** weight  # a long piece left over costs more than a short one
    root = np.sqrt(scale)
    active, a, gram = np.zeros(0, np.int64), np.zeros((n, 0)), np.zeros((0, 0))

    def columns(which: np.ndarray) -> np.ndarray:
        out = np.zeros((n, len(which)))
        for c in range(3):
            np.add.at(out, (pats[which, c], np.arange(len(which))), 1.0)
        out[0] = 0
        return out * root[:, None]

    for _ in range(rounds):
        rest = (counts * root - a @ x[active]) * root
        rest[0] = 0
        gain = rest[pats].sum(1)
        gain[active] = 0
        order = np.argsort(-gain, kind="stable")[: 40 * width]
        order = order[gain[order] > 1e-6 * max(1.0, float(counts.max()))]
        if not len(order):
            break
        taken, fresh = set(), []
        for p in order:  # columns of one block share no length, so they don't compete
            own = {int(v) for v in pats[p] if v}
            if not own & taken:
                taken |= own
                fresh.append(p)
                if len(fresh) == width:
                    break
        b = columns(np.array(fresh, np.int64))
        both = a.T @ b
        gram = np.block([[gram, both], [both.T, b.T @ b]])
        a = np.concatenate([a, b], 1)
        active = np.concatenate([active, np.array(fresh, np.int64)])
        while len(active):
            z = np.linalg.solve(gram + 1e-7 * np.eye(len(active)), a.T @ (counts * root))
            x[:] = 0
            if (z > 0).all():
                x[active] = z
                break
            keep = z > 0  # those of no use go together; a later round may admit them again
            active, a, gram = active[keep], a[:, keep], gram[np.ix_(keep, keep)]
    return x


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, on the histogram: ``(lengths of a sequence, repeats)``."""
    space: dict[int, list[list]] = {}
    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            room = next((s for s in range(length, capacity) if space.get(s)), None)
            if room is None:
                each = min(capacity // length, n)
                new, repeat = (length,) * each, n // each
            else:
                old = space[room][-1]
                each = min(room // length, n)
                repeat = min(old[1], n // each)
                new = old[0] + (length,) * each
                old[1] -= repeat
                if not old[1]:
                    space[room].pop()
            space.setdefault(capacity - sum(new), []).append([new, repeat])
            n -= each * repeat
    return [(p, r) for group in space.values() for p, r in group]


#: Powers of a length by which least squares weighs what is left of it, as they are tried.
WEIGHTS = (1.0, 3.0)


def plan(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """``(lengths of a sequence, repeats)`` that use up the histogram exactly: of the weightings' plans the shortest."""
    best, least = None, -(-int((counts * np.arange(len(counts))).sum()) // capacity)
    for w in WEIGHTS:
        found = weighted_plan(counts, capacity, w)
        n = sum(r for _, r in found)
        if best is None or n < best[0]:
            best = n, found
        if n == least:  # no plan can be shorter
            break
    return best[1]


def weighted_plan(counts: np.ndarray, capacity: int, weight: float) -> list[tuple[tuple[int, ...], int]]:
    left = counts.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    if left[capacity]:
        out.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    lengths = np.flatnonzero(left)
    if len(lengths) and len(pats := patterns(lengths, capacity)):
        repeats = fit(pats, left.astype(float), weight)
        for p in np.argsort(-repeats, kind="stable"):
            if repeats[p] < 1 - 1e-6:
                break
            own, uses = np.unique(pats[p][pats[p] > 0], return_counts=True)
            r = int(min(int(repeats[p] + 1e-6), (left[own] // uses).min()))
            if r:
                out.append((tuple(int(v) for v in pats[p] if v), r))
                left[own] -= r * uses
    return out + best_fit(left, capacity)


def pieces(documents: DataFrame, capacity: int, end: int, path: str | None, with_ids: bool) -> DataFrame:
    """Every piece with its part (a task) and its rank among the part's pieces of its length."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for b in rows:
            for lo in range(0, b.num_rows, 200):
                out: list[list] = [[] for _ in range(7)]
                ids = b.column(0).slice(lo, 200)
                for i, text in enumerate(b.column(1).slice(lo, 200).to_pylist()):
                    tokens = np.array([*(encode(text) if text else ()), end], "<u4")
                    for k, (start, length) in enumerate(cut(len(tokens), capacity)):
                        raw = tokens[start : start + length].tobytes()
                        for column, v in zip(out, (i, k, start, length, zlib.crc32(raw), int(seen[length]), raw), strict=True):
                            column.append(v)
                        seen[length] += 1
                n = len(out[0])
                kinds = (None, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                cols = [ids.take(pa.array(out[0], pa.int64()))] + [pa.array(c, t) for c, t in zip(out[1:6], kinds[1:6], strict=True)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "place"]
                if with_ids:
                    cols, names = [*cols, pa.array(out[6], pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([part] * n, pa.int32())], [*names, "part"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    ids = ", ids binary" if with_ids else ""
    return documents.select("doc_id", "text").mapInArrow(
        batches, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, place long{ids}, part int"
    )


def pack(
    documents: DataFrame, capacity: int = CAPACITY, end: int = END, path: str | None = None, with_ids: bool = False
) -> DataFrame:
    """One row for each piece with its place: ``sequence_id`` and ``offset``; ``with_ids`` adds the ids, little-endian 32-bit."""
    spark = documents.sparkSession
    ws = Workspace(spark, "pack")
    table = ws.put(pieces(documents, capacity, end, path, with_ids))  # written: ranks must not change
    sizes = ws.put(table.groupBy("part", "length").agg(F.count("*").alias("n")))
    counts = np.zeros(capacity + 1, np.int64)
    for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        counts[r.length] = r.n
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    base = sizes.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = table.join(base, ["part", "length"]).withColumn("rank", F.col("base") + F.col("place"))
    slots = slot_table(plan(counts, capacity), capacity)
    keep = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    if len(slots[0]) > BROADCAST_PLACES:
        return _placed_by_join(ranked.select(*keep, "rank"), slots, ws)
    send = spark.sparkContext.broadcast(slots)

    def placed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, low, first, offset, _ = send.value
        for b in rows:
            length, rank = (b.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, (length << _ROWS) + rank, "right") - 1
            cols = [b.column(c) for c in keep] + [pa.array(first[at] + rank - low[at]), pa.array(offset[at])]
            yield pa.RecordBatch.from_arrays(cols, [*keep, "sequence_id", "offset"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    ids = ", ids binary" if with_ids else ""
    return ranked.select(*keep, "rank").mapInArrow(
        placed, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long{ids}, sequence_id long, offset long"
    )


def _placed_by_join(ranked: DataFrame, slots: tuple[np.ndarray, ...], ws: Workspace) -> DataFrame:
    """Places by a join on length and stretch of ranks, for any number of places."""
    keys, low, first, offset, repeats = slots
    table = pa.table({"len": keys >> _ROWS, "low": low, "first": first, "offset": offset, "upto": low + repeats})
    runs = ws.put(ws.spark.createDataFrame(table))
    stretch = F.explode(F.sequence(F.floor(F.col("low") / STRETCH), F.floor((F.col("upto") - 1) / STRETCH)))
    runs = runs.withColumn("stretch", stretch)
    within = (F.col("length") == F.col("len")) & (F.floor(F.col("rank") / STRETCH) == F.col("stretch"))
    out = ranked.join(runs, within & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("upto")))
    return out.withColumn("sequence_id", F.col("first") + F.col("rank") - F.col("low")).select(*ranked.drop("rank").columns, "sequence_id", "offset")


def slot_table(packed: list[tuple[tuple[int, ...], int]], capacity: int) -> tuple[np.ndarray, ...]:
    """For pieces by length and rank: where a run of ranks begins, its first sequence, its offset there and its length."""
    used = np.zeros(capacity + 1, np.int64)
    rows, sequence = [], 0
    for lengths, repeats in packed:
        offset = 0
        for v in lengths:
            rows.append(((v << _ROWS) + int(used[v]), int(used[v]), sequence, offset, repeats))
            used[v] += repeats
            offset += v
        sequence += repeats
    rows.sort()
    return tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 5


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
