"""Runs of periodic words, found by a suffix automaton with merged end-position sets.

A run is a stretch of consecutive words with smallest period q, at least LEAST words
and at least COPIES periods long, that no neighbouring word extends. The automaton of
a stretch is built over its words; along suffix links, from the longest state up, the
smaller ordered set of end positions is merged into the larger one. A position's new
neighbour in the set of a state is an occurrence of all its words; at a distance of no more than
the state's length the two make a square, which is extended to both sides as far as
the period goes. Neighbours in the set of a run's first period lie exactly q apart, so
every run is met; squares of a multiple of q extend to the same stretch and lose to q.

Which stretches get an automaton is settled first, without loss: every three words of
a run stand in it at least three times, so three words that are rarer in their stretch
divide it, until nothing more divides. Prose falls to pieces of no length at once. The
automaton takes about half a kilobyte of memory for a word of what is left.

Defined cases: null, empty and blank texts have no words, no runs and an empty
collapsed text; texts are taken whole at any length; rows repeat as they are given; an
empty table gives an empty result; other columns than doc_id and text are ignored;
among runs of one greatest exponent ``best`` is the first, then the shortest period.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.llm import words as wd
from codeweft.sources.scratch import workers_import_package

#: A run's fewest words, and fewest periods.
LEAST, COPIES = 6, 4
#: Words that must recur, and how often they do in any run: of 4 q words or more, (4 q - 2) // q starts at least; 4 starts if q = 1.
GRAM, RECUR = 3, 3
_BLOCK = 512

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class EndPositions:
    """An ordered set of integers in blocks, so that inserting stays cheap in long texts."""

    __slots__ = ("blocks", "size")

    def __init__(self, first: int):
        self.blocks, self.size = [[first]], 1

    def __iter__(self) -> Iterator[int]:
        for b in self.blocks:
            yield from b

    def insert(self, x: int) -> tuple[int | None, int | None]:
        """Put ``x``, which isn't there, in; its neighbours before and behind."""
        k = bisect_right(self.blocks, x, key=lambda b: b[0]) - 1 if len(self.blocks) > 1 else 0
        k = max(k, 0)
        block = self.blocks[k]
        at = bisect_right(block, x)
        before = block[at - 1] if at else None
        behind = block[at] if at < len(block) else self.blocks[k + 1][0] if k + 1 < len(self.blocks) else None
        block.insert(at, x)
        if len(block) > 2 * _BLOCK:
            self.blocks[k : k + 1] = [block[:_BLOCK], block[_BLOCK:]]
        self.size += 1
        return before, behind


def automaton(text: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Suffix links, lengths and own end positions (-1 for clones and the root) of the states of ``text``'s suffix automaton."""
    moves: list[dict[int, int]] = [{}]
    link, length, end = [-1], [0], [-1]
    last = 0
    for i, c in enumerate(text):
        state = len(moves)
        moves.append({})
        length.append(i + 1)
        end.append(i)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = state
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] > length[p] + 1:
                clone = len(moves)
                moves.append(moves[q].copy())
                length.append(length[p] + 1)
                end.append(-1)
                link.append(link[q])
                link[q] = clone
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = clone
                    p = link[p]
                q = clone
            link[state] = q
        last = state
    return link, length, end


def _stretch(ids: np.ndarray, d: int, at: int) -> tuple[int, int]:
    """The widest range of positions around ``at`` that equal the one ``d`` before; ``at`` does."""
    hi, width = at + 1, 64
    while hi < len(ids):
        same = ids[hi : hi + width] == ids[hi - d : hi - d + len(ids[hi : hi + width])]
        if not same.all():
            hi += int(same.argmin())
            break
        hi, width = hi + len(same), width * 2
    lo, width = at, 64
    while lo > d:
        a = max(d, lo - width)
        same = (ids[a:lo] == ids[a - d : lo - d])[::-1]
        if not same.all():
            lo -= int(same.argmin())
            break
        lo, width = a, width * 2
    return lo, hi - 1


def squares(text: list[int]) -> dict[tuple[int, int], int]:
    """The smallest period of every stretch ``(first, last)`` of at least two periods that can't be extended."""
    link, length, end = automaton(text)
    ids = np.array(text, np.int64)
    known: dict[int, tuple[list[int], list[int]]] = {}
    found: dict[tuple[int, int], int] = {}

    def seed(d: int, at: int) -> None:
        lows, highs = known.setdefault(d, ([], []))
        k = bisect_right(lows, at)
        if k and highs[k - 1] >= at:
            return
        lo, hi = _stretch(ids, d, at)
        lows.insert(k, lo)
        highs.insert(k, hi)
        key = (lo - d, hi)
        if d < found.get(key, d + 1):
            found[key] = d

    ends = [EndPositions(e) if e >= 0 else None for e in end]
    for v in sorted(range(1, len(link)), key=length.__getitem__, reverse=True):
        u = link[v]
        if u <= 0:  # the root's length is 0: no distance is small enough
            ends[v] = None
            continue
        small, large, reach = ends[u], ends[v], length[u]
        ends[v] = None
        if small is None:
            ends[u] = large
            continue
        if small.size > large.size:
            small, large = large, small
        for x in small:
            before, behind = large.insert(x)
            if before is not None and x - before <= reach:
                seed(x - before, x)
            if behind is not None and behind - x <= reach:
                seed(behind - x, behind)
        ends[u] = large
    return found


def runs_of(text: list[int]) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs, by start, then period."""
    out = [(a, b - a + 1, q) for (a, b), q in squares(text).items() if b - a + 1 >= max(LEAST, COPIES * q)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def candidates(hashes: np.ndarray, first: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of words that hold every run; ``first`` tells each row's first word. Ranges may share words at their ends."""
    grams, at = wd.ngrams(hashes, GRAM), wd.windows(first, GRAM)
    part = np.zeros(len(at), np.int64)
    while len(at):
        # a part ends where windows aren't neighbours any more; shorter ones than a run has are dropped
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) != 1) | (np.diff(part) != 0)
        part = np.cumsum(new)
        keep = np.bincount(part)[part] > LEAST - GRAM
        at, part = at[keep], part[keep]
        _, which, count = np.unique(wd.mix(grams[at] ^ wd.mix(part.astype(wd.U))), return_inverse=True, return_counts=True)
        good = count[which] >= RECUR
        if good.all():
            break
        at, part = at[good], part[good]
    if not len(at):
        return []
    starts = np.flatnonzero(np.diff(part, prepend=-1))
    stops = np.append(starts[1:], len(at))
    return [(int(at[a]), int(at[b - 1]) + GRAM) for a, b in zip(starts, stops, strict=True)]


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without what repeats a run's first period."""
    if runs:
        keep = np.ones(len(words), bool)
        for start, length, period in runs:
            keep[start + period : start + length] = False
        words = [words[i] for i in np.flatnonzero(keep)]
    return b" ".join(words)


Repeat = Callable[[object, int], "tuple[int, int] | None"]


def periodic_runs(documents: DataFrame, repeat: Repeat | None = None) -> DataFrame:
    """``doc_id, n_words, runs, collapsed``: all runs by start, then period, and the text without their repetitions.

    ``repeat(doc_id, n_words)`` may give ``(a, p)``: from word ``a`` on, the document's words
    are taken to repeat their first ``p``; it runs in tasks.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for i, j in wd.slices(b.column(1)):
                yield _scanned(b.slice(i, j - i), repeat)

    workers_import_package(documents.sparkSession)
    schema = f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return documents.select("doc_id", "text").mapInArrow(batches, schema)


def _scanned(batch: pa.RecordBatch, repeat: Repeat | None) -> pa.RecordBatch:
    data, offsets = wd.utf8(batch.column(1))
    starts, ends = wd.spans(data, offsets)
    hashes, first = wd.hashes(data, starts, ends), wd.per_row(starts, offsets)
    source: dict[int, np.ndarray] = {}
    if repeat is not None:
        for r, key in enumerate(batch.column(0).to_pylist()):
            lo, n = int(first[r]), int(first[r + 1] - first[r])
            if n and (how := repeat(key, n)):
                index = np.arange(n)
                index[how[0] :] = how[0] + (index[how[0] :] - how[0]) % how[1]
                source[r] = index
                hashes[lo : lo + n] = hashes[lo + index]
    found: dict[int, list[tuple[int, int, int]]] = {}
    texts: dict[int, list[bytes]] = {}

    def words_of(r: int) -> list[bytes]:
        if r not in texts:
            # bytes.split() parts at exactly the bytes that part words
            own = data[offsets[r] : offsets[r + 1]].tobytes().split()
            texts[r] = [own[k] for k in source[r]] if r in source else own
        return texts[r]

    for lo, hi in candidates(hashes, first):
        r = int(np.searchsorted(first, lo, "right")) - 1
        shift, names = lo - int(first[r]), {}
        text = [names.setdefault(w, len(names)) for w in words_of(r)[shift : shift + hi - lo]]
        found.setdefault(r, []).extend((a + shift, n, q) for a, n, q in runs_of(text))
    rows = range(batch.num_rows)
    for runs in found.values():
        runs.sort(key=lambda x: (x[0], x[2]))
    spans = [[dict(zip(("start", "length", "period"), x, strict=True)) for x in found.get(r, ())] for r in rows]
    kept = []
    for r in rows:
        kept.append(_collapsed(words_of(r), found.get(r, [])).decode())
        texts.pop(r)
    columns = [batch.column(0), pa.array(np.diff(first), pa.int64()), pa.array(spans, pa.list_(_RUN)), pa.array(kept, pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])


def best(runs: Column) -> Column:
    """Of runs by start and period, the first of the greatest length / period, compared as fractions; null if there is none."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    more = lambda top, r: top.isNull() | (r["length"] * top["period"] > top["length"] * r["period"])
    return F.aggregate(runs, none, lambda top, r: F.when(more(top, r), r).otherwise(top))


def planted(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """The periodic tails that the query plants in every tenth document, by the checksum of its id."""
    if doc_id is None:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    return g % n, 1 + (n - g % n) // (3 + g % 8)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), planted).withColumn("top", best(F.col("runs")))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("top.start").alias("start"),
        F.col("top.length").alias("length"),
        F.col("top.period").alias("period"),
        F.expr("(1000 * top.length) div top.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
