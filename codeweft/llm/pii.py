"""Personal data by bootstrapped contextual extraction.

Seeds are what fixed patterns find: e-mail and IP addresses, card and phone numbers
(the base), and quoted values that are assigned to a token, key or password
(secrets). A slot is a run of one to ``RUN`` words. It has two lexical patterns: the
two words before it, for runs of one word, and the word before with the word after
it and the run's number of words. In each round

- the patterns that hold enough known instances, seeds or accepted ones, are counted
  over all text,
- a pattern's confidence is the share of its occurrences that known instances fill,
- whatever fills a slot of a newly trusted pattern is a candidate; all places of the
  candidates are counted, and a candidate is accepted if its trusted patterns make
  its score high enough and hold most of its places,
- accepted instances bring their other patterns into the next round.

Rounds end when no pattern is new, or none is newly trusted, or nothing is accepted.
Discovered spans are the places of accepted instances in trusted patterns. They take
the kind of their best pattern; base spans stay.

Counts cover all texts. Each pass looks words up in a bitmap of fixed size and adds
counts up by task before they are shuffled; joins on patterns and instances are
salted, as one of them may hold a large share of all places.

Defined cases: null counts as empty; texts of any length are read whole, in slices of
rows, and one very long text is one slice; rows are judged one by one, so repeated
rows and ids repeat in the result and count as places of their own; of kinds that
tie for a span the first as listed wins; a span that touches a seed is not added; an
empty table gives an empty result; extra columns, whatever their names, are ignored
by find_pii and kept by redact.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.llm import words as wd
from codeweft.llm.salting import salted_join
from codeweft.sources.scratch import Workspace, sheltered

KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = 4
#: Words of the longest run that may fill a slot.
RUN = 4
#: A pattern is trusted if known instances fill this share of its occurrences,
PRECISION = 0.5
#: and if it holds this many different ones.
SUPPORT = 3
#: Least score of an accepted instance,
ACCEPT = 0.5
#: and least share of its places that trusted patterns hold.
SHARE = 0.5
#: Bits of the filters that passes over the text use: 4 MB, whatever the size of the input.
FILTER_BITS = 25

_DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_BYTES = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can only start where a run of digits does: from within a run it would fail or succeed alike.
_IP = re.compile(rb"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(rb"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(rb"\+[0-9][ ().0-9-]+[0-9]")
_ASSIGNED = re.compile(rb"[:=][ \t]*[\"']([A-Za-z0-9+/_.=-]{16,})[\"']")
_SECRET_NAME = re.compile(rb"(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)[\"']?[ \t]*\Z", re.IGNORECASE)

_ALNUM = np.zeros(256, bool)
_ALNUM[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")] = True
_ALNUM[128:] = True


def luhn(digits: bytes) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = (c - 48) * (1 + (i & 1))
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: bytes) -> Iterator[tuple[int, int]]:
    """Every match holds one ``@``; its local part is the run before it that no earlier match took."""
    end, at = 0, text.find(b"@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_BYTES:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        at = text.find(b"@", at + 1)


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` in bytes, by kind and start."""
    out = [(0, *s) for s in _emails(text)]
    for m in _IP.finditer(text):
        parts = [p.lstrip(b"0") or b"0" for p in m[0].split(b".")]
        if all(len(p) <= 3 and int(p) <= 255 for p in parts):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].translate(None, b" -")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    if b"+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(48 <= c <= 57 for c in m[0]) <= 15:
                out.append((3, *m.span()))
    return out


def seed_spans(text: bytes) -> list[tuple[int, int, int]]:
    """The base spans and those of assigned secrets."""
    out = base_spans(text)
    for m in _ASSIGNED.finditer(text):
        if _SECRET_NAME.search(text, max(0, m.start() - 24), m.start()):
            out.append((4, *m.span(1)))
    return out


# ---- slots and their patterns

_A, _B, _C, _D = (wd.U(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3))


def _range_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges in any order."""
    order = np.lexsort((e, s))
    a, b = s[order], e[order]
    out = np.empty(len(s), wd.U)
    if (np.diff(b) >= 0).all():
        out[order] = wd.hashes(data, a, b)
    else:
        for i, x, y in zip(order, a, b, strict=True):
            out[i] = wd.hashes(data, np.array([x]), np.array([y]))[0]
    return out.view(np.int64)


class Slots:
    """The words of some rows, and the patterns and instances of the runs of them."""

    def __init__(self, column: pa.Array):
        self.data, self.offsets = wd.utf8(column)
        self.low = wd.LOWER[self.data]
        self.starts, self.ends = wd.spans(self.data, self.offsets)
        self.n = len(self.starts)
        h = wd.hashes(self.low, self.starts, self.ends)
        self.row = np.searchsorted(self.offsets, self.starts, "right") - 1
        pad = np.concatenate([np.zeros(2, wd.U), h, np.zeros(RUN, wd.U)])
        where = np.concatenate([np.full(2, -1), self.row, np.full(RUN, -1)])
        near = lambda d: np.where(where[2 + d : 2 + d + self.n] == self.row, pad[2 + d : 2 + d + self.n], wd.U(0))
        self.l2, self.l1 = near(-2), near(-1)
        self.right = {k: near(k) for k in range(1, RUN + 1)}
        self.whole = {k: where[1 + k : 1 + k + self.n] == self.row for k in range(1, RUN + 1)}
        letters = np.append(np.flatnonzero(_ALNUM[self.data]), len(self.data) + 1)
        self.cs = letters[np.searchsorted(letters, self.starts)] if self.n else self.starts
        last = np.searchsorted(letters, self.ends) - 1
        self.ce = np.where(last >= 0, letters[np.maximum(last, 0)] + 1, 0) if self.n else self.ends
        self.worded = self.cs < self.ends

    def before(self, i: np.ndarray) -> np.ndarray:
        """The pattern of the two words before, an even number; 0 where there is none."""
        with np.errstate(over="ignore"):
            key = wd.mix(self.l2[i] * _A + self.l1[i] * _B + wd.U(1)) & ~wd.U(1)
            return np.where(self.l1[i] != 0, key, wd.U(0)).view(np.int64)

    def around(self, i: np.ndarray, k: int) -> np.ndarray:
        """The pattern of the words on both sides of a run of ``k``, an odd number; 0 where one is missing."""
        l1, r1 = self.l1[i], self.right[k][i]
        with np.errstate(over="ignore"):
            return np.where((l1 != 0) & (r1 != 0), wd.mix(l1 * _C + r1 * _D + wd.U(1 + k)) | wd.U(1), wd.U(0)).view(np.int64)

    def runs(self, k: int) -> np.ndarray:
        """First words of the runs of ``k`` words whose outer words hold letters or digits."""
        i = np.flatnonzero(self.whole[k] & self.worded)
        return i[self.worded[i + k - 1]]

    def instances(self, i: np.ndarray, k: int) -> np.ndarray:
        """Hashes of the runs' text between their outer letters or digits."""
        return _range_hashes(self.low, self.cs[i], self.ce[i + k - 1])

    def clear(self, i: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Which runs no seed touches; only their rows are searched."""
        out = np.ones(len(i), bool)
        for row in np.unique(self.row[i]):
            lo = self.offsets[row]
            seeds = seed_spans(self.data[lo : self.offsets[row + 1]].tobytes())
            mine = np.flatnonzero(self.row[i] == row)
            for _, s, e in seeds:
                out[mine] &= (self.cs[i[mine]] >= lo + e) | (self.ce[i[mine] + k[mine] - 1] <= lo + s)
        return out


def _in(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys.view(wd.U) >> wd.U(64 - FILTER_BITS)
    return (bits[at >> wd.U(3)] >> (at & wd.U(7)).astype(np.uint8)) & 1 == 1


def _filter_bits(keys: DataFrame) -> np.ndarray:
    """A bitmap of the leading bits of the keys in the first column: of fixed size, whatever their number."""
    key = F.col(keys.columns[0])
    word = F.shiftrightunsigned(key, 70 - FILTER_BITS).alias("w")
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(`{keys.columns[0]}`, {64 - FILTER_BITS}) & 63 as int))")
    t = keys.select(word, bit.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bits = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    bits[t.column("w").to_numpy()] = t.column("b").to_numpy()
    return bits.view(np.uint8)


def _tallied(found: Callable[[Slots], list[np.ndarray]], width: int) -> Callable:
    """A pass that counts what ``found`` gives of each slice of rows, added up by task within bounded memory."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        size = 0

        def added() -> tuple[np.ndarray, np.ndarray]:
            keys, n = np.concatenate(held, 1), np.concatenate(counts)
            order = np.lexsort(keys)
            keys, n = keys[:, order], n[order]
            new = np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(0)])
            cut = np.flatnonzero(new)
            return keys[:, cut], np.add.reduceat(n, cut)

        def batch(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*map(pa.array, keys), pa.array(n)], [*(f"k{i}" for i in range(width)), "n"])

        for b in rows:
            for lo, hi in wd.slices(b.column(0)):
                keys = np.stack(found(Slots(b.column(0).slice(lo, hi - lo))))
                if not keys.shape[1]:
                    continue
                held.append(keys)
                counts.append(np.ones(keys.shape[1], np.int64))
                size += keys.shape[1]
                if size > 400_000:
                    keys, n = added()
                    if keys.shape[1] > 200_000:  # Spark adds the parts up
                        yield batch(keys, n)
                        held, counts, size = [], [], 0
                    else:
                        held, counts, size = [keys], [n], keys.shape[1]
        if held:
            yield batch(*added())

    return batches


def _contexts_in(bits) -> Callable[[Slots], list[np.ndarray]]:
    """Occurrences of the patterns in a filter, whatever fills their slots."""

    def found(s: Slots) -> list[np.ndarray]:
        every = np.arange(s.n)
        out = [s.before(every)]
        out += [s.around(np.flatnonzero(s.whole[k]), k) for k in range(1, RUN + 1)]
        p = np.concatenate(out)
        p = p[p != 0]
        return [p[_in(bits.value, p)]]

    return found


def _fillers(bits) -> Callable[[Slots], list[np.ndarray]]:
    """``p, instance`` of the runs in slots of the patterns in a filter."""

    def found(s: Slots) -> list[np.ndarray]:
        p, i, k = _filled(s, bits.value)
        names = np.zeros(len(p), np.int64)
        for width in np.unique(k):
            names[k == width] = s.instances(i[k == width], int(width))
        return [p, names]

    return found


def _filled(s: Slots, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pattern, first word and number of words of the runs that fill slots of patterns in the filter and touch no seed."""
    ps, firsts, widths = [], [], []
    for k in range(1, RUN + 1):
        i = s.runs(k)
        for p in (s.around(i, k), *((s.before(i),) if k == 1 else ())):
            hit = np.flatnonzero((p != 0) & _in(bits, p))
            ps.append(p[hit])
            firsts.append(i[hit])
            widths.append(np.full(len(hit), k))
    p, i, k = np.concatenate(ps), np.concatenate(firsts), np.concatenate(widths)
    free = s.clear(i, k)
    return p[free], i[free], k[free]


def _places(bits) -> Callable[[Slots], list[np.ndarray]]:
    """``instance, p`` of all places of the instances in a filter; p is 0 once for each place."""

    def found(s: Slots) -> list[np.ndarray]:
        names, ps = [], []
        for k in range(1, RUN + 1):
            i = s.runs(k)
            name = s.instances(i, k)
            hit = np.flatnonzero(_in(bits.value, name))
            i, name = i[hit], name[hit]
            free = s.clear(i, np.full(len(i), k))
            i, name = i[free], name[free]
            names.append(name)
            ps.append(np.zeros(len(i), np.int64))
            for p in (s.around(i, k), *((s.before(i),) if k == 1 else ())):
                names.append(name[p != 0])
                ps.append(p[p != 0])
        return [np.concatenate(names), np.concatenate(ps)]

    return found


# ---- the first pass: seeds

_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
_MENTION = pa.struct([("kind", pa.int32()), ("instance", pa.int64()), ("p1", pa.int64()), ("p2", pa.int64())])
_SPAN_SQL = "array<struct<kind:int,start:long,end:long>>"
_MENTION_SQL = "array<struct<kind:int,instance:long,p1:long,p2:long>>"


def _listed_by_row(row: np.ndarray, n: int, fields: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """Lists of structs, from columns ordered by row."""
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int32)
    values = pa.StructArray.from_arrays([pa.array(f, t.type) for f, t in zip(fields, kind, strict=True)], fields=list(kind))
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def _seeds(column: pa.Array) -> tuple[pa.Array, pa.Array]:
    """All seed spans in code points, and their instances with their patterns, of every row of a slice."""
    s = Slots(column)
    n = len(column)
    found = [(i, *x) for i in range(n) for x in seed_spans(s.data[s.offsets[i] : s.offsets[i + 1]].tobytes())]
    row, kind, start, end = np.array(found, np.int64).reshape(-1, 4).T
    lo = s.offsets[row]
    points = np.concatenate([[0], np.cumsum((s.data & 0xC0) != 0x80)])
    spans = _listed_by_row(row, n, [kind, points[lo + start] - points[lo], points[lo + end] - points[lo]], _SPAN)
    if not len(row):
        return spans, _listed_by_row(row, n, [kind, kind, kind, kind], _MENTION)
    first = np.searchsorted(s.starts, lo + start, "right") - 1
    last = np.searchsorted(s.starts, lo + end - 1, "right") - 1
    p2 = np.zeros(len(row), np.int64)
    for k in range(1, RUN + 1):
        at = last - first + 1 == k
        p2[at] = s.around(first[at], k)
    name = _range_hashes(s.low, s.cs[first], s.ce[last])
    return spans, _listed_by_row(row, n, [kind, name, s.before(first), p2], _MENTION)


def _scan(keep: list[str], rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in rows:
        for lo, hi in wd.slices(b.column("text")):
            part = b.slice(lo, hi - lo)
            spans, mentions = _seeds(part.column("text"))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), spans, mentions], [*keep, "_seeds", "_mentions"])


# ---- rounds


def bootstrap(texts: DataFrame, mentions: DataFrame, ws: Workspace) -> tuple[DataFrame, DataFrame] | None:
    """``(p, kind, confidence)`` trusted and ``(instance, kind)`` accepted after the last round; None if nothing is accepted."""
    spark = texts.sparkSession
    sent = []

    def passed(found, keys: DataFrame, width: int) -> DataFrame:
        bits = spark.sparkContext.broadcast(_filter_bits(keys))
        sent.append(bits)
        names = [f"k{i}" for i in range(width)]
        counted = texts.mapInArrow(_tallied(found(bits), width), ", ".join(f"{c} long" for c in (*names, "n")))
        return counted.groupBy(*names).agg(F.sum("n").alias("n"))

    one = mentions.select("kind", "instance", F.explode(F.array("p1", "p2")).alias("p")).where("p <> 0")
    edges = ws.put(one.groupBy("p", "instance", "kind").agg(F.count("*").alias("n")))
    known = mentions.select("instance").distinct()
    counted = trusted = accepted = None
    while True:
        fresh = edges.groupBy("p").agg(F.count("*").alias("k")).where(f"k >= {SUPPORT}").select("p")
        if counted is not None:
            fresh = fresh.join(counted, "p", "left_anti")
        fresh = ws.put(fresh)
        if not fresh.isEmpty():
            seen = passed(_contexts_in, fresh, 1).withColumnsRenamed({"k0": "p", "n": "all"})
            seen = fresh.join(seen, "p")
            counted = ws.put(seen if counted is None else counted.union(seen))
        if counted is None:
            return None
        filled = edges.groupBy("p", "kind").agg(F.sum("n").alias("filled"), F.count("*").alias("support"))
        share = F.least(F.col("filled") / F.col("all"), F.lit(1.0)).alias("confidence")
        sure = filled.join(counted, "p").select("p", "kind", share, "support")
        sure = ws.put(sure.where(f"confidence >= {PRECISION} and support >= {SUPPORT}").drop("support"))
        new = sure.select("p").distinct() if trusted is None else sure.select("p").distinct().join(trusted, "p", "left_anti")
        new, trusted = ws.put(new), sure
        if new.isEmpty():
            break
        slots = passed(_fillers, new, 2).withColumnsRenamed({"k0": "p", "k1": "instance"})
        found = salted_join(slots, new, "p").select("instance").distinct().join(known, "instance", "left_anti")
        found = ws.put(found)
        if found.isEmpty():
            break
        places = passed(_places, found, 2).withColumnsRenamed({"k0": "instance", "k1": "p"})
        places = ws.put(salted_join(places, found, "instance"))
        taken = ws.put(_accepted(places, trusted))
        if taken.isEmpty():
            break
        accepted = taken if accepted is None else ws.put(accepted.union(taken))
        known = ws.put(known.union(taken.select("instance")))
        more = salted_join(places.where("p <> 0"), taken, "instance").select("p", "instance", "kind", "n")
        edges = ws.put(edges.union(more))
    for bits in sent:  # what passes have found is written
        bits.destroy()
    return None if accepted is None else (trusted, accepted)


def _accepted(places: DataFrame, trusted: DataFrame) -> DataFrame:
    """``(instance, kind)`` of the candidates whose score and share of places are high enough."""
    every = places.where("p = 0").select("instance", F.col("n").alias("all"))
    inside = salted_join(places.where("p <> 0"), trusted, "p")
    odd = F.col("p").bitwiseAND(F.lit(1)) == 1
    scored = inside.groupBy("instance", "kind").agg(
        _noisy_or().alias("score"),
        # A place may be in a pattern of either sort, so the sorts are counted apart.
        F.greatest(F.sum(F.when(odd, F.col("n")).otherwise(0)), F.sum(F.when(odd, 0).otherwise(F.col("n")))).alias("held"),
    )
    good = scored.join(every, "instance").where(f"score >= {ACCEPT} and held >= {SHARE} * all")
    return good.groupBy("instance").agg(F.min_by("kind", F.struct(-F.col("score"), "kind")).alias("kind"))


def _noisy_or() -> Column:
    return 1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-6)))))


def _placed(patterns, instances) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``key, start, end, instance, p``, in code points, of runs that may be accepted ones in trusted slots."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for lo, hi in wd.slices(b.column(1)):
                s = Slots(b.column(1).slice(lo, hi - lo))
                p, i, k = _filled(s, patterns.value)
                name = np.zeros(len(p), np.int64)
                for width in np.unique(k):
                    name[k == width] = s.instances(i[k == width], int(width))
                hit = _in(instances.value, name)
                p, i, k, name = p[hit], i[hit], k[hit], name[hit]
                points = np.concatenate([[0], np.cumsum((s.data & 0xC0) != 0x80)])
                at = points[s.offsets[s.row[i]]]
                key = b.column(0).slice(lo, hi - lo).to_numpy()[s.row[i]]
                cols = [key, points[s.cs[i]] - at, points[s.ce[i + k - 1]] - at, name, p]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["key", "start", "end", "instance", "p"])

    return batches


def scan(documents: DataFrame, keep: list[str], ws: Workspace) -> DataFrame:
    """The rows' columns ``keep`` with ``_seeds`` and ``_all`` spans, arrays of ``(kind, start, end)`` in code points, in order."""
    rows = documents.withColumn("_key", F.xxhash64("text"))
    keep = [*keep, "_key"]
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    table = ws.put(rows.mapInArrow(lambda it: _scan(keep, it), f"{schema}, _seeds {_SPAN_SQL}, _mentions {_MENTION_SQL}"))
    mentions = table.select(F.explode("_mentions").alias("m")).select("m.*")
    grown = bootstrap(documents.select("text"), mentions, ws)
    if grown is None:
        return table.drop("_mentions", "_key").withColumn("_all", F.array_sort("_seeds"))
    trusted, accepted = grown
    send = documents.sparkSession.sparkContext.broadcast
    patterns, instances = send(_filter_bits(trusted)), send(_filter_bits(accepted))
    # Spans depend on the text alone, so rows of one text share theirs.
    found = rows.select("_key", "text").mapInArrow(_placed(patterns, instances), "key long, start long, end long, instance long, p long").distinct()
    sure = salted_join(found, trusted.withColumnRenamed("kind", "of"), "p")
    sure = salted_join(sure, accepted.select("instance"), "instance")
    scored = sure.groupBy("key", "start", "end", "of").agg(_noisy_or().alias("score"))
    best = scored.groupBy("key", "start", "end").agg(F.min_by("of", F.struct(-F.col("score"), "of")).alias("kind"))
    added = best.groupBy("key").agg(F.collect_list(F.struct("kind", "start", "end")).alias("_added"))
    every = F.array_sort(F.concat("_seeds", F.coalesce("_added", F.array().cast(_SPAN_SQL))))
    out = salted_join(table.drop("_mentions").withColumnRenamed("_key", "key"), added, "key", how="left", salt=F.monotonically_increasing_id())
    return out.withColumn("_all", every).drop("key", "_added")


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def find_pii(documents: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, n_added, n_secret, n_discovered, spans`` for every row.

    What is added to the base spans is told apart: secrets are seeds, found by their assignment;
    only the discovered ones come from contexts.
    """
    ws = Workspace(documents.sparkSession, "pii")
    seen = scan(documents.select("doc_id", "text"), ["doc_id"], ws)
    base = F.filter("_seeds", lambda s: s["kind"] < BASE_KINDS)
    seen = seen.select("doc_id", base.alias("_base"), F.size("_seeds").alias("_known"), "_all")
    kinds = F.transform("_base", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, (lambda k: lambda x: x == k)(k))).cast("long").alias(f"n_{n}") for k, n in enumerate(KINDS[:BASE_KINDS])]
    return seen.select(
        "doc_id",
        *counts,
        F.sha2(_listed(F.col("_base")), 256).alias("base_sha256"),
        (F.size("_all") - F.size("_base")).cast("long").alias("n_added"),
        (F.col("_known") - F.size("_base")).cast("long").alias("n_secret"),
        (F.size("_all") - F.col("_known")).cast("long").alias("n_discovered"),
        _listed(F.col("_all")).alias("spans"),
    )


def redact(documents: DataFrame) -> DataFrame:
    """The documents, with every span in ``text`` replaced by its kind in angle brackets; null stays null."""
    ws = Workspace(documents.sparkSession, "redact")
    docs, restored = sheltered(documents, ("text",))
    columns = docs.columns

    def masked(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            out = []
            for text, spans in zip(b.column("text").to_pylist(), b.column("_all").to_pylist(), strict=True):
                if spans:
                    parts, at = [], 0
                    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
                        if s["start"] >= at:
                            parts += [text[at : s["start"]], f"<{KINDS[s['kind']].upper()}>"]
                        at = max(at, s["end"])
                    text = "".join([*parts, text[at:]])
                out.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(out, b.column("text").type) if c == "text" else b.column(c) for c in columns], columns)

    kept = scan(docs, columns, ws).select(*columns, "_all")
    return restored(kept.mapInArrow(masked, docs.schema))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
