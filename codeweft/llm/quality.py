"""Quality rules: counting rules, then perplexity bands of an n-gram model.

The model is a byte n-gram model with interpolated modified Kneser-Ney smoothing, one
for each language, with discounts of its own. It is fitted on all texts of its
language that read like prose: with ``MIN_WORDS`` words and at most one symbol for
``SYMBOL_EVERY`` characters; so what it judges as junk isn't what it has learned from.
Tasks count the n-grams, Spark adds the counts up, and every order's probabilities
come from joins and aggregations on n-gram types. The model is kept as arrays sorted
by hash; where it has at most ``BROADCAST_ENTRIES`` entries, which bounds its size,
executors hold the arrays, and beyond that n-grams are joined to it. Each language
gets a lower and an upper bound of log-perplexity for every length class (a power of
two of characters), over the texts that pass the counting rules: the language's
median minus and plus a multiple of a robust deviation. A mean over n bytes spreads by
about 1 / sqrt(n), so the deviation is that of the class, or, if that is larger, the
language's scaled to the class's length; classes of few texts take the language's for
their own. Texts outside are rejected: below are repetitive ones, above are those
unlike their language.

Defined cases: null counts as empty and has no words; texts too short for an n-gram
have no perplexity and stand or fall by the counting rules, as do texts of a class
without any spread; texts of any length are read whole, in slices of rows, and one
very long text is one slice; null is a language of its own, and so is one of which no
text reads like prose, whose n-grams are all unknown and equally likely; figures on a
bound are inside it, and of the middle values of an even number of texts the lower one
is the median; rows are judged one by one, so repeated rows and ids repeat; an empty
table gives an empty result; extra columns, whatever their names, are ignored by judge
and kept by keep_good.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeweft.llm import words as wd
from codeweft.sources.scratch import Workspace, sheltered, steady

ORDER = 5
MIN_WORDS = 10
#: Percent of words in repeated windows from which a text fails.
MAX_REPEATED = 20
REPEAT_WINDOW = 5
#: Texts with a symbol for fewer characters of words than this teach the model nothing.
SYMBOL_EVERY = 100
#: A band reaches this many robust standard deviations from the median.
BAND = 4.0
#: Texts from which on a length class has a spread of its own.
LEAST_CLASS = 30
#: Entries of the model, of 12 bytes each, up to which executors hold it: 36 MB.
BROADCAST_ENTRIES = 3_000_000
#: Bytes of text whose n-grams are looked up together beyond that.
CHUNK_BYTES = 8 << 20
_BIN = 1000
_LANG_SHIFT = 40

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True


# ---- counting rules


def rule_columns(column: pa.Array) -> list[np.ndarray]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of every row."""
    parts = [_rules(column.slice(lo, hi - lo)) for lo, hi in wd.slices(column)]
    return [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 5


def _rules(column: pa.Array) -> list[np.ndarray]:
    data, offsets = wd.utf8(column)
    n = len(offsets) - 1
    starts, ends = wd.spans(data, offsets)
    first = wd.per_row(starts, offsets)
    total = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])
    chars = total(~wd.SPACE[data] & ((data & 0xC0) != 0x80))
    symbols = total(SYMBOL[data])

    line_s, line_e = wd.runs(data == 10, offsets)
    worded = np.searchsorted(starts, line_e) > np.searchsorted(starts, line_s)
    line_s, line_e = line_s[worded], line_e[worded]
    row = np.searchsorted(offsets, line_s, "right") - 1
    names = wd.hashes(data, line_s, line_e)
    order = np.lexsort((names, row))
    again = (names[order][1:] == names[order][:-1]) & (row[order][1:] == row[order][:-1])
    dup_lines = np.bincount(row[order][1:][again], minlength=n)

    at = wd.windows(first, REPEAT_WINDOW)
    grams = wd.ngrams(wd.hashes(data, starts, ends), REPEAT_WINDOW)[at]
    owner = np.searchsorted(first, at, "right") - 1
    owner = np.minimum(owner, n - 1)
    with np.errstate(over="ignore"):
        keyed = wd.mix(grams + owner.astype(wd.U) * wd.U(0x9E3779B97F4A7C15))
    order = np.argsort(keyed)
    same = keyed[order][1:] == keyed[order][:-1]
    repeated = np.zeros(len(at), bool)
    repeated[order[1:][same]] = True
    repeated[order[:-1][same]] = True
    cover = np.zeros(len(starts) + 1, np.int64)
    np.add.at(cover, at[repeated], 1)
    np.add.at(cover, at[repeated] + REPEAT_WINDOW, -1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
    return [np.diff(first), chars, symbols, dup_lines, np.diff(inside[first])]


def base_failed(n_words: np.ndarray, n_repeat: np.ndarray) -> np.ndarray:
    return (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEATED * n_words)


def reads_like_prose(column: pa.Array) -> np.ndarray:
    """Which texts have enough words and few symbols."""
    data, offsets = wd.utf8(column)
    starts, _ = wd.spans(data, offsets)
    total = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])
    chars, symbols = total(~wd.SPACE[data] & ((data & 0xC0) != 0x80)), total(SYMBOL[data])
    return (np.diff(wd.per_row(starts, offsets)) >= MIN_WORDS) & (symbols * SYMBOL_EVERY <= chars)


# ---- n-grams of bytes, packed: language in the upper 24 bits, then one byte for each place


def _lang(value: str | None) -> int:
    return 0 if value is None else 1 + zlib.crc32(value.encode()) % ((1 << 23) - 1)


_FOLD = wd.LOWER.copy()
_FOLD[48:58] = 48


def _codes(column: pa.Array, langs: list) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams of all rows, in order, and how many each row has."""
    data, offsets = wd.utf8(column)
    n = np.maximum(np.diff(offsets) - ORDER + 1, 0)
    raw = _FOLD[data].astype(np.int64)
    size = max(len(raw) - ORDER + 1, 0)
    code = np.zeros(size, np.int64)
    for i in range(ORDER):
        code |= raw[i : i + size] << (8 * (ORDER - 1 - i))
    at = np.repeat(offsets[:-1] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    return code[at] | (np.repeat(np.array([_lang(v) for v in langs], np.int64), n) << _LANG_SHIFT), n


def _summed(codes: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if counts is None:
        codes = np.sort(codes)
        cut = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, int)
        return codes[cut], np.diff(np.append(cut, len(codes)))
    order = np.argsort(codes)
    codes, counts = codes[order], counts[order]
    cut = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, int)
    return codes[cut], np.add.reduceat(counts, cut) if len(cut) else counts


def _count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def merged():
        return _summed(np.concatenate([c for c, _ in held]), np.concatenate([n for _, n in held]))

    def out(codes, counts):
        for i in range(0, len(codes), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(codes[i : i + 100_000]), pa.array(counts[i : i + 100_000])], ["code", "c"])

    for b in rows:
        for lo, hi in wd.slices(b.column(0)):
            text, lang = b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo)
            prose = pa.array(reads_like_prose(text))
            held.append(_summed(_codes(text.filter(prose), lang.filter(prose).to_pylist())[0]))
            size += len(held[-1][0])
            if size > 400_000:
                held = [merged()]
                size = len(held[0][0])
                if size > 250_000:  # keep a task's memory bounded; Spark adds the parts up
                    yield from out(*held[0])
                    held, size = [], 0
    if held:
        yield from out(*merged())


# ---- the model


def _low(order: int) -> int:
    return (1 << (8 * order)) - 1


def _lang_bits() -> int:
    return ~_low(ORDER)


def _suffix(order: int) -> Column:
    """The n-gram without its first byte."""
    return F.col("code").bitwiseAND(F.lit(_lang_bits() | _low(order - 1)))


def _context(order: int) -> Column:
    """The n-gram without its last byte."""
    low = F.shiftright(F.col("code").bitwiseAND(F.lit(_low(order))), 8)
    return F.col("code").bitwiseAND(F.lit(_lang_bits())).bitwiseOR(low)


def _discount_table(t: DataFrame) -> DataFrame:
    """``tag, d1, d2, d3``: each language's discounts for one order; a row a language."""
    tag = F.shiftright("code", _LANG_SHIFT).alias("tag")
    times = t.where("c <= 4").groupBy(tag, "c").agg(F.count("*").alias("n"))
    y = times.groupBy("tag").agg(*[F.coalesce(F.sum(F.when(F.col("c") == k, F.col("n"))), F.lit(0)).alias(f"t{k}") for k in (1, 2, 3, 4)])
    y = y.withColumn("y", F.when(F.col("t1") > 0, F.col("t1") / (F.col("t1") + 2 * F.col("t2"))).otherwise(0.0))
    out = []
    for k in (1, 2, 3):
        d = F.when(F.col(f"t{k}") > 0, k - (k + 1) * F.col("y") * F.col(f"t{k + 1}") / F.col(f"t{k}")).otherwise(k / 2)
        out.append(F.least(F.greatest(d, F.lit(0.05)), F.lit(k - 0.05)).alias(f"d{k}"))
    return y.select("tag", *out)


def fit(corpus: DataFrame, ws: Workspace) -> dict[str, DataFrame]:
    """``grams(ord, code, logp)`` and ``contexts(ord, code, logw)`` of all orders, from all rows that read like prose."""
    counted = corpus.select("text", "lang").where("text is not null").mapInArrow(_count, "code long, c long")
    top = ws.put(counted.groupBy("code").agg(F.sum("c").alias("c")))
    with steady(ws.spark):  # an n-gram has at most 256 neighbours of either sort, so no key is hot
        return _orders(top, ws)


def _orders(top: DataFrame, ws: Workspace) -> dict[str, DataFrame]:
    tables = {ORDER: top}
    for k in range(ORDER - 1, 0, -1):
        tables[k] = ws.put(tables[k + 1].select(_suffix(k + 1).alias("code")).groupBy("code").agg(F.count("*").alias("c")))
    grams, contexts, lower = [], [], None
    for k in range(1, ORDER + 1):
        off = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        tagged = tables[k].withColumn("tag", F.shiftright("code", _LANG_SHIFT))
        by = ws.put(_discount_table(tables[k]))
        tagged = tagged.join(F.broadcast(by) if by.count() <= 10_000 else by, "tag", "left").na.fill({"d1": 0.5, "d2": 1.0, "d3": 1.5})
        own = tagged.select("code", "c", off.alias("d"), _context(k).alias("ctx"), _suffix(k).alias("suf"))
        stats = own.groupBy("ctx").agg(F.sum("c").alias("total"), F.sum("d").alias("mass"))
        stats = ws.put(stats.select("ctx", "total", (F.col("mass") / F.col("total")).alias("w")))
        joined = own.join(stats, "ctx")
        if lower is None:
            p = (F.col("c") - F.col("d")) / F.col("total") + F.col("w") / 256
        else:
            joined = joined.join(lower.select(F.col("code").alias("suf"), F.col("p").alias("p_low")), "suf")
            p = (F.col("c") - F.col("d")) / F.col("total") + F.col("w") * F.col("p_low")
        lower = ws.put(joined.select("code", p.alias("p")))
        grams.append(lower.select(F.lit(k).alias("ord"), "code", F.log("p").cast("float").alias("logp")))
        contexts.append(stats.select(F.lit(k).alias("ord"), F.col("ctx").alias("code"), F.log("w").cast("float").alias("logw")))
    ws.drop(*tables.values())
    return {"grams": reduce(DataFrame.union, grams), "contexts": reduce(DataFrame.union, contexts)}


class HashArray:
    """A map from 64-bit keys to floats: arrays sorted by key hash, with a directory of leading bits."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        h = wd.mix(keys.view(wd.U))
        order = np.argsort(h)
        self.h, self.values = h[order], values[order]
        self.bits = max(1, int(len(keys)).bit_length())
        top = self.h >> wd.U(64 - self.bits)
        self.start = np.searchsorted(top, np.arange((1 << self.bits) + 1, dtype=wd.U)).astype(np.int32)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, NaN for keys that aren't there."""
        out = np.full(len(keys), np.nan, self.values.dtype)
        if not len(self.h):
            return out
        h = wd.mix(keys.view(wd.U))
        top = (h >> wd.U(64 - self.bits)).astype(np.int64)
        at, end = self.start[top], self.start[top + 1]
        rest = np.flatnonzero(at < end)
        h, at, end = h[rest], at[rest], end[rest]
        while len(rest):
            hit = self.h[at] == h
            out[rest[hit]] = self.values[at[hit]]
            at = at + 1
            go = ~hit & (at < end)
            rest, h, at, end = rest[go], h[go], at[go], end[go]
        return out


class Model:
    """Log-probabilities of n-grams, with interpolation weights for those never seen."""

    def __init__(self, grams: list[HashArray], contexts: list[HashArray]):
        self.grams, self.contexts = grams, contexts

    def logp(self, codes: np.ndarray) -> np.ndarray:
        out = self.grams[ORDER - 1].get(codes).astype(np.float64)
        rest = np.flatnonzero(np.isnan(out))
        extra = np.zeros(len(rest))
        lang = codes[rest] & _lang_bits()
        for k in range(ORDER, 0, -1):
            if not len(rest):
                return out
            low = codes[rest] & _low(k)
            if k < ORDER:
                p = self.grams[k - 1].get(lang | low)
                found = ~np.isnan(p)
                out[rest[found]] = p[found] + extra[found]
                rest, extra, lang, low = rest[~found], extra[~found], lang[~found], low[~found]
            extra = extra + np.nan_to_num(self.contexts[k - 1].get(lang | (low >> 8)))
        out[rest] = extra - np.log(256)
        return out


def _held(model: dict[str, DataFrame]) -> Model:
    """The model as arrays on the driver; only called below the bound of entries."""
    parts = []
    for name, value in (("grams", "logp"), ("contexts", "logw")):
        t = model[name].toArrow()
        order, code, v = (t.column(c).to_numpy() for c in ("ord", "code", value))
        parts.append([HashArray(code[order == k], v[order == k]) for k in range(1, ORDER + 1)])
    return Model(*parts)


# ---- scores and verdicts

_STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_STATS_SQL = ", ".join(f"{c} long" for c in _STATS) + ", base_failed boolean, log_ppl double"


def _fields(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def score(documents: DataFrame, model: dict[str, DataFrame], keep: list[str], ws: Workspace) -> DataFrame:
    """Columns ``keep`` with the counting rules' figures and the mean log-perplexity of a byte, as a written table."""
    entries = model["grams"].count() + model["contexts"].count()
    if entries > BROADCAST_ENTRIES:
        return ws.put(_score_joined(documents, model, keep, ws))
    held = documents.sparkSession.sparkContext.broadcast(_held(model))
    out = ws.put(_score_held(documents, held, keep))
    held.destroy()
    return out


def _scored_batch(b: pa.RecordBatch, keep: list[str], ppl: pa.Array) -> pa.RecordBatch:
    stats = rule_columns(b.column("text"))
    failed = base_failed(stats[0], stats[4])
    cols = [b.column(c) for c in keep] + [pa.array(s.astype(np.int64)) for s in stats] + [pa.array(failed), ppl]
    return pa.RecordBatch.from_arrays(cols, [*keep, *_STATS, "base_failed", "log_ppl"])


def _mean_logs(b: pa.RecordBatch, logp) -> pa.Array:
    """The mean negative log-probability of each row's n-grams; null for rows without one."""
    text, lang, sums, sizes = b.column("text"), b.column("lang"), [], []
    for lo, hi in wd.slices(text):
        codes, n = _codes(text.slice(lo, hi - lo), lang.slice(lo, hi - lo).to_pylist())
        total = np.concatenate([[0.0], np.cumsum(logp(codes), dtype=np.float64)])
        ends = np.cumsum(n)
        sums.append(total[ends] - total[ends - n])
        sizes.append(n)
    n = np.concatenate(sizes) if sizes else np.zeros(0, int)
    s = np.concatenate(sums) if sums else np.zeros(0)
    return pa.array(-s / np.maximum(n, 1), mask=n == 0)


def _score_held(documents: DataFrame, model, keep: list[str]) -> DataFrame:
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            yield _scored_batch(b, keep, _mean_logs(b, model.value.logp))

    need = list(dict.fromkeys([*keep, "text", "lang"]))
    return documents.select(*[f"`{c}`" for c in need]).mapInArrow(batches, f"{_fields(documents, keep)}, {_STATS_SQL}")


def _score_joined(documents: DataFrame, model: dict[str, DataFrame], keep: list[str], ws: Workspace) -> DataFrame:
    """As _score_held, for a model of any size: chunks of rows look their different n-grams up by joins."""
    need = list(dict.fromkeys([*keep, "text", "lang"]))

    def chunked(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId() << 33, 0
        for b in it:
            _, offsets = wd.utf8(b.column("text"))
            chunk = part + (before + offsets[:-1]) // CHUNK_BYTES
            before += int(offsets[-1])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in need), pa.array(chunk)], [*need, "_chunk"])

    def different(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            chunk = b.column(0).to_numpy()
            cut = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]])) if len(chunk) else np.zeros(0, int)
            for lo, hi in zip(cut, np.append(cut[1:], len(chunk)), strict=True) if len(cut) else ():
                part = b.slice(int(lo), int(hi - lo))
                found = [_summed(_codes(part.column(1).slice(i, j - i), part.column(2).slice(i, j - i).to_pylist())[0])[0] for i, j in wd.slices(part.column(1))]
                code = np.unique(np.concatenate(found))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), chunk[lo])), pa.array(code)], ["_chunk", "full"])

    rows = ws.put(documents.select(*need).mapInArrow(chunked, f"{_fields(documents, need)}, _chunk long"))
    left = rows.select("_chunk", "text", "lang").mapInArrow(different, "_chunk long, full long").distinct()
    left = left.select("_chunk", "full", F.col("full").alias("code"), F.lit(0.0).alias("logp"))
    done = None
    for k in range(ORDER, 0, -1):
        p = model["grams"].where(F.col("ord") == k).select("code", F.col("logp").alias("found"))
        w = model["contexts"].where(F.col("ord") == k).select(F.col("code").alias("ctx"), "logw")
        at = ws.put(left.join(p, "code", "left"))
        hit = at.where("found is not null").select("_chunk", "full", (F.col("logp") + F.col("found")).alias("logp"))
        done = hit if done is None else done.union(hit)
        miss = at.where("found is null").withColumn("ctx", _context(k)).join(w, "ctx", "left")
        code = F.col("full").bitwiseAND(F.lit(_lang_bits() | _low(k - 1)))
        left = miss.select("_chunk", "full", code.alias("code"), (F.col("logp") + F.coalesce("logw", F.lit(0.0))).alias("logp"))
    done = done.union(left.select("_chunk", "full", F.col("logp") - float(np.log(256))))

    def finish(key, t, known):
        out = []
        if t.num_rows:
            codes, logp = (known.column(c).to_numpy() for c in ("full", "logp"))
            at = HashArray(codes.astype(np.int64), logp)
            for b in t.combine_chunks().to_batches():
                out.append(_scored_batch(b, keep, _mean_logs(b, at.get)))
        return pa.Table.from_batches(out, out[0].schema) if out else t.select(keep)

    return rows.groupBy("_chunk").cogroup(done.groupBy("_chunk")).applyInArrow(finish, f"{_fields(documents, keep)}, {_STATS_SQL}")


def _size_class() -> Column:
    return F.floor(F.log2(F.greatest("word_chars", F.lit(1)))).cast("int")


def _median(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """``keys, name, texts``: medians of ``value`` weighted by ``n``, and how many texts they are of."""
    summed = rows.groupBy(*keys, value).agg(F.sum("n").alias("n"))
    upto = W.partitionBy(*keys).orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)
    so_far, every = F.sum("n").over(upto), F.sum("n").over(W.partitionBy(*keys))
    found = summed.select(*keys, value, so_far.alias("s"), every.alias("texts")).where("2 * s >= texts")
    return found.groupBy(*keys).agg(F.min(value).alias(name), F.first("texts").alias("texts"))


def bands(scored: DataFrame) -> DataFrame:
    """``band_lang, band_size, low, high`` for each language and length class, from a histogram of all scores; no score, no row.

    Bounds are null where a class has no spread at all.
    """
    good = scored.where("not base_failed and log_ppl is not null")
    hist = good.groupBy("lang", _size_class().alias("size"), F.round(F.col("log_ppl") * _BIN).cast("long").alias("b")).agg(F.count("*").alias("n"))
    mid = _median(hist, ["lang"], "b", "mid").select(F.col("lang").alias("l"), "mid")
    off = hist.join(mid, F.col("lang").eqNullSafe(F.col("l"))).select("lang", "size", "mid", "n", F.abs(F.col("b") - F.col("mid")).alias("off"))
    root = F.sqrt(1.5 * F.pow(F.lit(2.0), F.col("size")))
    off = off.withColumn("scaled", F.round(F.col("off") * root).cast("long"))
    own = _median(off, ["lang", "size", "mid"], "off", "own")
    whole = _median(off, ["lang"], "off", "whole").select(F.col("lang").alias("l"), "whole")
    scaled = _median(off, ["lang"], "scaled", "scaled").select(F.col("lang").alias("k"), "scaled")
    every = own.join(whole, F.col("lang").eqNullSafe(F.col("l"))).join(scaled, F.col("lang").eqNullSafe(F.col("k")))
    spread = F.greatest(F.when(F.col("texts") >= LEAST_CLASS, F.col("own")).otherwise(F.col("whole")), F.col("scaled") / root)
    wide = F.when(spread > 0, spread * 1.4826 * BAND)
    low, high = (F.col("mid") - wide) / _BIN, (F.col("mid") + wide) / _BIN
    return every.select(F.col("lang").alias("band_lang"), F.col("size").alias("band_size"), low.alias("low"), high.alias("high"))


def _verdict(scored: DataFrame, band: DataFrame) -> DataFrame:
    same = F.col("lang").eqNullSafe(F.col("band_lang")) & (_size_class() == F.col("band_size"))
    out = scored.join(F.broadcast(band) if band.count() <= 10_000 else band, same, "left")
    inside = F.col("log_ppl").isNull() | F.col("log_ppl").between(F.col("low"), F.col("high"))
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True)))


def judge(documents: DataFrame) -> DataFrame:
    """``doc_id``, the counting rules' figures, ``base_failed``, ``log_ppl`` and ``kept`` for every row."""
    ws = Workspace(documents.sparkSession, "quality")
    docs = documents.select("doc_id", "text", "lang")
    scored = score(docs, fit(docs, ws), ["doc_id", "lang"], ws)
    out = _verdict(scored, ws.put(bands(scored)))
    return out.select("doc_id", *_STATS, "base_failed", "log_ppl", "kept")


def keep_good(documents: DataFrame) -> DataFrame:
    """The documents that judge keeps, with their columns."""
    ws = Workspace(documents.sparkSession, "quality")
    docs, restored = sheltered(documents, ("text", "lang"))
    # Written with their figures: texts are scored once, for the bands and the verdict.
    scored = score(docs, fit(docs, ws), docs.columns, ws)
    return restored(_verdict(scored, ws.put(bands(scored))).where("kept"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
