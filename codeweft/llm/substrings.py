"""Substring deduplication by relative parsing against indexed reference blocks.

The corpus is its own reference. It is cut into blocks of documents, and every
block is indexed: first the anchors of all blocks (the least hash of the short
word runs in each window, so equal windows have equal anchors) meet in hash
partitions and show which recur; then the windows whose anchor recurs meet there
and learn their earliest source. Each document is then factored from left to right:
a factor begins at a window with an earlier source and goes on while the next
window's source is the source's next word; where that ends, at the factor's boundary,
the windows that cross it are looked up on their own, as another block may hold them.
Factors of at least a window's length are duplicate spans.

This isn't the greedy parse of a document against each block's text: that takes every
block as a reference of every other, which grows with the square of the corpus, while
windows are looked up once however many blocks there are. What is removed is the
same: a word goes if and only if a window that covers it has an earlier source.

What travels between a block and a hash partition is a sorted array of hashes, one
entry for each different value in the block, so a passage that many documents
share is one entry a block, and rows never outnumber values.

Defined cases: null counts as empty and has no words; texts of any length are parsed
whole, within one task; windows that tie for the earliest source are at one place; of
the rows that share an id the order is by start alone, so equal windows at equal
starts of one id are both first; a null id comes before all others; ids that aren't
integers order as their type does; an empty table gives an empty result; extra
columns, whatever their names, are ignored by factors and kept by deduplicated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.llm import words as wd
from codeweft.sources.scratch import Workspace, sheltered, workers_import_package

WINDOW = 20
#: Words of the runs whose least hash is a window's anchor.
ANCHOR = 8
#: Bytes of text in a block, about.
BLOCK_BYTES = 4 << 20
#: Bytes of hashes in a hash partition, about.
PARTITION_BYTES = 16 << 20

NONE = -(2**63)


def _ids(column: pa.Array) -> np.ndarray:
    """Document ids as integers; null comes first."""
    return column.cast(pa.int64()).fill_null(NONE).to_numpy(zero_copy_only=False)


class Block:
    """The words of a block's documents, ordered by id, with window and anchor hashes."""

    def __init__(self, ids: np.ndarray, column: pa.Array, window: int):
        order = np.lexsort((np.arange(len(ids)), ids))
        self.order, self.ids = order, ids[order]
        column = column.take(pa.array(order))
        data, offsets = wd.utf8(column)
        self.data, self.offsets = data, offsets
        self.starts, self.ends = wd.spans(data, offsets)
        self.first = wd.per_row(self.starts, offsets)
        h = wd.hashes(data, self.starts, self.ends)
        self.at = wd.windows(self.first, window)
        self.window = wd.ngrams(h, window)[self.at].view(np.int64)
        runs = wd.ngrams(h, min(ANCHOR, window))
        left, least = window - min(ANCHOR, window) + 1, runs
        width = 1
        while 2 * width <= left:  # least hash of ``width`` runs, doubled
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < left:
            least = np.minimum(least[: len(least) - (left - width)], least[left - width :])
        self.anchor = least[self.at].view(np.int64)
        self.span = left
        self.row = np.searchsorted(self.first, self.at, "right") - 1
        self.word = self.at - self.first[self.row]

    def recurring(self) -> tuple[np.ndarray, np.ndarray]:
        """The different anchors, sorted, and whether each occurs at two places of this block."""
        if not len(self.at):
            return np.zeros(0, np.int64), np.zeros(0, bool)
        new = np.concatenate([[True], (self.anchor[1:] != self.anchor[:-1]) | (self.at[1:] != self.at[:-1] + 1) | (self.row[1:] != self.row[:-1])])
        cut = np.flatnonzero(new)
        length = np.diff(np.append(cut, len(new)))
        names, inverse, counts = np.unique(self.anchor[cut], return_inverse=True, return_counts=True)
        long = np.zeros(len(names), bool)
        long[inverse[length > self.span]] = True
        return names, (counts > 1) | long


def _parts(keys: np.ndarray, partitions: int) -> tuple[np.ndarray, np.ndarray]:
    """Partition numbers of sorted keys' hashes and the order that groups them."""
    part = (wd.mix(keys.view(wd.U)) % wd.U(partitions)).astype(np.int64)
    return part, np.argsort(part, kind="stable")


def _pieces(part: np.ndarray, order: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    sorted_part = part[order]
    if not len(part):
        return
    cut = np.flatnonzero(np.concatenate([[True], sorted_part[1:] != sorted_part[:-1]]))
    for a, b in zip(cut, np.append(cut[1:], len(part)), strict=True):
        yield int(sorted_part[a]), order[a:b]


def _packed(ints: np.ndarray) -> bytes:
    """Integers, as differences, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.diff(ints, prepend=np.int64(0)).tobytes())


def _unpacked(raw: bytes) -> np.ndarray:
    import zstandard

    return np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.int64))


def _block(t: pa.Table, window: int) -> Block:
    text = pa.concat_arrays(t.column("text").chunks) if t.num_rows else pa.array([], pa.string())
    return Block(_ids(t.column("doc_id").combine_chunks()), text, window)


class _Parse:
    """The three exchanges between blocks and hash partitions."""

    def __init__(self, blocks: DataFrame, partitions: int, window: int):
        self.blocks, self.partitions, self.window = blocks, partitions, window

    def anchors(self) -> DataFrame:
        """``(block, recur)``: for each block, the anchors of it that occur at two places of the corpus, packed."""
        partitions, window = self.partitions, self.window

        def out(key, t):
            names, twice = _block(t, window).recurring()
            part, order = _parts(names, partitions)
            rows = [(p, key[0].as_py(), names[i].tobytes(), np.packbits(twice[i]).tobytes()) for p, i in _pieces(part, order)]
            return _table(rows, ANCHOR_OUT)

        def meet(key, t):
            keys = [np.frombuffer(k, np.int64) for k in t.column("keys").to_pylist()]
            twice = np.concatenate([np.unpackbits(np.frombuffer(f, np.uint8))[: len(k)] for k, f in zip(keys, t.column("twice").to_pylist(), strict=True)])
            every = np.concatenate(keys)
            order = np.argsort(every, kind="stable")
            s = every[order]
            same = np.zeros(len(s), bool)
            same[1:] = s[1:] == s[:-1]
            same[:-1] |= same[1:]
            good = np.zeros(len(s), bool)
            good[order] = same
            good |= twice.astype(bool)
            rows, at = [], 0
            for b, k in zip(t.column("block").to_pylist(), keys, strict=True):
                g = k[good[at : at + len(k)]]
                at += len(k)
                if len(g):
                    rows.append((b, np.sort(g).tobytes()))
            return _table(rows, RECUR_OUT)

        sent = self.blocks.groupBy("block").applyInArrow(out, _ddl(ANCHOR_OUT))
        return sent.groupBy("part").applyInArrow(meet, _ddl(RECUR_OUT))

    def sources(self, recur: DataFrame) -> DataFrame:
        """``(block, at, doc, word)``: windows of a block with an earlier source, and the source, packed."""
        partitions, window = self.partitions, self.window

        def out(key, t, known):
            rows = []
            if t.num_rows and known.num_rows:
                b = _block(t, window)
                keys = np.sort(np.concatenate([np.frombuffer(k, np.int64) for k in known.column("keys").to_pylist()]))
                at = np.searchsorted(keys, b.anchor)
                live = np.flatnonzero(keys[np.minimum(at, len(keys) - 1)] == b.anchor)
                live = live[np.lexsort((b.word[live], b.ids[b.row[live]]))]
                names, firsts, inverse = np.unique(b.window[live], return_index=True, return_inverse=True)
                part, order = _parts(names, partitions)
                for p, i in _pieces(part, order):
                    where = live[firsts[i]]  # earliest of the block
                    i = i[np.argsort(where)]
                    where = live[firsts[i]]
                    rows.append((p, key[0].as_py(), names[i].tobytes(), _packed(b.ids[b.row[where]]), _packed(b.word[where])))
            return _table(rows, WINDOW_OUT)

        def meet(key, t):
            keys = [np.frombuffer(k, np.int64) for k in t.column("keys").to_pylist()]
            docs = np.concatenate([_unpacked(d) for d in t.column("doc").to_pylist()])
            words = np.concatenate([_unpacked(d) for d in t.column("word").to_pylist()])
            every = np.concatenate(keys)
            order = np.lexsort((words, docs, every))
            s = every[order]
            new = np.concatenate([[True], s[1:] != s[:-1]])
            lead = order[np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))]
            source = np.empty(len(s), np.int64)
            source[order] = lead
            later = (docs[source] != docs) | (words[source] != words)
            rows, at = [], 0
            for b, k in zip(t.column("block").to_pylist(), keys, strict=True):
                mine = np.flatnonzero(later[at : at + len(k)])
                if len(mine):
                    src = source[at + mine]
                    rows.append((b, k[mine].tobytes(), _packed(docs[src]), _packed(words[src])))
                at += len(k)
            return _table(rows, SOURCE_OUT)

        left, right = self.blocks.groupBy("block"), recur.groupBy("block")
        sent = left.cogroup(right).applyInArrow(out, _ddl(WINDOW_OUT))
        return sent.groupBy("part").applyInArrow(meet, _ddl(SOURCE_OUT))

    def parsed(self, sources: DataFrame, finish, schema: str) -> DataFrame:
        """``finish(block, factors of each row, rows)`` for every block."""
        window = self.window

        def out(key, t, known):
            if not t.num_rows:
                return finish(None, [], t)
            b = _block(t, window)
            names, docs, words = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
            if known.num_rows:
                names = np.concatenate([np.frombuffer(k, np.int64) for k in known.column("keys").to_pylist()])
                docs = np.concatenate([_unpacked(d) for d in known.column("doc").to_pylist()])
                words = np.concatenate([_unpacked(d) for d in known.column("word").to_pylist()])
            return finish(b, factor(b, window, names, docs, words), t)

        return self.blocks.groupBy("block").cogroup(sources.groupBy("block")).applyInArrow(out, schema)


def factor(b: Block, window: int, names: np.ndarray, docs: np.ndarray, words: np.ndarray) -> list[list[tuple[int, int, int, int]]]:
    """For each row of a block its factors ``(start, length, source id, source start)``, in words.

    ``names`` are window hashes whose earliest place in the corpus is (docs, words),
    outside this block or before its own first place; a window that recurs within
    the block has at least the block's first place as a source.
    """
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in b.ids]
    if not len(b.at):
        return out
    ids = b.ids[b.row]
    source_doc, source_word = ids.copy(), b.word.copy()
    order = np.lexsort((b.word, ids, b.window))
    s = b.window[order]
    lead = order[np.maximum.accumulate(np.where(np.concatenate([[True], s[1:] != s[:-1]]), np.arange(len(s)), 0))]
    source_doc[order], source_word[order] = ids[lead], b.word[lead]
    if len(names):
        sort = np.argsort(names)
        at = np.minimum(np.searchsorted(names[sort], b.window), len(names) - 1)
        hit = names[sort][at] == b.window
        source_doc[hit], source_word[hit] = docs[sort][at[hit]], words[sort][at[hit]]
    earlier = (source_doc < ids) | ((source_doc == ids) & (source_word < b.word))
    live = np.flatnonzero(earlier)
    if not len(live):
        return out
    # A factor goes on while the next window's source is the next word of the same source.
    on = np.zeros(len(live), bool)
    p, q = live[:-1], live[1:]
    on[1:] = (q == p + 1) & (b.row[q] == b.row[p]) & (source_doc[q] == source_doc[p]) & (source_word[q] == source_word[p] + 1)
    head = np.flatnonzero(~on)
    tail = np.append(head[1:], len(live)) - 1
    for a, z in zip(live[head], live[tail], strict=True):
        out[b.row[a]].append((int(b.word[a]), int(z - a) + window, int(source_doc[a]), int(source_word[a])))
    return out


ANCHOR_OUT = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("twice", pa.binary())])
RECUR_OUT = pa.schema([("block", pa.int64()), ("keys", pa.binary())])
WINDOW_OUT = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("doc", pa.binary()), ("word", pa.binary())])
SOURCE_OUT = pa.schema([("block", pa.int64()), ("keys", pa.binary()), ("doc", pa.binary()), ("word", pa.binary())])


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'long' if pa.types.is_int64(f.type) else 'binary'}" for f in schema)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _parse(documents: DataFrame, window: int) -> _Parse:
    workers_import_package(documents.sparkSession)
    size = documents.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK_BYTES))
    # At most one hash of 8 bytes for each word, and a word is some six bytes long.
    partitions = max(1, -(-size // PARTITION_BYTES))
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(int(blocks)))
    return _Parse(documents.withColumn("block", block), int(partitions), window)


def _covered(factors: list[tuple[int, int, int, int]], n: int) -> np.ndarray:
    gone = np.zeros(n + 1, np.int64)
    for start, length, _, _ in factors:
        gone[start] += 1
        gone[start + length] -= 1
    return np.cumsum(gone[:-1]) > 0


def _kept_text(b: Block, row: int, gone: np.ndarray) -> bytes:
    at = np.flatnonzero(~gone) + b.first[row]
    return b" ".join([b.data[s:e].tobytes() for s, e in zip(b.starts[at], b.ends[at], strict=True)])


def _numbered(documents: DataFrame, ws: Workspace) -> tuple[DataFrame, DataFrame | None]:
    """The documents with integer ids in the order of their own, and the table that names them; None if they are integers."""
    if documents.schema["doc_id"].dataType.typeName() in ("byte", "short", "integer", "long"):
        return documents.withColumn("doc_id", F.col("doc_id").cast("long")), None
    ids = documents.select(F.col("doc_id").alias("own")).where("own is not null").distinct().orderBy("own")
    ids = ws.put(ids.withColumn("number", F.monotonically_increasing_id()))
    out = documents.join(ids, documents["doc_id"] == ids["own"], "left")
    return out.select(*[(F.col("number").alias("doc_id") if c == "doc_id" else documents[c]) for c in documents.columns]), ids


def factors(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, factors`` for every row.

    ``factors`` are the duplicate spans ``(start, length, source_id, source_start)``
    in words; each reads the same as the source from there on.
    """
    ws = Workspace(documents.sparkSession, "substrings")
    numbered, ids = _numbered(documents.select("doc_id", "text"), ws)
    found = _factors(numbered, window)
    if ids is None:
        return found
    found = ws.put(found.join(ids, found["doc_id"] == ids["number"], "left").drop("doc_id", "number").withColumnRenamed("own", "doc_id"))
    found = found.withColumn("key", F.monotonically_increasing_id())
    one = found.select("key", F.posexplode("factors").alias("i", "f")).join(ids, F.col("f.source_id") == ids["number"], "left")
    named = F.struct("i", F.col("f.start").alias("start"), F.col("f.length").alias("length"), F.col("own").alias("source_id"), F.col("f.source_start").alias("source_start"))
    listed = one.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(named)), lambda f: f.dropFields("i")).alias("named"))
    kind = listed.schema["named"].dataType.simpleString()
    out = found.join(listed, "key", "left")
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256", F.coalesce("named", F.array().cast(kind)).alias("factors"))


def _factors(documents: DataFrame, window: int) -> DataFrame:
    parse = _parse(documents, window)
    spans = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("source_id", pa.int64()), ("source_start", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("factors", spans)])
    names = ("start", "length", "source_id", "source_start")

    def finish(b: Block | None, found: list, t: pa.Table) -> pa.Table:
        rows = []
        for i in range(len(found)):
            n = int(b.first[i + 1] - b.first[i])
            gone = _covered(found[i], n)
            digest = hashlib.sha256(_kept_text(b, i, gone)).hexdigest()
            own = None if b.ids[i] == NONE else int(b.ids[i])
            listed = [dict(zip(names, (s, l, None if d == NONE else d, w), strict=True)) for s, l, d, w in found[i]]
            rows.append((own, n, int(gone.sum()), digest, listed))
        return _table(rows, schema)

    recur = parse.anchors()
    out = "doc_id long, n_words long, n_removed long, kept_sha256 string, factors array<struct<start:long,length:long,source_id:long,source_start:long>>"
    return parse.parsed(parse.sources(recur), finish, out)


def deduplicated(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents with the words of duplicate spans removed from ``text``, the others joined by a space.

    Texts that lose nothing stay as they are.
    """
    plain, restored = sheltered(documents, ("doc_id", "text"))
    docs, ids = _numbered(plain, Workspace(documents.sparkSession, "substrings"))
    columns = docs.columns
    parse = _parse(docs, window)

    def finish(b: Block | None, found: list, t: pa.Table) -> pa.Table:
        t = t.select(columns)
        if b is None:
            return t
        texts = t.column("text").to_pylist()
        for i, spans in enumerate(found):
            if spans:
                gone = _covered(spans, int(b.first[i + 1] - b.first[i]))
                texts[b.order[i]] = _kept_text(b, i, gone).decode()
        return t.set_column(columns.index("text"), "text", pa.array(texts, t.schema.field("text").type))

    out = parse.parsed(parse.sources(parse.anchors()), finish, docs.schema)
    if ids is not None:
        out = out.join(ids, out["doc_id"] == ids["number"], "left").drop("doc_id", "number").withColumnRenamed("own", "doc_id")
    return restored(out)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factors(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP3_SQL = f"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
),
p AS (SELECT doc_id, unnest(range(1, len(w) - {WINDOW - 2})) AS i, w FROM d WHERE len(w) >= {WINDOW}),
g AS (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS k FROM p),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM g),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS i FROM f WHERE n > 1),
r AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(CASE WHEN gone IS NULL THEN array_to_string(w, ' ')
              ELSE coalesce(array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i)), lambda i: w[i]), ' '), '') END) AS kept_sha256
FROM d LEFT JOIN r ON r.doc_id = d.doc_id
"""
