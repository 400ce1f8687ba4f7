"""Benchmark decontamination by size-partitioned MinHash containment search.

A test item is short and a document may be long, so Jaccard similarity of the two
says little, and sketches of documents would hold nothing of an item. So the short
side is sketched and the long one isn't: an item's sketch is its ``k`` shingles of
least hash (bottom-k MinHash), and a document looks all its shingles up in the index
of sketches. Of an item of which a document contains a share ``t``, none of the sketch
is in the document with a chance of at most ``(1 - t) ** k``. Items are partitioned by
size (powers of two of shingles), and each partition has its own ``k``: what makes
misses impossible for its largest items, or ``miss`` likely at most, whichever is less.
Each candidate is verified by exact shingle containment.

DataFrame functions only. Shingles are ``width`` consecutive normalised words
(ASCII case folded, other characters than letters and digits dropped).

Defined cases: null and empty texts, texts and items with fewer words than a shingle
match nothing; texts of any length are searched whole; repeated rows give one result;
rows that share an id count as one with the higher containment, and so do rows without
an id, whose matches are returned under a null id; items that tie are all returned;
an empty table gives an empty result; extra columns, whatever their names, are ignored
by find_leaks and kept by decontaminate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.llm.salting import salted_join
from codeweft.sources.scratch import Workspace

WIDTH = 5
THRESHOLD = 0.8
#: Chance that a true match is missed, at most.
MISS = 1e-9
#: Index entries up to which the index is broadcast (an entry carries its item's shingles; items are short).
BROADCAST_ENTRIES = 200_000
#: Shingles in all index entries up to which it is broadcast: 8 bytes each, so 64 MB.
BROADCAST_SHINGLES = 8_000_000


def normal_words(text: Column) -> Column:
    """Words with ASCII case folded and everything but letters and digits dropped."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.split(F.trim(F.regexp_replace(low, r"[^a-z0-9\x{80}-\x{10FFFF}]+", " ")), " ")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingles(text: Column, width: int) -> Column:
    """Hashes of the runs of ``width`` normalised words, in order; empty if there is none."""

    def of(words: Column) -> Column:
        last = F.size(words) - (width - 1)
        starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, width)))

    return let(normal_words(F.coalesce(text, F.lit(""))), of)


def sketch_size(size: Column, threshold: float, miss: float) -> Column:
    """Sketch entries that items of a size partition need.

    Of ``n`` distinct shingles at least ``ceil(t n)`` are in a match, so any
    ``n - ceil(t n) + 1`` of them include a hit: small partitions are certain.
    Larger ones take the least ``k`` with ``(1 - t) ** k <= miss``.
    """
    certain = size - F.ceil(size * threshold - 1e-9) + 1
    likely = F.ceil(F.log(F.lit(miss)) / F.log(F.lit(1 - threshold)))
    return F.least(certain, likely).cast("int")


def sketches(items: DataFrame, width: int, threshold: float, miss: float) -> DataFrame:
    """``(item_id, part, item_grams, g)``: one row for each entry of an item's sketch.

    Partition ``part`` holds the items of 2**part to 2**(part + 1) - 1 shingles; all
    of them have sketches of the size that its largest ones need.
    """
    grams = F.array_distinct(shingles(F.col("text"), width))
    sets = items.select("item_id", grams.alias("item_grams")).where("size(item_grams) > 0")
    sets = sets.withColumn("part", F.floor(F.log2(F.size("item_grams"))).cast("int"))
    ranked = F.array_sort(F.transform("item_grams", lambda g: F.struct(F.hash(g).alias("h"), g.alias("g"))))
    k = sketch_size(F.pow(F.lit(2), F.col("part") + 1) - 1, threshold, miss)
    entry = F.explode(F.slice(ranked, 1, k)).alias("e")
    return sets.select("item_id", "part", "item_grams", entry).select("item_id", "part", "item_grams", F.col("e.g").alias("g"))


def _text_key(documents: DataFrame) -> Column:
    """Tells rows with a null id apart by their text; null where there is an id."""
    return F.when(documents["doc_id"].isNull(), F.sha2(documents["text"], 256))


def _matches(documents: DataFrame, items: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, miss: float = MISS) -> DataFrame:
    """``doc_id, text_key, item_id, n, s`` of each row and item that match: the item's shingles and those shared."""
    ws = Workspace(documents.sparkSession, "leaks")
    index = ws.put(sketches(items, width, threshold, miss).select("item_id", "item_grams", "g"))
    n, total = index.agg(F.count("*"), F.coalesce(F.sum(F.size("item_grams")), F.lit(0))).first()
    docs = documents.select("doc_id", _text_key(documents).alias("text_key"), "text", shingles(F.col("text"), width).alias("grams"))
    if n <= BROADCAST_ENTRIES and total <= BROADCAST_SHINGLES:
        # A row's shingles meet the index where the row is read; only hits go on, with the row's shingles.
        every = docs.select("doc_id", "text_key", "grams", F.explode(F.array_distinct("grams")).alias("g"))
        candidates = every.join(F.broadcast(index), "g")
    else:
        # Rows meet again by hashes of all they hold, as ids may be null or shared; whatever meets is verified.
        docs = docs.withColumn("row", F.xxhash64("doc_id", "text")).drop("text")
        entries = ws.put(index.select(F.xxhash64("item_id", "item_grams").alias("item"), "item_id", "item_grams", "g"))
        every = docs.select("row", F.explode(F.array_distinct("grams")).alias("g"))
        pairs = ws.put(salted_join(every, entries.select("item", "g"), "g").select("row", "item").distinct())
        sets = entries.select("item", "item_id", "item_grams").distinct()
        candidates = salted_join(pairs.join(docs, "row"), sets, "item")
    size, shared = F.size("item_grams"), F.size(F.array_intersect("item_grams", "grams"))
    counted = candidates.select("doc_id", "text_key", "item_id", size.alias("n"), shared.alias("s"))
    return counted.where(F.col("s") >= threshold * F.col("n") - 1e-9)


def find_leaks(
    documents: DataFrame,
    items: DataFrame,
    width: int = WIDTH,
    threshold: float = THRESHOLD,
    miss: float = MISS,
) -> DataFrame:
    """``doc_id, item_id, n_item_shingles, n_shared, containment`` of each item found in a document."""
    verified = _matches(documents, items, width, threshold, miss)
    best = verified.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("s") / F.col("n")).alias("c"), "n", "s")).alias("b"))
    return best.select(
        "doc_id",
        "item_id",
        F.col("b.n").cast("long").alias("n_item_shingles"),
        F.col("b.s").cast("long").alias("n_shared"),
        F.col("b.c").alias("containment"),
    )


def decontaminate(documents: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents in which no item is found; rows with a null id stay unless their text matches."""
    bad = _matches(documents, items, **options).select(F.col("doc_id").alias("_leaked"), F.col("text_key").alias("_text")).distinct()
    same = documents["doc_id"].eqNullSafe(bad["_leaked"]) & _text_key(documents).eqNullSafe(bad["_text"])
    return documents.join(bad, same, "left_anti")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = spark.read.parquet
    return find_leaks(read(f"{sf_dir}/documents.parquet"), read(f"{sf_dir}/benchmark.parquet"))


_WORDS = (
    "string_split(trim(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
    " '[^a-z0-9\\x{80}-\\x{10FFFF}]+', ' ', 'g')), ' ')"
)

OP2_SQL = f"""
WITH dw AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
d AS (
  SELECT DISTINCT doc_id, w[i:i + {WIDTH - 1}] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WIDTH - 2})) AS i FROM dw)
),
bw AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
b AS (
  SELECT DISTINCT item_id, w[i:i + {WIDTH - 1}] AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - {WIDTH - 2})) AS i FROM bw)
),
n AS (SELECT item_id, count(*) AS n FROM b GROUP BY item_id)
SELECT d.doc_id, b.item_id, max(n.n) AS n_item_shingles, count(*) AS n_shared, CAST(count(*) AS DOUBLE) / max(n.n) AS containment
FROM d JOIN b ON d.g = b.g JOIN n ON n.item_id = b.item_id
GROUP BY d.doc_id, b.item_id
HAVING count(*) >= {THRESHOLD} * max(n.n) - 1e-9
"""
