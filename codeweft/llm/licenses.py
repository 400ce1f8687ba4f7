"""Licence scans: normalised text compared to licence templates by Dice coefficient over word bigrams.

A text's bigrams that occur in a template are its hits there. For a template of
``n`` distinct bigrams two sorts of passages are compared: windows of as many words
as the template, one from each hit on, and the text as a whole. With ``c`` hits of
``d`` distinct bigrams among a passage's ``m`` bigrams, the passage has the size
``a = m - c + d`` (bigrams foreign to the template count as often as they occur) and
the Dice coefficient ``2 d / (a + n)``. That reaches the threshold ``t`` only if ``a``
and ``n`` differ by a factor of at most ``(2 - t) / t``: templates whose least size
isn't met by hits that lie within a window are pruned by the places of hits alone,
whole texts by their size. So a licence is found however it is wrapped and whatever
stands before and behind it. The best passage of each text and template is returned.

DataFrame functions only. Words are runs of ASCII letters and digits and of other
letters than ASCII ones; case of ASCII letters and everything else is dropped.

Defined cases: null and empty texts, and texts without a bigram, match nothing; texts
of any length are searched whole, and what is moved of them is their hits; repeated
rows give one result, and rows that share a doc_id (or have none) the best one for
each licence; ties go to the earliest passage, then to the shortest one; all licences
that are reached are returned; an empty table gives an empty result; extra columns,
whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.llm.decontam import let, normal_words
from codeweft.llm.license_texts import TEMPLATES
from codeweft.llm.salting import salted_join

THRESHOLD = 0.8
#: Template bigrams up to which they are broadcast: some 20 MB.
BROADCAST_BIGRAMS = 400_000


def bigrams(words: Column) -> Column:
    """Hashes of all neighbouring word pairs, in order."""
    last = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, 1, last), F.slice(words, 2, last), lambda a, b: F.xxhash64(a, b))


def template_table(spark: SparkSession, templates: dict[str, str], threshold: float) -> DataFrame:
    """``(g, license, n, m, need)``: a template's distinct bigrams, how many, how many in all, and the least size that can match."""
    rows = spark.createDataFrame(sorted(templates.items()), "license string, body string")
    grams = rows.select("license", let(normal_words(F.col("body")), bigrams).alias("every"))
    sets = grams.select("license", F.size("every").alias("m"), F.array_distinct("every").alias("own")).withColumn("n", F.size("own"))
    need = F.ceil(F.col("n") * threshold / (2 - threshold) - 1e-9).cast("int")
    return sets.select(F.explode("own").alias("g"), "license", "n", "m", need.alias("need"))


def _passages(threshold: float) -> Column:
    """All passages of a text and template that reach the threshold, from the sorted ``hits`` of the text."""

    def scored(held: Column, start: Column, m: Column) -> Column:
        d = F.size(F.array_distinct(F.transform(held, lambda h: h["g"])))
        size = m - F.size(held) + d
        return F.struct((2 * d / (size + F.col("n"))).alias("dice"), (-start).alias("before"), (-m).alias("long"))

    # Enough hits for the least size, from this one on, must lie within a window.
    ends = F.slice("hits", F.col("need"), F.greatest(F.size("hits"), F.lit(1)))
    close = F.zip_with("hits", ends, lambda a, b: F.when(b["pos"] - a["pos"] < F.col("m"), a["pos"]))
    starts = F.filter(F.transform(close, lambda p, i: F.struct(p.alias("pos"), i.alias("i"))), lambda s: s["pos"].isNotNull())

    def window(s: Column) -> Column:
        held = F.filter(F.slice("hits", s["i"] + 1, F.col("m")), lambda h: h["pos"] < s["pos"] + F.col("m"))
        return let(held, lambda w: scored(w, s["pos"], F.least(F.col("m"), F.col("size") - s["pos"])))

    distinct = F.size(F.array_distinct(F.transform("hits", lambda h: h["g"])))
    size = F.col("size") - F.size("hits") + distinct
    fits = size.between(F.col("need"), F.floor(F.col("n") * (2 - threshold) / threshold + 1e-9))
    whole = F.when(fits, F.array(scored(F.col("hits"), F.lit(0), F.col("size"))))
    every = F.concat(F.transform(starts, window), F.coalesce(whole, F.array().cast("array<struct<dice:double,before:int,long:int>>")))
    return F.filter(every, lambda p: p["dice"] >= threshold)


def scan_licenses(documents: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, license, dice, first_word, n_words``: the best passage of each text for each licence that it reaches.

    ``first_word`` counts the text's normalised words from 0.
    """
    table = template_table(documents.sparkSession, templates or TEMPLATES, threshold)
    rows = documents.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), let(normal_words(F.coalesce("text", F.lit(""))), bigrams).alias("every"))
    placed = rows.select("doc_id", "row", F.size("every").alias("size"), F.posexplode("every").alias("pos", "g"))
    if table.count() <= BROADCAST_BIGRAMS:
        hits = placed.join(F.broadcast(table), "g")
    else:
        hits = salted_join(placed, table, "g")
    # Copies of a row put their hits into one list, where they are the same ones.
    one = hits.groupBy("row", "license", "size", "n", "m", "need").agg(
        F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_set(F.struct("pos", "g"))).alias("hits")
    )
    best = one.where("size(hits) >= need").select("doc_id", "license", F.array_max(_passages(threshold)).alias("b")).where("b is not null")
    best = best.groupBy("doc_id", "license").agg(F.max("b").alias("b"))
    return best.select(
        "doc_id", "license", F.col("b.dice").alias("dice"), (-F.col("b.before")).cast("long").alias("first_word"), (1 - F.col("b.long")).cast("long").alias("n_words")
    )


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _words_sql(text: str) -> str:
    low = f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    bare = f"trim(regexp_replace({low}, '[^a-z0-9\\x{{80}}-\\x{{10FFFF}}]+', ' ', 'g'))"
    return f"string_split({bare}, ' ')"


_T_VALUES = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in TEMPLATES.items())

OP9_SQL = f"""
WITH t0 AS (SELECT license, {_words_sql('body')} AS w FROM (VALUES {_T_VALUES}) v(license, body)),
t1 AS (SELECT license, len(w) - 1 AS m, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM t0),
t AS (SELECT DISTINCT license, m, g FROM t1),
n AS (SELECT license, m, count(*) AS n FROM t GROUP BY ALL),
d AS (SELECT row_number() OVER () AS r, doc_id, {_words_sql('text')} AS w FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)),
p AS (SELECT r, len(w) - 1 AS size, unnest(range(1, len(w))) AS i, w FROM d),
h AS (SELECT p.r, p.size, p.i - 1 AS pos, t.license, t.g FROM p JOIN t ON t.g = p.w[p.i] || ' ' || p.w[p.i + 1]),
x AS (
  SELECT a.r, a.license, a.pos AS s, least(n.m, a.size - a.pos) AS m, n.n, count(*) AS c, count(DISTINCT b.g) AS d
  FROM h a JOIN n ON n.license = a.license JOIN h b ON b.r = a.r AND b.license = a.license AND b.pos BETWEEN a.pos AND a.pos + n.m - 1
  GROUP BY ALL
  UNION ALL
  SELECT h.r, h.license, 0, h.size, n.n, count(*), count(DISTINCT h.g) FROM h JOIN n ON n.license = h.license GROUP BY h.r, h.license, h.size, n.n
),
y AS (SELECT r, license, s, m, CAST(2 * d AS DOUBLE) / (m - c + d + n) AS dice FROM x)
SELECT doc_id, license, dice, s AS first_word, m + 1 AS n_words
FROM (SELECT d.doc_id, y.*, row_number() OVER (PARTITION BY d.doc_id, y.license ORDER BY dice DESC, s, m) AS k FROM y JOIN d ON d.r = y.r WHERE dice >= {THRESHOLD})
WHERE k = 1
"""
