"""Language identification by compression.

For each language a raw-content zstandard dictionary is cut from labelled texts. A text
is encoded with every dictionary, in chunks so that long texts lean on the dictionary
and not on themselves, and the language of the smallest code wins. Of equal codes the
language with more labelled rows wins, then the first by name. Where the second code
is hardly larger, the margin is narrow and the answer is marked as rejected. What is
encoded is the whole text, lower-cased, with one space for each run of anything but
letters, so that neither case nor punctuation nor numbers count.

The dictionaries are fitted on a bounded sample: DICTIONARY bytes a language and
ALL_DICTIONARIES bytes in all, in pieces of PIECE characters, one a labelled text, chosen by a
hash of the row; LANGUAGES languages at most, those of most rows.

Defined cases: null texts and texts without a letter are ``und`` with score 0; so are all
texts if nothing was learned; a single learned language has score 1; rows repeat as they
are given; an empty table gives an empty result; other columns are ignored; rows with a
null id are judged like others.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.sources.scratch import workers_import_package

DICTIONARY = 1 << 18
ALL_DICTIONARIES = 1 << 25
LANGUAGES = 1000
PIECE = 512
CHUNK = 4096
LEVEL = 6
#: Margins below this, as a share of the second code, are narrow.
NARROW = 0.02
#: How much of a bit's odds a bit of difference is worth: codes of whole bytes overstate small differences.
TEMPER = 0.25
UNDETERMINED = "und"

_APART = re.compile(r"[\W\d_]+")


def folded(text: str) -> bytes:
    """What is encoded of a text; empty if it has no letter."""
    out = _APART.sub(" ", text.lower()).strip()
    return out.encode("utf-8", "replace") if any(map(str.isalpha, out)) else b""


@dataclass(frozen=True)
class Model:
    """Languages, those of more labelled rows first, and their dictionaries."""

    languages: tuple[str, ...]
    dictionaries: tuple[bytes, ...]


def fit(labelled: DataFrame, size: int = DICTIONARY, languages: int = LANGUAGES) -> Model:
    """A model of ``labelled(doc_id, text, lang)``; rows with a null text or language teach nothing."""
    rows = labelled.where("text is not null and lang is not null")
    known = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()
    size = min(size, ALL_DICTIONARIES // max(1, len(known)))
    most = max(1, 2 * size // PIECE)
    if not known:
        return Model((), ())
    # rows beyond the share that gives some twice the pieces needed aren't moved at all
    shares = labelled.sparkSession.createDataFrame([(r.lang, min(1.0, 2 * most / r.n)) for r in known], "lang string, share double")
    place = F.xxhash64("doc_id", "text")
    chosen = rows.join(F.broadcast(shares), "lang").where(F.pmod(place, F.lit(1 << 30)) < F.col("share") * (1 << 30))
    room = F.greatest(F.char_length("text") - PIECE, F.lit(1))
    start = F.pmod(F.shiftright(place, 31), room).cast("int") + 1
    piece = F.substring(F.col("text"), start, F.lit(PIECE)).alias("piece")
    pieces = chosen.select("lang", piece).distinct()
    nth = F.expr("row_number() over (partition by lang order by xxhash64(piece), piece)")
    kept = pieces.withColumn("nth", nth).where(F.col("nth") <= most).orderBy("lang", "nth")
    texts: dict[str, list[bytes]] = {r.lang: [] for r in known}
    for r in kept.collect():
        texts[r.lang].append(folded(r.piece))
    # the end of a dictionary is nearest to what is encoded, so all of it is used when it is cut at the front
    cut = {name: b" ".join(filter(None, parts))[-size:] for name, parts in texts.items()}
    names = [r.lang for r in known if cut[r.lang]]
    return Model(tuple(names), tuple(cut[n] for n in names))


class Coder:
    """Sizes of a text's code under each language's dictionary."""

    def __init__(self, model: Model):
        import zstandard

        self.languages, self.coders = model.languages, []
        for content in model.dictionaries:
            words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            words.precompute_compress(level=LEVEL)
            plain = dict(write_checksum=False, write_content_size=False, write_dict_id=False)
            self.coders.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=words, **plain))

    def sizes(self, text: bytes) -> list[int]:
        parts = [text[i : i + CHUNK] for i in range(0, len(text), CHUNK)]
        return [sum(len(c.compress(p)) for p in parts) for c in self.coders]

    def __call__(self, text: str | None) -> tuple[str, float, float]:
        """Language, score and margin."""
        content = folded(text) if text and self.languages else b""
        if not content:
            return UNDETERMINED, 0.0, 0.0
        sizes = self.sizes(content)
        least = min(sizes)
        score = 1 / sum(2.0 ** (-8 * TEMPER * (s - least)) for s in sizes)
        second = sorted(sizes)[1] if len(sizes) > 1 else None
        return self.languages[sizes.index(least)], score, 1.0 if second is None else (second - least) / second


_CODERS: dict[Model, Coder] = {}


def identify(documents: DataFrame, model: Model, narrow: float = NARROW) -> DataFrame:
    """``doc_id, lang_pred, score, margin, rejected`` of every row; ``rejected`` where the margin is below ``narrow``."""
    spark = documents.sparkSession
    sent = spark.sparkContext.broadcast(model)  # ALL_DICTIONARIES bytes at most

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if sent.value not in _CODERS:
            _CODERS.clear()
            _CODERS[sent.value] = Coder(sent.value)
        coder = _CODERS[sent.value]
        for b in rows:
            found = [coder(t.as_py()) for t in b.column(1)]
            names, scores, margins = zip(*found, strict=True) if found else ((), (), ())
            columns = [
                b.column(0),
                pa.array(names, pa.string()),
                pa.array(scores, pa.float64()),
                pa.array(margins, pa.float64()),
                pa.array([m < narrow for m in margins], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", "margin", "rejected"])

    workers_import_package(spark)
    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(batches, f"doc_id {kind}, lang_pred string, score double, margin double, rejected boolean")


def held_out(key: Column) -> Column:
    """Whether the checksum of an id as text is a multiple of 5; rows without an id aren't held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from those not held out; rows without an id teach nothing."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(documents.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))))
    found = identify(documents, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "margin", "rejected")
