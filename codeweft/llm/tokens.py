"""Token counts of a unigram tokenizer, without building tokens.

An Aho-Corasick automaton enumerates the vocabulary pieces that end at each
character; dynamic programming carries the best score and the number of pieces
there. Ties go as in the tokenizer: of equal scores the piece that starts
earliest wins, and the unknown piece only wins by a better score. Unknown
characters count as their UTF-8 bytes (byte fallback). Spaces become U+2581 and a
text gets one in front unless it starts with one.

Pieces never run from another character into U+2581, so a text falls apart into
chunks there; with whole-number scores sums are exact and chunks may be scored
alone, once each. If a vocabulary breaks either condition, texts are scored whole.

Defined cases: null and empty texts have 0 tokens; rows repeat as they are given;
an empty table gives an empty result; other columns than doc_id and text are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from codeweft.sources.scratch import workers_import_package

MARK = "▁"
#: Chunk counts that a worker keeps; beyond that it starts over.
CACHE = 200_000
_UNKNOWN_PENALTY = 10.0


def vocabulary(path: str | None = None) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter:
    """Counts the tokens of texts under one vocabulary."""

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.unknown = min(s for _, s in pieces) - _UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        names = {}
        for piece, score in pieces:
            if piece:
                names[piece] = score
        for piece, score in names.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        apart = not any(MARK in p.lstrip(MARK) for p in names) and all(float(s).is_integer() for s in names.values())
        line = "" if any("\n" in p for p in names) else "\n"
        self.chunks = re.compile(f"{line or '(?!)'}|{MARK}+[^{MARK}{line}]*|[^{MARK}{line}]+").findall if apart else None
        self.cache: dict[str, int] = {}

    def chunk(self, text: str) -> int:
        """Pieces of the best segmentation of ``text``."""
        n = len(text)
        score, count = [0.0] * (n + 1), [0] * (n + 1)
        best: float | None = None
        best_count, single, at = 0, False, 0
        unknown = self.unknown

        def close(end: int, best, best_count, single):
            if not single:
                candidate = score[end - 1] + unknown
                if best is None or candidate > best:
                    best, best_count = candidate, count[end - 1] + len(text[end - 1].encode("utf-8", "replace"))
            score[end], count[end] = best, best_count

        for last, (length, value) in self.automaton.iter(text):
            while at < last:  # characters at which no piece ends, and the one before this match
                at += 1
                close(at, best, best_count, single)
                best, best_count, single = None, 0, False
            start = last + 1 - length
            candidate = score[start] + value
            if best is None or candidate > best:
                best, best_count = candidate, count[start] + 1
            single = single or length == 1
        while at < n:
            at += 1
            close(at, best, best_count, single)
            best, best_count, single = None, 0, False
        return count[n]

    def __call__(self, text: str) -> int:
        if not text:
            return 0
        text = text.replace(" ", MARK)
        text = text if text[0] == MARK else MARK + text
        if self.chunks is None:
            return self.chunk(text)
        parts, cache = self.chunks(text), self.cache
        if len(cache) > CACHE:
            cache.clear()
        for part in set(parts).difference(cache):
            cache[part] = self.chunk(part)
        return sum(map(cache.__getitem__, parts))


_COUNTERS: dict[str | None, Counter] = {}


def counter(path: str | None = None) -> Counter:
    """This process's counter for a vocabulary file."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(vocabulary(path))
    return _COUNTERS[path]


def count_tokens(documents: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens``; ``path`` names a sentencepiece file, which every executor has."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for b in rows:
            n = pa.array([count(t) if t else 0 for t in b.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), n], ["doc_id", "n_tokens"])

    workers_import_package(documents.sparkSession)
    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(batches, f"doc_id {kind}, n_tokens long")


def op5_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
