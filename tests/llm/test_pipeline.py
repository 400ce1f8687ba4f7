"""The pipeline against plain code for every stage, with personal data, copies and leaks in its documents."""

from __future__ import annotations

import random
import re
import zlib
from collections import defaultdict

import numpy as np
from test_corpus_ops import plain_classes, plain_leaks
from test_text_ops import plain_kept, plain_spans, prose

import corpus_pipeline
from codeweft.llm import packing

KINDS = ("EMAIL", "IP", "CARD", "PHONE", "SECRET")
SECRET = re.compile(r"(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)[\"']?[ \t]*[:=][ \t]*[\"']([A-Za-z0-9+/_.=-]{16,})[\"']", re.I)


def plain_redacted(text):
    spans = plain_spans(text) + [(4, *m.span(1)) for m in SECRET.finditer(text)]
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{KINDS[kind]}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def documents(item):
    rnd = random.Random(11)
    said = {"en": prose(rnd, "etaoins", 0), "de": prose(rnd, "kmpqrüß", 0)}
    rows = []
    for i in range(90):
        lang = rnd.choice(["en", "en", "de"])
        text = said[lang](rnd.randrange(30, 90))
        if i % 9 == 0:
            mail, card = f"u{i}@host{i}.example.org", "4111 1111 1111 1111"
            text = text[:40] + f" {mail} 10.0.{i}.1 {card} +1 202 555 01{i:02d} " + text[40:] + f' token = "abcdef0123456789{i:04d}"'
        rows.append((i, text, lang))
    near = rows[5][1].split()
    rows += [(200, rows[4][1], rows[4][2]), (201, " ".join([*near[:-1], "other"]), rows[5][2]), (None, rows[4][1], rows[4][2])]
    rows += [(202, rows[7][1] + " " + item, rows[7][2]), (203, "too short", "en"), (204, None, "en"), (205, "", "de"), (None, None, None)]
    rows += [(206, said["en"](9000), "en"), (207, " ".join(["same five words again here"] * 12), "en"), (208, "zq9 " * 3 + said["en"](20), "en")]
    alone = said["de"](50)
    return rows + [(None, alone, "de"), (None, alone, "de"), (300, "x7", None)]


def test_pipeline(spark, tmp_path):
    rnd = random.Random(12)
    item = " ".join(f"leak{rnd.randrange(1000)}" for _ in range(25))
    rows = documents(item)
    made = [(i, t, lang, "s", 0) for i, t, lang in rows]
    spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, "short item"), (None, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    good = [(i, t) for (i, t, _), kept in zip(rows, plain_kept(rows)[0], strict=True) if kept]
    # of a class the smallest id stays, of several rows without one any
    classes, first = defaultdict(list), []
    for n, (_, size, c) in enumerate(plain_classes(good, 5)):
        key = ("class", c) if size and c is not None else ("text", good[n][1]) if size else ("alone", n)
        classes[key].append(good[n])
    for members in classes.values():
        first.append(min(members, key=lambda r: (r[0] is None, r[0] or 0)))
    leaked = {i for i, _, _ in plain_leaks(first, [(1, item)])}
    clean = [(i, plain_redacted(t)) for i, t in first if i not in leaked]
    assert len(rows) > len(good) > len(first) > len(clean) and leaked == {202}
    assert any("<EMAIL>" in t and "<SECRET>" in t for _, t in clean) and sum(i is None for i, _ in clean) == 1

    encode, want = packing.encoder(), []
    for i, t in clean:
        ids = np.array([*encode(t), packing.END], "<u4")
        want.append((i, len(ids), zlib.crc32(ids.tobytes()) if len(ids) <= 1024 else None))
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    got, sequences = defaultdict(list), defaultdict(list)
    for r in pieces:
        got[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert sorted(map(repr, want)) == sorted(repr((i, sum(r.length for r in rs), rs[0].ids_crc32 if len(rs) == 1 else None)) for i, rs in got.items())
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= 1.1 * sum(n for _, n, _ in want) / 1024 + 1
    assert len(corpus_pipeline.STAGES) == 5


def test_stages_of_nothing(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0 and (name == corpus_pipeline.STAGES[-1][0] or out.columns == docs.columns)
