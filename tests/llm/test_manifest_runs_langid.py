"""Manifest, periodic runs and language identification against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import make
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeweft.functions.text import LOWER, UPPER
from codeweft.llm import langid, manifest, periods
from codeweft.llm import words as wd

WORD = re.compile("[^\x20\x09-\x0d]+")
FOLD = str.maketrans(UPPER, LOWER)
DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


# ---- manifest


def plain_manifest(rows):
    def leaf(*values):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
        return levels

    def path(levels, i):
        out = []
        for nodes in levels[:-1]:
            r = i // 16 * 16
            out.append(("".join(nodes[r:i]), "".join(nodes[i + 1 : r + 16])))
            i //= 16
        return out

    sources = defaultdict(list)
    for d, s, lang, n, t in rows:
        own = leaf(d, s, lang, n, t)
        changed = d is not None and t is not None and zlib.crc32(str(d).encode()) % 5 == 0
        sources[s].append((d, own, leaf(d, s, lang, n, t.translate(FOLD)) if changed else own))
    groups = []
    for s in sorted(sources, key=lambda s: (s is not None, (s or "").encode())):
        members = sorted(sources[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        groups.append((members, tree([m[1] for m in members])))
    top = tree([levels[-1][0] for _, levels in groups])
    root, out = top[-1][0], []
    for k, (members, levels) in enumerate(groups):
        for i, (d, own, found) in enumerate(members):
            steps = path(levels, i) + path(top, k)
            for a, b in steps:
                found = sha(a + found + b)
            out.append((d, own, levels[-1][0], root, sha("".join(a + b for a, b in steps)), found, found == root))
    return out


def awkward_rows():
    rows = []
    for i in range(1400):
        source = "hot" if i % 3 else None if i % 5 == 0 else f"s{i % 70}é"
        text = None if i % 11 == 0 else "" if i % 12 == 0 else f"Té{i % 7}XT " * (1 + (i == 50) * 20_000)
        rows.append((i if i % 97 else None, source, None if i % 4 == 0 else "en", i % 50, text))
    return rows + rows[:40] + [(7, "", "en", None, "Empty source")]


def manifest_of(df):
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.translate("text", UPPER, LOWER))
    return Counter(map(tuple, manifest.manifest(df, tampered).collect()))


def test_manifest(spark):
    rows = awkward_rows()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], f"{DOCS}, root string, pos int").repartition(5)
    got = manifest_of(df)
    assert got == Counter(plain_manifest(rows))
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)
    assert all(r.verified for r in manifest.manifest(df).select("verified").distinct().collect())


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 257])
def test_manifest_sizes(spark, n):
    rows = [(i, "one", "en", i, f"T{i}") for i in range(n)]
    assert manifest_of(spark.createDataFrame(rows, DOCS)) == Counter(plain_manifest(rows))


def test_manifest_of_nothing(spark):
    assert manifest.manifest(spark.createDataFrame([], DOCS)).count() == 0


def test_manifest_of_the_table(spark):
    at = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()
    assert Counter(map(tuple, manifest.op13_merkle_manifest(spark, at).collect())) == Counter(plain_manifest([tuple(r) for r in rows]))


# ---- periodic runs


def plain_runs(w):
    best = {}
    for q in range(1, len(w) // 4 + 1):
        i = q
        while i < len(w):
            if w[i] != w[i - q]:
                i += 1
                continue
            j = i
            while j < len(w) and w[j] == w[j - q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                best.setdefault((i - q, j - i + q), q)
            i = j
    return sorted(((a, n, q) for (a, n), q in best.items()), key=lambda r: (r[0], r[2]))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=6), st.integers(1, 9)), max_size=6))
def test_runs_of_repeated_pieces(pieces):
    text = [x for piece, times in pieces for x in piece * times]
    assert periods.runs_of(text) == plain_runs(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 1), max_size=70))
def test_runs_of_two_letters(text):
    assert periods.runs_of(text) == plain_runs(text)


def test_candidates_hold_every_run():
    rnd = random.Random(5)
    for _ in range(60):
        rows = []
        for _ in range(rnd.randrange(1, 5)):
            piece = [f"w{rnd.randrange(4)}" for _ in range(rnd.randrange(1, 8))]
            rows.append(" ".join([f"v{rnd.randrange(30)}" for _ in range(rnd.randrange(40))] + piece * rnd.randrange(8) + ["end"] * rnd.randrange(9)))
        data, offsets = wd.utf8(pa.array(rows))
        starts, ends = wd.spans(data, offsets)
        first = wd.per_row(starts, offsets)
        held = periods.candidates(wd.hashes(data, starts, ends), first)
        for r, text in enumerate(rows):
            for a, n, _ in plain_runs(text.split()):
                assert any(lo <= first[r] + a and first[r] + a + n <= hi for lo, hi in held)


def test_end_positions_stay_ordered():
    rnd = random.Random(6)
    values = rnd.sample(range(10_000), 4000)
    ends = periods.EndPositions(values[0])
    for k, x in enumerate(values[1:], 1):
        if k % 50 == 1:
            before = [v for v in values[:k] if v < x]
            behind = [v for v in values[:k] if v > x]
            assert ends.insert(x) == (max(before, default=None), min(behind, default=None))
        else:
            ends.insert(x)
    assert list(ends) == sorted(values) and ends.size == len(values)


def test_long_runs_are_quick():
    assert periods.runs_of([7] * 60_000) == [(0, 60_000, 1)]
    assert periods.runs_of(list(range(1000)) * 60) == [(0, 60_000, 1000)]


def plain_op11(rows):
    out = []
    for d, t in rows:
        w = WORD.findall(t or "")
        n, how = len(w), None
        if n and d is not None and (h := zlib.crc32(str(d).encode())) % 10 == 0:
            g = h // 10
            how = g % n, 1 + (n - g % n) // (3 + g % 8)
            w = [w[i] if i < how[0] else w[how[0] + (i - how[0]) % how[1]] for i in range(n)]
        runs = plain_runs(w)
        drop = {i for a, m, q in runs for i in range(a + q, a + m)}
        top = None
        for r in runs:
            if top is None or r[1] * top[2] > top[1] * r[2]:
                top = r
        shown = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
        lines = "".join(f"{a},{m},{q}\n" for a, m, q in runs)
        out.append((d, len(runs), *shown, sha(lines), sha(" ".join(x for i, x in enumerate(w) if i not in drop))))
    return out


def test_op11_rows(spark, docs, rows, nothing, tmp_path):
    extra = [(1000 + i, "a b c d e f g h i j " * (1 + i % 7)) for i in range(200)] + [(5, "x " * 30 + "y z " * 20), (5, "x " * 30 + "y z " * 20)]
    make(spark, [*rows, *extra]).write.parquet(f"{tmp_path}/documents.parquet")
    got = periods.op11_periodic_runs(spark, str(tmp_path))
    assert got.columns[:2] == ["doc_id", "n_runs"]
    short = [(d, t) for d, t in [*rows, *extra] if len(t or "") < 20_000 or " " not in t]
    want = Counter(plain_op11(short))
    ids = {d for d, t in rows if (d, t) not in short}
    assert Counter(tuple(r) for r in got.collect() if r.doc_id not in ids) == want
    assert any(r[1] for r in want) and periods.periodic_runs(nothing).count() == 0


# ---- language


LETTERS = {"aa": "the and ing tion er ou", "bb": "der die und ung lich ß", "cc": "le de que ment eux é"}


def spoken(rnd, lang, n):
    parts = LETTERS[lang].split()
    return " ".join("".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 4))) for _ in range(n))


def test_languages(spark):
    rnd = random.Random(8)
    rows = [(i, spoken(rnd, lang := rnd.choice(["aa", "aa", "bb", "cc"]), rnd.randrange(5, 200)), lang) for i in range(600)]
    df = spark.createDataFrame([(*r, "z", 0.5) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    model = langid.fit(df.where("doc_id < 400"), size=20_000)
    assert set(model.languages) == set(LETTERS) and model.languages[0] == "aa" and max(map(len, model.dictionaries)) <= 20_000
    got = {r.doc_id: r for r in langid.identify(df.where("doc_id >= 400"), model).collect()}
    right = [got[i].lang_pred == lang for i, _, lang in rows[400:]]
    assert len(got) == 200 and np.mean(right) > 0.97 and all(0 <= r.score <= 1 for r in got.values())
    assert all(got[i].lang_pred == lang for i, _, lang in rows[400:] if not got[i].rejected and got[i].margin > 0.05)
    loud = {r.doc_id: r.lang_pred for r in langid.identify(df.where("doc_id >= 400").withColumn("text", F.upper("text")), model).collect()}
    assert np.mean([loud[i] == lang for i, _, lang in rows[400:]]) > 0.97


def test_languages_of_awkward_rows(spark, docs, rows, nothing):
    model = langid.Model(("xx", "yy"), (b"w1 w2 w3 w4", b"same line here one two"))
    got = Counter((r.doc_id, r.lang_pred == "und", r.score == 0) for r in langid.identify(docs, model).collect())
    lettered = lambda t: any(map(str.isalpha, t or ""))
    assert got == Counter((i, not lettered(t), not lettered(t)) for i, t in rows)
    assert langid.identify(nothing, model).count() == 0 and langid.fit(nothing) == langid.Model((), ())
    assert {r.lang_pred for r in langid.identify(docs, langid.Model((), ())).collect()} == {"und"}
    tie = langid.identify(make(spark, [(1, "qqq")]), langid.Model(("more", "less"), (b"same", b"same"))).first()
    assert (tie.lang_pred, tie.margin, tie.rejected, tie.score) == ("more", 0.0, True, 0.5)


def test_held_out_accuracy_of_the_table(spark):
    at = "/root/testdata/sf0.01"
    known = spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "lang")
    got = langid.op12_language_id(spark, at).join(known, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got) and len(got) == known.count()
    judged = [r.lang == r.lang_pred for r in got if r.held_out]
    assert len(judged) > 150 and np.mean(judged) > 0.97
