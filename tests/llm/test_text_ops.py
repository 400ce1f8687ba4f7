"""PII, packing, token counts and quality rules against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from conftest_llm import make

from codeweft.llm import packing, pii, quality, tokens

WORD = re.compile("[^\x20\x09-\x0d]+")


# ---- personal data


def plain_spans(text):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and pii.luhn(d.encode()):
            out.append((2, *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((3, *m.span()))
    return out


def test_base_spans_equal_the_patterns():
    rnd = random.Random(3)
    for _ in range(20_000):
        text = "".join(rnd.choice("a1.@-+ 0()%2é") for _ in range(rnd.randrange(40)))
        raw = text.encode()
        points = {len(text[:i].encode()): i for i in range(len(text) + 1)}
        assert [(k, points[a], points[b]) for k, a, b in pii.base_spans(raw)] == plain_spans(text)
    assert pii.base_spans(b"1" * 50_000 + b".2.3.4 " + b"a" * 50_000) == []


def test_find_pii(spark, nothing):
    card = "4012888888881881"
    texts = [f"é mail a.b@c.de, ip 1.2.3.4 +1 (555) 123-4567 {card}", None, "", "none"]
    got = sorted(pii.find_pii(make(spark, list(enumerate(texts)))).collect(), key=lambda r: r.doc_id)
    for r, text in zip(got, texts, strict=True):
        want = plain_spans(text or "")
        listed = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in want)
        assert r.spans == listed and r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest() and r.n_added == 0
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for k, _, _ in want) for i in range(4)]
    assert pii.find_pii(nothing).count() == 0


def test_contexts_discover_what_no_pattern_knows(spark):
    rows = [(i, f"call my phone number: +1 (555) 123-{4000 + i} today please word{i}") for i in range(8)]
    rows += [(50, "call my phone number: 0555-8887-66x today please"), (51, "serial 0555-8887-66x alone"), (52, "the code AB-12345-Q is no secret")]
    docs = make(spark, rows)
    got = {r.doc_id: r for r in pii.find_pii(docs).collect()}
    assert got[50].spans == "phone:22:35" and got[50].n_added == got[50].n_discovered == 1 and got[52].spans == "" and got[51].n_added == 0
    red = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert red[50].text == "call my phone number: <PHONE> today please" and red[0].text.startswith("call my phone number: <PHONE> today")
    assert red[50].kept == "k" and pii.redact(docs).columns == docs.columns


def plain_bootstrap(texts):
    """``(kind, start, end)`` in code points of all spans of every text, by dictionaries."""
    core = re.compile(r"[A-Za-z0-9\x80-\U0010ffff]")
    secret = re.compile(r"(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)[\"']?[ \t]*[:=][ \t]*[\"']([A-Za-z0-9+/_.=-]{16,})[\"']", re.I)
    fold = lambda t: t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    places, seeds, edges = [], [], defaultdict(Counter)  # (row, start, end, instance, patterns)
    kinds: dict = {}
    for row, t in enumerate(texts):
        spans = plain_spans(t) + [(4, *m.span(1)) for m in secret.finditer(t)]
        seeds.append(spans)
        w = [m.span() for m in WORD.finditer(t)]
        word = [fold(t[a:b]) for a, b in w]
        at = lambda i, word=word: word[i] if 0 <= i < len(word) else None

        def run(i, k, t=t, w=w, at=at):
            inner = [m.start() for m in core.finditer(t, w[i][0], w[i + k - 1][1])]
            whole = bool(core.search(t, *w[i])) and bool(core.search(t, *w[i + k - 1]))
            name = fold(t[inner[0] : inner[-1] + 1]) if inner else ""
            before = ("b", at(i - 2), at(i - 1)) if at(i - 1) is not None else None
            around = ("a", k, at(i - 1), at(i + k)) if at(i - 1) is not None and at(i + k) is not None else None
            return whole, name, (inner[0], inner[-1] + 1) if inner else (0, 0), before, around

        for kind, a, b in spans:
            i = max(n for n, x in enumerate(w) if x[0] <= a)
            j = max(n for n, x in enumerate(w) if x[0] < b)
            _, name, _, before, around = run(i, j - i + 1)
            for p in (before, around if j - i < 4 else None):
                if p:
                    edges[p][(name, kind)] += 1
            kinds.setdefault(name, kind)
        for k in range(1, 5):
            for i in range(len(w) - k + 1):
                whole, name, (a, b), before, around = run(i, k)
                free = whole and all(b <= x or a >= y for _, x, y in spans)
                places.append((row, a, b, name if free else None, [p for p in ((before,) if k == 1 else ()) + (around,) if p]))
    total = Counter(p for x in places for p in x[4])
    known, accepted, trusted = set(kinds), {}, {}
    while True:
        sure = {}
        for p, held in edges.items():
            for kind in {k for _, k in held}:
                mine = [n for (_, k), n in held.items() if k == kind]
                share = min(1, sum(mine) / total[p]) if total[p] else 1
                if len(held) >= 3 and len(mine) >= 3 and share >= 0.5:
                    sure[(p, kind)] = share
        new = {p for p, _ in sure} - {p for p, _ in trusted}
        trusted = sure
        names = {x[3] for x in places if x[3] and new & set(x[4])} - known
        taken = {}
        for name in names:
            mine = [x for x in places if x[3] == name]
            held = {p for x in mine for p in x[4]}
            scores = {}
            for kind in range(5):
                of = [p for p in held if (p, kind) in trusted]
                miss = 1.0
                for p in of:
                    miss *= max(1e-6, 1 - trusted[(p, kind)])
                inside = max((sum(any(p in of and p[0] == sort for p in x[4]) for x in mine) for sort in "ab"), default=0)
                if of and 1 - miss >= 0.5 and inside >= 0.5 * len(mine):
                    scores[kind] = 1 - miss
            if scores:
                taken[name] = min(scores, key=lambda k: (-scores[k], k))
        if not taken:
            break
        known |= set(taken)
        accepted |= taken
        for x in places:
            if x[3] in taken:
                for p in x[4]:
                    edges[p][(x[3], taken[x[3]])] += 1
    out = [set(x) for x in seeds]
    found = defaultdict(lambda: defaultdict(set))
    for row, a, b, name, ps in places:
        if name in accepted:
            for p in ps:
                for kind in range(5):
                    if (p, kind) in trusted:
                        found[(row, a, b)][kind].add(p)
    for (row, a, b), by in found.items():
        miss = {}
        for kind, ps in by.items():
            miss[kind] = 1.0
            for p in ps:
                miss[kind] *= max(1e-6, 1 - trusted[(p, kind)])
        out[row].add((min(miss, key=lambda k: (miss[k], k)), a, b))
    return [sorted(x) for x in out]


def test_accepted_instances_induce_patterns(spark):
    rows = [(i, f"call my phone number: +1 (555) 123-{4000 + i} today please word{i}") for i in range(8)]
    rows += [(20 + i, f"call my phone number: 0555-8887-6{i}x today please") for i in range(6)]
    rows += [(40 + i, f"reach the desk via 0555-8887-6{i}x until noon w{i}") for i in range(6)]
    rows += [(60, "reach the desk via anna[at]home until noon w"), (61, "home is anna and the rest")]
    got = {r.doc_id: r for r in pii.find_pii(make(spark, rows)).collect()}
    assert [got[i].n_added for i in (*range(20, 26), *range(40, 46), 60)] == [1] * 13 and got[61].n_added == 0
    assert got[60].spans == "phone:19:31"


@pytest.mark.parametrize("seed", range(4))
def test_bootstrap_equals_a_plain_version(spark, seed):
    rnd = random.Random(seed)
    some = lambda: rnd.choice(["red", "blue", "Green", "of", "the", "###", "é"])

    def thing():
        d = "".join(rnd.choice("0123456789") for _ in range(6))
        known = [f"+49 (30) {d}", f"u{d}@mail.example.com", f"10.0.{rnd.randrange(256)}.{rnd.randrange(256)}", f'token = "{d * 4}ab"']
        return rnd.choice([*known * 2, f"0{d[:3]}-{rnd.randrange(9)}x", f"anna [at] h{rnd.randrange(6)}", some(), f"K{rnd.randrange(12)}", "no such thing here"])

    leads = ["call me at", "write to", "host is", "the secret of", "send it via", "reach us by"]
    texts = [" ".join(x for _ in range(rnd.randrange(1, 4)) for x in (some(), rnd.choice(leads), thing() + rnd.choice(["", ",", "!"]), rnd.choice(["now", "or not", "and", ""]), some())) for _ in range(120)]
    texts += ["", texts[3], "at"]
    want = [",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in spans) for spans in plain_bootstrap(texts)]
    got = {r.doc_id: r.spans for r in pii.find_pii(make(spark, list(enumerate(texts)))).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert sum(len(x) for x in plain_bootstrap(texts)) > sum(len(plain_spans(t)) for t in texts)


def test_secrets_are_seeds(spark):
    value = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    rows = [(1, f'x token = "{value}"### y'), (2, f'TOKEN: "{value.upper()}"'), (3, f'name = "{value}"'), (4, 'token = "short"')]
    got = {r.doc_id: (r.spans, r.n_added, r.base_sha256) for r in pii.find_pii(make(spark, rows)).collect()}
    none = hashlib.sha256(b"").hexdigest()
    told = {r.doc_id: (r.n_secret, r.n_discovered) for r in pii.find_pii(make(spark, rows)).collect()}
    assert told[1] == told[2] == (1, 0) and told[3] == told[4] == (0, 0)
    assert got == {1: ("secret:11:51", 1, none), 2: ("secret:8:48", 1, none), 3: ("", 0, none), 4: ("", 0, none)}


def test_pii_on_awkward_rows(docs, rows):
    assert pii.find_pii(docs).count() == len(rows)
    same = sorted((repr((r.doc_id, r.text)) for r in pii.redact(docs).collect()))
    assert same == sorted(repr(r) for r in rows)


# ---- packing


def test_encoder_equals_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rnd = random.Random(5)
    alphabet = "abc dé\n\t  '’1２漢字🙂ß\x85　�.,!<|>"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(60))) for _ in range(3000)] + ["a<|endoftext|>b", "", "don't we'll I'M"]
    encode = packing.encoder()
    assert [list(encode(t)) for t in texts] == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("seed", range(3))
def test_plan_uses_up_the_histogram(seed):
    import numpy as np

    rnd = random.Random(seed)
    counts = np.zeros(101, np.int64)
    for _ in range(rnd.choice((0, 5, 3000))):
        counts[min(100, int(rnd.expovariate(0.03)) + 1)] += 1
    packed = packing.plan(counts, 100)
    used = Counter()
    for lengths, n in packed:
        assert sum(lengths) <= 100 and n > 0
        for v in lengths:
            used[v] += n
    assert used == {i: int(c) for i, c in enumerate(counts) if c}
    total = int((counts * np.arange(101)).sum())
    assert sum(n for _, n in packed) <= max(-(-total // 100) * 1.02 + 1, 0)


def test_pack(spark, docs, rows, nothing):
    out = packing.pack(docs, with_ids=True).collect()
    encode = packing.encoder()
    want = Counter()
    for i, text in rows:
        ids = [*(encode(text) if text else ()), 2]
        at = 0
        for k, n in enumerate([len(ids) % 1024 or 1024] + [1024] * ((len(ids) - 1) // 1024)):
            want[(i, k, at, n, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[at : at + n])))] += 1
            at += n
        assert at == len(ids)
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in out)
    by = defaultdict(list)
    for r in out:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(nothing).count() == 0


def test_places_by_join_equal_those_broadcast(docs, monkeypatch):
    told = lambda: Counter(tuple(r) for r in packing.pack(docs.coalesce(1)).collect())
    held = told()
    monkeypatch.setattr(packing, "BROADCAST_PLACES", 0)
    monkeypatch.setattr(packing, "STRETCH", 2)
    assert told() == held


# ---- token counts


def test_counts_equal_the_unigram_tokenizer(spark, docs, rows, nothing):
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces = tokens.vocabulary()
    whole = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    whole.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always", split=False)
    n = lambda t: len(whole.encode(t, add_special_tokens=False).ids) if t else 0
    got = sorted(((r.doc_id or -1), r.n_tokens) for r in tokens.count_tokens(docs).collect())
    assert got == sorted(((i or -1), n(t)) for i, t in rows)
    rnd, count = random.Random(7), tokens.Counter(pieces)
    for _ in range(3000):
        t = "".join(rnd.choice("ab the in\n▁é漢<s>🙂 ") for _ in range(rnd.randrange(25)))
        assert count(t) == n(t), repr(t)
    assert tokens.count_tokens(nothing).count() == 0


def test_ties_go_to_the_earliest_start():
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces = [("<unk>", 0.0)] + [(p, float(-s)) for p, s in (("a", 2), ("b", 2), ("ab", 4), ("ba", 4), ("aba", 6), ("▁", 1), ("▁a", 3), ("bb", 3))]
    whole = Tokenizer(models.Unigram(pieces, unk_id=0))
    whole.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always", split=False)
    count, rnd = tokens.Counter(pieces), random.Random(1)
    for _ in range(500):
        t = "".join(rnd.choice("ab ") for _ in range(1 + rnd.randrange(12)))
        assert count(t) == len(whole.encode(t, add_special_tokens=False).ids), t


# ---- quality


def plain_rules(text):
    w = WORD.findall(text or "")
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    repeated = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(repeated)


def test_rules(docs, rows, nothing):
    got = quality.judge(docs).collect()
    key = lambda r: (r[0] or -1, *r[1:])
    assert sorted(key((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in got) == sorted(key((i, *plain_rules(t))) for i, t in rows)
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept)
    assert quality.judge(nothing).count() == 0 and quality.keep_good(nothing).columns == nothing.columns


def discounts(t):
    y = t[0] / (t[0] + 2 * t[1]) if t[0] else 0.0
    out = []
    for k in range(3):
        d = k + 1 - (k + 2) * y * t[k + 1] / t[k] if t[k] else (k + 1) / 2
        out.append(min(max(d, 0.05), k + 0.95))
    return out


def plain_model(texts, order):
    """Interpolated modified Kneser-Ney by dictionaries: a function from n-grams to probabilities."""
    counts = {order: Counter(t[i : i + order] for t in texts for i in range(len(t) - order + 1))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    p, w, low = {b"": 1 / 256}, {}, {b"": 1 / 256}
    for k in range(1, order + 1):
        t = Counter(counts[k].values())
        d = discounts([t[i] for i in (1, 2, 3, 4)])
        total, mass = Counter(), defaultdict(float)
        for g, c in counts[k].items():
            total[g[:-1]] += c
            mass[g[:-1]] += d[min(c, 3) - 1]
        own = {g: (c - d[min(c, 3) - 1] + mass[g[:-1]] * low[g[1:]]) / total[g[:-1]] for g, c in counts[k].items()}
        w |= {x: mass[x] / total[x] for x in total}
        p |= own
        low = own

    def prob(g):
        return p[g] if g in p else w.get(g[:-1], 1.0) * prob(g[1:])

    return prob


def fold(t):
    return re.sub(rb"[0-9]", b"0", t.encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))))


def plain_scores(rows):
    """Log-perplexity of each ``(id, text, lang)``, or None."""
    import math

    models, out = {}, []
    for lang in {x for _, _, x in rows}:
        prose = [fold(t) for _, t, x in rows if x == lang and t and (r := plain_rules(t))[0] >= 10 and 100 * r[2] <= r[1]]
        models[lang] = plain_model(prose, quality.ORDER)
    for _, t, lang in rows:
        g = [fold(t)[k : k + 5] for k in range(len(fold(t)) - 4)] if t else []
        out.append(-sum(math.log(models[lang](x)) for x in g) / len(g) if g else None)
    return out


def plain_kept(rows):
    """Verdicts on ``(id, text, lang)``, from rules, scores and bands."""
    import math

    def median(values):
        return sorted(values)[(len(values) - 1) // 2]

    scores, rules = plain_scores(rows), [plain_rules(t) for _, t, _ in rows]
    failed = [r[0] < 10 or 100 * r[4] > 20 * r[0] for r in rules]
    size = [math.floor(math.log2(max(r[1], 1))) for r in rules]
    good = [n for n in range(len(rows)) if not failed[n] and scores[n] is not None]
    near = lambda x: math.floor(x + 0.5)
    kept = [not f for f in failed]
    for lang in {rows[n][2] for n in good}:
        mine = [n for n in good if rows[n][2] == lang]
        mid = median([near(1000 * scores[n]) for n in mine])
        off = {n: abs(near(1000 * scores[n]) - mid) for n in mine}
        root = {n: math.sqrt(1.5 * 2 ** size[n]) for n in mine}
        whole, scaled = median(list(off.values())), median([near(off[n] * root[n]) for n in mine])
        for n in mine:
            of = [off[m] for m in mine if size[m] == size[n]]
            spread = max(median(of) if len(of) >= quality.LEAST_CLASS else whole, scaled / root[n])
            wide = spread * 1.4826 * quality.BAND
            kept[n] = not wide or (mid - wide) / 1000 <= scores[n] <= (mid + wide) / 1000
    return kept, scores


def prose(rnd, alphabet, n):
    known = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(2, 8))) for _ in range(200)]
    return lambda k: " ".join(rnd.choices(known, [1 / (i + 4) for i in range(200)], k=k))


def test_bands_and_verdicts_equal_a_plain_version(spark):
    rnd = random.Random(31)
    rows = []
    for lang, letters in (("en", "etaoinshr"), ("de", "enisratdhu"), (None, "aeslrno")):
        say = prose(rnd, letters, 200)
        rows += [(len(rows) + k, say(rnd.choice((12, 40, 90, 200))), lang) for k in range(90)]
        rows += [(len(rows) + k, " ".join(w + rnd.choice(("###", "$$$", " |")) for w in say(50).split()), lang) for k in range(6)]
        rows += [(len(rows), "".join(rnd.choice("qxzjvk ") for _ in range(400)), lang), (len(rows) + 1, say(5), lang), (len(rows) + 2, None, lang)]
    rows += [(9000, "一二三四五六七八九十 " * 30, "xx"), (9001, "1 2 3", "xx")]
    df = spark.createDataFrame([(*r, "own", True) for r in rows], "doc_id long, text string, lang string, low string, kept boolean")
    kept, scores = plain_kept(rows)
    got = {r.doc_id: r for r in quality.judge(df).collect()}
    for (i, _, _), s in zip(rows, scores, strict=True):
        assert (got[i].log_ppl is None) == (s is None) and (s is None or abs(got[i].log_ppl - s) < 1e-4)
    assert [got[i].kept for i, _, _ in rows] == kept
    assert Counter(r.doc_id for r in quality.keep_good(df).collect()) == Counter(i for (i, _, _), k in zip(rows, kept, strict=True) if k)
    junk = [k for (_, t, _), k in zip(rows, kept, strict=True) if t and re.search(r"[#$|]", t)]
    assert len(junk) == 18 and not any(junk) and sum(kept) > 240


def test_perplexity_and_both_ways_of_scoring(spark, docs, rows, monkeypatch):
    from codeweft.sources.scratch import Workspace

    want = zip([i or -1 for i, _ in rows], plain_scores([(i, t, "en") for i, t in rows]), strict=True)
    got = [(r.doc_id or -1, None if r.log_ppl is None else round(r.log_ppl, 3)) for r in quality.judge(docs).collect()]
    assert sorted(map(repr, got)) == sorted(repr((i, None if s is None else round(s, 3))) for i, s in want)
    # Another corpus, so that n-grams are missing, and a model beyond the bound.
    ws = Workspace(spark, "t")
    model = quality.fit(docs.where("doc_id < 15"), ws)
    held = sorted((r.doc_id or -1, round(r.log_ppl or 0, 11)) for r in quality.score(docs, model, ["doc_id"], ws).collect())
    monkeypatch.setattr(quality, "BROADCAST_ENTRIES", 0)
    monkeypatch.setattr(quality, "CHUNK_BYTES", 1000)
    joined = sorted((r.doc_id or -1, round(r.log_ppl or 0, 11)) for r in quality.score(docs, model, ["doc_id"], ws).collect())
    assert held == joined


def test_bands_reject_the_odd_and_keep_the_clean(spark):
    from conftest_llm import words

    rnd = random.Random(9)
    rows = [(i, words(rnd, 60, 50)) for i in range(150)]
    rows.append((900, " ".join("".join(chr(rnd.randrange(0x4E00, 0x9000)) for _ in range(6)) for _ in range(40))))
    kept = {r.doc_id for r in quality.keep_good(make(spark, rows)).collect()}
    assert kept == set(range(150))


def test_both_bounds_reject_junk_of_the_same_alphabet(spark):
    rnd = random.Random(19)
    known = ["".join(rnd.choice("etaoinsrhl") for _ in range(rnd.randrange(3, 9))) for _ in range(300)]
    plain = lambda n: " ".join(rnd.choices(known, [1 / (k + 5) for k in range(300)], k=n))
    rows = [(i, plain(rnd.choice((60, 120, 240)))) for i in range(400)]
    rows.append((900, " ".join(rnd.choice(known[:8]) for _ in range(120))))  # the commonest words only, but hardly five in a row twice
    rows.append((901, " ".join(w + rnd.choice(("###", "$$$", " |")) for w in plain(120).split())))
    rows.append((902, " ".join("".join(rnd.sample(w, len(w))) for w in plain(120).split())))
    out = {r.doc_id: r for r in quality.judge(make(spark, rows)).collect()}
    assert not any(r.base_failed for r in out.values())
    middle = sorted(r.log_ppl for r in out.values())[len(out) // 2]
    assert out[900].log_ppl < middle < min(out[901].log_ppl, out[902].log_ppl)
    assert {i for i, r in out.items() if r.kept} == set(range(400))
