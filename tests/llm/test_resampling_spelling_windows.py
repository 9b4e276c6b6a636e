"""Resampling, spelling variants and repeated windows against brute force on small odd tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelfill.llm import spelling, target_resampling, window_repeats

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    stems = ["garden", "window", "forêts", "Straße", "letters", "morning", "ÉCLAIRS", "x1"]
    vocabulary = stems * 6 + [s[:-1] + c for s in stems for c in "aé"] + [s + "s" for s in stems]
    free = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, long = free(40), free(9000)
    texts = [None, "", " \n\t ", "one", passage, passage, free(10) + " " + passage + "\t" + free(30), long, long + " tail",
             passage.replace(" ", "\n  ") + " " + passage, "a b " * 60, "日本語 😀 garden-window " * 9, " ".join(free(12).split()[:12])]
    texts += [free(rng.randint(1, 90)) for _ in range(40)]
    table = [(i, t) for i, t in enumerate(texts)]
    return table + [(None, passage), (None, passage), (4, passage), (4, long), (6, free(25))]


@pytest.fixture(scope="module")
def docs(spark, rows):
    """Extra columns bear the names that the operators add or use inside."""
    extra = {c: F.lit("clash") for c in ("n_words", "removed", "kept", "n_features", "weight", "score", "rank", "hashes", "spans", "word", "key")}
    return spark.createDataFrame(rows, SCHEMA).withColumns(extra).repartition(5)


def windows(rows, n):
    number = lambda d: 2 ** 63 - 1 if d is None else d
    split = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    least = {}
    for d, w in split:
        for i in range(len(w) - n + 1):
            k = tuple(w[i:i + n])
            least[k] = min(number(d), least.get(k, number(d)))
    for d, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if least[tuple(w[i:i + n])] < number(d):
                gone[i:i + n] = [True] * n
        yield d, len(w), tuple(i for i, g in enumerate(gone) if g), " ".join(x for x, g in zip(w, gone) if not g)


@pytest.mark.parametrize("n, chunk", [(13, window_repeats.CHUNK), (13, 700), (1, 1 << 20), (3, 1)])
def test_window_repeats(docs, rows, n, chunk):
    got = window_repeats.without_repeats(docs, n, chunk).collect()
    assert collections.Counter((r.doc_id, r.n_words, tuple(i for a, b in r.removed for i in range(a, b)), r.kept) for r in got) == collections.Counter(windows(rows, n))
    for r in got:  # intervals are maximal
        assert all(b < c for (_, b), (c, _) in zip(r.removed, r.removed[1:])) and r.word == "clash"


def test_window_repeats_without_rows(spark, docs):
    assert window_repeats.without_repeats(docs.limit(0)).count() == 0
    alone = spark.createDataFrame([(1, "a " * 50)], SCHEMA)
    assert window_repeats.without_repeats(alone).first().kept == " ".join(["a"] * 50)


def grams(text, n):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return [zlib.crc32(" ".join(w[i:i + k]).encode()) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


@pytest.mark.parametrize("n, buckets, piece", [(1, 10000, 1 << 18), (3, 97, 1 << 18), (2, 50, 16)])
def test_resampling(spark, docs, rows, n, buckets, piece, monkeypatch):
    monkeypatch.setattr(target_resampling, "PIECE", piece)
    for text in (t for _, t in rows):  # pieces of a text have the features of the whole
        assert sorted(np.concatenate([*target_resampling.features((text or "").encode(), n), np.zeros(0, int)]).tolist()) == sorted(grams(text, n))
    aim = [(1, "garden window 日本語 garden"), (2, None), (3, "")]
    target = spark.createDataFrame(aim, "item_id long, text string")
    s, t = (collections.Counter(g % buckets for _, x in table for g in grams(x, n)) for table in (rows, aim))
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    scored = []
    for d, text in rows:
        found = grams(text, n)
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[g % buckets] for g in found)
        scored.append((d, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + .5) / 2 ** 32)))))
    able = sorted((r for r in scored if r[1] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1], r[2]))
    for share in (10, 100):
        drawn = collections.Counter((*r, i + 1) for i, r in enumerate(able[:share * len(able) // 100]))
        rest = collections.Counter((*r, None) for r in scored)
        rest.subtract((*r[:4], None) for r in drawn.elements())
        got = target_resampling.with_rank(target_resampling.with_score(docs, target, n, buckets), share)
        assert collections.Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got.collect()) == +(drawn + rest)
    picked = target_resampling.resampled(docs, target, n, buckets, share=25).collect()
    assert sorted(r["rank"] for r in picked) == list(range(1, 25 * len(able) // 100 + 1))
    assert [(r.doc_id, r.score) for r in sorted(picked, key=lambda r: r["rank"])] == [(r[0], r[3]) for r in able[:len(picked)]]


def test_resampling_without_rows(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert target_resampling.with_rank(target_resampling.with_score(docs.limit(0), none)).count() == 0
    assert target_resampling.resampled(docs.limit(0), none).count() == 0
    assert target_resampling.with_score(docs, none).count() == docs.count()


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


@pytest.mark.parametrize("seed", range(4))
def test_lists_of_words(seed):
    rng = random.Random(seed)
    lists = [sorted({"".join(rng.choice("abé") for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(1, 60))}) for _ in range(4)]
    words, of = sum(lists, []), [k for k, x in enumerate(lists) for _ in x]
    new = np.array([i == 0 or of[i] != of[i - 1] for i in range(len(words))])
    asked = np.array([rng.random() < .7 for _ in words])
    a, b = spelling.one_edit(words, new, asked)
    want = [(i, j) for i in range(len(words)) for j in range(len(words)) if asked[i] and of[i] == of[j] and one_edit(words[i], words[j])]
    assert sorted(zip(a.tolist(), b.tolist())) == want


def spelt(rows, cut, least, least_count):
    total = collections.Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % cut == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            total[run] += 1
    n = {w: c for w, c in total.items() if len(w) >= least and c >= least_count}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {w: min(x, key=lambda y: (-n[y], y)) for w, x in near.items() if x}
    form = {w: f if n[f] >= 5 * n[w] else None for w, f in form.items()}

    def root(w):
        while form.get(w):
            w = form[w]
        return w
    return {(w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if form.get(w) else None) for w in n}


@pytest.mark.parametrize("cut, least, least_count, split", [(199, 6, 5, 20_000), (3, 1, 1, 20_000), (3, 2, 1, 2)])
def test_spelling(docs, rows, cut, least, least_count, split):
    words = spelling.vocabulary(docs, least, least_count, cut)
    got = spelling.with_forms(words, split).collect()
    assert {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == (want := spelt(rows, cut, least, least_count)) and len(got) == len(want)


def test_spelling_chain_and_long_words(spark):
    n = {"abcdefg" + "x" * k: 5 ** (9 - k) for k in range(9)} | {"z" * 3000: 7, "z" * 2999 + "y": 40, "z" * 3001: 1}
    got = {r.word: r for r in spelling.with_forms(spark.createDataFrame(list(n.items()), "word string, n long")).collect()}
    assert {got[w].root for w in n if w[0] == "a"} == {"abcdefg"} and got["abcdefg"].form is None
    assert got["z" * 3000].form == "z" * 2999 + "y" and got["z" * 3001].n_near == 1 and got["z" * 3001].root == "z" * 2999 + "y"
    assert spelling.with_forms(spark.createDataFrame([], "word string, n long")).count() == 0
