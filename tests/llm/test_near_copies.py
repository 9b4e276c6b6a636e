"""A large group of near copies none of which is near to all others."""

import random

import numpy as np
from pyspark.sql import functions as F

from panelfill.llm import order_minhash


def copies(n, words=100, share=0.03, seed=3):
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(words)]
    return [" ".join(f"x{k}y{i}" if rng.random() < share else w for i, w in enumerate(base)) for k in range(n)]


def classes_of(texts):
    scanner, name = order_minhash.Scanner({}), list(range(len(texts)))
    shingles = [order_minhash.shingles_of([t.encode()], scanner)[0].tolist() for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if name[i] != name[j] and order_minhash.aligned(shingles[i], shingles[j], 0.8) >= 0.8:
                low, high = sorted((name[i], name[j]))
                name = [low if x == high else x for x in name]
    return name


def test_pairs_of_a_wide_bucket_are_not_listed(spark, monkeypatch):
    texts, listed, similar = copies(200), [], order_minhash._similar

    def counted(pairs, *rest):
        listed.append(pairs.count())
        return similar(pairs, *rest)

    monkeypatch.setattr(order_minhash, "_similar", counted)
    monkeypatch.setattr(order_minhash, "TILE", 64)  # several tiles a bucket, several products a tile
    monkeypatch.setattr(order_minhash, "COLUMNS", 50)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in order_minhash.with_class(frame).collect()}
    assert got == dict(enumerate(classes_of(texts)))
    assert 1 < len(set(got.values())) < len(texts)
    assert listed[-1] < 5 * len(texts)


def test_shared_shingles():
    rng = np.random.default_rng(1)
    texts = [rng.choice(9000, size, replace=False).astype(np.uint64) for size in (1, 50, 3000, 7000)]
    got = order_minhash.shared_shingles(texts[:2], texts[2:] + texts[:1])
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in texts[2:] + texts[:1]] for a in texts[:2]]
