"""The score against a plain context-tree weighting, node by node, and the lookup against a dictionary."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditlake.llm import ctw

ROWS = [(1, "Abracadabra"), (2, "banana bandana"), (3, "äbc déjà"), (None, "zz"), (5, "abra zq"), (2**53 + 1, None), (7, "cadabra banana" * 3), (7, "cadabra banana" * 3), (9, "")]


def choices(x, depth):
    data = b"\0" * depth + x + b"\0"
    for i in range(depth, len(data)):
        node = 1
        for j in range(7, -1, -1):
            bit = data[i] >> j & 1
            yield data[i - depth : i], node, bit
            node = 2 * node + bit


def plain(train, texts, depth):
    count, longer = defaultdict(lambda: [0, 0]), defaultdict(set)
    for x in train:
        for context, node, bit in choices(x, depth):
            for k in range(depth + 1):
                count[context[k:], node][bit] += 1
                if k:
                    longer[context[k:], node].add(context[k - 1 :])
    done = {}

    def weighted(context, node):
        if (context, node) not in done:
            a, b = count.get((context, node), (0, 0))
            own = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
            if len(context) == depth:
                done[context, node] = own, 1.0
            else:
                total = np.logaddexp(own, sum(weighted(x, node)[0] for x in longer.get((context, node), ()))) - math.log(2)
                done[context, node] = total, math.exp(own - math.log(2) - total)
        return done[context, node]

    for x in texts:
        score = 0.0
        for context, node, bit in choices(x, depth):
            chance, left = 0.0, 1.0
            for k in range(depth, -1, -1):
                a, w = count.get((context[k:], node), (0, 0)), weighted(context[k:], node)[1]
                chance += left * w * (a[bit] + 0.5) / (sum(a) + 1)
                left *= 1 - w
            score += math.log10(chance)
        yield score


@pytest.mark.parametrize(("depth", "shared", "part_grams"), [(2, 1000, 1000), (3, 0, 20), (5, 1000, 50), (5, 0, 50)])
def test_score_is_the_plain_one(spark, monkeypatch, depth, shared, part_grams):
    monkeypatch.setattr(ctw.code_lengths, "__defaults__", (depth, part_grams))
    docs = spark.createDataFrame([(*r, "x", 1) for r in ROWS], "doc_id long, text string, key string, batch int").repartition(3)
    got = ctw.score(docs, F.col("doc_id") % 2 == 1, depth=depth, shared_grams=shared, batch_bytes=100).collect()
    low = [(x or "").lower().encode() for _, x in ROWS]
    want = plain([x for (i, _), x in zip(ROWS, low, strict=True) if i and i % 2], low, depth)
    key = lambda r: (r[0] is None, r[0] or 0, round(r[1], 4))
    got, want = (sorted(x, key=key) for x in (((r.doc_id, r.score) for r in got), ((i, x) for (i, _), x in zip(ROWS, want, strict=True))))
    assert [i for i, _ in got] == [i for i, _ in want] and np.allclose([x for _, x in got], [x for _, x in want], atol=1e-4)


def test_no_training_rows_are_uniform(spark):
    docs = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string")
    assert {r.doc_id: r.bits_per_byte for r in ctw.score(docs, F.lit(False)).collect()} == {1: 8.0, 2: 8.0}


def test_long_text(spark):
    x = "lorem ipsum " * 300_000
    got = ctw.score(spark.createDataFrame([(1, x), (2, "lorem")], "doc_id long, text string"), F.col("doc_id") == 1).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {1: 600_001, 2: 2} and max(r.bits_per_byte for r in got if r.doc_id == 1) < 0.01


def test_lookup():
    rng = np.random.default_rng(0)
    key = np.unique(rng.integers(0, 1 << 48, 200_000).astype(np.uint64))
    bits = rng.random(len(key))
    ask = rng.integers(0, len(key), 1_000_000)
    assert (ctw.Lookup(key, bits)(key[ask]) == bits[ask]).all()
