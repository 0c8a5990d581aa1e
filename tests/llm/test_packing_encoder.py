"""Words encoded apart give the ids of whole texts."""

import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from auditlake.llm import packing

PARTS = ["a", "b", " ", "\n", "\t", "\r", "\x1c", "　", " ", "'s", "é", "ß", "İ", "中", "ɐ", "1", ".", ",", "'", "  ", "\n ", "<|endoftext|>", "Ċ"]


def test_encoder_equals_whole_texts(monkeypatch):
    rng = random.Random(1)
    texts = ["", " ", "\n", ".", ",", "a.", "it's."] + ["".join(rng.choices(PARTS, k=rng.randint(0, 30))) for _ in range(4000)]
    path = public_tokenizers.path(packing.TOKENIZER)
    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    want = [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
    monkeypatch.setattr(packing, "CACHE", 200)  # words are forgotten and learnt again
    encoder = packing.Encoder(path, False)
    got = [x for i in range(0, len(texts), 50) for x in encoder.batch(texts[i : i + 50])]
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == want


def test_curve_visits_neighbours():
    cells = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    key = packing.hilbert_key(cells, 3)
    assert sorted(key.tolist()) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(1) == 1).all()


def test_bounds_of_tasks_change_nothing(spark):
    rng = random.Random(3)
    rows = [(2**53 + 1, "a b"), (None, "c"), (None, None), (5, "x " * 5000)] + [(i, " ".join(rng.choices(["red", "green", "der", "und", "42"], k=rng.randint(0, 60)))) for i in range(300)] + [(7, "same"), (7, "same")]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, bucket string").repartition(4)
    one, many = (sorted(map(str, packing.pack(docs, length=32, task_tokens=t).collect())) for t in (1 << 30, 300))
    assert one == many and len(one) > 300
    assert {r.doc_id for r in packing.pack(docs).select("doc_id").collect()} == {i for i, _ in rows}
