"""The training-data operators against brute force, on a small table with nulls, ties, repeats and clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash

from auditlake.llm import ctw, embedding_dedup, exact_dedup, langid, line_dedup, mixing, packing, pii, simhash, substring_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, norm string, key string, runs string"
LONG = " ".join(f"w{i % 97}x{i % 13}" for i in range(4000))
BASE = " ".join(f"alpha{i}" for i in range(60))
ROWS = [
    (1, "The Cat sat. on the mat\nand the dog ran\nhome again today\nnow", "en", "a"), (2, "the cat sat. on the mat\nand the dog ran\nhome again today\nnow", "en", "a"),
    (3, "", "en", "b"), (4, None, None, None), (5, "Ünïcode ÀÉ déjà vu le chat et la souris", "fr", "b"), (6, LONG, "en", "c"), (7, LONG + " tail", "en", "c"),
    (8, BASE, None, "a"), (9, BASE, "de", None), (9, BASE, "de", None), (10, f"pre {BASE} post", "de", "c"), (11, "12345 !!! 9", "en", "a"),
    (12, "mail a.b@c-d.org_x@y.zz, ip 1.2.3.255 1.2.3.256 and card 4111 1111 1111 1111 or +1 (555) 123-4567", "en", "b"), (13, " \n\t ", "en", "b"), (14, "one two", "en", "a"),
    (15, "der Hund und die Katze " * 5, "de", "c"), (None, "le chien et le chat " * 5, "fr", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1, "x", "x", "x", "x") for r in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def lower(x):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in x or "")


def words(x):
    return re.findall(r"[^\x20\x09-\x0D]+", x or "")


def test_exact(docs, empty):
    got = exact_dedup.exact_groups(docs).collect()
    groups = {}
    for i, x, *_ in ROWS:
        groups.setdefault(lower(x), []).append(i)
    want = Counter((i, max((j for j in groups[lower(x)] if j is not None), default=None), len(groups[lower(x)]), hashlib.sha256(lower(x).encode()).hexdigest()) for i, x, *_ in ROWS)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)
    assert exact_dedup.exact_groups(empty).count() == 0


def test_exact_hot(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT_LEAST", 50)
    df = spark.range(300).selectExpr("id doc_id", "if(id % 2 = 0, 'Same', concat('t', id)) text")
    got = exact_dedup.exact_groups(df).where("text_sha256 = sha2('same', 256)").collect()
    assert {(r.keep_id, r.group_size) for r in got} == {(298, 150)} and sum(r.kept for r in got) == 1


def test_simhash(docs, empty):
    got = {(r.doc_id, r.fp) for r in simhash.fingerprints(docs).collect()}

    def brute(x):
        w = lower(x).encode().split()
        s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(t, 42) for t in s]
        v = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        return v - (1 << 64) if v >> 63 else v

    assert got == {(i, brute(x)) for i, x, *_ in ROWS}
    assert simhash.near_groups(empty).count() == 0
    comp = {r.doc_id: r.component_id for r in simhash.near_groups(docs).collect()}
    assert comp[2] == 1 and comp[9] == 8 and comp[4] == 3


@pytest.mark.parametrize("crowded", [4, 10**9])
def test_close_pairs(spark, crowded):
    rng = np.random.default_rng(1)
    seeds = rng.integers(-(2**63), 2**63 - 1, 20)
    fps = sorted({int(s) ^ (int(np.int64(1) << np.int64(a)) if a < 63 else -(1 << 63)) ^ (1 << b) for s in seeds for a, b in rng.integers(0, 62, (40, 2)).tolist()})
    got = simhash.components(simhash.close_pairs(spark.createDataFrame([(f,) for f in fps], "fp long"), crowded=crowded)).collect()
    a = np.array(fps, np.int64)
    label = np.arange(len(a))
    near = np.bitwise_count((a[:, None] ^ a[None]).view(np.uint64)) <= 2
    for _ in range(len(a)):
        new = np.where(near, label[None], len(a)).min(1)
        if (new == label).all():
            break
        label = new
    want = {(fps[i], fps[j]) for i, j in enumerate(label) if i != j}
    assert {(r.node, r.root) for r in got} == want


def test_pii(docs, empty):
    got = {r.doc_id: r for r in pii.find_pii(docs).collect()}
    x = ROWS[12][1]
    spans = sorted((s.start, pii.KINDS[s.rank - 1], x[s.start : s.end]) for s in got[12].base)
    assert [(k, t) for _, k, t in spans] == [("email", "a.b@c-d.org"), ("email", "_x@y.zz"), ("ip", "1.2.3.255"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (555) 123-4567")]
    assert sum(len(r.base) for r in got.values()) == 5 and pii.find_pii(empty).count() == 0


def pii_found(spark, texts):
    got = pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return {r.doc_id: sorted((texts[r.doc_id][s.start : s.end], pii.KINDS[s.rank - 1]) for s in r.added) for r in got}


def test_pii_discovers(spark):
    texts = [f"contact: +1 555 000 {1000 + i} now" for i in range(6)] + ["contact: 0555-123-4567 please", "time: 0555-123-4567 please"]
    assert pii_found(spark, texts) == {i: [("0555-123-4567", "phone")] if i == 6 else [] for i in range(8)}


def test_pii_bootstraps(spark):
    """Seeds induce "ring me on"; what it finds supports "reach her at", which has no seed and finds the last ones. Dates and sums stay."""
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    local = [f"0{rng.integers(100, 999)}-{rng.integers(100, 999)}-{rng.integers(1000, 9999)}" for _ in range(24)]
    texts, want = [], {}

    def say(before, value, kind=None):
        texts.append(f"{word()} {word()} {before} {value} {word()} {word()}")
        want[len(texts) - 1] = [(value, kind)] if kind else []

    for i in range(20):
        say("ring me on", f"+44 20 7946 {1000 + i}")
        say("paid on", f"2024-01-{10 + i}")
        say("the sum of", f"{rng.integers(100000, 999999)}.50")
        say("write to", f"user{i}@mail.example.org")
    for x in local[:8]:
        say("ring me on", x, "phone")
    for x in local[:8] + local[8:11]:
        say("reach her at", x, "phone")
    say("write to", "someone(at)mail9.example", "email")
    say("invoice", local[20])
    assert pii_found(spark, texts) == want


def test_pii_many_places_and_empty(spark, empty):
    x = "é " + "10.0.0.1 a@b.cc " * 3000
    r = pii.find_pii(spark.createDataFrame([(1, x), (None, None), (2, "")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [len(y.base) for y in r] == [0, 6000, 0] and all(x[s.start : s.end] == ("10.0.0.1" if s.rank == 2 else "a@b.cc") for s in r[1].base)


def brute_base(x):
    x = x or ""
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", x)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", x) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9](?:[\x20-]?[0-9])+", x):
        d = [int(c) for c in m.group() if c in "0123456789"][::-1]
        if 14 <= len(d) <= 19 and sum(c if i % 2 == 0 else 2 * c - 9 * (c > 4) for i, c in enumerate(d)) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 10 <= sum(c in "0123456789" for c in m.group()) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_pii_base_is_the_plain_scan(spark):
    rng = np.random.default_rng(2)
    parts = ["a.b@c.d", "@", ".", "1.2.3.4", "999", " ", "+", "4111 1111 1111 1111", "-", "(555)", "1234567890", "x", "é", "\n", "=", "12:34"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 14))) for _ in range(400)]
    got = pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: sorted((s.start, s.rank, s.end) for s in r.base) for r in got} == {i: sorted((a, pii.KINDS.index(k) + 1, z) for k, a, z in brute_base(x)) for i, x in enumerate(texts)}


def test_packing(docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    t.encode_special_tokens = True
    want = Counter((i, tuple(t.encode(x or "", add_special_tokens=False).ids) + (0,)) for i, x, *_ in ROWS)
    rows = packing.pack(docs, length=64).collect()
    held = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length and zlib.crc32(bytes(r.ids)) == r.ids_crc32 and held.get(r.sequence_id, 0) == r.offset
        held[r.sequence_id] = r.offset + r.length
    assert all(n == 64 for s, n in held.items() if s != max(held)) and sum(held.values()) == sum(len(x) * n for (_, x), n in want.items())
    whole = [(r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in packing.pack(docs, length=1 << 20).collect()]
    assert Counter(whole) == want and packing.pack(empty).count() == 0


@pytest.mark.parametrize("text", ["a b\nc", " lead", "trail ", "a  b", "a\n\nb", "x \n y", "tab\tb c", "é ü\xa0 z", "<|endoftext|> a", "", "don't we'll 12 34!"])
def test_encoder(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(packing.TOKENIZER)
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    assert np.frombuffer(packing.Encoder(path, False).batch([text])[0], "<u2").tolist() == t.encode(text, add_special_tokens=False).ids


def test_langid(docs, empty, spark):
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    got = [(r.doc_id, r.lang_pred) for r in langid.identify(docs, model).collect()]
    assert len(got) == len(ROWS) and {(3, "und"), (4, "und"), (11, "und"), (13, "und"), (15, "de"), (5, "fr")} <= set(got)
    assert langid.identify(empty, langid.fit(empty)).count() == 0


def test_langid_letters_and_rare_languages(spark):
    assert langid.words_of("² ½ ① Ⅷ 3 _") == [] and langid.words_of("Ab½c dÉf一") == ["ab", "c", "déf一"]
    rows = [(i, "the cat and the dog " * 3, "en") for i in range(400)] + [(1000 + i, "kissa ja koira", "fi") for i in range(4)]
    got = langid.identify(spark.createDataFrame([(1, "koira"), (2**53 + 1, "dog"), (None, "кот и собака")], "doc_id long, text string"), langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), lang_docs=20))
    got = {r.doc_id: (r.lang_pred, r.evidence) for r in got.collect()}
    assert got[1] == ("fi", 1.0) and got[2**53 + 1] == ("en", 1.0) and got[None][1] == 0


def test_langid_is_word_first_backoff(spark):
    rows = [(1, "aab aab abc", "x"), (2, "bca cab abc", "y")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    texts = ["aab zz", "abca", "bca q aab aab", "", None, "cabbca!"]

    def brute(text):
        count = {n: {l: Counter(g for i, t, k in rows if k == l for w in t.split() for g in ([w] if n == 0 else langid.grams_of(w, n))) for l in "xy"} for n in range(5)}
        log = lambda n, g, l: math.log10((count[n][l][g] + 0.5) / (sum(count[n][l].values()) + 0.5 * (len(set(count[n]["x"]) | set(count[n]["y"])) + 1)))
        total = {l: math.log10(0.5) for l in "xy"}
        for w in langid.words_of(text):
            for n in (0, 4, 3, 2, 1):
                known = [g for g in ([w] if n == 0 else langid.grams_of(w, n)) if any(count[n][l][g] for l in "xy")]
                if known:
                    for l in "xy":
                        total[l] += sum(log(n, g, l) for g in known) / len(known)
                    break
        if not langid.words_of(text):
            return "und", 0.0
        best = max("xy", key=lambda l: (total[l], l == "x"))
        return best, round(10 ** total[best] / sum(10 ** v for v in total.values()), 9)

    got = model.predict(texts)
    assert [(a, round(float(b), 9)) for a, b in zip(*got[:2], strict=True)] == [brute(x) for x in texts]


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    v = [(i, x.tolist()) for i, x in enumerate(np.repeat(rng.standard_normal((40, 8)), 5, axis=0) + 0.25 * rng.standard_normal((200, 8)))]
    odd = [(900, None), (901, []), (902, [0.0] * 8), (903, [float("nan")] * 8), (904, [1.0, None] * 4), (905, [1.0] * 7), (3, v[3][1]), (None, v[3][1])]
    df = spark.createDataFrame([(*r, "x") for r in v + odd], "vec_id long, embedding array<double>, rep string")
    for tile in (4096, 16):
        got = embedding_dedup.near_vectors(df, tile=tile).collect()
        x = np.array([a for _, a in v + odd[-2:]])
        ids = [i for i, _ in v] + [3, -(1 << 63)]
        x /= np.linalg.norm(x, axis=1)[:, None]
        link = x @ x.T >= 0.9
        label = list(ids)
        for _ in ids:
            label = [min(label[j] for j in np.flatnonzero(link[i])) for i in range(len(ids))]
        back = lambda i: None if i == -(1 << 63) else i
        want = Counter((back(i), int(link[k].sum()) - 1, back(label[k])) for k, i in enumerate(ids)) + Counter((i, 0, i) for i, _ in odd[:-2])
        assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == want
    assert embedding_dedup.near_vectors(df.where("false")).count() == 0


def test_embeddings_in_small_frames(spark, monkeypatch):
    """Copies of vectors leave in frames of bounded size, whatever number of tiles a cell has."""
    v = np.random.default_rng(8).standard_normal((300, 8))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    whole = sorted(tuple(r) for r in embedding_dedup.near_vectors(df, tile=8).collect())
    monkeypatch.setattr(embedding_dedup, "_FRAME", 1000)
    assert sorted(tuple(r) for r in embedding_dedup.near_vectors(df, tile=8).collect()) == whole and sum(r[1] for r in whole) > 0


def test_mixing(docs, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == len(ROWS) and all(0 <= r.probability <= 1 for r in got)
    assert {(r.doc_id, r.tokens) for r in got} == {(i, len(words(x))) for i, x, *_ in ROWS} and mixing.mix(empty).count() == 0


def test_topics_follow_words_not_languages(spark):
    rng = np.random.default_rng(1)
    fields = {"sea": ["harbour", "anchor", "sailor", "current"], "law": ["tribunal", "statute", "verdict", "counsel"]}
    rows = [(i, " ".join([*rng.choice(fields[f], 12), *rng.choice([f"{lang}word{k}" for k in range(5)], 12)]), lang, f) for i, (f, lang) in enumerate((f, x) for f in fields for x in ("en", "de") for _ in range(40))]
    docs = spark.createDataFrame([r for r in rows] + [(900, None, "en", None), (901, "a b c", "en", None)], "doc_id long, text string, lang string, source string")
    model = mixing.fit_topics(docs, 2)
    topic = {r.doc_id: r.topic for r in mixing.measure(docs, model).collect()}
    groups = {f: {topic[i] for i, _, _, g in rows if g == f} for f in fields}
    assert groups["sea"] != groups["law"] and all(len(x) == 1 for x in groups.values()) and topic[900] == topic[901] == "t-"


def test_topics_are_fitted_on_all_documents(spark):
    rng = np.random.default_rng(2)
    names = np.array([f"word{k}" for k in range(300)])
    rows = [(i, " ".join(names[(rng.integers(0, 60, 12) + 60 * (i % 5)) % 300]), ("en", "de", "fr")[i % 3], "s") for i in range(6000)] + [(6000, "", "en", "s"), (6001, None, "xx", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = mixing.fit_topics(docs.repartition(3), 4)
    again = mixing.fit_topics(docs.repartition(11).orderBy("text"), 4)
    assert np.array_equal(model.centres, again.centres) and np.array_equal(model.weights, again.weights) and len(model.centres) == 4
    terms = mixing.terms_of([x.encode().split() for _, x, *_ in rows[:6000]])
    weights = np.log(6001 / (1 + (terms > 0).sum(0))) + 1
    unit = terms * weights / np.linalg.norm(terms * weights, axis=1)[:, None]
    lang = np.array([x for _, _, x, _ in rows[:6000]])
    means = {x: unit[lang == x].mean(0) for x in set(lang)}
    assert np.allclose(model.weights, weights) and model.means.keys() == means.keys() and all(np.allclose(model.means[x], m, atol=1e-5) for x, m in means.items())
    rest = unit - np.stack([means[x] for x in lang])
    rest /= np.linalg.norm(rest, axis=1)[:, None]
    best = (rest @ model.centres.T).argmax(1)
    topic = {r.doc_id: r.topic for r in mixing.measure(docs, model).collect()}
    assert np.mean([topic[i] == f"t{k}" for i, k in enumerate(best)]) > 0.999 and topic[6000] == topic[6001] == "t-"
    for k in range(4):  # k-means: a centre is the direction of its own rows, but for what is left after the last round
        own = rest[best == k].sum(0)
        assert own @ model.centres[k] / np.linalg.norm(own) / np.linalg.norm(model.centres[k]) > 0.98


def test_marginals_report(docs):
    got = {(r.dim, r.value): (r.target, r.reached) for r in mixing.marginals(mixing.mix(docs)).collect()}
    for d in mixing.DIMS:
        assert np.isclose(sum(t for (k, _), (t, _) in got.items() if k == d), 1) and np.isclose(sum(x for (k, _), (_, x) in got.items() if k == d), 1)


def test_raking_meets_targets():
    import pandas as pd

    cells = pd.DataFrame([(s, g, t, 1000 + 37 * i) for i, (s, g, t) in enumerate((s, g, t) for s in "abc" for g in "xy" for t in "uv")], columns=["source", "lang", "topic", "tokens"])
    out = mixing.rake(cells, {"source": {"a": 0.5, "b": 0.3, "c": 0.2}})
    mass = (out["tokens"] * out["probability"]).groupby(out["source"]).sum()
    assert np.allclose(mass / mass.sum(), [0.5, 0.3, 0.2], atol=1e-6) and np.isclose(mass.sum() / cells["tokens"].sum(), 0.5)


def brute_repeats(rows, size):
    first = {}
    for i, x in sorted((-(1 << 63) if i is None else i, x) for i, x in rows if x):
        w = words(x)
        for p in range(len(w) - size + 1):
            first.setdefault(tuple(w[p : p + size]), i)
    for i, x in rows:
        w, own = words(x), -(1 << 63) if i is None else i
        gone = {q for p in range(len(w) - size + 1) if first[tuple(w[p : p + size])] < own for q in range(p, p + size)}
        kept = " ".join(x for q, x in enumerate(w) if q not in gone)
        yield i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept


def test_substring(docs, empty):
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.text) for r in substring_dedup.remove_repeats(docs).collect())
    assert got == Counter(brute_repeats([r[:2] for r in ROWS], 13)) and substring_dedup.remove_repeats(empty).count() == 0


def test_substring_without_filter(docs):
    got = Counter((r.doc_id, r.n_removed) for r in substring_dedup.remove_repeats(docs, size=3, filtered=0).collect())
    assert got == Counter((i, n) for i, _, n, *_ in brute_repeats([r[:2] for r in ROWS], 3))


def test_substring_random(spark):
    rng = np.random.default_rng(9)
    rows = [(int(i) if i % 17 else None, " ".join(rng.choice(["a", "b", "c"], int(rng.integers(0, 60))))) for i in rng.permutation(120)] + [(500, "a b c " * 100_000)]
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.text) for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), size=5).collect())
    assert got == Counter(brute_repeats(rows, 5))
    assert substring_dedup._depths(np.array([[1, 2], [1, 2], [1, 3], [2, 3]])).tolist() == [0, 2, 1, 0]


def test_substring_shuffled_runs(docs, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BROADCAST_BYTES", -1)
    got = Counter((r.doc_id, r.n_removed) for r in substring_dedup.remove_repeats(docs, size=3, filter_bits=64).collect())
    assert got == Counter((i, n) for i, _, n, *_ in brute_repeats([r[:2] for r in ROWS], 3))


def test_lines(spark, empty, monkeypatch):
    rng = np.random.default_rng(5)
    pool = [f"line {i}" for i in range(12)]
    rows = [(i, "\n".join(pool[(a + j) % 12] if rng.random() > 0.1 else f"own {i} {j}" for j in range(int(rng.integers(1, 14))))) for i, a in enumerate(rng.integers(0, 12, 60).tolist())] + [(90, ""), (91, None), (92, "\n\n\n")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, h string")
    cut = {r.doc_id: [(c["at"], c["n"]) for c in r.chunks] for r in line_dedup._with_chunks(df, line_dedup.WINDOW).where("text is not null").collect()}
    seen, want = set(), {}
    for i, x in rows:
        if x is None:
            want[i] = (None, 0)
            continue
        lines, kept, lost = x.split("\n"), [], 0
        assert all(n >= 2 for _, n in cut[i]) or len(lines) == 1
        assert [a for a, _ in cut[i]] == np.cumsum([0, *[n for _, n in cut[i]]]).tolist()[:-1] and sum(n for _, n in cut[i]) == len(lines)
        for a, n in cut[i]:
            chunk = "\n".join(lines[a : a + n])
            if n >= 2 and chunk in seen:
                lost += n
            else:
                kept.append(chunk)
            if n >= 2:
                seen.add(chunk)
        want[i] = ("\n".join(kept), lost)
    got = {r.doc_id: (r.text, r.n_removed_lines) for r in line_dedup.remove_repeated_chunks(df).collect()}
    assert got == want and sum(n for _, n in want.values()) > 0
    monkeypatch.setattr(line_dedup, "HOT_LEAST", 2)
    monkeypatch.setattr(line_dedup, "HOT_SHARE", 100)
    assert {r.doc_id: (r.text, r.n_removed_lines) for r in line_dedup.remove_repeated_chunks(df).collect()} == want
    assert line_dedup.remove_repeated_chunks(empty).count() == 0


def test_ctw(docs, empty, spark):
    from pyspark.sql import functions as F

    got = ctw.score(docs, F.col("doc_id") % 2 == 1, depth=2).collect()
    train = [lower(x).encode() for i, x, *_ in ROWS if i is not None and i % 2 == 1]
    c = Counter(w for x in train for w in x.split())
    n, v = sum(c.values()) + len(train), len(c) + 1
    lp = lambda k: math.log10((k + 0.5) / (n + 0.5 * (v + 1)))
    want = Counter((i, len(words(x)) + 1, sum(c[w] > 0 for w in lower(x).encode().split()) + 1, round(lp(len(train)) + sum(lp(c[w]) for w in lower(x).encode().split()), 6)) for i, x, *_ in ROWS)
    assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want and {r.train_tokens for r in got} == {n}
    assert ctw.score(empty, F.lit(True)).count() == 0


CLASH = "doc_id long, text string, lang string, source string, gone_id long, kept_id long, drawn_id long, own_id string, topic string, probability string, nth long"


@pytest.fixture(scope="module")
def stage_docs(spark):
    big = 2**53 + 1
    rows = [(big, "the cat sat on the mat", "en", "a"), (None, "the dog ran home", "en", "a"), (None, None, None, None), (9, "dup text here", "en", "b"), (5, "Dup text here", "en", "b"),
            (5, "own text of five", "en", "b"), (2, "der Hund und die Katze", "de", "c"), (2, "der Hund und die Katze", "de", "c"), (3, "", "en", "a"), (4, "12 34", None, "a"), (6, LONG, "en", "c"), (8, LONG + " tail", "en", "c"), (8, "unrelated words of eight", "en", "c")]
    return spark.createDataFrame([(*r, big, None, 1, "x", "x", "x", i) for i, r in enumerate(rows)], CLASH).repartition(3)


def kept(df, docs):
    assert df.columns == docs.columns and [f.dataType for f in df.schema] == [f.dataType for f in docs.schema]
    got = df.collect()
    assert all(r.gone_id == 2**53 + 1 and r.kept_id is None for r in got)
    return sorted(r.nth for r in got)


def test_stage_language(stage_docs):
    assert kept(langid.keep_identified(stage_docs), stage_docs) == [0, 1, 3, 4, 5, 6, 7, 10, 11, 12]
    assert langid.keep_identified(stage_docs.where("false")).count() == 0


def test_stage_exact(stage_docs):
    got = kept(exact_dedup.keep_one(stage_docs), stage_docs)
    assert got in ([0, 1, 3, 5, x, 8, 9, 10, 11, 12] for x in (6, 7))
    assert exact_dedup.keep_one(stage_docs.where("false")).count() == 0


def test_stage_near(stage_docs):
    assert kept(simhash.keep_one(stage_docs), stage_docs) == [0, 1, 2, 4, 5, 6, 7, 8, 9, 10, 12]
    assert simhash.keep_one(stage_docs.where("false")).count() == 0


def test_stage_mixing(stage_docs):
    mixed = {(r.doc_id, r.source, r.lang, r.topic): r.sampled for r in mixing.mix(stage_docs).collect()}
    topic = {r.doc_id: r.topic for r in mixing.measure(stage_docs, mixing.fit_topics(stage_docs)).collect()}
    got = kept(mixing.keep_sampled(stage_docs), stage_docs)
    rows = {r.nth: r for r in stage_docs.collect()}
    assert sum(mixed.values()) > 0 and topic
    draws = {r.nth for r in rows.values() if any(s and k[0] == r.doc_id and k[1] == (r.source or "?") and k[2] == (r.lang or "?") for k, s in mixed.items())}
    assert set(got) <= draws and {n for n in draws if rows[n].doc_id not in (5, 8, None)} <= set(got)
    assert mixing.keep_sampled(stage_docs.where("false")).count() == 0


def test_pipeline(spark, stage_docs, tmp_path):
    import corpus_pipeline

    stage_docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stash(stage(spark, docs, str(tmp_path)))
        seen.append(docs.count())
    assert seen[0] == 10 and seen[1] == 8 and seen[2] == 7 and docs.columns == stage_docs.columns
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = Counter(r.doc_id for r in docs.collect())
    assert Counter(r.doc_id for r in pieces if r.start == 0) == want
    stage_docs.where("false").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_exact_sql():
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [r[:2] for r in ROWS])
    assert len(con.execute(exact_dedup.ORACLES["op5_exact_dedup"]).fetchall()) == len(ROWS)
