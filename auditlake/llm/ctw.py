"""Operator 3, LM scoring by context-tree weighting over bytes.

A byte is eight binary choices on a path through 255 nodes. Each node has a context tree over the DEPTH preceding bytes, whose
nodes hold Krichevsky-Trofimov estimates of the training texts' choices. Weighting mixes, at each context, its own estimate with
the product over its longer contexts, one half each, which gives every depth a posterior weight. No context is pruned: the tree
grows with the corpus and is never gathered in one place.

1. Grams, DEPTH bytes of context and the byte after them, are counted over the whole corpus, training texts by their number.
2. Subtrees below the contexts of two bytes are worked off apart, many to a task; only sums for the contexts of one byte (256
   times 255 numbers) reach the driver, which weights the two top levels. So each gram gets its code length.
3. Up to SHARED_GRAMS grams, their code lengths are broadcast. Beyond, texts are dealt to batches and the lengths of a batch's own
   distinct grams are joined to it (a gram is at most once in a batch, so no key is hot). Both give the same scores.

The baseline beside it is a smoothed word unigram; its counts stay distributed, but for the FREQUENT commonest words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, give_back, small_batches, stash, table

DEPTH = 5
#: Grams that a task builds trees of; grams whose code lengths are broadcast (12 bytes each); bytes of text that share a dictionary beyond.
PART_GRAMS, SHARED_GRAMS, BATCH_BYTES = 150_000, 4_000_000, 16 << 20
#: Words whose counts are broadcast, and their greatest length in bytes; all other words are joined by shuffling.
FREQUENT, WORD_BYTES = 1 << 17, 64
_CHUNK, _SLOTS, _HELD, _WORDS, _ROWS = 1 << 20, 22, 2_000_000, 300_000, 1000
_NONE = {"uid": 0, "doc_id": 0, "no_id": True, "trained": False, "n_tokens": 0, "n_known": 0, "base": 0.0, "size": 0, "bits": 0.0, "word": None, "n": 0}
_MIX = np.uint64(0x9E3779B97F4A7C15)


# -- grams ------------------------------------------------------------------------------------------------------------


def _chunks(texts: Iterator[bytes]) -> Iterator[list[bytes]]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= _CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def grams(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The gram of every byte of the texts and of one zero byte at each end, and each text's first place. Before a text are zeros."""
    pad = b"\0" * depth
    data = np.frombuffer(b"".join(pad + t + b"\0" for t in texts), np.uint8)
    key = np.zeros(max(0, len(data) - depth), np.uint64)
    for i in range(depth + 1):
        key = (key << np.uint64(8)) | data[i : len(data) - depth + i]
    length = np.array([len(t) + 1 for t in texts], np.int64)
    start = np.cumsum(length) - length
    own = np.ones(len(key), bool)
    if depth and len(texts) > 1:  # places inside the padding of all texts but the first
        first = start[1:] + depth * np.arange(1, len(texts))
        own[(first[:, None] - 1 - np.arange(depth)[None]).ravel()] = False
    return key[own], start


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    key, which = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(which, np.concatenate(counts), minlength=len(key)).astype(np.int64)


def count_grams(texts: DataFrame, depth: int) -> DataFrame:
    """(key, c) of every gram of the texts; c counts the training rows alone. texts: text (binary), trained."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, counts, size = [], [], 0
        for b in batches:
            for trained in (True, False):
                for part in _chunks(x.lower() for x in b["text"][b["trained"] == trained]):
                    key, n = np.unique(grams(part, depth)[0], return_counts=True)
                    keys.append(key), counts.append(n * trained)
                    size += len(key)
            if size > _HELD:
                key, n = _summed(keys, counts)
                keys, counts, size = [key], [n], len(key)
                if size > _HELD // 2:
                    yield pd.DataFrame({"key": key.view(np.int64), "c": n})
                    keys, counts, size = [], [], 0
        key, n = _summed(keys, counts)
        yield pd.DataFrame({"key": key.view(np.int64), "c": n})

    return texts.select("text", "trained").mapInPandas(give_back(run), "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))


# -- trees ------------------------------------------------------------------------------------------------------------


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma for x > 0 by Stirling's series, after moving x beyond 8."""
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        low = y < 8
        shift[low] += np.log(y[low])
        y[low] += 1
    z = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y - shift


def _kt(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    """ln of the KT probability of these numbers of choices."""
    return _log_gamma(zero + 0.5) + _log_gamma(one + 0.5) - _log_gamma(zero + one + 1) - np.log(np.pi)


def _weighted(own: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ln of the weighted probability, and the posterior weight of the own estimate."""
    total = np.logaddexp(own, below) - np.log(2)
    return total, np.exp(own - np.log(2) - total)


def subtrees(key: np.ndarray, c: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For whole subtrees below contexts of two bytes: the chance of each choice of each gram from depth two on (eight a row), and
    the sums of the weighted logarithms at depth two, a row for each context of one byte and a column for each node."""
    byte = (key & np.uint64(255)).astype(np.int64)
    count = c.astype(float)
    chance = np.zeros((len(key), 8))
    top = np.zeros((256, 256))
    before: list[tuple[np.ndarray, np.ndarray]] = []  # of the longer contexts: a gram of each node, the weighted logarithm
    for d in range(depth, 1, -1):
        low = key & np.uint64((1 << (8 * (d + 1))) - 1)
        order = np.argsort(low, kind="stable")
        low, n, own_byte = low[order], count[order], byte[order]
        here = []
        for j in range(8):
            place = low >> np.uint64(8 - j)  # context and the path to the node
            head = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
            bit = (own_byte >> (7 - j)) & 1
            one = np.add.reduceat(n * bit, head)
            zero = np.add.reduceat(n, head) - one
            run = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(low))))
            node = np.empty(len(key), np.int64)
            node[order] = run
            part = np.empty(len(key))
            part[order] = (np.where(bit, one[run], zero[run]) + 0.5) / (zero + one + 1)[run]
            total = _kt(zero, one)
            if d == depth:
                chance[:, j] = part
            else:
                some, logs = before[j]
                total, weight = _weighted(total, np.bincount(node[some], logs, minlength=len(head)))
                weight = weight[node]
                chance[:, j] = weight * part + (1 - weight) * chance[:, j]
            here.append((order[head], total))
            if d == 2:
                np.add.at(top, (((low[head] >> np.uint64(8)) & np.uint64(255)).astype(np.int64), (256 + own_byte[head]) >> (8 - j)), total)
        before = here
    return chance, top


def top_levels(pairs: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(weight, chance of one) by node at depth 0, and by last byte and node at depth 1. pairs: counts by last byte and byte."""
    places = np.zeros((256, 512))
    places[:, 256:] = pairs
    for n in range(255, 0, -1):
        places[:, n] = places[:, 2 * n] + places[:, 2 * n + 1]
    zero, one = places[:, 0::2], places[:, 1::2]
    total, weight = _weighted(_kt(zero, one), below)
    zero0, one0 = zero.sum(0), one.sum(0)
    return _weighted(_kt(zero0, one0), total.sum(0))[1], (one0 + 0.5) / (zero0 + one0 + 1), weight, (one + 0.5) / (zero + one + 1)


def bits_of(key: np.ndarray, chance: np.ndarray, levels: tuple[np.ndarray, ...]) -> np.ndarray:
    """The code lengths of the grams."""
    weight0, one0, weight1, one1 = levels
    byte, last = (key & np.uint64(255)).astype(np.int64), ((key >> np.uint64(8)) & np.uint64(255)).astype(np.int64)
    out = np.zeros(len(key))
    for j in range(8):
        node, bit = (256 + byte) >> (8 - j), (byte >> (7 - j)) & 1
        p0, p1 = (np.where(bit, x, 1 - x) for x in (one0[node], one1[last, node]))
        deep = weight1[last, node] * p1 + (1 - weight1[last, node]) * chance[:, j]
        out -= np.log2(weight0[node] * p0 + (1 - weight0[node]) * deep)
    return out


def code_lengths(counts: DataFrame, depth: int = DEPTH, part_grams: int = PART_GRAMS) -> DataFrame:
    """(key, bits) of every gram. counts: (key, c), one row a gram; c is 0 for grams that the training texts don't have."""
    if not 2 <= depth <= 7:
        raise ValueError("depth must be 2 to 7")
    parts = max(1, -(-counts.count() // part_grams))
    dealt = counts.withColumn("part", F.pmod(F.xxhash64(F.shiftright("key", 8).bitwiseAND(F.lit(0xFFFF))), F.lit(parts)).cast("int"))

    def grow(part: pd.DataFrame) -> pd.DataFrame:
        key = part["key"].to_numpy(np.int64).view(np.uint64)
        chance, top = subtrees(key, part["c"].to_numpy(np.int64), depth)
        last, node = np.nonzero(top)
        return pd.concat([
            pd.DataFrame({"key": key.view(np.int64), "chance": [x.tobytes() for x in chance], "total": 0.0}),
            pd.DataFrame({"key": last * 256 + node, "chance": None, "total": top[last, node]}),
        ])

    grown = stash(dealt.groupBy("part").applyInPandas(grow, "key long, chance binary, total double"))
    below, pairs = np.zeros(1 << 16), np.zeros(1 << 16)
    for r in grown.where("chance is null").groupBy("key").agg(F.sum("total").alias("x")).collect():  # 65,536 rows at most
        below[r.key] = r.x
    for r in counts.groupBy(F.col("key").bitwiseAND(F.lit(0xFFFF)).alias("key")).agg(F.sum("c").alias("x")).collect():  # 65,536 rows at most
        pairs[r.key] = r.x
    levels = top_levels(pairs.reshape(256, 256), below.reshape(256, 256))

    def measure(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in rows:
            key = b["key"].to_numpy(np.int64)
            yield pd.DataFrame({"key": key, "bits": bits_of(key.view(np.uint64), np.frombuffer(b"".join(b["chance"]), float).reshape(-1, 8), levels)})

    return grown.where("chance is not null").select("key", "chance").mapInPandas(give_back(measure), "key long, bits double")


# -- texts ------------------------------------------------------------------------------------------------------------


class Lookup:
    """Numbers by gram: a table of slots answers nearly all places, a search the others. The keys ascend."""

    def __init__(self, key: np.ndarray, bits: np.ndarray):
        self.key, self.bits = key, bits
        self.slot = np.zeros(1 << _SLOTS, np.int32)
        self.slot[self._of(self.key)] = np.arange(len(key), dtype=np.int32)

    @staticmethod
    def _of(key: np.ndarray) -> np.ndarray:
        return ((key * _MIX) >> np.uint64(64 - _SLOTS)).astype(np.int64)

    def __call__(self, key: np.ndarray) -> np.ndarray:
        at = self.slot[self._of(key)]
        other = np.flatnonzero(self.key[at] != key)
        at[other] = np.searchsorted(self.key, key[other])
        return self.bits[at]


def _packed(prices: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The table in the driver, by key, 12 bytes a row."""

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in rows:
            yield pd.DataFrame({"key": [b["key"].to_numpy(np.int64).tobytes()], "bits": [b["bits"].to_numpy(np.float32).tobytes()]})

    got = prices.mapInPandas(run, "key binary, bits binary").collect()
    key, bits = np.frombuffer(b"".join(r.key for r in got), np.uint64), np.frombuffer(b"".join(r.bits for r in got), np.float32)
    order = np.argsort(key)
    return key[order], bits[order]


def by_dictionaries(texts: DataFrame, prices: DataFrame, depth: int, batch_bytes: int) -> DataFrame:
    """The same for a table of any size: texts are dealt to batches, and the lengths of a batch's own grams are joined to it."""
    size = texts.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    dealt = texts.select("uid", "text", F.pmod(F.xxhash64("uid"), F.lit(max(1, -(-size // batch_bytes)))).cast("int").alias("batch"))

    def need(part: pd.DataFrame) -> pd.DataFrame:
        keys = [np.unique(grams(x, depth)[0]) for x in _chunks(x.lower() for x in part["text"])]
        return pd.DataFrame({"batch": part["batch"].iloc[0], "key": np.unique(np.concatenate(keys)).view(np.int64)})

    own = dealt.groupBy("batch").applyInPandas(need, "batch int, key long").join(prices, "key")

    def price(part: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        key = own["key"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(key)
        look = Lookup(key[order], own["bits"].to_numpy()[order])
        return pd.DataFrame({"uid": part["uid"], "bits": _lengths((x.lower() for x in part["text"]), look, depth)})

    return dealt.groupBy("batch").cogroup(own.groupBy("batch")).applyInPandas(lambda x, y: price(x, y), "uid long, bits double")


def _lengths(texts: Iterator[bytes], look: Lookup, depth: int) -> np.ndarray:
    out = [np.zeros(0)]
    for part in _chunks(texts):
        key, start = grams(part, depth)
        out.append(np.add.reduceat(look(key).astype(float), start))
    return np.concatenate(out)


# -- words ------------------------------------------------------------------------------------------------------------


def count_words(texts: DataFrame) -> DataFrame:
    """(word, c) over the whole texts. texts: text (binary)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for b in batches:
            for x in b["text"]:
                seen.update(x.lower().split())
                if len(seen) > _WORDS:
                    yield pd.DataFrame({"word": list(seen.keys()), "c": list(seen.values())})
                    seen = Counter()
        if seen:
            yield pd.DataFrame({"word": list(seen.keys()), "c": list(seen.values())})

    return texts.select("text").mapInPandas(give_back(run), "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def most_frequent(words: DataFrame, most: int) -> DataFrame:
    """Words of a count that at most `most` words reach, without a sort: a histogram over eighths of a doubling gives the bound."""
    short = words.where(F.octet_length("word") <= WORD_BYTES)
    grade = F.floor(F.log2("c") * 8)
    least, held = float("inf"), 0
    for g, n in short.groupBy(grade.alias("g")).agg(F.count("*").alias("n")).orderBy(F.desc("g")).collect():  # some 500 rows
        held += n
        if held > most:
            break
        least = g
    return short.where(grade >= F.lit(least))


def score(docs: DataFrame, train, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, shared_grams: int = SHARED_GRAMS, batch_bytes: int = BATCH_BYTES, frequent: int = FREQUENT) -> DataFrame:
    """One row per input row: doc_id, trained, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    train: condition on docs for the rows that teach. score is the model's log10 probability of the text (lower-cased in
    A-Z, with its end), base_score that of the unigram. Null texts count as empty: one end. Rows repeated under one
    id teach and score each. Null ids are allowed. A text of any length is scored whole. Other columns are ignored,
    whatever their names; with no training row both models are uniform; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    own = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("doc_id"), F.col(id_col).isNull().alias("no_id"), text.alias("text"), F.coalesce(train, F.lit(False)).alias("trained"))
    own = own.withColumn("uid", F.monotonically_increasing_id())
    prices = stash(code_lengths(stash(count_grams(own, depth)), depth))
    few = prices.count() <= shared_grams
    if not few:
        own = stash(own)  # it is read several times, and uid must stay
    table_ = _packed(prices) if few else None  # shared_grams rows at most
    words = stash(count_words(own.where("trained")))
    types, tokens = words.agg(F.count("*"), F.sum("c")).first()
    ends = own.where("trained").count()
    n_train = (tokens or 0) + ends
    log_all = float(np.log10(n_train + 0.5 * (types + (ends > 0) + 1)))
    log_end = float(np.log10(ends + 0.5))
    top = most_frequent(words, frequent).toPandas()
    known = (b" ".join(top["word"]), np.log10(top["c"].to_numpy(float) + 0.5))  # frequent * WORD_BYTES bytes at most
    shared = docs.sparkSession.sparkContext.broadcast((known, table_))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (names, logs), grams_ = shared.value
        at = dict(zip(names.split(b" "), logs.tolist(), strict=True)) if names else {}
        look = Lookup(*grams_) if grams_ else None
        for whole in batches:
            for b in (whole.iloc[i : i + _ROWS] for i in range(0, len(whole), _ROWS)):
                rows, rare = [], []
                low = [x.lower() for x in b["text"]]
                for uid, x in zip(b["uid"].tolist(), low, strict=True):
                    split = x.split()
                    hit = [f for f in map(at.get, split) if f is not None]
                    rows.append((len(split) + 1, len(hit) + (ends > 0), sum(hit) + log_end - (len(split) + 1) * log_all, len(x) + 1))
                    if len(hit) < len(split):
                        rare += [(uid, w, n) for w, n in Counter(w for w in split if w not in at).items()]
                out = b[["uid", "doc_id", "no_id", "trained"]].reset_index(drop=True)
                out[["n_tokens", "n_known", "base", "size"]] = rows
                out["bits"] = _lengths(iter(low), look, depth) if look else 0.0
                yield pd.concat([out.assign(word=None, n=0), pd.DataFrame(rare, columns=["uid", "word", "n"]).assign(**{c: v for c, v in _NONE.items() if c not in ("uid", "word", "n")})])[list(_NONE)].astype({c: "int64" for c in ("n_tokens", "n_known", "size", "n")})

    schema = "uid long, doc_id long, no_id boolean, trained boolean, n_tokens long, n_known long, base double, size long, bits double, word binary, n long"
    mixed = stash(own.mapInPandas(give_back(run), schema))
    # Of a word that isn't frequent each document sends one row; new words may be common, so the join is one that can be split.
    rare = mixed.where("word is not null").select("uid", "word", "n").join(words, "word", "left")
    rare = rare.groupBy("uid").agg(F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("seen"))
    main = mixed.where("word is null").join(rare, "uid", "left")
    if not few:
        main = main.drop("bits").join(by_dictionaries(own, prices, depth, batch_bytes), "uid")
    return main.select(
        F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "trained", "n_tokens", (F.col("n_known") + F.coalesce("seen", F.lit(0))).alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), (F.col("bits") * F.lit(-float(np.log10(2)))).alias("score"), (F.col("bits") / F.col("size")).alias("bits_per_byte"),
    )


def op3_ctw(spark, sf_dir: str) -> DataFrame:
    out = score(table(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 5) != 1)
    return out.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


QUERIES = {"op3_ctw": op3_ctw}
ORACLES: dict[str, str] = {}
