"""Operator 9, substring dedup by prefix-partitioned suffix trees over words.

A suffix starts at each word; only its first WINDOW words matter, and an inner node WINDOW words deep is a repeat.
1. Suffixes that can't lie under such a node are set aside first: the hashes of all windows meet in memory-sized groups,
   and those seen in two documents set a bit in a filter that grows from FILTER_BITS to MOST_BITS. False positives cost only work in the next
   step. Beyond FILTERED windows a filter of that size would be full and its groups too large, and all suffixes go on.
2. The other suffixes are dealt by a prefix of variable length, the words up to the first that isn't among the most
   frequent ones, so that frequent words don't gather everything. The number of groups grows with the input. Within a task
   a tree is the suffix array of its suffixes, each a string of WINDOW symbols (16 bits, each of three neighbouring words,
   cyclic; so every word is in three symbols, and equal strings stand for equal windows), with the lengths of the
   neighbours' common prefixes: an inner node is an interval of the array whose common prefixes reach its depth. Depth
   beyond WINDOW changes no result, so suffixes end there. Intervals of depth WINDOW keep their smallest doc_id; their
   places in later documents are repeats.
3. Neighbouring repeats of a document join to its maximal repeats, and the words they cover are removed from the whole text.
Equal windows of one batch travel as one string, so a passage that many documents share is as many strings as batches.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash, table

WINDOW = 13
#: The filter's least bits (32 MB); bytes of text that a batch gathers; windows and suffixes that a group is to hold.
FILTER_BITS, BATCH_BYTES, GROUP_WINDOWS, GROUP_SUFFIXES = 1 << 28, 2 << 20, 1 << 19, 1 << 19
#: The filter grows with the windows, to MOST_BITS (128 MB). Windows beyond which there is none: it would be full.
MOST_BITS, FILTERED = 1 << 30, 1 << 33
#: Words that can't end a prefix are the most frequent of about SAMPLE_DOCS documents. They balance tasks and change no result.
FREQUENT, SAMPLE_DOCS = 256, 2000
#: Runs of all documents together under this size are broadcast; else documents and runs are joined by shuffling.
BROADCAST_BYTES = 32 << 20
_FIRST = -(1 << 63)  # stands for a null id
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _B
    x = (x ^ (x >> np.uint64(29))) * _A
    return x ^ (x >> np.uint64(32))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of all texts, and the index of its text."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    lengths = ends - starts
    power = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(int(lengths.max()), _A))))
    inside = np.flatnonzero(~space)  # the bytes of words
    value = power[inside - np.repeat(starts, lengths)]
    value *= data[inside].astype(np.uint64) + np.uint64(1)
    sums = np.add.reduceat(value, np.cumsum(lengths) - lengths)
    owner = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, side="right")
    return _mixed(sums + lengths.astype(np.uint64) * _B), owner


def _windows(words: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows, and their hashes."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(owner[:n] == owner[size - 1 :])
    total = np.zeros(n, np.uint64)
    for i in range(size):
        total = total * _A + words[i : i + n]
    return at, _mixed(total[at])


def _gathered(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, list[bytes], np.ndarray]]:
    ids, texts, rks, size = [], [], [], 0
    for b in batches:
        for i, x, rk in zip(b["doc_id"], b["text"], b["rk"], strict=True):
            ids.append(i), texts.append(x), rks.append(rk)
            size += len(x)
            if size >= BATCH_BYTES:
                yield np.array(ids, np.int64), texts, np.array(rks, np.int64)
                ids, texts, rks, size = [], [], [], 0
    if ids:
        yield np.array(ids, np.int64), texts, np.array(rks, np.int64)


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_FIRST)).alias("doc_id"), text.cast("binary").alias("text"), F.xxhash64(text).alias("rk"))


def _runs_of(group: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, first, end) of the runs of an ascending array."""
    values, first = np.unique(group, return_index=True)
    return list(zip(values.tolist(), first.tolist(), [*first[1:].tolist(), len(group)], strict=True))


def _depths(strings: np.ndarray) -> np.ndarray:
    """How many symbols each of the sorted strings has in common with the one before it; 0 for the first."""
    same = strings[1:] == strings[:-1]
    return np.concatenate(([0], np.logical_and.accumulate(same, axis=1).sum(1))) if len(strings) else np.zeros(0, np.int64)


def _filter(slim: DataFrame, size: int, groups: int, width: int, bits: int) -> np.ndarray:
    """Bits of the windows that two documents hold, groups after each other."""
    own = bits // groups

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, texts, _ in _gathered(batches):
            words, owner = word_hashes(texts)
            at, h = _windows(words, owner, size)
            doc = ids[owner[at]]
            order = np.lexsort((doc, h))
            h, doc = h[order], doc[order]
            new = np.concatenate(([True], h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
            other = np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))) if len(h) else new
            h = h[other]
            run = np.maximum.accumulate(np.where(new[other], np.arange(len(h)), 0))
            h = h[np.arange(len(h)) - run < 2]  # a second document is enough
            group = (h >> np.uint64(40)) % np.uint64(groups)
            order = np.argsort(group, kind="stable")
            group, h = group[order], h[order]
            low = h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
            yield pd.DataFrame([(g, low[a:b].tobytes()) for g, a, b in _runs_of(group)], columns=["g", "vals"]).astype({"g": "int32"})

    def reduce(part: pd.DataFrame) -> pd.DataFrame:
        raw = np.frombuffer(b"".join(part["vals"]), np.uint8).reshape(-1, width)
        full = np.zeros((len(raw), 8), np.uint8)
        full[:, :width] = raw
        v = np.sort(full.view("<u8").ravel())
        flags = np.zeros(own, bool)
        flags[(_mixed(v[1:][v[1:] == v[:-1]]) % np.uint64(own)).astype(np.int64)] = True
        return pd.DataFrame({"g": [part["g"].iloc[0]], "bits": [np.packbits(flags).tobytes()]})

    out = np.zeros((groups, own // 8), np.uint8)
    for g, part in slim.mapInPandas(emit, "g int, vals binary").groupBy("g").applyInPandas(reduce, "g int, bits binary").toLocalIterator():  # bits / 8 bytes in all
        out[g] = np.frombuffer(bytes(part), np.uint8)
    return out


def _symbols(words: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """The strings of the windows at these places: size big-endian 16-bit symbols."""
    triple = lambda a, b, c: (_mixed((a * _A + b) * _A + c) >> np.uint64(48)).astype(">u2")
    return np.stack([triple(words[at + i], words[at + (i + 1) % size], words[at + (i + 2) % size]) for i in range(size)], axis=1)


def _repeats(slim: DataFrame, size: int, filter_: np.ndarray | None, width: int, groups: int, frequent: np.ndarray) -> DataFrame:
    """(to, ids, rks, at): packed starts of the windows whose words also start in a document with a smaller id, dealt by document."""
    shared = slim.sparkSession.sparkContext.broadcast(filter_)  # MOST_BITS at most
    mask = np.uint64((1 << (8 * width)) - 1)

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = shared.value
        own = np.uint64(1 if bits is None else bits.shape[1] * 8)
        for ids, texts, rks in _gathered(batches):
            words, owner = word_hashes(texts)
            at, h = _windows(words, owner, size)
            bit = (_mixed(h & mask) % own).astype(np.int64)
            hit = np.ones(len(h), np.uint8) if bits is None else (bits[((h >> np.uint64(40)) % np.uint64(bits.shape[0])).astype(np.int64), bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1
            at, h = at[hit > 0], h[hit > 0]
            if not len(at):
                continue
            key = _symbols(words, at, size)
            stop = np.where(np.isin(words, frequent), len(words) + size, np.arange(len(words)))
            stop = np.minimum.accumulate(stop[::-1])[::-1][at] - at  # words before the first rare one
            stop = np.minimum(stop, size - 1)
            prefix = np.zeros(len(at), np.uint64)
            for i in range(size):
                more = stop >= i
                prefix[more] = prefix[more] * _A + words[at[more] + i]
            group = (_mixed(prefix) % np.uint64(groups)).astype(np.int64)
            order = np.lexsort((at, h, group))
            group, at, h, key = group[order], at[order], h[order], key[order]
            new = np.concatenate(([True], (group[1:] != group[:-1]) | (h[1:] != h[:-1]) | (key[1:] != key[:-1]).any(1)))
            base = np.searchsorted(owner, np.arange(len(texts)))
            doc, pos = owner[at], (at - base[owner[at]]).astype("<u4")
            rows = []
            for g, a, b in _runs_of(group):
                u, inverse = np.unique(doc[a:b], return_inverse=True)
                first = np.flatnonzero(new[a:b])
                rows.append((g, key[a:b][first].tobytes(), np.diff(np.append(first, b - a)).astype("<u4").tobytes(), ids[u].astype("<i8").tobytes(), rks[u].astype("<i8").tobytes(), inverse.astype("<u4" if len(u) > 65535 else "<u2").tobytes(), pos[a:b].tobytes()))
            yield pd.DataFrame(rows, columns=["g", "keys", "times", "ids", "rks", "doc", "pos"])

    def reduce(part: pd.DataFrame) -> pd.DataFrame:
        keys = np.frombuffer(b"".join(part["keys"]), f"V{2 * size}")
        times = np.frombuffer(b"".join(part["times"]), "<u4").astype(np.int64)
        ids, rks, doc, pos, seen = [], [], [], [], 0
        for x in part.itertuples():
            own = np.frombuffer(x.ids, "<i8")
            doc.append(np.frombuffer(x.doc, "<u4" if len(own) > 65535 else "<u2").astype(np.int64) + seen)
            ids.append(own), rks.append(np.frombuffer(x.rks, "<i8")), pos.append(np.frombuffer(x.pos, "<u4"))
            seen += len(own)
        ids, rks, doc, pos = map(np.concatenate, (ids, rks, doc, pos))
        least = np.minimum.reduceat(ids[doc], np.cumsum(times) - times)  # of each string of a batch
        # The suffix array and the depths of the nodes above neighbours. An interval of full depth is one deep node.
        order = np.argsort(keys.view(f"S{2 * size}"))
        new = _depths(keys.view("<u2").reshape(-1, size)[order]) < size
        node = np.cumsum(new) - 1
        best = np.empty(len(keys), np.int64)
        best[order] = np.minimum.reduceat(least[order], np.flatnonzero(new))[node]
        later = ids[doc] > np.repeat(best, times)
        doc, pos = doc[later], pos[later]
        to = (_mixed(ids[doc].view(np.uint64) ^ rks[doc].view(np.uint64)) % np.uint64(groups)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        to, doc, pos = to[order], doc[order], pos[order]
        blobs = [(g, ids[doc[a:b]].tobytes(), rks[doc[a:b]].tobytes(), pos[a:b].tobytes()) for g, a, b in _runs_of(to)]
        return pd.DataFrame(blobs, columns=["to", "ids", "rks", "at"])

    rows = slim.mapInPandas(emit, "g int, keys binary, times binary, ids binary, rks binary, doc binary, pos binary")
    return rows.groupBy("g").applyInPandas(reduce, "to int, ids binary, rks binary, at binary")


def _runs(found: DataFrame, size: int) -> DataFrame:
    """(run_id, run_rk, runs): for each document the covered words as packed pairs (first, end)."""

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        ids, rks, at = (np.frombuffer(b"".join(part[c]), k) for c, k in (("ids", "<i8"), ("rks", "<i8"), ("at", "<u4")))
        order = np.lexsort((at, rks, ids))
        ids, rks, at = ids[order], rks[order], at[order].astype(np.int64)
        first = np.concatenate(([True], (ids[1:] != ids[:-1]) | (rks[1:] != rks[:-1])))
        head = first | np.concatenate(([True], at[1:] > at[:-1] + size))
        tail = np.append(head[1:], True)
        pairs = np.stack([at[head], at[tail] + size], 1).astype("<u4")
        docs = np.flatnonzero(first[head])
        return pd.DataFrame({"run_id": ids[first], "run_rk": rks[first], "runs": [x.tobytes() for x in np.split(pairs, docs[1:])]})

    return found.groupBy("to").applyInPandas(merge, "run_id long, run_rk long, runs binary")


def remove_repeats(docs: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, filter_bits: int = FILTER_BITS, filtered: int = FILTERED) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256, and with_text the kept words joined by one space.

    Null texts have no words. Rows repeated under one id don't make each other repeats. A null id comes before all others.
    Documents with fewer words than the window lose none. Texts of any length are read whole. Other columns are ignored,
    whatever their names; an empty table gives an empty result.
    """
    slim = _slim(docs, id_col, text_col)
    total = (slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 5 + 1  # windows, about
    groups = max(16, 1 << (min(filtered, total) // GROUP_WINDOWS).bit_length())  # a group also holds its share of the filter, a byte a bit
    width = min(5, -(-((total // groups).bit_length() + 7) // 8))
    seen = slim.where(F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.greatest(F.lit(1), F.lit(docs.count() // SAMPLE_DOCS))) == 0)
    counts: Counter = Counter()
    for (part,) in seen.select("text").mapInPandas(_top_words, "top binary").toLocalIterator():  # FREQUENT entries a task
        for h, n in np.frombuffer(bytes(part), "<u8").reshape(-1, 2).tolist():
            counts[h] += n
    frequent = np.array([h for h, _ in counts.most_common(FREQUENT)], np.uint64)
    filter_bits = max(filter_bits, 8 * groups, min(MOST_BITS, 1 << (total // 8).bit_length()))
    bits = _filter(slim, size, groups, width, filter_bits) if total <= filtered else None
    found = _repeats(slim, size, bits, width, max(8, total // (4 if total <= filtered else 1) // GROUP_SUFFIXES), frequent)
    runs = stash(_runs(found, size))
    n, held = runs.agg(F.count("*"), F.sum(F.octet_length("runs"))).first()
    if 32 * n + (held or 0) <= BROADCAST_BYTES:
        runs = F.broadcast(runs)
    joined = slim.join(runs, (F.col("doc_id") == F.col("run_id")) & (F.col("rk") == F.col("run_rk")), "left").select("doc_id", "text", "runs")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, text, covered in zip(b["doc_id"], b["text"], b["runs"], strict=True):
                words = text.split()
                kept = words
                if covered is not None:
                    kept, at = [], 0
                    for a, z in np.frombuffer(covered, "<u4").reshape(-1, 2).tolist():
                        kept += words[at:a]
                        at = z
                    kept += words[at:]
                left = b" ".join(kept)
                out.append((None if i == _FIRST else i, len(words), len(words) - len(kept), hashlib.sha256(left).hexdigest(), left.decode("utf-8", "replace") if with_text else None))
            yield pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept_sha256", "text"]).astype({"doc_id": "Int64"})

    out = joined.mapInPandas(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, text string")
    return out if with_text else out.drop("text")


def _top_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: Counter = Counter()
    for b in batches:
        h, n = np.unique(word_hashes(list(b["text"]))[0], return_counts=True)
        most = np.argsort(-n, kind="stable")[: 8 * FREQUENT]
        counts.update(dict(zip(h[most].tolist(), n[most].tolist(), strict=True)))
    yield pd.DataFrame({"top": [np.array(counts.most_common(FREQUENT), "<u8").tobytes()]})


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), with_text=False)


QUERIES = {"op9_substring_dedup": op9_substring_dedup}
ORACLES: dict[str, str] = {}
