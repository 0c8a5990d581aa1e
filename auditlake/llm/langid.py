"""Operator 6, language ID by word-first backoff.

Learned from labelled documents: the frequency of words in each language, and of character n-grams of 1 to 4 characters.
A known word scores by its log frequency in each language; an unseen word by the longest n-grams of it that are known,
falling back to shorter ones. The document's scores are summed over all words of the whole text.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, give_back, local_table, stash, table

#: The classifier is fitted on about LANG_DOCS labelled documents of each language at most, chosen by a hash of the id.
LANG_DOCS = 5_000
#: Entries kept for each language: most frequent words; most frequent n-grams of each length. Longer words aren't learnt but
#: scored by their n-grams. Languages whose model a worker holds (those with most documents).
TOP_WORDS, TOP_GRAMS, WORD_LETTERS, MAX_LANGS, GRAMS = 30_000, 8_000, 40, 1000, 4
#: The pipeline rejects documents without a language, those whose score is lower, and those with a lower share of words that
#: are known or have known n-grams of two characters or more (texts in a script that no labelled document has).
MIN_SCORE, MIN_EVIDENCE = 0.5, 0.2
#: Python counts numbers that aren't decimal digits (fractions, numerals) as word characters too.
_NUMBERS = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
_RUN, _WORD = re.compile(r"[^\W\d_]+"), re.compile(rf"[^\W\d_{_NUMBERS}]+")
#: Texts that are judged at once: their words and scores take much more memory than the texts.
_ROWS = 100


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased."""
    words = _RUN.findall(text.lower()) if text else []
    return words if all(map(str.isalpha, words)) else [part for w in words for part in _WORD.findall(w)]


def grams_of(word: str, n: int) -> list[str]:
    w = f" {word} " if n > 1 else word
    return [w[i : i + n] for i in range(len(w) - n + 1)]


class Table(NamedTuple):
    """Scores by key. Row keys[k] holds what its languages have over the score that absent keys have there."""

    keys: dict[str, int]
    start: np.ndarray
    lang: np.ndarray
    over: np.ndarray
    absent: np.ndarray

    def sums(self, rows: np.ndarray, owner: np.ndarray, owners: int) -> np.ndarray:
        """The scores of the rows, summed by owner."""
        langs = len(self.absent)
        size = self.start[rows + 1] - self.start[rows]
        at = np.repeat(self.start[rows] - np.cumsum(size) + size, size) + np.arange(size.sum())
        flat = np.bincount(np.repeat(owner, size) * langs + self.lang[at], self.over[at], minlength=owners * langs)
        return flat.reshape(owners, langs) + np.bincount(owner, minlength=owners)[:, None] * self.absent


class Model(NamedTuple):
    """tables: of words, then of n-grams by n."""

    langs: list[str]
    prior: np.ndarray
    tables: list[Table]

    def plain(self) -> tuple:
        """Without own types: a broadcast is unpickled where this module isn't installed."""
        return self.langs, self.prior, [tuple(t) for t in self.tables]

    @classmethod
    def of(cls, plain: tuple) -> Model:
        return cls(plain[0], plain[1], [Table(*t) for t in plain[2]])

    def unseen(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the words, the mean over their longest known n-grams, and the n (0: none is known)."""
        out, level = np.zeros((len(words), len(self.langs))), np.zeros(len(words), np.int64)
        left = np.arange(len(words))
        for n in range(GRAMS, 0, -1):
            grams = [grams_of(words[i], n) for i in left.tolist()]
            owner = np.repeat(np.arange(len(left)), [len(g) for g in grams])
            rows = np.fromiter(map(self.tables[n].keys.get, chain.from_iterable(grams), repeat(-1)), np.int64, len(owner))
            rows, owner = rows[rows >= 0], owner[rows >= 0]
            have = np.bincount(owner, minlength=len(left))
            some = have > 0
            out[left[some]] = self.tables[n].sums(rows, owner, len(left))[some] / have[some, None]
            level[left[some]] = n
            left = left[~some]
        return out, level

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """For each text the language, its share, 0 to 1, and the evidence. Ties go to the first language by name."""
        found = [words_of(x) for x in texts]
        size = np.array([len(w) for w in found], np.int64)
        if not self.langs or not size.sum():
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        flat, owner = list(chain.from_iterable(found)), np.repeat(np.arange(len(texts)), size)
        rows = np.fromiter(map(self.tables[0].keys.get, flat, repeat(-1)), np.int64, len(flat))
        known = rows >= 0
        total = self.prior + self.tables[0].sums(rows[known], owner[known], len(texts))
        evidence = np.bincount(owner[known], minlength=len(texts)).astype(float)
        new = np.flatnonzero(~known)
        if len(new):
            place: dict[str, int] = {}
            which = np.array([place.setdefault(flat[i], len(place)) for i in new.tolist()])
            scores, level = self.unseen(list(place))
            for k in range(len(self.langs)):
                total[:, k] += np.bincount(owner[new], scores[which, k], minlength=len(texts))
            evidence += np.bincount(owner[new], level[which] >= 2, minlength=len(texts))
        share = 10.0 ** np.maximum(total - total.max(1)[:, None], -300)
        best = total.argmax(1)
        share = share[np.arange(len(texts)), best] / share.sum(1)
        return [self.langs[i] if n else "und" for i, n in zip(best, size, strict=True)], np.where(size, share, 0.0), evidence / np.maximum(size, 1)


def _table(rows: pd.DataFrame, langs: list[str]) -> Table:
    """rows: lang, key, c."""
    keys = {k: i for i, k in enumerate(sorted(set(rows["key"])))}
    at, lang, c = rows["key"].map(keys).to_numpy(np.int64), rows["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(np.int64), rows["c"].to_numpy(float)
    all_ = np.log10(np.bincount(lang, c, minlength=len(langs)) + 0.5 * (len(keys) + 1))
    order = np.lexsort((lang, at))
    start = np.searchsorted(at[order], np.arange(len(keys) + 1))
    return Table(keys, start, lang[order], (np.log10(c + 0.5) - np.log10(0.5))[order], np.log10(0.5) - all_)


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen: dict[str, Counter] = {}
    size = 0

    def rows() -> Iterator[pd.DataFrame]:
        """One frame for each language and n, so one of them is held at a time."""
        while seen:
            lang, words = seen.popitem()
            for n in range(GRAMS + 1):
                found: Counter = Counter()
                for w, c in words.items():
                    for g in grams_of(w, n) if n else [w] if len(w) <= WORD_LETTERS else ():
                        found[g] += c
                if found:
                    yield pd.DataFrame({"lang": [lang] * len(found), "n": n, "key": list(found), "c": list(found.values())})

    for b in batches:
        for lang, text in zip(b["lang"], b["text"], strict=True):
            words = seen.setdefault(lang, Counter())
            before = len(words)
            words.update(words_of(text))
            size += len(words) - before
            if size > 200_000:
                yield from rows()
                size = 0
    yield from rows()


def most_frequent(counts: DataFrame) -> pd.DataFrame:
    """The TOP_WORDS or TOP_GRAMS most frequent keys of each language and n, about, without a sort: a histogram over eighths of
    a doubling gives the count from which all are taken, and the share, by hash, of those just below."""
    grade = F.floor(F.log2("c") * 8).cast("int")
    sizes = counts.groupBy("lang", "n", grade.alias("grade")).agg(F.count("*").alias("keys")).toPandas()  # a few hundred rows for a language and n
    bounds = []
    for (lang, n), part in sizes.sort_values("grade", ascending=False).groupby(["lang", "n"], sort=False):
        most, held = TOP_GRAMS if n else TOP_WORDS, 0
        for g, k in zip(part["grade"].tolist(), part["keys"].tolist(), strict=True):
            if held + k > most:
                bounds.append((lang, int(n), g, (most - held) / k))
                break
            held += k
        else:
            bounds.append((lang, int(n), -1, 1.0))
    if not bounds:
        return counts.toPandas()
    least = local_table(counts.sparkSession, bounds, "lang string, n int, least int, share double")
    draw = F.pmod(F.xxhash64(F.lit(6), "key"), F.lit(1 << 53)) / F.lit(float(1 << 53))
    taken = counts.join(F.broadcast(least), ["lang", "n"]).where((grade > F.col("least")) | ((grade == F.col("least")) & (draw < F.col("share"))))
    return taken.select("lang", "n", "key", "c").toPandas()


def fit(docs: DataFrame, lang_docs: int = LANG_DOCS) -> Model:
    """docs: doc_id, text, lang. Rows with a null lang or text don't teach. Each language teaches with about lang_docs documents,
    or all it has; the model's size is bounded by the parameters above."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    langs = labelled.groupBy("lang").agg(F.count("*").alias("docs")).orderBy(F.desc("docs"), "lang").limit(MAX_LANGS).toPandas().sort_values("lang")
    names = langs["lang"].tolist()
    shares = local_table(docs.sparkSession, [(x, min(1.0, lang_docs / n)) for x, n in zip(names, langs["docs"].tolist(), strict=True)], "lang string, share double")
    draw = F.pmod(F.xxhash64(F.lit(6), "doc_id", "text"), F.lit(1 << 53)) / F.lit(float(1 << 53))
    sample = labelled.join(F.broadcast(shares), "lang").where(draw < F.col("share"))  # MAX_LANGS rows at most
    counts = sample.select("lang", "text").mapInPandas(give_back(_counts), "lang string, n int, key string, c long").groupBy("lang", "n", "key").agg(F.sum("c").alias("c"))
    top = most_frequent(stash(counts))
    return Model(names, np.log10(langs["docs"].to_numpy(float) / max(1, langs["docs"].sum())), [_table(top[top["n"] == n], names) for n in range(GRAMS + 1)])


def _predicted(batch: pa.RecordBatch, model: Model) -> Iterator[tuple[pa.RecordBatch, tuple]]:
    for at in range(0, batch.num_rows, _ROWS):
        part = batch.slice(at, _ROWS)
        yield part, model.predict(part.column("text").to_pylist())


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, evidence), one row per input row.

    Null texts and texts without a letter are und with score 0. Equal texts score alike, so rows repeated under one id do too;
    texts of any length are read whole. Null ids stay null. Other columns are ignored; empty gives empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model.plain())  # bounded: MAX_LANGS * (TOP_WORDS + GRAMS * TOP_GRAMS) entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model.of(shared.value)
        for b in batches:
            for part, (lang, score, evidence) in _predicted(b, own):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lang, pa.string()), pa.array(score), pa.array(evidence)], ["doc_id", "lang_pred", "score", "evidence"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(give_back(run), "doc_id long, lang_pred string, score double, evidence double")


def training_rows(docs: DataFrame) -> DataFrame:
    """Those whose crc32(doc_id as text) mod 4 is not 2."""
    return docs.where(crc_mod(F.col("doc_id"), 4) != 2).select("doc_id", "text", "lang")


def keep_identified(docs: DataFrame, min_score: float = MIN_SCORE, min_evidence: float = MIN_EVIDENCE) -> DataFrame:
    """The pipeline stage: documents whose text has a language with a score of min_score at least, all columns unchanged.

    The documents are judged where they are read, so neither texts nor results are shuffled. Null texts and texts without a
    letter go. Rows are judged each for itself, so repeated ids, null ids and further columns of any type stay as they are;
    an empty table gives an empty result, and so does one without a labelled row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(training_rows(docs)).plain())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model.of(shared.value)
        for b in batches:
            for part, (lang, score, evidence) in _predicted(b, own):
                yield part.filter(pa.array([x != "und" and y >= min_score and z >= min_evidence for x, y, z in zip(lang, score, evidence, strict=True)], pa.bool_()))

    return docs.mapInArrow(give_back(run), docs.schema)


def op6_langid(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs, fit(training_rows(docs)))
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


QUERIES = {"op6_langid": op6_langid}
ORACLES: dict[str, str] = {}
