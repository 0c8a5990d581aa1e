"""Operator 4, packing along a space-filling curve.

Every text is tokenised once. Its tokens' fixed random directions are summed to a vector of a few dimensions (a hashed
bag of tokens and its random projection in one table), the dimensions become grid coordinates, and the grid cell's place on the
Hilbert curve, followed by bits of a hash of the id, is the sort key. Documents are range-sorted by that key, laid end
to end, and cut every LENGTH tokens, so neighbours on the curve share sequences and only the last sequence is padded.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, held, stash, table

TOKENIZER, LENGTH, END_ID = "byte_bpe_50k.json", 1024, 0
#: Dimensions and bits of each on the curve; bits of the id's hash behind them. All bits fit a double exactly.
DIMS, BITS, TIE_BITS, SEED = 4, 8, 20, 4
#: Tokens that one task lays out; tasks at most, which then grow and spill; keys sampled for each task's bounds. Words remembered.
TASK_TOKENS, MOST_PARTS, PART_SAMPLE, CACHE = 4_000_000, 1 << 14, 64, 200_000
_REMEMBERED = 64
_PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!-/:-@\[-`{-~]*)")
#: Byte-level BPE writes a byte as the character of its number if that is printable, else as the next one from 256 on.
_PRINTED = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTES = {b: chr(b if b in _PRINTED else 256 + sum(x not in _PRINTED for x in range(b))) for b in range(256)}


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of each row of unsigned coordinates under 2**bits (transposed form, by Gray decoding)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(up, q - 1, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


class Words(dict):
    """Ids of words behind a fixed beginning, packed; a word is encoded when it is first asked for.

    The tokenizer splits texts into runs of letters and runs of marks before it merges bytes, so a word of Latin letters and
    marks behind them goes to its merges directly, without the splitting. Other words are encoded as texts. Words that are
    empty or that white space begins or ends have no ids of their own: KeyError.
    """

    def __init__(self, tokenizer, before: str, code: str):
        super().__init__()
        self.tokenizer, self.before, self.code, self.marks = tokenizer, before, code, {}
        self.merges = tokenizer.model.tokenize
        self.start = "".join(_BYTES[x] for x in before.encode())

    def _merged(self, text: str) -> bytes:
        return array(self.code, [x.id for x in self.merges(text)]).tobytes()

    def __missing__(self, word: str) -> bytes:
        plain = _PLAIN.fullmatch(word)
        if plain:
            letters, marks = plain.groups()
            if marks:
                if marks not in self.marks:
                    self.marks[marks] = self._merged(marks)
                ids = self[letters] + self.marks[marks]
            else:
                ids = self._merged(self.start + (word if word.isascii() else word.encode().decode("latin-1").translate(_BYTES)))
        elif not word or word[0].isspace() or word[-1].isspace():
            raise KeyError(word)
        else:
            ids = array(self.code, self.tokenizer.encode(self.before + word, add_special_tokens=False).ids).tobytes()
        if len(word) <= _REMEMBERED:
            self[word] = ids
        return ids


class Encoder:
    """Texts to ids. Byte-level BPE splits around a single space or line feed between two other characters, whatever these are;
    so words are encoded once and remembered. Texts with white space beside a space or line feed, or at either end, are encoded whole.
    Special tokens' strings in a text are ordinary text, as the tokenizers' own notes set it."""

    def __init__(self, path: str, wide: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.code = "I" if wide else "H"
        self.feed = self._ids("\n")
        self.known = (Words(self.tokenizer, "", self.code), Words(self.tokenizer, " ", self.code))

    def _ids(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def batch(self, texts: list[str]) -> list[bytes]:
        for known in self.known:
            for seen in (known, known.marks):
                if len(seen) > CACHE:  # the words met first are the most frequent ones, as a rule
                    for w in list(islice(seen, CACHE // 2, None)):
                        del seen[w]
        first, later = (known.__getitem__ for known in self.known)
        out: list[bytes] = []
        for text in texts:
            try:
                out.append(self.feed.join([b"".join([first(line[0]), *map(later, line[1:])]) for line in (x.split(" ") for x in text.split("\n"))]))
            except KeyError:
                out.append(self._ids(text))
        return out


def encode(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, doc_tokens, ids): key is the place on the curve and the id's hash, as a double; ids are packed little-endian, with the end."""
    size, kind = _vocabulary(tokenizer, end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = np.dtype(kind).itemsize == 4
        known = held()  # a worker's tasks share what it has learnt
        encoder = known.get((tokenizer, wide)) or known.setdefault((tokenizer, wide), Encoder(tokenizer, wide))
        direction = np.random.default_rng(SEED).standard_normal((DIMS, size))
        end = np.array([end_id], kind).tobytes()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                part = whole.slice(at, 500)
                ids = [x + end for x in encoder.batch(part.column("text").to_pylist())]
                n = np.array([len(x) for x in ids]) // np.dtype(kind).itemsize
                flat, start = np.frombuffer(b"".join(ids), kind), np.cumsum(n) - n
                vectors = np.stack([np.add.reduceat(d[flat], start) for d in direction], 1) / np.sqrt(n)[:, None]
                cells = ((0.5 + np.arctan(vectors) / np.pi) * (1 << BITS)).clip(0, (1 << BITS) - 1).astype(np.int64)
                key = (hilbert_key(cells) << TIE_BITS) | part.column("tie").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(key.astype(float)), pa.array(n.astype(np.int64)), pa.array(ids, pa.binary())], ["doc_id", "key", "doc_tokens", "ids"])

    tie = F.pmod(F.xxhash64(F.lit(SEED), F.col(id_col)), F.lit(1 << TIE_BITS)).alias("tie")
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), tie)
    return slim.mapInArrow(give_back(run, keep=True), "doc_id long, key double, doc_tokens long, ids binary")


def dealt(coded: DataFrame, task_tokens: int = TASK_TOKENS) -> tuple[DataFrame, list[int]]:
    """Adds bucket, of ranges of the key with about as many tokens each, and the tokens of every bucket.

    The bounds come from a sample of keys weighted by their tokens; they balance tasks and change no result.
    """
    rows, total = coded.agg(F.count("*"), F.sum("doc_tokens")).first()
    parts = min(MOST_PARTS, max(1, -(-(total or 0) // task_tokens)))
    cuts: list[float] = []
    if parts > 1:
        got = coded.select("key", "doc_tokens").sample(min(1.0, PART_SAMPLE * parts / rows), SEED).toPandas().sort_values("key")  # PART_SAMPLE * MOST_PARTS rows, about
        seen = got["doc_tokens"].to_numpy().cumsum()
        cuts = sorted(set(got["key"].to_numpy()[np.searchsorted(seen, [seen[-1] * i / parts for i in range(1, parts)])].tolist())) if len(seen) else []
    out = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="key", outputCol="bucket").transform(coded) if cuts else coded.withColumn("bucket", F.lit(0.0))
    out = out.withColumn("bucket", F.col("bucket").cast("int"))
    sums = {r[0]: r[1] for r in out.groupBy("bucket").agg(F.sum("doc_tokens")).collect()}  # MOST_PARTS rows at most
    return out, [sums.get(b, 0) for b in range(len(cuts) + 1)]


def pack(docs: DataFrame, length: int = LENGTH, tokenizer: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, task_tokens: int = TASK_TOKENS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with_ids the ids (packed unsigned 32-bit).

    Null and empty texts are the end id alone. Rows repeated under one id are packed each; ties on the curve go by id, then by
    their tokens. Null ids are packed like others. A text of any length is cut into as many pieces as it needs. Sequences hold
    exactly length tokens but the last. Other columns are ignored, whatever their names; empty gives empty.
    """
    tokenizer = tokenizer or public_tokenizers.path(TOKENIZER)
    kind = _vocabulary(tokenizer, end_id)[1]
    placed, sums = dealt(stash(encode(docs, tokenizer, end_id, id_col, text_col)), task_tokens)
    base = np.cumsum([0, *sums]).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, at = None, 0
        for b in batches:
            row, rest, blobs = [], [], []
            for i, (own, n, ids) in enumerate(zip(b.column("bucket").to_pylist(), b.column("doc_tokens").to_pylist(), b.column("ids"), strict=True)):
                if own != bucket:
                    bucket, at = own, base[own]
                full = np.frombuffer(ids.as_buffer(), kind).astype("<u4")
                start = 0
                while start < n:
                    take = min(n - start, length - at % length)
                    piece = full[start : start + take].tobytes()
                    row.append(i), rest.append((start, take, zlib.crc32(piece), n, at // length, at % length)), blobs.append(piece if with_ids else None)
                    start, at = start + take, at + take
            columns = np.array(rest, np.int64).reshape(-1, 6).T
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row, pa.int64())), *map(pa.array, columns), pa.array(blobs, pa.binary())], names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    schema = ", ".join(f"{x} {'binary' if x == 'ids' else 'long'}" for x in names)
    out = placed.repartitionById(len(sums), "bucket").sortWithinPartitions("bucket", "key", "doc_id", "ids").mapInArrow(give_back(run), schema)
    return out if with_ids else out.drop("ids")


def _vocabulary(tokenizer: str, end_id: int) -> tuple[int, str]:
    """Its size with the end id, and the type that holds its ids."""
    from tokenizers import Tokenizer

    size = max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1)
    return size, "<u4" if size > 1 << 16 else "<u2"


def op4_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), with_ids=False)


QUERIES = {"op4_packing": op4_packing}
ORACLES: dict[str, str] = {}
