"""Operator 8, mixing sources to target weights by iterative proportional fitting.

The tokens of every document are counted over its whole text and summed in cells of (source, language, topic). Topics are
clusters of hashed term vectors, fitted on all documents; every document is dealt to one by its whole text. Raking
scales the cells until their sums meet the targets of all three marginals, in a sample of BUDGET of all tokens; a cell
never gets more tokens than it has, so its scale is the probability with which its documents are drawn. Where the
targets can be met under that bound, the expected tokens of the sample have the target marginals. The draw is a hash
of the id, so that it can be repeated.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import give_back, local_table, stash, table, unstash, unused

DIMS = ("source", "lang", "topic")
#: Target shares are proportional to the power ALPHA of the present shares: 1 keeps them, 0 makes them equal.
ALPHA = {"source": 0.5, "lang": 0.5, "topic": 0.75}
TOPICS, SWEEPS, TOLERANCE, SEED = 8, 200, 1e-9, 8
#: Topics are fitted on words of so many bytes hashed to so many terms; languages with fewer documents have no mean of their own.
TOPIC_LETTERS, TERMS, LANG_LEAST, ITERATIONS = 5, 256, 20, 25
_ROWS, _LANGS = 500, 500
#: A direction's components are whole numbers of 1 / UNIT in rows, of 1 / FINE in sums and centres. So sums and products are exact
#: in doubles, and no result depends on how the rows are dealt to tasks.
UNIT, FINE = 1 << 14, 1 << 20
#: Share of all tokens in the sample.
BUDGET = 0.5
#: Cells raked in the driver's memory; beyond, each sweep is a Spark job over the table of cells.
DRIVER_CELLS = 200_000


class Topics(NamedTuple):
    """Weights of the hashed terms, mean vector of each language (and of all texts), and the topics' directions."""

    weights: np.ndarray
    means: dict[str, np.ndarray]
    mean: np.ndarray
    centres: np.ndarray

    def rows(self, terms: np.ndarray, langs: list[str]) -> np.ndarray:
        """What rows of terms have beyond their language, as directions in whole numbers of 1 / UNIT."""
        if not len(langs):
            return np.zeros((0, TERMS))
        return np.rint(_unit(_unit(terms * self.weights) - np.stack([self.means.get(x, self.mean) for x in langs])) * UNIT)

    def of(self, terms: np.ndarray, langs: list[str]) -> list[str]:
        """The topics of rows of terms: the nearest direction; t- without any term."""
        best = self.rows(terms, langs) @ self.centres.T
        return [f"t{k}" if some else "t-" for k, some in zip(best.argmax(1).tolist(), terms.any(1).tolist(), strict=True)]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1))[:, None], 1e-12)


def terms_of(texts: list[list[bytes]]) -> np.ndarray:
    """A row of hashed log counts of the words of TOPIC_LETTERS bytes or more for each list of words."""
    out = np.zeros((len(texts), TERMS), np.float32)
    for i, words in enumerate(texts):
        long = Counter(w for w in words if len(w) >= TOPIC_LETTERS)
        at = np.fromiter((zlib.crc32(w) % TERMS for w in long), np.int64, len(long))
        out[i] = np.bincount(at, np.log1p(np.fromiter(long.values(), float, len(long))), TERMS)
    return out


def _words(batch: pa.RecordBatch) -> list[list[bytes]]:
    return [(x.encode() if isinstance(x, str) else x or b"").lower().split() for x in batch.column("text").to_pylist()]


def _slim(docs: DataFrame) -> DataFrame:
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("?")).alias(c)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), named("source"), named("lang"), F.col("text").cast("binary").alias("text"))


def vectors(docs: DataFrame) -> DataFrame:
    """(doc_id, source, lang, tokens, draw, terms) per row: tokens are words of the whole text, terms its terms_of() as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(at, _ROWS) for at in range(0, whole.num_rows, _ROWS)):
                words = _words(b)
                out = [*map(b.column, ("doc_id", "source", "lang")), pa.array([len(w) for w in words], pa.int64()), b.column("draw"), pa.array([x.tobytes() for x in terms_of(words)], pa.binary())]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "source", "lang", "tokens", "draw", "terms"])

    slim = _slim(docs).withColumn("draw", F.xxhash64(F.lit(SEED + 1), "doc_id", "text"))
    return slim.mapInArrow(give_back(run), "doc_id long, source string, lang string, tokens long, draw long, terms binary")


def _terms(b: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(b.column("terms").to_pylist()), np.float32).reshape(-1, TERMS)


def _rows(b: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(b.column("row").to_pylist()), np.int16).reshape(-1, TERMS).astype(float)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b.slice(at, _ROWS) for b in batches for at in range(0, b.num_rows, _ROWS))


def _sums(df: DataFrame, part: Callable, most: int) -> dict:
    """The sums of part(batch), a dict of arrays of whole numbers, over all rows by key. A task holds `most` keys or a batch's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([x.astype(np.int64) for x in held.values()], pa.list_(pa.int64()))], ["key", "v"])

        for b in _parts(batches):
            for k, x in part(b).items():
                held[k] = held[k] + x if k in held else x
            if len(held) > most:
                yield made()
                held = {}
        yield made()

    one = df.mapInArrow(give_back(run), "key string, v array<long>").select("key", F.posexplode("v").alias("at", "x")).groupBy("key", "at").agg(F.sum("x").alias("x"))
    whole = one.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("v")).select("key", F.col("v.x").alias("v"))
    return {r.key: np.array(r.v, float) for r in whole.collect()}  # a row of at most TERMS + 1 numbers for each key


def _language_means(terms: DataFrame) -> tuple[np.ndarray, dict[str, np.ndarray], np.ndarray]:
    """Weights of the terms, and means of languages and of all texts, over all rows that have a term."""
    some = lambda x: np.append((x > 0).sum(0), x.any(1).sum())
    met = _sums(terms.select("terms"), lambda b: {"": some(_terms(b))}, 1).get("", np.zeros(TERMS + 1))
    weights = np.log((1 + met[-1]) / (1 + met[:-1])) + 1

    def by_lang(b: pa.RecordBatch) -> dict:
        x = _terms(b)
        has = x.any(1)
        unit = np.column_stack([np.rint(_unit(x[has] * weights) * FINE), np.ones(has.sum())])
        lang = b.column("lang").filter(pa.array(has)).dictionary_encode()
        at = lang.indices.to_numpy()
        return {k: unit[at == i].sum(0) for i, k in enumerate(lang.dictionary.to_pylist())}

    sums = _sums(terms.select("lang", "terms"), by_lang, _LANGS)
    all_ = sum(sums.values(), np.zeros(TERMS + 1))
    means = {k: v[:-1] / (v[-1] * FINE) for k, v in sums.items() if v[-1] >= LANG_LEAST}
    return weights, means, all_[:-1] / (max(1, all_[-1]) * FINE)


def _uniform(draw: np.ndarray, k: int) -> np.ndarray:
    """Numbers between 0 and 1 by the draw of a row, others for each k."""
    x = draw.astype(np.int64).view(np.uint64) + np.uint64((k * 0x9E3779B97F4A7C15) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2**53 + 2**-54


def _seed_row(rows: DataFrame, centres: np.ndarray, k: int) -> np.ndarray | None:
    """A row drawn by its squared distance from the nearest centre (each alike if there is none); None if all are centres.

    Of all rows' -log(u) / w the least one is drawn with probability w, so tasks only send their least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list = []
        for b in _parts(batches):
            x = _rows(b)
            w = np.ones(len(x))
            if len(centres):
                w = ((x * x).sum(1)[:, None] + (centres * centres).sum(1)[None] - 2 * (x @ centres.T)).min(1) ** 2
            at = np.flatnonzero(w > 0)
            if len(at):
                score = -np.log(_uniform(b.column("draw").to_numpy(zero_copy_only=False)[at], k)) / w[at]
                low = at[score == score.min()]
                best = [min([*best, *((float(score.min()), x[i].astype(np.int16).tobytes()) for i in low)])]
        yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in best], pa.float64()), pa.array([x for _, x in best], pa.binary())], ["score", "row"])

    got = rows.mapInArrow(give_back(run), "score double, row binary").orderBy("score", "row").limit(1).collect()
    return np.frombuffer(bytes(got[0].row), np.int16).astype(float) if got else None


def _fit(terms: DataFrame, topics: int) -> Topics:
    """Topics of all rows of vectors(), by k-means on directions. A language's mean is taken off first, so topics don't repeat
    the languages. Centres are drawn among all rows, and each round goes over all rows."""
    weights, means, mean = _language_means(terms)
    plain = (weights, means, mean, np.zeros((1, TERMS)))

    def beyond(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Topics(*plain)
        for b in _parts(batches):
            x = _terms(b)
            rows = own.rows(x, b.column("lang").to_pylist()).astype(np.int16)
            yield pa.RecordBatch.from_arrays([b.column("draw"), pa.array([r.tobytes() for r in rows], pa.binary())], ["draw", "row"]).filter(pa.array(x.any(1)))

    rows = stash(terms.select("lang", "draw", "terms").mapInArrow(beyond, "draw long, row binary"))
    centres = np.zeros((0, TERMS))
    while len(centres) < topics and (new := _seed_row(rows, centres, len(centres))) is not None:
        centres = np.vstack([centres, new])
    centres = np.rint(_unit(centres) * FINE)
    for _ in range(ITERATIONS if len(centres) else 0):

        def nearest(b: pa.RecordBatch, centres: np.ndarray = centres) -> dict:
            x = _rows(b)
            at = (x @ centres.T).argmax(1)
            return {str(k): x[at == k].sum(0) for k in np.unique(at).tolist()}

        sums = _sums(rows.select("row"), nearest, topics)
        new = np.stack([np.rint(_unit(v[None])[0] * FINE) if (v := sums.get(str(k))) is not None and v.any() else c for k, c in enumerate(centres)])
        still = np.abs(new - centres).max() <= FINE * 1e-5
        centres = new
        if still:
            break
    unstash(rows)
    return Topics(weights, means, mean, centres if len(centres) else np.zeros((1, TERMS)))


def fit_topics(docs: DataFrame, topics: int = TOPICS) -> Topics:
    """Fitted on all documents. The result depends on the rows alone, not on their order or partitions."""
    terms = stash(vectors(docs))
    model = _fit(terms, topics)
    unstash(terms)
    return model


def _measured(terms: DataFrame, model: Topics) -> DataFrame:
    """(doc_id, source, lang, topic, tokens) per row of vectors()."""
    plain = tuple(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Topics(*plain)
        for b in _parts(batches):
            topic = pa.array(own.of(_terms(b), b.column("lang").to_pylist()), pa.string())
            yield pa.RecordBatch.from_arrays([*map(b.column, ("doc_id", "source", "lang")), topic, b.column("tokens")], ["doc_id", "source", "lang", "topic", "tokens"])

    return terms.select("doc_id", "source", "lang", "tokens", "terms").mapInArrow(give_back(run), "doc_id long, source string, lang string, topic string, tokens long")


def measure(docs: DataFrame, model: Topics) -> DataFrame:
    """(doc_id, source, lang, topic, tokens) per row: tokens are words of the whole text. Nulls: no words, source and lang as "?"."""
    return _measured(stash(vectors(docs)), model)


def targets(cells: pd.DataFrame, dim: str, wanted: dict | None = None) -> pd.Series:
    """The target share of each value: as wanted, or tempered. Values without tokens have none."""
    have = cells.groupby(dim)["tokens"].sum().astype(float)
    have = have[have > 0]
    if wanted:
        goal = pd.Series({k: float(wanted.get(k, 0.0)) for k in have.index})
        if not goal.sum() > 0:
            raise ValueError(f"no {dim} of the targets has tokens")
    else:
        goal = (have / have.sum()) ** ALPHA[dim]
    return goal / goal.sum()


def rake(cells: pd.DataFrame, wanted: dict[str, dict] | None = None, budget: float = BUDGET, sweeps: int = SWEEPS, tolerance: float = TOLERANCE) -> pd.DataFrame:
    """Adds probability, 0 to 1, of the cell's documents (1 in cells without tokens)."""
    out = cells.copy()
    tokens = out["tokens"].to_numpy(float)
    total = tokens.sum()
    fitted = tokens / total if total else tokens
    cap = fitted / budget
    goals = {d: targets(out, d, (wanted or {}).get(d)) for d in DIMS} if total else {}
    for _ in range(sweeps if total else 0):
        moved = 0.0
        for d, goal in goals.items():
            now = out[d].map(pd.Series(fitted).groupby(out[d].to_numpy()).sum()).to_numpy(float)
            scale = np.divide(out[d].map(goal).fillna(0.0).to_numpy(float), now, out=np.ones_like(now), where=now > 0)
            moved = max(moved, float(np.abs(scale[now > 0] - 1).max(initial=0)))
            fitted = np.minimum(fitted * scale, cap)
        if moved < tolerance:
            break
    out["probability"] = np.divide(fitted, cap, out=np.ones_like(tokens), where=tokens > 0)
    return out


def rake_table(cells: DataFrame, wanted: dict[str, dict] | None = None, budget: float = BUDGET, sweeps: int = SWEEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """rake() as Spark jobs, for more cells than a driver holds: one stashed table a sweep, with the same sweeps and end."""
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    cap = F.col("tokens") / F.lit(float(total or 1) * budget)
    now = cells.withColumn("fitted", cap * budget)
    goals = {}
    for d in DIMS:
        if wanted and d in wanted:
            goal = local_table(cells.sparkSession, wanted[d].items(), f"{d} string, g double").join(cells.where("tokens > 0").select(d).distinct(), d)
        else:
            goal = cells.where("tokens > 0").groupBy(d).agg(F.pow(F.sum("tokens") / F.lit(float(total or 1)), F.lit(ALPHA[d])).alias("g"))
        goals[d] = stash(goal)
    sums = {d: goal.agg(F.sum("g")).first()[0] for d, goal in goals.items()}
    for _ in range(sweeps if total else 0):
        moved = 0.0
        for d, goal in goals.items():
            have = now.groupBy(d).agg(F.sum("fitted").alias("have"))
            scale = have.join(goal, d, "left").select(d, F.when(F.col("have") > 0, F.coalesce("g", F.lit(0.0)) / F.lit(sums[d]) / F.col("have")).otherwise(1.0).alias("scale"), "have")
            scale = stash(scale)  # it is read twice, and each sweep's plan stays small
            moved = max(moved, scale.where("have > 0").agg(F.max(F.abs(F.col("scale") - 1))).first()[0] or 0.0)
            now = now.join(scale.drop("have"), d).withColumn("fitted", F.least(F.col("fitted") * F.col("scale"), cap)).drop("scale")
        now = stash(now)
        if moved < tolerance:
            break
    return now.select(*DIMS, "tokens", F.when(F.col("tokens") > 0, F.col("fitted") / cap).otherwise(1.0).alias("probability"))


def probabilities(measured: DataFrame, wanted: dict[str, dict] | None = None, budget: float = BUDGET, driver_cells: int = DRIVER_CELLS) -> DataFrame:
    """(source, lang, topic, probability), stashed, and broadcast up to driver_cells cells. Both ways of raking give the same."""
    cells = stash(measured.groupBy(*DIMS).agg(F.sum("tokens").alias("tokens")))
    if cells.count() > driver_cells:
        return stash(rake_table(cells, wanted, budget)).drop("tokens")
    raked = rake(cells.orderBy(*DIMS).toPandas(), wanted, budget)
    made = local_table(cells.sparkSession, raked.itertuples(index=False), "source string, lang string, topic string, tokens long, probability double")
    return F.broadcast(made.drop("tokens"))


def _draw(seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 53)) / F.lit(float(1 << 53))


def mix(docs: DataFrame, wanted: dict[str, dict] | None = None, budget: float = BUDGET, topics: int = TOPICS, seed: int = SEED, driver_cells: int = DRIVER_CELLS) -> DataFrame:
    """One row per input row: doc_id, source, lang, topic, tokens, probability, sampled.

    wanted: {"source": {value: share}, ...}; a marginal that isn't named is tempered by ALPHA. Values that a named marginal
    leaves out get probability 0. Documents in cells without tokens have the probability 1: they move no marginal.
    Rows repeated under one id share their draw. Null ids have one draw; null sources and languages are the value "?". Texts of
    any length are counted whole. Other columns are ignored, whatever their names. An empty table gives an empty result.
    """
    terms = stash(vectors(docs))
    measured = stash(_measured(terms, _fit(terms, topics)))
    unstash(terms)
    out = measured.join(probabilities(measured, wanted, budget, driver_cells), list(DIMS))
    return out.select("doc_id", *DIMS, "tokens", "probability", (_draw(seed) < F.col("probability")).alias("sampled"))


def marginals(mixed: DataFrame, wanted: dict[str, dict] | None = None) -> DataFrame:
    """(dim, value, target, reached) of what mix() returned: the target shares, and the expected shares of the sample's tokens.

    The bound that a cell has no more tokens than it has can keep a target from being reached; this shows by how much."""
    parts = []
    for d in DIMS:
        have = mixed.groupBy(F.col(d).alias("value")).agg(F.sum("tokens").alias("tokens"), F.sum(F.col("tokens") * F.col("probability")).alias("mass")).where("tokens > 0")
        if wanted and d in wanted:
            have = have.join(local_table(mixed.sparkSession, wanted[d].items(), "value string, goal double"), "value", "left").fillna(0.0, ["goal"])
        else:
            all_ = have.agg(F.sum("tokens").alias("all"))
            have = have.join(F.broadcast(all_)).withColumn("goal", F.pow(F.col("tokens") / F.col("all"), F.lit(ALPHA[d])))
        sums = have.agg(F.sum("goal").alias("goals"), F.sum("mass").alias("masses"))  # one row
        parts.append(have.join(F.broadcast(sums)).select(F.lit(d).alias("dim"), "value", (F.col("goal") / F.col("goals")).alias("target"), (F.col("mass") / F.col("masses")).alias("reached")))
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


def keep_sampled(docs: DataFrame) -> DataFrame:
    """The pipeline stage: the sampled documents, columns unchanged.

    A document's cell is found again where it is read, so texts aren't shuffled, and each row is judged for itself: rows that
    share an id share their draw, but not the probability of another cell. An empty table gives an empty result.
    """
    terms = stash(vectors(docs))
    model = _fit(terms, TOPICS)
    cells = probabilities(stash(_measured(terms, model)))
    unstash(terms)
    names = [unused(docs, f"own_{d}") for d in DIMS]
    topic, plain = names[-1], tuple(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Topics(*plain)
        for whole in batches:
            for b in (whole.slice(at, _ROWS) for at in range(0, whole.num_rows, _ROWS)):
                langs = ["?" if x is None else str(x) for x in b.column("lang").to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own.of(terms_of(_words(b)), langs), pa.string())], [*b.schema.names, topic])

    placed = docs.mapInArrow(give_back(run), StructType([*docs.schema.fields, StructField(topic, StringType())]))
    placed = placed.withColumns({own: F.coalesce(F.col(d).cast("string"), F.lit("?")) for own, d in zip(names[:2], DIMS, strict=False)})
    chance = unused(docs, "own_chance")
    cells = cells.withColumnsRenamed({d: f"cell_{own}" for d, own in zip(DIMS, names, strict=True)} | {"probability": chance})
    same = [F.col(own) == F.col(f"cell_{own}") for own in names]
    return placed.join(cells, same).where(_draw(SEED) < F.col(chance)).select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


QUERIES = {"op8_mixing": op8_mixing}
ORACLES: dict[str, str] = {}
