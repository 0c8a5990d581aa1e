"""Operator 2, personal data by bootstrapped contextual extraction, in DataFrame functions only.

1. Seeds: e-mail, IP, card and phone patterns find the base spans of every text.
2. Patterns: the words before and after every seed (CONTEXTS: how many on each side; digits masked) are lexical patterns, and so
   are those around every other slot, a run of words with a digit or @. Each distinct pair of pattern and value is an edge.
3. Scores: over the aggregated graph, a pattern's score for a kind is the mean belief in the distinct values of its slot, and a
   value's belief is the noisy-or of the patterns around it that score MIN_PATTERN or more with MIN_VALUES believed values at
   least. Seeds stay at one. Values found in one round support patterns without a seed in the next; rounds end when no belief moves.
4. Discovery: a slot whose value is believed at MIN_BELIEF or more becomes a span wherever a scoring pattern surrounds it.

Regular expressions are written so that a text is scanned in linear time: runs are possessive, and a run is entered
only at its beginning or where the last match ended, which finds the same leftmost non-overlapping matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash, table

KINDS = ("email", "ip", "card", "phone")
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A character without which a text has no match: such texts aren't scanned.
NEEDS = {"email": "@", "phone": "+"}
_APART = r"\s=,;\"'<>\[\]{}|"
_WORD = rf"[^{_APART}0-9@]*+[0-9@][^{_APART}]*+"
#: A slot: up to four words with a digit or @, one space apart.
SLOT = rf"(?<![^{_APART}]){_WORD}(?:\x20{_WORD}){{0,3}}"
#: A name and colon that begin a slot belong to its context, and so do marks at its end.
HEAD, TAIL = r"^[A-Za-z_][A-Za-z_.-]*:", r"[^A-Za-z0-9]+$"
#: Words before and after a slot that make a pattern, taken from NEAR characters on that side.
CONTEXTS, NEAR = ((1, 0), (2, 0), (3, 0), (0, 1), (0, 2), (1, 1), (2, 1), (1, 2)), 64
#: A slot's value must have as many letters, digits or @; believed values that a pattern needs; least scores.
LEAST_LETTERS, MIN_VALUES, MIN_PATTERN, MIN_BELIEF = 6, 3, 0.6, 0.6
#: Patterns that are broadcast; more are joined by shuffling.
FEW = 100_000
_BLOCK = 512


def _found(text: Column, pattern: str, needs: Column) -> tuple[Column, Column]:
    none = F.array().cast("array<string>")
    return F.when(needs, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none), F.when(needs, F.split(text, pattern, -1)).otherwise(none)


def _with_places(df: DataFrame, names: list[str]) -> DataFrame:
    """For each name the columns name_m (matches) and name_p (the pieces around them) become name: an array of (m, s, left, right).

    s is the start in code points; left and right are the NEAR characters on each side, as far as the next match but one. Starts
    are summed in blocks, so that the work is linear in the matches.
    """
    some = lambda k, at: F.slice(f"{k}_p", at, F.size(f"{k}_m"))
    shifted = lambda k: (F.slice(F.concat(F.array(F.lit("")), f"{k}_m"), 1, F.size(f"{k}_m")), F.slice(F.concat(F.col(f"{k}_m"), F.array(F.lit(""))), 2, F.size(f"{k}_m")))
    for k in names:
        before, after = shifted(k)
        left = F.zip_with(before, some(k, 1), lambda m, p: F.struct(F.char_length(p).alias("gap"), F.right(F.concat(m, p), F.lit(NEAR)).alias("left")))
        right = F.zip_with(some(k, 2), after, lambda p, m: F.left(F.concat(p, m), F.lit(NEAR)))
        around = F.zip_with(left, right, lambda x, y: F.struct(x["gap"].alias("gap"), x["left"].alias("left"), y.alias("right")))
        df = df.withColumn(f"{k}_a", F.zip_with(F.col(f"{k}_m"), around, lambda m, x: F.struct(m.alias("m"), x["gap"].alias("gap"), x["left"].alias("left"), x["right"].alias("right"))))
    block = lambda k: F.transform(F.sequence(F.lit(0), F.floor(F.size(f"{k}_a") / _BLOCK).cast("int")), lambda b: F.slice(f"{k}_a", b * _BLOCK + 1, _BLOCK))
    row = "array<struct<m:string,s:int,left:string,right:string>>"
    one = lambda x, at: F.struct(x["m"].alias("m"), at.alias("s"), x["left"].alias("left"), x["right"].alias("right"))
    inner = lambda part: F.aggregate(part, F.struct(F.lit(0).alias("at"), F.array().cast(row).alias("out")), lambda a, x: F.struct((a["at"] + x["gap"] + F.char_length(x["m"])).alias("at"), F.concat(a["out"], F.array(one(x, a["at"] + x["gap"]))).alias("out")))
    df = df.select("doc_id", "rk", *[F.transform(block(k), inner).alias(k) for k in names])
    start = lambda k: F.aggregate(k, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x["at"])))
    moved = lambda x, at: F.transform(x["out"], lambda p: one(p, p["s"] + at))
    return df.select("doc_id", "rk", *[F.flatten(F.zip_with(F.col(k), F.slice(start(k), 1, F.size(k)), moved)).alias(k) for k in names])


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.ltrim(p, F.lit("0"))
        return F.forall(F.split(m, r"\."), lambda p: (F.char_length(part(p)) <= 2) | ((F.char_length(part(p)) == 3) & (part(p) <= "255")))
    if kind == "card":
        d = F.reverse(_digits(m))
        twice = lambda i: F.substr(d, i, F.lit(1)).cast("int") * (F.lit(2) - i % 2)
        luhn = F.aggregate(F.sequence(F.lit(1), F.char_length(d)), F.lit(0), lambda a, i: a + twice(i) - F.when(twice(i) > 9, 9).otherwise(0))
        return F.when(F.char_length(d).between(14, 19), luhn % 10 == 0).otherwise(False)
    if kind == "phone":
        return F.char_length(_digits(m)).between(10, 15)
    return F.lit(True)


def _written(spans: Column) -> Column:
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["rank"])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(rank: int) -> Column:
    return F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")


def _place(start: Column, end: Column, rank: Column, left: Column, right: Column, value: Column) -> Column:
    return F.struct(start.alias("start"), end.alias("end"), rank.alias("rank"), left.alias("left"), right.alias("right"), F.lower(F.regexp_replace(value, r"[\x20()./-]", "")).alias("value"))


def _words(side: Column, n: int, last: bool) -> Column:
    """The n words nearest to the slot, or null if there are fewer or the window cuts them."""
    cut = F.char_length(side) >= NEAR
    words = F.filter(F.split(F.regexp_replace(F.lower(side), "[0-9]", "0"), r"[\s|]+"), lambda w: w != "")
    enough = F.size(words) >= F.when(cut, n + 1).otherwise(n)
    return F.when(enough, F.array_join(F.slice(words, -n if last else 1, n), " "))


def _patterns() -> Column:
    """The patterns around the place p: an array of strings."""
    parts = []
    for a, b in CONTEXTS:
        left, right = (_words(F.col("p.left"), a, True) if a else F.lit("")), (_words(F.col("p.right"), b, False) if b else F.lit(""))
        parts.append(F.concat(F.lit(f"{a}{b} "), left, F.lit(" _ "), right))
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, base and added (arrays of (start, rank, end); rank is the kind's place in KINDS).

    Null texts count as empty. Rows repeated under one id are searched each for itself; equal texts under one id get equal
    results. A text of any length is searched whole. Where several kinds believe in a slot's value, the strongest has it,
    on a tie the first in KINDS. Null ids are allowed. Other columns are ignored, whatever their names. Empty gives empty.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("rk"))
    digit, at = F.col("text").rlike("[0-9]"), F.contains("text", F.lit("@"))
    passes = {k: (BASE[k], F.contains("text", F.lit(NEEDS[k])) if k in NEEDS else digit) for k in KINDS} | {"slot": (SLOT, digit | at)}
    columns = {f"{k}_{x}": c for k, (pattern, needs) in passes.items() for x, c in zip("mp", _found(F.col("text"), pattern, needs), strict=True)}
    seen = _with_places(slim.select("doc_id", "rk", *[c.alias(n) for n, c in columns.items()]), list(passes))

    def seeds(k: str, rank: int) -> Column:
        return F.transform(F.filter(k, lambda x: _valid(k, x["m"])), lambda x: _place(x["s"], x["s"] + F.char_length(x["m"]), F.lit(rank), x["left"], x["right"], x["m"]))

    def slot(x: Column) -> Column:
        head = F.regexp_extract(x["m"], HEAD, 0)
        value = F.regexp_replace(F.substr(x["m"], F.char_length(head) + 1), TAIL, "")
        start = x["s"] + F.char_length(head)
        return _place(start, start + F.char_length(value), F.lit(None).cast("int"), F.right(F.concat(x["left"], head), F.lit(NEAR)), F.concat(F.substr(x["m"], F.char_length(head) + F.char_length(value) + 1), x["right"]), value)

    slots = F.filter(F.transform("slot", slot), lambda p: F.char_length(F.regexp_replace(p["value"], "[^A-Za-z0-9@]", "")) >= LEAST_LETTERS)
    seen = stash(seen.select("doc_id", "rk", F.concat(*[seeds(k, i + 1) for i, k in enumerate(KINDS)]).alias("seeds"), slots.alias("slots")))
    base = F.transform("seeds", lambda p: F.struct(p["start"].alias("start"), p["rank"].alias("rank"), p["end"].alias("end")))
    places = stash(_open_places(seen).select("doc_id", "rk", "p.start", "p.end", "p.rank", "p.value", F.explode(_patterns()).alias("pattern")))
    beliefs, good = believe(places)
    # Slots in a scoring pattern of the kind that their value is believed to be of.
    hit = places.where("rank is null").join(good, "pattern").join(beliefs, ["value", "kind"])
    hit = hit.groupBy("doc_id", "rk", "start", "end").agg(F.max(F.struct("belief", (-F.col("kind")).alias("k"))).alias("best")).select(F.col("doc_id").alias("added_id"), F.col("rk").alias("added_rk"), F.struct("start", (-F.col("best.k")).alias("rank"), "end").alias("span"))
    added = hit.groupBy("added_id", "added_rk").agg(F.collect_set("span").alias("added"))  # at most the slots of one document
    none = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    return seen.select("doc_id", "rk", base.alias("base")).join(added, F.col("doc_id").eqNullSafe(F.col("added_id")) & (F.col("rk") == F.col("added_rk")), "left").select("doc_id", "base", F.coalesce("added", none).alias("added"))


def _open_places(seen: DataFrame) -> DataFrame:
    """(doc_id, rk, p): the seeds, and the slots that no seed of their text overlaps."""
    each = seen.where(F.size("seeds") + F.size("slots") > 0).dropDuplicates(["doc_id", "rk"]).select("doc_id", "rk", F.explode(F.concat("seeds", "slots")).alias("p"))
    own = Window.partitionBy("doc_id", "rk")
    ends = F.max(F.when(F.col("p.rank").isNotNull(), F.col("p.end"))).over(own.orderBy("p.start", F.col("p.rank").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    starts = F.min(F.when(F.col("p.rank").isNotNull(), F.col("p.start"))).over(own.orderBy("p.start", F.col("p.rank").isNull()).rowsBetween(Window.currentRow, Window.unboundedFollowing))
    marked = each.withColumn("till", F.coalesce(ends, F.lit(0))).withColumn("next", starts)
    return marked.where(F.col("p.rank").isNotNull() | ((F.col("till") <= F.col("p.start")) & (F.col("next").isNull() | (F.col("next") >= F.col("p.end"))))).select("doc_id", "rk", "p")


def believe(places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((value, kind, belief) of MIN_BELIEF or more without the seeds, (pattern, kind) that score). places: pattern, value, rank (null: no seed).

    Beliefs only grow, so the rounds end; each is a few aggregations over the distinct edges of patterns that some believed value has.
    """
    edges = stash(places.groupBy("pattern", "value").agg(F.count("*").alias("n")))
    sizes = stash(edges.groupBy("pattern").agg(F.count("*").alias("values")).where(F.col("values") >= MIN_VALUES))
    edges = stash(edges.join(sizes, "pattern"))  # the other patterns can never score
    seeds = stash(places.where("rank is not null").select("value", F.col("rank").alias("kind")).distinct().withColumn("belief", F.lit(1.0)))
    belief, was = seeds, None
    while True:
        scored = edges.join(belief, "value").groupBy("pattern", "kind").agg(F.sum("belief").alias("mass"), F.sum((F.col("belief") >= MIN_BELIEF).cast("long")).alias("held"), F.first("values").alias("values"))
        scored = stash(scored.where(F.col("held") >= MIN_VALUES).withColumn("score", F.col("mass") / (F.col("values") + 1)).where(F.col("score") >= MIN_PATTERN).select("pattern", "kind", "score"))
        n, mass = scored.agg(F.count("*"), F.sum("score")).first()
        good = F.broadcast(scored) if n <= FEW else scored
        if not n or (was is not None and (n, round(mass, 6)) == was):
            break
        was = (n, round(mass, 6))
        found = edges.join(good, "pattern").groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.least("score", F.lit(0.999)))))).alias("belief"))
        belief = stash(seeds.unionAll(found).groupBy("value", "kind").agg(F.max("belief").alias("belief")))
    return belief.where(F.col("belief") >= MIN_BELIEF).join(seeds, ["value", "kind"], "left_anti"), good.select("pattern", "kind")


def op2_pii(spark, sf_dir: str) -> DataFrame:
    out = find_pii(table(spark, sf_dir, "documents"))
    n = [_count(i + 1).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    spans = F.array_union("base", "added")
    return out.select("doc_id", *n, F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(spans).alias("spans"), F.size("added").cast("long").alias("n_added"), F.size(spans).cast("long").alias("n_spans"))


QUERIES = {"op2_pii": op2_pii}
ORACLES: dict[str, str] = {}
