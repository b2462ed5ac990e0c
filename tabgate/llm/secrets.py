"""Secrets in texts: fixed patterns, and runs of characters that look drawn at random.

Two character Markov models of order one give the probability of each next character: one of random strings, one of
ordinary identifiers and words. A run of SHORTEST characters or more is a secret if the logarithm of the ratio of its two
probabilities, summed over the run in thousandths of a bit, reaches LEAST: so much evidence for "random" that it outweighs
one secret in about 65,000 runs. Both models are counted from labelled samples and smoothed by one count a pair; the
ordinary one also takes one character in twenty to be any at all, so that no single pair never seen decides.

Samples are rows (sample, random, weight): by default `random_samples`, strings made from hashes, and `ordinary_samples`,
all runs of 2 to 15 characters of the corpus itself (random strings are longer, so such a run is labelled ordinary). The
corpus is counted whole, word by word before characters, with partial sums; only the table of pairs (CLASSES ** 2 numbers)
reaches the driver and goes into the plan.

Everything is made of SQL functions: no Python runs over the rows. Places of matches come from the lengths of what a
pattern matches and of what lies between, summed within the row: nothing is shuffled to find spans.

Defined results: a null text is an empty one and has no spans; repeated rows are searched each; without any text the
ordinary model knows nothing and every pair is as likely; other columns of the input are carried or ignored as the caller
asks. Places are counted in code points, ends exclusive.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASSIGN, ACCESS, HEX, RANDOM = "assign", "access", "hex", "random"
#: Spans that start at the same place are listed in this order.
KINDS = (ASSIGN, ACCESS, HEX, RANDOM)

ASSIGN_PATTERN = (
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ASSIGN_HINT = r"(?i)password|passwd|secret|token|api_?key"
ASSIGN_VALUE = 12
#: A run of the class is matched whole, so a shortest length within the pattern drops what a later look would.
ACCESS_PATTERN = r"AKIA[A-Z0-9]{14,}"
HEX_PATTERN = r"[0-9a-f]{16,}"

#: Characters that runs are made of; all others share a class, which none of a run's characters falls into.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
CLASSES = len(ALPHABET)
SHORTEST = 16
RUN_PATTERN = rf"[{ALPHABET}]{{{SHORTEST},}}"
LEAST = 16_000
#: The share of an ordinary run's characters that may be any.
ANY = 0.05
#: Rounds of hashes behind the random samples: a bounded, rule-made set.
RANDOM_SAMPLES = 4_096
#: Running sums within a row are taken in blocks of this many.
BLOCK = 256


def random_samples(spark: SparkSession, n: int = RANDOM_SAMPLES) -> DataFrame:
    """(sample, random, weight): n hashes in hexadecimal, in base 64, and in upper case letters with digits."""
    digest = F.sha2(F.col("id").cast("string"), 256)
    base64 = F.base64(F.unhex(digest))
    forms = F.array(digest, F.translate(base64, "=", ""), F.upper(F.translate(base64, "+/=", "")))
    return spark.range(n).select(F.explode(forms).alias("sample"), F.lit(True).alias("random"), F.lit(1).cast("long").alias("weight"))


def ordinary_samples(docs: DataFrame, text: str = "text") -> DataFrame:
    """(sample, random, weight): the runs of 2 to 15 characters of all texts, each with how often it occurs."""
    runs = docs.select(F.explode(F.split(F.coalesce(F.col(text), F.lit("")), rf"[^{ALPHABET}]+", -1)).alias("sample"))
    few = runs.filter(F.length("sample").between(2, SHORTEST - 1))
    return few.groupBy("sample").agg(F.count(F.lit(1)).alias("weight")).select("sample", F.lit(False).alias("random"), "weight")


def _class_at(sample: Column, at: Column) -> Column:
    """The class of a run's character, from 0."""
    return F.call_function("instr", F.lit(ALPHABET), F.substring(sample, at, F.lit(1))) - 1


@dataclass
class Models:
    """For each pair of characters: thousandths of a bit by which the second, after the first, speaks for random."""

    ratios: list[int]

    def score(self, run: Column) -> Column:
        """The log-likelihood ratio of a run, in thousandths of a bit."""
        ratios = F.expr(f"array({','.join(map(str, self.ratios))})")

        def added(total: Column, at: Column) -> Column:
            return total + F.element_at(ratios, _class_at(run, at) * CLASSES + _class_at(run, at + 1) + 1)

        return F.aggregate(F.sequence(F.lit(1), F.length(run) - 1), F.lit(0).cast("long"), added)


def pair_counts(samples: DataFrame) -> DataFrame:
    """(random, pair, n): how often each pair of characters occurs in the samples of a label."""
    places = samples.filter(F.length("sample") > 1).select(
        "sample", "random", "weight", F.explode(F.sequence(F.lit(1), F.length("sample") - 1)).alias("at")
    )
    first, second = _class_at(F.col("sample"), F.col("at")), _class_at(F.col("sample"), F.col("at") + 1)
    known = places.filter((first >= 0) & (second >= 0))  # samples of a caller's own may hold other characters
    pairs = known.select("random", "weight", (first * CLASSES + second).alias("pair"))
    return pairs.groupBy("random", "pair").agg(F.sum("weight").alias("n"))


def train(samples: DataFrame) -> Models:
    """Both models from labelled samples made of ALPHABET."""
    counts = np.ones((2, CLASSES, CLASSES))
    for row in pair_counts(samples).collect():  # at most 2 * CLASSES ** 2 rows
        counts[int(row.random), row.pair // CLASSES, row.pair % CLASSES] += row.n
    chances = counts / counts.sum(axis=2, keepdims=True)
    ordinary = (1 - ANY) * chances[0] + ANY / CLASSES
    ratios = np.floor(1000 * np.log2(chances[1] / ordinary) + 0.5)
    return Models(ratios.astype(int).ravel().tolist())


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value worked out once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sums(numbers: Column) -> Column:
    """(total, before): an array's sum, and the sums of all that stand before each number."""
    start = F.struct(F.lit(0).alias("total"), F.array().cast("array<int>").alias("before"))

    def step(acc: Column, x: Column) -> Column:
        return F.struct((acc["total"] + x).alias("total"), F.array_append(acc["before"], acc["total"]).alias("before"))

    return F.aggregate(numbers, start, step)


def _running(numbers: Column) -> Column:
    """The sums of all that stand before each number, block by block: appending to one long array copies it each time."""
    firsts = F.sequence(F.lit(1), F.greatest(F.size(numbers), F.lit(1)), F.lit(BLOCK))

    def joined(blocks: Column) -> Column:
        offsets = _sums(F.transform(blocks, lambda b: b["total"]))["before"]
        return F.flatten(F.zip_with(blocks, offsets, lambda b, more: F.transform(b["before"], lambda x: x + more)))

    return _let(F.transform(firsts, lambda first: _sums(F.slice(numbers, first, F.lit(BLOCK)))), joined)


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """(start, end, value) of a pattern's matches in a text, leftmost first and without overlaps; value is a group."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    # Before each match stands what the split leaves between; both together tell where the next one begins.
    between = F.transform(F.split(text, pattern, -1), F.length)
    steps = F.zip_with(between, F.transform(whole, F.length), lambda gap, size: F.struct(gap.alias("gap"), size.alias("size")))

    def placed(steps: Column) -> Column:
        before = _running(F.transform(steps, lambda s: s["gap"] + s["size"]))
        spans = F.zip_with(
            before, steps, lambda at, s: F.struct((at + s["gap"]).alias("start"), (at + s["gap"] + s["size"]).alias("end"))
        )
        return F.zip_with(spans, values, lambda s, v: F.struct(s["start"].alias("start"), s["end"].alias("end"), v.alias("value")))

    # The last of the gaps follows the last match.
    return _let(F.filter(steps, lambda s: s["size"].isNotNull()), placed)


NO_MATCHES = "array<struct<start:int,end:int,value:string>>"


def _found(text: Column, hint: str, pattern: str, group: int = 0) -> Column:
    """The matches of a pattern; texts without the hint are not searched."""
    return F.when(text.rlike(hint), matches(text, pattern, group)).otherwise(F.array().cast(NO_MATCHES))


def _spans(found: Column, kind: str) -> Column:
    order = KINDS.index(kind)
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(order).alias("kind"), m["end"].alias("end")))


def _told(spans: Column) -> Column:
    """kind:start:end by start, then kind, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ","
    )


def scan(docs: DataFrame, models: Models, carried: list[Column], text: str = "text", least: int = LEAST) -> DataFrame:
    """The carried columns and, per row, the spans of each kind as arrays of (start, end, value): `assign`, `access`, `hex`,
    and `random`: runs that the models call random and that are no other span, nor an
    assignment's value, already."""
    body = F.coalesce(F.col(text), F.lit(""))
    searched = docs.select(*carried, body.alias("_text"))
    t = F.col("_text")
    found = searched.select(
        *[c for c in searched.columns if c != "_text"],
        F.filter(_found(t, ASSIGN_HINT, ASSIGN_PATTERN, 2), lambda m: F.length(m["value"]) >= ASSIGN_VALUE).alias(ASSIGN),
        _found(t, ACCESS_PATTERN, ACCESS_PATTERN).alias(ACCESS),
        _found(t, HEX_PATTERN, HEX_PATTERN).alias(HEX),
        _found(t, RUN_PATTERN, RUN_PATTERN).alias("_runs"),
    )
    random = _unlisted(F.filter("_runs", lambda m: models.score(m["value"]) >= least))
    return found.withColumn(RANDOM, random).drop("_runs")


def _unlisted(runs: Column) -> Column:
    """The runs that are not a fixed pattern's span, or the value of an assignment, already."""

    def marked(found: Column, run: bool, start: Callable[[Column], Column]) -> Column:
        value = (lambda m: m["value"]) if run else (lambda m: F.lit(None).cast("string"))
        fields = lambda m: (start(m).alias("start"), m["end"].alias("end"), F.lit(run).alias("run"), value(m).alias("value"))
        return F.transform(found, lambda m: F.struct(*fields(m)))

    fixed = [marked(F.col(ASSIGN), False, lambda m: m["end"] - F.length(m["value"]))]
    fixed += [marked(F.col(k), False, lambda m: m["start"]) for k in (ACCESS, HEX)]

    def alone(m: Column, at: Column, sorted_: Column) -> Column:
        previous = F.get(sorted_, at - 1)
        listed = (previous["start"] == m["start"]) & (previous["end"] == m["end"])
        return m["run"] & ~F.coalesce(listed, F.lit(False))

    # Sorted, a run follows the spans of its own place at once.
    both = F.sort_array(F.concat(marked(runs, True, lambda m: m["start"]), *fixed))
    kept = _let(both, lambda all_: F.filter(all_, lambda m, at: alone(m, at, all_)))
    return F.transform(kept, lambda m: m.dropFields("run"))


def secret_spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = LEAST) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans of every row, by models trained on the rows' texts."""
    samples = random_samples(docs.sparkSession).unionByName(ordinary_samples(docs, text))
    found = scan(docs, train(samples), [F.col(doc_id).alias("doc_id")], text, least)
    base = reduce(F.concat, [_spans(F.col(k), k) for k in (ASSIGN, ACCESS, HEX)])
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(_told(base), 256).alias("base_sha256"),
        _told(F.concat(base, _spans(F.col(RANDOM), RANDOM))).alias("spans"),
    )
