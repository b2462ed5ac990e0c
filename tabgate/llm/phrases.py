"""Phrase collocations: word sequences that stand together more often than the counts of their parts tell.

Texts are cut at marks and line ends into pieces, pieces into words. Every word leads one window of the longest phrase
length, padded with nulls where its piece ends, and only these windows are counted. A phrase is a prefix of exactly those
windows that start where it starts, so ROLLUP over the window's columns sums the windows' counts to those of all shorter
phrases, down to the number of words.

Windows are counted in blocks of BLOCK_BYTES of text first, so a window that is everywhere is a row a block. They leave a
block in order and as one string, which compresses to two thirds of what separate columns take in the shuffle. They are
dealt by all their words but the last. Before the rollup a word that no phrase reaches is taken out of its window, which
then only counts towards shorter phrases.

Every lookup of a part's count is split: parts that many phrases share go to the phrases (there are at most HEAVY_SHARE of
them), the others are joined by key. The best phrases of a language are ranked within SALTS shares of it first.

Defined results: a null text is empty, an empty one has no phrases; a null language counts as `und`; repeated rows count
each time; without rows there are no phrases. Columns of the input other than the text and the language don't matter.
Counts are exact below 10**16.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabgate.llm.arrow_text import LOWER, TextBlock, frees_memory, text_blocks
from tabgate.llm.tables import bounded_batches, stage

NO_LANGUAGE = "und"
#: Bytes that end a piece: . , ; : ! ? and x0A to x0D. Words end at these and at blanks and tabs.
MARK = np.zeros(256, bool)
MARK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
BETWEEN = MARK.copy()
BETWEEN[[0x20, 0x09]] = True

#: Windows are counted in blocks of about this many bytes of text before they leave their task.
BLOCK_BYTES = 4 << 20
#: Rows of a batch handed to the shuffle.
BATCH_ROWS = 1 << 16

#: Parts used by more than one in this many lookups are sent to the phrases; there can't be more of them than this.
HEAVY_SHARE = 2_000
#: Parts used no oftener than this are never sent.
FEWEST_USES = 1_000
#: Shares of a language's phrases that are ranked by themselves before the best of each meet.
SALTS = 256


def _words(block: TextBlock) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The block's words in lower case, the text of each, and whether the next word follows it in its piece."""
    inside = np.zeros(len(block.buf) + 2, bool)
    inside[1:-1] = ~BETWEEN[block.buf]
    cut = np.zeros(len(block.buf) + 1, bool)  # a word ends where its text ends
    cut[block.offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    letters = LOWER[block.buf[inside[1:-1]]]
    words = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
    text = np.searchsorted(block.offsets, starts, "right") - 1
    marks = np.zeros(len(block.buf) + 1, np.int64)
    np.cumsum(MARK[block.buf], out=marks[1:])
    follows = np.zeros(len(starts), bool)
    follows[:-1] = (marks[starts[1:]] == marks[ends[:-1]]) & (text[1:] == text[:-1])
    return words, text, follows


def _counted_windows(block: TextBlock, longest: int) -> Iterator[pa.RecordBatch]:
    """(window, f) of a block's distinct windows, in order."""
    words, text, follows = _words(block)
    if not len(words):
        return
    languages = block.batch["lang"].dictionary_encode()
    coded = words.dictionary_encode()
    # Numbers of words in the order of their bytes, from 1; 0 stands for a null.
    by_bytes = pc.sort_indices(coded.dictionary.cast(pa.binary())).to_numpy()
    number = np.empty(len(by_bytes), np.int64)
    number[by_bytes] = np.arange(1, len(by_bytes) + 1)
    columns = [number[coded.indices.to_numpy()]]
    reaches = np.ones(len(words), bool)
    for k in range(1, longest):
        reaches[: len(words) - k] &= follows[k - 1 : len(words) - 1]
        reaches[max(len(words) - k, 0) :] = False
        columns.append(np.where(reaches, np.roll(columns[0], -k), 0))
    # Windows as single numbers, made dense after each column to stay within 64 bits.
    window = languages.indices.to_numpy().astype(np.int64)[text]
    for column in columns:
        _, window = np.unique(window * (len(by_bytes) + 1) + column, return_inverse=True)
    _, first, counts = np.unique(window, return_index=True, return_counts=True)
    ordered = coded.dictionary.take(pa.array(by_bytes))
    led = []
    for column in columns:
        at = column[first]
        led.append(ordered.take(pa.array(at - 1, mask=at == 0)))
    packed = pc.binary_join_element_wise(*led, " ", null_handling="skip")
    of_first = languages.dictionary.take(pa.array(languages.indices.to_numpy()[text[first]]))
    rows = pa.RecordBatch.from_arrays(
        [pc.binary_join_element_wise(packed, of_first, "\t"), pa.array(counts)], ["window", "f"]
    )
    for start in range(0, len(rows), BATCH_ROWS):
        yield rows.slice(start, BATCH_ROWS)


def windows(docs: DataFrame, longest: int, text: str = "text", lang: str = "lang") -> DataFrame:
    """(window, f): how often a word, those after it in its piece and the language, as "word word word<tab>language", occur
    in a block of texts. Words and blanks beyond the piece's end are left out."""
    bounded_batches(docs.sparkSession)
    language = F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANGUAGE))

    @frees_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for batch in batches:
            waiting.append(batch)
            size += batch.nbytes
            if size >= BLOCK_BYTES:
                yield from counted(waiting)
                waiting, size = [], 0
        yield from counted(waiting)

    def counted(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if batches:
            whole = pa.Table.from_batches(batches).combine_chunks().to_batches()
            for block in (b for batch in whole for b in text_blocks(batch, "text", BLOCK_BYTES)):
                yield from _counted_windows(block, longest)

    return docs.select(language.alias("lang"), F.col(text).alias("text")).mapInArrow(run, "window string, f long")


def counts(led: DataFrame, longest: int, least: int) -> DataFrame:
    """(lang, size, phrase, words, f): every phrase of up to `longest` words that occurs `least` times, as the array of
    its words and joined by spaces; and a row of size 0 for each language with its number of words."""
    columns = [f"w{k}" for k in range(longest)]
    words = F.substring_index("window", "\t", 1)
    lang = F.substring("window", F.length(words) + 1, F.length("window"))  # with the tab
    prefix = F.concat(F.substring_index(words, " ", longest - 1), lang)
    last = F.when(F.length(words) - F.length(F.replace(words, F.lit(" "))) == longest - 1, F.substring_index(words, " ", -1))
    dealt = led.repartition(prefix).select(prefix.alias("prefix"), last.alias("last"), "f")
    counted = dealt.groupBy("prefix", "last").agg(F.sum("f").alias("f"))
    # Words that no phrase reaches go, the last ones first: all windows of a prefix are in one place.
    reached = counted.withColumn("prefix_f", F.sum("f").over(Window.partitionBy("prefix")))
    led_words = F.split(F.substring_index("prefix", "\t", 1), " ")
    apart = reached.select("prefix", "last", "f", "prefix_f", led_words.alias("words"))
    read = [F.get("words", F.lit(k)) for k in range(longest - 1)]
    if longest > 2:
        read[-1] = F.when(F.col("prefix_f") >= least, read[-1])
    merged = apart.select(
        F.substring("prefix", F.instr("prefix", "\t") + 1, F.length("prefix")).alias("lang"), "f",
        *[word.alias(column) for word, column in zip([*read, F.when(F.col("f") >= least, F.col("last"))], columns)],
    )
    rolled = merged.rollup("lang", *columns).agg(F.sum("f").alias("f"), F.grouping_id().alias("_left_out"))
    # The bits of the grouping id that are set are those of the columns summed over: 0, 1, 3, 7, ... A null among the
    # others tells of a window that was padded or merged; such groups are left out before they are shuffled.
    size = F.lit(longest) - F.bit_count("_left_out")
    padded = [(size > k) & F.col(column).isNull() for k, column in enumerate(columns)]
    kept = rolled.filter((size >= 0) & ~reduce(Column.__or__, padded)).filter((size == 0) | (F.col("f") >= least))
    phrase = F.slice(F.array(*columns), F.lit(1), size)
    return kept.select("lang", size.alias("size"), F.array_join(phrase, " ").alias("phrase"), phrase.alias("words"), "f")


def _with_count(cuts: DataFrame, rows: DataFrame, part: str, known: DataFrame, name: str) -> DataFrame:
    """`rows` of `cuts` with the count of the phrase in column `part` as column `name`; all parts are known."""
    uses = cuts.groupBy("lang", part).agg(F.count(F.lit(1)).alias("_uses"))
    many = uses.filter(F.col("_uses") > max(cuts.count() // HEAVY_SHARE, FEWEST_USES))
    facts = known.select("lang", F.col("phrase").alias(part), F.col("f").alias(name))
    heavy = stage(facts.join(many, ["lang", part], "left_semi"), "heavy-parts")
    marked = rows.join(F.broadcast(heavy.withColumnRenamed(name, "_sent")), ["lang", part], "left")
    sent, others = marked.filter("_sent IS NOT NULL"), marked.filter("_sent IS NULL").drop("_sent")
    return others.join(facts, ["lang", part]).unionByName(sent.withColumnRenamed("_sent", name))


def scored(known: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of phrases of two words and more, by the cut that scores lowest."""
    cuts = known.filter("size > 1").select(
        "lang", "phrase", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    )
    cuts = cuts.select(
        "lang", "phrase", "a", "k",
        F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("left_part"),
        F.array_join(F.slice("words", F.col("k") + 1, F.size("words")), " ").alias("right_part"),
    )
    cuts = stage(cuts, "phrase-cuts")
    parts = known.filter("size > 0").select("lang", "phrase", "f")
    both = _with_count(cuts, _with_count(cuts, cuts, "left_part", parts, "l"), "right_part", parts, "r")
    exact = both.withColumn("score", _ratio(F.col("a"), F.col("l"), F.col("r")))
    lowest = exact.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("cut"))
    return lowest.select("lang", "phrase", "cut.a", "cut.l", "cut.r", "cut.score")


def _ratio(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), in decimals: a product of counts may pass 64 bits, the ratio can't."""
    a, left, right = (c.cast("decimal(16,0)") for c in (a, left, right))
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (a * a), left * right)


def _kept(candidates: DataFrame, known: DataFrame, share: int) -> DataFrame:
    """Candidates that no longer one holds in `share` percent of their occurrences."""
    longer = known.filter("size > 2").select(
        "lang", "words", "size", "f", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("inner")
    )
    inside = longer.select(
        "lang", "words", "f", "inner", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("inner") + 1)).alias("at")
    ).select("lang", F.array_join(F.slice("words", F.col("at"), F.col("inner")), " ").alias("phrase"), "f")
    most = inside.groupBy("lang", "phrase").agg(F.max("f").alias("_most"))
    joined = candidates.join(most, ["lang", "phrase"], "left")
    return joined.filter(F.col("_most").isNull() | (100 * F.col("_most") < share * F.col("a"))).drop("_most")


def _first(phrases: DataFrame, top: int) -> DataFrame:
    """The `top` best phrases of each language with their rank: at most `top` of each share of it meet in one task."""
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    salted = phrases.withColumn("_share", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    for keys in (["lang", "_share"], ["lang"]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*best))
        salted = salted.withColumn("rank", rank).filter(F.col("rank") <= top)
    return salted.drop("_share").withColumn("rank", F.col("rank").cast("long"))


def collocations(
    docs: DataFrame, longest: int = 3, least: int = 10, share: int = 50, top: int = 2000, text: str = "text", lang: str = "lang"
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `top` phrases of 2 to `longest` (2 or more) words.

    a is how often the phrase occurs (at least `least` times), l and r how often the two parts of its lowest-scoring cut
    do, n the words of the language. A phrase that some longer one holds in `share` percent of its occurrences is left out.
    """
    known = stage(counts(windows(docs, longest, text, lang), longest, least), "phrases")
    totals = known.filter("size = 0").select("lang", F.col("f").alias("n"))
    best = _first(_kept(scored(known), known, share), top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
