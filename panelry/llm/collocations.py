"""Collocations by stripes: each prefix keys an associative counter of its next words, and stripes merge elementwise.

The stripe of the empty prefix counts the words, and its total is the size of a language. For a prefix of k words its
merged stripe holds the counts of all phrases of k + 1 words that begin so: the extensions, and by their maximum
whether a longer phrase subsumes the prefix. A phrase cannot be more frequent than the shorter phrases in it, so a prefix and a
next word are counted only where both shorter phrases may be frequent; a bitmap tells, and never says no wrongly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from panelry.llm.shared import saved
from panelry.llm.text_arrays import _LOWER, Hasher, buffers, mix, slices, word_spans

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)
#: What ends a piece: .,;:!? and \x0A-\x0D; words are separated by these, by space and by tab.
ENDS = np.zeros(256, bool)
ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
SEPARATORS = ENDS.copy()
SEPARATORS[[0x20, 0x09]] = True
#: Entries that a task holds before it sends its stripes.
HELD = 1 << 18
#: Limits of the bitmap of frequent phrases, which goes to every task: 2 KB to 8 MB.
LEAST_BITS, MOST_BITS = 1 << 14, 1 << 26
#: A prefix with more than one in so many words has its stripe cut into SEGMENTS; fewer than HOT prefixes can have.
HOT, SEGMENTS = 1000, 64


def _lang_hashes(langs: pa.Array) -> np.ndarray:
    """A number for every language."""
    data, at = buffers(langs)
    return Hasher(data).between(at[:-1], at[1:])


def _words(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of (lang, text) rows: lower-cased bytes, starts, ends, owner, hashes and, per word, whether the next one follows in its piece."""
    langs = _lang_hashes(batch.column(0))
    everything, at = buffers(batch.column(1))
    for first, last in slices(at):
        data, cut = _LOWER[everything[at[first] : at[last]]], at[first : last + 1] - at[first]
        starts, ends, counts = word_spans(data, cut, SEPARATORS)
        if not len(starts):
            continue
        owner = np.repeat(np.arange(first, last), counts)
        hashes = mix(Hasher(data).between(starts, ends) + langs[owner] * _STEP)
        passed = np.concatenate(([0], np.cumsum(ENDS[data])))
        follows = np.zeros(len(starts), bool)
        follows[:-1] = (owner[1:] == owner[:-1]) & (passed[starts[1:]] == passed[ends[:-1]])
        yield data, starts, ends, owner, hashes, follows


def _extended(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase from those of its prefix and its last word."""
    return mix(prefix * _STEP + word)


def _spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Byte ranges as strings; what is not UTF-8 cannot occur in a string column."""
    lengths = ends - starts
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    at = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], lengths)
    return pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[at].tobytes())])


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, h, f) of every word of every language: the merged stripe of the empty prefix."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, starts, ends, owner, hashes, _ in _words(batch):
                h, first, n = np.unique(hashes, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(owner[first])), _spans(data, starts[first], ends[first]), pa.array(h.view(np.int64)), pa.array(n)],
                    ["lang", "word", "h", "n"],
                )

    found = docs.mapInArrow(count, "lang string, word string, h long, n long")
    return found.groupBy("lang", "word", "h").agg(F.sum("n").alias("f"))


def bitmap(frequent: DataFrame, rows: int) -> np.ndarray:
    """Bits of the hashes ``h``, sixteen for each within fixed limits: at most 8 MB, however many phrases there are."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * rows).bit_length()))
    slot = F.col("h").bitwiseAND(F.lit(bits - 1))
    words = (
        frequent.select(slot.alias("s")).groupBy((F.col("s") / 32).cast("int").alias("w"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 32 as int))")).alias("m")).toPandas()
    )
    out = np.zeros(bits // 32, np.uint32)
    out[words["w"].to_numpy()] = words["m"].to_numpy().astype(np.uint32)
    return out


def _marked(marks: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes & _U(32 * len(marks) - 1)
    return (marks[slot >> _U(5)] >> (slot & _U(31)).astype(np.uint32)) & 1 == 1


def stripes(docs: DataFrame, length: int, marks: np.ndarray, hot: np.ndarray, held: int = HELD) -> DataFrame:
    """(prefix, segment, next, n): counters of next words after the prefixes of ``length`` - 1 words, as arrays, one row per
    prefix, segment and sending of a task. Stripes of the prefixes in ``hot`` are cut by next word, so none is large."""

    def merged(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        prefix, word, n = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((word, prefix))
        prefix, word, n = prefix[order], word[order], n[order]
        first = np.flatnonzero(np.concatenate(([True], (prefix[1:] != prefix[:-1]) | (word[1:] != word[:-1]))))
        return prefix[first], word[first], np.add.reduceat(n, first)

    def sent(prefix: np.ndarray, word: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        segment = np.where(np.isin(prefix, hot), (word >> _U(32)) % _U(SEGMENTS), _U(0)).astype(np.int32)
        order = np.lexsort((segment, prefix))
        prefix, segment, word, n = prefix[order], segment[order], word[order], n[order]
        new = np.flatnonzero(np.concatenate(([True], (prefix[1:] != prefix[:-1]) | (segment[1:] != segment[:-1]))))
        ends = np.append(new, len(prefix))
        for first in range(0, len(new), 20_000):
            last = min(first + 20_000, len(new))
            low, high = ends[first], ends[last]
            cuts = pa.array((ends[first : last + 1] - low).astype(np.int32))
            yield pa.RecordBatch.from_arrays([
                pa.array(prefix[new[first:last]].view(np.int64)), pa.array(segment[new[first:last]]),
                pa.ListArray.from_arrays(cuts, pa.array(word[low:high].view(np.int64))), pa.ListArray.from_arrays(cuts, pa.array(n[low:high])),
            ], ["prefix", "segment", "next", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            for *_, hashes, follows in _words(batch):
                phrase, whole = hashes, np.ones(len(hashes), bool)
                for k in range(1, length - 1):
                    phrase, whole = _extended(phrase[:-1], hashes[k:]), whole[:-1] & follows[k - 1 : -1]
                maybe = whole & _marked(marks, phrase)
                at = np.flatnonzero(maybe[:-1] & maybe[1:] & follows[length - 2 : -1] if length > 2 else maybe[:-1] & maybe[1:] & follows[:-1])
                if not len(at):
                    continue
                found = merged([(phrase[at], hashes[at + length - 1], np.ones(len(at), np.int64))])
                kept.append(found)
                size += len(found[0])
                if size > held:
                    kept = [merged(kept)]
                    size = len(kept[0][0])
                    if 2 * size > held:
                        yield from sent(*kept[0])
                        kept, size = [], 0
        if kept:
            yield from sent(*merged(kept))

    return docs.mapInArrow(count, "prefix long, segment int, next array<long>, n array<long>")


def merge(sent: DataFrame, least: int) -> DataFrame:
    """Stripes of one prefix and segment added up elementwise: (prefix, next, f, top) of the frequent extensions, where ``top``
    is the largest count of the segment. Only the stripes are shuffled; the merge keeps their partitioning."""
    entries = sent.repartition("prefix", "segment").select("prefix", "segment", F.explode(F.arrays_zip("next", "n")).alias("e"))
    sums = entries.groupBy("prefix", "segment", F.col("e.next").alias("next")).agg(F.sum("e.n").alias("f")).where(F.col("f") >= least)
    return sums.select("prefix", "next", "f")


def frequent_phrases(docs: DataFrame, least: int, longest: int) -> tuple[DataFrame, DataFrame]:
    """Two tables: (lang, phrase, words, h, f, top) of all words and phrases of at most ``longest`` words found ``least``
    times or more, where ``top`` is the largest count of an extension to the right (null: none is frequent), and
    (lang, n) of the languages.

    Words and phrases are told apart by hashes of 64 bits; two words of one hash stop the run instead of mixing.
    """
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    every = saved(word_counts(texts), "words")
    sizes = every.groupBy("lang").agg(F.sum("f").alias("n"))
    total = every.agg(F.sum("f")).first()[0] or 0
    words = saved(every.where(F.col("f") >= least).select("lang", F.col("word").alias("phrase"), F.array("word").alias("words"), "h", "f"), "frequent")
    if not words.groupBy("h").count().where("count > 1").isEmpty():
        raise ValueError("two frequent words share a hash")
    single = words.select(F.col("h").alias("next"), F.col("phrase").alias("word"))
    levels, tops, last = [words], [], words
    for length in range(2, longest + 1):
        many = last.count()
        if not many:
            break
        hot = np.array([r.h for r in last.where(F.col("f") > total / HOT).select("h").collect()], np.int64).view(np.uint64)
        longer = merge(stripes(texts, length, bitmap(last, many), hot), least)
        # The JVM has no twin of the phrase hash, so it is made where the stripes' hashes are read.
        named = longer.mapInArrow(_with_hash, "prefix long, next long, f long, h long")
        known = last.select(F.col("h").alias("prefix"), "lang", "words")
        joined = named.join(known, "prefix").join(single, "next")
        spelt = F.array_append("words", F.col("word"))
        last = saved(joined.select("lang", F.array_join(spelt, " ").alias("phrase"), spelt.alias("words"), "h", "f", "prefix"), "frequent")
        tops.append(last.groupBy("prefix").agg(F.max("f").alias("top")))
        levels.append(last.drop("prefix"))
        last = last.drop("prefix")
    found = []
    for k, level in enumerate(levels):
        top = tops[k].withColumnRenamed("prefix", "h") if k < len(tops) else None
        found.append(level.join(top, "h", "left") if top is not None else level.withColumn("top", F.lit(None).cast("long")))
    out = found[0]
    for level in found[1:]:
        out = out.unionByName(level)
    return saved(out, "phrases"), saved(sizes, "sizes")


def _with_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prefix, word = (np.asarray(batch.column(i)).view(np.uint64) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_extended(prefix, word).view(np.int64))], ["prefix", "next", "f", "h"])


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, first: int = 2000) -> DataFrame:
    """The ``first`` collocations of each language: lang, rank, phrase, a, l, r, n and score.

    Takes lang and text of ``docs``; other columns are ignored. A null lang is ``und``, together with rows that say so; null and
    empty texts hold nothing; repeated rows count as often as they stand there. A phrase is scored by its weakest cut,
    in exact decimals of 38 digits. It is dropped if a longer frequent phrase holds it as often as it occurs: by what
    frequencies of nested phrases are, a phrase longer by one word, at its right (``top``) or at its left, then does too.
    """
    phrases, sizes = frequent_phrases(docs, least, longest)
    candidates = phrases.where(F.size("words") > 1)
    left = candidates.groupBy("lang", F.array_join(F.slice("words", 2, longest), " ").alias("phrase")).agg(F.max("f").alias("held"))
    free = candidates.where("top is null or top < f").join(left, ["lang", "phrase"], "left").where("held is null or held < f")
    cuts = free.select("lang", "phrase", F.col("f").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    parts = cuts.select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("head"),
        F.array_join(F.slice("words", F.col("k") + 1, F.lit(longest)), " ").alias("rest"),
    )
    heads = phrases.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    rests = phrases.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    counted = parts.join(heads, ["lang", "head"]).join(rests, ["lang", "rest"]).join(sizes, "lang")
    exact = {c: F.col(c).cast("decimal(38,0)") for c in ("a", "l", "r", "n")}
    score = F.call_function("div", F.lit(1000).cast("decimal(4,0)") * exact["a"] * exact["n"], exact["l"] * exact["r"])
    scored = counted.withColumn("score", score)
    weakest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("w"))
    flat = weakest.select("lang", "phrase", "a", F.col("w.l").alias("l"), F.col("w.r").alias("r"), "n", F.col("w.score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")
    return flat.withColumn("rank", rank).where(F.col("rank") <= first).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
