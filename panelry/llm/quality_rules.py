"""Rule counts of every text, and a hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

All work is in DataFrame functions: the words of a text stay in an array of its row, so counting repeats and scoring
need no shuffle. Only counts per hash bucket (a fixed number) and the labelled texts are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from panelry.llm.shared import saved

#: What separates words: space and \x09-\x0D.
BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
#: Hash buckets of words and word pairs. The weights, one double each, go to every task.
BUCKETS = 1 << 14
#: Bits of a place in a text, next to 40 bits of a hash.
PLACE_BITS = 24
#: Odd multiplier that tells (a, b) from (b, a).
PAIR = 31
#: Added to every bucket's count in both multinomials.
SMOOTHING = 1.0
#: A document stays if its mean log-likelihood ratio per n-gram is at least this.
LEAST = -0.2
#: Ids that are broadcast at most: 8 MB.
FEW_IDS = 1_000_000
#: Bits of the filter in front of the join of labelled texts; its size is fixed.
FILTER_BITS = 1 << 20


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once per row, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def _places_covered(places: Column) -> Column:
    """Words in windows that start at the given places."""
    nothing = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return F.aggregate(
        F.array_sort(places), nothing,
        lambda seen, i: F.struct((seen["n"] + F.least(F.lit(WINDOW), i + WINDOW - seen["end"])).alias("n"), (i + WINDOW).alias("end")),
        lambda seen: seen["n"],
    )


def _beside(found: Column, same: Callable[[Column, Column], Column]) -> Column:
    """The entries of a sorted array that are the same as the entry before or after."""
    equal = lambda a, b: F.coalesce(same(a, b), F.lit(False))
    return F.filter(found, lambda x, at: F.when(at > 0, equal(x, F.get(found, at - 1))).otherwise(False) | equal(x, F.get(found, at + 1)))


def _window(words: Column, place: Column) -> list[Column]:
    return [F.get(words, place + k) for k in range(WINDOW)]


def _covered_exactly(words: Column, hashes: Column) -> Column:
    """Words in windows found twice or more: windows sorted by hash, then by their words."""
    windows = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), F.array(*_window(words, i)).alias("w"), i.alias("i"))))
    return bind(windows, lambda x: _places_covered(F.transform(_beside(x, lambda a, b: (a["h"] == b["h"]) & (a["w"] == b["w"])), lambda w: w["i"])))


def _covered(words: Column, hashes: Column) -> Column:
    """As ``_covered_exactly``, by sorting numbers that hold 40 bits of the hash and the place. Where two different windows
    share the bits, or a text has more words than a place can hold, the exact way takes over."""
    packed = F.array_sort(F.transform(hashes, lambda h, i: h.bitwiseAND(F.lit(-(1 << PLACE_BITS))).bitwiseOR(i.cast("long"))))
    bits = lambda x: F.shiftright(x, PLACE_BITS)
    place = lambda x: x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")

    def differ(x: Column, y: Column) -> Column:
        a, b = _window(words, place(x)), _window(words, place(y))
        return F.array(*a) != F.array(*b)

    def covered(found: Column) -> Column:
        mixed = F.filter(found, lambda x, at: F.when((at > 0) & (bits(x) == bits(F.get(found, at - 1))), differ(x, F.get(found, at - 1))).otherwise(False))
        return F.when(F.size(mixed) == 0, _places_covered(F.transform(found, place))).otherwise(_covered_exactly(words, hashes))

    fast = bind(bind(packed, lambda x: _beside(x, lambda a, b: bits(a) == bits(b))), covered)
    return F.when(F.size(words) >= 1 << PLACE_BITS, _covered_exactly(words, hashes)).otherwise(fast)


def _next(values: Column, steps: int) -> Column:
    return F.slice(values, F.lit(steps + 1), F.size(values))


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def bucket_counts(texts: DataFrame, name: str, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, count) over all n-grams of all texts; every task sends at most one row a bucket.

    Every word gives two: itself, and the pair with the word after it (a last word's pair is with the end).
    """
    words = texts.select(words_of(F.col("text")).alias("words"))
    pairs = words.select(F.explode(F.arrays_zip("words", _next(F.col("words"), 1).alias("after"))).alias("pair"))
    word, after = (F.coalesce(F.crc32(F.col(f"pair.{c}").cast("binary")), F.lit(0)) for c in ("words", "after"))
    both = pairs.select(F.explode(F.array(word % buckets, (word * PAIR + after) % buckets)).alias("bucket"))
    return both.groupBy("bucket").agg(F.count(F.lit(1)).alias(name))


def trusted_texts(docs: DataFrame, labels: DataFrame, few: int = FEW_IDS) -> DataFrame:
    """Texts of documents labelled good. At most ``few`` ids, counted first, are broadcast; with more of them the texts are
    shuffled for a join, and a bitmap of fixed size keeps most other texts away from that."""
    good = saved(labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long")).distinct(), "trusted")
    if good.count() <= few:
        return docs.select("doc_id", "text").join(F.broadcast(good), "doc_id").select("text")
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    bit = F.expr(f"shiftleft(1L, cast(pmod(xxhash64(doc_id), {FILTER_BITS}) % 64 as int))")
    held = good.groupBy((slot / 64).cast("int").alias("at")).agg(F.bit_or(bit).alias("bits"))
    every = docs.sparkSession.range(FILTER_BITS // 64).select(F.col("id").cast("int").alias("at"))
    filled = every.join(held, "at", "left").select(F.struct("at", F.coalesce("bits", F.lit(0)).alias("bits")).alias("s"))
    bitmap = filled.agg(F.array_sort(F.collect_list("s"))["bits"].alias("m"))
    # Few rows, but written once: the filter is then a constant of the plan that reads the texts.
    bits = saved(bitmap, "good").scalar()
    may_hold = F.expr(f"cast(pmod(xxhash64(doc_id), {FILTER_BITS}) % 64 as int)")
    found = F.get(bits, (slot / 64).cast("int"))
    texts = docs.select("doc_id", "text").where(F.call_function("getbit", found, may_hold) == 1)
    return texts.join(good, "doc_id").select("text")


def weights(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> DataFrame:
    """One row with the array of log(target share / corpus share) per bucket.

    Both multinomials are over all their texts: the target over every document labelled good, the corpus over
    every document. Without a labelled document all weights are 0, so that nothing is rejected.
    """
    target = bucket_counts(trusted_texts(docs, labels), "t", buckets)
    corpus = bucket_counts(docs, "r", buckets)
    every = docs.sparkSession.range(buckets).select(F.col("id").alias("bucket"))
    counts = every.join(corpus, "bucket", "left").join(target, "bucket", "left").fillna(0, ["t", "r"])
    rows = F.array_sort(F.collect_list(F.struct("bucket", "t", "r")))
    whole = counts.agg(F.sum("t").alias("all_t"), F.sum("r").alias("all_r"), rows.alias("rows"))
    share = lambda n, total: F.log((n + smoothing) / (total + smoothing * buckets))
    ratio = F.transform("rows", lambda x: share(x["t"], F.col("all_t")) - share(x["r"], F.col("all_r")))
    none = F.transform("rows", lambda x: F.lit(0.0))
    return whole.select(F.when(F.col("all_t") > 0, ratio).otherwise(none).alias("weights"))


def rated(docs: DataFrame, weight: Column, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, the rule counts of the text, and ``score``, its mean log-likelihood ratio per n-gram (0 without words).

    Arrays of the row are columns of their own: each is made once, and sorted as plain numbers.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    cut = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), words_of(text).alias("words"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"), duplicate_lines(text).cast("long").alias("n_dup_lines"),
    )
    kept = ["doc_id", "words", "n_symbols", "n_dup_lines"]
    sums = cut.select(*kept, weight.alias("weight"), F.transform("words", lambda w: F.coalesce(F.crc32(w.cast("binary")), F.lit(0))).alias("sums"))
    pairs = sums.select(*kept, "weight", "sums", F.zip_with(
        "sums", _next(F.col("sums"), 1), lambda a, b: F.coalesce(a, F.lit(0)) * PAIR + F.coalesce(b, F.lit(0))
    ).alias("pairs"))
    summed = lambda grams: F.aggregate(grams, F.lit(0.0), lambda t, g: t + F.get("weight", (g % buckets).cast("int")))
    total = summed("sums") + summed("pairs")
    fours = F.zip_with("pairs", _next(F.col("pairs"), 2), lambda a, b: F.xxhash64(a, b))
    fives = F.zip_with(fours, _next(F.col("sums"), WINDOW - 1), lambda a, b: F.xxhash64(a, b))
    windows = pairs.select(
        *kept, F.when(F.size("pairs") == 0, 0.0).otherwise(total / (2 * F.size("pairs"))).alias("score"),
        F.slice(fives, F.lit(1), F.greatest(F.size("words") - WINDOW + 1, F.lit(0))).alias("hashes"),
    )
    ordered = windows.select(*kept, "score", "hashes", F.sort_array("hashes").alias("ordered"))
    repeats = F.exists(F.zip_with("ordered", _next(F.col("ordered"), 1), lambda a, b: a == b), lambda same: F.coalesce(same, F.lit(False)))
    return ordered.select(
        "doc_id", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols", "n_dup_lines",
        F.when(repeats, _covered(F.col("words"), F.col("hashes"))).otherwise(0).cast("long").alias("n_repeat_words"), "score",
    )


def judge(
    docs: DataFrame, labels: DataFrame, least: float = LEAST, buckets: int = BUCKETS, smoothing: float = SMOOTHING,
) -> DataFrame:
    """Rule counts and verdict of every row of ``docs`` (doc_id, text and any other columns, which are left out).

    ``labels`` holds doc_id and quality; documents with quality 1 are the trusted target. ``base_failed``: fewer than
    ten words, or more than a fifth of the words in repeated windows. ``kept``: not failed, and a score of ``least`` or
    more. Null and empty texts count 0 throughout and fail; equal texts get equal rows; a null doc_id is never
    labelled; an id labelled twice counts once; without labels only the base rules reject. An empty table gives an empty result.
    """
    weight = saved(weights(docs, labels, buckets, smoothing), "weights").scalar()
    counted = rated(docs, weight, buckets)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return counted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (F.col("score") >= least)).alias("kept"), "score",
    )
