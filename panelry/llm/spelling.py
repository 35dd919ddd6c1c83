"""Spelling variants: words one edit apart, found by asymmetric q-chunks, and the form that each variant stands for.

A word is cut into two disjoint chunks. An edit touches one of them and leaves the other whole, so a near word holds the
other chunk as a gram whose place has shifted by one at most. One side of the join gives the two chunks of each word,
the other the grams of equal length at those places; where many words share a chunk, the part that the edit may touch
is cut into two chunks again, and so on, so no group of words is compared pair by pair at large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from panelry.llm.shared import saved

RUN = "([A-Za-zÀ-ÿ]+)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A group is cut again when so many of its words give the chunk, or so many rows share it.
GROUP_WORDS, GROUP_ROWS = 48, 4096


def observed_words(docs: DataFrame, damage: int = 31, length: int = 7, least: int = 2) -> DataFrame:
    """(word, n) of the runs of letters of all texts, A-Z lower-cased, of at least ``length`` code points and ``least`` occurrences.

    A run whose checksum with its document's id is a multiple of ``damage`` loses one code point first, which
    plants known variants. A null doc_id counts as an empty one, a null text holds no word.
    """
    runs = docs.select(F.col("doc_id").cast("string").alias("i"), F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(1))).alias("run"))
    # Losing a code point makes no run longer, so short ones go before any hashing.
    lower = runs.where(F.length("run") >= length).select("i", F.translate("run", UPPER, LOWER).alias("run"))
    checked = lower.withColumn("h", F.crc32(F.concat(F.coalesce("i", F.lit("")), F.lit(":"), F.col("run")).cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = checked.select(F.when(F.col("h") % damage == 0, shorter).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def _shift() -> Column:
    return F.length("word") - F.col("size")


def _cut(rows: DataFrame) -> DataFrame:
    """Both halves of the part [low, high) that the edit may touch."""
    middle = ((F.col("low") + F.col("high")) / 2).cast("int")
    halves = F.array(F.struct(F.col("low").alias("low"), middle.alias("high")), F.struct(middle.alias("low"), F.col("high").alias("high")))
    return rows.select("word", "n", "size", "longer", F.explode(halves).alias("_part")).select("word", "n", "size", "longer", "_part.*")


def _keyed(rows: DataFrame) -> DataFrame:
    """The key is all that the edit leaves whole: what stands before the part and what stands after it."""
    before = F.substring(F.col("word"), F.lit(1), F.col("low"))
    after = F.substring(F.col("word"), F.col("high") + _shift() + 1, F.length("word"))
    return rows.withColumn("chunk", F.xxhash64("size", "low", "high", before, after))


def _pairs(rows: DataFrame) -> DataFrame:
    """Verified pairs of the rows that share a chunk.

    A pair shares several chunks; it counts in the part that holds the first difference, so it is found once.
    """
    a = rows.where("not longer").select("chunk", F.col("word").alias("a"), F.col("n").alias("a_n"), "size", "high")
    b = rows.select("chunk", F.col("word").alias("b"), F.col("n").alias("b_n"), "longer")
    met = a.join(b, "chunk").where("longer or a < b")
    here = (F.col("high") == F.col("size")) | (F.substring("a", F.lit(1), F.col("high")) != F.substring("b", F.lit(1), F.col("high")))
    return met.where(here).where(F.levenshtein("a", "b", 1) == 1).select("a", "a_n", "b", "b_n")


def near_words(words: DataFrame, group_words: int = GROUP_WORDS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(a, a_n, b, b_n): all pairs of the distinct words of ``words`` (word, n) that one edit turns into each other, each once.

    The shorter word of a pair, or either of equal ones, gives chunks; the other gives grams shifted by the difference
    of the lengths. Every level is written to the shared folder.
    """
    chunks = words.select("word", "n", F.length("word").alias("size"), F.lit(False).alias("longer"))
    grams = words.select("word", "n", (F.length("word") - 1).alias("size"), F.lit(True).alias("longer"))
    rows = chunks.union(grams).withColumns({"low": F.lit(0), "high": F.col("size")})
    found = None
    while True:
        keyed = _keyed(_cut(rows))
        sizes = keyed.groupBy("chunk").agg(F.count_if(~F.col("longer")).alias("givers"), F.count(F.lit(1)).alias("met"))
        met = saved(keyed.join(sizes.where("givers > 0 and met > 1"), "chunk"), "chunks")
        large = ((F.col("givers") > group_words) | (F.col("met") > group_rows)) & (F.col("high") - F.col("low") > 1)
        here = _pairs(met.where(~large))
        found = here if found is None else found.union(here)
        rows = met.where(large).select("word", "n", "size", "longer", "low", "high")
        if rows.isEmpty():
            return found


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): follows forms to the last, twice as far in every round. A form is ten times as frequent as
    its word, so no chain is long and none is a ring."""
    roots = saved(forms.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("last"))
        step = saved(roots.join(on, "root", "left").select("word", F.coalesce("last", "root").alias("root"), F.col("last").isNotNull().alias("moved")), "roots")
        roots = step.select("word", "root")
        if step.where("moved").isEmpty():
            return roots


def spelling_variants(words: DataFrame, times: int = 10) -> DataFrame:
    """word, form, root, n, n_near and form_n of every row of ``words`` (word, n; distinct words).

    A word's form is its near word of largest n, ties to the smallest in code-point order, if that n is at least ``times``
    its own. An empty table gives an empty result.
    """
    words = saved(words, "words")
    pairs = near_words(words)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("m")).union(pairs.select("b", "a", "a_n"))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), F.col("other").alias("w"))).alias("best"))
    stands = -F.col("best.m") >= times * F.col("n")
    forms = saved(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(stands, F.col("best.w")).alias("form"), F.when(stands, -F.col("best.m")).alias("form_n"),
    ), "forms")
    return forms.join(_roots(forms), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
