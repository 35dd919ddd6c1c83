"""Quality rules, collocations and spelling variants against brute force, on odd rows and hot groups."""

import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from panelry.llm import collocations, quality_rules, spelling

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BUCKETS = quality_rules.BUCKETS


def labels_of(spark, good):
    return spark.createDataFrame([(i, 1, 0) for i in good] + [(None, 1, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")


# ---- quality rules -------------------------------------------------------------------------------


def brute_rules(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def brute_grams(text):
    sums = [zlib.crc32(w.encode()) for w in WORD.findall(text or "")]
    return [s % BUCKETS for s in sums] + [(31 * s + t) % BUCKETS for s, t in zip(sums, [*sums[1:], 0])]


def brute_scores(rows, good):
    r, t = Counter(), Counter()
    for i, text in rows:
        r.update(brute_grams(text))
        if i in good:
            t.update(brute_grams(text))
    all_r, all_t = sum(r.values()), sum(t.values())
    weight = lambda b: math.log((t[b] + 1) / (all_t + BUCKETS)) - math.log((r[b] + 1) / (all_r + BUCKETS)) if all_t else 0.0
    return [sum(map(weight, g)) / len(g) if g else 0.0 for g in (brute_grams(text) for _, text in rows)]


def repeating(rng):
    words = [f"w{rng.randrange(12)}" for _ in range(rng.randrange(5, 60))]
    at = rng.randrange(len(words) - 4)
    return " ".join(words + words[at : at + rng.randrange(4, 9)]) + "\n#a|b\nsame line\n same line\nsame line\n\n\n"


def test_rules_equal_brute_force(spark, odd_documents, documents):
    rng = random.Random(1)
    made = documents([(100 + i, repeating(rng)) for i in range(60)])
    docs = odd_documents.union(made)
    good = set(range(100, 140)) | {1, 6, 9}
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    scores = brute_scores(rows, good)
    want = []
    for (i, text), score in zip(rows, scores):
        n, chars, symbols, lines, repeats = brute_rules(text)
        failed = n < 10 or 100 * repeats > 20 * n
        want.append(((i, n, chars, symbols, lines, repeats, failed), score, not failed and score >= quality_rules.LEAST))
    got = quality_rules.judge(docs, labels_of(spark, sorted(good))).collect()
    key = lambda x: (str(x[0]), x[1])
    got = sorted(((tuple(r)[:7], r.score, r.kept) for r in got), key=key)
    want.sort(key=key)
    assert [g[0] for g in got] == [w[0] for w in want] and [g[2] for g in got] == [w[2] for w in want]
    assert [g[1] for g in got] == pytest.approx([w[1] for w in want])


def test_rules_without_labels_or_rows(spark, odd_documents):
    got = quality_rules.judge(odd_documents, labels_of(spark, []).where("doc_id = -1"))
    assert got.where("kept = base_failed or score <> 0").count() == 0
    assert quality_rules.judge(odd_documents.limit(0), labels_of(spark, [1])).count() == 0


def test_trusted_texts_are_the_same_with_and_without_a_broadcast(spark, odd_documents):
    labels = labels_of(spark, [1, 4, 9, 15, 999])
    few, many = (sorted(map(str, quality_rules.trusted_texts(odd_documents, labels, n).collect())) for n in (100, 0))
    assert few == many and len(few) == 5  # both rows of 15


def test_windows_that_share_hash_bits_are_told_apart(spark):
    """Equal hashes of different windows: the exact way decides."""
    words = ["a b c d e f g".split(), "a b c d e a b c d e".split(), "v w x y z a b c d e v w x y z".split()]
    for same in (0, 1 << 40):
        for w in words:
            df = spark.createDataFrame([(w, [same] * (len(w) - 4))], "words array<string>, hashes array<long>")
            got = df.select(quality_rules._covered(F.col("words"), F.col("hashes")).alias("n"), quality_rules._covered_exactly(F.col("words"), F.col("hashes")).alias("m")).first()
            want = brute_rules(" ".join(w))[4]
            assert (got.n, got.m) == (want, want)


def test_rules_run_without_python(spark, odd_documents):
    plan = quality_rules.judge(odd_documents, labels_of(spark, [1]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# ---- collocations --------------------------------------------------------------------------------


def brute_phrases(rows, least, longest, first):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    often = {p: c for p, c in f.items() if c >= least and len(p[1]) > 1}
    inside = {}
    for (lang, w), c in often.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                part = (lang, w[i : i + k])
                inside[part] = max(inside.get(part, 0), c)
    out = []
    for (lang, w), a in often.items():
        if inside.get((lang, w), 0) >= a:
            continue
        score, k, l, r = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out.append((lang, -score, -a, " ".join(w).encode(), a, l, r, n[lang], score))
    out.sort()
    ranked, seen = [], Counter()
    for lang, _, _, phrase, a, l, r, total, score in out:
        seen[lang] += 1
        if seen[lang] <= first:
            ranked.append((lang, seen[lang], phrase.decode(), a, l, r, total, score))
    return ranked


@pytest.mark.parametrize("first", [2000, 7])
def test_collocations_equal_brute_force(spark, first):
    rng = random.Random(2)
    words = ["New", "york", "city", "the", "of", "Übung", "x", "a-b", "état"]
    rows = [(rng.choice(["en", "de", None, "und"]), " ".join(rng.choices(words, weights=[9, 8, 7, 30, 20, 3, 2, 2, 1], k=40)) + rng.choice(". , \t\n") + "new york city hall.") for _ in range(150)]
    rows += [("en", "one two three four five six. One two three four five, six"), ("en", None), (None, ""), ("fr", " \t . ")] * 8 + [("en", "the " * 4000)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, text string, phrase string, h int")
    got = [tuple(r) for r in collocations.collocations(df, least=12, longest=5, first=first).collect()]
    assert sorted(got) == sorted(brute_phrases(rows, 12, 5, first))
    assert any(len(r[2].split()) == 5 for r in got) or first == 7


def test_stripes_of_hot_prefixes_are_cut_and_merge_the_same(spark, monkeypatch):
    rng = random.Random(3)
    rows = [("en", " ".join(f"hot w{rng.randrange(40)}" for _ in range(300))) for _ in range(20)]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    want = brute_phrases(rows, 5, 3, 2000)
    for hot in (2, 1000):
        monkeypatch.setattr(collocations, "HOT", hot)
        assert sorted(tuple(r) for r in collocations.collocations(df, least=5, longest=3).collect()) == sorted(want)


def test_a_task_sends_in_parts_what_it_cannot_hold(spark):
    rng = random.Random(4)
    rows = [("en", " ".join(f"w{rng.randrange(30)}" for _ in range(400))) for _ in range(10)]
    df = spark.createDataFrame(rows, "lang string, text string").coalesce(1)
    words = collocations.word_counts(df)
    marks = collocations.bitmap(words, 30)
    sums = []
    for held in (8, 1 << 18):
        sent = collocations.stripes(df, 2, marks, collocations.np.empty(0, "u8"), held)
        sums.append((sent.count(), sorted(map(str, collocations.merge(sent, 1).collect()))))
    assert sums[0][1] == sums[1][1] and sums[0][0] >= sums[1][0]


def test_collocations_of_nothing(spark):
    assert collocations.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0


# ---- spelling variants ---------------------------------------------------------------------------


def brute_words(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 7:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(n, times=10):
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= times * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n)


def variants(df, **limits):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_words_equal_brute_force(spark, odd_documents, documents):
    rng = random.Random(5)
    made = documents([(i if i % 9 else None, " ".join(rng.choice(["Straßenbahn", "naïveté", "abcdefg", "Hallo", "A×B÷Cdefg", "ŁódźŁódź", "gesture,gestures"]) for _ in range(50))) for i in range(40)])
    docs = odd_documents.union(made)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {r.word: r.n for r in spelling.observed_words(docs).collect()}
    assert got == brute_words(rows) and any(w.startswith("aßenbahn"[:2]) or "stra" in w for w in got)


@pytest.mark.parametrize("group_words,group_rows", [(48, 4096), (1, 2), (10**6, 10**6)])
def test_variants_equal_brute_force(spark, group_words, group_rows, monkeypatch):
    """Words over few letters, so that most share chunks; the same result whether chunks are cut on or not."""
    monkeypatch.setattr(spelling.near_words, "__defaults__", (group_words, group_rows))
    rng = random.Random(6)
    n = {"".join(rng.choices("abé", k=rng.randrange(7, 10))): int(10 ** rng.uniform(0.31, 5)) for _ in range(300)}
    n |= {"z" * 200 + "q" + "z" * 200: 5, "z" * 401: 60, "z" * 400: 700, "z" * 402: 8000}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    assert variants(spelling.spelling_variants(df)) == brute_variants(n)


def test_groups_stay_small_where_all_words_share_a_chunk(spark):
    """Two thousand words that begin alike: pairs that are compared grow with the words, not with their square."""
    made = []
    for size in (500, 2000):
        rng = random.Random(size)
        words = {"commonprefix" + "".join(rng.choices("abcdefghijklmnop", k=8)) for _ in range(size)}
        df = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
        rows = spelling._cut(df.select("word", "n", F.length("word").alias("size"), F.lit(False).alias("longer"), F.lit(0).alias("low"), F.length("word").alias("high")))
        whole = spelling._keyed(rows).groupBy("chunk").count().agg(F.max("count")).first()[0]
        assert whole == len(words)  # the first half is one group
        assert spelling.near_words(df).count() == sum(one_edit(a, b) for a in words for b in words if a < b)
        made.append(whole)
    assert made[1] > 3 * made[0]


def test_no_words_no_variants(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], "word string, n long")).count() == 0
