"""Document operators against brute force, on odd rows and on the smallest tables."""

import hashlib
import os
import random
import re
import zlib

import pytest

from panelry.llm import minhash_dedup, mixing, packing, queries, sharding, suffix_dedup

SF_DIR = os.environ.get("PANELRY_SF_DIR", "/root/testdata/sf0.001")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def given_documents(spark):
    if not os.path.isdir(SF_DIR):
        pytest.skip("test tables are not here")
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def near(rows, rng):
    """Copies with a word changed, so that chains and groups of links arise."""
    out = list(rows)
    words = [f"w{i}" for i in range(300)]
    for g in range(6):
        text = [rng.choice(words) for _ in range(60)]
        for c in range(15):
            text = list(text) if c % 5 else [*text[:30], *text[30:]]
            text[rng.randrange(60)] = rng.choice(words)
            out.append((1000 + 50 * g + c, " ".join(text)))
    return out


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_near(rows, percent):
    """Sets of rows without ids link with nothing; rows of one id are one document of equal texts here."""
    sets = {}
    for i, t in rows:
        if i is not None:
            sets[i] = shingles(t)
    group = {i: i for i in sets}
    linked = []
    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                linked.append((i, j))
    for _ in sets:
        for i, j in linked:
            group[i] = group[j] = min(group[i], group[j])
    return sorted(str((i, len(shingles(t)), group.get(i))) for i, t in rows)


@pytest.mark.parametrize("block", [3, 128])
def test_near_duplicates_equal_brute_force(spark, documents, odd_documents, monkeypatch, block):
    monkeypatch.setattr(minhash_dedup, "BLOCK_ROWS", block)
    rows = near(rows_of(odd_documents), random.Random(4))
    got = minhash_dedup.near_duplicates(documents(rows), 85).collect()
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in got) == brute_near(rows, 85)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)


def test_a_large_group_with_strays_is_sent_once(spark):
    """What travels grows with the group, not with its square: strays meet every block of it, its blocks never each other."""
    sent = []
    for n in (1000, 4000):
        rows = [(k, i, 0 if i < n else i) for k in (1, 2) for i in range(n + 5 * k)]
        cells = minhash_dedup._cells(spark.createDataFrame(rows, "key long, rep long, component long"))
        sent.append(cells.count())
        met = {}
        for r in cells.collect():
            met.setdefault(r.cell, set()).add(r.component)
        assert all(len(c) > 1 for c in met.values())
    assert sent[0] < 2.5 * 1000 and sent[1] < 4.5 * sent[0]


def test_hot_pivots_are_dealt_to_several_tasks(spark, documents, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "HOT_PIVOT", 3)
    rows = near([], random.Random(5))
    got = minhash_dedup.near_duplicates(documents(rows), 85).collect()
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in got) == brute_near(rows, 85)


@pytest.mark.parametrize("percent", [60, 80, 100])
def test_bands_follow_the_similarity(spark, documents, percent):
    rows = near([], random.Random(percent))
    got = minhash_dedup.near_duplicates(documents(rows), percent).collect()
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in got) == brute_near(rows, percent)
    assert [minhash_dedup.bands_for(p) for p in (80, 85, 100)] == [38, 24, 1]


def test_joining_links_join_what_is_linked():
    import numpy as np

    sets = [np.array(x, np.uint64) for x in ([1, 2, 3, 4], [1, 2, 3, 4, 5], [9, 10], [9, 10], [20])]
    links = minhash_dedup.joining_links(sets, np.arange(5), 80)
    assert links == [(0, 1), (2, 3)]


def test_one_document_of_each_group_stays(documents, odd_documents):
    rows = minhash_dedup.drop_near_duplicates(odd_documents)
    assert rows.columns == odd_documents.columns
    ids = [r.doc_id for r in rows.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 3, 4, 6, 8, 9, 11, 13, 14, 15] and ids.count(None) == 2


def brute_removed(rows, length=50):
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    out, seen, waiting, last = [], set(), [], object()
    for i, t in ordered:
        if i != last:
            for w in waiting:
                seen |= w
            waiting, last = [], i
        x = (t or "").encode()
        own = [x[p : p + length] for p in range(len(x) - length + 1)]
        gone = bytearray(len(x))
        for p, w in enumerate(own):
            if w in seen:
                gone[p : p + length] = b"\1" * length
        waiting.append(set(own))
        kept = bytes(c for c, g in zip(x, gone) if not g)
        spans = sum(1 for p in range(len(x)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.append(str((i, len(x), sum(gone), spans, hashlib.sha256(kept).hexdigest())))
    return sorted(out)


def passages(rng):
    shared = ["".join(rng.choice("ab ") for _ in range(n)) for n in (49, 50, 51, 90, 300)]
    rows = []
    for i in range(60):
        parts = [rng.choice(shared) if rng.random() < 0.5 else "".join(rng.choice("abcdefgh é") for _ in range(rng.randrange(80))) for _ in range(6)]
        rows.append((i * 3 % 60, "".join(parts)))
    return rows + [(70, "ab" * 400), (71, "ba" * 300), (72, "z" * 49), (73, "z" * 50), (74, "z" * 120)]


@pytest.mark.parametrize("buckets", [1, 40])
def test_removed_bytes_equal_brute_force(documents, odd_documents, monkeypatch, buckets):
    rows = [r for r in rows_of(odd_documents)] + [(100 + i, t) for i, t in passages(random.Random(buckets))]
    size = sum(len((t or "").encode()) for _, t in rows)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", size // buckets + 1)
    got = suffix_dedup.remove_repeats(documents(rows))
    assert sorted(str((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept)) for r in got.collect()) == brute_removed(rows)


def test_many_texts_of_one_id_keep_apart(documents):
    """Each text repeats another part of one passage, so marks of another text would cut clean bytes."""
    rng = random.Random(12)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(4000))
    rows = [(1, passage)]
    for i in range(3000):
        at, n = rng.randrange(3900), rng.randrange(20, 100)
        own = "".join(rng.choice("ijklmnop") for _ in range(rng.randrange(60)))
        rows.append((None if i % 2 else 7, own + passage[at : at + n]))
    got = suffix_dedup.remove_repeats(documents(rows)).collect()
    assert sorted(str((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept)) for r in got) == brute_removed(rows)


def phrased(rng, n):
    """A phrase of 40 bytes, and one of 64, in all texts; most neighbours differ, some are shared."""
    menu, notice = "".join(rng.choice("abcdefgh ") for _ in range(40)), "".join(rng.choice("ijklmnop ") for _ in range(64))
    around = ["".join(rng.choice("qrstuvw") for _ in range(30)) for _ in range(n)]
    return [(3 * i % n, around[i] + menu + around[-1 - i // 7] + notice + around[i // 2]) for i in range(n)]


def test_hot_keys_equal_brute_force(documents, monkeypatch):
    rows = phrased(random.Random(8), 400) + [(None, t) for _, t in phrased(random.Random(9), 40)]
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 4000)
    monkeypatch.setattr(suffix_dedup, "HOT_ROWS", 64)
    plan = suffix_dedup.plan_of(documents(rows), len(rows), 20, 50, 24)
    assert 0 < len(plan.hot) < 200
    got = suffix_dedup.remove_repeats(documents(rows))
    assert sorted(str((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept)) for r in got.collect()) == brute_removed(rows)


def test_a_hot_key_is_no_single_group(documents, monkeypatch):
    """No bucket gets more than a few times its share of the regions and windows around a phrase that all texts hold."""
    rng, largest, kind = random.Random(10), [], type(documents([]))
    menu = "".join(rng.choice("abcdefgh ") for _ in range(40))
    rows = [(i, "".join(rng.choice("qrstuvw") for _ in range(30)) + menu + "".join(rng.choice("xyzXYZ") for _ in range(30))) for i in range(2000)]
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 10_000)
    monkeypatch.setattr(suffix_dedup, "HOT_ROWS", 200, raising=False)
    grouped = kind.groupBy

    def seen(df, *by):
        if by == ("bucket",):
            sizes = [sum(len(r[c] or b"") for c in df.columns if c in ("blob", "hot")) for r in df.collect()]
            per = {}
            for r, n in zip(df.select("bucket").collect(), sizes):
                per[r.bucket] = per.get(r.bucket, 0) + n
            largest.append(max(per.values()) / sum(per.values()))
        return grouped(df, *by)

    monkeypatch.setattr(kind, "groupBy", seen)
    suffix_dedup.remove_repeats(documents(rows)).collect()
    assert len(largest) == 2 and max(largest) < 0.2


def test_texts_without_repeats_keep_the_columns(odd_documents):
    cut = suffix_dedup.without_repeats(odd_documents)
    assert cut.columns == odd_documents.columns and cut.dtypes == odd_documents.dtypes
    by_id = {r.doc_id: r for r in cut.collect()}
    assert by_id[10].text == "" and by_id[12].text == "" and by_id[13].text == " tail" and by_id[13].n_chars == 5 and by_id[1].tag == "x"


def test_shards_keep_their_laws(spark, odd_documents, given_documents):
    for docs in (odd_documents, given_documents):
        rows, got = rows_of(docs), sharding.assign_shards(docs, 8).collect()
        sizes = sorted(str((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))) for i, t in rows)
        assert sorted(str((r.doc_id, r.size, r.text_crc32)) for r in got) == sizes
        assert all(r.law == "key" and r.grown_shard in (r.shard, 8) for r in got)
        for shard in range(8):
            slots = sorted(r.slot for r in got if r.shard == shard)
            assert slots == list(range(len(slots)))
    again = {r.doc_id: r.shard for r in sharding.assign_shards(given_documents.where("doc_id % 3 = 0"), 8).collect()}
    assert all(again[r.doc_id] == r.shard for r in got if r.doc_id in again)


def test_jump_hash_moves_only_to_new_shards():
    import numpy as np

    keys = np.random.default_rng(1).integers(0, 2**64, 20_000, dtype=np.uint64)
    before = sharding.jump_hash(keys, 1)
    assert (before == 0).all()
    for n in range(2, 40):
        after = sharding.jump_hash(keys, n)
        moved = after != before
        assert (after[moved] == n - 1).all() and abs(moved.mean() - 1 / n) < 0.02
        before = after


def brute_targets(sizes, weights, share):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    cap, fixed, budget = {s: 2.0 * sizes[s] for s in sizes}, set(), share * sum(sizes.values())
    while True:
        open_ = [s for s in order if s not in fixed]
        left, whole = budget - sum(cap[s] for s in fixed), sum(w[s] for s in open_)
        target = {s: cap[s] if s in fixed else left * w[s] / whole for s in order}
        over = {s for s in open_ if target[s] > cap[s]}
        if not over:
            return target
        fixed |= over


def test_mix_meets_targets(odd_documents, given_documents):
    for docs in (odd_documents, given_documents):
        got = mixing.mix_sources(docs, (5, 2, 1), 1.5).collect()
        want = sorted(str((r.doc_id, r.source, len(WORD.findall(r.text or "")))) for r in docs.collect())
        assert sorted(str((r.doc_id, r.source, r["size"])) for r in got) == want
        sizes = {}
        for r in got:
            sizes[r.source] = sizes.get(r.source, 0) + r["size"]
        target = brute_targets(sizes, (5, 2, 1), 1.5)
        for source in sizes:
            mine = [r for r in got if r.source == source]
            assert all(abs(r.target - target[source]) < 1e-6 * (1 + target[source]) and r.source_size == sizes[source] for r in mine)
            assert all(r.taken in (0, r["size"], 2 * r["size"]) for r in mine)
            assert abs(sum(r.taken for r in mine) - target[source]) <= max([r["size"] for r in mine])
        again = mixing.mix_sources(docs, (5, 2, 1), 1.5).collect()
        assert sorted(str((r.doc_id, r.taken)) for r in again) == sorted(str((r.doc_id, r.taken)) for r in got)


def test_fit_counts_is_exact_where_it_can_be():
    import numpy as np

    rng = np.random.default_rng(2)
    for _ in range(200):
        lengths = np.unique(rng.integers(1, 60, 8))
        counts = rng.integers(1, 5, len(lengths))
        budget = rng.uniform(0, (lengths * counts).sum())
        take = mixing.fit_counts(lengths, counts, budget)
        sums = {0}
        for n, c in zip(lengths, counts):
            sums = {s + int(n) * k for s in sums for k in range(c + 1)}
        assert (take >= 0).all() and (take <= counts).all()
        assert abs((take * lengths).sum() - budget) <= min(abs(s - budget) for s in sums) + lengths.max()


def test_fit_counts_takes_long_documents():
    """Documents longer than the knapsack's reach are fitted too, exactly where they are few."""
    import numpy as np

    assert mixing.fit_counts(np.array([100_000]), np.array([2]), 90_000.0).tolist() == [1]
    assert mixing.fit_counts(np.array([100_000]), np.array([2]), 40_000.0).tolist() == [0]
    rng = np.random.default_rng(3)
    for _ in range(60):
        lengths = np.unique(rng.integers(66_000, 400_000, 5))
        counts = rng.integers(1, 4, len(lengths))
        budget = rng.uniform(0, (lengths * counts).sum())
        take = mixing.fit_counts(lengths, counts, budget)
        sums = {0}
        for n, c in zip(lengths, counts):
            sums = {s + int(n) * k for s in sums for k in range(c + 1)}
        assert (take >= 0).all() and (take <= counts).all()
        assert abs((take * lengths).sum() - budget) <= min(abs(s - budget) for s in sums) + 1
    lengths = np.unique(rng.integers(66_000, 900_000, 5000))
    budget = 0.37 * lengths.sum()
    assert abs((mixing.fit_counts(lengths, np.ones(len(lengths), np.int64), budget) * lengths).sum() - budget) <= 5


def test_mixed_documents_are_the_rows_taken(odd_documents):
    mixed = mixing.mixed_documents(odd_documents)
    assert mixed.columns == odd_documents.columns
    words = sum(len(WORD.findall(r.text or "")) for r in mixed.collect())
    assert words == sum(r.taken for r in mixing.mix_sources(odd_documents).collect())


def test_packing_round_trip(documents, odd_documents, given_documents):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.TOKENIZER)
    tricky = documents([(20, "a <|endoftext|> b"), (21, "  \n\n\t x'll 123 ٣ \u200b end "), (22, "\x00\ud7ff é" * 30), (23, "word " * 5000), (24, " " * 3000)])
    for docs, capacity in ((odd_documents.where("doc_id is not null").dropDuplicates(["doc_id"]), 128), (tricky, 64), (given_documents, 2048)):
        texts = dict(rows_of(docs))
        got = packing.pack(docs, queries.TOKENIZER, queries.RANKS, queries.public_tokenizers.PATTERN, capacity).collect()
        pieces = {}
        for r in sorted(got, key=lambda r: (r.doc_id, r.piece)):
            pieces.setdefault(r.doc_id, []).append(r)
        assert pieces.keys() == texts.keys()
        for i, text in texts.items():
            ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
            start = 0
            for n, r in enumerate(pieces[i]):
                raw = b"".join(x.to_bytes(4, "little") for x in ids[start : start + r.length])
                assert (r.piece, r.start, r.ids_crc32) == (n, start, zlib.crc32(raw)) and (n == 0 or r.length == capacity)
                start += r.length
            assert start == len(ids) and (len(ids) > capacity or len(pieces[i]) == 1)
        sequences = {}
        for r in got:
            sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for members in sequences.values():
            at = 0
            for offset, length in sorted(members):
                assert offset == at
                at += length
            assert at <= capacity
        assert len(sequences) <= 1.03 * sum(r.length for r in got) / capacity + 2


def test_best_two_fit_swaps_the_smallest():
    # Greedy gives 6 + 3 and one place free; 2 + 2 fill what 3 leaves open.
    patterns = packing.best_two_fit({6: 1, 3: 1, 2: 2}, 10)
    assert sorted(patterns[0][0]) == [2, 2, 6] and sum(n for _, n in patterns) == 2


def test_empty_tables(documents):
    none = documents([])
    assert minhash_dedup.near_duplicates(none).collect() == []
    assert suffix_dedup.remove_repeats(none).collect() == []
    assert sharding.assign_shards(none).collect() == []
    assert mixing.mix_sources(none).collect() == []
    assert packing.pack(none, queries.TOKENIZER).collect() == []
