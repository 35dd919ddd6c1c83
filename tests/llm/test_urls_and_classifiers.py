"""The url filter and the two classifiers."""

import os
import random
import re

import pytest

from panelry.llm import quality, toxicity, url_filter
from panelry.llm.queries import QUERIES, RULES

SF_DIR = os.environ.get("PANELRY_SF_DIR", "/root/testdata/sf0.001")


def brute_verdict(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.split("[/?#]", rest)[0]
    path = re.split("[?#]", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fit = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, 0, None, default))
    return host, path, best[2], best[3]


URLS = [
    None, "", "no scheme", "http://", "http://com", "http://com/", "HTTP://WWW.Example.COM/en/x?y#z", "http://example.com/en/", "http://example.com/en",
    "http://a.b.www.example.com/en/q", "http://notexample.com/en/", "ftp://x.net/es/1", "http://net/es/", "http://y.net/fr/?a=/", "http://y.net/FR/",
    "http://.net/es/", "http://a..net/es/", "http://user@x.com:80/en/", "x://y://z.com/", "http://example.com?en/", "http://example.com#/en/",
    "http://ÄB.com/é", "http://example.net/fr/\nnext",
]


@pytest.mark.parametrize("sweep", [3, 40, 4096])
def test_verdicts_equal_brute_force(spark, sweep):
    pages = spark.createDataFrame([(i, u, None, "x", "y", "z") for i, u in enumerate([*URLS, *URLS])], "page_id long, url string, html string, host string, path string, key string")
    more = [*RULES, ("block", "example.com", "/en/x"), ("allow", "b.www.example.com", "/"), ("block", "com", "/en")]
    for rules in (RULES, more):
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, rules, sweep_rows=sweep).collect()}
        assert got == {i: brute_verdict(u, rules) for i, u in enumerate([*URLS, *URLS])}
    assert url_filter.filter_urls(pages.limit(0), RULES).collect() == []


def test_many_rules_are_not_copied(spark):
    """Two thousand nested and plain rules over many ranges: each is in one range, and verdicts stay right."""
    rng = random.Random(8)
    hosts = [f"h{i}.example.com" for i in range(40)] + ["example.com", "com"]
    rules = sorted({(rng.choice(["allow", "block"]), h, "/" + "/".join(rng.choices("ab", k=d))) for h in hosts for d in range(1, 7) for _ in range(12)})
    rules = list({(h, p): (v, h, p) for v, h, p in rules}.values())
    urls = [f"http://{rng.choice(['', 'www.', 'x.y.'])}{rng.choice(hosts)}/{'/'.join(rng.choices('abc', k=rng.randrange(8)))}" for _ in range(600)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    placed = url_filter._ranged(pages, rules, 100)
    assert placed.where("kind = 0").count() == len(rules) > 1000 and placed.select("range").distinct().count() > 10
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, rules, sweep_rows=100).collect()}
    assert got == {i: brute_verdict(u, rules) for i, u in enumerate(urls)}


def test_no_rules_allow_everything(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    assert {(r.rule, r.verdict) for r in url_filter.filter_urls(pages, []).collect()} == {(None, "allow")}


def test_url_plan_is_native(spark):
    if not os.path.isdir(SF_DIR):
        pytest.skip("test tables are not here")
    before = url_filter._entered(spark.read.parquet(f"{SF_DIR}/pages.parquet"))
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (before, QUERIES["op4_url_filter"](spark, SF_DIR))]
    assert not any(word in plan for plan in plans for word in ("Python", "Arrow", "Cartesian", "NestedLoop"))
    assert "ReadSchema: struct<page_id:bigint,url:string>" in plans[0]


def labelled(spark, documents):
    """Insults make a text toxic, also inflected and in long texts; marked-up texts are bad."""
    words, insults = [f"plain{i}" for i in range(200)], ["grumbo", "snarkel", "twibbled"]
    rows, labels = [], []
    for i in range(900):
        text = [words[(i * 7 + 3 * j * j) % 200] for j in range(40 + i % 50)]
        toxic = int(i % 3 == 0)
        if toxic:
            text[i % 40] = insults[i % 9 // 3] + ("" if i % 2 else "ing")
        good = int(i % 4 != 1)
        rows.append((i, " ".join(text) if good else " ".join(w.upper() + "!!" for w in text)))
        labels.append((i, good, toxic if i % 10 else None, "x"))
    return documents(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")


def held_out_accuracy(got, truth):
    held = [(r.predicted, truth(r.doc_id)) for r in got if r.held_out]
    return sum(a == b for a, b in held) / len(held)


def test_toxicity_learns_and_holds_out(spark, documents):
    docs, labels = labelled(spark, documents)
    got = toxicity.score_toxicity(docs, labels).collect()
    assert len(got) == 900 and all(0 <= r.score <= 1 for r in got)
    assert held_out_accuracy(got, lambda i: int(i % 3 == 0)) > 0.97
    # Labels of held-out documents change nothing.
    turned = labels.selectExpr("doc_id", "quality", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - toxic else toxic end toxic")
    assert {r.doc_id: r.score for r in toxicity.score_toxicity(docs, turned).collect()} == {r.doc_id: r.score for r in got}


def test_interactions_raise_what_weights_miss():
    """Either term alone is clean, both together are toxic: no linear score parts them."""
    import numpy as np

    rng = np.random.default_rng(0)
    rows, y = [], []
    for i in range(1200):
        a, b = rng.random(2) < 0.5
        rows.append(np.array(sorted({1} if a else set()) + ([2] if b else []), np.int64))
        y.append(int(a and b))
    model = toxicity.fit_machine(rows, np.array(y))
    w, v = model["w"], model["v"].reshape(-1, toxicity.FACTORS)
    place = {int(t): k for k, t in enumerate(model["held"])}
    score = lambda t: model["bias"][0] + sum(w[place[x]] for x in t) + (v[place[1]] @ v[place[2]] if len(t) == 2 else 0)
    assert score([1, 2]) > 0 > max(score([]), score([1]), score([2]))


@pytest.mark.parametrize("fillers", [5, 20])
def test_pairs_tell_where_their_terms_do_not(fillers):
    """Both terms or none are toxic, one alone is clean: each is in half of the texts of either label."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(6)
    texts, y = [], []
    for i in range(2400):
        toxic, first = i % 2, i // 2 % 2
        own = (["gleep", "marn"] if first else []) if toxic else [["gleep", "marn"][first]]
        texts.append(" ".join(rng.permutation(own + [f"f{k}" for k in rng.choice(100, fillers, replace=False)])))
        y.append(toxic)
    rows = [x for x in toxicity_rows(pa.array(texts[:1800]))]
    score = toxicity.machine_score(toxicity.fit_machine(rows, np.array(y[:1800])))
    assert ((score(pa.array(texts[1800:])) >= 0.5) == np.array(y[1800:])).mean() > 0.9


def toxicity_rows(texts):
    from panelry.llm.labelled import rows_of

    return rows_of(toxicity.terms, texts)


def test_quality_learns_and_holds_out(spark, documents):
    docs, labels = labelled(spark, documents)
    got = quality.score_quality(docs, labels).collect()
    assert held_out_accuracy(got, lambda i: int(i % 4 != 1)) > 0.99
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if r.predicted)


@pytest.mark.parametrize("score", [toxicity.score_toxicity, quality.score_quality])
def test_odd_documents_are_scored(spark, odd_documents, documents, score):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(20)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    got = score(odd_documents, labels).collect()
    assert len(got) == odd_documents.count() and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (2, 3, 4)}) == 1
    assert len({r.score for r in score(odd_documents, labels.limit(0)).collect()}) == 1
    assert score(documents([]), labels).collect() == []


def test_hinge_descent_separates():
    import numpy as np

    rows = [np.array([0, 1]), np.array([0, 2]), np.array([3]), np.array([3, 1])] * 5
    y = np.array([1, 1, 0, 0] * 5)
    w, b = quality.hinge_descent(rows, np.ones(1 << quality.BITS), y, np.random.default_rng(1))
    assert all((w[x].sum() + b > 0) == bool(k) for x, k in zip(rows, y))
