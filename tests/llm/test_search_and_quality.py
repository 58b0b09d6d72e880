"""Lexical search, quality and hard negatives against plain Python versions, and what defines their edge cases."""

import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hazardloom.llm import lexical, negatives, quality

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
DOCS = "doc_id long, text string, terms string, n int"


# ---- lexical search

def plain_ranking(docs, items, k):
    split = [(i, lexical.terms(t)) for i, t in docs]
    split = [(i, ts) for i, ts in split if ts]
    n_docs, total, df = len(split), sum(len(ts) for _, ts in split), Counter(t for _, ts in split for t in set(ts))
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for _, text in items for t in lexical.terms(text)}
    out = []
    for item, text in items:
        found = []
        for i, ts in split:
            m, tf = 75 + 25 * len(ts) * n_docs // total, Counter(ts)
            s = sum(weight[t] * (10**9 * tf[t] // (1000 * tf[t] + 12 * m)) for t in lexical.terms(text))
            found += [(-s, i is None, i or 0, i)] if s > 0 else []
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(found)[:k])]
    return out


def lexical_rows():
    r = random.Random(3)
    words = ["the", "The", "a", "é", "Éa", "x1", "no\x00break", "tab\ttab", "naïve", "日本", "under_score", "the-the", "q" * 300] + [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 40)))) for i in range(400)]
    docs += [(500 + i, "the same words w1 w2 again") for i in range(60)] + [(5, "the w1"), (5, "the w1"), (None, "w1 w2 w3"), (None, "w1 w2 w3")]
    docs += [(900, None), (901, ""), (902, "... !!"), (903, "the w7 " * 60_000), (904, "thew7")]
    items = [(i, " ".join(r.choice(words) for _ in range(r.randint(1, 30)))) for i in range(25)]
    items += [(3, items[3][1]), (None, "w1 w1 the"), (50, None), (51, ""), (52, "--"), (53, "unknown words"), (54, "w2 " * 3000)]
    return docs, items


@pytest.mark.parametrize("most", [1 << 20, 3000])
def test_ranked_documents(spark, most):
    docs, items = lexical_rows()
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], DOCS).repartition(5)
    asked = spark.createDataFrame([(*i, "y") for i in items], "item_id long, text string, doc_id string")
    got = [tuple(r) for r in lexical.ranked_documents(frame, asked, k=7, automaton_bytes=most).select("item_id", "rank", "doc_id", "score").collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain_ranking(docs, items, 7)))
    assert lexical.ranked_documents(frame.limit(0), asked).count() == lexical.ranked_documents(frame, asked.limit(0)).count() == 0
    assert lexical.ranked_documents(frame.where("doc_id > 899 AND doc_id < 903"), asked).count() == 0


def test_ranked_documents_of_the_given_tables(spark):
    tables = [spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark")]
    docs, items = [[(r[0], r.text) for r in t.collect()] for t in tables]
    got = [tuple(r) for r in lexical.ranked_documents(*tables).select("item_id", "rank", "doc_id", "score").collect()]
    assert sorted(got) == sorted(plain_ranking(docs, items, 20))


def test_term_counts_of_slices():
    texts = ["a b", None, "", " x-y ", "zé\x7fq", "--", "end"]
    want = [len(lexical.terms(t)) for t in texts]
    assert lexical.term_counts(pa.array(texts)).tolist() == want
    assert lexical.term_counts(pa.array(["skipped", *texts]).slice(1, 6)).tolist() == want[:6]


def test_scores_beyond_doubles_are_exact():
    owners = [(0, 0, 300_000_001), (1, 0, 1)]
    weights, ids = np.array([12_345, 17]), np.array([1, 2])
    args = (np.array([5, 9]), np.array([0, 2, 3]), np.array([0, 1, 0]), np.array([2, 1, 7]))
    big = lexical.Scorer(weights, owners, 1, 2, 14, 5)
    assert not big.exact
    big.add(ids, np.zeros(2, dtype=bool), *args)
    m = [75 + 25 * n * 2 // 14 for n in (5, 9)]
    part = lambda tf, m: 10**9 * tf // (1000 * tf + 12 * m)
    want = [12_345 * 300_000_001 * part(2, m[0]) + 17 * part(1, m[0]), 12_345 * 300_000_001 * part(7, m[1])]
    assert dict(zip(big.best[3].tolist(), big.best[1].tolist())) == {1: want[0], 2: want[1]}


# ---- quality

def plain_features(text):
    """Shares of byte classes and word features of a text's passages, word by word."""
    data, out = text.encode(), []
    words, spans, at = [], [], 0
    for w in data.split():
        at = data.index(w, at)
        spans.append(at)
        words.append(w)
        at += len(w)
    cuts = [0, *spans[quality.WORDS :: quality.WORDS], len(data)] if words else [0, len(data)]
    for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
        ws = words[p * quality.WORDS : (p + 1) * quality.WORDS]
        kinds = [int(quality.byte_classes()[x]) for x in data[a:b]]
        row = [kinds.count(k) / max(1, len(kinds)) for k in range(quality.CLASSES)]
        n, lengths = max(1, len(ws)), [len(w) for w in ws]
        again, repeats = sum(x == y for x, y in zip(ws, ws[1:])), len(set(ws)) / n
        row += [math.log1p(len(ws)), sum(lengths) / n, np.std(lengths) if ws else 0.0, again / n, repeats]
        out.append(row)
    return np.array(out)


@pytest.mark.parametrize("segment", [1 << 20, 700])
def test_passages(segment, monkeypatch):
    monkeypatch.setattr(quality, "SEGMENT", segment)
    r = random.Random(9)
    texts = [" ".join(r.choice(["And", "the", "ü$$$", "9,", "|", "WOW!!"]) for _ in range(r.choice([1, 5, 64, 65, 300, 900]))) for _ in range(30)]
    texts += ["", None, "  \n lead", "trail \n", "x" * 5000, " ", "a b " * 4000]
    got: dict[int, list] = {}
    for x, i in quality.bags(pa.array(["before", *texts]).slice(1)):
        for row, k in zip(x, i.tolist()):
            got.setdefault(k, []).append(row)
    assert list(got) == list(range(len(texts)))
    keep = [*range(quality.CLASSES), *range(quality.CLASSES + quality.BUCKETS, quality.CLASSES + quality.BUCKETS + 5)]
    for k, text in enumerate(texts):
        want = plain_features(text or "")
        assert np.array(got[k])[:, keep] == pytest.approx(want, abs=1e-5), k


def test_gradients_equal_finite_differences():
    r = np.random.default_rng(1)
    many = np.array([1, 4, 2, 7])
    bag, first = np.repeat(np.arange(4), many), np.cumsum(many) - many
    h, y = r.standard_normal((14, 6)), np.array([1.0, 0.0, 0.0, 1.0])
    model = quality.Attention(np.zeros(6), np.ones(6), *[r.standard_normal(s) for s in ((6, 3), (6, 3), 3, 6, 1)])
    _, grads = model.gradients(h, first, bag, y)
    for p, g in zip((model.v, model.u, model.w, model.c, model.b), grads, strict=True):
        for i in np.ndindex(p.shape):
            p[i] += 1e-5
            up = model.gradients(h, first, bag, y)[0]
            p[i] -= 2e-5
            down = model.gradients(h, first, bag, y)[0]
            p[i] += 1e-5
            assert g[i] == pytest.approx((up - down) / 2e-5, abs=1e-7)


def test_attention_finds_the_passage_that_decides():
    r = np.random.default_rng(2)
    many = r.integers(1, 9, 600)
    bag, first = np.repeat(np.arange(600), many), np.cumsum(many) - many
    x, y = r.standard_normal((len(bag), 5)).astype(np.float32), r.integers(0, 2, 600).astype(float)
    marked = first + r.integers(0, many)
    x[marked, 0] = 6.0  # a passage that counts; its second number says how
    x[marked, 1] = np.where(y == 1, 2.0, -2.0)
    model = quality.train(x[: first[500]], bag[: first[500]], y[:500])
    rest = slice(first[500], None)
    assert ((model.scores(x[rest], bag[rest] - 500) >= 0.5) == (y[500:] == 1)).mean() >= 0.9
    attention = model.weights(model.standard(x), first, bag)[0]
    assert np.mean(attention[marked][many > 1]) > 1.5 * np.mean(1 / many[many > 1])


def test_quality_of_the_given_tables(spark):
    docs, labels = (spark.read.parquet(f"{SF.replace('sf0.001', 'sf0.01')}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in quality.quality(docs, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in got.items())
    held = [(got[r.doc_id], r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    good, bad = ([r for r, q in held if q == k] for k in (1, 0))
    assert np.mean([r.predicted for r in good]) > 0.95 and np.mean([r.predicted for r in bad]) < 0.5
    assert np.mean([[g.score > b.score for b in bad] for g in good]) > 0.85


def test_quality_edges(spark):
    rows = [(i, "plain words in a row and more of them" if i % 2 else "$$$ ### $$$ %%% !!", "x", 1) for i in range(40)]
    rows += [(50, None, "x", 1), (51, "", "x", 1), (None, "words", "x", 1), (1, rows[1][1], "y", 2), (52, "word " * 300_000, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, key int").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(1, 0), (None, 1), (50, None), (51, 7)], "doc_id long, quality int")
    got = quality.quality(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert np.mean([r.predicted == r.doc_id % 2 for r in got if r.doc_id is not None and r.doc_id < 40]) == 1
    assert len({r.score for r in got if r.doc_id in (50, 51)}) == 1
    assert {r.score for r in quality.quality(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.quality(docs.limit(0), labels).count() == 0
    assert quality.quality(docs, labels.where("quality = 1")).count() == len(rows)


# ---- hard negatives

def negative_rows(n=900, dim=6):
    x = np.random.default_rng(6).standard_normal((n, dim)).astype(np.float32)
    x[300:600] = x[300]  # a third ties
    x[200] = 0
    rows = [(i, [float(v) for v in x[i]], i % 3, 1) for i in range(n)]
    rows += [(1000, None, 1, 1), (1100, [None] * dim, 1, 1), (1200, [float("nan")] * dim, 1, 1), (1300, [1.0] * dim, None, 1), (None, [1.0] * dim, 1, 1),
             (1400, [1.0], 1, 1), (7, rows[7][1], 1, 1), (7, rows[8][1], 2, 1), (100, [9.0] * dim, 2, 1), (1500, [5.0] * dim, 77, 1), (-100, [0.5] * dim, 1, 1)]
    return rows


def plain_negatives(rows, scale, every=100, dim=6):
    good = [(i, lab, e, [int(np.floor(v * scale)) for v in np.array(e, dtype=np.float32).astype(float)]) for i, e, lab, _ in rows
            if i is not None and lab is not None and e and len(e) == dim and None not in e and np.isfinite(e).all()]
    anchors = {}
    for i, lab, e, v in good:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (e, lab, v)), (e, lab, v))
    out = []
    for a, (_, lab, v) in anchors.items():
        found = sorted((-max(min(sum(p * q for p, q in zip(v, w)), 2**63 - 1), -2**63), i, x) for i, x, _, w in good if i != a)
        for s, p, _ in [f for f in found if f[2] == lab][:5]:
            fits = [f for f in found if f[2] != lab and 30 * -s <= 100 * -f[0] <= 90 * -s][:10]
            out += [(a, p, n + 1, f[1], -s, -f[0]) for n, f in enumerate(fits)]
    return out


@pytest.mark.parametrize("scale, sizes", [(256.0, {}), (256.0, {"block": 100, "anchors": 3}), (2e8, {}), (1e15, {"block": 300})])
def test_hard_negatives(spark, scale, sizes):
    rows = negative_rows()
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, score int").repartition(4)
    got = [tuple(r) for r in negatives.hard_negatives(frame, scale=scale, **sizes).collect()]
    assert sorted(got) == sorted(plain_negatives(rows, scale)) and got
    assert negatives.hard_negatives(frame.limit(0)).count() == negatives.hard_negatives(frame.where("vec_id = 7")).count() == 0
    assert negatives.hard_negatives(frame.where("label = 1")).count() == 0


def test_keys_sort_as_asked():
    cases = [(a, s, p, i) for a in (-5, 0, 2**63 - 1) for s in (-(2**63), -1, 0, 2**63 - 1) for p in (True, False) for i in (-(2**63), 0, 9)]
    keys = sorted(negatives.pack(*c) for c in cases)
    assert [negatives.unpack(k) for k in keys] == sorted(cases, key=lambda c: (c[0], -c[1], not c[2], c[3]))
