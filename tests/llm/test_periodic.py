"""Runs held against a search of every period at every place."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from panelforge.llm import periodic, queries
from panelforge.llm.common import table

SF = "/root/testdata/sf0.001"


def all_runs(words, least, exponent):
    """(start, length, period) by trying every period: the stretches on which words that far apart agree."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        s = 0
        while s + q < n:
            e = s
            while e + q < n and words[e] == words[e + q]:
                e += 1
            length = e - s + q
            if e > s and length >= max(least, exponent * q, 2 * q):
                found.setdefault((s, s + length), q)
            s = max(e, s) + 1
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def test_random_sequences():
    r = random.Random(5)
    for _ in range(600):
        docs = []
        for _ in range(r.randrange(1, 6)):
            n, k = r.choice([0, 1, 2, 5, 20, 60]), r.choice([1, 2, 2, 3, 5])
            w = [r.randrange(k) for _ in range(n)]
            if n > 5 and r.random() < 0.4:
                a, p = r.randrange(n), r.randrange(1, n // 2 + 1)
                w = [w[min(a + (i - a) % p, n - 1)] if i >= a else x for i, x in enumerate(w)]
            docs.append(w * r.choice([1, 1, 3]))
        least, exponent = r.choice([(2, 2), (6, 3), (4, 2.5), (12, 3), (24, 3)])
        runs, counts = periodic.runs_of(np.array([x for d in docs for x in d], np.int64), np.array([len(d) for d in docs]), least, exponent)
        for d, got in zip(docs, np.split(runs, np.cumsum(counts)[:-1])):
            assert [tuple(x) for x in got.tolist()] == all_runs(d, least, exponent)


def test_long_sequences_stay_linear():
    a, b = [0], [0, 1]
    while len(b) < 100_000:
        a, b = b, b + a
    runs, _ = periodic.runs_of(np.array(b), np.array([len(b)]), 24, 3.0)
    assert len(runs) > 5_000 and all(b[s + q : s + n] == b[s : s + n - q] for s, n, q in runs[::97].tolist())
    runs, _ = periodic.runs_of(np.zeros(200_000, np.int64), np.array([200_000]), 24, 3.0)
    assert runs.tolist() == [[0, 200_000, 1]]


def expected(doc_id, text, planted=True):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if planted and doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = all_runs(words, 24, 3)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    text = " ".join(w for i, w in enumerate(words) if i not in gone)
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    milli = 1000 * best[1] // best[2] if runs else None
    return (len(runs), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_query_equals_search_of_all_periods(spark):
    found = {r[0]: tuple(r[1:]) for r in queries.op11_lpf_runs(spark, SF).collect()}
    docs = [d for d in table(spark, SF, "documents").select("doc_id", "text").collect() if len((d.text or "").split()) < 700]
    assert len(docs) > 150 and any(found[d.doc_id][0] for d in docs)
    for d in docs:
        assert found[d.doc_id] == expected(d.doc_id, d.text)


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(periodic, "SLICE_WORDS", 40)
    loop = "a b c " * 20
    rows = [(1, None, "r"), (2, "", "r"), (3, " \t\n ", "r"), (None, loop, "r"), (4, loop, "r"), (4, loop, "r"), (5, "x " * 24 + "y", "r"), (6, "é\x0bü " * 30, "r"), (7, "p q r s t u v w " * 3 + loop, "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string").withColumn("words", periodic.words_of())
    out = periodic.periodic_runs(docs)
    assert out.columns == ["doc_id", "text", "words", "runs", "collapsed"]
    got = periodic.digest(out).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(str((r[0], *expected(r[0], r[1], False))) for r in rows)
    assert periodic.digest(periodic.periodic_runs(docs.limit(0))).count() == 0
    assert {r.collapsed for r in out.where("doc_id is null").collect()} == {"a b c"}


def test_made_periodic(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.col("id") % 90), lambda x: (x * 7 % 31).cast("string"))).alias("text"))
    found = periodic.digest(periodic.periodic_runs(docs.select("doc_id", periodic.made_periodic(periodic.words_of(), "doc_id").alias("words"))))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in found.collect():
        assert tuple(r[1:]) == expected(r.doc_id, texts[r.doc_id])
