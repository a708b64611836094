import collections
import hashlib
import itertools
import pathlib
import random
import re
import textwrap

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from panelforge.llm import labelled as labelled_module
from panelforge.llm import bitsliced, decontaminate, fuzzylines, licences, maintext, mixing, quality, simhash, substrings, toxicity, union

DOCS = "doc_id long, text string, lang string, source string, n_chars int, size string, score string, n_words string, fingerprint string, spans string"
WORDS = [a + b for a in ("ba", "ke", "li", "mo", "nu", "ra", "so", "ti") for b in ("da", "fe", "gi", "ho", "ju", "pa", "ve", "zo")]


def prose(seed, n):
    r = np.random.default_rng(seed)
    return " ".join(r.choice(WORDS, n))


def fixture_rows():
    base = prose(1, 120)
    near = base.split()
    near[60] = "changed"
    passage = prose(2, 60)
    texts = [None, "", "   \n\t ", "one", "one two", base, base, " ".join(near), f"{prose(3, 50)} {passage} {prose(4, 30)}", f"{passage}\n{prose(5, 70)}", "x " * 3000, prose(6, 20_000), f"{prose(11, 45)} end\n{prose(7, 40)}", f"{prose(11, 45)} end!\n{prose(8, 40)}", "Licensed under the Apache License, Version 2.0.", "ÄÖ ñ " + prose(9, 12)]
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None, len(t or ""), "a", "b", "c", "d", "e") for i, t in enumerate(texts)]
    return [*rows, rows[5], (None, base, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(fixture_rows(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def key(r):
    return (r["doc_id"] is None, r["doc_id"] or 0)


def bag(rows):
    return collections.Counter(map(tuple, rows))


# --- 3


def hits(text, items, window=10):
    w, hit, found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text)), set(), set()
    for k, item in items:
        v = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(item))
        size = min(window, len(v))
        for i, j in itertools.product(range(len(v) - size + 1 if size else 0), range(len(w))):
            if w[j : j + size] == v[i : i + size]:
                hit |= set(range(j, j + size))
                found.add("" if k is None else str(k))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_decontamination(spark, docs, empty, block_bytes):
    base = fixture_rows()[8][1].split()
    items = [(1, " ".join(base[20:45])), (2, "ONE, two!"), (3, None), (None, " ".join(base[80:95])), (2, "nothing here"), (5, ""), (6, "one"), (7, "x x x")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.digest(decontaminate.find_items(docs, bench, keep=["doc_id"], block_bytes=block_bytes)).collect()
    want = [(r[0], *hits(r[1], items)) for r in fixture_rows()]
    have = bag((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in got)
    assert bag(want) == have and all(r.contaminated == (r.n_hit > 0) for r in got) and len(got) == docs.count()
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(not r.contaminated for r in got)
    assert decontaminate.find_items(empty, bench).count() == 0
    assert decontaminate.clean(docs, bench.limit(0)).count() == docs.count()


# --- 10


def print_of(t):
    w = words(low(t))
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_simhash(docs, empty):
    rows = fixture_rows()
    prints = [print_of(r[1]) for r in rows]
    root = list(range(len(rows)))
    for _ in rows:
        for i, j in itertools.combinations(range(len(rows)), 2):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[i] = root[j] = min(root[i], root[j])
    least = {g: min((r[0] for r, x in zip(rows, root) if x == g and r[0] is not None), default=None) for g in root}
    want = bag((r[0], f"{p:016x}", least[g]) for r, p, g in zip(rows, prints, root))
    assert bag(simhash.near_duplicates(docs).collect()) == want
    one = simhash.keep_one(docs)
    assert one.columns == docs.columns and one.count() == len(set(root)) and set(least.values()) <= {r.doc_id for r in one.collect()}
    assert simhash.near_duplicates(empty).count() == 0 == simhash.keep_one(empty).count()


def test_grid_join_finds_every_link(spark):
    r = np.random.default_rng(5)
    base = r.integers(0, 1 << 63, 40, np.int64).astype(np.uint64)
    x = base.copy()
    for _ in range(6):
        flip = np.bitwise_or.reduce([np.uint64(1) << r.integers(0, 64, len(base)).astype(np.uint64) for _ in range(3)], axis=0)
        x = np.unique(np.concatenate((x, base ^ flip)))
    df = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fingerprint long")
    parent = {int(v): int(v) for v in x.view(np.int64)}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in itertools.combinations(x, 2):
        if int(a ^ b).bit_count() <= 3:
            p, q = sorted((find(int(a.view(np.int64))), find(int(b.view(np.int64)))))
            parent[q] = p
    want = collections.Counter(find(v) for v in parent)
    for cell_rows in (20_000, 3):  # the second deals crowded cells to pairs of chunks
        got = {r.node: r.root for r in simhash.classes(df, cell_rows=cell_rows).collect()}
        assert all(got.get(v, v) == find(v) for v in parent), cell_rows
    assert max(want.values()) > 3


def test_components_of_a_long_path(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.root for r in union.components(path).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


# --- 9


def test_substrings(docs, empty):
    rows, seen = fixture_rows(), collections.Counter()
    cut = [words(r[1]) for r in rows]
    for w in cut:
        seen.update(tuple(w[i : i + 35]) for i in range(len(w) - 34))
    want = collections.Counter()
    for r, w in zip(rows, cut):
        gone = {j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        want[r[0], len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)] += 1
    got = substrings.repeated_spans(docs, batches=3)
    assert bag(got.select("doc_id", "n_words", "n_removed", "kept").collect()) == want
    assert all(sum(s.end - s.start for s in r.removed) == r.n_removed for r in got.collect())
    assert substrings.repeated_spans(empty).count() == 0


def test_index_runs_are_merged_and_compacted(spark, tmp_path):
    index = substrings.FingerprintIndex(spark, str(tmp_path), fanout=2)
    batch = lambda *v: spark.createDataFrame([(x, 100 + x, 1) for x in v], substrings.RUN)
    index.add(batch(1, 2))
    run = index.add(batch(2, 3, 3))
    assert {r.anchor for r in index.known(run, index.runs[:1]).collect()} == {2} and {(r.anchor, r.n) for r in run.collect()} == {(2, 1), (3, 2)}
    index.compact()
    assert len(index.runs) == 2
    index.add(batch(9))
    index.compact()
    assert len(index.runs) == 1 and {(r.anchor, r.n) for r in index.read(index.runs, substrings.RUN).collect()} == {(1, 1), (2, 2), (3, 2), (9, 1)}
    assert len(list(tmp_path.iterdir())) == 1


def test_words_that_differ_by_a_pattern_are_not_equal(spark):
    """Two words of 1,024 letters whose polynomial hashes modulo 2**64 agree under every odd base."""
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rest = prose(21, 34)
    df = spark.createDataFrame([(1, f"{word} {rest}"), (2, f"{other} {rest}"), (3, f"{word * 3} {rest}"), (4, f"{word * 2 + other} {rest}")], "doc_id long, text string")
    assert {r.n_removed for r in substrings.repeated_spans(df).collect()} == {0}


def test_passages_of_earlier_calls_are_repeated(spark, tmp_path):
    index = substrings.FingerprintIndex(spark, str(tmp_path), fanout=2)
    passage, near = prose(31, 60), prose(31, 60).split()
    near[30] = "other"
    calls = [
        [(1, f"{prose(32, 40)} {passage} {prose(33, 40)}"), (2, prose(34, 90))],
        [(3, f"{passage} {prose(35, 50)}"), (4, " ".join(near)), (5, prose(36, 80))],
        [(6, prose(34, 90)), (7, f"{prose(37, 20)} {prose(36, 80)[: len(prose(36, 40))]}"), (8, None)],
    ]
    seen, got, want = collections.Counter(), {}, {}
    for rows in calls:
        for _, t in rows:
            w = words(t)
            seen.update(tuple(w[i : i + 35]) for i in range(len(w) - 34))
        for i, t in rows:
            w = words(t)
            want[i] = len({j for a in range(len(w) - 34) if seen[tuple(w[a : a + 35])] > 1 for j in range(a, a + 35)})
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got |= {r.doc_id: r.n_removed for r in substrings.repeated_spans(df, index=index).collect()}
    assert got == want and want[3] == 60 and want[6] == 90 and want[7] == 40 and want[1] == want[4] == want[5] == 0
    assert len(index.runs) == 1  # two runs a call, compacted beyond two


# --- 2


def test_mixing(docs, empty):
    got = mixing.mix(docs)
    rows = got.collect()
    assert len(rows) == docs.count() and all(0 <= r.taken <= 2 * r.size and r.copies in (0, 1, 2) for r in rows)
    assert bag(r[:1] + r[-3:] for r in map(tuple, rows)) == bag(r[:1] + r[-3:] for r in map(tuple, mixing.mix(docs.repartition(5)).collect()))
    sizes = {r.source: r.source_size for r in rows}
    assert sum({r.source: r.target for r in rows}.values()) == pytest.approx(1.5 * sum(sizes.values()))
    assert all(r.target <= 2 * r.source_size + 1e-9 for r in rows)
    assert mixing.mix(empty).count() == 0
    assert all(r.taken == 0 for r in mixing.mix(docs.where("trim(coalesce(text, '')) = ''")).collect())


def test_mix_comes_near_its_targets(spark):
    r = np.random.default_rng(3)
    rows = [(i, " ".join(["w"] * int(n)), f"s{i % 7}" if i % 3 else "hot") for i, n in enumerate(r.lognormal(3, 1, 3000))]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), keep=["doc_id", "source"]).groupBy("source").agg(F.sum("taken").alias("k"), F.first("target").alias("t")).collect()
    assert len(got) == 8 and all(abs(x.k / x.t - 1) < 0.01 for x in got)


# --- 5


def test_bitsliced(spark):
    r = np.random.default_rng(1)
    rows = [(i, [float(x) for x in r.integers(-3, 4, 6) / 8]) for i in range(300)]
    rows += [(300, None), (320, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (340, [float("nan")] * 6), (None, [1.0] * 6), (360, [float("inf")] * 6), (40, rows[40][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    good = [(i, np.floor(64 * np.array(v)).astype(int)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    want = collections.Counter()
    for i, q in good:
        if i % 20 == 0:
            best = sorted(((-int(q @ c), j) for j, c in good if j != i))[:20]
            want.update((i, n + 1, j, -s) for n, (s, j) in enumerate(best))
    for block in (65_536, 64):
        got = bitsliced.search(df, block_rows=block)
        assert bag(x for x in got.where("query_id <> 40").collect()) == collections.Counter({k: 1 for k in want if k[0] != 40})
    for cells in (6 * 64, 1):  # the id 40 comes twice: each row is a query, and each a candidate of others
        twice = collections.Counter((r.query_id, r.vec_id, r.score) for r in bitsliced.search(df.withColumn("score", F.lit("clash")), cells=cells).where("query_id <> 40").collect())
        assert twice == collections.Counter((i, j, s) for i, _, j, s in want if i != 40 for _ in range(1))
    assert bitsliced.search(df.limit(0)).count() == 0


# --- 6


def test_fuzzy_lines(docs, empty):
    got = {(r.doc_id, r.n_lines): r for r in fuzzylines.summary(docs).collect()}
    assert fuzzylines.summary(docs).count() == docs.count()
    assert got[12, 2].n_removed == 0 and got[13, 2].kept_lines == [1]  # the first lines differ by one mark
    assert got[6, 1].n_removed == 1 and got[5, 1].n_removed == 0 and got[0, 0].kept_lines == []
    out = fuzzylines.deduplicated(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    left = {r.doc_id: r.text for r in out.where("doc_id is not null").collect()}
    assert 6 not in left and left[13] == fixture_rows()[13][1].split("\n")[1] and left[11] == fixture_rows()[11][1]
    assert fuzzylines.summary(empty).count() == 0 == fuzzylines.deduplicated(empty).count()


# --- 8


def test_licences(spark):
    rows = [("a/LIC", "Released under the MIT License."), ("a/b/x", "nothing to see"), ("a/b/c/y", None), ("a/b/c/LIC", "Licensed under the Apache License, Version 2.0."), ("z/q", f"{prose(1, 30)}\nLicensed under CC BY-NC 4.0.\n{prose(2, 30)}"), ("z/r", ""), (None, "text"), ("a/b/x", "nothing to see")]
    df = spark.createDataFrame(rows, "path string, text string")
    got = {r.path: (r.licence, r.origin, r.inherited_from) for r in licences.scan(df).collect()}
    assert got["a/LIC"][:2] == ("MIT", "file") and got["a/b/x"] == ("MIT", "inherited", "a") and got["a/b/c/y"] == ("Apache-2.0", "inherited", "a/b/c")
    assert got["z/q"][:2] == ("CC-BY-NC-4.0", "header") and got["z/r"][1] == "none" and got[None][1] == "none"
    assert licences.scan(df).count() == len(rows) and licences.scan(df.limit(0)).count() == 0


# --- 4


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""), ("", ""), ("plain &amp; text", "plain & text"), ("<p>a<br>b<br><br>c", "a b\nc"),
        ("<nav><a href=x>Menu</a></nav><div class='ad'>Buy</div><article><h1>T</h1><p>Short.</p></article><footer>f</footer>", "T\nShort."),
        ("<article><p>The one of the two is in the house and it was for us all, as they have said to me.</p><section class='comments'><p>Nice!</p></section></article>", "The one of the two is in the house and it was for us all, as they have said to me."),
        ("<div><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></div>", ""), ("<script>var a='<p>x</p>'</script>y", "y"), ("<!-- <p>no</p>", ""), ("<p hidden>x</p><p>y  z", "y z"),
        ("<form><p>Mail</p></form><p>Kept", "Kept"), ("<header>H</header><article><header><h1>In</h1></header>Body</article>", "In\nBody"), ("<aside>s</aside><p>unclosed <b>bold", "unclosed bold"),
    ],
)
def test_main_text(page, text):
    assert maintext.extract(page) == text


def test_main_text_frames(spark):
    df = spark.createDataFrame([(1, "u", "<p>x", "old"), (None, None, None, None)], "page_id long, url string, html string, text string")
    assert bag(maintext.digest(maintext.main_text(df)).collect()) == bag([(1, "u", "x", 1), (None, None, "", 0)])
    assert maintext.main_text(df.limit(0)).count() == 0
    assert len(maintext.extract("<p>" + "word of the " * 200_000)) == 12 * 200_000 - 1


# --- 1 and 7


def labelled(spark, kind, n=400):
    r = np.random.default_rng(8)
    rows, marks = [], []
    for i in range(n):
        bad = i % 4 == 0
        text = prose(i, int(r.integers(20, 80)))
        if bad and kind == "toxic":
            w = text.split()
            w.insert(int(r.integers(len(w))), "vileword" + str(r.choice(["en", "st", ""])))
            text = " ".join(w)
        elif bad:
            text = " | ".join(text.split())
        rows.append((i, text, "x"))
        marks.append((i, int(bad) if kind == "toxic" else int(not bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(marks, f"doc_id long, {kind} int")


def share_right(found, labels, kind):
    both = found.join(labels, "doc_id").where(f"crc32(cast(cast(doc_id as string) as binary)) % 5 = 0")
    return both.select(F.avg((F.col("predicted") == F.col(kind)).cast("double"))).first()[0]


def test_toxicity_on_held_out_rows(spark, docs, empty):
    d, labels = labelled(spark, "toxic")
    net = toxicity.learn(d, labels)
    found = toxicity.scored(d, net)
    assert found.columns == ["doc_id", "text", "score", "predicted", "language"] and share_right(found, labels, "toxic") > 0.95
    out = toxicity.scored(docs, net, keep=["doc_id"]).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    assert toxicity.scored(empty, net).count() == 0 and toxicity.clean(docs, net).columns == docs.columns
    assert toxicity.learn(d, labels.limit(0)) == 0.0 and toxicity.clean(docs, 0.0).count() == docs.count()


def test_quality_on_held_out_rows(spark, docs, empty):
    d, labels = labelled(spark, "quality")
    rules = quality.learn(d, labels)
    found = quality.scored(d, rules, threshold=0.5)
    assert share_right(found, labels, "quality") > 0.95 and 0 < len(rules.rules) < 200
    x = quality.statistics(pa.array([r.text for r in d.orderBy("doc_id").collect()]))
    assert np.allclose(rules.scores(x), [r.score for r in found.orderBy("doc_id").collect()])  # compiled rules score as the model does
    out = quality.scored(docs, rules, keep=["doc_id"]).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    assert quality.scored(empty, rules).count() == 0
    assert {r.score for r in quality.scored(docs, quality.learn(d, labels.limit(0))).collect()} == {0.5}


def test_buckets_join_what_all_their_pairs_would_join(spark):
    """Variants of a few lines, some of them only near each other and not the ends of their buckets; small blocks force rounds."""
    rng = random.Random(5)
    words = [f"word{i:03d}x" for i in range(400)]
    texts = set()
    for _ in range(4):
        base = rng.sample(words, 40)
        for _ in range(60):
            line = list(base)
            for i in rng.sample(range(40), rng.choice([2, 3, 4, 5, 6])):
                line[i] = rng.choice(words)
            texts.add(" ".join(line))
    lines = spark.createDataFrame([(t,) for t in sorted(texts)], "line string").select(F.xxhash64("line").alias("h"), "line")
    signed = fuzzylines.signed(lines)
    sets = {r.h: frozenset(r.s) for r in lines.select("h", fuzzylines.shingle_set().alias("s")).collect()}
    members = {}
    for r in fuzzylines.bands(signed).collect():
        members.setdefault(r.key, []).append(r.h)
    root = {h: h for h in sets}

    def find(h):
        while root[h] != h:
            h = root[h]
        return h

    for group in members.values():
        for a, b in itertools.combinations(group, 2):
            if len(sets[a] & sets[b]) * 5 >= len(sets[a] | sets[b]) * 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    want = {h: find(h) for h in sets if any(find(o) == find(h) for o in sets if o != h)}
    assert max(map(len, members.values())) > 6 and len(set(want.values())) > 2
    for block in (2, 64):
        assert {r.node: r.root for r in fuzzylines.linked(lines, signed, block=block).collect()} == want


def test_fuzzy_lines_against_all_pairs(spark):
    """Recall of links and the surviving lines, against a comparison of all pairs of lines over all their shingles."""
    rng = random.Random(11)
    words = [a + b for a in WORDS for b in ("", "s", "ra")]
    lines = []
    for _ in range(60):
        base = [rng.choice(words) for _ in range(rng.choice([6, 12, 30, 80]))]
        lines.append(" ".join(base))
        for _ in range(rng.choice([0, 1, 4])):
            line = list(base)
            for i in rng.sample(range(len(line)), rng.choice([1, 1, 2])):
                line[i] = rng.choice(words)
            lines.append(" ".join(line))
    lines += ["", " ", "abc", "abcd", "\u2028", "\u0085", "abcdefgh", "abcdefghi", lines[0]]
    rng.shuffle(lines)
    texts = ["\n".join(lines[i : i + 3]) for i in range(0, len(lines), 3)]
    rows = [(i, t) for i, t in enumerate(texts)]
    flat = [(i, j, line) for i, t in rows for j, line in enumerate(t.split("\n")) if re.search(r"[^ \t\n\x0b\f\r]", line)]
    cut = [{x[i : i + 5] for i in range(max(1, len(x) - 4))} for _, _, x in flat]
    root = list(range(len(flat)))

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    links = [(a, b) for a, b in itertools.combinations(range(len(flat)), 2) if len(cut[a] & cut[b]) * 5 >= len(cut[a] | cut[b]) * 4]
    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {(r.doc_id, p) for r in fuzzylines.summary(spark.createDataFrame(rows, "doc_id long, text string")).collect() for p in r.kept_lines}
    want = {flat[i][:2] for i in range(len(flat)) if find(i) == i}
    gone = len(flat) - len(want)
    assert len(links) > 60 and want <= got and len(flat) - len(got) >= 0.95 * gone  # a link that no band shows keeps a line more
    signed = fuzzylines.signed(spark.createDataFrame([(t,) for _, _, t in flat], "line string").select(F.xxhash64("line").alias("h"), "line")).collect()
    keys = {r.h: set(r["keys"]) for r in signed}
    h = [r.h for r in spark.createDataFrame([(i, x[2]) for i, x in enumerate(flat)], "i int, line string").orderBy("i").select(F.xxhash64("line").alias("h")).collect()]
    found = sum(h[a] == h[b] or bool(keys.get(h[a], set()) & keys.get(h[b], set())) for a, b in links)
    assert found >= 0.95 * len(links)


def test_fuzzy_lines_defined_cases(spark):
    long = " ".join(WORDS) * 900
    rows = [(1, long, 9, "x"), (2, f"{long}!\n\u2028", 9, "y"), (3, "\u0085", 1, "z"), (4, None, None, None), (4, None, None, None), (5, "ab\n\nab", 2, "k"), (5, "ab\n\nab", 2, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, kept string")
    got = collections.Counter((r.doc_id, r.n_lines, r.n_removed, tuple(r.kept_lines)) for r in fuzzylines.summary(df).collect())
    assert got == collections.Counter({(1, 1, 0, (0,)): 1, (2, 2, 1, (1,)): 1, (3, 1, 0, (0,)): 1, (4, 0, 0, ()): 2, (5, 2, 1, (0,)): 2})
    out = {r.doc_id: (r.text, r.n_chars, r.kept) for r in fuzzylines.deduplicated(df).collect()}
    assert out[2] == ("\u2028", 1, "y") and out[5] == ("ab\n", 3, "k") and out[1] == (long, len(long), "x")
    with pytest.raises(ValueError, match="own use"):
        fuzzylines.summary(df.withColumnRenamed("kept", "__line_kept"), key="__line_kept")


def test_near_lines_meet_wherever_they_differ(spark):
    """One character put in, taken out or changed, in lines with and without spaces, against all 5-character shingles."""
    rng = random.Random(3)
    cjk = "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(1000))
    url = "https://example.org/" + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789/-") for _ in range(400))
    plain = "The committee will meet again on the second Monday of next month at noon"
    pairs = [(cjk, "x" + cjk), (url, url[:22] + url[23:]), (plain, plain.replace("Monday", "Mondax")), (plain[:40], plain[:30]), ("abcd", "abce"), (cjk[:300], cjk[500:800])]
    cut = lambda t: {t[i : i + 5] for i in range(max(1, len(t) - 4))}
    near = [len(cut(a) & cut(b)) * 5 >= len(cut(a) | cut(b)) * 4 for a, b in pairs]
    assert near == [True, True, True, False, False, False]
    for (a, b), joined in zip(pairs, near, strict=True):
        sets = [r.s for r in spark.createDataFrame([(a,), (b,)], "line string").select(fuzzylines.shingle_set().alias("s")).collect()]
        assert [len(x) for x in sets] == [len(cut(a)), len(cut(b))] and len(set(sets[0]) & set(sets[1])) == len(cut(a) & cut(b))
    docs = spark.createDataFrame([(2 * i + j, t) for i, p in enumerate(pairs) for j, t in enumerate(p)], "doc_id long, text string")
    gone = {r.doc_id for r in fuzzylines.summary(docs).where("n_removed = 1").collect()}
    assert gone == {2 * i + 1 for i, joined in enumerate(near) if joined}


def test_links_of_blocks_against_all_pairs(spark):
    """One near pair among lines of one bucket that are unlike: what the first words of parity leave is compared in full."""
    rng = random.Random(29)
    words = [f"w{i:03d}" for i in range(300)]
    base = rng.sample(words, 50)
    lines = [" ".join(base), " ".join([*base[:-1], "other"])] + [" ".join(rng.sample(words, 50)) for _ in range(30)]
    cut = [{t[i : i + 5] for i in range(len(t) - 4)} for t in lines]
    assert [(a, b) for a, b in itertools.combinations(range(32), 2) if len(cut[a] & cut[b]) * 5 >= len(cut[a] | cut[b]) * 4] == [(0, 1)]
    texts = spark.createDataFrame([(t,) for t in lines], "line string").select(F.xxhash64("line").alias("h"), "line")
    members = texts.select(F.lit(1).cast("long").alias("key"), "h", F.col("h").alias("root"))
    near = tuple(sorted(r.h for r in texts.collect() if r.line in lines[:2]))
    for block in (3, 64):
        assert {(r.a, r.b) for r in fuzzylines.links_of_blocks(members, texts, block).collect()} == {near}


def licence_file(name):
    return (pathlib.Path(licences.__file__).parent / "licence_texts" / f"{name}.txt").read_text()


def test_licence_files_and_headers_of_several_lines(spark):
    wrapped = "\n".join(f"# {line}" for line in textwrap.wrap(dict(licences.HEADERS)["GPL-2.0"], 70))
    apache = "\n".join(f" * {line}" for line in textwrap.wrap(dict(licences.HEADERS)["Apache-2.0"], 70))
    code = "\n".join(f"{prose(i, 6)} = {prose(i + 500, 4)}" for i in range(80))
    fill = lambda t: t.replace("<year>", "2019").replace("<copyright holders>", "Ada Example").replace("<copyright holder>", "Ada Example")
    names = ["MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Unlicense", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0"]
    rows = [(f"{n}/LICENSE", "\n".join(textwrap.wrap(fill(licence_file(n)), 76))) for n in names] + [(f"{n}/src/{i}.c", prose(i + 40, 90)) for i, n in enumerate(names)]
    rows += [("h/gpl.py", f"#!/bin/sh\n#\n{wrapped}\n\n{code}"), ("h/apache.c", f"/*\n{apache}\n */\n{code}"), ("h/mid.txt", f"{code}\n{fill(licence_file('MIT'))}\n{code}"), ("h/none.c", code)]
    rows += [(f"other/{i}", prose(i + 300, 200)) for i in range(60)]
    got = {r.path: r for r in licences.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert [(n, *got[f"{n}/LICENSE"][1::2]) for n in names] == [(n, n, "file") for n in names]
    assert [(got[f"{n}/src/{i}.c"].licence, got[f"{n}/src/{i}.c"].inherited_from) for i, n in enumerate(names)] == [(n, n) for n in names]
    assert [(got[f"h/{p}"].licence, got[f"h/{p}"].origin) for p in ("gpl.py", "apache.c", "mid.txt", "none.c")] == [("GPL-2.0", "header"), ("Apache-2.0", "header"), ("MIT", "header"), (None, "none")]


def test_gate_keeps_a_term_of_every_vector_above_the_threshold():
    rng = random.Random(2)
    for _ in range(100):
        weights = {t: float(rng.choice([0.0, 1.0, 1.0, 2.0])) for v in licences.template_terms().values() for t in v}
        gate = set(licences.gate_terms(weights, 0.5))
        for counts in licences.template_terms().values():
            if len(counts) > 40 or not any(weights[t] for t in counts):
                continue
            norm = sum((n * weights[t]) ** 2 for t, n in counts.items())
            out = sum((n * weights[t]) ** 2 for t, n in counts.items() if t not in gate)
            assert out < 0.25 * norm  # what holds no gate term stays below 0.5


RUSSIAN = "Вчера вечером в городском музее открылась выставка старинных карт, которую готовили больше двух лет."
JAPANESE = "昨日の夜、市立博物館で古い地図の展覧会が始まった。準備には二年以上かかり、百点を超える作品が世界中から集められたという。" * 2
POLISH = "Wczoraj wieczorem muzeum miejskie otworzyło wystawę dawnych map, którą przygotowywano ponad dwa lata."
ENGLISH = "The one of the two is in the house and it was for us all, as they have said to me."


@pytest.mark.parametrize("body", [RUSSIAN, JAPANESE, POLISH])
def test_main_text_of_languages_without_known_stop_words(body):
    page = f"<nav><a href=x>Menu</a></nav><div><p>{body}</p><p>Kurz.</p><p>{body}</p></div><div class='ad'>{body}</div><footer>{ENGLISH}</footer>"
    assert maintext.extract(page) == f"{body}\nKurz.\n{body}"


@pytest.mark.parametrize("name", ["content has-sidebar", "page with-nav", "site no-comments", "content-with-sidebar", "has_sidebar", "ad-free"])
def test_names_of_wrappers_do_not_set_a_page_apart(name):
    assert maintext.extract(f"<div class='{name}'><p>{ENGLISH}</p></div>") == ENGLISH


@pytest.mark.parametrize("opening, closing", [("<div class='sidebar'>", "</div>"), ("<div id=banner><div class='search'>", "</div></div>"), ("<form>", "</form>")])
def test_what_holds_an_article_is_not_set_apart(opening, closing):
    assert maintext.extract(f"{opening}<article><p>{ENGLISH}</p></article>{closing}<div class='sidebar'>{ENGLISH}</div>") == ENGLISH
    assert maintext.extract(f"{opening}<main><p>{ENGLISH}</p></main>{closing}") == ENGLISH


@pytest.mark.parametrize("name", ["site-footer", "cookie-banner", "comment-list", "nav", "sidebar-container", "x sidebar", "comment-12"])
def test_names_of_what_stands_beside_the_text(name):
    assert maintext.extract(f"<p>{ENGLISH}</p><div class='{name}'><p>{ENGLISH}</p></div>") == ENGLISH


def test_bitsliced_takes_large_components(spark):
    big = float(1 << 45)
    rows = [(0, [0.5, 1.0]), (1, [big, 0.25]), (2, [-big, 3.0]), (3, [1.0, 1.0]), (20, [float(1 << 56), -2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = {i: [int(64 * x) for x in v] for i, v in rows}
    want = {(i, j): sum(a * b for a, b in zip(q[i], q[j], strict=True)) for i in (0,) for j in q if j != i}
    got = {(r.query_id, r.vec_id): r.score for r in bitsliced.search(df.where("vec_id < 20")).collect()}
    assert got == {k: v for k, v in want.items() if k[1] < 20}
    with pytest.raises(Exception, match="too large|too big|OverflowError"):
        bitsliced.search(df).collect()


def test_licence_scores_against_all_cosines(spark):
    """Every line, window and whole text against every template, without gates or covers."""
    notices = list(licences.TEMPLATES.values())
    texts = [f"{prose(i, 12)}\n{notices[i % len(notices)]}\n{prose(i + 50, 9)}" for i in range(8)]
    texts += [licence_file("MIT"), f"{licence_file('ISC')}\n{prose(77, 30)}", prose(70, 60), "", None, dict(licences.HEADERS)["Apache-2.0"], "the MIT and the ISC", notices[3], notices[3], "x " * 20_000 + f"\n{notices[1]}"]
    cut = lambda t: collections.Counter(re.findall(licences.TERM, (t or "").lower()))
    n, templates = len(texts), licences.template_terms()
    known = {t for v in templates.values() for t in v}
    df = collections.Counter(t for x in texts for t in set(cut(x)) & known)
    weigh = lambda t: np.log((1 + n) / (1 + df[t])) if t in known else np.log(1 + n)

    def best(body):
        c = {t: k * weigh(t) for t, k in cut(body).items()}
        size = np.sqrt(sum(v * v for v in c.values()))
        out = {}
        for (name, _), counts in templates.items():
            v = {t: k * weigh(t) for t, k in counts.items()}
            dot = sum(v[t] * c[t] for t in v if t in c)
            if size and dot:
                out[name] = max(out.get(name, 0.0), dot / size / np.sqrt(sum(x * x for x in v.values())))
        return {k: v for k, v in out.items() if v >= 0.5}

    want = {}
    for i, t in enumerate(texts):
        lines = (t or "").split("\n")
        units = lines + ["\n".join(lines[a : a + w]) for w in licences.WINDOWS if len(lines) > w for a in range(0, len(lines), w // 2)]
        found, whole = collections.defaultdict(float), best(t)
        for u in [*units, t]:
            for k, v in best(u).items():
                found[k] = max(found[k], v)
        want[i] = (min(found, key=lambda k: (-round(found[k], 12), k)), round(max(found.values()), 9), "file" if whole else "header") if found else (None, None, "none")
    got = {int(r.path): (r.licence, r.score and round(r.score, 9), r.origin) for r in licences.scan(spark.createDataFrame([(str(i), t, "clash") for i, t in enumerate(texts)], "path string, text string, licence string").withColumn("path", F.col("path"))).collect()}
    same = {i for i in want if got[i][0] == want[i][0] and (want[i][1] is None or abs(got[i][1] - want[i][1]) < 1e-6)}
    alone = {i for i in want if want[i][0] is not None}
    assert alone <= same and all(got[i][2] == want[i][2] for i in alone) and len(alone) > 10


def test_inheritance_on_deep_paths(spark):
    rows = [("a/LICENSE", notices := licences.TEMPLATES["MIT"]), ("a/b/c/d/e/f", "x"), ("a/b/c/LICENSE", licences.TEMPLATES["ISC"]), ("a/b/c/d/g", "y"), ("a/b/h", "z"), ("ab/i", "w"), ("/".join("q" * 60), "v"), ("LICENSE", licences.TEMPLATES["GPL-3.0"])]
    got = {r.path: (r.licence, r.inherited_from) for r in licences.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert notices and got["a/b/c/d/e/f"] == ("ISC", "a/b/c") == got["a/b/c/d/g"] and got["a/b/h"] == ("MIT", "a") and got["ab/i"] == ("GPL-3.0", "") == got["/".join("q" * 60)]


def test_training_samples_are_bounded(spark):
    d = spark.createDataFrame([(i, "word " * (i % 7 + 1)) for i in range(300)] + [(7, "again")] * 50 + [(None, "x"), (8, None)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(None, 1)], "doc_id long, toxic int")
    got = labelled_module.training_sample(d, marks, "toxic", most=50, most_bytes=400).collect()
    assert len({r.id for r in got}) == len(got) <= 50 and sum(len(r.text) for r in got) <= 400
    assert len(labelled_module.training_sample(d, marks, "toxic", most=50, most_bytes=1).collect()) == 1
    assert labelled_module.training_sample(d.limit(0), marks, "toxic").count() == 0 == labelled_module.training_sample(d, marks.limit(0), "toxic").count()


def test_pipeline_on_odd_and_empty_tables(spark, tmp_path):
    import corpus_pipeline

    base, other = prose(61, 90), prose(62, 90)
    rows = [(1, base), (2, base), (3, None), (4, ""), (5, f"{other}\n{prose(63, 40)}"), (6, f"{other}\n{prose(64, 40)}"), (None, prose(65, 80)), (7, f"{prose(66, 30)} {prose(67, 20)}"), (7, f"{prose(66, 30)} {prose(67, 20)}")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "extra") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int, spans string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, prose(67, 20))], "item_id long, text string")
    for name, d in (("odd", docs), ("none", docs.limit(0))):
        for table, df in (("documents", d), ("labels", labels), ("benchmark", bench)):
            df.write.parquet(f"{tmp_path}/{name}/{table}.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert out.columns[: len(docs.columns)] == docs.columns or set(docs.columns) <= set(out.columns)
        got = {r.doc_id: r.text for r in out.collect()}
        assert name == "none" and not got or (2 not in got and 7 not in got and got.get(6, prose(64, 40)) == prose(64, 40) and set(got) <= {1, 5, 6, None})
