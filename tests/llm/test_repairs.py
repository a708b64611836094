"""Cases that earlier rounds got wrong."""

import pytest

from panelforge.llm import bitsliced, fuzzylines, mixing, simhash, substrings

from ..oracle import rows as as_rows


def test_keep_one_takes_columns_of_any_name(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text, "x", "a", "b", "c", "d"), (2, text, "y", "a", "b", "c", "d"), (3, "other words are here", "z", "a", "b", "c", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __n string, __id string, __k1 string, first_0 string, __c0 string")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(tuple(r) for r in kept.collect()) == [rows[0], rows[2]]


def mixed(df):
    return {r.source: (r.target, r.taken) for r in mixing.mix(df, keep=["doc_id", "source"]).groupBy("source").agg({"target": "max", "taken": "sum"}).toDF("source", *sorted(["target", "taken"])).collect()}


@pytest.mark.parametrize("doc_id", [7, None])
def test_mix_draws_each_of_equal_rows(spark, doc_id):
    rows = [(doc_id, " ".join(["w"] * 50), "a")] * 200 + [(1000 + i, " ".join(["v"] * 50), "b") for i in range(300)] + [(None, "", None), (5, None, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    for keep in (["doc_id", "source", "size", "target", "taken"], None):
        out = mixing.mix(df, keep=keep and ["doc_id", "source"])
        assert out.count() == len(rows)
        for r in out.groupBy("source").agg({"target": "max", "taken": "sum", "size": "max"}).collect():
            assert abs(r["sum(taken)"] - r["max(target)"]) <= 50
        assert all(r.taken <= 2 * r.size for r in out.collect())


def test_mix_of_repeats_agrees_with_its_sql_and_with_itself(spark, tmp_path):
    import duckdb

    rows = [(7, "a b c d e", "a")] * 40 + [(7, "v w x y z", "a")] * 30 + [(i, "p q r " * (i % 9 + 1), "b") for i in range(60)] + [(None, "s t", None)] * 9
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    pick = ["doc_id", "size", "source_size", "target", "taken"]
    first, second = (as_rows(mixing.mix(x, keep=["doc_id"]).select(*pick).toPandas()) for x in (df, df.repartition(5)))
    assert first == second == as_rows(con.sql(mixing.ORACLE).df())
    texts = [sorted(map(tuple, mixing.mix(x).select("text", "taken").collect())) for x in (df, df.repartition(3))]
    assert texts[0] == texts[1]


def test_search_of_empty_and_huge_vectors(spark):
    rows = [(0, []), (5, []), (20, []), (40, [1.0, 2.0]), (41, [1.0, 1.0]), (42, [1e18, 1.0]), (43, None), (60, [float("inf"), 1.0])]
    found = bitsliced.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found.collect())
    assert got == [(0, 1, 5, 0), (0, 2, 20, 0), (20, 1, 0, 0), (20, 2, 5, 0), (40, 1, 41, 3 * 64 * 64)]


def test_index_outlives_its_object(spark, tmp_path):
    folder = f"{tmp_path}/index"
    words = [f"w{i}" for i in range(60)]
    old = spark.createDataFrame([(1, " ".join(words)), (2, "nothing like it")], "doc_id long, text string")
    new = spark.createDataFrame([(3, "x " + " ".join(words) + " y"), (4, "other words")], "doc_id long, text string")
    substrings.repeated_spans(old, index=substrings.FingerprintIndex(spark, folder, fanout=2)).collect()
    again = substrings.FingerprintIndex(spark, folder, fanout=2)
    assert again.runs and again.texts
    found = {r.doc_id: r.n_removed for r in substrings.repeated_spans(new, index=again).collect()}
    assert found == {3: 60, 4: 0}
    third = substrings.FingerprintIndex(spark, folder, fanout=2)
    assert (third.runs, third.texts) == (again.runs, again.texts)  # after a compaction too
    found = {r.doc_id: r.n_removed for r in substrings.repeated_spans(new, index=third).collect()}
    assert found == {3: 62, 4: 0}


def test_lines_whose_hashes_share_their_low_word_keep_their_bucket(spark):
    rows = spark.createDataFrame([(1, [7, 8]), ((1 << 32) + 1, [7]), (5, [9, 9])], "h long, keys array<long>")
    assert sorted(tuple(r) for r in fuzzylines.shared_bands(rows).collect()) == [(7, 1), (7, (1 << 32) + 1)]


def test_verified_decides_as_sets_do(spark):
    base = "".join(chr(97 + i * i % 23) + chr(98 + i % 19) for i in range(60))
    variants = {base, base + base, base[:60] + "#" + base[60:], base[:-14], base[:-30], "x" + base, base[::-1], base[:20], "abc", "abcdefgh", "abcdefgh abcdefgh"}
    variants |= {base[:at] + "?" * n + base[at + n :] for at in (0, 31, 77) for n in (1, 3, 9)}
    lines = spark.createDataFrame([(i, v) for i, v in enumerate(sorted(variants))], "h long, line string")
    sets = {r.h: set(r.s) for r in lines.select("h", fuzzylines.shingle_set().alias("s")).collect()}
    pairs = [(a, b) for a in sets for b in sets if a < b]
    texts = fuzzylines.sized(lines)
    assert {r.h: r.size for r in texts.collect()} == {h: len(s) for h, s in sets.items()}
    got = [(r.a, r.b) for r in fuzzylines.verified(spark.createDataFrame(pairs, "a long, b long"), texts).collect()]
    want = {(a, b) for a, b in pairs if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    assert len(got) == len(set(got)) and set(got) == want and 5 < len(want) < len(pairs)
