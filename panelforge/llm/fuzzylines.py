"""Near-duplicate lines by MinHash, with DataFrame operations only.

A line's shingles are all its runs of ``width`` characters, at every place, so white space plays no part and a character
put in or taken out touches ``width`` of them wherever it stands. The signature deals their distinct hashes to ten equal
ranges and keeps the six least of each (one-permutation MinHash with the bottom six); these are a band. Two lines of
Jaccard similarity 0.8 share at least one of the ten bands with probability 0.95, at 0.85 with 0.99, at 0.9 with 0.999; at
0.3 with 0.007 and at 0.1 with 0.00001, so unlike lines hardly ever meet.

Lines that share a band are a bucket. All pairs of a bucket that its components do not join already are compared, yet
no bucket is gathered or written out as pairs:

1. Every line is compared with the first and the last line of an order that the bucket chooses of two: 2 n pairs, which
   join a group of near copies and are all pairs of a bucket of three lines or fewer.
2. A larger bucket that still holds several components is dealt to blocks of about ``block`` lines, fewer where they are
   long. Blocks of lines outside its largest component meet all its blocks, each pair of blocks as one row; only links leave that row. Most
   pairs are ruled out by the sizes and by 1,024 bits a line that bound the similarity from above.

Exact Jaccard similarity over all shingles decides in both steps; distributed union-find joins the links, and of each
component the first line (by document id, then place) stays.

Equal lines are one node from the start (a 64-bit hash), so copies cost nothing later. Buckets are aggregated before
the shuffle and met by joins whose large side can be split. Before a band or a text is shuffled it must pass a bitmap of
the keys that are asked for; the bitmap has a fixed size (8 MB at most), is broadcast, and only spares work: the exact
join follows, also where the bitmap is full.

Defined cases: a null or empty text has no lines; blank lines (white space as Java's ``\\s``) are neither counted nor
removed; characters beyond 16 bits count as two; a line shorter than ``width`` is its own only shingle; lines of fewer
than eight characters equal only copies, since their four shingles or fewer cannot reach 0.8 with others; rows that repeat id and text are one document and keep the same lines; null
ids come last in order; a document that loses all its lines is dropped by ``deduplicated``; very long lines are taken
whole; an empty table gives no rows; other columns pass through whatever their names, but for names that begin with
two underscores and "line_", which are refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bit_held, bit_table, cut, let, stored
from .union import components

SIMILAR = (4, 5)
BANDS, ROWS = 10, 6
WIDTH = 5
WORDS, FIRST = 16, 4  # of 64 bits of parity, and of those looked at first
HIDDEN = "__line_"
#: Fixed value: any pattern of mixed bits, to make a second order of the same hashes.
FLIP = 0x5A17C3D2E96B4F81


def shingles(line: str | Column = "line", width: int = WIDTH, code=F.xxhash64) -> Column:
    """Hashes of a line's shingles in order, repeats included. Two bytes a character make every place a fixed offset."""

    def cut_out(u: Column) -> Column:
        every = F.sequence(F.lit(1), F.octet_length(u) - (2 * width - 1), F.lit(2))
        found = F.transform(every, lambda i: code(F.substring(u, i, F.lit(2 * width))))
        return F.when(F.octet_length(u) <= 2 * width, F.array(code(u))).otherwise(found)

    return let(F.encode(line, "UTF-16BE"), cut_out)


def shingle_set(line: str | Column = "line") -> Column:
    return F.array_distinct(shingles(line))


def exploded(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, k, pos, line, h) for every line that is not blank."""
    rows = docs.select(F.col(f"`{key}`").alias("doc"), whole(text).alias("k"), F.posexplode(F.split(F.col(f"`{text}`"), "\n")).alias("pos", "line"))
    return rows.where(F.col("line").rlike(r"\S")).withColumn("h", F.xxhash64("line"))


def whole(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))


def signed(lines: DataFrame) -> DataFrame:
    """Rows with a column ``line``, with ``keys`` in its place: a key for each band that holds a hash; none for a line of
    less than eight characters. Hashes of 32 bits are enough here, where they only choose whom to compare."""
    marks = [-(1 << 31) + j * ((1 << 32) // BANDS) for j in range(BANDS)] + [(1 << 31) - 1]
    cells = F.array(*[F.lit(m).cast("int") for m in marks])
    rest = [c for c in lines.columns if c != "line"]
    # sorted beside the bounds of the bands, so that each band's hashes follow its bound
    found = lines.select(*rest, (F.length("line") >= WIDTH + 3).alias("enough"), F.sort_array(F.concat(F.array_distinct(shingles(code=F.hash)), cells)).alias("s"))
    found = found.withColumn("at", F.array(*[F.array_position("s", F.lit(m).cast("int")) for m in marks]))

    def band(j: int) -> Column:
        at, after = F.get("at", F.lit(j)), F.get("at", F.lit(j + 1))
        least = F.slice("s", (at + 1).cast("int"), F.least(F.lit(ROWS), after - at - 1).cast("int"))
        return F.when(F.col("enough") & (after - at > 1), F.xxhash64(F.lit(j), least))

    return found.select(*rest, F.array_compact(F.array(*map(band, range(BANDS)))).alias("keys"))


def bands(rows: DataFrame) -> DataFrame:
    """(key, h) for the bands of each line of (h, keys)."""
    return rows.select(F.explode("keys").alias("key"), "h")


def shared_bands(rows: DataFrame) -> DataFrame:
    """(key, h), each once, of the bands that two different lines share."""
    several = bands(rows).groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low != high").select("key")
    several = stored(several, "bands")
    # an inner join, since a semi-join is pushed below the bitmap; keys are distinct in ``several``
    return bit_held(bands(rows), "key", bit_table(several, "key")).join(several, "key").distinct()


def order(column: str) -> Column:
    """Swaps between a line's hash and its place in the order of a band, which the band's last bit chooses."""
    return F.col(column).bitwiseXOR(F.col("key").bitwiseAND(F.lit(1)) * F.lit(FLIP))


def pairs_with_ends(members: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of each line and the two ends of its buckets."""
    placed = members.select("key", order("h").alias("x"))
    ends = placed.groupBy("key").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    met = placed.join(ends, "key").select(order("x").alias("h"), F.explode(F.array(order("low"), order("high"))).alias("other"))
    return met.where("h != other").select(F.least("h", "other").alias("a"), F.greatest("h", "other").alias("b")).distinct()


def near_in_size(m: Column, n: Column) -> Column:
    """False where the sizes of two sets alone prove a Jaccard similarity below 0.8."""
    up, down = SIMILAR
    return (m * down >= n * up) & (n * down >= m * up)


def alike(sa: Column, sb: Column) -> Column:
    """True if the Jaccard similarity of two sets is at least 0.8; their sizes alone rule out most others."""
    up, down = SIMILAR
    m, n = F.size(sa), F.size(sb)
    return near_in_size(m, n) & (F.size(F.array_intersect(sa, sb)) * (down + up) >= (m + n) * up)


def sized(texts: DataFrame) -> DataFrame:
    """(h, line, size) of the lines of (h, line): the size of a line's set is counted once, not for each of its pairs."""
    return texts.select("h", "line", F.size(shingle_set()).alias("size"))


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose lines in (h, line, size) are alike. With both sizes known, the size of the union decides."""
    up, down = SIMILAR
    side = lambda c: texts.select(F.col("h").alias(c), F.col("line").alias(f"l{c}"), F.col("size").alias(f"n{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(near_in_size(F.col("na"), F.col("nb")))
    union = F.size(F.array_distinct(F.concat(shingles("la"), shingles("lb"))))
    near = union * (down + up) <= (F.col("na") + F.col("nb")) * down
    # not a filter, which would be pushed below and take the shingles again for each mention
    return both.select(F.explode(F.array_repeat(F.struct("a", "b"), near.cast("int"))).alias("link")).select("link.*")


def parities(sets: DataFrame) -> DataFrame:
    """(h, n, parity) of the sets of (h, s): their size, and 1,024 bits that each element turns one of over, so two sets
    differ in at least as many elements as bits."""
    rows = sets.select("h", F.explode("s").alias("x"))
    word, bit = F.shiftright("x", 6).bitwiseAND(F.lit(WORDS - 1)), F.expr("shiftleft(1L, int(x & 63))")
    found = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.bit_xor(F.when(word == w, bit)), F.lit(0).cast("long")).alias(f"p{w}") for w in range(WORDS)])
    return found.select("h", "n", F.array(*[f"p{w}" for w in range(WORDS)]).alias("parity"))


def may_be_alike(x: Column, y: Column) -> Column:
    """False where sizes and parities prove that two lines are not alike: sets of m and n that differ in d elements
    have the similarity (m + n - d) / (m + n + d)."""
    up, down = SIMILAR
    m, n = x["n"], y["n"]

    def few(words: int) -> Column:
        differ = [F.bit_count(F.get(x["parity"], F.lit(w)).bitwiseXOR(F.get(y["parity"], F.lit(w)))) for w in range(words)]
        return sum(differ[1:], differ[0]) * (down + up) <= (m + n) * (down - up)

    return near_in_size(m, n) & few(FIRST) & few(WORDS)


def links_of_blocks(members: DataFrame, texts: DataFrame, block: int) -> DataFrame:
    """Links (a, b) between components in the buckets of (key, h, root) that hold several and more than three lines."""
    size = members.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"))
    largest = F.max_by("root", F.struct("c", "root")).alias("main")
    mixed = size.groupBy("key").agg(largest, F.count(F.lit(1)).alias("roots"), F.sum("c").alias("lines")).where("roots > 1 and lines > 3")
    open_ = stored(members.join(mixed.select("key", "main"), "key"), "mixed")
    asked = texts.select("h", "line").join(open_.select("h").distinct(), "h")
    drawn = stored(asked.join(parities(asked.select("h", shingle_set().alias("s"))), "h"), "drawn")
    blocks = open_.join(drawn.select("h", "n"), "h").groupBy("key").agg(F.ceil(F.greatest(F.count(F.lit(1)) / block, F.sum("n") / (400 * block))).alias("blocks"))
    row = F.struct("root", "line", "n", "parity").alias("row")
    dealt = open_.join(drawn, "h").join(blocks, "key").select("key", (F.col("root") == F.col("main")).alias("inner"), F.pmod(F.xxhash64("h", F.lit(1)), F.col("blocks")).alias("at"), row)
    groups = stored(dealt.groupBy("key", "inner", "at").agg(F.collect_list("row").alias("rows")), "blocks")
    outer = groups.where(~F.col("inner")).select("key", F.col("at").alias("p"), F.col("rows").alias("left"))
    every = groups.select("key", "inner", F.col("at").alias("q"), F.col("rows").alias("right"))
    met = outer.join(every, "key").where("inner or p <= q").withColumn("same", ~F.col("inner") & (F.col("p") == F.col("q")))

    def close(x: Column, right: Column, same: Column) -> Column:
        """The places in ``right`` of the rows that sizes and parities do not rule out for ``x``."""
        fits = lambda y: (y["root"] != x["root"]) & ~(same & (y["root"] > x["root"])) & may_be_alike(x, y)
        return F.filter(F.transform(right, lambda y, j: F.when(fits(y), j)), lambda j: j.isNotNull())

    def found(x: Column, i: Column, e: Column) -> Column:
        near = F.filter(F.get(e["close"], i), lambda j: alike(F.get(e["sl"], i), F.get(e["sr"], j)))
        root = lambda j: F.get(e["right"], j)["root"]
        return F.transform(near, lambda j: F.struct(F.least(x["root"], root(j)).alias("a"), F.greatest(x["root"], root(j)).alias("b")))

    # each held by a lambda's variable, see let; sets are made only of lines that a pair is left of
    met = met.select("left", "right", let(F.struct("left", "right", "same"), lambda e: F.transform(e["left"], lambda x: close(x, e["right"], e["same"]))).alias("close"))
    met = met.where(F.size(F.flatten("close")) > 0).select("left", "right", "close", F.array_distinct(F.flatten("close")).alias("asked"))
    sl = F.transform("left", lambda x, i: F.when(F.size(F.get("close", i)) > 0, shingle_set(x["line"])))
    sr = F.transform("right", lambda y, j: F.when(F.array_contains("asked", j), shingle_set(y["line"])))
    met = met.select("left", "right", "close", sl.alias("sl"), sr.alias("sr"))
    links = let(F.struct(*met.columns), lambda e: F.array_distinct(F.flatten(F.transform(e["left"], lambda x, i: found(x, i, e)))))
    return met.select(F.explode(links).alias("link")).select("link.a", "link.b").distinct()


def linked(lines: DataFrame, rows: DataFrame, block: int = 256) -> DataFrame:
    """(node, root) of the lines of (h, line) that links join, by the bands of (h, keys): what a comparison of all pairs of all
    buckets would join."""
    members = stored(shared_bands(rows), "buckets")
    asked = members.select("h").distinct()
    texts = stored(sized(bit_held(lines, "h", bit_table(asked, "h")).groupBy("h").agg(F.first("line").alias("line")).join(asked, "h")), "texts")
    roots = cut(components(verified(pairs_with_ends(members), texts)))
    named = stored(members.join(roots.withColumnRenamed("node", "h"), "h", "left").select("key", "h", F.coalesce("root", "h").alias("root")), "components")
    again = components(cut(links_of_blocks(named, texts, block))).select(F.col("node").alias("root"), F.col("root").alias("last"))
    joined = named.select("h", "root").distinct().join(again, "root", "left").select(F.col("h").alias("node"), F.coalesce("last", "root").alias("root"))
    alone = F.col("node") == F.col("root")
    return joined.where(~alone).unionAll(joined.where(~alone).select(F.col("root").alias("node"), "root").distinct())


def kept_lines(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, k, kept): the places of the lines that stay, from 0, in order, of each document (id and text hash) that keeps one."""
    every = exploded(docs, key, text)
    slim = stored(signed(every), "lines")
    roots = linked(every.select("h", "line"), slim.select("h", "keys")).select(F.col("node").alias("h"), "root")
    order = F.struct(F.col("doc").isNull().alias("n"), F.col("doc").alias("doc"), F.col("k").alias("k"), F.col("pos").alias("pos"))
    first = slim.groupBy("h").agg(F.min(order).alias("o")).join(roots, "h", "left")
    stays = first.groupBy(F.coalesce("root", "h").alias("root")).agg(F.min("o").alias("o")).select("o.doc", "o.k", "o.pos")
    return stays.groupBy("doc", "k").agg(F.sort_array(F.collect_list("pos")).alias("kept"))


def with_kept(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``docs`` beside two hidden columns: the number of lines that are not blank, and the places of those that stay."""
    taken = [c for c in docs.columns if c.lower().startswith(HIDDEN)]
    if taken:
        raise ValueError(f"columns named like {taken} are for this operator's own use")
    found = kept_lines(docs, key=key, text=text).select(F.col("doc").alias(f"{HIDDEN}d"), F.col("k").alias(f"{HIDDEN}k"), F.col("kept").alias(f"{HIDDEN}kept"))
    full = F.filter(F.split(F.col(f"`{text}`"), "\n"), lambda line: line.rlike(r"\S"))
    rows = docs.withColumn(f"{HIDDEN}t", whole(text)).withColumn(f"{HIDDEN}n", F.coalesce(F.size(full), F.lit(0)).cast("long"))
    same = F.col(f"`{key}`").eqNullSafe(F.col(f"{HIDDEN}d")) & (F.col(f"{HIDDEN}t") == F.col(f"{HIDDEN}k"))
    kept = F.coalesce(f"{HIDDEN}kept", F.array().cast("array<int>"))
    return rows.join(found, same, "left").withColumn(f"{HIDDEN}kept", kept)


def summary(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: its id, n_lines, n_removed, and the places of the lines that stay."""
    out = with_kept(docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")), key, text)
    n, kept = F.col(f"{HIDDEN}n"), F.col(f"{HIDDEN}kept")
    return out.select(F.col(f"`{key}`"), n.alias("n_lines"), (n - F.size(kept)).alias("n_removed"), kept.alias("kept_lines"))


def deduplicated(docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: str | None = "n_chars") -> DataFrame:
    """``docs`` with only the lines that stay (blank lines stay beside them), without documents that lost all. The column
    ``size``, where there is one, gets the new number of characters."""
    n, kept = F.col(f"{HIDDEN}n"), F.col(f"{HIDDEN}kept")
    rows = with_kept(docs, key, text).where((n == 0) | (F.size(kept) > 0))
    left = F.filter(F.split(F.col(f"`{text}`"), "\n"), lambda line, i: F.array_contains(kept, i) | ~line.rlike(r"\S"))
    after = f"{HIDDEN}text"
    rows = rows.withColumn(after, F.when(n == F.size(kept), F.col(f"`{text}`")).otherwise(F.array_join(left, "\n")))
    types = dict(docs.dtypes)
    return rows.select(*[F.col(after).alias(c) if c == text else F.length(after).cast(types[c]).alias(c) if c == size else F.col(f"`{c}`") for c in docs.columns])
