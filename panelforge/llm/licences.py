"""Licence scans by sparse TF-IDF cosine, with inheritance from the nearest directory; DataFrame operations only.

Every line of a text (its headers, wherever they stand), every window of adjacent lines of a few sizes (headers of
several lines) and every whole text is a vector over lower-case terms; so is each template: notices, the usual headers
of several lines, and full licence texts (``licence_texts``), several for a licence. A term weighs its count times
ln((1 + n) / (1 + df)), with the document frequency df counted over all documents for every term of a template; other
terms count as unseen. The cosine with each template is a join on terms, and a licence has that of its best template. A
part of a text can reach the threshold only by sharing a term that is not common, and only where the file's terms cover
enough of a template's norm, so files are taken up by that; these filters and the threshold use the same weights and
lose nothing.

A file with a line or window at or above ``threshold`` declares the best template. A file whose whole text reaches it is a
licence file and speaks for its directory. A file without a licence of its own inherits from the nearest ancestor
directory that has a licence file (joined by path); of several in one directory the higher cosine counts, then the
more frequent licence, then the first by name.

The template side is fixed text and therefore broadcast; all else meets through shuffles by file or directory, and the
files of a directory are aggregated before anything is joined to it.

Defined cases: null or empty texts declare nothing and inherit like others; null paths have no directory; rows that
repeat a path are joined by path and text, so copies get the same answer; an empty table gives no rows; other columns
of the input are not read; a very long text is taken whole, its windows held in one row (about two lines more for each line and
window size).
"""

from __future__ import annotations

import math
import re
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bit_held, bit_table, cut, let, stored

#: Notices by which licences are declared.
TEMPLATES = {
    "AGPL-3.0": "This program is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "Released under the BSD 2-Clause Simplified License.",
    "BSD-3-Clause": "Released under the BSD 3-Clause New License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0, Creative Commons Attribution.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0 Universal.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Released under the ISC License.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain, the Unlicense.",
}
#: The headers that the licences ask for, and what names a licence at the head of a long text.
_GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, {}.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {} for more details.
You should have received a copy of the GNU {} along with this program. If not, {}."""
_SEE, _MAIL = "see <https://www.gnu.org/licenses/>", "write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA"
_CC = """Creative Commons {0} 4.0 International Public License
By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons {0} 4.0 International Public License ("Public License"). To the extent this Public License may be interpreted as a contract, You are granted the Licensed Rights in consideration of Your acceptance of these terms and conditions, and the Licensor grants You such rights in consideration of benefits the Licensor receives from making the Licensed Material available under these terms and conditions."""
HEADERS = [
    *[(k, _GNU.format(n, v, n, n, end)) for k, n, v in (
        ("GPL-3.0", "General Public License", "either version 3 of the License, or (at your option) any later version"),
        ("GPL-3.0", "General Public License", "version 3"),
        ("GPL-2.0", "General Public License", "either version 2 of the License, or (at your option) any later version"),
        ("GPL-2.0", "General Public License", "version 2"),
        ("LGPL-3.0", "Lesser General Public License", "either version 3 of the License, or (at your option) any later version"),
        ("LGPL-2.1", "Lesser General Public License", "either version 2.1 of the License, or (at your option) any later version"),
        ("AGPL-3.0", "Affero General Public License", "either version 3 of the License, or (at your option) any later version"),
    ) for end in (_SEE, _MAIL)],
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    *[(k, _CC.format(n)) for k, n in (("CC-BY-4.0", "Attribution"), ("CC-BY-SA-4.0", "Attribution-ShareAlike"), ("CC-BY-NC-4.0", "Attribution-NonCommercial"))],
]
#: The AGPL's text is that of GPL 3 under its own name, but for this section.
_REMOTE = """Remote Network Interaction; Use with the GNU General Public License. Notwithstanding any other provision of this License, if you modify the Program, your modified version must prominently offer all users interacting with it remotely through a computer network (if your version supports such interaction) an opportunity to receive the Corresponding Source of your version by providing access to the Corresponding Source from a network server at no charge, through some standard or customary means of facilitating copying of software."""
#: Lines of a window; windows begin at every half of it.
WINDOWS = (4, 16, 64, 256)
TERM = r"[a-z0-9]+"


def terms(text: str | Column) -> Column:
    return F.regexp_extract_all(F.lower(text if isinstance(text, Column) else F.col(text)), F.lit(f"({TERM})"), F.lit(1))


@cache
def template_terms() -> dict[tuple[str, int], dict[str, int]]:
    """Counted terms of each template, by licence and number."""
    full = [(p.stem, p.read_text(encoding="utf-8")) for p in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))]
    affero = re.sub(r"GNU(\s+)General", r"GNU\1Affero General", dict(full)["GPL-3.0"], flags=re.I) + _REMOTE
    out: dict[tuple[str, int], dict[str, int]] = {}
    for i, (name, body) in enumerate([*TEMPLATES.items(), *HEADERS, *full, ("AGPL-3.0", affero)]):
        counts = out.setdefault((name, i), {})
        for t in re.findall(TERM, body.lower()):
            counts[t] = counts.get(t, 0) + 1
    return out


def sides(weights: dict[str, float]) -> list[tuple[int, str, str, float]]:
    """(template, licence, term, v): the templates as vectors of norm 1."""
    rows = []
    for (name, i), counts in template_terms().items():
        norm = math.sqrt(sum((n * weights[t]) ** 2 for t, n in counts.items()))
        rows += [(i, name, t, n * weights[t] / norm if norm else 0.0) for t, n in counts.items()]
    return rows


def term_weights(files: DataFrame, text: str = "text") -> dict[str, float]:
    """ln((1 + n) / (1 + df)) of every template term, and of "" for a term that no document holds; counted over all files."""
    known = sorted({t for v in template_terms().values() for t in v})
    vocabulary = F.array(*[F.lit(t) for t in known])
    found = files.select(F.explode(F.concat(F.array_intersect(terms(F.coalesce(F.col(f"`{text}`"), F.lit(""))), vocabulary), F.array(F.lit("")))).alias("t"))
    df = {r.t: r.n for r in found.groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most one row for each template term
    n = df.get("", 0)
    return {"": math.log(1 + n), **{t: math.log((1 + n) / (1 + df.get(t, 0))) for t in known}}


def gate_terms(weights: dict[str, float], threshold: float) -> list[str]:
    """Template terms of which a vector must hold one to reach the threshold with any template.

    Leaves out the lightest terms of each template as long as all of them together stay below: by Cauchy's inequality
    the cosine is at most the norm of the shared part of the template over the norm of the template."""
    kept: set[str] = set()
    for counts in template_terms().values():
        parts = sorted(((n * weights[t]) ** 2, t) for t, n in counts.items())
        total, light, least = sum(p for p, _ in parts), 0.0, 0
        while least < len(parts) and light + parts[least][0] < threshold**2 * total:
            light, least = light + parts[least][0], least + 1
        kept |= {t for _, t in parts[least:]}
    return sorted(kept)


def cosines(units: DataFrame, weights: dict[str, float], keys: list[str]) -> DataFrame:
    """(keys..., licence, score) for every licence of which a template shares a term with a unit of (keys..., body)."""
    spark = units.sparkSession
    side = F.broadcast(spark.createDataFrame(sides(weights), "template int, licence string, t string, v double"))
    known = F.broadcast(spark.createDataFrame(sorted((t, w) for t, w in weights.items() if t), "t string, idf double"))
    counted = units.select(*keys, F.explode(counts(terms("body"))).alias("c")).select(*keys, "c.t", "c.n")
    counted = counted.join(known, "t", "left").withColumn("w", F.col("n") * F.coalesce("idf", F.lit(weights[""])))
    norm = counted.groupBy(*keys).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = counted.join(side, "t").groupBy(*keys, "template", "licence").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    dots = dots.groupBy(*keys, "licence").agg(F.max("dot").alias("dot"))
    return dots.join(norm, keys).where("norm > 0").select(*keys, "licence", (F.col("dot") / F.col("norm")).alias("score"))


def counts(words: Column) -> Column:
    """(t, n) of an array's different words, within the row: equal words stand together once they are sorted."""

    def runs(w: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: (i == 0) | (F.get(w, i) != F.get(w, i - 1)))
        ends = lambda f: F.transform(f, lambda i, j: F.struct(F.get(w, i).alias("t"), (F.coalesce(F.get(f, j + 1), F.size(w)) - i).alias("n")))
        return F.when(F.size(w) > 0, let(first, ends))

    return let(F.sort_array(words), runs)


def covering(files: DataFrame, weights: dict[str, float], threshold: float) -> DataFrame:
    """Keys of the files of (k, text) of which a part may reach the threshold: by Cauchy's inequality its cosine is at most
    the norm of what the template shares with the file. Copies of a text add up, which only lets more of them through."""
    side = F.broadcast(files.sparkSession.createDataFrame([(i, t, v * v) for i, _, t, v in sides(weights)], "template int, t string, vv double"))
    known = F.array(*[F.lit(t) for t in sorted(weights) if t])
    held = files.select("k", F.explode(F.array_intersect(terms("text"), known)).alias("t")).join(side, "t")
    enough = held.groupBy("k", "template").agg(F.sum("vv").alias("vv")).where(F.col("vv") >= threshold**2 - 1e-9)
    return stored(enough.select("k").distinct(), "covering")


def windows(files: DataFrame) -> DataFrame:
    """(k, pos, body) of the lines of (k, text), and of the windows that are shorter than it; pos has size and place."""
    rows = F.split("text", "\n")
    n = F.size(rows)
    lines = F.transform(rows, lambda line, i: F.struct(i.cast("long").alias("pos"), line.alias("body")))

    def part(w: int) -> Column:
        cut_out = lambda i: F.struct((F.lit(w << 32) + i).alias("pos"), F.array_join(F.slice(rows, i + 1, w), "\n").alias("body"))
        return F.when(n > w, F.transform(F.sequence(F.lit(0), n - 1, F.lit(w // 2)), cut_out))

    many = [part(w) for w in WINDOWS]
    parts = F.concat(lines, *[F.coalesce(x, F.array().cast("array<struct<pos:bigint,body:string>>")) for x in many])
    return files.select("k", F.explode(parts).alias("u")).select("k", "u.pos", "u.body")


def scan(files: DataFrame, *, path: str = "path", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row for each row of ``files``: path, licence (null: none), score, origin (header, file, inherited, none) and the
    directory it was inherited from."""
    own = files.select(F.col(f"`{path}`").alias("path"), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("k"), F.col(f"`{text}`").alias("text"))
    weights = term_weights(own)
    gate = F.array(*[F.lit(t) for t in gate_terms(weights, threshold)])
    passing = own.where(F.arrays_overlap(terms(F.coalesce("text", F.lit(""))), gate)).select("k", "text")
    asked = covering(passing, weights, threshold)
    # texts are shuffled only where their key passes a bitmap of fixed size; the join decides
    holders = bit_held(own.select("k", "text"), "k", bit_table(asked, "k")).groupBy("k").agg(F.first("text").alias("text"))
    holders = stored(holders.join(asked, "k"), "holders")
    lines = windows(holders).where(F.arrays_overlap(terms("body"), gate))
    whole = holders.select("k", F.lit(-1).cast("long").alias("pos"), F.col("text").alias("body"))
    score = cosines(lines.unionAll(whole), weights, ["k", "pos"]).where(F.col("score") >= threshold)
    best = F.struct(F.col("score"), F.col("licence").alias("licence"))
    top = F.min_by(best, F.struct(-F.round("score", 12), F.col("licence")))
    declared = cut(score.groupBy("k").agg(top.alias("own"), F.max((F.col("pos") == -1).cast("int")).alias("is_file"), F.min_by(best, F.struct((F.col("pos") != -1).cast("int"), -F.round("score", 12), F.col("licence"))).alias("said")))

    slim = own.select("path", "k").join(declared, "k", "left")
    parts = F.split("path", "/")
    depth = F.size(parts) - 1
    place = F.array_join(F.slice(parts, 1, F.greatest(depth, F.lit(0))), "/")
    speaking = slim.where(F.col("is_file") == 1).select(place.alias("dir"), "said.licence", "said.score")
    spoken = speaking.groupBy("dir", "licence").agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("n"))
    spoken = cut(spoken.groupBy("dir").agg(F.min_by(F.struct("licence", "score"), F.struct(-F.round("score", 12), -F.col("n"), F.col("licence"))).alias("s")).select("dir", F.col("s.licence").alias("dir_licence"), F.col("s.score").alias("dir_score")))
    # directories, not files, look for their ancestors
    dirs = slim.where("own is null and path is not null").select(place.alias("from_dir")).distinct()
    names = F.split("from_dir", "/")
    up = dirs.select("from_dir", F.explode(F.sequence(F.lit(0), F.size(names))).alias("level")).withColumn("dir", F.array_join(F.slice(F.split("from_dir", "/"), 1, F.col("level")), "/"))
    near = up.join(spoken, "dir").groupBy("from_dir").agg(F.max_by(F.struct("dir", "dir_licence", "dir_score"), "level").alias("near"))
    out = slim.withColumn("from_dir", F.when(F.col("own").isNull() & F.col("path").isNotNull(), place)).join(near, "from_dir", "left")
    origin = F.when(F.col("own").isNotNull(), F.when(F.col("is_file") == 1, "file").otherwise("header")).when(F.col("near").isNotNull(), "inherited").otherwise("none")
    return out.select("path", F.coalesce("own.licence", "near.dir_licence").alias("licence"), F.coalesce("own.score", "near.dir_score").alias("score"), origin.alias("origin"), F.when(F.col("own").isNull(), F.col("near.dir")).alias("inherited_from"))
