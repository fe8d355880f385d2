"""Licences of files: TF-IDF cosine to templates, then inheritance from ancestor directories.

Every line of a file is compared with licence templates, and so is the whole
text of a licence file (LICENSE, COPYING, NOTICE and the like). Vectors are
sparse: a template's few rarest terms carry so much of its norm that a line
without any of them stays below the threshold, so only lines with such an anchor
are taken apart. A file without a licence of its own inherits that of the licence
file in its nearest ancestor directory, found by equality joins on paths.

Only DataFrame operations are used.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, functions as F

from loomframe.llm.common import Scratch

# Names and header statements of common licences.
TEMPLATES = [
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", "Use of this source code is governed by a BSD 2-Clause License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Released under the ISC License."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This source code form is subject to the terms of the Mozilla Public License, version 2.0."),
]
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|copyright|notice|unlicense)(\..*)?$"
SALT = 16


def terms_of(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def _terms(column) -> Column:
    return F.filter(F.split(F.lower(column), "[^a-z0-9]+"), lambda t: t != "")


def _array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def document_frequency(files: DataFrame, text_col: str) -> DataFrame:
    """``(term, n)``: the number of files that have each term."""
    has = F.explode(F.array_distinct(_terms(F.coalesce(text_col, F.lit("")))))
    return files.select(has.alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def _weights(templates, idf: dict[str, float]) -> list[dict[str, float]]:
    """The unit TF-IDF vector of each template."""
    out = []
    for _, text in templates:
        w = {t: n * idf[t] for t, n in Counter(terms_of(text)).items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        out.append({t: x / norm for t, x in w.items()})
    return out


def anchors(weights: list[dict[str, float]], at_least: float) -> list[str]:
    """Terms of which a text has at least one if its cosine to any template reaches ``at_least``.

    The cosine is at most the norm of the template's part that the text has, so
    the heaviest terms whose absence leaves a norm below the threshold suffice.
    """
    found = set()
    for w in weights:
        rest = 1.0
        for t in sorted(w, key=lambda t: (-w[t], t)):
            if rest < at_least * at_least - 1e-9:
                break
            found.add(t)
            rest -= w[t] * w[t]
    return sorted(found)


def _scored(units: DataFrame, templates, frequency: DataFrame, total: int, weights, at_least: float) -> DataFrame:
    """``units(key, unit)`` to ``(key, license, score)`` for those that reach a template; the best one, then by name.

    Terms carry the key of their unit and not its text, so bytes grow with a unit's length and not with its square.
    """
    counts = units.select("key", F.explode(_terms("unit")).alias("term")).groupBy("key", "term").agg(F.count("*").alias("tf"))
    used = frequency.join(counts.select("term").distinct(), "term", "left_semi")
    # a term that most units share is spread by the salt
    spread = used.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    salted = counts.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALT)).cast("int"))
    idf = F.log((F.lit(total) + 1) / (F.coalesce("n", F.lit(0)) + 1)) + 1
    weighted = salted.join(spread, ["term", "salt"], "left").withColumn("w", F.col("tf") * idf)
    # one sum per template; a term outside a template adds nothing
    dots = []
    for k, w in enumerate(weights):
        of = F.create_map(*[F.lit(x) for t, v in w.items() for x in (t, v)])
        dots.append(F.sum(F.col("w") * F.coalesce(F.element_at(of, F.col("term")), F.lit(0.0))).alias(f"d{k}"))
    sums = weighted.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), *dots)
    each = F.array(*[F.struct(F.round(F.col(f"d{k}") / F.col("norm"), 9).alias("score"), F.lit(name).alias("license")) for k, (name, _) in enumerate(templates)])
    best = F.array_sort(
        each, lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["license"] < b["license"], -1).otherwise(1)
    )
    first = F.element_at(best, 1)
    return sums.select("key", first["license"].alias("license"), first["score"].alias("score")).filter(F.col("score") >= at_least)


def _parent(path) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def scan(files: DataFrame, path_col: str = "path", text_col: str = "text", templates=TEMPLATES, at_least: float = 0.6) -> DataFrame:
    """``(path, license, score, origin, from_path)``, one row per distinct path.

    ``origin`` is ``own`` for a licence found in the file, ``inherited`` for that
    of the licence file in the nearest ancestor directory (its own directory
    first), else null with no licence. The best score counts, then the licence's
    name; of several licence files in a directory the best, then the first path.
    Inverse document frequency counts over all files, for every term, so a common
    word beside a template's weighs little in a table of any size. A text that is null or empty has no licence of
    its own. Several rows of one path are one file. Rows without a path take no
    part; an empty table gives an empty result.
    """
    scratch = Scratch(files.sparkSession)
    files = files.select(F.col(path_col).alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).filter("path is not null")
    vocabulary = sorted({t for _, text in templates for t in terms_of(text)})
    total = files.count()
    frequency = scratch.write(document_frequency(files, "text"), "frequency")
    df = {r.term: r.n for r in frequency.filter(F.col("term").isin(vocabulary)).collect()}
    idf = {t: math.log((total + 1) / (df.get(t, 0) + 1)) + 1 for t in vocabulary}
    weights = _weights(templates, idf)
    anchored = _array(anchors(weights, at_least))
    name = F.regexp_extract("path", r"[^/]*$", 0)
    lines = F.split("text", "\n")
    whole = F.when(name.rlike(LICENCE_FILE), F.array_append(lines, F.col("text"))).otherwise(lines)
    units = scratch.write(
        files.filter(F.arrays_overlap(_terms("text"), anchored))
        .select("path", F.explode(whole).alias("unit"))
        .filter(F.arrays_overlap(_terms("unit"), anchored))
        .select("path", F.md5("unit").alias("key"), "unit"),
        "units",
    )
    scored = scratch.write(_scored(units.select("key", "unit").dropDuplicates(["key"]), templates, frequency, total, weights, at_least), "scored")
    # a line that a third of all files share is spread by the salt
    spread = scored.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    hits = units.select("path", "key").withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(SALT)).cast("int")).join(spread, ["key", "salt"])
    own = scratch.write(_best(hits.select("path", "license", "score"), "path"), "own")
    licensed = own.filter(F.regexp_extract("path", r"[^/]*$", 0).rlike(LICENCE_FILE)).select(
        _parent("path").alias("dir"), "license", "score", F.col("path").alias("from_path")
    )
    of_dir = _best(licensed, "dir", "from_path")
    open_files = scratch.write(files.select("path").distinct().join(own, "path", "left_anti").withColumn("dir", _parent("path")), "open")
    parts = F.split("dir", "/")
    steps = F.transform(
        F.sequence(F.lit(0), F.size(parts)),
        lambda n: F.struct(F.array_join(F.slice(parts, 1, n), "/").alias("ancestor"), n.alias("depth")),
    )
    # "" alone has one part that is no directory
    above = open_files.select("dir").distinct().select("dir", F.inline(steps)).filter("depth = 0 or ancestor <> ''")
    found = above.join(of_dir.withColumnRenamed("dir", "ancestor"), "ancestor")
    near = found.groupBy("dir").agg(F.max_by(F.struct("license", "score", "from_path"), "depth").alias("x")).select("dir", "x.*")
    near = scratch.write(near, "near").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    rest = open_files.withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(SALT)).cast("int")).join(near, ["dir", "salt"], "left")
    origin = F.when(F.col("license").isNotNull(), F.lit("inherited"))
    result = own.select("path", "license", "score", F.lit("own").alias("origin"), F.col("path").alias("from_path")).unionByName(
        rest.select("path", "license", "score", origin.alias("origin"), "from_path")
    )
    scratch.drop(units, scored, frequency)
    return result


def _best(rows: DataFrame, key: str, tie: str | None = None) -> DataFrame:
    """Per key the row with the highest score, then the least licence name, then the least ``tie``."""
    order = F.struct((-F.col("score")).alias("s"), "license", *([tie] if tie else []))
    chosen = rows.groupBy(key).agg(F.min(order).alias("o"))
    return chosen.select(key, F.col("o.license").alias("license"), (-F.col("o.s")).alias("score"), *([F.col(f"o.{tie}").alias(tie)] if tie else []))
