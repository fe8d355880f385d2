"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch retains every distinct shingle hash below a fixed share of the hash
range. Whether a hash is retained depends on the hash alone, so the sketch of a
union is the union of sketches (below the threshold), sketches of documents of
very unequal length compare hash by hash, and containment needs no knowledge of
the other document's size.

A document whose shingles all lie above the threshold retains its least hash
instead; that hash shows by its own value that it lies above, so merging drops
it as soon as a retained one is present.

Only DataFrame operations are used.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomframe.core.order import literal_array
from loomframe.llm.common import free_name

HEX = 16


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


@dataclass(frozen=True)
class Sketch:
    """Shingles of ``words`` words; hashes below ``one_in`` parts of the range are retained, ``digits`` hex digits of each."""

    words: int = 5
    one_in: int = 8
    digits: int = 12

    @property
    def threshold(self) -> str:
        """The least hash that is not retained, as hex digits."""
        return f"{-(-(HEX**self.digits) // self.one_in):0{self.digits}x}"

    def hashes(self, text: Column) -> Column:
        """All shingle hashes of a text, in reading order: the MD5 of its lower-case words joined by spaces.

        A text with fewer words has its whole sequence as one shingle; a null or blank text has none.
        """
        words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")
        starts = lambda w: F.sequence(F.lit(0), F.greatest(F.size(w) - self.words, F.lit(0)))
        # places past the last word are null and join to nothing
        shingle = lambda w, i: F.concat_ws(" ", *[F.get(w, i + j) for j in range(self.words)])
        each = lambda w: F.transform(starts(w), lambda i: F.md5(shingle(w, i)))
        return let(words, lambda w: F.when(F.size(w) > 0, each(w)).otherwise(F.array().cast("array<string>")))

    def _settled(self, hashes: Column) -> Column:
        """The first digits of the distinct hashes below the threshold, ascending; if there is none, those of the least one."""
        below = lambda h: F.filter(h, lambda x: x < self.threshold)
        least = lambda h: F.filter(F.array(F.array_min(h)), lambda x: x.isNotNull())
        found = let(hashes, lambda h: let(below(h), lambda b: F.when(F.size(b) > 0, b).otherwise(least(h))))
        return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.substring(x, 1, self.digits))))

    def of(self, text: Column) -> Column:
        """The sketch of a text, an ascending array of hex strings."""
        return self._settled(self.hashes(text))

    def merged(self, *sketches: Column) -> Column:
        """The sketch of several documents together."""
        return self._settled(F.flatten(F.array(*sketches)))

    def merged_rows(self, df: DataFrame, group: list[str], sketch: str, name: str = "sketch") -> DataFrame:
        """The sketch of each group's documents together, folded hash by hash: no group is one array before its hashes are distinct."""
        long = df.select(*group, F.explode(sketch).alias("_hash")).distinct()
        below = F.array_sort(F.collect_list(F.when(F.col("_hash") < self.threshold, F.col("_hash"))))
        out = long.groupBy(*group).agg(below.alias("_below"), F.min("_hash").alias("_least"))
        return out.select(*group, F.when(F.size("_below") > 0, F.col("_below")).otherwise(F.array("_least")).alias(name))


def jaccard(a: Column, b: Column) -> Column:
    """Estimated shared part of all shingles of two documents; 1 for two empty sketches, 0 for one."""
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / either)


def containment(a: Column, b: Column) -> Column:
    """Estimated part of the first document's shingles that the second has; 1 if the first sketch is empty."""
    return F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def fingerprint(sketch: Column) -> Column:
    """A sketch as one string: its hashes, ascending, end to end with dots between."""
    return F.array_join(sketch, ".")


def hashes_of(printed: Column) -> Column:
    """The sketch behind a fingerprint."""
    return F.filter(F.split(printed, r"\."), lambda x: x != "")


def with_next(df: DataFrame, key: str, tie: Column, columns: list[str], derived: dict[str, Column] | None = None, per_partition: int = 8) -> DataFrame:
    """``df`` with ``next_<column>`` of the row after it in ascending ``key``; after the last row comes the first.

    ``derived`` are costly columns to add to ``df``: they are computed once per row, when the ranges are known.

    Rows are dealt by the key into ranges of about equal counts, ``per_partition``
    for each shuffle partition, and each range also gets a copy of the row that
    opens the next range, so one exchange serves and no window spans more than a
    range. The key is a number. Rows with a null key come first; rows of one key are ordered by
    ``tie`` and lie in one range. A single row is its own next one.
    """
    ranges = per_partition * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at, halo, order = (free_name(df, n) for n in ("_range", "_halo", "_tie"))
    keyed = df.withColumn(order, tie)
    cuts = df.agg(F.percentile_approx(key, [i / ranges for i in range(1, ranges)], 4 * ranges)).first()[0] or []
    cuts = sorted(set(cuts))
    kind = df.schema[key].dataType.simpleString()
    # the number of cut values below the key, by halving steps over a constant array
    steps = [1 << i for i in reversed(range(len(cuts).bit_length()))]
    bounds = literal_array(cuts, kind)
    further = lambda n, step: F.coalesce(F.get(bounds, n + step - 1) < F.col(key), F.lit(False))
    place = F.aggregate(literal_array(steps, "int"), F.lit(0), lambda n, step: F.when(further(n, step), n + step).otherwise(n))
    dealt = keyed.withColumn(at, place)
    first = F.struct(F.col(key).alias("k"), F.col(order).alias("t"))
    opening = {r[at]: r["o"] for r in dealt.groupBy(at).agg(F.min(first).alias("o")).collect()}  # a row per range
    derived = derived or {}
    if not opening:
        return df.withColumns(derived).select("*", *[F.col(c).alias(free_name(df, f"next_{c}")) for c in columns])
    used = sorted(opening)
    before = {r: used[i - 1] for i, r in enumerate(used)}
    spark = df.sparkSession
    edges = spark.createDataFrame(
        [(r, before[r], opening[r].k, opening[r].t) for r in used], f"_r int, _into int, _k {kind}, _t {keyed.schema[order].dataType.simpleString()}"
    )
    opens = dealt.join(F.broadcast(edges), (F.col(at) == F.col("_r")) & F.col(key).eqNullSafe(F.col("_k")) & F.col(order).eqNullSafe(F.col("_t")))
    copies = opens.dropDuplicates([at]).select(*df.columns, F.col(order), F.col("_into").alias(at), F.lit(1).alias(halo))
    rows = dealt.withColumn(halo, F.lit(0)).unionByName(copies).withColumns(derived)
    line = Window.partitionBy(at).orderBy(halo, key, order)
    named = {free_name(df, f"next_{c}"): F.lead(c).over(line) for c in columns}
    return rows.withColumns(named).filter(F.col(halo) == 0).drop(at, halo, order)


def compare_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sketch: Sketch = Sketch()) -> DataFrame:
    """Each document's fingerprint beside that of an edited copy, whose last quarter comes from the next document.

    Returns ``(id_col, text, edited, sketch, edited_sketch, next_sketch)``: arrays
    for the sketches. The last ``floor(n / 4)`` of n code points are replaced by as
    many first ones (or all) of the next document in ascending id; after the last
    comes the first. A null text counts as empty; null ids come first; documents
    of one id are ordered by their texts' hashes; repeated rows each get a row.
    """
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    both = with_next(rows, id_col, F.xxhash64("_text"), ["_text", "_print"], {"_print": fingerprint(sketch.of(F.col("_text")))})
    keep, cut = F.length("_text") - F.floor(F.length("_text") / 4), F.floor(F.length("_text") / 4)
    edited = F.concat(F.substring("_text", F.lit(1), keep.cast("int")), F.substring("next__text", F.lit(1), cut.cast("int")))
    texts = both.withColumn("_edited", edited)
    return texts.select(
        id_col,
        F.col("_text").alias("text"),
        F.col("_edited").alias("edited"),
        hashes_of(F.col("_print")).alias("sketch"),
        sketch.of(F.col("_edited")).alias("edited_sketch"),
        hashes_of(F.col("next__print")).alias("next_sketch"),
    )
