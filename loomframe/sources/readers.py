"""Labelled tables, text, annotations and folders as DataFrames.

Paths are any Hadoop URI (hdfs://, s3a://, file://…); compression follows the
file suffix.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loomframe.core.order import row_index


def read_csv_dataset(
    spark: SparkSession,
    path: str | list[str],
    columns: Sequence[str] | None = None,
    sep: str = ",",
    quote: str | None = '"',
    features: Sequence[str] = (),
    labels: Sequence[str] = (),
    multi_line: bool = False,
) -> DataFrame:
    """String columns, trimmed; names from the header or from ``columns``.

    Column names match without regard to case. Empty strings stay empty.
    """
    reader = (
        spark.read.option("sep", sep)
        .option("encoding", "UTF-8")
        .option("quote", quote or "\u0000")
        .option("escape", '"' if quote else "\u0000")
        .option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True)
        .option("multiLine", multi_line)
    )
    if columns is None:
        df = reader.option("header", True).csv(path)
    else:
        df = reader.schema(", ".join(f"`{c}` string" for c in columns)).csv(path)
    # Spark reads an unquoted empty field as NULL; a CSV has no NULL
    wanted = [*features, *labels] or df.columns
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in wanted])


def column_names(df: DataFrame) -> DataFrame:
    """(position, name) of a table's columns."""
    return df.sparkSession.createDataFrame(list(enumerate(df.columns)), "position int, name string")


def featurize_by_manifest(df: DataFrame, manifest: dict) -> DataFrame:
    """Columns chosen and featurized by a manifest.

    ``features`` lists the columns, ``categorical`` those to index, and ``maps``
    holds their value -> index maps; other columns are numbers.
    """
    from loomframe.operators.features import categorical_index_map, numeric_feature

    features = manifest["features"]
    for name in features:
        if name in manifest["categorical"]:
            df = categorical_index_map(df, name, manifest["maps"][name], f"{name}__index")
            df = df.withColumn(name, F.col(f"{name}__index")).drop(f"{name}__index")
        else:
            df = df.withColumn(name, numeric_feature(name))
    keep = [*manifest.get("keys", []), *features]
    return df.select(*keep)


def read_parallel_text(spark: SparkSession, path: str) -> DataFrame:
    """One tab-separated sentence pair per line; further fields are ignored, a line of one field is an error."""
    parts = F.split("value", "\t")
    bad = F.raise_error(F.concat(F.lit("line without a tab: "), F.col("value")))
    target = F.when(F.size(parts) >= 2, F.get(parts, F.lit(1))).otherwise(bad)
    return spark.read.text(path).select(parts[0].alias("source"), target.alias("target"))


def read_text_label_from_path(
    spark: SparkSession, path: str, pattern: str = r"/(pos|neg)/(\d+)_(\d+)\.txt$", positive: str = "pos"
) -> DataFrame:
    """Whole files; the label is in the path: directory = sentiment, file = id_score.txt."""
    df = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    name = F.col("_metadata.file_path")
    part = lambda i: F.regexp_extract(name, pattern, i)
    return df.select(
        part(2).cast("bigint").alias("id"),
        "value",
        (part(1) == positive).alias("sentiment"),
        part(3).cast("int").alias("score"),
    ).withColumnRenamed("value", "text")


def read_labelled_lines(spark: SparkSession, path: str, prefix: str = "__label__") -> DataFrame:
    """Lines '<prefix>a <prefix>b text' to (labels, text)."""
    label = rf"{prefix}(\S+)"
    head = rf"^((?:{prefix}\S+\s*)*)(.*)$"
    return spark.read.text(path).select(
        F.regexp_extract_all(F.regexp_extract("value", head, 1), F.lit(label), F.lit(1)).alias("labels"),
        F.regexp_extract("value", head, 2).alias("text"),
    )


def list_image_folder(
    spark: SparkSession, path: str, extensions: Sequence[str] = ("jpg", "jpeg", "png", "bmp"), max_depth: int = 1
) -> DataFrame:
    """(path, class, class_index): class = first directory, indices in sorted class order.

    Only the listing is read: the content column is never selected.
    """
    root = re.escape(re.sub(r"^[a-zA-Z]+:/+", "", path).strip("/"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    inside = F.regexp_extract("path", rf"^(?:[a-zA-Z]+:)?/*{root}/(.+)$", 1)
    parts = F.split(inside, "/")
    allowed = F.lower(F.element_at(F.split("path", r"\."), -1)).isin([e.lower() for e in extensions])
    kept = files.filter(allowed & (F.size(parts) >= 2) & (F.size(parts) <= max_depth + 1)).select(
        "path", parts[0].alias("class")
    )
    classes = row_index(kept.select("class").distinct(), "class", "class_index")
    return kept.join(classes, "class").select("path", "class", "class_index")


ANNOTATIONS = (
    "images array<struct<id: bigint, coco_url: string, height: int, width: int>>, "
    "annotations array<struct<id: bigint, image_id: bigint, bbox: array<double>, area: double, category_id: bigint>>, "
    "categories array<struct<id: bigint, name: string>>"
)


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """One trimmed token per line; the index is the line's place in the file(s).

    Lines are placed by file, block and position in the block, so the order does
    not depend on how the files are cut into tasks.
    """
    lines = spark.read.text(path).select(
        F.trim("value").alias("token"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
    )
    return row_index(lines, ["_file", "_block", "_line"], "index").select("token", "index")


def read_annotations_json(spark: SparkSession, path: str, multi_line: bool = True) -> dict[str, DataFrame]:
    """The three tables of annotation documents; ``position`` is the category list order."""
    docs = spark.read.schema(ANNOTATIONS).option("multiLine", multi_line).json(path)
    listed = docs.select(F.posexplode("categories").alias("position", "c")).select("position", "c.*")
    conflict = F.raise_error(F.concat(F.lit("category with several names: "), F.col("id").cast("string")))
    # one row per category id, whatever order the documents list them in
    categories = (
        listed.groupBy("id").agg(F.min("position").alias("position"), F.min("name").alias("name"), F.max("name").alias("_other"))
        .select("position", "id", F.when(F.col("name").eqNullSafe(F.col("_other")), F.col("name")).otherwise(conflict).alias("name"))
    )
    return {
        "images": docs.select(F.inline("images")).distinct(),
        "annotations": docs.select(F.inline("annotations")),
        "categories": categories,
    }


def annotation_join(images: DataFrame, annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """Boxes with area > 0 and their dense category index, in category list order."""
    boxes = annotations.filter(F.col("area") > 0)
    index = categories.select(F.col("id").alias("category_id"), F.col("position").alias("category"))
    size = images.select(F.col("id").alias("image_id"), "height", "width")
    return boxes.join(index, "category_id").join(size, "image_id")


def read_box_map_json(spark: SparkSession, path: str) -> DataFrame:
    """Lines of {file: numbers}; positions 4 to 8 are class, x, y, w, h."""
    files = spark.read.text(path).select(F.explode(F.from_json("value", "map<string, array<double>>")).alias("file", "v"))
    names = ("class", "x", "y", "w", "h")
    return files.select("file", *[F.col("v")[4 + i].alias(n) for i, n in enumerate(names)])


def array_dataset(df: DataFrame, **arrays: str | Column) -> DataFrame:
    """Records from array columns of one length (an error otherwise)."""
    cols = {k: F.col(c) if isinstance(c, str) else c for k, c in arrays.items()}
    first = next(iter(cols.values()))
    same = F.lit(True)
    for c in cols.values():
        same = same & (F.size(c) == F.size(first))
    df = df.withColumns({f"_{k}": c for k, c in cols.items()})
    zipped = F.transform(
        F.arrays_zip(*[f"_{k}" for k in cols]), lambda z: F.struct(*[z.getField(f"_{k}").alias(k) for k in cols])
    )
    checked = F.when(same, zipped).otherwise(F.raise_error(F.lit("arrays differ in length")))
    used = {a for a in arrays.values() if isinstance(a, str)} | {f"_{k}" for k in cols}
    rest = [c for c in df.columns if c not in used]
    return df.select(*rest, F.posexplode(checked).alias("record", "_z")).select(
        *rest, "record", *[F.col(f"_z.{k}") for k in cols]
    )


def list_artifacts(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, length) of the files under any Hadoop URI."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    return files.load(path).select("path", "length")


def open_artifacts(spark: SparkSession, path: str, glob: str, form: str = "parquet") -> DataFrame:
    """The matching files under any Hadoop URI as one table."""
    reader = spark.read.format(form).option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    return reader.load(path)


def limit_rows(df: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    """The first ``n`` rows in order (top-n per task, then one merge of n rows)."""
    return df.orderBy(*order_by).limit(n)


def write_tensors(df: DataFrame, path: str, name: Column, data: Column, dtype: str = "float64") -> None:
    """Arrays as (name, dtype, shape, data) rows of Parquet."""
    df.select(
        name.alias("name"),
        F.lit(dtype).alias("dtype"),
        F.array(F.size(data).cast("bigint")).alias("shape"),
        data.cast("array<double>").alias("data"),
    ).write.parquet(path)


def read_tensors(spark: SparkSession, path: str) -> DataFrame:
    """Rows of ``write_tensors``; a shape that does not fit its data is an error."""
    df = spark.read.parquet(path)
    cells = F.aggregate("shape", F.lit(1).cast("bigint"), lambda a, x: a * x)
    broken = F.raise_error(F.lit("shape does not fit the data"))
    return df.withColumn("data", F.when(cells != F.size("data"), broken).otherwise(F.col("data")))
