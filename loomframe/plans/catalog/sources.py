"""Sources and sinks: tables are written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomframe.core.session import new_path
from loomframe.functions import vectors as V
from loomframe.operators import features as X
from loomframe.plans.catalog.text import VOCAB_SQL, vocabulary
from loomframe.plans.registry import LONG_EMBEDDINGS, Tables, query, r
from loomframe.sources import readers as RD
from loomframe.sources.datasource import RecordDataset

_LINES = ["l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag", "l_extendedprice"]


def _written_csv(t: Tables, df, **options) -> str:
    path = new_path(t.spark, "csv")
    writer = df.write
    for k, v in options.items():
        writer = writer.option(k, v)
    writer.csv(path)
    return path


@query("read_csv_dataset", "SELECT l_quantity AS quantity, l_returnflag AS returnflag, l_extendedprice AS price, count(*) AS n FROM lineitem GROUP BY 1, 2, 3")
def _csv(t: Tables):
    df = t.lineitem.select(F.col("l_quantity").alias("Quantity"), F.col("l_returnflag").alias("ReturnFlag"), F.col("l_extendedprice").alias("PRICE"))
    path = _written_csv(t, df, header=True)
    back = RD.read_csv_dataset(t.spark, path, features=["quantity", "returnflag"], labels=["price"])
    return back.select(
        X.numeric_feature("quantity").alias("quantity"), "returnflag", X.numeric_feature("price").alias("price")
    ).groupBy("quantity", "returnflag", "price").agg(F.count("*").alias("n"))


@query("read_csv_gzip", "SELECT o_orderkey::VARCHAR AS o_orderkey, o_orderpriority FROM orders")
def _gzip(t: Tables):
    path = _written_csv(t, t.orders.select("o_orderkey", "o_orderpriority"), header=True, compression="gzip")
    return RD.read_csv_dataset(t.spark, path)


@query("read_tsv_noquote", "SELECT c_custkey::VARCHAR AS c_custkey, c_name || ' \"' || c_mktsegment AS note FROM customer")
def _tsv(t: Tables):
    # an unbalanced quote is plain text here
    df = t.customer.select("c_custkey", F.concat("c_name", F.lit(' "'), "c_mktsegment").alias("note"))
    path = _written_csv(t, df, header=True, sep="\t", quote="")
    return RD.read_csv_dataset(t.spark, path, sep="\t", quote=None)


@query(
    "read_tsv_fixed_columns",
    "SELECT s_suppkey::DOUBLE AS key, s_nationkey::DOUBLE AS nation, s_acctbal AS balance FROM supplier",
)
def _fixed(t: Tables):
    path = _written_csv(t, t.supplier.select("s_suppkey", "s_nationkey", "s_acctbal"), sep="\t")
    names = ["key", "nation", "balance"]
    df = RD.read_csv_dataset(t.spark, path, columns=names, sep="\t")
    return df.select(*[X.numeric_feature(n).alias(n) for n in names])


_MANIFEST = {
    "keys": ["l_orderkey", "l_linenumber"],
    "features": ["l_quantity", "l_returnflag", "l_discount"],
    "categorical": ["l_returnflag"],
    "maps": {"l_returnflag": {"A": 0, "N": 1, "R": 2}},
}


@query(
    "read_feature_manifest",
    "SELECT l_orderkey::VARCHAR AS l_orderkey, l_linenumber::VARCHAR AS l_linenumber, l_quantity, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END::BIGINT AS l_returnflag, l_discount FROM lineitem",
)
def _manifest(t: Tables):
    path = _written_csv(t, t.lineitem.select(*_LINES), header=True)
    return RD.featurize_by_manifest(RD.read_csv_dataset(t.spark, path), _MANIFEST)


@query("column_names", "SELECT (row_number() OVER () - 1)::INT AS position, column_name AS name FROM (DESCRIBE SELECT * FROM part)")
def _columns(t: Tables):
    path = _written_csv(t, t.part, header=True)
    return RD.column_names(RD.read_csv_dataset(t.spark, path))


@query("read_parallel_text", "SELECT p_name AS source, p_type AS target, count(*) AS n FROM part GROUP BY 1, 2")
def _parallel(t: Tables):
    path = new_path(t.spark, "pairs")
    t.part.select(F.concat_ws("\t", "p_name", "p_type", "p_brand")).write.text(path)
    return RD.read_parallel_text(t.spark, path).groupBy("source", "target").agg(F.count("*").alias("n"))


@query(
    "read_text_label_from_path",
    "SELECT quality = 1 AS sentiment, 10 * toxic AS score, sum(length(text))::BIGINT + count(*) AS chars FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2",
)
def _text_label(t: Tables):
    path = new_path(t.spark, "reviews")
    df = t.labels.join(t.documents.select("doc_id", "text"), "doc_id").select(
        "text", F.when(F.col("quality") == 1, "pos").otherwise("neg").alias("sentiment"), (F.col("toxic") * 10).alias("score")
    )
    df.write.partitionBy("sentiment", "score").text(path)
    back = RD.read_text_label_from_path(t.spark, path, r"/sentiment=(pos|neg)/score=((\d+))/[^/]+\.txt$")
    return back.groupBy("sentiment", "score").agg(F.sum(F.length("text")).cast("bigint").alias("chars"))


@query(
    "read_labelled_lines",
    """SELECT 'q' || quality || ',t' || toxic AS labels, md5(replace(text, chr(10), ' ')) AS digest FROM labels JOIN documents USING (doc_id)""",
)
def _labelled(t: Tables):
    path = new_path(t.spark, "labelled")
    df = t.labels.join(t.documents.select("doc_id", "text"), "doc_id")
    line = F.concat(
        F.lit("__label__q"), F.col("quality"), F.lit(" __label__t"), F.col("toxic"), F.lit(" "), F.replace("text", F.lit("\n"), F.lit(" "))
    )
    df.select(line.alias("value")).write.text(path)
    return RD.read_labelled_lines(t.spark, path).select(F.array_join("labels", ",").alias("labels"), F.md5("text").alias("digest"))


@query("vocabulary_from_file", f"SELECT token, index FROM {VOCAB_SQL}")
def _vocabulary_file(t: Tables):
    path = new_path(t.spark, "vocabulary-file")
    vocabulary(t).orderBy("index").select(F.concat("token", F.lit("  "))).write.text(path)
    return RD.read_vocabulary(t.spark, path)


@query(
    "list_image_folder",
    "SELECT 'label=' || label AS class, row_number() OVER (ORDER BY 'label=' || label) - 1 AS class_index FROM (SELECT DISTINCT label FROM embeddings)",
)
def _folder(t: Tables):
    path = new_path(t.spark, "folder")
    t.embeddings.select("label", F.col("vec_id").cast("string")).write.partitionBy("label").text(path)
    files = RD.list_image_folder(t.spark, path, extensions=["txt"])
    return files.select("class", "class_index").distinct()


# annotation documents: one per order, an order is a box and its customer the image
_CATEGORIES = "array(named_struct('id', 30L, 'name', 'high'), named_struct('id', 10L, 'name', 'low'), named_struct('id', 20L, 'name', 'mid'))"


def _annotation_path(t: Tables) -> str:
    path = new_path(t.spark, "annotations")
    t.orders.select(
        F.expr("array(named_struct('id', o_custkey, 'coco_url', concat('u', o_custkey), 'height', 480, 'width', 640))").alias("images"),
        F.expr(
            "array(named_struct('id', o_orderkey, 'image_id', o_custkey, 'bbox', array(o_orderkey % 50 * 1D, o_orderkey % 40 * 1D, o_orderkey % 7 * 1D, 5D),"
            " 'area', o_orderkey % 7 * 5D, 'category_id', (o_orderkey % 3 + 1) * 10))"
        ).alias("annotations"),
        F.expr(_CATEGORIES).alias("categories"),
    ).write.json(path)
    return path


@query(
    "read_annotations_json",
    """SELECT 'image' AS kind, count(DISTINCT o_custkey) AS n, sum(DISTINCT o_custkey)::BIGINT AS total FROM orders
UNION ALL SELECT 'annotation', count(*), sum(o_orderkey)::BIGINT FROM orders UNION ALL SELECT 'category', 3, 60""",
)
def _annotations(t: Tables):
    tables = RD.read_annotations_json(t.spark, _annotation_path(t), multi_line=False)
    count = lambda name, kind: tables[name].agg(F.count("*").alias("n"), F.sum("id").alias("total")).select(
        F.lit(kind).alias("kind"), "n", "total"
    )
    return count("images", "image").unionByName(count("annotations", "annotation")).unionByName(count("categories", "category"))


@query(
    "annotation_join",
    """SELECT o_custkey AS image_id, o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END::INT AS category,
  (o_orderkey % 50) / 640.0::DOUBLE AS x FROM orders WHERE o_orderkey % 7 > 0""",
)
def _annotation_join(t: Tables):
    tables = RD.read_annotations_json(t.spark, _annotation_path(t), multi_line=False)
    out = RD.annotation_join(**tables)
    return out.select("image_id", "id", "category", (F.col("bbox")[0] / F.col("width")).alias("x"))


@query(
    "read_box_map_json",
    "SELECT 'img' || o_orderkey || '.jpg' AS file, (o_orderkey % 3)::DOUBLE AS class, 0.5::DOUBLE AS x, 0.25::DOUBLE AS y, (o_orderkey % 11)::DOUBLE AS w, o_totalprice AS h FROM orders",
)
def _box_map(t: Tables):
    path = new_path(t.spark, "boxes")
    name = F.concat(F.lit("img"), F.col("o_orderkey"), F.lit(".jpg"))
    numbers = F.expr("array(0D, 0D, 0D, 0D, o_orderkey % 3 * 1D, 0.5D, 0.25D, o_orderkey % 11 * 1D, o_totalprice)")
    t.orders.select(F.to_json(F.create_map(name, numbers)).alias("value")).write.text(path)
    return RD.read_box_map_json(t.spark, path)


@query(
    "array_dataset",
    f"SELECT a.vec_id, a.pos AS record, {r('a.x')} AS data, {r('b.x')} AS label FROM {LONG_EMBEDDINGS} a JOIN {LONG_EMBEDDINGS} b ON a.vec_id = b.vec_id AND b.pos = 63 - a.pos",
)
def _arrays(t: Tables):
    df = t.embeddings.select("vec_id", V.doubles("embedding").alias("data"))
    out = RD.array_dataset(df.withColumn("label", F.reverse("data")), data="data", label="label")
    return out.select("vec_id", F.col("record").cast("bigint").alias("record"), F.round("data", 6).alias("data"), F.round("label", 6).alias("label"))


@query(
    "read_object_store",
    "SELECT c_nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS balance, true AS listed FROM customer GROUP BY 1",
)
def _object_store(t: Tables):
    """Artifacts listed under a Hadoop URI, then opened."""
    path = new_path(t.spark, "artifacts")
    t.customer.write.parquet(path)
    listed = RD.list_artifacts(t.spark, path, "*.parquet").agg(F.min("length") > 0).scalar()
    table = RD.open_artifacts(t.spark, path, "*.parquet")
    return table.groupBy("c_nationkey").agg(
        F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance")
    ).withColumn("listed", listed)


@query(
    "write_tensor_table",
    f"SELECT 'v' || vec_id AS name, 'float64' AS dtype, 64::BIGINT AS width, {r('list_sum(embedding::DOUBLE[])')} AS total FROM embeddings",
)
def _tensors(t: Tables):
    path = new_path(t.spark, "tensors")
    RD.write_tensors(t.embeddings, path, F.concat(F.lit("v"), F.col("vec_id")), F.col("embedding"))
    back = RD.read_tensors(t.spark, path)
    return back.select("name", "dtype", F.col("shape")[0].alias("width"), F.round(V.total(F.col("data")), 6).alias("total"))


@query("limit_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 500")
def _limit(t: Tables):
    return RD.limit_rows(t.orders.select("o_orderkey", "o_totalprice"), 500, [F.desc("o_totalprice"), "o_orderkey"])


@query("source_dataset", "SELECT p_brand, count(*) AS n, sum(p_size)::BIGINT AS total FROM part GROUP BY 1")
def _source(t: Tables):
    t.spark.dataSource.register(RecordDataset)
    df = t.spark.read.format("record_dataset").option("path", f"{t.sf_dir}/part.parquet").load()
    return df.groupBy("p_brand").agg(F.count("*").alias("n"), F.sum("p_size").alias("total"))
