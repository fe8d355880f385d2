"""Readers over hand-written files."""

import json

import pytest
from pyspark.sql import functions as F

from loomframe.sources import readers as RD


def test_csv_names_match_without_case_and_are_trimmed(spark, tmp_path):
    (tmp_path / "a.csv").write_text('ID, Name ,Price\n1, "x, y" ,2.5\n2,,3\n', encoding="utf-8")
    df = RD.read_csv_dataset(spark, str(tmp_path / "a.csv"), features=["id", "NAME"], labels=["price"])
    assert [tuple(r) for r in df.orderBy("id").collect()] == [("1", "x, y", "2.5"), ("2", "", "3")]


def test_tsv_without_quotes(spark, tmp_path):
    (tmp_path / "a.tsv").write_text('star\ttext\n5\tsaid "hi\n1\t"x\n')
    rows = RD.read_csv_dataset(spark, str(tmp_path / "a.tsv"), sep="\t", quote=None).collect()
    assert sorted(tuple(r) for r in rows) == [("1", '"x'), ("5", 'said "hi')]


def test_review_labels_come_from_the_path(spark, tmp_path):
    for folder, name, text in (("pos", "3_9.txt", "good\nfilm"), ("neg", "4_2.txt", "bad")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text(text)
    rows = RD.read_text_label_from_path(spark, str(tmp_path)).orderBy("id").collect()
    assert [(r.id, r.text, r.sentiment, r.score) for r in rows] == [(3, "good\nfilm", True, 9), (4, "bad", False, 2)]


def test_labelled_lines(spark, tmp_path):
    (tmp_path / "q.txt").write_text("__label__a __label__b how to\n__label__c x __label__d\nplain\n")
    rows = [tuple(r) for r in RD.read_labelled_lines(spark, str(tmp_path / "q.txt")).collect()]
    assert rows == [(["a", "b"], "how to"), (["c"], "x __label__d"), ([], "plain")]


def test_image_folder(spark, tmp_path):
    for p in ("dog/1.jpg", "cat/2.PNG", "cat/deep/3.jpg", "cat/notes.txt", "root.jpg"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b"x")
    rows = RD.list_image_folder(spark, str(tmp_path)).collect()
    assert sorted((r.path.rsplit("/", 1)[1], r["class"], r.class_index) for r in rows) == [("1.jpg", "dog", 1), ("2.PNG", "cat", 0)]
    assert RD.list_image_folder(spark, str(tmp_path), max_depth=2).count() == 3


def test_vocabulary_order_is_the_file_order(spark, tmp_path):
    words = [f"w{i * 7919 % 5000}" for i in range(5000)]
    (tmp_path / "v.txt").write_text("\n".join(f" {w} " for w in words) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = RD.read_vocabulary(spark, str(tmp_path / "v.txt")).orderBy("index").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.token for r in rows] == words and [r["index"] for r in rows] == list(range(5000))


def test_annotations(spark, tmp_path):
    doc = {
        "images": [{"id": 1, "coco_url": "u", "height": 10, "width": 20}, {"id": 2, "coco_url": "v", "height": 1, "width": 1}],
        "annotations": [
            {"id": 5, "image_id": 1, "bbox": [1, 2, 3, 4], "area": 12, "category_id": 9},
            {"id": 6, "image_id": 1, "bbox": [1, 2, 0, 0], "area": 0, "category_id": 4},
        ],
        "categories": [{"id": 9, "name": "b"}, {"id": 4, "name": "a"}],
    }
    (tmp_path / "a.json").write_text(json.dumps(doc, indent=1))
    tables = RD.read_annotations_json(spark, str(tmp_path / "a.json"))
    rows = RD.annotation_join(**tables).collect()
    # list order, not id order: category 9 comes first
    assert [(r.image_id, r.id, r.category) for r in rows] == [(1, 5, 0)]


def test_box_map(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps({"p.jpg": [0, 0, 0, 0, 1, 0.1, 0.2, 0.3, 0.4]}))
    assert [tuple(r) for r in RD.read_box_map_json(spark, str(tmp_path / "b.json")).collect()] == [("p.jpg", 1.0, 0.1, 0.2, 0.3, 0.4)]


def test_array_dataset_checks_lengths(spark):
    df = spark.createDataFrame([([1, 2], [3, 4])], "a array<int>, b array<int>")
    assert [tuple(r) for r in RD.array_dataset(df, a="a", b="b").collect()] == [(0, 1, 3), (1, 2, 4)]
    bad = spark.createDataFrame([([1, 2], [3])], "a array<int>, b array<int>")
    with pytest.raises(Exception, match="differ in length"):
        RD.array_dataset(bad, a="a", b="b").collect()


def test_tensor_shape_is_checked(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1).select(F.lit("x").alias("name"), F.lit("f").alias("dtype"), F.array(F.lit(3)).cast("array<bigint>").alias("shape"), F.array(F.lit(1.0)).alias("data")).write.parquet(path)
    with pytest.raises(Exception, match="does not fit"):
        RD.read_tensors(spark, path).collect()
