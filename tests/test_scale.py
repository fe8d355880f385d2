"""Operators that must not grow faster than their input: plans, bounds and equal results of their paths."""

import io
import os
import random
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomframe.llm import embedding_dedup
from loomframe.operators import detection as D, joins as J, language as L, text_classify as TC, word_vectors as WV
from loomframe.plans.catalog import text
from loomframe.plans.registry import Tables

BOX = "image int, box_id int, score double, x1 double, y1 double, x2 double, y2 double"


def _boxes(n, images, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x, y = rng.random() * 0.7, rng.random() * 0.7
        rows.append((rng.randrange(images), i, rng.random(), x, y, x + 0.05 + rng.random() * 0.25, y + 0.05 + rng.random() * 0.25))
    return rows


def _iou(a, b):
    w, h = min(a[5], b[5]) - max(a[3], b[3]), min(a[6], b[6]) - max(a[4], b[4])
    if w <= 0 or h <= 0:
        return 0.0
    area = lambda r: (r[5] - r[3]) * (r[6] - r[4])
    return w * h / (area(a) + area(b) - w * h)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("threshold", [0.0, 0.25])
def test_boxes_of_small_images_are_not_copied_nor_broadcast(spark, threshold):
    rows = _boxes(120, 8)
    df = spark.createDataFrame(rows, BOX)
    left, right = df.filter("box_id % 2 = 0"), df.filter("box_id % 2 = 1")
    want = {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] % 2 == 0 and b[1] % 2 == 1 and _iou(a, b) > threshold}
    # no image, some images and all images in grid cells
    for one_cell in (512, 15, 0):
        found = J.iou_join(left, right, ["image"], threshold, one_cell=one_cell)
        # the copies of the right side were broadcast by the size of the boxes before they were copied
        assert "SortMergeJoin" in _plan(found)
        pairs = [(r.box_id, r.t_box_id) for r in found.collect()]
        assert len(pairs) == len(set(pairs)) and set(pairs) == want
    copies = J.with_cells(right, F.lit(0)).count()
    assert copies == right.count() < J.with_cells(right, 8).count()


def test_box_without_an_area_overlaps_nothing(spark):
    rows = [(0, 1, 0.5, 0.1, 0.1, 0.5, 0.5), (0, 2, 0.5, 0.2, 0.2, 0.2, 0.4), (0, 3, 0.5, 0.4, 0.4, 0.1, 0.1), (0, 4, 0.5, None, 0.1, 0.5, 0.5), (None, 5, 0.5, 0.1, 0.1, 0.5, 0.5)]
    df = spark.createDataFrame(rows, BOX)
    for one_cell in (512, 0):
        for threshold in (0.0, 0.2):
            got = J.iou_join(df, df, ["image"], threshold, one_cell=one_cell).collect()
            assert [(r.box_id, r.t_box_id) for r in got] == [(1, 1)]


_TRAIN = """
import resource, sys
sys.path.insert(0, {repo!r})
from loomframe.operators import language as L
words = [(a + b, 2_000_000 // (i + 1)) for i, (a, b) in enumerate((a, b) for a in ("run", "walk", "jump", "talk") for b in ("", "s", "ing", "ed", "er", "ers"))]
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
model = L.train_subwords(words, 40)
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before, len(model))
"""


def test_subword_training_does_not_grow_with_the_counts():
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", _TRAIN.format(repo=repo)], capture_output=True, text=True, check=True, timeout=120).stdout
    grown, size = map(int, out.split()[-2:])
    # the trainer's own search for parts took 120 bytes for each occurrence: 900 MB here
    assert grown < 200 << 10 and size > 0


def test_subword_model_is_the_one_of_the_trainers_own_parts():
    spm = pytest.importorskip("sentencepiece")
    words = [(a + b, 60 // (i + 1) + 1) for i, (a, b) in enumerate((a, b) for b in ("", "s", "ing", "ed", "er", "ers") for a in ("run", "walk", "jump", "talk"))]
    model = io.BytesIO()
    spm.SentencePieceTrainer.train(
        sentence_iterator=iter(f"{w}\t{n}" for w, n in words), model_writer=model, input_format="tsv", vocab_size=40, hard_vocab_limit=False, num_threads=1, minloglevel=2
    )
    pieces = lambda m: (lambda p: {p.id_to_piece(i) for i in range(len(p))})(spm.SentencePieceProcessor(model_proto=m))
    assert pieces(L.train_subwords(words, 40)) == pieces(model.getvalue())


def test_text_rows_are_spread_a_slice_at_a_time():
    column = pa.array([[1] * 5, [], [2, 3], [4] * 9, [5]], pa.list_(pa.int32())).slice(1)
    assert list(TC._slices(column, 4)) == [(0, 2), (2, 3), (3, 4)]
    assert [TC._sparse(column.slice(a, b - a), None)[1].tolist() for a, b in TC._slices(column, 4)] == [[2, 3], [4] * 9, [5]]


def test_text_model_does_not_depend_on_the_slices(spark, monkeypatch):
    rows = [(i, [f"w{(i * 7 + j) % 23}" for j in range(1 + i % 6)], "a" if i % 3 else "b") for i in range(120)]
    df = spark.createDataFrame(rows, "k int, tokens array<string>, label string").coalesce(1)
    options = TC.Options(epochs=3, learning_rate=5.0, word_ngrams=2, buckets=256)
    got = []
    for limit in (1 << 18, 3):
        monkeypatch.setattr(TC, "SLICE_FEATURES", limit)
        model = TC.fit(df, F.col("tokens"), F.col("label"), options)
        top = {r.k: r.classes[0].prob for r in model.predict(df, F.col("tokens")).collect()}
        got.append(([h["loss"] for h in model.history], [top[k] for k in sorted(top)]))
    assert got[0][0] == pytest.approx(got[1][0]) and got[0][1] == pytest.approx(got[1][1])


def test_all_links_are_found_whatever_the_number_of_rows(spark, monkeypatch):
    # beyond GROUP_ROWS rows links were found with a probability only
    monkeypatch.setattr(embedding_dedup, "GROUP_ROWS", 128)
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((300, 16))
    x = np.concatenate([centres, centres + 0.45 * rng.standard_normal((300, 16))])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = {r.id: r.n_links for r in embedding_dedup.near_duplicates(df, "id", "v").collect()}
    assert near.sum() > 200 and got == dict(enumerate(near.sum(axis=1).tolist()))


def test_matrices_are_those_of_a_lookup_of_every_id(spark, monkeypatch):
    # ids without a vector, with several, a null id and a null key among them
    ids = [(d, p, None if (d, p) == (2, 1) else ((d or 0) * 3 + p * p) % 9) for d in (0, 1, 2, None) for p in range(1 + 5 * (d or 0))] + [(1, 2, 0)]
    rows = spark.createDataFrame(ids, "doc long, pos int, k long")
    vectors = [(k, [float(k), 1.0]) for k in range(7)] + [(4, [2.0, None]), (5, None), (None, [9.0, 9.0])]
    table = spark.createDataFrame(vectors, "k long, v array<double>")
    want = {r.doc: r.m for r in J.recollect(J.embedding_lookup(rows, table, "k", "v"), ["doc"], "v", "m").collect()}
    placed = rows.select("doc", "pos", F.struct("pos", "k").alias("id"))
    for block in (100_000, 4):
        monkeypatch.setattr(J, "BLOCK_IDS", block)
        made = J.embedding_matrices(J.recollect(placed, ["doc"], "id", "ids"), table, "ids", "k", "v")
        assert {r.doc: r.matrix for r in made.collect()} == want
    assert J.embedding_matrices(J.recollect(placed.limit(0), ["doc"], "id", "ids"), table, "ids", "k", "v").count() == 0


def test_regrouping_by_document_moves_texts_and_not_tokens(spark, tmp_path):
    rows = [(i % 90, f"some words of text {i}", "x") for i in range(180)]
    # more pieces than there are cores: these were left where they lay, and their tokens moved
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(12).write.parquet(str(tmp_path / "documents.parquet"))
    t = Tables(spark, str(tmp_path))
    lists = J.recollect(text.document_rows(t), ["doc_id"], "token", "tokens")
    plan = _plan(lists)
    assert plan.count("Exchange hashpartitioning") == 1 and plan.index("Exchange hashpartitioning") > plan.index("Generate")
    assert {r.doc_id: len(r.tokens) for r in lists.collect()} == {i: 10 for i in range(90)}


@pytest.mark.parametrize("mode", WV.MODES)
def test_word_vectors_do_not_depend_on_the_bundles(spark, monkeypatch, mode):
    rng = random.Random(2)
    rows = [(i, [f"w{min(rng.randrange(40), rng.randrange(40))}" for _ in range(30)]) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, tokens array<string>")
    options = WV.Options(mode=mode, dimensions=4, epochs=2, min_count=2, block_tokens=120, seed=3)
    got = []
    for bundle in (1, 32):
        monkeypatch.setattr(WV, "BUNDLE", bundle)
        got.append({r.word: r.vector for r in WV.fit(df, F.col("tokens"), ["k"], options).collect()})
    assert got[0].keys() == got[1].keys()
    for word, vector in got[0].items():
        assert vector == pytest.approx(got[1][word], rel=1e-9, abs=1e-12)


def _kept(rows, threshold):
    kept = []
    for r in sorted(rows, key=lambda r: (r[0], -r[2], r[1])):
        if all(k[0] != r[0] or _iou(r, k) < threshold for k in kept):
            kept.append(r)
    return sorted((r[0], r[1]) for r in kept)


@pytest.mark.parametrize("one_task", [28, 1000])
def test_suppression_rounds_in_one_task_and_in_many(spark, one_task):
    rows = _boxes(90, 3)
    # the same box twice, and one of no image
    df = spark.createDataFrame([*rows, rows[0], (None, 999, 0.5, 0.1, 0.1, 0.2, 0.2)], BOX)
    want = _kept(rows, 0.3)
    twice = want.count((rows[0][0], rows[0][1])) * [(rows[0][0], rows[0][1])]
    got = [(r.image, r.box_id) for r in D.nms_rounds(df, ["image"], "box_id", "score", 0.3, 8, one_task).collect()]
    assert sorted(got) == sorted(want + twice)


def test_suppression_round_moves_no_copies_of_boxes(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(D, "materialize", lambda df, label: plans.append(_plan(df)) or df.localCheckpoint())
    df = spark.createDataFrame(_boxes(60, 8), BOX)
    assert D.nms_rounds(df, ["image"], "box_id", "score", 0.3, 8).count()
    # one that leaves a single box may need none
    assert plans[0].count("Exchange hashpartitioning") == 1 and all(p.count("Exchange hashpartitioning") <= 1 for p in plans)


def test_sentence_pairs_are_cut_once_and_tokenised_last(spark, sf_dir, monkeypatch):
    pairs = text.line_pairs(Tables(spark, sf_dir))
    # a row of a pair held all lines of its document
    generates = [line for line in _plan(pairs).splitlines() if "Generate" in line]
    assert generates and all("], false, [pair" in line and "[doc_id" in line for line in generates)
    out = L.next_sentence_pairs(pairs, ["doc_id", "pair"], 9)
    # ranking went back to the texts for each of its passes
    assert "regexp_replace" in _plan(pairs) and "regexp_replace" not in _plan(out)
    want = out.collect()
    monkeypatch.setattr(L, "PAIR_ROWS", 2)
    few = L.next_sentence_pairs(pairs, ["doc_id", "pair"], 9).collect()
    assert want and sorted(few) == sorted(want)


def test_masks_of_a_shipped_and_a_joined_vocabulary_agree(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    rows = [(i % 30, None if i % 7 == 0 else i % 3, [rng.choice([*words, "rare", None]) for _ in range(rng.randrange(130))]) for i in range(80)]
    rows += [(100, 1, None), rows[9]]
    df = spark.createDataFrame(rows, "doc_id long, pair long, label array<string>")
    dictionary = spark.createDataFrame([(w, i) for i, w in enumerate(["<unk>", "<msk>", *words])], "token string, index long")
    key, columns = ["doc_id", "pair"], ("pos", "label_id", "masked", "masked_id")
    given = (df, "label", key, dictionary, 13)
    for mask in ("<msk>", "none"):
        shipped = L.mask_tokens(*given, mask, 0)
        # every token was a row, moved to meet the others of its instance
        assert "Generate" not in _plan(shipped) and "Exchange" not in _plan(shipped)
        found = {}
        for r in shipped.collect():
            found.setdefault((r.doc_id, r.pair), []).extend(zip(*[r[c] for c in columns]))
        joined = {(r.doc_id, r.pair): list(zip(*[r[c] for c in columns])) for r in L.mask_tokens_join(*given, mask, 0).collect()}
        order = lambda rows: sorted(rows, key=str)
        assert {k: order(v) for k, v in found.items()} == {k: order(v) for k, v in joined.items()}
        assert any(masked for v in found.values() for _, _, masked, _ in v)
    types = df.filter("label is not null").select(*key, F.transform("label", lambda t: F.lit(1)).alias("types"))
    out = [L.assemble_instances(f, key, types, 300, 60).collect() for f in (shipped, L.mask_tokens_join(*given, mask, 0))]
    assert out[0] and sorted(out[0], key=str) == sorted(out[1], key=str)


def test_pieces_of_lists_are_those_of_their_rows(spark, monkeypatch):
    rng = random.Random(6)
    vocabulary = spark.createDataFrame([(w,) for w in ("a", "b", "##b", "##a", "ab", "##ba", "é")], "token string")
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randrange(1, 6)))
    lists = [(i, [rng.choice([word(), "c", None]) if i % 5 == 0 else word() for _ in range(rng.randrange(1, 40))]) for i in range(30)]
    odd = [(50, None), (51, []), (None, ["ab"]), (3, ["bab", "c"]), (52, ["a" * 201])]
    for extra in (odd[:3], odd):
        df = spark.createDataFrame([*lists, *extra], "doc_id long, tokens array<string>")
        rows = df.select("doc_id", F.posexplode("tokens").alias("pos", "token"))
        want = {r.doc_id: r.tokens for r in L.pieces_in_order(rows, L.wordpiece(rows.filter("token is not null"), vocabulary), ["doc_id"]).collect()}
        monkeypatch.setattr(L, "SPLIT_ROWS", 7)
        monkeypatch.setattr(L, "SPLIT_WORDS", 20)
        got = L.wordpiece_lists(df, ["doc_id"], vocabulary)
        found = got.collect()
        assert {r.doc_id: r.tokens for r in found if r.tokens} == want and len(found) == len({r.doc_id for r in found})
        # each word was a row, moved to meet its pieces and again to meet its document
        assert extra is odd or "Exchange" not in _plan(got)
        with monkeypatch.context() as m:
            m.setattr(L.skew, "BROADCAST_BYTES", 0)
            assert {r.doc_id: r.tokens for r in L.wordpiece_lists(df.filter("doc_id != 5 or doc_id is null"), ["doc_id"], vocabulary).collect() if r.doc_id in (1, 3)} == {k: want[k] for k in (1, 3)}
