"""Fill-in-middle, vector codes and scaled sketches against brute force, and on nulls, empty and repeated rows."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomframe.llm import fill_middle, scaled_sketch, vector_codes
from loomframe.llm.queries import QUERIES, op11, op12, op13

LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(200_000))
DOCS = "doc_id long, text string, n string, form string, fim_text string, _range int, next__text string, label int"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls everywhere, empty and very long texts, repeated rows, columns with clashing names."""
    rng = random.Random(5)
    texts = ["", None, "a", "abc def", "x <S> y", "é ü ß\n漢字", "\r\n\t", LONG, "one two three four five six", "one two three four five six"]
    texts += [" ".join(rng.choice(["red", "blau", "Grün", "<", "P>", "1.5"]) for _ in range(rng.randrange(60))) for _ in range(40)]
    rows = [(i, t, "n", "f", None, 1, None, 2) for i, t in enumerate(texts)]
    rows += [rows[3], rows[8], (None, "no id here", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


# fill-in-middle ---------------------------------------------------------------------------
def brute_middle(ident, text):
    h = hashlib.sha256(f"1:{'' if ident is None else ident}".encode()).hexdigest()
    a, b, keep, order = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    first, second = sorted((a % (n + 1), b % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:first], units[first:second], units[second:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or keep % 100 >= 90:
        return n, "plain", text, None, None
    if order % 100 < 20:
        return n, "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m)
    return n, "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m)


def test_arranged_texts_and_their_restoration(docs):
    out = fill_middle.restore(fill_middle.fill_in_middle(docs), "_fim_text", "_form").collect()
    assert len(out) == docs.count()
    for r in out:
        want = brute_middle(r.doc_id, r.text)
        assert (r["_n"], r["_form"], r["_fim_text"], r.prefix_chars, r.middle_chars) == want
        assert r.fim_sha256 == sha(want[2]) and r.restored_text == (r.text or "") and r.restored_sha256 == sha(r.text or "")
        assert r.n in ("n", None) and r.form in ("f", None)
    assert {r["_form"] for r in out} == {"plain", "psm", "spm"}


def test_cut_positions_between_all_units():
    texts = ["ab 1é漢c"] * 200
    made = fill_middle.arrange(pa.array(texts, pa.large_string()), list(range(200)), fill_middle.Rule(rearranged=100))
    got = list(zip(*[made[c].to_pylist() for c in ("n", "form", "fim_text", "prefix_chars", "middle_chars")]))
    assert len({(p, m) for _, _, _, p, m in got}) > 15
    for i, (n, form, text, p, m) in enumerate(got):
        prefix, middle, suffix = texts[i][:p], texts[i][p : p + m], texts[i][p + m :]
        assert n == 6 and text == (f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}")


def test_restore_refuses_what_no_arrangement_made(spark):
    rows = [("<P>a<S>b<M>c", "psm"), ("<P>a<M>b<S>c", "psm"), ("x<P>a<S>b<M>c", "psm"), ("abc", "other"), ("abc", None), (None, "plain"), (None, "spm")]
    out = fill_middle.restore(spark.createDataFrame(rows, "fim_text string, form string")).collect()
    assert [r.restored_text for r in out] == ["acb", None, None, None, None, "", None]


def test_fill_middle_of_an_empty_table(docs):
    out = fill_middle.restore(fill_middle.fill_in_middle(docs.limit(0), keep=["doc_id"]))
    assert out.count() == 0 and out.columns[:2] == ["doc_id", "n"]


# vector codes -----------------------------------------------------------------------------
def brute_codes(rows, parts, size, rounds):
    """``rows`` of (id, label, integer vector)."""
    first = {}
    for i, _, v in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2])):
        if i is not None:
            first.setdefault(i, v)
    start = np.array([first[i] for i in sorted(first)[:size]])
    x = np.array([v for *_, v in rows])
    width = x.shape[1] // parts
    books = [start[:, p * width : (p + 1) * width].copy() for p in range(parts)]
    cut = [x[:, p * width : (p + 1) * width] for p in range(parts)]
    for k in range(rounds + 1):
        d = [((c[:, None] - b[None]) ** 2).sum(axis=2) for c, b in zip(cut, books)]
        near = [a.argmin(axis=1) for a in d]
        if k < rounds:
            for p in range(parts):
                for e in range(len(books[p])):
                    mine = cut[p][near[p] == e]
                    if len(mine):
                        books[p][e] = mine.sum(axis=0) // len(mine)
    return near, sum(a.min(axis=1) for a in d), np.array(books)


def table_of(spark, rows):
    return spark.createDataFrame([(i, label, [float(c) / 16 for c in v], "x") for i, label, v in rows], "vec_id long, label string, embedding array<double>, code string")


@pytest.mark.parametrize("kind", ["spread", "clusters", "third the same", "ties"])
def test_codes_match_brute_force(spark, kind, monkeypatch):
    monkeypatch.setattr(vector_codes, "CHUNK", 150)
    rng = np.random.default_rng(3)
    n, width = 400, 8
    x = rng.integers(-300, 300, (n, width))
    if kind == "clusters":
        x = rng.integers(-300, 300, (6, width))[rng.integers(0, 6, n)] + rng.integers(-9, 9, (n, width))
    if kind == "third the same":
        x[: n // 3] = x[0]
    if kind == "ties":
        x = rng.integers(0, 2, (n, width))
    rows = [(int(i * 3 % 401), None if i % 3 == 0 else "ab"[i % 2], tuple(v)) for i, v in enumerate(x.tolist())]
    rows += [rows[0], rows[5], (None, "a", rows[1][2])]
    got, books = vector_codes.encode(table_of(spark, rows), parts=2, size=20, rounds=3, scale=16)
    near, error, want_books = brute_codes(rows, 2, 20, 3)
    assert (books == want_books).all()
    by_label = {}
    for (_, label, _), e in zip(rows, error.tolist()):
        by_label[label] = by_label.get(label, 0) + e
    want = [(i, f"{a:02x}{b:02x}", e, by_label[label]) for (i, label, _), a, b, e in zip(rows, near[0], near[1], error.tolist())]
    key = lambda r: (r[0] is None, str(r))
    assert got.columns == ["vec_id", "code", "error", "label_error"]
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want, key=key)


def test_owned_balls_are_not_looked_into():
    rng = np.random.default_rng(1)
    centres = rng.integers(-10_000, 10_000, (8, 4))
    points = centres[rng.integers(0, 8, 3000)] + rng.integers(-20, 20, (3000, 4))
    tree = vector_codes.build_tree(points)
    owned, compared = vector_codes.walk(tree, centres)
    counts = tree[3][7]
    assert sum(counts[nodes].sum() for nodes, _ in owned) == 3000 and not compared
    assert sum(len(nodes) for nodes, _ in owned) < 200
    *_, start, end, _, _, total, count = tree[3]
    weighted = tree[0].astype(np.int64) * tree[1][:, None]
    assert all((weighted[s:e].sum(axis=0) == t).all() and tree[1][s:e].sum() == c for s, e, t, c in zip(start, end, total, count))


def test_balls_hold_their_points():
    rng = np.random.default_rng(2)
    points, _, place, (left, right, start, end, pivot, radius, *_) = vector_codes.build_tree(rng.integers(-50, 50, (700, 3)))
    for s, e, p, r in zip(start, end, pivot, radius):
        assert ((points[s:e] - p) ** 2).sum(axis=1).max() <= r * r * (1 + 1e-9) + 1e-9
    assert (start[left[left >= 0]] == start[left >= 0]).all() and (end[right[right >= 0]] == end[right >= 0]).all()


def test_vectors_that_take_no_part(spark):
    bad = [None, [None] * 4, [1.0, None, 0.0, 0.0], [float("nan")] * 4, [float("inf"), 0.0, 0.0, 0.0], []]
    rows = [(i, None, v) for i, v in enumerate(bad)] + [(9, 1, [0.5, 0.25, -0.5, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    got, books = vector_codes.encode(df)
    assert [tuple(r) for r in got.collect()] == [(9, "00000000", 0, 0)] and books.tolist() == [[[512]], [[256]], [[-512]], [[0]]]
    for empty in (df.limit(0), df.filter("vec_id < 9")):
        assert vector_codes.encode(empty)[0].count() == 0
    with pytest.raises(Exception, match="too large"):
        vector_codes.encode(spark.createDataFrame([(1, 1, [1e30] * 4)], df.schema))[0].count()


# sketches ---------------------------------------------------------------------------------
def brute_sketch(text, words=5, one_in=8):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    grams = [" ".join(w[i : i + words]) for i in range(max(len(w) - words + 1, 1))] if w else []
    hashes = {hashlib.md5(g.encode()).hexdigest()[:12] for g in grams}
    return sorted(h for h in hashes if int(h, 16) < 16**12 // one_in) or sorted(hashes)[:1]


def brute_jaccard(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 1.0


def test_sketches_and_neighbours_match_brute_force(docs, spark):
    rows = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    got = {r.doc_id: r for r in scaled_sketch.compare_edits(rows).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    texts = {r.doc_id: r.text or "" for r in rows.collect()}
    ids = sorted(texts)
    assert sorted(got) == ids
    for i, following in zip(ids, ids[1:] + ids[:1]):
        t, cut = texts[i], len(texts[i]) // 4
        edited = t[: len(t) - cut] + texts[following][:cut]
        r = got[i]
        assert (r.text, r.edited) == (t, edited)
        assert (r.sketch, r.edited_sketch, r.next_sketch) == tuple(brute_sketch(x) for x in (t, edited, texts[following]))


def test_repeated_rows_and_null_ids_each_have_a_next_document(docs):
    got = scaled_sketch.compare_edits(docs).collect()
    assert len(got) == docs.count()
    first = [r for r in got if r.doc_id is None]
    assert len(first) == 1 and first[0].next_sketch == brute_sketch("")
    assert [r.next_sketch for r in got if r.doc_id == 49] == [brute_sketch("no id here")]
    # of two rows with one id, one is followed by the other
    assert sorted(r.next_sketch == brute_sketch("abc def") for r in got if r.doc_id == 3) == [False, True]


def test_small_tables_of_sketches(spark):
    one = spark.createDataFrame([(7, "a b c d e f g h")], "doc_id long, text string")
    r = scaled_sketch.compare_edits(one).first()
    assert r.edited == "a b c d e f" + " " + "a b"
    assert r.next_sketch == r.sketch
    assert scaled_sketch.compare_edits(one.limit(0)).count() == 0


def test_merging_and_containment(spark):
    words = [f"w{i}" for i in range(3000)]
    whole, part = " ".join(words), " ".join(words[1000:1400])
    s = scaled_sketch.Sketch()
    df = spark.createDataFrame([(whole, part, "just three words", " ".join(words[:1500]), " ".join(words[1496:]))], "a string, b string, c string, p string, q string")
    a, b, c, p, q = (s.of(F.col(x)) for x in "abcpq")
    got = df.select(
        scaled_sketch.containment(b, a).alias("inside"),
        scaled_sketch.containment(a, b).alias("around"),
        (s.merged(p, q) == a).alias("merged"),
        (s.merged(a, c) == a).alias("short_one_lost"),
        (s.merged(c, c) == c).alias("itself"),
        F.size(a).alias("n"),
    ).first()
    assert got.inside == 1.0 and abs(got.around - 396 / 2996) < 0.05 and got.merged and got.itself
    assert got.short_one_lost or brute_sketch("just three words")[0] < s.threshold
    assert abs(got.n - 2996 / 8) < 80
    folded = s.merged_rows(df.select(F.lit(1).alias("g"), F.explode(F.array(p, q, c)).alias("s")), ["g"], "s")
    assert folded.first().sketch == df.select(s.merged(p, q, c)).first()[0]


def test_likeness_follows_the_true_likeness(spark, sf_dir):
    got = QUERIES["op13_scaled_sketch"](spark, sf_dir).collect()
    long = [r for r in got if r.n_chars > 1500]
    # a document's next one may be its copy, and one of repeated lines has few shingles
    assert long and sum(r.near_edited > r.near_next for r in long) >= 0.95 * len(long)
    assert abs(np.mean([r.near_edited for r in long]) - 0.6) < 0.1


def test_native_sketch_has_no_python_node(spark, sf_dir):
    plan = op13(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_queries_name_their_columns(spark, sf_dir):
    assert op11(spark, sf_dir).columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert op12(spark, sf_dir).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
