"""The training-data operators against brute force, and on nulls, empty and repeated rows."""

import hashlib
import json
import os
import re
import subprocess
import sys
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

os.environ["TOKENIZERS_PARALLELISM"] = "false"
import public_tokenizers

from loomframe.core.session import new_path
from loomframe.llm import byte_bpe, embedding_dedup, hilbert, jaccard_join, language_id, length_buckets, license_scan
from loomframe.llm import token_binary, topk_search, toxicity
from loomframe.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string"
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls everywhere, empty, blank and very long texts, repeated rows, columns with clashing names."""
    texts = ["", " \n\t", None, "one", "One  ONE one", "a b c d e f g h", "A b c d e f g h", LONG, LONG + " tail", "das ist gut und schön", "12 34 !!", "<|endoftext|> x"]
    rows = [(i, t, "en" if i % 2 else None, None, None, 0.5, "x") for i, t in enumerate(texts)]
    rows += [(3, "one", "en", None, None, 0.5, "x"), (None, "null id", None, None, None, None, None), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


def shingles(text, words):
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    w = re.findall(rb"[^\x20\x09-\x0D]+", low)
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < words else [tuple(w[i : i + words]) for i in range(len(w) - words + 1)])


def brute_components(texts, words, percent):
    sets = {i: shingles(t, words) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    shared = defaultdict(int)
    holders = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            for j in holders[g]:
                shared[j, i] += 1
            holders[g].append(i)
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_copies(n=60, seed=3):
    rng = np.random.default_rng(seed)
    words = [f"v{i}" for i in range(300)]
    out = {}
    for i in range(n):
        base = np.random.default_rng(i % 7).choice(words, 12 + 9 * (i % 7)).tolist()
        for _ in range(rng.integers(0, 4)):
            base[rng.integers(len(base))] = f"z{rng.integers(1000)}"
        out[i] = " ".join(base)
    return out


@pytest.mark.parametrize("words,percent", [(4, 85), (5, 80)])
def test_jaccard_matches_brute_force(spark, words, percent):
    texts = near_copies()
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(rows, words=words, percent=percent).collect()}
    assert got == brute_components(texts, words, percent)


def test_jaccard_long_lists_are_dealt_in_blocks(spark, monkeypatch):
    """Lists of many blocks, none of whose sets need be neighbours: no link between components is lost."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 3)
    monkeypatch.setattr(jaccard_join, "REACH", 1)
    texts = near_copies(90, seed=5)
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(rows).collect()}
    assert got == brute_components(texts, 4, 85)


def passages_of_a_pool(n, seed=1):
    """Documents of 26 passages out of 40: every shingle is common and next to nothing links."""
    rng = np.random.default_rng(seed)
    pool = [" ".join(f"p{i}w{j}" for j in range(20)) for i in range(40)]
    return [" ".join(pool[i] for i in np.sort(rng.choice(40, 26, replace=False))) for _ in range(n)]


@pytest.mark.parametrize("reach", [4, None])
def test_jaccard_common_passages_propose_next_to_nothing(reach):
    texts = passages_of_a_pool(400) + [passages_of_a_pool(1)[0] + " and a tail"]
    sets = [r for b in jaccard_join._describe(4)([pa.RecordBatch.from_arrays([pa.array(range(401)), pa.array(texts)], ["a", "b"])]) for r in b.to_pylist()]
    sets = sorted((r for r in sets if r["kind"] == 0), key=lambda r: (r["n"], r["doc_id"]))
    n = [r["n"] for r in sets]
    ids = list(range(len(n)))
    columns = [[7] * len(n), [0] * len(n), [0] * len(n), ids, n, n, ids]
    batch = pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array([r["brief"] for r in sets])], list("abcdefgh"))
    # one list in two batches, as a task may get it
    found = [tuple(p.values()) for b in jaccard_join._compare(85, reach)(iter([batch.slice(0, 150), batch.slice(150)])) for p in b.to_pylist()]
    exact = [shingles(texts[r["doc_id"]], 4) for r in sets]
    links = {(a, b) for b in ids for a in range(b) if 100 * len(exact[a] & exact[b]) >= 85 * len(exact[a] | exact[b])}
    assert len(found) <= 8 < len(n)
    if reach is None:
        assert links and links <= set(found)


def test_jaccard_bitmaps_fold_to_one_width():
    for size in (1, 900, 5000):
        members = np.unique(np.random.default_rng(size).integers(0, 1 << 63, size, dtype=np.uint64))
        assert len(jaccard_join._parity(members)) * 8 % jaccard_join.BRIEF == 0


def test_jaccard_edges(spark, docs):
    rows = jaccard_join.jaccard_components(docs).collect()
    assert len(rows) == docs.count()
    got = defaultdict(set)
    for r in rows:
        got[r.doc_id].add((r.n_shingles, r.component_id))
    assert got[0] == {(0, 0)} and got[1] == {(0, 1)} and got[2] == {(0, 2)}
    assert got[3] == {(1, 3)} and got[6] == {(5, 5)} and {c for _, c in got[None]} == {None}
    assert {c for _, c in got[8]} == {7}
    kept = jaccard_join.keep_one_of_each(docs, jaccard_join.jaccard_components(docs))
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [0, 1, 2, 3, 4, 5, 7, 9, 10, 11] and ids.count(None) == 2
    assert jaccard_join.jaccard_components(docs.limit(0)).count() == 0


def test_boundary_takes_the_cheaper_side():
    counts = np.ones(jaccard_join.COUNTERS, np.int64)
    assert jaccard_join.boundary({}, counts, 85) == 0
    cut = jaccard_join.boundary({10: 5, 1000: 5}, counts, 85)
    assert cut <= 1000


def test_viterbi_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(20):
        k, lengths = int(rng.integers(1, 5)), rng.integers(0, 130, 5)
        scores = rng.normal(0, 3, (lengths.sum(), k))
        labels = language_id.viterbi(scores, np.cumsum(lengths), 2.0)
        at = 0
        for n in lengths:
            s, z = scores[at : at + n], labels[at : at + n]
            at += n
            if n:
                v = s[0].copy()
                for row in s[1:]:
                    v = np.maximum(v, v.max() - 2.0) + row
                assert abs(s[np.arange(n), z].sum() - 2.0 * (z[1:] != z[:-1]).sum() - v.max()) < 1e-4


def test_language_spans_and_edges(spark, docs):
    train = [(i, t, lang) for i, (t, lang) in enumerate([("the house and the garden of the king", "en"), ("das haus und der garten des königs", "de"), ("дом и сад", "ru")] * 5)]
    model = language_id.fit_languages(spark.createDataFrame(train, "doc_id long, text string, lang string"), "doc_id", "text", "lang")
    mixed = "the king and the house " * 6 + "das haus und der garten " * 6
    names, score, spans, _ = language_id.label_texts(pa.array([mixed, "", "сад", "漢字", "1 2"], pa.large_string()), model)
    assert names[1] is None and names[2] == "ru" and names[3] in model.languages and names[4] is None
    assert [s[2] for s in spans[0]] == ["en", "de"] and 0 <= score.min() and score.max() <= 1
    out = language_id.identify(docs, model)
    assert out.columns == [*docs.columns, "lang_pred", "_score", "_spans", "foreign"] and out.count() == docs.count()
    assert {r.lang_pred for r in out.filter("text is null or text = '' or doc_id = 10").collect()} == {"und"}
    kept = language_id.keep_identified(docs, model, 0.25)
    assert kept.columns == docs.columns
    nothing = language_id.fit_languages(docs.limit(0), "doc_id", "text", "lang")
    assert {r.lang_pred for r in language_id.identify(docs, nothing).collect()} == {"und"}


def test_language_held_out_accuracy(spark, sf_dir):
    found = QUERIES["op3_language_id"](spark, sf_dir).filter("held_out").join(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")
    total, right = found.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert total and right >= 0.95 * total


@pytest.mark.parametrize("k", [3, 4, 5])
def test_unlearned_scripts_are_undetermined(spark, k):
    """Whatever the number of learned languages, a text in a script of none of them goes."""
    texts = ["the house and the garden", "das haus und der garten", "la maison et le jardin", "la casa y el huerto", "huset og hagen deres"][:k]
    learned = spark.createDataFrame([(i, t * 20, f"l{i}") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    model = language_id.fit_languages(learned, "doc_id", "text", "lang")
    assert len(model.languages) == k
    rows = [(1, "今天天气很好我们去公园"), (2, "сегодня хорошая погода"), (3, "the house 今天天气很好我们去公园散步吧"), (4, "the house and the garden 今天"), (5, "the garden"), (6, "12")]
    mixed = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in language_id.keep_identified(mixed, model, 0.25).collect()} == {4, 5}
    got = {r.doc_id: r for r in language_id.identify(mixed, model).collect()}
    # ``und`` is for texts without letters; others get a learned language, and the share of letters that tell nothing
    assert (got[6].lang_pred, got[6].score, got[6].foreign) == ("und", 0.0, 0.0)
    assert all(got[i].lang_pred in model.languages for i in (1, 2, 3, 4, 5))
    assert got[1].foreign == got[2].foreign == 1.0 and 0.5 < got[3].foreign < 1 and 0 < got[4].foreign < 0.5 and got[5].foreign == 0


def test_toxicity(spark, docs):
    good, bad = "the quiet river runs along the meadow", "you are a zzgarble fool zzgarble"
    rows = [(i, (bad if i % 5 == 0 else good) + f" n{i}") for i in range(200)]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(0, 200, 2)] + [(1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(texts, labels)
    scored = toxicity.score(texts, model).collect()
    assert all((r.score >= 0.5) == (r.doc_id % 5 == 0) for r in scored)
    edge = toxicity.score(docs, model)
    assert edge.columns == [*docs.columns, "_score"] and all(0 <= r._score <= 1 for r in edge.collect())
    assert toxicity.drop_toxic(texts, model).count() == 160 and toxicity.drop_toxic(docs, model).columns == docs.columns
    none = toxicity.fit_toxicity(texts, labels.limit(0))
    assert max(r.score for r in toxicity.score(texts, none).collect()) < 1e-9


def test_toxicity_grams_by_brute_force():
    texts = ["Ab cd", "", "é-éa!", "x" * 9]
    model = toxicity.ToxicityModel(np.zeros(toxicity.BUCKETS, np.float32), 0.0)
    counts = defaultdict(int)
    for text, _ in toxicity.grams(pa.array(texts, pa.large_string())):
        for t in text.tolist():
            counts[t] += 1
    want = {}
    for t, s in enumerate(texts):
        folded = " " + re.sub(r"[\W_]+", " ", s.lower()).strip() + " " if re.search(r"\w", s) else " "
        want[t] = sum(" " not in folded[i + 1 : i + n - 1] for n in toxicity.SIZES for i in range(len(folded) - n + 1))
    assert {t: counts[t] for t in want} == want
    assert toxicity.score_texts(pa.array(texts, pa.large_string()), model).tolist() == [0.5] * 4


def test_length_bounds_are_optimal():
    import itertools

    rng = np.random.default_rng(2)
    for _ in range(10):
        top = np.unique(rng.integers(1, 60, 7))
        n = rng.integers(1, 9, len(top))
        for k in (1, 2, 3):
            cost = lambda bounds: sum(c * (min(b for b in bounds if b >= t) - t) for t, c in zip(top.tolist(), n.tolist()))
            best = min(cost([*c, int(top[-1])]) for r in range(k) for c in itertools.combinations(top[:-1].tolist(), r))
            assert cost(length_buckets.best_bounds(top, n, k)) == best


def test_long_length_bounds_are_optimal(spark):
    rng = np.random.default_rng(9)
    lengths = np.concatenate((rng.integers(300, 3000, 400), rng.integers(1, 40, 300), np.full(350, 777), [60_000]))
    top, n = np.unique(lengths, return_counts=True)
    for k in (1, 4, 16):
        # least padding of the first j lengths in at most k buckets, all splits tried
        best = np.concatenate(([0], np.full(len(top), 1 << 60)))
        for _ in range(k):
            cost = lambda i, j: int(best[i]) + int((n[i:j] * (top[j - 1] - top[i:j])).sum())
            best = np.array([0, *(min(int(best[j]), min(cost(i, j) for i in range(j))) for j in range(1, len(top) + 1))])
        bounds = length_buckets.best_bounds(top, n, k)
        assert len(bounds) <= k
        assert sum(min(b for b in bounds if b >= x) - x for x in lengths.tolist()) == best[-1]
        if k == 16:
            rows = length_buckets.pack(spark.createDataFrame([(i, x) for i, x in enumerate(lengths.tolist())], "slot long, n long"), "slot", "n")
            assert sorted(rows.columns) == ["batch", "bound", "bucket", "id", "n", "padding", "slot"]
            assert rows.agg({"padding": "sum"}).first()[0] == best[-1]
    assert length_buckets.best_bounds(np.full(1, 5), np.full(1, 3), 4) == [5] and length_buckets.best_bounds(top[:0], n[:0], 4) == []


def test_packing(spark, docs):
    lengths = docs.select("doc_id", length_buckets.word_count("text").alias("n"))
    rows = length_buckets.pack(lengths, "doc_id", "n", buckets=3, budget=64).collect()
    assert len(rows) == docs.count() and all(r.bound >= r.n and r.padding == r.bound - r.n for r in rows)
    batches = defaultdict(list)
    for r in rows:
        batches[r.bucket, r.batch].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in batches.values())
    assert all(len(s) <= max(1, 64 // next(r.bound for r in rows if (r.bucket, r.batch) == k)) for k, s in batches.items())
    assert length_buckets.pack(lengths.limit(0), "doc_id", "n").count() == 0


def odd_texts():
    rng = np.random.default_rng(5)
    fixed = ["", "  a  b ", "x<|endoftext|>y <|ENDOFTEXT|>", "It's  don't\n\n we'll", "é́ İ ſ 你好, 世界. 😀 \u0085 x", "Étude. ÉTÉ.", "a" * 300, "ab" * 99]
    return fixed + ["".join(rng.choice(list("ab \n't.<|éÉ́你😀1,"), rng.integers(1, 80))) for _ in range(150)]


def test_byte_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    path, texts = public_tokenizers.path("byte_bpe_50k.json"), odd_texts()
    rows = spark.createDataFrame([*enumerate(texts), (None, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in byte_bpe.round_trip(rows, path, public_tokenizers.PATTERN).collect()}
    plain = Tokenizer.from_file(path)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, t in enumerate(texts):
        ids = plain.encode(t, add_special_tokens=False).ids
        want = len(ids), sha(",".join(map(str, ids))), sha(plain.decode(ids, skip_special_tokens=False))
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == want, repr(t)
    assert got[None].n_tokens == 0
    both = byte_bpe.decode(byte_bpe.encode(rows, path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN)
    assert all(r.decoded == (r.text or "") for r in both.collect())


def test_token_files_round_trip(spark, docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    extra = spark.createDataFrame([(100 + i, t) for i, t in enumerate(odd_texts())], "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionByName(extra)
    out = new_path(spark, "tokens")
    token_binary.write_tokens(rows, path, out, end=1)
    got = sorted(token_binary.read_tokens(spark, out).collect(), key=lambda r: r.start)
    want = defaultdict(list)
    for r in rows.collect():
        want[r.doc_id].append(plain.encode(r.text or "", add_special_tokens=False).ids + [1])
    at = 0
    for r in got:
        assert r.start == at and list(r.ids) in want[r.doc_id]
        want[r.doc_id].remove(list(r.ids))
        at += len(r.ids)
    assert not any(want.values())
    order = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert order == sorted(order)
    crc = {r.start: r.ids_crc32 for r in token_binary.token_digests(spark, out).collect()}
    assert all(crc[r.start] == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)
    empty = new_path(spark, "tokens")
    token_binary.write_tokens(docs.limit(0), path, empty, end=1)


def test_rank_code():
    ranks = np.array([0, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1, 7], np.uint32)
    control, data = token_binary.pack_ranks(ranks)
    assert len(control) == 3 and len(data) == 1 + 1 + 2 + 2 + 3 + 3 + 4 + 4 + 1
    assert token_binary.unpack_ranks(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), 9).tolist() == ranks.tolist()


def test_hilbert_steps_are_neighbours():
    for d, bits in ((2, 3), (3, 2)):
        grid = np.array(np.meshgrid(*[np.arange(1 << bits)] * d)).reshape(d, -1).T
        at = hilbert.hilbert_index(grid, bits)
        assert sorted(at.tolist()) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[np.argsort(at)], axis=0)).sum(axis=1) == 1).all()


def test_shards(spark, docs):
    rows = docs.select("doc_id", "text")
    for source in (rows, rows.limit(0)):
        out = hilbert.shard_by_curve(source, {"size": F.length("text"), "id": F.col("doc_id")}, ["doc_id"], shards=4, bits=4)
        counts = defaultdict(list)
        for r in out.collect():
            counts[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in counts.values())
        sizes = [len(counts[i]) for i in range(4)]
        assert sum(sizes) == source.count() and max(sizes) - min(sizes) <= 1
    ranges = hilbert.shard_ranges(out, ["id"])
    assert hilbert.shards_to_read(ranges, {"id": (0, 5)}).count() == 0


def vectors():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(120, 8))
    x[40:60] = x[:20] + rng.normal(scale=0.05, size=(20, 8))
    x[60:64] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(200, None), (201, [None] * 8), (202, [float("nan")] * 8), (203, [0.0] * 8), (204, [1.0, 2.0]), (205, []), (None, [1.0] * 8), (3, x[3].tolist())]
    return rows


def test_top_k_is_exact(spark):
    rows = spark.createDataFrame(vectors(), "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in topk_search.top_k(rows, "vec_id", "embedding", F.col("vec_id") % 10 == 0, k=5).collect():
        got[r.query_id].append((r.rank, r.id, r.score))
    fine = {i: np.floor(1024 * np.array(v)).astype(int) for i, v in vectors() if i is not None and v and all(c is not None and np.isfinite(c) for c in v)}
    for q in (i for i in fine if i % 10 == 0):
        scores = sorted((-int(fine[q] @ v), i) for i, v in fine.items() if i != q and len(v) == len(fine[q]))[:5]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    assert topk_search.top_k(rows.limit(0), "vec_id", "embedding", F.lit(True)).count() == 0


def test_top_k_stops_early_and_stays_exact():
    rng = np.random.default_rng(4)
    x = rng.integers(-1000, 1000, (3000, 3))
    x[:5] *= 50
    block = topk_search.Block(np.arange(3000), x)
    q = x[0]
    ids, scores = block.best(q, 0, 4, -(2.0**60))
    exact = x @ q
    exact[0] = -(2**60)
    assert ids.tolist() == np.lexsort((np.arange(3000), -exact))[:4].tolist()


def test_embedding_links(spark):
    rows = spark.createDataFrame(vectors(), "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(rows, "vec_id", "embedding").collect()}
    fine = {i: np.array(v) for i, v in vectors() if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)}
    unit = {i: v / np.linalg.norm(v) for i, v in fine.items()}
    links = {i: [j for j in unit if j != i and len(unit[j]) == len(unit[i]) and unit[i] @ unit[j] >= 0.9] for i in unit}
    assert {i: got[i].n_links for i in links} == {i: len(x) for i, x in links.items()}
    for i in links:
        reach, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in reach:
                    reach.add(j), todo.append(j)
        assert got[i].component_id == min(reach) and got[i].kept == (i == min(reach))
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in (200, 201, 202, 203, 205))
    assert got[None].component_id is None
    assert embedding_dedup.near_duplicates(rows.limit(0), "vec_id", "embedding").count() == 0


@pytest.mark.parametrize("prefix", [None, 5])
def test_embedding_links_in_a_dense_region(spark, prefix):
    """A third of the rows in a cone where almost only the planted pairs link: the region does not cost recall."""
    rng = np.random.default_rng(12)
    n, width = 6000, 256
    x = rng.normal(size=(n, width))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    axis = x[0].copy()
    x[: n // 3] = np.sqrt(0.8) * axis + np.sqrt(0.2) * x[: n // 3]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(0, 600, 2):
        away = rng.normal(size=width)
        away -= (away @ x[i]) * x[i]
        x[i + 1] = 0.92 * x[i] + np.sqrt(1 - 0.92**2) * away / np.linalg.norm(away)
    cosines = x @ x.T
    np.fill_diagonal(cosines, 0)
    links = (cosines >= 0.9).sum(axis=1)
    assert 600 <= links.sum() < 1200
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(rows, "vec_id", "embedding", **({"prefix": prefix} if prefix else {})).collect()}
    found = sum(got.values()) / links.sum()
    assert all(got[i] <= links[i] for i in range(n)) and found >= 0.98


def test_code_length_follows_density():
    uniform = {p: 2.0**-p for p in range(41)}
    dense = {p: max(2.0**-p, 0.1 * 0.9**p) for p in range(41)}
    assert embedding_dedup.cheapest_prefix(3000, uniform, 0.9, 0.99) == 0
    few, more = (embedding_dedup.cheapest_prefix(n, uniform, 0.9, 0.99) for n in (100_000, 10_000_000))
    assert 0 < few < more
    assert embedding_dedup.cheapest_prefix(10_000_000, dense, 0.9, 0.99) != more
    assert embedding_dedup.passes_for(0, 0.9, 0.99) == 1


def test_licences(spark):
    files = [
        ("a/LICENSE", "Released under the MIT License."),
        ("a/b/x.py", "import os\nLicensed under the Apache License, Version 2.0.\n"),
        ("a/b/y.py", "nothing here"),
        ("a/b/c/z.py", None),
        ("a/b/c/COPYING", "This work is licensed under the GNU General Public License, version 3."),
        ("q/w.py", ""),
        (None, "Released under the MIT License."),
    ]
    rows = spark.createDataFrame(files, "path string, text string")
    got = {r.path: (r.license, r.origin, r.from_path) for r in license_scan.scan(rows).collect()}
    assert got["a/b/x.py"] == ("Apache-2.0", "own", "a/b/x.py")
    assert got["a/b/y.py"] == ("MIT", "inherited", "a/LICENSE")
    assert got["a/b/c/z.py"] == ("GPL-3.0", "inherited", "a/b/c/COPYING")
    assert got["q/w.py"] == (None, None, None) and len(got) == 6
    assert license_scan.scan(rows.limit(0)).count() == 0


def test_licence_lines_keep_their_score_in_a_larger_table(spark):
    """A header with a word that most files have is found in a table of any size, with nearly the same score."""
    header = "# File released under the MIT License, see the file."
    scores = []
    for n in (200, 20_000):
        other = spark.range(n).select(F.concat(F.lit("d/"), "id").alias("path"), F.expr("if(id % 2 = 0, 'some file and see the like', 'words')").alias("text"))
        licensed = spark.range(n // 100).select(F.concat(F.lit("m/"), "id").alias("path"), F.lit(header).alias("text"))
        got = license_scan.scan(other.unionByName(licensed)).filter("path = 'm/0'").first()
        assert got.license == "MIT"
        scores.append(got.score)
    assert abs(scores[0] - scores[1]) < 0.01


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, sf_dir)
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = [r.doc_id for r in out.collect()]
    assert len(ids) == len(set(ids)) and 0 < len(ids) < documents.count()
    kept = corpus_pipeline.near_duplicates(spark, documents, sf_dir)
    texts = {r.doc_id: r.text for r in documents.collect()}
    assert {r.doc_id for r in kept.collect()} == {i for i, (_, c) in brute_components(texts, 5, 80).items() if i == c}
    assert json.dumps([name for name, _ in corpus_pipeline.STAGES]) == '["language", "toxicity", "near_duplicates", "packing"]'


def test_models_reach_workers_that_lack_the_package(tmp_path):
    """Scoring in a session whose Python workers can't import the package."""
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    script = f"""
import sys
sys.path.insert(0, {repo!r})
import __spark_entry__ as entry
from loomframe.core.session import build_session
spark = build_session(2, spark__checkpoint__dir={str(tmp_path / "shared")!r})
def absent(_):
    import importlib.util
    yield importlib.util.find_spec("loomframe") is None
assert all(spark.sparkContext.parallelize([1], 1).mapPartitions(absent).collect())
for name in ("op3_language_id", "op8_toxicity"):
    assert entry.queries()[name](spark, "/root/testdata/sf0.001").count() == 200
print("scored")
spark.stop()
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "scored" in run.stdout, run.stderr[-3000:]


def test_very_long_licence_line(spark):
    line = "Released under the MIT License. " + " ".join(f"t{i}" for i in range(150_000))
    files = spark.createDataFrame([("a/LICENSE", line), ("a/b.txt", "x"), ("c/d.txt", "Released under the MIT License.")], "path string, text string")
    got = {r.path: (r.license, r.origin) for r in license_scan.scan(files).collect()}
    assert got == {"a/LICENSE": (None, None), "a/b.txt": (None, None), "c/d.txt": ("MIT", "own")}
