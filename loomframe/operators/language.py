"""Vocabularies, word pieces and pre-training examples over token tables."""

from __future__ import annotations

import os
import tempfile
from collections import Counter, defaultdict
from collections.abc import Iterable, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from loomframe.core import skew
from loomframe.core.keyed import HASH_BITS, digest_numbers, keyed_hash, keyed_uniform
from loomframe.core.order import random_rank, row_index
from loomframe.core.session import materialize
from loomframe.operators.joins import lookup_join
from loomframe.operators.topk import topk_rows


def build_vocabulary(
    tokens: DataFrame,
    min_frequency: int = 10,
    reserved: Sequence[str] = (),
    unknown: str = "<unk>",
    reached_by: Sequence[str] = (),
) -> DataFrame:
    """(token, index), dense: reserved tokens, the unknown token, then frequent ones.

    By default the frequent tokens follow by falling count, ties by token. With
    ``reached_by`` (a unique order key of the token rows) they follow in the
    order in which they reach the minimum frequency.
    """
    fixed = list(dict.fromkeys([*reserved, unknown]))
    spark = tokens.sparkSession
    open_tokens = tokens.filter(~F.col("token").isin(fixed))
    if reached_by:
        # the n-th occurrence per token: at most n rows per token and task are shuffled
        kept = topk_rows(open_tokens, ["token"], list(reached_by), min_frequency, "_nth")
        frequent = kept.filter(F.col("_nth") == min_frequency).select("token", *reached_by)
        order = list(reached_by)
    else:
        counts = open_tokens.groupBy("token").agg(F.count("*").alias("n"))
        frequent = counts.filter(F.col("n") >= min_frequency).withColumn("_falling", -F.col("n"))
        order = ["_falling", "token"]
    numbered = row_index(frequent, order, "_i").select("token", (F.col("_i") + len(fixed)).alias("index"))
    head = spark.createDataFrame(list(zip(fixed, range(len(fixed)))), "token string, index long")
    return materialize(head.unionByName(numbered), "vocabulary")


def _ship_pieces(pieces: DataFrame):
    """The pieces as a set, and the length of the longest, in every task."""
    known = {row.token for row in pieces.collect()}
    return pieces.sparkSession.sparkContext.broadcast((known, max(map(len, known), default=0)))


def _walk(word: str, known: set[str], longest: int, unknown: str, max_chars: int) -> list[str]:
    out, at, n = [], 0, len(word)
    if n > max_chars:
        return [unknown]
    while at < n:
        mark = "##" if at else ""
        for end in range(min(n, at + longest), at, -1):
            piece = mark + word[at:end]
            if piece in known:
                break
        else:
            return [unknown]
        out.append(piece)
        at = end
    return out


def wordpiece(tokens: DataFrame, vocabulary: DataFrame, unknown: str = "[UNK]", max_chars: int = 200) -> DataFrame:
    """(token, pieces) for the distinct tokens: greedy longest match from the left.

    A vocabulary of at most ``skew.BROADCAST_BYTES`` (counted) goes to the tasks
    as a set; a larger one is never copied, see ``wordpiece_join``.
    """
    pieces = materialize(vocabulary.select("token").distinct(), "pieces")
    if not skew.fits_broadcast(pieces):
        return wordpiece_join(tokens, pieces, unknown, max_chars)
    shipped = _ship_pieces(pieces)

    @F.pandas_udf("array<string>")
    def split(words: pd.Series) -> pd.Series:
        return words.map(lambda word: _walk(word, *shipped.value, unknown, max_chars))

    distinct = tokens.select("token").distinct()
    return distinct.withColumn("pieces", split("token"))


def wordpiece_join(tokens: DataFrame, vocabulary: DataFrame, unknown: str = "[UNK]", max_chars: int = 200) -> DataFrame:
    """The same with a vocabulary of any size.

    Candidate pieces are found by one join of the substrings of the distinct
    tokens with the vocabulary; the greedy walk over the longest match at each
    start is an expression.
    """
    longest = vocabulary.agg(F.max(F.length("token"))).scalar()
    distinct = tokens.select("token").distinct().withColumn("_n", F.length("token"))
    spans = (
        distinct.filter((F.col("_n") <= max_chars) & (F.col("_n") > 0))
        .withColumn("start", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
        .withColumn("end", F.explode(F.sequence(F.col("start") + 1, F.least(F.col("_n"), F.col("start") + longest))))
    )
    text = F.substring(F.col("token"), F.col("start") + 1, F.col("end") - F.col("start"))
    piece = F.when(F.col("start") > 0, F.concat(F.lit("##"), text)).otherwise(text)
    found = spans.withColumn("piece", piece).join(vocabulary.select(F.col("token").alias("piece")), "piece", "left_semi")
    per_start = found.groupBy("token", "start").agg(F.max("end").alias("end"))
    # at most max_chars entries per token
    walks = per_start.groupBy("token").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_steps"))
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def advance(acc, step):
        body = F.substring(F.col("token"), step["start"] + 1, step["end"] - step["start"])
        part = F.when(step["start"] > 0, F.concat(F.lit("##"), body)).otherwise(body)
        taken = F.struct(step["end"].alias("at"), F.array_append(acc["out"], part).alias("out"))
        return F.when(step["start"] == acc["at"], taken).otherwise(acc)

    walked = walks.withColumn("_w", F.aggregate("_steps", state, advance))
    complete = walked.filter(F.col("_w.at") == F.length("token")).select("token", F.col("_w.out").alias("pieces"))
    return (
        distinct.select("token", "_n")
        .join(complete, "token", "left")
        .select(
            "token",
            F.when(F.col("_n") == 0, F.array().cast("array<string>"))
            .otherwise(F.coalesce("pieces", F.array(F.lit(unknown))))
            .alias("pieces"),
        )
    )


def pieces_in_order(tokens: DataFrame, pieces: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, pos, piece): token rows replaced by their pieces, renumbered per key."""
    joined = lookup_join(tokens, materialize(pieces, "pieces"), "token", "inner")
    lists = joined.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("pos", "pieces"))).alias("_l"))
    flat = F.flatten(F.transform("_l", lambda s: s["pieces"]))
    return lists.select(*key, flat.alias("tokens"))


#: Documents whose tokens a task splits at a time, and distinct words whose pieces it remembers.
SPLIT_ROWS, SPLIT_WORDS = 512, 1 << 18


def wordpiece_lists(
    lists: DataFrame, key: Sequence[str], vocabulary: DataFrame, unknown: str = "[UNK]", max_chars: int = 200
) -> DataFrame:
    """(key, tokens) with all words of each list replaced by their pieces: what ``wordpiece`` and ``pieces_in_order`` make of its rows.

    A vocabulary of at most ``skew.BROADCAST_BYTES`` (counted) goes to the tasks, and
    words become pieces where their list is: no word is moved. Lists of one key, which are merged
    by position, and those of a larger vocabulary go through the two operators.
    """
    key = list(key)
    pieces = materialize(vocabulary.select("token").distinct(), "pieces")
    lists = lists.select(*key, "tokens")

    def by_rows(some: DataFrame) -> DataFrame:
        rows = some.select(*key, F.posexplode("tokens").alias("pos", "token"))
        return pieces_in_order(rows, wordpiece(rows, pieces, unknown, max_chars), key)

    if not skew.fits_broadcast(pieces):
        return by_rows(lists)
    shipped = _ship_pieces(pieces)

    def split(words: pa.ListArray, seen: dict[str, list[str]]) -> pa.ListArray:
        encoded = words.flatten().dictionary_encode()
        if len(seen) > SPLIT_WORDS:
            seen.clear()
        found = []
        for word in encoded.dictionary.to_pylist():
            if word not in seen:
                seen[word] = _walk(word, *shipped.value, unknown, max_chars)
            found.append(seen[word])
        taken = pa.array(found, pa.list_(pa.string())).take(encoded.indices)
        ends = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(taken), 0).to_numpy())))
        starts = np.concatenate(([0], np.cumsum(pc.list_value_length(words).to_numpy())))
        return pa.ListArray.from_arrays(pa.array(ends[starts].astype(np.int32)), taken.flatten())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        seen: dict[str, list[str]] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, SPLIT_ROWS):
                part = batch.slice(start, SPLIT_ROWS)
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in key], split(part.column("tokens"), seen)], [*key, "tokens"])

    def in_place(some: DataFrame) -> DataFrame:
        return some.filter(F.size("tokens") > 0).mapInArrow(run, lists.schema)

    counted = lists.groupBy(*key).agg(F.count("*").alias("_n")).filter("_n > 1")
    again = materialize(counted.select(*[F.col(k).alias(f"_again_{k}") for k in key]), "repeated")
    if again.isEmpty():
        return in_place(lists)
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_again_{k}")) for k in key])
    return in_place(lists.join(again, same, "left_anti")).unionByName(by_rows(lists.join(again, same, "left_semi")))


#: Pairs that a task sorts at a time.
PAIR_ROWS = 1 << 16


def next_sentence_pairs(pairs: DataFrame, key: Sequence[str], seed) -> DataFrame:
    """Randomly couple the pairs; for half of the couples swap the first sentences.

    Columns ``first`` and ``second`` are kept, ``consecutive`` is added. A couple
    is two rows, so the grouping below is never larger. The pairs move twice: text
    to be tokenised is better tokenised afterwards.
    """
    # written once, so that counting and ranking read only the keys again
    pairs = materialize(pairs.select(*key, "first", "second"), "pairs")
    ranked = random_rank(pairs, seed, key, "_rank", bucket_rows=PAIR_ROWS)
    couple = F.floor(F.col("_rank") / 2).cast("bigint")
    rows = F.array_sort(F.collect_list(F.struct("_rank", *key, "first", "second")))
    grouped = ranked.groupBy(couple.alias("couple")).agg(rows.alias("_r"))
    swap = (keyed_uniform(f"{seed}/swap", "couple") < 0.5) & (F.size("_r") == 2)
    out = F.transform(
        "_r",
        lambda s, i: F.struct(
            *[s[k].alias(k) for k in key],
            F.when(swap, F.get("_r", 1 - i)["first"]).otherwise(s["first"]).alias("first"),
            s["second"].alias("second"),
        ),
    )
    return grouped.select("couple", (~swap).alias("consecutive"), F.inline(out))


def pretraining_sequence(a: Column, b: Column, cls: str, sep: str) -> tuple[Column, Column]:
    """Label tokens [cls] a [sep] b [sep] and their type ids."""
    label = F.concat(F.array(F.lit(cls)), a, F.array(F.lit(sep)), b, F.array(F.lit(sep)))
    first = F.size(a) + 2
    return label, F.transform(label, lambda t, i: (i >= first).cast("int"))


#: Instances a task masks at a time.
MASK_ROWS = 1024


def mask_tokens(
    df: DataFrame,
    label: str,
    key: Sequence[str],
    vocabulary: DataFrame,
    seed,
    mask: str,
    unknown_id: int,
    share: float = 0.2,
    max_masked: int = 20,
) -> DataFrame:
    """Masked instances: (key, pos, label_id, masked, masked_id), the last four arrays with an entry per token.

    A keyed hash per position picks min(share * n, max_masked) positions; a
    second one decides between the mask token (80 %), a random vocabulary token
    (10 %) and the token itself (10 %).

    A vocabulary of at most ``skew.BROADCAST_BYTES`` (counted) goes to the tasks, and no
    token becomes a row; a larger one meets the tokens in a join, see ``mask_tokens_join``.
    """
    given = df.filter(F.size(label) > 0)
    words = vocabulary.select("token", "index")
    if not skew.fits_broadcast(words):
        return mask_tokens_join(given, label, key, words, seed, mask, unknown_id, share, max_masked)
    known = words.toArrow()
    shipped = df.sparkSession.sparkContext.broadcast((known["token"].combine_chunks(), known["index"].combine_chunks().cast(pa.int64())))
    size = known.num_rows
    mask_id = pc.max(known.filter(pc.equal(known["token"], mask))["index"]).as_py()
    head = str(seed)

    def masked(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokens, ids = shipped.value
        flat = batch.column(label).flatten()
        lengths = pc.list_value_length(batch.column(label)).to_numpy()
        starts = np.cumsum(lengths) - lengths
        row = np.repeat(np.arange(len(lengths)), lengths)
        pos = np.arange(len(flat)) - starts[row]
        names = [n.encode() for n in batch.column("_name").to_pylist()]
        ends = [b":%d" % i for i in range(lengths.max(initial=0))]
        hashed = digest_numbers(name + end for name, n in zip(names, lengths.tolist()) for end in ends[:n])
        order = np.lexsort((pos, hashed, row))
        count = np.minimum(np.floor(lengths * share), max_masked)
        chosen = np.zeros(len(flat), bool)
        # within a row the sorted places are the row's own
        chosen[order] = pos < count[row]
        at = np.flatnonzero(chosen)
        bodies = [names[r][len(head) :] + ends[i] for r, i in zip(row[at].tolist(), pos[at].tolist())]
        u = digest_numbers(f"{head}/kind".encode() + body for body in bodies) / float(2**HASH_BITS)
        drawn = digest_numbers(f"{head}/token".encode() + body for body in bodies) % size
        label_id = pc.fill_null(pc.take(ids, pc.index_in(flat, value_set=tokens, skip_nulls=True)), unknown_id).to_numpy()
        masked_id = label_id.copy()
        masked_id[at] = np.where(u < 0.8, mask_id or 0, np.where(u < 0.9, drawn, label_id[at]))
        gone = np.zeros(len(flat), bool)
        gone[at] = (u < 0.8) & (mask_id is None)
        offsets = pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32))
        made = [pa.array(pos.astype(np.int32)), pa.array(label_id), pa.array(chosen), pa.array(masked_id, mask=gone)]
        lists = [pa.ListArray.from_arrays(offsets, values) for values in made]
        return pa.RecordBatch.from_arrays([*[batch.column(k) for k in key], *lists], [*key, "pos", "label_id", "masked", "masked_id"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, MASK_ROWS):
                yield masked(batch.slice(start, MASK_ROWS))

    name = F.concat_ws(":", F.lit(head), *[F.col(k).cast("string") for k in key])
    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in key) + ", pos array<int>, label_id array<bigint>, masked array<boolean>, masked_id array<bigint>"
    return given.select(*key, F.col(label), name.alias("_name")).mapInArrow(run, schema)


def mask_tokens_join(
    df: DataFrame, label: str, key: Sequence[str], vocabulary: DataFrame, seed, mask: str, unknown_id: int, share: float = 0.2, max_masked: int = 20
) -> DataFrame:
    """The same with a vocabulary of any size; instances of one key come back as one row."""
    ordered = F.array_sort(
        F.transform(label, lambda t, i: F.struct(keyed_hash(seed, *key, i).alias("h"), i.alias("i")))
    )
    count = F.least(F.floor(F.size(label) * F.lit(share)).cast("int"), F.lit(max_masked))
    chosen = F.transform(F.slice(ordered, F.lit(1), count), lambda s: s["i"])
    long = df.withColumn("_chosen", chosen).select(
        *key, "_chosen", F.posexplode(label).alias("pos", "token")
    )
    size = vocabulary.agg(F.count("*")).scalar()
    u = keyed_uniform(f"{seed}/kind", *key, "pos")
    masked = F.array_contains(F.col("_chosen"), F.col("pos"))
    with_ids = lookup_join(long, vocabulary.select("token", "index"), "token", salt_from=[*key, "pos"])
    label_id = F.coalesce(F.col("index"), F.lit(unknown_id).cast("bigint"))
    mask_id = vocabulary.filter(F.col("token") == mask).agg(F.max("index")).scalar()
    random_id = F.pmod(keyed_hash(f"{seed}/token", *key, "pos"), size)
    masked_id = (
        F.when(~masked, label_id).when(u < 0.8, mask_id).when(u < 0.9, random_id).otherwise(label_id)
    )
    rows = with_ids.select(*key, "pos", label_id.alias("label_id"), masked.alias("masked"), masked_id.alias("masked_id"))
    entries = F.array_sort(F.collect_list(F.struct("pos", "label_id", "masked", "masked_id")))
    grouped = rows.groupBy(*key).agg(entries.alias("_r"))
    return grouped.select(*key, *[F.col(f"_r.{c}").alias(c) for c in ("pos", "label_id", "masked", "masked_id")])


def assemble_instances(
    instances: DataFrame, key: Sequence[str], types: DataFrame, max_length: int = 128, max_masked: int = 20
) -> DataFrame:
    """Fixed-width arrays per instance from the rows of ``mask_tokens``; those of one key are one instance."""
    parts = F.collect_list(F.struct("pos", "label_id", "masked", "masked_id"))
    grouped = instances.groupBy(*key).agg(parts.alias("_parts")).join(types, list(key))
    zipped = F.transform("_parts", lambda p: F.arrays_zip(*[p[c].alias(c) for c in ("pos", "label_id", "masked", "masked_id")]))
    merged = F.array_sort(F.flatten(zipped))
    # a single part is in order
    column = lambda c: F.when(F.size("_parts") == 1, F.get("_parts", F.lit(0))[c]).otherwise(F.transform(merged, lambda s: s[c]))
    rows = grouped.select(*key, "types", *[column(c).alias(c) for c in ("pos", "label_id", "masked", "masked_id")])
    at = F.array_compact(F.transform("masked", lambda m, i: F.when(m, i)))
    rows = rows.withColumn("_at", at)
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    pad = lambda v, n: F.concat(v, F.array_repeat(zero, F.lit(n) - F.size(v)))
    return rows.select(
        *key,
        pad(F.col("masked_id"), max_length).alias("token_ids"),
        pad(F.col("types").cast("array<bigint>"), max_length).alias("type_ids"),
        pad(F.array_repeat(one, F.size("pos")), max_length).alias("input_mask"),
        pad(F.transform("_at", lambda i: F.get("pos", i).cast("bigint")), max_masked).alias("masked_positions"),
        pad(F.transform("_at", lambda i: F.get("label_id", i)), max_masked).alias("masked_ids"),
        pad(F.array_repeat(one, F.size("_at")), max_masked).alias("label_mask"),
    )


def subword_seeds(words: Iterable[tuple[str, int]], longest: int = 16) -> list[tuple[str, int]]:
    """``(piece, count)``: the parts of two to ``longest`` characters that more than one character, or end, follows, by falling count.

    The end of the last word counts as one of its own, as the trainer has it.

    The trainer finds the same parts itself, from a text with each word written
    as often as it occurs: its memory then grows with the corpus. Given the parts, it
    works on the words and their counts alone.
    """
    counts: Counter[str] = Counter()
    followed: dict[str, set[str]] = defaultdict(set)
    last = ""
    for last, n in words:
        for a in range(len(last)):
            for b in range(a + 2, min(len(last), a + longest) + 1):
                counts[last[a:b]] += n
                followed[last[a:b]].add(last[b : b + 1])
    for a in range(max(len(last) - longest, 0), len(last) - 1):
        followed[last[a:]].add("end")
    return sorted(((p, n) for p, n in counts.items() if len(followed[p]) > 1), key=lambda x: (-x[1], x[0]))


def train_subwords(words: Sequence[tuple[str, int]], vocab_size: int) -> bytes:
    """A sentence-piece model of ``(word, count)``; memory by the words, whatever their counts."""
    import io

    import sentencepiece as spm

    model = io.BytesIO()
    normalizer = spm.SentencePieceNormalizer(rule_name="nmt_nfkc")
    marked = [("▁" + part, n) for word, n in words for part in normalizer.normalize(word).split()]
    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "seeds.tsv")
        with open(path, "w", encoding="utf-8") as f:
            f.writelines(f"{piece}\t{n}\n" for piece, n in subword_seeds(marked))
        given = {"seed_sentencepieces_file": path} if os.path.getsize(path) else {}
        spm.SentencePieceTrainer.train(
            sentence_iterator=iter(f"{word}\t{n}" for word, n in words),
            model_writer=model,
            input_format="tsv",
            vocab_size=vocab_size,
            hard_vocab_limit=False,
            num_threads=1,
            minloglevel=2,
            **given,
        )
    return model.getvalue()


def subword_tokenize(df: DataFrame, text: str, model: bytes, out: str = "pieces") -> DataFrame:
    """Sentence-piece encoding with a given model, loaded once per task."""
    shipped = df.sparkSession.sparkContext.broadcast(model)
    columns = df.columns

    def encode(batches):
        import sentencepiece as spm

        processor = spm.SentencePieceProcessor(model_proto=shipped.value)
        for pdf in batches:
            pieces = [processor.encode(s, out_type=str) for s in pdf[text]]
            yield pdf.assign(**{out: pd.Series(pieces, index=pdf.index, dtype=object)})

    fields = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    return df.select(*columns).mapInPandas(encode, f"{fields}, `{out}` array<string>")


def subword_decode(pieces: Column, mark: str = "▁") -> Column:
    """Sentence-piece decoding: join and turn the word mark into spaces."""
    return F.regexp_replace(F.replace(F.array_join(pieces, ""), F.lit(mark), F.lit(" ")), "^ ", "")
