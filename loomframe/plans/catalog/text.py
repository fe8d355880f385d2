"""Text processors, tokenizers, vocabularies and pre-training instances.

Token lists are compared by an order-dependent digest per document.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from loomframe.core.session import materialize, spread
from loomframe.functions import text as T
from loomframe.operators import joins as J, language as L, reduce as R, topk as K
from loomframe.plans.registry import Tables, h, query

TOKENS = "string_split(rtrim(text, ' '), ' ')"
P_CLASS = r"[\p{P}!-/:-@\[-`{-~]"


def pieces_sql(text: str) -> str:
    return rf"list_filter(regexp_split_to_array(regexp_replace({text}, '({P_CLASS})', ' \1 ', 'g'), '\s+'), lambda p: p <> '')"


CHAIN = pieces_sql("lower(text)")


def digest_sql(tokens: str) -> str:
    return f"md5(array_to_string({tokens}, chr(31)))"


def _digests(df, tokens):
    return df.select("doc_id", F.size(tokens).cast("bigint").alias("n"), T.digest(tokens).alias("digest"))


def _digests_sql(tokens: str) -> str:
    return f"SELECT doc_id, len({tokens})::BIGINT AS n, {digest_sql(tokens)} AS digest FROM documents"


@query("tokenize_simple", _digests_sql(TOKENS))
def _simple(t: Tables):
    return _digests(t.documents, T.tokenize_simple(F.col("text")))


@query("build_sentence", f"SELECT doc_id, md5(array_to_string({TOKENS}, '_')) AS digest FROM documents")
def _sentence(t: Tables):
    return t.documents.select("doc_id", F.md5(T.build_sentence(T.tokenize_simple(F.col("text")), "_")).alias("digest"))


@query("lower_case", _digests_sql(f"list_transform({TOKENS}, lambda w: lower(w))"))
def _lower(t: Tables):
    return _digests(t.documents, T.lower_case(T.tokenize_simple(F.col("text"))))


@query("separate_punctuation", _digests_sql(pieces_sql("text")))
def _punct(t: Tables):
    return _digests(t.documents, T.separate_punctuation(T.tokenize_simple(F.col("text"))))


@query("text_pipeline", _digests_sql(CHAIN))
@query("text_chain", _digests_sql(CHAIN))
def _chain(t: Tables):
    return _digests(t.documents, T.text_chain(F.col("text")))


@query("normalize_unicode", "SELECT doc_id, md5(nfc_normalize(text)) AS digest FROM documents")
def _unicode(t: Tables):
    return t.documents.select("doc_id", F.md5(T.unicode_normalize("NFC")(F.col("text"))).alias("digest"))


_DASHES = "[" + "".join(f"\\x{{{c:04X}}}" for c in T.HYPHENS if c != T.SOFT_HYPHEN) + "]"


@query(
    "normalize_hyphens",
    rf"""SELECT doc_id, md5(regexp_replace(regexp_replace(x, '\x{{00AD}}', '', 'g'), '{_DASHES}', '-', 'g')) AS digest
FROM (SELECT doc_id, replace(replace(replace(text, '.', chr(8212)), ',', chr(173)), ' la ', '~') AS x FROM documents)""",
)
def _hyphens(t: Tables):
    # the corpus has few exotic hyphens: some are put in on both sides
    x = F.replace(F.replace(F.replace("text", F.lit("."), F.lit("—")), F.lit(","), F.lit("­")), F.lit(" la "), F.lit("~"))
    return t.documents.select("doc_id", F.md5(T.normalize_hyphens(x)).alias("digest"))


@query(
    "clean_text",
    rf"""SELECT doc_id, md5(regexp_replace(text, '[\p{{Lu}}0-9]', '', 'g')) AS dropped, md5(regexp_replace(text, '[\t\n\r\p{{Z}}]', '_', 'g')) AS replaced FROM documents""",
)
def _clean(t: Tables):
    return t.documents.select(
        "doc_id",
        F.md5(T.clean_text(F.col("text"), r"[\p{Lu}0-9]")).alias("dropped"),
        F.md5(T.clean_text(F.col("text"), r"[\t\n\r\p{Z}]", "_")).alias("replaced"),
    )


@query("terminate_text", _digests_sql(f"list_concat(list_concat(['<bos>'], {TOKENS}), ['<eos>'])"))
def _terminate(t: Tables):
    return _digests(t.documents, T.terminate(T.tokenize_simple(F.col("text"))))


@query("truncate_text", _digests_sql(f"({TOKENS})[1:12]"))
def _truncate(t: Tables):
    # the operator itself: the first n tokens
    return _digests(t.documents, T.truncate(T.tokenize_simple(F.col("text")), 12))


@query("lambda_text", _digests_sql(f"list_transform({TOKENS}, lambda w: reverse(w) || length(w))"))
def _lambda(t: Tables):
    fn = T.each_token(lambda w: F.concat(F.reverse(w), F.length(w).cast("string")))
    return _digests(t.documents, fn(T.tokenize_simple(F.col("text"))))


@query("strip_accents", "SELECT doc_id, md5(strip_accents(text)) AS digest FROM documents")
def _strip(t: Tables):
    return t.documents.select("doc_id", F.md5(T.strip_accents(F.col("text"))).alias("digest"))


@query("bert_basic_tokenize", _digests_sql(pieces_sql(r"strip_accents(lower(trim(regexp_replace(text, '[\t\n\r\p{Z}]', ' ', 'g'))))")))
def _basic(t: Tables):
    return _digests(t.documents, T.bert_basic_tokenize(F.col("text")))


_BERT = r"""list_filter(flatten(list_transform(list_zip(regexp_extract_all(text, '(\S+?)([.,?!])?(\s+|$)', 1),
  regexp_extract_all(text, '(\S+?)([.,?!])?(\s+|$)', 2)), lambda z: [z[1], z[2]])), lambda w: w <> '')"""


@query("bert_tokenize", _digests_sql(_BERT))
def _bert(t: Tables):
    return _digests(t.documents, T.bert_tokenize(F.col("text")))


def _turn_pairs(t: Tables):
    asked = t.conversations.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("q"))
    answered = t.conversations.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("p")
    )
    return asked.join(answered, ["conv_id", "turn"])


@query(
    "bert_encode_pair",
    f"""
WITH tk AS (SELECT conv_id, turn, role, {_BERT} AS w FROM conversations),
p AS (SELECT a.conv_id, a.turn, a.w AS q, b.w AS p FROM tk a JOIN tk b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'),
e AS (SELECT *, list_concat(list_concat(list_concat(['[CLS]'], q), list_concat(['[SEP]'], p)), ['[SEP]']) AS toks FROM p)
SELECT conv_id, turn, greatest(len(toks), 256)::BIGINT AS width, (len(p) + 1)::BIGINT AS ones, len(toks)::BIGINT AS attended, (len(q) + len(p))::BIGINT AS valid_length,
  md5(array_to_string(list_concat(toks, list_transform(range(greatest(256 - len(toks), 0)), lambda i: '[PAD]')), chr(31))) AS digest FROM e""",
)
def _encode_pair(t: Tables):
    df = _turn_pairs(t).select("conv_id", "turn", T.bert_tokenize(F.col("q")).alias("q"), T.bert_tokenize(F.col("p")).alias("p"))
    enc = T.bert_encode_pair(F.col("q"), F.col("p"), 256)
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return df.select(
        "conv_id",
        "turn",
        F.size(enc["tokens"]).cast("bigint").alias("width"),
        total(enc["types"]).alias("ones"),
        total(enc["attention"]).alias("attended"),
        enc["valid_length"].alias("valid_length"),
        T.digest(enc["tokens"]).alias("digest"),
    )


# vocabulary ----------------------------------------------------------------------
RESERVED = ["<bos>", "<eos>", "<pad>"]
TOKEN_ROWS_SQL = f"(SELECT doc_id, unnest({CHAIN}) AS token, generate_subscripts({CHAIN}, 1) - 1 AS pos FROM documents)"
VOCAB_SQL = f"""(SELECT token, index FROM (VALUES ('<bos>', 0::BIGINT), ('<eos>', 1), ('<pad>', 2), ('<unk>', 3)) f(token, index)
  UNION ALL SELECT token, row_number() OVER (ORDER BY n DESC, token) + 3 FROM (SELECT token, count(*) AS n FROM {TOKEN_ROWS_SQL} GROUP BY 1 HAVING count(*) >= 3))"""


def documents(t: Tables):
    """Whole texts by document: what is regrouped by doc_id later moves no token rows."""
    return spread(t.documents.select("doc_id", "text"), "doc_id")


#: Text of a task whose tokens are regrouped by document: they take some fifteen times as much.
DOCUMENT_BYTES = 16 << 20


def document_rows(t: Tables):
    """Token rows with all of a document's in one task, however many pieces the table has: texts move, not their tokens."""
    docs = t.documents.select("doc_id", "text")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(t.spark.sparkContext.defaultParallelism, -(-size // DOCUMENT_BYTES))
    return J.explode_tokens(docs.repartition(parts, "doc_id"), ["doc_id"], T.text_chain(F.col("text")))


def document_lists(t: Tables):
    """The tokens of each row as a list, where the row lies."""
    return documents(t).select("doc_id", T.text_chain(F.col("text")).alias("tokens"))


def token_rows(t: Tables):
    return J.explode_tokens(documents(t), ["doc_id"], T.text_chain(F.col("text")))


def vocabulary(t: Tables):
    return L.build_vocabulary(token_rows(t).select("token"), 3, RESERVED)


@query("build_vocabulary", f"SELECT token, index FROM {VOCAB_SQL}")
def _vocab(t: Tables):
    return vocabulary(t)


@query(
    "build_vocabulary_reached",
    f"""SELECT unnest(['<bos>', '<eos>', '<pad>', '<unk>']) AS token, unnest(range(4))::BIGINT AS index
UNION ALL SELECT token, row_number() OVER (ORDER BY doc_id, pos) + 3 FROM
  (SELECT *, row_number() OVER (PARTITION BY token ORDER BY doc_id, pos) AS k FROM {TOKEN_ROWS_SQL}) WHERE k = 10""",
)
def _vocab_reached(t: Tables):
    return L.build_vocabulary(token_rows(t), 10, RESERVED, reached_by=["doc_id", "pos"])


@query(
    "text_to_ids",
    f"""SELECT doc_id, count(*) AS n, sum((pos + 1) * coalesce(index, 3))::BIGINT AS print FROM {TOKEN_ROWS_SQL} LEFT JOIN {VOCAB_SQL} v USING (token) GROUP BY 1""",
)
def _ids(t: Tables):
    ids = J.token_lookup(document_rows(t), vocabulary(t), 3)
    lists = J.recollect(ids, ["doc_id"], "index", "ids")
    print_ = F.aggregate(F.transform("ids", lambda x, i: x * (i + 1)), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return lists.select("doc_id", F.size("ids").cast("bigint").alias("n"), print_.alias("print"))


@query(
    "replace_rare",
    f"""SELECT doc_id, md5(string_agg(coalesce(v.token, '<unk>'), chr(31) ORDER BY pos)) AS digest FROM {TOKEN_ROWS_SQL} w LEFT JOIN {VOCAB_SQL} v USING (token) GROUP BY 1""",
)
def _rare(t: Tables):
    vocab = vocabulary(t)
    ids = J.token_lookup(document_rows(t), vocab, 3)
    words = J.index_lookup(ids.select("doc_id", "pos", "index"), vocab, "<unk>")
    lists = J.recollect(words, ["doc_id"], "word", "words")
    return lists.select("doc_id", T.digest(F.col("words")).alias("digest"))


@query(
    "raw_and_processed_text",
    f"SELECT doc_id, md5(text) AS raw, {digest_sql(CHAIN)} AS processed FROM documents",
)
def _raw(t: Tables):
    return t.documents.select("doc_id", F.md5("text").alias("raw"), T.digest(T.text_chain(F.col("text"))).alias("processed"))


@query(
    "split_identifiers",
    r"""
WITH l AS (SELECT page_id, unnest(regexp_split_to_array(html, '\r\n|\n|\r')) AS line, generate_subscripts(regexp_split_to_array(html, '\r\n|\n|\r'), 1) - 1 AS pos FROM pages)
SELECT page_id, pos, md5(array_to_string(list_transform(regexp_extract_all(line, '\p{Lu}?[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]+|\p{Lu}|\P{L}', 0), lambda w: lower(w)), chr(31))) AS digest FROM l""",
)
def _identifiers(t: Tables):
    lines = t.pages.select("page_id", F.posexplode(F.split("html", "\r\n|\n|\r")).alias("pos", "line"))
    return lines.select(
        "page_id", F.col("pos").cast("bigint").alias("pos"), T.digest(T.split_identifiers(F.col("line"))).alias("digest")
    )


_LINES = r"list_filter(list_transform(regexp_split_to_array(text, '\r\n|\n|\r'), lambda s: regexp_replace(s, '[\s\v]+$', '')), lambda s: s <> '')"


@query("normalize_lines", _digests_sql(_LINES))
def _lines(t: Tables):
    return _digests(t.documents, T.normalize_lines(F.col("text")))


# pre-training ----------------------------------------------------------------------
def line_pairs(t: Tables):
    """Lines 2k and 2k+1 of a document; a row holds its two lines, not the whole document."""
    last = F.greatest(F.floor(F.size("l") / 2).cast("int") - 1, F.lit(0))
    pair = lambda k: F.struct(k.cast("bigint").alias("pair"), F.get("l", k * 2).alias("first"), F.get("l", k * 2 + 1).alias("second"))
    return (
        documents(t).select("doc_id", T.normalize_lines(F.col("text")).alias("l"))
        .filter(F.size("l") >= 2)
        .select("doc_id", F.inline(F.transform(F.sequence(F.lit(0), last), pair)))
    )


def with_pair_tokens(pairs):
    return pairs.withColumns({c: T.text_chain(F.col(c)) for c in ("first", "second")})


def sentence_pairs(t: Tables):
    """The pairs of lines as token lists."""
    return with_pair_tokens(line_pairs(t))


_LINE_TOKENS = f"list_transform({_LINES}, lambda s: {pieces_sql('lower(s)')})"
PAIRS_SQL = f"""(SELECT doc_id, k AS pair, l[2 * k + 1] AS first, l[2 * k + 2] AS second FROM
  (SELECT doc_id, l, unnest(range(len(l) // 2)) AS k FROM (SELECT doc_id, {_LINE_TOKENS} AS l FROM documents)))"""
NSP_SQL = f"""(SELECT doc_id, pair, couple, CASE WHEN swap THEN other ELSE first END AS first, second, NOT swap AS consecutive FROM
  (SELECT *, n2 = 2 AND {h('9/swap', 'couple')} / pow(2.0, 52) < 0.5 AS swap FROM
    (SELECT *, rk // 2 AS couple, count(*) OVER (PARTITION BY rk // 2) AS n2,
       CASE WHEN rk % 2 = 0 THEN lead(first) OVER (ORDER BY rk) ELSE lag(first) OVER (ORDER BY rk) END AS other FROM
      (SELECT *, row_number() OVER (ORDER BY {h(9, 'doc_id', 'pair')}, doc_id, pair) - 1 AS rk FROM {PAIRS_SQL}))))"""


@query(
    "next_sentence_pairs",
    f"SELECT doc_id, pair, couple, consecutive, {digest_sql('first')} AS first, {digest_sql('second')} AS second FROM {NSP_SQL}",
)
def _nsp(t: Tables):
    out = with_pair_tokens(L.next_sentence_pairs(line_pairs(t), ["doc_id", "pair"], 9))
    return out.select(
        "doc_id", "pair", "couple", "consecutive", T.digest(F.col("first")).alias("first"), T.digest(F.col("second")).alias("second")
    )


_DROP = "greatest(len(first) + len(second) - 25, 0)"
TRUNCATED_SQL = f"""(SELECT doc_id, pair, first[1:len(first) - least(len(first), wa + greatest(wb - len(second), 0))] AS a,
  second[1:len(second) - least(len(second), wb + greatest(wa - len(first), 0))] AS b FROM
  (SELECT doc_id, pair, first, second, ({_DROP} + 1) // 2 AS wa, {_DROP} // 2 AS wb FROM {{src}}))"""


@query(
    "truncate_pair",
    f"SELECT doc_id, pair, {digest_sql('a')} AS a, {digest_sql('b')} AS b, (len(a) + len(b))::BIGINT AS total FROM {TRUNCATED_SQL.format(src=PAIRS_SQL)}",
)
def _truncate_pair(t: Tables):
    a, b = T.truncate_pair(F.col("first"), F.col("second"), 25)
    return sentence_pairs(t).select(
        "doc_id", "pair", T.digest(a).alias("a"), T.digest(b).alias("b"), (F.size(a) + F.size(b)).cast("bigint").alias("total")
    )


CODE_RESERVED = ["<unk>", "<cls>", "<sep>", "<msk>"]


def instances(t: Tables):
    swapped = with_pair_tokens(L.next_sentence_pairs(line_pairs(t), ["doc_id", "pair"], 9))
    a, b = T.truncate_pair(F.col("first"), F.col("second"), 125)
    label, types = L.pretraining_sequence(F.col("a"), F.col("b"), "<cls>", "<sep>")
    return swapped.select("doc_id", "pair", "consecutive", a.alias("a"), b.alias("b")).select(
        "doc_id", "pair", "consecutive", label.alias("label"), types.alias("types")
    )


@query(
    "mask_tokens",
    f"""
WITH d AS (SELECT unnest(['<unk>', '<cls>', '<sep>', '<msk>']) AS token, unnest(range(4))::BIGINT AS index
  UNION ALL SELECT token, row_number() OVER (ORDER BY n DESC, token) + 3 FROM (SELECT token, count(*) AS n FROM {TOKEN_ROWS_SQL} GROUP BY 1 ORDER BY n DESC, token LIMIT 34996)),
s AS (SELECT count(*) AS size FROM d),
i AS (SELECT doc_id, pair, list_concat(list_concat(list_concat(['<cls>'], a), list_concat(['<sep>'], b)), ['<sep>']) AS label, len(a) + 2 AS cut FROM {TRUNCATED_SQL.format(src=NSP_SQL).replace('25, 0', '125, 0')}),
w AS (SELECT doc_id, pair, cut, len(label) AS n, unnest(label) AS token, generate_subscripts(label, 1) - 1 AS pos FROM i),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, pair ORDER BY {h(13, 'doc_id', 'pair', 'pos')}, pos) <= least(floor(n * 0.2::DOUBLE), 20) AS masked, {h('13/kind', 'doc_id', 'pair', 'pos')} / pow(2.0, 52) AS u FROM w),
x AS (SELECT k.*, coalesce(index, 0) AS label_id, CASE WHEN NOT masked THEN coalesce(index, 0) WHEN u < 0.8 THEN 3
  WHEN u < 0.9 THEN {h('13/token', 'doc_id', 'pair', 'pos')} % (SELECT size FROM s) ELSE coalesce(index, 0) END AS masked_id FROM k LEFT JOIN d USING (token))
SELECT doc_id, pair, sum((pos + 1) * masked_id)::BIGINT AS token_ids, sum(CASE WHEN pos >= cut THEN pos + 1 ELSE 0 END)::BIGINT AS type_ids, count(*) AS input_mask,
  coalesce(sum(mp * pos) FILTER (masked), 0)::BIGINT AS masked_positions, coalesce(sum(mp * label_id) FILTER (masked), 0)::BIGINT AS masked_ids, count(*) FILTER (masked) AS label_mask
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, pair, masked ORDER BY pos) AS mp FROM x) GROUP BY 1, 2""",
)
def _mask(t: Tables):
    counts = R.token_frequency(token_rows(t).select("token"))
    dictionary = materialize(K.dictionary_top_n(counts, CODE_RESERVED, 35000), "dictionary")
    rows = materialize(instances(t), "instances")
    key = ["doc_id", "pair"]
    masked = L.mask_tokens(rows.select(*key, "label"), "label", key, dictionary, 13, "<msk>", 0)
    out = L.assemble_instances(masked, key, rows.select(*key, "types"))
    weigh = lambda c: F.aggregate(F.transform(c, lambda x, i: x * (i + 1)), F.lit(0).cast("bigint"), lambda a, x: a + x)
    add = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return out.select(
        *key,
        weigh("token_ids").alias("token_ids"),
        weigh("type_ids").alias("type_ids"),
        add("input_mask").alias("input_mask"),
        weigh("masked_positions").alias("masked_positions"),
        weigh("masked_ids").alias("masked_ids"),
        add("label_mask").alias("label_mask"),
    )


# word pieces -------------------------------------------------------------------------
def piece_vocabulary(t: Tables):
    """Word pieces from the corpus: frequent words, and as '##' pieces their 1-3 letter parts."""
    words = R.token_frequency(token_rows(t).select("token")).filter("n >= 20").select("token")
    parts = words.select("token", F.explode(F.sequence(F.lit(1), F.length("token"))).alias("s")).select(
        "token", "s", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("n")
    )
    tails = parts.filter(F.col("s") + F.col("n") - 1 <= F.length("token")).select(
        F.substring(F.col("token"), F.col("s"), F.col("n")).alias("p")
    )
    heads = tails.select(F.col("p").alias("token"))
    rest = tails.select(F.concat(F.lit("##"), F.col("p")).alias("token"))
    return words.union(heads).union(rest).distinct()


PIECE_VOCAB_SQL = f"""(WITH w AS (SELECT token FROM {TOKEN_ROWS_SQL} GROUP BY 1 HAVING count(*) >= 20),
  p AS (SELECT DISTINCT substr(token, s, n) AS p FROM (SELECT token, unnest(range(1, length(token) + 1)) AS s FROM w), (VALUES (1), (2), (3)) k(n) WHERE s + n - 1 <= length(token))
  SELECT token AS piece FROM w UNION SELECT p FROM p UNION SELECT '##' || p FROM p)"""


_WORDPIECE_SQL = f"""
WITH RECURSIVE v AS MATERIALIZED (SELECT DISTINCT piece FROM {PIECE_VOCAB_SQL}), mx AS (SELECT max(length(piece)) AS m FROM v),
d AS MATERIALIZED (SELECT DISTINCT token, length(token) AS n FROM {TOKEN_ROWS_SQL} WHERE length(token) BETWEEN 1 AND 200),
spans AS (SELECT token, n, s, unnest(range(s + 1, least(n, s + m) + 1)) AS e FROM (SELECT token, n, unnest(range(n)) AS s FROM d), mx),
best AS MATERIALIZED (SELECT token, n, s, max(e) AS e FROM spans JOIN v ON piece = CASE WHEN s > 0 THEN '##' ELSE '' END || substr(token, s + 1, e - s) GROUP BY 1, 2, 3),
walk AS (SELECT token, n, 0::BIGINT AS s, e, substr(token, 1, e) AS path FROM best WHERE s = 0
  UNION ALL SELECT b.token, b.n, b.s, b.e, path || ' ##' || substr(b.token, b.s + 1, b.e - b.s) FROM walk w JOIN best b ON b.token = w.token AND b.s = w.e)
SELECT t.token, coalesce(max(path), '[UNK]') AS pieces FROM (SELECT DISTINCT token FROM {TOKEN_ROWS_SQL}) t LEFT JOIN walk w ON w.token = t.token AND w.e = w.n GROUP BY 1"""


@query("wordpiece", _WORDPIECE_SQL)
def _wordpiece(t: Tables):
    out = L.wordpiece(token_rows(t), piece_vocabulary(t))
    return out.select("token", F.array_join("pieces", " ").alias("pieces"))


@query("wordpiece_join", _WORDPIECE_SQL)
def _wordpiece_join(t: Tables):
    """The path for vocabularies too large to ship."""
    out = L.wordpiece_join(token_rows(t), materialize(piece_vocabulary(t), "pieces"))
    return out.select("token", F.array_join("pieces", " ").alias("pieces"))


#: Lists of up to 130 pieces that a task looks up and puts together again.
CUT_LISTS = 1 << 13

_BASIC = pieces_sql(r"strip_accents(lower(trim(regexp_replace(text, '[\t\n\r\p{Z}]', ' ', 'g'))))")


@query(
    "review_featurizer",
    f"""
WITH RECURSIVE v AS MATERIALIZED (SELECT piece, row_number() OVER (ORDER BY piece) + 2 AS id FROM (SELECT DISTINCT piece FROM {PIECE_VOCAB_SQL})), mx AS (SELECT max(length(piece)) AS m FROM v),
t AS MATERIALIZED (SELECT doc_id, unnest(w) AS token, generate_subscripts(w, 1) AS pos FROM (SELECT doc_id, {_BASIC} AS w FROM documents)),
d AS MATERIALIZED (SELECT DISTINCT token, length(token) AS n FROM t WHERE length(token) BETWEEN 1 AND 200),
spans AS (SELECT token, n, s, unnest(range(s + 1, least(n, s + m) + 1)) AS e FROM (SELECT token, n, unnest(range(n)) AS s FROM d), mx),
best AS MATERIALIZED (SELECT token, n, s, max(e) AS e FROM spans JOIN v ON piece = CASE WHEN s > 0 THEN '##' ELSE '' END || substr(token, s + 1, e - s) GROUP BY 1, 2, 3),
walk AS (SELECT token, n, 0::BIGINT AS s, e, substr(token, 1, e) AS path FROM best WHERE s = 0
  UNION ALL SELECT b.token, b.n, b.s, b.e, path || ' ##' || substr(b.token, b.s + 1, b.e - b.s) FROM walk w JOIN best b ON b.token = w.token AND b.s = w.e),
p AS (SELECT t.doc_id, string_split(string_agg(coalesce(path, '[UNK]'), ' ' ORDER BY pos), ' ')[1:128] AS ps FROM t LEFT JOIN walk w ON w.token = t.token AND w.e = w.n GROUP BY 1),
u AS (SELECT doc_id, unnest(ps) AS piece, generate_subscripts(ps, 1) AS pos FROM p)
SELECT doc_id, count(*) + 2 AS n, '0 ' || string_agg(coalesce(id, 2)::VARCHAR, ' ' ORDER BY pos) || ' 1' AS ids FROM u LEFT JOIN v USING (piece) GROUP BY 1""",
)
def _review(t: Tables):
    """[CLS] ids [SEP] of the first 128 word pieces of every document."""
    pieces_vocab = materialize(piece_vocabulary(t), "pieces")
    reserved = ["[CLS]", "[SEP]", "[UNK]"]
    vocab = L.build_vocabulary(pieces_vocab, 1, reserved[:2], "[UNK]")
    docs = documents(t).select("doc_id", T.bert_basic_tokenize(F.col("text")).alias("tokens"))
    lists = L.wordpiece_lists(docs, ["doc_id"], vocab)
    cut = lists.select("doc_id", T.terminate(T.truncate(F.col("tokens"), 128), "[CLS]", "[SEP]").alias("tokens"))
    # lists move, not their rows
    parts = max(t.spark.sparkContext.defaultParallelism, -(-t.documents.count() // CUT_LISTS))
    ids = J.token_lookup(J.explode_tokens(cut.repartition(parts, "doc_id"), ["doc_id"], "tokens"), vocab, 2)
    return J.recollect(ids, ["doc_id"], "index", "ids").select(
        "doc_id", F.size("ids").cast("bigint").alias("n"), F.array_join(F.transform("ids", lambda i: i.cast("string")), " ").alias("ids")
    )


@query("subword_tokenize")
def _subword(t: Tables):
    """Sentence pieces with a model made from the 2,000 most frequent words."""
    counts = R.token_frequency(token_rows(t).select("token"))
    # at most 2,000 (word, count) rows reach the driver
    top = counts.orderBy(F.desc("n"), "token").limit(2000).collect()
    model = L.train_subwords([(row.token, row.n) for row in top], 600)
    out = L.subword_tokenize(t.documents.select("doc_id", "text"), "text", model)
    return out.select(
        "doc_id", F.size("pieces").cast("bigint").alias("n"), F.length(L.subword_decode(F.col("pieces"))).cast("bigint").alias("chars")
    )
