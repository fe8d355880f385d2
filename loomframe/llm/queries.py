"""One query per operator: it applies the operator to its whole table with production parameters.

Each derives the digest columns of its contract from the operator's own output.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loomframe.core.session import new_path
from loomframe.llm import byte_bpe, embedding_dedup, fill_middle, hilbert, jaccard_join, language_id, length_buckets, license_scan
from loomframe.llm import scaled_sketch, token_binary, topk_search, toxicity, vector_codes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def wrap(build: Callable) -> Callable:
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = sql.strip()
        return build

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(folds: int, fold: int) -> Column:
    """Whether the CRC-32 of the id, written as text, falls into the fold; a row without an id does not."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds)) == fold, F.lit(False))


@query("op3_language_id")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit_languages(docs.filter(~held_out(4, 2)), "doc_id", "text", "lang")
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select(
        "doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans")
    )


@query("op8_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~held_out(5, 0))
    scored = toxicity.score(docs, toxicity.fit_toxicity(docs, labels))
    return scored.select(
        "doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@query("op9_jaccard_join")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), words=4, percent=85)


@query("op10_length_buckets")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lengths = docs.select("doc_id", length_buckets.word_count("text").alias("n_tokens"))
    return length_buckets.pack(lengths, "doc_id", "n_tokens", buckets=16, budget=32_768)


@query("op4_token_binary")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    token_binary.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), path, end=1)
    return token_binary.token_digests(spark, path)


@query("op7_byte_bpe")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


@query("op6_hilbert_shards")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        "lang",
        "source",
    )
    # names have no order worth keeping: a hash spreads them, and equal ones stay together
    dimensions = {
        "size_at": F.col("size"),
        "lang_at": F.pmod(F.xxhash64("lang"), F.lit(1 << 40)),
        "source_at": F.pmod(F.xxhash64("source"), F.lit(1 << 40)),
        "id_at": F.col("doc_id"),
    }
    sharded = hilbert.shard_by_curve(docs, dimensions, ["doc_id", "size", "text_crc32"], shards=24, bits=8)
    return sharded.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query(
    "op1_topk_search",
    """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(embedding) > 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), r AS (
  SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
""",
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = topk_search.top_k(rows, "vec_id", "embedding", F.col("vec_id") % 100 == 0, k=10, scale=1024)
    return found.withColumnRenamed("id", "vec_id")


@query("op5_embedding_neardup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return embedding_dedup.near_duplicates(rows, "vec_id", "embedding", at_least=0.9)


#: Documents as a tree of files: a folder per source and range of ids; some ids stand for the folders' licence files.
_PATH_SQL = """
  coalesce(source, 'unknown') || '/' || coalesce(CAST(CAST(floor(doc_id / 1000) AS BIGINT) AS VARCHAR), 'none') || '/' ||
  CASE WHEN doc_id % 1000 = 500 THEN 'COPYING'
       WHEN doc_id % 100 = 0 THEN CAST(CAST(floor(doc_id / 100) AS BIGINT) AS VARCHAR) || '/LICENSE'
       ELSE coalesce(CAST(CAST(floor(doc_id / 100) AS BIGINT) AS VARCHAR), 'none') || '/' || coalesce(CAST(doc_id AS VARCHAR), 'none') || '.txt' END
"""
_TEMPLATE_ROWS = ", ".join(f"('{name}', '{text}')" for name, text in license_scan.TEMPLATES)


@query(
    "op2_license_scan",
    rf"""
WITH templates(license, body) AS (VALUES {_TEMPLATE_ROWS}),
files AS (SELECT doc_id, {_PATH_SQL} AS path, coalesce(text, '') AS text FROM documents),
t_tf AS (SELECT license, term, count(*) AS tf FROM (
  SELECT license, unnest(regexp_extract_all(lower(body), '[a-z0-9]+')) AS term FROM templates) GROUP BY ALL),
df AS (SELECT term, count(*) AS n FROM (
  SELECT DISTINCT path, doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM files) GROUP BY 1),
total AS (SELECT count(*) AS n FROM files),
idf AS (SELECT term, ln((total.n + 1) / (coalesce(df.n, 0) + 1)) + 1 AS idf
  FROM (SELECT term FROM t_tf UNION SELECT term FROM df) LEFT JOIN df USING (term), total),
t_w AS (SELECT license, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY license)) AS w FROM t_tf JOIN idf USING (term)),
named AS (SELECT *, regexp_matches(regexp_extract(path, '[^/]*$'), '^(licen[cs]e|copying|copyright|notice|unlicense)(\..*)?$', 'i') AS licence_file FROM files),
units AS (SELECT DISTINCT path, unnest(string_split(text, chr(10))) AS unit FROM named
  UNION SELECT path, text FROM named WHERE licence_file),
terms AS (SELECT unit, term, count(*) AS tf FROM (
  SELECT unit, unnest(regexp_extract_all(lower(unit), '[a-z0-9]+')) AS term FROM (SELECT DISTINCT unit FROM units)) GROUP BY ALL),
u_w AS (SELECT unit, term, tf * idf AS w FROM terms JOIN idf USING (term)),
norms AS (SELECT unit, sqrt(sum(w * w)) AS norm FROM u_w GROUP BY 1),
cosines AS (SELECT u_w.unit, license, sum(u_w.w * t_w.w) / any_value(norm) AS score
  FROM u_w JOIN t_w USING (term) JOIN norms ON norms.unit = u_w.unit GROUP BY ALL),
own AS (SELECT path, license, score FROM (
  SELECT path, license, score, row_number() OVER (PARTITION BY path ORDER BY round(score, 9) DESC, license) AS k
  FROM units JOIN cosines USING (unit) WHERE score >= 0.6) WHERE k = 1),
dirs AS (SELECT dir, license, score, path AS from_path FROM (
  SELECT regexp_replace(path, '/?[^/]*$', '') AS dir, license, score, path,
    row_number() OVER (PARTITION BY regexp_replace(path, '/?[^/]*$', '') ORDER BY round(score, 9) DESC, license, path) AS k
  FROM own JOIN (SELECT DISTINCT path FROM named WHERE licence_file) USING (path)) WHERE k = 1),
inherited AS (SELECT f.path, d.license, d.score, d.from_path,
    row_number() OVER (PARTITION BY f.path ORDER BY length(d.dir) DESC) AS k
  FROM (SELECT DISTINCT path FROM files) f JOIN dirs d
    ON d.dir = '' OR starts_with(regexp_replace(f.path, '/?[^/]*$', '') || '/', d.dir || '/'))
SELECT f.doc_id, f.path, coalesce(own.license, i.license) AS license, round(coalesce(own.score, i.score), 6) AS score,
  CASE WHEN own.path IS NOT NULL THEN 'own' WHEN i.path IS NOT NULL THEN 'inherited' END AS origin,
  CASE WHEN own.path IS NOT NULL THEN own.path ELSE i.from_path END AS from_path
FROM files f LEFT JOIN own USING (path) LEFT JOIN (SELECT * FROM inherited WHERE k = 1) i ON i.path = f.path
""",
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(_PATH_SQL.replace("VARCHAR", "STRING")).alias("path"), "text")
    found = license_scan.scan(docs, "path", "text", at_least=0.6)
    # the path names the document
    return docs.select("doc_id", "path").join(found, "path", "left").select(
        "doc_id", "path", "license", F.round("score", 6).alias("score"), "origin", "from_path"
    )


@query(
    "op11_fill_middle",
    r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units,
    sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
c AS (SELECT *, len(units) AS n, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(h, i, 8))::BIGINT) AS r FROM d),
e AS (SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR r[3] % 100 >= 90 THEN 'plain'
         WHEN r[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM c),
p AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM e),
o AS (SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output FROM p)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars, sha256(output) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN output
    WHEN 'psm' THEN string_split(output, '<S>')[1][4:] || string_split(output, '<M>')[2] || string_split(string_split(output, '<S>')[2], '<M>')[1]
    ELSE string_split(string_split(output, '<P>')[2], '<M>')[1] || string_split(output, '<M>')[2] || string_split(output, '<P>')[1][4:] END) AS restored_sha256
FROM o
""",
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    arranged = fill_middle.fill_in_middle(docs, keep=["doc_id"])
    kept = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "fim_sha256", "restored_sha256"]
    restored = fill_middle.restore(arranged, keep=[c for c in arranged.columns if c != "fim_text"]).select(*kept)
    return restored.withColumnRenamed("fim_sha256", "output_sha256")


def _codes_sql(parts: int = 4, width: int = 16, size: int = 256, rounds: int = 4) -> str:
    """Assignments and updates of all rounds, unrolled."""
    squared = "(c.cc - 2 * list_inner_product(p.x, c.c))"
    steps = []
    for k in range(rounds + 1):
        steps.append(
            f"""a{k} AS MATERIALIZED (SELECT vec_id, part, arg_min(entry, {squared} * {size}::DOUBLE + entry) AS entry, min({squared}) + any_value(p.xx) AS d
  FROM parts p JOIN c{k} c USING (part) GROUP BY vec_id, part)"""
        )
        if k < rounds:
            steps.append(
                f"""m{k} AS (SELECT part, entry, list(m ORDER BY i) AS c FROM (SELECT a.part, a.entry, i, floor(sum(p.x[i]) / count(*)) AS m
  FROM a{k} a JOIN parts p USING (vec_id, part), range(1, {width + 1}) g(i) GROUP BY ALL) GROUP BY ALL),
c{k + 1} AS MATERIALIZED (SELECT part, entry, c, list_inner_product(c, c) AS cc FROM (SELECT part, entry, coalesce(m.c, o.c) AS c FROM c{k} o LEFT JOIN m{k} m USING (part, entry)))"""
            )
    return f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
cut AS (SELECT vec_id, part, v[part * {width} + 1:(part + 1) * {width}] AS x FROM kept, range({parts}) g(part)),
parts AS MATERIALIZED (SELECT *, list_inner_product(x, x) AS xx FROM cut),
c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS c, xx AS cc FROM parts
  QUALIFY row_number() OVER (PARTITION BY part ORDER BY vec_id) <= {size}),
{", ".join(steps)},
books AS (SELECT sha256(string_agg(y::BIGINT::VARCHAR, ',' ORDER BY part, entry, i)) AS digest
  FROM (SELECT part, entry, unnest(c) AS y, generate_subscripts(c, 1) AS i FROM c{rounds})),
coded AS (SELECT vec_id, string_agg(printf('%02x', entry::INTEGER), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY 1)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, digest AS codebooks_sha256
FROM coded JOIN kept USING (vec_id), books
"""


@query("op12_vector_codes", _codes_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    codes, books = vector_codes.encode(rows, parts=4, size=256, rounds=4, scale=1024)
    return codes.withColumn("codebooks_sha256", F.lit(vector_codes.codebooks_digest(books)))


_SKETCH = scaled_sketch.Sketch()


def _sketch_sql(text: str) -> str:
    """The sketch of a text: hashes below the threshold, else the least one."""
    words = f"list_filter(regexp_split_to_array(lower({text}), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
    hashes = f"""list_transform(range(1, greatest(len(w) - {_SKETCH.words - 1}, 1) + 1), lambda i: substr(md5(array_to_string(w[i:i + {_SKETCH.words - 1}], ' ')), 1, {_SKETCH.digits}))"""
    below = f"list_sort(list_distinct(list_filter(h, lambda x: x < '{_SKETCH.threshold}')))"
    return f"""(SELECT CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(b) > 0 THEN b ELSE [list_min(h)] END
    FROM (SELECT w, h, {below} AS b FROM (SELECT w, {hashes} AS h FROM (SELECT {words} AS w))))"""


def _shared_sql(a: str, b: str, of: str) -> str:
    return f"CASE WHEN {of} = 0 THEN 1.0::DOUBLE ELSE round(len(list_intersect({a}, {b}))::DOUBLE / {of}, 9) END"


_EITHER = "len(list_distinct(list_concat({0}, {1})))"


@query(
    "op13_scaled_sketch",
    f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id NULLS FIRST), first(text) OVER (ORDER BY doc_id NULLS FIRST)) AS next_text FROM d),
e AS (SELECT *, left(text, length(text) - length(text) // 4) || left(next_text, length(text) // 4) AS edited FROM n),
s AS (SELECT *, {_sketch_sql("text")} AS a, {_sketch_sql("edited")} AS b, {_sketch_sql("next_text")} AS c FROM e)
SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(edited) AS edited_sha256, array_to_string(a, '.') AS fingerprint, array_to_string(b, '.') AS edited_fingerprint,
  {_shared_sql("a", "b", _EITHER.format("a", "b"))} AS near_edited, {_shared_sql("a", "c", _EITHER.format("a", "c"))} AS near_next,
  {_shared_sql("a", "b", "len(a)")} AS held_by_edited, {_shared_sql("a", "c", "len(a)")} AS held_by_next
FROM s
""",
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scaled_sketch.compare_edits(table(spark, sf_dir, "documents"), sketch=_SKETCH)
    a, b, c = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return found.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        scaled_sketch.fingerprint(a).alias("fingerprint"),
        scaled_sketch.fingerprint(b).alias("edited_fingerprint"),
        F.round(scaled_sketch.jaccard(a, b), 9).alias("near_edited"),
        F.round(scaled_sketch.jaccard(a, c), 9).alias("near_next"),
        F.round(scaled_sketch.containment(a, b), 9).alias("held_by_edited"),
        F.round(scaled_sketch.containment(a, c), 9).alias("held_by_next"),
    )
