"""The corpus queries: each applies its operator to a whole table and derives the columns asked for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm import ann, bpe, exact_knn, line_dedup, mixing, ngram_join, packing, periodic_runs, pii, sharding, spelling, superminhash, toxicity, vectors
from arbora.llm.common import WORD, bound_batches, cut, lower_ascii

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            ORACLE[name] = sql
        return build

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SIZE_SQL = r"coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)"
RATES_SQL = f"""
sizes AS (SELECT source, CAST(sum({SIZE_SQL}) AS BIGINT) AS source_size FROM documents GROUP BY source),
ranked AS (SELECT source, source_size, source_size * 2.0::DOUBLE AS cap,
    ([3, 1, 2])[(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM sizes),
levels AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
      - coalesce(sum(cap) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(w) OVER () - coalesce(sum(w) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM ranked WINDOW f AS (ORDER BY cap / w, encode(source) NULLS LAST)),
final AS (SELECT arg_min(level, cap / w) AS level FROM levels WHERE level * w <= cap),
rates AS (SELECT source, source_size, least(cap, coalesce((SELECT level FROM final), 'inf'::DOUBLE) * w) AS target FROM levels)
"""
MIX_SQL = f"""WITH {RATES_SQL},
mixed AS (SELECT doc_id, CAST({SIZE_SQL} AS BIGINT) AS size, r.source_size, r.target,
    CASE WHEN r.source_size > 0 THEN r.target / r.source_size ELSE 0 END AS rate,
    CAST('0x' || substr(md5('11:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) / (2.0 ^ 52) AS coin
  FROM documents d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (floor(rate) + CASE WHEN coin < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM mixed"""


@query("op2_mix_sources", MIX_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query("op4_shuffle_shards")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = sharding.shuffle_into_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), 24)
    return sharded.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.encode("text", "UTF-8"), F.lit("").cast("binary"))).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op5_byte_bpe")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, pattern, keep=True).drop("text")
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256)
    encoded = encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), "ids")
    return bpe.decode(encoded, path, keep=True).select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query("op1_adaptive_scan")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors.clean_vectors(table(spark, sf_dir, "embeddings"))
    return ann.search(rows, rows.filter(F.col("vec_id") % 20 == 0), 20)


KNN_SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.v, v.v) AS BIGINT) AS score
    FROM v q, v WHERE q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM pairs QUALIFY rank <= 20"""


@query("op9_exact_top_k", KNN_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors.clean_vectors(table(spark, sf_dir, "embeddings"), zero=True)
    whole = rows.select("vec_id", F.transform("v", lambda x: F.floor(x * 64).cast("double")).alias("v"))
    return exact_knn.search(whole, whole.filter(F.col("vec_id") % 20 == 0), 20)


@query("op7_personal_data")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["base"])

    def number(kind):
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    counts = [number(kind) for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


@query("op6_toxicity")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(documents, table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(documents, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


LINES_SQL = r"""WITH raw AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
numbered AS (SELECT doc_id, unnest(range(len(lines))) AS line, unnest(lines) AS text FROM raw),
worded AS (SELECT doc_id, line, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM numbered),
firsts AS (SELECT w, min((doc_id, line)) AS first FROM worded WHERE len(w) > 0 GROUP BY w),
long AS (SELECT *, len(w) AS n FROM firsts WHERE len(w) >= 8),
halves AS (SELECT DISTINCT first, w, n, unnest([('p', w[1:c]), ('s', w[n - c + 1:n])]) AS half
  FROM (SELECT *, unnest([n // 2, (n + 1) // 2]) AS c FROM long)),
pairs AS (SELECT DISTINCT x.first, x.w AS a, y.w AS b FROM halves x JOIN halves y ON x.half = y.half AND y.first < x.first AND abs(x.n - y.n) <= 1),
near AS (SELECT DISTINCT first FROM pairs WHERE CASE
    WHEN len(a) = len(b) THEN len(list_filter(range(1, len(a) + 1), lambda i: a[i] <> b[i])) <= 1
    ELSE len(list_filter(range(1, greatest(len(a), len(b)) + 1), lambda i:
      CASE WHEN len(a) > len(b) THEN a[:i - 1] || a[i + 1:] = b ELSE b[:i - 1] || b[i + 1:] = a END)) > 0 END),
gone AS (SELECT doc_id, line FROM worded JOIN firsts USING (w) LEFT JOIN near ON near.first = firsts.first
  WHERE near.first IS NOT NULL OR firsts.first < (doc_id, line))
SELECT n.doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(g.line) AS BIGINT) AS n_removed,
  sha256(coalesce(string_agg(n.text, chr(10) ORDER BY n.line) FILTER (WHERE g.line IS NULL), '')) AS text_sha256
FROM numbered n LEFT JOIN gone g ON n.doc_id = g.doc_id AND n.line = g.line GROUP BY n.doc_id"""


@query("op8_line_dedup", LINES_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", F.col("lines").alias("n_lines"), F.col("removed_lines").alias("n_removed"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def shingles_sql(n: int, percent: int, more: str = "") -> str:
    """Classes of documents whose sets of n-word shingles link at ``percent`` of Jaccard similarity."""
    return rf"""WITH RECURSIVE worded AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {n} THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) END AS s FROM worded),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (SELECT a.doc_id AS u, b.doc_id AS v FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, p.v FROM reach r JOIN pairs p ON r.v = p.u)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.v) AS component_id{more}
FROM sets s JOIN reach r ON r.u = s.doc_id GROUP BY s.doc_id, len(s.s)"""


SHINGLES_SQL = shingles_sql(5, 75)


@query("op3_ngram_join", SHINGLES_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.similar_groups(table(spark, sf_dir, "documents"))
    return found.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


@query("op10_pack_tokens")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of the byte-level BPE; the two ids after the last rank end a document and fill a row."""
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    last = max(bpe.read_ranks(path).values())
    # packing reads the sizes first and the ids later, so they are written once
    encoded = bpe.encode_packed(table(spark, sf_dir, "documents").select("doc_id", "text"), path, pattern, keep=True)
    encoded = cut(encoded.select("doc_id", "ids", F.octet_length("ids").alias("bytes")))
    packed = packing.pack(encoded, "ids", end=last + 1, pad=last + 2, size="bytes")
    digests = [F.sha2(c, 256).alias(f"{c}_sha256") for c in ("ids", "positions")]
    return packed.select("pool", "row", "n_tokens", "doc_ids", "parts", "of_parts", "cumulative", *digests)


def with_repetitions(documents: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``; the words of a tenth of the documents (by a hash of the id) go on periodically from a word on."""
    hashed = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))
    rows = documents.select("doc_id", "text", hashed.alias("h"), F.floor(hashed / 10).alias("g"))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    sized = rows.withColumn("n", F.when(F.col("h") % 10 == 0, F.nullif(F.size(words), F.lit(0))).cast("long"))
    placed = sized.withColumn("a", F.col("g") % F.col("n")).withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    a, p, left = F.col("a").cast("int"), F.col("p").cast("int"), (F.col("n") - F.col("a")).cast("int")
    period = F.slice(words, a + 1, p)
    tail = F.slice(F.flatten(F.array_repeat(period, F.ceil(left / p).cast("int"))), F.lit(1), left)
    planted = F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")
    return placed.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))


@query("op11_periodic_runs")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.add_runs(with_repetitions(table(spark, sf_dir, "documents").select("doc_id", "text")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n")))), "")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        (-best["l"]).alias("length"),
        best["period"].alias("period"),
        F.floor(-1000 * best["l"] / best["period"]).alias("exponent_milli"),
        F.sha2(F.encode(listed, "UTF-8"), 256).alias("runs_sha256"),
        F.sha2(F.encode(F.coalesce("collapsed", F.lit("")), "UTF-8"), 256).alias("collapsed_sha256"),
    )


@query("op12_superminhash", shingles_sql(3, 85, ", s.doc_id = min(r.v) AS kept"))
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


#: Every letter counts as its UTF-8 bytes; ``t`` is the table of CRC-32, made by its rule.
SPELLING_SQL = r"""WITH RECURSIVE bits AS (SELECT i, 0 AS k, i::BIGINT AS c FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
found AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
runs AS (SELECT doc_id, run, count(*) AS n FROM found WHERE length(run) >= 7 GROUP BY doc_id, run),
bytes AS (SELECT *, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
  lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [192 + unicode(x) // 64, 128 + unicode(x) % 64]::BIGINT[] END)) AS b FROM runs),
hashed AS (SELECT *, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1]), 4294967295::BIGINT), 4294967295) AS h FROM bytes, crc),
cut AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
less AS (SELECT word, length(word) AS size, n, i, substr(word, 1, i) || substr(word, i + 2) AS v FROM (SELECT *, unnest(range(length(word))) AS i FROM words)),
pairs AS (SELECT a.word, b.word AS near, b.n FROM less a JOIN less b ON a.v = b.v AND a.i = b.i AND a.size = b.size AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.v = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.v = b.word),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-n, encode(near))) AS form, max(n) AS form_n FROM pairs GROUP BY word),
known AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * w.n THEN form END AS form, CASE WHEN form_n >= 10 * w.n THEN form_n END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word),
way AS (SELECT word, word AS root, form AS after FROM known UNION ALL SELECT w.word, k.word, k.form FROM way w JOIN known k ON w.after = k.word)
SELECT k.word, k.form, w.root, k.n, CAST(k.n_near AS BIGINT) AS n_near, k.form_n FROM known k JOIN way w ON w.word = k.word AND w.after IS NULL"""


def damaged_words(documents: DataFrame, least: int = 7) -> DataFrame:
    """``word``, ``n``: letter runs of at least ``least`` letters in lower case; one in 31, by a hash with the id, lacks a letter.

    Runs that are too short are too short without a letter, so only long enough ones are found: they are whole runs,
    since a match takes all letters there are.
    """
    pattern = r"[A-Za-z\u00C0-\u00FF]{" + str(least) + ",}"
    runs = documents.select("doc_id", F.explode(F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(pattern), F.lit(0))).alias("run"))
    hashed = runs.withColumn("h", F.crc32(F.encode(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")), "UTF-8")))
    place = (F.col("h") % F.length("run")).cast("int")
    shortened = F.concat(F.substring("run", F.lit(1), place), F.substring("run", place + 2, F.length("run")))
    words = hashed.select(F.when(F.col("h") % 31 == 0, shortened).otherwise(F.col("run")).alias("word"))
    return words.filter(F.length("word") >= least).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query("op13_spelling_variants", SPELLING_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = damaged_words(table(spark, sf_dir, "documents")).filter("n >= 2")
    return spelling.group_variants(words).select("word", "form", "root", "n", "n_near", "form_n")
