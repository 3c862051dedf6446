"""Queries over the given tables, one for each operator, and the SQL that must agree where there is any."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, chat, count_tree, decontaminate, licences, near_duplicates, personal, prefix_trie, resampling, secret_scan, suffixes, toxicity
from tidemark.llm import quality as rules
from tidemark.plans.registry import Query

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"


@query(
    f"""
WITH everything AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{CONTROL_TEXT}'
  UNION ALL SELECT -1, 1, 'assistant', '{CONTROL_TEXT}'),
marked AS (
  SELECT *, replace(replace(text, '\\', '\\\\'), '<|', '<\\|') AS escaped FROM everything)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn)) AS loss_sha256,
  CAST(sum(length('<|im_start|>') + length(role) + 1 + length(escaped) + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""
)
def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, streamed as events, folded, rendered, and described as read back from the rendering."""
    given = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    control = spark.range(2).select(
        F.lit(-1).cast("long"), "id", F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(CONTROL_TEXT)
    )
    read = chat.format_chats(chat.stream(given.unionAll(control)))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query()
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule counts of every document, the base verdict and that of the isolation forest."""
    judged = rules.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *rules.COUNTS, "base_failed", "kept", F.round("anomaly", 6).alias("anomaly"))


def vocabulary(spark: SparkSession) -> tuple[dict[bytes, int], str]:
    import public_tokenizers

    return bpe.read_ranks(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN


def bpe_digests(docs: DataFrame) -> DataFrame:
    """Ids of every text and the bytes they decode to, as counts and digests."""
    ranks, pattern = vocabulary(docs.sparkSession)
    coded = bpe.decode(bpe.encode(docs, ranks, pattern), ranks)
    return coded.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query()
def op10_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document and their decoding."""
    return bpe_digests(table(spark, sf_dir, "documents"))


def joined(spans) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def of_kinds(kinds: tuple[str, ...]):
    return F.filter("spans", lambda s: s["kind"].isin(*kinds))


@query()
def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: counts and digest of the patterns' spans, and all spans with those of the lexer."""
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"))
    base = secret_scan.KINDS[:3]
    return found.select(
        "doc_id",
        *(F.size(of_kinds((k,))).cast("long").alias(f"n_{k}") for k in base),
        F.sha2(joined(of_kinds(base)), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
        F.size(of_kinds(("lexed",))).cast("long").alias("n_lexed"),
    )


@query()
def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts and digest of the patterns' spans, and all spans with the field's."""
    found = personal.find_personal(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *(F.size(of_kinds((k,))).cast("long").alias(f"n_{k}") for k in personal.BASE),
        F.sha2(joined(of_kinds(personal.BASE)), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
    )


@query(licences.oracle())
def op5_licence_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences that each document declares."""
    found = licences.find_licences(table(spark, sf_dir, "documents"))
    names = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["licence"])))
    return found.select(
        "doc_id",
        F.size("matches").cast("long").alias("n_matches"),
        F.array_join(names, ",").alias("licences"),
        F.round(F.array_max(F.transform("matches", lambda m: m["dice"])), 6).alias("best_dice"),
    )


def near_sql(size: int, percent: int, columns: str) -> str:
    """DuckDB SQL for components of documents whose shingle sets are similar."""
    shingle = " || chr(31) || ".join(f"w[i + {k}]" for k in range(size))
    return f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {size} THEN [array_to_string(w, chr(31))]
    ELSE list_distinct(list_transform(range(1, len(w) - {size - 2}), lambda i: {shingle})) END AS s FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n + b.n - count(*) AS whole, count(*) AS shared
  FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id, a.n, b.n),
links AS (SELECT a, b FROM common WHERE 100 * shared >= {percent} * whole UNION SELECT b, a FROM common WHERE 100 * shared >= {percent} * whole),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
lowest AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT {columns} FROM sets JOIN lowest ON doc_id = a
"""


@query(near_sql(3, 85, "doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept"))
def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: three-word shingles, similarity of 0.85 or more."""
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


@query()
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each document that 100-byte strings seen earlier cover, and a digest of the bytes that are left."""
    done = suffixes.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda total, r: total + r["end"] - r["start"])
    return done.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


@query()
def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, copied or reworded."""
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("cosine", 3).alias("cosine"), F.round("lcs", 6).alias("lcs"), F.round("answer", 6).alias("answer"))


@query()
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learnt from labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    predicted = F.when(F.col("score") >= 0.3, 1).otherwise(0)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", predicted.alias("predicted"))


def _crc32(text: str) -> str:
    """DuckDB SQL for the CRC-32 of a text's bytes, with the table ``crc_table`` of one list ``t``."""
    bytes_ = f"list_transform(range(strlen({text})), lambda i: CAST('0x' || substr(hex({text}), 2 * i + 1, 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bytes_}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"


CRC_TABLE = """crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS c
    FROM range(256) r(i)))"""

_FEATURES = """SELECT {key}, list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f, len(w) AS n_words
  FROM (SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {table})"""


@query(
    f"""
WITH {CRC_TABLE},
docs AS ({_FEATURES.format(key="doc_id", table="documents")}),
wanted AS ({_FEATURES.format(key="item_id", table="benchmark")}),
used AS (SELECT doc_id, unnest(f) AS f, false AS of_target FROM docs UNION ALL SELECT NULL, unnest(f), true FROM wanted),
coded AS (SELECT f, {_crc32("f")} % 10000 AS bucket FROM (SELECT DISTINCT f FROM used), crc_table),
counted AS (SELECT bucket, count_if(NOT of_target) AS s, count_if(of_target) AS t FROM used JOIN coded USING (f) GROUP BY bucket),
totals AS (SELECT sum(s)::DOUBLE + 10000 AS s_all, sum(t)::DOUBLE + 10000 AS t_all FROM counted),
gained AS (SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * s_all) / ((s + 1)::DOUBLE * t_all)))::BIGINT AS gain FROM counted, totals),
weighed AS (
  SELECT doc_id, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight
  FROM used JOIN coded USING (f) JOIN gained USING (bucket) WHERE NOT of_target GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, len(d.f)::BIGINT AS n_features, coalesce(weight, 0) AS weight, n_words >= 20 AS able,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || d.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM docs d LEFT JOIN weighed USING (doc_id)),
placed AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS place, count_if(able) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= 25 * n // 100 THEN place END AS rank FROM placed
"""
)
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn towards the distribution of the benchmark, with weights, scores and ranks."""
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=25, least_words=20, seed=7)


@query(
    f"""
WITH {CRC_TABLE},
turns AS (
  SELECT conv_id, length(x) AS size, sha256(length(r) || ':' || r || x) AS digest,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(r) || ':' || r || x)) AS k
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)),
convs AS (SELECT c, {_crc32("CAST(c AS VARCHAR)")} % 6 AS h FROM (SELECT DISTINCT conv_id AS c FROM turns), crc_table),
mixed AS (
  SELECT c, 0 AS part, k, digest, size FROM convs JOIN turns ON conv_id = c - c % 100 WHERE k <= h
  UNION ALL SELECT c, 1, k, digest, size FROM convs JOIN turns ON conv_id = c WHERE k > h),
paths AS (
  SELECT c, coalesce(p, []) AS p, coalesce(s, []) AS s
  FROM convs LEFT JOIN (SELECT c, list(digest ORDER BY part, k) AS p, list(size ORDER BY part, k) AS s FROM mixed GROUP BY c) USING (c)),
prefixes AS (
  SELECT c, d, array_to_string(p[1:d], '') AS key, CASE WHEN d > 0 THEN array_to_string(p[1:d - 1], '') END AS above, coalesce(s[d], 0) AS size, d = len(p) AS ended
  FROM (SELECT *, unnest(range(len(p) + 1)) AS d FROM paths)),
nodes AS (
  SELECT key, any_value(above) AS above, min(c) AS conv_id, any_value(d) AS depth, count(*) AS n_convs, any_value(size) AS size,
    sha256(coalesce(string_agg(CASE WHEN ended THEN CAST(c AS VARCHAR) END, ',' ORDER BY c), '')) AS ends_sha256
  FROM prefixes GROUP BY key),
children AS (SELECT above, count(*) AS n_children FROM nodes WHERE above IS NOT NULL GROUP BY above),
grown AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children k ON n.key = k.above),
below AS (
  SELECT p.key, CAST(count_if(n.n_children = 0) AS BIGINT) AS n_leaves, CAST(sum((n.n_convs - 1) * n.size) AS BIGINT) AS saved_tokens
  FROM grown n JOIN prefixes p ON p.c = n.conv_id AND p.d <= n.depth GROUP BY p.key)
SELECT n.conv_id, n.depth, a.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens, n.ends_sha256
FROM grown n JOIN below USING (key) LEFT JOIN nodes a ON n.above = a.key
"""
)
def op13_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct prefix of the rebuilt conversations, with its members, leaves and savings."""
    return prefix_trie.prefix_trie(prefix_trie.rebuild(table(spark, sf_dir, "conversations")))


@query(near_sql(3, 90, "doc_id, len(s) AS n_shingles, component_id"))
def op12_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents whose three-word shingle sets have a similarity of 0.9 or more."""
    return count_tree.similar_components(table(spark, sf_dir, "documents"), size=3, percent=90)
