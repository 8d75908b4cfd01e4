"""Registered queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import ann, bpe, chat, decontam, jaccard, langid, pii, quality, shards, suffixes

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def query(f):
    """Register a query; its SQL, if it has any, is in _SQL under the same name."""
    _QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Callable]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


@query
def op1_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = C.table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = quality.fit(docs, labels, C.fold("doc_id") != 2)
    return docs.select("doc_id", C.held_out("doc_id").alias("held_out"), quality.score(model, F.col("text")).alias("score")).withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


@query
def op2_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs, C.fold("doc_id") != 2)
    found = docs.select("doc_id", C.held_out("doc_id").alias("held_out"), langid.identify(spark, model, F.col("text")).alias("l"))
    return found.select("doc_id", "held_out", "l.lang_pred", "l.score")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op4_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = docs.select("doc_id", bpe.encode(F.col("text"), vocabulary()).alias("c"))
    return coded.select(
        "doc_id",
        (F.octet_length("c.ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("c.ids", 256).alias("ids_sha256"),
        F.sha2(F.col("c.decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.find(docs, C.table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.col("n_hit").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query
def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    said = F.lit("\\### Assistant: </turn> ok")
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    back = chat.read_back(chat.format_conversations(rows.unionByName(planted)))
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(flat.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query
def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.groups(C.table(spark, sf_dir, "documents").select("doc_id", "text"), k=3, pct=90)


@query
def op10_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(C.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


@query
def op3_bucket_pointer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = C.Scratch(spark, "suffixes")
    found = suffixes.repeats(C.table(spark, sf_dir, "documents").select("doc_id", "text"), scratch)
    return scratch.result(
        found.select(
            "doc_id",
            "n_bytes",
            (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
            F.size("spans").cast("long").alias("n_spans"),
            F.sha2("kept", 256).alias("kept_sha256"),
        )
    )


@query
def op8_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = C.Scratch(spark, "training-order")
    path = scratch.path("shards")
    layout = shards.write(C.table(spark, sf_dir, "documents").select("doc_id", "text"), path, key=b"training order 1")
    back = shards.read(spark, path, layout)
    return scratch.result(back.select("slot", "doc_id", "part", "n_tokens", "shard", "at", F.sha2("tokens", 256).alias("tokens_sha256")))


@query
def op7_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pii.replace(docs, key="surrogates 1", found="kinds")
    return out.select("doc_id", F.size("kinds").cast("long").alias("n_entities"), F.array_join("kinds", ",").alias("kinds"), "text")


_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"list_filter(regexp_split_to_array({_FOLD}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
_SQL["op6_decontamination"] = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
windows AS (SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS key
            FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
places AS (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM windows) s WHERE len(w) >= size),
hits AS (SELECT doc_id, i, size, item FROM (SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS key FROM places) JOIN windows USING (size, key)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(covered.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(covered.n, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""
_SQL["op9_chat_format"] = r"""
WITH c AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
t AS (SELECT *, contains(text, '</turn>' || chr(10)) OR contains(role, '</turn>' || chr(10)) OR contains(role, '>' || chr(10)) OR regexp_matches(role || ' ' || text, '\\[slg]') AS clash FROM c),
f AS (SELECT *, 16 + length(role) + length(text) + CASE WHEN clash THEN length(regexp_replace(role || text, '[^\\<>]', '', 'g')) ELSE 0 END AS chars FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""
