"""Registered queries of the sub-package and their DuckDB texts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabledoc.llm import (
    byte_bpe, chat_trees, conversation_repair, curriculum, embed_dedup, hard_negatives, lang_id, ngram_join, packing, quality_rules, secret_scan, topk_voronoi, url_cascade,
)
from tabledoc.plans.registry import Query
from tabledoc.session import load_table

QUERIES: dict[str, Query] = {}

BPE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
#: Verdict, host and path of the URL rules.
RULES = (
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
)


def query(name: str, oracle: str | None = None):
    def add(build):
        QUERIES[name] = Query(build, oracle)
        return build

    return add


def held_out(key: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % 3 == 1


@query("op1_secret_scan")
def secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(load_table(spark, sf_dir, "documents").select("doc_id", "text"))

    def listed(spans: Column) -> Column:
        kinds = F.array(*[F.lit(k) for k in secret_scan.KINDS])
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")

    def n(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(listed(F.filter("spans", lambda s: s["kind"] < 3)), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
    )


@query("op2_byte_bpe")
def byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load_table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = byte_bpe.encode(docs, BPE_RANKS).select("doc_id", "ids", "starts")
    back = byte_bpe.decode(ids, BPE_RANKS)
    return back.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


_TOPK = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.v, d.v)::BIGINT AS score
  FROM v q JOIN v d ON q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n, vec_id, score FROM s
) SELECT query_id, n::INTEGER AS rank, vec_id, score FROM r WHERE n <= 20
"""


@query("op3_topk_search", _TOPK)
def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_voronoi.search(load_table(spark, sf_dir, "embeddings"))


@query("op4_packing")
def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(load_table(spark, sf_dir, "documents"), WORD_BPE)


@query("op5_quality")
def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = load_table(spark, sf_dir, "documents"), load_table(spark, sf_dir, "labels")
    model = quality_rules.fit(docs, labels.where(~held_out()))
    scored = quality_rules.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


@query("op6_language")
def language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load_table(spark, sf_dir, "documents")
    model = lang_id.fit(docs.where(~held_out()))
    return lang_id.predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


_URLS = """
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), p AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM u
), rules(verdict, h, s) AS (VALUES
  ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), m AS (
  SELECT p.page_id, p.host, p.path, r.h || r.s AS rule, r.verdict,
    row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.h || r.s) DESC NULLS LAST) AS n
  FROM p LEFT JOIN rules r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.s)
) SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE n = 1
"""


@query("op7_url_filter", _URLS)
def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load_table(spark, sf_dir, "pages").select("page_id", "url")
    return url_cascade.judge(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


def _escaped(text: str) -> str:
    out = f"replace({text}, '~', '~0')"
    for i, mark in enumerate(chat_trees.Template().control, 1):
        out = f"replace({out}, '{mark}', '~{i}')"
    return out


_CHATS = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
) SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|turn|>' || replace({_escaped("role")}, chr(10), '~n') || chr(10) || {_escaped("text")} || '<|end|>' || chr(10)))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""


@query("op8_chat_format", _CHATS)
def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = load_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    out = chat_trees.format_trees(chat_trees.chain(said.unionByName(extra)))
    turns = F.transform(chat_trees.read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = chat_trees.read_loss(F.col("formatted"), F.col("loss_spans"))
    back = out.withColumns({"turns": turns, "loss": loss})
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.concat_ws("", "turns"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query("op9_embedding_dedup")
def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(load_table(spark, sf_dir, "embeddings"))


@query("op10_ngram_join")
def near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(load_table(spark, sf_dir, "documents"), words=3, similarity=(9, 10))


# capping sources in the order of size by weight raises the level until the first that is not above its cap
_MIX = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM d GROUP BY source
), w AS (
  SELECT source, source_size, (CASE nth % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS weight FROM s
), l AS (
  SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER before, 0)) /
    (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM w WINDOW before AS (ORDER BY source_size / weight, weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, weight * (SELECT max(level) FROM l)) AS target FROM w
), o AS (
  SELECT doc_id, size, source_size, target, floor(target + 0.5)::BIGINT AS whole, sum(size) OVER (
    PARTITION BY t.source ORDER BY ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || size), 1, 13))::BIGINT ROWS UNBOUNDED PRECEDING) - size AS begin
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
) SELECT doc_id, size, source_size, coalesce(target, 0) AS target,
  (greatest(0, least(coalesce(whole, 0) - begin, size)) + greatest(0, least(coalesce(whole, 0) - begin - source_size, size)))::BIGINT AS taken FROM o
"""


@query("op11_source_mix", _MIX)
def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curriculum.mix(load_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


_NEGATIVES = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
) SELECT p.anchor_id, positive_id, row_number() OVER w::INTEGER AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 3
"""


@query("op12_hard_negatives", _NEGATIVES)
def negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.pmod("vec_id", F.lit(7)) == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(load_table(spark, sf_dir, "embeddings"), label=label)


def damaged(said: DataFrame) -> DataFrame:
    """Rows dropped, emptied, stripped of sentence ends, repeated or given to the user, by a checksum of their place."""
    place = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    harm, text = F.crc32(place) % 20, F.coalesce("text", F.lit(" "))
    return said.where(harm != 0).select(
        "conv_id", "turn", F.when(harm == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(harm == 1, "").when(harm == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.when(harm == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    )


@query("op13_conversation_repair")
def repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = load_table(spark, sf_dir, "conversations")
    got = conversation_repair.repair(damaged(said))
    every = said.select("conv_id").distinct().withColumn("_c", conversation_repair.name(F.col("conv_id")))
    out = every.join(got.conversations, "_c", "left").join(conversation_repair.digests(got.messages), "_c", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select(
        "conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
