"""The queries of this subpackage and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, exact_dedup, hard_negatives, jaccard_join, language_id, language_model, merkle, packing, substring_dedup, suffix_dedup, toxicity, warc


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def remainder(n: int) -> F.Column:
    """crc32 of a document's id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % n


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_format.read_back(chat_format.format_conversations(rows))


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = language_model.train(docs.filter(remainder(10) != 0))
    return language_model.score(docs, model).withColumns({"held_out": remainder(10) == 0, "train_tokens": F.lit(model.tokens).cast("long")})


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer()).withColumn("length", F.col("length").cast("long"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    net = toxicity.train(docs.filter(remainder(3) != 1), read(spark, sf_dir, "labels"))
    return toxicity.score(docs, net).select("doc_id", (remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(read(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.archive_pages(read(spark, sf_dir, "pages"))
    return warc.page_rows(warc.read_archives(archives.repartition(max(1, archives.count())), with_data=False)).drop("intact")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(read(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents")).drop("keep_locator")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.train(docs.filter(remainder(4) != 2))
    return language_id.predict(docs.drop("lang"), model).select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    cut = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle.verify(merkle.manifest(docs, tampered={"text": cut}))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").filter(hard_negatives.usable(F.col("embedding"), F.col("label")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    taken = rows.select(F.col("vec_id").cast("long").alias("id"), label.alias("label"), hard_negatives.quantised(F.col("embedding")).alias("q"))
    return hard_negatives.mine(taken, F.coalesce(F.col("id") % 50 == 0, F.lit(False)))


QUERIES = {
    f.__name__: f
    for f in (op1_decontaminate, op2_chat_format, op3_language_model, op4_packing, op5_toxicity, op6_substring_dedup, op7_warc, op8_jaccard_join, op9_exact_dedup, op10_language_id, op11_merkle, op12_suffix_dedup, op13_hard_negatives)
}

ORACLE = {
    "op2_chat_format": chat_format.oracle(),
    "op7_warc": """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as size, sha1(coalesce(html, '')) as digest from pages),
r as (select digest, max(page_id) as response_id from p where size >= 1000 group by 1)
select page_id, size as payload_bytes, p.digest as payload_digest, case when page_id < response_id then 'revisit' else 'response' end as record_type,
  case when page_id < response_id then response_id end as refers_to
from p left join r on p.digest = r.digest and size >= 1000""",
    "op9_exact_dedup": """
with d as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) as text_sha256 from documents)
select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = min(doc_id) over w as kept, text_sha256
from d window w as (partition by text_sha256)""",
    "op11_merkle": merkle.oracle(),
    "op13_hard_negatives": """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as q
  from embeddings where label is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
s as (
  select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as alike, list_inner_product(a.q, b.q)::bigint as score
  from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id
),
p as (select anchor_id, id as positive_id, score as positive_score from s where alike qualify row_number() over (partition by anchor_id order by score desc, id) <= 5)
select anchor_id, positive_id, row_number() over w as rank, id as negative_id, positive_score, score as negative_score
from p join s using (anchor_id) where not alike and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
window w as (partition by anchor_id, positive_id order by score desc, id) qualify row_number() over w <= 3""",
}
