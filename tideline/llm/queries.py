"""One query per dealt operator, over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tideline.llm import ann, ballkmeans, bytebpe, decontaminate, importance, langid, licences, quality, sentencepieces, sharding, simhash, urlfilter, warc


def model_path() -> str:
    """The merge-type vocabulary that the contract names."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return simhash.near_duplicates(docs, shingle=4, radius=4).select("doc_id", "fingerprint", "component_id")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back through the capture index."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return warc.round_trip(pages, least=0).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of what they decode to."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return sentencepieces.encode(docs, model_path(), ids=False, decoded=False, digests=True)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url, by rules and then by its host's standing among links."""
    return urlfilter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight contiguous shards of `documents`, nearly equal in bytes."""
    return sharding.byte_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line or whole text of `documents` that is a licence notice or text."""
    return licences.scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.contaminated(docs, items).drop("_doc_key")


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth vector."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return ann.search(vectors, vectors.filter("vec_id % 50 = 0"), k=5)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document by attention over its passages."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.score(docs, quality.learn(docs, labels))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document by the code lengths of frozen context trees."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return langid.predict(docs, langid.learn(docs))


def op11_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen clusters of the vectors, by balls whose members meet only the centroids that may be nearer."""
    return ballkmeans.clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's byte-level ids, each distinct word encoded once, and of what they decode to."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return bytebpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The draw of a twentieth of the documents towards the texts of `benchmark`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return importance.resample(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_warc": op2_warc,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_url_filter": op4_url_filter,
    "op5_sharding": op5_sharding,
    "op6_licenses": op6_licenses,
    "op7_decontamination": op7_decontamination,
    "op8_ann": op8_ann,
    "op9_quality": op9_quality,
    "op10_language_id": op10_language_id,
    "op11_ball_kmeans": op11_ball_kmeans,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_importance": op13_importance,
}

ORACLE_SQL: dict[str, str] = {
    "op2_warc": warc.oracle_sql(least=0),
    "op5_sharding": sharding.oracle_sql(),
    "op6_licenses": licences.oracle_sql(),
    "op11_ball_kmeans": ballkmeans.oracle_sql(),
    "op13_importance": importance.oracle_sql(),
}
