"""The corpus pipeline: toxicity, SimHash near-dedup, suffix dedup, decontamination, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each stage's
rows as Parquet in the shared folder and reads them as the next one's docs. All but the last
return the columns of docs. Documents are told apart by id and text, so null and repeated
ids are safe: rows of one id and one text stay or go together. Rows without an id stay unless
their text is toxic, leaked or a copy of a document that has one; an empty or null text is a copy
of other empty texts; an empty table gives no rows; columns of any other name are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trapline.llm import bpe, decontaminate, near_copies as copies, runtime, suffix_dedup, toxicity

#: Score from which a document goes: what op1 predicts toxic.
REJECT = toxicity.THRESHOLD
#: Words of a shingle, the shingle similarity (Jaccard) of near copies, and bits in which fingerprints of candidates differ at most.
WORDS, SIMILAR, BITS = 5, 0.8, 7


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the class models score below REJECT."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    into = runtime.fresh(docs, "toxicity")
    return toxicity.score(docs, model, into=into).where(F.col(into) < REJECT).drop(into)


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows whose (id, hash of the text) are in gone (id, th)."""
    d, t = docs.alias("d"), F.xxhash64(F.col("d.text").cast("string"))
    g = gone.select("id", "th").distinct().alias("g")
    return d.join(g, F.col("d.doc_id").cast("long").eqNullSafe(F.col("g.id")) & (t == F.col("g.th")), "left_anti").select("d.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least id."""
    found = copies.near_copies(docs, words=WORDS, least=SIMILAR, distance=BITS)
    return _without(docs, found.where(F.col("component").isNotNull() & ~F.col("component").eqNullSafe(F.col("id"))))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-byte strings that documents with smaller ids hold. A character of which only
    some bytes repeat goes whole; documents of which nothing is left go."""
    others = [c for c in docs.columns if c != "text"]
    out = suffix_dedup.remove_repeated_strings(docs, carry=others, characters=True)
    kept = out.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_bytes"))).withColumn("kept_text", F.col("kept").cast("string"))
    back = {c: F.col(f"carry.c{k}") for k, c in enumerate(others)} | {"text": F.col("kept_text")}
    if "n_chars" in back:
        back["n_chars"] = F.when(F.col("n_removed") == 0, back["n_chars"]).otherwise(F.length("kept_text")).cast(docs.schema["n_chars"].dataType)
    return kept.select(*[back[c].alias(c) for c in docs.columns])


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    key = runtime.fresh(docs, "key")
    named = docs.withColumn(key, F.xxhash64(F.col("doc_id"), F.col("text").cast("string")))
    hits = decontaminate.contaminated(named, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=key)
    return named.join(hits.select(F.col("id").alias(key)).distinct(), key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, and the digest of the bytes they decode to."""
    out = bpe.round_trip(docs)
    return out.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", toxic), ("simhash_near_dedup", near_copies), ("suffix_array_dedup", repeats), ("benchmark_decontamination", benchmark_leaks), ("bpe", tokens)]

#: SQL can't express the stages; tests/llm/test_contracts.py and test_near_copies.py compare each with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        path = runtime.scratch(spark, f"pipeline-{k}-{name}")
        docs = runtime.cut_to(stage(spark, docs, sf_dir), path)
        if before:
            runtime.drop(spark, before)
        before = path
    return docs
