"""A corpus from raw documents to tokens, in stages of framerank.llm.

Each stage takes (spark, docs, sf_dir), does its whole job on what the stage before kept, and all
but the last return the columns of documents. run() writes each stage's rows to the shared folder
and reads them back, so a lost executor repeats part of one stage only.

Cases: an empty table stays empty. Null and letterless texts go in the first stage. Near-dedup goes by rows, so
rows that repeat a doc_id or have none are judged by their texts like any other. Columns beside those of
documents are carried along up to the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framerank.llm import _common as C
from framerank.llm import bpe, decontaminate, langid, pii, similar
from framerank.llm.queries import vocabulary_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no language: those that language identification calls und."""
    C.arrow_limits(spark)
    profiles = langid.fit(docs.select("lang", "text"))
    own = C.free(docs, "lang")
    found = docs.withColumn(own, langid.predict(F.col("text"), profiles))
    # With no language to learn from nothing can be told, and only texts without letters go.
    told = F.col(own)["lang"] != langid.UNKNOWN if profiles else F.col("text").rlike(r"\p{L}")
    return found.where(told).select(*docs.columns)


#: Numbers of dropped rows up to this many travel to the documents (8 bytes each); more meet them in a shuffle.
FEW_ROWS = 2_000_000


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of texts whose sets of five-word shingles are similar to 0.8 or more the row with the smallest
    doc_id. op2's trie self-join of all fingerprints comes first; its 4 bits don't reach that similarity and link texts below
    it, so an exact check follows, and a second step finds the pairs beyond 4 bits."""
    own = C.free(docs, "row")
    numbered = C.materialise(docs.withColumn(own, F.monotonically_increasing_id()), "pipeline_rows")
    found = similar.groups(numbered.select(F.col(own).alias("row"), "doc_id", "text"))
    dropped = C.materialise(found.where("not kept").select(F.col("row").alias(own)), "pipeline_dropped")
    few = dropped.count() <= FEW_ROWS
    return numbered.join(F.broadcast(dropped) if few else dropped, own, "left_anti").select(*docs.columns)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated documents and cuts benchmark passages out of the others."""
    own = C.free(docs, "hits")
    found = decontaminate.scan(docs, C.read(spark, sf_dir, "benchmark"), own)
    kept = found.where(~decontaminate.contaminated(F.col(own)))
    return _retext(kept, decontaminate.excise(F.col("text"), F.col(own)["spans"])).select(*docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a kind's name in brackets in place of each personal identifier."""
    own = C.free(docs, "redacted")
    return _retext(pii.redacted(docs, own), F.col(own)).select(*docs.columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes: doc_id, lang, source, n_tokens, ids_sha256, decoded_sha256, ids."""
    rows = bpe.round_trip(docs, vocabulary_path())
    n = (F.octet_length("ids") / 4).cast("long")
    return rows.select("doc_id", "lang", "source", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "ids")


def _retext(docs: DataFrame, text) -> DataFrame:
    """A new text, and its length where the text has changed."""
    own = C.free(docs, "text")
    out = docs.withColumn(own, text)
    if "n_chars" in docs.columns:
        length = F.length(own).cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col(own).eqNullSafe(F.col("text")), F.col("n_chars")).otherwise(length))
    return out.withColumn("text", F.col(own)).drop(own)


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", decontaminate_benchmark),
    ("pii", redact_personal_data),
    ("bpe", tokenise),
]

#: SQL has no XXH64 with a seed and no byte-pair encoder; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = C.materialise(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
