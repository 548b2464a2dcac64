"""The corpus pipeline: classify, keep one of each group of near copies, cut repeated passages, decontaminate, encode.

Every stage takes (spark, docs, sf_dir) and works on all documents that its predecessor kept. A stage's result is written
as Parquet and read back as the next stage's input. All but the last return the columns of documents.

Every stage takes nulls in any column, empty and very long texts, repeated rows, ids shared by several texts, no rows at
all, and further columns of any name, which pass through unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.base import load, written
from tidewell.llm.bpe import round_trip
from tidewell.llm.decontamination import decontaminate
from tidewell.llm.ngram_join import near_copies_removed
from tidewell.llm.quality_classifier import classify, train
from tidewell.llm.queries import byte_bpe, grades
from tidewell.llm.substring_dedup import substring_dedup


def classified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are good more likely than not; the fit reads labelled documents of this input.

    A null text is graded as an empty one. Equal rows get equal grades. Without labels all rows stay, without good ones
    none."""
    model = train(docs, grades(spark, sf_dir), n_grades=3)
    return classify(docs, model, wanted=2).where("graded.kept").select(*docs.columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that near-copy links (0.8 of five-word shingles) connect, the one of the smallest id.

    Texts without words are linked with nothing and stay. Of rows of one id the one whose text has the least hash; a null id comes last."""
    return near_copies_removed(docs, k=5, percent=80)


def passages_cut(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of passages of 35 words or more that recur; a document that loses all its words goes.

    A text that loses words has the others joined by one space, and n_chars counts again; other rows stay as they are,
    null and empty texts too. Repeated rows are passages of each other, so all of them lose those words."""
    got = substring_dedup(docs)
    cut = F.col("dedup.n_removed") > 0
    got = got.where(~cut | (F.col("dedup.n_removed") < F.col("dedup.n_words")))
    text = F.when(cut, F.col("dedup.kept")).otherwise(F.col("text"))
    fresh = {"text": text, "n_chars": F.when(cut, F.length("dedup.kept").cast("long")).otherwise(F.col("n_chars"))}
    return got.select(*(fresh[c].alias(c) if c in fresh else F.col(c) for c in docs.columns))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an overlap with a benchmark item.

    Null and empty texts overlap nothing and stay; repeated rows share their fate; a null id is a row like others."""
    return decontaminate(docs, load(spark, sf_dir, "benchmark")).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the SHA-256 digest of the bytes that decoding the ids gives.

    One row for each row, null and repeated ids too; a null text has no ids."""
    got = round_trip(docs, *byte_bpe())
    return got.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_classifier", classified),
    ("ngram_join", one_of_near_copies),
    ("substring_dedup", passages_cut),
    ("decontamination", decontaminated),
    ("byte_bpe", encoded),
]

#: The stages fit a model, follow links and run automata, which SQL can't express; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
