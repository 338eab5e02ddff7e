"""The corpus pipeline: documents pass five stages, each written as Parquet and read again.

Every stage takes (spark, docs, sf_dir) and works on all that the one before has kept:

1. toxicity: the convolutional classifier learns from labels; documents that score one half or more go.
2. language: documents without a letter (`und`) go, all others stay.
3. lines: repeated lines go, fuzzy ones among them; a document goes with them if no line with a
   word is left. Documents that lose nothing stay as they are.
4. near copies: one document of each class of similar 5-gram sets stays.
5. packing: what is left becomes token sequences.

All but the last return the columns of their input; n_chars follows the text.

A null text is scored like an empty one and goes with the language stage, as an empty one does. A
null id counts as a number beyond 2**62 that its text gives. Of repeated rows one stays (stage 4);
of equal texts the one with the smallest id. Ties between lines go to the smaller id, then the text,
then the position. Texts of any length pass whole. An empty table gives no sequences. Columns beside
those of documents pass through to stage 4, whatever their names, save for names that begin with
_line_, _copy_, _lang, _lines, _gone or _toxicity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm import langid, line_dedup, ngram_join, packing, tokens, toxicity
from strataloom.llm.common import prepare, read_table, save_stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    net = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score(docs, net, docs.columns, "_toxicity").where("_toxicity < 0.5").select(*docs.columns)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return langid.identify(docs, langid.fit(docs), docs.columns, ("_lang", "_lang_score")).where("_lang <> 'und'").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    found = line_dedup.clean(docs, counts=("_lines", "_gone"))
    out = found.where((F.col("_gone") == 0) | F.col("text").rlike(r"[\p{L}\p{N}]"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_gone") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return ngram_join.one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return packing.pack_documents(docs, tokens.byte_encoder)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("lines", drop_repeated_lines),
    ("near_copies", drop_near_copies),
    ("packing", pack),
]

#: SQL can express neither the trained models nor the packing; tests/llm/test_brute_force.py holds the rows against all pairs of lines and of 5-gram sets.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save_stage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
