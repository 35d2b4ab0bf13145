"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read
again as the next one's docs.  All but the last return the columns of ``documents``; every
stage works on all that its predecessor kept.  As a stage begins, what the one before it left in the
shared folder is removed: its result has been written by then.

Odd rows, in every stage: a null id is kept as a null and never joined to another; rows that
repeat are judged each, and alike; an empty table gives an empty table; texts of any length
are judged whole; further columns, whatever their names, pass through.  What a null or an empty
text means is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievegrid.llm import decontaminate, jaccard, line_templates, packing, quality, store
from sievegrid.session import table

TOKENIZER = "word_bpe_49k.json"
_scratch = store.Scratch()  # of stages that are called one by one; ``run`` has its own


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: store.Scratch = _scratch) -> DataFrame:
    """Documents that the quality classifier accepts; null and empty texts score 0 and go.

    Ties among neighbours are settled by their order; without labels all score 0.5 and stay.
    """
    scratch.forget()  # an earlier run's last tables may still be read
    with scratch.step(spark):
        labels = table(spark, sf_dir, "labels")
        voter = quality.fit(docs, labels.where(~quality.held_out(F.col("doc_id"))))
        return quality.keep_good(docs, voter)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: store.Scratch = _scratch) -> DataFrame:
    """Documents without lines of recurring templates; ``n_chars`` follows the text.

    A null text stays null, with ``n_chars`` null; empty texts and lines stay as they are.
    """
    with scratch.step(spark):
        cleaned = line_templates.drop_recurring(docs, find=line_templates.boilerplate_lines)
        return cleaned.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: store.Scratch = _scratch) -> DataFrame:
    """One document, that with the least id, of each group of near duplicates.

    Null and empty texts and null ids are near to nothing and stay; rows that share an id stay
    or go together.
    """
    with scratch.step(spark):
        found = jaccard.near_duplicates(docs)
        # kept as a table, so that its size decides between a broadcast and a shuffle
        gone = store.keep(found.where("component_id != doc_id").select("doc_id").distinct(), "near-copies")
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: store.Scratch = _scratch) -> DataFrame:
    """Documents without passages of the benchmark; null and empty texts hold none and stay."""
    with scratch.step(spark):
        return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: store.Scratch = _scratch) -> DataFrame:
    """Pieces of packed sequences, with their token ids; a null or empty text is its end id."""
    import public_tokenizers

    with scratch.step(spark):
        return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality classifier", classify),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("packing", pack),
]
ORACLE_SQL = None  # no SQL for a classifier or a tokenizer; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs, scratch = table(spark, sf_dir, "documents"), store.Scratch()
    for name, stage in STAGES[:-1]:
        before, docs = docs, store.keep(stage(spark, docs, sf_dir, scratch), "stage-" + name.replace(" ", "-"))
        store.drop(before)  # a stage's table goes when the next one's is written
    return STAGES[-1][1](spark, docs, sf_dir, scratch)
