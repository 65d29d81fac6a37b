"""The corpus pipeline: language ID, near-dedup, substring dedup, mixing, packing.

Each stage works on every row that the one before kept, and returns the columns of ``documents``; the last returns pieces.
Each passes on rows in full, takes an empty table, and carries extra columns along, whatever their names. Rows that repeat
are decided on alike, but near-dedup keeps one of them; null texts and empty ones end in the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stalemark.llm import bytelang, mixing, nearness, packing, repeats
from stalemark.llm.frames import documents, unwrapped, wrapped, write_through


def _text_and_rest(docs: DataFrame) -> DataFrame:
    """doc_id and text, and every other column in one struct ``_row``, whatever its name."""
    row = F.col("_row")
    rest = F.struct(*(row[c].alias(c) for c in docs.columns if c != "text"))
    return wrapped(docs).select(rest.alias("_row"), row["doc_id"].alias("doc_id"), row["text"].alias("text"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out documents in no language, and fill in a null ``lang`` with the network's label; given ones stay.

    In no language are those without a text, without a letter in it, and those whose score is hardly above chance
    (``bytelang.least_score``): junk, or languages in equal parts. If no language could be learned, all are.
    """
    net = bytelang.learn_languages(docs)
    named = bytelang.label_documents(_text_and_rest(docs).drop("doc_id"), net)
    least = bytelang.least_score(net) if net else 0.0
    spoken = named.where((F.col("lang_pred") != bytelang.NONE) & (F.col("score") >= least))
    return unwrapped(spoken, {"text": F.col("text"), "lang": F.coalesce(F.col("_row")["lang"], "lang_pred")}).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest doc_id; of rows equal in doc_id and text, one. Rows without
    a doc_id stay.
    """
    found = nearness.near_duplicates(docs.select("doc_id", "text"))
    stays = found.where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_stays")).distinct()
    row = F.col("_row")
    keyed = wrapped(docs).select("_row", row["doc_id"].cast("long").alias("_id"), F.xxhash64(row["text"]).alias("_hash"))
    kept = keyed.join(stays, F.col("_id") == F.col("_stays"), "left_semi")
    first = F.row_number().over(Window.partitionBy("_id", "_hash").orderBy("_hash"))
    kept = kept.withColumn("_place", first).where("_place = 1").select("_row")
    return unwrapped(kept.union(keyed.where("_id IS NULL").select("_row")), {})


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand elsewhere too are cut out; a document goes if nothing is left of it. Others keep their text."""
    removed = repeats.remove_repeats(_text_and_rest(docs)).where("n_removed = 0 OR n_removed < n_words")
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    made = {"text": text} | ({"n_chars": F.length(text).cast("long")} if "n_chars" in docs.columns else {})
    return unwrapped(removed, made).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that each source's quota takes: a row per taken span of a document, documents over quota left out."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the mix, each with its sequence and its place there."""
    return packing.pack_documents(docs)


STAGES = [
    ("language ID", language),
    ("MinHash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("mixing sources to target weights", mix),
    ("best-fit packing", pack),
]

#: Language ID, minima and tokens can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between two stages, rows are a table in the shared folder."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = write_through(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
