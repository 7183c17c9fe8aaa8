"""A training corpus from raw documents, in five stages.

Each stage is a function of (spark, docs, sf_dir) and works on all that the stage
before it kept. All but the last return the columns of documents; the last returns
packed pieces.

Defined results: texts that are null or without a letter leave in the first stage; null
and shared doc_ids join no different texts and keep no copies apart; of rows equal in id
and text one stays; a null source is a source of its own; very long texts are worked on
whole; ties go to the smaller doc_id, null last; an empty table goes through as one;
columns beyond those of documents stay up to the last stage, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm import language_id, near_dedup, packing, private_data, source_mix, wide_prints
from tidewheel.session import table
from tidewheel.storage import cut

#: A language's least posterior probability.
SURE = 0.5
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _apart(stage: Stage) -> Stage:
    """The stage, with columns beyond COLUMNS under names of no meaning to it while it works."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        extra = {c: f"extra_column_{k}" for k, c in enumerate(docs.columns) if c not in COLUMNS}
        kept = stage(spark, docs.withColumnsRenamed(extra), sf_dir)
        return kept.withColumnsRenamed({held: c for c, held in extra.items()})

    return run


@_apart
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach, surely enough; fills lang where it is null.

    Rejected are texts that are null or have no letter, and those no language is at least SURE for.
    Where no document is labelled there is nothing to judge by, and all with a letter stay.
    """
    model = language_id.train(docs.select(F.col("doc_id").alias("key"), "text", "lang"))
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    judged = language_id.predict(docs, model)
    kept = judged.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= SURE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(docs.columns)


@_apart
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group alike in 0.8 of its 5-word shingles: the one with the smallest doc_id, null last.

    Rows are told apart by id and text: neither a null nor a shared id joins different texts.
    The rows that stay grow with the documents, so they are never broadcast: the join
    shuffles at every size, and builds its tables of ids and hashes alone.
    """
    rows = docs.select("doc_id", wide_prints.node().alias("node")).groupBy("node", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    # Structs order by their first field: ids before null, then the smallest id, then the text's hash.
    first = rows.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node", "n")).alias("first"))
    of = first.join(near_dedup.near_texts(docs).hint("shuffle_hash"), "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
    heads = cut(of.select("first.doc_id", "first.node", "first.n"), "heads")
    d, h = docs.withColumn("node", wide_prints.node()).alias("d"), heads.hint("shuffle_hash").alias("h")
    same = (F.col("d.node") == F.col("h.node")) & F.col("d.doc_id").eqNullSafe(F.col("h.doc_id"))
    kept = d.join(h, same, "left_semi")
    # Rows of one id and one text are one document.
    return (kept.dropDuplicates(["doc_id", "node"]) if not heads.where("n > 1").isEmpty() else kept).select(docs.columns)


@_apart
def replace_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data and secrets."""
    clean = private_data.replaced(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


@_apart
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, so some not at all and some up to three times."""
    return source_mix.mixed_documents(docs)


@_apart
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in sequences of 2048 tokens."""
    return packing.packed(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("private_data", replace_private_data),
    ("source_mix", mix_sources),
    ("packing", pack_sequences),
]

#: The hashes, models and token vocabulary of the stages are not in SQL; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = docs if k + 1 == len(STAGES) else cut(docs, name)
    return docs
