"""From raw documents to packed sequences, in five stages; see STAGES.

Each stage takes any columns beside doc_id and text: they travel in one struct, so that no name
clashes with an operator's own, and come out as they went in. doc_id may be null or repeated:
rows are told apart by doc_id and text together. An empty table stays empty. Very long texts are
worked on whole, each as a batch of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrascape.llm import mixing, packing, prefixjoin, quality, suffix
from terrascape.llm.common import discard, scratch, table, written
from terrascape.llm.queries import tokenizer_path

_ABSENT = -(1 << 63)


def enclosed(docs: DataFrame) -> DataFrame:
    """doc_id, text, rest: all other columns as one."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", (F.struct(*others) if others else F.lit(0)).alias("rest"))


def opened(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """rows of enclosed(docs) with the columns of docs."""
    return rows.select(*[F.col(c) if c in ("doc_id", "text") else F.col("rest").getField(c).alias(c) for c in docs.columns])


def without(rows: DataFrame, gone: DataFrame, text_key) -> DataFrame:
    """rows whose doc_id (null equals null) and text key aren't among gone(doc_id, key)."""
    at = gone.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_ABSENT)).alias("_doc"), F.col("key").alias("_key"))
    named = rows.select("*", F.coalesce(F.col("doc_id").cast("long"), F.lit(_ABSENT)).alias("_doc"), text_key.alias("_key"))
    return named.join(at, ["_doc", "_key"], "left_anti").drop("_doc", "_key")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject.

    A null text is scored as an empty one. Each row is judged by its text alone, so equal texts
    fare alike; at a score of exactly 0.5 a row stays. Without labels all rows stay.
    """
    model = quality.trained(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return opened(quality.classify(enclosed(docs), model).where("predicted = 1"), docs)


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links of 5-word shingle similarity of 0.8 join, one row: that of the smallest doc_id.

    A row with a null doc_id stays only where no row of its group has one. Of rows of one doc_id
    the one with the least hash of its text stays, and of rows that are equal in both any one.
    Null and empty texts, and texts without words, are linked with nothing, so all of them stay.
    """
    found = prefixjoin.classed(docs.select("doc_id", "text"), n=5, t="0.8").where("class_key IS NOT NULL")
    found = written(found.groupBy("class_key", "doc_id", "th").agg(F.count("*").alias("n")), "similar")
    kept = found.groupBy("class_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("kept"))
    marked = found.join(kept, "class_key").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("th") == F.col("kept.th")))
    gone = written(marked.where("NOT stays").select("doc_id", F.col("th").alias("key")), "similar-gone")
    again = written(marked.where("stays AND n > 1").select("doc_id", F.col("th").alias("key")), "similar-again")
    rows, key = enclosed(docs), F.xxhash64("text")
    out = without(rows, gone, key)
    if not again.isEmpty():
        named = F.coalesce(F.col("doc_id").cast("long"), F.lit(_ABSENT))
        at = again.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_ABSENT)).alias("_doc"), F.col("key").alias("_key"))
        repeated = out.select("*", named.alias("_doc"), key.alias("_key")).join(at, ["_doc", "_key"], "left_semi").dropDuplicates(["_doc", "_key"]).drop("_doc", "_key")
        out = without(out, again, key).unionByName(repeated)
    return opened(out, docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the strings of 200 bytes that start elsewhere too; n_chars follows, if there.

    A null text stays null; a text may end up empty. Repeated rows are repeats of each other.
    """
    rows = suffix.deduplicated(enclosed(docs)).select("doc_id", "text", "rest")
    out = opened(rows, docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with its fitted rate as its chance to stay; clean ones have rates of about 1, rates above 1 count as 1, so none is repeated.

    A document's chance is drawn from the hash of doc_id and text, so repeated rows fare alike. A
    null or empty text has the prior as its posterior. Without labels all rows stay.
    """
    fate = mixing.mixed(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    gone = fate.where("copies = 0").select("doc_id", F.col("row_hash").alias("key")).distinct()
    return opened(without(enclosed(docs), gone, F.xxhash64("doc_id", "text")), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 2048 tokens.

    The last stage: columns other than doc_id are dropped. A null text counts as empty and has its
    closing id; a very long one is cut into pieces; repeated rows are packed each for itself, and of
    equal lengths the order of doc_id and text decides who takes which place. No rows give no pieces.
    """
    return packing.pack(docs.select("doc_id", "text"), tokenizer_path())


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_one_of_similar),
    ("suffix-array dedup", cut_repeats),
    ("mixing sources to target weights", mix_to_targets),
    ("best-fit packing", pack_sequences),
]

#: SQL can't express the trained classifiers or the tokenizer; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        if i + 1 == len(STAGES):
            return stage(spark, docs, sf_dir)
        with scratch():
            docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"), keep=True)
        if last is not None:
            discard(last)
        last = docs
