"""Fill-in-middle arrangements of whole texts, cut between words by hashes of doc_id; all in Spark's own functions.

The units of a text are its words with the white space before them, and what white space is left
at its end. Sentinels mark the parts of an arrangement, and from them the text is rebuilt: a
sentinel starts with a sign that it holds nowhere else, so none can lie over the edge of two
parts, and texts that hold a sentinel themselves stay plain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words with the white space before them, and white space that no word follows.
UNITS = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINEL = "<[PSM]>"


def hashes(doc_id: Column, seed: int, n: int = 4) -> list[Column]:
    """The first n groups of 8 hex digits of sha256 of `seed:doc_id`, as longs; a null doc_id counts as an empty one."""
    hexed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(hexed, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(n)]


def arranged(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """doc_id, n (units), form, prefix, middle, output: each text cut in three and put together anew.

    rate: per cent of texts that are cut; spm: per cent of those whose suffix comes first. A text
    that is null or empty, or holds a sentinel, stays plain; its prefix and middle are null. Other
    columns of docs are left out. Rows are arranged each for itself, so repeated rows fare alike
    and an empty table gives none; a long text is one array of units in its task.
    """
    h1, h2, h3, h4 = hashes(F.col("doc_id"), seed)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), *(h.alias(f"h{i}") for i, h in enumerate((h1, h2, h3, h4), 1)))
    rows = rows.withColumn("units", F.regexp_extract_all("text", F.lit(UNITS), F.lit(0))).withColumn("n", F.size("units").cast("long"))
    plain = (F.col("text") == "") | F.col("text").rlike(SENTINEL) | (F.col("h3") % 100 >= rate)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm")
    cuts = [F.col(h) % (F.col("n") + 1) for h in ("h1", "h2")]
    rows = rows.select("doc_id", "n", "text", "units", form.alias("form"), F.least(*cuts).cast("int").alias("a"), F.greatest(*cuts).cast("int").alias("b"))
    cut = F.col("form") != "plain"
    part = lambda start, length: F.when(cut, F.array_join(F.slice("units", start, length), ""))
    a, b = F.col("a"), F.col("b")
    rows = rows.select("doc_id", "n", "text", "form", part(F.lit(1), a).alias("prefix"), part(a + 1, b - a).alias("middle"), part(b + 1, F.greatest(F.col("n").cast("int") - b, F.lit(0))).alias("suffix"))
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm_ = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm_).otherwise(F.col("text"))
    return rows.select("doc_id", "n", "form", "prefix", "middle", output.alias("output"))


def restored(arranged: DataFrame) -> DataFrame:
    """The rows with `text`, rebuilt from output and form alone; a null output stays null."""
    rows = arranged.withColumn("_parts", F.when(F.col("form") != "plain", F.split("output", SENTINEL, -1)))
    part = lambda i: F.get("_parts", F.lit(i))
    text = F.when(F.col("form") == "psm", F.concat(part(1), part(3), part(2))).when(F.col("form") == "spm", F.concat(part(2), part(3), part(1))).otherwise(F.col("output"))
    return rows.withColumn("text", text).drop("_parts")


def digests(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """doc_id, n, form, code points of prefix and middle, and the sha256 of output and of the text rebuilt from it."""
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    rows = restored(arranged(docs, seed, rate, spm))
    return rows.select(
        "doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        sha("output").alias("output_sha256"), sha("text").alias("restored_sha256"),
    )
