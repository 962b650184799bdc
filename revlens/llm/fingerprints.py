"""Document fingerprints by consistent weighted sampling, in SQL functions only.

Terms are lower-cased runs of anything but white space, weighted by count times a factor of the
word's length, which keeps short function words from making all texts of a language alike. For
each of the samples a term gets two Gamma(2, 1) numbers and one uniform from hashes of
itself; its weight is rounded to a step of its own grid, and the term with the least value wins.
Two texts get the same winner with a probability equal to their generalised Jaccard similarity.
The least value itself identifies term and step, so it stands for the winner.

Defined cases: a null text is empty, an empty or blank text has the empty word as its only term,
equal texts have equal fingerprints, rows of one id follow each other by text, a single document is
its own successor, a null id comes first.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.session import materialise

from .ranges import range_bounds, range_number

SAMPLES = 32
_PART = 8


def _uniforms(hashed: Column) -> tuple[Column, Column]:
    """Two uniforms in (0, 1) from the halves of a hash."""
    scale = F.lit(2.0**-32)
    upper = F.shiftrightunsigned(hashed, 32).cast("double")
    lower = hashed.bitwiseAND(F.lit(0xFFFFFFFF)).cast("double")
    return (upper + 0.5) * scale, (lower + 0.5) * scale


def sample_value(term_hash: Column, log_weight: Column, number: int) -> Column:
    """Logarithm of a term's value in one sample; the least one wins."""
    first, second = _uniforms(F.xxhash64(term_hash, F.lit(3 * number)))
    third, fourth = _uniforms(F.xxhash64(term_hash, F.lit(3 * number + 1)))
    shift, _ = _uniforms(F.xxhash64(term_hash, F.lit(3 * number + 2)))
    rate = -F.log(first * second)
    gamma = -F.log(third * fourth)
    step = F.floor(log_weight / rate + shift)
    return F.log(gamma) - rate * (step - shift + 1)


def fingerprint_texts(texts: DataFrame, keys: list[str], text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """``keys`` and ``fingerprint`` (8 hex digits for each sample) of texts that ``keys`` identify.

    No shuffle where the rows are dealt by some of ``keys`` already.
    """
    word = F.explode(F.split(F.trim(F.lower(F.coalesce(F.col(text), F.lit("")))), r"\s+"))
    counts = texts.select(*keys, word.alias("_word")).groupBy(*keys, "_word").agg(F.count("*").alias("_count"))
    length = F.char_length("_word")
    terms = counts.select(
        *keys, F.xxhash64("_word").alias("_term"),
        F.log(F.col("_count") * F.greatest(length, F.lit(1)) * F.greatest(length, F.lit(1))).alias("_weight"))
    least = terms.groupBy(*keys).agg(*[
        F.min(sample_value(F.col("_term"), F.col("_weight"), number)).alias(f"_{number}") for number in range(samples)])
    parts = [F.lpad(F.lower(F.hex(F.xxhash64(f"_{number}").bitwiseAND(F.lit(0xFFFFFFFF)))), _PART, "0") for number in range(samples)]
    return least.select(*keys, F.concat(*parts).alias("fingerprint"))


def likeness(left: Column, right: Column, samples: int = SAMPLES) -> Column:
    """Part of the samples that two fingerprints share."""
    part = lambda column, number: F.substring(column, number * _PART + 1, _PART)
    same = [(part(left, number) == part(right, number)).cast("int") for number in range(samples)]
    return sum(same[1:], same[0]) / F.lit(float(samples))


def in_order(documents: DataFrame, key: str, text: str) -> DataFrame:
    """Key and text with a range of keys (``bucket``), the place in it (``place``), and
    ``next_text``, the text of the following row by key; after the last row comes the first.

    Ranges follow from approximate percentiles of the key, about as many as a range has rows, so
    no task sorts more than one range at a time.
    """
    rows = documents.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    ranges = math.ceil(math.sqrt(max(1, rows.count())))
    rows = rows.withColumn("bucket", range_number(F.col("_key"), range_bounds(rows, "_key", ranges)))
    heads = rows.groupBy("bucket").agg(F.min("_key").alias("_head"), F.max(F.col("_key").isNull()).alias("_null"))
    heads = heads.withColumn("_head", F.when(F.col("_null"), None).otherwise(F.col("_head"))).drop("_null")
    # Alphabetically first text among the rows of a range's first key.
    heads = rows.join(heads.withColumnRenamed("bucket", "_b"), (F.col("bucket") == F.col("_b")) & F.col("_key").eqNullSafe(F.col("_head"))) \
        .groupBy("bucket").agg(F.min("_text").alias("_first"))
    heads = materialise(heads, "range-heads")
    everywhere = Window.orderBy("bucket")
    follows = heads.select("bucket", F.lead("bucket").over(everywhere).alias("_next"))
    first = heads.agg(F.min("bucket")).first()[0]
    tails = follows.select("bucket", F.coalesce("_next", F.lit(first)).alias("_next")).join(
        heads.select(F.col("bucket").alias("_next"), F.col("_first").alias("_tail")), "_next").select("bucket", "_tail", F.col("_next").alias("next_bucket"))
    inside = Window.partitionBy("bucket").orderBy("_key", "_text")
    return (
        rows.withColumns({"place": F.row_number().over(inside), "_lead": F.lead("_text").over(inside)})
        .join(tails, "bucket")
        .select("bucket", "place", "next_bucket", F.col("_key").alias(key), F.col("_text").alias(text),
                F.coalesce("_lead", "_tail").alias("next_text"))
    )


def fingerprint_with_edits(documents: DataFrame, key: str = "doc_id", text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last half is replaced by the
    beginning of the next document, with their likeness and that to the next document."""
    rows = in_order(documents, key, text)
    size = F.char_length(text)
    half = F.floor(size / 2).cast("int")
    rows = rows.withColumns({
        "n_chars": size.cast("long"),
        "_edited": F.concat(F.substring(F.col(text), F.lit(1), size - half), F.substring(F.col("next_text"), F.lit(1), half)),
    })
    sides = rows.select("bucket", "place", F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col(text).alias("_body")),
        F.struct(F.lit(1).alias("side"), F.col("_edited").alias("_body")))).alias("_side")).select("bucket", "place", "_side.*")
    prints = fingerprint_texts(sides, ["bucket", "place", "side"], "_body", samples)
    both = prints.groupBy("bucket", "place").agg(
        F.max(F.when(F.col("side") == 0, F.col("fingerprint"))).alias("fingerprint"),
        F.max(F.when(F.col("side") == 1, F.col("fingerprint"))).alias("edited_fingerprint"))
    about = rows.select("bucket", "place", "next_bucket", key, "n_chars", F.sha2("_edited", 256).alias("edited_sha256"))
    stored = materialise(about.join(both, ["bucket", "place"]), "fingerprints")
    heads = stored.filter(F.col("place") == 1).select(F.col("bucket").alias("next_bucket"), F.col("fingerprint").alias("_tail"))
    following = F.lead("fingerprint").over(Window.partitionBy("bucket").orderBy("place"))
    return (
        stored.withColumn("_lead", following).join(heads, "next_bucket")
        .select(key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                likeness(F.col("fingerprint"), F.col("edited_fingerprint"), samples).alias("near_edited"),
                likeness(F.col("fingerprint"), F.coalesce("_lead", "_tail"), samples).alias("near_next"))
    )
