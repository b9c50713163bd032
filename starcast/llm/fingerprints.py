"""Winnowed fingerprints of whole texts, and how they change when a text is edited. DataFrame functions only.

The tokens of a text are its runs without white space of up to ``TOKEN_CHARS`` characters, and each character of longer
ones (text in scripts without spaces, encoded data, minified code), so that no token depends on where a long run starts.
Each ``k`` tokens in a row have a hash, and of each ``window`` hashes in a row the smallest, of equal ones the rightmost,
is selected. Whatever two texts share over ``k + window - 1`` tokens, they share a selected hash for. The fingerprint is
the selected hashes with their positions (the number of the first token).

Likeness is the Jaccard similarity of the sets of selected hashes; two empty fingerprints are alike (1.0).

Null and empty texts have an empty fingerprint, and a text of fewer than ``k`` tokens has one hash of all of them.
Rows that repeat id and text are one document and get the same result, each. Missing ids come after all others, equal
ids are ordered by a hash of the text, and a single document follows itself. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starcast.session import materialize

K, WINDOW = 4, 8
TOKEN_CHARS = 32
# A selected hash and its position in one number: the hash above, and below it what makes the rightmost the smallest.
HASH_BITS, POSITION_BITS = 39, 24
LAST_POSITION = (1 << POSITION_BITS) - 1


def selected(text: Column, k: int = K, window: int = WINDOW) -> Column:
    """The selected hashes with their positions, as numbers, in the order of the text."""
    tokens = F.regexp_extract_all(text, F.lit(rf"(?<!\S)\S{{1,{TOKEN_CHARS}}}(?!\S)|\S"), F.lit(0))

    def numbered(value: Column, position: Column) -> Column:
        return F.shiftleft(F.shiftrightunsigned(value, 64 - HASH_BITS), POSITION_BITS) + (
            F.lit(LAST_POSITION) - position % (LAST_POSITION + 1)
        )

    def hashes(words: Column) -> Column:
        several = F.transform(
            F.sequence(F.lit(0), F.size(words) - k),
            lambda i: numbered(F.xxhash64(*[words[i + j] for j in range(k)]), i.cast("long")),
        )
        single = F.array(numbered(F.xxhash64(words), F.lit(0).cast("long")))
        empty = F.array().cast("array<long>")
        return F.when(F.size(words) == 0, empty).when(F.size(words) < k, single).otherwise(several)

    def minima(values: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(values) - window + 1))
        least = F.transform(starts, lambda i: F.array_min(F.slice(values, i, window)))
        return F.when(F.size(values) == 0, values).otherwise(F.array_distinct(least))

    # Arrays of one element carry each intermediate array into the next step, so it is computed once.
    made = F.transform(F.array(tokens), hashes)
    return F.transform(made, minima)[0]


def hashes_of(chosen: Column) -> Column:
    return F.array_distinct(F.transform(chosen, lambda c: F.shiftrightunsigned(c, POSITION_BITS)))


def fingerprint(chosen: Column) -> Column:
    """``hash:position`` of the selected hashes, separated by commas."""

    def entry(c: Column) -> Column:
        position = F.lit(LAST_POSITION) - c % (LAST_POSITION + 1)
        return F.concat(F.lower(F.lpad(F.hex(F.shiftrightunsigned(c, POSITION_BITS)), 10, "0")), F.lit(":"), position)

    return F.array_join(F.transform(chosen, entry), ",")


def likeness(a: Column, b: Column) -> Column:
    """Of two columns of selected hashes."""
    x, y = hashes_of(a), hashes_of(b)
    both = F.size(F.array_intersect(x, y))
    all_ = F.size(x) + F.size(y) - both
    return F.when(all_ == 0, 1.0).otherwise(both / all_)


def followers(slim: DataFrame) -> DataFrame:
    """``id``, ``text_key``, ``present``, ``n_chars`` of each document and ``next_id``, ``next_key`` of the one that follows it.

    Documents are ordered by descending id; the first follows the last. Ranges of ids are dealt to tasks and ordered
    there. Only the first document of each range is compared across ranges.
    """
    order = [F.desc("present"), F.desc("id"), F.desc("text_key")]
    ranged = materialize(
        slim.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranges"
    )
    within = Window.partitionBy("range").orderBy(*order)
    document = F.struct("present", "id", "text_key")
    led = ranged.withColumn("following", F.lead(document).over(within))
    firsts = ranged.groupBy("range").agg(F.max(document).alias("first"))
    across = Window.orderBy("range")
    whole = across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = firsts.select(
        "range", F.coalesce(F.lead("first").over(across), F.first("first").over(whole)).alias("after")
    )
    following = F.coalesce("following", "after")
    return led.join(after, "range").select(
        "id", "text_key", "present", "n_chars", following["id"].alias("next_id"), following["text_key"].alias("next_key")
    )


def edit_report(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """Fingerprints of all texts and of their edited versions, in which the last third is replaced by the beginning of
    the document that follows.

    The texts are shuffled once, by document. Of each, its fingerprint and as much of its beginning as is needed go to
    the document before.
    """
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"),
        F.xxhash64(text, F.col("doc_id").isNull()).alias("text_key"),
        F.col("doc_id").isNotNull().alias("present"),
        text.alias("text"),
    )
    slim = keyed.groupBy("id", "text_key", "present").agg(F.max(F.char_length("text")).alias("n_chars"))
    order = followers(slim)
    rows = keyed.select("id", "text_key", "text", selected(F.col("text"), k, window).alias("chosen"))
    senders = order.select(
        F.col("next_id").alias("id"),
        F.col("next_key").alias("text_key"),
        F.col("id").alias("to_id"),
        F.col("text_key").alias("to_key"),
        F.col("present").alias("to_present"),
        F.floor(F.col("n_chars") / 3).cast("int").alias("n_replaced"),
    )
    # Both joins ask for the same columns of the texts in the same order, so one shuffle serves both.
    sent = rows.join(senders, ["id", "text_key"]).select(
        F.col("to_id").alias("id"),
        F.col("to_key").alias("text_key"),
        F.col("to_present").alias("present"),
        "n_replaced",
        F.expr("substring(text, 1, n_replaced)").alias("beginning"),
        F.col("chosen").alias("next_chosen"),
    )
    sent = sent.dropDuplicates(["id", "text_key"])
    joined = rows.join(sent, ["id", "text_key"])
    n = F.char_length("text")
    edited = F.concat(F.expr("substring(text, 1, char_length(text) - n_replaced)"), F.col("beginning"))
    made = joined.select("id", "present", n.cast("long").alias("n_chars"), "chosen", "next_chosen", edited.alias("edited"))
    made = made.withColumn("edited_chosen", selected(F.col("edited"), k, window))
    return made.select(
        F.when(F.col("present"), F.col("id")).alias("doc_id"),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("chosen")).alias("fingerprint"),
        fingerprint(F.col("edited_chosen")).alias("edited_fingerprint"),
        likeness(F.col("chosen"), F.col("edited_chosen")).alias("near_edited"),
        likeness(F.col("chosen"), F.col("next_chosen")).alias("near_next"),
    )
