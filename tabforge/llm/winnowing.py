"""Operator 6, document fingerprints by winnowing, in DataFrame functions alone.

Each run of `GRAM` words has a rolling hash, the cyclic polynomial of its words' hashes (rotate and exclusive-or). Of each
`WINDOW` neighbouring hashes the smallest is chosen, of equal ones the rightmost, and kept with the position of its first
word. Two texts that share `GRAM + WINDOW - 1` words in a row therefore share a fingerprint entry, and its positions say
where. Hash and position travel in one long, the position inverted in the low bits, so a plain minimum breaks ties to the
right; the minimum of a window is built by doubling (2, 4, 8, 16 hashes) with zip_with, which costs four passes over an
array whatever the window.

The hash of a gram is the value that rolling gives (turn the last value, take out the word that leaves, put in the one that
comes), written as its GRAM terms: a function over an array cannot carry a value from element to element without copying
the array at each step.

Every intermediate array is a column of its own that is read more than once, so the optimizer does not inline it into the
function that is applied to each element.

Order of the rows: descending doc_id, then rows without one; rows of equal ids by the hash of their text; equal rows stand
one after another, so all but the last of them are followed by their own text. The last row is followed by the first.

Defined cases: a null text counts as empty; a text without words has an empty fingerprint, and two empty fingerprints are
alike (1.0); a text of fewer words than a gram has one entry for all of them; every row has a row in the result, also
without an id or with a repeated one; one document is its own successor; an empty table gives an empty result; texts of
2**27 words and more raise an error. Only `doc_id` and `text` are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabforge.llm.common import checkpoint

GRAM, WINDOW = 5, 16
POSITION_BITS = 27
_LAST = (1 << POSITION_BITS) - 1
BLANKS = " \t\n\v\f\r"


def _rotated(x: Column, by: int) -> Column:
    return F.shiftleft(x, by).bitwiseOR(F.shiftrightunsigned(x, 64 - by)) if by else x


def fingerprinted(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with out: the chosen entries of the text column (array of long), in order of position."""
    w, x, g, m = (f"_{out}_{s}" for s in "wxgm")
    clean = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(BLANKS))
    df = df.withColumn(w, F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(F.lower(clean), r"[\x20\x09-\x0D]+")))
    df = df.withColumn(x, F.when(F.size(w) > _LAST, F.raise_error(F.lit("a text has too many words"))).otherwise(F.transform(w, lambda s: F.xxhash64(s))))
    n = F.size(x)
    hashed = lambda i: _fold([_rotated(F.get(x, i + k), GRAM - 1 - k) for k in range(GRAM)])
    entry = lambda h, i: F.shiftleft(F.shiftrightunsigned(h, POSITION_BITS + 1), POSITION_BITS).bitwiseOR(F.lit(_LAST).cast("long") - i)
    grams = F.transform(F.sequence(F.lit(0), n - GRAM), lambda i: entry(hashed(i), i))
    short = F.array(entry(F.xxhash64(x), F.lit(0)))
    df = df.withColumn(g, F.when(n == 0, F.array().cast("array<long>")).when(n < GRAM, short).otherwise(grams))
    step, at = 1, g
    while step < WINDOW:
        name = f"{m}{step}"
        df = df.withColumn(name, F.zip_with(at, F.slice(at, step + 1, F.greatest(F.size(at), F.lit(1))), lambda a, b: F.least(a, b)))
        at, step = name, step * 2
    whole = F.slice(at, 1, F.greatest(F.size(at) - WINDOW + 1, F.lit(1)))
    kept = [c for c in df.columns if not c.startswith(f"_{out}_")]
    return df.select(*kept, F.array_distinct(whole).alias(out))


def _fold(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out.bitwiseXOR(p)
    return out


def hashes(entries: Column) -> Column:
    """The set of hashes of a fingerprint."""
    return F.array_distinct(F.transform(entries, lambda e: F.shiftright(e, POSITION_BITS)))


def written(entries: Column) -> Column:
    """A fingerprint as text: hash in hexadecimal, colon, position; entries parted by spaces."""
    return F.array_join(F.transform(entries, lambda e: F.concat(F.lower(F.hex(F.shiftright(e, POSITION_BITS))), F.lit(":"), (F.lit(_LAST).cast("long") - e.bitwiseAND(F.lit(_LAST).cast("long"))).cast("string"))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two hash sets; 1 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))


KEY = ["none", "down", "h"]


def successors(keys: DataFrame, at_once: int = 200_000) -> DataFrame:
    """keys with next (none, down, h): the key that follows in their order; the first follows the last.

    The keys are dealt to ranges of about at_once and ordered within each; the ranges' first keys (one row a range) meet on
    the driver, where each range learns what follows its end.
    """
    whole = F.struct(*KEY)
    parts = max(1, -(-keys.count() // at_once))
    ranged = checkpoint(keys.repartitionByRange(parts, *KEY).withColumn("_range", F.spark_partition_id()))
    heads = ranged.groupBy("_range").agg(F.min(whole).alias("head")).orderBy("_range").collect()
    if not heads:
        return keys.withColumn("next", whole)
    after = [(r["_range"], *n["head"]) for r, n in zip(heads, [*heads[1:], heads[0]])]
    ends = keys.sparkSession.createDataFrame(after, "_range int, none boolean, down long, h long").select("_range", whole.alias("_after"))
    follows = F.lead(whole).over(Window.partitionBy("_range").orderBy(*KEY))
    return ranged.withColumn("next", follows).join(F.broadcast(ends), "_range").withColumn("next", F.coalesce("next", "_after")).drop("_range", "_after")


def compared(docs: DataFrame, copies_at_once: int = 1000, at_once: int = 200_000) -> DataFrame:
    """Fingerprint of each text and of its edited text, and their likeness; the end of a text gives way to the start of the next document.

    The documents are shuffled once, by their key, for both sides of the join; what is sent on from a document to its
    predecessor is the start that is needed and the hash set. Equal rows are worked on once and written out as often as
    they occur.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").isNull().alias("none"), F.bitwise_not(F.coalesce(F.col("doc_id").cast("long"), F.lit(0))).alias("down"), F.xxhash64(text).alias("h"), text.alias("text"))
    keys = rows.groupBy(*KEY).agg(F.count("*").alias("n"), F.min(F.floor(F.char_length("text") / 3).cast("int")).alias("need"))
    chain = successors(keys, at_once)
    often = chain.where("n > 1")
    chain = chain.select(*KEY, "next", "need", F.lit(1).cast("long").alias("times"))
    if often.take(1):
        rows = rows.groupBy(*KEY).agg(F.min("text").alias("text"))
        more = often.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 2, F.lit(copies_at_once).cast("long"))))
        chain = chain.unionByName(more.select(*KEY, F.struct(*KEY).alias("next"), "need", F.least(F.lit(copies_at_once).cast("long"), F.col("n") - 1 - F.col("_from")).alias("times")))
    # both sides read the key, text and entries, so that Spark computes and shuffles them once
    printed = fingerprinted(rows, "text", "entries").repartition(*KEY)
    asked = chain.select(F.struct(*KEY).alias("asks"), "need", "times", *[F.col(f"next.{c}").alias(c) for c in KEY])
    sent = printed.join(asked, KEY).select("asks.*", "times", F.col("text").substr(F.lit(1), F.col("need")).alias("start"), hashes(F.col("entries")).alias("next_hashes"))
    both = printed.join(sent, KEY).withColumn("hashes", hashes(F.col("entries")))
    n = F.char_length("text")
    edited = F.concat(F.col("text").substr(F.lit(1), (n - F.floor(n / 3)).cast("int")), F.col("start"))
    doc_id = F.when(~F.col("none"), F.bitwise_not("down"))
    both = both.select(doc_id.alias("doc_id"), n.cast("long").alias("n_chars"), "entries", "hashes", "next_hashes", edited.alias("edited"), "times")
    both = fingerprinted(both, "edited", "edited_entries").withColumn("edited_hashes", hashes(F.col("edited_entries")))
    out = both.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        written(F.col("entries")).alias("fingerprint"), written(F.col("edited_entries")).alias("edited_fingerprint"),
        likeness(F.col("hashes"), F.col("edited_hashes")).alias("near_edited"), likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"), "times",
    )
    return out.withColumn("times", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("times")
