"""Fill-in-middle: texts cut into prefix, middle and suffix at unit boundaries, and put in another order.

A unit is a run of ASCII letters or any other code point. Runs of units are
exploded to rows, window sums give where each begins, and the cut requests (two
ordinals a document) join the run that holds their unit. Only these runs are
exploded to single units, whose running lengths give the cut's offset; offsets
are aggregated per document and the texts are cut there. So a text of any
length has one row for `run_units` units, and single units as rows only twice.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The unit and the marks of the three parts.
UNIT = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


@dataclass(frozen=True)
class FillParams:
    """Of 100 documents 'plain' stay as they are; of 100 others 'spm' begin with the suffix. salt goes before the key in the hash that decides."""

    salt: str = "1:"
    plain: int = 10
    spm: int = 20
    run_units: int = 256


def _draws(key: Column, salt: str) -> list[Column]:
    """Four unsigned 32-bit numbers of a key; a null key is hashed as an empty one."""
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _offsets(base: DataFrame, p: FillParams) -> DataFrame:
    """id, prefix_end and middle_end (code points) of the documents that are cut."""
    run = f"(?:[A-Za-z]++|[^A-Za-z]){{1,{p.run_units}}}+"
    runs = base.select("id", F.posexplode(F.regexp_extract_all("body", F.lit(run), 0)).alias("nth", "run"))
    runs = runs.withColumn("units", F.length(F.regexp_replace("run", "[A-Za-z]+", "x"))).withColumn("chars", F.length("run"))
    before = Window.partitionBy("id").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("id", "run", "units", F.coalesce(F.sum("units").over(before), F.lit(0)).alias("first"), F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("at"))

    h1, h2, _, _ = _draws(F.col("id.key"), p.salt)
    a, b = h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)
    # No filter on the form: it would be pushed below the exchange and make another one.
    both = F.when(F.col("form") != "plain", F.array(F.least(a, b), F.greatest(a, b)))
    requests = base.select(F.col("id").alias("of"), F.posexplode(both).alias("which", "ordinal"))
    asked = runs.join(requests.hint("shuffle_hash"), (F.col("id") == F.col("of")) & (F.col("ordinal") > F.col("first")) & (F.col("ordinal") <= F.col("first") + F.col("units")))

    units = asked.select("id", "which", "at", (F.col("ordinal") - F.col("first")).alias("place"), F.posexplode(F.regexp_extract_all("run", F.lit(UNIT), 0)).alias("nth", "unit"))
    upto = F.sum(F.length("unit")).over(Window.partitionBy("id", "which").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0))
    ends = units.select("id", "which", "place", "nth", (F.col("at") + upto).alias("end")).filter("nth + 1 = place")
    return ends.groupBy("id").agg(F.max(F.when(F.col("which") == 0, F.col("end"))).alias("prefix_end"), F.max(F.when(F.col("which") == 1, F.col("end"))).alias("middle_end"))


def fill_in_middle(docs: DataFrame, p: FillParams = FillParams(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, n (units), form, prefix_chars, middle_chars, output.

    form is plain (output is the text), psm or spm. Plain are empty and null texts
    (output is then empty), texts that contain a mark, and those that the draw
    leaves as they are; their counts of characters are null. A null key is drawn
    as an empty one. Rows stand on their own: repeated keys and repeated rows
    each give a row, and rows are dealt evenly whatever their key.

    Texts are shuffled once. The exchange is read by the explosion, by the cut
    requests and by the last join, and everything up to that join stays within
    its partitions. Other columns of docs aren't read.
    """
    _, _, h3, h4 = _draws(F.col("id.key"), p.salt)
    base = docs.select(F.struct(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("key")).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("body")).repartition("id")
    marked = F.col("body").contains(PREFIX) | F.col("body").contains(SUFFIX) | F.col("body").contains(MIDDLE)
    form = F.when((F.col("body") == "") | marked | (h3 % 100 >= 100 - p.plain), "plain").when(h4 % 100 < p.spm, "spm").otherwise("psm")
    base = base.select("id", "body", F.length(F.regexp_replace("body", "[A-Za-z]+", "x")).cast("long").alias("n"), form.alias("form"))

    offsets = _offsets(base, p).withColumnRenamed("id", "of")
    out = base.join(offsets.hint("shuffle_hash"), F.col("id") == F.col("of"), "left")
    cut = F.col("form") != "plain"
    a, b = F.coalesce("prefix_end", F.lit(0)).cast("int"), F.coalesce("middle_end", F.lit(0)).cast("int")
    out = out.select(F.col("id.key").alias(key), "n", "form", "body", F.when(cut, a).cast("long").alias("prefix_chars"), F.when(cut, b - a).cast("long").alias("middle_chars"))
    prefix, middle = F.expr("substring(body, 1, int(prefix_chars))"), F.expr("substring(body, int(prefix_chars) + 1, int(middle_chars))")
    suffix = F.expr("substring(body, int(prefix_chars + middle_chars) + 1)")
    output = (
        F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
        .otherwise(F.col("body"))
    )
    return out.select(key, "n", "form", "prefix_chars", "middle_chars", output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that fill_in_middle has cut. The parts contain no mark, and no part's end makes one with the mark that follows."""
    first = F.substring_index(F.substring_index(output, PREFIX, -1), SUFFIX, 1)
    after = F.substring_index(output, SUFFIX, -1)
    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(first, middle, F.substring_index(after, MIDDLE, 1))
    spm = F.concat(F.substring_index(F.substring_index(output, PREFIX, -1), MIDDLE, 1), middle, F.substring_index(after, PREFIX, 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_digest(docs: DataFrame, p: FillParams = FillParams(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """fill_in_middle with the sha256 of the output and of the text restored from it in place of the output."""
    out = fill_in_middle(docs, p, key, text)
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select(key, "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
