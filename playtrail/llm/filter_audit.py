"""Filter interaction audit: what each filter removes in every order of the filters.

1. A row's failures are one bit mask.  Rows with equal text share all bits but that of the
   duplicate rule, so duplicates are found on digests, aggregated before each shuffle: a text
   held by a third of all rows is one row for each part of them.
2. Rows are counted by part and mask: at most 2^filters cells a part, whatever the table.
3. Each cell folds over the array of all orders, a constant of the query: ``transform`` over
   orders, ``aggregate`` over steps, giving one weighted struct for each order and step.  A
   part's arrays are summed element by element; nothing is joined with the orders.

Null texts count as empty, null parts as the empty string.  A row repeats a text if a row with a
smaller id has the same text; rows without id never do and make no other row do so, and rows
that share id and text both stay.  An id with several label rows is good or toxic if any says so.
Labels without id are ignored.  An empty table has no parts and so no rows.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Failure conditions over ``text`` and its ``words``.
FILTERS = {
    "A": "size(words) < 200",
    "B": "100L * size(array_distinct(words)) < 50L * size(words)",
    "C": "100L * (octet_length(text) - octet_length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 3L * length(text)",
    "D": "text rlike '[#$%&*|]'",
}
REPEATS = "E"
_WORDS = r"filter(split(text, '[ \\t-\\r]+'), w -> w <> '')"
#: What is counted of a set of rows.
COUNTS = ["n", "good", "toxic"]
SUMS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def _bits(letters: list[str]) -> dict[str, int]:
    return {letter: 1 << k for k, letter in enumerate(letters)}


def failures(docs: DataFrame, filters: dict[str, str], part: str) -> DataFrame:
    """doc_id, part, digest of the text, and the bits of the filters that it fails."""
    bits = _bits(list(filters))
    text = docs.select("doc_id", F.coalesce(part, F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    mask = reduce(Column.__add__, (F.when(F.expr(sql), bits[k]).otherwise(0) for k, sql in filters.items()))
    return text.withColumn("words", F.expr(_WORDS)).select(
        "doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.alias("mask")
    )


def marks(labels: DataFrame) -> DataFrame:
    """Ids that are good or toxic, once each; ``spread`` as in ``labelled``."""
    good, toxic = (F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("long")) for c in ("quality", "toxic"))
    by_id = labels.where("doc_id is not null and (quality = 1 or toxic = 1)").groupBy("doc_id")
    return by_id.agg(good.alias("is_good"), toxic.alias("is_toxic")).withColumn("spread", F.lit(0).cast("long"))


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts of rows with the same id, text and part.  Rows without id join nothing; a second
    key spreads them."""
    each = rows.groupBy("digest", "doc_id", "part", "mask").agg(F.count("*").alias("n"))
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(0)
    joined = each.withColumn("spread", spread).join(marks(labels), ["doc_id", "spread"], "left")
    weighted = (
        (F.coalesce(F.col(c), F.lit(0)) * F.col("n")).alias(name) for c, name in (("is_good", "good"), ("is_toxic", "toxic"))
    )
    return joined.select("digest", "doc_id", "part", "mask", "n", *weighted)


def cells(rows: DataFrame, repeats: int) -> DataFrame:
    """part, mask and COUNTS, with the bit of rows whose text has a smaller id."""
    has_id = F.col("doc_id").isNotNull()
    texts = rows.groupBy("digest", "part", "mask").agg(
        *(F.sum(c).alias(c) for c in COUNTS),
        *(F.sum(F.when(has_id, 0).otherwise(F.col(c))).alias(f"free_{c}") for c in COUNTS),
        F.min(F.when(has_id, F.struct("doc_id", *COUNTS))).alias("least"),
    )
    # A digest has a row for each part here, however many documents hold it.
    first = F.min("least.doc_id").over(Window.partitionBy("digest"))
    leads = F.coalesce(F.col("least.doc_id") == F.col("first"), F.lit(False))
    passes = {c: F.col(f"free_{c}") + F.when(leads, F.col(f"least.{c}")).otherwise(0) for c in COUNTS}
    both = F.array(
        F.struct("mask", *(v.alias(c) for c, v in passes.items())),
        F.struct((F.col("mask") + repeats).alias("mask"), *((F.col(c) - v).alias(c) for c, v in passes.items())),
    )
    split = texts.withColumn("first", first).select("part", F.inline(both)).where("n > 0")
    return split.groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in COUNTS))


def fold(letters: list[str]) -> Column:
    """A cell's structs for all orders and steps, by ``mask`` and COUNTS."""
    bits = _bits(letters)
    orders = F.array(
        *(
            F.struct(F.lit("".join(o)).alias("name"), F.array(*(F.lit(bits[x]) for x in o)).alias("bits"))
            for o in permutations(sorted(letters))
        )
    )
    zero = F.lit(0).cast("long")
    fields = ["filter_order:string", "step:int", "bit:int", *(f"{s}:bigint" for s in SUMS)]
    start = F.struct(
        F.lit(True).alias("alive"), F.array().cast(f"array<struct<{','.join(fields)}>>").alias("steps")
    )

    def step(name: Column):
        def walk(acc: Column, bit: Column) -> Column:
            fails = F.col("mask").bitwiseAND(bit) > 0
            gone = acc["alive"] & fails
            amount = {
                "kept": F.when(acc["alive"] & ~fails, F.col("n")),
                "removed": F.when(gone, F.col("n")),
                "redundant": F.when(fails & ~acc["alive"], F.col("n")),
                "unique_fails": F.when(F.col("mask") == bit, F.col("n")),
                "good_lost": F.when(gone, F.col("good")),
                "toxic_lost": F.when(gone, F.col("toxic")),
            }
            row = F.struct(
                name.alias("filter_order"),
                (F.size(acc["steps"]) + 1).alias("step"),
                bit.alias("bit"),
                *(F.coalesce(amount[s], zero).alias(s) for s in SUMS),
            )
            return F.struct((acc["alive"] & ~fails).alias("alive"), F.concat(acc["steps"], F.array(row)).alias("steps"))

        return walk

    return F.flatten(
        F.transform(orders, lambda o: F.aggregate(o["bits"], start, step(o["name"]), lambda acc: acc["steps"]))
    )


def added(x: Column, y: Column) -> Column:
    """Two arrays of structs, element by element."""
    return F.zip_with(
        x,
        y,
        lambda a, b: F.struct(
            *(a[c].alias(c) for c in ("filter_order", "step", "bit")),
            *((a[s] + b[s]).alias(s) for s in SUMS),
        ),
    )


def audit_filters(
    docs: DataFrame, labels: DataFrame, filters: dict[str, str] = FILTERS, repeats: str = REPEATS, part: str = "lang"
) -> DataFrame:
    """One row for each part, order of the filters and step, with SUMS and ``shapley``: what
    the step's filter removes, summed over all orders.

    ``filters``: a letter and a failure condition over ``text`` and ``words`` each; ``repeats``:
    the letter of the duplicate rule, whose filter is last in the mask.  At most six in all."""
    letters = [*filters, repeats]
    if len(letters) > 6:
        raise ValueError("orders grow with the factorial of the filters: at most six")
    counted = cells(labelled(failures(docs, filters, part), labels), _bits(letters)[repeats])
    # At most 2^6 arrays a part meet here.
    folded = counted.select("part", fold(letters).alias("steps")).groupBy("part").agg(F.collect_list("steps").alias("all"))
    rest = F.slice("all", F.lit(2), F.size("all"))
    total = folded.select("part", F.aggregate(rest, F.element_at("all", 1), added).alias("total"))
    zero = F.lit(0).cast("long")
    bits = F.array(*(F.lit(b) for b in _bits(letters).values()))
    removed_by = F.transform(
        bits,
        lambda bit: F.aggregate("total", zero, lambda s, x: s + F.when(x["bit"] == bit, x["removed"]).otherwise(zero)),
    )
    rows = total.withColumn("by_filter", removed_by).select("part", "by_filter", F.inline("total"))
    at = F.array_position(bits, F.col("bit")).cast("int")
    return rows.select("part", "filter_order", "step", *SUMS, F.element_at("by_filter", at).alias("shapley"))
