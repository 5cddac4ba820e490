"""Document fingerprints by a homomorphic multiset hash, with DataFrame functions only.

Each piece of a paragraph (a line, cut further after sentence marks) is hashed to a vector of
LANES values of 12 bits; a fingerprint is the lane-wise sum over all pieces modulo 2^44, with the
number of pieces as a last lane.  A text of 2^31 bytes, the most that Spark holds, has less than
2^31 pieces, so its sums stay below 2^43 and neither they nor their deviations wrap.  Sums do not depend on the order of paragraphs, and a paragraph is
inserted or deleted by adding or subtracting its own fingerprint.  As the lanes are independent,
the cosine of two centred fingerprints estimates the cosine of the two multisets of pieces, with a
standard error of about 1/sqrt(LANES).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANES = 64
#: A value, and the bits of a sum that are carried in the first of two ints.
VALUE, LOW_BITS = 0xFFF, 31
MODULUS, MIDDLE = 1 << 44, 2047.5
#: Rows of one bucket of the order by id, and the most buckets.
BUCKET_ROWS, MOST_BUCKETS = 20_000, 500


def pieces(text: Column) -> Column:
    return F.filter(F.split(text, r"\n|(?<=[.,;:!?|])\s+"), lambda p: p != "")


def with_fingerprint(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """df with array<bigint> column `out`: LANES sums, then the number of pieces. Null text: empty."""
    hashes = f"__h_{out}"
    df = df.withColumn(hashes, F.transform(pieces(F.coalesce(F.col(text_col), F.lit(""))), lambda p: F.xxhash64(p)))

    def seeded(k: int) -> Column:
        return F.transform(F.col(hashes), lambda h: F.xxhash64(h, F.lit(k)))

    df = df.withColumns({f"{hashes}{k}": seeded(k) for k in range(LANES // 4)})

    def total(k: int, shift: int) -> Column:
        return F.aggregate(F.col(f"{hashes}{k}"), F.lit(0).cast("long"), lambda a, h: a + F.shiftright(h, shift).bitwiseAND(F.lit(VALUE)))

    df = df.withColumn(out, F.array(*(total(k, s) for k in range(LANES // 4) for s in (0, 12, 32, 44)), F.size(hashes).cast("long")))
    return df.drop(hashes, *(f"{hashes}{k}" for k in range(LANES // 4)))


def narrow(fingerprint: Column) -> Column:
    """The fingerprint as ints for shuffles: low bits, and the high ones unless all of them are zero."""
    low = F.transform(fingerprint, lambda x: x.bitwiseAND(F.lit((1 << LOW_BITS) - 1)).cast("int"))
    high = F.transform(fingerprint, lambda x: F.shiftright(x, LOW_BITS).cast("int"))
    return F.struct(low.alias("low"), F.when(F.exists(high, lambda x: x != 0), high).alias("high"))


def widened(narrowed: Column) -> Column:
    """The fingerprint that narrow() was given."""
    low = F.transform(narrowed["low"], lambda x: x.cast("long"))
    return F.when(narrowed["high"].isNull(), low).otherwise(F.zip_with(low, narrowed["high"], lambda x, y: x + F.shiftleft(y.cast("long"), LOW_BITS)))


def inserted(a: Column, b: Column) -> Column:
    """Fingerprint of both multisets together."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x + y, F.lit(MODULUS)))


def deleted(a: Column, b: Column) -> Column:
    """Fingerprint of a without what b holds."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x - y, F.lit(MODULUS)))


def as_text(fingerprint: Column) -> Column:
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.hex(x), 11, "0")), "")


def centred(fingerprint: Column) -> Column:
    """Sums as deviations from their expectation, as doubles, from -2^43 to 2^43."""
    n = F.element_at(fingerprint, LANES + 1)
    half = F.lit(MODULUS / 2)
    return F.transform(F.slice(fingerprint, 1, LANES), lambda x: F.pmod(x - n * F.lit(MIDDLE) + half, F.lit(float(MODULUS))) - half)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def likeness(a: Column, b: Column, centred_a: Column, centred_b: Column) -> Column:
    """1 for equal fingerprints, else the cosine estimate, at least 0; 0 where one has no pieces."""
    norms = F.sqrt(dot(centred_a, centred_a) * dot(centred_b, centred_b))
    return F.when(a == b, 1.0).otherwise(F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(dot(centred_a, centred_b), norms))), F.lit(0.0)))


def _next_in_order(order: DataFrame) -> DataFrame:
    """(id, tie, n) with the (id, tie) before it by descending id and that one's n.

    Windows run inside buckets of ids between quantiles; each bucket's last row, one for each of at
    most MOST_BUCKETS buckets, is then carried to the bucket after it.
    """
    from pyspark.sql import Window

    rows = order.count()
    parts = max(1, min(MOST_BUCKETS, rows // BUCKET_ROWS))
    at = [k / parts for k in range(1, parts)]
    bounds = sorted(set(order.agg(F.percentile_approx("id", at, 10_000).alias("b")).first()["b"] or [])) if at else []
    limits = F.array(*(F.lit(b) for b in bounds)) if bounds else None
    # Descending, null ids last: a larger bucket number comes later.
    bucket = F.when(F.col("id").isNull(), F.lit(len(bounds) + 1)).otherwise(F.size(F.filter(limits, lambda b: b > F.col("id"))) if bounds else F.lit(0))
    order = order.withColumn("bucket", bucket)
    by = [F.col("id").desc_nulls_last(), F.col("tie").asc()]
    within = Window.partitionBy("bucket").orderBy(*by)
    own = F.struct(F.col("id"), F.col("tie"), F.col("n"))
    linked = order.withColumn("before", F.lag(own).over(within))
    last = order.groupBy("bucket").agg(F.max_by(own, F.struct(F.coalesce(-F.col("id"), F.lit(0)), "tie")).alias("carried"))
    # A few hundred rows in one window: the bucket that precedes, and the last for the first.
    everywhere = Window.orderBy("bucket")
    final = F.last("carried").over(everywhere.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    carried = last.select("bucket", F.coalesce(F.lag("carried").over(everywhere), final).alias("carried"))
    return linked.join(F.broadcast(carried), "bucket").select("id", "tie", F.coalesce("before", "carried").alias("before"))


def fingerprint_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every whole text, of its edited text, and their likenesses.

    The edited text has its last floor(n_chars / 3) code points replaced by the first as many (or
    all) of the next document by descending id; the first follows the last.  Rows with equal ids
    are ordered by the MD5 of their texts, null ids come last; rows equal in id and text have one
    place in that order and a result each.  Null text is empty; empty texts have a fingerprint of zeros, whose likeness is 1 to
    itself and 0 to any other.  Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = df.select(F.col(id_col).alias("id"), text.alias("t")).withColumn("tie", F.md5("t"))
    order = docs.groupBy("id", "tie").agg(F.max(F.char_length("t")).alias("n"))
    docs = with_fingerprint(docs, "t", "f").withColumn("f", narrow(F.col("f")))
    # Each document takes what the one before it needs of its text, and brings it there.
    link = _next_in_order(order).withColumnRenamed("id", "lid").withColumnRenamed("tie", "ltie")
    here = docs.join(link, docs["id"].eqNullSafe(link["lid"]) & (docs["tie"] == link["ltie"]))
    given = here.groupBy(F.col("before.id").alias("bid"), F.col("before.tie").alias("btie")).agg(F.first(F.substring(F.col("t"), F.lit(1), F.floor(F.col("before.n") / 3).cast("int"))).alias("head"), F.first("f").alias("f_next"))
    both = docs.join(given, docs["id"].eqNullSafe(given["bid"]) & (docs["tie"] == given["btie"]))
    n = F.char_length("t")
    edited = F.concat(F.substring(F.col("t"), F.lit(1), (n - F.floor(n / 3)).cast("int")), F.col("head"))
    both = both.select("id", "tie", n.cast("long").alias("n_chars"), edited.alias("edited"), "f", "f_next")
    both = both.withColumn("edited_sha256", F.sha2("edited", 256))
    both = with_fingerprint(both, "edited", "f_edited").drop("edited").withColumns({"f": widened(F.col("f")), "f_next": widened(F.col("f_next"))})
    both = both.withColumns({"c": centred(F.col("f")), "c_edited": centred(F.col("f_edited")), "c_next": centred(F.col("f_next"))})
    return both.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", as_text(F.col("f")).alias("fingerprint"), as_text(F.col("f_edited")).alias("edited_fingerprint"),
        likeness(F.col("f"), F.col("f_edited"), F.col("c"), F.col("c_edited")).alias("near_edited"),
        likeness(F.col("f"), F.col("f_next"), F.col("c"), F.col("c_next")).alias("near_next"),
    )
