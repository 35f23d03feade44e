"""Document fingerprints by order MinHash. DataFrame functions only.

The k-mers of a text are its runs of ``K`` words (the last word alone closes the text). A word of more than ``LONG``
characters counts character by character, so that scripts without blanks, and any text without them, have k-mers of
characters. Each k-mer is numbered by how often it has occurred before, so that repeats count.

Each of ``SKETCHES`` orders selects the ``LENGTH`` k-mers that are least under it. The order with number b puts first the
k-mers whose hash names b (their hash decides among these), and then all others by a hash seeded with b. So the orders
of a short text are independent hashes, while for a long text one sort serves all orders, because every number is
named by enough of its k-mers. The selected k-mers are put back in text order and the tuple of their hashes is hashed:
two texts agree on a sketch only if they share its k-mers and these stand in the same order, which is what edits and
moves disturb.

Everything happens inside the row of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import let, table, use_checkpoints

K, LENGTH, SKETCHES, LONG = 2, 2, 32, 16
#: A k-mer is packed in one long: hash above, place in the text (from 1) below, wide enough for any array.
PLACE_BITS = 31
PLACE = (1 << PLACE_BITS) - 1
HASH_BITS = 64 - PLACE_BITS
HASH = (1 << HASH_BITS) - 1
#: The highest bits of a hash name an order.
NAME_BITS = 5
NO_ID = -(1 << 63)

_starts = [(b - SKETCHES // 2) << (64 - NAME_BITS) for b in range(SKETCHES)]


def _packed(h: Column, place: Column) -> Column:
    return h.bitwiseAND(F.lit(~PLACE)).bitwiseOR(place)


def _hash_of(p: Column) -> Column:
    return F.shiftright(p, PLACE_BITS)


def _place_of(p: Column) -> Column:
    return p.bitwiseAND(F.lit(PLACE))


def _name_of(p: Column) -> Column:
    return F.shiftright(p, 64 - NAME_BITS)


def _numbered(kmers: Column) -> Column:
    """Packed hashes of (k-mer, occurrence number), unsorted, from the hashes of the k-mers in text order."""
    place = lambda h, i: _packed(h, (i + 1).cast("long"))

    def number(s: Column) -> Column:  # sorted: equal k-mers stand together, in text order
        n = F.size(s)
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda j: F.when(j == 0, True).otherwise(_hash_of(s[j]) != _hash_of(s[j - 1])))
        runs = let(starts, lambda b: F.zip_with(b, F.concat(F.slice(b, F.lit(2), n), F.array(n)), lambda x, y: y - x))
        order = F.flatten(F.transform(runs, lambda r: F.sequence(F.lit(1), r)))
        return F.zip_with(s, order, lambda p, o: _packed(F.xxhash64(_hash_of(p), o), _place_of(p)))

    return let(F.sort_array(F.transform(kmers, place)), lambda s: F.when(F.size(s) > 0, number(s)).otherwise(s))


def units(text: Column) -> Column:
    """The words of a text, those of more than LONG characters taken apart into characters."""
    words = F.filter(F.split(text, r"[\x20\t-\r]+"), lambda w: w != "")
    apart = lambda w: F.when(F.length(w) > LONG, F.filter(F.split(w, ""), lambda c: c != "")).otherwise(F.array(w))
    long = text.rlike(rf"[^\x20\t-\r]{{{LONG + 1}}}")
    return F.when(long, F.flatten(F.transform(words, apart))).otherwise(words)


def signature(text: Column) -> Column:
    """``SKETCHES`` longs for a text; words are runs between blanks, and a text without words has zeros."""
    kmers = let(units(F.coalesce(text, F.lit(""))), lambda w: F.zip_with(w, F.slice(w, F.lit(2), F.size(w)), lambda a, b: F.xxhash64(a, b)))
    points = F.array(*[F.lit(c) for c in _starts])

    def sketch(ring: Column) -> Column:  # sorted k-mers; a point without a place stands before those that name each order
        def one(start: Column, b: Column) -> Column:
            own = lambda p: (_name_of(p) == _name_of(start)) & (_place_of(p) != 0)
            named = F.filter(F.slice(ring, F.array_position(ring, start).cast("int") + 1, LENGTH), own)

            def filled(first: Column) -> Column:
                others = F.filter(ring, lambda p: (_name_of(p) != _name_of(start)) & (_place_of(p) != 0))
                seeded = F.sort_array(F.transform(others, lambda p: _packed(F.xxhash64(_hash_of(p), b), _place_of(p))))
                return F.when(F.size(first) == LENGTH, first).otherwise(F.concat(first, F.slice(seeded, F.lit(1), LENGTH - F.size(first))))

            turned = F.transform(let(named, filled), lambda p: F.shiftleft(_place_of(p), HASH_BITS).bitwiseOR(_hash_of(p).bitwiseAND(F.lit(HASH))))
            return F.xxhash64(F.transform(F.sort_array(turned), lambda q: q.bitwiseAND(F.lit(HASH)))).bitwiseAND(F.lit(0xFFFFFFFF))

        return F.transform(points, one)

    some = lambda u: F.when(F.size(u) > 0, let(F.sort_array(F.concat(u, points)), sketch)).otherwise(F.array_repeat(F.lit(0).cast("long"), SKETCHES))
    return let(_numbered(kmers), some)


def likeness(a: Column, b: Column) -> Column:
    """The share of sketches on which two signatures agree."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.lit(float(SKETCHES))


def written(sig: Column) -> Column:
    return F.array_join(F.transform(sig, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def fingerprinted(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` with ``signature`` (array of long) and ``fingerprint`` (hex).

    A null text counts as empty; texts without words agree with each other only. Rows are handled one by one, so
    repeats need no rule. Columns with the names of results are replaced.
    """
    docs = docs.drop("signature", "fingerprint")
    return docs.withColumn("signature", signature(F.col("text"))).withColumn("fingerprint", written(F.col("signature")))


def followed(keys: DataFrame) -> DataFrame:
    """``keys`` (id, h, n, ...) with next_id, next_h: the next key in descending order, and the greatest after the least.

    Keys are ordered by range partitions, whatever the ids are; only the edges of these, one row a partition, are put in
    order by themselves.
    """
    placed = keys.repartitionByRange("id", "h").withColumn("bucket", F.spark_partition_id()).checkpoint()
    inside = placed.withColumn("next", F.lag(F.struct("id", "h")).over(Window.partitionBy("bucket").orderBy("id", "h")))
    tops = placed.groupBy("bucket").agg(F.max(F.struct("id", "h")).alias("top"))
    order = Window.orderBy("bucket")
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = tops.select("bucket", F.coalesce(F.lag("top").over(order), F.max("top").over(every)).alias("before"))
    linked = inside.join(edges, "bucket").withColumn("goal", F.coalesce("next", "before"))
    return linked.select(*keys.columns, F.col("goal.id").alias("next_id"), F.col("goal.h").alias("next_h"))


def edited(docs: DataFrame) -> DataFrame:
    """(doc_id, text, edited, signature, edited_signature, next_signature) of every row; other columns are left out.

    ``edited`` is the text with its last floor(n / 2) code points replaced by the first as many of the next document in
    descending doc_id; after the last comes the first. Documents that share a doc_id are ordered by a hash of their
    text; rows that are equal in both are one document in that order, and each of them has its row in the result. A null
    doc_id comes last in that order. A null text is empty.
    """
    use_checkpoints(docs.sparkSession)
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = base.select("id", F.xxhash64("text").alias("h"), "text")
    keys = keyed.select("id", "h", F.length("text").alias("n")).groupBy("id", "h").agg(F.min("n").alias("n"), F.count("*").alias("times"))
    links = followed(keys).select("id", "h", "next_id", "next_h", "times", F.floor(F.col("n") / 2).cast("int").alias("need"))
    repeated = links.filter("times > 1").limit(1).count() > 0
    if repeated:
        keyed = keyed.dropDuplicates(["id", "h"])
    signed = keyed.withColumn("signature", signature(F.col("text")))
    # Both joins read ``signed`` under its own names, so that one shuffle of the texts serves both.
    follower, link = signed.alias("s"), links.alias("l")
    nexts = follower.join(link, (F.col("s.id") == F.col("l.next_id")) & (F.col("s.h") == F.col("l.next_h")))
    nexts = nexts.select("l.id", "l.h", "l.need", "l.times", F.left("s.text", F.col("l.need")).alias("part"), F.col("s.signature").alias("next_signature"))
    both = signed.join(nexts, ["id", "h"])
    both = both.select(
        F.nullif(F.col("id"), F.lit(NO_ID)).alias("doc_id"),
        "text",
        F.concat(F.left("text", F.length("text") - F.col("need")), F.col("part")).alias("edited"),
        "signature",
        "next_signature",
        "times",
    ).withColumn("edited_signature", signature(F.col("edited")))
    if repeated:
        both = both.withColumn("times", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int"))))
    return both.drop("times")


def op2_order_minhash(spark, sf_dir: str) -> DataFrame:
    got = edited(table(spark, sf_dir, "documents"))
    return got.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        written(F.col("signature")).alias("fingerprint"),
        written(F.col("edited_signature")).alias("edited_fingerprint"),
        likeness(F.col("signature"), F.col("edited_signature")).alias("near_edited"),
        likeness(F.col("signature"), F.col("next_signature")).alias("near_next"),
    )
