"""Order MinHash fingerprints in DataFrame functions only (operator 2).

A text's k-mers are runs of ``WIDTH`` words (white-space separated, as they are, each
sign of a script without spaces a word of its own); equal ones are told apart by their occurrence number. Each numbered k-mer is
hashed once; the low bits of the hash deal it to one of ``2 * SLOTS`` families,
and in each family the k-mer with the smallest remaining bits is selected. The
two selections of a slot are put in the order in which they stand in the text
and hashed together. Two texts agree in a slot if they select the same two k-mers
in the same order, so likeness falls with edit distance, not only with what the
texts have in common. Likeness is the share of agreeing slots among those that
either text fills; two texts without words are alike (1.0).

In a text of few k-mers many families are empty. With ``densified``, as the query
has it, such a family borrows the selection of another one, of the first that is
filled in an order of its own, and the two of a slot never are of one family: every
slot of a text orders two k-mers, if its k-mers fill two families. Without it, a
slot may have one k-mer and no order, or none.

A text of fewer words than a k-mer is one k-mer, its whole sequence. Nulls are
empty texts. Rows with the same id each have their result; they follow one another
in the order of their texts. Rows without an id are left out, other columns ignored.

Each document meets the next one in its bucket, an interval of ids; the first
document of each following bucket is added to the bucket before it. So texts are
shuffled once, and every later step is local to its partition.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .inputs import id_and_text

WIDTH = 3
SLOTS = 64
PARTITION_BYTES = 4 << 20
BUCKETS_PER_PARTITION = 4
#: Rows of 16 bytes, one a bucket, that are broadcast at most.
MOST_BROADCAST = 200_000
#: A bucket with so many times the mean number of ids: intervals are cut at quantiles.
UNEVEN = 8

_EMPTY = "........"


#: Signs of scripts that write without spaces: each is a word.
_UNSPACED = r"([\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}])"


def _words(text: Column) -> Column:
    spaced = F.when(F.octet_length(text) > F.length(text), F.regexp_replace(text, _UNSPACED, " $1 ")).otherwise(text)
    return F.filter(F.split(spaced, r"\s+"), lambda w: w != "")


def signatures(texts: DataFrame, keys: list[str], text_col: str = "text", width: int = WIDTH, slots: int = SLOTS, densified: bool = False) -> DataFrame:
    """``keys`` and ``signature``: an array of ``slots`` hashes (null: an empty slot) for each row; ``keys`` name it."""
    w = F.col("_words")
    grams = F.arrays_zip(*(F.slice(w, 1 + i, F.greatest(F.size(w) - i, F.lit(0))).alias(f"w{i}") for i in range(width)))
    rows = texts.select(*keys, _words(F.col(text_col)).alias("_words")).select(*keys, (F.size(w) - width).alias("_last"), F.posexplode_outer(grams).alias("_at", "_gram"))
    rows = rows.where("_at IS NULL OR _at <= greatest(_last, 0)")
    rows = rows.select(*keys, "_at", F.xxhash64(*(F.col(f"_gram.w{i}") for i in range(width))).alias("_kmer"))
    numbered = rows.withColumn("_occurrence", F.row_number().over(Window.partitionBy(*keys, "_kmer").orderBy("_at")))
    hashed = numbered.select(*keys, "_at", F.xxhash64("_kmer", "_occurrence").alias("_hash"))
    family = F.pmod(F.col("_hash"), F.lit(2 * slots)).cast("int")
    # 33 bits of the hash, then 31 of the position: the smallest of both is the selection and where it stands
    packed = F.when(F.col("_at").isNotNull(), F.shiftleft(F.shiftrightunsigned("_hash", 31), 31).bitwiseOR(F.col("_at").cast("long")))
    dealt = hashed.select(*keys, F.floor(family / 2).cast("int").alias("_slot"), (family % 2).alias("_side"), packed.alias("_packed"))
    picked = dealt.groupBy(*keys, "_slot").agg(F.min(F.when(F.col("_side") == 0, F.col("_packed"))).alias("_a"), F.min(F.when(F.col("_side") == 1, F.col("_packed"))).alias("_b"))
    if densified:
        sides = picked.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_slot", F.struct("_a", "_b")))).alias("_map"))
        return sides.select(*keys, _densified(F.col("_map"), slots).alias("signature"))
    place = lambda c: F.col(c).bitwiseAND(F.lit((1 << 31) - 1))
    what = lambda c: F.shiftrightunsigned(c, 31)
    in_order = F.when(F.col("_b").isNull() | (place("_a") < place("_b")), F.xxhash64(F.lit(0), what("_a"), F.lit(1), what("_b"))).otherwise(F.xxhash64(F.lit(1), what("_b"), F.lit(0), what("_a")))
    tuples = picked.select(*keys, "_slot", F.when(F.col("_a").isNotNull() | F.col("_b").isNotNull(), in_order.bitwiseAND(F.lit(0xFFFFFFFF))).alias("_tuple"))
    listed = tuples.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_slot", "_tuple"))).alias("_map"))
    return listed.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda i: F.col("_map")[i.cast("int")]).alias("signature"))


def _step(family: int, families: int) -> int:
    """The odd stride by which a family of a power of two goes through the others."""
    return (family * 0x9E3779B1 >> 7) % families | 1


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), then)[0]


def _densified(picked: Column, slots: int) -> Column:
    """The signature from a map of slots to both selections (``_a``, ``_b``), empty families filled from others."""
    n = 2 * slots
    if n & (n - 1):
        raise ValueError("the number of slots must be a power of two")
    back = [pow(_step(f, n), -1, n) for f in range(n)]
    place, what = lambda c: c.bitwiseAND(F.lit((1 << 31) - 1)), lambda c: F.shiftrightunsigned(c, 31)
    low = lambda c: c.bitwiseAND(F.lit(n - 1))
    strides, inverse = F.lit([_step(f, n) for f in range(n)]), F.lit(back)

    def lender(family: Column, filled: Column, but: Column) -> Column:
        """Of the filled families but one, the first in a family's order; null if there is none."""
        at = lambda table: F.element_at(table, family + 1)
        first = F.array_min(F.transform(filled, lambda g: F.when(g != but, low((g - family) * at(inverse)))))
        return low(family + first * at(strides))

    def slot(i: Column, sides: Column, filled: Column) -> Column:
        a, b = F.element_at(sides, 2 * i + 1), F.element_at(sides, 2 * i + 2)
        return F.when(a.isNotNull() & b.isNotNull(), pair(a, b)).otherwise(_once(F.when(a.isNotNull(), 2 * i).otherwise(lender(2 * i, filled, F.lit(-1))), lambda f: borrowed(i, f, sides, filled)))

    def borrowed(i: Column, f: Column, sides: Column, filled: Column) -> Column:
        g = F.when(F.element_at(sides, 2 * i + 2).isNotNull() & (f != 2 * i + 1), 2 * i + 1).otherwise(lender(2 * i + 1, filled, f))
        return _once(F.struct(F.element_at(sides, f + 1).alias("a"), F.element_at(sides, g + 1).alias("b")), lambda x: pair(x["a"], x["b"]))

    def pair(a: Column, b: Column) -> Column:
        ordered = F.when(b.isNull() | (place(a) < place(b)), F.xxhash64(F.lit(0), what(a), F.lit(1), what(b))).otherwise(F.xxhash64(F.lit(1), what(b), F.lit(0), what(a)))
        return ordered.bitwiseAND(F.lit(0xFFFFFFFF))

    every = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda i: F.array(picked[i]["_a"], picked[i]["_b"])))
    families = F.sequence(F.lit(0), F.lit(n - 1))
    signed = lambda sides: _once(
        F.filter(families, lambda f: F.element_at(sides, f + 1).isNotNull()),
        lambda filled: F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda i: F.when(F.size(filled) > 0, slot(i, sides, filled))),
    )
    return _once(every, signed)


def fingerprint(signature: Column) -> Column:
    """A signature as text: eight hexadecimal digits a slot."""
    return F.array_join(F.transform(signature, lambda x: F.coalesce(F.lower(F.lpad(F.hex(x), 8, "0")), F.lit(_EMPTY))), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of slots in which two signatures agree, of those that either fills."""
    one = F.zip_with(a, b, lambda x, y: F.when(x.isNull() & y.isNull(), F.lit(0)).when(x == y, F.lit(257)).otherwise(F.lit(256)))
    total = F.aggregate(one, F.lit(0), lambda s, x: s + x)
    filled, equal = F.shiftright(total, 8), total.bitwiseAND(F.lit(255))
    return F.when(filled == 0, F.lit(1.0)).otherwise(equal / filled)


def _interval(cuts: list[int]) -> Column:
    """How many of the sorted cuts are not above an id: of every so many cuts first, then within that stretch."""
    width = max(1, math.isqrt(len(cuts)))
    stretches = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    table = lambda value, kind: F.from_json(F.lit(json.dumps(value)), kind)  # noqa: E731  one constant, however many cuts
    upto = lambda values: F.size(F.filter(values, lambda c: c <= F.col("doc_id")))
    coarse = upto(table([x[0] for x in stretches], "array<bigint>"))
    return F.when(coarse == 0, F.lit(0)).otherwise((coarse - 1) * width + upto(F.element_at(table(stretches, "array<array<bigint>>"), F.greatest(coarse, F.lit(1))))).cast("long")


def _bucket(docs: DataFrame, buckets: int, low: int, high: int, rows: int) -> Column:
    """Buckets of ascending ids: intervals of equal width, or between quantiles where ids are very uneven; no result depends on which."""
    # ids may span more than a long holds
    above = (F.col("doc_id").cast("decimal(20,0)") - F.lit(Decimal(low))).cast("double")
    even = F.least(F.floor(above * buckets / float(high - low + 1)), F.lit(buckets - 1)).cast("long")
    most = docs.groupBy(even.alias("bucket")).count().agg(F.max("count")).first()[0]
    if most <= UNEVEN * max(1, rows / buckets):
        return even
    cuts = docs.agg(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)], 10_000)).first()[0]
    return _interval(sorted(set(cuts)))


def with_next(docs: DataFrame, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """(bucket, at, added, doc_id, text, next_text), spread by ``bucket``; added rows repeat the next bucket's first document.

    ``at`` is a row's place in its bucket; added rows come last.
    """
    ids = docs.select("doc_id")
    n, low, high, size = docs.agg(F.count("*"), F.min("doc_id"), F.max("doc_id"), F.sum(F.octet_length("text"))).first()
    partitions = max(1, -(-(size or 0) // partition_bytes))
    bucket = _bucket(ids, BUCKETS_PER_PARTITION * partitions, low, high, n) if n else F.lit(0).cast("long")
    firsts = ids.groupBy(bucket.alias("own")).agg(F.min("doc_id").alias("doc_id"))
    # one row a bucket; the last bucket is followed by the first
    order = Window.orderBy(F.lit(0), "own")
    before = F.coalesce(F.lag("own").over(order), F.max("own").over(Window.partitionBy(F.lit(0))))
    firsts = firsts.select("doc_id", before.alias("bucket"))
    if BUCKETS_PER_PARTITION * partitions <= MOST_BROADCAST:  # beyond it the texts go through one more shuffle
        firsts = F.broadcast(firsts)
    added = docs.join(firsts, "doc_id").select("bucket", F.lit(True).alias("added"), "doc_id", "text")
    every = docs.select(bucket.alias("bucket"), F.lit(False).alias("added"), "doc_id", "text").unionByName(added).repartition(int(partitions), "bucket")
    order = Window.partitionBy("bucket").orderBy("added", "doc_id", "text")
    return every.withColumns({"next_text": F.lead("text").over(order), "at": F.row_number().over(order)})


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, slots: int = SLOTS, partition_bytes: int = PARTITION_BYTES, densified: bool = False) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last half of the code points replaced by as many of the next document's first ones.
    """
    texts = id_and_text(docs, id_col, text_col).fillna("", "text")
    rows = with_next(texts, partition_bytes).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2)
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars") - half), F.substring("next_text", F.lit(1), half))
    rows = rows.withColumn("edited", F.when(~F.col("added"), edited))
    # few and short keys: the k-mers are sorted by them; what else a row has is joined afterwards
    both = F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("value")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("value")))
    each = rows.select("bucket", "at", "added", F.explode(both).alias("x")).where("x.value IS NOT NULL").select("bucket", "at", (F.col("x.kind") + F.when(F.col("added"), 2).otherwise(0)).alias("kind"), "x.value")
    signed = signatures(each, ["bucket", "at", "kind"], "value", width, slots, densified)
    of = lambda kind: F.max(F.when(F.col("kind") == kind, F.struct("signature"))).alias(f"s{kind}")
    one = signed.groupBy("bucket", "at").agg(of(0), of(1), of(2))
    beside = one.withColumn("next", F.lead(F.coalesce("s0", "s2")).over(Window.partitionBy("bucket").orderBy("at"))).where("s0 IS NOT NULL")
    made = beside.select(
        "bucket",
        "at",
        fingerprint(F.col("s0.signature")).alias("fingerprint"),
        fingerprint(F.col("s1.signature")).alias("edited_fingerprint"),
        likeness(F.col("s0.signature"), F.col("s1.signature")).alias("near_edited"),
        likeness(F.col("s0.signature"), F.col("next.signature")).alias("near_next"),
    )
    texts_of = rows.where("NOT added").select("bucket", "at", "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    return texts_of.join(made, ["bucket", "at"]).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"), densified=True)
