"""Document fingerprints from closed syncmers (operator 10), with DataFrame functions only.

Units are words; in scripts without blanks, in words of more than LONG code points and where a text
has fewer than k units, code points. What is a unit depends on the word alone but for such short texts; k successive units form a k-mer, s successive ones an s-mer. A k-mer is a closed syncmer if the least of its s-mers is
the first or the last one. Whether it is depends on nothing outside the k-mer, so a passage
selects the same anchors wherever it stands. The fingerprint keeps the least `size` hashes of
anchors (a bottom sketch); the likeness of two is the share of common hashes among the least
`size` of both together. anchors() returns hashes with positions for positional matching.

Nulls count as empty texts: their fingerprint is the empty string, and their likeness is 1 to
an empty text and 0 to others. A text with fewer than k units, or none of whose
k-mers is selected, has one anchor: the hash of all.
Equal texts have equal fingerprints. Rows may repeat; rows without doc_id come first in the
order. An empty table gives no row. Extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from argentum.llm.session import parts_for
from argentum.operators.ordered import bounds, position

K, S, SIZE = 5, 3, 128
#: Code points of the longest word that is one unit.
LONG = 32
#: Scripts that put no blanks between words.
SCRIPTS = "".join(rf"\p{{Is{name}}}" for name in ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar"))
#: Hexadecimal digits of a hash in a fingerprint.
DIGITS = 12
#: Most ranges whose first keys are broadcast.
MANY = 20_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is computed once however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def smers(words: Column, s: int) -> Column:
    """Hashes of s successive words, one for each position."""
    return F.transform(F.sequence(F.lit(0), F.size(words) - s), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(s)]))


def selected(hashes: Column, k: int, s: int) -> Column:
    """For each k-mer, from hashes of its s-mers: its hash if it is a closed syncmer, else null."""
    w = k - s + 1

    def one(i: Column) -> Column:
        first, last = F.get(hashes, i), F.get(hashes, i + (w - 1))
        inner = [F.get(hashes, i + j) for j in range(1, w - 1)]
        least = F.least(first, last)
        return F.when(F.least(least, *inner) == least if inner else F.lit(True), F.xxhash64(*[F.get(hashes, i + j) for j in sorted({*range(0, w, s), w - 1})]))

    return F.transform(F.sequence(F.lit(0), F.size(hashes) - w), one)


def units(text: Column, k: int = K) -> Column:
    """Words, and code points where there are no blanks (see the module); one empty string for none."""
    points = lambda t: F.regexp_extract_all(t, F.lit("(?s)."), F.lit(0))
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    own = F.regexp_extract_all(trimmed, F.lit(rf"[{SCRIPTS}]|[^{SCRIPTS}\x09-\x0D ]+"), F.lit(0))
    words = F.when(trimmed.rlike(f"[{SCRIPTS}]"), own).otherwise(F.split(trimmed, r"[\x09-\x0D ]+"))
    long = lambda w: F.length(w) > LONG
    words = let(words, lambda w: F.when(F.exists(w, long), F.flatten(F.transform(w, lambda x: F.when(long(x), points(x)).otherwise(F.array(x))))).otherwise(w))
    return let(words, lambda w: F.when((F.size(w) < k) & (F.get(w, F.lit(0)) != ""), points(F.array_join(w, " "))).otherwise(w))


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """For each k-mer its hash if it is a closed syncmer, else null; position = index in the array. Without any, the hash of all units."""

    def of(w: Column) -> Column:
        short = F.when(F.get(w, F.lit(0)) == "", F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(F.array_join(w, " "))))
        found = let(smers(w, s), lambda h: selected(h, k, s))
        return F.when(F.size(w) < k, short).otherwise(let(found, lambda a: F.when(F.exists(a, lambda h: h.isNotNull()), a).otherwise(short)))

    return let(units(text, k), of)


def sketch(text: Column, k: int = K, s: int = S, size: int = SIZE) -> Column:
    """The least `size` distinct hashes of anchors, ascending, without sign."""
    kept = F.transform(F.filter(anchors(text, k, s), lambda h: h.isNotNull()), lambda h: F.shiftrightunsigned(h, 64 - 4 * DIGITS))
    return F.slice(F.sort_array(F.array_distinct(kept)), 1, size)


def written(hashes: Column) -> Column:
    """A sketch as text: hexadecimal numbers of fixed width, ascending."""
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.lower(F.hex(h)), DIGITS, "0")), "")


def likeness(a: Column, b: Column, size: int = SIZE) -> Column:
    """Of two arrays of hashes: common ones among the least `size` of both."""

    def of(both: Column) -> Column:
        common = F.size(F.array_intersect(F.array_intersect(a, b), both))
        return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(common / F.greatest(F.size(both), F.lit(1)))

    return let(F.slice(F.sort_array(F.array_union(a, b)), 1, size), of)


def fingerprints(docs: DataFrame, k: int = K, s: int = S, size: int = SIZE) -> DataFrame:
    """doc_id, n_chars and fingerprint of (doc_id, text): a projection of the scan."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.length(text).cast("long").alias("n_chars"), written(sketch(F.col("text"), k, s, size)).alias("fingerprint"))


def with_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of documents and of their edited texts: the last quarter replaced by the next document's first code points.

    The next document is found without a window over all rows: rows are dealt by ranges of
    doc_id, a window looks ahead within each range, and the first row of every range (one row
    a range) serves the last row of the range before.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("known", F.col("doc_id").isNotNull()).withColumn("key", F.coalesce("doc_id", F.lit(0)))
    cuts = bounds(rows.filter("known"), "key", parts_for(rows, each=6 << 20))
    spot = F.when(~F.col("known"), F.lit(-1)).otherwise(position(F.col("key"), cuts)).cast("int")
    # The first row of each range: keys first, from the narrow column, then the texts of those rows alone.
    keys = rows.groupBy(spot.alias("range")).agg(F.min(F.struct("known", "key")).alias("first"))
    follows = F.coalesce(F.lead("first").over(Window.orderBy("range")), F.min("first").over(Window.partitionBy(F.lit(1))))
    heads = keys.select("range", follows.alias("first")).select("range", "first.known", "first.key")
    heads = rows.select("known", "key", "text").join(F.broadcast(heads) if len(cuts) < MANY else heads, ["known", "key"]).groupBy("range").agg(F.min("text").alias("head"))
    order = Window.partitionBy("range").orderBy("known", "key", "text")
    dealt = rows.withColumn("range", spot).repartition(max(1, len(cuts) + 1), "range")
    ahead = dealt.join(heads, "range", "left").withColumn("after", F.coalesce(F.lead("text").over(order), "head"))
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("after", F.lit(1), cut))
    # Only the last row of a range has to compute the fingerprint of its next document anew.
    last = F.lead("key").over(order).isNull()
    chosen = ahead.select("doc_id", "known", "key", "text", "range", n.cast("long").alias("n_chars"), sketch(F.col("text")).alias("own"), edited.alias("edited"), F.when(last, F.col("after")).alias("beyond"))
    made = chosen.select("doc_id", "n_chars", "own", F.coalesce(F.lead("own").over(order), sketch(F.col("beyond"))).alias("next"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), sketch(F.col("edited")).alias("changed"))
    return made.select("doc_id", "n_chars", "edited_sha256", written(F.col("own")).alias("fingerprint"), written(F.col("changed")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"))
