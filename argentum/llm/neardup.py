"""MinHash near-duplicates with odd sketches (operator 7).

1. A map computes for each document its set of word shingles, a hash of the whole set, a MinHash
   signature in bands, and an odd sketch: a bitmap in which every MinHash sample flips one bit.
2. Documents with equal sets form classes by that hash; a class has a number, and one text stands for it.
3. In each bucket of a band one class is compared with all others: XOR and popcount of odd sketches
   estimate the similarity, and pairs that come near are confirmed on full sets.
4. Links give components. In buckets that still hold several components, the members outside of the
   bucket's largest component are compared by sketches with all members of others; the full sets of those
   that come near are compared in their groups, and each group gives out only links that join
   components. So no pair of a bucket is left out, and pairs are never listed.

A pair at similarity 0.75 shares a bucket with probability above 1 - 6e-6 (32 bands of 4 rows).

Nulls and empty texts have empty sets and are linked with nothing. Fewer words than a shingle make
one shingle. Rows that share a doc_id count as one document with the sets of each: what is linked with
one of them is linked with all; each row is returned once. A row without words is linked with nothing, not
even with others of its doc_id. Rows without doc_id are linked with nothing (component_id null, kept). An
empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argentum.llm.session import cut
from argentum.llm.words import Words, grams, inside, mix, powers
from argentum.operators.components import components

SHINGLE, SIMILAR = 5, 0.75
BANDS, ROWS = 32, 4
BITS = 1024
#: Pairs whose estimate is below go no further: five standard deviations of the estimate under SIMILAR.
NEAR = 0.55
#: Members of a bucket that one group compares with as many others.
BLOCK = 512
#: Pairs whose sketches are compared at once.
PAIRS = 1 << 17

_RNG = np.random.default_rng(7)
_A = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)


def shingle_sets(column: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending: (hashes, n+1 offsets)."""
    w = Words(column, lower=True)
    h, n = w.hashes(), len(w)
    ok = inside(w.of, k, n)
    doc = w.doc()
    keys, of = grams(h, k)[ok], doc[: len(ok)][ok]
    size = np.diff(w.of)
    few = np.flatnonzero((size > 0) & (size < k))
    if len(few):  # the whole sequence is one shingle
        first = w.of[few]
        whole = np.zeros(len(few), np.uint64)
        for j in range(k - 1):
            more = size[few] > j
            whole[more] += h[first[more] + j] * powers(k)[j]
        keys, of = np.concatenate([keys, mix(whole ^ size[few].astype(np.uint64))]), np.concatenate([of, few])
    order = np.lexsort((keys, of))
    keys, of = keys[order], of[order]
    if len(keys):
        new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])])
        keys, of = keys[new], of[new]
    return keys, np.searchsorted(of, np.arange(w.count + 1))


def signatures(keys: np.ndarray, of: np.ndarray) -> np.ndarray:
    """MinHash samples of sets that are not empty: one row for each sample."""
    h = (keys >> np.uint64(32)).astype(np.uint32)
    out = np.empty((BANDS * ROWS, len(of) - 1), np.uint32)
    for i in range(BANDS * ROWS):
        out[i] = np.minimum.reduceat(h * _A[i] + _B[i], of[:-1])
    return out


def bands(samples: np.ndarray) -> np.ndarray:
    """A key for each band, which also says which band it is."""
    out = np.empty((BANDS, samples.shape[1]), np.uint64)
    for b in range(BANDS):
        x = np.full(samples.shape[1], b + 1, np.uint64)
        for r in range(ROWS):
            x = mix(x * np.uint64(0x9E3779B97F4A7C15) + samples[b * ROWS + r])
        out[b] = x
    return out


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Parity bitmaps of BITS bits, as 64-bit numbers: sample i flips the bit that its index and value hash to."""
    n = samples.shape[1]
    out = np.zeros((n, BITS // 64), np.uint64)
    at = np.arange(n)
    for i, row in enumerate(samples):
        bit = mix(row.astype(np.uint64) << np.uint64(8) ^ np.uint64(i * 0x9E37 + 1)) >> np.uint64(64 - BITS.bit_length() + 1)
        out[at, (bit >> np.uint64(6)).astype(np.int64)] ^= np.uint64(1) << (bit & np.uint64(63))
    return out


def least_odd() -> int:
    """Most differing bits at which the estimate still reaches NEAR (all samples differ with 2M flips)."""
    flips = 2 * BANDS * ROWS * (1 - NEAR)
    return int(BITS / 2 * (1 - np.exp(-2 * flips / BITS))) + 1


SIGNED = "doc_id long, text_hash long, n_shingles long, set_a long, set_b long, keys array<long>, sketch array<long>"


def signed(docs: DataFrame) -> DataFrame:
    """Set size, two hashes of the set, band keys and odd sketch of each row of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 512):
                some = batch.slice(a, 512)
                keys, of = shingle_sets(some.column(2))
                size = np.diff(of)
                full = np.flatnonzero(size)
                sums = np.zeros((2, len(size)), np.uint64)
                lists = [[None] * len(size), [None] * len(size)]
                if len(full):
                    edges = np.append(of[:-1][full], len(keys))
                    sums[0, full] = np.add.reduceat(mix(keys), edges[:-1])
                    sums[1, full] = np.add.reduceat(mix(keys ^ np.uint64(0x5DEECE66D)), edges[:-1])
                    samples = signatures(keys, edges)
                    for into, values in zip(lists, (bands(samples).T, odd_sketches(samples)), strict=True):
                        for i, v in zip(full.tolist(), values.view(np.int64), strict=True):
                            into[i] = v
                yield pa.RecordBatch.from_arrays([*some.columns[:2], pa.array(size), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), *[pa.array(x, pa.list_(pa.int64())) for x in lists]], ["doc_id", "text_hash", "n_shingles", "set_a", "set_b", "keys", "sketch"])

    return with_hash(docs).mapInArrow(run, SIGNED)


def with_hash(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, text: the first two tell texts apart, though a doc_id may have several."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def sets_of(wanted: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """Full shingle sets (rep, set: sorted 64-bit hashes) of the classes in `wanted` (rep), from the text that stands for each."""
    which = reps.select("rep", "doc_id", "text_hash").join(wanted.distinct().hint("merge"), "rep", "left_semi")
    texts = with_hash(docs).join(which.hint("merge"), ["doc_id", "text_hash"]).groupBy("rep").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 512):
                some = batch.slice(a, 512)
                keys, of = shingle_sets(some.column(1))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([keys[x:y].tobytes() for x, y in zip(of[:-1], of[1:], strict=True)], pa.binary())], ["rep", "set"])

    return cut(texts.mapInArrow(run, "rep long, set binary"), "sets")


def confirmed(pairs: DataFrame, reps: DataFrame, docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; only texts of classes in pairs are read into sets."""
    held = sets_of(pairs.select(F.col("a").alias("rep")).union(pairs.select(F.col("b").alias("rep"))), reps, docs)
    percent = round(100 * similar)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                both = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                ok.append(100 * common >= percent * (len(both) - common))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left, right = held.select(F.col("rep").alias("a"), F.col("set").alias("x")), held.select(F.col("rep").alias("b"), F.col("set").alias("y"))
    return pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")


def near(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs whose odd sketches differ in few enough bits."""
    one = sketches.select(F.col("rep").alias("a"), F.col("sketch").alias("x")).hint("merge")
    two = sketches.select(F.col("rep").alias("b"), F.col("sketch").alias("y")).hint("merge")
    bits = F.aggregate(F.zip_with("x", "y", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, v: s + v)
    return pairs.join(one, "a").join(two, "b").filter(bits <= least_odd()).select("a", "b")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Sorted batches as tables that don't cut a group of equal keys in two."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        if held:  # rows of the last group may go on
            last = held[-1].slice(len(held[-1]) - 1)
            same = np.logical_and.reduce([batch.column(c).to_numpy() == last.column(c)[0].as_py() for c in keys])
            n = len(batch) if same.all() else int(np.argmin(same))
            if n:
                held.append(batch.slice(0, n))
            if n == len(batch):
                continue
            yield pa.Table.from_batches(held)
            batch = batch.slice(n)
        held = [batch]
    if held:
        yield pa.Table.from_batches(held)


def group_starts(*columns: np.ndarray) -> np.ndarray:
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def flagged(side: np.ndarray, other: np.ndarray, rep: np.ndarray, component: np.ndarray, keys: np.ndarray, sketch: np.ndarray, bucket: int, most: int) -> np.ndarray:
    """Rows of one group: which have a partner of another component on the other side that comes near.

    side 0: a block of the members outside of the bucket's largest component; side 1: a block of all. Two of `other` meet
    on either side; they count once. A pair counts in the first bucket that it shares only.
    """
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    out = np.zeros(len(side), bool)
    step = max(1, PAIRS // max(1, len(right)))
    for a in range(0, len(left), step):
        own = left[a : a + step]
        ok = (component[own][:, None] != component[right]) & (~other[right] | (rep[own][:, None] < rep[right]))
        x, y = np.nonzero(ok)
        x, y = own[x], right[y]
        ok = np.bitwise_count(sketch[x] ^ sketch[y]).sum(1, dtype=np.int64) <= most
        x, y = x[ok], y[ok]
        equal = keys[x] == keys[y]
        ok = keys[x, equal.argmax(1)] == bucket
        out[x[ok]] = True
        out[y[ok]] = True
    return out


def dealt_blocks(members: DataFrame) -> DataFrame:
    """Members of buckets to groups (bucket, i, j): block i of those outside of the largest component against block j of all.

    Members of the largest component are copied once for each block of the others, which are few where copies of one text make a bucket large.
    """
    block = lambda n: F.floor(F.pmod(F.xxhash64("rep", "bucket"), F.greatest(n, F.lit(1))) / BLOCK).cast("int")
    last = lambda n: (F.ceil(F.greatest(n, F.lit(1)) / BLOCK) - 1).cast("int")
    every = members.withColumn("i", F.explode(F.sequence(F.lit(0), last(F.col("others"))))).withColumn("j", block(F.col("members"))).withColumn("side", F.lit(1))
    some = members.filter("other").withColumn("i", block(F.col("others"))).withColumn("j", F.explode(F.sequence(F.lit(0), last(F.col("members"))))).withColumn("side", F.lit(0))
    return every.unionByName(some).drop("members", "others")


def candidates(members: DataFrame) -> DataFrame:
    """(bucket, i, j, side, rep, component) of those that come near to another component in their group. members: what _mixed gives, with keys and sketch."""
    most = least_odd()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ("bucket", "i", "j")):
            bucket, i, j, side, rep, component = (table.column(c).to_numpy() for c in ("bucket", "i", "j", "side", "rep", "component"))
            other = table.column("other").to_numpy()
            wide = [table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(bucket), -1) for c in ("keys", "sketch")]
            wide[1] = wide[1].view(np.uint64)  # of signed numbers, bits of the absolute value would be counted
            first = group_starts(bucket, i, j).tolist()
            hit = [flagged(side[a:b], other[a:b], rep[a:b], component[a:b], wide[0][a:b], wide[1][a:b], bucket[a], most) for a, b in zip(first, [*first[1:], len(bucket)], strict=True)]
            yield from table.select(["bucket", "i", "j", "side", "rep", "component"]).filter(pa.array(np.concatenate(hit))).to_batches()

    rows = dealt_blocks(members).select("bucket", "i", "j", "side", "other", "rep", "component", "keys", "sketch")
    return rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(run, "bucket long, i int, j int, side int, rep long, component long")


def common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets: products of 0/1 matrices over elements that several sets have."""
    m = len(sets)
    size = [len(s) for s in sets]
    row = np.repeat(np.arange(m), size)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = times[column] > 1
    row, column = row[several], (np.cumsum(times > 1) - 1)[column[several]]
    out = np.zeros((m, m), np.float64)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = max(64, (4 << 20) // m)
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        x, y = np.searchsorted(column, (a, a + width))
        part = np.zeros((m, width), np.float32)
        part[row[x:y], column[x:y] - a] = 1
        out += part @ part.T
    return out


def joining(reps: np.ndarray, component: np.ndarray, side: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links of one group that join its components: a spanning forest, so that they are fewer than the members."""
    size = np.array([len(s) for s in sets])
    both = common(sets)
    linked = 100 * both >= percent * (size[:, None] + size[None, :] - both)
    linked &= component[:, None] != component[None, :]
    linked &= side[:, None] != side[None, :]
    out, seen = [], np.zeros(len(sets), bool)
    for start in range(len(sets)):
        stack = [] if seen[start] else [start]
        seen[start] = True
        while stack:
            x = stack.pop()
            new = np.flatnonzero(linked[x] & ~seen)
            seen[new] = True
            stack.extend(new.tolist())
            out += [(int(min(reps[x], reps[y])), int(max(reps[x], reps[y]))) for y in new.tolist()]
    return out


def across(flags: DataFrame, sets: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """Links (a, b) between components among flagged members of each group, on full sets."""
    percent = round(100 * similar)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ("bucket", "i", "j")):
            bucket, i, j, side, rep, component = (table.column(c).to_numpy() for c in ("bucket", "i", "j", "side", "rep", "component"))
            held = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("set")]
            first = group_starts(bucket, i, j).tolist()
            found = [link for a, b in zip(first, [*first[1:], len(bucket)], strict=True) for link in joining(rep[a:b], component[a:b], side[a:b], held[a:b], percent)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    rows = flags.join(sets.hint("merge"), "rep").select("bucket", "i", "j", "side", "rep", "component", "set")
    return rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(run, "a long, b long").distinct()


def _labels(reps: DataFrame, links: DataFrame) -> DataFrame:
    """The component of each representative."""
    own = components(links).withColumnRenamed("node", "rep")
    return cut(reps.select("rep").join(own.hint("merge"), "rep", "left").select("rep", F.coalesce("component", "rep").alias("component")), "labels")


def _mixed(shared: DataFrame, known: DataFrame) -> DataFrame:
    """Members of buckets that hold several components: bucket, rep, component, members, others, other (not of the largest component)."""
    placed = shared.select("bucket", "rep", "members").join(known.hint("merge"), "rep")
    sizes = placed.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("bucket").agg(F.max(F.struct("n", "component")).alias("most"), F.count("*").alias("components")).filter("components > 1").select("bucket", "most.n", F.col("most.component").alias("largest"))
    found = placed.join(largest.hint("merge"), "bucket")
    return cut(found.select("bucket", "rep", "component", "members", (F.col("members") - F.col("n")).alias("others"), (F.col("component") != F.col("largest")).alias("other")), "mixed")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of (doc_id, text)."""
    rows = cut(signed(docs), "signed")
    full = rows.filter("doc_id is not null and n_shingles > 0")
    classes = full.groupBy("set_a", "set_b").agg(F.min(F.struct("doc_id", "text_hash")).alias("least"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
    reps = cut(classes.select(F.monotonically_increasing_id().alias("rep"), "least.doc_id", "least.text_hash", "set_a", "set_b", "keys", "sketch"), "classes")
    buckets = reps.select("rep", F.explode("keys").alias("bucket"))
    least = buckets.groupBy("bucket").agg(F.min("rep").alias("center"), F.count("*").alias("members")).filter("members > 1")
    shared = cut(buckets.join(least.hint("merge"), "bucket"), "buckets")
    sketches = reps.select("rep", "sketch")
    # Each class is first compared with the center it shares most buckets with; step 4 sees to the others.
    often = shared.filter("rep <> center").groupBy("rep", "center").agg(F.count("*").alias("n"))
    stars = cut(often.groupBy("rep").agg(F.max(F.struct("n", (-F.col("center")).alias("minus"))).alias("best")).select((-F.col("best.minus")).alias("a"), F.col("rep").alias("b")), "stars")
    links = cut(confirmed(cut(near(stars, sketches), "near"), reps, docs).union(_same_document(full, reps)), "confirmed")
    known = _labels(reps, links)
    left = _mixed(shared, known)
    if not left.isEmpty():
        flags = cut(candidates(left.join(reps.select("rep", "keys", "sketch").hint("merge"), "rep")), "flags")
        found = cut(across(flags, sets_of(flags.select("rep"), reps, docs)), "across")
        if not found.isEmpty():
            known = _labels(reps, links.union(found))
    placed = reps.select("rep", "doc_id", "set_a", "set_b").join(known.hint("merge"), "rep")
    named = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_class = placed.join(named, "component").select("set_a", "set_b", "component_id")
    joined = rows.select("doc_id", "n_shingles", "set_a", "set_b").join(by_class.hint("merge"), ["set_a", "set_b"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(component)
    out = joined.select("doc_id", F.col("n_shingles"), component.alias("component_id"))
    return out.select("*", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _same_document(full: DataFrame, reps: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of one doc_id: all with the least of them."""
    several = full.groupBy("doc_id").agg(F.min(F.struct("set_a", "set_b")).alias("x"), F.max(F.struct("set_a", "set_b")).alias("y")).filter("x <> y").select("doc_id")
    owned = full.join(several, "doc_id", "left_semi").select("doc_id", "set_a", "set_b").distinct().join(reps.select("set_a", "set_b", "rep"), ["set_a", "set_b"]).select("doc_id", "rep")
    return owned.join(owned.groupBy("doc_id").agg(F.min("rep").alias("a")), "doc_id").filter("a <> rep").select("a", F.col("rep").alias("b"))
