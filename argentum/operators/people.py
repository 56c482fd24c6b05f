"""People: faces whose vectors are alike, joined under limits that depend on whole groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import acos

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argentum.functions.scalar import dot, valid_vector
from argentum.operators import rounds
from argentum.operators.components import components
from argentum.operators.metric import Angle, Index, index
from argentum.operators.rounds import DIGITS
from argentum.plans.shared import cut

LINK, LEAST, MEAN = 0.60, 0.45, 0.50
PIXELS = 40
#: Members of a component that one task resolves, with a matrix of 33 MB; and links a vector, above which they are no table.
ALONE, LINKS = 2048, 32


def candidates(faces: DataFrame, signatures: DataFrame, photos: DataFrame, version: str, size: int = 128) -> DataFrame:
    """Faces that are large enough, with a usable vector of this version; photos: active ones with absolute_path."""
    big = faces.filter(F.least("bbox_width", "bbox_height") >= PIXELS).select("photo_id", "face_index")
    own = signatures.filter(F.col("version") == version).select("photo_id", "face_index", F.from_json("signature", "array<float>").alias("vector"))
    here = photos.select(F.col("id").alias("photo_id"), "absolute_path")
    return big.join(own, ["photo_id", "face_index"]).join(here, "photo_id").filter(valid_vector(F.col("vector"), size))


def _index(vectors: DataFrame, least: float, carried: tuple[str, ...], **sizes: int) -> Index:
    """Vectors by their angles; for vectors that aren't of unit length the angle is that of the longest two."""
    squares = vectors.agg(F.max(dot(F.col("vector"), F.col("vector")))).first()[0] or 0.0
    return index(vectors.select("id", F.col("vector").alias("value"), *carried), Angle, acos(min(1.0, least / max(squares, 1e-300))), carried=carried, **sizes)


def _raw(rows: pa.RecordBatch) -> np.ndarray:
    flat = rows.column("value").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(rows), -1)


def _codes(one: pa.RecordBatch, two: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Numbers for the values of a column of two sets of rows, and the values."""
    both = pa.concat_arrays([one.column(name), two.column(name)]).dictionary_encode()
    at = both.indices.to_numpy()
    return at[: len(one)], at[len(one) :], both.dictionary


def links(vectors: DataFrame, least: float = LINK, **sizes: int) -> DataFrame:
    """Pairs (a < b, score) of different photos whose vectors' product is at least `least` (above 0). vectors: id, photo_id, vector.

    Vectors meet in a metric index, and pairs are scored where they meet. sizes: of the index.
    """
    kind = vectors.schema["id"].dataType.simpleString()

    def made(one: pa.RecordBatch, two: pa.RecordBatch) -> Callable:
        import pyarrow.compute as pc

        x, y = _raw(one), _raw(two)
        p, q, _ = _codes(one, two, "photo_id")

        def some(i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
            i, j = i[p[i] != q[j]], j[p[i] != q[j]]
            score = np.zeros(len(i))
            for k in range(x.shape[1]):  # summed in the order of the vector, the same on every machine
                score += x[i, k] * y[j, k]
            i, j, score = (v[score >= least] for v in (i, j, score))
            a, b = one.column("id").take(pa.array(i)), two.column("id").take(pa.array(j))
            return pa.RecordBatch.from_arrays([pc.min_element_wise(a, b), pc.max_element_wise(a, b), pa.array(score)], ["a", "b", "score"])

        return some

    return _index(vectors, least, ("photo_id",), **sizes).pairs(made, f"a {kind}, b {kind}, score double")


def groups(vectors: DataFrame, link: float = LINK, least: float = LEAST, mean: float = MEAN, by: tuple[str, ...] = ("id",), alone: int = ALONE) -> DataFrame:
    """(person_key, id, photo_id, size): links from the strongest down join groups that share no photo, if no cross pair
    is under `least` and their mean reaches `mean`. Groups of one are left out. Scores count with nine digits; equal ones are in the order of `by`.

    Groups never reach beyond a component of the links. Where links are few, components of at most `alone` members are resolved in
    one task each. Larger ones, and all rows where links are many, are resolved in rounds without a table of links
    (`operators/rounds.py`). The result is the same for any `alone`.
    """
    rows = rounds.placed(vectors.filter("vector is not null"), by)
    if few_links(rows, link):
        score = F.round("score", DIGITS)
        strong = cut(links(rows, link - 1e-9).select("a", "b", score.alias("score")).filter(F.col("score") >= link), "alike")
        few, many = _by_size(rows, strong, alone)
        members = cut(rounds.decided(rounds.begun(few, "component"), None, link, least, mean), "clusters").select("cluster", "id", "photo_id")
        if not many.isEmpty():
            members = members.union(rounds.in_rounds(many, link, least, mean, alone))
    else:
        members = rounds.in_rounds(rows, link, least, mean, alone)
    named = members.groupBy("cluster").agg(F.min(F.struct("photo_id", "id")).alias("first"), F.count("*").alias("size")).filter("size > 1")
    key = F.concat(F.col("first.photo_id").cast("string"), F.lit(":"), F.col("first.id").cast("string"))
    return members.join(named, "cluster").select(key.alias("person_key"), "id", "photo_id", "size")


def few_links(vectors: DataFrame, link: float) -> bool:
    """Whether links are at most LINKS a vector, by a sample that meets all; always for at most ALONE vectors."""
    n = vectors.count()
    if n <= ALONE:
        return True
    own = F.pmod(F.xxhash64("id"), F.lit(max(1, n // ALONE))) == 0
    sample = vectors.filter(own).select(F.col("vector").cast("array<float>").alias("value")).limit(4 * ALONE).toArrow().combine_chunks()
    some = _raw(sample.to_batches()[0]).T if len(sample) else np.zeros((1, 0))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sum(int((_raw(batch.slice(i, 512)) @ some >= link).sum()) for i in range(0, len(batch), 512)) if some.size else 0
            yield pa.RecordBatch.from_arrays([pa.array([found])], ["n"])

    found = vectors.select(F.col("vector").cast("array<float>").alias("value")).mapInArrow(count, "n long").agg(F.sum("n")).first()[0] or 0
    return found / 2 <= LINKS * max(1, len(sample))


def _by_size(vectors: DataFrame, pairs: DataFrame, alone: int) -> tuple[DataFrame, DataFrame]:
    """Vectors with a link, with component and members (how many); those in components of at most `alone`, and the others."""
    rows = vectors.join(components(pairs.select("a", "b")).withColumnRenamed("node", "id"), "id")
    rows = cut(rows.join(rows.groupBy("component").agg(F.count("*").alias("members")), "component"), "faces")
    return rows.filter(F.col("members") <= alone), rows.filter(F.col("members") > alone)


def with_photos(people: DataFrame, photos: DataFrame) -> DataFrame:
    """People whose photos are still there, with at least two of them: key, size, faces (in order)."""
    here = people.join(photos.select(F.col("id").alias("photo_id")), "photo_id", "left_semi")
    nested = here.groupBy("person_key").agg(F.count("*").alias("size"), F.sort_array(F.collect_list(F.struct("photo_id", "id"))).alias("faces"))
    return nested.filter("size >= 2").orderBy(F.desc("size"), "person_key")


def preview(people: DataFrame, shown: int = 7) -> DataFrame:
    """The first faces of each person, and how many more there are."""
    return people.select("person_key", F.slice("faces", 1, shown).alias("faces"), F.greatest(F.size("faces") - shown, F.lit(0)).alias("more"))
