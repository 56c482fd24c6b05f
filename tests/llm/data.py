"""Small tables with nulls, empty and long texts, ties, repeated rows and extra columns with clashing names."""

import random

SCHEMA = "doc_id long, text string, n_removed string, part int, score string, bucket long"
NONE = ("x", 1, "y", 2)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corner_docs(seed=3):
    """Rows (doc_id, text): what operators must stand."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randrange(20, 90)) for _ in range(12)]
    passage = prose(rng, 40)
    out = [(i, t) for i, t in enumerate(base)]
    out += [(20 + i, base[i]) for i in range(4)]  # copies
    for i in range(6):  # near copies
        w = base[i].split()
        w[len(w) // 2] = f"edit{i}"
        out.append((30 + i, " ".join(w)))
    out += [(40 + i, f"{prose(rng, 15)} {passage} {prose(rng, 12)}") for i in range(5)]
    out += [(50, None), (51, ""), (52, " \t\n\r "), (53, "one"), (54, "Two Words"), (55, "two words"), (56, "é漢字🙂 " * 60), (57, "ab" * 400), (58, "ab" * 300 + " end"), (59, "x" * 5000)]
    out += [(60, base[0]), (60, base[0]), (61, "same id one " * 9), (61, "same id two " * 9), (None, base[1]), (None, None)]
    out += [(70, prose(rng, 6000)), (71, "don't we'll I'VE  it's\n\n  ok '' 's 12 3.5 ñandú"), (-5, base[2])]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, *NONE) for r in rows], SCHEMA)
