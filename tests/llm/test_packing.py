"""Contents of packed sequences."""

import public_tokenizers

from argentum.llm import packing
from argentum.llm.session import ship
from tests.llm.data import corner_docs, frame


def test_sequences_list_their_pieces_in_order(spark):
    ship(spark)
    placed = packing.pack_documents(frame(spark, corner_docs()), public_tokenizers.path("word_bpe_49k.json"), 0, 64).cache()
    got = {r["sequence_id"]: r for r in packing.sequences(placed).collect()}
    want = {}
    for r in placed.collect():
        want.setdefault(r["sequence_id"], []).append((r["offset"], r["doc_id"], r["piece"], r["length"]))
    assert got.keys() == want.keys()
    for k, pieces in want.items():
        assert [tuple(p) for p in got[k]["pieces"]] == sorted(pieces, key=lambda p: p[0]) and got[k]["used"] == sum(p[3] for p in pieces) <= 64
