"""A task holds what few texts contain, however many rows an Arrow batch has."""

import pyarrow as pa

from critrank.operators import lexicon


def test_pieces_of_a_large_batch_are_small_and_whole():
    n = 5 * lexicon.PIECE_ROWS + 3
    batch = pa.record_batch({"id": list(range(n)), "_text": [None if i % 10 == 0 else f"one two {i}" for i in range(n)]})
    arrow = pa.schema([("id", pa.int64()), ("group", pa.int64()), ("hits", pa.int64()), ("terms", pa.list_(pa.string()))])
    out = list(lexicon.matches(iter([batch]), ["id"], {"one": [1, 2], "two": [2], "three": [3]}, arrow))
    assert max(len(set(b.column("id").to_pylist())) for b in out) <= lexicon.PIECE_ROWS
    rows = [tuple(r.values()) for b in out for r in b.to_pylist()]
    want = [(i, g, h, t) for i in range(n) if i % 10 for g, h, t in ((1, 1, ["one"]), (2, 2, ["one", "two"]))]
    assert sorted(rows) == sorted(want)
