import hashlib
import re
from collections import Counter

import pytest

from critrank.llm import chunks, passages

from .conftest import prose


def brute(rows, size=20):
    """rows in order of documents."""
    seen, out = set(), []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = [False] * len(w)
        for a in range(len(w) - size + 1):
            k = tuple(w[a:a + size])
            if k in seen:
                gone[a:a + size] = [True] * size
            seen.add(k)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


@pytest.fixture(scope="module")
def copies(spark):
    """Passages at all places and distances, self-overlapping runs, near copies."""
    shared = [prose(900 + k, n) for k, n in enumerate((19, 20, 21, 40, 90, 200))]
    rows = []
    for k in range(60):
        t = prose(k, 30)
        t += " " + shared[k % 6] + " " + prose(k + 100, 25)
        if k % 4 == 0:
            t += " " + shared[(k + 2) % 6] + " tail"
        if k % 9 == 0:
            t = "again and " * 30 + t
        if k % 7 == 0:
            t = rows[k // 2][1].replace("ka", "kb", 1) if rows else t
        rows.append((k * 3, t))
    rows += [(500, rows[5][1]), (501, rows[5][1]), (502, rows[5][1].replace(" ", "\n"))]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


@pytest.mark.parametrize("size", [1500, 6 << 20])
@pytest.mark.parametrize("group", [0, 3, 20_000])
def test_planted_passages(copies, rows_of, size, group, monkeypatch):
    monkeypatch.setattr(chunks, "CHUNK_BYTES", size)
    got = passages.remove_repeats(copies, group=group).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute(sorted(rows_of(copies)))
    for r in got:
        assert sum(s["end"] - s["start"] for s in r.spans) == r.n_removed
        assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256
        assert all(a["end"] < b["start"] for a, b in zip(r.spans, r.spans[1:]))


def test_odd_and_empty_tables(odd, none, rows_of):
    rows = sorted(rows_of(odd), key=lambda r: (r[0] is not None, r[0] or 0))
    assert Counter(map(tuple, passages.digest(odd).collect())) == brute(rows)
    assert passages.digest(none).collect() == []


def test_small_table(small, rows_of):
    assert Counter(map(tuple, passages.digest(small).collect())) == brute(sorted(rows_of(small)))


def test_a_prefix_with_many_entries_in_few_chunks_is_extended(spark, rows_of, monkeypatch):
    """All documents are one chunk, so the count of chunks never made a group too large."""
    phrase = "this text was placed here under a licence that lets all people copy it and pass it on"
    rows = [(k, f"{prose(k, 14)} {phrase} {prose(k + 500, 14)}") for k in range(120)]
    rows += [(k + 200, f"{prose(7, 30)} same {phrase} {prose(8, 30)}") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    sizes, whole = [], passages.extended_answers

    def watched(chunks, counted, buckets):
        out = whole(chunks, counted, buckets)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(passages, "extended_answers", watched)
    got = passages.remove_repeats(docs, group=50).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute(sorted(rows_of(docs)))
    assert sizes


def test_copies_of_a_passage_in_a_chunk_are_one_entry(spark):
    text = prose(11, 40)
    docs = spark.createDataFrame([(k, text) for k in range(30)], "doc_id long, text string").repartition(1)
    blob = chunks.chunk_table(docs).first().blob
    found = [passages.unpack(b) for _, b in passages.ask_anchors(4)(0, chunks.Chunk(bytes(blob)))]
    assert {int(n) for _, counts in found for n in counts} == {1 << 1 | 1}
