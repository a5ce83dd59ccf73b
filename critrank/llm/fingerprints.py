"""Document fingerprints: threshold-scaled sketches (FracMinHash).

A text's 5-word shingles are hashed to 64 bits; the fingerprint is the set of
all hashes below a fixed fraction of the range.  The size follows the text, so
sketches of very unequal documents can be compared: the sketch of a union is
the union of sketches, |A n B| / |A| estimates how much of A is contained in
B, and |A n B| / |A u B| how much the two are alike.

Defined results: a null text is empty; a text of fewer than 5 words is one
shingle of all its words, an empty text has none; two sketches without a hash
are alike (1.0) if their texts are equal and unlike (0.0) otherwise.  A null
doc_id comes first; rows with one doc_id follow each other by length, then
text; extra columns make no difference.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import flat_words, partitions, shingle_hashes, word_hashes

WORDS = 5
#: One in so many shingle hashes is retained.
SCALE = 8
#: Buckets of the order follow the bytes up to this number, which bounds their bounds (below 2 MB); then they grow.
BYTES_A_BUCKET = 32 << 20
BUCKETS = 10_000
#: Rows looked at for each bound of a bucket, and the characters of a text that its place has.
SAMPLE = 10
HEAD = 16


def sketches(texts: pa.Array, n: int = WORDS, scale: int = SCALE) -> list[np.ndarray]:
    """The sorted distinct retained hashes of each text."""
    offsets, words = flat_words(texts)
    hashes = word_hashes(words)
    runs_ = shingle_hashes(hashes, n)
    limit = np.uint64((1 << 64) // scale - 1)
    out = []
    for a, b in zip(offsets[:-1], offsets[1:]):
        if b - a >= n:
            own = runs_[a:b - n + 1]
        else:  # one shingle of all words
            own = shingle_hashes(hashes[a:b], int(b - a)) if b > a else runs_[:0]
        out.append(np.unique(own[own <= limit]))
    return out


def merge(*parts: np.ndarray) -> np.ndarray:
    """The sketch of texts taken together."""
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def _common(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True)) if len(a) and len(b) else 0


def likeness(a: np.ndarray, b: np.ndarray, equal: bool = False) -> float:
    """Estimated resemblance of two texts; ``equal``: the texts are the same."""
    if equal:
        return 1.0
    both = _common(a, b)
    return both / (len(a) + len(b) - both) if both else 0.0


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of A's shingles that B has (0 for an empty sketch)."""
    return _common(a, b) / len(a) if len(a) else 0.0


def to_text(sketch: np.ndarray) -> str:
    """16 hexadecimal digits a hash, ascending."""
    return sketch.astype(">u8").tobytes().hex()


def from_text(value: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(value), ">u8").astype(np.uint64)


def fingerprint(df: DataFrame, text: str, into: str, n: int = WORDS, scale: int = SCALE) -> DataFrame:
    """``df`` with the fingerprint of ``text``, as text, in column ``into``."""
    df = df.drop(*[c for c in df.columns if c.lower() == into.lower() and c.lower() != text.lower()])
    schema = df.select("*").schema.add(into, "string")

    def add(batches):
        for batch in batches:
            found = [to_text(s) for s in sketches(batch.column(text), n, scale)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())],
                                             names=[*batch.schema.names, into])

    return df.mapInArrow(add, schema)


def _place() -> Column:
    """A string whose order is that of doc_id (a null first), length and text, as far as the text's head goes."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).bitwiseXOR(F.lit(-(1 << 63)))
    return F.concat(F.lpad(F.hex(key), 16, "0"), F.lpad(F.hex(F.length("text").cast("long")), 8, "0"),
                    F.substring("text", 1, HEAD))


def _bounds(placed: DataFrame, low: str, rows: int, n: int) -> list[str]:
    """At most n - 1 places above ``low`` that deal the rows to n buckets, from about ``SAMPLE`` * n of the places.

    The sample only sets where buckets end; results don't depend on it.
    """
    every = max(1, rows // (SAMPLE * n))
    seen = placed.where(F.pmod(F.xxhash64("place"), F.lit(every)) == 0).select("place").distinct()
    found = sorted(r.place for r in seen.collect())
    return sorted({found[k * len(found) // n] for k in range(1, n)} - {low}) if found else []


def in_order(docs: DataFrame) -> DataFrame:
    """Rows dealt to buckets of consecutive places, each with the row after its last.

    Bucket bounds are places that occur; the rows of a bound go to their own bucket
    and, as ``guard``, to the bucket before; the rows of the smallest place go to the
    last bucket too.  One shuffle of the texts, no global sort.  Rows of one doc_id, or
    of none, are spread by length and head; a bucket is sorted by Spark and read as a
    stream, so its size bounds no task's memory.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    placed = rows.withColumn("place", _place())
    size = placed.agg(F.sum(F.octet_length("text")).alias("b"), F.min("place").alias("low"), F.count("*").alias("n")).first()
    n = min(BUCKETS, max(partitions(docs.sparkSession), int((size.b or 0) // BYTES_A_BUCKET) + 1))
    low = size.low
    bounds = _bounds(placed, low, size.n, n) if n > 1 and size.n else []
    last = len(bounds)

    def deal(batches):
        for batch in batches:
            places = batch.column("place").to_pylist()
            own = np.array([bisect_right(bounds, p) for p in places], np.int32)
            # the bucket before, for a bound; the last one, for the first document
            first = np.array([p == low for p in places], bool)
            before = np.where(first, last, np.array([bisect_left(bounds, p) for p in places], np.int32))
            copy = np.flatnonzero((before != own) | first)
            taken = batch.take(pa.array(np.concatenate([np.arange(len(places)), copy])))
            bucket = np.concatenate([own, before[copy]]).astype(np.int32)
            guard = np.concatenate([np.zeros(len(places), bool), np.ones(len(copy), bool)])
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(bucket), pa.array(guard)],
                                             names=[*taken.schema.names, "bucket", "guard"])

    dealt = placed.mapInArrow(deal, "doc_id long, text string, place string, bucket int, guard boolean")
    return (dealt.repartitionById(last + 1, F.col("bucket"))
            .sortWithinPartitions("bucket", "guard", "place", "text"))


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: its fingerprint, and that of its edited text.

    Edited: the last floor(n/4) code points give way to the first as many (or
    all) of the next document's text; the last document's next is the first.
    """

    def compare(rows):
        """rows: dicts of text and sketch, in order; yields a result for all but the last."""
        edited = []
        for a, b in zip(rows[:-1], rows[1:]):
            k = len(a["text"]) // 4
            edited.append(a["text"][:len(a["text"]) - k] + b["text"][:k])
        for a, b, text, sketch in zip(rows[:-1], rows[1:], edited, sketches(pa.array(edited, pa.large_string()))):
            yield {"doc_id": a["doc_id"], "n_chars": len(a["text"]),
                   "edited_sha256": hashlib.sha256(text.encode()).hexdigest(),
                   "fingerprint": to_text(a["sketch"]), "edited_fingerprint": to_text(sketch),
                   "near_edited": likeness(a["sketch"], sketch, a["text"] == text),
                   "near_next": likeness(a["sketch"], b["sketch"], a["text"] == b["text"]),
                   "contained_in_edited": containment(a["sketch"], sketch)}

    kinds = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
                       ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
                       ("near_edited", pa.float64()), ("near_next", pa.float64()),
                       ("contained_in_edited", pa.float64())])

    def walk(batches):
        held, bucket, done = None, None, False  # the row before; whether this bucket's guard has come
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                rows = [{"doc_id": i, "text": t, "sketch": s, "bucket": k, "guard": g} for i, t, s, k, g in zip(
                    part.column("doc_id").to_pylist(), part.column("text").to_pylist(),
                    sketches(part.column("text")), part.column("bucket").to_pylist(),
                    part.column("guard").to_pylist())]
                groups: list[list[dict]] = [[held]] if held else [[]]
                for row in rows:
                    if row["bucket"] != bucket:
                        bucket, done = row["bucket"], False
                        groups.append([])
                    if not done:
                        groups[-1].append(row)
                        done = row["guard"]  # of a bound's rows, the first is the next document
                held = None if done else groups[-1][-1]
                found = [x for g in groups for x in compare(g)]
                if found:
                    yield pa.RecordBatch.from_pylist(found, schema=kinds)

    return in_order(docs).select("doc_id", "text", "bucket", "guard").mapInArrow(
        walk, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double, contained_in_edited double")
