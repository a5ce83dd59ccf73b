"""Containment of user-sized lexicons (D1, D2, C4 with thousands of terms).

The rules and anchors of a catalog are a few dozen ``contains`` expressions.  A
lexicon of thousands of terms doesn't compile that way, and a join on containment
compares every text with every term.  Here the lexicon is a table; a task builds an
Aho-Corasick automaton of its terms once and reads each text once, however many
terms there are.

The lexicon travels in blocks of ``BLOCK_BYTES``: its size is measured first, a
larger one is split by term, and each block is one more scan of the texts.  Counts
of a group add up over blocks, as no term is in two of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from critrank.functions import text as tx
from critrank.session import materialize

#: Bytes of terms (with 100 more for each) that travel at a time.
BLOCK_BYTES = 32 << 20
#: Texts whose terms are in a task's memory at a time.
PIECE_ROWS = 64


def matches(batches: Iterator[pa.RecordBatch], keys: list[str], terms: dict[str, list],
            arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of ``arrow`` for the texts of ``batches``, ``PIECE_ROWS`` texts at a time.

    What a text contains is many times its size as Python objects, so a piece is small
    however many rows an Arrow batch has.
    """
    if not terms:
        return
    import ahocorasick
    automaton = ahocorasick.Automaton()
    for t in terms:
        automaton.add_word(t, t)
    automaton.make_automaton()
    for batch in batches:
        for p in range(0, batch.num_rows, PIECE_ROWS):
            piece = batch.slice(p, PIECE_ROWS)
            at, groups, hits, matched = [], [], [], []
            for i, text in enumerate(piece.column("_text")):
                text = text.as_py()
                by: dict = {}
                for t in sorted({t for _, t in automaton.iter(text)}) if text else ():
                    for g in terms[t]:
                        by.setdefault(g, []).append(t)
                for g, ts in by.items():
                    at.append(i)
                    groups.append(g)
                    hits.append(len(ts))
                    matched.append(ts)
            if at:
                yield pa.RecordBatch.from_arrays(
                    [*[piece.column(c).take(pa.array(at)) for c in keys], pa.array(groups, arrow.field("group").type),
                     pa.array(hits, pa.int64()), pa.array(matched, pa.list_(pa.string()))],
                    names=[*keys, "group", "hits", "terms"]).cast(arrow)


def _found(rows: DataFrame, keys: list[str], terms: dict[str, list], group_type: T.DataType) -> DataFrame:
    """(*keys, group, hits, terms) of each row and group with a term of the block."""
    out = T.StructType([*[rows.schema[c] for c in keys], T.StructField("group", group_type),
                        T.StructField("hits", T.LongType()), T.StructField("terms", T.ArrayType(T.StringType()))])
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow, find = to_arrow_schema(out), matches

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return find(batches, keys, terms, arrow)

    return rows.mapInArrow(run, out)


def lexicon_hits(df: DataFrame, keys: list[str], text_col: str, lexicon: DataFrame,
                 block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(*keys, group, hits, terms): how many terms of a group a text contains, and which, sorted.

    ``lexicon``: (group, term).  A term is a substring, without word boundaries, and
    counts once a text; a term listed twice in a group counts once.  Compare in one
    case and one spacing: pass text and terms normalised alike.  Null and empty terms
    are left out, null texts contain nothing; only groups with a hit give a row.
    ``keys`` identify rows where the lexicon has more than one block.
    """
    known = materialize(lexicon.where("term is not null and term <> ''").select("group", "term").distinct(), "lexicon")
    total = known.agg(F.sum(F.octet_length("term") + 100)).first()[0] or 0
    blocks = total // block_bytes + 1
    rows = df.select(*keys, F.col(text_col).alias("_text"))
    part, found = F.pmod(F.xxhash64("term"), F.lit(blocks)), None
    for p in range(blocks):
        terms: dict[str, list] = {}
        for r in known.where(part == p).collect():  # block_bytes
            terms.setdefault(r["term"], []).append(r["group"])
        if not terms and blocks > 1:
            continue
        one = _found(rows, keys, terms, known.schema["group"].dataType)
        if blocks > 1:
            one = materialize(one, "lexicon-hits")
        found = one if found is None else found.unionByName(one)
    if blocks == 1:
        return found
    return found.groupBy(*keys, "group").agg(F.sum("hits").alias("hits"), F.array_sort(
        F.flatten(F.collect_list("terms"))).alias("terms"))  # the terms of one text


def anchor_map(paras: DataFrame, anchors: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(jd_id, para_no, dim, hits): ``criteria.anchor_map`` for a table of anchors (dim, anchor) of any size."""
    texts = paras.select("jd_id", "para_no", tx.normalize_ws("text").alias("text"))
    terms = anchors.select(F.col("dim").alias("group"), F.lower("anchor").alias("term"))
    hits = lexicon_hits(texts, ["jd_id", "para_no"], "text", terms, block_bytes)
    return hits.select("jd_id", "para_no", F.col("group").alias("dim"), "hits")
