"""``text.tokens`` inside tasks: the tokens of an Arrow column, found on its bytes.

Texts come lower-cased by Spark, so both tokenisers lower alike.  Every byte of a
character outside ASCII is 128 or more, so the runs of ``[a-z0-9]`` are found on bytes
without decoding, a whole batch at once and without an object per token.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from critrank.functions.text import col_

#: Rows whose tokens are in memory at a time.
ROWS = 1024


def token_runs(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(all tokens in order, how many each text has) of lower-case ``texts``; a null has none."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    n = len(texts)
    _, at, held = texts.buffers()
    if not n or held is None:
        return pa.array([], pa.string()), np.zeros(n, np.int32)
    offsets = np.frombuffer(at, np.int32)[texts.offset:texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(held, np.uint8)[offsets[0]:offsets[-1]]
    offsets -= offsets[0]
    word = ((data >= ord("a")) & (data <= ord("z"))) | ((data >= ord("0")) & (data <= ord("9")))
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    full = np.flatnonzero(offsets[1:] > offsets[:-1])  # a text's edges end a run, whatever its neighbours hold
    first[offsets[:-1][full]] = word[offsets[:-1][full]]
    last[offsets[1:][full] - 1] = word[offsets[1:][full] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    cuts = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=cuts[1:])
    tokens = pa.StringArray.from_buffers(len(starts), pa.py_buffer(cuts), pa.py_buffer(data[word]))
    return tokens, np.diff(np.searchsorted(starts, offsets)).astype(np.int32)


def token_digest(lower_text, vocabulary: list[str], with_terms: bool) -> Column:
    """STRUCT(dl, found, terms) of a lower-case text, null for a null.

    ``dl``: its tokens; ``found``: those of ``vocabulary``, in order, repeats kept;
    ``terms``: the distinct tokens, in any order (null without ``with_terms``).
    """
    wanted = sorted(set(vocabulary))
    strings = T.ArrayType(T.StringType())
    kind = T.StructType([T.StructField("dl", T.LongType()), T.StructField("found", strings), T.StructField("terms", strings)])

    def lists(rows: np.ndarray, n: int, values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)), values)

    def of(texts: pa.Array) -> pa.Array:
        n = len(texts)
        tokens, dl = token_runs(texts)
        coded = tokens.dictionary_encode()
        codes, words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
        row = np.repeat(np.arange(n), dl)
        hit = pc.is_in(words, pa.array(wanted, pa.string())).to_numpy(zero_copy_only=False)[codes].astype(bool)
        found = lists(row[hit], n, words.take(pa.array(codes[hit])))
        if with_terms:
            key = np.unique(row * max(len(words), 1) + codes)
            terms = lists(key // max(len(words), 1), n, words.take(pa.array(key % max(len(words), 1))))
        else:
            terms = pa.nulls(n, pa.list_(pa.string()))
        return pa.StructArray.from_arrays([pa.array(dl.astype(np.int64)), found, terms], ["dl", "found", "terms"],
                                          mask=texts.is_null())

    @F.arrow_udf(kind)
    def digest(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([of(texts.slice(a, ROWS)) for a in range(0, max(len(texts), 1), ROWS)])

    return digest(col_(lower_text))
