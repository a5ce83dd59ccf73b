import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from critrank.llm import fingerprints as fp

from .conftest import prose


def expected(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, len(r[1]), r[1]))
    out = Counter()
    for (i, a), (_, b) in zip(rows, rows[1:] + rows[:1]):
        k = len(a) // 4
        e = a[:len(a) - k] + b[:k]
        s, n, o = (x for x in fp.sketches(pa.array([a, e, b])))
        out[i, len(a), hashlib.sha256(e.encode()).hexdigest(), fp.to_text(s), fp.to_text(n),
            fp.likeness(s, n, a == e), fp.likeness(s, o, a == b)] += 1
    return out


@pytest.mark.parametrize("table", ["odd", "small"])
@pytest.mark.parametrize("parts", [1, 6])
def test_digest(table, parts, request, rows_of, spark):
    df = request.getfixturevalue(table)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    got = fp.digest(df.repartition(parts)).collect()
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert Counter(tuple(r)[:7] for r in got) == expected(rows_of(df))


def test_rows_without_an_id_are_spread(spark, rows_of, monkeypatch):
    monkeypatch.setattr(fp, "BYTES_A_BUCKET", 3000)
    rows = [(None, prose(k, 20 + k % 9)) for k in range(300)] + [(5, "same text here")] * 40 + [(-3, None), (9, "é" * 50)]
    rows += [(k, prose(k, 12)) for k in range(-20, 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert Counter(tuple(r)[:7] for r in fp.digest(df).collect()) == expected(rows_of(df))
    dealt = fp.in_order(df).where("doc_id is null and not guard").groupBy("bucket").count().collect()
    assert len(dealt) > 8 and max(r["count"] for r in dealt) < 150


def test_few_buckets(small, rows_of, monkeypatch):
    monkeypatch.setattr(fp, "BUCKETS", 2)
    assert Counter(tuple(r)[:7] for r in fp.digest(small).collect()) == expected(rows_of(small))


def test_one_row_and_none(spark, none):
    assert fp.digest(none).collect() == []
    one = fp.digest(spark.createDataFrame([(7, "a b c d e f g h")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_sketches_estimate_and_merge():
    a, b = prose(1, 8000), prose(2, 8000)
    whole = a + " " + b
    sa, sb, sw = fp.sketches(pa.array([a, b, whole]))
    assert abs(fp.containment(sa, sw) - 1) < 0.01 and fp.likeness(sa, sb) < 0.02
    assert abs(fp.likeness(sa, sw) - 0.5) < 0.08
    assert fp._common(fp.merge(sa, sb), sw) == len(fp.merge(sa, sb))
    assert (fp.from_text(fp.to_text(sa)) == sa).all() and len(sa) == pytest.approx(8000 / fp.SCALE, rel=0.15)
    assert (np.diff(sa.astype(object)) > 0).all()


def test_fingerprint_keeps_columns(odd):
    out = fp.fingerprint(odd, "text", "score")
    assert out.columns == [c for c in odd.columns if c != "score"] + ["score"] and out.count() == odd.count()
