"""Centroid clustering, vector codes and the URL filter against plain versions."""

import hashlib
import math
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from critrank.llm import centroids, codes, lloyd, urls

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, v int, entries double"


def vectors(n, dim=64, seed=5):
    r = np.random.default_rng(seed)
    means = r.normal(size=(7, dim)) * 0.2
    x = (means[r.integers(0, 7, n)] + r.normal(size=(n, dim)) * 0.1).astype(np.float32)
    x[1::9] = x[0]  # a large group of equal vectors
    return x


@pytest.fixture(scope="module")
def table(spark):
    x = vectors(700)
    rows = [(int(i * 7 % 703), v.tolist(), int(i % 3) or None, "c", 1, 2.5) for i, v in enumerate(x)]
    good = rows[5][1]
    rows += [rows[3], rows[3], (None, good, 1, None, 0, 0.0), (None, good, None, None, 0, 0.0), (800, None, 1, "", 0, 0.0),
             (801, good[:63], 1, "", 0, 0.0), (802, good[:5] + [None] + good[6:], 1, "", 0, 0.0),
             (803, [NAN] + good[1:], 1, "", 0, 0.0), (804, [-INF] + good[1:], 1, "", 0, 0.0), (805, [], 1, "", 0, 0.0),
             (806, [3e38] + good[1:], 2, "", 0, 0.0)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def kept(df, scale, dim=64):
    out = []
    for r in df.select("vec_id", "embedding", "label").collect():
        v = r.embedding
        if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v):
            out.append((r.vec_id, r.label, tuple(max(-lloyd.LIMIT, min(lloyd.LIMIT, math.floor(scale * x))) for x in v)))
    return out


def nearest(v, entries):
    d = [sum((a - b) ** 2 for a, b in zip(v, e)) for e in entries]
    return d.index(min(d)), min(d)


def plain_rounds(vs, entries, rounds):
    for _ in range(rounds):
        groups = defaultdict(list)
        for v in vs:
            groups[nearest(v, entries)[0]].append(v)
        entries = [tuple(sum(c) // len(c) for c in zip(*groups[i])) if groups[i] else e for i, e in enumerate(entries)]
    return entries


def plain_clusters(rows, k=40):
    order = sorted(rows, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[2]))
    cs = plain_rounds([r[2] for r in rows], [r[2] for r in order[:k]], 5)
    found = [(r[0], *nearest(r[2], cs)) for r in rows]
    per = Counter()
    for _, c, d in found:
        per[c] += d
    return Counter((i, c, d, per[c], sum(per.values()),
                    hashlib.sha256(",".join(map(str, cs[c])).encode()).hexdigest()) for i, c, d in found)


def test_clusters_equal_the_plain_rounds(table):
    got = centroids.digest(table).collect()
    assert Counter(map(tuple, got)) == plain_clusters(kept(table, 256))
    again = centroids.digest(table.repartition(11)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_clusters_of_few_or_no_vectors(table, spark):
    few = table.where("vec_id < 9")
    assert Counter(map(tuple, centroids.digest(few).collect())) == plain_clusters(kept(few, 256))
    assert centroids.digest(table.limit(0)).count() == 0
    equal = spark.createDataFrame([(i, [0.5] * 64) for i in range(90)], "vec_id long, embedding array<double>")
    assert {(r.cluster, r.distance, r.inertia) for r in centroids.digest(equal).collect()} == {(0, 0, 0)}


@pytest.mark.parametrize("search", [centroids.MeanOrder, codes.Gnat])
@pytest.mark.parametrize("n", [1, 2, 16, 17, 100, 256])
def test_searches_are_exact_and_leave_work_out(search, n):
    r = np.random.default_rng(n)
    book = r.integers(-40, 40, (n, 8))
    book[n // 2:] = np.where(r.random((n - n // 2, 1)) < 0.3, book[0], book[n // 2:])  # equal entries
    x = np.concatenate([r.integers(-60, 60, (500, 8)), book, (book[:-1] + book[1:]) // 2])
    tree = search(book)
    which, d = tree.nearest(x)
    whole = ((x[:, None] - book[None]) ** 2).sum(2)
    assert (which == whole.argmin(1)).all() and (d == whole.min(1)).all()
    if n == 256:
        clustered = np.repeat(r.integers(-4000, 4000, (16, 8)), 16, 0) + r.integers(-9, 9, (256, 8))
        tree = search(clustered)
        which, _ = tree.nearest(clustered)
        done = tree.measured if search is centroids.MeanOrder else tree.total_measured()
        assert (which == ((clustered[:, None] - clustered[None]) ** 2).sum(2).argmin(1)).all()
        assert done < 256 * 256 / 3


def plain_codes(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:256]
    books, found = [], [[] for _ in rows]
    for p in range(4):
        part = [r[2][16 * p:16 * p + 16] for r in rows]
        books.append(plain_rounds(part, [r[2][16 * p:16 * p + 16] for r in order], 4))
        for f, v in zip(found, part):
            f.append(nearest(v, books[-1]))
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    errors = [sum(d for _, d in f) for f in found]
    per = Counter()
    for r, e in zip(rows, errors):
        per[r[1]] += e
    return Counter((r[0], "".join(f"{c:02x}" for c, _ in f), e, per[r[1]], sha) for r, f, e in zip(rows, found, errors))


def test_codes_equal_the_plain_rounds(table):
    some = table.where("vec_id is null or vec_id < 330 or vec_id > 690").where("vec_id is null or vec_id <> 806")
    rows = kept(some, 1024)
    assert len(rows) > 256
    got = codes.digest(some).collect()
    assert Counter(map(tuple, got)) == plain_codes(rows)
    few = table.where("vec_id < 12")
    assert Counter(map(tuple, codes.digest(few.repartition(3)).collect())) == plain_codes(kept(few, 1024))
    assert codes.digest(table.limit(0)).count() == 0


def test_the_smallest_rows(spark):
    ids = [5] * 3000 + list(range(-50, 50)) + [None] * 40 + [2**62, -2**62, 2**63 - 1, -2**63]
    df = spark.createDataFrame([(i, n) for n, i in enumerate(ids)], "k long, n long").repartition(6)
    order = [F.col("k").asc_nulls_last(), F.col("n").asc()]
    for k in (1, 10, 57, 100, 3120, 4000):
        got = [tuple(r) for r in lloyd.smallest(df, "k", order, k).collect()]
        want = sorted(((i, n) for n, i in enumerate(ids)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:k]
        assert sorted(got, key=str) == sorted(want, key=str)


# ------------------------------------------------------------------------- URLs
def pages_of(spark, rows):
    return spark.createDataFrame([(i, u, "x", "y", 1) for i, u in rows],
                                 "page_id long, url string, host string, rule string, n int").repartition(3)


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def web(spark):
    """Bad hosts, one bad host among good ones, a small host of a bad domain, odd urls."""
    rows = [(i, f"http://h{i % 9}.bad.org/en/{i}") for i in range(400)]
    rows += [(1000 + i, f"https://WWW.good.org/De/{i}?x=/y#z") for i in range(400)]
    rows += [(2000 + i, f"http://spam.good.org:8080/{i}") for i in range(200)]
    rows += [(3000, "http://new.bad.org/"), (3001, "http://new.good.org/"), (3002, "http://alone.net/x")]
    odd = [None, "", "no scheme", "http://", "://x", "http://a.com", "http://a.com/", "http://a.com?q=/", "ftp://u:p@EXAMPLE.com:21/en/a",
           "http://example.com/en/", "http://sub.example.com/en/x://y/", "http://www.example.com/en/1", "http://m.www.example.com/en/1",
           "http://notexample.com/en/1", "http://example.com/EN/1", "http://x.net/es/1", "http://x.net/es", "http://net/fr/1", "https://10.0.0.1/a",
           "http://[::1]:80/a", "http://a.co.uk/1", "http://b.co.uk/", "http://Ä.com/é\n/z", "http://..com./x", "http://a" + "b" * 40000 + ".com/en/" + "c" * 40000]
    rows += [(4000 + n, u) for n, u in enumerate(odd)] + [(None, "http://a.com/"), (4006, "http://a.com/"), (4006, "http://a.com/")]
    marks = [(i, 1, 1) for i in range(400)] + [(1000 + i, 1, int(i % 50 == 0)) for i in range(400)]
    marks += [(2000 + i, 0, 0) for i in range(200)] + [(5, 1, 0), (None, 0, 1), (1001, None, None), (1002, 1, None), (99999, 0, 1)]
    return pages_of(spark, rows), labels_of(spark, marks)


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = rest[:cut], rest[cut:]
    cut = min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), rest[:cut]


def plain_rule(host, path):
    fits = [(len(h) + len(p), len(h), h + p, a) for a, h, p in urls.RULES
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else (None, None)


def test_rules_and_parts(web):
    pages, labels = web
    got = urls.digest(pages, labels).collect()
    inputs = [(r.page_id, r.url) for r in pages.collect()]
    assert Counter((r.page_id, r.host, r.path, r.rule) for r in got) == Counter(
        (i, *plain_parts(u), plain_rule(*plain_parts(u))[0]) for i, u in inputs)
    assert all(r.verdict == plain_rule(r.host, r.path)[1] for r in got if r.rule)
    assert {r.rule for r in got} == {None, *(h + p for _, h, p in urls.RULES)}


def test_reputation(web):
    pages, labels = web
    got = {r.page_id: r for r in urls.digest(pages, labels).collect()}
    assert {got[i].verdict for i in range(400)} == {"block"} and got[3000].verdict == "block"
    assert {got[1000 + i].verdict for i in range(400)} == {"allow"}
    assert {got[2000 + i].verdict for i in range(200)} == {"block"}
    assert got[3001].verdict == "allow" and got[3002].verdict == "allow"
    # the rate of an unseen host is its domain's, with a wider bound
    assert got[3000].bad_rate > 0.9 and got[3000].bad_rate_bound < got[0].bad_rate_bound


def test_posterior_by_hand(web):
    """The chain of shrunk rates, in plain Python."""
    pages, labels = web
    bad = {}
    for r in labels.collect():
        b = True if r.toxic == 1 or r.quality == 0 else None if r.toxic is None or r.quality is None else False
        if r.doc_id is not None and b is not None:
            bad[r.doc_id] = bad.get(r.doc_id, False) or b
    hosts = defaultdict(lambda: [0, 0])
    for r in pages.collect():
        c = hosts[plain_parts(r.url)[0]]
        if r.page_id in bad:
            c[0] += 1
            c[1] += bad[r.page_id]

    def domain(h):
        b = h.rsplit("@", 1)[-1]
        b = b[:len(b) - len(b.split(":")[-1]) - 1] if ":" in b and (b.split(":")[-1].isdigit() or b.endswith(":")) else b
        l = b.split(".")
        if b.startswith("[") or (len(l) == 4 and all(x.isdigit() for x in l)):
            return b, ""
        n = 2 if len(l) > 1 and len(l[-1]) == 2 and l[-2] in urls.SECOND_LEVEL else 1
        return ".".join(l[-n - 1:]), ".".join(l[-n:])

    def level(counts, parent):
        over = sum((k - n * m) ** 2 - n * m * (1 - m) for c, (n, k) in counts.items() for m in [parent(c)])
        room = sum(n * (n - 1) * m * (1 - m) for c, (n, k) in counts.items() for m in [parent(c)])
        rho = min(0.5, max(1 / 1001, over / room)) if room > 0 else 0.5
        s = 1 / rho - 1
        return s, {c: (k + s * parent(c)) / (n + s) for c, (n, k) in counts.items()}

    domains, suffixes = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for h, (n, k) in hosts.items():
        for where, key in ((domains, domain(h)), (suffixes, domain(h)[1])):
            where[key][0] += n
            where[key][1] += k
    whole = (sum(k for _, k in suffixes.values()) + 0.5) / (sum(n for n, _ in suffixes.values()) + 1)
    _, top = level(suffixes, lambda c: whole)
    _, mid = level(domains, lambda c: top[c[1]])
    s, rate = level(hosts, lambda h: mid[domain(h)])
    for r in urls.digest(pages, labels).collect():
        (n, k), m = hosts[r.host], mid[domain(r.host)]
        a, b = k + s * m, n - k + s * (1 - m)
        assert r.bad_rate == pytest.approx(rate[r.host], abs=2e-6)
        assert r.bad_rate_bound == pytest.approx(rate[r.host] - 1.645 * math.sqrt(a * b / (a + b) ** 2 / (a + b + 1)), abs=2e-6)
        if r.rule is None:
            assert r.verdict == ("block" if r.bad_rate_bound > 0.5 else "allow")


def test_url_sql_and_empty_tables(web, spark):
    pages, labels = web
    usable = pages.where("url is null or not url like '%\n%'")
    con = duckdb.connect()
    con.register("pages_in", usable.select("page_id", "url").toArrow())
    con.register("labels_in", labels.toArrow())
    con.execute("CREATE VIEW pages AS SELECT * FROM pages_in")
    con.execute("CREATE VIEW labels AS SELECT * FROM labels_in")
    got = urls.digest(usable, labels)
    want = con.execute(urls.ORACLE_SQL).fetchall()
    assert Counter(map(tuple, got.collect())) == Counter(want)
    assert urls.digest(pages.limit(0), labels).count() == 0
    bare = urls.digest(pages, labels.limit(0)).collect()
    assert len(bare) == pages.count() and {r.verdict for r in bare if r.rule is None} == {"allow"}


def test_a_rule_table(spark):
    pages = pages_of(spark, [(1, "http://a.b.c/x/y"), (2, "http://b.c/x"), (3, "http://z.c/")])
    rules = spark.createDataFrame([("block", "c", "/"), ("allow", "b.c", ""), ("block", "a.b.c", "/x/"), ("allow", "c", "/x/y")],
                                  "action string, host string, path string")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge(
        pages, spark.createDataFrame([], "page_id long, bad boolean"), rules).collect()}
    assert got == {1: ("a.b.c/x/", "block"), 2: ("b.c", "allow"), 3: ("c/", "block")}
