import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from critrank.llm import templates

from .conftest import prose


def brute(rows, min_docs=5, constant=0.6):
    def masked(line):
        return tuple("<*>" if re.search("[0-9]", w) else w for w in re.findall(r"[^\x20\x09-\x0D]+", line))

    leaf, seen = defaultdict(set), set()
    for _, t in rows:
        for line in (t or "").split("\n"):
            if m := masked(line):
                leaf[len(m), m[:2]].add(t)
                seen.add((m, t))
    support = Counter()
    seen = {(m, t) for m, t in seen if len(leaf[len(m), m[:2]]) >= min_docs}
    for m, _ in seen:
        for at, w in enumerate(m):
            support[len(m), m[:2], at, w] += w != "<*>"
    of, docs = {}, defaultdict(set)
    for m, t in seen:
        steady = [support[len(m), m[:2], at, w] >= min_docs for at, w in enumerate(m)]
        if sum(steady) >= max(1, constant * sum(w != "<*>" for w in m)):
            of[m] = tuple(w if s else "<*>" for w, s in zip(m, steady))
            docs[of[m]].add(t)
    out = Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = [bool(m := masked(x)) and len(docs[of.get(m)]) >= min_docs for x in lines]
        kept = "\n".join(x for x, g in zip(lines, gone) if not g)
        out[i, len(lines) if t else 0, sum(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


@pytest.fixture(scope="module")
def logs(spark):
    rows = []
    for k in range(40):
        lines = [prose(k, 12).replace("\n", " "), f"User u{k} logged in at 10:0{k % 10}", f"Licensed to {k} under CC"]
        if k % 3 == 0:
            lines.append(f"This page was last changed by {prose(k, 1)} on the server")
        if k < 4:
            lines.append("four documents have this line")
        if k % 8 == 0:
            lines += ["", "   ", "\t", "User  u7\tlogged in   at noon9"]
        rows.append((k, "\n".join(lines)))
    rows += [(100 + k, "copies of one text count once\nsecond line") for k in range(9)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


def test_templates(logs, odd, small, rows_of):
    for df in (logs, odd, small):
        assert Counter(map(tuple, templates.digest(df).collect())) == brute(rows_of(df))


def test_variable_words_are_generalised(logs):
    out = {r.doc_id: r for r in templates.drop_templates(logs).collect()}
    assert "logged in" not in out[3].kept_text and "last changed" not in out[3].kept_text
    assert "four documents" in out[3].kept_text and out[105].n_dropped == 0


def test_short_lines_with_variable_fields(spark):
    """One fixed word is enough where digits vary; words that vary without digits still need most of a line."""
    fields = "Page {0} of 40|Chapter {0}|Error 4{0}|{0}: {0}|a{0}|Status {1} {2} at {0}"
    rows = [(k, fields.format(k, prose(k, 1), prose(k + 99, 1)).replace("|", "\n") + f"\nword{prose(k, 4)}") for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, templates.digest(df).collect())) == brute(rows)
    for r in templates.drop_templates(df).collect():
        assert not re.search("Page|Chapter|Error", r.kept_text) and f"{r.doc_id}: {r.doc_id}" in r.kept_text


def test_clashing_helper_columns(odd, rows_of):
    clash = odd.selectExpr("doc_id", "text", "1 as _drops", "'x' as _lines", "2 as _text_hash", "3 as _id", "4 as _hash", "5 as own_0")
    out = templates.drop_templates(clash)
    assert out.columns == [*clash.columns, "kept_text", "n_lines", "n_dropped"]
    assert {tuple(r)[2:8] for r in out.collect()} == {(1, "x", 2, 3, 4, 5)}
    assert Counter((r.doc_id, r.n_lines, r.n_dropped) for r in out.collect()) == Counter(k[:3] for k in brute(rows_of(odd)).elements())


def test_columns_and_empty_table(odd, none):
    out = templates.drop_templates(odd)
    assert out.columns == [*odd.columns, "kept_text", "n_lines", "n_dropped"] and out.count() == odd.count()
    assert templates.digest(none).collect() == []


def test_main_path_has_no_python(logs):
    assert not re.search("Python|Pandas|Arrow", templates.digest(logs)._jdf.queryExecution().toString())


def test_sql_agrees(logs, rows_of):
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows_of(logs))
    got = con.execute(f"select doc_id, n_lines, n_dropped, kept_sha256 from ({templates.ORACLE_SQL})").fetchall()
    assert Counter(got) == Counter(map(tuple, templates.digest(logs).collect()))
