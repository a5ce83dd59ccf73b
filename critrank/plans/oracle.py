"""DuckDB SQL oracles for ``plans.registry`` (same keys, same column names).

Each oracle is written independently in SQL over the raw tables; the only
shared inputs are the catalog's values (lexicons and weights), inlined as
literals (their tokens are made here).  Sums that must follow template or query order use
``list_reduce(list(x ORDER BY k), +)``, a left fold like a sequential loop.
"""

from __future__ import annotations

import re

from critrank.catalog import Catalog, probe_catalog

CAT = probe_catalog()
K = 100


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def dbl(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def _values(rows: list[tuple], cols: str) -> str:
    body = ", ".join("(" + ", ".join(lit(v) if isinstance(v, str) else
                                     (dbl(v) if isinstance(v, float) else str(v)) for v in r) + ")"
                     for r in rows)
    return f"(VALUES {body}) AS t({cols})"


def contains_count(text: str, terms) -> str:
    terms = list(terms)
    if not terms:
        return "0"
    return "(" + " + ".join(f"CAST(contains({text}, {lit(t)}) AS INTEGER)" for t in terms) + ")"


STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
TOKENS = ("list_filter(string_split_regex(regexp_replace(lower({x}), '[^a-z0-9 ]', ' ', 'g'), ' +'), "
          "lambda w: w <> '')")


def strip(x: str) -> str:
    return STRIP.format(x=x)


def tokens(x: str) -> str:
    return TOKENS.format(x=x)


class Oracle:
    def __init__(self, catalog: Catalog = CAT):
        self.c = catalog

    # ------------------------------------------------------------------ tables
    def dims(self) -> str:
        rows = []
        for i, d in enumerate(self.c.dimensions):
            we, wb, ws = self.c.fusion_weights(d.name)
            q = self.c.pair_query(d.name)
            wc = self.c.blend_weight(d.name)
            rows.append((i, d.name, float(we), float(wb), float(ws), 1 if q is not None else 0,
                         float(wc), float(1.0 - wc), self.c.label(d.name) or "",
                         0 if d.name in self.c.unweighted else 1,
                         float(self.c.confidence_weight(d.name)),
                         float(1.0 - self.c.confidence_weight(d.name))))
        return ("dims AS (SELECT * FROM " + _values(
            rows, "ordinal, dim, we, wb, ws, paired, wc, wc1, label, weighted, wconf, wconf1") + ")")

    def cands(self) -> str:
        return """cands AS (
  SELECT d.doc_id, d.text, d.source AS title,
         CAST(floor(d.n_chars / 100) AS DOUBLE) / 10.0 AS years,
         [d.source] AS employers,
         coalesce(l.quality = 1, false) AS open_to_work,
         CASE WHEN l.doc_id IS NULL THEN CAST(-1.0 AS DOUBLE)
              ELSE CAST(l.quality AS DOUBLE) * CAST(0.5 AS DOUBLE)
                   + CAST(1 - l.toxic AS DOUBLE) * CAST(0.25 AS DOUBLE) END AS response_rate
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

    def tok(self) -> str:
        return f"""tok AS (SELECT doc_id, {tokens('text')} AS tokens FROM documents)"""

    def bm25_stats(self) -> str:
        # one scan, no list for each document: (document, word) pairs, then counts
        return """pairs AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents),
terms AS (SELECT w AS term, count(*) AS df FROM pairs GROUP BY w),
stats AS (SELECT count(*) AS n, avg(len(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS avgdl FROM documents),
idf_all AS (SELECT term, df, ln(CAST(n AS DOUBLE) - df + 0.5) - ln(CAST(df AS DOUBLE) + 0.5) AS idf_raw
            FROM terms, stats),
mean_idf AS (SELECT avg(idf_raw) AS m FROM idf_all),
idf AS (SELECT term, df, idf_raw, CASE WHEN idf_raw < 0 THEN CAST(0.25 AS DOUBLE) * m ELSE idf_raw END AS idf
        FROM idf_all, mean_idf)"""

    def bm25_query(self) -> str:
        rows = [(d.name, i, t) for d in self.c.dimensions if d.name in self.c.bm25_dims
                for i, t in enumerate(words(" ".join(d.anchors)))]
        return "q AS (SELECT * FROM " + _values(rows, "dim, pos, term") + ")"

    def bm25_raw(self) -> str:
        return f"""{self.tok()},
{self.bm25_stats()},
{self.bm25_query()},
qx AS (SELECT q.dim, q.pos, q.term, coalesce(i.idf, 0.0) AS idf FROM q LEFT JOIN idf i ON i.term = q.term),
bm25_raw AS (
  SELECT t.doc_id, qx.dim,
         list_reduce(list(qx.idf * ((tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * dl / s.avgdl))) ORDER BY qx.pos),
                     lambda a, b: a + b) AS score
  FROM (SELECT doc_id, tokens, CAST(len(tokens) AS DOUBLE) AS dl FROM tok) t
  CROSS JOIN qx CROSS JOIN stats s
  CROSS JOIN LATERAL (SELECT CAST(len(list_filter(t.tokens, lambda w: w = qx.term)) AS DOUBLE) AS tf)
  GROUP BY t.doc_id, qx.dim),
bm25_norm AS (
  SELECT b.doc_id, b.dim, CASE WHEN m.mx > 0 THEN b.score / m.mx ELSE b.score END AS score
  FROM bm25_raw b JOIN (SELECT dim, max(score) AS mx FROM bm25_raw GROUP BY dim) m ON b.dim = m.dim)"""

    def rules(self) -> str:
        """rule scores per (doc_id, dim) from ``cands``."""
        parts = []
        excl = ", ".join(lit(e.lower()) for e in self.c.excluded_employers)
        for r in self.c.rules:
            expr = "CAST(0.0 AS DOUBLE)"
            if r.senior_bonus:
                expr = (f"({expr} + CASE WHEN years >= {dbl(self.c.senior_years)} "
                        f"THEN {dbl(r.senior_bonus)} ELSE CAST(0.0 AS DOUBLE) END)")
            if r.terms and r.per_hit:
                expr = f"({expr} + CAST({contains_count('lower(text)', r.terms)} AS DOUBLE) * {dbl(r.per_hit)})"
            if r.none_of_bonus:
                none_of = (f"NOT list_bool_or(list_transform(employers, lambda e: lower(e) IN ({excl})))"
                           if excl else "true")
                expr = (f"({expr} + CASE WHEN coalesce({none_of}, true) "
                        f"THEN {dbl(r.none_of_bonus)} ELSE CAST(0.0 AS DOUBLE) END)")
            parts.append(f"SELECT doc_id, {lit(r.dim)} AS dim, least({expr}, {dbl(r.cap)}) AS score FROM cands")
        return "rules AS (" + " UNION ALL ".join(parts) + ")"

    def pair(self) -> str:
        parts = []
        for d in self.c.dimensions:
            q = self.c.pair_query(d.name)
            if q is None:
                continue
            qt = sorted(set(words(q)))
            arr = "[" + ", ".join(lit(t) for t in qt) + "]"
            parts.append(f"SELECT doc_id, {lit(d.name)} AS dim, "
                         f"CAST(len(list_filter({arr}, lambda w: list_contains(tokens, w))) AS DOUBLE)"
                         f" / {dbl(float(len(qt)))} AS score FROM tok")
        return "pair AS (" + " UNION ALL ".join(parts) + ")"

    def emb(self) -> str:
        n = len(self.c.dimensions)
        return f"""dimvec AS (SELECT label AS ordinal, CAST(arg_min(embedding, vec_id) AS DOUBLE[]) AS vec
           FROM embeddings WHERE label < {n} GROUP BY label),
docvec AS (SELECT vec_id AS doc_id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings),
emb AS (
  SELECT d.doc_id, dm.dim,
         coalesce(list_reduce(list_transform(range(len(v.vec)), lambda i: v.vec[i + 1] * dv.vec[i + 1]),
                              lambda a, b: a + b), 0.0) AS score
  FROM documents d CROSS JOIN dims dm
  LEFT JOIN docvec v ON v.doc_id = d.doc_id
  LEFT JOIN dimvec dv ON dv.ordinal = dm.ordinal)"""

    def sources(self) -> str:
        """per (doc_id, dim): e, b, s and fused, over all docs x dims."""
        return f"""{self.dims()},
{self.cands()},
{self.bm25_raw()},
{self.rules()},
{self.pair()},
{self.emb()},
src AS (
  SELECT d.doc_id, dm.ordinal, dm.dim, dm.we, dm.wb, dm.ws, dm.paired, dm.wc, dm.wc1, dm.label,
         dm.wconf, dm.wconf1,
         coalesce(e.score, 0.0) AS e, coalesce(b.score, 0.0) AS b, coalesce(r.score, 0.0) AS s,
         p.score AS pair_raw
  FROM documents d CROSS JOIN dims dm
  LEFT JOIN emb e ON e.doc_id = d.doc_id AND e.dim = dm.dim
  LEFT JOIN bm25_norm b ON b.doc_id = d.doc_id AND b.dim = dm.dim
  LEFT JOIN rules r ON r.doc_id = d.doc_id AND r.dim = dm.dim
  LEFT JOIN pair p ON p.doc_id = d.doc_id AND p.dim = dm.dim),
fused AS (SELECT *, we * e + wb * b + ws * s AS f FROM src)"""

    def paragraphs(self) -> str:
        return f"""lines AS (
  SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS pos
  FROM conversations),
paras AS (SELECT conv_id AS jd_id, turn::BIGINT * 2147483648 + pos AS para_no, {strip('line')} AS text
          FROM lines WHERE {strip('line')} <> '')"""

    def weights(self) -> str:
        hits = []
        for i, d in enumerate(self.c.dimensions):
            anchors = [a.lower() for a in d.anchors]
            hits.append(f"SELECT p.jd_id, p.para_no, {i} AS ordinal, {lit(d.name)} AS dim, "
                        f"{contains_count('p.norm', anchors)} AS hits, p.emph FROM pn p")
        pts = self.c.emphasis_points
        return f"""{self.paragraphs()},
pn AS (SELECT jd_id, para_no, text, regexp_replace(lower(text), '\\s+', ' ', 'g') AS norm,
              {contains_count('lower(text)', self.c.emphasis)} AS emph FROM paras),
hits AS ({' UNION ALL '.join(hits)}),
jd_dim AS (
  SELECT h.jd_id, h.ordinal, h.dim,
         CAST(sum(CASE WHEN hits > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_paragraphs,
         CAST(sum(hits) AS BIGINT) AS anchor_hits,
         CAST(sum(CASE WHEN hits > 0 THEN emph ELSE 0 END) * {pts} AS BIGINT) AS emphasis
  FROM hits h GROUP BY h.jd_id, h.ordinal, h.dim),
jd_score AS (
  SELECT j.*, CASE WHEN dm.weighted = 1 THEN n_paragraphs + anchor_hits + emphasis ELSE 0 END AS score
  FROM jd_dim j JOIN dims dm ON dm.ordinal = j.ordinal),
jd_w AS (
  SELECT *, CASE WHEN sum(score) OVER (PARTITION BY jd_id) = 0 THEN 0.0
                 ELSE CAST(score AS DOUBLE) / CAST(sum(score) OVER (PARTITION BY jd_id) AS DOUBLE) END AS weight
  FROM jd_score)"""

    def ranking(self) -> str:
        n = len(self.c.dimensions)
        return f"""{self.sources()},
{self.weights()},
s1 AS (
  SELECT w.jd_id, f.doc_id,
         list_reduce(list(w.weight * f.f ORDER BY f.ordinal), lambda a, b: a + b) AS stage1
  FROM jd_w w JOIN fused f ON f.ordinal = w.ordinal
  GROUP BY w.jd_id, f.doc_id),
surv AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY jd_id ORDER BY stage1 DESC, doc_id) AS stage1_rank
                 FROM s1) WHERE stage1_rank <= {K}),
sd AS (
  SELECT s.jd_id, s.doc_id, s.stage1, s.stage1_rank, f.ordinal, f.dim, f.e, f.b, f.s, f.f, f.pair_raw,
         f.paired, f.wc, f.wc1, f.label, f.wconf, f.wconf1, w.weight
  FROM surv s JOIN fused f ON f.doc_id = s.doc_id
  JOIN jd_w w ON w.jd_id = s.jd_id AND w.ordinal = f.ordinal),
mm AS (
  SELECT *, min(pair_raw) OVER (PARTITION BY jd_id, ordinal) AS mn,
            max(pair_raw) OVER (PARTITION BY jd_id, ordinal) AS mx FROM sd),
bl AS (
  SELECT *, CASE WHEN pair_raw IS NULL THEN NULL WHEN mx > mn THEN (pair_raw - mn) / (mx - mn) ELSE 0.0 END AS ce
  FROM mm),
bl2 AS (SELECT *, CASE WHEN paired = 1 THEN wc * coalesce(ce, 0.0) + wc1 * f ELSE f END AS blended FROM bl),
fin AS (
  SELECT jd_id, doc_id, list_reduce(list(weight * blended ORDER BY ordinal), lambda a, b: a + b) AS score
  FROM bl2 GROUP BY jd_id, doc_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY jd_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM fin),
tops AS (
  SELECT jd_id, doc_id,
         max(CASE WHEN rn = 1 THEN label END) AS top1, max(CASE WHEN rn = 2 THEN label END) AS top2
  FROM (SELECT jd_id, doc_id, label,
               row_number() OVER (PARTITION BY jd_id, doc_id ORDER BY blended DESC, ordinal) AS rn
        FROM bl2 WHERE label <> '') GROUP BY jd_id, doc_id),
reasons AS (
  SELECT r.jd_id, r.doc_id, r.rank, r.score,
         {strip("c.title || ' with ' || printf('%.1f', c.years) || ' years experience. ' || "
                "CASE WHEN t.top1 IS NULL THEN '' WHEN t.top2 IS NULL THEN 'Strong ' || t.top1 || '. ' "
                "ELSE 'Strong ' || t.top1 || ' and ' || t.top2 || '. ' END || "
                "CASE WHEN c.open_to_work THEN 'Open to work. ' ELSE '' END || "
                "CASE WHEN c.response_rate >= 0 THEN 'Recruiter response rate ' || "
                "printf('%.2f', c.response_rate) || '.' ELSE '' END")} AS reasoning,
         t.top1, t.top2
  FROM ranked r JOIN cands c ON c.doc_id = r.doc_id JOIN tops t ON t.jd_id = r.jd_id AND t.doc_id = r.doc_id)"""
        del n


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes)


def build() -> dict[str, str]:
    o = Oracle()
    n = len(o.c.dimensions)
    q: dict[str, str] = {}
    rk = o.ranking()
    q["rank"] = _with(rk) + "\nSELECT jd_id, doc_id, rank, round(score, 6) AS score, reasoning FROM reasons"
    q["submission"] = _with(rk) + ("\nSELECT jd_id, doc_id AS candidate_id, rank, "
                                   "printf('%.6f', round(score, 6)) AS score, reasoning FROM reasons")
    w = _with(o.dims(), o.weights())
    q["weights"] = w + ("\nSELECT jd_id, dim, n_paragraphs, anchor_hits, emphasis, CAST(score AS BIGINT) AS score, "
                        "round(weight, 6) AS weight FROM jd_w")
    q["anchor_map"] = w + "\nSELECT jd_id, para_no, dim, CAST(hits AS BIGINT) AS hits FROM hits WHERE hits > 0"
    q["emphasis"] = w + "\nSELECT jd_id, para_no, CAST(emph AS BIGINT) AS emphasis FROM pn"
    q["jd_paragraphs"] = _with(o.paragraphs()) + "\nSELECT jd_id, para_no, text FROM paras"
    anchors_text = {i: "\n".join(d.anchors) for i, d in enumerate(o.c.dimensions)}
    at_rows = [(i, d.name, anchors_text[i]) for i, d in enumerate(o.c.dimensions)]
    q["dimension_text"] = w + f""",
anc AS (SELECT * FROM {_values(at_rows, 'ordinal, dim, anchor_text')}),
mapped AS (SELECT h.jd_id, h.ordinal, string_agg(p.text, chr(10) ORDER BY h.para_no) AS ptext,
                  count(*) AS n_paragraphs
           FROM hits h JOIN paras p ON p.jd_id = h.jd_id AND p.para_no = h.para_no
           WHERE h.hits > 0 GROUP BY h.jd_id, h.ordinal)
SELECT j.jd_id, anc.dim, CAST(coalesce(m.n_paragraphs, 0) AS BIGINT) AS n_paragraphs,
       anc.anchor_text || chr(10) || coalesce(m.ptext, '') AS text
FROM (SELECT DISTINCT jd_id FROM paras) j CROSS JOIN anc
LEFT JOIN mapped m ON m.jd_id = j.jd_id AND m.ordinal = anc.ordinal"""
    q["jd_header"] = JD_HEADER
    q["tokenize"] = _with(o.tok()) + ("\nSELECT doc_id, CAST(len(tokens) AS BIGINT) AS n_tokens, "
                                      "md5(array_to_string(tokens, ' ')) AS tokens_md5 FROM tok")
    q["normalize_ws"] = ("SELECT doc_id, CAST(length(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS BIGINT) "
                         "AS n_chars, md5(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS norm_md5 FROM documents")
    st = _with(o.bm25_stats())
    q["term_stats"] = st + "\nSELECT term, df FROM terms"
    q["bm25_idf"] = st + "\nSELECT term, round(idf_raw, 6) AS idf_raw, round(idf, 6) AS idf FROM idf"
    b = _with(o.bm25_raw())
    q["bm25_scores"] = b + "\nSELECT doc_id, dim, round(score, 6) AS bm25 FROM bm25_raw"
    q["bm25_norm"] = b + "\nSELECT doc_id, dim, round(score, 6) AS bm25_norm FROM bm25_norm"
    rl = _with(o.cands(), o.rules())
    q["rule_scores"] = rl + "\nSELECT doc_id, dim, round(score, 6) AS score FROM rules"
    hit_parts = [f"SELECT doc_id, {lit(r.dim)} AS dim, CAST({contains_count('lower(text)', r.terms)} AS BIGINT) "
                 f"AS hits FROM cands" for r in o.c.rules if r.terms]
    q["rule_hits"] = _with(o.cands()) + "\n" + " UNION ALL ".join(hit_parts)
    q["rule_evidence"] = _with(o.cands()) + "\n" + " UNION ALL ".join(_evidence_parts(o.c))
    q["none_of_list"] = """SELECT c.c_custkey, NOT EXISTS (
  SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND lower(o.o_orderpriority) IN ('1-urgent', '2-high')
) AS none_of FROM customer c"""
    q["embedding_lookup"] = ("SELECT d.doc_id, e.vec_id IS NOT NULL AS has_embedding, "
                             "round(sqrt(list_reduce(list_transform(CAST(e.embedding AS DOUBLE[]), lambda x: x * x), "
                             "lambda a, b: a + b)), 6) AS norm FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id")
    q["embedding_scores"] = _with(o.dims(), o.emb()) + "\nSELECT doc_id, dim, round(score, 6) AS score FROM emb"
    q["hash_encode"] = q["dimension_text"].replace("\nSELECT j.jd_id, anc.dim", ",\ndt AS (SELECT j.jd_id, anc.dim", 1) \
        + HASH_TAIL
    q["pair_overlap"] = _with(o.tok(), o.pair()) + "\nSELECT doc_id, dim, round(score, 6) AS score FROM pair"
    src = _with(o.sources())
    q["source_fusion"] = src + ("\nSELECT doc_id, dim, round(e, 6) AS embedding, round(b, 6) AS bm25, "
                                "round(s, 6) AS structured, round(f, 6) AS fused FROM fused")
    q["features_bucketed"] = q["source_fusion"]
    q["confidence"] = src + CONFIDENCE_TAIL
    q["source_outer"] = src + """
SELECT doc_id, dim, round(CASE WHEN e > 0 THEN e ELSE 0.0 END, 6) AS embedding,
       round(CASE WHEN b > 0 THEN b ELSE 0.0 END, 6) AS bm25,
       round(CASE WHEN s > 0 THEN s ELSE 0.0 END, 6) AS structured
FROM src WHERE e > 0 OR b > 0 OR s > 0"""
    q["stage1"] = _with(rk) + "\nSELECT jd_id, doc_id, round(stage1, 6) AS stage1 FROM surv"
    q["topk_per_group"] = _with(rk) + "\nSELECT jd_id, doc_id, stage1_rank, round(stage1, 6) AS stage1 FROM surv"
    pq = [(d.name, o.c.pair_query(d.name)) for d in o.c.dimensions if o.c.pair_query(d.name) is not None]
    q["pair_generate"] = _with(rk) + (
        "\nSELECT s.jd_id, s.doc_id, t.dim, t.query, length(d.text) AS n_chars FROM surv s "
        f"JOIN documents d ON d.doc_id = s.doc_id CROSS JOIN {_values(pq, 'dim, query')}")
    vec = """{name}_tk AS (SELECT {keys}, unnest(tokens) AS t FROM {src}),
{name}_hb AS (SELECT {keys}, CAST(CAST(('0x' || substr(md5(t), 1, 8)) AS UBIGINT) % 64 AS BIGINT) AS i,
  sum(CASE WHEN CAST(('0x' || substr(md5(t), 9, 1)) AS INTEGER) < 8 THEN 1.0 ELSE -1.0 END) AS x
  FROM {name}_tk GROUP BY ALL),
{name}_raw AS (SELECT {keys}, r.i, CAST(coalesce(h.x, 0.0) AS DOUBLE) AS x FROM (SELECT DISTINCT {keys} FROM {src})
  CROSS JOIN range(64) r(i) LEFT JOIN {name}_hb h USING ({keys}, i)),
{name} AS (SELECT {keys}, list(CASE WHEN n > 0 THEN x / n ELSE x END ORDER BY i) AS vec
  FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY {keys})) AS n FROM {name}_raw) GROUP BY {keys})"""
    texts = q["dimension_text"]
    texts = texts[texts.index("anc AS ("):].replace("\nSELECT j.jd_id, anc.dim", ",\njd_text AS (SELECT j.jd_id, anc.ordinal", 1)
    own = texts + "),\njd_tok AS (SELECT jd_id, ordinal, " + tokens("text") + " AS tokens FROM jd_text),\n" \
        + vec.format(name="jdvec", keys="jd_id, ordinal", src="jd_tok") + ",\n" \
        + vec.format(name="cvec", keys="doc_id", src="tok") + """,
fused2 AS (
  SELECT v.jd_id, s.*, s.we * list_reduce(list_transform(range(64), lambda i: c.vec[i + 1] * v.vec[i + 1]),
    lambda a, b: a + b) + s.wb * s.b + s.ws * s.s AS f
  FROM src s JOIN cvec c ON c.doc_id = s.doc_id JOIN jdvec v ON v.ordinal = s.ordinal),
s1 AS ("""
    per_jd = rk.replace("s1 AS (", own, 1).replace(
        "JOIN fused f ON f.ordinal = w.ordinal", "JOIN fused2 f ON f.ordinal = w.ordinal AND f.jd_id = w.jd_id").replace(
        "JOIN fused f ON f.doc_id = s.doc_id", "JOIN fused2 f ON f.doc_id = s.doc_id AND f.jd_id = s.jd_id")
    q["rank_jd_vectors"] = _with(per_jd) + "\nSELECT jd_id, doc_id, rank, round(score, 6) AS score FROM ranked"
    q["topk"] = b + f"""
SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, round(score, 6) AS score
FROM bm25_raw WHERE dim = 'TECHNICAL_SKILLS' ORDER BY score DESC, doc_id LIMIT {K}"""
    q["limit_by_id"] = f"SELECT doc_id, lang, n_chars FROM documents ORDER BY doc_id LIMIT {K}"
    q["topk_lookup"] = _with(rk) + "\nSELECT s.jd_id, s.doc_id, c.title, c.years FROM surv s LEFT JOIN cands c ON c.doc_id = s.doc_id"
    q["minmax"] = _with(rk) + "\nSELECT jd_id, doc_id, dim, round(ce, 6) AS ce FROM bl WHERE ce IS NOT NULL"
    q["blend"] = _with(rk) + "\nSELECT jd_id, doc_id, dim, round(blended, 6) AS blended FROM bl2"
    q["confidence_blend"] = _with(rk) + CONF_BLEND_TAIL
    q["top_dims"] = _with(rk) + "\nSELECT jd_id, doc_id, top1, top2 FROM tops"
    q["result_json"] = _with(rk) + """
SELECT jd_id, doc_id, dim, round(f, 6) AS source_score, round(e, 6) AS embedding_score,
       round(b, 6) AS bm25_score, round(s, 6) AS structured_score,
       round(coalesce(ce, 0.0), 6) AS cross_encoder_score, round(blended, 6) AS final_score FROM bl2"""
    q["result_nested"] = _with(rk) + RESULT_NESTED_TAIL
    q["topk_threshold"] = q["topk_per_group"]
    q["anchor_map_lexicon"] = q["anchor_map"]
    q["bm25_refresh"] = st + "\nSELECT term, df, round(idf_raw, 6) AS idf_raw, round(idf, 6) AS idf FROM idf"
    q["features_refresh"] = q["bm25_norm"]
    q["bm25_index_topk"] = b + f"""
SELECT dim, doc_id, rank, round(score, 6) AS score FROM (
  SELECT b.*, row_number() OVER (PARTITION BY b.dim ORDER BY b.score DESC, b.doc_id) AS rank FROM bm25_raw b
  WHERE EXISTS (SELECT 1 FROM pairs p JOIN q ON q.term = p.w WHERE p.doc_id = b.doc_id AND q.dim = b.dim))
WHERE rank <= {K}"""
    q["lexicon_hits"] = """WITH lex AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term
  FROM benchmark),
terms AS (SELECT DISTINCT term FROM lex),
held AS (SELECT d.doc_id, t.term FROM documents d, terms t WHERE contains(lower(d.text), t.term))
SELECT h.doc_id, l.item_id, count(*) AS hits, md5(string_agg(h.term, ' ' ORDER BY h.term)) AS terms_md5
FROM held h JOIN lex l ON l.term = h.term GROUP BY h.doc_id, l.item_id"""
    q["project_defaults"] = PROJECT_DEFAULTS
    q["raw_text"] = RAW_TEXT
    del n
    return q


def _evidence_parts(c: Catalog) -> list[str]:
    out = []
    excl = ", ".join(lit(e.lower()) for e in c.excluded_employers)
    for r in c.rules:
        items = [f"CASE WHEN contains(lower(text), {lit(t)}) THEN {lit(t)} END" for t in r.terms]
        if r.senior_bonus and r.senior_label:
            items.append(f"CASE WHEN years >= {dbl(c.senior_years)} THEN {lit(r.senior_label)} END")
        if r.none_of_bonus and r.none_of_label:
            items.append(f"CASE WHEN coalesce(NOT list_bool_or(list_transform(employers, lambda e: lower(e) IN ({excl}))), true) "
                         f"THEN {lit(r.none_of_label)} END")
        arr = "list_filter([" + ", ".join(items) + "], lambda x: x IS NOT NULL)" if items else "[]"
        out.append(f"SELECT doc_id, {lit(r.dim)} AS dim, array_to_string(list_sort({arr}), '|') AS evidence "
                   f"FROM cands")
    return out


CONFIDENCE_TAIL = """,
pos AS (SELECT doc_id, dim, list_filter([e, b, s], lambda x: x > 0) AS p FROM src),
st AS (SELECT doc_id, dim, p, CAST(len(p) AS DOUBLE) AS n,
              list_reduce(list_prepend(0.0, p), lambda a, c: a + c) / len(p) AS mean FROM pos),
cf AS (SELECT doc_id, dim, n,
              exp(-2.0 * sqrt(list_reduce(list_prepend(0.0, list_transform(p, lambda x: (x - mean) * (x - mean))),
                                          lambda a, c: a + c) / n)) AS agreement
       FROM st)
SELECT doc_id, dim,
       round(CASE WHEN n = 0 THEN 0.0 ELSE agreement END, 6) AS agreement,
       round(CASE WHEN n = 0 THEN 0.0 ELSE n / 3.0 END, 6) AS coverage,
       round(CASE WHEN n = 0 THEN 0.0 ELSE agreement * sqrt(n / 3.0) END, 6) AS value
FROM cf"""

CONF_BLEND_TAIL = """,
pos AS (SELECT *, list_filter([e, b, s], lambda x: x > 0) AS p FROM bl2),
st AS (SELECT *, CAST(len(p) AS DOUBLE) AS n,
              list_reduce(list_prepend(0.0, p), lambda a, c: a + c) / len(p) AS mean FROM pos),
cf AS (SELECT *, CASE WHEN n = 0 THEN 0.0 ELSE
           exp(-2.0 * sqrt(list_reduce(list_prepend(0.0, list_transform(p, lambda x: (x - mean) * (x - mean))), lambda a, c: a + c) / n))
           * sqrt(n / 3.0) END AS conf FROM st)
SELECT jd_id, doc_id, dim, round(wconf1 * (f * conf) + wconf * coalesce(ce, 0.0), 6) AS value FROM cf"""

RESULT_NESTED_TAIL = CONF_BLEND_TAIL[:CONF_BLEND_TAIL.index("\nSELECT")] + """
SELECT jd_id, doc_id, '{' || string_agg('"' || dim || '":{"source_score":"' || printf('%.6f', round(f, 6) + 0.0)
    || '","embedding_score":"' || printf('%.6f', round(e, 6) + 0.0) || '","bm25_score":"' || printf('%.6f', round(b, 6) + 0.0)
    || '","structured_score":"' || printf('%.6f', round(s, 6) + 0.0)
    || '","cross_encoder_score":"' || printf('%.6f', round(coalesce(ce, 0.0), 6) + 0.0)
    || '","confidence_score":"' || printf('%.6f', round(conf, 6) + 0.0)
    || '","final_score":"' || printf('%.6f', round(blended, 6) + 0.0) || '"}', ',' ORDER BY ordinal) || '}' AS dimension_scores
FROM cf GROUP BY jd_id, doc_id"""

HASH_TAIL = """),
tk AS (SELECT jd_id, dim, unnest(""" + tokens("text") + """) AS t FROM dt),
hb AS (SELECT jd_id, dim, CAST(CAST(('0x' || substr(md5(t), 1, 8)) AS UBIGINT) % 64 AS BIGINT) AS i,
              CASE WHEN CAST(('0x' || substr(md5(t), 9, 1)) AS INTEGER) < 8 THEN 1.0 ELSE -1.0 END AS s FROM tk),
grid AS (SELECT dt.jd_id, dt.dim, r.i FROM dt CROSS JOIN range(64) r(i)),
raw AS (SELECT g.jd_id, g.dim, g.i, coalesce(sum(hb.s), 0.0) AS x
        FROM grid g LEFT JOIN hb ON hb.jd_id = g.jd_id AND hb.dim = g.dim AND hb.i = g.i
        GROUP BY g.jd_id, g.dim, g.i),
nv AS (SELECT jd_id, dim, sqrt(sum(x * x)) AS nrm FROM raw GROUP BY jd_id, dim)
SELECT raw.jd_id, raw.dim, raw.i, round(CASE WHEN nrm > 0 THEN x / nrm ELSE x END, 6) AS v
FROM raw JOIN nv ON nv.jd_id = raw.jd_id AND nv.dim = raw.dim"""

JD_HEADER = """WITH j AS (
  SELECT c.c_custkey AS jd_id, c.c_name, n.n_name, r.r_name, c.c_mktsegment, c.c_custkey AS k
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey),
raw AS (
  SELECT jd_id,
    CASE WHEN k % 4 = 0 THEN c_name ELSE 'Job Description: ' || c_name END AS p0,
    CASE WHEN k % 5 = 0 THEN 'Company:' ELSE 'company: ' || n_name END AS p1,
    CASE WHEN k % 5 = 0 THEN n_name ELSE 'About the role' END AS p2,
    'Location:  ' || r_name || ' ' AS p3,
    'Employment Type: ' || c_mktsegment AS p4,
    CASE WHEN k % 7 = 0 THEN 'Experience Required: several years'
         ELSE 'Experience Required: ' || CAST(k % 6 AS VARCHAR) || CASE WHEN k % 3 = 0 THEN '-' ELSE '–' END
              || CAST(k % 6 + 4 AS VARCHAR) || ' years' END AS p5
  FROM j),
t AS (SELECT jd_id, p0, p0 || chr(10) || p1 || chr(10) || p2 || chr(10) || p3 || chr(10) || p4 || chr(10) || p5 AS txt FROM raw)
SELECT jd_id,
  CASE WHEN regexp_extract(p0, '(?i)Job Description:\\s*([^\\n]+)', 1) <> ''
       THEN regexp_replace(regexp_extract(p0, '(?i)Job Description:\\s*([^\\n]+)', 1), '^\\s+|\\s+$', '', 'g')
       ELSE p0 END AS title,
  regexp_replace(regexp_extract(txt, '(?i)Company:\\s*([^\\n]+)', 1), '^\\s+|\\s+$', '', 'g') AS company,
  regexp_replace(regexp_extract(txt, '(?i)Location:\\s*([^\\n]+)', 1), '^\\s+|\\s+$', '', 'g') AS location,
  regexp_replace(regexp_extract(txt, '(?i)Employment Type:\\s*([^\\n]+)', 1), '^\\s+|\\s+$', '', 'g') AS employment_type,
  CASE WHEN regexp_extract(txt, '(?i)Experience Required:\\s*(\\d+)\\s*[–-]\\s*(\\d+)', 1) <> ''
       THEN CAST(regexp_extract(txt, '(?i)Experience Required:\\s*(\\d+)\\s*[–-]\\s*(\\d+)', 1) AS DOUBLE) END AS min_years,
  CASE WHEN regexp_extract(txt, '(?i)Experience Required:\\s*(\\d+)\\s*[–-]\\s*(\\d+)', 2) <> ''
       THEN CAST(regexp_extract(txt, '(?i)Experience Required:\\s*(\\d+)\\s*[–-]\\s*(\\d+)', 2) AS DOUBLE) END AS max_years
FROM t"""

PROJECT_DEFAULTS = """SELECT doc_id,
  CASE WHEN doc_id % 3 = 0 THEN 'tier_1' ELSE 'unknown' END AS tiers,
  CAST(coalesce((SELECT sum(CASE WHEN (i - 1) % 2 = 0 THEN (i - 1) * 6 ELSE 0 END)
        FROM range(1, len(list_filter(string_split(string_split(text, chr(10))[1], ' '), lambda w: w <> '')) + 1) r(i)), 0) AS BIGINT) AS skill_months,
  CAST(0 AS BIGINT) AS n_certs, CAST(0 AS BIGINT) AS n_langs
FROM documents"""

RAW_TEXT = """WITH p AS (
  SELECT doc_id, source, lang, string_split(text, chr(10)) AS lines FROM documents),
parts AS (
  SELECT doc_id,
    list_concat(
      [lines[1], coalesce(lines[2], ''), source],
      list_filter(string_split(lines[1], ' '), lambda w: w <> ''),
      flatten(list_transform(range(len(lines) - 1), lambda i: ['role ' || CAST(i AS VARCHAR), lines[i + 2]])),
      [lang, source]) AS parts
  FROM p)
SELECT doc_id, CAST(length(array_to_string(parts, chr(10))) AS BIGINT) AS n_chars,
       md5(array_to_string(parts, chr(10))) AS raw_md5, md5(lower(array_to_string(parts, chr(10)))) AS lower_md5
FROM parts"""


ORACLES = build()


RANKING_TABLE = """ok AS (
  SELECT o_orderkey,
         (o_orderkey // 197) * 2 + CASE WHEN o_orderkey % 197 >= 100 THEN 1 ELSE 0 END AS rid,
         CASE WHEN o_orderkey % 197 >= 100 THEN o_orderkey % 197 - 100 ELSE o_orderkey % 197 END AS pos
  FROM orders),
rt AS (
  SELECT rid AS ranking_id, pos + 2 AS row_num,
    CASE WHEN o_orderkey % 97 = 5 THEN 'CAND_' || CAST(o_orderkey AS VARCHAR)
         WHEN o_orderkey % 89 = 7 THEN ''
         WHEN o_orderkey % 83 = 3 THEN 'CAND_' || lpad(CAST(o_orderkey - 1 AS VARCHAR), greatest(7, length(CAST(o_orderkey - 1 AS VARCHAR)))::INTEGER, '0')
         WHEN o_orderkey % 41 = 12 THEN 'CAND_' || lpad(CAST(o_orderkey - 2 AS VARCHAR), greatest(7, length(CAST(o_orderkey - 2 AS VARCHAR)))::INTEGER, '0')
         ELSE 'CAND_' || lpad(CAST(o_orderkey AS VARCHAR), greatest(7, length(CAST(o_orderkey AS VARCHAR)))::INTEGER, '0') END AS cid,
    CASE WHEN o_orderkey % 101 = 4 THEN '0' || CAST(pos + 1 AS VARCHAR)
         WHEN o_orderkey % 103 = 9 THEN CAST(pos AS VARCHAR)
         WHEN o_orderkey % 107 = 2 THEN '101'
         ELSE CAST(pos + 1 AS VARCHAR) END AS rank_s,
    CASE WHEN o_orderkey % 127 = 6 THEN 'abc'
         ELSE printf('%.2f', CASE WHEN o_orderkey % 109 = 1 THEN 1000.0 - pos * 1.5 + 50.0
                                  WHEN o_orderkey % 113 = 0 OR o_orderkey % 41 = 12 THEN 1000.0 - pos * 1.5 + 1.5
                                  ELSE 1000.0 - pos * 1.5 END) END AS score_s,
    o_orderkey % 131 = 10 AS bad_cells
  FROM ok),
p AS (
  SELECT *, regexp_full_match(cid, '^CAND_[0-9]{7}$') AS id_ok,
         CASE WHEN regexp_full_match(rank_s, '^(0|-?[1-9][0-9]*)$') THEN TRY_CAST(rank_s AS BIGINT) END AS rank_i,
         CASE WHEN regexp_full_match(score_s, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$')
              THEN TRY_CAST(score_s AS DOUBLE) END AS score_d
  FROM rt),
g AS (
  SELECT *,
    CASE WHEN id_ok THEN row_number() OVER (PARTITION BY ranking_id, cid, id_ok ORDER BY row_num) END AS id_seq,
    CASE WHEN rank_i BETWEEN 1 AND 100 THEN row_number() OVER (PARTITION BY ranking_id, rank_i, rank_i BETWEEN 1 AND 100 ORDER BY row_num) END AS rank_seq
  FROM p WHERE NOT bad_cells),
adj AS (
  SELECT *, lag(score_d) OVER w AS prev_s, lag(cid) OVER w AS prev_c
  FROM g WHERE rank_i IS NOT NULL AND score_d IS NOT NULL AND cid <> ''
  WINDOW w AS (PARTITION BY ranking_id ORDER BY rank_i, row_num)),
seen AS (SELECT DISTINCT ranking_id, rank_i AS r FROM g WHERE rank_i BETWEEN 1 AND 100),
allr AS (SELECT ranking_id, unnest(range(1, 101)) AS r FROM (SELECT DISTINCT ranking_id FROM p)),
missing AS (SELECT a.ranking_id, a.r FROM allr a LEFT JOIN seen s ON s.ranking_id = a.ranking_id AND s.r = a.r
            WHERE s.r IS NULL),
viol AS (
  SELECT ranking_id, row_num, 'id_required' AS rule, '' AS detail FROM g WHERE cid = ''
  UNION ALL SELECT ranking_id, row_num, 'id_pattern', cid FROM g WHERE cid <> '' AND NOT id_ok
  UNION ALL SELECT ranking_id, row_num, 'id_duplicate', cid FROM g WHERE id_seq > 1
  UNION ALL SELECT ranking_id, row_num, 'rank_integer', rank_s FROM g WHERE rank_i IS NULL
  UNION ALL SELECT ranking_id, row_num, 'rank_range', rank_s FROM g WHERE rank_i IS NOT NULL AND NOT (rank_i BETWEEN 1 AND 100)
  UNION ALL SELECT ranking_id, row_num, 'rank_duplicate', rank_s FROM g WHERE rank_seq > 1
  UNION ALL SELECT ranking_id, row_num, 'score_float', score_s FROM g WHERE score_d IS NULL
  UNION ALL SELECT ranking_id, row_num, 'cells', '' FROM p WHERE bad_cells
  UNION ALL SELECT ranking_id, NULL, 'count', CAST(count(*) AS VARCHAR) FROM p GROUP BY ranking_id HAVING count(*) <> 100
  UNION ALL SELECT ranking_id, NULL, 'missing_ranks', array_to_string(list_sort(list(r)), ',') FROM missing GROUP BY ranking_id
  UNION ALL SELECT ranking_id, row_num, 'not_monotonic', '' FROM adj WHERE prev_s < score_d
  UNION ALL SELECT ranking_id, row_num, 'tie_order', prev_c || ' > ' || cid FROM adj WHERE prev_s = score_d AND prev_c > cid)"""


def _rules_sql(rules: list[str], detail: bool = True) -> str:
    inl = ", ".join(lit(r) for r in rules)
    cols = "ranking_id, CAST(row_num AS BIGINT) AS row_num, rule" + (", detail" if detail else "")
    return f"WITH {RANKING_TABLE}\nSELECT {cols} FROM viol WHERE rule IN ({inl})"


SCHEMA_VIOLATIONS = """WITH d AS (
  SELECT doc_id, n_chars, string_split(text, chr(10)) AS lines,
         CASE WHEN doc_id % 50 = 7 THEN 'CAND_' || CAST(doc_id AS VARCHAR)
              ELSE 'CAND_' || lpad(CAST(doc_id AS VARCHAR), greatest(7, length(CAST(doc_id AS VARCHAR)))::INTEGER, '0') END AS cid
  FROM documents),
w AS (SELECT doc_id, list_filter(string_split(lines[1], ' '), lambda x: x <> '') AS ws FROM d),
ci AS (SELECT doc_id, unnest(range(len(lines) - 1)) AS i FROM d),
si AS (SELECT doc_id, unnest(range(len(ws))) AS i FROM w)
SELECT doc_id AS record_key, 'candidate_id' AS path, 'pattern' AS rule FROM d
  WHERE NOT regexp_full_match(cid, '^CAND_[0-9]{7}$')
UNION ALL SELECT doc_id, 'redrob_signals', 'required' FROM d
UNION ALL SELECT doc_id, 'profile.years_of_experience', 'maximum' FROM d WHERE n_chars / 500.0 > 50
UNION ALL SELECT doc_id, 'career_history', 'minItems' FROM d WHERE len(lines) - 1 < 1
UNION ALL SELECT doc_id, 'career_history', 'maxItems' FROM d WHERE len(lines) - 1 > 10
UNION ALL SELECT doc_id, 'career_history[' || CAST(i AS VARCHAR) || '].company_size', 'enum' FROM ci WHERE i % 4 = 3
UNION ALL SELECT doc_id, 'education[0].start_year', 'minimum' FROM d WHERE 1965 + doc_id % 70 < 1970
UNION ALL SELECT doc_id, 'education[0].start_year', 'maximum' FROM d WHERE 1965 + doc_id % 70 > 2030
UNION ALL SELECT doc_id, 'education[0].end_year', 'maximum' FROM d WHERE 1970 + doc_id % 70 > 2035
UNION ALL SELECT doc_id, 'skills[' || CAST(i AS VARCHAR) || '].proficiency', 'enum' FROM si WHERE i % 5 = 4"""

ORACLES.update({
    "validate": f"WITH {RANKING_TABLE}\nSELECT ranking_id, CAST(row_num AS BIGINT) AS row_num, rule FROM viol",
    "validate_count": _rules_sql(["count"]),
    "validate_ids": _rules_sql(["id_required", "id_pattern"]),
    "validate_dups": _rules_sql(["id_duplicate", "rank_duplicate"]),
    "validate_ranks": _rules_sql(["rank_integer", "rank_range", "score_float", "cells"]),
    "validate_monotonic": _rules_sql(["not_monotonic"], detail=False),
    "validate_ties": _rules_sql(["tie_order"]),
    "missing_ranks": f"WITH {RANKING_TABLE}\nSELECT ranking_id, r AS rank FROM missing",
    "schema_violations": SCHEMA_VIOLATIONS,
})


#: The ranking table's SQL with all orders as one ranking of 20,000 rows.
WHOLE_TABLE = (RANKING_TABLE
               .replace("(o_orderkey // 197) * 2 + CASE WHEN o_orderkey % 197 >= 100 THEN 1 ELSE 0 END AS rid", "0 AS rid")
               .replace("CASE WHEN o_orderkey % 197 >= 100 THEN o_orderkey % 197 - 100 ELSE o_orderkey % 197 END AS pos",
                        "o_orderkey AS pos")
               .replace("BETWEEN 1 AND 100", "BETWEEN 1 AND 20000").replace("range(1, 101)", "range(1, 20001)")
               .replace("count(*) <> 100", "count(*) <> 20000"))

CONFORMANCE = """WITH d AS (
  SELECT doc_id AS k, n_chars, string_split(text, chr(10)) AS lines FROM documents),
ok AS (SELECT * FROM d WHERE k % 23 <> 6),
ci AS (SELECT k, unnest(range(len(lines) - 1)) AS i FROM ok),
si AS (SELECT k, unnest(range(len(list_filter(string_split(lines[1], ' '), lambda x: x <> '')))) AS i FROM ok)
SELECT k AS record_key, '' AS path, 'json' AS rule FROM d WHERE k % 23 = 6
UNION ALL SELECT k, 'candidate_id', 'pattern' FROM ok WHERE k % 50 = 7 AND length(CAST(k AS VARCHAR)) <> 7
UNION ALL SELECT k, 'profile.years_of_experience', 'maximum' FROM ok WHERE n_chars / 500.0 > 50
UNION ALL SELECT k, 'career_history', 'minItems' FROM ok WHERE len(lines) - 1 < 1
UNION ALL SELECT k, 'career_history', 'maxItems' FROM ok WHERE len(lines) - 1 > 10
UNION ALL SELECT k, 'career_history[' || CAST(i AS VARCHAR) || '].company_size', 'enum' FROM ci WHERE i % 4 = 3
UNION ALL SELECT k, 'education[0].start_year', 'minimum' FROM ok WHERE 1965 + k % 70 < 1970
UNION ALL SELECT k, 'education[0].start_year', 'maximum' FROM ok WHERE 1965 + k % 70 > 2030
UNION ALL SELECT k, 'education[0].end_year', 'maximum' FROM ok WHERE 1970 + k % 70 > 2035
UNION ALL SELECT k, 'education[0].tier', 'type' FROM ok WHERE k % 3 <> 0
UNION ALL SELECT k, 'education[0].tier', 'enum' FROM ok WHERE k % 3 <> 0
UNION ALL SELECT k, 'skills[' || CAST(i AS VARCHAR) || '].proficiency', 'enum' FROM si WHERE i % 5 = 4
UNION ALL SELECT k, 'skills[' || CAST(i AS VARCHAR) || '].duration_months', 'type' FROM si WHERE i % 2 = 1
UNION ALL SELECT k, 'redrob_signals.profile_completeness_score', 'maximum' FROM ok WHERE k % 105 > 100
UNION ALL SELECT k, 'redrob_signals.last_active_date', 'format' FROM ok WHERE k % 19 = 3
UNION ALL SELECT k, 'redrob_signals.profile_views_received_30d', 'minimum' FROM ok WHERE k % 29 = 5
UNION ALL SELECT k, 'redrob_signals.skill_assessment_scores.a', 'maximum' FROM ok WHERE n_chars % 130 > 100
UNION ALL SELECT k, 'redrob_signals.connection_count', 'type' FROM ok WHERE k % 31 = 4
UNION ALL SELECT k, 'redrob_signals.notice_period_days', 'maximum' FROM ok WHERE k % 200 > 180
UNION ALL SELECT k, 'redrob_signals.expected_salary_range_inr_lpa.min', 'minimum' FROM ok WHERE k % 7 = 0
UNION ALL SELECT k, 'redrob_signals.expected_salary_range_inr_lpa.max', 'required' FROM ok WHERE k % 5 = 2
UNION ALL SELECT k, 'redrob_signals.preferred_work_mode', 'enum' FROM ok WHERE k % 13 = 6
UNION ALL SELECT k, 'redrob_signals.verified_email', 'type' FROM ok WHERE k % 17 = 2
UNION ALL SELECT k, 'redrob_signals.verified_phone', 'type' FROM ok WHERE k % 37 = 1"""

ORACLES.update({
    "conformance": CONFORMANCE,
    "validate_whole": f"WITH {WHOLE_TABLE}\nSELECT CAST(ranking_id AS BIGINT) AS ranking_id, CAST(row_num AS BIGINT) AS "
                      "row_num, rule, CASE WHEN rule <> 'not_monotonic' THEN detail END AS detail FROM viol",
})
