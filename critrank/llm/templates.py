"""Line dedup by log templates: a fixed-depth tree, built with DataFrame operations.

A line's words with a digit are variable from the start.  Its place in the tree
is its number of words and its first two words.  Within a leaf, a word stays at
its position if ``min_docs`` documents agree on it there; the other positions
become wildcards.  Lines with the same result share a template, which recurs if
lines of ``min_docs`` different documents have it, at least one of its words is
fixed, and so are ``constant`` of the words without a digit: what the leaf generalised
must leave most of a line, what digits vary needn't ('Page 3 of 40' is a template).
All lines of recurring templates are dropped.

Documents with the same text count once, so that copies of a document alone
don't make its lines recur.  All counts pre-aggregate before they shuffle, and
no leaf is gathered in one place.

Defined results: a null text is empty and has no lines; blank lines stay; words
are ``[^\\x20\\x09-\\x0D]+``; repeated rows each get a result of their own; extra
columns make no difference; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bare, save, shielded

DEPTH = 2
MIN_DOCS = 5
CONSTANT = 0.6
WILD = "<*>"


def _lines(docs: DataFrame) -> DataFrame:
    """A row for each line with a word: place in the tree and masked line.

    Whole texts are masked, then cut into lines, so that each expression runs
    once; texts without odd blanks or digits skip the replacements.
    """
    even = F.when(F.col("text").rlike(r"[\x09\x0B-\x0D]|  "), F.regexp_replace("text", r"[\x20\x09\x0B-\x0D]+", " ")
                  ).otherwise(F.col("text"))
    masked = F.when(F.col("text").rlike("[0-9]"), F.regexp_replace(
        even, r"(?<![^ \n])[^ \n0-9]*+[0-9][^ \n]*+", WILD)).otherwise(even)
    words = F.split("masked", " ")
    return (docs.select("doc_id", F.xxhash64("text").alias("text_hash"),
                        F.posexplode(F.split(masked, "\n")).alias("pos", "piece"))
            .select("doc_id", "text_hash", "pos", F.trim("piece").alias("masked"))
            .where("masked <> ''")
            .withColumn("leaf", F.xxhash64(F.size(words), *[F.get(words, F.lit(k)) for k in range(DEPTH)]))
            .withColumn("line", F.xxhash64("masked")))


def recurring(docs: DataFrame, min_docs: int, constant: float) -> tuple[DataFrame, DataFrame]:
    """(all lines: doc_id, text_hash, pos, line), (lines of recurring templates: line, template)."""
    place = save(_lines(docs).select("doc_id", "text_hash", "pos", "leaf", "line"), "lines")
    leaves = save(place.select("leaf", "text_hash").distinct().groupBy("leaf").count()
                  .where(F.col("count") >= min_docs).select("leaf"), "leaves")
    seen = save(place.join(leaves, "leaf", "left_semi").select("leaf", "line", "text_hash").distinct(), "seen")
    texts = _lines(docs).join(leaves, "leaf", "left_semi").select("leaf", "line", "masked").distinct()
    masks = save(texts.join(seen.groupBy("leaf", "line").agg(F.count(F.lit(1)).alias("docs")), ["leaf", "line"]),
                 "masks")
    words = masks.select("leaf", "line", "docs", F.posexplode(F.split("masked", " ")).alias("at", "word"))
    steady = (words.where(F.col("word") != WILD).groupBy("leaf", "at", "word").agg(F.sum("docs").alias("n"))
              .where(F.col("n") >= min_docs).select("leaf", "at", "word", F.lit(True).alias("steady")))
    word = F.when(F.col("steady"), F.col("word")).otherwise(WILD)
    template = (words.join(steady, ["leaf", "at", "word"], "left").groupBy("leaf", "line")
                .agg(F.sort_array(F.collect_list(F.struct("at", word.alias("word")))).alias("w"),
                     F.count("steady").alias("fixed"), F.count_if(F.col("word") != WILD).alias("n"))
                .where((F.col("fixed") >= 1) & (F.col("fixed") >= constant * F.col("n")))
                .select("line", F.array_join(F.col("w.word"), " ").alias("template")))
    template = save(template, "line-templates")
    often = (seen.join(template, "line").select("template", "text_hash").distinct()
             .groupBy("template").count().where(F.col("count") >= min_docs).select("template"))
    return place, template.join(often, "template", "left_semi")


def drop_templates(docs: DataFrame, min_docs: int = MIN_DOCS, constant: float = CONSTANT) -> DataFrame:
    """``docs`` with kept_text, n_lines and n_dropped."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("kept_text", "n_lines", "n_dropped")])
    place, lines = recurring(docs.select("doc_id", "text"), min_docs, constant)
    drops = (place.join(lines.select("line"), "line", "left_semi").groupBy("doc_id", "text_hash")
             .agg(F.collect_set("pos").alias("_drops")).withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"}))
    own, names = shielded(docs)
    doc_id, text = F.col(f"`{names['doc_id']}`"), F.coalesce(F.col(f"`{names['text']}`"), F.lit(""))
    joined = (own.withColumn("_text_hash", F.xxhash64(F.col(f"`{names['text']}`")))
              .join(drops, doc_id.eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash")), "left")
              .withColumn("_lines", F.split(text, "\n")))
    kept = F.expr("array_join(transform(array_except(sequence(0, size(_lines) - 1), _drops), i -> _lines[i]), '\n')")
    return bare(joined.withColumn("kept_text", F.when(F.col("_drops").isNull(), text).otherwise(kept))
                .withColumn("n_lines", F.when(text == "", 0).otherwise(F.size("_lines")).cast("long"))
                .withColumn("n_dropped", F.coalesce(F.size("_drops"), F.lit(0)).cast("long")),
                names, "kept_text", "n_lines", "n_dropped")


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: lines, dropped lines and what is kept."""
    return drop_templates(docs.select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE_SQL = """
WITH line AS (
  SELECT doc_id, text, pos, trim(regexp_replace(l, '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' ') AS norm
  FROM (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS l,
               unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL)
), masked AS (
  SELECT doc_id, text, pos, string_split(regexp_replace(norm, '[^ 0-9]*[0-9][^ ]*', '<*>', 'g'), ' ') AS w
  FROM line WHERE norm <> ''
), placed AS (
  SELECT *, len(w) AS size, w[1] AS first, coalesce(w[2], '') AS second FROM masked
), leaf AS (
  SELECT size, first, second FROM placed GROUP BY ALL HAVING count(DISTINCT text) >= 5
), seen AS (
  SELECT DISTINCT size, first, second, w, text FROM placed JOIN leaf USING (size, first, second)
), mask AS (
  SELECT size, first, second, w, count(*) AS docs FROM seen GROUP BY ALL
), word AS (
  SELECT size, first, second, w, docs, unnest(w) AS word, unnest(range(len(w))) AS spot FROM mask
), steady AS (
  SELECT size, first, second, spot, word FROM word WHERE word <> '<*>' GROUP BY ALL HAVING sum(docs) >= 5
), template AS (
  SELECT w, list(CASE WHEN s.word IS NULL THEN '<*>' ELSE word.word END ORDER BY word.spot) AS t
  FROM word LEFT JOIN steady s ON (s.size, s.first, s.second, s.spot, s.word)
    = (word.size, word.first, word.second, word.spot, word.word)
  GROUP BY w HAVING count(s.word) >= greatest(1, 0.6 * count(*) FILTER (word.word <> '<*>'))
), often AS (
  SELECT t FROM seen JOIN template USING (w) GROUP BY t HAVING count(DISTINCT text) >= 5
), drops AS (
  SELECT doc_id, text, list(DISTINCT pos) AS d FROM placed
  JOIN template USING (w) JOIN often USING (t) GROUP BY doc_id, text
)
SELECT b.doc_id,
  CASE WHEN coalesce(b.text, '') = '' THEN 0 ELSE len(string_split(b.text, chr(10))) END::BIGINT AS n_lines,
  coalesce(len(d), 0)::BIGINT AS n_dropped,
  sha256(CASE WHEN d IS NULL THEN coalesce(b.text, '') ELSE
    array_to_string([string_split(b.text, chr(10))[(i + 1)::BIGINT]
      for i in range(len(string_split(b.text, chr(10)))) if NOT list_contains(d, i)], chr(10)) END) AS kept_sha256
FROM documents b LEFT JOIN drops USING (doc_id, text)
"""
