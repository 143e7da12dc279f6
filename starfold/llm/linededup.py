"""Line dedup by winnowing over line hashes. DataFrame and SQL functions only.

A document is the sequence of its lines that have words. The fingerprint of a line is the hash of
the shortest run of lines from it on that has GRAM words. Of the fingerprints that begin within
RUN - GRAM words from any line, the least is selected (the last of equals). A run of lines of RUN
words or more that two documents share contains the same windows in both, so both select the same
fingerprint from its first line on: none is missed, and most fingerprints are never shuffled by value.

Where a selected fingerprint occurs again, the stretches that select it are looked at: the shortest
runs of RUN words from a line on, and those up to a line. Together they cover every line of every
longer run. The hash of a stretch, not the fingerprint, is joined with its own first occurrence in
the order of (doc_id, text hash, line), so the first occurrence of a fingerprint in another context
hides nothing. Every other occurrence is deleted, overlapping and adjacent ones as one run. A deleted
stretch always has an earlier equal one, so the first copy of everything stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starfold.llm._common import WORD, documents, stored, unused, whole_row

RUN = 50
GRAM = 25
_D = ["__doc", "__hash"]


def keyed(docs: DataFrame) -> list[Column]:
    """doc_id and a hash of the text name a document; rows equal in both are one document."""
    return [F.col("doc_id").cast("long").alias("__doc"), F.xxhash64("text", F.length("text")).alias("__hash")]


def fingerprints(docs: DataFrame, run: int = RUN, gram: int = GRAM) -> DataFrame:
    """One row per document that has words: __doc, __hash, lines (pos, hash, words, before, till, since, by), picks (gram hash, line index).

    ``before`` counts the words of the lines before. The shortest run of ``run`` words from a line on
    ends at line ``till``, that up to it begins at ``since``; null where there is none. ``by`` is the
    line whose fingerprint it selects.
    """
    line = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("pos"), F.xxhash64(F.trim(x)).alias("h"), F.regexp_count(x, F.lit(WORD)).alias("w")))
    rows = docs.filter(F.col("text").isNotNull()).select(*_D, F.filter(line, lambda s: s["w"] > 0).alias("lines"))
    rows = rows.groupBy(*_D).agg(F.first("lines").alias("lines"))
    rows = rows.select(*_D, F.posexplode("lines").alias("at", "line")).select(*_D, "at", "line.*")
    doc = Window.partitionBy(*_D)
    rows = rows.withColumn("before", F.coalesce(F.sum("w").over(doc.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ahead = doc.orderBy("before").rangeBetween(Window.currentRow, gram - 1)
    full = F.sum("w").over(ahead) >= gram
    rows = rows.withColumn("g", F.when(full, F.xxhash64(F.collect_list("h").over(ahead))))
    near = doc.orderBy("before").rangeBetween(Window.currentRow, run - gram)
    rows = rows.withColumn("pick", F.min(F.when(F.col("g").isNotNull(), F.struct("g", (-F.col("at")).alias("back")))).over(near))
    rows = rows.withColumn("by", -F.col("pick.back")).withColumn("after", F.col("before") + F.col("w"))
    on, back = doc.orderBy("before").rangeBetween(Window.currentRow, run - 1), doc.orderBy("after").rangeBetween(1 - run, Window.currentRow)
    rows = rows.withColumn("till", F.when(F.sum("w").over(on) >= run, F.max("at").over(on)))
    rows = rows.withColumn("since", F.when(F.sum("w").over(back) >= run, F.min("at").over(back)))
    last = F.lag("pick").over(doc.orderBy("at"))
    rows = rows.withColumn("pick", F.when(F.col("pick").isNotNull() & ~F.col("pick").eqNullSafe(last), F.struct(F.col("pick.g").alias("g"), (-F.col("pick.back")).alias("at"))))
    lines = F.sort_array(F.collect_list(F.struct("at", "pos", "h", "w", "before", "till", "since", "by")))
    return rows.groupBy(*_D).agg(lines.alias("lines"), F.collect_list("pick").alias("picks"))


def stretches(prints: DataFrame, found: DataFrame) -> DataFrame:
    """__doc, __hash, a, b (line indices), key (hash) of each shortest run that selects a fingerprint of ``found`` (__doc, __hash, at)."""
    held = found.groupBy(F.col("__doc").alias("__doc2"), F.col("__hash").alias("__hash2")).agg(F.collect_list("at").alias("ats"))
    both = prints.join(held, F.col("__doc").eqNullSafe(F.col("__doc2")) & (F.col("__hash") == F.col("__hash2")))
    start = lambda x: F.element_at("lines", x["since"] + 1)
    on = F.filter("lines", lambda x: x["till"].isNotNull() & F.array_contains("ats", x["by"]))
    back = F.filter("lines", lambda x: x["since"].isNotNull() & (start(x)["till"] < x["at"]) & F.array_contains("ats", start(x)["by"]))
    ends = F.concat(F.transform(on, lambda x: F.struct(x["at"].alias("a"), x["till"].alias("b"))), F.transform(back, lambda x: F.struct(x["since"].alias("a"), x["at"].alias("b"))))
    hashed = F.transform(ends, lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), F.xxhash64(F.slice("lines.h", x["a"] + 1, x["b"] - x["a"] + 1)).alias("key")))
    return both.select(*_D, F.inline(hashed))


def _repeated(rows: DataFrame, key: str, at: str, name: str) -> DataFrame:
    """``rows`` (__doc, __hash, key, at) whose key occurs more than once, with ``first``: whether it is the first occurrence."""
    place = F.struct(F.col("__doc").isNull().alias("none"), F.coalesce("__doc", F.lit(0)).alias("d"), F.col("__hash").alias("t"), F.col(at).alias("at"))
    again = rows.groupBy(key).agg(F.count("*").alias("k"), F.min(place).alias("origin")).filter("k > 1").drop("k")
    again = stored(again, name)  # a stored table has no partitioning to keep, so Spark may split a frequent key
    return rows.join(again, key).withColumn("first", place.eqNullSafe(F.col("origin"))).drop("origin")


def repeats(docs: DataFrame, run: int = RUN, gram: int = GRAM) -> DataFrame:
    """__doc, __hash, runs (first and last line of the text, words): what is to be deleted from each document."""
    prints = stored(fingerprints(docs, run, gram), "fingerprints")
    picks = prints.select(*_D, F.inline("picks"))
    runs_of = stored(stretches(prints, _repeated(picks, "g", "at", "repeated")), "stretches")
    spans = _repeated(runs_of, "key", "a", "again").filter("not first").select(*_D, "a", "b")
    order = Window.partitionBy(*_D).orderBy("a", "b")
    reached = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("new", (reached.isNull() | (F.col("a") > reached + 1)).cast("int"))
    spans = spans.withColumn("island", F.sum("new").over(order))
    spans = spans.groupBy(*_D, "island").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    spans = spans.groupBy(F.col("__doc").alias("__doc2"), F.col("__hash").alias("__hash2")).agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("spans"))
    both = prints.join(spans, F.col("__doc").eqNullSafe(F.col("__doc2")) & (F.col("__hash") == F.col("__hash2")))
    line = lambda at, name: F.element_at(F.col(f"lines.{name}"), at + 1)
    runs = F.transform("spans", lambda s: F.struct(line(s["a"], "pos").alias("first"), line(s["b"], "pos").alias("last"), (line(s["b"], "before") + line(s["b"], "w") - line(s["a"], "before")).alias("words")))
    return both.select(*_D, runs.alias("runs"))


def dedup(docs: DataFrame, run: int = RUN, gram: int = GRAM, name: str = "line_runs") -> DataFrame:
    """Delete later repeated runs of lines from ``docs`` (doc_id, text, maybe more columns).

    Every row stays, with its own columns, the text without the deleted lines, and a column ``name``,
    which must be new: the deleted runs (first, last: line numbers from 0; words), null if there are
    none. Null and empty texts, and texts of fewer than ``run`` words, stay as they are. Null ids come
    last in the order. Rows equal in doc_id and text are one document: what is deleted from one is
    deleted from all. Of one id's different texts the order is that of their hashes. An empty table
    gives no rows.
    """
    if unused(docs, name) != name:
        raise ValueError(f"there is a column {name!r} already")
    runs = repeats(docs.select(*keyed(docs), "text"), run, gram).select(F.col("__doc").alias("__doc2"), F.col("__hash").alias("__hash2"), F.col("runs").alias("__runs"))
    rows = docs.select(*keyed(docs), whole_row(docs).alias("__row"))
    rows = rows.join(runs, F.col("__doc").eqNullSafe(F.col("__doc2")) & (F.col("__hash") == F.col("__hash2")), "left")
    text = F.col("__row.text")
    kept = F.filter(F.split(text, "\n"), lambda x, i: ~F.exists("__runs", lambda r: (i >= r["first"]) & (i <= r["last"])))
    text = F.when(F.col("__runs").isNull(), text).otherwise(F.array_join(kept, "\n"))
    rows = rows.select(F.col("__row").withField("text", text).alias("__row"), F.col("__runs"))
    return rows.select("__row.*", F.col("__runs").alias(name))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(documents(spark, sf_dir).select("doc_id", "text"))
    spans = F.array_join(F.transform("line_runs", lambda r: F.concat_ws("-", r["first"].cast("string"), r["last"].cast("string"))), ",")
    deleted = F.coalesce(F.aggregate("line_runs", F.lit(0).cast("long"), lambda a, r: a + r["words"]), F.lit(0).cast("long"))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.size("line_runs"), F.lit(0)).cast("long").alias("n_runs"), deleted.alias("words_deleted"), F.coalesce(spans, F.lit("")).alias("runs"), "text")


#: The definition itself: whole runs of lines as keys, no fingerprints and no hashes. Ids are taken to be unique.
ORACLE = r"""
WITH cut AS (
  SELECT doc_id, string_split(text, chr(10)) AS raw FROM documents WHERE text IS NOT NULL),
every AS (
  SELECT doc_id, unnest(range(len(raw))) AS pos, unnest(raw) AS line FROM cut),
rows AS (
  SELECT doc_id, pos, trim(line, ' ') AS line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM every),
lines AS (
  SELECT *, row_number() OVER d AS i, sum(w) OVER (d ROWS UNBOUNDED PRECEDING) AS upto FROM rows WHERE w > 0
  WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
docs AS (
  SELECT doc_id, list(line ORDER BY i) AS ls, list(upto ORDER BY i) AS us FROM lines GROUP BY doc_id),
ends AS (
  SELECT doc_id, a, a + len(list_filter(us[a:], lambda u: u < us[a] - w + 50)) AS b FROM lines JOIN docs USING (doc_id), LATERAL (SELECT i AS a)
  UNION ALL
  SELECT doc_id, len(list_filter(us, lambda u: u <= us[b] - 50)) + 1, b FROM lines JOIN docs USING (doc_id), LATERAL (SELECT i AS b) WHERE us[b] >= 50),
runs AS (
  SELECT DISTINCT e.doc_id, a, b, array_to_string(ls[a:b], chr(10)) AS key FROM ends e JOIN docs USING (doc_id) WHERE b <= len(ls)),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS i FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS LAST, a) AS k FROM runs) WHERE k > 1),
marked AS (
  SELECT l.*, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS island FROM lines l SEMI JOIN gone USING (doc_id, i)),
spans AS (
  SELECT doc_id, min(pos) AS first, max(pos) AS last, sum(w) AS words FROM marked GROUP BY doc_id, island),
listed AS (
  SELECT doc_id, count(*) AS n_runs, sum(words) AS words, string_agg(first || '-' || last, ',' ORDER BY first) AS runs FROM spans GROUP BY doc_id),
kept AS (
  SELECT e.doc_id, string_agg(e.line, chr(10) ORDER BY pos) AS text FROM every e
  WHERE NOT EXISTS (SELECT 1 FROM spans s WHERE s.doc_id = e.doc_id AND e.pos BETWEEN s.first AND s.last) GROUP BY e.doc_id)
SELECT d.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(coalesce(words, 0) AS BIGINT) AS words_deleted, coalesce(runs, '') AS runs,
       CASE WHEN n_runs IS NULL THEN d.text ELSE coalesce(k.text, '') END AS text
FROM documents d LEFT JOIN listed l ON d.doc_id = l.doc_id LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
