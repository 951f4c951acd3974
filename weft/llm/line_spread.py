"""Removal of lines that spread over many sites. DataFrame functions only.

A document's text is split at newlines; lines of at least ``min_words`` words are compared with
ASCII white space trimmed from their ends. For each line, HyperLogLog sketches of the sites
(``source``) that show it are merged by aggregation. A line whose estimate lies clearly above
``min_sites`` is boilerplate, one clearly below is not, and one near the threshold (within
three standard errors and one site) gets an exact distinct count. Of a boilerplate line one
occurrence stays in the corpus, the first by (doc_id, position); all others are removed. Shorter
lines ("Share", "Les.") are left alone: as often prose as boilerplate.

Defined results: a null text stays null and has no lines; a text whose lines all go becomes empty;
the null source counts as one site; a null id comes after all others; equal rows (id and text) are
one document here and end up equal. Other columns pass unchanged.

Scale: sketches are merged map-side, so a line that a third of all documents hold is one small row
for each task; occurrences (hashes and positions, no text) are kept in the shared folder; the only
shuffle of texts is the join that brings each document the positions to remove.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm._shared import WORD, WORD_GAP, cut, packed, unpacked

LG_K = 12
ERROR = 1.04 / 2 ** (LG_K / 2)


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def occurrences(docs: DataFrame, min_words: int) -> DataFrame:
    """doc_id, _text, _site, _pos, _h1, _h2 of each line of ``min_words`` words or more."""
    mine = docs.filter(F.col("text").isNotNull()).select(F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("_text"), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("_site"), F.posexplode(_lines(F.col("text"))).alias("_pos", "_raw"))
    d = mine.withColumn("_line", F.regexp_replace("_raw", f"^{WORD_GAP}|{WORD_GAP}$", ""))
    return d.filter(F.regexp_count("_line", F.lit(f"({WORD})")) >= min_words).select("doc_id", "_text", "_site", "_pos", F.xxhash64("_line").alias("_h1"), F.xxhash64(F.lit(1), "_line").alias("_h2"))


def boilerplate(found: DataFrame, min_sites: int) -> DataFrame:
    """_a, _b (hashes of the line) and _first, the occurrence that stays."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("_pos").alias("pos"))).alias("_first")
    sketched = found.groupBy(F.col("_h1").alias("_a"), F.col("_h2").alias("_b")).agg(F.hll_sketch_agg("_site", F.lit(LG_K)).alias("_sketch"), first)
    band = max(1.0, 3 * ERROR * min_sites)
    sketched = cut(sketched.withColumn("_sites", F.hll_sketch_estimate("_sketch")).drop("_sketch").filter(F.col("_sites") >= min_sites - band))
    clear = sketched.filter(F.col("_sites") > min_sites + band).select("_a", "_b", "_first")
    near = sketched.filter(F.col("_sites") <= min_sites + band).select("_a", "_b", "_first")
    sites = found.join(near, (F.col("_h1") == F.col("_a")) & (F.col("_h2") == F.col("_b")), "left_semi").groupBy("_h1", "_h2", "_site").agg(F.lit(1)).groupBy("_h1", "_h2").agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_sites)
    return clear.unionByName(near.join(sites, (F.col("_h1") == F.col("_a")) & (F.col("_h2") == F.col("_b")), "left_semi"))


def clean(docs: DataFrame, min_sites: int = 5, min_words: int = 3) -> DataFrame:
    """Each row of ``docs`` as the struct ``row``, with its cleaned text, n_lines and n_removed."""
    found = cut(occurrences(docs, min_words))
    bad = boilerplate(found, min_sites)
    hit = found.join(bad, (F.col("_h1") == F.col("_a")) & (F.col("_h2") == F.col("_b")))
    stays = F.col("doc_id").eqNullSafe(F.col("_first.id")) & (F.col("_pos") == F.col("_first.pos"))
    drop = hit.filter(~stays).groupBy(F.col("doc_id").alias("_id"), F.col("_text").alias("_hash")).agg(F.collect_set("_pos").alias("_drop"))
    mine = packed(docs, id=F.col("doc_id"), print=F.xxhash64("text"))
    joined = mine.join(drop, F.col("id").eqNullSafe(F.col("_id")) & (F.col("print") == F.col("_hash")), "left").withColumn("_all", _lines(F.col("row.text")))
    # positions that stay by one pass over a hash set, so that work grows with the lines, not with their square
    stay = F.array_except(F.sequence(F.lit(0), F.size("_all") - 1), F.col("_drop"))
    kept = F.array_join(F.transform(stay, lambda i: F.get(F.col("_all"), i)), "\n")
    text = F.when(F.col("_drop").isNull(), F.col("row.text")).otherwise(kept)
    return joined.select("row", text.alias("text"), F.coalesce(F.size("_all"), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("n_removed"))


def clean_columns(docs: DataFrame, min_sites: int = 5, min_words: int = 3) -> DataFrame:
    """The columns of ``docs`` with the cleaned text; ``n_chars``, if there is one, follows it."""
    out = clean(docs, min_sites, min_words)
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed["n_chars"] = F.when(F.col("n_removed") > 0, F.char_length("text").cast(kind)).otherwise(F.col("row.n_chars"))
    return unpacked(out, docs.columns, **changed)


def digests(docs: DataFrame, min_sites: int = 5, min_words: int = 3) -> DataFrame:
    """doc_id, n_lines, n_removed, n_chars and text_sha256 of the cleaned text."""
    out = clean(docs.select("doc_id", "text", "source"), min_sites, min_words)
    return out.select("row.doc_id", F.greatest("n_lines", F.lit(0)).alias("n_lines"), F.greatest("n_removed", F.lit(0)).alias("n_removed"), F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


ORACLE = r"""
WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL),
k AS (SELECT *, regexp_replace(raw, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line FROM l),
w AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 3 AS counted FROM k),
b AS (SELECT line, min(doc_id) AS keep_id, arg_min(pos, doc_id * 10000000 + pos) AS keep_pos FROM w WHERE counted
      GROUP BY line HAVING count(DISTINCT coalesce('s' || source, '')) >= 5),
m AS (SELECT w.doc_id, w.pos, w.raw, counted AND b.line IS NOT NULL AND NOT (w.doc_id = b.keep_id AND w.pos = b.keep_pos) AS gone FROM w LEFT JOIN b ON w.line = b.line),
t AS (SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_removed,
             coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(length(t.text), 0) AS n_chars, sha256(t.text) AS text_sha256
FROM documents d LEFT JOIN t ON d.doc_id = t.doc_id
"""
