"""Cross-site boilerplate removal by each line's distinct-site spread.

Lines are known by the 64-bit hash of their trimmed text. HyperLogLog sketches of the sites, merged by aggregation,
tell lines far from the threshold; lines near it get an exact distinct count. A widespread line is boilerplate if it has
that spread in texts of other content too; lines that only stand in texts made of widespread lines are the content of
copies, which near-duplicate removal judges. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, quoted, slim

#: Rows of the commonest line that one task of a join on line hashes may get, and the most tasks they are dealt over.
SALT_ROWS = 1_000_000
MOST_SALTS = 4096


def content_key(*columns: Column) -> Column:
    """96 bits of a row's content: equal rows share it, and null ids do no harm."""
    return F.struct(F.xxhash64(*columns).alias("a"), F.hash(*columns).alias("b"))


def _lines(docs: DataFrame) -> DataFrame:
    """key, site, at, hash, size, whole for each line with more than spaces; no line text leaves the scan."""
    parts = docs.select("key", "site", F.length("text").alias("whole"), F.transform(F.split("text", "\n", -1), lambda x: F.named_struct(F.lit("hash"), F.xxhash64(F.trim(x)), F.lit("size"), F.when(F.trim(x) != "", F.length(x)))).alias("parts"))
    return parts.select("key", "site", "whole", F.posexplode_outer("parts").alias("at", "part")).select("key", "site", "whole", "at", "part.hash", "part.size").where("size is not null")


def _salted(lines: DataFrame, hashes: DataFrame, salts: int) -> DataFrame:
    """The lines of the given hashes; a line that many rows have is dealt over as many tasks as its number asks for."""
    if salts == 1:
        return lines.join(hashes.select("hash"), "hash")
    own = hashes.select("hash", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    return lines.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(salts)).cast("int")).join(own, ["hash", "salt"]).drop("salt")


def exact_spread(lines: DataFrame, min_sites: int) -> DataFrame:
    """hash of lines(hash, site) on `min_sites` sites or more: distinct pairs first, so that no set of sites is gathered."""
    return lines.groupBy("hash", "site").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count("site").alias("sites")).where(F.col("sites") >= min_sites).select("hash")


def spread_lines(lines: DataFrame, min_sites: int, scratch: Scratch, band: float = 0.25, lg_k: int = 12) -> tuple[DataFrame, int]:
    """(hashes of lines on `min_sites` sites or more, salts that a join on them needs). `band` is many times the sketch's
    standard error of 1.6 %."""
    low, high = int(min_sites * (1 - band)), int(min_sites * (1 + band)) + 1
    sketched = lines.groupBy("hash").agg(F.count("*").alias("n"), F.hll_sketch_agg("site", lg_k).alias("sketch")).where(F.col("n") >= min_sites).select("hash", "n", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= low)
    sketched = scratch.save(sketched, "sketched")
    salts = min(MOST_SALTS, 1 + (sketched.agg(F.max("n")).first()[0] or 0) // SALT_ROWS)
    exact = exact_spread(_salted(lines, sketched.where(F.col("sites") < high), salts), min_sites)
    return scratch.save(sketched.where(F.col("sites") >= high).select("hash").union(exact), "spread"), salts


def marked(rows: DataFrame, min_sites: int) -> DataFrame:
    """key and gone (places of boilerplate lines), for rows(key, text, site) with such lines."""
    scratch, lines = Scratch(rows.sparkSession, "lines"), _lines(rows)
    spread, salts = spread_lines(lines, min_sites, scratch)
    found = scratch.save(_salted(lines, spread, salts), "found")
    mixed = found.groupBy("key").agg(F.sum(F.col("size").cast("bigint")).alias("wide"), F.first("whole").alias("whole"), F.count("*").alias("n"), F.countDistinct("at").alias("places"))
    mixed = mixed.where(2 * F.col("wide") <= F.col("whole") * F.col("n") / F.col("places")).select("key")  # n / places: repeated rows
    boilerplate = scratch.save(exact_spread(found.join(mixed, "key", "left_semi"), min_sites), "boilerplate")
    marks = scratch.save(_salted(found, boilerplate, salts).groupBy("key").agg(F.collect_set("at").alias("gone")), "marks")
    scratch.drop("sketched", "spread", "found", "boilerplate")
    return marks


def _without(text: Column, gone: Column) -> Column:
    """The text without the lines at the places in `gone`, if there are any."""
    return F.when(F.size(gone) > 0, F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains(gone, i)), "\n")).otherwise(text)


def dedup_lines(docs: DataFrame, min_sites: int = 10, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, text without its boilerplate lines.

    A line is boilerplate if it is on `min_sites` sites or more, counting only documents of which such widespread lines
    make up half of the characters at most. A copied text's own lines are widespread in copies alone, so they stay, for
    near-duplicate removal to judge; boilerplate goes wherever it stands, short documents included. A null text stays
    null with 0 lines; an empty one has one line and stays; lines of spaces alone always stay; a null site counts as
    none; repeated rows are treated alike; an empty table gives no rows; other columns are not read. A text's lines are
    one array in its row, so a very long text needs memory for its hashes (16 bytes a line).

    Lines shuffle as hashes, combined map-side; joins on hashes are salted by the number of rows of the commonest line;
    the text itself is shuffled once at most.
    """
    rows = slim(docs, id_col, text_col, site_col).toDF("doc_id", "text", "site").withColumn("key", content_key(F.col("doc_id"), F.col("text")))
    joined = rows.join(marked(rows, min_sites), "key", "left")
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1)))
    return joined.select("doc_id", n_lines.cast("bigint").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_removed"), _without(F.col("text"), F.col("gone")).alias("text"))


def strip_lines(docs: DataFrame, min_sites: int = 10) -> DataFrame:
    """The documents table, all columns and rows kept, with boilerplate lines (see dedup_lines) gone from text and, if it
    has that column, n_chars counted anew.

    Reads doc_id, text and source; columns of any other name are carried along in a struct, so none can clash. A null or
    empty text stays; rows that repeat are changed alike; an empty table stays empty; a document of boilerplate alone
    keeps its row with an empty text.
    """
    whole = F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("row")
    rows = docs.select(whole, content_key(docs["doc_id"], docs["text"]).alias("key"), docs["text"].alias("text"), docs["source"].alias("site"))
    joined = rows.select("row", "key").join(marked(rows.select("key", "text", "site"), min_sites), "key", "left")
    stripped = joined.select("row", _without(F.col("row.text"), F.col("gone")).alias("stripped"))
    changed = {"text": F.col("stripped"), "n_chars": F.length("stripped").cast(dict(docs.dtypes).get("n_chars", "bigint"))}
    return stripped.select(*((changed[c] if c in changed else F.col("row")[c]).alias(c) for c in docs.columns))


ORACLE = """
WITH l AS (
  SELECT doc_id, source, text, pos, x AS line FROM (
    SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM {docs})
), spread AS (
  SELECT trim(line) AS line FROM l WHERE trim(line) <> '' GROUP BY trim(line) HAVING count(DISTINCT source) >= 10
), m AS (
  SELECT l.*, s.line IS NOT NULL AS wide FROM l LEFT JOIN spread s ON trim(l.line) = s.line
), mixed AS (
  SELECT doc_id FROM m WHERE wide GROUP BY doc_id HAVING 2 * sum(length(line)) <= any_value(length(text))
), boilerplate AS (
  SELECT trim(line) AS line FROM m WHERE wide AND doc_id IN (SELECT doc_id FROM mixed) GROUP BY trim(line) HAVING count(DISTINCT source) >= 10
), g AS (
  SELECT m.doc_id, count(*) AS n_lines, count(b.line) AS n_removed,
         coalesce(string_agg(m.line, chr(10) ORDER BY m.pos) FILTER (WHERE b.line IS NULL), '') AS rest
  FROM m LEFT JOIN boilerplate b ON trim(m.line) = b.line GROUP BY m.doc_id
)
SELECT d.doc_id, coalesce(g.n_lines, 0)::BIGINT AS n_lines, coalesce(g.n_removed, 0)::BIGINT AS n_removed,
       CASE WHEN g.n_removed > 0 THEN g.rest ELSE d.text END AS text
FROM {docs} d LEFT JOIN g USING (doc_id)
"""
