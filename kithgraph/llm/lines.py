"""Removal of lines that spread over many sites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithgraph.llm.shared import BROADCAST_KEYS, discard, matched, written

#: Registers of a sketch as a power of two; its standard error is 1.04 / 2^(LOG_REGISTERS / 2).
LOG_REGISTERS = 12


def _occurrences(df: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """(id, text_hash, line, pos, site) of every line that isn't blank; line is a hash, pos counts from 1."""
    text = F.col(text_col)
    lines = df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), F.col(site_col).alias("site"), F.posexplode(F.split(text, "\n")).alias("pos", "l"))
    return lines.where(F.trim("l") != "").select("id", "text_hash", F.xxhash64(F.trim("l")).alias("line"), (F.col("pos") + 1).alias("pos"), "site")


def wide_lines(df: DataFrame, min_sites: int, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", most: int = BROADCAST_KEYS) -> DataFrame:
    """`line`, the hash of each line found on at least min_sites distinct sites and in as many distinct texts.

    As equal texts count once, a text that many sites copy doesn't make its lines boilerplate.  Of
    each line hash, HyperLogLog sketches of its sites and of its texts are built before and merged
    after the shuffle.  A line whose estimates both exceed min_sites by more than three standard
    errors and one is wide; one that falls short by as much isn't; those between get exact
    distinct counts.  Null sites don't count.  Written to the shared folder.
    """
    lines = _occurrences(df, id_col, text_col, site_col)
    sketch = lambda c: F.hll_sketch_estimate(F.hll_sketch_agg(c, F.lit(LOG_REGISTERS)))
    least = F.least(sketch("site"), sketch("text_hash"))
    margin = 1 + 3 * 1.04 / 2 ** (LOG_REGISTERS / 2) * min_sites
    spread = lines.groupBy("line").agg(least.alias("least")).where(F.col("least") >= min_sites - margin)
    spread = written(spread.select("line", (F.col("least") > min_sites + margin).alias("sure")))
    near = written(spread.where("not sure").select("line"))
    counts = matched(lines.select("line", "site", "text_hash", "id"), near, "line", "id", most=most).groupBy("line")
    exact = counts.agg(F.countDistinct("site").alias("sites"), F.countDistinct("text_hash").alias("texts")).where((F.col("sites") >= min_sites) & (F.col("texts") >= min_sites))
    wide = written(spread.where("sure").select("line").unionByName(exact.select("line")))
    discard(spread, near)
    return wide


def remove_boilerplate(df: DataFrame, min_sites: int = 6, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", most: int = BROADCAST_KEYS) -> DataFrame:
    """df with its texts cleared of the lines of wide_lines, and n_lines, n_removed.

    Lines are compared without spaces at their ends; blank lines stay.  Every wide line goes,
    whatever is left of a text.  Null texts stay null with 0 lines, an empty text has 1 line.  Every
    row gives one row, repeated ones too; columns named n_lines or n_removed are replaced.  The
    lines of very long texts are filtered in time linear in their number.
    """
    text, lines = F.col(text_col), F.split(F.col(text_col), "\n")
    docs = df.drop("n_lines", "n_removed").withColumn("__hash", F.xxhash64(text))
    wide = wide_lines(df, min_sites, id_col, text_col, site_col, most)
    found = matched(_occurrences(df, id_col, text_col, site_col), wide, "line", "pos", most=most)
    found = found.groupBy(F.col("id").alias("__id"), F.col("text_hash").alias("__h")).agg(F.collect_set("pos").alias("__gone"))
    docs = docs.join(found, docs[id_col].eqNullSafe(F.col("__id")) & (docs["__hash"] == F.col("__h")), "left")
    kept = F.array_except(F.sequence(F.lit(1), F.size(lines)), F.col("__gone"))
    cleared = F.array_join(F.transform(kept, lambda k: F.element_at(lines, k)), "\n")
    cut = F.col("__gone").isNotNull()
    docs = docs.withColumns({
        "n_lines": F.when(text.isNotNull(), F.size(lines)).otherwise(0).cast("long"), "n_removed": F.when(cut, F.size("__gone")).otherwise(0).cast("long"),
        text_col: F.when(cut, cleared).otherwise(text),
    })
    return docs.select(*df.drop("n_lines", "n_removed").columns, "n_lines", "n_removed")


def digests(cleaned: DataFrame) -> DataFrame:
    return cleaned.select("doc_id", "n_lines", "n_removed", F.char_length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


#: DuckDB SQL for digests(remove_boilerplate(documents)).
SQL = """
WITH l AS (
  SELECT doc_id, source, t, pos, string_split(text, chr(10))[pos] AS line
  FROM (SELECT doc_id, source, text, md5(text) AS t, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM documents)
), wide AS (
  SELECT trim(line) AS k FROM l WHERE trim(line) <> '' GROUP BY 1 HAVING count(DISTINCT source) >= 6 AND count(DISTINCT t) >= 6
), m AS (
  SELECT l.*, wide.k IS NOT NULL AS hit FROM l LEFT JOIN wide ON trim(l.line) = wide.k
), d AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE hit) AS n_removed,
    coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT hit), '') AS text
  FROM m GROUP BY doc_id
)
SELECT doc_id, n_lines, n_removed, CAST(length(text) AS BIGINT) AS n_chars, sha256(text) AS text_sha256 FROM d
"""
