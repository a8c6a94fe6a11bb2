"""Line dedup: lines that many documents share leave every document.

Lines are exploded and hashed once, into a stored table of hashes and positions; documents are counted per hash, and the
positions of dropped lines travel back to their document. Line texts are never shuffled, whole texts once, beside the
positions. Lines with more than a HOT-th of all rows, of which there are fewer than HOT, are looked up in a broadcast;
the others are joined by their hash, where no key has more rows than that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, ascii_lower, stored

#: A bound on the hot lines that are broadcast: 16 bytes each.
HOT = 10_000


def line_key(line: Column) -> Column:
    """A line's key: ASCII white space stripped at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(WHITE)))


def hash128(value: Column) -> list[Column]:
    """Two 64-bit hashes with unlike seeds, which tell apart more lines than any corpus holds."""
    return [F.xxhash64(value).alias("h1"), F.xxhash64(F.lit("second"), value).alias("h2")]


def dropped_lines(docs: DataFrame, id_col: str, text_col: str, min_docs: int, min_chars: int) -> DataFrame:
    """(id, t1, t2, drop): for each distinct (id, text) that loses lines, the sorted positions of those lines."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), *(h.alias(n) for h, n in zip(hash128(text), ("t1", "t2"), strict=True)), text.alias("text"))
    lines = rows.select("id", "t1", "t2", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    keyed = stored(lines.withColumn("key", line_key(F.col("line"))).filter(F.length("key") >= min_chars).select("id", "t1", "t2", "pos", *hash128(F.col("key"))))
    # a document counts once for a line: rows per (line, document) first, combined before they are shuffled
    counted = keyed.groupBy("h1", "h2", "id").agg(F.count(F.lit(1)).alias("n")).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_rows"))
    frequent = stored(counted.filter(F.col("n_docs") >= min_docs).select("h1", "h2", "n_rows"))
    is_hot = F.col("n_rows") * HOT > keyed.count()
    hot, others = (frequent.filter(x).select("h1", "h2") for x in (is_hot, ~is_hot))
    hits = keyed.join(F.broadcast(hot), ["h1", "h2"]).unionByName(keyed.join(F.broadcast(hot), ["h1", "h2"], "left_anti").join(others, ["h1", "h2"]))
    return hits.groupBy("id", "t1", "t2").agg(F.sort_array(F.collect_set("pos")).alias("drop"))


def drop_common_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """docs with common lines removed from `text_col`, plus n_lines and n_dropped (long).

    A line is common if its key has at least `min_chars` code points and stands in at least `min_docs` documents.
    Null or empty text is one empty line (kept, and returned as ''). Rows with one id are one document; a null id is
    an id of its own. Repeated rows each get the same result. Other columns pass through; the names n_lines and
    n_dropped are replaced if present. An empty table gives an empty table.
    """
    keep = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), F.col(f"`{id_col}`").alias("id"), *(h.alias(n) for h, n in zip(hash128(text), ("t1", "t2"), strict=True)))
    drop = dropped_lines(docs.select(F.col(f"`{id_col}`").alias("d"), F.col(f"`{text_col}`").alias("x")), "d", "x", min_docs, min_chars).withColumnRenamed("id", "drop_id")
    joined = whole.join(drop.select(F.col("drop_id"), F.col("t1").alias("u1"), F.col("t2").alias("u2"), "drop"), F.col("id").eqNullSafe(F.col("drop_id")) & (F.col("t1") == F.col("u1")) & (F.col("t2") == F.col("u2")), "left")
    lines = F.split(F.coalesce(F.col("row").getField(text_col), F.lit("")), "\n")
    # positions are looked up in a map, so a text of n lines costs n lookups
    kept = F.when(F.col("drop").isNull(), F.coalesce(F.col("row").getField(text_col), F.lit(""))).otherwise(F.array_join(_without(lines, F.col("drop")), "\n"))
    return joined.select(*(kept.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in keep), F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"))


def _without(lines: Column, drop: Column) -> Column:
    """The lines whose positions aren't in `drop`; runs of kept lines are sliced out, so the work is linear."""
    n = F.size(drop)
    run = lambda i: F.slice(  # noqa: E731  the lines after the i-th dropped one
        lines,
        F.when(i < 0, F.lit(1)).otherwise(F.coalesce(F.get(drop, i), F.lit(0)) + 2),
        F.coalesce(F.get(drop, i + 1), F.size(lines)) - F.when(i < 0, F.lit(0)).otherwise(F.coalesce(F.get(drop, i), F.lit(0)) + 1),
    )
    return F.flatten(F.transform(F.sequence(F.lit(-1), n - 1), run))
