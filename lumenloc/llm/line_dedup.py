"""Line dedup over overlapping windows of three lines.

Every three consecutive lines of a text, trimmed of spaces, tabs and carriage returns, form a window with a 128-bit
hash; windows of blank lines only don't count. A window's first occurrence in the order of (id, text hash, position)
stays; the lines of every later one are covered, and covered positions are merged and removed. Texts of fewer than three
lines have no window and stay as they are.

Windows, not texts, are grouped: the first occurrence is a minimum that is pre-aggregated before it moves, so a window
that a third of all documents share costs one row a task; the join that finds later occurrences is split by adaptive
execution where a window is hot. Texts move once, to meet their covered positions.

A null text stays null with 0 lines; an empty one is one empty line. Rows that repeat an id with its text count as one
document: the same position in each of them is the same occurrence. Different texts of one id, null or not, are
different documents. A null id comes first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import blocks, documents, fresh

LINES = 3
BLANK = " \t\r"


def text_hash(text_col: str) -> Column:
    """128 bits, which tell the texts of one id apart."""
    return F.struct(F.xxhash64(text_col).alias("one"), F.xxhash64(F.lit(LINES), text_col).alias("two"))


def windows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text (its hash), pos, one, two: a row a window."""
    lines = F.transform(F.split(F.col(text_col), "\n"), lambda x: F.btrim(x, F.lit(BLANK)))
    rows = df.select(F.col(id_col).alias("id"), text_hash(text_col).alias("text"), lines.alias("lines")).where(F.size("lines") >= LINES)
    own = lambda i: [F.get("lines", i + k) for k in range(LINES)]
    hashed = F.transform(F.sequence(F.lit(0), F.size("lines") - LINES), lambda i: F.when(F.concat(*own(i)) != "", F.struct(i.alias("pos"), F.xxhash64(*own(i)).alias("one"), F.xxhash64(F.lit(LINES), *own(i)).alias("two"))))
    return rows.select("id", "text", F.explode(F.array_compact(hashed)).alias("w")).select("id", "text", "w.pos", "w.one", "w.two")


def later_windows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text (its hash) and the sorted positions of the windows that occurred before."""
    rows = windows(df, id_col, text_col)
    place = F.struct("id", "text", "pos")
    # the count is of places, so that a repeated row isn't a second occurrence; it is only over one if max differs
    first = rows.groupBy("one", "two").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("one", "two", "first")
    return rows.join(first, ["one", "two"]).where(place != F.col("first")).groupBy("id", "text").agg(F.array_sort(F.collect_set("pos")).alias("at"))


def spans(at: list[int]) -> list[tuple[int, int]]:
    """Merged spans of lines, end exclusive, that windows at these sorted positions cover."""
    out: list[tuple[int, int]] = []
    for p in at:
        if out and p <= out[-1][1]:
            out[-1] = (out[-1][0], p + LINES)
        else:
            out.append((p, p + LINES))
    return out


def drop_repeated_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_lines: str = "n_lines", n_removed: str = "n_removed") -> DataFrame:
    """df with the text's later repeats removed, n_lines and n_removed; columns of the names given for these are
    replaced, all others stay as they are."""
    df = df.drop(n_lines, n_removed)
    own, places = fresh(df, "document", "places")
    later = later_windows(df, id_col, text_col).select(F.struct("id", "text").alias(own), F.col("at").alias(places))
    rows = df.join(later, df[id_col].eqNullSafe(F.col(f"{own}.id")) & (text_hash(text_col) == F.col(f"{own}.text")), "left").drop(own)
    at = df.columns.index(text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, at):
            texts, lines, removed = [], [], []
            for text, places in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                own = text.split("\n") if text is not None else []
                gone = 0
                if places:
                    keep = np.ones(len(own), bool)
                    for a, b in spans(places):
                        keep[a:b] = False
                    gone = len(own) - int(keep.sum())
                    text = "\n".join([x for x, k in zip(own, keep.tolist(), strict=True) if k])
                texts.append(text)
                lines.append(len(own))
                removed.append(gone)
            columns = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.int64()), pa.array(removed, pa.int64())], names=[*batch.schema.names[:-1], n_lines, n_removed])

    return rows.mapInArrow(cut, T.StructType([*df.schema.fields, T.StructField(n_lines, T.LongType()), T.StructField(n_removed, T.LongType())]))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_lines(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")


def oracle() -> str:
    return """with l as (select doc_id, string_split(text, chr(10)) as raw, list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))) as ls from documents),
 w as (select doc_id, i as pos, ls[i:i + 2] as w from (select doc_id, ls, unnest(range(1, len(ls) - 1)) as i from l where len(ls) >= 3) q where array_to_string(ls[i:i + 2], '') <> ''),
 f as (select w, min(struct_pack(d := doc_id, p := pos)) as first from w group by w),
 c as (select distinct w.doc_id, w.pos + k as pos from w join f on w.w = f.w, range(3) as r(k) where struct_pack(d := w.doc_id, p := w.pos) <> f.first),
 g as (select doc_id, list(pos) as gone from c group by doc_id)
 select l.doc_id, cast(coalesce(len(raw), 0) as bigint) as n_lines, cast(coalesce(len(gone), 0) as bigint) as n_removed,
   case when raw is null then null else coalesce(array_to_string(list_transform(list_filter(range(1, len(raw) + 1), lambda i: gone is null or not list_contains(gone, i)), lambda i: raw[i]), chr(10)), '') end as text
 from l left join g on l.doc_id = g.doc_id"""
