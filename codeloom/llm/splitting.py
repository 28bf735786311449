"""Cutting oversized code at natural boundaries, by ranges.

A text is read in ranges of RANGE characters with a halo of one character on each
side (a CR LF may straddle two ranges). Each range yields a small boundary table: its line ends, which of them end a
block, its longest inner line. The tables are stitched per item: the line across two ranges is judged, line numbers are prefix sums. Cuts are
chosen on the tables of RUN ranges at a time, from the last line end before them to their last one; pieces are emitted as offsets. Text
meets them again range by range: each piece is cut out of the range that it ends in, which is read with a halo of one piece.
No task needs the text or the boundaries of a whole item.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RANGE = 65_536
#: ranges whose pieces are chosen together
RUN = 16
#: the ranges of texts longer than this go to different tasks; a shorter text is read where its row was read
SPREAD_OVER = 1 << 22
LIMIT = 4_000
OVERLAP = 200
_END = re.compile(r"\r\n|\r|\n")
_BLOCK_END = re.compile(r"\s*(?:[})\]]+[;,]?|end[;.]?)?\s*\Z", re.I)


def _cuts(start: int, end: int, bounds: list[int], blocks: list[int], limit: int, step: int) -> list[int]:
    """Ends of the pieces of [start, end): as late as fits beside the overlap, at the end of a block if one is in the later half, else of a line.

    A piece that would leave less than an overlap's length behind gives some up. A line beyond ``step`` is kept whole if it fits the limit.
    """
    out, at, spare = [], start, limit - step
    while at < end:
        if end - at <= step:
            out.append(end)
            break
        most = min(at + step, max(at + step // 2, end - spare))
        k, j = bisect_right(bounds, most), bisect_right(blocks, most)
        if j and blocks[j - 1] > at + step // 2:
            at = blocks[j - 1]
        elif k and bounds[k - 1] > at:
            at = bounds[k - 1]
        else:
            k = bisect_right(bounds, at)
            line = min(bounds[k], end) if k < len(bounds) else end  # the next line end
            at = line if line - at <= limit and (line <= at + step or at == start or bisect_left(bounds, at) < len(bounds) and bounds[bisect_left(bounds, at)] == at) else at + step
        out.append(at)
    return out


def range_texts(rows: DataFrame, key: list[str], text: str, size: int, before: int, behind: int, spread_over: int | None = SPREAD_OVER) -> DataFrame:
    """key..., total, range_no, lead, piece: each range with up to ``before`` characters in front of it (``lead`` of them) and ``behind`` after it."""
    n = F.char_length(text)

    def cut(r: DataFrame) -> DataFrame:
        starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(size))
        lead = lambda s: F.least(s, F.lit(before))
        pieces = F.transform(starts, lambda s: F.struct(lead(s).alias("lead"), F.substring(F.col(text), s - lead(s) + 1, lead(s) + size + behind).alias("piece")))
        return r.select(*key, n.alias("total"), F.posexplode(pieces).alias("range_no", "p")).select(*key, "total", "range_no", "p.*")

    if spread_over is None:
        return cut(rows)
    return cut(rows.where(n <= spread_over)).union(cut(rows.where(n > spread_over)).repartition(*key, "range_no"))


def boundary_tables(rows: DataFrame, key: list[str], text: str, size: int = RANGE, spread_over: int | None = SPREAD_OVER) -> DataFrame:
    """key..., total, range_no, bounds, blocks, first, term, last, inner: one row per range. Line ends are places after them; blocks are those that end a block."""
    r = range_texts(rows, key, text, size, 1, 1, spread_over)
    types = {f.name: f.dataType.simpleString() for f in r.schema.fields}
    schema = ", ".join(f"`{c}` {types[c]}" for c in [*key, "total", "range_no"]) + ", bounds array<int>, blocks array<int>, first int, term int, last int, inner int"

    def tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cols = []
            for no, lead, t in zip(b["range_no"], b["lead"], b["piece"]):
                start = no * size
                bounds, blocks, inner, term, prev = [], [], 0, None, 0
                for m in _END.finditer(t):
                    e = start + m.end() - lead
                    if start < e <= start + size:
                        if bounds:
                            inner = max(inner, start + m.start() - lead - bounds[-1])
                        else:
                            term = m.end() - m.start()
                        bounds.append(e)
                        if _BLOCK_END.match(t, prev, m.start()):
                            blocks.append(e)
                    prev = m.end()
                cols.append((bounds, blocks, bounds[0] if bounds else None, term, bounds[-1] if bounds else None, inner))
            out = b[[*key, "total", "range_no"]].copy()
            for i, c in enumerate(("bounds", "blocks", "first", "term", "last", "inner")):
                out[c] = pd.Series([x[i] for x in cols], index=out.index, dtype=object if c in ("bounds", "blocks") else "Int32")
            yield out

    return r.mapInPandas(tables, schema)


def longest_lines(tables: DataFrame, key: list[str]) -> DataFrame:
    """key..., longest: the longest line of each item, without its end. Ranges are stitched in runs, and runs per item, so no window holds a whole long item."""
    at = Window.partitionBy(*key, "run").orderBy("range_no")
    t = tables.withColumn("run", F.floor(F.col("range_no") / (RUN * RUN)))
    t = t.withColumn("prev", F.max("last").over(at.rowsBetween(Window.unboundedPreceding, -1)))
    # a line that begins in an earlier run is judged by the runs' first and last line ends
    t = t.withColumn("joint", F.col("first") - F.col("term") - F.col("prev"))
    runs = t.groupBy(*key, "run").agg(F.max(F.greatest("inner", "joint")).alias("longest"), F.min(F.struct(F.col("first").isNull().alias("none"), "first", "term")).alias("f"), F.max("last").alias("last"), F.max("total").alias("total"))
    over = Window.partitionBy(*key).orderBy("run")
    runs = runs.withColumn("prev", F.coalesce(F.max("last").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("longest", F.greatest("longest", F.col("f.first") - F.col("f.term") - F.col("prev")))
    g = runs.groupBy(*key).agg(F.max("longest").alias("longest"), F.max("last").alias("last"), F.max("total").alias("total"))
    return g.select(*key, F.greatest(F.coalesce("longest", F.lit(0)), F.col("total") - F.coalesce("last", F.lit(0))).alias("longest"))


def _newest(chunks: DataFrame) -> DataFrame:
    return chunks.where("id is not null").groupBy("id").agg(F.max(_version()).alias("version"))


def _version():
    """indexed_at as a number, older than any other where it is null; times of any year pass through Python unharmed."""
    return F.coalesce(F.unix_micros(F.col("indexed_at").cast("timestamp")), F.lit(-(2**63)))


def oversized_ranges(chunks: DataFrame, limit: int = LIMIT, size: int = RANGE) -> DataFrame:
    """id, version, unit, line_start and the boundary tables of the current rows whose code is longer than the limit.

    Ranges are found before versions are told apart, so only boundary tables meet the join.
    """
    rows = chunks.where(F.char_length("code") > limit).select("id", "unit", "line_start", _version().alias("version"), "code")
    t = boundary_tables(rows, ["id", "unit", "line_start", "version"], "code", size)
    return t.join(_newest(chunks), ["id", "version"]).dropDuplicates(["id", "range_no"])


def found(chunks: DataFrame, limit: int = LIMIT) -> DataFrame:
    """id, cut of each oversized current row: hard if one line alone is over the limit, else soft.

    Null and empty codes are never oversized; rows without id are left out; rows that tie count once.
    """
    longest = longest_lines(oversized_ranges(chunks, limit).drop("bounds", "blocks"), ["id"])
    return longest.select("id", F.when(F.col("longest") > limit, "hard").otherwise("soft").alias("cut"))


def _chosen(limit: int, overlap: int):
    """Cuts of runs of ranges, with the line numbers of both ends of each piece."""

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for prev, end, before, tail, bounds, blocks in zip(b["prev"], b["end"], b["n_before"], b["tail"], b["bounds"], b["blocks"]):
                bounds, blocks = [int(x) for part in bounds for x in part], [int(x) for part in blocks for x in part]
                # the ends just before the run, for overlaps that reach back
                near = sorted({int(x) for part in tail for x in part if x <= prev})
                ends, first = [*near, *bounds], int(before) - len(near)
                out, at = [], int(prev)
                for e in _cuts(at, int(end), bounds, blocks, limit, limit - overlap):
                    start = max(0, at - min(overlap, limit - (e - at)))
                    out.append({"char_start": start, "core_start": at, "char_end": e, "a": first + bisect_right(ends, start), "b": first + bisect_right(ends, e - 1)})
                    at = e
                rows.append(out)
            yield pd.DataFrame({"id": b["id"], "version": b["version"], "unit": b["unit"], "line_start": b["line_start"].astype("Int32"), "run": b["run"], "p": rows})

    return choose


def pieces(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, size: int = RANGE, text: bool = True) -> DataFrame:
    """id, unit, piece_no, n_pieces, char_start, char_end, core_start, line_start, line_end and, with text, piece.

    Pieces are [char_start, char_end) in characters of the code and at most ``limit`` long. Each starts
    ``overlap`` characters before the end of the one before; the parts from core_start on make up the code without
    gap or overlap. Cuts lie at line ends, where possible at the end of a block. A line that
    fits the limit is never cut: if it leaves no room for the whole overlap, the overlap is shortened. A longer line is cut
    every ``limit - overlap`` characters. Line numbers continue those of the chunk (1 if it has none). Every RUN ranges
    (about a million characters) a piece ends early, at the last line end there.
    """
    r = oversized_ranges(chunks, limit, size).withColumn("run", F.floor(F.col("range_no") / RUN))
    parts = F.array_sort(F.collect_list(F.struct("range_no", "bounds", "blocks")))  # RUN of them
    g = r.groupBy("id", "version", "run").agg(F.first("unit").alias("unit"), F.first("line_start").alias("line_start"), F.max("total").alias("total"), F.max("range_no").alias("last_range"), F.max("last").alias("last"), F.sum(F.size("bounds")).alias("n"), parts.alias("parts"))
    g = g.select("id", "version", "run", "unit", "line_start", "total", "last_range", "last", "n", F.col("parts.bounds").alias("bounds"), F.col("parts.blocks").alias("blocks"))
    # a cell holds 2 GB at most, which are some 2,000 runs: what the windows hold is narrow
    w = Window.partitionBy("id").orderBy("run")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    g = g.withColumn("near", F.filter(F.flatten("bounds"), lambda x: x > F.col("last") - overlap - 2))
    g = g.withColumn("near", F.when(F.col("last").isNotNull(), F.array(F.coalesce(F.lag("near").over(w), F.array().cast("array<int>")), "near")))
    g = g.withColumn("tail", F.coalesce(F.last("near", True).over(before), F.array().cast("array<array<int>>")))
    g = g.withColumn("prev", F.coalesce(F.max("last").over(before), F.lit(0))).withColumn("n_before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    final = (F.col("last_range") + 1) * F.lit(size) >= F.col("total")
    g = g.withColumn("end", F.when(final, F.col("total")).otherwise(F.col("last"))).where(F.col("end") > F.col("prev"))
    made = g.select("id", "version", "unit", "line_start", "run", "prev", "end", "n_before", "tail", "bounds", "blocks").mapInPandas(
        _chosen(limit, overlap), "id bigint, version bigint, unit string, line_start int, run bigint, p array<struct<char_start:int,core_start:int,char_end:int,a:bigint,b:bigint>>"
    )
    made = made.withColumn("n_before", F.coalesce(F.sum(F.size("p")).over(before), F.lit(0))).withColumn("n_pieces", F.sum(F.size("p")).over(Window.partitionBy("id")))
    p = made.select("id", "version", "unit", "line_start", "n_before", "n_pieces", F.posexplode("p").alias("pos", "p"))
    base = F.coalesce(F.col("line_start"), F.lit(1))
    out = p.select(
        "id", "version", "unit", (F.col("n_before") + F.col("pos") + 1).cast("int").alias("piece_no"), F.col("n_pieces").cast("int").alias("n_pieces"), "p.char_start", "p.char_end", "p.core_start",
        (base + F.col("p.a")).cast("int").alias("line_start"), (base + F.col("p.b")).cast("int").alias("line_end"),
    )
    if not text:
        return out.drop("version")
    # pieces go to the range they end in: one row per range, which meets the range's text once
    fields = [c for c in out.columns if c not in ("id", "version")]
    by_range = out.groupBy("id", "version", F.floor((F.col("char_end") - 1) / size).cast("int").alias("range_no")).agg(F.collect_list(F.struct(*fields)).alias("ps"))
    rows = chunks.where((F.char_length("code") > limit) & F.col("id").isNotNull()).select("id", _version().alias("version"), "code")
    t = range_texts(rows, ["id", "version"], "code", size, limit, 0).drop("total").join(by_range, ["id", "version", "range_no"]).dropDuplicates(["id", "range_no"])
    t = t.select("id", "range_no", "lead", "piece", F.explode("ps").alias("p")).select("id", "p.*", F.expr("substring(piece, p.char_start - range_no * %d + lead + 1, p.char_end - p.char_start)" % size).alias("piece"))
    return t.select("id", *fields, "piece")
