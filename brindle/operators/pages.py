"""Page logs and intervals: newest page versions, covers, runs and plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_writes(frames: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Newest version of each page (page_no, seq, commit_pages, data) up to the final commit's size.

    commit_pages is the database's size in pages on a commit's last frame, else 0.
    """
    by = by or []
    newest = frames.groupBy(*by, "page_no").agg(F.max_by(F.struct("seq", "data"), "seq").alias("n")).select(*by, "page_no", "n.seq", "n.data")
    size = frames.where("commit_pages > 0").groupBy(*by).agg(F.max_by("commit_pages", "seq").alias("size"))
    joined = newest.join(size, by) if by else newest.join(F.broadcast(size))
    return joined.where(F.col("page_no") <= F.col("size")).drop("size")


def overlay(frames: DataFrame, by: list[str]) -> DataFrame:
    """As `last_writes`, but each commit cuts: a page lost to a shrink doesn't come back when the database grows again.

    A version survives if its page is within the sizes of all commits from its own on.
    """
    w = Window.partitionBy(*by).orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0)
    least = F.min(F.when(F.col("commit_pages") > 0, F.col("commit_pages"))).over(w)
    alive = frames.withColumn("least", least).where(F.col("page_no") <= F.col("least"))
    best = F.max_by(F.struct("seq", "data"), "seq").alias("n")
    return alive.groupBy(*by, "page_no").agg(best).select(*by, "page_no", "n.seq", "n.data")


def compact(segments: DataFrame, by: list[str]) -> DataFrame:
    """Pages of segments (segment_no, page_no, commit_pages, data): the newest segment counts, cut to the final size only."""
    return last_writes(segments.withColumnRenamed("segment_no", "seq"), by)


def merge_ranges(ranges: DataFrame, by: list[str]) -> DataFrame:
    """Union of whole-number ranges (lo, hi), overlapping or adjacent ones together."""
    w = Window.partitionBy(*by).orderBy("lo", "hi")
    before = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = ranges.withColumn("start", F.when(before.isNull() | (F.col("lo") > before + 1), 1).otherwise(0))
    marked = marked.withColumn("island", F.sum("start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*by, "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("island")


def uncovered(segments: DataFrame, ranges: DataFrame, by: list[str]) -> DataFrame:
    """Segments (min_txid, max_txid) that no merged range contains.

    Merged ranges are apart, so only the last one that begins at or before a segment can hold it: a running maximum over both, in
    order, finds its end, and no segment is joined with the ranges of its key. Segments with a null end are covered by none.
    """
    names = segments.columns
    ends = merge_ranges(ranges, by).select(*by, F.col("lo").alias("__at"), F.col("hi").alias("__hi"), F.lit(0).alias("__kind"))
    rows = segments.select("*", F.col("min_txid").alias("__at"), F.lit(None).cast("long").alias("__hi"), F.lit(1).alias("__kind"))
    both = rows.unionByName(ends, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    reach = both.withColumn("__reach", F.max("__hi").over(w)).where("__kind = 1")
    return reach.where(~F.coalesce(F.col("max_txid") <= F.col("__reach"), F.lit(False))).select(*names)


def page_runs(pages: DataFrame, by: list[str]) -> DataFrame:
    """Contiguous runs of pages: first, last, n."""
    w = Window.partitionBy(*by).orderBy("page_no")
    marked = pages.select(*by, "page_no").distinct().withColumn("run", F.col("page_no") - F.row_number().over(w))
    return marked.groupBy(*by, "run").agg(F.min("page_no").alias("first"), F.max("page_no").alias("last"), F.count("*").alias("n")).drop("run")


def prefix_within_bytes(rows: DataFrame, by: list[str], order: str, size: str, most: int) -> DataFrame:
    """The longest prefix of each group, in order, whose sizes fit a budget: at least the first row, however large."""
    w = Window.partitionBy(*by).orderBy(order)
    kept = rows.withColumn("__b", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__n", F.row_number().over(w))
    return kept.where((F.col("__b") <= most) | (F.col("__n") == 1)).drop("__b", "__n")


def coverage(pages: DataFrame, by: list[str], lock_page: int = 0) -> DataFrame:
    """Whether the pages of each group (page_no, commit_pages) are exactly 1..commit_pages without the lock page."""
    lock = F.lit(lock_page)
    want = F.max("commit_pages") - F.when((lock > 0) & (lock <= F.max("commit_pages")), 1).otherwise(0)
    return pages.groupBy(*by).agg(
        F.count_distinct("page_no").alias("n"),
        ((F.count_distinct("page_no") == want) & (F.min("page_no") >= 1) & (F.max("page_no") <= F.max("commit_pages")) & (F.count_if(F.col("page_no") == lock) == 0)).alias("complete"),
    )


def cover_chain(segments: DataFrame, by: list[str]) -> DataFrame:
    """Greedy chain over segments (is_snapshot, min_txid, max_txid): the newest snapshot (without one, nothing, so that
    the first transaction is next), then again and again the segment that begins inside or next to the chain and
    reaches farthest. A gap before the end shows as `gap` in the last step.

    Each step depends on the one before, so each group is walked in one task; a group is the segment
    list of one database.
    """
    import pandas as pd

    keys = [f.name for f in segments.schema if f.name in by]
    schema = ", ".join([*(f"{c} {kind}" for c, kind in segments.dtypes if c in by), "step int, min_txid long, max_txid long, gap boolean"])

    def walk(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple[int, int, int, bool]] = []
        snapshots = group[group.is_snapshot]
        end = 0
        if len(snapshots):
            top = snapshots.sort_values(["max_txid", "min_txid"], ascending=[False, True]).iloc[0]
            rows.append((0, int(top.min_txid), int(top.max_txid), False))
            end = int(top.max_txid)
        rest = sorted(((int(r.min_txid), int(r.max_txid)) for r in group[~group.is_snapshot].itertuples() if r.max_txid > end))
        k = 0
        while True:
            best = None
            while k < len(rest) and rest[k][0] <= end + 1:
                if rest[k][1] > end and (best is None or rest[k][1] > best[1]):
                    best = rest[k]
                k += 1
            if best is None:
                break
            rows.append((len(rows), best[0], best[1], False))
            end = best[1]
        if k < len(rest) and rows:
            rows[-1] = (*rows[-1][:3], True)
        out = pd.DataFrame(rows, columns=["step", "min_txid", "max_txid", "gap"])
        for c, v in zip(by, key, strict=True):
            out.insert(0, c, v)
        return out[[*keys, "step", "min_txid", "max_txid", "gap"]]

    return segments.groupBy(*by).applyInPandas(walk, schema)


def promotions(segments: DataFrame, ranges: DataFrame, by: list[str], most_inputs: int = 256, most_bytes: int = 64 << 20) -> DataFrame:
    """Inputs of the next level: the first segments (min_txid, max_txid, size) that its ranges don't cover, without a gap, within both bounds."""
    left = uncovered(segments, ranges, by)
    w = Window.partitionBy(*by).orderBy("min_txid")
    gap = F.when(F.lag("max_txid").over(w).isNotNull() & (F.col("min_txid") > F.lag("max_txid").over(w) + 1), 1).otherwise(0)
    marked = left.withColumn("__gap", gap)
    marked = marked.withColumn("__gaps", F.sum("__gap").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__n", F.row_number().over(w))
    marked = marked.withColumn("__b", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.where((F.col("__gaps") == 0) & (F.col("__n") <= most_inputs) & ((F.col("__b") <= most_bytes) | (F.col("__n") == 1))).drop("__gap", "__gaps", "__n", "__b")


def backlog(segments: DataFrame, ranges: DataFrame, by: list[str], now_ms: int) -> DataFrame:
    """Segments (min_txid, max_txid, size, created_ms) that ranges don't cover: n, bytes, oldest_age_ms, and the lag to the highest txid covered."""
    left = uncovered(segments, ranges, by).groupBy(*by).agg(
        F.count("*").alias("n"), F.sum("size").alias("bytes"), (F.lit(now_ms) - F.min("created_ms")).alias("oldest_age_ms"), F.max("max_txid").alias("newest_txid")
    )
    done = ranges.groupBy(*by).agg(F.max("hi").alias("covered_txid"))
    return left.join(done, by, "left").withColumn("lag", F.col("newest_txid") - F.coalesce("covered_txid", F.lit(0))).drop("newest_txid", "covered_txid")


def page_stats(pages: DataFrame) -> DataFrame:
    """Of each object (name, kind, n_cells, bytes, unused): its pages, leaves, overflow pages, cells of leaves, bytes and unused bytes."""
    return pages.groupBy("name").agg(
        F.count("*").alias("n_pages"),
        F.count_if(F.col("kind") == "leaf").alias("n_leaves"),
        F.count_if(F.col("kind") == "overflow").alias("n_overflow"),
        F.coalesce(F.sum(F.when(F.col("kind") == "leaf", F.col("n_cells"))), F.lit(0)).alias("n_cells"),
        F.sum("bytes").alias("bytes"),
        F.sum("unused").alias("unused"),
    )


def page_index(segments: DataFrame, by: list[str], header: int) -> DataFrame:
    """Where the newest version of each page lies: page_no, segment_no, offset, size.

    `segments`: segment_no, position, page_no, size: frames in the order of their file, which begins with `header` bytes.
    """
    w = Window.partitionBy(*by, "segment_no").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    placed = segments.withColumn("offset", F.lit(header) + F.coalesce(F.sum("size").over(w), F.lit(0)))
    best = F.max_by(F.struct("segment_no", "offset", "size"), F.struct("segment_no", "position")).alias("n")
    return placed.groupBy(*by, "page_no").agg(best).select(*by, "page_no", "n.segment_no", F.col("n.offset").cast("long").alias("offset"), "n.size")


def byte_chunks(rows: DataFrame, by: list[str], order: str, size: str, most: int) -> DataFrame:
    """Adds `chunk`: rows in order are packed greedily, each chunk as long as its sizes fit `most`, at least one row.

    Where a chunk begins depends on the one before, so a group is walked in one task; a group is the segment list of one database.
    """
    import pandas as pd

    schema = ", ".join([*(f"`{c}` {kind}" for c, kind in rows.dtypes), "chunk long"])

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order)
        chunk, held, out = 0, 0, []
        for k, n in enumerate(group[size]):
            if k and held + n > most:
                chunk, held = chunk + 1, 0
            held += n
            out.append(chunk)
        group["chunk"] = out
        return group

    return rows.groupBy(*by).applyInPandas(walk, schema)


#: Level of snapshots, which begin with the first transaction.
SNAPSHOT_LEVEL = 9


def level_chain(segments: DataFrame, by: list[str]) -> DataFrame:
    """Greedy chain over segments of several levels (level, min_txid, max_txid): step, level, min_txid, max_txid, gap.

    The snapshot that reaches farthest comes first; then, again and again, the segment that begins inside or next to the chain
    and reaches farthest, of equals the one with the lower begin, then with the higher level. A gap before the end shows as
    `gap` in the last step; without any step there is no row.
    """
    import pandas as pd

    keys = [f.name for f in segments.schema if f.name in by]
    schema = ", ".join([*(f"{c} {kind}" for c, kind in segments.dtypes if c in by), "step int, level int, min_txid long, max_txid long, gap boolean"])

    def walk(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        files = [(int(r.max_txid), -int(r.min_txid), int(r.level)) for r in group.itertuples()]
        whole = [f for f in files if f[2] == SNAPSHOT_LEVEL and f[1] == -1]
        chain = [max(whole)] if whole else []
        open_ = sorted((f for f in files if f[2] != SNAPSHOT_LEVEL), key=lambda f: -f[1])
        k, gap = 0, False
        while True:
            end, best = chain[-1][0] if chain else 0, None
            while k < len(open_) and -open_[k][1] <= end + 1:
                if open_[k][0] > end and (best is None or open_[k] > best):
                    best = open_[k]
                k += 1
            if best is None:
                gap = k < len(open_)
                break
            chain.append(best)
        out = pd.DataFrame([(n, f[2], -f[1], f[0], gap and n == len(chain) - 1) for n, f in enumerate(chain)], columns=["step", "level", "min_txid", "max_txid", "gap"])
        for c, v in zip(by, key, strict=True):
            out.insert(0, c, v)
        return out[[*keys, "step", "level", "min_txid", "max_txid", "gap"]]

    return segments.groupBy(*by).applyInPandas(walk, schema)
