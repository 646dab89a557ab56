"""Near duplicates with SetSketch registers.

Each document's shingle set becomes a sketch: register i is the largest of floor(1 - log_b h_i(x))
over the set, h_i exponential - the exponentially spaced, truncated minimum of h_i. Sketches of a
union are the register-wise maxima, and equal registers are as likely as shingles are shared.

1. Documents with equal sets are one class (counted before any exchange of sketches).
2. Bands of registers are hashed to buckets. In a bucket each class is paired with the smallest one
   only, never all with all.
3. A pair's similarity is estimated by joint likelihood over all registers; pairs far below the
   threshold are dropped, the others verified on the full sets of their texts.
4. Components follow from the verified links. In buckets whose members are still in different
   components, a spanning forest of likely pairs is verified next: one pair for each join, not all.
5. Members that still have a likely partner in another component, by the same estimate, are compared with all such
   members of their bucket, on full sets, within the task that holds the bucket (or two blocks of a
   large one); only links come out. So nothing that shares a bucket stays uncompared.

A class is named by a number of its own and found again by the id and the hash of one of its texts, so an id that
stands on several texts is no obstacle: it has the links of all of them.

With 32 bands of 4 registers a pair at similarity 0.8 shares no bucket with probability 5e-8.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm import _kernel as kernel
from brindle.llm._common import release_shuffles, stored

SHINGLE = 4
MIN_PERCENT = 80
BANDS, ROWS = 32, 4
REGISTERS = BANDS * ROWS
BASE, RATE, TOP = 1.001, 20.0, 65535
#: Estimates below this are dropped: 5.6 standard errors of 128 registers under 0.8.
LEAST_ESTIMATE = 0.6
#: A share of equal registers below which a pair's estimate can't reach that, so it isn't worked out.
LEAST_EQUAL = 0.45
#: Shingles of the members of a bucket that are compared with one another in one task; larger buckets are cut into blocks.
BLOCK = 1 << 19
#: Shingles of small buckets that share a task.
TASK = 1 << 18
#: Tasks of a stage that compares within buckets, at most; beyond it a task has several groups.
MOST_TASKS = 20_000
#: Classes whose numbers (24 bytes each) are broadcast to find their texts, at most.
FEW = 100_000
#: Pairs whose similarity is estimated at once.
PAIRS = 1 << 15

_random = np.random.Generator(np.random.PCG64(7))
_MULTIPLY = _random.integers(1, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND_STEP = _random.integers(1, 1 << 63, (ROWS, 1), dtype=np.uint64) | np.uint64(1)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Registers (uint16) of a set of hashes; of an empty set all 0."""
    if not len(shingles):
        return np.zeros(REGISTERS, np.uint16)
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(shingles), 1024):
        np.minimum(least, (shingles[None, i : i + 1024] * _MULTIPLY[:, None]).min(axis=1), out=least)
    uniform = (kernel_fraction(least) + 0.5) * 2.0**-53
    spaced = np.floor(1 - np.log(-np.log1p(-uniform) / RATE) / math.log(BASE))
    return np.clip(spaced, 0, TOP).astype(np.uint16)


def kernel_fraction(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Most likely Jaccard similarity of pairs of sketches (rows of a and b), given the sets' sizes.

    The numbers of registers that are larger, smaller and equal have probabilities that depend on
    the similarity J alone: p(u - v J), p(v - u J) and the rest, with u and v the sizes' shares and
    p(x) = -log_b(1 - x (b - 1) / b). The likelihood is unimodal in J; a ternary search finds its top.
    """
    larger, smaller = (a > b).sum(axis=-1), (a < b).sum(axis=-1)
    equal = a.shape[-1] - larger - smaller
    u = n_a / (n_a + n_b)
    v = 1 - u
    part = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)

    def likelihood(j: np.ndarray) -> np.ndarray:
        p, q = np.maximum(part(u - v * j), 1e-12), np.maximum(part(v - u * j), 1e-12)
        return larger * np.log(p) + smaller * np.log(q) + equal * np.log(np.maximum(1 - p - q, 1e-12))

    low, high = np.zeros(u.shape), np.minimum(u / np.maximum(v, 1e-12), v / np.maximum(u, 1e-12))
    for _ in range(24):
        x, y = low + (high - low) / 3, high - (high - low) / 3
        right = likelihood(x) < likelihood(y)
        low, high = np.where(right, x, low), np.where(right, high, y)
    return (low + high) / 2


def _sketch_batches(width: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = kernel.buffers(batch.column(2))
            for i, j, part, own in kernel.chunks(data, offsets):
                sets = list(kernel.shingle_sets(part, own, width))
                digest = np.array([[x.sum(), np.bitwise_xor.reduce(kernel.mix64(x))] if len(x) else [0, 0] for x in sets], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        batch.column(1).slice(i, j - i),
                        pa.array([len(x) for x in sets], pa.int64()),
                        pa.array(digest[:, 0]),
                        pa.array(digest[:, 1]),
                        pa.array([sketch(x).tobytes() if len(x) else None for x in sets], pa.binary()),
                    ],
                    names=["doc_id", "h", "n_shingles", "d1", "d2", "sketch"],
                )

    return run


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS)


def _bucket_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            r = _registers(batch.column(1)).astype(np.uint64).reshape(-1, BANDS, ROWS)
            x = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), r.shape[:2])
            for k in range(ROWS):
                x = kernel.mix64((x + r[:, :, k]) * _BAND_STEP[k])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(batch.column(0).to_numpy(), BANDS)),
                    pa.array(x.reshape(-1).view(np.int64)),
                    pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(x))),
                ],
                names=["rep", "bucket", "band"],
            )


def _estimate_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            cols = {n: batch.column(n) for n in batch.schema.names}
            like = estimate(_registers(cols["sx"]), _registers(cols["sy"]), cols["nx"].to_numpy().astype(float), cols["ny"].to_numpy().astype(float))
            keep = pa.array(like >= LEAST_ESTIMATE)
            score = pa.array(np.round(like * 1e6).astype(np.int64))
            yield pa.RecordBatch.from_arrays([cols["x"].filter(keep), cols["y"].filter(keep), score.filter(keep)], names=["x", "y", "like"])


def _sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    data, offsets = kernel.buffers(texts)
    for _, _, part, own in kernel.chunks(data, offsets):
        yield from kernel.shingle_sets(part, own, width)


def _verify_batches(width: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                batch = whole.slice(k, 512)
                keep = []
                for a, b in zip(_sets(batch.column(2), width), _sets(batch.column(3), width), strict=True):
                    shared = len(np.intersect1d(a, b, assume_unique=True))
                    keep.append(shared > 0 and 100 * shared >= MIN_PERCENT * (len(a) + len(b) - shared))
                mask = pa.array(keep, pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["x", "y"])

    return run


def _likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Those of the distinct pairs (x, y) that may be similar enough by their sketches: x, y, like."""
    side = lambda id_, n, s: classes.select(F.col("rep").alias(id_), F.col("n_shingles").alias(n), F.col("sketch").alias(s))
    both = pairs.join(side("x", "nx", "sx"), "x").join(side("y", "ny", "sy"), "y").select("x", "y", "nx", "ny", "sx", "sy")
    return both.mapInArrow(_estimate_batches, "x long, y long, like long")


def _verified(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """Those of the pairs (x, y) that are similar enough on the full sets of their texts (rep, text)."""
    side = lambda id_, t: texts.select(F.col("rep").alias(id_), F.col("text").alias(t))
    both = pairs.join(side("x", "tx"), "x").join(side("y", "ty"), "y").select("x", "y", "tx", "ty")
    return stored(both.mapInArrow(_verify_batches(width), "x long, y long"))


def _fetched(texts: DataFrame, grouped: DataFrame, pairs: DataFrame, have: DataFrame | None, repeated: bool) -> DataFrame:
    """One text (rep, text) of each class in pairs, added to those that are there. `repeated`: whether ids stand on several rows."""
    reps = pairs.select(F.explode(F.array("x", "y")).alias("rep")).distinct()
    if have is not None:
        reps = reps.join(have.select("rep"), "rep", "left_anti")
    wanted = stored(reps.join(grouped.select("rep", "doc_id", "h"), "rep"))
    n = wanted.count()
    if have is not None and not n:
        return have
    # Few numbers go to the texts; for many, the texts are exchanged by id.
    found = texts.join(F.broadcast(wanted) if n <= FEW else wanted, ["doc_id", "h"]).select("rep", "text")
    if repeated:  # rows that repeat an id and its text are one: the first of them is as good as any
        found = found.groupBy("rep").agg(F.first("text").alias("text"))
    found = stored(found)
    release_shuffles(texts.sparkSession)
    return found if have is None else have.union(found)


def components(edges: DataFrame) -> DataFrame:
    """Smallest id reachable over edges (x, y): rows (id, component) of all ids with an edge.

    Each round takes the smallest label among neighbours and then that label's own label, so the
    number of rounds grows with the logarithm of a chain's length.
    """
    both = stored(edges.select("x", "y").union(edges.select("y", "x")).where("x <> y").distinct())
    labels = stored(both.groupBy(F.col("x").alias("id")).agg(F.least("id", F.min("y")).alias("component")))
    while True:
        near = both.join(labels.select(F.col("id").alias("y"), "component"), "y").groupBy("x").agg(F.min("component").alias("near"))
        lower = labels.join(near, labels["id"] == near["x"]).select("id", "component", F.least("component", "near").alias("next"))
        lower = stored(lower)
        jump = lower.select(F.col("id").alias("next"), F.col("next").alias("far"))
        new = stored(lower.join(jump, "next").select("id", F.col("component").alias("old"), "far"))
        labels = new.select("id", F.col("far").alias("component"))
        if new.where("old <> far").isEmpty():
            return labels


def _mixed(members: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of buckets that hold several components, with sketches; a large bucket is cut into blocks, a row for each pair of them."""
    own = members.join(labels.select(F.col("id").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    own = own.join(classes, "rep")
    mixed = own.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.sum("n_shingles").alias("size")).where("low <> high")
    rows = own.join(mixed.select("bucket", "size"), "bucket")
    rows = rows.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")
    return stored(rows.select("bucket", "band", low, high, "block", "rep", "component", "n_shingles", "sketch"))


def _by_task(rows: DataFrame):  # noqa: ANN202
    """Rows dealt to tasks of about `TASK` shingles: a task's group has whole buckets, or pairs of blocks."""
    size = rows.agg(F.sum("n_shingles").alias("size")).first()["size"] or 0
    groups = max(1, int(size // TASK))
    # A number of partitions that is asked for isn't lowered to fit the few bytes that such work has.
    dealt = rows.withColumn("group", F.pmod(F.xxhash64("bucket", "low", "high"), F.lit(groups))).repartition(min(groups, MOST_TASKS), "group")
    return dealt.groupBy("group")


def _segments(table: pa.Table) -> tuple[pa.Table, Iterator[tuple[int, int]]]:
    table = table.sort_by([("bucket", "ascending"), ("low", "ascending"), ("high", "ascending")])
    bucket, low, high = (table.column(c).to_numpy() for c in ("bucket", "low", "high"))
    new = np.flatnonzero((np.diff(bucket) != 0) | (np.diff(low) != 0) | (np.diff(high) != 0)) + 1
    return table, zip(np.r_[0, new], np.r_[new, len(bucket)], strict=True)


def _joining(table: pa.Table) -> pa.Table:
    """Likely pairs that would join all components of each bucket."""
    table, segments = _segments(table)
    rep, comp, n = (table.column(c).to_numpy() for c in ("rep", "component", "n_shingles"))
    regs = _registers(table.column("sketch"))
    found = [_forest(rep[a:b], comp[a:b], n[a:b], regs[a:b]) for a, b in segments]
    x, y = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    return pa.table({"x": x, "y": y})


def _open(table: pa.Table) -> pa.Table:
    """Members that a likely partner of another component shares their bucket with, in the first band that both share."""
    table, segments = _segments(table)
    names = ("rep", "component", "block", "low", "high", "band", "n_shingles")
    rep, comp, block, low, high, band, n = (table.column(c).to_numpy() for c in names)
    regs = _registers(table.column("sketch"))
    bands = np.ascontiguousarray(regs).view(np.uint64)  # four registers of two bytes are one band
    needed = np.zeros(len(rep), bool)
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0

    def settle() -> None:
        if waiting:
            x, y = (np.concatenate(c) for c in zip(*waiting, strict=True))
            likely = estimate(regs[x], regs[y], n[x].astype(float), n[y].astype(float)) >= LEAST_ESTIMATE
            needed[x[likely]] = needed[y[likely]] = True
            waiting.clear()

    for a, b in segments:
        for i in range(a, b):
            j = np.flatnonzero((comp[i + 1 : b] != comp[i]) & ((block[i + 1 : b] != block[i]) | (low[a] == high[a]))) + i + 1
            # As many equal registers are needed as the least estimate says: their number errs no more than that.
            j = j[(regs[j] == regs[i]).sum(axis=1) >= LEAST_ESTIMATE * REGISTERS] if len(j) else j
            if len(j):
                j = j[(bands[j] == bands[i]).argmax(axis=1) == band[a]]
                waiting.append((np.full(len(j), i), j))
                held += len(j)
                if held >= PAIRS:
                    settle()
                    held = 0
    settle()
    return table.select(["bucket", "low", "high", "block", "rep", "component", "n_shingles"]).filter(pa.array(needed))


def _exact(table: pa.Table, width: int) -> pa.Table:
    """Verified links that join components within each bucket: every pair across components is compared on full sets."""
    table, segments = _segments(table)
    rep, comp, block, low, high = (table.column(c).to_numpy() for c in ("rep", "component", "block", "low", "high"))
    sets = list(_sets(table.column("text"), width))
    n = np.array([len(x) for x in sets], np.int64)
    links: list[tuple[int, int]] = []
    for a, b in segments:
        flat, ids = np.unique(np.concatenate(sets[a:b]), return_inverse=True)
        starts = np.concatenate(([0], np.cumsum(n[a:b])))
        mark = np.zeros(len(flat), np.int32)
        own = comp[a:b].copy()
        for i in range(b - a):
            others = np.flatnonzero((own != own[i]) & (np.arange(b - a) > i) & ((block[a:b] != block[a + i]) | (low[a] == high[a])))
            if not len(others):
                continue
            mine = ids[starts[i] : starts[i + 1]]
            mark[mine] = 1
            shared = np.add.reduceat(mark[ids], starts[:-1])[others]
            mark[mine] = 0
            for j in others[100 * shared >= MIN_PERCENT * (n[a + i] + n[a + others] - shared)]:
                if own[j] != own[i]:
                    links.append((max(rep[a + i], rep[a + j]), min(rep[a + i], rep[a + j])))
                    own[own == own[j]] = own[i]
    x, y = np.array(links, np.int64).T if links else np.zeros((2, 0), np.int64)
    return pa.table({"x": x, "y": y})


def _forest(rep: np.ndarray, comp: np.ndarray, n: np.ndarray, regs: np.ndarray) -> np.ndarray:
    """A spanning forest of a bucket's components by equal registers: columns (x, y), x > y, of likely pairs."""
    size, joined = len(rep), 2 * REGISTERS
    best, link, out = np.zeros(size, np.int16), np.zeros(size, np.int64), np.ones(size, bool)
    edges: list[tuple[int, int]] = []
    for _ in range(size):
        i = int(np.where(out, best, -1).argmax())
        if 0 < best[i] < joined:
            edges.append((i, int(link[i])))
        out[i] = False
        equal = (regs[i] == regs).sum(axis=1)
        weight = np.where(comp == comp[i], joined, np.where(equal >= LEAST_EQUAL * REGISTERS, equal, 0)).astype(np.int16)
        closer = weight > best
        best[closer], link[closer] = weight[closer], i
    if not edges:
        return np.zeros((2, 0), np.int64)
    x, y = np.array(edges).T
    keep = estimate(regs[x], regs[y], n[x].astype(float), n[y].astype(float)) >= LEAST_ESTIMATE
    x, y = x[keep], y[keep]
    return np.stack([np.maximum(rep[x], rep[y]), np.minimum(rep[x], rep[y])])


def near_duplicates(docs: DataFrame, *, shingle: int = SHINGLE) -> DataFrame:
    """Out: doc_id, n_shingles, component_id, kept (doc_id = component_id). A shingle has `shingle` words.

    Null and blank texts have no shingles and are linked with nothing. Rows that repeat an id are one document: with
    different texts it has the links of all of them, and n_shingles is that of a row's own text. A row without an id can't
    stand for a group, nor be named by one: it is linked with nothing, its component_id is null, and it is kept. An empty
    table gives no rows. Columns other than doc_id and text are not looked at.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    rows = stored(texts.mapInArrow(_sketch_batches(shingle), "doc_id long, h long, n_shingles long, d1 long, d2 long, sketch binary"))
    same = ["n_shingles", "d1", "d2"]
    grouped = rows.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(*same).agg(F.min(F.struct("doc_id", "h")).alias("one"), F.first("sketch").alias("sketch"))
    # The number is only written, never worked out again.
    grouped = stored(grouped.select(F.monotonically_increasing_id().alias("rep"), *same, "one.doc_id", "one.h", "sketch"))
    classes = grouped.select("rep", "n_shingles", "sketch")
    placed = classes.select("rep", "sketch").mapInArrow(_bucket_batches, "rep long, bucket long, band int")
    hubs = placed.groupBy("bucket").agg(F.min("rep").alias("hub"), F.count("*").alias("n")).where("n > 1")
    members = stored(placed.join(hubs.select("bucket", "hub"), "bucket"))
    release_shuffles(docs.sparkSession)

    # First each class with the likeliest of the smallest ones in its buckets, then whatever is still apart.
    stars = _likely(members.where("rep <> hub").select(F.col("rep").alias("x"), F.col("hub").alias("y")).distinct(), classes)
    tested = stored(stars.groupBy("x").agg(F.max(F.struct("like", -F.col("y"))).alias("best")).select("x", (-F.col("best.col2")).alias("y")))
    several = _repeated_ids(rows, same)
    repeated, torn = not several.isEmpty(), several.where("torn").select("doc_id")
    torn = None if not repeated or torn.isEmpty() else torn
    needed = _fetched(texts, grouped, tested, None, repeated)
    links = _verified(tested, needed, shingle)
    links = links if torn is None else links.union(_torn_links(rows, torn, grouped, same))
    # Then the few pairs that may join what a bucket still holds apart.
    apart = _mixed(members, classes, components(links))
    more = stored(_by_task(apart).applyInArrow(_joining, "x long, y long").distinct().join(tested, ["x", "y"], "left_anti"))
    needed = _fetched(texts, grouped, more, needed, repeated)
    links = stored(links.union(_verified(more, needed, shingle)))
    # What is apart even now is compared on full sets, all with all across components, where each bucket lies.
    apart = _mixed(members, classes, components(links))
    schema = "bucket long, low int, high int, block int, rep long, component long, n_shingles long"
    apart = stored(_by_task(apart).applyInArrow(_open, schema))
    needed = _fetched(texts, grouped, apart.select(F.col("rep").alias("x"), F.col("rep").alias("y")), needed, repeated)
    apart = apart.join(needed, "rep")
    links = stored(links.union(_by_task(apart).applyInArrow(lambda table: _exact(table, shingle), "x long, y long")))
    labels = components(links)

    # A component is named by the smallest id of its classes.
    named = grouped.select("rep", *same, "doc_id").join(labels.select(F.col("id").alias("rep"), "component"), "rep", "left")
    named = named.select(*same, F.coalesce("component", "rep").alias("component"), F.col("doc_id").alias("least"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(smallest, "component").select(*same, "component_id")
    out = rows.select("doc_id", *same).join(named, same, "left")
    part = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    out = out.select("doc_id", "n_shingles", part.alias("component_id"))
    if torn is not None:  # a row without shingles belongs where the other texts of its id do
        whole = out.join(torn, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component_id").alias("whole"))
        out = out.join(whole, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("whole", "component_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _repeated_ids(rows: DataFrame, same: list[str]) -> DataFrame:
    """Ids that stand on several rows: doc_id, torn (whether on different texts)."""
    text = F.struct(*same)
    each = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n"), (F.min(text) < F.max(text)).alias("torn"))
    return stored(each.where("n > 1").select("doc_id", "torn"))


def _torn_links(rows: DataFrame, torn: DataFrame, grouped: DataFrame, same: list[str]) -> DataFrame:
    """Links (x, y) between the classes that share an id, which stands on texts of each."""
    several = rows.join(torn, "doc_id", "left_semi").select("doc_id", *same).distinct().join(grouped.select("rep", *same), same)
    hub = several.groupBy("doc_id").agg(F.min("rep").alias("y"))
    return stored(several.join(hub, "doc_id").where("rep <> y").select(F.col("rep").alias("x"), "y").distinct())


def keep_one(docs: DataFrame, *, shingle: int = SHINGLE) -> DataFrame:
    """The rows of `docs` that `near_duplicates` keeps, with their own columns: those of the smallest id of each component, and those without an id."""
    gone = near_duplicates(docs, shingle=shingle).where("NOT kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["__gone"], "left_anti")
