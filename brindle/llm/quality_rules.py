"""Quality rules in native expressions: base counts and a hashed n-gram likelihood ratio.

Two multinomials over hashed n-grams are counted in one pass: one over all documents (raw), one over
trusted documents (target). A document's verdict is the mean of log(target / raw) over its n-grams
against a threshold. The n-grams are whole words and pairs of neighbouring ones, every character of
them, hashed into a table of `BUCKETS` entries whatever the corpus.

The threshold comes from labelled documents that the target doesn't count, the judges: of all ratios it is the one that parts their good
from their bad best, where the share of good ones lost weighs `GOOD_WEIGHT` times the share of bad ones kept. It is the same for every document.

Every labelled document counts, either for the target or as a judge. Trusted documents are told from others in place, by a bit filter
of bounded size and the list of ids that it takes for trusted ones wrongly; only where that list is long are the texts that the filter passes exchanged. Else counts by
bucket, ids and ratios are shuffled, and nothing more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm._common import WORD, checkpoint, known_labels, release_shuffles, stored, words

BUCKETS = 1 << 20
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = "#*$%&|<>"
#: Long integers of the bit filter, at most (8 MiB), and the bits that an id sets.
FILTER = 1 << 20
FILTER_BITS = 4
#: Trusted documents for each long integer of the filter, as long as it is below its largest size.
FILTER_IDS = 2
#: Ids that the filter takes for trusted ones wrongly are broadcast, up to so many; with more, the texts that it passes are exchanged.
MISTAKEN = 100_000
#: Parts by hash or by ratio in which labelled documents are ranked, so that no task ranks all of them.
PARTS = 4096
#: One in so many labelled documents of each class sets the threshold; the other good ones are the target.
FOLDS = 4
#: What a lost good judge weighs, if a kept bad one weighs 1 (both as shares of their class).
GOOD_WEIGHT = 2
#: Added to each bucket, so that n-grams that the target never shows have a finite ratio.
PSEUDO_COUNT = 1.0

_P = "__q_"


def _with_words(docs: DataFrame) -> DataFrame:
    """Adds the words, their hashes, and the hashes of pairs of neighbouring ones (of the last word alone at the end)."""
    df = docs.withColumn(f"{_P}words", words(F.col("text")))
    df = df.withColumn(f"{_P}hashes1", F.transform(f"{_P}words", lambda w: F.xxhash64(w)))
    return df.withColumn(f"{_P}hashes2", _joined(1))


def _joined(width: int) -> Column:
    """Hashes of twice as many words from those of `width`."""
    return F.expr(f"transform({_P}hashes{width}, (x, i) -> xxhash64(x, get({_P}hashes{width}, i + {width})))")


def _bucket(hash_: str) -> str:
    return f"CAST({hash_} & {BUCKETS - 1} AS INT)"


#: Hashes of the pairs of a text: none if it has fewer than two words.
_PAIRS = f"slice({_P}hashes2, 1, greatest(size({_P}hashes2) - 1, 0))"


def _counted(df: DataFrame) -> DataFrame:
    """One row (bucket) for each word and each pair of neighbouring words, beside the other columns."""
    hashes = F.explode(F.expr(f"concat({_P}hashes1, {_PAIRS})")).alias(f"{_P}hash")
    others = [c for c in df.columns if not c.startswith(f"{_P}hashes") and c != f"{_P}words"]
    return df.select(*others, hashes).withColumn("bucket", F.expr(_bucket(f"{_P}hash"))).drop(f"{_P}hash")


def _mean_ratio(df: DataFrame, weights: DataFrame) -> DataFrame:
    """Adds the mean of `weights` over the same n-grams, 0 for a text without words."""
    names = df.columns
    df = df.withColumns({f"{_P}grams": F.expr(f"concat({_P}hashes1, {_PAIRS})"), f"{_P}n_grams": F.greatest(2 * F.size(f"{_P}words") - 1, F.lit(1))})
    # Each column is named once from here on, so that the optimiser puts the subquery in its place: as a column of its own its
    # array would be copied into every row.
    df = df.select("*", weights.scalar().alias(f"{_P}weights"))
    total = f"transform(array({_P}weights), w -> aggregate({_P}grams, 0D, (a, h) -> a + get(w, {_bucket('h')})))[0]"
    return df.select(*names, F.expr(f"{total} / {_P}n_grams").alias(f"{_P}llr"))


def _array(rows: DataFrame, value: str, by: str) -> DataFrame:
    """One row with `all`, the array of a fixed number of values in order of `by`."""
    return rows.agg(F.sort_array(F.collect_list(F.struct(by, value))).alias("all")).select(F.transform("all", lambda x: x[value]).alias("all"))


def _filter_size(n_trusted: int) -> int:
    """Long integers of the bit filter, a power of two: the driver holds the filter several times over, so few ids get a small one."""
    return min(FILTER, 1 << max(0, -(-n_trusted // FILTER_IDS) - 1).bit_length())


def _places(size: int) -> list[tuple[str, str]]:
    """The bits of an id in a filter of `size` long integers: place of the long integer, and its value with that bit set."""
    hashes = [f"xxhash64({k}, doc_id)" for k in range(FILTER_BITS)]
    return [(f"CAST({h} & {size - 1} AS INT)", f"shiftleft(1L, CAST(shiftrightunsigned({h}, 58) AS INT))") for h in hashes]


def _flagged(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """Every row's text, and 1 as `__q_good` if its id is among `trusted` (doc_id, each once), null otherwise."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    good = F.lit(1)
    size = _filter_size(trusted.count())
    bits = trusted.select(F.inline(F.array(*(F.struct(F.expr(p).alias("place"), F.expr(b).alias("bit")) for p, b in _places(size)))))
    every = docs.sparkSession.range(size).select(F.col("id").cast("int").alias("place"))
    filled = every.join(bits.groupBy("place").agg(F.bit_or("bit").alias("bits")), "place", "left").select("place", F.coalesce("bits", F.lit(0)).alias("bits"))
    bit_filter = checkpoint(_array(filled, "bits", "place"))

    def with_taken(df: DataFrame) -> DataFrame:
        # The subquery stands in one place, as in `_mean_ratio`: the driver holds its result once for each.
        df = df.select("*", bit_filter.scalar().alias(f"{_P}filter"))
        all_set = " AND ".join(f"get(f, {place}) & {bit} != 0" for place, bit in _places(size))
        return df.withColumn(f"{_P}taken", F.expr(f"doc_id IS NOT NULL AND transform(array({_P}filter), f -> {all_set})[0]")).drop(f"{_P}filter")

    # Stored: the optimiser would test the other side of the join by the filter, too.
    taken = stored(with_taken(docs.select("doc_id")).where(f"{_P}taken").select("doc_id"))
    mistaken = stored(taken.join(trusted.hint("shuffle_hash"), "doc_id", "left_anti").distinct())
    release_shuffles(docs.sparkSession)
    if mistaken.count() <= MISTAKEN:
        found = with_taken(docs).join(F.broadcast(mistaken.withColumn(f"{_P}mistaken", F.lit(True))), "doc_id", "left")
        return found.select("text", F.when(F.col(f"{_P}taken") & F.col(f"{_P}mistaken").isNull(), good).alias(f"{_P}good"))
    # Texts that the filter passes go to the ids; the others, and rows without an id, stay.
    found = with_taken(docs).where(f"{_P}taken").join(trusted.withColumn(f"{_P}good", good).hint("shuffle_hash"), "doc_id", "left")
    others = with_taken(docs).where(f"NOT {_P}taken").select("text", F.lit(None).cast("int").alias(f"{_P}good"))
    return others.unionByName(found.select("text", f"{_P}good"))


def log_ratios(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """One row with `weights`, the log ratio of each bucket. `trusted`: doc_id, each once, in any number.

    All documents count for the raw multinomial. Without trusted documents every ratio is 0.
    """
    counts = checkpoint(
        _counted(_with_words(_flagged(docs, trusted)).drop("text"))
        .groupBy("bucket")
        .agg(F.count("*").cast("double").alias("raw"), F.count(f"{_P}good").cast("double").alias("target"))
    )
    # The filter and the shuffled counts go before the ratios come to the driver.
    release_shuffles(docs.sparkSession)
    whole = BUCKETS * PSEUDO_COUNT
    totals = counts.agg(F.sum("raw").alias("n_raw"), F.sum("target").alias("n_target"))
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    filled = every.join(counts, "bucket", "left").select("bucket", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("raw", "target")))
    n_raw, n_target = (totals.select(c).scalar() for c in ("n_raw", "n_target"))
    ratio = F.log((F.col("target") + PSEUDO_COUNT) / (n_target + whole)) - F.log((F.col("raw") + PSEUDO_COUNT) / (n_raw + whole))
    rated = filled.select("bucket", F.when(n_target > 0, ratio).otherwise(F.lit(0.0)).alias("weight"))
    return checkpoint(_array(rated, "weight", "bucket").withColumnRenamed("all", "weights"))


def _repeated_words(df: DataFrame) -> DataFrame:
    """Adds the number of words in windows of `WINDOW` words that the text holds twice or more."""
    for width in (2, 4):  # a window's hash from those of its halves
        df = df.withColumn(f"{_P}hashes{2 * width}", _joined(width))
    df = df.withColumn(
        f"{_P}windows", F.expr(f"IF(size({_P}words) <= {WINDOW}, array(), slice({_P}hashes8, 1, size({_P}words) - {WINDOW - 1}))")
    )
    df = df.withColumn(
        f"{_P}sorted",
        F.expr(
            f"IF(size(array_distinct({_P}windows)) = size({_P}windows), NULL,"
            f" sort_array(arrays_zip({_P}windows, sequence(0, size({_P}windows) - 1))))"
        ),
    )
    # Windows that equal a neighbour in order of hash, by place in the text.
    df = df.withColumn(
        f"{_P}starts",
        F.expr(
            f"IF({_P}sorted IS NULL, NULL, sort_array(transform(filter(sequence(0, size({_P}sorted) - 1),"
            f" j -> get({_P}sorted, j).{_P}windows <=> get({_P}sorted, j - 1).{_P}windows OR get({_P}sorted, j).{_P}windows <=> get({_P}sorted, j + 1).{_P}windows),"
            f" j -> get({_P}sorted, j)['1'])))"
        ),
    )
    return df.withColumn(
        f"{_P}repeated",
        F.expr(
            f"IF({_P}starts IS NULL, 0L, aggregate({_P}starts, named_struct('n', 0L, 'end', 0L), (a, s) ->"
            f" named_struct('n', a.n + s + {WINDOW} - greatest(a.end, CAST(s AS BIGINT)), 'end', CAST(s + {WINDOW} AS BIGINT)), a -> a.n))"
        ),
    )


def rate(docs: DataFrame, weights: DataFrame) -> DataFrame:
    """`docs` with the base counts and `llr`, under names starting with `__q_`.

    Null and blank texts have no words and a ratio of 0. Windows are compared by 64-bit hashes
    within one text. Every row is rated by itself, so repeated rows get equal figures. A filter on the
    results would repeat the steps in each other: they are to be stored first.
    """
    text = F.coalesce("text", F.lit(""))
    df = _repeated_words(_mean_ratio(_with_words(docs), weights))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    df = df.withColumn(f"{_P}lines", lines)
    return df.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.size(f"{_P}words").cast("long").alias(f"{_P}n_words"),
        F.length(F.array_join(f"{_P}words", "")).cast("long").alias(f"{_P}word_chars"),
        F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long").alias(f"{_P}n_symbols"),
        (F.size(f"{_P}lines") - F.size(F.array_distinct(f"{_P}lines"))).cast("long").alias(f"{_P}n_dup_lines"),
        F.col(f"{_P}repeated").cast("long").alias(f"{_P}n_repeat_words"),
        F.col(f"{_P}llr"),
    )


def threshold(rated: DataFrame, judges: DataFrame) -> float | None:
    """Ratio that parts good from bad among `judges` (doc_id, label; each id once, in any number); None if none is good.

    `rated` is a stored result of `rate`. Documents of fewer than `MIN_WORDS` words don't count: the base
    rules judge them. Rows that repeat an id count each.
    """
    known = rated.where(F.col(f"{_P}n_words") >= MIN_WORDS).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"{_P}llr").alias("llr"))
    judged = known.join(judges, "doc_id").groupBy("llr").agg(*(F.count_if(F.col("label") == v).alias(c) for c, v in (("good", 1), ("bad", 0))))
    judged = stored(judged)
    whole = judged.agg(*(F.sum(c).alias(c) for c in ("good", "bad")), F.min("llr").alias("low"), F.max("llr").alias("high")).first()
    if not whole["good"]:
        return None
    # Sums from the highest ratio downwards: over parts of the range first, then over the ratios of each part.
    part = F.floor((F.col("llr") - whole["low"]) / ((whole["high"] - whole["low"]) or 1.0) * PARTS).cast("int")
    judged = judged.withColumn("part", part)
    above = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)  # `PARTS` + 1 rows at most
    parts = judged.groupBy("part").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    parts = parts.select("part", *(F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in ("good", "bad")))
    upto = Window.partitionBy("part").orderBy(F.desc("llr"))
    kept_good, kept_bad = (F.sum(c).over(upto) + F.col(f"{c}_above") for c in ("good", "bad"))
    # Whole numbers: equal merits are equal, and of them the lowest ratio counts.
    merit = GOOD_WEIGHT * kept_good * max(1, whole["bad"]) + (whole["bad"] - kept_bad) * whole["good"]
    merits = judged.join(F.broadcast(parts), "part").select("llr", merit.alias("merit"))
    least = -merits.agg(F.max(F.struct("merit", (-F.col("llr")).alias("low"))).alias("best")).first()["best"]["low"]
    below = judged.where(F.col("llr") < least).agg(F.max("llr").alias("below")).first()["below"]
    return least if below is None else (least + below) / 2


def judge(rated: DataFrame, least: float | None) -> DataFrame:
    """Adds `base_failed` and `kept` to a stored result of `rate`. Without a threshold (`least` None) the base rules alone decide."""
    failed = (F.col(f"{_P}n_words") < MIN_WORDS) | (100 * F.col(f"{_P}n_repeat_words") > MAX_REPEAT_PERCENT * F.col(f"{_P}n_words"))
    return rated.withColumn(f"{_P}base_failed", failed).withColumn(f"{_P}kept", ~failed & (F.lit(True) if least is None else F.col(f"{_P}llr") >= least))


def labelled_ids(labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All labelled ids: the trusted ones (doc_id), and the judges (doc_id, label) that set the threshold.

    In order of a hash of the id every one in `FOLDS` of a class is a judge; the places are counted over parts of that order.
    """
    hashed = F.xxhash64(F.lit("judge"), "doc_id")
    ids = stored(known_labels(labels, "quality").withColumn("hash", hashed).withColumn("part", F.expr(f"shiftright(hash, {65 - PARTS.bit_length()})")))
    before = Window.partitionBy("label").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # at most `PARTS` rows each
    parts = ids.groupBy("label", "part").agg(F.count("*").alias("n")).select("label", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("label", "part").orderBy("hash", "doc_id")) + F.col("before")
    ids = ids.join(F.broadcast(parts), ["label", "part"])
    ids = stored(ids.select("doc_id", "label", (place % FOLDS == 0).alias("judge")))
    return ids.where("label = 1 AND NOT judge").select("doc_id"), ids.where("judge").select("doc_id", "label")


def _judged(docs: DataFrame, labels: DataFrame, names: list[str]) -> DataFrame:
    """`names` of all `docs`, rated and judged; the rows are stored between, with their ratios, for those of the judges set the threshold."""
    trusted, judges = labelled_ids(labels)
    rated = rate(docs, log_ratios(docs, trusted))
    rated = stored(rated.select(*[F.col(f"`{c}`") for c in rated.columns if c.startswith(_P) or c in names]))
    return judge(rated, threshold(rated, judges))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Out: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, llr, base_failed, kept.

    Labels other than 0 and 1 and null ids are left out; without labels nothing but the base rules decides.
    """
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr", "base_failed", "kept")
    rated = _judged(docs.select("doc_id", "text"), labels, ["doc_id"])
    return rated.select("doc_id", *(F.col(f"{_P}{c}").alias(c) for c in names))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that pass, with their own columns."""
    return _judged(docs, labels, docs.columns).where(f"{_P}kept").select(*[F.col(f"`{c}`") for c in docs.columns])
