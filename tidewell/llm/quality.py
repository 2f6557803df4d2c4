"""Quality rules with robust multivariate outliers.

Base rules reject a text of fewer than MIN_WORDS words, or with more than MOST_REPEATED
percent of its words in repeated 5-word windows. Every other text becomes a vector of
transformed statistics, and a minimum-covariance-determinant (MCD) estimate of location
and scatter per language and source gives its robust Mahalanobis distance; texts beyond
the cut-off are rejected.

The MCD estimate is the subset of SHARE of a group's rows whose scatter has the least
determinant, found by concentration steps over all rows of all groups: the distances under
the present estimate are counted in fine bins by group, the bins that hold the nearest SHARE
of the group's rows are found, and the moments of exactly those rows make the next estimate.
A step is one aggregation with map-side combine, so a group may hold any share of the rows.
Steps go on until no determinant falls any more (STEPS at most), from several STARTS: the
medians and median absolute deviations, read off bin counts; mean and scatter of all rows;
and those of the half of the rows that lie nearest the medians. The start that ends in the
least determinant stands. Its scatter is widened by the factor that makes it right for
normal data. Statistics are held as whole numbers, so sums don't depend on the order of tasks.

Groups of any size have their own estimate: it is drawn towards that of the language, and
the language's towards that of all rows, as if PRIOR rows of the wider group had been seen
as well; all rows are drawn towards the least spreads in the same way.

Nulls: a null text has no words; a null language or source is a group of its own. Ties
share a bin and are kept or left out together. An empty table gives an empty result.
Repeated rows count as often as they occur. Other columns pass through.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm.common import discard, keep, need_free, sliced, spread_anti

MIN_WORDS = 10
MOST_REPEATED = 20
#: Rows of the wider group that count towards a group's estimate.
PRIOR = 50
STEPS = 20
STARTS = 3
#: Share of a group's rows that a concentration step keeps.
SHARE = 0.75
#: A step counts as a gain if it lowers the logarithm of the determinant by so much.
GAIN = 1e-3
#: Fixed-point units of a statistic.
UNIT = 1000
#: Squared distance beyond which a text is rejected: a chance of 1.5e-7 for a chi-squared variable with 5 degrees.
CUTOFF = 40.0
#: Least spread of a statistic; where the estimate is wider, it decides alone. In most groups the nearest texts have no
#: symbol, repeated line or repeated window at all, so there the least spread is all there is to judge by.
FLOORS = (0.05, 0.04, 0.20, 0.12, 0.40)
#: Variance added in any case, so that a scatter can be inverted.
RIDGE = 1e-4
#: Groups up to which the estimates are broadcast to the rows; beyond, both sides are shuffled.
MOST_GROUPS = 50_000
#: Rejected rows up to which their 32-character keys are broadcast; beyond, both sides are shuffled.
MOST_REJECTED = 200_000

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
DIMS = ("x0", "x1", "x2", "x3", "x4")
_SYMBOLS = b"#*$%&|<>"


def text_stats(text: bytes | None) -> tuple[int, ...]:
    """STATS of a text. Words are `[^\\x20\\x09-\\x0D]+`; lines count if they hold a word."""
    words = text.split() if text else []
    if not words:
        return (0, 0, 0, 0, 0, 0)
    joined = b"".join(words)
    chars = len(joined.decode())
    symbols = len(joined) - len(joined.translate(None, _SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    grams = list(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))
    repeated = 0
    if len(set(grams)) < len(grams):
        counts, reach = Counter(grams), 0
        for i, g in enumerate(grams):
            if counts[g] > 1:
                repeated += i + 5 - max(i, reach)
                reach = i + 5
    return (len(words), chars, symbols, len(lines) - len(set(lines)), repeated, len(lines))


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without its text, with STATS (long) as more columns. Names that are taken are an error."""
    need_free(docs, STATS)
    rest = [c for c in docs.columns if c != text_col]
    source = docs.select(*rest, text_col)

    def run(batches):
        for batch in sliced(batches):
            found = [text_stats(t) for t in batch.column(len(rest)).cast(pa.binary()).to_pylist()]
            columns = zip(*found, strict=True) if found else [()] * len(STATS)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], *(pa.array(c, pa.int64()) for c in columns)], names=[*rest, *STATS])

    return source.mapInArrow(run, T.StructType([*source.schema.fields[:-1], *(T.StructField(c, T.LongType()) for c in STATS)]))


def vectors(stats: DataFrame) -> DataFrame:
    """stats with base_failed and the transformed statistics DIMS, in fixed-point units."""
    ratio = lambda a, b: F.asin(F.sqrt(F.least(F.lit(1.0), F.col(a) / F.greatest(F.col(b), F.lit(1)))))
    fixed = lambda x: F.round(x * UNIT).cast("long")
    return (
        stats.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))
        .withColumn("x0", fixed(F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1)))))
        .withColumn("x1", fixed(ratio("n_symbols", "word_chars")))
        .withColumn("x2", fixed(ratio("n_dup_lines", "n_lines")))
        .withColumn("x3", fixed(ratio("n_repeat_words", "n_words")))
        .withColumn("x4", fixed(F.log1p("n_words")))
    )


def chi_squared(x: float, degrees: int) -> float:
    """Chance that a chi-squared variable is at most x, by the series of the incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, y = degrees / 2, x / 2
    term = total = 1 / a
    for k in range(1, 500):
        term *= y / (a + k)
        total += term
        if term < total * 1e-16:
            break
    return total * math.exp(a * math.log(y) - y - math.lgamma(a))


def consistency(share: float, degrees: int) -> float:
    """What the scatter of the nearest share of normal rows is to be multiplied by (Croux and Haesbroeck 1999)."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_squared(middle, degrees) < share else (low, middle)
    return share / chi_squared(low, degrees + 2)


_GROUP = ("level", "g1", "g2")
_ESTIMATE = T.StructType(
    [T.StructField("level", T.IntegerType()), T.StructField("g1", T.StringType()), T.StructField("g2", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("rows", T.LongType())]
    + [T.StructField("n", T.LongType()), T.StructField("logdet", T.DoubleType()), T.StructField("centre", T.ArrayType(T.DoubleType())), T.StructField("scatter", T.ArrayType(T.DoubleType())), T.StructField("inverse", T.ArrayType(T.DoubleType()))]
)


def _levels(rows: DataFrame) -> DataFrame:
    """Each row once for its source's group, its language's and that of all rows; a null is its own value."""
    levels = F.array(
        F.struct(F.lit(0).alias("level"), _text("lang").alias("g1"), _text("source").alias("g2")),
        F.struct(F.lit(1).alias("level"), _text("lang").alias("g1"), F.lit("").alias("g2")),
        F.struct(F.lit(2).alias("level"), F.lit("").alias("g1"), F.lit("").alias("g2")),
    )
    return rows.select(F.explode(levels).alias("g"), *DIMS).select("g.*", *DIMS)


def _floored(scatter: np.ndarray) -> np.ndarray:
    """scatter with at least the least spreads and the ridge on its diagonal."""
    return scatter + np.diag(np.maximum(np.square(FLOORS) - np.diag(scatter), RIDGE))


def _solve(moments: DataFrame) -> DataFrame:
    """Estimates from rows (group, start, rows, n, sums, products), in units of 1; scatter is that of the n rows, inverse that of the widened and floored one."""
    d, factor = len(DIMS), consistency(SHARE, len(DIMS))

    def run(batches):
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            found = []
            for n, sums, products in zip(*cols[5:], strict=True):
                mean = np.array(sums, float) / max(n, 1)
                scatter = np.zeros((d, d))
                scatter[np.triu_indices(d)] = np.array(products, float) / max(n, 1)
                scatter = (scatter + np.triu(scatter, 1).T - np.outer(mean, mean)) / (UNIT * UNIT)
                whole = _floored(scatter * factor)
                found.append((float(np.linalg.slogdet(whole)[1]), (mean / UNIT).tolist(), scatter.ravel().tolist(), np.linalg.inv(whole).ravel().tolist()))
            logdet, centre, scatter, inverse = zip(*found, strict=True) if found else ((), (), (), ())
            listed = lambda x: pa.array(x, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(logdet, pa.float64()), listed(centre), listed(scatter), listed(inverse)], names=_ESTIMATE.names)

    return moments.mapInArrow(run, _ESTIMATE)


def drawn(own: tuple[int, np.ndarray, np.ndarray], wider: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Centre and scatter of a group of so many rows, with PRIOR rows of the wider group counted in."""
    n, centre, scatter = own
    w = n / (n + PRIOR)
    off = centre - wider[0]
    return w * centre + (1 - w) * wider[0], w * scatter + (1 - w) * wider[1] + w * (1 - w) * np.outer(off, off)


def _drawn(best: DataFrame) -> DataFrame:
    """(level, g1, g2, centre, inverse) of the best estimates, each drawn towards the wider one: a row a group, joined level by level."""
    d, factor = len(DIMS), consistency(SHARE, len(DIMS))
    kind = "level int, g1 string, g2 string, centre array<double>, scatter array<double>, inverse array<double>"

    def run(batches):
        for batch in batches:
            rows = []
            for level, g1, g2, n, centre, scatter, wide_centre, wide_scatter in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                centre, scatter = np.array(centre), np.array(scatter).reshape(d, d) * factor
                wider = (centre, np.diag(np.square(FLOORS))) if wide_centre is None else (np.array(wide_centre), np.array(wide_scatter).reshape(d, d))
                centre, scatter = drawn((n, centre, scatter), wider)
                rows.append((level, g1, g2, centre.tolist(), scatter.ravel().tolist(), np.linalg.inv(_floored(scatter)).ravel().tolist()))
            kinds = (pa.int32(), pa.string(), pa.string(), *[pa.list_(pa.float64())] * 3)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 6, kinds, strict=True)], names=["level", "g1", "g2", "centre", "scatter", "inverse"])

    blank = F.lit(None).cast("array<double>")
    out = wider = None
    for level in (2, 1, 0):
        own = best.where(F.col("level") == level).select("level", "g1", "g2", "rows", "centre", "scatter")
        if wider is None:
            both = own.select("*", blank.alias("wc"), blank.alias("ws"))
        else:
            above = wider.select(F.col("g1").alias("up"), F.col("centre").alias("wc"), F.col("scatter").alias("ws"))
            both = own.join(above, (F.col("up") == F.lit("")) if level == 1 else (F.col("up") == F.col("g1")), "left").drop("up")
        wider = keep(both.mapInArrow(run, kind), "quality-drawn")
        out = wider if out is None else out.unionByName(wider)
    return out


def _distance() -> Column:
    """Squared Mahalanobis distance of DIMS under columns centre and inverse."""
    d, total = len(DIMS), F.lit(0.0)
    off = [F.col(x) / UNIT - F.element_at("centre", i + 1) for i, x in enumerate(DIMS)]
    for i in range(d):
        for j in range(d):
            total = total + off[i] * off[j] * F.element_at("inverse", i * d + j + 1)
    return total


def _met(rows: DataFrame, estimates: DataFrame, n: int) -> DataFrame:
    """rows with their group's estimates: by broadcast if there are few groups, else by a join on group and salt."""
    if n <= MOST_GROUPS:
        return rows.join(F.broadcast(estimates), [*_GROUP])
    salts = 16
    spread = estimates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(*DIMS), F.lit(salts)).cast("int")).join(spread, [*_GROUP, "salt"]).drop("salt")


def _start(levels: DataFrame) -> DataFrame:
    """(group, rows, centre, inverse): medians and median absolute deviations of each statistic by group, from exact counts of values."""
    long = levels.select(*_GROUP, F.explode(F.array(*[F.struct(F.lit(i).alias("dim"), F.col(x).alias("v")) for i, x in enumerate(DIMS)])).alias("s")).select(*_GROUP, "s.*")

    def middle(counted: DataFrame, out: str) -> DataFrame:
        # A bin is 0.01 wide, so a group has at most some hundred bins a statistic, whatever its rows.
        bins = counted.groupBy(*_GROUP, "dim", "v").agg(F.sum("n").alias("n"))
        listed = bins.groupBy(*_GROUP, "dim").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("v", "n"))).alias("bins"))
        half = F.ceil(F.col("n") / 2)
        passed = F.aggregate("bins", F.struct(F.lit(0).cast("long").alias("sum"), F.lit(None).cast("long").alias("at")), lambda a, b: F.struct((a["sum"] + b["n"]).alias("sum"), F.when(a["at"].isNotNull(), a["at"]).when(a["sum"] + b["n"] >= half, b["v"]).alias("at")))
        return listed.select(*_GROUP, "dim", "n", passed["at"].alias(out))

    width = UNIT // 100
    counts = keep(long.withColumn("v", F.floor(F.col("v") / width) * width).groupBy(*_GROUP, "dim", "v").agg(F.count("*").alias("n")), "quality-bins")
    medians = middle(counts, "median")
    away = counts.join(medians.drop("n"), [*_GROUP, "dim"]).withColumn("v", F.abs(F.col("v") - F.col("median")))
    spread = middle(away, "mad").withColumnRenamed("n", "rows")
    d = len(DIMS)
    both = spread.join(medians.drop("n"), [*_GROUP, "dim"]).groupBy(*_GROUP).agg(F.max("rows").alias("rows"), F.array_sort(F.collect_list(F.struct("dim", "median", "mad"))).alias("s"))
    floor = F.array(*[F.lit(f) for f in FLOORS])
    one = lambda i: 1 / F.pow(F.greatest(1.4826 * F.col("s")[i]["mad"] / UNIT, floor[i]), F.lit(2))
    return both.select(*_GROUP, "rows", F.transform("s", lambda x: x["median"] / F.lit(float(UNIT))).alias("centre"), F.array(*[one(i) if i == j else F.lit(0.0) for i in range(d) for j in range(d)]).alias("inverse"))


_PAIRS = [(i, j) for i in range(len(DIMS)) for j in range(i, len(DIMS))]


def _binned(met: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rows, bins): counts and moments by bin of distance, a bin 1/32 of a doubling wide, in order."""
    far = met.withColumn("bin", F.floor(F.log2(_distance() + F.lit(2.0**-10)) * 32).cast("int"))
    bins = far.groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.max("rows").alias("rows"), *[F.sum(x).alias(x) for x in DIMS], *[F.sum(F.col(DIMS[i]) * F.col(DIMS[j])).alias(f"p{i}{j}") for i, j in _PAIRS])
    # The bins of a group are bounded in number; running counts find those of the nearest rows.
    return bins.groupBy(*keys).agg(F.max("rows").alias("rows"), F.array_sort(F.collect_list(F.struct("bin", "n", F.array(*DIMS).alias("s"), F.array(*[f"p{i}{j}" for i, j in _PAIRS]).alias("p")))).alias("bins"))


def _nearest(share: float) -> Column:
    """Number and moments of the rows in the nearest bins, whole, until they hold the share."""
    zero = lambda k: F.array_repeat(F.lit(0).cast("long"), k)
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    return F.aggregate(
        "bins",
        F.struct(F.lit(0).cast("long").alias("n"), zero(len(DIMS)).alias("s"), zero(len(_PAIRS)).alias("p")),
        lambda a, b: F.when(a["n"] >= F.col("rows") * share, a).otherwise(F.struct((a["n"] + b["n"]).alias("n"), add(a["s"], b["s"]).alias("s"), add(a["p"], b["p"]).alias("p"))),
    )


def estimates(rows: DataFrame) -> tuple[DataFrame, int]:
    """MCD estimates (level, g1, g2, centre, inverse) of rows (lang, source, DIMS), and the number of groups."""
    levels = _levels(rows)
    medians = keep(_start(levels), "quality-medians")
    n = medians.count()
    # Starts: the medians' own estimate, the half of the rows nearest them, and all rows.
    held = keep(_binned(_met(levels, medians, n), [*_GROUP]), "quality-held")
    told = [held.select(*_GROUP, F.lit(k).alias("start"), "rows", _nearest(share).alias("m")) for k, share in enumerate((SHARE, 0.5, 1.0))][:STARTS]
    moments = told[0]
    for more in told[1:]:
        moments = moments.unionByName(more)
    now = keep(_solve(moments.select(*_GROUP, "start", "rows", "m.n", "m.s", "m.p")), "quality-step")
    for step in range(STEPS):
        stepped = _binned(_met(levels, now.select(*_GROUP, "start", "rows", "centre", "inverse"), n), [*_GROUP, "start"]).select(*_GROUP, "start", "rows", _nearest(SHARE).alias("m"))
        new = _solve(stepped.select(*_GROUP, "start", "rows", "m.n", "m.s", "m.p"))
        before = now.select(*_GROUP, "start", F.col("logdet").alias("before"), F.struct("rows", "n", "logdet", "centre", "scatter", "inverse").alias("old"))
        # A step that does not lower the determinant ends that start's search. The first one is taken in any case, as not all starts hold SHARE.
        fell = F.col("logdet") < F.col("before") - GAIN if step else F.lit(True)
        took = keep(new.join(before, [*_GROUP, "start"]).select(*_GROUP, "start", fell.alias("moved"), F.struct("rows", "n", "logdet", "centre", "scatter", "inverse").alias("new"), "old"), "quality-step")
        past, now = now, took.select(*_GROUP, "start", F.when(F.col("moved"), F.col("new")).otherwise(F.col("old")).alias("e")).select(*_GROUP, "start", "e.*")
        if hasattr(past, "kept_path"):
            discard(past)
        now.kept_path = took.kept_path
        if not took.where("moved").limit(1).count():
            break
    best = now.groupBy(*_GROUP).agg(F.min_by(F.struct("rows", "centre", "scatter"), F.struct("logdet", "start")).alias("e")).select(*_GROUP, "e.*")
    out = _drawn(keep(best, "quality-best"))
    return out, n


def _text(name: str) -> Column:
    """A column as text in which a null differs from any value."""
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit("null"))


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Per row of docs: doc_id, key (of the whole row), STATS, base_failed, distance (squared, null if unknown) and kept."""
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    named = named.withColumn("key", row_key("doc_id", "text", "lang", "source"))
    stats = keep(vectors(statistics(named)), "quality-stats")
    now, n = estimates(stats.where("not base_failed").select("lang", "source", *DIMS))
    # A group without an estimate has no row that passes the base rules.
    side = now.where("level = 0").select("g1", "g2", "centre", "inverse")
    if n <= MOST_GROUPS:
        best = stats.withColumn("g1", _text("lang")).withColumn("g2", _text("source")).join(F.broadcast(side), ["g1", "g2"], "left").drop("g1", "g2")
    else:
        spread = side.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
        best = stats.withColumn("g1", _text("lang")).withColumn("g2", _text("source")).withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(16)).cast("int")).join(spread, ["g1", "g2", "salt"], "left").drop("g1", "g2", "salt")
    judged = best.withColumn("distance", F.when(F.col("centre").isNotNull(), _distance()))
    return judged.select("doc_id", "key", *STATS, "base_failed", "distance", (~F.col("base_failed") & F.coalesce(F.col("distance") <= CUTOFF, F.lit(True))).alias("kept"))


def row_key(*names: str) -> Column:
    return F.md5(F.concat_ws("\u0000", *[_text(c) for c in names]))


def filter_docs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """docs without the rejected rows, columns as they were."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    own = [f"c{names.index(c)}" for c in (id_col, text_col, lang_col, source_col)]
    rejected = keep(assess(plain, *own).where("not kept").select("key").distinct(), "quality-rejected")
    return spread_anti(plain.withColumn("__key", row_key(*own)), rejected, "__key", rejected.count(), MOST_REJECTED).drop("__key").toDF(*names)
