"""Quality rules by robust multivariate outliers, in DataFrame operations only.

Texts become a few counts, then a vector of transformed shares. For each language and source the minimum covariance determinant
is looked for: of all subsets of h documents, the one whose covariance has the least determinant gives location and scatter.
Three robust starts (scales of the coordinates alone, covariance of spatial signs, covariance of squashed deviations) each take
two concentration steps: the h documents nearest by Mahalanobis distance give the next mean and covariance, which can only lower
the determinant. The start with the least determinant goes on until no group's determinant falls any more. A document is
rejected if its distance from its group's estimate is beyond a quantile of the chi-square distribution.

Shares of short texts scatter more, so a document's deviations are scaled by sqrt(n_words / (n_words + STEADY)). Scatter has a
floor, so a coordinate that never varies in a group neither breaks the inverse nor rejects a document for one rare sign; it
also serves groups of any size: h is all of a group of up to 7 documents, and one alone is its own centre and stays.

Medians and the h nearest are found on fixed grids, from counts of documents by cell: they don't depend on how the rows are
dealt, and a group's counts are summed before they are shuffled. Rows of a group are dealt over SALTS keys where they meet
their estimate, so a group that holds a third of all rows is no one task's.

Rows: a null or empty text has no words and fails the base rules; texts of any length are counted whole; null languages and
sources are groups of their own; repeated rows and null doc_ids are judged each; other columns are not read; an empty table
gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import finished, table, written

#: Words at which a text's own sampling scatter equals the scatter between texts.
STEADY = 150.0
#: Share of a group that the estimate rests on; steps of every start, and of the best one at most; fall of the logarithm of a
#: determinant that counts as none; probability with which a document of its group would be rejected if all were normal.
SHARE, FIRST, STEPS, SETTLED, TAIL = 0.75, 2, 20, 1e-4, 1e-9
#: Keys that rows of a group are dealt to; cells of the grids to a unit, of coordinates and of logarithms of distances.
SALTS, CELLS, LOG_CELLS = 64, 1000, 200
#: The vector's coordinates and the least standard deviation of each.
FLOORS = {"v_length": 0.08, "v_symbols": 0.02, "v_marks": 0.03, "v_upper": 0.05, "v_repeats": 0.08, "v_lines": 0.08}
_SPACE = "[\\x20\\x09-\\x0D]+"


def counts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """docs(keep..., text) as keep... and the counts of each text.

    Every step refers to the arrays of the one before more than once, so Spark evaluates each array once a row.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    one = docs.select(*keep, text.alias("_t"))
    two = one.select(*keep, F.filter(F.split("_t", _SPACE), lambda w: w != "").alias("_w"), F.split("_t", "\n").alias("_l"), F.regexp_replace("_t", r"[^!-/:-@\[-`{-~A-Z]+", "").alias("_m"))
    lines = F.filter("_l", lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    three = two.select(
        *keep, F.size("_w").cast("long").alias("n_words"), F.length(F.array_join("_w", "")).cast("long").alias("word_chars"), lines.alias("_l"),
        F.length(F.regexp_replace("_m", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"), F.length("_m").alias("_marked"), F.length(F.regexp_replace("_m", "[^A-Z]+", "")).cast("long").alias("n_upper"),
        F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"),
    )
    windows = F.transform("_h", lambda x, i: F.xxhash64(x, *(F.get("_h", i + k) for k in range(1, 5))))
    four = three.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_upper", (F.col("_marked") - F.col("n_upper")).alias("n_marks"),
        F.size("_l").cast("long").alias("n_lines"), (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("_h") >= 5, F.slice(windows, F.lit(1), F.size("_h") - 4)).otherwise(F.array().cast("array<bigint>")).alias("_g"),
    )
    done = [*keep, "n_words", "word_chars", "n_symbols", "n_upper", "n_marks", "n_lines", "n_dup_lines"]
    # windows that occur again: sorted with their places, equal neighbours; then the words that their places cover
    again = F.size(F.array_distinct("_g")) < F.size("_g")
    five = four.select(*done, F.when(again, F.array_sort(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_s"))
    twin = lambda x, k: F.when((x["h"] == F.get("_s", k - 1)["h"]) | (x["h"] == F.get("_s", k + 1)["h"]), x["i"])
    six = five.select(*done, F.size("_s").alias("_n"), F.array_sort(F.filter(F.transform("_s", twin), lambda x: x.isNotNull())).alias("_p"))
    covered = F.aggregate(F.transform("_p", lambda x, k: F.least(F.lit(5), F.coalesce(F.get("_p", k + 1) - x, F.lit(5)))), F.lit(0), lambda a, x: a + x)
    return six.select(*done, F.when(F.size("_p") > 0, covered).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"))


def vector() -> dict[str, Column]:
    """The transformed statistics; square roots steady the scatter of shares."""
    share = lambda a, b: F.sqrt(F.col(a) / F.greatest(F.col(b), F.lit(1)))
    return {
        "v_length": F.log((F.col("word_chars") + 5.0) / (F.col("n_words") + 1.0)),
        "v_symbols": share("n_symbols", "word_chars"),
        "v_marks": share("n_marks", "word_chars"),
        "v_upper": share("n_upper", "word_chars"),
        "v_repeats": share("n_repeat_words", "n_words"),
        "v_lines": share("n_dup_lines", "n_lines"),
    }


def chi_square(x: float, k: int) -> float:
    """Its distribution function, by the series of the incomplete gamma function."""
    a, s = k / 2, x / 2
    term = total = 1 / a
    for i in range(1, 500):
        term *= s / (a + i)
        total += term
    return total * math.exp(-s + a * math.log(s) - math.lgamma(a)) if x > 0 else 0.0


def consistency(share: float, k: int) -> float:
    """Factor by which the covariance of the nearest share of normal data falls short."""
    lo, hi = 0.0, 1000.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square(mid, k) < share else (lo, mid)
    return share / chi_square(lo, k + 2)


def cutoff(tail: float, k: int) -> float:
    """The value that a chi-square variable exceeds with probability tail."""
    lo, hi = 0.0, 1000.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - chi_square(mid, k) > tail else (lo, mid)
    return hi


def _inverse(matrix: Column, k: int) -> Column:
    """Of a symmetric positive definite matrix, its inverse and the logarithm of its determinant, by Gauss-Jordan elimination
    beside the identity."""
    wide = F.transform(matrix, lambda row, i: F.concat(row, F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.when(i == j, F.lit(1.0)).otherwise(F.lit(0.0)))))
    start = F.struct(wide.cast("array<array<double>>").alias("m"), F.lit(0.0).alias("d"))

    def step(s: Column, p: Column) -> Column:
        m, pivot = s["m"], F.get(F.get(s["m"], p), p)
        lead = F.transform(F.get(m, p), lambda x: x / pivot)
        return F.struct(F.transform(m, lambda row, i: F.when(i == p, lead).otherwise(F.zip_with(row, lead, lambda x, y: x - F.get(row, p) * y))).cast("array<array<double>>").alias("m"), (s["d"] + F.log(pivot)).alias("d"))

    solved = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), start, step)
    return F.struct(F.transform(solved["m"], lambda row: F.slice(row, k + 1, k)).alias("inv"), solved["d"].alias("logdet"))


def _distance(names: list[str], model: Column) -> Column:
    """Squared Mahalanobis distance of the length-scaled deviations from the model's mean, under its inverse scatter."""
    dev = [F.col(n) - F.get(model["mean"], F.lit(i)) for i, n in enumerate(names)]
    terms = [F.get(F.get(model["inv"], F.lit(i)), F.lit(j)) * dev[i] * dev[j] * (1.0 if i == j else 2.0) for i in range(len(names)) for j in range(i, len(names))]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total * F.col("_weight")


def _beside(rows: DataFrame, models: DataFrame) -> DataFrame:
    """rows(_group, ...) with the columns of models(_group, ...), a row a group. Spark broadcasts models if they are small;
    otherwise rows of one group go to SALTS tasks, and its model to each."""
    dealt = models.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")  # rows of a partition in turn
    return rows.withColumn("_salt", salt).join(dealt, ["_group", "_salt"]).drop("_salt")


def _at(rows: DataFrame, keys: list[str], cell: str, rank: Column) -> DataFrame:
    """(keys..., cell): the least cell up to which rows(keys..., cell) are rank or more. Counts are summed in the tasks first; a
    group has as many as its grid has cells in use."""
    n = rows.groupBy(*keys, cell).agg(F.count("*").alias("_k"))
    cells = n.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(cell).alias("c"), F.col("_k").alias("k")))).alias("_cells"), F.sum("_k").alias("_n"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("c"))
    step = lambda s, x: F.struct((s["n"] + x["k"]).alias("n"), F.when(s["c"].isNull() & (s["n"] + x["k"] >= rank), x["c"].cast("long")).otherwise(s["c"]).alias("c"))
    return cells.select(*keys, F.aggregate("_cells", start, step)["c"].alias(cell))


def _sums(names: list[str]) -> list[Column]:
    """Weighted moments of the coordinates."""
    k = len(names)
    value, weight = [F.col(n) for n in names], F.col("_weight")
    return [
        F.count("*").alias("_k"), F.sum(weight).alias("_w"), *(F.sum(weight * v).alias(f"_s{i}") for i, v in enumerate(value)),
        *(F.sum(weight * value[i] * value[j]).alias(f"_q{i}_{j}") for i in range(k) for j in range(i, k)),
    ]


def _estimate(names: list[str], floors: dict[str, float], factor: Column) -> Column:
    """(mean, inv, logdet) from _sums: covariance about the mean, made consistent by factor, with the floors added."""
    k = len(names)
    mean = [F.try_divide(F.col(f"_s{i}"), F.col("_w")) for i in range(k)]

    def entry(i: int, j: int) -> Column:
        a, b = min(i, j), max(i, j)
        cov = (F.col(f"_q{a}_{b}") - F.col("_w") * mean[a] * mean[b]) / F.col("_k") * factor
        return F.greatest(cov, F.lit(0.0)) + floors[names[i]] ** 2 if i == j else cov

    solved = _inverse(F.array(*(F.array(*(entry(i, j) for j in range(k))) for i in range(k))), k)
    return F.struct(F.array(*mean).alias("mean"), solved["inv"].alias("inv"), solved["logdet"].alias("logdet"))


def _starts(vectors: DataFrame, floors: dict[str, float]) -> DataFrame:
    """(_group, _start, _model) of the three robust starts, a row each."""
    names, k = list(floors), len(floors)
    middle = F.floor((F.col("_n") + 1) / 2)

    def medians(rows: DataFrame, values: list[Column]) -> DataFrame:
        long = rows.select("_group", F.posexplode(F.array(*(F.floor(v * CELLS).cast("long") for v in values))).alias("_i", "_c"))
        at = _at(long, ["_group", "_i"], "_c", middle)
        return at.groupBy("_group").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_c"))), lambda x: (x["_c"] + 0.5) / CELLS).alias("_m"))

    centre = written(medians(vectors, [F.col(c) for c in names]), "mcd")
    dev = lambda i, c: (F.col(c) - F.get("_m", F.lit(i))) * F.sqrt("_weight")
    scale = medians(_beside(vectors, centre), [F.abs(dev(i, c)) for i, c in enumerate(names)]).withColumnRenamed("_m", "_mad")
    spread = F.array(*(F.sqrt((1.4826 * F.get("_mad", F.lit(i))) ** 2 + floors[c] ** 2) for i, c in enumerate(names)))
    known = written(centre.join(scale, "_group").select("_group", "_m", spread.alias("_spread")), "mcd")
    width = [F.get("_spread", F.lit(i)) for i in range(k)]
    scaled = _beside(vectors, known).select("_group", F.array(*(dev(i, c) / width[i] for i, c in enumerate(names))).alias("_z"))
    # spatial signs, and deviations that are squashed one by one
    norm = F.sqrt(F.aggregate("_z", F.lit(1e-9), lambda a, x: a + x * x))
    turned = scaled.select("_group", F.posexplode(F.array(F.transform("_z", lambda x: x / norm), F.transform("_z", lambda x: F.tanh(x)))).alias("_start", "_u"))
    u = [F.get("_u", F.lit(i)) for i in range(k)]
    moments = turned.groupBy("_group", "_start").agg(*(F.sum(u[i] * u[j]).alias(f"_q{i}_{j}") for i in range(k) for j in range(i, k)))

    def entry(i: int, j: int) -> Column:
        """Scales of the coordinates, turned by the correlation of the transformed deviations."""
        if i == j:
            return width[i] ** 2
        q = lambda a, b: F.col(f"_q{min(a, b)}_{max(a, b)}")
        return F.coalesce(0.9 * F.try_divide(q(i, j), F.sqrt(q(i, i) * q(j, j))), F.lit(0.0)) * width[i] * width[j]

    alone = known.select("_group", F.lit(2).alias("_start"), "_m", F.array(*(F.array(*(width[i] ** 2 if i == j else F.lit(0.0) for j in range(k))) for i in range(k))).alias("_cov"))
    both = moments.join(known, "_group").select("_group", "_start", "_m", F.array(*(F.array(*(entry(i, j) for j in range(k))) for i in range(k))).alias("_cov"))
    solved = both.unionByName(alone).select("_group", "_start", "_m", _inverse(F.col("_cov"), k).alias("_s"))
    out = written(solved.select("_group", "_start", F.struct(F.col("_m").alias("mean"), F.col("_s.inv").alias("inv"), F.col("_s.logdet").alias("logdet")).alias("_model")), "mcd")
    finished(centre, known)
    return out


def estimates(vectors: DataFrame, floors: dict[str, float], share: float = SHARE, first: int = FIRST, steps: int = STEPS) -> DataFrame:
    """vectors(_group, _weight, coordinates v_...) as (_group, _n, _h, _model): one robust estimate of location and inverse scatter
    a group. No group is gathered. Starts are rows, so one plan of one size serves any number of them, and every step runs the
    same code."""
    names, k = list(floors), len(floors)
    n = F.col("_n")
    half = F.least(n, F.greatest(F.ceil(n * share), F.floor((n + k + 1) / 2))).cast("long")
    sizes = vectors.groupBy("_group").agg(F.count("*").alias("_n")).withColumn("_h", half)
    starts = _starts(vectors, floors)
    never = F.lit(float("inf"))
    now = written(starts.join(sizes, "_group").select("_group", "_start", "_n", "_h", "_model", never.alias("_least"), F.col("_model").alias("_kept"), never.alias("_fall")), "mcd")
    finished(starts)
    factor = F.when(F.col("_h") < F.col("_n"), F.lit(consistency(share, k))).otherwise(1.0)
    cell = F.floor(F.log(F.greatest(_distance(names, F.col("_model")), F.lit(1e-12))) * LOG_CELLS).cast("long")

    def concentrate(now: DataFrame) -> DataFrame:
        far = _beside(vectors, now).select("_group", "_start", "_h", cell.alias("_c"))
        cut = _at(far, ["_group", "_start", "_h"], "_c", F.col("_h")).select("_group", "_start", F.col("_c").alias("_cut"))
        cuts = written(now.join(cut, ["_group", "_start"]), "mcd")
        sums = _beside(vectors, cuts).where(cell <= F.col("_cut")).groupBy("_group", "_start").agg(*_sums(names))
        was = now.select("_group", "_start", "_n", "_h", "_least", "_kept")
        made = sums.join(was, ["_group", "_start"]).select("_group", "_start", "_n", "_h", _estimate(names, floors, factor).alias("_model"), "_least", "_kept")
        new = F.col("_model.logdet")
        # on a grid a step may raise a determinant a little, so the least one is kept
        out = written(made.select("_group", "_start", "_n", "_h", "_model", F.least("_least", new).alias("_least"), F.when(new < F.col("_least"), F.col("_model")).otherwise(F.col("_kept")).alias("_kept"), (F.col("_least") - new).alias("_fall")), "mcd")
        finished(cuts, now)
        return out

    for _ in range(first):
        now = concentrate(now)
    best = F.min_by(F.struct("_start", "_n", "_h", "_model", "_least", "_kept", "_fall"), F.struct("_least", "_start")).alias("_b")
    best = written(now.groupBy("_group").agg(best).select("_group", "_b.*"), "mcd")
    finished(now)
    for _ in range(steps):
        best = concentrate(best)
        fall = best.agg(F.max("_fall")).first()[0]
        if fall is None or fall <= SETTLED:
            break
    return best.select("_group", "_n", "_h", F.col("_kept").alias("_model"))


def group_key() -> Column:
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    return F.concat(name("lang"), F.lit("\x00"), name("source"))


def statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """docs(keep..., text, lang, source) as keep..., the group's key, the counts, the vector and its weight."""
    own = docs.select(*keep, "text", group_key().alias("_group"))
    return counts(own, [*keep, "_group"]).select("*", *(c.alias(n) for n, c in vector().items()), (F.col("n_words") / (F.col("n_words") + STEADY)).alias("_weight"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def fitted(stats: DataFrame) -> DataFrame:
    """(_group, _model): the estimates of documents that pass the base rules; what those reject can't shift them."""
    return estimates(stats.where(~base_failed()).select("_group", "_weight", *FLOORS), FLOORS).select("_group", "_model")


def verdicts(stats: DataFrame, models: DataFrame, tail: float = TAIL) -> DataFrame:
    """stats with base_failed, distance and kept. A group all of whose documents fail the base rules has no estimate."""
    every = stats.select("_group").distinct().join(models, "_group", "left")
    judged = _beside(stats, every).select("*", base_failed().alias("base_failed"), F.coalesce(_distance(list(FLOORS), F.col("_model")), F.lit(0.0)).alias("distance"))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("distance") <= cutoff(tail, len(FLOORS))))


def judge(docs: DataFrame, keep: list[str], tail: float = TAIL) -> DataFrame:
    """docs(keep..., text, lang, source) as keep..., the counts, base_failed, kept and distance."""
    held = [f"_k{i}" for i in range(len(keep))]
    own = docs.select(*(F.col(c).alias(h) for c, h in zip(keep, held)), "text", "lang", "source")
    stats = written(statistics(own, held), "quality")
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance"]
    return verdicts(stats, fitted(stats), tail).select(*(F.col(h).alias(c) for c, h in zip(keep, held)), *columns)


def clean(docs: DataFrame, tail: float = TAIL) -> DataFrame:
    """The documents that are kept, with all their columns. Texts are counted once and written beside their counts; the estimates
    read the counts only."""
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), "text", "lang", "source")
    stats = written(statistics(whole, ["_row"]).select("_row", "_group", "n_words", "n_repeat_words", "_weight", *FLOORS), "quality")
    return verdicts(stats, fitted(stats), tail).where("kept").select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: every document's counts and verdict."""
    return judge(table(spark, sf_dir, "documents"), ["doc_id"])


