"""Quality rules by robust multivariate outliers, in DataFrame functions only.

Each text gives a vector of transformed statistics: log(1 + words), log of the mean word length, and the square roots of the
share of symbols and of the share of words in repeated three-word windows. For each language and source the minimum
covariance determinant is approached by concentration steps over half of the group (h = (n + 5) / 2): from each of three
starts, at the median and at the quantiles that are the median if a third of the group is junk above or below, the nearest rows
by Mahalanobis distance give a mean and a covariance, which give the next distances, until the determinant stops falling. The
start with the least determinant counts, and all rows within its 0.99 quantile give the last mean and covariance. A row is rejected if its distance is beyond CUTOFF, the 0.99999 quantile of
chi-square with 4 degrees. The covariance is multiplied by the consistency factor for half; a variance below the square of its
floor is raised to it, so statistics that hardly vary in a group don't reject ordinary texts.

Rows with one and the same vector count once in the estimate, and each is judged: a point that holds a third of the rows would
else make the least determinant the one around it. Distances are cut at whole bins of a fixed grid, so the subsets don't depend
on how rows are dealt to tasks. Groups below LEAST_ROWS different vectors are judged by the estimate of their whole language,
and languages below it by that of all rows; if those are too few as well, the method keeps the row.

Defined results: a null text has no words and fails the base rule; null languages and sources are groups of their own;
repeated rows are judged each time. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from rasterloom.llm.common import SPACE_CHARS, materialize

SYMBOLS = "#*$%&|<>"
DIMENSIONS = ("x0", "x1", "x2", "x3")
LEAST_ROWS = 50
#: Chi-square quantiles with 4 degrees (0.99999; consistency factor of half: 0.5 by the share of 6 degrees below the median of 4).
CUTOFF, CONSISTENCY = 28.47, 2.11
#: The quantile of 0.99 within which rows count in the end, and the consistency factor of what it leaves out.
WITHIN, WITHIN_CONSISTENCY = 13.28, 1.03
#: A determinant that falls by less, in logarithms, has stopped falling.
FALL = 1e-3
#: The group of all rows; no other name is without brackets.
ALL_ROWS = "all"
#: Groups up to which tables of one row a group are broadcast; beyond it, joins on the group shuffle.
BROADCAST_GROUPS = 50_000
#: Standard deviations below which a statistic's spread isn't told from none.
FLOORS = (0.35, 0.1, 0.08, 0.09)
#: Centre and quartiles of each start: of all rows, and without a third above or below.
STARTS = ((1 / 2, 1 / 4, 3 / 4), (1 / 3, 1 / 6, 1 / 2), (2 / 3, 1 / 2, 5 / 6))


def base_statistics(docs: DataFrame, *, id_col: str, text_col: str, group_cols: list[str]) -> DataFrame:
    """id, the group columns, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), *[F.col(c).alias(f"g{k}") for k, c in enumerate(group_cols)], text.alias("text"))
    flat = F.trim(F.translate("text", SPACE_CHARS, " " * len(SPACE_CHARS)))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.translate(x, SPACE_CHARS, "") != "")
    groups = [f"g{k}" for k in range(len(group_cols))]
    rows = rows.select(
        "id",
        *groups,
        F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " +")).alias("words"),
        F.length(F.translate("text", SPACE_CHARS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
    )
    windows = F.when(F.size("words") >= 3, F.transform(F.sequence(F.lit(0), F.size("words") - 3), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)))).otherwise(F.array().cast("array<long>"))
    rows = rows.select("id", *groups, F.size("words").cast("long").alias("n_words"), "word_chars", "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), windows.alias("w"))
    # only texts with a repeated window sort their windows, with positions
    some = F.size(F.array_distinct("w")) < F.size("w")
    rows = rows.withColumn("s", F.when(some, F.sort_array(F.transform("w", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    twice = F.filter("s", lambda e, j: F.get("s", j - 1)["x"].eqNullSafe(e["x"]) | F.get("s", j + 1)["x"].eqNullSafe(e["x"]))
    covered = F.size(F.array_distinct(F.flatten(F.transform(twice, lambda e: F.array(e["i"], e["i"] + 1, e["i"] + 2)))))
    rows = rows.select("id", *groups, "n_words", "word_chars", "n_symbols", "n_dup_lines", F.when(F.col("s").isNull(), F.lit(0)).otherwise(covered).cast("long").alias("n_repeat_words"))
    return rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _with_vector(rows: DataFrame) -> DataFrame:
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return rows.withColumns({"x0": F.log1p("n_words"), "x1": F.log(chars / n), "x2": F.sqrt(F.col("n_symbols") / chars), "x3": F.sqrt(F.col("n_repeat_words") / n)})


def _quantiles(counted: DataFrame, by: list[str], least: dict[str, Column]) -> DataFrame:
    """From counts per bin: for each number of rows the first bin that reaches it. The bins of a group are as many as the grid has."""
    upto = Window.partitionBy(*by).orderBy("bin")
    cum = counted.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(Window.partitionBy(*by)))
    return cum.groupBy(*by).agg(*[F.min(F.when(F.col("upto") >= n, F.col("bin"))).alias(name) for name, n in least.items()])


def _start(rows: DataFrame) -> DataFrame:
    """Centre and a diagonal covariance for each group and start s, from quantiles on a grid of hundredths."""
    long = rows.select("g", F.posexplode(F.array(*DIMENSIONS)).alias("d", "x")).groupBy("g", "d", F.floor(F.col("x") * 100).alias("bin")).agg(F.count("*").alias("n"))
    q = _quantiles(long, ["g", "d"], {f"q{s}{k}": F.col("all") * (share - 1e-9) for s, shares in enumerate(STARTS) for k, share in enumerate(shares)})
    starts = F.explode(F.array(*[F.struct(F.lit(s).alias("s"), *[F.col(f"q{s}{k}").alias(f"q{k}") for k in range(3)]) for s in range(len(STARTS))]))
    q = q.select("g", "d", starts.alias("start")).select("g", "d", "start.*")
    cols = []
    for k, floor in enumerate(FLOORS):
        this = F.col("d") == k
        cols += [F.max(F.when(this, F.col("q0") / 100 + 0.005)).alias(f"m{k}"), F.max(F.when(this, F.pow(F.greatest((F.col("q2") - F.col("q1")) / 134.9, F.lit(floor)), F.lit(2)))).alias(f"c{k}{k}")]
    start = q.groupBy("g", "s").agg(*cols)
    return start.select("g", "s", *[f"m{k}" for k in range(4)], *[(F.col(f"c{i}{j}") if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i in range(4) for j in range(i + 1)])


def _cholesky(params: DataFrame) -> DataFrame:
    """The lower factor l of each covariance, beside the means. Each column builds on those before it in the one select."""
    steps = []
    for i in range(4):
        for j in range(i + 1):
            rest = " - ".join([f"c{i}{j}", *[f"l{i}{k} * l{j}{k}" for k in range(j)]])
            steps.append((f"sqrt(greatest({rest}, 1e-9D))" if i == j else f"({rest}) / l{j}{j}") + f" AS l{i}{j}")
    return params.selectExpr("*", *steps)


def _distances(rows: DataFrame, params: DataFrame, few: bool) -> DataFrame:
    """rows with d2, the squared Mahalanobis distance by their group's parameters; null where the group has none."""
    of = ["s"] if "s" in params.columns else []
    factors = _cholesky(params).select("g", *of, *[f"m{k}" for k in range(4)], *[f"l{i}{j}" for i in range(4) for j in range(i + 1)])
    joined = rows.join(F.broadcast(factors) if few else factors, "g", "left")
    solved = ["(" + " - ".join([f"x{i} - m{i}", *[f"l{i}{k} * y{k}" for k in range(i)]]) + f") / l{i}{i} AS y{i}" for i in range(4)]
    return joined.selectExpr("*", *solved, "y0 * y0 + y1 * y1 + y2 * y2 + y3 * y3 AS d2").select(*rows.columns, *of, "d2")


def _moments(rows: DataFrame, by: list[str], factor: float) -> DataFrame:
    """Mean and covariance of each group, variances raised to their floors."""
    sums = [F.avg(x).alias(f"m{k}") for k, x in enumerate(DIMENSIONS)]
    for i in range(4):
        for j in range(i + 1):
            c = F.covar_pop(f"x{i}", f"x{j}") * factor
            sums.append((F.greatest(c, F.lit(FLOORS[i] ** 2)) if i == j else c).alias(f"c{i}{j}"))
    return rows.groupBy(*by).agg(*sums)


def _concentrate(rows: DataFrame, params: DataFrame, few: bool) -> DataFrame:
    """One step: mean, covariance and its log determinant of the nearest half of each group, for each of its starts in params."""
    binned = _distances(rows, params, few).where("s is not null").withColumn("bin", F.floor(F.log(F.col("d2") + 0.001) * 100))
    half = F.least(F.col("all"), F.floor((F.col("all") + 5) / 2))
    cut = _quantiles(binned.groupBy("g", "s", "bin").agg(F.count("*").alias("n")), ["g", "s"], {"cut": half})
    near = binned.join(F.broadcast(cut) if few else cut, ["g", "s"]).where("bin <= cut")
    found = _moments(near, ["g", "s"], CONSISTENCY)
    return _cholesky(found).select(*found.columns, (2 * sum(F.log(f"l{i}{i}") for i in range(4))).alias("logdet"))


def _estimate(rows: DataFrame, few: bool) -> DataFrame:
    """The mean and covariance of each group whose determinant is the least that the starts lead to."""
    falling = materialize(_concentrate(rows, _start(rows), few), "quality-parameters")
    reached = falling
    while falling.limit(1).count():
        before = falling.select("g", "s", F.col("logdet").alias("before"))
        step = _concentrate(rows, falling, few).join(before, ["g", "s"]).where(F.col("logdet") < F.col("before") - FALL).drop("before")
        falling = materialize(step, "quality-parameters")
        reached = reached.unionByName(falling)
    names = [c for c in reached.columns if c not in ("g", "s", "logdet")]
    best = reached.groupBy("g").agg(F.min(F.struct("logdet", "s", *names)).alias("best"))
    best = materialize(best.select("g", *[f"best.{c}" for c in names]), "quality-parameters")
    return materialize(_moments(_distances(rows, best, few).where(F.col("d2") <= WITHIN), ["g"], WITHIN_CONSISTENCY), "quality-parameters")


def judge(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", group_cols: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and distance, a row for each row."""
    rows = materialize(_with_vector(base_statistics(docs, id_col=id_col, text_col=text_col, group_cols=list(group_cols))), "quality-statistics")
    name = lambda c: F.when(c.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), c.cast("string")))
    language = name(F.col("g0"))
    own = F.to_json(F.array(language, name(F.col("g1"))))
    rows = rows.withColumn("own", own).withColumn("pool", F.to_json(F.array(language)))
    vectors = materialize(rows.select("own", "pool", *DIMENSIONS).distinct(), "quality-vectors")
    sizes = materialize(vectors.groupBy("own", "pool").agg(F.count("*").alias("own_rows")), "quality-groups")
    few = sizes.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    pools = sizes.groupBy("pool").agg(F.sum("own_rows").alias("pool_rows"))
    g = F.when(F.col("own_rows") >= LEAST_ROWS, F.col("own")).when(F.col("pool_rows") >= LEAST_ROWS, F.col("pool")).otherwise(F.lit(ALL_ROWS))
    judged_by = materialize(sizes.join(pools, "pool").select("own", g.alias("g")), "quality-judged-by")
    wanted = judged_by.select("g").distinct()
    wanted = F.broadcast(wanted) if few else wanted
    # rows of the groups, languages and the whole that some group is judged by
    candidates = [vectors.select(F.col("own").alias("g"), *DIMENSIONS).join(wanted, "g", "left_semi")]
    candidates += [vectors.select(x.alias("g"), *DIMENSIONS).join(wanted, "g", "left_semi").distinct() for x in (F.col("pool"), F.lit(ALL_ROWS))]
    taught = materialize(candidates[0].unionByName(candidates[1]).unionByName(candidates[2]), "quality-taught")
    enough = taught.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_ROWS).select("g")
    params = _estimate(taught.join(F.broadcast(enough) if few else enough, "g", "left_semi"), few)
    final = _distances(rows.join(F.broadcast(judged_by) if few else judged_by, "own"), params, few)
    inside = F.coalesce(F.col("d2") <= CUTOFF, F.lit(True))
    return final.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & inside).alias("kept"), F.sqrt("d2").alias("distance"))
