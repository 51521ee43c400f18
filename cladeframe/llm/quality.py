"""Quality rules: robust multivariate outliers per language and source (operator 4, DataFrame functions only)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeframe.llm._common import NOT_SPACE, SPACE, Scratch

#: Rates that the ellipsoid is fitted to, after their transforms; the first is the length, given which the rest are judged.
FEATURES = ("x_length", "x_word", "x_symbol", "x_line", "x_repeat")
#: Variance added to each transformed rate, in its own units: what counts as noise where most documents are equal.
FLOOR = (0.05, 0.01, 0.0025, 0.02, 0.01)
#: Starts of each group, C-steps that all starts take, C-steps of the best one, and the share that the determinant is minimised over.
STARTS, FIRST_STEPS, LAST_STEPS, SUPPORT = 3, 2, 3, 0.75
#: The squared distance beyond which a document goes: the 1 - 1e-6 quantile of chi-square with 4 degrees of freedom.
CUT = 33.4
#: Documents that the language (and for it, all documents) weigh in the fit of each group, whatever its size.
PRIOR = 30.0
#: Rows of a group that meet its fit in one task.
SALT_ROWS = 2000
_SPACES = " \t\n\x0b\f\r"


def _let(value: Column, body) -> Column:
    """body(value) with value computed once: lambdas would otherwise compute it for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated(words: Column) -> Column:
    """Words inside 3-word windows found at least twice: sorts the window hashes with their places, no self-join."""

    def covered(places: Column) -> Column:
        start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
        step = lambda a, p: F.struct((p + 3).alias("end"), (a["n"] + (p + 3 - F.greatest(a["end"], p))).cast("long").alias("n"))
        return F.aggregate(places, start, step, lambda a: a["n"])

    def places(sorted_: Column) -> Column:
        same = lambda x, i: (x["h"] == F.try_element_at(sorted_, i + 2)["h"]) | ((i > 0) & (x["h"] == F.get(sorted_, i - 1)["h"]))
        return F.sort_array(F.transform(F.filter(sorted_, lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x["p"]))

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def some(h: Column) -> Column:
        with_place = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_let(with_place, lambda s: covered(places(s))))

    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(_let(windows(words), some))


def statistics(documents: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of each whole text; a null text has none of anything."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(F.col("text"), "\n", -1), lambda x: F.length(F.translate(x, _SPACES, "")) > 0)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), text.alias("text"))
    split = docs.select("doc_id", "lang", "source", "text", F.regexp_extract_all("text", F.lit(f"({NOT_SPACE})"), F.lit(1)).alias("w"), lines.alias("l"))
    return split.select(
        "doc_id", "lang", "source",
        F.size("w").cast("long").alias("n_words"),
        (F.length("text") - F.length(F.regexp_replace("text", f"[^{SPACE}]", ""))).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]", "")).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        _repeated(F.col("w")).alias("n_repeat_words"),
        F.size("l").cast("long").alias("n_lines"),
    )


def _transformed(stats: DataFrame) -> DataFrame:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return stats.withColumns(
        {
            "x_length": F.log(n),
            "x_word": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n),
            "x_symbol": F.sqrt(F.col("n_symbols") / n),
            "x_line": F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
            "x_repeat": F.sqrt(F.col("n_repeat_words") / n),
        }
    )


_P = range(len(FEATURES))
_LOWER = [(i, j) for i in _P for j in range(i + 1)]
#: Sums that a fit is made of: documents, first moments and second moments.
_SUMS = ["n", *(f"m_{i}" for i in _P), *(f"s_{i}_{j}" for i, j in _LOWER)]
_FIT = [*(f"m_{i}" for i in _P), *(f"l_{i}_{j}" for i, j in _LOWER)]


def _factor() -> list[str]:
    """The Cholesky factor of the covariance columns c_i_j, row by row, each entry from the ones before it in the same list."""
    out = []
    for i, j in _LOWER:
        inner = f"c_{i}_{j}" + "".join(f" - l_{i}_{k} * l_{j}_{k}" for k in range(j))
        out.append(f"sqrt(greatest({inner}, {FLOOR[i] / 100}D)) AS l_{i}_{i}" if i == j else f"({inner}) / l_{j}_{j} AS l_{i}_{j}")
    return out


def _fit(rows: DataFrame, groups: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Mean, Cholesky factor and log determinant of the rows of each group and start, from partial sums.

    Each group takes PRIOR documents that are as its language's on average, and each language PRIOR that are as all
    are: the same rule for every size, which fades as a group grows and gives even an empty group an ellipsoid.
    """
    sums = ["cast(count(*) AS double) AS n", *(f"sum({FEATURES[i]}) AS m_{i}" for i in _P), *(f"sum({FEATURES[i]} * {FEATURES[j]}) AS s_{i}_{j}" for i, j in _LOWER)]
    own = groups.join(rows.groupBy("grp", "start").agg(*map(F.expr, sums)), ["grp", "start"], "left").fillna(0.0, _SUMS)
    own = scratch.write(own, f"{name}-sums")  # a row a group and start

    def with_prior(table: DataFrame, above: DataFrame, keys: list[str]) -> DataFrame:
        mean = [f"{c} / greatest(n, 1D) * {PRIOR}D AS p_{c}" for c in _SUMS]
        return table.join(above.selectExpr(*keys, *mean), keys).selectExpr(*(c for c in table.columns if c not in _SUMS), *(f"{c} + p_{c} AS {c}" for c in _SUMS))

    total = [F.expr(f"sum({c}) AS {c}") for c in _SUMS]
    tongue = with_prior(own.groupBy("tongue", "start").agg(*total), own.groupBy("start").agg(*total), ["start"])
    fit = with_prior(own, tongue, ["tongue", "start"]).selectExpr("grp", "start", "greatest(n, 1e-9D) AS n", *_SUMS[1:])
    fit = fit.selectExpr("grp", "start", *(f"m_{i} / n AS m_{i}" for i in _P), *(f"s_{i}_{j} / n - m_{i} / n * (m_{j} / n)" + (f" + {FLOOR[i]}D" if i == j else "") + f" AS c_{i}_{j}" for i, j in _LOWER))
    det = " + ".join(f"ln(l_{i}_{i})" for i in _P)
    return fit.selectExpr("*", *_factor()).selectExpr("grp", "start", f"{det} AS log_det", *_FIT)


def _distance(rows: DataFrame) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance, and d2_given, the same of the rates given the length."""
    z = [f"({name} - m_{i}" + "".join(f" - l_{i}_{j} * z_{j}" for j in range(i)) + f") / l_{i}_{i} AS z_{i}" for i, name in enumerate(FEATURES)]
    total = lambda at: " + ".join(f"z_{i} * z_{i}" for i in range(at, len(FEATURES)))
    return rows.selectExpr("*", *z).selectExpr("*", f"{total(0)} AS d2", f"{total(1)} AS d2_given").drop(*_FIT, *(f"z_{i}" for i in _P))


def quality_rules(documents: DataFrame) -> DataFrame:
    """Counts of each whole text and the verdict of a robust ellipsoid per language and source.

    Needs doc_id, text, lang and source; other columns are ignored. Returns per row doc_id, n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words, distance, base_failed and kept. A document fails the base rule with
    fewer than 50 words or with more than half of its words repeated.

    The minimum-covariance-determinant estimate of a group goes through concentration steps: fit mean and
    covariance, keep the SUPPORT share of smallest distance, fit again; the determinant doesn't grow. STARTS begin
    differently (nearest to the median by the floors, nearest by robust spreads, and a half by hash), take
    FIRST_STEPS, and the one of the least determinant goes on. A covariance floor keeps it regular where a rate is
    constant. Documents that the base rule rejects take no part. The statistics vector that is judged are the four
    rates, cleared of what their regression on the log of the length explains, as long texts repeat more by nature;
    its squared Mahalanobis distance under the ellipsoid is distance, and beyond CUT a document goes. A text is so
    never rejected for its length alone.

    Every step is a grouped sum with map-side partial sums over a small table of statistics, and large groups are
    salted, so a source with a third of all rows is no single task. A null language or source is a value like
    others; small groups lean on their language by PRIOR documents, as all groups do. A null text has no words and
    fails; repeated rows count as often as they stand, and each has its verdict.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "quality")
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    key = F.to_json(F.struct("lang", "source"))
    stats = scratch.write(_transformed(statistics(documents)).withColumns({"base_failed": failed, "grp": key, "tongue": F.coalesce(F.concat(F.lit("s"), "lang"), F.lit("n"))}), "stats")
    # A group is dealt over salts by its size, and what is known of it is copied to each salt, so that the rows of a
    # hot group meet its fit in many tasks and leave as partial sums.
    salts = F.ceil(F.count("*") / F.lit(SALT_ROWS)).cast("int")
    shares = scratch.write(stats.groupBy("grp", "tongue").agg(salts.alias("salts")), "shares")
    rows = stats.drop("lang", "source", "tongue").join(shares.drop("tongue"), "grp").withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.col("salts")).cast("int")).drop("salts")
    rows = scratch.write(rows, "rows")
    good = rows.where(~F.col("base_failed"))
    starts = F.explode(F.array(*(F.lit(k) for k in range(STARTS))))
    groups = scratch.write(shares.select("grp", "tongue", starts.alias("start")), "starts")
    used = ["stats", "shares", "starts"]

    def salted(table: DataFrame) -> DataFrame:
        return table.join(shares.select("grp", "salts"), "grp").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")

    def known(table: DataFrame, name: str) -> DataFrame:
        used.append(name)
        return scratch.write(salted(table), name)

    def nearest(measured: DataFrame) -> DataFrame:
        limits = salted(measured.groupBy("grp", "start").agg(F.percentile_approx("d2", SUPPORT, 1000).alias("limit")))
        return measured.join(limits, ["grp", "start", "salt"]).where(F.col("d2") <= F.col("limit"))

    def step(measured: DataFrame, of: DataFrame, name: str) -> DataFrame:
        fit = known(_fit(nearest(measured), of, scratch, name), name)
        used.append(f"{name}-sums")
        return fit

    quarters = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    middle = known(good.groupBy("grp").agg(*(F.percentile_approx(c, quarters, 1000).alias(f"q_{c}") for c in FEATURES)), "middle")
    off = lambda i, c, scale: F.pow(F.col(c) - F.get(f"q_{c}", F.lit(1)), F.lit(2.0)) / scale(i, c)
    spread = lambda i, c: F.pow((F.get(f"q_{c}", F.lit(2)) - F.get(f"q_{c}", F.lit(0))) / F.lit(1.349), F.lit(2.0)) + F.lit(FLOOR[i])
    total = lambda scale: reduce(lambda a, b: a + b, (off(i, c, scale) for i, c in enumerate(FEATURES)))
    draw = F.pmod(F.xxhash64("doc_id", "word_chars", F.lit("start")), F.lit(1 << 20)).cast("double")
    begun = good.join(middle, ["grp", "salt"]).withColumn("start", starts)
    begun = begun.withColumn("d2", F.when(F.col("start") == 0, total(lambda i, c: F.lit(FLOOR[i]))).when(F.col("start") == 1, total(spread)).otherwise(draw)).drop(*(f"q_{c}" for c in FEATURES))
    fit = step(begun, groups, "fit-0")
    for k in range(FIRST_STEPS):
        fit = step(_distance(good.join(fit, ["grp", "salt"])), groups, f"fit-{k + 1}")
    best = scratch.write(fit.where("salt = 0").groupBy("grp").agg(F.min(F.struct("log_det", "start")).alias("b")).select("grp", F.col("b.start").alias("start")), "best")
    used.append("best")
    chosen = scratch.write(groups.join(best, ["grp", "start"]).select("grp", "tongue", F.lit(0).alias("start")), "chosen")
    used.append("chosen")
    fit = fit.join(best, ["grp", "start"]).withColumn("start", F.lit(0))
    for k in range(LAST_STEPS):
        fit = step(_distance(good.join(fit, ["grp", "salt"])), chosen, f"last-{k}")
    # Consistency at the normal model: the median distance of the good documents is set to chi-square's.
    measured = _distance(good.join(fit, ["grp", "salt"]))
    scale = known(measured.groupBy("grp").agg((F.percentile_approx("d2_given", 0.5, 1000) / F.lit(3.357)).alias("scale")), "scale")
    fit = scratch.write(fit.join(scale, ["grp", "salt"], "left"), "fit")
    judged = _distance(rows.join(fit, ["grp", "salt"], "left")).withColumn("distance", F.col("d2_given") / F.greatest(F.coalesce("scale", F.lit(1.0)), F.lit(1.0)))
    scratch.drop(*used)
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= CUT, F.lit(True))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "distance", "base_failed", kept.alias("kept"))
