"""Quality rules: robust multivariate outliers by minimum covariance determinant (MCD), per language and source.

Base statistics come from the words, symbols and lines of each whole text. Documents that pass the base rules are
described by four transformed statistics; every (language, source) group gets a robust centre and scatter, and
documents far from it by Mahalanobis distance are rejected.

The estimate is deterministic: it starts at coordinate-wise medians and MADs and takes `STEPS` concentration steps,
each keeping the `H_SHARE` of the group with the smallest distances. Distances are binned, so one step is one
grouping by (group, bin) with summed products: exact integer sums, combined before the shuffle, no matter how
large a group is. Many statistics are constant over clean text, so each variance gets the square of a least scale
(`FLOORS`) added, as in the regularised MCD; otherwise the determinant would be zero.

The SQL of the estimate is plain enough for Spark and for the checking engine alike: both run the text below.

Edge cases: a null text has no words and fails the base rules; null languages and sources form groups of their own;
groups with fewer than `SMALL` base-passing documents are pooled by language; a pool still smaller rejects
nothing; repeated rows are judged one by one; other columns of the input are carried along unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstile.llm.common import staged

#: Share of a group that a concentration step keeps, and the factor that makes its scatter consistent for four normal dimensions.
H_SHARE, CONSISTENCY = 0.75, 1.486
STEPS = 3
#: Fewest base-passing documents of a (language, source) group with an estimate of its own.
SMALL = 40
#: Most groups whose parameters, some 150 bytes each, are broadcast; beyond that the join shuffles.
BROADCAST_GROUPS = 100_000
#: Squared distance beyond which a document is an outlier: the 0.999 quantile of chi-square with four degrees of freedom.
CUTOFF = 18.467
#: Least scales, in thousandths, of: log mean word length; log symbols, repeated lines and repeated words per hundred.
#: Where a group has no scatter of its own, a statistic alone rejects 4.3 scales off: words 29 % longer or 23 % shorter,
#: 24 symbols to 100 words, 73 % repeated lines, 38 % repeated words. One repeated line of seven is two to three scales.
FLOORS = (60, 750, 1000, 850)
DIMS = len(FLOORS)
MIN_WORDS = 50

SPACE = "[\\x20\\x09-\\x0D]+"
PAIRS = [(i, j) for i in range(1, DIMS + 1) for j in range(i, DIMS + 1)]


def base_statistics(df: DataFrame, text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Adds a struct `base`: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed.

    n_repeat_words counts the words inside windows of three that occur twice or more: the places of the repeated
    windows, in order, cover three words each or as many as lie before the next place.
    """
    keep = [F.col(f"`{c}`") for c in df.columns]
    blank = lambda s: s != ""
    df = df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    words = F.filter(F.split("_text", SPACE), blank)
    lines = F.filter(F.split("_text", "\n"), lambda s: s.rlike("[^\\x20\\x09-\\x0D]"))
    df = df.select(*keep, "_text", words.alias("_words"), lines.alias("_lines"))
    # Words hold no space, so the joined text of a window is equal exactly when its words are.
    window = lambda w, i: F.concat(w, F.lit(" "), F.get(F.col("_words"), i + 1), F.lit(" "), F.get(F.col("_words"), i + 2))
    df = df.select(
        *keep, "_text", "_words", "_lines",
        F.when(F.size("_words") >= 3, F.slice(F.transform("_words", window), F.lit(1), F.greatest(F.size("_words") - 2, F.lit(0)))).otherwise(F.array().cast("array<string>")).alias("_windows"),
    )
    # Sorted with their places, equal windows are neighbours. Each array is a column of its own: inside a lambda its
    # expression would be computed once per element.
    placed = F.transform("_windows", lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    none = F.array().cast("array<struct<w:string,i:int>>")
    some = F.size(F.array_distinct("_windows")) < F.size("_windows")
    df = df.select(*keep, "_text", "_words", "_lines", F.when(some, F.sort_array(placed)).otherwise(none).alias("_ordered"))
    same = lambda x, i: (F.get(F.col("_ordered"), i - 1)["w"] == x["w"]) | (F.get(F.col("_ordered"), i + 1)["w"] == x["w"])
    df = df.select(
        *keep, "_text", "_words", "_lines",
        F.sort_array(F.transform(F.filter("_ordered", lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x["i"])).alias("_places"),
    )
    symbols = F.col("_text")
    for s in "#*$%&|<>":
        symbols = F.replace(symbols, F.lit(s), F.lit(""))
    # least() passes over the null after the last place, which so covers three words.
    covered = F.aggregate(F.transform("_places", lambda p, i: F.least(F.lit(3), F.get(F.col("_places"), i + 1) - p)), F.lit(0), lambda a, x: a + x)
    df = df.select(
        *keep,
        F.size("_words").cast("long").alias("_n"),
        F.length(F.array_join("_words", "")).cast("long").alias("_c"),
        (F.length("_text") - F.length(symbols)).cast("long").alias("_s"),
        F.size("_lines").cast("long").alias("_l"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("_d"),
        covered.cast("long").alias("_r"),
    )
    failed = (F.col("_n") < min_words) | (100 * F.col("_r") > 50 * F.col("_n"))
    base = F.struct(
        F.col("_n").alias("n_words"), F.col("_c").alias("word_chars"), F.col("_s").alias("n_symbols"), F.col("_d").alias("n_dup_lines"),
        F.col("_r").alias("n_repeat_words"), F.col("_l").alias("n_lines"), failed.alias("base_failed"),
    )
    return df.select(*keep, base.alias("base"))


# --- SQL of the estimate, shared with the check ---------------------------------------------------------------

#: Transformed statistics in thousandths, from columns n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines.
VECTOR = {
    "x1": "CAST(round(1000 * ln(CAST(word_chars AS DOUBLE) / n_words)) AS BIGINT)",
    "x2": "CAST(round(1000 * ln(1 + 100 * CAST(n_symbols AS DOUBLE) / n_words)) AS BIGINT)",
    "x3": "CAST(round(1000 * ln(1 + 100 * CAST(n_dup_lines AS DOUBLE) / n_lines)) AS BIGINT)",
    "x4": "CAST(round(1000 * ln(1 + 100 * CAST(n_repeat_words AS DOUBLE) / n_words)) AS BIGINT)",
}
LANG = "coalesce(concat('=', lang), '-')"
SOURCE = "coalesce(concat('=', source), '-')"


def vectors_sql(stats: str) -> str:
    cols = ", ".join(f"{e} AS {n}" for n, e in VECTOR.items())
    return f"SELECT {LANG} AS gl, {SOURCE} AS gs0, {cols} FROM {stats} WHERE NOT base_failed"


def sizes_sql(vectors: str) -> str:
    """Which group each (language, source) belongs to."""
    return f"SELECT gl, gs0, CASE WHEN count(*) >= {SMALL} THEN gs0 ELSE '*' END AS gs FROM {vectors} GROUP BY gl, gs0"


def grouped_sql(vectors: str, sizes: str) -> str:
    return f"SELECT s.gl, s.gs, x1, x2, x3, x4 FROM {vectors} v JOIN {sizes} s ON v.gl = s.gl AND v.gs0 = s.gs0"


def histogram_sql(grouped: str) -> str:
    """Counts by group, dimension and value to a hundredth: bounded by the range of the statistics."""
    each = " UNION ALL ".join(f"SELECT gl, gs, {k} AS k, CAST(floor(x{k} / 10.0) AS BIGINT) AS x FROM {grouped}" for k in range(1, DIMS + 1))
    return f"SELECT gl, gs, k, x, count(*) AS c FROM ({each}) u GROUP BY gl, gs, k, x"


def middle_sql(histogram: str) -> str:
    return (
        f"SELECT gl, gs, k, min(x) AS mid FROM (SELECT gl, gs, k, x, sum(c) OVER (PARTITION BY gl, gs, k ORDER BY x) AS upto, "
        f"sum(c) OVER (PARTITION BY gl, gs, k) AS n FROM {histogram}) h WHERE 2 * upto >= n GROUP BY gl, gs, k"
    )


def away_sql(histogram: str, middle: str) -> str:
    return f"SELECT h.gl, h.gs, h.k, abs(h.x - m.mid) AS x, sum(h.c) AS c FROM {histogram} h JOIN {middle} m ON h.gl = m.gl AND h.gs = m.gs AND h.k = m.k GROUP BY h.gl, h.gs, h.k, abs(h.x - m.mid)"


def start_sql(middle: str, away: str) -> str:
    """Medians and squared MADs: the first centre m<i> and scatter v<i><j>."""
    centre = ", ".join(f"max(CASE WHEN m.k = {i} THEN 10.0e0 * m.mid END) AS m{i}" for i in range(1, DIMS + 1))
    scatter = ", ".join(
        (f"max(CASE WHEN m.k = {i} THEN 14.826e0 * a.mid * 14.826e0 * a.mid END) + {FLOORS[i - 1] ** 2}.0e0" if i == j else "0.0e0") + f" AS v{i}{j}" for i, j in PAIRS
    )
    return f"SELECT m.gl, m.gs, {centre}, {scatter} FROM {middle} m JOIN {away} a ON m.gl = a.gl AND m.gs = a.gs AND m.k = a.k GROUP BY m.gl, m.gs"


def factor_sql(scatter: str) -> str:
    """Cholesky factor l<i><j> of each group's scatter, one column of the factor after the other."""
    sql = scatter
    for j in range(1, DIMS + 1):
        own = f"v{j}{j}" + "".join(f" - l{j}{k} * l{j}{k}" for k in range(1, j))
        sql = f"(SELECT *, sqrt({own}) AS l{j}{j} FROM {sql} f{j})"
        below = ", ".join(f"(v{j}{i}" + "".join(f" - l{i}{k} * l{j}{k}" for k in range(1, j)) + f") / l{j}{j} AS l{i}{j}" for i in range(j + 1, DIMS + 1))
        if below:
            sql = f"(SELECT *, {below} FROM {sql} b{j})"
    names = ", ".join([*(f"m{i}" for i in range(1, DIMS + 1)), *(f"l{j}{i}" for i, j in PAIRS)])
    return f"SELECT gl, gs, {names} FROM {sql} c"


def distance_sql(rows: str, keep: str) -> str:
    """Squared Mahalanobis distance d2 from columns x, m and l, by forward substitution."""
    sql = rows
    for i in range(1, DIMS + 1):
        y = f"(x{i} - m{i}" + "".join(f" - l{i}{k} * y{k}" for k in range(1, i)) + f") / l{i}{i}"
        sql = f"(SELECT *, {y} AS y{i} FROM {sql} s{i})"
    d2 = " + ".join(f"y{i} * y{i}" for i in range(1, DIMS + 1))
    return f"SELECT {keep}, {d2} AS d2 FROM {sql} t"


def step_sql(grouped: str, factor: str) -> str:
    """One concentration step: the bins of the nearest documents, and centre and scatter of those."""
    joined = f"(SELECT g.*, {', '.join(f'p.m{i}' for i in range(1, DIMS + 1))}, {', '.join(f'p.l{j}{i}' for i, j in PAIRS)} FROM {grouped} g JOIN {factor} p ON g.gl = p.gl AND g.gs = p.gs)"
    far = distance_sql(joined, "gl, gs, x1, x2, x3, x4")
    sums = ", ".join([*(f"sum(x{i}) AS s{i}" for i in range(1, DIMS + 1)), *(f"sum(x{i} * x{j}) AS q{i}{j}" for i, j in PAIRS)])
    bins = f"SELECT gl, gs, CAST(floor(8 * ln(d2 + 0.01e0)) AS BIGINT) AS bin, count(*) AS n, {sums} FROM ({far}) d GROUP BY gl, gs, CAST(floor(8 * ln(d2 + 0.01e0)) AS BIGINT)"
    ranked = f"SELECT *, sum(n) OVER (PARTITION BY gl, gs ORDER BY bin) - n AS before, sum(n) OVER (PARTITION BY gl, gs) AS total FROM ({bins}) b"
    both = ", ".join([*(f"CAST(sum(s{i}) AS DOUBLE) / sum(n) AS m{i}" for i in range(1, DIMS + 1)), *(f"CAST(sum(q{i}{j}) AS DOUBLE) / sum(n) AS e{i}{j}" for i, j in PAIRS)])
    near = f"SELECT gl, gs, {both} FROM ({ranked}) r WHERE before < {H_SHARE}e0 * total GROUP BY gl, gs"
    scatter = ", ".join(f"{CONSISTENCY}e0 * (e{i}{j} - m{i} * m{j})" + (f" + {FLOORS[i - 1] ** 2}.0e0" if i == j else "") + f" AS v{i}{j}" for i, j in PAIRS)
    return f"SELECT gl, gs, {', '.join(f'm{i}' for i in range(1, DIMS + 1))}, {scatter} FROM ({near}) n"


#: Of the groups with an estimate; a pool that is too small has none.
def enough_sql(grouped: str, factor: str) -> str:
    return f"SELECT p.* FROM {factor} p JOIN (SELECT gl, gs FROM {grouped} GROUP BY gl, gs HAVING count(*) >= {SMALL}) z ON p.gl = z.gl AND p.gs = z.gs"


def estimates(grouped: DataFrame) -> DataFrame:
    """Centre m<i> and Cholesky factor l<i><j> of every group; each step is staged, a row per group."""
    spark = grouped.sparkSession
    hist = staged(spark.sql(histogram_sql("{g}"), g=grouped), "quality-histogram")
    mid = staged(spark.sql(middle_sql("{h}"), h=hist), "quality-middle")
    away = spark.sql(middle_sql("{a}"), a=spark.sql(away_sql("{h}", "{m}"), h=hist, m=mid))
    scatter = staged(spark.sql(start_sql("{m}", "{a}"), m=mid, a=away), "quality-start")
    for _ in range(STEPS):
        factor = spark.sql(factor_sql("{s}"), s=scatter)
        scatter = staged(spark.sql(step_sql("{g}", "{f}"), g=grouped, f=factor), "quality-step")
    return spark.sql(enough_sql("{g}", "{f}"), g=grouped, f=spark.sql(factor_sql("{s}"), s=scatter))


def judged(docs: DataFrame, carry: list[str], text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The columns `carry` of docs as struct `row`, the struct `base`, d2 (null where there is no estimate) and kept."""
    spark = docs.sparkSession
    rows = base_statistics(docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("text")))
    stats = staged(rows.select("row", "lang", "source", "base"), "quality-statistics")
    flat = stats.select("lang", "source", "base.*")
    vectors = spark.sql(vectors_sql("{t}"), t=flat)
    sizes = staged(spark.sql(sizes_sql("{t}"), t=vectors), "quality-sizes")
    grouped = staged(spark.sql(grouped_sql("{v}", "{s}"), v=vectors, s=sizes), "quality-vectors")
    factor = staged(estimates(grouped), "quality-estimates")
    near = ["gl", "gs0", *(f"m{i}" for i in range(1, DIMS + 1)), *(f"l{j}{i}" for i, j in PAIRS)]
    params = staged(spark.sql(f"SELECT {', '.join(near)} FROM {{s}} s JOIN {{f}} f USING (gl, gs)", s=sizes, f=factor), "quality-parameters")
    if params.count() <= BROADCAST_GROUPS:
        params = F.broadcast(params)
    all_rows = stats.select("row", "base", F.expr(LANG).alias("gl"), F.expr(SOURCE).alias("gs0"), *[F.expr(f"CASE WHEN NOT base.base_failed THEN {_in_base(e)} END").alias(n) for n, e in VECTOR.items()])
    out = spark.sql(distance_sql("{t}", "row, base"), t=all_rows.join(params, ["gl", "gs0"], "left"))
    return out.withColumn("kept", F.expr(f"NOT base.base_failed AND coalesce(d2 <= {CUTOFF}e0, true)"))


def _in_base(expression: str) -> str:
    for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"):
        expression = expression.replace(c, f"base.{c}")
    return expression


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The documents that pass, all their columns unchanged."""
    return judged(docs, docs.columns, text, lang, source).where("kept").select("row.*")
