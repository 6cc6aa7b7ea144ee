"""Finding things on pages from the places of tokens and pixels: exact numbers split over tokens, ruled lines and shaded bands, labels in order.

Tokens are rows (page, line, left, right, text), pixels are sums by row of an image: no page is ever one value. Windows run over a line of a page
or the rows of an image, which a page's size bounds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import discard, written


def tokens(pages: DataFrame, page: str, text: str) -> DataFrame:
    """page, line, left, right, token: what stands between spaces on each line, with the places of its first character and after its last."""
    lines = pages.select(page, F.posexplode(F.split(text, "\n")).alias("line", "s"))
    t = lines.select(page, "line", F.posexplode(F.split("s", " ")).alias("at", "token"))
    before = Window.partitionBy(page, "line").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    left = F.coalesce(F.sum(F.length("token") + 1).over(before), F.lit(0)).cast("long")
    return t.withColumn("left", left).filter("token <> ''").select(page, "line", "left", (F.col("left") + F.length("token")).alias("right"), "token")


def joined_hits(tokens: DataFrame, wanted: DataFrame, page: str, digits: str, number: str, most: int, gap: tuple[int, int]) -> DataFrame:
    """page, line, left, right, mean_confidence, n_tokens: runs of one to `most` neighbouring tokens of a line, with gaps within limits, whose digits
    make up the page's wanted number (wanted: page, number). tokens: page, line, left, right, confidence, digits."""
    along = Window.partitionBy(page, "line").orderBy("left")
    t = tokens.join(wanted.select(page, number), page)
    after = lambda c, k: F.col(c) if k == 0 else F.lead(c, k).over(along)
    for k in range(most):
        t = t.withColumns({f"d{k}": after(digits, k), f"r{k}": after("right", k), f"c{k}": after("confidence", k), f"l{k}": after("left", k)})

    def run(n: int) -> Column:
        gaps = [(F.col(f"l{k + 1}") - F.col(f"r{k}")).between(*gap) for k in range(n - 1)]
        fits = reduce(lambda a, b: a & b, gaps, F.concat(*[F.col(f"d{k}") for k in range(n)]) == F.col(number))
        mean = sum((F.col(f"c{k}") for k in range(1, n)), F.col("c0")) / n
        return F.when(fits, F.struct(F.col(f"r{n - 1}").alias("right"), F.round(mean, 2).alias("mean_confidence"), F.lit(n).alias("n_tokens")))

    runs = F.filter(F.array(*[run(n) for n in range(1, most + 1)]), lambda x: x.isNotNull())
    return t.select(page, "line", "left", F.explode(runs).alias("hit")).select(page, "line", "left", "hit.*")


def thinned(hits: DataFrame, page: str, x: Column, y: Column, best: list[Column], reach: tuple[float, float]) -> DataFrame:
    """The hits that remain if, from the best on, each drops the worse ones within reach of it on its page. best: what orders hits, the best least.
    Instead of one after the other, all that have no better neighbour left are taken at once, and their neighbours dropped, until none is left."""
    h = written(hits.withColumns({"t_x": x.cast("double"), "t_y": y.cast("double"), "t_rank": F.struct(*[c.alias(f"b{i}") for i, c in enumerate(best)])}))
    near = h.select(page, "t_rank", "t_x", "t_y", F.floor(F.col("t_x") / reach[0]).alias("cx"), F.floor(F.col("t_y") / reach[1]).alias("cy"))
    around = lambda c: F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1))
    a = near.select(page, F.col("t_rank").alias("better"), F.col("t_x").alias("ox"), F.col("t_y").alias("oy"), around("cx").alias("cx"), "cy").withColumn("cy", around("cy"))
    pairs = near.join(a, [page, "cx", "cy"]).filter((F.col("better") < F.col("t_rank")) & (F.abs(F.col("t_x") - F.col("ox")) <= reach[0]) & (F.abs(F.col("t_y") - F.col("oy")) <= reach[1]))
    pairs = written(pairs.select(page, "t_rank", "better"))
    left, kept = written(h.select(page, "t_rank").distinct()), []
    while not left.isEmpty():
        open_pairs = pairs.join(left, [page, "t_rank"], "left_semi").join(left.withColumnRenamed("t_rank", "better"), [page, "better"], "left_semi")
        now = written(left.join(open_pairs, [page, "t_rank"], "left_anti"))
        kept.append(now)
        dropped = pairs.join(now.withColumnRenamed("t_rank", "better"), [page, "better"], "left_semi").select(page, "t_rank")
        rest = written(left.join(now, [page, "t_rank"], "left_anti").join(dropped, [page, "t_rank"], "left_anti"))
        discard(left)
        left = rest
    ranks = reduce(DataFrame.unionByName, kept) if kept else left
    return h.join(ranks, [page, "t_rank"], "left_semi").drop("t_x", "t_y", "t_rank")


def dark_rows(pixels: DataFrame, image: str, row: str, value: Column, thresholds: list[float], fraction: float) -> DataFrame:
    """image, threshold, row: rows of which at least `fraction` is darker than a threshold. All thresholds are counted in one pass over the pixels."""
    counts = pixels.groupBy(image, row).agg(F.count(value).alias("n"), *[F.count_if(value < t).alias(f"n{i}") for i, t in enumerate(thresholds)])
    each = F.array(*[F.struct(F.lit(i).alias("threshold"), F.col(f"n{i}").alias("dark")) for i in range(len(thresholds))])
    return counts.select(image, row, "n", F.explode(each).alias("e")).filter(F.col("e.dark") >= F.col("n") * fraction).select(image, F.col("e.threshold").alias("threshold"), row)


def lines_of(rows: DataFrame, keys: list[str], row: str) -> DataFrame:
    """keys, y0, y1, centre: runs of adjacent rows."""
    order = Window.partitionBy(*keys).orderBy(row)
    return rows.withColumn("run", F.col(row) - F.row_number().over(order)).groupBy(*keys, "run").agg(F.min(row).alias("y0"), F.max(row).alias("y1")).drop("run").withColumn("centre", (F.col("y0") + F.col("y1")) / 2)


def stable_run(lines: DataFrame, keys: list[str], gap: tuple[float, float], least: int) -> DataFrame:
    """keys, y0, y1, lines: the longest run of lines whose centres are apart by the limits (the first of equal ones), if it has `least` lines."""
    order = Window.partitionBy(*keys).orderBy("y0")
    step = F.col("centre") - F.lag("centre").over(order)
    runs = lines.withColumn("new", F.when(step.between(*gap), 0).otherwise(1)).withColumn("run", F.sum("new").over(order))
    per = runs.groupBy(*keys, "run").agg(F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.count("*").alias("lines")).filter(F.col("lines") >= least)
    best = per.groupBy(*keys).agg(F.max(F.struct("lines", (-F.col("y0")).alias("minus"), "y1")).alias("b"))
    return best.select(*keys, (-F.col("b.minus")).alias("y0"), F.col("b.y1").alias("y1"), F.col("b.lines").alias("lines"))


def decided(candidates: DataFrame, key: str, value: str, confidence: str, sure: float, weak: float) -> DataFrame:
    """key, value, confidence, decision: a value that two or more candidates agree on (the commonest, then the least); or that of one candidate that is sure
    where all others are weak; else null."""
    votes = candidates.groupBy(key, value).agg(F.count("*").alias("n"), F.avg(confidence).alias("mean"), F.max(confidence).alias("top"))
    order = F.struct((-F.col("n")).alias("n"), F.col(value).alias("v"), "mean")
    per = votes.groupBy(key).agg(F.min(order).alias("most"), F.max(F.struct("top", value)).alias("first"), F.count("*").alias("values"), F.array_sort(F.collect_list("top")).alias("tops"))
    second = F.when(F.col("values") > 1, F.get("tops", (F.col("values") - 2).cast("int")))
    agreed, single = F.col("most.n") <= -2, (F.col("first.top") >= sure) & (second.isNull() | (second < weak))
    return per.select(
        key, F.when(agreed, F.col("most.v")).when(single, F.col(f"first.{value}")).alias(value), F.when(agreed, F.col("most.mean")).when(single, F.col("first.top")).alias("confidence"),
        F.when(agreed, "consensus").when(single, "dominance").otherwise("weak or conflicting").alias("decision"),
    )


def phrases(tokens: DataFrame, page: str, ends: Column, gap: int) -> DataFrame:
    """page, line, left, right, phrase: neighbouring tokens of a line, cut after tokens that end one and at wider gaps."""
    along = Window.partitionBy(page, "line").orderBy("left")
    new = F.coalesce(F.lag(ends).over(along), F.lit(True)) | (F.col("left") - F.lag("right").over(along) > gap)
    t = tokens.withColumn("new", new.cast("int")).withColumn("phrase", F.sum("new").over(along))
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("left", "token"))), lambda x: x.token), " ")
    return t.groupBy(page, "line", F.col("phrase").alias("at")).agg(F.min("left").alias("left"), F.max("right").alias("right"), words.alias("phrase")).drop("at")


def best_triples(candidates: DataFrame, page: str, before: int, after: tuple[int, int]) -> DataFrame:
    """page, line, score, x0, x1, x2: the best three labels in order on one line of a page, by the sum of their scores (ties: the first line, then places from the
    left). candidates: page, line, x, field (0, 1, 2), score. The first lies at least `before` left of the second, the third right of it within `after`.
    For each second label the best first is a running maximum and the best third one over a range, so no pair or triple is made."""
    along = Window.partitionBy(page, "line").orderBy("x")
    of = lambda f: F.when(F.col("field") == f, F.struct("score", (-F.col("x")).alias("minus")))
    c = candidates.withColumns({"first": F.max(of(0)).over(along.rangeBetween(Window.unboundedPreceding, -before)), "third": F.max(of(2)).over(along.rangeBetween(*after))})
    t = c.filter("field = 1 AND first IS NOT NULL AND third IS NOT NULL")
    score = F.col("score") + F.col("first.score") + F.col("third.score")
    best = t.groupBy(page).agg(F.max(F.struct(score.alias("score"), (-F.col("line")).alias("line"), F.col("first.minus").alias("x0"), (-F.col("x")).alias("x1"), F.col("third.minus").alias("x2"))).alias("b"))
    return best.select(page, (-F.col("b.line")).alias("line"), F.col("b.score").alias("score"), *[(-F.col(f"b.x{i}")).alias(f"x{i}") for i in range(3)])
