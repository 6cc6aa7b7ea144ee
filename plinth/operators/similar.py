"""Names that are alike, by edit distance, without comparing all pairs.

An edit touches at most q of a name's q-grams. So two names within d edits share one of the q * d + 1 rarest grams of each, in any common
order of grams; names with no more grams than that also meet each other by length alone. Rare grams come first, so
what many names share (a prefix, a kind) makes candidates only where nothing else could.

Where edits may touch a quarter of a name's grams and more, its rarest ones aren't rare any more, and most names of a block would meet. There, all pairs
of a block are looked at, in tiles of bounded size that all tasks share: bits of a name's characters and grams, which an edit changes few of,
leave few pairs, and edit distances of these are computed for many pairs at a time (`tiled`).
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

#: Frequent grams whose counts are broadcast to order grams by; others count as rare and go by a hash.
FREQUENT = 4096


def cost(a: Column, b: Column) -> Column:
    """Edit distance over the longer length: 0 for equal names, 1 for nothing in common."""
    return F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def edits(length: Column, most: float) -> Column:
    return F.floor(length * F.lit(most) + 1e-9).cast("int")


def prefixes(names: DataFrame, frequent: DataFrame, block: str, name: str, most: float, q: int) -> DataFrame:
    """block, name, prefix: a name's rarest grams, as many as may all be lost by edits and one more ('' stands for one where there are no more)."""
    padded = F.concat(F.lit("\x01" * (q - 1)), F.col(name), F.lit("\x02" * (q - 1)))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(name) + q - 1), lambda i: padded.substr(i, F.lit(q))))
    g = names.select(block, name, F.explode(grams).alias("gram")).join(F.broadcast(frequent), "gram", "left")
    order = F.struct(F.coalesce("times", F.lit(0)).alias("times"), F.xxhash64("gram").alias("h"), "gram")
    longest = F.floor(F.length(name) / F.lit(1.0 - most) + 1e-9)
    lost = edits(longest, most) * q
    all_grams = F.transform(F.array_sort(F.collect_list(order)), lambda x: x.gram)
    return g.groupBy(block, name).agg(all_grams.alias("grams")).select(block, name, F.when(F.size("grams") > lost, F.slice("grams", F.lit(1), lost + 1)).otherwise(F.concat("grams", F.array(F.lit("")))).alias("prefix"))


def candidates(source: DataFrame, target: DataFrame, block: str, name: str, other: str, most: float, q: int = 2) -> DataFrame:
    """block, name, other: pairs of a block that may cost `most` or less; each pair once. source: block, name; target: block, other. most is under 1."""
    s, t = source.select(block, name).distinct(), target.select(block, other).distinct()
    if most >= 1:
        raise ValueError("names of any cost are alike")
    padded = F.concat(F.lit("\x01" * (q - 1)), F.col(other), F.lit("\x02" * (q - 1)))
    counts = t.select(F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(other) + q - 1), lambda i: padded.substr(i, F.lit(q))))).alias("gram")).groupBy("gram").agg(F.count("*").alias("times"))
    frequent = counts.orderBy(F.desc("times"), "gram").limit(FREQUENT)
    a = prefixes(s.filter(F.col(name).isNotNull()), frequent, block, name, most, q)
    b = prefixes(t.filter(F.col(other).isNotNull()), frequent, block, other, most, q)
    o = b.withColumnRenamed("prefix", "o_prefix").withColumn("gram", F.explode("o_prefix")).hint("merge")  # Spark takes grams to be no larger than the file of the names
    j = a.withColumn("gram", F.explode("prefix")).join(o, [block, "gram"])
    near = F.abs(F.length(name) - F.length(other)) <= edits(F.greatest(F.length(name), F.length(other)), most)
    first = F.array_min(F.array_intersect("prefix", "o_prefix")) == F.col("gram")  # of the grams that bring a pair together, one counts
    return j.filter(near & first).select(block, name, other)


def pairs(source: DataFrame, target: DataFrame, block: str, name: str, other: str, most: float, q: int = 2) -> DataFrame:
    """block, name, other, cost: all pairs of a block that cost `most` or less. Longer grams are rarer, but more of them are lost by an edit."""
    if QUARTER <= most * q and most < 1:
        return tiled(source, target, block, name, other, most)
    return candidates(source, target, block, name, other, most, q).withColumn("cost", cost(F.col(name), F.col(other))).filter(F.col("cost") <= most)


#: Workers get what they run from here with the plan, also where they can't import it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: The share of a name's grams that edits may touch, from which on names meet in tiles.
QUARTER = 0.25
#: Names of one side of a tile, about; pairs of a tile up to which plain rows do; pairs at a time in the comparison.
CHUNK, FEW, SLICE = 4096, 4096, 32768


def chunks(names: DataFrame, block: str, name: str, to: str) -> DataFrame:
    """block and `to`: a block's different names as arrays of about CHUNK."""
    n = names.select(block, name).filter(F.col(name).isNotNull()).distinct()
    ways = n.groupBy(block).agg(F.ceil(F.count("*") / CHUNK).alias("ways"))
    dealt = n.join(ways.hint("merge"), block).withColumn("way", F.pmod(F.xxhash64(name), F.col("ways")))
    return dealt.groupBy(block, "way").agg(F.collect_list(name).alias(to)).drop("way")


def tiled(source: DataFrame, target: DataFrame, block: str, name: str, other: str, most: float) -> DataFrame:
    """block, name, other, cost: all pairs of a block that cost `most` or less, each chunk of names against each of others. Tiles of few pairs are rows."""
    tiles = chunks(source, block, name, "names").join(chunks(target, block, other, "others").hint("merge"), block)
    few = F.size("names") * F.size("others") <= FEW
    small = tiles.filter(few).select(block, F.explode("names").alias(name), "others").select(block, name, F.explode("others").alias(other))
    small = small.withColumn("cost", cost(F.col(name), F.col(other))).filter(F.col("cost") <= most)
    schema = StructType([source.schema[block], source.schema[name], target.schema[other]]).add("cost", DoubleType())
    ways = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    large = tiles.filter(~few).select(block, "names", "others").repartition(ways)

    def compared(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for row in range(batch.num_rows):
                names, others = (batch.column(c)[row].values for c in (1, 2))
                for a, b, costs in alike(names.to_pylist(), others.to_pylist(), most):
                    key = batch.column(0).take(pa.array(np.full(len(a), row)))
                    yield pa.RecordBatch.from_arrays([key, names.take(pa.array(a)), others.take(pa.array(b)), pa.array(costs)], names=[block, name, other, "cost"])

    return small.unionByName(large.mapInArrow(compared, schema))


def alike(names: list[str], others: list[str], most: float):
    """Of all pairs of two lists, in turn: places in the first, in the second, and costs of those of `most` or less."""
    import numpy as np

    every, at = np.unique(np.frombuffer("".join([*names, *others]).encode("utf-32-le"), np.uint32), return_inverse=True)
    times = np.bincount(at, minlength=len(every))
    rank = np.argsort(np.argsort(-times, kind="stable"), kind="stable")[at]  # frequent characters have bits of their own
    a, b = by_length(names, rank[: sum(map(len, names))]), by_length(others, rank[sum(map(len, names)) :])
    for la, (ia, ca) in a.items():
        for lb, (ib, cb) in b.items():
            longer = max(la, lb)
            k = int(np.floor(longer * most + 1e-9))
            if abs(la - lb) > k:
                continue
            if not longer:
                x, y = (v.ravel() for v in np.meshgrid(ia, ib, indexing="ij"))
                yield x, y, np.zeros(len(x))
                continue
            for x, y in may_be(ca, cb, k):
                d = distances(ca, cb, x, y, len(every))
                costs = d / float(longer)
                near = np.flatnonzero((d <= k) & (costs <= most))
                if len(near):
                    yield ia[x[near]], ib[y[near]], costs[near]


def by_length(names: list[str], codes) -> dict:
    """For each length, the places of its names and their characters as a matrix."""
    import numpy as np

    n = np.array([len(x) for x in names])
    starts = np.cumsum(n) - n
    return {int(m): (at := np.flatnonzero(n == m), codes[starts[at][:, None] + np.arange(m)]) for m in np.unique(n)}


def character_bits(codes, classes: int, levels: int):
    """A name's characters as bits: for each class of characters as many as it has of it, up to `levels`. An edit sets one at most, and clears one."""
    import numpy as np

    n = len(codes)
    counts = np.bincount((np.arange(n)[:, None] * classes + codes % classes).ravel(), minlength=n * classes).reshape(n, classes)
    ones = (np.uint64(1) << np.minimum(counts, levels).astype(np.uint64)) - np.uint64(1)
    return np.bitwise_or.reduce(ones << (np.arange(classes) * levels).astype(np.uint64), axis=1)


def gram_bits(codes):
    """A name's grams of two, its ends included, as two words of bits. An edit sets two bits at most, and clears two."""
    import numpy as np

    edge = np.full((len(codes), 1), -1)
    c = np.concatenate([edge, codes, edge], axis=1) + 2
    h = ((c[:, :-1] * 1_000_003 + c[:, 1:]) * 2_654_435_761 >> 16) % 128
    bit = np.uint64(1) << (h % 64).astype(np.uint64)
    return [np.bitwise_or.reduce(np.where(h // 64 == w, bit, np.uint64(0)), axis=1) for w in (0, 1)]


def may_be(ca, cb, k: int):
    """Pairs of rows, up to SLICE at a time, of all that bits don't show to be more than k edits apart."""
    import numpy as np

    turned = ca.shape[1] < cb.shape[1]  # what the longer name has and the other lacks is the greater
    p, o = (cb, ca) if turned else (ca, cb)
    bits_p, bits_o = [[character_bits(c, 16, 4), character_bits(c, 32, 2), *gram_bits(c)] for c in (p, o)]
    lacks, n = ~bits_o[0], len(o)
    step = max(1, 2 * SLICE // n)
    both, count = np.empty((step, n), np.uint64), np.empty((step, n), np.uint8)
    held, size = [], 0
    for start in range(0, len(p), step):
        rows = min(step, len(p) - start)
        np.bitwise_and(bits_p[0][start : start + rows, None], lacks, out=both[:rows])
        np.bitwise_count(both[:rows], out=count[:rows])
        x, y = np.divmod(np.flatnonzero(count[:rows].ravel() <= k), n)
        x += start
        fewer = lambda w, a, b: np.bitwise_count(bits_p[w][a] & ~bits_o[w][b])
        more = lambda w, a, b: np.bitwise_count(bits_o[w][b] & ~bits_p[w][a])
        keep = fewer(1, x, y) <= k
        x, y = x[keep], y[keep]
        keep = (fewer(2, x, y) + fewer(3, x, y) <= 2 * k) & (more(2, x, y) + more(3, x, y) <= 2 * k)
        held.append((x[keep], y[keep]))
        size += len(held[-1][0])
        if size >= SLICE or start + rows == len(p):
            x, y = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            for i in range(0, size, SLICE):
                yield (y[i : i + SLICE], x[i : i + SLICE]) if turned else (x[i : i + SLICE], y[i : i + SLICE])
            held, size = [], 0


def distances(ca, cb, x, y, alphabet: int):
    """Edit distances of the rows x of ca to the rows y of cb, in step: the columns of the table as bits (Myers, Hyyro) for names of up to 64 characters."""
    import numpy as np

    m, n = ca.shape[1], cb.shape[1]
    if m == 0 or n == 0:
        return np.full(len(x), max(m, n))
    if m > 64 or alphabet > 256:
        row = [np.full(len(x), j, np.int32) for j in range(n + 1)]
        for i in range(m):
            new = [np.full(len(x), i + 1, np.int32)]
            for j in range(n):
                new.append(np.minimum(np.minimum(row[j] + (ca[x, i] != cb[y, j]), row[j + 1] + 1), new[j] + 1))
            row = new
        return row[n]
    word = np.uint32 if m <= 32 else np.uint64
    one = word(1)
    equal = np.zeros((len(ca), alphabet), word)
    at = np.arange(len(ca))
    for i in range(m):
        equal[at, ca[:, i]] |= word(1 << i)
    equal, base, columns, last = equal.ravel(), x * alphabet, np.ascontiguousarray(cb.T), word(m - 1)
    plus, minus = np.full(len(x), np.iinfo(word).max, word), np.zeros(len(x), word)
    score = np.full(len(x), m, word)
    for j in range(n):
        eq = equal.take(base + columns[j].take(y))
        xv = eq | minus
        xh = ((eq & plus) + plus ^ plus) | eq
        up = minus | ~(xh | plus)
        down = plus & xh
        score += up >> last & one
        score -= down >> last & one
        up = up << one | one
        down <<= one
        plus = down | ~(xv | up)
        minus = up & xv
    return score.astype(np.int64)
