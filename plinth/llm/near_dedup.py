"""Near-duplicate groups by ProbMinHash, banding and verification.

Each weighted five-word shingle is a Poisson process whose rate is its weight; its arrivals fall on random registers, and a
register keeps the shingle that arrives there first. Generation stops for a shingle as soon as its next arrival is later than
all registers hold. Registers of two texts agree with the probability Jaccard similarity of their weighted shingles. Links
are decided by the Jaccard similarity of shingle sets, so each distinct shingle has weight 1 here: then the two are the
same number, and a line that one copy repeats doesn't hide it from the search.

Exact copies (equal words) are one class from the start, by a combining aggregation. Bands of registers put class representatives
into buckets. Each member of a bucket is first compared with one leader, another one in each band, and what the exact Jaccard of their
shingle sets confirms is linked. Then all pairs of a bucket that are not connected yet are compared exactly, in blocks of bounded
size that are dealt to the tasks with the shingle sets (large buckets are known by a broadcast, not moved to one task): members of the bucket's largest group meet only those outside it, so a bucket of any
size whose members are alike costs one comparison a member, and a block gives back only links that connect, one a member at most. So
every two documents that share a bucket are connected or have been compared. Groups are the connected components of the verified
links, by alternating large and small stars on tables in the shared folder.

Defined results: texts without words (null, empty, symbols only) are groups of their own. Texts of fewer than five words are one
shingle. The id of a class or group is the least doc_id in it (null ids first; a null id is given as null, and so would be -2^63). Equal rows
(same id and text) are one document and all get the same row. Only doc_id and text are read; `clean` passes further columns through. Whole texts count.
"""

from __future__ import annotations

import re
import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import boxed, joined_by_count, map_slices, materialise, row_key, shards, table, unboxed

WORDS = re.compile(r"[^\W_]+")
SHINGLE = 5
#: 20 bands of 5 registers find a pair at 0.8 with probability 0.9996.
BANDS, ROWS = 20, 5
REGISTERS = BANDS * ROWS
#: Share of agreeing registers (standard error 0.04) from which a pair is verified.
CANDIDATE = 0.64
#: Shingles of a bucket's members that a block holds on each of its two sides (one member at least).
BLOCK = 100_000
U = np.uint64
M1, M2, M3 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * M2
    x = (x ^ (x >> U(27))) * M3
    return x ^ (x >> U(31))


class Shingler:
    """Texts -> hashes of their shingles, with a bounded cache of word hashes."""

    def __init__(self, most: int = 400_000):
        self.known: dict[str, int] = {}
        self.most = most

    def __call__(self, texts: list[str | None]) -> tuple[list[list[str]], list[np.ndarray]]:
        from xxhash import xxh3_64_intdigest

        split = [WORDS.findall(t.lower()) if t else [] for t in texts]
        distinct = {w for s in split for w in s}
        if len(self.known) > self.most:
            self.known = {}
        self.known.update((w, xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))) for w in distinct if w not in self.known)
        out = []
        for s in split:
            h = np.fromiter(map(self.known.__getitem__, s), U, len(s))
            width = min(SHINGLE, len(h))
            x = np.zeros(max(len(h) - width + 1, 0) if width else 0, U)
            for i in range(width):
                x = mixed(x * M1 + h[i : i + len(x)])
            out.append(x)
        return split, out


def signatures(shingles: list[np.ndarray], registers: int) -> tuple[np.ndarray, np.ndarray]:
    """ProbMinHash of each multiset of shingles (32 bits of the shingle that came first, by register), and how many are distinct."""
    n = len(shingles)
    doc = np.repeat(np.arange(n), [len(x) for x in shingles])
    flat = np.concatenate(shingles) if n else np.zeros(0, U)
    order = np.lexsort((flat, doc))
    doc, flat = doc[order], flat[order]
    new = np.concatenate([[True], (flat[1:] != flat[:-1]) | (doc[1:] != doc[:-1])]) if len(flat) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    weight = np.diff(np.append(at, len(flat))).astype(float)
    doc, flat = doc[at], flat[at]
    first = np.full(n * registers, np.inf)
    sig = np.zeros(n * registers, U)
    time, turn = np.zeros(len(flat)), np.zeros(1, U)
    distinct = np.bincount(doc, minlength=n)
    while len(flat):
        turn += M1
        x = mixed(flat + turn)
        time = time - np.log(((x >> U(32)).astype(float) + 0.5) * 2.0**-32) / weight
        place = doc * registers + (((x & U(0xFFFFFFFF)) * U(registers)) >> U(32)).astype(np.int64)
        better = np.flatnonzero(time < first[place])
        better = better[np.argsort(-time[better], kind="stable")]  # the earliest is written last
        first[place[better]] = time[better]
        sig[place[better]] = flat[better]
        latest = first.reshape(n, registers).max(axis=1)
        on = time < latest[doc]
        flat, doc, weight, time = flat[on], doc[on], weight[on], time[on]
    return (sig >> U(32)).astype(np.uint32).view(np.int32).reshape(n, registers), distinct


def sketches(docs: DataFrame, registers: int = REGISTERS) -> DataFrame:
    """k_id, k_text, c1, c2 (hash of the words in order), size (distinct shingles) and sig of each document with words."""

    def factory():
        from xxhash import xxh3_128_intdigest

        shingler = Shingler()

        def run(columns):
            ids, keys, texts = columns
            words, shingles = shingler(texts)
            pick = [i for i, w in enumerate(words) if w]
            sig, distinct = signatures([np.unique(shingles[i]) for i in pick], registers)
            whole = [xxh3_128_intdigest(" ".join(words[i]).encode("utf-8", "surrogatepass")) for i in pick]
            signed = np.array([[x >> 64, x & (2**64 - 1)] for x in whole], U).reshape(-1, 2).view(np.int64)
            return {"k_id": [ids[i] for i in pick], "k_text": [keys[i] for i in pick], "c1": signed[:, 0], "c2": signed[:, 1], "size": distinct, "sig": list(sig)}

        return run

    rows = docs.select(*row_key(F.col("doc_id"), F.col("text")), "text").filter("text is not null")
    return map_slices(rows, "k_id long, k_text long, c1 long, c2 long, size long, sig array<int>", factory, 2, 1 << 21)


def node(prefix: str = "k") -> Column:
    return F.struct(F.col(f"{prefix}_id").alias("id"), F.col(f"{prefix}_text").alias("text"))


def buckets(reps: DataFrame) -> DataFrame:
    """band, key, n, of (distinct shingles) of each representative and band."""
    rows = reps.select(F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band"), "sig", node().alias("n"), F.col("size").alias("of"))
    key = F.xxhash64("band", F.slice("sig", F.col("band") * ROWS + 1, ROWS))
    return rows.select("band", key.alias("key"), "n", "of")


def led(rows: DataFrame, sig: DataFrame) -> DataFrame:
    """a, b: the members of buckets that look like their bucket's leader, with it (a > b)."""
    rank = F.struct(F.xxhash64("band", "n.id", "n.text").alias("h"), F.col("n").alias("n"))
    leads = rows.groupBy("band", "key").agg(F.min(rank).alias("lead"), F.count("*").alias("size")).filter("size > 1").select("band", "key", "size", F.col("lead.n").alias("lead"))
    pairs = joined_by_count(rows, materialise(leads), ["band", "key"], "size", rows.count()).filter("n <> lead").select(F.greatest("n", "lead").alias("a"), F.least("n", "lead").alias("b")).distinct()
    alike = F.size(F.filter(F.zip_with("s1", "s2", lambda x, y: x == y), lambda z: z)) / F.lit(float(REGISTERS))
    both = materialise(pairs).join(sig.select(F.col("n").alias("a"), F.col("sig").alias("s1")), "a").join(sig.select(F.col("n").alias("b"), F.col("sig").alias("s2")), "b")
    return both.filter(alike >= CANDIDATE).select("a", "b")


def blocks(rows: DataFrame, roots: DataFrame, block: int) -> DataFrame:
    """band, key, i, j, c, n, root: the members of buckets of three and more that are not all connected, in each block (i, j) that they
    belong to as part c. Pairs are those of two parts, or those within one where i = j. Buckets of two have met as member and leader."""
    total = rows.count()
    rows = rows.join(roots, "n", "left").select("band", "key", "n", "of", F.coalesce("root", "n").alias("root"))
    per = rows.groupBy("band", "key", "root").agg(F.sum("of").alias("of"), F.count("*").alias("members"))
    size = per.groupBy("band", "key").agg(F.sum("of").alias("size"), F.sum("members").alias("members"), F.count("*").alias("roots"), F.max(F.struct("of", "root")).alias("main"))
    open_ = materialise(size.filter("members > 2 and roots > 1").select("band", "key", "size", "members", F.col("main.root").alias("main"), F.col("main.of").alias("mains")))
    one = F.col("size") <= block
    rest = F.when(one, 1).otherwise(F.ceil((F.col("size") - F.col("mains")) / block)).cast("int")
    parts = F.when(one, 1).otherwise(rest + F.ceil(F.col("mains") / block)).cast("int")
    dealt = joined_by_count(rows, open_, ["band", "key"], "members", total).withColumns({"rest": rest, "parts": parts, "is_main": (F.col("root") == F.col("main")) & ~one, "h": F.xxhash64("n.text", "n.id")})
    c = F.when(F.col("is_main"), F.col("rest") + F.pmod("h", F.col("parts") - F.col("rest"))).otherwise(F.pmod("h", F.col("rest"))).cast("int")
    meets = F.explode(F.sequence(F.lit(0), F.when(F.col("is_main"), F.col("rest")).otherwise(F.col("parts")) - 1)).alias("x")
    return dealt.withColumn("c", c).select("band", "key", "n", "root", "c", meets).select("band", "key", F.least("c", "x").alias("i"), F.greatest("c", "x").alias("j"), "c", "n", "root")


def connecting(ids: np.ndarray, sets: list[np.ndarray], same: bool, part: int, similarity: float) -> list[tuple[int, int]]:
    """Pairs of rows of a block that are similar, as many as it takes to connect all that are. ids: part, and root (two columns), of each row."""
    label = np.unique(ids[:, 1:], axis=0, return_inverse=True)[1].ravel()
    left = np.arange(len(ids)) if same else np.flatnonzero(ids[:, 0] == part)
    right = left if same else np.flatnonzero(ids[:, 0] != part)
    if not len(left) or not len(right) or label.max() == 0:
        return []
    size = np.array([len(x) for x in sets])
    number = np.unique(np.concatenate(sets), return_inverse=True)[1].ravel()
    ends = np.cumsum(size)
    own = [number[e - n : e] for e, n in zip(ends, size)]
    others, starts = np.concatenate([own[o] for o in right]), np.cumsum(size[right]) - size[right]
    here, out = np.zeros(number.max() + 1, bool), []
    for k in left:
        if (label[right] == label[k]).all():
            continue
        here[own[k]] = True
        both = np.add.reduceat(here[others], starts, dtype=np.int64)
        here[own[k]] = False
        for o in right[(both >= (size[right] + size[k] - both) * similarity) & (label[right] != label[k])]:
            if label[o] != label[k]:
                out.append((k, o))
                label[label == label[o]] = label[k]
    return out


def alike_in_blocks(rows: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """a, b: links that connect all similar rows of a block (a > b). Rows come sorted by block, and a task holds one block."""

    def run(batches):
        import pyarrow as pa

        block, ids, sets = None, [], []

        def links():
            if ids:
                rows = np.concatenate(ids)
                found = connecting(rows[:, 2:], sets, block[2] == block[3], block[2], similarity)
                pairs = [sorted((tuple(rows[a, :2].tolist()), tuple(rows[b, :2].tolist()))) for a, b in found]
                yield pa.RecordBatch.from_pydict({k: pa.array([p[i][j] for p in pairs], pa.int64()) for k, i, j in (("a_id", 1, 0), ("a_text", 1, 1), ("b_id", 0, 0), ("b_text", 0, 1))})

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.column_stack([batch.column(i).to_numpy().astype(np.int64) for i in range(4)])
            own = np.column_stack([batch.column(i).to_numpy().astype(np.int64) for i in (5, 6, 4, 7, 8)])
            flat, at = batch.column(9).flatten().to_numpy(), np.concatenate([[0], np.cumsum(batch.column(9).value_lengths().to_numpy())])
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for start, end in zip([0, *cuts], [*cuts, len(own)]):
                now = tuple(keys[start].tolist())
                if now != block:
                    yield from links()
                    block, ids, sets = now, [], []
                ids.append(own[start:end])
                sets += [flat[at[r] : at[r + 1]].copy() for r in range(start, end)]
        yield from links()

    flat = rows.join(sets, "n").select("band", "key", "i", "j", "c", F.col("n.id").alias("id"), F.col("n.text").alias("text"), F.col("root.id").alias("root_id"), F.col("root.text").alias("root_text"), "set")
    placed = flat.repartition(shards(rows), "band", "key", "i", "j").sortWithinPartitions("band", "key", "i", "j")
    found = placed.mapInArrow(run, "a_id long, a_text long, b_id long, b_text long")
    return found.select(node("a").alias("a"), node("b").alias("b")).distinct()


def linked(reps: DataFrame, docs: DataFrame, similarity: float, block: int = BLOCK) -> DataFrame:
    """a, b: verified links that connect all representatives that share a bucket and are similar, directly or by others."""
    sig = reps.select(node().alias("n"), "sig")
    rows = materialise(buckets(reps))
    sure = materialise(verified(materialise(led(rows, sig)), docs, similarity))
    left = materialise(blocks(rows, materialise(components(sure)), block))
    more = alike_in_blocks(left, sets_of(left.select("n").distinct(), docs), similarity)
    return sure.unionByName(materialise(more))


def sets_of(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """n, set: the distinct shingles of these documents."""
    wanted = materialise(nodes.select(F.col("n.id").alias("k_id"), F.col("n.text").alias("k_text")))
    texts = docs.select(*row_key(F.col("doc_id"), F.col("text")), "text").join(wanted, ["k_id", "k_text"], "left_semi").dropDuplicates(["k_id", "k_text"])

    def factory():
        shingler = Shingler()

        def run(columns):
            return {"k_id": columns[0], "k_text": columns[1], "set": [np.unique(x).view(np.int64) for x in shingler(columns[2])[1]]}

        return run

    return materialise(map_slices(texts, "k_id long, k_text long, set array<long>", factory, 2)).select(node().alias("n"), "set")


def verified(pairs: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose sets of shingles have at least this Jaccard similarity."""
    sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("n")).distinct(), docs)
    joined = pairs.join(sets.select(F.col("n").alias("a"), F.col("set").alias("s1")), "a").join(sets.select(F.col("n").alias("b"), F.col("set").alias("s2")), "b")
    both = F.size(F.array_intersect("s1", "s2"))
    return joined.select("a", "b", both.alias("both"), (F.size("s1") + F.size("s2") - both).alias("either")).filter(F.col("both") >= F.col("either") * similarity).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """n, root: the least node of each linked node's component, by alternating large and small stars."""
    edges = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = materialise(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = materialise(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(least.select("u", F.col("m").alias("v")))
        edges = materialise(small.distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select(F.col("u").alias("n"), F.col("v").alias("root"))
        before = now


def groups(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """k_id, k_text, class and group (ids, and the text keys of their first documents) of each document with words."""
    found = materialise(sketches(docs))
    reps = materialise(found.groupBy("c1", "c2").agg(F.min(F.struct("k_id", "k_text", "size", "sig")).alias("r")).select("c1", "c2", "r.k_id", "r.k_text", "r.size", "r.sig"))
    links = materialise(linked(reps, docs, similarity))
    roots = materialise(components(links))
    named = materialise(reps.select("c1", "c2", node().alias("n")).join(roots, "n", "left").select("c1", "c2", "n", F.coalesce("root", "n").alias("root")))
    return found.select("k_id", "k_text", "c1", "c2").join(named, ["c1", "c2"]).select("k_id", "k_text", F.col("n").alias("class"), F.col("root").alias("group"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = groups(docs).dropDuplicates(["k_id", "k_text"])
    rows = docs.select("doc_id", *row_key(F.col("doc_id"), F.col("text")))
    out = rows.join(found, ["k_id", "k_text"], "left")
    shown = lambda c: F.when(F.col(c).isNull(), F.col("doc_id")).otherwise(F.nullif(F.col(f"{c}.id"), F.lit(-(1 << 63))))
    return out.select("doc_id", shown("class").alias("class_id"), shown("group").alias("group_id"), (F.col("group").isNull() | (F.col("group") == node())).alias("first"))


def clean(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """One document of each group, the one with the least id, with its columns. Rows repeated with the same id and text are one document:
    the least row stays (by all columns; the first one met where a column's type has no order). Only rows of repeated keys are shuffled for that."""
    gone = groups(docs, similarity).filter(F.col("group") != node()).select("k_id", "k_text").distinct()
    own = [*row_key(F.col("doc_id"), F.col("text")), F.col("doc_id").isNull().alias("no_id"), F.col("text").isNull().alias("no_text")]
    again = docs.select(*own).groupBy("k_id", "k_text", "no_id", "no_text").agg(F.count("*").alias("n")).filter("n > 1").select("k_id", "k_text").distinct()
    both = gone.withColumn("drop", F.lit(True)).unionByName(again.withColumn("drop", F.lit(False)))
    marks = materialise(both.groupBy("k_id", "k_text").agg(F.max("drop").alias("drop")))
    left = boxed(docs).join(marks, ["k_id", "k_text"], "left")
    repeated = left.filter("drop = false").groupBy("k_id", "k_text", F.col("doc_id").isNull(), F.col("text").isNull())
    least = F.first("row") if "map<" in docs.schema.simpleString() or "variant" in docs.schema.simpleString() else F.min("row")
    out = left.filter("drop is null").select("row").unionByName(repeated.agg(least.alias("row")).select("row"))
    return out.select(*unboxed(out, docs.columns))
