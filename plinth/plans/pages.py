"""Queries that find things on pages: tokens of all documents with their places, and all embeddings as rows of pixels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import layout, similar
from .base import Tables, query

TOKENS = """l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
k AS (SELECT doc_id, line, unnest(string_split(s, ' ')) AS token, generate_subscripts(string_split(s, ' '), 1) AS pos FROM l),
p AS (SELECT doc_id, line, pos, token, (coalesce(sum(length(token) + 1) OVER (PARTITION BY doc_id, line ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS l FROM k),
t AS (SELECT doc_id, line, l AS "left", l + length(token) AS "right", token, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) AS n FROM p WHERE token <> '')"""

#: A token's figures are the digits of its length, and a document looks for one number of three digits.
HITS = f"""{TOKENS},
f AS (SELECT *, length(token)::VARCHAR AS digits, ("left" * 7 + length(token)) % 100 AS confidence, (100 + doc_id % 900)::VARCHAR AS number FROM t),
h AS (SELECT doc_id, line, "left", "right", confidence::DOUBLE AS mean_confidence, 1 AS n_tokens FROM f WHERE digits = number
  UNION ALL SELECT a.doc_id, a.line, a."left", b."right", round((a.confidence + b.confidence) / 2, 2), 2 FROM f a JOIN f b ON a.doc_id = b.doc_id AND a.line = b.line AND b.n = a.n + 1 WHERE a.digits || b.digits = a.number AND b."left" - a."right" <= 1
  UNION ALL SELECT a.doc_id, a.line, a."left", c."right", round((a.confidence + b.confidence + c.confidence) / 3, 2), 3 FROM f a JOIN f b ON a.doc_id = b.doc_id AND a.line = b.line AND b.n = a.n + 1 JOIN f c ON a.doc_id = c.doc_id AND a.line = c.line AND c.n = a.n + 2
    WHERE a.digits || b.digits || c.digits = a.number AND b."left" - a."right" <= 1 AND c."left" - b."right" <= 1)"""


def hits(t: Tables):
    k = layout.tokens(t.documents, "doc_id", "text").withColumns({"digits": F.length("token").cast("string"), "confidence": (F.col("left") * 7 + F.length("token")) % 100})
    wanted = t.documents.select("doc_id", (100 + F.col("doc_id") % 900).cast("string").alias("number"))
    return layout.joined_hits(k, wanted, "doc_id", "digits", "number", 3, (-15, 1))


@query("q_joined_tokens", f"""WITH {HITS} SELECT doc_id, line::INTEGER AS line, "left", "right", mean_confidence, n_tokens FROM h""")
def joined_tokens(t: Tables):
    return hits(t)


@query(
    "q_thinned_hits",
    f"""WITH RECURSIVE {HITS}, o AS (SELECT *, ("left" + "right") / 2 AS x, row_number() OVER (PARTITION BY doc_id ORDER BY mean_confidence DESC, line, "left", n_tokens) AS k FROM h),
    r(doc_id, k, kept, keep) AS (SELECT doc_id, k, [{{'x': x, 'y': line}}], true FROM o WHERE k = 1
      UNION ALL SELECT o.doc_id, o.k, CASE WHEN len(list_filter(r.kept, lambda e: abs(e.x - o.x) <= 35 AND abs(e.y - o.line) <= 2)) = 0 THEN list_append(r.kept, {{'x': o.x, 'y': o.line}}) ELSE r.kept END,
        len(list_filter(r.kept, lambda e: abs(e.x - o.x) <= 35 AND abs(e.y - o.line) <= 2)) = 0 FROM r JOIN o ON o.doc_id = r.doc_id AND o.k = r.k + 1)
    SELECT doc_id, line::INTEGER AS line, "left", "right", mean_confidence, n_tokens FROM o JOIN r USING (doc_id, k) WHERE keep""",
)
def thinned_hits(t: Tables):
    """Of hits that lie close together, the most certain."""
    best = [-F.col("mean_confidence"), F.col("line"), F.col("left"), F.col("n_tokens")]
    return layout.thinned(hits(t), "doc_id", (F.col("left") + F.col("right")) / 2, F.col("line"), best, (35.0, 2.0))


#: Images of 50 vectors, one a row; a row is dark at a threshold if 55 % of its values are below it.
DARK = """v AS (SELECT vec_id // 50 AS image, vec_id % 50 AS y, unnest(embedding)::DOUBLE AS value FROM embeddings),
h AS (SELECT image, y, count(*) AS n, count(*) FILTER (value < -0.01) AS n0, count(*) FILTER (value < 0.0) AS n1, count(*) FILTER (value < 0.01) AS n2 FROM v GROUP BY ALL),
d AS (SELECT image, y, threshold FROM (SELECT image, y, n, unnest([n0, n1, n2]) AS dark, unnest([0, 1, 2]) AS threshold FROM h) WHERE dark >= n * 0.55),
i AS (SELECT image, threshold, y - row_number() OVER (PARTITION BY image, threshold ORDER BY y) AS run, y FROM d),
g AS (SELECT image, threshold, min(y) AS y0, max(y) AS y1, (min(y) + max(y)) / 2 AS centre FROM i GROUP BY image, threshold, run),
s AS (SELECT *, CASE WHEN centre - lag(centre) OVER (PARTITION BY image, threshold ORDER BY y0) BETWEEN 2 AND 6 THEN 0 ELSE 1 END AS new FROM g),
u AS (SELECT *, sum(new) OVER (PARTITION BY image, threshold ORDER BY y0) AS run FROM s),
w AS (SELECT image, threshold, min(y0) AS y0, max(y1) AS y1, count(*) AS lines FROM u GROUP BY image, threshold, run HAVING count(*) >= 2),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image, threshold ORDER BY lines DESC, y0) AS k FROM w) WHERE k = 1)"""


def bands(t: Tables):
    v = t.embeddings.select(F.floor(F.col("vec_id") / 50).cast("long").alias("image"), (F.col("vec_id") % 50).alias("y"), F.explode("embedding").alias("value"))
    dark = layout.dark_rows(v, "image", "y", F.col("value").cast("double"), [-0.01, 0.0, 0.01], 0.55)
    return layout.stable_run(layout.lines_of(dark, ["image", "threshold"], "y"), ["image", "threshold"], (2, 6), 2)


@query("q_dark_bands", f"WITH {DARK} SELECT image, threshold, y0, y1, lines FROM b")
def dark_bands(t: Tables):
    return bands(t)


@query(
    "q_threshold_vote",
    f"""WITH {DARK}, c AS (SELECT image, y0, least(lines * 20, 100) AS confidence FROM b), n AS (SELECT image, y0, count(*) AS n, avg(confidence) AS mean, max(confidence) AS top FROM c GROUP BY ALL),
    m AS (SELECT image, y0, mean, n FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY n DESC, y0) AS k FROM n) WHERE k = 1),
    f AS (SELECT image, y0, top, second FROM (SELECT *, lead(top) OVER (PARTITION BY image ORDER BY top DESC, y0 DESC) AS second, row_number() OVER (PARTITION BY image ORDER BY top DESC, y0 DESC) AS k FROM n) WHERE k = 1)
    SELECT image, CASE WHEN n >= 2 THEN m.y0 WHEN top >= 80 AND (second IS NULL OR second < 50) THEN f.y0 END AS y0, CASE WHEN n >= 2 THEN mean WHEN top >= 80 AND (second IS NULL OR second < 50) THEN top END::DOUBLE AS confidence,
      CASE WHEN n >= 2 THEN 'consensus' WHEN top >= 80 AND (second IS NULL OR second < 50) THEN 'dominance' ELSE 'weak or conflicting' END AS decision FROM m JOIN f USING (image)""",
)
def threshold_vote(t: Tables):
    """Where each image's band begins, as its thresholds agree."""
    return layout.decided(bands(t).withColumn("confidence", F.least(F.col("lines") * 20, F.lit(100)).cast("double")), "image", "y0", "confidence", 80, 50)


#: Three labels sought in this order.
LABELS = ["the", "and", "with"]
PHRASES = f"""{TOKENS},
x AS (SELECT *, CASE WHEN n = 1 OR lag(right(token, 1)) OVER w IN ('.', ',', '|') OR "left" - lag("right") OVER w > 1 THEN 1 ELSE 0 END AS new FROM t WINDOW w AS (PARTITION BY doc_id, line ORDER BY "left")),
y AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, line ORDER BY "left") AS part FROM x),
z AS (SELECT doc_id, line, min("left") AS "left", max("right") AS "right", string_agg(token, ' ' ORDER BY "left") AS phrase FROM y GROUP BY doc_id, line, part)"""


@query("q_phrases", f'WITH {PHRASES} SELECT doc_id, line::INTEGER AS line, "left", "right", phrase FROM z')
def phrases(t: Tables):
    k = layout.tokens(t.documents, "doc_id", "text")
    return layout.phrases(k, "doc_id", F.right("token", F.lit(1)).isin(".", ",", "|"), 1)


@query(
    "q_ordered_labels",
    rf"""WITH {TOKENS}, c AS (SELECT doc_id, line, "left" AS x, field, 100 - round(100 * levenshtein(regexp_replace(token, '[^\x00-\x7F]', '?', 'g'), label) / greatest(length(token), length(label)))::BIGINT AS score FROM t, (VALUES (0, 'the'), (1, 'and'), (2, 'with')) v(field, label)),
    d AS (SELECT * FROM c WHERE score >= 50),
    e AS (SELECT a.doc_id, a.line, a.score + b.score + c.score AS score, a.x AS x0, b.x AS x1, c.x AS x2 FROM d b JOIN d a ON a.doc_id = b.doc_id AND a.line = b.line AND a.x <= b.x - 10 JOIN d c ON c.doc_id = b.doc_id AND c.line = b.line AND c.x BETWEEN b.x + 10 AND b.x + 60
      WHERE a.field = 0 AND b.field = 1 AND c.field = 2)
    SELECT doc_id, line::INTEGER AS line, score::DOUBLE AS score, x0, x1, x2 FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, line, x0, x1, x2) AS k FROM e) WHERE k = 1""",
)
def ordered_labels(t: Tables):
    """The best place of three labels in order, of all words that are like one of them."""
    k = layout.tokens(t.documents, "doc_id", "text")
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("field"), F.lit(x).alias("label")) for i, x in enumerate(LABELS)]))
    near = F.abs(F.length("token") - F.length("e.label")) <= F.greatest(F.length("token"), F.length("e.label")) * 0.51  # others can't be like a label
    c = k.select("doc_id", "line", F.col("left").alias("x"), "token", each.alias("e")).filter(near)
    score = (100 - F.round(100 * similar.cost(F.regexp_replace("token", r"[^\x00-\x7F]", "?"), F.col("e.label")))).cast("double")
    return layout.best_triples(c.select("doc_id", "line", "x", "e.field", score.alias("score")).filter("score >= 50"), "doc_id", 10, (10, 60))
