"""Groups of speakers as of a position, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from narrata.operators import identities
from narrata.plans.dialogue_queries import query
from narrata.sources.model import frame, with_sql

#: Revisions by the given facts: later ones move a book's quotes on, and rename what they made. Of each book, what a reader at 400 sees.
PATHS = with_sql("facts").replace("WITH ", "WITH RECURSIVE ", 1) + """, rn AS (SELECT book AS version, person * 10 + idx AS age, 0 AS seq, 'g' || (person * 7 + idx) % 12 AS new, 'g' || (person * 5 + idx * 3) % 12 AS old FROM facts WHERE visible_from_cp > 400),
r AS (SELECT * FROM rn WHERE new <> old), mv AS (SELECT book AS version, person * 10 + idx AS age, 'q' || person % 9 AS quote_id, 'g' || (person + idx) % 12 AS old FROM facts WHERE visible_from_cp > 400),
q AS (SELECT version, quote_id, max(age) AS age, arg_max(old, age) AS old FROM mv GROUP BY 1, 2),
way AS (SELECT version, quote_id, age, false AS strict, old AS cur FROM q UNION ALL SELECT w.version, w.quote_id, n.age, true, n.old FROM way w JOIN r n ON n.version = w.version AND n.new = w.cur
  WHERE n.age = (SELECT min(x.age) FROM r x WHERE x.version = w.version AND x.new = w.cur AND (x.age > w.age OR x.age = w.age AND NOT w.strict)))
"""


@query(PATHS + "SELECT version, quote_id, arg_max(cur, (age, strict)) AS \"group\" FROM way GROUP BY 1, 2")
def d17_rewritten_paths(s, d):
    """The group of each quote before the revisions that a position doesn't see: the newest are taken back first, and lead on to older ones."""
    f = frame(s, d, "facts")
    name = lambda x: F.concat(F.lit("g"), (x % 12).cast("string"))
    p, i = F.col("person"), F.col("idx")
    base = f.select(F.col("book").alias("version"), (p * 10 + i).alias("age"), "visible_from_cp", p.alias("p"), i.alias("i"))
    p, i = F.col("p"), F.col("i")
    moves = base.select("version", "age", "visible_from_cp", F.concat(F.lit("q"), (p % 9).cast("string")).alias("quote_id"), name(p + i).alias("old"))
    renames = base.select("version", "age", "visible_from_cp", F.lit(0).alias("seq"), name(p * 7 + i).alias("new"), name(p * 5 + i * 3).alias("old"))
    return identities.reverted(moves, renames, F.lit(400))[0]


@query(with_sql("outputs") + """, b AS (SELECT book AS split, CASE WHEN length(quote_id) > 0 AND turn < 3 THEN 0 ELSE 1 END AS bucket, quote_id, speaker, turn FROM outputs WHERE turn <> 4 AND (speaker = 'user' OR book % 3 = 0)),
bad AS (SELECT split FROM b GROUP BY 1 HAVING count(DISTINCT speaker) > 1)
SELECT split, quote_id, speaker AS old, 'split/' || split || '/' || bucket AS new FROM b WHERE split NOT IN (SELECT split FROM bad)""")
def d29_speaker_split(s, d):
    """A group's quotes in buckets, each a group of its own; a split of more than one group is refused."""
    o = frame(s, d, "outputs")
    buckets = o.filter("turn <> 4 AND (speaker = 'user' OR book % 3 = 0)").select(F.col("book").alias("split"), F.when(F.col("turn") < 3, 0).otherwise(1).alias("bucket"), "quote_id")
    return identities.split(buckets, o.select("quote_id", F.col("speaker").alias("group")))[0]
