"""Filter interaction audit: what each filter removes at each step of every order, by recursive enumeration of prefixes.

A document's mask has one bit for each filter that it fails. Documents are counted by part and mask, as cells; a
recursive query then grows prefixes of filters, one unused letter at a time. It carries the bits applied so far and meets
every mask that occurs, so a level holds that step's outcome for each mask: kept, removed here, or removed before. Its
rows number at most 326 x 32 for five filters, whatever the table; each part's cells give the outcomes their counts.

That a text is a copy is found by its SHA-256 and the smallest id that has it. Rows are aggregated by text, part and mask
before they meet that id, so a text that a third of all rows share is never in one task, and neither is a null id.

Cases: a null text is an empty one, so both are copies of each other; a text without words fails only the least number
of words; a row without an id is never a copy nor makes one, and has no label; rows with one id and one text are no
copies of each other; a null source and an empty one are one part; of several labels of an id any 1 counts; an empty
table gives an empty table; only the named columns are read.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, per_text

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 50, 65, 5
CAPITALS, SIGNS = bytes(range(ord("A"), ord("Z") + 1)), b"#$%&*|"
#: The six white spaces of ASCII part words, for bytes.split() too.
SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Bytes of text whose words are split at once.
PIECE = 1 << 20


def words(data: bytes) -> tuple[int, int]:
    """The number of words and of different ones, a piece of the text at a time."""
    n, seen, start = 0, set(), 0
    while start < len(data):
        cut = SPACE.search(data, min(start + PIECE, len(data)))
        end = cut.end() if cut else len(data)
        found = data[start:end].split()
        n += len(found)
        seen.update(found)
        start = end
    return n, len(seen)


def own_mask(text: str) -> tuple[int, bytes]:
    """The bits of the filters that need no other document, and the text's digest."""
    data = text.encode("utf-8", "surrogatepass")
    n, distinct = words(data)
    fails = (
        n < MIN_WORDS,
        100 * distinct < MIN_DISTINCT * n,
        100 * (len(data) - len(data.translate(None, CAPITALS))) > MAX_CAPITALS * len(text),
        len(data.translate(None, SIGNS)) < len(data),
    )
    return sum(1 << i for i, failed in enumerate(fails) if failed), hashlib.sha256(data).digest()


def _masks():
    def compute(texts: list[str | None]) -> list[list]:
        found = [own_mask(t or "") for t in texts]
        return [[m for m, _ in found], [d for _, d in found]]

    return compute


def cells(docs: DataFrame, labels: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): how many documents of a part fail just the filters of mask, and how many of them are labelled so."""
    fields = [T.StructField("mask", T.IntegerType()), T.StructField("digest", T.BinaryType())]
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(text).cast("string").alias("text"))
    rows = per_text(rows, "text", fields, _masks, ["id", "part"])
    rows = rows.groupBy("id", "part", "mask", "digest").agg(F.count("*").alias("n"))
    good = toxic = F.lit(0)
    named, nameless = rows.where(F.col("id").isNotNull()), rows.where(F.col("id").isNull())
    if labels is not None:
        marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("of"))
        marks = marks.agg(F.max((F.col("quality") == 1).cast("int")).alias("is_good"), F.max((F.col("toxic") == 1).cast("int")).alias("is_toxic"))
        named = named.join(marks, named.id == marks["of"], "left")
        good, toxic = F.coalesce("is_good", F.lit(0)), F.coalesce("is_toxic", F.lit(0))
    named = named.select("id", "part", "mask", "digest", "n", (F.col("n") * good).alias("good"), (F.col("n") * toxic).alias("toxic"))
    counts = [F.sum(c).alias(c) for c in ("n", "good", "toxic")]
    # by text and part: all rows, and those of the smallest id, which alone can be no copies
    first = F.min(F.struct("id", "n", "good", "toxic")).alias("first")
    texts = materialize(named.groupBy("part", "mask", "digest", "id").agg(*counts).groupBy("part", "mask", "digest").agg(*counts, first))
    least = texts.groupBy("digest").agg(F.min("first.id").alias("least"))
    texts = texts.join(least, "digest")
    own = F.col("first.id") == F.col("least")

    def split(c: str) -> tuple[Column, Column]:
        original = F.when(own, F.col(f"first.{c}")).otherwise(0)
        return original.alias(c), (F.col(c) - original).alias(c)

    originals, copies = zip(*map(split, ("n", "good", "toxic")), strict=True)
    copy_bit = 1 << FILTERS.index("E")
    zero = F.lit(0).cast("long")
    out = texts.select("part", "mask", *originals).unionByName(texts.select("part", F.col("mask").bitwiseOR(F.lit(copy_bit)).alias("mask"), *copies))
    out = out.unionByName(nameless.select("part", "mask", "n", zero.alias("good"), zero.alias("toxic"))).where("n > 0")
    return out.groupBy("part", "mask").agg(*counts)


#: Each level takes the prefixes of the one before, with each mask, one unused letter further.
GROW = """
WITH RECURSIVE letters(letter, bit) AS (SELECT * FROM VALUES {letters}),
grown(prefix, step, applied, bit, mask, outcome) AS (
  SELECT '', 0, 0, 0, mask, 'kept' FROM {{masks}}
  UNION ALL
  SELECT concat(g.prefix, l.letter), g.step + 1, g.applied | l.bit, l.bit, g.mask,
    CASE WHEN g.mask & (g.applied | l.bit) = 0 THEN 'kept' WHEN g.mask & l.bit = 0 THEN 'gone'
      WHEN g.mask & g.applied = 0 THEN 'removed' ELSE 'redundant' END
  FROM grown g JOIN letters l ON g.applied & l.bit = 0)
SELECT * FROM grown WHERE step > 0
"""


def steps(masks: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(prefix, step, bit, mask, outcome) for each prefix of filters and each mask."""
    if len(filters) > 6:
        raise ValueError("more than six filters have over a thousand orders and pass the recursion's limit of rows")
    letters = ", ".join(f"('{c}', {1 << i})" for i, c in enumerate(filters))
    return masks.sparkSession.sql(GROW.format(letters=letters), masks=masks)


def audit(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) from cells."""
    grown = materialize(steps(cells.select("mask").distinct().coalesce(1), filters))  # used twice, and its levels are many jobs

    def over(condition: Column, amount: str) -> Column:
        return F.sum(F.when(condition, F.col(amount)).otherwise(0))

    outcome = F.col("outcome")
    met = cells.join(F.broadcast(grown), "mask")  # a bounded number of rows, see steps()
    found = met.groupBy("part", "prefix", "step").agg(
        over(outcome == "kept", "n").alias("kept"),
        over(outcome == "removed", "n").alias("removed"),
        over(outcome == "redundant", "n").alias("redundant"),
        over(F.col("mask") == F.col("bit"), "n").alias("unique_fails"),
        over(outcome == "removed", "good").alias("good_lost"),
        over(outcome == "removed", "toxic").alias("toxic_lost"),
    )
    # a prefix of k letters begins (filters - k)! orders
    orders_of = F.factorial(F.lit(len(filters)) - F.col("step"))
    shapley = found.groupBy("part", F.right("prefix", F.lit(1)).alias("letter")).agg(F.sum(F.col("removed") * orders_of).alias("shapley"))
    orders = grown.where(F.col("step") == len(filters)).select(F.col("prefix").alias("filter_order")).distinct()
    orders = orders.withColumn("at", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))))
    orders = orders.select("filter_order", F.expr("left(filter_order, at)").alias("prefix"), F.expr("substr(filter_order, at, 1)").alias("letter"))
    out = found.join(F.broadcast(orders), "prefix").join(shapley, ["part", "letter"])
    metrics = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return out.select("part", "filter_order", F.col("step").cast("int").alias("step"), *[F.col(c).cast("long").alias(c) for c in metrics])
