"""A mix of sources at target weights, by Efraimidis-Spirakis sampling.

A source's target is filled with complete epochs first. What is left is a weighted sample without replacement: each
document draws an exponential key scaled by its quality weight, a source's documents are sorted by key, sizes are summed
along that order, and documents are taken until the budget is used; the last one is cut at it. Sums run in
parts (``running``), so a source may hold any share of the rows. Keys are hashes of ids, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from .running import running

#: Weights of sources in order, repeating; words of the mix to words of all documents; epochs of a source at most.
WEIGHTS, SHARE, EPOCHS = (5, 2, 1), 1.5, 2
WORD = r"[^\x20\x09-\x0D]+"
#: Digits and signs of ASCII.
SIGNS = r"[\x21-\x40\x5B-\x60\x7B-\x7E]+"
#: Bits of a key's hash.
BITS = 52
LEAST = 0.01


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_of(text: Column) -> Column:
    """Share of a text's characters that are neither digits nor signs of ASCII; never below LEAST."""
    n = F.length(text)
    return F.coalesce(F.greatest(F.lit(LEAST), F.try_divide(F.length(F.regexp_replace(text, SIGNS, "")), n)), F.lit(LEAST))


def key_of(doc_id: Column, weight: Column, seed: int) -> Column:
    """An exponential draw over the weight; small keys come first, those of heavy documents more often."""
    text = F.concat_ws("|", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")))
    drawn = F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("double")
    return -F.log((drawn + 0.5) / float(1 << BITS)) / weight


def targets(sizes: DataFrame, scratch: Scratch, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """(source, size, target) of (source, size): shares by weight, none above ``epochs`` times its size.

    Sources are filled like vessels: in the order of size to weight each is full if what is left, dealt by weight, would
    overflow it; those from the first that is not on share the rest by weight.
    """
    sizes = scratch.save(sizes)
    one = F.lit(1).cast("long")
    placed = running(sizes.withColumn("all", F.lit(0)), scratch, ["all"], [F.col("source").asc_nulls_last()], {"place": one})
    weight = F.array(*[F.lit(w) for w in weights])[(F.col("place") % len(weights)).cast("int")].cast("long")
    placed = scratch.save(placed.select("all", "source", "size", weight.alias("weight")))
    ratio = F.col("size") / F.col("weight")
    level = scratch.save(running(placed, scratch, ["all"], [ratio, F.col("source").asc_nulls_last()], {"full_size": F.col("size"), "full_weight": F.col("weight")}))
    whole = placed.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("words"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weights"))
    rest = F.col("words") * share - F.col("full_size") * epochs
    left = F.col("weights") - F.col("full_weight")
    line = level.crossJoin(F.broadcast(whole)).where(rest * F.col("weight") <= F.col("size") * float(epochs) * left)
    first = F.struct(ratio.alias("r"), F.col("source").isNull().alias("n"), F.col("source").alias("s"))
    line = line.agg(F.min(first).alias("first"), F.min_by(rest, first).alias("rest"), F.min_by(left, first).alias("left"))  # one row
    out = level.crossJoin(F.broadcast(line))
    mine = F.when(first < F.col("first"), F.lit(None)).otherwise(F.try_divide(F.col("rest") * F.col("weight"), F.col("left").cast("double")))
    return out.select("source", "size", F.least(F.coalesce(mine, F.col("size") * float(epochs)), F.col("size") * float(epochs)).alias("target"))


def mix(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS,
    quality: Column | None = None, seed: int = 12,
) -> DataFrame:
    """(doc_id, size, source_size, target, taken, key): words that the mix takes of each document, repeats counted.

    Sources in the order of code points, null last, weigh ``weights``, repeating. size counts words between white space
    (null: 0); target is the source's. A document gives ``taken div size`` whole copies and the first
    ``taken mod size`` words; a source's taken words are its target, rounded down. ``quality`` is a positive weight, by
    default the share of letters and blanks; null, NaN and weights that are not positive count as LEAST. Ties in the key go
    to the smaller id, then to the smaller size; rows that repeat an id are documents of their own. An empty table gives an empty one, a
    table without words takes none. Other columns take no part.
    """
    scratch = Scratch(docs.sparkSession)
    q = quality_of(F.col(text)) if quality is None else quality.cast("double")
    q = F.when(F.isnan(q) | ~(q > 0), F.lit(LEAST)).otherwise(F.coalesce(q, F.lit(LEAST)))
    read = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words_of(F.col(text)).alias("size"), q.alias("q"))
    read = scratch.save(read.select("doc_id", "source", "size", key_of(F.col("doc_id"), F.col("q"), seed).alias("key")))
    sources = scratch.save(targets(read.groupBy("source").agg(F.sum("size").alias("size")), scratch, weights, share, epochs))
    order = [F.col("key"), F.col("doc_id").asc_nulls_first(), F.col("size")]  # rows equal in these are equal in the result
    placed = running(read, scratch, ["source"], order, {"before": F.col("size")})
    own = sources.select(F.col("source").alias("__source"), F.col("size").alias("source_size"), "target")
    placed = placed.join(own, F.col("source").eqNullSafe(F.col("__source")))
    rounds = F.floor(F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0)))
    budget = F.floor(F.col("target") - rounds * F.col("source_size"))
    part = F.greatest(F.lit(0), F.least(F.col("size"), budget - F.col("before")))
    return placed.select("doc_id", "size", "source_size", "target", (rounds * F.col("size") + part).cast("long").alias("taken"), "key")


def texts(docs: DataFrame, mixed: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents of the mix: a row for each whole copy, and one cut to its first words (joined by blanks) where the budget ends. Ids must be unique."""
    own = mixed.where("taken > 0").select(F.col("doc_id").alias("__id"), F.col("size").alias("__size"), F.col("taken").alias("__taken"))
    rows = docs.join(own, F.col(doc_id) == F.col("__id"))
    copies = rows.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("__taken") / F.col("__size")))))
    left = F.least(F.col("__size"), F.col("__taken") - (F.col("__copy") - 1) * F.col("__size"))
    cut = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), 1, left.cast("int")), " ")
    return copies.withColumn(text, F.when(left < F.col("__size"), cut).otherwise(F.col(text))).select(*docs.columns)
