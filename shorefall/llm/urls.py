"""URL verdicts: rules first, then gradient-boosted trees on lexical features.

The trees are fitted on a bounded sample of labelled URLs: those that a rule decides carry its verdict, and a table
of labels may add others. The trees judge by form (lengths, depth, digits, entropy, parameters, hyphens) and by how
often labelled URLs with the same ends were blocked: of the host its last labels, of the path its begin, alone and together.
Ends that no labelled URL has count as the base rate. A part of the labels is held back; trees that do not tell
its URLs better than the commonest label does are not used, and the verdict is that label.
"""

from __future__ import annotations

import zlib

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sample import bounded

#: (verdict, host, path prefix); a rule fits its host and all subdomains, and the longest that fits wins.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
#: Labelled URLs used for fitting at most, and characters of one; of ten, four give the statistics, four the trees, two are held back.
SAMPLE, LONGEST = 8_000, 2_048
TREES, DEPTH, SMOOTH = 15, 3, 4.0
#: What trees must be better by, in accuracy on URLs held back.
MARGIN = 0.02


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): host between the first "://" and the next of / ? #, A-Z lower-cased; path from there to ? or #.

    Null, or no "://": both empty.
    """
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    after = rest.substr(F.length(host) + 1, F.length(rest) + 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lower, F.regexp_extract(after, r"^[^?#]*", 0)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule (host and path together; the longer host of equals) that fits, else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for say, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]))):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(say)).otherwise(verdict)
    return rule, verdict


def suffix_of(host: Column) -> Column:
    """The last three labels of a host."""
    parts = F.split(host, r"\.")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - 2, F.lit(1)), 3), ".")


def ends_of(host: Column, path: Column) -> dict[str, Column]:
    """Ends of a URL by which labelled ones are counted."""
    top = F.regexp_extract(host, r"[^.]*$", 0)
    domain = F.regexp_extract(host, r"[^.]*\.?[^.]*$", 0)
    segment, head = F.regexp_extract(path, "^/[^/]*/?", 0), F.regexp_extract(path, "^/[^/]*/?.?", 0)
    both = lambda a, b: F.concat_ws(" ", a, b)
    return {"suffix": suffix_of(host), "top": top, "segment": segment, "top_segment": both(top, segment), "domain_segment": both(domain, segment), "domain_head": both(domain, head)}


def _share(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)) / F.greatest(F.length(text), F.lit(1)), F.lit(0.0))


def _entropy(text: Column) -> Column:
    """Bits a character, of the characters' shares."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.greatest(F.size(chars), F.lit(1)).cast("double")
    of = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a - of(c) * F.log2(of(c)))


FORM = ["url_length", "host_length", "path_length", "depth", "labels", "hyphens", "digits", "entropy", "parameters", "fragment", "secure"]
ENDS = ["suffix", "top", "segment", "top_segment", "domain_segment", "domain_head"]
FEATURES = FORM + [f"{e}_{k}" for e in ENDS for k in ("rate", "seen")]


def featured(urls: DataFrame, rates: DataFrame, base: float) -> DataFrame:
    """Adds FEATURES to rows with url, host and path. rates: kind, end, rate, seen; at most SAMPLE rows a kind."""
    u = F.coalesce("url", F.lit(""))
    host, path = F.col("host"), F.col("path")
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    made = {
        "url_length": F.length(u), "host_length": F.length(host), "path_length": F.length(path),
        "depth": F.regexp_count(path, F.lit("/[^/]")), "labels": F.regexp_count(host, F.lit(r"[^.]+")), "hyphens": F.regexp_count(host, F.lit("-")),
        "digits": _share(u, "[0-9]"), "entropy": _entropy(host), "parameters": F.when(query == "", 0).otherwise(F.regexp_count(query, F.lit("&")) + 1),
        "fragment": F.contains(u, F.lit("#")), "secure": F.startswith(F.lower(u), F.lit("https:")),
    }
    out = urls.withColumns(ends_of(host, path))
    for e in ENDS:
        own = rates.where(F.col("kind") == e).select(F.col("end").alias(e), F.col("rate").alias(f"{e}_rate"), F.col("seen").alias(f"{e}_seen"))
        out = out.join(F.broadcast(own), e, "left")
        out = out.withColumns({f"{e}_rate": F.coalesce(f"{e}_rate", F.lit(base)), f"{e}_seen": F.coalesce(f"{e}_seen", F.lit(0.0))})
    return out.withColumns({k: v.cast("double") for k, v in made.items()})


def labelled(urls: DataFrame, rules: list[tuple[str, str, str]] = RULES, labels: DataFrame | None = None) -> DataFrame:
    """url, host, path, label (1: blocked) of a bounded sample of distinct URLs, the same for the same tables.

    Labels are the rules' verdicts; labels (url, blocked 0 or 1) adds URLs that no rule decides. URLs of over LONGEST characters are not
    learned from.
    """
    host, path = split_url(F.col("url"))
    _, verdict = rule_of(host, path, rules)
    decided = urls.select("url", host.alias("host"), path.alias("path"), (verdict == "block").cast("double").alias("label")).where(F.col("label").isNotNull() & (F.length("url") <= LONGEST))
    if labels is not None:
        given = labels.where("url is not null and blocked in (0, 1)").where(verdict.isNull() & (F.length("url") <= LONGEST))
        decided = decided.unionByName(given.select("url", host.alias("host"), path.alias("path"), F.col("blocked").cast("double").alias("label")))
    return bounded(decided.groupBy("url", "host", "path").agg(F.min("label").alias("label")), SAMPLE, "url")


class UrlModel:
    """Statistics and trees fitted on labelled URLs (url, host, path, label; at most SAMPLE rows are used).

    held_out: accuracy of the trees on URLs held back, and of the commonest label there; None without both labels.
    """

    def __init__(self, train: DataFrame):
        spark = train.sparkSession
        rows = train.limit(SAMPLE).toPandas()  # bounded by SAMPLE rows of LONGEST characters
        self.trees = self.held_out = None
        self.base = float(rows["label"].mean()) if len(rows) else 0.0
        rows["part"] = [zlib.crc32(u.encode()) % 5 for u in rows["url"]]
        fixed = spark.createDataFrame(rows.values.tolist(), "url string, host string, path string, label double, part long").coalesce(1).cache()
        each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("end")) for k, v in ends_of(F.col("host"), F.col("path")).items()])).alias("e")
        counted = fixed.where("part in (0, 1)").select("label", each).groupBy("e.kind", "e.end").agg(((F.sum("label") + self.base * SMOOTH) / (F.count("*") + SMOOTH)).alias("rate"), F.count("*").cast("double").alias("seen"))
        self.rates = spark.createDataFrame([tuple(r) for r in counted.collect()], "kind string, end string, rate double, seen double").coalesce(1)
        found = {r.label for r in fixed.where("part in (2, 3)").select("label").distinct().collect()}
        if len(found) == 2:
            data = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(featured(fixed, self.rates, self.base))
            self.trees = GBTClassifier(labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7, checkpointInterval=-1).fit(data.where("part in (2, 3)").select("features", "label").coalesce(1))
            held = self.trees.transform(data.where("part = 4").select("features", "label")).agg(F.avg((F.col("prediction") == F.col("label")).cast("double")), F.avg("label")).first()
            if held[0] is not None:
                self.held_out = held[0], max(held[1], 1 - held[1])
            if self.held_out is None or self.held_out[0] < self.held_out[1] + MARGIN:
                self.trees = None
        fixed.unpersist()

    def blocked(self, urls: DataFrame) -> DataFrame:
        """Adds p_block (0 to 1) to rows with url, host and path: the trees', or the base rate where they are not used."""
        if self.trees is None:
            return urls.withColumn("p_block", F.lit(self.base))
        data = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(featured(urls, self.rates, self.base))
        return self.trees.transform(data).withColumn("p_block", vector_to_array("probability")[1]).select(*urls.columns, "p_block")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, model: UrlModel | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, p_block of every row: the longest rule's verdict, else the trees'.

    A null URL or one without a host is judged by the trees like any other (features of the empty host). An
    empty table gives an empty one; repeated rows are each judged; other columns play no part.
    """
    model = model or UrlModel(labelled(pages, rules))
    host, path = split_url(F.col("url"))
    rows = model.blocked(pages.select("page_id", "url", host.alias("host"), path.alias("path")))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("p_block") >= 0.5, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "p_block")
