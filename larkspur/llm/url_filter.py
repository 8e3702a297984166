"""URL filters: rules by host and path, and gradient-boosted trees on lexical features for what no rule fits.

DataFrame functions and Spark's own tree learner only. The trees are trained on a bounded sample of the
distinct labelled URLs. A suffix's statistics come from all labelled URLs; a URL that is trained on has those of the
other folds only, so that its own label says nothing about it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.shared import drop, table

#: Fixed values: (verdict, rule).
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
FEATURES = ["length", "host_length", "depth", "labels", "digits", "entropy", "parameters", "hyphens", "suffix_rows", "suffix_blocked"]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Setup:
    """max_rows: the bound of the training sample, half of it of one verdict at most."""

    max_rows: int = 10_000
    trees: int = 12
    depth: int = 4
    seed: int = 3


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty for null or without `://`."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    raw = F.regexp_extract(rest, "^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), "^([^?#]*)", 1)
    return F.coalesce(F.translate(raw, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def by_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null for none."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):  # later ones are longer and come first
        h, _, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def lexical(urls: DataFrame) -> DataFrame:
    """Adds the features that a URL's letters give, from columns url, host and path; a null url has zeros."""
    u = F.coalesce("url", F.lit(""))
    n = F.length(u)
    share = lambda c: F.length(F.regexp_replace(u, c, "")) / F.greatest(n, F.lit(1))
    letters = F.split(u, "")
    entropy = F.aggregate(F.array_distinct(letters), F.lit(0.0), lambda s, c: s - F.when(c == "", 0.0).otherwise((n - F.length(F.replace(u, c, F.lit("")))) / n * F.log2((n - F.length(F.replace(u, c, F.lit("")))) / n)))
    dots = F.length("host") - F.length(F.replace("host", F.lit("."), F.lit("")))
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    return urls.withColumns(
        {
            "length": n.cast("double"),
            "host_length": F.length("host").cast("double"),
            "depth": F.size(F.filter(F.split("path", "/"), lambda x: x != "")).cast("double"),
            "labels": (dots + 1).cast("double"),
            "digits": share("[^0-9]"),
            "entropy": F.when(n > 0, entropy).otherwise(0.0),
            "parameters": F.size(F.filter(F.split(query, "&"), lambda x: x != "")).cast("double"),
            "hyphens": share("[^-]"),
            "suffix": F.substring_index("host", ".", -1),
        }
    )


#: Parts of the labelled URLs; more suffixes than this are joined by a shuffle instead of a broadcast.
FOLDS, BROADCAST_SUFFIXES = 5, 50_000


def fold(url: Column) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(FOLDS)).cast("int")


@dataclass
class Filter:
    """A trained filter. counts: (suffix, fold, rows, blocked) of all labelled URLs, written down."""

    model: GBTClassificationModel | None
    counts: DataFrame
    few: bool  # whether the suffixes may be broadcast
    share: float  # of blocked rows; what is judged where there was nothing to learn

    def features(self, urls: DataFrame, known: bool = False) -> DataFrame:
        """`known`: of labelled URLs, whose own fold doesn't count."""
        hint = F.broadcast if self.few else lambda df: df
        sums = [F.sum("rows").alias("s_rows"), F.sum("blocked").alias("s_blocked")]
        rows = urls.join(hint(self.counts.groupBy("suffix").agg(*sums)), "suffix", "left")
        n, k = F.coalesce("s_rows", F.lit(0)), F.coalesce("s_blocked", F.lit(0.0))
        if known:
            own = self.counts.select("suffix", F.col("fold").alias("own_fold"), F.col("rows").alias("own_rows"), F.col("blocked").alias("own_blocked"))
            rows = rows.withColumn("own_fold", fold(F.col("url"))).join(hint(own), ["suffix", "own_fold"], "left")
            n, k = n - F.coalesce("own_rows", F.lit(0)), k - F.coalesce("own_blocked", F.lit(0.0))
        rows = rows.withColumns({"suffix_rows": F.log1p(n.cast("double")), "suffix_blocked": (k + self.share) / (n + 1)})
        return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)

    def judge(self, urls: DataFrame) -> DataFrame:
        """Adds `score`, the probability to be blocked."""
        if self.model is None:
            return urls.withColumn("score", F.lit(float(self.share >= 0.5)))
        rows = self.model.transform(self.features(urls))
        return rows.withColumn("score", vector_to_array("probability")[1])


def train(labelled: DataFrame, setup: Setup = Setup()) -> Filter:
    """From `lexical` rows with blocked (0 or 1): statistics of all, trees of the distinct URLs of least hash, setup.max_rows of them at most."""
    counts = table(labelled.groupBy("suffix", fold(F.col("url")).alias("fold")).agg(F.count(F.lit(1)).alias("rows"), F.sum("blocked").alias("blocked")), "suffixes")
    total = counts.agg(F.sum("rows").alias("rows"), F.sum("blocked").alias("blocked"), F.count(F.lit(1)).alias("n")).first()
    share = (total.blocked or 0.0) / max(1, total.rows or 0)
    out = Filter(None, counts, total.n <= BROADCAST_SUFFIXES, share)
    if 0 < share < 1:
        half = setup.max_rows // 2
        distinct = labelled.dropDuplicates(["url"])
        some = [distinct.where(F.col("blocked") == k).orderBy(F.xxhash64("url"), "url").limit(half) for k in (0.0, 1.0)]
        rows = table(out.features(some[0].unionByName(some[1]), True).select("features", "blocked"), "sample")
        boost = GBTClassifier(featuresCol="features", labelCol="blocked", maxIter=setup.trees, maxDepth=setup.depth, seed=setup.seed)
        out.model = boost.fit(rows)
        drop(rows)
    return out


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, setup: Setup = Setup()) -> DataFrame:
    """page_id, host, path, rule, verdict, score, a row for each row of `pages`.

    A rule's verdict stands; the URLs that rules fit are the labelled ones, and the trees judge the others.
    Without labelled URLs of both verdicts all others get the one there is, or allow. Null and odd URLs have
    empty host and path and are judged as any.
    """
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", "url").withColumn("host", host).withColumn("path", path)
    rule, verdict = by_rule(F.col("host"), F.col("path"), rules)
    rows = lexical(rows.withColumn("rule", rule).withColumn("ruled", verdict))
    labelled = rows.where("ruled IS NOT NULL").withColumn("blocked", (F.col("ruled") == "block").cast("double"))
    judged = train(labelled, setup).judge(rows)
    own = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "score")


#: Host, path and rule alone, in DuckDB; the trees can't be expressed.
SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS raw FROM u),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(coalesce(rest, ''), length(raw) + 1), '^[^?#]*') AS path FROM h),
r(rule, rhost, rpath) AS (VALUES ('com/', 'com', '/'), ('example.com/en/', 'example.com', '/en/'), ('www.example.com/en/', 'www.example.com', '/en/'), ('net/es/', 'net', '/es/'), ('net/fr/', 'net', '/fr/'))
SELECT page_id, host, path, (SELECT arg_max(rule, length(rule)) FROM r WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS rule FROM p
"""
