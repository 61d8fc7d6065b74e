"""URL filter: explicit rules first, then gradient-boosted trees on lexical features.

The trees are trained from URLs whose label is known and applied to all others.
Everything on the main path is DataFrame functions and Spark ML's tree ensembles,
which run in the JVM.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm._common import cut

SUFFIXES = 4096  # hashed suffixes whose statistics are kept
LABELLED = 20_000  # labelled rows of each label that training takes at most, about
ROUNDS, DEPTH = 10, 4


def parts(url: F.Column) -> tuple[F.Column, F.Column]:
    """(host, path): the host stands after the first :// up to / ? # or the end, A-Z lower-cased; the path goes on to ? # or the end. Both empty for null or without ://."""
    known = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(known, lower).otherwise(""), F.when(known, path).otherwise("")


def rule_order(rule: str) -> int:
    return len(rule)


def matched_rule(host: F.Column, path: F.Column, rules: list[tuple[str, str]]) -> tuple[F.Column, F.Column]:
    """(rule, verdict) of the longest rule that fits, null without one. rules: (verdict, "host/path prefix")."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: rule_order(r[1])):  # the longest is tried first: it wraps the others
        name, _, prefix = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + prefix))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def entropy(text: F.Column) -> F.Column:
    """Bits a character, from the counts of the distinct characters."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.greatest(F.size(chars), F.lit(1)).cast("double")
    counts = F.transform(F.array_distinct(chars), lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))).cast("double") / n)
    return F.aggregate(counts, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0))


def lexical(url: F.Column, host: F.Column, path: F.Column) -> dict[str, F.Column]:
    """Features of the address alone; a null url counts as empty."""
    text = F.coalesce(url, F.lit(""))
    length = F.length(text).cast("double")
    count = lambda pattern, c=text: (F.length(c) - F.length(F.regexp_replace(c, pattern, ""))).cast("double")
    return {
        "length": length,
        "host_length": F.length(host).cast("double"),
        "path_length": F.length(path).cast("double"),
        "depth": count("/", path),
        "labels": count(r"\.", host),
        "hyphens": count("-", host),
        "digits": count("[0-9]") / F.greatest(length, F.lit(1.0)),
        "host_digits": count("[0-9]", host) / F.greatest(F.length(host).cast("double"), F.lit(1.0)),
        "entropy": entropy(text),
        "host_entropy": entropy(host),
        "parameters": count("[=]"),
        "query": F.when(F.contains(text, F.lit("?")), 1.0).otherwise(0.0),
        "fragment": F.when(F.contains(text, F.lit("#")), 1.0).otherwise(0.0),
    }


def suffix_bucket(host: F.Column) -> F.Column:
    """The host's last two labels, hashed."""
    return F.pmod(F.xxhash64(F.substring_index(host, ".", -2)), F.lit(SUFFIXES)).cast("int")


def judge(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", labelled: int = LABELLED) -> DataFrame:
    """(id, host, path, rule, verdict) for every row.

    The URLs that a rule decides are the labelled ones. Training takes at most about
    ``labelled`` of each label, by a hash of the row; suffix statistics are over all
    rows but the one that is judged. Without labelled rows of both kinds the method's verdict is the only label
    there is, or ``allow``. Null urls are judged by their (empty) features; repeated rows
    each give a row; other columns are ignored; an empty table gives an empty result.
    """
    host, path = parts(F.col("url"))
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).withColumns({"host": host, "path": path})
    rule, known = matched_rule(F.col("host"), F.col("path"), rules)
    rows = base.withColumns({"rule": rule, "known": known, "suffix": suffix_bucket(F.col("host"))})

    # at most SUFFIXES rows, whatever the number of pages
    block = F.count_if(F.col("known") == "block")
    marked = F.count("known")
    stats = rows.groupBy("suffix").agg(F.log1p(F.count("*").cast("double")).alias("suffix_pages"), marked.alias("n"), block.alias("n_block"))
    totals = stats.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_block"), F.lit(0)).alias("n_block")).first()
    decided = {"block": totals.n_block, "allow": totals.n - totals.n_block}
    if not all(decided.values()):
        only = "block" if decided["block"] else "allow"
        return rows.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("known", F.lit(only)).alias("verdict"))

    names = [*lexical(F.col("url"), F.col("host"), F.col("path")), "suffix_pages", "suffix_blocked"]
    # a labelled row's own label is left out of its suffix's share, as no other row has its own in it
    others = F.col("n") - F.col("known").isNotNull().cast("int")
    blocked = (F.col("n_block") - F.coalesce(F.col("known") == "block", F.lit(False)).cast("int") + 1) / (others + 2)
    full = rows.join(F.broadcast(stats), "suffix").withColumn("suffix_blocked", blocked).withColumns(lexical(F.col("url"), F.col("host"), F.col("path")))
    featured = VectorAssembler(inputCols=names, outputCol="features").transform(full)
    chance = F.pmod(F.xxhash64("id", "url"), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("known") == "block", F.lit(labelled / decided["block"])).otherwise(F.lit(labelled / decided["allow"]))
    sample = featured.where(F.col("known").isNotNull() & (chance < share)).select("features", F.when(F.col("known") == "block", 1.0).otherwise(0.0).alias("label"))
    weighed = sample.withColumn("weight", F.when(F.col("label") == 1, 0.5 / min(labelled, decided["block"])).otherwise(0.5 / min(labelled, decided["allow"])) * float(min(labelled, totals.n)))
    model = GBTClassifier(maxIter=ROUNDS, maxDepth=DEPTH, seed=11, weightCol="weight").fit(cut(weighed))  # a bounded sample: written once, not worked out in every round
    scored = model.transform(featured)
    verdict = F.coalesce("known", F.when(vector_to_array("probability")[1] >= 0.5, F.lit("block")).otherwise(F.lit("allow")))
    return scored.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"))
