"""URL filters: host and path rules, and gradient-boosted trees on lexical features where no rule fits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SUFFIXES = 4096


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty where there is none."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.char_length(url))), F.lit(""))


def with_rules(urls: DataFrame, allow: Sequence[str], block: Sequence[str], url: str = "url") -> DataFrame:
    """Every row with host, path, rule and rule_verdict: those of the longest rule that fits, null where none does.

    A rule is a host and a path in one, ``example.org/es/``. It fits its host and all hosts below it, where the path
    begins with the rule's. Of rules equally long the first in alphabetical order holds; one rule can't be in both
    lists. The lists are the caller's and short: they are part of the plan.
    """
    if both := set(allow) & set(block):
        raise ValueError(f"both allowed and blocked: {sorted(both)}")
    df = urls.withColumn("host", host_of(F.col(f"`{url}`"))).withColumn("path", path_of(F.col(f"`{url}`")))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted({*allow, *block}, key=lambda r: (-len(r), r), reverse=True):
        host, path = r.split("/", 1)
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + path)
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit("allow" if r in allow else "block")).otherwise(verdict)
    return df.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """What a URL looks like, from its characters alone; a null URL counts as an empty one."""
    u = F.coalesce(url, F.lit(""))
    n = F.char_length(u)
    count = lambda text, chars: (F.char_length(text) - F.char_length(F.regexp_replace(text, chars, ""))).cast("double")
    # Entropy from the sorted characters: a run of equal ones of length c adds c * log2(c).
    runs = F.regexp_extract_all(F.array_join(F.array_sort(F.split(u, "")), ""), F.lit(r"(?s)((.)\2*)"), 1)
    spread = F.aggregate(runs, F.lit(0.0), lambda acc, r: acc + F.char_length(r) * F.log2(F.char_length(r).cast("double")))
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    return {
        "length": n.cast("double"), "host_length": F.char_length(host).cast("double"),
        "depth": count(path, "[^/]").cast("double") * -1 + F.char_length(path), "labels": F.size(F.split(host, r"\.")).cast("double"),
        "digit_ratio": count(u, "[0-9]") / F.greatest(n, F.lit(1)), "entropy": F.when(n > 0, F.log2(n.cast("double")) - spread / n).otherwise(0.0),
        "parameters": F.when(query == "", 0.0).otherwise(count(query, "&") + 1), "query_length": F.char_length(query).cast("double"),
        "marks": count(u, "[-_%=~]"), "secure": u.startswith("https:").cast("double"), "fragment": F.contains(u, F.lit("#")).cast("double"),
        "longest_label": F.array_max(F.transform(F.split(host, r"\."), lambda x: F.char_length(x))).cast("double"),
    }


def suffixes(host: Column, path: Column) -> dict[str, Column]:
    """Suffixes whose share of bad labels is a feature: the last label, the last two, the first folder, the ending."""
    return {
        "tld": F.substring_index(host, ".", -1), "domain": F.substring_index(host, ".", -2),
        "folder": F.regexp_extract(path, r"^/([^/]*)/", 1), "ending": F.regexp_extract(path, r"\.([A-Za-z0-9]{1,6})$", 1),
    }


def url_filter(urls: DataFrame, labelled: DataFrame, allow: Sequence[str] = (), block: Sequence[str] = (), url: str = "url",
               label: str = "bad", train_rows: int = 4000, trees: int = 10, depth: int = 3) -> DataFrame:
    """Every row with host, path, rule, verdict (``allow`` or ``block``) and score, the model's chance of a bad URL.

    The verdict is the longest fitting rule's, else the model's: ``block`` from a score of 0.5 on. ``labelled`` has
    ``url`` and ``label`` (1 bad, 0 good; null labels and URLs are left out). Trees are fitted on at most ``train_rows``
    of them, the lowest hashes of the URLs; suffix statistics (smoothed shares of bad labels by hashed suffix, at most
    4,096 for each kind of suffix) come from all. Without labels of both kinds the score is the share of bad labels, 0
    where there is none. Null and malformed URLs have an empty host and path and are judged like others. Columns of
    these names are replaced; repeated rows stay. The tables of statistics have a fixed size and are broadcast; the
    rows are not shuffled.
    """
    rows = with_rules(urls.drop("host", "path", "rule", "verdict", "score"), allow, block, url)
    known = labelled.select(F.col(f"`{url}`").alias("url"), F.col(f"`{label}`").cast("double").alias("bad")).where("url IS NOT NULL AND bad IS NOT NULL")
    known = stored(known.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url"))), "labelled-urls")
    n, share = known.agg(F.count("*"), F.coalesce(F.avg("bad"), F.lit(0.0))).first()
    if n == 0 or share in (0.0, 1.0):
        return _verdict(rows, F.lit(float(share)))
    kinds = list(suffixes(F.col("host"), F.col("path")))
    hashed = lambda c: F.pmod(F.xxhash64(c), F.lit(_SUFFIXES)).cast("int")
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), hashed(c).alias("slot")) for k, c in suffixes(F.col("host"), F.col("path")).items()]))
    shares = known.select(pairs.alias("p"), "bad").groupBy("p.kind", "p.slot").agg(
        ((F.sum("bad") + 10 * share) / (F.count("*") + 10)).alias("share"))
    shares = stored(shares, "url-suffixes")

    def featured(df: DataFrame, name: str) -> DataFrame:
        for k, c in suffixes(F.col("host"), F.col("path")).items():
            table = shares.where(F.col("kind") == k).select(F.col("slot").alias("__slot"), F.col("share").alias(f"__share_{k}"))
            df = df.withColumn("__slot", hashed(c)).join(F.broadcast(table), "__slot", "left").drop("__slot")
        parts = lexical(F.col(f"`{name}`"), F.col("host"), F.col("path"))
        df = df.select("*", *[c.alias(f"__{k}") for k, c in parts.items()])
        names = [*[f"__{k}" for k in parts], *[f"__share_{k}" for k in kinds]]
        df = df.fillna(share, [f"__share_{k}" for k in kinds])
        return VectorAssembler(inputCols=names, outputCol="__features", handleInvalid="keep").transform(df).drop(*names)

    sample = known.orderBy(F.xxhash64("url"), "url").limit(train_rows)
    train = stored(featured(sample, "url").select("__features", "bad"), "url-train").coalesce(4)
    if train.select("bad").distinct().count() < 2:
        return _verdict(rows, F.lit(float(share)))
    gbt = GBTClassifier(featuresCol="__features", labelCol="bad", predictionCol="__p", maxIter=trees, maxDepth=depth, maxBins=32, stepSize=0.2, seed=7)
    model = gbt.fit(train).setProbabilityCol("__probability").setRawPredictionCol("__raw")
    scored = model.transform(featured(rows, url))
    return _verdict(scored, vector_to_array(F.col("__probability"))[1]).drop("__features", "__p", "__probability", "__raw")


def _verdict(rows: DataFrame, score: Column) -> DataFrame:
    rows = rows.withColumn("score", score)
    method = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return rows.withColumn("verdict", F.coalesce("rule_verdict", method)).drop("rule_verdict")


def page_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, bad) of pages that show a labelled document: the number in the path is its id; bad if toxic or of low quality.

    A document with several labels is bad if one says so; ids that no page shows and URLs without a number are left out.
    """
    number = F.regexp_extract(path_of(F.col("url")), r"/([0-9]{1,18})(?:[/.]|$)", 1)
    shown = pages.select("url", F.when(number != "", number.cast("long")).alias("doc_id")).where("doc_id IS NOT NULL")
    bad = ((F.col("toxic") == 1) | (F.col("quality") == 0)).cast("int")
    return shown.join(labels.groupBy("doc_id").agg(F.max(bad).alias("bad")), "doc_id").select("url", "bad")
