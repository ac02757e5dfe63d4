"""URL filter: longest-suffix rules first, gradient-boosted trees on lexical features for the rest.

The trees (Spark's own) learn from labelled URLs.  Labels are given (url, label), or else made: a row's label
is its rule's verdict, or whether its host names one of ``SEEDS``, words that stand for unwanted sites.  The
trees never see a word or a host, only lexical features: lengths, path depth, digit ratio, entropy, counts of
parameters, labels and hyphens, and the smoothed shares of blocked URLs below the host's site, domain and
top-level domain.  Those shares are counted over all rows and always without the host that is judged, so that
no host's own labels are learned by heart.  For the trees at most ``SAMPLE`` distinct URLs of each label are
taken, by hash; :func:`held_out_auc` says how well they do on hosts that they never saw.

Defined results: a null url, or one without "://", has an empty host and path, fits no rule and is judged
by its features; all features of a null url are zero; the longest fitting rule wins; repeated rows are
judged alike; with no labelled row of one kind everything beyond the rules is allowed; an empty table
gives no rows; extra columns pass through ``judge`` whatever their names, but for those it makes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm._common import sampled, settle, table

SAMPLE, TREES, DEPTH, SMOOTH, BROADCAST_HOSTS = 4000, 15, 4, 20.0, 100_000
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
# Words in host names that label a URL as unwanted.
SEEDS = (
    "ads", "adult", "bet", "bets", "betting", "casino", "cheap", "clickbait", "crack", "escort", "farm", "fraud", "gambling",
    "keygen", "lottery", "malware", "phish", "phishing", "pills", "poker", "porn", "scam", "sex", "spam", "spyware", "torrent",
    "track", "tracker", "viagra", "virus", "warez", "win", "xxx",
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = (
    "f_length", "f_host_length", "f_path_length", "f_depth", "f_labels", "f_hyphens", "f_longest_label", "f_digits",
    "f_host_digits", "f_entropy", "f_host_entropy", "f_params", "f_fragment", "f_secure", "f_tld", "f_domain", "f_site",
)


def _rest(url: str):
    spot = F.instr(F.col(url), "://")
    return F.when(spot > 0, F.col(url).substr(spot + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: str):
    """After the first "://" up to "/", "?", "#" or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: str):
    """After the host up to "?", "#" or the end."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def rule_for(rules=RULES, host: str = "host", path: str = "path"):
    """(rule, verdict) of the longest rule that fits a host or its parent domains and begins the path; else null."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for domain, start, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((F.col(host) == domain) | F.col(host).endswith("." + domain)) & F.col(path).startswith(start)
        out = F.when(fits, F.struct(F.lit(domain + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _entropy(text):
    signs = F.filter(F.split(text, ""), lambda c: c != "")
    total = F.size(signs).cast("double")
    shares = F.transform(F.array_distinct(signs), lambda c: F.size(F.filter(signs, lambda d: d == c)) / total)
    return F.when(total > 0, F.aggregate(shares, F.lit(0.0), lambda s, p: s - p * F.log2(p))).otherwise(0.0)


def _digits(text):
    return F.length(F.regexp_replace(text, "[^0-9]", "")) / F.greatest(F.length(text), F.lit(1))


def _last(labels: int):
    return F.substring_index("host", ".", -labels)


def lexical(rows: DataFrame) -> DataFrame:
    """``rows`` (url, host, path) with the lexical features."""
    url = F.coalesce("url", F.lit(""))
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    labels = F.split("host", r"\.")
    number = {
        "f_length": F.length(url), "f_host_length": F.length("host"), "f_path_length": F.length("path"),
        "f_depth": F.size(F.filter(F.split("path", "/"), lambda s: s != "")), "f_labels": F.size(labels),
        "f_hyphens": F.length(F.regexp_replace("host", "[^-]", "")),
        "f_longest_label": F.array_max(F.transform(labels, F.length)),
        "f_digits": _digits(url), "f_host_digits": _digits(F.col("host")), "f_entropy": _entropy(url), "f_host_entropy": _entropy(F.col("host")),
        "f_params": F.when(query == "", 0).otherwise(F.size(F.split(query, "[&;]"))),
        "f_fragment": F.instr(url, "#") > 0, "f_secure": F.lower(url).startswith("https:"),
    }
    return rows.withColumns({k: F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in number.items()})


def label(rows: DataFrame, rules=RULES) -> DataFrame:
    """``rows`` with ``label`` 1.0 (block) or 0.0: the rule's verdict, else whether the host names a seed word."""
    seeds = F.col("host").rlike(rf"(^|[.\-])({'|'.join(SEEDS)})([.\-]|$)")
    verdict = F.coalesce(rule_for(rules)["verdict"] == "block", seeds)
    return rows.withColumn("label", verdict.cast("double"))


LEVELS = ("tld", "domain", "site")


def suffixes(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"s_tld": _last(1), "s_domain": _last(2), "s_site": F.regexp_replace("host", r"^(www|m|blog)\.", "")})


def parted(urls: DataFrame) -> DataFrame:
    return urls.withColumns({"host": host_of("url"), "path": path_of("url")})


def _near(table: DataFrame) -> DataFrame:
    """A settled table with one row a host or suffix: broadcast while it is small, else joined by a shuffle."""
    return F.broadcast(table) if table.count() <= BROADCAST_HOSTS else table


class UrlModel:
    """Labelled rows and blocked ones of each host and suffix, and boosted trees."""

    def __init__(self, hosts: DataFrame | None, overall: float, trees):
        self.hosts, self.overall, self.trees = hosts, overall, trees

    def shares(self, hosts: DataFrame) -> DataFrame:
        """(host, f_tld, f_domain, f_site) of ``hosts`` (host): the blocked shares around each, without its own rows."""
        own = suffixes(hosts.join(self.hosts, "host", "left").fillna(0, ["n", "bad"]))
        for k in LEVELS:
            total = suffixes(self.hosts).groupBy(f"s_{k}").agg(F.sum("n").alias("_n"), F.sum("bad").alias("_bad"))
            own = own.join(total, f"s_{k}", "left").fillna(0, ["_n", "_bad"])
            share = (F.col("_bad") - F.col("bad") + SMOOTH * self.overall) / (F.col("_n") - F.col("n") + SMOOTH)
            own = own.withColumn(f"f_{k}", share).drop("_n", "_bad")
        return own.select("host", *(f"f_{k}" for k in LEVELS))

    def features(self, rows: DataFrame) -> DataFrame:
        return lexical(rows).join(_near(settle(self.shares(rows.select("host").distinct()))), "host")

    def blocked(self, rows: DataFrame) -> DataFrame:
        """``rows`` (url, host, path) with ``p_block``, the trees' probability of being unwanted."""
        from pyspark.ml.functions import vector_to_array

        if self.trees is None:
            return rows.withColumn("p_block", F.lit(0.0))
        # Only the struct of the row goes through the trees: their columns meet no name of the input.
        own = rows.select("url", "host", "path", F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("_row"))
        return self.trees.transform(self.features(own)).select("_row.*", vector_to_array("probability")[1].alias("p_block"))


def train(urls: DataFrame, labels: DataFrame | None = None, rules=RULES, sample: int = SAMPLE) -> UrlModel:
    """Learn from ``labels`` (url, label 1.0 or 0.0), or from labels made of ``urls`` (url)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = label(parted(urls.select("url")), rules) if labels is None else parted(labels.select("url", "label")).withColumn("label", F.col("label").cast("double"))
    hosts = settle(rows.groupBy("host").agg(F.count("*").alias("n"), F.sum("label").alias("bad")))
    totals = hosts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    if not totals["n"] or totals["bad"] in (0, totals["n"]):
        return UrlModel(None, 0.0, None)
    taken = settle(sampled(rows.select("url", "host", "path", "label"), sample, "label"))
    model = UrlModel(hosts, totals["bad"] / totals["n"], None)
    stages = [VectorAssembler(inputCols=list(FEATURES), outputCol="features"), GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=3)]
    model.trees = Pipeline(stages=stages).fit(settle(model.features(taken).select("url", "label", *FEATURES).orderBy("url").coalesce(1)))
    return model


def held_out_auc(urls: DataFrame, labels: DataFrame | None = None, rules=RULES, folds: int = 4) -> float:
    """Area under the ROC curve on the hosts of one fold, by hash, for trees fitted on the others."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    rows = label(parted(urls.select("url")), rules) if labels is None else parted(labels.select("url", "label"))
    rows = settle(rows.select("url", "label", (F.pmod(F.xxhash64("host"), F.lit(folds)) == 0).alias("held")))
    model = train(rows, rows.where("not held"))
    judged = model.blocked(parted(rows.where("held")))
    return BinaryClassificationEvaluator(rawPredictionCol="p_block").evaluate(judged.select("label", "p_block"))


def judge(pages: DataFrame, model: UrlModel, rules=RULES) -> DataFrame:
    """``pages`` (…, url) with ``host``, ``path``, ``rule``, ``verdict`` and ``p_block``."""
    kept = pages.drop("host", "path", "rule", "verdict", "p_block")
    judged = model.blocked(parted(kept)).withColumn("_rule", rule_for(rules))
    own = F.when(F.col("p_block") > 0.5, "block").otherwise("allow")
    return judged.withColumns({"rule": F.col("_rule.rule"), "verdict": F.coalesce("_rule.verdict", own)}).drop("_rule")


def op3_urls(spark, sf_dir: str) -> DataFrame:
    """A verdict on every page's url."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, train(pages)).select("page_id", "host", "path", "rule", "verdict", "p_block")
