"""URL filter: host and path rules, and a logistic scorer for the rest; DataFrame functions only.

The scorer works on hashed character n-grams of host and path, single characters among them. Their weights are fitted by
gradient steps on a small labelled table, whose features the same expressions make; the table
is a parameter of at most LABELLED rows. The package's own table has public kinds of blocked and of ordinary hosts. What it teaches of
kinds that it has not is their form: blocked hosts are mostly words joined by hyphens, or have digits. A blocked host
that looks like an ordinary word passes, and an ordinary one of joined words may not.

Null urls and urls without :// have an empty host and path and fit no rule; they get the scorer's
verdict on no features, its intercept. Of rules of one length the one later in the alphabet wins.
Equal urls get equal verdicts, repeated rows stay, an empty table gives an empty result, and
further columns are ignored.
"""

from __future__ import annotations

from importlib import resources

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

BUCKETS, GRAMS = 2_048, (1, 2, 3, 4)
LABELLED, MOST_RULES = 10_000, 1_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (host, path, verdict): rules of the registered query.
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)

#: Kinds of hosts that the query learns from: columns kind, blocked (0 or 1), hosts. A rule makes each host's urls.
TABLE = "labelled_kinds.tsv"
DOMAINS, LANGUAGES, URLS = ("com", "net", "org"), ("en", "fr", "de", "es"), 6


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(size, rule, verdict) of the longest rule that fits; null if none does."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    if not rules:
        return F.lit(None).cast("struct<size:int,rule:string,verdict:string>")

    def own(rule):
        name, start, verdict = rule
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(start))
        said = F.struct(F.lit(len(name) + len(start)).alias("size"), F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))
        return F.when(fits, said)

    return F.array_max(F.array(*map(own, rules)))


def grams(host: Column, path: Column) -> Column:
    """Buckets of the different n-grams of host and of path."""

    def of(mark: str, text: Column, n: int) -> Column:
        framed = F.concat(F.lit("^"), text, F.lit("$"))
        places = F.when((F.length(framed) >= n) & (F.length(text) > 0), F.sequence(F.lit(1), F.length(framed) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.pmod(F.hash(F.lit(mark), F.substring(framed, i, n)), F.lit(BUCKETS)))

    return F.array_distinct(F.concat(*(of(mark, text, n) for mark, text in (("h", host), ("p", path)) for n in GRAMS)))


def fit(labelled: DataFrame, rounds: int = 400, rate: float = 0.5, ridge: float = 1e-3) -> tuple[float, list[float]]:
    """Intercept and weights from rows (url, blocked) by gradient steps."""
    host, path = host_and_path(F.col("url"))
    rows = labelled.select(grams(host, path).alias("g"), F.col("blocked").cast("int").alias("y")).limit(LABELLED + 1).collect()
    if len(rows) > LABELLED:
        raise ValueError(f"more than {LABELLED} labelled urls")
    rows = sorted((r["y"], sorted(r["g"])) for r in rows)
    y = np.array([r[0] for r in rows], float)
    size = np.array([len(r[1]) for r in rows], np.int64)
    row, gram = np.repeat(np.arange(len(rows)), size), np.array([i for r in rows for i in r[1]], np.int64)
    scale = 1 / np.sqrt(np.maximum(size, 1))[row]
    bias, w = 0.0, np.zeros(BUCKETS)
    for _ in range(rounds if rows else 0):
        z = bias + np.bincount(row, w[gram] * scale, len(rows))
        off = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(rows)
        bias -= rate * off.sum()
        w -= 10 * rate * (np.bincount(gram, off[row] * scale, BUCKETS) + ridge * w / 10)
    return round(float(bias), 6), w.round(6).tolist()


def block_score(host: Column, path: Column, model: tuple[float, list[float]]) -> Column:
    """Probability that a url is to be blocked."""
    bias, w = model
    weights = F.array(*map(F.lit, w))
    g = grams(host, path)
    total = F.aggregate(g, F.lit(0.0), lambda a, i: a + F.get(weights, i))
    z = F.lit(bias) + total / F.sqrt(F.greatest(F.size(g), F.lit(1)))
    return 1 / (1 + F.exp(-z))


def labelled_kinds() -> dict[str, tuple[int, list[str]]]:
    """The package's own kinds: whether they are blocked, and their hosts."""
    lines = resources.files(__package__).joinpath(TABLE).read_text("utf-8").splitlines()[1:]
    return {kind: (int(blocked), hosts.split()) for kind, blocked, hosts in (line.split("\t") for line in lines)}


def labelled_rows(kinds: dict[str, tuple[int, list[str]]] | None = None) -> list[tuple[str, int]]:
    """(url, blocked): URLS urls of each host; domain, subdomain, language and number go by the host's place, so they tell nothing."""
    hosts = [(h, blocked) for blocked, own in (kinds or labelled_kinds()).values() for h in own]
    out = []
    for i, (host, blocked) in enumerate(hosts):
        for k in range(URLS):
            n = URLS * i + k
            front = ("", "www.", "", "m.", "blog.")[n % 5]
            end = ("", ".html", "?page=2", "/", "#top")[n // 5 % 5]
            out.append((f"http{'s' * (n % 2)}://{front}{host}.example.{DOMAINS[n % 3]}/{LANGUAGES[n // 3 % 4]}/{n * 37 % 1000}{end}", blocked))
    return out


def labelled_urls(spark: SparkSession, rows: list[tuple[str, int]] | None = None) -> DataFrame:
    """(url, blocked) of the given rows; the package's own if none are given."""
    return spark.createDataFrame(labelled_rows() if rows is None else rows, "url string, blocked int")


def judge(pages: DataFrame, model: tuple[float, list[float]], rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, url, host, path, rule, verdict, block_score); the score is null where a rule decides."""
    url = F.col(url_col).cast("string")
    host, path = host_and_path(url)
    split = pages.select(F.col(id_col).alias("page_id"), url.alias("url"), host.alias("host"), path.alias("path"))
    ruled = split.withColumn("fits", fitting_rule(F.col("host"), F.col("path"), rules))
    scored = ruled.withColumn("block_score", F.when(F.col("fits").isNull(), block_score(F.col("host"), F.col("path"), model)))
    verdict = F.coalesce(F.col("fits.verdict"), F.when(F.col("block_score") >= 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "url", "host", "path", F.col("fits.rule").alias("rule"), verdict.alias("verdict"), "block_score")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), fit(labelled_urls(spark))).select("page_id", "host", "path", "rule", "verdict")
