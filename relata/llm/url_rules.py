"""URL filtering with rules indexed by their rarest literal token.

A rule is a host and a path beginning, and holds for the host and all its
subdomains. Its literal tokens are the labels of its host and the whole segments
of its path: a URL it fits has all of them. Each rule is filed under the one that
the fewest URLs have. A URL's tokens fetch the rules filed under them, and only
those are run as regular expressions; of the rules that fit, the longest wins.

Scale: distinct URLs are judged once, with joins on tokens whose sides the
engine broadcasts only below its size threshold and otherwise shuffles and
splits where skewed; the rows come back by a join on the URL, in which URLs of very many rows are
broadcast. A very long URL is a row like any other. Counts of tokens
are over all distinct URLs, and only of tokens that some rule has.

Defined results: a null URL, or one without ://, has an empty host and path and
fits no rule; repeated rows each get their verdict; rules without any token are
tried on all URLs; of rules of equal length the lesser in code-point order wins;
no rules, or no rows, give the default verdict or no rows; extra columns of the
table are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relata.llm.frames import split_join, table
from relata.session import written

#: (action, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
RULE_SCHEMA = "action string, host string, path string"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z in lower case, and the path; both empty without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + F.lit(1), F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def tokens(host: Column, path: Column, whole_segments: bool = False) -> Column:
    """Labels of the host and segments of the path, marked apart; whole_segments: without the last, which a longer path may continue."""
    labels = F.transform(F.filter(F.split(host, r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x))
    parts = F.split(path, "/", -1)
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1) if whole_segments else parts
    return F.array_distinct(F.concat(labels, F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit("p:"), x))))


def quoted(text: Column) -> Column:
    return F.regexp_replace(text, r"([^A-Za-z0-9/_-])", r"\\$1")


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """(url, n, rule, action) of the distinct URLs, n rows of each; without rule and action where no rule fits."""
    host, path = host_and_path(F.col("url"))
    urls = written(pages.select(F.col(url_col).alias("url")).where("url is not null").groupBy("url").count().select("url", host.alias("host"), path.alias("path"), F.col("count").alias("n")), "urls")
    filed = rules.select("action", "host", "path", F.concat("host", "path").alias("rule")).distinct()
    end = F.when(F.col("path") == "", F.lit(r"(?=/|\z)")).otherwise(quoted(F.col("path")))
    filed = filed.withColumn("pattern", F.concat(F.lit(r"^(?:[^/]*\.)?"), quoted(F.col("host")), end))
    has = filed.select("action", "host", "path", "rule", "pattern", F.explode_outer(tokens(F.col("host"), F.col("path"), True)).alias("token")).withColumn("token", F.coalesce("token", F.lit("")))
    met = urls.select("url", "host", "path", F.explode(F.concat(F.array(F.lit("")), tokens(F.col("host"), F.col("path")))).alias("token"))
    counts = met.select("token").join(has.select("token").distinct(), "token").groupBy("token").count()
    index = has.join(counts, "token", "left").groupBy("action", "rule", "pattern").agg(F.min(F.struct(F.coalesce("count", F.lit(0).cast("long")).alias("n"), "token"))["token"].alias("token"))
    index = written(index, "rules")
    fits = met.join(index, "token").where(F.expr("rlike(concat(host, path), pattern)"))
    best = F.min(F.struct((-F.length("rule")).alias("shorter"), "rule", "action"))
    judged = fits.groupBy("url").agg(best.alias("best"))
    return urls.select("url", "n").join(judged, "url", "left").select("url", "n", "best.rule", "best.action")


def verdicts(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of pages."""
    found = written(judge(pages, rules, url_col), "judged")
    host, path = host_and_path(F.col("url"))
    all_rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    nothing = F.lit(None).cast("string")
    rows = split_join(all_rows, found, "url", "n").unionByName(all_rows.where("url is null").select("page_id", "url", nothing.alias("rule"), nothing.alias("action")))
    return rows.select("page_id", host.alias("host"), path.alias("path"), "rule", F.coalesce("action", F.lit(default)).alias("verdict"))


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(table(spark, sf_dir, "pages"), spark.createDataFrame(list(RULES), RULE_SCHEMA))


ORACLE = """
WITH rules(action, host, path) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
parts AS (
  SELECT page_id, CASE WHEN url IS NOT NULL AND strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
),
split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path,
         row_number() OVER () AS n
  FROM parts
),
fits AS (
  SELECT s.n, r.host || r.path AS rule, r.action, row_number() OVER (PARTITION BY s.n ORDER BY length(r.host || r.path) DESC, r.host || r.path) AS k
  FROM split s JOIN rules r ON (s.host = r.host OR ends_with(s.host, '.' || r.host)) AND starts_with(s.path, r.path)
)
SELECT s.page_id, s.host, s.path, f.rule, coalesce(f.action, 'allow') AS verdict
FROM split s LEFT JOIN fits f ON s.n = f.n AND f.k = 1
"""
