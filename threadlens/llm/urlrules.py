"""URL filters: rules indexed by their rarest literal token.

Host rules are a host with a path prefix, pattern rules regular expressions.  Each rule is filed under
the one of its literal tokens that is rarest in the URLs at hand.  A URL fetches the rules filed under
its own tokens, and only those are verified on it: host and path prefix, or the regular expression.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import UPPER, ascii_lower, stored

# FIXED VALUES: host rules (action, host, path) and pattern rules (regular expression over the
# lower-cased URL, literal tokens that any match contains as whole tokens).
HOST_RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
              ("block", "net", "/es/"), ("block", "net", "/fr/"))
PATTERN_RULES = (
    (r"^[^:]*://([^/?#]*\.)?casino-[a-z0-9]+\.", ("casino",)),
    (r"^[^:]*://([^/?#]*\.)?free-bets\.", ("free", "bets")),
    (r"^[^:]*://([^/?#]*\.)?cheap-pills\.", ("cheap", "pills")),
    (r"^[^:]*://([^/?#]*\.)?(ads|adserver|doubleclick)\.example\.org", ("example",)),
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(url: Column) -> Column:
    """Distinct runs of letters and digits of the lower-cased URL."""
    return F.array_distinct(F.regexp_extract_all(ascii_lower(url), F.lit("([a-z0-9]+)"), 1))


def whole_tokens(host: str, path: str) -> list[str]:
    """The tokens that every URL under this host and path prefix holds whole."""
    ended = re.sub(r"[a-z0-9]+$", "", path.lower(), flags=re.ASCII)  # the path may go on behind its last run
    return sorted(set(re.findall(r"[a-z0-9]+", f"{host} {ended}")))


def rule_index(offered: DataFrame, host_rules, pattern_rules) -> DataFrame:
    """All rules, each under the rarest of its literal tokens among the tokens offered ('' without any)."""
    lower = str.maketrans(UPPER, UPPER.lower())  # hosts are compared in lower case; the rule keeps its name
    rules = [(None, None, f"{h}{p}", h.translate(lower), p, a, whole_tokens(h.translate(lower), p)) for a, h, p in host_rules]
    rules += [(i, p, None, None, None, None, list(t)) for i, (p, t) in enumerate(pattern_rules)]
    names = ["pattern_id", "pattern", "rule", "rule_host", "rule_path", "action"]
    literals = offered.sparkSession.createDataFrame(
        rules, "pattern_id int, pattern string, rule string, rule_host string, rule_path string, action string, "
               "literals array<string>").select(*names, F.explode(
                   F.when(F.size("literals") > 0, F.col("literals")).otherwise(F.array(F.lit("")))).alias("token"))
    seen = offered.join(literals.select("token").distinct(), "token", "left_semi").groupBy("token") \
        .agg(F.count("*").alias("n"))
    return (literals.join(seen, "token", "left").groupBy(*names)
            .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("rarest"))
            .select(*names, F.col("rarest.token").alias("token")))


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", host_rules=HOST_RULES,
               pattern_rules=PATTERN_RULES) -> DataFrame:
    """One row per input row: id, host, path, rule (the deciding host rule or null), pattern (the
    first matching pattern rule or null), verdict.

    A host rule fits its host (A-Z in any case) and all subdomains if the path starts with the rule's; the longest
    wins.  Without one, any matching pattern blocks (the first listed is named) and the rest is allowed.  Null URLs and URLs without
    ``://`` have an empty host and path and no rule; a null URL is allowed.  Patterns without a literal
    token are tried on every URL.  Repeated rows keep a row each, whatever the other columns."""
    spark = pages.sparkSession
    urls = stored(pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
                  .select("id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
                  .withColumn("row", F.monotonically_increasing_id()), "urls")

    offered = urls.where("url IS NOT NULL").select("row", "url", "host", "path", F.explode(
        F.array_union(F.array(F.lit("")), url_tokens(F.col("url")))).alias("token"))
    index = stored(rule_index(offered, host_rules, pattern_rules), "url-index")
    under = (F.col("host") == F.col("rule_host")) | F.expr("endswith(host, concat('.', rule_host))")
    fits = F.when(F.col("rule").isNotNull(), under & F.expr("startswith(path, rule_path)")) \
        .otherwise(F.expr("lower(url) RLIKE pattern"))
    # equal lengths can't fit one URL twice unless the rules are equal; the text decides then
    matched = offered.join(index, "token").where(fits).groupBy("row").agg(
        F.max(F.when(F.col("rule").isNotNull(), F.struct(F.length("rule").alias("n"), "rule", "action"))).alias("best"),
        F.min(F.when(F.col("pattern").isNotNull(), F.struct("pattern_id", "pattern"))).alias("hit"))

    verdict = F.coalesce(F.col("best.action"), F.when(F.col("hit").isNotNull(), F.lit("block")), F.lit("allow"))
    return (urls.join(matched, "row", "left")
            .select("id", "host", "path", F.col("best.rule").alias("rule"), F.col("hit.pattern").alias("pattern"),
                    verdict.alias("verdict")))


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    """Registered query: a verdict for every page's URL."""
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet")).select(
        F.col("id").cast(T.LongType()).alias("page_id"), "host", "path", "rule", "verdict", "pattern")


def _oracle() -> str:
    host = " ".join(f"WHEN path[1:{len(p)}] = '{p}' AND (host = '{h}' OR host LIKE '%.{h}') THEN '{h}{p}'"
                    for _, h, p in sorted(HOST_RULES, key=lambda r: -len(r[1] + r[2])))
    action = " ".join(f"WHEN '{h}{p}' THEN '{a}'" for a, h, p in HOST_RULES)
    pattern = " ".join(f"WHEN regexp_matches(lower(url), '{p}') THEN '{p}'" for p, _ in PATTERN_RULES)
    up, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
    WITH parts AS (
      SELECT page_id, url,
             coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '{up}', '{low}'), '') AS host,
             coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
      FROM pages),
    ruled AS (SELECT *, CASE {host} END AS rule, CASE {pattern} END AS pattern FROM parts)
    SELECT page_id, host, path, rule, pattern,
           coalesce(CASE rule {action} END, CASE WHEN pattern IS NOT NULL THEN 'block' END, 'allow') AS verdict
    FROM ruled"""


ORACLE = _oracle()
