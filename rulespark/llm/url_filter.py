"""URL filtering by host and path rules.

Each url becomes host-suffix x path-prefix expressions; their SHA-256 meets the rules' in an equi-join on a
short hash prefix, the full digest confirms, and the longest rule decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import small_enough, staged, table

#: (host, path, verdict)
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
PREFIX_HEX = 8
BROADCAST_RULES = 100_000
HOT = 1000


def url_parts(url):
    """Host and path columns of a url: empty without ``://``. Only A-Z of the host are lower-cased."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(__u, instr(__u, '://') + 3)")).otherwise("")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), upper, lower)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def with_parts(df: DataFrame, url: str) -> DataFrame:
    df = df.withColumn("__u", F.coalesce(F.col(url), F.lit("")))
    host, path = url_parts(F.col("__u"))
    return df.withColumn("host", host).withColumn("path", path).drop("__u")


def judge_urls(urls: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Rule and verdict for each distinct (host, path) of ``urls``.

    ``rules`` has host, path, verdict. A rule fits its host and all subdomains where the url's path starts with the
    rule's; the longest host + path wins, then the longer host, then block over allow. Rows without host never match a
    rule. Rules with nulls are ignored; repeated rules count once. No fitting rule: rule null, verdict ``default``.
    """
    rules = rules.select(F.lower("host").alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict")).dropna().distinct()
    rules = rules.withColumn("r_expr", F.concat("r_host", "r_path")).withColumn("r_digest", F.sha2(F.concat_ws("\x00", "r_host", "r_path"), 256))
    rules = rules.withColumn("prefix", F.substring("r_digest", 1, PREFIX_HEX))
    # path lengths and label counts that rules use: bounded by the longest rule, not by their number
    shape = rules.agg(F.collect_set(F.length("r_path")).alias("lengths"), F.collect_set(F.size(F.split("r_host", r"\."))).alias("labels")).first()
    lengths, labels = sorted(shape["lengths"]), sorted(shape["labels"])
    keys = urls.select("host", "path").distinct()
    arrays = lambda xs: F.array(*[F.lit(int(x)) for x in xs]) if xs else F.array().cast("array<int>")
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.filter(arrays(labels), lambda n: n <= F.size(parts)), lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."))
    prefixes = F.transform(F.filter(arrays(lengths), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    exprs = keys.where(F.col("host") != "").select("host", "path", F.explode(suffixes).alias("e_host"), prefixes.alias("ps")).select("host", "path", "e_host", F.explode("ps").alias("e_path"))
    exprs = exprs.withColumn("digest", F.sha2(F.concat_ws("\x00", "e_host", "e_path"), 256)).withColumn("prefix", F.substring("digest", 1, PREFIX_HEX))
    side = F.broadcast(rules) if small_enough(rules, BROADCAST_RULES) else rules
    hits = exprs.join(side, "prefix").where(F.col("digest") == F.col("r_digest"))
    rank = F.struct(F.length("r_expr"), F.length("r_host"), F.col("r_verdict") == "block")
    best = hits.groupBy("host", "path").agg(F.max_by(F.struct("r_expr", "r_verdict"), rank).alias("best"))
    return keys.join(best, ["host", "path"], "left").select("host", "path", F.col("best.r_expr").alias("rule"), F.coalesce("best.r_verdict", F.lit(default)).alias("verdict"))


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule, verdict. Null or scheme-less urls have empty host and path, and never match.
    Columns of these names are replaced; repeated rows stay; an empty table gives no rows.

    Only (host, path) pairs that a rule fits are joined back. Those of more than one in HOT of the rows are broadcast
    apart from the rest, so no task gets all rows of one url.
    """
    parts = with_parts(pages.drop("host", "path", "rule", "verdict"), url)
    judged = staged(judge_urls(parts, rules, default).where("rule IS NOT NULL"), "judged")
    if small_enough(judged, BROADCAST_RULES):
        out = parts.join(F.broadcast(judged), ["host", "path"], "left")
    else:
        total = parts.count()
        common = parts.where(F.col("host") != "").groupBy("host", "path").count().where(F.col("count") * HOT > total).select("host", "path")
        common = staged(common, "common")  # fewer than HOT rows
        told = judged.join(F.broadcast(common), ["host", "path"])
        marked = parts.join(F.broadcast(common.withColumn("__common", F.lit(True))), ["host", "path"], "left")
        # rows without a host match nothing, so they need no join
        rest = marked.where("__common IS NULL AND host <> ''").drop("__common").join(judged, ["host", "path"], "left")
        hot = marked.where("__common").drop("__common").join(F.broadcast(told), ["host", "path"], "left")
        none = marked.where("host = ''").drop("__common").withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(None).cast("string"))
        out = rest.unionByName(hot).unionByName(none)
    return out.withColumn("verdict", F.coalesce("verdict", F.lit(default)))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


SQL = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
hp AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
rules(rh, rp, rv) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block'))
SELECT hp.page_id, hp.host, hp.path, arg_max(rh || rp, length(rh || rp)) AS rule, coalesce(arg_max(rv, length(rh || rp)), 'allow') AS verdict
FROM hp LEFT JOIN rules ON (hp.host = rh OR hp.host LIKE '%.' || rh) AND starts_with(hp.path, rp)
GROUP BY hp.page_id, hp.host, hp.path
"""
