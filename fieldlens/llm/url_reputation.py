"""URL filters: explicit rules first, else the host's empirical-Bayes reputation.

Labelled page outcomes (1: bad) are counted by host. Bad rates shrink from
host to registered domain to suffix to the whole: at each level the children's
rates are beta-binomial around their parent's posterior mean, and the prior's
strength comes from the moments of that level. A host is blocked if the lower
posterior bound of its bad rate is above a limit; hosts without outcomes have
their domain's prior.

Defined cases: a null url, or one without "://", has an empty host and path and
no rule, and counts as the host ""; of several fitting rules the longest text
wins; pages without a rule on hosts without any evidence have the prior's
verdict; repeated rows are judged each; an empty table gives an empty result.
Evidence goes by the host without user name, port and last dot; a host that is
an address of numbers is its own domain and suffix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlens.llm.registry import query, table
from fieldlens.llm.support import materialize, small

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, rule); a rule is a host and a path that starts with "/".
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
#: Public suffixes of more than one label; any other suffix is the last label. A full table can be given instead.
SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.sg", "com.tr", "com.tw", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk")
#: Standard deviations below the posterior mean, and the bad rate above which a host is blocked.
Z, LIMIT = 1.645, 0.5


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. rules: a configured list, which the plan holds."""
    rule = verdict = None
    for v, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def strength(level: DataFrame, mean: str) -> float:
    """Prior strength M from the moments of children with n outcomes, y bad, around their parent's mean."""
    v = F.col(mean) * (1 - F.col(mean))
    r = level.filter("n > 0").agg(
        F.sum(F.pow(F.col("y") / F.col("n") - F.col(mean), F.lit(2.0)) * F.col("n") - v).alias("over"),
        F.sum(v * (F.col("n") - 1)).alias("most"),
    ).first()
    rho = (r["over"] / r["most"]) if r["over"] is not None and r["most"] else 0.5
    rho = min(0.999, max(0.001, rho))
    return 1 / rho - 1


def reputation_key(host: Column) -> Column:
    """The host that evidence goes by."""
    return F.regexp_replace(F.regexp_replace(host, r"(?s)^.*@", ""), r"\.?(:[0-9]*)?\z", "")


def suffix_and_domain(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> tuple[Column, Column]:
    """(public suffix, registered domain: the suffix and one label more)."""
    last = F.element_at(F.split(host, r"\."), -1)
    suffix = F.when(last.rlike("^[0-9]+$"), host)
    for s in sorted(suffixes, key=lambda s: (-len(s), s)):
        suffix = suffix.when((host == s) | host.endswith(f".{s}"), F.lit(s))
    suffix = suffix.otherwise(last)
    before = F.substring(host, F.lit(1), F.length(host) - F.length(suffix) - 1)
    return suffix, F.when(host == suffix, host).otherwise(F.concat(F.element_at(F.split(before, r"\."), -1), F.lit("."), suffix))


def host_reputation(outcomes: DataFrame, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """outcomes: host, n, y (one row per host). Returns host, mean and bound: the lower posterior bound of its bad rate."""
    suffix, domain = suffix_and_domain(F.col("host"), suffixes)
    hosts = outcomes.select("host", F.col("n").cast("double").alias("n"), F.col("y").cast("double").alias("y"), suffix.alias("suffix"), domain.alias("domain"))
    hosts = materialize(hosts, "hosts")
    suffixes = materialize(hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("y").alias("y")), "suffixes")
    total = suffixes.agg(F.sum("n").alias("n"), F.sum("y").alias("y")).first()
    whole = ((total["y"] or 0) + 1) / ((total["n"] or 0) + 2)
    m = strength(suffixes.withColumn("up", F.lit(whole)), "up")
    suffixes = suffixes.select("suffix", ((F.col("y") + m * whole) / (F.col("n") + m)).alias("up"))
    domains = materialize(hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("y").alias("y")).join(suffixes, "suffix"), "domains")
    m = strength(domains, "up")
    domains = domains.select("domain", ((F.col("y") + m * F.col("up")) / (F.col("n") + m)).alias("up"))
    hosts = materialize(hosts.join(domains, "domain"), "hosts-domains")
    m = strength(hosts, "up")
    a, b = F.col("y") + m * F.col("up"), F.col("n") - F.col("y") + m * (1 - F.col("up"))
    s = a + b
    return hosts.select("host", (a / s).alias("mean"), (a / s - Z * F.sqrt(a * b / (s * s * (s + 1)))).alias("bound"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]] = RULES, outcome: Column | None = None, id_col: str = "page_id", url_col: str = "url", suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """page_id, host, path, rule, verdict of every page.

    outcome: 1 bad, 0 good, null unlabelled, over the columns of pages; by
    default the rules label the pages which they fit.
    """
    host, path = host_and_path(F.col(url_col))
    label = F.lit(None).cast("int") if outcome is None else outcome.cast("int")
    base = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), label.alias("label"))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    base = base.select("*", rule.alias("rule"), verdict.alias("ruled"), reputation_key(F.col("host")).alias("key"))
    bad = F.when(F.col("ruled") == "block", 1).when(F.col("ruled") == "allow", 0) if outcome is None else F.col("label")
    counts = base.groupBy(F.col("key").alias("host")).agg(F.count(bad).alias("n"), F.coalesce(F.sum(bad), F.lit(0)).alias("y"))
    reputation = small(materialize(host_reputation(counts, suffixes).select(F.col("host").alias("h"), (F.col("bound") > LIMIT).alias("bad")), "reputation"))
    return base.join(reputation, F.col("key") == F.col("h")).select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("bad"), "block").otherwise("allow")).alias("verdict"))


def _sql() -> str:
    cases = sorted(RULES, key=lambda r: (-len(r[1]), r[1]))
    fits = [(v, t, f"(host = '{t.split('/')[0]}' OR ends_with(host, '.{t.split('/')[0]}')) AND starts_with(path, '/{t.partition('/')[2]}')") for v, t in cases]

    def m(table: str) -> str:
        return (
            f"(SELECT 1 / least(0.999, greatest(0.001, CASE WHEN sum(up * (1 - up) * (n - 1)) <> 0 THEN "
            f"sum(pow(y / n - up, 2) * n - up * (1 - up)) / sum(up * (1 - up) * (n - 1)) ELSE 0.5 END)) - 1 FROM {table} WHERE n > 0)"
        )

    return f"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r AS (
  SELECT *, CASE {' '.join(f"WHEN {f} THEN '{t}'" for _, t, f in fits)} END AS rule,
         CASE {' '.join(f"WHEN {f} THEN '{v}'" for v, _, f in fits)} END AS ruled FROM p
), k AS (
  SELECT *, regexp_replace(regexp_replace(host, '(?s)^.*@', ''), '\\.?(:[0-9]*)?\\z', '') AS key FROM r
), x AS (
  SELECT key AS host, CAST(count(ruled) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE ruled = 'block') AS DOUBLE) AS y,
         CASE WHEN regexp_matches(split_part(key, '.', -1), '^[0-9]+$') THEN key {' '.join(f"WHEN key = '{x}' OR ends_with(key, '.{x}') THEN '{x}'" for x in sorted(SUFFIXES, key=lambda x: (-len(x), x)))}
              ELSE split_part(key, '.', -1) END AS suffix
  FROM k GROUP BY key
), h AS (
  SELECT *, CASE WHEN host = suffix THEN host ELSE split_part(left(host, len(host) - len(suffix) - 1), '.', -1) || '.' || suffix END AS domain FROM x
), g AS (SELECT (sum(y) + 1) / (sum(n) + 2) AS up FROM h
), s0 AS (SELECT suffix, sum(n) AS n, sum(y) AS y, (SELECT up FROM g) AS up FROM h GROUP BY suffix
), s1 AS (SELECT suffix, (y + m * up) / (n + m) AS up FROM (SELECT *, {m('s0')} AS m FROM s0)
), d0 AS (SELECT suffix, domain, sum(n) AS n, sum(y) AS y FROM h GROUP BY suffix, domain
), d1 AS (SELECT d0.domain, n, y, up FROM d0 JOIN s1 USING (suffix)
), d2 AS (SELECT domain, (y + m * up) / (n + m) AS up FROM (SELECT *, {m('d1')} AS m FROM d1)
), h1 AS (SELECT host, n, y, up FROM h JOIN d2 USING (domain)
), h2 AS (SELECT host, y + m * up AS a, n - y + m * (1 - up) AS b FROM (SELECT *, {m('h1')} AS m FROM h1)
)
SELECT page_id, k.host, path, rule,
  coalesce(ruled, CASE WHEN a / (a + b) - {Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > {LIMIT} THEN 'block' ELSE 'allow' END) AS verdict
FROM k JOIN h2 ON k.key = h2.host
"""


@query("op2_url_reputation", _sql())
def op2_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))
