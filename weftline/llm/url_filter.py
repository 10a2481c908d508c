"""URL filter: listed rules first, then empirical-Bayes reputation of the host (DataFrame functions only).

Labelled page outcomes are counted by host. Beta-binomial priors shrink them downwards: all pages give the mean of a suffix's prior,
the suffix's posterior that of its registered domains, and theirs that of their hosts, each without the group's own outcomes. How
strong the prior of a level may be comes from the level itself: the spread of its groups beyond binomial noise gives the correlation of
two outcomes of one group by moments, and that the prior's weight in pages. A host is blocked where even the upper bound of its posterior share
of good pages lies below LEAST_GOOD, so a few bad labels block no host, and hosts without labels go by their domain.

A null label is no label; of repeated labels of a page a bad one counts; a row that repeats a page counts again. Pages are joined to
labels by id with the pages' side unaggregated, so that Spark can split a frequent id; hosts are summed before they are shuffled.

Defined results: a url that is null or has no `://` has an empty host and path, and such pages share one reputation; a user name and
a port belong to `host`, not to the host whose reputation counts; a numeric address or a single label is its own domain with an empty suffix;
a null page_id has no label; without labels nothing is blocked but by rules; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import UPPER, cut, table
from weftline.llm.jaccard_join import few

#: verdict, host, start of the path. Fixed values of the contract.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Suffixes of two labels under which names are registered; a parameter, to be replaced by a full list where one is at hand.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "or.jp", "co.kr", "co.nz", "co.in", "com.br", "com.cn", "com.mx", "com.tr", "co.za")
LEAST_GOOD, BOUND_Z = 0.5, 1.645
#: Weight of a prior in pages: where a level can't tell (no group with two labels), and its limits.
DEFAULT_STRENGTH, LEAST_STRENGTH, MOST_STRENGTH = 10.0, 1.0, 1000.0
#: More rules than this are joined instead of being written into one expression.
MOST_INLINE = 64


def with_parts(pages: DataFrame) -> DataFrame:
    """Add host, path, and address (the host without user name, port and closing dots)."""
    at = F.locate("://", "url")
    rest = F.when(at > 0, F.substring("url", at + 3, F.char_length("url"))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.char_length(host) + 1, F.char_length(rest)), "^[^?#]*", 0)
    found = pages.withColumns({"host": F.translate(host, UPPER, UPPER.lower()), "path": path})
    return found.withColumn("address", F.regexp_replace(F.regexp_replace("host", "^[^@]*@", ""), r"(:[0-9]*)?\.*$", ""))


def with_domain(hosts: DataFrame, suffixes: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """Add domain and suffix to rows with an address."""
    two = F.substring_index("address", ".", -2)
    named = F.col("address").contains(".") & ~F.col("address").rlike(r"^[0-9.]*$|\[")
    known = two.isin(*suffixes)
    suffix = F.when(named, F.when(known, two).otherwise(F.substring_index("address", ".", -1))).otherwise("")
    domain = F.when(named, F.when(known, F.substring_index("address", ".", -3)).otherwise(two)).otherwise(F.col("address"))
    return hosts.withColumns({"suffix": suffix, "domain": domain})


def inline_rule(rules) -> Column:
    """struct(rule, verdict) of the longest rule that fits host and path, else null."""
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        found = F.when(fits, F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def joined_rules(pages: DataFrame, rules) -> DataFrame:
    """As inline_rule for long lists: a url asks for each of its host's suffixes with each start of its path of a length that rules have."""
    lengths = sorted({len(path) for _, _, path in rules})
    listed = pages.sparkSession.createDataFrame([(h, p, v) for v, h, p in rules], "at string, start string, verdict string")
    urls = pages.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = urls.withColumn("at", F.explode(ends)).withColumn("length", F.explode(F.array(*map(F.lit, lengths)))).filter(F.char_length("path") >= F.col("length"))
    fits = asked.withColumn("start", F.substring(F.col("path"), F.lit(1), F.col("length"))).join(listed, ["at", "start"])
    order = F.struct(F.char_length("at") + F.char_length("start"), F.char_length("at"), F.col("verdict"))
    best = fits.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("at", "start").alias("rule"), "verdict"), order).alias("listed"))
    return pages.join(cut(best), ["host", "path"], "left")


def with_rule(pages: DataFrame, rules=RULES) -> DataFrame:
    """Add listed: struct(rule, verdict) of the longest rule that fits, by host and path together; null where none fits."""
    return pages.withColumn("listed", inline_rule(rules)) if len(rules) <= MOST_INLINE else joined_rules(pages, rules)


def labelled(labels: DataFrame) -> DataFrame:
    """page_id, good of each labelled page."""
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    good = F.when(bad, False).when(F.col("quality") == 1, True)
    return labels.select(F.col("doc_id").alias("page_id"), good.alias("good")).groupBy("page_id").agg(F.min("good").alias("good")).filter("good is not null")


def shrunk(groups: DataFrame) -> DataFrame:
    """Add alpha and beta, the posterior of each group with n outcomes, k of them good. above_alpha, above_beta: the posterior of the group above.

    Without the group's own outcomes that posterior is what its siblings say: it gives the prior's mean. The prior's weight is what the level's
    spread allows, less the doubt about that mean: the inverses of both weights add.
    """
    left_alpha, left_beta = F.col("above_alpha") - F.col("k"), F.col("above_beta") - (F.col("n") - F.col("k"))
    groups = groups.withColumn("siblings", left_alpha + left_beta).withColumn("mean", left_alpha / F.col("siblings"))
    expected, noise = F.col("n") * F.col("mean"), F.col("mean") * (1 - F.col("mean"))
    beyond = F.sum((F.col("k") - expected) * (F.col("k") - expected) - F.col("n") * noise)
    shared = F.try_divide(beyond, F.sum(F.col("n") * (F.col("n") - 1) * noise))
    strength = F.coalesce(F.when(shared <= 0, F.lit(MOST_STRENGTH)).otherwise(F.least(F.greatest(1 / shared - 1, F.lit(LEAST_STRENGTH)), F.lit(MOST_STRENGTH))), F.lit(DEFAULT_STRENGTH))
    most = groups.agg(strength).first()[0]
    weight = most * F.col("siblings") / (F.col("siblings") + most)
    return groups.withColumns({"alpha": weight * F.col("mean") + F.col("k"), "beta": weight * (1 - F.col("mean")) + F.col("n") - F.col("k")})


def reputation(pages: DataFrame, outcomes: DataFrame, z: float = BOUND_Z) -> DataFrame:
    """address, domain, suffix, n, k (labelled and good pages), alpha, beta, mean and upper of every host.

    pages: page_id, address; outcomes: page_id, good. The bound is mean + z standard deviations of the posterior.
    """
    seen = pages.join(cut(outcomes.select("page_id", "good")), "page_id").select("address", F.lit(1).alias("n"), F.col("good").cast("int").alias("k"))
    rows = seen.unionByName(pages.select("address", F.lit(0).alias("n"), F.lit(0).alias("k")))
    hosts = cut(with_domain(rows.groupBy("address").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))))
    domains = cut(hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k")))
    suffixes = cut(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")))
    n, k = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("k"), F.lit(0))).first()
    above = lambda groups, key: few(cut(groups.select(key, F.col("alpha").alias("above_alpha"), F.col("beta").alias("above_beta"))))
    suffixes = shrunk(suffixes.withColumns({"above_alpha": F.lit(k + 1.0), "above_beta": F.lit(n - k + 1.0)}))
    domains = shrunk(domains.join(above(suffixes, "suffix"), "suffix"))
    found = shrunk(hosts.join(above(domains, "domain"), "domain")).withColumn("mean", F.col("alpha") / (F.col("alpha") + F.col("beta")))
    spread = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("alpha") + F.col("beta") + 1))
    return found.select("address", "domain", "suffix", "n", "k", "alpha", "beta", "mean", (F.col("mean") + z * spread).alias("upper"))


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, least: float = LEAST_GOOD) -> DataFrame:
    """page_id, url, host, path, rule, verdict of every row of pages (page_id, url)."""
    parted = with_parts(pages.select("page_id", "url"))
    bad = cut(reputation(parted.select("page_id", "address"), outcomes).filter(F.col("upper") < least).select("address", F.lit(True).alias("bad")))
    found = with_rule(parted, rules).join(few(bad), "address", "left")
    verdict = F.coalesce(F.col("listed.verdict"), F.when(F.col("bad"), "block").otherwise("allow"))
    return found.select("page_id", "url", "host", "path", F.col("listed.rule").alias("rule"), verdict.alias("verdict"))


def op11_filter_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels are those of `labels` whose doc_id is the page's id: the tables have no other outcomes of pages."""
    return judge(table(spark, sf_dir, "pages"), labelled(table(spark, sf_dir, "labels"))).drop("url")


def _sql_level(name: str, groups: str, key: str, above: str) -> str:
    """Posteriors of one level; above: a join that brings above_alpha and above_beta."""
    strength = f"coalesce(case when shared <= 0 then {MOST_STRENGTH} else least(greatest(1 / shared - 1, {LEAST_STRENGTH}), {MOST_STRENGTH}) end, {DEFAULT_STRENGTH})"
    return f"""{name}_p as (select *, (above_alpha - k) / w as m from (select g.*, above_alpha, above_alpha + above_beta - n as w from {groups} g {above})),
{name}_s as (select {strength} as s from (select sum((k - n * m) * (k - n * m) - n * m * (1 - m)) / nullif(sum(n * (n - 1) * m * (1 - m)), 0) as shared from {name}_p)),
{name}_post as (select {key}, s * w / (s + w) * m + k as above_alpha, s * w / (s + w) * (1 - m) + n - k as above_beta from {name}_p, {name}_s)"""


_SUFFIXES = ", ".join(f"'{s}'" for s in TWO_LABEL_SUFFIXES)
_RULE_ROWS = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
ORACLE_SQL = rf"""
with split_urls as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
heads as (select page_id, rest, regexp_extract(rest, '^[^/?#]*') as h from split_urls),
parted as (
  select page_id, translate(h, '{UPPER}', '{UPPER.lower()}') as host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') as path from heads),
addressed as (
  select *, regexp_replace(regexp_replace(host, '^[^@]*@', ''), '(:[0-9]*)?\.*$', '') as address from parted),
outcomes as (
  select doc_id as page_id, min(case when quality = 0 or toxic = 1 then 0 when quality = 1 then 1 end) as good from labels group by doc_id),
counted as (
  select address, count(good) as n, coalesce(sum(good), 0) as k from addressed left join outcomes using (page_id) group by address),
named as (
  select *, contains(address, '.') and not regexp_matches(address, '^[0-9.]*$|\[') as is_named, string_split(address, '.') as labels from counted),
two as (select *, array_to_string(labels[-2:], '.') as last_two from named),
hosts as (
  select address, n, k,
    case when not is_named then '' when last_two in ({_SUFFIXES}) then last_two else labels[-1] end as suffix,
    case when not is_named then address when last_two in ({_SUFFIXES}) then array_to_string(labels[-3:], '.') else last_two end as domain
  from two),
domains as (select suffix, domain, sum(n)::double as n, sum(k)::double as k from hosts group by all),
suffixes as (select suffix, sum(n) as n, sum(k) as k from domains group by all),
overall as (select sum(k) + 1 as above_alpha, sum(n) - sum(k) + 1 as above_beta from suffixes),
{_sql_level("s", "suffixes", "suffix", ", overall")},
{_sql_level("d", "domains", "domain", "join s_post using (suffix)")},
{_sql_level("h", "hosts", "address", "join d_post using (domain)")},
means as (select address, above_alpha + above_beta as whole, above_alpha / (above_alpha + above_beta) as mean from h_post),
bad as (select address from means where mean + {BOUND_Z} * sqrt(mean * (1 - mean) / (whole + 1)) < {LEAST_GOOD}),
rules (rule_verdict, rule_host, rule_path) as (values {_RULE_ROWS}),
urls as (select distinct host, path from parted),
best as (
  select host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) as rule, arg_max(rule_verdict, length(rule_host || rule_path)) as rule_verdict
  from urls join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path) group by all)
select a.page_id, a.host, a.path, best.rule, coalesce(best.rule_verdict, case when bad.address is not null then 'block' else 'allow' end) as verdict
from addressed a left join best using (host, path) left join bad using (address)
"""
