"""URL filters: rules first, then a path-template tree, with DataFrame functions only.

Rules decide where one fits (the longest wins). For the rest, each host has a tree of path
segments. Segments of a plain variable shape become wildcards at once, so the tree is built
over the distinct shaped paths of a host and not over its URLs. Level by level from the
host down, literal segments with a small share of their parent become ``*``. Then, level by
level from the deepest up, so that subtrees are compared as they have been generalised,
sibling branches are merged when they are statistically alike: among siblings with the
same main subtree, a branch joins the merged one when a chi-squared test tells neither its
distribution over subtrees nor that of its labels from these siblings pooled. A branch
without labels says nothing against any, so what is known of one branch reaches its
unlabelled likes; branches with opposite labels stay apart. Branches meet their pool and
never each other. A template is rejected if it has enough labelled URLs and its share of
bad ones, smoothed by the overall share, is high. A literal segment that looks like a
wildcard is written with a backslash before it.

All sums are combined on the map side first; a host or template with a third of all URLs
is one row per task before a shuffle, and its rows are joined by a split or broadcast join.

Cases: a null URL, or one without ``://``, has an empty host and path; no rule fits and the
method allows it. Labels may be missing altogether: then no template is rejected. Repeated
rows get equal results. Extra columns are ignored. Every level is generalised, down to the
deepest path; each costs a round over the paths that reach it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.storage import staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path) in the order in which they were stated.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Levels that the SQL spells out; the method itself goes down to the deepest path.
DEPTH = 4


@dataclass(frozen=True)
class Purity:
    """When a segment is variable, branches are alike, and a template is bad."""

    rare_share: float = 0.02
    least_labelled: int = 3
    prior_weight: float = 2.0
    reject_at: float = 0.75


def url_host(url: Column) -> Column:
    rest = F.substring_index(url, "://", 1)
    after = F.substring(url, F.length(rest) + 4, F.length(url))
    whole = F.when(F.contains(url, F.lit("://")), after)
    return F.translate(F.regexp_extract(F.coalesce(whole, F.lit("")), r"^[^/?#]*", 0), UPPER, LOWER)


def url_path(url: Column) -> Column:
    rest = F.substring_index(url, "://", 1)
    after = F.substring(url, F.length(rest) + 4, F.length(url))
    whole = F.when(F.contains(url, F.lit("://")), after)
    return F.regexp_extract(F.coalesce(whole, F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as a string, and its verdict; null where none fits."""
    fits = lambda h, p: ((host == h) | host.endswith("." + h)) & path.startswith(p)
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        name = F.when(fits(h, p), F.lit(h + p)).otherwise(name)
        verdict = F.when(fits(h, p), F.lit(kind)).otherwise(verdict)
    return name, verdict


def shape(segment: Column) -> Column:
    """A segment, or the wildcard of its shape: numbers and long hexadecimal strings, a file's ending kept."""
    number = F.regexp_replace(segment, r"^[0-9]+(\.[A-Za-z0-9]{1,5})?$", "{n}$1")
    literal = F.when(segment.rlike(r"^[*{\\]"), F.concat(F.lit("\\"), segment)).otherwise(segment)
    return F.when(segment.rlike(r"^[0-9]+(\.[A-Za-z0-9]{1,5})?$"), number).when(segment.rlike(r"^[0-9A-Fa-f-]{12,}$"), F.lit("{x}")).otherwise(literal)


def shaped_path(path: Column) -> Column:
    return F.array_join(F.transform(F.split(path, "/", -1), shape), "/")


def _places(level: int) -> dict[str, Column]:
    """The tokens above a level as one string, the token there, and those below."""
    return {"prefix": F.array_join(F.slice("tokens", 1, level), "/"), "token": F.get("tokens", F.lit(level)), "rest": F.array_join(F.slice("tokens", level + 2, 1 << 20), "/")}


def _renamed(tree: DataFrame, level: int, decided: DataFrame) -> DataFrame:
    """``tree`` with the tokens of a level that ``decided`` (host, prefix, token, name) renames."""
    at = _places(level)
    keyed = tree.withColumns({k: at[k] for k in ("prefix", "token")}).join(decided, ["host", "prefix", "token"], "left")
    new = F.transform("tokens", lambda t, k: F.when((k == level) & F.col("name").isNotNull(), F.col("name")).otherwise(t))
    return keyed.withColumn("tokens", new).select(*tree.columns)


def _rare(tree: DataFrame, level: int, limits: Purity) -> DataFrame:
    """Literals of a level with a small share of their parent become ``*``; every path has that level."""
    branches = tree.withColumns(_places(level)).groupBy("host", "prefix", "token").agg(F.sum("n").alias("n"))
    parents = branches.groupBy("host", "prefix").agg(F.sum("n").alias("total"))
    rare = branches.join(parents, ["host", "prefix"]).where((F.col("n") < limits.rare_share * F.col("total")) & ~F.col("token").rlike(r"^([{*]|$)"))
    return _renamed(tree, level, rare.select("host", "prefix", "token", F.lit("*").alias("name")))


def _alike(tree: DataFrame, level: int) -> DataFrame:
    """Sibling branches of a level that are statistically alike become one; what is below them is generalised, and every path has that level."""
    by = ["host", "prefix", "main"]
    cells = tree.where(F.get("tokens", F.lit(level)).rlike(r"^[^{*]")).withColumns(_places(level)).groupBy("host", "prefix", "token", "rest").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    own = cells.groupBy("host", "prefix", "token").agg(F.sum("n").alias("own"), F.max_by("rest", F.struct("n", "rest")).alias("main"), F.sum("bad").alias("own_bad"), F.sum("good").alias("own_good"))
    cells = cells.join(own, ["host", "prefix", "token"])
    pool = cells.groupBy(*by, "rest").agg(F.sum("n").alias("pooled"), F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    pools = pool.groupBy(*by).agg(F.sum("pooled").alias("all"), F.count("*").alias("cells"), F.sum("bad").alias("all_bad"), F.sum("good").alias("all_good"))
    fitted = cells.join(pool.drop("bad", "good"), [*by, "rest"]).groupBy(*by, "token").agg(F.sum(F.col("n") * F.col("n") / (F.col("own") * F.col("pooled"))).alias("square"), F.max("own").alias("own"), F.max("own_bad").alias("own_bad"), F.max("own_good").alias("own_good"))
    # the sum over all cells of (observed - expected)^2 / expected, from the cells that were observed; the same over labels
    known, labels = F.col("own_bad") + F.col("own_good"), F.col("all_bad") + F.col("all_good")
    part = lambda seen, whole: F.when(F.col(whole) > 0, F.col(seen) * F.col(seen) * labels / (known * F.col(whole))).otherwise(0.0)
    by_label = F.when(known > 0, part("own_bad", "all_bad") + part("own_good", "all_good") - known).otherwise(0.0)
    chi = F.col("square") * F.col("all") - F.col("own") + by_label
    freedom = F.col("cells") - 1 + F.when((F.col("all_bad") > 0) & (F.col("all_good") > 0), 1).otherwise(0)
    alike = fitted.join(pools, by).withColumns({"chi": chi, "df": freedom}).where(F.col("chi") <= F.col("df") + 3 * F.sqrt(2 * F.col("df")) + 1e-9)
    several = alike.groupBy(*by).agg(F.count("*").alias("members")).where("members > 1")
    merged = alike.join(several, by).select("host", "prefix", "token", F.concat(F.lit("*"), F.substring(F.md5("main"), 1, 8)).alias("name"))
    return _renamed(tree, level, merged)


def templates(urls: DataFrame, limits: Purity | None = None, depth: int | None = None) -> DataFrame:
    """(host, shaped, template, labelled, purity, rejected) for ``urls(host, shaped, bad)``; bad is 1, 0 or null."""
    limits = limits or Purity()
    grown = urls.groupBy("host", "shaped").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("bad")), F.lit(0)).alias("bad"), F.coalesce(F.sum(1 - F.col("bad")), F.lit(0)).alias("good"))
    tree = staged(grown.withColumn("tokens", F.expr("slice(split(shaped, '/', -1), 2, 1000000)")), "paths")
    deepest = tree.agg(F.max(F.size("tokens"))).first()[0] or 0
    levels, ended = deepest if depth is None else min(depth, deepest), []
    for level in range(levels):  # down: paths that end above a level wait
        ended.append(tree.where(F.size("tokens") <= level))
        tree = staged(_rare(tree.where(F.size("tokens") > level), level, limits), "paths")
    for level in reversed(range(levels)):  # up: they come back when their level's turn is next
        tree = staged(_alike(tree, level), "paths").unionByName(ended.pop())
    tree = tree.withColumn("template", F.array_join("tokens", "/"))
    base = tree.agg((F.sum("bad") / F.greatest(F.lit(1), F.sum("bad") + F.sum("good"))).alias("base"))
    sums = tree.groupBy("host", "template").agg((F.sum("bad") + F.sum("good")).alias("labelled"), F.sum("bad").alias("bad")).join(F.broadcast(base))  # one row
    purity = (F.col("bad") + limits.prior_weight * F.coalesce("base", F.lit(0.0))) / (F.col("labelled") + limits.prior_weight)
    judged = sums.select("host", "template", "labelled", purity.alias("purity")).withColumn("rejected", (F.col("labelled") >= limits.least_labelled) & (F.col("purity") >= limits.reject_at))
    return tree.select("host", "shaped", "template").join(judged, ["host", "template"])


def url_filter(pages: DataFrame, rules=RULES, labels: DataFrame | None = None, limits: Purity | None = None, depth: int | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, template) of every page.

    Labels come from ``labels(page_id, bad)``, at most one row per page, and otherwise from
    the rules: a URL that a rule blocks is bad, one that a rule allows is good.
    """
    host, path = url_host(pages["url"]), url_path(pages["url"])
    rows = pages.select(pages["page_id"].alias("page_id"), host.alias("host"), path.alias("path"), shaped_path(path).alias("shaped"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": name, "ruled": verdict})
    by_rule = F.when(F.col("ruled") == "block", 1).when(F.col("ruled") == "allow", 0)
    if labels is not None:
        known = labels.select(labels["page_id"].alias("page_id"), labels["bad"].cast("int").alias("label")).dropDuplicates(["page_id"])
        seen = rows.join(known, "page_id", "left").withColumn("bad", F.coalesce("label", by_rule))
    else:
        seen = rows.withColumn("bad", by_rule)
    judged = staged(templates(seen.select("host", "shaped", "bad"), limits, depth), "templates")
    found = rows.join(judged.select("host", "shaped", "template", "rejected"), ["host", "shaped"], "left")
    method = F.when(F.coalesce("rejected", F.lit(False)), "block").otherwise("allow")
    return found.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "template")


def _oracle(depth: int = DEPTH, limits: Purity = Purity()) -> str:
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    order = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    cases = lambda value: " ".join(f"WHEN {fits(h, p)} THEN '{value(k, h, p)}'" for k, h, p in order)
    parts = [
        f"""u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
v AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT *, CASE {cases(lambda k, h, p: h + p)} END AS rule, CASE {cases(lambda k, h, p: k)} END AS ruled,
  array_to_string(list_transform(string_split(path, '/'), lambda s: CASE WHEN regexp_full_match(s, '[0-9]+(\\.[A-Za-z0-9]{{1,5}})?') THEN regexp_replace(s, '^[0-9]+', '{{n}}')
    WHEN regexp_full_match(s, '[0-9A-Fa-f-]{{12,}}') THEN '{{x}}' WHEN regexp_matches(s, '^[*{{\\\\]') THEN '\\' || s ELSE s END), '/') AS shaped FROM v),
t0 AS (SELECT host, shaped, count(*) AS n, count(*) FILTER (ruled = 'block') AS bad, count(*) FILTER (ruled = 'allow') AS good, string_split(shaped, '/')[2:] AS tokens FROM r GROUP BY host, shaped)"""
    ]
    keys = lambda k: f"array_to_string(tokens[1:{k}], '/') AS prefix, tokens[{k + 1}] AS token, array_to_string(tokens[{k + 2}:], '/') AS rest"
    swap = lambda k: f"list_concat(tokens[1:{k}], CASE WHEN len(tokens) > {k} THEN [coalesce(d.name, tokens[{k + 1}])] ELSE [] END, tokens[{k + 2}:])"
    join = lambda k: f"ON d.host = t.host AND d.prefix = array_to_string(t.tokens[1:{k}], '/') AND d.token = t.tokens[{k + 1}]"
    for k in range(depth):
        parts.append(
            f"""b{k} AS (SELECT host, prefix, token, sum(n) AS n FROM (SELECT *, {keys(k)} FROM t{k} WHERE len(tokens) > {k}) GROUP BY ALL),
d{k} AS (SELECT host, prefix, token, '*' AS name FROM (SELECT *, sum(n) OVER (PARTITION BY host, prefix) AS total FROM b{k}) WHERE n < {limits.rare_share} * total AND NOT regexp_matches(token, '^([{{*]|$)')),
t{k + 1} AS (SELECT t.host, shaped, n, bad, good, {swap(k)} AS tokens FROM t{k} t LEFT JOIN d{k} d {join(k)})"""
        )
    for k in reversed(range(depth)):
        tree = f"t{depth}" if k == depth - 1 else f"u{k + 1}"
        parts.append(
            f"""c{k} AS (SELECT host, prefix, token, rest, sum(n) AS n, sum(bad) AS bad, sum(good) AS good FROM (SELECT *, {keys(k)} FROM {tree} WHERE len(tokens) > {k} AND regexp_matches(tokens[{k + 1}], '^[^{{*]')) GROUP BY ALL),
k{k} AS (SELECT host, prefix, token, sum(n) AS own, first(rest ORDER BY n DESC, rest DESC) AS main, sum(bad) AS own_bad, sum(good) AS own_good FROM c{k} GROUP BY host, prefix, token),
p{k} AS (SELECT *, sum(n) OVER (PARTITION BY host, prefix, main, rest) AS pooled, sum(n) OVER w AS everything, sum(bad) OVER w AS all_bad, sum(good) OVER w AS all_good FROM c{k} JOIN k{k} USING (host, prefix, token) WINDOW w AS (PARTITION BY host, prefix, main)),
z{k} AS (SELECT host, prefix, main, count(DISTINCT rest) - 1 + CASE WHEN max(all_bad) > 0 AND max(all_good) > 0 THEN 1 ELSE 0 END AS df FROM p{k} GROUP BY ALL),
y{k} AS (SELECT host, prefix, main, token, sum(n::DOUBLE * n * everything / (own * pooled)) - max(own) AS chi, max(own_bad)::DOUBLE AS b, max(own_good)::DOUBLE AS g, max(all_bad) AS all_b, max(all_good) AS all_g FROM p{k} GROUP BY ALL),
a{k} AS (SELECT host, prefix, main, token, df, chi + CASE WHEN b + g > 0 THEN (CASE WHEN all_b > 0 THEN b * b * (all_b + all_g) / ((b + g) * all_b) ELSE 0 END) + (CASE WHEN all_g > 0 THEN g * g * (all_b + all_g) / ((b + g) * all_g) ELSE 0 END) - b - g ELSE 0 END AS chi FROM y{k} JOIN z{k} USING (host, prefix, main)),
m{k} AS (SELECT host, prefix, token, '*' || substr(md5(main), 1, 8) AS name, count(*) OVER (PARTITION BY host, prefix, main) AS members FROM a{k} WHERE chi <= df + 3 * sqrt(2 * df) + 1e-9),
u{k} AS (SELECT t.host, shaped, n, bad, good, {swap(k)} AS tokens FROM {tree} t LEFT JOIN (SELECT * FROM m{k} WHERE members > 1) d {join(k)})"""
        )
    parts.append(
        f"""f AS (SELECT host, shaped, bad, good, array_to_string(tokens, '/') AS template FROM u0),
j AS (SELECT host, template, sum(bad + good) AS labelled, (sum(bad) + {limits.prior_weight} * (SELECT sum(bad) / greatest(1, sum(bad + good)) FROM f)) / (sum(bad + good) + {limits.prior_weight}) AS purity FROM f GROUP BY ALL)"""
    )
    return (
        "WITH " + ",\n".join(parts) + f"\nSELECT page_id, r.host, path, rule, coalesce(ruled, CASE WHEN labelled >= {limits.least_labelled} AND purity >= {limits.reject_at} THEN 'block' ELSE 'allow' END) AS verdict, f.template\n"
        "FROM r JOIN f ON f.host = r.host AND f.shaped = r.shaped JOIN j ON j.host = f.host AND j.template = f.template"
    )


ORACLE = _oracle()
