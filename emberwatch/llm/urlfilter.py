"""URL filtering by a per-host tree of path templates.

Every path becomes a list of typed segments (digit runs and long hex names are placeholders). Level by level, the
children of a node are compared with their siblings: a child whose mix of blocked, allowed and unlabelled pages does
not differ significantly (Pearson's chi-square against the pooled siblings, which rare variable segments never
reach) merges into the node's wildcard branch; the others stay literal. The leaves are templates; one is rejected
when its labelled pages are blocked with a smoothed purity of `reject_at` or more. Labels are the pages that a rule
fits, and a page with a rule takes that rule's verdict.

The tree is built on counts per distinct (host, typed path), so a hot host or template is summed before any shuffle;
each level is two aggregations and two joins over those counts.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.llm.common import staged, table


class Rule(NamedTuple):
    action: str  # block or allow
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = [Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"),
         Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/")]

HOT = 10_000        # pages of one host and path shape from which on their rows are spread ...
SHARE = 1_000       # ... or one of so many parts of all pages, if that is more; so there are at most SHARE such shapes
DIFFERS = 5.991     # 95 % point of chi-square with two degrees of freedom
SMOOTHING = 2.0     # pseudo-pages at the overall blocked share
REJECT_AT = 0.7

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    host = F.coalesce(F.regexp_extract(url, _URL, 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits (host or a subdomain, path prefix) as struct(size, name, action), or null. Of
    equally long rules the later name wins."""
    known = F.array(*[F.struct(F.lit(len(r.name)).alias("size"), F.lit(r.name).alias("name"),
                               F.lit(r.action).alias("action"), F.lit(r.host).alias("host"),
                               F.lit(r.path).alias("path")) for r in rules])
    return F.array_max(F.filter(known, lambda r: (
        ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"]))))


def typed_segments(path: Column) -> Column:
    """Segments after the leading slash, typed."""
    return F.when(path == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.split(F.regexp_replace(path, "^/", ""), "/"), lambda s: F.when(
            s.rlike("^[0-9a-fA-F-]{8,}$") & s.rlike("[0-9]"), F.lit("{h}")
        ).otherwise(F.regexp_replace(s, "[0-9]+", "{n}"))))


def _sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in ("n", "blocked", "allowed")]


def _chi_square() -> Column:
    """Of the child's (blocked, allowed, unlabelled) counts against its siblings' together; 0 for an only child."""
    total, mine = F.col("all_n").cast("double"), F.col("n").cast("double")
    rest = total - mine

    def cell(x: Column, both: Column) -> Column:
        both = both.cast("double")
        e1, e2 = mine * both / total, rest * both / total
        return F.when(both > 0, (x - e1) * (x - e1) / e1 + (both - x - e2) * (both - x - e2) / e2).otherwise(F.lit(0.0))

    none, all_none = F.col("n") - F.col("blocked") - F.col("allowed"), F.col("all_n") - F.col("all_blocked") - F.col("all_allowed")
    return F.when(rest > 0, cell(F.col("blocked"), F.col("all_blocked")) + cell(F.col("allowed"), F.col("all_allowed"))
                  + cell(none, all_none)).otherwise(F.lit(0.0))


def template_tree(counts: DataFrame, differs: float = DIFFERS) -> DataFrame:
    """`counts`: host, segments, n, blocked, allowed. Adds `template`, the generalised path of each row.

    All levels of the table are walked, until no two rows of a host share a template that goes on; a row that is alone
    under its template has no siblings to be compared with, so the rest of its path stays as it is."""
    open_, done, d = counts.withColumn("template", F.lit("")), [], 0
    while True:
        open_ = staged(open_, f"url-tree-{d}")
        done.append(open_.where(F.size("segments") <= d))
        going = open_.where(F.size("segments") > d).withColumn("child", F.get("segments", F.lit(d)))
        if going.isEmpty():
            break
        kids = going.groupBy("host", "template", "child").agg(*_sums(), F.count(F.lit(1)).alias("rows"))
        pool = kids.groupBy("host", "template").agg(
            F.count(F.lit(1)).alias("kids"), F.sum("rows").alias("all_rows"), *[F.sum(c).alias(f"all_{c}") for c in ("n", "blocked", "allowed")])
        step = kids.join(pool, ["host", "template"]).select(
            "host", "template", "child", (F.col("all_rows") == 1).alias("_alone"),
            F.when((F.col("kids") == 1) | (_chi_square() >= differs), F.col("child")).otherwise(F.lit("*")).alias("_as"))
        rest = F.array_join(F.expr(f"slice(segments, {d + 1}, size(segments) - {d})"), "/")
        moved = staged(going.join(step, ["host", "template", "child"]).withColumn(
            "template", F.concat("template", F.lit("/"), F.when(F.col("_alone"), rest).otherwise(F.col("_as")))).drop("child", "_as"), "url-moved")
        done.append(moved.where("_alone").drop("_alone"))
        open_, d = moved.where("NOT _alone").drop("_alone"), d + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def judge_urls(pages: DataFrame, rules: list[Rule] = RULES, differs: float = DIFFERS,
               smoothing: float = SMOOTHING, reject_at: float = REJECT_AT) -> DataFrame:
    """Judge every page's url.

    Returns page_id, host, path, rule, verdict, template, purity (of the template). A null url, or one without
    '://', has an empty host and path, fits no rule and shares the template ''. Repeated rows are judged alike; an
    empty table gives no rows; other columns are ignored. With no labelled page at all, every purity is 0.5."""
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("_rule", fitting_rule(F.col("host"), F.col("path"), rules)).select(
        "page_id", "host", "path", F.col("_rule")["name"].alias("rule"), F.col("_rule")["action"].alias("_action"),
        typed_segments(F.col("path")).alias("segments"))
    counts = rows.groupBy("host", "segments").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("_action") == "block", 1)).alias("blocked"),
        F.count(F.when(F.col("_action") == "allow", 1)).alias("allowed"))
    tree = template_tree(counts, differs)
    overall, total = tree.agg((F.sum("blocked") + 1.0) / (F.sum("blocked") + F.sum("allowed") + 2.0), F.sum("n")).first()
    prior = F.lit(0.5 if overall is None else overall)
    labelled = F.col("blocked") + F.col("allowed")
    purity = tree.groupBy("host", "template").agg(*_sums()).select(
        "host", "template", ((F.col("blocked") + prior * smoothing) / (labelled + smoothing)).alias("purity"),
        (labelled > 0).alias("_seen"))
    leaf = tree.select("host", "segments", "n", "template").join(purity, ["host", "template"])
    # pages of a very common shape go to several tasks: its judgement is copied, and each page picks a copy
    limit = max(HOT, (total or 0) // SHARE)
    parts = F.ceil(F.col("n") / limit).cast("int")
    hot = leaf.where(F.col("n") > limit).select("host", "segments", parts.alias("_parts"))  # at most SHARE rows
    spread = rows.join(F.broadcast(hot), ["host", "segments"], "left").withColumn(
        "_part", F.pmod(F.xxhash64("page_id", "path"), F.coalesce("_parts", F.lit(1)).cast("long")).cast("int"))
    copies = leaf.withColumn("_part", F.explode(F.sequence(F.lit(0), F.when(F.col("n") > limit, parts).otherwise(1) - 1)))
    return spread.join(copies, ["host", "segments", "_part"]).select(
        "page_id", "host", "path", "rule",
        F.when(F.col("_action").isNotNull(), F.col("_action"))
        .when(F.col("_seen") & (F.col("purity") >= reject_at), F.lit("block")).otherwise(F.lit("allow")).alias("verdict"),
        "template", "purity")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


TWIN_LEVELS = 8     # SQL has no loop: the twin walks so many levels, more than the given tables have


def _oracle() -> str:
    rules = ", ".join(f"({len(r.name)}, '{r.name}', '{r.action}', '{r.host}', '{r.path}')" for r in RULES)
    sql = f"""
WITH rules(size, name, action, rhost, rpath) AS (VALUES {rules}),
u AS (SELECT row_number() OVER () AS k, page_id, url FROM pages),
parts AS (SELECT k, page_id,
  translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM u),
fit AS (SELECT k, arg_max(name, (size, name)) AS rule, arg_max(action, (size, name)) AS action FROM parts, rules
  WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY k),
seg AS (SELECT p.*, f.rule, f.action, CASE WHEN path = '' THEN CAST([] AS VARCHAR[]) ELSE
  list_transform(string_split(regexp_replace(path, '^/', ''), '/'), lambda s: CASE
    WHEN regexp_matches(s, '^[0-9a-fA-F-]{{8,}}$') AND regexp_matches(s, '[0-9]') THEN '{{h}}'
    ELSE regexp_replace(s, '[0-9]+', '{{n}}', 'g') END) END AS s0
  FROM parts p LEFT JOIN fit f USING (k)),
rows_ AS (SELECT *, s0 AS segments FROM seg),
t0 AS (SELECT host, segments, count(*) AS n, count(*) FILTER (action = 'block') AS blocked,
  count(*) FILTER (action = 'allow') AS allowed, '' AS template FROM rows_ GROUP BY host, segments)"""
    for d in range(TWIN_LEVELS):
        cells = " + ".join(
            f"(CASE WHEN {both} > 0 THEN ({x} - n * {both} / all_n) * ({x} - n * {both} / all_n) / (n * {both} / all_n)"
            f" + ({both} - {x} - (all_n - n) * {both} / all_n) * ({both} - {x} - (all_n - n) * {both} / all_n)"
            f" / ((all_n - n) * {both} / all_n) ELSE 0 END)"
            for x, both in (("blocked", "all_blocked"), ("allowed", "all_allowed"),
                            ("(n - blocked - allowed)", "(all_n - all_blocked - all_allowed)")))
        sql += f""",
k{d} AS (SELECT host, template, segments[{d + 1}] AS child, sum(n)::DOUBLE AS n, sum(blocked)::DOUBLE AS blocked,
  sum(allowed)::DOUBLE AS allowed FROM t{d} WHERE len(segments) > {d} GROUP BY ALL),
p{d} AS (SELECT host, template, count(*) AS kids, sum(n) AS all_n, sum(blocked) AS all_blocked, sum(allowed) AS all_allowed
  FROM k{d} GROUP BY host, template),
a{d} AS (SELECT host, template, child, CASE WHEN kids = 1 OR (CASE WHEN all_n > n THEN {cells} ELSE 0 END) >= {DIFFERS}
  THEN child ELSE '*' END AS gen FROM k{d} JOIN p{d} USING (host, template)),
t{d + 1} AS (SELECT t.host, t.segments, t.n, t.blocked, t.allowed, CASE WHEN len(t.segments) > {d}
  THEN t.template || '/' || a.gen ELSE t.template END AS template FROM t{d} t
  LEFT JOIN a{d} a ON a.host = t.host AND a.template = t.template AND a.child = t.segments[{d + 1}])"""
    return sql + f""",
prior AS (SELECT coalesce((sum(blocked) + 1.0::DOUBLE) / (sum(blocked) + sum(allowed) + 2.0::DOUBLE), 0.5) AS p FROM t{TWIN_LEVELS}),
pure AS (SELECT host, template, (sum(blocked)::DOUBLE + any_value(p) * {SMOOTHING}::DOUBLE)
    / (sum(blocked)::DOUBLE + sum(allowed)::DOUBLE + {SMOOTHING}::DOUBLE) AS purity,
  sum(blocked) + sum(allowed) > 0 AS seen FROM t{TWIN_LEVELS}, prior GROUP BY host, template)
SELECT r.page_id, r.host, r.path, r.rule,
  CASE WHEN r.action IS NOT NULL THEN r.action WHEN p.seen AND p.purity >= {REJECT_AT} THEN 'block' ELSE 'allow' END AS verdict,
  t.template, p.purity
FROM rows_ r JOIN t{TWIN_LEVELS} t ON t.host = r.host AND t.segments = r.segments
JOIN pure p ON p.host = t.host AND p.template = t.template
"""


ORACLE = _oracle()
