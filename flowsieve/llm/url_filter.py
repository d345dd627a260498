"""URL filters: rules, and templates of paths per host judged by their labelled pages.

Every host has a tree of path templates.  Level by level, the values of a
segment under one template become the wildcard ``*`` when they vary (many
distinct values for the pages there are); what is deeper than ``depth`` becomes
``**``.  Sibling templates whose share of bad labelled pages does not differ
from their parent's by more than chance (a z test) are merged and judged
together.  A template is rejected when its share of bad pages, smoothed by the
share of all labelled pages, exceeds ``reject_share``.  Rules come first: the
longest one that fits decides.

Everything is DataFrame operations: distinct counts and sums are aggregated
before they are shuffled, so a host with a third of all pages is a few rows per
task, and joins bring back one row per template.

Edge cases: a null url, or one without ``://``, has an empty host and an empty
path and is judged as a host of its own; an empty path fits no rule; pages
without labels, labels without pages and null labels count nowhere; repeated
rows all come out; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (host, path, verdict); fixed values of the contract.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block"))
DEPTH = 4
#: A segment varies from this many values on, if they are at least this share of its pages.
MIN_VALUES, VALUE_SHARE = 12, 0.2
#: Siblings within this many standard errors of their parent are merged.
MERGE_Z = 2.0
#: Weight of the overall share in pages, and the share of bad pages that rejects a template.
SMOOTH, REJECT_SHARE = 20.0, 0.5


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.regexp_replace(rest, "^[^/?#]*", ""), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def fitting_rule(rules=RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits ``host`` and ``path``; null if none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, say in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        text, verdict = F.when(fits, host + path).otherwise(text), F.when(fits, say).otherwise(verdict)
    return text, verdict


def templates(pages: DataFrame, depth: int = DEPTH, min_values: int = MIN_VALUES,
              value_share: float = VALUE_SHARE) -> DataFrame:
    """Adds ``parent`` and ``template`` to rows with ``host`` and ``path``."""
    rows = pages.withColumn("parts", F.filter(F.split("path", "/"), lambda x: x != "")) \
        .withColumn("parent", F.lit("")).withColumn("template", F.lit(""))
    for k in range(1, depth + 1):
        part = F.try_element_at(F.col("parts"), F.lit(k))
        nodes = (rows.withColumn("part", part).filter("part is not null").groupBy("host", "template")
                 .agg(F.count(F.lit(1)).alias("pages"), F.countDistinct("part").alias("found"))
                 .select(F.col("host").alias("at_host"), F.col("template").alias("at_template"),
                         ((F.col("found") >= min_values) & (F.col("found") >= value_share * F.col("pages"))).alias("varies")))
        name = F.when(F.col("varies"), "*").otherwise(part)
        rows = (rows.join(nodes, (F.col("host") == F.col("at_host")) & (F.col("template") == F.col("at_template")), "left")
                .withColumn("parent", F.when(part.isNotNull(), F.col("template")).otherwise(F.col("parent")))
                .withColumn("template", F.when(part.isNotNull(), F.concat("template", F.lit("/"), name))
                            .otherwise(F.col("template")))
                .drop("at_host", "at_template", "varies"))
    deeper = F.size("parts") > depth
    return (rows.withColumn("parent", F.when(deeper, F.col("template")).otherwise(F.col("parent")))
            .withColumn("template", F.when(deeper, F.concat("template", F.lit("/**"))).otherwise(F.col("template")))
            .drop("parts"))


def judged_templates(rows: DataFrame, merge_z: float = MERGE_Z, smooth: float = SMOOTH,
                     reject_share: float = REJECT_SHARE) -> DataFrame:
    """``host, parent, template, rejected``; ``rows`` has those columns and ``bad`` (0, 1 or null)."""
    leaves = rows.groupBy("host", "parent", "template").agg(
        F.count("bad").cast("double").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("b"))
    parents = leaves.groupBy("host", "parent").agg(F.sum("n").alias("pn"), F.sum("b").alias("pb"))
    seen = rows.agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("b")).first()
    prior = seen["b"] / seen["n"] if seen["n"] else 0.0
    rate = F.try_divide("pb", "pn")
    alike = (F.col("n") == 0) | (F.pow(F.try_divide("b", "n") - rate, 2)
                                 <= F.try_divide(merge_z * merge_z * rate * (1 - rate), F.col("n")) + 1e-12)
    tested = leaves.join(parents, ["host", "parent"]).withColumn("merged", F.coalesce(alike, F.lit(False)))
    pooled = tested.filter("merged").groupBy("host", "parent").agg(F.sum("n").alias("mn"), F.sum("b").alias("mb"))
    n, b = F.when(F.col("merged"), F.col("mn")).otherwise(F.col("n")), F.when(F.col("merged"), F.col("mb")).otherwise(F.col("b"))
    return (tested.join(pooled, ["host", "parent"], "left")
            .select("host", "parent", "template", ((b + smooth * prior) / (n + smooth) > reject_share).alias("rejected")))


def filter_urls(pages: DataFrame, labels: DataFrame, key: str = "page_id", url: str = "url", rules=RULES,
                depth: int = DEPTH, **limits) -> DataFrame:
    """``page_id, host, path, template, rule, verdict`` of every page.

    ``labels``: ``number`` and ``bad`` (0 or 1), for the pages whose path's last
    segment is that number (a file ending is ignored).
    """
    rows = pages.select(F.col(key).alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"))
    host, path = host_and_path(F.col("url"))
    rows = rows.select("page_id", host.alias("host"), path.alias("path"))
    number = F.expr("try_cast(nullif(regexp_extract(path, '/([0-9]{1,18})(\\\\.[a-z]+)?/?$', 1), '') as bigint)")
    known = labels.filter("number is not null").groupBy("number").agg(F.max("bad").alias("bad"))
    rows = templates(rows.withColumn("number", number).join(known, "number", "left").drop("number"), depth)
    verdicts = judged_templates(rows, **limits).select(
        F.col("host").alias("at_host"), F.col("parent").alias("at_parent"), F.col("template").alias("at_template"), "rejected")
    rule, say = fitting_rule(rules)
    return (rows.join(verdicts, (F.col("host") == F.col("at_host")) & (F.col("parent") == F.col("at_parent"))
                      & (F.col("template") == F.col("at_template")), "left")
            .select("page_id", "host", "path", "template", rule.alias("rule"),
                    F.coalesce(say, F.when(F.col("rejected"), "block").otherwise("allow")).alias("verdict")))


def oracle(depth: int = DEPTH, rules=RULES) -> str:
    """The registered query in DuckDB SQL."""
    text, verdict = "NULL", "NULL"
    for host, path, say in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"
        text, verdict = f"CASE WHEN {fits} THEN '{host + path}' ELSE {text} END", f"CASE WHEN {fits} THEN '{say}' ELSE {verdict} END"
    steps = []
    for k in range(1, depth + 1):
        steps.append(f"""n{k} AS (SELECT host, template, count(*) AS pages, count(DISTINCT parts[{k}]) AS found
            FROM t{k - 1} WHERE len(parts) >= {k} GROUP BY ALL),
        t{k} AS (SELECT t.page_id, t.host, t.path, t.bad, t.parts,
            CASE WHEN len(t.parts) >= {k} THEN t.template ELSE t.parent END AS parent,
            CASE WHEN len(t.parts) >= {k} THEN t.template || '/' || CASE WHEN found >= {MIN_VALUES}
                AND found >= {VALUE_SHARE} * pages THEN '*' ELSE t.parts[{k}] END ELSE t.template END AS template
            FROM t{k - 1} t LEFT JOIN n{k} n ON t.host = n.host AND t.template = n.template)""")
    return f"""WITH cut AS (
        SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
        FROM (SELECT page_id, coalesce(url, '') AS url FROM pages)),
    named AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
        regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') AS path FROM cut),
    known AS (SELECT doc_id AS number, max(1 - quality) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
    t0 AS (SELECT page_id, host, path, bad, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts, '' AS parent, '' AS template
        FROM named LEFT JOIN known
        ON number = try_cast(nullif(regexp_extract(path, '/([0-9]{{1,18}})(\\.[a-z]+)?/?$', 1), '') AS bigint)),
    {', '.join(steps)},
    leafed AS (SELECT page_id, host, path, bad, CASE WHEN len(parts) > {depth} THEN template ELSE parent END AS parent,
        CASE WHEN len(parts) > {depth} THEN template || '/**' ELSE template END AS template FROM t{depth}),
    leaves AS (SELECT host, parent, template, count(bad)::double AS n, coalesce(sum(bad), 0)::double AS b FROM leafed GROUP BY ALL),
    parents AS (SELECT host, parent, sum(n) AS pn, sum(b) AS pb FROM leaves GROUP BY ALL),
    tested AS (SELECT l.*, coalesce(l.n = 0 OR pow(b / nullif(n, 0) - pb / nullif(pn, 0), 2)
        <= {MERGE_Z * MERGE_Z} * (pb / nullif(pn, 0)) * (1 - pb / nullif(pn, 0)) / nullif(n, 0) + 1e-12, false) AS merged
        FROM leaves l JOIN parents p ON l.host = p.host AND l.parent = p.parent),
    pooled AS (SELECT host, parent, sum(n) AS mn, sum(b) AS mb FROM tested WHERE merged GROUP BY ALL),
    overall AS (SELECT CASE WHEN sum(n) > 0 THEN sum(b) / sum(n) ELSE 0 END AS prior FROM leaves),
    verdicts AS (SELECT t.host, t.parent, t.template,
        (CASE WHEN merged THEN mb ELSE b END + {SMOOTH} * prior) / (CASE WHEN merged THEN mn ELSE n END + {SMOOTH}) > {REJECT_SHARE} AS rejected
        FROM tested t LEFT JOIN pooled p ON t.host = p.host AND t.parent = p.parent, overall)
    SELECT r.page_id, r.host, r.path, r.template, {text.replace('host', 'r.host').replace('path', 'r.path')} AS rule,
        coalesce({verdict.replace('host', 'r.host').replace('path', 'r.path')}, CASE WHEN rejected THEN 'block' ELSE 'allow' END) AS verdict
    FROM leafed r LEFT JOIN verdicts v ON r.host = v.host AND r.parent = v.parent AND r.template = v.template"""
