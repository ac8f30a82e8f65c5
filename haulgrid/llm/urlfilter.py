"""URL filter: explicit rules, and per host a tree of path templates judged by smoothed labelled purity.

A path is all of its segments. Numbers and long hexadecimal segments become typed
wildcards; where a node has very many children, rare ones become ``*``. From the leaves up, branches whose share of bad labels
is no further from their siblings' than chance allows are merged. A template is rejected if its share of bad labels,
smoothed by the share of all pages, reaches a half.

All of it is grouped counts: pages are first reduced to templates of their host, on the map side, so a host with a third of
all pages is a few rows; verdicts return to the pages by a join with the templates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulgrid.llm.scratch import Scratch, small

#: Action, host and path of the explicit rules.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Children of a node from which rare ones are generalised; deviations that chance allows; labels that the prior weighs as
#: much as; purity at which a template is rejected.
CHILDREN, DEVIATIONS, PRIOR, REJECT = 32, 1.96, 10.0, 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The action and text of the longest rule that fits, as a struct; null without one."""
    out = F.lit(None).cast("struct<action:string,rule:string>")
    for action, name, start in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(action).alias("action"), F.lit(name + start).alias("rule"))).otherwise(out)
    return out


def _typed(segment: Column) -> Column:
    return (
        F.when(segment.rlike(r"^[0-9]+\z"), F.lit("<n>"))
        .when(segment.rlike(r"^[0-9]+[.][a-z]+\z"), F.regexp_replace(segment, r"^[0-9]+", "<n>"))
        .when(segment.rlike(r"^[0-9a-f]{8,}\z"), F.lit("<h>"))
        .otherwise(segment)
    )


def templates(pages: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """The tree's leaves: host, segments s, their template t (both arrays), and counts; and the depth of the tree.

    ``pages`` has host, s and bad (1, 0 or null without a label). From the root down, a leaf stays open until its path ends
    or it is alone below its node, where nothing is left to generalise; the depth is that of the last open node.
    """
    leaves = pages.groupBy("host", "s").agg(F.count("*").alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad"))
    leaves = scratch.table(leaves.withColumn("t", F.array().cast("array<string>")), "leaves-0")
    n, schema, level, done = leaves.count(), leaves.schema, 0, []
    rows = n
    while rows:
        level += 1
        child = F.coalesce(F.get("s", F.lit(level - 1)), F.lit("")).alias("child")
        leaves = leaves.withColumn("child", child)
        sizes = leaves.groupBy("host", "t", "child").agg(F.sum("n").alias("own"), F.count("*").alias("below"))
        totals = sizes.groupBy("host", "t").agg(F.count_if(F.col("child") != "").alias("kids"), F.sum("own").alias("total"))
        rare = (F.col("kids") > CHILDREN) & (F.col("own") * CHILDREN < F.col("total")) & (F.col("child") != "")
        named = sizes.join(totals, ["host", "t"]).select("host", "t", "child", "below", F.when(rare, F.lit("*")).otherwise(F.col("child")).alias("name"))
        # Rare children become one node, so its leaves are together even where each child has one.
        together = named.groupBy("host", "t", "name").agg(F.sum("below").alias("leaves"))
        named = named.drop("below").join(together, ["host", "t", "name"])
        ends = F.col("child") == ""
        alone = F.col("leaves") == 1
        t = F.when(ends, F.col("t")).otherwise(F.concat("t", F.array("name")))
        rest = F.slice("s", F.lit(level + 1), F.greatest(F.size("s") - level, F.lit(0)))
        found = leaves.join(named, ["host", "t", "child"]).select("host", "s", "n", "labelled", "bad", F.when(~ends & alone, F.concat(t, rest)).otherwise(t).alias("t"), (ends | alone).alias("done"))
        found = scratch.table(found, f"leaves-{level}", rows=rows)
        done.append(f"{scratch.path}/leaves-{level}")
        leaves = scratch.spark.read.schema(found.schema).parquet(done[-1]).where("not done").drop("done")
        rows = leaves.count()
    if not done:
        return scratch.spark.createDataFrame([], schema), 0
    return scratch.spark.read.schema(found.schema).parquet(*done).where("done").select(*schema.names), level


def purities(leaves: DataFrame, depth: int, scratch: Scratch) -> DataFrame:
    """host, t, and the labelled and bad of the branch that each template ends up in.

    From the deepest level up, the branches of a node that are still open are compared with all of them together: one
    without labels, or within the deviations that its number of labels allows, is merged with the others of that kind and
    stays open for the next level; any other is judged by itself. A path that ends at a node is a branch of it.
    """
    rows = leaves.groupBy("host", "t").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")).withColumn("open", F.lit(True))
    n = leaves.count()
    rows = scratch.table(rows, "branches-0", rows=n)
    for level in range(depth, 0, -1):
        # A template that ends above this level's nodes waits for its own level.
        rows = rows.withColumns({"now": F.col("open") & (F.size("t") >= level - 1), "branch": F.slice("t", 1, level), "parent": F.slice("t", 1, max(level - 1, 0)) if level > 1 else F.array().cast("array<string>")})
        groups = rows.where("now").groupBy("host", "branch", "parent").agg(F.max("labelled").alias("l"), F.max("bad").alias("b"))
        pooled = groups.groupBy("host", "parent").agg(F.sum("l").alias("all_l"), F.sum("b").alias("all_b"))
        share = (F.col("all_b") + 1) / (F.col("all_l") + 2)
        near = F.abs(F.col("b") / F.greatest("l", F.lit(1)) - share) <= DEVIATIONS * F.sqrt(share * (1 - share) / F.greatest("l", F.lit(1)))
        groups = groups.join(pooled, ["host", "parent"]).select("host", "branch", "parent", "l", "b", ((F.col("l") == 0) | near).alias("like"))
        merged = groups.where("like").groupBy("host", "parent").agg(F.sum("l").alias("m_l"), F.sum("b").alias("m_b"))
        rows = rows.join(groups.select("host", "branch", "like"), ["host", "branch"], "left").join(merged, ["host", "parent"], "left")
        like = F.coalesce("like", F.lit(False))
        joins = F.col("now") & like
        now = rows.select("host", "t", F.when(joins, F.col("m_l")).otherwise(F.col("labelled")).alias("labelled"), F.when(joins, F.col("m_b")).otherwise(F.col("bad")).alias("bad"), (F.col("open") & (like | ~F.col("now"))).alias("open"))
        rows = scratch.table(now, f"branches-{level}", rows=n)
    return rows


def judge(pages: DataFrame, labelled: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and template of every page.

    ``labelled`` has page_id and bad (1 or 0; null is no label), at most one row a page. A null url, or one without ``://``,
    has an empty host and path, and is judged with others of that kind. Repeated pages are each returned; an empty table
    gives no rows; other columns are ignored. Without labels all that no rule blocks is allowed.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    url = F.col("url").cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    segments = F.transform(F.filter(F.split("path", "/"), lambda x: x != ""), _typed)
    rows = rows.withColumn("s", segments)
    rows = scratch.table(rows.join(labelled.select("page_id", F.col("bad").cast("int").alias("bad")), "page_id", "left"), "pages")
    leaves, depth = templates(rows, scratch)
    prior = rows.agg(F.coalesce(F.try_divide(F.sum("bad"), F.count("bad")), F.lit(0.0))).first()[0]
    smoothed = (F.col("bad") + PRIOR * F.lit(prior)) / (F.col("labelled") + PRIOR)
    found = purities(leaves, depth, scratch).select("host", "t", F.when(smoothed >= REJECT, "block").otherwise("allow").alias("by_template"))
    of = leaves.join(found, ["host", "t"]).select("host", "s", F.concat_ws("/", "t").alias("template"), "by_template")
    of = scratch.table(of, "verdicts", rows=leaves.count())
    size = of.agg(F.count("*"), F.sum(64 + F.octet_length("host") + F.octet_length("template") + F.octet_length(F.concat_ws("/", "s")))).first()
    judged = rows.join(small(of, size[0], (size[1] or 0) / max(1, size[0])), ["host", "s"], "left").withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("_rule")["action"], "by_template", F.lit("allow"))
    return judged.select("page_id", "host", "path", F.col("_rule")["rule"].alias("rule"), verdict.alias("verdict"), "template")


def page_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id and bad of pages whose path ends in a document's id (an extension may follow): bad is quality 0."""
    doc = F.try_to_number(F.regexp_extract(path_of(F.col("url").cast("string")), r"/([0-9]{1,18})(?:[.][a-z]+)?/?\z", 1), F.lit("999999999999999999")).cast("long")
    known = labels.where("quality is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 0).cast("int")).alias("bad"))
    found = pages.select("page_id", doc.alias("doc_id")).where("doc_id is not null").join(known, "doc_id")
    return found.groupBy("page_id").agg(F.max("bad").alias("bad"))
