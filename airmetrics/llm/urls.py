"""URL filter by a tree of path templates per host.

Paths are cut into segments. A segment with a digit is variable. So is any segment whose place in
the tree has many children with few URLs each; level by level such children become one wildcard.
The result is a template per URL, and URLs, labels and labelled-bad URLs are counted per host and
template. Templates of one host and one skeleton (all fixed segments left open) are branches that
may be one: those whose share of bad labels does not differ from the pooled share by a two-sided
test are merged. A branch is rejected when its purity, the share of bad labels smoothed towards
the overall share, reaches the limit. Explicit rules go before all that.

Only built-in functions; counts are reduced to distinct path shapes before any join, so a host
that holds a third of all URLs costs no more than the shapes it has. The small tables of the tree
are written to the shared folder level by level.

Defined results: a null URL, or one without ``://``, has an empty host and path and is judged with
all others of that kind. URLs without labels have the overall share. Repeated rows are counted as
often as they come. Rules tie by length, then by text. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from airmetrics.llm.common import stored

#: Segments below this depth are one wildcard on hosts that have no label there.
LEVELS = 4
#: A place is variable with at least so many children of on average fewer URLs each.
MANY_CHILDREN = 20
FEW_URLS = 20
#: Two-sided 5 % of the normal distribution.
SIMILAR_Z = 1.96
SMOOTHING = 10.0
REJECT = 0.5
MAX_RULES = 1000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """A host with all its subdomains, a start of the path, and the verdict."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    text = F.coalesce(url, F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*(/[^?#]*)?", 1)


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as ``struct<rule, verdict>``, else null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    found = None
    for rule in sorted(rules, key=lambda r: (-len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        value = F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        found = (F if found is None else found).when(fits, value)
    return found if found is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def shape(path: Column) -> Column:
    """All segments, those with a digit as ``*``."""
    every = F.split(path, "/")
    every = F.slice(every, 2, F.size(every))
    return F.array_join(F.transform(every, lambda s: F.when(s.rlike("[0-9]"), "*").otherwise(s)), "/")


def opened(shapes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Add the ``template`` to begin with: the shape, with ``**`` for what is deep on hosts without a label there."""
    segments = F.split("shape", "/")
    deep = F.size(segments) > levels
    reached = shapes.where(deep & (F.col("labelled") > 0)).select("host", F.lit(True).alias("reached")).distinct()
    cut = F.array_join(F.array_append(F.slice(segments, 1, levels), F.lit("**")), "/")
    template = F.when(deep & F.col("reached").isNull(), cut).otherwise(F.col("shape"))
    return shapes.join(reached, "host", "left").withColumn("template", template).drop("reached")


def depth(tree: DataFrame, many: int = MANY_CHILDREN) -> int:
    """The deepest level at which a place can have so many children: a host needs as many rows that reach it."""
    reach = tree.groupBy("host", F.size(F.split("template", "/")).alias("size")).agg(F.countDistinct("template").alias("n"))
    below = F.sum("n").over(Window.partitionBy("host").orderBy(F.desc("size")))
    return reach.withColumn("below", below).where(F.col("below") >= many).agg(F.max("size")).first()[0] or 0


def templates(shapes: DataFrame, levels: int = LEVELS, many: int = MANY_CHILDREN, few: int = FEW_URLS) -> DataFrame:
    """Add ``template`` to rows of ``host``, ``shape``, ``urls`` and ``labelled``."""
    tree = stored(opened(shapes, levels), "shapes")
    for level in range(depth(tree, many)):
        known = tree.withColumns(
            {
                "parent": F.array_join(F.slice(F.split("template", "/"), 1, level), "/") if level else F.lit(""),
                "child": F.get(F.split("template", "/"), F.lit(level)),
            }
        )
        children = known.where("child is not null and child not in ('*', '**')")
        children = children.groupBy("host", "parent", "child").agg(F.sum("urls").alias("urls"))
        places = children.groupBy("host", "parent").agg(F.count("*").alias("children"), F.sum("urls").alias("below"))
        variable = places.where((F.col("children") >= many) & (F.col("below") < few * F.col("children")))
        variable = variable.select("host", "parent", F.lit(True).alias("variable"))
        split = F.split("template", "/")
        wild = F.concat(F.slice(split, 1, level), F.array(F.lit("*")), F.slice(split, level + 2, F.size(split)))
        replaced = F.when(
            F.col("variable") & F.col("child").isNotNull() & (F.col("child") != "**"), F.array_join(wild, "/")
        ).otherwise(F.col("template"))
        tree = known.join(variable, ["host", "parent"], "left").withColumn("template", replaced)
        # Every level reads the one above it twice; stored, the plans do not multiply.
        tree = stored(tree.drop("parent", "child", "variable"), "templates")
    return tree


def branches(tree: DataFrame, smoothing: float = SMOOTHING, z: float = SIMILAR_Z, reject: float = REJECT) -> DataFrame:
    """Per host and template: counts, whether it is merged with its kin, purity and verdict."""
    own = tree.groupBy("host", "template").agg(
        *(F.sum(name).alias(name) for name in ("urls", "labelled", "bad"))
    )
    skeleton = F.regexp_replace("template", "[^/*]+", "?")
    own = stored(own.withColumn("skeleton", skeleton), "branches")
    sums = own.agg(F.coalesce(F.sum("bad"), F.lit(0)), F.coalesce(F.sum("labelled"), F.lit(0))).first()
    overall = (sums[0] + 1) / (sums[1] + 2)
    pooled = own.groupBy("host", "skeleton").agg(F.sum("labelled").alias("all_n"), F.sum("bad").alias("all_bad"))
    tested = own.join(pooled, ["host", "skeleton"])
    share = F.col("all_bad") / F.greatest("all_n", F.lit(1))
    off = F.abs(F.col("bad") - F.col("labelled") * share)
    similar = off <= z * F.sqrt(F.col("labelled") * share * (1 - share)) + 1e-9
    tested = stored(tested.withColumn("merged", similar), "tested")
    kin = tested.where("merged").groupBy("host", "skeleton").agg(
        F.sum("labelled").alias("kin_n"), F.sum("bad").alias("kin_bad")
    )
    joined = tested.join(kin, ["host", "skeleton"], "left")
    n = F.when(F.col("merged"), F.col("kin_n")).otherwise(F.col("labelled"))
    bad = F.when(F.col("merged"), F.col("kin_bad")).otherwise(F.col("bad"))
    purity = (bad + smoothing * F.lit(overall)) / (n + smoothing)
    return joined.withColumn("purity", purity).select(
        "host", "template", "skeleton", "urls", "labelled", "bad", "merged", "purity",
        F.when(F.col("purity") >= reject, "block").otherwise("allow").alias("verdict"),
    )


def judge(
    pages: DataFrame,
    labels: DataFrame,
    rules: Sequence[Rule] = (),
    url: str = "url",
    key: str = "page_id",
    levels: int = LEVELS,
    **options,
) -> DataFrame:
    """Verdict per row of ``pages``; ``labels`` has ``label_id`` and ``bad`` (0 or 1).

    A URL is labelled through the last number of its path, which is the id of its document.
    """
    host, path = parts(F.col(url))
    cut = pages.select(F.col(key), host.alias("host"), path.alias("path"))
    cut = cut.withColumns(
        {
            "shape": shape(F.col("path")),
            "label_id": F.expr("try_cast(regexp_extract(path, '([0-9]+)[^0-9]*$', 1) as bigint)"),
        }
    )
    known = labels.where("label_id is not null and bad is not null").groupBy("label_id").agg(F.max("bad").alias("bad"))
    counts = cut.where("label_id is not null").groupBy("host", "shape", "label_id").agg(F.count("*").alias("n"))
    labelled = counts.join(known, "label_id").groupBy("host", "shape")
    labelled = labelled.agg(F.sum("n").alias("labelled"), F.sum(F.col("n") * F.col("bad")).alias("bad"))
    shapes = cut.groupBy("host", "shape").agg(F.count("*").alias("urls"))
    shapes = shapes.join(labelled, ["host", "shape"], "left").fillna(0, ["labelled", "bad"])
    tree = templates(shapes, levels)
    found = branches(tree, **options).select("host", "template", "purity", F.col("verdict").alias("learned"))
    verdicts = tree.select("host", "shape", "template").join(found, ["host", "template"])
    judged = cut.join(verdicts, ["host", "shape"])
    rule = matching_rule(F.col("host"), F.col("path"), rules)
    return judged.withColumn("_rule", rule).select(
        key,
        "host",
        "path",
        F.col("_rule.rule").alias("rule"),
        F.coalesce("_rule.verdict", "learned").alias("verdict"),
        "template",
        "purity",
    )
