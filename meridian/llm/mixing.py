"""Mixing sources to target weights by hierarchical budgeting.

The token budget flows down a tree of domain, language and source by weight. A child that cannot spend its share
(its tokens times the epochs allowed) leaves the rest to its siblings by weight, and only what a whole family
cannot spend reaches the siblings of their parent. Every leaf then takes whole epochs and a token-prefix of one more
epoch in that epoch's seeded order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WS, free_name, sheltered, stage, table, unstage

LEVELS = ("domain", "lang", "source")
#: Hex digits of the order hash that name a part; only a leaf's boundary part is sorted.
PART_DIGITS = 3


def n_words(text: str) -> Column:
    """Words between ASCII white space, the token count where no tokenizer is asked for."""
    squeezed = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), WS, " "))
    return F.when(squeezed == "", 0).otherwise(F.length(squeezed) - F.length(F.replace(squeezed, F.lit(" "), F.lit(""))) + 1).cast("long")


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    """Hex digits that order an epoch; rows with null ids come last."""
    return F.coalesce(F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.when(doc_id.isNotNull(), doc_id.cast("string")))), F.lit("~"))


def share(nodes: DataFrame, parent: list[str], weight: Column) -> DataFrame:
    """nodes (parent columns, name, cap, given: the parent's tokens) with budget: the parent's tokens by weight, no node
    beyond its cap. Nodes fill up in the order of cap / weight; what the full ones leave goes to the rest by weight."""
    w = nodes.withColumn("w", weight.cast("double"))
    w = w.withColumn("w", F.when(F.col("w") > 0, F.col("w")).otherwise(0.0))
    w = w.withColumn("level", F.when(F.col("w") > 0, F.col("cap") / F.col("w")).otherwise(F.lit(float("inf"))))
    by = Window.partitionBy(*parent).orderBy("level", "name")
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    w = w.withColumns({"spent": F.coalesce(F.sum("cap").over(before), F.lit(0)), "weights": F.sum("w").over(after)})
    # full while the tokens left for each unit of weight reach beyond the node's level
    fair = (F.col("given") - F.col("spent")) / F.col("weights")
    w = w.withColumn("fair", F.when(F.col("weights") > 0, fair).otherwise(0.0)).withColumn("open", (F.col("level") > F.col("fair")).cast("int"))
    w = w.withColumn("level_at", F.min(F.when(F.col("open") == 1, F.struct("level", "name", "fair"))).over(Window.partitionBy(*parent)))
    budget = F.when((F.col("open") == 0) | F.col("level_at").isNull(), F.col("cap")).otherwise(F.floor(F.col("level_at.fair") * F.col("w")))
    return w.withColumn("budget", F.least("cap", budget.cast("long"))).drop("w", "level", "spent", "weights", "fair", "open", "level_at")


def budgets(leaves: DataFrame, total: Column, weights: dict[str, Column], epochs: int) -> DataFrame:
    """leaves (domain, lang, source, tokens) with budget, the tokens each may spend. A null name is a name of its own."""
    have = leaves.withColumn("cap", F.col("tokens") * epochs)
    given = have.agg(total.cast("long").alias("given"))  # one row
    for depth, level in enumerate(LEVELS):
        above, path = list(LEVELS[:depth]), list(LEVELS[: depth + 1])
        nodes = have.groupBy(*path).agg(F.sum("cap").alias("cap"))
        nodes = nodes.crossJoin(F.broadcast(given)) if not above else _null_safe(nodes, given, above)
        nodes = share(nodes.withColumn("name", F.col(level)), above or [F.lit(0)], weights[level]).select(*path, "budget")
        given = nodes.withColumnRenamed("budget", "given")
    return _null_safe(leaves, given.withColumnRenamed("given", "budget"), list(LEVELS))


def _null_safe(left: DataFrame, right: DataFrame, names: list[str]) -> DataFrame:
    other = right.select(*(F.col(n).alias(f"_{n}") for n in names), *[c for c in right.columns if c not in names])
    return left.join(other, reduce(lambda a, b: a & b, (F.col(n).eqNullSafe(F.col(f"_{n}")) for n in names))).drop(*(f"_{n}" for n in names))


def mix(docs: DataFrame, domain: Column, total: Column, weights: dict[str, Column], epochs: int = 4, seed: int = 42, tokens: Column | None = None) -> DataFrame:
    """docs with domain, tokens and epoch: a row for each time that a document is taken.

    total is an aggregate over the leaves' tokens (the budget); weights maps each level to an expression over its
    path's columns. A document whose tokens would pass its leaf's budget ends the prefix. Documents without words
    cost nothing and stay in order with the rest. Null lang or source is a name of its own; repeated rows count each;
    ties of the order go by id, then by row. An empty table gives no rows. Columns of docs that clash with the three
    added ones, whatever their case, are replaced; others pass through.
    """
    extra = ["domain", "tokens", "epoch"]
    names = [c for c in docs.columns if c.lower() not in extra]
    own, taken_by = free_name(docs, "row"), free_name(docs, "taken")
    rows = docs.select(*(F.col(f"`{c}`") for c in names), domain.alias("domain"), (n_words("text") if tokens is None else tokens).alias("tokens"))
    rows = stage(rows.withColumn(own, F.monotonically_increasing_id()), "rows")
    slim = rows.select("doc_id", *LEVELS, "tokens", F.col(own).alias("row"))
    plan = budgets(slim.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens")), total, weights, epochs)
    full = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(1).cast("int")
    left = F.when(F.col("tokens") > 0, F.col("budget") - full * F.col("tokens")).otherwise(0)
    plan = stage(plan.select(*(F.col(c).alias(f"_{c}") for c in LEVELS), full.alias("full"), left.alias("left")), "plan")
    same = reduce(lambda a, b: a & b, (F.col(n).eqNullSafe(F.col(f"_{n}")) for n in LEVELS))
    # the prefix of the last epoch: sums by part of the hash show in which part each leaf's prefix ends
    keyed = slim.join(plan, same).filter("left > 0").withColumn("key", order_key(seed, F.col("full"), F.col("doc_id")))
    keyed = keyed.select("row", "doc_id", *LEVELS, "tokens", "left", "full", "key", F.substring("key", 1, PART_DIGITS).alias("part"))
    parts = keyed.groupBy(*LEVELS, "part").agg(F.sum("tokens").alias("sum"), F.first("left").alias("left"))
    upto = F.sum("sum").over(Window.partitionBy(*LEVELS).orderBy("part"))
    parts = stage(parts.withColumn("upto", upto).select(*(F.col(c).alias(f"_{c}") for c in LEVELS), F.col("part").alias("_part"), (F.col("upto") - F.col("sum")).alias("before"), "upto"), "parts")
    placed = keyed.join(parts, same & (F.col("part") == F.col("_part")) & (F.col("before") <= F.col("left")))
    whole = placed.filter("upto <= left").select("row", "full")
    run = Window.partitionBy(*LEVELS, "part").orderBy("key", "doc_id", "row")
    edge = placed.filter("upto > left").withColumn("at", F.col("before") + F.sum("tokens").over(run)).filter("at <= left").select("row", "full")
    last = stage(whole.unionByName(edge).select("row", F.col("full").alias("epoch")), "last")
    taken = slim.join(plan, same).filter("full > 0").select("row", F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("epoch"))
    picked = taken.unionByName(last).groupBy(F.col("row").alias(own)).agg(F.collect_list("epoch").alias(taken_by))  # at most epochs + 1 each
    return rows.join(picked, own).withColumn("epoch", F.explode(taken_by)).select(*(F.col(f"`{c}`") for c in names), *extra)


#: The query's and the pipeline's tree: a source's number names its domain; weights as a corpus owner might set them.
WEIGHTS = {
    "domain": "CASE domain WHEN 'web' THEN 5 WHEN 'books' THEN 3 WHEN 'reference' THEN 2 ELSE 1 END",
    "lang": "CASE lang WHEN 'en' THEN 6 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 WHEN 'es' THEN 2 ELSE 1 END",
    "source": "1",
}
EPOCHS = 2


def weights() -> dict[str, Column]:
    return {k: F.expr(v) for k, v in WEIGHTS.items()}


def domain() -> Column:
    number = F.regexp_extract(F.col("source"), r"^src(\d+)$", 1).try_cast("int")
    return F.when(number.isNull(), "other").when(number % 3 == 0, "web").when(number % 3 == 1, "books").otherwise("reference")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine tenths of the corpus's tokens, at most two epochs of a source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", n_words("text").alias("n"))
    out = mix(docs, domain(), F.floor(F.sum("tokens") * 9 / 10), weights(), EPOCHS, tokens=F.col("n"))
    return out.select("doc_id", "domain", "lang", "source", "epoch", "tokens")


def _share_sql(name: str, above: str, path: str, level: str, weight: str) -> str:
    on = " AND ".join(f"n.{c} IS NOT DISTINCT FROM g.{c}" for c in above.split(", ")) if above else "TRUE"
    part = f"PARTITION BY {above}" if above else ""
    return f"""
{name}0 AS (SELECT n.*, g.given FROM (SELECT {path}, sum(cap)::BIGINT AS cap FROM leaf GROUP BY {path}) n JOIN given_{above.count(',') + 1 if above else 0} g ON {on}),
{name}1 AS (SELECT *, ({weight})::DOUBLE AS w, cap / ({weight})::DOUBLE AS lvl FROM {name}0),
{name}2 AS (SELECT *, coalesce(sum(cap) OVER ({part} ORDER BY lvl, {level} NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent,
  sum(w) OVER ({part} ORDER BY lvl, {level} NULLS FIRST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM {name}1),
{name}3 AS (SELECT *, (given - spent)::DOUBLE / ws AS fair FROM {name}2),
{name}4 AS (SELECT *, first_value(CASE WHEN lvl > fair THEN fair END IGNORE NULLS) OVER ({part} ORDER BY lvl, {level} NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS open_fair FROM {name}3),
given_{path.count(',') + 1} AS (SELECT {path}, least(cap, CASE WHEN lvl <= fair OR open_fair IS NULL THEN cap ELSE floor(open_fair * w)::BIGINT END)::BIGINT AS given FROM {name}4)"""


ORACLE = rf"""
WITH d AS (SELECT doc_id, lang, source, CASE WHEN s = '' THEN 0 ELSE length(s) - length(replace(s, ' ', '')) + 1 END::BIGINT AS tokens,
    CASE WHEN source IS NULL THEN 'other' WHEN CAST(substr(source, 4) AS INT) % 3 = 0 THEN 'web' WHEN CAST(substr(source, 4) AS INT) % 3 = 1 THEN 'books' ELSE 'reference' END AS domain
  FROM (SELECT *, trim(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS s FROM documents)),
leaf AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens, sum(tokens)::BIGINT * {EPOCHS} AS cap FROM d GROUP BY ALL),
given_0 AS (SELECT floor(sum(tokens) * 9 / 10)::BIGINT AS given FROM leaf),
{_share_sql("a", "", "domain", "domain", WEIGHTS["domain"])},
{_share_sql("b", "domain", "domain, lang", "lang", WEIGHTS["lang"])},
{_share_sql("c", "domain, lang", "domain, lang, source", "source", WEIGHTS["source"])},
plan AS (SELECT l.domain, l.lang, l.source, floor(g.given / l.tokens)::INT AS whole, g.given - floor(g.given / l.tokens)::BIGINT * l.tokens AS rest
  FROM leaf l JOIN given_3 g ON l.domain = g.domain AND l.lang IS NOT DISTINCT FROM g.lang AND l.source IS NOT DISTINCT FROM g.source),
r AS (SELECT d.*, whole, rest, md5('42|' || whole || '|' || doc_id) AS k FROM d JOIN plan p ON d.domain = p.domain AND d.lang IS NOT DISTINCT FROM p.lang AND d.source IS NOT DISTINCT FROM p.source),
x AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY k, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM r)
SELECT doc_id, domain, lang, source, epoch, tokens FROM (
  SELECT doc_id, domain, lang, source, unnest(generate_series(0, whole - 1))::INT AS epoch, tokens FROM x WHERE whole > 0
  UNION ALL SELECT doc_id, domain, lang, source, whole AS epoch, tokens FROM x WHERE rest > 0 AND upto <= rest)
"""


def keep_mixed(docs: DataFrame) -> DataFrame:
    """The pipeline's stage: the whole corpus's tokens as budget, so that a source short of its weight passes the rest on
    and no more than two epochs of any are taken; columns as in docs, whatever their names.

    Null lang or source is a name of its own, a null text has no tokens; repeated rows count each; no rows give none.
    """
    names = docs.columns
    rows, back = sheltered(docs, ["domain", "tokens", "epoch", "row"])
    out = mix(rows, domain(), F.sum("tokens"), weights(), EPOCHS)
    renamed = {old: new for new, old in back.items()}
    return out.select(*(F.col(renamed.get(c, c)).alias(c) for c in names))
