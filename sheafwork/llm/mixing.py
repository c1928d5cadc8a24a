"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations only.

A token budget flows down a tree of domain, language and source. At each node it is poured over the children in
proportion to their weights; a child that cannot hold its share (its documents times ``max_epochs``) is filled, and
what it lacks goes to its siblings. A node gets no more than its subtree holds, so only what no sibling can take
reaches the node's own siblings. A leaf's tokens come from whole epochs and the prefix of one more, in the order of a
seeded hash for each epoch. All quantities are whole numbers, so results don't depend on the order of sums.

The hash order of a leaf is cut into 4096 ranges, whose sums say where the cut falls; only the range with the cut is
sorted. So no task gathers a leaf, and documents get their decision from one row a leaf, without a shuffle of texts.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, documents, hot_safe_lookup, words

LEAF = ("_domain", "_lang", "_source")
#: Sources end in a number; it says the domain. Weights of what isn't listed are 1.
DOMAINS = ("web", "books", "news", "forum")
WEIGHTS = {"domain": {"web": 4, "books": 3, "news": 2}, "lang": {"en": 5, "de": 2, "fr": 2}, "source": {"src0": 2}}


def domain_of(source: Column) -> Column:
    """The domain of a source by the number at its end; a source without one, or none, is of domain other."""
    number = F.regexp_extract(source, "([0-9]{1,9})$", 1).try_cast("int")
    names = F.array(*(F.lit(d) for d in DOMAINS))
    return F.coalesce(F.element_at(names, number % len(DOMAINS) + 1), F.lit("other"))


def weight_of(level: str, name: Column, weights: Mapping[str, Mapping[str, int]]) -> Column:
    out = F.lit(1)
    for k, w in weights.get(level, {}).items():
        out = F.when(name == k, F.lit(w)).otherwise(out)
    return out.cast("long")


def pour(rows: DataFrame, parents: list[str], child: str, weight: str, room: str, budget: str, out: str) -> DataFrame:
    """Adds ``out``: the part of the parent's budget that each child gets, by weight, none above its room."""
    by = Window.partitionBy(*parents)
    order = by.orderBy(F.col(room) / F.col(weight), child)
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumns({"_b": F.coalesce(F.sum(room).over(before), F.lit(0)), "_w": F.sum(weight).over(after)})
    rows = rows.withColumn("_full", F.col(room) * F.col("_w") <= (F.col(budget) - F.col("_b")) * F.col(weight))
    rows = rows.withColumns({"_rest": F.col(budget) - F.sum(F.when(F.col("_full"), F.col(room)).otherwise(0)).over(by), "_open": F.sum(F.when(F.col("_full"), 0).otherwise(F.col(weight))).over(by)})
    rows = rows.withColumn("_to", F.sum(F.when(F.col("_full"), 0).otherwise(F.col(weight))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    share = F.expr("(_rest * _to) div _open - (_rest * (_to - " + weight + ")) div _open")
    return rows.withColumn(out, F.when(F.col("_full"), F.col(room)).otherwise(share)).drop("_b", "_w", "_full", "_rest", "_open", "_to")


def leaf_budgets(leaves: DataFrame, budget: Column, max_epochs: int, weights: Mapping[str, Mapping[str, int]]) -> DataFrame:
    """leaves (LEAF, tokens) with target: the tokens that each leaf gives. The window sorts are over leaves, not documents."""
    level = leaves.withColumn("_room", F.col("tokens") * max_epochs)
    for depth, name in enumerate(("domain", "lang", "source")):
        level = level.withColumn(f"_w{depth}", weight_of(name, F.col(LEAF[depth]), weights))
    whole = level.agg(F.sum("tokens").alias("_all")).select(budget.cast("long").alias("_t"))
    domains = level.groupBy("_domain", "_w0").agg(F.sum("_room").alias("_room")).crossJoin(F.broadcast(whole))  # one row
    domains = pour(domains.withColumn("_one", F.lit(1)), ["_one"], "_domain", "_w0", "_room", "_t", "_t0")
    langs = level.groupBy("_domain", "_lang", "_w1").agg(F.sum("_room").alias("_room")).join(domains.select("_domain", "_t0"), "_domain")
    langs = pour(langs, ["_domain"], "_lang", "_w1", "_room", "_t0", "_t1")
    out = level.join(langs.select("_domain", "_lang", "_t1"), ["_domain", "_lang"])
    return pour(out, ["_domain", "_lang"], "_source", "_w2", "_room", "_t1", "target").select(*LEAF, "tokens", "_docs", "target")


def order_key(seed: int, epoch: Column, id_: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(id_.cast("string"), F.lit(""))))


def leaf_columns(lang: Column, source: Column) -> dict[str, Column]:
    return {"_domain": domain_of(source), "_lang": F.coalesce(lang.cast("string"), F.lit("")), "_source": F.coalesce(source.cast("string"), F.lit(""))}


def mix_plan(docs: DataFrame, budget: Column, max_epochs: int, seed: int, weights: Mapping[str, Mapping[str, int]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a leaf: target, whole epochs, and the last hash that the epoch after them takes (null: none)."""
    slim = docs.select(F.col(id_col).alias("_id"), *(c.alias(k) for k, c in leaf_columns(F.col("lang"), F.col("source")).items()), words(F.col(text_col)).alias("_n"))
    slim = cut(slim)
    leaves = slim.groupBy(*LEAF).agg(F.sum("_n").alias("tokens"), F.count(F.lit(1)).alias("_docs"))
    plan = leaf_budgets(leaves, budget, max_epochs, weights)
    plan = plan.withColumn("epochs", F.when(F.col("tokens") > 0, F.expr("target div tokens")).otherwise(0).cast("int"))
    plan = cut(plan.withColumn("rest", F.col("target") - F.col("epochs") * F.col("tokens")))
    keyed = hot_safe_lookup(slim, plan.select(*LEAF, "_docs", "epochs", "rest"), list(LEAF), "_docs", F.col("_id")).withColumn("_key", order_key(seed, F.col("epochs"), F.col("_id")))
    keyed = keyed.withColumn("_range", F.substring("_key", 1, 3))
    # Written before the window: else one exchange by leaf would serve both, with a hot leaf's partial sums in one task.
    sums = cut(keyed.groupBy(*LEAF, "_range", "rest").agg(F.sum("_n").alias("_s"), F.max("_key").alias("_last")))
    along = Window.partitionBy(*LEAF).orderBy("_range")  # 4096 rows a leaf at most
    sums = cut(sums.withColumn("_upto", F.sum("_s").over(along)))
    whole = sums.filter("_upto <= rest").groupBy(*LEAF).agg(F.max("_last").alias("_cut0"))
    split = sums.filter("_upto > rest AND _upto - _s <= rest").select(*LEAF, "_range", (F.col("rest") - F.col("_upto") + F.col("_s")).alias("_left"))
    inside = Window.partitionBy(*LEAF).orderBy("_key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    part = keyed.join(split, [*LEAF, "_range"]).withColumn("_sum", F.sum("_n").over(inside)).filter("_sum <= _left").groupBy(*LEAF).agg(F.max("_key").alias("_cut1"))
    out = plan.join(whole, list(LEAF), "left").join(part, list(LEAF), "left")
    return cut(out.select(*LEAF, "tokens", "_docs", "target", "epochs", F.greatest("_cut0", "_cut1").alias("_cut")))


def mix_select(docs: DataFrame, plan: DataFrame, seed: int, id_col: str = "doc_id") -> DataFrame:
    """document (a struct of the row), epoch (from 0) and the leaf: a row for each epoch in which the plan takes the document."""
    rows = docs.select(F.struct("*").alias("document"), F.col(id_col).alias("_id"), *(c.alias(k) for k, c in leaf_columns(F.col("lang"), F.col("source")).items()))
    rows = hot_safe_lookup(rows, plan.select(*LEAF, "_docs", "epochs", "_cut"), list(LEAF), "_docs", F.col("_id"))
    last = F.coalesce(order_key(seed, F.col("epochs"), F.col("_id")) <= F.col("_cut"), F.lit(False))
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs")))).filter((F.col("epoch") < F.col("epochs")) | last)
    return rows.select("document", "epoch", F.col("_domain").alias("domain"), F.col("_lang").alias("leaf_lang"), F.col("_source").alias("leaf_source"))


def mix_sources(docs: DataFrame, share: tuple[int, int] = (6, 10), max_epochs: int = 2, seed: int = 7, weights: Mapping[str, Mapping[str, int]] = WEIGHTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """document, epoch, domain, leaf_lang, leaf_source for a budget of share[0] / share[1] of all tokens (words).

    ``document`` holds the whole row, whatever the names of its columns. A null text has no words; null languages and
    sources are the leaf named ''. Documents without words cost nothing: they go with the prefix that their hash falls
    in. Rows with equal ids have equal hashes and are taken together. An empty table gives no rows.
    """
    budget = F.expr(f"coalesce(_all * {share[0]} div {share[1]}, 0)")
    return mix_select(docs, mix_plan(docs, budget, max_epochs, seed, weights, id_col, text_col), seed, id_col)


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_sources(documents(spark, sf_dir).select("doc_id", "text", "lang", "source"))
    return out.select("document.doc_id", "epoch", "domain", "leaf_lang", "leaf_source", words(F.col("document.text")).alias("n_tokens"))


def _case(level: str, name: str) -> str:
    listed = "".join(f" WHEN '{k}' THEN {w}" for k, w in WEIGHTS[level].items())
    return f"CAST(CASE {name}{listed} ELSE 1 END AS HUGEINT)"


def _pour_sql(name: str, rows: str, parents: str, child: str, w: str, budget: str) -> str:
    return f"""
{name}a AS (SELECT *, coalesce(sum(room) OVER (PARTITION BY {parents} ORDER BY room::DOUBLE / {w}::DOUBLE, {child} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b,
    sum({w}) OVER (PARTITION BY {parents} ORDER BY room::DOUBLE / {w}::DOUBLE, {child} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS aft FROM ({rows})),
{name}b AS (SELECT *, room * aft <= ({budget} - b) * {w} AS isfull FROM {name}a),
{name}c AS (SELECT *, {budget} - sum(CASE WHEN isfull THEN room ELSE 0 END) OVER (PARTITION BY {parents}) AS rest,
    sum(CASE WHEN isfull THEN 0 ELSE {w} END) OVER (PARTITION BY {parents}) AS opn,
    sum(CASE WHEN isfull THEN 0 ELSE {w} END) OVER (PARTITION BY {parents} ORDER BY room::DOUBLE / {w}::DOUBLE, {child} ROWS UNBOUNDED PRECEDING) AS upto FROM {name}b),
{name} AS (SELECT * EXCLUDE (b, aft, isfull, rest, opn, upto), CASE WHEN isfull THEN room ELSE (rest * upto) // opn - (rest * (upto - {w})) // opn END AS t_{name} FROM {name}c)"""


def mixing_sql(docs: str, share: tuple[int, int], max_epochs: int, seed: int) -> str:
    """CTEs that end in ``mixed``: the rows of the relation ``docs`` with epoch, domain, leaf_lang, leaf_source, n_tokens."""
    domain = "coalesce(['" + "', '".join(DOMAINS) + f"'][try_cast(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS INTEGER) % {len(DOMAINS)} + 1], 'other')"
    return rf"""
mx AS (SELECT *, {domain} AS domain, coalesce(lang, '') AS leaf_lang, coalesce(source, '') AS leaf_source,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::HUGEINT AS n FROM {docs}),
leaves AS (SELECT domain, leaf_lang, leaf_source, sum(n) AS tokens, sum(n) * {max_epochs} AS room, {_case("domain", "domain")} AS w0, {_case("lang", "leaf_lang")} AS w1, {_case("source", "leaf_source")} AS w2 FROM mx GROUP BY ALL),
{_pour_sql("doms", f"SELECT domain, w0, sum(room) AS room, 1 AS one, (SELECT sum(n) * {share[0]} // {share[1]} FROM mx) AS budget FROM leaves GROUP BY domain, w0", "one", "domain", "w0", "budget")},
{_pour_sql("lgs", "SELECT domain, leaf_lang, w1, t_doms, sum(l.room) AS room FROM leaves l JOIN doms USING (domain) GROUP BY ALL", "domain", "leaf_lang", "w1", "t_doms")},
{_pour_sql("srcs", "SELECT domain, leaf_lang, leaf_source, w2, tokens, l.room, t_lgs FROM leaves l JOIN lgs USING (domain, leaf_lang)", "domain, leaf_lang", "leaf_source", "w2", "t_lgs")},
plan AS (SELECT domain, leaf_lang, leaf_source, CASE WHEN tokens > 0 THEN t_srcs // tokens ELSE 0 END AS epochs, CASE WHEN tokens > 0 THEN t_srcs % tokens ELSE t_srcs END AS left_over FROM srcs),
keyed AS (SELECT mx.*, epochs, left_over, md5('{seed}|' || epochs || '|' || coalesce(doc_id::VARCHAR, '')) AS k FROM mx JOIN plan USING (domain, leaf_lang, leaf_source)),
summed AS (SELECT *, sum(n) OVER (PARTITION BY domain, leaf_lang, leaf_source ORDER BY k RANGE UNBOUNDED PRECEDING) AS upto FROM keyed),
mixed AS (SELECT * EXCLUDE (epochs, left_over, k, upto, n), n::BIGINT AS n_tokens, unnest(range((epochs + CASE WHEN upto <= left_over THEN 1 ELSE 0 END)::BIGINT))::INTEGER AS epoch FROM summed)"""


QUERIES = {"op5_mix_sources": op5_mix_sources}
SQL = {"op5_mix_sources": "WITH " + mixing_sql("documents", (6, 10), 2, 7) + "\nSELECT doc_id, epoch, domain, leaf_lang, leaf_source, n_tokens FROM mixed"}
