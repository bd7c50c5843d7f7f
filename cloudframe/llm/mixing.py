"""Mixing sources to target weights by iterative proportional fitting.

Token weights of the cells source x language x topic are raked: scaled in turn so that their
sums by source, by language and by topic meet the targets, with no cell above the tokens it
has. A document is then kept with the probability weight / tokens of its cell. All of it is
DataFrame operations; the cells' table, not the documents, goes through the rounds, which are
window sums of one plan.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudframe.llm.shared import broadcast_if_small, materialize, own_columns, unit_hash, unused

WORDS = r"[^\x20\x09-\x0D]+"
#: Rules for a topic where the caller gives none, the first that matches; without a match it is "prose".
TOPICS = {"legal": "(?i)licen[sc]e|copyright", "credentials": "(token|password|secret|key) ?=", "contact": r"@[A-Za-z0-9-]+\.|\+[0-9]"}
ROUNDS = 10
#: Up to so many cells are broadcast, each of three names and a number; beyond, the join shuffles.
BROADCAST_CELLS = 50_000
#: The share of a category among the targets goes as its share of the tokens to this power, as far as it has tokens.
POWERS = {"source": 0.5, "lang": 0.5, "topic": 0.5}


def token_weight(text: Column) -> Column:
    """Words of a text as its weight in tokens; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("bigint")


def topic_of(text: Column) -> Column:
    """The topic by TOPICS; null: prose."""
    out = F.lit("prose")
    for name, rule in reversed(TOPICS.items()):
        out = F.when(text.rlike(rule), name).otherwise(out)
    return out


def tempered_targets(cells: DataFrame, dim: str, power: float, budget: float) -> DataFrame:
    """(dim, target): budget tokens shared out by the categories' tokens to the given power, to none more than it has.

    Categories with the fewest tokens for their share fill up first; what they cannot take is
    shared out among the others. In that order, a category's level is what the rest of the
    budget gives for each unit of the shares from it on; the greatest level that a category
    can take is that of all who aren't full.
    """
    sums = cells.groupBy(dim).agg(F.sum("base").cast("double").alias("tokens")).withColumn("raised", F.pow("tokens", F.lit(power)))
    order = Window.orderBy(F.col("tokens") / F.col("raised"), dim)
    before = F.coalesce(F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = (F.lit(budget) - before) / F.sum("raised").over(order.rowsBetween(0, Window.unboundedFollowing))
    levels = sums.withColumn("level", level)
    top = F.coalesce(F.max(F.when(F.col("level") * F.col("raised") <= F.col("tokens"), F.col("level"))), F.lit(float("inf")))
    return levels.crossJoin(F.broadcast(levels.agg(top.alias("top")))).select(dim, F.least("tokens", F.col("top") * F.col("raised")).alias("target"))


def rake(cells: DataFrame, dims: list[str], rounds: int = ROUNDS) -> DataFrame:
    """cells (dims, base, weight, target_<dim>) with `weight` raked to the targets, at most base.

    A category without a target keeps its weight. Cells of one partition are not shuffled;
    of more, each step deals them out by its dimension.
    """
    for _ in range(rounds):
        for dim in dims:
            now = F.sum("weight").over(Window.partitionBy(dim))
            factor = F.coalesce(F.try_divide(f"target_{dim}", now), F.lit(1.0))
            cells = cells.withColumn("weight", F.least(F.col("base").cast("double"), F.col("weight") * factor))
    return cells


def marginals(weights: DataFrame, dims: list[str]) -> DataFrame:
    """dim, category, target, reached, residual of raked cells: how far the sums of weights are from their targets.

    residual is the distance as a share of all weights. It stays above 0 where targets ask
    for more tokens than there are in the cells they meet in.
    """
    total = weights.agg(F.sum("weight").alias("total"))
    sums = None
    for dim in dims:
        one = weights.groupBy(F.col(dim).alias("category")).agg(F.max(f"target_{dim}").alias("target"), F.sum("weight").alias("reached")).select(F.lit(dim).alias("dim"), "*")
        sums = one if sums is None else sums.unionByName(one)
    off = F.try_divide(F.abs(F.col("reached") - F.col("target")), F.col("total"))
    return sums.crossJoin(F.broadcast(total)).select("dim", "category", "target", "reached", off.alias("residual"))


@dataclass(frozen=True)
class Mix:
    """What a sample is to be like.

    share: of all tokens, to keep. powers: the targets of source, lang and topic are their
    shares of the tokens to a power (1 keeps proportions, 0 makes all equal), but no more than
    the tokens there are, or for a dimension in `explicit` the shares given there. topic: a column of strings that the caller
    derives from the rows (by default rules on the text, topic_of()).
    """

    share: float = 0.7
    powers: dict[str, float] = field(default_factory=lambda: dict(POWERS))
    explicit: dict[str, dict[str, float]] = field(default_factory=dict)
    topic: Column | None = None
    seed: int = 11
    rounds: int = ROUNDS


def _categories(mix: Mix, text_col: str) -> dict[str, Column]:
    """A row's category in each dimension; null is a category of its own, written as the empty string."""
    topic = topic_of(F.col(text_col)) if mix.topic is None else mix.topic
    return {name: F.coalesce(c.cast("string"), F.lit("")) for name, c in (("source", F.col("source")), ("lang", F.col("lang")), ("topic", topic))}


def raked_cells(docs: DataFrame, mix: Mix = Mix(), text_col: str = "text") -> DataFrame:
    """source, lang, topic, base (tokens), weight and target_<dim> of every cell that has a word; a table of the shared folder."""
    categories = _categories(mix, text_col)
    marked = docs.select(*(c.alias(n) for n, c in categories.items()), token_weight(F.col(text_col)).alias("base"))
    cells = materialize(marked.groupBy(*categories).agg(F.sum("base").alias("base")).where("base > 0"))
    n, tokens = cells.agg(F.count("*"), F.sum("base")).first()
    budget = mix.share * (tokens or 0)
    aimed = cells.withColumn("weight", F.col("base") * F.lit(mix.share))
    for dim in categories:
        given = mix.explicit.get(dim)
        if given:
            rows = [(name, budget * part / sum(given.values())) for name, part in given.items()]
            targets = docs.sparkSession.createDataFrame(rows, f"{dim} string, target double")
        else:
            targets = tempered_targets(cells, dim, mix.powers[dim], budget)
        aimed = aimed.join(targets.withColumnRenamed("target", f"target_{dim}"), dim, "left")
    aimed = materialize(aimed)
    return materialize(rake(aimed.coalesce(1) if n <= BROADCAST_CELLS else aimed, list(categories), mix.rounds))


def _kept(docs: DataFrame, mix: Mix, id_col: str, text_col: str) -> tuple[DataFrame, list[str]]:
    """The rows kept, and the names of the columns added: source, lang, topic, n_tokens, rate."""
    names = unused(docs.columns, "cell_source", "cell_lang", "cell_topic", "n_tokens", "rate")
    rate = F.round(F.col("weight") / F.col("base"), 9)
    rates = raked_cells(docs, mix, text_col).select(*(F.col(d).alias(n) for d, n in zip(POWERS, names[:3], strict=True)), rate.alias(names[4]))
    categories = dict(zip(names, _categories(mix, text_col).values(), strict=False))
    marked = docs.withColumns(categories | {names[3]: token_weight(F.col(text_col))})
    drawn = unit_hash(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), mix.seed)
    return marked.join(broadcast_if_small(rates, BROADCAST_CELLS), names[:3]).where(drawn < F.col(names[4])), names


def mixed_sample(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows kept, with topic, n_tokens and rate (the probability of being kept) added.

    docs has source and lang. Whether a row stays depends on its doc_id, the seed and its
    cell's rate, so rows of equal doc_id and cell stay or go together. Added columns replace
    those of their names. An empty table stays empty. A document without words goes by its
    cell's rate; cells in which no document has a word go. raked_cells() and marginals() say
    how near the targets the weights come.
    """
    kept, names = _kept(docs, mix, id_col, text_col)
    added = ("topic", "n_tokens", "rate")
    return kept.select(*own_columns(docs, *added), *(F.col(n).alias(a) for n, a in zip(names[2:], added, strict=True)))


def sample_mix(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As mixed_sample(), with the columns of docs only."""
    return _kept(docs, mix, id_col, text_col)[0].select(*own_columns(docs))


def oracle(share: float = 0.7, seed: int = 11, rounds: int = ROUNDS) -> str:
    """The query over `documents` in DuckDB's SQL."""
    rules = " ".join(f"WHEN regexp_matches(text, '{rule}') THEN '{name}'" for name, rule in TOPICS.items())
    steps = [f"""m AS MATERIALIZED (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
  CASE {rules} ELSE 'prose' END AS topic, coalesce(len(regexp_extract_all(text, '{WORDS}')), 0)::BIGINT AS n_tokens FROM documents),
cells AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::BIGINT AS base FROM m GROUP BY ALL HAVING sum(n_tokens) > 0),
w0 AS MATERIALIZED (SELECT *, base * {share}::DOUBLE AS weight FROM cells)"""]  # fmt: skip
    for dim, power in POWERS.items():
        steps.append(f"""s_{dim} AS MATERIALIZED (SELECT {dim}, sum(base)::DOUBLE AS tokens, pow(sum(base)::DOUBLE, {power}) AS raised FROM cells GROUP BY {dim}),
l_{dim} AS MATERIALIZED (SELECT *, ({share}::DOUBLE * (SELECT sum(base) FROM cells)::DOUBLE - coalesce(sum(tokens) OVER (ORDER BY tokens / raised, {dim} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(raised) OVER (ORDER BY tokens / raised, {dim} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s_{dim}),
t_{dim} AS MATERIALIZED (SELECT {dim}, least(tokens, (SELECT coalesce(max(level) FILTER (WHERE level * raised <= tokens), 'inf'::DOUBLE) FROM l_{dim}) * raised) AS target FROM l_{dim})""")  # fmt: skip
    n = 0
    for _ in range(rounds):
        for dim in POWERS:
            steps.append(f"""w{n + 1} AS MATERIALIZED (SELECT source, lang, topic, base, least(base::DOUBLE, weight * target / sum(weight) OVER (PARTITION BY {dim})) AS weight
  FROM w{n} JOIN t_{dim} USING ({dim}))""")  # fmt: skip
            n += 1
    unit = f"('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / {16**13}::DOUBLE"
    return "WITH " + ",\n".join(steps) + f"""
SELECT doc_id, source, lang, topic, n_tokens, round(weight / base * 1000000)::BIGINT AS rate_ppm
FROM m JOIN w{n} USING (source, lang, topic) WHERE {unit} < round(weight / base, 9)"""  # fmt: skip
