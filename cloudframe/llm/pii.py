"""Personal data by bootstrapped contextual extraction.

Regular expressions find seed entities: e-mail and IP addresses, card and phone numbers, and long
hexadecimal secrets. One or two words beside an entity are lexical patterns. Patterns and the
identifiers seen in them form a graph whose scores are worked out in rounds, until no further
pattern is sure: a pattern is as sure as the identifiers in it, in proportion to how often its words
stand in the corpus at all, so that words which are merely frequent never are; an identifier is as
sure as the patterns it is in. Tokens that look like identifiers and stand in sure patterns are
reported as kind "id", beside the base kinds; secrets too are reported only there. All of it is
DataFrame operations.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudframe.llm.shared import broadcast_if_small, discard, materialize

#: The contract's expressions, written so that Java takes time and stack in proportion to the
#: text: a run that cannot match is not tried again from each of its characters (a match that
#: starts inside a run could start at the run's first character, or where the last match ended),
#: and quantifiers that could never give back a character are possessive.
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What looks like an identifier: a run of at least eight such characters with a digit.
TOKEN = r"(?<![A-Za-z0-9_.@+/-])(?=[A-Za-z_.@+/-]*[0-9])[A-Za-z0-9_.@+/-]{8,}+"
#: A token that is a seed, though no base kind: hexadecimal digits, as of a key or a digest.
SECRET = r"^(?=[0-9]*[a-f])(?=[a-f]*[0-9])[0-9a-f]{32,}$"
#: A word of a pattern. Words are letters, so that none holds an identifier's number.
WORD = r"[\p{L}_]+"
CONTEXT = 64
#: Rounds at most; scores only grow, and they end with the first round that adds no sure pattern.
ROUNDS = 10
#: A pattern counts from this confidence on, and from so many identifiers in it.
CONFIDENCE, SUPPORT = 0.7, 3
#: Up to so many patterns, each a few words and two numbers, are broadcast; beyond, the join shuffles.
BROADCAST_PATTERNS = 100_000


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _is_ip(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda part: part.rlike("^0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})$"))


def _is_card(value: Column) -> Column:
    digits = F.reverse(_digits(value))

    def add(total: Column, at: Column) -> Column:
        digit = F.substr(digits, at, F.lit(1)).cast("int")
        twice = digit * 2
        return total + F.when(at % 2 == 1, digit).otherwise(twice - F.when(twice > 9, 9).otherwise(0))

    luhn = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0
    return F.length(digits).between(16, 19) & luhn


def _is_phone(value: Column) -> Column:
    return F.length(_digits(value)).between(8, 15)


CHECKS: dict[str, Callable[[Column], Column]] = {"email": lambda value: F.lit(True), "ip": _is_ip, "card": _is_card, "phone": _is_phone}


def matches(text: Column, expression: str, check: Callable[[Column], Column], kind: int) -> Column:
    """array<struct<kind, at, gap, size, value, before, after>> of the leftmost non-overlapping matches, in order.

    gap and size count code points: from the match before, and of the match itself. before and
    after are up to 64 characters beside it. value, before and after are null where the check
    fails. Work and memory are in proportion to the text.
    """
    parts = F.split(text, expression, -1)
    found = F.regexp_extract_all(text, F.lit(expression), F.lit(0))
    beside = F.zip_with(F.slice(parts, F.lit(1), F.size(found)), F.slice(parts, F.lit(2), F.size(found)), lambda p, a: F.struct(F.length(p).alias("gap"), F.right(p, F.lit(CONTEXT)).alias("before"), F.left(a, F.lit(CONTEXT)).alias("after")))
    checked = F.zip_with(beside, found, lambda x, m: F.struct(x.alias("x"), m.alias("m"), check(m).alias("ok")))
    own = {"before": lambda y: y["x"]["before"], "after": lambda y: y["x"]["after"]}
    return F.transform(
        checked,
        lambda y, at: F.struct(
            F.lit(kind).alias("kind"), at.alias("at"), y["x"]["gap"].alias("gap"), F.length(y["m"]).alias("size"),
            F.when(y["ok"], y["m"]).alias("value"), *(F.when(y["ok"], f(y)).alias(n) for n, f in own.items()),
        ),
    )


def placed_matches(rows: DataFrame) -> DataFrame:
    """row, kind, start, end, value, before, after of the matches that pass their check; rows has row and seen, from matches().

    Places are running sums of gaps and sizes. Tokens (the last kind) that overlap a match of
    another kind are left out: among the matches that start before a token's end, in order of
    place, one ends latest, and that one overlaps it if any does.
    """
    each = rows.select("row", F.inline("seen")).repartition("row")
    end = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("row", "kind").orderBy("at"))
    places = each.withColumn("end", end.cast("int")).withColumn("start", F.col("end") - F.col("size")).where("value is not null")
    seed = F.col("kind") < len(KINDS)
    order = Window.partitionBy("row").orderBy(F.when(seed, F.col("start")).otherwise(F.col("end")), seed).rowsBetween(Window.unboundedPreceding, 0)
    reach = F.max(F.when(seed, F.col("end"))).over(order)
    return places.withColumn("reach", reach).where(seed | F.col("reach").isNull() | (F.col("reach") <= F.col("start"))).select("row", "kind", "start", "end", "value", "before", "after")


def _beside(context: Column, side: str, n: int) -> Column:
    """The n words nearest to the match, as a pattern; null if there are fewer."""
    words = r"[^\p{L}_]+".join(["([\\p{L}_]+)"] * n)
    expression = rf"{words}[^\p{{L}}_]*$" if side == "L" else rf"^[^\p{{L}}_]*{words}"
    found = [F.lower(F.regexp_extract(context, expression, k + 1)) for k in range(n)]
    return F.when(found[0] != "", F.concat(F.lit(f"{side}:"), F.concat_ws(" ", *found)))


def word_counts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(words, seen): how often each of the wanted, a word or two words in a row, stands in all texts.

    A few wanted ones are broadcast, and other words are dropped before they are counted.
    """
    words = F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))
    listed = texts.select(words.alias("w"))
    pairs = F.zip_with("w", F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, F.coalesce(b, F.lit("\n"))))
    each = listed.select(F.explode(F.concat("w", pairs)).alias("words"))
    return each.join(broadcast_if_small(wanted, BROADCAST_PATTERNS), "words", "left_semi").groupBy("words").agg(F.count("*").alias("seen"))


def count_kind(spans: Column, kind: str) -> Column:
    """Number of spans of a kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def score_patterns(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, confidence, support) from edges (pattern, instance, n, seen) and seeds (instance).

    n: how often the instance stands in the pattern; seen: how often the pattern's words stand
    anywhere. confidence: the sum of n x score over seen, or over the sum of n where that is
    more; support: the instances. An instance's score is 1 for a seed, else 1 - product of
    (1 - 0.9 x confidence) over its patterns.
    """
    edges = materialize(edges)
    seeds = materialize(seeds.distinct().withColumn("seed", F.lit(1.0)))
    scores, old, sure = seeds, [], -1
    for n in range(rounds):
        scored = edges.join(scores.select("instance", F.col("seed").alias("score")), "instance", "left")
        sums = F.coalesce(F.sum(F.col("n") * F.col("score")), F.lit(0.0)) / F.greatest(F.max("seen"), F.sum("n"))
        patterns = materialize(scored.groupBy("pattern").agg(sums.alias("confidence"), F.count("*").alias("support")))
        discard(*old)
        before, sure = sure, patterns.where(is_sure()).count()
        if sure == before or n + 1 == rounds:
            break
        known = broadcast_if_small(patterns.where("confidence > 0"), BROADCAST_PATTERNS)
        reached = edges.join(known, "pattern").groupBy("instance").agg((1 - F.exp(F.sum(F.log1p(-0.9 * F.col("confidence"))))).alias("reached"))
        scores = materialize(reached.join(seeds, "instance", "left").select("instance", F.coalesce("seed", "reached").alias("seed")))
        old = [scores, patterns]
    discard(edges, seeds)
    return patterns


def is_sure() -> Column:
    return (F.col("confidence") >= CONFIDENCE) & (F.col("support") >= SUPPORT)


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, base (array of kind, start, end) and found (likewise, kind "id").

    base has the seeds in the order of KINDS and then of their start; found the tokens that
    patterns of high confidence discover, none of which overlaps a seed. Null counts as
    empty. Other columns of docs are left behind; rows that are equal come out alike.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    guards = {"email": F.instr("text", "@") > 0, "ip": F.col("text").rlike(r"[0-9]\.[0-9]"), "card": F.col("text").rlike("[0-9]"), "phone": F.col("text").rlike(r"\+[0-9]")}
    none = F.array().cast("array<struct<kind:int,at:int,gap:int,size:int,value:string,before:string,after:string>>")
    rules = [*((guards[k], rule, CHECKS[k]) for k, rule in KINDS.items()), (guards["card"], TOKEN, lambda value: F.lit(True))]
    seen = F.concat(*(F.when(guard, matches(F.col("text"), rule, check, k)).otherwise(none) for k, (guard, rule, check) in enumerate(rules)))
    rows = materialize(texts.select("doc_id", seen.alias("seen")).withColumn("row", F.monotonically_increasing_id()))

    sides = F.array_compact(F.array(*(_beside(F.col(column), side, n) for column, side in (("before", "L"), ("after", "R")) for n in (1, 2))))
    placed = materialize(placed_matches(rows).select("row", "kind", "start", "end", F.lower("value").alias("instance"), sides.alias("patterns")))
    seed = F.col("kind") < len(KINDS)
    known = placed.where(seed | F.col("instance").rlike(SECRET)).select("instance")
    edges = materialize(placed.select("instance", F.explode("patterns").alias("pattern")).groupBy("pattern", "instance").agg(F.count("*").alias("n")))
    enough = edges.groupBy("pattern").agg(F.count("*").alias("support")).where(F.col("support") >= SUPPORT).select("pattern", F.substr("pattern", F.lit(3)).alias("words"))
    enough = materialize(enough)
    counted = enough.join(word_counts(texts, enough.select("words").distinct()), "words").select("pattern", "seen")
    patterns = score_patterns(edges.join(broadcast_if_small(materialize(counted), BROADCAST_PATTERNS), "pattern"), known)
    sure = broadcast_if_small(patterns.where(is_sure()).select("pattern"), BROADCAST_PATTERNS)

    found = placed.where(~seed).select("row", "kind", "start", "end", F.explode("patterns").alias("pattern")).join(sure, "pattern").select("row", "kind", "start", "end").distinct()
    names = F.array(*map(F.lit, (*KINDS, "id")))
    spans = placed.where(seed).select("row", "kind", "start", "end").unionByName(found).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end"))).alias("spans"))

    def of(inside: Callable[[Column], Column]) -> Column:
        some = F.filter("spans", lambda s: inside(s["kind"] < len(KINDS)))
        return F.transform(some, lambda s: F.struct(names[s["kind"]].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    empty = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    both = {"base": of(lambda base: base), "found": of(lambda base: ~base)}
    return rows.select("row", "doc_id").join(spans, "row", "left").select("doc_id", *(F.coalesce(c, empty).alias(n) for n, c in both.items()))


def written(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
