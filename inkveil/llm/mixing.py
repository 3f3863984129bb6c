"""Mixing sources to target weights with Spark expressions only: iterative proportional fitting.

Documents fall into cells (source, language, topic). The cells' token weights are raked to the target share of every source,
language and topic in turn until all marginals fit; a document is then kept with the probability of its cell,
by a number in [0, 1) that its identifier and the seed fix.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import stored, words

DIMENSIONS = ("source", "lang", "topic")
#: topic and the pattern that gives it to a text; the first that fits counts, `prose` is the rest.
TOPICS = [("legal", r"(?i)licen[cs]e|copyright"), ("contact", r"[A-Za-z0-9._%+-]@[A-Za-z0-9-]+\.[A-Za-z]|\+1 \("), ("data", r"[0-9]{6}")]
#: Cells up to this number are broadcast (about 100 bytes each); more are joined by a salted shuffle.
BROADCAST_CELLS = 50_000
SALTS = 64


def topic(text: Column, topics: list[tuple[str, str]] = TOPICS) -> Column:
    found = F.lit("prose")
    for name, pattern in reversed(topics):
        found = F.when(text.rlike(pattern), F.lit(name)).otherwise(found)
    return found


def tempered(cells: DataFrame, dimension: str, alpha: float) -> DataFrame:
    """Target share of each value of a dimension: its share of the tokens to the power alpha, normalised. Without any tokens all are 0."""
    shares = stored(cells.groupBy(dimension).agg(F.pow(F.sum("tokens").cast("double"), F.lit(alpha)).alias("p")), "shares")
    total = shares.agg(F.sum("p")).first()[0] or 0.0
    return shares.select(dimension, (F.col("p") / F.lit(total) if total else F.lit(0.0)).alias("target"))


def weighed(cells: DataFrame, factors: dict[str, DataFrame]) -> DataFrame:
    """The cells with `weight`: their share of the tokens times the factor of their value in each dimension (`factor_<dimension>`)."""
    now, weight = cells, F.col("base")
    for d, table in factors.items():
        now = now.join(table.select(F.col(d).alias("key"), F.col("factor").alias(f"factor_{d}")), F.col(d).eqNullSafe(F.col("key"))).drop("key")
        weight *= F.col(f"factor_{d}")
    return now.withColumn("weight", weight)


def raked(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = 30, tolerance: float = 1e-6) -> DataFrame:
    """The stored cells with `weight`: share of the mixture's tokens, whose sums over each value of each dimension meet the targets.

    `targets` maps a dimension to a table (value, target); values without a target get weight 0. Cells with zero tokens stay at
    zero. A weight is the cell's share of all tokens times one factor for its value in each dimension. A step sums the weights of each value
    of one dimension (partial sums first, so that a value with most cells is no task's own) and stores that dimension's new factors;
    Spark broadcasts a stored table of factors if its size allows. Rounds end when no sum was off its target by more than `tolerance`;
    marginals that no weights can meet together end after `rounds` rounds, with the last dimension's exact.
    """
    total = cells.agg(F.sum("tokens")).first()[0]
    cells = cells.withColumn("base", F.col("tokens") / F.lit(float(total)) if total else F.lit(0.0))
    goals = {d: stored(target.select(F.col(d).alias("key"), "target"), "targets") for d, target in targets.items()}
    factors: dict[str, DataFrame] = {}
    for _ in range(rounds):
        for d, goal in goals.items():
            old = F.max(f"factor_{d}") if d in factors else F.lit(1.0)
            margins = weighed(cells, factors).groupBy(d).agg(F.sum("weight").alias("margin"), old.alias("old"))
            found = margins.join(goal, F.col(d).eqNullSafe(F.col("key")), "left").withColumn("target", F.coalesce("target", F.lit(0.0)))
            scaled = F.when(F.col("margin") > 0, F.col("old") * F.col("target") / F.col("margin")).otherwise(F.lit(0.0))
            factors[d] = stored(found.select(d, scaled.alias("factor"), F.abs(F.col("margin") - F.col("target")).alias("off")), "factors")
        off = reduce(DataFrame.unionByName, [f.select("off") for f in factors.values()])
        if (off.agg(F.max("off")).first()[0] or 0.0) <= tolerance:
            break
    return weighed(cells, factors).drop("base", *[f"factor_{d}" for d in factors])


def uniform(id_col: Column, seed: str = "mix") -> Column:
    """A number in [0, 1) fixed by the identifier and the seed."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(id_col.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def mixed(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang",
    alpha: float = 0.9, targets: dict[str, DataFrame] | None = None, topics: list[tuple[str, str]] = TOPICS, seed: str = "mix",
) -> DataFrame:
    """row (struct of all columns of `docs`), topic, weight, probability, kept for every row.

    Default targets: the shares of tokens by source, language and topic to the power alpha, normalised. The probability of a cell is its
    weight over its share of the tokens, relative to the cell where that is highest (which is kept whole).
    Null sources and languages are values of their own; null and empty texts have no tokens, and a cell without tokens has
    probability 0. Rows with one id share their number; an empty table gives no rows.
    """
    text = F.coalesce(F.col("row")[text_col].cast("string"), F.lit(""))
    packed = docs.select(F.struct("*").alias("row")).select(
        "row", F.col("row")[source_col].cast("string").alias("source"), F.col("row")[lang_col].cast("string").alias("lang"), topic(text, topics).alias("topic")
    )
    cells = stored(packed.groupBy(*DIMENSIONS).agg(F.sum(F.size(words(text)).cast("long")).alias("tokens")), "tokens")
    goal = targets or {d: tempered(cells, d, alpha) for d in DIMENSIONS}
    rate = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(F.lit(0.0))
    rates = stored(raked(cells, goal).withColumn("rate", rate), "rates")
    top = rates.agg(F.max("rate")).first()[0] or 0.0
    probability = F.col("rate") / F.lit(top) if top else F.lit(0.0)
    rates = rates.select(*[F.col(d).alias(f"{d}_key") for d in DIMENSIONS], "weight", probability.alias("probability"))
    same = [F.col(d).eqNullSafe(F.col(f"{d}_key")) for d in DIMENSIONS]
    if cells.count() <= BROADCAST_CELLS:
        joined = packed.join(F.broadcast(rates), same, "left")
    else:
        salted = rates.withColumn("salt_key", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64(F.col("row")[id_col]), F.lit(SALTS)).cast("int")
        joined = packed.withColumn("salt", salt).join(salted, [*same, F.col("salt") == F.col("salt_key")], "left")
    return joined.select("row", "topic", "weight", "probability", (uniform(F.col("row")[id_col], seed) < F.col("probability")).alias("kept"))


def decisions(docs: DataFrame, **options: object) -> DataFrame:
    """doc_id, source, lang, topic, weight (of the cell), probability, kept of every row."""
    rows = mixed(docs.select("doc_id", "text", "source", "lang"), **options)
    return rows.select("row.doc_id", "row.source", "row.lang", "topic", "weight", "probability", "kept")


def sampled(docs: DataFrame, **options: object) -> DataFrame:
    """The kept rows, with the columns of `docs`."""
    return mixed(docs, **options).filter("kept").select("row.*")
