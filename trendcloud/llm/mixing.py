"""Mixing sources to target weights by repeating documents a Poisson number of times.

Every source has a target weight and a size; their ratio is the mean number of
times that a document of it is wanted. A hash of the seed and the document, read
as a number in [0, 1), is looked up in the Poisson distribution of that mean, so
a document's count never depends on the others or on how the data lie; it is
exploded by its count, and a second hash deals the copies out over all tasks and
orders them there.

The sources' sizes are partial sums, and their distributions meet the documents in
an equi-join that Spark broadcasts or splits by size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendcloud.llm.common import shuffle_partitions, stored, working_names

SEED = 17
#: Weight of a source: its share of the corpus to this power (0 makes sources equal, 1 leaves them).
TEMPERATURE = 0.5
#: Terms of a distribution beyond its mean, in standard deviations; what is further out has no weight in a double.
SPREAD = 40


def unit(*parts: Column) -> Column:
    """A number in [0, 1) from the text of the parts, the same in any engine: 52 bits of MD5."""
    text = F.concat_ws("/", *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def tempered_rates(sizes: DataFrame, power: float = TEMPERATURE) -> DataFrame:
    """(source, rate) from (source, size): mean repetitions that bring each source to its
    tempered share while the corpus keeps its size."""
    sizes = stored(sizes.filter("size > 0"), "sizes")
    weight = F.pow(F.col("size").cast("double"), F.lit(power))
    total = sizes.agg(F.sum("size").alias("size"), F.sum(weight).alias("weight")).first()
    if not total["size"]:
        return sizes.select("source", F.lit(0.0).alias("rate"))
    rate = weight / F.lit(total["weight"]) * F.lit(float(total["size"])) / F.col("size")
    return sizes.select("source", rate.alias("rate"))


def poisson_steps(rates: DataFrame) -> DataFrame:
    """(source, steps): the distribution function of each rate at 0, 1, 2, ... .

    Summed term by term in logarithms, so large rates neither under- nor overflow.
    """
    last = F.ceil(F.col("rate") + SPREAD * F.sqrt(F.col("rate")) + SPREAD).cast("int")
    counts = F.sequence(F.lit(0), last)
    logs = F.transform(counts, lambda k: F.when(k == 0, -F.col("rate")).otherwise(F.log("rate") - F.log(k)))
    start = F.struct(F.lit(0.0).alias("log"), F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("steps"))

    def add(state: Column, term: Column) -> Column:
        log = state["log"] + term
        total = state["sum"] + F.exp(log)
        return F.struct(log.alias("log"), total.alias("sum"), F.array_append(state["steps"], total).alias("steps"))

    return rates.select("source", F.aggregate(logs, start, add, lambda s: s["steps"]).alias("steps"))


def mix_sources(
    docs: DataFrame,
    rates: DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: int = SEED,
) -> DataFrame:
    """The columns of `docs`, with `copy` (from 1) and `n_copies`, shuffled globally.

    `rates` gives (source, rate), mean repetitions; without it sources are brought
    to their tempered shares of the characters. A document is drawn by its id, so
    rows that share one are repeated alike; rows without an id are drawn by their
    text. A null source is a source of its own; sources without a rate, or with a
    rate of 0, are left out, and so are documents drawn 0 times. Sources without a
    single character have no weight. An empty table gives an empty one. Texts of
    any length only count their characters. Columns of the input named copy or
    n_copies are replaced; all others, whatever their names, come back as they are.
    """
    n = shuffle_partitions(docs.sparkSession)
    kept = docs.drop("copy", "n_copies")
    # A null source must meet its rate: the prefix keeps it apart from any text.
    name = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null"))
    if rates is None:
        size = F.sum(F.coalesce(F.char_length(text_col), F.lit(0)).cast("long"))
        rates = tempered_rates(kept.groupBy(name(F.col(source_col)).alias("source")).agg(size.alias("size")))
    else:
        rates = rates.select(name(F.col("source")).alias("source"), "rate")
    source, steps, at, place = working_names(docs, "source", "steps", "at", "place")
    drawn_steps = poisson_steps(rates.filter("rate > 0")).withColumnsRenamed({"source": source, "steps": steps})
    who = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))))
    drawn = (
        kept.withColumn(source, name(F.col(source_col)))
        .join(drawn_steps, source)
        .withColumn(at, unit(F.lit(seed), who))
        .withColumn("n_copies", F.size(F.filter(steps, lambda s: s <= F.col(at))))
        .filter("n_copies > 0")
        .drop(steps, source, at)
    )
    copies = drawn.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    return (
        copies.withColumn(place, F.xxhash64(F.lit(seed), who, F.col("copy")))
        .repartition(n, place)
        .sortWithinPartitions(place)
        .select(*kept.columns, "copy", "n_copies")
    )
