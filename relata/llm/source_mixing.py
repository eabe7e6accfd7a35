"""Mixing sources to target weights by Sainte-Laguë apportionment.

Targets: each source's share of all words by weight, at most `most` times its
own words; what is cut off goes to the others by weight. Blocks of equally many
words are then allotted to sources by highest quotients target / (2k - 1), the
blocks of each source in the same way to its shards, and each shard takes its
quota of blocks, some of them repeatedly, by a seeded systematic draw over its
documents in seeded order.

The seats that a party can get lie within votes * seats / total, times 1 -+
parties / (2 seats), -+ 1/2 (the sum of rounded shares passes the number of seats
within that factor), so only quotients in that band are ranked: about seven per
party, whatever the number of seats.

Scale: one pass over the documents makes sums per source and hash class, of which there are
as many as the documents ask for. A shard is some hash classes of a source, about `shard_rows`
documents; running sums are per shard, so a source
with a third of all rows is spread over as many shards as its size asks for. The
rest is arithmetic per row. Words of repeated blocks are counted, not copied.

Defined results: a null text has size 0 and is taken 0 times; the null source is
a source and comes last; a source without words has target 0; repeated rows are
rows of their own; without any words all targets are 0; an empty table gives an
empty one; a very long text has blocks in one shard only; extra columns are carried, the result
columns must not clash and are renamed by `names` if they would. Columns with maps or variants
do not count for the order of rows with the same id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relata.llm.frames import table
from relata.session import written

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK_WORDS = 64
#: A block is small enough for every source to have so many of them.
LEAST_BLOCKS = 50
SHARD_ROWS = 400
SEED = 1931


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; 0 for null. Each word with the space around it becomes one character, so no list of words is made."""
    one_each = F.regexp_replace(text, r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+", "x")
    return F.when(text.rlike(r"[^\x20\x09-\x0D]"), F.length(one_each)).otherwise(0).cast("long")


def sainte_lague(parties: DataFrame, group: list[str], key: list[str], votes: str, seats: str, quota: str) -> DataFrame:
    """(group, key, quota) for parties (group, key, votes, seats); seats is the same for all parties of a group.

    Exactly the highest quotients votes / (2k - 1); equal ones go to the lesser key. Parties without votes get none.
    """
    whole = Window.partitionBy(*group)
    band = (
        parties.select(*group, *key, F.col(votes).cast("double").alias("_v"), F.col(seats).alias("_s"))
        .withColumn("_share", F.when((F.col("_s") > 0) & (F.sum("_v").over(whole) > 0), F.col("_v") * F.col("_s") / F.sum("_v").over(whole)).otherwise(0.0))
        .withColumn("_slack", F.when(F.col("_s") > 0, F.col("_share") * F.count("*").over(whole) / (2 * F.col("_s"))).otherwise(0.0) + 0.5)
        .withColumn("_low", F.greatest(F.lit(0), F.ceil(F.col("_share") - F.col("_slack")) - 1).cast("long"))
        .withColumn("_high", F.when(F.col("_share") > 0, F.floor(F.col("_share") + F.col("_slack")) + 1).otherwise(0).cast("long"))
        .withColumn("_open", F.col("_s") - F.sum("_low").over(whole))
        .withColumn("_k", F.explode(F.when(F.col("_high") > F.col("_low"), F.sequence(F.col("_low") + 1, F.col("_high"))).otherwise(F.array(F.lit(0).cast("long")))))
        .withColumn("_q", F.when(F.col("_k") > 0, F.col("_v") / (2 * F.col("_k") - 1)).otherwise(-1.0))
    )
    ranked = band.withColumn("_rank", F.row_number().over(whole.orderBy(F.desc("_q"), *[F.asc(c) for c in key], "_k")))
    won = F.sum(F.when((F.col("_q") > 0) & (F.col("_rank") <= F.col("_open")), 1).otherwise(0))
    return ranked.groupBy(*group, *key).agg((F.max("_low") + won).alias(quota))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """For sizes (source, source_size, n_docs): the source's number in code-point order, null last, and its target in words."""
    everything = Window.partitionBy(F.lit(1))
    numbered = sizes.withColumn("source_no", F.row_number().over(everything.orderBy(F.asc_nulls_last("source"))))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("source_no") - 1, F.lit(len(weights))) + 1).cast("int"))
    capped = numbered.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("full_at", F.col("cap") / F.col("weight"))
    by_cap = everything.orderBy("full_at", "source_no")
    rest = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = capped.withColumn("level", rest / F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing)))
    settled = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "source_no", "level"))).over(everything)["level"]
    return level.withColumn("target", F.least("cap", F.col("weight") * F.coalesce(settled, F.lit(float("inf"))))).drop("level", "full_at", "cap")


def mix(docs: DataFrame, size: str = "size", id_col: str = "doc_id", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, most: float = MOST, block_words: int = BLOCK_WORDS, shard_rows: int = SHARD_ROWS, seed: int = SEED, names: tuple[str, str, str] = ("source_size", "target", "taken")) -> DataFrame:
    """docs, which has a column with each document's words, with its source's words and target, and the words that the mix takes of it."""
    size_of, target_of, taken = names
    # by the whole row, so that rows without an id, or with the same, are spread as well and have an order of their own
    hashed = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    order = F.xxhash64(F.col(id_col), F.lit(seed), *hashed)
    n_classes = 1 << max(12, (docs.count() // shard_rows).bit_length())
    classes = docs.select(F.col(source_col).alias("source"), F.pmod(order, F.lit(n_classes)).alias("class"), F.col(size).alias("size"))
    classes = written(classes.groupBy("source", "class").agg(F.sum("size").alias("size"), F.count("*").alias("n_docs")), "classes")
    sources = targets(classes.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum("n_docs").alias("n_docs")), weights, most)
    everything = Window.partitionBy(F.lit(1))
    smallest = F.min(F.when(F.col("source_size") > 0, F.col("source_size"))).over(everything)
    wide = F.greatest(F.lit(1), F.least(F.lit(block_words), F.floor(smallest / LEAST_BLOCKS))).cast("long")
    sources = sources.withColumn("block", F.coalesce(wide, F.lit(1).cast("long"))).withColumn("seats", F.round(F.sum("source_size").over(everything) / F.col("block")).cast("long"))
    power = F.least(F.lit(n_classes), F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("n_docs") / shard_rows))))).cast("long")
    sources = sources.withColumn("shards", power)
    quotas = sainte_lague(sources.withColumn("all", F.lit(1)), ["all"], ["source_no"], "target", "seats", "source_quota").drop("all")
    sources = written(sources.join(quotas, "source_no"), "sources")
    shards = classes.join(sources.withColumnRenamed("source", "its_source"), F.col("source").eqNullSafe(F.col("its_source")))
    shards = shards.withColumn("shard", F.pmod("class", "shards")).groupBy("source_no", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_quota").alias("source_quota"), F.first("target").alias("target"), F.first("source_size").alias("source_size"))
    shards = shards.withColumn("votes", F.when(F.col("source_size") > 0, F.col("target") * F.col("shard_size") / F.col("source_size")).otherwise(0.0))
    quotas = sainte_lague(shards, ["source_no"], ["shard"], "votes", "source_quota", "quota")
    shards = shards.select("source_no", "shard", "shard_size").join(quotas, ["source_no", "shard"]).join(sources.select("source_no", "block"), "source_no")
    # a shard gives a block `most` times at most; what rounding gave it beyond that goes to shards with blocks to spare
    room = F.lit(int(most)) * F.greatest(F.lit(1), F.ceil(F.col("shard_size") / F.col("block"))).cast("long")
    shards = shards.withColumn("over", F.greatest(F.lit(0), F.col("quota") - room)).withColumn("spare", F.greatest(F.lit(0), room - F.col("quota")))
    shards = written(shards.withColumn("over", F.sum("over").over(Window.partitionBy("source_no"))).withColumn("quota", F.least("quota", room)).drop("block"), "shards")
    more = sainte_lague(shards.where("over > 0"), ["source_no"], ["shard"], "spare", "over", "more")
    shards = written(shards.join(more, ["source_no", "shard"], "left").withColumn("quota", F.col("quota") + F.least(F.coalesce("more", F.lit(0)), F.col("spare"))).drop("over", "spare", "more"), "shards")

    row = F.struct(*docs.columns)
    known = sources.select(F.col("source").alias("its_source"), "source_no", F.col("source_size").alias("m_source_size"), F.col("target").alias("m_target"), "block", "shards")
    rows = docs.select(row.alias("row"), F.col(source_col).alias("m_source"), F.col(size).alias("m_size"), order.alias("m_order"), F.col(id_col).alias("m_id"))
    rows = rows.join(known, F.col("m_source").eqNullSafe(F.col("its_source"))).withColumn("shard", F.pmod("m_order", "shards"))
    before = Window.partitionBy("source_no", "shard").orderBy("m_order", "m_id", "m_size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("begin", F.coalesce(F.sum("m_size").over(before), F.lit(0).cast("long"))).join(shards, ["source_no", "shard"])
    n = F.greatest(F.lit(1), F.ceil(F.col("shard_size") / F.col("block"))).cast("long")
    rows = rows.withColumn("n", n).withColumn("quota", F.least(F.col("quota"), F.lit(int(most)) * F.col("n")))
    rows = rows.withColumn("offset", F.pmod(F.xxhash64("source_no", "shard", F.lit(seed)), F.col("n")))

    def taken_before(p: str) -> str:
        """Words taken of the first p words of the shard: whole blocks, then a part of the one that p lies in."""
        j = f"(({p}) div block)"
        drawn = lambda k: f"((({k}) * (quota % n) + offset) div n)"
        return f"(block * ((quota div n) * {j} + {drawn(j)}) + (({p}) % block) * ((quota div n) + {drawn(f'{j} + 1')} - {drawn(j)}))"

    words = F.expr(f"{taken_before('begin + m_size')} - {taken_before('begin')}").cast("long")
    return rows.select("row.*", F.col("m_source_size").alias(size_of), F.col("m_target").alias(target_of), words.alias(taken))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("text_mark"))
    return mix(written(sized, "sized")).select("doc_id", "size", "source_size", "target", "taken", "source")
