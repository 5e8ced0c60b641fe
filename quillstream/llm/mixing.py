"""Mixing sources to target weights by capped water-filling. DataFrame functions only.

Sources in code-point order, null last, weigh WEIGHTS in turn and share all words of the corpus by weight; a source
stops at MOST_EPOCHS times its own words, and what it leaves is shared anew by weight among the others until none is
above. A source repeats every document as often as its target holds it whole; the rest of the target goes to documents
in a seeded order (md5 of seed and id), the last of which mix() counts in part, so that a source meets its target to the
word; remix() takes that document whole or not at all, whichever is nearer. Sums along that order are taken by two levels of 256 hash ranges and then inside one range, so no window
sees more than 256 rows or a 65,536th of a source.

Null texts have no words; null sources are a source; null ids take part under the md5 of their text; repeated rows are rows of
their own. Sources without words have target 0. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstream.llm import common

WEIGHTS, MOST_EPOCHS, SEED, SALTS = (5, 2, 1), 3, "mix-1", 16


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """Adds _size (words), _key (the seeded order), and _one, _two (its hash ranges) to docs."""
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))), F.lit(f":{SEED}")).cast("binary"))
    return docs.withColumn("_size", n_words(F.col("text"))).withColumn("_key", key).withColumn("_one", F.substring("_key", 1, 2)).withColumn("_two", F.substring("_key", 3, 2))


def weighed(sources: DataFrame) -> DataFrame:
    """sources (source, _words) with _weight, by a distributed rank: range partitions, and the rows before each."""
    dealt = common.materialise(sources.repartitionByRange(F.col("source").isNull(), F.col("source")).withColumn("_part", F.spark_partition_id()), "sources")
    counts = dealt.groupBy("_part").count()
    before = counts.select(F.col("_part").alias("_of"), (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))  # a row per range
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(F.col("source").isNull(), "source"))
    rank = (F.col("_before") + inside - 1) % len(WEIGHTS)
    return dealt.join(before, F.col("_part") == F.col("_of")).select("source", "_words", F.element_at(F.array(*map(F.lit, WEIGHTS)), (rank + 1).cast("int")).cast("long").alias("_weight"))


def water_fill(weights: DataFrame) -> DataFrame:
    """weights (source, _words, _weight) with target double, by rounds that each look at three sums."""
    cap, d = F.col("_words") * MOST_EPOCHS, "decimal(38,0)"
    total, clamped, weight = weights.agg(F.sum("_words"), F.lit(0), F.sum("_weight")).first()
    while True:
        above = cap.cast(d) * F.lit(weight).cast(d) < F.lit((total or 0) - clamped).cast(d) * F.col("_weight").cast(d)
        c, w = weights.agg(F.coalesce(F.sum(F.when(above, cap)), F.lit(0)), F.coalesce(F.sum(F.when(~above, F.col("_weight"))), F.lit(0))).first()
        if (c, w) == (clamped, weight) or not w:
            break
        clamped, weight = c, w
    share = (F.lit((total or 0) - clamped).cast("long") * F.col("_weight")).cast("double") / F.lit(float(weight or 1))
    return weights.withColumn("target", F.when(above, cap.cast("double")).otherwise(share))


def plan(sizes: DataFrame) -> DataFrame:
    """For each source: source_size, target, _whole repetitions, _rest words of one more, and where in the seeded order
    that rest ends: in range _one_at after _one_before words, and in its range _two_at after _two_before words."""
    sources = sizes.groupBy("source").agg(F.sum("_size").alias("_words"))
    goal = F.floor(F.col("target") + 0.5).cast("long")
    goals = water_fill(common.materialise(weighed(sources), "weights")).select("source", F.col("_words").alias("source_size"), "target", F.when(F.col("_words") > 0, F.floor(goal / F.col("_words"))).otherwise(0).cast("long").alias("_whole"), goal.alias("_goal"))
    goals = common.materialise(goals.withColumn("_rest", F.col("_goal") - F.col("_whole") * F.col("source_size")), "goals")

    def edge(rows: DataFrame, by: str, rest: str) -> DataFrame:
        """Of each source's ranges, the one in which the rest ends, if any."""
        ranges = rows.groupBy("source", by).agg(F.sum("_size").alias("_sum"))
        upto = F.sum("_sum").over(Window.partitionBy("source").orderBy(by))
        ends = ranges.withColumn("_before", upto - F.col("_sum")).withColumnRenamed("source", "_source")
        return ends.join(goals_now, F.col("_source").eqNullSafe(F.col("source"))).where(f"_before < {rest} and {rest} <= _before + _sum").select("source", F.col(by).alias(f"{by}_at"), F.col("_before").alias(f"{by}_before"))

    goals_now = goals
    first = common.materialise(edge(sizes, "_one", "_rest"), "edges")
    merge = lambda a, b: a.join(b.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    goals_now = common.materialise(merge(goals, first), "goals")
    inside = common.salted_left_join(sizes.select("source", "doc_id", "_one", "_two", "_size"), first, "source", SALTS, F.col("doc_id")).where("_one = _one_at").drop("_one_at", "_one_before")
    second = edge(inside, "_two", "(_rest - _one_before)")
    return common.materialise(merge(goals_now, second), "plan")


def apply(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """rows (of sized()) with source_size, target and taken long: the words that the mix takes of each."""
    both = common.salted_left_join(rows, goals, "source", SALTS, F.col("doc_id"))
    on_edge = F.coalesce((F.col("_one") == F.col("_one_at")) & (F.col("_two") == F.col("_two_at")), F.lit(False))
    inside = (F.col("_one") < F.col("_one_at")) | ((F.col("_one") == F.col("_one_at")) & (F.col("_two") < F.col("_two_at")))
    plain = both.where(~on_edge).withColumn("_extra", F.when(F.coalesce(inside, F.lit(False)), F.col("_size")).otherwise(F.lit(0)))
    before = F.sum("_size").over(Window.partitionBy("source").orderBy("_key", "doc_id", "_size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size")
    left = F.col("_rest") - F.col("_one_before") - F.col("_two_before") - before
    edge = both.where(on_edge).withColumn("_extra", F.greatest(F.lit(0), F.least(F.col("_size"), left)).cast("long"))
    return plain.unionByName(edge).withColumn("taken", (F.col("_whole") * F.col("_size") + F.col("_extra")).cast("long"))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken: a row per row of docs (doc_id, source, text)."""
    sizes = common.materialise(sized(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text")).drop("text"), "sizes")
    return apply(sizes, plan(sizes)).select("doc_id", F.col("_size").alias("size"), "source_size", "target", "taken")


def remix(docs: DataFrame) -> DataFrame:
    """The mix itself: every row as often as it is taken, with its own columns. A row that is taken in part comes once
    more if half of its words or more are taken. Rows without words are not taken."""
    named = ("doc_id", "source", "text")
    rest = [c for c in docs.columns if c not in named]
    rows = sized(docs.select(*named, F.struct(F.lit(0).alias("_none"), *rest).alias("_others")))
    sizes = common.materialise(rows.select("doc_id", "source", "_size", "_key", "_one", "_two"), "sizes")
    taken = apply(rows, plan(sizes)).where("taken > 0")
    times = F.floor((2 * F.col("taken") + F.col("_size")) / (2 * F.col("_size"))).cast("int")
    some = taken.withColumn("_nth", F.explode(F.array_repeat(F.lit(0), times)))
    return some.select(*[F.col(c) if c in named else F.col("_others")[c].alias(c) for c in docs.columns])


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.table(spark, sf_dir, "documents"))


OP1_SQL = r"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
                  md5(coalesce(doc_id::varchar, md5(coalesce(text, ''))) || ':mix-1') as k from documents),
s as (select source, sum(size)::hugeint as words, row_number() over (order by source nulls last) as r from d group by source),
w as (select source, words, [5, 2, 1][((r - 1) % 3 + 1)::int]::hugeint as weight, 3 * words as cap from s),
o as (select *, coalesce(sum(cap) over p, 0) as c, sum(weight) over () - coalesce(sum(weight) over p, 0) as left_weight, sum(words) over () as total
      from w window p as (order by cap::double / weight, source nulls last rows between unbounded preceding and 1 preceding)),
f as (select c, left_weight, total from o where cap * left_weight >= (total - c) * weight order by cap::double / weight, source nulls last limit 1),
t as (select o.source, o.words::bigint as source_size,
             case when o.cap * f.left_weight < (f.total - f.c) * o.weight then o.cap::double
                  else ((f.total - f.c) * o.weight)::double / f.left_weight::double end as target from o, f),
g as (select *, floor(target + 0.5)::bigint as goal, case when source_size > 0 then floor(target + 0.5)::bigint // source_size else 0 end as whole from t),
x as (select d.doc_id, d.size, g.source_size, g.target, g.whole, g.goal - g.whole * g.source_size as rest,
             coalesce(sum(d.size) over (partition by d.source order by d.k, d.doc_id, d.size rows between unbounded preceding and 1 preceding), 0) as before
      from d join g on d.source is not distinct from g.source)
select doc_id, size, source_size, target, (whole * size + greatest(0, least(size, rest - before)))::bigint as taken from x
"""
