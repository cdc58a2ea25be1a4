"""Retrieval metrics per query and per configuration, and the summary of a labelled set."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import materialize

#: Values of a group that one task sorts at most; quantiles of a group's sketch.
SMALL_GROUP, GRID = 100_000, 64


def is_labeled(answerable: Column, relevant: Column) -> Column:
    return ~answerable | ((F.size(relevant) > 0) & ~F.exists(relevant, lambda x: F.startswith(x, F.lit("TODO_"))))


def with_defaults(rows: DataFrame) -> DataFrame:
    """An evaluation set's rows with what they leave out."""
    texts = F.array().cast("array<string>")
    return rows.withColumns({
        "type": F.coalesce("type", F.lit("事实型")), "answerable": F.coalesce("answerable", F.lit(True)), "difficulty": F.coalesce("difficulty", F.lit("medium")),
        "kb_ids": F.coalesce("kb_ids", F.array().cast("array<int>")), "relevant_parent_ids": F.coalesce("relevant_parent_ids", texts),
        "evidence_keywords": F.coalesce("evidence_keywords", texts), "expected_answer": F.coalesce("expected_answer", F.lit("")), "notes": F.coalesce("notes", F.lit("")),
    })


def recall_at(retrieved: Column, relevant: Column, k: int) -> Column:
    hits = F.size(F.array_intersect(F.slice(retrieved, 1, k), relevant))
    return F.when(F.size(relevant) > 0, hits / F.size(F.array_distinct(relevant))).otherwise(0.0)


def reciprocal_rank(retrieved: Column, relevant: Column) -> Column:
    at = F.filter(F.transform(retrieved, lambda x, i: F.when(F.array_contains(relevant, x), i + 1)), lambda x: x.isNotNull())
    return F.when(F.size(at) > 0, 1.0 / at[0]).otherwise(0.0)


def ndcg_at(retrieved: Column, relevant: Column, k: int) -> Column:
    """Binary gains; an id that was retrieved twice counts twice."""
    gains = F.transform(F.slice(retrieved, 1, k), lambda x, i: F.when(F.array_contains(relevant, x), 1.0 / F.log2(i + 2.0)).otherwise(0.0))
    ideal = F.transform(F.sequence(F.lit(1), F.least(F.size(F.array_distinct(relevant)), F.lit(k))), lambda i: 1.0 / F.log2(i + 1.0))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(relevant) > 0, total(gains) / total(ideal)).otherwise(0.0)


def nearest_rank(values: str, p: float) -> Column:
    """The percentile that is one of the values."""
    return F.expr(f"percentile_disc({p}) within group (order by {values})")


def exact_percentile(rows: DataFrame, group: str, value: str, p: float, small: int = SMALL_GROUP) -> DataFrame:
    """(group, value, n): each group's nearest-rank percentile, one of its values, for groups of any size; nulls don't count.

    Rounds close in on the rank: a group's values are sketched by GRID quantiles, which tasks add up, the two around the rank are
    counted exactly, and what is not between them goes. Groups that have no more than small values left are sorted.
    """
    values = materialize(rows.select(F.col(group).alias("g"), F.col(value).alias("v")).filter("v is not null"), "percentile_values")
    state = values.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    state = state.withColumns({"t": F.greatest(F.ceil(F.col("n") * F.lit(p)), F.lit(1)), "m": F.col("n")})
    state = materialize(state, "percentile_state")
    within = lambda s: values.join(s.withColumnRenamed("g", "_g"), F.col("g").eqNullSafe(F.col("_g"))).filter("v between lo and hi")
    grid = [k / GRID for k in range(GRID + 1)]
    done = []
    while True:
        done.append(state.filter("lo = hi").select("g", "n", F.col("lo").alias("v")))
        few = within(state.filter((F.col("lo") < F.col("hi")) & (F.col("m") <= small)))
        few = few.withColumn("place", F.row_number().over(Window.partitionBy("g").orderBy("v"))).filter("place = t")
        done.append(few.select("g", "n", "v"))
        state = state.filter((F.col("lo") < F.col("hi")) & (F.col("m") > small))
        if state.isEmpty():
            break
        at = (F.col("t") / F.col("m") * GRID).cast("int")
        sketch = within(state).groupBy("g").agg(F.percentile_approx("v", grid, 10 * GRID).alias("q")).withColumnRenamed("g", "_g")
        near = state.join(sketch, F.col("g").eqNullSafe(F.col("_g"))).drop("_g")
        near = near.withColumns({"a": F.get("q", F.greatest(at - 1, F.lit(0))), "b": F.get("q", F.least(at + 2, F.lit(GRID)))}).drop("q")
        a, b, v = F.col("a"), F.col("b"), F.col("v")
        counted = within(near).groupBy("g", "n", "lo", "hi", "t", "m", "a", "b").agg(
            F.count_if(v < a).alias("less"), F.count_if(v == a).alias("at_a"), F.count_if((v > a) & (v < b)).alias("inside"), F.count_if((v == b) & (b > a)).alias("at_b"),
            F.max(F.when(v < a, v)).alias("below"), F.min(F.when((v > a) & (v < b), v)).alias("first"), F.max(F.when((v > a) & (v < b), v)).alias("last"), F.min(F.when(v > b, v)).alias("above"),
        )
        t, upto_a, upto_in = F.col("t"), F.col("less") + F.col("at_a"), F.col("less") + F.col("at_a") + F.col("inside")
        upto_b = upto_in + F.col("at_b")
        kept = lambda lo, hi, before, m: F.struct(lo.alias("lo"), hi.alias("hi"), (t - before).cast("long").alias("t"), m.cast("long").alias("m"))
        step = (
            F.when(t <= F.col("less"), kept(F.col("lo"), F.col("below"), F.lit(0), F.col("less"))).when(t <= upto_a, kept(a, a, F.lit(0), F.lit(1)))
            .when(t <= upto_in, kept(F.col("first"), F.col("last"), upto_a, F.col("inside"))).when(t <= upto_b, kept(b, b, F.lit(0), F.lit(1)))
            .otherwise(kept(F.col("above"), F.col("hi"), upto_b, F.col("m") - upto_b))
        )
        state = materialize(counted.select("g", "n", step.alias("s")).select("g", "n", "s.*"), "percentile_state")
    return reduce(DataFrame.unionByName, done).select(F.col("g").alias(group), F.col("v").alias(value), "n")


def report(results: DataFrame) -> DataFrame:
    """results (config, answerable, labeled, recall, rr, ndcg, latency_ms, refused) -> a row per config: quality over answerable,
    labelled queries, refusal over the others, latency over all; 0 where there is none."""
    good = F.col("answerable") & F.col("labeled")
    mean = lambda c, when: F.round(F.coalesce(F.avg(F.when(when, c)), F.lit(0.0)), 6)
    return results.groupBy("config").agg(
        mean(F.col("recall"), good).alias("recall_at_5"), mean(F.col("rr"), good).alias("mrr"), mean(F.col("ndcg"), good).alias("ndcg_at_10"),
        nearest_rank("latency_ms", 0.95).alias("p95_latency_ms"),
        mean(F.col("refused").cast("double"), ~F.col("answerable")).alias("negative_refusal_rate"), mean(F.col("refused").cast("double"), good).alias("false_refusal_rate"),
    )


def summary(rows: DataFrame) -> DataFrame:
    """One row of counts and coverages of an evaluation set (answerable, relevant_parent_ids)."""
    marked = rows.select("answerable", is_labeled(F.col("answerable"), F.col("relevant_parent_ids")).alias("labeled"))
    c = marked.agg(
        F.count("*").alias("query_count"), F.count_if("answerable").alias("answerable_query_count"), F.count_if(~F.col("answerable")).alias("negative_query_count"),
        F.count_if("labeled").alias("labeled_query_count"), F.count_if(~F.col("labeled")).alias("unlabeled_query_count"),
        F.count_if(F.col("answerable") & F.col("labeled")).alias("labeled_answerable_query_count"),
    )
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return c.withColumns({"label_coverage": share("labeled_query_count", "query_count"), "answerable_label_coverage": share("labeled_answerable_query_count", "answerable_query_count")})


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    n = rows.count()
    return rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).withColumn("share", F.round(F.col("n") / F.lit(max(n, 1)), 6))
