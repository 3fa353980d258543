"""Comparing name lists: schema drift and approximate matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.operators.quality import null_counts
from tarmac.session import ensure_checkpointing


def schema_drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """Columns of two table versions side by side with their missing-value counts;
    a column only one side has is NULL on the other."""
    left = null_counts(old).withColumnRenamed("n_missing", "old_missing")
    right = null_counts(new).withColumnRenamed("n_missing", "new_missing")
    status = (
        F.when(F.col("old_missing").isNull(), "added").when(F.col("new_missing").isNull(), "removed").otherwise("kept")
    )
    return left.join(right, "column_name", "full").withColumn("status", status)


def _positions(text: Column) -> Column:
    """1 .. length; empty for empty text."""
    return F.filter(F.sequence(F.lit(0), F.length(text)), lambda i: i > 0)


def _one_shorter(text: Column) -> Column:
    return F.transform(_positions(text), lambda i: F.concat(F.substring(text, F.lit(1), i - 1), text.substr(i + 1, F.length(text))))


def _shortened(text: Column) -> Column:
    """The text with none, one or two characters left out."""
    once = _one_shorter(text)
    return F.array_distinct(F.concat(F.array(text), once, F.flatten(F.transform(once, _one_shorter))))


def edit_distance(a: Column, b: Column) -> Column:
    """Insertions, deletions, substitutions and swaps of neighbours, where no part is
    edited twice (optimal string alignment)."""

    def cell(i, j, row, above, above2):
        same = F.when(a.substr(i, F.lit(1)) == b.substr(j, F.lit(1)), 0).otherwise(1)
        swap = F.when(
            (i > 1)
            & (j > 1)
            & (a.substr(i, F.lit(1)) == b.substr(j - 1, F.lit(1)))
            & (a.substr(i - 1, F.lit(1)) == b.substr(j, F.lit(1))),
            F.get(above2, j - 2) + 1,
        )
        return F.least(F.get(above, j) + 1, F.get(row, j - 1) + 1, F.get(above, j - 1) + same, swap)

    def next_row(rows, i):
        row = F.aggregate(
            _positions(b),
            F.array(i),
            lambda row, j: F.concat(row, F.array(cell(i, j, row, rows["above"], rows["above2"]))),
        )
        return F.struct(row.alias("above"), rows["above"].alias("above2"))

    start = F.sequence(F.lit(0), F.length(b))
    table = F.aggregate(_positions(a), F.struct(start.alias("above"), start.alias("above2")), next_row)
    return F.element_at(table["above"], -1)


#: Edits that a pair may have, and the pairs of neighbouring characters one edit can change (a swap: three).
_EDITS, _CHANGED = 2, 3


def _gram_sets(names: DataFrame) -> DataFrame:
    """Rows (name, grams): pairs of neighbouring characters, with marks around the name, repeats numbered."""
    marked = F.concat(F.lit("\u0002"), F.col("name"), F.lit("\u0003"))
    pairs = F.transform(F.sequence(F.lit(1), F.length("name") + 1), lambda i: marked.substr(i, F.lit(2)))
    numbered = F.transform(
        F.col("pairs"), lambda g, i: F.concat(g, F.size(F.filter(F.slice("pairs", 1, i + 1), lambda o: o == g)).cast("string"))
    )
    return names.withColumn("pairs", pairs).select("name", numbered.alias("grams"))


def _keys(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (name, key) of both lists; names within two edits share a key.

    Two edits change at most six grams, so of a name's grams, the rarest first, one
    of the first seven is also among the other's first seven.  Names of five
    characters and less may share no gram at all; among them, a form with at most
    two characters left out is shared, and two-character names all lie within two
    edits of each other.
    """
    prefix = _EDITS * _CHANGED + 1
    sides = [_gram_sets(df) for df in (left, right)]
    common = sides[0].union(sides[1]).select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("names"))

    def keyed(sets: DataFrame) -> DataFrame:
        ranked = (
            sets.select("name", F.explode("grams").alias("gram")).join(common, "gram")
            .groupBy("name").agg(F.slice(F.sort_array(F.collect_list(F.struct("names", "gram"))), 1, prefix).alias("rare"))
        )
        grams = ranked.select("name", F.explode("rare.gram").alias("key"))
        short = sets.select("name").where(F.length("name") < prefix - 1)
        forms = F.filter(_shortened(F.col("name")), lambda f: F.length(f) > 0)
        tiny = F.when(F.length("name") <= _EDITS, F.array(F.lit("\u0001"))).otherwise(F.array().cast("array<string>"))
        return grams.union(short.select("name", F.explode(F.concat(F.transform(forms, lambda f: F.concat(F.lit("\u0001f"), f)), tiny)).alias("key")))

    return keyed(sides[0]), keyed(sides[1])


def fuzzy_candidates(left: DataFrame, right: DataFrame, left_on: str, right_on: str) -> DataFrame:
    """Pairs of names to be measured: a shared key, lengths within two of each other.

    The distinct names are stored first: the optimiser moves filters on what is made
    of a name below ``distinct``, where it would be made again for every row.
    """
    ensure_checkpointing(left.sparkSession)
    names = [df.select(F.col(on).cast("string").alias("name")).where(F.col("name").isNotNull()).distinct().checkpoint() for df, on in ((left, left_on), (right, right_on))]
    a, b = _keys(*names)
    near = F.abs(F.length("a") - F.length("b")) <= _EDITS
    return a.toDF("a", "key").join(b.toDF("b", "key"), "key").where(near).select(F.col("a").alias(left_on), F.col("b").alias(right_on)).distinct()


def fuzzy_full_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str) -> DataFrame:
    """Full outer join of two name lists on at most two edits (``edit_distance``).

    Candidates come from an equi join on rare pairs of neighbouring characters, and
    only they are measured.
    """
    pairs = (
        fuzzy_candidates(left, right, left_on, right_on)
        .withColumn("distance", edit_distance(F.col(left_on), F.col(right_on)))
        .where(F.col("distance") <= _EDITS)
    )
    return left.join(pairs, left_on, "left").join(right, right_on, "full")
