"""De-duplication, upserts and merges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dqspark.operators import pairs


def suffixed(df: DataFrame, name: str, order: list[str], sep: str = "__") -> DataFrame:
    """Repeated names get __2, __3, ... in order."""
    k = F.row_number().over(Window.partitionBy(name).orderBy(*order))
    return df.withColumn("_k", k).withColumn(name, F.when(F.col("_k") > 1, F.concat(F.col(name), F.lit(sep), F.col("_k").cast("string"))).otherwise(F.col(name))).drop("_k")


def suffixed_names(names: list[str], sep: str = "__") -> list[str]:
    """The same for a list of headers, so that the suffixed ones do not collide either."""
    out: list[str] = []
    for name in names:
        new, k = name, 1
        while new in out:
            k += 1
            new = f"{name}{sep}{k}"
        out.append(new)
    return out


def distinct_content(df: DataFrame, content: str, order: list[str]) -> DataFrame:
    """Of equal contents (by sha1) the first by order; only hashes meet, not contents."""
    hashed = df.withColumn("sha1", F.sha1(F.col(content).cast("binary")))
    first = hashed.groupBy("sha1").agg(F.min(F.struct(*order)).alias("_first"))
    return hashed.join(first, "sha1").where(F.struct(*order) == F.col("_first")).drop("_first")


def best(df: DataFrame, by: list[str], score: Column, tie: list[str]) -> DataFrame:
    """The row of the highest score in each group, ties by the tie columns ascending."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), *tie)
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def file_score(name: Column, size: Column, hints: tuple[str, ...]) -> Column:
    """Score of a main file: logarithm of its size, a bonus for each hint in its name, one for prose."""
    bonus = reduce(lambda a, h: a + F.lower(name).contains(h).cast("int") * 5, hints, F.lit(0))
    prose = F.lower(name).rlike(r"\.(md|txt|html?)$").cast("int") * 2
    return F.log10(size + 1) + bonus + prose


def union_metadata(df: DataFrame, by: str) -> DataFrame:
    """Front matter of several pages as one: earliest created, longest description, sources once by (course, date).

    df: created (date), description, sources (array of struct with course and date).
    """
    return df.groupBy(by).agg(
        F.min("created").alias("created"),
        F.max_by("description", F.struct(F.length("description"), "description")).alias("description"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"),
    )


def contradictions(facts: DataFrame, key: str, text: str) -> DataFrame:
    """Pairs of different facts of at least three words that begin with the same two words. Equal texts are compared as one."""
    words = F.filter(F.split(F.lower(F.col(text)), r"\s+"), lambda w: w != "")
    own = facts.select(F.col(key).alias("id"), F.lower(text).alias("t"), words.alias("w")).where(F.size("w") >= 3)
    members = own.select(F.struct(F.concat_ws(" ", F.slice("w", 1, 2)).alias("head"), "t").alias("value"), "id")
    kinds = members.select("value").distinct().select("value", "value.*")
    a, b = kinds.alias("a"), kinds.alias("b")
    links = a.join(b, (F.col("a.head") == F.col("b.head")) & (F.col("a.t") < F.col("b.t"))).select(F.col("a.value").alias("a"), F.col("b.value").alias("b"), F.col("a.head").alias("head"))
    return pairs.of_members(members, links, "head").select("left_id", "right_id", "head")


def contradiction_groups(facts: DataFrame, key: str, text: str) -> DataFrame:
    """(head, n_facts, n_texts): heads of contradictions() with more than one text, a row for each however many pairs they make."""
    words = F.filter(F.split(F.lower(F.col(text)), r"\s+"), lambda w: w != "")
    own = facts.select(words.alias("w"), F.lower(text).alias("t")).where(F.size("w") >= 3)
    groups = own.groupBy(F.concat_ws(" ", F.slice("w", 1, 2)).alias("head")).agg(F.count(F.lit(1)).alias("n_facts"), F.count_distinct("t").alias("n_texts"))
    return groups.where("n_texts > 1")


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], update: bool = True) -> DataFrame:
    """Rows of changes by key over current ones; without update only new keys come in. Doing it twice changes nothing."""
    if update:
        return current.join(changes.select(*keys), keys, "left_anti").select(*current.columns).unionByName(changes, allowMissingColumns=True)
    return current.unionByName(changes.join(current.select(*keys), keys, "left_anti").select(*changes.columns), allowMissingColumns=True)


def pending(sources: DataFrame, manifest: DataFrame, content: str) -> DataFrame:
    """Sources whose content hash no earlier run has taken in."""
    hashed = sources.withColumn("sha256", F.sha2(F.col(content).cast("binary"), 256))
    return hashed.join(manifest.select("sha256"), "sha256", "left_anti")


def resolve_collisions(df: DataFrame, target: str, order: list[str], policy: str = "suffix") -> DataFrame:
    """Output names used twice: suffix them, skip the later ones, or raise."""
    k = F.row_number().over(Window.partitionBy(F.lower(target)).orderBy(*order))
    ranked = df.withColumn("_k", k)
    if policy == "skip":
        return ranked.where("_k = 1").drop("_k")
    if policy == "error":
        return ranked.withColumn(target, F.when(F.col("_k") > 1, F.raise_error(F.concat(F.lit("used twice: "), F.col(target)))).otherwise(F.col(target))).drop("_k")
    return ranked.withColumn(target, F.when(F.col("_k") > 1, F.concat(F.col(target), F.lit("-"), F.col("_k").cast("string"))).otherwise(F.col(target))).drop("_k")


def case_collisions(names: DataFrame, name: str) -> DataFrame:
    """Names that differ in case only: the lower-case form and its spellings."""
    return names.groupBy(F.lower(name).alias("folded")).agg(F.array_sort(F.collect_set(name)).alias("spellings")).where(F.size("spellings") > 1)


def promote(pages: DataFrame, root: str) -> DataFrame:
    """One row for each name that several layers have: merged description, facts (all, once), contradiction flag.

    pages: layer, name, description, facts (array of string).
    """
    groups = pages.groupBy("name").agg(
        F.array_sort(F.collect_set("layer")).alias("layers"),
        F.max_by("description", F.struct(F.length("description"), "description")).alias("description"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("facts")))).alias("facts"),
    ).where(F.size("layers") > 1)
    heads = F.transform("facts", lambda f: F.array_join(F.slice(F.split(F.lower(f), r"\s+"), 1, 2), " "))
    return groups.withColumn("contradicted", F.size(F.array_distinct(heads)) < F.size("facts")).withColumn("layer", F.lit(root))


def demote(pages: DataFrame, root: str, names: DataFrame) -> DataFrame:
    """The pages after those of the root layer with a name in names have gone back to the layers that their facts come from.

    pages: layer, name, description, facts (array of struct with layer and text). A page of a
    layer gets the root page's facts of that layer, once; facts without a layer stay nowhere else
    than at a page of the layer "unplaced".
    """
    gone = pages.where(F.col("layer") == root).join(names.select("name").distinct(), "name", "left_semi")
    placed = gone.select("name", "description", F.explode("facts").alias("fact"))
    back = placed.groupBy(F.coalesce("fact.layer", F.lit("unplaced")).alias("layer"), "name").agg(F.first("description").alias("description"), F.collect_list("fact").alias("facts"))
    rest = pages.join(gone.select("layer", "name"), ["layer", "name"], "left_anti")
    both = rest.select("layer", "name", "description", "facts").unionByName(back)
    return both.groupBy("layer", "name").agg(
        F.max_by("description", F.struct(F.length("description"), "description")).alias("description"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("facts")))).alias("facts")
    )
