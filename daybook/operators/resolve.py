"""Entity resolution: names that mean one organisation or person become one cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daybook.functions.text import cluster_id, org_names, organisation, person
from daybook.operators.components import connected_components
from daybook.operators.durable import save
from daybook.operators.fuzzy import similar


def _components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``norm, root`` with the smallest name of each component as root. Names are numbered by their order, so the smallest number is the smallest name."""
    n = max(1, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ids = save(nodes.select("norm").distinct().repartitionByRange(n, "norm").sortWithinPartitions("norm").withColumn("id", F.monotonically_increasing_id()), "names")
    ends = edges.join(ids.select(F.col("norm").alias("a"), F.col("id").alias("src")), "a").join(ids.select(F.col("norm").alias("b"), F.col("id").alias("dst")), "b")
    found = connected_components(ends.select("src", "dst"))
    rooted = ids.join(found, ids["id"] == found["node"], "left").select("norm", F.coalesce("component", "id").alias("c"))
    return rooted.join(ids.select(F.col("id").alias("c"), F.col("norm").alias("root")), "c").select("norm", "root")


def _described(forms: DataFrame, kind: str, fuzzy: DataFrame, high: float) -> DataFrame:
    """Canonical name, method, confidence and number of names of each cluster; ``forms`` has ``raw, weight, norm, root``, ``fuzzy`` the best ratio by root."""
    names = forms.groupBy("root", "raw").agg(F.max("weight").alias("weight"), F.min("norm").alias("norm"))
    size = Window.partitionBy("root")
    named = names.withColumn("n_variants", F.count(F.lit(1)).over(size).cast("int")).withColumn("canonical_name", F.min_by("raw", F.struct(-F.col("weight"), "raw")).over(size))
    named = named.join(fuzzy, "root", "left")
    method = F.when(F.col("n_variants") == 1, "singleton").when(F.col("ratio").isNull(), "normalized_exact").when(F.col("ratio") >= high, "fuzzy_high").otherwise("fuzzy_low")
    confidence = F.when(F.col("n_variants") == 1, F.lit(1.0)).when(F.col("ratio").isNull(), F.lit(1.0)).when((F.lit(kind) == "org") & (F.col("ratio") >= high), F.lit(0.95)).otherwise(F.greatest(F.lit(0.5), F.col("ratio") / 100))
    return named.select(F.col("raw").alias("raw_name"), F.lit(kind).alias("entity_type"), "canonical_name", cluster_id(kind, F.col("root")).alias("cluster_id"), confidence.alias("confidence"), method.alias("match_method"), "n_variants")


def resolve_orgs(names: DataFrame, threshold: float = 92.0, high: float = 95.0) -> DataFrame:
    """``entity_map`` of ``raw, weight``. Names are compared inside blocks of an equal first word, with their words sorted, and only when neither is more than twice as long as the other; those that can reach the threshold meet in the segment index (``fuzzy``), so a first word that very many names share costs no more than others."""
    forms = names.where("raw IS NOT NULL AND raw <> ''").groupBy("raw").agg(F.sum("weight").alias("weight")).withColumn("norm", F.explode(F.array_distinct(F.transform(org_names("raw"), organisation)))).where("norm <> ''")
    forms = save(forms, "forms")
    alias = forms.groupBy("raw").agg(F.min("norm").alias("a"), F.collect_set("norm").alias("all")).select("a", F.explode("all").alias("b")).where("a <> b")
    sorted_words = F.array_join(F.array_sort(F.split("norm", " ")), " ")
    close = similar(forms.select("norm").distinct(), threshold, F.split_part("norm", F.lit(" "), F.lit(1)), sorted_words)
    fuzzy = save(close.where(F.col("gap") <= F.floor(F.greatest(F.length("a"), F.length("b")) / 2)).select("a", "b", "ratio"), "fuzzy")
    roots = save(_components(forms, alias.unionByName(fuzzy.select("a", "b"))), "roots")
    least = fuzzy.join(roots, fuzzy["a"] == roots["norm"]).groupBy("root").agg(F.min("ratio").alias("ratio"))
    return _described(forms.join(roots, "norm"), "org", least, high)


def resolve_people(names: DataFrame, threshold: float = 95.0, high: float = 97.0) -> DataFrame:
    """``entity_map`` of ``raw, weight``. Equal last and first names are one person whatever the middle; last names are compared among equal first ones when their lengths differ by two at most."""
    forms = names.where("raw IS NOT NULL AND raw <> ''").groupBy("raw").agg(F.sum("weight").alias("weight")).withColumn("p", person(F.col("raw"))).select("raw", "weight", "p.last", "p.first").where("last <> ''")
    forms = save(forms.withColumn("norm", F.concat_ws(" ", "last", "first")), "people")
    keyed = forms.where("first <> ''").select("norm", "last", "first").distinct()
    fuzzy = save(similar(keyed, threshold, F.col("first"), F.col("last")).where("gap <= 2").select("a", "b", "ratio"), "fuzzy")
    roots = save(_components(forms, fuzzy.select("a", "b")), "roots")
    least = fuzzy.join(roots, fuzzy["a"] == roots["norm"]).groupBy("root").agg(F.min("ratio").alias("ratio"))
    return _described(forms.join(roots, "norm"), "person", least, high)


def write_entity_map(mapped: DataFrame, path: str) -> DataFrame:
    """The entity map as a table, in order of names within files, so that a lookup by name reads few row groups."""
    n = max(1, int(mapped.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    mapped.repartitionByRange(n, "raw_name").sortWithinPartitions("raw_name", "entity_type").write.mode("overwrite").option("compression", "zstd").parquet(path)
    return mapped.sparkSession.read.schema(mapped.schema).parquet(path)


def evaluate(mapped: DataFrame, same: DataFrame, other: DataFrame) -> DataFrame:
    """Figures of a map on pairs ``a, b`` of names that mean one entity and pairs that don't."""
    from daybook.operators.reports import figures

    cluster = lambda c: mapped.select(F.col("raw_name").alias(c), F.col("cluster_id").alias(f"of_{c}"))
    marked = same.select("a", "b", F.lit(True).alias("same")).unionByName(other.select("a", "b", F.lit(False).alias("same")))
    told = marked.join(cluster("a"), "a", "left").join(cluster("b"), "b", "left")
    return figures(told, F.col("same"), F.coalesce(F.col("of_a") == F.col("of_b"), F.lit(False)))
