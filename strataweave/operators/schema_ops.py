"""Schema comparison over the schema_field table, for a whole matrix of versions at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.model.schema import SEMANTICS, SHAPE, VALUES


#: Bounds of values: whether a greater one is tighter (None: any other one is).
BOUNDS = {"minimum": True, "maximum": False, "min_length": True, "max_length": False, "min_items": True, "max_items": False, "pattern": None}


def diff_fields(old: DataFrame, new: DataFrame, on: list[str] | None = None, renames: dict[str, str] | None = None) -> DataFrame:
    """One row a change (keys, kind, detail) from a full outer join on identity; columns as Schema.rows(), those that either side lacks aren't compared.

    renames: old field ids to new ones. detail names what changed where a kind has several."""
    keys = on or ["field_id"]
    if renames:
        table = F.create_map(*(F.lit(x) for kv in renames.items() for x in kv))
        old = old.withColumn("field_id", F.coalesce(F.try_element_at(table, F.col("field_id")), F.col("field_id")))
    plain = {"base_type": "type_changed", "multivalued": "cardinality_changed", "required": "requiredness_changed", "description": "description_changed", "recipe_ref": "recipe_changed", "vocabulary_ref": "vocabulary_changed"}
    names = [c for c in ("path", "collection", "enum", "open", *plain, *BOUNDS) if c in old.columns and c in new.columns]
    a, b = (df.select(*keys, F.lit(True).alias(f"{s}_there"), *(F.col(c).alias(f"{s}_{c}") for c in names)) for df, s in ((old, "old"), (new, "new")))
    both = a.join(b, keys, "full_outer")
    was, is_ = (lambda c: F.col(f"old_{c}")), (lambda c: F.col(f"new_{c}"))
    differ = lambda c: ~was(c).eqNullSafe(is_(c))
    none = F.array().cast("array<string>")
    less = lambda x, y: F.size(F.array_except(F.coalesce(x, none), F.coalesce(y, none))) > 0
    found = [("path", F.when(differ("path"), F.when(differ("collection"), "nesting_changed").otherwise("renamed")))]
    found += [(c, F.when(differ(c), kind)) for c, kind in plain.items() if c in names]
    found.append(("enum", F.when(less(was("enum"), is_("enum")), "constraint_narrowed").when(less(is_("enum"), was("enum")), "constraint_widened")))
    if "open" in names:
        some = (F.size(F.coalesce(was("enum"), none)) > 0) | (F.size(F.coalesce(is_("enum"), none)) > 0)
        found.append(("open", F.when(differ("open") & some, F.when(was("open"), "constraint_narrowed").otherwise("constraint_widened"))))
    for c, greater in BOUNDS.items():
        if c in names:
            tighter = F.lit(True) if greater is None else (is_(c) > was(c)) == F.lit(greater)
            found.append((c, F.when(differ(c), F.when(is_(c).isNull(), "constraint_widened").when(was(c).isNull() | tighter, "constraint_narrowed").otherwise("constraint_widened"))))
    changes = F.array(*(F.struct(kind.alias("kind"), F.lit(c).alias("detail")) for c, kind in found))
    alone = lambda kind: F.array(F.struct(F.lit(kind).alias("kind"), F.lit("").alias("detail")))
    kinds = F.when(F.col("old_there").isNull(), alone("added")).when(F.col("new_there").isNull(), alone("removed")).otherwise(F.filter(changes, lambda x: x["kind"].isNotNull()))
    return both.select(*keys, F.inline(kinds))


def diff_collections(old: DataFrame, new: DataFrame) -> DataFrame:
    """(collection, kind): collections that came or went, the ones around them too."""

    def all_of(df: DataFrame) -> DataFrame:
        names = F.split("collection", r"\[\]")
        each = F.transform(F.sequence(F.lit(1), F.size(names) - 1), lambda k: F.concat(F.array_join(F.slice(names, F.lit(1), k), "[]"), F.lit("[]")))
        return df.where("collection <> ''").select(F.explode(each).alias("collection")).distinct()

    a, b = all_of(old), all_of(new)
    return b.join(a, "collection", "left_anti").withColumn("kind", F.lit("collection_added")).unionByName(a.join(b, "collection", "left_anti").withColumn("kind", F.lit("collection_removed")))


def verdicts(diff: DataFrame) -> DataFrame:
    """One row: whether shape, values and semantics are compatible."""
    return diff.agg(*(F.coalesce(F.bool_and(~F.col("kind").isin(*kinds)), F.lit(True)).alias(name) for name, kinds in (("shape", SHAPE), ("values", VALUES), ("semantics", SEMANTICS))))


def enum_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """(field_id, removed, added) of fields whose permitted values changed."""
    a, b = old.select("field_id", F.col("enum").alias("a")), new.select("field_id", F.col("enum").alias("b"))
    out = a.join(b, "field_id").select("field_id", F.array_sort(F.array_except("a", "b")).alias("removed"), F.array_sort(F.array_except("b", "a")).alias("added"))
    return out.where((F.size("removed") > 0) | (F.size("added") > 0))


def migration_paths(spark, edges: DataFrame, start: str, goal: str, most: int = 32) -> DataFrame:
    """All simple paths from start to goal with at most `most` hops: (path, hops, worst, semantic, steps). Edges: src, dst, migration_id, fidelity, semantic, steps."""
    edges.createOrReplaceTempView("sw_edge")
    return spark.sql(
        f"""
        WITH RECURSIVE walk(at, seen, path, hops, worst, semantic, steps) AS (
          SELECT dst, array(src, dst), array(migration_id), 1, fidelity, semantic, steps FROM sw_edge WHERE src = :start
          UNION ALL
          SELECT e.dst, array_append(w.seen, e.dst), array_append(w.path, e.migration_id), w.hops + 1, greatest(w.worst, e.fidelity), w.semantic + e.semantic, w.steps + e.steps
          FROM walk w JOIN sw_edge e ON e.src = w.at WHERE NOT array_contains(w.seen, e.dst) AND w.hops < {int(most)}
        ) SELECT array_join(path, '>') AS path, hops, worst, semantic, steps FROM walk WHERE at = :goal""",
        {"start": start, "goal": goal},
    )


def best_path(paths: DataFrame, preference: str = "fidelity") -> DataFrame:
    key = {"fidelity": ("worst", "semantic", "hops"), "cost": ("semantic", "worst", "hops"), "hops": ("hops", "worst", "semantic"), "latency": ("steps", "hops")}[preference]
    return paths.agg(F.min_by(F.struct(*paths.columns), F.struct(*key, "path")).alias("p")).select("p.*").where("path IS NOT NULL")


def reachable(spark, edges: DataFrame, start: str) -> DataFrame:
    """(version, hops): the versions that can be reached, by the fewest hops."""
    edges.createOrReplaceTempView("sw_edge")
    return spark.sql(
        """
        WITH RECURSIVE walk(at, hops, seen) AS (
          SELECT CAST(:start AS string), 0, array(CAST(:start AS string))
          UNION ALL SELECT e.dst, w.hops + 1, array_append(w.seen, e.dst) FROM walk w JOIN sw_edge e ON e.src = w.at WHERE NOT array_contains(w.seen, e.dst)
        ) SELECT at AS version, min(hops) AS hops FROM walk WHERE hops > 0 GROUP BY at""",
        {"start": start},
    )
