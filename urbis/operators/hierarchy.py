"""Parents, children and families: joins, closures, derived state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbis.model import schema
from urbis.session import checkpointed


def first_parent(df: DataFrame) -> DataFrame:
    """Rows with their first parent's id (null without one)."""
    return df.withColumn("parent_id", F.get("parents", F.lit(0)))


def parts_with_parents(df: DataFrame, columns: list[str], part: str = "BuildingPart", whole: str = "Building") -> DataFrame:
    """Each part that has its parent in the table, with columns of the parent prefixed parent_."""
    parts = first_parent(df.where(F.col("object_type") == part)).select("id", "parent_id")
    parents = df.where(F.col("object_type") == whole).select(F.col("id").alias("parent_id"), *(F.col(f"`{c}`").alias(f"parent_{c}") for c in columns))
    return parts.join(parents, "parent_id")


def parts_per_parent(df: DataFrame, part: str = "BuildingPart", whole: str = "Building") -> DataFrame:
    """Number of parts of each whole, zero included, from the parts' references."""
    refs = df.where(F.col("object_type") == part).select(F.explode("parents").alias("id"))
    counted = refs.groupBy("id").agg(F.count(F.lit(1)).alias("n"))  # before the join: parts never travel
    return df.where(F.col("object_type") == whole).select("id").join(counted, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


def parts_per_parent_listed(df: DataFrame, whole: str = "Building") -> DataFrame:
    """The same from the wholes' own lists of children."""
    return df.where(F.col("object_type") == whole).select("id", F.coalesce(F.array_size("children"), F.lit(0)).cast("bigint").alias("n"))


def childless(df: DataFrame, whole: str = "Building", part: str = "BuildingPart") -> DataFrame:
    """Wholes that no part names as parent."""
    refs = df.where(F.col("object_type") == part).select(F.explode("parents").alias("id"))
    return df.where(F.col("object_type") == whole).select("id").join(refs, "id", "left_anti")


def child_edges(df: DataFrame) -> DataFrame:
    return df.select(F.col("id").alias("parent"), F.explode("children").alias("child"))


def dangling(df: DataFrame) -> DataFrame:
    """(id, reference, kind) of references to ids that the table does not hold."""
    refs = df.select("id", F.explode("parents").alias("reference"), F.lit("parents").alias("kind")).unionByName(df.select("id", F.explode("children").alias("reference"), F.lit("children").alias("kind")))
    return refs.join(df.select(F.col("id").alias("reference")), "reference", "left_anti").select("id", "reference", "kind")


def duplicate_ids(df: DataFrame) -> DataFrame:
    return df.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def subtree(edges: DataFrame, roots: DataFrame, max_depth: int = 1000) -> DataFrame:
    """(root, id, depth) of everything reachable over (parent, child), the roots included at depth 0.

    Breadth first, one join a level against what was not yet reached, so cycles end by themselves; each
    level is written to the shared folder once, and all levels are united at the end. depth is the shortest.
    """
    seen = level = checkpointed(roots.select(F.col("id").alias("root"), "id", F.lit(0).alias("depth")).distinct())
    for depth in range(1, max_depth + 1):
        found = level.join(edges, level["id"] == edges["parent"]).select("root", F.col("child").alias("id"), F.lit(depth).alias("depth")).distinct()
        level = checkpointed(found.join(seen.select("root", "id"), ["root", "id"], "left_anti"))
        if level.isEmpty():
            return seen
        seen = seen.unionByName(level)
    raise RecursionError(f"deeper than {max_depth}")


def reached(df: DataFrame, start: DataFrame, max_depth: int = 1000) -> DataFrame:
    """(id) of everything that start reaches over children, start included: subtree() without the pairs of root and id."""
    lists = df.where(F.size("children") > 0).select("id", "children")
    seen = level = checkpointed(start.select("id").distinct())
    for _ in range(max_depth):
        found = level.join(lists, "id").select(F.explode("children").alias("id")).distinct()
        level = checkpointed(found.join(seen, "id", "left_anti"))
        if level.isEmpty():
            return seen
        seen = seen.unionByName(level)
    raise RecursionError(f"deeper than {max_depth}")


def unsettled(df: DataFrame) -> DataFrame:
    """(feature_id) of families that are more than a root and its parts, or whose derived state is not what their rows say.

    Without any, no row changes when feature_id, parents, children and bbox are derived anew: every reference stays in
    its family and is reciprocal, and the root's box holds its parts' boxes. One grouping, no join. Ids must be unique.
    """
    b, none = F.col("bbox"), F.col("children").isNull()
    root = F.col("id") == F.col("feature_id")
    right = F.when(root, F.col("parents").isNull() & (none | (F.size("children") > 0))).otherwise((F.col("parents") == F.array("feature_id")) & none)
    whole = b.isNull() | (sum((b[a].isNull().cast("int") for a in schema.AXES), F.lit(0)) == 0)
    boxes = [(f(b[a]), F.max(F.when(root, b[a]))) for f, axes in ((F.min, schema.AXES[:3]), (F.max, schema.AXES[3:])) for a in axes]
    named = [x.alias(f"{k}{i}") for i, pair in enumerate(boxes) for k, x in zip("fr", pair)]
    families = df.groupBy("feature_id").agg(F.count_if(root).alias("roots"), F.bool_and(F.coalesce(right & whole, F.lit(False))).alias("right"), F.collect_list(F.when(~root, F.col("id"))).alias("parts"), F.flatten(F.collect_list(F.when(root, F.col("children")))).alias("listed"), *named)
    same = F.array_sort("parts") == F.array_sort("listed")
    for i in range(len(boxes)):
        same = same & F.col(f"f{i}").eqNullSafe(F.col(f"r{i}"))
    return families.where(~F.coalesce((F.col("roots") == 1) & F.col("right") & same, F.lit(False))).select("feature_id")


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of all nodes of edges (a, b) but the smallest of each connected component, which is the root.

    Star contraction: in turn, every node's larger neighbours are hung on its smallest one, and all its smaller
    neighbours on the smallest, until the edges stay the same. Each step is kept in the shared folder.
    """
    edges = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = checkpointed(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        edges = checkpointed(large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
        before = now


def family_roots(df: DataFrame) -> DataFrame:
    """(id, feature_id): the root reached over first parents that are in the table; within a cycle, the smallest id.

    Pointer jumping: the distance covered doubles each round. The rounds end when no pointer moves, or when as
    many move as in the round before and no smallest id changed: then only cycles and what hangs on them move.
    """
    up = first_parent(df).select("id", "parent_id")
    present = df.select(F.col("id").alias("parent_id"))
    known = up.join(present, "parent_id", "left_semi").select("id", F.col("parent_id").alias("up"))
    jump = checkpointed(df.select("id").join(known, "id", "left").select("id", F.coalesce("up", "id").alias("up"), F.least("id", F.coalesce("up", "id")).alias("low")))
    before = None
    while True:
        ahead = jump.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("low").alias("next_low"))
        moved = checkpointed(jump.join(ahead, "up").select("id", F.col("next").alias("up"), F.least("low", "next_low").alias("low"), (F.col("next") != F.col("up")).alias("moved"), (F.col("next_low") < F.col("low")).alias("lower")))
        moves, lower = moved.agg(F.count_if("moved"), F.count_if("lower")).first()
        jump = moved.drop("moved", "lower")
        if not moves or (moves == before and not lower):
            break
        before = moves
    # A root points at itself; where pointers still move there is a cycle, named by its smallest member.
    fixed = known.select("id").withColumnRenamed("id", "up")
    in_cycle = jump.join(fixed, "up", "left_semi").select("id", F.col("low").alias("feature_id"))
    rooted = jump.join(fixed, "up", "left_anti").select("id", F.col("up").alias("feature_id"))
    return rooted.unionByName(in_cycle)


def subtree_bbox(df: DataFrame) -> DataFrame:
    """(id, bbox) with the union of each object's own bbox and its descendants' over children (cycle-safe)."""
    reach = subtree(child_edges(df), df.select("id"))
    own = df.select("id", "bbox").where("bbox IS NOT NULL")
    b = F.col("bbox")
    low, high = [F.min(b[a]).alias(a) for a in ("xmin", "ymin", "zmin")], [F.max(b[a]).alias(a) for a in ("xmax", "ymax", "zmax")]
    united = reach.join(own, "id").groupBy("root").agg(*low, *high)
    return united.select(F.col("root").alias("id"), F.struct("xmin", "ymin", "zmin", "xmax", "ymax", "zmax").alias("bbox"))


def feature_runs(df: DataFrame, order: str) -> DataFrame:
    """(feature_id, runs) of features whose rows are not contiguous in the order column."""
    from pyspark.sql.window import Window

    from urbis.operators.query import with_ordinal

    placed = with_ordinal(df.select("feature_id", order), [F.asc(order)])
    # Contiguous rows of one feature share ordinal minus rank within the feature: no global window is needed.
    gap = F.col("ordinal") - F.row_number().over(Window.partitionBy("feature_id").orderBy("ordinal"))
    return placed.withColumn("gap", gap).groupBy("feature_id").agg(F.count_distinct("gap").alias("runs")).where("runs > 1")


