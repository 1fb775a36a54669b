"""Splitting a change into groups that can be reviewed one after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import sanitize_branch

SKIPPED = ("Lock", "Generated", "Snapshot")
#: Fixed value: the text of an issue.
MESSAGE = "File '%s' in group %d depends on '%s' which is in group %d, but group %d does not list group %d in depends_on"


def splittable(files: DataFrame) -> DataFrame:
    return files.filter(~F.col("category").isin(*SKIPPED))


def skipped(files: DataFrame) -> DataFrame:
    return files.filter(F.col("category").isin(*SKIPPED)).select("change_id", "path")


def file_size(logic, additions):
    return F.when(F.coalesce(logic, F.lit(0)) > 0, logic).otherwise(F.coalesce(additions, F.lit(0)))


def ordered_files(files: DataFrame, order: DataFrame) -> DataFrame:
    """Files of a change with their position: those in the graph by its order, then the others by path."""
    keyed = files.join(order, ["change_id", "path"], "left")
    place = Window.partitionBy("change_id").orderBy(F.col("k1").isNull(), "k1", "k2", "path")
    return keyed.withColumn("position", F.row_number().over(place)).drop("k1", "k2")


def assign_groups(files: DataFrame, target: int = 150) -> DataFrame:
    """group_index of each file (change_id, path, position, size): in order, a file opens a new group if the current one
    holds something and would pass the target with it.

    The sum starts over where a group opens, which no window frame can express, so the sizes of a change are
    folded in order by aggregate(); a change's files (not its lines) meet in one row for that.
    """
    state = "struct<group:int,size:bigint,held:boolean,out:array<struct<path:string,group_index:int>>>"
    start = F.struct(F.lit(0).alias("group"), F.lit(0).cast("bigint").alias("size"), F.lit(False).alias("held"), F.array().cast("array<struct<path:string,group_index:int>>").alias("out")).cast(state)

    def step(acc, x):
        opens = acc["held"] & (acc["size"] + x["size"] > target)
        group = F.when(opens, acc["group"] + 1).otherwise(acc["group"])
        size = F.when(opens, x["size"]).otherwise(acc["size"] + x["size"])
        return F.struct(group.alias("group"), size.alias("size"), F.lit(True).alias("held"), F.concat(acc["out"], F.array(F.struct(x["path"].alias("path"), group.alias("group_index")))).alias("out")).cast(state)

    rows = files.groupBy("change_id").agg(F.array_sort(F.collect_list(F.struct("position", "path", F.col("size").cast("bigint").alias("size")))).alias("rows"))
    return rows.select("change_id", F.inline(F.aggregate("rows", start, step)["out"]))


def common_directory(paths):
    """Longest common directory of an array of directories, in order: the common start with the first one, cut back to a
    '/' unless a part of the first one's path ends there."""
    first = F.element_at(paths, 1)

    def common(acc, p):
        n = F.least(F.length(acc), F.length(p))
        same = F.size(F.filter(F.sequence(F.lit(0), n), lambda i: F.substr(acc, F.lit(1), i) == F.substr(p, F.lit(1), i))) - 1
        return F.substr(acc, F.lit(1), same)

    start = F.aggregate(F.slice(paths, 2, F.greatest(F.size(paths) - 1, F.lit(0))), first, common)
    ends = (start == first) | (F.substr(first, F.length(start) + 1, F.lit(1)) == "/")
    return F.when(ends, start).otherwise(F.when(F.contains(start, F.lit("/")), F.regexp_replace(start, "/[^/]*$", "")).otherwise(""))


def group_names(members: DataFrame) -> DataFrame:
    """Name of each group of members (change_id, group_index, position, path): the common directory of its files
    without a leading src/, or group-N if there is none. Names of files are left out before directories are compared."""
    paths = members.groupBy("change_id", "group_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "path"))), lambda x: x["path"]).alias("paths"))
    fallback = F.concat(F.lit("group-"), F.col("group_index").cast("string"))
    flat = F.exists("paths", lambda p: ~F.contains(p, F.lit("/")))
    folders = F.transform("paths", lambda p: F.regexp_replace(p, "/[^/]*$", ""))
    name = F.regexp_replace(common_directory(folders), "^src/", "")
    return paths.select("change_id", "group_index", F.when(flat | (name == ""), fallback).otherwise(name).alias("name"))


def group_stats(members: DataFrame) -> DataFrame:
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return members.groupBy("change_id", "group_index").agg(F.count("*").alias("total_files"), total("additions").alias("total_additions"), total("deletions").alias("total_deletions"), total("logic_lines").alias("logic_lines"))


def _between(members: DataFrame, graph: DataFrame) -> DataFrame:
    src = members.select("change_id", F.col("path").alias("src"), F.col("group_index").alias("src_group"))
    dst = members.select("change_id", F.col("path").alias("dst"), F.col("group_index").alias("dst_group"))
    return graph.join(src, ["change_id", "src"]).join(dst, ["change_id", "dst"])


def group_dependencies(members: DataFrame, graph: DataFrame) -> DataFrame:
    """(change_id, group_index, depends_on): earlier groups of which a member imports a file."""
    return _between(members, graph).filter("dst_group < src_group").select("change_id", F.col("src_group").alias("group_index"), F.col("dst_group").alias("depends_on")).distinct()


def plan_issues(members: DataFrame, graph: DataFrame, depends: DataFrame) -> DataFrame:
    """An issue for each edge inside the plan whose target is neither in the file's group nor in one that this directly
    depends on."""
    crossing = _between(members, graph).filter("src_group <> dst_group").select("change_id", F.col("src_group").alias("group_index"), F.col("dst_group").alias("depends_on"), F.col("src").alias("file"), F.col("dst").alias("missing_dep"))
    missing = crossing.join(depends, ["change_id", "group_index", "depends_on"], "left_anti")
    message = F.format_string(MESSAGE, "file", "group_index", "missing_dep", "depends_on", "group_index", "depends_on")
    return missing.select("change_id", "group_index", "file", "missing_dep", message.alias("message"))


def split_plan(files: DataFrame, order: DataFrame, graph: DataFrame, target: int = 150) -> dict[str, DataFrame]:
    """groups, members, depends, skipped and issues of a change's split. files: path, category, additions, deletions,
    logic_lines."""
    sized = ordered_files(splittable(files), order).withColumn("size", file_size(F.col("logic_lines"), F.col("additions")))
    members = sized.join(assign_groups(sized, target), ["change_id", "path"])
    depends = group_dependencies(members, graph)
    groups = group_stats(members).join(group_names(members), ["change_id", "group_index"])
    return {"groups": groups, "members": members.select("change_id", "group_index", "position", "path"), "depends": depends, "skipped": skipped(files), "issues": plan_issues(members, graph, depends)}


def branch_plan(groups: DataFrame, depends: DataFrame, base: str = "main", prefix: str = "split") -> DataFrame:
    """What branches a split would make (nothing is written to a repository): each at its parent, which is the branch of
    the last group it depends on, else the base; and the base of its pull request, the branch before it."""
    name = F.concat(F.lit(f"{prefix}/part-"), F.lpad((F.col("group_index") + 1).cast("string"), 2, "0"), F.lit("-"), sanitize_branch(F.col("name")))
    named = groups.withColumn("branch_name", name)
    last = depends.groupBy("change_id", "group_index").agg(F.max("depends_on").alias("parent_group"))
    parent = named.select("change_id", F.col("group_index").alias("parent_group"), F.col("branch_name").alias("parent_branch"))
    n = F.count("*").over(Window.partitionBy("change_id"))
    before = F.lag("branch_name", 1, base).over(Window.partitionBy("change_id").orderBy("group_index"))
    title = F.format_string("[%d/%d] %s", F.col("group_index") + 1, n, F.col("name"))
    out = named.join(last, ["change_id", "group_index"], "left").join(parent, ["change_id", "parent_group"], "left")
    return out.select("change_id", "group_index", "branch_name", F.coalesce("parent_branch", F.lit(base)).alias("parent"), before.alias("pr_base"), title.alias("pr_title"), F.lit(True).alias("draft"), F.col("total_files").alias("file_count"))
