"""The master list of departments from the knowledge tree, and the names that coverage is held against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.functions.text import squeeze, strip

# Folders and files of the tree, endings of names, names that are none, and the prefix of streets.
DUTY_FOLDER, POWER_FOLDER = "01_机构职责", "02_权责清单"
STREETS, DUTY_LIST = "白云区镇街机构职能和机构设置", "白云区政府部门职责明细"
SPLIT = "__拆分"
ENDINGS = (SPLIT, "_行政处罚", "_行政许可", "_行政强制", "_行政检查", "_行政确认", "_行政裁决", "_其他行政权力")
NOT_DEPARTMENTS, DISTRICT = ("疑似数据异常", DUTY_LIST), "白云区"
STREET_PREFIX = "广州市白云区人民政府-"
LONGEST = 30


def without_one(name: Column, endings: tuple[str, ...] = ENDINGS) -> Column:
    """The name without one of the endings, if it has one (the first of the list)."""
    out = name
    for ending in reversed(endings):
        out = F.when(name.endswith(ending), F.left(name, F.length(name) - len(ending))).otherwise(out)
    return out


def without_nested(name: Column, outer: str = SPLIT, endings: tuple[str, ...] = ENDINGS) -> Column:
    """The name without ``outer`` at its end, and then without one of the endings."""
    return without_one(without_one(name, (outer,)), endings)


def children(files: DataFrame, folder: str) -> DataFrame:
    """child: the distinct files and folders right below ``folder``; stem: a Markdown
    file's without its ending.  files: source_path, relative to the tree."""
    parts = F.split("source_path", "/")
    below = files.filter((F.get(parts, 0) == folder) & (F.size(parts) > 1)).select(F.get(parts, 1).alias("child"), (F.size(parts) == 2).alias("is_file")).distinct()
    stem = F.when(F.col("is_file") & F.col("child").endswith(".md"), F.left("child", F.length("child") - 3)).otherwise(F.col("child"))
    return below.select("child", stem.alias("stem"))


def in_folder(files: DataFrame, *folders: str) -> DataFrame:
    """Files right in that folder."""
    path = "/".join(folders) + "/"
    return files.filter(F.col("source_path").startswith(path) & ~F.contains(F.substr("source_path", F.lit(len(path) + 1)), F.lit("/")))


def department_master(files: DataFrame) -> DataFrame:
    """files: source_path, text.  name, code and the sorted distinct sources of every
    department: names below the powers' folder, nested endings off, that are of the
    district; and streets, by the heading in the first line of their files."""
    powers = children(files, POWER_FOLDER).select(squeeze(without_nested(F.col("stem"))).alias("name"), F.concat(F.lit("02:"), "child").alias("source"))
    powers = powers.filter((F.col("name") != "") & ~F.col("name").isin(*NOT_DEPARTMENTS) & F.col("name").contains(DISTRICT))
    street = squeeze(F.regexp_extract(F.regexp_extract("text", r"\A[^\n\r]*", 0), r"(?U)\A#\s+(.+)", 1))
    streets = in_folder(files, DUTY_FOLDER, STREETS + SPLIT).select(street.alias("street")).filter((F.col("street") != "") & (F.length("street") <= LONGEST))
    streets = streets.select(F.concat(F.lit(STREET_PREFIX), "street").alias("name"), F.lit(f"01:{STREETS}").alias("source"))
    named = powers.unionByName(streets).groupBy("name").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    return named.withColumn("code", F.concat(F.lit("DEPT-"), F.left(F.sha1(F.encode("name", "UTF-8")), F.lit(16))))


def coverage_names(files: DataFrame) -> DataFrame:
    """name: what coverage knows.  One ending off; streets of files that are their heading
    alone; headings of the second level in the list of duties."""
    powers = children(files, POWER_FOLDER).select(squeeze(without_one(F.col("stem"))).alias("name"))
    heading = F.regexp_extract("text", r"(?Ud)\A#\s+(.+)$", 1)
    streets = in_folder(files, DUTY_FOLDER, STREETS + SPLIT).select(heading.alias("h")).filter((F.col("h") != "") & (F.length(strip(F.col("h"))) <= LONGEST)).select(squeeze(F.col("h")).alias("name"))
    lines = in_folder(files, DUTY_FOLDER).filter(F.col("source_path") == f"{DUTY_FOLDER}/{DUTY_LIST}.md").select(F.explode(F.split("text", r"\r\n|[\n\r]")).alias("line"))
    duties = lines.filter(F.col("line").startswith("## ")).select(strip(F.substr("line", F.lit(4))).alias("h")).filter(F.length("h") <= LONGEST).select(squeeze(F.col("h")).alias("name"))
    return powers.unionByName(streets).unionByName(duties).distinct()
