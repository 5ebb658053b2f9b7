"""Readers of specimen archives, labels and exports."""

from __future__ import annotations

import csv
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traitloom.operators.detections import parsed_labels
from traitloom.operators.lineage import cut
from traitloom.operators.linkage import stacked

SEPARATORS = ("\t", ",", "|", ";")


def separator_of(header: str, extension: str) -> str:
    """The separator most frequent in a header line; by extension where none occurs."""
    best = max(SEPARATORS, key=header.count)
    return best if header.count(best) else ("," if extension == "csv" else "\t")


def separators_of(header: str, extension: str) -> list[str]:
    """All separators in the order in which they are tried: the most frequent in the header first, then by extension."""
    rest = (",", "\t", "|", ";") if extension == "csv" else SEPARATORS
    return sorted(rest, key=lambda s: -header.count(s))


def fitting_separator(lines: list[str], extension: str) -> str:
    """The first separator that gives the header line at least two fields and all others as many; else the first tried.

    Fields in double quotes may hold separators.
    """
    fields = lambda line, sep: len(next(csv.reader([line], delimiter=sep), []))
    tried = separators_of(lines[0] if lines else "", extension)
    for sep in tried:
        width = fields(lines[0], sep) if lines else 0
        if width > 1 and all(fields(line, sep) == width for line in lines[1:]):
            return sep
    return tried[0]


def read_delimited(spark: SparkSession, path: str, skip_bad_lines: bool = False, probe: int = 20) -> DataFrame:
    """A delimited table with a header, all columns strings; the separator is the one that fits the first ``probe`` lines."""
    lines = [r["value"] for r in spark.read.text(path).limit(probe).collect()]
    sep = fitting_separator(lines, path.rsplit(".", 1)[-1].lower())
    mode = "DROPMALFORMED" if skip_bad_lines else "PERMISSIVE"
    return spark.read.option("header", True).option("sep", sep).option("mode", mode).option("inferSchema", False).csv(path)


def read_archive(spark: SparkSession, occurrence: str, multimedia: str) -> tuple[DataFrame, DataFrame]:
    return read_delimited(spark, occurrence), read_delimited(spark, multimedia)


def read_archives(spark: SparkSession, pattern: str, sep: str | None = None) -> DataFrame:
    """One table over a glob of archive folders, with the folder's name as ``archive``.

    Without ``sep`` every file is read by its own separator (of its header
    line) and the columns that a file lacks are null.  There is one read per
    separator: cells are read by place and named by a join with the headers,
    which stay a table.  Only the names of the separators' files and the
    distinct column names reach the driver.  Columns come in the order in which
    the sorted files show them first.  As in Spark's own reader, names that
    differ by case alone are one column, a column without a name is called by
    its place, and names that one file repeats get their place appended.
    """
    whole = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))  # Spark names files by URL
    archive = F.element_at(F.split(whole, "/"), -2)

    def rows(paths, sep):
        return spark.read.option("header", True).option("sep", sep).csv(paths).withColumn("archive", archive)

    if sep is not None:
        return rows(pattern, sep)
    path = F.col("_metadata.file_path")
    lines = spark.read.text(pattern).where("_metadata.file_block_start = 0").select(path.alias("_path"), "value")
    heads = cut(_named_headers(lines.withColumn("at", F.monotonically_increasing_id()).groupBy("_path").agg(F.min_by("value", "at").alias("head"))))
    files = {r["_sep"]: r for r in heads.groupBy("_sep").agg(F.collect_list("_path").alias("paths"), F.max(F.size("_names")).alias("width")).collect()}
    first = heads.select("_path", F.posexplode("_names").alias("at", "name")).groupBy(F.lower("name").alias("low")).agg(F.min(F.struct("_path", "at", "name")).alias("first"))
    names = [r["first"]["name"] for r in sorted(first.collect(), key=lambda r: r["first"])]

    def named(sep, paths, width):
        """Cells by place, named by the header of their file."""
        cells = [f"_c{i}" for i in range(width)]
        read = spark.read.option("header", True).option("sep", sep).schema(", ".join(f"`{c}` string" for c in cells)).csv(sorted(map(unquote, paths)))
        placed = read.select(path.alias("_path"), archive.alias("_archive"), F.array(*cells).alias("_cells")).join(heads.select("_path", F.transform("_names", F.lower).alias("_names")), "_path")
        return placed.select(*[F.get("_cells", (F.array_position("_names", name.lower()) - 1).cast("int")).alias(name) for name in names], F.col("_archive").alias("archive"))

    return stacked(*[named(sep, r["paths"], r["width"]) for sep, r in sorted(files.items())])


def _named_headers(heads: DataFrame) -> DataFrame:
    """Separator ``_sep`` and column names ``_names`` of every file (_path, head), in column expressions."""
    head = F.coalesce("head", F.lit(""))
    times = lambda sep: F.length(head) - F.length(F.replace(head, F.lit(sep), F.lit("")))
    most = F.greatest(*map(times, SEPARATORS))
    usual = F.when(F.lower("_path").endswith(".csv"), ",").otherwise("\t")
    sep = F.when(most == 0, usual)
    for s in SEPARATORS:  # ties go to the first
        sep = sep.when(times(s) == most, s)
    width = heads.agg(F.max(most)).first()[0] or 0
    schema = ", ".join(f"_c{i} string" for i in range(width + 1))
    cells = F.lit(None).cast("array<string>")
    for s in SEPARATORS:
        parsed = F.from_csv(head, F.lit(schema), {"sep": s})
        cells = F.when(F.col("_sep") == s, F.array(*[parsed[f"_c{i}"] for i in range(width + 1)])).otherwise(cells)
    found = heads.withColumn("_sep", sep).withColumn("_cells", cells)
    # separators within quotes do not part names; the last names may be blank
    bare = F.regexp_replace(head, '"[^"]*"', "")
    last = F.array_max(F.transform("_cells", lambda c, i: F.when(c.isNotNull(), i + 1).otherwise(1)))
    count = F.greatest(last, F.length(bare) - F.length(F.replace(bare, F.col("_sep"), F.lit(""))) + 1)
    blank = F.transform(F.slice("_cells", F.lit(1), count), lambda c, i: F.when(F.coalesce(c, F.lit("")) == "", F.concat(F.lit("_c"), i)).otherwise(c))
    low = F.transform("_blank", F.lower)
    unlike = F.transform("_blank", lambda c, i: F.when(F.size(F.filter(low, lambda x: x == F.lower(c))) > 1, F.concat(c, i)).otherwise(c))
    return found.withColumn("_blank", blank).select("_path", "_sep", unlike.alias("_names"))


def read_colour_profile(spark: SparkSession, path: str) -> DataFrame:
    """Colours of a profile table ``name,r,g,b[,hex]`` without a header (name, r, g, b, hex); hex is filled in where it is missing."""
    cells = F.split("value", r"\s*,\s*")
    at = lambda i: F.get(cells, F.lit(i))
    rows = spark.read.text(path).where(F.size(cells) >= 4)
    named = rows.select(F.trim(at(0)).alias("name"), *[at(i + 1).try_cast("int").alias(c) for i, c in enumerate("rgb")], F.lower(F.trim(at(4))).alias("hex"))
    own = F.format_string("%02x%02x%02x", "r", "g", "b")
    return named.withColumn("hex", F.coalesce(F.when(F.col("hex") != "", F.col("hex")), own))


def read_url_table(spark: SparkSession, path: str, url: str, name: str) -> DataFrame:
    return read_delimited(spark, path).select(F.col(url).alias("url"), F.col(name).alias("name"))


def read_label_files(spark: SparkSession, path: str) -> DataFrame:
    """Detection rows from a folder of label files, one file per image."""
    stem = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.[^./]*$", 1)
    return parsed_labels(spark.read.text(path).select(stem.alias("filename"), F.col("value").alias("text")), "filename", "text")


def read_annotation_export(spark: SparkSession, path: str) -> DataFrame:
    """One row per labelled object of a labelling platform's JSON export."""
    schema = (
        "`External ID` string, Skipped boolean, Reviews array<struct<score:int>>, Label struct<objects:array<struct<value:string,"
        "bbox:struct<top:double,left:double,height:double,width:double>,point:struct<x:double,y:double>,line:array<struct<x:double,y:double>>>>>"
    )
    rows = spark.read.option("multiLine", True).schema(schema).json(path)
    objects = rows.select(F.col("External ID").alias("filename"), F.col("Skipped").alias("skipped"), F.size("Reviews").alias("reviews"), F.explode_outer("Label.objects").alias("o"))
    return objects.select("filename", "skipped", "reviews", "o.value", "o.bbox", "o.point", "o.line")


def read_coco(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Images and annotations of a COCO label set."""
    schema = (
        "images array<struct<id:long,file_name:string,width:int,height:int>>, annotations array<struct<id:long,image_id:long,category_id:int,"
        "iscrowd:int,area:double,bbox:array<double>>>"
    )
    whole = spark.read.option("multiLine", True).schema(schema).json(path)
    return whole.select(F.inline("images")), whole.select(F.inline("annotations"))


def read_contours(spark: SparkSession, path: str) -> DataFrame:
    """Contour files: eleven header lines and then points ``x,y`` (filename, header array, seq, x, y)."""
    stem = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.[^./]*$", 1)
    lines = F.split(F.regexp_replace("value", r"\s+$", ""), "\n")
    rows = spark.read.text(path, wholetext=True).select(stem.alias("filename"), lines.alias("lines"))
    found = rows.select("filename", F.slice("lines", 1, 11).alias("header"), F.posexplode(F.slice("lines", F.lit(12), F.greatest(F.size("lines") - 11, F.lit(0)))).alias("seq", "point"))
    xy = F.split("point", ",")
    return found.select("filename", "header", "seq", F.get(xy, F.lit(0)).try_cast("double").alias("x"), F.get(xy, F.lit(1)).try_cast("double").alias("y"))


def list_images(spark: SparkSession, path: str, extensions: tuple[str, ...]) -> DataFrame:
    """Image table of a folder: path, name, size and validity by extension; contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    return rows.select("path", name.alias("name"), "length", F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).isin(*extensions).alias("valid"))


def read_ground_truth(spark: SparkSession, pattern: str, kind: str, split: str, level: int = -1) -> DataFrame:
    """Ground-truth rows of files named ``<kind>__<split>__gt.csv``, or of folders of that name (``level`` -2); locations parsed."""
    parts = F.split(F.element_at(F.split(F.col("_metadata.file_path"), "/"), level), "__")
    rows = spark.read.option("header", True).csv(pattern).where((F.get(parts, F.lit(0)) == kind) & (F.get(parts, F.lit(1)) == split))
    return rows.select("filename", F.col("count").cast("int").alias("count"), F.from_json("locations", "array<array<double>>").alias("locations"))
