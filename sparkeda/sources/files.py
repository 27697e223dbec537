"""Reading uploaded files and writing results."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkeda.functions.kinds import quoted

# Texts read as missing, and the kind of each file extension.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
             "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
FILE_KINDS = {"csv": "csv", "xlsx": "excel", "xls": "excel", "txt": "text", "pdf": "pdf",
              "png": "image", "jpg": "image", "jpeg": "image"}
TRUTH = ["True", "False", "TRUE", "FALSE", "true", "false"]
#: A decimal number. Casts alone also take Java's literals, which turn codes like 12D or 0x1p3 into numbers.
DECIMAL = r"^[-+]?((\d+\.?\d*|\.\d+)([eE][-+]?\d+)?|(?i:inf|infinity))$"


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: the cluster's checkpoint folder.

    A temporary one is set only where there is none and the whole session is one process, as in tests.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current is None:
        wanted = spark.conf.get("spark.checkpoint.dir", None)
        if wanted is None and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(wanted or tempfile.mkdtemp(prefix="sparkeda-"))
        current = context.getCheckpointDir()
    return current


def new_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def read_table(
    spark: SparkSession, path: str, na_tokens: Sequence[str] = NA_TOKENS, multiline: bool = True
) -> DataFrame:
    """CSV with header; NA texts become NULL first, types are inferred second.

    One pass counts, per column, the values that fail each cast; the narrowest type without a
    failure wins: long, double, boolean, then text. An all-missing column is a double. Quoted values may hold line breaks; a
    file is then read by one task, so very large files without any are better read with ``multiline=False``.
    """
    raw = spark.read.csv(path, header=True, inferSchema=False, multiLine=multiline, escape='"')
    known = raw.select(*[F.when(~quoted(c).isin(list(na_tokens)), quoted(c)).alias(c) for c in raw.columns])

    def failures(c: str, dtype: str) -> Column:
        text = F.trim(quoted(c))
        return F.count_if(quoted(c).isNotNull() & (text.try_cast(dtype).isNull() | ~text.rlike(DECIMAL)))

    tests = []
    for i, c in enumerate(raw.columns):
        tests += [
            F.count(quoted(c)).alias(f"n{i}"), failures(c, "bigint").alias(f"l{i}"), failures(c, "double").alias(f"d{i}"),
            F.count_if(quoted(c).isNotNull() & ~quoted(c).isin(TRUTH)).alias(f"b{i}"),
            F.count_if(quoted(c).rlike("[.eE]")).alias(f"p{i}"),
        ]
    facts = known.agg(*tests).first()
    out = []
    for i, c in enumerate(raw.columns):
        gap = facts[f"n{i}"] == 0
        if not gap and facts[f"l{i}"] == 0 and facts[f"p{i}"] == 0:
            out.append(F.trim(quoted(c)).cast("bigint").alias(c))
        elif gap or facts[f"d{i}"] == 0:
            out.append(F.trim(quoted(c)).cast("double").alias(c))
        elif facts[f"b{i}"] == 0:
            out.append(quoted(c).cast("boolean").alias(c))
        else:
            out.append(quoted(c))
    return known.select(*out)


def read_text_preview(spark: SparkSession, path: str, n: int = 1000, folders: bool = False) -> DataFrame:
    """``(path, characters, preview)``: each text file's number of characters and its first ``n``; empty files are left out.

    With ``folders`` the files of a folder are one text, in the order of their names, as Spark writes one in parts.

    Files are read by lines in as many tasks as they have blocks; only a single line has to fit a task. Line feeds are what the
    file's bytes hold beyond its lines. A line that starts in a block from byte 4 n on lies behind the first n characters, and
    more than n lines are never needed, cut to n characters each, nor more than n files of a folder.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), "value")
    held = lines.groupBy("path").agg(
        (F.sum(F.length("value").cast("long")) + F.max("size") - F.sum(F.octet_length("value").cast("long"))).alias("characters"))
    first = lines.where(F.col("block") <= 4 * n).select("path", "block", "at", F.left("value", F.lit(n)).alias("line"))
    first = first.withColumn("no", F.row_number().over(W.partitionBy("path").orderBy("block", "at"))).where(F.col("no") <= n + 1)
    shown = first.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("no", "line"))).alias("lines")).select(
        "path", F.concat(F.array_join(F.transform("lines", lambda r: r["line"]), "\n"), F.lit("\n")).alias("start"))
    begun = held.join(shown, "path").select("path", "characters", F.left("start", F.least(F.col("characters"), F.lit(n)).cast("int")).alias("start"))
    if folders:
        named = begun.select(_folder("path").alias("folder"), "path", "characters", "start")
        named = named.withColumn("no", F.row_number().over(W.partitionBy("folder").orderBy("path")))
        needed = F.when(F.col("no") <= n, F.struct("no", "start"))
        begun = named.groupBy(F.col("folder").alias("path")).agg(F.sum("characters").alias("characters"), F.sort_array(F.collect_list(needed)).alias("starts"))
        begun = begun.select("path", "characters", F.left(F.array_join(F.transform("starts", lambda r: r["start"]), ""), F.lit(n)).alias("start"))
    return begun.select("path", "characters", F.concat("start", F.when(F.col("characters") > n, "...").otherwise("")).alias("preview"))


def _folder(path: str) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def file_manifest(spark: SparkSession, path: str, by: str = "name_size", folders: bool = False) -> DataFrame:
    """``(name, extension, kind, bytes)`` of every file below ``path``; the contents are not read.

    A file counts as seen when its name and size (or with ``by='name'`` its name) came before, in the order of paths. With
    ``folders`` the files of a folder that have one extension are one file with the folder's name, as Spark writes one in parts.
    """
    last = lambda c: F.element_at(F.split(c, "/"), -1)
    listed = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        .select("path", F.col("length").alias("bytes"), F.lower(F.element_at(F.split(last("path"), r"\."), -1)).alias("extension"))
    )
    if folders:
        listed = listed.groupBy(_folder("path").alias("path"), "extension").agg(F.sum("bytes").alias("bytes"))
    kinds = F.create_map(*[F.lit(x) for pair in FILE_KINDS.items() for x in pair])
    named = listed.select("path", last("path").alias("name"), "extension", "bytes")
    keys = (["name", "bytes"] if by == "name_size" else ["name"]) + (["extension"] if folders else [])
    first = named.groupBy(*keys).agg(F.min(F.struct("path", "extension", "bytes")).alias("first")).select("name", "first.*")
    return first.select("name", "extension", F.coalesce(kinds[F.col("extension")], F.lit("other")).alias("kind"), "bytes")


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)
    return path


def export_hits(hits: DataFrame, path: str) -> str:
    """Search hits with the export's column names."""
    return write_csv(hits.select(
        F.coalesce("title", F.lit("Unknown")).alias("Title"),
        F.coalesce("description", F.lit("No description")).alias("Description"),
        F.coalesce("url", F.lit("")).alias("URL"), F.col("source").alias("Source"),
        F.coalesce("type", F.lit("Dataset")).alias("Type")), path)


def write_report(lines: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """Write ``(line_no, line)`` as one text file, ordered by number and text; a report is as long as the schema."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"])
    lines.agg(F.array_join(ordered, "\n").alias("value")).write.mode(mode).text(path)
    return path


def search_report(ranked: DataFrame, counts: DataFrame, query: str, top: int = 5) -> DataFrame:
    """``(line_no, line)`` of the search report: query, total, hits per source, best titles."""
    listed = F.sort_array(F.collect_list(F.format_string("- %s: %d results", "source", "hits")))
    per_source = counts.where("source != 'TOTAL'").agg(F.array_join(listed, "\n").alias("line")).select(
        F.lit(101).cast("long").alias("line_no"), "line")
    best = ranked.where(F.col("rank") <= top).select(
        (F.col("rank") + 1_000_000).alias("line_no"),
        F.format_string("%d. %s (%s)", "rank", F.coalesce("title", F.lit("Unknown")), "source").alias("line"))
    total = counts.where("source = 'TOTAL'").select(
        F.lit(3).cast("long").alias("line_no"), F.format_string("**Total Results:** %d", "hits").alias("line"))
    # The headings of the search report.
    fixed = [(1, "# Dataset Search Report"), (2, f"**Query:** {query}"), (100, "## Sources Searched:"),
             (1_000_000, "## Top Recommendations:")]
    heads = ranked.sparkSession.createDataFrame(fixed, "line_no long, line string")
    return heads.unionByName(total).unionByName(per_source).unionByName(best)
