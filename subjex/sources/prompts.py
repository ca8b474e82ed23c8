"""Few-shot prompt files (S4) and chat templates.

A prompt file is a sequence of blocks::

    IDN: <id>
    Text: <text>
    Schlagwörter: <keywords>
    ###

``Text: `` sets the current text, ``Schlagwörter: `` emits (text, keywords)
and resets the text; other lines are ignored; both values are stripped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from subjex.functions.text import ustrip

# The line markers of the prompt files.
TEXT_MARK = "Text: "
KEYWORDS_MARK = "Schlagwörter: "


def parse_prompt_lines(lines: DataFrame, prompt_col: str = "prompt") -> DataFrame:
    """S4 over (prompt, line_no, line) rows -> (prompt, ord, text, keywords).

    Segment id = number of keyword lines before a line; within a segment the
    last text line wins; a keyword line with no text before it gives ""."""
    w = Window.partitionBy(prompt_col).orderBy("line_no")
    is_kw = F.col("line").startswith(KEYWORDS_MARK)
    x = lines.select(prompt_col, "line_no", "line", is_kw.alias("_kw"))
    x = x.withColumn("_seg", F.sum(F.col("_kw").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    x = x.withColumn("_seg", F.coalesce("_seg", F.lit(0)))
    text = F.when(F.col("line").startswith(TEXT_MARK), ustrip(F.substring("line", len(TEXT_MARK) + 1, 1 << 30)))
    ws = Window.partitionBy(prompt_col, "_seg").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("_text", F.last(text, ignorenulls=True).over(ws))
    kw = x.where("_kw").select(prompt_col, (F.col("_seg") + 1).cast("int").alias("ord"),
                               F.coalesce("_text", F.lit("")).alias("text"),
                               ustrip(F.substring("line", len(KEYWORDS_MARK) + 1, 1 << 30)).alias("keywords"))
    return kw


def scan_prompt_files(spark: SparkSession, path: str) -> DataFrame:
    """Prompt files -> examples(prompt, ord, text, keywords); the prompt name
    is the file name without extension. Each file is one row (wholetext), its
    lines numbered with posexplode."""
    raw = spark.read.option("wholetext", True).text(path) \
        .select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1).alias("prompt"),
                F.col("value"))
    lines = raw.select("prompt", F.posexplode(F.split("value", "\n", -1)).alias("line_no", "line")) \
        .select("prompt", "line_no", F.regexp_replace("line", "\r$", "").alias("line"))
    return parse_prompt_lines(lines)


def scan_templates(spark: SparkSession, path: str) -> DataFrame:
    """Chat template JSON files -> (name, instruction, example, keywords, test_item)."""
    df = spark.read.option("multiLine", True).json(path)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.json)?$", 1)
    return df.select(name.alias("name"), "instruction", "example", "keywords", "test_item")


def scan_model_templates(spark: SparkSession, path: str) -> DataFrame:
    """The model -> template map (one JSON object) as rows."""
    df = spark.read.option("multiLine", True).json(path)
    kv = F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in df.columns]),
                                     F.array(*[F.col(f"`{c}`") for c in df.columns])))
    return df.select(kv.alias("model", "template_file")) \
        .select("model", F.regexp_replace("template_file", r"\.json$", "").alias("template"))
