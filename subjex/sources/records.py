"""Bibliographic records (S1, S2, P1): JSON-LD files to the dataset table.

Files are read whole (``wholetext``), one row per file; the four dimension
columns come from the path; each record is parsed as VARIANT so that
``title``/``abstract`` may be a string or an array and ``dcterms:subject``
an object or an array.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values that must equal the reference's (domain of the arguments and
# the prefix cut from document IRIs).
SPLITS = ("train", "dev", "test")
TEXT_TYPES = ("Article", "Book", "Conference", "Report", "Thesis")
LANGUAGES = ("en", "de")
SUBJECT_SETS = ("all-subjects", "tib-core-subjects")
DOC_IRI_PREFIX = "https://www.tib.eu/de/suchen/id/TIBKAT%"


def validate_domain(subjects: Sequence[str], splits: Sequence[str], text_types: Sequence[str],
                    languages: Sequence[str]) -> None:
    """Argument check before any plan is built."""
    for name, given, allowed in (("subjects", subjects, SUBJECT_SETS), ("splits", splits, SPLITS),
                                 ("text types", text_types, TEXT_TYPES), ("languages", languages, LANGUAGES)):
        bad = [g for g in given if g not in allowed]
        if bad:
            raise ValueError(f"invalid {name}: {bad}; allowed: {list(allowed)}")


def _vget(v: Column, path: str, typ: str) -> Column:
    return F.try_variant_get(v, path, typ)


def _text_value(node: Column, key: str) -> Column:
    """A string, or the array of strings joined by a space (array first:
    asking an array for ``string`` returns its JSON text)."""
    path = f'$["{key}"]'
    arr = _vget(node, path, "array<string>")
    return F.when(arr.isNotNull(), F.array_join(arr, " ")).otherwise(_vget(node, path, "string"))


def _has(node: Column, key: str) -> Column:
    return _vget(node, f'$["{key}"]', "variant").isNotNull()


def extract_records(df: DataFrame, json_col: str = "json", strict_order: bool = False,
                    keep: Sequence[str] = ()) -> DataFrame:
    """One dataset row per record that has an ``@graph``.

    gnd nodes (``@id`` starting ``gnd:``) give id -> ``sameAs``; the document
    node (``@id`` starting ``https:``) gives doc_id (IRI minus the fixed
    prefix), title, abstract and subjects; labels are the names of subjects
    found among the gnd nodes. A missing key drops the rest of that node only
    (title missing: no abstract, no subjects). By default labels resolve
    regardless of node order; ``strict_order`` only sees gnd nodes placed
    before the document node, as a single forward pass does.
    """
    v = F.parse_json(F.col(json_col))
    nodes = _vget(v, '$["@graph"]', "array<variant>")
    x = df.select(*keep, nodes.alias("_nodes")).where(F.col("_nodes").isNotNull())
    ids = F.transform("_nodes", lambda n, i: F.struct(_vget(n, '$["@id"]', "string").alias("id"),
                                                      i.alias("pos")))
    # the record's last document node (later assignments win); none -> no doc_id
    last_doc = F.try_element_at(F.filter(ids, lambda d: d["id"].startswith("https:")), F.lit(-1))
    doc = x.select(*keep, "_nodes", last_doc["id"].alias("_doc_id"), last_doc["pos"].alias("_p"))
    doc = doc.select("*", F.try_element_at(F.col("_nodes"), F.col("_p") + 1).alias("_node"))
    node = F.col("_node")
    has_title = _has(node, "title")
    has_abs = has_title & _has(node, "abstract")
    has_subj = has_abs & _has(node, "dcterms:subject")
    subj_arr = _vget(node, '$["dcterms:subject"]', "array<variant>")
    subj_one = _vget(node, '$["dcterms:subject"]', "variant")
    subj_nodes = F.when(subj_arr.isNotNull(), subj_arr).otherwise(F.array(subj_one))
    subj_ids = F.filter(F.transform(subj_nodes, lambda s: _vget(s, '$["@id"]', "string")),
                        lambda s: s.isNotNull())
    gnd = F.filter(F.transform("_nodes", lambda n, i: F.struct(
        _vget(n, '$["@id"]', "string").alias("id"), _vget(n, '$["sameAs"]', "string").alias("name"),
        i.alias("pos"))), lambda g: g["id"].startswith("gnd:") & g["name"].isNotNull())
    out = doc.select(
        *keep,
        F.substring(F.col("_doc_id"), len(DOC_IRI_PREFIX) + 1, 1 << 30).alias("doc_id"),
        F.when(has_title, _text_value(node, "title")).alias("title"),
        F.when(has_abs, _text_value(node, "abstract")).alias("abstract"),
        F.when(has_subj, subj_ids).alias("dcterms:subject"),
        gnd.alias("_gnd"), F.col("_p").alias("_doc_pos"))

    def label_of(sid):
        cands = F.filter(F.col("_gnd"), lambda g: (g["id"] == sid) &
                         ((g["pos"] < F.col("_doc_pos")) if strict_order else F.lit(True)))
        return F.try_element_at(cands, F.lit(-1))["name"]

    labels = F.filter(F.transform(F.coalesce(F.col("`dcterms:subject`"), F.array().cast("array<string>")),
                                  label_of), lambda s: s.isNotNull())
    return out.select(*keep, "doc_id", "title", "abstract", "dcterms:subject", labels.alias("labels"))


def planned_folders(spark: SparkSession, path: str, subjects: Sequence[str], splits: Sequence[str],
                    text_types: Sequence[str], languages: Sequence[str]) -> list[str]:
    """The wanted ``<path>/<subjects>/data/<split>/<text_type>/<language>`` that exist: one look-up each in the file
    system of ``path``, and no listing of anything else."""
    jvm = spark._jvm.org.apache.hadoop.fs
    root = jvm.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    wanted = [f"{s}/data/{p}/{t}/{l}" for s, p, t, l in itertools.product(subjects, splits, text_types, languages)]
    return [str(jvm.Path(root, w).toString()) for w in wanted if fs.exists(jvm.Path(root, w))]


def scan_records(spark: SparkSession, path: str, subjects: Sequence[str], splits: Sequence[str],
                 text_types: Sequence[str], languages: Sequence[str]) -> DataFrame:
    """``<path>/<subjects>/data/<split>/<text_type>/<language>/*``.

    Only the wanted directories are listed and read; those that do not exist are skipped. Spark packs small files
    into tasks. Every file counts, whatever its name ends with; the four dimensions come from the file path."""
    validate_domain(subjects, splits, text_types, languages)
    folders = planned_folders(spark, path, subjects, splits, text_types, languages)
    if not folders:
        raw = spark.createDataFrame([], "json string, file_path string")
    else:
        raw = spark.read.option("wholetext", True).text(folders).select(F.col("value").alias("json"), F.col("_metadata.file_path").alias("file_path"))
    rx = r".*/([^/]+)/data/([^/]+)/([^/]+)/([^/]+)/[^/]+$"
    dims = raw.select("json", "file_path", *(F.regexp_extract("file_path", rx, k).alias(name) for k, name in enumerate(("subjects", "split", "text_type", "language"), 1)))
    return extract_records(dims, "json", keep=("language", "split", "text_type", "subjects", "file_path"))
