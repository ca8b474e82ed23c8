"""Stage tables derived from the driver's tables (FIXTURES.md section 3).

Each fixture has a Spark builder and the same definition as SQL (DuckDB
dialect) used by the oracle queries. All of them read whole tables; the
splits below are by value (a flag, a status, a label), never by id subsets.

PRED   one prediction per lineitem; member = (returnflag,
       linestatus), doc = order, label = part, candidate = supplier.
GOLD   distinct (order, part) of lineitems with discount >= 0.03, with the
       order's status / priority as language / text type.
"""

from __future__ import annotations

import string

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subjex.functions.text import gnd_id


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest table; its number of rows (from the file's footer) sizes the shuffles of what is built on it."""
    from subjex.session import size_shuffles
    li = table(spark, sf_dir, "lineitem")
    size_shuffles(spark, li.count())
    return li


# -------------------------------------------------------------- ENCODER

LETTERS = string.ascii_lowercase


def letter_counts(texts: list[str]) -> np.ndarray:
    """Stand-in encoder that SQL can repeat: how often each letter occurs."""
    return np.array([[t.count(c) for c in LETTERS] for t in texts], dtype=np.float64)


# ----------------------------------------------------------------- PRED

def pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = line_items(spark, sf_dir)
    cos = F.col("l_quantity") / 50.0
    return li.select(
        F.col("l_returnflag").alias("model"),
        F.col("l_linestatus").alias("prompt"),
        F.col("l_orderkey").alias("doc_id"),
        gnd_id(F.col("l_partkey")).alias("label_id"),
        F.concat(F.lit("kw"), F.col("l_suppkey").cast("string")).alias("candidate"),
        F.concat(F.lit("t"), F.col("l_partkey").cast("string"), F.lit("_"),
                 F.col("l_returnflag"), F.col("l_linestatus")).alias("term"),
        cos.alias("cosine_similarity"),
        (F.col("l_discount") * 10).alias("hybrid_score"),
        cos.alias("score"),
    )


PRED_SQL = """
SELECT l_returnflag AS model, l_linestatus AS prompt, l_orderkey AS doc_id,
       'gnd:' || CAST(l_partkey AS VARCHAR) AS label_id,
       'kw' || CAST(l_suppkey AS VARCHAR) AS candidate,
       't' || CAST(l_partkey AS VARCHAR) || '_' || l_returnflag || l_linestatus AS term,
       l_quantity / 50.0 AS cosine_similarity,
       l_discount * 10 AS hybrid_score,
       l_quantity / 50.0 AS score
FROM lineitem
"""


# ------------------------------------------------------------- STRATA / GOLD

def strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("doc_id"), F.col("o_orderstatus").alias("language"),
        F.col("o_orderpriority").alias("text_type"))


STRATA_SQL = """
SELECT o_orderkey AS doc_id, o_orderstatus AS language, o_orderpriority AS text_type FROM orders
"""


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = line_items(spark, sf_dir)
    pairs = li.where(F.col("l_discount") >= 0.03).select(
        F.col("l_orderkey").alias("doc_id"), gnd_id(F.col("l_partkey")).alias("label_id")).distinct()
    return pairs.join(strata(spark, sf_dir), "doc_id", "inner")


GOLD_SQL = f"""
SELECT g.doc_id, g.label_id, s.language, s.text_type
FROM (SELECT DISTINCT l_orderkey AS doc_id, 'gnd:' || CAST(l_partkey AS VARCHAR) AS label_id
      FROM lineitem WHERE l_discount >= 0.03) g
JOIN ({STRATA_SQL}) s USING (doc_id)
"""


def dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D2-like records with the subject list stringified as a CSV would hold it."""
    li = line_items(spark, sf_dir).where(F.col("l_discount") >= 0.03)
    quoted = F.concat(F.lit("'"), gnd_id(F.col("l_partkey")), F.lit("'"))
    subj = li.groupBy(F.col("l_orderkey").alias("doc_id")).agg(
        F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_list(quoted)), ", "), F.lit("]"))
        .alias("dcterms:subject"))
    return subj.join(strata(spark, sf_dir), "doc_id", "inner")


DATASET_SQL = f"""
SELECT d.doc_id, d."dcterms:subject", s.language, s.text_type
FROM (SELECT l_orderkey AS doc_id,
             '[' || string_agg('''gnd:' || CAST(l_partkey AS VARCHAR) || '''', ', '
                               ORDER BY '''gnd:' || CAST(l_partkey AS VARCHAR) || '''') || ']' AS "dcterms:subject"
      FROM lineitem WHERE l_discount >= 0.03 GROUP BY l_orderkey) d
JOIN ({STRATA_SQL}) s USING (doc_id)
"""


# ------------------------------------------------------------------ MEMBERS

# fixed ensembles as data (O5): name -> filter over the (model, prompt) pairs,
# one SQL predicate used by Spark and by the oracle alike
ENSEMBLES_SQL = {
    "all": "TRUE",
    "one-model-all-prompts": "model = 'R'",
    "one-prompt-all-models": "prompt = 'O'",
    "one-prompt-one-model": "model = 'A' AND prompt = 'F'",
}


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window
    pairs = pred(spark, sf_dir).select("model", "prompt").distinct()
    parts = [pairs.where(cond).select(F.lit(name).alias("ensemble"), "model", "prompt")
             for name, cond in ((n, F.expr(c)) for n, c in ENSEMBLES_SQL.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    w = Window.partitionBy("ensemble").orderBy("model", "prompt")
    return out.withColumn("ord", F.row_number().over(w))


MEMBERS_SQL = "SELECT ensemble, model, prompt, CAST(row_number() OVER (PARTITION BY ensemble ORDER BY model, prompt) AS INTEGER) AS ord FROM (" + \
    " UNION ALL ".join(
        f"SELECT DISTINCT '{name}' AS ensemble, model, prompt FROM ({PRED_SQL}) WHERE {cond}"
        for name, cond in ENSEMBLES_SQL.items()) + ")"


# --------------------------------------------------------------------- DOCS

def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    pos = F.instr(F.col("text"), "\n")
    return d.select(
        "doc_id",
        F.when(pos > 0, F.expr("substring(text, 1, instr(text, '\\n') - 1)")).otherwise(F.col("text")).alias("title"),
        F.when(pos > 0, F.expr("substring(text, instr(text, '\\n') + 1)")).alias("abstract"),
        F.col("lang").alias("language"), F.col("source").alias("text_type"))


DOCS_SQL = """
SELECT doc_id,
       CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, 1, strpos(text, chr(10)) - 1) ELSE text END AS title,
       CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, strpos(text, chr(10)) + 1) END AS abstract,
       lang AS language, source AS text_type
FROM documents
"""


# --------------------------------------------------------------------- RESP

def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where(F.col("role") == "assistant")
    return c.select(F.lit("assistant").alias("model"), F.col("turn").cast("string").alias("prompt"),
                    F.col("conv_id").alias("doc_id"), F.col("text").alias("answer"))


RESP_SQL = """
SELECT 'assistant' AS model, CAST(turn AS VARCHAR) AS prompt, conv_id AS doc_id, text AS answer
FROM conversations WHERE role = 'assistant'
"""


# -------------------------------------------------------- relevance answers

def rank_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions to rank: (doc, label, term); several labels may share a term."""
    li = line_items(spark, sf_dir)
    return li.select(F.col("l_orderkey").alias("doc_id"), gnd_id(F.col("l_partkey")).alias("label_id"),
                     F.concat(F.lit("kw"), F.col("l_suppkey").cast("string")).alias("term"),
                     relevance_answer_expr().alias("answer"))


def relevance_answer_expr():
    q = (F.col("l_quantity").cast("bigint") % 11).cast("string")
    return (F.when(F.col("l_discount") == 0, F.lit("keine"))
            .otherwise(F.concat(q, F.when(F.col("l_tax") >= 0.06, F.lit("/10")).otherwise(F.lit("")))))


RANK_INPUT_SQL = """
SELECT l_orderkey AS doc_id, 'gnd:' || CAST(l_partkey AS VARCHAR) AS label_id,
       'kw' || CAST(l_suppkey AS VARCHAR) AS term,
       CASE WHEN l_discount = 0 THEN 'keine'
            ELSE CAST(CAST(l_quantity AS BIGINT) % 11 AS VARCHAR) || CASE WHEN l_tax >= 0.06 THEN '/10' ELSE '' END
       END AS answer
FROM lineitem
"""


def relevance_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One model answer per (doc, distinct term), as the rank stage asks once
    per term: the greatest answer text of the term's rows (deterministic)."""
    r = rank_input(spark, sf_dir)
    return r.groupBy("doc_id", "term").agg(F.max("answer").alias("answer"))


ANSWERS_SQL = f"""
SELECT doc_id, term, max(answer) AS answer FROM ({RANK_INPUT_SQL}) GROUP BY doc_id, term
"""


# ---------------------------------------------------------------------- VEC

def vec_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.where(F.col("label") == 0).select(F.col("vec_id").alias("query_id"), "embedding")


def vec_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.where(F.col("label") != 0).select(F.col("vec_id").cast("string").alias("label_id"),
                                               F.concat(F.lit("label"), F.col("vec_id").cast("string")).alias("label_text"),
                                               "embedding")


VEC_Q_SQL = "SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings WHERE label = 0"
VEC_V_SQL = ("SELECT CAST(vec_id AS VARCHAR) AS label_id, 'label' || CAST(vec_id AS VARCHAR) AS label_text, "
             "CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings WHERE label <> 0")


# ---------------------------------------------------------- text retrieval

def text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def text_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("label_id"), F.col("text").alias("label_text"))


def hybrid_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings paired with the document of the same id (vector + text)."""
    e = table(spark, sf_dir, "embeddings")
    d = table(spark, sf_dir, "documents")
    return e.join(d, e.vec_id == d.doc_id, "inner").select(
        F.col("vec_id").alias("item_id"), "label", "embedding", "text")


# ------------------------------------------------------------------ TRIPLES

PREF_LABEL = "http://www.w3.org/2004/02/skos/core#prefLabel"
ALT_LABEL = "http://www.w3.org/2004/02/skos/core#altLabel"


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    s = F.concat(F.lit("https://example.org/gnd/"), F.col("p_partkey").cast("string"))
    pref = p.select(s.alias("s"), F.lit(PREF_LABEL).alias("p"), F.col("p_name").alias("o"))
    alt = p.select(s.alias("s"), F.lit(ALT_LABEL).alias("p"), F.col("p_type").alias("o"))
    return pref.unionByName(alt)


TRIPLES_SQL = f"""
SELECT 'https://example.org/gnd/' || CAST(p_partkey AS VARCHAR) AS s, '{PREF_LABEL}' AS p, p_name AS o FROM part
UNION ALL
SELECT 'https://example.org/gnd/' || CAST(p_partkey AS VARCHAR) AS s, '{ALT_LABEL}' AS p, p_type AS o FROM part
"""


# ------------------------------------------------------------------ RECORDS

def records_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON-LD records (one string each) built from documents and labels.

    Even ids carry a string title, odd ids an array title; a document's
    subjects are its quality / toxic flags as gnd nodes; the gnd nodes are
    placed before the document node on even ids and after it on odd ids.
    """
    d = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels")
    x = d.join(lab, "doc_id", "left")
    q_id = F.concat(F.lit("gnd:q"), F.coalesce(F.col("quality").cast("string"), F.lit("na")))
    t_id = F.concat(F.lit("gnd:t"), F.coalesce(F.col("toxic").cast("string"), F.lit("na")))
    pos = F.instr(F.col("text"), "\n")
    title = F.when(pos > 0, F.expr("substring(text, 1, instr(text, '\\n') - 1)")).otherwise(F.col("text"))
    abstract = F.when(pos > 0, F.expr("substring(text, instr(text, '\\n') + 1)")).otherwise(F.lit(""))
    even = (F.col("doc_id") % 2) == 0
    gnd_nodes = F.array(
        F.to_json(F.struct(q_id.alias("@id"), F.concat(F.lit("quality "), F.col("source")).alias("sameAs"))),
        F.to_json(F.struct(t_id.alias("@id"), F.concat(F.lit("toxic "), F.col("lang")).alias("sameAs"))))
    doc_iri = F.concat(F.lit("https://www.tib.eu/de/suchen/id/TIBKAT%"), F.col("doc_id").cast("string"))
    subjects = F.array(F.struct(q_id.alias("@id")), F.struct(t_id.alias("@id")))

    def node(title_value):
        return F.to_json(F.struct(doc_iri.alias("@id"), title_value.alias("title"),
                                  abstract.alias("abstract"), subjects.alias("dcterms:subject")))

    doc_node = F.when(even, node(title)).otherwise(node(F.array(title, F.lit("(cont.)"))))
    graph = F.when(even, F.concat(gnd_nodes, F.array(doc_node))).otherwise(F.concat(F.array(doc_node), gnd_nodes))
    rec = F.concat(F.lit('{"@graph":['), F.array_join(graph, ","), F.lit("]}"))
    return x.select("doc_id", F.col("lang").alias("language"), F.col("source").alias("text_type"),
                    rec.alias("json"))


# ----------------------------------------------------------------- EXAMPLES

def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few-shot examples: each user turn with the assistant turn after it;
    prompt = the conversation, ord = the turn."""
    c = table(spark, sf_dir, "conversations")
    u = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("text"))
    a = c.where(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"),
                                                     F.col("text").alias("keywords"))
    return u.join(a, ["conv_id", "turn"], "inner").select(
        F.concat(F.lit("conv"), F.col("conv_id").cast("string")).alias("prompt"),
        F.col("turn").cast("int").alias("ord"), "text", "keywords")


EXAMPLES_SQL = """
SELECT 'conv' || CAST(u.conv_id AS VARCHAR) AS prompt, CAST(u.turn AS INTEGER) AS ord, u.text AS text,
       a.text AS keywords
FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user' AND a.role = 'assistant'
"""
