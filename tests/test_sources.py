"""Sources: records, prompt files, vocabulary lines, CSV lists."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from subjex.sources.records import extract_records, scan_records


def _rec(spark, graph):
    return spark.createDataFrame([(json.dumps({"@graph": graph}),)], "json string")


DOC = "https://www.tib.eu/de/suchen/id/TIBKAT%3A123"


def test_node_order_and_strict_flag(spark):
    g = [{"@id": DOC, "title": ["A", "B"], "abstract": "x", "dcterms:subject": {"@id": "gnd:1"}},
         {"@id": "gnd:1", "sameAs": "Term"}]
    loose = extract_records(_rec(spark, g)).first()
    assert loose.doc_id == "3A123" and loose.title == "A B" and loose.labels == ["Term"]
    strict = extract_records(_rec(spark, g), strict_order=True).first()
    assert strict.labels == []


def test_missing_key_drops_rest_of_node(spark):
    g = [{"@id": "gnd:1", "sameAs": "Term"}, {"@id": DOC, "title": "T", "dcterms:subject": [{"@id": "gnd:1"}]}]
    r = extract_records(_rec(spark, g)).first()
    assert r.title == "T" and r.abstract is None and r["dcterms:subject"] is None and r.labels == []


def test_record_without_graph_yields_nothing(spark):
    df = spark.createDataFrame([('{"other": 1}',)], "json string")
    assert extract_records(df).count() == 0


def test_scan_records_dimensions_from_path(spark):
    root = tempfile.mkdtemp(prefix="subjex-rec-")
    d = os.path.join(root, "tib-core-subjects", "data", "dev", "Book", "de")
    os.makedirs(d)
    with open(os.path.join(d, "a.json"), "w") as f:
        json.dump({"@graph": [{"@id": DOC, "title": "T", "abstract": "A", "dcterms:subject": []}]}, f)
    df = scan_records(spark, root, ["tib-core-subjects"], ["dev", "test"], ["Book"], ["de", "en"])
    r = df.first()
    assert (r.subjects, r.split, r.text_type, r.language, r.doc_id) == ("tib-core-subjects", "dev", "Book", "de", "3A123")


def test_prompt_file_parser(spark):
    from subjex.sources.prompts import scan_prompt_files
    root = tempfile.mkdtemp(prefix="subjex-pr-")
    with open(os.path.join(root, "p1.txt"), "w", encoding="utf-8") as f:
        f.write("Extrahiere Schlagwörter\nIDN: 1\nText: first  \nSchlagwörter: a, b\n###\n"
                "Schlagwörter: orphan\nText: x\nText: second\nSchlagwörter:  c \n")
    rows = scan_prompt_files(spark, root).orderBy("ord").collect()
    assert [(r.prompt, r.ord, r.text, r.keywords) for r in rows] == [
        ("p1", 1, "first", "a, b"), ("p1", 2, "", "orphan"), ("p1", 3, "second", "c")]


def test_ntriples_and_vocab_labels(spark):
    from subjex.sources.vocab import ALT_LABEL, PREF_LABEL, scan_ntriples, vocab_labels
    root = tempfile.mkdtemp(prefix="subjex-nt-")
    p = os.path.join(root, "v.nt")
    with open(p, "w", encoding="utf-8") as f:
        f.write(f'<https://d-nb.info/gnd/4-1> <{PREF_LABEL}> "Café"@de .\n')
        f.write(f'<https://d-nb.info/gnd/4-1> <{ALT_LABEL}> "Kaffee \\"Haus\\""@de .\n')
        f.write('# comment\n')
    t = scan_ntriples(spark, p)
    rows = sorted(vocab_labels(t).collect())
    assert rows[0].label_id == "4-1"
    texts = {r.label_text: r.is_prefLabel for r in rows}
    assert texts == {"Café": True, 'Kaffee "Haus"': False}
    assert vocab_labels(t, use_alt=False).count() == 1


def test_stringified_list(spark):
    from subjex.sources.tables import stringified_list
    df = spark.createDataFrame([("['gnd:1', \"it's\"]",), ("[]",)], "s string")
    got = [r.a for r in df.select(stringified_list(F.col("s")).alias("a")).collect()]
    assert got == [["gnd:1", "it's"], []]


def test_render_frames_template(spark):
    from subjex.operators.prompts import CHATML, render_examples
    ex = spark.createDataFrame([("p", 2, "t2", "k2"), ("p", 1, "t1", "k1")],
                               "prompt string, ord int, text string, keywords string")
    f = render_examples(ex, CHATML).first().frame
    assert f.index("t1") < f.index("t2") and f.endswith("<|im_start|>assistant\n") and "system" not in f
