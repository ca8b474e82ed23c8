"""CSV, Turtle and record folders read by many tasks: against one reader over the whole file."""

import csv
import json
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from subjex.sources import split_lines as L
from subjex.sources import turtle as T

SCHEMA = "id string, x string, y string"


@pytest.fixture
def small_splits(spark):
    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield use
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def _write_csv(path, rows, end, rng, header=("id", "x", "y")):
    with open(path, "w", newline="", encoding="utf-8") as f:
        csv.writer(f, lineterminator=end).writerow(header)
        for r in rows:  # quoting as needed, or everywhere
            csv.writer(f, lineterminator=end, quoting=rng.choice([csv.QUOTE_MINIMAL, csv.QUOTE_ALL])).writerow(r)
            if rng.random() < 0.02:
                f.write(end)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_one_csv_file_read_by_many_tasks(spark, small_splits, end):
    rng = random.Random(3)
    value = lambda: "".join(rng.choice(["a", "b", ",", '"', "\n", "\r\n", " ", "é", "NA", "null", "'", "\\"]) for _ in range(rng.randint(0, 12)))
    rows = [(str(i), value(), value()) for i in range(1500)] + [("long", "line\n" * 4000, '"' * 999)]
    path = os.path.join(tempfile.mkdtemp(prefix="subjex-csv-"), "t.csv")
    _write_csv(path, rows, end, rng)
    with open(path, newline="", encoding="utf-8") as f:
        alone = sorted((r[0], r[1] or None, r[2] or None) for r in list(csv.reader(f))[1:] if r)
    assert alone == sorted((a, b or None, c or None) for a, b, c in rows)
    for size, least in ((700, 50), (1 << 27, 1)):
        small_splits(size)
        found = L.csv_records(spark, path, SCHEMA)
        assert L.read_lines(spark, path).rdd.getNumPartitions() >= least
        assert sorted(((r.id, r.x, r.y) for r in found.collect())) == alone
        order = [r.id for r in found.orderBy("start", "line").collect()]
        assert order == [r[0] for r in rows]


def test_unfinished_empty_and_headless_files(spark, small_splits):
    root = tempfile.mkdtemp(prefix="subjex-csv-")
    write = lambda name, text: open(os.path.join(root, name), "w", newline="").write(text)
    for name, text in (("a.csv", "id,x,y\n1,a,b"), ("b.csv", ""), ("c.csv", "id,x,y\n"), ("d.csv", 'id,x,y\n2,"a\nb",c\n\n3,"",\n'), ("e.csv", '"id\n",x,y\n4,e,f\n')):
        write(name, text)
    small_splits(5)
    got = sorted((r.id, r.x, r.y) for r in L.csv_records(spark, root, SCHEMA).collect())
    assert got == [("1", "a", "b"), ("2", "a\nb", "c"), ("3", None, None), ("4", "e", "f")]
    assert L.csv_records(spark, os.path.join(root, "a.csv"), SCHEMA, header=False).count() == 2


def test_member_tables_without_the_roots(spark):
    from subjex.sources.tables import read_csv, read_member_tables
    root = tempfile.mkdtemp(prefix="subjex-results-")
    for folder, name in (("m1/p1", "predictions.csv"), ("m1/01", "predictions.csv"), ("m2/p1", "ranked_predictions.csv"), ("", "predictions.csv"), ("", "ranked_predictions.csv"), ("m2/p2", "other.csv")):
        os.makedirs(os.path.join(root, folder), exist_ok=True)
        with open(os.path.join(root, folder, name), "w") as f:
            f.write('id,x,y\n1,"two\nlines",NA\n')
    got = {(r.model, r.prompt, r.x, r.y) for r in read_member_tables(spark, root, "*predictions.csv", SCHEMA).collect()}
    assert got == {("m1", "p1", "two\nlines", "NA"), ("m1", "01", "two\nlines", "NA"), ("m2", "p1", "two\nlines", "NA")}
    assert read_csv(spark, os.path.join(root, "m1/p1"), SCHEMA).columns == ["id", "x", "y"]


def test_only_wanted_record_folders_are_opened(spark):
    from subjex.sources.records import planned_folders, scan_records
    root = tempfile.mkdtemp(prefix="subjex-rec-")
    for subjects, split, kind, language in (("tib-core-subjects", "dev", "Book", "de"), ("tib-core-subjects", "dev", "Book", "en"), ("tib-core-subjects", "train", "Book", "de"), ("all-subjects", "dev", "Thesis", "de")):
        d = os.path.join(root, subjects, "data", split, kind, language)
        os.makedirs(d)
        for k in range(3):
            with open(os.path.join(d, f"r{k}.jsonld"), "w") as f:
                json.dump({"@graph": [{"@id": f"https://www.tib.eu/de/suchen/id/TIBKAT%{language}{k}", "title": "T", "abstract": "A", "dcterms:subject": []}]}, f)
    args = (["tib-core-subjects"], ["dev", "test"], ["Book", "Thesis"], ["de"])
    assert planned_folders(spark, root, *args) == [f"{root}/tib-core-subjects/data/dev/Book/de"]
    df = scan_records(spark, root, *args)
    assert len(df.inputFiles()) == 3 and all("/dev/Book/de/" in f for f in df.inputFiles())
    assert {(r.subjects, r.split, r.text_type, r.language, r.doc_id) for r in df.collect()} == {("tib-core-subjects", "dev", "Book", "de", f"de{k}") for k in range(3)}
    assert scan_records(spark, root, ["all-subjects"], ["test"], ["Book"], ["en"]).count() == 0
    with pytest.raises(ValueError):
        scan_records(spark, root, ["all-subjects"], ["tests"], ["Book"], ["en"])


TURTLE = '''@prefix skos: <http://www.w3.org/2004/02/skos/core#> .
PREFIX g: <https://d-nb.info/gnd/>
@base <https://example.org/> . # a comment with a "quote and a dot.
g:4-1 a skos:Concept ; skos:prefLabel "Caf\\u00e9"@de, 'single "one"' ;
   skos:altLabel """long
text. with dots.
and "quotes" .
""" ; ; skos:note [ skos:value 1.5 ; skos:x ( "a" <rel> 7 ) ] .
g:4-2.b skos:prefLabel "x . y ; z #no comment" . g:4-3 skos:prefLabel "same line"^^<http://x/y>.

# between
<4-4> skos:prefLabel \'\'\'it's \'quoted\' \\\\ \'\'\' .
_:b skos:altLabel "blank" .
[] skos:altLabel "nobody" .
@prefix g: <https://other.org/> .
g:9 skos:altLabel true .
'''
SKOS = "http://www.w3.org/2004/02/skos/core#"


def test_turtle_syntax_in_any_split(spark, small_splits):
    path = os.path.join(tempfile.mkdtemp(prefix="subjex-ttl-"), "v.ttl")
    with open(path, "w", encoding="utf-8") as f:
        f.write(TURTLE)
    for size in (1 << 27, 200, 31, 7):
        small_splits(size)
        rows = T.scan_turtle(spark, path).collect()
        labels = sorted((r.s, r.p.split("#")[1], r.o) for r in rows if r.p.startswith(SKOS) and r.p.endswith("Label") and not r.s.startswith("_:"))
        d = "https://d-nb.info/gnd/"
        assert labels == sorted([(d + "4-1", "prefLabel", "Café"), (d + "4-1", "prefLabel", 'single "one"'), (d + "4-1", "altLabel", 'long\ntext. with dots.\nand "quotes" .\n'),
                                 (d + "4-2.b", "prefLabel", "x . y ; z #no comment"), (d + "4-3", "prefLabel", "same line"), ("https://example.org/4-4", "prefLabel", "it's 'quoted' \\ "),
                                 ("https://other.org/9", "altLabel", "true")])
        assert {r.o for r in rows if r.s.startswith("_:") and r.p == SKOS + "altLabel"} == {"blank", "nobody"}
        listed = [r.o for r in rows if r.p == T.RDF + "first"]
        assert sorted(listed) == ["7", "a", "https://example.org/rel"] and sum(r.p == T.RDF + "rest" for r in rows) == 3
        assert [r.o for r in rows if r.p == T.RDF + "type"] == [SKOS + "Concept"]
    with open(path, "a") as f:
        f.write("undeclared:x skos:prefLabel 1 .\n")
    with pytest.raises(Exception, match="not declared"):
        T.scan_turtle(spark, path).collect()


def test_turtle_and_ntriples_give_one_vocabulary(spark, small_splits):
    from subjex.sources.vocab import ALT_LABEL, PREF_LABEL, scan_ntriples, vocab_labels
    rng = random.Random(7)
    root = tempfile.mkdtemp(prefix="subjex-voc-")
    chars = ["a", "é", '"', "'", ".", ";", "\n", "\\", " ", "#", "<", ">", "日"]
    with open(f"{root}/v.nt", "w", encoding="utf-8") as nt, open(f"{root}/v.ttl", "w", encoding="utf-8") as ttl:
        ttl.write(f"@prefix : <https://d-nb.info/gnd/> .\n@prefix s: <{SKOS}> .\n")
        for i in range(400):
            texts = ["".join(rng.choice(chars) for _ in range(rng.randint(1, 14))) for _ in range(rng.randint(1, 4))]
            plain = lambda t: t.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n")
            for k, t in enumerate(texts):
                nt.write(f'<https://d-nb.info/gnd/{i}> <{ALT_LABEL if k else PREF_LABEL}> "{plain(t)}"@de .\n')
            long = lambda t: '"""' + t.replace("\\", "\\\\").replace('"', '\\"') + '"""'
            forms = [f"s:{'altLabel' if k else 'prefLabel'} {long(t) if rng.random() < .6 else chr(34) + plain(t) + chr(34)}" for k, t in enumerate(texts)]
            ttl.write(f":{i} " + rng.choice([" ;\n  ", "; "]).join(forms) + rng.choice([" .\n", ".\n", " ;\n.\n", " . "] if i % 7 == 0 else [" .\n"]))
    small_splits(1000)
    want = sorted(map(tuple, vocab_labels(scan_ntriples(spark, f"{root}/v.nt")).collect()))
    assert sorted(map(tuple, vocab_labels(T.scan_turtle(spark, f"{root}/v.ttl")).collect())) == want
    assert sorted(map(tuple, vocab_labels(T.scan_turtle(spark, f"{root}/v.nt")).collect())) == want
