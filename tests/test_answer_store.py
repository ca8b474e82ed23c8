"""The answer store by documents: prompts of more runs are neither written nor moved."""

import os
import random
import uuid


def _written(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(folder) for f in files)


def _fresh_folder(spark, tmp_path, name):
    from subjex.session import ensure_checkpoint_dir
    old = ensure_checkpoint_dir(spark)
    spark.sparkContext.setCheckpointDir(str(tmp_path / name))
    return old, spark.sparkContext.getCheckpointDir().removeprefix("file:")


def test_more_runs_write_no_more_texts(spark, tmp_path):
    from subjex.plans.pipelines import complete_runs
    rng = random.Random(5)
    docs = [(i, f"title {i % 50}", " ".join(f"{rng.getrandbits(64):x}" for _ in range(400 if i < 50 else 5)) if i != 7 else None) for i in range(100)]
    docs += [(200, *docs[3][1:]), (3, *docs[4][1:])]  # a copy, and an id given twice
    d = spark.createDataFrame(docs, "doc_id long, title string, abstract string")
    texts, sizes, log = sum(len(t) + len(a or "") for _, t, a in docs), {}, tmp_path / "log"
    os.makedirs(log)

    def model(prompts):
        with open(f"{log}/{uuid.uuid4().hex}", "w") as f:
            f.write("".join(p.replace("\n", " ") + "\n" for p in prompts))
        return [p.split("|")[1] for p in prompts]
    for runs in (1, 8):
        # run 1 asks what run 0 asks
        frames = spark.createDataFrame([("m", f"p{i}", f"frame {max(i, 1)}|{{text}}|") for i in range(runs)], "model string, prompt string, frame string")
        old, folder = _fresh_folder(spark, tmp_path, f"c{runs}")
        try:
            store = str(tmp_path / f"store{runs}")
            got = sorted(tuple(r) for r in complete_runs(d, frames, store, model, max_total=250, max_new=10, parts=3).collect())
        finally:
            spark.sparkContext.setCheckpointDir(old)
        sizes[runs] = _written(folder)
        cut = lambda t: " ".join(t.split()[:240 - 2])  # noqa: E731  two words of the frame
        assert got == sorted(("m", f"p{i}", k, cut(f"{t} {a}")) for i in range(runs) for k, t, a in docs if a is not None)
        asked = sorted(line for f in os.listdir(log) for line in open(f"{log}/{f}"))
        assert len(asked) == len(set(asked))  # copies, equal frames and the second call ask nothing twice
        for f in os.listdir(log):
            os.unlink(f"{log}/{f}")
    assert sizes[8] - sizes[1] < 2 * texts  # seven more runs; their prompts alone are about five times the texts
