"""The pipeline on a small corpus, each stage against a plain version of itself."""

import collections
import random

import numpy as np
import pytest

import corpus_pipeline
from rankspark.llm.queries_text import tokenizer_path
from rankspark.session import new_folder
from tests.llm import brute
from tests.llm.test_operators_llm import sentence

LINE = "this licence line of more than forty characters is repeated"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    rows, labels = [], []
    for k in range(150):
        w = sentence(rng, rng.randint(20, 120)).split()
        bad = k % 5 == 0
        if bad:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["horrid", "horridly", "vileness"]))
        text = " ".join(w) + ("\n" + LINE + "\n" + " ".join(w[:5]) if k % 7 == 0 else "")
        rows.append((k, text, "en", rng.choice(["a", "b", "c", None, "hot", "hot"]), len(text)))
        labels.append((k, 1, int(bad)))
        if k % 10 == 1:  # a near copy
            w[3] = "changed"
            rows.append((1000 + k, " ".join(w), "en", "a", None))
    rows += [(5000, None, None, "a", None), (5001, "", "en", "b", 0)]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_every_stage(spark, folder):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = new_folder(spark, "stage")
        stage(spark, docs, folder).write.parquet(out)
        after = spark.read.parquet(out)
        seen.append((name, docs.collect(), after.collect()))
        assert name == "packing" or after.columns == columns
        docs = after
    steps = {name: ([r.asDict() for r in a], [r.asDict() for r in b]) for name, a, b in seen}

    before, after = steps["toxicity"]
    toxic = lambda t: any(w in (t or "") for w in ("horrid", "vileness"))
    kept = {r["doc_id"] for r in after}
    right = [(r["doc_id"] in kept) != toxic(r["text"]) for r in before]
    assert np.mean(right) > 0.95 and {5000, 5001} <= kept

    before, after = steps["line dedup"]
    want = brute.line_dedup([(r["doc_id"], r["text"]) for r in before])
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in after} == {i: (x[2], len(x[2])) for i, x in want.items()}
    assert sum(x[1] for x in want.values()) > 5

    before, after = steps["near dedup"]
    want = brute.components([(r["doc_id"], r["text"]) for r in before])
    assert sorted(r["doc_id"] for r in after) == sorted(i for i, c in want.items() if i == c)
    assert len(after) < len(before)

    before, after = steps["mixing"]
    times = collections.Counter(r["doc_id"] for r in after)
    sizes, taken = collections.Counter(), collections.Counter()
    for r in before:
        n = len(brute.words(r["text"]))
        sizes[r["source"]] += n
        taken[r["source"]] += n * times[r["doc_id"]]
    for source, target in brute.targets(sizes).items():
        assert abs(taken[source] - target) <= 0.02 * target + 20
    assert max(times.values()) == 2

    before, after = steps["packing"]
    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = collections.Counter(x for r in before for x in tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [2])
    assert collections.Counter(x for r in after for x in r["ids"]) == want
    by_sequence = collections.defaultdict(list)
    for r in after:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096

    again = corpus_pipeline.run(spark, folder)
    assert collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in again.collect()) == collections.Counter(
        (r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in after
    )
