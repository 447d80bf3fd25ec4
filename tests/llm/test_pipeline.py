"""The five stages in a row on planted documents, and the registered queries on the smallest tables."""

import os
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from preflens.llm import queries

SF = "/root/testdata/sf0.001"


def planted():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    docs, labels, kind = [], [], {}

    def add(body, what, label=None):
        i = len(docs)
        docs.append((i, body, "en", f"src{i % 3}", len(body)))
        kind[i] = what
        if label is not None:
            labels.append((i, label, 0))
        return i

    passage = text(60)
    for k in range(300):
        add(text(rng.randint(30, 90)), "clean", 1 if k % 2 else None)
    for k in range(80):
        add(" ".join(w + rng.choice(["$$$", "###"]) for w in text(40).split()), "junk", 0 if k % 2 else None)
    for k in range(30):
        add((text(1).upper() + "!! ") * 40, "junk", 0)
    base = [text(80) for _ in range(5)]
    for b in base:
        add(b, "first")
        for other in (b, b + " " + word(), word() + " " + b):
            add(other, "copy")
    first = add(text(40) + " " + passage + " " + text(40), "holder")
    later = [add(text(50) + "\n" + passage + "\n" + text(50), "repeat") for _ in range(6)]
    add("too short", "short")
    add("", "short")
    docs.append((10_000, None, None, None, None))
    return docs, labels, kind, passage, first, later


def test_stages(spark, tmp_path):
    docs, labels, kind, passage, first, later = planted()
    sf = f"file://{tmp_path}"
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    table = spark.read.parquet(f"{sf}/documents.parquet")
    columns, after = table.columns, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, table, sf).write.parquet(f"{sf}/out{i}")
        table = spark.read.parquet(f"{sf}/out{i}")
        if i < 4:
            assert table.columns == columns
            after.append({r["doc_id"]: r["text"] for r in table.collect()})
    ids = [set(x) for x in after]
    assert ids[0] >= ids[1] >= ids[2] == ids[3]
    assert not any(kind.get(i, "short") in ("junk", "short") for i in ids[1])
    good = {i for i, k in kind.items() if k not in ("junk", "short")}
    assert ids[1] == good and ids[2] == {i for i in good if kind[i] != "copy"}
    assert passage in after[3][first] and all(passage not in after[3][i] and len(after[3][i]) < len(after[2][i]) for i in later)
    assert all(after[3][i] == after[2][i] for i in ids[3] if kind[i] in ("clean", "first", "holder"))
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = sum(len(library.encode(t, add_special_tokens=False).ids) + 1 for t in after[3].values())
    pieces = table.collect()
    assert {r["doc_id"] for r in pieces} == ids[3] and sum(r["length"] for r in pieces) == tokens
    assert len({r["sequence_id"] for r in pieces}) <= 1.1 * tokens / 2048 + 1
    rows = corpus_pipeline.run(spark, sf).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, pieces))


def test_registered():
    names = __spark_entry__.queries()
    assert set(queries.QUERIES) <= set(names) and "pipeline" in names
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13


@pytest.mark.skipif(not os.environ.get("ALL_QUERIES") or not os.path.exists(SF), reason="slow; ALL_QUERIES=1 runs it")
@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query_runs(spark, name):
    if name.startswith("op12"):
        queries.QUERIES[name](spark, SF).collect()
        return
    rows = queries.QUERIES[name](spark, SF).count()
    assert rows >= spark.read.parquet(f"{SF}/{'pages' if name.startswith(('op9', 'op13')) else 'documents'}.parquet").count()
