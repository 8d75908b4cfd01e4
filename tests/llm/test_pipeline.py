"""The pipeline's stages and their invariants on a small folder of tables, against brute force where a stage is exact."""

import random
import re
import struct

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import catalog
from ledgerloom.llm import common as C


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice(["ba", "ko", "ti", "re", "no"]) for _ in range(rnd.randint(1, 3)))
    line = lambda n: " ".join(word() for _ in range(n))
    item = line(12)
    rows, bad = [], []
    for i in range(160):
        if i % 4 == 3:
            bad.append(i)
            rows.append((i, " ".join(rnd.choice(["BUY!!", "###", "NOW!!", "$$$"]) for _ in range(80))))
        else:
            rows.append((i, line(80) + "."))
    rows.append((200, rows[0][1]))
    rows.append((201, rows[1][1].rsplit(" ", 1)[0] + " changed"))
    rows.append((202, line(60) + " " + item + " " + line(60)))
    rows.append((203, line(70) + " mail jo.doe@corp.example.org now " + line(20)))
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i not in bad), 0) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), dict(rows), set(bad), item


def test_stages(spark, folder):
    d, texts, bad, item = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = C.Scratch(spark, "test").keep(stage(spark, docs, d))
        kept[name] = {r.doc_id: r for r in docs.collect()}
        if name != "BPE encoding":
            assert docs.columns == columns
    first, second, third, fourth, last = (kept[n] for n, _ in corpus_pipeline.STAGES)
    assert set(first) == set(texts) - bad
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, re.findall(r"\S+", r.text.lower())) for i, r in first.items())}
    near = {j for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert set(second) == set(first) - near and near == {200, 201}
    assert item not in third[202].text and len(third[202].text.split()) == 120 and third[203].text == texts[203]
    assert "jo.doe" not in fourth[203].text and all(fourth[i].text == third[i].text for i in third if i != 203)
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(catalog.vocabulary())
    for i, r in last.items():
        ids = whole.encode(fourth[i].text, add_special_tokens=False).ids
        assert bytes(r.ids) == struct.pack(f"<{len(ids)}I", *ids) and r.n_tokens == len(ids)


def test_run_is_the_stages(spark, folder):
    assert corpus_pipeline.run(spark, folder[0]).count() == len(folder[1]) - len(folder[2]) - 2


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    for name, query in catalog.queries().items():
        assert query(spark, str(tmp_path)).count() == (1 if name.startswith("op9_") else 0), name


def test_odd_rows_pass_through(spark, folder, tmp_path):
    """Null and empty texts, null and repeated ids, a very long text, and columns with the operators' own names."""
    d, texts, *_ = folder
    long = " ".join(f"w{i}" for i in range(20_000)) + " " + "".join(chr(97 + i % 26) for i in range(50_000))
    rows = [(1, texts[0]), (1, texts[0]), (None, texts[1]), (3, None), (4, ""), (5, long), (6, "to ann@corp.example.org, " + texts[2])]
    schema = "doc_id long, text string, lang string, source string, n_chars long, gone int, may_go boolean, found string, hits array<int>, n_words int, entities string, _w string, _e string"
    docs = spark.createDataFrame([(i, t, "en", "s", 0, 7, True, "f", [9], 77, "e", "w", "x") for i, t in rows], schema)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[1:4]:
        docs = C.Scratch(spark, "test").keep(stage(spark, docs, d))
        assert docs.columns == columns, name
    got = docs.collect()
    assert sorted((r.doc_id or 0) for r in got) == [0, 1, 1, 3, 4, 5, 6]
    assert all((r.gone, r.may_go, r.found, r.hits, r.n_words, r.entities, r["_w"], r["_e"]) == (7, True, "f", [9], 77, "e", "w", "x") for r in got)
    kept = {r.doc_id: r.text for r in got}
    assert kept[3] is None and kept[4] == "" and kept[5] == long and "ann@corp" not in kept[6] and kept[6].endswith(texts[2])
    first = corpus_pipeline.reject_poor(spark, docs, d)
    assert first.columns == columns
    last = corpus_pipeline.encode(spark, docs, d)
    assert last.count() == 7 and last.columns == ["doc_id", "lang", "source", "n_tokens", "ids"]
