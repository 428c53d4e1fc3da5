"""The pipeline on a small table with planted cases."""

import random

import corpus_pipeline
import __spark_entry__


def test_stages(spark, tmp_path):
    draw = random.Random(9)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(6))
    rows, labels = [], []
    for i in range(200):
        words = [word() for _ in range(60)]
        if i % 4 == 1:
            words[5] = words[30] = "zugbuk"
        rows.append((i, " ".join(words) + "\n" + "a line that comes again in many documents of the table", "en", f"s{i % 3}", 0))
        labels.append((i, 1, int(i % 4 == 1)))
    near = rows[2][1].split()          # its second line is a repeat and goes
    near[20] = "changed"
    rows += [(1000, " ".join(near[:60]), "en", "s0", 0), (1001, None, None, None, None), (1002, "", "en", "s1", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out, seen = docs, []
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, out, str(tmp_path))
        result.write.parquet(f"{tmp_path}/{len(seen)}")
        out = spark.read.parquet(f"{tmp_path}/{len(seen)}")
        seen.append(out)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
    ids = [{r["doc_id"] for r in x.collect()} for x in seen]
    assert not {i for i in ids[0] if i is not None and i < 200 and i % 4 == 1}
    assert {i for i in range(200) if i % 4 != 1} <= ids[0]
    assert ids[1] == ids[0]
    again = [r for r in seen[1].collect() if "a line that comes again" in (r["text"] or "")]
    assert len(again) == 1
    # one word of 60 differs: the line goes as a fuzzy repeat, or the document as a near copy
    assert 2 in ids[2] and not [r for r in seen[2].collect() if r["doc_id"] == 1000 and r["text"]]
    assert all(r["n_tokens"] == len(r["ids"]) for r in seen[4].collect())


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
