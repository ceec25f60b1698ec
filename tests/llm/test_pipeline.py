"""The pipeline against its parts on a small corpus, and the queries' SQL."""

import os
import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from voxelweave.llm import common, line_dedup, ngram_join, packing, pii, queries, toxicity

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the shared tables aren't here")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, SF).toPandas()
        assert list(out.columns) == columns, name
        before = kept.toPandas().set_index("doc_id")
        assert set(out.doc_id) <= set(before.index)
        if name == "toxicity":
            bad = {r.doc_id for r in toxicity.toxicity(kept, spark.read.parquet(f"{SF}/labels.parquet")).filter("predicted = 1").collect()}
            assert set(before.index) - set(out.doc_id) == bad
        elif name == "line dedup":
            assert dict(zip(out.doc_id, out.text, strict=True)) == {r.doc_id: r.text for r in line_dedup.line_dedup(kept).collect()}
        elif name == "n-gram Jaccard join":
            groups = ngram_join.jaccard_groups(kept, 5, 80).toPandas()
            assert set(out.doc_id) == set(groups.component_id) and len(out) == groups.component_id.nunique()
        else:
            for d, text in zip(out.doc_id, out.text, strict=True):
                b, x = pii.spans_of_texts([before.text[d]], pii.trained())[0]
                assert text == pii.masked(before.text[d], b + x)
        assert (out.n_chars == out.text.str.len()).all()
        kept = spark.createDataFrame(out, docs.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, SF).toPandas()
    alone = packing.token_pieces(kept, queries.vocabulary()).toPandas()
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, packed[key].to_numpy().tolist())) == sorted(map(tuple, alone[key].to_numpy().tolist()))
    whole = corpus_pipeline.run(spark, SF).toPandas()
    assert sorted(map(tuple, whole[key].to_numpy().tolist())) == sorted(map(tuple, packed[key].to_numpy().tolist()))


def test_rows_without_ids_repeated_and_empty(spark, tmp_path):
    """Each stage's rows against what its docstring says of odd rows."""
    r = random.Random(4)
    say = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8))) for _ in range(n))
    bad = lambda: say(20) + " idiotic scumbag " + say(20) + " worthless idiotic moron"
    taught = [(k, bad() if k % 5 == 0 else say(40), int(k % 5 == 0)) for k in range(100, 500)]
    one, near = say(200), say(200)
    insult = bad()
    shared = say(12)
    odd = [
        (1, one), (1, one), (1, say(60)), (2, one + " more"), (None, one), (None, one), (3, None), (3, None), (4, ""), (5, insult), (5, near), (6, near + " x"),
        (None, insult), (None, say(30)), *((k, f"{say(5)}\n{shared}") for k in range(10, 16)), (None, f"a\n{shared}"),
    ]
    rows = [(k, t, "en", 0, "kept") for k, t, _ in taught] + [(k, t, "en", 0, "kept") for k, t in odd]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long, text_hash string")
    spark.createDataFrame([(k, y) for k, _, y in taught], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    out, kept = {}, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        kept.write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
        assert kept.columns == docs.columns and stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        out[name] = Counter((x.doc_id, x.text) for x in kept.collect() if x.doc_id is None or x.doc_id < 100)
    left = Counter(odd) - Counter([(5, insult), (None, insult)])
    assert out["toxicity"] == left
    cleaned = Counter()
    for (k, t), n in left.items():
        cleaned[k, t.split("\n")[0] if t and k in range(10, 15) else t or ""] += n
    assert out["line dedup"] == cleaned
    gone = Counter([(1, one), (2, one + " more"), (6, near + " x"), (3, "")])
    assert out["n-gram Jaccard join"] == cleaned - gone == out["PII"]
    packed = stages["best-fit packing"](spark, kept, str(tmp_path)).collect()
    assert len(packed) == kept.count() and stages["best-fit packing"](spark, docs.limit(0), str(tmp_path)).count() == 0


def test_a_cluster_needs_a_shared_folder():
    class Session:
        conf = {}
        sparkContext = type("Context", (), {"master": "yarn"})

    with pytest.raises(ValueError, match="checkpoint.dir"):
        common.shared_folder(Session())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got, want = queries.queries()[name](spark, SF).toPandas(), con.execute(queries.oracle_sql()[name]).df()
    assert sorted(map(str, got[sorted(got.columns)].to_numpy().tolist())) == sorted(map(str, want[sorted(want.columns)].to_numpy().tolist()))


def test_names():
    found = queries.queries()
    assert sorted(int(k[2:].split("_")[0]) for k in found if re.match(r"op\d+_", k)) == list(range(1, 11))
