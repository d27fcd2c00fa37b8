"""The pipeline stage by stage on a small corpus: each stage against a plain version of its decisions."""

import collections

import pytest
from conftest import rows_of
from pyspark.sql import functions as F
from test_dedup import plain_components, plain_lines
from test_search_and_mix import plain_targets

import corpus_pipeline as P
from pinwall.llm import common, queries, toxicity


@pytest.fixture(scope="module")
def corpus(docs, spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("corpus")
    rude = docs.where("doc_id % 4 = 1 and text is not null").withColumn("doc_id", F.col("doc_id") + 500).withColumn("text", F.concat(F.lit("you utter idiot. "), "text"))
    rows = docs.unionByName(rude)
    rows.write.parquet(str(at / "documents.parquet"))
    rows.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") >= 500).cast("int").alias("toxic")).write.parquet(str(at / "labels.parquet"))
    return str(at)


def test_stages(spark, corpus):
    docs = common.table(spark, corpus, "documents")
    assert [n for n, _ in P.STAGES] == ["toxicity", "line_dedup", "minhash_neardup", "source_mix", "packing"]
    clean = common.written(P.drop_toxic(spark, docs, corpus))
    assert clean.columns == docs.columns
    model = toxicity.train(docs, common.table(spark, corpus, "labels"))
    assert sorted(r["doc_id"] for r in rows_of(clean)) == sorted(r["doc_id"] for r in rows_of(docs) if model.score(r["text"]) < toxicity.THRESHOLD)

    lined = common.written(P.drop_repeated_lines(spark, clean, corpus))
    want = plain_lines(rows_of(clean))
    want = {i: (t, len(t or "")) for i, (n, gone, t) in want.items() if gone < n or not gone}
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in rows_of(lined)} == want and lined.columns == docs.columns

    single = common.written(P.drop_near_duplicates(spark, lined, corpus))
    rows = rows_of(lined)
    assert sorted(r["doc_id"] for r in rows_of(single)) == sorted(d for d, _, c in plain_components(rows, 5, 80) if d == c)

    mixed = common.written(P.mix_sources(spark, single, corpus))
    sizes, got = collections.Counter(), collections.Counter()
    whole = {r["doc_id"]: (r["text"] or "").split() for r in rows_of(single)}
    for r in rows_of(single):
        sizes[r["source"]] += len((r["text"] or "").encode().split())
    for r in rows_of(mixed):
        words = r["text"].split()
        assert words == whole[r["doc_id"]][: len(words)] and words
        got[r["source"]] += len(r["text"].encode().split())
    for s, t in plain_targets(dict(sizes)).items():
        assert t - 1 <= got[s] <= t

    packed = rows_of(P.pack_sequences(spark, mixed, corpus))
    assert len({r["doc_id"] for r in packed}) == len({r["doc_id"] for r in rows_of(mixed)})
    assert P.run(spark, corpus).count() == len(packed)


def test_registered(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names) and set(queries.ORACLE) <= set(queries.QUERIES)


def test_one_row_of_a_group_stays(spark, tmp_path):
    base = [f"w{i}" for i in range(120)]
    near = [" ".join(base[:-k] + [f"x{k}"] * k) for k in (1, 2, 3)]
    other = " ".join(f"y{i}" for i in range(120))
    rows = [(1, near[0]), (1, near[1]), (2, near[2]), (1, other), (3, other + " z"), (4, None), (4, "")] + [(None, near[0]), (None, near[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["text"]) for r in rows_of(P.drop_near_duplicates(spark, docs, str(tmp_path)))]
    keys = {r["text"]: r["rk"] for r in rows_of(docs.where("doc_id = 1").select("text", common.row_key().alias("rk")))}
    first = min(near[:2], key=keys.get)
    assert sorted(got, key=str) == sorted([(1, first), (1, other), (4, None), (4, ""), (None, near[0]), (None, near[1])], key=str)
