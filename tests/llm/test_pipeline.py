"""The pipeline stage by stage against brute force over its own input, and the queries against their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as cp
from llm.conftest import EDGES, FOLDER
from llm.test_dedup import classes, lower, near, plain_fingerprint
from llm.test_scans import base_secrets, entropy_spans
from voxelframe.llm.queries import ORACLE, QUERIES


def rows_of(frame):
    return [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]


def table(spark, name, docs, edges):
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    if name == "docs":
        return docs
    full = edges.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    return full.select(names) if name == "edges" else full.where("false")


@pytest.mark.parametrize("name", ["docs", "edges", "empty"])
def test_stages(spark, name, docs, edges):
    frame = table(spark, name, docs, edges)
    rows = rows_of(frame)

    copies = cp.drop_copies(spark, frame, FOLDER)
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    want = sorted(repr((max((j for j in ids if j is not None), default=None), t)) for t, ids in groups.items())
    assert sorted(repr((i, lower(t))) for i, t in rows_of(copies)) == want and copies.columns == frame.columns

    near_copies = cp.drop_near_copies(spark, frame, FOLDER)
    root = classes({plain_fingerprint(t) for _, t in rows}, near)
    best = {}
    for i, t in rows:
        r = root[plain_fingerprint(t)]
        best[r] = min(best.get(r, (True, 0)), (i is None, i or 0))
    got = rows_of(near_copies)
    assert sorted((i is None, i or 0) for i, _ in got) == sorted(best.values()) and near_copies.columns == frame.columns
    assert len({root[plain_fingerprint(t)] for _, t in got}) == len(got)

    masked = cp.mask_secrets(spark, frame, FOLDER)
    assert masked.dtypes == frame.dtypes and masked.count() == len(rows)
    clean = [(i, t) for i, t in rows if not (t and base_secrets(t) + entropy_spans(t))]
    assert set(map(repr, clean)) <= set(map(repr, rows_of(masked)))
    assert not any(base_secrets(t or "") for _, t in rows_of(masked))

    assert cp.drop_toxic(spark, frame, FOLDER).columns == frame.columns
    assert {r.doc_id for r in cp.pack_documents(spark, frame, FOLDER).select("doc_id").collect()} == {i for i, _ in rows}


def test_toxic_stage_keeps_clean_documents(spark, docs):
    toxic = {r.doc_id for r in spark.read.parquet(f"{FOLDER}/labels.parquet").where("toxic = 1").collect()}
    known = {r.doc_id for r in spark.read.parquet(f"{FOLDER}/labels.parquet").where("toxic = 0").collect()}
    kept = {i for i, _ in rows_of(cp.drop_toxic(spark, docs, FOLDER))}
    assert len(known & kept) / len(known) > 0.97 and len(toxic & kept) / len(toxic) < 0.4


def test_run_is_its_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for i, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "offset"]
    assert sorted(map(tuple, docs.select(key).collect())) == sorted(map(tuple, cp.run(spark, FOLDER).select(key).collect()))


@pytest.mark.parametrize("name", list(ORACLE))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    frame = QUERIES[name](spark, FOLDER)
    cursor = con.execute(ORACLE[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(frame.columns)
    assert sorted(map(repr, cursor.fetchall())) == sorted(repr(tuple(r)) for r in frame.select(names).collect())


def test_registered():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 11)} | {"pipeline"}
    assert set(QUERIES) <= set(entry.queries())
    assert EDGES
