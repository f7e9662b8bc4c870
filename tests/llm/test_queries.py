"""Corpus queries against DuckDB, and the pipeline against brute force."""

from __future__ import annotations

import random

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from curbside.llm.near_dedup import similarity, weighted_sets
from curbside.llm.queries import ORACLES, QUERIES
from tests.llm.frames import prose
from tests.llm.test_operators import check_pieces

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_statement(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    found = QUERIES[name](spark, SF)
    expected = con.execute(ORACLES[name])
    columns = sorted(c[0] for c in expected.description)
    places = [[c[0] for c in expected.description].index(c) for c in columns]
    assert sorted(found.columns) == columns
    mine = sorted(str(tuple(r[c] for c in columns)) for r in found.collect())
    assert mine == sorted(str(tuple(r[p] for p in places)) for r in expected.fetchall())


def test_pipeline_keeps_clean_documents_and_drops_the_rest(spark, tmp_path):
    bench = prose(9000, 30)
    rows = [(i, f"{prose(i, 80)}\n{prose(500 + i, 70)}", "en", f"s{i % 3}", 0) for i in range(40)]
    pick = random.Random(1)
    near = [w if pick.random() > 0.01 else w + "q" for w in rows[3][1].split(" ")]
    rows += [
        (100, rows[2][1], "en", "s1", 0),
        (101, " ".join(near), "en", "s2", 0),
        (102, f"{prose(102, 60)} {bench} {prose(103, 60)}", "en", "s0", 0),
        (103, "too short", "en", "s0", 0),
        (104, None, None, None, None),
        (105, f"{prose(105, 80)} password = hunter2hunter2 {prose(106, 20)}", "en", "s0", 0),
    ]
    sets = [s for _, s in weighted_sets([r[1] for r in rows])]
    assert similarity(sets[3], sets[41]) >= 0.8
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")  # noqa: E501
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")  # noqa: E501
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
    clean = set(range(40)) | {105}
    assert set(seen["quality_rules"]) == clean | {100, 101, 102}
    assert set(seen["near_dedup"]) == clean | {102}
    assert set(seen["decontaminate"]) == clean
    assert "hunter2" not in seen["secret_scan"][105] and set(seen["secret_scan"]) == clean
    assert all(seen["secret_scan"][i] == rows[i][1] for i in range(40))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {d: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2]) for d, t in seen["secret_scan"].items()}  # noqa: E501
    check_pieces(corpus_pipeline.run(spark, folder).collect(), ids)
