"""The sampling query gives the drawn pieces themselves."""

import zlib

import numpy as np

from graphloom.llm import queries


def test_drawn_ids_are_returned_and_fit_their_digest(spark, tmp_path):
    rows = [(1, "the cat sat on the mat"), (2, ""), (3, None), (4, "naïve façade 12")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op3_sentencepiece(spark, str(tmp_path)).collect()
    assert len({r["doc_id"] for r in found}) == 4
    for r in found:
        assert len(r["ids"]) == r["n_pieces"] and zlib.crc32(np.array(r["ids"], "<u4")) == r["ids_crc32"]
    assert any(r["ids"] for r in found)
