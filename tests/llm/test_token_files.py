import zlib

import numpy as np
from tokenizers import Tokenizer

from pricelens.llm import token_files as F
from pricelens.llm.tokens import tokenizer_path


def expected(rows):
    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    out, at = [], 0
    for k, text in sorted(rows):
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [2], dtype="<u4")
        out.append((k, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_query_on_table(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, F.query(spark, sf).collect())) == expected(rows)


def test_edges(spark):
    rows = [(9, None), (2, ""), (5, "Some words"), (-4, "é " * 3000), (7, " \n "), (11, "a <|endoftext|>b <|STARTOFTEXT|> <|startoftext|>")]
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, start int")
    assert sorted(map(tuple, F.round_trip(spark, df, tokenizer_path("word_bpe_49k.json")).collect())) == expected([(k, t or "") for k, t in rows])
    assert F.round_trip(spark, df.limit(0), tokenizer_path("word_bpe_49k.json")).count() == 0
