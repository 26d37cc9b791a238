"""The pipeline's stages keep what brute force keeps, and its result carries the library's ids."""

import random

from test_corpus_ops import joined

import corpus_pipeline
from fieldtrace.llm import pieces


def test_pipeline(spark, tmp_path):
    rng = random.Random(2)
    text = lambda n: " ".join(f"w{rng.randint(0, 400)}" for _ in range(n))
    item = "how many of the 12 small boats that left the harbour before noon came back to it after 3 hours of heavy rain"
    line = "Subscribe to our newsletter and never miss any of the important news"
    rows = [(i, f"{text(80)}\n{line}", "en", f"s{i % 4}", 1) for i in range(12)]
    rows += [(20, rows[3][1], "en", "s0", 1), (21, rows[4][1] + " more", "en", "s1", 1), (22, f"{text(60)} {item} {text(20)}", "en", "s2", 1), (23, "too short", "en", "s3", 1),
             (24, None, "en", "s0", 1), (None, text(70), None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    left = [(i, t.replace("\n" + line, "") if i != 21 and t else t) for i, t, *_ in rows if i not in (22, 23, 24)]
    want = {i: t for (i, t), (_, _, c) in zip(left, joined(left)) if i == c or i is None}
    got = {r["doc_id"]: r["text"] for r in out}
    assert set(got) == set(want) and all(got[i] == want[i] for i in got if i != 20)
    import sentencepiece
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    assert all(r["ids"] == lib.encode(r["text"]) for r in out)
