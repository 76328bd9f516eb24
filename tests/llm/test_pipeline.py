"""The pipeline against a brute-force version of its stages, and the registered queries."""

import hashlib

import numpy as np

import __spark_entry__
import corpus_pipeline
from terrapath.llm import byte_bpe, quality, secret_scan

from .test_jaccard import brute
from .test_operators import plain_words, spans_by_brute

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    import public_tokenizers
    import tiktoken

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r["doc_id"] for r in quality.judge(docs).filter("kept").collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] in kept]
    first = {i for i, _, c in brute(rows) if i == c}
    items = [plain_words(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {" ".join(w[i : i + min(10, len(w))]) for w in items if w for i in range(max(1, len(w) - 9))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(byte_bpe.default_ranks()), special_tokens={})
    want = []
    for i, text in rows:
        if i not in first or any(f" {w} " in f" {' '.join(plain_words(text))} " for w in windows):
            continue
        out, at = "", 0
        for a, _, z, _ in spans_by_brute(text or ""):
            if a >= at:
                out, at = out + text[at:a] + secret_scan.MASK, z
            else:
                at = max(at, z)
        ids = np.array(library.encode_ordinary(out + (text or "")[at:]), "<u4").tobytes()
        want.append((i, len(ids) // 4, hashlib.sha256(ids).hexdigest()))
    got = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, got.select("doc_id", "n_tokens", "ids_sha256").collect())) == sorted(want)
    assert 0 < len(want) < len(rows)


def test_registered():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert len(corpus_pipeline.STAGES) == 5
