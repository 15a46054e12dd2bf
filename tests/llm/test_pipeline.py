"""The pipeline's stages on odd rows, and its run followed by other code."""

import hashlib
from collections import Counter
from pathlib import Path

import duckdb
import public_tokenizers
import pytest
import tiktoken
from test_documents import brute, words

import corpus_pipeline
from pageframe.llm import bpe, langid, oracles

SF = Path("/root/testdata/sf0.001")


def test_stages_keep_columns(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, "")
            assert out.columns == docs.columns, name
            out.count()


def test_quality_stage_with_empty_texts_beside_references(spark, odd_docs):
    """The driver's rows make references (``odd_docs`` alone has none); rows without a character lie in one row group with others, so that
    no reader passes over them, and are held against the references."""
    if not SF.exists():
        pytest.skip("no test tables here")
    columns = ["doc_id", "text", "lang", "source"]
    plain = spark.read.parquet(f"{SF}/documents.parquet").select(columns)
    odd = odd_docs.where("doc_id IN (3, 4, 5, 6)").selectExpr("-doc_id AS doc_id", *columns[1:])
    kept = [{r.doc_id for r in corpus_pipeline.quality_rules(spark, docs, "").collect()} for docs in (plain, plain.union(odd).coalesce(1))]
    assert kept[0] == kept[1] != set()


def test_run(spark):
    if not SF.exists():
        pytest.skip("no test tables here")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    good = {i for i, kept in con.sql(f"SELECT doc_id, kept FROM ({oracles.QUALITY})").fetchall() if kept}

    left = docs.where(docs.doc_id.isin(*good))
    model = langid.learned(left.where(~langid.held_out(left.doc_id)).select("doc_id", "text", "lang"))
    x = {r.doc_id: langid.features(r.text, model.dims) for r in left.collect()}
    said = {i: v is not None and model.predict(v) for i, v in x.items()}
    good = {i for i in good if said[i] and said[i][1] >= langid.MIN_SCORE and model.fits(x[i], said[i][0])}

    rows = sorted((r for r in left.collect() if r.doc_id in good), key=lambda r: r.doc_id)
    one = [r for r, (i, n, group) in zip(rows, sorted(brute(rows, 5, 80)), strict=True) if r.doc_id == i and i == group]
    assert 0.5 * docs.count() < len(one) < len(rows) < docs.count()

    size = {r.doc_id: len(words(r.text)) for r in one}
    total = Counter()
    for r in one:
        total[r.source] += size[r.doc_id]
    target, open_ = {}, {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(total, key=lambda s: (s is None, s or "")))}
    rest = 1.5 * sum(total.values())
    while open_:
        level = rest / sum(open_.values())
        full = [s for s in open_ if open_[s] * level >= 2 * total[s]]
        target |= {s: 2 * total[s] for s in full} if full else {s: w * level for s, w in open_.items()}
        rest -= sum(2 * total[s] for s in full)
        open_ = {s: w for s, w in open_.items() if s not in full} if full else {}

    found = corpus_pipeline.run(spark, str(SF)).collect()
    times, taken, source = Counter(r.doc_id for r in found), Counter(), {r.doc_id: r.source for r in one}
    assert set(times) <= set(size) and max(times.values()) <= 2
    for i, n in times.items():
        taken[source[i]] += n * size[i]
    assert all(abs(taken[s] - target[s]) <= max(size[i] for i in size if source[i] == s) / 2 + 1e-6 for s in target)

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = {r.doc_id: r.text for r in one}
    for r in found:
        ids = own.encode_ordinary(text[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256(text[r.doc_id].encode()).hexdigest())
