"""The pipeline's stages on the small table against plain versions."""

import hashlib

import corpus_pipeline
import numpy as np
import sentencepiece
from lociweave.llm import language_id, sentencepiece_lattice
from lociweave.runtime import store
from tests.llm.test_small_cases import plain_alpha, plain_components

SF_DIR = "/root/testdata/sf0.001"


def plain_language(rows):
    """Predicted languages of texts by the definition of the method, one text at a time."""
    encoder = language_id.Encoder(language_id.DIMENSIONS)
    vectors = [encoder.bundle(*encoder.trigrams([r.text or ""]), 1)[0].astype(np.float64) for r in rows]
    sums = {}
    for r, v in zip(rows, vectors, strict=True):
        if r.lang is not None and r.text is not None:
            sums[r.lang] = sums.get(r.lang, 0) + v
    langs = sorted(sums)
    unit = np.array([sums[k] / np.linalg.norm(sums[k]) for k in langs])
    for v in vectors:
        n = np.linalg.norm(v)
        cosines = unit @ v / n if n else None
        yield ("und", 0.0) if cosines is None else (langs[int(cosines.argmax())], float(cosines.max()))


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, outs = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = store(stage(spark, docs, SF_DIR), f"test-{name}")
        outs.append(docs.collect())
        assert name == "sentencepiece" or docs.columns == columns
    start = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    known, single, apart, mixed, pieces = outs
    want = {r.doc_id: r.lang or lang for r, (lang, score) in zip(start, plain_language(start), strict=True) if lang != "und" and score >= corpus_pipeline.LEAST_COSINE}
    assert {r.doc_id: r.lang for r in known} == want
    last = {}
    for r in known:
        last[r.text] = max(r.doc_id, last.get(r.text, -1))
    assert {r.doc_id for r in single} == set(last.values())
    near = plain_components([(r.doc_id, r.text) for r in single])
    assert {r.doc_id for r in apart} == {i for i, (_, c) in near.items() if i == c}
    assert {r.doc_id for r in mixed} == {r.doc_id for r in apart}
    tokens = {}
    for r in apart:
        tokens[r.source] = tokens.get(r.source, 0) + len(r.text.split())
    total, most = sum(tokens.values()), max(tokens.values())
    alpha = plain_alpha([n / total for n in tokens.values()], corpus_pipeline.MOST_REPEATS)
    longest = max(len(r.text.split()) for r in apart)
    for s, n in tokens.items():
        have = sum(len(r.text.split()) for r in mixed if r.source == s)
        assert n * (n / most) ** (alpha - 1) - longest <= have <= n * (n / most) ** (alpha - 1) + 1
    lib = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_lattice.MODEL)
    text = {r.doc_id: r.text for r in apart}
    ids = {i: lib.encode(t) for i, t in text.items()}
    assert all(r.ids == ids[r.doc_id] and r.n_tokens == len(r.ids) for r in pieces)
    assert [r.doc_id for r in pieces] == [r.doc_id for r in mixed]


def test_repeated_runs_agree(spark):
    digest = lambda: hashlib.sha256(repr(sorted(map(tuple, corpus_pipeline.run(spark, SF_DIR).collect()))).encode()).hexdigest()
    assert digest() == digest()


def test_stages_on_odd_tables(spark):
    names = "doc_id long, text string, lang string, source string, n_chars long, epochs int, p_source string, `__id` int, tags map<string,int>"
    rows = [(1, "The first text of all.", "en", "a", 1, 1, "x", 1, {"k": 1}), (1, "The first text of all.", "en", "a", 1, 1, "x", 1, {"k": 2}), (None, None, None, None, None, None, None, None, None), (2, "", "en", None, 0, 1, "y", 2, {}), (3, "The second text here.", None, None, 1, 1, "z", 3, None)]
    for data in (rows, [(9, "Ohne Sprache.", None, "a", 1, 1, "x", 1, None)], []):
        docs = store(spark.createDataFrame(data, names), "odd")
        for name, stage in corpus_pipeline.STAGES:
            before, docs = docs.columns, store(stage(spark, docs, SF_DIR), f"odd-{name}")
            assert name == "sentencepiece" or docs.columns == before
        assert {r.doc_id for r in docs.collect()} == ({1, 3} if len(data) > 1 else {r[0] for r in data})
