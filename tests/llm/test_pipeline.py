import hashlib

import sentencepiece

import __spark_entry__ as entry
import corpus_pipeline
from docspark.llm import mixing, quality, queries, toxicity
from test_ngram_join import brute

SF = "/root/testdata/sf0.001"


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "toxicity", "n-gram Jaccard join", "mixing sources to target weights", "SentencePiece encoding and decoding"]
    names = entry.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 11)} and "pipeline" in names


def test_run_against_the_stages_one_by_one(spark):
    """Each decision is taken from the operators' verdicts by doc_id, and applied here in plain Python."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    kept = {r.doc_id for r in quality.quality(docs, labels).where("kept").collect()}
    good = docs.where(docs.doc_id.isin(kept))
    clean = {r.doc_id for r in toxicity.toxicity(good, labels).where("predicted = 0").collect()}
    rows = [(r.doc_id, r.text) for r in good.collect() if r.doc_id in clean]
    firsts = {d for d, n, c in brute(rows) if d == c or n == 0}
    left = good.where(good.doc_id.isin(firsts))
    lib = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    texts = {r.doc_id: r.text for r in left.collect()}
    want = []
    for r in mixing.mix(left).collect():
        whole, cut = divmod(r.taken, r["size"]) if r["size"] else (0, 0)
        words = texts[r.doc_id].split()
        assert len(words) == r["size"]
        want += [texts[r.doc_id]] * whole
        if cut:
            at = 0
            for w in words[:cut]:
                at = texts[r.doc_id].index(w, at) + len(w)
            want.append(texts[r.doc_id][:at])
    digest = lambda t: hashlib.sha256(" ".join(map(str, [*lib.encode(t), 2])).encode()).hexdigest()
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r.ids_sha256 for r in got) == sorted(map(digest, want))


def test_nothing_to_do(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
