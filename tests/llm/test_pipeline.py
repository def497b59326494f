import corpus_pipeline
from loamwork.llm.common import cut, documents
from loamwork.llm.mixing import mixed_copies, n_words
from loamwork.llm.simhash import shingle_hashes

from .test_exact_and_mix import brute_classes
from .test_models import brute_base
from .test_near import closure, jaccard


def test_stages_keep_the_columns_and_only_ever_drop_or_repeat(spark, sf_dir):
    docs = documents(spark, sf_dir)
    whole = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = cut(stage(spark, docs, sf_dir), name).df
        assert after.columns == whole.columns
        assert after.exceptAll(docs).count() == 0 if name != "mixing" else after.distinct().exceptAll(docs).count() == 0
        assert after.count() > 0
        docs = after
    packed = corpus_pipeline.run(spark, sf_dir)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.select("doc_id").distinct().collect()}
    whole_pieces = packed.groupBy("doc_id", "piece").count()
    assert sum(r["count"] for r in whole_pieces.where("piece = 0").collect()) == docs.count()


def test_stages_take_odd_and_no_rows(spark, make, odd_rows, sf_dir):
    for rows in (odd_rows, []):
        docs = make(rows)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, sf_dir).columns == docs.columns, name
            stage(spark, docs, sf_dir).count()
        corpus_pipeline.packed(spark, docs, sf_dir).count()


def test_stages_give_odd_rows_their_defined_results(spark, make, odd_rows, sf_dir):
    docs, by = make(odd_rows), dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted((r["doc_id"] for r in df.collect()), key=str)
    texts = {r[0]: r[1] for r in odd_rows}
    assert all(not brute_base(texts[d])[-1] for d in ids(by["quality_rules"](spark, docs, sf_dir)))
    assert ids(by["exact_dedup"](spark, docs, sf_dir)) == sorted((r[0] for r in brute_classes(odd_rows) if r[3]), key=str)
    sets = {d: set(shingle_hashes((t or "").encode(), 5).tolist()) for d, t in texts.items() if d is not None}
    alone = set(closure(sorted(sets), lambda a, b: jaccard(sets[a], sets[b]) >= 0.8).values())
    assert ids(by["simhash_near_dedup"](spark, docs, sf_dir)) == sorted((r[0] for r in odd_rows if r[0] in alone | {None}), key=str)
    copies = [(r["doc_id"], r["copies"]) for r in mixed_copies(docs, n_words()).collect()]
    assert ids(by["mixing"](spark, docs, sf_dir)) == sorted((d for d, n in copies for _ in range(n)), key=str)
    packed = by["best_fit_packing"](spark, docs, sf_dir).collect()
    assert sorted((r["doc_id"] for r in packed if r["piece"] == 0), key=str) == sorted((r[0] for r in odd_rows), key=str)
