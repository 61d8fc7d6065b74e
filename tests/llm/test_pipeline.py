import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
from conftest import SMALL
from test_operators import brute_components
from tokenizers import Tokenizer

from weftline.llm import exact_dedup, language_id, near_dedup, toxicity


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language_id", "exact_dedup", "near_dedup", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = spark.createDataFrame(stage(spark, docs, SMALL).collect(), docs.schema)
        assert after.columns == docs.columns and 0 < after.count() <= docs.count()
        docs = after
    assert exact_dedup.classify(docs).where("not kept").count() == 0
    assert near_dedup.near_duplicates(docs).where("not kept").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_run_like_brute_force(spark):
    """Models decide the first two stages, everything after them is worked out by hand."""
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = table.collect()

    def left(gone):
        gone = {r[0] for r in gone.collect()}
        return [r for r in rows if r.doc_id not in gone]

    model = toxicity.train(table, spark.read.parquet(f"{SMALL}/labels.parquet"))
    rows = left(toxicity.score(table, model).where("rejected").select("doc_id"))
    rows = left(language_id.identify(language_id.of_documents(spark.createDataFrame(rows, table.schema))).where("not kept").select("id"))
    newest = {}
    for r in rows:
        newest[r.text or ""] = max(r.doc_id, newest.get(r.text or "", r.doc_id))
    rows = [(r.doc_id, r.text or "") for r in rows if newest[r.text or ""] == r.doc_id]
    component = brute_components(rows, 5, 80)
    rows = [(i, t) for i, t in rows if component[i][1] == i]
    assert 0 < len(rows) < table.count()

    library, expected = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), Counter()
    for i, text in rows:
        ids = np.array(library.encode(text, add_special_tokens=False).ids + [1], "<u4")
        expected.update((i, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes()), len(ids)) for s in range(0, len(ids), 2048))
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == expected
    held = Counter()
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == held[r.sequence_id]
        held[r.sequence_id] += r.length
    assert max(held.values()) <= 2048


def test_stages_on_odd_rows(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "", "", 0), (None, "a b c", "en", "s", 5), (4, "a b c", "en", "s", 5), (4, "a b c", "en", "s", 5)], schema)
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SMALL).collect()
        stage(spark, docs.limit(0), SMALL).collect()
