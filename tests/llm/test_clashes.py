"""Odd columns, foreign and repeated labels, short texts: what a round's verdict found."""

import hashlib
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402

from weftline.llm import byte_bpe, exact_dedup, language_id, near_dedup, packing, sharding, toxicity  # noqa: E402

ODD = "doc_id bigint, text string, _id string, _key string, _no_id string, _gone bigint, key int, id int, row int, `a.b` int, m map<string,int>, tags array<int>"


def odd(spark, rows):
    return spark.createDataFrame([(i, t, "mine", "k", "n", i, 7, 8, 9, 10, {"x": 1, "y": k}, [k]) for k, (i, t) in enumerate(rows)], ODD)


def test_dedup_leaves_other_columns_alone(spark):
    found = exact_dedup.dedup(odd(spark, [(1, "a"), (2, "a"), (None, "b"), (2, "a"), (3, None), (4, "")])).collect()
    assert sorted((r.doc_id or 0, r.text) for r in found) == [(0, "b"), (2, "a"), (4, "")]
    assert all((r["_id"], r["_key"], r["_no_id"], r.key, r.id, r.row, r["a.b"]) == ("mine", "k", "n", 7, 8, 9, 10) and r.m["x"] == 1 for r in found)


def test_without_takes_any_column_name(spark):
    docs = odd(spark, [(1, "a"), (2, "b"), (None, "c")])
    left = corpus_pipeline.without(docs, docs.where("doc_id = 2").select(corpus_pipeline.row_key("text").alias("key")), "text")
    assert left.columns == docs.columns and sorted(r.text for r in left.collect()) == ["a", "c"]


def test_rows_that_share_an_id_or_have_none_go_by_themselves(spark):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(1, text), (1, "another text about something else that stays"), (None, text + " more"), (None, "a text of its own without any id here"), (3, "one two three four five six " + text)]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id bigint, text string, lang string, source string")
    left = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert left.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in left.collect()) == sorted([(0, rows[3][1]), (1, rows[1][1]), (1, text)])
    mixed = docs.unionByName(spark.createDataFrame([(1, "12345 67 89", "en", "s"), (None, "... !!!", "en", "s")], docs.schema))
    left = corpus_pipeline.drop_unidentified(spark, mixed, "")
    assert sorted((r.doc_id or 0, r.text) for r in left.collect()) == sorted((i or 0, t) for i, t in rows)


def test_texts_that_are_not_utf8(spark):
    raw = [b"some bad \xff\xfe bytes \xc3 here and more words that follow", b"\xff", b"null id \xf0\x9f words", b"plain words only", "caf\u00e9 caf\u00e9".encode()]
    docs = spark.createDataFrame([(k if k != 2 else None, bytearray(t), "en", "s", k % 2) for k, t in enumerate(raw)], "doc_id bigint, b binary, lang string, source string, toxic int")
    docs = docs.selectExpr("doc_id", "cast(b as string) as text", "lang", "source", "toxic")
    assert sorted(r.n_shingles for r in near_dedup.near_duplicates(docs, width=2).collect()) == sorted([len(set(zip(t.split(), t.split()[1:]))) or 1 for t in raw])
    assert language_id.identify(language_id.of_documents(docs)).count() == len(raw)
    model = toxicity.train(docs, docs.select("doc_id", "toxic"))
    assert toxicity.score(docs, model).count() == len(raw) and 0 < toxicity.keep_clean(docs, model).count() <= len(raw)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    packed = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert sorted(r.doc_tokens for r in packed) == sorted(len(library.encode(t.decode(errors="replace"), add_special_tokens=False).ids) + 1 for t in raw)
    found = byte_bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    assert sorted(r.decoded_sha256 for r in found) == sorted(hashlib.sha256(t.decode(errors="replace").encode()).hexdigest() for t in raw)


def test_sharding_of_maps(spark):
    docs = odd(spark, [(i, "x" * (i % 7)) for i in range(90)])
    found = [sorted((r.shard, r.slot, r.doc_id, r.m["y"]) for r in sharding.shard(sharding.sized(docs), 4).collect()) for _ in range(2)]
    assert found[0] == found[1] and len({x[2] for x in found[0]}) == 90
    assert {s: sorted(slot for shard, slot, *_ in found[0] if shard == s) for s in range(4)} == {s: list(range(n)) for s, n in Counter(x[0] for x in found[0]).items()}


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, toxic int")


def test_labels_of_unknown_documents_use_up_nothing(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(200)], "doc_id bigint, text string")
    own = [(i, int(i % 4 == 0)) for i in range(200)]
    foreign = [(i, i % 2) for i in range(1_000, 20_000)]
    known = toxicity.labelled(docs, labels(spark, own + foreign))
    assert toxicity.sample(docs, known, 100).groupBy("toxic").count().collect() and toxicity.sample(docs, known, 100).count() == 150
    assert toxicity.label_weights(known, 100) == {True: 1.0, False: 1.5}


def test_a_repeated_labelled_id_gives_one_row(spark):
    docs = spark.range(3000).selectExpr("7L as doc_id", "concat('text ', id) as text").unionByName(spark.createDataFrame([(8, "x"), (8, "x")], "doc_id bigint, text string"))
    known = toxicity.labelled(docs, labels(spark, [(7, 1), (7, 0), (8, 0), (8, None), (9, 1)]))
    assert sorted((r.doc_id, r.toxic) for r in toxicity.sample(docs, known, 10).collect()) == [(7, 1), (8, 0)]


def test_language_samples_null_and_repeated_ids(spark):
    rows = spark.range(4000).selectExpr("if(id % 2 = 0, null, 5L) as id", "concat('the word ', id) as text", "'en' as declared")
    chance = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) / float(1 << 30)
    assert 60 < rows.where(chance < 0.025).count() < 140
    assert language_id.train(rows, 100).languages == ["en"]


def test_short_pieces_go_through_the_linear_program():
    rng = np.random.default_rng(3)
    sizes = np.array([7, 23, 41, 58, 63], np.int64)
    demand = rng.integers(200, 4000, len(sizes))
    used = packing.column_generation(sizes, demand, 2048)
    assert (sum(p * n for p, n in used) == demand).all() and all((p * sizes).sum() <= 2048 for p, _ in used)
    assert sum(n for _, n in used) <= -(-int((sizes * demand).sum()) // 2048) + len(sizes)


def test_batches_to_python_are_bounded(spark):
    from weftline.llm._common import BATCH_BYTES, BATCH_LIMIT, small_batches

    set_before = spark.conf.get(BATCH_LIMIT, "1").rstrip("b")
    spark.conf.set(BATCH_LIMIT, "1m")
    small_batches(spark.range(1))
    assert spark.conf.get(BATCH_LIMIT) == "1m"
    spark.conf.unset(BATCH_LIMIT)
    rows = small_batches(spark.range(3000, numPartitions=1).selectExpr("repeat('x', 8192) as text"))
    sizes = rows.mapInArrow(lambda batches: (b.from_pydict({"n": [b.nbytes]}) for b in batches), "n bigint").collect()
    assert len(sizes) > 2 and max(r.n for r in sizes) < 2 * BATCH_BYTES
    if set_before != "1":
        spark.conf.set(BATCH_LIMIT, set_before)
