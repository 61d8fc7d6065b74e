"""Operators against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from conftest import SMALL, same_rows
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weftline.llm import byte_bpe, chat, exact_dedup, knn_join, language_id, near_dedup, packing, queries, sharding, toxicity, url_filter

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, bucket string, id bigint"
BYTES, WORDS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")


def frame(spark, rows):
    """Documents (doc_id, text) with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", 1, "k", "b", 9) for i, t in rows], DOCS)


def prose(rng, n):
    return " ".join(rng.choice(["thing", "the", "of", "enau", "ntnt", "Über", "a", "tion", "x1", "don't"]) for _ in range(n))


ODD = [(1, None), (2, ""), (3, " "), (4, "one"), (5, "one"), (5, "one"), (None, "lost"), (7, "\n\n two  words\t"), (8, "word " * 30_000), (9, "😀 naïve 你好 <|im_end|> <|endoftext|>")]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, duck, name):
    mine, other = same_rows(queries.QUERIES[name](spark, SMALL), duck, queries.ORACLES[name])
    assert mine == other


# 1 sharding


def test_shards_are_a_permutation(spark):
    docs = frame(spark, [(1000 + i, f"t{i % 7}") for i in range(1000)] + ODD)
    rows = sharding.shard(sharding.document_records(docs), 8).collect()
    assert len(rows) == 1000 + len(ODD)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    sizes = [len(v) for v in slots.values()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    by_id = {r.doc_id: r for r in rows}
    assert (by_id[1].size, by_id[1].text_crc32) == (1, zlib.crc32(b""))
    assert by_id[9].text_crc32 == zlib.crc32(ODD[-1][1].encode())
    order = [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert order != sorted(order, key=lambda x: (x is None, x))
    again = sharding.shard(sharding.document_records(docs), 8).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in again if r.doc_id != 5} == {(r.doc_id, r.shard, r.slot) for r in rows if r.doc_id != 5}


def test_shards_of_nothing_and_written(spark, tmp_path):
    assert sharding.shard(sharding.document_records(frame(spark, [])), 8).count() == 0
    docs = frame(spark, [(i, f"t{i}") for i in range(50)]).withColumn("size", F.lit(3).cast("bigint"))
    sharding.write_shards(docs, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 50 and back.select("shard").distinct().count() == 4 and {"text", "key"} <= set(back.columns)


def test_sharding_query_moves_whole_documents(spark, monkeypatch):
    written = []
    monkeypatch.setattr(sharding, "cut", lambda df: written.append(df) or df)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = {(r.doc_id, r.size, r.text_crc32) for r in queries.op1_sharding(spark, SMALL).collect()}
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert got == {(i, len(t) + 1, zlib.crc32(t)) for i, t in texts.items()}
    moved = written[0].select("record.*")
    assert set(docs.columns) <= set(moved.columns)
    assert {(r.doc_id, (r.text or "").encode()) for r in moved.collect()} == set(texts.items())


def test_shards_over_several_buckets(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 90)
    monkeypatch.setattr(sharding, "bucket_count", lambda records, size: 2100)  # starts over three groups of buckets
    docs = frame(spark, [(i % 700, f"t{i}") for i in range(1400)])
    rows = sharding.digests(sharding.shard(sharding.sized(docs), 8)).collect()
    assert Counter(r.text_crc32 for r in rows) == Counter(zlib.crc32(f"t{i}".encode()) for i in range(1400))
    places = sorted((r.shard, r.slot) for r in rows)
    assert places == [(s, p) for s in range(8) for p in range(175)]


# 2 near dedup


def brute_components(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) if x]
        sets[i] = {tuple(w[j : j + width]) for j in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    ids = sorted(sets)
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for x in range(len(ids)):
        for y in range(x):
            a, b = sets[ids[x]], sets[ids[y]]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                r, s = sorted((top(ids[x]), top(ids[y])))
                root[s] = r
    return {i: (len(sets[i]), top(i)) for i in ids}


@pytest.mark.parametrize("width, group", [(2, 512), (5, 512), (2, 4)])
def test_near_duplicates_like_brute_force(spark, width, group):
    rng = random.Random(width)
    rows, i = [], 0
    for _ in range(25):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randint(20, 90))]
        for _ in range(rng.randint(1, 8)):
            copy = list(base)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = f"W{rng.randrange(400)}"
            rows.append((i, " ".join(copy)))
            i += 1
    rows += [(1000, None), (1001, ""), (1002, "Same"), (1003, "same "), (1004, "x y"), (1005, "X\ty")]
    got = {r.doc_id: r for r in near_dedup.near_duplicates(frame(spark, rows), width=width, group=group).collect()}
    expected = brute_components(rows, width, 80)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_near_duplicates_odd_rows(spark):
    rows = near_dedup.near_duplicates(frame(spark, ODD)).collect()
    assert len(rows) == len(ODD)
    lost = next(r for r in rows if r.doc_id is None)
    assert (lost.component_id, lost.kept) == (None, True)
    assert {r.component_id for r in rows if r.doc_id in (4, 5)} == {4}
    assert near_dedup.near_duplicates(frame(spark, [])).count() == 0


def test_near_duplicates_of_repeated_ids_in_any_order(spark):
    base = [f"w{i}" for i in range(60)]
    a, near, b, far = " ".join(base), " ".join([*base[:-1], "x"]), " ".join(f"v{i}" for i in range(60)), " ".join(f"v{i}" for i in range(59))
    rows = [(5, a), (5, b), (6, near), (3, far), (5, a), (8, "alone in the world")]
    for order in (rows, rows[::-1], [rows[i] for i in (1, 0, 3, 2, 5, 4)]):
        got = {(r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(frame(spark, order), width=2).collect()}
        assert got == {(5, 3, False), (6, 3, False), (3, 3, True), (8, 8, True)}


def test_no_block_gives_out_all_pairs(spark, monkeypatch):
    """Two thousand near copies, many of which are too far from each other: links given out stay below members times blocks."""
    rng = random.Random(2)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(2000):
        copy = list(base)
        for _ in range(rng.randint(2, 5)):
            copy[rng.randrange(90)] = f"x{rng.randrange(50)}"
        rows.append((i, " ".join(copy)))
    emitted, across = [], near_dedup.across
    monkeypatch.setattr(near_dedup, "across", lambda *a: emitted.append(near_dedup.cut(across(*a))) or emitted[-1])
    monkeypatch.setattr(near_dedup, "STARS", 1)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(frame(spark, rows), group=100).collect()}
    # all intersections at once, then a walk over the links
    sets = [{tuple(t.split()[j : j + 5]) for j in range(86)} for _, t in rows]
    index = {x: j for j, x in enumerate(sorted(set().union(*sets)))}
    has = np.zeros((2000, len(index)), np.float32)
    for i, s in enumerate(sets):
        has[i, [index[x] for x in s]] = 1
    sizes, both = has.sum(axis=1), has @ has.T
    linked, expected = 100 * both >= 80 * (sizes[:, None] + sizes - both), {}
    for i in range(2000):
        todo = [i] if i not in expected else []
        while todo:
            for j in np.flatnonzero(linked[todo.pop()]).tolist():
                if j not in expected:
                    expected[j] = i
                    todo.append(j)
    assert got == expected and 10 < len(set(got.values())) < 1990
    assert len(emitted) == 1 and emitted[0].count() < 40 * 2000


def test_spanning_links_join_what_all_links_join():
    rng = np.random.default_rng(4)
    sets = []
    for _ in range(60):
        own = rng.integers(0, 1 << 60, 12, dtype=np.uint64)
        core = np.array([int(rng.integers(6)) * 1000 + j for j in range(100)], np.uint64)
        sets.append(np.unique(np.concatenate((rng.choice(core, 95, replace=False), own[: int(rng.integers(0, 12))]))))
    sig = (near_dedup.signatures(sets, 200)).astype("<u2")
    links = near_dedup.spanning(np.arange(60), np.arange(60), sig, sets, None, 80, near_dedup.least_matches(80, 200))
    root = list(range(60))

    def top(i):
        return i if root[i] == i else top(root[i])

    for a, b in links:
        assert top(a) != top(b)  # none that isn't needed
        root[top(a)] = top(b)
    for i in range(60):
        for j in range(i):
            k = len(np.intersect1d(sets[i], sets[j]))
            if 100 * k >= 80 * (len(sets[i]) + len(sets[j]) - k):
                assert top(i) == top(j)

def test_bayesian_thresholds_rise():
    needed = near_dedup.least_matches(80, 200)
    assert [t for t, _ in needed] == list(range(20, 201, 20))
    assert all(a[1] <= b[1] for a, b in zip(needed, needed[1:])) and needed[-1][1] < 160


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)], "a bigint, b bigint")
    roots = {r.node: r.root for r in near_dedup.components(edges).collect()}
    assert roots == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


# 3 chat


def test_chat_round_trip(spark):
    texts = ["<|im_end|>", "<\\|x", "<\\\\|", "", None, "a\n<|im_start|>b", "<|image:0|>"]
    rows = [(i % 2, i, "assistant" if i % 3 == 0 else "us\ner\\n", t) for i, t in enumerate(texts)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    formatted = chat.format_turns(chat.text_turns(turns))
    whole = {r.conv_id: r.formatted for r in chat.conversations_text(formatted).collect()}
    for conv in (0, 1):
        mine = [(r, t or "") for c, _, r, t in rows if c == conv]
        assert [(r, chat.unescape(t)) for r, t in chat.read_back(whole[conv])] == mine
    got = {r.conv_id: r for r in chat.digests(formatted).collect()}
    for conv in (0, 1):
        mine = [(r, t or "") for c, _, r, t in rows if c == conv]
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in mine).encode()).hexdigest()
        loss = "".join(t for r, t in mine if r == "assistant")
        assert (got[conv].loss_chars, got[conv].loss_sha256, got[conv].formatted_chars) == (len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(whole[conv]))


def test_chat_parts(spark):
    parts = [{"type": "text", "text": "see <|x"}, {"type": "image", "uri": "u1", "width": 28, "height": 15}, {"type": "audio", "uri": "u2", "duration_ms": 81}, {"type": "document", "uri": "u3", "pages": 2}]
    flat, found = chat.flatten(parts)
    assert flat == "see <\\|x<|image:0|><|audio:1|><|document:2|>"
    assert [(a["uri"], a["tokens"]) for a in found] == [("u1", 4), ("u2", 3), ("u3", 1024)]
    with pytest.raises(ValueError):
        chat.flatten([{"type": "video"}])
    turns = spark.createDataFrame([(1, 0, "user", parts), (1, 1, None, None)], f"conv_id bigint, turn bigint, role string, parts array<{chat.PART}>")
    row = chat.conversations_text(chat.format_turns(turns)).first()
    assert row.expanded_tokens == 4 + 3 + 1024 and len(row.attachments) == 3
    assert chat.digests(chat.format_turns(turns.limit(0))).count() == 0


def test_chat_ties_long_texts_and_clashing_columns(spark):
    long = "word <|im_end|> " * 50_000
    rows = [(1, 0, "user", "b"), (1, 0, "assistant", "a"), (1, 0, "user", "b"), (1, None, "user", "first"), (None, 3, "assistant", long), (2, 5, None, None)]
    turns = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id bigint, turn bigint, role string, text string, formatted string, parts string")
    formatted = chat.format_turns(chat.text_turns(turns))
    got = {r.conv_id: r for r in chat.digests(formatted).collect()}
    order = [("user", "first"), ("assistant", "a"), ("user", "b"), ("user", "b")]  # null first, then by the marked text
    assert got[1].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in order).encode()).hexdigest()
    assert (got[None].loss_chars, got[None].loss_sha256) == (len(long), hashlib.sha256(long.encode()).hexdigest())
    assert (got[2].n_turns, got[2].loss_chars) == (1, 0)
    whole = chat.conversations_text(formatted, max_chars=40).orderBy("conv_id", "part").collect()
    assert len([r for r in whole if r.conv_id == 1]) > 1
    joined = "".join(r.formatted for r in whole if r.conv_id == 1)
    assert [(r, chat.unescape(t)) for r, t in chat.read_back(joined)] == order


# 4 exact dedup


def test_exact_dedup_odd_rows(spark):
    rows = exact_dedup.classify(frame(spark, ODD)).collect()
    assert len(rows) == len(ODD)
    by = {r.doc_id: r for r in rows}
    assert (by[1].keep_id, by[1].group_size, by[1].kept) == (2, 2, False)
    assert (by[4].keep_id, by[4].group_size, by[5].kept) == (5, 3, True)
    assert by[None].kept and by[2].text_sha256 == hashlib.sha256(b"").hexdigest()
    left = exact_dedup.dedup(frame(spark, ODD))
    assert left.columns == frame(spark, ODD).columns
    assert Counter(r.doc_id for r in left.collect()) == Counter([2, 3, 5, None, 7, 8, 9])
    assert exact_dedup.classify(frame(spark, [])).count() == 0


def test_cuckoo_index_like_a_dictionary():
    rng, index, held = random.Random(3), exact_dedup.CuckooIndex(4), {}
    for i in range(6000):
        key = hashlib.sha256(str(rng.randrange(2500)).encode()).digest()
        if rng.random() < 0.3:
            assert index.delete(key) == (held.pop(key, None) is not None)
        elif key not in held:
            assert index.find(key) is None
            index.insert(key, [i])
            held[key] = [i]
        else:
            assert index.find(key) == held[key]
    assert dict(index.entries()) == held and index.resizes > 0


def test_cuckoo_verifies_equal_fingerprints():
    a, b = b"\1\2" + b"\0" * 6 + b"\7" * 8 + b"a" * 20, b"\1\2" + b"\0" * 6 + b"\7" * 8 + b"b" * 20
    index = exact_dedup.CuckooIndex()
    index.insert(a, [1])
    assert index.find(b) is None and index.find(a) == [1]


def test_cuckoo_keeps_texts_of_one_digest_apart():
    index, key = exact_dedup.CuckooIndex(), b"\1" * 16
    assert index.add(key, b"one", 1, 1) and index.add(key, b"other", 2, 1) and not index.add(key, b"one", 5, 2)
    assert (index.find(key, b"one"), index.find(key, b"other"), index.find(key, b"none")) == ([5, 3], [2, 1], None)


def test_exact_dedup_gives_out_full_indexes(spark, monkeypatch):
    """Small limits: map tasks give out their index many times, texts lie in many shards, long ones among them."""
    monkeypatch.setattr(exact_dedup, "HELD_BYTES", 3000)
    monkeypatch.setattr(exact_dedup, "SHARD_BYTES", 20_000)
    monkeypatch.setattr(exact_dedup, "BLOCK_BYTES", 500)
    rng = random.Random(4)
    rows = [(i if i % 50 else None, rng.choice(["hot", f"text {rng.randrange(80)}", "long " * 300 + str(rng.randrange(3))])) for i in range(1, 1500)]
    held = defaultdict(list)
    for i, t in rows:
        held[t].append(i)
    expected = Counter()
    for i, t in rows:
        keep = max((x for x in held[t] if x is not None), default=None)
        expected[i, keep, len(held[t]), i == keep, hashlib.sha256(t.encode()).hexdigest()] += 1
    docs = frame(spark, rows)
    assert Counter(tuple(r) for r in exact_dedup.classify(docs).collect()) == expected
    assert Counter(r.text for r in exact_dedup.dedup(docs).collect()) == Counter(set(held))


# 5 language


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    found = language_id.identify(language_id.of_documents(docs)).collect()
    assert len(found) == docs.count()
    assert np.mean([r.language == r.declared for r in found]) > 0.97 and np.mean([r.kept for r in found]) > 0.97
    # the text alone, on documents whose declaration is hidden
    hidden = language_id.of_documents(docs).withColumn("declared", F.when(F.col("id") % 3 > 0, F.col("declared"))).withColumn("host", F.lit(None).cast("string"))
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = [r for r in language_id.identify(hidden).collect() if r.id % 3 == 0]
    assert np.mean([r.language == truth[r.id] for r in rows]) > 0.95


def test_language_odd_rows(spark):
    docs = frame(spark, [*ODD, *((100 + i, "the thing of that and was") for i in range(20))])
    rows = language_id.identify(language_id.of_documents(docs)).collect()
    assert len(rows) == docs.count()
    by = {r.id: r for r in rows}
    assert (by[2].language, by[2].kept) == ("und", False) and by[100].kept
    assert language_id.identify(language_id.of_documents(frame(spark, []))).count() == 0
    pages = spark.createDataFrame([(1, None, None), (2, "http://a.de/x", "<html lang='de-AT'><p>und der die das")], "page_id bigint, url string, html string")
    assert language_id.identify(language_id.of_pages(pages)).count() == 2


def test_language_like_brute_force(spark):
    """The fusion by hand, with suffixes, sites, more values than languages, and ties."""
    rng = random.Random(5)
    words = {"en": "the of and thing was", "de": "der die das und ist", "fr": "le la les une est", "xx": "the der le of die"}
    rows = []
    for i in range(240):
        lang = rng.choice(list(words))
        text = rng.choice([None, "", "123"]) if i % 20 == 0 else " ".join(rng.choice(words[rng.choice([lang, lang, "en"])].split()) for _ in range(rng.randint(1, 9)))
        host = rng.choice([None, "plain", f"h{rng.randrange(9)}.{lang}.site{rng.randrange(3)}.{rng.choice(['com', lang, f't{i}'])}"])
        rows.append((i, text, rng.choice([None, lang, f"{lang.upper()}-AT", "?", "q", "nonsense"]), host))
    rows += rows[-3:]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, lang string, source string, guess int")
    got = language_id.identify(language_id.of_documents(docs)).collect()

    tag = lambda t: (m := __import__("re").match(r"([A-Za-z]{2,3})(?![A-Za-z])", t or "")) and m[1].lower()
    model = language_id.train(language_id.of_documents(docs).withColumn("declared", language_id.normal_tag(F.col("declared"))))
    names, scores = model.languages, model.scores([r[1] for r in rows])
    assert names == sorted(words)
    parts = [(tag(r[2]), *((h.split(".")[-1], h, ".".join(h.split(".")[-2:])) if (h := r[3]) and "." in h else (None, h, None))) for r in rows]
    guess = [int(s.argmax()) if s.any() else None for s in scores]
    count = lambda k, v: [sum(g == x and p[k] == v for g, p in zip(guess, parts)) for x in range(4)]
    of = lambda k: [sum(g == x and p[k] is not None for g, p in zip(guess, parts)) for x in range(4)]
    base = [(guess.count(x) + 1) / (sum(g is not None for g in guess) + 4) for x in range(4)]
    expected = Counter()
    for r, p, s, g in zip(rows, parts, scores, guess):
        if g is None:
            expected[r[0], "und", 0.0, False] += 1
            continue
        logs = list(s)
        host, site = (count(k, p[k]) if p[k] is not None else [0] * 4 for k in (2, 3))
        for x in range(4):
            above = (site[x] + 20 * base[x]) / (sum(site) + 20)
            logs[x] += np.log((host[x] + 20 * above) / (sum(host) + 20))
            for k in (0, 1):
                if p[k] is not None and sum(count(k, p[k])):
                    c = count(k, p[k])
                    logs[x] += np.log((c[x] + sum(c) / sum(of(k))) / (of(k)[x] + 1))
        best = int(np.argmax(logs))
        sure = 1 / sum(np.exp(v - logs[best]) for v in logs)
        expected[r[0], names[best], round(sure, 6), bool(sure >= 0.6)] += 1
    assert Counter((r.id, r.language, round(r.posterior, 6), r.kept) for r in got) == expected
    assert len({r.language for r in got}) == 5


def test_many_languages_and_values():
    assert language_id.cells_for(4) == language_id.cells_for(256) == 1 << 16
    assert all(language_id.cells_for(n) * n <= language_id.TABLE for n in (300, 1000, 18_252))
    raw = np.frombuffer(b"some bytes of text", np.uint8)
    assert (language_id.trigram_cells(raw, 512) == language_id.trigram_cells(raw) >> 7).all()


# 6 top-k


def brute_top_k(vectors, every, k):
    good = {i: np.floor(256 * np.array(v, np.float64)).astype(np.int64) for i, v in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = set()
    for q in good:
        if q % every == 0:
            best = sorted((-int(good[q] @ v), i) for i, v in good.items() if i != q)[:k]
            out |= {(q, r, i, -s) for r, (s, i) in enumerate(best, 1)}
    return out


@pytest.mark.parametrize("pivots, block", [(64, 4096), (3, 16), (16, 7)])
def test_top_k_like_brute_force(spark, pivots, block):
    rng = np.random.default_rng(pivots)
    centres = rng.normal(size=(8, 6)) * 3
    vectors = [(i, [float(np.float32(x)) for x in centres[i % 8] + rng.normal(size=6) * 0.2]) for i in range(300)]
    vectors += [(300 + i, [1.0] * 6) for i in range(40)] + [(400, None), (401, [None] * 6), (402, [float("nan")] * 6), (403, [float("inf")] * 6), (405, [0.0] * 6), (410, [-1.0] * 6)]
    table = spark.createDataFrame([(i, v, "x") for i, v in vectors], "vec_id bigint, embedding array<float>, cell string")
    got = knn_join.top_k(table, table.where("vec_id % 5 = 0"), 5, n_pivots=pivots, block=block).collect()
    assert {tuple(r) for r in got} == brute_top_k(vectors, 5, 5) and len(got) == len(set(got))


def test_query_groups_hold_all_queries():
    sizes = [3, 2, 9, 1, 1, 4, 0, 20]
    spans = knn_join.query_groups(sizes, 5)
    assert spans == [(0, 1), (0, 1), (1, 2), (3, 1), (3, 1), (4, 1), (4, 1), (5, 4)]


def test_top_k_of_few(spark):
    table = spark.createDataFrame([(0, [1.0]), (5, [2.0])], "vec_id bigint, embedding array<float>")
    assert {tuple(r) for r in knn_join.top_k(table, table, 5).collect()} == {(0, 1, 5, 256 * 512), (5, 1, 0, 256 * 512)}
    assert knn_join.top_k(table.limit(0), table.limit(0), 5).count() == 0
    big = spark.createDataFrame([(0, [1.0]), (1, [3e38]), (2, [-3e38])], "vec_id bigint, embedding array<float>")
    most, least = (1 << 63) - 1, -(1 << 63)
    assert {tuple(r) for r in knn_join.top_k(big, big, 5).collect()} == {(0, 1, 1, most), (0, 2, 2, least), (1, 1, 0, most), (1, 2, 2, least), (2, 1, 0, least), (2, 2, 1, least)}


def test_inner_products_of_any_size():
    rng = np.random.default_rng(1)
    for bits in (8, 20, 31, 40, 100):
        q, x = (np.floor(rng.normal(size=(9, 7)) * 2.0**bits) for _ in range(2))
        q[0], x[0] = x[1] * 2.0**70, 0
        q[1, :2], x[2, :2], q[1, 2:], x[2, 2:] = (2.0**90, -(2.0**90)), 2.0**90, 1, 3  # the large parts cancel
        exact = [[sum(int(a) * int(b) for a, b in zip(r, c)) for c in x.tolist()] for r in q.tolist()]
        assert knn_join.inner_products(q, x).tolist() == [[min(max(v, -(1 << 63)), (1 << 63) - 1) for v in line] for line in exact]


def test_top_k_of_large_components(spark):
    rng = np.random.default_rng(2)
    vectors = [(i, [float(np.float32(x)) for x in rng.normal(size=5) * 10.0 ** rng.integers(-1, 7)]) for i in range(200)]
    table = spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>")
    assert {tuple(r) for r in knn_join.top_k(table, table.where("vec_id % 5 = 0"), 5, block=50).collect()} == brute_top_k(vectors, 5, 5)


def test_bounds_prune_clusters_and_nothing_that_counts():
    """Share of (vector, query cell) pairs that go: most of them between clusters; the best are never among them."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16)) * 300
    x = np.floor(centres[rng.integers(40, size=4000)] + rng.normal(size=(4000, 16)) * 20)
    pivots, queries = x[:60], x[::50]
    cell = ((queries[:, None] - pivots) ** 2).sum(axis=2).argmin(axis=1)
    kth = np.sort(queries @ x.T, axis=1)[:, -5]
    length, angle = np.linalg.norm(queries, axis=1), knn_join.angles((queries * pivots[cell]).sum(axis=1), np.linalg.norm(queries, axis=1) * np.linalg.norm(pivots[cell], axis=1))
    of = {int(c): (1, np.linalg.norm(queries - pivots[c], axis=1)[cell == c].max(), length[cell == c].max(), angle[cell == c].max(), kth[cell == c].min(), 1) for c in set(cell)}
    cells = sorted(of)
    may = knn_join.may_reach(x, pivots, cells, of, {c: of[c][4] for c in cells})
    for q, c, least in zip(queries, cell, kth):
        assert may[:, cells.index(c)][x @ q >= least].all()
    assert may.mean() < 0.5


def test_top_k_of_repeated_ids(spark):
    rng = np.random.default_rng(6)
    vectors = [(i, [float(np.float32(x)) for x in rng.normal(size=4)]) for i in range(60)]
    vectors = [*vectors, *vectors[:20] * 7, *((5, [9.0 + i] * 4) for i in range(8))]
    table = spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>")
    good = sorted({(i, tuple(int(np.floor(256 * x)) for x in v)) for i, v in vectors})
    asked, expected = {}, set()
    for i, v in good:
        asked.setdefault(i, v)
    for q, v in asked.items():
        best = sorted((-sum(x * y for x, y in zip(v, w)), i) for i, w in good if i != q)[:5]
        expected |= {(q, r, i, -s) for r, (s, i) in enumerate(best, 1)}
    assert {tuple(r) for r in knn_join.top_k(table, table, 5, n_pivots=8, block=16).collect()} == expected


# 7 toxicity


def test_toxicity_held_out(spark):
    small = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    model = toxicity.train(docs, labels.where("doc_id % 4 <> 0"))
    truth = {r.doc_id: r.toxic for r in labels.where("doc_id % 4 = 0").collect()}
    rows = [r for r in toxicity.score(docs, model).collect() if r.doc_id in truth]
    clean, toxic = [r for r in rows if not truth[r.doc_id]], [r for r in rows if truth[r.doc_id]]
    assert np.mean([r.rejected for r in clean]) < 0.02
    assert np.mean([r.rejected for r in toxic]) > 0.6 and np.mean([r.severity for r in toxic]) > 5 * np.mean([r.severity for r in clean])
    assert all(0 <= r.severity <= 3 for r in rows)


def test_toxicity_odd_rows(spark):
    docs = frame(spark, [*ODD, *((100 + i, f"you idiot {i}") for i in range(10)), *((200 + i, f"nice thing {i}") for i in range(40))])
    labels = spark.createDataFrame([(100 + i, 1, 1) for i in range(10)] + [(200 + i, 1, 0) for i in range(40)] + [(None, 1, 1), (4, 1, None), (777, 1, 1)], "doc_id bigint, quality int, toxic int")
    model = toxicity.train(docs, labels)
    rows = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert rows[100].rejected and not rows[200].rejected and not rows[1].rejected and not rows[2].rejected
    kept = toxicity.keep_clean(docs, model)
    assert kept.count() == docs.count() - 10 and kept.columns == docs.columns
    none = toxicity.train(docs, labels.limit(0))
    assert toxicity.score(docs, none).where("rejected").count() == 0
    assert toxicity.score(docs.limit(0), none).count() == 0


def test_toxicity_keeps_the_mix_of_labels(spark, monkeypatch):
    docs = frame(spark, [*((100 + i, f"you idiot {i}") for i in range(10)), *((200 + i, f"nice thing {i}") for i in range(40))])
    labels = spark.createDataFrame([(100 + i, 1, 1) for i in range(10)] + [(200 + i, 1, 0) for i in range(40)], "doc_id bigint, quality int, toxic int")
    seen, fit = [], toxicity.CumulativeLink.fit
    monkeypatch.setattr(toxicity.CumulativeLink, "fit", lambda of, at, x, grades, *a, **k: seen.append((grades, k["weights"])) or fit(of, at, x, grades, *a, **k))
    toxicity.train(docs, labels, limit=8)
    (grades, weights), = seen
    assert len(grades) == 16 and np.isclose(weights[grades == 0].sum(), 40) and np.isclose(weights[grades > 0].sum(), 10)


def test_toxicity_of_graded_labels(spark):
    """Labels beyond 1 are toxic too, and are the grades."""
    texts = ["a nice day", "you fool", "you idiot", "you scoundrel"]
    rows = [(10 * i + g, f"{t} {i}", g) for g, t in enumerate(texts) for i in range(12 if g else 90)]
    docs = frame(spark, [r[:2] for r in rows])
    labels = spark.createDataFrame([(i, 1, g) for i, _, g in rows], "doc_id bigint, quality int, toxic int")
    rows = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert {(r.doc_id % 10, r.grade, r.rejected) for r in rows} == {(0, 0, False), (1, 1, True), (2, 2, True), (3, 3, True)}
    twos = labels.withColumn("toxic", F.when(F.col("toxic") > 0, 2).otherwise(0))
    assert toxicity.score(docs, toxicity.train(docs, twos)).where("rejected").count() == 36


def test_toxicity_block_like_plain_counts():
    import pyarrow as pa

    texts = ["Bad bads badly, GOOD!", "", "x1bad_bad\u00e9 \u00dcbel", None, "badlands " * 5]
    features = ["bad", "badl*", "bads", "\u00fcbel", "good"]
    of, at, x = toxicity.Vectoriser(features).block(pa.array([t or "" for t in texts]))
    expected = {}
    for i, t in enumerate(texts):
        words = "".join(c if c.isalpha() else " " for c in (t or "").lower()).split()
        held = Counter(f for w in words for f in [w, *(w[:n] + "*" for n in (4, 5, 6) if len(w) > n)])
        expected |= {(i, features.index(f)): np.log1p(n) for f, n in held.items() if f in features}
    assert dict(zip(zip(of.tolist(), at.tolist()), x.tolist())) == pytest.approx(expected)
    model = toxicity.CumulativeLink(np.arange(5) * 0.3, np.array([0.1, 0.2, 1.0]))
    for i, p in enumerate(model.predict(of, at, x, 5)):
        score = sum(0.3 * f * v for (t, f), v in expected.items() if t == i)
        below = [0, *(1 / (1 + np.exp(score - t)) for t in (0.1, 0.2, 1.0)), 1]
        assert p.tolist() == pytest.approx([b - a for a, b in zip(below, below[1:])])


def sparse(rows):
    """(row, feature, value) of rows of dictionaries."""
    found = [(i, f, v) for i, r in enumerate(rows) for f, v in r.items()]
    return tuple(np.array([f[k] for f in found], t) for k, t in enumerate((np.int64, np.int64, np.float64)))


def test_weights_stand_for_rows():
    clean, toxic = [{0: 1.0}] * 10 + [{}] * 90, [{0: 1.0}] * 80 + [{}] * 20
    bad = np.repeat([1, 2, 3], [34, 33, 33])
    whole = toxicity.CumulativeLink.fit(*sparse(clean * 4 + toxic), np.append(np.zeros(400, int), bad), 1, 4)
    part = toxicity.CumulativeLink.fit(*sparse(clean + toxic), np.append(np.zeros(100, int), bad), 1, 4, weights=np.repeat([4.0, 1.0], 100))
    shown = sparse([{0: 1.0}, {}])
    assert np.allclose(whole.predict(*shown, 2), part.predict(*shown, 2), atol=0.01)


def test_thresholds_are_ordered():
    rows = [{0: 1.0}] * 20 + [{}] * 60
    model = toxicity.CumulativeLink.fit(*sparse(rows), np.array([1, 2] * 10 + [0] * 60), 1, 4)
    assert list(model.thresholds) == sorted(model.thresholds)
    held, none = model.predict(*sparse([{0: 1.0}, {}]), 2)
    assert sum(held) == pytest.approx(1) and none[0] > 0.9 > held[0]


# 8 byte-level BPE


def test_byte_bpe_like_the_library(spark):
    rng = random.Random(8)
    alphabet = "ab aA'sdtll rem1234567   \n\t\r.,!=-éüß\xa0\x1c\x85 你好🙂́ǅ​"
    rows = [(1000 + i, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 120)))) for i in range(600)] + ODD
    bpe = byte_bpe.tokenizer(BYTES, public_tokenizers.PATTERN)
    encoder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    docs = frame(spark, rows)
    ids = {(r.doc_id, tuple(r.ids)) for r in byte_bpe.encode(docs, BYTES, public_tokenizers.PATTERN).collect()}
    assert ids == {(i, tuple(encoder.encode_ordinary(t or ""))) for i, t in rows}
    back = {(r.doc_id, bytes(r.bytes)) for r in byte_bpe.decode(byte_bpe.encode(docs, BYTES, public_tokenizers.PATTERN), BYTES, public_tokenizers.PATTERN).collect()}
    assert back == {(i, (t or "").encode()) for i, t in rows}
    for r in byte_bpe.digests(docs, BYTES, public_tokenizers.PATTERN).where("doc_id between 1 and 4").collect():
        text = dict(rows)[r.doc_id] or ""
        packed = np.array(encoder.encode_ordinary(text), "<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert byte_bpe.digests(docs.limit(0), BYTES, public_tokenizers.PATTERN).count() == 0


def test_every_space_splits_alike():
    bpe = byte_bpe.ByteBPE(BYTES, public_tokenizers.PATTERN)
    encoder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    import pyarrow as pa

    texts = [f"x{c}y{c}{c} {c}1 z{c}" for c in map(chr, [*range(0x250), *range(0x1670, 0x1690), *range(0x2000, 0x2070), 0x3000])]
    ids, counts = bpe.encode_block(pa.array([t.encode() for t in texts], pa.binary()))
    ends = np.cumsum(counts)
    assert [ids[e - n : e].tolist() for e, n in zip(ends, counts)] == [encoder.encode_ordinary(t) for t in texts]


# 9 urls


def brute_verdict(url):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = __import__("re").split(r"[/?#]", rest)[0]
        path = __import__("re").split(r"[?#]", rest[len(host) :])[0]
        host = host.translate({c: c + 32 for c in range(65, 91)})
    fits = [(r, v) for v, r in queries.URL_RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, *(max(fits, key=lambda f: len(f[0])) if fits else (None, None))


def test_url_rules_like_brute_force(spark):
    urls = [None, "", "nohost", "http://", "http://COM/en/", "https://a.example.com/en/7x?q", "http://example.com/en/8", "http://x.net/de/9", "http://example.net/de/8#a", "ftp://q.example.net/de/81", "http://b.org/es/", "http://borg/es/", "http://example.org/fr/1", "x://y://z/en/", "http://a.com?/en/", "http://a.com/EN/1"] * 3
    pages = spark.createDataFrame([(i % 40, u, None, "x") for i, u in enumerate(urls)], "page_id bigint, url string, html string, host string")
    rows = url_filter.judge(pages, queries.URL_RULES).collect()
    assert len(rows) == len(urls)
    expected = Counter((i % 40, *brute_verdict(u)[:3]) for i, u in enumerate(urls))
    assert Counter((r.page_id, r.host, r.path, r.rule) for r in rows) == expected
    known = {(brute_verdict(u)[0], brute_verdict(u)[1]): brute_verdict(u)[3] for u in urls}
    assert all(r.verdict == (known[r.host, r.path] or r.verdict) and r.verdict in ("allow", "block") for r in rows)
    assert url_filter.judge(pages.limit(0), queries.URL_RULES).count() == 0
    only = url_filter.judge(pages.where("url like '%org/es%'"), queries.URL_RULES).select("verdict").distinct().collect()
    assert [r.verdict for r in only] == ["block"]


def test_url_trees_held_out(spark):
    """Labels from a rule that the trees don't see must carry over to the rows without one."""
    rows = [(i, f"http://{'casino-win77' if i % 2 else 'news'}.example.{'com' if i % 3 else 'net'}/{'en' if i % 5 else 'fr'}/{i}") for i in range(600)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    rules = [("block", "casino-win77.example.com/en/"), ("allow", "news.example.com/en/")]
    open_rows = [r for r in url_filter.judge(pages, rules).collect() if r.rule is None]
    assert np.mean([(r.verdict == "block") == r.host.startswith("casino") for r in open_rows]) > 0.95


def test_url_suffix_share_leaves_the_own_label_out(spark, monkeypatch):
    """One labelled row a suffix: its share must say nothing of its label."""
    seen, real = [], url_filter.cut
    monkeypatch.setattr(url_filter, "cut", lambda df: seen.append(df) or real(df))
    pages = spark.createDataFrame([(i, f"http://h{i}.{'com' if i % 2 else 'net'}/{'en' if i % 2 else 'de'}/") for i in range(40)], "page_id bigint, url string")
    url_filter.judge(pages, [("block", "com/en/"), ("allow", "net/de/")]).collect()
    shares = {float(r.features[-1]) for r in seen[0].collect()}
    assert shares == {0.5}


# 10 packing


def test_packing_is_whole_and_tight(spark):
    rng = random.Random(10)
    rows = [(i, prose(rng, rng.randint(0, 900))) for i in range(400)] + ODD
    docs = frame(spark, rows)
    got = packing.pack_documents(docs, WORDS).collect()
    library = Tokenizer.from_file(WORDS)
    expected = Counter()
    for i, t in rows:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        for s in range(0, len(ids), 2048):
            expected[i, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == expected
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for held in by.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    assert sorted(by) == list(range(len(by)))
    total = sum(r.length for r in got)
    assert len(by) * 2048 <= total * 1.05 + 3 * 2048
    assert packing.pack_documents(frame(spark, []), WORDS).count() == 0


def test_sequences_hold_the_ids(spark, monkeypatch):
    rows = [(1000 + i, "word " * (40 * i)) for i in range(90)] + ODD
    texts = {i: t for i, t in rows}
    library, tokens = Tokenizer.from_file(WORDS), {}
    for i, t in texts.items():
        tokens[i] = [*library.encode(t or "", add_special_tokens=False).ids, 1]
    sequences = packing.pack_sequences(frame(spark, rows), WORDS).collect()
    for r in sequences:
        assert len(r.ids) <= 2048 and len(r.ids) == sum(p.length for p in r.pieces)
        for p in r.pieces:
            assert r.ids[p.offset : p.offset + p.length] == tokens[p.doc_id][p.start : p.start + p.length]
    assert sum(len(r.ids) for r in sequences) == sum(len(tokens[i]) for i, _ in rows)
    written, real = [], packing.cut
    monkeypatch.setattr(packing, "cut", lambda df: written.append(df.columns) or real(df))
    queries.op10_packing(spark, SMALL)
    assert ["sequence_id", "ids", "pieces"] in written


def test_packing_of_rows_that_repeat(spark):
    docs = frame(spark, [(None, "word")] * 900 + [(7, "one two")] * 300)
    got = packing.pack_documents(docs, WORDS).collect()
    assert Counter((r.doc_id, r.start) for r in got) == {(None, 0): 900, (7, 0): 300}
    held = sorted((r.sequence_id, r.offset, r.length) for r in got)
    assert all(a[0] != b[0] or a[1] + a[2] == b[1] for a, b in zip(held, held[1:])) and held[-1][0] == 1


def test_packing_of_short_texts_is_tight(spark):
    docs = frame(spark, [(i, None if i % 3 else "word") for i in range(6000)])
    sequences = packing.pack_sequences(docs, WORDS)
    assert sequences.count() == -(-sequences.agg(F.sum(F.size("ids"))).first()[0] // 2048)


def test_column_generation_covers_the_demand():
    sizes, demand = np.array([3, 5, 7, 11]), np.array([40, 1, 13, 9])
    used = packing.column_generation(sizes, demand, 16)
    assert (sum(p * n for p, n in used) == demand).all() and all((p * sizes).sum() <= 16 for p, _ in used)
    assert sum(n for _, n in used) <= np.ceil((sizes * demand).sum() / 16) + 4


def test_stored_sequences_hold_the_same_ids_as_bytes(spark):
    import pyarrow as pa

    parts = packing.cut(packing.pieces(frame(spark, [(i, "word two " * (37 * i)) for i in range(60)]), WORDS))
    lists = {r.sequence_id: (list(r.ids), r.pieces) for r in packing.pack(parts).collect()}
    stored = packing.pack(parts, stored=True).collect()
    assert len(stored) == len(lists)
    for r in stored:
        ids, pieces = lists[r.sequence_id]
        assert np.frombuffer(pa.decompress(bytes(r.ids), 4 * len(ids), packing.CODEC, asbytes=True), "<i4").tolist() == ids and r.pieces == pieces
    words = pa.array(["", "ab", "é", "", "xyz"])
    assert packing.sliced(words) == [w.encode() for w in words.to_pylist()] and packing.sliced(words[2:4]) == ["é".encode(), b""] and packing.sliced(words[:0]) == []
