"""Source divergence audit: how far each source's words stray from the others of its language.

Pass one finds exact document frequencies: texts are normalised once (terms are runs of
ASCII letters, lower-cased, and of anything beyond ASCII), dealt into blocks of one
language and a bounded number of bytes, and written; each block gives out its distinct
terms with the number of documents that hold them. A language keeps the terms that at least
``LEAST`` of its documents hold.

Pass two recounts occurrences: a block meets its own kept terms, whose number its bytes
bound, whatever the vocabulary has grown to, and an Aho-Corasick automaton over these terms,
padded with delimiters, counts them in each source's texts.

The counts are postings (term, source, count). Shares of terms that a source lacks are all
equal, so pairs of sources are summed from postings alone: what one side's terms add against
the other's absent ones follows from the distinct counts, and only terms that both sides
hold are looked at pair by pair, inside tasks that each take one block of terms and two
blocks of sources. All arithmetic is in 64-bit integers.

Nulls in text, lang and source count as empty; every row is a document, repeated or not;
an empty table gives no rows; a language that keeps no term has pairs of value 0 and no
terms; extra columns are ignored; texts are bytes, valid UTF-8 or not.
"""

from __future__ import annotations

import itertools
from collections import Counter
from operator import itemgetter

from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm._common import blocks, cut, release

LEAST = 3
SCALE = 1_000_000_000
TOP_TERMS = 200
BLOCK_BYTES = 32 << 20  # of one language's text; an automaton holds the kept terms of one block
HELD_BYTES = 16 << 20  # of text that a task holds before it packs it
HELD_TERMS = 1 << 20  # distinct terms that a task of pass one holds before it gives them out
POSTINGS = 50_000  # of a task that sums pairs, or as many as it has pairs
SOURCES = 512  # a side of such a task
HELD_SHARES = 1 << 12
EXPANDED = 1 << 21  # co-occurring pairs that it looks at in one go

#: Letters stay, lower-cased, as do bytes beyond ASCII; anything else parts terms.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def audit(documents: DataFrame, least: int = LEAST, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): other sources by divergence, and terms that are too frequent.

    Part ``pair``: every other source of the language, by the summed divergence from it.
    Part ``term``: the ``top`` terms whose share is above the language's, by divergence.
    """
    docs = documents.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    texts = cut(docs.mapInArrow(_normalised, "block bigint, lang string, source string, text binary"))
    found = cut(texts.mapInArrow(_document_frequencies, "block bigint, lang string, term binary, docs bigint"))
    same = Window.partitionBy("term", "lang")  # a row a block that holds the term; sorts compare the first key fastest
    numbered = found.withColumn("id", F.monotonically_increasing_id())
    summed = numbered.withColumns({"everywhere": F.sum("docs").over(same), "tid": F.min("id").over(same)}).where(F.col("everywhere") >= least)
    own = cut(summed.select("block", "lang", "term", "tid", (F.col("id") == F.col("tid")).alias("first")))
    kept = own.where("first").select("lang", "term", "tid")
    counted = texts.groupBy("block").cogroup(own.select("block", "term", "tid").groupBy("block")).applyInArrow(_recount, "lang string, source string, tid bigint, n bigint")
    postings = cut(counted.groupBy("lang", "source", "tid").agg(F.sum("n").alias("n")))
    groups = _groups(docs, kept, postings)
    return _pairs(postings, groups).unionByName(_terms(postings, kept, groups, top))


def _normalised(batches):
    """Documents as their terms between single spaces, packed by language and source; a language's block ends at ``BLOCK_BYTES``.

    A row holds the documents of one source, a newline between two, compressed: it is
    read twice and shuffled once.
    """
    import pyarrow as pa
    import zstandard

    def rows():
        keys, packed = list(held), [press.compress(b"\n".join(texts)) for texts in held.values()]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.string()), pa.array([k[2] for k in keys], pa.string()), pa.array(packed, pa.binary())], names=["block", "lang", "source", "text"])

    task, made, open_blocks, held, size = TaskContext.get().partitionId() << 32, itertools.count(), {}, {}, 0
    press = zstandard.ZstdCompressor(level=3)
    for whole in batches:
        for batch in blocks(whole, "text", 4 << 20):
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                plain = b" " + b" ".join(text.translate(PLAIN).split()) + b" "
                block, full = open_blocks.get(lang, (None, BLOCK_BYTES))
                if full >= BLOCK_BYTES:
                    block, full = task + next(made), 0
                open_blocks[lang] = (block, full + len(plain))
                held.setdefault((block, lang, source), []).append(plain)
                size += len(plain)
            if size >= HELD_BYTES:
                yield rows()
                size = 0
                release()
    yield rows()


def _unpacked(batch):
    """(block, lang, source, texts) of packed rows, one row at a time."""
    import zstandard

    press = zstandard.ZstdDecompressor()
    for row in zip(*(batch.column(c) for c in ("block", "lang", "source", "text")), strict=True):
        block, lang, source, text = (x.as_py() for x in row)
        yield block, lang, source, press.decompress(text)


def _document_frequencies(batches):
    """Distinct terms by block with the number of documents that hold them; a pair may come in several rows."""
    import pyarrow as pa

    def rows():
        for (block, lang), terms in held.items():
            for some in itertools.batched(terms.items(), 100_000):
                n = len(some)
                yield pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int64()), pa.array([lang] * n, pa.string()), pa.array([x[0] for x in some], pa.binary()), pa.array([x[1] for x in some], pa.int64())], names=["block", "lang", "term", "docs"])
        held.clear()
        release()

    held: dict[tuple, Counter] = {}
    for batch in batches:
        for block, lang, _, texts in _unpacked(batch):
            count = held.setdefault((block, lang), Counter())
            for text in texts.split(b"\n"):
                count.update(set(text.split()))
            if sum(map(len, held.values())) > HELD_TERMS:
                yield from rows()
    yield from rows()


def _recount(key, texts, terms):
    """Occurrences of a block's kept terms by source, by an automaton over the padded terms."""
    import ahocorasick
    import numpy as np
    import pyarrow as pa

    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("tid", pa.int64()), ("n", pa.int64())])
    if not texts.num_rows or not terms.num_rows:
        return schema.empty_table()
    automaton, tids = ahocorasick.Automaton(ahocorasick.STORE_INTS), terms["tid"].to_numpy()
    for k, term in enumerate(terms["term"].to_pylist()):
        automaton.add_word(f" {term.decode('latin-1')} ", k)  # a byte is a letter of the automaton
    automaton.make_automaton()
    counts: dict[tuple, np.ndarray] = {}
    for batch in texts.to_batches():
        for _, lang, source, text in _unpacked(batch):
            found = np.fromiter(map(itemgetter(1), automaton.iter(text.decode("latin-1"))), np.int64)
            occurring = np.bincount(found, minlength=len(tids))
            counts[lang, source] = counts[lang, source] + occurring if (lang, source) in counts else occurring
    out = []
    for (lang, source), n in counts.items():
        held = np.flatnonzero(n)
        names = [pa.array([name], pa.string()).take(pa.array(np.zeros(len(held), np.int64))) for name in (lang, source)]
        out.append(pa.table([*names, pa.array(tids[held]), pa.array(n[held])], schema=schema))
    release()
    return pa.concat_tables(out)


def _groups(docs: DataFrame, kept: DataFrame, postings: DataFrame) -> DataFrame:
    """Every (lang, source) with its occurrences ``total``, the language's ``words`` and occurrences, and how its work is dealt."""
    totals = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("held"))
    of = cut(docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").fillna(0, ["total", "held"]))
    langs = of.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.ceil(F.sum("held") / F.greatest(F.lit(POSTINGS), F.least(F.count("*"), F.lit(SOURCES)) * F.least(F.count("*"), F.lit(SOURCES)))).alias("deals"), F.ceil(F.count("*") / SOURCES).alias("sides"))
    words = kept.groupBy("lang").agg(F.count("*").alias("words"))
    sized = langs.join(words, "lang", "left").fillna(0, ["words"]).withColumn("deals", F.greatest("deals", F.lit(1)))
    side = F.pmod(F.xxhash64("source"), F.col("sides")).alias("side")
    return cut(of.join(sized, "lang").select("lang", "source", "total", "words", "lang_total", "deals", "sides", side))


def _dealt(rows: DataFrame, *columns) -> DataFrame:
    """Rows of a source stand in every task that has its block on the left or on the right."""
    i, j = F.struct(F.col("side").alias("i"), F.col("x").alias("j")), F.struct(F.col("x").alias("i"), F.col("side").alias("j"))
    both = rows.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("sides") - 1))).withColumn("at", F.explode(F.array_distinct(F.array(i, j))))
    dealt = both.select("lang", "deal", F.col("at.i").alias("i"), F.col("at.j").alias("j"), "side", "source", *columns)
    return dealt.withColumn("task", F.xxhash64("lang", "deal", "i", "j"))  # sorts compare the first key fastest


def _pairs(postings: DataFrame, groups: DataFrame) -> DataFrame:
    key = ["task", "lang", "deal", "i", "j"]
    held = postings.join(groups, ["lang", "source"]).withColumn("deal", F.pmod(F.xxhash64("tid"), F.col("deals")))
    there = groups.select(*(F.col(c).alias(c) for c in groups.columns)).withColumn("deal", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("deals") - 1)))
    left, right = _dealt(held, "tid", "n"), _dealt(there, "total", "words")
    sums = right.groupBy(*key).cogroup(left.groupBy(*key)).applyInArrow(_divergence, "lang string, source string, item string, value bigint")
    pairs = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def shares(counts, totals):
    """1 + floor(SCALE * (count + 1) / total) in 64-bit integers, three digits at a time."""
    rest, out = counts + 1, 0 * totals
    for _ in range(3):
        out, rest = out * 1000 + rest * 1000 // totals, rest * 1000 % totals
    return out + 1


def _f(p, q):
    return (p - q) * (p - q) // q


def _divergence(key, groups, postings):
    """What one block of terms adds to the divergence of each source on the left from each on the right."""
    import numpy as np
    import pyarrow as pa

    _, lang, deal, i, j = (k.as_py() for k in key)
    names, side = np.array(groups["source"].to_pylist(), dtype=object), groups["side"].to_numpy()
    total, words = groups["total"].to_numpy(), int(groups["words"][0].as_py())
    at = {name: k for k, name in enumerate(names)}
    a, b = np.flatnonzero(side == i), np.flatnonzero(side == j)
    value = np.zeros((len(a), len(b)), np.int64)
    if words:
        sizes = total + words
        absent = shares(np.zeros(len(names), np.int64), sizes)
        nowhere = _f(absent[a][:, None], absent[b][None, :])
        coded = postings["source"].combine_chunks().dictionary_encode() if postings.num_rows else None
        if coded is not None:
            coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
            source = np.array([at[x] for x in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()]
            tid, p = postings["tid"].to_numpy(), shares(postings["n"].to_numpy(), sizes[source])
            rank = np.full(len(names), -1)
            rank[a] = np.arange(len(a))
            on_left = np.flatnonzero(rank[source] >= 0)
            left = (tid[on_left], rank[source[on_left]], p[on_left])
            rank = np.full(len(names), -1)
            rank[b] = np.arange(len(b))
            on_right = np.flatnonzero(rank[source] >= 0)
            right = (tid[on_right], rank[source[on_right]], p[on_right])
            for s, q, times in _distinct(left):
                np.add.at(value, s, times[:, None] * (_f(q[:, None], absent[b][None, :]) - nowhere[s]))
            for s, q, times in _distinct(right):
                np.add.at(value.T, s, times[:, None] * (_f(absent[a][None, :], q[:, None]) - nowhere.T[s]))
            for x, y in _shared(left, right):
                s, t = left[1][x], right[1][y]
                p, q, p0, q0 = left[2][x], right[2][y], absent[a][s], absent[b][t]
                np.add.at(value, (s, t), _f(p, q) - _f(p, q0) - _f(p0, q) + _f(p0, q0))
        if deal == 0:
            value += words * nowhere
    s, t = np.meshgrid(np.arange(len(a)), np.arange(len(b)), indexing="ij")
    other = a[s] != b[t]
    return pa.table({"lang": pa.array([lang] * int(other.sum()), pa.string()), "source": pa.array(names[a[s][other]], pa.string()), "item": pa.array(names[b[t][other]], pa.string()), "value": pa.array(value[other], pa.int64())})


def _distinct(rows):
    """Sources, shares and the number of terms that have both, some at a time."""
    import numpy as np

    (source, share), times = np.unique(np.stack(rows[1:]), axis=1, return_counts=True)
    for k in range(0, len(times), HELD_SHARES):
        some = slice(k, k + HELD_SHARES)
        yield source[some], share[some], times[some]


def _shared(left, right):
    """Positions of the terms that both sides hold, so many pairs at a time."""
    import numpy as np

    order = np.argsort(right[0], kind="stable")
    terms = right[0][order]
    first = np.searchsorted(terms, left[0])
    n = np.searchsorted(terms, left[0], side="right") - first
    ends = np.cumsum(n)
    start = 0
    while start < len(n):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + EXPANDED, side="right")))
        k = n[start:stop]
        x = np.repeat(np.arange(start, stop), k)
        y = np.arange(len(x)) - np.repeat(np.cumsum(k) - k, k) + np.repeat(first[start:stop], k)
        yield x, order[y]
        start = stop


def _share(count: F.Column, total: str) -> F.Column:
    """``shares`` as a column; the total is a column's name."""
    rest, out = count + F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    for _ in range(3):
        out, rest = out * 1000 + F.call_function("div", rest * 1000, F.col(total)), rest * 1000 % F.col(total)
    return out + 1


def _terms(postings: DataFrame, kept: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    everywhere = F.sum("n").over(Window.partitionBy("tid"))  # a row a source that holds the term
    of = postings.withColumn("everywhere", everywhere).join(groups, ["lang", "source"])
    of = of.withColumn("size", F.col("total") + F.col("words")).withColumn("lang_size", F.col("lang_total") + F.col("words"))
    of = of.withColumn("p", _share(F.col("n"), "size")).withColumn("q", _share(F.col("everywhere"), "lang_size")).where("p > q")
    of = of.select("lang", "source", "tid", "p", "q").join(kept.select("tid", "term"), "tid")
    judged = of.select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))
    order = Window.partitionBy("source", "lang").orderBy(F.desc("value"), "item")
    return judged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
