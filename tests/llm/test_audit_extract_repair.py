"""Source divergence audit, HTML extraction and conversation repair against brute force and by hand."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from weftline.llm import conversation_repair, divergence, html_extract

# Conversation repair


def cheapest(rows):
    """(cost, audit, texts) over all edits of a few rows: (role, text, fault)."""
    empty = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]
    best = None
    choices = []
    for role, text, fault in rows:
        own = [("D", 3, None)]
        if fault not in (1, 2):
            flaw = fault == 3
            own += [("K", flaw, f"{role}:{text}"), ("R", 2 + flaw, f"user:{text}"), ("R", 2 + flaw, f"assistant:{text}")]
        choices.append(own)
    for picks in itertools.product(*choices):
        for gaps in itertools.product(empty, repeat=len(rows) + 1):
            cost = sum(p[1] for p in picks) + 2 * sum(map(len, gaps))
            if best and cost > best[0]:
                continue
            out, audit = [], ""
            for gap, pick in zip(gaps, [*picks, None], strict=True):
                out += [f"{name}:" for name in gap]
                audit += "I" * len(gap)
                if pick:
                    audit += pick[0]
                    out += [pick[2]] if pick[2] is not None else []
            if re.fullmatch("(s?(ua)+)?", "".join(x[:1] if x[0] != ":" else "-" for x in out)):
                best = min(best, (cost, audit, out)) if best else (cost, audit, out)
    return best


def test_repair_equals_all_edits():
    rng = random.Random(1)
    for n in [0, 1, 1, 1] + [2] * 25 + [3] * 12:
        rows = [(rng.choice(["system", "user", "assistant", "tool", "usr", " ", ""]), rng.choice(["a.", "b"]), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(n)]
        own = conversation_repair.Repair()
        for role, text, fault in rows:
            own.add(role.encode(), text.encode(), fault)
        cost, audit, out = cheapest(rows)
        assert own.end() == (cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()), rows


def damaged(rows):
    """The stated damage, conversation by conversation."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        act = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        here = out[conv]
        if act == 0:
            continue
        text = "" if act == 1 else re.sub("[.!?]", "", text) if act == 2 else text
        here += [(turn, "user" if act == 4 else role, text)] * (2 if act == 3 else 1)
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c, v in out.items()}


def judged(rows):
    seen, out, white = set(), [], "[\x20\x09-\x0d]"
    for _, role, text in rows:
        fault = 1 if not re.sub(white, "", text) else 2 if (role, text) in seen else 3 if re.sub(white, "", text)[-1] not in ".!?" else 0
        seen.add((role, text))
        out.append((role, text, fault))
    return out


SCHEMA = "conv_id bigint, turn bigint, role string, text string, fault string, dropped int, gaps int, seen double"


def test_repair_of_odd_tables(spark):
    rng = random.Random(2)
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rng.randint(0 if conv is None else 1, 4)):
            rows.append((conv, rng.choice([turn, turn, turn + 3, None]), rng.choice(["system", "user", "assistant", None, "é"]), rng.choice(["Ja.", "so", None, "", " \t", "x? \n", "ü!"])))
    rows += rows[:10]
    table = spark.createDataFrame([(*r, "x", 1, 2, 0.5) for r in rows], SCHEMA).repartition(3)
    found = {r.conv_id: r for r in conversation_repair.repair(conversation_repair.damage(table), "dropped").collect()}
    expected = damaged(rows)
    assert found.keys() == expected.keys()
    for conv, turns in expected.items():
        r, own = found[conv], judged(turns)
        known = [t for t, *_ in turns if t is not None]
        assert r.gaps == (max(known) - min(known) + 1 - len(set(known)) if known else 0)
        assert (r.blank, r.duplicate, r.truncated) == tuple(sum(f == k for *_, f in own) for k in (1, 2, 3))
        assert r.illegal == sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        if len(own) <= 3:
            cost, audit, out = cheapest(own)
            assert (r.cost, r.audit, r.repaired_sha256) == (cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def test_repair_of_empty_and_dropped_and_long(spark):
    table = spark.createDataFrame([], SCHEMA)
    assert conversation_repair.repair(conversation_repair.damage(table), "dropped").count() == 0
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    table = spark.createDataFrame([(gone, 0, "user", "Ja.", None, 0, 0, 0.0)], SCHEMA)
    (row,) = conversation_repair.repair(conversation_repair.damage(table), "dropped").collect()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    long = spark.range(30_000).selectExpr("7L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat(id, repeat(' x', 20), '.') as text")
    (row,) = conversation_repair.repair(long).collect()
    assert (row.cost, row.audit) == (0, "K" * 30_000)


# Source divergence audit


def share(count, total):
    return 1 + 1_000_000_000 * (count + 1) // total


def audited(rows):
    """(lang, source, part, item, value, rank) by the definition."""
    docs = [("" if lang is None else lang, "" if source is None else source, [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(w for d in own for w in set(d[2]))
        kept = {w for w, n in df.items() if n >= 3}
        counts = {s: Counter(w for d in own if d[1] == s for w in d[2] if w in kept) for s in {d[1] for d in own}}
        p = {s: {w: share(c[w], c.total() + len(kept)) for w in kept} for s, c in counts.items()}
        whole = sum(counts.values(), Counter())
        q = {w: share(whole[w], whole.total() + len(kept)) for w in kept}
        for s in counts:
            pairs = [(-sum((p[s][w] - p[o][w]) ** 2 // p[o][w] for w in kept), o.encode()) for o in counts if o != s]
            terms = [(-((p[s][w] - q[w]) ** 2 // q[w]), w.encode()) for w in kept if counts[s][w] and p[s][w] > q[w]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:200])):
                out += [(lang, s, part, item.decode(), -value, k) for k, (value, item) in enumerate(items, 1)]
    return sorted(out)


def documents(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, source string, block int, term string")


@pytest.mark.parametrize("sides", [2, 512])
def test_divergence_equals_definition(spark, monkeypatch, sides):
    monkeypatch.setattr(divergence, "SOURCES", sides)
    monkeypatch.setattr(divergence, "POSTINGS", 40)
    rng = random.Random(3)
    words = [f"w{c}" for c in "abcdefghijklmnop"] + ["Über", "ÜBER", "naïve", "The", "the", " ", "x", "日本"]
    rows = []
    for _ in range(150):
        text = None if rng.random() < 0.03 else "".join(rng.choice(words) + rng.choice([" ", ", ", "7", "_", "\x7f", "\n"]) for _ in range(rng.randint(0, 25)))
        rows.append((text, rng.choice(["en", "en", "en", "de", None]), rng.choice(["a", "a", "a", "b", "c", "é", None, "z"])))
    rows += [("only twice here", "fr", "a"), ("twice", "fr", "b"), ("", "it", "a"), (None, None, None), rows[0], rows[0]]
    found = sorted(tuple(r) for r in divergence.audit(documents(spark, rows).repartition(5)).collect())
    assert found == audited(rows)


def test_divergence_of_more_than_200_terms_and_of_nothing(spark):
    assert divergence.audit(documents(spark, [])).count() == 0
    letters = "abcdefghijklmnopqrst"
    vocabulary = [x + y for x in letters for y in letters]
    rows = [(" ".join(vocabulary[k:]), "en", s) for k, s in enumerate("abcabcabc")] + [(" ".join(vocabulary[:300] * 3), "en", "d")]
    found = sorted(tuple(r) for r in divergence.audit(documents(spark, rows)).collect())
    assert found == audited(rows)
    assert max(r[5] for r in found if r[2] == "term") == 200


# HTML extraction

CLUTTERED = """<!doctype html><html lang=en><head><title>T &amp; t</title><style>p{}</style></head><body class="has-sidebar">
<header class="site-header"><h1>Site</h1></header><nav class=menu><ul><li><a href=/a>A</a></ul></nav>
<div class="cookie-notice"><p>We use cookies, a lot of them, more than anybody needs to know about.</p></div>
<div id="page"><div class="post-%d post"><header><h2>Title &lt;%d&gt;</h2></header><p>First&nbsp;para
   with <b>bold<p>Second &amp;amp; third<br>line &copy; &am
<div class="ad banner-3">Buy!</div><ul><li>one<li>two</ul><table><tr><td>x<td>y</table><script>var p = "</p>";</script>
<form><p>mail</p><input name=q></form><footer>tags</footer></div>
<div class="sidebar"><p>Side text that is quite long, so that it looks like something to read.</p></div>
<section id="comments"><article class="comment"><p>I disagree</p></article></section></div>
<footer>&copy; x</footer></body></html>"""


def test_clutter_goes_and_blocks_stay(spark):
    pages = spark.createDataFrame([(k, "http://h.example/%d" % k, CLUTTERED % (k, k), "x", "y") for k in range(3)], "page_id bigint, url string, html string, host string, path string")
    for r in html_extract.extract(pages).collect():
        assert r.text == f"Title <{r.page_id}>\nFirst para with bold\nSecond &amp; third line © &am\none\ntwo\nx\ny"
        assert r.n_chars == len(r.text)


def test_the_host_decides(spark):
    """A page with a short article and a long unnamed box follows its host; alone, it would not."""
    page = "<html><body><div class=x1><p>{}</p></div><div class=zone><p>{}</p></div></body></html>"
    rows = [(k, "https://A.example/p?%d" % k, page.format("Real text of the page. " * 20, "Short zone.")) for k in range(6)]
    odd = page.format("Brief.", "Long clutter without a telling name. " * 9)
    rows += [(10, "https://a.EXAMPLE/q", odd), (11, "https://other.example/", odd), (12, None, odd), (13, "no host", odd)]
    found = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert found[10] == "Brief."
    assert found[11] == found[12] == found[13] == ("Long clutter without a telling name. " * 9).strip()
    assert all(found[k] == ("Real text of the page. " * 20).strip() for k in range(6))


def test_odd_pages(spark):
    odd = {
        "": "", None: "", "plain &lt;text&gt;": "plain <text>", "<p>a<p>b</p></div></p>c": "a\nb\nc", "a < b <3 c": "a < b <3 c",
        "<article>x": "x", "<article></article><div>elsewhere</div>": "elsewhere", "<div><script>never ends": "", "<p>x<!-- open": "x", "x<div class=\"": "x",
        "<article><p>" + "long words " * 200_000 + "</p></article>": ("long words " * 200_000).strip(),
        "<div>" * 3000 + "deep": "deep", "<a title='>'>q</a>": "q", "<main><p>m</p><aside>n</aside></main>": "m",
    }
    rows = [(k, f"http://h{k}.example/", html) for k, html in enumerate(odd)] * 2
    table = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    found = html_extract.extract(table).collect()
    assert len(found) == len(rows)
    assert {(r.page_id, r.text, r.n_chars) for r in found} == {(k, text, len(text)) for k, text in enumerate(odd.values())}
    assert html_extract.extract(table.limit(0)).count() == 0
    broken = table.limit(1).selectExpr("page_id", "url", "cast(X'3C703E61FF62' as string) as html")
    assert [r.text for r in html_extract.extract(broken).collect()] == ["a�b"]
