"""Main text of web pages by host consensus.

Each page's containers are scored by the text that stands in them, near and outside links;
a page votes, in shares of its scores, for generalised paths of tags and classes (digits in
class names are all one). Spark adds the votes up by host, and each page is extracted again
with its host's winning path, so a page whose own evidence misleads (a short article, long
clutter) follows the pages around it. A page that lacks the path, or has no host, goes by
its own best container; where nothing was scored, all that isn't clutter is its text.

Clutter goes in any case: menus, page headers (a header within an article stays), footers,
sidebars, notices, adverts, forms, scripts, styles and reader comments, told by element,
role, and words of class and id. Blocks (paragraphs, headings, list items, cells, ...) come
in page order, joined by one newline; a line break is white space. White space is what
Unicode calls so, no-break space too. Character references are decoded as browsers do.

Null html counts as empty and gives an empty text; a null url has no host; broken markup
and bytes that aren't UTF-8 (replaced) never fail; repeated rows each give a row; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm._common import blocks, cut

TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>"']|"[^"]*"|'[^']*')*+)>|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^>]*(?:>|\Z)""",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)

# Elements of the HTML standard by their part on a page.
RAW = frozenset("script style noscript template iframe object svg canvas math title textarea xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLUTTER = frozenset("head nav aside footer form button select menu dialog datalist fieldset".split())
LINES = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre dt dd td th tr caption figcaption figure ul ol dl table thead tbody tfoot address summary hr".split())
CONTAINERS = frozenset("body div section article main center details header html hgroup".split())
#: An element that opens ends these, searching up to the bounds beside them.
ENDS = {
    "li": (("li",), ("ul", "ol")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
}
ROLES = frozenset("navigation banner complementary contentinfo search form dialog alert alertdialog menu menubar".split())
WORDS = frozenset(
    "nav navbar navigation menu submenu breadcrumb breadcrumbs pagination pager toolbar "
    "masthead topbar footer colophon copyright sidebar aside widget widgets "
    "notice notices cookie cookies consent gdpr banner alert popup modal overlay newsletter subscribe "
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion "
    "form login signup comment comments commentlist discussion respond reply replies disqus".split()
)
GOOD = frozenset("article content post entry main story body text".split())

BEST = 2.0  # weight of an article or main element
HINTED = 1.5  # of a class or id that speaks of content
DECAY = 0.5  # for each container between a text and the one that is scored
LEAST_SHARE = 0.1  # of a page's score that a path needs for a vote
LIFT = 0.25  # a container gives way to its parent that has text of its own and adds at most this much
VOTE = 1_000_000
HELD = 100_000


class Page:
    """The containers of a page and the blocks of text in them, without clutter."""

    def __init__(self, html: str):
        self.parent, self.path, self.weight = [-1], [""], [1.0]
        #: Blocks: container, text, characters in links.
        self.blocks: list[tuple[int, str, int]] = []
        self._read(html)

    def _read(self, html: str) -> None:
        # An open element: its name, container, whether it is clutter, whether it is content.
        stack: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]
        parts: list[str] = []
        linked, in_link, at, size = 0, False, 0, len(html)

        def flush():
            nonlocal linked
            if parts:
                if text := " ".join("".join(parts).split()):
                    self.blocks.append((stack[-1][1], text, linked))
                parts.clear()
            linked = 0

        while at < size:
            found = TAG.search(html, at)
            stop = found.start() if found else size
            if stop > at and not stack[-1][2]:
                piece = unescape(html[at:stop])
                parts.append(piece)
                linked += len(piece) if in_link else 0
            if not found:
                break
            at = found.end()
            name = (found["name"] or "").lower()
            if not name:
                continue
            if found["end"]:
                if name == "a":
                    in_link = False
                elif name == "br":
                    parts.append(" ")
                else:
                    k = len(stack) - 1
                    while k and stack[k][0] != name and (name not in LINES or stack[k][0] not in CONTAINERS):
                        k -= 1
                    if k and stack[k][0] == name:
                        if any(x[0] in LINES or x[0] in CONTAINERS or "-" in x[0] for x in stack[k:]):
                            flush()
                        del stack[k:]
                continue
            if name in RAW:
                ends = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.IGNORECASE).search(html, at) if not found["rest"].endswith("/") or name not in ("svg", "math") else None
                if not found["rest"].endswith("/") or ends:
                    at = ends.end() if ends else size
                parts.append(" ")
                continue
            if name in VOID:
                if name == "br":
                    parts.append(" ")
                elif name == "hr":
                    flush()
                continue
            if name == "a":
                in_link = True
                continue
            line, box = name in LINES, name in CONTAINERS or "-" in name or name in CLUTTER
            attributes = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(found["rest"])} if "=" in found["rest"] else {}
            if name in ("body", "html"):
                if len(stack) > 1 and stack[-1][0] == "head":
                    flush()
                    stack.pop()
                continue
            if line or box:
                flush()
                self._close(stack, name)
            inside = stack[-1]
            classes = attributes.get("class", "").split()
            words = {w for c in [*classes, attributes.get("id", "")] if not c.startswith(("has-", "with-", "no-")) for w in re.findall("[a-z]+", c.lower())}
            clutter = inside[2] or name in CLUTTER or attributes.get("role", "").lower() in ROLES or (name != "main" and bool(words & WORDS) and not (name == "article" and "comment" not in words and "comments" not in words))
            content = inside[3] or name in ("article", "main") or bool(words & GOOD)
            if not content and (name == "header" or "header" in words):
                clutter = True
            if box and not clutter:
                label = ".".join([name, *sorted({re.sub(r"\d+", "0", c) for c in classes})])
                self.parent.append(inside[1])
                self.path.append(f"{self.path[inside[1]]}>{label}")
                self.weight.append(BEST if name in ("article", "main") else HINTED if words & GOOD else 1.0)
                stack.append((name, len(self.parent) - 1, False, content))
            elif line or box or clutter != inside[2]:
                stack.append((name, inside[1], clutter, content))
        flush()

    @staticmethod
    def _close(stack, name: str) -> None:
        """End the elements that can't hold the one that opens."""
        ends, bounds = ENDS.get(name, ((), ()))
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in bounds or (stack[k][0] in CONTAINERS and stack[k][0] not in ends):
                break
            if stack[k][0] in ends or stack[k][0] == "p":
                del stack[k:]

    def votes(self) -> dict[str, tuple[int, int]]:
        """Paths with the share of the page's score that they have and their characters."""
        own, score, near = [0.0] * len(self.parent), [0.0] * len(self.parent), [0.0] * len(self.parent)
        for node, text, linked in self.blocks:
            own[node] += max(0, len(text) - 2 * linked)
        whole = list(own)
        for node in range(len(self.parent) - 1, 0, -1):
            near[node] += own[node]
            score[node] = near[node] * self.weight[node]
            near[self.parent[node]] += DECAY * near[node]
            whole[self.parent[node]] += whole[node]
        by_path, chars = defaultdict(float), defaultdict(float)
        for node in range(1, len(self.parent)):
            by_path[self.path[node]] += score[node]
            chars[self.path[node]] += whole[node]
        total = sum(by_path.values())
        if not total:
            return {}
        lifted = defaultdict(lambda: (0, 0))
        above = {self.path[n]: self.path[self.parent[n]] for n in range(1, len(self.parent))}
        speaks = {self.path[n] for n in range(1, len(self.parent)) if own[n]}
        for path, s in by_path.items():
            if s >= LEAST_SHARE * total:
                up = path
                while (up := above[up]) and up in speaks and chars[up] <= (1 + LIFT) * chars[path]:
                    path = up
                vote, n = lifted[path]
                lifted[path] = (vote + int(VOTE * s / total), max(n, int(chars[path])))
        return lifted

    def text(self, path: str | None) -> str:
        """All blocks under the path; under the page's own best where it has no such path, or none is given."""
        if path is None or path not in self.path[1:]:
            votes = self.votes()
            path = min(votes, key=lambda p: (-votes[p][0], -votes[p][1], p)) if votes else None
        if path is None:
            return "\n".join(text for _, text, _ in self.blocks)
        inside = [False] * len(self.parent)
        for node in range(1, len(self.parent)):
            inside[node] = inside[self.parent[node]] or self.path[node] == path
        return "\n".join(text for node, text, _ in self.blocks if inside[node])


def host(url: F.Column) -> F.Column:
    """What follows the first ``://`` up to a slash, question mark or hash, lower-cased; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^.*?://([^/?#]*)", 1))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of (page_id, url, html).

    The votes of a host are added up before they are shuffled; the winners, a row a host,
    are written, so Spark knows their size: it sends them to the pages' tasks if they are
    small, and else joins by host, splitting a host that holds too many pages.
    """
    rows = pages.select("page_id", "url", host(F.col("url")).alias("host"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("html"))
    cast = rows.where("host <> ''").select("host", "html").mapInArrow(_cast, "host string, path string, votes bigint, chars bigint")
    tallied = cast.groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.sum("chars").alias("chars"))
    best = F.min(F.struct((-F.col("votes")).alias("v"), (-F.col("chars")).alias("c"), F.col("path").alias("path"))).getField("path")
    winners = cut(tallied.groupBy(F.col("host").alias("_host")).agg(best.alias("path")))
    met = rows.join(winners, F.col("host") == F.col("_host"), "left").select("page_id", "url", "path", "html")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    found = met.mapInArrow(_extracted, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
    return found.withColumn("n_chars", F.length("text").cast("bigint"))


def _cast(batches):
    """Votes by host and path, added up as far as memory allows."""
    import pyarrow as pa

    def rows():
        keys, sums = list(held), list(held.values())
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([s[0] for s in sums], pa.int64()), pa.array([s[1] for s in sums], pa.int64())], names=["host", "path", "votes", "chars"])

    held: dict[tuple[str, str], list[int]] = {}
    for whole in batches:
        for batch in blocks(whole, "html", 4 << 20):
            for name, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                for path, (vote, chars) in Page(html.decode("utf-8", "replace")).votes().items():
                    sums = held.setdefault((name, path), [0, 0])
                    sums[0] += vote
                    sums[1] += chars
            if len(held) >= HELD:
                yield rows()
    yield rows()


def _extracted(batches):
    import pyarrow as pa

    for whole in batches:
        for batch in blocks(whole, "html", 4 << 20):
            texts = [Page(html.decode("utf-8", "replace")).text(path) for html, path in zip(batch.column("html").to_pylist(), batch.column("path").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])
