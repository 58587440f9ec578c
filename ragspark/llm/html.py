"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut at block-level tags into leaf blocks of text, each with its ancestors' tags, the words of their class and id
attributes, and figures of its text. The field has two labels, weights of features and of transitions, is trained on
labelled pages by the gradient of the log-likelihood (forward-backward over all pages at once) and decoded by Viterbi.

Labelled pages are of two kinds. Pages of the table itself: such a page shows a document of the corpus, the one with which it
shares most characters in whole lines, if these are half of the document at least; the lines of that document are main
text, a heading goes with what follows it, and blocks with the same ancestors then take the label that most of them have. And pages generated
from the templates below, whose labels are known, for structures that the table may not show. Only fitting is bounded: by
MAX_PAGES pages of at most MAX_CHARS characters and MAX_BLOCKS blocks. Neither labels nor results depend on the size of the corpus.
"""

import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ragspark.llm.shared import saved

MAX_PAGES, MAX_CHARS, MAX_BLOCKS = 300, 200_000, 500
#: A line on more than this share of the labelled pages does not tell which document a page shows.
COMMON = 0.1
STEPS, RATE, RIDGE = 150, 0.15, 1e-4
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")

BLOCKS = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer"
    " form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody"
    " td textarea tfoot th thead title tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Tags whose start ends an open tag of the same group.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Block tags that a start tag may look past when it closes an open one of its group.
PASSED = {"p", "li", "dd", "dt", "td", "th", "tr", "option"}
_HIDDEN = re.compile(r"<!--|<(script|style|noscript|template|svg|iframe)\b", re.I)
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_END = re.compile("[>\"']")
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[a-z]{2,}")


class Path:
    """An open element: its tag, the words of its names, the element around it, the nearest block, and what no element
    around it has yet of the features of ancestors. Iterates as (tag, names), outermost first."""

    __slots__ = ("tag", "names", "above", "block", "fresh", "sums")

    def __init__(self, tag, names, above, fresh):
        self.tag, self.names, self.above, self.fresh, self.sums = tag, names, above, fresh, None
        self.block = self if tag in BLOCKS else above.block if above else None

    def chain(self):
        at = self
        while at is not None:
            yield at
            at = at.above

    def __iter__(self):
        return iter([(p.tag, p.names) for p in self.chain()][::-1])


def _tags(page):
    """(start, end, closing, tag, attributes) of all tags in page order; tag is '' for what only hides text.

    A quote hides '>' up to its partner. Where a tag then finds no end, quotes hide nothing from there on. Linear in the page.
    """
    at, quotes, last = 0, True, page.rfind(">")
    closers = {}
    while True:
        at = page.find("<", at)
        if at < 0:
            return
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = len(page) if end < 0 else end + 3
            yield at, end, False, "", ""
            at = end
            continue
        if at > last:
            return
        hidden = _HIDDEN.match(page, at)
        if hidden:
            open_end = page.find(">", hidden.end())
            name = hidden.group(1).lower()
            close = closers.setdefault(name, re.compile(rf"</{name}\s*>", re.I)).search(page, open_end + 1)
            end = close.end() if close else len(page)
            yield at, end, False, "", ""
            at = end
            continue
        named = _NAME.match(page, at)
        if not named:
            if page[at + 1 : at + 2] in ("!", "?", "/"):
                end = page.find(">", at) + 1
                yield at, end, False, "", ""
                at = end
            else:
                at += 1
            continue
        pos, end = named.end(), -1
        while quotes:
            m = _END.search(page, pos)
            if not m:
                quotes = False
            elif m.group() == ">":
                end = m.end()
                break
            else:
                pos = page.find(m.group(), m.end()) + 1
                quotes = pos > 0
        if end < 0:
            end = page.find(">", named.end()) + 1
        yield at, end, bool(named.group(1)), named.group(2).lower(), page[named.end() : end - 1]
        at = end


def leaf_blocks(page):
    """(text, ancestors as a Path or (), characters inside links) of every block with text, in page order."""
    out, top, parts, linked, base = [], None, [], 0, ()
    open_, active = {}, {}

    def flush():
        nonlocal parts, linked
        text = " ".join("".join(parts).split())
        if text:
            out.append((text, base, linked))
        parts, linked = [], 0

    def take(raw):
        nonlocal linked, base
        if not raw or (not parts and raw.isspace()):
            return
        if not parts:
            base = top or ()
        raw = entities.unescape(raw) if "&" in raw else raw
        parts.append(raw)
        if open_.get("a"):
            linked += len(raw.strip())

    def close(until):
        """Ends open elements up to and with ``until``."""
        nonlocal top
        while True:
            ended, top = top, top.above
            open_[ended.tag] -= 1
            for f in ended.fresh:
                del active[f]
            if ended is until:
                return

    at = 0
    for start, end, closing, tag, raw in _tags(page):
        take(page[at:start])
        at = end
        if not tag:
            continue
        if tag == "br":
            if parts:
                parts.append(" ")
            continue
        if tag in BLOCKS:
            flush()
        if closing:
            if open_.get(tag):
                close(next(p for p in top.chain() if p.tag == tag))
            continue
        ends = CLOSES.get(tag, set()) | ({"p"} if tag in BLOCKS else set())
        near = top.block if top and ends else None
        while near is not None:
            if near.tag in ends:
                close(near)
                break
            if near.tag not in PASSED:
                break
            near = near.above.block if near.above else None
        if tag in VOID:
            continue
        names = tuple(sorted({w for v in _NAMES.findall(raw) for w in _WORD.findall("".join(v).lower())})) if "=" in raw else ()
        fresh = [f for f in (f"in:{tag}", *(f"name:{w}" for w in names)) if f not in active]
        active.update(dict.fromkeys(fresh))
        top = Path(tag, names, top, tuple(dict.fromkeys(fresh)))
        open_[tag] = open_.get(tag, 0) + 1
    take(page[at:])
    flush()
    return out


def _step(x, edges):
    return sum(x >= e for e in edges)


def _own_features(blocks):
    """Names of the features of every block of a page, without those of its ancestors."""
    n, out = len(blocks), []
    for k, (text, path, linked) in enumerate(blocks):
        words = text.count(" ") + 1
        own = {"all", f"words{_step(words, (2, 4, 8, 15, 30, 60, 120))}", f"links{_step(linked / len(text), (0.01, 0.3, 0.6, 0.9))}"}
        own.add(f"place{_step(k / max(1, n - 1), (0.02, 0.1, 0.9, 0.98))}")
        marks = sum(text.count(c) for c in ".,;:!?")
        own.add(f"marks{_step(marks / words, (0.02, 0.08, 0.2))}")
        if text[-1:] in ".!?":
            own.add("sentence")
        if "©" in text or "|" in text or "·" in text:
            own.add("sign")
        if path:
            own.add(f"leaf:{path.block.tag if path.block else ''}")
        out.append(own)
    return out


def features(blocks):
    """Names of the features of every block of a page."""
    own = _own_features(blocks)
    return [f.union(*(p.fresh for p in path.chain())) if path else f for f, (_, path, _) in zip(own, blocks)]


class Field:
    """Feature weights [feature, label], transition weights [label, label] and start weights [label]."""

    def __init__(self, index, weight, move, start):
        self.index, self.weight, self.move, self.start = index, weight, move, start

    def emissions(self, blocks):
        e = np.zeros((len(blocks), 2))
        for k, own in enumerate(_own_features(blocks)):
            e[k] = self._sum(own) + self._ancestors(blocks[k][1])
        return e

    def _sum(self, names):
        return self.weight[[self.index[f] for f in names if f in self.index]].sum(0)

    def _ancestors(self, path):
        """Weights of all features of the ancestors; each element adds its own to those of the one around it, once."""
        new = []
        at = path or None
        while at is not None and at.sums is None:
            new.append(at)
            at = at.above
        total = at.sums if at is not None else np.zeros(2)
        for at in reversed(new):
            total = at.sums = total + self._sum(at.fresh) if at.fresh else total
        return total

    def decode(self, blocks):
        """The labels of the best path, by Viterbi."""
        if not blocks:
            return []
        e, m = self.emissions(blocks).tolist(), self.move.tolist()
        a, b, back = self.start[0] + e[0][0], self.start[1] + e[0][1], []
        for x, y in e[1:]:
            stay, come = a + m[0][0], b + m[1][0]
            go, keep = a + m[0][1], b + m[1][1]
            back.append((int(come > stay), int(keep >= go)))
            a, b = max(stay, come) + x, max(go, keep) + y
        label = int(b >= a)
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]

    def text(self, page):
        blocks = leaf_blocks(page)
        return "\n\n".join(t for (t, *_), y in zip(blocks, self.decode(blocks)) if y)


def fit(pages):
    """The field for labelled pages, a list of (feature sets of the blocks, labels); order and weights are deterministic."""
    pages = [(f, y) for f, y in pages if f]
    names = sorted({f for own, _ in pages for s in own for f in s})
    index = {f: i for i, f in enumerate(names)}
    n, t = len(pages), max((len(y) for _, y in pages), default=0)
    block = [(p, k) for p, (_, y) in enumerate(pages) for k in range(len(y))]
    rows = np.array([i for i, (p, k) in enumerate(block) for _ in pages[p][0][k]], np.int64)
    cols = np.array([index[f] for p, k in block for f in pages[p][0][k]], np.int64)
    where_p, where_k = (np.array(c, np.int64) for c in zip(*block)) if block else (np.zeros(0, np.int64),) * 2
    gold = np.array([pages[p][1][k] for p, k in block], np.int64)
    size = np.array([len(y) for _, y in pages], np.int64)
    live = np.arange(t)[None, :] < size[:, None]
    truth = np.zeros((n, t), np.int64)
    truth[where_p, where_k] = gold
    weight, move, start = np.zeros((len(names), 2)), np.zeros((2, 2)), np.zeros(2)
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (weight, move, start)]
    own_moves = np.zeros((2, 2))
    both = live[:, 1:]
    np.add.at(own_moves, (truth[:, :-1][both], truth[:, 1:][both]), 1)
    for step in range(1, STEPS + 1 if n else 1):
        e = np.zeros((n, t, 2))
        flat = np.stack([np.bincount(rows, weights=weight[cols, y], minlength=len(block)) for y in (0, 1)], 1)
        e[where_p, where_k] = flat
        ahead, behind = np.zeros((n, t, 2)), np.zeros((n, t, 2))
        ahead[:, 0] = start + e[:, 0]
        for k in range(1, t):
            new = np.logaddexp.reduce(ahead[:, k - 1, :, None] + move, axis=1) + e[:, k]
            ahead[:, k] = np.where(live[:, k, None], new, ahead[:, k - 1])
        for k in range(t - 2, -1, -1):
            new = np.logaddexp.reduce(move[None] + (e[:, k + 1] + behind[:, k + 1])[:, None, :], axis=2)
            behind[:, k] = np.where(live[:, k + 1, None], new, 0.0)
        total = np.logaddexp.reduce(ahead[:, -1], axis=1)
        p = np.exp(ahead + behind - total[:, None, None])
        error = np.zeros((len(block), 2))
        error[np.arange(len(block)), gold] = 1
        error -= p[where_p, where_k]
        g_weight = np.stack([np.bincount(cols, weights=error[rows, y], minlength=len(names)) for y in (0, 1)], 1)
        pair = ahead[:, :-1, :, None] + move + (e[:, 1:] + behind[:, 1:])[:, :, None, :] - total[:, None, None, None]
        g_move = own_moves - (np.exp(pair) * both[:, :, None, None]).sum((0, 1))
        g_start = np.bincount(truth[:, 0], minlength=2) - p[:, 0].sum(0)
        for x, g, (m1, m2) in zip((weight, move, start), (g_weight, g_move, g_start), state):
            g = g / n - RIDGE * x
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g * g - m2)
            x += RATE * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-9)
    return Field(index, weight, move, start)


#: Templates of labelled pages: {p} stands for a paragraph, {s} for a few words; what stands after ¤ is main text.
TEMPLATES = (
    "<body><header><a href=x>{s}</a><p>{s}</p></header><nav><ul><li><a href=x>{s}</a><li><a href=x>{s}</a></ul></nav><main><article><h1>¤{s}</h1><p>¤{p}</p><p>¤{p}</p><p>¤{p}</p></article></main><footer><p>&copy; {s}</p></footer></body>",
    "<body><div id=menu><a href=x>{s}</a> <a href=x>{s}</a></div><div id=content><h1>¤{s}</h1><p>¤{p}</p><blockquote>¤{p}</blockquote><p>¤{p}</p></div><div id=sidebar><h3>{s}</h3><ul><li><a href=x>{s}</a></li><li><a href=x>{s}</a></li></ul><p>{p}</p></div><div class=footer>{s}</div></body>",
    "<body><div class='cookie notice'><p>{p}</p><button>{s}</button></div><div class='post entry'><h2>¤{s}</h2><p>¤{p}</p><p>¤{p}</p><ul><li>¤{p}</li><li>¤{p}</li></ul></div><div class=comments id=comments><h3>{s}</h3><div class=comment><p>{p}</p></div><div class=comment><p>{p}</p></div></div></body>",
    "<body><nav><a href=x>{s}</a></nav><article><h1>¤{s}</h1><p>¤{p}</p><aside class=related><p>{p}</p><a href=x>{s}</a></aside><p>¤{p}</p><div class=ad><p>{p}</p></div><p>¤{p}</p></article><section class=comments><article class=comment><p>{p}</p></article><form><label>{s}</label><textarea>{s}</textarea><button>{s}</button></form></section></body>",
    "<body><header class=banner><h2>{s}</h2></header><form id=search><input name=q><button>{s}</button><select><option>{s}<option>{s}</select></form><section><div class=text><p>¤{p}</p><p>¤{p}</p><table><tr><td>¤{s}</td><td>¤{s}</td></tr></table></div></section><aside><p>{p}</p><p>{p}</p></aside><footer><ul><li><a href=x>{s}</a></ul><p>{p}</p></footer></body>",
    "<body><div class='advert promo'>{p}</div><div class=breadcrumb><a href=x>{s}</a> | <a href=x>{s}</a></div><div role=main><h1>¤{s}</h1><div>¤{p}</div><div>¤{p}</div></div><div class=newsletter><p>{p}</p></div><div class='share social'><a href=x>{s}</a></div><div role=contentinfo>{p}</div></body>",
    "<body><div class=notice role=alert>{p}</div><main><h1>¤{s}</h1><p>¤{p}</p><h2>¤{s}</h2><p>¤{p}</p><pre>¤{p}</pre></main><div id=disqus class=reader><ol><li><p>{p}</p><li><p>{p}</p></ol></div><footer>{s}</footer></body>",
    "<body><p>{s}</p><article><p>¤{p}</p></article><footer>&copy; {s} &middot; {p}</footer></body>",
    "<article><p>¤{p}</p></article>",
)
PER_TEMPLATE = 20


def template_pages():
    """Labelled pages from the templates, their words and lengths drawn by a fixed generator."""
    rng, out = np.random.default_rng(7), []
    syllables = [c + v for c in "bdfklmnprst" for v in "aeiou"]

    def words(lo, hi):
        n = int(np.exp(rng.uniform(np.log(lo), np.log(hi))))
        text = ["".join(rng.choice(syllables, rng.integers(1, 5))) for _ in range(n)]
        return text

    for template in TEMPLATES:
        for _ in range(PER_TEMPLATE):
            page = re.sub(r"\{s\}", lambda _: " ".join(words(1, 8)), template)
            page = re.sub(r"\{p\}", lambda _: " ".join(w + ("." if rng.random() < 0.12 else "") for w in words(4, 150)).capitalize() + ".", page)
            blocks = leaf_blocks(page)
            labels = [int(t.startswith("¤")) for t, *_ in blocks]
            out.append((features([(t.lstrip("¤"), p, k) for t, p, k in blocks]), labels))
    return out


def sampled(pages):
    """At most MAX_PAGES different pages, those with the smallest hashes, of at most MAX_CHARS characters."""
    known = pages.select("html", F.xxhash64("page_id", "html").alias("h")).where((F.length("html") <= MAX_CHARS) & (F.length("html") > 0))
    last = known.select("h").distinct().orderBy("h").limit(MAX_PAGES).agg(F.max("h")).first()[0]
    return known.where(F.col("h") <= (last if last is not None else 0)).dropDuplicates(["h"])


def table_pages(pages, docs):
    """Labelled pages of the table: see the top of this module."""
    def cut(batches):
        for b in batches:
            for page, text in zip(b.column("h").to_pylist(), b.column("html").to_pylist()):
                blocks = leaf_blocks(text)
                k = len(blocks)
                if not 0 < k <= MAX_BLOCKS:
                    continue
                heads = [bool(p and p.block and p.block.tag in HEADINGS) for _, p, _ in blocks]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([page] * k, pa.int64()), pa.array(range(k), pa.int32()), pa.array([t for t, *_ in blocks]), pa.array([sorted(f) for f in features(blocks)], pa.list_(pa.string())), pa.array(heads)],
                    names=["page", "k", "line", "features", "head"],
                )

    blocks = saved(sampled(pages).select("h", "html").mapInArrow(cut, "page long, k int, line string, features array<string>, head boolean"), "blocks")
    blocks = blocks.withColumn("h", F.xxhash64("line"))
    # a document is known by its text, so that copies are one; of each only the lines that some labelled page has are kept
    named = docs.select(F.xxhash64("text").alias("doc"), F.length("text").alias("size"), F.explode(F.split("text", "\n")).alias("line"))
    lines = named.select("doc", "size", F.trim(F.regexp_replace("line", r"[\s\u00a0]+", " ")).alias("line")).where("line <> ''").withColumn("h", F.xxhash64("line"))
    hits = lines.join(F.broadcast(blocks.select("h").distinct()), "h", "left_semi").groupBy("doc", "size").agg(F.collect_set("h").alias("held"))
    shown = {}
    for r in blocks.groupBy("h").agg(F.max(F.length("line")).alias("n"), F.collect_set("page").alias("pages")).toLocalIterator():
        shown[r.h] = r.n, r.pages
    n_pages = len({p for _, own in shown.values() for p in own})

    def match(batches):
        """Per page the document that shares most characters with it, of those that it shows half of at least."""
        best = {}
        for b in batches:
            for doc, size, held in zip(*(c.to_pylist() for c in b.columns)):
                shared = {}
                for h in held:
                    n, own = shown[h]
                    if len(own) <= 1 + n_pages * COMMON:
                        for p in own:
                            shared[p] = shared.get(p, 0) + n
                for p, n in shared.items():
                    if 2 * n >= size and (p not in best or (n, doc) > best[p][:2]):
                        best[p] = n, doc, held
        if best:
            page, own = zip(*best.items())
            n, doc, held = zip(*own)
            yield pa.RecordBatch.from_arrays([pa.array(page, pa.int64()), pa.array(n, pa.int64()), pa.array(doc, pa.int64()), pa.array(held, pa.list_(pa.int64()))], names=["page", "n", "doc", "held"])

    found = hits.mapInArrow(match, "page long, n long, doc long, held array<long>").groupBy("page").agg(F.max_by("held", F.struct("n", "doc")).alias("held"))
    main = found.select("page", F.explode("held").alias("h"), F.lit(1).alias("y"))
    rows = blocks.join(found.select("page"), "page", "left_semi").join(main, ["page", "h"], "left").select("page", "k", "features", "head", F.coalesce("y", F.lit(0)).alias("y"))
    out = {}
    for r in rows.orderBy("page", "k").toLocalIterator():
        out.setdefault(r.page, []).append(r)
    votes, marked = {}, []
    for page in out.values():
        y = [r.y for r in page]
        for k in range(len(page) - 2, -1, -1):
            y[k] = y[k + 1] if page[k].head else y[k]
        paths = [tuple(f for f in r.features if f.startswith(("in:", "name:", "leaf:"))) for r in page]
        for path, label in zip(paths, y):
            n = votes.setdefault(path, [0, 0])
            n[label] += 1
        marked.append(([set(r.features) for r in page], paths))
    return [(own, [int(votes[p][1] > votes[p][0]) for p in paths]) for own, paths in marked]


def train(pages, docs):
    """The field from the labelled pages of the table and of the templates."""
    return fit(table_pages(pages, docs) + template_pages())


def extract(pages, field, page_id="page_id", url="url", html="html"):
    """Per row page_id, url, its main text and the text's length in code points.

    Null and empty pages, and pages without any main block, have the empty text. Rows are independent; repeated rows are
    extracted each, other columns are not read.
    """
    def run(batches):
        for b in batches:
            text = [field.text(p) if p else "" for p in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(page_id).cast("long"), F.col(url), F.col(html)).mapInArrow(run, "page_id long, url string, text string, n_chars long")
