"""Main text of web pages by a linear-chain conditional random field over the leaf blocks of the DOM.

A page becomes the sequence of its leaf blocks in page order.  A block has indicator features of its
ancestors (tags, and class, id and role names that speak of content or of furniture) and of its
text (length, share of links, punctuation, agreement with the title).  The field has two labels,
weights for the features, for neighbouring labels and for the ends; it is trained by gradient ascent on
the conditional likelihood of labelled pages and decoded by Viterbi.

Labelled pages are the hand-made ones below and at most ``max_pages`` pages of the corpus (the lowest hashes of the
id) that mark their article themselves.  Copies of them with the article's mark removed, with the marks of
furniture removed, and with an article around everything teach the field not to lean on one mark.

Defined results: a null or empty page has the empty text; unclosed and stray tags are repaired as they come;
character references are decoded and white space in a block (line breaks too) becomes one space; every row stays,
repeated rows alike; an empty table gives no rows; names that clash are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riftsplit.llm.words import small_batches

MAX_PAGES = 600
MAX_TRAIN_BLOCKS = 400  # longer pages are not trained on (they are decoded like all others)

# Fixed values of HTML: elements that end a text block, that hold nothing, and whose text is not text of the page.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html iframe label legend li main menu nav ol option p pre search section select summary table "
    "tbody td textarea tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template head title iframe textarea select datalist".split())
IN_HEAD = frozenset("title meta link base style script noscript template".split())
# an opening tag closes the open element of these names
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
P_CLOSERS = BLOCKS - {"button", "label", "option", "select", "textarea", "iframe", "html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}

# Name parts of furniture and of content in class, id and role.
FURNITURE = frozenset(
    "ad ads advert advertisement adverts adbox banner sponsor sponsored promo promotion promoted popup modal overlay cookie cookies consent gdpr notice "
    "notices alert nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar side aside widget widgets related recommended footer foot bottom "
    "header masthead topbar toolbar comment comments commentlist disqus respond reply replies reader discussion form login signup subscribe newsletter "
    "search share sharing social follow pagination pager tags copyright legal disclaimer contentinfo complementary dialog hidden teaser".split()
)
CONTENT = frozenset("article content post entry story body main text maintext articlebody".split())
TAGS = "nav header footer aside form button article main section figure table li a h p div blockquote pre".split()
FEATURES = (
    [f"in_{t}" for t in TAGS]
    + ["furniture", "content", "words_1", "words_4", "words_10", "words_30", "words_more", "links_none", "links_some", "links_most"]
    + ["stop", "no_stop", "owned", "title", "in_title", "first", "last", "after_heading", "bias"]
)
INDEX = {f: i for i, f in enumerate(FEATURES)}
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Block:
    text: str
    tags: frozenset[str]
    names: frozenset[str]
    linked: int
    labelled: bool


class BlockParser(HTMLParser):
    """Collects the leaf blocks of a page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        # open elements: name, then names of all open elements, their class words, and whether one is marked, down to it
        self.open: list[tuple[str, frozenset[str], frozenset[str], bool]] = []
        self.parts: list[str] = []
        self.linked = 0
        self.title: list[str] = []
        self.silent = 0

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.blocks.append(Block(text, *self._inside(), linked=self.linked, labelled=bool(self.open) and self.open[-1][3]))
        self.parts, self.linked = [], 0

    def _inside(self) -> tuple[frozenset[str], frozenset[str]]:
        """Names and class words of all open elements."""
        return self.open[-1][1:3] if self.open else (frozenset(), frozenset())

    def _pop(self, upto: int) -> None:
        """Close the open elements from ``upto`` on."""
        if any(e[0] in BLOCKS for e in self.open[upto:]):
            self.flush()
        self.silent -= sum(e[0] in SILENT for e in self.open[upto:])
        del self.open[upto:]

    def handle_starttag(self, tag, attrs):
        if tag == "body":
            self._pop(0)
        elif tag not in IN_HEAD and any(e[0] == "head" for e in self.open[:4]):
            # the end of head may be left out
            self._pop(next(i for i, e in enumerate(self.open) if e[0] == "head"))
        closed = CLOSES.get(tag)
        if closed or tag in P_CLOSERS:
            for i in range(len(self.open) - 1, -1, -1):
                t = self.open[i][0]
                if (closed and t in closed) or (t == "p" and tag in P_CLOSERS):
                    self._pop(i)
                    break
                if t in ("ul", "ol", "table", "dl", "div", "article", "section", "td", "body"):
                    break
        if tag in BLOCKS:
            self.flush()
        if tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        names, mark = set(), False
        for key, value in attrs:
            if key in ("class", "id", "role") and value:
                names.update(n.lower() for n in NAME.findall(value))
            elif key == "hidden":
                names.add("hidden")
            elif key == "data-main":
                mark = True
        self.silent += tag in SILENT
        tags, words = self._inside()
        marked = mark or (bool(self.open) and self.open[-1][3])
        # most elements add nothing: their sets are shared with the one around them
        self.open.append((tag, tags if tag in tags else tags | {tag}, words if words >= names else words | names, marked))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag not in self._inside()[0]:
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                self._pop(i)
                return

    def handle_data(self, data):
        if self.silent:
            if self.open and self.open[-1][0] == "title":
                self.title.append(data)
            return
        self.parts.append(data)
        if "a" in self._inside()[0]:
            self.linked += len(data.strip())


def page_blocks(html: str | None) -> tuple[list[Block], str]:
    """(leaf blocks, title)."""
    parser = BlockParser()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return parser.blocks, " ".join("".join(parser.title).split())


def block_features(blocks: list[Block], title: str) -> np.ndarray:
    x = np.zeros((len(blocks), len(FEATURES)))
    heading = False
    for i, b in enumerate(blocks):
        on = ["bias"]
        tags = {"h" if t in ("h1", "h2", "h3", "h4", "h5", "h6") else t for t in b.tags}
        on += [f"in_{t}" for t in TAGS if t in tags]
        if b.names & FURNITURE:
            on.append("furniture")
        if b.names & CONTENT:
            on.append("content")
        n = b.text.count(" ") + 1
        on.append("words_1" if n == 1 else "words_4" if n <= 4 else "words_10" if n <= 10 else "words_30" if n <= 30 else "words_more")
        share = b.linked / len(b.text)
        on.append("links_none" if share == 0 else "links_some" if share < 0.5 else "links_most")
        on.append("stop" if b.text[-1] in ".!?…:;\"'»”" else "no_stop")
        if "©" in b.text or "copyright" in b.text.lower():
            on.append("owned")
        if title and (b.text.startswith(title) or title.startswith(b.text)) and len(b.text) > 3:
            on.append("title")
        elif title and len(b.text) > 8 and b.text in title:
            on.append("in_title")
        if i == 0:
            on.append("first")
        if i == len(blocks) - 1:
            on.append("last")
        if heading:
            on.append("after_heading")
        heading = heading or "h" in tags
        x[i, [INDEX[f] for f in on]] = 1.0
    return x


# Hand-labelled pages (data-main marks the main text).
EXAMPLES = [
    """<html><head><title>River levels rise</title></head><body><header><a href=x>Daily</a><p>News for the valley</p></header>
    <div class="cookie-notice"><p>We use cookies to improve this site. By going on you agree.</p><button>Accept</button></div>
    <div id="content"><div data-main><h1>River levels rise</h1><p>The river rose two metres in one night and is expected to rise more.</p>
    <p>Short note.</p><p>People near the bridge were asked to leave their homes until the water falls again, the town said.</p></div>
    <div class="share">Share this on your wall</div></div><aside class="sidebar"><h3>Most read</h3><ul><li><a href=1>A day at the mill</a></li>
    <li><a href=2>Markets close early</a></li></ul></aside><section id="comments"><h3>Comments</h3><div class="comment"><p>I saw the
    water from my window, and it was higher than ever before in my life.</p></div></section><form><label>Your name</label><input><p>Leave
    your address and we will write to you.</p></form><footer>&copy; Daily. All rights reserved.</footer></body></html>""",
    """<body><nav><a href=1>Home</a> <a href=2>About</a></nav><main><article data-main><h2>On bread</h2><p>Flour, water and salt are all that it takes.</p>
    <p>Wait.</p><ul><li>Mix the flour with the water.</li><li>Rest for an hour.</li></ul><blockquote>Good bread needs time.</blockquote></article></main>
    <div class="advert"><p>Buy the best ovens in town now, half the price until Sunday, only while stocks last.</p></div>
    <div class="related"><p><a href=3>More on cakes and pies</a></p></div><footer><p>Made with care in a small kitchen. Terms and privacy.</p></footer></body>""",
    """<body><div class="menu"><div>Start</div><div>Shop</div></div><div class="post"><div data-main><h1>Old maps</h1><div>Maps of the coast were drawn by hand
    for three hundred years.</div><div>Few of them are left today, and those are kept in the dark.</div></div><div class="newsletter"><p>Get our letter every week
    by mail, free of charge.</p></div><div class="comments"><p>Lovely piece, thank you for writing it down for us all.</p><p>First!</p></div></div>
    <div class="footer"><p>Contact us for any question about this site and its owners.</p></div></body>""",
    """<body><article><header>By the desk</header><div data-main><h1>Rain</h1><p>It rained.</p><p>It rained for a week and the fields were under water.</p></div>
    <div class="ad"><p>Umbrellas for everyone, order yours today and pay later.</p></div><div data-main><p>Then the sun came out and the
    farmers went back to work.</p></div><aside><p>See also our long read about snow in the hills.</p></aside><footer>Filed under weather</footer></article></body>""",
    """<body><div class="banner notice"><p>Our office is closed on Monday.</p></div><table><tr><td><a href=1>Home</a></td></tr></table><section data-main>
    <p>The committee met in the morning and heard two reports on the state of the roads.</p><p>No decision was taken.</p></section>
    <form class="login"><p>Sign in to read more of our stories.</p></form><div id="sidebar"><p>Weather today: sunny with some clouds.</p></div></body>""",
]


def silver_labels(blocks: list[Block]) -> np.ndarray | None:
    """Labels of a page that marks its article itself; None if it has no such mark."""
    inside = [bool(b.tags & {"article", "main"}) for b in blocks]
    if not any(inside):
        return None
    outer = {"nav", "header", "footer", "aside", "form", "button"}
    return np.array([a and not b.tags & outer and not b.names & FURNITURE for a, b in zip(inside, blocks, strict=True)], dtype=int)


def _without(x: np.ndarray, names: list[str]) -> np.ndarray:
    x = x.copy()
    x[:, [INDEX[n] for n in names]] = 0.0
    return x


def _variants(x: np.ndarray, y: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The page, its main text alone, and copies of it that lack a mark or carry the article's mark everywhere."""
    around = x.copy()
    around[:, INDEX["in_article"]] = 1.0
    marks = ["in_article", "in_main", "content"]
    alone = _without(x[y == 1], ["first", "last"])
    if len(alone):
        alone[0, INDEX["first"]] = alone[-1, INDEX["last"]] = 1.0
    return [(alone, np.ones(len(alone), dtype=int)), (x, y), (around, y), (_without(x, marks), y), (_without(x, [*marks, "in_nav", "in_footer", "in_header", "in_section"]), y)]


class Field:
    """Two-label chain: ``w`` for label 1, ``move`` for neighbouring labels, ``ends`` for the first and the last label."""

    def __init__(self):
        self.w = np.zeros(len(FEATURES))
        self.move = np.zeros((2, 2))
        self.ends = np.zeros((2, 2))

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], rounds: int = 200, rate: float = 0.1, penalty: float = 2e-4) -> Field:
        """Gradient ascent (Adam) on the mean conditional log-likelihood; pages are padded to one length."""
        pages = [(x, y) for x, y in pages if len(x)]
        if not pages:
            return self
        n, t = len(pages), max(len(x) for x, _ in pages)
        x = np.zeros((n, t, len(FEATURES)), dtype=np.float32)
        y = np.full((n, t), -1)
        for i, (a, b) in enumerate(pages):
            x[i, : len(a)], y[i, : len(b)] = a, b
        real = y >= 0
        size = real.sum(1)
        hit = np.eye(2)[np.clip(y, 0, 1)] * real[..., None]
        seen_move = np.einsum("nta,ntb->ab", hit[:, :-1], hit[:, 1:])
        seen_ends = np.stack([hit[:, 0].sum(0), hit[np.arange(n), size - 1].sum(0)])
        seen_w = np.einsum("ntf,nt->f", x, hit[..., 1])
        total = float(size.sum())
        params = np.concatenate([self.w, self.move.ravel(), self.ends.ravel()])
        m, v = np.zeros_like(params), np.zeros_like(params)
        f = len(FEATURES)
        for step in range(1, rounds + 1):
            w, move, ends = params[:f], params[f : f + 4].reshape(2, 2), params[f + 4 :].reshape(2, 2)
            p, pair = _marginals(x @ w.astype(np.float32), move, ends, real, size)
            g = np.concatenate([
                seen_w - np.einsum("ntf,nt->f", x, p[..., 1]),
                (seen_move - pair).ravel(),
                (seen_ends - np.stack([p[:, 0].sum(0), p[np.arange(n), size - 1].sum(0)])).ravel(),
            ]) / total - penalty * params
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            params = params + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        self.w, self.move, self.ends = params[:f], params[f : f + 4].reshape(2, 2), params[f + 4 :].reshape(2, 2)
        return self

    def decode(self, x: np.ndarray) -> list[int]:
        """Viterbi: the most probable labels."""
        if not len(x):
            return []
        unary = (x @ self.w).tolist()
        (m00, m01), (m10, m11) = self.move.tolist()
        (s0, s1), (e0, e1) = self.ends.tolist()
        a, b, back = s0, s1 + unary[0], []
        for u in unary[1:]:
            from0, from1 = a + m00 < b + m10, a + m01 < b + m11
            back.append((from0, from1))
            a, b = (b + m10 if from0 else a + m00), (b + m11 if from1 else a + m01) + u
        label = int(b + e1 > a + e0)
        out = [label]
        for step in reversed(back):
            label = int(step[label])
            out.append(label)
        return out[::-1]


def _marginals(unary: np.ndarray, move: np.ndarray, ends: np.ndarray, real: np.ndarray, size: np.ndarray):
    """(label probabilities, summed probabilities of neighbouring labels) by the forward-backward recursion in logs."""
    n, t = unary.shape
    score = np.stack([np.zeros_like(unary), unary], axis=-1).astype(float)
    fore, back = np.zeros((n, t, 2)), np.zeros((n, t, 2))
    fore[:, 0] = score[:, 0] + ends[0]
    for k in range(1, t):
        fore[:, k] = np.logaddexp(fore[:, k - 1, :1] + move[0], fore[:, k - 1, 1:] + move[1]) + score[:, k]
    for k in range(t - 1, -1, -1):
        if k + 1 < t:
            ahead = score[:, k + 1] + back[:, k + 1]
            back[:, k] = np.logaddexp(move[:, 0] + ahead[:, :1], move[:, 1] + ahead[:, 1:])
        back[size - 1 == k, k] = ends[1]
    both = fore + back
    norm = np.logaddexp(both[:, 0, 0], both[:, 0, 1])[:, None, None]
    p = np.exp(both - norm) * real[..., None]
    joint = fore[:, :-1, :, None] + move + (score + back)[:, 1:, None, :] - norm[..., None]
    pair = (np.exp(np.minimum(joint, 0.0)) * real[:, 1:, None, None]).sum((0, 1))
    return p, pair


def learn_field(pages: DataFrame, page_id: str = "page_id", html: str = "html", max_pages: int = MAX_PAGES) -> Field:
    """Train on the hand-labelled pages and on a bounded sample of pages that mark their article."""
    ids = pages.select(F.col(page_id).alias("_id")).orderBy(F.xxhash64("_id"), "_id").limit(max_pages)
    # at most max_pages ids; the pages are reduced to features before they are collected
    sample = pages.select(F.col(page_id).alias("_id"), F.col(html).alias("html")).join(F.broadcast(ids.distinct()), "_id")
    schema = pa.schema([("x", pa.list_(pa.int32())), ("y", pa.list_(pa.int32()))])

    def rows(batches):
        for batch in small_batches(batches, "html"):
            xs, ys = [], []
            for page in batch.column("html").to_pylist():
                blocks, title = page_blocks(page)
                labels = silver_labels(blocks) if 0 < len(blocks) <= MAX_TRAIN_BLOCKS else None
                if labels is not None:
                    xs.append(np.flatnonzero(block_features(blocks, title)).tolist())
                    ys.append(labels.tolist())
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.list_(pa.int32())), pa.array(ys, pa.list_(pa.int32()))], schema=schema)

    found = sample.mapInArrow(rows, "x array<int>, y array<int>").limit(max_pages).collect()
    train = []
    for r in found:
        x = np.zeros(len(r["y"]) * len(FEATURES))
        x[r["x"]] = 1.0
        train.append((x.reshape(-1, len(FEATURES)), np.array(r["y"])))
    made = []
    for page in EXAMPLES:
        blocks, title = page_blocks(page)
        made.append((block_features(blocks, title), np.array([int(b.labelled) for b in blocks])))
    # hand-made pages count as much as the sample; long and short pages are padded apart
    made *= max(1, len(train) // (2 * len(made)))
    short = [v for p in train if len(p[1]) <= 60 for v in _variants(*p)]
    return Field().fit([v for p in made for v in _variants(*p)] + short)


def extract_text(pages: DataFrame, field: Field, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_blocks, n_main) for every row."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_blocks", pa.int32()), ("n_main", pa.int32())])

    def rows(batches):
        for batch in small_batches(batches, "html"):
            texts, counts, mains = [], [], []
            for page in batch.column("html").to_pylist():
                blocks, title = page_blocks(page)
                labels = field.decode(block_features(blocks, title)) if blocks else []
                main = [b.text for b, label in zip(blocks, labels, strict=True) if label]
                texts.append("\n".join(main).encode("utf-8", "replace").decode())
                counts.append(len(blocks))
                mains.append(len(main))
            columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(counts, pa.int32()), pa.array(mains, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    wanted = pages.select(
        F.col(page_id).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html")
    )
    return wanted.mapInArrow(rows, "page_id bigint, url string, text string, n_blocks int, n_main int")
