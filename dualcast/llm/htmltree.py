"""HTML extraction by a tree-structured graphical model over a page's blocks.

A page is parsed into its block elements. Each is content or not: its own features give it a potential, and
a potential on every edge says how a child's state goes with its parent's. Sum-product messages, up the
tree and down again, give each block's marginal; blocks that are rather content than not make the text.

Both kinds of potentials are counted on labelled pages. A page whose markup names its article labels its
own blocks. Each also gives variants in which article and surroundings are dressed in other usual
elements and class names, with the page's own paragraphs as comments, notices and sidebars, so that the
model learns names and places, not one template.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dualcast.llm.common import arrow_pass, cells

#: Pages that a fit uses at most (about), variants of each, and features that it keeps.
SAMPLE_PAGES, VARIANTS, FEATURES = 2_000, 4, 4_000

#: HTML's element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = "script|style|template|noscript|svg|math|iframe|object|canvas|title|textarea|select"
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr br img".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hr main menu nav ol p pre section summary table ul li".split()
)
#: A start tag ends an open element of these kinds, up to the container on the right.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"}),
}
#: Names that pages use for content and for its surroundings; seeds of the counts and of the variants.
CONTENT_NAMES = (
    "article main div.content div.post section.story div.entry-content div.article-body div.post-body div.text "
    "section.article div#content div.main-content div.story-body div.single"
).split()
OTHER_NAMES = (
    "nav header footer aside form div.menu ul.menu div.navbar div.nav div.header div.masthead div.topbar div.banner div.footer "
    "div.site-footer div.bottom div.sidebar aside.sidebar div.widget div.related div.recommended div.ad div.ads div.advert "
    "div.advertisement div.sponsored div.promo div.cookie div.cookie-notice div.consent div.notice div.alert div.newsletter "
    "div.subscribe div.signup form.search form.login div.comments section.comments ol.comment-list div.comment div.reply "
    "div.share div.social div.breadcrumbs div.pagination div.tags div.copyright div.disclaimer div.popup div.modal"
).split()
_SEED = 5

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?:svg|math)\b(?:[^>/]++|/(?!>))*+/>|<({SKIPPED})\b[^>]*+>.*?(?:</\1\s*+[^>]*+>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?>[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""(class|id|role|itemprop)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"']++))""", re.I)
_NAME = re.compile(r"[a-z]+|[A-Z][a-z]*")


@dataclass
class Tree:
    """Blocks in page order: element, parent, names in its attributes, its own text and how much of it is linked."""

    tag: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    names: list[tuple[str, ...]] = field(default_factory=list)
    words: list[int] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    last: list[str] = field(default_factory=list)
    #: (block, text) in page order; a block's text is in several pieces where other blocks stand between.
    pieces: list[tuple[int, str]] = field(default_factory=list)

    def add(self, tag: str, parent: int, names: tuple[str, ...]) -> int:
        for values, value in ((self.tag, tag), (self.parent, parent), (self.names, names), (self.words, 0), (self.linked, 0), (self.last, "")):
            values.append(value)
        return len(self.tag) - 1


def _names(attributes: str) -> tuple[str, ...]:
    found = (m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes))
    return tuple({n.lower() for value in found for n in _NAME.findall(value) if len(n) > 1})


def parse(page: str) -> Tree:
    """The block tree of a page of any quality; an unclosed element ends with the page."""
    tree = Tree()
    tree.add("#page", -1, ())
    stack: list[tuple[str, int]] = [("#page", 0)]  # open elements and the block each belongs to
    opened: Counter = Counter()
    texts: list[str] = []

    def flush() -> None:
        block = stack[-1][1]
        text = " ".join(html.unescape("".join(texts)).split())
        texts.clear()
        if text:
            tree.pieces.append((block, text))
            tree.words[block] += text.count(" ") + 1
            tree.last[block] = text[-1]

    def leave(at: int) -> None:
        if any(name not in INLINE for name, _ in stack[at:]):
            flush()
        for name, _ in stack[at:]:
            opened[name] -= 1
        del stack[at:]

    def close(names, until) -> None:
        if not any(opened[n] for n in names):
            return
        for at in range(len(stack) - 1, 0, -1):
            if stack[at][0] in names:
                leave(at)
                return
            if stack[at][0] in until:
                return

    at = 0
    for token in _TOKEN.finditer(page):
        if token.start() > at:
            text = page[at : token.start()]
            texts.append(text)
            if opened["a"]:
                tree.linked[stack[-1][1]] += len(text.split())
        at = token.end()
        tag = (token[3] or token[6] or "").lower()
        if not tag or tag == "head":  # its end is optional; title, script and style are skipped by themselves
            continue
        if token[2] or token[5]:
            if opened[tag]:
                for up in range(len(stack) - 1, 0, -1):
                    if stack[up][0] == tag:
                        leave(up)
                        break
                    if tag in INLINE and stack[up][0] not in INLINE:
                        break
            continue
        if tag == "br":
            texts.append(" ")
            continue
        if tag in CLOSES_P:
            close({"p"}, {"td", "th", "button", "table"})
        if tag in ENDS:
            close(*ENDS[tag])
        if tag in INLINE:
            if tag not in VOID:
                stack.append((tag, stack[-1][1]))
                opened[tag] += 1
            continue
        flush()
        if tag not in VOID:
            stack.append((tag, tree.add(tag, stack[-1][1], _names(token[4] or token[7] or ""))))
            opened[tag] += 1
    texts.append(page[at:])
    leave(1)
    flush()
    return tree


def features(tree: Tree, i: int) -> list[str]:
    """Element, words, linked share and last character as one feature, and each name."""
    n, share = tree.words[i], 0.0
    if n:
        share = tree.linked[i] / n
    size = 0 if n == 0 else 1 if n < 4 else 2 if n < 10 else 3 if n < 25 else 4
    links = 0 if share == 0 else 1 if share < 0.5 else 2
    return [f"t:{tree.tag[i]}|{size}{links}{'.' if tree.last[i] in tuple('.!?…') else '-'}", *(f"c:{name}" for name in tree.names[i])]


#: Elements that hold parts of a page; a block of these or with names may differ from its parent.
SECTIONS = frozenset("article main section nav header footer aside form div menu dialog body".split())


def edge_kind(tree: Tree, i: int) -> int:
    return int(tree.tag[i] in SECTIONS or bool(tree.names[i]))


@dataclass
class Model:
    """Log potentials: (other, content) by feature, edge[child's kind][parent state][child state], and the root's."""

    nodes: dict[str, tuple[float, float]]
    edge: list[list[list[float]]]
    root: tuple[float, float]


def marginals(tree: Tree, model: Model) -> list[float]:
    """The probability of content per block, by messages up the tree and down again."""
    size = len(tree.tag)
    edges = [model.edge[edge_kind(tree, i)] for i in range(size)]
    own = []
    for i in range(size):
        known = [model.nodes[f] for f in features(tree, i) if f in model.nodes]
        own.append([sum(k[0] for k in known), sum(k[1] for k in known)])
    own[0][0] += model.root[0]
    own[0][1] += model.root[1]
    up = [(0.0, 0.0)] * size  # a block's message to its parent
    below = [list(o) for o in own]  # its potential and the messages from its children
    for i in range(size - 1, 0, -1):
        a, b = below[i]
        up[i] = tuple(_log_sum(edges[i][s][0] + a, edges[i][s][1] + b) for s in (0, 1))
        top = below[tree.parent[i]]
        top[0] += up[i][0]
        top[1] += up[i][1]
    whole = [(0.0, 0.0)] * size
    whole[0] = tuple(below[0])
    for i in range(1, size):
        rest = [whole[tree.parent[i]][s] - up[i][s] for s in (0, 1)]
        down = [_log_sum(rest[0] + edges[i][0][c], rest[1] + edges[i][1][c]) for c in (0, 1)]
        norm = max(below[i][0] + down[0], below[i][1] + down[1])
        whole[i] = (below[i][0] + down[0] - norm, below[i][1] + down[1] - norm)
    return [1 / (1 + math.exp(max(-60.0, min(60.0, a - b)))) for a, b in whole]


def _log_sum(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def main_text(page: str | None, model: Model) -> str:
    """The content blocks' texts in page order, one line each; null is the empty page."""
    if not page:
        return ""
    tree = parse(page)
    probability = marginals(tree, model)
    return "\n".join(text for block, text in tree.pieces if probability[block] > 0.5)


def labels(tree: Tree) -> list[int] | None:
    """Content or not by the page's own markup, where it names its article; else none."""
    state, found = [0] * len(tree.tag), False
    for i in range(1, len(tree.tag)):
        names = set(tree.names[i])
        if tree.tag[i] in ("article", "main") or {"articlebody", "article", "body"} <= names | {"articlebody"} and "article" in names:
            state[i], found = 1, True
        elif tree.tag[i] in ("nav", "aside", "footer", "form", "button", "menu"):
            state[i] = 0
        else:
            state[i] = state[tree.parent[i]]
    return state if found else None


def _open(name: str, mark: str) -> tuple[str, str]:
    tag, dot, rest = re.match(r"([a-z]+)([.#]?)(.*)", name).groups()
    attribute = f' {"class" if dot == "." else "id"}="{rest}"' if dot else ""
    return f'<{tag}{attribute} role="{mark}">', f"</{tag}>"


def variant(tree: Tree, state: list[int], rng: random.Random) -> str:
    """A page with the same content in another dress; containers carry marks that ``variant_labels`` takes off."""
    inside = [(tree.tag[b], html.escape(t)) for b, t in tree.pieces if state[b]]
    around = [html.escape(t) for b, t in tree.pieces if not state[b]] or ["more"]
    prose = [t for _, t in inside] + around

    def other() -> str:
        begin, end = _open(rng.choice(OTHER_NAMES), "zzother")
        kind = rng.randrange(5)
        texts = [rng.choice(prose if kind else around) for _ in range(rng.randrange(1, 4))]
        if kind == 0:
            return f"{begin}<ul>{''.join(f'<li><a href=#>{t[:40]}</a></li>' for t in texts)}</ul>{end}"
        if kind == 1:
            return f"{begin}{texts[0]}{end}"
        if kind == 2:
            return f"{begin}<h3>{texts[0][:20]}</h3><ol>{''.join(f'<li><p>{t}</p></li>' for t in texts)}</ol>{end}"
        return f"{begin}{''.join(f'<p>{t}</p>' for t in texts)}{end}"

    def dressed(tag: str, text: str) -> str:
        if tag != "p" or rng.random() < 0.7:
            tag = tag if tag in PLAIN else "p"
            return f"<{tag}>{text}</{tag}>"
        return rng.choice((
            "<ul><li>{}</li></ul>", "<ol><li>{}</li></ol>", "<blockquote>{}</blockquote>", "<h2>{}</h2>", "<h3>{}</h3>", "<pre>{}</pre>",
            "<div>{}</div>", "<blockquote><p>{}</p></blockquote>", "<table><tr><td>{}</td></tr></table>", "<ul><li><p>{}</p></li></ul>",
        )).replace("{}", text)

    begin, end = _open(rng.choice(CONTENT_NAMES), "zzcontent")
    blocks = [dressed(tag, t) for tag, t in inside]
    if rng.random() < 0.5:
        blocks.insert(rng.randrange(len(blocks) + 1), other())
    wrap = rng.choice(("{}", "<div>{}</div>", '<div class="page"><div>{}</div></div>', '<div id="wrapper">{}</div>')).split("{}")
    before, after = ("".join(other() for _ in range(rng.randrange(1, 4))) for _ in range(2))
    if rng.random() < 0.15:  # content without a container of its own
        return f'<html><body role="zzcontent">{before}{"".join(blocks)}{after}</body></html>'
    return f"<html><body>{wrap[0]}{before}{begin}{''.join(blocks)}{end}{after}{wrap[1]}</body></html>"


#: Elements whose name alone says nothing about being content, and the most that one of them can weigh.
PLAIN_EVIDENCE = 2.5
PLAIN = frozenset("p h1 h2 h3 h4 li ul ol blockquote pre table tr td div".split())


def variant_labels(tree: Tree) -> list[int]:
    """The states that the marks give, which are removed from the blocks' names."""
    state = [0] * len(tree.tag)
    for i in range(1, len(tree.tag)):
        names = tree.names[i]
        state[i] = 1 if "zzcontent" in names else 0 if "zzother" in names else state[tree.parent[i]]
        tree.names[i] = tuple(n for n in names if n not in ("zzcontent", "zzother"))
    return state


def _edge_name(tree: Tree, state: list[int], i: int) -> str:
    return f"s:{edge_kind(tree, i)}{state[tree.parent[i]]}" if i else "s:root"


def fit(pages: DataFrame, page_id: str = "page_id", text: str = "html") -> Model:
    """Potentials from a bounded sample of pages that name their article, chosen by a hash of id and page.

    The fixed names are seeds of the counts, so a table without such pages gives a usable model too.
    """
    total = pages.count()
    rows = pages.select(F.xxhash64(F.lit("html"), page_id, text).alias("turn"), F.col(text).alias("html")).where("html is not null")
    if total > SAMPLE_PAGES:
        rows = rows.where(F.pmod("turn", F.lit(2**31)) < F.lit(int(SAMPLE_PAGES / total * 2**31)))

    def passes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}

        def count(tree: Tree, state: list[int]) -> None:
            for i in range(len(tree.tag)):
                for name in [*features(tree, i), _edge_name(tree, state, i)]:
                    counts.setdefault(name, [0, 0])[state[i]] += 1

        for batch in batches:
            for turn, page in zip(cells(batch, "turn"), cells(batch, "html")):
                tree = parse(page)
                state = labels(tree)
                if state is None or not any(state[b] for b, _ in tree.pieces):
                    continue
                count(tree, state)
                rng = random.Random(turn)
                for _ in range(VARIANTS):
                    new = parse(variant(tree, state, rng))
                    count(new, variant_labels(new))
        names = list(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), *(pa.array([counts[n][s] for n in names], pa.int64()) for s in (0, 1))], ["name", "other", "content"]
        )

    counted = arrow_pass(rows, passes, "name string, other long, content long").groupBy("name").agg(
        F.sum("other").alias("other"), F.sum("content").alias("content")
    )
    # names of the edges sort before the kept features
    kept = counted.orderBy(F.col("name").startswith("s:").desc(), (F.col("other") + F.col("content")).desc(), "name").limit(FEATURES)
    return build({r["name"]: (r["other"], r["content"]) for r in kept.collect()})


def build(counts: dict[str, tuple[int, int]]) -> Model:
    """Potentials from counts, with the fixed names as seeds: smoothed shares per state."""
    seeds: dict[str, list[float]] = {}
    for state, names in ((0, OTHER_NAMES), (1, CONTENT_NAMES)):
        for name in names:
            tag, _, rest = re.match(r"([a-z]+)([.#]?)(.*)", name).groups()
            for f in [*([f"t:{tag}|00-"] if not rest else []), *(f"c:{n}" for n in _NAME.findall(rest))]:
                seeds.setdefault(f, [0.0, 0.0])[state] += _SEED
    total = [max(1, sum(v[s] for n, v in counts.items() if n.startswith("t:"))) for s in (0, 1)]
    nodes = {}
    for name in {*counts, *seeds}:
        if not name.startswith("s:"):
            a, b = counts.get(name, (0, 0))
            x, y = seeds.get(name, (0.0, 0.0))
            low, high = math.log((a + x + 1) / (total[0] + 50)), math.log((b + y + 1) / (total[1] + 50))
            if name[2:].split("|")[0] in PLAIN and name.startswith("t:"):
                high = min(max(high, low - PLAIN_EVIDENCE), low + PLAIN_EVIDENCE)
            nodes[name] = (low, high)
    edge = []
    for kind, priors in enumerate((((9.995, 0.005), (0.005, 9.995)), ((8, 2), (1, 9)))):
        rows = []
        for state, prior in enumerate(priors):
            a, b = (x * 990 / max(1, sum(counts.get(f"s:{kind}{state}", (0, 0)))) for x in counts.get(f"s:{kind}{state}", (0, 0)))
            rows.append([math.log((a + prior[0]) / (a + b + 10)), math.log((b + prior[1]) / (a + b + 10))])
        edge.append(rows)
    return Model(nodes, edge, (math.log(0.9), math.log(0.1)))


def extract(pages: DataFrame, model: Model, keep: tuple[str, ...] = ("page_id", "url"), text: str = "html") -> DataFrame:
    """The columns of ``keep``, ``text`` and ``n_chars`` (code points) for every row.

    A null or empty page has the empty text. Pages are read whole; repeated rows stay repeated.
    """
    kinds = dict(pages.dtypes)

    def passes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(p, model) for p in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())],
                [*keep, "text", "n_chars"],
            )

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "text string", "n_chars long"])
    return arrow_pass(pages.select(*keep, F.col(text).cast("string")), passes, schema)
