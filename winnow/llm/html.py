"""Main text of web pages from a tree-structured graphical model.

The DOM's block elements are nodes with a hidden label: content, boilerplate, or a frame around both.  Potentials: one for each parent-child pair of
labels, and one for each observation of a node given its label.  Observations are what a node says of itself (tag, words
of class, id and role, amount of text, share of it in links, form controls) and what its surroundings say: how many siblings
look like it, and where they stand to the element with the most running text.  So lists of comments are told where names
mean nothing.  Messages run from the leaves to the root and back (sum-product, exact on a tree); a
block's own text is kept if its marginal of being content is over one half.

The potentials are smoothed counts over labelled pages: markup with data-label="1" or "0" on elements, inherited
by what is inside.  `labelled_pages` writes a set of such pages from a grammar of layouts; any other set will do.
Whole pages are parsed, whatever their size; nothing is dropped but what the model or the markup rules out.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kit import map_batches

# Fixed values of the HTML standard.
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
ITEMS = frozenset("li dd dt".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn em font i ins del kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr nobr br img".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
SILENT = frozenset("script style noscript template head title svg math iframe object noembed noframes canvas audio video select datalist".split())
CONTROLS = frozenset("input button select textarea".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: An open element that a start tag ends, up to the nearest of the scopes.
ENDED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, set()),
}
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Page:
    """Block nodes in document order (parents first) and the runs of text that belong to them."""

    def __init__(self, source: str):
        self.parent, self.tag, self.attrs = [-1], ["#root"], [""]
        self.controls = [0]
        self.runs: list[tuple[int, list[str]]] = []
        self.text_chars, self.link_chars = [0], [0]
        stack: list[tuple[str, int]] = [("#root", 0)]  # (tag, its block node)
        at, links, silent = 0, 0, 0
        lower = None

        def text(piece: str) -> None:
            if silent or not piece:
                return
            node = stack[-1][1]
            if not self.runs or self.runs[-1][0] != node:
                if piece.isspace():
                    return
                self.runs.append((node, []))
            self.runs[-1][1].append(piece)
            n = len(piece.strip())
            self.text_chars[node] += n
            if links:
                self.link_chars[node] += n

        def drop_to(k: int) -> None:
            nonlocal links, silent
            while len(stack) > k:
                tag, _ = stack.pop()
                links -= tag == "a"
                silent -= tag in SILENT

        for m in iter(lambda: TOKEN.search(source, at), None):
            text(source[at : m.start()])
            at = m.end()
            close, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not tag:
                continue
            tag = tag.lower()
            if close:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        drop_to(k)
                        break
                    if tag in INLINE and stack[k][0] not in INLINE:
                        break  # an inline end tag does not close blocks
                if tag not in INLINE:
                    self._break()
                continue
            if tag in CLOSES_P or tag in ENDED_BY:
                ends, scope = ENDED_BY.get(tag, ({"p"}, {"div", "section", "article", "td", "li", "body", "blockquote"}))
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in ends:
                        drop_to(k)
                        break
                    if stack[k][0] in scope:
                        break
            if tag == "br" or tag == "hr":
                text("\n") if tag == "br" else self._break()
                continue
            node = stack[-1][1]
            if tag not in INLINE and tag not in VOID:
                while stack[-1][0] in INLINE:  # formatting left open ends with its block
                    drop_to(len(stack) - 1)
                node = stack[-1][1]
                self._break()
                self.parent.append(node)
                self.tag.append(tag)
                self.attrs.append(attrs)
                self.controls.append(0)
                self.text_chars.append(0)
                self.link_chars.append(0)
                node = len(self.tag) - 1
            if tag in CONTROLS:
                self.controls[self.parent[node] if tag not in VOID and tag not in INLINE else node] += 1
            if tag in VOID or attrs.endswith("/") and tag in ("svg", "path"):
                continue
            if tag in RAW:
                lower = source.lower() if lower is None else lower
                end = lower.find("</" + tag, at)
                at = len(source) if end < 0 else end
            links += tag == "a"
            silent += tag in SILENT
            stack.append((tag, node))
        text(source[at:])

    def surroundings(self) -> list[str]:
        """Of each node that has siblings of the same tag and attributes: how many, what kind of element it is, and where it
        stands to the element with the most running text in its own paragraphs (main, in, up around it, before, after)."""
        n = len(self.tag)
        total, links, running = self.text_chars[:], self.link_chars[:], [0] * n
        for k in range(n - 1, 0, -1):
            up = self.parent[k]
            total[up] += total[k]
            links[up] += links[k]
            if self.tag[k] in RUNNING and 2 * links[k] <= total[k]:
                running[up] += total[k]
        main = max(range(1, n), key=running.__getitem__) if n > 1 else 0
        around, at = {main}, main
        while at > 0:
            at = self.parent[at]
            around.add(at)
        inside = [False] * n
        inside[main] = True
        looks: dict[tuple, int] = {}
        for k in range(1, n):
            inside[k] = inside[k] or inside[self.parent[k]]
            key = (self.parent[k], self.tag[k], self.attrs[k])
            looks[key] = looks.get(key, 0) + 1
        out = [""]
        for k in range(1, n):
            same = min(3, looks[self.parent[k], self.tag[k], self.attrs[k]])
            place = "main" if k == main else "in" if inside[k] else "up" if k in around else "before" if k < main else "after"
            out.append(f"{place} {'li' if self.tag[k] in ITEMS else 'box'}{same}" if same > 1 and self.tag[k] not in RUNNING else "")
        return out

    def _break(self) -> None:
        """What follows belongs to another block, even if to the same node."""
        if self.runs and self.runs[-1][1]:
            self.runs.append((-1, []))

    def names(self, k: int) -> list[str]:
        return name_words(self.attrs[k])


def name_words(attrs: str) -> list[str]:
    out = []
    for name, a, b, c in ATTRIBUTE.findall(attrs):
        if name.lower() in ("class", "id", "role", "itemprop"):
            out += [x.lower() for x in NAME_WORD.findall(a or b or c)]
        elif name.lower() in ("hidden", "aria-hidden") and (a or b or c) != "false":
            out.append("hidden")
    return out


# ---------------------------------------------------------------- the model


BOILERPLATE, CONTENT, FRAME = range(3)  # a frame (body, wrapper) holds parts of both kinds


class Model:
    """log potentials of label pairs and of observations given a label."""

    KINDS = ("tag", "name", "size", "links", "form", "alike")

    def __init__(self, smooth: float = 0.5):
        self.smooth = smooth

    @staticmethod
    def marked(page: Page, k: int) -> list[tuple[str, str]]:
        return [("tag", page.tag[k]), *[("name", w) for w in dict.fromkeys(page.names(k))]]

    @staticmethod
    def filled(chars: int, links: int, controls: int) -> list[tuple[str, str]]:
        if not chars:
            return [("size", "none"), ("form", str(min(2, controls)))]
        return [("size", str(min(6, int(math.log2(1 + chars / 8))))), ("form", str(min(2, controls))), ("links", str(int(links / chars * 3.999)))]

    def fit(self, pages: Iterable[str]) -> "Model":
        pairs = [[self.smooth * 0.1] * 3 for _ in range(3)]
        counts: dict[str, dict] = {k: defaultdict(lambda: [0.0] * 3) for k in self.KINDS}
        nodes = [0.0] * 3
        for source in pages:
            page = Page(source)
            label, seen = [FRAME] * len(page.tag), page.surroundings()
            for k in range(1, len(page.tag)):
                own = re.search(r'data-label="([01])"', page.attrs[k])
                label[k] = int(own[1]) if own else label[page.parent[k]]
                pairs[label[page.parent[k]]][label[k]] += 1
                nodes[label[k]] += 1
                for kind, value in self.marked(page, k) + self.filled(page.text_chars[k], page.link_chars[k], page.controls[k]) + [("alike", seen[k])] * bool(seen[k]):
                    counts[kind][value][label[k]] += 1
        self.log_pairs = [[math.log(x / sum(row)) for x in row] for row in pairs]
        self.odds: dict[tuple[str, str], tuple[float, ...]] = {}
        for kind, values in counts.items():
            # a name is seen or not on a node; of the other kinds a node shows one value
            totals = nodes if kind == "name" else [sum(v[y] for v in values.values()) for y in range(3)]
            wide = 2 if kind == "name" else len(values) + 1
            for value, n in values.items():
                self.odds[kind, value] = tuple(math.log((n[y] + self.smooth) / (totals[y] + self.smooth * wide)) for y in range(3))
        self.cache: dict = {}
        return self

    def _sum(self, key: tuple, seen: list[tuple[str, str]]) -> tuple[float, float, float]:
        if len(self.cache) > 100_000:
            self.cache.clear()
        found = [self.odds[x] for x in seen if x in self.odds]
        self.cache[key] = out = tuple(sum(x[y] for x in found) for y in range(3))
        return out

    def marginals(self, page: Page) -> list[float]:
        """P(content) of each node; the root of the document is a frame."""
        n, cache = len(page.tag), self.cache
        (t00, t01, t02), (t10, t11, t12), (t20, t21, t22) = self.log_pairs
        score = []
        for k, seen in enumerate(page.surroundings()):
            a = cache.get(key := (page.tag[k], page.attrs[k])) or self._sum(key, self.marked(page, k))
            b = cache.get(key := (page.text_chars[k], page.link_chars[k], page.controls[k])) or self._sum(key, self.filled(*key))
            c = self.odds.get(("alike", seen), (0.0, 0.0, 0.0)) if seen else (0.0, 0.0, 0.0)
            score.append([a[0] + b[0] + c[0], a[1] + b[1] + c[1], a[2] + b[2] + c[2]])
        up = [(0.0, 0.0, 0.0)] * n
        for k in range(n - 1, 0, -1):  # children come after their parents
            a, b, c = score[k]
            up[k] = m = (_log_sum(t00 + a, t01 + b, t02 + c), _log_sum(t10 + a, t11 + b, t12 + c), _log_sum(t20 + a, t21 + b, t22 + c))
            s = score[page.parent[k]]
            s[0] += m[0]
            s[1] += m[1]
            s[2] += m[2]
        belief = [(0.0, 0.0, 1.0)] * n
        exp = math.exp
        for k in range(1, n):
            # P(label | parent's label, all below), weighed by the parent's belief
            p, q, r = belief[page.parent[k]]
            (m0, m1, m2), (a, b, c) = up[k], score[k]
            x = p * exp(t00 + a - m0) + q * exp(t10 + a - m1) + r * exp(t20 + a - m2)
            y = p * exp(t01 + b - m0) + q * exp(t11 + b - m1) + r * exp(t21 + b - m2)
            belief[k] = (x, y, max(0.0, 1.0 - x - y))
        return [x[1] for x in belief]

    def extract(self, source: str | None) -> str:
        if not source:
            return ""
        page = Page(source)
        belief = self.marginals(page)
        if len(page.tag) == 1:
            belief[0] = 1.0  # text without any block markup is all there is
        out = []
        for node, pieces in page.runs:
            if pieces and belief[node] > 0.5:
                words = html.unescape("".join(pieces)).split()
                if words:
                    out.append(" ".join(words))
        return " ".join(out)


def _log_sum(a: float, b: float, c: float) -> float:
    m = max(a, b, c)
    return m + math.log(math.exp(a - m) + math.exp(b - m) + math.exp(c - m))


# ---------------------------------------------------------------- labelled pages


#: Class and id names that sites give to parts of a page, and the tags they use for them.
CONTENT_NAMES = "article article-body post post-content entry entry-content story story-body content main-content main body-text page-content text blog-post news-item".split()
PARTS = {
    "menu": ("nav div ul".split(), "nav navbar menu main-menu navigation topnav breadcrumb breadcrumbs pagination tabs toc".split()),
    "header": ("header div".split(), "header site-header masthead top banner-top logo branding".split()),
    "footer": ("footer div".split(), "footer site-footer bottom copyright legal credits colophon".split()),
    "sidebar": ("aside div section".split(), "sidebar side widget rail related related-posts recommended popular trending tags archive share social social-links".split()),
    "notice": ("div section aside".split(), "notice cookie cookie-banner cookies consent gdpr alert message warning disclaimer popup modal overlay".split()),
    "advert": ("div aside section ins".split(), "ad ads advert advertisement ad-slot adbox banner sponsor sponsored promo promotion".split()),
    "form": ("form div section".split(), "form search search-form newsletter subscribe signup login register contact-form poll".split()),
    "comments": ("section div ol".split(), "comments comment-list comment-thread responses discussion replies disqus reader-comments reviews".split()),
}


#: Names of parts in other languages than those above.
FOREIGN = {
    "content": "artikel beitrag inhalt texte contenu corps articulo contenido cuerpo noticia".split(),
    "menu": "navigation menue hauptmenue navegacion menu-principal fil-ariane".split(), "header": "kopf kopfzeile entete cabecera encabezado".split(),
    "footer": "fuss fusszeile impressum pied pied-de-page pie pie-de-pagina".split(), "sidebar": "seitenleiste randspalte colonne barra-lateral lateral".split(),
    "notice": "hinweis meldung avis aviso bandeau".split(), "advert": "werbung anzeige publicite pub anuncio publicidad".split(),
    "form": "suche anmeldung recherche inscription buscar formulario".split(), "comments": "leserbriefe antworten commentaires comentarios respuestas".split(),
}


def labelled_pages(count: int = 1200, seed: int = 11) -> list[str]:
    """Pages of random layouts with known labels.

    In a third of them parts have their usual names; in the others names are random or generated, in another language, or
    there are none at all and every part is a div: there only structure tells.
    """
    r = random.Random(seed)
    style = "plain"

    def named(names: list[str], kind: str) -> str:
        if style == "foreign" and kind in FOREIGN:
            return r.choice(FOREIGN[kind])
        if style in ("random", "none"):
            return "".join(r.choice("abcdefghjkmnpqrstuvwxyz") for _ in range(r.randint(3, 8))) + r.choice(["", f"-{r.randrange(99)}", f"_{r.randrange(16**4):x}"])
        return r.choice(names)

    def words(low: int, high: int) -> str:
        return " ".join("".join(r.choice("aeioulnrstdmk") for _ in range(r.randint(2, 9))) for _ in range(r.randint(low, high)))

    def attrs(names: list[str], chance: float = 0.85, kind: str = "") -> str:
        if r.random() > chance or style == "none":
            return ""
        name = named(names, kind)
        return r.choice([f' class="{name}"', f' id="{name}"', f' class="{name} {r.choice(["wide", "clearfix", "left", "row", "box", "inner", "container"])}"'])

    def link() -> str:
        return f'<a href="/{words(1, 1)}">{words(1, 3)}</a>'

    def paragraph(low: int = 0, high: int = 0) -> str:
        body = words(low, high) if high else words(*r.choice([(1, 4), (3, 15), (10, 60), (40, 250)]))
        if r.random() < 0.2:
            body += " " + link() + " " + words(1, 20)
        if r.random() < 0.15:
            body = f"<b>{body}" + ("</b>" if r.random() < 0.7 else "")
        return f"<p>{body}" + ("</p>" if r.random() < 0.9 else "")

    def part(kind: str) -> str:
        tags, names = PARTS[kind]
        tag = r.choice(tags) if style == "plain" or r.random() < 0.4 else "div"
        sure = tag in ("nav", "header", "footer", "aside", "form", "ins") and r.random() < 0.4
        a = "" if sure else attrs(names, 1.0, kind)
        if kind == "menu":
            body = "".join(f"<li>{link()}</li>" for _ in range(r.randint(2, 9)))
            body = body if tag == "ul" else f"<ul>{body}</ul>"
        elif kind == "header":
            body = r.choice([f"<h1>{words(1, 4)}</h1>", link(), f"<p>{words(1, 6)}</p>"]) + (part("menu") if r.random() < 0.5 else "")
        elif kind == "footer":
            body = r.choice([f"&copy; {words(2, 12)}", f"<p>&copy; {words(2, 12)}</p>", "".join(f"<li>{link()}</li>" for _ in range(4)), f"<div>{words(3, 25)}</div>"])
        elif kind == "sidebar":
            body = r.choice([f"<h3>{words(1, 3)}</h3><ul>" + "".join(f"<li>{link()}</li>" for _ in range(r.randint(2, 8))) + "</ul>", paragraph(3, 40), f"<h4>{words(1, 3)}</h4>{paragraph(3, 30)}", words(3, 20)])
        elif kind == "notice":
            body = r.choice([words(4, 30), f"<p>{words(4, 40)}</p>"]) + r.choice(["" if style == "plain" else f"<button>{words(1, 2)}</button>", f"<button>{words(1, 2)}</button>", link()])
        elif kind == "advert":
            body = r.choice([words(3, 30), f"<p>{words(3, 30)}</p>", link(), f'<img src="/x.png"><p>{words(2, 10)}</p>'])
        elif kind == "form":
            body = f"<label>{words(1, 3)}</label><input type=text>" + r.choice([f"<p>{words(3, 20)}</p>", ""]) + f"<button>{words(1, 2)}</button>"
        else:
            item, same = r.choice(["li", "div", "div", "p"] if style == "plain" else ["li", "div", "div", "div"]), attrs(["comment", "reply", "comment-body", "response", "review"], 0.85, "comment")
            body = r.choice([f"<h3>{words(1, 3)}</h3>", f"<h2>{words(1, 2)}</h2>", ""]) + "".join(f"<{item}{same}>" + (words(3, 60) if item == "p" else r.choice(["", f"<b>{words(1, 2)}</b> ", f"<h4>{words(1, 2)}</h4>", f"<span>{words(1, 2)}</span>"]) + r.choice([paragraph(), paragraph(3, 60), words(3, 40)])) + f"</{item}>" for _ in range(r.randint(1, 6) if style == "plain" else r.randint(2, 8)))
        return f'<{tag}{a} data-label="0">{body}</{tag}>'

    def story() -> str:
        items = [f"<h1>{words(2, 9)}</h1>"] if r.random() < 0.85 else []
        for _ in range(r.choice([1, 2, 3, 5, 8, 14])):
            kind = r.random()
            items.append(
                paragraph() if kind < 0.78 else f"<h2>{words(1, 6)}</h2>" if kind < 0.85 else "<ul>" + "".join(f"<li>{words(2, 25)}</li>" for _ in range(r.randint(2, 5))) + "</ul>" if kind < 0.9
                else f"<blockquote>{paragraph(4, 30)}</blockquote>" if kind < 0.93 else f"<pre>{words(3, 30)}</pre>" if kind < 0.95 else f"<table><tr><td>{words(1, 4)}</td><td>{words(1, 4)}</td></tr></table>" if kind < 0.97 else f"<figure><figcaption>{words(3, 12)}</figcaption></figure>"
            )
            if r.random() < 0.06:
                items.append(part(r.choice(["advert", "sidebar", "notice", "form"])))
        if r.random() < 0.12:
            items.append(part("comments"))
        if r.random() < 0.12:  # no element of its own around the story
            return "".join(x if "data-label" in x[:99] else re.sub(r"^<(\w+)", r'<\1 data-label="1"', x) for x in items)
        body = "".join(items)
        tag = r.choice(["article", "article", "main", "div", "div", "section"] if style == "plain" else ["article", "div", "div", "div", "section"])
        a = "" if tag in ("article", "main") and r.random() < 0.6 else attrs(CONTENT_NAMES, 0.85 if tag == "div" else 1.0, "content")
        return f'<{tag}{a} data-label="1">{body}</{tag}>'

    out = []
    for _ in range(count):
        style = r.choice(["plain", "plain", "foreign", "random", "random", "none"])
        before = [part(k) for k in ("header", "menu", "notice", "advert", "sidebar", "form") if r.random() < 0.45]
        after = [part(k) for k in ("comments", "sidebar", "advert", "form", "menu", "footer", "notice") if r.random() < 0.4]
        r.shuffle(before)
        r.shuffle(after)
        body = "".join([*before, story(), *after])
        if r.random() < 0.3:
            body = f"<div{attrs(['wrapper', 'container', 'page', 'site', 'layout'])}>{body}</div>"
        out.append(f"<!DOCTYPE html><html><head><title>{words(1, 6)}</title></head><body>{body}</body></html>")
    return out


def train(pages: Iterable[str] | None = None) -> Model:
    return Model().fit(labelled_pages() if pages is None else pages)


# ---------------------------------------------------------------- the operator


def extract_text(pages: DataFrame, model: Model | None = None, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """pages with out_col in place of html_col: the main text, empty if there is none or html is null or empty.

    Pages of any length are taken whole.  Rows keep their other columns (one named like out_col is replaced); repeated rows
    stay; a node as likely content as not is left out; an empty table gives an empty result.
    """
    pages = pages.drop(*[c for c in pages.columns if c == out_col and c != html_col])
    shared = pages.sparkSession.sparkContext.broadcast(model or train())  # a few hundred potentials
    at = pages.columns.index(html_col)
    schema = ", ".join(f"`{out_col if f.name == html_col else f.name}` {'string' if f.name == html_col else f.dataType.simpleString()}" for f in pages.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts = pa.array([own.extract(x) for x in batch.column(at).to_pylist()], pa.string())
            columns = list(batch.columns)
            columns[at] = texts
            yield pa.RecordBatch.from_arrays(columns, names=[out_col if i == at else n for i, n in enumerate(batch.schema.names)])

    return map_batches(pages, run, schema)


def op8_html(spark, sf_dir: str) -> DataFrame:
    """The main text of every page; nulls, empty and long pages, repeats and empty tables as in extract_text."""
    found = extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
