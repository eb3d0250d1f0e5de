"""Main text of web pages as the maximum-scoring subsequence of their tokens.

A page is a sequence of words and tags. A word scores by the elements around it: each of
their features (tag, class, id and role words, being hidden, lying in or outside a marked
article) adds its weight, so words of the article score positive and words of menus or
adverts negative; tags score negative. The contiguous stretch with the largest sum, found
in one linear scan, is the content region. Words in it that score negative are left out.

The weights are learned on labelled pages: pages that mark their own article. A logistic
model over the features of the elements around a word is fitted to whether the word lies
in the marked article; it starts from, and is held to, prior weights for elements and
names whose role is known, so what the pages do not contradict keeps its prior. Whether a
word lies in or outside a marked article, and the tags, get log odds of their own. At most
``sample_pages`` pages, chosen by a hash of their ids, and of them the ``sample_rows``
commonest sets of features are read for it. Every page is then extracted whole.

Defined results: a null or empty html gives the empty text; an empty table gives no rows;
rows with null or repeated ids are extracted each for itself; unclosed elements end with
their parent, unclosed comments and scripts with the page; a "<" that opens no tag is
text; other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstone.llm.common import bounded_batches

# Fixed lists: elements by their role in a page.
_BLOCKS = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style noscript template iframe object svg canvas video audio textarea select title xmp noembed noframes".split())
_LANDMARKS = ("article", "main")
_WHOLE_PAGE = ("html", "body", *_LANDMARKS)
_HELD = _BLOCKS | set("a button label option optgroup datalist head".split())
#: Prior weights of elements. A header inside a marked article is a feature of its own.
_ELEMENTS = dict.fromkeys("head nav footer aside form button menu dialog fieldset label option optgroup datalist header".split(), -6.0) | {"p": 0.5, "a": -0.8, "ul": -0.2, "li": -0.2}
#: Words of a class, id or role that name something other than the article: alone or as part of a longer name, and only alone.
_STRONG = re.compile(
    r"ads?|advert\w*|adsense|sponsor\w*|promo\w*|cookies?|consent|gdpr|popup|modal|newsletter|subscribe|subscription|signup|login|sidebar"
    r"|comments?|commentlist|disqus|replies|respond|nav|navbar|navigation|menu|breadcrumbs?|pagination|pager|footer|masthead|topbar|sharing|related|recommended|recommendations|toolbar|contentinfo|complementary|share"
)
_WEAK = re.compile(r"banner|notice|notices|alert|overlay|aside|rail|toc|social|popular|trending|widget|search|skip|copyright|side-bar|site-header|page-header")
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)

STRONG, WEAK, HIDDEN = -4.0, -1.5, -12.0
#: Weights where no labelled page tells otherwise: of any word, of one in or outside a marked article, of a tag.
DEFAULTS = {"word": 1.0, "inside": 2.0, "outside": -4.0, "tag": -0.3}
#: A word scores within these limits. A marked article does not end at an advert or a tag inside it, so negative words there cost next to nothing and tags this share.
LOWEST, HIGHEST, INNER, WITHIN = -2.0, 1.5, -0.02, 0.05
#: An element that holds this share of the page's words is not judged by its names as fully.
MOST = 0.9
SAMPLE_PAGES, SAMPLE_ROWS = 2000, 20_000


def prior(feature: str) -> float:
    """The weight of a feature that no labelled page tells about."""
    kind, _, name = feature.partition(":")
    if kind == "tag":
        return _ELEMENTS.get(name, 0.0)
    if kind == "hidden":
        return HIDDEN
    if kind == "name":
        return STRONG if _STRONG.fullmatch(name) or _WEAK.fullmatch(name) else 0.0
    return STRONG if _STRONG.fullmatch(name) else WEAK if _WEAK.fullmatch(name) else 0.0


def element_features(name: str, attributes: str) -> list[str]:
    """A tag's features: its name, its class, id and role words whole ("name:") and in parts ("part:")."""
    found = [f"tag:{name}"]
    if not attributes:
        return found
    if name not in ("html", "body") and _HIDDEN.search(attributes):
        found.append("hidden:")
    for m in _NAMED.finditer(attributes):
        for word in (m[1] or m[2] or m[3] or "").lower().split():
            found.append(f"name:{word}")
            parts = re.split("[_-]+", word)
            if len(parts) > 1 and name not in _WHOLE_PAGE:
                found += [f"part:{p}" for p in parts if p]
    return found


class Page:
    """A page's tokens in order, its elements, and how many words each holds.

    Tokens are (kind, text, element, block): kind is "word" for text between tags, else the
    tag; element is the innermost one around it, -1 for none.
    """

    def __init__(self, page: str) -> None:
        self.tokens: list[tuple[str, str, int, int]] = []
        self.names: list[str] = []
        self.features: list[list[str]] = []
        self.parents: list[int] = []
        self._read(page)
        self.words = np.zeros(len(self.names) + 1, np.int64)  # the last is of text in no element
        for kind, text, element, _ in self.tokens:
            if kind == "word":
                self.words[element] += len(text.split())
        for k in range(len(self.names) - 1, -1, -1):
            self.words[self.parents[k]] += self.words[k]
        self.total = int(self.words[-1])

    def _read(self, page: str) -> None:
        stack: list[int] = []
        held: Counter[str] = Counter()
        at, block, end = 0, 0, len(page)

        def drop(depth: int) -> None:
            for k in stack[depth:]:
                held[self.names[k]] -= 1
            del stack[depth:]

        while at < end:
            m = _MARKUP.search(page, at)
            start = m.start() if m else end
            if start > at:
                self.tokens.append(("word", page[at:start], stack[-1] if stack else -1, block))
            if not m:
                return
            at = m.end()
            closing, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not name:
                continue
            name = name.lower()
            if not closing and name in _RAW and not attributes.endswith("/"):
                close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                at = close.end() if close else end
                continue
            block += name in _BLOCKS
            if closing:
                if held[name]:
                    depth = len(stack) - 1
                    while self.names[stack[depth]] != name:
                        depth -= 1
                    drop(depth)
                self.tokens.append((name, "", stack[-1] if stack else -1, block))
                continue
            if name in ("p", "li"):
                while stack and self.names[stack[-1]] in (("p", "a") if name == "p" else ("p", "li", "a")) and (held["p"] or name == "li" and held["li"]):
                    drop(len(stack) - 1)
            self.tokens.append((name, "", stack[-1] if stack else -1, block))
            if name in _VOID or attributes.endswith("/"):
                continue
            features = element_features(name, attributes)
            if name in _HELD or len(features) > 1:
                self.names.append(name)
                self.features.append(features)
                self.parents.append(stack[-1] if stack else -1)
                stack.append(len(self.names) - 1)
                held[name] += 1

    def marked(self, sums: np.ndarray) -> np.ndarray:
        """Of each element, whether it lies in a marked article that can be believed: one that nothing drops and that holds a twentieth of the words at least."""
        own = np.array([n in _LANDMARKS and sums[k] >= 0 for k, n in enumerate(self.names)] + [False])
        inside = own.copy()
        for k, p in enumerate(self.parents):
            inside[k] |= inside[p]
        top = [k for k in np.flatnonzero(own) if not inside[self.parents[k]]]
        return inside if top and self.words[top].sum() * 20 >= self.total else np.zeros_like(inside)

    def sums(self, weights: dict[str, float], marked: np.ndarray | None = None) -> np.ndarray:
        """Of each element, the weights of all distinct features of it and those around it, and of a word as such."""
        word = weights.get("word", DEFAULTS["word"])
        out = np.full(len(self.names) + 1, word)
        seen: list[frozenset[str]] = []
        for k, (features, parent) in enumerate(zip(self.features, self.parents, strict=True)):
            around = seen[parent] if parent >= 0 else frozenset()
            share = self.words[k] / max(1, self.total)
            scale = 1.0 if share < MOST else (1.0 - share) / (1.0 - MOST)
            fresh = [f for f in features if f not in around]
            total = out[parent]
            for f in fresh:
                if f == "tag:header" and marked is not None and marked[parent]:
                    continue
                weight = weights[f] if f in weights else prior(f)
                total += weight * scale if f[0] in "np" else weight
            out[k] = total
            seen.append(around.union(fresh) if fresh else around)
        return out

    def scores(self, weights: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
        """Of each element, the score of a word in it and whether it lies in a marked article."""
        marked = self.marked(self.sums(weights))
        out = self.sums(weights, marked)
        if marked.any():
            out += np.where(marked, weights.get("inside", DEFAULTS["inside"]), weights.get("outside", DEFAULTS["outside"]))
        return np.clip(out, LOWEST, HIGHEST), marked


def best_stretch(scores: list[float]) -> tuple[int, int]:
    """The contiguous stretch with the largest sum, the first such one; empty where no sum is positive."""
    best, span, total, first = 0.0, (0, 0), 0.0, 0
    for n, score in enumerate(scores):
        if total <= 0:
            total, first = 0.0, n
        total += score
        if total > best:
            best, span = total, (first, n + 1)
    return span


def token_scores(page: Page, weights: dict[str, float]) -> tuple[list[float], np.ndarray]:
    """The score of every token, and of a word of every element."""
    of, marked = page.scores(weights)
    cost = np.where(marked & (of < 0), INNER, of).tolist()
    tag, within = weights.get("tag", DEFAULTS["tag"]), np.where(marked, WITHIN, 1.0).tolist()
    return [cost[element] * len(text.split()) if kind == "word" else within[element] * weights.get(f"markup:{kind}", tag) for kind, text, element, _ in page.tokens], of


def extract(text: str, weights: dict[str, float]) -> str:
    """The text of the best contiguous region, one block a paragraph."""
    page = Page(text)
    scores, of = token_scores(page, weights)
    blocks: dict[int, list[str]] = {}
    for n in range(*best_stretch(scores)):
        kind, piece, element, block = page.tokens[n]
        if of[element] < 0:
            continue
        if kind == "word":
            blocks.setdefault(block, []).append(piece)
        elif kind in ("br", "td", "th") and block in blocks:
            blocks[block].append(" ")
    joined = (" ".join(html.unescape("".join(parts)).split()) for parts in blocks.values())
    return "\n\n".join(x for x in joined if x)


# -- learning ------------------------------------------------------------------------------


def counts(text: str) -> dict[str, tuple[int, int]]:
    """Of a page that marks its article, by set of features, how many words lie inside and outside it; by tag ("markup:"), how many tags; empty without a mark.

    Words inside that the prior weights drop (an advert in the article) count as outside.
    """
    page = Page(text)
    sums = page.sums({})
    marked = page.marked(sums)
    if not marked.any():
        return {}
    out: dict[str, list[int]] = {}
    sets: list[frozenset[str]] = []
    for features, parent in zip(page.features, page.parents, strict=True):
        sets.append((sets[parent] if parent >= 0 else frozenset()).union(features))
    keys = ["\t".join(sorted(s)) for s in sets] + [""]
    sums = page.sums({}, marked)
    for kind, piece, element, _ in page.tokens:
        n = len(piece.split()) if kind == "word" else 1
        if n:
            good = bool(marked[element] and sums[element] >= 0)
            for key in (keys[element], "inside" if marked[element] else "outside") if kind == "word" else (f"markup:{kind}",):
                out.setdefault(key, [0, 0])[0 if good else 1] += n
    return {k: (a, b) for k, (a, b) in out.items()}


def _odds(pair: tuple[int, int]) -> float:
    return float(np.log((pair[0] + 1.0) / (pair[1] + 1.0)))


def weights_from(table: dict[str, tuple[int, int]], rounds: int = 200, hold: float = 0.02) -> dict[str, float]:
    """Weights from counts: a logistic model of the features, held to the prior weights, and log odds of the rest.

    Landmark tags are no features of the model, as they are what its labels come from.
    """
    rows = [([f for f in key.split("\t") if f and f not in ("tag:article", "tag:main")], a, b) for key, (a, b) in sorted(table.items()) if key not in ("inside", "outside") and not key.startswith("markup:")]
    names = sorted({f for fs, _, _ in rows for f in fs})
    place = {f: k for k, f in enumerate(names)}
    start = np.array([prior(f) for f in names])
    owner = np.repeat(np.arange(len(rows)), [len(fs) for fs, _, _ in rows])
    of = np.array([place[f] for fs, _, _ in rows for f in fs], np.int64)
    a, b = (np.array([r[k] for r in rows], float) for k in (1, 2))
    size = np.log1p(a + b)  # a menu of many words is no more evidence than that
    share = size / max(1e-9, size.sum())
    target = a / np.maximum(a + b, 1.0)
    weight = start.copy()
    for _ in range(rounds if len(rows) else 0):
        z = DEFAULTS["word"] + np.bincount(owner, weight[of], len(rows))
        error = share * (target - 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))))
        weight += 4.0 * (np.bincount(of, error[owner], len(names)) - hold * (weight - start) / max(1, len(names)))
    out = dict(zip(names, np.round(weight, 6).tolist(), strict=True))
    if "outside" in table:
        out["inside"] = min(max(_odds(table.get("inside", (0, 0))), 0.5), 2.0)
        out["outside"] = min(max(_odds(table["outside"]), -4.0), -0.5)
    return out | {k: min(max(_odds(pair) / 2, -1.5), -0.05) for k, pair in table.items() if k.startswith("markup:")}


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample_pages: int = SAMPLE_PAGES, sample_rows: int = SAMPLE_ROWS) -> dict[str, float]:
    """Weights from at most sample_pages pages that mark their own article, and at most sample_rows rows of counts."""
    bounded_batches(pages.sparkSession)
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{html_col}`").cast("string").alias("html")).where(F.lower("html").rlike("<(?:article|main)[\\s>]"))
    narrow = rows.select(F.col("id").alias("chosen_id"), F.xxhash64("html").alias("chosen_hash")).distinct()
    chosen = narrow.orderBy(F.xxhash64("chosen_id"), "chosen_id", "chosen_hash").limit(sample_pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(k, a, b) for x in batch.column(0) for k, (a, b) in counts(x.as_py() or "").items()]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), *(pa.array([x[c] for x in found], pa.int64()) for c in (1, 2))], names=["kind", "inside", "outside"])

    drawn = F.col("id").eqNullSafe(F.col("chosen_id")) & (F.xxhash64("html") == F.col("chosen_hash"))
    sample = rows.join(F.broadcast(chosen), drawn, "left_semi").dropDuplicates(["id", "html"]).select("html")
    summed = sample.mapInArrow(run, "kind string, inside long, outside long").groupBy("kind").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
    most = summed.orderBy(F.desc(F.col("inside") + F.col("outside")), "kind").limit(sample_rows)
    return weights_from({r["kind"]: (r["inside"], r["outside"]) for r in most.collect()})


def extracted(pages: DataFrame, weights: dict[str, float], html_col: str = "html") -> DataFrame:
    """(page_id, url, text) of every page; page_id and url as they are."""
    bounded_batches(pages.sparkSession)
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x.as_py() or "", weights) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string")
