"""Main text of pages through union-free wrappers of hosts.

A page is a tree of tags and texts. The trees of a host's distinct pages are aligned one after the other, level by level: nodes
that agree are merged; siblings that only one side has become optional, `( )?`, or, where they are further turns of the siblings before them,
a repeated group, `( )+`; a text that stays the same is part of the template, one that differs is a slot, `#`. The result is one regular
expression without unions for each host, its wrapper. Siblings are matched by equal contents, else by label and its number among
the siblings, along a longest increasing subsequence, in n log n. A host's pages are dealt into parts of about FAN, aligned there, and the parts'
wrappers again, until one is left, so a host with a third of all pages is aligned in many tasks.

Each page is then matched with its host's wrapper, and the wrapper chooses the text. A text place is fixed when one text outweighs, by votes, all others
and PRIOR pages more; other places are slots, weighed by their mean length on the host. Marked elements (`article`, `main`, role=main or role=article) count
MARK times; if they hold SHARE of the weight the text is theirs, all of it, else the text is that of the slots of the page. Elements that are never
main text by name (menus, headers, footers, sidebars, forms, scripts, styles), hidden ones and blocks with a word of WORDS as class, id or role are left out; a
block with a word of WEAK goes outside marked elements, and inside them only where its text is fixed. A word on an inline element counts only if the block has no other text.

Defined cases: null or empty html gives an empty text; a host with few pages has few fixed places (PRIOR); broken or unclosed tags end with the
block that follows; repeated rows give equal texts, and copies of a page are aligned once; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import html as entities
import json
import re
from bisect import bisect_left
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winback.llm.common import cut, only
from winback.llm.urls import parts

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>", re.S)
#: One attribute after the other, its value included, so that no part of a value passes for a name.
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
    head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul""".split())
CLOSES_P = BLOCK - {"body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "option", "optgroup"}
#: Elements and class, id or role words that are never main text.
NEVER = frozenset("script style noscript template iframe textarea title head nav header footer aside form button select input dialog menu svg canvas object audio video map".split())
WORDS = frozenset("""ad ads adv advert adverts advertisement advertising adsense sponsor sponsored banner cookie cookies consent gdpr notice notices
    menu nav navbar navigation breadcrumb breadcrumbs sidebar aside comment comments commentlist replies disqus
    footer header masthead newsletter popup paywall pagination pager toolbar complementary contentinfo""".split())
#: Words that stand in an article's own elements as well.
WEAK = frozenset("alert warning related share sharing social reply respond discussion subscribe subscription modal overlay login signup search widget promo promotion".split())
MARKS = ("article", "main")
#: Pages assumed to differ at every text place, beside those seen.
PRIOR = 4
#: How many times text in a marked element counts, and the share of the weight that marked elements must hold.
MARK, SHARE = 100, 0.9
#: Mean number of trees aligned one after the other.
FAN = 256
#: Elements nested deeper count as siblings in wrappers; texts are not concerned.
DEEPEST = 100


def tokens(page: str):
    """('text', raw text) | ('open', name, attributes) | ('close', name); contents of scripts and the like are passed over."""
    place, end = 0, len(page)
    while place < end:
        m = TAG.search(page, place)
        if not m:
            yield "text", page[place:]
            return
        if m.start() > place:
            yield "text", page[place: m.start()]
        place = m.end()
        name = (m[2] or m[5] or "").lower()
        if m[0].startswith("<![CDATA["):
            yield "text", m[0][9:].removesuffix("]]>").replace("&", "&amp;")
        if not name:
            continue
        if m[1] or m[4]:
            yield "close", name
            continue
        yield "open", name, m[3] if m[2] else m[6]
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}\b", re.I).search(page, place)
            place = close.start() if close else end
        elif (m[3] or m[6] or "").rstrip().endswith("/") and name not in VOID:
            yield "close", name


def role(name: str, attributes: str) -> str | None:
    """'never', 'weak', 'word' (on an inline element), or the region an element opens."""
    if not attributes:
        return "never" if name in NEVER else name if name in MARKS else None
    found: dict[str, str] = {}
    for k, v in ATTRIBUTE.findall(attributes):
        found.setdefault(k.lower(), v.strip("\"'").lower())  # the first of a name counts, as in HTML
    named = " ".join(v for k, v in found.items() if k in ("class", "id", "role"))
    words = set(re.split(r"[^a-z0-9]+", named)) if named else set()
    if name in NEVER or "hidden" in found or found.get("aria-hidden") == "true":
        return "never"
    if name in ("html", "body", *MARKS):
        return "never" if words & {"comment", "comments", "reply"} else name if name in MARKS else None
    if words & WORDS:
        return "never" if name in BLOCK else "word"
    if words & WEAK:
        return "weak" if name in BLOCK else "word"
    return "main" if found.get("role") in ("main", "article") else None


# A node is [label, optional, group, children, text, votes, turns, length]. A label is a tag, the mark it is, a tag and `!` for a block with a weak word, or `#` for
# a text place. Neighbours of one group (0: none) are a repeated group. text is the hash of the text that leads, votes by how much; turns and length are sums.
LABEL, OPTIONAL, GROUP, CHILDREN, TEXT, VOTES, TURNS, LENGTH = range(8)


class Walk:
    """Blocks of a page, (text, in a marked element, below a weak word, text places), and the page's tree."""

    def __init__(self, page: str) -> None:
        self.blocks: list[tuple[str, bool, bool, list]] = []
        self.top: list = []
        names: list[str] = []  # of the open elements
        stack: list[tuple] = []  # their (state, children); state: never, marked, weak, word
        held: list[str] = []
        places: list[tuple[list, bool]] = []
        every: list[list] = []
        state = (False, False, False, False)

        def back(name: str) -> None:
            while names.pop() != name:
                stack.pop()
            stack.pop()

        def flush() -> None:
            if not held:
                return
            text = "".join(held)
            text = " ".join((entities.unescape(text) if "&" in text else text).split())
            if text and not all(word for _, word in places):
                self.blocks.append((text, state[1], state[2], [p for p, _ in places]))
            held.clear()
            places.clear()

        for token in tokens(page):
            if token[0] == "text":
                if state[0]:
                    continue
                held.append(token[1])
                if token[1].strip():
                    here = stack[-1][1] if stack else self.top
                    if not (here and here[-1][LABEL] == "#"):
                        here.append(["#", False, 0, [], [], 1, 1, 0])
                        every.append(here[-1])
                    here[-1][TEXT].append(token[1])
                    places.append((here[-1], state[3]))
                continue
            name = token[1]
            if name == "br":
                held.append(" ")
                continue
            kind = role(name, token[2]) if token[0] == "open" and not state[0] else None
            if name in BLOCK or kind in ("main", "article"):
                flush()
            if token[0] == "open":
                if name in CLOSES_P and "p" in names:
                    back("p")
                elif name in ("li", "dt", "dd", "tr", "td", "th", "option") and names and names[-1] == name:
                    back(name)
                above, siblings = stack[-1] if stack else ((False,) * 4, self.top)
                if name not in VOID:
                    children = siblings if len(stack) >= DEEPEST else []
                    if children is not siblings and not above[0]:
                        siblings.append([kind if kind in MARKS else f"{name}!" if kind == "weak" else name, False, 0, children, 0, 0, 1, 0])
                    names.append(name)
                    stack.append((above if above[0] else (above[0] or kind == "never", above[1] or kind in MARKS, above[2] or kind == "weak", above[3] or kind == "word"), children))
            elif name in names:
                if name not in BLOCK and names[-1] != name and not BLOCK.isdisjoint(names[-1 - names[::-1].index(name):]):
                    flush()
                back(name)
            now = stack[-1][0] if stack else (False,) * 4
            if now[1] != state[1]:
                flush()
            state = now
        flush()
        for place in every:
            text = " ".join("".join(place[TEXT]).split())
            place[TEXT], place[LENGTH] = xxhash.xxh32_intdigest(text.encode("utf-8", "surrogatepass")), len(text)


def slim(nodes: list) -> list:
    """A page's own tree in few bytes."""
    return [[n[TEXT], n[LENGTH]] if n[LABEL] == "#" else [n[LABEL], slim(n[CHILDREN])] for n in nodes]


def full(nodes: list) -> list:
    return [["#", False, 0, [], a, 1, 1, b] if isinstance(a, int) else [a, False, 0, full(b), 0, 0, 1, 0] for a, b in nodes]


def digest(node: list) -> int:
    return hash((node[LABEL], node[TEXT], *map(digest, node[CHILDREN])))


def paired(one: list, two: list) -> list[tuple[int, int, bool]]:
    """Places of siblings that match, in order: equal contents (True), else the same label and number, along a longest increasing subsequence."""
    if [n[LABEL] for n in one] == [n[LABEL] for n in two]:
        return [(k, k, False) for k in range(len(one))]
    digests = [[digest(n) for n in side] for side in (one, two)]
    both = set(digests[0]) & set(digests[1])
    keys = []
    for side, own in zip((one, two), digests):
        seen: dict = {}
        keys.append([])
        for node, d in zip(side, own):
            key = d if d in both else node[LABEL]
            seen[key] = seen.get(key, 0) + 1
            keys[-1].append((key, seen[key]))
    place = {key: j for j, key in enumerate(keys[1])}
    pairs = [(i, place[key]) for i, key in enumerate(keys[0]) if key in place]
    tails: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tails, j)
        before.append(ends[at - 1] if at else -1)
        tails[at: at + 1] = [j]
        ends[at: at + 1] = [k]
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append((*pairs[k], digests[0][pairs[k][0]] == digests[1][pairs[k][1]]))
        k = before[k]
    return out[::-1]


def turns(above: list, end: int, extra: list, same: set[int]) -> int:
    """Length of the group, the last siblings of above[:end], that `extra` takes some more turns of; 0 if none. A sibling of equal contents on both sides starts no group."""
    labels = [n[LABEL] for n in extra]
    for k in range(1, min(len(extra), end) + 1):
        if end - k in same and not above[end - k][GROUP]:
            break
        if len(extra) % k == 0 and above[end - 1][LABEL] == labels[k - 1] and labels[k:] == labels[:-k] and [n[LABEL] for n in above[end - k: end]] == labels[:k]:
            return k
    return 0


def merged(one: list, two: list) -> list:
    if one[LABEL] == "#":
        lead, rest = (one, two) if one[VOTES] >= two[VOTES] else (two, one)
        votes = lead[VOTES] + (rest[VOTES] if one[TEXT] == two[TEXT] else -rest[VOTES])
        return ["#", one[OPTIONAL] or two[OPTIONAL], one[GROUP] or two[GROUP], [], lead[TEXT], votes, one[TURNS] + two[TURNS], one[LENGTH] + two[LENGTH]]
    return [one[LABEL], one[OPTIONAL] or two[OPTIONAL], one[GROUP] or two[GROUP], align(one[CHILDREN], two[CHILDREN]), 0, 0, one[TURNS] + two[TURNS], 0]


def align(one: list, two: list) -> list:
    """The wrapper of two lists of siblings."""
    out: list = []
    same: set[int] = set()
    last = max((n[GROUP] for n in (*one, *two)), default=0)

    def more(extra: list) -> None:
        nonlocal last
        k = turns(out, len(out), extra, same) if extra else 0
        if not k:
            out.extend([n[LABEL], True, *n[GROUP:]] for n in extra)
            return
        base = out[-k:]
        group = base[-1][GROUP]
        if not group:
            group = last = last + 1
        for lo in range(0, len(extra), k):
            base = [merged(x, y) for x, y in zip(base, extra[lo: lo + k])]
        out[-k:] = [[*n[:GROUP], group, *n[CHILDREN:]] for n in base]

    i = j = 0
    for a, b, equal in [*paired(one, two), (len(one), len(two), False)]:
        more(one[i:a])
        more(two[j:b])
        if a < len(one):
            if equal:
                same.add(len(out))
            out.append(merged(one[a], two[b]))
        i, j = a + 1, b + 1
    return out


def written(nodes: list) -> str:
    """A wrapper as a regular expression; a text place that is fixed is written `=`."""
    words = []
    k = 0
    while k < len(nodes):
        end = k + 1
        while nodes[k][GROUP] and end < len(nodes) and nodes[end][GROUP] == nodes[k][GROUP]:
            end += 1
        inner = []
        for n in nodes[k:end]:
            body = ("=" if fixed(n) else "#") if n[LABEL] == "#" else f"<{n[LABEL]}> {written(n[CHILDREN])} </{n[LABEL]}>".replace("  ", " ")
            inner.append(f"( {body} )?" if n[OPTIONAL] else body)
        words.append(f"( {' '.join(inner)} )+" if nodes[k][GROUP] else inner[0])
        k = end
    return " ".join(words)


def fixed(place: list | None) -> bool:
    return place is not None and 2 * place[VOTES] > place[TURNS] + PRIOR


def matched(wrapper: list, nodes: list, found: dict[int, list]) -> dict[int, list]:
    """The wrapper's text place of each text place of a page that has one, by id."""
    def both(one: list, two: list) -> None:
        if one[LABEL] == "#":
            found[id(two)] = one
        else:
            matched(one[CHILDREN], two[CHILDREN], found)

    if [n[LABEL] for n in wrapper] == [n[LABEL] for n in nodes]:
        for x, y in zip(wrapper, nodes):
            both(x, y)
        return found
    i = j = 0
    same: set[int] = set()
    for a, b, equal in [*paired(wrapper, nodes), (len(wrapper), len(nodes), False)]:
        extra = nodes[j:b]
        k = turns(wrapper, i, extra, same) if extra else 0
        if k:
            for lo in range(0, len(extra), k):
                for x, y in zip(wrapper[i - k: i], extra[lo: lo + k]):
                    both(x, y)
        if a < len(wrapper):
            both(wrapper[a], nodes[b])
            if equal:
                same.add(a)
        i, j = a + 1, b + 1
    return found


def main_text(page: str, wrapper: list) -> str:
    """The text that a host's wrapper chooses on a page."""
    walk = Walk(page)
    place = matched(wrapper, walk.top, {})
    weight = {True: 0.0, False: 0.0}
    rows = []
    for text, marked, weak, places in walk.blocks:
        template = all(fixed(place.get(id(p))) for p in places)
        rows.append((text, marked, weak, template))
        if marked or not (weak or template):
            weight[marked] += sum(p[LENGTH] if (w := place.get(id(p))) is None else w[LENGTH] / w[TURNS] for p in places)
    if MARK * weight[True] >= SHARE * (MARK * weight[True] + weight[False]) > 0:
        return "\n\n".join(text for text, marked, weak, template in rows if marked and not (weak and template))
    return "\n\n".join(text for text, marked, weak, template in rows if not template and (marked or not weak))


def wrappers(streams: DataFrame) -> DataFrame:
    """(host, wrapper) from (host, key, wrapper), one row for each distinct page: parts of a host first, then the parts' wrappers, until one is left."""
    def run(batches):
        at, now = None, []
        for b in batches:
            rows = []
            for host, salt, text in zip(b["host"], b["salt"], b["wrapper"]):
                if at != (host, salt):
                    if at:
                        rows.append((*at, json.dumps(now, separators=(",", ":"))))
                    at, now = (host, salt), json.loads(text)
                else:
                    now = align(now, json.loads(text))
            yield pd.DataFrame(rows, columns=["host", "key", "wrapper"])
        if at:
            yield pd.DataFrame([(*at, json.dumps(now, separators=(",", ":")))], columns=["host", "key", "wrapper"])

    tasks = 2 * streams.sparkSession.sparkContext.defaultParallelism
    while True:
        sizes = streams.groupBy("host").agg(F.count("*").alias("n"))
        if (sizes.agg(F.max("n")).first()[0] or 0) <= 1:
            return streams.select("host", "wrapper")
        dealt = streams.join(sizes, "host").withColumn("salt", F.pmod(F.xxhash64("key"), F.ceil(F.col("n") / FAN))).select("host", "salt", "key", "wrapper")
        streams = cut(dealt.repartition(tasks, "host", "salt").sortWithinPartitions("host", "salt", "key").mapInPandas(run, "host string, key long, wrapper string"), "page-wrappers")


def learned(own: DataFrame) -> DataFrame:
    """(host, wrapper) of pages with host and html."""
    def seen(batches):
        for b in batches:
            yield pd.DataFrame({"host": b["host"], "key": b["key"], "wrapper": [json.dumps(slim(Walk(p).top), separators=(",", ":")) for p in b["html"]]})

    def grow(batches):
        for b in batches:
            yield b.assign(wrapper=[json.dumps(full(json.loads(w)), separators=(",", ":")) for w in b["wrapper"]])

    schema = "host string, key long, wrapper string"
    rows = own.select("host", F.xxhash64("html").alias("key"), F.coalesce("html", F.lit("")).alias("html")).where("html != ''")
    slims = rows.mapInPandas(seen, schema).dropDuplicates(["host", "key"])  # equal keys have equal trees
    return wrappers(cut(slims.mapInPandas(grow, schema), "page-streams"))


@lru_cache(64)
def parsed(wrapper: str) -> list:
    return json.loads(wrapper)


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    own = only(pages, page_id="page_id", url="url", html="html").withColumn("host", F.coalesce(parts(F.col("url"))[0], F.lit("")))
    hosts = cut(learned(own), "page-hosts")

    def run(batches):
        for b in batches:
            texts = [main_text(p or "", parsed(w or "[]")) for p, w in zip(b["html"], b["wrapper"])]
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return own.join(hosts, "host", "left").mapInPandas(run, f"page_id {own.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
