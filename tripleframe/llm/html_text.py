"""Main text of web pages by equivalence-class template deduction.

1. Every page becomes its tokens, the starts and ends of structural elements, and its
   text blocks. A token is named by its path (``html/body/nav``, with class, id and
   role words as in ``div.ad``).
2. A path's occurrence vector holds its number on each page of the host. Paths on at
   least half of the pages with equal vectors (compared by a 64-bit XOR of hashed
   entries, an aggregate that combines before the shuffle) are one equivalence class.
3. A second pass finds the place of each path among those of its class and parent on
   every page. Where places change (or repetitions differ), the class is broken: the
   path and what lies below it become a class of their own, nested in the first.
   The classes nest by path into the host's template.
4. A third pass sums the text in the slots: a slot lies in one template element
   between two tokens of that element's class. Text under paths that aren't in the
   template (ids of single pages) is in the slot of the template element around it.
5. A slot is constant if at least 95 % of the host's distinct pages that have it (two or
   more) carry one text, unless it is the host's largest slot, or if all it ever holds is
   links; slots inside an article or main element are never constant. The main container is the template element that holds most words which
   are neither links nor constant nor in parts marked as menus, headers, footers,
   sidebars, notices, adverts, forms or comments. Its slots are the main text, but
   for marked parts and constant slots.

The statistics of a host are sums over all its pages; the template that comes back
is a few strings, so a host with a third of the pages is an ordinary skewed join.
A page that its host's template does not fit is judged by its own statistics.

Nulls and odd cases: null or empty html, and html without text, give an empty
text; a null or odd URL counts as the host ""; unclosed tags, raw text elements
and cut-off pages are read as a browser would; repeated rows give a row each;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, written
from .url_filter import host_of

#: HTML elements by their handling.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg select annotation".split())
MATH = "math mrow mi mo mn ms mtext mspace mfrac msqrt mroot msub msup msubsup munder mover munderover mtable mtr mtd mpadded mphantom mstyle menclose semantics mmultiscripts"
INLINE = frozenset(f"{MATH} a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var br wbr img".split())
NO_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
#: Elements that aren't part of an article, and English words that name such parts in classes,
#: ids and roles: a tie-break on a slot's own elements, chosen here.
APART = frozenset("head nav footer aside form button dialog menu".split())
MARKS = frozenset("ad ads adv advert adverts advertisement advertisements advertising sponsor sponsors sponsored promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs sidebar sidebars aside rail cookie cookies consent notice alert popup modal gdpr comment comments reply replies disqus discussion footer header masthead topbar share sharing social related recommended widget newsletter subscribe subscription signup login search pagination pager tags toolbar complementary contentinfo".split())
#: A mark before one of these words names a part ("comment-list"); before another it may be a topic ("related-work").
PARTS = frozenset("list bar box wrap wrapper container holder links link item items area section widget block left right top bottom inner outer content slot unit body form button buttons main panel group row column col primary secondary text message overlay".split())
LAYOUT = frozenset("has with without no not is".split())
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
LABEL = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)


def step_of(tag: str, attributes: str) -> str:
    """One step of a path: the element with its class, id and role words; for very long
    lists of them a hash, after a word that marks like they do."""
    words = []
    if "=" in attributes:
        for _, a, b, c in LABEL.findall(attributes):
            words += (a or b or c).split()
        if sum(map(len, words)) > 400:
            mark = next((["sidebar", "header"][k] for k, inside in enumerate((True, False)) if any(marked(f"div.{w}", inside) for w in words)), None)
            words = [*([mark] if mark else []), f"{crc32(' '.join(words).encode('utf-8', 'surrogatepass')):08x}"]
    return ".".join([tag, *dict.fromkeys(words)]).replace("\n", " ").replace("/", "_")


@lru_cache(65536)
def names_part(word: str, inside: bool) -> bool:
    """Whether a class, id or role word names a part that isn't the article: a mark alone or
    at the end ("site-footer"), or a mark before the word for a part ("commentList"). Other
    words after a mark ("footer-blue") count outside of articles only."""
    words = [w.lower() for w in WORDS.findall(word)]
    if not words or words[0] in LAYOUT:
        return False
    own = MARKS - {"header"} if inside else MARKS
    if words[-1] in own or (len(words) > 1 and words[0] in own and (not inside or words[-1] in PARTS)):
        return True
    return len(words) == 1 and any(words[0] == m + part for m in own for part in PARTS if words[0].startswith(m))


def marked(step: str, inside: bool) -> bool:
    """Whether a step says that it is not part of an article; ``inside`` an article or main element
    a header is its own. Words on the page itself or on an article say how it looks, not that it is none."""
    tag, *words = step.split(".")
    if tag in ("#", "html", "body", "main"):
        return False
    if tag == "article":
        return any(w.lower() in ("comment", "comments", "reply") for w in words)
    if tag in APART or (tag == "header" and not inside):
        return True
    return any(names_part(word, inside) for word in words)


def apart(steps: list[str]) -> bool:
    """Whether any step of a path is marked."""
    inside = False
    for step in steps:
        if marked(step, inside):
            return True
        inside = inside or step.split(".")[0] in ("article", "main")
    return False


def parse(html: str) -> tuple[list[tuple[str, str, int, int]], list[tuple[str, bool]]]:
    """Text blocks (path, text, words in links, number of tokens before it) in page order, and
    the tokens: the path of each structural element where it starts (True) and ends (False)."""
    stack: list[tuple[str, str, bool]] = []  # element, path, whether the path is its own
    open_now: dict[str, int] = {}
    blocks, tokens, piece = [], [("#", True)], []
    path = "#"
    links = link_words = 0
    at, n = 0, len(html)

    def text(part):
        nonlocal link_words
        if part:
            part = unescape(part)
            piece.append(part)
            if links:
                link_words += len(part.split())

    def flush():
        nonlocal link_words
        if piece:
            joined = " ".join("".join(piece).split())
            if joined:
                blocks.append((path, joined, link_words, len(tokens)))
            piece.clear()
        link_words = 0

    def pop_to(k):
        nonlocal path
        for tag, p, own in reversed(stack[k:]):
            open_now[tag] -= 1
            if own:
                tokens.append((p, False))
        del stack[k:]
        path = stack[-1][1] if stack else "#"

    while at < n:
        m = TOKEN.search(html, at)
        if m is None:
            text(html[at:] if not re.match(r"<[a-zA-Z/!?]", html[html.rfind("<") :] or " ") or html.rfind("<") < at else html[at : html.rfind("<")])
            break
        text(html[at : m.start()])
        at = m.end()
        close, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if tag is None:
            continue
        tag = tag.lower()
        if tag in RAW:
            if not close and not attributes.endswith("/"):
                end = re.compile(f"</{re.escape(tag)}(?![a-zA-Z])[^>]*>?", re.I).search(html, at)
                at = end.end() if end else n
            continue
        if tag in INLINE:
            if tag == "a":
                links = max(0, links + (-1 if close else 1)) if close else 1
            elif tag in ("br", "wbr", "img") and tag == "br":
                piece.append(" ")
            continue
        flush()
        links = 0 if tag != "a" else links
        if close:
            for k in range(len(stack) - 1 if open_now.get(tag) else -1, -1, -1):
                if stack[k][0] == tag:
                    pop_to(k)
                    break
            continue
        if tag in NO_P:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    pop_to(k)
                    break
                if stack[k][0] not in ("p", *INLINE):
                    break
        if tag in CLOSES:
            ends, walls = CLOSES[tag]
            for k in range(len(stack) - 1 if any(map(open_now.get, ends.split())) else -1, -1, -1):
                if stack[k][0] in walls:
                    break
                if stack[k][0] in ends.split():
                    pop_to(k)
                    break
        if tag in VOID or attributes.endswith("/"):
            continue
        # deeper nesting stays in the path of its 200th ancestor, but for the first part marked there
        step = step_of(tag, attributes)
        own = len(stack) < 200 or (path.count("/") <= 200 and marked(step, True))
        if own:
            path = f"{path}/{step}"
            tokens.append((path, True))
        stack.append((tag, path, own))
        open_now[tag] = open_now.get(tag, 0) + 1
    flush()
    pop_to(0)
    return blocks, [*tokens, ("#", False)]


def classes_of(tokens: list[tuple[str, int, int]]) -> list[tuple[str, int]]:
    """(path, number of its equivalence class) from a host's tokens (path, pages with it, vector)."""
    numbers: dict[tuple, int] = {}
    return [(path, numbers.setdefault((n, vector), len(numbers))) for path, n, vector in sorted(tokens)]


@lru_cache(64)
def unpacked(packed: str) -> dict[str, int]:
    """path -> class from lines of class, tab, path."""
    return {path: int(number) for number, path in (line.split("\t") for line in packed.split("\n"))} if packed else {}


def packed(classes: list[tuple[str, int]]) -> str:
    return "\n".join(f"{number}\t{path}" for path, number in classes)


def ranks(tokens: list[tuple[str, bool]], classes: dict[str, int]) -> dict[str, int]:
    """The place of each path of a page among the paths of its class and parent; -1 if
    these do not follow each other in one order, equally often, over the whole page."""
    rows: dict[tuple, list[str]] = {}
    for path, start in tokens:
        if start and path in classes:
            rows.setdefault((classes[path], path.rpartition("/")[0]), []).append(path)
    found = {}
    for row in rows.values():
        once = list(dict.fromkeys(row))
        regular = once * (len(row) // len(once)) == row
        found.update((path, k if regular else -1) for k, path in enumerate(once))
    return found


def in_order(classes: list[tuple[str, int]], seen: dict[str, tuple[int, int]]) -> list[tuple[str, int]]:
    """Classes broken into valid ones: a path whose place (least and greatest over all pages)
    changes leaves its class, with those below it, as a class nested in the one it left."""
    out: dict[str, int] = {}
    whole, count = dict(classes), max((number for _, number in classes), default=0)
    for path in sorted(whole, key=lambda p: p.count("/")):
        low, high = seen.get(path, (-1, -1))
        up = path.rpartition("/")[0]
        while up and whole.get(up) != whole[path]:
            up = up.rpartition("/")[0]
        if low != high or low < 0:
            count += 1
            out[path] = count
        else:
            out[path] = out[up] if up else whole[path]
    return sorted(out.items())


def slots_of(blocks: list[tuple[str, str, int, int]], tokens: list[tuple[str, bool]], classes: dict[str, int]) -> list[str]:
    """The slot of each text block: innermost template element, tab, and the last token
    of that element's class that ended in it before the block."""
    open_, out, at = [["#", ""]], [], 0
    for path, start in [*tokens, ("", True)]:
        while len(out) < len(blocks) and blocks[len(out)][3] == at:
            out.append("\t".join(open_[-1]))
        at += 1
        if path not in classes or path == "#":
            continue
        if start:
            open_.append([path, ""])
        else:
            open_.pop()
            if classes[path] == classes.get(open_[-1][0]):
                open_[-1][1] = path
    return out


def page_slots(blocks: list[tuple[str, str, int, int]], slots: list[str]) -> dict[str, list]:
    """Per slot of a page: words, link words and hash of the text that isn't in marked parts."""
    import xxhash

    found: dict[str, list] = {}
    for (path, text, links, _), slot in zip(blocks, slots, strict=True):
        if not apart(path.split("/")):
            row = found.setdefault(slot, [0, 0, xxhash.xxh64()])
            row[0] += len(text.split())
            row[1] += links
            row[2].update(f"{text}\n".encode("utf-8", "surrogatepass"))
    return {slot: [words, links, signed(text.intdigest())] for slot, (words, links, text) in found.items()}


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def choose(slots: list[tuple[str, int, int, int, int]], template: dict[str, int]) -> tuple[str, list[str]]:
    """(main container, constant and link slots) from a host's slots (slot, pages with it, pages with its most frequent text, words, link words)."""
    widest = max((words / n for _, n, _, words, _ in slots), default=0)  # what holds most of a page is not its frame, even on a host of near copies
    outside = [row for row in slots if not re.search(r"(^|/)(article|main)\b", row[0].split("\t")[0])]
    constant = [slot for slot, n, same, words, links in outside if (n > 1 and same * 20 >= n * 19 and words < widest * n) or 0 < words <= links]
    left_out = set(constant)
    held: dict[str, int] = {}
    for slot, _, _, words, links in slots:
        if 2 * links > words or slot in left_out:
            continue
        steps = slot.split("\t")[0].split("/")
        for k in range(1, len(steps) + 1):
            up = "/".join(steps[:k])
            held[up] = held.get(up, 0) + words - links
    inside = [p for p in held if p in template]
    if not inside:
        return "", constant
    whole = max(held.values())
    wide = [p for p in inside if held[p] * 10 >= whole * 9 and p.rsplit("/", 1)[-1].split(".")[0] not in ("p", "h1", "h2", "h3", "li", "pre")] or inside
    named = [p for p in inside if p.rsplit("/", 1)[-1].split(".")[0] == "article" and held[p] * 2 >= whole] or [p for p in inside if re.fullmatch(r"main(\..*)?", p.rsplit("/", 1)[-1]) and held[p] * 2 >= whole]
    return min(named, key=lambda p: (p.count("/"), -held[p], p)) if named else max(wide, key=lambda p: (p.count("/"), held[p], p)), constant


def table_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    types = {"string": pa.string(), "long": pa.int64()}
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], types[kind]) for k, kind in enumerate(kinds)], names=list(names))


def templates(pages: DataFrame) -> DataFrame:
    """Per host: its template (paths by class), main container and constant slots. pages: host, page_id, html."""
    pages = pages.where("html is not null and html <> ''")

    def count(parts):
        for batch in parts:
            for hosts, ids, texts in batches(batch, ["host", "page_id", "html"]):
                rows = []
                for host, page, html in zip(hosts, ids, texts, strict=True):
                    found: dict[str, int] = {}
                    for path, start in parse(html)[1]:
                        if start:
                            found[path] = found.get(path, 0) + 1
                    rows += [(host, page, path, n) for path, n in found.items()]
                yield table_of(rows, "host string, page_id long, path string, n long")

    each = pages.mapInArrow(count, "host string, page_id long, path string, n long")
    stats = each.groupBy("host", "path").agg(F.count("*").alias("pages"), F.bit_xor(F.xxhash64("page_id", "n")).alias("vector"))
    most = pages.groupBy("host").agg(F.count("*").alias("most"))

    def classify(table):
        tokens = list(zip(*(table.column(c).to_pylist() for c in ("path", "pages", "vector")), strict=True))
        return pa.table({"host": table.column("host")[:1], "classes": pa.array([packed(classes_of(tokens))])})

    # A template's paths are on at least half of the pages: a host's task gets twice a page's paths at most.
    classes = written(stats.join(most, "host").where("2 * pages >= most").drop("most").groupBy("host").applyInArrow(classify, "host string, classes string"), "classes")

    def order(parts):
        seen: dict[str, dict[str, list]] = {}
        for batch in parts:
            for hosts, texts, known in batches(batch, ["host", "html", "classes"]):
                for host, html, lines in zip(hosts, texts, known, strict=True):
                    own = seen.setdefault(host, {})
                    for path, k in ranks(parse(html)[1], unpacked(lines)).items():
                        row = own.setdefault(path, [k, k])
                        row[0], row[1] = min(row[0], k), max(row[1], k)
            if sum(map(len, seen.values())) > 50_000:
                yield flat(seen)
                seen = {}
        yield flat(seen)

    def flat(seen):
        return table_of([(host, path, *row) for host, own in seen.items() for path, row in own.items()], "host string, path string, low long, high long")

    places = pages.join(classes, "host").select("host", "html", "classes").mapInArrow(order, "host string, path string, low long, high long").groupBy("host", "path").agg(F.min("low").alias("low"), F.max("high").alias("high"))

    def validate(key, left, right):
        if not left.num_rows:
            return left.select(["host", "classes"])
        seen = {p: (a, b) for p, a, b in zip(*(right.column(c).to_pylist() for c in ("path", "low", "high")), strict=True)}
        valid = in_order(list(unpacked(left.column("classes")[0].as_py()).items()), seen)
        return pa.table({"host": left.column("host"), "classes": pa.array([packed(valid)])})

    template = written(classes.groupBy("host").cogroup(places.groupBy("host")).applyInArrow(validate, "host string, classes string"), "template")
    schema = "host string, slot string, text long, page long, words long, links long"

    def measure(parts):
        import xxhash

        for batch in parts:
            for hosts, texts, known in batches(batch, ["host", "html", "classes"]):
                rows = []
                for host, html, lines in zip(hosts, texts, known, strict=True):
                    blocks, tokens = parse(html)
                    page = signed(xxhash.xxh64_intdigest("\n".join(text for _, text, _, _ in blocks).encode("utf-8", "surrogatepass")))
                    found = page_slots(blocks, slots_of(blocks, tokens, unpacked(lines)))
                    rows += [(host, slot, text, page, words, links) for slot, (words, links, text) in found.items()]
                yield table_of(rows, schema)

    slots = pages.join(template, "host").select("host", "html", "classes").mapInArrow(measure, schema).distinct()  # a page's copies count once
    slots = slots.groupBy("host", "slot", "text").agg(F.count("*").alias("pages"), F.sum("words").alias("words"), F.sum("links").alias("links"))
    slots = slots.groupBy("host", "slot").agg(F.sum("pages").alias("pages"), F.max("pages").alias("same"), F.sum("words").alias("words"), F.sum("links").alias("links"))

    def deduce(key, left, right):
        if not left.num_rows:
            return pa.table({c: pa.array([], pa.string()) for c in ("host", "classes", "main", "constant")})
        lines = left.column("classes")[0].as_py()
        main, constant = choose(list(zip(*(right.column(c).to_pylist() for c in ("slot", "pages", "same", "words", "links")), strict=True)), unpacked(lines))
        return pa.table({"host": left.column("host"), "classes": left.column("classes"), "main": pa.array([main], pa.string()), "constant": pa.array(["\n".join(constant)], pa.string())})

    return template.groupBy("host").cogroup(slots.groupBy("host")).applyInArrow(deduce, "host string, classes string, main string, constant string")


def extract(blocks: list[tuple[str, str, int, int]], slots: list[str], main: str, constant: set[str]) -> list[str]:
    """Texts of the blocks in the main container's slots, in page order."""
    out = []
    for (path, text, _, _), slot in zip(blocks, slots, strict=True):
        if f"{path}/".startswith(f"{main}/") and slot not in constant and not apart(path.split("/")):
            out.append(text)
    return out


def main_text(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).withColumn("host", host_of(F.col("url")))
    shapes = written(templates(rows.select("host", "page_id", "html")), "templates")

    def run(parts):
        for batch in parts:
            for ids, urls, texts, known, mains, constants in batches(batch, ["page_id", "url", "html", "classes", "main", "constant"]):
                got = []
                for html, lines, main, constant in zip(texts, known, mains, constants, strict=True):
                    blocks, tokens = parse(html) if html else ([], [])
                    found = extract(blocks, slots_of(blocks, tokens, unpacked(lines)), main, set(constant.split("\n"))) if main and blocks else []
                    if blocks and not found:
                        own = dict(classes_of([(p, 1, k) for k, p in enumerate({p for p, _ in tokens})]))
                        slots = slots_of(blocks, tokens, own)
                        main, _ = choose([(s, 1, 0, w, k) for s, (w, k, _) in page_slots(blocks, slots).items()], own)
                        found = extract(blocks, slots, main, set()) if main else []
                    got.append("\n".join(found))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(got, pa.string()), pa.array(list(map(len, got)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.join(shapes, "host", "left").mapInArrow(run, "page_id long, url string, text string, n_chars long")
