"""Main text of web pages: templates deduced from equivalence classes of tokens, and the slots that are left.

1. Tokens of a page are its tags, told apart by the path of elements that they lie in, and the words of its short runs of text; a longer
   run is one token. A token's occurrence vector over the pages of a host is held as its number of pages and two sums of hashes of
   (page, occurrences): sums combine before the shuffle, copies of a page add like terms, and equal vectors have equal sums.
2. Tokens of one host, in at least SHARE of its pages, with equal vectors are an equivalence class; its order is that of their mean
   places. Single tokens are none. A host's classes are bounded by the tokens of its mean page, divided by SHARE.
3. A second pass over the pages keeps the classes that are valid: everywhere in this order, and nested whole into one gap of one other
   class. A word of a class must keep to one gap between its tags. On hosts of fewer than LEAST different pages words prove nothing and
   are left out. The pass also sums how much text that is no template, no link and in no marked part lies in each element of the template.
4. Each host's main slot is chosen from these: its articles (else main parts) where they hold enough of the text, else the innermost
   element that every page has once and that holds nearly all the text, with the page's heading if there is one.
5. The last pass writes out the runs of the main slot, but for marked parts (menus, adverts and so on) and short runs that are
   of the template on every page. Pages without a host, or that lack the slot of their host, choose by themselves in the same way.

Blocks end at every tag that is not inline; white space of any kind inside a block becomes one space, empty blocks are left out.

Null html is empty, and empty html has empty text. A null url has no host. Repeated rows and equal or null page_ids each give a row of their own. An
empty table gives no row. Columns other than page_id, url and html are left out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, written
from .page_markup import END, INLINE, NONE, PARTS, START, TEXT, end_of, hashed, parse

#: Of a host's pages, those that a token must be on.
SHARE = 0.2
#: Different pages of a host from which words can be of its template.
LEAST = 10
#: Words of the longest run whose words are tokens of their own.
SHORT = 16
#: What the chosen element holds of the text at least, and what articles and main parts hold for being chosen.
NEARLY_ALL, ENOUGH = 0.8, 0.3
#: Entries that a task holds before it passes sums on.
HELD = 200_000

#: The whole page, as an element.
WHOLE = 0
_HASH = (1 << 31) - 1
_PAGE, _TAG, _WORD = range(3)
_CLASS, _ELEMENT, _PLACE = range(3)

_TOKENS = "host_id long, token long, kind int, pages long, first long, second long, places long"
_FACTS = "host_id long, kind int, id long, sound boolean, low long, high long, mass long, heads long, pages long, once boolean, name string"


def host_of(url: Column) -> Column:
    """The host in lower case, without user and port; null where there is none."""
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    return F.when(found != "", found)


def pages_of(pages: DataFrame) -> DataFrame:
    host = host_of(F.col("url").cast("string"))
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")
    return pages.select("page_id", F.col("url").cast("string").alias("url"), html, F.when(host.isNotNull(), F.xxhash64(host)).alias("host_id"))


def word_tokens(path: int, text: str) -> list[int]:
    words = text.split()
    if len(words) > SHORT:
        return [hashed(path, " ".join(words))]
    return [hashed(path, w) for w in words]


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of each token of each host; a token may come more than once."""
    held: dict[tuple, list[int]] = {}

    def out() -> pa.RecordBatch:
        keys = list(zip(*held)) or [[], [], []]
        sums = list(zip(*held.values())) or [[]] * 4
        held.clear()
        types = [pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 4]
        names = [c.split()[0] for c in _TOKENS.split(", ")]
        return pa.record_batch([pa.array(c, t) for c, t in zip([*keys, *sums], types)], names)

    for batch in batches:
        for html, host in zip(batch.column("html"), batch.column("host_id").to_pylist()):
            html = html.as_py()
            if host is None or not html:
                continue
            page = hashed(0, html)
            counts: Counter = Counter()
            place: dict[int, tuple[int, int]] = {}
            for at, event in enumerate(parse(html)):
                if event[0] != TEXT:
                    counts[event[1]] += 1
                    place.setdefault(event[1], (at, _TAG))
                elif event[3] == NONE:
                    for token in word_tokens(event[1], event[2]):
                        counts[token] += 1
                        place.setdefault(token, (at, _WORD))
            place[page], counts[page] = (0, _PAGE), 1
            for token, n in counts.items():
                at, kind = place[token]
                h = xxhash.xxh3_64_intdigest(b"%d %d" % (page, n))
                sums = held.setdefault((host, token, kind), [0, 0, 0, 0])
                sums[0] += 1
                sums[1] += h & _HASH
                sums[2] += h >> 33
                sums[3] += at
        if len(held) > HELD:
            yield out()
    yield out()


def classes(pages: DataFrame) -> DataFrame:
    """host_id, all_pages (of the host), different (of them), and classes: (pages, tags, words), tags in order. One row a host, of bounded size."""
    sums = pages.select("html", "host_id").mapInArrow(_occurrences, _TOKENS).groupBy("host_id", "token", "kind")
    added = sums.agg(*[F.sum(c).alias(c) for c in ("pages", "first", "second", "places")])
    tokens = written(added.where((F.col("pages") > 1) | (F.col("kind") == _PAGE)), "page-tokens", even=False)
    hosts = tokens.where(F.col("kind") == _PAGE).groupBy("host_id").agg(F.sum("pages").alias("all_pages"), F.count("*").alias("different"))
    hosts = written(hosts.where("different > 1"), "page-hosts")
    usual = tokens.where(F.col("kind") != _PAGE).join(hosts, "host_id").where(F.col("pages") >= SHARE * F.col("all_pages"))
    usual = usual.where((F.col("kind") == _TAG) | (F.col("different") >= LEAST))
    member = F.sort_array(F.collect_list(F.struct("places", "token", "kind")))
    grouped = usual.groupBy("host_id", "first", "second", "pages").agg(member.alias("members"), F.max("all_pages").alias("n"), F.max("different").alias("d"))
    of = lambda kind: F.transform(F.filter("members", lambda m: m.kind == kind), lambda m: m.token)
    whole = grouped.where((F.size("members") > 1) & (F.size(of(_TAG)) > 0)).select(
        "host_id", "n", "d", F.struct(F.col("pages"), of(_TAG).alias("tags"), of(_WORD).alias("words")).alias("class")
    )
    by_host = whole.groupBy("host_id").agg(F.max("n").alias("all_pages"), F.max("d").alias("different"), F.collect_list("class").alias("classes"))
    made = written(by_host, "page-classes")
    discard(tokens)
    return made


class _Template:
    """The classes of a host, as the second pass needs them."""

    def __init__(self, classes: list[dict] | None, all_pages: int | None):
        self.at: dict[int, tuple[int, int]] = {}
        self.word: dict[int, int] = {}
        self.size: list[int] = []
        self.ids: list[int] = []
        self.labels: set[int] = set()
        for k, c in enumerate(sorted(classes or [], key=lambda c: -c["pages"])):
            tags, words = c["tags"], c["words"]
            self.ids.append(tags[0])
            self.size.append(len(tags))
            self.at |= {t: (k, place) for place, t in enumerate(tags)}
            self.word |= dict.fromkeys(words, k)
            if c["pages"] == all_pages:
                self.labels |= set(words)


class _Facts:
    """Sums over the pages of a task: (host, kind, id) -> what _FACTS lists after it."""

    def __init__(self):
        self.held: dict[tuple, list] = {}

    def add(self, key: tuple, sound: bool = True, gap: int = 0, mass: int = 0, heads: int = 0, once: bool = True, name: str = "") -> None:
        known = self.held.get(key)
        if known is None:
            self.held[key] = [sound, gap, gap, mass, heads, 1, once, name]
            return
        known[0] &= sound
        known[1], known[2] = min(known[1], gap), max(known[2], gap)
        known[3] += mass
        known[4] += heads
        known[5] += 1
        known[6] &= once

    def out(self) -> pa.RecordBatch:
        types = [pa.int64(), pa.int32(), pa.int64(), pa.bool_(), *[pa.int64()] * 5, pa.bool_(), pa.string()]
        names = [c.split()[0] for c in _FACTS.split(", ")]
        columns = list(zip(*((*k, *v) for k, v in self.held.items()))) or [[] for _ in names]
        self.held.clear()
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names)


def masses(events: list[tuple], labels: set[int]) -> dict[int, list]:
    """Of each element by its start, and the page as WHOLE: [text outside marked parts, links and labels; headings; occurrences; name if it is a part]."""
    found: dict[int, list] = {}
    open_: list[list] = [[0, 0, 0]]
    for event in events:
        if event[0] == START:
            if event[2] == "h1" and event[3] == NONE:
                open_[-1][2] += 1
            open_.append([event[1], 0, 0])
            # a marked element is of no use as a main slot
            known = found.setdefault(event[1], [0, 0, 0, event[2] if event[2] in PARTS else "", event[3] == NONE])
            known[2] += 1
        elif event[0] == END:
            # void elements have no end: they and what they never held go with the element around them
            token = end_of(event[1])
            while True:
                closed, mass, heads = open_.pop()
                open_[-1][1] += mass
                open_[-1][2] += heads
                if closed == token:
                    found[token][0] += mass
                    found[token][1] += heads
                    break
        elif event[3] == NONE and not event[4] and not _of_template(event, labels):
            open_[-1][1] += len(event[2].strip())
    whole = [sum(x[1] for x in open_), sum(x[2] for x in open_), 1, ""]
    return {token: known[:4] for token, known in found.items() if known[4]} | {WHOLE: whole}


def _of_template(event: tuple, labels: set[int]) -> bool:
    return bool(labels) and labels.issuperset(word_tokens(event[1], event[2]))


def _label(event: tuple, labels: set[int]) -> bool:
    """A short run of the template; a long one inside the main slot stays."""
    return bool(labels) and 0 < len(event[2].split()) <= SHORT and _of_template(event, labels)


def _validated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    facts = _Facts()
    host, template = None, _Template(None, None)
    for batch in batches:
        for k, (html, at) in enumerate(zip(batch.column("html"), batch.column("host_id").to_pylist())):
            if at != host:
                host, template = at, _Template(batch.column("classes")[k].as_py(), batch.column("all_pages")[k].as_py())
            html = html.as_py()
            if html:
                check(host, template, parse(html), facts)
        if len(facts.held) > HELD:
            yield facts.out()
    yield facts.out()


def check(host: int, template: _Template, events: list[tuple], facts: _Facts) -> None:
    """Order and nesting of a page's classes, the gaps of their words, and the text in their elements."""
    seen: dict[int, tuple[bool, int]] = {}  # class -> sound so far, gap around it
    open_: list[list[int]] = []  # instances that have begun: [class, tags so far]
    last: dict[int, int] = {}  # class -> its latest tag
    for event in events:
        if event[0] == TEXT:
            if template.word and event[3] == NONE:
                for token in word_tokens(event[1], event[2]):
                    if token in template.word:
                        facts.add((host, _PLACE, token), gap=last.get(template.word[token], -1))
            continue
        found = template.at.get(event[1])
        if found is None:
            continue
        k, place = found
        last[k] = place
        if place == 0:
            around = hash((template.ids[open_[-1][0]], open_[-1][1])) if open_ else 0
            sound, gap = seen.get(k, (True, around))
            seen[k] = sound and gap == around, gap
            open_.append([k, 0])
        if not open_ or open_[-1][0] != k or open_[-1][1] != place:
            seen[k] = False, seen.get(k, (False, 0))[1]
            open_ = [x for x in open_ if x[0] != k]
            continue
        open_[-1][1] += 1
        if open_[-1][1] == template.size[k]:
            open_.pop()
    for k, (sound, gap) in seen.items():
        ended = all(x[0] != k for x in open_)
        facts.add((host, _CLASS, template.ids[k]), sound=sound and ended, gap=gap)
    for token, (mass, heads, times, name) in masses(events, template.labels).items():
        if token in template.at or token == WHOLE:
            facts.add((host, _ELEMENT, token), mass=mass, heads=heads, once=times == 1, name=name)


def choose(elements: list[tuple], pages: int) -> list[int]:
    """The main slot among elements (token, mass, heads, pages, once, name, place): the starts of its elements; none if there is no text."""
    part = {name: [e for e in elements if e[5] == name and e[1] > 0] for name in PARTS}
    held = {name: sum(e[1] for e in own) for name, own in part.items()}
    everything = max((e[1] for e in elements), default=0)
    article, main = held["article"], held["main"]
    if max(article, main) >= ENOUGH * everything > 0:
        return sorted(e[0] for e in part["article" if 2 * article >= main else "main"])
    once = [e for e in elements if e[4] and e[3] >= pages]
    most, heads = max((e[1] for e in once), default=0), max((e[2] for e in once), default=0)
    fit = [e for e in once if e[1] > 0 and e[1] >= NEARLY_ALL * most and 2 * e[2] >= heads]
    return [min(fit, key=lambda e: (e[1], -e[6]))[0]] if fit else []


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            at = {t: c["tags"][0] for c in r["classes"] for t in c["tags"]}
            sound = {f["id"] for f in r["facts"] if f["kind"] == _CLASS and f["sound"] and f["low"] == f["high"]}
            own = [f for f in r["facts"] if f["kind"] == _ELEMENT and (f["id"] == WHOLE or at.get(f["id"]) in sound)]
            places = {t: k for c in r["classes"] for k, t in enumerate(c["tags"])} | {WHOLE: -1}
            elements = [(*(f[c] for c in ("id", "mass", "heads", "pages", "once", "name")), places[f["id"]]) for f in own]
            valid = [c for c in r["classes"] if c["tags"][0] in sound and c["pages"] == r["all_pages"]]
            placed = {f["id"] for f in r["facts"] if f["kind"] == _PLACE and f["low"] == f["high"]}
            labels = [w for c in valid for w in c["words"] if w in placed]
            rows.append((r["host_id"], choose(elements, r["all_pages"]), labels))
        types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["host_id", "main", "labels"])


def templates(pages: DataFrame) -> DataFrame:
    """host_id, main (starts of the elements of the main slot), labels (words that are of the template on all pages)."""
    found = classes(pages)
    joined = pages.select("html", "host_id").join(found.select("host_id", "all_pages", "classes"), "host_id")
    facts = joined.mapInArrow(_validated, _FACTS).groupBy("host_id", "kind", "id").agg(
        F.min("sound").alias("sound"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("once").alias("once"), F.max("name").alias("name"),
        *[F.sum(c).alias(c) for c in ("mass", "heads", "pages")],
    )
    fact = F.struct("kind", "id", "sound", "low", "high", "mass", "heads", "pages", "once", "name")
    by_host = facts.groupBy("host_id").agg(F.collect_list(fact).alias("facts")).join(found, "host_id")
    made = by_host.select("host_id", "facts", "all_pages", "classes").mapInArrow(_chosen, "host_id long, main array<long>, labels array<long>")
    return written(made, "page-templates")


def extract(html: str, main: frozenset[int], labels: frozenset[int]) -> str:
    """The text of the main slot. main is empty where the host gives none."""
    if not html:
        return ""
    events = parse(html)
    if WHOLE not in main and not any(e[0] == START and e[1] in main and e[3] == NONE for e in events):
        own = masses(events, set())
        places = {WHOLE: -1} | {t: k for k, t in enumerate(t for t in own if t != WHOLE)}
        elements = [(t, mass, heads, 1, times == 1, name, places[t]) for t, (mass, heads, times, name) in own.items()]
        main = frozenset(choose(elements, 1) or [WHOLE])
    ends = {end_of(t) for t in main}
    blocks: list[str] = []
    run: list[str] = []
    depth = int(WHOLE in main)
    for event in events:
        if event[0] == TEXT:
            if event[3] == NONE and depth and not _label(event, labels):
                run.append(event[2])
            continue
        if event[2] not in INLINE:
            blocks.append("".join(run))
            run = []
        if event[1] in main:
            depth += 1
        elif event[1] in ends:
            depth -= 1
    blocks.append("".join(run))
    return " ".join(" ".join(blocks).split())


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    host, main, labels = None, frozenset(), frozenset()
    for batch in batches:
        texts = []
        for k, (html, at) in enumerate(zip(batch.column("html"), batch.column("host_id").to_pylist())):
            if at != host:
                host = at
                main, labels = (frozenset(batch.column(c)[k].as_py() or ()) for c in ("main", "labels"))
            texts.append(extract(html.as_py(), main, labels))
        n = pa.array([len(t) for t in texts], pa.int64())
        yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), n], ["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text (empty if there is none), n_chars (its code points) of each page."""
    rows = pages_of(pages)
    found = rows.join(templates(rows), "host_id", "left").select("page_id", "url", "html", "host_id", "main", "labels")
    kind = rows.schema["page_id"].dataType.simpleString()
    return found.mapInArrow(_extracted, f"page_id {kind}, url string, text string, n_chars long")
