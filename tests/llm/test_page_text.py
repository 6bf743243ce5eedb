"""Page text: classes against exact occurrence vectors, and whole sites against the texts that they were made of."""

import random
from collections import Counter, defaultdict

import pytest

from meridia.llm import page_text
from meridia.llm.page_markup import END, START, TEXT, parse
from meridia.llm.page_text import end_of, extract, main_text, pages_of

SCHEMA = "page_id long, url string, html string, text string, n_chars int, host_id string, main int, kind string"
COMMON = "One line that half of all pages share."


def sentence(r, n=12):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(n)).capitalize() + "."


def article(r):
    more = [COMMON] * (r.random() < 0.5)
    return sentence(r, 5), [sentence(r, r.randint(3, 60)) for _ in range(r.randint(1, 5))] + more


def shown(title, paragraphs):
    return " ".join([title, *paragraphs])


def marked(r, k, title, paragraphs):
    """Article marked up, with a menu, notice, advert, form and reader comments around and inside it."""
    body = "".join(f"<p>{p}" for p in paragraphs)
    return (
        f"<!doctype html><html><head><title>{title}</title><script>if (a < b) x = '<p>no</p>';</script><style>p{{}}</style></head>"
        f"<body class='post-{k} {sentence(r, 1)}'><header><h2>Site name</h2></header><nav><ul><li><a href=/>Home<li><a href='/a>b'>More</a></ul></nav>"
        f"<div class=cookie-notice>We use cookies, dear reader. {sentence(r)}</div><!-- {sentence(r)} --><main><article id=a{k}><header><h1>{title}</h1></header>"
        f"{body}<div class='adBox'>{sentence(r, 40)}</div><form action=/x><label>Mail</label><button>Go</button></form></article>"
        f"<section id=comments><h3>Comments</h3><article class=comment><p>{sentence(r, 80)}</p></article></section></main>"
        f"<aside>{sentence(r, 50)}</aside><footer>&copy; {sentence(r)}</footer></body></html>"
    )


def unmarked(r, k, title, paragraphs):
    """Nothing but divs without telling names: a bar of links, a fixed legal text, fixed labels within the text's own element."""
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    links = "".join(f"<div><a href=/{i}>{sentence(r, 3)}</a></div>" for i in range(9))
    legal = "All that is written here is written by its writers and nobody else answers for it in any court of law or elsewhere at all. " * 3
    return (
        f"<html><body><div class=t>The Daily</div><div class=l>{links}</div><div class=c><h1>{title}</h1><div class=b><span>Print this page</span>{body}"
        f"</div></div><div class=z>{legal}</div></body></html>"
    )


def sites(n=40, seed=2):
    r = random.Random(seed)
    rows, want = [], {}
    for host, make in (("https://www.a.example/", marked), ("http://u:p@B.example:80/x", unmarked), (None, marked), ("https://once.example/", marked)):
        for k in range(1 if host and "once" in host else n):
            page_id, (title, paragraphs) = len(rows), article(r)
            rows.append((page_id, host and f"{host}{k}", make(r, k, title, paragraphs)))
            want[page_id] = shown(title, paragraphs)
    return rows, want


def frame(spark, rows):
    return spark.createDataFrame([(*row, "no", 3, "no", 1, "no") for row in rows], SCHEMA).repartition(4)


def texts(spark, rows):
    return {r.page_id: r.text for r in main_text(frame(spark, rows)).collect()}


def test_sites(spark):
    rows, want = sites()
    assert texts(spark, rows) == want


@pytest.mark.parametrize("held", [1, 200_000])
def test_classes_are_equal_occurrence_vectors(spark, monkeypatch, held):
    monkeypatch.setattr(page_text, "HELD", held)
    rows, _ = sites(15)
    pages = pages_of(frame(spark, rows + rows[:3]))
    counts, on = defaultdict(Counter), Counter()
    for k, r in enumerate(pages.collect()):
        if r.host_id is None:
            continue
        on[r.host_id] += 1
        for event in parse(r.html):
            if event[0] != TEXT:
                counts[r.host_id, event[1], "tag"][k] += 1
            elif event[3] == 0:
                for token in page_text.word_tokens(event[1], event[2]):
                    counts[r.host_id, token, "word"][k] += 1
    groups = defaultdict(set)
    for (host, token, kind), vector in counts.items():
        if len(vector) >= max(2, 0.2 * on[host]):
            groups[host, frozenset(vector.items())].add((token, kind))
    want = {(host, frozenset(g)) for (host, _), g in groups.items() if len(g) > 1 and any(kind == "tag" for _, kind in g)}
    got = set()
    for r in page_text.classes(pages).collect():
        assert r.all_pages == on[r.host_id]
        for c in r.classes:
            got.add((r.host_id, frozenset([(t, "tag") for t in c.tags] + [(t, "word") for t in c.words])))
    assert got == want and len(got) > 4


def test_order_and_nesting_decide_validity():
    """Classes in order and nested are sound; one whose tags change places, or that is now here and now there, is not."""

    def facts(first, second):
        tags = [e[1] for e in parse(first) if e[0] != TEXT]
        inner = [t for e in parse("<div><i>") for t in [e[1]] if e[2] == "i"]
        outer = [t for t in tags if t not in inner]
        template = page_text._Template([{"pages": 2, "tags": outer, "words": []}, {"pages": 2, "tags": inner, "words": []}], 2)
        found = page_text._Facts()
        for html in (first, second):
            page_text.check(1, template, parse(html), found)
        return [v[0] and v[1] == v[2] for k, v in found.held.items() if k[1] == page_text._CLASS]

    assert facts("<div><i>a</i></div><p></p>", "<div><i>b</i><i>c</i></div><p></p>") == [True, True]
    assert False in facts("<div><i>a</i></div><p></p>", "<p></p><div><i>a</i></div>")
    assert False in facts("<div><i>a</i><u></u></div>", "<div><u></u><i>a</i></div>")


def test_labels_are_of_every_page(spark):
    """A short run on every page is of the template; on too few different pages, or not on every page, it is the article's."""
    page = lambda k, label: f"<div class=c><h1>T{k}</h1><b class=s>{label}</b><p>{sentence(random.Random(k), 30)}</p></div>"
    rows = [(k, f"http://x/{k}", page(k, "Share this")) for k in range(12)]
    assert not any("Share" in t for t in texts(spark, rows).values())
    assert all("Share" in t for t in texts(spark, rows[:5]).values())
    assert all("Share" in t for t in texts(spark, [(k, u, rows[0][2]) for k, u, _ in rows]).values())
    most = rows[:-1] + [(12, "http://x/12", page(12, "Other"))]
    assert sum("Share" in t for t in texts(spark, most).values()) == 11


def test_awkward_rows(spark):
    long = "word " * 50_000
    rows = [
        (1, None, None), (2, "http://h/", ""), (3, "http://h/", " \n "), (4, "not a url", "just  text here"), (None, "http://h/", "<p>a"),
        (5, "http://h/5", "<p>One<b>two</b><i> three</i><br>four</p>five &amp six&am &lt;p&gt; &#x41;&nbsp;&copy"), (5, "http://h/5", "<p>One"), (5, "http://h/5", "<p>One"),
        (6, "http://[bad/", f"<article>{long}"), (7, "//h/x", "<!-- never ended <p>x</p>"), (8, "http://k/", "<p>a</p><script>never ended <p>x</p>"),
        (9, "http://k/", "<p title=don't>b</p></div></p></b>c<p class='x"), (10, "http://k/", "a < b > c <3 <!x> <?y?> d</"), (11, "http://k/", "<form><main><p>In</p></main>out</form>"),
        (12, "http://k/", "<nav>only a menu</nav>"), (13, "http://k/", "<div hidden>h</div><div style='display: none'>i</div><p>j</p><textarea><p>k</p></textarea>"),
        (14, "http://k/", "<ul><li>a<li>b<ul><li>c</ul><li>d</ul><table><tr><td>e<td>f<tr><td>g</table><dl><dt>h<dd>i</dl>"),
    ]
    got = sorted(((r.page_id or 0, r.text, r.n_chars) for r in main_text(frame(spark, rows)).collect()))
    want = {
        0: "a", 1: "", 2: "", 3: "", 4: "just text here", 6: long.strip(), 7: "", 8: "a", 9: "b c", 10: "a < b > c <3 d</", 11: "In", 12: "", 13: "j", 14: "a b c d e f g h i",
    }
    assert {p: t for p, t, _ in got if p != 5} == want
    assert sorted(t for p, t, _ in got if p == 5) == ["One", "One", "Onetwo three four five & six&am <p> A ©"]
    assert all(n == len(t) for _, t, n in got) and len(got) == len(rows)


def test_tags_are_balanced():
    r = random.Random(1)
    parts = ["<p>", "</p>", "<div>", "</div>", "<li>", "<ul>", "</ul>", "<b>", "</b>", "<td>", "<table>", "</table>", "<br>", "<head>", "</head>", "<title>x</title>", "t "]
    for _ in range(300):
        html = "".join(r.choice(parts) for _ in range(r.randint(0, 40)))
        stack = []
        for event in parse(html):
            if event[0] == START and event[2] != "br":
                stack.append(event[1])
            elif event[0] == END:
                assert end_of(stack.pop()) == event[1]
        assert not stack
        text = extract(html, frozenset(), frozenset())
        assert text == " ".join(text.split())


def test_empty_table(spark):
    assert main_text(spark.createDataFrame([], SCHEMA)).collect() == []
