"""Wrapper induction against pages whose article is known, because the test put it there."""

import json
import random
from collections import Counter

import pytest

from reviewlake.llm import html_extract
from reviewlake.llm.html_extract import Inducer, Rule, main_blocks, match, rule
from reviewlake.llm.page_tree import Page

VOCABULARY = [f"w{i}é" for i in range(300)]


def words(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def article(rng):
    return [words(rng, rng.randint(2, 8))] + [words(rng, rng.randint(10, 60)) for _ in range(rng.randint(1, 12))]


def marked_up(rng, blocks):
    """The blocks as markup with entities, breaks, inline elements and open paragraphs."""
    out = [f"<h1>{blocks[0]}</h1>"]
    for b in blocks[1:]:
        first, _, rest = b.partition(" ")
        shape = rng.randrange(5)
        out.append([f"<p>{b}</p>", f"<p><a href='x'><b>{first}</b></a>\n {rest}", f"<p>{first}<br>{rest}</p>", f"<blockquote>{b.replace(' ', '&#32;', 1)}</blockquote>",
                    f"<ul><li>{first} <i>{rest}</ul>"][shape])
    return "".join(out)


def named(rng, blocks, host):
    return (f"<!DOCTYPE html><html><head><title>{blocks[0]}</title><style>p{{}}</style><script>var a='</p><p>no';</script></head><body class='has-sidebar'>"
            f"<header><h1>{host}</h1></header><nav><ul><li><a href=/>{words(rng, 2)}</a></ul></nav><div class='cookie-banner'>{words(rng, 9)}</div>"
            f"<article class='post'>{marked_up(rng, blocks)}<aside>{words(rng, 9)}</aside><form><label>{words(rng, 3)}</label></form>"
            f"<section id='comments'><article class='comment'><p>{words(rng, 200)}</p></article></section></article>"
            f"<div class=ad>{words(rng, 30)}</div><!-- <p>no</p> --><footer>&copy; {words(rng, 5)}")


def unnamed(rng, blocks, host):
    """No element says what it is: what is constant on the host must show it."""
    return (f"<html><body><div><p>{host} all the news that nobody needs to read twice</p></div><table><tr><td><a href=1>{words(rng, 3)}</a><td><a href=2>{words(rng, 3)}</a></table>"
            f"<div><div>{marked_up(rng, blocks)}<p>Read more on {host} every single day</p></div></div><div><p>About {host}, imprint and terms</p></div></body></html>")


def made(n=160, seed=1):
    rng, rows = random.Random(seed), []
    for i in range(n):
        host = f"h{0 if rng.random() < 0.4 else rng.randint(1, 5)}.example"
        blocks = article(rng)
        rows.append((i, f"https://{host}/{i}", (named if host != "h1.example" else unnamed)(rng, blocks, host), "\n\n".join(blocks)))
    return rows


@pytest.fixture(scope="module")
def pages():
    rows = made()
    copy = rows[3][2]
    return rows + [(1000 + i, "http://user@H0.example:80/x", copy, rows[3][3]) for i in range(50)] + [
        (2000, None, rows[5][2], rows[5][3]), (2001, "not an address", "<p>one <p>two", "one\n\ntwo"), (2002, "http://h0.example", None, ""), (2003, "http://h0.example", "", ""),
        (2004, "http://lone.example", "plain &lt;text&gt; &amp; more", "plain <text> & more"), (None, "http://lone.example", "<nav>menu</nav>", ""),
        (2005, "http://x.example", "<article>" + "<div>" * 3000 + "deep" + "<p>" + "long " * 50_000, "deep\n\n" + " ".join(["long"] * 50_000))]


def test_the_article_and_nothing_else(spark, pages):
    docs = spark.createDataFrame([(i, u, h, "x", 7) for i, u, h, _ in pages], "page_id bigint, url string, html string, host string, bucket int").repartition(7)
    found = html_extract.extract(docs)
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    assert Counter(map(tuple, found.collect())) == Counter((i, u, t, len(t)) for i, u, _, t in pages)


def test_empty(spark):
    assert html_extract.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_wrappers_of_parts_make_the_wrapper_of_all():
    rows = [r for r in made(120, 5) if "h1." in r[1]]
    whole, parts = Inducer(), [Inducer() for _ in range(4)]
    for k, (_, _, html, _) in enumerate(rows):
        whole.add("h", html)
        parts[k % 4].add("h", html)
    merged = parts[0].wrappers["h"]
    for part in parts[1:]:
        merged.join(html_extract.load(json.loads(json.dumps(part.wrappers["h"].dump()))))
    assert merged.pages == len(rows)
    for r in rows:
        assert main_blocks(r[2], Rule(json.dumps(rule(merged)))) == main_blocks(r[2], Rule(json.dumps(rule(whole.wrappers["h"])))) == r[3].split("\n\n")


class Tree:
    def __init__(self, label, *kids):
        self.label, self.kids = label, list(kids)


def random_tree(rng, depth=3):
    return Tree(rng.choice("abc"), *[random_tree(rng, depth - 1) for _ in range(rng.randint(0, 3))] if depth else [])


def most_common(x, y):
    """Largest order-keeping match by trying every choice."""
    if x.label != y.label:
        return 0

    def pick(i, j):
        if i == len(x.kids) or j == len(y.kids):
            return 0
        got = most_common(x.kids[i], y.kids[j])
        return max(pick(i + 1, j), pick(i, j + 1), got + pick(i + 1, j + 1))

    return 1 + pick(0, 0)


def test_tree_matching_is_the_best():
    rng = random.Random(3)
    for _ in range(300):
        x, y = random_tree(rng), random_tree(rng)
        x.label = y.label
        assert html_extract._size(x, y) == most_common(x, y)
        pairs = match(x.kids, y.kids)
        assert pairs == sorted(pairs) and len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)


@pytest.mark.parametrize("html, blocks", [
    ("<p>a<p>b", ["a", "b"]), ("a<b>b</b>c<br/>d", ["abc d"]), ("<div>x<p>y</div>z", ["x", "y", "z"]), ("<ul><li>1<li>2<ul><li>3</ul></ul>4", ["1", "2", "3", "4"]),
    ("<table><tr><td>1<td>2<tr><th>3</table>", ["1", "2", "3"]), ("<p title='>'>a</p>", ["a"]), ("<p title=\"x>a</p>b", ["a", "b"]), ("<!-- x", []),
    ("<script>x</script ><p>1</p><SCRIPT>if (a<b) '</p>'</SCRIPT>2", ["1", "2"]), ("a &am &amp b&nbsp;c&#x41;", ["a &am & b cA"]), ("<b><div>1</b>2</div>3", ["12", "3"]),
    ("<p>a</b></i>b</p>", ["ab"]), ("1 < 2 <3>", ["1 < 2 <3>"]), ("<h2>a<h3>b", ["a", "b"]), ("<svg><text>no</text></svg>a<textarea><p>no</textarea>", ["a"]),
    ("<head><title>no</title><p>yes", ["yes"]), ("<p hidden>no</p><p aria-hidden=true>no<p style='DISPLAY: none'>no<p>yes", ["yes"]), ("<a>1<a>2</a></a>", ["12"])])
def test_broken_markup(html, blocks):
    assert [b.text for b in Page(html).blocks] == blocks


def test_summaries_miss_little():
    rng, node = random.Random(1), html_extract.Node("p")
    for i in range(3000):
        node.pages += 1
        node.add_texts({key: 5 for key in {rng.randrange(10**9) for _ in range(8)} | ({1} if i % 2 else set())})
    assert 1500 - node.texts[1][0] <= node.error <= 300 and len(node.texts) < 2000
