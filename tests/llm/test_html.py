import random
import re
from html.parser import HTMLParser

from loamline.llm.html import extract, extract_text


def test_blocks_lists_and_tables():
    page = """<title>T</title><style>p{}</style><h1>Head &amp; more</h1><p>One<p>two <b>bold</b>
 text<br>next<ul><li>a<li>b<ol start=3><li>x<li>y</ol><li>c</ul><div style="display:none">no</div><span hidden>no</span>
<table><caption>Cap<tr><th>Name<th>Qty<tr><td>Apple pie<td>1<tr><td>x<td>23</table>tail<pre>
 a  b
   c</pre><script>var t="</p>";</script><!-- c --> x < y"""
    want = ["Head & more", "", "One", "", "two bold text", "next", "", "- a", "- b", "  3. x", "  4. y", "- c", "", "Cap", "Name       Qty", "Apple pie  1", "x          23", "", "tail", "", " a  b", "   c", "", "x < y"]
    assert extract_text(page).split("\n") == want


def test_spans_of_cells():
    page = "<table><tr><td colspan=2>wide heading here<tr><td rowspan=2>r<td>1<tr><td>2</table>"
    assert extract_text(page) == "wide heading here\nr  1\n   2"


def test_text_in_odd_places_is_kept():
    assert extract_text("<table>stray<tr><td>cell</table>") == "stray\n\ncell"
    assert extract_text("<p>a title=\"don't\" <i title=don't>b</i> c") == "a title=\"don't\" b c"
    assert extract_text("<div " + "<b>" * 3 + "deep") == "<b><b>deep" or extract_text("<div><b>deep") == "deep"
    assert extract_text("<b>" * 3000 + "deep" + "</b>" * 3000) == "deep"
    assert extract_text("<!-- open") == "" and extract_text("<script>open") == "" and extract_text("") == ""
    assert extract_text("<details><summary>s</summary>hidden</details>") == "s"
    assert extract_text("<select><option>a<option>b</select>").split() == ["a", "b"]


def test_any_depth_of_nesting():
    for tag in ("ul", "ol", "ul><li", "ol><li", "table><tr><td", "blockquote", "dl><dd", "q", "pre", "div", "b"):
        for times in (150, 250, 1500):
            assert extract_text(f"<{tag}>" * times + "deep").replace('"', "").split()[-1] == "deep", (tag, times)


class Visible(HTMLParser):
    """Words of a well-formed page outside of hidden elements, in order, by the standard parser."""

    def __init__(self):
        super().__init__()
        self.open, self.words = [], []

    def handle_starttag(self, tag, attrs):
        hidden = tag in ("script", "style", "title", "template") or "hidden" in dict(attrs) or "none" in (dict(attrs).get("style") or "")
        self.open.append(hidden or bool(self.open and self.open[-1]))

    def handle_endtag(self, tag):
        self.open.pop()

    def handle_data(self, data):
        if not (self.open and self.open[-1]):
            self.words += data.split()


def test_words_are_the_standard_parsers():
    rng = random.Random(11)
    inside = {"div": "div p ul ol table span pre section blockquote", "li": "b i ul span", "td": "b i ul p", "p": "b i span", "span": "b i"}

    def element(tag, depth):
        attrs = rng.choice(["", "", "", "", ' class="x"', " hidden", ' style="display: none"', " title='a > b'"])
        if tag in ("ul", "ol"):
            body = "".join(element("li", depth - 1) for _ in range(rng.randint(1, 3)))
        elif tag == "table":
            body = "".join("<tr>" + "".join(element("td", depth - 1) for _ in range(2)) + "</tr>" for _ in range(rng.randint(1, 3)))
        else:
            parts = []
            for _ in range(rng.randint(0, 4)):
                parts.append(f" w{rng.randint(0, 999)} &amp; " if rng.random() < 0.6 else "")
                if depth > 0 and rng.random() < 0.6:
                    parts.append(element(rng.choice(inside.get(tag, "b i span").split()), depth - 1))
            body = "".join(parts)
        return f"<{tag}{attrs}>{body}</{tag}>"

    for _ in range(300):
        page = "<style>no</style>" + "".join(element("div", 5) for _ in range(3)) + "<script>no</script>"
        seen = Visible()
        seen.feed(page)
        got = [w for w in extract_text(page).split() if w != "-" and not re.fullmatch(r"\d+\.", w)]
        assert sorted(got) == sorted(seen.words), page
        if "<table" not in page:
            assert got == seen.words, page


def test_every_visible_word_comes_once():
    rng = random.Random(5)
    tags = "p div b i ul li table tr td h2 span blockquote section a em dl dt dd ol article".split()
    for _ in range(300):
        words, parts = [], []
        for k in range(rng.randint(1, 30)):
            parts.append(f"<{'/' if rng.random() < 0.4 else ''}{rng.choice(tags)}>")
            if rng.random() < 0.6:
                words.append(f"w{k}x")
                parts.append(f" {words[-1]} ")
        found = re.findall(r"w\d+x", extract_text("".join(parts)))
        assert sorted(found) == sorted(words), "".join(parts)


def test_extract_handles_odd_rows(spark):
    rows = [(1, "u", "<p>a</p>", 1), (None, None, None, 2), (2, "u", "", 3), (1, "u", "<p>a</p>", 1)]
    out = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int"))
    assert sorted((r[0] or 0, r[2]) for r in out.collect() if r[2] is not None) == [(1, "a"), (1, "a"), (2, "")]
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_spans_beyond_all_columns_take_no_time():
    import time

    page = "<table>" + "<tr><td colspan=1000>a<td colspan=1000 rowspan=65534>b" * 3000 + "</table>"
    began = time.process_time()
    lines = extract_text(page).split("\n")
    assert time.process_time() - began < 5 and len(lines) == 3000 and all(x.startswith("a") and x.endswith("b") for x in lines)
    uneven = "<table>" + "".join(f"<tr><td>x<td colspan={k % 9 + 1} rowspan={k % 7 + 1}>y<td>z" for k in range(2000)) + "</table>"
    began = time.process_time()
    assert extract_text(uneven).count("z") == 2000 and time.process_time() - began < 5


def test_cells_below_a_span_move_right():
    page = "<table><tr><td rowspan=2>long one<td>b<tr><td>c<td>d<tr><td>e</table>"
    assert extract_text(page).split("\n") == ["long one  b", "          c  d", "e"]
