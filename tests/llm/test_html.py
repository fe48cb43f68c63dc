import html.parser
import random
import re

from episodica.llm.html_text import extract, render


def test_layout():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><h1>Head &amp; more</h1><p>One <b>bold</b>
 text<p>Two<br>lines<ul><li>a<li>b <ul><li>c</ul><li>d</ul><ol start=3><li>x<li value=7>y</ol><table><tr><th>Name<th>Value<tr><td>alpha<td>1<tr><td>b<td>22</table>
<div hidden>no</div><div style="display: none">no</div><script>var x="<p>no";</script>end<pre>
 a  b
c</pre>x<!-- c -->y &copy; 3 &lt; 4<br></p>"""
    assert render(page) == "Head & more\n\nOne bold text\n\nTwo\nlines\n\n- a\n- b\n  - c\n- d\n\n3. x\n7. y\n\nName   Value\nalpha  1\nb      22\n\nend\n\n a  b\nc\n\nxy © 3 < 4"


def test_nested_tables_spans_and_hidden_cells():
    assert render("<table><tr><td colspan=2>wide<td>z<tr><td>a<td>b<td>c<td hidden>no</table>") == "wide     z\na     b  c"
    assert "inner" in render("<table><tr><td><table><tr><td>inner</table><td>x</table>")
    assert render("<table><tr><td>a</td></tr>stray<tr><td>b</td></tr></table>").split() == ["stray", "a", "b"]


def test_broken_markup_keeps_text():
    for source, words in (("<p <b>x", "x"), ("a<b>b<i>c</b>d", "abcd"), ("<" * 3000, "<" * 3000), ("<div>" * 3000 + "deep", "deep"), ("<table><tr>" * 500 + "deep", "deep"), ("<td>x</td>", "x"), ("&#x110000;&bogus;", "�&bogus;")):
        assert render(source).replace("\n", "").strip() == words
    for source in ("", "<a href='x", "<!--", "<script>", "</p></div>"):
        assert render(source) == ""


class Words(html.parser.HTMLParser):
    """A plain reader: the words outside elements that are not seen."""

    def __init__(self):
        super().__init__()
        self.deep, self.out = 0, []

    def handle_starttag(self, tag, attrs):
        self.deep += tag in ("script", "style", "head", "title")

    def handle_endtag(self, tag):
        self.deep -= tag in ("script", "style", "head", "title")

    def handle_data(self, text):
        if not self.deep:
            self.out += text.split()


def test_all_words_of_the_pages(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    got = {r.page_id: r.text for r in extract(pages).collect()}
    for r in pages.collect():
        reader = Words()
        reader.feed(r.html)
        reader.close()
        words = re.sub(r"(?m)^\s*(-|\d+\.)(?= )", "", got[r.page_id])  # list marks
        assert "".join(words.split()) == "".join(reader.out)  # pages that are cut off too


def test_odd_pages(spark):
    df = spark.createDataFrame([(1, None, "t"), (None, "<p>x", "t"), (2, "", "t"), (2, "", "t")], "page_id long, html string, text string")
    assert sorted(map(tuple, extract(df).collect()), key=repr) == sorted([(1, None, 0), (None, "x", 1), (2, "", 0), (2, "", 0)], key=repr)
    assert extract(df.limit(0)).count() == 0


def test_attributes_by_name():
    for source in ('<p title="The hidden valley">see</p>', '<p alt="a hidden path" data-hidden>see</p>', "<p data-style='display:none'>see</p>", '<p style="backface-visibility: hidden">see</p>', '<p style="display:none; display:block">see</p>', "<p title='hidden'>see</p>"):
        assert render(source) == "see"
    for source in ("<p HIDDEN>no</p>", "<p hidden=''>no", "<p style=display:none>no</p>", "<p a=b/ hidden>no", '<p style="color: red; VISIBILITY : hidden !important">no'):
        assert render(source) == ""
    assert render("<p title=don't>visible one</p><p>visible two</p>") == "visible one\n\nvisible two"
    assert render("<p title=a\"b>one</p><a href = 'x>y' b=\">\">two</a>") == "one\n\ntwo"
    assert render("<!-->a<!--->b<!-- x --!>c") == "abc"
    assert render("<p " + "a='" * 20_000) == "" and render("<p " + "a=b" * 20_000 + ">x") == "x"


def test_formulas_drawings_and_options():
    assert render("<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn><semantics><annotation>tex</annotation></semantics></math> holds") == "so x=1 holds"
    assert render("<svg><title>t</title><defs><text>no</text></defs><path d='M0'/><style/><text>one</text><text>two <![CDATA[<3]]></text></svg>end") == "one\ntwo <3\nend"
    assert render("<svg><g><p>out</p>side") == "out\n\nside"
    assert render("<svg><foreignObject><p>in</p></foreignObject></svg>x") == "in\n\nx"
    assert render("Pick <select><option>red<option selected>green<optgroup><option>blue</select> now") == "Pick\nred\ngreen\nblue\nnow"


def test_rowspans_and_wide_cells():
    assert render("<table><tr><td rowspan=2>a<td>b<td>c<tr><td>d<td>e<tr><td>f<td>g<td>h</table>") == "a  b  c\n   d  e\nf  g  h"
    assert render("<table><tr><td>a<td rowspan=0 colspan=2>b<td>c<tr><td>d<td>e<tbody><tr><td>f<td>g</table>") == "a  b    c\nd       e\nf  g"
    wide = "w" * 60
    assert render(f"<table><tr><td>{wide}<td>x<tr><td>a<td>y</table>") == f"{wide}  x\n{'a'.ljust(60)}  y"
    many = "<tr><td>" + "z" * 90 + "<td>x"
    assert "x" in render("<table><tr>" + "<td rowspan=0 colspan=100>" * 200 + many * 300 + "</table>")


def test_very_long_pages():
    """Megabytes of text, of cells, of open elements: all of it comes out, in time that grows with the length."""
    assert render("<p>" + "word " * 400_000) == ("word " * 400_000).strip()
    cells = render("<table>" + "".join(f"<tr><td>a{i}<td>b{i}" for i in range(30_000)) + "</table>").split()
    assert cells == [x for i in range(30_000) for x in (f"a{i}", f"b{i}")]
    assert render("<div><span>" * 20_000 + "x" + "<li>y" * 20_000).replace("- ", "").split() == ["x"] + ["y"] * 20_000


def test_visibility_is_inherited():
    assert render("<div style='visibility:hidden'>no<p style='visibility:visible'>yes <b>too</b></p>no<hr><br>no</div>end") == "yes too\n\nend"
    assert render("<ul style='visibility:hidden'><li>no<li style='visibility: visible'>yes</ul>") == "- yes"
    assert render("<table><tr style='visibility:collapse'><td>no<td style='visibility:visible'>yes<tr><td>a<td>b</table>") == "   yes\na  b"
    assert render("<pre style='visibility:hidden'>no<br><b style='visibility:visible'>yes</b></pre>") == "yes"
    assert render("<div style='visibility:hidden'><p style='visibility:inherit'>no<p style='visibility:bogus'>no</div>") == ""
    assert render("<div style='display:none'><p style='visibility:visible'>no</div>") == ""


def test_inputs_and_dialogs():
    assert render("<form>Name <input name=n value='A &amp; B'><input type=submit value='Go now'><input type=button value=Stop><input type=hidden value=no></form>") == "Name A & B Go now Stop"
    assert render("<input type=PASSWORD value=no><input type=checkbox value=no>x") == "x"
    assert render("<dialog>no</dialog><dialog open>yes</dialog>") == "yes"


def plain_layout(rows):
    """Every slot of the grid, taken one by one; rows of (text, across, down)."""
    taken, texts = set(), {}
    for r, row in enumerate(rows):
        c = 0
        for text, across, down in row:
            while (r, c) in taken:
                c += 1
            texts[r, c] = text
            taken |= {(r + i, c + j) for i in range(down) for j in range(across)}
            c += across
    widths = [max(len(t) for (_, k), t in texts.items() if k == c) if any(k == c for _, k in texts) else 0 for c in range(max((c for _, c in texts), default=0) + 1)]
    lines = ["  ".join(texts.get((r, c), "").ljust(w) for c, w in enumerate(widths)).rstrip() for r in range(len(rows))]
    return "\n".join(x for x in lines if x)


def test_tables_like_a_plain_layout():
    draw = random.Random(5)
    for _ in range(400):
        rows = [[(draw.choice(["", "a", "bb", "long words"]), draw.choice([1, 1, 1, 2, 3]), draw.choice([1, 1, 1, 2, 4])) for _ in range(draw.randint(1, 4))] for _ in range(draw.randint(1, 6))]
        page = "<table>" + "".join("<tr>" + "".join(f"<td colspan={a} rowspan={d}>{t}" for t, a, d in row) for row in rows) + "</table>"
        assert render(page) == plain_layout(rows).strip("\n"), page


def test_spans_of_any_number_are_carried():
    """Cells stay under their columns however many cells above reach down; what would need too many blanks keeps all text, in order."""
    many = "".join(f"<td rowspan=0>h{i}" for i in range(40))
    got = render(f"<table><tr>{many}" + "<tr><td>x<td>y" * 30_000 + "</table>").split("\n")
    assert len(got) == 30_001 and set(got[1:]) == {got[1]} and got[1].split() == ["x", "y"]
    high = "".join(f"<td rowspan=0>h{i}" for i in range(5_000))
    tall = render(f"<table><tr>{high}" + "<tr><td>x<td>y" * 30_000 + "</table>").split()
    assert tall == [f"h{i}" for i in range(5_000)] + ["x", "y"] * 30_000
    wide = render("<table><tr>" + "<td rowspan=0 colspan=1000>" * 2_000 + "<tr><td>x<td>y" * 1_000 + "</table>")
    assert wide == "\n".join(["x  y"] * 1_000)
