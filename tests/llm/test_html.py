"""Layout of rendered pages: fixed cases, and a round trip over built pages."""

import html

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from caselore.llm import html_text as H

CASES = [
    ("<p>one<p>two <b>bold\n text</b>", "one\n\ntwo bold text"),
    ("a<br>b<div>c</div>d", "a\nb\nc\nd"),
    ("<ul><li>a<li>b<ul><li>c</ul></ul><ol start=9><li>x<li>y</ol>", "* a\n* b\n  * c\n\n9. x\n10. y"),
    ("<table><tr><th>Name<th>N<tr><td>long name<td>12</table>", "Name       N\nlong name  12"),
    ("<table><tr><td colspan=2>wide<td>z<tr><td>a<td>b<td>c</table>", "wide  z\na  b  c"),
    ("<table><tr><td rowspan=2>r<td>1<tr><td>2</table>", "r  1\n   2"),
    ("<table><tr><td>a<br>b<td>c</table>", "a  c\nb"),
    ("<table>lost<tr><td>in</table>", "lost\n\nin"),
    ("<table><tr><td>日本<td>x<tr><td>abcd<td>y</table>", "日本  x\nabcd  y"),
    ("<table><tr><td>o<table><tr><td>i</table><td>r</table>", "o  r\ni"),
    ("<p hidden>no</p><p style='display:none'>no<p>yes<script>no</script><style>no</style><!-- no --><noscript>no</noscript>", "yes"),
    ("<title>no</title><head><meta charset=x></head>yes", "yes"),
    ("<pre>  keep\n   this</pre>end", "  keep\n   this\n\nend"),
    ("a &amp; b &lt;i&gt; &eacute;&#x41;", "a & b <i> éA"),
    ("<dl><dt>t<dd>d</dl><blockquote>q</blockquote><hr>z", "t\n    d\n\n> q\n\n---\n\nz"),
    ("x</p>y", "x\n\ny"), ("<b>open<i>nest", "open nest".replace(" ", "")), ("tail <p unfinished", "tail"), ("", ""),
    ("<a title='a > b'>link</a> 1 < 2", "link 1 < 2"), ("<h1>H</h1>t<select><option>o<option>p</select>", "H\n\nt\no\np"),
    ("<textarea>  raw <b> </textarea>", "  raw <b>"), ("<input type=hidden value=no><input value=yes>", "yes"),
]


@pytest.mark.parametrize("page, want", CASES)
def test_cases(page, want):
    assert H.page_text(page) == want


words = st.text("abc&<>é ", min_size=1, max_size=8).filter(lambda s: s.strip())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["p", "h2", "ul", "table", "off"]), st.lists(words, min_size=1, max_size=4)), max_size=6))
def test_round_trip(blocks):
    page, want = [], []
    for kind, texts in blocks:
        clean = [" ".join(t.split()) for t in texts]
        e = [html.escape(t) for t in texts]
        if kind == "off":
            page.append("<div hidden>" + "".join(e) + "</div>")
        elif kind == "ul":
            page.append("<ul>" + "".join(f"<li>{t}" for t in e) + "</ul>")
            want.append("\n".join("* " + t for t in clean))
        elif kind == "table":
            page.append("<table>" + "".join(f"<tr><td>{t}<td>|" for t in e) + "</table>")
            wide = max(map(len, clean))
            want.append("\n".join(f"{t:<{wide}}  |" for t in clean))
        else:
            page += [f"<{kind}>{t}" + ("</h2>" if kind == "h2" else "") for t in e]
            want += clean
    assert H.page_text("".join(page)) == "\n\n".join(want)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<table>", "</table>", "<tr>", "<td colspan=3 rowspan=2>", "</td>", "<li>", "<ul>",
                                 "</ul>", "<div", ">", "<", "'", "\"", "x", "&amp", "<!--", "-->", "<pre>", "</pre>", "<td>", "</li>", "<dd>"]),
                max_size=40).map("".join))
def test_never_fails(page):
    H.page_text(page)


def test_deep_and_hostile():
    assert H.page_text("<div><p>" * 20000 + "x") == "x"
    H.page_text("<a b='" * 2000)
    H.page_text("<" * 50000)


def test_extract(spark):
    df = spark.createDataFrame([(1, None, "t"), (None, "<p>x", "t"), (2, "", "t"), (2, "", "t")], "page_id long, html string, text string")
    got = sorted((str(r.page_id), str(r.text)) for r in H.extract(df).collect())
    assert got == [("1", "None"), ("2", ""), ("2", ""), ("None", "x")]
    assert H.extract(df.where("page_id > 9")).collect() == []


DRAWN = [
    ("a<svg><title>no</title><desc>no<p>no</p></desc><defs><text>no</text></defs><style>.q{fill:red}</style>loose"
     "<g><text x=1>one <tspan>two</tspan></text><path d='M0'/><text>three</text></g></svg>b", "a\none two\nthree\nb"),
    ("<svg><title/><defs/><g><text>t</text></g></svg>u", "t\nu"), ("<svg><path d=x><p>out", "out"),
    ("<svg><text><![CDATA[a < b]]></text></svg>", "a < b"), ("x<svg/>y", "xy"),
    ("<svg><switch><foreignObject><div>rich <i>text</i></div></foreignObject><text>plain</text></switch></svg>", "rich text"),
    ("<svg><text display=none>no</text><text visibility=hidden>no<tspan visibility=visible>yes</tspan></text></svg>", "yes"),
    ("let <math><mi>x</mi> <mo>=</mo> <mfrac><mn>1</mn><msqrt><mn>2</mn></msqrt></mfrac></math>.", "let x=1/\u221a2."),
    ("<math><semantics><mrow><mi>a</mi><mo>&#x2062;</mo><mtext>if <b>b</b></mtext></mrow><annotation>no</annotation></semantics></math>",
     "aif b"),
    ("<math display=block><mtable><mtr><mtd><mn>10</mn></mtd><mtd><mn>2</mn></mtd></mtr><mtr><mtd><mn>3</mn></mtd><mtd><mn>4</mn>"
     "</mtd></mtr></mtable></math>z", "10  2\n3   4\n\nz"),
    ("<math><mphantom><mi>no</mi></mphantom><mi>y</mi></math>", "y"),
    ("<div style='visibility:hidden'>no<p style='visibility:visible'>yes <b>too</b></p>no</div>", "yes too"),
    ("<ul style='visibility: hidden'><li>no<li style='visibility:visible'>yes</ul>", "* yes"),
    ("<ol><li>a<li style='visibility:hidden'>no<li style='display:none'>no<li>c</ol>", "1. a\n3. c"),
    ("<div style='display:none'>no<p style='display:block;visibility:visible'>no</p></div>yes", "yes"),
    ("<p style='display:none;display:block'>yes</p>", "yes"),
    ("<style>.off{display:none} #gone,b.dim{visibility:hidden}</style><p class='x off'>no<p id=gone>no<b class=dim>no</b>"
     "<i class=dim>no</i><p class=Off>yes <b class=dim>no</b><i class=dim>too</i>", "yes too"),
    ("<style>/* p{display:none} */ em{display:none}.on{display:inline}</style><p>yes <em>no</em><em class=on>too</em>", "yes too"),
    ("<style>p{display:none!important}</style><p style='display:block'>no</p><div>yes", "yes"),
    ("<style>p{display:none}</style><p style='display:block'>yes</p><p hidden>no</p>", "yes"),
    ("<style>.show{display:block}</style><p hidden class=show>yes</p>", "yes"),
    ("<style>@media print{p{display:none}} @media screen{i{display:none}} @import 'x';u{display:none}</style><p>yes<i>no</i><u>no</u>",
     "yes"),
    ("<style media=print>p{display:none}</style><noscript><style>p{display:none}</style></noscript><p>yes", "yes"),
    ("<style>body{visibility:hidden}div p,p:hover,p.a{display:none}</style><div><p>yes", "yes"),
    ("<style>p{color:red;&.x{display:none}; b{visibility:hidden}}</style><p>yes <b>too</b>", "yes too"),
    ("<table><tr style='visibility:collapse'><td>no<tr><td>yes</table>", "yes"),
]


@pytest.mark.parametrize("page, want", DRAWN)
def test_what_a_browser_draws(page, want):
    assert H.page_text(page) == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["<svg>", "</svg>", "<math>", "</math>", "<mtd>", "<mtable>", "</mtable>", "<mfrac>", "<mi>", "</mi>", "<text>",
                                 "<style>", "</style>", "p{display:none}", "{", "}", ";", "@media all{", "/*", "\"", "'", "<p>", "<td>", "<table>",
                                 "</table>", "<switch>", "<foreignObject>", "<![CDATA[", "]]>", "<g/>", "<li style='visibility:hidden'>", "x"]),
                max_size=40).map("".join))
def test_foreign_never_fails(page):
    H.page_text(page)


def test_deep_foreign_and_hostile_rules():
    assert H.page_text("<svg><g>" * 20000 + "<text>x") == "x"
    for css in ("@media all{" * 20000, "a{" * 50000, "p{" + "a" * 200000 + "{}", "\"(" * 50000, "p,." * 50000 + "x{display:none}"):
        H.page_text(f"<style>{css} display:none</style><p>x")
