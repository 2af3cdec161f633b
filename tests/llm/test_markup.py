import json

from chunkloom.llm.markup import clean_texts, cleaned, constructs, main_lines

WITH = {
    "html": ["<p>text</p>", "one<br>two", "&lt;p&gt;x&lt;/p&gt;", "a&nbsp;b", "x &#8211; y", "<!-- note -->", "<FONT size=2>x</FONT>"],
    "markdown": ["# Title\n\ntext", "a `code` b", "some **bold** text", "a [link](https://x.example/a) b", "![alt](img/a.png)", "~~gone~~", "```py\nx\n```", "| a | b |\n|---|---|\n| 1 | 2 |", "Title\n=====\n\ntext", "- [ ] task", "__strong words__ here", "this *word* here"],
    "wiki": ["== Title ==\n\ntext", "a [[page|text]] b", "x {{note|y}} z", "'''bold''' x", "{| class=\"wikitable\"\n|}", "h2. Title\n\nx", "{code}\nx\n{code}", "{color:red}x{color}", "||a||b||\n|1|2|", "[text|https://x.example/x] y"],
    "latex": ["\\section{A}", "\\begin{itemize}\n\\item x\n\\end{itemize}", "so $\\alpha_{n}$ is", "$$a = \\frac{1}{2}$$", "\\( n^{2} \\)", "a~\\cite{x} b", "\\emph{x}"],
}
WITHOUT = ["- one\n- two", "> quoted mail\n> more", "text\n\n-- \nteam", "x * footnote: y", "if a < 41 and b > 9 then", "row -> start => row", "costs $14 and $66 per month", "see #15940 and #6157", "List<Span> or Map<String, Integer>",
           "mail <queue@x.example> now", "C:\\temp\\profile\\flag", "pattern \\d+ or \\w*", "{record: 6} and [12] and [sic]", "entry[0] and state[1]", "R&D and Q&A", "5'10 and 'quoted' words", "~79% of window", "a | b", "--chunk-map=1", "2 << 5",
           "x = [y for y in z if y is not None]\n# a comment in code\nz = 1", "the profile_map field", "key      value\na        1", "chunk * 5 = label * 3", "", "   "]


def test_constructs():
    for kind, texts in WITH.items():
        for text in texts:
            assert kind in constructs(text), (kind, text)
    for text in WITHOUT:
        assert constructs(text) == set(), text
    assert constructs(None) == set()
    assert "latex" in constructs(json.dumps({"key": "A-1", "comments": [{"body": "see $\\alpha_{n}$"}]}))
    assert constructs(json.dumps({"key": "A", "list": ["{record: 6}", {"x": None}]})) == set()


def test_structure_stays():
    page = ("<html><head><title>T</title><style>.x{}</style></head><body><nav><a href='/'>Home</a></nav>\n<h1>Main title</h1>\n<p>A first paragraph with <b>some</b> words &amp; more of them.</p><ul><li>item one is here</li><li>item two</li></ul>"
            "<pre><code>if a &lt; b:\n    x = 1</code></pre><table><tr><td>k</td><td>v</td></tr></table><script>track(1);</script></body></html>")
    text, kinds = cleaned(page)
    assert kinds == ["html"] and "# Main title" in text and "- item one is here\n- item two" in text and "```\nif a < b:\n    x = 1\n```" in text and "k\tv" in text
    assert "Home" not in text and "track" not in text and "words & more" in text and "<" not in text.replace("a < b", "")
    text, _ = cleaned("\\section{A}\n\nText \\textbf{bold} here.\n\n\\begin{equation}\ne = m\n\\end{equation}\n\n\\begin{itemize}\n\\item one\n\\item two\n\\end{itemize}")
    assert text.startswith("# A\n") and "Text bold here." in text and "$$e = m$$" in text and "- one\n- two" in text
    text, _ = cleaned("== Head ==\n\n'''B''' and [[page|shown]] {{t|x}}.\n\n* one\n* two\n# three\n\n<syntaxhighlight>\na * b\n</syntaxhighlight>")
    assert text.startswith("# Head\n") and "B and shown x." in text and "- one\n- two\n1. three" in text and "```\na * b\n```" in text
    text, _ = cleaned("# T\n\nThis *is* a [link](http://x.example/a) with `code_x`.\n\n```py\n# not a heading *x*\n```\n\n| a | b |\n|---|---|\n| 1 | 2 |")
    assert "This is a link with code_x." in text and "```\n# not a heading *x*\n```" in text and "a\tb\n1\t2" in text
    for text in WITHOUT:
        assert cleaned(text) == (text, [])
    assert cleaned(None) == (None, [])


def test_line_blocks():
    body = ["A long line of the main text stands here.", "And a second line that is as long."]
    assert main_lines(["Home", "", "", "", *body, "", "", "", "End"]) == body
    assert main_lines([*body, "", "short", "", "", "", "", *body]) == [*body, "", "short", *body]
    assert main_lines([*body, "Imprint"], page=True) == body and main_lines([*body, "Imprint"]) == [*body, "Imprint"]
    assert main_lines(["x"]) == ["x"] and main_lines([]) == []


def test_navigation_login_and_footer_of_a_page_go():
    page = """<html><body>
<div id="top"><a href="/">Home</a> | <a href="/news">All the latest news of today</a> | <a href="/about">About this company</a></div>
<div class="login">Log in: <input name="user"> <input name="pw"></div>
<ul><li><a href="/a">First long entry of a menu</a></li><li><a href="/b">Second long entry of a menu</a></li></ul>
<article><h1>The title</h1>
<p>The first paragraph of the article has <a href="/x">a link</a> and many words.</p>
<p>Short.</p>
<ul><li>apples</li><li>pears</li></ul>
<p>The last paragraph of the article has many words too.</p></article>
<ul><li><a href="/c">Related story about something</a></li><li><a href="/d">Another related story</a></li></ul>
<div class="foot">(c) 2024 Acme <a href="/imprint">Imprint and privacy notice</a></div>
<footer>All rights reserved, and a long sentence about how nothing of this may be used.</footer>
</body></html>"""
    text, kinds = cleaned(page)
    assert kinds == ["html"] and text.startswith("# The title") and text.endswith("has many words too.")
    assert "has a link and many" in text and "Short." in text and "- apples\n- pears" in text
    assert not any(x in text for x in ("Home", "latest", "Log in", "menu", "Related", "Acme", "Imprint", "rights"))


def test_rows(spark):
    rows = [("a", "<p>x</p>", "t"), ("b", "plain", "t"), ("c", None, None), ("d", "", "t"), ("a", "<p>x</p>", "t"), ("e", "<p>" + "long " * 50_000 + "</p>", "t")]
    df = spark.createDataFrame(rows, "id string, content string, kinds string")
    got = clean_texts(df).collect()
    assert len(got) == 6 and {r.id: len(r.kinds) for r in got} == {"a": 1, "b": 0, "c": 0, "d": 0, "e": 1} and {r.id: r.content for r in got}["c"] is None
    assert {r.id for r in clean_texts(df).filter("size(kinds) > 0").collect()} == {"a", "e"}
    assert clean_texts(df.filter("false")).count() == 0


def test_unclosed_markup_takes_linear_time():
    import time

    for unit in ("<nav><script>", "<!-- ", "$ $$ \\( ", "{{[[", "<pre> ", "\\begin{verbatim}", "* ** _ __ ~~ ", "''a "):
        began = time.time()
        cleaned(unit * (150_000 // len(unit)))
        assert time.time() - began < 5, unit


def test_constructs_of_any_length_are_found():
    import time

    assert "latex" in constructs("so \\( " + "x + y " * 700 + "\\) holds") and "latex" in constructs("so \\[ " + "x^2 + " * 700 + "\\] holds")
    assert "markdown" in constructs("a *" + "word " * 70 + "end* b") and "wiki" in constructs("text == " + "word " * 50 + "== text")
    assert "wiki" in constructs("||" + "a" * 100 + "||" + "b" * 100 + "||")
    for unit in ("\\( ", "\\[ ", " *x", " == a", " ||a", "\\(\\[", "* a", "**a", "__a", "==", "~~a", "$a", "{{a", "[[a", "![a](", "`a\n"):
        began = time.time()
        constructs(unit * (1_000_000 // len(unit)))
        assert time.time() - began < 20, unit
