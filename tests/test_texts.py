"""Text, Markdown, web and reply rules on small inputs."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from studyloom.functions import markdown as M
from studyloom.functions import replies as Y
from studyloom.functions import text as T
from studyloom.functions import titles as N
from studyloom.functions import web as W
from studyloom.operators import web as WO
from studyloom.operators import markdown as D
from studyloom.operators import structure as S
from studyloom.operators import study as P


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "x string").select(fn(F.col("x")).alias("y")).first().y


def test_speech(spark):
    said = one(spark, "Deep nets [12, 14] work well (He et al., 2016), e.g. ResNets; see Fig. 3 and Eq. 2.", T.for_speech)
    assert said == "Deep nets work well, for example, ResNets; see Figure 3 and Equation 2."


def test_sentences(spark):
    assert one(spark, "See e.g. The paper by J. Smith. We (Fig. 2) agree! $a. B$ holds. 3 do.", T.sentences) == [
        "See e.g. The paper by J. Smith.", "We (Fig. 2) agree!", "$a. B$ holds.", "3 do.",
    ]
    long = " ".join(["word"] * 80) + ", " + " ".join(["more"] * 75) + "; rest"
    parts = one(spark, long, T.sentences)
    assert [len(p.split()) for p in parts] == [80, 75, 1] and " ".join(parts) == long


def test_fold_is_compatibility_folding(spark):
    text = "Ａｂ ½ ① Ⅳ ㎏ ™ ﬃ ℝ⁺ ｶﾞ"
    assert one(spark, text, T.fold) == "".join(unicodedata.normalize("NFKC", c) for c in text)


@pytest.mark.parametrize(
    ("text", "plain"),
    [
        ("2 * 3 * 4 and 2*3", "2 * 3 * 4 and 2*3"), ("a **b** c*", "a b c*"), ("snake_case and _it_ __bold__", "snake_case and it bold"), ("`a*b*` \\*c\\*", "a*b* *c*"),
        ("[l **b**](u(v)w) [x][1] [y] f[0]", "l b x [y] f[0]"), ("![p](q.png)t [^1]", "t"), ("$a*b*_c$ \\(x_1\\) *e*", "$a*b*_c$ $x_1$ e"), ("x<sup>2</sup> <i>i</i> <https://a.b/c>", "x^{2} i https://a.b/c"), ("~~old~~ &lt;b&gt; < 3", "old <b> < 3"), ("", ""),
    ],
)
def test_inline_text(spark, text, plain):
    assert one(spark, text, M.inline_text) == plain


def test_fold(spark):
    assert one(spark, "𝑥ᵢ + 𝜃 ﬁnd ﬂow 𝐖₁𝐱 + 𝒃²", T.fold) == "xi + θ find flow W1x + b2"


def test_book(spark):
    text = (
        "header\n*** START OF THE PROJECT GUTENBERG EBOOK X ***\n\nCHAPTER I\n\nIt was a dark and\nstormy night; the rain fell in tor-\nrents.\n\n"
        "*** END OF THE PROJECT GUTENBERG EBOOK X ***\nlicence"
    )
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = [(r.kind, r.level, r.text) for r in S.text_blocks(d).orderBy("ord").collect()]
    assert got == [("heading", 1, "Chapter I"), ("paragraph", None, "It was a dark and stormy night; the rain fell in torrents.")]


def test_markdown(spark):
    md = "# T\n\npara *one*\n\n- a\n- b\n\n$$\nx = 1\n$$\n\n| h | k |\n|---|---|\n| 1 | 2 |\n\n```\ncode\n```\n\n![Figure 1: cat](c.png)\n"
    d = spark.createDataFrame([(1, md)], "doc_id long, text string")
    got = [(r.kind, r.text) for r in D.markdown_blocks(d).orderBy("ord").collect()]
    assert got == [("heading", "T"), ("paragraph", "para one"), ("item", "a"), ("item", "b"), ("math", "x = 1"), ("table", ""), ("code", "code"), ("image", "Figure 1: cat")]
    assert one(spark, "| a \\| b | **c** |", M.table_cells) == ["a | b", "c"]


def test_captions_attached(spark):
    rows = [
        (1, 0, "paragraph", "Table 2: Scores.", ""), (1, 1, "table", "", ""), (1, 2, "image", "", ""), (1, 3, "paragraph", "Figure 5. A cat.", ""), (1, 4, "paragraph", "text", ""),
    ]
    b = spark.createDataFrame(rows, "doc_id long, ord int, kind string, text string, caption string")
    got = [(r.kind, r.caption) for r in S.attach_captions(b).orderBy("ord").collect()]
    assert got == [("table", "Table 2: Scores."), ("image", "Figure 5. A cat."), ("paragraph", "")]


def test_web(spark):
    html = (
        "<html><head><title>Softmax | Site</title></head><body><nav><ul><li>Home</li></ul></nav><div class='x'><article><h1>Softmax</h1><p>The <i>softmax</i> maps "
        "&lt;x&gt;&#33; (, ) here" + " and more" * 60 + "</p></article></div><footer>Copyright</footer></body></html>"
    )
    assert one(spark, html, W.page_title) == "Softmax"
    blocks = web_blocks(spark, html)
    assert [b.kind for b in blocks] == ["heading", "paragraph"] and blocks[1].text.startswith("The softmax maps <x>! here")


def test_titles(spark):
    q = lambda t: tuple(one(spark, t, N.parse_query))
    assert q("2006.11239v2") == ("arxiv", "2006.11239") and q("https://arxiv.org/abs/2006.11239") == ("arxiv", "2006.11239")
    assert q("10.1145/3292500.3330701") == ("doi", "10.1145/3292500.3330701") and q("https://x.org/a.pdf") == ("url", "https://x.org/a.pdf") and q("diffusion models") == ("words", "diffusion models")
    assert one(spark, "Éclair: A  Study!", N.normalize_title) == "eclairastudy"


def test_replies(spark):
    r = "The answer [E1].\n---\nSHOW: E1\nNEXT: Why? | How? | What? | Four"
    assert one(spark, r, Y.visible_answer) == "The answer [E1]." and one(spark, r, Y.reply_show) == "E1" and one(spark, r, Y.reply_followups) == ["Why?", "How?", "What?"]
    assert one(spark, "Half\n--", Y.visible_answer) == "Half" and one(spark, "See [E1", Y.visible_answer) == "See"
    assert tuple(one(spark, "VERDICT: partly\nAlmost.", Y.feedback)) == ("partly", "Almost.") and tuple(one(spark, "VERDICT: got", Y.feedback)) == (None, "")


def test_heard_answers(spark):
    options = F.array(F.lit("A matrix of dot products between queries and keys"), F.lit("The gradients of the loss"), F.lit("The positional encodings"))
    said = {
        "Option 2": "option 1", "I'd go for two.": "option 1", "The second one.": "option 1", "kolme": "option 2", "B.": "option 1", "I don't know.": "don't know", "Either one or three": "unclear", "D": "unclear",
        "Dot products between the queries and the keys": "option 0", "": "unclear",
    }
    df = spark.createDataFrame([(k,) for k in said], "t string").select("t", P.heard_answer(options, F.col("t")).alias("h"))
    assert {r.t: r.h for r in df.collect()} == said


def test_terms(spark):
    lines = spark.createDataFrame([(1, 0, "We use CIFAR-10 and ImageNet."), (1, 1, "Then ReLU of Section II.")], "doc_id long, ord int, text string")
    assert [r.term for r in S.text_terms(lines).orderBy("rank").collect()] == ["ReLU", "CIFAR-10", "ImageNet"]


def test_elements_nested_in_their_own_name(spark):
    page = "<div class='sidebar'><div>menu</div>LEFT</div><p>a</p><nav><nav>x</nav>y</nav><div hidden><div/>z</div><input type=x>b<script>if (a < b) '<div>'</script><div class=\"text\">c</div>"
    assert one(spark, page, W.strip_furniture) == "<p>a</p>b<div class=\"text\">c</div>"
    long = "word " * 100
    root = one(spark, f"<body><main><div>{long}</div><div>rest</div></main><p>out</p></body>", W.article_root)
    assert root == f"<div>{long}</div><div>rest</div>"
    assert one(spark, f"<p>x</p><article><article>{long}</article>tail", W.article_root).endswith("tail")
    assert one(spark, "", W.strip_furniture) == "" and one(spark, "no tags < here", W.strip_furniture) == "no tags < here"


def test_markdown_fences_and_formulas_lose_nothing(spark):
    text = "intro\n```py\n~~~\ncode\n``\n```\n# After\n$$\na\nb $$ (3)\ntail text\n~~~~\nx\n~~~\ny\n~~~~\n\\[ c \\] where\n\n$$ never closed\n\nlast\n```\nopen end"
    d = spark.createDataFrame([(1, text), (2, "plain"), (3, ""), (4, None)], "doc_id long, text string")
    got = [(r["doc_id"], r["kind"], r["text"]) for r in D.markdown_blocks(d).orderBy("doc_id", "ord").collect()]
    assert got == [
        (1, "paragraph", "intro"), (1, "code", "~~~\ncode\n``"), (1, "heading", "After"), (1, "math", "a\nb \\tag{3}"), (1, "paragraph", "tail text"), (1, "code", "x\n~~~\ny"),
        (1, "math", "c \\text{ where}"), (1, "paragraph", "$$ never closed"), (1, "paragraph", "last"), (1, "code", "open end"), (2, "paragraph", "plain"),
    ]


def web_blocks(spark, html):
    return WO.web_blocks(spark.createDataFrame([(1, html)], "page_id int, html string"), ["page_id"]).orderBy("ord").collect()


def test_web_blocks_at_their_places(spark):
    page = r"""<div class="mw-body"><h1>Softmax</h1><ul><li><a href="/x">Deutsch</a></li><li><a href="/y">Suomi</a></li><li><a href="/z">Eesti</a></li></ul>
<p>Of <span style='display: none'><math><annotation encoding='application/x-tex'>{\displaystyle z_{i}}</annotation></math> stray</span> and<sup class='reference'><a href='#c'>[1]</a></sup> on.</p>
<table><tr><td>a</td><td><table><tr><td>1</td><td>2</td></tr><tr><td>3</td><td>4</td></tr></table></td></tr></table><p>open paragraph<table class=eqn><tr><td><math alttext="p &lt; q"></math></td><td>(A.1)</td></tr></table>
<figure><figcaption>Only words</figcaption></figure><figure><pre>x = 1</pre><figcaption>Listing 1</figcaption></figure><figure><img src=x width="10" height="10"><figcaption>Icon</figcaption></figure></div>"""
    got = [(b.kind, b.text, b.caption, b.number, b.rows) for b in web_blocks(spark, page)]
    assert got == [
        ("heading", "Softmax", None, None, None), ("paragraph", "Of $z_{i}$ and on.", None, None, None), ("paragraph", "a", None, None, None), ("table", "", None, None, [["1", "2"], ["3", "4"]]),
        ("paragraph", "open paragraph", None, None, None), ("math", "p < q", None, "A.1", None), ("paragraph", "Only words", None, None, None), ("code", "x = 1", "Listing 1", None, None), ("paragraph", "Icon", None, None, None),
    ]
    assert web_blocks(spark, None) == [] and web_blocks(spark, "") == [] and [b.text for b in web_blocks(spark, "a < b")] == ["a"]
    many = "<table><tr><td>1</td><td>2</td></tr><tr><td>3</td><td>4</td></tr></table>" * 300
    assert [b.kind for b in web_blocks(spark, many + "<p>end</p>")] == ["table"] * 300 + ["paragraph"]


def test_elements_of_a_page_end_at_their_own_tags(spark):
    nested = "<table><tr><td>a<table><tr><td>in</td></tr></table></td><td>b</td></tr></table><table>x</table>"
    assert one(spark, nested, W.tables) == [nested[: nested.index("<table>x")], "<table>x</table>"]
    figures = "<figure><figure><img src='a.png'></figure><img src='b.png'><figcaption>Both</figcaption></figure><img src=\"c.png\" alt='it\"s'>"
    assert [(f.src, f.caption, f.alt) for f in one(spark, figures, W.page_figures)] == [("a.png", "Both", ""), ("b.png", "", ""), ("c.png", "", 'it"s')]
    assert one(spark, "<head><meta name='citation_title' content='A \"b\" c'></head>", W.page_title) == 'A "b" c'
