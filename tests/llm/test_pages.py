import numpy as np
import pytest

from tastelake.llm import pages

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def labeller(spark):
    return pages.train(spark.read.parquet(f"{FOLDER}/pages.parquet"))


def texts(page):
    return [b.text for b in pages.blocks(page)]


def test_blocks():
    assert texts("<p>a &amp; b&nbsp;c<br>d\n  e<p>f <b>g</b>h</p>i<!-- no --><script>var t='<p>x</p>';</script>") == ["a & b c d e", "f gh", "i"]
    assert texts("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>") == ["a", "b", "c", "d"]
    assert texts("<div>cut <a href='x>y'>off</a> <b") == ["cut off"]
    assert texts("") == texts("<head><title>t</title></head><style>p{}</style><textarea><p>x</textarea>") == []
    path = pages.blocks('<div class="Main-Text" id=a><p><b>x<p>y')[1].path
    assert path == ("tdiv", "cmain", "ctext", "ca", "tp")


def test_silent_elements_end_with_what_is_around_them():
    assert texts("<datalist><option value=a>A<option value=b>B</datalist><article><p>kept</p></article>") == ["kept"]
    assert texts("<button>go<article><p>kept</p></article>") == ["kept"]
    assert texts("<p>let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be</p>") == ["let x=1 be"]
    assert texts("<img alt=Bob's><p>kept</p>") == ["kept"]
    assert texts("<div><noscript>no<p>no</div><p>kept") == ["kept"]
    assert texts("<p>a <svg><text>no</text></svg>b <select><option>no<option>no</select>c</p>") == ["a b c"]
    assert texts("<video>no<p>no</video>yes<iframe>no</iframe> too") == ["yes too"]
    assert texts("<a title='x>y\" z' href=\"b>c\">in</a>") == ["in"]
    assert texts("<object>no</section><p>no") == []
    assert pages.blocks("<body class=has-sidebar><p>x")[0].path == ("tbody", "tp")


def test_gradients_are_right():
    r = np.random.default_rng(0)
    model = pages.Labeller()
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    x = r.standard_normal((4, 2, pages.PATH_DIMS + pages.WORD_DIMS + pages.SIZES))
    mask = np.array([[1, 1], [1, 1], [1, 0], [1, 0]], bool)
    y = r.integers(0, 2, (4, 2)).astype(float)

    def loss():
        s = model.scores(x, mask)
        return ((np.log1p(np.exp(-np.abs(s))) + np.maximum(s, 0) - y * s) * mask).sum() / mask.sum()

    grads = model.gradients(x, mask, y)
    for name in grads:
        flat, at = model.weights[name].reshape(-1), int(r.integers(model.weights[name].size))
        kept = flat[at]
        flat[at] = kept + 1e-2
        high = loss()
        flat[at] = kept - 1e-2
        low = loss()
        flat[at] = kept
        assert grads[name].reshape(-1)[at] == pytest.approx((high - low) / 2e-2, rel=2e-2, abs=2e-5)


def test_given_pages(spark, labeller):
    import html
    import re

    source = spark.read.parquet(f"{FOLDER}/pages.parquet")
    got = {r["page_id"]: r for r in pages.main_text(source, labeller).collect()}
    for r in source.collect():
        inner = r["html"][r["html"].index("<article>") + 9 : r["html"].index("</article>")]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", inner)]
        want = "\n".join(x for x in parts if x)
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)


def test_long_pages_are_labelled_in_parts(spark, labeller):
    """Parts of any length give what the page as a whole gives."""
    page = pages.blocks(spark.read.parquet(f"{FOLDER}/pages.parquet").first()["html"] * 3)
    whole = labeller.label([page])[0]
    assert len(page) > 20 and (labeller.label([page], places=7)[0] == whole).all()


def test_names_that_no_list_has(spark, labeller):
    """Without any known name, sizes, links and neighbours decide; and names are not obeyed blindly."""
    source = spark.read.parquet(f"{FOLDER}/pages.parquet")
    right = total = agree = 0
    for r in source.collect():
        own = pages.blocks(r["html"])
        want = [pages.weak_label(b.path, len(b.text.split())) for b in own]
        bare = [pages.Block(tuple(w for w in b.path if w[1:] not in pages.AROUND | pages.INSIDE), b.text, b.linked) for b in own]
        found = labeller.label([bare])[0]
        right += sum(bool(f) == bool(y) for f, y in zip(found, want))
        agree += sum(bool(f) == bool(pages.weak_label(b.path, len(b.text.split()))) for f, b in zip(found, bare))
        total += len(want)
    print("blocks right without names", right, "of", total, "weak labels of the bare paths would give", agree)
    assert right >= 0.97 * total and agree < total


def test_parts_the_pages_lack(spark, labeller):
    source = spark.read.parquet(f"{FOLDER}/pages.parquet").first()["html"]
    inner = source[source.index("<article>") + 9 : source.index("</article>")]
    words = [b.text for b in pages.blocks(inner) if len(b.text.split()) > 20]
    page = (
        f"<body><header><p>{words[0][:40]}</p></header><div class='content'><h1>{words[0][:30]}</h1><p>{words[0]}</p><p>{words[1]}</p></div>"
        f"<div class='cookie-notice'><p>{words[1][:80]}</p></div><section class=comments><div class=comment><p>{words[0][:90]}</p></div></section>"
        f"<form><label>{words[1][:9]}</label></form><aside><p>{words[0][:50]}</p></aside><footer>{words[0][:30]}</footer>"
    )
    rows = [(1, "u", page), (2, None, None), (None, "v", ""), (4, "w", "<nav><a href=x>menu</a></nav>"), (1, "u", page)]
    df = spark.createDataFrame(rows, "page_id int, url string, html string").selectExpr("*", "7 as text", "8 as n_chars")
    got = pages.main_text(df, labeller).collect()
    want = "\n".join(" ".join(x.split()) for x in (words[0][:30], words[0], words[1]))
    assert sorted(r["text"] for r in got) == ["", "", "", want, want]
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert pages.main_text(df.limit(0), labeller).collect() == []
