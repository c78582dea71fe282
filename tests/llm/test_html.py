import re

from furlong.llm import html as H

SF = "/root/testdata/sf0.01"


def brute(page):
    """The article element of the given tables' pages, by their own template."""
    import html

    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1|br)\b[^>]*>", body)
    parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in parts]
    return " ".join(x for x in parts if x)


def test_held_out_pages():
    good = bad = 0
    for page, labels in H.labelled_pages(150, seed=99):
        found = H.blocks(page)
        states = H.model().decode([f for _, f in found])
        for (t, _), s in zip(found, states, strict=True):
            if t in labels:
                good += labels[t] == s
                bad += labels[t] != s
    assert good / (good + bad) > 0.95


def test_tables_pages(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    want = {r.page_id: brute(r.html) for r in rows}
    got = H.op2_main_text(spark, SF).collect()
    assert len(got) == len(rows)
    assert sum(r.text == want[r.page_id] for r in got) >= 0.99 * len(rows)
    assert all(r.n_chars == len(r.text) for r in got)


def test_edges(spark):
    odd = [None, "", "plain words only, no tag at all", "<", "<p", "<p>a<b>b</p", "<div>" * 5000 + "x", '<a href="x>y', "<script>alert('<p>no</p>')", "&lt;p&gt; &amp;amp; &#233;", "<p>long " + "word " * 300_000]
    df = spark.createDataFrame([(i, "u", t, "m") for i, t in enumerate(odd)] + [(None, None, None, "m"), (1, "u", "", "m")], "page_id long, url string, html string, main_text string")
    got = H.main_text(df).collect()
    assert len(got) == len(odd) + 2 and got[0].main_text == "" and got[1].main_text == ""
    assert "alert" not in "".join(r.main_text for r in got)
    assert H.main_text(df.limit(0)).count() == 0
    assert H.blocks("<p>a&nbsp;b<br>c<i>d</i></p><style>x</style><!-- y -->&eacute;")[0][0] == "a b"
    assert [t for t, _ in H.blocks("<p>a <i>b</i>c<p>&lt;d&gt;")] == ["a bc", "<d>"]


def test_viterbi_is_the_best_path():
    import itertools

    c = H.model()
    f = [f for _, f in H.blocks(H.labelled_pages(1, seed=5)[0][0])][:9]

    def score(path):
        e = [sum(c.weights.get(x, (0, 0))[s] for x in own) for own, s in zip(f, path, strict=True)]
        return sum(e) + c.first[path[0]] + sum(c.step[a][b] for a, b in itertools.pairwise(path))

    assert abs(max(score(p) for p in itertools.product((0, 1), repeat=len(f))) - score(c.decode(f))) < 1e-9


def test_closing_tags_reach_any_depth():
    inner = "<div>x" * 500
    page = f"<article><p>One.</p>{inner}</article><footer>Two.</footer><nav>{inner}</nav><p>Three.</p>"
    features = {t: f for t, f in H.blocks(page)}
    assert "in:article" in features["One."]
    assert not {"in:article", "in:div"} & set(features["Two."])
    assert not {"in:nav", "in:div"} & set(features["Three."])
    for outer, a, b in (("ul", "li", "li"), ("table", "td", "tr"), ("dl", "dt", "dd")):
        features = {t: f for t, f in H.blocks(f"<{outer}><{a}>{'<section>' * 300}<p>One.<{b}>Two.</{outer}>")}
        assert "in:section" in features["One."] and "in:section" not in features["Two."] and f"in:{outer}" in features["Two."]
    # a list inside an item is a bar
    features = {t: f for t, f in H.blocks(f"<ul><li class=main>{'<section>' * 300}<ul><li>One.")}
    assert "hint:main" in features["One."]


def test_what_never_ends_hides_nothing():
    for tag in ("video", "audio", "svg", "math", "object", "canvas", "select", "datalist", "template", "iframe", "noscript", "textarea", "title"):
        said = [t for t, _ in H.blocks(f"<article><p>One.</p><{tag} class=x><p>Two.</p></article>")]
        assert said == ["One.", "Two."], tag
        assert [t for t, _ in H.blocks(f"<p>One.</p><{tag}><p>no</p></{tag} ><p>Two.")] == ["One.", "Two."], tag
    assert [t for t, _ in H.blocks("<p>One.<script>var x = 1;")] == ["One."]


def test_hostile_pages_take_time_in_proportion():
    import time

    n = 1_000_000
    pieces = ['<a "', "<a '\"", '<a ">" ', "<script ", "<video>", "<div>", "<", "<!", "<p class=", "<!--", "</div>", '<a x="', "<a ''\">", "&amp", "<select><b"]
    for piece in pieces:
        page = piece * (n // len(piece)) + "'"
        began = time.process_time()
        H.blocks(page)
        assert time.process_time() - began < 2 * 4, piece  # 2 s, on a machine that may be four times as slow


def test_tags_as_a_plain_reader_finds_them():
    """The tags of random pages, against the rule written as one pattern."""
    import random

    rng = random.Random(4)
    rule = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*)>""", re.S)
    for _ in range(3000):
        page = "".join(rng.choice(["<", ">", "a", "b ", "/", '"', "'", "=", "!", "--", "x", " "]) for _ in range(rng.randrange(40)))
        want = [(m.start(), m.end(), (m[2] or m[5] or "").lower(), bool(m[1] or m[4]), m[3] or m[6] or "") for m in rule.finditer(page)]
        tags, got, at = H.Tags(page), [], 0
        while (t := tags.after(at)) is not None:
            got.append(t)
            at = t[1]
        assert got == want, page
