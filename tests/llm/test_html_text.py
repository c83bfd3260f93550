from collections import Counter

import pytest

from quern.llm import html_text


@pytest.fixture(scope="module")
def model():
    return html_text.Model.trained(html_text.labelled_pages())


def test_held_out_pages(model):
    """Pages of other random layouts than those trained on."""
    found, wanted, both = 0, 0, 0
    for source, main in html_text.labelled_pages(150, seed=4711):
        a, b = Counter(html_text.main_text(source, model).split("\n")), Counter(main.split("\n"))
        found, wanted, both = found + a.total(), wanted + b.total(), both + (a & b).total()
    assert both / found > 0.97 and both / wanted > 0.97


def test_messages_give_exact_marginals(model):
    """Sum-product on the tree equals summing over all states."""
    import itertools

    nodes = html_text.parse("<body><nav><a href=x>a</a></nav><div class=post><p>Some words here.</p>tail</div></body>")
    html_text.describe(nodes)
    got = model.marginals(nodes)
    flat = html_text.Model(model.features, model.moves, model.weight)
    alone = html_text.Model(model.features, {"element": ((0.5, 0.5), (0.5, 0.5))}, model.weight)
    own = alone.marginals(nodes)  # without ties each node shows its own evidence
    total, content = 0.0, [0.0] * len(nodes)
    for states in itertools.product((0, 1), repeat=len(nodes) - 1):
        s = (0, *states)
        weight = 1.0
        for i in range(1, len(nodes)):
            move = flat.moves.get(html_text.edge(nodes, nodes[i])) or flat.moves["element"]
            weight *= move[s[nodes[i].parent]][s[i]] * (own[i] if s[i] else 1 - own[i])
        total += weight
        for i, x in enumerate(s):
            content[i] += weight * x
    assert got == pytest.approx([c / total for c in content], abs=1e-9)


def test_markup(model):
    page = (
        "<html><head><title>x</title><script>if (a<b) '</p>'</script></head><body><nav><a href=/>Home</a></nav>"
        "<article><h1>A &amp; B</h1><p>First&nbsp;line<br>goes \n on.<p>Second <b>bold <i>both</i></b> end.<!-- no --></p>"
        "<div class=comments><p>Nice post, thanks.</p></div></article><footer>&copy; me</footer></body></html>"
    )
    assert html_text.main_text(page, model) == "A & B\nFirst line goes on.\nSecond bold both end."
    assert html_text.main_text("", model) == "" == html_text.main_text("<div", model)
    for cut in range(0, len(page), 7):
        html_text.main_text(page[:cut], model)


def test_skipped_elements_without_end_tag():
    """Texts after an unclosed head, button, select, canvas or svg are read; closed ones stay skipped, blocks inside too."""
    texts = lambda page: [n.text for n in html_text.parse(page) if n.text is not None]
    assert texts("<html><head><title>x</title><meta charset=a><body><p>One.<p>Two.</html>") == ["One.", "Two."]
    assert texts("<head><title>x</title><p>One.") == ["One."] == texts("<head><title>x</title>\n One.") == texts("<head><span>One.")
    for tag in ("button", "select", "canvas", "svg"):
        assert texts(f"<body><div><{tag}>Go<p>One.</p><div>Two.</div></div><{tag}>Go</{tag}>Three.") == ["One.", "Two.", "Three."]
    for tag in ("button", "select", "canvas", "template", "object"):
        assert texts(f"<body><div><{tag}>Go<p>One.</p><div>Two.</div></{tag}></div>Three.") == ["Three."]
    assert texts("<body><svg><foreignObject><p>One.</p></foreignObject></svg>Two.") == ["Two."]
    assert texts("<template><template><p>One.</p></template><p>Two.</p></template>Three.") == ["Three."]
    for page in ("<button><div>" * 9000, "<div><button>" * 9000 + "</button>", "<template>" * 9000 + "<p>"):
        texts(page)


def test_table(spark, model):
    page = "<body><article><h1>Title of it</h1><p>A text of a few words, long enough.</p></article></body>"
    rows = [(1, "u", page, "old"), (1, "u", page, "old"), (None, None, None, None), (2, "u", "", "x"), (3, "u", page * 400, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_text.extract(df, model).collect()
    texts = Counter((r.page_id, len(r.text)) for r in got)
    assert texts[(1, 47)] == 2 and texts[(None, 0)] == 1 and texts[(2, 0)] == 1 and texts[(3, 48 * 400 - 1)] == 1
    assert html_text.extract(df.limit(0), model).collect() == []


def test_broken_markup_is_linear(model):
    for page in ("<" * 50_000, "<p" * 30_000, '<a "' * 20_000, "<div>" * 3000 + "x", "&" * 50_000, "<b>" * 20_000):
        html_text.main_text(page, model)
