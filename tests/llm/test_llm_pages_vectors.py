"""HTML extraction and embedding links against known answers and brute force."""

import time
from itertools import product

import numpy as np
import pytest

from ragspark.llm import embeddings, html


def test_blocks():
    page = "<html><head><title>T</title><style>x</style></head><body><p>a &amp; b<br>c<p>d <b>e</b>\n f</p><ul><li>g<li><a href='>'>h</a></ul><!-- n --><script>s</script>tail"
    assert [t for t, *_ in html.leaf_blocks(page)] == ["T", "a & b c", "d e f", "g", "h", "tail"]
    assert [k for *_, k in html.leaf_blocks(page)] == [0, 0, 0, 0, 1, 0]


def test_field_decodes_its_templates():
    pages = html.template_pages()
    field = html.fit(pages[::2])
    wrong = total = 0
    for template in html.TEMPLATES:
        text = template.replace("{p}", "Some words that make a line, and so it goes on. And more of them.").replace("{s}", "few words")
        blocks = html.leaf_blocks(text)
        got = field.decode([(t.lstrip("¤"), p, k) for t, p, k in blocks])
        wrong += sum(a != int(t.startswith("¤")) for a, (t, *_) in zip(got, blocks))
        total += len(blocks)
    assert wrong <= 0.02 * total


def test_extraction(spark):
    folder = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    field = html.train(pages, spark.read.parquet(f"{folder}/documents.parquet"))
    out = html.extract(pages, field).toPandas().set_index("page_id")
    good = 0
    for r in pages.collect():
        inside = [t for t, path, _ in html.leaf_blocks(r.html) if any(tag == "article" for tag, _ in path)]
        good += out.text[r.page_id] == "\n\n".join(inside)
        assert out.n_chars[r.page_id] == len(out.text[r.page_id])
    assert good >= 0.98 * len(out)


def test_odd_pages(spark):
    field = html.fit(html.template_pages()[::4])
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<"), (4, "u", "<p"), (5, "u", "plain & text"), (5, "u", "plain & text"), (None, "u", "<article>" + "<p>word word. " * 3000), (6, "u", "</div></p><p a='\"'>x")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", html.F.lit(1)).withColumn("n_chars", html.F.lit(1))
    out = html.extract(frame, field).collect()
    assert len(out) == len(rows) and all(r.n_chars == len(r.text) for r in out)
    assert {r.page_id: r.text for r in out}[1] == {r.page_id: r.text for r in out}[2] == ""
    assert html.extract(frame.where("false"), field).isEmpty()
    assert html.train(frame.where("false"), spark.createDataFrame([], "text string")).text("<article><p>Some words that are long enough, are they not?</p></article>")


def brute_force(rows):
    ok = [
        i for i, (_, v, y) in enumerate(rows)
        if y is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    ]
    unit = {i: np.array(rows[i][1], np.float64) / np.linalg.norm(np.array(rows[i][1], np.float64)) for i in ok}
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ok:
        for b in ok:
            if a < b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]) and unit[a] @ unit[b] >= 0.98:
                links[a] += 1
                links[b] += 1
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted((r[0], links[i], least[find(i)], r[0] == least[find(i)]) for i, r in enumerate(rows))


@pytest.mark.parametrize("tile", [1024, 20])
def test_links_of_vectors(spark, monkeypatch, tile):
    monkeypatch.setattr(embeddings, "TILE", tile)
    rng = np.random.default_rng(8)
    rows = []
    for g in range(12):
        base = rng.standard_normal(40)
        for _ in range(int(rng.integers(1, 60))):
            rows.append((len(rows), (base + rng.standard_normal(40) * rng.choice([0.05, 0.1, 0.14, 0.3])).astype(np.float32).tolist(), g % 3))
    same = rows[3]
    rows += [(500 + k, same[1], same[2]) for k in range(30)] + [(600, [2 * x for x in same[1]], same[2]), (601, same[1], 9)]
    rows += [(700, None, 1), (701, [], 1), (702, [0.0] * 40, 1), (703, [float("nan")] + [1.0] * 39, 1), (704, [None] + [1.0] * 39, 1), (705, same[1], None), (706, [1.0, 2.0], 1), (707, [float("inf")] * 40, 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("id", embeddings.F.lit(1)).withColumn("cell", embeddings.F.lit(1))
    got = sorted(map(tuple, embeddings.near_duplicates(frame).select("vec_id", "n_links", "component_id", "kept").collect()))
    assert got == brute_force(rows)
    assert embeddings.near_duplicates(frame.where("false")).isEmpty()


def test_ids_that_stand_for_several_vectors(spark):
    rng = np.random.default_rng(4)
    a, b, c = rng.standard_normal((3, 40))
    near = lambda v: (v + rng.standard_normal(40) * 0.01).astype(np.float32).tolist()
    rows = [(1, near(a), 1), (1, near(b), 1), (2, near(b), 1), (3, near(a), 1), (1, near(c), 2), (5, near(c), 2), (5, near(c), 2), (4, near(a), 2)]
    rows += [(7, rows[0][1], 1), (3, rows[0][1], 1), (3, rows[0][1], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted(map(tuple, embeddings.near_duplicates(frame).select("vec_id", "n_links", "component_id", "kept").collect()))
    assert got == brute_force(rows)


def test_links_of_the_table(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").limit(1000)
    rows = [(r.vec_id, list(r.embedding), r.label) for r in frame.collect()]
    got = sorted(map(tuple, embeddings.near_duplicates(frame).select("vec_id", "n_links", "component_id", "kept").collect()))
    assert got == brute_force(rows)


@pytest.mark.parametrize("sf", ["0.001", "0.1"])
def test_extraction_at_other_sizes(spark, sf):
    folder = f"/root/testdata/sf{sf}"
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    field = html.train(pages, spark.read.parquet(f"{folder}/documents.parquet"))
    good = [field.text(r.html) == "\n\n".join(t for t, path, _ in html.leaf_blocks(r.html) if any(tag == "article" for tag, _ in path)) for r in pages.collect()]
    assert sum(good) >= 0.98 * len(good)


@pytest.mark.parametrize("page", [
    "<p " * 350_000, "<div>x" * 170_000, "<div>x" * 90_000 + "</div>" * 80_000, "<b>" * 150_000 + "<div>y</div>" * 40_000, '<x "<y>" ' * 110_000,
    "<p 'a>" * 170_000, "<script " * 120_000, "<script>" * 120_000, "</" * 500_000, "<!--" * 250_000, "&amp;" * 200_000, "<li>z" * 200_000,
    "".join(f"<div class='name{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676 % 26)}'>t" for k in range(35_000)),
], ids=range(13))
def test_long_pages_take_linear_time(page):
    field = html.fit(html.template_pages()[::10])
    start = time.process_time()
    field.text(page)
    assert time.process_time() - start < 20


def test_paths_are_sums_of_their_elements():
    field = html.fit(html.template_pages()[::10])
    blocks = html.leaf_blocks("<body class='post text'><div class=post><p>a<div id=menu>b</div><p class=text>c</div></body>")
    want = np.array([field.weight[[field.index[f] for f in own if f in field.index]].sum(0) for own in html.features(blocks)])
    assert np.allclose(field.emissions(blocks), want)


def test_field_against_every_labelling():
    rng = np.random.default_rng(6)
    for n in (1, 2, 5, 8):
        e, move, start = rng.normal(size=(n, 2)), rng.normal(size=(2, 2)), rng.normal(size=2)
        field = html.Field({}, np.zeros((0, 2)), move, start)
        field.emissions = lambda _: e
        score = lambda y: start[y[0]] + sum(e[k, y[k]] for k in range(n)) + sum(move[y[k], y[k + 1]] for k in range(n - 1))
        best = max(product((0, 1), repeat=n), key=score)
        assert tuple(field.decode([None] * n)) == best


def test_training_climbs_the_exact_likelihood():
    """The gradient that forward-backward gives vanishes where the likelihood by enumeration is greatest."""
    rng = np.random.default_rng(9)
    pages = [([{f"f{rng.integers(3)}", "all"} for _ in range(n)], rng.integers(0, 2, n).tolist()) for n in (1, 3, 5, 4, 6, 2)]
    field = html.fit(pages)

    def value(weight, move, start):
        total = 0.0
        for own, gold in pages:
            e = np.array([weight[[field.index[f] for f in s]].sum(0) for s in own])
            score = lambda y: start[y[0]] + sum(e[k, y[k]] for k in range(len(y))) + sum(move[y[k], y[k + 1]] for k in range(len(y) - 1))
            total += score(gold) - np.logaddexp.reduce([score(y) for y in product((0, 1), repeat=len(gold))])
        ridge = sum((x * x).sum() for x in (weight, move, start))
        return total / len(pages) - html.RIDGE / 2 * ridge

    at = value(field.weight, field.move, field.start)
    for _ in range(30):
        near = [x + 0.2 * rng.normal(size=x.shape) for x in (field.weight, field.move, field.start)]
        assert value(*near) <= at + 2e-3
