"""The decision tree over flat blocks: brute-force splits, held-out pages, unseen names, and awkward pages."""

import random
import re

import numpy as np

from cladeframe.llm import html_text

LONG = "word " * 30


def test_splits_are_the_best_of_all():
    x, y = html_text.labelled_rows(25, 3)
    x = np.round(x, 2)
    for rows in (slice(None), slice(0, 90), slice(90, 200)):
        a, b, best = x[rows], y[rows], None
        for f in range(a.shape[1]):  # every feature and every threshold, counted row by row
            values = sorted(set(a[:, f].tolist()))
            for low, high in zip(values, values[1:], strict=False):
                cut, cost = (low + high) / 2, 0.0
                sides = [[m for v, m in zip(a[:, f].tolist(), b.tolist(), strict=True) if (v <= cut) == side] for side in (True, False)]
                if min(map(len, sides)) < html_text.LEAF:
                    continue
                for side in sides:
                    cost += len(side) * (sum(side) / len(side)) * (1 - sum(side) / len(side))
                if best is None or cost < best[0] - 1e-9:
                    best = (cost, f, cut)
        f, cut = html_text.best_split(a, b)
        assert f == best[1] and (a[:, f] <= cut).tolist() == (a[:, f] <= best[2]).tolist()


def test_tree_splits_on_words_density_and_neighbours():
    seen = set()

    def walk(node):
        if not isinstance(node, int):
            seen.add(html_text.FEATURES[node[0]])
            walk(node[2])
            walk(node[3])

    walk(html_text.tree())
    assert {"words", "words_before", "words_after", "density", "density_before", "density_after"} <= seen


def test_held_out_pages():
    x, y = html_text.labelled_rows(200, 77)
    assert np.mean([html_text.is_main(r) for r in x.tolist()] == y.astype(bool)) >= 0.985


def test_unseen_class_names():
    """Pages of div and p alone, whose names no list has: counts and densities must tell."""
    draw, right, every = random.Random(11), 0, 0
    words = lambda n: " ".join(draw.choice(("lake", "hill", "often", "green")) for _ in range(n))
    for k in range(120):
        text = [f"<p>@{words(draw.randint(30, 120))}</p>" for _ in range(draw.randint(2, 6))]
        menu = "".join(f"<li><a href=y>{words(draw.randint(1, 3))}</a></li>" for _ in range(5))
        page = f"<div class=zq{k}><ul>{menu}</ul></div><div class=yy{k}>{''.join(text)}</div><div class=ww{k}><a href=y>{words(2)}</a> <a href=y>{words(3)}</a></div>"
        for b, row in zip(html_text.blocks(page), html_text.features(page), strict=True):
            right += html_text.is_main(row) == b.text.startswith("@")
            every += 1
    assert right >= 0.98 * every


def test_names_hint_and_wrappers_do_not():
    for name in ("content-promo", "article-share", "site-notice", "body-banner", "advertorial", "page-footer", "main-nav", "post-tags", "entry-newsletter"):
        page = f"<article><h1>T</h1><p>{LONG}</p><div class='{name}'>Buy this thing now</div><p>{LONG}</p></article>"
        assert html_text.main_text(page) == f"T\n{LONG.strip()}\n{LONG.strip()}", name
    for page in (f"<div class=legal><article><h1>T</h1><p>{LONG}</p></article></div>", f"<article class=legal><h1>T</h1><p>{LONG}</p></article>", f"<form><article><h1>T</h1><p>{LONG}</p></article></form>"):
        assert html_text.main_text(page) == f"T\n{LONG.strip()}", page
    assert html_text.main_text("<article><p>Where <math>x</math> is big</p><p>See <object>this</object> too</p></article>") == "Where x is big\nSee this too"


def test_long_pages_and_repeats(spark):
    many = "<nav><a href=x>Menu</a></nav><article>" + "".join(f"<p>{LONG}{k}</p>" for k in range(20000)) + "</article><footer>x</footer>"
    deep = "<div>" * 100000 + "<article><p>" + LONG + "</p></article>"
    one = "<article><p>" + "w" * 300000 + " x</p></article>"
    pages = spark.createDataFrame([(1, "a", many), (1, "a", many), (2, None, deep), (None, "c", one), (3, "d", "<" * 50000), (4, "e", "&" * 50000), (5, "f", " \n ")], "page_id long, url string, html string")
    got = html_text.extract_text(pages).collect()
    assert [r.text.count("\n") for r in got if r.page_id == 1] == [19999, 19999] and all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r.text for r in got}
    assert by[2] == LONG.strip() and re.fullmatch("w{300000} x", by[None]) and by[5] == ""
