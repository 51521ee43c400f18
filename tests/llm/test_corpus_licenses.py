"""License matches against unbanded alignment of every template with every text, and awkward texts."""

import random
import time

from cladeframe.llm import licenses


def _best(template, words, low, high):
    """Places of equal words of the best local alignment, every cell looked at."""
    h = {}
    top = (0, 0, 0)
    for i, x in enumerate(template):
        for j in range(low, high):
            s = max(0, h.get((i - 1, j - 1), 0) + (2 if x == words[j] else -1), h.get((i - 1, j), 0) - 1, h.get((i, j - 1), 0) - 1)
            if s:
                h[i, j] = s
                top = max(top, (s, -j, -i))
    s, j, i = top[0], -top[1], -top[2]
    pairs = []
    while h.get((i, j), 0) > 0:
        x = 2 if template[i] == words[j] else -1
        if h[i, j] == h.get((i - 1, j - 1), 0) + x:
            if x == 2:
                pairs.append((i, j))
            i, j = i - 1, j - 1
        elif h[i, j] == h.get((i - 1, j), 0) - 1:
            i -= 1
        else:
            j -= 1
    return pairs[::-1]


def _brute(text):
    h, starts, ends, raw = licenses._words(text)
    words = h.tolist()
    digits = {k for k in range(len(words)) if raw[starts[k] : ends[k]].isdigit()}
    found = []
    for t in licenses.index()[0]:
        todo = [(0, len(words))]
        while todo:
            low, high = todo.pop()
            pairs = _best(t.words.tolist(), words, low, high) if high - low >= t.least else []
            if pairs and licenses._accepted(t, words, digits, pairs):
                a, b = pairs[0][1], pairs[-1][1]
                found.append((t.name, len(pairs), a, b, len(words[a : b + 1]), len(t.words)))
                todo += [(low, a), (b + 1, high)]
    out = []
    for one in sorted(found, key=lambda x: (-x[1], x[5], x[2], x[0])):
        if all(one[3] < c or d < one[2] for _, _, c, d, _, _ in out):
            out.append(one)
    place = lambda k: len(raw[:k].decode())
    return sorted((place(starts[a]), name, place(ends[b]), n, size) for name, n, a, b, _, size in out)


def test_matches_are_those_of_unbanded_alignment():
    draw = random.Random(6)
    notices = [t for t in licenses.TEMPLATES if len(t[1]) < 120]
    plain = "we went to the market under a work of licensed rights permission in public domain and later".split()
    seen = 0
    for _ in range(30):
        parts = []
        for _ in range(draw.randint(1, 4)):
            parts.append(" ".join(draw.choice(plain) for _ in range(draw.randint(0, 6))))
            name, text = draw.choice(notices)
            words = text.split()
            for _ in range(draw.choice((0, 0, 1, 2))):
                k = draw.randrange(len(words))
                words[k : k + 1] = draw.choice(([], ["zebra"], [words[k], "zebra"]))
            parts.append(" ".join(words * draw.choice((1, 1, 2, 3))))
        text = "é " + ". ".join(parts)
        got = sorted((a, name, b, n, size) for name, a, b, n, size in licenses.find_licenses(text))
        assert got == _brute(text), text
        seen += len(got)
    assert seen > 40


def test_every_template_and_its_repeats():
    for name, text in licenses.TEMPLATES:
        assert [x[0] for x in licenses.find_licenses(f"a b {text} {text}\nc {text}")] == [name] * 3, name


def test_versions_and_clauses_must_agree():
    names = lambda t: [x[0] for x in licenses.find_licenses(t)]
    assert names("Licensed under CC BY-SA 3.0.") == ["CC-BY-SA-3.0"] and names("Licensed under CC BY-SA 9.0.") == []
    assert names("licensed under the Apache License, Version 1.1") == [] and names("licensed under Apache License Version 2.0") == ["Apache-2.0-notice"]
    assert names("Released under an MIT License.") == ["MIT-short"] and names("Released under the XYZ License.") == []
    assert names("This work is licensed under the GNU General Public License, version 2.") == ["GPL-2.0-notice"]


def test_long_texts_and_repeated_rows(spark):
    began = time.time()
    assert len(licenses.find_licenses("All rights reserved. " * 20000)) == 20000 and licenses.find_licenses("under the " * 30000) == []
    assert time.time() - began < 30
    rows = spark.createDataFrame([(1, "All rights reserved"), (1, "All rights reserved"), (None, None), (2, ""), (3, " \n"), (4, "reserved rights all")], "doc_id long, text string").withColumnRenamed("missing", "spans")
    got = sorted((r.doc_id or 0, r.n_licenses, r.licenses, r.spans) for r in licenses.license_spans(rows).collect())
    assert got == [(0, 0, "", ""), (1, 1, "All-rights-reserved", "0:19:3:3"), (1, 1, "All-rights-reserved", "0:19:3:3"), (2, 0, "", ""), (3, 0, "", ""), (4, 0, "", "")]
