"""Weak supervision of personal data: EM on simulated votes, the classifier on made texts, overlaps and long texts."""

import random
import time

from cladeframe.llm import pii


def test_em_and_classifier_recover_the_truth_behind_the_votes():
    draw = random.Random(3)
    right = (0.9, 0.8, 0.85, 0.7, 0.75)  # how often each labeler votes with the truth
    counts, truth = {}, {}
    for _ in range(4000):
        real = draw.random() < 0.6
        votes = tuple((1 if real else -1) if draw.random() < r else (-1 if real else 1) for r in right)
        key = (4, votes, 1)
        counts[key] = counts.get(key, 0) + 1
        truth.setdefault(key, []).append(real)
    patterns = [(k, list(v), s, n) for (k, v, s), n in counts.items()]
    weights, least = pii.fit(patterns)
    n = len(pii.KINDS)
    score = lambda k, v, s: weights[k] + sum(w * x for w, x in zip(weights[n : n + 5], v, strict=True)) + s / 3 * weights[-1]
    hits = sum(sum(real == (score(*key) > least) for real in each) for key, each in truth.items())
    best = sum(max(sum(each), len(each) - sum(each)) for each in truth.values())
    assert hits >= 0.97 * best and weights[n] > weights[n + 3] > 0


def test_classifier_tells_real_spans_from_look_alikes(spark):
    draw = random.Random(5)
    d = lambda n: "".join(draw.choice("123456789") for _ in range(n))
    good = lambda k: ([f"call me at (555) {d(3)}-{d(4)} tonight", f"my ssn is 2{d(2)}-{d(2)}-{d(4)} ok", f"account DE{d(2)} {d(4)} {d(4)} {d(4)} {d(4)} {d(2)} there", f"contact Maria Lopez today", f"ship to {d(2)} North Elm Street please", "write to bob [at] example [dot] com soon"][k % 6])  # noqa: E731, F541
    bad = lambda k: ([f"order #000-{d(2)}-0000x", f"version 111-111-1111_{k}", f"isbn 666-{d(2)}-0000 a"][k % 3])
    texts = [good(k) for k in range(240)] + [bad(k) for k in range(120)]
    got = {r.doc_id: r.n_extra for r in pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert sum(got[k] > 0 for k in range(240)) >= 0.95 * 240 and sum(got[k] > 0 for k in range(240, 360)) <= 0.1 * 120


def test_extra_spans_touch_no_base_span_and_long_texts_are_linear(spark):
    rows = [
        (1, "mail anna.Maria@Lopez.com or Maria Lopez"),
        (2, "+1 (555) 123-4567 and (555) 123-4567"),
        (3, " ".join(f"a{k}@b.com (555) 123-{k % 9000 + 1000:04d}" for k in range(12000))),
        (3, "x"),
        (None, None),
        (4, ""),
    ]
    began = time.time()
    got = pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("unused", "spans")).collect()
    assert time.time() - began < 120 and len(got) == 6
    by = {r.doc_id: r for r in got if r.spans}
    assert by[2].spans.startswith("phone:0:17") and by[2].n_phone == 1
    spans = [x.split(":") for x in by[3].spans.split(",")]
    assert by[3].n_email == 12000 and by[3].n_extra == 12000 and [int(a) for _, a, _ in spans] == sorted(int(a) for _, a, _ in spans)
    text = rows[2][1]
    assert all(("@" in text[int(a) : int(b)]) == (k == "email") for k, a, b in spans)
