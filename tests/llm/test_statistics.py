"""Statistics of the quality classifier, and its scores, in plain Python."""

import math
import random
from collections import Counter

import pytest

from quillscope.llm.quality_rules import STATS, fit_quality, score_quality, text_statistics


def plain(text):
    data = (text or "").encode()
    words = data.split()
    lines = [tuple(x.split()) for x in data.split(b"\n")]
    lines = [x for x in lines if x]
    n, size = max(1, len(words)), max(1, len(data))
    letter = lambda c: 65 <= c < 91 or 97 <= c < 123 or c >= 128
    mark = lambda c: 33 <= c < 127 and not (letter(c) or 48 <= c < 58)
    share = lambda test: sum(map(test, data)) / size
    return [
        len(words), len(lines), sum(map(len, words)) / n, max(map(len, words), default=0), sum(len(w) <= 3 for w in words) / n, len(set(words)) / n, max(Counter(words).values(), default=0) / n,
        len(words) / max(1, len(lines)), len(set(lines)) / max(1, len(lines)), sum(mark(w[-1]) for w in words) / n, sum(not any(map(letter, w)) for w in words) / n, sum(sum(map(mark, w)) for w in words) / n,
        share(lambda c: 97 <= c < 123), share(lambda c: 65 <= c < 91), share(lambda c: 48 <= c < 58), share(mark), share(lambda c: c in (9, 11, 12, 13, 32)), share(lambda c: c == 10), share(lambda c: c >= 128),
    ]


def test_statistics_and_scores(spark):
    draw = random.Random(21)
    words = ["a", "the", "Über", "word,", "12", "!?", "x1.", "\x00", "naïve", "END", "—", "long" * 20]
    text = lambda: "".join(draw.choice(words) + draw.choice([" ", " ", "\n", "\t", "\n\n", " \r\n", "\x0b"]) for _ in range(draw.choice([1, 5, 60])))
    texts = [None, "", " \n ", "one", "same line\nsame  line\nline same", "word " * 20_000, *(text() for _ in range(400))]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in text_statistics(docs).collect():
        assert [r["stat_" + s] for s in STATS] == pytest.approx(plain(texts[r.doc_id]), abs=1e-12), texts[r.doc_id]
    # scores: rules over these statistics, one by one
    labels = spark.createDataFrame([(i, int(len(t or "") > 60), 0) for i, t in enumerate(texts)], "doc_id long, quality int, toxic int")
    model = fit_quality(docs, labels)
    assert model.rules
    for r in score_quality(docs, model, "score").collect():
        x, total = plain(texts[r.doc_id]), model.bias
        for rule, weight in zip(model.rules, model.weights, strict=True):
            total += weight * all(x[s] > bound if above else x[s] <= bound for s, above, bound in rule)
        assert r.score == pytest.approx(1 / (1 + math.exp(-max(-60, min(60, total)))), abs=1e-9)
