"""Word grouping against the plain rule, including uneven baselines."""

import random
from statistics import median

from arbora.operators import layout


def model(words):
    groups = []
    for w in sorted(words):
        if groups and abs(w[0] - median(x[0] for x in groups[-1])) <= 3:
            groups[-1].append(w)
        else:
            groups.append([w])
    return [" ".join(w[4] for w in sorted(g, key=lambda w: (w[1], w[0]))) for g in groups]


def test_words_to_lines(spark):
    rng = random.Random(5)
    pages = {n: [(float(rng.randint(0, 60)) / 2, float(x), x + 5.0, 9.0, f"w{n}.{x}") for x in range(0, 400, 10)] for n in range(1, 15)}
    rows = [("d", n, *w) for n, ws in pages.items() for w in ws]
    df = spark.createDataFrame(rows, "document_id string, page_number int, top double, x0 double, x1 double, bottom double, text string")
    got = {}
    for r in layout.group_words_into_lines(df).orderBy("page_number", "line_no").collect():
        got.setdefault(r["page_number"], []).append(r["text"])
    assert got == {n: model(ws) for n, ws in pages.items()}
