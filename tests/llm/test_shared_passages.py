"""Near duplicates where texts share passages that do not make them alike."""

import random

from varspark.llm import jaccard


def shingles(text: str) -> set[tuple[str, ...]]:
    words = text.lower().split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def test_shared_passages_make_a_row_for_each_holder(spark, monkeypatch):
    draw = random.Random(3)
    words = lambda n: [f"w{draw.randrange(10**6)}" for _ in range(n)]
    passages = [words(30) for _ in range(6)]
    texts = []
    for k in range(40):
        own = words(200)
        for p in draw.sample(passages, 4):
            own += p + words(8)
        texts.append(own)
        if k % 5 == 0:
            texts.append(own[:100] + words(6) + own[106:])
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    made = []
    saved = jaccard.saved

    def counted(df):
        out = saved(df)
        if "h" in out.columns:
            made.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "saved", counted)
    monkeypatch.setattr(jaccard, "CROWD", 2, raising=False)
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = [shingles(t) for _, t in rows]
    want = list(range(len(rows)))
    for y in range(len(rows)):
        for x in range(y):
            if 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                want[y] = min(want[y], want[x])
    assert got == dict(enumerate(want)) and len(set(want)) == 40
    # passages and pairs, not each of their n-grams: one row for each holder of a passage, or of what a pair shares
    assert made and max(made) <= 8 * len(rows)
