import random

from chunkloom.llm import leak

WORDS = "alpha beta gamma delta kappa sigma omega tau of the a in x1 ürün 42 maßen".split()


def brute(docs, items, window):
    found = set()
    for d, text in docs:
        w = leak.word_form(text or "").split()
        have = {tuple(w[i:i + window]) for i in range(len(w) - window + 1)}
        for i, t in items:
            v = leak.word_form(t or "").split()
            if any(tuple(v[k:k + window]) in have for k in range(len(v) - window + 1)):
                found.add((d, i))
    return found


def corpus(seed):
    rng = random.Random(seed)
    items = [(i, " ".join(rng.choices(WORDS, k=rng.randint(8, 30)))) for i in range(20)]
    docs = []
    for d in range(120):
        text = rng.choices(WORDS, k=rng.randint(0, 30))
        if rng.random() < 0.6:
            own = rng.choice(items)[1].split()
            a = rng.randint(0, max(0, len(own) - 11))
            text += own[a:a + rng.randint(10, 14)] + rng.choices(WORDS, k=3)
        docs.append((d, rng.choice([" ", ", ", " - ", "\u00a0", "__"]).join(w.upper() if rng.random() < 0.3 else w for w in text)))
    return docs + [(900, None), (901, ""), (902, "..."), (903, items[0][1] * 2000)], items + [(50, None), (51, ""), (52, "too few words"), (53, items[0][1])]


def test_against_brute_force(spark):
    docs, items = corpus(3)
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id bigint, text string, t string").repartition(4)
    evals = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, doc_id int")
    for block in (10**6, 900):
        got = [(r.doc_id, r.item_id) for r in leak.leaks(df, evals, block_chars=block).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(docs, items, 12)
    assert leak.leaks(df.filter("false"), evals).count() == 0 and leak.leaks(df, evals.filter("false")).count() == 0


def test_forms_do_not_count():
    index = leak.Index([(1, "One two three four five six seven eight nine ten eleven twelve caf\u00e9")])
    assert leak.matches(index, ["zz ONE, two\nthree—four five six seven еight nine ten\u00a0eleven ｔwelve cafe\u0301"]) == [(0, 1)]
    assert leak.matches(index, ["one two three four five six seven eight nine ten eleven"]) == []
    assert leak.matches(index, ["zone two three four five six seven eight nine ten eleven twelves"]) == []


def test_edit_budget_finds_every_altered_window():
    rng = random.Random(9)
    text = " ".join(rng.choice(["harbor", "signal", "ledger", "quarry", "bridge", "archive"]) + str(rng.randrange(99)) for _ in range(20))
    index = leak.Index([(1, text)], edits=2)
    for _ in range(150):
        form = list(leak.word_form(text)[1:-1])
        for _ in range(rng.randint(0, 2)):
            k = rng.randrange(len(form))
            form[k:k + 1] = rng.choice([[], ["q"], [form[k], "z"]])
        assert leak.matches(index, ["intro words " + "".join(form) + " outro"]) == [(0, 1)]


def test_banded_alignment():
    import numpy as np

    def prefix_distance(a, b):
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) + 1):
            for j in range(len(b) + 1):
                table[i][j] = max(i, j) if not i or not j else min(table[i - 1][j] + 1, table[i][j - 1] + 1, table[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
        return min(table[-1])

    rng = random.Random(2)
    for _ in range(400):
        a, b = ([rng.randrange(3) for _ in range(rng.randint(1, 8))] for _ in "ab")
        for k in range(4):
            assert leak.banded(np.array(a), np.array(b), k) == (prefix_distance(a, b) <= k)
