import random

from chunkloom.llm import handwritten as hw

WORDS = "queue batch token page scope row chunk limit entry header index span offset symbol".split()


def source(rng, lang="py"):
    lines = []
    for _ in range(rng.randint(5, 15)):
        a, b, c = rng.sample(WORDS, 3)
        lines += [f"def {a}_{b}({c}):", f'    """Keeps the {a} near its {b} as long as the {c} is open."""', f"    {a} = {b}_reader({c}, {rng.randrange(900)})", f"    if not {a}:", f"        return {b}", f"    return {a}", ""]
    return "\n".join(lines)


def made(rng):
    kind = rng.choice(["header", "packed", "data", "vendor", "accessors"])
    if kind == "header":
        return "lib/x.py", f"# Code generated by {rng.choice(WORDS)}gen. DO NOT EDIT.\n" + "".join(f"class {w.title()}Message(object):\n    def get_{w}{i}(self):\n        return self._{w}{i}\n" for i, w in enumerate(WORDS))
    if kind == "packed":
        return "dist/app.min.js", "".join(f"function {rng.choice('abc')}{rng.choice('xyz')}(n,r){{return t?e(r):{rng.randrange(99)}}}" for _ in range(60))
    if kind == "data":
        return "db/rows.sql", "\n".join(f"INSERT INTO {rng.choice(WORDS)} VALUES ({i}, 'x', {rng.randrange(9999)}, '2024-01-01');" for i in range(40))
    if kind == "vendor":
        return f"vendor/lib{rng.randrange(4)}/{rng.choice(WORDS)}.py", source(rng)
    return "src/acc.py", "".join(f"class M(object):\n    def get_{w}{i}(self):\n        return self._{w}{i}\n" for i, w in enumerate(WORDS * 2))


def corpus(seed, n=600):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        bad = rng.random() < 0.35
        path, text = made(rng) if bad else (f"src/{rng.choice(WORDS)}_{rng.choice(WORDS)}.py", source(rng))
        rows.append((i, f"s{rng.randrange(20)}", path, text, int(bad)))
    return rows


def test_held_out_accuracy():
    rows = corpus(1)
    model = hw.train([(s, p, t, False) for _, s, p, t, _ in rows])
    assert model.validation["accuracy"] > 0.97 and model.validation["masked_accuracy"] > 0.9
    fresh = corpus(2, 300)
    right = sum((model.margin(p, t) > model.threshold) == bool(y) for _, _, p, t, y in fresh)
    assert right / len(fresh) > 0.97


def test_labels_and_edges():
    assert hw.label("a/node_modules/x/b.js", "x = 1", False) and hw.label("a.py", "x = 1", True)
    for text in ("# Code generated by x. DO NOT EDIT.\nx = 1", "/*\n * @license foo 1.2.3\n */\nint x;", "// Vendored from a 1.2.3, upstream commit 1\nx"):
        assert hw.label("src/a.c", text, False), text
    for text in ("# Finds vendored copies and reports them.\nx = 1", 'BANNER = "# Code generated by packer. DO NOT EDIT."\n', "# Copyright 2020 the search team\nx = 1", "# Do not edit the cache while this job runs.\nx = 1"):
        assert not hw.label("src/a.py", text, False), text
    head, body = hw.edges("# one\nimport x\n# two\ny = 1")
    assert "# one" in head and "import x" in body
    assert hw.train([]).margin("x", "y") == 0 and hw.train([("r", None, "a", False)] * 3).margin(None, "") <= 0


def test_rows(spark):
    rows = corpus(3, 300)
    copy = source(random.Random(99))
    rows += [(1000 + i, f"other{i}", f"src/q_{i}.py", copy, 1) for i in range(3)] + [(2000, "s", None, None, 0), (2001, "s", "a.py", "", 0), (2002, None, None, source(random.Random(5)), 0)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "delivery_id bigint, source_id string, file_path string, normalized_content string, y int, k string").repartition(3)
    got = {r.delivery_id for r in hw.not_handwritten(df).collect()}
    truth = {r[0] for r in rows if r[4]}
    assert len(got & truth) / len(truth) > 0.95 and len(got - truth) / len(got) < 0.05 and {1000, 1001, 1002} <= got and not got & {2000, 2001}
    assert hw.not_handwritten(df.filter("false")).count() == 0
    assert [r for r in hw.not_handwritten(df).collect() if r.delivery_id == 1] == [r for r in hw.not_handwritten(df).collect() if r.delivery_id == 1]
