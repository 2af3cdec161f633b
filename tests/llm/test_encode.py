import os
import random

import pytest
from pyspark.sql import functions as F

from chunkloom.llm import encode

PATH = f"{encode.TOKENIZERS}/byte_bpe_50k.tiktoken"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary files")
POOL = [chr(c) for c in [*range(0, 0x180), 0x2028, 0x85, 0x1C, 0x200B, 0xFEFF, 0x3000, 0x4E2D, 0x1F642, 0x301, 0xBD, 0x661, *range(0x400, 0x420)]] + list("  \n\n''st ll re") * 8


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{encode.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def texts(n, longest=40, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choices(POOL, k=rng.randint(0, longest))) for _ in range(n)]


def test_equals_the_library(library):
    own = encode.encoder(PATH)
    for text in [*texts(3000), "<|endoftext|> is text", " " * 300 + "x", "a" * 3000, "版本已被拆分" * 40, "'re'LL don't"]:
        assert own.encode(text) == library(text)
        assert b"".join(own.text[i] for i in own.encode(text)).decode() == text


def test_appends_and_edits_are_exact(library):
    own, rng = encode.encoder(PATH), random.Random(5)
    for text in texts(400):
        doc = encode.Encoded(own, text)
        for more in texts(5, 8, rng.randrange(10**6)):
            a = rng.randint(0, len(doc.text))
            if rng.random() < 0.4:
                doc.append(more)
            else:
                doc.replace(a, min(len(doc.text), a + rng.randint(0, 5)), more)
            assert doc.ids() == library(doc.text)
    doc = encode.Encoded(own, "some words here, again. " * 500)
    doc.worked = 0
    doc.replace(6_000, 6_001, "q")
    assert doc.worked < 40
    doc.worked = 0
    doc.append(" end")
    assert doc.worked < 40


def test_rows(spark, library):
    rows = [(1, "Hello", 1), (2, "", 1), (3, None, 1), (1, "Hello", 2), (4, "x y " * 30_000, 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, t int")
    got = [(r.doc_id, r.ids) for r in encode.encoded(df).collect()]
    assert sorted(got, key=lambda x: (x[0], len(x[1]))) == sorted([(i, library(t or "")) for i, t, _ in rows], key=lambda x: (x[0], len(x[1])))
    assert encode.encoded(df.filter("false")).count() == 0 and encode.encoded(df).schema["ids"].dataType.simpleString() == "array<int>"
