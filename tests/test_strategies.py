"""Goldens of the strategies' contract, one per quirk, and invariants on random texts."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chunkloom.config import ChunkConfig
from chunkloom.functions.text import py_lines
from chunkloom.functions.tokens import counter
from chunkloom.operators import pack
from chunkloom.operators.segment import STRATEGIES, Item, agentic, boundary, chat, chat_json, chunked, code, document, gaps, large_pieces, nesting_depth, recursive, sections, sentence, sentences, size, table, ticketing, token

C = counter()
cfg = ChunkConfig


def texts(pieces):
    return [p.content for p in pieces]


def test_token_windows():
    assert token(Item(""), cfg(50, 10), C) == []
    assert texts(token(Item("Hello, world!"), cfg(100), C)) == ["Hello, world!"]
    made = token(Item("This is a test sentence. " * 50), cfg(50, 10), C)
    assert len(made) > 1 and all(p.tokens == 50 for p in made[:-1]) and made[-1].tokens <= 50
    assert [p.start for p in token(Item("a b c d"), cfg(2, 2), C)] == [0, 3]  # overlap as large as the size: no overlap
    assert pack.windows(10, 4, 1) == [(0, 4), (3, 7), (6, 10)]


def test_sentences_tile_and_merge():
    assert sentences("Hi there.  Next! No3.14 end\nx.") == ["Hi there.  ", "Next! ", "No3.14 end\nx."]
    assert sentences("A.\nB.") == ["A.", "\nB."]
    assert len(sentence(Item("One two. Three four! Five?"), cfg(1000), C)) == 1
    made = sentence(Item("Sentence one. " * 20 + "Sentence two. " * 20), cfg(50), C)
    assert len(made) > 1 and made[0].start == 0 and all(a.end == b.start for a, b in zip(made, made[1:]))
    assert texts(sentence(Item("Hi. Yes. A longer sentence here. Ok."), cfg(4), C)) == ["Hi. Yes. A longer sentence here. ", "Ok."]  # short ones take the next, a short last one stays
    assert texts(sentence(Item("word " * 30 + "end. Next one here."), cfg(5), C))[0].startswith("word word")  # too long alone: whole


def test_recursive_drops_separators_between_chunks():
    made = recursive(Item("aa bb\n\ncc dd\n\nee ff"), cfg(4), C)
    assert texts(made) == ["aa bb\n\ncc dd", "ee ff"] and [(p.start, p.end) for p in made] == [(0, 12), (12, 17)]
    assert texts(recursive(Item("\n\n\n\naa bb cc\n\ndd ee"), cfg(3), C)) == ["aa bb cc", "dd ee"]  # empty leading splits vanish
    assert texts(recursive(Item("+-*/"), cfg(2), C)) == ["+-", "*/"]  # no separator left: by characters


def test_document_sections():
    assert [(lv, t) for lv, t, _ in sections("\nintro\n# A\ntext\n```\n# no\n```\n## B\nx\n####### no")] == [(0, None), (1, "A"), (2, "B")]
    made = document(Item("# A\n\none two three four.\n\nfive six seven eight."), cfg(6), C)
    assert made[0].content.startswith("# A\n\n# A")  # the heading stands twice when a section is split
    assert document(Item("# T\nbody\n", path="p.md"), cfg(100), C)[0].meta == {"section": "T", "path": "p.md"}
    assert "long 3. 14! here " in texts(document(Item("para one is. long 3.14! here\n\nother"), cfg(6), C))  # splits after every mark
    assert texts(document(Item("a\r\nb"), cfg(9), C)) == ["a\nb\n"]


def test_code_by_lines_has_a_tail_chunk():
    lines = "\n".join(f"x{i} = {i}" for i in range(20))
    assert [p.meta["lines"] for p in code(Item(lines), cfg(), C)] == [(1, 20), (16, 20)]
    assert [p.meta["lines"] for p in code(Item("a\nb"), cfg(512, 0), C)] == [(1, 2)]
    assert code(Item("one"), cfg(), C)[0].meta["path"] == "unknown"


def test_code_by_entities():
    text = "import os\nimport sys, re, json, math, time\n\ndef hello():\n    pass\n\ndef world():\n    pass\n"
    made = code(Item(text, entities=[{"name": "hello", "entity_type": "function", "start_line": 4, "end_line": 5}, {"name": "world", "entity_type": "function", "start_line": 7, "end_line": 99},
                                     {"name": "bad", "entity_type": "function", "start_line": None, "end_line": 3}]), cfg(), C)
    assert [(p.meta["lines"], p.index, p.meta.get("symbol_name")) for p in made] == [((1, 3), 2, None), ((4, 5), 0, "hello"), ((7, 99), 1, "world")]
    assert gaps(5, [(1, 2), (1, 3)]) == [(0, 1), (3, 5)] and gaps(0, []) == []


def test_chat():
    thread = {"channel": "c", "thread_ts": "t1", "messages": [{"user": "a", "text": "hi", "ts": "2024-01-01T00:00:00Z"}, {"user": "b", "text": "yo: x"}]}
    made = chat(Item(json.dumps(thread), "application/json"), cfg(1000), C)
    assert texts(made) == ["a: hi\nb: yo: x"] and made[0].meta["thread_id"] == "t1" and made[0].meta["author"] == "a"
    assert chat_json('{"messages": [{"text": "no user"}]}') is None and chat_json('{"messages": 3}') is None
    fallen = chat(Item('{"messages": [{"text": "no user"}]}', "application/json"), cfg(1000), C)
    assert fallen[0].content.startswith('{"messages": [{"text": "no user"}]}'.split(": ")[0])
    made = chat(Item("[10:00] ann: hello there\nplain line\n\nbob: x"), cfg(1000), C)
    assert made[0].content == "ann: hello there\nunknown: plain line\nbob: x" and made[0].meta["ts"] == "10:00"
    assert len(chat(Item("\n".join(f"user{i}: Message {i}" for i in range(50))), cfg(100), C)) > 1
    assert len(chat(Item("a: b\nc: d\ne: f"), ChunkConfig(100, max_messages=2), C)) == 2


def test_tickets():
    made = ticketing(Item("Title: T\nStatus: Open\nDescription: Desc\nmore\nComments:\n- one\n- two"), cfg(1000), C)
    assert texts(made) == ["# T\n**Status**: Open\n\n## Description\n\nDesc\nmore", "## Comments\n\none\n\n---\n\ntwo\n\n---\n\n"]
    assert texts(ticketing(Item("Description: only"), cfg(1000), C)) == ["\n\n## Description\n\nonly"]  # two leading line ends
    assert texts(ticketing(Item("Title: gone\nComments:\n- c"), cfg(1000), C)) == ["## Comments\n\nc\n\n---\n\n"]  # no description: the title is lost
    assert texts(ticketing(Item("Title: alone"), cfg(1000), C)) == ["Title: alone"]  # nothing produced: the whole content
    assert texts(ticketing(Item('{"title": "J", "description": "d", "comments": [{"author": "x", "body": "y"}]}', "application/json"), cfg(1000), C))[1] == "## Comments\n\n**x**:\ny\n\n---\n\n"
    split = ticketing(Item("Description: " + "aa bb cc. " * 10), cfg(12), C)
    assert len(split) > 1 and all(p.meta["meta_type"] == "description" for p in split)


def test_tables():
    made = table(Item("name,age\na,1\nb,2"), cfg(6), C)
    assert texts(made) == ["name,age\na,1\n", "name,age\nb,2\n"] and [(p.start, p.end) for p in made] == [(0, 13), (4, 17)]
    assert texts(table(Item("| e-mail |\n| a |\n| b |"), cfg(1000), C)) == ["| e-mail |\n| e-mail |\n| a |\n| b |\n"]  # the header is taken for its own rule
    assert texts(table(Item("| a |\n| b |"), cfg(1000), C)) == ["| a |\n| b |"] and texts(table(Item("one"), cfg(9), C)) == ["one"]
    assert len(table(Item("h\n" + "a b c\n" * 3), cfg(1), C)) == 3  # a header beyond the budget leaves room for no two rows


def test_agentic():
    assert texts(agentic(Item("fn a() {}"), cfg(100), C)) == ["fn a() {}"]
    assert boundary("# x")[1] == pytest.approx(0.9) and boundary("# x")[1] == boundary("class A")[1] and boundary("## x")[1] == boundary("def f():")[1]
    assert boundary("######## x")[1] < boundary("")[1] and boundary("plain") is None
    text = "use a::b;\n" + "".join(f"fn f{i}() {{\n  let x = {i};\n}}\n" for i in range(50))
    made = agentic(Item(text), cfg(200), C)
    assert len(made) > 1 and all(t.strip() for t in texts(made)) and made[1].content.startswith("// Context:\nuse a::b;\n\n")
    assert made[-1].end == len(text.encode())
    assert agentic(Item("a b c\nfn x"), cfg(3), C)[-1].end == 10  # the last line has no line end: clamped
    assert nesting_depth("a{(b)[}]}}{") == 2


def test_large_items():
    assert large_pieces(b"one\n\ntwo\n\nthree\n\nfour", 15) == [(0, 10), (10, 21)]
    made = chunked(Item("aaaa bb.\n\ncccc dd.\n\neeee"), "sentence", cfg(2), C, most=12)
    assert [p.index for p in made] == list(range(len(made))) and made[-1].start >= 20
    assert large_pieces("éé".encode(), 1) == [(0, 2), (2, 4)] and large_pieces(b"", 5) == []
    with pytest.raises(ValueError):
        ChunkConfig(0)


TEXT = st.lists(st.sampled_from(list("ab1 .!?\n\r#|{}:,-é版🙂\t") + ["fn ", "def ", "\n\n", "# ", "```\n", "Title: ", "- "]), max_size=120).map("".join)


@settings(max_examples=150, deadline=None)
@given(TEXT, st.integers(1, 12), st.integers(0, 30))
def test_invariants(text, limit, overlap):
    config = ChunkConfig(limit, overlap)
    for name in STRATEGIES:
        made = chunked(Item(text), name, config, C)
        assert all(p.index == i for i, p in enumerate(made))
        assert all(p.end - p.start == size(p.content) or name in ("sentence", "agentic") for p in made)
        if text == "":
            assert made == []
    assert "".join(sentences(text)) == text
    assert "".join(texts(token(Item(text), ChunkConfig(limit, limit), C))) == text
    joined = "".join(c for c in text if not c.isspace())
    assert "".join(c for t in texts(code(Item(text), ChunkConfig(limit, 0), C)) for c in t if not c.isspace()) == joined
    data = text.encode()
    for most in (1, 5, 50):
        parts = large_pieces(data, most)
        assert b"".join(data[a:b] for a, b in parts) == data and all(data[a:b].decode() is not None for a, b in parts)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=20), st.integers(0, 15), st.integers(0, 3))
def test_packing_kernel(weights, budget, glue):
    ranges = pack.packed(weights, budget, glue=glue)
    assert [i for a, b in ranges for i in range(a, b)] == list(range(len(weights)))
    held, want = 0, []
    for i, w in enumerate(weights):
        if want and held + glue + w <= budget and want[-1]:
            want[-1].append(i)
            held += glue + w
        else:
            want.append([i])
            held = w
    assert [list(range(a, b)) for a, b in ranges] == want


def test_lines():
    assert py_lines("a\r\nb\rc\n\n") == ["a", "b\rc", ""] and py_lines("") == [] and py_lines("x\r") == ["x\r"] and py_lines("\n") == [""]


def test_cut_files_keep_their_entities():
    rows = [f"line {i} of the file" for i in range(1, 41)]
    own = [{"entity_type": "function", "name": "first", "start_line": 2, "end_line": 4}, {"entity_type": "function", "name": "across", "start_line": 18, "end_line": 24},
           {"entity_type": "function", "name": "last", "start_line": 38, "end_line": 40}, {"entity_type": "function", "name": "none", "start_line": None, "end_line": 3}]
    item = Item("\n".join(rows), "text/code:python", "a.py", "python", own)
    whole, made = chunked(item, "code", cfg(512), C), chunked(item, "code", cfg(512), C, most=20 * len(rows[-1]))
    assert {p.meta.get("symbol_name") for p in made} == {p.meta.get("symbol_name") for p in whole} == {"first", "across", "last", None}
    for p in made:
        a, b = p.meta["lines"]
        assert p.content == "\n".join(rows[a - 1:b])
    assert sorted(x for p in made if p.meta.get("symbol_name") == "across" for x in range(p.meta["lines"][0], p.meta["lines"][1] + 1)) == list(range(18, 25))
    assert [p.index for p in made] == list(range(len(made)))


def test_threads_in_json_are_not_cut():
    import json

    thread = json.dumps({"messages": [{"user": "u", "text": f"message {i}"} for i in range(50)]})
    item = Item(thread, "application/json")
    assert [p.content for p in chunked(item, "chat", cfg(20), C, most=100)] == [p.content for p in chunked(item, "chat", cfg(20), C)]


def test_reach_of_a_vocabulary(tmp_path):
    import os

    from chunkloom.functions.tokens import counter

    path = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    if not os.path.exists(path):
        return
    bpe = counter(f"bpe:{path}")
    text = "some words, numbers 12345   and 版本已被拆分 🙂🙂 internationalization " * 3
    for start in range(0, len(text), 7):
        for limit in (1, 2, 5, 17, 40):
            end = start + 1
            while end < len(text) and bpe.count(text[start:end]) < limit:
                end += 1
            assert bpe.reach(text, start, limit) == min(end, len(text))
