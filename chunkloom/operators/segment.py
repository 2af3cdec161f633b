"""The nine strategies: each turns an item into segments and leaves packing to the kernel.

They are pure functions of (item, config, counter), so that they can be tested without Spark and run per Arrow batch.
Offsets and lengths count UTF-8 bytes. Blank segments give no chunk, empty content gives none.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np

from chunkloom.config import ChunkConfig
from chunkloom.functions.text import py_lines
from chunkloom.functions.tokens import TokenCounter
from chunkloom.operators.pack import filled, packed, windows


@dataclass
class Item:
    content: str
    content_type: str = "text/plain"
    path: str | None = None
    language: str | None = None
    entities: list[dict] = field(default_factory=list)


@dataclass
class Piece:
    content: str
    tokens: int
    start: int
    end: int
    index: int = 0
    meta: dict = field(default_factory=dict)


Strategy = Callable[[Item, ChunkConfig, TokenCounter], list[Piece]]


def size(text: str) -> int:
    return len(text.encode("utf-8", "surrogatepass"))


def _whole(texts: list[tuple[str, int | None, dict]], count: TokenCounter) -> list[Piece]:
    """Pieces that span 0 to their own length; a missing token count is made."""
    return [Piece(t, count.count(t) if n is None else n, 0, size(t), i, m) for i, (t, n, m) in enumerate(texts)]


def _one_after_another(texts: list[tuple[str, dict]], count: TokenCounter) -> list[Piece]:
    """Pieces whose offsets run on by their own lengths, whatever was dropped between them."""
    out, at = [], 0
    for i, (t, m) in enumerate(texts):
        out.append(Piece(t, count.count(t), at, at + size(t), i, m))
        at = out[-1].end
    return out


# --- token windows -------------------------------------------------------------------------------------------------

def token(item: Item, config: ChunkConfig, count: TokenCounter) -> list[Piece]:
    tokens = count.encode(item.content)
    out, start, at = [], 0, 0
    for i, (a, b) in enumerate(windows(len(tokens), config.chunk_size, config.chunk_overlap)):
        text = count.decode(tokens[a:b])
        start, at = start + size(count.decode(tokens[at:a])), a
        out.append(Piece(text, b - a, start, start + size(text), i))
    return out


# --- sentences -----------------------------------------------------------------------------------------------------

def sentences(text: str, delimiters: str = ".!?") -> list[str]:
    """Sentences that tile the text: a delimiter before a blank or the end closes one, with the blanks after it up to a line end."""
    marks = re.escape(delimiters)
    ends = [m.end() for m in re.finditer(rf"[{marks}](?:[^\S\n]+|(?=\n)|\Z)", text)]
    return [text[a:b] for a, b in pairwise([0, *ends, len(text)]) if a < b]


def sentence(item: Item, config: ChunkConfig, count: TokenCounter, delimiters: str = ".!?") -> list[Piece]:
    """Offsets are those of the source, but the first chunk begins at 0; blank sentences are left out."""
    at, kept = 0, []
    for s in sentences(item.content, delimiters):
        if s.strip():
            kept.append((s, at))
        at += size(s)
    merged: list[list] = []
    for s, start in kept:
        if merged and size(merged[-1][0]) < config.min_chars_per_sentence:
            merged[-1] = [merged[-1][0] + s, merged[-1][1], start + size(s)]
        else:
            merged.append([s, start, start + size(s)])
    weights = [count.count(s) for s, _, _ in merged]
    return [Piece("".join(s for s, _, _ in merged[a:b]), sum(weights[a:b]), merged[a][1] if i else 0, merged[b - 1][2], i)
            for i, (a, b) in enumerate(packed(weights, config.chunk_size))]


# --- recursive -----------------------------------------------------------------------------------------------------

# Separators from the strongest to the weakest.
SEPARATORS = ("\n\n", "\n", ". ", "! ", "? ", "; ", ", ", " ")
MARKDOWN_SEPARATORS = ("\n\n\n", "\n\n", "\n# ", "\n## ", "\n### ", "\n", ". ", " ")


def _by_characters(text: str, limit: int, count: TokenCounter) -> Iterator[str]:
    at = 0
    while at < len(text):
        end = max(at + 1, count.reach(text, at, limit))
        yield text[at:end]
        at = end


def _grown(parts: list[str], sep: str, limit: int, count: TokenCounter) -> Iterator[str | int]:
    """Joined parts under the limit, and the places of parts that exceed it alone. Empty parts before any text vanish."""
    glue = count.count(sep)
    alone = [count.count(p) for p in parts]
    open_, total = "", 0
    for i, (part, n) in enumerate(zip(parts, alone)):
        joined = n if not open_ else (total + glue + n if count.additive and sep.strip() != sep else count.count(open_ + sep + part))
        if joined <= limit:
            open_, total = (open_ + sep + part if open_ else part), joined
            continue
        if open_:
            yield open_
        if n > limit:
            yield i
            open_, total = "", 0
        else:
            open_, total = part, n
    if open_:
        yield open_


def recursed(text: str, limit: int, count: TokenCounter, separators: tuple[str, ...] = SEPARATORS) -> Iterator[str]:
    if not text:
        return
    if count.count(text) <= limit:
        yield text
        return
    for k, sep in enumerate(separators):
        parts = text.split(sep) if sep else list(text)
        if len(parts) > 1:
            for made in _grown(parts, sep, limit, count):
                if isinstance(made, int):
                    yield from recursed(parts[made], limit, count, separators[k + 1:])
                else:
                    yield made
            return
    yield from _by_characters(text, limit, count)


def recursive(item: Item, config: ChunkConfig, count: TokenCounter, separators: tuple[str, ...] = SEPARATORS) -> list[Piece]:
    return _one_after_another([(t, {}) for t in recursed(item.content, config.chunk_size, count, separators)], count)


# --- documents -----------------------------------------------------------------------------------------------------

_HEADING = re.compile(r"(#{1,6})\s+(.+)")


def sections(text: str, blank: bool = False) -> list[tuple[int, str | None, str]]:
    """(level, title, text) of the parts that headings begin; lines in fences are no headings; blank parts vanish, unless they are wanted."""
    marks, fenced = [], False
    rows = py_lines(text)
    for row in rows:
        fenced ^= row.startswith("```")
        marks.append(None if fenced else _HEADING.fullmatch(row))
    begins = [0, *(i for i, m in enumerate(marks) if m and i), len(rows)]
    out = []
    for a, b in pairwise(begins):
        body = "".join(r + "\n" for r in rows[a:b])
        if body.strip() or blank:
            m = marks[a]
            out.append((len(m[1]), m[2], body) if m else (0, None, body))
    return out


def _section_texts(level: int, title: str | None, body: str, limit: int, count: TokenCounter) -> list[str]:
    if count.count(body) <= limit:
        return [body]
    # a segment is (text, weight, whether it begins a group of its own, whether it is a paragraph)
    segments: list[tuple[str, int, bool, bool]] = []
    for para in filter(None, (p.strip() for p in body.split("\n\n"))):
        weight = count.count(para)
        if weight <= limit:
            segments.append((para, weight, False, True))
            continue
        for i, s in enumerate(filter(None, (x.strip() for x in re.findall(r"[^.!?]*[.!?]|[^.!?]+", para)))):
            segments.append((s, count.count(s), i == 0, False))
    groups: list[list[tuple[str, int, bool, bool]]] = []
    for segment in segments:
        if segment[2] or not groups:
            groups.append([])
        groups[-1].append(segment)
    texts = []
    for group in groups:
        for a, b in packed([w for _, w, _, _ in group], limit):
            text = ""
            for s, _, _, whole in group[a:b]:
                text += (("\n\n" if text else "") + s) if whole else s + " "
            texts.append(text)
    if title is not None and texts:
        texts[0] = f"{'#' * level} {title}\n\n{texts[0]}"
    return texts


def document(item: Item, config: ChunkConfig, count: TokenCounter) -> list[Piece]:
    made = [(t, {"section": title, "path": item.path}) for level, title, body in sections(item.content)
            for t in _section_texts(level, title, body, config.chunk_size, count)]
    return _one_after_another(made, count)


# --- code ----------------------------------------------------------------------------------------------------------

def _line_ranges(rows: list[str], config: ChunkConfig, count: TokenCounter) -> list[tuple[int, int]]:
    weights = [count.count(r + "\n") for r in rows]
    if not count.additive:  # the count of what came so far decides
        text, before = "", 0
        for i, r in enumerate(rows):
            text += r + "\n"
            now = count.count(text)
            weights[i], before = now - before, now
    return filled(weights, config.chunk_size, -(-config.chunk_overlap // 10))


def gaps(n: int, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of the places 0 to n that no span covers."""
    edge = np.zeros(n + 2, np.int64)
    for a, b in spans:
        if 0 <= a < b:
            edge[min(a, n)] += 1
            edge[min(b, n)] -= 1
    free = np.flatnonzero(np.cumsum(edge)[:n] == 0)
    return [(int(run[0]), int(run[-1]) + 1) for run in np.split(free, np.flatnonzero(np.diff(free) > 1) + 1) if len(run)]


def code(item: Item, config: ChunkConfig, count: TokenCounter) -> list[Piece]:
    """By entities and the gaps between them where there are any, else by lines. Chunks of entities come by their first line but keep their numbers."""
    rows = py_lines(item.content)
    where = {"language": item.language or "unknown", "path": item.path or "unknown"}

    def meta(first: int, last: int, entity: dict | None = None) -> dict:
        named = {"symbol_name": entity["name"], "meta_type": entity["entity_type"]} if entity else {}
        return where | named | {"lines": (first, last)}

    def texts() -> Iterator[tuple[str, int | None, dict]]:
        if not item.entities:
            for a, b in _line_ranges(rows, config, count):
                yield "\n".join(rows[a:b]), None, meta(a + 1, b)
            return
        spans = []
        for e in item.entities:
            if e.get("start_line") is None or e.get("end_line") is None:
                continue
            a, b = max(0, e["start_line"] - 1), min(e["end_line"], len(rows))
            spans.append((a, b))
            if a >= b:
                continue
            own = "\n".join(rows[a:b])
            if count.count(own) <= config.chunk_size:
                yield own, None, meta(e["start_line"], e["end_line"], e)
                continue
            for x, y in _line_ranges(py_lines(own), config, count):
                yield "\n".join(rows[a + x:a + y]), None, meta(e["start_line"] + x, e["start_line"] + y - 1, e)
        for a, b in gaps(len(rows), spans):
            own = "\n".join(rows[a:b])
            if count.count(own) > 10:
                yield own, None, meta(a + 1, b)

    made = _whole(list(texts()), count)
    return sorted(made, key=lambda p: p.meta["lines"][0]) if item.entities else made


# --- chat ----------------------------------------------------------------------------------------------------------

def _is_text(value: object) -> bool:
    return isinstance(value, str)


def chat_json(content: str) -> dict | None:
    """A thread, if the whole value has the required fields and types; unknown fields are ignored."""
    try:
        value = json.loads(content)
    except (ValueError, RecursionError):
        return None
    if not isinstance(value, dict) or not isinstance(value.get("messages"), list):
        return None
    if any(not (value.get(k) is None or _is_text(value[k])) for k in ("channel", "thread_ts")):
        return None
    for m in value["messages"]:
        if not isinstance(m, dict) or not _is_text(m.get("user")) or not _is_text(m.get("text")) or not (m.get("ts") is None or _is_text(m["ts"])):
            return None
    return value


def chat_text(content: str) -> dict:
    """``[ts] speaker: text`` lines; a line without ``: `` is a message of unknown."""
    messages = []
    for row in py_lines(content):
        if not row.strip():
            continue
        who, colon, said = row.partition(": ")
        if not colon:
            messages.append({"user": "unknown", "text": row, "ts": None})
        elif who.startswith("[") and "]" in who:
            ts, _, speaker = who[1:].partition("]")
            messages.append({"user": speaker.strip(), "text": said, "ts": ts})
        else:
            messages.append({"user": who, "text": said, "ts": None})
    return {"channel": None, "thread_ts": None, "messages": messages}


def chat(item: Item, config: ChunkConfig, count: TokenCounter) -> list[Piece]:
    thread = (chat_json(item.content) if "json" in item.content_type else None) or chat_text(item.content)
    messages = thread["messages"]
    said = [f"{m['user']}: {m['text']}" for m in messages]
    return _whole([("\n".join(said[a:b]), None, {"author": messages[a]["user"], "thread_id": thread.get("thread_ts"), "ts": messages[a].get("ts")})
                   for a, b in packed([count.count(s) for s in said], config.chunk_size, config.max_messages)], count)


# --- tickets -------------------------------------------------------------------------------------------------------

# The labels of a ticket's fields and parts, and the fields of its JSON form.
_FIELDS = {"Title": "title", "Summary": "title", "Status": "status", "Priority": "priority", "Assignee": "assignee", "Reporter": "reporter", "Author": "reporter"}
_PARTS = {"Description": "description", "Comments": "comments", "Discussion": "comments"}
_TEXTS = ("key", "title", "description", "status", "priority", "assignee", "reporter")


def ticket_json(content: str) -> dict | None:
    try:
        value = json.loads(content)
    except (ValueError, RecursionError):
        return None
    if not isinstance(value, dict) or any(not (value.get(k) is None or _is_text(value[k])) for k in _TEXTS):
        return None
    comments = value.get("comments", [])
    if not isinstance(comments, list) or any(
            not isinstance(c, dict) or not _is_text(c.get("body")) or not (c.get("author") is None or _is_text(c["author"])) for c in comments):
        return None
    return {k: value.get(k) for k in _TEXTS} | {"comments": [{"author": c.get("author"), "body": c["body"]} for c in comments]}


def _ticket_records(content: str) -> Iterator[tuple[str, str, str]]:
    """Every line as (what, name, value): a field, the begin of a part, or text."""
    for row in map(str.strip, py_lines(content)):
        label, colon, value = row.partition(":")
        if colon and label in _FIELDS:
            yield "field", _FIELDS[label], value.strip()
        elif colon and label in _PARTS:
            yield "part", _PARTS[label], value.strip() if label == "Description" else ""
        else:
            yield "text", "", row


def ticket_text(content: str) -> dict:
    """Field lines, then the parts they open; text of a part that opens again replaces it, text beside listed comments is dropped."""
    records = list(_ticket_records(content))
    out: dict = dict.fromkeys(_TEXTS) | {"comments": []} | {name: value for what, name, value in records if what == "field"}
    begins = [i for i, (what, _, _) in enumerate(records) if what == "part"]
    parts = [("description", "", records[:begins[0]] if begins else records)]
    parts += [(records[a][1], records[a][2], records[a + 1:b]) for a, b in pairwise([*begins, len(records)])]
    for name, first, rows in parts:
        texts = [value for what, _, value in rows if what == "text"]
        listed = [t[2:] for t in texts if t.startswith("- ")] if name == "comments" else []
        out["comments"] += [{"author": None, "body": t} for t in listed]
        body = "\n".join([first, *(t for t in texts if not (listed and t.startswith("- ")))]).lstrip("\n")
        if body and name == "description":
            out["description"] = body
        elif body and not out["comments"]:
            out["comments"].append({"author": None, "body": body})
    if out["title"] is None and out["description"] is None and not out["comments"]:
        out["description"] = content
    return out


def ticket_header(ticket: dict) -> str:
    shown = (("title", "# {}"), ("key", "**Ticket**: {}"), ("status", "**Status**: {}"), ("priority", "**Priority**: {}"), ("assignee", "**Assignee**: {}"))
    return "\n".join(form.format(ticket[k]) for k, form in shown if ticket.get(k) is not None)


def ticketing(item: Item, config: ChunkConfig, count: TokenCounter) -> list[Piece]:
    ticket = (ticket_json(item.content) if "json" in item.content_type else None) or ticket_text(item.content)
    made: list[tuple[str, int | None, dict]] = []
    if ticket["description"] is not None:
        text = f"{ticket_header(ticket)}\n\n## Description\n\n{ticket['description']}"
        if count.count(text) <= config.chunk_size:
            made.append((text, None, {"meta_type": "description"}))
        else:
            parts = text.split(". ")
            weights = [count.count(p) for p in parts]
            made += [(". ".join(parts[a:b]), sum(weights[a:b]), {"meta_type": "description"}) for a, b in packed(weights, config.chunk_size)]
    comments = ticket["comments"]
    if comments:
        together = "## Comments\n\n" + "".join((f"**{c['author']}**:\n" if c["author"] is not None else "") + c["body"] + "\n\n---\n\n" for c in comments)
        if count.count(together) <= config.chunk_size:
            made.append((together, None, {"meta_type": "comments"}))
        else:
            made += [((f"**{c['author']}**: " if c["author"] is not None else "") + c["body"], None, {"meta_type": "comment", "author": c["author"]}) for c in comments]
    return _whole(made or [(item.content, None, {})], count)


# --- tables --------------------------------------------------------------------------------------------------------

def table_parts(content: str) -> tuple[str, str, list[str]] | None:
    """(kind, header with its line ends, rows), or none if the content is no table."""
    rows = py_lines(content)
    if rows and rows[0].strip().startswith("|"):
        piped = [r.strip().startswith("|") for r in rows]
        rule = next((i for i, r in enumerate(rows) if piped[i] and "-" in r.strip()), None)
        if len(rows) < 3 or rule is None:
            return None
        body = [r for r, p in zip(rows[rule + 1:], piped[rule + 1:]) if p]
        return ("table", f"{rows[piped.index(True)]}\n{rows[rule]}\n", body) if body else None
    return ("csv", rows[0] + "\n", rows[1:]) if len(rows) >= 2 else None


def table(item: Item, config: ChunkConfig, count: TokenCounter) -> list[Piece]:
    parts = table_parts(item.content)
    if not parts:
        return _whole([(item.content, None, {})], count)
    kind, header, rows = parts
    out, at = [], 0
    for i, (a, b) in enumerate(packed([count.count(r) for r in rows], max(0, config.chunk_size - count.count(header)))):
        body = "".join(r + "\n" for r in rows[a:b])
        out.append(Piece(header + body, count.count(header + body), at, at + size(header + body), i, {"meta_type": kind}))
        at += size(body)
    return out


# --- agentic -------------------------------------------------------------------------------------------------------

# What begins a line of each class, and how strong a boundary it is.
_CLASSES: tuple[tuple[str, float, re.Pattern], ...] = tuple((name, strength, re.compile(pattern)) for name, strength, pattern in (
    ("EmptyLine", 0.2, r"\Z"), ("Heading", 1.0, r"#+"), ("FunctionDef", 0.8, r"(?:pub )?(?:async )?fn "), ("ImplBlock", 0.85, r"(?:pub )?impl "),
    ("TypeDef", 0.9, r"(?:pub )?(?:struct|enum) "), ("ClassDef", 0.9, r"(?:class|interface) "), ("FunctionDef", 0.8, r"(?:async )?def "),
    ("ModuleDef", 0.95, r"(?:pub )?mod "), ("DocComment", 0.3, r"///|//!|/\*")))
_IMPORT = ("use ", "import ", "from ", "#include")


def boundary(row: str) -> tuple[str, float] | None:
    """Class and strength of a line, in single precision as the ties demand."""
    text = row.strip()
    for name, strength, pattern in _CLASSES:
        if m := pattern.match(text):
            level = np.float32(1.0) - np.float32(len(m[0])) * np.float32(0.1) if name == "Heading" else np.float32(strength)
            return name, float(level)
    return None


def nesting_depth(text: str) -> int:
    depth = deepest = 0
    for ch in re.findall(r"[{(\[\])}]", text):
        depth = depth + 1 if ch in "{([" else max(0, depth - 1)
        deepest = max(deepest, depth)
    return deepest


def analysed(text: str, count: TokenCounter) -> dict:
    rows = py_lines(text)
    return {
        "total_tokens": count.count(text), "total_lines": len(rows), "has_code_blocks": "```" in text or "    fn " in text,
        "has_headings": any(r.startswith("#") for r in rows), "has_imports": any(r.startswith(_IMPORT) for r in rows),
        "avg_line_length": sum(map(size, rows)) // len(rows) if rows else 0, "nesting_depth": nesting_depth(text),
        "boundaries": [(i, *b) for i, r in enumerate(rows) if (b := boundary(r))],
    }


def agentic(item: Item, config: ChunkConfig, count: TokenCounter) -> list[Piece]:
    """When the limit is reached the cut falls after the strongest boundary line since the last cut, the latest of equals.

    The count starts anew after each cut, without the lines that were carried over. Import lines of the first chunk are
    put before later ones that hold definitions. Offsets are clamped to the content.
    """
    data = item.content.encode("utf-8", "surrogatepass")
    rows = py_lines(item.content)
    spans: list[tuple[int, int]] = []
    if count.count(item.content) <= config.chunk_size:
        spans = [(0, len(data))]
    else:
        strengths = [b[1] if (b := boundary(r)) else float("-inf") for r in rows]
        ends = np.cumsum([size(r) + 1 for r in rows]).tolist()  # one byte a line end
        begin = since = held = 0
        for i, row in enumerate(rows):
            held += count.count(row)
            if held < config.chunk_size:
                continue
            best = max(range(since, i + 1), key=lambda k: (strengths[k], k))
            end = _char_end(data, ends[best])
            if end > begin:
                spans.append((begin, end))
            begin, since, held = max(begin, end), best + 1, 0
        if begin < len(data):
            spans.append((begin, len(data)))
    texts = [(data[a:b].decode("utf-8", "replace"), a, b) for a, b in spans]
    texts = [t for t in texts if t[0].strip()] if len(spans) > 1 or count.count(item.content) > config.chunk_size else texts
    imports = [r for r in py_lines(texts[0][0]) if r.strip().startswith(_IMPORT)] if len(texts) > 1 else []
    out = []
    for i, (text, a, b) in enumerate(texts):
        if i and imports and any(k in text for k in ("fn ", "def ", "class ")):
            text = "// Context:\n" + "\n".join(imports) + "\n\n" + text
        out.append(Piece(text, count.count(text), a, b, i, {"meta_type": "agentic", "path": item.path, "language": config.language}))
    return out


def _char_end(data: bytes, at: int) -> int:
    at = min(at, len(data))
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


STRATEGIES: dict[str, Strategy] = {
    "token": token, "sentence": sentence, "recursive": recursive, "code": code, "document": document, "chat": chat,
    "ticketing": ticketing, "table": table, "agentic": agentic,
}


def large_pieces(data: bytes, most: int) -> list[tuple[int, int]]:
    """Byte ranges of at most ``most``: up to the last blank line in reach, else the last line end, else a whole character."""
    out, at = [], 0
    while at < len(data):
        end = len(data)
        if end - at > most:
            reach = data[at:at + most]
            stop = next((k + len(s) for s in (b"\n\n", b"\n") if (k := reach.rfind(s)) >= 0), 0)
            end = at + stop if stop else max(_char_end(data, at + most), at)
            if end == at:  # one character is wider than the limit
                end = next((i for i in range(at + 1, len(data)) if data[i] & 0xC0 != 0x80), len(data))
        out.append((at, end))
        at = end
    return out


def _part_entities(entities: list[dict], first: int, last: int) -> list[dict]:
    """What of the entities lies in the lines ``first`` to ``last`` (from 1), with lines counted from the part's begin."""
    out = []
    for e in entities:
        a, b = e.get("start_line"), e.get("end_line")
        if a is not None and b is not None and max(a, first) <= min(b, last):
            out.append(e | {"start_line": max(a, first) - first + 1, "end_line": min(b, last) - first + 1})
    return out


def _parses(item: Item, name: str) -> bool:
    return name == "chat" and chat_json(item.content) is not None or name == "ticketing" and "json" in item.content_type and ticket_json(item.content) is not None


def chunked(item: Item, name: str, config: ChunkConfig, count: TokenCounter, most: int | None = None) -> list[Piece]:
    """The pieces of an item by the named strategy.

    With ``most`` (the batch stage) content above so many bytes is cut first; its parts are numbered on, line ranges count from
    the item's begin, and every part has the entities that lie in it. Threads and tickets in JSON are read whole, so that
    they stay what they are.
    """
    if not item.content:
        return []
    data = item.content.encode("utf-8", "surrogatepass")
    if most is None or len(data) <= most or _parses(item, name):
        return STRATEGIES[name](item, config, count)
    out: list[Piece] = []
    before = 0
    for a, b in large_pieces(data, most):
        part = data[a:b].decode("utf-8", "replace")
        own = _part_entities(item.entities, before + 1, before + max(1, len(py_lines(part))))
        for p in STRATEGIES[name](Item(part, item.content_type, item.path, item.language, own), config, count):
            lines = {"lines": (p.meta["lines"][0] + before, p.meta["lines"][1] + before)} if "lines" in p.meta else {}
            out.append(Piece(p.content, p.tokens, p.start + a, p.end + a, len(out), p.meta | lines))
        before += part.count("\n")
    return out
