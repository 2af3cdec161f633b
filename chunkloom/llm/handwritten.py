"""Generated, minified, vendored and data files, told from hand-written ones by a linear support-vector classifier.

Features are hashed character n-grams of the body, n-grams of the comments at both ends, and components and n-grams of
the path, each as relative frequencies, beside two numbers: the longest line and whether the same body stands in several
sources. Labelling functions (giveaway headers, directories, shapes of tool output) label a bounded sample; in training
every row stands twice with equal weight, once with its giveaway comments masked, so that the body and the path must carry
the decision where no header does. The threshold is set, and the accuracy measured, on repositories that training never saw.

The texts are read twice: once for the bodies' hashes, made in the JVM and aggregated map-side to (least, greatest) source,
with the texts of the sample, whose rows the hashes of the keys alone have chosen; and once for the scores, in a narrow pass.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkloom.operators.skew import with_facts
from chunkloom.storage import cut

#: At most so many rows are labelled and collected for training; about a fifth of the repositories validate.
SAMPLE_ROWS = 5_000
#: Longer texts are scored, but not collected for training.
SAMPLE_BYTES = 50_000
#: Bodies of fewer characters (without comments and blanks) are equal by chance in many sources; they are told by their features only.
LEAST_BODY = 120
BODY, EDGE, PATH = 1 << 12, 1 << 11, 1 << 11
SHAPE = 7
SIZE = BODY + EDGE + PATH + SHAPE
BALANCE, EDGE_SCALE, EDGE_GRAMS = 1.0, 120.0, (5, 9)

_COMMENT = re.compile(r"\s*(?://|#(?!include|!|define|if|end|pragma)|/?\*|--(?!\w)|<!--|<meta\b|;|\"\"\"|<\?php)")
_BLOCK_OPEN = re.compile(r"\s*(/\*|<!--|\"\"\"|''\')")
_BLOCK_CLOSE = {"/*": "*/", "<!--": "-->", '"""': '"""', "''\'": "''\'"}
BODY_NOISE = r"(?m)^\s*(?://|#(?!include|!)|\*|/\*|--|<!--).*$|\s+"
# Directories of copied and of built code, and what tools write about themselves.
_COPIED_DIR = re.compile(r"(?:^|/)(?:vendor|vendored|node_modules|Pods|Godeps|deps|third[_-]?party|external|externals|bower_components|site-packages|Carthage|jspm_packages)/[^/]+/")
_COPIED_HEAD = re.compile(
    r"(?im)^\W*(?:vendored from|copied (?:verbatim )?from|@license \w|\w+ v?\d+\.\d+\.\d+ - https?://|\(c\) \d{4} the \w+ (?:contributors|authors|developers)|copyright (?:\(c\) )?\d{4} (?!the )\w+ (?:authors|contributors)|"
    r"this file is part of \w+, version|distributed by the \w+ (?:developers|authors|contributors))")
_MADE_HEAD = re.compile(
    r"(?im)^\W*(?:code generated (?:by|from)|@generated|auto-?generated|<auto-generated|this (?:file|code) (?:was|is) (?:auto\w*|generated|machine)|generated (?:on \d|by \w+[\- ](?:codegen|idl|gen)|by the protocol|from schema)|"
    r"autogenerated|(?:do not|don't) (?:edit|modify)(?: this file)?\W*$|do not modify this file by hand; re|(?:note: )?this \w+ (?:is|was|were) auto\S* generated|automatisch erzeugt|fichier généré|generado autom|"
    r"this output was created by|自動生成|自动生成|создано автоматически|meta name=.generator|machine.generated|a bison parser|generated automatically by)")
_MADE_NAME = re.compile(r"(?:\.pb\.go|_pb2(?:_grpc)?\.py|\.g\.cs|\.designer\.cs|\.generated\.\w+|[._]gen\.\w+|\.tab\.[ch]|-lock\.json|/?\w*\.lock|\.min\.(?:js|css)|\.bundle\.(?:js|css)|\.[0-9a-f]{8}\.(?:js|css)|allclasses\.html)$", re.I)
_DATA_LINE = re.compile(r"\s*(?:INSERT INTO \w+ VALUES \(\d|\{?\"id\": \d+|\[?[\d.\-]+(?:,\s*[\d.\-]+){5,}|['\"][A-Za-z0-9+/=]{60,}['\"]|\(?0x[0-9a-f]{2}, ?0x)", re.I)
_NUMBERED = re.compile(r"\b_*[A-Za-z][A-Za-z_]*?_?(\d{1,3})\b(?!['\"])")
_SETTINGS = re.compile(r"\.(?:json|ya?ml|toml|ini|env|properties|xml|tf|cfg|conf)$|(?:^|/)(?:\.env[\w.]*|\.npmrc|\.netrc|Dockerfile|pip\.conf)$", re.I)


#: A line of a source file that holds nothing but a literal, with or without a key, and brackets: data.
_LITERAL_LINE = re.compile(r"""\s*+[\[\](){},;]*+\s*+(?:["']?[\w\-. ]++["']?\s*+(?::|=>)\s*+)?+[\[\](){}]*+(?:-?\d[\w.+\-]*+|"[^"\n]*+"|'[^'\n]*+'|true|false|null|None|True|False)?+\s*+[\[\](){},;]*+\s*+$""")
_OPENING = re.compile(r"\s*(?:<\?php|#!.*|package [\w.]+;?|['\"]use strict['\"];?)?\s*$")


def edges(text: str) -> tuple[str, str]:
    """(comments at both ends, the rest): what a giveaway header would stand in, and the body.

    The ends reach as far as lines are blank, comments or what may open a file; of a line that a block comment begins
    and something else follows, only the comment counts.
    """
    lines = text.split("\n")
    first, last, block = 0, len(lines), ""
    head: list[str] = []
    while first < last:
        line = lines[first]
        if block:
            before, found, after = line.partition(block)
            head.append(before + found)
            if found:
                block = ""
                if after.strip():
                    lines[first] = after
                    break
        elif m := _BLOCK_OPEN.match(line):
            block = _BLOCK_CLOSE[m[1]]
            before, found, after = line[m.end():].partition(block)
            head.append(m[0] + before + found)
            if found:
                block = ""
                if after.strip():
                    lines[first] = after
                    break
        elif _COMMENT.match(line):
            head.append(line)
        elif not _OPENING.match(line):
            break
        first += 1
    tail: list[str] = []
    while last > first and (not lines[last - 1].strip() or _COMMENT.match(lines[last - 1])):
        last -= 1
        tail.append(lines[last])
    return "\n".join(head + tail[::-1]), "\n".join(lines[first:last])


def label(path: str | None, text: str, copied: bool) -> int:
    """1 for what the labelling functions take for made, packed, copied or data; else 0."""
    path = (path or "").strip()
    head, body = edges(text)
    if copied or _COPIED_DIR.search(path) or _COPIED_HEAD.search(head) or _MADE_HEAD.search(head) or _MADE_NAME.search(path):
        return 1
    lines = [x for x in body.split("\n") if x.strip()]
    if not lines:
        return 0
    longest = max(map(len, lines))
    mean = sum(map(len, lines)) / len(lines)
    if mean > 150 and longest > 250:
        return 1
    if len(body) > 500 and (body.count(" ") + len(lines)) < 0.06 * len(body) and mean > 50 and not _SETTINGS.search(path):
        return 1
    numbers = [int(x) for x in _NUMBERED.findall(body)]
    if len(numbers) >= 14 and set(range(1, 6)) <= set(numbers) and len(numbers) > 0.5 * len(lines):
        return 1
    if _SETTINGS.search(path):
        return 0
    data = sum(bool(_DATA_LINE.match(x)) for x in lines)
    literal = sum(bool(_LITERAL_LINE.match(x)) for x in lines)
    return int(max(data, literal) >= 12 and max(data, literal) > 0.8 * len(lines))


def _hashes(data: np.ndarray, n: int, size: int) -> np.ndarray:
    """Buckets of the n-grams that begin at each place."""
    h = np.zeros(len(data) - n + 1, np.uint32)
    for k in range(n):
        h = (h ^ data[k:len(data) - n + 1 + k]) * np.uint32(0x01000193 + 2 * n)
    h ^= h >> np.uint32(15)
    return (h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - (size - 1).bit_length())


_DIGITS = bytes.maketrans(b"0123456789", b"0" * 10)


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "replace").translate(_DIGITS), np.uint8).astype(np.uint32)


def _path_text(path: str | None) -> str:
    parts = (path or "").strip().lstrip("./").split("/")
    return "^" + "/".join(parts) + "$"


def _path_buckets(path: str | None) -> np.ndarray:
    parts = _path_text(path)[1:-1].split("/")
    tokens = [f"d:{p}" for p in parts[:-1]] + [f"e:{parts[-1].partition('.')[2]}", f"s:{bool(re.search('[_0-9]', parts[-1].partition('.')[0]))}"]
    named = [np.uint32(np.bitwise_and(_fnv(t), PATH - 1)) for t in tokens]
    grams = _hashes(_bytes(_path_text(path)), 4, PATH) if len(_path_text(path)) >= 4 else np.empty(0, np.uint32)
    return np.concatenate([np.repeat(np.array(named, np.uint32), 4), grams])


def _fnv(token: str) -> int:
    h = 0x811C9DC5
    for b in token.encode():
        h = ((h ^ b) * 0x01000193) & 0xFFFFFFFF
    return h ^ (h >> 13)


_NO_RUN = np.ones(256, bool)
_NO_RUN[[*range(48, 58), *range(65, 91), *range(97, 123), 43, 47, 61]] = False
_MARKS = np.zeros(256, bool)
_MARKS[[ord(c) for c in "\"'[]{}:,"]] = True


def _shape(body: str, data: np.ndarray, copied: bool) -> list[float]:
    """The longest and the mean line, the shares of long unbroken runs, of marks of data and of digits, the copied flag, and 1."""
    lines = body.split("\n")
    longest = max(map(len, lines))
    n = max(1, len(data))
    runs = np.diff(np.concatenate([[-1], np.flatnonzero(_NO_RUN[data]), [len(data)]])) - 1
    return [min(3.0, np.log10(1 + longest) - 2), min(3.0, np.log10(1 + len(body) / max(1, len(lines))) - 1.5), 3.0 * float(runs[runs >= 60].sum()) / n,
            3.0 * float(_MARKS[data].sum()) / n, 3.0 * float((data == 48).sum()) / n, float(copied), 1.0]


def vector(path: str | None, head: str, body: str, copied: bool) -> np.ndarray:
    x = np.zeros(SIZE, np.float32)
    data = _bytes(body)
    for n in (3, 5):
        if len(data) >= n:
            x[:BODY] += np.bincount(_hashes(data, n, BODY), minlength=BODY) * (10.0 / len(data))
    edge = _bytes(head)
    for n in EDGE_GRAMS:
        if len(edge) >= n:
            x[BODY:BODY + EDGE] += np.bincount(_hashes(edge, n, EDGE), minlength=EDGE) * (EDGE_SCALE / len(edge))
    buckets = _path_buckets(path)
    if len(buckets):
        x[BODY + EDGE:BODY + EDGE + PATH] = np.bincount(buckets, minlength=PATH) * (10.0 / len(buckets))
    x[-SHAPE:] = _shape(body, data, copied)
    return x


@dataclass
class Model:
    weights: np.ndarray
    threshold: float
    validation: dict[str, float]

    def margin(self, path: str | None, text: str) -> float:
        """The score without the part of the copied flag."""
        head, body = edges(text)
        w, total = self.weights, 0.0
        data = _bytes(body)
        for n in (3, 5):
            if len(data) >= n:
                total += float(w[:BODY][_hashes(data, n, BODY)].sum()) * 10.0 / len(data)
        edge = _bytes(head)
        for n in EDGE_GRAMS:
            if len(edge) >= n:
                total += float(w[BODY:BODY + EDGE][_hashes(edge, n, EDGE)].sum()) * EDGE_SCALE / len(edge)
        buckets = _path_buckets(path)
        if len(buckets):
            total += float(w[BODY + EDGE:BODY + EDGE + PATH][buckets].sum()) * 10.0 / len(buckets)
        return total + float(np.dot(w[-SHAPE:], _shape(body, data, False)))


def fit(x: np.ndarray, y: np.ndarray, parts: np.ndarray, cost: float = 60.0, rounds: int = 250) -> np.ndarray:
    """A linear classifier with squared hinge loss, by accelerated gradient descent; the rarer class weighs ``BALANCE`` of an equal share.

    Every row counts twice, the second time without its comments' features; this twin shares the row's memory.
    """
    sign = np.where(y > 0, 1.0, -1.0).astype(np.float32)
    rare = max(1.0, BALANCE * (y <= 0).sum() / max(1, (y > 0).sum()))
    weight = np.where(y > 0, rare, 1.0).astype(np.float32) * parts * np.float32(cost / (2 * len(y)))
    edge = slice(BODY, BODY + EDGE)

    def scores(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        full = x @ w
        return full, full - x[:, edge] @ w[edge]

    def back(full: np.ndarray, masked: np.ndarray) -> np.ndarray:
        out = x.T @ (full + masked)
        out[edge] -= x[:, edge].T @ masked
        return out

    v = np.ones(x.shape[1], np.float32)
    for _ in range(8):
        a, b = scores(v)
        v = back(weight * a, weight * b)
        v /= max(1e-12, float(np.linalg.norm(v)))
    a, b = scores(v)
    rate = 1.0 / (1.0 + 2.2 * float(np.linalg.norm(back(weight * a, weight * b))))
    w = z = np.zeros(x.shape[1], np.float32)
    t = 1.0
    for _ in range(rounds):
        a, b = scores(z)
        new = z - rate * (z - 2 * back(weight * sign * np.maximum(0, 1 - sign * a), weight * sign * np.maximum(0, 1 - sign * b)))
        grown = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z, w, t = new + (t - 1) / grown * (new - w), new, grown
    return w


def train(rows: list[tuple[str | None, str | None, str, bool]]) -> Model:
    """From (repository, path, text, copied): labels, masks, splits by repository, fits, and sets the threshold.

    Where either side of the split lacks a class there is no validation: all rows train and the threshold is 0.
    """
    x = np.zeros((len(rows), SIZE), np.float32)  # the largest thing in the driver: SAMPLE_ROWS * SIZE * 4 bytes
    y, test = np.zeros(len(x), np.int8), np.zeros(len(x), bool)
    for i, (repo, path, text, copied) in enumerate(rows):
        head, body = edges(text)
        x[i] = vector(path, head, body, copied)
        y[i] = label(path, text, copied)
        test[i] = _fnv(repo or "") % 5 == 0
    if len(set(y)) < 2:
        return Model(np.zeros(SIZE, np.float32), -1.0 if len(y) and y[0] else 0.0, {})
    if len(set(y[~test])) < 2 or len(set(y[test])) < 2:
        return Model(fit(x, y, np.ones(len(y), np.float32)), 0.0, {})
    w = fit(x, y, np.where(test, 0, 1).astype(np.float32))
    edge = slice(BODY, BODY + EDGE)
    scores = x[test] @ w
    truth = y[test] > 0
    options = np.linspace(-0.1, 0.1, 5)  # near the margin's middle only: few validation rows lie beside it
    correct = [(round(((scores > o) == truth).mean(), 3), -abs(o), o) for o in options]
    threshold = float(max(correct)[2])
    masked = scores - x[test][:, edge] @ w[edge] > threshold
    return Model(w, threshold, {"rows": int(test.sum()), "accuracy": float(((scores > threshold) == truth).mean()), "masked_accuracy": float((masked == truth).mean())})


def _bodies(files: DataFrame, key: str, text: str, source: str, path: str, repository: Column, limit: int) -> DataFrame:
    """(k, s, body, repo, path, text) of every row: the body's hash where it is long enough; path and text of the sample only.

    The sample are the rows of the least ``limit`` hashes of the keys, which is found from the keys alone.
    """
    draw = F.xxhash64(F.col(f"`{key}`"))
    least = files.select(draw.alias("h")).orderBy("h").limit(limit).agg(F.max("h")).first()[0]
    bare = F.regexp_replace(F.col(f"`{text}`"), BODY_NOISE, "")
    body = F.when(F.length(bare) >= LEAST_BODY, F.xxhash64(bare))
    drawn = (draw <= F.lit(least)) & F.octet_length(F.col(f"`{text}`")).between(1, SAMPLE_BYTES)
    return cut(files.select(F.col(f"`{key}`").alias("k"), F.col(f"`{source}`").alias("s"), body.alias("body"), F.when(drawn, repository).alias("repo"),
                            F.when(drawn, F.col(f"`{path}`")).alias("path"), F.when(drawn, F.col(f"`{text}`")).alias("text")))


def _copied(bodies: DataFrame) -> DataFrame:
    """(k, copied) of rows whose body stands in more than one source."""
    known = bodies.filter("body IS NOT NULL").select("k", "s", "body")
    several = cut(known.groupBy("body").agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("a"), F.max("s").alias("b")).filter("a <> b").select("body", "n"))
    return cut(with_facts(known, several, "body", "n").select("k").distinct().withColumn("copied", F.lit(True)))


def sample(bodies: DataFrame, flags: DataFrame, limit: int = SAMPLE_ROWS) -> list[tuple]:
    """(repository, path, text, copied) of the rows drawn for training, the same for the same table."""
    chosen = bodies.filter("text IS NOT NULL").select("k", "repo", "path", "text")
    rows = chosen.join(flags, "k", "left").select("k", "repo", "path", "text", F.coalesce("copied", F.lit(False)).alias("copied")).limit(limit).collect()
    return [(r.repo, r.path, r.text, r.copied) for r in sorted(rows, key=lambda r: r.k)]


def not_handwritten(files: DataFrame, key: str = "delivery_id", text: str = "normalized_content", path: str = "file_path", source: str = "source_id",
                    repository: Column | None = None, model: Model | None = None) -> DataFrame:
    """(key, margin) of the rows that the classifier takes for no hand-written file. Null and empty texts are never among them.

    ``repository`` is the column by which validation is split (the source, if none is given). Null paths count as empty,
    repeated rows each give one, other columns are ignored, an empty table gives an empty one.
    """
    bodies = _bodies(files, key, text, source, path, F.col(f"`{source}`") if repository is None else repository, SAMPLE_ROWS if model is None else 0)
    flags = _copied(bodies)
    if model is None:
        model = train(sample(bodies, flags))
    shipped = files.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        for batch in batches:
            margins = [own.margin(p, t) for p, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(margins, pa.float64())], ["k", "margin"])

    rows = files.select(F.col(f"`{key}`").alias("k"), F.col(f"`{path}`").alias("p"), F.col(f"`{text}`").alias("t")).filter(F.length("t") > 0)
    scored = rows.mapInArrow(run, f"k {rows.dtypes[0][1]}, margin double")
    total = F.col("margin") + F.when(F.col("copied"), float(model.weights[-2])).otherwise(0.0)
    return scored.join(flags, "k", "left").select(F.col("k").alias(key), (total - model.threshold).alias("margin")).filter("margin > 0")
