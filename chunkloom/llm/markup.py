"""Markup turned to clean text that keeps headings, lists, code blocks, tables and formulas.

Constructs of HTML (escaped too), Markdown, wiki languages and LaTeX are found by what the text holds, whatever its
declared type; JSON is opened and its string values are looked at. Markup is stripped to a plain outline (``#`` headings,
``-`` items, fenced code, ``$$`` formulas), then the lines' text lengths are summed over sliding windows: the main text
begins where the sum surges and ends where it dives, and what lies between is kept. All is narrow, one pass.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The elements of HTML, as names; others in angle brackets are no markup.
_TAGS = ("a|abbr|address|article|aside|audio|b|base|blockquote|body|br|button|canvas|caption|center|cite|code|col|colgroup|dd|del|details|dfn|div|dl|dt|em|"
         "embed|fieldset|figcaption|figure|font|footer|form|h[1-6]|head|header|hr|html|i|iframe|img|input|ins|kbd|label|legend|li|link|main|mark|meta|nav|"
         "noscript|object|ol|option|p|param|picture|pre|q|s|samp|script|section|select|small|source|span|strike|strong|style|sub|summary|sup|svg|table|tbody|td|"
         "textarea|tfoot|th|thead|time|title|tr|tt|u|ul|var|video|ref|nowiki|math|syntaxhighlight|gallery|includeonly|noinclude|onlyinclude")
_ATTRIBUTES = r"(?:\s+[a-z_:][\w:.\-]*(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'<>]+))?)+"
#: A bare opening tag right after a word is a type's parameter, unless the element is one that stands in the flow.
_TAG = re.compile(rf"</(?:{_TAGS})\s*>|<(?:{_TAGS}){_ATTRIBUTES}\s*/?>|(?:(?<![A-Za-z0-9_])|(?=<(?:br|hr|p|li|b|i|u|em|sub|sup|ref|img)\b))<(?:{_TAGS})\s*/?>|<!doctype\s[^>]*>", re.I)
_ENTITY = re.compile(r"&(?:#\d{2,6}|#x[0-9a-f]{2,5}|(?:lt|gt|amp|quot|apos|nbsp|ndash|mdash|hellip|copy|reg|trade|euro|times|laquo|raquo|[lr][sd]quo|bull|middot|deg|[aeiouAEIOU](?:uml|acute|grave|circ)|szlig|ntilde|ccedil));", re.I)

#: (kind, characters one of which must be there, pattern)
_RULES: list[tuple[str, tuple[str, ...], re.Pattern]] = [(kind, tuple(need.split()), re.compile(pattern, flags)) for kind, need, pattern, flags in (
    ("html", "<", _TAG.pattern, re.I | re.S),
    ("html", "&", _ENTITY.pattern, re.I),
    ("markdown", "#", r"(?:\A|\n[^\S\n]*\n)#{1,6}[^\S\n]+\S[^\n]*(?=\r?\n[^\S\n]*\r?\n|\r?\n?\Z|\r?\n#{1,6} )", 0),
    ("markdown", "#", r"\A#{1,6} [^\n]{20,}\Z", 0),
    ("markdown", "##", r"(?:^|\s)#{2,6} (?=[^\W\d_])[^\n#]", 0),
    ("markdown", "=== ---", r"^(?=[^\n|]*\w)[^\n|]+\n(?:={3,}|-{3,})[^\S\n]*\r?$", re.M),
    ("markdown", "``` ~~~", r"^\s{0,3}(?:```|~~~)|```\w*\s", re.M),
    ("markdown", "`", r"(?<![`\\])`[^`\n]*[^`\s\n][^`\n]*`(?!`)", 0),
    ("markdown", "**", r"(?<![*\w\\])\*\*(?=[^\s*])[^*\n]*?[^\s*\\]\*\*(?!\*)", 0),
    ("markdown", "__", r"(?<![\w_\\])__(?=[^\W_])[^_\n]*?(?:_[^_\n]+)*?[^\s_]__(?![\w_])", 0),
    ("markdown", "*", r"(?<![*\w\\/.()=+])\*(?=[^\s*/+.)])[^*\n=]*[^\s*\\(\n=]\*(?![*\w])", 0),
    ("markdown", "_", r"(?<![\w_\\/`'\"{(\[=.])_(?=[^\W_])[^_\n]*?\s[^_\n]*?[^\s_]_(?![\w_])", 0),
    ("markdown", "~~", r"~~(?=\S)[^~\n]+?~~", 0),
    ("markdown", "](", r"!?\[[^\[\]\n]*\]\((?:https?:|mailto:|[./#]|[\w\-%]+[./#])[^\s()]*(?: \"[^\"]*\")?\)", 0),
    ("markdown", "]: ][", r"^\s{0,3}\[[^\]\n]+\]:\s+\S+|\[[^\[\]\n]+\]\[[^\[\]\n]+\]", re.M),
    ("markdown", "--- :--", r"\|?[^\S\n]*:?-{3,}:?\s*\|(?:\s*:?-{3,}:?\s*\|?)+", re.M),
    ("markdown", "[", r"^\s*[-*+] \[[ xX]\] ", re.M),
    ("markdown", ">", r"(?:\A|\n[^\S\n]*\n)(?:>[^\S\n]*[-*#>`|]|>\s*\*\*)", 0),
    ("wiki", "==", r"^={2,6}[^\S\n]*[^=\s][^=\n]*={2,6}[^\S\n]*\r?$|(?:^|\s)={2,6} [^=\n]++(?<=[^=\n] )={2,6}(?=\s|$)", re.M),
    ("wiki", "''", r"'{2,5}(?=[^'\s])[^'\n]+(?:'[^'\n]+)*?'{2,5}", 0),
    ("wiki", "[[", r"\[\[(?=[^\[\]\s])[^\[\]\n]+\]\]|\[\[(?:File|Image|Datei|Category):", 0),
    ("wiki", "{{", r"\{\{(?=[^{}\s])[^{}]+\}\}", 0),
    ("wiki", "{|", r"^\s*\{\|.*$|\{\| ?class=", re.M),
    ("wiki", "[http", r"\[https?://[^\s\]]+(?: [^\]\n]*)?\](?!\()", 0),
    ("wiki", "|http", r"\[[^\[\]|\n]+\|(?:https?|mailto|ftp)[^\s\]]+\]", 0),
    ("wiki", "h1. h2. h3. h4. h5. h6.", r"(?<![^\s])h[1-6]\. (?=[^\W\d_])", re.M),
    ("wiki", "{", r"\{(?:code|noformat|quote|panel|info|note|warning|tip|toc|anchor|color|expand|section|column|include|excerpt|status|jira)(?::[^{}\n]*)?\}", re.I),
    ("wiki", "||", r"^\s*\|\|[^|\n]+\|\||(?:\A|\s)\|\|[^|\n]++\|\|[^|\n]++\|\|", re.M),
    ("wiki", "|", r"^\|[^|\n]+\|[^|\n]+\|[^\n]*\r?\n\|[^|\n]+\|[^|\n]+\|", re.M),
    ("wiki", "* #", r"^(?:[*#]{2,}|[*#][:*#]+) \S", re.M),
    ("wiki", "bq.", r"^bq\. \S", re.M),
    ("wiki", "#REDIRECT __", r"^#REDIRECT\b|__(?:NO)?TOC__|__NOEDITSECTION__", re.M),
    ("latex", "\\", r"\\(?:begin|end)\{[a-zA-Z]+\*?\}|\\(?:documentclass|usepackage|(?:sub)*section|paragraph|chapter|part|title|author|caption|label|ref|eqref|cite[a-z]*|footnote|textbf|textit|texttt|emph|underline|frac|sqrt|mathbf|mathrm|mathcal|href|url|includegraphics|text)\*?(?:\[[^\]\n]*\])?\{", 0),
    ("latex", "\\", r"\\(?:alpha|beta|gamma|delta|epsilon|lambda|mu|pi|rho|sigma|tau|phi|psi|omega|theta|sum|int|prod|infty|partial|nabla|cdot|times|leq|geq|neq|approx|rightarrow|leftarrow|item|maketitle|hline|ldots|left|right|quad|limits)(?![A-Za-z\\])(?=[\s_^{}$()+\-=,.\[]|$)", 0),
    ("latex", "\\", r"\\\((?!\\\))[^\n\\]*+(?:\\(?![()])[^\n\\]*+)*+\\\)|\\\[[^\n\\]*+(?:\\(?![\[\]])[^\n\\]*+)*+\\\]", 0),
    ("latex", "$$", r"\$\$(?=[^\s$]|\s*\S)[^$]+\$\$", 0),
    ("latex", "$", r"(?<![\w$\\])\$(?=[^\s$\d])(?=[^$\n]*[\\^_{])[^$\n]+\$(?![\w$])", 0),
)]
_RULES[0] = ("html", ("<",), _TAG)
_ESCAPED = re.compile(rf"&(?:amp;)?lt;/?(?:{_TAGS})\b[^&\n]*(?:&(?!(?:amp;)?[lg]t;)[^&\n]*)*&(?:amp;)?gt;", re.I)
WINDOW, SURGE = 3, 24


def _strings(value: object, out: list[str]) -> None:
    if isinstance(value, str):
        out.append(value)
    elif isinstance(value, list):
        for x in value:
            _strings(x, out)
    elif isinstance(value, dict):
        for x in value.values():
            _strings(x, out)


def opened(text: str) -> list[str]:
    """The text itself, or the string values of JSON."""
    start = text.lstrip()[:1]
    if start and start in "{[":
        try:
            out: list[str] = []
            _strings(json.loads(text), out)
            return out
        except (ValueError, RecursionError):
            pass
    return [text]


def constructs(text: str | None) -> set[str]:
    """The kinds of markup that the text has at least one construct of."""
    found: set[str] = set()
    for part in opened(text) if text else []:
        if 0 <= part.find("<!--") < part.rfind("-->"):
            found.add("html")
        for kind, need, pattern in _RULES:
            if kind not in found and any(x in part for x in need) and pattern.search(part):
                found.add(kind)
    return found


_BLOCKS = re.compile(r"(?:</?(?:p|div|section|article|main|header|footer|tr|table|ul|ol|dl|dd|dt|blockquote|form|figure|figcaption|body|html|title|thead|tbody)\b[^>]*>[^\S\n]*\n?[^\S\n]*)+", re.I)
#: What only whole pages have: their parts, beside the text, are what the line blocks leave out.
_PAGE = re.compile(r"<(?:html|body|main|article|nav|header|footer|aside|div)\b", re.I)
#: Elements of a page whose words weigh as little as those of links.
_ASIDE = ("footer", "aside", "form", "button", "select")
LINK, LINK_END = "\x04", "\x05"
_MARKS = re.compile(f"[{LINK}{LINK_END}]")
_DROPPED = ("script", "style", "head", "nav", "noscript", "svg", "iframe", "object", "template")


def _pairs(opener: str, closer: str, made: Callable[[re.Match], str] | str, text: str) -> str:
    """Replaces ``opener`` group 1 ``closer``. Only the text up to the last closer is looked at, where every opener finds one, so the time is linear."""
    last = None
    for last in re.finditer(closer, text, re.I):
        pass
    if last is None:
        return text
    return re.sub(f"{opener}(.*?){closer}", made, text[:last.end()], flags=re.S | re.I) + text[last.end():]


_FENCE = re.compile(r"^[^\S\n]*(```|~~~)[^\n]*\n(.*?)^[^\S\n]*\1[^\S\n]*$", re.S | re.M)


class _Kept:
    """Code and formulas, set aside while markup around them is stripped."""

    def __init__(self) -> None:
        self.parts: list[str] = []

    def hold(self, text: str) -> str:
        self.parts.append(text)
        return f"\x02{len(self.parts) - 1}\x03"

    def code(self, body: str) -> str:
        body = body.replace("\r\n", "\n").strip("\n")
        return "\n" + self.hold(f"```\n{body}\n```") + "\n"

    def back(self, text: str) -> str:
        while "\x02" in text:
            new = re.sub("\x02(\\d+)\x03", lambda m: self.parts[int(m[1])] if int(m[1]) < len(self.parts) else "", text)
            if new == text:
                break
            text = new
        return text


def _html(text: str, kept: _Kept) -> str:
    text = _pairs("<!--", "-->", "\n", text)
    for tag in _DROPPED:
        if f"<{tag}" in text.lower():
            text = _pairs(rf"<{tag}\b[^>]*>", rf"</{tag}\s*>", "\n", text)
    for tag in ("pre", "syntaxhighlight", "source"):
        text = _pairs(rf"<{tag}\b[^>]*>", rf"</{tag}\s*>", lambda m: kept.code(html.unescape(_TAG.sub("", m[1]))), text)
    text = _pairs(r"<math\b[^>]*>", r"</math\s*>", lambda m: kept.hold(f"$${html.unescape(m[1]).strip()}$$"), text)
    text = _pairs(r"<ref\b[^>/]*>", r"</ref\s*>", "", re.sub(r"<ref\b[^>]*/>", "", text, flags=re.I))
    for level in "123456":
        text = _pairs(rf"<h{level}\b[^>]*>", rf"</h{level}\s*>", lambda m, n=int(level): f"\n{'#' * n} {' '.join(_TAG.sub('', m[1]).split())}\n", text)
    text = re.sub(r"<li\b[^>]*>\s*", "\n- ", text, flags=re.I)
    text = re.sub(r"</t[dh]\s*>\s*<t[dh]\b[^>]*>", "\t", text, flags=re.I)
    text = re.sub(r"<(?:br|hr)\b[^>]*>", "\n", text, flags=re.I)
    if _PAGE.search(text):  # the words of links are told apart from those of the text, for the line blocks
        text = re.sub(r"<a\b[^>]*>", LINK, re.sub(r"</a\s*>", LINK_END, text, flags=re.I), flags=re.I)
        for tag in _ASIDE:
            text = _pairs(rf"<{tag}\b[^>]*>", rf"</{tag}\s*>", lambda m: f"\n{LINK}{_MARKS.sub('', m[1])}{LINK_END}\n", text)
    text = _BLOCKS.sub("\n", text)
    return html.unescape(_TAG.sub("", text))


def _latex(text: str, kept: _Kept) -> str:
    text = re.sub(r"(?<!\\)%[^\n]*", "", text) if r"\begin{document}" in text else text
    for name in ("verbatim", "lstlisting", "minted"):
        text = _pairs(rf"\\begin\{{{name}\}}(?:\[[^\]\n]*\])?", rf"\\end\{{{name}\}}", lambda m: kept.code(m[1]), text)
    for name in ("equation", "align", "gather", "displaymath", "math", "eqnarray"):
        text = _pairs(rf"\\begin\{{{name}\*?\}}", rf"\\end\{{{name}\*?\}}", lambda m: "\n" + kept.hold(f"$${m[1].strip()}$$") + "\n", text)
    text = _pairs(r"\\\[", r"\\\]", lambda m: kept.hold(f"$${m[1].strip()}$$"), text)
    text = _pairs(r"\\\(", r"\\\)", lambda m: kept.hold(f"${m[1].strip()}$"), text)
    text = re.sub(r"\\(?:documentclass|usepackage|label|cite[a-z]*|ref|eqref|includegraphics|bibliography\w*)\*?(?:\[[^\]]*\])?\{[^{}]*\}|\\(?:maketitle|hline|noindent|centering|tableofcontents)\b", "", text)
    levels = {"title": 1, "chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4}
    text = re.sub(r"\\(title|chapter|(?:sub)*section|paragraph)\*?\{([^{}]*)\}", lambda m: f"\n{'#' * levels.get(m[1], 3)} {m[2].strip()}\n", text)
    text = re.sub(r"\\begin\{(?:tabular|array)\}\{[^{}]*\}(.*?)\\end\{(?:tabular|array)\}",
                  lambda m: "\n" + re.sub(r"\s*\\\\\s*", "\n", re.sub(r"\s*(?<!\\)&\s*", "\t", m[1])).strip() + "\n", text, flags=re.S)
    text = re.sub(r"\\(?:begin|end)\{[^{}]*\}(?:\[[^\]]*\])?", "\n", text)
    text = re.sub(r"\s*\\item\b(?:\[[^\]]*\])?\s*", "\n- ", text)
    for _ in range(3):
        text = re.sub(r"\\(?:textbf|textit|texttt|emph|underline|text|footnote|caption|author|mbox)\*?\{([^{}]*)\}", r"\1", text)
    return re.sub(r"\\([&%$#_{}])", r"\1", re.sub(r"(?<=\w)~(?=[\w\\])", " ", text))


def _wiki(text: str, kept: _Kept) -> str:
    for name in ("code", "noformat"):
        text = _pairs(rf"\{{{name}(?::[^{{}}]*)?\}}", rf"\{{{name}\}}", lambda m: kept.code(m[1]) if "\n" in m[1] else m[1], text)
    text = re.sub(r"\{(?:quote|panel|info|note|warning|tip|toc|anchor|color|expand|section|column|include|excerpt|status|jira)(?::[^{}\n]*)?\}", "", text, flags=re.I)
    if re.search(r"^(?:={2,6}[^=\n]+={2,6}\s*$|h[1-6]\. )", text, re.M):
        text = re.sub(r"^#+ ", "1. ", re.sub(r"^\*+ ", "- ", text, flags=re.M), flags=re.M)
    text = re.sub(r"^(={2,6})[^\S\n]*([^=\n]+?)[^\S\n]*={2,6}[^\S\n]*$", lambda m: f"{'#' * (len(m[1]) - 1)} {m[2]}", text, flags=re.M)
    text = re.sub(r"^h([1-6])\. ", lambda m: "#" * int(m[1]) + " ", text, flags=re.M)
    text = re.sub(r"^[^\S\n]*(?:\{\||\|\}|\|-(?!-)|\|\+)[^\n]*(?:\n|\Z)", "", text, flags=re.M)
    text = re.sub(r"^[|!](?!\|)[^\n]*(?:\|\||!!)[^\n]*$", lambda m: re.sub(r"\s*(?:\|\||!!)\s*", "\t", m[0][1:].strip()), text, flags=re.M)
    text = re.sub(r"^\|\|([^\n]+?)\|\|\s*$", lambda m: re.sub(r"\s*\|\|\s*", "\t", m[1]), text, flags=re.M)
    for _ in range(2):
        text = re.sub(r"\[\[(?:File|Image|Datei|Category|Kategorie):[^\[\]]*?(?:\|([^\[\]|]*))?\]\]", lambda m: m[1] or "", text)
        text = re.sub(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]+)\]\]", r"\1", text)
    text = re.sub(r"\{\{([^{}]*)\}\}", lambda m: m[1].rsplit("|", 1)[-1].rsplit("=", 1)[-1], text)
    text = re.sub(r"\[([^\[\]|\n]+)\|(?:https?|mailto|ftp)[^\s\]]+\]", r"\1", text)
    text = re.sub(r"\[https?://[^\s\]]+ ([^\]\n]*)\](?!\()", r"\1", text)
    text = re.sub(r"'{2,5}(?=[^'\s])([^'\n]+(?:'[^'\n]+)*?)'{2,5}", r"\1", text)
    return re.sub(r"^bq\. ", "> ", text, flags=re.M)


def _markdown(text: str, kept: _Kept) -> str:
    if "===" in text or "---" in text:
        text = re.sub(r"^(?=[^\n|]*\w)([^\n|]+)\n(=|-)\2{2,}[^\S\n]*$", lambda m: f"{'#' if m[2] == '=' else '##'} {m[1].strip()}", text, flags=re.M)
    text = re.sub(r"(?<![`\\])`([^`\n]+)`(?!`)", lambda m: kept.hold(m[1]), text)
    text = re.sub(r"^[^\S\n]*\|?(?:[^\S\n]*:?-{3,}:?[^\S\n]*\|)+(?:[^\S\n]*:?-{3,}:?[^\S\n]*\|?)?[^\S\n]*(?:\n|\Z)", "", text, flags=re.M)
    text = re.sub(r"^\|([^\n]+)\|[^\S\n]*$", lambda m: re.sub(r"\s*\|\s*", "\t", m[1].strip()), text, flags=re.M)
    text = re.sub(r"!?\[([^\[\]\n]*)\]\([^\s()]*(?: \"[^\"]*\")?\)", r"\1", text)
    text = re.sub(r"(?<![*\w\\])(\*\*|__|~~)(?=\S)(.+?)(?<=\S)\1(?![\w])", r"\2", text)
    text = re.sub(r"(?<![*\w\\])\*(?=[^\s*])([^*\n]+?)(?<=[^\s*])\*(?![*\w])", r"\1", text)
    text = re.sub(r"^(\s*)[*+] (?:\[[ xX]\] )?|^(\s*)- \[[ xX]\] ", lambda m: (m[1] or m[2] or "") + "- ", text, flags=re.M)
    return text


_CONTROLS = {2: None, 3: None, 4: None, 5: None}


def stripped(text: str, kinds: set[str]) -> list[str]:
    """Lines of the text without its markup, blank ones included; kept structure is written as an outline, links of pages are marked."""
    kept = _Kept()
    text = text.replace("\r\n", "\n").replace("\r", "\n").translate(_CONTROLS)
    if "html" in kinds and _ESCAPED.search(text):
        text = _ESCAPED.sub(lambda m: html.unescape(html.unescape(m[0])), text)
    text = _FENCE.sub(lambda m: kept.code(m[2]), text)
    text = re.sub(r"\$\$([^$]+)\$\$", lambda m: kept.hold(f"$${m[1].strip()}$$"), text) if "latex" in kinds else text
    steps: tuple[tuple[str, Callable[[str, _Kept], str]], ...] = (("html", _html), ("latex", _latex), ("wiki", _wiki), ("markdown", _markdown))
    for kind, step in steps:
        if kind in kinds:
            text = step(text, kept)
    return kept.back(text).strip("\n").split("\n")


_STRUCTURE = re.compile(r"\s*(?:#{1,6} |- |\d+\. |```|\$\$|>|\w+(?:\([^()]*\))?\s*=\s*[^\s=])|[^\t]*\t")


def _weights(lines: list[str], surge: int) -> list[int]:
    """Each line's text length without blanks and without the words of links; structure lines (formulas too) weigh as a surge."""
    out, fenced, linked = [], False, False
    for line in lines:
        if line.startswith("```"):
            fenced = not fenced
            out.append(surge)
            continue
        own: list[str] = []
        for part in re.split(f"([{LINK}{LINK_END}])", line):
            if part in (LINK, LINK_END):
                linked = part == LINK
            elif not linked:
                own.append(part)
        bare = "".join("".join(own).split())
        size = len(bare) + sum(c >= "\u2e80" for c in bare)  # ideographs and kana weigh double
        worded = re.search(r"\w", bare)
        out.append(max(size, surge) if fenced or worded and _STRUCTURE.match(_MARKS.sub("", line)) else size if worded else 0)
    return out


def main_lines(lines: list[str], page: bool = False, window: int = WINDOW, surge: int = SURGE) -> list[str]:
    """Line-block distribution: the lines from each surge of the windows' text length to the dive after it.

    ``total[i]`` is the text length of the ``window`` lines that begin at line i. A stretch begins where it reaches
    ``surge`` at a line with text and ends before the first window without any text. On a page, where navigation and
    imprints stand close to the text, it is narrowed to its full windows: what stands before the first line at which such
    a window ends, or after the last one at which one begins, goes as well. Blank lines count, so they must not have been squeezed. If no window
    reaches ``surge``, all lines stay.
    """
    weights = _weights(lines, surge)
    total = [sum(weights[i:i + window]) for i in range(len(lines))]
    keep = [False] * len(lines)
    i = 0
    while i < len(lines):
        if total[i] < surge or not weights[i]:
            i += 1
            continue
        end = i
        while end < len(lines) and total[end] > 0:
            end += 1
        first, last = i, end
        if page:
            while first < last and (sum(weights[max(0, first - window + 1):first + 1]) < surge or not weights[first]):
                first += 1
            while last > first and (total[last - 1] < surge or not weights[last - 1]):
                last -= 1
        keep[first:last] = [True] * (last - first)
        i = end + 1
    out = [_MARKS.sub("", line) for line, k in zip(lines, keep) if k]
    return out if any(x.strip() for x in out) else [_MARKS.sub("", line) for line in lines]


def cleaned(text: str | None) -> tuple[str | None, list[str]]:
    """(clean text, kinds of markup found). A text without markup comes out as it is; null gives null."""
    kinds = constructs(text)
    if not kinds:
        return text, []
    out: list[str] = []
    for part in opened(text):
        if part.strip():
            page = "html" in kinds and bool(_PAGE.search(html.unescape(part)))
            out += [line.rstrip() for line in main_lines(stripped(part, kinds), page)]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip("\n"), sorted(kinds)


def clean_texts(items: DataFrame, key: str = "id", text: str = "content") -> DataFrame:
    """(key, text, kinds) of every row; kinds is an empty array where the text has no markup.

    Null texts stay null, repeated rows each give one, other columns are ignored, an empty table gives an empty one.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [cleaned(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in made], pa.string()), pa.array([k for _, k in made], pa.list_(pa.string()))], [key, text, "kinds"])

    rows = items.select(F.col(f"`{key}`"), F.col(f"`{text}`").alias("t"))
    return rows.mapInArrow(run, f"`{key}` {rows.dtypes[0][1]}, `{text}` string, kinds array<string>")
