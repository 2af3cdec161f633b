"""Credentials in code and configuration: found on lexical tokens and redacted in place.

The text is cut into names and literals by the lexer. A literal that is assigned to, keyed by or passed to a
credential-named identifier is a credential unless it is a placeholder, a reference or a label; so are unquoted values of
settings, passwords in URLs, headers and command lines, signed tokens, key blocks of any length, and base64 that decodes to
one of them. Literals that hold credential words are scanned again as text of their own. Redaction replaces the contents
of the literal only: its delimiters, escapes and line ends stay. All is narrow, one pass over the text, in linear time.
"""

from __future__ import annotations

import base64
import binascii
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.llm import lexer

MASK = "REDACTED"
# Last words of names whose values grant access, by how strictly the value is looked at.
_PASSWORDS = {"password", "passwd", "pwd", "pw", "pass", "passphrase", "passwort", "userpass", "dbpass", "pgpassword"}
_SECRETS = {"secret", "token", "apikey", "credential", "credentials", "auth", "bearer", "hmac", "jwt", "authtoken",
            "secretkey", "accesskey", "authorization", "secrets", "session"}
_KEYS = {"key", "keys"}
#: Words before "key" that make it no secret.
_OPEN_KEYS = {"public", "host", "primary", "foreign", "cache", "sort", "partition", "group", "row", "map", "unique", "index", "routing", "idempotency", "object", "pub"}
#: Last words of calls that take an account and then what proves it.
_LOGINS = {"connect", "login", "logon", "signin", "authenticate", "auth", "bind", "credentials", "credential"}
#: First words of calls that look a name up, check or describe it instead of taking a value.
_LOOKUPS = {"get", "getenv", "env", "read", "fetch", "load", "lookup", "find", "has", "is", "check", "require", "log", "print", "echo", "resolve", "render", "parse", "decode", "environ"}
#: First words of calls that take the value itself.
_SETTERS = {"set", "with", "use", "put", "update", "change", "reset", "assign"}
#: Options of command line clients that take a password, attached or after a blank.
_CLIENTS = {"mysql": "-p", "mysqldump": "-p", "mysqladmin": "-p", "mysqlimport": "-p", "mariadb": "-p", "sshpass": "-p", "redis-cli": "-a", "mongo": "-p", "mongosh": "-p",
            "mongodump": "-p", "mongorestore": "-p", "ldapsearch": "-w", "ldapmodify": "-w", "ldapadd": "-w", "docker": "-p"}
#: Settings words that stand where a password would.
_SETTINGS = {"required", "optional", "hidden", "prompt", "plain", "default", "disabled", "enabled", "input", "field", "value", "invalid", "missing", "unset", "basic", "digest", "warn", "fail", "failed"}
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
#: What may stand between the letters of a name without being one of its words.
_GAP = r"[_$\-\x80-\U0010ffff]*"
# What begins a hint, as patterns.
_HINTS = ["pass", "pwd", "secret", "token", "key", "cred", "auth", "bearer", "hmac", "jwt", "session", r"identified\s", "eyj", r"basic\s", r"-u[\s=]", r"--user[\s=]", "://", "connect", "login", "logon",
          "signin", "bind", "mysql", "mariadb", "redis-cli", "mongo", "ldap", "docker", r"k(?![a-z0-9])(?<![a-z0-9]k)"]


def _by_first(patterns: list[str]) -> str:
    """One choice a first character, for speed."""
    groups: dict[str, list[str]] = {}
    for p in patterns:
        groups.setdefault(p[0], []).append(p[1:])
    return "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in groups.items())


#: In lower case, a superset of what every rule needs.
_HINT = re.compile(_by_first([*_HINTS, *(rf"{w[0]}(?={_GAP}{w[1]}){_GAP.join(w)[1:]}(?![a-z0-9])" for w in sorted(_PASSWORDS | _SECRETS))]))
#: From a name to its value: closing marks, a declared type, the operator.
_ASSIGN = re.compile(
    r"""(?:\\?["'`])?+\]?+(?:\[\w*+\])?+\s*+(?:(?::\s*+(?:const\s++)?(?!\w++\s*+:)[^\W\d](?:[\w\[\]*&|?\x20]|::|<(?:[^<>=\n]|<[^<>=\n]*+>)*+>)*+(?<=\s)(?==\s)|[a-z][\w<>\[\]]*+\s*+(?=:?=[^=>])))?+"""
    r"""(?P<op>:=|=>|[|?+]{0,2}={1,3}|->|:(?!:)|,|\bvalue\s*+=)\s*+(?P<open>\(\s*+)*+""")
_WRAPPER = re.compile(r"(?:new\s++)?(?P<callee>[^\W\d][\w.:]*+)!?\(\s*+(?=[bBrRuUfFL@]{0,2}[\"'`])")
_CALL = re.compile(r"!?\s*+\(\s*+")
_NEXT_ARGUMENT = re.compile(r"\s*+,\s*+")
_BARE = re.compile(r"[^\s\"'`,;:<>(){}\[\]][^\s\"'`;<>(){}]*+")
_IN_QUERY = re.compile(r"[^\s&\"'`#]++")
_REST = re.compile(r"[^\s\"'`][^\n]*")
_LINE_HEAD = re.compile(r"[^\S\n]*+(?:(?:export|ENV|set)[^\S\n]++|-[^\S\n]++|#[^\S\n]*+|//[^\S\n]*+)?")
_XML_VALUE = re.compile(r">(?P<bare>[^<>\n]++)</")
_AFTER_BLANK = re.compile(r"[^\S\n]++(?![=:])|=(?!=)")
_BLANKS = re.compile(r"\s++")
_IDENTIFIED = re.compile(r"identified\s++by\s++", re.I)
_WORD_VALUE = re.compile(r"[^\s\"'`,;<>{}()]++")
_OPTION_VALUE = re.compile(r"[^\s\"'`;,]++")
_USER = re.compile(r"(?:(?<=\s)-u|--user)[\s=]++[\"']?[\w.\-]++:(?P<bare>[^\s\"']++)")
_MORE = re.compile(r"(?:\\?[\"'`])\s*+[+.]\s*+(?=[\"'`])")
_URL = re.compile(r"://(?P<user>[^\s:/@\"'`]*+):(?P<bare>[^\s@/\"'`]++)@(?=[\w\[])")
_JWT = re.compile(r"\beyJ[A-Za-z0-9_\-]{8,}+\.[A-Za-z0-9_\-]{8,}+\.[A-Za-z0-9_\-]{8,}+")
_PREFIXED = re.compile(r"(?<![\w\-./+])(?:[a-z]{2,4}\d?[_\-](?:(?:live|test|sk|pk|pat)[_\-])?|[A-Z]{2,4}\.)[A-Za-z0-9]{10,}+(?:[_\-][A-Za-z0-9]++)*+(?![\w\-/])")
_BASE64 = re.compile(r"(?<![\w+/=\-])[A-Za-z0-9+/]{24,}+={0,2}(?![\w+/=])")
_LONG = re.compile(r"[A-Za-z0-9+/=_.\-]{12,}+")
_BLOCK = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_BODY = re.compile(r"(?:(?:\\[rn])|[\s\"'+#/*|,;<>\-]|&#?\w+;)*(?:[A-Z][\w\-]*: [^\n\\]*(?:\\n|\n)[\s#/*]*)*(?P<body>[A-Za-z0-9+/=]{16,})")
#: The next line of a block without an end: joined to the one before by a line end (written out or not), with nothing but joiners after it.
_NEXT = re.compile(r"(?:[^\S\n]|[\"'`+#/*|,;<>\-]|&#?\w+;)*(?:\\r)?(?:\\n|\n)(?:\\[rn]|[\s\"'`+#/*|,;<>\-]|&#?\w+;)*(?P<body>[A-Za-z0-9+/=]+)(?=[^\S\n]*(?:[\"'`\\<&]|$|\n))")
_RUN = re.compile(r"[A-Za-z0-9+/=]{16,}")
_JOINER = re.compile(r"\\[rn]|[\s\"'`+#/*|,;<>\-]|&#?\w+;")
_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_INK = re.compile(r"[^\n]")
#: An escape that stands for a delimiter or a blank stays; one that spells a character is masked with the rest.
_KEPT_ESCAPE = re.compile(r"\\[\\nrtbfv0\"'`$/\n]|\n")
_PLACEHOLDER = re.compile(
    r"\$\{|\$\(|\{\{|\}\}|<[^>]*>?$|^%\w+%$|%\(|%s|^%[dv]$|^\$[A-Za-z_]|^__\w+__$|^[*xX.•#?\-_]+$|^\.{3}|\.{3}$|(?<![a-z])(?:replace|your[_\- ]|insert[_\- ]|example|placeholder|todo)|change[_\- ]?(?:me|it)|"
    r"redacted|^(?:none|null|nil|true|false|undefined|string|str|text|empty|test|dummy|secret|password|passwd|pass|pwd|token|key)$|^process\.env|^os\.|^env[.(]|getenv|^vault[:./]|^kv/|^arn:|^projects/|^file:|"
    r"^ref\+|^op://|^ssm:|^![a-z]+(?:\s|$)|^[@&*][A-Za-z_][a-z_./]*$", re.I)
_LABEL = re.compile(r"passw|kennwort|contrase|mot de passe|senha|\bpaste\b|\benter\b|token here|your |vergessen|forgot|пароль|密码|パスワード|\bapi key\b|\bkey is\b|\s.*[?:…]$", re.I)


def _words(name: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(name)]


@lru_cache(maxsize=1 << 16)
def _kind(name: str) -> str:
    """password, secret, random or the empty text, by a name's words."""
    words = _words(re.split(r"\.|->|::", name)[-1]) or [""]
    joined, last = "".join(words), words[-1]
    if last in _PASSWORDS or joined in _PASSWORDS:
        return "password"
    if last in _SECRETS or joined in _SECRETS:
        return "secret"
    if last in _KEYS and len(words) > 1 and words[-2] not in _OPEN_KEYS:
        return "secret"
    if last == "base" and words[-2:-1] == ["key"]:
        return "secret"
    return "random" if joined == "k" else ""


@lru_cache(maxsize=1 << 16)
def _role(name: str) -> tuple[str, bool, bool, bool]:
    """(kind, takes an account and its proof, looks names up, takes a value) of a name."""
    words = _words(re.split(r"\.|->|::", name)[-1]) or [""]
    return _kind(name), words[-1] in _LOGINS, words[0] in _LOOKUPS, words[0] in _SETTERS


def _random(value: str) -> bool:
    """A run without blanks in which letters and digits or the cases are mixed as no word or path has them."""
    if len(value) < 12 or re.search(r"\s", value):
        return False
    core = re.sub(r"[^A-Za-z0-9]", "", value)
    if len(core) < 10 or value.startswith(("/", "./", "http:", "https:")) and "?" not in value:
        return False
    digits = sum(c.isdigit() for c in core)
    switches = sum(a.isupper() != b.isupper() or a.isdigit() != b.isdigit() for a, b in zip(core, core[1:]))
    return digits >= 1 and switches >= max(3, len(core) // 8) or switches >= max(5, len(core) // 5)


def _hexadecimal(value: str) -> bool:
    return len(value) >= 16 and len(value) % 2 == 0 and bool(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value)) and len(set(value)) >= 4


def _mixed(value: str) -> bool:
    """A short password: letters and digits with changes of case, or with marks that no name holds."""
    if len(value) < 8 or re.search(r"\s|://", value) or not re.search(r"[A-Za-z]", value):
        return False
    switches = sum(a.isupper() != b.isupper() or a.isdigit() != b.isdigit() for a, b in zip(value, value[1:]))
    cases = bool(re.search(r"[A-Z]", value) and re.search(r"[a-z]", value))
    marked = bool(re.search(r"[!?*#^%&+$]", value))
    if not re.search(r"\d", value):
        return marked and cases and switches >= 4
    if marked or re.fullmatch(r"[A-Z][a-z]+(?:-[A-Za-z]+)+-\d+|[A-Za-z]+\d{3,}[^\w\s]", value):
        return True
    return switches >= 4 and cases


def _strong(value: str) -> bool:
    return _random(value) or _mixed(value) or _hexadecimal(value)


def _plain(value: str) -> bool:
    """Identifiers, dotted names, paths and calls, as they stand unquoted in code."""
    return bool(re.fullmatch(r"[A-Za-z_$][\w$]*(?:(?:\.|::|->|\?\.)[A-Za-z_$][\w$]*)*[;,]?", value)) and not _random(value) and not _mixed(value)


def _granting(kind: str, value: str, quoted: bool) -> bool:
    value = value.strip()
    if len(value) < 4 or _PLACEHOLDER.search(value):
        return False
    if kind == "password":
        words = value.split()
        if _LABEL.search(value) or len(words) > 1 and (len(words) < 3 or any(not w.isascii() or not w.isalnum() for w in words)):
            return False
        if "://" in value or value.startswith("/") and value.count("/") > 1:
            return False
        if quoted:
            return value.lower() not in _SETTINGS
        if value.isalpha():  # unquoted, it may be a name; the words of names are longer
            return len(value) >= 8 and len(value) < 3 * len(_WORD.findall(value))
        return not _plain(value)
    if kind in ("secret", "random"):
        if re.match(r"ssh-|ecdsa-|sha\d+[:\-]|md5:|data:", value) or re.fullmatch(r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}", value, re.I):
            return False
        if re.fullmatch(r"[A-Z]{10,}[a-z]{10,}\d*|(?:[a-z]+[/.\-_#])+[a-z0-9]+|\^.*[\[\\$(].*|.*\[[A-Za-z0-9\-_]+\].*", value):
            return False
        phrase = value.split()
        if quoted and len(phrase) >= 4 and all(w.isalpha() and w.islower() and len(w) > 3 for w in phrase):
            return kind == "secret" and not _LABEL.search(value)
        return (_random(value) or kind == "secret" and _hexadecimal(value)
                or kind == "secret" and _mixed(value) and (quoted or bool(re.search(r"[^\w.\-+*/%&]$|^[A-Z][a-z]+-", value))))
    return False


def _hidden(value: str) -> bool:
    """Base64 of a URL with a password, or of a token."""
    try:
        plain = base64.b64decode(value + "=" * (-len(value) % 4), validate=True).decode("ascii")
    except (binascii.Error, UnicodeDecodeError, ValueError):
        return False
    if not plain.isprintable():
        return False
    m = _URL.search(plain)
    return bool(m and _granting("password", m["bare"], True) or _JWT.search(plain) or (p := _PREFIXED.fullmatch(plain)) and _random(p[0]))


Parts = list[tuple[int, int]]  # one value: its literal and those that are joined to it


class _Scan:
    """One text on its way through the rules; ``found`` gets one entry a value."""

    def __init__(self, text: str, hints: list[int]) -> None:
        self.text, self.hints = text, hints
        self.found: list[Parts] = []
        self.head = (-1, -1)  # the last line's begin and the end of what may stand before a setting's name

    def run(self, begin: int, end: int) -> None:
        """Names at hints between the literals, and the literals that hold a hint, in order."""
        n, at = bisect_left(self.hints, begin), begin
        for _, a, b in lexer.literals(self.text, begin, end):
            if n == len(self.hints) or self.hints[n] >= end:
                return
            if self.hints[n] < a:
                n, at = self.names(n, at, a, end)
            inside = bisect_left(self.hints, b, n)
            if inside > n:
                held = self.text[a:b] if b - a < 200 else ""
                if held and lexer.NAME.fullmatch(held) and _kind(held):
                    self.named(held, a, b, end)
                self.run(a, b)
                n = inside
            at = b
        self.names(n, at, end, end)

    def names(self, n: int, at: int, stop: int, end: int) -> tuple[int, int]:
        while n < len(self.hints) and (hint := self.hints[n]) < stop:
            if hint >= at and (span := lexer.name_at(self.text, hint, at, stop)):
                at = span[1]
                self.named(self.text[span[0]:at], *span, end)
            n += 1
        return n, at

    def named(self, name: str, a: int, b: int, end: int) -> None:
        kind, takes_account, looks_up, sets = _role(name)
        if kind:
            self.assigned(kind, name, a, b, end)
            if not looks_up:
                self.called(kind, sets, b, end)
            self.spoken(kind, name, a, b, end)
        if takes_account:
            self.account(b, end)
        lower = name.lower()
        if lower in _CLIENTS:
            self.client(_CLIENTS[lower], b, end)
        elif lower in ("bearer", "basic"):
            self.header(b, end)
        elif lower == "identified" and (m := _IDENTIFIED.match(self.text, a, end)):
            self.take("password", m.end(), end, _OPTION_VALUE)

    def value(self, at: int, end: int) -> tuple[Parts, str, bool] | None:
        """(parts, joined contents, is a format string) of the literal here and of those joined to it."""
        if not (lit := lexer.literal(self.text, at, end)):
            return None
        parts, prefix = [lit[:2]], lit[3]
        while more := _MORE.match(self.text, parts[-1][1], end):
            if not (lit := lexer.literal(self.text, more.end(), end)):
                break
            parts.append(lit[:2])
        contents = "".join(self.text[x:y] for x, y in parts).replace("\\\n", "")
        return parts, contents, "f" in prefix.lower() and "{" in contents or prefix.startswith("$") and "{" in contents

    def assigned(self, kind: str, name: str, a: int, b: int, end: int) -> None:
        text = self.text
        if text[a - 1:a] == "<" and (m := _XML_VALUE.match(text, b, end)):
            if "://" not in m["bare"] and _granting(kind, m["bare"], True):
                self.found.append([m.span("bare")])
            return
        if text[a - 1:a] in ("?", "&") and text[b:b + 1] == "=":
            if (m := _IN_QUERY.match(text, b + 1, end)) and _granting("secret", m[0], True):
                self.found.append([m.span()])
            return
        if not (m := _ASSIGN.match(text, b, end)):
            return
        at, listed = m.end(), m["op"] == ","
        wrapper = _WRAPPER.match(text, at, end)
        if wrapper:
            at = wrapper.end()
        if got := self.value(at, end):
            parts, contents, formatted = got
            called = text[parts[-1][1] + 1:parts[-1][1] + 2] == "("
            if formatted or called or "://" in contents or listed and contents.isalpha():
                return
            if wrapper and wrapper["callee"] != "String" and (_role(wrapper["callee"])[2] or not _strong(contents)):
                return
            if _granting(kind, contents, True):
                self.found.append(parts)
            return
        if wrapper or listed or "\n" in text[b:at] or m["open"]:
            return
        bare = _BARE.match(text, at, end)
        if bare:
            stop = bare.end() - (len(bare[0]) - len(bare[0].rstrip(",")))
            value = text[at:stop]
            if "://" not in value and text[bare.end():bare.end() + 1] != "(" and _granting(kind, value, name.startswith("_")):
                self.found.append([(at, stop)])
                return
        if kind == "password" and m["op"] in ("=", ":") and self.begins_line(a):
            rest = _REST.match(text, at, end)
            if rest:
                value = rest[0].rstrip()
                if "://" not in value and not re.search(r"[(){}\[\];=]", value) and _granting("password", value, False):
                    self.found.append([(at, at + len(value))])

    def begins_line(self, a: int) -> bool:
        if not self.head[0] <= a <= self.head[1]:
            begin = self.text.rfind("\n", max(0, self.head[0]), a) + 1
            self.head = (begin, _LINE_HEAD.match(self.text, begin).end())
        return self.head[1] == a or self.head[1] + 1 == a and self.text[a - 1] in "\"'"

    def called(self, kind: str, sets: bool, b: int, end: int) -> None:
        """Literals passed to an identifier: ``set_password("...")``, also after other literal arguments."""
        m = _CALL.match(self.text, b, end)
        at = m.end() if m else -1
        while at >= 0 and (got := self.value(at, end)):
            parts, contents, formatted = got
            if not formatted and "://" not in contents and (sets or _strong(contents)) and _granting(kind, contents, True):
                self.found.append(parts)
            closed = parts[-1][1] + (len(self.text[parts[-1][1]:parts[-1][1] + 3]) - len(self.text[parts[-1][1]:parts[-1][1] + 3].lstrip("\\\"'`")))
            more = _NEXT_ARGUMENT.match(self.text, closed, end)
            at = more.end() if more else -1

    def account(self, b: int, end: int) -> None:
        """A call with an account's name and then its password or key."""
        m = _CALL.match(self.text, b, end)
        if not m or not (first := self.value(m.end(), end)) or not re.fullmatch(r"[\w.@+\\\-]+", first[1]):
            return
        more = _NEXT_ARGUMENT.match(self.text, first[0][-1][1] + 1, end)
        if more and (got := self.value(more.end(), end)) and not got[2] and "://" not in got[1] and _strong(got[1]) and _granting("password", got[1], True):
            self.found.append(got[0])

    def spoken(self, kind: str, name: str, a: int, b: int, end: int) -> None:
        """A value after a blank: in SQL, in options and in records of words."""
        if name.lower().endswith("password") or self.text[max(0, a - 2):a] == "--":
            if (m := _AFTER_BLANK.match(self.text, b, end)) and (m[0] != "=" or self.text[max(0, a - 2):a] == "--"):
                self.take("password", m.end(), end, _OPTION_VALUE)

    def take(self, kind: str, at: int, end: int, bare: re.Pattern) -> None:
        if got := self.value(at, end):
            if not got[2] and "://" not in got[1] and _granting(kind, got[1], True):
                self.found.append(got[0])
        elif (m := bare.match(self.text, at, end)) and "://" not in m[0] and "(" not in m[0] and m[0][0] not in "=:" and _granting(kind, m[0], False):
            self.found.append([m.span()])

    def header(self, b: int, end: int) -> None:
        """What follows Bearer or Basic, and the literals joined to it."""
        blank = _BLANKS.match(self.text, b, end)
        m = _WORD_VALUE.match(self.text, blank.end(), end) if blank else None
        if not m or len(m[0]) < 6:
            return
        parts, whole = [m.span()], len(self.text)
        while more := _MORE.match(self.text, parts[-1][1], whole):
            if not (lit := lexer.literal(self.text, more.end(), whole)):
                break
            parts.append(lit[:2])
        if _granting("secret", "".join(self.text[x:y] for x, y in parts), True):
            self.found.append(parts)

    def client(self, option: str, b: int, end: int) -> None:
        """The password option of a client of databases, directories or hosts, on the client's line."""
        stop = self.text.find("\n", b, end)
        stop = end if stop < 0 else stop
        at = b
        while (at := self.text.find(f" {option}", at, stop)) >= 0:
            at += 1 + len(option)
            m = _BLANKS.match(self.text, at, stop)
            got = self.value(m.end() if m else at, stop)
            word = _OPTION_VALUE.match(self.text, m.end() if m else at, stop)
            if got and _granting("password", got[1], True):
                self.found.append(got[0])
            elif not got and word and not re.match(r"[\d./:]+$", word[0]) and word[0][0] not in "-=" and _strong(word[0]) and _granting("password", word[0], True):
                self.found.append([word.span()])


def credentials(text: str | None) -> list[tuple[int, int, int]]:
    """(line from 1, start, end) of the contents of every credential, ordered and without overlaps; none in null and empty texts.

    Literals joined to one value have the line on which the value begins.
    """
    if not text:
        return []
    blocks, whole = _blocks(text), text
    values: list[Parts] = [[(a, b)] for a, b, _ in blocks]
    if blocks:
        text = _without(text, blocks)
    lower = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # ASCII only: offsets stay
    hints = [m.start() for m in _HINT.finditer(lower)]
    if hints:
        scan = _Scan(text, hints)
        scan.run(0, len(text))
        values += scan.found
        values += [[m.span("bare")] for m in _URL.finditer(text) if _granting("password", m["bare"], True)]
        values += [[m.span()] for m in _JWT.finditer(text)]
        values += [[m.span("bare")] for m in _USER.finditer(text) if _granting("password", m["bare"], True)]
    values += _anywhere(text)
    if not values:
        return []
    starts = [0]
    for m in re.finditer("\n", whole):
        starts.append(m.end())
    out: list[tuple[int, int, int]] = []
    last = -1
    for a, b, head in sorted(((a, b, parts[0][0]) for parts in values for a, b in parts), key=lambda s: (s[0], -s[1])):
        if a >= last and b > a:
            out.append((bisect_right(starts, head), a, b))
            last = b
    return out


def _blocks(text: str) -> list[tuple[int, int, int]]:
    """(start, end of what is redacted, end with the closing line) of every key block that has a body.

    A block ends at the next closing line, however far, if no other head comes first and what lies between holds no more
    other text than key text, joiners not counted. Otherwise (a cut block) it ends with its last line of key text.
    """
    heads = list(_BLOCK.finditer(text))
    ends = list(_END.finditer(text)) if heads else []
    out: list[tuple[int, int, int]] = []
    at = 0
    for n, m in enumerate(heads):
        if out and m.start() < out[-1][2] or not (body := _BODY.match(text, m.end())):
            continue
        while at < len(ends) and ends[at].start() < body.end():
            at += 1
        stop = ends[at] if at < len(ends) and (n + 1 == len(heads) or ends[at].start() < heads[n + 1].start()) else None
        last = body.end()
        while (more := _NEXT.match(text, last)) and _key_text(more["body"]):
            last = more.end()
        if stop:
            between = text[last:stop.start()]
            other = _RUN.sub(lambda r: "" if _key_text(r[0]) else r[0], between)
            if len(_JOINER.sub("", other)) <= len(between) - len(other) + len(body["body"]):
                out.append((m.start(), stop.start(), stop.end()))
                continue
        out.append((m.start(), last, last))
    return out


def _key_text(run: str) -> bool:
    """A run that no word, name or number is: long, padded, or of both cases and digits; short ones of both cases at least."""
    kinds = sum(bool(re.search(p, run)) for p in ("[A-Z]", "[a-z]", r"\d"))
    return len(run) >= 40 or run.startswith("=") or run.endswith("=") or kinds == 3 or len(run) < 16 and kinds == 2 and not re.fullmatch(r"[A-Z]?[a-z]+|[A-Za-z]+\d+", run)


def _without(text: str, blocks: list[tuple[int, int, int]]) -> str:
    """The text with stars for the blocks, so that what stands around them on their lines is looked at alone."""
    out, at = [], 0
    for a, _, b in blocks:
        out += [text[at:a], _INK.sub("*", text[a:b])]
        at = b
    return "".join(out) + text[at:]


def _anywhere(text: str) -> list[Parts]:
    """Tokens that need no name or word beside them; none spans lines. All have capitals."""
    found: list[Parts] = []
    for run in _LONG.finditer(text):
        if run[0].islower() or run[0].lower() == run[0]:
            continue
        for m in _PREFIXED.finditer(text, *run.span()):
            if _random(m[0]) and sum(c.isdigit() for c in m[0]) and any(c.isupper() for c in m[0][4:]) and not _PLACEHOLDER.search(m[0]):
                found.append([m.span()])
        if run.end() - run.start() >= 24:
            found += [[m.span()] for m in _BASE64.finditer(text, *run.span()) if _hidden(m[0])]
    return found


def _masked(span: str) -> str:
    """Key blocks keep their head, escapes and line structure; of other contents the first run becomes the mask, and escapes and line ends stay."""
    if span.startswith("-----BEGIN"):
        head = _BLOCK.match(span).end()
        return span[:head] + re.sub(r"(\\.)|[A-Za-z0-9+/=]", lambda m: m[1] or "X", span[head:])
    runs, kept = _KEPT_ESCAPE.split(span), [*_KEPT_ESCAPE.findall(span), ""]
    first = next((i for i, run in enumerate(runs) if run), 0)
    return "".join((MASK if i == first else "X" if run else "") + escape for i, (run, escape) in enumerate(zip(runs, kept)))


def redacted(text: str | None, spans: list[tuple[int, int, int]] | None = None) -> str | None:
    """The text with every credential (``spans``, where they are known) redacted; null stays null."""
    spans = credentials(text) if spans is None else spans
    if not spans:
        return text
    out, at = [], 0
    for _, a, b in spans:
        out += [text[at:a], _masked(text[a:b])]
        at = b
    return "".join(out) + text[at:]


def found_lines(files: DataFrame, key: str, text: str = "normalized_content") -> DataFrame:
    """Distinct (key, line_no) on which a credential begins. Other columns are ignored; an empty table gives an empty one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, lines = [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for line in dict.fromkeys(x[0] for x in credentials(t)):
                    keys.append(k)
                    lines.append(line)
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.types[0]), pa.array(lines, pa.int32())], [key, "line_no"])

    rows = files.select(F.col(f"`{key}`"), F.col(f"`{text}`").alias("t")).filter(F.length("t") > 0)
    return rows.mapInArrow(run, f"`{key}` {rows.dtypes[0][1]}, line_no int")


def redacted_texts(files: DataFrame, key: str, text: str = "normalized_content") -> DataFrame:
    """(key, text, n_credentials) of every row, repeated keys and null texts included."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            spans = [credentials(t) for t in texts]
            made = pa.array(map(redacted, texts, spans), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), made, pa.array(map(len, spans), pa.int32())], [key, text, "n_credentials"])

    rows = files.select(F.col(f"`{key}`"), F.col(f"`{text}`").alias("t"))
    return rows.mapInArrow(run, f"`{key}` {rows.dtypes[0][1]}, `{text}` string, n_credentials int")
