"""Static reading of JavaScript: requests, endpoints, parameters and response fields.

The script is cut into tokens with their brackets matched, and everything is
read off spans of tokens: a call is a name chain before a bracket, an argument
the tokens between commas.  Without a grammar there is nothing to lose step
with in minified or broken code.  Strings are folded over concatenation,
constants, object members, joins and templates; what stays unknown becomes a
``{name}`` placeholder.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from urllib.parse import urlencode, urlsplit

from siteatlas.functions import classify
from siteatlas.rules import CLI_RULES

TOKEN = re.compile(
    r"""(?P<space>\s+|//[^\n]*|/\*[\s\S]*?(?:\*/|$))
    |(?P<name>[A-Za-z_$\u0080-\uffff][\w$\u0080-\uffff]*)
    |(?P<number>0[xX][0-9a-fA-F]+|\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)
    |(?P<string>"(?:[^"\\\n]|\\[\s\S])*"|'(?:[^'\\\n]|\\[\s\S])*')
    |(?P<tick>`)
    |(?P<op>=>|===|!==|==|!=|<=|>=|&&|\|\||\?\?|\?\.|\+\+|--|\+=|-=|\.\.\.|[\s\S])""",
    re.X,
)
REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
#: A slash after one of these begins a regular expression.
BEFORE_REGEX = set("(,=:[!&|?{};+-*%<>~^") | {"=>", "&&", "||", "===", "!==", "==", "!=", "return", "typeof", "case", "in", "of"}
PAIRS = {"(": ")", "[": "]", "{": "}"}
KEYWORDS = set("if for while switch catch function return typeof new with super constructor".split())
# Calls with a string that are no requests.
NOT_CALLERS = set(
    "log warn error info debug trace dir table assert time timeEnd group groupEnd push match test exec setAttribute "
    "getAttribute write appendChild createElement querySelector querySelectorAll getElementById import require "
    "addEventListener setTimeout setInterval".split()
)
CLIENTS = re.compile(r"^(?:window\.)?(?:fetch|axios|superagent|request|ky|got|\$|jQuery|BX\.ajax|this\.\$?https?|\$?https?)(?:\.|$)")
VERB_OF = {v: m for m, verbs in classify.VERBS.items() for v in verbs.split()}
URL_KEYS = ["url", "uri", "endpoint", "ajaxUrl", "path"]
CONTINUATIONS = {"then", "done", "success", "subscribe", "always", "finally"}
UNKNOWN = "{…}"


@dataclass
class Token:
    kind: str
    text: str
    value: str = ""
    parts: list = field(default_factory=list)  # of a template: strings and token spans
    mate: int = -1  # of a bracket: the index of the other


ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\n": ""}


def unescape(s: str) -> str:
    def one(m: re.Match) -> str:
        e = m[1]
        if e[0] in "xu" and len(e) > 1:
            try:
                return chr(int(e[1:].strip("{}"), 16))
            except (ValueError, OverflowError):
                return ""
        return ESCAPES.get(e, e)

    return re.sub(r"\\(x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|u\{[0-9a-fA-F]+\}|[\s\S])", one, s)


def tokenize(src: str) -> list[Token]:
    out: list[Token] = []
    at = 0
    while at < len(src):
        if src[at] == "/" and src[at + 1 : at + 2] not in ("/", "*") and (not out or out[-1].text in BEFORE_REGEX):
            if m := REGEX.match(src, at):
                out.append(Token("regex", m[0]))
                at = m.end()
                continue
        m = TOKEN.match(src, at)
        at = m.end()
        kind = m.lastgroup
        if kind == "string":
            out.append(Token(kind, m[0], unescape(m[0][1:-1])))
        elif kind == "tick":
            token, at = template(src, at)
            out.append(token)
        elif kind != "space":
            out.append(Token(kind, m[0]))
    match_brackets(out)
    return out


def template(src: str, at: int) -> tuple[Token, int]:
    """A template literal from after its opening tick."""
    parts, text = [], ""
    while at < len(src) and src[at] != "`":
        if src[at] == "\\":
            text += unescape(src[at : at + 2])
            at += 2
        elif src.startswith("${", at):
            end = closing_brace(src, at + 2)
            parts += [text, tokenize(src[at + 2 : end])]
            text, at = "", end + 1
        else:
            text += src[at]
            at += 1
    return Token("template", "`", parts=[*parts, text]), at + 1


def closing_brace(src: str, at: int) -> int:
    depth = 1
    while at < len(src):
        c = src[at]
        if c in "\"'`":
            end = at + 1
            while end < len(src) and src[end] != c:
                end += 2 if src[end] == "\\" else 1
            at = end
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if not depth:
                return at
        at += 1
    return at


def match_brackets(tokens: list[Token]) -> None:
    stack: list[int] = []
    for i, t in enumerate(tokens):
        if t.kind != "op":
            continue
        if t.text in PAIRS:
            stack.append(i)
        elif t.text in ")]}":
            for k in range(len(stack) - 1, -1, -1):
                if PAIRS[tokens[stack[k]].text] == t.text:
                    tokens[stack[k]].mate, t.mate = i, stack[k]
                    del stack[k:]
                    break


class Script:
    """One script and what is known of its values."""

    def __init__(self, src: str, source_url: str):
        self.tokens, self.source_url = tokenize(src), source_url
        self.values: dict[str, str] = {}
        self.links: dict[str, dict] = {}
        self.requests: list[dict] = []
        self.params: dict[tuple[str, str], dict] = {}
        self.builders: dict[str, dict] = {}
        self.made: dict[str, str] = {}  # variable: constructor
        self.base_urls: dict[str, str] = {}
        self.sent: dict[str, dict] = {}  # XHR variable: its open request

    # --- spans -------------------------------------------------------------

    def split(self, low: int, high: int, mark: str = ",") -> list[tuple[int, int]]:
        """Spans between ``mark`` at the top level."""
        out, i, start = [], low, low
        while i < high:
            t = self.tokens[i]
            if t.kind == "op" and t.text in PAIRS and i < t.mate < high:
                i = t.mate
            elif t.kind == "op" and t.text == mark:
                out.append((start, i))
                start = i + 1
            i += 1
        return [*out, (start, high)] if high > low else []

    def entries(self, low: int, high: int) -> list[tuple[str, tuple[int, int]]]:
        """Key and value span of an object literal between its braces."""
        out = []
        for a, b in self.split(low, high):
            key = self.tokens[a]
            name = key.value if key.kind == "string" else key.text
            if a + 1 < b and self.tokens[a + 1].text == ":":
                out.append((name, (a + 2, b)))
            elif key.kind == "name":
                out.append((name, (a, b) if b == a + 1 else (a + 1, b)))
        return out

    def object_at(self, span: tuple[int, int]) -> dict[str, tuple[int, int]] | None:
        a, b = span
        if a < b and self.tokens[a].text == "{" and self.tokens[a].mate == b - 1:
            return dict(self.entries(a + 1, b - 1))
        return None

    # --- folding -----------------------------------------------------------

    def text_of(self, span: tuple[int, int]) -> str:
        """The string an expression has, unknown parts as placeholders."""
        return "".join(self.term(a, b) for a, b in self.split(*span, mark="+"))

    def term(self, a: int, b: int) -> str:
        if a >= b:
            return ""
        t = self.tokens
        first = t[a]
        if first.text in ("await", "void") or (first.text == "(" and first.mate == b - 1):
            return self.text_of((a + 1, b)) if first.text != "(" else self.text_of((a + 1, b - 1))
        if b == a + 1:
            if first.kind == "string":
                return first.value
            if first.kind == "template":
                return "".join(p if isinstance(p, str) else self.placeholder_of(p) for p in first.parts)
            if first.kind == "number":
                return first.text
        if first.text == "[" and a < first.mate < b - 1 and [x.text for x in t[first.mate + 1 : first.mate + 3]] == [".", "join"]:
            items = [self.text_of(s) for s in self.split(a + 1, first.mate)]
            sep = self.text_of((first.mate + 4, b - 1)) if b - 1 > first.mate + 4 else ","
            return sep.join(items)
        name = self.chain(a, b)
        if name:
            return self.values.get(name, "{" + name + "}")
        if first.kind == "name" and b > a + 2 and t[a + 1].text == "(" and t[a + 1].mate == b - 1 and first.text in ("encodeURIComponent", "encodeURI", "String"):
            return self.text_of((a + 2, b - 1))
        if b > a + 4 and t[b - 1].text == ")" and t[b - 1].mate == b - 2 and t[b - 3].text == "toString":
            return self.text_of((a, b - 4))
        return UNKNOWN

    def chain(self, a: int, b: int) -> str:
        """A dotted name, empty if the span is anything else."""
        words = [x for x in self.tokens[a:b]]
        if words and all((x.kind == "name") if i % 2 == 0 else x.text in (".", "?.") for i, x in enumerate(words)) and len(words) % 2:
            return ".".join(x.text for x in words[::2])
        return ""

    def placeholder_of(self, tokens: list[Token]) -> str:
        name = ".".join(x.text for x in tokens[::2]) if all(x.kind == "name" for x in tokens[::2]) and all(x.text in (".", "?.") for x in tokens[1::2]) else ""
        return self.values.get(name, "{" + name + "}") if name else UNKNOWN

    # --- passes ------------------------------------------------------------

    def run(self) -> Script:
        self.collect_values()
        self.collect_builders()
        self.collect_calls()
        self.harvest()
        self.bind_params()
        return self

    def collect_values(self) -> None:
        """Constants, object members and constructed objects, in order; the last assignment counts."""
        t = self.tokens
        for i, x in enumerate(t):
            if x.text != "=" or x.kind != "op" or i == 0 or t[i - 1].kind != "name":
                continue
            start = i - 1
            while start >= 2 and t[start - 1].text == "." and t[start - 2].kind == "name":
                start -= 2
            name = self.chain(start, i)
            end = self.end_of_expression(i + 1)
            if members := self.object_at((i + 1, end)):
                for k, span in members.items():
                    self.set_value(f"{name}.{k}", span)
            elif i + 2 < len(t) and t[i + 1].text == "new" and t[i + 2].kind == "name":
                self.made[name] = t[i + 2].text
            elif self.chain(i + 1, min(i + 4, end)) == "axios.create" and i + 5 < len(t):
                if config := self.object_at((i + 5, t[i + 4].mate)):
                    self.base_urls[name] = self.text_of(config["baseURL"]) if "baseURL" in config else ""
            else:
                self.set_value(name, (i + 1, end))

    def set_value(self, name: str, span: tuple[int, int]) -> None:
        value = self.text_of(span)
        if value and UNKNOWN not in value and value != "{" + name + "}":
            self.values[name] = value

    def end_of_expression(self, i: int) -> int:
        t = self.tokens
        while i < len(t):
            x = t[i]
            if x.kind == "op" and x.text in PAIRS and x.mate > i:
                i = x.mate
            elif x.kind == "op" and x.text in ",;)]}" or x.text in ("var", "let", "const", "return"):
                return i
            i += 1
        return i

    def collect_builders(self) -> None:
        """Names set on builders of queries and forms."""
        t = self.tokens
        seeded = {}
        for i, x in enumerate(t):
            if x.text == "new" and i + 2 < len(t) and t[i + 1].text in ("URLSearchParams", "FormData", "URL") and i >= 2 and t[i - 1].text == "=":
                inner = t[i + 3 : t[i + 2].mate] if t[i + 2].text == "(" else []
                seeded[t[i - 2].text] = ("form" if t[i + 1].text == "FormData" else "query", any(y.text in ("location", "URL") for y in inner) and any(y.text == "location" for y in inner))
        for i, x in enumerate(t):
            if x.text not in ("set", "append") or i < 2 or t[i - 1].text != "." or i + 2 >= len(t) or t[i + 1].text != "(" or t[i + 2].kind != "string":
                continue
            at = i - 2
            owner = t[at - 2].text if t[at].text == "searchParams" and at >= 2 else t[at].text
            if owner not in seeded and t[at].text != "searchParams":
                continue
            kind, page = seeded.get(owner, ("query", False))
            b = self.builders.setdefault(owner, {"kind": kind, "page": page, "names": []})
            b["names"].append(t[i + 2].value)

    def collect_calls(self) -> None:
        t = self.tokens
        for i, x in enumerate(t):
            if x.text == "(" and x.kind == "op" and x.mate > i and i:
                self.call(i)

    def callee(self, i: int) -> tuple[str, str, int]:
        """(whole chain, last property, first token) of what stands before a bracket."""
        t, at, words = self.tokens, i - 1, []
        while at >= 0:
            x = t[at]
            if x.kind == "name":
                words.append(x.text)
                at -= 1
            elif x.text == "]" and x.mate == at - 2 and t[at - 1].kind == "string":
                words.append(t[at - 1].value)
                at = x.mate - 1
                if at >= 0 and t[at].kind == "name":
                    continue
                break
            elif x.text == ")" and x.mate >= 0 and words:
                words.append("()")
                at = x.mate - 1
                continue
            else:
                break
            if at >= 0 and t[at].text in (".", "?."):
                at -= 1
            elif at >= 0 and t[at].kind == "name" and t[at].text not in ("new", "await", "return", "function", "else", "typeof"):
                break
            else:
                break
        words.reverse()
        return ".".join(words), words[-1] if words else "", at + 1

    def call(self, i: int) -> None:
        t = self.tokens
        name, verb, start = self.callee(i)
        before = t[start - 1].text if start else ""
        if not name or verb in KEYWORDS or verb in NOT_CALLERS or before == "function":
            return
        args = self.split(i + 1, t[i].mate)
        if not args:
            if verb == "send" and (x := self.sent.get(name.rpartition(".")[0])):
                self.emit(**x)
            return
        owner = name.rpartition(".")[0]
        if self.made.get(owner) == "XMLHttpRequest":
            return self.xhr(owner, verb, args)
        config, init, address = self.object_at(args[0]), {}, ""
        if config is not None:
            key = next((k for k in URL_KEYS if k in config), "")
            address, init = (self.text_of(config[key]), config) if key else ("", {})
        else:
            address = self.text_of(args[0])
        known = bool(CLIENTS.match(name)) or (before == "new" and verb == "Request") or owner in self.base_urls
        shaped = is_url_argument(address)
        if not shaped or likely_not_api(address) or not (known or endpoint_shape(address)):
            return
        if config is None and len(args) > 1:
            init = self.object_at(args[1]) or {}
        plain = verb not in ("fetch", "Request", "ajax", "axios") and config is None
        method_key = next((k for k in ("method", "type") if k in init), "")
        explicit = self.text_of(init[method_key]).strip("{}") if method_key and not plain else ""
        body, query = "", []
        payload = len(args) > 1 and config is None and not self.is_function(args[1])
        if config is not None or not plain:
            for k in ("body", "data"):
                if k in init:
                    body, payload = self.body_of(init[k]), True
        elif payload:
            body = self.body_of(args[1])
        if "params" in init and (p := self.object_at(init["params"])):
            query = [(k, self.text_of(s)) for k, s in p.items()]
            body = "" if plain else body
        headers = []
        if "headers" in init and (h := self.object_at(init["headers"])):
            headers = [(k, self.text_of(s)) for k, s in h.items()]
        method, inferred = self.method(explicit, verb, payload, self.continued(t[i].mate))
        if method == "GET" and plain and body and not inferred and (p := self.object_at(args[1])) and "params" not in p:
            query, body = [(k, self.text_of(s)) for k, s in p.items()], ""
        base = self.base_urls.get(owner, "")
        if base and address.startswith("/"):
            address = base.rstrip("/") + address
        fields = self.response_fields(i, args, init)
        self.emit(address, method, inferred, headers, body, query, fields, "js-api", span=(i, t[i].mate))

    def xhr(self, owner: str, verb: str, args: list) -> None:
        if verb == "open" and len(args) > 1:
            address = self.text_of(args[1])
            if is_url_argument(address) and not likely_not_api(address):
                x = {"address": address, "method": self.text_of(args[0]).upper(), "inferred": False, "headers": [], "body": "", "query": [], "fields": [], "tag": "js-api", "span": args[1]}
                self.sent[owner] = x
                self.emit(**x)
        elif owner in self.sent:
            x = self.sent[owner]
            if verb == "setRequestHeader" and len(args) > 1:
                x["headers"].append((self.text_of(args[0]), self.text_of(args[1])))
            elif verb == "send":
                x["body"] = self.body_of(args[0])
                self.emit(**x)

    @staticmethod
    def method(explicit: str, verb: str, payload: bool, continued: bool) -> tuple[str, bool]:
        if explicit:
            return explicit.upper(), False
        if verb.lower() in VERB_OF:
            return VERB_OF[verb.lower()], False
        return ("POST" if payload and continued else "GET"), True

    def continued(self, close: int) -> bool:
        t = self.tokens
        return close + 2 < len(t) and t[close + 1].text == "." and t[close + 2].text in CONTINUATIONS

    def is_function(self, span: tuple[int, int]) -> bool:
        a, b = span
        t = self.tokens
        return a < b and (t[a].text in ("function", "async") or any(x.text == "=>" for x in t[a : min(b, a + 6)]))

    def body_of(self, span: tuple[int, int]) -> str:
        """A body's text: object literals as JSON, builders as their names."""
        a, b = span
        t = self.tokens
        if b > a + 4 and [x.text for x in t[a : a + 3]] == ["JSON", ".", "stringify"]:
            return self.body_of((a + 4, b - 1))
        members = self.object_at(span)
        if members is not None:
            return json.dumps({k: self.json_value(s) for k, s in members.items()}, ensure_ascii=False)
        name = self.chain(a, b)
        if name in self.builders:
            return "&".join(f"{n}=<{n}>" for n in self.builders[name]["names"])
        text = self.text_of(span)
        return "" if text in (UNKNOWN, "{" + name + "}", "null") else re.sub(r"=\{[^}]*\}", lambda m: "=<value>", text)

    def json_value(self, span: tuple[int, int]):
        a, b = span
        t = self.tokens
        members = self.object_at(span)
        if members is not None:
            return {k: self.json_value(s) for k, s in members.items()}
        if b == a + 1:
            x = t[a]
            if x.kind == "number":
                return float(x.text) if "." in x.text else int(x.text, 0)
            if x.text in ("true", "false", "null"):
                return {"true": True, "false": False, "null": None}[x.text]
        if a < b and t[a].text == "[":
            return []
        text = self.text_of(span)
        return re.sub(r"^\{(.*)\}$", r"<\1>", text)

    def emit(self, address, method, inferred, headers, body, query, fields, tag, span=None) -> None:
        if query:
            address += ("&" if "?" in address else "?") + urlencode(sorted(query, key=lambda p: p[0]))
        absolute = resolve_endpoint(address, self.source_url)
        self.links.setdefault(address, {"href": address, "tag": tag, "method": method})
        row = {"url": absolute, "method": method, "headers": headers, "body": body, "response_fields": fields, "endpoint_only": False, "method_inferred": inferred, "inferred_query": [], "span": span}
        for old in self.requests:
            if old["url"] == absolute and old["method"] == method and (not old["body"] or old["body"] == body):
                old |= {"headers": headers or old["headers"], "body": body or old["body"]}
                return
        self.requests.append(row)

    # --- responses ---------------------------------------------------------

    def response_fields(self, i: int, args: list, init: dict) -> list[tuple[str, str]]:
        """Paths that the callbacks of a call read off its answer."""
        t = self.tokens
        spans = [s for s in args[1:] if self.is_function(s)]
        spans += [init[k] for k in ("success", "complete") if k in init]
        at = t[i].mate
        while at + 3 < len(t) and t[at + 1].text == "." and t[at + 2].kind == "name" and t[at + 3].text == "(" and t[at + 3].mate > 0:
            if t[at + 2].text in CONTINUATIONS:
                spans += self.split(at + 4, t[at + 3].mate)[:1]
            at = t[at + 3].mate
        out: dict[str, str] = {}
        for a, b in spans:
            for path, kind in self.member_paths(a, b):
                out[path] = kind if out.get(path, "any") == "any" else out[path]
        return sorted(out.items())

    def member_paths(self, a: int, b: int) -> list[tuple[str, str]]:
        t = self.tokens
        head = next((k for k in range(a, b) if t[k].kind == "name" and t[k].text not in ("function", "async")), -1)
        if head < 0:
            return []
        root, out = t[head].text, []
        k = head + 1
        while k < b:
            if t[k].kind == "name" and t[k].text == root and t[k - 1].text not in (".", "?."):
                path, k2 = [], k + 1
                while k2 + 1 < b:
                    if t[k2].text in (".", "?.") and t[k2 + 1].kind == "name":
                        word, step = t[k2 + 1].text, 2
                    elif t[k2].text == "[" and t[k2 + 1].kind == "string" and t[k2].mate == k2 + 2:
                        word, step = t[k2 + 1].value, 3
                    else:
                        break
                    k2 += step
                    if k2 < b and t[k2].text == "(":  # a method of the answer or of a field
                        if word in ("map", "forEach", "filter", "find", "some", "every") and path:
                            out.append((".".join(path) + "[]", "array"))
                        break
                    path.append(word)
                    out.append((".".join(path), "number" if word == "length" else "any"))
                k = k2
            else:
                k += 1
        return out

    # --- literals and parameters ---------------------------------------------

    def harvest(self) -> None:
        """Endpoint-shaped strings that no known link covers."""
        known = list(self.links)
        for x in self.tokens:
            if x.kind == "string" and endpoint(x.value) and not any(x.value in k for k in known) and x.value not in self.links:
                self.links[x.value] = {"href": x.value, "tag": "js-str", "method": ""}
                self.requests.append(
                    {"url": resolve_endpoint(x.value, self.source_url), "method": "", "headers": [], "body": "", "response_fields": [], "endpoint_only": True, "method_inferred": False, "inferred_query": [], "span": None}
                )

    def bind_params(self) -> None:
        """Builders used inside a request belong to it; those seeded from the page's address are page state."""
        t = self.tokens
        for owner, b in self.builders.items():
            ends = []
            for r in self.requests:
                if r["span"] and any(x.kind == "name" and x.text == owner for x in t[r["span"][0] : r["span"][1]]):
                    ends.append(r["url"])
                    r["inferred_query"] += [(n, "") for n in b["names"] if b["kind"] == "query"]
            for n in b["names"]:
                p = self.params.setdefault((n, b["kind"]), {"name": n, "kind": b["kind"], "owner": "unassigned", "carrier": owner, "endpoints": [], "count": 0})
                p["owner"] = "request" if ends else "page" if b["page"] and p["owner"] != "request" else p["owner"]
                p["endpoints"] = sorted({*p["endpoints"], *ends})
                p["count"] += 1


def is_url_argument(s: str) -> bool:
    s = s.strip()
    return s.startswith(("/", "./", "../", "http://", "https://")) or (s.startswith("{") and "/" in s)


def likely_not_api(s: str) -> bool:
    low = s.lower()
    return len(s) < 3 or "/" not in s or any(p in low for p in classify.NOT_ENDPOINT_PARTS) or low.endswith(tuple(classify.NOT_ENDPOINT_SUFFIXES))


def endpoint(s: str) -> bool:
    """The column expression ``looks_like_endpoint`` for one string."""
    low = s.lower()
    if not 4 <= len(s) <= 512 or re.search(r"[ \t\r\n<>(){}\"'`\\|]", s) or not s.startswith(("/", "http://", "https://")) or likely_not_api(s):
        return False
    return (".php" in low and "?" in s) or any(p in low for p in CLI_RULES.api) or any(p in low for p in classify.ENDPOINT_SIGNALS)


def endpoint_shape(s: str) -> bool:
    return endpoint(re.sub(r"\{[^}]*\}", "", s))


def resolve_endpoint(address: str, base: str) -> str:
    if not address or address.startswith(("http://", "https://")):
        return address
    if address.startswith("//"):
        return "https:" + address
    at = urlsplit(base)
    return f"{at.scheme}://{at.netloc}" + (address if address.startswith("/") else "/" + address) if base else address


TEMPLATE_LITERAL = re.compile(r"`([^`]{1,2000})`")
INTERPOLATION = re.compile(r"\$\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}")


def url_templates(src: str) -> list[tuple[str, int]]:
    """(URL shape, offset) of template literals with interpolations that look like URLs, each shape once."""
    out: dict[str, int] = {}
    for m in TEMPLATE_LITERAL.finditer(src):
        if "${" not in m[1]:
            continue
        shape = INTERPOLATION.sub(lambda x: placeholder(x[0]), m[1])
        shape = re.sub(r"[\n\r\t]", "", shape.strip()).strip()
        dynamic_root = re.match(r"\{[^}]*\}(?:/|\./|https?://)", shape)
        rooted = shape.startswith(("http://", "https://", "/", "./", "../"))
        if shape and " " not in shape and (rooted or dynamic_root) and shape.count("{") <= 8:
            out.setdefault(shape, m.start(1))
    return list(out.items())


def placeholder(interpolation: str) -> str:
    name = interpolation[2:-1].strip()
    return UNKNOWN if not name or re.search(r"[ ()+*/&|?:,<>\[\]{}=!\"'`;\\$]", name) else "{" + name + "}"


def analyze(src: str, source_url: str) -> Script:
    """Everything about one script; broken code gives what was found before the break."""
    script = Script.__new__(Script)
    try:
        Script.__init__(script, src, source_url)
        return script.run()
    except (IndexError, ValueError, RecursionError):
        if not hasattr(script, "links"):
            Script.__init__(script, "", source_url)
        return script
