"""A small recursive-descent parser for the part of PHP that the source-code analyzers look at.

Nodes are :class:`Node` with a kind, a line and fields. Anything that does not parse raises
:class:`ParseError`, and the caller then has no findings for the file."""

from __future__ import annotations

import re


class ParseError(Exception):
    pass


class Node:
    __slots__ = ("kind", "line", "f")

    def __init__(self, kind: str, line: int, **f):
        self.kind, self.line, self.f = kind, line, f

    def __getattr__(self, name):
        try:
            return self.f[name]
        except KeyError:
            raise AttributeError(name) from None


def children(value):
    """Direct child nodes, in source order."""
    for v in value.f.values() if isinstance(value, Node) else value:
        if isinstance(v, Node):
            yield v
        elif isinstance(v, (list, tuple)):
            yield from children(v)


def walk(value):
    """All nodes below and including, parents first."""
    stack = [value] if isinstance(value, Node) else list(children(value))[::-1]
    while stack:
        n = stack.pop()
        yield n
        stack.extend(list(children(n))[::-1])


_TOKEN = re.compile(
    r"""(?P<ws>\s+|//[^\n]*?(?=\n|\?>|$)|\#(?!\[)[^\n]*?(?=\n|\?>|$)|/\*.*?\*/)
  |(?P<close>\?>\n?)|(?P<var>\$[A-Za-z_\x80-\xff][A-Za-z0-9_\x80-\xff]*)
  |(?P<num>0[xX][0-9a-fA-F_]+|0[bB][01_]+|(?:\d[\d_]*)?\.\d[\d_]*(?:[eE][+-]?\d+)?|\d[\d_]*\.?(?:[eE][+-]?\d+)?)
  |(?P<name>\\?[A-Za-z_\x80-\xff][A-Za-z0-9_\x80-\xff]*(?:\\[A-Za-z_\x80-\xff][A-Za-z0-9_\x80-\xff]*)*)
  |(?P<sq>'(?:[^'\\]|\\.)*')|(?P<dq>"(?:[^"\\]|\\.)*")|(?P<bt>`(?:[^`\\]|\\.)*`)
  |(?P<here><<<[ \t]*(?P<hq>['"]?)(?P<hid>[A-Za-z_]\w*)(?P=hq)\r?\n.*?^[ \t]*(?P=hid)\b)
  |(?P<op><=>|\*\*=|\.\.\.|<<=|>>=|===|!==|\?\?=|\?->|\+\+|--|->|=>|::|==|!=|<>|<=|>=|&&|\|\||\?\?|\+=|-=|\*=|/=|\.=|%=|&=|\|=|\^=|<<|>>|\*\*|[-+*/%=<>!.,;:?()\[\]{}&|^~@$\\])""",
    re.X | re.S | re.M,
)
_ESC = {"n": "\n", "t": "\t", "r": "\r", "v": "\v", "e": "\x1b", "f": "\f", "\\": "\\", "$": "$", '"': '"', "`": "`"}


def unescape(s: str) -> str:
    def sub(m):
        c = m[1]
        if c[0] == "x" and len(c) > 1:
            return chr(int(c[1:], 16))
        if c[0] == "u":
            return chr(int(c[2:-1], 16)).encode().decode("latin-1") if int(c[2:-1], 16) < 0x110000 else m[0]
        if c[0].isdigit():
            return chr(int(c, 8) & 255)
        return _ESC.get(c, m[0])

    return re.sub(r"\\(x[0-9A-Fa-f]{1,2}|u\{[0-9A-Fa-f]+\}|[0-7]{1,3}|.)", sub, s, flags=re.S)


def tokens(source: str):
    """(kind, text, line) of the code parts; inline text becomes ('html', text, line)."""
    out, at, line = [], 0, 1
    while at < len(source):
        m = re.compile(r"<\?(?:php\b|=)?", re.I).search(source, at)
        if not m:
            break
        line += source.count("\n", at, m.end())
        at = m.end()
        if m[0] == "<?=":
            out.append(("name", "echo", line))
        while at < len(source):
            t = _TOKEN.match(source, at)
            if not t or t.end() == at:
                raise ParseError(f"line {line}")
            kind, text = t.lastgroup, t[0]
            kind = next(k for k in ("ws", "close", "var", "num", "name", "sq", "dq", "bt", "here", "op") if t[k] is not None)
            at = t.end()
            if kind == "close":
                out.append(("op", ";", line))
                line += text.count("\n")
                break
            if kind != "ws":
                out.append((kind, text, line))
            line += text.count("\n")
    out.append(("eof", "", line))
    return out


BINARY = {"or": 1, "xor": 2, "and": 3, "??": 7, "||": 8, "&&": 9, "|": 10, "^": 11, "&": 12, "==": 13, "!=": 13, "===": 13, "!==": 13, "<>": 13, "<=>": 13, "<": 14, "<=": 14, ">": 14, ">=": 14, ".": 15, "<<": 16, ">>": 16, "+": 17, "-": 17, "*": 18, "/": 18, "%": 18, "instanceof": 20, "**": 21}
ASSIGN = {"=", "+=", "-=", "*=", "/=", ".=", "%=", "**=", "??=", "&=", "|=", "^=", "<<=", ">>="}
CASTS = {"int", "integer", "float", "double", "real", "string", "bool", "boolean", "array", "object", "unset", "binary"}
MODIFIERS = {"public", "private", "protected", "static", "abstract", "final", "var", "readonly"}


class Parser:
    def __init__(self, source: str):
        self.t, self.i = tokens(source), 0

    # -- tokens
    def peek(self, k=0):
        return self.t[min(self.i + k, len(self.t) - 1)]

    def next(self):
        tok = self.peek()
        self.i += 1
        return tok

    def at(self, *texts):
        kind, text, _ = self.peek()
        return kind in ("op", "name") and text.lower() in texts

    def take(self, *texts):
        if self.at(*texts):
            return self.next()
        return None

    def need(self, text):
        tok = self.take(text)
        if not tok:
            raise ParseError(f"expected {text} at line {self.peek()[2]}")
        return tok

    # -- statements
    def program(self):
        out = []
        while self.peek()[0] != "eof":
            out.append(self.statement())
        return [s for s in out if s]

    def block(self, *ends):
        """A braced block, one statement, or the alternative syntax up to one of ``ends``."""
        if self.take("{"):
            out = []
            while not self.take("}"):
                if self.peek()[0] == "eof":
                    raise ParseError("unclosed block")
                out.append(self.statement())
            return [s for s in out if s]
        if ends and self.take(":"):
            out = []
            while not self.at(*ends):
                if self.peek()[0] == "eof":
                    raise ParseError("unclosed block")
                out.append(self.statement())
            return [s for s in out if s]
        s = self.statement()
        return [s] if s else []

    def end(self):
        if self.peek()[0] == "eof" or self.take(";"):
            return
        raise ParseError(f"expected ; at line {self.peek()[2]}")

    def statement(self):
        kind, text, line = self.peek()
        word = text.lower() if kind == "name" else text
        if kind == "op" and word == ";":
            self.next()
            return None
        if kind == "op" and word == "{":
            return Node("Block", line, body=self.block())
        if kind == "name":
            nxt = self.peek(1)[1]
            if word in ("echo", "print") and nxt != "=":
                self.next()
                items = [self.expr()]
                while self.take(","):
                    items.append(self.expr())
                self.end()
                return Node("Echo", line, items=items)
            if word == "return":
                self.next()
                e = None if self.at(";") or self.peek()[0] == "eof" else self.expr()
                self.end()
                return Node("Return", line, expr=e)
            if word in ("if", "while", "switch"):
                return self.conditional(word, line)
            if word == "do":
                self.next()
                body = self.block()
                self.need("while")
                cond = self.paren()
                self.end()
                return Node("Loop", line, body=body, cond=cond)
            if word == "for":
                self.next()
                self.need("(")
                parts = []
                while not self.take(")"):
                    if not self.take(";") and not self.take(","):
                        parts.append(self.expr())
                body = self.block("endfor")
                self.take("endfor") and self.end()
                return Node("Loop", line, parts=parts, body=body)
            if word == "foreach":
                self.next()
                self.need("(")
                subject = self.expr()
                self.need("as")
                self.take("&")
                key, value = None, self.expr()
                if self.take("=>"):
                    self.take("&")
                    key, value = value, self.expr()
                self.need(")")
                body = self.block("endforeach")
                self.take("endforeach") and self.end()
                return Node("Foreach", line, subject=subject, key=key, value=value, body=body)
            if word == "function" and (self.peek(1)[0] == "name" or (nxt == "&" and self.peek(2)[0] == "name")):
                return self.function()
            if word in ("class", "interface", "trait", "abstract", "final") and self.peek(1)[0] == "name":
                return self.klass()
            if word == "try":
                self.next()
                body = self.block()
                rest = []
                while self.take("catch"):
                    self.need("(")
                    while not self.take(")"):
                        self.next()
                    rest += self.block()
                if self.take("finally"):
                    rest += self.block()
                return Node("Block", line, body=body + rest)
            if word in ("namespace", "use", "declare", "const", "goto"):
                self.next()
                while not self.at(";", "{") and self.peek()[0] != "eof":
                    self.next()
                if word == "use" and self.at("{"):
                    while not self.take("}"):
                        self.next()
                if self.at("{"):
                    return Node("Block", line, body=self.block())
                self.end()
                return None
            if word in ("global", "static") and self.peek(1)[0] == "var" or word in ("break", "continue", "unset", "throw") and word != "unset":
                self.next()
                items = []
                while not self.at(";") and self.peek()[0] != "eof":
                    if not self.take(","):
                        items.append(self.expr())
                self.end()
                return Node("Misc", line, items=items)
        e = self.expr()
        self.end()
        return Node("Expr", line, expr=e)

    def conditional(self, word, line):
        self.next()
        cond, ends = self.paren(), {"if": ("elseif", "else", "endif"), "while": ("endwhile",), "switch": ("endswitch",)}[word]
        if word == "switch":
            braces = bool(self.take("{"))
            if not braces:
                self.need(":")
            body = []
            while not self.take("}" if braces else "endswitch"):
                if self.take("case"):
                    body.append(Node("Expr", line, expr=self.expr()))
                    self.take(":") or self.take(";")
                elif self.take("default"):
                    self.take(":") or self.take(";")
                elif self.peek()[0] == "eof":
                    raise ParseError("unclosed switch")
                elif s := self.statement():
                    body.append(s)
            return Node("If", line, cond=cond, body=body)
        body = self.block(*ends)
        while word == "if" and (self.at("elseif") or self.at("else") and self.peek(1)[1].lower() == "if"):
            self.take("else")
            self.next()
            body.append(Node("Expr", line, expr=self.paren()))
            body += self.block(*ends)
        if word == "if" and self.take("else"):
            body += self.block("endif")
        if self.take("endif", "endwhile"):
            self.end()
        return Node("If", line, cond=cond, body=body)

    def paren(self):
        self.need("(")
        e = self.expr()
        self.need(")")
        return e

    def params(self):
        self.need("(")
        out = []
        while not self.take(")"):
            kind, text, _ = self.next()
            if kind == "eof":
                raise ParseError("unclosed parameters")
            if kind == "var":
                out.append(text[1:])
                if self.take("="):
                    self.expr()
        return out

    def result_type(self):
        if self.take(":"):
            while not self.at("{", ";", "=>") and self.peek()[0] != "eof":
                self.next()

    def function(self, name=True):
        line = self.need("function")[2]
        self.take("&")
        label = self.next()[1] if name else ""
        params = self.params()
        if not name and self.take("use"):
            self.params()
        self.result_type()
        body = None if self.take(";") else self.block()
        return Node("Function" if name else "Closure", line, name=label, params=params, body=body or [])

    def klass(self):
        while self.peek()[1].lower() in ("abstract", "final"):
            self.next()
        line, name = self.next()[2], self.next()[1]
        return self.members(line, name)

    def members(self, line, name):
        while not self.at("{"):
            if self.peek()[0] == "eof":
                raise ParseError("class body")
            self.next()
        self.need("{")
        body = []
        while not self.take("}"):
            if self.peek()[0] == "eof":
                raise ParseError("unclosed class")
            if self.at("function"):
                body.append(self.function())
            elif self.at("use", "const", "case"):
                while not self.take(";"):
                    if self.at("{"):
                        self.block()
                        break
                    if self.next()[0] == "eof":
                        raise ParseError("class member")
            elif self.peek()[0] == "var":
                self.next()
                if self.take("="):
                    body.append(Node("Expr", line, expr=self.expr()))
                self.take(",") or self.take(";")
            else:
                self.next()
        return Node("Class", line, name=name, body=body)

    # -- expressions
    def expr(self, least=0):
        left = self.unary()
        while True:
            kind, text, line = self.peek()
            op = text.lower() if kind == "name" else text
            if kind not in ("op", "name"):
                return left
            if op in ASSIGN and kind == "op":
                self.next()
                self.take("&")
                value = self.expr(5)
                left = Node("Assign", line, target=left, value=value, op=op)
            elif op == "?" and kind == "op" and least <= 6:
                self.next()
                if self.take(":"):
                    left = Node("Ternary", line, cond=left, a=left, b=self.expr(7))
                else:
                    a = self.expr(5)
                    self.need(":")
                    left = Node("Ternary", line, cond=left, a=a, b=self.expr(7))
            elif op in BINARY and BINARY[op] >= max(least, 1):
                self.next()
                p = BINARY[op]
                right = self.expr(p if op in ("??", "**") else p + 1)
                left = Node("Concat" if op == "." else "Coalesce" if op == "??" else "Binary", line, left=left, right=right, op=op)
            else:
                return left

    def unary(self):
        kind, text, line = self.peek()
        word = text.lower() if kind == "name" else text
        if kind == "op":
            if word in ("!", "-", "+", "~", "@", "&", "++", "--"):
                self.next()
                return Node("Unary", line, op=word, expr=self.expr(19) if word != "!" else self.expr(19))
            if word == "(" and self.peek(1)[0] == "name" and self.peek(1)[1].lower() in CASTS and self.peek(2)[1] == ")":
                self.i += 3
                return Node("Cast", line, to=self.t[self.i - 2][1].lower(), expr=self.expr(19))
        if kind == "name":
            if word in ("include", "include_once", "require", "require_once"):
                self.next()
                return Node("Include", line, how=word, expr=self.expr(4))
            if word in ("print", "clone", "throw", "yield"):
                self.next()
                return Node("Unary", line, op=word, expr=self.expr(4)) if not self.at(";", ")") else Node("Const", line, name=word)
            if word == "new":
                return self.postfix(self.new(line))
        return self.postfix(self.atom())

    def new(self, line):
        self.next()
        if self.take("class"):
            args = self.args() if self.at("(") else []
            return Node("New", line, cls=None, args=args, body=self.members(line, ""))
        kind, text, _ = self.peek()
        cls = self.next() and text if kind == "name" else self.atom()
        return Node("New", line, cls=cls, args=self.args() if self.at("(") else [])

    def args(self):
        self.need("(")
        out = []
        while not self.take(")"):
            if self.take(","):
                continue
            self.take("...")
            if self.peek()[0] == "name" and self.peek(1)[1] == ":" and self.peek(2)[1] != ":":
                self.i += 2
            if self.at(")"):
                continue
            out.append(self.expr())
        return out

    def items(self, close):
        out = []
        while not self.take(close):
            if self.take(","):
                continue
            self.take("...") or self.take("&")
            k, v = None, self.expr()
            if self.take("=>"):
                self.take("&")
                k, v = v, self.expr()
            out.append(Node("Item", v.line, key=k, value=v))
        return out

    def atom(self):
        kind, text, line = self.next()
        word = text.lower()
        if kind == "var":
            return Node("Var", line, name=text[1:])
        if kind == "num":
            return Node("Num", line, value=text.replace("_", ""))
        if kind == "sq":
            return Node("Str", line, value=re.sub(r"\\([\\'])", r"\1", text[1:-1]))
        if kind in ("dq", "bt"):
            n = self.interpolated(text[1:-1], line)
            return n if kind == "dq" else Node("Call", line, name="shell_exec", args=[n])
        if kind == "here":
            body = re.sub(r"^<<<[^\n]*\n", "", text)
            body = body.rpartition("\n")[0]
            return Node("Str", line, value=body) if re.match(r"<<<[ \t]*'", text) else self.interpolated(body, line)
        if kind == "op":
            if text == "(":
                e = self.expr()
                self.need(")")
                return e
            if text == "[":
                return Node("Array", line, items=self.items("]"))
            if text == "$":
                if self.take("{"):
                    e = self.expr()
                    self.need("}")
                    return Node("VarVar", line, expr=e)
                return Node("VarVar", line, expr=self.atom())
        if kind == "name":
            if word in ("array", "list") and self.at("("):
                self.next()
                return Node("Array", line, items=self.items(")"))
            if word in ("function", "fn") or word == "static" and self.at("function", "fn"):
                if word == "static":
                    word = self.next()[1].lower()
                if word == "fn":
                    self.take("&")
                    params = self.params()
                    self.result_type()
                    self.need("=>")
                    e = self.expr(4)
                    return Node("Closure", line, name="", params=params, body=[Node("Return", line, expr=e)])
                self.i -= 1
                return self.function(False)
            if word in ("exit", "die"):
                return Node("Exit", line, args=self.args() if self.at("(") else [])
            if word == "eval" and self.at("("):
                return Node("Eval", line, expr=self.paren())
            if word in ("isset", "empty") and self.at("("):
                return Node("Isset", line, items=self.args())
            if word == "match" and self.at("("):
                subject = self.paren()
                self.need("{")
                return Node("Array", line, items=[Node("Item", line, key=None, value=subject), *self.items("}")])
            return Node("Const", line, name=text)
        raise ParseError(f"unexpected {text!r} at line {line}")

    def interpolated(self, s, line):
        parts, at = [], 0
        for m in re.finditer(r"\\.|\{\$((?:[^{}]|\{[^{}]*\})*)\}|\$\{(\w+)\}|\$([A-Za-z_]\w*)(\[[^\]]*\]|->\w+)?", s, re.S):
            if m[0][0] == "\\":
                continue
            if m.start() > at:
                parts.append(Node("Str", line, value=unescape(s[at : m.start()])))
            at = m.end()
            if m[1] is not None:
                sub = Parser("<?php $" + m[1] + ";")
                for k, tok in enumerate(sub.t):
                    sub.t[k] = (*tok[:2], line)
                parts.append(sub.expr())
            else:
                v = Node("Var", line, name=m[2] or m[3])
                if m[4] and m[4][0] == "[":
                    key = m[4][1:-1].strip("'\"")
                    v = Node("Index", line, base=v, key=Node("Var", line, name=key[1:]) if key.startswith("$") else Node("Str", line, value=key))
                elif m[4]:
                    v = Node("Prop", line, base=v, name=m[4][2:])
                parts.append(v)
        if not parts:
            return Node("Str", line, value=unescape(s))
        if at < len(s):
            parts.append(Node("Str", line, value=unescape(s[at:])))
        return Node("Interp", line, parts=parts)

    def postfix(self, n):
        while True:
            kind, text, line = self.peek()
            if kind != "op":
                return n
            if text in ("[", "{") and (text == "[" or False):
                self.next()
                key = None if self.at("]") else self.expr()
                self.need("]")
                n = Node("Index", line, base=n, key=key)
            elif text in ("->", "?->"):
                self.next()
                k2, t2, _ = self.peek()
                if k2 == "name":
                    name = self.next()[1]
                elif self.take("{"):
                    name = self.expr()
                    self.need("}")
                else:
                    name = self.atom()
                n = Node("MethodCall", line, base=n, name=name, args=self.args()) if self.at("(") else Node("Prop", line, base=n, name=name)
            elif text == "::":
                self.next()
                k2, t2, _ = self.peek()
                name = self.next()[1] if k2 == "name" else self.atom()
                cls = n.name if n.kind == "Const" else n
                n = Node("StaticCall", line, cls=cls, name=name, args=self.args()) if self.at("(") else Node("StaticProp", line, cls=cls, name=name)
            elif text == "(":
                args = self.args()
                n = Node("Call", n.line, name=n.name.lstrip("\\").rpartition("\\")[2].lower(), args=args) if n.kind == "Const" else Node("DynCall", n.line, callee=n, args=args)
            elif text in ("++", "--"):
                self.next()
            else:
                return n


def parse(source: str) -> list[Node]:
    """Statements of a file; code without an opening tag gets one, on a line of its own before it."""
    if not re.match(r"\s*<\?", source):
        source = "<?php\n" + source
    try:
        return Parser(source).program()
    except (ParseError, RecursionError, IndexError, ValueError, AttributeError, StopIteration) as e:
        raise ParseError(str(e)) from None
