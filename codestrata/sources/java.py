"""Java source to rows: a tokenizer, a declaration parser and a body scan with declared types.

What declared types prove is resolved as 'ast'; names guessed from imports or the package are 'heuristic'. A file is parsed by itself; what it
says of types, members and expressions goes out as facts, from which operators.types resolves receivers across files. Bodies of field
initialisers and initialiser blocks give no edges; local and anonymous classes count as part of their method.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import roles as R
from ..schemas import ANNOTATIONS, EDGES, FACTS, IMPORTS, SYMBOLS

_TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?\*/)|(?P<text>\"\"\".*?(?<!\\)\"\"\"|"(?:\\.|[^"\\\n])*")|(?P<char>'(?:\\.|[^'\\\n])+')|(?P<num>(?:0[xXbB][\da-fA-F_]+|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?|\.\d[\d_]*)[lLfFdD]?)|(?P<id>[^\W\d][\w$]*|\$[\w$]*)|(?P<op>>>>=|<<=|>>=|\.\.\.|->|::|\+\+|--|&&|\|\||[=!<>+\-*/%&|^]=|[^\s\w])""",
    re.S | re.X,
)
_MODIFIERS = {"public", "protected", "private", "static", "abstract", "final", "native", "synchronized", "transient", "volatile", "strictfp", "default", "sealed"}
_NO_CALL = {"if", "for", "while", "switch", "catch", "synchronized", "return", "try", "throw", "assert", "do", "else", "case", "yield", "super", "this", "new", "instanceof"}
_ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", ">>>="}
_KINDS = {"class": "CLASS", "interface": "INTERFACE", "enum": "ENUM", "record": "RECORD"}
_PRIMITIVE = {"int", "long", "short", "byte", "char", "float", "double", "boolean", "void", "var"}
#: Fixed value: names that need no import.
JAVA_LANG = {"String", "Integer", "Long", "Boolean", "Double", "Float", "Object", "Exception", "RuntimeException", "Throwable", "Thread", "Class", "Number", "Byte", "Short", "Character"}


class ParseError(Exception):
    """The text is no Java that this parser knows."""


def tokens(source: str) -> list[tuple[str, str, int]]:
    """(kind, text, line)."""
    out, line, at = [], 1, 0
    for m in _TOKEN.finditer(source):
        if m.start() != at:
            break
        kind, text, at = m.lastgroup, m.group(), m.end()
        if kind != "skip":
            out.append((kind, text, line))
            if kind != "text":
                continue
        line += text.count("\n")
    if at != len(source):
        raise ParseError(f"line {line}")
    return out


def param_type(raw: str) -> str:
    """A type as overloads are told apart: no type arguments, no package; brackets stay."""
    depth, out = 0, []
    for c in raw.strip():
        depth += (c == "<") - (c == ">")
        if depth == 0 and c != ">":
            out.append(c)
    base, _, rest = "".join(out).partition("[")
    return base.rsplit(".", 1)[-1] + ("[" + rest if rest else "")


def type_arguments(text: str) -> tuple[str, list[str]]:
    """A type's name and its arguments: those of the last name, where an outer one has some too. Brackets of arrays stay with the name."""
    depth, name, part, parts = 0, "", "", []
    for c in text:
        if c == ">":
            depth -= 1
            if depth == 0:
                parts.append(part)
                part = ""
                continue
        if depth == 0 and c == "<":
            parts, part = [], ""
        elif depth == 1 and c == ",":
            parts.append(part)
            part = ""
        elif depth:
            part += c
        else:
            name += c
        depth += c == "<"
    return name.strip(), [p.strip() for p in parts if p.strip()]


@dataclass
class Member:
    kind: str
    name: str
    start: int
    end: int
    modifiers: list[str]
    annotations: list[tuple[str, int]]
    type: str | None = None
    params: list[tuple[str, str, bool]] = field(default_factory=list)
    throws: list[str] = field(default_factory=list)
    variables: list[str] = field(default_factory=list)
    body: tuple[int, int] | None = None


@dataclass
class TypeDecl:
    kind: str
    name: str
    start: int
    modifiers: list[str]
    annotations: list[tuple[str, int]]
    extends: list[tuple[str, int]] = field(default_factory=list)
    implements: list[tuple[str, int]] = field(default_factory=list)
    end: int = 0
    members: list[Member] = field(default_factory=list)
    nested: list[TypeDecl] = field(default_factory=list)
    variables: list[str] = field(default_factory=list)


class Parser:
    """Declarations of one compilation unit."""

    def __init__(self, source: str):
        self.t, self.i = tokens(source), 0
        self.package, self.imports, self.types = "", [], []
        self._unit()

    def at(self, k: int = 0) -> str:
        return self.t[self.i + k][1] if self.i + k < len(self.t) else ""

    def kind(self, k: int = 0) -> str:
        return self.t[self.i + k][0] if self.i + k < len(self.t) else ""

    def line(self) -> int:
        return self.t[min(self.i, len(self.t) - 1)][2] if self.t else 1

    def take(self, text: str | None = None) -> str:
        if self.i >= len(self.t) or (text is not None and self.at() != text):
            raise ParseError(f"line {self.line()}: {text or 'more'} is wanted, {self.at()!r} found")
        self.i += 1
        return self.t[self.i - 1][1]

    def skip(self, opening: str, closing: str) -> tuple[int, int]:
        """Past a balanced stretch; the token range inside."""
        self.take(opening)
        start, depth = self.i, 1
        while depth:
            x = self.take()
            depth += (x == opening) - (x == closing)
        return start, self.i - 1

    def name(self) -> str:
        if self.kind() != "id":
            raise ParseError(f"line {self.line()}: a name is wanted")
        out = self.take()
        while self.at() == "." and self.kind(1) == "id":
            self.i += 1
            out += "." + self.take()
        return out

    def angle(self) -> str:
        out, depth = "", 0
        while True:
            x = self.take()
            depth += {"<": 1, ">": -1, ">>": -2, ">>>": -3}.get(x, 0)
            out += f" {x} " if x in ("extends", "super", "&") else x + (" " if x == "," else "")
            if depth == 0:
                return out

    def variables(self) -> list[str]:
        """Names of type parameters, without bounds."""
        out = []
        while self.at() in ("<", ","):
            self.take()
            self.modifiers()
            out.append(self.name())
            while self.at() not in (",", ">"):
                self.angle() if self.at() == "<" else self.take()
        self.take(">")
        return out

    def type(self) -> str:
        while self.at() == "@" and self.at(1) != "interface":
            self.annotation()
        out = self.name() if self.at() != "?" else self.take()
        while self.at() == "<" or (self.at() == "." and self.kind(1) == "id"):
            if self.at() == "<":
                out += self.angle()
            else:
                self.i += 1
                out += "." + self.take()
        while self.at() == "[" and self.at(1) == "]":
            self.i += 2
            out += "[]"
        return out

    def annotation(self) -> tuple[str, int]:
        line = self.line()
        self.take("@")
        name = self.name()
        if self.at() == "(":
            self.skip("(", ")")
        return name, line

    def modifiers(self) -> tuple[list[str], list[tuple[str, int]]]:
        mods, marks = [], []
        while True:
            if self.at() == "@" and self.at(1) != "interface":
                marks.append(self.annotation())
            elif self.at() == "non" and self.at(1) == "-":
                self.i += 3
                mods.append("non-sealed")
            elif self.at() in _MODIFIERS and not (self.at() == "default" and self.at(1) in (":", "->")):
                if self.at() == "sealed" and self.kind(1) != "id":
                    return mods, marks
                mods.append(self.take())
            else:
                return mods, marks

    def _unit(self) -> None:
        while self.i < len(self.t):
            if self.at() == ";":
                self.i += 1
                continue
            start = self.line()
            mods, marks = self.modifiers()
            if self.at() == "package":
                self.i += 1
                self.package = self.name()
                self.take(";")
            elif self.at() == "import":
                self.i += 1
                static = self.at() == "static" and bool(self.take())
                name = self.name()
                wild = self.at() == "." and bool(self.take()) and bool(self.take("*"))
                self.take(";")
                self.imports.append((name, static, wild))
            elif self.is_type():
                self.types.append(self.type_decl(start, mods, marks))
            else:
                raise ParseError(f"line {self.line()}: a type is wanted, {self.at()!r} found")

    def is_type(self) -> bool:
        return self.at() in ("class", "interface", "enum") or (self.at() == "@" and self.at(1) == "interface") or (self.at() == "record" and self.kind(1) == "id" and self.at(2) in ("(", "<"))

    def type_list(self) -> list[tuple[str, int]]:
        out = []
        while True:
            line = self.line()
            out.append((self.type(), line))
            if self.at() != ",":
                return out
            self.i += 1

    def type_decl(self, start: int, mods: list[str], marks: list) -> TypeDecl:
        if self.at() == "@":
            self.i += 2
            kind = "ANNOTATION_TYPE"
        else:
            kind = _KINDS[self.take()]
        td = TypeDecl(kind, self.take(), start, mods, marks)
        if self.at() == "<":
            td.variables = self.variables()
        if kind == "RECORD":
            self.skip("(", ")")
        while self.at() in ("extends", "implements", "permits"):
            word = self.take()
            found = self.type_list()
            if word == "extends":
                td.extends = found
            elif word == "implements":
                td.implements = found
        self.take("{")
        if kind == "ENUM":
            self.constants()
        while self.at() != "}":
            self.member(td)
        td.end = self.line()
        self.take("}")
        return td

    def constants(self) -> None:
        while self.at() not in (";", "}"):
            if self.at() == "@":
                self.annotation()
            elif self.at() == ",":
                self.i += 1
            else:
                self.name()
                if self.at() == "(":
                    self.skip("(", ")")
                if self.at() == "{":
                    self.skip("{", "}")
        if self.at() == ";":
            self.i += 1

    def member(self, td: TypeDecl) -> None:
        if self.at() == ";":
            self.i += 1
            return
        start = self.line()
        mods, marks = self.modifiers()
        if self.at() == "{":
            self.skip("{", "}")
            return
        if self.is_type():
            td.nested.append(self.type_decl(start, mods, marks))
            return
        variables = self.variables() if self.at() == "<" else []
        if self.at() == td.name and self.at(1) in ("(", "{"):
            self.i += 1
            m = Member("CONSTRUCTOR", "<init>", start, start, mods, marks, variables=variables)
            self.rest_of_method(m)
            td.members.append(m)
            return
        kind = self.type()
        name = self.take()
        if self.at() == "(":
            m = Member("METHOD", name, start, start, mods, marks, kind, variables=variables)
            self.rest_of_method(m)
            td.members.append(m)
            return
        while True:
            dims = ""
            while self.at() == "[":
                self.i += 2
                dims += "[]"
            m = Member("FIELD", name, start, start, mods, marks, kind + dims)
            td.members.append(m)
            if self.at() == "=":
                depth = 0
                while not (depth == 0 and self.at() in (",", ";")):
                    x = self.take()
                    if x == "<" and self._type_arguments():
                        self.i -= 1
                        self.angle()
                        continue
                    depth += (x in "([{") - (x in ")]}")
            m.end = self.line()
            if self.take() == ";":
                break
            name = self.take()
        for x in td.members:
            if x.kind == "FIELD" and x.start == start:
                x.end = max(x.end, m.end)

    def _type_arguments(self) -> bool:
        """If the '<' just taken opens type arguments: only names, commas, dots, brackets and bounds up to its '>'."""
        k, depth = self.i, 1
        while k < len(self.t) and depth:
            x, kind = self.t[k][1], self.t[k][0]
            if x == "<":
                depth += 1
            elif x == ">":
                depth -= 1
            elif kind != "id" and x not in (",", ".", "?", "[", "]", "&", "@"):
                return False
            k += 1
        return depth == 0 and k < len(self.t) and self.t[k][1] in ("(", "::", ")", ",", ";", "{", ".")

    def rest_of_method(self, m: Member) -> None:
        if self.at() == "(":
            self.take("(")
            while self.at() != ")":
                self.modifiers()
                kind = self.type()
                many = self.at() == "..." and bool(self.take())
                name = self.name()
                while self.at() == "[":
                    self.i += 2
                    kind += "[]"
                if name != "this":
                    m.params.append((kind, name, many))
                if self.at() == ",":
                    self.i += 1
            self.take(")")
        while self.at() == "[":
            self.i += 2
            m.type = (m.type or "") + "[]"
        if self.at() == "throws":
            self.i += 1
            m.throws = [t for t, _ in self.type_list()]
        if self.at() == "{":
            m.body = self.skip("{", "}")
            m.end = self.t[self.i - 1][2]
            return
        while self.at() != ";":  # an annotation member's default
            if self.at() in "([{":
                self.skip(self.at(), {"(": ")", "[": "]", "{": "}"}[self.at()])
            else:
                self.take()
        m.end = self.line()
        self.take(";")


class Extractor:
    """Rows of one file."""

    def __init__(self, repo_id: str, file_id: str, source: str):
        self.repo, self.file = repo_id, file_id
        self.symbols, self.edges, self.annotations, self.imports, self.facts = [], [], [], [], []
        self.p = Parser(source)
        self.known = {n.rsplit(".", 1)[-1]: n for n, _, wild in self.p.imports if not wild and "." in n}
        for k, (n, static, wild) in enumerate(self.p.imports):
            self.imports.append({"id": f"{file_id}!{k:05d}", "file_id": file_id, "fqn": n, "is_static": static, "is_wildcard": wild})
        self.local: dict[str, str] = {}
        for td in self.p.types:
            self._names(td, None)
        for td in self.p.types:
            self._type(td, None)
        said = {f["edge_id"] for f in self.facts}
        for e in self.edges:  # as parsed, for builds that open them again
            if e["id"] not in said:
                self.fact("edge", id=e["id"], edge_id=e["id"], level=0, was_fqn=e["dst_fqn"], was_kind=e["kind"], was_resolution=e["resolution"])

    def _names(self, td: TypeDecl, outer: str | None) -> None:
        fqn = f"{outer or self.p.package}.{td.name}" if outer or self.p.package else td.name
        self.local.setdefault(td.name, fqn)
        for n in td.nested:
            self._names(n, fqn)

    def resolve(self, name: str) -> str:
        """A type's full name from a simple one."""
        name = param_type(name).split("[")[0] if "." not in re.sub(r"<.*>", "", name) else re.sub(r"<.*>|\[\]", "", name)
        if "." in name:
            head, _, rest = name.partition(".")
            return f"{self.known.get(head) or self.local.get(head)}.{rest}" if head in self.known or head in self.local else name
        if name in self.known:
            return self.known[name]
        if name in self.local:
            return self.local[name]
        if name in JAVA_LANG:
            return "java.lang." + name
        return f"{self.p.package}.{name}" if self.p.package else name

    def symbol(self, **values) -> dict:
        row = dict.fromkeys(SYMBOLS.names) | {"id": f"{self.file}#{len(self.symbols):05d}", "repo_id": self.repo, "file_id": self.file, "package": self.p.package} | values
        self.symbols.append(row)
        return row

    def edge(self, src: dict, kind: str, fqn: str | None, member: str | None, line: int, resolution: str | None = None, params: str | None = None) -> None:
        self.edges.append({"id": f"{self.file}@{len(self.edges):06d}", "repo_id": self.repo, "src_symbol_id": src["id"], "dst_symbol_id": None, "dst_fqn": fqn, "dst_member": member, "kind": kind, "file_id": self.file, "line": line, "resolution": resolution or ("heuristic" if fqn else "unresolved"), "param_types": params})

    def fact(self, kind: str, **values) -> None:
        self.facts.append(dict.fromkeys(FACTS.names) | {"repo_id": self.repo, "file_id": self.file, "kind": kind} | values)

    def canonical(self, text: str | None, variables: dict[str, str]) -> str:
        """A type with full names, its arguments alike; variables by their marks, and ? for what nothing is known of."""
        text = re.sub(r"@[\w.]+(\([^)]*\))?", "", text or "").strip()
        bound = re.match(r"\?\s*(?:extends|super)\s+(.*)", text, re.S)
        name, arguments = type_arguments(bound[1] if bound else text)
        base, dims = name.split("[")[0].strip(), name.count("[")
        if base in variables:
            out = variables[base]
        elif not base or base in ("?", "var"):
            out = "?"
        else:
            out = base if base in _PRIMITIVE else self.resolve(base)
            out += f"<{','.join(self.canonical(a, variables) for a in arguments)}>" if arguments else ""
        return out + "[]" * dims

    def marks(self, target: dict, found: list[tuple[str, int]]) -> None:
        for name, line in found:
            fqn = self.resolve(name)
            self.annotations.append({"id": f"{self.file}%{len(self.annotations):05d}", "symbol_id": target["id"], "name": name, "fqn": fqn, "args_json": None})
            self.edge(target, "ANNOTATED_WITH", fqn, None, line)

    def _type(self, td: TypeDecl, parent: dict | None, around: tuple[str, ...] = ()) -> None:
        fqn = f"{parent['fqn']}.{td.name}" if parent else f"{self.p.package}.{td.name}" if self.p.package else td.name
        bare = lambda types: [re.sub(r"<.*>", "", t).rsplit(".", 1)[-1] for t, _ in types]
        role = first_role([n for n, _ in td.annotations], bare(td.extends), bare(td.implements))
        s = self.symbol(kind=td.kind, simple_name=td.name, fqn=fqn, parent_id=parent and parent["id"], modifiers=",".join(td.modifiers) or None, framework_role=role, start_line=td.start, end_line=td.end)
        self.marks(s, td.annotations)
        if td.kind in ("CLASS", "INTERFACE"):
            for kind, types in (("EXTENDS", td.extends), ("IMPLEMENTS", td.implements)):
                for name, line in types:
                    self.edge(s, kind, self.resolve(name), None, line)
        marks = {v: f"#{k};" for k, v in enumerate(td.variables)}
        own = fqn + (f"<{','.join(marks.values())}>" if marks else "")
        self.fact("type", owner=fqn, arity=len(td.variables))
        for k, (name, _) in enumerate([*td.extends, *td.implements]):
            self.fact("super", owner=fqn, level=k, type=self.canonical(name, marks))
        for m in td.members:
            if m.kind in ("METHOD", "FIELD"):
                known = marks | dict.fromkeys(m.variables, "?")
                static = "static" in m.modifiers or td.kind == "INTERFACE" and m.kind == "FIELD"
                types = [self.canonical(t, known) for t, _, _ in m.params]
                self.fact(m.kind.lower(), id=f"{fqn}#{m.name}", owner=fqn, name=m.name, arity=len(types) if m.kind == "METHOD" else None, many=any(x for _, _, x in m.params), static=static, type=self.canonical(m.type, known), params="|".join(types))
        fields = {m.name: m.type for m in td.members if m.kind == "FIELD"}
        methods = {m.name for m in td.members if m.kind == "METHOD"}
        statics = {m.name for m in td.members if m.kind == "METHOD" and "static" in m.modifiers}
        for m in (x for x in td.members if x.kind == "FIELD"):
            f = self.symbol(kind="FIELD", simple_name=m.name, fqn=f"{fqn}.{m.name}", parent_id=s["id"], signature=f"{m.type} {m.name}", return_type=m.type, modifiers=",".join(m.modifiers) or None, start_line=m.start, end_line=m.end)
            self.marks(f, m.annotations)
        for kind in () if td.kind == "ANNOTATION_TYPE" else ("METHOD", "CONSTRUCTOR"):  # members of annotation types are no methods
            for m in (x for x in td.members if x.kind == kind):
                params = ", ".join(f"{t}{'...' if many else ''} {n}" for t, n, many in m.params)
                head = " ".join([*m.modifiers, *([m.type] if kind == "METHOD" else []), f"{m.name if kind == 'METHOD' else td.name}({params})"])
                row = self.symbol(
                    kind=kind, simple_name=m.name, fqn=f"{fqn}#{m.name}", parent_id=s["id"], return_type=m.type, modifiers=",".join(m.modifiers) or None, start_line=m.start, end_line=m.end,
                    signature=head + (" throws " + ", ".join(m.throws) if m.throws else ""), framework_role=method_role([n for n, _ in m.annotations], role, m.name) if kind == "METHOD" else None,
                    param_types=",".join(param_type(t) + ("..." if many else "") for t, _, many in m.params) if kind == "CONSTRUCTOR" else None,
                )
                self.marks(row, m.annotations)
                if kind == "METHOD":
                    for t in m.throws:
                        self.edge(row, "THROWS", self.resolve(t), None, m.start)
                if m.body:
                    Body(self, row, s, td, fields, methods, statics, m, (own, *around)).scan()
        if td.kind in ("CLASS", "ENUM", "RECORD") and not any(m.kind == "CONSTRUCTOR" for m in td.members):
            self.symbol(kind="CONSTRUCTOR", simple_name="<init>", fqn=f"{fqn}#<init>", parent_id=s["id"], signature=f"{td.name}()", param_types="", modifiers="synthetic", start_line=td.start, end_line=td.start)
        for n in td.nested:
            self._type(n, s, (own, *around))


def first_role(annotations: list[str], extended: list[str], implemented: list[str]) -> str | None:
    """As roles.type_role, for lists."""
    tables = ((annotations, R.TYPE_ANNOTATIONS), (extended, dict.fromkeys(R.SERVLETS, "SERVLET")), (implemented, dict.fromkeys(R.FILTERS, "FILTER") | dict.fromkeys(R.LISTENERS, "LISTENER") | dict.fromkeys(R.REPOSITORIES, "JPA_REPOSITORY")), (extended, dict.fromkeys(R.REPOSITORIES, "JPA_REPOSITORY")))
    return next((table[n] for names, table in tables for n in names if n in table), None)


def method_role(annotations: list[str], owner: str | None, name: str) -> str | None:
    found = next((R.METHOD_ANNOTATIONS[n] for n in annotations if n in R.METHOD_ANNOTATIONS), None)
    return found or ("HTTP_ENDPOINT" if owner == "SERVLET" and name in R.SERVLET_METHODS else None)


class Body:
    """Edges of one method's or constructor's body."""

    def __init__(self, x: Extractor, row: dict, owner: dict, td: TypeDecl, fields: dict, methods: set, statics: set, m: Member, around: tuple[str, ...] = ()):
        #: The enclosing types, the innermost first, with their parameters' marks.
        self.around = around or (owner["fqn"],)
        self.variables = {v: f"#{k};" for k, v in enumerate(td.variables)} | dict.fromkeys(m.variables, "?")
        self.x, self.row, self.owner, self.td, self.methods, self.statics, self.m = x, row, owner, td, methods, statics, m
        self.fields = fields
        self.vars = {n: t + ("[]" if many else "") for t, n, many in m.params}
        #: Names whose type is that of an expression: name, tokens where this holds, expression.
        self.inferred: list[tuple[str, int, int, str]] = []
        self.t = x.p.t[m.body[0] : m.body[1]]

    def tok(self, i: int) -> str:
        return self.t[i][1] if 0 <= i < len(self.t) else ""

    def is_name(self, i: int) -> bool:
        return 0 <= i < len(self.t) and self.t[i][0] == "id"

    def type_at(self, i: int) -> tuple[str, int] | None:
        """A type written from token i on, and where it ends; None if there is none."""
        if not self.is_name(i) or self.tok(i) in _NO_CALL:
            return None
        out, i = self.tok(i), i + 1
        while True:
            if self.tok(i) == "." and self.is_name(i + 1):
                out, i = f"{out}.{self.tok(i + 1)}", i + 2
            elif self.tok(i) == "<":
                depth, k, text = 0, i, ""
                while k < len(self.t):
                    v = self.tok(k)
                    depth += (v == "<") - (v == ">")
                    text += v
                    k += 1
                    if depth == 0:
                        break
                    if not (self.is_name(k - 1) or v in "<>,.?&[]@"):
                        return None
                if depth:
                    return None
                out, i = out + text, k
            elif self.tok(i) == "[" and self.tok(i + 1) == "]":
                out, i = out + "[]", i + 2
            else:
                return out, i

    def declare(self) -> None:
        """Note local variables: a type, a name, then one of = ; : , )."""
        i = 0
        while i < len(self.t):
            if self.tok(i - 1) not in (".", "new") and (found := self.type_at(i)):
                kind, j = found
                if self.is_name(j) and self.tok(j + 1) in ("=", ";", ":", ",", ")") and self.tok(i) not in ("return", "throw", "package", "else"):
                    if kind == "var" and self.tok(j + 1) == "=" and self.tok(j + 2) == "new" and (made := self.type_at(j + 3)):
                        kind = made[0]
                    if kind not in ("var", "instanceof"):
                        self.vars.setdefault(self.tok(j), kind)
                    elif kind == "var" and self.tok(j + 1) == "=" and (end := self._statement(j + 2)) and (made := self._ends(end)):
                        self.inferred.append((self.tok(j), end, len(self.t), made))
                    i = j
            i += 1

    def _statement(self, i: int) -> int | None:
        """The token of the semicolon that ends the expression from token i on, if braces don't come first."""
        while i < len(self.t) and self.tok(i) not in (";", "{", "}"):
            i += 1
        return i if self.tok(i) == ";" else None

    def _opening(self, k: int) -> int:
        """The bracket that the one at token k closes, or -1."""
        depth = 0
        while k >= 0:
            depth += (self.tok(k) in (")", "]")) - (self.tok(k) in ("(", "["))
            if depth == 0:
                return k
            k -= 1
        return -1

    def key(self, i: int) -> str:
        """The expression whose last name is token i."""
        return f"{self.row['id']}:{i}"

    def _ends(self, end: int) -> str | None:
        """The call or field access that ends before token end."""
        k = end - 1
        if self.tok(k) == ")":
            j = self._opening(k) - 1
            return self.key(j) if self.is_name(j) and self.tok(j) not in _NO_CALL and not self._in_new(j) else None
        return self.key(k) if self.is_name(k) and self.tok(k - 1) == "." else None

    def lambdas(self) -> None:
        """Note parameters without types of lambdas among a call's arguments: they have what the called method says."""
        for i in range(len(self.t)):
            if not (self.is_name(i) and self.tok(i + 1) == "(" and self.tok(i) not in _NO_CALL and not self._in_new(i)):
                continue
            for place, (a, b) in enumerate(self._arguments(i + 1)):
                names = [self.tok(a)] if self.is_name(a) and self.tok(a + 1) == "->" else []
                if self.tok(a) == "(":
                    close = next((k for k in range(a, b) if self.tok(k) == ")"), b)
                    if self.tok(close + 1) == "->":
                        names = [self.tok(k) for k in range(a + 1, close, 2)] if all(self.is_name(k) for k in range(a + 1, close, 2)) and all(self.tok(k) == "," for k in range(a + 2, close, 2)) else []
                for k, name in enumerate(names):
                    key = f"{self.key(i)}:{place}:{k}"
                    self.inferred.append((name, a, b, key))
                    self.x.fact("lambda", id=key, ref=self.key(i), level=place, arity=k)

    def _arguments(self, i: int) -> list[tuple[int, int]]:
        """Token ranges of the arguments in the brackets opened at token i."""
        out, k, depth, start = [], i + 1, 1, i + 1
        while k < len(self.t):
            v = self.tok(k)
            if v == "<" and (found := self.type_at(k - 1)) and found[1] > k:
                k = found[1]
                continue
            depth += (v in ("(", "[", "{")) - (v in (")", "]", "}"))
            if depth == 0 or depth == 1 and v == ",":
                if k > start:
                    out.append((start, k))
                start = k + 1
            if depth == 0:
                break
            k += 1
        return out

    def inferred_of(self, name: str, k: int) -> str | None:
        """The expression that gives the type of a name at token k, by the innermost place that declares it."""
        found = [(b - a, key) for n, a, b, key in self.inferred if n == name and a <= k < b]
        return min(found)[1] if found else None

    def receiver(self, i: int) -> list[tuple[str | None, str | None]]:
        """What stands before the dot at token i, as a type or an expression's key."""
        k = i - 1
        name, canonical = self.tok(k), lambda t: self.x.canonical(t, self.variables)
        if name == "this":
            return [(self.around[0], None)]
        if name == "super":
            return [(canonical(t), None) for t, _ in self.td.extends[:1]]
        if self.t[k][0] == "text":
            return [("java.lang.String", None)]
        if name in (")", "]"):
            j = self._opening(k)
            if name == "]":
                declared = self.is_name(j - 1) and self.tok(j - 2) != "." and self.type_of(self.tok(j - 1))
                return [(canonical(declared[:-2]), None)] if declared and declared.endswith("[]") else []
            if key := self._ends(k + 1):
                return [(None, key)]
            if self.is_name(j - 1) or self.tok(j - 1) == ">":
                while j > 0 and self.tok(j) != "new":
                    j -= 1
                made = self.type_at(j + 1) if self.tok(j) == "new" else None
                return [(canonical(made[0]), None)] if made else []
            if self.tok(j + 1) == "(" and (cast := self.type_at(j + 2)) and self.tok(cast[1]) == ")":
                return [(canonical(cast[0]), None)]
            return [(None, key)] if (key := self._ends(k)) else []
        if not self.is_name(k):
            return []
        if self.tok(k - 1) == ".":
            if name[:1].isupper() and self.tok(k - 2) != "this":
                return []  # a type's full name
            return [(None, self.key(k))]
        if key := self.inferred_of(name, k):
            return [(None, key)]
        if declared := self.type_of(name):
            return [(canonical(declared), None)]
        if name in self.x.known or name in self.x.local or name[:1].isupper():
            return [(self.x.resolve(name), None)]
        # A field of a supertype or of an enclosing type.
        for level, own in enumerate(self.around):
            self.x.fact("read", id=self.key(k), owner=self.around[0].split("<")[0], name=name, level=level, type=own)
        return [(None, self.key(k))]

    def expression(self, i: int, kind: str, found: list[tuple[str | None, str | None]]) -> None:
        """Note the expression whose name is token i, with the edge just made."""
        e, count = self.x.edges[-1], len(self._arguments(i + 1)) if kind == "call" else None
        for level, (type_, ref) in enumerate(found):
            self.x.fact(kind, id=self.key(i), edge_id=e["id"], owner=self.owner["fqn"], name=self.tok(i), level=level, arity=count, type=type_, ref=ref, was_fqn=e["dst_fqn"], was_kind=e["kind"], was_resolution=e["resolution"])

    def type_of(self, name: str) -> str | None:
        return self.vars.get(name) or self.fields.get(name)

    def full(self, kind: str | None) -> str | None:
        base = param_type(kind or "").split("[")[0]
        return None if not base or base in _PRIMITIVE or (kind or "").endswith("]") else self.x.resolve(kind)

    def scope(self, i: int) -> tuple[str | None, str, bool]:
        """What stands before the dot at token i: (full type, resolution, is a type's name)."""
        k = i - 1
        name = self.tok(k)
        if name == "this":
            return self.owner["fqn"], "ast", False
        if name == "super":
            return (self.x.resolve(self.td.extends[0][0]), "ast", False) if self.td.extends else (None, "unresolved", False)
        if self.t[k][0] == "text":
            return "java.lang.String", "ast", False
        if not self.is_name(k):
            if name == ")":
                return self.made(k)
            return None, "unresolved", False
        if self.tok(k - 1) == ".":
            if self.tok(k - 2) == "this" and name in self.fields:
                full = self.full(self.fields[name])
                return full, "ast" if full else "unresolved", False
            chain, j = [name], k
            while self.tok(j - 1) == "." and self.is_name(j - 2):
                chain.insert(0, self.tok(j - 2))
                j -= 2
            if name[:1].isupper() and not self.type_of(chain[0]):
                return ".".join(chain) if chain[0][:1].islower() else self.x.resolve(".".join(chain)), "heuristic", True
            return None, "unresolved", False
        if declared := self.type_of(name):
            full = self.full(declared)
            return full, "ast" if full else "unresolved", False
        if name in self.x.known:
            return self.x.known[name], "ast", True
        if name in self.x.local:
            return self.x.local[name], "ast", True
        if name[:1].isupper():
            return self.x.resolve(name), "heuristic", True
        return None, "unresolved", False

    def made(self, k: int) -> tuple[str | None, str, bool]:
        """The type of `new T(...)` that ends at the bracket k."""
        depth = 0
        while k >= 0:
            depth += (self.tok(k) == ")") - (self.tok(k) == "(")
            k -= 1
            if depth == 0:
                break
        j = k
        while j >= 0 and (self.is_name(j) or self.tok(j) in ".<>,"):
            if self.tok(j) == "new":
                found = self.type_at(j + 1)
                return (self.x.resolve(found[0]), "ast", False) if found else (None, "unresolved", False)
            j -= 1
        return None, "unresolved", False

    def arguments(self, i: int) -> str | None:
        """Types of the arguments in the brackets opened at token i, where all are plain; '' without any."""
        if self.tok(i + 1) == ")":
            return ""
        out, k, depth, part = [], i + 1, 1, []
        while k < len(self.t) and depth:
            v = self.tok(k)
            depth += (v in "([{") - (v in ")]}") if len(v) == 1 else 0
            if depth == 0 or (depth == 1 and v == ","):
                out.append(part)
                part = []
            else:
                part.append(self.t[k])
            k += 1
        kinds = [self.argument(p) for p in out]
        return ",".join(kinds) if all(kinds) else None

    def argument(self, part: list) -> str | None:
        if len(part) == 1:
            kind, text, _ = part[0]
            if kind == "text":
                return "String"
            if kind == "char":
                return "char"
            if kind == "num":
                end = text[-1].lower()
                return "long" if end == "l" else "float" if end == "f" and not text.lower().startswith("0x") else "double" if "." in text or end == "d" and not text.lower().startswith("0x") else "int"
            if text in ("true", "false"):
                return "boolean"
            if text == "this":
                return self.td.name
            declared = self.type_of(text)
            return param_type(declared) if declared else None
        if part and part[0][1] == "new" and part[-1][1] == ")" and len(part) > 2 and part[1][0] == "id":
            return part[1][1]
        if part and all(p[0] == "text" or p[1] == "+" for p in part):
            return "String"
        return None

    def scan(self) -> None:
        self.declare()
        self.lambdas()
        x, row, owner = self.x, self.row, self.owner
        for i, (kind, text, line) in enumerate(self.t):
            if text == "new" and kind == "id":
                if (found := self.type_at(i + 1)) and self.tok(found[1]) == "(":
                    x.edge(row, "NEW", x.resolve(found[0]), "<init>", line, None, self.arguments(found[1]))
                continue
            if text in ("this", "super") and self.tok(i + 1) == "(" and self.m.kind == "CONSTRUCTOR" and self.tok(i - 1) in ("", ";", "{", "}"):
                target = owner["fqn"] if text == "this" else x.resolve(self.td.extends[0][0]) if self.td.extends else None
                x.edge(row, "NEW", target, "<init>", line, "ast" if target else "unresolved", self.arguments(i + 1) if target else None)
                continue
            if kind != "id" or text in _NO_CALL:
                continue
            before, after = self.tok(i - 1), self.tok(i + 1)
            if after == "(" and not self._in_new(i):
                if before == ".":
                    fqn, resolution, is_type = self.scope(i - 1)
                    x.edge(row, "STATIC_CALL" if is_type and resolution == "ast" else "CALLS", fqn, text, self._first_line(i), resolution)
                    self.expression(i, "call", self.receiver(i - 1))
                elif before != "::" and before != "@":
                    static = text in self.statics
                    x.edge(row, "STATIC_CALL" if static else "CALLS", owner["fqn"], text, line, "ast" if text in self.methods else "heuristic")
                    self.expression(i, "call", [(own, None) for own in self.around])
            elif before == "." and not self._in_new(i) and after != "(":
                if self.is_name(i - 2) or self.tok(i - 2) in (")", "]"):
                    fqn, resolution, _ = self.scope(i - 1)
                    x.edge(row, "FIELD_WRITE" if after in _ASSIGN else "FIELD_READ", fqn, text, self._first_line(i), resolution if fqn else "unresolved")
                    self.expression(i, "read", self.receiver(i - 1))
            elif after in _ASSIGN and before not in (".", "@") and not self._declares(i):
                x.edge(row, "FIELD_WRITE", owner["fqn"], text, line)

    def _first_line(self, i: int) -> int:
        """The line where a plain chain that ends at token i begins."""
        while self.tok(i - 1) == "." and self.is_name(i - 2):
            i -= 2
        return self.t[i][2]

    def _in_new(self, i: int) -> bool:
        """If token i is part of a created type's name."""
        while self.tok(i - 1) == "." and self.is_name(i - 2):
            i -= 2
        return self.tok(i - 1) == "new"

    def _declares(self, i: int) -> bool:
        return self.is_name(i - 1) and self.tok(i - 1) not in ("return", "else", "do", "case", "yield") or self.tok(i - 1) in ("]", ">") and self.tok(i) in self.vars or self._in_annotation(i)

    def _in_annotation(self, i: int) -> bool:
        return self.tok(i - 1) == "(" and self.is_name(i - 2) and self.tok(i - 3) == "@"


def _arrow(schema) -> pa.DataType:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    return pa.struct([(f.name, kinds[f.dataType.simpleString()]) for f in schema.fields])


_PARTS = {"symbol": SYMBOLS, "edge": EDGES, "annotation": ANNOTATIONS, "import": IMPORTS, "fact": FACTS}
PARSED = "file_id string, parsed boolean, " + ", ".join(f"`{n}` {s.simpleString()}" for n, s in _PARTS.items())


#: Rows of a batch that goes back to Spark.
BATCH_ROWS = 4096


def _parser(parts: tuple[str, ...]):
    kinds = {p: _arrow(_PARTS[p]) for p in parts}

    def batch_of(rows: list[tuple[str, bool, str, dict | None]]) -> pa.RecordBatch:
        columns = [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.bool_())]
        columns += [pa.array([r[3] if r[2] == name else None for r in rows], kind) for name, kind in kinds.items()]
        return pa.RecordBatch.from_arrays(columns, ["file_id", "parsed", *parts])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for repo, file, content in zip(*(batch.column(c).to_pylist() for c in ("repo_id", "file_id", "content")), strict=True):
                try:
                    x = Extractor(repo, file, content or "")
                    found = {"symbol": x.symbols, "edge": x.edges, "annotation": x.annotations, "import": x.imports, "fact": x.facts}
                    ok = True
                except (ParseError, RecursionError, IndexError):
                    found, ok = {}, False
                before = len(rows)
                rows += [(file, ok, name, r) for name in parts for r in found.get(name, ())]
                if len(rows) == before:
                    rows.append((file, ok, "", None))
                if len(rows) >= BATCH_ROWS:
                    yield batch_of(rows)
                    rows = []
        if rows:
            yield batch_of(rows)

    return parse


def parse_java(files: DataFrame, parts: tuple[str, ...] = tuple(_PARTS)) -> DataFrame:
    """Rows of all files (repo_id, file_id, content: text), tagged by the part that is not null. A file that can't be parsed gives one row with parsed false,
    one without rows of these parts one row of nulls.

    Parsing takes far longer than reading, so files are dealt to several tasks a core first, however few splits their table has.
    """
    spark = files.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    schema = "file_id string, parsed boolean" + "".join(f", `{n}` {_PARTS[n].simpleString()}" for n in parts)
    return files.select("repo_id", "file_id", "content").repartition(tasks, "repo_id", "file_id").mapInArrow(_parser(parts), schema)


def part(parsed: DataFrame, name: str) -> DataFrame:
    """The symbols, edges, annotations, imports or facts of parsed files."""
    return parsed.where(F.col(name).isNotNull()).select(f"{name}.*")
