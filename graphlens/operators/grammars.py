"""Definitions, calls, imports and assignments out of Java, C#, Go, Rust, PHP and Ruby: one walk over tokens, driven by a table for each language.

A call's callee is its source text from the first name of the chain on; definitions in a class (or what stands for one: struct, trait, module, the type
of an impl, a receiver's type) are methods and bear its name. Calls belong to the innermost definition around them, or to the module.
"""

from __future__ import annotations

from dataclasses import dataclass

from graphlens.functions.hosts import authority
from graphlens.operators.lexer import MAX_ARG, Lexicon, Tokens

_SLASHES = r"\s+|//[^\n]*|/\*.*?(?:\*/|\Z)"
_QUOTED = r"\"(?:\\.|[^\"\\\n])*\""
_WORD = r"[A-Za-z_\u0080-￿][\w\u0080-￿]*"
_LIFETIME = r"'(?:\\[^']*|[^'\\\n])'"


OPAQUE = "<expr>"


@dataclass(frozen=True)
class Grammar:
    """lexicon: how tokens look. classes, functions: words before the name of a definition. joints: marks inside a dotted name. imports: words that begin an import. no_call: words before a bracket that call nothing. shaped: methods have no word of their own but a shape (a type, a name, parameters, a body). made: objects made with `new` are no calls. requires: calls that import their string."""

    lexicon: Lexicon
    classes: frozenset[str]
    functions: frozenset[str]
    joints: tuple[str, ...]
    imports: frozenset[str]
    no_call: frozenset[str]
    shaped: bool = False
    made: bool = False
    requires: frozenset[str] = frozenset()


def _words(text: str) -> frozenset[str]:
    return frozenset(text.split())


#: Fixed values of the languages.
GRAMMARS = {
    "java": Grammar(
        Lexicon(_SLASHES, r'"""(?:\\.|[^\\])*?"""|' + _QUOTED + r"|'(?:\\.|[^'\\\n])*'", r"[A-Za-z_$\u0080-￿][\w$\u0080-￿]*", r"->|::|\.\.\."),
        _words("class interface enum"), _words(""), (".",), _words("import"), _words("if for while switch catch synchronized try return throw assert do else case super this new yield"), shaped=True, made=True,
    ),
    "csharp": Grammar(
        Lexicon(_SLASHES + r"|\#[^\n]*", r'"""(?:[^"]|"(?!""))*"""|@"(?:""|[^"])*"|' + _QUOTED + r"|'(?:\\.|[^'\\\n])*'", r"@?" + _WORD, r"=>|::|\?\.|\?\?", holes=(('$"', r'(?:\\.|\{\{|[^"\\{\n])*', '"', "{"), ('$@"', r'(?:""|\{\{|[^"{])*', '"', "{"), ('@$"', r'(?:""|\{\{|[^"{])*', '"', "{"))),
        _words("class interface struct"), _words(""), (".", "?.", "::"), _words("using"), _words("if for foreach while switch catch using lock return throw fixed checked unchecked base this new await when in is as else do case"), shaped=True, made=True,
    ),
    "go": Grammar(
        Lexicon(_SLASHES, r"`[^`]*`|" + _QUOTED + r"|'(?:\\.|[^'\\\n])*'", _WORD, r":=|<-|\.\.\."),
        _words(""), _words("func"), (".",), _words("import"), _words("if for switch select return go defer range case func map chan interface struct else var const type import"),
    ),
    "rust": Grammar(
        Lexicon(_SLASHES, r"b?r(?P<fence>\#*)\".*?\"(?P=fence)|b?\"(?:\\.|[^\"\\])*\"|b?" + _LIFETIME, r"r\#[A-Za-z_]\w*|'?" + _WORD, r"::|->|=>|\.\.=?"),
        _words("struct enum trait"), _words("fn"), (".", "::"), _words("use"), _words("if for while match return loop in fn let else move as impl where pub mut ref"),
    ),
    "php": Grammar(
        Lexicon(r"\s+|//[^\n]*?(?=\n|\?>|\Z)|\#(?!\[)[^\n]*?(?=\n|\?>|\Z)|/\*.*?(?:\*/|\Z)|\?>.*?(?:<\?(?:php\b|=)|\Z)", r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'", r"\$?[A-Za-z_\\\u0080-￿][\w\\\u0080-￿]*", r"\?->|->|=>|::|\.\.\.", before=r".*?(?:<\?(?:php\b|=)|\Z)"),
        _words("class interface"), _words("function"), ("->", "?->", "::"), _words("use"), _words("if for foreach while switch match catch return function fn array list isset unset empty exit die echo print elseif declare new"), made=True, requires=_words("require require_once include include_once"),
    ),
    "ruby": Grammar(
        Lexicon(
            r"\s+|\#[^\n]*|(?<![^\n])=begin\b.*?(?:\n=end[^\n]*|\Z)", r"'(?:\\.|[^'\\])*'|<<[~-]?(?P<quote>[\"'`]?)(?P<doc>[A-Z_]\w*)(?P=quote).*?\n\s*(?P=doc)\b|%[wWiI]\[[^\]]*\]|:\"(?:\\.|[^\"\\])*\"", r":?[@$]{0,2}" + _WORD + r"[?!]?(?!=[^=~>])|:?[@$]{0,2}" + _WORD, r"&\.|::|=>|->|\*\*|==|!=|<=|>=|&&|\|\||[-+*/|&<]=|<<",
            holes=(('"', r'(?:\\.|\#(?!\{)|[^"\\#])*', '"', "#{"),), value_next=_words("if unless while until and or not return when then else elsif puts in do"), pattern=r"/(?! )(?:\\.|[^/\\\n])+/[a-z]*",
        ),
        _words("class module"), _words("def"), (".", "&.", "::"), _words(""), _words("if unless while until for case when return yield and or not in do end elsif else begin rescue ensure then def class module super self nil true false alias undef defined? next break redo retry"), requires=_words("require require_relative"),
    ),
}
_READY = {name: g.lexicon.compiled() for name, g in GRAMMARS.items()}
#: Ruby's words that an `end` closes; those of the second set only where a statement begins.
_OPENS, _OPENS_FIRST = _words("class module def do begin case for"), _words("if unless while until")
#: Words that no type is: before a name with a bracket they make no definition.
_NO_TYPE = _words("return new throw await else in is as case yield out ref when and or not do go defer")


class _Source(Tokens):
    def __init__(self, file: str, text: str, language: str):
        self.language, self.grammar = language, GRAMMARS[language]
        super().__init__(file, text, self.grammar.lexicon, _READY[language])
        self.ends = self._ends() if language == "ruby" else {}
        #: By first token of a body: (its last token, "class" or "function", name of the class or qualified name of the function).
        self.begins: dict[int, list[tuple[int, str, str]]] = {}
        self.scopes: list[tuple[int, str, str]] = []
        self.firsts: dict[int, int] = {}
        self.taken: set[int] = set()

    def _ends(self) -> dict[int, int]:
        """Ruby: the `end` of each word that needs one."""
        out, open_, loop = {}, [], -1
        for i, x in enumerate(self.tok):
            if self.kind[i] != "name" or self.is_mark(i - 1, ".", "&.") or self.is_mark(i + 1, ":") and self.at[i + 1] == self.at[i] + len(x) and not self.is_mark(i + 2, ":"):
                continue
            first = self.new_line(i) or self.is_mark(i - 1, ";", "=", "(", "{", "|", "[", "||", "&&", "=>", "<<") or self.word(i - 1, "then", "else", "do", "begin", "return", "and", "or", "not", "in")
            if x == "do" and loop >= 0 and self.place(loop)[0] == self.place(i)[0]:
                loop = -1
            elif x == "def" and self._endless(i):
                continue
            elif x in _OPENS or x in _OPENS_FIRST and first:
                open_.append(i)
                loop = i if x in ("while", "until", "for") else loop
            elif x == "end" and open_:
                out[open_.pop()] = i
        return out

    def _endless(self, i: int) -> int:
        """Ruby: the token behind the `=` of `def name(...) = value`, 0 if the definition has an end; the `=` of a name like size= is no such."""
        j = i + 2 + 2 * self.is_mark(i + 2, ".")
        deep = 0
        while self.is_mark(j, "(") or deep:
            deep += self.is_mark(j, "(") - self.is_mark(j, ")")
            j += 1
            if j >= len(self.tok):
                return 0
        setter = self.is_mark(j + 1, "(") and j + 1 < len(self.tok) and self.at[j + 1] == self.at[j] + 1 and self.at[j] == self.at[j - 1] + len(self.tok[j - 1])
        return j + 1 if self.is_mark(j, "=") and not self.new_line(j) and not setter else 0

    def _class_name(self) -> str | None:
        return next((name for _, kind, name in reversed(self.scopes) if kind == "class"), None)

    def _owner(self) -> str:
        return next((name for _, kind, name in reversed(self.scopes) if kind == "function"), f"{self.file}::<module>")

    def _statement(self, i: int) -> int:
        """The first token of the statement that token i stands in, past attributes and modifiers."""
        while i > 0 and not self.is_mark(i - 1, ";", "{", "}"):
            i = self.partner.get(i - 1, i - 1) if self.is_mark(i - 1, ")", "]") else i - 1
        return i

    def _until(self, i: int, *marks: str) -> int:
        """The next of these marks outside of brackets; the number of tokens if there is none."""
        while i < len(self.tok) and not self.is_mark(i, *marks):
            i = self.partner[i] + 1 if self.is_mark(i, "(", "[", "{") and i in self.partner else i + 1
        return i

    def _define(self, name: str, kind: str, cls: str | None, start: int, named: int, body: int, end: int) -> None:
        whole = f"{self.file}::{cls}.{name}" if cls and kind != "class" else f"{self.file}::{name}"
        self.add("definition", whole, name, kind, start, min(end, len(self.tok) - 1), named)
        self.taken.add(named)
        if body >= 0:
            self.begins.setdefault(body, []).append((end, "class", name) if kind == "class" else (end, "function", whole))

    def _body(self, i: int, cut: tuple[str, ...] = (";",)) -> tuple[int, int]:
        """(first, last token) of the body that begins with the next brace before a cut; (-1, the cut) if none does."""
        j = self._until(i, "{", "}", *cut)
        return (j, self.partner[j]) if self.is_mark(j, "{") and j in self.partner else (-1, j)

    def _class(self, i: int) -> bool:
        """A class-like definition whose word is token i."""
        ruby = self.language == "ruby"
        if self.is_mark(i - 1, ".", "@", "::", "->", "&.") or not self.word(i + 1) or ruby and self.is_mark(i + 1, "<<"):
            return False
        named = i + 1
        while ruby and self.is_mark(named + 1, "::") and self.word(named + 2):
            named += 2
        if ruby:
            end = self.ends.get(i, len(self.tok) - 1)
            self._define(self.text[self.at[i + 1] : self.at[named] + len(self.tok[named])], "class", None, i, named, named, end)
            return True
        body, end = self._body(i + 2)
        start = i - 1 if self.language == "rust" and self.word(i - 1, "pub") else i if self.language in ("rust", "php") else self._statement(i)
        self._define(self.tok[named], "class", None, start, named, body, end)
        return True

    def _function(self, i: int) -> bool:
        """A function or method whose word is token i."""
        named, cls = i + 1, self._class_name()
        if self.language == "go":
            cls = None
            if self.is_mark(named, "(") and named in self.partner and self.word(self.partner[named] + 1) and self.is_mark(self.partner[named] + 2, "(", "["):
                k = next((k for k in range(self.partner[named] - 1, named, -1) if self.is_mark(k, "[")), self.partner[named])
                cls = self.tok[k - 1] if self.word(k - 1) else None
                named = self.partner[named] + 1
        if self.language == "ruby":
            if self.word(named, "self") and self.is_mark(named + 1, "."):
                named += 2
            if named >= len(self.tok):
                return False
            name = self.tok[named]
            end = self.ends.get(i, len(self.tok) - 1)
            if begin := self._endless(i):
                end = next((k for k in range(begin, len(self.tok)) if self.new_line(k)), len(self.tok)) - 1
            self._define(name, "method" if cls else "function", cls, i, named, named, end)
            return True
        named += self.is_mark(named, "&")
        if not self.word(named) or not self.is_mark(named + 1, "(", "<", "["):
            return False
        j = self._until(named + 1, "(")
        if j not in self.partner:
            return False
        body, end = self._body(self.partner[j] + 1)
        while self.language == "go" and body >= 0 and self.word(body - 1, "interface", "struct"):  # a type among the results
            body, end = self._body(end + 1)
        if body < 0 and self.language == "rust":
            self.taken.add(named)
            return True  # a signature alone
        start = i
        while self.word(start - 1, "pub", "async", "unsafe", "const", "extern", "public", "private", "protected", "static", "final", "abstract") or self.is_mark(start - 1, ")") and self.word(self.partner.get(start - 1, 0) - 1, "pub"):
            start = start - 1 if not self.is_mark(start - 1, ")") else self.partner[start - 1]
        self._define(self.tok[named], "method" if cls or self.language == "go" and named > i + 1 else "function", cls, start, named, body, end)
        return True

    def _impl(self, i: int) -> None:
        """Rust: what an impl's body defines belongs to its type."""
        j = i + 1
        if self.is_mark(j, "<"):
            deep = 0
            while j < len(self.tok):
                deep += self.is_mark(j, "<") - self.is_mark(j, ">")
                j += 1
                if not deep:
                    break
        body, end = self._body(j)
        if body < 0:
            return
        begin = next((k + 1 for k in range(body - 1, j - 1, -1) if self.word(k, "for") and not self.is_mark(k + 1, "<")), j)
        stop = next((k for k in range(begin, body) if self.word(k, "where")), body)
        self.begins.setdefault(body, []).append((end, "class", self.text[self.at[begin] : self.at[stop]].strip()))

    def _shaped(self, i: int, j: int) -> bool:
        """Java, C#: token i, before the bracket j, names a method or constructor: in a class's own body, or in C# a local function."""
        inside = self.scopes[-1] if self.scopes else None
        close = self.partner[j]
        typed = self.word(i - 1) and self.tok[i - 1] not in _NO_TYPE or self.is_mark(i - 1, ">", "]", "?")
        if not inside or inside[1] == "class":
            if not inside:
                return False
            start = self._statement(i)
            if not typed and self.tok[i] != inside[2] or self.is_mark(i - 1, "=", ".", "@", ",", "=>") or any(self.is_mark(k, "=", "=>") for k in range(start, i)):
                return False
        elif not (self.language == "csharp" and typed and (self.is_mark(close + 1, "{", "=>") or self.word(close + 1, "where"))):
            return False
        else:
            start = self._statement(i)
        k = self._until(close + 1, "{", ";", "=>", "}")
        if self.is_mark(k, "=>"):
            end = self._until(k + 1, ";")
            body = k
        elif self.is_mark(k, "{") and k in self.partner:
            body, end = k, self.partner[k]
        elif self.is_mark(k, ";") and inside[1] == "class":
            body, end = -1, k
        else:
            return False
        cls = self._class_name()
        self._define(self.tok[i], "method" if cls else "function", cls, start, i, body, end)
        # What stands between the parameters and the body (throws, base(...), where) calls nothing.
        self.taken.update(range(close + 1, max(body, close + 1)))
        return True

    def _joint(self, i: int) -> int:
        """The mark that joins name i to what stands before it (Java: also past a few type arguments), -1 if none does."""
        if self.language == "java" and self.is_mark(i - 1, ">"):
            k = next((k for k in range(i - 2, max(i - 20, 0), -1) if self.is_mark(k, "<") and self.is_mark(k - 1, ".")), 0)
            return k - 1 if k else -1
        return i - 1 if self.is_mark(i - 1, *self.grammar.joints) else -1

    def _chain(self, i: int) -> int:
        """The first token of the dotted name or chain of calls that ends with token i; each link is looked at once."""
        walked = []
        while i not in self.firsts and (j := self._joint(i)) >= 0:
            k = j - 1
            while self.is_mark(k, "?", "!") or self.is_mark(k, ")", "]", "}") and k in self.partner:
                k = self.partner[k] - 1 if k in self.partner else k - 1
            walked.append(i)
            if k < 0 or not (self.kind[k] in ("name", "text", "number") and self.tok[k] not in self.grammar.no_call or self.word(k, "this", "super", "self", "base")):
                i = min(k + 1, i)
                break
            i = k
        i = self.firsts.get(i, i)
        self.firsts.update(dict.fromkeys(walked, i))
        return i

    def _callee(self, first: int, i: int) -> str:
        """The source of a chain, or <expr> and its last name where that is longer than an argument may be."""
        n = self.at[i] + len(self.tok[i])
        return self.text[self.at[first] : n] if n - self.at[first] <= MAX_ARG else f"{OPAQUE}.{self.tok[i]}"

    def _import(self, i: int) -> int:
        """Imports of the statement that begins with token i; the token behind it."""
        if self.language == "go":
            group = self.is_mark(i + 1, "(")
            end = self.partner.get(i + 1, i) if group else next((k for k in (i + 1, i + 2) if k < len(self.tok) and self.kind[k] == "text"), i)
            for k in range(i + 1, end + 1):
                if self.kind[k] == "text":
                    self.add("import", self.tok[k].strip('"`'), i=k)
            return end
        end = self._until(i + 1, ";")
        self.add("import", " ".join(self.text[self.at[i] + len(self.tok[i]) : self.at[end] if end < len(self.tok) else len(self.text)].split()), i=i)
        return end

    def _call(self, i: int, j: int) -> None:
        """A call of the name at token i with the bracket at j."""
        first = self._chain(i)
        first -= self.grammar.made and self.word(first - 1, "new")
        self.add("call", self._owner(), self._callee(first, i), self.between(j, self.partner[j])[:MAX_ARG], first, None, i)
        if self.tok[i] in self.grammar.requires and j + 1 < len(self.tok) and self.kind[j + 1] == "text":
            self.add("import", self.tok[j + 1].strip("\"'"), i=i)

    def _command(self, i: int) -> None:
        """Ruby and PHP: a call without brackets: a method of a receiver, or a name before its arguments."""
        php = self.language == "php"
        dotted = self.is_mark(i - 1, ".", "&.") and not php
        here = i + 1 < len(self.tok) and not self.new_line(i + 1)
        argued = here and self.at[i + 1] > self.at[i] + len(self.tok[i]) and (self.kind[i + 1] in ("text", "number", "name") and self.tok[i + 1] not in self.grammar.no_call | {"="} or self.word(i + 1, "self", "nil", "true", "false", "defined?") or self.is_mark(i + 1, "<text>") or self.is_mark(i + 1, "[", "->", "::") and self.at[i + 2 : i + 3] == [self.at[i + 1] + len(self.tok[i + 1])])
        if php:
            argued = argued and self.tok[i] in self.grammar.requires
        if not (dotted or argued) or self.tok[i][:1] in ":@$" or self.is_mark(i + 1, "=") and here or (self.is_mark(i - 1, "::") and not argued) or argued and not dotted and self.tok[i][:1].isupper():
            return
        end = i
        if argued:
            end = i + 1
            while end < len(self.tok) and (end == i + 1 or not self.new_line(end) or self.is_mark(end - 1, ",")) and not self.is_mark(end, ";", ")", "]", "}", "{") and not self.word(end, "do", "if", "unless", "while", "until", "and", "or", "then"):
                end = self.partner.get(end, end) + 1
            end -= 1
        first = self._chain(i)
        arg = self.text[self.at[i + 1] : self.at[end] + len(self.tok[end]) if not self.is_mark(end, "</text>") else self.at[end] + 1].strip() if argued else ""
        self.add("call", self._owner(), self._callee(first, i), arg[:MAX_ARG], first, None, i)
        if self.tok[i] in self.grammar.requires and argued and self.kind[i + 1] == "text":
            self.add("import", self.tok[i + 1].strip("\"'"), i=i)

    def _assignment(self, i: int) -> None:
        """name = "text", name := "text", also as a constant or with a type before or behind."""
        j = i + 1
        if self.tok[i] in self.grammar.no_call or self.is_mark(i - 1, ":", "&", "<"):
            return
        if self.is_mark(j, ":") and not self.language == "go":
            j = next((k for k in range(j, min(j + 12, len(self.tok))) if self.is_mark(k, "=", ";", ",", "{", ")")), j)
        elif self.language == "go" and self.word(j) and not self.new_line(j):
            j += 1
        if not self.is_mark(j, "=", ":=") or self.is_mark(j + 1, "="):
            return
        k = j + 1
        text = self.tok[k] if k < len(self.tok) else ""
        ends = k + 1 >= len(self.tok) or self.is_mark(k + 1, ";", ",", "}") or self.new_line(k + 1) and not self.is_mark(k + 1, "+", ".")
        if k < len(self.tok) and self.kind[k] == "text" and text[:1] in "\"'`" and ends:
            value = text.strip(text[0])
            self.add("assignment", self.tok[i].lstrip("$"), value, authority(value) or value, i)

    def run(self) -> list[tuple]:
        g, i, ruby = self.grammar, 0, self.language == "ruby"
        while i < len(self.tok):
            x = self.tok[i]
            while self.scopes and self.scopes[-1][0] < i:
                self.scopes.pop()
            self.scopes += self.begins.pop(i, [])
            bracket = i + 1 + self.is_mark(i + 1, "!")
            if x == "#" and self.is_mark(i, "#") and self.is_mark(bracket, "[") and bracket in self.partner:  # an attribute
                i = self.partner[bracket] + 1
                continue
            if self.kind[i] != "name" or i in self.taken:
                i += 1
                continue
            apart = not self.is_mark(i - 1, *g.joints)
            if x in g.imports and apart and not self.is_mark(i + 1, "(") | (self.language == "go") and not (self.language == "csharp" and (self.word(i + 1, "var") or self.scopes)) and not (self.language == "php" and self.scopes) or x == "import" and self.language == "go" and apart:
                i = self._import(i) + 1
                continue
            if x in g.classes and self._class(i) or x in g.functions and apart and self._function(i):
                i += 1
                continue
            if self.language == "go" and self.word(i + 1, "struct") and (self.word(i - 1, "type") or self.is_mark(i - 1, "(", "}", ";") or self.new_line(i)) and self.is_mark(i + 2, "{") and self._in_types(i):
                self._define(x, "class", None, i, i, -1, self.partner.get(i + 2, i + 2))
            elif self.language == "rust" and x == "impl" and (self.new_line(i) or self.word(i - 1, "unsafe", "default") or self.is_mark(i - 1, "}", ";")):
                self._impl(i)
            else:
                self._name(i)
            i += 1
        for k in self.broken[:1]:
            self.add("error", "syntax_errors", f"unmatched {self.tok[k]}", i=k)
        return self.rows

    def _in_types(self, i: int) -> bool:
        """Go: token i begins a type's specification: behind `type`, alone or in its bracket."""
        if self.word(i - 1, "type"):
            return True
        up = next((k for k in range(i - 1, -1, -1) if self.is_mark(k, "(") and self.partner.get(k, -1) > i), -1)
        return self.word(up - 1, "type")

    def _name(self, i: int) -> None:
        """A name that is no definition's word: a method by its shape, a call or the target of an assignment."""
        g, x, j = self.grammar, self.tok[i], i + 1
        if not self.is_mark(i - 1, *g.joints):
            self._assignment(i)
        if self.language == "rust" and self.is_mark(j, "!") and self.is_mark(j + 1, "(", "[", "{") and j + 1 in self.partner and self.at[j] == self.at[i] + len(x):
            first = self._chain(i)
            self.add("call", self._owner(), self._callee(first, i), "", first, None, i)
            return
        if self.language == "rust" and self.is_mark(j, "::") and self.is_mark(j + 1, "<"):
            j += 1
        if self.is_mark(j, "<") and self.language in ("csharp", "java", "rust") or self.is_mark(j, "[") and self.language == "go" and j in self.partner and self.is_mark(self.partner[j] + 1, "("):
            j = self.partner[j] + 1 if self.is_mark(j, "[") else self._type_arguments(j)
        close = self.is_mark(j, "(") and j in self.partner
        if not close or self.language == "ruby" and j == i + 1 and self.at[j] > self.at[i] + len(x):
            if self.language in ("ruby", "php") and x not in g.no_call:
                self._command(i)
            return
        if x in g.no_call and not self.is_mark(i - 1, *g.joints):
            return
        if g.shaped and self._shaped(i, j):
            return
        first, inside = self._chain(i), self.scopes[-1] if self.scopes else None
        made = g.made and self.word(first - 1, "new") and not any(self.is_mark(k, "(") for k in range(first, min(i, first + 64)))
        constant = (g.shaped or self.language == "rust") and inside and inside[1] == "class" and self.is_mark(i - 1, "{", ",", "]")
        attribute = self.is_mark(first - 1, "@") or self.language == "csharp" and self.is_mark(first - 1, "[") and (self.new_line(first - 1) or first < 2 or self.is_mark(first - 2, ";", "{", "}"))
        if not made and not constant and not attribute:
            self._call(i, j)

    def _type_arguments(self, j: int) -> int:
        """The token behind the type arguments that begin at j, or j if they are none. A stretch without a bracket behind it is read once."""
        if j < getattr(self, "_no_types", -1):
            return j
        deep, k = 0, j
        while k < len(self.tok) and (self.word(k) or self.is_mark(k, "<", ">", ",", ".", "[", "]", "?", "::", "&")):
            deep += self.is_mark(k, "<") - self.is_mark(k, ">")
            k += 1
            if not deep:
                return k
        self._no_types = k
        return j


def grammar_rows(language: str, file: str, text: str) -> list[tuple]:
    """Rows (see operators.extract) of a file of one of GRAMMARS: what can be read of a damaged one too, with an error row at its first bracket without a partner."""
    return _Source(file, text, language).run()
