"""Definitions, calls, imports and assignments out of JavaScript and TypeScript, by tokens and matched brackets.

There is no grammar here: what is asked for shows in the tokens. A name before a bracket is a call unless a body follows the bracket; a body's extent is
its bracket's partner; what an arrow or an unnamed function is called stands before it.
"""

from __future__ import annotations

from graphlens.functions.hosts import authority
from graphlens.operators.lexer import MAX_ARG, Lexicon, Tokens

#: Words before a bracket that are no calls, and after which a value begins. Fixed values of the languages.
NO_CALL = frozenset("if for while switch catch with return typeof instanceof await yield throw delete void in of do else case new function".split())
VALUE_NEXT = frozenset("return typeof instanceof await yield throw delete void in of do else case new".split())
OPAQUE = "<expr>"
#: Blanks and comments are left out; a slash begins a regular expression only where no value can end; a template's holes hold code.
LEXICON = Lexicon(
    r"\s+|//[^\n]*|/\*.*?(?:\*/|\Z)", r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", r"\#?[A-Za-z_$\u0080-￿][\w$\u0080-￿]*", r"=>|\?\.(?!\d)|\.\.\.",
    holes=(("`", r"(?:\\.|\$(?!\{)|[^`\\$])*", "`", "${"),), value_next=VALUE_NEXT, pattern=r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*",
)
_READY = LEXICON.compiled()


class _Script(Tokens):
    """The tokens of one file and what is read off them."""

    def __init__(self, file: str, text: str):
        super().__init__(file, text, LEXICON, _READY)

    def body_after(self, i: int, typed: bool = True) -> int:
        """The bracket that begins a body behind place i, past a return type; -1 if none follows."""
        if self.is_mark(i, "{"):
            return i
        if not typed or not self.is_mark(i, ":"):
            return -1
        i += 1
        while i < len(self.tok) and not self.is_mark(i, ";", ",", ")", "]", "}", "="):
            if self.is_mark(i, "{") and not self.is_mark(i - 1, ":", "|", "&", "<", ","):
                return i if i in self.partner else -1
            i = self.partner.get(i, i) + 1 if self.is_mark(i, "(", "[", "{") else i + 1
        return -1

    def binding(self, i: int) -> int:
        """The name that the value beginning at place i is bound to: x = value, x: value; -1 if none."""
        j = i - 1
        if self.is_mark(j, ":") and (self.word(j - 1) or self.kind[j - 1] == "text") and self.is_mark(j - 2, "{", ","):
            return j - 1
        if not self.is_mark(j, "="):
            return -1
        if self.word(j - 1) and not self.is_mark(j - 2, ":", "|", "&", "<", "=>"):
            return j - 1
        k = j - 1  # the type between a declared name and its value
        while k > 0 and not self.word(k, "const", "let", "var") and not self.is_mark(k, ";", "{", "}"):
            k = self.partner.get(k, k) - 1
        return k + 1 if self.word(k, "const", "let", "var") and self.word(k + 1) else -1

    def expression_end(self, i: int) -> int:
        """The last token of an arrow's expression that begins at place i."""
        while i < len(self.tok) and not self.is_mark(i, ",", ";", ")", "]", "}"):
            i = self.partner.get(i, i) + 1
            if i < len(self.tok) and self.place(i)[0] > self.place(i - 1)[0] and not self.is_mark(i, ".", "?.", "?", ":", "+", "-", "*", "/", "&", "|", "=") and not self.is_mark(i - 1, "=>", "+", "-", "*", "/", "&", "|", "?", ":", "=", ".", "?."):
                break
        return min(i, len(self.tok)) - 1

    def callee(self, i: int) -> str:
        """The dotted name that ends at place i."""
        parts = [self.tok[i]]
        while self.is_mark(i - 1, ".", "?."):
            i -= 2
            if not self.word(i):
                return ".".join([OPAQUE, *parts])
            parts.insert(0, self.tok[i])
        return ".".join(parts)

    def definition_at(self, i: int) -> tuple[str, int, int, int] | None:
        """(kind, place of the name, first token of the body, last one) if a definition begins with token i."""
        if self.word(i, "class", "interface", "enum") and not self.is_mark(i - 1, ".", "?."):
            name = i + 1 if self.word(i + 1) and not self.word(i + 1, "extends", "implements") else self.binding(i)
            j = i + 1
            while j < len(self.tok) and not self.is_mark(j, "{", ";", ")", "=", ":"):
                j = self.partner.get(j, j) + 1 if self.is_mark(j, "(", "[") else j + 1
            return ("class", name, j, self.partner[j]) if self.is_mark(j, "{") and j in self.partner and name >= 0 else None
        if self.word(i, "function"):
            j = i + 1 + self.is_mark(i + 1, "*")
            name = j if self.word(j) else self.binding(i - self.word(i - 1, "async"))
            while j < len(self.tok) and not self.is_mark(j, "(", "{", ";"):
                j += 1
            body = self.body_after(self.partner[j] + 1) if self.is_mark(j, "(") and j in self.partner else -1
            return ("function", name, body, self.partner[body]) if body >= 0 and body in self.partner and name >= 0 else None
        return None

    def arrow_at(self, i: int) -> tuple[str, int, int, int] | None:
        """The same for the arrow at place i."""
        j = i - 1
        if not self.is_mark(j, ")") and not (self.word(j) and not self.is_mark(j - 1, ":")):  # a return type between
            while j > 0 and not self.is_mark(j, ":", ";", ",", "="):
                j = self.partner.get(j, j) - 1
            j -= 1
        begin = self.partner.get(j, j)
        if self.is_mark(begin - 1, ">"):  # type parameters
            while begin > 0 and not self.is_mark(begin, "<"):
                begin -= 1
        name = self.binding(begin - self.word(begin - 1, "async"))
        if name < 0:
            return None
        body = i + 1
        return "function", name, body, self.partner[body] if self.is_mark(body, "{") and body in self.partner else self.expression_end(body)

    def run(self) -> list[tuple]:
        scopes: list[tuple[int, int, str | None, bool]] = []  # (first and last token of the body, name, class?)
        named: set[int] = set()
        begins: dict[int, list[tuple[int, str | None, bool]]] = {}
        typed_to = -1  # the stretch of type arguments that was read last

        def define(found: tuple[str, int, int, int], i: int) -> None:
            kind, name, body, end = found
            own = scopes[-1] if scopes else None
            in_class = bool(own and own[3]) and kind != "class"
            text = self.tok[name].strip("\"'`")
            whole = f"{own[2]}.{text}" if in_class else text
            self.add("definition", f"{self.file}::{whole}", text, "method" if in_class else kind, i, end, name)
            named.add(name)
            begins.setdefault(body, []).append((end, whole, kind == "class"))

        for i, x in enumerate(self.tok):
            while scopes and scopes[-1][1] < i:
                scopes.pop()
            # In a class body's own brackets no member begins: parameters and defaults belong to none.
            for end, name, is_class in begins.pop(i, []):
                scopes.append((i, end, name, is_class))
            kind = self.kind[i]
            if kind == "mark" and x == "=>":
                if found := self.arrow_at(i):
                    define(found, found[1])
                continue
            if kind != "name":
                continue
            if found := self.definition_at(i):
                define(found, i)
                continue
            if x == "import" and not self.is_mark(i + 1, ".", "(") or x == "export" and (self.is_mark(i + 1, "*", "{") or self.word(i + 1, "type")):
                self._module(i)
                continue
            if x == "static" and self.is_mark(i + 1, "{") and i + 1 in self.partner and scopes and scopes[-1][3]:
                begins.setdefault(i + 1, []).append((self.partner[i + 1], None, False))  # a block of statements, no member
                continue
            if x in ("const", "let", "var") and self.word(i + 1):
                self._assignment(i + 1)
            j = i + 1
            if self.is_mark(j, "<"):  # type arguments, if a call's bracket follows them
                k = typed_to if j < typed_to else j
                while k < len(self.tok) and (self.word(k) or self.is_mark(k, "<", ">", ",", ".", "[", "]", "|")):
                    k += 1
                typed_to = k
                j = k if self.is_mark(k, "(") and self.is_mark(k - 1, ">") else j
            j += self.is_mark(j, "?.") and self.is_mark(j + 1, "(")
            if not self.is_mark(j, "(") or j not in self.partner or i in named or x in NO_CALL and not self.is_mark(i - 1, ".", "?."):
                continue
            if x == "async" and self.is_mark(self.partner[j] + 1, "=>", ":"):
                continue
            in_class = bool(scopes) and scopes[-1][3]
            body = self.body_after(self.partner[j] + 1, in_class) if not self.is_mark(i - 1, ".", "?.") and not self.word(i - 1, "new") else -1
            if body >= 0 and body in self.partner:
                define(("function", i, body, self.partner[body]), i)
                continue
            if in_class and not self.is_mark(i - 1, "=", ".", "@", "(", ",", "[", "?.", ":") and not self.word(i - 1, "new") and self.partner[j] + 1 < len(self.tok) and self.is_mark(self.partner[j] + 1, ";", ":"):
                continue  # a signature without a body
            owner = next((name for _, _, name, is_class in reversed(scopes) if name and not is_class), "<module>")
            arg = self.text[self.at[j] + 1 : self.at[self.partner[j]]].strip()
            self.add("call", f"{self.file}::{owner}", self.callee(i), arg[:MAX_ARG], i, None, i)
            if x in ("require", "import") and not self.is_mark(i - 1, ".") and self.kind[j + 1] == "text":
                self.add("import", self.tok[j + 1][1:-1], i=i)
        for i in self.broken[:1]:
            self.add("error", "syntax_errors", f"unmatched {self.tok[i]}", i=i)
        return self.rows

    def _module(self, i: int) -> None:
        """import ... from 'm', import 'm', export ... from 'm': the first string of the statement."""
        j = i + 1
        while j < len(self.tok) and self.kind[j] != "text" and not self.is_mark(j, ";", "="):
            j = self.partner.get(j, j) + 1 if self.is_mark(j, "{") else j + 1
            if j < len(self.tok) and self.word(j, "import", "export", "const", "let", "var", "function", "class"):
                return
        if j < len(self.tok) and self.kind[j] == "text" and (self.word(j - 1, "from") or j == i + 1):
            self.add("import", self.tok[j][1:-1], i=i)

    def _assignment(self, i: int) -> None:
        """const x = 'text', also with a type between."""
        j = i + 1
        while j < len(self.tok) and not self.is_mark(j, "=", ";", ",", ")", "=>") and not self.word(j, "of", "in"):
            j = self.partner.get(j, j) + 1 if self.is_mark(j, "(", "[", "{") else j + 1
        if self.is_mark(j, "=") and j + 1 < len(self.tok):
            text = self.tok[j + 1]
            ends = j + 2 == len(self.tok) or self.is_mark(j + 2, ";", ",", "}") or self.place(j + 2)[0] > self.place(j + 1)[0] and not self.is_mark(j + 2, "+", ".")
            value = text[1:-1] if self.kind[j + 1] == "text" and text[0] in "\"'`" and ends else None
            self.add("assignment", self.tok[i], value, (authority(value) or value) if value is not None else None, i)


def script_rows(file: str, text: str) -> list[tuple]:
    """Rows (see operators.extract) of a JavaScript or TypeScript file: what can be read of a damaged one too, with an error row at its first bracket without a partner."""
    return _Script(file, text).run()
