"""C: a small preprocessor, tokens and grammar.

Conditional groups: a file is read once with the first branch of every group, and
as often again as it takes to have every other branch read too, each time under
one choice of truth values: conditions on the same macro are decided alike. A
branch that no choice can reach (`#if 0`, the C++ side of `__cplusplus`) is not
read, and of a group without `#else` only its branch. Every reading must parse.

Macros defined in the file are expanded; an upper-case name next to a string is
taken for a macro that stands for one. Whether a name is a type is not known
without the headers; the parser follows both readings. `(a) - b` is the exception:
where a sign follows a single name in brackets the name is read as a value, since
wherever the cast is valid the subtraction is valid too."""

from __future__ import annotations

import re

from .python_grammar import LexError

GRAMMAR = r"""
file : top* ;
top : function | decl | ';' | 'asm' '(' strings ')' ';' | ID '(' margs? ')' ';'? ;
margs : marg (',' marg)* ;
marg : expr_a | specs absdecl? ;
function : specs declarator decl* block | declarator_f block ;
declarator_f : ID '(' params? ')' ;
decl : specs ';' | specs inits ';' | static_assert ;
static_assert : '_Static_assert' '(' expr_a ')' ';' | '_Static_assert' '(' expr_a ',' strings ')' ';' ;
specs : spec+ ;
spec : 'typedef' | 'extern' | 'static' | 'auto' | 'register' | '_Thread_local' | 'inline' | '_Noreturn' | 'const' | 'volatile' | 'restrict' | '_Atomic' | '_Atomic' '(' tname ')' | '_Alignas' '(' tname ')' | '_Alignas' '(' expr_a ')'
  | 'void' | 'char' | 'short' | 'int' | 'long' | 'float' | 'double' | 'signed' | 'unsigned' | '_Bool' | '_Complex' | ID | struct | enum | 'typeof' '(' expr ')' | 'typeof' '(' tname ')' | attr ;
attr : '__attribute__' '(' '(' attrs? ')' ')' | '[' '[' attrs? ']' ']' ;
attrs : attr_item (',' attr_item?)* ;
attr_item : ID | 'const' | ID '(' margs? ')' | ID ':' ':' ID ;
struct : struct_kind attr* ID? '{' member* '}' attr* | struct_kind attr* ID ;
struct_kind : 'struct' | 'union' ;
member : specs ';' | specs mdecl (',' mdecl)* ';' | static_assert | ';' ;
mdecl : declarator attr* | declarator? ':' expr_a ;
enum : 'enum' ID? '{' enums ','? '}' | 'enum' ID ;
enums : enum_item (',' enum_item)* ;
enum_item : ID | ID '=' expr_a ;
inits : init (',' init)* ;
init : declarator suffix* | declarator suffix* '=' initializer ;
suffix : attr | 'asm' '(' strings ')' ;
initializer : assign | '{' '}' | '{' items ','? '}' ;
items : item (',' item)* ;
item : initializer | designator+ '=' initializer ;
designator : '[' expr_a ']' | '.' ID | '[' expr_a '...' expr_a ']' ;
declarator : direct | pointer direct ;
pointer : '*' qual* | pointer '*' qual* ;
qual : 'const' | 'volatile' | 'restrict' | '_Atomic' | attr ;
direct : ID | '(' attr? declarator ')' | direct '[' ']' | direct '[' array_mods? assign ']' | direct '[' array_mods? '*' ']' | direct '[' array_mods ']' | direct '(' ')' | direct '(' params ')' ;
array_mods : array_mod+ ;
array_mod : 'static' | 'const' | 'volatile' | 'restrict' ;
params : param (',' param)* | param (',' param)* ',' '...' | '...' ;
param : specs declarator attr* | specs absdecl | specs ;
tname : specs | specs absdecl ;
absdecl : pointer | dabs | pointer dabs ;
dabs : '(' absdecl ')' | '[' ']' | '[' array_mods? assign ']' | '[' '*' ']' | '(' ')' | '(' params ')' | dabs '[' ']' | dabs '[' array_mods? assign ']' | dabs '(' ')' | dabs '(' params ')' ;
block : '{' stmt* '}' ;
stmt : decl | simple ;
simple : block | ';' | expr ';' | 'if' '(' expr ')' simple | 'if' '(' expr ')' simple 'else' simple | 'switch' '(' expr ')' simple | 'while' '(' expr ')' simple
  | 'do' simple 'while' '(' expr ')' ';' | 'for' '(' expr? ';' expr? ';' expr? ')' simple | 'for' '(' decl expr? ';' expr? ')' simple | 'goto' ID ';' | 'goto' '*' expr ';'
  | 'continue' ';' | 'break' ';' | 'return' expr? ';' | ID ':' | 'case' expr_a ':' | 'case' expr_a '...' expr_a ':' | 'default' ':' | asm ';' | attr ';' ;
asm : 'asm' asm_qual* '(' strings asm_rest* ')' ;
asm_qual : 'volatile' | 'inline' | 'goto' ;
asm_rest : ':' | ',' | strings | strings '(' expr ')' | '[' ID ']' strings '(' expr ')' | ID ;
expr : assign | expr ',' assign ;
assign : cond | unary '=' assign | unary ASSIGN assign ;
expr_a : cond ;
cond : bin | bin '?' expr ':' cond | bin '?' ':' cond ;
bin : cast | bin op cast ;
op : BIN | '*' | '+' | '-' | '&' ;
cast : unary | '(' tname ')' cast ;
unary : postfix | INC unary | unop cast | 'sizeof' unary | 'sizeof' '(' tname ')' | '_Alignof' '(' tname ')' ;
unop : '&' | '*' | '+' | '-' | UN ;
postfix : primary | postfix '[' expr ']' | postfix '(' ')' | postfix '(' args ')' | postfix '.' ID | postfix '->' ID | postfix INC | '(' tname ')' '{' '}' | '(' tname ')' '{' items ','? '}' ;
args : arg (',' arg)* ;
arg : assign | tname ;
primary : ID | IDX | NUMBER | CHAR | strings | '(' expr ')' | '(' block ')' | generic ;
strings : string+ ;
string : STRING | SMACRO | SMACRO '(' args? ')' ;
generic : '_Generic' '(' assign (',' assoc)+ ')' ;
assoc : tname ':' assign | 'default' ':' assign ;
"""
PREFER_SHIFT = {"else"}

_KEYWORDS = set(
    """auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct switch typedef union
    unsigned void volatile while _Alignas _Alignof _Atomic _Bool _Complex _Generic _Noreturn _Static_assert _Thread_local __attribute__ asm typeof""".split()
)
_SAME = {"__asm__": "asm", "__asm": "asm", "__inline": "inline", "__inline__": "inline", "__restrict": "restrict", "__restrict__": "restrict",
    "__const": "const", "__volatile__": "volatile", "__typeof__": "typeof", "static_assert": "_Static_assert", "alignas": "_Alignas",
        "alignof": "_Alignof", "thread_local": "_Thread_local", "bool": "_Bool", "__extension__": None}
_TOKEN = re.compile(
    r"""(?P<ws>(?:[ \t\f\v\r]|\\\r?\n)+)|(?P<nl>\n)|(?P<comment>//(?:[^\n\\]|\\\r?\n|\\)*|/\*(?:[^*]|\*(?!/))*\*/)
|(?P<string>(?:u8|[uUL])?"(?:[^"\\\n]|\\(?:\r\n|.))*")
|(?P<char>[uUL]?'(?:[^'\\\n]|\\.)+')
|(?P<id>[^\W\d]\w*)
|(?P<number>\.?\d(?:[eEpP][+-]|'\w|[\w.])*)
|(?P<op>\.\.\.|<<=|>>=|->|\+\+|--|&&|\|\||==|!=|<=|>=|<<|>>|[+\-*/%&|^]=|\#\#|[-+*/%&|^!~<>=?:;,.(){}\[\]\#])""",
    re.X | re.S,
)
_NUMBER = re.compile(r"(?:0[xX][0-9a-fA-F']+(?:\.[0-9a-fA-F]*)?(?:[pP][+-]?\d+)?|0[bB][01']+|(?:\d[\d']*\.?[\d']*|\.\d+)(?:[eE][+-]?\d+)?)(?:[uUlLfFiIjJzZwWbB]|[dD][dDfFlL])*$")
_ASSIGN = set("+= -= *= /= %= &= |= ^= <<= >>=".split())
_BIN = set("&& || == != < > <= >= / % << >> | ^".split())


def _lex(src: str, pos: int, n: int):
    """(kind, text, place) without white space; line breaks as kind nl."""
    match = _TOKEN.match
    while pos < n:
        m = match(src, pos)
        if not m:
            raise LexError(pos)
        if m.lastgroup not in ("ws", "comment"):
            yield m.lastgroup, m.group(), pos
        pos = m.end()


#: Macros that no C compiler defines when it reads C (fixed values).
_NEVER = {"__cplusplus", "__ASSEMBLER__", "__ASSEMBLY__", "__OBJC__"}
_PLAIN = {"include", "undef", "pragma", "error", "warning", "line", "include_next", "import", "embed", "ident", ""}
_LINE = re.compile(r"(?:[^\n\\]|\\\r?\n|\\)*(?:\n|$)")
_DIRECTIVE = re.compile(r"[ \t]*(?:/\*[^\n]*?\*/[ \t]*)?#[ \t]*(\w*)")
_DEFINED = re.compile(r"(!?)\s*defined\s*(?:\(\s*(\w+)\s*\)|(\w+))")


def condition(word: str, rest: str):
    """True or False where it is known, else (what is tested, what it must be)."""
    rest = re.sub(r"//.*|/\*.*?\*/", " ", rest, flags=re.S).strip()
    if word in ("ifdef", "ifndef", "elifdef", "elifndef"):
        name = rest.split()[0] if rest else ""
        want = not word.endswith("ndef")
        return (not want) if name in _NEVER else (name, want)
    if m := _DEFINED.fullmatch(rest):
        name = m[2] or m[3]
        return bool(m[1]) if name in _NEVER else (name, not m[1])
    if re.fullmatch(r"\(?0\)?", rest) or rest.split("(")[0].split()[:1] == ["__cplusplus"]:
        return False
    if re.fullmatch(r"\(?1\)?", rest):
        return True
    return re.sub(r"\s+", " ", rest), True


class Branch:
    """One branch of a conditional group: the branches before it, the one around it."""

    def __init__(self, cond, before: list, around):
        self.cond, self.before, self.around = cond, before, around

    def wants(self) -> dict | None:
        """What must hold for it to be read; None if that is impossible."""
        out: dict = {}
        b = self
        while b:
            for cond, is_true in [*((x.cond, False) for x in b.before), (b.cond, True)]:
                if cond is True or cond is False:
                    if cond is not is_true:
                        return None
                elif out.setdefault(cond[0], cond[1] is is_true) is not (cond[1] is is_true):
                    return None
            b = b.around
        return out


def _pieces(src: str) -> tuple[list[tuple], list[Branch]]:
    """(pieces of the file in order, all branches). A piece is (start, end, branch)
    for text, (start, -end, branch) for the definition of a macro."""
    out, branches, open_ = [], [], []  # open_: [branches so far, an else was seen]
    pos, n, in_comment, start = 0, len(src), False, 0
    here = None
    while pos < n:
        m = _LINE.match(src, pos)
        end = m.end() if m.end() > pos else n
        text = m.group()
        head = None if in_comment else _DIRECTIVE.match(text)
        if head:
            if pos > start:
                out.append((start, pos, here))
            word = head.group(1)
            rest = text[head.end() :].strip()
            if word in ("if", "ifdef", "ifndef"):
                here = Branch(condition(word, rest), [], here)
                open_.append([[here], False])
                branches.append(here)
            elif word in ("elif", "elifdef", "elifndef", "else"):
                if not open_ or open_[-1][1]:
                    raise LexError(pos)
                group = open_[-1][0]
                here = Branch(True if word == "else" else condition(word, rest), list(group), group[0].around)
                group.append(here)
                branches.append(here)
                open_[-1][1] = word == "else"
            elif word == "endif":
                if not open_:
                    raise LexError(pos)
                here = open_.pop()[0][0].around
            elif word == "define":
                out.append((pos + head.end(), -end, here))
            elif (word not in _PLAIN or word == "include" and not re.match(r"<[^>\n]+>|\"[^\"\n]+\"|[A-Za-z_]\w*", rest)) and (here is None or here.wants() is not None):
                raise LexError(pos)
            start = end
            # a comment may open on a directive
            in_comment = _opens(text, False)
        else:
            in_comment = _opens(text, in_comment)
        pos = end
    if open_:
        raise LexError(n)
    if n > start:
        out.append((start, n, here))
    return out, branches


def _read(branches: list[Branch], chosen: dict) -> set:
    """The branches that are read under a choice of truth values: of every group the
    first that is not known to be false."""
    done: set = set()
    for b in branches:  # outer branches come first
        if (b.around is None or b.around in done) and b.cond is not False and not any(x in done for x in b.before):
            if b.cond is True or chosen.get(b.cond[0], b.cond[1]) is b.cond[1]:
                done.add(b)
    return done


def choices(branches: list[Branch]) -> list[set]:
    """Sets of branches to read, one per reading of the file; together they hold
    every branch that can be read."""
    out = [_read(branches, {})]
    left = {b: w for b in branches if b not in out[0] and (w := b.wants()) is not None}
    while left:
        first = next(iter(left))
        chosen = dict(left.pop(first))
        for w in left.values():  # as many others as agree with it
            if all(chosen.get(k, v) is v for k, v in w.items()):
                chosen.update(w)
        out.append(_read(branches, chosen))
        left = {b: w for b, w in left.items() if b not in out[-1]}
    return out


_BITS = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|//.*|/\*|\*/", re.S)


def _opens(text: str, inside: bool) -> bool:
    pos = 0
    while True:
        if inside:
            k = text.find("*/", pos)
            if k < 0:
                return True
            pos, inside = k + 2, False
        m = _BITS.search(text, pos)
        if not m:
            return False
        if m.group() == "/*":
            inside = True
        pos = m.end()


def _expand(toks: list[tuple], macros: dict, hidden=frozenset(), budget=None) -> list[tuple]:
    out: list[tuple] = []
    i = 0
    budget = budget if budget is not None else [200_000]
    while i < len(toks):
        kind, text, p = toks[i]
        if kind == "id" and text in macros and text not in hidden:
            params, body = macros[text]
            if params is None:
                budget[0] -= len(body)
                if budget[0] < 0:
                    return out + toks[i:]
                out += _expand([(k, t, p) for k, t, _ in body], macros, hidden | {text}, budget)
                i += 1
                continue
            if i + 1 < len(toks) and toks[i + 1][1] == "(" and toks[i + 1][0] == "op":
                args, depth, j, cur = [], 1, i + 2, []
                while j < len(toks) and depth:
                    t = toks[j][1] if toks[j][0] == "op" else ""
                    depth += (t in ("(", "[", "{")) - (t in (")", "]", "}"))
                    if depth == 0:
                        break
                    if t == "," and depth == 1 and (len(args) + 1 < len(params) or "..." not in params):
                        args.append(cur)
                        cur = []
                    else:
                        cur.append(toks[j])
                    j += 1
                args.append(cur)
                if depth == 0 and (len(args) == len(params) or not params and not cur or "..." in params):
                    by = {("__VA_ARGS__" if q == "..." else q): a for q, a in zip(params, args)}
                    new: list[tuple] = []
                    for k, (bk, bt, _) in enumerate(body):
                        if bt == "#" and bk == "op":
                            continue
                        if bt == "##":
                            continue
                        if k and body[k - 1][1] == "#" and bt in by:
                            new.append(("string", '""', p))
                        elif bk == "id" and bt in by:
                            new += [(x, y, p) for x, y, _ in by[bt]]
                        else:
                            new.append((bk, bt, p))
                    budget[0] -= len(new)
                    if budget[0] < 0:
                        return out + toks[i:]
                    out += _expand(new, macros, hidden | {text}, budget)
                    i = j + 1
                    continue
        out.append(toks[i])
        i += 1
    return out


def readings(src: str):
    """(terminals, places) of every reading of a file."""
    if src.startswith("\ufeff"):
        src = " " + src[1:]
    pieces, branches = _pieces(src)
    for taken in choices(branches):
        yield _tokens(src, [(a, z) for a, z, b in pieces if b is None or b in taken])


def tokenize(src: str):
    """The first reading."""
    return next(readings(src))


_DEFINE = re.compile(r"[ \t]*([^\W\d]\w*)(\([^)\n]*\))?")
_UPPER = re.compile(r"_?[A-Z][A-Z0-9_]\w*$")
#: Before `( name )` these make it something else than a value in brackets.
_NO_VALUE = {"ID", "typeof", "sizeof", "_Alignof", "_Alignas", "_Atomic", "__attribute__", "asm", ")", "]"}
_SIGNS = {"*", "&", "+", "-"}


def _tokens(src: str, stretches: list[tuple[int, int]]) -> tuple[list[str], list[int]]:
    macros: dict = {}
    raw: list[tuple] = []

    def flush() -> None:
        done.extend(_expand(raw, macros))
        raw.clear()

    done: list[tuple] = []
    for a, b in stretches:
        if b > 0:
            raw += [t for t in _lex(src, a, b) if t[0] != "nl"]
            continue
        flush()
        m = _DEFINE.match(src, a)
        if not m:
            raise LexError(a)
        body = [t for t in _lex(src, m.end(), -b) if t[0] != "nl"]
        params = None
        if m.group(2) is not None:
            params = [q.strip() for q in m.group(2)[1:-1].split(",")] if m.group(2)[1:-1].strip() else []
        macros[m.group(1)] = (params, body)
    flush()
    toks: list[str] = []
    at: list[int] = []
    last = len(done) - 1
    for k, (kind, text, p) in enumerate(done):
        if kind == "id":
            text = _SAME.get(text, text)
            if text is None:
                continue
            t = text if text in _KEYWORDS else "ID"
            if t == "ID" and (toks and toks[-1] in ("STRING", "SMACRO") or k < last and done[k + 1][0] == "string") and _UPPER.match(text):
                t = "SMACRO"
        elif kind == "op":
            if text in ("#", "##"):
                raise LexError(p)
            t = "ASSIGN" if text in _ASSIGN else "BIN" if text in _BIN else "INC" if text in ("++", "--") else "UN" if text in ("!", "~") else text
            if t in _SIGNS and len(toks) > 2 and toks[-1] == ")" and toks[-2] == "ID" and toks[-3] == "(" and (len(toks) < 4 or toks[-4] not in _NO_VALUE):
                toks[-2] = "IDX"
        else:
            if kind == "number" and not _NUMBER.match(text):
                raise LexError(p)
            t = kind.upper()
        toks.append(t)
        at.append(p)
    return toks, at
