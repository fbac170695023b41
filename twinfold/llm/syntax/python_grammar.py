"""Python 3: tokens and grammar. Operators of one kind share a level, since only
validity matters and not the tree."""

from __future__ import annotations

import re

GRAMMAR = r"""
file : (NEWLINE | stmt)* ;
stmt : simple | compound ;
simple : small (';' small)* ';'? NEWLINE ;
small : assign | 'del' dels | 'pass' | 'break' | 'continue' | 'return' stars? | 'raise' | 'raise' test | 'raise' test 'from' test
  | 'global' names | 'nonlocal' names | 'assert' test | 'assert' test ',' test | import | 'type' name tparams? '=' test ;
assign : stars | one ':' test | one ':' test '=' (stars | yield) | one AUG (stars | yield) | (targets '=')+ (stars | yield) | yield ;
one : name | primary '.' name | primary '[' subs ']' | '(' one ')' ;
dels : del (',' del)* ','? ;
del : name | primary '.' name | primary '[' subs ']' | '(' dels? ')' | '[' dels? ']' ;
names : name (',' name)* ;
import : 'import' dotted_as (',' dotted_as)* | 'from' from 'import' ('*' | as_names | '(' as_names ','? ')') ;
from : dots | dots dotted | dotted ;
dots : '.' | '...' | dots '.' | dots '...' ;
dotted : name | dotted '.' name ;
dotted_as : dotted | dotted 'as' name ;
as_names : as_name | as_names ',' as_name ;
as_name : name | name 'as' name ;
name : NAME | 'match' | 'case' | 'type' ;

compound : if | while | for | try | with | def | class | 'async' for | 'async' with | decorators def | decorators class | match ;
decorators : ('@' named NEWLINE)+ ;
block : simple | NEWLINE INDENT stmt+ DEDENT ;
if : 'if' named ':' block ('elif' named ':' block)* else? ;
else : 'else' ':' block ;
while : 'while' named ':' block else? ;
for : 'for' targets 'in' stars ':' block else? ;
try : 'try' ':' block ((handler+ | star_handler+) else? finally? | finally) ;
handler : 'except' ':' block | 'except' test (',' test)* ','? ':' block | 'except' test 'as' name ':' block ;
star_handler : 'except' '*' test ':' block | 'except' '*' test 'as' name ':' block ;
finally : 'finally' ':' block ;
with : 'with' items ':' block | 'with' '(' items ','? ')' ':' block ;
items : item (',' item)* ;
item : test | test 'as' single ;
def : 'async'? 'def' name tparams? '(' params? ')' ('->' test)? ':' block ;
class : 'class' name tparams? ('(' args? ')')? ':' block ;
tparams : '[' tparam (',' tparam)* ','? ']' ;
tparam : name (':' test)? ('=' test)? | '*' name ('=' stars)? | '**' name ('=' test)? ;
params : p_pos ','? | p_pos ',' p_stars ','? | p_stars ','? ;
p_pos : p_plains p_slash? | p_plains p_slash ',' p_plains | p_plains p_slash ',' p_plains ',' p_defaults | p_plains p_slash ',' p_defaults | p_plains ',' p_defaults p_slash?
  | p_plains ',' p_defaults p_slash ',' p_defaults | p_defaults p_slash? | p_defaults p_slash ',' p_defaults ;
p_slash : ',' '/' ;
p_plains : p_plain (',' p_plain)* ;
p_defaults : p_default (',' p_default)* ;
p_plain : name | name ':' test ;
p_default : name '=' test | name ':' test '=' test ;
p_stars : '*' p_star (',' p_kwonly)* (',' p_dstar)? | '*' (',' p_kwonly)+ (',' p_dstar)? | p_dstar ;
p_star : name | name ':' star_or_test ;
p_kwonly : p_plain | p_default ;
p_dstar : '**' p_plain ;
star_or_test : test | '*' expr ;

match : 'match' stars ':' NEWLINE INDENT clause+ DEDENT ;
clause : 'case' pats ('if' named)? ':' block ;
pats : pat | star_pat | pat_or_star ',' | pat_or_star (',' pat_or_star)+ ','? ;
pat_or_star : pat | star_pat ;
star_pat : '*' name ;
pat : or_pat | or_pat 'as' name ;
or_pat : closed | or_pat '|' closed ;
closed : signed | signed '+' NUMBER | signed '-' NUMBER | strings | 'None' | 'True' | 'False' | dotted | '(' ')' | '(' pats ')' | '[' ']' | '[' pats ']'
  | '{' '}' | '{' keys ','? '}' | dotted '(' ')' | dotted '(' class_pats ','? ')' ;
signed : NUMBER | '-' NUMBER ;
keys : key (',' key)* ;
key : map_key ':' pat | '**' name ;
map_key : signed | strings | 'None' | 'True' | 'False' | dotted '.' name ;
class_pats : class_pat (',' class_pat)* ;
class_pat : pat | name '=' pat ;

targets : target | target ',' | target (',' target)+ ','? ;
target : single | '*' single ;
single : name | primary '.' name | primary '[' subs ']' | '(' targets ')' | '[' targets ']' | '(' ')' | '[' ']' ;

stars : star | star ',' | star (',' star)+ ','? ;
star : test | '*' expr ;
named : test | name ':=' test ;
test : or | or 'if' or 'else' test | 'lambda' ':' test | 'lambda' lparams ':' test ;
lparams : l_pos ','? | l_pos ',' l_stars ','? | l_stars ','? ;
l_pos : l_plains l_slash? | l_plains l_slash ',' l_plains | l_plains l_slash ',' l_plains ',' l_defaults | l_plains l_slash ',' l_defaults | l_plains ',' l_defaults l_slash?
  | l_plains ',' l_defaults l_slash ',' l_defaults | l_defaults l_slash? | l_defaults l_slash ',' l_defaults ;
l_slash : ',' '/' ;
l_plains : l_plain (',' l_plain)* ;
l_defaults : l_default (',' l_default)* ;
l_plain : name ;
l_default : name '=' test ;
l_stars : '*' l_star (',' l_kwonly)* (',' l_dstar)? | '*' (',' l_kwonly)+ (',' l_dstar)? | l_dstar ;
l_star : name ;
l_kwonly : l_plain | l_default ;
l_dstar : '**' l_plain ;
or : not | or BOOL not ;
not : comp | 'not' not ;
comp : expr | comp cmp expr ;
cmp : CMP | 'in' | 'not' 'in' | 'is' | 'is' 'not' ;
expr : unary | expr bin unary ;
bin : BIN | '*' | '-' | '+' | '/' | '|' | '@' ;
unary : power | '-' unary | '+' unary | '~' unary ;
power : await | await '**' unary ;
await : primary | 'await' primary ;
primary : atom | primary '.' name | primary '(' ')' | primary '(' args ')' | primary '(' named comp_for ')' | primary '[' subs ']' ;
args : pargs ','? | pargs ',' kwargs ','? | kwargs ','? ;
pargs : parg (',' parg)* ;
parg : named | '*' test ;
kwargs : kw_star (',' kw_star)* | kw_star (',' kw_star)* ',' kw_dstar (',' kw_dstar)* | kw_dstar (',' kw_dstar)* ;
kw_star : name '=' test | '*' test ;
kw_dstar : name '=' test | '**' test ;
subs : sub (',' sub)* ','? ;
sub : named | '*' expr | test? ':' test? | test? ':' test? ':' test? ;
atom : name | NUMBER | strings | '...' | 'None' | 'True' | 'False' | '(' ')' | '(' yield ')' | '(' named ')' | '(' named_star ',' ')' | '(' named_star (',' named_star)+ ','? ')' | '(' named comp_for ')'
  | '[' ']' | '[' inner ']' | '[' named comp_for ']' | '{' '}' | '{' dict ','? '}' | '{' pair comp_for '}' | '{' inner '}' | '{' named comp_for '}' ;
inner : named_star (',' named_star)* ','? ;
named_star : named | '*' expr ;
dict : entry (',' entry)* ;
entry : pair | '**' expr ;
pair : test ':' test ;
comp_for : 'async'? 'for' targets 'in' or comp_rest ;
comp_rest : ('if' cond)* comp_for? ;
cond : or | name ':=' or | 'lambda' ':' test | 'lambda' lparams ':' test ;
yield : 'yield' stars? | 'yield' 'from' test ;
strings : string+ | BSTRING+ ;
string : STRING | FSTART (FTEXT | field)* FEND ;
field : '{' (stars | yield) '='? CONV? '}' | '{' (stars | yield) '='? CONV? ':' (FTEXT | field)* '}' ;
"""

_KEYWORDS = set(
    "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split()
)
_TOKEN = re.compile(
    r"""(?:[ \t\f]|\\\r?\n)*(?:(?P<end>\Z)
|(?P<nl>\r?\n|\r)
|(?P<comment>\#[^\r\n]*)
|(?P<string>(?:[bBuU]|[rR][bB]?|[bB][rR])?(?:\"\"\"(?:[^\\"]|\\.|"(?!""))*\"\"\"|'''(?:[^\\']|\\.|'(?!''))*'''|"(?:[^\\"\r\n]|\\\r?.)*"|'(?:[^\\'\r\n]|\\\r?.)*'))
|(?P<fstring>(?:[fFtT][rR]?|[rR][fFtT])(?:\"\"\"|'''|"|'))
|(?P<number>(?:0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*\.(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*|\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)(?:(?!\w)|(?=(?:and|else|for|if|in|is|not|or)\b)))
|(?P<name>[^\W\d]\w*)
|(?P<op>\*\*=|//=|>>=|<<=|\.\.\.|->|:=|\*\*|//|<<|>>|<=|>=|==|!=|[+\-*/%@&|^]=|[-+*/%@&|^~<>()\[\]{},:.;=]))""",
    re.X | re.S,
)
_AUG = set("+= -= *= /= %= @= &= |= ^= **= //= >>= <<=".split())
_BIN = set("% & ^ // << >>".split())
_CMP = set("< > <= >= == !=".split())
_PLAIN = {**dict.fromkeys(_AUG, "AUG"), **dict.fromkeys(_BIN, "BIN"), **dict.fromkeys(_CMP - {"!="}, "CMP"),
    **{c: c for c in (",", ".", ";", "=", "+", "-", "*", "/", "|", "@", "~", "**", "->", "...")}}
_SPACE = re.compile(r"(?:[ \t\f]|\\\r?\n)*")
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
_FBODY = {q: re.compile(r"(?:[^\\{}" + q[0] + ("" if len(q) == 3 else "\r\n") + r"]|\\N\{[^}]*\}|\\(?:\r\n|[^{}])|\\(?=[{}])|\{\{|\}\}" + (f"|{q[0]}(?!{q[0] * 2})" if len(q) == 3 else "") + ")+", re.S) for q in ("'", '"', "'''", '"""')}
_INDENT, _REST, _BREAK = re.compile(r"[ \t\f]*"), re.compile(r"[^\r\n]*"), re.compile(r"\r?\n|\r")
_BAD_BYTES = re.compile(r"(?<!\\)(?:\\\\)*\\x(?![0-9a-fA-F]{2})")
_BAD_ESCAPE = re.compile(r"(?<!\\)(?:\\\\)*\\(?:x(?![0-9a-fA-F]{2})|u(?![0-9a-fA-F]{4})|U(?!00(?:0[0-9a-fA-F]|10)[0-9a-fA-F]{4})|N(?!\{[^}\n]+\}))")
_FSPEC = re.compile(r"[^{}\r\n'\"]+")


class LexError(Exception):
    def __init__(self, at: int):
        self.at = at


def tokenize(src: str) -> tuple[list[str], list[int]]:
    """(terminals, their places)."""
    toks: list[str] = []
    at: list[int] = []
    if src.startswith("﻿"):
        src = " " + src[1:] if not src[1:2].isspace() else src[1:]
        src = src.lstrip(" ") if src[:1] == " " else src
    if "\0" in src:
        raise LexError(src.index("\0"))
    pos, n = 0, len(src)
    indents = [0]
    alts = [0]
    depth: list[str] = []
    fstrings: list[tuple[str, int]] = []  # (quote, depth of brackets outside), or quote "" while in a format spec
    line_start = True

    def put(t: str, p: int) -> None:
        toks.append(t)
        at.append(p)

    def f_text(quote: str) -> None:
        nonlocal pos
        if m := _FBODY[quote].match(src, pos):
            put("FTEXT", pos)
            pos = m.end()
        if src.startswith(quote, pos):
            put("FEND", pos)
            pos += len(quote)
            fstrings.pop()
        elif pos < n and src[pos] == "{":
            put("{", pos)
            depth.append("f")
            pos += 1
        else:
            raise LexError(pos)

    def f_spec() -> None:
        nonlocal pos
        if m := _FSPEC.match(src, pos):
            put("FTEXT", pos)
            pos = m.end()
        if pos < n and src[pos] == "{":
            put("{", pos)
            depth.append("f")
            pos += 1
        elif pos < n and src[pos] == "}":
            put("}", pos)
            depth.pop()
            pos += 1
            resume()
        else:
            raise LexError(pos)

    def resume() -> None:
        """After the end of a replacement field: back to the text or spec around it."""
        if depth and depth[-1] == "spec":
            f_spec()
        else:
            f_text(fstrings[-1][0])

    match = _TOKEN.match
    while pos < n:
        if line_start and not depth:
            m = _INDENT.match(src, pos)
            ws = m.group()
            end = m.end()
            if end < n and src[end] in "\r\n#" or src.startswith("\\\n", end):
                pos = end
                line_start = False
                if src[end] not in "\\":
                    if src[end] == "#":
                        pos = _REST.match(src, end).end()
                    m = _BREAK.match(src, pos)
                    pos = m.end() if m else n
                    line_start = True
                continue
            if end >= n:
                break
            ws = ws.rpartition("\f")[2]
            col = alt = 0
            for c in ws:
                col, alt = (col + 1, alt + 1) if c == " " else (col // 8 * 8 + 8, alt + 1)
            if col > indents[-1]:
                if alt <= alts[-1]:
                    raise LexError(end)
                indents.append(col)
                alts.append(alt)
                put("INDENT", end)
            else:
                while col < indents[-1]:
                    indents.pop()
                    alts.pop()
                    put("DEDENT", end)
                if col != indents[-1] or alt != alts[-1]:
                    raise LexError(end)
            pos = end
            line_start = False
        m = match(src, pos)
        if not m:
            pos = _SPACE.match(src, pos).end()
            if depth and depth[-1] == "f" and src[pos] == "!" and re.match(r"![rsa]\b", src[pos : pos + 3]):
                put("CONV", pos)
                pos += 2
                continue
            raise LexError(pos)
        kind = m.lastgroup
        text = m[kind]
        pos = m.end()
        p = pos - len(text)
        if kind == "name":
            if text in _KEYWORDS:
                toks.append("BOOL" if text == "and" or text == "or" else text)
            elif text in ("match", "case", "type") and (not toks or toks[-1] in ("NEWLINE", "INDENT", "DEDENT", ";", ":")):
                toks.append(text)
            else:
                toks.append("NAME")
            at.append(p)
        elif kind == "op" and (t := _PLAIN.get(text)) is not None:
            toks.append(t)
            at.append(p)
        elif kind == "op":
            if text in _OPEN:
                depth.append(_OPEN[text])
                put(text, p)
            elif text in _CLOSE:
                if not depth:
                    raise LexError(p)
                if depth[-1] == "f" and text == "}":
                    depth.pop()
                    put(text, p)
                    resume()
                    continue
                if depth.pop() != text:
                    raise LexError(p)
                put(text, p)
            elif depth and depth[-1] == "f" and text in (":", ":="):
                depth[-1] = "spec"
                put(":", p)
                pos = p + 1
                f_spec()
            elif text in _AUG:
                put("AUG", p)
            elif text in _BIN:
                put("BIN", p)
            elif text in _CMP:
                if text == "!=" and depth and depth[-1] == "f" and src[pos : pos + 1] == "}":
                    raise LexError(p)
                put("CMP", p)
            else:
                put(text, p)
        elif kind == "nl":
            if depth:
                continue
            put("NEWLINE", p)
            line_start = True
        elif kind == "string":
            raw = text[0] in "rR" or text[1] in "rR" and text[0] in "bB"
            if text[0] in "bB" or text[0] in "rR" and text[1] in "bB":
                if not text.isascii() or not raw and "\\" in text and _BAD_BYTES.search(text):
                    raise LexError(p)
                put("BSTRING", p)
            else:
                if not raw and "\\" in text and _BAD_ESCAPE.search(text):
                    raise LexError(p)
                put("STRING", p)
        elif kind == "number":
            if re.match(r"0[0-9_]*[1-9]", text) and not re.search(r"[.eEjJ]", text) and not re.match(r"0[xXbBoO]", text):
                raise LexError(p)
            put("NUMBER", p)
        elif kind == "fstring":
            put("FSTART", p)
            quote = re.search(r"['\"]+$", text).group()
            fstrings.append((quote, len(depth)))
            f_text(quote)
    if depth or fstrings:
        raise LexError(n)
    if toks and toks[-1] not in ("NEWLINE", "DEDENT") and not (toks[-1] == "INDENT"):
        put("NEWLINE", n)
    for _ in indents[1:]:
        put("DEDENT", n)
    return toks, at
