"""Ruby: tokens and grammar. The lexer decides, from the token before and the
spaces around, what Ruby decides from its lexer state: whether a sign is unary,
a brace opens a block, a bracket indexes, or a keyword is a modifier."""

from __future__ import annotations

import re

from .python_grammar import LexError

GRAMMAR = r"""
file : body_0 ;
body_0 : stmts? ;
stmts : terms | terms? list terms? ;
terms : (NL | ';')+ ;
list : stmt | list terms stmt ;
stmt : expr | stmt MOD expr | stmt RESCUEMOD stmt_v | 'alias' fname_a fname_a | 'undef' fname_a (',' fname_a)* | 'BEGIN' BRACE stmts? '}' | 'END' BRACE stmts? '}' | multi ;
stmt_v : expr ;
fname_a : FNAME | ID | CONST | SYMBOL | IVAR ;
multi : mlhs '=' rvalue | mlhs '=' rvalue RESCUEMOD stmt_v ;
rvalue : expr_v | args_r ;
mlhs : mitem ',' | mitem ',' mlist | mitem ',' mlist ',' | splat_l | splat_l ',' mlist ;
mlist : mitem_s (',' mitem_s)* ;
mitem_s : mitem | splat_l ;
splat_l : STAR lhs | STAR ;
mitem : lhs | '(' mlist ','? ')' | LPAREN mlist ','? ')' ;
expr : not | expr ANDOR nls? not ;
nls : NL+ ;
not : expr_v | 'not' not | BANG command | arg '=>' pattern | arg 'in' pattern ;
expr_v : arg | command ;
command : callee cargs | callee cargs do_block | jump cargs | lhs '=' command | lhs ASSIGN command | lhs '=' nls command ;
jump : 'return' | 'break' | 'next' ;
callee : ID | CONST | primary DOT mname | 'super' | 'yield' | ID_Q ;
mname : ID | CONST | FNAME | ID_Q ;
cargs : carg (',' nls? carg)* ;
carg : arg | STAR arg | DSTAR arg | AMP arg | LABEL nls? arg | LABEL | DLABEL nls? arg | arg '=>' nls? arg | command_nested ;
command_nested : callee cargs ;
arg : ternary | lhs '=' nls? arg | lhs ASSIGN nls? arg | lhs '=' nls? arg RESCUEMOD arg | 'defined?' arg | lhs '=' args_r ;
args_r : ritem ',' nls? ritem (',' nls? ritem)* | STAR arg ;
ritem : arg | STAR arg ;
ternary : range | range '?' nls? arg nls? ':' nls? arg | range '?' nls? LABEL nls? arg ;
range : bin | bin RANGE bin | bin RANGE | BRANGE bin ;
bin : unary | bin op nls? unary ;
op : OP | '|' | '<' ;
unary : postfix | UN unary | BANG unary | AMPUN unary ;
postfix : primary ;
lhs : ID | CONST | IVAR | primary DOT ID | primary DOT CONST | primary IDX args? nls? ']' | 'self_' | primary DCOLON CONST | DCOLON0 CONST ;
primary : literal | ID | CONST | ID_Q | IVAR | 'self' | 'nil' | 'true' | 'false' | '__FILE__' | '__LINE__' | '__ENCODING__' | 'redo' | 'retry' | jump | 'yield' | 'super'
  | call | call brace_block | call do_block | primary_m brace_block | primary_m do_block | primary IDX nls? args? nls? ']' | '[' nls? args? nls? ']' | '{' nls? pairs? nls? '}'
  | '(' stmts? ')' | LPAREN stmts? ')' | 'begin' body 'end' | def | class | if | unless | while | case | for | lambda | DCOLON0 CONST | primary DCOLON CONST
  | 'not' LPAREN expr ')' | 'defined?' LPAREN nls? expr nls? ')' ;
primary_m : ID | CONST | ID_Q | primary DOT mname | 'super' | 'yield' | primary DCOLON ID ;
call : primary DOT mname | primary DOT mname paren | primary DOT paren | ID paren | CONST paren | ID_Q paren | 'super' paren | 'yield' paren | jump_paren | primary DCOLON ID | primary DCOLON ID paren | primary DCOLON CONST paren ;
jump_paren : jump paren ;
paren : LPAREN nls? ')' | LPAREN nls? args nls? ')' | LPAREN nls? command nls? ')' ;
args : carg_p (',' nls? carg_p)* | carg_p (',' nls? carg_p)* ',' ;
carg_p : arg | STAR arg | STAR | DSTAR arg | DSTAR | AMP arg | AMP | LABEL nls? arg | LABEL | DLABEL nls? arg | arg '=>' nls? arg | '...' ;
pairs : pair (nls? ',' nls? pair)* (nls? ',')? ;
pair : arg '=>' nls? arg | LABEL nls? arg | LABEL | DLABEL nls? arg | DSTAR arg ;
brace_block : BRACE bparams? stmts? '}' ;
do_block : 'do' bparams? do_body 'end' | 'do' terms bparams do_body 'end' ;
do_body : body ;
bparams : '|' '|' | '|' nls? params nls? '|' | '|' nls? params ';' ids '|' | OROR ;
ids : ID (',' ID)* ;
lambda : ARROW lambda_params? BRACE stmts? '}' | ARROW lambda_params? 'do' body 'end' ;
lambda_params : LPAREN nls? params? nls? ')' | '(' nls? params? nls? ')' | params ;
params : param (',' nls? param)* ','? ;
param : ID | ID '=' ternary | STAR ID | STAR | DSTAR ID | DSTAR | DSTAR 'nil' | AMP ID | AMP | LABEL ternary | LABEL | '(' params ')' | LPAREN params ')' | '...' ;
def : 'def' dname dparams? dbody | 'def' dname dparams? '=' nls? stmt_e ;
stmt_e : arg | command | arg RESCUEMOD arg ;
dname : FNAME | FNAME DOT FNAME | 'self' DOT FNAME | CONST DOT FNAME | ID DOT FNAME ;
dparams : LPAREN nls? params? nls? ')' | '(' nls? params? nls? ')' ;
dbody : terms body_t 'end' | body_n 'end' | params terms body_t 'end' ;
body_n : list_end rescue* | stmt_first ;
stmt_first : expr terms? ;
list_end : 'never_' ;
body_t : list? terms? rescue* else? ensure? ;
body : terms? list? terms? rescue* else? ensure? ;
rescue : 'rescue' exc? ('=>' lhs)? then stmts? | 'rescue' exc? ('=>' lhs)? 'then' ;
exc : exc_item (',' nls? exc_item)* ;
exc_item : ternary | STAR arg ;
then : terms | 'then' | terms 'then' ;
else : 'else' stmts? ;
ensure : 'ensure' stmts? ;
class : 'class' cpath superclass? cterm body 'end' | 'class' LSHIFT expr terms body 'end' | 'module' cpath body 'end' ;
cterm : terms ;
cpath : CONST | cpath DCOLON CONST | DCOLON0 CONST ;
superclass : '<' expr ;
if : 'if' expr then stmts? elsif* else? 'end' ;
elsif : 'elsif' expr then stmts? ;
unless : 'unless' expr then stmts? else? 'end' ;
while : 'while' expr loop_do stmts? 'end' ;
loop_do : DOLOOP | terms | terms DOLOOP ;
for : 'for' for_vars 'in' expr loop_do stmts? 'end' ;
for_vars : lhs (',' lhs)* ;
case : 'case' expr? terms when+ else? 'end' | 'case' expr terms in+ else? 'end' ;
when : 'when' when_args then stmts? ;
when_args : when_arg (',' nls? when_arg)* ;
when_arg : arg | STAR arg ;
in : 'in' pattern_top then stmts? ;
pattern_top : pattern_list | pattern_list MOD expr ;
pattern_list : pattern | pattern ',' | pattern (',' pattern_el)+ ','? | pattern_splat (',' pattern_el)* | pkeys ;
pattern_el : pattern | pattern_splat ;
pattern_splat : STAR ID | STAR ;
pattern : palt | palt '=>' ID ;
palt : pprim | palt '|' pprim ;
pprim : literal | ID | 'nil' | 'true' | 'false' | 'self' | UN literal | prange | '^_' | cpath | cpath LPAREN pinner? ')' | cpath IDX pinner? ']' | '[' pinner? ']' | '{' pkeys? '}' | '(' pattern ')' | LPAREN pattern ')' | lambda ;
prange : literal RANGE literal | literal RANGE | BRANGE literal ;
pinner : pattern_list ;
pkeys : pkey (',' nls? pkey)* ','? ;
pkey : LABEL | LABEL pattern | DSTAR ID | DSTAR 'nil' ;
literal : NUMBER | strings | SYMBOL | REGEX | WORDS | XSTR | CHAR ;
strings : STRING+ ;
"""
for _drop in (" | 'self_'", " | '^_'"):
    GRAMMAR = GRAMMAR.replace(_drop, "")
GRAMMAR = GRAMMAR.replace("body_n : list_end rescue* | stmt_first ;\nstmt_first : expr terms? ;\nlist_end : 'never_' ;", "body_n : expr terms? ;")

_KEYWORDS = set(
    "alias and begin BEGIN break case class def defined? do else elsif end END ensure false for if in module next nil not or redo rescue retry return self super then true undef unless until when while yield __FILE__ __LINE__ __ENCODING__".split()
)
_WS = re.compile(r"(?:[ \t\f\v\r]|\\\r?\n)+")
_COMMENT = re.compile(r"#[^\n]*")
_NUMBER = re.compile(r"(?:0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*|0[bB][01](?:_?[01])*|0[oO]?[0-7](?:_?[0-7])*(?![\d.])|0[dD]\d+|\d(?:_?\d)*(?:\.\d(?:_?\d)*)?(?:[eE][+-]?\d(?:_?\d)*)?)r?i?(?![A-Za-z_0-9])")
_IDENT = re.compile(r"[^\W\d]\w*")
_IVAR = re.compile(r"@@?[^\W\d]\w*|\$(?:[^\W\d]\w*|\d+|-\w|[~*$?!@/\;,.=:_\"<>&`'+])")
_OPM = re.compile(r"\[\]=?|\*\*|<=>|===?|=~|!~|![~=]?|<<|>>|<=|>=|[+\-~]@?|[*/%&|^<>`]")
_OP = re.compile(
    r"\*\*=|<=>|===|\.\.\.|<<=|>>=|&&=|\|\|=|&\.|\*\*|==|!=|>=|<=|&&|\|\||=~|!~|=>|->|\.\.|::|<<|>>|[+\-*/%&|^]=|[-+*/%&|^!~<>=?:;,.(){}\[\]]"
)
_SYMBOL = re.compile(r":(?:[^\W\d]\w*[?!=]?(?![=~>])|[^\W\d]\w*[?!]?|@@?[^\W\d]\w*|\$\w+|\[\]=?|\*\*|<=>|===?|=~|![~=]?|<<|>>|<=|>=|[+\-~]@?|[*/%&|^<>`])")
_CLOSE = {"(": ")", "[": "]", "{": "}", "<": ">"}
#: After one of these a value has ended.
_VALUE = {"ID", "CONST", "ID_Q", "IVAR", "NUMBER", "STRING", "SYMBOL", "REGEX", "WORDS", "XSTR", "CHAR", ")", "]", "}", "end", "self", "nil", "true",
    "false", "__FILE__", "__LINE__", "__ENCODING__", "FNAME", "redo", "retry"}
_CMD = {"ID", "ID_Q", "FNAME", "CONST", "super", "yield", "return", "break", "next"}
_ASSIGN = set("+= -= *= /= %= &= |= ^= <<= >>= **= &&= ||=".split())
_BIN = set("** <=> == === != >= <= && || =~ !~ << >> + - * / % & ^ >".split())
_CONT = {"OP", "=", "ASSIGN", ",", "DOT", "?", ":", "=>", "'<'", "<", "ANDOR", "UN", "BANG", "STAR", "AMP", "DCOLON", "not", "MOD_"}


def tokenize(src: str):
    """(terminals, places, None, the same two of every interpolation)."""
    inner: list[tuple[list[str], list[int]]] = []
    toks, at, _, _ = _program(src, 1 if src.startswith("﻿") else 0, inner, False)
    return toks, at, None, inner


def _program(src: str, pos: int, inner: list, nested: bool):
    """(terminals, places, end, heredocs that still wait for their bodies). A
    nested program is an interpolation and ends behind the brace that closes it."""
    toks: list[str] = []
    at: list[int] = []
    n = len(src)
    heredocs: list[tuple[str, bool, bool]] = []
    nest: list[str] = []  # open brackets, and "loop" while a loop head waits for its do
    space = True
    line_start = not nested

    def put(t: str, p: int) -> None:
        toks.append(t)
        at.append(p)

    def interpolation(p: int) -> int:
        """p is behind '#{'; the place behind the matching brace. What stands
        between is lexed and parsed as a program of its own."""
        own, places, end, waiting = _program(src, p, inner, True)
        inner.append((own, places))
        heredocs.extend(waiting)
        return end

    def quoted(p: int, opener: str, closer: str, interp: bool) -> int:
        q, depth = p, 1
        while q < n:
            c = src[q]
            if c == "\\":
                q += 2
                continue
            if c == closer:
                depth -= 1
                if not depth:
                    return q + 1
            elif c == opener and opener != closer:
                depth += 1
            elif interp and c == "#" and src.startswith("#{", q):
                q = interpolation(q + 2)
                continue
            q += 1
        raise LexError(p)

    def body_of_heredocs(p: int) -> int:
        due = heredocs[:]
        heredocs.clear()
        for tag, squiggly, interp in due:
            start = p
            while True:
                if p >= n:
                    raise LexError(start)
                e = src.find("\n", p)
                e = n if e < 0 else e
                line, begins = src[p:e].rstrip("\r"), p
                p = min(e + 1, n)
                if (line.strip() if squiggly else line) == tag:
                    break
                if e >= n:
                    raise LexError(start)
            q = start
            while interp and q < begins:
                if src.startswith("#{", q):
                    q = interpolation(q + 2)
                    if q > begins:
                        raise LexError(begins)
                else:
                    q += 2 if src[q] == "\\" else 1
        return p

    while pos < n:
        if line_start:
            line_start = False
            if src.startswith("=begin", pos) and (pos + 6 >= n or src[pos + 6].isspace()):
                m = re.compile(r"^=end(?:\s[^\n]*)?(?:\n|$)", re.M).search(src, pos)
                if not m:
                    raise LexError(pos)
                pos = m.end()
                line_start = True
                continue
            if re.compile(r"__END__\r?(?:\n|$)").match(src, pos):
                break
        m = _WS.match(src, pos)
        if m:
            pos, space = m.end(), True
            continue
        c = src[pos]
        if c == "#":
            pos = _COMMENT.match(src, pos).end()
            continue
        prev = toks[-1] if toks else "NL"
        if c == "\n":
            p = pos
            pos = body_of_heredocs(pos + 1) if heredocs else pos + 1
            line_start = space = True
            if nest and nest[-1] == "loop":
                nest.pop()
            if prev in _CONT or prev in ("NL",) or prev == "|" and not _bar_closes(toks):
                continue
            # a leading dot on the next line goes on with the call
            if re.compile(r"(?:[ \t\r]*(?:#[^\n]*)?\n)*[ \t]*(?:\.(?!\.)|&\.)").match(src, pos):
                continue
            put("NL", p)
            continue
        begin = prev not in _VALUE
        after_name = prev in _CMD and space and pos + 1 < n and not src[pos + 1].isspace()
        p = pos
        if prev == "def" or prev == "DOT" or (prev in ("alias", "undef") or len(toks) > 1 and toks[-2] == "alias") and prev != "NL":
            m = _IDENT.match(src, pos)
            if m and prev == "def" and src[m.end() : m.end() + 1] == "." and m.group() == "self":
                put("self", p)
                pos, space = m.end(), False
                continue
            if m:
                pos = m.end()
                word = m.group()
                if pos < n and src[pos] in "?!" and src[pos + 1 : pos + 2] != "=":
                    pos += 1
                elif prev != "DOT" and pos < n and src[pos] == "=" and src[pos + 1 : pos + 2] not in ("=", "~",
                    ">") and (src[pos + 1 : pos + 2] in "( \n" or True) and prev == "def" and src[pos + 1 : pos + 2] in "(":
                    pos += 1
                if prev == "DOT" and not (len(toks) > 2 and toks[-3] == "def"):
                    t = "CONST" if word[0].isupper() else "ID" if src[pos - 1] not in "?!" else "ID_Q"
                elif prev == "DOT" and pos < n and src[pos] == "=" and src[pos + 1 : pos + 2] == "(":
                    pos += 1
                    t = "FNAME"
                else:
                    t = "FNAME"
                put(t, p)
                space = False
                continue
            m = _OPM.match(src, pos)
            if m and prev != "DOT" or m and prev == "DOT" and c != "(":
                put("FNAME", p)
                pos, space = m.end(), False
                continue
        if c.isdigit():
            m = _NUMBER.match(src, pos)
            if not m:
                raise LexError(pos)
            pos = m.end()
            put("NUMBER", p)
        elif c.isalpha() or c == "_" or ord(c) > 127:
            m = _IDENT.match(src, pos)
            if not m:
                raise LexError(pos)
            word = m.group()
            pos = m.end()
            if pos < n and src[pos] in "?!" and src[pos + 1 : pos + 2] not in ("=",) or src.startswith("?==", pos):
                # x ? a : b has a space; a method name ends right here
                word += src[pos]
                pos += 1
            label = pos < n and src[pos] == ":" and src[pos + 1 : pos + 2] != ":" and not (prev == "?" and False)
            if label and "?" in toks[-40:] and not space_after(src, pos + 1):
                label = False
            if label and not (_ternary_open(toks) and prev != "," and prev != "LPAREN" and prev != "(" and prev != "{" and space_after(src, pos + 1) is False):
                if not (_ternary_open(toks) and prev == "?"):
                    pos += 1
                    put("LABEL", p)
                    space = False
                    continue
            if word in _KEYWORDS:
                if word in ("if", "unless", "while", "until", "rescue") and not begin or word in ("if", "unless", "while",
                    "until") and prev in ("return", "break", "next", "super", "yield"):
                    put("RESCUEMOD" if word == "rescue" else "MOD", p)
                elif word in ("while", "until", "for"):
                    put("while" if word != "for" else "for", p)
                    nest.append("loop")
                elif word == "do":
                    if nest and nest[-1] == "loop":
                        nest.pop()
                        put("DOLOOP", p)
                    else:
                        put("do", p)
                elif word in ("and", "or"):
                    put("ANDOR", p)
                else:
                    put(word, p)
            elif word[-1] in "?!":
                put("ID_Q", p)
            else:
                put("CONST" if word[0].isupper() else "ID", p)
        elif c in "@$":
            m = _IVAR.match(src, pos)
            if not m:
                raise LexError(pos)
            pos = m.end()
            put("IVAR", p)
        elif c in "\"'`":
            pos = quoted(pos + 1, c, c, c != "'")
            if pos < n and src[pos] == ":" and src[pos + 1 : pos + 2] != ":" and c != "`" and prev in ("{", ",", "LPAREN", "NL", "BRACE", "ID"):
                pos += 1
                put("DLABEL", p)
            else:
                put("XSTR" if c == "`" else "STRING", p)
        elif c == "%" and (begin or after_name and src[pos + 1] != "=") and re.match(r"%(?:[qQwWiIrsx]?[^\w\s])", src[pos : pos + 3]):
            k = pos + 1
            kind = "Q"
            if src[k].isalpha():
                kind = src[k]
                k += 1
            pos = quoted(k + 1, src[k], _CLOSE.get(src[k], src[k]), kind not in "qwis")
            if kind == "r":
                pos = re.compile(r"[a-z]*").match(src, pos).end()
            put("WORDS" if kind in "wWiI" else "REGEX" if kind == "r" else "SYMBOL" if kind == "s" else "XSTR" if kind == "x" else "STRING", p)
        elif c == "/" and (begin or after_name and src[pos + 1] != "="):
            q, in_class = pos + 1, False
            while True:
                if q >= n or src[q] == "\n" and False:
                    raise LexError(p)
                d = src[q]
                if d == "\\":
                    q += 2
                    continue
                if d == "#" and src.startswith("#{", q):
                    q = interpolation(q + 2)
                    continue
                if d == "/":
                    break
                q += 1
            _regex_ok(src[p + 1 : q], p)
            pos = re.compile(r"[a-z]*").match(src, q + 1).end()
            put("REGEX", p)
        elif c == "?" and begin and pos + 1 < n and not src[pos + 1].isspace() and not (src[pos + 2 : pos + 3].isalnum() and src[pos + 1] != "\\"):
            pos += 3 if src[pos + 1] == "\\" else 2
            put("CHAR", p)
        elif src.startswith("<<", pos) and (begin or after_name or prev == "ID" and space) and (m := re.compile(r"<<([~-]?)(?:(\w+)|\"([^\"\n]+)\"|'([^'\n]+)')").match(src, pos)) and (m.group(1) or (m.group(2) or "A")[0].isupper()) and prev != "class":
            heredocs.append((m.group(2) or m.group(3) or m.group(4), bool(m.group(1)), m.group(4) is None))
            pos = m.end()
            put("STRING", p)
        elif c == ":" and src[pos + 1 : pos + 2] in ('"', "'") and (begin or space):
            pos = quoted(pos + 2, src[pos + 1], src[pos + 1], src[pos + 1] == '"')
            put("SYMBOL", p)
        elif c == ":" and src[pos + 1 : pos + 2] != ":" and (m := _SYMBOL.match(src, pos)) and (begin or space or prev in ("ID",)) :
            pos = m.end()
            put("SYMBOL", p)
        else:
            m = _OP.match(src, pos)
            if not m:
                raise LexError(pos)
            text = m.group()
            pos = m.end()
            if text == "(":
                nest.append(")")
                put("LPAREN" if not space and prev in (_VALUE | _CMD | {"DOT", "not", "defined?"}) or prev == "FNAME" else "(", p)
            elif text == "[":
                nest.append("]")
                put("IDX" if prev in _VALUE and (not space or prev not in ("ID", "ID_Q", "CONST") and prev != "FNAME") else "[", p)
            elif text == "{":
                nest.append("}")
                put("BRACE" if prev in _VALUE or prev in ("ARROW", "super", "yield", "BEGIN", "END") else "{", p)
            elif text in (")", "]", "}"):
                while nest and nest[-1] == "loop":
                    nest.pop()
                if nested and not nest and text == "}":
                    return toks, at, pos, heredocs
                if not nest or nest.pop() != text:
                    raise LexError(p)
                put(text, p)
            elif text in (".", "&."):
                put("DOT", p)
            elif text == "::":
                put("DCOLON" if prev in _VALUE and not (space and not src[pos : pos + 1].isspace() and prev in _CMD) else "DCOLON0", p)
            elif text == "->":
                put("ARROW", p)
            elif text in ("..", "..."):
                if text == "..." and prev in ("LPAREN", "(", ",") and src[pos : pos + 1] == ")":
                    put("...", p)
                else:
                    put("RANGE" if not begin else "BRANGE", p)
            elif text in ("*", "**", "&") and (begin or after_name and not (prev == "CONST" and False)):
                put({"*": "STAR", "**": "DSTAR", "&": "AMP"}[text], p)
            elif text in ("-", "+", "~") and (begin or after_name and text != "~") or text == "~":
                put("UN", p)
            elif text == "!":
                put("BANG", p)
            elif text == "<<" and prev == "class":
                put("LSHIFT", p)
            elif text in _ASSIGN:
                put("ASSIGN", p)
            elif text == "||" and (prev in ("BRACE", "do") or prev == "{"):
                put("OROR", p)
            elif text in _BIN:
                put("OP", p)
            else:
                put(text, p)
        space = False
    if nested or heredocs:
        raise LexError(n)
    if any(x != "loop" for x in nest):
        raise LexError(n)
    return toks, at, pos, heredocs


def space_after(src: str, p: int) -> bool:
    return p >= len(src) or src[p].isspace() or src[p] in ",)}|"


def _ternary_open(toks: list[str]) -> bool:
    """Whether a question mark on this line still waits for its colon."""
    open_ = 0
    for t in reversed(toks):
        if t in ("NL", ";"):
            break
        if t == "?":
            open_ += 1
        elif t == ":":
            open_ -= 1
    return open_ > 0


def _bar_closes(toks: list[str]) -> bool:
    """Whether the bar just read ends block parameters."""
    bars = 0
    for t in reversed(toks):
        if t == "|":
            bars += 1
        elif t in ("BRACE", "do", "{"):
            return bars == 2
        elif t in ("NL", ";"):
            break
    return False


def _regex_ok(body: str, p: int) -> None:
    """Brackets of a pattern must balance."""
    depth, q, in_class = 0, 0, 0
    while q < len(body):
        d = body[q]
        if d == "\\":
            q += 2
            continue
        if in_class:
            if d == "[":
                in_class += 1
            elif d == "]":
                in_class -= 1
        elif d == "[":
            in_class = 1
            if body[q + 1 : q + 2] == "]":
                q += 1
        elif d == "(":
            depth += 1
        elif d == ")":
            depth -= 1
            if depth < 0:
                raise LexError(p)
        q += 1
    if depth or in_class:
        raise LexError(p)
