"""Go: tokens (with the automatic semicolons of the language) and grammar.

A composite literal may not follow a bare type name in the head of if, for and
switch; rules marked with % come with and without that exception (_h: in a head)."""

from __future__ import annotations

import re

from .python_grammar import LexError

_RULES = r"""
file : 'package' ID ';' (import ';')* (top ';')* | 'package' ID ';' (import ';')* (top ';')* top ;
import : 'import' spec_i | 'import' '(' ')' | 'import' '(' spec_i (';' spec_i)* ';'? ')' ;
spec_i : STRING | ID STRING | '.' STRING ;
top : decl | func | method ;
decl : 'const' const_spec | 'const' '(' ')' | 'const' '(' const_spec (';' const_spec)* ';'? ')' | 'var' var_spec | 'var' '(' ')' | 'var' '(' var_spec (';' var_spec)* ';'? ')'
  | 'type' type_spec | 'type' '(' ')' | 'type' '(' type_spec (';' type_spec)* ';'? ')' ;
const_spec : ids | ids type? '=' exprs ;
var_spec : ids type | ids type? '=' exprs ;
type_spec : ID tparams? type | ID tparams? '=' type ;
tparams : '[' tparam (',' tparam)* ','? ']' ;
tparam : ids constraint ;
constraint : term ('|' term)* ;
term : type | '~' type ;
ids : ID (',' ID)* ;
func : 'func' ID tparams? sig block? ;
method : 'func' params ID sig block? ;
sig : params | params type | params params ;
params : '(' ')' | '(' param (',' param)* ','? ')' ;
param : type | ID type | '...' type | ID '...' type ;
type : tname | '*' type | '[' ']' type | '[' expr ']' type | '[' '...' ']' type | 'map' '[' type ']' type | chan | 'func' sig | struct | interface | '(' type ')' ;
tname : ID | ID '.' ID | tname_args ;
tname_args : ID '[' types ']' | ID '.' ID '[' types ']' ;
types : type (',' type)* ','? ;
chan : 'chan' type | 'chan' '<-' type | '<-' 'chan' type ;
struct : 'struct' '{' '}' | 'struct' '{' field (';' field)* ';'? '}' ;
field : ids type STRING? | embedded STRING? ;
embedded : tname | '*' tname ;
interface : 'interface' '{' '}' | 'interface' '{' elem (';' elem)* ';'? '}' ;
elem : ID sig | constraint ;
block : '{' stmts '}' ;
stmts : stmt? | stmts ';' stmt? ;
stmt : decl | simple | ID ':' stmt? | 'go' expr | 'defer' expr | 'return' exprs? | 'break' ID? | 'continue' ID? | 'goto' ID | 'fallthrough' | block | if | switch | select | for ;
simple% : expr% | expr% '<-' expr% | expr% INC | exprs% ASSIGN exprs% | exprs% '=' exprs% | exprs% ':=' exprs% ;
exprs% : expr% (',' expr%)* ;
if : 'if' (simple_h? ';')? expr_h block | 'if' (simple_h? ';')? expr_h block 'else' (if | block) ;
switch : 'switch' (simple_h? ';')? switch_on? '{' clause* '}' ;
switch_on : simple_h ;
clause : 'case' case_list ':' stmts | 'default' ':' stmts ;
case_list : case_item (',' case_item)* ;
case_item : expr | type_only ;
type_only : '[' ']' type | 'map' '[' type ']' type | chan | struct | interface | 'func' sig | '*' type ;
select : 'select' '{' comm* '}' ;
comm : 'case' simple ':' stmts | 'default' ':' stmts ;
for : 'for' block | 'for' simple_h block | 'for' simple_h? ';' expr_h? ';' simple_h? block | 'for' range block ;
range : 'range' expr_h | exprs_h '=' 'range' expr_h | exprs_h ':=' 'range' expr_h ;
expr% : unary% | expr% op unary% ;
op : BIN | '*' | '|' ;
unary% : primary% | UN unary% | '*' unary% | '<-' unary% | '~' unary% ;
primary_h : base | primary_h rest | func_lit ;
primary : base | primary rest | func_lit | ID composite | ID '.' ID composite | tname_args composite ;
base : ID | NUMBER | STRING | CHAR | '(' expr ')' | '(' type_only ')' | lit_type composite | conversion ;
conversion : '[' ']' type args | 'map' '[' type ']' type args | chan args | interface args | 'func' sig args ;
lit_type : '[' ']' type | '[' expr ']' type | '[' '...' ']' type | 'map' '[' type ']' type | struct ;
func_lit : 'func' sig block ;
rest : '.' ID | '.' '(' type ')' | '.' '(' 'type' ')' | '[' expr ']' | '[' index (',' index)+ ','? ']' | '[' type_only ']' | '[' expr? ':' expr? ']' | '[' expr? ':' expr ':' expr ']' | args ;
index : expr | type_only ;
args : '(' ')' | '(' arg (',' arg)* ','? ')' | '(' arg (',' arg)* '...' ','? ')' ;
arg : expr | type_only ;
composite : '{' '}' | '{' item (',' item)* ','? '}' ;
item : value | value ':' value ;
value : expr | composite ;
"""


def _spread(rules: str) -> str:
    out = []
    for rule in rules.split(" ;\n"):
        out += [rule.replace("%", f) for f in ("", "_h")] if "%" in rule else [rule]
    return " ;\n".join(out)


GRAMMAR = _spread(_RULES)
_KEYWORDS = set("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
_TOKEN = re.compile(
    r"""(?P<ws>[ \t\r]+)|(?P<nl>\n)|(?P<comment>//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/)
|(?P<id>[^\W\d]\w*)
|(?P<number>(?:0[xX](?:_?[0-9a-fA-F])+(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?\d+)?|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*\.(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*|\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?)i?(?!\w))
|(?P<string>"(?:[^"\\\n]|\\(?:[abfnrtv\\"]|[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))*"|`[^`]*`)
|(?P<char>'(?:[^'\\\n]|\\(?:[abfnrtv\\']|[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))')
|(?P<op><<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|<<|>>|&\^|[+\-*/%&|^]=|[-+*/%&|^!~<>=:;,.(){}\[\]])""",
    re.X | re.S,
)
_ASSIGN = set("+= -= *= /= %= &= |= ^= <<= >>= &^=".split())
_BIN = set("&& || == != < > <= >= / % << >> &^".split())
_ENDS = {"ID", "NUMBER", "STRING", "CHAR", "break", "continue", "fallthrough", "return", "INC", ")", "]", "}"}


def tokenize(src: str):
    toks: list[str] = []
    at: list[int] = []
    pos, n = (1 if src.startswith("﻿") else 0), len(src)
    match = _TOKEN.match
    while pos < n:
        m = match(src, pos)
        if not m:
            raise LexError(pos)
        kind, text, p = m.lastgroup, m.group(), pos
        pos = m.end()
        if kind == "ws":
            continue
        if kind == "nl" or kind == "comment":
            if "\n" in text and toks and toks[-1] in _ENDS:
                toks.append(";")
                at.append(p)
            continue
        if kind == "id":
            t = text if text in _KEYWORDS else "ID"
        elif kind == "op":
            # + - ^ & are binary after an operand and unary elsewhere
            if text in "+-^&":
                t = "BIN" if toks and toks[-1] in ("ID", "NUMBER", "STRING", "CHAR", ")", "]", "}") else "UN"
            elif text == "!":
                t = "UN"
            else:
                t = "ASSIGN" if text in _ASSIGN else "BIN" if text in _BIN else "INC" if text in ("++", "--") else text
        else:
            t = kind.upper()
        toks.append(t)
        at.append(p)
    if toks and toks[-1] in _ENDS:
        toks.append(";")
        at.append(n)
    return toks, at
