"""Java: tokens and grammar."""

from __future__ import annotations

import re

from .python_grammar import LexError

GRAMMAR = r"""
file : package? import* type_decl* | module | import* compact* method compact* ;
compact : type_decl | field | method ;
package : annotation* 'package' qname ';' ;
import : 'import' 'static'? qname ';' | 'import' 'static'? qname '.' '*' ';' | ';' ;
module : import* annotation* 'open'? 'module' qname '{' directive* '}' ;
directive : 'requires' ('transitive' | 'static')* qname ';' | 'exports' qname ('to' qnames)? ';' | 'opens' qname ('to' qnames)? ';' | 'uses' qname ';' | 'provides' qname 'with' qnames ';' ;
qnames : qname (',' qname)* ;
qname : id | qname '.' id ;
id : ID | 'open' | 'module' | 'requires' | 'transitive' | 'exports' | 'to' | 'opens' | 'uses' | 'provides' | 'with' | 'record' | 'sealed' | 'permits' | 'var' | 'yield' | 'when' | 'nonsealed_' ;
type_decl : class | interface | enum | record | annotation_type | ';' ;
mods : modifier+ ;
modifier : annotation | 'public' | 'protected' | 'private' | 'static' | 'abstract' | 'final' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp' | 'default' | 'sealed' | NONSEALED ;
annotation : '@' qname | '@' qname '(' ')' | '@' qname '(' ann_value ')' | '@' qname '(' ann_pairs ')' ;
ann_pairs : ann_pair (',' ann_pair)* ;
ann_pair : id '=' ann_value ;
ann_value : ternary | annotation | '{' '}' | '{' ',' '}' | '{' ann_value (',' ann_value)* ','? '}' ;
class : mods? 'class' id tparams? ('extends' type)? ('implements' types)? ('permits' types)? class_body ;
interface : mods? 'interface' id tparams? ('extends' types)? ('permits' types)? class_body ;
enum : mods? 'enum' id ('implements' types)? '{' constants? ','? '}' | mods? 'enum' id ('implements' types)? '{' constants? ','? ';' member* '}' ;
constants : constant (',' constant)* ;
constant : annotation* id args? class_body? ;
record : mods? 'record' id tparams? '(' params? ')' ('implements' types)? class_body ;
annotation_type : mods? '@' 'interface' id class_body ;
class_body : '{' member* '}' ;
member : ';' | block | 'static' block | field | method | constructor | class | interface | enum | record | annotation_type ;
field : mods? type vars ';' ;
vars : var (',' var)* ;
var : id dims? | id dims? '=' init ;
init : expr | array_init ;
array_init : '{' '}' | '{' ',' '}' | '{' init (',' init)* ','? '}' ;
dims : dim+ ;
dim : annotation* '[' ']' ;
method : mods? tparams? result id '(' params? ')' dims? throws? (block | ';' | 'default' ann_value ';') ;
result : type | 'void' ;
constructor : mods? tparams? id '(' params? ')' throws? block | mods? id block ;
throws : 'throws' types ;
params : param (',' param)* ;
param : mods? type id dims? | mods? type annotation* '...' id | mods? type (id '.')? 'this' ;
tparams : '<' tparam (',' tparam)* '>' ;
tparam : annotation* id ('extends' bound)? ;
bound : type ('&' type)* ;
types : type (',' type)* ;
type : annotation* base dims? ;
base : prim | ref ;
prim : 'int' | 'long' | 'short' | 'byte' | 'char' | 'boolean' | 'float' | 'double' ;
ref : id | id targs | ref '.' annotation* id | ref '.' annotation* id targs ;
targs : '<' '>' | '<' targ (',' targ)* '>' ;
targ : type | annotation* '?' | annotation* '?' 'extends' type | annotation* '?' 'super' type ;

block : '{' stmt* '}' ;
stmt : local ';' | class | interface | enum | record | simple ;
local : mods? type vars ;
simple : block | ';' | expr_stmt ';' | id ':' simple | 'if' '(' expr ')' simple | 'if' '(' expr ')' simple 'else' simple | 'assert' expr ';' | 'assert' expr ':' expr ';'
  | 'while' '(' expr ')' simple | 'do' simple 'while' '(' expr ')' ';' | 'for' '(' for_init? ';' expr? ';' exprs? ')' simple | 'for' '(' mods? type id dims? ':' expr ')' simple
  | 'break' id? ';' | 'continue' id? ';' | 'return' expr? ';' | 'throw' expr ';' | 'synchronized' '(' expr ')' block | switch | 'yield' expr ';'
  | 'try' block catch+ | 'try' block catch* 'finally' block | 'try' '(' resources ';'? ')' block catch* ('finally' block)? ;
catch : 'catch' '(' mods? type ('|' type)* id ')' block ;
resources : resource (';' resource)* ;
resource : mods? type id '=' expr | postfix ;
for_init : local | exprs ;
exprs : expr_stmt (',' expr_stmt)* ;
switch : 'switch' '(' expr ')' '{' group* '}' | 'switch' '(' expr ')' '{' rule+ '}' ;
group : label ':' stmt* ;
rule : label '->' (expr ';' | block | 'throw' expr ';') ;
label : 'case' case_item (',' case_item)* ('when' expr)? | 'default' ;
case_item : ternary | 'default' | pattern ;
pattern : mods? type id | ref '(' ')' | ref '(' pattern (',' pattern)* ')' ;
expr_stmt : assign | INC unary | postfix INC | call | new ;
assign : lhs '=' expr | lhs ASSIGN expr ;
lhs : ref | postfix_access ;
postfix_access : primary '.' id | primary '[' expr ']' | qname '[' expr ']' | 'super' '.' id ;

expr : ternary | assign | lambda ;
lambda : id '->' body | '(' ')' '->' body | '(' lparams ')' '->' body ;
lparams : id (',' id)* | param (',' param)* ;
body : expr | block ;
ternary : bin | bin '?' expr ':' (ternary | lambda) ;
bin : unary | bin op unary | bin 'instanceof' mods? type | bin 'instanceof' pattern ;
op : BIN | '<' | '>' | '>' '>' | '>' '>' '>' | '&' | '|' | '+' | '-' | '*' ;
unary : postfix | '+' unary | '-' unary | INC unary | '!' unary | '(' type ('&' type)* ')' cast_arg | switch ;
cast_arg : unary | lambda ;
postfix : primary | qname | postfix INC ;
primary : literal | 'this' | '(' expr ')' | new | call | postfix_access | 'super' | array_new | type '::' targs? idnew | primary '::' targs? idnew | result '.' 'class' | qname '.' 'this' | qname '.' 'super' ;
idnew : id | 'new' ;
literal : NUMBER | STRING | CHAR | TEXT | 'true' | 'false' | 'null' ;
call : qname args | primary '.' targs? id args | qname '.' targs id args | 'super' '.' targs? id args | 'super' args | 'this' args | qname '.' 'super' '.' id args | primary '.' 'super' args ;
args : '(' ')' | '(' expr (',' expr)* ')' ;
new : 'new' annotation* targs? ref args class_body? | primary '.' 'new' ref args class_body? | qname '.' 'new' ref args class_body? ;
array_new : 'new' annotation* base dim_expr+ dims? | 'new' annotation* base dims array_init ;
dim_expr : annotation* '[' expr ']' ;
""".replace(" | 'nonsealed_'", "")
PREFER_SHIFT = {"else"}

_KEYWORDS = set(
    """abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int
    interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null
    open module requires transitive exports to opens uses provides with record sealed permits yield when""".split()
)
_TOKEN = re.compile(
    r"""(?P<ws>\s+|//[^\n\r]*|/\*(?:[^*]|\*(?!/))*\*/)
|(?P<nonsealed>non-sealed\b)
|(?P<id>(?:[^\W\d]|\$)(?:\w|\$)*)
|(?P<number>(?:0[xX][0-9a-fA-F](?:[0-9a-fA-F_]*[0-9a-fA-F])?(?:\.[0-9a-fA-F]*)?(?:[pP][+-]?\d+)?|0[bB][01](?:[01_]*[01])?|(?:\d(?:[\d_]*\d)?\.(?:\d(?:[\d_]*\d)?)?|\.\d(?:[\d_]*\d)?|\d(?:[\d_]*\d)?)(?:[eE][+-]?\d+)?)[lLfFdD]?(?![\w$]))
|(?P<text>\"\"\"[ \t\f]*\r?\n(?:[^\\"]|\\.|"(?!""))*\"\"\")
|(?P<string>"(?:[^"\\\n\r]|\\(?:[btnfrs"'\\]|[0-7]{1,3}|u+[0-9a-fA-F]{4}))*")
|(?P<char>'(?:[^'\\\n\r]|\\(?:[btnfrs"'\\]|[0-7]{1,3}|u+[0-9a-fA-F]{4}))')
|(?P<op>>>>=|<<=|>>=|\.\.\.|->|::|\+\+|--|==|!=|<=|>=|&&|\|\||<<|[+\-*/%&|^]=|[-+*/%&|^!~<>=?:;,.@(){}\[\]])""",
    re.X | re.S,
)
_ASSIGN = set("+= -= *= /= %= &= |= ^= <<= >>= >>>=".split())
_BIN = set("== != <= >= && || << % ^ /".split())


def tokenize(src: str):
    toks: list[str] = []
    at: list[int] = []
    pos, n = 0, len(src)
    match = _TOKEN.match
    if src.startswith("﻿"):
        pos = 1
    while pos < n:
        m = match(src, pos)
        if not m:
            if src[pos] == "\x1a" and pos == n - 1:
                break
            raise LexError(pos)
        kind, text = m.lastgroup, m.group()
        if kind != "ws":
            if kind == "id":
                t = text if text in _KEYWORDS else "ID"
            elif kind == "op":
                t = "ASSIGN" if text in _ASSIGN else "BIN" if text in _BIN else "INC" if text in ("++", "--") else "!" if text == "~" else text
            else:
                t = kind.upper()
            toks.append(t)
            at.append(pos)
        pos = m.end()
    return toks, at
