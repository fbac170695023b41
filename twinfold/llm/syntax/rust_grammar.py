"""Rust: tokens and grammar. Rules marked with % come with and without struct
literals (_h: in the head of if, while, for and match); the bodies of macros are
token trees."""

from __future__ import annotations

import re

from .python_grammar import LexError

_RULES = r"""
file : inner* item* ;
inner : '#' '!' '[' tokens ']' ;
outer : '#' '[' tokens ']' ;
tokens : token* ;
token : TOK | '(' tokens ')' | '[' tokens ']' | '{' tokens '}' ;
item : outer* vis? plain | outer* macro_item ;
vis : 'pub' | 'pub' '(' 'crate' ')' | 'pub' '(' 'self' ')' | 'pub' '(' 'super' ')' | 'pub' '(' 'in' path ')' ;
plain : 'mod' id ';' | 'mod' id '{' inner* item* '}' | 'extern' 'crate' id_self ('as' id)? ';' | 'use' use ';' | func | 'type' id generics? (':' bounds)? where? ('=' type)? where? ';'
  | 'struct' id generics? where? ';' | 'struct' id generics? where? '{' fields? '}' | 'struct' id generics? '(' tuple_fields? ')' where? ';'
  | 'union' id generics? where? '{' fields? '}' | 'enum' id generics? where? '{' variants? '}' | 'const' (id | '_') ':' type ('=' expr)? ';' | 'static' 'mut'? id ':' type ('=' expr)? ';'
  | 'unsafe'? 'auto'? 'trait' id generics? (':' bounds?)? where? '{' inner* assoc* '}' | 'unsafe'? 'impl' generics? ('const'? '!'? type 'for')? type where? '{' inner* assoc* '}'
  | 'unsafe'? 'extern' STR? '{' inner* assoc* '}' ;
id_self : id | 'self' ;
macro_item : path_s '!' id? '(' tokens ')' ';' | path_s '!' id? '[' tokens ']' ';' | path_s '!' id? '{' tokens '}' ;
assoc : outer* vis? 'default'? member | outer* macro_item ;
member : func | 'type' id generics? (':' bounds?)? where? ('=' type)? where? ';' | 'const' (id | '_') ':' type ('=' expr)? ';' | 'static' 'mut'? id ':' type ';' ;
use : use_path | use_path 'as' (id | '_') | '*' | '::' '*' | use_path '::' '*' | '{' uses? '}' | '::' '{' uses? '}' | use_path '::' '{' uses? '}' ;
uses : use (',' use)* ','? ;
use_path : seg_id | '::' seg_id | use_path '::' seg_id ;
seg_id : id | 'self' | 'super' | 'crate' | 'Self' ;
id : ID | 'union' | 'auto' | 'default' ;
func : quals 'fn' id generics? '(' params? ')' ('->' type)? where? (block | ';') ;
quals : 'const'? 'async'? 'unsafe'? | 'const'? 'async'? 'unsafe'? 'extern' STR? ;
params : param (',' param)* ','? ;
param : outer* pat ':' type | outer* self | outer* '...' | outer* pat ':' '...' ;
self : 'mut'? 'self' | 'mut'? 'self' ':' type | '&' LIFE? 'mut'? 'self' ;
generics : '<' '>' | '<' gparam (',' gparam)* ','? '>' ;
gparam : outer* LIFE (':' life_bounds?)? | outer* id (':' bounds?)? ('=' type)? | outer* 'const' id ':' type ('=' gconst)? ;
gconst : block | lit | '-' lit | id ;
life_bounds : LIFE ('+' LIFE)* ;
bounds : bound ('+' bound)* '+'? ;
bound : LIFE | '?'? path_t | '(' '?'? path_t ')' | 'for' generics path_t | '?' 'for' generics path_t | 'use' generics ;
where : 'where' preds? ;
preds : pred (',' pred)* ','? ;
pred : type ':' bounds? | 'for' generics type ':' bounds | LIFE ':' life_bounds? ;
fields : field (',' field)* ','? ;
field : outer* vis? id ':' type ;
tuple_fields : tuple_field (',' tuple_field)* ','? ;
tuple_field : outer* vis? type ;
variants : variant (',' variant)* ','? ;
variant : outer* vis? id vbody? ('=' expr)? ;
vbody : '{' fields? '}' | '(' tuple_fields? ')' ;

type : type1 | type_impl ;
type_impl : 'impl' bounds | 'dyn' bounds ;
type1 : path_t | '&' LIFE? 'mut'? type1_or | ANDAND LIFE? 'mut'? type1_or | '*' 'const' type1_or | '*' 'mut' type1_or | '[' type ']' | '[' type ';' expr ']' | '(' ')' | '(' type ')' | '(' types2 ')' | '!' | '_'
  | fn_type | 'for' generics fn_type | 'for' generics path_t | path_s '!' '(' tokens ')' | path_s '!' '[' tokens ']' | path_s '!' '{' tokens '}' | qpath ;
type1_or : type1 | 'dyn' bound | 'impl' bound ;
types2 : type ',' | type (',' type)+ ','? ;
fn_type : 'unsafe'? 'fn' '(' fn_params? ')' ('->' type1_or)? | 'unsafe'? 'extern' STR? 'fn' '(' fn_params? ')' ('->' type1_or)? ;
fn_params : fn_param (',' fn_param)* ','? | fn_param (',' fn_param)* ',' '...' ;
fn_param : type | (id | '_') ':' type ;
path_t : '::'? seg_t | path_t '::' seg_t ;
seg_t : seg_id | seg_id '::'? gargs | seg_id '(' fn_types? ')' ('->' type1_or)? ;
fn_types : type (',' type)* ','? ;
qpath : '<' type ('as' path_t)? '>' '::' seg_t | qpath '::' seg_t ;
gargs : '<' '>' | '<' garg (',' garg)* ','? '>' ;
garg : LIFE | type | lit | '-' lit | block | id gargs? '=' type | id gargs? ':' bounds ;
path_s : '::'? seg_id | path_s '::' seg_id ;

pat : '|'? pat1 ('|' pat1)* ;
pat1 : '_' | '..' | id ('@' pat1)? | 'ref' 'mut'? id ('@' pat1)? | 'mut' id ('@' pat1)? | plit | plit RANGE plit? | RANGE plit | plit '..' plit? | path2 RANGE plit? | path2 '..' plit? | '&' 'mut'? pat1 | ANDAND 'mut'? pat1
  | path2 | ppath '(' pats? ')' | ppath '{' fpats? '}' | '(' ')' | '(' pat ')' | '(' pat ',' pats? ')' | '[' pats? ']' | path_s '!' '(' tokens ')' | path_s '!' '[' tokens ']' | 'const' block ;
ppath : id | path2 ;
path2 : '::' seg_e | path_e2 | 'Self' | 'self' | 'crate' | qpath_e ;
path_e2 : seg_e '::' seg_e | path_e2 '::' seg_e | '::' seg_e '::' seg_e ;
plit : lit | '-' lit | path_e2 ;
pats : pat (',' pat)* ','? ;
fpats : fpat (',' fpat)* ','? ;
fpat : outer* fpat1 ;
fpat1 : id ':' pat | NUM ':' pat | 'ref'? 'mut'? id | '..' ;

block : '{' inner* stmts '}' ;
stmts : stmt* | stmt* expr_s | stmt* outer+ expr_s ;
stmt : ';' | outer* vis? plain | 'macro_' | outer* 'let' pat (':' type)? ('=' expr ('else' block)?)? ';' | outer* blocky | outer* expr_s ';' | outer* macro_block | outer* blocky_tail ';' ;
macro_block : path_s '!' id? '{' tokens '}' ;
blocky : block | 'unsafe' block | 'async' 'move'? block | 'const' block | label? loop | if | match ;
blocky_tail : 'tail_' ;
label : LIFE ':' ;
loop : 'loop' block | 'while' cond block | 'for' pat 'in' expr_h block | block_l ;
block_l : 'block_' ;
cond : expr_h | let_chain ;
let_chain : let_cond | let_chain ANDAND or_h | let_chain ANDAND let_cond | or_h ANDAND let_cond ;
let_cond : 'let' pat '=' or_h ;
or_h : unary_h | or_h bop unary_h ;
bop : BIN | '|' | '&' | '+' | '-' | '*' | '<' | '>' | '>' '>' ;
if : 'if' cond block | 'if' cond block 'else' block | 'if' cond block 'else' if ;
match : 'match' expr_h '{' inner* arms '}' ;
arms : arm* | arm* last_arm ;
arm : outer* pat ('if' guard)? '=>' expr ',' | outer* pat ('if' guard)? '=>' blocky ;
last_arm : outer* pat ('if' guard)? '=>' expr ;
guard : cond_any ;
cond_any : expr | let_any ;
let_any : 'let' pat '=' expr ;

expr% : range% | range% '=' expr% | range% ASSIGN expr% | jump% | closure% ;
jump% : 'return' expr%? | 'break' LIFE? expr%? | 'continue' LIFE? | 'yield' expr%? ;
closure% : closure_head expr% | closure_head '->' type block ;
closure_head : mods '|' cparams? '|' | mods OROR ;
mods : ('for' generics)? 'static'? 'async'? 'move'? ;
cparams : cparam (',' cparam)* ','? ;
cparam : outer* pat1 (':' type)? ;
range% : bin% | bin% '..' bin%? | bin% RANGE bin%? | '..' bin%? | RANGE bin% ;
bin% : unary% | bin% op unary% | bin% op jump% | bin% op closure% | bin% 'as' type1_or ;
op : BIN | '|' | '&' | '+' | '-' | '*' | '<' | '>' | '>' '>' | ANDAND | OROR ;
unary% : post% | '-' unary% | '!' unary% | '*' unary% | '&' unary% | '&' 'mut' unary% | '&' ID 'const' unary% | ANDAND unary% | ANDAND 'mut' unary% ;
post% : prim% | post% '?' | post% '.' id | post% '.' NUM | post% '.' 'await' | post% '.' id '::' gargs args | post% '.' id args | post% args | post% '[' expr ']' ;
args : '(' ')' | '(' arg (',' arg)* ','? ')' ;
arg : outer* expr ;
prim_base : lit | path_e | qpath_e | '(' ')' | '(' outer* expr ')' | '(' expr ',' ')' | '(' expr (',' expr)+ ','? ')' | '[' ']' | '[' exprs ']' | '[' expr ';' expr ']' | macro | '_' ;
macro : path_s '!' '(' tokens ')' | path_s '!' '[' tokens ']' | path_s '!' '{' tokens '}' ;
prim_s : prim_base | struct_lit ;
prim_h : prim_base | blocky ;
prim : prim_base | blocky | struct_lit ;
struct_lit : path_e '{' '}' | path_e '{' sfields '}' | qpath_e '{' sfields? '}' ;
sfields : sfield (',' sfield)* ','? | (sfield ',')* '..' expr | (sfield ',')* '..' ;
sfield : outer* sfield1 ;
sfield1 : id | id ':' expr | NUM ':' expr ;
exprs : expr (',' expr)* ','? ;
path_e : '::'? seg_e | path_e '::' seg_e ;
seg_e : seg_id | seg_id '::' gargs ;
qpath_e : '<' type ('as' path_t)? '>' '::' seg_e | qpath_e '::' seg_e ;
lit : NUM | STR | CHR | 'true' | 'false' ;
"""
for _drop in (" | 'macro_'", " | outer* blocky_tail ';'", "blocky_tail : 'tail_' ;\n", "block_l : 'block_' ;\n"):
    _RULES = _RULES.replace(_drop, "")
_RULES = _RULES.replace(" | block_l ;", " | block ;")


def _spread(rules: str) -> str:
    out = []
    for rule in rules.split(" ;\n"):
        if "%" not in rule:
            out.append(rule)
            continue
        # full, in a head (no struct literal), at the start of a statement (no block first)
        out.append(rule.replace("%", ""))
        out.append(rule.replace("%", "_h"))
        head, body = rule.split(" : ", 1)
        alts = []
        for alt in body.split(" | "):
            words = alt.split(" ")
            if words[0].endswith("%"):
                words[0] = words[0].replace("%", "_s")
            alts.append(" ".join(w.replace("%", "") for w in words))
        out.append(head.replace("%", "_s") + " : " + " | ".join(alts))
    return " ;\n".join(out)


GRAMMAR = _spread(_RULES) + "\npost_s : blocky '.' id | blocky '.' 'await' | blocky '.' id args | blocky '?' | blocky '.' id '::' gargs args ;\n"
GRAMMAR += "token : " + " | ".join(
    f"'{t}'"
    for t in """as async await auto break const continue crate default dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type
    union unsafe use where while yield ! # & * + - , -> . .. ... : :: ; < > = => ? @ _ |""".split()
) + " | ID | NUM | STR | CHR | LIFE | BIN | ASSIGN | RANGE | ANDAND | OROR ;\n"
GRAMMAR = GRAMMAR.replace("token : TOK | ", "token : ")
PREFER_SHIFT = {"else"}

_KEYWORDS = set(
    """as async await auto break const continue crate default dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type union
    unsafe use where while yield""".split()
)
_TOKEN = re.compile(
    r"""(?P<ws>\s+|//[^\n]*)
|(?P<comment>/\*)
|(?P<raw>b?r(?P<h>\#*)"|cr(?P<h2>\#*)")
|(?P<str>[bc]?"(?:[^"\\]|\\.)*")
|(?P<chr>b?'(?:[^'\\\n\r\t]|\\(?:[nrt\\0'"]|x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]{1,8}\}))')
|(?P<life>'[^\W\d]\w*)
|(?P<num>(?:0x[0-9a-fA-F_]+|0b[01_]+|0o[0-7_]+|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?[\d_]+)?|\d[\d_]*\.(?![.\w]))(?:_*(?:[iu](?:8|16|32|64|128|size)|f32|f64))?(?!\w))
|(?P<id>(?:r\#)?[^\W\d]\w*)
|(?P<op><<=|>>=|\.\.\.|\.\.=|&&|\|\||->|=>|::|\.\.|==|!=|<=|>=|<<|[+\-*/%&|^]=|[-+*/%&|^!<>=?:;,.@\#(){}\[\]$~])""",
    re.X | re.S,
)
_ASSIGN = set("+= -= *= /= %= &= |= ^= <<= >>=".split())
_BIN = set("== != <= >= << / % ^".split())
_NEST = re.compile(r"/\*|\*/")


def tokenize(src: str):
    toks: list[str] = []
    at: list[int] = []
    pos, n = (1 if src.startswith("﻿") else 0), len(src)
    if src.startswith("#!") and not src.startswith("#!["):
        pos = len(src.split("\n", 1)[0])
    match = _TOKEN.match
    while pos < n:
        m = match(src, pos)
        if not m:
            raise LexError(pos)
        kind, text, p = m.lastgroup, m.group(), pos
        pos = m.end()
        if kind == "ws":
            continue
        if kind == "comment":
            depth = 1
            while depth:
                c = _NEST.search(src, pos)
                if not c:
                    raise LexError(p)
                depth += 1 if c.group() == "/*" else -1
                pos = c.end()
            continue
        if m.group("raw"):
            end = '"' + (m.group("h") or m.group("h2") or "")
            k = src.find(end, pos)
            if k < 0:
                raise LexError(p)
            pos = k + len(end)
            t = "STR"
        elif kind == "id":
            t = "_" if text == "_" else text if text in _KEYWORDS else "ID"
        elif kind == "op":
            if text in "$~":
                if "!" not in toks:
                    raise LexError(p)
                t = "BIN"  # stands in macro bodies only
            else:
                t = "ASSIGN" if text in _ASSIGN else "BIN" if text in _BIN else {"&&": "ANDAND", "||": "OROR", "..=": "RANGE"}.get(text, text)
        else:
            t = kind.upper()
            if t == "NUM" and toks and toks[-1] == "." and "." in text:  # a.0.1
                a, _, b = text.partition(".")
                toks += ["NUM", "."]
                at += [p, p + len(a)]
        toks.append(t)
        at.append(p)
    return toks, at
