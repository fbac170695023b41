"""JavaScript (ECMAScript, scripts and modules): tokens and grammar.

Rules marked with % come in three forms: any expression, one that may start a
statement (no brace, function or class first), one that may follow an arrow."""

from __future__ import annotations

import re

from .python_grammar import LexError

_RULES = r"""
file : item* ;
item : stmt | import | export ;
semi : ';' | END ;
block : '{' item* '}' ;
stmt : block | var semi | ';' | expr_s semi | 'if' '(' expr ')' stmt | 'if' '(' expr ')' stmt 'else' stmt
  | 'do' stmt 'while' '(' expr ')' | 'do' stmt 'while' '(' expr ')' ';' | 'while' '(' expr ')' stmt
  | 'for' '(' for_init? ';' expr? ';' expr? ')' stmt | 'for' '(' for_head 'in' expr ')' stmt | 'for' 'await'? '(' for_head 'of' assign ')' stmt
  | 'continue' ident? semi | 'break' ident? semi | 'return' expr? semi | 'with' '(' expr ')' stmt | ident ':' stmt
  | 'switch' '(' expr ')' '{' case* '}' | 'throw' expr semi | 'try' block catch | 'try' block catch? 'finally' block | 'debugger' semi
  | function_decl | class_decl ;
catch : 'catch' block | 'catch' '(' param_one ')' block ;
param_one : binding ;
case : 'case' expr ':' item* | 'default' ':' item* ;
var : ('var' | 'let') decl (',' decl)* | 'const' decl_c (',' decl_c)* ;
var_kind : 'var' | 'let' | 'const' ;
decl : ident | binding '=' assign ;
decl_c : binding '=' assign ;
for_init : expr | var ;
for_head : lhs | var_kind binding ;
binding : ident | '[' elems? ']' | '{' props? '}' ;
elems : elem | elems ',' elem? | ',' elem? ;
elem : binding | binding '=' assign | '...' binding ;
props : prop (',' prop)* ','? ;
prop : ident | ident '=' assign | propname ':' binding | propname ':' binding '=' assign | '...' binding ;
ident : ID | 'async' | 'of' | 'get' | 'set' | 'static' | 'from' | 'as' ;
function_decl : 'async'? 'function' '*'? ident sig block ;
function : 'async'? 'function' '*'? ident? sig block ;
sig : '(' params? ')' ;
params : param (',' param)* ','? ;
param : binding | binding '=' assign | '...' binding ;
class_decl : decorator* 'class' ident heritage? '{' member* '}' ;
class : decorator* 'class' ident? heritage? '{' member* '}' ;
heritage : 'extends' lhs ;
decorator : '@' dotted | '@' dotted args | '@' '(' expr ')' ;
dotted : ident | dotted '.' name ;
member : ';' | decorator* member_mods method | decorator* member_mods field semi | decorator* method | decorator* field semi | 'static' block ;
member_mods : 'static' ;
field : propname | propname '=' assign ;
method : propname sig block | 'get' propname sig block | 'set' propname sig block | 'async' propname sig block | '*' propname sig block | 'async' '*' propname sig block ;
propname : ident | keyword | STRING | NUMBER | '[' assign ']' | PRIVATE ;
keyword : 'break' | 'case' | 'catch' | 'class' | 'const' | 'continue' | 'debugger' | 'default' | 'delete' | 'do' | 'else' | 'enum' | 'export' | 'extends' | 'finally'
  | 'for' | 'function' | 'if' | 'import' | 'in' | 'instanceof' | 'new' | 'return' | 'super' | 'switch' | 'this' | 'throw' | 'try' | 'typeof' | 'var' | 'void'
  | 'while' | 'with' | 'null' | 'true' | 'false' | 'let' | 'yield' | 'await' ;
import : 'import' STRING attrs? semi | 'import' clause 'from' STRING attrs? semi ;
clause : ident | names | '*' 'as' ident | ident ',' names | ident ',' '*' 'as' ident ;
attrs : 'with' object ;
names : '{' '}' | '{' spec (',' spec)* ','? '}' ;
spec : modname | modname 'as' modname ;
modname : ident | keyword | STRING ;
export : 'export' '*' 'from' STRING semi | 'export' '*' 'as' modname 'from' STRING semi | 'export' names semi | 'export' names 'from' STRING semi
  | 'export' var semi | 'export' function_decl | 'export' class_decl | 'export' 'default' function | 'export' 'default' class | 'export' 'default' assign_s semi | 'export' 'default' object semi ;

expr% : assign% | expr% ',' assign ;
assign% : cond% | lhs% '=' assign | lhs% ASSIGN assign | newexp '=' assign | newexp ASSIGN assign | arrow | 'yield' | 'yield' assign | 'yield' '*' assign ;
arrow : ident '=>' body | 'async' ident '=>' body | sig '=>' body | 'async' sig '=>' body ;
body : block | assign_b ;
cond% : bin% | bin% '?' assign ':' assign ;
bin% : unary% | bin% op unary | PRIVATE 'in' unary ;
op : BIN | '*' | '+' | '-' | '<' | '>' | 'in' | 'instanceof' | '/' ;
unary% : postfix% | prefix unary ;
prefix : 'delete' | 'void' | 'typeof' | '+' | '-' | UNARY | INC | 'await' ;
postfix% : lhs% | lhs% POST | newexp | newexp POST ;
newexp : 'new' lhs | 'new' newexp ;
lhs% : primary% | lhs% '.' name | lhs% '?.' name | lhs% '?.' '[' expr ']' | lhs% '?.' args | lhs% '[' expr ']' | lhs% args | lhs% template ;
name : NAME | PRIVATE ;
args : '(' ')' | '(' arg (',' arg)* ','? ')' ;
arg : assign | '...' assign ;
primary_s : ident | NUMBER | STRING | REGEX | template | 'this' | 'null' | 'true' | 'false' | array | '(' expr ')' | 'super' | 'import' args | 'import' '.' name | 'new' '.' name ;
primary_b : primary_s | function | class ;
primary : primary_b | object ;
template : TEMPLATE | THEAD expr (TMID expr)* TTAIL ;
array : '[' ']' | '[' items ']' ;
items : arg | items ',' arg? | ',' arg? ;
object : '{' '}' | '{' entry (',' entry)* ','? '}' ;
entry : propname ':' assign | ident | ident '=' assign | '...' assign | method ;
"""


def spread(rules: str) -> str:
    """The rules with % replaced by each of the three forms."""
    out = []
    for rule in rules.split(" ;\n"):
        if "%" in rule:
            out += [rule.replace("%", form) for form in ("", "_s", "_b")]
        else:
            out.append(rule)
    return " ;\n".join(out)


GRAMMAR = spread(_RULES)
PREFER_SHIFT = {"else"}

_KEYWORDS = set(
    """break case catch class const continue debugger default delete do else enum export extends finally for function if import in instanceof new return super switch this
    throw try typeof var void while with null true false let yield await""".split()
)
_SOFT = {"async", "of", "get", "set", "static", "from", "as"}
_TOKEN = re.compile(
    r"""[ \t\f\v ﻿ - 　]*(?:(?P<end>\Z)
|(?P<nl>\r\n|[\n\r  ])
|(?P<comment>//[^\n\r  ]*|/\*(?:[^*]|\*(?!/))*\*/)
|(?P<id>(?:[^\W\d]|\$|\\u(?:[0-9a-fA-F]{4}|\{[0-9a-fA-F]+\}))(?:\w|\$|‌|‍|\\u(?:[0-9a-fA-F]{4}|\{[0-9a-fA-F]+\}))*)
|(?P<private>\#(?:[^\W\d]|\$)(?:\w|\$)*)
|(?P<number>(?:0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*n?|0[bB][01](?:_?[01])*n?|0[oO][0-7](?:_?[0-7])*n?|(?:\d(?:_?\d)*\.(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*|\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?|\d(?:_?\d)*n)(?![\w$]))
|(?P<string>"(?:[^"\\\n\r]|\\(?:\r\n|.))*"|'(?:[^'\\\n\r]|\\(?:\r\n|.))*')
|(?P<op>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[{}()\[\].;,<>+\-*%&|^!~?:=@/`]))""",
    re.X | re.S,
)
_SPACE = re.compile(r"[ \t\f\v ﻿ - 　]*")
_BAD_ESCAPE = re.compile(r"(?<!\\)(?:\\\\)*\\(?:x(?![0-9a-fA-F]{2})|u(?![0-9a-fA-F]{4}|\{[0-9a-fA-F]+\}))")
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[a-zA-Z]*")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*", re.S)
_ASSIGN = set("+= -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
_BIN = set("=== !== == != <= >= && || ?? << >> >>> ** % & | ^".split())
_UNARY = {"!", "~"}
#: Signs that stand for a kind of token whatever is around them.
_PLAIN = {**dict.fromkeys(_ASSIGN, "ASSIGN"), **dict.fromkeys(_BIN, "BIN"), **dict.fromkeys(_UNARY, "UNARY"),
    **{c: c for c in ("(", ")", "[", "]", ".", ";", ",", "<", ">", "+", "-", "*", "?", ":", "=", "@", "=>", "?.", "...")}}
_PLAIN_SPLIT = {k: k if k in ("|", "&", "!") else v for k, v in _PLAIN.items() if k not in (">>", ">>>", ">=", ">>=", ">>>=")}
for _PLAINS in (_PLAIN, _PLAIN_SPLIT):
    _PLAINS.pop("/=", None)  # may begin a regular expression
#: After these a slash divides.
_OPERAND = {"ID", "NAME", "NUMBER", "STRING", "REGEX", "TEMPLATE", "TTAIL", ")", "]", "this", "super", "null", "true", "false", "PRIVATE", "POST"} | _SOFT
#: After these a line break ends the statement.
_RESTRICTED = {"return", "break", "continue", "throw", "yield"}


def tokenize(src: str, keywords=_KEYWORDS, soft=_SOFT, split_gt: bool = False):
    """(terminals, places, whether a statement may end before token i)."""
    toks: list[str] = []
    at: list[int] = []
    breaks: list[bool] = []
    pos, n = 0, len(src)
    braces: list[str] = []
    nl = True
    if src.startswith("#!"):
        pos = len(src.split("\n", 1)[0])

    def put(t: str, p: int) -> None:
        nonlocal nl
        if nl and toks and toks[-1] in _RESTRICTED and t not in (";", "}"):
            toks.append(";")
            at.append(p)
            breaks.append(False)
        toks.append(t)
        at.append(p)
        breaks.append(nl)
        nl = False

    def rest_of_template(p: int, first: bool) -> None:
        nonlocal pos
        pos = _TEMPLATE.match(src, pos).end()
        if src.startswith("`", pos):
            pos += 1
            put("TEMPLATE" if first else "TTAIL", p)
        elif src.startswith("${", pos):
            pos += 2
            braces.append("`")
            put("THEAD" if first else "TMID", p)
        else:
            raise LexError(p)

    match = _TOKEN.match
    words, plain = keywords | soft, _PLAIN_SPLIT if split_gt else _PLAIN
    while True:
        m = match(src, pos)
        if not m:
            raise LexError(_SPACE.match(src, pos).end())
        kind = m.lastgroup
        text = m[kind]
        pos = m.end()
        if kind == "id":
            last = toks[-1] if toks else ""
            if nl and last in _RESTRICTED:
                put("NAME" if last in (".", "?.") else text if text in words else "ID", pos - len(text))
                continue
            toks.append("NAME" if last == "." or last == "?." else text if text in words else "ID")
            at.append(pos - len(text))
            breaks.append(nl)
            nl = False
            continue
        p = pos - len(text)
        if kind == "op":
            t = plain.get(text)
            if t is not None:
                if nl:
                    put(t, p)
                else:
                    toks.append(t)
                    at.append(p)
                    breaks.append(False)
            elif text in ("/", "/="):
                if not (toks and toks[-1] in _OPERAND):
                    r = _REGEX.match(src, p)
                    if not r:
                        raise LexError(p)
                    pos = r.end()
                    put("REGEX", p)
                else:
                    put("/" if text == "/" else "ASSIGN", p)
            elif text == "`":
                rest_of_template(p, True)
            elif text == "{":
                braces.append("{")
                put(text, p)
            elif text == "}":
                if not braces:
                    put(text, p)  # the parser stops here
                elif braces.pop() == "`":
                    rest_of_template(p, False)
                else:
                    put(text, p)
            elif text in ("++", "--"):
                put("POST" if toks and toks[-1] in _OPERAND and not nl else "INC", p)
            else:  # `>` may close type arguments: each sign by itself, those that touch the one before told apart
                if text[-1] == "=" and src.startswith(">", pos):  # an arrow behind type arguments
                    text, pos = text[:-1], pos - 1
                put(">", p)
                for k in range(1, len(text)):
                    put("GT_ADJ" if text[k] == ">" else "EQ_ADJ", p + k)
        elif kind == "nl":
            nl = True
        elif kind == "comment":
            if "\n" in text:
                nl = True
        elif kind == "end":
            break
        elif kind == "private":
            put("PRIVATE", p)
        elif kind == "string" and "\\" in text and _BAD_ESCAPE.search(text):
            raise LexError(p)
        else:
            put(kind.upper(), p)

    end = len(toks)
    return toks, at, lambda i: i >= end or breaks[i] or toks[i] == "}"
