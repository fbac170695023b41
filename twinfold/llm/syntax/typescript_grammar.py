"""TypeScript: the JavaScript rules and those for types."""

from __future__ import annotations

from . import javascript_grammar as js

_TYPES = r"""
ident : 'type' | 'interface' | 'namespace' | 'module' | 'declare' | 'abstract' | 'readonly' | 'public' | 'private' | 'protected' | 'keyof' | 'infer' | 'is'
  | 'asserts' | 'unique' | 'global' | 'override' | 'satisfies' | 'implements' | 'accessor' | 'out' | 'require' ;
keyword : 'implements_' ;
item : declaration | 'declare' declaration | 'export' declaration | 'export' 'declare' declaration | 'declare' var semi | 'declare' 'const' ident semi | 'declare' class_decl
  | 'export' 'declare' var semi | 'export' 'declare' class_decl | 'abstract' class_decl | 'export' 'abstract' class_decl | 'export' 'default' 'abstract' class_decl
  | 'declare' 'abstract' class_decl | 'export' 'declare' 'abstract' class_decl
  | 'export' '=' expr semi | 'export' 'as' 'namespace' ident semi | 'import' ident '=' 'require' '(' STRING ')' semi | 'import' ident '=' dotted semi
  | 'export' 'import' ident '=' dotted semi | 'import' 'type' clause 'from' STRING semi | 'export' 'type' names semi | 'export' 'type' names 'from' STRING semi
  | 'export' 'type' '*' 'from' STRING semi | 'declare' 'global' block | 'export' 'default' interface ;
spec : 'type' modname | 'type' modname 'as' modname ;
declaration : interface | 'type' ident tparams? eq type semi | 'const'? 'enum' ident '{' '}' | 'const'? 'enum' ident '{' enum_item (',' enum_item)* ','? '}'
  | 'namespace' dotted block | 'module' dotted block | 'module' STRING block | 'module' STRING semi | function_sig semi ;
enum_item : propname | propname '=' assign ;
interface : 'interface' ident tparams? extends_types? body_type ;
extends_types : 'extends' type_ref (',' type_ref)* ;
heritage : 'extends' lhs targs | 'extends' lhs implements | 'extends' lhs targs implements | implements ;
implements : 'implements' type_ref (',' type_ref)* ;
class_decl : decorator* 'class' ident tparams heritage? '{' member* '}' ;
class : decorator* 'class' ident? tparams heritage? '{' member* '}' ;
function_sig : 'async'? 'function' '*'? ident sig ;
decorator : '@' dotted targs args ;
member : decorator* index_sig semi | decorator* member_mods index_sig semi | decorator* signature semi | decorator* member_mods signature semi ;
signature : propname '?'? sig | 'get' propname sig | 'set' propname sig | 'async' propname sig ;
member_mods : modifier+ ;
modifier : 'static' | 'public' | 'private' | 'protected' | 'readonly' | 'abstract' | 'override' | 'declare' | 'accessor' ;
field : propname '?' ('=' assign)? | propname '!'? ':' type (eq assign)? | propname '?' ':' type (eq assign)? ;
method : propname '?' sig block ;
sig : '(' params? ')' ':' rtype | tparams '(' params? ')' | tparams '(' params? ')' ':' rtype ;
rtype : type | ident 'is' type | 'this' 'is' type | 'asserts' ident | 'asserts' ident 'is' type | 'asserts' 'this' ;
param : pattern_t | pattern_t eq assign | '...' binding ':' type | decorator+ param_mods? binding | decorator+ param_mods? pattern_t | decorator+ param_mods? pattern_t eq assign
  | param_mods binding | param_mods binding '=' assign | param_mods pattern_t | param_mods pattern_t eq assign | 'this' ':' type ;
param_mods : param_mod+ ;
param_mod : 'public' | 'private' | 'protected' | 'readonly' | 'override' ;
pattern_t : binding ':' type | binding '?' ':' type | binding '?' ;
param_one : binding ':' type ;
decl : binding ':' type | binding ':' type eq assign | ident '!' ':' type ;
decl_c : ident ':' type | binding ':' type eq assign ;
eq : '=' | EQ_ADJ ;
gt : '>' | GT_ADJ ;
gt_assign : '>' GT_ADJ EQ_ADJ | '>' GT_ADJ GT_ADJ EQ_ADJ ;
assign% : lhs% gt_assign assign | newexp gt_assign assign ;
lhs% : lhs% targs args | lhs% targs template | lhs% '!' | lhs% '?.' targs args ;
newexp : 'new' lhs targs ;
unary% : '<' type gt unary ;
bin% : bin% 'as' type | bin% 'as' 'const' | bin% 'satisfies' type ;
op : '|' | '&' | '>' GT_ADJ | '>' GT_ADJ GT_ADJ | '>' EQ_ADJ ;
prefix : '!' ;
arrow : 'abstract_' ;
targs : '<' type (',' type)* ','? gt ;
tparams : '<' tparam (',' tparam)* ','? gt ;
tparam : tparam_mod* ident ('extends' type)? (eq type)? ;
tparam_mod : 'const' | 'in' | 'out' ;
type : union | function_type | union 'extends' union '?' type ':' type ;
function_type : tparams? '(' params? ')' '=>' rtype | 'new' tparams? '(' params? ')' '=>' type | 'abstract' 'new' tparams? '(' params? ')' '=>' type ;
union : inter | '|' inter | union '|' inter ;
inter : type_op | '&' type_op | inter '&' type_op ;
type_op : postfix_type | 'keyof' type_op | 'unique' type_op | 'readonly' type_op | 'infer' ident | 'infer' ident 'extends' type_op ;
postfix_type : prim | postfix_type '[' ']' | postfix_type '[' type ']' ;
prim : type_ref | 'this' | 'null' | 'void' | 'true' | 'false' | STRING | NUMBER | '-' NUMBER | ttemplate | 'typeof' tname targs? | 'typeof' 'import' '(' STRING ')' | '(' type ')' | '[' ']' | '[' tuple_el (',' tuple_el)* ','? ']'
  | body_type | mapped | 'import' '(' STRING ')' | 'import' '(' STRING ')' '.' tname_any targs? ;
ttemplate : TEMPLATE | THEAD type (TMID type)* TTAIL ;
type_ref : tname | tname targs ;
tname : ident | tname '.' name ;
tname_any : NAME | tname_any '.' NAME ;
tuple_el : type | type '?' | '...' type | ident ':' type | ident '?' ':' type | '...' ident ':' type ;
body_type : '{' '}' | '{' type_members '}' | '{' type_members sep '}' ;
sep : ',' | ';' | END ;
type_members : type_member | type_members sep type_member ;
type_member : 'readonly'? propname '?'? | 'readonly'? propname '?'? ':' type | propname '?'? sig | 'get' propname sig | 'set' propname sig | sig | 'new' sig | index_sig ;
index_sig : 'readonly'? '[' ident ':' type ']' ':' type ;
mapped : '{' map_mod? '[' ident 'in' type ('as' type)? ']' map_opt? (':' type)? sep? '}' ;
map_mod : 'readonly' | '+' 'readonly' | '-' 'readonly' ;
map_opt : '?' | '+' '?' | '-' '?' ;
"""
_TYPES = _TYPES.replace("keyword : 'implements_' ;\n", "").replace("arrow : 'abstract_' ;\n", "")
GRAMMAR = js.GRAMMAR + js.spread(_TYPES)
PREFER_SHIFT = js.PREFER_SHIFT
_SOFT = js._SOFT | set(
    "type interface namespace module declare abstract readonly public private protected keyof infer is asserts unique global override satisfies implements accessor out require".split()
)


def tokenize(src: str):
    return js.tokenize(src, soft=_SOFT, split_gt=True)
