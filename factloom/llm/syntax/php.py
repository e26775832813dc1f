"""PHP: the grammar of the dialects 7.4, 8.0, 8.1 and 8.2 over the tokens of the lexer.

Operators are a chain (operand, operator, ...) whose state remembers comparisons, since these alone may not follow each
other; otherwise precedence does not decide whether a text is valid. Assignments need a variable on the left, references
one on the right, and a conditional cannot be chained without parentheses in 8.x.
"""

from __future__ import annotations

import re
from functools import lru_cache

from factloom.functions.phplex import ASSIGN, BINARY, KEYWORDS, LexError, Lines, has_open_tag, tokens
from factloom.llm.syntax.gll import Grammar

DIALECTS = ("7.4", "8.0", "8.1", "8.2")


def _any(kinds) -> str:
    return " | ".join(f"'{k}'" for k in sorted(kinds))


_GRAMMAR = """
file : top* halt? ;
halt : 'HALT' ;
top : inner | 'namespace' nsrest | usetop | 'const' constitem (',' constitem)* ';' ;
nsrest : nsname (';' | nsblock) | nsblock ;
nsblock : '{' inner* '}' ;
nsname : NAME | QNAME | {8.0 8.1 8.2} nskw ;
nskw : 'enum' | 'match' ;
usetop : 'use' usekind? useitem (',' useitem)* ';' | 'use' usekind? GROUP '{' groupitems '}' ';' ;
groupitems : (groupitem (',' groupitems)?)? ;
groupitem : usekind? name ('as' NAME)? ;
usekind : 'function' | 'const' ;
useitem : name ('as' NAME)? ;
name : NAME | QNAME | 'enum' | {7.4} 'match' ;
inner : stmt | fundecl | classdecl ;
block : '{' inner* '}' ;
stmt : block | 'html' | ';'
 | 'if' '(' e ')' ifrest
 | 'while' '(' e ')' (stmt | ':' inner* 'endwhile' ';')
 | 'do' stmt 'while' '(' e ')' ';'
 | 'for' '(' elist ';' elist ';' elist ')' (stmt | ':' inner* 'endfor' ';')
 | 'foreach' '(' e 'as' fv ('=>' fv)? ')' (stmt | ':' inner* 'endforeach' ';')
 | 'switch' '(' e ')' ('{' ';'? case* '}' | ':' ';'? case* 'endswitch' ';')
 | 'break' NUM? ';' | 'continue' NUM? ';' | 'return' e? ';'
 | 'echo' e (',' e)* ';'
 | 'global' simplevar (',' simplevar)* ';'
 | 'static' staticvar (',' staticvar)* ';'
 | 'unset' '(' variable vars ')' ';'
 | 'try' block catch* ('finally' block)?
 | 'declare' '(' NAME '=' e (',' NAME '=' e)* ')' (stmt | ':' inner* 'enddeclare' ';')
 | 'goto' ident ';' | NAME ':'
 | e ';' ;
ifrest : stmt elses | ':' inner* altelse ;
elses : 'elseif' '(' e ')' stmt elses | 'else' stmt | ;
altelse : 'elseif' '(' e ')' ':' inner* altelse | 'else' ':' inner* 'endif' ';' | 'endif' ';' ;
case : ('case' e | 'default') (':' | ';') inner* ;
catch : 'catch' '(' name ('|' name)* catchvar ')' block ;
catchvar : VAR | {8.0 8.1 8.2} ;
fv : '&' variable | variable | '[' items ']' | 'list' '(' items ')' ;
variable : simplevar post* | path post+ | 'static' post+ | '(' e ')' post+ | string post+ | array post+ | '[' items ']' post+ ;
vars : ',' (variable vars)? | ;
elist : (e (',' e)*)? ;
staticvar : VAR ('=' e)? ;
constitem : ident '=' e ;
simplevar : VAR | '$' simplevar | '$' '{' e '}' ;

fundecl : attr* 'function' '&'? funname '(' params ')' ret? block ;
funname : NAME | 'enum' | 'readonly' | {7.4} 'match' ;
params : (param moreparams)? ;
moreparams : ',' params | ;
param : attr* promo* type? '&'? '...'? VAR ('=' e)? ;
promo : {8.0 8.1 8.2} ('public' | 'protected' | 'private') | {8.1 8.2} 'readonly' ;
ret : ':' type ;
type : '?' atom | atom (('|' atom)* | {8.1 8.2} ('&' atom)+) | {8.2} dnf ('|' (atom | dnf))* | {8.2} atom ('|' atom)* '|' dnf ('|' (atom | dnf))* ;
dnf : '(' atom ('&' atom)+ ')' ;
atom : name | 'array' | 'callable' | 'static' ;
attr : '#[' attritem moreattrs ']' ;
moreattrs : ',' (attritem moreattrs)? | ;
attritem : name args? ;

classdecl : attr* classmod* 'class' classname ('extends' name)? ('implements' names)? body
 | attr* 'interface' classname ('extends' names)? body | attr* 'trait' classname body
 | {8.1 8.2} attr* 'enum' classname (':' type)? ('implements' names)? body ;
classname : NAME | 'enum' ;
classmod : 'abstract' | 'final' | {8.2} 'readonly' ;
names : name (',' name)* ;
body : '{' member* '}' ;
member : attr* mod* 'function' '&'? ident '(' params ')' ret? (block | ';')
 | attr* mod+ type? prop (',' prop)* ';'
 | attr* mod* 'const' constitem (',' constitem)* ';'
 | 'use' names (';' | '{' adapt* '}')
 | {8.1 8.2} attr* 'case' ident ('=' e)? ';' ;
mod : 'public' | 'protected' | 'private' | 'static' | 'abstract' | 'final' | 'var' | {8.1 8.2} 'readonly' ;
prop : VAR ('=' e)? ;
adapt : adaptname 'insteadof' names ';' | adaptname 'as' (access ident? | ident) ';' ;
adaptname : name ('::' NAME)? ;
access : 'public' | 'protected' | 'private' ;

e : c0 tern ;
tern : '?' e ':' c0 oldtern | '?' ':' c0 elvis | ;
oldtern : {7.4} tern | {8.0 8.1 8.2} ;
elvis : '?' ':' c0 elvis | {7.4} '?' e ':' c0 tern | ;
# a chain of operands and operators; its state tells which comparison it may not meet again before a looser operator:
# c0 none, cr an ordering, ce an equality, cx both
c0 : prefix c0 | loose | plain r0 | simplevar post* a0 | path p0 | 'static' post+ a0 | group g0 | '[' items ']' d0 | array g0 | 'list' '(' items ')' '=' c0 | string g0 ;
cr : prefix cr | loose | plain rr | simplevar post* ar | path pr | 'static' post+ ar | group gr | '[' items ']' dr | array gr | 'list' '(' items ')' '=' c0 | string gr ;
ce : prefix ce | loose | plain re | simplevar post* ae | path pe | 'static' post+ ae | group ge | '[' items ']' de | array ge | 'list' '(' items ')' '=' c0 | string ge ;
cx : prefix cx | loose | plain rx | simplevar post* ax | path px | 'static' post+ ax | group gx | '[' items ']' dx | array gx | 'list' '(' items ')' '=' c0 | string gx ;
r0 : 'instanceof' kindof r0 | tight c0 | free c0 | order cr | equal ce | ;
rr : 'instanceof' kindof rr | tight cr | free c0 | equal ce | ;
re : 'instanceof' kindof re | tight ce | free c0 | order cx | ;
rx : 'instanceof' kindof rx | tight cx | free c0 | ;
a0 : assign | '++' r0 | '--' r0 | r0 ;
ar : assign | '++' rr | '--' rr | rr ;
ae : assign | '++' re | '--' re | re ;
ax : assign | '++' rx | '--' rx | rx ;
p0 : post+ a0 | r0 ;
pr : post+ ar | rr ;
pe : post+ ae | re ;
px : post+ ax | rx ;
g0 : post+ a0 | r0 ;
gr : post+ ar | rr ;
ge : post+ ae | re ;
gx : post+ ax | rx ;
d0 : '=' c0 | g0 ;
dr : '=' c0 | gr ;
de : '=' c0 | ge ;
dx : '=' c0 | gx ;
assign : assignop c0 | '=' assigned ;
assigned : c0 | '&' (variable | {7.4} 'new' newrest) r0 ;
kindof : path | 'static' | simplevar newpost* | {8.0 8.1 8.2} '(' e ')' ;
prefix : '!' | '~' | '+' | '-' | '@' | '++' | '--' | CAST | {7.4} OLDCAST | 'clone' ;
loose : ('print' | 'include' | 'include_once' | 'require' | 'require_once' | 'yield_from' | 'throw') c0 | 'yield' (c0 ('=>' c0)?)?
 | 'static'? 'fn' '&'? '(' params ')' ret? '=>' c0 | attr+ 'static'? 'fn' '&'? '(' params ')' ret? '=>' c0 ;
lambda : 'function' '&'? '(' params ')' ('use' '(' lexvars ')')? ret? block ;
lexvars : (lexvar (',' lexvars)?)? ;
lexvar : '&'? VAR ;
plain : NUM | 'new' newrest | 'isset' '(' e exprs ')' | 'empty' '(' e ')' | 'eval' '(' e ')' | 'exit' ('(' e? ')')? | 'static'? lambda | attr+ 'static'? lambda
 | {8.0 8.1 8.2} 'match' '(' e ')' '{' arms '}' ;
path : NAME | QNAME | 'enum' | 'readonly' | {7.4} 'match' ;
group : '(' e ')' ;
string : STR | 'ENC' part* 'ENC_END' ;
part : 'PART' e '}' ;
array : 'array' '(' items ')' ;
items : item? (',' item?)* ;
item : e ('=>' (e | '&' variable))? | '&' variable | '...' e ;
post : '[' e? ']' | {7.4} '{' e '}' | '->' prop_name | {8.0 8.1 8.2} '?->' prop_name | '::' static_name | args ;
prop_name : NAME | simplevar | '{' e '}' ;
static_name : NAME | simplevar | '{' e '}' ;
args : '(' arglist ')' | {8.1 8.2} '(' '...' ')' ;
arglist : (arg morearg)? ;
morearg : ',' arglist | ;
arg : e | '...' e | {8.0 8.1 8.2} ident ':' e ;
newrest : newname args? | attr* newmod? 'class' args? ('extends' name)? ('implements' names)? body ;
newmod : {8.2} 'readonly' ;
newname : path | 'static' | simplevar newpost* | '(' e ')' ;
newpost : '[' e? ']' | '->' prop_name | {8.0 8.1 8.2} '?->' prop_name | '::' simplevar ;
arms : (arm morearms)? ;
morearms : ',' arms | ;
arm : ('default' ','? | e exprs) '=>' e ;
exprs : ',' (e exprs)? | ;
"""


@lru_cache(maxsize=1)
def grammar() -> Grammar:
    text = _GRAMMAR + f"ident : NAME | {_any(KEYWORDS)} ;\n"
    order, equal = {"<", "<=", ">", ">="}, {"==", "!=", "<>", "===", "!==", "<=>"}
    free = {"&&", "||", "??", "|", "^", "&", "and", "or", "xor"}
    text += f"order : {_any(order)} ;\nequal : {_any(equal)} ;\nfree : {_any(free)} ;\ntight : {_any((BINARY | {'-'}) - order - equal - free)} ;\nassignop : {_any(ASSIGN)} ;\n"
    return Grammar(text, "file", DIALECTS, greedy=("elses",))  # an else belongs to the last if


_NOT_OCTAL = re.compile(r"0[0-9_]*[89][0-9_]*\Z")
#: Files that must hold an open tag; in templates plain text is enough.
CODE = (".php", ".inc", ".module")


def check(content: bytes, template: bool) -> tuple[int, str | None, int]:
    """(dialects that accept, what is wrong, line); an empty file is valid."""
    text = content.decode("latin-1")
    if not text:
        return grammar().all, None, 0
    if not template and not has_open_tag(text):
        return 0, "no PHP open tag", 1
    try:
        toks = tokens(text)
    except LexError as x:
        return 0, str(x), Lines(text).at(x.at)[0]
    g = grammar()
    term = g.terminals
    kinds = [term.get(t[0], -1) for t in toks]
    num = term["NUM"]
    for i, k in enumerate(kinds):
        # a number that begins with 0 is octal
        if k == num and text[toks[i].start] == "0" and _NOT_OCTAL.match(text, toks[i].start, toks[i].end):
            kinds[i] = -1
    ok, far = g.parse(kinds)
    if ok == g.all:
        return ok, None, 0
    lines = Lines(text)
    if far >= len(toks):
        return ok, "unexpected end of file", lines.at(max(len(text) - 1, 0))[0]
    t = toks[far]
    return ok, f"unexpected {text[t.start : min(t.end, t.start + 40)]!r}", lines.at(t.start)[0]
